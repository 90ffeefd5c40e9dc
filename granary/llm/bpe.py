"""Byte-pair encoding and decoding of whole texts by a pair occurrence index.

The distinct pieces of a stretch of a partition (texts cut by the vocabulary's pattern) are laid end to end as byte
symbols. An index maps each mergeable pair to all its positions. Active ranks are taken in ascending order; a rank is
applied at all its positions at once, left to right where they overlap, and only the lists of the pairs beside them are
updated. Pieces met before in the same worker are kept in a bounded table.

Vocabulary: a tokenizers JSON file with a BPE model and a ByteLevel pre-tokenizer; its path is a parameter.

Defined cases: a null text counts as empty (no ids); the text of an added token is cut out first and gets its own id;
null or repeated doc_id: rows are encoded each by itself; empty tables give empty results; other columns pass through.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from granary.llm.common import prepare
from granary.llm.quality_classifier import schema_with

#: Fixed: the pattern of the byte-level pre-tokenizer, from its public description.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
@dataclass(frozen=True)
class BpeParams:
    """chunk_bytes: text whose new pieces are encoded together; kept_pieces: bound of a worker's table."""

    chunk_bytes: int = 6 << 20
    kept_pieces: int = 400_000


def byte_symbols() -> dict[int, str]:
    """The printable character that stands for each byte: itself if printable Latin-1, else the next from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Vocabulary:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        model, symbol = file["model"], byte_symbols()
        byte_of = {s: b for b, s in symbol.items()}
        ids = model["vocab"]
        self.bytes_of = {i: bytes(byte_of[c] for c in t) for t, i in ids.items()}
        self.added = {t["content"]: t["id"] for t in file["added_tokens"]}
        self.bytes_of |= {i: t.encode() for t, i in self.added.items()}
        self.first = np.array([ids[symbol[b]] for b in range(256)], np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        key = np.array([ids[a] << 32 | ids[b] for a, b in pairs], np.int64)
        self.made = np.array([ids[a + b] for a, b in pairs], np.int64)
        order = np.argsort(key, kind="stable")
        self.keys, self.rank_of = key[order], order
        self.key = key
        self.of_bytes = np.full(65536, -1, np.int64)  # ranks of pairs of bytes
        both = np.arange(65536)
        self.of_bytes[:] = self.ranks(self.first[both >> 8], self.first[both & 255])
        self.text_of = {i: str(i) for i in self.bytes_of}
        self.cut = regex.compile(PATTERN)
        self.added_cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Of pairs of ids; -1 where they don't merge."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank_of[at], -1) if len(self.keys) else np.full(len(key), -1)

    def encode_pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pieces, end to end, and where each piece's end."""
        data = np.frombuffer(b"".join(pieces), np.uint8)
        n = len(data)
        edges = np.cumsum([len(p) for p in pieces])
        symbols, after, before = self.first[data], np.arange(1, n + 1), np.arange(-1, n - 1)
        after[edges[edges > 0] - 1] = -1
        before[edges[(edges > 0) & (edges < n)]] = -1
        live = np.ones(n, bool)
        few = len(self.key) < 65536
        lists: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def index(at: np.ndarray, r: np.ndarray) -> None:
            """Put the pairs that begin at these positions on the lists of their ranks."""
            ok = r >= 0
            at, r = at[ok], r[ok]
            if not len(r):
                return
            order = np.argsort(r.astype(np.uint16) if few else r, kind="stable")  # 16 bits are sorted by radix
            at, r = at[order], r[order]
            cuts = [0, *(np.flatnonzero(r[1:] != r[:-1]) + 1).tolist(), len(r)]
            for i, rank in enumerate(r[cuts[:-1]].tolist()):
                some = at[cuts[i] : cuts[i + 1]]
                if rank in lists:
                    lists[rank].append(some)
                else:
                    lists[rank] = [some]
                    heapq.heappush(heap, rank)

        begins = np.flatnonzero(after >= 0)
        index(begins, self.of_bytes[data[begins].astype(np.int64) << 8 | data[begins + 1]] if n else begins)
        while heap:
            rank = heapq.heappop(heap)
            some = lists.pop(rank)
            at = np.sort(np.concatenate(some)) if len(some) > 1 else some[0]
            if len(some) > 1:
                at = at[np.concatenate([[True], at[1:] != at[:-1]])]
            a, b = self.key[rank] >> 32, self.key[rank] & 0xFFFFFFFF
            then = after[at]
            ok = live[at] & (then >= 0)
            ok[ok] = (symbols[at[ok]] == a) & (symbols[then[ok]] == b)
            at = at[ok]
            if not len(at):
                continue
            if a == b and len(at) > 1:  # a run of one symbol: every second position of it
                starts = np.concatenate([[True], after[at[:-1]] != at[1:]])
                place = np.arange(len(at)) - np.maximum.accumulate(np.where(starts, np.arange(len(at)), 0))
                at = at[place % 2 == 0]
            gone = after[at]
            symbols[at], live[gone] = self.made[rank], False
            then = after[gone]
            after[at] = then
            before[then[then >= 0]] = at[then >= 0]
            left = before[at]
            beside = np.concatenate([left[left >= 0], at[then >= 0]])
            if len(beside):
                beside = np.sort(beside)
                beside = beside[np.concatenate([[True], beside[1:] != beside[:-1]])]
                index(beside, self.ranks(symbols[beside], symbols[after[beside]]))
        kept = np.flatnonzero(live)
        return symbols[kept], np.searchsorted(kept, edges)

    def chunks(self, text: str) -> list:
        """text in chunks that the pattern cuts apart anyway, whatever stands beside them; added tokens as tuples of one.

        The pattern starts a new piece at a newline and at a space that stand alone between other characters. Other
        white space needs the pattern itself.
        """
        if self.added_cut is not None and any(t in text for t in self.added):
            parts = self.added_cut.split(text)
            return [c for i, part in enumerate(parts) for c in ([(part,)] if i % 2 else self.chunks(part) if part else [])]
        if text.split() != text.replace("\n", " ").split(" "):  # two white spaces in a row, or other ones
            return self.cut.findall(text)
        out: list = []
        for i, line in enumerate(text.split("\n")):
            if i:
                out.append("\n")
            first, *rest = line.split(" ")
            if first:
                out.append(first)
            out += [" " + w for w in rest]
        return out

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


class Encoder:
    """A vocabulary with a bounded table of chunks met before: their numbers, and the ids of all of them end to end."""

    def __init__(self, vocabulary: Vocabulary, params: BpeParams = BpeParams()):
        self.vocabulary, self.params = vocabulary, params
        self.forget()

    def forget(self) -> None:
        self.number: dict = {}
        self.ids, self.begin = np.zeros(0, np.int64), np.zeros(1, np.int64)

    def learn(self, wanted: set) -> None:
        new = wanted - self.number.keys()
        if len(self.number) + len(new) > self.params.kept_pieces:
            self.forget()
            new = wanted
        v = self.vocabulary
        pieces, pieces_to, order, special = [], [], [], []
        for c in new:
            if isinstance(c, tuple):
                special.append(c)
                continue
            order.append(c)
            if c.isalpha() or c[0] == " " and c[1:].isalpha():
                pieces.append(c.encode())
            else:
                pieces += [p.encode() for p in v.cut.findall(c)]
            pieces_to.append(len(pieces))
        ids, ends = v.encode_pieces(pieces)
        ends = ends[np.array(pieces_to, np.int64) - 1] if order else np.zeros(0, np.int64)
        ids = np.concatenate([self.ids, ids, np.array([v.added[c[0]] for c in special], np.int64)])
        ends = np.concatenate([ends, np.arange(1, len(special) + 1) + (ends[-1] if len(ends) else 0)])
        n = len(self.number)
        self.number.update(zip([*order, *special], range(n, n + len(ends)), strict=True))
        self.ids, self.begin = ids, np.concatenate([self.begin, ends + self.begin[-1]])

    def encode(self, texts: list[str | None]) -> Iterator[list[int]]:
        """The ids of each text."""
        cut = [self.vocabulary.chunks(t) if t else [] for t in texts]
        self.learn(set().union(*cut))
        for chunks in cut:
            at = np.fromiter(map(self.number.__getitem__, chunks), np.int64, len(chunks))
            begin, size = self.begin[at], self.begin[at + 1] - self.begin[at]
            total = np.cumsum(size)
            yield self.ids[np.arange(total[-1] if len(total) else 0) + np.repeat(begin - total + size, size)].tolist()


_encoders: dict[tuple, Encoder] = {}


def encode(documents: DataFrame, path: str, params: BpeParams = BpeParams(), digests: bool = False) -> DataFrame:
    """documents with n_tokens and either ids (array<int>) and decoded, or, with digests, the SHA-256 of both in hex.

    path: of the vocabulary file, which executors open themselves (it is installed on them as a package's data).
    """
    prepare(documents.sparkSession)
    made = ["n_tokens", "ids_sha256", "decoded_sha256"] if digests else ["n_tokens", "ids", "decoded"]
    kept = documents.select(*[c for c in documents.columns if c not in made])
    names = kept.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoders.get((path, params)) or _encoders.setdefault((path, params), Encoder(Vocabulary(path), params))
        held, size = [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            rows = encoder.encode([t for b in held for t in b.column(names.index("text")).to_pylist()])
            for b in held:
                n, ids, decoded = [], [], []
                for _ in range(b.num_rows):
                    own = next(rows)
                    back = encoder.vocabulary.decode(own)
                    n.append(len(own))
                    ids.append(hashlib.sha256(",".join(map(encoder.vocabulary.text_of.__getitem__, own)).encode()).hexdigest() if digests else own)
                    decoded.append(hashlib.sha256(back.encode()).hexdigest() if digests else back)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(n, pa.int64()), pa.array(ids, pa.string() if digests else pa.list_(pa.int32())), pa.array(decoded, pa.string())], names=[*names, *made])

        for b in batches:
            held.append(b)
            size += b.nbytes
            if size >= params.chunk_bytes:
                yield from flush()
                held, size = [], 0
        if held:
            yield from flush()

    return kept.mapInArrow(run, schema_with(kept, "n_tokens long, ids_sha256 string, decoded_sha256 string" if digests else "n_tokens long, ids array<int>, decoded string"))


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """encoded (with ids array<int>) with the column decoded: the text of the ids, added tokens included; null ids: null."""
    kept = encoded.select(*[c for c in encoded.columns if c != "decoded"])
    names = kept.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = (_encoders.get((path, BpeParams())) or _encoders.setdefault((path, BpeParams()), Encoder(Vocabulary(path)))).vocabulary
        for b in batches:
            texts = [None if ids is None else v.decode(ids) for ids in b.column(names.index("ids")).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], names=[*names, "decoded"])

    return kept.mapInArrow(run, schema_with(kept, "decoded string"))
