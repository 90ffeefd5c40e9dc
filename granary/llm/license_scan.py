"""Licence scan: normalised text compared to licence templates by the Dice coefficient over word bigrams.

Text is lower-cased and cut to words of letters and digits; lines and punctuation play no part in the comparison. A
template is compared to every window of words that can reach the threshold, so a notice is found wherever it stands:
wrapped, inside a longer line, or followed by more text. Only windows that begin and end with something of the template
count, as others are beaten by a shorter one. Texts that hold too few distinct bigrams of a template for any window to
reach the threshold are left out before windows are made, which loses nothing.

The Dice coefficient is over distinct bigrams, with one that marks the start and one the end of a window, so that notices
of one word count too. Templates are short notices and the full texts in the folder licenses.

Of a template's windows that overlap, the likest is reported (then the earlier, then the shorter one); of different
templates' windows of which half or more coincide, the likest (then the longer one, then the template named first in
the alphabet). A short notice that stands in a full text is reported beside it.

Defined cases: null and empty texts have no findings; a null doc_id is scanned like any; repeated rows are scanned each.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.common import prepare

WORD = regex.compile(r"[\p{L}\p{N}]+")

#: Short notices by which texts name their licence, from the licences' own instructions for use and common practice.
TEMPLATES = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0."],
    "Apache-2.0 notice": ["Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."],
    "MIT": ["Released under the MIT License."],
    "MIT notice": ["Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction."],
    "BSD-3-Clause": ["Licensed under the BSD 3-Clause License."],
    "BSD notice": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met."],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2."],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3."],
    "LGPL-3.0": ["This work is licensed under the GNU Lesser General Public License, version 3."],
    "AGPL-3.0": ["This work is licensed under the GNU Affero General Public License, version 3."],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0."],
    "CC-BY-ND-4.0": ["Licensed under CC BY-ND 4.0."],
    "CC0-1.0": ["Dedicated to the public domain under CC0 1.0."],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
    "All rights reserved": ["All rights reserved."],
    "BSD-2-Clause header": ["Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer."],
}

#: Full licence texts, without the lines that name an owner.
TEMPLATES |= {f"{p.stem} text": p.read_text(encoding="utf-8").split("\n") for p in sorted((Path(__file__).parent / "licenses").glob("*.txt"))}


@dataclass(frozen=True)
class LicenseParams:
    dice: float = 0.8


@dataclass(frozen=True)
class Template:
    name: str
    first: str
    last: str
    pairs: frozenset  # distinct bigrams, without the marks
    size: int  # with them
    most: int  # distinct bigrams of a window that reaches the threshold, marks included
    need: int  # bigrams that such a window shares, marks left out


class Scanner:
    def __init__(self, templates: dict[str, list[str]], params: LicenseParams):
        self.least = d = params.dice
        self.templates = []
        for name in sorted(templates):
            words = WORD.findall("\n".join(templates[name]).lower())
            if words:
                pairs = frozenset(zip(words, words[1:], strict=False))
                n = len(pairs) + 2
                # 2 s >= d (own + n) and own >= s bound s from below and own from above
                self.templates.append(Template(name, words[0], words[-1], pairs, n, int(n * (2 - d) / d + 1e-9), int(np.ceil(d * n / (2 - d) - 1e-9)) - 2))
        self.ids = {w: i for i, w in enumerate(sorted({w for t in self.templates for w in (t.first, *(x for p in t.pairs for x in p))}))}
        found = sorted((self.ids[a] * len(self.ids) + self.ids[b], i) for i, t in enumerate(self.templates) for a, b in t.pairs)
        self.keys, begin = np.unique(np.array([k for k, _ in found], np.int64), return_index=True)
        self.owners, self.begin = np.array([i for _, i in found], np.int64), np.append(begin, len(found))
        self.need = np.array([t.need for t in self.templates])
        self.single = {}  # templates of so few words that a window may share the marks alone
        for i, t in enumerate(self.templates):
            if t.need <= 0:
                self.single.setdefault(self.ids[t.first], []).append(i)

    def scan(self, text: str) -> list[dict]:
        """license, dice, line (from 0) and lines of the windows at least `dice` like a template."""
        text = text.lower()
        words = WORD.findall(text)
        which = self.candidates(words)
        if not len(which):
            return []
        seen: dict[str, int] = {}
        own = np.array([seen.setdefault(w, len(seen)) for w in words], np.int64)
        pair = own[:-1] * len(seen) + own[1:]
        _, at = np.unique(pair, return_inverse=True)
        order = np.argsort(at, kind="stable")
        again = at[order[1:]] == at[order[:-1]]
        before, final = np.full(len(pair), -1), np.ones(len(pair), bool)  # where a bigram stood last; whether it comes no more
        before[order[1:][again]] = order[:-1][again]
        final[order[:-1][again]] = False
        found = []
        for t in (self.templates[i] for i in which):
            shared = np.isin(pair, [seen[a] * len(seen) + seen[b] for a, b in t.pairs if a in seen and b in seen])
            first, last = own == seen.get(t.first, -1), own == seen.get(t.last, -1)
            found += [(*w, t.name) for w in self.windows(t, before, final, shared, first, last)]
        kept = []
        for i, j, dice, name in sorted(found, key=lambda w: (-w[2], w[0] - w[1], w[3])):
            if all(2 * (min(j, y) - max(i, x)) < max(j, y) - min(i, x) for x, y, _, _ in kept):
                kept.append((i, j, dice, name))
        if not kept:
            return []
        breaks = [m.start() for m in regex.finditer("\n", text)]
        line = np.searchsorted(breaks, [m.start() for m in WORD.finditer(text)])
        return [{"license": name, "dice": dice, "line": int(line[i]), "lines": int(line[j - 1] - line[i] + 1)} for i, j, dice, name in sorted(kept)]

    def candidates(self, words: list[str]) -> np.ndarray:
        """The templates of which the text holds enough distinct bigrams."""
        ids = np.fromiter(map(self.ids.get, words, itertools.repeat(-1)), np.int64, len(words))
        both = (ids[:-1] >= 0) & (ids[1:] >= 0)
        small = [i for w in self.single if (ids == w).any() for i in self.single[w]]
        if not both.any() or not len(self.keys):
            return np.array(small, np.int64)
        pair = np.unique(ids[:-1][both] * len(self.ids) + ids[1:][both])
        at = np.searchsorted(self.keys, pair)
        at = at[self.keys[np.minimum(at, len(self.keys) - 1)] == pair]
        n = np.bincount(np.concatenate([self.owners[self.begin[k] : self.begin[k + 1]] for k in at]), minlength=len(self.templates)) if len(at) else np.zeros(len(self.templates), np.int64)
        return np.union1d(np.flatnonzero((n >= self.need) & (self.need > 0)), np.array(small, np.int64)).astype(np.int64)

    def windows(self, t: Template, before: np.ndarray, final: np.ndarray, shared: np.ndarray, first: np.ndarray, last: np.ndarray) -> list[tuple[int, int, float]]:
        """(from, to, dice): the template's windows of words that don't overlap, likest first."""
        out, todo = [], [(0, len(first))]
        while todo:
            lo, hi = todo.pop()
            # distinct bigrams of the template from each word on, bounded from above
            count = shared & final if hi == len(first) else shared
            rest = np.append(np.cumsum(count[lo : hi - 1][::-1])[::-1], 0)
            starts = lo + np.flatnonzero((np.append(shared[lo : hi - 1], False) | first[lo:hi]) & (rest >= t.need))
            likely, past = [], -1
            for i in starts.tolist():
                if i < past:
                    continue
                reach = self.reach(t, i, hi, before, shared, first, last)
                if reach:
                    likely.append((i, *reach))
                    past = reach[0] if reach[1] == 1 else past  # nothing inside is likelier
            while likely:  # groups of overlapping windows: the best one, then what it leaves on its two sides
                end, n = likely[0][3], 1
                while n < len(likely) and likely[n][0] < end:
                    end, n = max(end, likely[n][3]), n + 1
                group, likely = likely[:n], likely[n:]
                i, j, dice, _ = min(group, key=lambda w: (-w[2], w[0], w[1]))
                out.append((i, j, dice))
                todo += [(a, b) for a, b in ((group[0][0], i), (j, end)) if b > a]
        return out

    def reach(self, t: Template, i: int, hi: int, before: np.ndarray, shared: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[int, float, int] | None:
        """The best end of a window from word i on, its coefficient, and the farthest end that reaches the threshold."""
        span = 2 * t.most
        while True:
            to = min(hi, i + span)
            new = before[i : to - 1] < i
            size = np.concatenate([[2], np.cumsum(new) + 2])
            if to == hi or size[-1] > t.most:
                break
            span *= 2
        have = np.concatenate([[0], np.cumsum(new & shared[i : to - 1])]) + last[i:to] + first[i]
        dice = 2 * have / (size + t.size)
        ok = np.flatnonzero(dice >= self.least)
        if not len(ok):
            return None
        best = int(dice.argmax())
        return i + best + 1, float(dice[best]), i + int(ok[-1]) + 1


@cache
def default_scanner(params: LicenseParams) -> Scanner:
    return Scanner(TEMPLATES, params)


def scan(documents: DataFrame, templates: dict[str, list[str]] | None = None, params: LicenseParams = LicenseParams()) -> DataFrame:
    """doc_id, license, dice, line (from 0), lines: where windows at least `dice` like a template stand, with the likest one."""
    spark = documents.sparkSession
    prepare(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = default_scanner(params) if templates is None else Scanner(templates, params)
        for b in batches:
            rows = [(d, f["license"], f["dice"], f["line"], f["lines"]) for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) if t for f in scanner.scan(t)]
            kinds = [pa.int64(), pa.string(), pa.float64(), pa.int32(), pa.int32()]
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "license", "dice", "line", "lines"])

    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, license string, dice double, line int, lines int")
