"""Deterministic sharded WARC writer and its reader.

Records are range-sorted by page_id and payload digest and dealt to shards of about shard_bytes. Their borders are quantiles, by
payload bytes, of a sample that a hash of the rows picks, some rows a shard, so the same table gives the same files on
any cluster, however unevenly page_ids are spread and however often one occurs. A shard's task rolls files by compressed size, one gzip member
a record after a warcinfo record; headers and digests are made anew; blocks are HTTP messages. A file is written under a temporary name of its own and renamed when it is whole; what a
repeated task wrote before is replaced by the same bytes. The manifest, a table of files with sizes and digests, is
written when all shards are done; readers take only files that it names.

Of records with equal payloads of at least dedup_bytes, the one with the largest page_id is a response and the others
are revisits of it.

Defined cases: a null html is an empty payload; a null page_id sorts first (such rows in shards by digest), and
those are always responses; rows with
equal page_id are a record each, of an id of its own, and of several with the largest page_id and one payload each is a response; null urls
give `about:blank`; an empty table gives an empty manifest; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm.common import prepare, shared_dir


@dataclass(frozen=True)
class WarcParams:
    dedup_bytes: int = 1000
    shard_bytes: int = 32 << 20  # payload bytes a shard has about
    file_bytes: int = 8 << 20  # compressed size from which a file is rolled
    sample: int = 32  # sampled rows a shard, about, that borders are taken from: the bound of what the driver gets
    date: str = "2024-01-01T00:00:00Z"  # of all records: files must not depend on the time of writing
    level: int = 6


def filesystem(folder: str) -> tuple[fs.FileSystem, str]:
    """The file system that a folder's name stands for; a plain path is local (or mounted on all machines)."""
    return fs.FileSystem.from_uri(folder) if ":/" in folder else (fs.LocalFileSystem(), folder)


def packed_record(head: list[str], block: bytes) -> bytes:
    head = ["WARC/1.1", *head, f"WARC-Block-Digest: sha1:{base32(hashlib.sha1(block).hexdigest())}", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def base32(digest: str) -> str:
    return base64.b32encode(bytes.fromhex(digest)).decode()


def opening(name: str, params: WarcParams) -> bytes:
    """The warcinfo record of a file."""
    head = ["WARC-Type: warcinfo", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, name)}>", f"WARC-Date: {params.date}", f"WARC-Filename: {name}", "Content-Type: application/warc-fields"]
    return packed_record(head, b"software: granary\r\nformat: WARC File Format 1.1\r\n")


def record(row: dict, params: WarcParams) -> bytes:
    """One WARC record, its block an HTTP message; a revisit's has no body. row["place"] counts rows of one page_id and payload."""
    payload = (row["html"] or "").encode()
    clean = lambda s: "".join(c if c.isprintable() and c != " " else "%%%02X" % ord(c) for c in s or "") or "about:blank"
    name = lambda page, place: uuid.uuid5(uuid.NAMESPACE_OID, f"page:{page}:{row['payload_digest']}" + f":{place}" * (place > 0))
    head = [
        f"WARC-Type: {row['record_type']}",
        f"WARC-Record-ID: <urn:uuid:{name(row['page_id'], row['place'])}>",
        f"WARC-Date: {params.date}",
        f"WARC-Target-URI: {clean(row['url'])}",
        f"WARC-Payload-Digest: sha1:{base32(row['payload_digest'])}",
        f"X-Payload-Length: {row['payload_bytes']}",
    ]
    if row["page_id"] is not None:
        head.append(f"X-Page-Id: {row['page_id']}")
    if row["record_type"] == "revisit":
        head += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: <urn:uuid:{name(row['refers_to'], 0)}>",
            f"WARC-Refers-To-Target-URI: {clean(row['refers_uri'])}",
            f"WARC-Refers-To-Date: {params.date}",
            f"X-Refers-To-Page-Id: {row['refers_to']}",
        ]
    message = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    return packed_record([*head, "Content-Type: application/http; msgtype=response"], message if row["record_type"] == "revisit" else message + payload)


def revisits(pages: DataFrame, params: WarcParams = WarcParams()) -> DataFrame:
    """(page_id, payload_digest, refers_to, refers_uri) of the pages that repeat a payload. Digests move, payloads don't."""
    html = F.coalesce("html", F.lit(""))
    large = pages.where("page_id is not null").where(F.octet_length(html) >= params.dedup_bytes).select(F.col("page_id").cast("long").alias("page_id"), F.octet_length(html).alias("size"), F.sha1(F.encode(html, "utf-8")).alias("payload_digest"), "url")
    several = large.groupBy("payload_digest", "size").agg(F.max(F.struct("page_id", F.col("url"))).alias("last"), F.min("page_id").alias("first")).where("first < last.page_id")
    # named anew, so that the join shuffles both sides and AQE can split a payload that a third of all pages have
    several = several.select(F.concat("payload_digest", F.lit("")).alias("d"), F.col("size").alias("s"), F.col("last.page_id").alias("refers_to"), F.col("last.url").alias("refers_uri"))
    found = large.join(several, (F.col("payload_digest") == F.col("d")) & (F.col("size") == F.col("s"))).where("page_id < refers_to")
    return found.select("page_id", "payload_digest", "refers_to", "refers_uri").distinct()


def weighed(pages: DataFrame) -> DataFrame:
    """(page_id, point, bytes): point is 32 bits of the payload's digest."""
    html = F.coalesce("html", F.lit(""))
    return pages.select(F.col("page_id").cast("long").alias("page_id"), point(F.sha1(F.encode(html, "utf-8"))).alias("point"), (F.octet_length(html) + 600).cast("long").alias("bytes"))


def point(digest: Column) -> Column:
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


def borders(pages: DataFrame, params: WarcParams) -> tuple[int, list[tuple[int, int]]]:
    """How many shards rows with a null page_id have, and the first (page_id, point) of each other shard but the first."""
    whole = pages.agg(*[F.sum(F.when(c, F.octet_length(F.coalesce("html", F.lit(""))) + 600)) for c in (F.col("page_id").isNull(), F.col("page_id").isNotNull())], F.count("page_id")).first()
    nulls, shards = (-(-(x or 0) // params.shard_bytes) for x in whole[:2])
    if shards < 2:
        return nulls, []
    share = min(1.0, params.sample * shards / whole[2])
    rows = weighed(pages.where("page_id is not null"))
    picked = rows.where(F.pmod(F.xxhash64("page_id", "point"), F.lit(1 << 30)) < int(share * (1 << 30)) + 1).groupBy("page_id", "point").agg(F.sum("bytes").alias("bytes")).toArrow()
    order = np.lexsort((picked.column("point").to_numpy(), picked.column("page_id").to_numpy()))
    page, at, size = (picked.column(c).to_numpy()[order] for c in ("page_id", "point", "bytes"))
    if not len(size):
        return nulls, []
    cut = np.searchsorted(np.cumsum(size), size.sum() / shards * np.arange(1, shards))
    return nulls, sorted({(int(page[i]), int(at[i])) for i in cut if i > 0})


def write(pages: DataFrame, folder: str, params: WarcParams = WarcParams()) -> DataFrame:
    """Write the records as folder/shard-00000-00000.warc.gz and so on; the manifest, as it stands in folder/manifest."""
    spark = pages.sparkSession
    prepare(spark)
    nulls, starts = borders(pages, params)
    sent = spark.sparkContext.broadcast(starts)  # a pair of numbers a shard

    @F.pandas_udf("int")
    def shard_of(page: pd.Series, at: pd.Series) -> pd.Series:
        return pd.Series([nulls + bisect_right(sent.value, x) for x in zip(page, at, strict=True)], dtype="int32")

    html = F.coalesce("html", F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.sha1(F.encode(html, "utf-8")).alias("payload_digest"), F.lit(None).cast("long").alias("refers_to"), "url", html.alias("html"))
    # a note on what a page revisits travels to its shard by itself and sorts right before it: pages are shuffled once
    notes = revisits(pages, params).select("page_id", "payload_digest", "refers_to", F.col("refers_uri").alias("url"), F.lit(None).cast("string").alias("html"))
    at = point(F.col("payload_digest"))
    alone = (at * max(1, nulls) / F.lit(1 << 32)).cast("int")
    dealt = rows.union(notes).withColumn("shard", F.when(F.col("page_id").isNull(), alone).otherwise(shard_of(F.coalesce("page_id", F.lit(0)), at)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, top = filesystem(folder)
        out = None  # [shard, number, temporary name, stream, records, bytes, digest]
        done: list[tuple] = []

        def close() -> None:
            out[3].close()
            name = f"shard-{out[0]:05d}-{out[1]:05d}.warc.gz"
            system.move(out[2], f"{top}/{name}")
            done.append((name, out[4], out[5], out[6].hexdigest()))

        def put(raw: bytes) -> None:
            pack = zlib.compressobj(params.level, zlib.DEFLATED, 31)
            data = pack.compress(raw) + pack.flush()
            out[3].write(data)
            out[5] += len(data)
            out[6].update(data)

        note, before, place = (None,) * 4, None, 0
        for b in batches:
            for row in b.to_pylist():
                key = (row["page_id"], row["payload_digest"])
                if row["html"] is None:
                    note = (*key, row["refers_to"], row["url"])
                    continue
                again = row["page_id"] is not None and note[:2] == key
                before, place = key, place + 1 if before == key else 0
                row |= {"payload_bytes": len(row["html"].encode()), "record_type": "revisit" if again else "response", "refers_to": note[2] if again else None, "refers_uri": note[3], "place": place}
                if out is None or out[0] != row["shard"] or out[5] >= params.file_bytes:
                    if out is not None:
                        close()
                    number = out[1] + 1 if out is not None and out[0] == row["shard"] else 0
                    temporary = f"{top}/temporary/{uuid.uuid4().hex}"
                    out = [row["shard"], number, temporary, system.open_output_stream(temporary, compression=None), 0, 0, hashlib.sha256()]
                    put(opening(f"shard-{out[0]:05d}-{out[1]:05d}.warc.gz", params))
                put(record(row, params))
                out[4] += 1
        if out is not None:
            close()
        columns = list(zip(*done, strict=True)) or [[], [], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.string())], names=["file", "records", "bytes", "sha256"])

    system, top = filesystem(folder)
    system.create_dir(f"{top}/temporary")
    n = nulls + len(starts) + 1
    files = dealt.repartitionByRange(n, "shard").sortWithinPartitions("shard", F.col("page_id").asc_nulls_first(), "payload_digest", F.col("html").isNotNull(), "url").mapInArrow(run, "file string, records long, bytes long, sha256 string")
    files.coalesce(n).write.mode("overwrite").parquet(f"{folder}/manifest")
    system.delete_dir(f"{top}/temporary")
    return spark.read.schema("file string, records long, bytes long, sha256 string").parquet(f"{folder}/manifest")


def parsed(data: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of a stream of gzip members."""
    buffer, unpack = b"", zlib.decompressobj(31)
    for part in data:
        while part:
            buffer += unpack.decompress(part)
            part = unpack.unused_data
            if unpack.eof:
                head, _, block = buffer.partition(b"\r\n\r\n")
                lines = head.decode().split("\r\n")
                if not lines[0].startswith("WARC/1."):
                    raise ValueError("not a WARC record")
                fields = dict(line.split(": ", 1) for line in lines[1:])
                size = int(fields["Content-Length"])
                if block[size:] != b"\r\n\r\n":
                    raise ValueError(f"record {fields['WARC-Record-ID']} has a wrong length")
                yield fields, block[:size]
                buffer, unpack = b"", zlib.decompressobj(31)
    if buffer or not unpack.eof and unpack.unconsumed_tail:
        raise ValueError("the last record is cut off")


def read(spark: SparkSession, folder: str) -> DataFrame:
    """page_id, url, html (null for revisits), payload_bytes, payload_digest (recomputed for responses), record_type, refers_to of the files in the manifest."""
    schema = "page_id long, url string, html string, payload_bytes long, payload_digest string, record_type string, refers_to long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, top = filesystem(folder)
        names = [f.split(" ")[0] for f in schema.split(", ")]
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        for b in batches:
            for file, expected in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rows, size, count = [], 0, 0
                with system.open_input_stream(f"{top}/{file}", compression=None) as stream:
                    for fields, block in parsed(iter(lambda: stream.read(1 << 20), b"")):
                        if fields["WARC-Type"] == "warcinfo":
                            continue
                        block = block.partition(b"\r\n\r\n")[2]
                        digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                        response = fields["WARC-Type"] == "response"
                        if response and (hashlib.sha1(block).hexdigest() != digest or len(block) != int(fields["X-Payload-Length"])):
                            raise ValueError(f"record {fields['WARC-Record-ID']} has a wrong digest")
                        page, refers = fields.get("X-Page-Id"), fields.get("X-Refers-To-Page-Id")
                        rows.append((page and int(page), fields["WARC-Target-URI"], block.decode() if response else None, int(fields["X-Payload-Length"]), digest, fields["WARC-Type"], refers and int(refers)))
                        size += len(block)
                        count += 1
                        if size > 4 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
                            rows, size = [], 0
                if count != expected:
                    raise ValueError(f"{file} has {count} records; the manifest says {expected}")
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    manifest = spark.read.schema("file string, records long, bytes long, sha256 string").parquet(f"{folder}/manifest")
    # a task for some files: their names are dealt out evenly by position
    return manifest.select("file", "records").repartition(spark.sparkContext.defaultParallelism * 4).mapInArrow(run, schema)


def fresh_folder(spark: SparkSession) -> str:
    """A new folder for archives in the shared folder."""
    return f"{shared_dir(spark)}/granary-{uuid.uuid4().hex}/warc"
