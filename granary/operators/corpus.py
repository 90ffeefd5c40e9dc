"""Chunks: the one base table of the engine, its derivation from documents, and its status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, StringType, StructField, StructType

from granary.functions import text as T

CHUNK = StructType(
    [
        StructField("id", StringType()),
        StructField("text", StringType()),
        StructField("page_start", IntegerType()),
        StructField("page_end", IntegerType()),
        StructField("section_title", StringType()),
        StructField("word_count", IntegerType()),
        StructField("char_count", IntegerType()),
        StructField("source_file", StringType()),
        StructField("has_table", BooleanType()),
    ]
)


def chunks(documents: DataFrame) -> DataFrame:
    """Each document as one chunk: chunk_id, text, source_file."""
    return documents.select(F.col("doc_id").alias("chunk_id"), "text", F.col("source").alias("source_file"))


def full_chunks(documents: DataFrame) -> DataFrame:
    """Documents in the schema of the base table."""
    return documents.select(
        F.concat("source", F.lit("_"), F.lpad(F.col("doc_id").cast("string"), 6, "0")).alias("id"),
        "text",
        F.lit(1).alias("page_start"),
        F.lit(1).alias("page_end"),
        F.lit("").alias("section_title"),
        T.word_count("text").alias("word_count"),
        F.length("text").alias("char_count"),
        F.col("source").alias("source_file"),
        T.has_table("text").alias("has_table"),
    )


def chunk_id(file: Column, number: Column) -> Column:
    """The file's name with its dots replaced, and a running number."""
    return F.concat(F.replace(file, F.lit("."), F.lit("_")), F.format_string("_%06d", number))


def page_start(pages: Column) -> Column:
    return F.coalesce(F.array_min(pages), F.lit(1))


def page_end(pages: Column) -> Column:
    return F.coalesce(F.array_max(pages), F.lit(1))


def section(section_title: Column, elements: Column) -> Column:
    """The section of the metadata, else the first Title among the elements (kind, text), else the empty string."""
    return F.coalesce(section_title, F.get(F.filter(elements, lambda e: e["kind"] == "Title"), F.lit(0))["text"], F.lit(""))


def windows(rows: DataFrame, size: int, overlap: int) -> DataFrame:
    """Windows of size words, each overlapping the one before: chunk_id, window, word_start, text."""
    words = F.filter(F.split(F.coalesce("text", F.lit("")), r"\s+"), lambda w: w != "")
    stride = size - overlap
    at = F.when(F.size("words") > 0, F.sequence(F.lit(0), F.size("words") - 1, F.lit(stride))).otherwise(F.array().cast("array<int>"))
    cut = rows.withColumn("words", words).select("chunk_id", "words", F.posexplode(at).alias("window", "word_start"))
    return cut.select("chunk_id", "window", "word_start", F.array_join(F.slice("words", F.col("word_start") + 1, F.lit(size)), " ").alias("text"))


def sentence_windows(rows: DataFrame, size: int, overlap: int) -> DataFrame:
    """Greedy windows of whole sentences: at most size words where sentences allow, carrying over up to overlap words."""
    count = lambda s: F.size(F.filter(F.split(s, r"\s+"), lambda w: w != ""))
    parts = F.filter(T.sentences(F.trim(F.coalesce("text", F.lit("")))), lambda s: s != "")
    start = F.struct(F.array().cast("array<array<string>>").alias("done"), F.array().cast("array<string>").alias("open"))
    words = lambda a: F.aggregate(a, F.lit(0), lambda n, s: n + count(s))
    # the tail that is carried over: sentences from the end while they fit into the overlap
    tail = lambda a: F.aggregate(F.reverse(a), F.struct(F.array().cast("array<string>").alias("kept"), F.lit(False).alias("full")), lambda k, s: F.when(k["full"] | (words(k["kept"]) + count(s) > overlap), F.struct(k["kept"].alias("kept"), F.lit(True).alias("full"))).otherwise(F.struct(F.concat(F.array(s), k["kept"]).alias("kept"), F.lit(False).alias("full"))), lambda k: k["kept"])
    step = lambda acc, s: F.when(
        (F.size(acc["open"]) > 0) & (words(acc["open"]) + count(s) > size),
        F.struct(F.concat(acc["done"], F.array(acc["open"])).alias("done"), F.concat(tail(acc["open"]), F.array(s)).alias("open")),
    ).otherwise(F.struct(acc["done"].alias("done"), F.concat(acc["open"], F.array(s)).alias("open")))
    made = F.aggregate(parts, start, step, lambda acc: F.filter(F.concat(acc["done"], F.array(acc["open"])), lambda w: F.size(w) > 0))
    return rows.select("chunk_id", F.posexplode(made).alias("window", "parts")).select("chunk_id", "window", F.array_join("parts", " ").alias("text"))


def chunk_by_title(elements: DataFrame, hard: int = 2000, soft: int = 1500, combine: int = 200, least_words: int = 50) -> DataFrame:
    """Elements (file, position, kind, text, page) to chunks that titles bound.

    A title opens a section. Sections shorter than combine characters join the one before; a section's text is cut when
    soft characters are reached, and no chunk has more than hard. Chunks under least_words go; numbers keep their gaps.
    """
    by_file = Window.partitionBy("file").orderBy("position")
    parts = elements.withColumn("section", F.sum(F.when(F.col("kind") == "Title", 1).otherwise(0)).over(by_file))
    sections = parts.groupBy("file", "section").agg(F.array_sort(F.collect_list(F.struct("position", "text", "kind", "page"))).alias("e"), F.sum(F.length("text") + 1).alias("chars"))
    sections = sections.withColumn("wide", F.coalesce(F.lag("chars").over(Window.partitionBy("file").orderBy("section")), F.lit(0)))
    groups = sections.withColumn("g", F.sum(F.when(F.col("wide") >= combine, 1).otherwise(0)).over(Window.partitionBy("file").orderBy("section")))
    whole = groups.groupBy("file", "g").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("section", "e"))), lambda s: s["e"])).alias("e"))
    line = whole.select("file", "g", F.posexplode("e").alias("n", "x")).select("file", "g", "n", "x.*")
    # a soft cut wherever the running number of characters passes another multiple of soft, a hard cut inside an element
    running = F.sum(F.length("text") + 1).over(Window.partitionBy("file", "g").orderBy("n"))
    line = line.withColumn("cut", F.floor((running - 1) / soft))
    piece = line.groupBy("file", "g", "cut").agg(F.array_sort(F.collect_list(F.struct("n", "text", "kind", "page"))).alias("e"))
    text = F.array_join(F.transform("e", lambda x: x["text"]), "\n\n")
    piece = piece.withColumn("text", text).withColumn("hard", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.expr(f"(length(text) - 1) div {hard}").cast("int")))))
    piece = piece.withColumn("i", F.row_number().over(Window.partitionBy("file").orderBy("g", "cut", "hard")) - 1)
    cut = F.substring(F.col("text"), F.col("hard") * hard + 1, F.lit(hard))
    pages = F.transform("e", lambda x: x["page"])
    rows = piece.select(
        chunk_id(F.col("file"), F.col("i")).alias("id"),
        cut.alias("text"),
        page_start(pages).alias("page_start"),
        page_end(pages).alias("page_end"),
        F.coalesce(F.get(F.filter("e", lambda x: x["kind"] == "Title"), F.lit(0))["text"], F.lit("")).alias("section_title"),
        F.col("file").alias("source_file"),
    )
    rows = rows.withColumn("word_count", T.word_count("text")).withColumn("char_count", F.length("text")).withColumn("has_table", T.has_table("text"))
    return rows.where(F.col("word_count") >= least_words).select(CHUNK.fieldNames())


def renumber(parts: list[DataFrame]) -> DataFrame:
    """The union of several files' chunks (chunk_id, text, source_file), renumbered globally by file and position.

    Numbers come from counts a file and ranks inside a file, so no task sees more than one file's ids.
    """
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    counts = rows.groupBy("source_file").agg(F.count("*").alias("n"))
    offsets = counts.select("source_file", F.coalesce(F.sum("n").over(Window.orderBy("source_file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("offset"))
    ranked = rows.withColumn("r", F.row_number().over(Window.partitionBy("source_file").orderBy("chunk_id")) - 1)
    return ranked.join(offsets, "source_file").select(F.format_string("chunk_%06d", F.col("r") + F.col("offset")).alias("id"), "chunk_id", "source_file")


def reading_order(words: DataFrame, width: float) -> DataFrame:
    """Text of each page from words (page, text, x0, x1, top): column by column if the right half has enough words."""
    right = (F.col("x0") >= width / 2).cast("int")
    page = Window.partitionBy("page")
    enough = F.sum(right).over(page) >= F.greatest(F.lit(3), F.floor(F.count("*").over(page) / 10))
    placed = words.withColumn("side", F.when(enough, right).otherwise(F.lit(0)))
    order = F.array_sort(F.collect_list(F.struct("side", "top", "x0", "text")))
    return placed.groupBy("page").agg(F.array_join(F.transform(order, lambda w: w["text"]), " ").alias("text"))


def headings(chars: DataFrame) -> DataFrame:
    """The heading of each page from chars (page, position, text, size): those larger than the most frequent size + 2.

    Of several most frequent sizes the one that comes first on the page counts.
    """
    sizes = chars.groupBy("page", "size").agg(F.count("*").alias("n"), F.min("position").alias("first"))
    body = sizes.groupBy("page").agg(F.max_by("size", F.struct("n", -F.col("first"))).alias("body"))
    large = chars.join(body, "page").where("size > body + 2")
    found = large.groupBy("page").agg(F.trim(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "text"))), lambda c: c["text"]), "")).alias("section_title"))
    return body.join(found, "page", "left").select("page", F.coalesce("section_title", F.lit("")).alias("section_title"))


def status(rows: DataFrame) -> DataFrame:
    """One row: the number of chunks, the first source file and all of them, sorted."""
    return rows.agg(F.count("*").alias("n_chunks"), F.min_by("source_file", "chunk_id").alias("first_source"), F.array_sort(F.collect_set("source_file")).alias("source_files"))


def exact_duplicates(rows: DataFrame) -> DataFrame:
    """Chunks with distinct texts: of equal ones the smallest chunk_id stays."""
    return rows.groupBy(F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest")).agg(F.min("chunk_id").alias("chunk_id"), F.count("*").alias("copies"))


def scaled(rows: DataFrame, scale: int) -> DataFrame:
    """The corpus scale times, copies with the suffix of their number."""
    copies = rows.select("*", F.explode(F.sequence(F.lit(0), F.lit(scale - 1))).alias("copy"))
    return copies.select(F.when(F.col("copy") == 0, F.col("chunk_id").cast("string")).otherwise(F.concat(F.col("chunk_id").cast("string"), F.lit("__dup"), F.col("copy"))).alias("id"), "text", "source_file")
