"""Reading and writing chunks: JSON arrays, Parquet, text and binary files; pages with their filters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.functions import text as T
from granary.operators.corpus import CHUNK


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """Chunks from a JSON array, JSON lines (multi-line reader takes both forms of a file) or Parquet, in a fixed schema."""
    if path.rstrip("/").endswith((".json", ".jsonl")):
        return spark.read.schema(CHUNK).json(path, multiLine=path.endswith(".json"))
    return spark.read.schema(CHUNK).parquet(path)


def write_chunks(chunks: DataFrame, path: str, form: str = "parquet", force: bool = False) -> None:
    """Write chunks and, beside them, the table of positions (id, position); existing chunks stay unless forced."""
    if form not in ("parquet", "json"):
        raise ValueError(f"unknown form {form!r}")
    mode = "overwrite" if force else "errorifexists"
    chunks.write.mode(mode).format(form).save(path)
    positions(chunks).write.mode(mode).parquet(path.rstrip("/") + "_positions")


def positions(chunks: DataFrame) -> DataFrame:
    """(id, position) in the order of file and id; numbered by file counts and ranks inside a file."""
    from granary.operators.corpus import renumber

    rows = chunks.select(F.col("id").alias("chunk_id"), "source_file", "text")
    return renumber([rows]).select(F.col("chunk_id").alias("id"), F.substring("id", 7, 20).cast("long").alias("position"))


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Text files as pages (file, page_number, text), a form feed between pages; contents and near-empty pages go."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), "value")
    pages = files.select("file", F.posexplode(F.split("value", "\f")).alias("page", "text")).select("file", (F.col("page") + 1).alias("page_number"), "text")
    return filter_pages(pages)


def filter_pages(pages: DataFrame, least: int = 50) -> DataFrame:
    """Pages that are no table of contents and have at least `least` characters when cleaned."""
    return pages.where(~T.is_contents_page("text")).where(F.length(T.clean("text")) >= least)


def check_file(spark: SparkSession, path: str, suffixes: tuple[str, ...] = (".pdf",)) -> None:
    """FileNotFoundError without such a file (a pattern may match none), ValueError for another kind of file."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = place.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(place)
    if found is None or not len(found):
        raise FileNotFoundError(path)
    if any(not f.isDirectory() and not f.getPath().getName().lower().endswith(suffixes) for f in found):
        raise ValueError(f"not a file of kind {', '.join(suffixes)}: {path}")


def check_upload(chunks: DataFrame) -> DataFrame:
    """chunks that may be ingested: ValueError if there are none with a text, or if columns lack."""
    lacking = {"chunk_id", "text", "source_file"} - set(chunks.columns)
    if lacking:
        raise ValueError(f"columns lack: {sorted(lacking)}")
    kept = chunks.where("text is not null and trim(text) != ''")
    if kept.isEmpty():
        raise ValueError("nothing to ingest: no chunk has a text")
    return kept


def page_counts(chunks: DataFrame) -> DataFrame:
    """One row: files, and the sum of their last pages, of chunks (source_file, page_end)."""
    last = chunks.groupBy("source_file").agg(F.coalesce(F.max("page_end"), F.lit(0)).alias("pages"))
    return last.agg(F.count("*").alias("files"), F.coalesce(F.sum("pages"), F.lit(0)).alias("pages"))


def page_elements(pages: DataFrame) -> DataFrame:
    """Elements (file, position, kind, text, page) of pages (file, page_number, text), for chunk_by_title: lines that are
    short and end no sentence are titles, other lines between blank ones are texts."""
    paragraphs = pages.select("file", F.col("page_number").alias("page"), F.posexplode(F.split("text", r"\n\s*\n|\n(?=[^\n]{1,60}(?<![.,;:!?])\n)")).alias("n", "text"))
    paragraphs = paragraphs.withColumn("text", F.trim("text")).where("text != ''")
    kind = F.when((F.length("text") <= 60) & ~F.col("text").rlike(r"[.,;:!?]$") & F.col("text").rlike(r"^\p{Lu}|^\d"), "Title").otherwise("Text")
    place = (F.col("page") * 1_000_000 + F.col("n")).cast("long")
    return paragraphs.select("file", place.alias("position"), kind.alias("kind"), "text", F.col("page").cast("int").alias("page"))


def read_pdf(spark: SparkSession, path: str) -> DataFrame:
    """Pages of PDF files (file, page_number, text), where the optional package pypdf is installed on the executors;
    contents and near-empty pages go."""
    check_file(spark, path)
    try:
        import pypdf  # noqa: F401
    except ImportError as e:
        raise NotImplementedError("reading PDF files needs the package pypdf; text files are read by read_pages") from e

    def run(batches):  # noqa: ANN001, ANN202
        import io

        import pandas as pd
        import pypdf

        for b in batches:
            rows = [(f, i, page.extract_text() or "") for f, c in zip(b["path"], b["content"], strict=True) for i, page in enumerate(pypdf.PdfReader(io.BytesIO(c)).pages, 1)]
            yield pd.DataFrame(rows, columns=["file", "page_number", "text"])

    pages = spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "file string, page_number int, text string")
    return filter_pages(pages.withColumn("text", T.extracted("text")))


def cached(spark: SparkSession, path: str, make, refresh: bool = False) -> DataFrame:  # noqa: ANN001
    """A table that is made once and read after, unless refreshed."""
    from pyspark.errors import AnalysisException

    if not refresh:
        try:
            return spark.read.parquet(path)
        except AnalysisException:
            pass
    make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
