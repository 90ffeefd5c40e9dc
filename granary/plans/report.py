"""Experiments as one run: method comparison, sweeps, scaling, and Markdown of their small result tables."""

from __future__ import annotations

import json
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.config import EngineConfig
from granary.plans.engine import Engine

#: The queries of the registry that make up the experiments, each with a few rows.
EXPERIMENTS = ("method_comparison", "sensitivity_num_perm", "sensitivity_bands", "sensitivity_hamming", "sensitivity_alpha", "precision_curve", "qualitative_counts")


def markdown(rows: list[dict], title: str = "") -> str:
    """A small table of results as Markdown."""
    head = [f"## {title}", ""] if title else []
    if not rows:
        return "\n".join([*head, "No rows.", ""])
    columns = list(rows[0])
    shown = lambda v: "" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v).replace("|", "\\|").replace("\n", " ")
    lines = [columns, ["-"] * len(columns), *[[shown(r[c]) for c in columns] for r in rows]]
    return "\n".join([*head, *["| " + " | ".join(line) + " |" for line in lines], ""])


def run_all(spark: SparkSession, folder: str, names: tuple[str, ...] = EXPERIMENTS) -> dict[str, list[dict]]:
    """The experiments over the tables in a folder, each as a list of rows."""
    from granary.registry import queries

    found = queries()
    return {name: [r.asDict(recursive=True) for r in found[name](spark, folder).collect()] for name in names}


def scalability(spark: SparkSession, chunks: DataFrame, queries: DataFrame, folder: str, scales: tuple[int, ...] = (2, 4, 8), methods: tuple[str, ...] = ("tfidf", "minhash", "simhash", "hybrid"), config: EngineConfig = EngineConfig()) -> list[dict]:
    """Seconds to build each index, and to answer the whole table of queries by each method, over copies of a corpus."""
    out = []
    for scale in scales:
        # copies are numbered after all chunks, so that ids stay numbers
        rows = chunks.select("text", "source_file", F.explode(F.sequence(F.lit(0), F.lit(scale - 1))).alias("copy"), "chunk_id")
        rows = rows.select((F.col("chunk_id") * scale + F.col("copy")).alias("chunk_id"), "text", "source_file")
        engine = Engine(spark, f"{folder.rstrip('/')}/scale-{scale}", config)
        version, steps = engine.build(rows)
        row = {"scale": scale, "chunks": rows.count()} | {f"build_{r['name']}": r["seconds"] for r in steps.collect()}
        for method in methods:
            began = time.perf_counter()
            engine.query(version, queries, method, use_pagerank=False).write.format("noop").mode("overwrite").save()
            row[f"query_{method}"] = time.perf_counter() - began
        out.append(row)
    return out


def worksheet(spark: SparkSession, rows: DataFrame, path: str) -> None:
    """A table for people to fill in (candidates to label, answers to judge), as Markdown in a text file."""
    write_text(spark, markdown([r.asDict(recursive=True) for r in rows.collect()]), path)


def report(results: dict[str, list[dict]]) -> str:
    """Markdown of all results, a section each."""
    return "\n".join(["# Experiments", "", *[markdown(rows, name) for name, rows in results.items()]])


def dump(spark: SparkSession, results: dict[str, list[dict]], folder: str) -> None:
    """results.json and report.md in a folder of any file system that Spark writes to."""
    write_text(spark, json.dumps(results, indent=1, default=str), f"{folder.rstrip('/')}/results.json")
    write_text(spark, report(results), f"{folder.rstrip('/')}/report.md")


def write_text(spark: SparkSession, text: str, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = place.getFileSystem(spark._jsc.hadoopConfiguration()).create(place, True)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()
