"""Keeps a full-text index of a folder of documents up to date.

    python -m jobs.index_documents --input /data/documents.parquet --output /data/index

The folder (or one file) is read as a file stream that takes what is new since the last run and stops;
Spark's checkpoint below ``output`` remembers the files. A batch goes into the parts of the index that
its documents belong to (``memloom.operators.text_index``), by dynamic partition overwrite. The output
is ``postings`` and ``documents``, partitioned by ``part``; ``memloom.operators.fulltext`` searches it.

A batch that was cut off is repeated by the stream and writes the same parts again. Documents that
come again, with another text, replace what was there. Null ids are not indexed, and counted in the log.
"""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs import cli
from memloom.operators import text_index
from memloom.streaming.incremental import run_available

NAME = "index_documents"
log = logging.getLogger(NAME)


def file_stream(spark: SparkSession, path: str, files: int | None = None) -> DataFrame:
    """What comes into a folder of Parquet files; a single file is a folder of one."""
    path = path.rstrip("/")
    # As a pattern that matches the path alone, a file will do as well as a folder.
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    return (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(f"{path[:-1]}[{path[-1]}]")


def run(spark: SparkSession, settings: dict) -> dict:
    """Index the documents that are new. Returns what was read and written."""
    output, key = settings["output"].rstrip("/"), settings["id"]
    total = {"batches": 0, "rows": 0, "without_id": 0, "documents": 0, "postings": 0, "parts": 0}

    def step(batch: DataFrame, number: int) -> None:
        rows, none = batch.agg(F.count(F.lit(1)), F.count_if(F.col(key).isNull())).first()
        told = text_index.update(spark, output, batch, key, settings["texts"], span=settings["span"])
        log.info("batch %d: %d rows of %s, %d without an id; %d parts written, with %d documents and %d postings", number, rows, settings["input"], none, told["parts"], told["documents"], told["postings"])
        for k, v in {"batches": 1, "rows": rows, "without_id": none, **told}.items():
            total[k] += v

    stream = file_stream(spark, settings["input"], settings.get("files_per_batch"))
    run_available(stream.select(key, *settings["texts"]), step, f"{output}/checkpoint").awaitTermination()
    log.info("indexed into %s: %s", output, total)
    return total


if __name__ == "__main__":
    cli.main(NAME, run)
