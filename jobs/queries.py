"""The jobs as queries: each is run twice into a new folder, and its whole output read back."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs import cli, curate_facts, index_documents
from memloom import catalog
from memloom.operators import text_index
from memloom.registry import folder


def _twice(spark: SparkSession, sf_dir: str, job) -> str:
    """The output folder of a job over the documents after its second run, which finds nothing new."""
    output = folder(spark, job.NAME)
    for _ in range(2):
        job.run(spark, cli.config(f"{job.NAME}.json") | {"input": f"{sf_dir}/documents.parquet", "output": output})
    return output


def job1_index_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The postings of an index of all documents, and a row for each document without any."""
    output = _twice(spark, sf_dir, index_documents)
    postings = text_index.stored(spark, output, "postings", text_index.POSTINGS).select("doc_id", "token", "tf", "n_tokens", "part")
    empty = text_index.stored(spark, output, "documents", text_index.DOCUMENTS).filter("n_tokens = 0")
    return postings.unionByName(empty.select("doc_id", F.lit(None).cast("string").alias("token"), F.lit(0).cast("long").alias("tf"), "n_tokens", "part"))


def job2_curate_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All facts of the documents, and the ids and rules of what was rejected."""
    output = _twice(spark, sf_dir, curate_facts)
    facts = curate_facts.facts(spark, output).select("fact_hash", F.md5("full_key").alias("digest"), "category", "seen_count", "first_id", "last_id", F.lit(None).cast("string").alias("rule"))
    none = {c: F.lit(None).cast("string").alias(c) for c in ("fact_hash", "digest", "category")}
    gone = curate_facts.rejected(spark, output).select(*none.values(), F.lit(1).cast("long").alias("seen_count"), F.col("id").alias("first_id"), F.col("id").alias("last_id"), "rule")
    return facts.unionByName(gone)


_TOKENS = catalog._TOK.format("text")
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (job1_index_documents, job2_curate_facts)}
ORACLES = {
    "job1_index_documents": f"""WITH d AS (SELECT doc_id, {_TOKENS} AS t FROM documents),
p AS (SELECT doc_id, len(t)::INTEGER AS n_tokens, unnest(t) AS token FROM d)
SELECT doc_id, token, count(*) AS tf, n_tokens, doc_id // 100000 AS part FROM p GROUP BY doc_id, token, n_tokens
UNION ALL SELECT doc_id, NULL, 0, 0, doc_id // 100000 FROM d WHERE coalesce(len(t), 0) = 0""",
    "job2_curate_facts": f"""WITH rules AS ({catalog._junk_sql('documents')}), d AS (SELECT doc_id, text, lang, rule, {catalog._HASH} AS h FROM documents JOIN rules USING (doc_id))
SELECT h AS fact_hash, arg_min(md5(text), doc_id) AS digest, arg_min(lang, doc_id) AS category, count(*) AS seen_count, min(doc_id) AS first_id, max(doc_id) AS last_id, NULL::VARCHAR AS rule FROM d WHERE rule IS NULL GROUP BY h
UNION ALL SELECT NULL, NULL, NULL, 1, doc_id, doc_id, rule FROM d WHERE rule IS NOT NULL""",
}
