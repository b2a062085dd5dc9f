"""Reading directories of text and fact files, and writing facts and graphs.

Paths go to Spark's readers as they are, so any store that Spark reads will do.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from memloom import schema
from memloom.functions.gates import is_junk, is_sensitive
from memloom.functions.text import fact_hash, norm_fts
from memloom.schema import JSONL_FACT, TABLES
from memloom.shared import file_system, names, read_text, remove, replace_text

# What is not indexed, and the default patterns.
EXCLUDED = [".git", "node_modules", ".venv", "venv", "env", "__pycache__", ".tox", ".mypy_cache", ".pytest_cache", "build", "dist", ".next", "target", ".idea", ".vscode", ".eggs"]
MOST_BYTES = 500_000
PATTERNS = ["*.md", "*.py", "*.txt"]
PARTS = ("nodes", "edges", "communities")
#: The file that names a project's version.
CURRENT = "CURRENT"


def excluded(path: Column, size: Column | None = None) -> Column:
    """A part of the path is on the list, or the file is too large."""
    parts = F.split(path, "/")
    out = F.arrays_overlap(parts, F.array(*(F.lit(x) for x in EXCLUDED)))
    return out if size is None else out | (size > MOST_BYTES)


def load_directory(spark: SparkSession, path: str, patterns: list[str] | None = None, recursive: bool = True, parsers: dict[str, Callable[[Column], Column]] | None = None) -> DataFrame:
    """``source, text`` of the files that match; a missing path raises. ``parsers`` turn other formats' bytes (by suffix) into text."""
    reader = spark.read.option("recursiveFileLookup", str(recursive).lower()).option("pathGlobFilter", "{" + ",".join(patterns or PATTERNS) + "}")
    files = reader.format("binaryFile").load(path).filter(~excluded(F.col("path"), F.col("length")))
    text = F.decode("content", "UTF-8")
    for suffix, parse in (parsers or {}).items():
        text = F.when(F.lower("path").endswith(suffix), parse(F.col("content"))).otherwise(text)
    return files.select(F.col("path").alias("source"), text.alias("text"))


def load_file(spark: SparkSession, path: str, **how) -> DataFrame:
    """One file; an excluded or too large one raises."""
    name = path.split("://", 1)[-1]
    place, fs = file_system(spark, path)
    if any(part in EXCLUDED for part in name.split("/")) or (fs.exists(place) and fs.getFileStatus(place).getLen() > MOST_BYTES):
        raise ValueError(f"{path} is excluded")
    return load_directory(spark, path, patterns=["*"], **how)


def read_facts(spark: SparkSession, path: str, known: DataFrame | None = None) -> DataFrame:
    """Facts of JSON-lines files that are well formed, no junk and not in ``known`` (``fact_hash``). A missing category is the file's name."""
    rows = spark.read.schema(JSONL_FACT).option("mode", "DROPMALFORMED").json(path)
    rows = rows.withColumn("category", F.coalesce("category", F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(?:\.jsonl?)?$", 1)))
    rows = rows.filter((F.trim(F.coalesce("key", F.lit(""))) != "") & ~is_junk("key")).withColumn("fact_hash", fact_hash("key"))
    return rows if known is None else rows.join(known.select("fact_hash"), "fact_hash", "left_anti")


def all_keys(spark: SparkSession, path: str) -> DataFrame:
    """Every key of the files, junk or not: what orphans are held against."""
    return spark.read.schema(JSONL_FACT).option("mode", "DROPMALFORMED").json(path).select("key").filter("key <> ''").distinct()


def append_facts(facts: DataFrame, path: str) -> None:
    """One folder of JSON lines a category."""
    facts.write.mode("append").partitionBy("category").json(path)


def save_graph(path: str, project: str, nodes: DataFrame, edges: DataFrame, communities: DataFrame) -> None:
    """Nodes, edges and communities of a project; each save replaces that project alone, all three at once.

    A save writes a version of its own; one small file, put in place in one step, says
    which version holds. Nodes that were there before keep their ``created_at``. The
    version before stays for those who are reading it, older ones go.
    """
    spark, home = nodes.sparkSession, f"{path}/{project}"
    former = read_text(spark, f"{home}/{CURRENT}")
    if former and "created_at" in nodes.columns:
        old = spark.read.parquet(f"{home}/{former}/nodes").select(F.col("node").alias("old_node"), F.col("created_at").alias("old_time"))
        kept = nodes.alias("n").join(old, F.col("n.node") == F.col("old_node"), "left")
        nodes = kept.select(*(F.coalesce("old_time", "n.created_at").alias(c) if c == "created_at" else F.col(f"n.`{c}`") for c in nodes.columns))
    version = f"v-{uuid.uuid4().hex}"
    for name, df in zip(PARTS, (nodes, edges, communities), strict=True):
        df.write.parquet(f"{home}/{version}/{name}")
    replace_text(spark, f"{home}/{CURRENT}", version)
    for other in names(spark, home):
        if other.startswith("v-") and other not in (version, former):
            remove(spark, f"{home}/{other}")


def load_graph(spark: SparkSession, path: str, project: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What ``save_graph`` saved last; an unknown project raises."""
    version = read_text(spark, f"{path}/{project}/{CURRENT}")
    if version is None:
        raise FileNotFoundError(f"no project {project} in {path}")
    return tuple(spark.read.parquet(f"{path}/{project}/{version}/{name}") for name in PARTS)


def list_projects(spark: SparkSession, path: str) -> DataFrame:
    """``project`` of all that were saved whole, in order; hidden ones are left out."""
    found = [(p,) for p in names(spark, path) if not p.startswith(".") and CURRENT in names(spark, f"{path}/{p}")]
    return spark.createDataFrame(found, "project string")


def delete_project(spark: SparkSession, path: str, project: str) -> None:
    remove(spark, f"{path}/{project}")


def import_node_link(spark: SparkSession, path: str, repair: bool = False) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of a node-link JSON document. A missing one raises; one that can't be read too, or, to ``repair``, it is set aside and an empty graph comes back."""
    place, fs = file_system(spark, path)
    if not fs.exists(place):
        raise FileNotFoundError(path)
    doc = spark.read.option("multiLine", "true").json(path)
    links = "links" if "links" in doc.columns else "edges"
    if "nodes" not in doc.columns or links not in doc.columns:
        if not repair:
            raise ValueError(f"{path} is no node-link document")
        fs.rename(place, file_system(spark, f"{path}.bak-{uuid.uuid4().hex[:8]}")[0])
        return spark.createDataFrame([], "id string"), spark.createDataFrame([], "src string, dst string, weight double")
    nodes, edges = doc.select(F.explode("nodes").alias("n")).select("n.*"), doc.select(F.explode(links).alias("e")).select("e.*")
    ends = edges.select(F.least("source", "target").alias("src"), F.greatest("source", "target").alias("dst"), *(c for c in edges.columns if c not in ("source", "target")))
    return nodes, ends


def create_tables(spark: SparkSession, path: str) -> list[str]:
    """Empty tables of the store where there are none yet; those that are there stay. Returns the names of the new ones."""
    made = []
    for name in TABLES:
        place, fs = file_system(spark, f"{path}/{name.lower()}")
        if not fs.exists(place):
            spark.createDataFrame([], getattr(schema, name)).write.parquet(f"{path}/{name.lower()}")
            made.append(name.lower())
    return made


def insert(rows: DataFrame, path: str, table: str) -> None:
    """Append rows to a table of the store, in its columns; those that ``rows`` lacks are null, others are left out."""
    fields = rows.sparkSession.createDataFrame([], getattr(schema, table.upper())).schema.fields
    known = lambda f: F.col(f.name) if f.name in rows.columns else F.lit(None)
    rows.select(*(known(f).cast(f.dataType).alias(f.name) for f in fields)).write.mode("append").parquet(f"{path}/{table}")


def compact(spark: SparkSession, path: str, file_bytes: int = 256 << 20) -> int:
    """Rewrite a folder of many small files as few of about ``file_bytes``. The new folder takes the old one's place when it is whole. Returns the number of files."""
    place, fs = file_system(spark, path)
    parts = max(1, -(-fs.getContentSummary(place).getLength() // file_bytes))
    staged, aside = (f"{path}.{kind}-{uuid.uuid4().hex}" for kind in ("staged", "aside"))
    rows = spark.read.parquet(path)
    (rows.coalesce(parts) if parts < rows.rdd.getNumPartitions() else rows.repartition(parts)).write.parquet(staged)
    fs.rename(place, file_system(spark, aside)[0])
    fs.rename(file_system(spark, staged)[0], place)
    remove(spark, aside)
    return len([n for n in names(spark, path) if n.endswith(".parquet")])


def without_secrets(facts: DataFrame, nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Facts, nodes and edges after the names of secrets are gone, with the edges of what went."""
    gone = nodes.filter(is_sensitive("content")).select("node")
    off = lambda side: gone.select(F.col("node").alias(side))
    return facts.filter(~is_sensitive("key")), nodes.join(gone, "node", "left_anti"), edges.join(off("src"), "src", "left_anti").join(off("dst"), "dst", "left_anti")


def migrate_graph(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Facts and relations of a graph; junk, categories and sessions stay behind. Looking at the result first is the dry run."""
    facts = nodes.filter((F.col("type") == "fact") & ~is_junk("content")).select("node", F.col("content").alias("full_key"), "category", "importance", fact_hash("content").alias("fact_hash"))
    ends = lambda side: facts.select(F.col("node").alias(side))
    links = edges.filter("type <> 'belongs_to'").join(ends("src"), "src", "left_semi").join(ends("dst"), "dst", "left_semi")
    return facts, links.select(F.col("src").alias("from_node"), F.col("dst").alias("to_node"), F.col("type").alias("kind"), "weight")


def migrate_store(facts: DataFrame, relations: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows of the trust store, its entities and their bridge: importance becomes trust, aliases tags, and a relation kind an entity of its facts."""
    from memloom.functions.text import OLDER_ENTITIES, entities, trust_of

    rows = facts.select("id", F.col("full_key").alias("content"), norm_fts("full_key").alias("content_normalized"), "category", F.array_join("aliases", ",").alias("tags"), trust_of("importance").alias("trust_score"), "created_at")
    named = facts.select("id", F.explode(entities("full_key", OLDER_ENTITIES)).alias("e")).select("id", "e.name", "e.type")
    kinds = relations.select(F.explode(F.array("from_id", "to_id")).alias("id"), F.concat(F.lit("relation:"), "kind").alias("name"), F.lit("relation").alias("type"))
    links = named.unionByName(kinds).distinct()
    entity = links.select(F.xxhash64("name", "type").alias("entity_id"), "name", "type").distinct()
    return rows, entity, links.select(F.col("id").alias("fact_id"), F.xxhash64("name", "type").alias("entity_id"))
