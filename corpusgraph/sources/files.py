"""Files in, corpus tables in and out."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from corpusgraph import schemas
from corpusgraph.functions.text import extension

TABLES = ("documents", "chunks", "document_relations", "tags", "document_tags")


def new_folder(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share: below spark.checkpoint.dir, or a local one where that is unset and all
    tasks run in the driver (tests)."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="corpusgraph-"))
    return f"{sc.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as a Parquet table in a new shared folder and read again: computed once, and safe from lost executors."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def with_names(files: DataFrame, base: str) -> DataFrame:
    """binaryFile rows as documents: document_id, title (path below base), filename, tags (its folders), content.

    Bytes that are no UTF-8 become U+FFFD. The id is a hash of the path, the same on every run.
    """
    root = base.rstrip("/") + "/"
    below = F.when(F.instr("path", root) > 0, F.substring_index("path", root, -1)).otherwise(F.col("path"))
    parts = F.split(below, "/")
    return files.select(
        F.sha2("path", 256).alias("document_id"),
        below.alias("title"),
        F.element_at(parts, -1).alias("filename"),
        F.filter(F.slice(parts, F.lit(1), F.size(parts) - 1), lambda p: p != "").alias("tags"),
        F.call_function("make_valid_utf8", F.col("content").cast("string")).alias("content"),
        "length",
        F.col("modificationTime").alias("updated_at"),
    )


def scan_files(spark: SparkSession, path: str, max_bytes: int = 100 * 2**20) -> DataFrame:
    """All files of known kinds below a folder, at most max_bytes long; sizes are checked before bytes are read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    known = extension(F.element_at(F.split("path", "/"), -1)).isin(*schemas.SCANNED)
    return with_names(files.where(known & (F.col("length") <= max_bytes)), path)


def write_corpus(tables: dict[str, DataFrame], path: str) -> None:
    """Parquet tables: documents by doc_type, chunks with those of a document together and in order."""
    for name, df in tables.items():
        if name == "documents" and "doc_type" in df.columns:
            df.write.mode("overwrite").partitionBy("doc_type").parquet(f"{path}/{name}")
        elif name == "chunks":
            df.repartition("document_id").sortWithinPartitions("document_id", "chunk_index").write.mode("overwrite").parquet(f"{path}/{name}")
        else:
            df.write.mode("overwrite").parquet(f"{path}/{name}")


#: The column by which each table is bucketed, and the order within a bucket.
BUCKETED = {"documents": ["id"], "chunks": ["document_id", "chunk_index"], "document_relations": ["source_id", "target_id"], "document_tags": ["document_id", "tag"], "call_edges": ["document_id", "pos"]}


def write_bucketed(tables: dict[str, DataFrame], path: str, prefix: str, buckets: int = 64) -> None:
    """Tables `prefix_name` of the catalog, stored below path in buckets by document and sorted within them.

    Joins and aggregations by document then need no exchange: vectors of documents, chunks of documents, reports. `buckets` is
    best a multiple of the cores, the same for all tables.
    """
    for name, df in tables.items():
        key, *rest = BUCKETED[name]
        # a task writes a file for each bucket it has rows of, so rows are dealt to tasks by bucket first
        df.repartition(buckets, key).write.mode("overwrite").option("path", f"{path}/{name}").bucketBy(buckets, key).sortBy(key, *rest).saveAsTable(f"{prefix}_{name}")


def open_bucketed(spark: SparkSession, path: str, prefix: str, names: Iterable[str], buckets: int = 64) -> dict[str, DataFrame]:
    """Tables of write_bucketed, which are made known to the catalog of this session if they aren't."""
    out = {}
    for name in names:
        if not spark.catalog.tableExists(f"{prefix}_{name}"):
            columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spark.read.parquet(f"{path}/{name}").schema)
            key, *rest = BUCKETED[name]
            spark.sql(f"create table `{prefix}_{name}` ({columns}) using parquet clustered by (`{key}`) sorted by ({', '.join(f'`{c}`' for c in (key, *rest))}) into {buckets} buckets location '{path}/{name}'")
        out[name] = spark.table(f"{prefix}_{name}")
    return out


def read_corpus(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables that are there."""
    found = {name: read_if_there(spark, f"{path}/{name}") for name in TABLES}
    return {name: df for name, df in found.items() if df is not None}


def read_if_there(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame | None:
    """A Parquet table, or None where nothing has been written; any other fault is raised."""
    try:
        return (spark.read if schema is None else spark.read.schema(schema)).parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return None
