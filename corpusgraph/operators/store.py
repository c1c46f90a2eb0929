"""A corpus in tables cut into fixed buckets, so that a change rewrites the buckets it touches and no others.

documents, chunks and document_tags are cut by the hash of the document; document_relations by that of the source, and once more,
as relations_by_target, by that of the target, so that the edges at either end of a document are in one known bucket.

A change reads the touched buckets, stores their new rows in a folder of its own, and puts these in place by dynamic partition
overwrite; a bucket that is left without rows gets an empty file. Every change can be repeated: one that was cut short
is made whole by making it again.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusgraph.operators import maintain
from corpusgraph.sources.files import read_if_there, stored
from corpusgraph.sources.lookup import bucket_of

#: The column by whose hash each table is cut.
KEYS = {"documents": "id", "chunks": "document_id", "document_tags": "document_id", "document_relations": "source_id", "relations_by_target": "target_id"}
EDGE = ["source_id", "target_id", "relation_type"]


class CorpusStore:
    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.path, self.buckets = spark, path, buckets

    def create(self, tables: dict[str, DataFrame]) -> None:
        """Writes documents and, where they are given, the other tables."""
        for name, df in tables.items():
            self._begin(name, df)
        if "document_relations" in tables:
            self._begin("relations_by_target", tables["document_relations"])

    def read(self, name: str, buckets: Iterable[int] | None = None) -> DataFrame | None:
        """A table, or only some of its buckets; None where there is none."""
        df = read_if_there(self.spark, f"{self.path}/{name}")
        if df is None:
            return None
        return (df if buckets is None else df.where(F.col("bucket").isin(*buckets))).drop("bucket")

    def _begin(self, name: str, rows: DataFrame) -> None:
        """A new table; one without rows is there as well."""
        self._clear(name, 0, rows)
        self._put(name, rows)

    def _clear(self, name: str, bucket: int, rows: DataFrame) -> None:
        rows.where("1 = 0").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/{name}/bucket={bucket}")

    def _put(self, name: str, rows: DataFrame) -> None:
        cut = rows.withColumn("bucket", bucket_of(KEYS[name], self.buckets)).hint("rebalance", "bucket")
        cut.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{self.path}/{name}")

    def _buckets(self, name: str, ids: DataFrame) -> list[int]:
        """The buckets of a table that these keys (one column) are in: numbers, as many as there are buckets at most."""
        return sorted(r[0] for r in ids.select(bucket_of(F.col(ids.columns[0]), self.buckets)).distinct().collect())

    def _replace(self, name: str, touched: list[int], rows: DataFrame) -> None:
        """rows become all there is in the touched buckets."""
        rows = stored(rows, "changed")
        self._put(name, rows)
        left = set(self._buckets(name, rows.select(KEYS[name])))
        for b in touched:
            if b not in left:
                self._clear(name, b, rows)

    def _exchange(self, name: str, ids: DataFrame, new: DataFrame | None) -> None:
        """The rows of a table with these keys (one column) are replaced by new ones."""
        touched = self._buckets(name, ids)
        old = self.read(name, touched)
        if old is None:
            if new is not None:
                self._begin(name, new)
            return
        rows = old.join(ids.toDF(KEYS[name]), KEYS[name], "left_anti").select(old.columns)
        self._replace(name, touched, rows if new is None else rows.unionByName(new.select(old.columns)))

    def _change_edges(self, removed: DataFrame, added: DataFrame | None = None) -> None:
        """removed: keys of edges; added: whole edges, which replace those with their key."""
        keys = removed.select(*EDGE) if added is None else removed.select(*EDGE).unionByName(added.select(*EDGE))
        keys = stored(keys.distinct(), "edge-keys")
        for name in ("document_relations", "relations_by_target"):
            touched = self._buckets(name, keys.select(KEYS[name]))
            old = self.read(name, touched)
            if old is None:
                if added is not None:
                    self._begin(name, added)
                continue
            rows = old.join(keys, EDGE, "left_anti").select(old.columns)
            self._replace(name, touched, rows if added is None else rows.unionByName(added.select(old.columns)))

    def _edges_of(self, ids: DataFrame, ends: tuple[str, ...]) -> DataFrame:
        """Keys of the edges that have one of these documents (id) at an end."""
        found = self.spark.createDataFrame([], "source_id string, target_id string, relation_type string")
        for name in ends:
            rows = self.read(name, self._buckets(name, ids))
            if rows is not None:
                found = found.unionByName(rows.join(ids.toDF(KEYS[name]), KEYS[name], "left_semi").select(*EDGE))
        return stored(found.distinct(), "edges")

    def upsert(self, tables: dict[str, DataFrame]) -> None:
        """New versions of documents (id and the stored columns), with their chunks, document_tags and document_relations: what
        these documents had before goes, and so do the edges that start at them; edges of others to them stay, and so does the
        time at which a document was created (created_at, if it is stored)."""
        ids = stored(tables["documents"].select("id").distinct(), "ids")
        old = self.read("documents", self._buckets("documents", ids))
        if old is not None and "created_at" in old.columns:
            first = stored(old.join(ids, "id", "left_semi").select("id", F.col("created_at").alias("__first")), "first-times")
            new = tables["documents"].join(first, "id", "left").withColumn("created_at", F.coalesce("__first", "created_at"))
            tables = tables | {"documents": new.select(old.columns)}
        self._change_edges(self._edges_of(ids, ("document_relations",)), tables.get("document_relations"))
        for name in ("chunks", "document_tags", "documents"):
            if name in tables or name != "documents":
                self._exchange(name, ids, tables.get(name))

    def patch(self, patches: DataFrame, at=None) -> None:
        """maintain.apply_patches (id, title, content, tags, metadata) on the buckets of the patched documents."""
        patches = stored(patches, "patches")
        docs, links = (self._buckets(n, patches.select("id")) for n in ("documents", "document_tags"))
        known = self.read("document_tags", links)
        given = known if known is not None else self.spark.createDataFrame([], "document_id string, tag string")
        new, tagged = maintain.apply_patches(self.read("documents", docs), given, patches, at)
        tagged = stored(tagged, "tags")
        self._replace("documents", docs, new)
        self._replace("document_tags", links, tagged)

    def delete(self, ids: DataFrame) -> None:
        """Documents (id) go with their chunks, tags, and the edges at either end of them."""
        ids = stored(ids.select("id").distinct(), "ids")
        self._change_edges(self._edges_of(ids, ("document_relations", "relations_by_target")))
        for name in ("chunks", "document_tags", "documents"):
            self._exchange(name, ids, None)

    def delete_relations(self, keys: DataFrame) -> None:
        """The edges with these keys go."""
        self._change_edges(keys)
