"""Inserts, patches and deletes, as new versions of the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def add_documents(batch: DataFrame, docs: DataFrame, tags: DataFrame, document_tags: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(docs, tags, document_tags) with a batch of documents (the columns of docs, and tags array<string>).

    Tags are made where their name is new. Documents whose id is stored already are left out, with their tags.
    """
    new = batch.join(docs.select("id"), "id", "left_anti").dropDuplicates(["id"])
    links = new.select(F.col("id").alias("document_id"), F.explode("tags").alias("tag")).where(F.col("tag").isNotNull()).distinct()
    names = links.select(F.col("tag").alias("name")).distinct().join(tags.select("name"), "name", "left_anti").withColumn("category", F.lit(None).cast("string"))
    return docs.unionByName(new.select(docs.columns)), tags.unionByName(names.select(tags.columns)), document_tags.unionByName(links)


def apply_patches(docs: DataFrame, document_tags: DataFrame, patches: DataFrame, at=None) -> tuple[DataFrame, DataFrame]:
    """(docs, document_tags) after patches (id, title, content, tags; metadata if docs has it), one at most for each id.

    Fields that are not null replace. A list of tags replaces the old one, an empty one clears it, null leaves it.
    updated_at becomes `at` (now) for patched documents.
    """
    fields = [c for c in ("title", "content", "metadata") if c in docs.columns and c in patches.columns]
    p = patches.select("id", *(F.col(c).alias(f"__{c}") for c in fields), F.lit(True).alias("__patched"))
    joined = docs.join(p, "id", "left")
    changed = {c: F.coalesce(f"__{c}", c) for c in fields}
    if "updated_at" in docs.columns:
        changed["updated_at"] = F.when(F.col("__patched"), F.current_timestamp() if at is None else at).otherwise(F.col("updated_at"))
    known = patches.where(F.col("tags").isNotNull()).join(docs.select("id"), "id", "left_semi")
    given = known.select(F.col("id").alias("document_id"), "tags")
    links = document_tags.join(given.select("document_id"), "document_id", "left_anti").select("document_id", "tag")
    return joined.withColumns(changed).select(docs.columns), links.unionByName(given.select("document_id", F.explode("tags").alias("tag")).distinct())


def delete_documents(ids: DataFrame, tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The tables (documents, chunks, document_tags, relations) without these documents (id) and all that hangs on them."""
    gone = ids.select("id").distinct()
    out = dict(tables)
    for name, keys in {"documents": ("id",), "chunks": ("document_id",), "document_tags": ("document_id",), "relations": ("source_id", "target_id")}.items():
        for key in keys if name in tables else ():
            out[name] = out[name].join(gone.select(F.col("id").alias(key)), key, "left_anti").select(tables[name].columns)
    return out


def delete_relations(keys: DataFrame, relations: DataFrame) -> DataFrame:
    """relations without those with these keys (source_id, target_id, relation_type)."""
    names = ["source_id", "target_id", "relation_type"]
    return relations.join(keys.select(*names).distinct(), names, "left_anti").select(relations.columns)
