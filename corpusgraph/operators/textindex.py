"""A stored inverted index with positions: built once, then asked by any number of query batches.

`postings` holds a row for each token of a document with its positions, `counts` the number of documents of each token; both are
Parquet tables cut by the hash of the token and sorted, so a batch of queries reads only the buckets and pages of its tokens, and
no text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from corpusgraph.functions.batches import slices
from corpusgraph.operators.search import asked_tokens, document_tokens, rank_by_frequency, rank_by_proximity
from corpusgraph.sources.files import new_folder
from corpusgraph.sources.lookup import BUCKETS, look_up, write_buckets


def postings_of(docs: DataFrame, tokenizer: str = "simple") -> DataFrame:
    """(token, document_id, tf, positions): positions from 0 in title and content, ascending; no row is shuffled."""
    own = document_tokens(docs, tokenizer)
    schema = T.StructType([T.StructField("token", T.StringType()), own.schema["document_id"], T.StructField("tf", T.IntegerType()), T.StructField("positions", T.ArrayType(T.IntegerType()))])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            ids, lists = b.column("document_id"), b.column("tokens")
            words = lists.flatten().dictionary_encode()
            if not len(words):
                continue
            sizes = np.diff(lists.offsets.to_numpy())
            doc, codes = np.repeat(np.arange(len(ids)), sizes), words.indices.to_numpy()
            at = np.arange(len(codes), dtype=np.int32) - np.repeat(np.cumsum(sizes) - sizes, sizes).astype(np.int32)
            key = doc * len(words.dictionary) + codes
            order = np.argsort(key, kind="stable")
            first = np.flatnonzero(np.diff(key[order], prepend=-1))
            ends = np.append(first, len(codes)).astype(np.int32)
            one = order[first]
            columns = [words.dictionary.take(pa.array(codes[one])), ids.take(pa.array(doc[one])), pa.array(np.diff(ends)), pa.ListArray.from_arrays(pa.array(ends), pa.array(at[order]))]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    return own.mapInArrow(run, schema)


class TextIndex:
    """An index in a folder. build makes it from docs (id, title, content); the searches have the results of fulltext_search and,
    with width, of its score by proximity."""

    def __init__(self, spark: SparkSession, folder: str, tokenizer: str = "simple", buckets: int = BUCKETS, id_type: T.DataType | None = None):
        self.spark, self.folder, self.tokenizer, self.buckets, self.id_type = spark, folder, tokenizer, buckets, id_type or T.StringType()

    @classmethod
    def build(cls, docs: DataFrame, folder: str | None = None, tokenizer: str = "simple", buckets: int = BUCKETS) -> TextIndex:
        index = cls(docs.sparkSession, folder or new_folder(docs.sparkSession, "index"), tokenizer, buckets, docs.schema["id"].dataType)
        write_buckets(postings_of(docs, tokenizer), f"{index.folder}/postings", "token", buckets)
        counts = index.read("postings").groupBy("token").agg(F.count("*").alias("n"))
        write_buckets(counts, f"{index.folder}/counts", "token", buckets)
        return index

    def read(self, name: str) -> DataFrame:
        more = [T.StructField("document_id", self.id_type), T.StructField("tf", T.IntegerType()), T.StructField("positions", T.ArrayType(T.IntegerType()))] if name == "postings" else [T.StructField("n", T.LongType())]
        return self.spark.read.schema(T.StructType([T.StructField("token", T.StringType()), *more, T.StructField("bucket", T.IntegerType())])).parquet(f"{self.folder}/{name}")

    def _found(self, queries: DataFrame, docs: DataFrame | None, columns: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
        asked = asked_tokens(queries, self.tokenizer)
        words = asked.select("token")
        postings = look_up(self.read("postings"), "token", words, self.buckets).select("document_id", "token", *columns)
        if docs is not None:
            postings = postings.join(docs.select(F.col("id").alias("document_id")).distinct(), "document_id", "left_semi")
        return postings, asked, look_up(self.read("counts"), "token", words, self.buckets).select("token", "n")

    def search(self, queries: DataFrame, k: int, docs: DataFrame | None = None) -> DataFrame:
        """(query_id, rank, document_id, score) of queries (query_id, query), among docs (id) if they are given."""
        return rank_by_frequency(*self._found(queries, docs, ["tf"]), k)

    def search_near(self, queries: DataFrame, k: int, docs: DataFrame | None = None) -> DataFrame:
        """(query_id, rank, document_id, score, width), ranked by frequency and by the smallest window of all tokens."""
        return rank_by_proximity(*self._found(queries, docs, ["tf", "positions"]), k)
