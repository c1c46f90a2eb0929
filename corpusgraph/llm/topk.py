"""Exact top-k search by inner product: exhaustive term-at-a-time accumulation.

Every vector is a sparse row of (term, integer weight). Rows are hashed into blocks of bounded size; each pair of a
block of queries and a block of candidates is one tile. Within a tile, the postings of each term are scattered, weighted,
into dense score arrays; a partition selection keeps the k best of each query; the winners of all tiles are merged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusgraph.llm.common import blocks_of, cut, table

CANDIDATES_PER_BLOCK = 4096
QUERIES_PER_BLOCK = 128

_PACKED = "block int, ids binary, places binary, counts binary, terms binary, weights binary"


def quantised(vector: Column, scale: int) -> Column:
    """floor(scale * x) of every component, as long."""
    return F.transform(vector, lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("long"))


def usable(vector: Column) -> Column:
    """Not null and without null or non-finite components."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(True))


def sparse_rows(df: DataFrame, id_col: str, vector_col: str, scale: int = 256) -> DataFrame:
    """Rows (id, place, terms, weights) of the usable vectors: the non-zero quantised components.

    Rows with a null id take no part. place tells rows with one id apart; as it counts rows, it is the same only as long as
    the rows are computed once: store them before they are used twice.
    """
    v = F.col(vector_col)
    kept = df.where(F.col(id_col).isNotNull() & usable(v)).select(F.col(id_col).cast("long").alias("id"), F.monotonically_increasing_id().alias("place"), quantised(v, scale).alias("v"))
    entries = F.filter(F.transform("v", lambda x, i: F.struct(i.cast("int").alias("t"), x.alias("w"))), lambda e: e["w"] != 0)
    return kept.select("id", "place", entries.alias("e")).select("id", "place", F.col("e.t").alias("terms"), F.col("e.w").alias("weights"))


def _pack(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values(["id", "place"], ignore_index=True)
    counts = np.array([len(t) for t in rows["terms"]], np.int64)
    flat = lambda c, kind: np.concatenate([np.asarray(x, kind) for x in rows[c]] or [np.zeros(0, kind)]).astype(kind)
    return pd.DataFrame({"block": [key[0]], "ids": [rows["id"].to_numpy(np.int64).tobytes()], "places": [rows["place"].to_numpy(np.int64).tobytes()], "counts": [counts.tobytes()], "terms": [flat("terms", np.int32).tobytes()], "weights": [flat("weights", np.int64).tobytes()]})


def packed_blocks(rows: DataFrame, blocks: int) -> DataFrame:
    """One row for each block: its sparse rows, by ascending id, as flat arrays."""
    return rows.withColumn("block", F.pmod(F.xxhash64("id", "place"), F.lit(blocks)).cast("int")).groupBy("block").applyInPandas(_pack, _PACKED)


def _unpacked(ids: bytes, places: bytes, counts: bytes, terms: bytes, weights: bytes):
    counts = np.frombuffer(counts, np.int64)
    return np.frombuffer(ids, np.int64), np.frombuffer(places, np.int64), np.repeat(np.arange(len(counts)), counts), np.frombuffer(terms, np.int32), np.frombuffer(weights, np.int64)


def _by_term(rows: np.ndarray, terms: np.ndarray, weights: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Postings: term -> (rows, weights)."""
    order = np.argsort(terms, kind="stable")
    names, first = np.unique(terms[order], return_index=True)
    return {int(t): (r, w) for t, r, w in zip(names, np.split(rows[order], first[1:]), np.split(weights[order], first[1:]), strict=True)}


def score_tile(queries, candidates, k: int) -> tuple[np.ndarray, ...]:
    """(query id, query place, candidate id, score) of each query's k best of the tile.

    Both sides: (ids ascending, places, rows, terms, weights); a candidate with the query's place is the query itself.
    """
    (q_ids, q_places, *q), (c_ids, c_places, *c) = queries, candidates
    n_q, n_c = len(q_ids), len(c_ids)
    q_terms, c_terms = _by_term(*q), _by_term(*c)
    most = sum(float(np.abs(q_terms[t][1]).max()) * float(np.abs(w).max()) for t, (_, w) in c_terms.items() if t in q_terms)
    kind = np.int32 if most < 2**31 else np.int64
    scores = np.zeros((n_q, n_c), kind)
    product = np.empty_like(scores)
    for t, (q_rows, q_w) in q_terms.items():
        if t not in c_terms:
            continue
        c_rows, c_w = c_terms[t]
        if 2 * len(c_rows) > n_c and 2 * len(q_rows) > n_q:  # long postings: whole arrays are cheaper than scattered adds
            dense_q, dense_c = np.zeros((n_q, 1), kind), np.zeros(n_c, kind)
            dense_q[q_rows, 0], dense_c[c_rows] = q_w, c_w
            np.multiply(dense_q, dense_c, out=product)
            scores += product
        else:
            scores[np.ix_(q_rows, c_rows)] += np.outer(q_w, c_w).astype(kind)
    own = q_places[:, None] == c_places[None, :]
    take = min(k, n_c)
    if most * n_c < 2**61:  # score and order of ids in one number, so that a selection has no ties
        keys = scores.astype(np.int64) * n_c + (n_c - 1 - np.arange(n_c))
        keys[own] = np.iinfo(np.int64).min
        best = np.argpartition(keys, n_c - take, axis=1)[:, n_c - take :]
    else:
        best = np.stack([np.lexsort((c_ids, -scores[i].astype(np.int64), own[i]))[:take] for i in range(n_q)]) if n_q else np.zeros((0, take), np.int64)
    at = np.repeat(np.arange(n_q), take), best.ravel()
    keep = ~own[at]
    return q_ids[at[0]][keep], q_places[at[0]][keep], c_ids[at[1]][keep], scores[at][keep].astype(np.int64)


def _tiles(k: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                q, p, v, s = score_tile(_unpacked(r.q_ids, r.q_places, r.q_counts, r.q_terms, r.q_weights), _unpacked(r.ids, r.places, r.counts, r.terms, r.weights), k)
                if len(q):
                    yield pd.DataFrame({"query_id": q, "place": p, "vec_id": v, "score": s})

    return run


def exact_topk(queries: DataFrame, candidates: DataFrame, k: int = 5, n_queries: int | None = None, n_candidates: int | None = None) -> DataFrame:
    """The k candidates with the highest inner product for each query: (query_id, rank, vec_id, score).

    Both inputs are sparse rows (id, place, terms array<int>, weights array<long>); place is unique in each and the same for
    a row that is in both. Rows with one id are queries and candidates of their own. A row is no candidate of its own; a
    candidate without a common term scores 0 and counts; ties go to the smaller id; a query with fewer than k
    candidates gets them all. Empty inputs give no rows. Scores must fit in a long.
    n_queries and n_candidates (counted if not given) only decide the number of blocks.
    """
    n_q = blocks_of(queries.count() if n_queries is None else n_queries, QUERIES_PER_BLOCK)
    n_c = blocks_of(candidates.count() if n_candidates is None else n_candidates, CANDIDATES_PER_BLOCK)
    q = packed_blocks(queries, n_q)
    q = q.select(F.explode(F.sequence(F.lit(0), F.lit(n_c - 1))).alias("block"), *(F.col(c).alias(f"q_{c}") for c in ("ids", "places", "counts", "terms", "weights")))
    tiles = q.join(packed_blocks(candidates, n_c), "block")
    best = tiles.drop("block").mapInPandas(_tiles(k), "query_id long, place long, vec_id long, score long")
    order = Window.partitionBy("query_id", "place").orderBy(F.desc("score"), "vec_id")
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op1_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fiftieth vector against all vectors, 5 best each."""
    vectors = table(spark, sf_dir, "embeddings")
    rows = cut(sparse_rows(vectors, "vec_id", "embedding", 256))
    return exact_topk(rows.where(F.col("id") % 50 == 0), rows, 5)


OP1_SQL = """
with v as (
  select vec_id, row_number() over () as place, list_transform(embedding, lambda x: floor(256 * x::double)) as w from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
  select q.vec_id as query_id, q.place, c.vec_id as vec_id, list_inner_product(q.w, c.w)::bigint as score
  from v q join v c on q.place <> c.place where q.vec_id % 50 = 0
), r as (
  select *, row_number() over (partition by query_id, place order by score desc, vec_id) as rk from s
)
select query_id, rk::int as rank, vec_id, score from r where rk <= 5
"""
