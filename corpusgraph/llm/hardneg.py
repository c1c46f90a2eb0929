"""Hard-negative mining: k-means inverted lists with stored radii, searched by Cauchy-Schwarz bounds.

Every vector lies in the list of its nearest centroid; the radius of a list is the largest distance of one of its vectors.
For an anchor q, the score of any vector of a list lies within |q| * radius of q * centroid. A probe is an anchor with a
window of scores; it visits the lists whose interval meets the window, by descending upper bound, in rounds: a few lists
at first, then more, and at last all others. After each round the k-th best score found so far is known, and a list is visited
only if its bound is not strictly below that. So the result is exact, whatever the centroids are.

Positives are a search with an open window among rows of the anchor's label; each positive's score then sets a window of
its own among the rows of other labels. Lists are stored as blocks of bounded size; a visit is a product of a block with a
group of anchors of one list.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusgraph.llm.common import stored, table
from corpusgraph.llm.topk import quantised, usable

#: Rows for which there is a centroid; centroids at most (they are broadcast); rows for each centroid of the fit's sample.
ROWS_PER_CENTROID, MOST_CENTROIDS, FIT_ROWS_PER_CENTROID = 2048, 4096, 64
#: Rows of a block of a list, anchors of a group.
ROWS_PER_BLOCK, ANCHORS_PER_GROUP = 4096, 128
#: Lists that a probe has looked at by the end of each round; the last round takes all that are left.
VISITS = (4, 32)

_LEAST, _MOST = -(2**63), 2**63 - 1
RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
_BLOCK = "block int, ids binary, places binary, labels binary, data binary"
_GROUP = "a_places binary, a_labels binary, a_data binary, owners binary, nos binary, lows binary, highs binary, leasts binary"
_FOUND = "place long, no int, id long, score long"


@dataclass
class Lists:
    """The index: blocks (a stored table) and, small enough to broadcast, centroids, radii, first block of each list."""

    blocks: DataFrame
    assigned: DataFrame
    centers: np.ndarray
    radii: np.ndarray
    first: np.ndarray
    groups: DataFrame


def vector_rows(df: DataFrame, id_col: str, label_col: str, vector_col: str, scale: int = 256) -> DataFrame:
    """(id, place, label, v): quantised vectors; rows with a null id or label or an unusable vector take no part.

    place tells rows with one id apart. Stored, so that it stays the same.
    """
    kept = df.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & usable(F.col(vector_col)))
    return stored(kept.select(F.col(id_col).cast("long").alias("id"), F.monotonically_increasing_id().alias("place"), F.col(label_col).cast("long").alias("label"), quantised(F.col(vector_col), scale).alias("v")), "vectors")


def _matrix(vectors, dim: int) -> np.ndarray:
    """Vectors as rows, shorter ones followed by zeros."""
    out = np.zeros((len(vectors), dim), np.int64)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a . b of all rows, exact as long as they fit in 64 bits."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    if most < 2**53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    return a @ b.T


def _fitted(rows: DataFrame, n: int, dim: int, per_centroid: int) -> np.ndarray:
    """Centroids of a sample of bounded size, chosen by a hash of the place."""
    k = min(MOST_CENTROIDS, max(1, n // per_centroid))
    share = max(1, n // (k * FIT_ROWS_PER_CENTROID))
    padded = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.coalesce(F.get("v", i), F.lit(0)).cast("double"))
    sample = rows.where(F.pmod(F.xxhash64("place"), F.lit(share)) == 0).coalesce(8).select(array_to_vector(padded).alias("features"))
    if k == 1 or sample.isEmpty():
        return np.zeros((1, dim))
    return np.array(KMeans(k=k, maxIter=8, seed=13).fit(sample).clusterCenters())


def build_lists(rows: DataFrame, is_anchor, per_centroid: int = ROWS_PER_CENTROID, per_block: int = ROWS_PER_BLOCK) -> Lists | None:
    """The index of all rows (vector_rows); is_anchor is a condition on them. None where there are no rows."""
    n, dim = rows.agg(F.count("*"), F.max(F.size("v"))).first()
    if not n:
        return None
    dim = max(1, dim)
    spark = rows.sparkSession
    centers = _fitted(rows, n, dim, per_centroid)
    shared = spark.sparkContext.broadcast(centers)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = shared.value
        square = (c * c).sum(axis=1)
        for b in batches:
            x = _matrix(b["v"], dim)
            near = np.argmin(square - 2.0 * (x @ c.T), axis=1)
            yield b.assign(v=[r.tobytes() for r in x], cluster=near.astype(np.int32), distance=np.linalg.norm(x - c[near], axis=1))

    marked = rows.withColumn("anchor", is_anchor)
    assigned = stored(marked.mapInPandas(assign, "id long, place long, label long, v binary, anchor boolean, cluster int, distance double"), "assigned")
    # one row for each centroid
    sizes = {r["cluster"]: r for r in assigned.groupBy("cluster").agg(F.count("*").alias("n"), F.count_if("anchor").alias("anchors"), F.max("distance").alias("radius")).collect()}
    radii = np.array([sizes[c]["radius"] if c in sizes else -1.0 for c in range(len(centers))])
    parts = [-(-sizes[c]["n"] // per_block) if c in sizes else 0 for c in range(len(centers))]
    first = np.concatenate([[0], np.cumsum(parts)]).astype(np.int64)
    groups = spark.createDataFrame([(c, int(first[c]), parts[c], max(1, -(-r["anchors"] // ANCHORS_PER_GROUP))) for c, r in sizes.items()], "cluster int, base int, parts int, groups int")

    def pack(key: tuple, r: pd.DataFrame) -> pd.DataFrame:
        r = r.sort_values(["id", "place"])
        return pd.DataFrame({"block": [key[0]], **{c: [r[k].to_numpy(np.int64).tobytes()] for c, k in (("ids", "id"), ("places", "place"), ("labels", "label"))}, "data": [b"".join(r["v"])]})

    split = assigned.join(F.broadcast(groups), "cluster").withColumn("block", (F.col("base") + F.pmod(F.xxhash64("place"), F.col("parts"))).cast("int"))
    blocks = stored(split.select("block", "id", "place", "label", "v").groupBy("block").applyInPandas(pack, _BLOCK), "lists")
    return Lists(blocks, assigned, centers, radii, first, groups)


def _grouped(key: tuple, r: pd.DataFrame) -> pd.DataFrame:
    """The probes of one group of anchors as flat arrays."""
    r = r.sort_values(["place", "no"], ignore_index=True)
    places, at, owner = np.unique(r["place"].to_numpy(np.int64), return_index=True, return_inverse=True)
    flat = lambda c, kind=np.int64: [r[c].to_numpy(kind).tobytes()]
    return pd.DataFrame({"a_places": [places.tobytes()], "a_labels": [r["label"].to_numpy(np.int64)[at].tobytes()], "a_data": [b"".join(r["v"].iloc[at])], "owners": [owner.astype(np.int32).tobytes()], "nos": flat("no", np.int32), "lows": flat("low"), "highs": flat("high"), "leasts": flat("least")})


def wanted(q: np.ndarray, owner: np.ndarray, low: np.ndarray, high: np.ndarray, least: np.ndarray, centers: np.ndarray, radii: np.ndarray, begin: int, end: int) -> np.ndarray:
    """Which lists (columns) each probe (row) visits in a round: those at places begin to end of its order by upper bound that
    meet its window, with a bound that is not below its k-th score so far."""
    mid, length = q @ centers.T, np.linalg.norm(q, axis=1)[:, None]
    slack = 1e-9 * length * (np.linalg.norm(centers, axis=1) + np.maximum(radii, 0)) + 1e-6  # rounding
    mid, reach = mid[owner], (length * radii + slack)[owner]
    low, high, least = (x.astype(np.float64)[:, None] for x in (low, high, least))
    upper = np.minimum(mid + reach, high)
    place = np.argsort(np.lexsort((np.abs(mid - high), -upper), axis=-1), axis=-1)
    return (radii >= 0) & (mid + reach >= low) & (mid - reach <= high) & (upper >= least) & (place >= begin) & (place < end)


def _visits(shared, begin: int, end: int, dim: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        centers, radii, first = shared.value
        for b in batches:
            for g in b.itertuples(index=False):
                places, labels = np.frombuffer(g.a_places, np.int64), np.frombuffer(g.a_labels, np.int64)
                data, owner, no = np.frombuffer(g.a_data, np.int64).reshape(-1, dim), np.frombuffer(g.owners, np.int32), np.frombuffer(g.nos, np.int32)
                low, high, least = (np.frombuffer(x, np.int64) for x in (g.lows, g.highs, g.leasts))
                need, out = wanted(data.astype(np.float64), owner, low, high, least, centers, radii, begin, end), []
                for c in np.flatnonzero(need.any(axis=0)):
                    p = np.flatnonzero(need[:, c])
                    a, own = np.unique(owner[p], return_inverse=True)
                    row = (places[a].tobytes(), labels[a].tobytes(), data[a].tobytes(), own.astype(np.int32).tobytes(), no[p].tobytes(), low[p].tobytes(), high[p].tobytes(), least[p].tobytes())
                    for block in range(first[c], first[c + 1]):
                        out.append((block, *row))
                        if len(out) == 64:
                            yield pd.DataFrame(out, columns=["block", *g._fields])
                            out = []
                if out:
                    yield pd.DataFrame(out, columns=["block", *g._fields])

    return run


def _tiles(k: int, same: bool, dim: int):
    """The k best of a block for each probe: score within its window and not below its k-th so far, by score, then id."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for t in batch.itertuples(index=False):
                ids, places, labels = (np.frombuffer(x, np.int64) for x in (t.ids, t.places, t.labels))
                a_places, a_labels, low, high, least = (np.frombuffer(x, np.int64) for x in (t.a_places, t.a_labels, t.lows, t.highs, t.leasts))
                owner, no = np.frombuffer(t.owners, np.int32), np.frombuffer(t.nos, np.int32)
                scores = _products(np.frombuffer(t.a_data, np.int64).reshape(-1, dim), np.frombuffer(t.data, np.int64).reshape(-1, dim))
                low, out, probes = np.maximum(low, least), [], np.split(np.argsort(owner, kind="stable"), np.cumsum(np.bincount(owner))[:-1])
                for i, own in enumerate(probes):
                    s = scores[i]
                    fits = (labels == a_labels[i]) == same
                    fits &= (places != a_places[i]) & (s >= low[own].min()) & (s <= high[own].max())
                    rows = np.flatnonzero(fits)
                    rows = rows[np.argsort(-s[rows], kind="stable")]
                    down = -s[rows]
                    for p in own:
                        at = np.searchsorted(down, -high[p])
                        best = rows[at : at + k]
                        best = best[s[best] >= low[p]]
                        if len(best):
                            out.append((np.full(len(best), a_places[i]), np.full(len(best), no[p]), ids[best], s[best]))
                if out:
                    yield pd.DataFrame(dict(zip(("place", "no", "id", "score"), map(np.concatenate, zip(*out, strict=True)), strict=True)))

    return run


def search(lists: Lists, probes: DataFrame, k: int, same: bool, visits: tuple[int, ...] = VISITS) -> DataFrame:
    """(place, no, id, score, rank): the k best rows of each probe, stored.

    probes: place (of an anchor), no, low, high; rows of the anchor's label if same is set, else of the others, with a score
    from low to high; ties to the smaller id. Joins are by merge: a planner that takes binary columns for short, or goes by the
    compressed size of a shuffle, would collect blocks, groups or vectors of anchors in the driver.
    """
    spark, dim, n = lists.blocks.sparkSession, lists.centers.shape[1], len(lists.centers)
    shared = spark.sparkContext.broadcast((lists.centers, lists.radii, lists.first))
    anchors = lists.assigned.where("anchor").select("place", "label", "cluster", "v")
    anchors = anchors.join(F.broadcast(lists.groups.select("cluster", "groups")), "cluster").withColumn("group", F.pmod(F.xxhash64("place"), F.col("groups")))
    order = Window.partitionBy("place", "no").orderBy(F.desc("score"), "id")
    ends = [*(v for v in visits if v < n), n]
    best = None
    for begin, end in zip([0, *ends[:-1]], ends, strict=True):
        now = probes.withColumn("least", F.lit(_LEAST))
        if best is not None:
            kth = best.where(F.col("rank") == k).select("place", "no", F.col("score").alias("least"))
            now = probes.join(kth.hint("merge"), ["place", "no"], "left").withColumn("least", F.coalesce("least", F.lit(_LEAST)))
        groups = now.join(anchors.hint("merge"), "place").groupBy("cluster", "group").applyInPandas(_grouped, _GROUP)
        tiles = groups.mapInPandas(_visits(shared, begin, end, dim), f"block int, {_GROUP}").join(lists.blocks.hint("merge"), "block").drop("block")
        found = tiles.mapInPandas(_tiles(k, same, dim), _FOUND)
        if best is not None:
            found = found.unionByName(best.drop("rank"))
        best = stored(found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k), "best")
    return best


def hard_negatives(rows: DataFrame, is_anchor, n_positives: int = 5, n_negatives: int = 10, low: int = 30, high: int = 90, per_centroid: int = ROWS_PER_CENTROID, per_block: int = ROWS_PER_BLOCK, visits: tuple[int, ...] = VISITS) -> DataFrame:
    """For each anchor and each of its n_positives best rows of the same label (all, if fewer), the n_negatives best rows of
    other labels whose score is low to high hundredths of the positive's: RESULT.

    rows: vector_rows; is_anchor: a condition on them. Scores are integer inner products, ties go to the smaller id. Rows
    that repeat an id are anchors and candidates of their own, but none of itself. A positive score below zero has an
    empty window. Shorter vectors are followed by zeros. A hundred times a score must fit in a long. An empty table, no
    anchors and a single label give no rows.
    """
    lists = build_lists(rows, is_anchor, per_centroid, per_block)
    if lists is None:
        return rows.sparkSession.createDataFrame([], RESULT)
    anchors = lists.assigned.where("anchor").select("place", F.col("id").alias("anchor_id"))
    open_ = anchors.select("place", F.lit(0).alias("no"), F.lit(_LEAST).alias("low"), F.lit(_MOST).alias("high"))
    positives = search(lists, open_, n_positives, True, visits).select("place", F.col("rank").alias("no"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    window = positives.where("positive_score >= 0").select("place", "no", F.expr(f"({low} * positive_score + 99) div 100").alias("low"), F.expr(f"({high} * positive_score) div 100").alias("high"))
    negatives = search(lists, window, n_negatives, False, visits)
    out = negatives.select("place", "no", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score")).join(positives.hint("merge"), ["place", "no"]).join(anchors.hint("merge"), "place")
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every hundredth vector as anchor; a seventh of the labels are changed first."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = vector_rows(table(spark, sf_dir, "embeddings").withColumn("label", label), "vec_id", "label", "embedding", 256)
    return hard_negatives(rows, F.col("id") % 100 == 0)


OP13_SQL = """
with v as (
  select vec_id, row_number() over () as place, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * x::double)) as w from embeddings
  where vec_id is not null and label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
  select a.vec_id as anchor_id, a.place, a.label = c.label as same, c.vec_id, list_inner_product(a.w, c.w)::bigint as score
  from v a join v c on a.place <> c.place where a.vec_id % 100 = 0
), p as (
  select anchor_id, place, vec_id as positive_id, score as positive_score, row_number() over (partition by place order by score desc, vec_id) as n from s where same
), r as (
  select p.anchor_id, p.positive_id, p.n, row_number() over (partition by p.place, p.n order by s.score desc, s.vec_id) as rk, s.vec_id as negative_id, p.positive_score, s.score as negative_score
  from p join s on s.place = p.place and not s.same and 30 * p.positive_score <= 100 * s.score and 100 * s.score <= 90 * p.positive_score
  where p.n <= 5
)
select anchor_id, positive_id, rk::int as rank, negative_id, positive_score, negative_score from r where rk <= 10
"""
