"""Uniform shuffle into shards of exact size by a hypergeometric communication matrix.

The number of rows that each source partition sends to each shard is drawn from the multivariate hypergeometric law,
which is the law of those counts under a uniform permutation of all rows. Every partition permutes its rows, sends that
many to each shard, and each shard permutes what it got. Only DataFrame functions touch rows; the driver sees one count
for each partition.
"""

from __future__ import annotations

import math
import random

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusgraph.llm.common import cut, table, uniform_key

ROWS_PER_SLOT_RANGE = 1 << 17


def hypergeometric(rng: random.Random, good: int, bad: int, draws: int) -> int:
    """How many of `draws` items taken without return from good + bad are good: inversion outwards from the mode."""
    low, high = max(0, draws - bad), min(draws, good)
    if low == high:
        return low
    mode = min(high, max(low, (draws + 1) * (good + 1) // (good + bad + 2)))

    def log_choose(n: int, k: int) -> float:
        return math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)

    up = lambda k: (good - k) * (draws - k) / ((k + 1) * (bad - draws + k + 1))  # noqa: E731  p(k + 1) / p(k)
    left = right = mode
    p_left = p_right = math.exp(log_choose(good, mode) + log_choose(bad, draws - mode) - log_choose(good + bad, draws))
    u = rng.random() - p_left
    while u > 0 and (left > low or right < high):
        if right < high:
            p_right *= up(right)
            right += 1
            u -= p_right
            if u <= 0:
                return right
        if left > low:
            left -= 1
            p_left /= up(left)
            u -= p_left
            if u <= 0:
                return left
        if p_left == p_right == 0.0:
            break
    return mode


def communication_matrix(partition_rows: list[int], shard_rows: list[int], seed: int) -> list[list[int]]:
    """Rows each partition sends to each shard; row sums and column sums are the arguments exactly."""
    rng, left, matrix = random.Random(seed), list(shard_rows), []
    for n in partition_rows:
        sent, rest = [], sum(left)
        for s, room in enumerate(left):
            rest -= room
            x = hypergeometric(rng, room, rest, n)
            sent.append(x)
            left[s] -= x
            n -= x
        matrix.append(sent)
    return matrix


def shuffled_shards(df: DataFrame, n_shards: int, seed: int = 0) -> DataFrame:
    """df with `shard` (0 to n_shards - 1) and `slot` (gapless from 0 within a shard): a uniform shuffle of all rows.

    Shard sizes differ by one row at most (law `rows`). Repeated rows, nulls and ties in any column have no influence:
    each row is identified by its place in the input. Existing columns named shard or slot are replaced. With fewer rows
    than shards some shards stay empty; an empty input gives no rows. The rows are written once to the shared folder,
    so that a lost executor can't change the places that have been dealt.
    """
    names = [c for c in df.columns if c not in ("shard", "slot")]
    placed = cut(df.select(F.struct(*names).alias("row"), F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("place")))
    sizes = sorted((r["part"], r["count"]) for r in placed.groupBy("part").count().collect())
    total = sum(n for _, n in sizes)
    shard_rows = [total // n_shards + (s < total % n_shards) for s in range(n_shards)]
    matrix = communication_matrix([n for _, n in sizes], shard_rows, seed)

    def upto(row: list[int]) -> list[int]:
        sums = [0]
        for x in row:
            sums.append(sums[-1] + x)
        return sums[1:]

    spark = df.sparkSession
    dealt = spark.createDataFrame([(p, upto(row)) for (p, _), row in zip(sizes, matrix, strict=True)], "part int, upto array<long>")
    # the first permutation: each partition sorts its own rows by a hash and numbers them, so none of them moves
    local = placed.withColumn("key", uniform_key("place", seed=seed)).sortWithinPartitions("key", "place")
    sent = local.withColumn("nth", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) + 1)
    sent = sent.join(F.broadcast(dealt), "part")  # a number for each partition and shard
    sent = sent.withColumn("shard", F.size(F.filter("upto", lambda x: x < F.col("nth"))))
    # the second permutation: a random order within each shard, cut into ranges that fit one task
    order = uniform_key("place", seed=seed + 1)
    ranges = max(1, -(-total // (n_shards * ROWS_PER_SLOT_RANGE)))
    sent = sent.select("row", "place", "shard", order.alias("key")).withColumn("range", F.floor(F.shiftrightunsigned("key", 33) * F.lit(ranges) / F.lit(1 << 31)).cast("int"))
    by_shard = Window.partitionBy("shard").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    before = sent.groupBy("shard", "range").count().select("shard", "range", F.coalesce(F.sum("count").over(by_shard), F.lit(0)).alias("before"))
    nth = F.row_number().over(Window.partitionBy("shard", "range").orderBy("key", "place"))
    out = sent.withColumn("nth", nth).join(before, ["shard", "range"]).withColumn("slot", F.col("before") + F.col("nth") - 1)
    return out.select(*(F.col("row")[c].alias(c) for c in names), F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents into 8 shards; a null text has no bytes."""
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    out = shuffled_shards(docs, 8, seed=4)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
