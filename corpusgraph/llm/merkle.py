"""Merkle manifest of a dataset: superblock reduction.

The rows of a group, in order, are the leaves of a tree of a fixed fanout. Leaves are numbered within their group, and
fanout^LEVELS consecutive ones are a superblock: one task collapses LEVELS levels of it to its root. The roots are numbered
by superblock and reduced in the same way until each group has one subroot; the subroots, by group, are the leaves of a
last tree. A proof is the joined proofs of the superblocks above a leaf: on the way down each superblock gets the upper
proof of its root and puts the lower proof of each of its nodes before it.

Tasks hold one superblock at a time, whatever the size of a group. Only hashes are sorted and sent, never the rows' values.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusgraph.llm.common import stored, table

FANOUT = 8
#: Levels that one superblock holds: FANOUT ** LEVELS nodes.
LEVELS = 3

#: By level from the leaf up: the place of the node in its run, and the run's other nodes from left to right.
PROOF = "array<struct<place:int,others:array<string>>>"


def record_hash(*columns: Column) -> Column:
    """Lower-case hex sha256 of the values joined, each as UTF-8 byte count, `:` and the value, or `-` if null."""
    shown = [c.cast("string") for c in columns]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-")) for s in shown)), 256)


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its proof lead to."""

    def up(node: Column, level: Column) -> Column:
        left = F.slice(level["others"], F.lit(1), level["place"])
        right = F.slice(level["others"], level["place"] + 1, F.size(level["others"]))
        return F.sha2(F.concat(F.array_join(left, ""), node, F.array_join(right, "")), 256)

    return F.aggregate(proof, leaf, up)


def proof_hash(proof: Column) -> Column:
    """sha256 of all nodes of a proof, level by level, from left to right."""
    return F.sha2(F.array_join(F.flatten(F.transform(proof, lambda level: level["others"])), ""), 256)


def numbered(rows: DataFrame, group: str, *order: str) -> DataFrame:
    """rows with `idx`, gapless from 0 within a group by order; nulls come first, equal rows in any order.

    Rows are sorted by range, so that a large group is in many partitions; each partition numbers its own runs, and only the
    first run of a partition can continue one from before it. What is carried on is one number for each partition.
    """
    kind = T.StructType([*rows.schema.fields, *T._parse_datatype_string("part int, nth long, head boolean").fields])
    names = rows.columns

    def count(batches):
        last, n, run = None, 0, 0
        for b in batches:
            if not len(b):
                continue
            keys = b[group].to_numpy()
            new = [x != y for x, y in zip(keys, [last, *keys[:-1]], strict=True)]
            nth, head = [], []
            for x in new:
                if x:
                    n, run = 0, run + 1
                nth.append(n)
                head.append(run == 1)
                n += 1
            last = keys[-1]
            yield b.assign(nth=nth, head=head)

    by_range = rows.repartitionByRange(group, *order).sortWithinPartitions(group, *order).withColumn("part", F.spark_partition_id())
    placed = stored(by_range.mapInPandas(count, kind), "numbered")
    runs = placed.groupBy("part", group, "head").agg(F.count("*").alias("n")).withColumn("h", F.sha2(F.col(group), 256))
    ends = runs.groupBy("part").agg(F.min_by(F.struct("h", "n"), group).alias("first"), F.max_by(F.struct("h", "n"), group).alias("last"))
    carried, held, total = [], None, 0
    for r in sorted(ends.collect()):  # one row for each partition
        carry = total if r["first"]["h"] == held else 0
        carried.append((r["part"], carry))
        held, total = r["last"]["h"], r["last"]["n"] + (carry if r["last"]["h"] == r["first"]["h"] else 0)
    carries = rows.sparkSession.createDataFrame(carried, "part int, carry long")
    return placed.join(F.broadcast(carries), "part").withColumn("idx", F.col("nth") + F.when(F.col("head"), F.col("carry")).otherwise(0)).select(*names, "idx")


def _levels(nodes: list[str], fanout: int, levels: int | None) -> list[list[str]]:
    """The nodes and each level above them: so many levels, or up to a single node."""
    out = [nodes]
    while len(out[-1]) > 1 if levels is None else len(out) <= levels:
        row = out[-1]
        out.append([hashlib.sha256("".join(row[i : i + fanout]).encode()).hexdigest() for i in range(0, len(row), fanout)])
    return out


def _collapsed(bucket: int, nodes: list[str], fanout: int, levels: int) -> list[list[str]]:
    """All levels of one superblock; one that isn't full and has none before it is the whole tree, which ends at its root."""
    whole = bucket == 0 and len(nodes) < fanout**levels
    return _levels(nodes, fanout, None if whole else levels)


def _proof(tree: list[list[str]], i: int, fanout: int) -> list[dict]:
    out = []
    for row in tree[:-1]:
        first = i - i % fanout
        run = row[first : first + fanout]
        out.append({"place": i - first, "others": run[: i - first] + run[i - first + 1 :]})
        i //= fanout
    return out


def reduced(leaves: DataFrame, fanout: int = FANOUT, levels: int = LEVELS) -> list[DataFrame]:
    """Tables (group, idx, node) from the leaves' superblocks up to the one node of each group.

    leaves: group, idx, node.
    """
    tables, span = [leaves], fanout**levels

    def collapse(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        nodes = rows.sort_values("idx")["node"].tolist()
        return pd.DataFrame({"group": [key[0]], "idx": [key[1]], "node": _collapsed(key[1], nodes, fanout, levels)[-1]})

    while True:
        below = tables[-1].select("group", "node", "idx", F.floor(F.col("idx") / span).alias("bucket"))
        tables.append(stored(below.groupBy("group", "bucket").applyInPandas(collapse, "group string, idx long, node string"), "nodes"))
        if not (tables[-1].agg(F.max("idx")).first()[0] or 0):
            return tables


def proven(tables: list[DataFrame], tops: DataFrame, fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """The rows of tables[0] with `subroot` and `proof`, from the tables of reduced and tops (group, subroot, proof): the proof
    of each group's subroot."""
    span = fanout**levels
    above = tops.select("group", F.lit(0).cast("long").alias("bucket"), "subroot", "proof")
    for below in reversed(tables[:-1]):
        more = T.StructType([*below.schema.fields, T.StructField("subroot", T.StringType()), *T._parse_datatype_string(f"proof {PROOF}").fields])

        def join(key: tuple, rows: pd.DataFrame, upper: pd.DataFrame) -> pd.DataFrame:
            rows = rows.drop(columns="bucket").sort_values("idx", ignore_index=True)
            tree = _collapsed(key[1], rows["node"].tolist(), fanout, levels)
            rest = [{"place": int(x["place"]), "others": list(x["others"])} for x in upper["proof"].iat[0]]
            return rows.assign(subroot=upper["subroot"].iat[0], proof=[_proof(tree, i, fanout) + rest for i in range(len(rows))])

        cut = below.withColumn("bucket", F.floor(F.col("idx") / span))
        proofs = cut.groupBy("group", "bucket").cogroup(above.groupBy("group", "bucket")).applyInPandas(join, more)
        above = proofs.select("group", F.col("idx").alias("bucket"), "subroot", "proof")
    return proofs


def manifest(rows: DataFrame, fanout: int = FANOUT, levels: int = LEVELS) -> tuple[DataFrame, DataFrame]:
    """(leaves, root): a Merkle tree over the rows of each group, and one over the groups.

    rows: group (string, null allowed), leaf (lower-case hex), id to sort by, and any other columns but `bucket`, `idx`,
    `node`, `proof`, `subroot`. leaves are the rows with idx (place within the group), subroot and proof (PROOF); root is one
    row (root). Groups go by UTF-8 bytes, null first; leaves by id, null first, then by leaf; equal ones are told apart at
    random, which changes no hash of the tree. A group of one row has its leaf as subroot, and one group its subroot as root.
    An empty table has no leaves and no root.
    """
    # a group's name as text that is never null and sorts alike
    named = rows.withColumns({"group": F.coalesce(F.concat(F.lit("="), "group"), F.lit("")), "__row": F.monotonically_increasing_id()})
    leaves = numbered(stored(named, "leaves"), "group", "id", "leaf", "__row").drop("__row").withColumnRenamed("leaf", "node")
    tables = reduced(leaves, fanout, levels)
    subroots = tables[-1].select(F.lit("").alias("group"), F.col("group").alias("name"), "node")
    above = reduced(numbered(subroots, "group", "name"), fanout, levels)
    root = above[-1].select(F.col("node").alias("root"))
    tops = proven(above, above[-1].select("group", F.col("node").alias("subroot"), F.array().cast(PROOF).alias("proof")), fanout, levels)
    tops = tops.select(F.col("name").alias("group"), F.col("node").alias("subroot"), "proof")
    out = proven(tables, stored(tops, "subroots"), fanout, levels).withColumnRenamed("node", "leaf")
    return out.withColumn("group", F.when(F.col("group") != "", F.substr("group", F.lit(2)))), root


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as leaves, by lang; a third of them are then tampered with, and each is held against its proof."""
    upper = "".join(map(chr, range(65, 91)))
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    text, tampered = F.col("text"), F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    leaf, other = record_hash(*fields, text), record_hash(*fields, F.translate(text, upper, upper.lower()))
    rows = table(spark, sf_dir, "documents").select(F.col("lang").alias("group"), F.col("doc_id").alias("id"), leaf.alias("leaf"), F.when(tampered, other).otherwise(leaf).alias("claimed"))
    leaves, root = manifest(rows)
    top = root.first()
    out = leaves.select(F.col("id").alias("doc_id"), "leaf", "subroot", F.lit(top["root"] if top else None).cast("string").alias("root"), proof_hash(F.col("proof")).alias("proof_sha256"), folded(F.col("claimed"), F.col("proof")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


#: crc32 bit by bit, as the engine has no function for it.
_CRC = "list_reduce([4294967295::bigint] || list_transform(string_split(doc_id::varchar, ''), lambda c: ascii(c)::bigint), lambda acc, b: list_reduce([xor(acc, b)] || [0, 0, 0, 0, 0, 0, 0, 0]::bigint[], lambda x, i: xor(x >> 1, (x & 1) * 3988292384)))"

OP12_SQL = f"""
with recursive raw as (
  select doc_id, lang, coalesce(strlen(doc_id::varchar) || ':' || doc_id::varchar, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::varchar) || ':' || n_chars::varchar, '-') as head, text, row_number() over () as r
  from documents
), l as (
  select r, doc_id, lang, sha256(head || coalesce(strlen(text) || ':' || text, '-')) as leaf,
    case when xor({_CRC}, 4294967295) % 3 = 0 then sha256(head || coalesce(strlen(text) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-')) else sha256(head || coalesce(strlen(text) || ':' || text, '-')) end as claimed
  from raw
), placed as (
  select *, row_number() over (partition by lang order by doc_id nulls first, leaf, r) - 1 as idx from l
), nodes as (
  select coalesce('=' || lang, '') as grp, 0 as level, idx, leaf as node, count(*) over (partition by lang) as n from placed
  union all
  select grp, level + 1, idx // 8, sha256(string_agg(node, '' order by idx)), (any_value(n) + 7) // 8 from nodes where n > 1 group by grp, level, idx // 8
), subs as (
  select grp, node as subroot, level as depth, row_number() over (order by grp) - 1 as idx, count(*) over () as n from nodes where n = 1
), tops as (
  select 0 as level, idx, subroot as node, n from subs
  union all
  select level + 1, idx // 8, sha256(string_agg(node, '' order by idx)), (any_value(n) + 7) // 8 from tops where n > 1 group by level, idx // 8
), sides as (
  select p.r, a.level, coalesce(string_agg(s.node, '' order by s.idx) filter (where s.idx < (p.idx // (8 ** a.level)::bigint)), '') as lft, coalesce(string_agg(s.node, '' order by s.idx) filter (where s.idx > (p.idx // (8 ** a.level)::bigint)), '') as rgt
  from placed p join (select distinct grp, level from nodes where n > 1) a on a.grp = coalesce('=' || p.lang, '')
  join nodes s on s.grp = a.grp and s.level = a.level and s.idx // 8 = p.idx // (8 ** (a.level + 1))::bigint
  group by p.r, a.level
), upper_sides as (
  select u.grp, a.level, coalesce(string_agg(s.node, '' order by s.idx) filter (where s.idx < (u.idx // (8 ** a.level)::bigint)), '') as lft, coalesce(string_agg(s.node, '' order by s.idx) filter (where s.idx > (u.idx // (8 ** a.level)::bigint)), '') as rgt
  from subs u cross join (select distinct level from tops where n > 1) a
  join tops s on s.level = a.level and s.idx // 8 = u.idx // (8 ** (a.level + 1))::bigint
  group by u.grp, a.level
), path as (
  select r, level, lft, rgt from sides
  union all
  select p.r, u.depth + x.level, x.lft, x.rgt from placed p join subs u on u.grp = coalesce('=' || p.lang, '') join upper_sides x on x.grp = u.grp
), fold as (
  select r, 0 as level, claimed as node from placed
  union all
  select f.r, f.level + 1, sha256(p.lft || f.node || p.rgt) from fold f join path p on p.r = f.r and p.level = f.level
), folded as (
  select r, max_by(node, level) as folded_root from fold group by r
), proofs as (
  select r, sha256(string_agg(lft || rgt, '' order by level)) as proof_sha256 from path group by r
)
select p.doc_id, p.leaf, u.subroot, t.node as root, coalesce(q.proof_sha256, sha256('')) as proof_sha256, f.folded_root, f.folded_root = t.node as verified
from placed p join subs u on u.grp = coalesce('=' || p.lang, '') join folded f on f.r = p.r left join proofs q on q.r = p.r cross join (select node from tops where n = 1) t
"""
