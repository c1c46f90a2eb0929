"""Exact Jaccard join of documents on word shingles, by partition of the universe of shingles.

Two sets r and s with a Jaccard similarity of 0.75 or more differ in at most (|r| + |s|) / 7 elements. For each band of
sizes the universe is cut by hash into segments. A difference spoils at most one segment, so if a set fills k segments and
the sets differ in at most H, at least k - H of their subsets are equal; so in any one order of all subsets, the first
equal one is among the first H + 1 of either. The order is by cost: subsets are counted, and each set leaves out its most
frequent ones, all but H + 1. One such key buys one difference. A set that fills too few segments is also indexed by the
one-deletion neighbourhoods of its segments of two and more elements, each of which buys two. Candidates are verified on
the whole sets.

Before that, sets that can have no partner are left out: one whose shingles are shared with any other set to less than
three quarters. Shingles are counted in slices of the hash space, as packed arrays, four bytes and a place each.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusgraph.llm.common import blocks_of, cut, mix64, portions, shingles, stored, table, word_hashes
from corpusgraph.llm.components import components
from corpusgraph.llm.linededup import only_with

SHINGLE_WORDS = 5
#: Linked from 100 * intersection >= PERCENT * union on; the bounds below are those of 75.
PERCENT = 75
SHINGLES_PER_SLICE = 1 << 21
#: Upper ends of the bands of set sizes grow by this factor; segments are this share of the upper end.
BAND_GROWTH, SEGMENT_SHARE = 1.25, 0.7

#: Of a block of documents that are compared at once; shingles of a matrix product.
DOCS_PER_BLOCK, SHINGLES_PER_BLOCK, COLUMNS_AT_ONCE = 256, 1 << 18, 1 << 13
#: Sizes of the sets of a block of a very frequent key differ by less than this factor.
SIZE_STEP = 1.1

#: Characters of the texts whose shingles are dealt together: each slice gets one packed array of them.
PORTION_CHARS = 1 << 20
_SHARED_DOC = 0xFFFF
_DOCS_AT_ONCE = 60_000


def _sets(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        return shingles(*word_hashes(texts), SHINGLE_WORDS)


def _sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values, out=total[1:])
    ends = np.cumsum(sizes)
    return total[ends] - total[ends - sizes]


def _prints(sets: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit fingerprints of each set."""
    with np.errstate(over="ignore"):
        return mix64(_sums(mix64(sets), sizes)), mix64(_sums(mix64(sets ^ np.uint64(0x5851F42D4C957F2D)), sizes))


def _fingerprints(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        ids, texts = batch["doc_id"], batch["text"].tolist()
        for a, b in portions(texts):
            sets, sizes = _sets(texts[a:b])
            f1, f2 = _prints(sets, sizes)
            yield pd.DataFrame({"doc_id": ids.iloc[a:b].astype("Int64"), "n_shingles": sizes, "f1": f1.astype(np.int64), "f2": f2.astype(np.int64)})


_BLOB = "slice int, chunk long, keys binary, places binary, prints binary, info binary"


def _dealt(n_slices: int):
    """The shingles of a portion of texts, dealt to slices: for each slice the low halves of hashes and the sets' places."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        chunk = TaskContext.get().partitionId() << 32
        for batch in batches:
            texts = batch["text"].tolist()
            for a, b in portions(texts, PORTION_CHARS):
                for c in range(a, b, _DOCS_AT_ONCE):
                    sets, sizes = _sets(texts[c : min(b, c + _DOCS_AT_ONCE)])
                    f1, _ = _prints(sets, sizes)
                    names, at = np.unique(f1, return_index=True)  # equal sets of a portion count once
                    keep = np.zeros(len(sizes), bool)
                    keep[at] = sizes[at] > 0
                    mask = np.repeat(keep, sizes)
                    sets, sizes, names = sets[mask], sizes[keep], f1[keep]
                    if not len(sets):
                        continue
                    docs = np.repeat(np.arange(len(sizes), dtype=np.uint16), sizes)
                    order = np.argsort(sets)
                    sets, docs = sets[order], docs[order]
                    first = np.flatnonzero(np.concatenate([[True], sets[1:] != sets[:-1]]))
                    runs = np.diff(np.append(first, len(sets)))
                    # a shingle of several sets here is sent once, as shared
                    local = np.bincount(docs[np.repeat(runs > 1, runs)], minlength=len(sizes))
                    places = np.where(runs > 1, np.uint16(_SHARED_DOC), docs[first]).astype("<u2")
                    keys = sets[first]
                    slices = ((keys >> np.uint64(32)) * np.uint64(n_slices) >> np.uint64(32)).astype(np.int64)
                    ends = np.searchsorted(slices, np.arange(n_slices + 1))
                    low, prints = keys.astype("<u4"), names.astype("<u8").tobytes()
                    info = names.tobytes() + sizes.astype("<i8").tobytes() + local.astype("<i8").tobytes()
                    told = chunk % n_slices
                    rows = [(s, chunk, low[x:y].tobytes(), places[x:y].tobytes(), prints, info if s == told else b"") for s, (x, y) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)) if y > x or s == told]
                    chunk += 1
                    yield pd.DataFrame(rows, columns=["slice", "chunk", "keys", "places", "prints", "info"])

    return run


def _shared(rows: pd.DataFrame) -> pd.DataFrame:
    """For each chunk of a slice, how many shingles of each of its sets another set has too."""
    keys = np.concatenate([np.frombuffer(x, "<u4") for x in rows["keys"]])
    places = [np.frombuffer(x, "<u2") for x in rows["places"]]
    known = np.concatenate(places) == _SHARED_DOC
    names = [np.frombuffer(x, "<u8") for x in rows["prints"]]
    ranks = np.unique(np.concatenate(names))  # sets by number, so that a number and a key fit in 64 bits
    prints = np.concatenate([np.append(np.searchsorted(ranks, x), len(ranks))[np.where(p == _SHARED_DOC, len(x), p)].astype(np.uint64) for x, p in zip(names, places, strict=True)])
    both = np.sort(keys.astype(np.uint64) << np.uint64(32) | prints)
    high = both >> np.uint64(32)
    twice = high[1:][(high[1:] == high[:-1]) & (both[1:] != both[:-1])]
    shared = np.unique(np.concatenate([twice.astype(np.uint32), keys[known]]))
    at = np.minimum(np.searchsorted(shared, keys), max(0, len(shared) - 1))
    hit = shared[at] == keys if len(shared) else np.zeros(len(keys), bool)
    out, first = [], 0
    for chunk, p, x, info in zip(rows["chunk"], places, names, rows["info"], strict=True):
        own = p[hit[first : first + len(p)]]
        first += len(p)
        out.append((chunk, np.bincount(own[own != _SHARED_DOC], minlength=len(x)).astype("<u4").tobytes(), info))
    return pd.DataFrame(out, columns=["chunk", "counts", "info"])


def _kept(rows: pd.DataFrame) -> pd.DataFrame:
    """The sets of a chunk that share three quarters of their shingles with others."""
    info = np.frombuffer(b"".join(rows["info"]), "<i8").reshape(3, -1)
    total = info[2] + np.sum([np.frombuffer(x, "<u4") for x in rows["counts"]], axis=0, dtype=np.int64)
    ok = 100 * total >= PERCENT * info[1]
    return pd.DataFrame({"f1": info[0][ok], "n_shingles": info[1][ok]})


def with_possible_partners(docs: DataFrame, n_shingles: int) -> DataFrame:
    """(f1, n_shingles) of the sets that may be similar to a different set; every set that is, is among them."""
    slices = blocks_of(n_shingles, SHINGLES_PER_SLICE)
    blobs = docs.select("text").mapInPandas(_dealt(slices), _BLOB)
    counts = blobs.groupBy("slice").applyInPandas(_shared, "chunk long, counts binary, info binary")
    return counts.groupBy("chunk").applyInPandas(_kept, "f1 long, n_shingles long").distinct()


def _whole_sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The sets of texts that are those of their class: with one doc_id there may be texts of other classes."""
    for batch in batches:
        texts = batch["text"].tolist()
        for a, b in portions(texts):
            sets, sizes = _sets(texts[a:b])
            prints = np.stack(_prints(sets, sizes)).astype(np.int64)
            own = (prints == batch.iloc[a:b][["f1", "f2"]].to_numpy().T).all(axis=0) & (sizes > 0)
            raw, ends = sets.astype("<u8").tobytes(), np.cumsum(sizes).tolist()
            elements = [raw[8 * (e - n) : 8 * e] for n, e, ok in zip(sizes.tolist(), ends, own.tolist(), strict=True) if ok]
            if elements:
                yield pd.DataFrame({"doc_id": batch["class"].iloc[a:b][own], "n": sizes[own], "elements": elements})


@cache
def bands(n: int) -> list[tuple[int, int, int]]:
    """(band, segments, differences allowed) of a set of n: its own band, and the lower ones where it may be the larger set."""
    out, high, band = [], 1, 0
    low = 1
    while low <= n:
        if n <= high * 4 // 3:
            allowed = (n + n * 4 // 3) // 7 if n <= high else (high + n) // 7
            out.append((band, max(2, int(SEGMENT_SHARE * high) + 2), allowed))
        low, high, band = high + 1, max(high + 1, int(high * BAND_GROWTH)), band + 1
    return out


def index_keys(elements: np.ndarray) -> list[tuple[int, int, np.ndarray]]:
    """(band, spare, keys) of one set: it may leave out the `spare` most frequent keys of a band. elements: sorted, distinct."""
    n, out = len(elements), []
    mixed = mix64(elements)
    sums = np.concatenate([[np.uint64(0)], np.cumsum(mixed, dtype=np.uint64)])
    for band, segments, allowed in bands(n):
        of = (elements >> np.uint64(32)) * np.uint64(segments) >> np.uint64(32)
        first = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
        last = np.append(first[1:], n)
        sizes, names = last - first, of[first]
        subset = sums[last] - sums[first]
        tag = (names + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(band + 1) * np.uint64(0xD6E8FEB86659FD93)
        out.append((band, max(0, len(first) - allowed - 1), mix64(subset ^ tag)))
        if len(first) > allowed:
            continue
        several = sizes >= 2
        if 2 * several.sum() <= allowed:
            out.append((band, 0, mix64(np.array([band], np.uint64) + np.uint64(0xA0761D6478BD642F))))
        place = np.repeat(several, sizes)
        whose = np.repeat(np.arange(len(first)), sizes)[place]
        one_less = subset[whose] - mixed[place]
        deletion = np.uint64(0xE7037ED1A0B428DB)
        out.append((band, 0, np.unique(mix64(np.concatenate([subset[several], one_less]) ^ np.concatenate([tag[several], tag[whose]]) ^ deletion))))
    return out


_POSTING = "key long, doc long, band int, spare int"


def _indexed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    def rows(parts: list) -> pd.DataFrame:
        sizes = [len(k) for *_, k in parts]
        columns = [np.repeat(np.array([p[i] for p in parts]), sizes) for i in range(3)]
        return pd.DataFrame({"key": np.concatenate([k for *_, k in parts]).astype(np.int64), "doc": columns[0], "band": columns[1], "spare": columns[2]})

    for batch in batches:
        parts, size = [], 0
        with np.errstate(over="ignore"):
            for doc, raw in zip(batch["doc_id"].tolist(), batch["elements"].tolist(), strict=True):
                for band, spare, keys in index_keys(np.frombuffer(raw, "<u8")):
                    parts.append((doc, band, spare, keys))
                    size += len(keys)
                if size > 1 << 18:
                    yield rows(parts)
                    parts, size = [], 0
        if parts:
            yield rows(parts)


def _checked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        ok = []
        for x, y in zip(batch["x"], batch["y"], strict=True):
            x, y = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
            both = len(np.intersect1d(x, y, assume_unique=True))
            ok.append(100 * both >= PERCENT * (len(x) + len(y) - both))
        yield batch[["a", "b"]].assign(ok=ok)


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, ok) of pairs of documents, on their whole sets."""
    fits = pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("n").alias("na")), "a").join(sets.select(F.col("doc_id").alias("b"), F.col("n").alias("nb")), "b")
    fits = fits.where(100 * F.least("na", "nb") >= PERCENT * F.greatest("na", "nb")).select("a", "b")
    both = fits.join(sets.select(F.col("doc_id").alias("a"), F.col("elements").alias("x")), "a").join(sets.select(F.col("doc_id").alias("b"), F.col("elements").alias("y")), "b")
    return both.mapInPandas(_checked, "a long, b long, ok boolean")


def links(sets: DataFrame) -> DataFrame:
    """Edges (a, b) of similar sets that connect all that similar sets connect. sets: doc_id, n, elements, all different.

    Each document is compared with one central document first, the one it has the most keys in common with. Documents with
    a common key that this doesn't connect are then compared in tiles.
    """
    postings = stored(sets.select("doc_id", "elements").mapInPandas(_indexed, _POSTING), "postings")
    often = postings.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    costly = F.row_number().over(Window.partitionBy("doc", "band").orderBy(F.desc("n"), F.desc("key")))
    postings = postings.join(often, "key").withColumn("nth", costly).where("nth > spare").select("key", "doc", "n")
    postings = stored(postings, "cheap-postings")
    # the document of a key that has the most in common with all others is compared with the rest of them first
    weight = postings.groupBy("doc").agg(F.sum("n").alias("w"))
    centre = F.max_by("doc", F.struct("w", -F.col("doc")))
    weighed = postings.join(weight, "doc")
    centres = weighed.groupBy("key").agg(centre.alias("centre"), F.count("*").alias("docs")).where("docs > 1").select("key", "centre")
    postings = stored(postings.select("key", "doc").join(centres, "key"), "shared-postings")
    stars = postings.where("centre <> doc").groupBy(F.col("centre").alias("a"), F.col("doc").alias("b")).agg(F.count("*").alias("n"))
    stars = cut(stars)
    # each document with the one it has the most keys in common with
    best = stars.groupBy("b").agg(F.max_by("a", F.struct("n", -F.col("a"))).alias("a")).select("a", "b")
    edges = cut(verified(best, sets)).where("ok").select("a", "b")
    label = components(edges)
    rows = postings.select("key", "doc").join(label.withColumnRenamed("node", "doc"), "doc", "left").withColumn("component", F.coalesce("component", "doc"))
    rows = stored(rows, "labelled-postings")
    open_ = rows.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x < y").select("key")
    return edges.unionByName(compared_in_tiles(rows.join(open_, "key", "left_semi"), sets))


def compared_in_tiles(postings: DataFrame, sets: DataFrame) -> DataFrame:
    """Edges (a, b) between different components of documents that share a key: as few as connect all that similar sets do.

    postings: key, doc, component. Documents are gathered in blocks of bounded size, by the most frequent key they have and,
    where it has more than a block, by the size of their sets; each pair of blocks with a common key whose sizes are near
    enough is a tile, in which all sets are compared at once by matrix products. So the rows that move are the sets of a
    block, once for each tile, and no pairs of documents.
    """
    often = postings.groupBy("key").agg(F.count("*").alias("m"))
    leader = postings.join(often, "key").groupBy("doc", "component").agg(F.max_by("key", F.struct("m", "key")).alias("leader"))
    leader = leader.join(sets.select(F.col("doc_id").alias("doc"), "n"), "doc").withColumn("step", F.floor(F.log(F.col("n")) / math.log(SIZE_STEP)))
    parts = F.greatest(F.ceil(F.count("*") / DOCS_PER_BLOCK), F.ceil(F.sum("n") / SHINGLES_PER_BLOCK))
    by_step = leader.groupBy("leader", "step").agg(parts.alias("parts"), F.count("*").alias("docs"), F.sum("n").alias("shingles"))
    whole = by_step.groupBy("leader").agg(F.sum("docs").alias("docs"), F.sum("shingles").alias("shingles"))
    small = whole.where((F.col("docs") <= DOCS_PER_BLOCK) & (F.col("shingles") <= SHINGLES_PER_BLOCK)).select("leader", F.lit(True).alias("small"))
    dealt = leader.join(by_step.select("leader", "step", "parts"), ["leader", "step"]).join(small, "leader", "left")
    block = F.when(F.col("small"), F.xxhash64("leader")).otherwise(F.xxhash64("leader", "step", F.pmod(F.xxhash64("doc"), "parts")))
    blocks = cut(dealt.select("doc", "component", "n", block.alias("block")))
    ranges = blocks.groupBy("block").agg(F.min("n").alias("low"), F.max("n").alias("high"))
    has = postings.select("key", "doc").join(blocks.select("doc", "block"), "doc").select("key", "block").distinct()
    # of keys with the same blocks one is enough
    same = has.groupBy("key").agg(F.count("*").alias("n"), F.sum(F.xxhash64("block").cast("decimal(38,0)")).alias("h")).groupBy("n", "h").agg(F.min("key").alias("key"))
    has = cut(has.join(same.select("key"), "key", "left_semi").join(ranges, "block"))
    other = has.select("key", F.col("block").alias("other"), F.col("low").alias("other_low"), F.col("high").alias("other_high"))
    near = (100 * F.least("high", "other_high") >= PERCENT * F.greatest("low", "other_low")) & (F.col("block") <= F.col("other"))
    pairs = has.join(other, "key").where(near).select("block", "other").distinct()
    tiles = pairs.select(F.xxhash64("block", "other").alias("tile"), F.explode(F.array_distinct(F.array("block", "other"))).alias("block"))
    members = tiles.join(blocks, "block").join(sets.select(F.col("doc_id").alias("doc"), "elements"), "doc")
    return members.select("tile", "doc", "component", "elements").groupBy("tile").applyInPandas(_tile_links, "a long, b long")


def _tile_links(rows: pd.DataFrame) -> pd.DataFrame:
    docs, component = rows["doc"].to_numpy(), rows["component"].to_numpy()
    names, of = np.unique(component, return_inverse=True)
    none = pd.DataFrame({"a": pd.Series([], dtype="int64"), "b": pd.Series([], dtype="int64")})
    if len(names) < 2:
        return none
    arrays = [np.frombuffer(x, "<u8") for x in rows["elements"]]
    n = np.array([len(x) for x in arrays])
    words, column, often = np.unique(np.concatenate(arrays), return_inverse=True, return_counts=True)
    place = np.cumsum(often > 1) - 1  # a shingle of one set alone is in no intersection
    keep = often[column] > 1
    row, column = np.repeat(np.arange(len(docs)), n)[keep], place[column[keep]]
    both = np.zeros((len(docs), len(docs)), np.float32)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    for first in range(0, int((often > 1).sum()), COLUMNS_AT_ONCE):
        a, b = np.searchsorted(column, [first, first + COLUMNS_AT_ONCE])
        part = np.zeros((len(docs), COLUMNS_AT_ONCE), np.float32)
        part[row[a:b], column[a:b] - first] = 1
        both += part @ part.T
    similar = (100 * both >= PERCENT * (n[:, None] + n[None, :] - both)) & (of[:, None] < of[None, :])
    i, j = np.nonzero(similar)
    _, at = np.unique(of[i] * len(names) + of[j], return_index=True)
    root = list(range(len(names)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    out = []
    for k in at.tolist():
        x, y = find(int(of[i[k]])), find(int(of[j[k]]))
        if x != y:
            root[x] = y
            out.append((int(docs[i[k]]), int(docs[j[k]])))
    return pd.DataFrame(out, columns=["a", "b"]) if out else none


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of docs (doc_id, text).

    Words are `[^\\x20\\x09-\\x0D]+` with A-Z lower-cased; a set holds the distinct 5-word shingles, or the whole sequence
    if there are fewer words. A null or empty text has no shingles and is linked with nothing; so is a row without doc_id,
    whose component_id is null. Rows that repeat a doc_id, with one text or several, count as one document with all their
    links. Equal sets are one class from the start. Other columns are left out; an empty table gives no rows.
    """
    rows = stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(_fingerprints, "doc_id long, n_shingles long, f1 long, f2 long"), "fingerprints")
    usable = rows.where("doc_id is not null and n_shingles > 0")
    classes = cut(usable.groupBy("n_shingles", "f1", "f2").agg(F.min("doc_id").alias("first")))
    total = rows.agg(F.sum("n_shingles")).first()[0] or 0
    partners = with_possible_partners(docs, total)
    # a class has a number of its own, as one doc_id may be the first of several
    chosen = stored(classes.join(partners, ["f1", "n_shingles"], "left_semi").select("first", "f1", "f2", F.monotonically_increasing_id().alias("class")), "classes")
    texts = only_with(docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "text"), chosen.withColumnRenamed("first", "doc_id"), "doc_id")
    sets = texts.join(chosen, F.col("doc_id") == F.col("first")).select("text", "f1", "f2", "class").mapInPandas(_whole_sets, "doc_id long, n long, elements binary")
    sets = stored(sets.dropDuplicates(["doc_id"]), "sets")
    first = chosen.select("class", "first")
    found = links(sets).join(first.select(F.col("class").alias("a"), F.col("first").alias("x")), "a").join(first.select(F.col("class").alias("b"), F.col("first").alias("y")), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    copies = usable.join(classes, ["n_shingles", "f1", "f2"]).select(F.col("first").alias("a"), F.col("doc_id").alias("b")).where("a <> b")
    # copies hang on their class: only where a class has rows of other documents do they join the graph
    class_of = components(found.unionByName(copies))
    out = rows.join(class_of.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with the number of their shingles and their class of near copies."""
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


OP2_SQL = r"""
with recursive w as (
  select doc_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as words from documents
), s as (
  select doc_id, case when words is null or len(words) = 0 then []::varchar[] when len(words) < 5 then [array_to_string(words, ' ')]
    else list_distinct(list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i+4], ' '))) end as sh from w
), n as (
  select doc_id, len(sh)::bigint as n from s
), t as (
  select doc_id, unnest(sh) as g from s
), h as (
  select g, list(doc_id) as docs from t group by g having count(*) > 1
), o as (
  select a.doc_id as a, b.doc_id as b, count(*) as both from t a join t b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2
), e as (
  select o.a, o.b from o join n x on x.doc_id = o.a join n y on y.doc_id = o.b where 100 * o.both >= 75 * (x.n + y.n - o.both)
), both_ways as (
  select a as u, b as v from e union select b, a from e
), reach(u, v) as (
  select u, v from both_ways union select r.u, x.v from reach r join both_ways x on r.v = x.u
)
select n.doc_id, n.n as n_shingles, least(n.doc_id, coalesce(min(r.v), n.doc_id)) as component_id from n left join reach r on r.u = n.doc_id group by n.doc_id, n.n
"""
