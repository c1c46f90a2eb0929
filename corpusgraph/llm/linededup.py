"""Line deduplication across documents: deletion-neighbourhood join on words.

Two lines are alike if their words are equal or, where both have at least MIN_WORDS words, if one word inserted, deleted or
replaced makes one the other. Words are `[^\\x20\\x09-\\x0D]+` with A-Z lower-cased; each character of a script without
blanks is a word. Blank lines are alike with nothing. Of alike lines the earliest stays: a line goes if any earlier line,
kept or not, is alike. Places are ordered by doc_id, then (where a doc_id is repeated) by a hash of the text, then by line
number.

1. Equal lines meet in their hash; the earliest place stands for them.
2. Lines that are one edit apart share their first or their last half, so only lines that share a half with another line
   go on (an exact filter: nothing is lost).
3. Those emit the hashes of all variants with one word deleted, and of themselves. Lines with the same variant at the
   same position are one replacement apart, and a line that equals a variant of another is one insertion apart. Within a
   group of equal variants only the earliest place matters, so groups are reduced by minimum, never paired.
4. Each pair found is verified word by word.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusgraph.llm.common import _BASE, _IPOW, _ODD, _POW, _inverse, _powers, blocks_of, cut, mix64, portions, stored, table, word_hashes
from corpusgraph.llm.urls import BITS_PER_URL, bloom_words, with_possible_hits

#: Lines of fewer words are alike only if they are equal: one word of a few is no small difference.
MIN_WORDS = 8
#: Lines that occur more often than this share of all, and OFTEN times, are marked by broadcast: at most HOT_LINES of them.
HOT_LINES, OFTEN = 100_000, 1000
#: Characters of scripts without blanks between words, each a word of its own.
NO_BLANKS = re.compile("([\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff])")

_OCCURRENCES = "line long, doc_id long, part long, line_no int, keys array<long>"


class _Sums:
    """Hashes of spans of words from running sums."""

    def __init__(self, words: np.ndarray):
        self.sums = np.zeros(len(words) + 1, np.uint64)
        np.cumsum(words * _powers(_POW, _BASE, np.arange(len(words))), out=self.sums[1:])

    def raw(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (self.sums[b] - self.sums[a]) * _powers(_IPOW, _inverse(_BASE), a)

    def span(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return mix64(self.raw(a, b) + (b - a).astype(np.uint64) * _ODD)

    def without(self, a: np.ndarray, b: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Hash of the words a to b but the one at `at`: the same as that of a line without it."""
        head = self.sums[at] - self.sums[a]
        tail = (self.sums[b] - self.sums[at + 1]) * np.uint64(_inverse(_BASE))
        return mix64((head + tail) * _powers(_IPOW, _inverse(_BASE), a) + (b - a - 1).astype(np.uint64) * _ODD)


#: What places are ordered by.
_PLACE = ("doc_id", "part", "line_no")


def _tagged(x: np.ndarray, *tags) -> np.ndarray:
    for t in tags:
        x = mix64(x ^ (np.asarray(t).astype(np.uint64) + np.uint64(1)) * _ODD)
    return x


def half_keys(s: _Sums, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Four keys for each line: first and last half, as the shorter or equal one of a pair and as the longer one."""
    keys, n = [], b - a
    for least in (n, n - 1):
        h = least // 2
        keys += [_tagged(s.span(a, a + h), least, 0), _tagged(s.span(b - h, b), least, 1)]
    return np.stack(keys, axis=1)


def spaced(line: str) -> str:
    """The line with blanks around each character of a script without them."""
    return line if line.isascii() else NO_BLANKS.sub(r" \1 ", line)


def _occurrences(min_words: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = batch["text"].tolist()
            for first, last in portions(texts):
                lines = [text.split("\n") for text in texts[first:last]]
                sizes = [len(x) for x in lines]
                numbers = np.concatenate([np.arange(n, dtype=np.int32) for n in sizes])
                found = rows([x for own in lines for x in own], np.repeat(np.arange(first, last), sizes), numbers, batch)
                if len(found):
                    yield found

    def rows(lines: list[str], of: np.ndarray, numbers: np.ndarray, batch: pd.DataFrame) -> pd.DataFrame:
        with np.errstate(over="ignore"):
            words, counts = word_hashes([spaced(x) for x in lines])
            ends = np.cumsum(counts)
            keep = np.flatnonzero(counts)
            a, b = (ends - counts)[keep], ends[keep]
            s = _Sums(words)
            long = counts[keep] >= min_words
            own = iter(half_keys(s, a[long], b[long]).astype(np.int64))
            keys = pd.Series([next(own) if x else None for x in long.tolist()], dtype=object)
            of = of[keep]
            return pd.DataFrame({"line": s.span(a, b).astype(np.int64), "doc_id": batch["doc_id"].to_numpy()[of], "part": batch["part"].to_numpy()[of], "line_no": numbers[keep], "keys": keys})

    return run


def _words_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The word hashes of the chosen lines of each text."""
    for batch in batches:
        for text, chosen in zip(batch["text"].tolist(), batch["chosen"].tolist(), strict=True):
            own = text.split("\n")
            words, counts = word_hashes([spaced(own[c["line_no"]]) for c in chosen])
            yield pd.DataFrame({"line": [c["line"] for c in chosen], "words": np.split(words.astype(np.int64), np.cumsum(counts)[:-1])})


def _variants(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A row for each line and deleted word: the variant's hash and its hash at that position."""
    for batch in batches:
        if not len(batch):
            continue
        with np.errstate(over="ignore"):
            counts = np.array([len(w) for w in batch["words"]])
            s = _Sums(np.concatenate(batch["words"].tolist()).astype(np.uint64))
            ends = np.cumsum(counts)
            a, b = np.repeat(ends - counts, counts), np.repeat(ends, counts)
            at = np.arange(len(a))
            v = s.without(a, b, at)
            yield pd.DataFrame({"line": np.repeat(batch["line"].to_numpy(), counts), **{c: np.repeat(batch[c].to_numpy(), counts) for c in _PLACE}, "variant": v.astype(np.int64), "placed": _tagged(v, at - a, 2).astype(np.int64)})


def one_edit(a: list[int], b: list[int]) -> bool:
    """At most one word inserted, deleted or replaced."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[i + (len(a) == len(b)) :] == b[i + 1 :]


def _verified(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        ok = np.array([one_edit(list(x), list(y)) for x, y in zip(batch["words"], batch["first_words"], strict=True)], bool)
        if ok.any():
            yield batch.loc[ok, ["line", "first"]]


def _part(text: Column | str) -> Column:
    """Tells apart the texts of rows with one doc_id."""
    return F.xxhash64(text)


def dropped_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """The lines that go: (doc_id, part, line_no, near); near is false where an equal line stands earlier.

    docs: doc_id, text; other columns are left out. Rows with a null doc_id or text take no part. Lines of any length but
    blank ones go if an equal one stands earlier, those of min_words words also if one an edit away does: an edit is one
    word inserted, deleted or replaced. Rows with one doc_id and text count as one document, rows with one doc_id and
    different texts as documents of their own, told apart by part (a hash of the text). An empty table gives no rows.
    """
    usable = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), _part("text").alias("part"), "text")
    seen = stored(usable.mapInPandas(_occurrences(min_words), _OCCURRENCES), "lines")
    place = F.struct(*_PLACE)
    lines = seen.groupBy("line").agg(F.min(place).alias("place"), F.max(place).alias("last"), F.count("*").alias("n"), F.first("keys", ignorenulls=True).alias("keys"))
    lines = stored(lines, "distinct-lines")
    # lines that share a half with another line
    halves = lines.select("line", F.explode("keys").alias("key"))
    shared = halves.groupBy("key").agg(F.min("line").alias("low"), F.max("line").alias("high")).where("low < high").select("key")
    alike = halves.join(shared, "key", "left_semi").select("line").distinct()
    chosen = cut(lines.select("line", "place").join(alike, "line", "left_semi").select("line", "place.*"))
    by_doc = chosen.groupBy("doc_id", "part").agg(F.collect_list(F.struct("line", "line_no")).alias("chosen"))
    words = only_with(usable, by_doc, "doc_id").join(by_doc, ["doc_id", "part"]).select("text", "chosen").mapInPandas(_words_of, "line long, words array<long>")
    words = stored(words.dropDuplicates(["line"]).join(chosen, "line"), "line-words")
    # variants with one word deleted: only the earliest line of a group counts for the others
    variants = words.mapInPandas(_variants, "line long, doc_id long, part long, line_no int, variant long, placed long")
    v = variants.select("line", place.alias("place"), "variant", "placed")
    own = F.struct("place", "line")
    first = v.groupBy("placed").agg(F.min(own).alias("f"), F.max(own).alias("g")).where("f < g").select("placed", F.col("f.line").alias("first"), F.col("f.place").alias("first_place"))
    replaced = v.join(first, "placed").where("first_place < place").select("line", "first")
    whole = words.select(F.col("line").alias("whole"), place.alias("whole_place"))
    longer = v.join(whole, v["variant"] == whole["whole"])
    inserted = longer.where("whole_place < place").select("line", F.col("whole").alias("first"))
    removed = longer.where("place < whole_place").groupBy("whole").agg(F.min(own).alias("f")).select(F.col("whole").alias("line"), F.col("f.line").alias("first"))
    pairs = replaced.unionByName(inserted).unionByName(removed).groupBy("line").agg(F.collect_set("first").alias("firsts")).select("line", F.explode("firsts").alias("first"))
    pairs = pairs.join(words.select("line", "words"), "line").join(words.select(F.col("line").alias("first"), F.col("words").alias("first_words")), "first")
    near = pairs.mapInPandas(_verified, "line long, first long").select("line").distinct()
    gone = lines.join(near.withColumn("near", F.lit(True)), "line", "left").where("near or place < last")
    gone = cut(gone.select("line", F.col("place").alias("kept"), F.coalesce("near", F.lit(False)).alias("near"), "n"))
    # lines that occur very often are few, so they are marked where they stand; the rest meet in their hash
    often = max(OFTEN, -(-seen.count() // HOT_LINES))
    hot = gone.where(F.col("n") > often).select("line", F.col("kept").alias("hot_kept"), F.col("near").alias("hot_near"))
    marked = seen.select("line", *_PLACE).join(F.broadcast(hot), "line", "left")
    rare = marked.where("hot_kept is null").select("line", *_PLACE).join(gone.where(F.col("n") <= often).select("line", "kept", "near"), "line")
    out = rare.unionByName(marked.where("hot_kept is not null").select("line", *_PLACE, F.col("hot_kept").alias("kept"), F.col("hot_near").alias("near")))
    out = out.where(F.col("near") | (F.col("kept") < place))
    return out.select(*_PLACE, F.when(F.col("kept") < place, False).otherwise(True).alias("near")).distinct()


def only_with(docs: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """The rows of docs that a Bloom filter of keys lets pass: all that a join on key needs, so that few texts are moved."""
    keys = keys.select(key).distinct()
    blocks = blocks_of(keys.count() * BITS_PER_URL, 64)
    return with_possible_hits(docs, key, bloom_words(keys, key, blocks), blocks, "__hit").where("__hit").drop("__hit")


def without_lines(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """docs without these lines (doc_id, part, line_no); documents that lose all their lines go, all others keep their columns.

    n_chars, where there is one, becomes the length of the new text.
    """
    by_doc = dropped.groupBy("doc_id", F.col("part").alias("__part")).agg(F.collect_set("line_no").alias("__gone"))
    by_doc = cut(by_doc)
    keys = by_doc.select("doc_id").distinct()
    blocks = blocks_of(keys.count() * BITS_PER_URL, 64)
    marked = with_possible_hits(docs, "doc_id", bloom_words(keys, "doc_id", blocks), blocks, "__hit")
    hits = marked.where("__hit").withColumn("__part", _part("text")).join(by_doc, ["doc_id", "__part"], "left").select(*docs.columns, "__gone")
    lines = F.filter(F.transform(F.split("text", "\n"), lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda s: ~F.array_contains("__gone", s["i"]))
    kept = hits.withColumn("__kept", F.when(F.col("__gone").isNotNull(), F.transform(lines, lambda s: s["x"])))
    kept = kept.where(F.col("__kept").isNull() | (F.size("__kept") > 0))
    kept = kept.withColumn("text", F.when(F.col("__kept").isNotNull(), F.array_join("__kept", "\n")).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.when(F.col("__kept").isNotNull(), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return kept.select(*docs.columns).unionByName(marked.where(~F.coalesce("__hit", F.lit(False))).select(*docs.columns))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the numbers of its lines that go, and of how many an equal line, or only one alike, is earlier."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    gone = dropped_lines(docs).groupBy("doc_id", "part").agg(F.sort_array(F.collect_list("line_no")).alias("dropped"), F.sum((~F.col("near")).cast("long")).alias("n_exact"), F.sum(F.col("near").cast("long")).alias("n_near"))
    n_lines = F.coalesce(F.size(F.split("text", "\n")), F.lit(0)).cast("long")
    out = docs.select("doc_id", _part("text").alias("part"), F.when(F.col("text").isNull(), 0).otherwise(n_lines).alias("n_lines")).join(gone, ["doc_id", "part"], "left")
    return out.select("doc_id", "n_lines", F.coalesce("n_exact", F.lit(0)).alias("n_exact"), F.coalesce("n_near", F.lit(0)).alias("n_near"), F.coalesce("dropped", F.array().cast("array<int>")).alias("dropped"))


#: Variants are lists of words here, and lines are compared by the same rule; written for small tables.
OP9_SQL = r"""
with l as (
  select doc_id, unnest(range(len(x)))::int as line_no, unnest(x) as line from (select doc_id, string_split(text, chr(10)) as x from documents where doc_id is not null and text is not null)
), w as (
  select doc_id, line_no, list_filter(regexp_split_to_array(translate(regexp_replace(line, '([\x{0e00}-\x{0eff}\x{1000}-\x{109f}\x{1780}-\x{17ff}\x{3040}-\x{30ff}\x{31f0}-\x{31ff}\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{f900}-\x{faff}\x{ff66}-\x{ff9f}\x{20000}-\x{3ffff}])', ' \1 ', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as words from l
), o as (
  select doc_id, line_no, words from w where len(words) >= 1
), d as (
  select words, min((doc_id, line_no)) as place from o group by words
), v as (
  select words, place, p, list_concat(words[1:p-1], words[p+1:]) as variant from (select words, place, unnest(range(1, len(words) + 1)) as p from d where len(words) >= 8)
), f as (
  select variant, p, min(place) as first from v group by all having count(*) > 1
), near as (
  select v.words from v join f on v.variant = f.variant and v.p = f.p where f.first < v.place
  union select v.words from v join d on v.variant = d.words where len(d.words) >= 8 and d.place < v.place
  union select d.words from v join d on v.variant = d.words where len(d.words) >= 8 and v.place < d.place
), gone as (
  select distinct o.doc_id, o.line_no, not (d.place < (o.doc_id, o.line_no)) as near
  from o join d on o.words = d.words where d.place < (o.doc_id, o.line_no) or o.words in (select words from near)
), g as (
  select doc_id, list_sort(list(line_no)) as dropped, sum((not near)::bigint)::bigint as n_exact, sum(near::bigint)::bigint as n_near from gone group by doc_id
)
select t.doc_id, case when t.text is null then 0 else len(string_split(t.text, chr(10))) end::bigint as n_lines, coalesce(n_exact, 0)::bigint as n_exact, coalesce(n_near, 0)::bigint as n_near, coalesce(dropped, []::int[]) as dropped
from documents t left join g on t.doc_id = g.doc_id
"""
