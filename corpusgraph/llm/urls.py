"""URL filter: rules by host and path, and a list of canonical URLs behind a blocked Bloom filter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusgraph.llm.common import blocks_of, cut, table, uniform_key

#: Fixed values: (verdict, host, path) of the rules.
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]
#: Words in the host names, of any top-level domain, whose pages make up the list of the registered query.
LISTED_HOST_WORDS = ("bets", "casino", "pills", "spam")

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BITS_PER_URL, BITS_SET = 16, 6
#: Filters of up to so many 64-bit words go to every task as one value; beyond that they are joined by block.
MAX_SHARED_WORDS = 1 << 20


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; '' where there is none."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """After the host up to `?`, `#` or the end; '' where there is no host part."""
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical_url(url: Column) -> Column:
    """Host without www. or m., path without closing slashes, and the sorted query without tracking parameters."""
    query = F.coalesce(F.regexp_extract(url, r"://[^?#]*\?([^#]*)", 1), F.lit(""))
    params = F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.startswith("utm_") & ~p.startswith("ref="))
    return F.concat(F.regexp_replace(host_of(url), r"^(www|m)\.", ""), F.regexp_replace(path_of(url), r"/+$", ""), F.lit("?"), F.array_join(F.array_sort(params), "&"))


def rule_for(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits: host or a subdomain of it, and a path that starts with the rule's."""
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1:]))
    fits = [(v, h + p, ((host == h) | host.endswith(f".{h}")) & path.startswith(p)) for v, h, p in ordered]
    return tuple(F.coalesce(*(F.when(ok, F.lit(out)) for *both, ok in fits for out in [both[which]])) for which in (1, 0))


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(uniform_key(key, seed=1), F.lit(blocks)).cast("int")


def _mask(key: Column) -> Column:
    """The bits of a key within the 64-bit word of its block."""
    h = uniform_key(key, seed=2)
    mask = F.lit(0).cast("long")
    for i in range(BITS_SET):
        mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, 6 * i).bitwiseAND(F.lit(63)).cast("int")))
    return mask


def bloom_words(keys: DataFrame, key: str, blocks: int) -> DataFrame:
    """Blocked Bloom filter: (block, word), a word of 64 bits for each block that has keys."""
    return keys.select(_block(F.col(key), blocks).alias("block"), _mask(F.col(key)).alias("m")).groupBy("block").agg(F.bit_or("m").alias("word"))


def with_possible_hits(df: DataFrame, key: str, words: DataFrame, blocks: int, to: str) -> DataFrame:
    """df with a boolean column: the filter may hold the key (never false for one that it holds)."""
    mask = _mask(F.col(key))
    if blocks <= MAX_SHARED_WORDS:
        dense = df.sparkSession.range(blocks).join(words, F.col("id") == F.col("block"), "left").select(F.struct(F.col("id"), F.coalesce("word", F.lit(0).cast("long")).alias("w")).alias("s"))
        shared = dense.agg(F.transform(F.sort_array(F.collect_list("s")), lambda s: s["w"]).alias("words"))
        found = F.get(shared.scalar(), _block(F.col(key), blocks))
        return df.withColumn(to, F.coalesce(found.bitwiseAND(mask) == mask, F.lit(False)))
    joined = df.withColumn("__block", _block(F.col(key), blocks)).join(words.withColumnRenamed("block", "__block").withColumnRenamed("word", "__word"), "__block", "left")
    return joined.withColumn(to, F.coalesce(F.col("__word").bitwiseAND(mask) == mask, F.lit(False))).drop("__block", "__word")


def judge_urls(pages: DataFrame, listed: DataFrame, rules: list[tuple[str, str, str]] = RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(id_col, host, path, rule, verdict, canonical, possible_hit) for every page, other columns left out.

    The longest fitting rule decides; else a page is blocked if its canonical URL is in `listed` (one column, url), else
    allowed. Null urls and urls without `://` have an empty host and path; they fit no rule and are never listed, so
    they are allowed. Repeated rows are judged alike; an empty list allows all that no rule blocks.
    """
    keys = cut(listed.where(F.instr(F.col("url"), "://") > 0).select(canonical_url(F.col("url")).alias("canonical")).distinct())
    blocks = blocks_of(keys.count() * BITS_PER_URL, 64)
    url = F.col(url_col)
    rows = pages.select(F.col(id_col), host_of(url).alias("host"), path_of(url).alias("path"), F.when(F.instr(url, "://") > 0, canonical_url(url)).alias("canonical"))
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    rows = rows.select("*", rule.alias("rule"), verdict.alias("by_rule"))
    rows = with_possible_hits(rows, "canonical", bloom_words(keys, "canonical", blocks), blocks, "possible_hit")
    hits = rows.where("possible_hit").join(keys.withColumn("listed", F.lit(True)), "canonical", "left")
    rest = rows.where(~F.col("possible_hit")).withColumn("listed", F.lit(None).cast("boolean"))
    judged = hits.unionByName(rest)
    verdict = F.coalesce("by_rule", F.when(F.col("listed"), F.lit("block")).otherwise(F.lit("allow")))
    return judged.select(id_col, "host", "path", "rule", verdict.alias("verdict"), "canonical", "possible_hit")


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page; the list holds the pages of hosts with a word of LISTED_HOST_WORDS in their name."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    listed = pages.where(host_of(F.col("url")).rlike("|".join(LISTED_HOST_WORDS))).select("url")
    return judge_urls(pages, listed).drop("possible_hit")


OP7_SQL = r"""
with p as (
  select page_id, url,
    translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') as path,
    coalesce(regexp_extract(url, '://[^?#]*\?([^#]*)', 1), '') as query
  from pages
), c as (
  select *, case when contains(url, '://') then regexp_replace(host, '^(www|m)\.', '') || regexp_replace(path, '/+$', '') || '?' ||
    array_to_string(list_sort(list_filter(string_split(query, '&'), lambda x: x <> '' and not starts_with(x, 'utm_') and not starts_with(x, 'ref='))), '&') end as canonical
  from p
), listed as (
  select distinct canonical from c where regexp_matches(host, 'bets|casino|pills|spam') and contains(url, '://')
), rules(verdict, h, p) as (
  values ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')
), best as (
  select c.page_id, c.url, arg_max(h || r.p, length(h || r.p)) as rule, arg_max(r.verdict, length(h || r.p)) as verdict
  from (select distinct page_id, url, host, path from c) c join rules r on (c.host = h or ends_with(c.host, '.' || h)) and starts_with(c.path, r.p) group by 1, 2
)
select c.page_id, c.host, c.path, b.rule, coalesce(b.verdict, case when l.canonical is not null then 'block' else 'allow' end) as verdict, c.canonical
from c left join best b on b.page_id = c.page_id and b.url = c.url left join listed l on l.canonical = c.canonical
"""
