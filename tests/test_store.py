"""The bucketed store, the stored index, proximity, and hub documents."""

import os
import random
import re

import pytest
from pyspark.sql import functions as F

from corpusgraph.operators import catalog, search
from corpusgraph.operators.store import CorpusStore
from corpusgraph.operators.textindex import TextIndex


def names(store, table):
    """The data files of each bucket."""
    out = {}
    for folder, _, found in os.walk(f"{store.path}/{table}"):
        out[os.path.basename(folder)] = sorted(f for f in found if f.endswith(".parquet"))
    return {k: v for k, v in out.items() if k.startswith("bucket=")}


def bucket(spark, ids, n):
    from corpusgraph.sources.lookup import bucket_of

    rows = spark.createDataFrame([(i,) for i in ids], "id string").select("id", bucket_of("id", n).alias("b")).collect()
    return {r["id"]: r["b"] for r in rows}


@pytest.fixture
def store(spark, tmp_path):
    docs = [(f"d{i}", f"t{i}", f"text {i}") for i in range(60)]
    edges = [(f"d{i}", f"d{j}", "references", 0.5) for i in range(60) for j in ((i * 7 + 1) % 60, (i * 3 + 2) % 60)]
    s = CorpusStore(spark, f"{tmp_path}/store", 16)
    s.create({
        "documents": spark.createDataFrame(docs, "id string, title string, content string"),
        "chunks": spark.createDataFrame([(f"d{i}", k, f"c{i}{k}") for i in range(60) for k in range(2)], "document_id string, chunk_index int, content string"),
        "document_tags": spark.createDataFrame([(f"d{i}", f"g{i % 3}") for i in range(60)], "document_id string, tag string"),
        "document_relations": spark.createDataFrame(edges, "source_id string, target_id string, relation_type string, confidence double"),
    })
    s.edges = {(a, b) for a, b, _, _ in edges}
    return s


def pairs(df):
    return sorted((r["source_id"], r["target_id"]) for r in df.select("source_id", "target_id").collect())


def test_delete_touches_its_buckets_alone(spark, store):
    before = {t: names(store, t) for t in ("documents", "chunks", "document_tags", "document_relations")}
    gone = ["d5", "d17"]
    store.delete(spark.createDataFrame([(i,) for i in gone], "id string"))
    assert {r["id"] for r in store.read("documents").collect()} == {f"d{i}" for i in range(60)} - set(gone)
    assert store.read("chunks").where(F.col("document_id").isin(*gone)).count() == 0 and store.read("chunks").count() == 116
    want = sorted(e for e in store.edges if e[0] not in gone and e[1] not in gone)
    assert sorted(set(pairs(store.read("document_relations")))) == want == sorted(set(pairs(store.read("relations_by_target"))))
    own = set(bucket(spark, gone, 16).values())
    ends = set(bucket(spark, [a for a, b in store.edges if a in gone or b in gone], 16).values())
    for t in before:
        changed = {int(b.split("=")[1]) for b, f in names(store, t).items() if before[t].get(b) != f}
        assert changed == (ends if t == "document_relations" else own), t
    store.delete(spark.createDataFrame([(i,) for i in gone], "id string"))  # again: nothing more goes
    assert sorted(set(pairs(store.read("document_relations")))) == want


def test_emptied_buckets_and_tables(spark, store):
    store.delete(store.read("documents").select("id"))
    for t in ("documents", "chunks", "document_tags", "document_relations", "relations_by_target"):
        assert store.read(t).count() == 0
    store.upsert({"documents": spark.createDataFrame([("x", "t", "c")], "id string, title string, content string")})
    assert [r["id"] for r in store.read("documents").collect()] == ["x"]


def test_file_that_comes_again_is_replaced(spark, store):
    before = names(store, "documents")
    new = {
        "documents": spark.createDataFrame([("d3", "new", "new text"), ("e1", "first", "x")], "id string, title string, content string"),
        "chunks": spark.createDataFrame([("d3", 0, "one")], "document_id string, chunk_index int, content string"),
        "document_tags": spark.createDataFrame([("d3", "fresh")], "document_id string, tag string"),
        "document_relations": spark.createDataFrame([("d3", "e1", "references", 0.9)], "source_id string, target_id string, relation_type string, confidence double"),
    }
    for _ in range(2):  # a change that is made again changes nothing
        store.upsert(new)
        docs = {r["id"]: r["title"] for r in store.read("documents").collect()}
        assert docs["d3"] == "new" and docs["e1"] == "first" and len(docs) == 61 and store.read("documents").count() == 61
        assert [(r["chunk_index"], r["content"]) for r in store.read("chunks").where("document_id = 'd3'").collect()] == [(0, "one")]
        assert [r["tag"] for r in store.read("document_tags").where("document_id = 'd3'").collect()] == ["fresh"]
        want = sorted({e for e in store.edges if e[0] != "d3"} | {("d3", "e1")})
        assert sorted(set(pairs(store.read("document_relations")))) == want == sorted(set(pairs(store.read("relations_by_target"))))
    touched = set(bucket(spark, ["d3", "e1"], 16).values())
    assert {int(b.split("=")[1]) for b, f in names(store, "documents").items() if before.get(b) != f} == touched


def test_patches(spark, store):
    before = names(store, "documents")
    patches = spark.createDataFrame([("d1", "T", None, ["a", "a"]), ("d2", None, "C", []), ("d4", None, None, None), ("none", "x", "y", ["z"])], "id string, title string, content string, tags array<string>")
    store.patch(patches)
    docs = {r["id"]: (r["title"], r["content"]) for r in store.read("documents").collect()}
    assert (docs["d1"], docs["d2"], docs["d4"], len(docs)) == (("T", "text 1"), ("t2", "C"), ("t4", "text 4"), 60)
    tags = {}
    for r in store.read("document_tags").collect():
        tags.setdefault(r["document_id"], []).append(r["tag"])
    assert tags["d1"] == ["a"] and "d2" not in tags and tags["d4"] == ["g1"] and "none" not in tags and len(tags) == 59
    touched = set(bucket(spark, ["d1", "d2", "d4", "none"], 16).values())
    assert {int(b.split("=")[1]) for b, f in names(store, "documents").items() if before.get(b) != f} <= touched


def test_the_time_of_the_first_version_stays(spark, tmp_path):
    kind = "id string, title string, created_at timestamp"
    day = lambda n: f"2024-01-0{n} 00:00:00"
    rows = lambda *r: spark.createDataFrame(list(r), "id string, title string, t string").select("id", "title", F.col("t").cast("timestamp").alias("created_at"))
    s = CorpusStore(spark, f"{tmp_path}/dated", 4)
    s.create({"documents": rows(("a", "x", day(1)), ("b", "y", day(2)))})
    assert [f"{f.name} {f.dataType.simpleString()}" for f in s.read("documents").schema] == kind.split(", ")
    s.upsert({"documents": rows(("a", "new", day(3)), ("c", "z", day(3)))})
    assert {r["id"]: (r["title"], str(r["created_at"])) for r in s.read("documents").collect()} == {"a": ("new", day(1)), "b": ("y", day(2)), "c": ("z", day(3))}


WORDS = "rain pump tank valve flow gauge".split()


def width(words, need):
    """The smallest window with all of need, by trying each."""
    return min(b - a + 1 for a in range(len(words)) for b in range(a, len(words)) if set(need) <= set(words[a : b + 1]))


def test_index_answers_batches_without_texts(spark, tmp_path):
    rng = random.Random(3)
    texts = {f"x{i}": [rng.choice(WORDS) for _ in range(rng.randrange(25))] for i in range(80)}
    docs = spark.createDataFrame([(i, "" if n % 2 else None, (" - ".join(t) if t else None), "note") for n, (i, t) in enumerate(texts.items())], "id string, title string, content string, doc_type string")
    index = TextIndex.build(docs, f"{tmp_path}/index", buckets=4)
    asked = [(1, "Rain, PUMP!"), (2, "gauge"), (3, "tank tank valve flow"), (4, "?"), (5, "rain absent")]
    queries = spark.createDataFrame(asked, "query_id int, query string")
    again = TextIndex(spark, f"{tmp_path}/index", buckets=4)  # opened anew
    key = lambda r: (r["query_id"], r["rank"], r["document_id"], round(r["score"], 9))
    want = sorted(map(key, search.fulltext_search(docs, queries, 100).collect()))
    assert sorted(map(key, index.search(queries, 100).collect())) == want
    assert sorted(map(key, again.search(queries.where("query_id < 3"), 100).unionByName(again.search(queries.where("query_id >= 3"), 100)).collect())) == want
    near = index.search_near(queries, 100).collect()
    assert {(r["query_id"], r["document_id"]) for r in near} == {(q, d) for q, _, d, _ in want}
    score = {(q, d): s for q, _, d, s in want}
    for r in near:
        need = set(re.findall(r"\w+", dict(asked)[r["query_id"]].lower()))
        assert r["width"] == width(texts[r["document_id"]], need)
        assert r["score"] == pytest.approx(score[r["query_id"], r["document_id"]] * len(need) / r["width"])
    for q in (1, 3):
        ranked = sorted(((-round(r["score"], 9), r["document_id"]), r["rank"]) for r in near if r["query_id"] == q)
        assert [n for _, n in ranked] == list(range(1, len(ranked) + 1))
    some = docs.where("id in ('x1', 'x2', 'x3', 'x5')")
    assert sorted(map(key, index.search(queries, 5, some).collect())) == sorted(map(key, search.fulltext_search(some, queries, 5).collect()))
    none = TextIndex.build(docs.where("1 = 0"), f"{tmp_path}/none")
    assert none.search(queries, 5).count() == none.search_near(queries, 5).count() == 0


def test_hub_is_listed_in_part_and_paged_whole(spark):
    n = 50_000
    docs = spark.range(n).select(F.concat(F.lit("d"), "id").alias("id"), F.format_string("t%06d", "id").alias("title"), F.lit("note").alias("doc_type"), F.lit("c").alias("content"))
    edges = spark.range(1, n).select(F.lit("d0").alias("source_id"), F.concat(F.lit("d"), "id").alias("target_id"), F.lit("references").alias("relation_type"), F.lit(None).cast("string").alias("description"), (F.col("id") % 7 / 7.0).alias("confidence"))
    none = spark.createDataFrame([], "document_id string, tag string")
    details = catalog.document_details(docs, none, edges, most=50)
    plan = details._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan  # only the first rows of a document leave the tasks that read them
    hub = details.where("id = 'd0'").first()
    assert [r["other_title"] for r in hub["relations"]] == [f"t{i:06d}" for i in range(1, 51)]
    chunks = spark.createDataFrame([], "document_id string, chunk_index int, content string, token_count int, metadata struct<type:string>")
    report = catalog.ingest_report(docs, chunks, edges, most=10).where("id in ('d0', 'd5')").orderBy("id").collect()
    assert [(r["relations_count"], len(r["relations"])) for r in report] == [(n - 1, 10), (1, 1)]
    pages = catalog.relation_pages(edges, docs, size=1000).where("document_id = 'd0'")
    sizes = {r["page"]: r["count"] for r in pages.groupBy("page").count().collect()}
    assert sizes == {p: 1000 if p < 49 else 999 for p in range(50)}
    third = pages.where("page = 3").orderBy("place").collect()
    assert [r["place"] for r in third] == list(range(3000, 4000)) and [r["other_title"] for r in third] == [f"t{i:06d}" for i in range(3001, 4001)]


def _hub(spark, n):
    """Documents d0 to dn-1, and relations of d0 with all the others."""
    docs = spark.range(n).select(F.concat(F.lit("d"), "id").alias("id"), F.format_string("t%06d", "id").alias("title"), F.lit("source_code").alias("doc_type"), F.lit("c").alias("content"))
    edges = spark.range(1, n).select(F.lit("d0").alias("source_id"), F.concat(F.lit("d"), "id").alias("target_id"), F.lit("references").alias("relation_type"), F.lit(None).cast("string").alias("description"), (F.col("id") % 7 / 7.0).alias("confidence"))
    return docs, edges


def test_details_of_hub_are_whole(spark):
    docs, edges = _hub(spark, 2501)
    hub = catalog.document_details(docs, spark.createDataFrame([], "document_id string, tag string"), edges).where("id = 'd0'").first()
    assert [r["other_title"] for r in hub["relations"]] == [f"t{i:06d}" for i in range(1, 2501)]


def test_code_context_of_hub_is_whole(spark):
    docs, edges = _hub(spark, 2501)
    lookups = spark.createDataFrame([(1, "t000000", None)], "lookup_id int, file_path string, symbol string")
    assert [len(r["related"]) for r in catalog.code_context(docs, edges, lookups).collect()] == [2500]


def test_report_of_hub_is_whole(spark):
    docs, edges = _hub(spark, 2501)
    chunks = spark.createDataFrame([], "document_id string, chunk_index int, content string, token_count int, metadata struct<type:string>")
    hub = catalog.ingest_report(docs, chunks, edges).where("id = 'd0'").first()
    assert (hub["relations_count"], len(hub["relations"])) == (2500, 2500)
