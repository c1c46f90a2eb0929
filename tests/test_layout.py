"""The bucketed layout, and how a scan deals files to tasks."""

from statistics import median

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusgraph.operators import catalog, embed
from corpusgraph.sources import files


@pytest.fixture
def small_joins_shuffle(spark):
    """No broadcast, so that a join by document would have to move rows."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_bucketed_tables_need_no_exchange(spark, tmp_path, small_joins_shuffle):
    rng = np.random.default_rng(2)
    docs = spark.createDataFrame([(f"d{i}", f"t{i}", "note", "x") for i in range(40)], "id string, title string, doc_type string, content string")
    chunks = spark.createDataFrame([(f"d{i % 40}", i // 40, [float(x) for x in rng.standard_normal(4)]) for i in range(160)], "document_id string, chunk_index int, embedding array<float>")
    files.write_bucketed({"documents": docs, "chunks": chunks}, f"{tmp_path}/t", "layout", 4)
    got = files.open_bucketed(spark, f"{tmp_path}/t", "layout", ["documents", "chunks"], 4)
    joined = got["chunks"].join(got["documents"], F.col("document_id") == F.col("id"))
    for df in (joined, embed.document_vectors(got["chunks"]), got["chunks"].groupBy("document_id").count()):
        assert "Exchange" not in plan(df)
    assert "Exchange" in plan(chunks.join(docs, F.col("document_id") == F.col("id")))
    assert joined.count() == 160
    want = {r["document_id"]: r["vector"] for r in embed.document_vectors(chunks).collect()}
    assert {r["document_id"]: pytest.approx(r["vector"]) for r in embed.document_vectors(got["chunks"]).collect()} == want
    spark.sql("drop table layout_chunks")  # as in another session: the table's files stay
    again = files.open_bucketed(spark, f"{tmp_path}/t", "layout", ["chunks"], 4)["chunks"]
    assert again.count() == 160 and "Exchange" not in plan(again.groupBy("document_id").count())
    report = catalog.ingest_report(got["documents"], chunks.withColumns({"content": F.lit("c"), "token_count": F.lit(1), "metadata": F.struct(F.lit("text").alias("type"))}), spark.createDataFrame([], "source_id string, target_id string, relation_type string, description string, confidence double"))
    assert report.count() == 40


def test_files_are_dealt_by_size(spark, tmp_path):
    """A few large files among many small ones: no task gets twice the median bytes of the tasks."""
    rng = np.random.default_rng(3)
    for i, size in enumerate([1_000_000] * 12 + [2_000] * 400):
        (tmp_path / f"f{i}.txt").write_bytes(bytes(rng.integers(97, 123, size, dtype=np.uint8)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", 1_200_000)
    spark.conf.set("spark.sql.files.openCostInBytes", 1_000)
    try:
        scanned = files.scan_files(spark, str(tmp_path))
        per_task = [r["b"] for r in scanned.groupBy(F.spark_partition_id().alias("t")).agg(F.sum("length").alias("b")).collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old[0])
        spark.conf.set("spark.sql.files.openCostInBytes", old[1])
    assert len(per_task) >= 10 and max(per_task) <= 2 * median(per_task)
