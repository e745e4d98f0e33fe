import zlib

import pytest
from pyspark.sql import functions as F

from placeloom.llm import quality, queries

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def scores(spark):
    return {r.doc_id: r for r in queries.op5_quality(spark, SF).collect()}


def test_held_out_accuracy(spark, scores):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    held = [(labels[i], r) for i, r in scores.items() if r.held_out and i in labels]
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r.score <= 1 for i, r in scores.items())
    right = sum((r.score >= 0.5) == y for y, r in held) / len(held)
    pairs = [(g.score > b.score) + (g.score == b.score) / 2 for y, g in held if y for z, b in held if not z]
    assert right >= 0.9 and sum(pairs) / len(pairs) >= 0.95
    assert len(scores) == spark.read.parquet(f"{SF}/documents.parquet").count()


def test_labels_of_the_held_out_fold_are_not_used(spark, scores):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    turned = labels.withColumn("quality", F.when(queries.fold() == 1, 1 - F.col("quality")).otherwise(F.col("quality")).cast("int"))
    a = quality.fit(docs, labels, use=queries.fold() != 1)
    assert a == quality.fit(docs, turned, use=queries.fold() != 1)


def test_odd_rows(spark):
    rows = [(1, None, 5.0), (1, None, 5.0), (2, "", 1.0), (3, "é" * 50000, 0.0), (None, "x", 0.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, Score double")
    none = quality.fit(docs, spark.createDataFrame([], "doc_id long, quality int"))
    got = quality.scored(docs, none).collect()
    assert len(got) == 5 and {r.score for r in got} == {0.5}
    one = quality.fit(docs, spark.createDataFrame([(1, 1), (2, 1), (2, 0), (None, 1), (3, None)], "doc_id long, quality int"))
    kept = quality.keep_good(docs, one)
    assert kept.columns == docs.columns and kept.count() == 5
    both = quality.fit(docs, spark.createDataFrame([(i, i % 2) for i in range(1, 4)], "doc_id long, quality int"))
    assert quality.scored(docs, both).count() == 5 and quality.scored(docs.limit(0), both).count() == 0
