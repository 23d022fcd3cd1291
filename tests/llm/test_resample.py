"""Importance resampling against its definition."""

from __future__ import annotations

import random

import numpy as np

from corvane.llm import resample
from tests.llm import brute
from tests.llm.test_operators import SF, awkward, empty


def as_rows(df):
    return sorted((r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in df.collect())


def test_rows_by_definition(spark):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    plain = brute.resampled([(r.doc_id, r.text) for r in docs.collect()], [r.text for r in bench.collect()])
    assert as_rows(resample.resample(docs, bench)) == plain
    # few buckets, wide runs: what collides is added up
    few = resample.resample(docs, bench, buckets=50, width=3, percent=100)
    assert few.where("rank is not null").count() == few.where("n_words >= 20").count()


def test_awkward_rows(spark):
    bench = spark.createDataFrame([("W1 w2 w3", 1), (None, 2), ("", 3), ("w1", None)], "text string, weight int")
    docs = awkward(spark).dropDuplicates()
    clashing = docs.withColumnsRenamed({"lang": "digest", "source": "rank", "n_chars": "copies"})
    plain = brute.resampled([(r.doc_id, r.text) for r in docs.collect() if r.doc_id is not None], ["W1 w2 w3", None, "", "w1"])
    assert as_rows(resample.resample(clashing, bench)) == plain
    drawn = {r[0] for r in plain if r[4]}
    got = resample.drawn_documents(clashing, bench)
    assert got.columns == clashing.columns and {r.doc_id for r in got.collect()} == drawn and drawn
    assert resample.resample(empty(spark), bench).count() == 0
    assert as_rows(resample.resample(docs, bench.limit(0))) == brute.resampled([(r.doc_id, r.text) for r in docs.collect() if r.doc_id is not None], [])


def test_copies_count_as_often_as_they_are(spark):
    rng = random.Random(1)
    texts = [" ".join(rng.choice(["alpha", "beta", "gamma", "delta", "über"]) for _ in range(30)) for _ in range(4)]
    rows = [(i, texts[0] if i % 3 == 0 else texts[i % 4]) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    bench = spark.createDataFrame([("alpha beta",)], "text string")
    assert resample.distinct_texts(docs).count() == 4
    assert resample.bucket_counts(resample.distinct_texts(docs)).sum() == 200 * 59
    assert as_rows(resample.resample(docs, bench)) == brute.resampled(rows, ["alpha beta"])
    assert as_rows(resample.resample(docs.coalesce(1), bench)) == as_rows(resample.resample(docs, bench))


def test_draws_follow_the_target(spark):
    """Documents in the target's words are drawn far more often than others of the same length."""
    rng = random.Random(2)
    mine, other = [f"m{i}" for i in range(40)], [f"o{i}" for i in range(40)]
    rows = [(i, " ".join(rng.choice(mine if i % 4 == 0 else other) for _ in range(40))) for i in range(400)]
    bench = spark.createDataFrame([(" ".join(mine * 50),)], "text string")
    out = resample.resample(spark.createDataFrame(rows, "doc_id long, text string"), bench, width=1, buckets=5000).collect()
    drawn = [r.doc_id for r in out if r["rank"]]
    assert len(drawn) == 100 and sum(d % 4 == 0 for d in drawn) > 80
    assert sorted(r["rank"] for r in out if r["rank"]) == list(range(1, 101))


def test_gains_are_rounded_down():
    g = resample.gains(np.array([0, 9, 99]), np.array([5, 0, 0]))
    assert g.tolist() == [4421, 327, -1976]
