"""The rule ensemble against plain statistics and rules, and its scores on held-out documents."""

from __future__ import annotations

import math
import re
import unicodedata
import zlib

import pytest
from pyspark.sql import functions as F

from corvane.llm import quality
from corvane.llm.queries import op11_quality_rules
from tests.llm.test_operators import awkward, empty

FOREST = """RandomForestClassificationModel: uid=x, numTrees=2, numClasses=2, numFeatures=13
  Tree 0 (weight 1.0):
    If (feature 0 <= 5.5)
     If (feature 0 <= 2.0E-5)
      Predict: 0.0
     Else (feature 0 > 2.0E-5)
      Predict: 1.0
    Else (feature 0 > 5.5)
     Predict: 1.0
  Tree 1 (weight 1.0):
    If (feature 7 <= 0.25)
     Predict: 1.0
    Else (feature 7 > 0.25)
     Predict: 0.0
"""


def plain_statistics(text):
    text = text or ""
    words, lines = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w], [x for x in text.split("\n") if x]
    kind = lambda c: unicodedata.category(c)
    letters = sum(kind(c)[0] == "L" for c in text)
    share = lambda n, whole: n / max(1, whole)
    signs = sum(kind(c)[0] not in "LN" and c not in " \t\n\x0b\f\r" and c not in ".,;:!?'\"()’“”«»¿¡…–-" for c in text)
    return {
        "chars": math.log1p(len(text)), "words": math.log1p(len(words)), "word_length": share(len(text), len(words)), "line_length": math.log1p(share(len(text), len(lines))),
        "letters": share(letters, len(text)), "capitals": share(sum(kind(c) == "Lu" for c in text), letters), "digits": share(sum(kind(c)[0] == "N" for c in text), len(text)), "signs": share(signs, len(text)),
        "exclamations": share(text.count("!"), len(words)), "stops": share(len(re.findall(r"[.!?](?=[ \t\n\x0b\f\r]|$)", text)), len(words)), "short_words": share(sum(len(w) <= 3 for w in words), len(words)),
        "distinct_words": share(len(set(words)), len(words)), "distinct_lines": share(len(set(lines)), len(lines)),
    }


def test_statistics(spark):
    docs = awkward(spark).select("doc_id", "text").unionByName(spark.createDataFrame([(90, "Ünï «Ça» 12½ ### a|b!! x.\n\nÜnï «Ça»\ta"), (91, "漢字。漢字   😀 …")], "doc_id long, text string"))
    for r in quality.with_statistics(docs.withColumn("statistics", F.lit(1))).collect():
        want = plain_statistics(r.text)
        assert list(want) == list(quality.NAMES) and r.statistics.asDict() == pytest.approx(want), r.doc_id


def test_paths_become_rules(spark):
    rules = quality.paths_of(FOREST)
    n = quality.NAMES
    assert rules == {((n[0], False, 5.5),), ((n[0], False, 2e-5),), ((n[0], False, 5.5), (n[0], True, 2e-5)), ((n[0], True, 5.5),), ((n[7], False, 0.25),), ((n[7], True, 0.25),)}
    ensemble = quality.Ensemble(tuple((r, 0.5 + i) for i, r in enumerate(sorted(rules))), -1.5)
    docs = awkward(spark).select("doc_id", F.col("text"), F.lit(3).alias("score"), F.lit("x").alias("predicted"))
    for r in quality.classify(docs, ensemble).collect():
        s = plain_statistics(r.text)
        total = -1.5 + sum(w for rule, w in ensemble.rules if all((s[c] > x) == above for c, above, x in rule))
        assert r.score == pytest.approx(1 / (1 + math.exp(-total))) and r.predicted == int(r.score >= 0.3)


def test_few_labels(spark):
    rows = quality.with_statistics(awkward(spark).select("doc_id", "text"))
    labels = lambda *x: spark.createDataFrame(list(x), "doc_id long, quality int")
    assert quality.learn(rows, labels()) == quality.Ensemble((), 0.0)
    one = quality.learn(rows, labels((1, 1), (2, 1), (None, 0), (3, None), (4, 7)))
    assert one.rules == () and one.bias == pytest.approx(math.log(3))
    assert {round(r.score, 6) for r in quality.score(rows, one).collect()} == {0.75}
    assert quality.learn(quality.with_statistics(empty(spark)), labels((1, 0), (2, 1))).rules == ()
    assert quality.classify(empty(spark), one).count() == 0


def test_held_out_documents(spark):
    folder = "/root/testdata/sf0.01"
    out = op11_quality_rules(spark, folder).collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    assert {r.doc_id for r in out} == set(docs) and len(out) == len(docs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in out)
    judged = [(r.score, r.predicted, labels[r.doc_id]) for r in out if r.held_out and r.doc_id in labels]
    good, bad = [x for x in judged if x[2]], [x for x in judged if not x[2]]
    assert sum(p for _, p, _ in good) >= 0.95 * len(good) and sum(p for _, p, _ in bad) <= 0.2 * len(bad)
    assert sum(g[0] > b[0] for g in good for b in bad) >= 0.95 * len(good) * len(bad)
    by_text = {}
    for r in out:
        assert by_text.setdefault(docs[r.doc_id], r.score) == r.score
