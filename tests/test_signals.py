"""Pitch, alignment of texts, phrases, bootstrap draws and extremes of cosines against plain versions."""

from __future__ import annotations

import math
import random
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.functions import arrays
from corvane.functions.text import Phrases, count_edits, count_edits_by_bits, edit_operations, normalize
from corvane.operators import audio, metrics

RATE = arrays.SAMPLE_RATE


def test_pitch_of_tones():
    t = np.arange(RATE) / RATE
    for f in range(65, 396, 11):
        for wave in (np.sin(2 * np.pi * f * t), sum(np.sin(2 * np.pi * f * k * t + k) / k for k in range(1, 6)), np.sign(np.sin(2 * np.pi * f * t + 0.3))):
            assert abs(np.median(arrays.pitches(0.3 * wave)) - f) < 1
    sweep = np.sin(2 * np.pi * np.cumsum(np.linspace(150, 180, RATE)) / RATE)
    frames = arrays.pitches(sweep)[3:-3]
    assert np.abs(frames - np.interp(np.arange(3, 3 + len(frames)) * 512, np.arange(RATE), np.linspace(150, 180, RATE))).max() < 2


def test_difference_by_transform_is_the_difference():
    """Without the transform: squared differences at every lag, over the first frame."""
    rng = np.random.default_rng(0)
    x = rng.normal(size=4096)
    padded = np.pad(x, 1024)
    frame = padded[512 * 2 : 512 * 2 + 2048]
    d = np.array([((frame[:1024] - frame[k : k + 1024]) ** 2).sum() for k in range(0, 268)])
    shape = d[40:268] / (np.cumsum(d[1:])[39:] / np.arange(40, 268))
    best = int(np.argmin(shape)) if not ((shape[1:-1] < 0.1) & (shape[1:-1] < shape[:-2])).any() else None
    found = RATE / arrays.pitches(x)[2]
    assert best is None or abs(found - (40 + best)) <= 1


def test_median_pitch_and_stability(spark):
    t = np.arange(8000) / RATE
    voices = {"a": (110, 112, 114), "b": (220, 220, 226), "c": (300,)}
    rows = [(v, (0.2 * np.sin(2 * np.pi * f * t)).tolist()) for v, fs in voices.items() for f in fs]
    rng = np.random.default_rng(3)
    mixed = np.concatenate([rng.normal(0, 1e-4, 800), 0.3 * np.sin(2 * np.pi * 150 * t)])
    table = spark.createDataFrame([*rows, ("d", None), ("e", []), ("f", mixed.tolist()), ("g", [0.0] * 4000)], "voice string, signal array<double>")
    got = table.select("voice", arrays.median_pitch("signal").alias("pitch")).collect()
    pitch = {r.voice: r.pitch for r in got}
    assert pitch["d"] is None and pitch["e"] is None and abs(pitch["f"] - 150) < 1 and pitch["g"] is None
    out = audio.identity_stability(spark.createDataFrame(got, "voice string, pitch double"), "voice", "pitch").first()
    means = [112, 222]
    assert out.n == 2 and abs(out.spread_of_means - np.std(means)) < 0.5 and abs(out.mean_spread - np.mean([np.std(voices[v]) for v in "ab"])) < 0.2
    none = audio.identity_stability(spark.createDataFrame([], "voice string, pitch double"), "voice", "pitch").first()
    assert (none.n, none.mean_spread, none.ratio) == (0, None, None)


def test_edits_by_bits():
    rng = random.Random(0)
    for _ in range(1500):
        signs = rng.choice(["ab", "abc", "aé漢😀b", "abcdefghij"])
        a = "".join(rng.choice(signs) for _ in range(rng.randrange(0, 40)))
        b = list(a)
        for _ in range(rng.randrange(9)):
            if b and rng.random() < 0.6:
                b.pop(rng.randrange(len(b)))
            else:
                b.insert(rng.randrange(len(b) + 1), rng.choice(signs))
        b = "".join(b) if rng.random() < 0.6 else "".join(rng.choice(signs) for _ in range(rng.randrange(0, 40)))
        for kept in (1, 3, 512):
            assert count_edits_by_bits(a, b, kept) == count_edits(a, b)


def test_columns_are_made_once():
    """Texts whose whole table has few bits are not gone over again on the way back, however many columns they have."""
    rng, made = random.Random(5), []
    a, b = ("".join(rng.choice("abcdefgh") for _ in range(1600)) for _ in range(2))
    sys.setprofile(lambda frame, event, _: made.append(1) if event == "call" and frame.f_code.co_name == "columns" else None)
    try:
        found = count_edits_by_bits(a, b)
    finally:
        sys.setprofile(None)
    assert len(made) == 1 and found == count_edits_by_bits(a, b, 100)


def test_edits_of_long_texts(spark):
    rng = random.Random(1)
    a = "".join(rng.choice("abcdéfghij") for _ in range(5000))
    b = "".join(c for c in a if rng.random() > 0.1)
    d, s, x, i = count_edits_by_bits(a, b)
    assert d == s + x + i and x - i == len(a) - len(b)
    rows = spark.createDataFrame([(a, b), (None, "x"), ("x", None), ("", "")], "a string, b string").select(edit_operations("a", "b").alias("e"), F.levenshtein("a", "b").alias("d")).collect()
    assert rows[0].e.distance == rows[0].d == d and tuple(rows[1].e) == (1, 0, 0, 1) and tuple(rows[2].e) == (1, 0, 1, 0)


def test_phrases(spark):
    table = {"頭": "头", "髮": "发", "發": "发", "頭髮": "头发", "乾": "干", "乾隆": "乾隆", "隆": "隆", "皇帝頭": "X", "": "never"}
    trie = Phrases(table)

    def plain(text):
        out, i = "", 0
        while i < len(text):
            n = next((n for n in range(len(text) - i, 0, -1) if text[i : i + n] in table), 0)
            out, i = out + (table[text[i : i + n]] if n else text[i]), i + max(1, n)
        return out

    rng = random.Random(5)
    for _ in range(400):
        text = "".join(rng.choice("頭髮發乾隆皇帝ab") for _ in range(rng.randrange(12)))
        assert trie.convert(text) == plain(text)
    assert trie.convert("乾隆皇帝頭髮乾") == "乾隆X发干" and trie.convert(None) is None and Phrases({}).convert("頭") == "頭"
    rows = spark.createDataFrame([("頭髮 ABC",), (None,)], "t string")
    assert [r[0] for r in rows.select(normalize(F.col("t"), simplified=table, traditional_to_simplified=True)).collect()] == ["头发abc", ""]
    with pytest.raises(ValueError):
        normalize(F.col("t"), traditional_to_simplified=True)


def systems(spark, n=300, seed=2):
    rng = random.Random(seed)
    rows = [(f"u{i}", rng.randrange(5), rng.randrange(6), rng.randrange(0, 9)) for i in range(n)]
    return rows, spark.createDataFrame(rows, "utt_id string, distance_a long, distance_b long, reference_length int")


def test_draws_add_up(spark):
    rows, pairs = systems(spark)
    one = {tuple(r) for r in metrics.multinomial_sums(pairs, 150, parts=16).collect()}
    assert {r[4] for r in one} == {len(rows)} and len(one) == 150
    assert {tuple(r) for r in metrics.multinomial_sums(pairs.repartition(7), 150, parts=16).collect()} == one
    # what replicates draw has the mean and the spread of n of n draws
    sums = np.array([r[3] for r in sorted(metrics.multinomial_sums(pairs, 2000, parts=16).collect())])
    lengths = np.array([r[3] for r in rows])
    assert abs(sums.mean() - lengths.sum()) < 4 * lengths.std() * math.sqrt(len(rows) / 2000) and 0.9 < sums.std() / (lengths.std() * math.sqrt(len(rows))) < 1.1


def test_significance_report(spark):
    rows, pairs = systems(spark)
    r = metrics.significance_report(pairs, top=5, replicates=300).first()
    scored = [x for x in rows if x[3]]
    assert r.n == len(scored) and abs(r.diff - (sum(x[1] for x in scored) - sum(x[2] for x in scored)) / sum(x[3] for x in scored)) < 1e-12 and r.low <= r.diff <= r.high
    want = sorted(((x[1] - x[2]) / x[3], x[0]) for x in scored if x[1] != x[2])
    assert [d.utt_id for d in r.disagreements] == [u for _, u in sorted(want, key=lambda x: (-abs(x[0]), x[1]))[:5]]
    same = metrics.bootstrap(pairs.withColumn("distance_b", F.col("distance_a")), 100).first()
    assert not same.significant and same.p_value == 1.0
    with pytest.raises(ValueError):
        metrics.bootstrap(pairs.limit(0), 10)


def plain_extremes(rows):
    out = {}
    for i, (_, a, x) in enumerate(rows):
        for _, b, y in rows[i + 1 :]:
            c = float(np.dot(x, y) / np.linalg.norm(x) / np.linalg.norm(y))
            for label in {a, b}:
                low, high = out.get(label, (2.0, -2.0))
                out[label] = (min(low, c), high) if a == b else (low, max(high, c))
    return out


@pytest.mark.parametrize("spread", [0.05, 3.0])
def test_extremes_by_bounds(spark, spread):
    rng = np.random.default_rng(6)
    centers = rng.normal(size=(6, 12))
    rows = [(i, f"l{i % 6}", (centers[i % 6] + spread * rng.normal(size=12)).tolist()) for i in range(240)] + [(900, "lone", rng.normal(size=12).tolist())]
    want = plain_extremes(rows)
    table = spark.createDataFrame([*rows, (901, "l1", [0.0] * 12), (902, None, [1.0] * 12), (903, "zero", [0.0] * 12)], "id long, label string, v array<double>")
    got = {r.label: r for r in arrays.separability(table, "id", "label", "v", block_rows=16).collect()}
    assert set(got) == {None, *want}
    for label, (low, high) in want.items():
        assert (got[label].min_within is None) == (low == 2.0) and (low == 2.0 or abs(got[label].min_within - low) < 1e-9) and abs(got[label].max_between - high) < 1e-9
    units = table.where("label is not null and id < 901").select(F.col("id").cast("string").alias("id"), "label", F.transform("v", lambda x: x / F.sqrt(arrays.dot(F.col("v"), F.col("v")))).alias("v"))
    _, compared, there = arrays.extremes(units, 16)
    assert compared < 0.5 * there if spread < 1 else compared <= there
    assert arrays.separability(table.where("id = 903"), "id", "label", "v").count() == 1


def test_extremes_send_blocks_to_groups(spark):
    """What the comparison shuffles grows as the rows do, though nearly all pairs of blocks are compared."""
    context, threshold = spark.sparkContext._jsc.sc(), "spark.sql.autoBroadcastJoinThreshold"

    def shuffled() -> int:
        context.listenerBus().waitUntilEmpty()
        return context.statusStore().executorList(True).apply(0).totalShuffleWrite()

    rng, grown = np.random.default_rng(7), []
    spark.conf.set(threshold, -1)
    try:
        for n in 800, 3200:
            made = rng.normal(size=(n, 32))
            units = spark.createDataFrame([(str(i), "ab"[i % 2], (v / np.linalg.norm(v)).tolist()) for i, v in enumerate(made)], "id string, label string, v array<double>")
            before = shuffled()
            arrays.extremes(units, 16)[0].collect()
            grown.append(shuffled() - before)
    finally:
        spark.conf.unset(threshold)
    assert grown[1] < 5 * grown[0]


def test_near_queries(spark):
    """Cosines by blocks, bit for bit those of cosine(), also of zero, null, infinite and shorter vectors."""
    draw = random.Random(8)
    rows = [(i, [draw.gauss(0, 1) + (i % 3) for _ in range(7)]) for i in range(300)]
    rows += [(300, [0.0] * 7), (301, None), (302, [1.0, None] + [1.0] * 5), (303, [float("inf")] + [1.0] * 6), (304, [1e200] * 7), (305, [1e-9] * 7), (306, [1.0] * 3), (307, []), (400, [float("nan")] * 7), (None, [1.0] * 7), (500, [1.0] * 3)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    queries = table.where("vec_id % 20 = 0")
    both = queries.toDF("query_id", "query").join(table, F.col("query_id") != F.col("vec_id"))
    want = both.select("query_id", "vec_id", arrays.cosine(F.col("query"), F.col("embedding")).alias("cosine")).where("cosine >= 0.3")
    for sizes in {}, {"query_rows": 5, "block_rows": 9}:
        got = arrays.near_queries(queries, table, 0.3, **sizes)
        assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
