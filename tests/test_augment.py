"""Augmentation: the noise bank, metadata, and interferers."""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import functions as F

from corvane.operators import augment


def test_files_are_drawn_by_weight(spark):
    weights = {"p0": 1.0, "p1": 3.0, "p2": 0.0, "p3": 0.5, "p4": 5.5}
    bank = spark.createDataFrame([("noise", p, w) for p, w in weights.items()] + [("rir", "r", 1.0)], "kind string, path string, weight double")
    rows = spark.range(20000).select(F.concat(F.lit("u"), "id").alias("utt_id"))
    drawn = augment.draw_files(rows, bank, "noise", cells=7)
    counts = {r.path: r["count"] / 20000 for r in drawn.groupBy("path").count().collect()}
    assert set(counts) == {"p0", "p1", "p3", "p4"} and all(abs(n - weights[p] / 10) < 0.015 for p, n in counts.items()) and abs(sum(counts.values()) - 1) < 1e-9
    some = rows.where("utt_id in ('u1', 'u77', 'u4000')")
    one = {r.utt_id: r.path for r in drawn.join(some, "utt_id").collect()}
    assert {r.utt_id: r.path for r in augment.draw_files(some.repartition(3), bank.repartition(4), "noise", cells=1000).collect()} == one and len(one) == 3
    assert augment.draw_files(rows, bank, "speech").count() == 0


def test_bank_and_metadata(spark):
    wave = [0.3 if i % 40 < 20 else -0.3 for i in range(1600)]
    rows = spark.createDataFrame([(f"{c}{i}", c, wave, wave if c == "competing_speech" and i else None, "o" if i else None, "s" if i else None) for c in augment.CONDITION_WEIGHTS for i in range(6)], "utt_id string, condition string, signal array<double>, interferer array<double>, other_id string, other_speaker string")
    hiss = np.random.default_rng(0).normal(size=900).tolist()
    bank = spark.createDataFrame([("noise", "n1", 1.0, hiss), ("noise", "n2", 1.0, None), ("noise", "n3", 1.0, []), ("rir", "r1", 2.0, [1.0, 0.0, 0.3])], "kind string, path string, weight double, signal array<double>")
    competing = F.col("interferer").isNull()
    out = {r.utt_id: r for r in augment.augment(augment.with_bank(rows.withColumn("competing", competing), bank)).collect()}
    again = {r.utt_id: r for r in augment.augment(augment.with_bank(rows.withColumn("competing", competing).repartition(5), bank)).collect()}
    assert len(out) == 36 and all(out[u] == again[u] for u in out) and not any(r.error for r in out.values())
    fields = set(next(iter(out.values())).asDict()) - {"utt_id", "signal", "error"}
    assert len(fields) == 14
    for name, r in out.items():
        asked = name.rstrip("0123456789")
        if asked in ("noise", "noise_reverb"):
            assert r.snr and tuple(r.noise_source) == ("corpus", "n1", None)
        if asked in ("reverb", "noise_reverb"):
            assert tuple(r.rir_source) == ("corpus", "r1", None)
        if asked == "codec":
            assert r.codec == "mu_law_g711" and r.resample_rate is None or r.codec == "resample_degrade" and r.resample_rate in (8000, 11025, 12000)
        if asked == "competing_speech":
            assert (r.condition, r.competing_utt_id, r.competing_speaker_id) == (("competing_speech", "o", "s") if r.sir else ("noise", None, None)) and (r.competing_speech_unavailable is True) == (name.endswith("0"))
        assert r.augmentation_seed == 42 and abs(r.input_rms - 0.3) < 1e-6 and max(map(abs, r.signal)) <= 0.99 + 1e-9 and -6 <= r.gain_db <= 6
    made = {r.utt_id: r for r in augment.augment(rows).collect()}  # without a bank everything is made up, and says so
    assert all(r.noise_source.source == "synthetic" and r.noise_source.color in augment.COLORS for u, r in made.items() if r.snr) and all(r.rir_source.rt60_seconds > 0 for u, r in made.items() if r.rir_source)


def check_interferers(spark, people):
    rows = spark.createDataFrame([(f"u{i}", s, c) for i, (s, c) in enumerate(people)], "utt_id string, speaker_id string, script_id string")
    got = {r.utt_id: r for r in augment.interferers(rows, rounds=3).collect()}
    assert set(got) == {f"u{i}" for i in range(len(people))}
    for i, (s, c) in enumerate(people):
        can = any(s2 != s and (c2 is None or c is None or c2 != c) for j, (s2, c2) in enumerate(people) if j != i)
        r = got[f"u{i}"]
        assert (r.other_id is not None) == can, (i, s, c)
        if can:
            s2, c2 = people[int(r.other_id[1:])]
            assert s2 != s and (c is None or c2 is None or c2 != c) and r.other_speaker == s2


def test_everyone_who_can_has_an_interferer(spark):
    rng = random.Random(7)
    check_interferers(spark, [(rng.choice("abcdefgh"), rng.choice(["x", "y", "z", "w", None])) for _ in range(120)])
    # one speaker has nearly all; only one row can help them, and it shares a script with some
    check_interferers(spark, [("a", rng.choice("xyz")) for _ in range(60)] + [("b", "x")])
    check_interferers(spark, [("a", "x")] * 20 + [("b", "x")] * 5 + [("a", "y")])
    check_interferers(spark, [("a", "x")] * 9)
    check_interferers(spark, [(None, None), (None, "x"), ("a", None)])
