"""Text and array functions against hand-computed values."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.functions import arrays, text


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize("reference,hypothesis,expected", [("abc", "abd", (1, 1, 0, 0)), ("abc", "ac", (1, 0, 1, 0)), ("ac", "abc", (1, 0, 0, 1)), ("abcd", "", (4, 0, 4, 0)), ("", "abc", (3, 0, 0, 3)), ("", "", (0, 0, 0, 0))])
def test_edit_kinds(reference, hypothesis, expected):
    assert text.count_edits(reference, hypothesis) == expected


def test_edit_kinds_add_up(spark):
    pairs = [("kitten", "sitting"), ("今天天气", "今天气"), ("abcdef", "azced"), ("aaaa", "bb"), ("x", "xyx")]
    rows = spark.createDataFrame(pairs, "r string, h string").select("r", "h", text.edit_operations("r", "h").alias("e"), F.levenshtein("r", "h").alias("d")).collect()
    assert all(r.e.distance == r.d == r.e.substitutions + r.e.deletions + r.e.insertions for r in rows)


def test_normalize(spark):
    cases = {"language Chinese<asr_text>不是ＣＴ，我说的是增强CT。": "不是ct我说的是增强ct", "血压120/80，正常。": "血压120/80正常", "上午9:30的号": "上午9:30的号", "等等.然后": "等等然后", "体温37.5度。": "体温37.5度", "": "", "  A b ": "ab"}
    rows = spark.createDataFrame(list(cases.items()), "t string, e string").select("e", text.normalize(F.col("t")).alias("n")).collect()
    assert [r.n for r in rows] == [r.e for r in rows]
    assert one(spark, text.normalize(F.lit(None).cast("string"))) == ""
    assert one(spark, text.normalize(F.lit(" A  b. "), drop_whitespace=False)) == "a b"


def test_numerals():
    cases = {"三十七": "37", "一百二十": "120", "二零一五": "2015", "两千零五": "2005", "三十七点五": "37.5", "五百米": "500米", "十": "10", "一万二千": "12000", "abc": "abc"}
    assert {t: text.arabic_numerals(t) for t in cases} == cases


def test_terms(spark):
    assert one(spark, text.term_counts(F.lit("不是ct我说的是增强ct"), ["ct", "增强ct"])) == {"增强ct": 1, "ct": 1}
    assert one(spark, text.term_counts(F.lit("增强ct"), ["ct", "增强ct"])) == {"增强ct": 1}


def test_ngrams(spark):
    assert one(spark, text.char_ngrams(F.lit("abcabc"))) == ["abc", "bca", "cab"]
    assert one(spark, text.char_ngrams(F.lit("ab"))) == ["ab"] and one(spark, text.char_ngrams(F.lit(""))) == []


def test_script_profile(spark):
    p = one(spark, text.script_profile(F.lit("做CT 3次，é")))
    assert (p.cjk, p.latin, p.digit, p.punct, p.space, p.other) == (2, 2, 1, 1, 1, 1)


def signal(spark, values):
    return spark.createDataFrame([(values,)], "s array<double>")


def test_measure(spark):
    m = signal(spark, [0.5, -1.0, float("nan"), 0.0]).select(arrays.measure(F.col("s")).alias("m")).first().m
    assert (m.n_samples, m.peak, m.n_nonfinite, m.is_all_zero, m.clipping_ratio) == (4, 1.0, 1, False, 0.25)
    assert m.rms == pytest.approx(np.sqrt(1.25 / 4))
    empty = signal(spark, []).select(arrays.measure(F.col("s")).alias("m")).first().m
    assert (empty.n_samples, empty.rms, empty.is_all_zero) == (0, 0.0, False)


def test_snr_scaling(spark):
    rng = np.random.default_rng(0)
    a, b = rng.normal(size=400).tolist(), rng.normal(size=400).tolist()
    for db in (5.0, 10.0, 20.0):
        table = spark.createDataFrame([(a, b)], "a array<double>, b array<double>")
        made = np.array(table.select(arrays.scale_to_snr(F.col("a"), F.col("b"), F.lit(db)).alias("x")).first().x)
        assert 10 * np.log10(np.mean(np.square(a)) / np.mean(np.square(made))) == pytest.approx(db, abs=1e-6)


def test_silence_and_trim(spark):
    s = [0.0] * 8000 + [0.5] * 4000 + [0.0] * 8000
    row = signal(spark, s).select(arrays.silence_stats("s").alias("q"), arrays.trim_silence("s").alias("t")).first()
    assert row.q.leading_silence == pytest.approx(0.49, abs=0.02) and row.q.silence_ratio == pytest.approx(0.79, abs=0.02)
    assert 4000 + 2 * 2400 <= len(row.t) <= 4000 + 2 * 2400 + 400


def test_array_forms(spark):
    t = signal(spark, [0.1, -0.4, 0.9])
    assert t.select(arrays.fit_length(F.col("s"), 5).alias("x")).first().x == [0.1, -0.4, 0.9, 0.1, -0.4]
    assert t.select(arrays.guard_clipping(F.col("s"), 0.45).alias("x")).first().x == pytest.approx([0.05, -0.2, 0.45])
    assert t.select(arrays.mu_law(F.col("s")).alias("x")).first().x == pytest.approx([0.1, -0.4, 0.9], abs=0.02)
    ids = spark.createDataFrame([([1, 2, 3, None], [None, 1, 2, 3])], "r array<int>, l array<int>")
    row = ids.select(arrays.label_mask(F.col("r"), F.lit(2)).alias("r"), arrays.label_mask(F.col("l"), F.lit(2)).alias("l")).first()
    assert row.r == [-100, 2, 3, -100] and row.l == [-100, -100, 2, 3]
