"""Metrics, significance, sampling, validation, templates, dedup and files."""

import json
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from corvane.operators import augment, dedup, metrics, report, sampling, templates, validate
from corvane.sources import readers, sinks
from corvane.sources.tables import save


def scored(spark, rows):
    return spark.createDataFrame(rows, "utt_id string, kind string, distance long, reference_length int")


def test_error_rates(spark):
    r = metrics.corpus_cer(scored(spark, [("a", "x", 1, 10), ("b", None, 1, 2), ("c", "x", 0, 0)])).first()
    assert (r.cer, r.macro_cer, r.n_scored, r.n_empty_reference) == (pytest.approx(2 / 12), pytest.approx(0.3), 2, 1)
    nothing = metrics.corpus_cer(scored(spark, [("c", "x", 0, 0)])).first()
    assert nothing.cer is None and nothing.macro_cer is None
    groups = {g.kind: g.cer for g in metrics.grouped_cer(scored(spark, [("a", "clean", 0, 4), ("b", "noise", 3, 6), ("c", None, 1, 2)]), "kind").collect()}
    assert groups == {"clean": 0.0, "noise": 0.5, "UNSPECIFIED": 0.5}


def test_bootstrap(spark):
    a = scored(spark, [(str(i), "x", 1, 10) for i in range(200)])
    b = scored(spark, [(str(i), "x", 0, 10) for i in range(200)])
    r = metrics.bootstrap(metrics.paired(a, b), 500).first()
    assert r["diff"] == pytest.approx(0.1) and r.low > 0 and r.significant and r.p_value == 0
    same = metrics.bootstrap(metrics.paired(a, a), 200).first()
    assert same["diff"] == same.low == same.high == 0 and not same.significant
    with pytest.raises(Exception, match="unpaired"):
        metrics.paired(a, b.limit(3)).collect()


def test_term_recall(spark):
    pairs = spark.createDataFrame([(1, "增强ct和ct", "ct")], "id long, reference string, hypothesis string")
    lexicon = spark.createDataFrame([("ct", "exam"), ("增强ct", "exam")], "term string, category string")
    recall = metrics.term_recall(pairs, lexicon, ["ct", "增强ct"], ["id"])
    total = metrics.term_metrics(recall, ["id"]).first()
    assert (total.n_reference, total.n_hit, total.recall, total.exact_match) == (2, 1, 0.5, 0.0)


def test_greedy_acceptance(spark):
    """Who is similar to a rejected one only is kept."""
    ids = spark.range(6).select("id")
    pairs = spark.createDataFrame([(0, 1), (1, 2), (2, 3), (3, 4)], "a long, b long")
    got = {r.id for r in dedup.accept_greedily(ids, pairs, save).where("accepted").collect()}
    assert got == {0, 2, 4, 5}


def test_near_pairs(spark):
    from corvane.functions.text import char_ngrams

    base = "the quick brown fox jumps over the lazy dog and runs away from the hungry wolves at night"
    rows = [(1, base), (2, base), (3, base + "s"), (4, "something else entirely, with no words in common"), (5, base.replace("night", "noon") + "...")]
    grams = spark.createDataFrame(rows, "id long, t string").select("id", char_ngrams(F.col("t")).alias("grams"))
    sets = {i: {t[j : j + 3] for j in range(len(t) - 2)} for i, t in rows}
    want = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.9 * len(sets[a] | sets[b])}
    for candidates in dedup.prefix_pairs, dedup.banded_pairs:
        got = {(r.a, r.b) for r in dedup.near_pairs(grams, save, candidates=candidates).collect()}
        assert got == {p for p in want if p[0] != 2} | {(1, 2)}


@pytest.mark.parametrize("threshold", [0.5, 0.8, 0.9, 1.0])
def test_prefix_pairs_leave_out_nothing(spark, threshold):
    """Sets of all sizes around the threshold, equal and empty ones, against every pair."""
    draw, sets = random.Random(4), {}
    for i in range(120):
        start = sets[draw.randrange(i)] if i > 10 else set()
        sets[i] = {g for g in start if draw.random() > 0.06} | {f"g{draw.randrange(60)}" for _ in range(draw.randrange(6))}
    sets |= {200: set(), 201: set(), 202: {f"g{i}" for i in range(8)}, 203: {f"g{i}" for i in range(4)}, 204: sets[100]}
    first = {i: min(j for j in sets if sets[j] == sets[i]) for i in sets}
    alike = lambda x, y: len(x & y) >= threshold * len(x | y) and bool(x)
    want = {(a, b) for a in sets for b in sets if a < b and (first[b] == a or first[a] == a and first[b] == b and alike(sets[a], sets[b]))}
    frame = spark.createDataFrame([(i, sorted(s)) for i, s in sets.items()], "id long, grams array<string>")
    assert {(r.a, r.b) for r in dedup.near_pairs(frame, save, threshold).collect()} == want
    assert dedup.near_pairs(frame.limit(0), save, threshold).count() == 0


@pytest.mark.parametrize("threshold", [0.5, 0.8, 0.9, 0.95, 1.0])
def test_part_pairs_leave_out_nothing(spark, threshold):
    """Sets of strings and of longs, of all sizes around the threshold, against every pair."""
    draw, sets = random.Random(5), {}
    for i in range(120):
        start = sets[draw.randrange(i)] if i > 10 else set()
        sets[i] = {g for g in start if draw.random() > 0.04} | {draw.randrange(400) for _ in range(draw.choice((1, 2, 6, 40)))}
    want = {(a, b) for a in sets for b in sets if a < b and sets[a] != sets[b] and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b])}
    for kind, form in (("long", int), ("string", str)):
        frame = spark.createDataFrame([(i, [form(g) for g in s]) for i, s in sets.items()], f"id long, grams array<{kind}>")
        got = {(r.a, r.b) for r in dedup.near_pairs(frame, save, threshold, dedup.part_pairs).collect()}
        assert {p for p in got if sets[p[0]] != sets[p[1]]} == {p for p in want if all(min(j for j in sets if sets[j] == sets[i]) == i for i in p)}
    assert dedup.near_pairs(frame.limit(0), save, threshold, dedup.part_pairs).count() == 0


@pytest.mark.parametrize("threshold", [0.5, 0.9, 1.0])
def test_block_pairs_leave_out_nothing(spark, threshold, monkeypatch):
    """Sets whose bitmaps have several widths, over many blocks and in one, against every pair."""
    monkeypatch.setattr(dedup, "LEAST_SETS", 20)
    monkeypatch.setattr(dedup, "TILE", 50)
    draw, sets = random.Random(7), {}
    for i in range(150):
        start = sets[draw.randrange(i)] if i > 10 and i % 3 else {draw.randrange(4000) for _ in range(draw.choice((1, 2, 6, 40, 300, 510, 530, 1020, 1100)))}
        sets[i] = {g for g in start if draw.random() > 0.03} | {draw.randrange(4000)}
    sets[150] = set()
    want = {(a, b) for a in sets for b in sets if a < b and sets[a] and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b])}
    for kind, form in (("long", int), ("string", str)):
        frame = spark.createDataFrame([(i, [form(g) for g in s]) for i, s in sets.items()], f"id long, grams array<{kind}>")
        for blocks in (1, 7):
            monkeypatch.setattr(dedup, "BLOCKS", blocks)
            got = [(r.a, r.b) for r in dedup.block_pairs(frame, save, threshold).collect()]
            assert want <= set(got) and len(got) == len(set(got))
    assert dedup.block_pairs(frame.limit(0), save, threshold).count() == 0


@pytest.mark.parametrize("name", ["near_dup_document_pairs", "near_dup_greedy"])
def test_documents_are_written_once_a_set(spark, tmp_path, monkeypatch, name):
    """Texts over few words: nothing that is written, beside pairs, has several rows for each of them, as posts by part had."""
    from corvane.plans import queries

    draw, rows = random.Random(8), {}
    words = ["".join(draw.choice("abcdeilmnorst") for _ in range(draw.randrange(2, 9))) for _ in range(8)]
    spark.createDataFrame([(i, " ".join(draw.choices(words, k=150))) for i in range(300)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")

    def watched(df, table):
        out = save(df, table)
        rows[table] = max(rows.get(table, 0), out.count())
        return out

    monkeypatch.setattr(queries, "save", watched)
    queries.QUERIES[name](spark, str(tmp_path)).collect()
    pairs = {"near-candidates", "near-met", "greedy-pairs"}
    assert max(n for table, n in rows.items() if table not in pairs) <= 300, rows


def test_part_pairs_meet_few(spark):
    """Texts of a few dozen words that all share their grams, none alike: candidates are hardly more than there are texts."""
    draw = random.Random(6)
    words = ["".join(draw.choice("abcdeilmnorst") for _ in range(draw.randrange(2, 9))) for _ in range(60)]
    from corvane.functions.text import trigram_codes

    frame = spark.createDataFrame([(i, " ".join(draw.choices(words, k=60))) for i in range(600)], "id long, t string").select("id", trigram_codes("t").alias("grams"))
    frame = save(frame, "few")
    assert dedup.part_pairs(frame, save, 0.9).count() < 600


def test_trigram_codes_are_char_ngrams(spark):
    from corvane.functions.text import char_ngrams, dedup_key, nfkc, trigram_codes

    texts = ["", "a", "ab", "a b", "abc", "aXb\u00a0c\u3000d\u2028e\u0085f\x1cg", "\u200bab\u180ecd", "ÀÉÎ—õü… 'x' ~y", "𝒜😀é 😀é😀", "ΑΣ Σ ΑΣ", "aaaa", "a\x00b\x00c", None]
    rows = save(spark.createDataFrame(list(enumerate(texts)), "id long, t string").select("id", dedup_key(F.col("t")).alias("k"), F.lower(nfkc(F.col("t"))).alias("t")), "codes")
    for r in rows.select("k", char_ngrams(F.col("k")).alias("g"), trigram_codes("t").alias("c")).collect():
        number = lambda g: sum((ord(x) + 1) << 21 * (len(g) - 1 - i) for i, x in enumerate(g))
        assert r.k is None and r.c is None or sorted(map(number, r.g)) == r.c


def test_split_and_quota(spark):
    rows = spark.createDataFrame([(c, f"{c}{f}", i) for c in "AB" for f in range(5) for i in range(10 * (f + 1))], "c string, f string, i int")
    out = sampling.split_families(rows, "c", "f", 0.2, 0.2)
    got = out.groupBy("category").agg(F.count_distinct("split").alias("n"), F.sum("size").alias("s")).collect()
    assert all(r.n == 3 and r.s == 150 for r in got) and out.count() == 10
    with pytest.raises(Exception, match="at least"):
        sampling.split_families(rows.where("f < 'A2' and c = 'A'"), "c", "f").collect()
    families = spark.createDataFrame([("A", 0.5, "f1", 0, 10), ("A", 0.5, "f2", 1, 1000), ("B", 0.5, "g", 0, 20)], "category string, share double, family string, position int, capacity long")
    assert {r.family: r.quota for r in sampling.allocate_quota(families, 100).collect()} == {"f1": 10, "f2": 40, "g": 20}


def test_budgets_are_nested(spark):
    rows = spark.createDataFrame([(i, float(1 + i % 3)) for i in range(200)], "id long, d double")
    got = {r.id: set(r.subsets) for r in sampling.nested_budgets(rows, "d", ["id"], {"s": 10.0, "l": 50.0}).collect()}
    before, want = 0.0, {}
    for i in range(200):
        want[i] = {n for n, limit in (("s", 10.0), ("l", 50.0)) if before < limit}
        before += 1 + i % 3
    assert got == want


def test_deal_by_credit():
    rows = pd.DataFrame({"category": ["a"] * 6 + ["b"] * 2, "speaker": list("xyxyxy") + ["z", "z"], "id": range(8)})
    out = sampling.deal_by_credit(rows).sort_values("position")
    assert sorted(out.position) == list(range(8)) and set(out.category[:4]) == {"a", "b"}


def test_validation(spark):
    good = dict(utt_id="u", audio="a", text="t", speaker_id="s", source="human", domain_category="disease", template_family="f", duration=1.0, condition="clean", snr=None, sir=None)
    bad = [dict(good, utt_id="u"), dict(good, utt_id="v", text=" "), dict(good, utt_id="w", condition="noise"), dict(good, utt_id="x", condition="competing_speech"), dict(good, utt_id="y", snr=1.0), dict(good, utt_id="z", duration=0.0), dict(good, utt_id="q", duration=31.0), dict(good, utt_id="r", source="tv"), dict(good, utt_id="m", audio=None)]
    schema = "utt_id string, audio string, text string, speaker_id string, source string, domain_category string, template_family string, duration double, condition string, snr double, sir double"
    rows = spark.createDataFrame([tuple(r.values()) for r in [good, *bad]], schema)
    found = {(r.utt_id, r.level, r.finding) for r in validate.manifest_findings(rows).collect()}
    assert found == {("u", "error", "repeated utt_id"), ("v", "error", "blank text"), ("w", "error", "noise without snr"), ("x", "error", "competing speech without sir"), ("y", "error", "clean with snr or sir"), ("z", "error", "duration not positive"), ("q", "warning", "duration over 30 s"), ("r", "error", "unknown source"), ("m", "error", "missing audio")}
    assert validate.verdict(validate.manifest_findings(rows)).first().verdict == "rejected"


def test_index_percentile(spark):
    r = validate.index_percentiles(spark.range(1, 11).select(F.lit("a").alias("k"), "id"), "id", "k", {"p10": 0.1, "p50": 0.5}).first()
    assert (r.p10, r.p50, r.n, r["mean"]) == (2, 6, 10, 5.5)


def test_templates(spark):
    patterns = spark.createDataFrame([(1, "f", "c", "{x} and {x2}"), (2, "f", "c", "plain")], "pattern_id long, family_id string, category string, pattern string")
    sizes = spark.createDataFrame([("x", 3), ("x2", 3)], "slot string, size int")
    assert {r.pattern_id: r.capacity for r in templates.pattern_capacities(patterns, sizes).collect()} == {1: 9, 2: 1}
    values = spark.createDataFrame([(s, i, v) for s in ("x", "x2") for i, v in enumerate("pqr")], "slot string, position int, value string")
    texts = sorted(r.text for r in templates.fillings(patterns, values, 100).collect())
    assert texts == sorted([f"{a} and {b}" for a in "pqr" for b in "pqr" if a != b] + ["plain"])
    assert spark.range(1).select(templates.decode(F.lit(17), F.array(F.lit(3), F.lit(2), F.lit(4))).alias("d")).first().d == [2, 0, 1]


def test_condition_mix_and_render(spark):
    rows = spark.range(8000).select(F.concat(F.lit("u"), "id").alias("id"))
    shares = {r.condition: r["count"] / 8000 for r in augment.plan_conditions(rows, "id").groupBy("condition").count().collect()}
    assert all(abs(shares[c] - w) < 0.02 for c, w in augment.CONDITION_WEIGHTS.items())
    wave = [0.3 if i % 40 < 20 else -0.3 for i in range(1600)]
    table = spark.createDataFrame([(c, c, wave, wave if c == "competing_speech" else None) for c in augment.CONDITION_WEIGHTS] + [("e", "competing_speech", wave, None)], "utt_id string, condition string, signal array<double>, interferer array<double>")
    a, b = ({r.utt_id: r for r in augment.augment(table).collect()} for _ in range(2))
    assert all(a[u].signal == b[u].signal for u in a) and a["e"].competing_speech_unavailable and a["e"].snr and a["noise"].snr and a["competing_speech"].sir


def test_names_and_cells(spark):
    names = spark.createDataFrame([("qwen06_full_1h_aug_replay_seed7",), ("nope",), ("base1_full_1h",), ("qwen17_proj_proj",), ("qwen9_audiolora_proj_replay",)], "n string")
    r = report.parse_names(names, "n").collect()
    assert [(x.model_key, x.arm_key, x.budget, x.augmented, x.replay, x.seed) for x in r] == [("qwen06", "full", "1h", True, True, 7), ("qwen9", "audiolora_proj", None, False, True, 42)] and r[0].arm == "A1 Full SFT" and r[1].model == "qwen9"
    assert spark.range(1).select(report.cell(F.lit(None).cast("double"), 2).alias("c")).first().c == "XX"
    assert r"a\_b" in report.latex([("x", "1%")], ["a_b", "c"])


def test_files(spark, tmp_path):
    path = tmp_path / "m.jsonl"
    path.write_text(json.dumps({"utt_id": "u", "duration": 1.5}) + "\n\n" + json.dumps({"utt_id": "v", "other": 1}) + "\n")
    assert [(r.utt_id, r.duration) for r in readers.read_jsonl(spark, str(path)).collect()] == [("u", 1.5), ("v", None)]
    path.write_text("{broken\n")
    with pytest.raises(Exception, match="malformed"):
        readers.read_jsonl(spark, str(path)).collect()
    (tmp_path / "t.txt").write_text("u1 你 好\nu2\n\n")
    assert [tuple(r) for r in readers.read_transcripts(spark, str(tmp_path / "t.txt")).collect()] == [("u1", "你好")]
    (tmp_path / "w").mkdir()
    (tmp_path / "w" / "a.wav").write_bytes(sinks.encode_wav([0.0, 0.5, -0.5]))
    (tmp_path / "w" / "b.wav").write_bytes(b"no")
    got = {r.path[-5:]: r for r in readers.read_audio(spark, str(tmp_path / "w")).collect()}
    assert got["a.wav"].signal == pytest.approx([0, 0.5, -0.5], abs=1e-3) and got["b.wav"].error
    lines = sinks.sft_lines(spark.createDataFrame([("a", "x"), ("b", "language None<asr_text>y")], "audio string, text string")).collect()
    assert [r.text for r in lines] == ["language Chinese<asr_text>x", "language None<asr_text>y"]


def test_corpus_from_templates(spark):
    from corvane.operators import corpus

    patterns = spark.createDataFrame([(1, "f1", "a", "the {x} meets the {y} today"), (2, "f2", "a", "fixed words only"), (3, "g1", "b", "where is {x} now please")], "pattern_id long, family_id string, category string, pattern string")
    values = spark.createDataFrame([("x", i, w) for i, w in enumerate(["doctor", "nurse", "patient"])] + [("y", i, w) for i, w in enumerate(["engineer", "teacher"])], "slot string, position int, value string")
    shares = spark.createDataFrame([("a", 0.5), ("b", 0.5)], "category string, share double")
    rows = corpus.generate(patterns, values, shares, 6, save).collect()
    assert len({r.text for r in rows}) == len(rows) and all("{" not in r.text for r in rows)
    assert {r.category for r in rows} == {"a", "b"} and sum(r.category == "b" for r in rows) == 3
