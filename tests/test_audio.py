"""Audio, deliveries, experiment trees and documents on small files."""

import io
import json
import wave

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from corvane.operators import audio, delivery, evaluation, report, subsets, tables
from corvane.sources import readers, sinks


def wav(path, seconds, rate=16000, channels=1, level=0.3):
    t = np.arange(int(seconds * rate)) / rate
    samples = np.clip(np.rint(level * np.sin(2 * np.pi * 440 * t) * 32767), -32768, 32767).astype("<i2")
    out = io.BytesIO()
    with wave.open(out, "wb") as f:
        f.setnchannels(channels), f.setsampwidth(2), f.setframerate(rate)
        f.writeframes(np.repeat(samples, channels).tobytes())
    path.write_bytes(out.getvalue())


def test_headers_and_findings(spark, tmp_path):
    wav(tmp_path / "a.wav", 1.0), wav(tmp_path / "b.wav", 2.0, rate=8000), wav(tmp_path / "c.wav", 1.5, channels=2)
    (tmp_path / "d.wav").write_bytes(b"no wave")
    headers = audio.read_headers(spark, str(tmp_path)).withColumn("path", F.regexp_extract("path", "([^/]+)$", 1))
    got = {r.path: (r.rate, r.channels, r.seconds, r.error is None) for r in headers.collect()}
    assert got == {"a.wav": (16000, 1, 1.0, True), "b.wav": (8000, 1, 2.0, True), "c.wav": (16000, 2, 1.5, True), "d.wav": (None, None, None, False)}
    rows = spark.createDataFrame([("train", "1", "a.wav", 1.2), ("train", "2", "b.wav", 2.0), ("train", "3", "d.wav", 1.0), ("train", "4", "z.wav", 1.0), ("dev", "5", "a.wav", 1.04), ("dev", "6", "a.wav", None)], "split string, utt_id string, audio string, duration double")
    found = {(r.level, r.check, r.split): r.n for r in delivery.audio_findings(rows, headers).collect()}
    assert found == {("FATAL", "audio present", "train"): 1, ("FATAL", "audio format 16kHz mono", "train"): 2, ("ERROR", "declared duration matches audio", "train"): 1, ("OK", "audio", "dev"): 0}


def test_screening_and_quality(spark):
    tone = [0.3 * float(x) for x in np.sin(np.arange(16000) / 8)]
    clips = [("r1", "rir", tone[:800], None), ("r2", "rir", tone[:100], None), ("n1", "noise", tone, None), ("n2", "noise", tone[:800], None), ("n3", "noise", [0.0] * 16000, None), ("n4", "noise", [], None), ("n5", "noise", None, "bad"), ("n6", "noise", [float("nan")] * 16000, None), ("n7", "noise", tone, None)]
    out = {r.path: (r.reason, r.kept) for r in audio.screened(spark.createDataFrame(clips, "path string, kind string, signal array<double>, error string"), {"rir": 5, "noise": 1}).collect()}
    assert out["r1"] == (None, True) and out["r2"][0].endswith("too short") and out["n2"][0].endswith("too short") and out["n3"][0] == "silent" and out["n4"][0] == "empty" and out["n5"][0] == "unreadable: bad" and out["n6"][0] == "non-finite samples"
    assert sorted(out[x][1] for x in ("n1", "n7")) == [False, True] and sum(kept for _, kept in out.values()) == 2
    files = spark.createDataFrame([("a", tone * 2, None), ("b", [0.0] * 8000 + tone + [0.0] * 8000, None), ("c", None, "broken"), ("d", [1.0] * 16000, None)], "path string, signal array<double>, error string")
    judged = audio.quality_control(files)
    out = {r.path: (r.passed, len(r.signal or []), list(r.reasons)) for r in judged.collect()}
    assert out["a"] == (True, 32000, []) and out["b"][0] and out["b"][1] < 32000 and out["c"][2] == ["unreadable: broken"] and not out["d"][0]
    total = audio.quality_summary(judged).first()
    assert (total.n_files, total.n_passed, total.removal_rate, dict(total.failure_reasons)["unreadable: broken"]) == (4, 2, 0.5, 1) and total.max == 2.0


def test_profile(spark):
    rng = np.random.default_rng(1)
    quiet, loud = rng.normal(0, 0.001, 8000), rng.normal(0, 0.001, 8000) + 0.5 * np.sin(np.arange(8000) * 2 * np.pi * 1000 / 16000)
    p = audio.profile_of(np.concatenate([quiet, loud, quiet]))
    assert p[0] == 1.5 and 0.25 < p[4] < 0.45 and p[6] > 40 and np.isfinite(p[7]) and abs(p[8] - 1000) < 60 and abs(p[9] - 1000) < 20 and audio.profile_of(np.zeros(100)) is None
    rows = spark.createDataFrame([(1, quiet.tolist()), (2, None)], "id int, signal array<double>").select("id", audio.profile("signal").alias("p")).collect()
    assert {r.id: r.p.duration is not None for r in rows} == {1: True, 2: False}


def test_pairing_and_checks(spark):
    recordings = spark.createDataFrame([("u1", "p1"), ("u2", "p2"), ("u3", "p3")], "utt_id string, path string")
    both, missing = audio.paired(recordings, spark.createDataFrame([("u1", "abc"), ("u2", "")], "utt_id string, text string"))
    assert [r.utt_id for r in both.collect()] == ["u1"] and sorted(r.utt_id for r in missing.collect()) == ["u2", "u3"]
    rows = spark.createDataFrame([("a", "hello", "hello"), ("b", "hello", ""), ("c", "...", "x")], "audio string, reference string, hypothesis string")
    assert [(r.audio, r.cer) for r in audio.independent_check(rows).collect()] == [("b", 1.0)]


def test_augmented_corpus(spark):
    tone = [0.3 * float(x) for x in np.sin(np.arange(8000) / 8)]
    rows = spark.createDataFrame([(f"u{i}", tone, None, "x") for i in range(60)], "utt_id string, signal array<double>, interferer array<double>, text string")

    def render(asked):
        bad = F.when(F.col("utt_id") == "u7", "cannot")
        return asked.select("utt_id", F.when(bad.isNull(), F.col("signal")).alias("signal"), F.lit(5.0).alias("snr"), F.lit(None).cast("double").alias("sir"), bad.alias("error"))

    kept, failures, mix = audio.augmented_corpus(rows, render)
    got = kept.collect()
    assert len(got) == 59 and [r.utt_id for r in failures.collect()] == ["u7"] and "competing_speech" not in {r.condition for r in got}
    assert any(r.competing_speech_unavailable for r in got) and sum(r.n_planned for r in mix.collect()) == 60 and sum(r.n_realised for r in mix.collect()) == 59


def test_experiment_tree(spark, tmp_path):
    def put(path, doc):
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(json.dumps(doc))

    put("qwen06_full_20h/metrics.json", {"trainable_parameters": 5, "gpu_hours": 1.5})
    put("qwen06_full_20h/trainable_parameters.json", {"trainable_parameters": 9, "total_parameters": 10})
    put("qwen06_full_20h/test_synthetic/metrics.json", {"overall": {"cer": 0.25, "n_utterances": 4}, "medical_terms": {"medical_term_error_rate": 0.5, "by_term_category": {"disease": {"n_reference_terms": 2, "term_error_rate": 0.5}}}, "by_condition": {"clean": {"cer": 0.2}}, "meta": {"real_time_factor": 0.1}})
    put("qwen06_proj_5h_aug/trainable_parameters.json", {"trainable_parameters": 7})
    put("notes/metrics.json", {"trainable_parameters": 1})
    rows = {r.experiment: r for r in readers.read_experiments(spark, str(tmp_path)).collect()}
    assert set(rows) == {"qwen06_full_20h", "qwen06_proj_5h_aug"}
    full, proj = rows["qwen06_full_20h"], rows["qwen06_proj_5h_aug"]
    assert (full.trainable_parameters, full.total_parameters, full.cer, full.budget, full.test_set) == (5, 10, 0.25, "20h", "test_synthetic")
    assert full.by_term_category["disease"].term_error_rate == 0.5 and full.by_condition["clean"].cer == 0.2 and full.predictions_path.endswith("test_synthetic/predictions.jsonl")
    assert (proj.trainable_parameters, proj.cer, proj.test_set, proj.augmented) == (7, None, None, True)


def test_json_lines(spark, tmp_path):
    (tmp_path / "m.jsonl").write_text('{"utt_id": "a"}\n\n  \n{"utt_id": "b"}\n')
    assert sorted(r.utt_id for r in readers.read_jsonl(spark, str(tmp_path / "m.jsonl")).collect()) == ["a", "b"]
    (tmp_path / "bad.jsonl").write_text('{"utt_id": "a"}\n{"utt_id": \n')
    with pytest.raises(Exception, match=r"bad\.jsonl:2 malformed line: \{"):
        readers.read_jsonl(spark, str(tmp_path / "bad.jsonl")).collect()


def test_documents_and_reports(spark, tmp_path):
    rows = spark.createDataFrame([("u1", "abcx", "abx", "clean"), ("u2", "", "zz", None), ("u3", "xx", None, "noise")], "utt_id string, reference_raw string, hypothesis_raw string, condition string")
    made = evaluation.records(rows, ["x"])
    got = {r.utt_id: r for r in made.collect()}
    assert len(made.columns) == 27 and (got["u1"].edit_distance, got["u1"].deletions, list(got["u1"].medical_entities), got["u1"].all_terms_correct) == (1, 1, ["x"], True)
    assert got["u2"].cer is None and got["u2"].hypothesis_length == 2 and list(got["u3"].entity_errors) == ["x", "x"] and got["u3"].cer == 1.0
    doc = evaluation.document(made, spark.createDataFrame([("x", "letter")], "term string, category string"), {"tag": "t"})
    whole = json.loads(doc.first()[0])
    assert whole["meta"] == {"tag": "t"} and whole["overall"]["total_edit_distance"] == 3 and whole["by_condition"]["noise"]["cer"] == 1.0 and whole["medical_terms"]["by_term_category"]["letter"]["n_matched_terms"] == 1
    evaluation.write_evaluation(made, doc, str(tmp_path / "out"), "qwen06_zero", "t")
    assert spark.read.json(str(tmp_path / "out/qwen06_zero/t/predictions.jsonl")).count() == 3
    table = tables.table(spark, tables.TABLES["data_budget"], spark.createDataFrame([("qwen06", "full", "1h", False, False, 42, "test_synthetic", 0.12345), ("qwen06", "zero", None, False, False, 42, "test_synthetic", 0.5)], "model_key string, arm_key string, budget string, augmented boolean, replay boolean, seed int, test_set string, cer double"))
    shown = {r.label: (r.h1, r.h20) for r in table.collect()}
    assert shown["A1 Full SFT"] == ("12.35", "XX") or shown["A1 Full SFT"] == ("12.34", "XX")
    assert shown["A0 Zero-shot"] == ("50.00", "50.00")
    twin = json.loads(report.twin(table, "t2", "Data budget", "row").first()[0])
    assert twin["n_cells"] == 20 and twin["n_missing_cells"] == 11 and twin["rows"][0][0] == "A0 Zero-shot"
    findings = spark.createDataFrame([("u1", "error", "blank text")] * 3 + [("u2", "warning", "long")], "utt_id string, level string, finding string")
    lines = delivery.report_text({"rows": 4}, findings, errors=2).splitlines()
    assert lines[0] == "== manifest ==" and lines[2:] == ["  ERROR   u1: blank text"] * 2 + ["  ... 1 more errors", "  WARNING u2: long"]
    sinks.write_csv(table, str(tmp_path / "csv"))
    assert spark.read.csv(str(tmp_path / "csv"), header=True).count() == 4


def test_pools():
    voices = pd.DataFrame({"speaker_id": [f"S{i:02d}" for i in range(32)], "accent": [f"a{i * 3 % 4}" for i in range(32)], "gender": ["f", "m"] * 16, "order": [f"{i * 7 % 32:02d}" for i in range(32)]})
    out = subsets.pools(voices, {"test": 6, "dev": 6})
    assert out.pool.value_counts().to_dict() == {"train": 20, "test": 6, "dev": 6} and set(out[out.pool == "test"].accent) == {"a0", "a1", "a2", "a3"}
    with pytest.raises(ValueError):
        subsets.pools(voices, {"test": 33})


def test_gate_accepts_a_clean_delivery(spark):
    rows = [(f"{s}{i}", "a", f"text {i // 2}", f"{s}{i % 4 if s != 'train' else i % 20}", "human", None, "numeric", "F", 3600.0, "clean", None, None, f"k{i // 2}", s) for s, n in (("train", 40), ("dev", 8), ("test", 8)) for i in range(n)]
    manifest = spark.createDataFrame(rows, "utt_id string, audio string, text string, speaker_id string, source string, tts_engine string, domain_category string, template_family string, duration double, condition string, snr double, sir double, script_id string, split string").withColumn("duration", F.lit(2000.0) / 80)
    scripts = manifest.select("split", "script_id", "text").distinct()
    out = delivery.gate(manifest, scripts, hours=0.2, busiest=0.3)
    assert delivery.verdict(out).first().verdict == "ACCEPT" and {r.level for r in out.collect()} == {"OK"}
    worse = delivery.gate(manifest.where("split <> 'dev'"), scripts.withColumn("text", F.lit("other")), hours=20.0)
    levels = {(r.level, r.check) for r in delivery.by_severity(worse).collect()}
    assert {("FATAL", "manifest present"), ("FATAL", "text matches script"), ("ERROR", "training hours"), ("WARN", "speaker balance")} <= levels and delivery.verdict(worse).first().verdict == "REJECT"
