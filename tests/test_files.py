"""Files: headers and samples of WAV and FLAC, writers that commit, numbered lines, and the chain from predictions to tables."""

from __future__ import annotations

import hashlib
import io
import json
import os
import random
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.operators import audio, evaluation, tables
from corvane.sources import files, flac, readers, sinks


def wav_bytes(samples, rate=16000, wide=2):
    out = io.BytesIO()
    with wave.open(out, "wb") as f:
        f.setnchannels(1), f.setsampwidth(wide), f.setframerate(rate)
        f.writeframes(np.asarray(samples).astype(f"<i{wide}").tobytes())
    return out.getvalue()


class Out:
    def __init__(self):
        self.bits = []

    def put(self, value, n):
        self.bits += [value >> i & 1 for i in reversed(range(n))]

    def rice(self, residual, k):
        for r in residual:
            r = int(r) << 1 if r >= 0 else (-int(r) << 1) - 1
            self.bits += [0] * (r >> k) + [1]
            self.put(r & (1 << k) - 1, k)

    def bytes(self):
        self.bits += [0] * (-len(self.bits) % 8)
        return np.packbits(self.bits).tobytes()


def flac_bytes(channels, rate=16000, block=512, kind="fixed", side=None):
    """A plain encoder: verbatim, constant, fixed or linear prediction; stereo as it is or with a difference."""
    n = len(channels[0])
    head = Out()
    for value, size in ((block, 16), (block, 16), (0, 24), (0, 24), (rate, 20), (len(channels) - 1, 3), (15, 5), (n, 36)):
        head.put(value, size)
    out = b"fLaC" + bytes([0x80, 0, 0, 34]) + head.bytes() + hashlib.md5(np.stack(channels, 1).astype("<i2").tobytes()).digest()
    for number, first in enumerate(range(0, n, block)):
        parts = [np.asarray(c[first : first + block], np.int64) for c in channels]
        size, o = len(parts[0]), Out()
        o.put(0x3FFE, 14), o.put(0, 2), o.put(7, 4), o.put(0, 4)
        o.put({None: len(channels) - 1, "left": 8, "right": 9, "middle": 10}[side], 4), o.put(4, 3), o.put(0, 1), o.put(number % 128, 8), o.put(size - 1, 16), o.put(0, 8)
        depths = [16] * len(parts)
        if side == "left":
            parts, depths = [parts[0], parts[0] - parts[1]], [16, 17]
        if side == "right":
            parts, depths = [parts[0] - parts[1], parts[1]], [17, 16]
        if side == "middle":
            parts, depths = [(parts[0] + parts[1]) >> 1, parts[0] - parts[1]], [16, 17]
        for x, depth in zip(parts, depths):
            mask = (1 << depth) - 1
            if kind == "constant":
                o.put(0, 8), o.put(int(x[0]) & mask, depth)
            elif kind == "verbatim" or size < 8:
                o.put(1 << 1, 8)
                for v in x:
                    o.put(int(v) & mask, depth)
            else:
                order = number % 5 if kind == "fixed" else 2
                o.put(((8 + order) if kind == "fixed" else (32 + order - 1)) << 1, 8)
                for v in x[:order]:
                    o.put(int(v) & mask, depth)
                if kind == "fixed":
                    residual = np.diff(x, order)
                else:
                    o.put(11, 4), o.put(9, 5), o.put(900 & 4095, 12), o.put(-410 & 4095, 12)
                    residual = x[2:] - ((900 * x[1:-1] - 410 * x[:-2]) >> 9)
                wide = number % 2
                o.put(wide, 2), o.put(1 if size % 2 == 0 else 0, 4)
                halves = [residual[: size // 2 - order], residual[size // 2 - order :]] if size % 2 == 0 else [residual]
                for j, half in enumerate(halves):
                    if j == 1 and number == 3:
                        o.put((1 << (4 + wide)) - 1, 4 + wide), o.put(20, 5)
                        for v in half:
                            o.put(int(v) & (1 << 20) - 1, 20)
                    else:
                        o.put(6, 4 + wide), o.rice(half, 6)
        out += o.bytes() + b"\0\0"
    return out


def tone(n=3000, f=200):
    t = np.arange(n)
    return np.rint(9000 * np.sin(2 * np.pi * f * t / 16000) + 300 * np.cos(t)).astype(np.int64)


@pytest.mark.parametrize("kind", ["fixed", "linear", "verbatim"])
def test_flac_round_trip(kind):
    x, y = tone(), tone(f=330)
    for channels, side in (([x], None), ([x, y], None), ([x, y], "left"), ([x, y], "right"), ([x, y], "middle")):
        data = flac_bytes(channels, kind=kind, side=side)
        out, info = flac.decode(data)
        assert (out == np.stack(channels)).all() and (info.rate, info.channels, info.bits, info.samples) == (16000, len(channels), 16, 3000)
    constant, _ = flac.decode(flac_bytes([np.full(700, -5)], kind="constant"))
    assert (constant == -5).all()
    bad = bytearray(data)
    bad[len(bad) // 2] ^= 8
    with pytest.raises(Exception):
        flac.decode(bytes(bad))
    with pytest.raises(ValueError):
        flac.decode(data[: len(data) // 2])


def test_headers_read_little(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    (tmp_path / "a.wav").write_bytes(wav_bytes(tone(160000)))
    (tmp_path / "deep/b.FLAC").write_bytes(flac_bytes([tone()], kind="verbatim"))
    body = wav_bytes(tone(50000), rate=8000, wide=4)
    late = body[:12] + body[36:] + b"LIST\x03\0\0\0abc\0" + body[12:36]  # samples first, an odd chunk, then what describes them
    (tmp_path / "c.wav").write_bytes(late)
    (tmp_path / "d.wav").write_bytes(b"RIFF1234WAVE")
    (tmp_path / "e.wav").write_bytes(wav_bytes(tone(1000))[:-500])
    (tmp_path / "f.txt").write_text("no audio")
    rows = {os.path.basename(r.path): r for r in audio.read_headers(spark, str(tmp_path)).collect()}
    assert set(rows) == {"a.wav", "b.FLAC", "c.wav", "d.wav", "e.wav"}
    assert (rows["a.wav"].rate, rows["a.wav"].seconds, rows["b.FLAC"].seconds) == (16000, 10.0, 3000 / 16000)
    assert (rows["c.wav"].rate, rows["c.wav"].seconds) == (8000, 50000 / 8000) and rows["d.wav"].error and rows["e.wav"].seconds == 750 / 16000
    assert sum(r.bytes_read for r in rows.values()) < 0.01 * sum(r.size for r in rows.values())
    sound = {os.path.basename(r.path): r for r in readers.read_audio(spark, str(tmp_path)).collect()}
    assert sound["b.FLAC"].signal == pytest.approx((tone() / 32768).tolist()) and sound["d.wav"].error and len(sound["c.wav"].signal) == 100000


def test_screened_index(spark, tmp_path):
    for name in ("a.wav", "b.wav", "c.wav"):
        (tmp_path / name).write_bytes(wav_bytes(tone(500)))
    index = {"noise": [{"path": str(tmp_path / "b.wav")}, {"path": str(tmp_path / "gone.wav")}], "rir": [{"path": str(tmp_path / "c.wav")}]}
    (tmp_path / "index.json").write_text(json.dumps(index))
    found = lambda kind: {os.path.basename(r.path) for r in readers.read_audio(spark, str(tmp_path / "index.json"), kind=kind).collect()}
    assert found("noise") == {"b.wav"} and found("rir") == {"c.wav"} and found("speech") == set()
    many = files.AudioReader({"path": str(tmp_path), "files": "2"}).partitions()
    assert [len(p.files) for p in many] == [2, 1]


def test_files_are_written_all_or_none(spark, tmp_path):
    folder = tmp_path / "out"
    rows = spark.createDataFrame([(f"d{i % 3}/f{i}.bin", bytes([i])) for i in range(20)], "path string, content binary").repartition(4)
    files.write_files(rows, str(folder))
    got = {str(p.relative_to(folder)): p.read_bytes() for p in folder.rglob("*") if p.is_file()}
    assert got == {f"d{i % 3}/f{i}.bin": bytes([i]) for i in range(20)} and not [p for p in folder.iterdir() if p.name.startswith("_")]
    with pytest.raises(Exception, match="already there"):
        files.write_files(rows.limit(1), str(folder))
    files.write_files(rows.where("path = 'd0/f0.bin'").withColumn("content", F.lit(b"new")), str(folder), "overwrite")
    assert (folder / "d0/f0.bin").read_bytes() == b"new"
    other = tmp_path / "other"
    failing = rows.withColumn("content", F.when(F.col("path") == "d1/f19.bin", F.raise_error(F.lit("task fails"))).otherwise(F.col("content")).cast("binary"))
    with pytest.raises(Exception):
        files.write_files(failing, str(other))
    for bad in (rows.unionByName(rows.limit(1)), rows.withColumn("path", F.lit("../x"))):
        with pytest.raises(Exception):
            files.write_files(bad, str(other))
    assert not [p for p in other.rglob("*") if p.is_file()] and not (tmp_path / "x").exists()


def test_waves_come_back(spark, tmp_path):
    rows = spark.createDataFrame([("s/a.wav", [0.0, 0.5, -0.5]), ("s/b.wav", None)], "path string, signal array<double>")
    sinks.write_wav(rows, str(tmp_path))
    got = readers.read_audio(spark, str(tmp_path)).collect()
    assert [os.path.basename(r.path) for r in got] == ["a.wav"] and got[0].signal == pytest.approx([0, 0.5, -0.5], abs=1e-4)


def test_line_numbers_across_splits(spark, tmp_path):
    rng = random.Random(3)
    lines = [json.dumps({"utt_id": f"u{i}", "text": "x" * rng.randrange(200)}) if rng.random() > 0.05 else "" for i in range(3000)]
    lines[2500] = '{"utt_id": '
    for name, some in (("one.jsonl", lines), ("two.jsonl", lines[:700])):
        (tmp_path / name).write_text("\n".join(some) + "\n")
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    spark.conf.set(key, str(os.path.getsize(tmp_path / "one.jsonl") // 4))
    try:
        assert spark.read.text(str(tmp_path / "one.jsonl")).rdd.getNumPartitions() >= 4
        got = {(os.path.basename(r.file), r.line): r.value for r in readers.numbered_lines(spark, str(tmp_path)).collect()}
        assert got == {(name, i): x for name, some in (("one.jsonl", lines), ("two.jsonl", lines[:700])) for i, x in enumerate(some, 1)}
        assert [(os.path.basename(r.file), r.line) for r in readers.malformed_lines(spark, str(tmp_path)).collect()] == [("one.jsonl", 2501)]
        with pytest.raises(Exception, match=r"one\.jsonl:2501 malformed"):
            readers.read_jsonl(spark, str(tmp_path)).count()
    finally:
        spark.conf.set(key, before)
    assert readers.read_jsonl(spark, str(tmp_path / "two.jsonl")).count() == sum(x != "" for x in lines[:700])


def test_from_predictions_to_tables(spark, tmp_path):
    """Two systems' records, written as documents, read back, and shown in the table of terms."""
    lexicon = spark.createDataFrame([("flu", "disease"), ("scan", "imaging_exam")], "term string, category string")
    said = [("u1", "the flu is here", None), ("u2", "a scan of the flu", None)]
    for experiment, heard in (("qwen06_zero", ["the flue is here", "a can of the fly"]), ("qwen06_dualpeft_20h", ["the flu is here", "a scan of the fly"])):
        rows = spark.createDataFrame([(u, ref, h) for (u, ref, _), h in zip(said, heard)], "utt_id string, reference_raw string, hypothesis_raw string")
        made = evaluation.records(rows, ["flu", "scan"])
        evaluation.write_evaluation(made, evaluation.document(made, lexicon, {"real_time_factor": "0.5"}), str(tmp_path), experiment, "test_synthetic")
    records = tables.of_experiments(readers.read_experiments(spark, str(tmp_path)))
    got = {r.arm_key: r for r in records.collect()}
    assert got["zero"].model == "Qwen3-ASR-0.6B" and got["dualpeft"].arm == "A7 DualPEFT" and got["zero"].test_set_label == "Synthetic clean (held-out voices)"
    assert (got["zero"].medical_term_error_rate, got["dualpeft"].medical_term_error_rate) == (pytest.approx(2 / 3), pytest.approx(1 / 3))
    assert (got["dualpeft"].term_error_imaging_exam, got["dualpeft"].term_error_disease, got["dualpeft"].utterance_exact_match) == (0.0, 0.5, 0.5)
    assert spark.read.json(got["zero"].predictions_path).count() == 2
    shown = {r.label: r.asDict() for r in tables.table(spark, tables.TABLES["terminology"], tables.latest(records, "experiment")).collect()}
    assert (shown["imaging_exam"]["zero"], shown["imaging_exam"]["dualpeft"], shown["disease"]["dualpeft"], shown["disease"]["full"]) == ("100.00", "0.00", "50.00", "XX")
    empty = evaluation.document(evaluation.records(rows.limit(0), ["flu"]), lexicon, {})
    assert "overall" not in json.loads(empty.first()[0])
