"""Writers: manifests, training lines, id lists, rejections, audio."""

from __future__ import annotations

import io
import wave

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.sources.files import write_files
from corvane.sources.readers import MANIFEST


def write_jsonl(rows: DataFrame, path: str) -> None:
    """Known fields first, in their fixed order, then the others by name."""
    known = [f.name for f in MANIFEST.fields if f.name in rows.columns]
    rows.select(*known, *sorted(set(rows.columns) - set(known))).write.json(path)


def sft_lines(rows: DataFrame, language: str = "Chinese") -> DataFrame:
    """audio, text for fine-tuning: a text without the "<asr_text>" mark gets the language prefix."""
    text = F.when(F.contains("text", F.lit("<asr_text>")), F.col("text")).otherwise(F.concat(F.lit(f"language {language}<asr_text>"), F.col("text")))
    return rows.select("audio", text.alias("text"))


def write_ids(rows: DataFrame, column: str, path: str) -> None:
    rows.select(F.col(column).cast("string")).sort(column).write.text(path)


def write_rejections(rows: DataFrame, reason: Column, path: str) -> None:
    """Rows that have a reason, with it."""
    rows.withColumn("reason", reason).where("reason is not null").write.json(path)


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.option("header", True).csv(path)


def encode_wav(signal, rate: int = 16000) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as f:
        f.setnchannels(1), f.setsampwidth(2), f.setframerate(rate)
        f.writeframes(np.clip(np.rint(np.asarray(signal, np.float64) * 32767), -32768, 32767).astype("<i2").tobytes())
    return out.getvalue()


@F.pandas_udf(T.BinaryType())
def wav_bytes(signals: pd.Series) -> pd.Series:
    """16-bit WAV files as bytes, to be written by any binary sink."""
    return signals.map(lambda s: None if s is None else encode_wav(s))


def write_wav(rows: DataFrame, folder: str, mode: str = "append") -> None:
    """rows (path below the folder, signal) as 16-bit WAV files, all of them or none; null signals have no file."""
    write_files(rows.where("signal is not null").select("path", wav_bytes("signal").alias("content")), folder, mode)
