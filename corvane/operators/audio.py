"""Audio files: headers, screening, quality control, profiles, and the pairing of recordings with transcripts."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.functions import arrays
from corvane.functions.text import normalize
from corvane.operators.sampling import hash_order
from corvane.sources.files import read_files

PROFILE = "duration double, rms double, peak double, clipping_ratio double, speech_ratio double, silence_ratio double, snr_estimate_db double, decay_slope_db_per_s double, spectral_centroid_hz double, rolloff85_hz double"


def read_headers(spark: SparkSession, folder: str, kind: str = "noise") -> DataFrame:
    """path, size, rate, channels, seconds, bytes_read, error of the WAV and FLAC files below a folder or of a screened index, from
    ranged reads of their headers; an unreadable one has an error."""
    return read_files(spark, folder, "headers", kind=kind)


def paired(recordings: DataFrame, transcripts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Recordings (utt_id, path) with their transcripts (utt_id, text), and those that have none or an empty one."""
    joined = recordings.join(transcripts.select("utt_id", "text"), "utt_id", "left")
    there = F.coalesce(F.col("text"), F.lit("")) != ""
    return joined.where(there), joined.where(~there).drop("text")


def screened(clips: DataFrame, caps: dict[str, int], seed: int = 42) -> DataFrame:
    """clips (path, kind, signal, error) with duration, peak, reason (null: fine) and kept: the first caps[kind] fine ones in hash order.

    An impulse response ("rir") lasts from 0.02 to 5 s, noise 1 s at least; all must be finite and not silent.
    """
    stats = clips.withColumn("m", arrays.measure(F.col("signal"), clip_at=2.0)).withColumns({"duration": F.round("m.duration", 3), "peak": F.round("m.peak", 5)})
    rir = F.col("kind") == "rir"
    reason = (
        F.when(F.col("error").isNotNull() | F.col("signal").isNull(), F.concat(F.lit("unreadable: "), F.coalesce("error", F.lit("")))).when(F.col("m.n_samples") == 0, "empty").when(F.col("m.n_nonfinite") > 0, "non-finite samples")
        .when(F.col("m.peak") < 1e-6, "silent").when(rir & (F.col("m.duration") > 5.0), "impulse response too long").when(rir & (F.col("m.duration") < 0.02), "impulse response too short").when(~rir & (F.col("m.duration") < 1.0), "noise clip too short")
    )
    judged = stats.withColumn("reason", reason).drop("m")
    fine = judged.where("reason is null").select("path", "kind")
    limit = F.coalesce(*(F.when(F.col("kind") == k, F.lit(n)) for k, n in caps.items()), F.lit(0))
    chosen = [fine.where(F.col("kind") == k).orderBy(hash_order("path", seed=seed), "path").limit(n).select("path", F.lit(True).alias("_kept")) for k, n in caps.items()]
    kept = chosen[0]
    for more in chosen[1:]:
        kept = kept.unionByName(more)
    return judged.join(kept, "path", "left").withColumn("kept", F.coalesce("_kept", F.lit(False)) & (limit > 0)).drop("_kept")


def quality_control(files: DataFrame, limits: dict[str, float] | None = None, trim: bool = True) -> DataFrame:
    """path, passed, reasons, signal (trimmed) and the measures of files (path, signal, error); an unreadable file fails."""
    signal = arrays.trim_silence(F.col("signal")) if trim else F.col("signal")
    made = files.select("path", "error", signal.alias("signal")).withColumns({"m": arrays.measure(F.col("signal")), "s": arrays.silence_stats(F.col("signal"))})
    stats = {c: F.col(f"m.{c}") for c in ("n_samples", "duration", "peak", "rms", "clipping_ratio", "n_nonfinite", "is_all_zero")} | {c: F.col(f"s.{c}") for c in ("silence_ratio", "leading_silence", "trailing_silence")}
    unreadable = F.col("error").isNotNull() | F.col("signal").isNull()
    reasons = F.when(unreadable, F.array(F.concat(F.lit("unreadable: "), F.coalesce("error", F.lit(""))))).otherwise(arrays.qc_reasons(stats, limits))
    return made.select("path", "signal", reasons.alias("reasons"), *(F.when(~unreadable, c).alias(n) for n, c in stats.items())).withColumn("passed", F.size("reasons") == 0)


def quality_summary(results: DataFrame) -> DataFrame:
    """One row over results (passed, reasons, duration): counts, removal rate, reasons by rule, and durations of what passed.

    A reason counts by its rule, the text before " above" or " below". Percentiles are the values at index
    floor(share * n) of the sorted durations; durations are counted before they are ranked.
    """
    rule = F.regexp_replace("reason", r" (above|below) .*$", "")
    reasons = results.where("not passed").select(F.explode("reasons").alias("reason")).groupBy(rule.alias("rule")).agg(F.count("*").alias("n"))
    reasons = reasons.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("rule", "n")))).alias("failure_reasons"))
    counts = results.agg(F.count("*").alias("n_files"), F.count_if("passed").alias("n_passed"), F.count_if(~F.col("passed")).alias("n_failed"), F.round(F.try_divide(F.count_if(~F.col("passed")), F.count("*")), 5).alias("removal_rate"))
    from corvane.operators.validate import index_percentiles

    lasting = index_percentiles(results.where("passed").withColumn("_all", F.lit(1)), "duration", "_all", {"p10": 0.1, "median": 0.5, "p90": 0.9})
    lasting = lasting.select(F.round(F.col("mean") * F.col("n"), 2).alias("total_duration"), *(F.round(c, 3).alias(c) for c in ("min", "max", "mean", "p10", "median", "p90")))
    return counts.join(reasons).join(lasting, F.lit(True), "left")  # one row each


def independent_check(rows: DataFrame, above: float = 0.60) -> DataFrame:
    """Rows (audio, reference, hypothesis of another recogniser) whose error rate is above a loose limit; without a reference none."""
    made = rows.select("audio", normalize(F.col("reference")).alias("reference"), normalize(F.col("hypothesis")).alias("hypothesis"))
    cer = F.levenshtein("reference", "hypothesis") / F.char_length("reference")
    return made.where("reference <> ''").withColumn("cer", F.round(cer, 4)).where(cer > above).withColumn("reason", F.lit("catastrophic failure suspected"))


def profile_of(signal: np.ndarray, rate: int = arrays.SAMPLE_RATE, frame_ms: int = 25, hop_ms: int = 10) -> tuple | None:
    """Measures of a recording: speech by energy against its own distribution, noise level, decay after speech, spectrum; None if too short."""
    frame, hop = rate * frame_ms // 1000, rate * hop_ms // 1000
    if len(signal) < frame:
        return None
    energy = (np.lib.stride_tricks.sliding_window_view(signal, frame)[::hop] ** 2).mean(axis=1)
    db = 10 * np.log10(energy + 1e-12)
    low, high = np.percentile(db, [10, 95])
    speech = db > low + 0.45 * (high - low)
    mean = lambda x, empty: float(x.mean()) if len(x) else empty
    snr = 10 * np.log10((mean(energy[speech], 0.0) + 1e-12) / (mean(energy[~speech], 1e-12) + 1e-12))
    slopes = []
    for end in np.flatnonzero(speech[:-1] & ~speech[1:]) + 1:
        tail = db[end : end + 100 // hop_ms]
        if len(tail) >= 4:
            slopes.append(np.polyfit(np.arange(len(tail)) * hop_ms / 1000, tail, 1)[0])
    power = np.abs(np.fft.rfft(signal * np.hanning(len(signal)))) ** 2
    freqs, total = np.fft.rfftfreq(len(signal), 1 / rate), power.sum() + 1e-12
    rolloff = freqs[min(len(freqs) - 1, np.searchsorted(np.cumsum(power) / total, 0.85))]
    size = np.abs(signal)
    out = (len(signal) / rate, np.sqrt((signal**2).mean()), size.max(), (size >= 0.999).mean(), speech.mean(), 1 - speech.mean(), snr, np.median(slopes) if slopes else np.nan, (freqs * power).sum() / total, rolloff)
    return tuple(round(float(x), n) for x, n in zip(out, (3, 6, 4, 6, 4, 4, 2, 1, 1, 1)))


@F.pandas_udf(T.StructType([T.StructField(c.split()[0], T.DoubleType()) for c in PROFILE.split(", ")]))
def profile(signals: pd.Series) -> pd.DataFrame:
    """profile_of() each signal; nulls for those that are missing or shorter than a frame."""
    names = [c.split()[0] for c in PROFILE.split(", ")]
    rows = [None if s is None else profile_of(np.asarray(s, np.float64)) for s in signals]
    return pd.DataFrame([r or (np.nan,) * len(names) for r in rows], columns=names)


def augmented_corpus(rows: DataFrame, render: Callable[[DataFrame], DataFrame], limits: dict[str, float] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A new manifest, failures with reasons, and the planned and realised mix of rows (utt_id, signal, interferer, and more).

    Conditions are planned by weight; competing speech without an interferer becomes noise, and the manifest says so.
    render(): augment() or a stand-in for it. What it makes goes through quality control.
    """
    from corvane.operators.augment import plan_conditions

    planned = rows.join(plan_conditions(rows.select("utt_id"), "utt_id"), "utt_id")
    alone = (F.col("condition") == "competing_speech") & F.col("interferer").isNull()
    asked = planned.withColumns({"planned": F.col("condition"), "competing_speech_unavailable": alone}).withColumn("condition", F.when(alone, "noise").otherwise(F.col("condition")))
    made = render(asked).select("utt_id", "signal", "snr", "sir", F.col("error").alias("render_error"))
    judged = quality_control(made.select(F.col("utt_id").alias("path"), "signal", F.col("render_error").alias("error")), limits, trim=False).withColumnsRenamed({"path": "utt_id"})
    kept = asked.drop("signal", "snr", "sir", "interferer").join(made.select("utt_id", "snr", "sir"), "utt_id").join(judged.where("passed").select("utt_id", "signal", F.col("duration").alias("new_duration")), "utt_id")
    failures = judged.where("not passed").select("utt_id", F.array_join("reasons", "; ").alias("reason"))
    mix = asked.groupBy("planned").agg(F.count("*").alias("n_planned")).join(kept.groupBy("condition").agg(F.count("*").alias("n_realised")), F.col("planned") == F.col("condition"), "full")
    return kept, failures, mix.select(F.coalesce("planned", "condition").alias("condition"), F.coalesce("n_planned", F.lit(0)).alias("n_planned"), F.coalesce("n_realised", F.lit(0)).alias("n_realised"))


def identity_stability(rows: DataFrame, identity: str, value: str) -> DataFrame:
    """n, mean_spread, spread_of_means, ratio: how far a measure such as the median pitch varies within identities, against
    how far identities lie apart.

    Identities with fewer than two values don't count; null values are left out. Without any identity all but n are
    null, and the ratio is null if means don't differ.
    """
    each = rows.groupBy(identity).agg(F.stddev_pop(value).alias("s"), F.avg(value).alias("m"), F.count(value).alias("k")).where("k >= 2")
    return each.agg(F.count("*").alias("n"), F.avg("s").alias("mean_spread"), F.stddev_pop("m").alias("spread_of_means"), F.try_divide(F.avg("s"), F.stddev_pop("m")).alias("ratio"))
