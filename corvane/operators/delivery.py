"""Acceptance of a delivery of synthetic speech: findings by check, severity and split, and a verdict."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.operators.validate import impure_conditions, manifest_findings

LEVELS = ("FATAL", "ERROR", "WARN", "OK")


def finding(level: Column | str, check: str, split: Column | str, n: Column | str) -> list[Column]:
    return [(level if isinstance(level, Column) else F.lit(level)).alias("level"), F.lit(check).alias("check"), (split if isinstance(split, Column) else F.lit(split)).alias("split"), (n if isinstance(n, Column) else F.col(n)).cast("long").alias("n")]


def gate(rows: DataFrame, scripts: DataFrame, splits: tuple[str, ...] = ("train", "dev", "test"), hours: float = 20.0, renderings: int = 2, busiest: float = 0.10, removed: DataFrame | None = None, removal: float = 0.02, audio: DataFrame | None = None) -> DataFrame:
    """level, check, split, n (rows or keys at fault; 0 if fine), a row for each thing that a check says.

    rows: a manifest with split and script_id; scripts: split, script_id, text; removed: split, n of rows that quality
    control took out; audio: findings of audio_findings(). Checks: a manifest for each split; no speaker in two splits;
    texts as in the scripts, and script ids known (asked only where no text differs); hours of training speech;
    renderings of a script in training, and by as many voices; clean conditions; the busiest speaker's share; the
    schema; what quality control removed; audio files.
    """
    spark = rows.sparkSession
    every = spark.createDataFrame([(s,) for s in splits], "split string")
    there = rows.groupBy("split").agg(F.count("*").alias("rows"))
    sized = every.join(there, "split", "left")
    parts = [sized.where("rows is null").select(*finding("FATAL", "manifest present", F.col("split"), F.lit(1)))]

    shared = rows.select("speaker_id", "split").distinct().groupBy("speaker_id").agg(F.count("*").alias("k")).where("k > 1").agg(F.count("*").alias("n"))
    parts.append(shared.select(*finding(F.when(F.col("n") > 0, "FATAL").otherwise("OK"), "speaker pools disjoint", "all", "n")))

    source = scripts.select(F.col("split").alias("s_split"), F.col("script_id").alias("s_id"), F.col("text").alias("s_text"))
    joined = rows.join(source, (rows.split == F.col("s_split")) & (rows.script_id == F.col("s_id")), "left")
    fidelity = joined.groupBy("split").agg(F.count_if(F.col("s_id").isNotNull() & ~F.col("text").eqNullSafe(F.col("s_text"))).alias("differ"), F.count_if(F.col("s_id").isNull()).alias("unknown"))
    parts.append(fidelity.where("differ > 0 or unknown = 0").select(*finding(F.when(F.col("differ") > 0, "FATAL").otherwise("OK"), "text matches script", F.col("split"), "differ")))
    parts.append(fidelity.where("differ = 0 and unknown > 0").select(*finding("ERROR", "script_id resolvable", F.col("split"), "unknown")))

    train = rows.where("split = 'train'")
    lasting = train.agg(F.count("*").alias("k"), (F.coalesce(F.sum("duration"), F.lit(0.0)) / 3600).alias("h")).where("k > 0")
    parts.append(lasting.select(*finding(F.when(F.col("h") < hours, "ERROR").otherwise("OK"), "training hours", "train", F.floor("h"))))
    per_script = train.groupBy("script_id").agg(F.count("*").alias("k"), F.count_distinct("speaker_id").alias("voices"))
    counted = per_script.agg(F.count("*").alias("scripts"), F.count_if(F.col("k") != renderings).alias("wrong"), F.count_if(F.col("voices") < F.least(F.lit(renderings), F.col("k"))).alias("same")).where("scripts > 0")
    parts.append(counted.where("wrong > 0").select(*finding("ERROR", "renderings per script", "train", "wrong")))
    parts.append(counted.select(*finding(F.when(F.col("same") > 0, "ERROR").otherwise("OK"), "renderings use distinct voices", "train", "same")))

    unclean = there.join(impure_conditions(rows).groupBy("split").agg(F.count("*").alias("n")), "split", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    parts.append(unclean.select(*finding(F.when(F.col("n") > 0, "ERROR").otherwise("OK"), "condition is clean", F.col("split"), "n")))

    busy = rows.groupBy("split", "speaker_id").agg(F.count("*").alias("k")).groupBy("split").agg(F.max("k").alias("most"), F.sum("k").alias("all"))
    parts.append(busy.where(F.col("most") / F.col("all") > busiest).select(*finding("WARN", "speaker balance", F.col("split"), "most")))

    schema = reduce(DataFrame.unionByName, (manifest_findings(rows.where(F.col("split") == s)).where("level = 'error'").withColumn("split", F.lit(s)) for s in splits))
    parts.append(schema.groupBy("split").agg(F.count("*").alias("n")).select(*finding("FATAL", "manifest schema", F.col("split"), "n")))
    if removed is not None:
        rate = there.join(removed.select("split", "n"), "split").where(F.col("n") / (F.col("rows") + F.col("n")) > removal)
        parts.append(rate.select(*finding("WARN", "QC removal rate", F.col("split"), "n")))
    if audio is not None:
        parts.append(audio.select("level", "check", "split", "n"))
    return reduce(DataFrame.unionByName, parts)


def by_severity(findings: DataFrame) -> DataFrame:
    """Findings with place: the gravest first, then by check and split."""
    rank = reduce(lambda c, i: c.when(F.col("level") == LEVELS[i], i), range(1, len(LEVELS)), F.when(F.col("level") == LEVELS[0], 0))
    return findings.withColumn("severity", rank).orderBy("severity", "check", "split")


def verdict(findings: DataFrame) -> DataFrame:
    """n_fatal, n_error, n_warn, n_ok and REJECT if anything is fatal or an error, else ACCEPT."""
    counts = findings.agg(*(F.count_if(F.col("level") == x).alias(f"n_{x.lower()}") for x in LEVELS))
    return counts.withColumn("verdict", F.when(F.col("n_fatal") + F.col("n_error") > 0, "REJECT").otherwise("ACCEPT"))


def sampled(rows: DataFrame, order: str, limit: int) -> DataFrame:
    """Every k-th row, k being rows // limit; all rows if the limit is 0."""
    from corvane.operators.sampling import every_kth

    step = max(1, rows.count() // limit) if limit else 1
    return rows if step == 1 else every_kth(rows, order, step)


def audio_findings(rows: DataFrame, headers: DataFrame, tolerance: float = 0.05) -> DataFrame:
    """level, check, split, n of rows (split, utt_id, audio, duration) against headers (path, rate, channels, seconds, error).

    A row whose file has no header is missing; unreadable files and those that aren't 16 kHz mono have a wrong format;
    a declared duration may differ from the file's by `tolerance` seconds.
    """
    joined = rows.join(headers.withColumnRenamed("path", "audio"), "audio", "left")
    readable = F.col("rate").isNotNull()
    seen = joined.groupBy("split").agg(
        F.count_if(~readable & F.col("error").isNull()).alias("missing"), F.count_if(F.col("error").isNotNull() | readable & ((F.col("rate") != 16000) | (F.col("channels") != 1))).alias("format"),
        F.count_if(readable & (F.coalesce("duration", F.lit(0.0)) != 0) & (F.abs(F.col("seconds") - F.col("duration")) > tolerance)).alias("duration"),
    )
    checks = [("FATAL", "audio present", "missing"), ("FATAL", "audio format 16kHz mono", "format"), ("ERROR", "declared duration matches audio", "duration")]
    found = [seen.where(F.col(c) > 0).select(*finding(level, check, F.col("split"), c)) for level, check, c in checks]
    fine = seen.where("missing + format + duration = 0").select(*finding("OK", "audio", F.col("split"), F.lit(0)))
    return reduce(DataFrame.unionByName, found, fine)


def report_text(summary: dict[str, object], findings: DataFrame, title: str = "manifest", errors: int = 50, warnings: int = 20) -> str:
    """A validation report for a log: what the summary says, then the first errors and warnings (a bounded read)."""
    lines = [f"== {title} ==", *(f"{k:<18}: {v}" for k, v in summary.items())]
    for level, most in (("error", errors), ("warning", warnings)):
        of = findings.where(F.col("level") == level)
        n = of.count()
        lines += [f"  {level.upper():<7} {r.utt_id}: {r.finding}" for r in of.orderBy("utt_id", "finding").limit(most).collect()]
        lines += [f"  ... {n - most} more {level}s"] * (n > most)
    return "\n".join(lines)
