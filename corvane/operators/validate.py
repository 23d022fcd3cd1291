"""Manifest validation and acceptance gates: what is wrong is reported, never raised."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of manifests.
SOURCES = ("synthetic_qwen3tts", "synthetic_cosyvoice3", "human", "public")
CONDITIONS = ("clean", "noise", "reverb", "noise_reverb", "competing_speech", "codec", "human_quiet", "human_farfield", "human_noisy", "public_clean", "public_noisy")
CATEGORIES = ("chief_complaint", "examination", "registration", "navigation", "disease", "medication", "numeric", "code_switch", "disfluency")
NOISY, COMPETING, CLEAN = ("noise", "noise_reverb"), "competing_speech", "clean"
REQUIRED = ("utt_id", "audio", "text", "speaker_id", "source", "domain_category", "template_family", "duration", "condition")


def manifest_findings(rows: DataFrame, conditions: tuple[str, ...] = CONDITIONS, categories: tuple[str, ...] = CATEGORIES, sources: tuple[str, ...] = SOURCES) -> DataFrame:
    """utt_id, level (error or warning), finding: a row for each thing that is wrong with a manifest row.

    All predicates are one array column, so rows are read once; only repeated ids take an aggregation more.
    """
    there = lambda c: F.col(c).isNotNull()
    known = lambda c, values: F.coalesce(F.col(c).isin(*values), F.lit(False))
    rules: list[tuple[str, str, Column]] = [("error", f"missing {c}", ~there(c)) for c in REQUIRED]
    rules += [
        ("error", "blank text", F.trim(F.coalesce("text", F.lit(""))) == ""),
        ("error", "unknown source", ~known("source", sources)),
        ("error", "unknown condition", ~known("condition", conditions)),
        # general is the category of public speech, which stands outside the taxonomy
        ("warning", "category outside the taxonomy", ~known("domain_category", categories) & ~(known("domain_category", ("general",)) & known("source", ("public",)))),
        ("error", "noise without snr", F.col("condition").isin(*NOISY) & ~there("snr")),
        ("error", "competing speech without sir", (F.col("condition") == COMPETING) & ~there("sir")),
        ("error", "clean with snr or sir", (F.col("condition") == CLEAN) & (there("snr") | there("sir"))),
        ("error", "duration not positive", F.col("duration") <= 0),
        ("warning", "duration over 30 s", F.col("duration") > 30),
    ]
    found = F.array_compact(F.array(*(F.when(wrong, F.struct(F.lit(level).alias("level"), F.lit(what).alias("finding"))) for level, what, wrong in rules)))
    each = rows.select("utt_id", F.explode(found).alias("f")).select("utt_id", "f.level", "f.finding")
    repeated = rows.where("utt_id is not null").groupBy("utt_id").count().where("count > 1")
    return each.unionByName(repeated.select("utt_id", F.lit("error").alias("level"), F.lit("repeated utt_id").alias("finding")))


def manifest_summary(rows: DataFrame) -> DataFrame:
    return rows.agg(
        F.count("*").alias("n_utterances"), F.sum(F.coalesce("duration", F.lit(0.0))).alias("duration"), (F.sum(F.coalesce("duration", F.lit(0.0))) / 3600).alias("hours"),
        F.count_distinct("speaker_id").alias("n_speakers"), F.count_distinct("template_family").alias("n_families"),
    )


def counts_by(rows: DataFrame, keys: list[str]) -> DataFrame:
    """dimension, value, n for several columns in one pass."""
    named = F.array(*(F.struct(F.lit(k).alias("dimension"), F.coalesce(F.col(k).cast("string"), F.lit("UNSPECIFIED")).alias("value")) for k in keys))
    return rows.select(F.explode(named).alias("d")).groupBy("d.dimension", "d.value").agg(F.count("*").alias("n"))


def foreign_keys(rows: DataFrame, known: DataFrame, key: str, text: str) -> DataFrame:
    """key, finding: rows whose key is unknown or whose text isn't that of the key."""
    joined = rows.select(key, text).join(known.select(F.col(key).alias("_key"), F.col(text).alias("_text")), F.expr(f"{key} = _key"), "left")
    finding = F.when(F.col("_key").isNull(), "unknown key").when(~F.col(text).eqNullSafe(F.col("_text")), "text differs")
    return joined.select(key, finding.alias("finding")).where("finding is not null")


def shared_between_splits(rows: DataFrame, key: str, split: str = "split") -> DataFrame:
    """split_a < split_b and the number of keys that both have."""
    each = rows.select(key, split).distinct()
    a, b = (each.select(key, F.col(split).alias(f"split_{x}")) for x in "ab")
    return a.join(b, key).where("split_a < split_b").groupBy("split_a", "split_b").agg(F.count("*").alias("n_shared"))


def impure_conditions(rows: DataFrame) -> DataFrame:
    """Rows of a set that should be clean and aren't."""
    return rows.where((F.coalesce("condition", F.lit("")) != CLEAN) | F.col("snr").isNotNull() | F.col("sir").isNotNull())


def renderings(rows: DataFrame, key: str) -> DataFrame:
    """How many keys have how many rows."""
    return rows.groupBy(key).agg(F.count("*").alias("n_rows")).groupBy("n_rows").agg(F.count("*").alias("n_keys"))


def busiest_share(rows: DataFrame, key: str) -> DataFrame:
    counts = rows.groupBy(key).agg(F.count("*").alias("n"))
    return counts.agg(F.max("n").alias("busiest"), F.sum("n").alias("n_rows"), (F.max("n") / F.sum("n")).alias("share"))


def verdict(findings: DataFrame) -> DataFrame:
    """Counts by level and whether the delivery is accepted: only without anything fatal and without errors."""
    level = F.lower("level")
    n = lambda x: F.count_if(level == x).alias(f"n_{x}")
    return findings.agg(n("fatal"), n("error"), n("warning")).withColumn("verdict", F.when(F.col("n_fatal") + F.col("n_error") > 0, "rejected").when(F.col("n_warning") > 0, "accepted with warnings").otherwise("accepted"))


def index_percentiles(rows: DataFrame, value: str, by: str, shares: dict[str, float]) -> DataFrame:
    """n, least, greatest, mean and the values at index floor(share * n) of each group, counted from 0.

    Values are counted before they are ranked, so a group is as many rows as it has distinct values.
    """
    from pyspark.sql.window import Window

    counted = rows.where(F.col(value).isNotNull()).groupBy(by, value).agg(F.count("*").alias("_k"))
    upto = counted.withColumn("upto", F.sum("_k").over(Window.partitionBy(by).orderBy(value))).withColumn("n", F.sum("_k").over(Window.partitionBy(by)))
    at = lambda q: F.floor(F.lit(q) * F.col("n"))
    picks = [F.max(F.when((F.col("upto") > at(q)) & (F.col("upto") - F.col("_k") <= at(q)), F.col(value))).alias(name) for name, q in shares.items()]
    return upto.groupBy(by).agg(F.max("n").alias("n"), F.min(value).alias("min"), F.max(value).alias("max"), (F.sum(F.col(value) * F.col("_k")) / F.max("n")).alias("mean"), *picks)
