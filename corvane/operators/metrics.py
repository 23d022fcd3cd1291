"""Error rates, dictionary term metrics and significance."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions.text import edit_operations, term_counts
from corvane.sources.tables import save

UNSPECIFIED, UNCATEGORIZED = "UNSPECIFIED", "UNCATEGORIZED"


def error_rates() -> list[Column]:
    """Aggregates over rows with distance and reference_length; what has no reference is counted, not scored."""
    scored = F.col("reference_length") > 0
    rate = F.col("distance") / F.col("reference_length")
    sums = [F.sum(F.when(scored, F.col(c))).cast("long") for c in ("distance", "reference_length")]
    return [
        F.count_if(scored).alias("n_scored"), F.count_if(~scored).alias("n_empty_reference"), sums[0].alias("sum_distance"), sums[1].alias("sum_reference"),
        F.try_divide(sums[0], sums[1]).alias("cer"), F.avg(F.when(scored, F.least(rate, F.lit(1.0)))).alias("macro_cer"),
    ]


def score(pairs: DataFrame, with_kinds: bool = False) -> DataFrame:
    """pairs (reference, hypothesis: normalized) with distance and reference_length, and on demand the kinds of edits."""
    out = pairs.withColumn("reference_length", F.char_length("reference"))
    if with_kinds:
        return out.withColumn("e", edit_operations("reference", "hypothesis")).select("*", "e.*").drop("e")
    return out.withColumn("distance", F.levenshtein("reference", "hypothesis").cast("long"))


def corpus_cer(scored: DataFrame) -> DataFrame:
    """Distances over reference lengths, summed; the macro rate caps each row at 1. All null if nothing is scorable."""
    return scored.agg(*error_rates())


def grouped_cer(scored: DataFrame, key: str) -> DataFrame:
    """corpus_cer for each value of a column; null makes a group of its own."""
    return scored.groupBy(F.coalesce(F.col(key).cast("string"), F.lit(UNSPECIFIED)).alias(key)).agg(*error_rates())


def cer_grouping_sets(scored: DataFrame, keys: list[str]) -> DataFrame:
    """The rates overall and by each of several columns in one pass: dimension, value, and the rates."""
    named = [F.struct(F.lit("overall").alias("dimension"), F.lit("all").alias("value"))]
    named += [F.struct(F.lit(k).alias("dimension"), F.coalesce(F.col(k).cast("string"), F.lit(UNSPECIFIED)).alias("value")) for k in keys]
    rows = scored.select("distance", "reference_length", F.explode(F.array(*named)).alias("d"))
    return rows.groupBy(F.col("d.dimension").alias("dimension"), F.col("d.value").alias("value")).agg(*error_rates())


def paired(a: DataFrame, b: DataFrame, key: str = "utt_id") -> DataFrame:
    """Two systems' scores side by side; an error if an utterance is missing on a side or its reference differs."""
    side = lambda df, x: df.select(F.col(key).alias(f"key_{x}"), F.col("distance").alias(f"distance_{x}"), F.col("reference_length").alias(f"length_{x}"))
    both = side(a, "a").join(side(b, "b"), F.expr("key_a <=> key_b"), "full")
    wrong = F.col("length_a").isNull() | F.col("length_b").isNull() | (F.col("length_a") != F.col("length_b"))
    length = F.when(wrong, F.raise_error(F.concat(F.lit("unpaired row or different reference: "), F.coalesce(F.col("key_a"), F.col("key_b")).cast("string")))).otherwise(F.col("length_a"))
    return both.select(F.coalesce("key_a", "key_b").alias(key), "distance_a", "distance_b", length.cast("int").alias("reference_length"))


def disagreements(pairs: DataFrame, key: str = "utt_id", top: int = 8) -> DataFrame:
    """The rows on which two systems differ most, ties by key; rows without a reference don't count."""
    delta = (F.col("distance_a") - F.col("distance_b")) / F.col("reference_length")
    return pairs.where("reference_length > 0").withColumn("delta", delta).where("delta <> 0").orderBy(F.desc(F.abs("delta")), key).limit(top)


def term_hits(rows: DataFrame, lexicon: DataFrame, terms: list[str], key: str, text: str) -> DataFrame:
    """key, term, category, n for each dictionary term found in a text; terms of no category are UNCATEGORIZED."""
    found = rows.select(key, F.explode(term_counts(F.col(text), terms)).alias("term", "n"))
    return found.join(lexicon.select("term", "category"), "term", "left").select(key, "term", F.coalesce("category", F.lit(UNCATEGORIZED)).alias("category"), "n")


def term_recall(pairs: DataFrame, lexicon: DataFrame, terms: list[str], key: list[str]) -> DataFrame:
    """key, term, category, n_reference, n_hit: for each term of a reference how many of it the hypothesis has too."""
    reference = pairs.select(*key, F.explode(term_counts(F.col("reference"), terms)).alias("term", "n_reference"), term_counts(F.col("hypothesis"), terms).alias("h"))
    hit = F.least("n_reference", F.coalesce(F.element_at("h", F.col("term")), F.lit(0)))
    joined = reference.withColumn("n_hit", hit).drop("h").join(lexicon.select("term", "category"), "term", "left")
    return joined.withColumn("category", F.coalesce("category", F.lit(UNCATEGORIZED)))


def term_metrics(recall: DataFrame, key: list[str]) -> DataFrame:
    """Over utterances with terms: n, terms, hits, recall, error rate and the share in which all terms are right."""
    each = recall.groupBy(*key).agg(F.sum("n_reference").alias("r"), F.sum("n_hit").alias("h"))
    return each.agg(
        F.count("*").alias("n_utterances"), F.sum("r").alias("n_reference"), F.sum("h").alias("n_hit"), F.try_divide(F.sum("h"), F.sum("r")).alias("recall"),
        (1 - F.try_divide(F.sum("h"), F.sum("r"))).alias("error_rate"), F.try_divide(F.count_if(F.col("r") == F.col("h")), F.count("*")).alias("exact_match"),
    )


def term_categories(recall: DataFrame) -> DataFrame:
    return recall.groupBy("category").agg(F.sum("n_reference").alias("n_reference"), F.sum("n_hit").alias("n_hit"), F.try_divide(F.sum("n_hit"), F.sum("n_reference")).alias("recall"))


def lexicon_collisions(lexicon: DataFrame) -> DataFrame:
    """Terms that stand in more than one category."""
    return lexicon.groupBy("term").agg(F.count_distinct("category").alias("n_categories")).where("n_categories > 1")


def bootstrap_lcg(pairs: DataFrame, replicates: int, a: int = 7919, b: int = 104729, c: int = 1299709) -> DataFrame:
    """replicate, diff: corpus error rates of system a less b over resampled rows, drawn by an integer rule.

    pairs: number (0 to n - 1), distance_a, distance_b, reference_length. Draw i of replicate r is row
    (a * r + b * i + c * r * i) mod n, so that SQL can draw the same rows. No draw is made: i goes through a residue
    class modulo g, the greatest common divisor of n and b + c * r, so row x is drawn g times if x - a * r is divisible
    by g and never if not. Rows are summed by residue class once for each g that occurs, a divisor of n.
    """
    n = pairs.count()
    if not n:
        return pairs.sparkSession.createDataFrame([], "replicate long, diff double")
    steps = [math.gcd((b + c * r) % n, n) for r in range(replicates)]
    rules = pairs.sparkSession.createDataFrame([(r, g, a * r % n % g) for r, g in enumerate(steps)], "replicate long, g long, residue long")
    kinds = pairs.select("number", "distance_a", "distance_b", "reference_length", F.explode(F.array(*(F.lit(g).cast("long") for g in sorted(set(steps))))).alias("g"))
    classes = kinds.groupBy("g", F.pmod(F.col("number"), F.col("g")).alias("residue")).agg(*(F.sum(x).alias(x) for x in ("distance_a", "distance_b", "reference_length")))
    drawn = rules.join(classes, ["g", "residue"])  # g cancels: every row of the class is drawn as often
    return drawn.select("replicate", ((F.col("distance_a") - F.col("distance_b")) / F.col("reference_length")).alias("diff"))


#: Parts of the hash range whose rows are drawn from together: their counts, one number each, are all the driver sees.
PARTS = 1 << 12


def _split_draws(counts: np.ndarray, part: int, replicates: np.ndarray, n: int, seed: int) -> np.ndarray:
    """How many of the n draws of each replicate fall to a part of the hash range, of parts with `counts` rows.

    n is split down a binary tree over the parts, at each node by a binomial draw with the share of its lower half, from
    a stream of the node's own. Whoever follows a path draws the same, and what the leaves get adds up to n.
    """
    low, high, draws = 0, len(counts), np.full(len(replicates), n, np.int64)
    node = 1
    while high - low > 1:
        middle = (low + high) // 2
        lower, whole = int(counts[low:middle].sum()), int(counts[low:high].sum())
        stream = np.random.Generator(np.random.Philox(key=[seed, node << 32 | int(replicates[0])]))
        taken = stream.binomial(draws, lower / whole if whole else 0.0)
        if part < middle:
            high, draws, node = middle, taken, 2 * node
        else:
            low, draws, node = middle, draws - taken, 2 * node + 1
    return draws


def multinomial_sums(pairs: DataFrame, replicates: int, seed: int = 42, parts: int = PARTS, together: int = 128) -> DataFrame:
    """replicate, a, b, n, draws: for each replicate n rows are drawn from n rows with replacement, and their sums.

    Sums can't tell rows with equal values apart, so equal rows are counted first and drawn as one with a weight, however
    many they are. A hash of the values sorts them into parts; n is split over these down a binary tree, and inside a
    part by a multinomial draw in the order of values, seeded by part and replicate. So the draws of a replicate add
    up to n, no row or draw leaves its task but in sums, and any partitioning gives the same rows.
    """
    values = ["distance_a", "distance_b", "reference_length"]
    rows = pairs.groupBy(*(F.col(c).cast("long").alias(c) for c in values)).agg(F.count("*").alias("weight"))
    rows = save(rows.withColumn("part", F.pmod(F.xxhash64(*values), F.lit(parts)).cast("int")), "draws")
    counts = np.zeros(parts, np.int64)
    for r in rows.groupBy("part").agg(F.sum("weight").alias("n")).collect():  # bounded by `parts`
        counts[r.part] = r.n
    n = int(counts.sum())

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, part, held = np.zeros((replicates, 4), np.int64), None, []

        def add() -> None:
            x = pd.concat(held)[[*values, "weight"]].to_numpy(np.int64)
            share = x[:, 3] / x[:, 3].sum()
            for first in range(0, replicates, together):
                numbers = np.arange(first, min(first + together, replicates))
                draws = _split_draws(counts, part, numbers, n, seed)
                stream = np.random.Generator(np.random.Philox(key=[seed ^ 0x5EED, part << 32 | first]))
                drawn = stream.multinomial(draws, share)
                total[numbers, :3] += drawn @ x[:, :3]
                total[numbers, 3] += draws

        for batch in batches:
            for now, some in batch.groupby("part", sort=False):
                if part is not None and now != part:
                    add()
                    held = []
                part = int(now)
                held.append(some)
        if held:
            add()
        yield pd.DataFrame(total, columns=["a", "b", "n", "draws"]).assign(replicate=np.arange(replicates))

    dealt = rows.repartition("part").sortWithinPartitions("part", *values)
    sums = dealt.mapInPandas(draw, "a long, b long, n long, draws long, replicate long")
    return sums.groupBy("replicate").agg(*(F.sum(c).alias(c) for c in ("a", "b", "n", "draws")))


def bootstrap(pairs: DataFrame, replicates: int = 10000, seed: int = 42, confidence: float = 0.95) -> DataFrame:
    """n, cer_a, cer_b, diff, low, high, p_value, significant: a paired bootstrap in which both systems share the drawn rows.

    Each replicate draws n of n rows with replacement (multinomial_sums). The interval takes the sorted differences at
    index floor(alpha * n) and ceil((1 - alpha) * n) - 1; the p-value is twice the share of differences on the other
    side of 0 from the observed. Rows without a reference don't count; without any row that does, it raises.
    """
    kept = pairs.where("reference_length > 0").select("distance_a", "distance_b", "reference_length")
    whole = kept.agg(F.count("*").alias("n"), *(F.sum(c).cast("double").alias(c) for c in ("distance_a", "distance_b", "reference_length"))).first()
    if not whole.n:
        raise ValueError("nothing to compare: no row has a reference")
    observed = (whole.distance_a - whole.distance_b) / whole.reference_length
    diffs = multinomial_sums(kept, replicates, seed).select(((F.col("a") - F.col("b")) / F.col("n")).alias("d"))
    ordered = diffs.agg(F.array_sort(F.collect_list("d")).alias("d"))  # a number for each replicate
    alpha, k = (1 - confidence) / 2, F.size("d")
    low, high = F.greatest(F.lit(0), F.floor(alpha * k).cast("int")), F.least(k - 1, F.ceil((1 - alpha) * k).cast("int") - 1)
    other = F.size(F.filter("d", (lambda x: x <= 0) if observed >= 0 else (lambda x: x >= 0)))
    out = ordered.select(F.lit(whole.n).alias("n"), F.lit(whole.distance_a / whole.reference_length).alias("cer_a"), F.lit(whole.distance_b / whole.reference_length).alias("cer_b"), F.lit(observed).alias("diff"), F.get("d", low).alias("low"), F.get("d", high).alias("high"), F.least(F.lit(1.0), 2 * other / k).alias("p_value"))
    return out.withColumn("significant", (F.col("low") > 0) | (F.col("high") < 0))


def significance_report(pairs: DataFrame, key: str = "utt_id", top: int = 8, **settings) -> DataFrame:
    """bootstrap()'s row with `disagreements`: the rows on which the two systems differ most, the largest first."""
    fields = ["delta", key, "distance_a", "distance_b", "reference_length"]
    most = disagreements(pairs, key, top).select(F.abs("delta").alias("size"), *fields).agg(F.collect_list(F.struct("size", *fields)).alias("d"))  # `top` rows
    ordered = F.array_sort("d", lambda x, y: F.when(x.size > y.size, -1).when(x.size < y.size, 1).when(x[key] < y[key], -1).when(x[key] > y[key], 1).otherwise(0))
    shown = most.select(F.lit(1).alias("one"), F.transform(ordered, lambda x: F.struct(*(x[f].alias(f) for f in [key, *fields[:1], *fields[2:]]))).alias("disagreements"))
    return bootstrap(pairs, **settings).withColumn("one", F.lit(1)).join(shown, "one").drop("one")
