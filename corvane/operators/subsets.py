"""Splits by family with a cross-check set, reports of splits and budgets, and pools of voices."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.operators.sampling import top_of_each


def with_splits(rows: DataFrame, assignment: DataFrame, category: str, family: str) -> DataFrame:
    """rows with the split of their family: assignment is category, family, split, a row for each family."""
    of = assignment.select(F.col("category").alias("_c"), F.col("family").alias("_f"), "split")
    return rows.join(F.broadcast(of), F.col(category).eqNullSafe(F.col("_c")) & F.col(family).eqNullSafe(F.col("_f"))).drop("_c", "_f")


def with_cross_flags(rows: DataFrame, key: str, category: str, each: int = 40) -> DataFrame:
    """rows (with split) and cross_selected: whether a test row is among the first `each` of its category; null elsewhere."""
    chosen = top_of_each(rows.where("split = 'test'").select(category, key), category, [key], each).select(F.col(key).alias("_k"), F.lit(True).alias("_in"))
    flag = F.when(F.col("split") == "test", F.coalesce("_in", F.lit(False)))
    return rows.join(chosen, F.col(key) == F.col("_k"), "left").withColumn("cross_selected", flag).drop("_k", "_in")


def split_report(rows: DataFrame, category: str, family: str) -> DataFrame:
    """split, category (null: all of the split), n, pct of all rows, n_families."""
    sets = rows.select("split", F.col(category).alias("category"), F.col(family).alias("family"))
    by = sets.groupBy("split", "category").agg(F.count("*").alias("n"), F.count_distinct("family").alias("n_families"))
    whole = sets.groupBy("split").agg(F.count("*").alias("n"), F.count_distinct("family").alias("n_families")).withColumn("category", F.lit(None).cast("string"))
    total = rows.agg(F.count("*").alias("total"))  # one row
    return whole.unionByName(by.where("category is not null")).join(F.broadcast(total)).withColumn("pct", F.round(100.0 * F.col("n") / F.col("total"), 2)).drop("total")


def subset_report(members: DataFrame, budgets: dict[str, float], amount: str, speaker: str, category: str) -> DataFrame:
    """subset, target, actual, n, n_speakers, speaker_min, speaker_max and by_category_pct (map) of nested budgets.

    members: rows with `subsets`, as nested_budgets() gives them. Counted by subset, speaker and category first.
    """
    cells = members.select(F.explode("subsets").alias("subset"), F.col(speaker).alias("speaker"), F.col(category).alias("category"), F.col(amount).alias("amount"))
    cells = cells.groupBy("subset", "speaker", "category").agg(F.count("*").alias("n"), F.sum("amount").alias("amount"))
    voices = cells.groupBy("subset", "speaker").agg(F.sum("n").alias("n"), F.sum("amount").alias("amount"))
    voices = voices.groupBy("subset").agg(F.sum("amount").alias("actual"), F.sum("n").alias("n"), F.count("*").alias("n_speakers"), F.min("n").alias("speaker_min"), F.max("n").alias("speaker_max"))
    kinds = cells.groupBy("subset", "category").agg(F.sum("n").alias("k")).groupBy("subset").agg(F.array_sort(F.collect_list(F.struct("category", "k"))).alias("kinds"))
    target = members.sparkSession.createDataFrame([(k, float(v)) for k, v in budgets.items()], "subset string, target double")
    share = F.map_from_entries(F.transform(F.filter("kinds", lambda x: x.category.isNotNull()), lambda x: F.struct(x.category, F.round(100.0 * x.k / F.col("n"), 2))))
    return target.join(voices, "subset", "left").join(kinds, "subset", "left").withColumn("by_category_pct", share).drop("kinds")


def pools(voices: pd.DataFrame, sizes: dict[str, int], rest: str = "train") -> pd.DataFrame:
    """voices (speaker_id, accent, gender, order) with pool: an inventory of a few dozen rows.

    Each pool takes accents in turn and genders in turn, the first free voice in `order` with that accent and gender,
    or else with that accent, or else the accent's turn passes; what is left goes to `rest`.
    """
    voices = voices.sort_values(["accent", "order", "speaker_id"], kind="stable").reset_index(drop=True)
    if sum(sizes.values()) > len(voices):
        raise ValueError("ran out of speakers")
    pool = pd.Series([None] * len(voices), dtype=object)
    accents, genders = sorted(voices.accent.unique()), sorted(voices.gender.unique())
    for name, size in sizes.items():
        turn = taken = 0
        while taken < size:
            free = pool.isna() & (voices.accent == accents[turn % len(accents)])
            turn += 1
            if free.any():
                fitting = free & (voices.gender == genders[taken % len(genders)])
                pool[(fitting if fitting.any() else free).idxmax()] = name
                taken += 1
    return voices.assign(pool=pool.fillna(rest))
