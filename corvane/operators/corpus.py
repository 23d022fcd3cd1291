"""A corpus from templates: capacities, quotas, fillings, first-come dedup."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvane.functions.text import dedup_key, trigram_codes
from corvane.operators import dedup, sampling, templates
from corvane.sources.sums import prefix_sums


def generate(patterns: DataFrame, slot_values: DataFrame, shares: DataFrame, total: int, save: Callable[[DataFrame, str], DataFrame], threshold: float = 0.9) -> DataFrame:
    """script_id, text, category, family_id, n_chars: up to `total` scripts that are no duplicates of each other.

    patterns: pattern_id, family_id, category, pattern; slot_values: slot, position, value; shares: category, share.
    Each family gets its quota by capacity, its patterns are filled, and of texts that are equal or similar after
    normalization the first in hash order stays.
    """
    sizes = slot_values.groupBy("slot").agg(F.count("*").cast("int").alias("size"))
    capacities = templates.family_capacities(templates.pattern_capacities(patterns, sizes))
    order = Window.partitionBy("category").orderBy("family_id")
    families = capacities.join(shares, "category").select("category", "share", F.col("family_id").alias("family"), (F.row_number().over(order) - 1).alias("position"), "capacity")
    quota = save(sampling.allocate_quota(families, total), "corpus-quota").select(F.col("family").alias("family_id"), "quota")
    made = templates.fillings(patterns, slot_values, total).join(patterns.select("pattern_id", "family_id", "category"), "pattern_id")
    made = save(made.withColumn("key", F.md5(dedup_key(F.col("text")))), "corpus-made")
    rank = F.row_number().over(Window.partitionBy("family_id").orderBy("key", "pattern_id", "index"))
    first = dedup.first_of_each(made.withColumn("place", F.struct("pattern_id", "index")), "key", "place")
    chosen = first.withColumn("rank", rank).join(quota, "family_id").where("rank <= quota")
    # the normalized form has a Python function in it, which can't stand under the lambda of the grams
    numbered = save(chosen.select(F.xxhash64("key").alias("id"), "text", "category", "family_id", dedup_key(F.col("text")).alias("form")), "corpus-chosen")
    grams = save(numbered.select("id", trigram_codes(F.col("form")).alias("grams")), "corpus-grams")
    accepted = dedup.accept_greedily(grams, dedup.near_pairs(grams, save, threshold, dedup.part_pairs), save).where("accepted").select("id")
    kept = numbered.join(accepted, "id", "left_semi")
    return kept.select(F.concat(F.lit("SCR-"), "family_id", F.lit("-"), F.substring(F.sha1("text"), 1, 12)).alias("script_id"), "text", "category", "family_id", F.char_length("text").alias("n_chars"))


@dataclass(frozen=True)
class Corpus:
    """Scripts, what became of every drawn text and every place that stayed empty, and the families that fell short."""

    rows: DataFrame
    counts: dict[str, int]
    shortfalls: DataFrame


def _in_rounds(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each row's round and the k at which that round stops, for rows in the order of pattern_id and k; -1 behind the last place that a pattern wants.

    A round has as many rows as the pattern lacks when it begins (wanted - n), and taken tells which of them fill a place.
    """
    pattern = None
    for batch in batches:
        ids, k, taken = (batch[c].to_numpy() for c in ("pattern_id", "k", "taken"))
        number, stops = np.full(len(ids), -1, np.int64), np.zeros(len(ids), np.int64)
        ends, at = np.append(np.flatnonzero(ids[1:] != ids[:-1]) + 1, len(ids)), 0
        for end in ends:
            if ids[at] != pattern:
                pattern, lacks, rounds, won = ids[at], int(batch.lacks.iloc[at]), 0, 0
                stop = int(k[at]) + lacks
            while at < end and lacks:
                upto = min(end, at + stop - int(k[at]))
                number[at:upto], stops[at:upto] = rounds, stop
                won += int(np.count_nonzero(taken[at:upto]))
                if k[upto - 1] + 1 == stop:
                    lacks, rounds, won = lacks - won, rounds + 1, 0
                    stop += lacks
                at = upto
            at = end
        yield pd.DataFrame({"pattern_id": ids, "k": k, "taken": taken, "round": number, "stop": stops})


def _judge(made: DataFrame, kept: DataFrame | None, asked: DataFrame, save, threshold: float) -> DataFrame:
    """pattern_id, k, taken, round, stop of all drawn rows: what drawing in rounds makes of them, without a job for each round.

    A row is taken if it is the first of its set of grams and near none taken before it, in the order of round, pattern_id and
    k. What is taken decides how far a round reaches, and rounds decide the order, but only between patterns: rows of one
    pattern stand in the order of k. So rounds are guessed, rows judged in that order, and rounds told from what was
    taken, until the order of rows that are alike is the one they were judged in. Each turn settles one round more at least.
    """
    sets = made.where("not doubled").select("set", "grams", F.lit(False).alias("old"))
    sets = sets if kept is None else sets.unionByName(kept.select("set", "grams", F.lit(True).alias("old")))
    different = save(sets.groupBy("set").agg(F.any_value("grams").alias("grams"), F.bool_or("old").alias("old")).withColumn("id", F.monotonically_increasing_id()), "corpus-sets")
    old = lambda x: different.select(F.col("id").alias(x), F.col("old").alias(f"old_{x}"))
    near = dedup.similar(different.select("id", "grams"), save, threshold, dedup.part_pairs)
    near = save(near.select("a", "b").join(old("a"), "a").join(old("b"), "b"), "corpus-near")
    met = near.where("old_b and not old_a").select(F.col("a").alias("id")).unionByName(near.where("old_a and not old_b").select(F.col("b").alias("id")))
    free = different.where("not old").select("id", "set").join(met, "id", "left_anti")
    places = save(made.where("not doubled").select("pattern_id", "k", "set").join(free, "set").select("pattern_id", "k", "id"), "corpus-places")
    of_sets = places.groupBy("id").agg(F.min("pattern_id").alias("p"), F.max("pattern_id").alias("q"))
    side = lambda x: of_sets.select(F.col("id").alias(x), F.col("p").alias(f"p_{x}"), F.col("q").alias(f"q_{x}"))
    links = save(near.where("not old_a and not old_b").join(side("a"), "a").join(side("b"), "b").select("a", "b", (F.greatest("q_a", "q_b") > F.least("p_a", "p_b")).alias("crosses")), "corpus-links")
    crosses = links.where("crosses").limit(1).count() + of_sets.where("p < q").limit(1).count() > 0
    before, rounds = None, None
    while True:
        if rounds is None:
            ranked = places.join(asked.select("pattern_id", "first", "lacks"), "pattern_id").withColumn("round", (F.col("k") >= F.col("first") + F.col("lacks")).cast("long"))
        else:
            ranked = places.join(rounds.select("pattern_id", "k", F.when(F.col("round") < 0, F.lit((1 << 62) - 1)).otherwise(F.col("round")).alias("round")), ["pattern_id", "k"])
        earliest = ranked.groupBy("id").agg(F.min(F.struct("round", "pattern_id", "k")).alias("place"))
        earliest = save(earliest, "corpus-earliest")
        place = lambda x: earliest.select(F.col("id").alias(x), F.col("place").alias(f"place_{x}"))
        later = F.col("place_a") > F.col("place_b")
        ordered = links.join(place("a"), "a").join(place("b"), "b").select(F.when(later, F.col("b")).otherwise(F.col("a")).alias("a"), F.when(later, F.col("a")).otherwise(F.col("b")).alias("b"))
        ordered = save(ordered, "corpus-ordered")
        firsts = earliest.select("id", "place.pattern_id", "place.k")
        if before is not None and not firsts.exceptAll(before[0]).limit(1).count() and not ordered.exceptAll(before[1]).limit(1).count():
            return rounds
        before = firsts, ordered
        accepted = dedup.accept_greedily(firsts.select("id"), ordered, save).where("accepted")
        taken = firsts.join(accepted, "id").select("pattern_id", "k", F.lit(True).alias("taken"))
        rows = made.select("pattern_id", "k").join(taken, ["pattern_id", "k"], "left").join(asked.select("pattern_id", "lacks"), "pattern_id")
        rows = rows.select("pattern_id", "k", F.coalesce("taken", F.lit(False)).alias("taken"), "lacks").repartition("pattern_id").sortWithinPartitions("pattern_id", "k")
        rounds = save(rows.mapInPandas(_in_rounds, rows.select("pattern_id").schema.add("k", "long").add("taken", "boolean").add("round", "long").add("stop", "long")), "corpus-rounds")
        if not crosses:
            return rounds


def build(patterns: DataFrame, slot_values: DataFrame, shares: DataFrame, total: int, save: Callable[[DataFrame, str], DataFrame], pairs: DataFrame | None = None, threshold: float = 0.9, seed: int = 42) -> Corpus:
    """A corpus with a quota for each pattern: texts are drawn, judged and drawn again until quotas or capacities are met.

    patterns: pattern_id, family_id, category, pattern, and with `pairs` a pair (see templates.pattern_capacities). Families
    get quotas by capacity, their patterns by theirs. In each round every pattern draws as many new fillings as it lacks.
    A filling is refused for two slots with one value, for the normalized form of an earlier text, or for near
    duplication of an accepted one; earlier rounds go before later ones, and inside a round pattern_id and number decide.
    Reasons are counted by observing the rows as they are written. counts: requested, drawn, accepted, doubled_value,
    exact_duplicate, near_duplicate and quota_unfilled: drawn ones are accepted or refused for one reason, and what was
    requested (as far as categories have families) is accepted or unfilled.

    Where most fillings are near duplicates there are very many rounds of few rows. They are therefore made ahead: twice as
    many fillings as a pattern wants, then four times as many as before, and all rounds for which every pattern has the
    rows are judged together, with the same result. What is made and not reached isn't drawn, and not counted.
    """
    # read at every draw, and small, whatever they come from
    patterns, slot_values = save(patterns, "corpus-patterns"), save(slot_values, "corpus-values")
    pairs = save(pairs, "corpus-pairs") if pairs is not None else None
    sizes = slot_values.groupBy("slot").agg(F.count("*").cast("int").alias("size"))
    capacities = save(templates.pattern_capacities(patterns, sizes, pairs), "corpus-capacities")
    order = Window.partitionBy("category").orderBy("family_id")
    families = templates.family_capacities(capacities).join(shares, "category").select("category", "share", F.col("family_id").alias("family"), (F.row_number().over(order) - 1).alias("position"), "capacity")
    quota = save(sampling.allocate_quota(families, total).select(F.col("family").alias("family_id"), "quota"), "corpus-quota")
    wanted = save(templates.pattern_quotas(capacities, quota), "corpus-wanted")
    counts = dict.fromkeys(("drawn", "accepted", "doubled_value", "exact_duplicate", "near_duplicate"), 0)
    none = F.lit(0).cast("long")
    kept, state = None, wanted.select("pattern_id", "capacity", "wanted", none.alias("first"), none.alias("n"), none.alias("last"))
    while True:
        lacks = F.col("wanted") - F.col("n")
        ahead = F.least("capacity", F.greatest(F.col("first") + lacks, 2 * F.col("wanted") + 8, 4 * F.col("last")))
        asked = state.where((lacks > 0) & (F.col("first") < F.col("capacity"))).select("pattern_id", "capacity", "first", lacks.alias("lacks"), ahead.alias("last"))
        if not asked.limit(1).count():
            break
        made = templates.drawn(patterns.join(asked.select("pattern_id", "first", "last"), "pattern_id"), slot_values, pairs, seed)
        made = save(made.withColumn("form", dedup_key(F.col("text"))).select("pattern_id", "k", "text", "doubled", "form"), "corpus-made")
        made = made.withColumn("key", F.when(~F.col("doubled"), F.md5("form"))).withColumn("grams", trigram_codes(F.col("form")))
        made = save(made.withColumn("set", dedup.set_of("grams")), "corpus-drawn")
        rounds = _judge(made, kept, asked, save, threshold)
        # as far as every pattern has the rows of a round
        upto = rounds.join(asked.select("pattern_id", "capacity", "last"), "pattern_id").where("round >= 0 and stop > last and last < capacity").agg(F.min("round")).first()[0]
        reached = rounds.where("round >= 0" + (f" and round < {upto}" if upto is not None else "")).drop("stop")
        drawn = made.join(reached, ["pattern_id", "k"])
        place = F.struct("pattern_id", "k")
        earliest = drawn.where("not doubled").groupBy("round", "key").agg(F.min(place).alias("earliest"))
        known = drawn.where("taken").select("key", F.col("round").alias("known"))
        known = known if kept is None else known.unionByName(kept.select("key", F.lit(-1).cast("long").alias("known")))
        copy = (F.coalesce("known", "round") < F.col("round")) | (place != F.col("earliest"))
        reason = F.when(F.col("doubled"), "doubled_value").when(~F.col("taken"), F.when(copy, "exact_duplicate").otherwise("near_duplicate"))
        verdicts = drawn.join(earliest, ["round", "key"], "left").join(known, "key", "left").select("pattern_id", "k", "text", "form", "key", "set", "grams", reason.alias("reason"))
        seen = Observation()
        watched = verdicts.observe(seen, F.count(F.lit(1)).alias("drawn"), F.count_if(F.col("reason").isNull()).alias("accepted"), *(F.count_if(F.coalesce(F.col("reason") == r, F.lit(False))).alias(r) for r in ("doubled_value", "exact_duplicate", "near_duplicate")))
        verdicts = save(watched, "corpus-verdicts")
        counts = {c: n + seen.get[c] for c, n in counts.items()}
        new = verdicts.where("reason is null").drop("reason")
        kept = new if kept is None else kept.unionByName(new)
        won = verdicts.groupBy("pattern_id").agg(F.count_if(F.col("reason").isNull()).alias("won"), (F.max("k") + 1).alias("upto"))
        later = state.join(asked.select("pattern_id", F.col("last").alias("ahead")), "pattern_id", "left").join(won, "pattern_id", "left")
        state = save(later.select("pattern_id", "capacity", "wanted", F.coalesce("upto", "first").alias("first"), (F.col("n") + F.coalesce("won", none)).alias("n"), F.coalesce("ahead", "last").alias("last")), "corpus-state")
    asked_for = wanted.agg(F.coalesce(F.sum("wanted"), F.lit(0))).first()[0]
    counts = {"requested": asked_for, **counts, "quota_unfilled": asked_for - counts["accepted"]}
    produced = state.join(wanted.select("pattern_id", "family_id"), "pattern_id").groupBy("family_id").agg(F.sum("n").alias("produced"), F.sum("wanted").alias("quota"), F.sum("capacity").alias("capacity"))
    if kept is None:
        kept = patterns.select("pattern_id", F.lit("").alias("text"), F.lit("").alias("form")).limit(0)
    rows = kept.join(wanted.select("pattern_id", "family_id", "category"), "pattern_id")
    rows = rows.select(F.concat(F.lit("SCR-"), "family_id", F.lit("-"), F.substring(F.sha1("text"), 1, 12)).alias("script_id"), "text", "category", "family_id", "pattern_id", F.char_length("form").alias("n_chars"))
    return Corpus(rows, counts, produced.where("produced < quota"))
