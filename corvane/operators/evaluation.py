"""Evaluation of recognisers: records of utterances, rates with kinds of edits, rescoring, and the metrics document."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvane.functions.text import edit_operations, normalize, term_counts
from corvane.operators.metrics import UNCATEGORIZED, UNSPECIFIED
from corvane.sources.files import write_files

#: What a record carries of an utterance besides its scores, and as what.
METADATA = {"condition": "string", "domain_category": "string", "template_family": "string", "speaker_id": "string", "source": "string", "tts_engine": "string", "snr": "double", "sir": "double", "duration": "double"}


def _repeated(counts: Column) -> Column:
    """Terms of a map of counts, each as often as it counts, in their order."""
    return F.array_sort(F.flatten(F.transform(F.map_entries(counts), lambda e: F.array_repeat(e.key, e.value.cast("int")))))


def records(rows: DataFrame, terms: list[str], form: Callable[[Column], Column] = normalize) -> DataFrame:
    """A record of 27 fields for each of rows (utt_id, reference_raw, hypothesis_raw, and metadata where there are any).

    A missing hypothesis is empty. Without a reference nothing is scored: distance, rate and kinds are null, as are
    recall and exactness without a term; a term found less often than it should be is an error as often as it lacks.
    """
    rows = rows.withColumns({c: F.lit(None).cast(kind) for c, kind in METADATA.items() if c not in rows.columns})
    rows = rows.withColumn("hypothesis_raw", F.coalesce("hypothesis_raw", F.lit("")))
    # dealt out between the forms and the edits, so that forms are made once and a task has one Python worker, not two
    made = rows.withColumns({"reference_normalized": form(F.col("reference_raw")), "hypothesis_normalized": form(F.col("hypothesis_raw"))}).repartition("utt_id")
    made = made.withColumns({"edits": edit_operations("reference_normalized", "hypothesis_normalized"), "wanted": term_counts(F.col("reference_normalized"), terms), "heard": term_counts(F.col("hypothesis_normalized"), terms)})
    length = F.char_length("reference_normalized")
    scored = lambda c: F.when(length > 0, c)
    lacking = F.transform_values("wanted", lambda k, v: v - F.least(v, F.coalesce(F.try_element_at("heard", k), F.lit(0))))
    total = lambda m: F.aggregate(F.map_values(m), F.lit(0).cast("long"), lambda t, x: t + x)
    made = made.withColumns({"lacking": lacking}).withColumns({"n_reference_terms": total("wanted"), "n_matched_terms": total("wanted") - total("lacking")})
    some = F.col("n_reference_terms") > 0
    return made.select(
        "utt_id", "reference_raw", "hypothesis_raw", "reference_normalized", "hypothesis_normalized", scored(F.col("edits.distance")).alias("edit_distance"), length.cast("long").alias("reference_length"),
        F.char_length("hypothesis_normalized").cast("long").alias("hypothesis_length"), scored(F.col("edits.distance") / length).alias("cer"),
        *(scored(F.col(f"edits.{c}")).alias(c) for c in ("substitutions", "deletions", "insertions")), _repeated(F.col("wanted")).alias("medical_entities"), _repeated(F.col("lacking")).alias("entity_errors"),
        "n_reference_terms", "n_matched_terms", F.when(some, F.col("n_matched_terms") / F.col("n_reference_terms")).alias("term_recall"), F.when(some, F.col("n_matched_terms") == F.col("n_reference_terms")).alias("all_terms_correct"), *METADATA,
    )


def rates() -> list[Column]:
    """Corpus rates of records, kinds of edits included; null where nothing can be scored."""
    scored = F.col("reference_length") > 0
    sums = {name: F.sum(F.when(scored, F.col(c))) for name, c in (("total_edit_distance", "edit_distance"), ("total_reference_length", "reference_length"), ("substitutions", "substitutions"), ("deletions", "deletions"), ("insertions", "insertions"))}
    cer = F.try_divide(sums["total_edit_distance"], sums["total_reference_length"])
    return [F.count_if(scored).alias("n_utterances"), F.count_if(~scored).alias("n_empty_reference"), *(c.alias(n) for n, c in sums.items()), cer.alias("cer"), F.avg(F.when(scored, F.least(F.col("cer"), F.lit(1.0)))).alias("macro_cer")]


def breakdown(made: DataFrame, keys: tuple[str, ...] = ("condition", "domain_category", "source")) -> DataFrame:
    """dimension, value, place and the rates: over all, and by each key, the largest group first (ties by name)."""
    named = [F.struct(F.lit("overall").alias("dimension"), F.lit("all").alias("value"))]
    named += [F.struct(F.lit(k).alias("dimension"), F.coalesce(F.col(k), F.lit(UNSPECIFIED)).alias("value")) for k in keys]
    rows = made.select("edit_distance", "reference_length", "cer", "substitutions", "deletions", "insertions", F.explode(F.array(*named)).alias("d")).where("d.dimension = 'overall' or reference_length > 0")
    out = rows.groupBy(F.col("d.dimension").alias("dimension"), F.col("d.value").alias("value")).agg(*rates())
    place = F.row_number().over(Window.partitionBy("dimension").orderBy(F.desc("n_utterances"), "value"))  # a row for each value
    return out.withColumn("place", place)


def term_breakdown(made: DataFrame, lexicon: DataFrame) -> DataFrame:
    """category (null: over all), n_utterances_with_terms, n_reference_terms, n_matched_terms, error rate, recall, exact match."""
    some = made.where("n_reference_terms > 0")
    error = 1 - F.try_divide(F.sum("n_matched_terms"), F.sum("n_reference_terms"))
    whole = some.agg(F.count("*").alias("n_utterances_with_terms"), F.sum("n_reference_terms").alias("n_reference_terms"), F.sum("n_matched_terms").alias("n_matched_terms"), error.alias("error_rate"), (1 - error).alias("recall"), F.try_divide(F.count_if("all_terms_correct"), F.count("*")).alias("exact_match"))
    each = lambda c, sign: some.select(F.explode(c).alias("term"), F.lit(sign).alias("hit"))
    terms = each("medical_entities", 1).unionByName(each("entity_errors", 0)).groupBy("term").agg(F.sum("hit").alias("wanted"), F.count_if(F.col("hit") == 0).alias("lacking"))
    one = lexicon.groupBy("term").agg(F.min("category").alias("category"))
    by = terms.join(one, "term", "left").groupBy(F.coalesce("category", F.lit(UNCATEGORIZED)).alias("category")).agg(F.sum("wanted").alias("n_reference_terms"), F.sum(F.col("wanted") - F.col("lacking")).alias("n_matched_terms"))
    by = by.withColumn("error_rate", 1 - F.try_divide(F.col("n_matched_terms"), F.col("n_reference_terms")))
    return whole.withColumn("category", F.lit(None).cast("string")).unionByName(by, allowMissingColumns=True)


def document(made: DataFrame, lexicon: DataFrame, meta: dict[str, str]) -> DataFrame:
    """One row, one column: the metrics document as JSON, with the names that read_experiments() looks for.

    Its parts are aggregates, a row for each value of a key. Without records there is no overall part, and the maps are empty.
    """
    parts = breakdown(made)
    entry = F.struct(*(c for c in parts.columns if c not in ("dimension", "value", "place")))
    one = parts.agg(F.first(F.when(F.col("dimension") == "overall", entry), ignorenulls=True).alias("overall"), *(F.map_from_entries(F.array_compact(F.collect_list(F.when(F.col("dimension") == k, F.struct("value", entry.alias("e")))))).alias(f"by_{k}") for k in ("condition", "domain_category", "source")))
    terms = term_breakdown(made, lexicon)
    whole = [F.first(F.when(F.col("category").isNull(), F.col(c)), ignorenulls=True).alias(n) for c, n in TERM_MEASURES.items()]
    each = F.struct("category", F.struct("n_reference_terms", "n_matched_terms", F.col("error_rate").alias("term_error_rate")).alias("e"))
    terms = terms.agg(*whole, F.map_from_entries(F.array_compact(F.collect_list(F.when(F.col("category").isNotNull(), each)))).alias("by_term_category"))
    told = F.create_map(*(F.lit(x) for kv in meta.items() for x in kv)) if meta else F.create_map().cast("map<string,string>")
    joined = one.withColumn("at", F.lit(1)).join(terms.select(F.lit(1).alias("at"), F.struct("*").alias("medical_terms")), "at")  # one row and one row
    return joined.select(F.to_json(F.struct(told.alias("meta"), *one.columns, "medical_terms")).alias("document"))


#: What the document calls the measures of terms over all records.
TERM_MEASURES = {"n_utterances_with_terms": "n_utterances_with_terms", "n_reference_terms": "n_reference_terms", "n_matched_terms": "n_matched_terms", "error_rate": "medical_term_error_rate", "recall": "medical_entity_recall", "exact_match": "utterance_exact_match"}


def write_evaluation(made: DataFrame, doc: DataFrame, folder: str, experiment: str, test_set: str) -> None:
    """predictions.jsonl, as parts, and metrics.json below folder/experiment/test_set, where read_experiments() finds them."""
    made.write.json(f"{folder}/{experiment}/{test_set}/predictions.jsonl")
    write_files(doc.select(F.lit(f"{experiment}/{test_set}/metrics.json").alias("path"), F.encode("document", "UTF-8").alias("content")), folder, "overwrite")


def rescore(rows: DataFrame, baseline: Callable[[Column], Column], variant: Callable[[Column], Column]) -> DataFrame:
    """n_utterances, cer_default, cer_variant, absolute and relative reduction of rows (reference_raw, hypothesis_raw) under two forms."""
    raw = rows.select(F.coalesce("reference_raw", F.lit("")).alias("reference_raw"), F.coalesce("hypothesis_raw", F.lit("")).alias("hypothesis_raw"))
    forms = raw.select(*(form(F.col(f"{side}_raw")).alias(f"{side[0]}_{n}") for n, form in (("d", baseline), ("v", variant)) for side in ("reference", "hypothesis")))
    cer = lambda n: F.try_divide(F.sum(F.when(F.col(f"r_{n}") != "", F.levenshtein(f"r_{n}", f"h_{n}"))) , F.sum(F.char_length(f"r_{n}")))
    out = forms.agg(F.count_if(F.col("r_d") != "").alias("n_utterances"), cer("d").alias("cer_default"), cer("v").alias("cer_variant"))
    reduction = F.col("cer_default") - F.col("cer_variant")
    return out.withColumn("absolute_reduction", reduction).withColumn("relative_reduction", F.when((reduction != 0) & (F.col("cer_default") != 0), reduction / F.col("cer_default")))


def coverage(hits: DataFrame, lexicon: DataFrame, n_texts: int) -> DataFrame:
    """One row of lexicon coverage from hits (key, term, n): texts with a term, their share, terms seen and never seen."""
    seen = hits.agg(F.count_distinct("key").alias("n_with_terms"), F.count_distinct("term").alias("n_seen"))
    size = lexicon.agg(F.count_distinct("term").alias("n_terms"))
    return seen.join(size).select(F.lit(n_texts).cast("long").alias("n_texts"), "n_with_terms", F.round(100.0 * F.col("n_with_terms") / max(1, n_texts), 2).alias("pct_with_terms"), "n_seen", (F.col("n_terms") - F.col("n_seen")).alias("n_never_seen"))  # one row and one row


def never_seen(hits: DataFrame, lexicon: DataFrame) -> DataFrame:
    return lexicon.select("term").distinct().join(hits, "term", "left_anti")


def most_frequent(hits: DataFrame, top: int = 20) -> DataFrame:
    """term, n of the terms that are found most often, ties by term."""
    return hits.groupBy("term").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "term").limit(top)


def extremes(terms: DataFrame, top: int = 15) -> DataFrame:
    """kind, term, length: the longest and the shortest terms, ties by term."""
    sized = terms.select("term").distinct().withColumn("length", F.char_length("term"))
    ends = [sized.orderBy(order, "term").limit(top).select(F.lit(kind).alias("kind"), "term", "length") for kind, order in (("longest", F.desc("length")), ("shortest", F.asc("length")))]
    return ends[0].unionByName(ends[1])


def first_category_wins(lexicon: DataFrame) -> DataFrame:
    """term (lower-cased), category: of the categories (term, category, rank) that claim a term the one with the least rank."""
    claims = lexicon.select(F.lower("term").alias("term"), F.struct("rank", "category").alias("claim"))
    return claims.groupBy("term").agg(F.min("claim").alias("claim")).select("term", "claim.category")
