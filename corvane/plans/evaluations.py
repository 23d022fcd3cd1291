"""Queries of evaluations, deliveries, report tables, subsets and quality control, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvane.functions import arrays, text
from corvane.operators import audio, augment, corpus, delivery, evaluation, sampling, subsets, tables
from corvane.sources.tables import save
from corvane.plans.queries import BUDGETS, LETTERS, LEXICON_SQL, MANIFEST, PAIRS, SPLIT, TERMS, distance_sql, form_sql, lexicon, manifest, query, read, rounded, term_chain

# ---------------------------------------------------------------- evaluation of turns


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consecutive turns as reference and hypothesis with metadata."""
    said = read(spark, sf_dir, "conversations").withColumn("text", F.coalesce("text", F.lit(""))).withColumn("before", F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))).where("before is not null")
    condition = F.when(F.col("turn") % 3 == 0, "noise").when(F.col("turn") % 3 == 1, "clean")
    return said.select(F.concat_ws("-", "conv_id", "turn").alias("utt_id"), F.col("before").alias("reference_raw"), F.col("text").alias("hypothesis_raw"), condition.alias("condition"), F.col("role").alias("source"))


def plain_form(c):
    return text.normalize(c, keep_digit_separators=False)


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.records(turns(spark, sf_dir), TERMS, plain_form)


ONE_LEXICON = "one as (select term, min(category) as category from lexicon group by term)"
SCORED = f"""{LEXICON_SQL}, {PAIRS}, r as ({term_chain('pairs', 'conv_id, turn', 'reference')}), h as ({term_chain('pairs', 'conv_id, turn', 'hypothesis')}),
found as (select r.conv_id, r.turn, r.term, r.n, r.n - least(r.n, coalesce(h.n, 0)) as lacking from r left join h using (conv_id, turn, term)),
terms as (select conv_id, turn, cast(sum(n) as bigint) as n, cast(sum(lacking) as bigint) as lacking, list_sort(flatten(list(list_transform(range(n), lambda i: term)))) as entities, list_sort(flatten(list(list_transform(range(lacking), lambda i: term)))) as errors from found group by all),
records as (select concat(conv_id, '-', turn) as utt_id, reference, hypothesis, case when reference <> '' then distance end as edit_distance, reference_length, length(hypothesis) as hypothesis_length,
case when reference <> '' then distance / reference_length end as cer, coalesce(entities, []) as medical_entities, coalesce(errors, []) as entity_errors, coalesce(n, 0) as n_reference_terms, coalesce(n - lacking, 0) as n_matched_terms,
case turn % 3 when 0 then 'noise' when 1 then 'clean' end as condition, role as source from scored left join terms using (conv_id, turn))"""


@query(f"""with {SCORED} select utt_id, reference as reference_normalized, hypothesis as hypothesis_normalized, edit_distance, reference_length, hypothesis_length, round(cer, 9) as cer, medical_entities, entity_errors, n_reference_terms, n_matched_terms,
case when n_reference_terms > 0 then round(n_matched_terms / n_reference_terms, 9) end as term_recall, case when n_reference_terms > 0 then n_matched_terms = n_reference_terms end as all_terms_correct, condition, source, edit_distance as edits from records""")
def eval_records(spark, sf_dir):
    """A record for each turn; substitutions, deletions and insertions must add up to the distance."""
    kinds = F.col("substitutions") + F.col("deletions") + F.col("insertions")
    names = "utt_id reference_normalized hypothesis_normalized edit_distance reference_length hypothesis_length cer medical_entities entity_errors n_reference_terms n_matched_terms term_recall all_terms_correct condition source"
    return rounded(records(spark, sf_dir).select(*names.split(), kinds.alias("edits")), "cer", "term_recall")


RATE = """count(*) filter (reference_length > 0) as n_utterances, count(*) filter (reference_length = 0) as n_empty_reference, cast(sum(edit_distance) as bigint) as total_edit_distance, cast(sum(reference_length) filter (reference_length > 0) as bigint) as total_reference_length,
round(sum(edit_distance) / sum(reference_length) filter (reference_length > 0), 9) as cer, round(avg(least(cer, 1.0)), 9) as macro_cer, cast(sum(edit_distance) as bigint) as edits, cast(sum(hypothesis_length - reference_length) filter (reference_length > 0) as bigint) as surplus"""


@query(f"""with {SCORED}, parts as (select 'overall' as dimension, 'all' as value, {RATE} from records union all select 'condition', coalesce(condition, 'UNSPECIFIED'), {RATE} from records where reference_length > 0 group by 2
union all select 'domain_category', 'UNSPECIFIED', {RATE} from records where reference_length > 0 union all select 'source', coalesce(source, 'UNSPECIFIED'), {RATE} from records where reference_length > 0 group by 2)
select *, cast(row_number() over (partition by dimension order by n_utterances desc, value) as int) as place from parts""")
def eval_breakdown(spark, sf_dir):
    """Rates overall, by condition, category and source; kinds of edits add up, and insertions less deletions are the lengths' difference."""
    out = evaluation.breakdown(records(spark, sf_dir))
    kinds = F.col("substitutions") + F.col("deletions") + F.col("insertions")
    return rounded(out.withColumns({"edits": kinds, "surplus": F.col("insertions") - F.col("deletions")}).drop("substitutions", "deletions", "insertions"), "cer", "macro_cer")


@query(f"""with {SCORED}, {ONE_LEXICON}, e as (select unnest(medical_entities) as term from records), m as (select unnest(entity_errors) as term from records),
w as (select term, count(*) as wanted from e group by 1), l as (select term, count(*) as lacking from m group by 1)
select category, cast(sum(wanted) as bigint) as n_reference_terms, cast(sum(wanted - coalesce(lacking, 0)) as bigint) as n_matched_terms, round(1 - sum(wanted - coalesce(lacking, 0)) / sum(wanted), 9) as error_rate, null::bigint as n_utterances_with_terms, null::double as exact_match
from w left join l using (term) join one using (term) group by category
union all select null, cast(sum(n_reference_terms) as bigint), cast(sum(n_matched_terms) as bigint), round(1 - sum(n_matched_terms) / sum(n_reference_terms), 9), count(*), round(count(*) filter (n_matched_terms = n_reference_terms) / count(*), 9) from records where n_reference_terms > 0""")
def eval_terms(spark, sf_dir):
    """Term error over all and by category."""
    return rounded(evaluation.term_breakdown(records(spark, sf_dir), lexicon(spark)).drop("recall"), "error_rate", "exact_match")


@query()
def eval_metrics_document(spark, sf_dir):
    """The nested metrics document as one JSON text."""
    return evaluation.document(records(spark, sf_dir), lexicon(spark), {"tag": "turns"})


# here punctuation stays, and with it no capital is taken either
VARIANT = [f"translate({c}, '{LETTERS[0]}', '{LETTERS[1]}')" for c in ("r_v", "h_v")]


def plain_sql(column: str) -> str:
    return form_sql(column).replace(f"translate(lower(", "lower((").replace(f", '{text.ASCII_PUNCTUATION.replace(chr(39), chr(39) * 2)}', '')", ")")


@query(f"""with said as (select *, lag(coalesce(text, '')) over (partition by conv_id order by turn) as before from conversations), f as (select {form_sql('before')} as r_d, {form_sql("coalesce(text, '')")} as h_d, {plain_sql('before')} as r_v, {plain_sql("coalesce(text, '')")} as h_v from said where before is not null),
s as (select count(*) filter (r_d <> '') as n_utterances, sum({distance_sql('r_d', 'h_d')}) filter (r_d <> '') / sum(length(r_d)) as d, sum(levenshtein({VARIANT[0]}, {VARIANT[1]})) filter (r_v <> '') / sum(length(r_v)) as v from f)
select n_utterances, round(d, 9) as cer_default, round(v, 9) as cer_variant, round(d - v, 9) as absolute_reduction, case when d <> v and d <> 0 then round((d - v) / d, 9) end as relative_reduction from s""")
def rescore_variants(spark, sf_dir):
    """Rates under the default form and under one that keeps punctuation."""
    variant = lambda c: text.normalize(c, drop_punctuation=False)
    return rounded(evaluation.rescore(turns(spark, sf_dir).repartition("utt_id"), plain_form, variant), "cer_default", "cer_variant", "absolute_reduction", "relative_reduction")


# ---------------------------------------------------------------- lexicon


def document_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", F.lower("text").alias("text"))
    return docs.select(F.col("doc_id").alias("key"), F.explode(text.term_counts(F.col("text"), TERMS)).alias("term", "n"))


HITS = f"{LEXICON_SQL}, hits as ({term_chain('documents', 'doc_id', 'lower(text)')})"


@query(f"""with {HITS} select (select count(*) from documents) as n_texts, count(distinct doc_id) as n_with_terms, round(100.0 * count(distinct doc_id) / (select count(*) from documents), 2) as pct_with_terms, count(distinct term) as n_seen, (select count(distinct term) from lexicon) - count(distinct term) as n_never_seen from hits""")
def lexicon_coverage_report(spark, sf_dir):
    return evaluation.coverage(document_hits(spark, sf_dir), lexicon(spark), read(spark, sf_dir, "documents").count())


@query(f"with {HITS} select term, cast(sum(n) as bigint) as n from hits group by term order by n desc, term limit 5")
def lexicon_most_frequent(spark, sf_dir):
    return evaluation.most_frequent(document_hits(spark, sf_dir), 5)


@query(f"with {HITS} select distinct term from lexicon where term not in (select term from hits)")
def lexicon_never_seen(spark, sf_dir):
    return evaluation.never_seen(document_hits(spark, sf_dir), lexicon(spark))


@query("""with t as (select distinct p_name as term, length(p_name) as length from part) (select 'longest' as kind, term, cast(length as int) as length from t order by length desc, term limit 15) union all (select 'shortest', term, cast(length as int) from t order by length, term limit 15)""")
def term_extremes(spark, sf_dir):
    return evaluation.extremes(read(spark, sf_dir, "part").select(F.col("p_name").alias("term")))


@query("select lower(p_name) as term, arg_min(p_brand, p_brand) as category from part group by 1")
def first_category_wins(spark, sf_dir):
    return evaluation.first_category_wins(read(spark, sf_dir, "part").select(F.col("p_name").alias("term"), F.col("p_brand").alias("category"), F.col("p_brand").alias("rank")))


# ---------------------------------------------------------------- deliveries


def delivered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest with script ids and splits by family."""
    digit = F.substring(sampling.hash_order("template_family"), 1, 1)
    split = F.when(digit < "8", "train").when(digit < "c", "dev").otherwise("test")
    return manifest(spark, sf_dir).withColumns({"script_id": F.concat(F.lit("S"), (F.substring("audio", 3, 30).cast("long") % 500).cast("string")), "split": split})


DELIVERED = MANIFEST.replace("end as text,", f"end as text, concat('S', doc_id % 500) as script_id, {SPLIT} as split,", 1)
BAD = "[utt_id is null, trim(text) = '', source not in ('synthetic_qwen3tts', 'synthetic_cosyvoice3', 'human', 'public'), condition = 'noise' and snr is null, condition = 'competing_speech' and sir is null, condition = 'clean' and (snr is not null or sir is not null), duration <= 0]"
GATE = f"""with {DELIVERED}, scripts as (select split, script_id, min(text) as script from manifest where script_id <> 'S7' group by all), sized as (select split, count(*) as k from manifest group by 1),
fidelity as (select m.split, count(*) filter (script is not null and text <> script) as differ, count(*) filter (script is null) as missing from manifest m left join scripts s on m.split = s.split and m.script_id = s.script_id group by 1),
renderings as (select script_id, count(*) as k, count(distinct speaker_id) as voices from manifest where split = 'train' group by 1), rendered as (select count(*) filter (k <> 2) as wrong, count(*) filter (voices < least(2, k)) as same, count(*) as n from renderings),
findings as (select 'FATAL' as level, 'manifest present' as "check", s as split, 1 as n from (select unnest(['train', 'dev', 'test']) as s) where s not in (select split from sized)
union all select case when count(*) > 0 then 'FATAL' else 'OK' end, 'speaker pools disjoint', 'all', count(*) from (select speaker_id from manifest group by 1 having count(distinct split) > 1)
union all select case when differ > 0 then 'FATAL' else 'OK' end, 'text matches script', split, differ from fidelity where differ > 0 or missing = 0
union all select 'ERROR', 'script_id resolvable', split, missing from fidelity where differ = 0 and missing > 0
union all select case when h < 20 then 'ERROR' else 'OK' end, 'training hours', 'train', cast(floor(h) as bigint) from (select sum(duration) / 3600 as h from manifest where split = 'train' having count(*) > 0)
union all select 'ERROR', 'renderings per script', 'train', wrong from rendered where wrong > 0 union all select case when same > 0 then 'ERROR' else 'OK' end, 'renderings use distinct voices', 'train', same from rendered where n > 0
union all select case when count(*) filter (condition <> 'clean' or snr is not null or sir is not null) > 0 then 'ERROR' else 'OK' end, 'condition is clean', split, count(*) filter (condition <> 'clean' or snr is not null or sir is not null) from manifest group by split
union all select 'WARN', 'speaker balance', split, max(k) from (select split, speaker_id, count(*) as k from manifest group by all) group by split having max(k) / sum(k) > 0.1
union all select 'FATAL', 'manifest schema', split, count(*) from (select split, unnest({BAD}) as bad from manifest) where bad group by split
union all select 'WARN', 'QC removal rate', split, 5 from sized where 5 / (k + 5) > 0.02)"""


def gate_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = delivered(spark, sf_dir)
    scripts = rows.where("script_id <> 'S7'").groupBy("split", "script_id").agg(F.min("text").alias("text"))
    removed = spark.createDataFrame([(s, 5) for s in ("train", "dev", "test")], "split string, n long")
    return delivery.gate(rows, scripts, removed=removed)


@query(f"{GATE} select level, \"check\", split, cast(n as bigint) as n from findings")
def delivery_gate(spark, sf_dir):
    """What each check says of the manifest, in order of severity."""
    return delivery.by_severity(gate_findings(spark, sf_dir)).drop("severity")


@query(f"{GATE} select count(*) filter (level = 'FATAL') as n_fatal, count(*) filter (level = 'ERROR') as n_error, count(*) filter (level = 'WARN') as n_warn, count(*) filter (level = 'OK') as n_ok, case when count(*) filter (level in ('FATAL', 'ERROR')) > 0 then 'REJECT' else 'ACCEPT' end as verdict from findings")
def delivery_verdict(spark, sf_dir):
    return delivery.verdict(gate_findings(spark, sf_dir))


# ---------------------------------------------------------------- report tables

TEST_SETS = [*tables.TEST_SETS, tables.GENERAL]
MEASURES = {"cer": "p_retailprice / 7919.0", "trainable_parameters": "case when p_partkey % 19 <> 0 then p_size * 1000 end", "trainable_percentage": "p_size / 7.0", "medical_term_error_rate": "p_size / 100.0", "medical_entity_recall": "1 - p_size / 100.0", "peak_vram_gib": "p_size / 3.0", "gpu_hours": "p_size / 5.0"}
MEASURES |= {f"term_error_{c}": f"(p_size + {i}) / 211.0" for i, c in enumerate(tables.TERM_CATEGORIES)}
MEASURES = {k: f"cast({v} as double)" for k, v in MEASURES.items()}


def chosen(values: list[str], at: str) -> str:
    return f"case {at} " + " ".join(f"when {i} then '{v}'" for i, v in enumerate(values)) + " end"


def whole(a: str, b: int, sql: bool) -> str:
    return f"({a} // {b})" if sql else f"({a} div {b})"


def experiments_sql(sql: bool) -> str:
    """Parts as experiments: every combination of keys in turn, several times."""
    arm = chosen(list(tables.ARMS), f"{whole('p_partkey', 4, sql)} % 8")
    budget = f"case when {arm} = 'zero' then null when {whole('p_partkey', 32, sql)} % 3 < 2 then '20h' else {chosen(['1h', '5h', '10h'], f'{whole('p_partkey', 96, sql)} % 3')} end"
    keys = [("case when p_partkey % 4 = 3 then 'qwen17' else 'qwen06' end", "model_key"), (arm, "arm_key"), (budget, "budget"), ("p_partkey % 9 = 0", "augmented"), ("p_partkey % 13 = 0", "replay"), ("case when p_partkey % 17 = 0 then 123 else 42 end", "seed"), (chosen(TEST_SETS, f"{whole('p_partkey', 5, sql)} % {len(TEST_SETS)}"), "test_set")]
    return "select p_partkey, " + ", ".join(f"{e} as {k}" for e, k in keys) + ", " + ", ".join(f"{e} as {k}" for k, e in MEASURES.items()) + " from part"


def experiments(spark: SparkSession, sf_dir: str) -> DataFrame:
    read(spark, sf_dir, "part").createOrReplaceTempView("part")
    made = spark.sql(experiments_sql(False))
    by_condition = F.create_map(F.lit("clean"), F.col("cer"), F.lit("noise"), 2 * F.col("cer"))
    return tables.latest(made.withColumn("by_condition", by_condition), "p_partkey")


LATEST = f"with made as ({experiments_sql(True)}), records as (select * from made qualify row_number() over (partition by {', '.join(tables.KEYS)} order by p_partkey desc) = 1)"


def literal(x) -> str:
    return "null" if x is None else f"'{x}'" if isinstance(x, str) else str(x).lower()


def cells_sql(cells: list[tables.Cell]) -> str:
    rows = ", ".join("(" + ", ".join(map(literal, (c.row, c.label, c.column, c.measure, c.form, c.less, *c.key()))) + ")" for c in cells)
    on = " and ".join(f"s.{k} is not distinct from r.{k}" for k in tables.KEYS)
    value = "case s.measure " + " ".join(f"when '{m}' then r.{m}" for m in sorted({c.measure for c in cells})) + " end"
    return f"""{LATEST}, s("row", label, "column", measure, form, less, {', '.join(tables.KEYS)}) as (values {rows}), zero as (select test_set, cer from records where model_key = 'qwen06' and arm_key = 'zero' and budget is null and not augmented and not replay and seed = 42),
found as (select s.*, case when less = 0 then {value} else less * ({value} - zero.cer) end as value from s left join records r on {on} left join zero on zero.test_set = s.test_set)"""


def table_sql(cells: list[tables.Cell]) -> str:
    shown = "case when value is null then 'XX' when form = 'int' then format('{:,}', cast(floor(value) as bigint)) when form = 'pct2' then format('{:.2f}', value * 100) when form = 'pct4' then format('{:.4f}', value * 100) when form = 'plain4' then format('{:.4f}', value) else format('{:.2f}', value) end"
    columns = ", ".join(f"max(case when \"column\" = '{c}' then {shown} end) as {c}" for c in dict.fromkeys(c.column for c in cells))
    return f'{cells_sql(cells)} select "row", label, {columns} from found group by "row", label'


def _table(name: str):
    def run(spark, sf_dir):
        return tables.table(spark, tables.TABLES[name], experiments(spark, sf_dir))

    run.__name__, run.__doc__ = f"table_{name}", f"The report's table of {name.replace('_', ' ')}."
    return query(table_sql(tables.TABLES[name]))(run)


for _name in tables.TABLES:
    _table(_name)


@query(f"{cells_sql(tables.HOURS_CELLS)} select label, cast(substr(\"column\", 2) as int) as hours, round(100 * value, 9) as cer from found where value is not null")
def figure_rates_by_hours(spark, sf_dir):
    return rounded(tables.rates_by_hours(spark, experiments(spark, sf_dir)), "cer")


@query(f"{cells_sql(tables.FORGETTING_CELLS)}, p as (select label, round(100 * max(value) filter (\"column\" = 'hospital'), 9) as hospital, round(100 * max(value) filter (\"column\" = 'general'), 9) as general from found group by label) select * from p where hospital is not null and general is not null")
def figure_forgetting(spark, sf_dir):
    return rounded(tables.forgetting_pairs(spark, experiments(spark, sf_dir)), "hospital", "general")


@query(f"""{LATEST}, spec(label, arm_key, budget, augmented) as (values ('Zero-shot', 'zero', null, false), ('Full SFT 20 h', 'full', '20h', false), ('Text-LoRA 20 h', 'textlora', '20h', false), ('DualPEFT 20 h', 'dualpeft', '20h', false), ('DualPEFT 20 h + aug', 'dualpeft', '20h', true)),
f as (select label, cer from spec join records r on r.model_key = 'qwen06' and r.arm_key = spec.arm_key and r.budget is not distinct from spec.budget and r.augmented = spec.augmented and not replay and seed = 42 and test_set = 'test_synthetic')
select label, 'clean' as part, round(cer, 9) as value from f union all select label, 'noise', round(2 * cer, 9) from f""")
def figure_by_condition(spark, sf_dir):
    return rounded(tables.by_part(spark, experiments(spark, sf_dir), "by_condition"), "value")


# ---------------------------------------------------------------- splits and budgets


def assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Families (sources) of each language and their split, by hash."""
    families = read(spark, sf_dir, "documents").select(F.col("lang").alias("category"), F.col("source").alias("family")).distinct()
    digit = F.substring(sampling.hash_order("family"), 1, 1)
    return families.withColumn("split", F.when(digit < "8", "train").when(digit < "c", "dev").otherwise("test"))


@query(f"""with s as (select doc_id, lang, {SPLIT} as split from documents where lang is not null and source is not null), r as (select *, row_number() over (partition by split, lang order by md5(concat('42|', doc_id)), doc_id) as r from s)
select doc_id, split, case when split = 'test' then r <= 40 end as cross_selected from r""")
def split_scripts(spark, sf_dir):
    """Documents with their family's split, and which test rows are in the cross-check set."""
    docs = read(spark, sf_dir, "documents").where("lang is not null and source is not null").select("doc_id", "lang", "source")
    rows = subsets.with_splits(docs, assignment(spark, sf_dir), "lang", "source")
    return subsets.with_cross_flags(rows, "doc_id", "lang").select("doc_id", "split", "cross_selected")


@query(f"""with s as (select lang as category, source, {SPLIT} as split from documents where lang is not null and source is not null)
select split, category, count(*) as n, count(distinct source) as n_families, round(100.0 * count(*) / (select count(*) from s), 2) as pct from s group by grouping sets ((split), (split, category))""")
def split_report(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").where("lang is not null and source is not null").select("lang", "source")
    return subsets.split_report(subsets.with_splits(docs, assignment(spark, sf_dir), "lang", "source"), "lang", "source")


@query("""with b as (select *, coalesce(sum(n_chars) over (order by doc_id rows between unbounded preceding and 1 preceding), 0) as before from documents), t(subset, target) as (values ('b1', 50000.0::double), ('b5', 250000.0), ('b10', 500000.0)),
m as (select subset, target, source, lang, n_chars from b join t on before < target), v as (select subset, source, count(*) as k from m group by all), l as (select subset, lang, count(*) as k from m where lang is not null group by all)
select subset, target, cast(sum(n_chars) as bigint) as actual, count(*) as n, count(distinct coalesce(source, '?')) as n_speakers, (select min(k) from v where v.subset = m.subset) as speaker_min, (select max(k) from v where v.subset = m.subset) as speaker_max,
(select list(concat(lang, ' ', format('{:.2f}', round(100.0 * k / (select count(*) from m x where x.subset = m.subset), 2))) order by lang) from l where l.subset = m.subset) as categories from m group by subset, target""")
def subset_report(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "n_chars", "source", "lang")
    members = sampling.nested_budgets(docs, "n_chars", ["doc_id"], BUDGETS)
    out = subsets.subset_report(members, BUDGETS, "n_chars", "source", "lang").withColumn("actual", F.col("actual").cast("long"))
    shown = F.array_sort(F.transform(F.map_entries("by_category_pct"), lambda e: F.concat(e.key, F.lit(" "), F.format_string("%.2f", e.value))))
    return out.withColumn("categories", shown).drop("by_category_pct")


@query()
def speaker_pools(spark, sf_dir):
    """Customers' nations as accents, two genders: six test and six dev voices of 32, accents and genders in turn."""
    voices = read(spark, sf_dir, "customer").orderBy("c_custkey").limit(32)
    voices = voices.select(F.format_string("SPK%02d", F.col("c_custkey").cast("int")).alias("speaker_id"), (F.col("c_nationkey") % 4).cast("string").alias("accent"), F.when(F.col("c_custkey") % 2 == 0, "female").otherwise("male").alias("gender"), sampling.hash_order("c_custkey").alias("order"))
    return voices.withColumn("all", F.lit(1)).groupBy("all").applyInPandas(lambda pdf: subsets.pools(pdf.drop(columns="all"), {"test": 6, "dev": 6}), "speaker_id string, accent string, gender string, order string, pool string")  # 32 voices


# ---------------------------------------------------------------- quality control

E = "list_transform(embedding, lambda x: cast(x as double))"


@query(f"""with m as (select len(embedding) / 16000 as duration, sqrt(list_dot_product({E}, {E}) / len(embedding)) as rms, len(list_filter({E}, lambda x: abs(x) >= 0.3)) / len(embedding) as clipping from embeddings),
r as (select duration, list_filter([case when clipping > 0.02 then 'clipping ratio' end, case when rms > 0.125001 then 'rms' end], lambda x: x is not null) as reasons from m), k as (select unnest(reasons) as rule from r),
p as (select duration, row_number() over (order by duration) - 1 as i, count(*) over () as n from r where len(reasons) = 0)
select count(*) as n_files, count(*) filter (len(reasons) = 0) as n_passed, count(*) filter (len(reasons) > 0) as n_failed, round(count(*) filter (len(reasons) > 0) / count(*), 5) as removal_rate,
coalesce((select list(concat(rule, ' ', n) order by rule) from (select rule, count(*) as n from k group by rule)), []) as reasons, (select round(sum(duration), 2) from p) as total_duration, (select round(min(duration), 3) from p) as min, (select round(max(duration), 3) from p) as max, (select round(avg(duration), 3) from p) as mean,
(select round(duration, 3) from p where i = floor(0.1 * n)) as p10, (select round(duration, 3) from p where i = floor(0.5 * n)) as median, (select round(duration, 3) from p where i = floor(0.9 * n)) as p90 from r""")
def qc_summary(spark, sf_dir):
    """Embeddings as signals: what fails which rule, and the durations of what passes."""
    m = read(spark, sf_dir, "embeddings").select(arrays.measure(F.col("embedding"), clip_at=0.3).alias("m")).select("m.*")
    stats = {c: F.col(c) for c in ("n_samples", "n_nonfinite", "is_all_zero", "clipping_ratio", "rms")}
    judged = m.withColumn("reasons", arrays.qc_reasons(stats, {"max_rms": 0.125001, "max_clipping_ratio": 0.02})).withColumn("passed", F.size("reasons") == 0)
    out = audio.quality_summary(judged)
    told = F.transform(F.map_entries("failure_reasons"), lambda e: F.concat(e.key, F.lit(" "), e.value.cast("string")))
    return out.withColumn("reasons", F.array_sort(told)).drop("failure_reasons")


@query("""with c as (select page_id, case when contains(url, 'blog') then 'rir' else 'noise' end as kind, length(url) / 20.0 as seconds from pages), j as (select *, case when kind = 'rir' and seconds > 5 then 'too long' when kind = 'noise' and seconds < 1.5 then 'too short' end as reason from c),
r as (select *, row_number() over (partition by kind, reason is null order by md5(concat('42|', page_id)), page_id) as r from j) select page_id, kind, reason, reason is null and r <= case kind when 'rir' then 30 else 60 end as kept from r""")
def screened_clips(spark, sf_dir):
    """Screening with a reason, and a cap on what is kept, in hash order."""
    seconds = F.char_length("url") / 20.0
    kind = F.when(F.contains("url", F.lit("blog")), "rir").otherwise("noise")
    reason = F.when((kind == "rir") & (seconds > 5), "too long").when((kind == "noise") & (seconds < 1.5), "too short")
    judged = read(spark, sf_dir, "pages").select("page_id", kind.alias("kind"), reason.alias("reason"))
    fine = judged.where("reason is null")
    kept = [fine.where(F.col("kind") == k).orderBy(sampling.hash_order("page_id"), "page_id").limit(n) for k, n in (("rir", 30), ("noise", 60))]
    chosen_ids = kept[0].unionByName(kept[1]).select("page_id", F.lit(True).alias("in"))
    return judged.join(chosen_ids, "page_id", "left").select("page_id", "kind", "reason", F.coalesce("in", F.lit(False)).alias("kept"))


# ---------------------------------------------------------------- augmentation and corpora over the tables


@query("""with files as (select s_name as path, greatest(1, cast(round(s_acctbal * 1e6) as bigint)) as w from supplier where s_acctbal > 0),
r as (select path, sum(w) over (order by path) - w as low, sum(w) over (order by path) as high, sum(w) over () as whole from files),
d as (select doc_id, least(cast(floor(u * whole) as bigint), whole - 1) as t from (select doc_id, cast(('0x' || substr(sha256(concat('42::noise::', doc_id)), 1, 13)) as bigint) / 4503599627370496.0::double as u from documents), (select any_value(whole) as whole from r))
select path, count(*) as n from d join r on t >= low and t < high group by path""")
def noise_draws(spark, sf_dir):
    """Files of a noise bank drawn by weight for each document, a range join on a hash; suppliers stand for files."""
    files = read(spark, sf_dir, "supplier").select(F.lit("noise").alias("kind"), F.col("s_name").alias("path"), F.col("s_acctbal").alias("weight"))
    rows = read(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("utt_id"))
    return augment.draw_files(rows, files, "noise").groupBy("path").agg(F.count("*").alias("n"))


@query("""with p as (select p_partkey, p_brand as speaker, p_type as script from part), b as (select speaker, count(*) as nb from p group by 1), t as (select script, count(*) as nt from p group by 1), s as (select speaker, script, count(*) as ns from p group by all)
select cast(p_partkey as varchar) as utt_id, (select count(*) from p) - nb - nt + ns > 0 as has_other, (select count(*) from p) - nb - nt + ns > 0 as fits from p join b using (speaker) join t using (script) join s using (speaker, script)""")
def interferer_choice(spark, sf_dir):
    """Whether each part, as an utterance of its brand reading its type, has another of another brand and type, and whether the one chosen fits."""
    rows = read(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("utt_id"), F.col("p_brand").alias("speaker_id"), F.col("p_type").alias("script_id"))
    chosen = augment.interferers(rows)
    other = rows.select(F.col("utt_id").alias("other_id"), F.col("speaker_id").alias("speaker"), F.col("script_id").alias("script"))
    both = chosen.join(rows, "utt_id").join(other, "other_id", "left")
    fits = (F.col("speaker") != F.col("speaker_id")) & (F.col("script") != F.col("script_id")) & (F.col("other_speaker") == F.col("speaker"))
    return both.select("utt_id", F.col("other_id").isNotNull().alias("has_other"), F.coalesce(fits, F.lit(False)).alias("fits"))


@query()
def corpus_counts(spark, sf_dir):
    """What became of a corpus of a twentieth as many scripts as there are parts, from patterns that parts make: outcome, n."""
    part = read(spark, sf_dir, "part")
    kind = F.split_part("p_type", F.lit(" "), F.lit(1))
    patterns = part.groupBy("p_brand", kind.alias("kind")).agg(F.min("p_partkey").alias("pattern_id"), F.substring(F.min("p_brand"), 7, 1).alias("category"))
    form = F.concat(F.lit("the {color} "), F.lower("kind"), F.lit(" of "), F.substring(F.md5("p_brand"), 1, 20), F.lit(" goes to {place} and to {place2}"))
    told = F.concat(F.lit("{short} stands for {long} at "), F.substring(F.md5("p_brand"), 1, 20))
    patterns = patterns.select("pattern_id", F.col("p_brand").alias("family_id"), "category", F.when(F.col("kind") == "PROMO", told).otherwise(form).alias("pattern"), F.when(F.col("kind") == "PROMO", "nations").alias("pair"))
    colors = part.select(F.split_part("p_name", F.lit(" "), F.lit(1)).alias("value")).distinct()
    nations = read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("int").alias("position"), F.lower("n_name").alias("value"))
    ranked = colors.select(F.lit("color").alias("slot"), F.dense_rank().over(Window.orderBy("value")).cast("int").alias("position"), "value")  # a few words
    values = ranked.unionByName(nations.select(F.lit("place").alias("slot"), "position", "value")).unionByName(nations.select(F.lit("place2").alias("slot"), "position", "value"))
    pairs = nations.select(F.lit("nations").alias("pair"), "position", F.explode(F.array(F.struct(F.lit("short").alias("slot"), F.substring("value", 1, 3).alias("value")), F.struct(F.lit("long").alias("slot"), F.col("value")))).alias("v")).select("pair", "position", "v.*")
    categories = patterns.select("category").distinct()
    shares = categories.withColumn("share", F.lit(1.0 / max(1, categories.count())))
    made = corpus.build(patterns, values, shares, part.count() // 20, save, pairs)
    outcomes = spark.createDataFrame(list(made.counts.items()), "outcome string, n long")
    written = made.rows.agg(F.count_distinct("text").alias("n")).select(F.lit("different_texts").alias("outcome"), "n")
    return outcomes.unionByName(written)
