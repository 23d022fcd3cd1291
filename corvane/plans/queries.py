"""Every query of the library over a folder of tables, each beside the SQL that says the same."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvane.functions import arrays, text
from corvane.sources.tables import save
from corvane.operators import audio, augment, dedup, metrics, report, sampling, templates, validate

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

# A dictionary for the queries: terms in the invented prose, some of them inside others, one in two categories.
LEXICON = [("that the", "phrase"), ("the that", "phrase"), ("tion", "suffix"), ("ing", "suffix"), ("the", "article"), ("that", "pronoun"), ("and", "conjunction"), ("der", "article"), ("que", "pronoun"), ("que", "conjunction"), ("zzzz", "never")]
TERMS = sorted({t for t, _ in LEXICON}, key=lambda t: (-len(t), t))


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lexicon(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(LEXICON, "term string, category string")


LEXICON_SQL = "lexicon(term, category) as (values " + ", ".join(f"('{t}', '{c}')" for t, c in LEXICON) + ")"

# ---------------------------------------------------------------- error rates


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consecutive turns as reference and hypothesis, whole and normalized; dealt out anew, since an edit distance takes the product of two lengths.

    A turn without text is empty, be it the reference or the hypothesis; only the first turn has none before it.
    """
    turn = Window.partitionBy("conv_id").orderBy("turn")
    said = read(spark, sf_dir, "conversations").withColumn("text", F.coalesce("text", F.lit(""))).withColumn("before", F.lag("text").over(turn)).where("before is not null")
    form = lambda c: text.normalize(F.col(c), keep_digit_separators=False)
    # dealt out behind the forms: else they would be made once for Python and once more for the rest
    return said.select("conv_id", "turn", "role", form("before").alias("reference"), form("text").alias("hypothesis")).repartition("conv_id", "turn")


PUNCT = text.ASCII_PUNCTUATION.replace("'", "''")
# DuckDB's levenshtein counts bytes: letters beyond ASCII take the place of capitals, of which lower-cased text has none.
LETTERS = "àâäáãåçèéêëìíîïñòóôöõùúûüß", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def form_sql(column: str) -> str:
    untagged = f"regexp_replace({column}, '(?i)^\\s*language\\s+\\w+\\s*<asr_text>\\s*', '')"
    return f"regexp_replace(translate(lower({untagged}), '{PUNCT}', ''), '\\s+', '', 'g')"


def distance_sql(a: str, b: str) -> str:
    one, other = (f"translate({x}, '{LETTERS[0]}', '{LETTERS[1]}')" for x in (a, b))
    return f"levenshtein({one}, {other})"


PAIRS = f"""said as (select * replace (coalesce(text, '') as text), lag(coalesce(text, '')) over (partition by conv_id order by turn) as before from conversations),
pairs as (select conv_id, turn, role, {form_sql('before')} as reference, {form_sql("text")} as hypothesis from said where before is not null),
scored as (select *, length(reference) as reference_length, {distance_sql('reference', 'hypothesis')} as distance from pairs)"""
RATES = """count(*) filter (reference_length > 0) as n_scored, count(*) filter (reference_length = 0) as n_empty_reference,
cast(sum(distance) filter (reference_length > 0) as bigint) as sum_distance, cast(sum(reference_length) filter (reference_length > 0) as bigint) as sum_reference,
round(sum(distance) filter (reference_length > 0) / sum(reference_length) filter (reference_length > 0), 9) as cer,
round(avg(least(distance / reference_length, 1.0)) filter (reference_length > 0), 9) as macro_cer"""


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    """Doubles to nine digits, for comparing sums made in any order."""
    return df.withColumns({c: F.round(c, 9) for c in columns})


@query(f"with {PAIRS} select {RATES} from scored")
def corpus_cer(spark, sf_dir):
    return rounded(metrics.corpus_cer(metrics.score(pairs(spark, sf_dir))), "cer", "macro_cer")


@query(f"with {PAIRS} select coalesce(role, 'UNSPECIFIED') as role, {RATES} from scored group by 1")
def grouped_cer(spark, sf_dir):
    return rounded(metrics.grouped_cer(metrics.score(pairs(spark, sf_dir)), "role"), "cer", "macro_cer")


@query(f"""with {PAIRS} select case when grouping(role, turn) = 3 then 'overall' when grouping(role, turn) = 1 then 'role' else 'turn' end as dimension,
case when grouping(role, turn) = 3 then 'all' when grouping(role, turn) = 1 then role else cast(turn as varchar) end as value, {RATES}
from scored group by grouping sets ((role), (turn), ())""")
def cer_grouping_sets(spark, sf_dir):
    return rounded(metrics.cer_grouping_sets(metrics.score(pairs(spark, sf_dir)), ["role", "turn"]), "cer", "macro_cer")


@query(f"with {PAIRS} select conv_id, turn, cast(distance as bigint) as distance, true as kinds_add_up, length(hypothesis) - length(reference) as surplus from scored")
def edit_ops_ascii(spark, sf_dir):
    out = metrics.score(pairs(spark, sf_dir), with_kinds=True)
    adds_up = F.col("substitutions") + F.col("deletions") + F.col("insertions") == F.levenshtein("reference", "hypothesis")
    return out.select("conv_id", "turn", "distance", adds_up.alias("kinds_add_up"), (F.col("insertions") - F.col("deletions")).alias("surplus"))


@query()
def edit_kinds(spark, sf_dir):
    """Substitutions, deletions and insertions of each turn, one by one."""
    return metrics.score(pairs(spark, sf_dir), with_kinds=True).select("conv_id", "turn", "distance", "substitutions", "deletions", "insertions")


def two_systems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """System a hears the turn, system b the turn without vowels; numbered. Written once: whoever reads it again doesn't score again."""
    said = save(pairs(spark, sf_dir).select(F.expr("conv_id * 1000 + turn").alias("utt_id"), "reference", "hypothesis"), "systems-said")
    rows = metrics.score(said)
    other = metrics.score(said.withColumn("hypothesis", F.translate("hypothesis", "aeiou", "")))
    return save(metrics.paired(rows, other), "systems")


SYSTEMS = f"{PAIRS}, systems as (select conv_id * 1000 + turn as utt_id, reference_length, distance as distance_a, {distance_sql('reference', "translate(hypothesis, 'aeiou', '')")} as distance_b from scored)"


@query(f"with {SYSTEMS} select utt_id, cast(distance_a as bigint) as distance_a, cast(distance_b as bigint) as distance_b, reference_length, round((distance_a - distance_b) / reference_length, 9) as delta from systems where reference_length > 0 and distance_a <> distance_b order by abs((distance_a - distance_b) / reference_length) desc, utt_id limit 8")
def paired_disagreements(spark, sf_dir):
    return rounded(metrics.disagreements(two_systems(spark, sf_dir)), "delta")


@query(f"""with {SYSTEMS}, numbered as (select *, row_number() over (order by utt_id) - 1 as number, count(*) over () as n from systems where reference_length > 0),
draws as (select r.r as replicate, (7919 * r.r + 104729 * i.number + 1299709 * r.r * i.number) % i.n as number from range(200) r(r), numbered i)
select replicate, round(cast(sum(distance_a) - sum(distance_b) as double) / sum(reference_length), 9) as diff from draws join numbered using (number) group by replicate""")
def paired_bootstrap_lcg(spark, sf_dir):
    kept = two_systems(spark, sf_dir).where("reference_length > 0").withColumn("one", F.lit(1).cast("long"))
    numbered = sampling.prefix_sums(kept, "one", ["utt_id"]).withColumnRenamed("before", "number")
    return rounded(metrics.bootstrap_lcg(numbered, 200), "diff")


@query()
def paired_bootstrap(spark, sf_dir):
    return metrics.bootstrap(two_systems(spark, sf_dir), replicates=1000)


@query()
def bootstrap_report(spark, sf_dir):
    """The test's row with the turns on which the two systems differ most."""
    return metrics.significance_report(two_systems(spark, sf_dir), replicates=1000)


@query("with n as (select count(*) as n from (select 1 from conversations where true qualify lag(turn) over (partition by conv_id order by turn) is not null)) select r as replicate, n as draws from n, range(300) t(r)")
def bootstrap_draws(spark, sf_dir):
    """Each replicate draws as many rows as there are, the draws of all parts added up."""
    pairs_of_turns = two_systems(spark, sf_dir).withColumn("reference_length", F.greatest("reference_length", F.lit(1)))
    return metrics.multinomial_sums(pairs_of_turns, 300).select("replicate", "draws")


# ---------------------------------------------------------------- dictionary terms


def term_chain(source: str, columns: str, field: str) -> str:
    """SQL of the masking search: one step for each term, longest first."""
    sql = f"select {columns}, {field} as rest from {source}"
    for i, t in enumerate(TERMS):
        before = ", ".join(f"n{j}" for j in range(i))
        sql = f"select {columns}{', ' + before if before else ''}, (length(rest) - length(replace(rest, '{t}', ''))) // {len(t)} as n{i}, replace(rest, '{t}', repeat(chr(1), {len(t)})) as rest from ({sql})"
    entries = " union all ".join(f"select {columns}, '{t}' as term, n{i} as n from chain where n{i} > 0" for i, t in enumerate(TERMS))
    return f"with chain as ({sql}) {entries}"


@query(f"with {LEXICON_SQL}, hits as ({term_chain('documents', 'doc_id', 'lower(text)')}) select doc_id, term, category, cast(n as bigint) as n from hits join lexicon using (term)")
def term_hits(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", F.lower("text").alias("text"))
    return metrics.term_hits(docs, lexicon(spark), TERMS, "doc_id", "text")


PAIR_TERMS = f"""{LEXICON_SQL}, {PAIRS}, r as ({term_chain('pairs', 'conv_id, turn', 'reference')}), h as ({term_chain('pairs', 'conv_id, turn', 'hypothesis')}),
recall as (select r.conv_id, r.turn, r.term, r.n as n_reference, least(r.n, coalesce(h.n, 0)) as n_hit from r left join h using (conv_id, turn, term))"""


@query(f"with {PAIR_TERMS} select category, cast(sum(n_reference) as bigint) as n_reference, cast(sum(n_hit) as bigint) as n_hit, round(sum(n_hit) / sum(n_reference), 9) as recall from recall join lexicon using (term) group by category")
def term_category_recall(spark, sf_dir):
    return rounded(metrics.term_categories(metrics.term_recall(pairs(spark, sf_dir), lexicon(spark), TERMS, ["conv_id", "turn"])), "recall")


@query(f"""with {PAIR_TERMS}, each as (select conv_id, turn, sum(n_reference) as r, sum(n_hit) as h from recall group by all)
select count(*) as n_utterances, cast(sum(r) as bigint) as n_reference, cast(sum(h) as bigint) as n_hit, round(sum(h) / sum(r), 9) as recall, round(1 - sum(h) / sum(r), 9) as error_rate, round(count(*) filter (r = h) / count(*), 9) as exact_match from each""")
def term_corpus_metrics(spark, sf_dir):
    one = lexicon(spark).dropDuplicates(["term"])
    recall = metrics.term_recall(pairs(spark, sf_dir), one, TERMS, ["conv_id", "turn"])
    return rounded(metrics.term_metrics(recall, ["conv_id", "turn"]), "recall", "error_rate", "exact_match")


@query(f"""with {LEXICON_SQL}, hits as ({term_chain('documents', 'doc_id', 'lower(text)')}), terms as (select distinct term from lexicon)
select term, cast(coalesce(sum(n), 0) as bigint) as n, count(distinct doc_id) as n_docs, round(count(distinct doc_id) / (select count(*) from documents), 9) as share from terms left join hits using (term) group by term""")
def lexicon_coverage(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", F.lower("text").alias("text"))
    found = docs.select("doc_id", F.explode(text.term_counts(F.col("text"), TERMS)).alias("term", "n"))
    counts = found.groupBy("term").agg(F.sum("n").alias("n"), F.count("*").alias("n_docs"))
    return lexicon(spark).select("term").distinct().join(counts, "term", "left").select("term", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("n_docs", F.lit(0)).alias("n_docs"), F.round(F.try_divide(F.coalesce("n_docs", F.lit(0)), F.lit(docs.count())), 9).alias("share"))


@query(f"with {LEXICON_SQL} select term, count(distinct category) as n_categories from lexicon group by term having count(distinct category) > 1")
def lexicon_collisions(spark, sf_dir):
    return metrics.lexicon_collisions(lexicon(spark))


# ---------------------------------------------------------------- text and duplicates

GRAMS = "case when length(t) = 0 then [] when length(t) < 3 then [t] else list_distinct(list_transform(range(1, length(t) - 1), lambda i: substr(t, i, 3))) end"
KEY = f"regexp_replace(translate(lower(coalesce(text, '')), '{text.DEDUP_PUNCTUATION}', ''), '[\\s\\x1c-\\x1f\\x85\\p{{Z}}]+', '', 'g')"


@query(f"select item_id, len(g) as n_grams, md5(array_to_string(list_sort(g), '|')) as digest from (select item_id, {GRAMS} as g from (select item_id, coalesce(text, '') as t from benchmark))")
def char_ngrams(spark, sf_dir):
    grams = text.char_ngrams(F.coalesce("text", F.lit("")))
    return read(spark, sf_dir, "benchmark").select("item_id", F.size(grams).cast("long").alias("n_grams"), F.md5(F.array_join(F.array_sort(grams), "|")).alias("digest"))


@query(f"select doc_id from (select doc_id, row_number() over (partition by {KEY} order by doc_id) as r from documents) where r = 1")
def exact_dedup(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", F.md5(text.dedup_key(F.coalesce("text", F.lit("")))).alias("key"))
    return dedup.first_of_each(docs, "key", "doc_id").select("doc_id")


TITLE = "regexp_extract(html, '(?s)<title>(.*?)</title>', 1)"


def grams_of_titles(spark, sf_dir):
    """Trigrams of page titles: texts of the length of a spoken sentence."""
    key = text.dedup_key(F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1), ascii_only=True)
    return read(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), text.char_ngrams(key).alias("grams")).where("size(grams) > 0")


@query(f"""with t as (select page_id as id, {KEY.replace("coalesce(text, '')", TITLE)} as t from pages), g as (select id, list_sort({GRAMS}) as g from t where t <> ''),
f as (select *, min(id) over (partition by g) as first from g)
select first as a, id as b, 1.0::double as similarity from f where id <> first
union all select x.id, y.id, round(len(list_intersect(x.g, y.g)) / (len(x.g) + len(y.g) - len(list_intersect(x.g, y.g))), 9) from f x join f y on x.id < y.id and x.id = x.first and y.id = y.first
and least(len(x.g), len(y.g)) >= 0.9 * greatest(len(x.g), len(y.g)) where len(list_intersect(x.g, y.g)) >= 0.9 * (len(x.g) + len(y.g) - len(list_intersect(x.g, y.g)))""")
def near_dup_pairs(spark, sf_dir):
    """Pairs of titles whose trigram sets are 0.9 alike; of titles with equal sets, pairs with the first of them."""
    return rounded(dedup.near_pairs(grams_of_titles(spark, sf_dir), save, candidates=dedup.banded_pairs), "similarity")


def grams_of_documents(spark, sf_dir):
    """Trigrams of the dedup keys of whole texts of documents, as numbers."""
    batch = "spark.sql.execution.arrow.maxRecordsPerBatch"  # rows carry whole texts and their grams
    spark.conf.set(batch, str(min(int(spark.conf.get(batch)) or 500, 500)))
    docs = read(spark, sf_dir, "documents").where("doc_id is not null")
    grams = text.trigram_codes(F.lower(text.nfkc(F.coalesce("text", F.lit("")))))
    # the filter reads what was written: above the functions it would have each of them run twice
    return save(docs.select(F.col("doc_id").alias("id"), grams.alias("grams")), "document-grams").where("size(grams) > 0")


@query()
def near_dup_document_pairs(spark, sf_dir):
    """near_dup_pairs over the whole texts of documents."""
    return rounded(dedup.near_pairs(grams_of_documents(spark, sf_dir), save, candidates=dedup.block_pairs), "similarity")


@query()
def near_dup_greedy(spark, sf_dir):
    """What first-come, first-kept acceptance keeps of the whole texts of documents."""
    return dedup.accept_texts(grams_of_documents(spark, sf_dir), save)


MARKS = PUNCT + text.CJK_PUNCTUATION.replace("　", "").replace("'", "''")


@query(f"""with c as (select doc_id, length(t) as n, len(regexp_extract_all(t, '[\\x{{4e00}}-\\x{{9fff}}]')) as cjk, len(regexp_extract_all(t, '[A-Za-z]')) as latin, len(regexp_extract_all(t, '[0-9]')) as digit,
length(t) - length(translate(t, '{MARKS}', '')) as punct, len(regexp_extract_all(t, '[\\s\\x0b\\x1c-\\x1f\\x85\\p{{Z}}]')) as space from (select doc_id, coalesce(text, '') as t from documents)) select doc_id, cjk, latin, digit, punct, space, n - cjk - latin - digit - punct - space as other from c""")
def script_profile(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", text.script_profile(F.col("text")).alias("p")).select("doc_id", "p.*")


@query("select 'c2a1a0f12d' as fingerprint")
def config_fingerprint(spark, sf_dir):
    fixed = {"nfkc": True, "strip_punctuation": True, "lowercase": True, "remove_whitespace": True, "traditional_to_simplified": False, "normalize_numbers": False, "keep_digit_separators": True, "strip_language_tag": True}
    return spark.range(1).select(text.fingerprint(fixed).alias("fingerprint"))


# ---------------------------------------------------------------- statistics, validation and gates


@query("""select lang, count(*) as n, min(n_chars) as min, max(n_chars) as max, round(avg(n_chars), 9) as mean,
list_sort(list(n_chars))[cast(floor(0.1 * count(*)) as int) + 1] as p10, list_sort(list(n_chars))[cast(floor(0.5 * count(*)) as int) + 1] as median, list_sort(list(n_chars))[cast(floor(0.9 * count(*)) as int) + 1] as p90 from documents group by lang""")
def length_stats(spark, sf_dir):
    return rounded(validate.index_percentiles(read(spark, sf_dir, "documents"), "n_chars", "lang", {"p10": 0.1, "median": 0.5, "p90": 0.9}), "mean")


def manifest(spark, sf_dir):
    """Documents as a manifest, with faults of all kinds at fixed places."""
    at = lambda n: F.col("doc_id") % n
    return read(spark, sf_dir, "documents").select(
        F.when(at(97) != 0, F.col("doc_id").cast("string")).alias("utt_id"), F.concat(F.lit("a/"), "doc_id").alias("audio"), F.when(at(89) == 0, "  ").otherwise(F.col("text")).alias("text"),
        F.concat(F.lit("SPK"), at(32).cast("string")).alias("speaker_id"), F.when(at(83) == 0, "radio").when(at(7) == 0, "public").otherwise("human").alias("source"),
        F.when(at(7) == 0, "general").when(at(79) == 0, "general").otherwise("numeric").alias("domain_category"), F.col("source").alias("template_family"),
        ((F.col("n_chars") - 20) / 100).alias("duration"), F.when(at(5) == 0, "noise").when(at(5) == 1, "competing_speech").otherwise("clean").alias("condition"),
        F.when((at(5) == 0) & (at(3) != 0) | (at(71) == 2), 10.0).alias("snr"), F.when((at(5) == 1) & (at(3) != 0), 8.0).alias("sir"),
    )


MANIFEST = """manifest as (select case when doc_id % 97 <> 0 then cast(doc_id as varchar) end as utt_id, case when doc_id % 89 = 0 then '  ' else text end as text, concat('SPK', doc_id % 32) as speaker_id,
case when doc_id % 83 = 0 then 'radio' when doc_id % 7 = 0 then 'public' else 'human' end as source, case when doc_id % 7 = 0 or doc_id % 79 = 0 then 'general' else 'numeric' end as domain_category,
source as template_family, (n_chars - 20) / 100 as duration, case doc_id % 5 when 0 then 'noise' when 1 then 'competing_speech' else 'clean' end as condition,
case when (doc_id % 5 = 0 and doc_id % 3 <> 0) or doc_id % 71 = 2 then 10.0::double end as snr, case when doc_id % 5 = 1 and doc_id % 3 <> 0 then 8.0::double end as sir from documents)"""


@query(f"""with {MANIFEST}, found as (
select 'error' as level, 'missing utt_id' as finding from manifest where utt_id is null
union all select 'error', 'blank text' from manifest where trim(text) = ''
union all select 'error', 'unknown source' from manifest where source not in ('synthetic_qwen3tts', 'synthetic_cosyvoice3', 'human', 'public')
union all select 'warning', 'category outside the taxonomy' from manifest where domain_category <> 'numeric' and not (domain_category = 'general' and source = 'public')
union all select 'error', 'noise without snr' from manifest where condition = 'noise' and snr is null
union all select 'error', 'competing speech without sir' from manifest where condition = 'competing_speech' and sir is null
union all select 'error', 'clean with snr or sir' from manifest where condition = 'clean' and (snr is not null or sir is not null)
union all select 'error', 'duration not positive' from manifest where duration <= 0
union all select 'warning', 'duration over 30 s' from manifest where duration > 30) select level, finding, count(*) as n from found group by all""")
def manifest_validate(spark, sf_dir):
    return validate.manifest_findings(manifest(spark, sf_dir)).groupBy("level", "finding").agg(F.count("*").alias("n"))


@query(f"with {MANIFEST} select count(*) as n_utterances, round(sum(duration), 4) as duration, round(sum(duration) / 3600, 6) as hours, count(distinct speaker_id) as n_speakers, count(distinct template_family) as n_families from manifest")
def manifest_summary(spark, sf_dir):
    return validate.manifest_summary(manifest(spark, sf_dir)).withColumns({"duration": F.round("duration", 4), "hours": F.round("hours", 6)})


@query(f"with {MANIFEST} select dimension, value, count(*) as n from (select unnest([{{'dimension': 'source', 'value': source}}, {{'dimension': 'condition', 'value': condition}}, {{'dimension': 'domain_category', 'value': domain_category}}], recursive := true) from manifest) group by all")
def manifest_counts(spark, sf_dir):
    return validate.counts_by(manifest(spark, sf_dir), ["source", "condition", "domain_category"])


@query(f"with {MANIFEST} select utt_id from manifest where utt_id is not null and (condition <> 'clean' or snr is not null or sir is not null)")
def condition_purity(spark, sf_dir):
    return validate.impure_conditions(manifest(spark, sf_dir)).where("utt_id is not null").select("utt_id")


@query("""select doc_id, case when k is null then 'unknown key' else 'text differs' end as finding from (select d.doc_id, l.doc_id as k, d.source as s, case when l.quality = 1 then d.source else 'low' end as s_2 from documents d left join labels l using (doc_id)) where k is null or s <> s_2""")
def fk_text_mismatch(spark, sf_dir):
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    known = docs.join(labels, "doc_id").select("doc_id", F.when(F.col("quality") == 1, F.col("source")).otherwise("low").alias("source"))
    return validate.foreign_keys(docs, known, "doc_id", "source")


SPLIT = "case when substr(md5(concat('42|', source)), 1, 1) < '8' then 'train' when substr(md5(concat('42|', source)), 1, 1) < 'c' then 'dev' else 'test' end"


def with_split(rows: DataFrame) -> DataFrame:
    digit = F.substring(sampling.hash_order("source"), 1, 1)
    return rows.withColumn("split", F.when(digit < "8", "train").when(digit < "c", "dev").otherwise("test"))


@query(f"select md5(text) as digest, count(distinct {SPLIT}) as n_splits from documents group by text having count(distinct {SPLIT}) > 1")
def split_leak_check(spark, sf_dir):
    rows = with_split(read(spark, sf_dir, "documents")).select(F.md5("text").alias("digest"), "split")
    return sampling.leaks(rows, "digest")


@query(f"with s as (select user_id as k, case user_id % 3 when 0 then 'train' when 1 then 'dev' else case when event_type = 'click' then 'train' else 'test' end end as split from events), e as (select distinct * from s) select a.split as split_a, b.split as split_b, count(*) as n_shared from e a join e b using (k) where a.split < b.split group by all")
def speaker_overlap(spark, sf_dir):
    split = F.when(F.col("user_id") % 3 == 0, "train").when(F.col("user_id") % 3 == 1, "dev").when(F.col("event_type") == "click", "train").otherwise("test")
    return validate.shared_between_splits(read(spark, sf_dir, "events").select("user_id", split.alias("split")), "user_id")


@query("select n_rows, count(*) as n_keys from (select conv_id, count(*) as n_rows from conversations group by 1) group by 1")
def renderings_histogram(spark, sf_dir):
    return validate.renderings(read(spark, sf_dir, "conversations"), "conv_id")


@query("select max(n) as busiest, cast(sum(n) as bigint) as n_rows, max(n) / sum(n) as share from (select source, count(*) as n from documents group by 1)")
def busiest_share(spark, sf_dir):
    return validate.busiest_share(read(spark, sf_dir, "documents"), "source")


@query(f"with {MANIFEST}, f as (select case when condition = 'clean' and snr is not null then 'error' when duration > 30 then 'warning' end as level from manifest) select count(*) filter (level = 'fatal') as n_fatal, count(*) filter (level = 'error') as n_error, count(*) filter (level = 'warning') as n_warning, case when count(*) filter (level in ('fatal', 'error')) > 0 then 'rejected' when count(*) filter (level = 'warning') > 0 then 'accepted with warnings' else 'accepted' end as verdict from f")
def acceptance_verdict(spark, sf_dir):
    level = F.when((F.col("condition") == "clean") & F.col("snr").isNotNull(), "ERROR").when(F.col("duration") > 30, "WARNING")
    return validate.verdict(manifest(spark, sf_dir).select(level.alias("level")))


# ---------------------------------------------------------------- splits, samples and budgets


@query(f"select lang, {SPLIT} as split, count(*) as n, count(distinct source) as n_families from documents group by all")
def family_split_report(spark, sf_dir):
    rows = with_split(read(spark, sf_dir, "documents"))
    return rows.groupBy("lang", "split").agg(F.count("*").alias("n"), F.count_distinct("source").alias("n_families"))


@query()
def family_assignment(spark, sf_dir):
    """Whole sources to splits, by the largest deficit, in every language."""
    return sampling.split_families(read(spark, sf_dir, "documents"), "lang", "source")


@query("select lang, doc_id, cast(r as int) as rank from (select lang, doc_id, row_number() over (partition by lang order by md5(concat('42|', doc_id)), doc_id) as r from documents) where r <= 40")
def stratified_topn(spark, sf_dir):
    return sampling.top_of_each(read(spark, sf_dir, "documents").select("lang", "doc_id"), "lang", ["doc_id"], 40).select("lang", "doc_id", "rank")


@query("select conv_id, turn, cast(row_number() over (partition by md5(coalesce(nullif(text, ''), cast(conv_id as varchar))) order by conv_id, turn) - 1 as int) as pass_no from conversations")
def occurrence_passes(spark, sf_dir):
    rows = read(spark, sf_dir, "conversations").withColumn("key", F.md5(F.coalesce(F.nullif(F.col("text"), F.lit("")), F.col("conv_id").cast("string")))).withColumn("place", F.struct("conv_id", "turn"))
    return sampling.occurrence(rows, ["key"], "place").select("conv_id", "turn", "pass_no")


BUDGETS = {"b1": 50_000.0, "b5": 250_000.0, "b10": 500_000.0}


@query("""select doc_id, before, before < 50000 as in_b1, before < 250000 as in_b5, before < 500000 as in_b10 from (select doc_id, cast(coalesce(sum(n_chars) over (order by doc_id rows between unbounded preceding and 1 preceding), 0) as bigint) as before from documents)""")
def nested_budget_prefix(spark, sf_dir):
    rows = sampling.nested_budgets(read(spark, sf_dir, "documents").select("doc_id", "n_chars"), "n_chars", ["doc_id"], BUDGETS)
    return rows.select("doc_id", F.col("before").cast("long").alias("before"), *(F.array_contains("subsets", b).alias(f"in_{b}") for b in BUDGETS))


@query("""with s as (select doc_id, coalesce(sum(n_chars) over (order by doc_id rows between unbounded preceding and 1 preceding), 0) as before from documents)
select doc_id from s where before < 50000 and not before < 250000 or before < 250000 and not before < 500000""")
def nesting_violations(spark, sf_dir):
    rows = sampling.nested_budgets(read(spark, sf_dir, "documents").select("doc_id", "n_chars"), "n_chars", ["doc_id"], BUDGETS)
    return sampling.nesting_violations(rows, BUDGETS).select("doc_id")


@query("select doc_id, lang, round((row_number() over (partition by lang order by md5(concat('42|', doc_id)), doc_id) - 0.5) / count(*) over (partition by lang), 9) as position from documents")
def balanced_order(spark, sf_dir):
    return rounded(sampling.balanced_position(read(spark, sf_dir, "documents").select("doc_id", "lang"), "lang", "doc_id"), "position")


@query("select format('SPK{:02d}', k) as speaker_id, count(*) as n from (select (row_number() over (order by md5(concat('42|', doc_id)), doc_id) - 1) % (select count(*) from supplier) as k from documents) group by k")
def round_robin_assign(spark, sf_dir):
    """A speaker for every document, dealt in turn in hash order."""
    return sampling.round_robin(read(spark, sf_dir, "documents").select("doc_id"), inventory_rows(spark, sf_dir), ["doc_id"], "speaker_id").groupBy("speaker_id").agg(F.count("*").alias("n"))


@query("select doc_id from (select doc_id, row_number() over (order by doc_id) - 1 as r from documents) where r % 50 = 0")
def every_kth(spark, sf_dir):
    return sampling.every_kth(read(spark, sf_dir, "documents").select("doc_id"), "doc_id", 50)


@query("select lang, doc_id from (select lang, doc_id, row_number() over (partition by lang order by doc_id) as r from documents) order by r, lang limit 25")
def category_cycling(spark, sf_dir):
    ranked = read(spark, sf_dir, "documents").select("lang", "doc_id", F.row_number().over(Window.partitionBy("lang").orderBy("doc_id")).alias("r")).where("r <= 25")
    return ranked.orderBy("r", "lang").limit(25).select("lang", "doc_id")


@query("select distinct doc_id from documents where lang = 'en' intersect select doc_id from labels where quality = 1 except select doc_id from labels where toxic = 1")
def set_operations(spark, sf_dir):
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    return docs.where("lang = 'en'").select("doc_id").intersect(labels.where("quality = 1").select("doc_id")).subtract(labels.where("toxic = 1").select("doc_id"))


@query("""select doc_id, case when u < 0.40 then 'clean' when u < 0.58 then 'noise' when u < 0.64 then 'reverb' when u < 0.70 then 'noise_reverb' when u < 0.85 then 'competing_speech' else 'codec' end as condition
from (select doc_id, cast(('0x' || substr(sha256(concat('42::', doc_id)), 1, 13)) as bigint) / 4503599627370496.0::double as u from documents)""")
def condition_plan(spark, sf_dir):
    return augment.plan_conditions(read(spark, sf_dir, "documents").select("doc_id"), "doc_id")


# ---------------------------------------------------------------- inventories, templates and configurations

GENDERS, PITCHES, ENERGIES = ["female", "male"], ["low", "middle", "bright"], ["even", "mild", "strong"]


def inventory_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A voice for each supplier, its attributes dealt out at strides."""
    i = F.col("s_suppkey")
    pick = lambda values, at: F.element_at(F.array(*map(F.lit, values)), (at % len(values)).cast("int") + 1)
    return read(spark, sf_dir, "supplier").select(i.alias("n"), F.format_string("SPK%02d", i).alias("speaker_id"), pick(GENDERS, i).alias("gender"), pick(["young", "middle", "old"], i).alias("age"), pick(["slow", "medium", "fast"], F.floor(i / 2)).alias("rate"), pick(PITCHES, F.floor(i / 3)).alias("pitch"), pick(["a0", "a1", "a2", "a3"], i * 3).alias("accent"), pick(ENERGIES, F.floor(i / 4)).alias("energy"))


@query("""select i as n, format('SPK{:02d}', i) as speaker_id, ['female', 'male'][i % 2 + 1] as gender, ['young', 'middle', 'old'][i % 3 + 1] as age, ['slow', 'medium', 'fast'][(i // 2) % 3 + 1] as rate, ['low', 'middle', 'bright'][(i // 3) % 3 + 1] as pitch, ['a0', 'a1', 'a2', 'a3'][(i * 3) % 4 + 1] as accent, ['even', 'mild', 'strong'][(i // 4) % 3 + 1] as energy from (select s_suppkey as i from supplier)""")
def speaker_inventory(spark, sf_dir):
    return inventory_rows(spark, sf_dir)


@query("""with i as (select i, ['female', 'male'][i % 2 + 1] as gender, ['young', 'middle', 'old'][i % 3 + 1] as age, ['slow', 'medium', 'fast'][(i // 2) % 3 + 1] as rate, ['low', 'middle', 'bright'][(i // 3) % 3 + 1] as pitch, ['a0', 'a1', 'a2', 'a3'][(i * 3) % 4 + 1] as accent, ['even', 'mild', 'strong'][(i // 4) % 3 + 1] as energy,
case when i < 20 then 'train' when i < 26 then 'dev' else 'test' end as pool from (select s_suppkey as i from supplier)), a as (select pool, unnest([{'attribute': 'gender', 'value': gender}, {'attribute': 'age', 'value': age}, {'attribute': 'rate', 'value': rate}, {'attribute': 'pitch', 'value': pitch}, {'attribute': 'accent', 'value': accent}, {'attribute': 'energy', 'value': energy}], recursive := true) from i)
select coalesce(pool, 'all') as pool, attribute, value, count(*) as n from a where true group by grouping sets ((attribute, value), (pool, attribute, value)) having grouping(pool) = 1 or attribute in ('gender', 'age', 'accent')""")
def inventory_report(spark, sf_dir):
    """Voices by six attributes, and in each pool by three."""
    voices = inventory_rows(spark, sf_dir).withColumn("pool", F.when(F.col("n") < 20, "train").when(F.col("n") < 26, "dev").otherwise("test"))
    whole = validate.counts_by(voices, ["gender", "age", "rate", "pitch", "accent", "energy"]).withColumn("pool", F.lit("all"))
    cells = F.explode(F.array(*(F.struct(F.lit(c).alias("dimension"), F.col(c).alias("value")) for c in ("gender", "age", "accent"))))
    by_pool = voices.select("pool", cells.alias("d")).groupBy("pool", "d.dimension", "d.value").agg(F.count("*").alias("n"))
    return whole.unionByName(by_pool).withColumnRenamed("dimension", "attribute")


@query("""with p as (select p_partkey as id, concat('{', replace(p_brand, '#', '_'), '} is {', split_part(p_type, ' ', 1), '} and {', split_part(p_type, ' ', 1), '2}') as pattern, p_brand as family_id, split_part(p_type, ' ', 1) as category from part),
s as (select distinct id, unnest(regexp_extract_all(pattern, '\\{(\\w+)\\}', 1)) as slot from p) select category, family_id, cast(sum(c) as bigint) as capacity, count(*) as n_patterns from (select id, cast(product(length(slot)) as bigint) as c from s group by id) join p using (id) group by all""")
def template_capacity(spark, sf_dir):
    kind = F.split_part("p_type", F.lit(" "), F.lit(1))
    pattern = F.concat(F.lit("{"), F.replace("p_brand", F.lit("#"), F.lit("_")), F.lit("} is {"), kind, F.lit("} and {"), kind, F.lit("2}"))
    patterns = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("pattern_id"), F.col("p_brand").alias("family_id"), kind.alias("category"), pattern.alias("pattern"))
    names = patterns.select(F.explode(templates.slots(F.col("pattern"))).alias("slot")).distinct()
    capacities = templates.pattern_capacities(patterns, names.select("slot", F.char_length("slot").alias("size")))
    return templates.family_capacities(capacities)


@query("select o_orderkey, [o_orderkey // 35 % 3, o_orderkey // 7 % 5, o_orderkey % 7] as digits from orders")
def mixed_radix_decode(spark, sf_dir):
    return read(spark, sf_dir, "orders").select("o_orderkey", templates.decode(F.col("o_orderkey") % 105, F.array(F.lit(3).cast("long"), F.lit(5).cast("long"), F.lit(7).cast("long"))).alias("digits"))


@query("""with g(phase, model, arm, budget, augmented, replay, seed) as (select '8', 'qwen06', 'zero', null, false, false, 42 union all select '15', 'qwen17', 'zero', null, false, false, 42
union all select '10', 'qwen06', unnest(['full', 'audiolora', 'proj', 'textlora', 'audiolora_proj', 'textlora_proj', 'dualpeft']), '20h', false, false, 42 union all select '12', 'qwen06', a, b, false, false, 42 from (select unnest(['full', 'textlora', 'dualpeft']) as a), (select unnest(['1h', '5h', '10h']) as b)
union all select '13', 'qwen06', 'dualpeft', '20h', true, false, 42 union all select '14', 'qwen06', 'dualpeft', '20h', false, true, 42 union all select '15', 'qwen17', unnest(['dualpeft', 'full']), '20h', false, false, 42 union all select '17', 'qwen06', a, '1h', false, false, s from (select unnest(['textlora', 'dualpeft']) as a), (select unnest([123, 2026]) as s))
select *, concat(model, '_', arm, coalesce('_' || budget, ''), case when augmented then '_aug' else '' end, case when replay then '_replay' else '' end, case when seed <> 42 then concat('_seed', seed) else '' end) as name, case when arm = 'full' then 2e-5::double else 1e-4::double end as learning_rate,
case budget when '1h' then 3 when '5h' then 2 else 1 end as epochs, arm = 'full' as gradient_checkpointing, case when arm <> 'zero' then concat('data/manifests/train_', budget, case when replay then '_replay' when augmented then '_aug' else '' end, '.jsonl') end as train_manifest from g""")
def config_grid(spark, sf_dir):
    return report.config_grid(spark)


NAMED = """p as (select *, coalesce(['qwen06', 'qwen17', 'qwen' || p_size, 'other' || p_size, 'qwen'][p_partkey % 5 + 1]) as model_key, ['zero', 'full', 'audiolora', 'proj', 'textlora', 'audiolora_proj', 'textlora_proj', 'dualpeft', 'lora'][p_partkey % 9 + 1] as arm_key,
[null, '1h', '5h', '20h'][p_partkey % 4 + 1] as budget, p_partkey % 3 = 0 as augmented, p_partkey % 7 = 0 as replay, case when p_partkey % 2 = 0 then 42 else p_partkey end as seed from part),
n as (select *, model_key || '_' || arm_key || coalesce('_' || budget, '') || case when augmented then '_aug' else '' end || case when replay then '_replay' else '' end || case when p_partkey % 2 = 1 then '_seed' || p_partkey else '' end || case when p_partkey % 13 = 0 then '_aug' else '' end as experiment from p)"""


@query(f"""with {NAMED} select experiment, model_key, case model_key when 'qwen06' then 'Qwen3-ASR-0.6B' when 'qwen17' then 'Qwen3-ASR-1.7B' else model_key end as model, arm_key,
case arm_key when 'zero' then 'A0 Zero-shot' when 'full' then 'A1 Full SFT' when 'audiolora' then 'A2 Audio-LoRA' when 'proj' then 'A3 Projection only' when 'textlora' then 'A4 Text-LoRA' when 'audiolora_proj' then 'A5 Audio-LoRA + Proj' when 'textlora_proj' then 'A6 Text-LoRA + Proj' else 'A7 DualPEFT' end as arm,
budget, case when p_partkey % 13 = 0 then true else augmented end as augmented, replay, cast(seed as int) as seed from n
where regexp_full_match(model_key, 'qwen[0-9]+') and arm_key <> 'lora' and (p_partkey % 13 <> 0 or (not augmented and not replay and p_partkey % 2 = 0))""")
def experiment_names(spark, sf_dir):
    """Names made from parts, some of which don't fit, and what they say."""
    pick = lambda values, at: F.element_at(F.array(*values), (at + 1).cast("int"))
    key, word = F.col("p_partkey"), lambda condition, w: F.when(condition, w).otherwise(F.lit(""))
    model = pick([F.lit("qwen06"), F.lit("qwen17"), F.concat(F.lit("qwen"), "p_size"), F.concat(F.lit("other"), "p_size"), F.lit("qwen")], key % 5)
    arm = pick([*map(F.lit, [*report.ARMS, "lora"])], key % 9)
    budget = pick([F.lit(""), F.lit("_1h"), F.lit("_5h"), F.lit("_20h")], key % 4)
    name = F.concat(model, F.lit("_"), arm, budget, word(key % 3 == 0, F.lit("_aug")), word(key % 7 == 0, F.lit("_replay")), word(key % 2 == 1, F.concat(F.lit("_seed"), key)), word(key % 13 == 0, F.lit("_aug")))
    return report.parse_names(read(spark, sf_dir, "part").select(name.alias("experiment")), "experiment")


@query("""with s as (select distinct lang from documents union all select 'xx'), r as (select lang, source, avg(n_chars) as v from documents where source in ('src0', 'src1') or (source = 'src2' and lang = 'en') group by all)
select s.lang, """ + ", ".join(f"coalesce((select format('{{:.2f}}', v) from r where r.lang = s.lang and source = '{c}'), 'XX') as {c}" for c in ("src0", "src1", "src2")) + " from s")
def pivot_report_xx(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    records = docs.where("source in ('src0', 'src1') or (source = 'src2' and lang = 'en')").groupBy("lang", "source").agg(F.avg("n_chars").alias("v"))
    spec = docs.select("lang").distinct().unionByName(spark.createDataFrame([("xx",)], "lang string"))
    return report.pivot_with_missing(records, spec, "lang", "source", ["src0", "src1", "src2"], F.col("v"))


@query("with p as (" + SQL["pivot_report_xx"] + ") select count(*) * 3 as n_cells, cast(sum(cast(src0 = 'XX' as int) + cast(src1 = 'XX' as int) + cast(src2 = 'XX' as int)) as bigint) as n_missing from p")
def missing_cells(spark, sf_dir):
    return report.missing_cells(pivot_report_xx(spark, sf_dir), ["src0", "src1", "src2"])


@query("""select doc_id, script_id, concat(script_id, '_SPK', lpad(cast(doc_id % 32 as varchar), 2, '0')) as utt_id, concat('aishell_', stem) as public_id, nullif(regexp_extract(stem, 'S[0-9]{4}', 0), '') as public_speaker
from (select doc_id, concat('SCR-', source, '-', substr(sha1(text), 1, 12)) as script_id, concat('BAC009S', lpad(cast(doc_id % 10007 as varchar), 4, '0'), 'W', doc_id) as stem from documents)""")
def id_construction(spark, sf_dir):
    """Ids of scripts, of their renderings by a voice, and of public recordings with the speaker that a file name tells."""
    script = F.concat(F.lit("SCR-"), "source", F.lit("-"), F.substring(F.sha1("text"), 1, 12))
    stem = F.concat(F.lit("BAC009S"), F.lpad((F.col("doc_id") % 10007).cast("string"), 4, "0"), F.lit("W"), F.col("doc_id").cast("string"))
    ids = read(spark, sf_dir, "documents").select("doc_id", script.alias("script_id"), stem.alias("stem"))
    voice = F.concat(F.lit("_SPK"), F.lpad((F.col("doc_id") % 32).cast("string"), 2, "0"))
    return ids.select("doc_id", "script_id", F.concat("script_id", voice).alias("utt_id"), F.concat(F.lit("aishell_"), "stem").alias("public_id"), F.nullif(F.regexp_extract("stem", "S[0-9]{4}", 0), F.lit("")).alias("public_speaker"))


@query("select page_id, case when contains(url, 'casino') or contains(url, 'bets') then 'gambling' when contains(url, 'pills') then 'pharmacy' when contains(url, '/blog') or contains(url, 'blog.') then 'blog' else 'other' end as kind from pages")
def path_classes(spark, sf_dir):
    has = lambda x: F.contains("url", F.lit(x))
    kind = F.when(has("casino") | has("bets"), "gambling").when(has("pills"), "pharmacy").when(has("/blog") | has("blog."), "blog").otherwise("other")
    return read(spark, sf_dir, "pages").select("page_id", kind.alias("kind"))


# ---------------------------------------------------------------- arrays

V = "list_transform(embedding, lambda x: cast(x as double))"


@query(f"""with u as (select vec_id, label, list_transform({V}, lambda x: x / sqrt(list_dot_product({V}, {V}))) as e from embeddings),
s as (select label, count(*) as n, list_dot_product(list(d), list(d)) as q from (select label, i, sum(x) as d, max(n) as n from (select label, unnest(e) as x, generate_subscripts(e, 1) as i, count(*) over (partition by label) as n from u) group by all) group by label)
select label, (select count(*) from embeddings e where e.label = s.label) as n, round((q - (select count(*) from embeddings e where e.label = s.label)) / ((select count(*) from embeddings e where e.label = s.label) * ((select count(*) from embeddings e where e.label = s.label) - 1)), 6) as mean_within from s""")
def identity_cohesion(spark, sf_dir):
    """Mean cosine of all pairs within a label, from the sum of unit vectors: no pair is made."""
    unit = lambda e: F.transform(arrays.doubles(e), lambda x: F.try_divide(x, F.sqrt(arrays.dot(e, e))))
    rows = read(spark, sf_dir, "embeddings").select("label", F.posexplode(unit(F.col("embedding"))).alias("i", "x"))
    sums = rows.groupBy("label", "i").agg(F.sum("x").alias("d"), F.count("x").alias("n"))
    out = sums.groupBy("label").agg(F.max("n").alias("n"), F.sum(F.col("d") * F.col("d")).alias("q"))
    return out.select("label", "n", F.round(F.try_divide(F.col("q") - F.col("n"), F.col("n") * (F.col("n") - 1)), 6).alias("mean_within"))


@query(f"""with u as (select vec_id, cast(label as varchar) as label, {V} as e from embeddings where label is not null and list_dot_product({V}, {V}) > 0),
p as (select a.label as l, b.label as m, list_cosine_similarity(a.e, b.e) as c from u a join u b on a.vec_id < b.vec_id), n as (select label, count(*) as n from u group by 1)
select label, n, round((select avg(c) from p where l = label and m = label), 9) as mean_within, round((select min(c) from p where l = label and m = label), 9) as min_within, null::double as mean_between,
round((select max(c) from p where l <> m and (l = label or m = label)), 9) as max_between, null::double as separability from n
union all select null, (select count(*) from u), round(avg(c) filter (l = m), 9), round(min(c) filter (l = m), 9), round(avg(c) filter (l <> m), 9), round(max(c) filter (l <> m), 9), round(avg(c) filter (l = m) - avg(c) filter (l <> m), 9) from p""")
def identity_separability(spark, sf_dir):
    """Cosines within and between labels: for each label the mean and least within; overall also the mean and greatest between, and within less between."""
    out = arrays.separability(read(spark, sf_dir, "embeddings"), "vec_id", "label", "embedding")
    return out.withColumns({c: F.round(c, 9) for c in ("mean_within", "min_within", "mean_between", "max_between", "separability")})


@query(f"""with q as (select vec_id, {V} as e from embeddings where vec_id % 100 = 0), c as (select vec_id, {V} as e from embeddings)
select q.vec_id as query_id, c.vec_id, round(list_cosine_similarity(q.e, c.e), 6) as cosine from q, c where q.vec_id <> c.vec_id and list_cosine_similarity(q.e, c.e) >= 0.3""")
def cosine_pairs(spark, sf_dir):
    """A stated query set (ids divisible by 100) against all rows, blocks of queries against blocks of rows."""
    rows = read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return arrays.near_queries(rows.where("vec_id % 100 = 0"), rows, 0.3).withColumn("cosine", F.round("cosine", 6))


@query(f"""select vec_id, len(embedding) as n_samples, round(len(embedding) / 16000, 9) as duration, round(list_max(list_transform({V}, lambda x: abs(x))), 9) as peak, round(sqrt(list_dot_product({V}, {V}) / len(embedding)), 9) as rms,
round(len(list_filter({V}, lambda x: abs(x) >= 0.3)) / len(embedding), 9) as clipping_ratio, 0 as n_nonfinite, false as is_all_zero from embeddings""")
def array_measure(spark, sf_dir):
    out = read(spark, sf_dir, "embeddings").select("vec_id", arrays.measure(F.col("embedding"), clip_at=0.3).alias("m")).select("vec_id", "m.*")
    return rounded(out, "duration", "peak", "rms", "clipping_ratio")


@query(f"""with m as (select vec_id, len(embedding) / 200.0 as duration, sqrt(list_dot_product({V}, {V}) / len(embedding)) as rms, len(list_filter({V}, lambda x: abs(x) >= 0.3)) / len(embedding) as clipping_ratio from embeddings),
r as (select case when duration < 0.3 then 'duration' end as a, case when clipping_ratio > 0.01 then 'clipping ratio' end as b, case when rms > 0.125001 then 'rms' end as c from m)
select reason, count(*) as n from (select unnest([a, b, c]) as reason from r) where reason is not null group by 1""")
def qc_reasons(spark, sf_dir):
    m = read(spark, sf_dir, "embeddings").select("vec_id", arrays.measure(F.col("embedding"), rate=200, clip_at=0.3).alias("m")).select("vec_id", "m.*")
    stats = {c: F.col(c) for c in ("n_samples", "n_nonfinite", "is_all_zero", "duration", "clipping_ratio", "rms")}
    reasons = m.select(F.explode(arrays.qc_reasons(stats, {"max_rms": 0.125001})).alias("reason"))
    return reasons.groupBy(F.regexp_replace("reason", " (above|below).*", "").alias("reason")).agg(F.count("*").alias("n"))


@query("select event_id, case when value >= 20 then 'likely_quiet' when user_id % 1000 < 100 then 'likely_farfield_or_muffled' when value >= 12 then 'likely_moderate' else 'likely_noisy' end as tier from events")
def tiering(spark, sf_dir):
    tier = F.when(F.col("value") >= 20, "likely_quiet").when(F.col("user_id") % 1000 < 100, "likely_farfield_or_muffled").when(F.col("value") >= 12, "likely_moderate").otherwise("likely_noisy")
    return read(spark, sf_dir, "events").select("event_id", tier.alias("tier"))


@query("""with each as (select user_id, stddev_pop(value) as s, avg(value) as m from events group by 1 having count(value) >= 2) select count(*) as n, round(avg(s), 6) as mean_spread, round(stddev_pop(m), 6) as spread_of_means, round(avg(s) / stddev_pop(m), 6) as ratio from each""")
def identity_stability(spark, sf_dir):
    out = audio.identity_stability(read(spark, sf_dir, "events"), "user_id", "value")
    return out.select("n", *(F.round(c, 6).alias(c) for c in ("mean_spread", "spread_of_means", "ratio")))


TONE = "user_id % 62 * 5 + 75"  # a voice of its own for each user, in Hz


@query(f"""with p as (select distinct user_id, {TONE} + event_id % 3 as f from events), each as (select user_id, count(*) as n, stddev_pop(f) as spread, avg(f) as mean from p group by user_id)
select count(*) as n, round(avg(spread), 1) as mean_spread, round(stddev_pop(mean), -1) as spread_of_means from each where n >= 2""")
def pitch_stability(spark, sf_dir):
    """How far the measured median pitch of a user's recordings (the different tones made from their events) varies, within and between users."""
    tones = read(spark, sf_dir, "events").select("user_id", F.expr(f"{TONE} + event_id % 3").alias("tone")).distinct()
    wave = F.transform(F.sequence(F.lit(0), F.lit(2047)), lambda i: F.sin(i * F.col("tone") * (2 * math.pi / arrays.SAMPLE_RATE)))
    made = tones.repartition("user_id", "tone").select("user_id", wave.alias("signal"))
    out = audio.identity_stability(made.select("user_id", arrays.median_pitch("signal").alias("pitch")), "user_id", "pitch")
    return out.select("n", F.round("mean_spread", 1).alias("mean_spread"), F.round("spread_of_means", -1).alias("spread_of_means"))


@query(f"select vec_id, list_transform(range(0, len(embedding) - 15, 8), lambda i: round(list_dot_product({V}[i + 1 : i + 16], {V}[i + 1 : i + 16]) / 16, 9)) as energies from embeddings")
def frame_energies(spark, sf_dir):
    return read(spark, sf_dir, "embeddings").select("vec_id", F.transform(arrays.frame_energies(F.col("embedding"), 16, 8), lambda x: F.round(x, 9)).alias("energies"))


@query(f"""with v as (select vec_id, {V} as e, case when list_max(list_transform({V}, lambda x: abs(x))) > 0 then list_max(list_transform({V}, lambda x: abs(x))) else 1.0 end as peak from embeddings),
c as (select vec_id, e, peak, list_transform(e, lambda x: round_even((sign(x / peak) * ln(1 + 255 * abs(x / peak)) / ln(256) + 1) / 2 * 255, 0) / 255 * 2 - 1) as q from v)
select vec_id, round(list_sum(list_transform(range(1, len(e) + 1), lambda i: abs(e[i] - sign(q[i]) * (pow(256.0, abs(q[i])) - 1) / 255 * peak))), 6) as error from c""")
def mu_law_codec(spark, sf_dir):
    error = arrays.total(F.zip_with(arrays.doubles(F.col("embedding")), arrays.mu_law(F.col("embedding")), lambda a, b: F.abs(a - b)))
    return read(spark, sf_dir, "embeddings").select("vec_id", F.round(error, 6).alias("error"))


@query("select conv_id, list_transform(range(len(t)), lambda i: case when i >= len(t) - 2 then t[i + 1] else -100 end) as labels from (select conv_id, list(cast(turn as int) order by turn) as t from conversations group by 1)")
def label_mask(spark, sf_dir):
    rows = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.col("turn").cast("int"))).alias("t"))
    return rows.select("conv_id", arrays.label_mask(F.col("t"), F.lit(2)).alias("labels"))


# ---------------------------------------------------------------- totals, collisions, mixes and documents


@query("""select coalesce(p_brand, 'TOTAL') as component, count(*) as n_parameters, cast(sum(p_size) as bigint) as total, round(100.0 * sum(p_size) / (select sum(p_size) from part), 6) as percent from part group by rollup (p_brand)""")
def component_totals(spark, sf_dir):
    """Totals of each component and of all, in one pass."""
    rows = read(spark, sf_dir, "part").rollup("p_brand").agg(F.count("*").alias("n_parameters"), F.sum("p_size").cast("long").alias("total"))
    whole = read(spark, sf_dir, "part").agg(F.sum("p_size").alias("whole"))  # one row
    return rows.join(F.broadcast(whole)).select(F.coalesce("p_brand", F.lit("TOTAL")).alias("component"), "n_parameters", "total", F.round(100.0 * F.col("total") / F.col("whole"), 6).alias("percent"))


@query("select split_part(p_name, ' ', 1) as leaf, count(distinct p_brand) as n_components from part group by 1 having count(distinct p_brand) > 1")
def leaf_collisions(spark, sf_dir):
    """Names that stand in more than one component."""
    rows = read(spark, sf_dir, "part").select(F.split_part("p_name", F.lit(" "), F.lit(1)).alias("leaf"), "p_brand")
    return rows.groupBy("leaf").agg(F.count_distinct("p_brand").alias("n_components")).where("n_components > 1")


@query("""with i as (select i, ['female', 'male'][i % 2 + 1] as gender, ['young', 'middle', 'old'][i % 3 + 1] as age, ['low', 'middle', 'bright'][(i // 3) % 3 + 1] as pitch from (select s_suppkey as i from supplier))
select 'gender' as dimension, gender as value, count(*) as n from i group by 2 union all select 'age', age, count(*) from i group by 2 union all select 'pitch', pitch, count(*) from i group by 2""")
def inventory_balance(spark, sf_dir):
    return validate.counts_by(inventory_rows(spark, sf_dir), ["gender", "age", "pitch"])


@query("""with p as (select case when u < 0.40 then 'clean' when u < 0.58 then 'noise' when u < 0.64 then 'reverb' when u < 0.70 then 'noise_reverb' when u < 0.85 then 'competing_speech' else 'codec' end as condition
from (select cast(('0x' || substr(sha256(concat('42::', doc_id)), 1, 13)) as bigint) / 4503599627370496.0::double as u from documents)),
w(condition, target) as (values ('clean', 0.40::double), ('noise', 0.18), ('reverb', 0.06), ('noise_reverb', 0.06), ('competing_speech', 0.15), ('codec', 0.15))
select condition, target, count(p.condition) as n, round(count(p.condition) / (select count(*) from p), 9) as realised from w left join p using (condition) group by all""")
def planned_mix(spark, sf_dir):
    """Shares that conditions should have and have."""
    counts = condition_plan(spark, sf_dir).groupBy("condition").agg(F.count("*").alias("n"))
    target = spark.createDataFrame(list(augment.CONDITION_WEIGHTS.items()), "condition string, target double")
    whole = read(spark, sf_dir, "documents").count()
    return target.join(counts, "condition", "left").select("condition", "target", F.coalesce("n", F.lit(0)).alias("n"), F.round(F.try_divide(F.coalesce("n", F.lit(0)), F.lit(whole)), 9).alias("realised"))


@query("""with r as (select doc_id, row_number() over (order by n_chars, doc_id) - 1 as r, count(*) over () as n from documents) select doc_id, r as rank from r where r in (select cast(round_even(k * (n - 1) / 9.0, 0) as bigint) from range(10) t(k))""")
def evenly_spaced(spark, sf_dir):
    """Ten documents at evenly spaced ranks of length."""
    rows = read(spark, sf_dir, "documents").select("doc_id", "n_chars").withColumn("one", F.lit(1).cast("long"))
    ranked = sampling.prefix_sums(rows, "one", ["n_chars", "doc_id"])
    n = rows.count()
    wanted = sorted({round(k * (n - 1) / 9) for k in range(10)})
    return ranked.where(F.col("before").isin(wanted)).select("doc_id", F.col("before").alias("rank"))


@query(f"with {PAIRS} select 'overall' as part, '' as key, count(*) as n, cast(sum(distance) as bigint) as errors from scored where reference_length > 0 union all select 'by_role', role, count(*), cast(sum(distance) as bigint) from scored where reference_length > 0 group by role")
def eval_document(spark, sf_dir):
    """The parts of an evaluation's metrics document, in long form."""
    kept = metrics.score(pairs(spark, sf_dir)).where("reference_length > 0")
    each = lambda part, key: (F.lit(part).alias("part"), key.alias("key"))
    sums = (F.count("*").alias("n"), F.sum("distance").alias("errors"))
    overall = kept.groupBy(*each("overall", F.lit(""))).agg(*sums)
    return overall.unionByName(kept.groupBy(*each("by_role", F.col("role"))).agg(*sums))


@query("select conv_id, count(*) as n_turns, count(*) filter (role = 'user') as n_user, max(length(text)) as longest from conversations group by conv_id having count(*) filter (role = 'user') < count(*)")
def conversation_profile(spark, sf_dir):
    rows = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("n_turns"), F.count_if(F.col("role") == "user").alias("n_user"), F.max(F.char_length("text")).cast("long").alias("longest"))
    return rows.where("n_user < n_turns")


@query("""select lang as category, count(*) as n, round(100.0 * count(*) / sum(count(*)) over (), 2) as pct, count(distinct source) as n_families from documents group by lang""")
def category_shares(spark, sf_dir):
    """Rows, their share and families of each category."""
    docs = read(spark, sf_dir, "documents")
    counts = docs.groupBy(F.col("lang").alias("category")).agg(F.count("*").alias("n"), F.count_distinct("source").alias("n_families"))
    total = counts.agg(F.sum("n").alias("total"))  # one row
    return counts.join(F.broadcast(total)).select("category", "n", F.round(100.0 * F.col("n") / F.col("total"), 2).alias("pct"), "n_families")


@query("select doc_id from documents order by md5(concat('42|', doc_id)), doc_id limit 100")
def seeded_subsample(spark, sf_dir):
    return sampling.subsample(read(spark, sf_dir, "documents").select("doc_id"), "doc_id", 100)


@query("select doc_id from documents order by doc_id limit 50")
def head_after_sort(spark, sf_dir):
    return sampling.first_rows(read(spark, sf_dir, "documents").select("doc_id"), ["doc_id"], 50)


@query("""with r as (select n_regionkey as category, n_name, row_number() over (partition by n_regionkey order by n_name) as r from nation), p as (select *, unnest(range(2)) as pass from r)
select category, n_name, cast(row_number() over (order by pass, r, category) - 1 as int) as turn from p order by pass, r, category limit 40""")
def category_cycling_again(spark, sf_dir):
    """40 of 25 nations, a region in turn: it begins again when all have been taken."""
    return sampling.in_turn(read(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("category"), "n_name"), "category", ["n_name"], 40)
