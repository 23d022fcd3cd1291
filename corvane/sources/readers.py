"""Readers: manifests and predictions as JSON lines, transcripts, shards, experiment trees, audio."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from corvane.sources.files import read_files

KINDS = {"string": T.StringType(), "double": T.DoubleType(), "int": T.IntegerType()}


def schema_of(columns: str) -> T.StructType:
    """A schema from "name kind, name kind"; unlike DDL it needs no session, so that modules can be imported before one."""
    return T.StructType([T.StructField(name, KINDS[kind]) for name, kind in (c.split() for c in columns.split(","))])


MANIFEST = schema_of(
    "utt_id string, audio string, text string, speaker_id string, source string, tts_engine string, domain_category string, template_family string,"
    " duration double, condition string, snr double, sir double, script_id string, split string"
)
PREDICTION = schema_of(
    "utt_id string, reference_raw string, hypothesis_raw string, reference_normalized string, hypothesis_normalized string, edit_distance int, reference_length int,"
    " hypothesis_length int, cer double, condition string, domain_category string, template_family string, speaker_id string, source string, duration double"
)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line (from 1), value of text files, however many splits a file is read in.

    Splits count their lines, the counts are added up over the splits of a file, and each line adds its place in its own
    split: no file is read in order, and what is summed is a row for each split.
    """
    raw = _placed(spark, path)
    splits = raw.groupBy("file", "start").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    earlier = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = splits.select("file", "start", (earlier - F.col("first") + 1).alias("offset"))
    return raw.join(offsets, ["file", "start"]).select("file", (F.col("at") + F.col("offset")).alias("line"), "value")


def _placed(spark: SparkSession, path: str) -> DataFrame:
    """Lines with their file, the split they begin in, and a number that grows in it."""
    return spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("at"))


def _parsed(value: Column, schema: T.StructType) -> Column:
    return F.from_json(value, T.StructType(schema.fields + [T.StructField("_bad", T.StringType())]), {"columnNameOfCorruptRecord": "_bad"})


def malformed_lines(spark: SparkSession, path: str, schema: T.StructType = MANIFEST) -> DataFrame:
    """file, line, value of the lines of JSON-lines files that are neither blank nor JSON of the schema."""
    lines = numbered_lines(spark, path).where(F.trim("value") != "")
    return lines.where(_parsed(F.col("value"), schema)["_bad"].isNotNull())


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType = MANIFEST) -> DataFrame:
    """Rows of JSON-lines files; blank lines are skipped, and a malformed line ends the read with its file and line number."""
    rows = spark.read.text(path).where(F.trim("value") != "").select(_parsed(F.col("value"), schema).alias("r")).where("r._bad is null")
    first = malformed_lines(spark, path, schema).orderBy("file", "line").limit(1)
    said = F.concat(F.col("file"), F.lit(":"), F.col("line").cast("string"), F.lit(" malformed line: "), F.col("value"))
    # in a condition, where no action can do without it
    raised = first.where(F.raise_error(said).isNotNull()).select(_parsed(F.col("value"), schema).alias("r"))
    return rows.unionByName(raised).select("r.*").drop("_bad")


def read_transcripts(spark: SparkSession, path: str) -> DataFrame:
    """utt_id, text of lines "id some text": split once, inner spaces dropped, lines without text left out."""
    line = F.trim("value")
    parts = spark.read.text(path).select(F.regexp_extract(line, r"^(\S+)\s+(.+)$", 1).alias("utt_id"), F.regexp_replace(F.regexp_extract(line, r"^(\S+)\s+(.+)$", 2), r"\s+", "").alias("text"))
    return parts.where("utt_id <> '' and text <> ''")


def read_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """term, category of a JSON file with terms_by_category."""
    whole = spark.read.schema("terms_by_category map<string,array<string>>").option("multiLine", True).json(path)
    return whole.select(F.explode("terms_by_category").alias("category", "terms")).select(F.explode("terms").alias("term"), "category").distinct()


def read_shards(spark: SparkSession, folder: str, split: str) -> DataFrame:
    """Parquet shards <split>-*.parquet with a struct column audio(path, bytes)."""
    return spark.read.parquet(f"{folder}/{split}-*.parquet").select("*", F.col("audio.path").alias("audio_path"), F.col("audio.bytes").alias("audio_bytes")).drop("audio")


TRAINED = "trainable_parameters long, total_parameters long, trainable_percentage double"
SPENT = "peak_vram_gib double, gpu_hours double, train_hours_audio double"
GROUPS = "map<string,struct<n_utterances:long,cer:double,macro_cer:double>>"


def read_experiments(spark: SparkSession, folder: str) -> DataFrame:
    """A row for each experiment and test set below a folder, and one without a test set for experiments that have none.

    Names that don't parse are left out. Training measures come from <experiment>/metrics.json, or else from
    trainable_parameters.json beside it; evaluations from <experiment>/<test set>/metrics.json with an overall part.
    What a file lacks is null, and a file that is no JSON counts as missing.
    """
    from corvane.operators.report import TEST_SET_LABELS, parse_names

    file = F.col("_metadata.file_path")
    part = lambda back: F.element_at(F.split(file, "/"), -back)
    below = lambda name, schema: spark.read.schema(schema).option("mode", "PERMISSIVE").json(folder, multiLine=True, recursiveFileLookup=True, pathGlobFilter=name)
    found = below("metrics.json", f"overall struct<cer:double,macro_cer:double,n_utterances:long,substitutions:long,deletions:long,insertions:long>, medical_terms struct<medical_term_error_rate:double,medical_entity_recall:double,utterance_exact_match:double,by_term_category:map<string,struct<n_reference_terms:long,n_matched_terms:long,term_error_rate:double>>>, by_condition {GROUPS}, by_domain_category {GROUPS}, meta struct<real_time_factor:double>, {TRAINED}, {SPENT}")
    tests = found.where("overall is not null").withColumns({"experiment": part(3), "test_set": part(2), "predictions_path": F.regexp_replace(file, "metrics\\.json$", "predictions.jsonl")}).where("test_set <> 'checkpoints'")
    tests = tests.select("experiment", "test_set", "overall.*", "medical_terms.medical_term_error_rate", "medical_terms.medical_entity_recall", "medical_terms.utterance_exact_match", "by_condition", "by_domain_category", "medical_terms.by_term_category", "meta.real_time_factor", "predictions_path")
    measures = [c.split()[0] for c in f"{TRAINED}, {SPENT}".split(", ")]
    own = found.where("overall is null").select(part(2).alias("experiment"), *measures)
    beside = below("trainable_parameters.json", TRAINED).select(part(2).alias("experiment"), *(F.col(c.split()[0]).alias(f"_{c.split()[0]}") for c in TRAINED.split(", ")))
    names = own.select("experiment").unionByName(beside.select("experiment")).unionByName(tests.select("experiment")).distinct()
    trained = names.join(own, "experiment", "left").join(beside, "experiment", "left")
    trained = trained.withColumns({c.split()[0]: F.coalesce(c.split()[0], f"_{c.split()[0]}") for c in TRAINED.split(", ")}).drop(*(f"_{c.split()[0]}" for c in TRAINED.split(", ")))
    labels = F.create_map(*(F.lit(x) for kv in TEST_SET_LABELS.items() for x in kv))
    both = trained.join(tests, "experiment", "left").withColumn("test_set_label", F.coalesce(F.try_element_at(labels, "test_set"), "test_set"))
    return parse_names(both, "experiment")


def read_audio(spark: SparkSession, folder: str, rate: int = 16000, kind: str = "noise") -> DataFrame:
    """path, signal, error of the WAV and FLAC files below a folder or of a screened index; an unreadable one has an error and no signal."""
    return read_files(spark, folder, "signals", rate=rate, kind=kind)


def file_digests(spark: SparkSession, folder: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"))
