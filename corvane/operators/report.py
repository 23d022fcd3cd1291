"""Experiment records, their configurations, and tables in which a missing result is shown as missing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MISSING = "XX"
# Fixed values of the report: keys in experiment names with their labels, and the labels of test sets.
ARMS = {"zero": "A0 Zero-shot", "full": "A1 Full SFT", "audiolora": "A2 Audio-LoRA", "proj": "A3 Projection only", "textlora": "A4 Text-LoRA", "audiolora_proj": "A5 Audio-LoRA + Proj", "textlora_proj": "A6 Text-LoRA + Proj", "dualpeft": "A7 DualPEFT"}
MODELS = {"qwen06": "Qwen3-ASR-0.6B", "qwen17": "Qwen3-ASR-1.7B"}
MODEL_FAMILY, DEFAULT_SEED = "qwen", 42
TEST_SET_LABELS = {
    "test_synthetic": "Synthetic clean (held-out voices)", "test_synthetic_aug": "Synthetic augmented", "test_cross_tts": "Cross-TTS (CosyVoice3)", "test_human_quiet": "Human quiet",
    "test_human_farfield": "Human far-field", "test_human_noisy": "Human noisy", "test_aishell1": "AISHELL-1 (general)", "test_public_noisy": "Public noisy Mandarin",
}


def labels(keys: Column, table: dict[str, str]) -> Column:
    """The label of each key; a key without one stands for itself."""
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), keys), keys)


def cell(value: Column, digits: int) -> Column:
    """A number as text; never 0 for what isn't there."""
    return F.when(value.isNotNull(), F.format_string(f"%.{digits}f", value.cast("double"))).otherwise(F.lit(MISSING))


#: What may follow model and arm in a name, each at most once and in this order.
NAME_PARTS = {"budget": r"\d+h", "augmented": "aug", "replay": "replay", "seed": r"seed\d+"}


def parse_names(rows: DataFrame, name: str) -> DataFrame:
    """model_key, model, arm_key, arm, budget, augmented, replay and seed of experiment names; rows whose names don't fit go.

    A name is words joined by "_": a model of the family, an arm, and then what NAME_PARTS lists.
    """
    rule = "_".join([rf"({MODEL_FAMILY}\d+)", f"({'|'.join(ARMS)})"]) + "".join(f"(?:_({part}))?" for part in NAME_PARTS.values())
    whole = rf"\A{rule}\z"
    word = {c: F.regexp_extract(name, whole, i) for i, c in enumerate(["model_key", "arm_key", *NAME_PARTS], 1)}
    out = rows.where(F.col(name).rlike(whole)).withColumns(word)
    seed = F.coalesce(F.nullif(F.substring("seed", 5, 18), F.lit("")).cast("int"), F.lit(DEFAULT_SEED))
    out = out.withColumns({"budget": F.nullif("budget", F.lit("")), "augmented": F.col("augmented") != "", "replay": F.col("replay") != "", "seed": seed})
    return out.withColumns({"model": labels(F.col("model_key"), MODELS), "arm": labels(F.col("arm_key"), ARMS)})


def pivot_with_missing(records: DataFrame, spec: DataFrame, row: str, column: str, columns: list[str], value: Column, digits: int = 2) -> DataFrame:
    """The spec's rows by the given columns; a combination without a record is MISSING. Keys may be null."""
    wide = records.groupBy(row).pivot(column, columns).agg(F.max(value))
    joined = spec.select(F.col(row).alias("_spec")).join(wide, F.expr(f"_spec <=> {row}"), "left")
    return joined.select(F.col("_spec").alias(row), *(cell(F.col(c), digits).alias(c) for c in columns))


def missing_cells(table: DataFrame, columns: list[str]) -> DataFrame:
    """n_cells and n_missing of a formatted table."""
    n = sum((F.sum(F.when(F.col(c) == MISSING, 1).otherwise(0)) for c in columns), F.lit(0))
    return table.agg((F.count("*") * len(columns)).alias("n_cells"), n.cast("long").alias("n_missing"))


#: The experiment matrix (fixed values): phase, models, arms, budgets, augmented, replay, seeds; every combination of a line is one run.
MATRIX = [
    ("8", ["qwen06"], ["zero"], [None], False, False, [42]),
    ("15", ["qwen17"], ["zero"], [None], False, False, [42]),
    ("10", ["qwen06"], ["full", "audiolora", "proj", "textlora", "audiolora_proj", "textlora_proj", "dualpeft"], ["20h"], False, False, [42]),
    ("12", ["qwen06"], ["full", "textlora", "dualpeft"], ["1h", "5h", "10h"], False, False, [42]),
    ("13", ["qwen06"], ["dualpeft"], ["20h"], True, False, [42]),
    ("14", ["qwen06"], ["dualpeft"], ["20h"], False, True, [42]),
    ("15", ["qwen17"], ["dualpeft", "full"], ["20h"], False, False, [42]),
    ("17", ["qwen06"], ["textlora", "dualpeft"], ["1h"], False, False, [123, 2026]),
]


def config_grid(spark: SparkSession) -> DataFrame:
    """The training configurations of the matrix: name, keys, learning rate by arm, epochs by budget, training manifest."""
    lines = spark.createDataFrame(MATRIX, "phase string, models array<string>, arms array<string>, budgets array<string>, augmented boolean, replay boolean, seeds array<int>")
    grid = lines
    for many, one in (("models", "model"), ("arms", "arm"), ("budgets", "budget"), ("seeds", "seed")):
        grid = grid.withColumn(one, F.explode(many)).drop(many)
    flag = lambda c, tag: F.when(c, F.lit(tag)).otherwise(F.lit(""))
    budget = F.coalesce(F.concat(F.lit("_"), "budget"), F.lit(""))
    seed = flag(F.col("seed") != 42, "_seed")
    name = F.concat("model", F.lit("_"), "arm", budget, flag(F.col("augmented"), "_aug"), flag(F.col("replay"), "_replay"), seed, F.when(F.col("seed") != 42, F.col("seed").cast("string")).otherwise(""))
    kind = F.when(F.col("replay"), "_replay").when(F.col("augmented"), "_aug").otherwise("")
    return grid.withColumns({
        "name": name, "learning_rate": F.when(F.col("arm") == "full", 2e-5).otherwise(1e-4), "epochs": F.when(F.col("budget") == "1h", 3).when(F.col("budget") == "5h", 2).otherwise(1),
        "gradient_checkpointing": F.col("arm") == "full", "train_manifest": F.when(F.col("arm") != "zero", F.concat(F.lit("data/manifests/train_"), "budget", kind, F.lit(".jsonl"))),
    })


def twin(table: DataFrame, key: str, title: str, order: str) -> DataFrame:
    """A finished table, small by nature, as one JSON text beside its CSV: columns, rows in order, cells and missing cells."""
    columns = [c for c in table.columns if c != order]
    row = F.struct(F.col(order).alias("at"), F.array(*(F.col(c).cast("string") for c in columns)).alias("cells"))
    missing = sum((F.count_if(F.col(c).cast("string") == MISSING) for c in columns), F.lit(0))
    whole = table.agg(F.transform(F.array_sort(F.collect_list(row)), lambda r: r.cells).alias("rows"), missing.alias("n_missing_cells"), (F.count("*") * len(columns)).alias("n_cells"))
    return whole.select(F.to_json(F.struct(F.lit(key).alias("key"), F.lit(title).alias("title"), F.array(*map(F.lit, columns)).alias("columns"), "rows", "n_missing_cells", "n_cells")).alias("document"))


def latex(rows: list[tuple], columns: list[str]) -> str:
    """A finished table, small by nature, as LaTeX."""
    safe = lambda x: "".join({"&": r"\&", "%": r"\%", "_": r"\_", "#": r"\#", "$": r"\$"}.get(c, c) for c in str(x))
    lines = [" & ".join(map(safe, r)) + r" \\" for r in [tuple(columns), *rows]]
    return "\n".join([rf"\begin{{tabular}}{{{'l' * len(columns)}}}", r"\toprule", lines[0], r"\midrule", *lines[1:], r"\bottomrule", r"\end{tabular}"])
