"""The report's seven tables and the sources of its result figures, as lookups of a fixed list of cells in experiment records.

A record is an experiment on a test set: model_key, arm_key, budget (null for zero-shot), augmented, replay, seed,
test_set, and measures. Each table is a list of cells; a cell names the record it wants, a measure and a form.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.operators.report import ARMS, MISSING, MODELS

KEYS = ("model_key", "arm_key", "budget", "augmented", "replay", "seed", "test_set")
# Fixed values of the report.
BUDGETS = {"1h": 1, "5h": 5, "10h": 10, "20h": 20}
TERM_CATEGORIES = ("imaging_exam", "lab_test", "disease", "medication", "department", "symptom", "abbreviation")
TEST_SETS = {"test_synthetic": "Synthetic clean", "test_cross_tts": "Cross-TTS", "test_human_quiet": "Human quiet", "test_human_farfield": "Human far-field", "test_human_noisy": "Human noisy", "test_public_noisy": "Public noisy"}
SYNTH, CROSS, GENERAL = "test_synthetic", "test_cross_tts", "test_aishell1"


@dataclass(frozen=True)
class Cell:
    """One cell: where it stands, the record and the measure it shows, its form, and whether it is a difference to zero-shot.

    form: "pct2" or "pct4" (times 100, that many digits), "plain2", "plain4" or "int". less: 1 shows the record less the
    zero-shot baseline on the same test set, -1 the baseline less the record.
    """

    row: int
    label: str
    column: str
    arm_key: str
    measure: str
    form: str = "pct2"
    model_key: str = "qwen06"
    budget: str | None = "20h"
    augmented: bool = False
    replay: bool = False
    seed: int = 42
    test_set: str = SYNTH
    less: int = 0

    def key(self) -> tuple:
        return tuple(getattr(self, k) for k in KEYS)


def budget_of(arm: str) -> str | None:
    return None if arm == "zero" else "20h"


def _ablation() -> list[Cell]:
    cells = []
    for i, (arm, label) in enumerate(ARMS.items()):
        at = Cell(i, label, "", arm, "", budget=budget_of(arm))
        cells += [
            replace(at, column="trainable", measure="trainable_parameters", form="int"), replace(at, column="share", measure="trainable_percentage", form="plain4"), replace(at, column="cer_synth", measure="cer"),
            replace(at, column="cer_cross", measure="cer", test_set=CROSS), replace(at, column="mter", measure="medical_term_error_rate"), replace(at, column="recall", measure="medical_entity_recall"),
        ]
    return cells


def _data_budget() -> list[Cell]:
    zero = [Cell(0, ARMS["zero"], f"h{h}", "zero", "cer", budget=None) for h in BUDGETS.values()]
    return zero + [Cell(i, ARMS[arm], f"h{h}", arm, "cer", budget=b) for i, arm in enumerate(("full", "textlora", "dualpeft"), 1) for b, h in BUDGETS.items()]


def _robustness() -> list[Cell]:
    return [Cell(i, label, column, arm, "cer", budget=budget_of(arm), augmented=aug, test_set=t) for i, (t, label) in enumerate(TEST_SETS.items()) for column, arm, aug in (("zero", "zero", False), ("plain", "dualpeft", False), ("augmented", "dualpeft", True))]


def _terminology() -> list[Cell]:
    return [Cell(i, c, arm, arm, f"term_error_{c}", budget=budget_of(arm)) for i, c in enumerate(TERM_CATEGORIES) for arm in ("zero", "full", "textlora", "dualpeft")]


def _forgetting() -> list[Cell]:
    rows = [("A0 Zero-shot", "zero", False), ("A1 Full SFT 20 h", "full", False), ("A4 Text-LoRA 20 h", "textlora", False), ("A7 DualPEFT 20 h", "dualpeft", False), ("A7 DualPEFT 20 h + replay", "dualpeft", True)]
    return [Cell(i, label, column, arm, "cer", budget=budget_of(arm), replay=again, test_set=t, less=less) for i, (label, arm, again) in enumerate(rows) for column, t, less in (("hospital", SYNTH, 0), ("general", GENERAL, 0), ("delta", GENERAL, 1))]


def _scale() -> list[Cell]:
    cells = []
    for i, (model, arm) in enumerate((m, a) for m in MODELS for a in ("zero", "dualpeft", "full")):
        at = Cell(i, f"{MODELS[model]} {ARMS[arm]}" + (" 20h" if arm != "zero" else ""), "", arm, "", model_key=model, budget=budget_of(arm))
        cells += [replace(at, column="cer_synth", measure="cer"), replace(at, column="cer_cross", measure="cer", test_set=CROSS), replace(at, column="mter", measure="medical_term_error_rate"), replace(at, column="trainable", measure="trainable_parameters", form="int")]
    return cells


def _efficiency() -> list[Cell]:
    cells = []
    for i, (arm, label) in enumerate(ARMS.items()):
        at = Cell(i, label, "", arm, "", budget=budget_of(arm))
        cells += [
            replace(at, column="trainable", measure="trainable_parameters", form="int"), replace(at, column="share", measure="trainable_percentage", form="plain4"), replace(at, column="vram", measure="peak_vram_gib", form="plain2"),
            replace(at, column="gpu_hours", measure="gpu_hours", form="plain2"), replace(at, column="cer", measure="cer"), replace(at, column="reduction", measure="cer", less=-1),
        ]
    return cells


TABLES = {"ablation": _ablation(), "data_budget": _data_budget(), "robustness": _robustness(), "terminology": _terminology(), "forgetting": _forgetting(), "scale": _scale(), "efficiency": _efficiency()}
#: Arms of the figure of rates against hours, and pairs of the figure of gain against forgetting.
HOURS_CELLS = [Cell(i, ARMS[arm], f"h{h}", arm, "cer", budget=b) for i, arm in enumerate(("full", "textlora", "dualpeft")) for b, h in BUDGETS.items()]
FORGETTING_CELLS = [c for c in TABLES["forgetting"] if not c.less]


def of_experiments(rows: DataFrame) -> DataFrame:
    """Records for the tables from read_experiments(): the term errors of each category as a measure of its own."""
    error = lambda c: F.try_element_at("by_term_category", F.lit(c)).getField("term_error_rate")
    return rows.withColumns({f"term_error_{c}": error(c) for c in TERM_CATEGORIES})


def latest(records: DataFrame, order: str) -> DataFrame:
    """One record for each key, the last in `order`; null keys are keys too."""
    others = [c for c in records.columns if c not in KEYS]
    return records.groupBy(*KEYS).agg(F.max_by(F.struct(*others), order).alias("_r")).select(*KEYS, "_r.*")


def looked_up(spark: SparkSession, cells: list[Cell], records: DataFrame) -> DataFrame:
    """row, label, column, value (null without a record) of each cell; records: latest().

    The list of cells is joined null-safe on the seven keys, and once more with the zero-shot baselines.
    """
    spec = spark.createDataFrame([(c.row, c.label, c.column, c.measure, c.form, c.less, *c.key()) for c in cells], "row int, label string, column string, measure string, form string, less int, model_key string, arm_key string, budget string, augmented boolean, replay boolean, seed int, test_set string")
    measures = sorted({c.measure for c in cells})
    value = F.coalesce(*(F.when(F.col("measure") == m, F.col(m).cast("double")) for m in measures))
    same = lambda other, keys: [F.col(f"spec.{k}").eqNullSafe(F.col(f"{other}.{k}")) for k in keys]
    found = spec.alias("spec").join(records.alias("r"), same("r", KEYS), "left").select("spec.*", value.alias("value"))
    if not any(c.less for c in cells):
        return found
    zero = records.where("model_key = 'qwen06' and arm_key = 'zero' and budget is null and not augmented and not replay and seed = 42").select("test_set", F.col("cer").alias("baseline"))
    both = found.alias("spec").join(F.broadcast(zero).alias("z"), same("z", ("test_set",)), "left")  # a row for each test set
    return both.select("spec.*", "baseline").withColumn("value", F.when(F.col("less") == 0, F.col("value")).otherwise(F.col("less") * (F.col("value") - F.col("baseline")))).drop("baseline")


def shown(value: Column, form: Column) -> Column:
    """A value in its form; MISSING where there is none."""
    text = F.when(form == "int", F.format_number(F.floor(value), 0)).when(form == "pct2", F.format_string("%.2f", value * 100)).when(form == "pct4", F.format_string("%.4f", value * 100))
    text = text.when(form == "plain4", F.format_string("%.4f", value)).otherwise(F.format_string("%.2f", value))
    return F.when(value.isNotNull(), text).otherwise(F.lit(MISSING))


def table(spark: SparkSession, cells: list[Cell], records: DataFrame) -> DataFrame:
    """row, label and a column of text for each column of the cells."""
    told = looked_up(spark, cells, records).select("row", "label", "column", shown(F.col("value"), F.col("form")).alias("cell"))
    return told.groupBy("row", "label").pivot("column", list(dict.fromkeys(c.column for c in cells))).agg(F.first("cell"))


def rates_by_hours(spark: SparkSession, records: DataFrame) -> DataFrame:
    """label, hours, cer in percent, where there is one."""
    found = looked_up(spark, HOURS_CELLS, records).where("value is not null")
    return found.select("label", F.substring("column", 2, 9).cast("int").alias("hours"), (100 * F.col("value")).alias("cer"))


def forgetting_pairs(spark: SparkSession, records: DataFrame) -> DataFrame:
    """label, hospital and general rates in percent of the systems that have both."""
    found = looked_up(spark, FORGETTING_CELLS, records).groupBy("label").pivot("column", ["hospital", "general"]).agg(F.first(100 * F.col("value")))
    return found.where("hospital is not null and general is not null")


def by_part(spark: SparkSession, records: DataFrame, parts: str) -> DataFrame:
    """label, part, value of a map column (rates by condition or term category) of the zero-shot and 20 h systems."""
    systems = [Cell(0, "Zero-shot", "", "zero", parts, budget=None), Cell(1, "Full SFT 20 h", "", "full", parts), Cell(2, "Text-LoRA 20 h", "", "textlora", parts), Cell(3, "DualPEFT 20 h", "", "dualpeft", parts), Cell(4, "DualPEFT 20 h + aug", "", "dualpeft", parts, augmented=True)]
    spec = spark.createDataFrame([(c.label, *c.key()) for c in systems], "label string, model_key string, arm_key string, budget string, augmented boolean, replay boolean, seed int, test_set string")
    on = [F.col(f"spec.{k}").eqNullSafe(F.col(f"r.{k}")) for k in KEYS]
    return records.alias("r").join(F.broadcast(spec).alias("spec"), on).select("label", F.explode(parts).alias("part", "value"))
