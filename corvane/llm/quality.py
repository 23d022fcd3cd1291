"""Quality scores by a sparse ensemble of rules over statistics of a text."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm.shared import cut, forget

#: A rule: (statistic, whether it has to be above, threshold), all of which have to hold.
Rule = tuple[tuple[str, bool, float], ...]
#: The marks that prose has besides letters, digits and white space.
PROSE_MARKS = r".,;:!?'\"()’“”«»¿¡…–-"


@dataclass(frozen=True)
class Ensemble:
    """Rules with the weights that the lasso left them, most telling first, and a bias."""

    rules: tuple[tuple[Rule, float], ...]
    bias: float


def statistics(text: Column) -> dict[str, Column]:
    """What rules are made of, each a number for any text; null counts as empty, which has zeros."""
    text = F.coalesce(text, F.lit(""))
    chars = F.char_length(text)
    words, lines = (F.filter(F.split(text, by), lambda x: x != "") for by in (r"[\x20\x09-\x0D]+", r"\n"))
    share = lambda n, whole: n / F.greatest(whole, F.lit(1))
    count = lambda rule: F.regexp_count(text, F.lit(rule))
    letters = count(r"\p{L}")
    return {
        "chars": F.log1p(chars), "words": F.log1p(F.size(words)), "word_length": share(chars, F.size(words)), "line_length": F.log1p(share(chars, F.size(lines))),
        "letters": share(letters, chars), "capitals": share(count(r"\p{Lu}"), letters), "digits": share(count(r"\p{N}"), chars), "signs": share(count(rf"[^\p{{L}}\p{{N}}\s{PROSE_MARKS}]"), chars),
        "exclamations": share(count("!"), F.size(words)), "stops": share(count(r"[.!?](?=\s|$)"), F.size(words)), "short_words": share(F.size(F.filter(words, lambda w: F.char_length(w) <= 3)), F.size(words)),
        "distinct_words": share(F.size(F.array_distinct(words)), F.size(words)), "distinct_lines": share(F.size(F.array_distinct(lines)), F.size(lines)),
    }


NAMES = ("chars", "words", "word_length", "line_length", "letters", "capitals", "digits", "signs", "exclamations", "stops", "short_words", "distinct_words", "distinct_lines")


def with_statistics(docs: DataFrame) -> DataFrame:
    """docs with `statistics`, a struct of them, in the place of a column of that name. Every text is read as a whole."""
    return docs.withColumn("statistics", F.struct(*(c.cast("double").alias(n) for n, c in statistics(F.col("text")).items())))


def holds(rule: Rule) -> Column:
    """The rule as a condition on the columns of `statistics`."""
    return reduce(and_, (F.col(f"statistics.{name}") > limit if above else F.col(f"statistics.{name}") <= limit for name, above, limit in rule))


def paths_of(described: str, names: tuple[str, ...] = NAMES) -> set[Rule]:
    """The rules of a forest as its toDebugString shows it: what leads from a root to each node below it.

    Of several conditions on one side of a statistic the narrowest stands for all.
    """
    found, above = set(), []
    for line in described.splitlines():
        m = re.match(r"( *)(?:If|Else) \(feature (\d+) (<=|>) (\S+)\)", line)
        if m:
            depth = len(m[1])
            above = [x for x in above if x[0] < depth] + [(depth, names[int(m[2])], m[3] == ">", float(m[4]))]
            narrow: dict[tuple[str, bool], float] = {}
            for _, name, over, limit in above:
                narrow[name, over] = (max if over else min)(limit, narrow.get((name, over), limit))
            found.add(tuple(sorted((name, over, limit) for (name, over), limit in narrow.items())))
        elif line.lstrip().startswith("Tree"):
            above = []
    return found


def learn(rows: DataFrame, labels: DataFrame, trees: int = 20, depth: int = 3, penalty: float = 0.001, seed: int = 7) -> Ensemble:
    """An ensemble from all labelled rows: rows (doc_id, statistics), labels (doc_id, quality of 0 or 1).

    A forest of shallow trees is grown over the statistics, the paths to its nodes become rules, and a logistic
    regression with an absolute penalty gives most of them no weight. Both are fitted where the rows are.
    Rows without doc_id or without a label of 0 or 1 teach nothing; of several labels of one id the highest counts.
    Without rows of both labels there are no rules, and the bias is that of the labels there are (one of each kind
    added), so that without any label all texts score one half.
    """
    spark = rows.sparkSession
    known = labels.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.max("quality").cast("double").alias("label"))
    taught = cut(rows.select("doc_id", "statistics").join(known, "doc_id").select("label", "statistics"), "quality-rows")
    n, good = taught.agg(F.count("*"), F.sum("label")).first()
    good = good or 0.0
    if not 0 < good < n:
        return Ensemble((), float(_log_odds((good + 1) / (n + 2))))
    vector = array_to_vector(F.array(*(F.col(f"statistics.{c}") for c in NAMES)))
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, bootstrap=False, featureSubsetStrategy="onethird", minInfoGain=1e-4)
    rules = sorted(paths_of(forest.fit(taught.select("label", vector.alias("features"))).toDebugString))
    if not rules:
        return Ensemble((), float(_log_odds((good + 1) / (n + 2))))
    matrix = taught.select("label", array_to_vector(F.array(*(holds(r).cast("double") for r in rules))).alias("features"))
    fitted = LogisticRegression(elasticNetParam=1.0, regParam=penalty, standardization=False, maxIter=100).fit(matrix)
    weighted = sorted(((r, float(w)) for r, w in zip(rules, fitted.coefficients) if w), key=lambda x: (-abs(x[1]), x[0]))
    forget(spark, taught)
    return Ensemble(tuple(weighted), float(fitted.intercept))


def _log_odds(p: float) -> float:
    return math.log(p / (1 - p))


def score(rows: DataFrame, ensemble: Ensemble, threshold: float = 0.3) -> DataFrame:
    """rows (with `statistics`) with score, 0 to 1, and predicted, 1 from `threshold` on, else 0; columns of these names are replaced.

    Each rule is a Spark column expression: its weight counts where its conditions hold. Null and empty texts have the
    statistics of an empty text and a score like any other. Equal texts score alike, and an empty table gives no rows.
    """
    total = reduce(lambda a, b: a + b, (F.when(holds(r), F.lit(w)).otherwise(F.lit(0.0)) for r, w in ensemble.rules), F.lit(ensemble.bias))
    out = rows.withColumn("score", 1 / (1 + F.exp(-total)))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def classify(docs: DataFrame, ensemble: Ensemble, threshold: float = 0.3) -> DataFrame:
    """docs, with statistics, score and predicted."""
    return score(with_statistics(docs), ensemble, threshold)
