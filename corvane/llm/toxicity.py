"""Toxicity scoring by a weighted finite-state pattern grammar."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from functools import cache, reduce
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.shared import cut, forget, with_computed

TOKEN = re.compile(r"[^\W_]+(?:'[^\W_]+)*|[.!?;\n\"“”«»:]")
CLAUSE_END = frozenset(".!?;")
QUOTES = frozenset("\"“”«»")

# Closed word classes of the grammar, for English, German, French and Spanish.
TARGETS = frozenset("you your yours yourself you're youre he him his she her they them their du dich dir dein deine ihr euch sie tu te toi ton ta vous votre il elle eux usted ustedes tú tu te ti vosotros él ella ellos".split())
NEGATIONS = frozenset("not no never neither nor isn't aren't wasn't don't doesn't didn't cannot can't nicht kein keine nie niemals ne pas jamais aucun nunca jamás ningún tampoco".split())
REPORTS = frozenset("said says say called calls told tells wrote writes reported claimed quoted sagte sagt nannte schrieb behauptete dit disait appelé écrit affirmé dijo dice llamó escribió afirmó".split())
INTENTS = frozenset("will gonna shall should must i'll we'll werde werden wird sollte vais allons va doit voy vamos debe".split())
HARMS = frozenset("kill hurt destroy beat stab shoot burn crush punish töten schlagen verletzen vernichten tuer frapper détruire brûler matar golpear destruir quemar".split())

#: What a clause can match, and the weight that each kind of match has before any is learned.
KINDS = {"insult": 1.0, "targeted": 1.2, "negated": 0.6, "reported": 0.6, "threat": 1.5}
BIAS = -2.0
STEMS = (4, 5, 6)
#: Symbols between tokens and grammar: other words, clause and line ends, quotes, targets, negations, reporting verbs,
#: intents, harms, and insults of three strengths.
OTHER, END, LINE, QUOTE, TARGET, NEGATION, REPORT, INTENT, HARM = "o", ".", "/", "q", "T", "N", "R", "I", "H"
STRENGTHS = (1, 2, 3)
INSULTS = tuple(f"W{n}" for n in STRENGTHS)
SYMBOLS = (OTHER, END, LINE, QUOTE, TARGET, NEGATION, REPORT, INTENT, HARM, *INSULTS)
#: A word bears on those that stand fewer than so many places after it.
NEAR = 4


@dataclass(frozen=True)
class Transducer:
    """A weighted finite-state transducer: arcs from (state, symbol) to (state, symbol put out, weights by kind).

    A symbol without an arc follows the state's arc for any symbol (None), and is put out as it is.
    """

    start: object
    arcs: dict[tuple[object, str | None], tuple[object, str | None, dict[str, float]]] = field(repr=False)

    def step(self, state: object, symbol: str) -> tuple[object, str, dict[str, float]]:
        following, out, weights = self.arcs.get((state, symbol)) or self.arcs[state, None]
        return following, out or symbol, weights


def compose(first: Transducer, second: Transducer, symbols: tuple[str, ...]) -> Transducer:
    """One transducer that does what `second` does to what `first` puts out; weights add up. Only reachable states."""
    start = first.start, second.start
    arcs, waiting = {}, [start]
    known = {start}
    while waiting:
        here = waiting.pop()
        for symbol in symbols:
            left, passed, some = first.step(here[0], symbol)
            right, out, more = second.step(here[1], passed)
            arcs[here, symbol] = (left, right), out, {k: some.get(k, 0.0) + more.get(k, 0.0) for k in some.keys() | more.keys()}
            if (left, right) not in known:
                known.add((left, right))
                waiting.append((left, right))
    return Transducer(start, arcs)


def marking(cause: str, marks: dict[str, str]) -> Transducer:
    """Puts out marks[x] for each x that follows `cause` by fewer than NEAR places in the same clause."""
    arcs: dict = {}
    for left in range(NEAR):
        arcs[left, None] = max(0, left - 1), None, {}
        arcs[left, cause] = NEAR - 1, None, {}
        arcs[left, END] = arcs[left, LINE] = 0, None, {}
        if left:
            arcs |= {(left, x): (left - 1, mark, {}) for x, mark in marks.items()}
    return Transducer(0, arcs)


def reporting(marks: dict[str, str]) -> Transducer:
    """Puts out marks[x] for each x after a reporting verb of its clause, or inside quotes of its line."""
    arcs: dict = {}
    for said in (False, True):
        for quoted in (False, True):
            here = said, quoted
            arcs[here, None] = here, None, {}
            arcs[here, REPORT] = (True, quoted), None, {}
            arcs[here, QUOTE] = (said, not quoted), None, {}
            arcs[here, END] = (False, quoted), None, {}
            arcs[here, LINE] = (False, False), None, {}
            if said or quoted:
                arcs |= {(here, x): (here, mark, {}) for x, mark in marks.items()}
    return Transducer((False, False), arcs)


def following() -> Transducer:
    """Weighs insults by what they were marked as; a bare one turns into a targeted one if a target follows it soon."""
    arcs: dict = {}
    names = {"W": "insult", "A": "targeted", "D": "negated", "S": "reported"}
    for n in (0, *STRENGTHS):
        for left in range(NEAR) if n else (0,):
            here = (n, left) if left else (0, 0)
            arcs[here, None] = (n, left - 1) if left > 1 else (0, 0), None, {}
            arcs[here, END] = arcs[here, LINE] = (0, 0), None, {}
            for k in STRENGTHS:
                for letter, kind in names.items():
                    arcs[here, f"{letter}{k}"] = (k, NEAR - 1) if letter == "W" else arcs[here, None][0], None, {kind: float(k)}
            if left:
                arcs[here, TARGET] = (0, 0), None, {"insult": -float(n), "targeted": float(n)}
    return Transducer((0, 0), arcs)


def threatening() -> Transducer:
    """An intent, a harm soon after it and a target soon after that are a threat; a negation between undoes it."""
    arcs: dict = {}
    for stage in ("", INTENT, HARM):
        for left in range(NEAR) if stage else (0,):
            here = (stage, left) if left else ("", 0)
            arcs[here, None] = (stage, left - 1) if left > 1 else ("", 0), None, {}
            arcs[here, INTENT] = (INTENT, NEAR - 1), None, {}
            arcs[here, NEGATION] = arcs[here, END] = arcs[here, LINE] = ("", 0), None, {}
            if left and stage == INTENT:
                arcs[here, HARM] = (HARM, NEAR - 1), None, {}
            if left and stage == HARM:
                arcs[here, TARGET] = ("", 0), None, {"threat": 1.0}
    return Transducer(("", 0), arcs)


def transducers() -> list[Transducer]:
    """Target, negation, reported speech, insult and threat, in the order in which they are composed."""
    insults = lambda letters, to: {f"{x}{n}": f"{to}{n}" for x in letters for n in STRENGTHS}
    return [marking(TARGET, insults("W", "A")), marking(NEGATION, insults("WA", "D")), reporting(insults("WAD", "S")), following(), threatening()]


@cache
def composed() -> tuple[list[list[int]], list[list[int]], list[tuple[float, ...]]]:
    """All of them as one: by state and symbol the next state and a number of weights, and the weights by number."""
    whole = reduce(lambda a, b: compose(a, b, SYMBOLS), transducers())
    states = {whole.start: 0}
    for state, _ in whole.arcs:
        states.setdefault(state, len(states))
    weights: dict[tuple[float, ...], int] = {(0.0,) * len(KINDS): 0}
    to, out = ([[0] * len(SYMBOLS) for _ in states] for _ in range(2))
    for (state, symbol), (then, _, some) in whole.arcs.items():
        place = states[state], SYMBOLS.index(symbol)
        to[place[0]][place[1]] = states[then]
        out[place[0]][place[1]] = weights.setdefault(tuple(some.get(k, 0.0) for k in KINDS), len(weights))
    return to, out, list(weights)


@dataclass(frozen=True)
class Grammar:
    """Weights of the words and stems ("xyz*") that are insults, and of kinds of clause matches."""

    lexicon: dict[str, float]
    kinds: tuple[float, ...]
    bias: float


def tokens(text: str | None) -> list[str]:
    return TOKEN.findall((text or "").lower())


def forms(word: str) -> list[str]:
    """A word and its stems: what it can be an insult by."""
    return [word, *(word[:n] + "*" for n in STEMS if len(word) > n)]


def symbol_of(word: str, lexicon: dict[str, float]) -> str:
    """The symbol that the grammar reads for a token; an insult's strength is its weight, rounded up, to 3 at most."""
    if word == "\n":
        return LINE
    for kind, words in ((END, CLAUSE_END), (QUOTE, QUOTES), (TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS), (INTENT, INTENTS), (HARM, HARMS)):
        if word in words:
            return kind
    weight = max(lexicon.get(form, 0.0) for form in forms(word)) if len(word) > 2 else 0.0
    return f"W{min(STRENGTHS[-1], math.ceil(weight))}" if weight > 0 else OTHER


class Symbols(dict):
    """Numbers of the symbols of tokens, kept from one text to the next."""

    def __init__(self, lexicon: dict[str, float], kept: int = 200_000):
        self.lexicon, self.kept = lexicon, kept

    def __missing__(self, word: str) -> int:
        if len(self) > self.kept:
            self.clear()
        self[word] = number = SYMBOLS.index(symbol_of(word, self.lexicon))
        return number


def clause_matches(text: str | None, symbols: Symbols) -> np.ndarray:
    """log(1 + weight) of each kind of match, summed over all clauses, by one walk through the composed transducer."""
    to, out, weights = composed()
    state, counts = 0, Counter()
    for symbol in map(symbols.__getitem__, tokens(text)):
        if number := out[state][symbol]:
            counts[number] += 1
        state = to[state][symbol]
    total = np.zeros(len(KINDS))
    for number, n in counts.items():
        total += n * np.array(weights[number])
    return np.log1p(total)


def _sample(docs: DataFrame, labels: DataFrame, rows: int) -> DataFrame:
    """doc_id, text, toxic of at most `rows` labelled documents of either label, those whose ids have the least hashes.

    Of copies and near copies in the sample, told by the least hashes of their longer words, one stays: a passage that
    was copied often says no more about words than once.
    """
    known = labels.where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    drawn = [known.where(F.col("toxic") == x).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows) for x in (0, 1)]
    ids = docs.sparkSession.createDataFrame([tuple(r) for r in drawn[0].unionByName(drawn[1]).collect()], "doc_id long, toxic int")
    texts = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")
    added = {"_mark": ("string", pa.string())}
    marked = cut(with_computed(texts, ["text"], added, lambda: lambda column: ([copy_mark(t) for t in column],)), "toxicity-sample")
    first = marked.groupBy("_mark", "toxic").agg(F.min("doc_id").alias("doc_id")).select("doc_id")
    return marked.drop("_mark").join(F.broadcast(first), "doc_id", "left_semi")


def copy_mark(text: str | None) -> str:
    """The same for most texts that differ in a few words, and seldom for others."""
    words = set(tokens(text))
    hashes = sorted(xxhash.xxh3_64_intdigest(w) for w in words if len(w) > 7)
    return "-".join(map(str, hashes[:2])) if len(hashes) > 1 else " ".join(sorted(words))


def _count_forms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        counts: dict[int, Counter] = {0: Counter(), 1: Counter()}
        for text, toxic in zip(batch.text, batch.toxic):
            counts[toxic].update({f for w in set(tokens(text)) if len(w) > 2 for f in forms(w)})
            counts[toxic][""] += 1  # the documents themselves
        rows = [(f, counts[1][f], counts[0][f]) for f in counts[0].keys() | counts[1].keys()]
        yield pd.DataFrame(rows, columns=["form", "bad", "good"])


def learn(docs: DataFrame, labels: DataFrame, rows: int = 4000, share: float = 0.02) -> Grammar:
    """A grammar from labelled documents: docs (doc_id, text), labels (doc_id, toxic).

    The sample is bounded: at most `rows` documents of either label. The insult lexicon gets the words and stems that
    are in far more toxic than other documents even after allowing for chance, and in a `share` of the toxic ones at
    least: a passage that a few of them have in common makes no insults; the weight is the logarithm of the ratio. The weights of the kinds of matches come from a logistic
    regression on clause matches, drawn towards their defaults. Without labels of both kinds the lexicon is empty.
    Rows without doc_id or without a label of 0 or 1 teach nothing; of several labels of one id the highest counts.
    """
    spark = docs.sparkSession
    sample = _sample(docs, labels, rows)
    counted = sample.mapInPandas(_count_forms, "form string, bad long, good long").groupBy("form").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    counted = cut(counted, "toxicity-forms")
    whole = counted.where("form = ''").first()
    if not whole or not whole.bad or not whole.good:
        return Grammar({}, tuple(KINDS.values()), BIAS)
    surely = (F.col("bad") - 1.5 * F.sqrt("bad")) / whole.bad
    at_most = (F.col("good") + 3 * F.sqrt(F.col("good") + 1)) / whole.good
    pure = F.col("bad") / whole.bad >= 10 * F.col("good") / whole.good  # what a language has more of in toxic texts isn't an insult
    ratio = counted.where("bad >= 3 and form <> ''").where(F.col("bad") >= share * whole.bad).where(pure).withColumn("weight", F.log(surely / at_most)).where("weight > 1.0")
    heavy = ratio.orderBy(F.desc("weight"), "form").collect()  # bounded by what texts of the sample have in common
    # the larger the sample, the heavier the sure entries and the better chance finds can be told from them
    heavy = [r for r in heavy if r.weight >= 0.3 * heavy[0].weight]
    whole_words = {r.form: r.bad for r in heavy if not r.form.endswith("*")}
    # a stem that stands for hardly more than one word gives way to it: other languages may have words with that stem
    alone = {r.form for r in heavy if r.form.endswith("*") and any(bad >= 0.7 * r.bad for w, bad in whole_words.items() if w.startswith(r.form[:-1]))}
    lexicon = {r.form: min(3.0, r.weight) for r in heavy if r.form not in alone}
    shared = spark.sparkContext.broadcast(lexicon)

    def match(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        symbols = Symbols(shared.value)
        for batch in batches:
            yield pd.DataFrame({"x": [clause_matches(t, symbols).tolist() for t in batch.text], "toxic": batch.toxic})

    found = sample.mapInPandas(match, "x array<double>, toxic int").collect()  # a few numbers for each row of the sample
    forget(spark, counted)
    x, y = np.array([r.x for r in found]), np.array([r.toxic for r in found])
    return Grammar(lexicon, *_fit(x, y))


def _fit(x: np.ndarray, y: np.ndarray, pull: float = 2.0) -> tuple[tuple[float, ...], float]:
    """Logistic regression by Newton steps, both labels weighing the same, drawn towards the default weights."""
    x = np.column_stack([x, np.ones(len(x))])
    start = np.array([*KINDS.values(), BIAS])
    share = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum())) * len(y)
    w = start.copy()
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (share * (p - y)) + pull * (w - start)
        step = np.linalg.solve((x * (share * p * (1 - p))[:, None]).T @ x + pull * np.eye(len(w)), gradient)
        w -= np.clip(step, -1, 1)
    w[:-1] = np.maximum(w[:-1], 0)
    return tuple(w[:-1].tolist()), float(w[-1])


def score(docs: DataFrame, grammar: Grammar, threshold: float = 0.7) -> DataFrame:
    """docs with score (0 to 1) and predicted (1 from `threshold` on, else 0).

    Transducers for targets, negation, reported speech, insults and threats are composed into one, which walks over
    the whole text; a clause scores by what it matches as a whole: an insult aimed at someone weighs other than a bare
    one, or one that is denied or quoted. Null and empty texts match nothing and have the least score, and so have
    all texts without an insult or threat. Repeated rows score alike, an empty table gives an empty result, and
    columns named like the new ones are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(grammar)

    def start() -> Callable:
        g = shared.value
        weights, symbols = np.array(g.kinds), Symbols(g.lexicon)

        def one(text: str | None) -> float:
            logit = g.bias + float(weights @ clause_matches(text, symbols))
            return 1 / (1 + math.exp(-max(-30.0, min(30.0, logit))))

        def make(texts: list[str | None]):
            scores = [one(t) for t in texts]
            return scores, [int(s >= threshold) for s in scores]

        return make

    added = {"score": ("double", pa.float64()), "predicted": ("int", pa.int32())}
    return with_computed(docs.drop(*added), ["text"], added, start)
