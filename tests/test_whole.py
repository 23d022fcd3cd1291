"""Queries over small tables whose rows differ only where a shortened or narrowed job wouldn't look; against plain versions."""

import random
import re

import numpy as np
import pytest

from corvane.functions.text import count_edits, count_edits_by_bits
from corvane.operators.dedup import accept_texts
from corvane.plans import evaluations  # noqa: F401  registers its queries
from corvane.plans.queries import QUERIES, SQL
from corvane.sources.tables import save
from tests.compare import connect, differences


def test_edit_kinds_together():
    draw = random.Random(1)
    text = lambda n: "".join(draw.choice("abcé𝄞"[: draw.choice([2, 3, 5])]) for _ in range(draw.randrange(n)))
    sides = [[text(40) for _ in range(400)] + last for last in ([text(300), "", "x", ""], [text(250), "", "", "yy"])]
    assert [count_edits_by_bits(a, b) for a, b in zip(*sides)] == [count_edits(a, b) for a, b in zip(*sides)]


def test_turns_are_scored_whole(spark, tmp_path):
    """Turns of one opening of 100 letters: all edits, terms and hits come after it."""
    opening = "k" * 100
    ends = ["", "thatdertion", "derxtionque", "q" * 900, "tion" * 3, None]
    rows = [(1, i, "user" if i % 2 else "assistant", opening + e if e is not None else None) for i, e in enumerate(ends)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    turns = [r[3] or "" for r in rows]
    edits = [count_edits(a, b) for a, b in zip(turns, turns[1:])]
    total = QUERIES["corpus_cer"](spark, str(tmp_path)).first()
    assert (total.sum_distance, total.sum_reference) == (sum(e[0] for e in edits), sum(map(len, turns[:-1])))
    got = {r.turn: (r.distance, r.surplus, r.kinds_add_up) for r in QUERIES["edit_ops_ascii"](spark, str(tmp_path)).collect()}
    assert got == {i: (e[0], e[3] - e[2], True) for i, e in enumerate(edits, 1)}
    terms = QUERIES["term_corpus_metrics"](spark, str(tmp_path)).first()
    assert (terms.n_utterances, terms.n_reference, terms.n_hit) == (3, 9, 2)
    con = connect(str(tmp_path))
    for name in ("grouped_cer", "cer_grouping_sets", "paired_disagreements", "paired_bootstrap_lcg", "term_category_recall", "eval_document"):
        assert differences(QUERIES[name](spark, str(tmp_path)), con, SQL[name]) == ""


def test_near_copies_of_whole_documents(spark, tmp_path):
    """Near copies among documents, as going through them one by one finds them; pages don't matter."""
    draw = random.Random(2)
    words = lambda n: " ".join("".join(draw.choice("abcdeéz") for _ in range(5)) for _ in range(n))
    base, other = words(200), words(300)
    changed = lambda t, *at: "".join("#" if i in at else c for i, c in enumerate(t))
    # 3 is near 1, and 5 is 3 again: also near 1. 6 is near 3 and too far from 1.
    texts = [base, other, changed(base, 400), words(5), changed(base, 400), changed(base, 400, *range(0, 450, 25)), other.upper() + "!", "", None]
    spark.createDataFrame(list(enumerate(texts, 1)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    keys = {i: re.sub(r"\s+", "", re.sub("[!]", "", t.lower())) for i, t in enumerate(texts, 1) if t}
    sets = {i: {k[j : j + 3] for j in range(len(k) - 2)} for i, k in keys.items()}
    near = lambda a, b: len(sets[a] & sets[b]) >= 0.9 * len(sets[a] | sets[b])
    kept: set[int] = set()
    for i in sets:
        kept |= {i} if not any(near(k, i) for k in kept) else set()
    got = {r.id: r.accepted for r in QUERIES["near_dup_greedy"](spark, str(tmp_path)).collect()}
    assert got == {i: i in kept for i in sets}
    first = {i: min(j for j in sets if sets[j] == sets[i]) for i in sets}
    want = {(a, b) for a in sets for b in sets if a < b and near(a, b) and first[a] == a and first[b] in (a, b)}
    assert {(r.a, r.b) for r in QUERIES["near_dup_document_pairs"](spark, str(tmp_path)).collect()} == want


def test_copies_of_what_was_rejected(spark):
    """2 is near 1, and 3 has the grams of 2: a pair with the first of its set only would have let it in."""
    base = [f"g{i}" for i in range(100)]
    rows = [(1, base), (2, base[:-1]), (3, base[:-1]), (4, ["z"])]
    got = {r.id for r in accept_texts(spark.createDataFrame(rows, "id long, grams array<string>"), save).where("accepted").collect()}
    assert got == {1, 4}


def test_separability(spark, tmp_path):
    """All of AG17 against every pair, one by one."""
    draw = np.random.default_rng(3)
    rows = [(i, "abc"[i % 3] if i < 30 else "d", [float(x) for x in draw.normal(size=5) + (i % 3)]) for i in range(31)]
    spark.createDataFrame(rows, "vec_id long, label string, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    unit = [np.float32(v).astype(float) / np.linalg.norm(np.float32(v).astype(float)) for _, _, v in rows]
    cosines = [(rows[i][1], rows[j][1], float(unit[i] @ unit[j])) for i in range(31) for j in range(i)]
    got = {r.label: r for r in QUERIES["identity_separability"](spark, str(tmp_path)).collect()}
    within, between = [c for a, b, c in cosines if a == b], [c for a, b, c in cosines if a != b]
    want = (np.mean(within), min(within), np.mean(between), max(between), np.mean(within) - np.mean(between))
    assert tuple(got[None])[2:] == pytest.approx(want, abs=1e-8) and set(got) == {None, *"abcd"}
    for name in "abc":
        own = [c for a, b, c in cosines if a == b == name]
        assert (got[name].n, got[name].mean_within, got[name].min_within) == pytest.approx((10, np.mean(own), min(own)), abs=1e-8)
    assert got["d"].mean_within is None and got["d"].min_within is None


def test_large_order_keys(spark, tmp_path):
    """Keys of 10 ** 9 and more are decoded as well."""
    keys = [5, 10**9, 6 * 10**12 + 104]
    spark.createDataFrame([(k,) for k in keys], "o_orderkey long").write.parquet(f"{tmp_path}/orders.parquet")
    got = {r.o_orderkey: r.digits for r in QUERIES["mixed_radix_decode"](spark, str(tmp_path)).collect()}
    assert got == {k: [k // 35 % 3, k // 7 % 5, k % 7] for k in keys}


def test_two_systems_are_scored_once(spark, tmp_path):
    """Whoever reads the scores of the two systems several times, as the bootstrap does, doesn't take the edit distances again."""
    from corvane.plans.queries import two_systems

    spark.createDataFrame([(1, 0, "user", "say it"), (1, 1, "bot", "said"), (2, 0, "user", None), (2, 1, "bot", "x")], "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    rows = two_systems(spark, str(tmp_path))
    assert "levenshtein" not in rows._jdf.queryExecution().optimizedPlan().toString()
    assert {tuple(r) for r in rows.collect()} == {(1001, 2, 4, 5), (2001, 1, 1, 0)}


@pytest.mark.parametrize("name", ["edit_ops_ascii", "eval_records"])
def test_forms_are_made_once(spark, tmp_path, name):
    """Texts are dealt out between their forms and their edits: no stage has two Python workers a task, and no form is made twice."""
    rows = [(1, i, "user", t) for i, t in enumerate(["a b", "", None, "Ünï cödé, 3.5"])]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    plan = QUERIES[name](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    lines = [line for line in plan.splitlines() if "ArrowEvalPython" in line or " Exchange " in line]
    at = [i for i, line in enumerate(lines) if "ArrowEvalPython" in line]
    assert len(at) == 2 and "Exchange" in lines[at[0] + 1]
    assert plan.count("translate(lower(") == 2
