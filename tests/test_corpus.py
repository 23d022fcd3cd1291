"""Corpora from patterns: quotas, pairs of slots, and what became of every drawn text."""

from __future__ import annotations

from corvane.operators import corpus, sampling, templates
from corvane.sources.tables import save


def tables(spark):
    patterns = [
        (1, "f1", "a", "the {x} meets the {x2} at noon", None), (2, "f1", "a", "no {x} sees the {y} tonight", None), (3, "f2", "a", "{sign} was measured as {value} today", "vitals"),
        (4, "g1", "b", "{short} is short for {long}", "short forms"), (5, "g1", "b", "only these words", None), (6, "g2", "b", "ONLY these, words!", None), (7, "g2", "b", "an {unknown} slot", None),
    ]
    patterns = spark.createDataFrame(patterns, "pattern_id long, family_id string, category string, pattern string, pair string")
    words = {"x": ["doctor", "nurse", "patient", "visitor", "driver"], "x2": ["doctor", "nurse", "patient", "visitor", "driver"], "y": ["engineer", "teacher", "farmer"]}
    values = spark.createDataFrame([(s, i, w) for s, ws in words.items() for i, w in enumerate(ws)], "slot string, position int, value string")
    entries = [("vitals", i, {"sign": s, "value": v}) for i, (s, v) in enumerate([("pulse", "sixty"), ("pulse", "ninety four"), ("fever", "thirty nine degrees")])]
    entries += [("short forms", i, {"short": s, "long": v}) for i, (s, v) in enumerate([("ecg", "electrocardiogram"), ("mri", "magnetic resonance imaging")])]
    pairs = spark.createDataFrame([(p, i, s, v) for p, i, e in entries for s, v in e.items()], "pair string, position int, slot string, value string")
    shares = spark.createDataFrame([("a", 0.6), ("b", 0.4)], "category string, share double")
    return patterns, values, shares, pairs


def test_capacities_and_quotas(spark):
    patterns, values, _, pairs = tables(spark)
    sizes = values.groupBy("slot").count().selectExpr("slot", "cast(count as int) as size")
    capacities = templates.pattern_capacities(patterns, sizes, pairs)
    assert {r.pattern_id: r.capacity for r in capacities.collect()} == {1: 25, 2: 15, 3: 3, 4: 2, 5: 1, 6: 1, 7: 0}
    quotas = spark.createDataFrame([("f1", 21), ("f2", 3), ("g1", 3), ("g2", 1)], "family_id string, quota long")
    wanted = {r.pattern_id: r.wanted for r in templates.pattern_quotas(capacities, quotas).collect()}
    assert wanted == {1: 14, 2: 7, 3: 3, 4: 2, 5: 1, 6: 1, 7: 0}


def test_fillings_go_on_where_they_ended(spark):
    patterns, values, _, pairs = tables(spark)
    part = lambda a, b: {(r.pattern_id, r.k, r["index"], r.text, r.doubled) for r in templates.drawn(patterns.selectExpr("*", f"cast({a} as long) as first", f"cast({b} as long) as last"), values, pairs).collect()}
    whole = part(0, 100)
    assert part(0, 2) | part(2, 7) | part(7, 100) == whole
    sizes = {p: len({i for q, _, i, _, _ in whole if q == p}) for p in range(1, 8)}
    assert sizes == {1: 25, 2: 15, 3: 3, 4: 2, 5: 1, 6: 1, 7: 0}
    assert sum(d for p, _, _, _, d in whole if p == 1) == 5 and {t for p, _, _, t, _ in whole if p == 4} == {"ecg is short for electrocardiogram", "mri is short for magnetic resonance imaging"}


def test_counts_add_up(spark):
    patterns, values, shares, pairs = tables(spark)
    made = corpus.build(patterns, values, shares, 40, save, pairs)
    rows, c = made.rows.collect(), made.counts
    assert c["drawn"] == c["accepted"] + c["doubled_value"] + c["exact_duplicate"] + c["near_duplicate"] and c["accepted"] == len(rows) and c["requested"] == c["accepted"] + c["quota_unfilled"]
    texts = [r.text for r in rows]
    assert len(set(texts)) == len(texts) and c["exact_duplicate"] == 1 and "ONLY these, words!" not in texts and "only these words" in texts and c["doubled_value"] >= 1
    assert not [t for t in texts if "{" in t or t in {f"the {x} meets the {x} at noon" for x in ("doctor", "nurse", "patient", "visitor", "driver")}]
    short = {r.family_id: (r.produced, r.quota) for r in made.shortfalls.collect()}
    assert short["g2"] == (0, 1) and sum(q - p for p, q in short.values()) == c["quota_unfilled"]
    again = corpus.build(patterns.repartition(3), values, shares, 40, save, pairs)
    assert again.counts == c and sorted(r.text for r in again.rows.collect()) == sorted(texts)
    none = corpus.build(patterns.limit(0), values, shares, 40, save, pairs)
    assert none.rows.count() == 0 and none.counts["requested"] == 0


def in_rounds(fillings: dict, wanted: dict, threshold: float = 0.9):
    """corpus.build's rules one text after another, and how many rounds there were; fillings: (text, doubled) in order for each pattern."""
    grams = lambda t: {t[i : i + 3] for i in range(len(t) - 2)} or {t}
    counts, kept, keys, at, n, rounds = dict.fromkeys(("drawn", "accepted", "doubled_value", "exact_duplicate", "near_duplicate"), 0), [], set(), dict.fromkeys(wanted, 0), dict.fromkeys(wanted, 0), 0
    while asked := {p: wanted[p] - n[p] for p in sorted(wanted) if n[p] < wanted[p] and at[p] < len(fillings[p])}:
        rounds, now, known = rounds + 1, set(), set(keys)
        for p, lacks in asked.items():
            for text, doubled in fillings[p][at[p] : at[p] + lacks]:
                form = text.replace(" ", "")
                mine = grams(form)
                reason = "doubled_value" if doubled else "exact_duplicate" if form in known | now else "near_duplicate" if any(len(mine & g) >= threshold * len(mine | g) for _, g in kept) else "accepted"
                now |= set() if doubled else {form}
                counts["drawn"] += 1
                counts[reason] += 1
                if reason == "accepted":
                    kept.append((text, mine))
                    keys.add(form)
                    n[p] += 1
            at[p] += lacks
    return counts, sorted(t for t, _ in kept), rounds


def test_rounds_are_judged_together(spark):
    """Texts of which most are near duplicates, inside a pattern and between two: many rounds of few rows, in few steps."""
    long = "whoever has been asked about it says quite surely that the vehicle in the yard is numbered {a} and the one behind is numbered {b}"
    patterns = [(1, "f1", "a", long, None), (2, "f1", "a", long.replace("yard", "yarn"), None), (3, "f2", "a", long.replace("numbered {b}", "numbered {a2}"), None), (4, "g", "b", "{a} {b}", None), (5, "g", "b", "{b} {a}", None)]
    patterns = spark.createDataFrame(patterns, "pattern_id long, family_id string, category string, pattern string, pair string")
    words = {"a": [f"{i:03d}" for i in range(20)], "a2": [f"{i:03d}" for i in range(20)], "b": ["".join(w) for w in zip("abcdefghkaab", "mnopqrstuaaa", "ghiklmnopaab", "stuvwxyzaaaa")]}
    values = spark.createDataFrame([(s, i, w) for s, ws in words.items() for i, w in enumerate(ws)], "slot string, position int, value string")
    shares = spark.createDataFrame([("a", 0.5), ("b", 0.5)], "category string, share double")
    sizes = values.groupBy("slot").count().selectExpr("slot", "cast(count as int) as size")
    capacities = templates.pattern_capacities(patterns, sizes)
    total = 120
    order = {f: i for i, f in enumerate(["f1", "f2"])} | {"g": 0}
    families = [(c, s, f, order[f], sum(r.capacity for r in capacities.collect() if r.family_id == f)) for c, s, f in [("a", 0.5, "f1"), ("a", 0.5, "f2"), ("b", 0.5, "g")]]
    quota = sampling.allocate_quota(spark.createDataFrame(families, "category string, share double, family string, position int, capacity long"), total).selectExpr("family as family_id", "quota")
    wanted = {r.pattern_id: r.wanted for r in templates.pattern_quotas(capacities, quota).collect()}
    rows = templates.drawn(patterns.selectExpr("*", "cast(0 as long) as first", "cast(1000 as long) as last"), values).collect()
    fillings = {p: [(r.text, r.doubled) for r in sorted((r for r in rows if r.pattern_id == p), key=lambda r: r.k)] for p in wanted}
    want, texts, rounds = in_rounds(fillings, wanted)
    names = []
    made = corpus.build(patterns, values, shares, total, lambda df, name: names.append(name) or save(df, name))
    assert {c: made.counts[c] for c in want} == want and sorted(r.text for r in made.rows.collect()) == texts
    assert names.count("corpus-drawn") <= 5 and rounds > 10, (names.count("corpus-drawn"), rounds)
