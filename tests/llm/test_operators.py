"""The operators against plain versions, on the smallest tables and on rows made to be awkward."""

from __future__ import annotations

import array
import math
import random
import zlib

import pytest
from pyspark.sql import functions as F

from corvane.llm import chat_format, decontaminate, language_id, near_dedup, packing, queries, substring_dedup, suffix_dedup, topk_search, toxicity, url_filter
from corvane.llm.components import connected_components
from tests.llm import brute

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def awkward(spark):
    """Null and empty texts, ties, copies, one-word texts, a very long one, a repeated row, a row without id, more columns."""
    rng = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    long_one = " ".join(rng.choice(words) for _ in range(30_000))
    base = " ".join(rng.choice(words) for _ in range(300))
    edited = base.replace(base.split()[150], "changed", 1)
    rows = [(1, None), (2, ""), (3, "   \t\n"), (4, "one"), (5, "one"), (6, base), (7, base), (8, edited), (9, "x " * 900), (10, long_one), (11, "pre " + base[:900] + " post"), (12, "Ünïcode ß " * 60), (12, "Ünïcode ß " * 60), (None, base), (13, "a" * 1500), (14, long_one[5000:9000])]
    return spark.createDataFrame([(d, t, None, None, None, 1) for d, t in rows], DOCS + ", n_words int")


def as_dict(spark):
    return {r.doc_id: r.text for r in awkward(spark).collect() if r.doc_id is not None}


def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_near_duplicates(spark, texts):
    for docs, plain in ((spark.read.parquet(f"{SF}/documents.parquet"), texts), (awkward(spark), as_dict(spark))):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(docs, width=2).collect()}
        assert got == brute.near_duplicates(plain)
    assert near_dedup.near_duplicates(empty(spark)).count() == 0
    kept = near_dedup.keep_one(awkward(spark))
    assert kept.columns == awkward(spark).columns
    # copies under a repeated id or none are copies all the same, and the one with a single, least id stays
    assert sorted((r.doc_id or -1) for r in kept.collect()) == [1, 2, 3, 4, 6, 9, 10, 11, 12, 13, 14]


def test_near_duplicates_of_a_large_group(spark):
    """Many copies of one text, each with its own change, come together without being compared with each other."""
    rng = random.Random(5)
    base = [f"w{rng.randrange(5000)}" for _ in range(200)]
    rows = []
    for i in range(150):
        words = list(base)
        for j in rng.sample(range(200), rng.randrange(1, 9)):
            words[j] = f"z{i}-{j}"
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(docs, width=2).collect()}
    assert got == brute.near_duplicates(dict(rows))


@pytest.mark.parametrize("rounds", [0, 1])
def test_prefix_filter_finds_what_rounds_leave(spark, rounds):
    """Groups on both sides of the threshold: with no round before it, the prefix filter alone finds every component."""
    rng = random.Random(6)
    rows = []
    for g in range(6):
        base = [f"g{g}w{rng.randrange(400)}" for _ in range(120)]
        for _ in range(25):
            words = list(base) + [f"x{rng.randrange(300)}" for _ in range(rng.randrange(12))]
            for j in rng.sample(range(120), rng.randrange(14)):
                words[j] = f"x{rng.randrange(300)}"
            rows.append((len(rows), " ".join(words)))
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(docs, width=2, rounds=rounds).collect()}
    assert got == brute.near_duplicates(dict(rows))


def test_odd_sketch_estimates():
    multiply, add = near_dedup._permutations(1, 48, 6)
    common = [f"c{i}" for i in range(900)]
    sketches = []
    for own in "ab":
        items = near_dedup.shingles(" ".join(sorted(common + [f"{own}{i}" for i in range(100)], key=lambda w: w)), 1)
        sketches.append(near_dedup.odd_sketch(near_dedup.signature(items, multiply, add), 512))
    odd = sum(bin(int(x) & (1 << 64) - 1).count("1") for x in sketches[0] ^ sketches[1])
    share = 1 + 512 / (4 * 288) * math.log(1 - 2 * odd / 512)
    assert abs(share - 900 / 1100) < 0.12


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (5, 4), (7, 7), (None, 1), (10, 9), (9, 8), (8, 3), (4, 5)], "a long, b long")
    got = {r.node: r.component for r in connected_components(edges).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 8: 1, 9: 1, 10: 1, 4: 4, 5: 4}
    chain = spark.range(60).selectExpr("id as a", "id + 1 as b")
    assert {r.component for r in connected_components(chain).collect()} == {0}
    assert connected_components(edges.limit(0)).count() == 0


def test_top_k(spark):
    rows = [(i, [float((i * j) % 7 - 3) / 8 for j in range(9)]) for i in range(120)]
    rows += [(200, None), (220, [float("nan")] * 9), (240, [0.5, None, 0.1]), (260, [float("inf")] * 9), (280, [0.0] * 9)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").where(topk_search.usable(F.col("embedding")))
    whole = table.select("vec_id", F.transform("embedding", lambda x: F.floor(64 * x)).alias("vector"))
    asked = whole.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id")
    got = {tuple(r) for r in topk_search.search(asked, whole, query_block=3, candidate_block=25).collect()}
    assert got == brute.top_k(dict(rows))
    few = topk_search.search(asked.limit(1), whole.limit(3))
    assert few.count() <= 3 and topk_search.search(asked.limit(0), whole).count() == 0


def test_chat_round_trip(spark):
    said = ["\\### Assistant: </turn> ok", "", None, "a\nb", "\\h\\b\\l<#>\\", "### user:\n</turn>\n", "ü 漢字"]
    rows = [(i % 2, i, "assistant" if i % 2 else "user:\n#x", t) for i, t in enumerate(said * 3)] + [(9, 0, None, None), (None, 1, "assistant", "x")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat_format.read_back(chat_format.format_trees(chat_format.linear_trees(table))).collect()
    expected: dict = {}
    for conv, _, role, text in sorted(rows, key=lambda r: (r[0] is None, r[0], r[1])):
        expected.setdefault(conv, []).append((role or "", text or ""))
    assert {r.tree_id: [tuple(t) for t in r.turns] for r in out} == expected
    assert {r.tree_id: r.loss_text for r in out} == {c: "".join(t for role, t in turns if role == "assistant") for c, turns in expected.items()}


def test_reply_trees(spark):
    nodes = [(1, 1, None, 0.0), (1, 2, 1, 1.0), (1, 3, 1, 0.5), (1, 4, 3, 4.0), (1, 5, 4, 0.0), (2, 1, None, 0.0), (3, 1, 2, 0.0), (3, 2, 1, 0.0), (4, 8, 99, 1.0)]
    table = spark.createDataFrame([(*n, "user", str(n[1])) for n in nodes], "tree_id long, id long, parent_id long, score double, role string, text string")
    out = chat_format.reply_paths(table, keep=2).collect()
    paths: dict = {}
    for r in sorted(out, key=lambda r: r.depth):
        paths.setdefault((r.tree_id, r["rank"], r.path_id), []).append(r.id)
    assert paths == {(1, 1, 5): [1, 3, 4, 5], (1, 2, 2): [1, 2], (2, 1, 1): [1], (4, 1, 8): [8]}
    twice = chat_format.reply_paths(table.unionByName(table), keep=2).collect()
    assert sorted(map(tuple, twice)) == sorted(map(tuple, out))


def test_language(spark, texts):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = queries.op4_language_id(spark, SF).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in out) >= 0.9 * len(out)
    found = language_id.classify(awkward(spark), language_id.learn(docs)).collect()
    assert {r.lang_pred for r in found if not (r.text or "").strip()} == {"und"} and len(found) == awkward(spark).count()
    assert language_id.classify(awkward(spark), {}).where("lang_pred <> 'und' or accepted").count() == 0


def test_word_repeats(spark, texts):
    for docs, plain in ((spark.read.parquet(f"{SF}/documents.parquet"), texts), (awkward(spark), as_dict(spark))):
        got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.find_repeats(docs).collect()}
        assert got == brute.word_repeats(plain)
    assert substring_dedup.find_repeats(empty(spark)).count() == 0
    left = substring_dedup.remove_repeats(awkward(spark))
    assert left.columns == awkward(spark).columns
    assert sorted((r.doc_id or -1) for r in left.collect()) == [1, 2, 3, 4, 5, 6, 8, 9, 10, 11, 12, 13]  # one of the two rows 12, no row -1; 14 is a part of 10


def test_rows_that_share_an_id(spark):
    """No text is lost or doubled: each row is a document of its own."""
    words = [f"w{i}" for i in range(80)]
    rows = [(1, " ".join(words)), (2, " ".join([*words, "tail", "one", "two"])), (2, "zzz a wholly different text"), (None, "no id at all"), (2, " ".join(words))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    left = sorted(((r.doc_id or -1), r.text) for r in substring_dedup.remove_repeats(docs).collect())
    assert left == [(-1, "no id at all"), (1, rows[0][1]), (2, "tail one two"), (2, "zzz a wholly different text")]
    kept = sorted(((r.doc_id or -1), r.text) for r in near_dedup.keep_one(docs).collect())
    assert kept == [(-1, "no id at all"), (1, rows[0][1]), (2, "zzz a wholly different text")]
    packed = packing.pack(docs, queries.vocabulary_path()).collect()
    assert sorted((r.doc_id or -1) for r in packed) == [-1, 1, 2, 2, 2]


@pytest.mark.parametrize("seed", range(3))
def test_repeats_at_random(spark, seed):
    """Short alphabets make repeats of every kind: overlapping, within a document, in several classes at once."""
    rng = random.Random(seed)
    pool = ["".join(rng.choice("ab ") for _ in range(500)) for _ in range(4)]
    rows = []
    for i in range(14):
        parts = [p[rng.randrange(200) : rng.randrange(300, 500)] for p in rng.choices(pool, k=3)]
        rows.append((i, rng.choice(["", " "]).join(parts)))
    docs, plain = spark.createDataFrame(rows, "doc_id long, text string"), dict(rows)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.find_repeats(docs).collect()}
    assert got == brute.byte_repeats(plain)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.find_repeats(docs).collect()}
    assert got == brute.word_repeats(plain)


def test_byte_repeats(spark, texts):
    for docs, plain in ((spark.read.parquet(f"{SF}/documents.parquet"), texts), (awkward(spark), as_dict(spark))):
        got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.find_repeats(docs).collect()}
        assert got == brute.byte_repeats(plain)
    assert suffix_dedup.find_repeats(empty(spark)).count() == 0
    # doubling over every position decides alone
    small = awkward(spark).where("doc_id <> 10 or doc_id is null")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.find_repeats(small, every_byte=True).collect()}
    assert got == brute.byte_repeats({d: t for d, t in as_dict(spark).items() if d != 10})


@pytest.mark.parametrize("broadcast", ["10m", "-1"])
def test_hot_rank(spark, monkeypatch, broadcast):
    """Positions of one rank are dealt to several tasks, whether the ranks that recur are broadcast or not."""
    settings = {
        "spark.sql.shuffle.partitions": "8", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": broadcast,
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k",
    }
    shares, before, write = [], {key: spark.conf.get(key) for key in settings}, suffix_dedup.cut

    def watched(df, name):
        if name == "suffix-ranks":
            whole = df.groupBy(F.spark_partition_id().alias("task")).agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64(*df.columns)))
            tasks = [r.n for r in whole.collect()]
            shares.append(max(tasks) / sum(tasks))
        return write(df, name)

    monkeypatch.setattr(suffix_dedup, "cut", watched)
    positions = spark.range(3000).select(F.col("id").alias("doc_id"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("ord"))
    positions = positions.select("doc_id", "ord", (F.col("ord") * 100).alias("at"), F.lit(7).cast("long").alias("r"), F.lit(272).alias("len"))
    try:
        for key, value in settings.items():
            spark.conf.set(key, value)
        got = sorted(tuple(r) for r in suffix_dedup.double_ranks(positions, 400).collect())
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    assert got == [(d, 0, 572) for d in range(3000)]
    assert len(shares) == 2 and max(shares) < 0.5


def test_urls(spark):
    rows = [(1, "http://A.Example.com/en/7x?q", ""), (2, "https://www.bad.org/es/1", ""), (3, "http://m.bad.org/es/1.html", ""), (4, "http://good.net/de/1", '<link rel="canonical" href="http://z.org/es/5">'), (5, None, None), (6, "no scheme", ""), (7, "http://x.net/fr/2", '<meta http-equiv="refresh" content="0; url=http://z.org/es/5">'), (8, "http://z.org/es/5", ""), (9, "x://h", ""), (9, "x://h", "")]
    pages = spark.createDataFrame([(*r, "mine") for r in rows], "page_id long, url string, html string, verdict string")
    out = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(pages, queries.RULES).collect()}
    assert out == {
        1: ("a.example.com", "/en/7x", "example.com/en/7", "allow"), 2: ("www.bad.org", "/es/1", "org/es/", "block"), 3: ("m.bad.org", "/es/1.html", "org/es/", "block"),
        4: ("good.net", "/de/1", "net/de/", "allow"), 5: ("", "", None, "allow"), 6: ("", "", None, "allow"), 7: ("x.net", "/fr/2", None, "block"), 8: ("z.org", "/es/5", "org/es/", "block"), 9: ("h", "", None, "allow"),
    }
    moved = spark.createDataFrame([("x://h", "http://z.org/es/5")], "a string, b string")
    assert {r.verdict for r in url_filter.judge(pages, queries.RULES, moved).where("page_id = 9").collect()} == {"block"}
    assert url_filter.judge(pages.limit(0), queries.RULES).count() == 0


def test_url_chains(spark):
    """Chains of links over forms, relative targets and targets that are no pages, against plain components."""
    link = lambda u: f'<link href="{u}" rel="canonical">'
    rows = [
        (1, "http://c.com/x", link("https://q.org/es/1")), (2, "http://a.com/x", link("http://www.c.com/x/")), (3, "http://d.com/a/b.html", link("../bad") + link("/good")),
        (4, "http://d.com/bad", link("//q.org/es/9?z=1")), (5, "https://e.com/index.html", link("/index.html")), (6, "http://f.com/index.html", link("/index.html")),
        (7, "http://g.com/y", '<meta http-equiv="refresh" content="0;url=./z">'), (8, "http://g.com/z", None), (9, "http://h.net/de/1", link("http://q.org/es/1")), (10, "none", link("/x")),
        (11, "http://k.com/1", link("http://l.com/2")), (12, "http://m.com/3", link("http://l.com/2/")), (13, "http://g.com/good", link("mailto:x@y")), (14, "http://d.com/good", None),
    ]
    pages = spark.createDataFrame([(*r, 1, "mine") for r in rows], "page_id long, url string, html string, spread int, _url string")
    moved = spark.createDataFrame([("http://m.com/3/", "http://www.q.org/es/77"), (None, "http://g.com/y")], "a string, b string")
    out = url_filter.judge(pages, queries.RULES, moved)
    assert out.columns == [*pages.columns, "host", "path", "rule", "verdict"]
    got = {r.page_id for r in out.collect() if r.verdict == "block"}
    assert got == {1, 2, 3, 4, 11, 12, 14}  # 9 is allowed by a rule; 5 and 6 have index pages of their own
    assert {r.page_id for r in url_filter.judge(pages, queries.RULES).collect() if r.verdict == "block"} == {1, 2, 3, 4, 14}


def test_packing(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(queries.vocabulary_path())
    odd = [(50, "it's 3.5 <|endoftext|> x\x1cy İstanbul ΣΑΣ e\u0301 don't 'll \u00a0 ﬁ"), (51, "!'s a'b ''re 12'3 émile's")]
    docs = awkward(spark).select("doc_id", "text").unionByName(spark.createDataFrame(odd, "doc_id long, text string"))
    out = packing.pack(docs.where("doc_id is not null").dropDuplicates(), queries.vocabulary_path()).collect()
    pieces: dict = {}
    for r in sorted(out, key=lambda r: (r.doc_id, r.piece)):
        pieces.setdefault(r.doc_id, []).append((r.piece, r.start, r.length, r.ids_crc32))
    for doc_id, text in {**as_dict(spark), **dict(odd)}.items():
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [1]
        assert pieces[doc_id] == [(i, s, len(ids[s : s + 4096]), zlib.crc32(array.array("I", ids[s : s + 4096]).tobytes())) for i, s in enumerate(range(0, len(ids), 4096))]
    sequences: dict = {}
    for r in sorted(out, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == sequences.get(r.sequence_id, 0)
        sequences[r.sequence_id] = r.offset + r.length
    assert max(sequences.values()) <= 4096 and len(sequences) <= -(-sum(sequences.values()) // 4096) + 1
    assert packing.pack(empty(spark), queries.vocabulary_path()).count() == 0
    other = packing.encoder(queries.vocabulary_path("byte_bpe_50k.json"))  # splits otherwise: whole texts
    assert not other.apart and other("a b  c") == array.array("I", other.tokenizer.encode("a b  c", add_special_tokens=False).ids).tobytes()


def test_genetic_algorithm_beats_its_start(spark):
    """Generations take bins away from what best fit in random orders starts with, without losing or doubling an item."""
    import numpy as np

    for seed in range(3):
        rng = np.random.default_rng(seed)
        lengths = np.concatenate([rng.integers(900, 2000, 600), rng.integers(20, 900, 200)])
        start = [packing.best_fit(lengths, np.random.default_rng(seed).permutation(len(lengths)), 4096)]
        start += [packing.best_fit(lengths, rng.permutation(len(lengths)), 4096) for _ in range(packing.POPULATION - 1)]
        best, generations = packing.evolve(lengths, start, 4096, seed)
        assert generations > 0 and best.max() < min(p.max() for p in start) and np.bincount(best, lengths).max() <= 4096
        child = packing.crossover(start[0], best, lengths, 4096, rng)
        assert np.bincount(child, lengths).max() <= 4096 and np.bincount(child).min() > 0 and len(child) == len(lengths)


def test_packing_of_a_table(spark):
    """All documents of sf0.01: the tokenizer's own ids, full cover, and hardly more sequences than the total length takes."""
    from tokenizers import Tokenizer

    tokenizer, folder = Tokenizer.from_file(queries.vocabulary_path()), "/root/testdata/sf0.01"
    out = queries.op7_best_fit_packing(spark, folder).collect()
    pieces: dict = {}
    for r in sorted(out, key=lambda r: (r.doc_id, r.piece)):
        pieces.setdefault(r.doc_id, []).append((r.piece, r.start, r.length, r.ids_crc32))
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    assert pieces.keys() == docs.keys()
    for doc_id, text in docs.items():
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [1]
        assert pieces[doc_id] == [(i, s, len(ids[s : s + 4096]), zlib.crc32(array.array("I", ids[s : s + 4096]).tobytes())) for i, s in enumerate(range(0, len(ids), 4096))]
    assert len({r.sequence_id for r in out}) <= -(-sum(r.length for r in out) // 4096) + 1


def test_toxicity(spark):
    out = queries.op9_toxicity(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").where("held_out").collect()
    bad, good = [r.score for r in out if r.toxic == 1], [r.score for r in out if r.toxic == 0]
    assert sum(b > g for b in bad for g in good) + 0.5 * sum(b == g for b in bad for g in good) > 0.8 * len(bad) * len(good)
    grammar = toxicity.Grammar({"fool*": 2.0}, tuple(toxicity.KINDS.values()), toxicity.BIAS)
    rows = ["you are a foolish man", "they said you are a foolish man", "you are not a foolish man", "the foolish day", "", None, "I will hurt you", "a fine day", "foolish, that are you", "I will not hurt you", "he will be there. hurt you"]
    scored = toxicity.score(spark.createDataFrame(list(enumerate(rows)), "id long, text string"), grammar)
    s = {r.id: r.score for r in scored.collect()}
    assert s[0] > s[3] > s[1] and s[0] > s[2] > s[4] and s[4] == s[5] == s[7] == s[9] == s[10] < s[6] and s[8] > s[3]
    assert toxicity.learn(awkward(spark), spark.createDataFrame([], "doc_id long, toxic int")).lexicon == {}
    assert toxicity.score(empty(spark), grammar).count() == 0


def test_composed_transducer():
    """The composed one does what its parts do one after another, on any sequence of symbols."""
    rng, parts = random.Random(2), toxicity.transducers()
    to, out, weights = toxicity.composed()
    for _ in range(60):
        states, here = [t.start for t in parts], 0
        for _ in range(60):
            symbol = passed = rng.choice(toxicity.SYMBOLS)
            total = dict.fromkeys(toxicity.KINDS, 0.0)
            for i, part in enumerate(parts):
                states[i], passed, some = part.step(states[i], passed)
                for kind, w in some.items():
                    total[kind] += w
            number = toxicity.SYMBOLS.index(symbol)
            assert tuple(total.values()) == weights[out[here][number]]
            here = to[here][number]


def test_clauses_not_words_decide():
    """One word in different clauses: the match's kind, and with it the score, comes from what stands around it."""
    symbols = toxicity.Symbols({"clown": 3.0})
    kinds = list(toxicity.KINDS)
    say = lambda text: {k: round(x, 3) for k, x in zip(kinds, toxicity.clause_matches(text, symbols)) if x}
    at = round(float(math.log(4)), 3)
    assert say("the clown came") == {"insult": at} and say("you are a clown") == {"targeted": at} and say("clown, are you") == {"targeted": at}
    assert say("you are no clown") == {"negated": at} and say("she wrote that you are a clown") == {"reported": at} and say('"clown"') == {"reported": at}
    assert say("you left. the old man was a clown. you came") == {"insult": at} and say("no. clown") == {"insult": at}
    assert say("we will hurt them") == {"threat": round(float(math.log(2)), 3)} and say("we will not hurt them") == {} and say("hurt") == {}


def test_contamination(spark, texts):
    items = {1: "One two, three four five six seven eight nine TEN eleven twelve", 2: "short item", 3: None, 4: "", 5: "seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen", 10: "Straße 漢字 9"}
    docs = {1: "x one two three four five six seven eight nine ten; eleven twelve!", 2: "a short   ITEM, short item", 3: None, 4: "", 5: "shorts items", 6: "aber straße 漢字 9", 7: "… Straße-漢字 9 …", 8: "six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen"}
    table = spark.createDataFrame([(d, t, [1]) for d, t in docs.items()], "doc_id long, text string, hits array<int>")
    bench = spark.createDataFrame([*items.items(), (None, "lost words here")], "item_id long, text string")
    for size in (1 << 20, 150):
        out = decontaminate.find_passages(table.drop("hits"), bench, automaton_bytes=size).collect()
        assert {r.doc_id: (r.n_words, r.n_hit, len(r["items"]), decontaminate.items_digest(r["items"])) for r in out} == brute.contamination(docs, items)
    spans = {r.doc_id: [docs[r.doc_id][s.start : s.end] for s in r.spans] for r in out}
    assert spans[2] == ["short   ITEM, short item"] and spans[7] == ["Straße-漢字 9"] and spans[5] == []
    odd = decontaminate.find_passages(table.withColumns({"items_": F.lit(5), "hits_": F.lit(6), "_items": F.lit(7)}), bench, automaton_bytes=150)
    assert {(r.items_, r.hits_, r._items) for r in odd.collect()} == {(5, 6, 7)}
    kept = decontaminate.drop_contaminated(table, bench)
    assert kept.columns == table.columns and {r.doc_id for r in kept.collect()} == {3, 4, 5, 6} - ({6} if brute.contamination(docs, items)[6][1] else set())
    assert decontaminate.find_passages(table.limit(0).drop("hits"), bench).count() == 0
