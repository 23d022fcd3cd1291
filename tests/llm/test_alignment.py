"""Alignment of two tokenizers against its definition."""

from __future__ import annotations

import random

import pytest

from corvane.llm import alignment
from corvane.llm.queries import op12_cross_tokenizer_alignment, vocabulary_path
from tests.llm import brute
from tests.llm.test_operators import SF, awkward, empty

A, B = vocabulary_path("byte_bpe_50k.json"), vocabulary_path("piece_bpe_32k.model")
COLUMNS = "doc_id n_a n_b n_groups n_links n_best count_sum groups_sha256".split()


@pytest.fixture(scope="module")
def tokenizers():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B)


def rows_of(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=str)


def odd_texts():
    rng = random.Random(4)
    signs = ["a", "Z", "é", "ß", "漢", "字", "😀", "́", " ", "  ", "\n", "\t", "\r\n", "\x1c", "\x85", " ", " ", "▁", "'s", "'ll", "12", "½", "!?", "<s>", "<|endoftext|>", "<0x41>", "the ", " of", "\x00", "‍", "ﬁ"]
    return ["".join(rng.choice(signs) for _ in range(rng.randrange(1, 25))) for _ in range(300)] + [" ", "   ", "\n ", "x ", " x", "a  b   c ", "e" * 3000, " " * 2500 + "x", "word" * 700 + " and more"]


def test_whole_table(spark, tokenizers):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rows, _ = brute.aligned(docs, *tokenizers)
    out = op12_cross_tokenizer_alignment(spark, SF)
    assert rows_of(out) == sorted(rows, key=str)
    assert dict(out.dtypes) == {c: "bigint" if c != "groups_sha256" else "string" for c in COLUMNS}


def test_odd_texts_in_small_chunks(spark, tokenizers, monkeypatch):
    """Many chunks, rounds of sums and deals of chunks give what one of each gives."""
    texts = list(enumerate(odd_texts()))
    rows, counts = brute.aligned(texts, *tokenizers)
    assert sum(r[1] > 0 for r in rows) > 150 and sum(r[1] == 0 for r in rows) > 10
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(5)
    assert rows_of(alignment.align(docs, A, B, stripes=300)) == sorted(rows, key=str)
    best = {}
    for (a, _), n in counts.items():
        best[a] = max(best.get(a, 0), n)
    found = {(r.a, r.b): (r.documents, r.best) for r in alignment.pair_counts(docs, A, B, stripes=777).collect()}
    assert found == {(a, b): (n, n == best[a]) for (a, b), n in counts.items()}


def test_rounds_of_sums_and_deals(spark, tokenizers, monkeypatch):
    texts = list(enumerate(odd_texts()[:120]))
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(6)
    linked = alignment.cut(alignment._linked(docs, A, B, 400), "test")
    sums, pairs = linked.where("kind = 'sums'"), linked.where("kind = 'pairs'")
    n_a, n_b = alignment._sizes(A, B)
    monkeypatch.setattr(alignment, "FAN_IN", 2)
    monkeypatch.setattr(alignment, "SCORED_CHUNKS", 2)
    counted = alignment.cut(alignment._counted(sums, n_a, n_b, 400), "test")
    scored = {(r.chunk, r.place): (r.n_best, r.count_sum) for r in alignment._scored(pairs, counted, 6, n_a, n_b, 400).collect()}
    docs_of = {(r.chunk, r.place): r.doc_id for r in linked.where("kind = 'doc'").collect()}
    rows, _ = brute.aligned(texts, *tokenizers)
    assert {docs_of[k]: v for k, v in scored.items()} == {r[0]: (r[5], r[6]) for r in rows if r[1]}


def test_awkward_rows(spark, tokenizers):
    docs = awkward(spark).withColumnsRenamed({"lang": "chunk", "source": "kind", "n_chars": "n_a"})
    rows, _ = brute.aligned([(r.doc_id, r.text) for r in docs.collect()], *tokenizers)
    assert rows_of(alignment.align(docs, A, B)) == sorted(rows, key=str)
    assert alignment.align(empty(spark), A, B).count() == 0
    groups = {r.doc_id: r.groups for r in alignment.token_groups(docs, A, B).collect()}
    assert groups[1] == groups[2] == "" and {brute.sha(groups[r[0]]) for r in rows if r[1]} == {r[7] for r in rows if r[1]}


def test_whole_texts_by_segments(tokenizers):
    """A segment's tokens are those that it has in its text, with the tokenizers' own libraries."""
    aligner = alignment.Aligner(A, B)
    texts = odd_texts()
    for text, (links, groups, n_a, n_b, _) in zip(texts, aligner.texts(texts)):
        if n_a:
            assert n_a == len(tokenizers[0].encode(" " + text, add_special_tokens=False).ids)
            assert n_b == len(tokenizers[1].encode(text))
            assert "|".join(g for g in groups.split(";")).count("|") == 2 * groups.count(";") + 1 and len(links) >= max(n_a, n_b)
