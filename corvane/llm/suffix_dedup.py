"""Removal of repeated byte strings by distributed prefix doubling."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm import repeats
from corvane.llm.shared import cut, forget, one_row_each


def double_ranks(positions: DataFrame, length: int, name: str = "suffix") -> DataFrame:
    """Positions whose string of at least `length` bytes recurs: doc_id, at, len.

    positions: doc_id, ord, at, r (rank: equal for equal strings of len bytes), len. Each round sorts the pairs of
    ranks at a position and at the one `offset` positions on, gives equal pairs a new rank, and drops the pairs that
    stand alone: no longer string that starts there can recur. Offsets double until every rank left is of a string
    past the threshold. Pairs count only if the two strings meet without a gap, so that the rank says all bytes.
    """
    offset, current = 1, positions
    while True:
        ahead = current.select("doc_id", (F.col("ord") - offset).alias("ord"), F.col("at").alias("at_2"), F.col("r").alias("r_2"), F.col("len").alias("len_2"))
        short = current.where(F.col("len") < length).join(ahead, ["doc_id", "ord"]).where("at_2 - at <= len")
        gap = F.col("at_2") - F.col("at")
        pairs = short.select("doc_id", "ord", "at", F.xxhash64("r", gap, "r_2", "len", "len_2").alias("r"), (gap + F.col("len_2")).alias("len"))
        pairs = cut(pairs, f"{name}-pairs")
        # written first: joined to its own aggregate, a rank that most positions share stays in one task
        again = cut(pairs.groupBy("r").agg(F.count("*").alias("n")).where("n > 1").select("r"), f"{name}-again")
        ranked = cut(current.where(F.col("len") >= length).unionByName(pairs.join(again, "r").select(*pairs.columns)), f"{name}-ranks")
        left = ranked.where(F.col("len") < length).limit(1).count()
        forget(positions.sparkSession, pairs, again, *([current] if offset > 1 else []))
        current, offset = ranked, offset * 2
        if not left:
            return current.select("doc_id", "at", "len")


def ranked_positions(docs: DataFrame, length: int, first: int = 8) -> DataFrame:
    """doc_id, at of every byte position whose string of `length` bytes starts at another position too, by prefix doubling alone.

    The first rank of a position is the value of its first `first` bytes. In each round Spark sorts the pairs of a
    position's rank and the rank `offset` bytes on, and the pairs that stand for several positions get new ranks in
    that order; a position whose pair is its own goes, since no longer string there can recur. Offsets double, and the
    last one is what lacks to `length`. Two strings that overlap by less than their length say all bytes between.
    """
    spark = docs.sparkSession

    def positions(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for doc_id, text in zip(batch.doc_id, batch.text):
                raw = np.frombuffer((text or "").encode(), np.uint8)
                if len(raw) >= length:
                    windows = np.lib.stride_tricks.sliding_window_view(raw, first)
                    values = np.ascontiguousarray(windows).view(">i8").ravel().astype(np.int64)
                    yield pd.DataFrame({"doc_id": np.full(len(values), doc_id), "at": np.arange(len(values), dtype=np.int32), "r": values})

    current, size = cut(docs.select("doc_id", "text").mapInPandas(positions, "doc_id long, at int, r long"), "suffix-ranks"), first
    while size < length:
        offset = min(size, length - size)
        ahead = current.select("doc_id", (F.col("at") - offset).alias("at"), F.col("r").alias("r_2"))
        pairs = cut(current.join(ahead, ["doc_id", "at"]), "suffix-pairs")
        again = pairs.groupBy("r", "r_2").agg(F.count("*").alias("n")).where("n > 1")
        ranks = cut(again.orderBy("r", "r_2").select("r", "r_2", F.monotonically_increasing_id().alias("rank")), "suffix-reranked")
        before, current = current, cut(pairs.join(ranks, ["r", "r_2"]).select("doc_id", "at", F.col("rank").alias("r")), "suffix-ranks")
        forget(spark, before, pairs, ranks)
        size += offset
    return current.select("doc_id", "at")


def find_repeats(docs: DataFrame, length: int = 400, sample: int = 272, every_byte: bool = False) -> DataFrame:
    """Bytes covered by a string of `length` bytes that starts at another place too, in any document or the same.

    Prefix doubling runs over sampled positions: of each `length` bytes winnowing picks one run of `sample` bytes by
    content alone, so equal strings have their positions at equal places and the ranks of positions in a row say
    all bytes between. The string that a rank past the threshold stands for is repeated as a whole. What doubling
    leaves open, strings that reach beyond the last sampled position of a repeat, is settled by fingerprints of the
    strings around those positions. Matches never cross documents; they are judged on the input.

    every_byte: doubling over every position decides alone, with the same result and many times the shuffle.

    A null or empty text has no bytes. Rows without doc_id are left out; of rows
    that share a doc_id the one with the least text counts; other columns are ignored.

    Returns doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept (zstandard; null: nothing was removed).
    """
    docs = one_row_each(docs, "text")
    base = repeats.scan(docs, "bytes", length, sample, "suffix")
    if every_byte:
        starts = cut(ranked_positions(docs, length).withColumnRenamed("at", "start"), "suffix-starts")
        none = F.array().cast("array<int>")
        texts = docs.join(starts.select("doc_id").distinct(), "doc_id", "left_semi").mapInPandas(_packed, "doc_id long, body binary").withColumns({"starts": none, "ends": none})
        return _told(repeats.kept(texts, base, starts, "bytes", length))
    rows = repeats.anchor_rows(base)
    shared = rows.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h")
    shared = cut(shared, "suffix-shared")
    sampled = cut(rows.join(shared, "h").select("doc_id", "ord", "at", F.col("h").alias("r"), F.lit(sample).alias("len")), "suffix-positions")
    covered = double_ranks(sampled, length)
    spans = covered.groupBy("doc_id").agg(F.collect_list("at").alias("starts"), F.collect_list(F.col("at") + F.col("len")).alias("ends"))
    texts = repeats.follow_up(docs, sampled.select("doc_id", "ord"), "bytes", length, sample, "suffix", spans)
    starts = repeats.repeated_starts(texts, "bytes", length, sample, False, "suffix")
    return _told(repeats.kept(texts, base, starts, "bytes", length))


def _packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    pack = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        yield pd.DataFrame({"doc_id": batch.doc_id, "body": [pack.compress((t or "").encode()) for t in batch.text]})


def _told(out: DataFrame) -> DataFrame:
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return out.select("doc_id", F.col("n").alias("n_bytes"), zero("n_removed"), zero("n_spans"), F.coalesce("kept_sha256", "sha").alias("kept_sha256"), "kept")
