"""Substring deduplication by seed and extend."""

from __future__ import annotations

import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm import repeats
from corvane.llm.shared import cut, one_row_each, restored, with_row_ids


def find_repeats(docs: DataFrame, length: int = 50, seed: int = 25) -> DataFrame:
    """Words that repeat a passage of a document with a smaller doc_id, for each document.

    Seeds are runs of `seed` words picked by winnowing; documents meet at equal seeds. Each seed that recurs is
    extended both ways, as far as a stretch of `length` words can reach around it, and every stretch that an earlier
    document has too is marked; stretches that overlap join into maximal repeats. Extension compares classes by
    fingerprint instead of pairs, first at the two outermost stretches of a seed and, where those don't settle it,
    at every one. Words are runs of bytes other than x20 and x09 to x0D.

    A null or empty text has no words; a text shorter than `length` loses none. Rows without doc_id are left out;
    of rows that share a doc_id the one with the least text counts. Other columns are ignored.

    Returns doc_id, n_words, n_removed, n_spans, kept_sha256 and kept (zstandard; null: nothing was removed).
    """
    docs = one_row_each(docs, "text")
    base = repeats.scan(docs, "words", length, seed, "substring")
    rows = repeats.anchor_rows(base)
    # written first: a hash that any share of the rows has can then be split in the join
    shared = rows.groupBy("h").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select("h")
    shared = cut(shared, "substring-shared")
    texts = repeats.follow_up(docs, rows.join(shared, "h").select("doc_id", "ord"), "words", length, seed, "substring")
    starts = repeats.repeated_starts(texts, "words", length, seed, True, "substring")
    out = repeats.kept(texts, base, starts, "words", length)
    return out.select("doc_id", F.col("n").alias("n_words"), F.coalesce("n_removed", F.lit(0)).alias("n_removed"), F.coalesce("n_spans", F.lit(0)).alias("n_spans"), F.coalesce("kept_sha256", "sha").alias("kept_sha256"), "kept")


def remove_repeats(docs: DataFrame, length: int = 50, seed: int = 25) -> DataFrame:
    """docs without repeated passages: changed texts are their kept words joined by one space, with n_chars to match.

    Documents of which nothing is left go; all others stay, in their own columns. Rows without doc_id and rows that
    share one are documents of their own; see with_row_ids.
    """

    def unpacked(batches):
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            yield pd.DataFrame({"row": batch.doc_id, "kept": [unpack.decompress(x).decode() for x in batch.kept]})

    rows = with_row_ids(docs)
    found = find_repeats(rows.select(F.col("row").alias("doc_id"), F.col("own_text").alias("text")), length, seed)
    changed = found.where("n_removed > 0").select("doc_id", "kept").mapInPandas(unpacked, "row long, kept string")
    out = rows.join(changed, "row", "left").where("kept is null or kept <> ''")
    values = {"own_text": F.coalesce("kept", "own_text")}
    if "n_chars" in docs.columns:
        values["own_n_chars"] = F.when(F.col("kept").isNotNull(), F.char_length("kept")).otherwise(F.col("own_n_chars")).cast(docs.schema["n_chars"].dataType)
    return restored(out.withColumns(values), docs.columns)
