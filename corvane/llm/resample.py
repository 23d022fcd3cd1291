"""Target-distribution importance resampling: documents are drawn by how much they read like a target corpus."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import accumulate
from zlib import crc32

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvane.llm.decontaminate import normalise
from corvane.llm.shared import cut, forget, small_batches

BUCKETS = 10_000
HELD = "digest binary, copies long, n_words long, n_features long, buckets binary"


def feature_buckets(text: str | None, width: int, buckets: int) -> tuple[int, np.ndarray]:
    """How many words text has, and the bucket of every run of 1 to `width` consecutive words, repeats among them.

    A-Z are lower-cased; words are runs of digits, a-z and all beyond ASCII. A run's bucket is the crc32 of its words
    with one blank between; that of a longer run goes on from that of the run without its last word.
    """
    words = normalise(text)[1].split()
    spaced = [b" " + w for w in words]
    runs = [list(map(crc32, words))]
    for n in range(1, min(width, len(words))):
        runs.append(list(map(crc32, spaced[n:], runs[-1])))
    return len(words), np.concatenate([np.array(r, np.uint32) for r in runs]) % np.uint32(buckets)


def distinct_texts(docs: DataFrame, width: int = 2, buckets: int = BUCKETS) -> DataFrame:
    """A row for each different text: its SHA-256, how many documents have it, n_words, n_features and its buckets.

    Equal texts meet by grouping on the whole text, counted before they are shuffled, so copies cost nothing however
    many they are. Features are made once for each text; their buckets, packed, are all that is kept of it.
    """
    small_batches(docs.sparkSession)
    texts = docs.select(F.coalesce("text", F.lit("")).alias("text")).groupBy("text").agg(F.count("*").alias("copies"))
    kind = np.uint16 if buckets <= 1 << 16 else np.uint32

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            made = [feature_buckets(t, width, buckets) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("digest"), batch.column("copies"), pa.array([n for n, _ in made], pa.int64()), pa.array([len(b) for _, b in made], pa.int64()), pa.array([pack(b.astype(kind).tobytes()) for _, b in made], pa.binary())],
                ["digest", "copies", "n_words", "n_features", "buckets"],
            )

    return texts.withColumn("digest", F.unhex(F.sha2("text", 256))).select("text", "digest", "copies").mapInArrow(run, HELD)


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How many features each bucket holds over distinct_texts(), each text counted as often as documents have it.

    Every task adds up all its texts; what comes to the driver is one number a bucket.
    """
    kind = np.uint16 if buckets <= 1 << 16 else np.uint32

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack, total = zstandard.ZstdDecompressor().decompress, np.zeros(buckets, np.int64)
        for batch in batches:
            for packed, copies in zip(batch.column("buckets").to_pylist(), batch.column("copies").to_pylist()):
                held = np.frombuffer(unpack(packed), kind)
                if len(held) * 8 < buckets:
                    np.add.at(total, held, copies)
                else:
                    total += np.bincount(held, minlength=buckets) * copies
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there, pa.int32()), pa.array(total[there], pa.int64())], ["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in texts.select("copies", "buckets").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """For each bucket the thousandfold logarithm, rounded down, of its smoothed share in the target over that in the source."""
    n, all_s, all_t = len(source), int(source.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1.0) * (all_s + n) / ((s + 1.0) * (all_t + n)))) for s, t in zip(source.tolist(), target.tolist())], np.int64)


def weigh(docs: DataFrame, target: DataFrame, width: int = 2, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, digest, n_words, n_features and weight of every row of docs (doc_id, text) that has a doc_id.

    The weight is the mean gain of a document's features, rounded down, 0 without features. Texts are collapsed, given
    a weight each, and the weights joined back by SHA-256, a join of narrow rows whose large keys Spark may split.
    """
    spark = docs.sparkSession
    kind = np.uint16 if buckets <= 1 << 16 else np.uint32
    docs = docs.where("doc_id is not null")
    texts = cut(distinct_texts(docs, width, buckets), "resample-texts")
    held = spark.sparkContext.broadcast(gains(bucket_counts(texts, buckets), bucket_counts(distinct_texts(target, width, buckets), buckets)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack, gain = zstandard.ZstdDecompressor().decompress, held.value
        for batch in batches:
            found = [np.frombuffer(unpack(b), kind) for b in batch.column("buckets").to_pylist()]
            weights = [int(gain[b].sum()) // len(b) if len(b) else 0 for b in found]
            yield pa.RecordBatch.from_arrays([batch.column("digest"), batch.column("n_words"), batch.column("n_features"), pa.array(weights, pa.int64())], ["digest", "n_words", "n_features", "weight"])

    weights = texts.select("digest", "n_words", "n_features", "buckets").mapInArrow(run, "digest binary, n_words long, n_features long, weight long")
    own = docs.select("doc_id", F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("digest"))
    out = cut(own.join(weights, "digest"), "resample-weights")
    forget(spark, texts)
    return out.select("doc_id", "digest", "n_words", "n_features", "weight")


def resample(docs: DataFrame, target: DataFrame, percent: int = 25, min_words: int = 20, seed: int = 7, width: int = 2, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, digest, n_words, n_features, weight, score and rank of every document; rank is null for those not drawn.

    Of the documents with `min_words` words or more, `percent` in a hundred are drawn without replacement in
    proportion to the exponential of their weights: those with the highest weight plus Gumbel noise, which comes from a
    hash of seed and doc_id, so any partitioning draws the same. Ties go to the smaller doc_id, then to the smaller digest.

    Null and empty texts have no features and weight 0, and aren't drawn. Rows without doc_id are no documents: they
    count nowhere and aren't returned. Rows that share a doc_id are documents of their own with the same noise. An
    empty docs gives no rows; an empty target makes all buckets alike but for the counts in docs. Only doc_id and text
    are read, so other columns may have any name.
    """
    spark = docs.sparkSession
    drawn = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string")).cast("binary"), 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(-1000 * F.log(-F.log((drawn + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")
    scored = weigh(docs, target, width, buckets).withColumn("score", F.col("weight") + noise).withColumn("able", F.col("n_words") >= min_words)
    # Scores are whole numbers between bounds that logarithms set, some 100 thousand values whatever the size of docs
    counts = scored.where("able").groupBy("score").agg(F.count("*").alias("n")).collect()
    quota = percent * sum(r.n for r in counts) // 100
    counts.sort(key=lambda r: -r.score)
    ahead = [(r.score, before) for r, before in zip(counts, accumulate((r.n for r in counts), initial=0)) if before < quota]
    above = F.broadcast(spark.createDataFrame(ahead, "score long, ahead long"))
    marked = scored.join(above, "score", "left").withColumn("able", F.col("able") & F.col("ahead").isNotNull())
    place = F.row_number().over(Window.partitionBy("score").orderBy("doc_id", "digest")) + F.col("ahead")
    columns = ["doc_id", "digest", "n_words", "n_features", "weight", "score"]
    first = marked.where("able").withColumn("rank", place).select(*columns, F.when(F.col("rank") <= quota, F.col("rank")).alias("rank"))
    return first.unionByName(marked.where("not able").select(*columns, F.lit(None).cast("long").alias("rank")))


def drawn_documents(docs: DataFrame, target: DataFrame, **settings) -> DataFrame:
    """The rows of docs, in their own columns, that resample() draws."""
    ids = resample(docs, target, **settings).where("rank is not null").select(F.col("doc_id").alias("_drawn_id"), F.col("digest").alias("_drawn_text")).distinct()
    return docs.join(ids, (F.col("doc_id") == F.col("_drawn_id")) & (F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)) == F.col("_drawn_text")), "left_semi")
