"""Finding stretches of a fixed length that recur, without comparing documents in pairs.

A stretch is `length` consecutive symbols (words or bytes). Winnowing gives each stretch one anchor inside it, a
run of `k` symbols chosen by the stretch's own content alone, so equal stretches meet at equal anchors. Work then
narrows: only anchors that recur are followed up; of each the outermost stretches are tried first, since their
being repeated covers everything between them; what is left undecided is compared stretch by stretch, within the
classes of its anchor. Classes are counted by aggregation, never expanded into pairs, so a class may hold any
share of the rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.shared import cut, mix, window_hashes, winnow, word_hashes

SECOND_BASE = 0x9FB21C651E98DF25
BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))

#: What a text is cut into: bytes.split() splits at x20 and x09 to x0D only.
PIECES: dict[str, Callable[[bytes], list[bytes] | bytes]] = {"words": bytes.split, "bytes": lambda raw: raw}
JOINT = {"words": b" ", "bytes": b""}


def symbols(pieces: list[bytes] | bytes) -> np.ndarray:
    if isinstance(pieces, bytes):
        return BYTE_VALUES[np.frombuffer(pieces, np.uint8)]
    return mix(word_hashes(pieces))


def scan(docs: DataFrame, kind: str, length: int, k: int, name: str) -> DataFrame:
    """Per document: its size, the digest of its pieces if nothing is removed, and hash and place of every anchor."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.doc_id, batch.text):
                pieces = PIECES[kind]((text or "").encode())
                hashes = window_hashes(symbols(pieces), k)
                at, _, _ = winnow(hashes, length - k + 1)
                whole = JOINT[kind].join(pieces) if kind == "words" else pieces
                rows.append((doc_id, len(pieces), hashlib.sha256(whole).hexdigest(), hashes[at].view(np.int64), at.astype(np.int32)))
            yield pd.DataFrame(rows, columns=["doc_id", "n", "sha", "hashes", "places"])

    out = docs.select("doc_id", "text").mapInPandas(run, "doc_id long, n long, sha string, hashes array<long>, places array<int>")
    return cut(out, f"{name}-anchors")


def anchor_rows(base: DataFrame) -> DataFrame:
    """A row for each anchor: document, number in it, place, hash."""
    zipped = F.posexplode(F.arrays_zip("hashes", "places"))
    return base.select("doc_id", zipped.alias("ord", "a")).select("doc_id", "ord", F.col("a.places").alias("at"), F.col("a.hashes").alias("h"))


def follow_up(docs: DataFrame, recurring: DataFrame, kind: str, length: int, k: int, name: str, covered: DataFrame | None = None) -> DataFrame:
    """Texts that have recurring anchors, compressed, and for each such anchor the fingerprints of its outermost stretches.

    recurring: doc_id, ord; covered: doc_id, starts and ends (arrays) of what is known to be repeated already.
    """
    wanted = recurring.groupBy("doc_id").agg(F.collect_list("ord").alias("ords"))
    if covered is not None:
        wanted = wanted.join(covered, "doc_id", "left")
    else:
        wanted = wanted.withColumns({"starts": F.lit(None).cast("array<int>"), "ends": F.lit(None).cast("array<int>")})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pack = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            rows = []
            for doc_id, text, ords, starts, ends in zip(batch.doc_id, batch.text, batch.ords, batch.starts, batch.ends):
                raw = (text or "").encode()
                values = symbols(PIECES[kind](raw))
                hashes = window_hashes(values, k)
                at, low, high = winnow(hashes, length - k + 1)
                ords = np.sort(np.asarray(ords))
                at, low, high = at[ords], low[ords], high[ords]
                prints = window_hashes(values, length, SECOND_BASE).view(np.int64)
                known = np.zeros(len(ords), bool)
                starts, ends = merged(starts, ends)
                if len(starts):
                    in_span = np.searchsorted(starts, low, "right") - 1
                    known = (in_span >= 0) & (high + length <= ends[np.maximum(in_span, 0)])
                rows.append((doc_id, pack.compress(raw), hashes[at].view(np.int64), low.astype(np.int32), high.astype(np.int32), prints[low], prints[high], known, starts, ends))
            yield pd.DataFrame(rows, columns=["doc_id", "body", "h", "low", "high", "f_low", "f_high", "known", "starts", "ends"])

    schema = "doc_id long, body binary, h array<long>, low array<int>, high array<int>, f_low array<long>, f_high array<long>, known array<boolean>, starts array<int>, ends array<int>"
    return cut(docs.select("doc_id", "text").join(wanted, "doc_id").mapInPandas(run, schema), f"{name}-texts")


def merged(starts, ends) -> tuple[np.ndarray, np.ndarray]:
    """Sorted disjoint spans that cover the same places; touching spans become one."""
    if starts is None or len(starts) == 0:
        return np.empty(0, np.int32), np.empty(0, np.int32)
    starts, ends = np.asarray(starts, np.int64), np.asarray(ends, np.int64)
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(ends[order])
    first = np.concatenate([[True], starts[1:] > reach[:-1]])
    last = np.append(first[1:], True)
    return starts[first].astype(np.int32), reach[last].astype(np.int32)


def repeated_starts(texts: DataFrame, kind: str, length: int, k: int, earlier: bool, name: str) -> DataFrame:
    """doc_id and start of repeated stretches that, with the known spans, cover all that is repeated.

    A stretch is repeated if it is in a document with a smaller doc_id (earlier), or else if it is anywhere else too.

    The outermost stretches around an anchor say all the symbols its stretches are made of: its context. Rows with
    equal contexts are decided by these two, all but the first of them when `earlier`, so one of them stands for all
    in the comparison of inner stretches.
    """
    context = ["h", "f_low", "f_high", "size"]
    parts = F.explode(F.arrays_zip("h", "low", "high", "f_low", "f_high", "known"))
    probes = texts.select("doc_id", parts.alias("p")).select("doc_id", "p.h", "p.low", (F.col("p.high") - F.col("p.low")).alias("size"), "p.f_low", "p.f_high", "p.known")
    ends = probes.select("doc_id", "h", F.explode(F.when(F.col("size") == 0, F.array("f_low")).otherwise(F.array("f_low", "f_high"))).alias("f"))
    met = ends.groupBy("h", "f").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
    met = cut(met.where("first < last" if earlier else "n > 1").select("h", "f", "first"), f"{name}-ends")

    def judged(rows: DataFrame, by: str, flag: str) -> DataFrame:
        """A flag for each row: whether the stretch with fingerprint `by` is repeated."""
        m = met.select("h", F.col("f").alias(by), "first")
        found = F.col("first") < F.col("doc_id") if earlier else F.col("first").isNotNull()
        return rows.join(m, ["h", by], "left").withColumn(flag, F.coalesce(found, F.lit(False))).drop("first")

    tried = cut(judged(judged(probes, "f_low", "d_low"), "f_high", "d_high"), f"{name}-tried")
    is_open = ~F.col("known") & ~(F.col("d_low") & F.col("d_high"))
    alike = tried.groupBy(*context).agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "low")).alias("one"), F.max(is_open).alias("open"))
    alike = cut(alike.select(*context, "n", "one.doc_id", "one.low", "open"), f"{name}-contexts")
    classes = alike.groupBy("h").agg(F.min("doc_id").alias("first"), F.max(F.when(F.col("open"), F.col("doc_id"))).alias("asks"), F.count("*").alias("kinds"))
    asked = classes.where("kinds > 1 and asks is not null" + " and first < asks" * earlier).select("h")
    asked = cut(asked, f"{name}-asked")
    answering = alike.join(asked, "h").groupBy("doc_id").agg(F.collect_list(F.struct("low", "size", "h", "n", "open")).alias("ranges"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            for doc_id, body, ranges in zip(batch.doc_id, batch.body, batch.ranges):
                prints = window_hashes(symbols(PIECES[kind](unpack.decompress(body))), length, SECOND_BASE).view(np.int64)
                low, size = np.array([r["low"] for r in ranges]), np.array([r["size"] for r in ranges]) + 1
                of = np.repeat(np.arange(len(low)), size)
                step = np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size)
                pick = lambda c, kind: np.array([r[c] for r in ranges], kind)[of]  # noqa: E731, B023
                rows = {"doc_id": np.full(len(of), doc_id), "low": low[of].astype(np.int32), "step": step.astype(np.int32), "h": pick("h", np.int64), "f": prints[low[of] + step], "n": pick("n", np.int64), "open": pick("open", bool)}
                yield pd.DataFrame(rows)

    stretches = texts.select("doc_id", "body").join(answering, "doc_id").mapInPandas(run, "doc_id long, low int, step int, h long, f long, n long, open boolean")
    stretches = cut(stretches, f"{name}-stretches")
    again = stretches.groupBy("h", "f").agg(F.sum("n").alias("all"), F.min("doc_id").alias("first"), F.count("*").alias("kinds")).where("kinds > 1").select("h", "f", "first")
    inner = stretches.where("open").select("doc_id", "low", "step", "h", "f").join(again, ["h", "f"])
    if earlier:
        inner = inner.where("first < doc_id")
    found = inner.groupBy("doc_id", "low").agg(F.collect_list("step").alias("steps"))
    # a document can have the same context at several places
    whose = alike.where("open").join(found, ["doc_id", "low"]).select(*context, "doc_id", "steps")
    places = tried.where(is_open).select("doc_id", *context, "low").join(whose, ["doc_id", *context]).select("doc_id", "low", F.explode("steps").alias("step")).selectExpr("doc_id", "low + step as start")
    low = tried.where("d_low").select("doc_id", F.col("low").alias("start"))
    high = tried.where("d_high").select("doc_id", (F.col("low") + F.col("size")).alias("start"))
    return low.unionByName(high).unionByName(places)


def kept(texts: DataFrame, base: DataFrame, starts: DataFrame, kind: str, length: int) -> DataFrame:
    """Per document: doc_id, n, spans (removed pieces, as [start, end)), n_removed, sha and body of what is left (null: all of it)."""
    lists = starts.groupBy("doc_id").agg(F.collect_list("start").alias("more"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pack, unpack = zstandard.ZstdCompressor(level=3), zstandard.ZstdDecompressor()
        for batch in batches:
            rows = []
            for doc_id, body, starts, ends, more in zip(batch.doc_id, batch.body, batch.starts, batch.ends, batch.more):
                more = np.asarray([] if more is None else more, np.int64)
                starts, ends = merged(np.concatenate([starts, more]), np.concatenate([ends, more + length]))
                pieces = PIECES[kind](unpack.decompress(body))
                bounds = zip(np.concatenate([[0], ends]).tolist(), np.append(starts, len(pieces)).tolist())
                left = [pieces[a:b] for a, b in bounds if a < b]
                whole = b"".join(left) if kind == "bytes" else b" ".join(w for run in left for w in run)
                rows.append((doc_id, int((ends - starts).sum()), len(starts), hashlib.sha256(whole).hexdigest(), pack.compress(whole)))
            yield pd.DataFrame(rows, columns=["doc_id", "n_removed", "n_spans", "kept_sha256", "kept"])

    changed = texts.select("doc_id", "body", "starts", "ends").join(lists, "doc_id", "left").where("more is not null or size(starts) > 0")
    changed = changed.mapInPandas(run, "doc_id long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    return base.select("doc_id", "n", "sha").join(changed, "doc_id", "left")
