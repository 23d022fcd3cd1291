"""Alignment of two tokenizers' ids over a corpus: which tokens overlap, and which pairs of ids do so in most documents."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.llm.shared import cut, forget, small_batches

#: The splitting rule of byte-level vocabularies, and the mark that stands for a blank in pieces.
WORD_RULE = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
BLANK = "▁"
#: Neither vocabulary has a token that holds a blank after something else, so a text falls apart before such blanks.
APART, RUNS = re.compile(r"(?<=\S)(?= )"), re.compile(r"\A |\s |\s\Z")

STRIPES = 256
#: Pairs of a chunk of documents, and different segments that a worker keeps.
CHUNK, KEPT = 1 << 20, 300_000
#: Segments beyond so many bytes are tokenized one by one, by a library whose time doesn't grow with their square.
LONG = 1000
#: Blobs that one task merges into a block of counts, and chunks that one task scores.
FAN_IN, SCORED_CHUNKS = 256, 4096


@cache
def byte_symbols() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary: itself if printable, else the next one from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class ByteVocabulary:
    """A byte-level BPE vocabulary: ids of texts, and the bytes of each id."""

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        held = json.load(open(path, encoding="utf-8"))
        if held["normalizer"]:
            raise ValueError(f"{path}: it changes texts before it splits them")
        symbols, special = byte_symbols(), {t["id"] for t in held["added_tokens"]}
        ranks = {bytes(symbols[c] for c in token): i for token, i in held["model"]["vocab"].items() if i not in special}
        merged = [bytes(symbols[c] for c in "".join(m.split(" ") if isinstance(m, str) else m)) for m in held["model"]["merges"]]
        made = [ranks[m] for m in merged]
        if made != sorted(made):
            raise ValueError(f"{path}: ids don't stand in the order of merges")
        self.bytes = [b""] * (max([*ranks.values(), *special]) + 1)
        for token, i in ranks.items():
            self.bytes[i] = token
        self.sizes = np.array(list(map(len, self.bytes)), np.int64)
        self.of_words = tiktoken.Encoding("own", pat_str=WORD_RULE, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        whole = Tokenizer.from_file(path)
        whole.encode_special_tokens = True
        self.of_long = lambda text: whole.encode(text, add_special_tokens=False).ids


class PieceVocabulary:
    """A vocabulary of pieces with byte fallback, which sets a blank before a text of its own accord."""

    def __init__(self, path: str):
        import sentencepiece

        held = sentencepiece.SentencePieceProcessor(model_file=path)
        byte = re.compile(r"<0x([0-9A-F]{2})>")
        self.bytes = []
        for i in range(held.get_piece_size()):
            piece, m = held.id_to_piece(i), held.is_byte(i)
            self.bytes.append(bytes([int(byte.fullmatch(piece)[1], 16)]) if m else b"" if held.is_control(i) or held.is_unknown(i) else piece.replace(BLANK, " ").encode())
        self.sizes = np.array(list(map(len, self.bytes)), np.int64)
        blank = [held.piece_to_id(BLANK)]  # it sets none before an empty text
        self.of_words = self.of_long = lambda text: held.encode(text[1:]) if text != " " else blank


def segments_of(text: str) -> list[str]:
    """Parts of a text, each without the blank before it, whose tokens are the text's own."""
    if RUNS.search(text):  # a blank at either end or after other white space: not every blank parts
        return [part[1:] for part in APART.split(" " + text)]
    return text.split(" ")


class Aligner:
    """Tokens of both vocabularies over the same bytes, a segment at a time; segments that recur are kept, in columns."""

    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = ByteVocabulary(path_a), PieceVocabulary(path_b)
        self.n_b = len(self.b.bytes)
        if len(self.a.bytes) * self.n_b >= 1 << 32:
            raise ValueError("a pair of ids doesn't fit into 32 bits")
        ids = [str(i) for i in range(max(len(self.a.bytes), self.n_b))]
        self.comma, self.bar, self.semicolon = (np.array([i + end for i in ids], object) for end in ",|;")
        self.digits = np.array([len(i) + 1 for i in ids])
        self.clear()

    def clear(self) -> None:
        self.place: dict[str, int] = {}
        self.groups: list[str] = []
        # links of all segments, where each one's end, and their tokens of either vocabulary and groups: -1 if not spelt
        self.links, self.ends, self.sizes = np.empty(1 << 16, np.uint32), np.zeros(1 << 14, np.int64), np.empty((1 << 14, 3), np.int64)

    def texts(self, texts: list[str | None]) -> Iterator[tuple[np.ndarray, str, int, int, int]]:
        """Links of each text behind a blank, its groups, how many tokens of either and groups it has; nothing of a text
        that is null or empty or that its tokens don't spell."""
        parts = [segments_of(t) if t else [] for t in texts]
        new = set().union(*parts) - self.place.keys()
        if len(self.place) + len(new) > KEPT:
            self.clear()
            new = set().union(*parts)
        together: list[str] = []
        size = 0
        for s in new:
            if len(s) > LONG // 4 or not s or s[-1].isspace():  # a blank at an end would run into the next segment
                self.alone(s)
                continue
            together.append(s)
            size += len(s)
            if size > 1 << 16:
                self.add(together)
                together, size = [], 0
        self.add(together)
        for part in parts:
            places = list(map(self.place.__getitem__, part))
            found = np.array(places, np.int64)
            n_a, n_b, n_groups = self.sizes[found].sum(0).tolist() if places and self.sizes[found, 0].min() >= 0 else (0, 0, 0)
            if not n_a:
                yield np.empty(0, np.uint32), "", 0, 0, 0
                continue
            first, after = self.ends[found], self.ends[found + 1]
            long = after - first
            yield self.links[np.repeat(after - np.cumsum(long), long) + np.arange(long.sum())], ";".join([self.groups[i] for i in places]), n_a, n_b, n_groups

    def add(self, segments: list[str]) -> None:
        if segments and not self.made(segments, self.a.of_words, self.b.of_words):
            for s in segments:
                self.alone(s)

    def alone(self, segment: str) -> None:
        if not self.made([segment], self.a.of_long, self.b.of_long):
            none = np.empty(0, np.uint32)
            self.keep([segment], none, np.zeros(1, np.int64), np.full((1, 3), -1), [""])

    def keep(self, segments: list[str], links: np.ndarray, ends: np.ndarray, sizes: np.ndarray, groups: list[str]) -> None:
        n = len(self.place)
        base = int(self.ends[n])
        while len(self.links) < base + len(links):
            self.links = np.concatenate([self.links, np.empty_like(self.links)])
        while len(self.ends) <= n + len(segments):
            self.ends, self.sizes = np.concatenate([self.ends, np.zeros_like(self.ends)]), np.concatenate([self.sizes, np.empty_like(self.sizes)])
        self.links[base : base + len(links)] = links
        self.ends[n + 1 : n + 1 + len(segments)] = base + ends
        self.sizes[n : n + len(segments)] = sizes
        self.groups += groups
        self.place.update(zip(segments, range(n, n + len(segments))))

    def made(self, segments: list[str], encode_a: Callable, encode_b: Callable) -> bool:
        """Whether the tokens of both spell the segments one after another; if so, these are kept."""
        line = " " + " ".join(segments)
        raw = line.encode()
        a, b = np.array(encode_a(line), np.int64), np.array(encode_b(line), np.int64)
        ends_a, ends_b = np.cumsum(self.a.sizes[a]), np.cumsum(self.b.sizes[b])
        if not len(a) or ends_a[-1] != len(raw) or b"".join(map(self.b.bytes.__getitem__, b.tolist())) != raw:  # bytes of a byte-level vocabulary are always the text's
            return False
        both = np.concatenate([ends_a, ends_b])
        both.sort(kind="stable")
        again = both[1:] == both[:-1]
        ends, cuts = both[np.append(~again, True)], both[1:][again]
        chars = np.append(np.flatnonzero((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80), len(raw))
        last = chars[np.cumsum([len(s) + 1 for s in segments])]
        if (cuts[np.minimum(np.searchsorted(cuts, last), len(cuts) - 1)] != last).any():
            return False
        # between two ends that follow each other lies one token of either: the bytes that a pair has in common
        links = (a[np.searchsorted(ends_a, ends)] * self.n_b + b[np.searchsorted(ends_b, ends)]).astype(np.uint32)
        group_a, group_b = np.searchsorted(cuts, ends_a), np.searchsorted(cuts, ends_b)
        place_a, place_b = np.arange(len(a)) + np.searchsorted(group_b, group_a), np.arange(len(b)) + np.searchsorted(group_a, group_b, "right")
        names, wide = np.empty(len(a) + len(b), object), np.empty(len(a) + len(b), np.int64)
        names[place_a] = np.where(cuts[group_a] == ends_a, self.bar[a], self.comma[a])
        names[place_b] = np.where(cuts[group_b] == ends_b, self.semicolon[b], self.comma[b])
        wide[place_a], wide[place_b] = self.digits[a], self.digits[b]
        upto = [np.searchsorted(x, last, "right") for x in (ends, ends_a, ends_b, cuts)]
        text, stop = "".join(names.tolist()), np.cumsum(wide)[upto[1] + upto[2] - 1].tolist()
        groups = [text[i : j - 1] for i, j in zip([0, *stop], stop)]
        self.keep(segments, links, upto[0], np.diff(np.stack(upto[1:], 1), axis=0, prepend=np.zeros((1, 3), np.int64)), groups)
        return True


def packed(values: np.ndarray) -> bytes:
    """Numbers as bytes, all first bytes first, compressed."""
    values = np.ascontiguousarray(values)
    return zstandard.ZstdCompressor(level=1).compress(values.view(np.uint8).reshape(len(values), values.itemsize).T.tobytes())


def unpacked(raw: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8)
    return np.ascontiguousarray(flat.reshape(size, -1).T).view(kind).ravel()


def striped(keys: np.ndarray, n_b: int, stripes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Order of keys by stripe, that of their first id modulo `stripes`; the cells of their stripe's block; stripes there and where they begin."""
    a, b = np.divmod(keys, np.uint32(n_b))
    stripe = (a % np.uint32(stripes)).astype(np.uint16)
    order = np.argsort(stripe, kind="stable")
    cells = (a // np.uint32(stripes) * np.uint32(n_b) + b)[order]
    there, first = np.unique(stripe[order], return_index=True)
    return order, cells, there, first


class Sums:
    """How many documents of a task hold each pair: sorted pairs, merged with those of the next chunk."""

    def __init__(self):
        self.keys, self.counts = np.empty(0, np.uint32), np.empty(0, np.int64)

    def add(self, keys: np.ndarray) -> None:
        new, counts = np.unique(keys, return_counts=True)
        both = np.concatenate([self.keys, new])
        self.keys, place = np.unique(both, return_inverse=True)
        total = np.zeros(len(self.keys), np.int64)
        np.add.at(total, place, np.concatenate([self.counts, counts]))
        self.counts = total


DOC = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
LINKED = f"kind string, chunk long, place int, {DOC}, stripe int, docs binary, cells binary, times binary"
_ARROW = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary()}


def _blobs(keys: np.ndarray, n_b: int, stripes: int, *columns: np.ndarray) -> dict[str, list]:
    """stripe, cells and the given columns of the pairs of each stripe, as bytes; `docs` as differences."""
    order, cells, there, first = striped(keys, n_b, stripes)
    parts = [slice(i, j) for i, j in zip(first.tolist(), [*first[1:].tolist(), len(keys)])]
    docs, times = [c[order] if c is not None else None for c in columns]
    out = {"stripe": there.astype(np.int32), "cells": [packed(cells[p]) for p in parts], "times": [packed(times[p]) for p in parts]}
    return out if docs is None else out | {"docs": [packed(np.diff(docs[p], prepend=np.uint32(0))) for p in parts]}


def _linked(docs: DataFrame, path_a: str, path_b: str, stripes: int) -> DataFrame:
    """All that reading the texts gives, in one pass: rows of kind `doc`, `pairs` of a chunk of documents in a stripe, and
    `sums`, the pairs of a task in a stripe with the number of its documents that hold them.

    A chunk has no more pairs than CHUNK and those of one document, so that no id, however frequent, makes a row large.
    """
    small_batches(docs.sparkSession, 500)
    id_field = docs.select("doc_id").schema.fields[0]
    fields = T.StructType.fromDDL(LINKED).fields

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, sums = Aligner(path_a, path_b), Sums()
        chunk, held, size, kind_of_id = TaskContext.get().partitionId() << 32, [], 0, pa.null()

        def rows(kind: str, n: int, ids: pa.Array | None, **columns) -> pa.RecordBatch:
            columns |= {"kind": [kind] * n}
            arrays = [pa.array(columns[f.name], _ARROW[f.dataType.simpleString()]) if f.name in columns else pa.nulls(n, _ARROW[f.dataType.simpleString()]) for f in fields]
            return pa.RecordBatch.from_arrays([pa.nulls(n, kind_of_id) if ids is None else ids, *arrays], ["doc_id", *(f.name for f in fields)])

        def of_chunk() -> Iterator[pa.RecordBatch]:
            keys = np.concatenate([k for k, _ in held])
            sums.add(keys)
            docs_of = np.repeat(np.arange(len(held), dtype=np.uint32), [len(k) for k, _ in held])
            blobs = _blobs(keys, aligner.n_b, stripes, docs_of, np.concatenate([t for _, t in held]).astype(np.uint32))
            yield rows("pairs", n := len(blobs["stripe"]), None, chunk=[chunk] * n, **blobs)

        def of_task() -> Iterator[pa.RecordBatch]:
            blobs = _blobs(sums.keys, aligner.n_b, stripes, None, sums.counts)
            yield rows("sums", n := len(blobs["stripe"]), None, chunk=[chunk] * n, **blobs)

        for batch in batches:
            ids, made = batch.column("doc_id"), []
            kind_of_id = ids.type
            for links, groups, n_a, n_b, n_groups in aligner.texts(batch.column("text").to_pylist()):
                made.append((chunk, len(held), n_a, n_b, n_groups, len(links), hashlib.sha256(groups.encode()).hexdigest() if n_a else ""))
                held.append(np.unique(links, return_counts=True))
                size += len(held[-1][0])
                if size >= CHUNK or len(held) >= 1 << 16:
                    yield from of_chunk()
                    chunk, held, size = chunk + 1, [], 0
                    if len(sums.keys) > 4 * CHUNK:
                        yield from of_task()
                        sums = Sums()
            yield rows("doc", len(made), ids, **dict(zip(("chunk", "place", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"), zip(*made))))
        if held:
            yield from of_chunk()
        yield from of_task()

    return docs.select("doc_id", "text").mapInArrow(run, T.StructType([T.StructField("doc_id", id_field.dataType), *fields]))


def _units(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[tuple[bool, tuple, tuple]]:
    """Of rows in the order of their first n columns: whether a new unit begins, the unit, and the other columns."""
    unit = None
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            yield row[:n] != unit, row[:n], row[n:]
            unit = row[:n]


def _counted(sums: DataFrame, n_a: int, n_b: int, stripes: int) -> DataFrame:
    """stripe, cells, times: twice the number of documents that hold a pair, and 1 more if no pair of its first id has a
    higher count; each stripe added up in a dense block of counts, whose row maxima tell.

    Sums meet in groups of about FAN_IN, those groups' sums meet again, and so on: no task reads more than so many blobs
    for a stripe, however many there are.
    """

    def adder(last: bool) -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            block, rows = np.zeros((-(-n_a // stripes), n_b), np.int64), np.empty(0, np.int64)

            def out(stripe: int, part: int) -> pa.RecordBatch:
                counts = block[rows]  # rows without a count aren't looked at
                row, b = np.nonzero(counts)
                cells, found = (rows[row] * n_b + b).astype(np.uint32), counts[row, b]
                if last:
                    found = found * 2 + (found == counts.max(axis=1)[row])
                block[rows] = 0
                parts = [slice(i, i + CHUNK) for i in range(0, len(cells), CHUNK)]
                columns = [stripe] * len(parts), [part] * len(parts), [packed(cells[p]) for p in parts], [packed(found[p]) for p in parts]
                return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int32(), pa.int64(), pa.binary(), pa.binary()))], ["stripe", "part", "cells", "times"])

            before = ()
            for new, unit, (cells, times) in _units(batches, 2):
                if new:
                    if before:
                        yield out(*before)
                    before, rows = unit, np.empty(0, np.int64)
                held = unpacked(cells, np.uint32)
                rows = np.union1d(rows, held // np.uint32(n_b)).astype(np.int64)
                np.add.at(block.reshape(-1), held, unpacked(times, np.int64))
            if before:
                yield out(*before)

        return run

    parts, groups = sums.select("stripe", F.col("chunk").alias("part"), "cells", "times"), 2
    n = parts.groupBy("stripe").count().agg(F.max("count")).first()[0] or 0
    while groups > 1:
        groups = max(1, -(-n // FAN_IN))
        dealt = parts.withColumn("part", F.pmod(F.xxhash64("part"), F.lit(groups).cast("long"))).repartition("stripe", "part").sortWithinPartitions("stripe", "part")
        parts, n = dealt.mapInArrow(adder(groups == 1), "stripe int, part long, cells binary, times binary"), groups
    return parts.select("stripe", "cells", "times")


def _scored(pairs: DataFrame, counted: DataFrame, n_chunks: int, n_a: int, n_b: int, stripes: int) -> DataFrame:
    """chunk, place, n_best, count_sum. Pairs go where the counts of their stripe are: a stripe's chunks are dealt out to as many
    tasks as it takes, each of which has the counts, sorted before the chunks."""
    deals = max(1, -(-n_chunks // SCORED_CHUNKS))
    deal = F.pmod(F.xxhash64("chunk"), F.lit(deals).cast("long"))
    first = counted.select("stripe", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(deals - 1).cast("long"))).alias("deal"), F.lit(-1).cast("long").alias("chunk"), F.lit(None).cast("binary").alias("docs"), "cells", "times")
    dealt = first.unionByName(pairs.select("stripe", deal.alias("deal"), "chunk", "docs", "cells", "times")).repartition("stripe", "deal").sortWithinPartitions("stripe", "deal", "chunk")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = None
        for new, (stripe, _), (chunk, docs, cells, times) in _units(batches, 2):
            if new:
                block = np.zeros(-(-(n_a - stripe) // stripes) * n_b, np.int64)
            held = unpacked(cells, np.uint32)
            if docs is None:
                block[held] = unpacked(times, np.int64)
                continue
            counts, times, docs = block[held], unpacked(times, np.uint32).astype(np.int64), np.cumsum(unpacked(docs, np.uint32))
            first = np.flatnonzero(np.diff(docs, prepend=-1))
            found = [docs[first].astype(np.uint32), np.add.reduceat(times * (counts & 1), first).astype(np.uint32), np.add.reduceat(times * (counts >> 1), first)]
            yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), *(pa.array([packed(x)], pa.binary()) for x in found)], ["chunk", "docs", "best", "sums"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, best, total, there = (), None, None, None

        def out() -> pa.RecordBatch:
            places = np.flatnonzero(there)
            return pa.RecordBatch.from_arrays([pa.array([before[0]] * len(places), pa.int64()), pa.array(places, pa.int32()), pa.array(best[places], pa.int64()), pa.array(total[places], pa.int64())], ["chunk", "place", "n_best", "count_sum"])

        for new, unit, (docs, more, sums) in _units(batches, 1):
            if new:
                if before:
                    yield out()
                before, best, total, there = unit, np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64), np.zeros(1 << 16, bool)
            held = unpacked(docs, np.uint32)
            best[held] += unpacked(more, np.uint32)
            total[held] += unpacked(sums, np.int64)
            there[held] = True
        if before:
            yield out()

    by_chunk = dealt.mapInArrow(score, "chunk long, docs binary, best binary, sums binary").repartition("chunk").sortWithinPartitions("chunk")
    return by_chunk.mapInArrow(gather, "chunk long, place int, n_best long, count_sum long")


def _sizes(path_a: str, path_b: str) -> tuple[int, int]:
    return len(ByteVocabulary(path_a).bytes), len(PieceVocabulary(path_b).bytes)


def align(docs: DataFrame, path_a: str, path_b: str, stripes: int = STRIPES) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every row of docs (doc_id, text).

    A text is read by a byte-level vocabulary (path_a), behind a blank, and by one of pieces (path_b). Offsets where
    tokens of both end cut them into groups; a link is a pair of occurrences whose bytes overlap. The count of a pair of
    ids is the number of documents that hold it linked; n_best are the links whose count is the highest of their first
    id, ties included, and count_sum adds up the counts of all links.

    Pairs are dealt by first id into stripes, whose counts are dense blocks, and scored where the counts are. Null and
    empty texts, and texts that the tokens of either vocabulary don't spell, have zeros and an empty groups_sha256. Every
    row is a document of its own, whatever its doc_id, which passes as it is. Other columns aren't read. An empty
    table gives no rows.
    """
    spark = docs.sparkSession
    n_a, n_b = _sizes(path_a, path_b)
    linked = cut(_linked(docs, path_a, path_b, stripes), "alignment")
    pairs, sums = linked.where("kind = 'pairs'"), linked.where("kind = 'sums'")
    counted = cut(_counted(sums, n_a, n_b, stripes), "alignment-counts")
    n_chunks = pairs.select("chunk").distinct().count()
    scored = cut(_scored(pairs, counted, n_chunks, n_a, n_b, stripes), "alignment-scores")
    forget(spark, counted)
    rows = linked.where("kind = 'doc'").select("doc_id", "chunk", "place", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
    zero = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("n_best", "count_sum")]
    return rows.join(scored, ["chunk", "place"], "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", *zero, "groups_sha256")


def pair_counts(docs: DataFrame, path_a: str, path_b: str, stripes: int = STRIPES) -> DataFrame:
    """a, b, documents, best: every pair of ids that is linked anywhere, how many documents hold it, and whether no other
    b has more for that a. The same counts as align() scores by."""
    n_a, n_b = _sizes(path_a, path_b)
    counted = _counted(cut(_linked(docs, path_a, path_b, stripes), "alignment").where("kind = 'sums'"), n_a, n_b, stripes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for stripe, cells, times in zip(*(c.to_pylist() for c in batch.columns)):
                row, b = np.divmod(unpacked(cells, np.uint32).astype(np.int64), n_b)
                counts = unpacked(times, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(row * stripes + stripe, pa.int32()), pa.array(b, pa.int32()), pa.array(counts >> 1, pa.int64()), pa.array(counts & 1 == 1, pa.bool_())], ["a", "b", "documents", "best"])

    return counted.mapInArrow(run, "a int, b int, documents long, best boolean")


def token_groups(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """doc_id and groups: the groups themselves, as text `a1,a2|b1;a3|b2,b3`; empty where align() finds no tokens."""
    small_batches(docs.sparkSession, 500)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(path_a, path_b)
        for batch in batches:
            found = [groups for _, groups, *_ in aligner.texts(batch.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.string())], ["doc_id", "groups"])

    return docs.select("doc_id", "text").mapInArrow(run, T.StructType([docs.schema["doc_id"], T.StructField("groups", T.StringType())]))
