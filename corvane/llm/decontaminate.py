"""Benchmark decontamination with one Aho-Corasick automaton."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.shared import with_computed

#: Bytes of UTF-8 as normalised: digits, a to z and all above x7F stay, A to Z are lower-cased, the rest parts words.
NORMAL = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
#: Bytes of windows that one automaton may hold; a larger benchmark is scanned for in several.
AUTOMATON_BYTES = 32 << 20

_built: dict[str, ahocorasick.Automaton] = {}


def normalise(text: str | None) -> tuple[bytes, bytes]:
    """The text's bytes with all else than words blank, and its words with one blank around each."""
    blanked = (text or "").encode().translate(NORMAL)
    words = blanked.split()
    return blanked, b" " + b" ".join(words) + b" " if words else b""


def windows(benchmark: DataFrame, width: int) -> DataFrame:
    """item_id and window: each `width` consecutive words of an item, with blanks around; all words if they are fewer."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for item, text in zip(batch.item_id, batch.text):
                words = normalise(text)[1].split()
                for i in range(max(1, len(words) - width + 1) if words else 0):
                    rows.append((item, b" " + b" ".join(words[i : i + width]) + b" "))
            yield pd.DataFrame(rows, columns=["item_id", "window"])

    return benchmark.select("item_id", "text").where("item_id is not null").mapInPandas(run, "item_id long, window binary").distinct()


def automaton(name: str, block: Broadcast) -> ahocorasick.Automaton:
    """The automaton of a block of windows, built once in each Python worker."""
    if name not in _built:
        _built.clear()  # a worker holds one, of whatever query it works for
        items: dict[bytes, list[int]] = {}
        for item, window in block.value:
            items.setdefault(window, []).append(item)
        built = ahocorasick.Automaton()
        for window, ids in items.items():
            built.add_word(window.decode("latin-1"), (window.count(b" ") - 1, ids))
        built.make_automaton()
        _built[name] = built
    return _built[name]


def find_passages(docs: DataFrame, benchmark: DataFrame, width: int = 10, automaton_bytes: int = AUTOMATON_BYTES) -> DataFrame:
    """docs with n_words, n_hit, items (sorted ids) and spans: where a document has a window of a benchmark item.

    Windows are `width` consecutive words of an item. All of them go into one Aho-Corasick automaton over normalised
    text, which reads each document once; its matches are mapped to words and to code points of the original text
    (spans: merged runs of hit words, as start and end). A benchmark whose windows exceed `automaton_bytes` is dealt
    into as many automata as it takes, so that what is sent to executors stays bounded.

    Null or empty texts have no words; items without words have no windows; rows of the benchmark without item_id are
    left out, items that share an id count as one. Columns of docs named like the new ones are replaced.
    """
    found = windows(benchmark, width)
    total = found.agg(F.sum(F.length("window"))).first()[0] or 0
    blocks = max(1, -(-total // automaton_bytes))
    zero = {"n_words": F.lit(0).cast("long"), "items": F.array().cast("array<long>"), "hits": F.array().cast("array<long>")}
    held = [next(x for x in (f"{c}_{'_' * i}" for i in range(99)) if x not in docs.columns) for c in ("items", "hits")]  # names that docs doesn't have
    out = docs.drop("n_hit", "spans", *zero).withColumns({held[0]: zero["items"], held[1]: zero["hits"]})
    for i in range(blocks):
        # a window's block is its own hash, so all items that share it are there, and blocks are about even
        part = [(r.item_id, bytes(r.window)) for r in found.where(F.pmod(F.xxhash64("window"), F.lit(blocks)) == i).collect()]
        added = {"n_words": ("long", pa.int64()), "items": LONGS, "hits": LONGS}
        out = with_computed(out, ["text", *held], added, _scanner(uuid.uuid4().hex, docs.sparkSession.sparkContext.broadcast(part)))
        if i < blocks - 1:
            out = out.drop("n_words", *held).withColumnsRenamed({"items": held[0], "hits": held[1]})
    added = {"n_hit": ("long", pa.int64()), "spans": ("array<struct<start:int,end:int>>", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))}
    return with_computed(out.drop(*held), ["text", "n_words", "hits"], added, lambda: _summary).drop("hits")


LONGS = ("array<long>", pa.list_(pa.int64()))


def _scanner(name: str, block: Broadcast):
    """Adds to hits, as pairs in one list, the first word and the one after the last of each match."""

    def start():
        search = automaton(name, block)

        def one(text: str | None, items: list[int], hits: list[int]) -> tuple[int, list[int], list[int]]:
            line = normalise(text)[1]
            matches = list(search.iter(line.decode("latin-1"))) if line and len(search) else []
            if matches:
                blanks = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
                ends = np.searchsorted(blanks, [m[0] for m in matches])
                sizes = np.array([m[1][0] for m in matches])
                hits = hits + np.stack([ends - sizes, ends], 1).ravel().tolist()
                items = sorted({*items, *(x for m in matches for x in m[1][1])})
            return max(0, line.count(b" ") - 1), items, hits

        return lambda *columns: zip(*map(one, *columns)) if columns[0] else ([], [], [])

    return start


def _summary(texts: list[str | None], words: list[int], all_hits: list[list[int]]):
    n_hit, spans = [], []
    for text, n, hits in zip(texts, words, all_hits):
        if not hits:
            n_hit.append(0)
            spans.append([])
            continue
        change = np.zeros(n + 1, np.int64)
        np.add.at(change, hits[::2], 1)
        np.add.at(change, hits[1::2], -1)
        hit = (np.cumsum(change[:-1]) > 0).astype(np.int8)
        n_hit.append(int(hit.sum()))
        raw = text.encode()
        there = (np.frombuffer(raw.translate(NORMAL), np.uint8) != 32).astype(np.int8)
        edges = np.flatnonzero(np.diff(there, prepend=0, append=0))
        turns = np.flatnonzero(np.diff(hit, prepend=0, append=0))
        chars = np.concatenate([[0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)])
        first, last = chars[edges[::2][turns[::2]]], chars[edges[1::2][turns[1::2] - 1]]
        spans.append([{"start": a, "end": b} for a, b in zip(first.tolist(), last.tolist())])
    return n_hit, spans


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, width: int = 10) -> DataFrame:
    """docs, in their own columns, without those that have a window of a benchmark item."""
    tagged = docs.select(*(F.col(c).alias(c if c == "text" else f"_own_{c}") for c in docs.columns))
    return find_passages(tagged, benchmark, width).where("n_hit = 0").select(*(F.col(c if c == "text" else f"_own_{c}").alias(c) for c in docs.columns))


def items_digest(ids) -> str:
    return hashlib.sha256(",".join(sorted(map(str, ids))).encode()).hexdigest()
