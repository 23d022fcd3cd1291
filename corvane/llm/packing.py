"""Best-fit packing of token sequences with a grouping genetic algorithm on islands."""

from __future__ import annotations

import array
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.shared import cut, with_row_ids

CAPACITY = 4096
END_ID = 1
#: Pieces of a shard, islands that evolve packings of the same shard, individuals of an island and generations of an
#: epoch, generations without a bin less after which it ends, and the emptiest bins that a crossover dissolves at most.
SHARD, ISLANDS, POPULATION, GENERATIONS, PATIENCE, DISSOLVED = 8192, 2, 8, 80, 32, 6
SEQUENCES_A_SHARD = 1 << 24

# What the vocabulary's own pre-tokenizer splits on, for lower-cased text in Latin letters; see encoder().
PLAIN = re.compile(r"[!-~À-ÖØ-öø-įı-ſ]+")
PART = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ſ]+|[0-9]|[^a-z0-9ß-öø-ſ]+")
CONTROL_SPACES = re.compile("[\x1c-\x1f]")
#: Words whose ids a worker keeps; about 80 MB.
KEPT_WORDS = 400_000


def _byte_letters() -> dict[int, str]:
    """The printable letter that a byte-level vocabulary has for each byte: its own where printable, else from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(others)}


#: The splitting rules of a vocabulary file for which words may be encoded apart (fixed values of the file).
APART = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}


class _Encoder:
    """Ids of a text, as little-endian unsigned 32-bit bytes, from those of its words, each encoded once.

    A vocabulary with other splitting rules than APART encodes each text as a whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:  # a vocabulary lies at the same place on every machine
            rules = json.load(file)
        self.apart = rules.get("normalizer") == APART["normalizer"] and (rules.get("pre_tokenizer") or {}).get("pretokenizers") == APART["pretokenizers"]
        self.tokenizer, letters = Tokenizer.from_file(path), _byte_letters()
        model = self.tokenizer.model.tokenize
        plain, parts, ids = PLAIN.fullmatch, PART.findall, self._ids

        def tokens(part: str) -> bytes:
            return array.array("I", [t.id for t in model(part)]).tobytes()

        class Parts(dict):
            def __missing__(self, part: str) -> bytes:
                self[part] = out = tokens(part if part.isascii() else part.encode().decode("latin-1").translate(letters))
                return out

        held = Parts()

        class Words(dict):
            def __missing__(self, word: str) -> bytes:
                if len(self) > KEPT_WORDS:
                    self.clear(), held.clear()
                if word.isascii() and word.isalpha():  # one part
                    low = word.lower()
                    out = tokens(word) if low == word else self[low]
                elif plain(word) and "<|" not in word:
                    out = b"".join([self[p] if p.isascii() and p.isalpha() else held[p] for p in parts(word.lower())])
                else:
                    out = ids(word)
                self[word] = out
                return out

        self.words, self.held = Words(), held

    def forget(self) -> None:
        """Lets go of the words that have been kept: a worker goes on to other stages, which need its memory."""
        self.words.clear(), self.held.clear()

    def _ids(self, text: str) -> bytes:
        return array.array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def __call__(self, text: str) -> bytes:
        if not self.apart or CONTROL_SPACES.search(text):  # str.split() takes these for blanks, the tokenizer doesn't
            return self._ids(text)
        return b"".join(map(self.words.__getitem__, text.split()))


_encoders: dict[str, _Encoder] = {}


def encoder(path: str) -> _Encoder:
    """Built once in each Python worker."""
    if path not in _encoders:
        _encoders[path] = _Encoder(path)
    return _encoders[path]


def tokenized_pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """doc_id, name, piece, start, length, ids_crc32 (and ids) for docs (doc_id, name, text): each document's ids and END_ID, cut only if over capacity."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(vocabulary)
        for batch in batches:
            rows = []
            for doc_id, name, text in zip(batch.doc_id, batch.name, batch.text):
                ids = encode(text or "") + END_ID.to_bytes(4, "little")
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    row = (doc_id, name, piece, at // 4, len(part) // 4, zlib.crc32(part))
                    rows.append((*row, np.frombuffer(part, "<u4").astype(np.int32)) if with_ids else row)
            yield pd.DataFrame(rows, columns=["doc_id", "name", "piece", "start", "length", "ids_crc32", *(["ids"] * with_ids)])
        encoder(vocabulary).forget()

    schema = "doc_id long, name string, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return docs.select("doc_id", F.col("name").cast("string"), "text").mapInPandas(run, schema)


def insert(order: np.ndarray, lengths: np.ndarray, bins: np.ndarray, rooms: list[int], capacity: int) -> None:
    """Best fit: puts the items, in the given order, each into the fullest bin that has room for it, or a new one."""
    by_room: dict[int, list[int]] = {}
    there = 0  # bit r is set if some bin has exactly r left
    for b, room in enumerate(rooms):
        if room:
            by_room.setdefault(room, []).append(b)
            there |= 1 << room
    for i in order.tolist():
        length = int(lengths[i])
        fits = there >> length
        if fits:
            room = length + (fits & -fits).bit_length() - 1
            held = by_room[room]
            b = held.pop()
            if not held:
                there ^= 1 << room
        else:
            b, room = len(rooms), capacity
            rooms.append(room)
        bins[i] = b
        rooms[b] = left = room - length
        if left:
            by_room.setdefault(left, []).append(b)
            there |= 1 << left


def fitness(lengths: np.ndarray, bins: np.ndarray) -> tuple[int, float]:
    """Fewer bins first; of equals the one with more in few bins and so more room in one piece. Less is better."""
    fill = np.bincount(bins, lengths)
    return len(fill), -float((fill**2).sum())


def best_fit(lengths: np.ndarray, order: np.ndarray, capacity: int) -> np.ndarray:
    bins = np.empty(len(lengths), np.int64)
    insert(order, lengths, bins, [], capacity)
    return bins


def crossover(one: np.ndarray, other: np.ndarray, lengths: np.ndarray, capacity: int, rng: np.random.Generator) -> np.ndarray:
    """Injects whole well-filled bins of `other` into `one`.

    Bins of `one` that share items with them go, so that no item is there twice, and so do a few of its emptiest ones;
    what those held beside is put back by best fit, longest first.
    """
    fill = np.bincount(other, lengths)
    well = np.argsort(-fill, kind="stable")[: max(1, len(fill) // 2)]
    taken = rng.choice(well, max(1, len(well) // 4), replace=False)
    injected = np.isin(other, taken)
    gone = np.zeros(one.max() + 1, bool)
    gone[one[injected]] = True
    gone[np.argsort(np.bincount(one, lengths), kind="stable")[: rng.integers(1, DISSOLVED + 1)]] = True
    loose = np.flatnonzero(gone[one] & ~injected)
    child = np.empty_like(one)
    stays = ~gone[one] & ~injected
    _, child[stays] = np.unique(one[stays], return_inverse=True)
    n = child[stays].max() + 1 if stays.any() else 0
    _, child[injected] = np.unique(other[injected], return_inverse=True)
    child[injected] += n
    placed = stays | injected
    rooms = (capacity - np.bincount(child[placed], lengths[placed])).astype(np.int64).tolist()
    insert(loose[np.argsort(-lengths[loose], kind="stable")], lengths, child, rooms, capacity)
    return child


def evolve(lengths: np.ndarray, arrived: list[np.ndarray], capacity: int, seed: int) -> tuple[np.ndarray, int]:
    """The fittest packing, and the number of generations that it took.

    Arrived packings and others by best fit in random orders, with no regard for length, make the first generation.
    In each a child of two of them replaces the least fit; the fittest stays. It ends early when there are as few bins as
    the total length allows, or when the fittest has had no bin less for PATIENCE generations.
    """
    rng, least = np.random.default_rng(seed), -(-int(lengths.sum()) // capacity)
    people = [*arrived, *(best_fit(lengths, rng.permutation(len(lengths)), capacity) for _ in range(POPULATION - len(arrived)))]
    ranked = sorted(((fitness(lengths, p), i, p) for i, p in enumerate(people)), key=lambda x: x[:2])
    generation = since = 0
    while generation < GENERATIONS and since < PATIENCE and ranked[0][0][0] > least:
        generation += 1
        fewest = ranked[0][0][0]
        a, b = sorted(rng.choice(len(ranked), 2, replace=False).tolist())
        child = crossover(ranked[a][2], ranked[b][2], lengths, capacity, rng)
        ranked = sorted([*ranked[:-1], (fitness(lengths, child), POPULATION + generation, child)], key=lambda x: x[:2])
        since = since + 1 if ranked[0][0][0] == fewest else 0
    return ranked[0][2], generation


PACKED = "doc_id long, piece int, length long, shard long, island int, bin long, n_bins long, fit double, generations int"


def _island(capacity: int):
    """Evolves a shard's packing on one island, from the packings that have come to it, if any."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["origin", "doc_id", "piece"], kind="stable")
        origins = pdf.origin.to_numpy()
        own = pdf[origins == origins[0]].reset_index(drop=True)
        lengths = own.length.to_numpy(np.int64)
        started = [pdf.bin.to_numpy(np.int64)[origins == o] for o in np.unique(origins) if o >= 0]
        shard, island = int(own.shard[0]), int(own.island[0])
        bins, generations = evolve(lengths, started, capacity, shard * 64 + island * 8 + len(started))
        n_bins, fit = fitness(lengths, bins)
        return own[["doc_id", "piece", "length", "shard", "island"]].assign(bin=bins, n_bins=n_bins, fit=fit, generations=generations)

    return run


def assign(pieces: DataFrame, capacity: int = CAPACITY, shard: int = SHARD, islands: int = ISLANDS, epochs: int = 2) -> DataFrame:
    """doc_id, piece, sequence_id and offset for pieces (doc_id, piece, length; length from 1 to capacity).

    Pieces are dealt by hash into shards of about `shard` rows. Each shard is packed on several islands, each a
    grouping genetic algorithm; after an epoch every island's elite moves to the next island too, and the fittest
    packing of all islands is taken. Sequences never reach over two shards, so at most one of each isn't full for
    want of pieces.
    """
    n = max(1, -(-pieces.count() // shard))
    number = F.pmod(F.xxhash64("doc_id", "piece"), F.lit(n))
    dealt = pieces.select("doc_id", "piece", "length", number.alias("shard"), F.lit(-1).alias("origin"), F.lit(-1).cast("long").alias("bin"))
    people = dealt.withColumn("island", F.explode(F.array(*map(F.lit, range(islands)))))
    for epoch in range(epochs):
        elite = cut(people.groupBy("shard", "island").applyInPandas(_island(capacity), PACKED), f"pack-{epoch}")
        moves = F.explode(F.array(F.col("island"), F.pmod(F.col("island") + 1, F.lit(islands))))
        people = elite.select("doc_id", "piece", "length", "shard", F.col("island").alias("origin"), "bin", moves.alias("island"))
    best = elite.groupBy("shard").agg(F.min(F.struct("n_bins", "fit", "island")).alias("b")).select("shard", F.col("b.island").alias("island"))

    def laid_out(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["bin", "length", "doc_id", "piece"], ascending=[True, False, True, True], kind="stable")
        before = pdf.groupby("bin").length.cumsum() - pdf.length
        return pd.DataFrame({"doc_id": pdf.doc_id, "piece": pdf.piece, "sequence_id": pdf.shard * SEQUENCES_A_SHARD + pdf.bin, "offset": before})

    chosen = elite.join(best, ["shard", "island"]).select("doc_id", "piece", "length", "shard", "bin")
    return chosen.groupBy("shard").applyInPandas(laid_out, "doc_id long, piece int, sequence_id long, offset long")


def pack(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids), sequence_id, offset: documents packed into few sequences.

    A document is its token ids and END_ID; null and empty texts are END_ID alone. Only documents over `capacity` are
    cut. Each piece lies in one sequence; pieces of a sequence lie end to end from 0. Rows without doc_id and rows
    that share one are documents of their own (see with_row_ids), and their pieces carry the doc_id that they have.
    An empty table gives an empty result. Other columns are ignored.
    """
    rows = with_row_ids(docs)
    pieces = cut(tokenized_pieces(rows.select(F.col("row").alias("doc_id"), F.col("own_doc_id").alias("name"), F.col("own_text").alias("text")), vocabulary, capacity, with_ids), "pack-pieces")
    placed = pieces.join(assign(pieces, capacity), ["doc_id", "piece"])
    return placed.withColumn("doc_id", F.col("name").cast(docs.schema["doc_id"].dataType)).drop("name")
