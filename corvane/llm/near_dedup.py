"""Near-duplicate documents by MinHash bands, verified by Odd sketches and on full sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.components import connected_components
from corvane.llm.shared import cut, forget, mix, one_row_each, restored, with_row_ids, word_hashes

BANDS, ROWS = 48, 6
SKETCH_BITS = 512


def shingles(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of `width` words, A-Z lower-cased; of all words if they are fewer."""
    words = word_hashes((text or "").encode().lower().split())
    if not len(words):
        return words
    width = min(width, len(words))
    out = np.full(len(words) - width + 1, width, np.uint64)
    for i in range(width):
        out = mix(out * np.uint64(0xD6E8FEB86659FD93) + words[i : len(words) - width + 1 + i])
    return np.unique(out)


def _permutations(seed: int, bands: int, rows: int) -> tuple[np.ndarray, np.ndarray]:
    draws = np.random.default_rng(seed).integers(0, 1 << 32, (2, bands * rows), np.uint32)
    return draws[0] | np.uint32(1), draws[1]


def signature(items: np.ndarray, multiply: np.ndarray, add: np.ndarray) -> np.ndarray:
    """The least of x * a + b modulo 2 ** 32 over the items, for each of the permutations."""
    low = np.full(len(multiply), 0xFFFFFFFF, np.uint32)
    short = (items >> np.uint64(32)).astype(np.uint32)
    for i in range(0, len(short), 2048):  # blocks that stay in the cache
        part = short[i : i + 2048]
        np.minimum(low, (multiply[:, None] * part[None, :] + add[:, None]).min(axis=1), out=low)
    return low


def odd_sketch(minima: np.ndarray, bits: int) -> np.ndarray:
    """A bitmap with the parity of the samples that fall on each bit; common samples cancel in the XOR of two."""
    numbered = mix(minima.astype(np.uint64) | (np.arange(len(minima), dtype=np.uint64) << np.uint64(32)))
    parity = np.bincount((numbered % np.uint64(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(parity.astype(np.uint8)).view(np.int64)


def signatures(docs: DataFrame, width: int, bands: int, rows: int, bits: int, seed: int) -> DataFrame:
    """Per document: n (set size), f_1 and f_2 (fingerprint of the set), keys (of bands), sketch."""
    multiply, add = _permutations(seed, bands, rows)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        numbers = np.arange(1, bands + 1, dtype=np.uint64)
        for batch in batches:
            out = []
            for doc_id, text in zip(batch.doc_id, batch.text):
                items = shingles(text, width)
                prints = int(items.sum(dtype=np.uint64)), int(mix(items ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64))
                if len(items):
                    minima = signature(items, multiply, add)
                    keys = numbers
                    for column in minima.reshape(bands, rows).T:
                        keys = mix(keys * np.uint64(0xD6E8FEB86659FD93) + column)
                    keys, sketch = keys.view(np.int64), odd_sketch(minima, bits)
                else:
                    keys = sketch = np.empty(0, np.int64)
                out.append((doc_id, len(items), *np.array(prints, np.uint64).view(np.int64), keys, sketch))
            yield pd.DataFrame(out, columns=["doc_id", "n", "f_1", "f_2", "keys", "sketch"])

    return docs.mapInPandas(run, "doc_id long, n long, f_1 long, f_2 long, keys array<long>, sketch array<long>")


def _sets(docs: DataFrame, named: DataFrame, width: int) -> DataFrame:
    """doc_id and items (shingle set) of the documents that are named."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch.doc_id, "items": [shingles(t, width).view(np.int64) for t in batch.text]})

    # merged at every size: which texts are needed is known to no task beforehand
    return cut(docs.join(named.hint("merge"), "doc_id", "left_semi").mapInPandas(run, "doc_id long, items array<long>"), "near-sets")


def _verified(pairs: DataFrame, sigs: DataFrame, docs: DataFrame, width: int, percent: int, samples: int, bits: int) -> DataFrame:
    """Those of pairs(a, b) whose sets have 100 * intersection >= percent * union."""
    side = lambda x: sigs.select(F.col("doc_id").alias(x), F.col("n").alias(f"n_{x}"), F.col("sketch").alias(f"s_{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    both = both.where(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
    # odd bits of the XOR, and from them the share of samples that agree; the margin is over five standard deviations
    odd = F.aggregate(F.zip_with("s_a", "s_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda t, x: t + x)
    share = F.lit(1.0) + bits / (4.0 * samples) * F.log(F.greatest(F.lit(1e-9), 1.0 - 2.0 * odd / bits))
    likely = cut(both.where(share >= percent / 100 - 0.25).select("a", "b", "n_a", "n_b"), "near-likely")
    named = likely.select(F.col("a").alias("doc_id")).unionByName(likely.select(F.col("b").alias("doc_id"))).distinct()
    whole = _sets(docs, named, width)
    joined = likely.join(whole.select(F.col("doc_id").alias("b"), F.col("items").alias("i_b")), "b").join(whole.select(F.col("doc_id").alias("a"), F.col("items").alias("i_a")), "a")
    common = F.size(F.array_intersect("i_a", "i_b"))
    links = cut(joined.where(100 * common >= percent * (F.col("n_a") + F.col("n_b") - common)).select("a", "b"), "near-links")
    forget(docs.sparkSession, likely, whole)
    return links


def _prefix_pairs(docs: DataFrame, residue: DataFrame, width: int, percent: int) -> DataFrame:
    """Pairs (a, b) of documents in different components that can be linked, by the prefix filter; it leaves out no link.

    residue: doc_id, component. Two sets that have `need` shingles in common, of n in one of them, have one among the
    first n - need + 1 of it too, in any order that holds for all. The order is by the number of documents, rare ones
    first, and ahead of all come the shingles that only one component has: they can be in no pair. Near copies that
    are too far apart for a link differ in such shingles, fill their prefixes with them and meet nobody, however many
    they are. The join keeps rows only if both places are inside the prefixes for these very two sizes.
    """
    sets = _sets(docs, residue, width)
    rows = sets.join(residue, "doc_id").select("doc_id", "component", F.size("items").alias("n"), F.explode("items").alias("item"))
    common = rows.groupBy("item").agg(F.count("*").alias("df"), F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("item", "df")
    ordered = rows.join(common, "item").groupBy("doc_id", "component", "n").agg(F.array_sort(F.collect_list(F.struct("df", "item"))).alias("items"))
    own = F.col("n") - F.size("items")
    longest = F.floor(F.col("n") * (100 - percent) / 100).cast("int") + 1
    first = F.posexplode(F.slice("items", F.lit(1), F.greatest(F.lit(0), longest - own)))
    prefix = ordered.select("doc_id", "component", "n", own.alias("own"), first.alias("at", "i")).select("doc_id", "component", "n", (F.col("own") + F.col("at")).alias("at"), F.col("i.item").alias("item"))
    prefix = cut(prefix, "near-prefixes")
    x, y = (prefix.select("item", F.col("doc_id").alias(s), *(F.col(c).alias(f"{c}_{s}") for c in ("component", "n", "at"))) for s in "xy")
    need = F.ceil(percent * (F.col("n_x") + F.col("n_y")) / (100 + percent) - 1e-9)
    larger = (F.col("n_x") > F.col("n_y")) | (F.col("n_x") == F.col("n_y")) & (F.col("x") < F.col("y"))
    inside = (F.col("at_x") <= F.col("n_x") - need) & (F.col("at_y") <= F.col("n_y") - need)
    meets = (x.item == y.item) & larger & (F.col("component_x") != F.col("component_y")) & (100 * F.col("n_y") >= percent * F.col("n_x")) & inside
    pairs = cut(x.join(y, meets).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "near-across")
    forget(docs.sparkSession, sets, prefix)
    return pairs


def _ends(labelled: DataFrame) -> DataFrame:
    """Rows (key, doc_id, component) of buckets whose documents are in several components, with the least and greatest of these."""
    ends = [f(F.struct("component", "doc_id")).alias(x) for f, x in ((F.min, "low"), (F.max, "high"))]
    several = labelled.groupBy("key").agg(*ends).where("low.component < high.component")
    return cut(labelled.join(several, "key"), "near-buckets")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS, bits: int = SKETCH_BITS, seed: int = 1, rounds: int = 2) -> DataFrame:
    """doc_id, n_shingles, component_id (least doc_id reachable by links) and kept, one row for each document.

    Documents are linked if the Jaccard similarity of their word shingle sets is percent / 100 or more. Equal sets
    are one class by fingerprint, and only its least doc_id goes on. MinHash bands propose pairs: with the defaults a
    pair at the threshold shares no band one time in two million. The samples, folded into Odd sketches, throw out
    unlikely pairs, and the full sets confirm the rest.

    In a band's bucket nobody is compared with everybody. In each of a few rounds a document is compared with two
    documents of other components at most, the least and the greatest that its buckets offer, and links join
    components; only buckets that still hold several components go on. Documents left in such buckets are put
    together by the prefix filter over their full sets, so that no pair that could join two components is left out.

    A document without words (null, empty) has an empty set and no links. Rows without doc_id are left out; of rows
    that share one the one with the least text counts. Other columns are ignored.
    """
    spark = docs.sparkSession
    docs = one_row_each(docs, "text")
    sigs = cut(signatures(docs, width, bands, rows, bits, seed), "near-signatures")
    sizes, filled = cut(sigs.select("doc_id", "n"), "near-sizes"), sigs.where("n > 0")
    # classes of several documents are written first: a class of any size can then be split in the join
    twice = cut(filled.groupBy("f_1", "f_2", "n").agg(F.min("doc_id").alias("rep"), F.count("*").alias("size")).where("size > 1").drop("size"), "near-classes")
    copies = cut(filled.select("doc_id", "f_1", "f_2", "n").join(twice, ["f_1", "f_2", "n"]).where("doc_id <> rep").select("doc_id", "rep"), "near-copies")
    reps = cut(filled.join(copies.select("doc_id"), "doc_id", "left_anti").select("doc_id", "n", "keys", "sketch"), "near-reps")
    forget(spark, sigs, twice)

    buckets = _ends(reps.select(F.explode("keys").alias("key"), "doc_id", F.col("doc_id").alias("component")))
    links = tried = cut(spark.createDataFrame([], "a long, b long"), "near-pairs")
    for _ in range(rounds):
        offers = F.array(*(F.when(F.col(f"{x}.component") != F.col("component"), F.col(f"{x}.doc_id")) for x in ("low", "high")))
        pairs = buckets.select("doc_id", F.explode(F.array_compact(offers)).alias("other")).groupBy("doc_id").agg(F.min("other").alias("x"), F.max("other").alias("y"))
        pairs = pairs.select("doc_id", F.explode(F.array("x", "y")).alias("other")).select(F.least("doc_id", "other").alias("a"), F.greatest("doc_id", "other").alias("b")).distinct()
        pairs = cut(pairs, "near-pairs")
        tried = tried.unionByName(pairs)
        links = links.unionByName(_verified(pairs, reps, docs, width, percent, bands * rows, bits))
        label = connected_components(links, "near-components").withColumnsRenamed({"node": "doc_id", "component": "_found"})
        before = buckets
        buckets = _ends(before.select("key", "doc_id").join(label, "doc_id", "left").select("key", "doc_id", F.coalesce("_found", "doc_id").alias("component")))
        forget(spark, before)

    residue = cut(buckets.select("doc_id", "component").distinct(), "near-residue")
    across = _prefix_pairs(docs, residue, width, percent).join(tried, ["a", "b"], "left_anti")
    links = links.unionByName(_verified(across, reps, docs, width, percent, bands * rows, bits))
    groups = connected_components(links, "near-components")
    found = copies.unionByName(groups.select(F.col("node").alias("doc_id"), F.col("node").alias("rep"))).join(groups, F.col("rep") == F.col("node"), "left")
    found = found.select("doc_id", F.coalesce("component", "rep").alias("component"))
    out = sizes.join(found, "doc_id", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.col("doc_id") == F.col("component_id"))


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """docs with one document of each group of near-duplicates, the one with the least doc_id, and all its columns.

    Rows without doc_id and rows that share one are documents of their own; see with_row_ids.
    """
    rows = with_row_ids(docs)
    out = near_duplicates(rows.select(F.col("row").alias("doc_id"), F.col("own_text").alias("text")), **options)
    gone = out.where("not kept").select(F.col("doc_id").alias("row"))
    return restored(rows.join(gone, "row", "left_anti"), docs.columns)
