"""Language identification by compression."""

from __future__ import annotations

import re

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvane.llm.shared import with_computed

UNKNOWN = "und"
NOT_LETTERS = re.compile(r"[\W\d_]+")
AGAIN = re.compile(r"\b(\w+)(?: \1\b)+")
#: The first so many bytes of a text are encoded again from each of its first words on: sums tell more than the size of one
#: short frame, and of a short text there are no others.
AGAIN_BYTES, STARTS = 512, 8


def letters_of(text: str | None) -> str:
    """Lower-cased words of letters with one blank between, a word that follows itself only once; empty without a letter."""
    words = AGAIN.sub(r"\1", NOT_LETTERS.sub(" ", (text or "").lower())).strip()
    return words if any(map(str.isalpha, words)) else ""


def parts_of(raw: bytes, block: int) -> list[bytes]:
    """What is encoded of a text, whatever its length: all its blocks, and its first bytes from the second word on, from the third, and so on."""
    words = raw[:AGAIN_BYTES].split(b" ")
    return [raw[i : i + block] for i in range(0, len(raw), block)] + [b" ".join(words[i:]) for i in range(1, min(STARTS, len(words)))]


def learn(docs: DataFrame, rows: int = 250, chars: int = 2000) -> dict[str, bytes]:
    """A raw-content dictionary for each language: the letters of a sample of its documents (doc_id, text, lang).

    The sample is bounded: of each language the `rows` documents whose ids have the least hashes, and of each of them
    `chars` characters in a row from a place that the hash of its id picks, anywhere in the text. Ids are drawn without
    reading texts. Null languages, texts and ids don't take part.
    """
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    drawn = docs.where("lang is not null and doc_id is not null").select("doc_id", "lang").withColumn("n", F.row_number().over(order)).where(F.col("n") <= rows)
    ids = docs.sparkSession.createDataFrame([(r.doc_id,) for r in drawn.select("doc_id").collect()], "doc_id long")
    texts = docs.join(F.broadcast(ids.distinct()), "doc_id").where("lang is not null and text is not null")
    begin = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.greatest(F.char_length("text") - chars, F.lit(0)) + 1).cast("int") + 1
    sample: dict[str, list[str]] = {}
    for r in sorted(texts.select("lang", F.substring("text", begin, F.lit(chars)).alias("text"), "doc_id").collect(), key=lambda r: (r.lang, r.doc_id)):
        sample.setdefault(r.lang, []).append(letters_of(r.text))
    return {lang: "\n".join(parts).encode() for lang, parts in sample.items() if any(parts)}


def classify(docs: DataFrame, dictionaries: dict[str, bytes], level: int = 3, block: int = 4096, margin: float = 0.002) -> DataFrame:
    """docs with lang_pred, score and accepted.

    Each text's letters are encoded with every language's dictionary, in blocks so that the dictionary counts for all
    of a long text, and the language with the fewest bytes wins; ties go to the smaller name. The margin is the share
    of bytes that the best saves over the second; score is 0.5 without a margin and nears 1 as it grows. A document is
    accepted if its margin is `margin` or more.

    Null texts and those without a letter are `und`, score 0, not accepted; with no dictionary at all everything is.
    With one language there is no second and the margin is 1. Columns named like the new ones are replaced.
    """
    names = sorted(dictionaries)
    shared = docs.sparkSession.sparkContext.broadcast(dictionaries)

    def start():
        encoders = []
        for name in names:
            held = zstandard.ZstdCompressionDict(shared.value[name], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            held.precompute_compress(level=level)
            encoders.append(zstandard.ZstdCompressor(level=level, dict_data=held, write_content_size=False, write_checksum=False, write_dict_id=False).compress)

        def one(text: str | None) -> tuple[str, float, bool]:
            raw = letters_of(text).encode()
            if not raw or not encoders:
                return UNKNOWN, 0.0, False
            parts = parts_of(raw, block)
            sizes = sorted((sum(len(encode(p)) for p in parts), name) for encode, name in zip(encoders, names))
            saved = 1 - sizes[0][0] / sizes[1][0] if len(sizes) > 1 else 1.0
            return sizes[0][1], 0.5 + 0.5 * saved / (saved + 0.05), saved >= margin

        return lambda texts: zip(*map(one, texts)) if texts else ([], [], [])

    added = {"lang_pred": ("string", pa.string()), "score": ("double", pa.float64()), "accepted": ("boolean", pa.bool_())}
    return with_computed(docs.drop(*added), ["text"], added, start)
