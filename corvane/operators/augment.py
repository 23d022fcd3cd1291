"""Waveform augmentation with a random stream for each utterance, and the boundary to external models."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.functions.arrays import SAMPLE_RATE
from corvane.sources.sums import prefix_sums
from corvane.sources.tables import save

# Shares of conditions and ranges of what they draw.
CONDITION_WEIGHTS = {"clean": 0.40, "noise": 0.18, "reverb": 0.06, "noise_reverb": 0.06, "competing_speech": 0.15, "codec": 0.15}
SNR_DB, SIR_DB, GAIN_DB, RT60_S = (5.0, 20.0), (6.0, 15.0), (-6.0, 6.0), (0.15, 0.7)


def uniform_of(key: Column, seed: int) -> Column:
    """A number from 0 to 1 that depends on the seed and the key alone: the first 13 hex digits of a SHA-256."""
    return F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}::"), key.cast("string")), 256), 1, 13), 16, 10).cast("double") / float(1 << 52)


def plan_conditions(rows: DataFrame, key: str, seed: int = 42, weights: dict[str, float] | None = None) -> DataFrame:
    """rows with a condition drawn by weight for each key, the same wherever and in whatever order it is drawn."""
    weights = weights or CONDITION_WEIGHTS
    u, upto, chosen = F.col("_u"), 0.0, None
    for name, weight in weights.items():
        upto += weight / sum(weights.values())
        chosen = F.when(u < upto, name) if chosen is None else chosen.when(u < upto, name)
    return rows.withColumn("_u", uniform_of(F.col(key), seed)).withColumn("condition", chosen.otherwise(list(weights)[-1])).drop("_u")


def stream(seed: int, key: str) -> np.random.Generator:
    return np.random.default_rng(int.from_bytes(hashlib.sha256(f"{seed}::{key}".encode()).digest()[:8], "little"))


def level(signal: np.ndarray) -> float:
    return float(np.sqrt(np.mean(np.square(signal)))) if len(signal) else 0.0


def pink_noise(n: int, rng: np.random.Generator, slope: float = 1.0) -> np.ndarray:
    """Noise whose power falls as frequency to the power `slope`, scaled to a peak of 1."""
    bands = np.maximum(1.0, np.arange(n // 2 + 1)) ** (-slope / 2)
    made = np.fft.irfft(bands * np.exp(2j * np.pi * rng.random(len(bands))), n)
    return made / max(1e-12, np.abs(made).max())


def room(rng: np.random.Generator) -> tuple[np.ndarray, float]:
    """A decaying burst of noise with a direct path in its first milliseconds, of energy 1, and the time in which it falls by 60 dB."""
    rt60 = rng.uniform(*RT60_S)
    t = np.arange(int(SAMPLE_RATE * 1.5 * rt60)) / SAMPLE_RATE
    response = rng.standard_normal(len(t)) * 10.0 ** (-3.0 * t / rt60)
    response[int(SAMPLE_RATE * rng.uniform(0.001, 0.006))] += 1.0
    return response / np.linalg.norm(response), float(rt60)


def reverberate(signal: np.ndarray, response: np.ndarray) -> np.ndarray:
    size = 1 << (len(signal) + len(response)).bit_length()
    wet = np.fft.irfft(np.fft.rfft(signal, size) * np.fft.rfft(response, size), size)[: len(signal)]
    return wet * (level(signal) / level(wet)) if level(wet) > 1e-9 else wet


def mix(signal: np.ndarray, other: np.ndarray, db: float) -> np.ndarray:
    """signal and `other`, cropped or repeated to its length, `db` below it."""
    other = np.resize(other, len(signal))
    return signal + other * ((level(signal) + 1e-12) / (level(other) + 1e-12) / 10.0 ** (db / 20))


def telephone(signal: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, int]:
    """Down to a telephone's rate and back, linearly; and the rate."""
    rate = int(rng.choice([8000, 11025, 12000]))
    n = max(1, int(len(signal) * rate / SAMPLE_RATE))
    down = np.interp(np.linspace(0, len(signal) - 1, n), np.arange(len(signal)), signal)
    return np.interp(np.linspace(0, n - 1, len(signal)), np.arange(n), down), rate


def companded(signal: np.ndarray, bits: int, mu: float = 255.0) -> np.ndarray:
    """There and back through the mu-law of telephony, quantized to so many bits."""
    peak = np.abs(signal).max(initial=0.0) or 1.0
    small = signal / peak
    steps = 2**bits - 1
    shrunk = np.rint((np.sign(small) * np.log1p(mu * np.abs(small)) / np.log1p(mu) + 1) / 2 * steps) / steps * 2 - 1
    return np.sign(shrunk) * np.expm1(np.abs(shrunk) * np.log1p(mu)) / mu * peak


#: What a rendered row tells besides its signal. A source is "corpus", with the file's path, or "synthetic".
METADATA = (
    "condition string, snr double, sir double, augmentation_seed long, gain_db double, noise_source struct<source:string,path:string,color:string>, rir_source struct<source:string,path:string,rt60_seconds:double>,"
    " codec string, resample_rate int, competing_utt_id string, competing_speaker_id string, input_rms double, clipping_rescaled_from_peak double, competing_speech_unavailable boolean"
)
COLORS = {"white": 0.0, "pink": 1.0, "brown": 2.0}


def render(signal: np.ndarray, condition: str, rng: np.random.Generator, other: dict | None = None, noise: tuple[str, np.ndarray] | None = None, rir: tuple[str, np.ndarray] | None = None) -> tuple[np.ndarray, dict]:
    """The signal under a condition, and its metadata (METADATA without the seed).

    noise, rir: a file of the bank, path and samples, or None, and then the material is made up and said to be. other: an
    interferer with signal, utt_id and speaker_id; without one competing speech becomes noise and says so.
    """
    told: dict = {"condition": condition, "input_rms": round(level(signal), 6)}
    out = np.asarray(signal, np.float64)

    def noisy(x: np.ndarray) -> np.ndarray:
        db = rng.uniform(*SNR_DB)
        if noise is not None:
            path, samples = noise
            told["noise_source"] = {"source": "corpus", "path": path}
            made = np.roll(samples, -int(rng.integers(len(samples))))
        else:
            color = str(rng.choice(list(COLORS)))
            told["noise_source"] = {"source": "synthetic", "color": color}
            made = pink_noise(len(x), rng, COLORS[color])
        told["snr"] = round(float(db), 2)
        return mix(x, made, db)

    if condition in ("reverb", "noise_reverb"):
        if rir is not None:
            told["rir_source"] = {"source": "corpus", "path": rir[0]}
            out = reverberate(out, rir[1])
        else:
            response, rt60 = room(rng)
            told["rir_source"] = {"source": "synthetic", "rt60_seconds": round(rt60, 3)}
            out = reverberate(out, response)
    if condition in ("noise", "noise_reverb"):
        out = noisy(out)
    if condition == "competing_speech":
        if other is None or not len(other["signal"]):
            out = noisy(out)
            told |= {"condition": "noise", "competing_speech_unavailable": True}
        else:
            db = rng.uniform(*SIR_DB)
            out = mix(out, np.roll(other["signal"], -int(rng.integers(len(other["signal"])))), db)
            told |= {"sir": round(float(db), 2), "competing_utt_id": other.get("utt_id"), "competing_speaker_id": other.get("speaker_id")}
    if condition == "codec":
        if rng.random() < 0.5:
            out = companded(out, int(rng.choice([8, 8, 6])))
            told["codec"] = "mu_law_g711"
        else:
            out, told["resample_rate"] = telephone(out, rng)
            told["codec"] = "resample_degrade"
    db = rng.uniform(*GAIN_DB)
    out = out * 10.0 ** (db / 20)
    told["gain_db"] = round(float(db), 2)
    peak = float(np.abs(out).max(initial=0.0))
    if peak > 0.99:
        out = out * (0.99 / peak)
        told["clipping_rescaled_from_peak"] = round(peak, 4)
    return out, told


def augment(rows: DataFrame, seed: int = 42) -> DataFrame:
    """utt_id, signal, the metadata and error for rows (utt_id, condition, signal, and where there are any interferer, other_id,
    other_speaker, noise_path, noise, rir_path, rir).

    Each row has its own random stream; a row that can't be rendered has an error instead of a signal.
    """
    optional = {"interferer": "array<double>", "other_id": "string", "other_speaker": "string", "noise_path": "string", "noise": "array<double>", "rir_path": "string", "rir": "array<double>"}
    rows = rows.withColumns({c: F.lit(None).cast(kind) for c, kind in optional.items() if c not in rows.columns})
    sources = {"noise_source": ("source", "path", "color"), "rir_source": ("source", "path", "rt60_seconds")}
    fields = [(f.name, f.dataType.simpleString()) for f in T.StructType.fromDDL(METADATA).fields]
    flat = [(n, kind) for n, kind in fields if n not in sources]
    flat += [(f"{n}_{part}", "double" if part == "rt60_seconds" else "string") for n, parts in sources.items() for part in parts]

    kinds = {"string": pa.string(), "double": pa.float64(), "bigint": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}
    schema = pa.schema([("utt_id", pa.string()), ("signal", pa.list_(pa.float64())), *((n, kinds[kind]) for n, kind in flat), ("error", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        array = lambda x: None if x is None else np.asarray(x, np.float64)
        file = lambda path, x: (path, array(x)) if x else None
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                told = {"condition": r["condition"]}
                made = error = None
                try:
                    other = {"signal": array(r["interferer"]), "utt_id": r["other_id"], "speaker_id": r["other_speaker"]} if r["interferer"] else None
                    made, told = render(array(r["signal"]), r["condition"], stream(seed, r["utt_id"]), other, file(r["noise_path"], r["noise"]), file(r["rir_path"], r["rir"]))
                    told |= {f"{n}_{part}": value for n in sources for part, value in told.pop(n, {}).items()}
                except (LookupError, ValueError, TypeError, IndexError) as e:
                    error = str(e)
                out.append({"utt_id": r["utt_id"], "signal": None if made is None else made.tolist(), "augmentation_seed": seed, "error": error, **told})
            yield pa.RecordBatch.from_pylist(out, schema)

    made = rows.select("utt_id", "condition", "signal", *optional).mapInArrow(run, f"utt_id string, signal array<double>, {', '.join(f'{n} {kind}' for n, kind in flat)}, error string")
    structs = {n: F.when(F.col(f"{n}_source").isNotNull(), F.struct(*(F.col(f"{n}_{part}").alias(part) for part in parts))) for n, parts in sources.items()}
    return made.select("utt_id", "signal", *(structs[n].alias(n) if n in structs else F.col(n) for n, _ in fields), "error")


def draw_files(rows: DataFrame, files: DataFrame, kind: str, seed: int = 42, cells: int = 1 << 12) -> DataFrame:
    """utt_id, path: for each row (utt_id) a file of a kind (files: kind, path, weight), drawn by its weight.

    Files cover ranges of the sums of their weights, in the order of paths, and a hash of seed and utt_id falls into one of them. The ranges are cut into cells, so that rows meet files by an equal cell and a condition instead
    of every file; no sum is made in one task and no file list is broadcast. Files without a weight above 0 aren't
    drawn; without any file, rows have no path and are left out.
    """
    # whole numbers, a millionth of a weight each: their sums leave no gaps and don't depend on any order
    bank = files.where(F.col("kind") == kind).where("weight > 0").select("path", F.greatest(F.lit(1), F.round(F.col("weight") * 1e6)).cast("long").alias("weight"))
    whole = bank.agg(F.sum("weight")).first()[0]
    if not whole:
        return rows.select("utt_id", F.lit(None).cast("string").alias("path")).limit(0)
    cell = lambda t: F.floor(t * (cells / whole)).cast("int")
    ranges = prefix_sums(bank, "weight", ["path"]).select("path", F.col("before").alias("low"), (F.col("before") + F.col("weight")).alias("high"))
    cut = ranges.select("path", "low", "high", F.explode(F.sequence(cell(F.col("low")), cell(F.col("high") - 1))).alias("cell"))
    asked = rows.select("utt_id", F.least(F.floor(uniform_of(F.concat(F.lit(f"{kind}::"), F.col("utt_id")), seed) * whole), F.lit(whole - 1)).cast("long").alias("t"))
    met = asked.withColumn("cell", cell(F.col("t"))).join(cut, "cell")
    return met.where((F.col("low") <= F.col("t")) & (F.col("t") < F.col("high"))).select("utt_id", "path")


def with_bank(rows: DataFrame, files: DataFrame, seed: int = 42) -> DataFrame:
    """rows (utt_id, condition, ...) with noise_path, noise, rir_path and rir from files (kind, path, weight, signal) where their condition takes them.

    Rows and recordings meet by path, so no audio is broadcast. Without files of a kind the columns are null, and
    augment() makes the material up and says so. Files without samples aren't drawn.
    """
    usable = files.where("signal is not null and size(signal) > 0")
    silent = F.col("competing") if "competing" in rows.columns else F.lit(True)
    for kind, wants in (("noise", F.col("condition").isin("noise", "noise_reverb") | (F.col("condition") == "competing_speech") & silent), ("rir", F.col("condition").isin("reverb", "noise_reverb"))):
        drawn = draw_files(rows.where(wants).select("utt_id"), usable.select("kind", "path", "weight"), kind, seed)
        sound = usable.where(F.col("kind") == kind).select(F.col("path").alias(f"{kind}_path"), F.col("signal").alias(kind))
        found = drawn.select("utt_id", F.col("path").alias(f"{kind}_path")).join(sound, f"{kind}_path")
        rows = rows.join(found, "utt_id", "left")
    return rows


def _far_pairs(pairs: DataFrame) -> list[tuple]:
    """A dozen of all (speaker, script) pairs at most, such that whoever has a fitting pair at all has one among them.

    Three pairs that share nothing are enough: a speaker and a script rule out two of them. If there aren't three, every
    pair holds one of the four ends of two, and of those with such an end two with unlike other ends are enough.
    """
    pick = lambda where: (pairs.where(where).agg(F.min(F.struct("order", "speaker", "script", "utt_id")).alias("p")).first() or [None])[0]
    value = lambda x: F.lit(x)
    found, apart = [], F.lit(True)
    for _ in range(3):
        p = pick(apart)
        if p is None:
            break
        found.append(p)
        apart = apart & ~F.col("speaker").eqNullSafe(value(p.speaker)) & (F.col("script") != value(p.script))
    if len(found) == 3:
        return found
    for p in list(found):
        for end, other in (("speaker", "script"), ("script", "speaker")):
            here = F.col(end).eqNullSafe(value(p[end]))
            one = pick(here)
            two = pick(here & ~F.col(other).eqNullSafe(value(one[other])))
            found += [x for x in (one, two) if x is not None]
    return list({p.utt_id: p for p in found}.values())


def interferers(rows: DataFrame, seed: int = 42, rounds: int = 8) -> DataFrame:
    """utt_id, other_id, other_speaker: for each utterance (utt_id, speaker_id, script_id) another of another speaker and script; null if there is none.

    All stand in one ring in hash order. In each round those that still have nobody look twice as far ahead as in the
    round before; a round is a join on places, and only the waiting go on. Whoever is left after the last round takes the
    first that fits of a dozen rows which are chosen so that nobody who could have one is left without (_far_pairs).
    A null script rules out nobody; a null speaker is a speaker like any other.
    """
    own = F.coalesce(F.concat(F.lit("s:"), "script_id"), F.concat(F.lit("u:"), "utt_id"))
    keyed = rows.select("utt_id", F.col("speaker_id").alias("speaker"), own.alias("script"), F.lit(1).cast("long").alias("one"), F.md5(F.concat(F.lit(f"{seed}|"), "utt_id")).alias("order"))
    ring = save(prefix_sums(keyed, "one", ["order", "utt_id"]).withColumnRenamed("before", "place").drop("one"), "ring")
    n = ring.count()
    fits = ~F.col("speaker").eqNullSafe(F.col("o_speaker")) & (F.col("script") != F.col("o_script"))
    done, waiting, step = [], ring, 1
    for _ in range(rounds):
        if step >= n:
            break
        other = ring.select(F.pmod(F.col("place") - step, F.lit(n)).alias("place"), F.col("utt_id").alias("o_utt"), F.col("speaker").alias("o_speaker"), F.col("script").alias("o_script"))
        tried = save(waiting.join(other, "place").withColumn("fits", fits), "ring-round")
        done.append(tried.where("fits").select("utt_id", F.col("o_utt").alias("other_id"), F.col("o_speaker").alias("other_speaker")))
        waiting, step = tried.where("not fits").select(*ring.columns), step * 2
        if not waiting.limit(1).count():
            break
    far = _far_pairs(ring) if n else []
    options = F.array(*(F.struct(F.lit(p.utt_id).cast("string").alias("utt"), F.lit(p.speaker).cast("string").alias("speaker"), F.lit(p.script).alias("script")) for p in far)) if far else F.expr("cast(array() as array<struct<utt:string,speaker:string,script:string>>)")
    chosen = F.get(F.filter(options, lambda o: ~o.speaker.eqNullSafe(F.col("speaker")) & (o.script != F.col("script"))), 0)
    out = waiting.select("utt_id", chosen.getField("utt").alias("other_id"), chosen.getField("speaker").alias("other_speaker"))
    for part in done:
        out = out.unionByName(part)
    return out


def transcribe(rows: DataFrame, recognise: Callable[[list[str]], list[str]], batch: int = 16) -> DataFrame:
    """utt_id, hypothesis: an external recogniser over audio paths, in batches; a batch that fails is tried row by row, and a row that fails is empty."""

    def one(path: str) -> str:
        try:
            return recognise([path])[0]
        except Exception:  # the recogniser's own trouble with this file
            return ""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            texts: list[str] = []
            for i in range(0, len(rows), batch):
                paths = rows.audio.iloc[i : i + batch].tolist()
                try:
                    texts += recognise(paths)
                except Exception:
                    texts += map(one, paths)
            yield pd.DataFrame({"utt_id": rows.utt_id, "hypothesis": texts})

    return rows.select("utt_id", "audio").mapInPandas(run, "utt_id string, hypothesis string")
