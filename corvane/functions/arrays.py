"""Functions of numeric arrays: waveforms and embeddings."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.sources.sums import prefix_sums
from corvane.sources.tables import save

TINY = 1e-12
SAMPLE_RATE = 16000
#: Fixed limits of quality control: they aim at broken audio, not at hard audio.
QC_LIMITS = {
    "min_duration": 0.30, "max_duration": 30.0, "max_clipping_ratio": 0.01, "max_silence_ratio": 0.85, "min_rms": 1e-4, "max_rms": 0.99,
    "max_leading_silence": 2.0, "max_trailing_silence": 2.0, "silence_threshold_db": -45.0,
}


def doubles(array: Column) -> Column:
    return F.transform(array, lambda x: x.cast("double"))


def total(array: Column) -> Column:
    return F.aggregate(array, F.lit(0.0), lambda t, x: t + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity in double; 0 if a norm is next to nothing."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms > TINY, dot(a, b) / norms).otherwise(F.lit(0.0))


def rms(signal: Column) -> Column:
    return F.when(F.size(signal) > 0, F.sqrt(dot(signal, signal) / F.size(signal))).otherwise(F.lit(0.0))


def gain(signal: Column, db: float) -> Column:
    return F.transform(signal, lambda x: x.cast("double") * (10.0 ** (db / 20.0)))


def scale_to_snr(signal: Column, noise: Column, snr_db: Column) -> Column:
    """The noise, scaled so that the signal stands snr_db above it."""
    factor = (rms(signal) + TINY) / (rms(noise) + TINY) / F.pow(F.lit(10.0), snr_db / 20.0)
    return F.transform(noise, lambda x: x.cast("double") * factor)


def guard_clipping(signal: Column, ceiling: float = 0.99) -> Column:
    """Scaled down as a whole if its peak is above the ceiling."""
    peak = F.array_max(F.transform(signal, lambda x: F.abs(x.cast("double"))))
    return F.when(peak > ceiling, F.transform(signal, lambda x: x.cast("double") * (F.lit(ceiling) / peak))).otherwise(doubles(signal))


def mu_law(signal: Column, levels: int = 256) -> Column:
    """Through a mu-law codec and back, scaled to its peak meanwhile."""
    mu = float(levels - 1)
    values = doubles(signal)
    peak = F.array_max(F.transform(values, F.abs))
    peak = F.when(peak > 0, peak).otherwise(F.lit(1.0))
    coded = lambda x: F.signum(x) * F.log1p(mu * F.abs(x)) / math.log1p(mu)
    steps = F.transform(values, lambda x: F.rint((coded(x / peak) + 1) / 2 * mu) / mu * 2 - 1)
    return F.transform(steps, lambda x: F.signum(x) * (F.pow(F.lit(1 + mu), F.abs(x)) - 1) / mu * peak)


def fit_length(signal: Column, length: int, start: Column | None = None) -> Column:
    """Cropped from `start` (0 if none) or repeated, to exactly `length` samples."""
    start = F.lit(0) if start is None else start
    times = F.ceil(F.lit(length) / F.greatest(F.size(signal), F.lit(1))).cast("int")
    return F.when(F.size(signal) >= length, F.slice(signal, start + 1, F.lit(length))).otherwise(F.slice(F.flatten(F.array_repeat(signal, times)), 1, length))


def frame_energies(signal: Column, frame: int = 400, hop: int = 160) -> Column:
    """Mean squares of frames that start every `hop` samples and lie wholly inside."""
    last = F.size(signal) - frame
    starts = F.when(last >= 0, F.sequence(F.lit(1), last + 1, F.lit(hop))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: total(F.transform(F.slice(signal, i, F.lit(frame)), lambda x: x.cast("double") * x.cast("double"))) / frame)


def measure(signal: Column, rate: int = SAMPLE_RATE, clip_at: float = 0.999) -> Column:
    """n_samples, duration, peak, rms, clipping_ratio, n_nonfinite, is_all_zero; non-finite samples count as 0."""
    values = F.coalesce(doubles(signal), F.array().cast("array<double>"))
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    clean = F.transform(values, lambda x: F.when(bad(x), F.lit(0.0)).otherwise(x))
    n = F.size(values)
    share = lambda k: F.when(n > 0, k / n).otherwise(F.lit(0.0))
    return F.struct(
        n.alias("n_samples"), (n / rate).alias("duration"), F.coalesce(F.array_max(F.transform(clean, F.abs)), F.lit(0.0)).alias("peak"), rms(clean).alias("rms"),
        share(F.size(F.filter(clean, lambda x: F.abs(x) >= clip_at))).alias("clipping_ratio"), F.size(F.filter(values, bad)).alias("n_nonfinite"), ((n > 0) & F.forall(clean, lambda x: x == 0)).alias("is_all_zero"),
    )


def silence(signal: np.ndarray, rate: int = SAMPLE_RATE, threshold_db: float = QC_LIMITS["silence_threshold_db"]) -> np.ndarray:
    """Which samples are silent: the mean absolute value of 20 ms around them, edges repeated, is below the threshold."""
    window = max(1, int(0.02 * SAMPLE_RATE))
    padded = np.pad(np.abs(signal), (window // 2, window // 2), mode="edge")
    sums = np.concatenate([[0.0], np.cumsum(padded)])
    return (sums[window : window + len(signal)] - sums[: len(signal)]) / window < 10.0 ** (threshold_db / 20.0)


@F.pandas_udf(T.StructType([T.StructField(c, T.DoubleType()) for c in ("silence_ratio", "leading_silence", "trailing_silence")]))
def silence_stats(signals: pd.Series) -> pd.DataFrame:
    rows = []
    for s in signals:
        s = np.nan_to_num(np.asarray([] if s is None else s, np.float64), nan=0.0, posinf=0.0, neginf=0.0)
        mask = silence(s) if len(s) else np.empty(0, bool)
        loud = np.flatnonzero(~mask)
        lead, trail = (loud[0], len(s) - 1 - loud[-1]) if len(loud) else (len(s), len(s))
        rows.append((float(mask.mean()) if len(s) else 1.0, lead / SAMPLE_RATE, trail / SAMPLE_RATE))
    return pd.DataFrame(rows, columns=["silence_ratio", "leading_silence", "trailing_silence"])


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def trim_silence(signals: pd.Series) -> pd.Series:
    """Without silence at both ends, but for 0.15 s; a wholly silent signal stays as it is."""

    def trimmed(s):
        s = np.asarray(s, np.float64)
        loud = np.flatnonzero(~silence(s)) if len(s) else []
        if not len(loud):
            return s
        margin = int(0.15 * SAMPLE_RATE)
        return s[max(0, loud[0] - margin) : loud[-1] + 1 + margin]

    return signals.map(lambda s: None if s is None else trimmed(s))


def pitches(signal: np.ndarray, low: float = 60.0, high: float = 400.0, rate: int = SAMPLE_RATE, frame: int = 2048, dip: float = 0.1) -> np.ndarray:
    """The pitch of each frame in Hz, by the YIN method; frames lie a quarter of their length apart, around every hop of the signal.

    The squared difference between half a frame and the half that lies a lag later comes from energies and one
    transform of all frames; it is divided by its mean over all smaller lags. The period is the first dip below `dip`, or
    without one the lowest value, moved to the top of the parabola through its neighbours.
    """
    half = frame // 2
    shortest, longest = max(1, int(rate // high)), min(math.ceil(rate / low), frame - half - 1)
    padded = np.pad(np.asarray(signal, np.float64), half)
    frames = np.lib.stride_tricks.sliding_window_view(padded, frame)[:: frame // 4]
    size = 1 << (frame + half - 1).bit_length()
    products = np.fft.irfft(np.fft.rfft(frames, size) * np.conj(np.fft.rfft(frames[:, :half], size)), size)[:, : longest + 1]
    sums = np.concatenate([np.zeros((len(frames), 1)), np.cumsum(frames**2, axis=1)], axis=1)
    energy = sums[:, half : half + longest + 1] - sums[:, : longest + 1]
    difference = np.maximum(energy[:, :1] + energy - 2 * products, 0.0)
    difference[difference < 1e-6] = 0.0
    mean = np.cumsum(difference[:, 1:], axis=1) / np.arange(1, longest + 1)
    shape = difference[:, shortest : longest + 1] / (mean[:, shortest - 1 :] + np.finfo(np.float64).tiny)
    before, after = shape[:, :-2], shape[:, 2:]
    lowest = np.zeros(shape.shape, bool)
    lowest[:, 1:-1] = (shape[:, 1:-1] < before) & (shape[:, 1:-1] <= after)
    lowest[:, 0] = shape[:, 0] < shape[:, 1]
    dips = lowest & (shape < dip)
    at = np.where(dips.any(axis=1), dips.argmax(axis=1), shape.argmin(axis=1))
    bend, slope = before + after - 2 * shape[:, 1:-1], (after - before) / 2
    shift = np.zeros(shape.shape)
    np.divide(-slope, bend, out=shift[:, 1:-1], where=np.abs(slope) < np.abs(bend))
    return rate / (shortest + at + shift[np.arange(len(at)), at])


@F.pandas_udf(T.DoubleType())
def median_pitch(signals: pd.Series) -> pd.Series:
    """The median of the pitches of a signal's frames that lie between 60 and 400 Hz; null without one, or without a signal."""

    def one(s) -> float | None:
        if s is None or not len(s):
            return None
        found = pitches(s)
        voiced = found[(found > 60.0) & (found < 400.0)]
        return float(np.median(voiced)) if len(voiced) else None

    return signals.map(one).astype("Float64")


def qc_reasons(stats: dict[str, Column], limits: dict[str, float] | None = None) -> Column:
    """Why a waveform fails, as an array; empty if it passes. stats: columns by the names of measure() and silence_stats."""
    limits = QC_LIMITS | (limits or {})
    rules = [F.when(stats["n_samples"] == 0, F.lit("empty audio")), F.when(stats["n_nonfinite"] > 0, F.lit("non-finite samples")), F.when(stats["is_all_zero"], F.lit("all-zero waveform"))]
    for what in ("duration", "clipping_ratio", "silence_ratio", "rms", "leading_silence", "trailing_silence"):
        if what not in stats:
            continue
        name = what.replace("_", " ")
        if f"min_{what}" in limits:
            rules.append(F.when(stats[what] < limits[f"min_{what}"], F.lit(f"{name} below {limits[f'min_{what}']:g}")))
        if f"max_{what}" in limits:
            rules.append(F.when(stats[what] > limits[f"max_{what}"], F.lit(f"{name} above {limits[f'max_{what}']:g}")))
    return F.array_compact(F.array(*rules))


def label_mask(ids: Column, supervised: Column, ignore: int = -100) -> Column:
    """ids with all but the last `supervised` ones that aren't padding (null) replaced by `ignore`."""
    kept = F.size(F.filter(ids, lambda x: x.isNotNull()))
    lead = F.size(ids) - F.size(F.filter(ids, lambda x: x.isNotNull()))
    end = F.when(F.element_at(ids, -1).isNull(), kept).otherwise(kept + lead)
    return F.transform(ids, lambda x, i: F.when((i < end) & (i >= end - supervised) & x.isNotNull(), x).otherwise(F.lit(ignore)))


def _dots(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Of rows of x and y, added up one after another as dot() does, so that every bit is the same."""
    out = np.zeros(len(x))
    for i in range(x.shape[1]):
        out += x[:, i] * y[:, i]
    return out


def _units(v: np.ndarray) -> np.ndarray:
    """Rows over their lengths; zero rows stay, and those of a length that is no number become NaN."""
    length = np.sqrt((v * v).sum(axis=1))[:, None]
    return np.where(length == 0, 0.0, np.where(np.isfinite(length), v, np.nan) / np.where(length > 0, length, 1.0))


def near_queries(queries: DataFrame, rows: DataFrame, least: float, query_rows: int = 4096, block_rows: int = 16384) -> DataFrame:
    """query_id, vec_id, cosine of queries and rows (vec_id, embedding) with other ids, `least` (above 0) or more; as cosine() gives it.

    Blocks of queries meet blocks of rows. A product of matrices proposes pairs, whose cosines are then made as cosine() does.
    Vectors that are null or hold a null, and pairs of different lengths, have no cosine above 0.
    """

    def packed(keys: tuple, batch: pd.DataFrame) -> pd.DataFrame:
        v = np.stack(batch.v.to_list()).astype(np.float64)
        return pd.DataFrame([(keys[0], keys[1], batch.id.to_numpy(np.int64).tobytes(), v.tobytes())], columns=["wide", "block", "ids", "vectors"])

    def blocks(side: DataFrame, most: int, fewest: int) -> DataFrame:
        known = side.where("vec_id is not null and size(embedding) > 0").where(~F.exists("embedding", lambda x: x.isNull()))
        n = max(fewest, -(-side.count() // most))
        dealt = known.select(F.col("vec_id").alias("id"), doubles(F.col("embedding")).alias("v"), F.size("embedding").alias("wide"), F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int").alias("block"))
        return save(dealt.groupBy("wide", "block").applyInPandas(packed, "wide int, block int, ids binary, vectors binary"), "packed")

    left = blocks(queries, query_rows, 1).select("wide", F.col("ids").alias("query_ids"), F.col("vectors").alias("queries"))
    right = blocks(rows, block_rows, 16)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with np.errstate(all="ignore"):
            for batch in batches:
                for r in batch.itertuples(index=False):
                    ids, query_ids = np.frombuffer(r.ids, np.int64), np.frombuffer(r.query_ids, np.int64)
                    x, q = (np.frombuffer(b, np.float64).reshape(-1, r.wide) for b in (r.vectors, r.queries))
                    unit = _units(q).T.copy()
                    for at in range(0, len(x), 1024):
                        part = x[at : at + 1024]
                        i, j = np.nonzero(~(_units(part) @ unit < least - 1e-9))  # NaN is above all numbers, as it is for Spark
                        for first in range(0, len(i), 1 << 18):
                            a, b = part[i[first : first + (1 << 18)]], q[j[first : first + (1 << 18)]]
                            norms = np.sqrt(_dots(b, b)) * np.sqrt(_dots(a, a))
                            cosines = np.where(norms <= TINY, 0.0, _dots(b, a) / norms)
                            out = pd.DataFrame({"query_id": query_ids[j[first : first + (1 << 18)]], "vec_id": ids[at + i[first : first + (1 << 18)]], "cosine": cosines})
                            yield out[~(cosines < least) & (out.query_id != out.vec_id)]

    met = right.join(left, "wide").repartition("wide", "block", F.xxhash64("query_ids"))
    # pandas hands NaN over as null; no cosine here is null
    return met.mapInPandas(run, "query_id long, vec_id long, cosine double").withColumn("cosine", F.coalesce("cosine", F.lit(float("nan"))))


#: Rows of a block of vectors, blocks of a group, and vectors that blocks are gathered around.
BLOCK_ROWS, GROUP_BLOCKS, PIVOTS = 2048, 1024, 32


def _blocks(units: DataFrame, rows: int) -> DataFrame:
    """block, label, n, center, radius, vectors (float64 bytes): at most `rows` unit vectors of one label that are near each other.

    Each vector goes to the nearest of a few, and stands there in the order of its nearness; blocks are cut off by place
    in the order of all, so that neither a label nor a neighbourhood, however large, is a task or a block of its own.
    """
    few = np.array([r.v for r in units.orderBy(F.xxhash64("id"), "v").limit(PIVOTS).collect()])  # bounded

    def nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            near = np.stack(batch.v.to_list()) @ few.T
            yield batch.assign(pivot=near.argmax(axis=1).astype("int32"), nearness=near.max(axis=1))

    placed = prefix_sums(units.mapInPandas(nearest, "id string, label string, v array<double>, pivot int, nearness double").withColumn("one", F.lit(1).cast("long")), "one", ["label", "pivot", "nearness", "id"])

    def gathered(keys: tuple, batch: pd.DataFrame) -> pd.DataFrame:
        v = np.stack(batch.v.to_list())
        center = v.sum(axis=0)
        center = center / np.linalg.norm(center) if np.linalg.norm(center) > TINY else v[0]
        radius = float(np.arccos(np.clip((v @ center).min(), -1, 1)))
        return pd.DataFrame([(keys[0], keys[1], len(v), center, radius, v.tobytes())], columns=["label", "pivot", "n", "center", "radius", "vectors"])

    cut = placed.withColumn("part", F.floor(F.col("before") / rows)).groupBy("label", "pivot", "part")
    made = cut.applyInPandas(gathered, "label string, pivot int, n long, center array<double>, radius double, vectors binary")
    return save(save(made, "blocks").withColumn("block", F.monotonically_increasing_id()), "numbered-blocks")


def _pairs_of_blocks(metas: DataFrame, most: int | None) -> DataFrame:
    """a, b, label, within, bound of pairs of blocks: no pair of vectors within their label lies below, or between labels above, the bound.

    metas: block, label, n, center, radius, and what is known of the label: least (of pairs within) and greatest (between). With
    `most` only the pairs with the most telling bounds of each label come back, that many; else all that could still
    beat what is known. Groups of blocks meet groups of blocks, so that no block is a key of its own.
    """
    n = metas.count()
    groups = max(1, -(-n // GROUP_BLOCKS))
    grouped = metas.withColumn("group", F.pmod(F.xxhash64("block"), F.lit(groups)).cast("int"))
    sides = [grouped.withColumn("l", F.col("group")).withColumn("r", F.explode(F.sequence(F.col("group"), F.lit(groups - 1)))), grouped.withColumn("r", F.col("group")).withColumn("l", F.explode(F.sequence(F.lit(0), F.col("group")))).toDF(*grouped.columns, "r", "l")]

    def bounded(keys: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        columns = ["a", "b", "label", "within", "bound"]
        if not len(left) or not len(right):
            return pd.DataFrame(columns=columns)
        angle = np.arccos(np.clip(np.stack(left.center.to_list()) @ np.stack(right.center.to_list()).T, -1, 1))
        reach = left.radius.to_numpy()[:, None] + right.radius.to_numpy()[None, :] + 1e-7
        a, b = left.block.to_numpy()[:, None], right.block.to_numpy()[None, :]
        same = left.label.to_numpy()[:, None] == right.label.to_numpy()[None, :]
        once = (a <= b) if keys[0] == keys[1] else np.ones(same.shape, bool)
        lone = (a == b) & (left.n.to_numpy()[:, None] < 2)
        low, high = np.cos(np.minimum(np.pi, angle + reach)), np.cos(np.maximum(0, angle - reach))
        inside, outside = once & same & ~lone, once & ~same
        parts = []
        for side, other in ((left, False), (right, True)):
            known = lambda c: side[c].fillna(np.inf if c == "least" else -np.inf).to_numpy()  # noqa: B023, E731
            wide = (lambda x: x[None, :]) if other else (lambda x: x[:, None])
            for want, bound, within in ((inside & (low < wide(known("least"))), low, True), (outside & (high > wide(known("greatest"))), high, False)):
                if within and other:
                    continue
                i, j = np.nonzero(want)
                labels = side.label.to_numpy()[j if other else i]
                part = pd.DataFrame({"a": a[i, 0], "b": b[0, j], "label": labels, "within": within, "bound": bound[i, j]})
                if most:
                    part = part.sort_values("bound", ascending=within).groupby("label").head(most)
                parts.append(part)
        return pd.concat(parts)[columns]

    found = sides[0].groupBy("l", "r").cogroup(sides[1].groupBy("l", "r")).applyInPandas(bounded, "a long, b long, label string, within boolean, bound double")
    if not most:
        return found.select("a", "b").distinct()
    best = F.min(F.struct(F.when(F.col("within"), F.col("bound")).otherwise(-F.col("bound")).alias("by"), "a", "b")).alias("p")
    return found.groupBy("label", "within").agg(best).select("p.a", "p.b").distinct()


#: Groups of blocks that meet, and the bytes of vectors above which there are more of them.
MEETING_GROUPS, MEETING_BYTES = 16, 32 << 20


def _compared(pairs: DataFrame, blocks: DataFrame) -> DataFrame:
    """label, least, greatest over all vectors of the given pairs of blocks.

    Groups of blocks meet: a block goes once to each pair of groups that has a pair of it, however many pairs that are. So
    vectors are sent as often as there are groups, a fixed number until a group would be too large for a task.
    """
    size = blocks.agg(F.sum(F.length("vectors"))).first()[0] or 0
    groups = max(MEETING_GROUPS, -(-size // MEETING_BYTES))
    group = lambda c: F.pmod(F.xxhash64(c), F.lit(groups)).cast("int")
    placed = pairs.select("a", "b", F.least(group("a"), group("b")).alias("l"), F.greatest(group("a"), group("b")).alias("r"))
    wanted = placed.select("l", "r", F.explode(F.array("a", "b")).alias("block")).distinct()
    sent = wanted.join(blocks.select("block", "label", F.size("center").alias("wide"), "vectors"), "block")

    def run(batch: pd.DataFrame) -> pd.DataFrame:
        here = batch[batch.a.isna()]
        held = {r.block: (r.label, np.frombuffer(r.vectors, np.float64).reshape(-1, int(r.wide))) for r in here.itertuples(index=False)}
        met = batch[batch.a.notna()]
        least, greatest = {}, {}
        for i, j in zip(met.a.astype("int64"), met.b.astype("int64")):
            (label, x), (other, y) = held[i], held[j]
            cosines = x @ y.T
            if label == other:
                cosines = cosines[np.triu_indices(len(x), 1)] if i == j else cosines
                if cosines.size:
                    least[label] = min(least.get(label, np.inf), float(cosines.min()))
            else:
                most = float(cosines.max())
                for one in (label, other):
                    greatest[one] = max(greatest.get(one, -np.inf), most)
        out = [(label, least.get(label), greatest.get(label)) for label in least | greatest]
        return pd.DataFrame(out, columns=["label", "least", "greatest"]).astype({"least": "Float64", "greatest": "Float64"})

    met = sent.unionByName(placed, allowMissingColumns=True).groupBy("l", "r").applyInPandas(run, "label string, least double, greatest double")
    return met.groupBy("label").agg(F.min("least").alias("least"), F.max("greatest").alias("greatest"))


def extremes(units: DataFrame, rows: int = BLOCK_ROWS) -> tuple[DataFrame, int, int]:
    """label, min_within, max_between of unit vectors (id, label, v); pairs of blocks that were compared, and that there are.

    Blocks have a center and a radius. For each label the pair of blocks that promises most is compared first; then
    only those whose angles and radii leave room for a lower or higher cosine than that.
    """
    blocks = _blocks(units, rows)
    metas = blocks.drop("vectors", "pivot")
    unknown = [F.lit(None).cast("double").alias(c) for c in ("least", "greatest")]
    seeds = save(_pairs_of_blocks(metas.select("*", *unknown), 1), "seeds")
    first = save(_compared(seeds, blocks), "first")
    rest = save(_pairs_of_blocks(metas.join(first, "label", "left"), None), "rest")
    last = first.unionByName(_compared(rest, blocks)).groupBy("label").agg(F.min("least").alias("min_within"), F.max("greatest").alias("max_between"))
    n = blocks.count()
    return last, seeds.unionByName(rest).distinct().count(), n * (n + 1) // 2


def separability(rows: DataFrame, key: str, label: str, vector: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """label (null: overall), n, mean_within, min_within, mean_between, max_between, separability (within less between).

    Means over pairs come from sums of unit vectors. The least and greatest come from blocks of vectors, of which only those
    are compared that could hold them. Zero vectors and rows without a label or with a null in their vector don't count; a
    label with one row has no pairs within.
    """
    length = F.sqrt(dot(F.col("v"), F.col("v")))
    known = rows.where(F.col(label).isNotNull()).select(F.col(key).cast("string").alias("id"), F.col(label).cast("string").alias("label"), doubles(F.col(vector)).alias("v")).withColumn("length", length)
    over = F.transform(F.array("length"), lambda n: F.transform("v", lambda x: F.try_divide(x, n)))  # the length is taken once, not for each value
    units = save(known.where("length > 0").select("id", "label", over[0].alias("v")), "units")
    sums = units.select("label", F.posexplode("v").alias("i", "x")).groupBy("label", "i").agg(F.sum("x").alias("d"), F.count("*").alias("n"))
    own = sums.groupBy("label").agg(F.max("n").alias("n"), F.sum(F.col("d") * F.col("d")).alias("q"))
    whole = sums.groupBy("i").agg(F.sum("d").alias("d")).agg(F.sum(F.col("d") * F.col("d")).alias("t"))
    none = F.lit(None).cast("double")
    if units.limit(1).count():
        ends, _, _ = extremes(units, block_rows)
        joined = own.join(ends, "label", "left")
    else:
        joined = own.withColumns({"min_within": none, "max_between": none})
    pairs = lambda n: F.when(n > 0, n)
    total = joined.agg(F.sum("n").alias("n"), F.sum("q").alias("q"), F.sum(F.col("n") * (F.col("n") - 1)).alias("w"), F.sum(F.col("n") * F.col("n")).alias("s"), F.min("min_within").alias("min_within"), F.max("max_between").alias("max_between"))
    total = total.withColumn("at", F.lit(1)).join(whole.withColumn("at", F.lit(1)), "at")  # one row and one row
    overall = total.select(F.lit(None).cast("string").alias("label"), "n", F.try_divide(F.col("q") - F.col("n"), pairs(F.col("w"))).alias("mean_within"), "min_within", F.try_divide(F.col("t") - F.col("q"), pairs(F.col("n") * F.col("n") - F.col("s"))).alias("mean_between"), "max_between")
    labels = joined.select("label", "n", F.try_divide(F.col("q") - F.col("n"), pairs(F.col("n") * (F.col("n") - 1))).alias("mean_within"), "min_within", none.alias("mean_between"), "max_between")
    return overall.unionByName(labels).withColumn("separability", F.col("mean_within") - F.col("mean_between"))
