"""What the operators of this subpackage share: written intermediate tables, word splitting, hashing and winnowing."""

from __future__ import annotations

import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_own_dir: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster shares (spark.checkpoint.dir); a temporary one only in a local session that sets none, as in tests."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not re.match(r"local(\[|$)", spark.conf.get("spark.master", "local")):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _own_dir:
        _own_dir.append("file://" + tempfile.mkdtemp(prefix="corvane-"))
    return _own_dir[0]


def cut(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it back: lineage ends here and lost executors cost nothing."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(spark: SparkSession, *tables: DataFrame) -> None:
    """Deletes tables that cut() wrote once nothing will read them again."""
    root = shared_dir(spark)
    for table in tables:
        for folder in {f.rpartition("/")[0] for f in table.inputFiles()}:
            if folder.removeprefix("file:").lstrip("/").startswith(root.removeprefix("file:").lstrip("/")):
                path = spark._jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def held_out(doc_id: Column) -> Column:
    """Documents that no model may learn from: crc32 of the id as text, modulo 3, is 1."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Rows carry whole texts here: batches of a thousand keep Python workers small, whatever the session's default."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if now <= 0 or now > rows:
        spark.conf.set(key, str(rows))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_hashes(words: list[bytes]) -> np.ndarray:
    """A 64-bit hash for each word."""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of splitmix64: a bijection that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** n modulo 2 ** 64, kept for the next call."""
    if len(_powers.get(base, ())) <= n:
        grown = np.full(max(n + 1, 4096), base, np.uint64)
        grown[0] = 1
        _powers[base] = np.cumprod(grown, dtype=np.uint64)
        if n > 1 << 20:  # those of a very long text aren't kept
            return _powers.pop(base)
    return _powers[base]


def window_hashes(symbols: np.ndarray, width: int, base: int = 0xD1342543DE82EF95) -> np.ndarray:
    """A 64-bit hash of each run of width symbols: differences of prefix sums of symbol * base ** i, mixed."""
    n = len(symbols)
    if n < width:
        return np.empty(0, np.uint64)
    prefix = np.zeros(n + 1, np.uint64)
    np.cumsum(symbols * _power(base, n)[:n], out=prefix[1:])
    return mix((prefix[width:] - prefix[:-width]) * _power(pow(base, -1, 1 << 64), n)[: n - width + 1])


def winnow(hashes: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The least hash of each window of consecutive hashes, the leftmost of equals: its place, and the first and last window it is least in.

    The choice depends on the window's own hashes alone, so equal windows choose the same place wherever they stand.
    Each window has one place, and the windows of a place are consecutive.
    """
    n = len(hashes) - window + 1
    if n <= 0:
        return (np.empty(0, np.int64),) * 3
    # the place below the upper half of its hash: no two are equal, and of equal halves the leftmost is least
    least, size = (hashes & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(hashes), dtype=np.uint64), 1
    while size * 2 <= window:
        least, size = np.minimum(least[:-size], least[size:]), size * 2
    places = (np.minimum(least[:n], least[window - size : window - size + n]) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    low = np.concatenate([[0], np.flatnonzero(places[1:] != places[:-1]) + 1])
    return places[low], low, np.append(low[1:], n) - 1


def one_row_each(docs: DataFrame, *columns: str) -> DataFrame:
    """doc_id and columns with one row for each doc_id: of rows that share an id the one whose columns sort least.

    Ids are counted first, without the texts, so that only a table with repeated ids is shuffled.
    """
    small_batches(docs.sparkSession)
    docs = docs.select("doc_id", *columns).where("doc_id is not null")
    if docs.groupBy("doc_id").count().where("count > 1").limit(1).count():
        least = docs.groupBy("doc_id").agg(F.min(F.struct(*columns)).alias("_row"))
        docs = least.select("doc_id", *(F.col(f"_row.{c}").alias(c) for c in columns))
    return docs


def with_row_ids(docs: DataFrame) -> DataFrame:
    """Every column c of docs as own_c, and row, a number of its own for each row: doc_id where that is there and not repeated.

    Rows without doc_id and rows that share one get numbers after all others, in the order of doc_id and text, so
    that each is a document of its own. Only a table that has such rows is written anew. restored() gives the columns
    their names back; till then none can clash with another.
    """
    small_batches(docs.sparkSession)
    docs = docs.select(*(F.col(c).alias(f"own_{c}") for c in docs.columns))
    key = F.col("own_doc_id").cast("long")
    ids = docs.select(key.alias("id"))
    repeated = ids.groupBy("id").count().where("count > 1 or id is null").select("id", F.lit(True).alias("odd"))
    if not repeated.limit(1).count():
        return docs.withColumn("row", key)
    marked = docs.join(cut(repeated, "repeated-ids"), key.eqNullSafe(F.col("id")), "left").drop("id")
    after = (ids.agg(F.max("id")).first()[0] or 0) + 1
    odd = marked.where("odd").drop("odd").withColumn("place", F.monotonically_increasing_id())
    odd = odd.repartitionByRange("own_doc_id", "own_text", "place").sortWithinPartitions("own_doc_id", "own_text", "place").drop("place")
    odd = odd.withColumn("row", F.monotonically_increasing_id() + after)
    return cut(marked.where("odd is null").drop("odd").withColumn("row", key).unionByName(odd), "row-ids")


def restored(rows: DataFrame, columns: list[str]) -> DataFrame:
    """The given columns of what with_row_ids() took, under their own names."""
    return rows.select(*(F.col(f"own_{c}").alias(c) for c in columns))


def with_computed(df: DataFrame, inputs: list[str], added: dict[str, tuple[str, pa.DataType]], start) -> DataFrame:
    """df with more columns, made in Arrow batches; its own columns pass untouched, whatever their types and nulls.

    added: name to (SQL type, Arrow type). start() is called once in each task and returns a function from the values
    of the input columns (lists) to the values of the added ones (lists).
    """

    def run(batches):
        make = start()
        for batch in batches:
            out = make(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in inputs))
            arrays = [pa.array(values, kind) for values, (_, kind) in zip(out, added.values())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *arrays], [*batch.schema.names, *added])

    small_batches(df.sparkSession)
    schema = T.StructType(df.schema.fields + T.StructType.fromDDL(", ".join(f"{c} {kind}" for c, (kind, _) in added.items())).fields)
    return df.mapInArrow(run, schema)
