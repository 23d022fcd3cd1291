"""Every query of the library over empty tables, and over tables with rows of nulls, zero vectors and groups of one row."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from tests.compare import TABLES

SF = "/root/testdata/sf0.001"
NAMES = [n for n in __spark_entry__.queries() if n != "pipeline" and not n.startswith("op")]
#: Queries that an empty table leaves nothing to compare, which they say.
REFUSES = {"paired_bootstrap": "nothing to compare", "bootstrap_report": "nothing to compare"}


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("empty")
    for t in TABLES:
        spark.read.parquet(f"{SF}/{t}.parquet").limit(0).coalesce(1).write.parquet(f"{folder}/{t}.parquet")
    return str(folder)


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """A few rows of each table, one whose values are null but for its keys, and vectors of nothing but zeros."""
    folder = tmp_path_factory.mktemp("odd")
    for t in TABLES:
        rows = spark.read.parquet(f"{SF}/{t}.parquet")
        few = rows.limit(40)
        keys = {c for c in rows.columns if c.endswith(("key", "_id", "number")) or c == "turn"}
        bare = rows.limit(1).select(*(F.when(F.lit(c in keys), F.col(c)).alias(c) for c in rows.columns))
        out = few.unionByName(bare)
        if t == "embeddings":
            zero = rows.limit(1).withColumns({"vec_id": F.lit(10**9).cast("long"), "embedding": F.transform("embedding", lambda x: (x * 0).cast("float")), "label": (F.col("label") * 0 + 10**6).cast(dict(rows.dtypes)["label"])})
            out = out.unionByName(zero.select(rows.columns))
        out.coalesce(1).write.parquet(f"{folder}/{t}.parquet")
    return str(folder)


@pytest.mark.parametrize("name", NAMES)
def test_on_empty_tables(spark, empty, name):
    if name in REFUSES:
        with pytest.raises(ValueError, match=REFUSES[name]):
            __spark_entry__.queries()[name](spark, empty).collect()
    else:
        __spark_entry__.queries()[name](spark, empty).collect()


@pytest.mark.parametrize("name", [n for n in NAMES if n not in {"family_assignment"}])
def test_on_odd_rows(spark, odd, name):
    __spark_entry__.queries()[name](spark, odd).collect()
