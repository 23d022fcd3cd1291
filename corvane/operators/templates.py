"""Template expansion: slots, capacities, and distinct fillings by index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

STRETCH = 1000  # fillings made in a row


def slots(pattern: Column) -> Column:
    """Names in braces, in the order in which they first appear."""
    return F.array_distinct(F.regexp_extract_all(pattern, F.lit(r"\{(\w+)\}"), F.lit(1)))


def pattern_capacities(patterns: DataFrame, slot_sizes: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """pattern_id, family_id, category, capacity: the product of the sizes of the pattern's slots; 1 without slots.

    A slot that has no values makes the capacity 0. slot_sizes: slot, size. A pattern with a pair (a column of patterns, null for
    most) takes all its slots from one entry of pairs (pair, position, slot, value), such as a sign with one of its own
    values or a short form with what it stands for, so its capacity is the number of that pair's entries.
    """
    used = patterns.select("pattern_id", F.explode(slots(F.col("pattern"))).alias("slot")).join(slot_sizes, "slot", "left")
    sizes = used.groupBy("pattern_id").agg(F.collect_list(F.coalesce("size", F.lit(0))).alias("sizes"))
    product = F.coalesce(F.aggregate("sizes", F.lit(1).cast("long"), lambda t, x: t * x), F.lit(1))
    out = patterns.join(sizes, "pattern_id", "left")
    if pairs is not None:
        entries = pairs.groupBy("pair").agg(F.count_distinct("position").alias("entries"))
        out = out.join(entries, "pair", "left")
        product = F.when(F.col("pair").isNotNull(), F.coalesce("entries", F.lit(0))).otherwise(product)
    return out.select("pattern_id", "family_id", "category", product.cast("long").alias("capacity"))


def pattern_quotas(capacities: DataFrame, quotas: DataFrame) -> DataFrame:
    """pattern_id, family_id, category, capacity, wanted: a family's quota (family_id, quota) dealt to its patterns by capacity.

    Each gets the whole part of its share, and what that leaves goes one by one to the first patterns by pattern_id.
    """
    whole = capacities.groupBy("family_id").agg(F.sum("capacity").alias("pooled"))
    shared = capacities.join(whole, "family_id").join(quotas.select("family_id", "quota"), "family_id")
    shared = shared.withColumn("part", F.floor(F.try_divide(F.col("quota") * F.col("capacity"), F.greatest("pooled", F.lit(1)))).cast("long"))
    given = shared.groupBy("family_id").agg(F.sum("part").alias("given"), F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy("family_id").orderBy("pattern_id")) - 1  # patterns of a family
    left = shared.join(given, "family_id").withColumn("left", F.col("quota") - F.col("given")).withColumn("place", place)
    extra = F.floor(F.col("left") / F.col("n")) + (F.col("place") < F.col("left") % F.col("n")).cast("long")
    return left.select("pattern_id", "family_id", "category", "capacity", (F.col("part") + extra).cast("long").alias("wanted"))


def family_capacities(capacities: DataFrame) -> DataFrame:
    return capacities.groupBy("category", "family_id").agg(F.sum("capacity").alias("capacity"), F.count("*").alias("n_patterns"))


def decode(index: Column, sizes: Column) -> Column:
    """Mixed-radix digits of an index for the given sizes; the last varies fastest."""
    start = F.struct(index.cast("long").alias("rest"), F.array().cast("array<long>").alias("digits"))
    step = lambda t, n: F.struct(F.floor(t.rest / n).cast("long").alias("rest"), F.concat(F.array(t.rest % n), t.digits).alias("digits"))
    return F.aggregate(F.reverse(sizes), start, step, lambda t: t.digits)


def fillings(patterns: DataFrame, slot_values: DataFrame, per_pattern: int, seed: int = 42) -> DataFrame:
    """pattern_id, k, index, text: distinct fillings of each pattern, half as many again as `per_pattern` and eight at most.

    A filling in which a slot named "x2" has the value of "x" is left out.
    """
    asked = patterns.withColumns({"first": F.lit(0).cast("long"), "last": F.lit(per_pattern + per_pattern // 2 + 8).cast("long")})
    return drawn(asked, slot_values, None, seed).where("not doubled").drop("doubled")


def drawn(patterns: DataFrame, slot_values: DataFrame, pairs: DataFrame | None = None, seed: int = 42) -> DataFrame:
    """pattern_id, k, index, text, doubled: the fillings number first to last - 1 of each pattern (pattern_id, pattern, pair, first, last).

    Fillings are numbered by an affine step over the pattern's capacity, which visits each index once before any again, so
    that none is listed to be thrown away and a later range goes on where an earlier one ended. doubled: a slot named "x2"
    has the value of "x". slot_values: slot, position (from 0), value; pairs: pair, position, slot, value.
    """
    entry = "array<struct<at:int,slot:string,size:int,values:array<string>>>"
    sizes = slot_values.groupBy("slot").agg(F.count("*").cast("int").alias("size"), F.transform(F.array_sort(F.collect_list(F.struct("position", "value"))), lambda v: v.value).alias("values"))
    names = patterns.withColumn("slots", slots(F.col("pattern")))
    plain = names if pairs is None else names.where("pair is null")
    lists = plain.select("pattern_id", F.posexplode("slots").alias("at", "slot")).join(sizes, "slot")
    gathered = lists.groupBy("pattern_id").agg(F.array_sort(F.collect_list(F.struct("at", "slot", "size", "values"))).alias("s"))
    base = plain.join(gathered, "pattern_id", "left").withColumn("s", F.coalesce("s", F.expr(f"cast(array() as {entry})")))
    base = base.where(F.size("s") == F.size("slots")).withColumn("capacity", F.aggregate("s", F.lit(1).cast("long"), lambda t, x: t * x["size"]))
    numbered = _numbered(base, seed)
    digits = decode(F.col("index"), F.transform("s", lambda x: x["size"].cast("long")))
    filled = numbered.withColumn("d", digits).withColumn("v", F.zip_with("s", "d", lambda s, d: F.struct(s.slot.alias("slot"), F.element_at(s["values"], (d + 1).cast("int")).alias("value"))))
    if pairs is not None:
        entries = pairs.groupBy("pair", "position").agg(F.array_sort(F.collect_list(F.struct("slot", "value"))).alias("v"))
        ranked = entries.select("pair", "v", (F.row_number().over(Window.partitionBy("pair").orderBy("position")) - 1).cast("long").alias("index"))
        counted = entries.groupBy("pair").agg(F.count("*").alias("capacity"))
        told = _numbered(names.join(counted, "pair"), seed).join(ranked, ["pair", "index"])
        filled = filled.select("pattern_id", "pattern", "k", "index", "v").unionByName(told.select("pattern_id", "pattern", "k", "index", "v"))
    doubled = F.exists("v", lambda x: x.slot.endswith("2") & F.exists("v", lambda y: (F.concat(y.slot, F.lit("2")) == x.slot) & (y.value == x.value)))
    text = F.aggregate("v", F.col("pattern"), lambda t, x: F.replace(t, F.concat(F.lit("{"), x.slot, F.lit("}")), x.value))
    return filled.select("pattern_id", "k", "index", text.alias("text"), doubled.alias("doubled"))


def _numbered(base: DataFrame, seed: int) -> DataFrame:
    """k from first to last - 1, below the capacity, and its index: multiples of a step prime to the capacity visit distinct ones."""
    last = F.least(F.col("capacity"), F.col("last"))
    # patterns are few and fillings many: stretches of them are dealt out over all cores
    stretches = base.where(F.col("first") < last).select("*", F.explode(F.sequence(F.col("first"), last - 1, F.lit(STRETCH).cast("long"))).alias("_from"))
    stretches = stretches.repartition(base.sparkSession.sparkContext.defaultParallelism, "pattern_id", "_from")
    asked = stretches.select("*", F.explode(F.sequence(F.col("_from"), F.least(F.col("_from") + STRETCH, last) - 1)).alias("k")).drop("_from")
    step = F.lit(2_147_483_647).cast("long")
    return asked.withColumn("index", F.pmod(F.col("k") * (step % F.col("capacity")) + F.pmod(F.xxhash64(F.lit(seed), "pattern_id"), F.col("capacity")), F.col("capacity")))
