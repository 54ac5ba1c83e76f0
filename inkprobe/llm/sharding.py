"""Sharding by proportional stratified interleaving, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from inkprobe.llm.arrow import without
from inkprobe.llm.frames import packed, unpacked

# Most buckets that ranks are counted in; with it, integer arithmetic is exact up to 10**10 rows of a source.
MAX_BUCKETS = 65_536
# Steps that the place of a source's first row is drawn from.
_STEPS = 4096


def _div(a: Column, b: Column | int) -> Column:
    """Whole-number division of numbers that aren't negative."""
    return F.call_function("div", a, F.lit(b) if isinstance(b, int) else b)


def _draw(digest: Column, digits: int) -> Column:
    return F.conv(F.substring(digest, 1, digits), 16, 10).cast("long")


def interleave(
    df: DataFrame, shards: int, source_col: str = "source", key_col: str = "doc_id", seed: int = 17, bucket_rows: int = 2_000
) -> DataFrame:
    """Add ``shard`` (from 0) and ``slot`` (gapless from 0 in each shard): every shard holds the mixture of all rows.

    Rows of a source are shuffled by the MD5 digest of seed and key and ranked. The row of rank r of a source
    of n rows gets the fractional rank (r + u) / n, where u is drawn once per source. All rows in order of
    fractional rank are cut into ``shards`` runs whose row counts differ by one at most; as each source is spread evenly
    over that order, each run has its share of each source.

    Ranks are counted bucket by bucket: digest prefixes within a source, then ranges of the fractional rank. A bucket
    has about ``bucket_rows`` rows whatever the source, so no source, however large, meets in one task. The rows
    of the second kind of bucket follow from the sizes of the sources alone. Only tables of counts are joined.

    A null source is a source of its own, null keys are keys like others. Rows with equal keys are ordered by a hash of all
    their columns; rows equal in all columns are interchangeable. Columns named ``shard`` or ``slot`` are replaced. An
    empty table gives an empty one.
    """
    if shards < 1:
        raise ValueError("shards must be positive")
    df = without(df, ["shard", "slot"])
    columns = df.columns
    total = df.count()
    buckets = min(MAX_BUCKETS, max(1, total // bucket_rows))

    key = F.col(f"`{key_col}`").cast("string")
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), key))
    strata = [F.coalesce(F.col(f"`{source_col}`"), F.lit("")).alias("__src"), F.col(f"`{source_col}`").isNull().alias("__nul")]
    ties = F.xxhash64(*[F.col(f"`{c}`") for c in columns]).alias("__ties")
    rows = df.select(packed(df, columns).alias("__row"), *strata, digest.alias("__md5"), ties)
    rows = rows.withColumn("__bucket", _div(_draw(F.col("__md5"), 4) * buckets, 65_536).cast("int"))

    # Ranks within a source: rows before the bucket, then the place in the bucket.
    stratum = ["__src", "__nul"]
    own = Window.partitionBy(*stratum)
    running = own.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counts = rows.groupBy(*stratum, "__bucket").agg(F.count(F.lit(1)).alias("__n"))
    offsets = counts.select(
        *stratum, "__bucket", (F.sum("__n").over(running) - F.col("__n")).alias("__before"), F.sum("__n").over(own).alias("__rows")
    )
    place = Window.partitionBy(*stratum, "__bucket").orderBy("__md5", "__ties")
    ranked = rows.withColumn("__place", F.row_number().over(place)).join(offsets, [*stratum, "__bucket"])
    ranked = ranked.withColumn("__rank", F.col("__before") + F.col("__place") - 1)

    # Fractional ranks, in whole numbers: (rank * _STEPS + u) / (rows * _STEPS).
    first = _draw(F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit("first"), F.col("__nul").cast("string"), F.col("__src"))), 3)
    up, down = F.col("__rank") * _STEPS + first, F.col("__rows") * _STEPS
    slices = ranked.withColumn("__slice", _div(up * buckets, down).cast("int")).withColumn("__share", up / down)

    # Rows in each slice of the order: from the sizes of the sources.
    def before(j: Column) -> Column:
        """Ranks of a source whose slice is below ``j``."""
        gap = j.cast("long") * F.col("__rows") * _STEPS - F.col("__first") * buckets
        step = _STEPS * buckets
        return F.when(gap <= 0, F.lit(0)).otherwise(F.least(_div(gap + (step - 1), step), F.col("__rows")))

    sizes = counts.groupBy(*stratum).agg(F.sum("__n").alias("__rows")).withColumn("__first", first)
    by_slice = F.transform(F.sequence(F.lit(0), F.lit(buckets - 1)), lambda j: F.struct(j.alias("slice"), (before(j + 1) - before(j)).alias("n")))
    at = lambda r: (r.cast("long") * _STEPS + F.col("__first")) * buckets
    by_rank = F.transform(
        F.sequence(F.lit(0).cast("long"), F.col("__rows") - 1),
        lambda r: F.struct(_div(at(r), F.col("__rows") * _STEPS).cast("int").alias("slice"), F.lit(1).cast("long").alias("n")),
    )
    parts = sizes.select(F.explode(F.when(F.col("__rows") >= buckets, by_slice).otherwise(by_rank)).alias("p"))
    held = parts.groupBy(F.col("p.slice").alias("__slice")).agg(F.sum("p.n").alias("__held"))
    # At most MAX_BUCKETS rows of counts meet here.
    order = Window.orderBy("__slice").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    held = held.select("__slice", (F.sum("__held").over(order) - F.col("__held")).alias("__start"))

    within = Window.partitionBy("__slice").orderBy("__share", *stratum, "__rank")
    placed = slices.withColumn("__spot", F.row_number().over(within)).join(held, "__slice")
    spot = F.col("__start") + F.col("__spot") - 1
    n = max(total, 1)
    placed = placed.withColumn("__spot", spot).withColumn("shard", _div(F.col("__spot") * shards, n).cast("int"))
    start = _div(F.col("shard").cast("long") * n + (shards - 1), shards)
    return unpacked(placed.withColumn("slot", (F.col("__spot") - start).cast("long")), "__row", columns, ["shard", "slot"])
