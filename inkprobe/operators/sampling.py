"""Seeded exact sampling, shuffling, splitting and folding.

Every choice is made on a uniform hash key (``functions.keys.order_key``). Exact counts
come from *finding the key at a given rank* and then filtering on it, so the rows
themselves are never shuffled: one pass counts rows per key prefix, one pass ranks the
rows of the single prefix that holds the wanted rank (1/65,536 of a class). The only
operator that has to move rows is the numbering in :func:`number_rows`.
"""

from __future__ import annotations

from collections.abc import Callable

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from inkprobe.functions.keys import order_key
from inkprobe.session import stage

# Hex digits of the key prefix: 4 digits cut any row set into 65,536 equal parts.
PREFIX_DIGITS = 4


def _prefix(key: str) -> Column:
    return F.substring(F.col(key), 1, PREFIX_DIGITS)


def _rows_before(counts: DataFrame, group: str) -> DataFrame:
    """Rows in smaller prefixes of the same group; at most 65,536 rows per group."""
    before = Window.partitionBy(group).orderBy("prefix").rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("rows_before", F.coalesce(F.sum("n").over(before), F.lit(0)))


# Classes that the driver handles one by one.
MOST_CLASSES = 10_000


def keys_at_ranks(
    df: DataFrame, key: Column, group: Column, ranks_for: Callable[[object, int], list[int]]
) -> tuple[dict, dict]:
    """Class sizes, and the key found at given 1-based ranks of each class.

    ``group`` is a class expression with few, non-null values; ``ranks_for(value, size)``
    names the ranks wanted for a class of that size. Returns ``(sizes, keys)`` where
    ``keys[value]`` lists the key at each wanted rank (rank 0 gives the empty string).
    """
    spark = df.sparkSession
    keyed = df.select(group.alias("grp"), key.alias("key")).withColumn("prefix", _prefix("key"))
    # At most 65,536 rows per class; staged, so the data is counted once.
    counts = stage(keyed.groupBy("grp", "prefix").agg(F.count(F.lit(1)).alias("n")), "prefixes")
    classes = counts.groupBy("grp").agg(F.sum("n").alias("n")).limit(MOST_CLASSES + 1).collect()
    if len(classes) > MOST_CLASSES:
        raise ValueError(f"more than {MOST_CLASSES} classes: stratify by a column with few values")
    sizes = {r["grp"]: r["n"] for r in classes}

    wanted = [(g, int(r)) for g, size in sizes.items() for r in set(ranks_for(g, size)) if 0 < r <= size]
    found: dict = {(g, 0): "" for g in sizes}
    if wanted:
        grp_type = keyed.schema["grp"].dataType.simpleString()
        # One row per class and wanted rank.
        asked = spark.createDataFrame(wanted, f"grp {grp_type}, want bigint")
        place = (
            _rows_before(counts, "grp")
            .join(F.broadcast(asked), "grp")
            .filter((F.col("want") > F.col("rows_before")) & (F.col("want") <= F.col("rows_before") + F.col("n")))
            .select("grp", "prefix", "want", (F.col("want") - F.col("rows_before")).alias("nth"))
        )
        # Repeated keys collapse map-side, so even a broken id column cannot flood a task.
        running = Window.partitionBy("grp", "want").orderBy("key").rowsBetween(Window.unboundedPreceding, 0)
        # ``place`` holds as many rows as ``asked``, so it is a bounded broadcast too.
        hits = (
            keyed.join(F.broadcast(place), ["grp", "prefix"])
            .groupBy("grp", "want", "nth", "key")
            .agg(F.count(F.lit(1)).alias("same"))
            .withColumn("upto", F.sum("same").over(running))
            .filter((F.col("upto") >= F.col("nth")) & (F.col("upto") - F.col("same") < F.col("nth")))
            .select("grp", "want", "key", "same")
            .collect()
        )
        for row in hits:
            if row["same"] > 1:
                raise ValueError("row ids are not unique: an exact sample needs one key per row")
            found[(row["grp"], row["want"])] = row["key"]
    keys = {g: [found[(g, min(int(r), size))] if size else "" for r in ranks_for(g, size)] for g, size in sizes.items()}
    return sizes, keys


def _by_class(group: Column, values: dict, default) -> Column:
    """CASE over the few classes of a group expression."""
    case = F.lit(default)
    for value, result in values.items():
        case = F.when(group == F.lit(value), result).otherwise(case)
    return case


def random_sample(df: DataFrame, n: int, seed: int, id_col: str = "text_id") -> DataFrame:
    """Exactly ``n`` rows (all, if there are fewer), without replacement."""
    key = order_key(seed, "sample", F.col(id_col))
    sizes, keys = keys_at_ranks(df, key, F.lit(0), lambda _, size: [min(n, size)])
    return df.filter(key <= F.lit(keys[0][0] if sizes else ""))


def number_rows(df: DataFrame, key: Column, name: str) -> DataFrame:
    """Number rows 0..n-1 in key order without a single global sort.

    Keys are unique (they digest row ids), so prefixes are of equal size. Rows are numbered
    inside each prefix and shifted by the rows in smaller ones. Both the join and the window use the prefix, so the rows move once.
    """
    keyed = df.withColumn("_key", key).withColumn("prefix", _prefix("_key"))
    counts = keyed.groupBy("prefix").agg(F.count(F.lit(1)).alias("n")).withColumn("all", F.lit(0))
    starts = _rows_before(counts, "all").select("prefix", "rows_before")
    place = F.row_number().over(Window.partitionBy("prefix").orderBy("_key"))
    return (
        keyed.join(starts, "prefix")
        .withColumn(name, F.col("rows_before") + place.cast("bigint") - 1)
        .drop("prefix", "rows_before", "_key")
    )


def number_in_ranges(df: DataFrame, keys: Sequence[Column], name: str) -> DataFrame:
    """Number rows 1..n in the order of ``keys``, however they are distributed.

    Rows are cut into ranges of about equal size and staged with their range, as a cut made twice may
    differ. A number is the place in the range plus the rows of the ranges before.
    """
    ranges = stage(df.repartitionByRange(*keys).withColumn("_range", F.spark_partition_id()), "ranges")
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = ranges.groupBy("_range").agg(F.count(F.lit(1)).alias("_rows"))
    starts = sizes.select("_range", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"))
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*keys))
    numbered = ranges.withColumn(name, place).join(F.broadcast(starts), "_range")
    return numbered.withColumn(name, F.col("_start") + F.col(name)).drop("_range", "_start")


def shuffle(df: DataFrame, seed: int, id_col: str, name: str = "text_id") -> DataFrame:
    """Seeded shuffle: ``name`` is each row's place 0..n-1 in the shuffled order."""
    return number_rows(df, order_key(seed, "shuffle", F.col(id_col)), name)


def balanced_sample(
    df: DataFrame,
    label_col: str,
    n_total: int,
    seed: int,
    id_col: str = "row_key",
    positive_label=1,
) -> DataFrame:
    """Exactly ``n_total // 2`` rows of each class, shuffled and numbered as ``text_id``.

    Every label other than ``positive_label``, a missing one included, is the negative
    class. Raises ``ValueError`` when a class is short.
    """
    per_class = n_total // 2
    positive = F.col(label_col).eqNullSafe(F.lit(positive_label))
    key = order_key(seed, "sample", F.col(id_col))
    sizes, keys = keys_at_ranks(df, key, positive, lambda _, size: [min(per_class, size)])
    n_pos, n_neg = sizes.get(True, 0), sizes.get(False, 0)
    if min(n_pos, n_neg) < per_class:
        raise ValueError(
            f"cannot balance {n_total} rows: {n_pos} positive and {n_neg} negative, {per_class} of each needed"
        )
    cut = _by_class(positive, {g: F.lit(k[0]) for g, k in keys.items()}, "")
    return shuffle(stage(df.filter(key <= cut), "sample"), seed, id_col)


def stratified_split(
    df: DataFrame, label_col: str, test_size: float = 0.2, seed: int = 42, id_col: str = "text_id", name: str = "is_test"
) -> DataFrame:
    """Flag ``round(test_size * n)`` rows of each class as test rows."""
    label = F.col(label_col)
    key = order_key(seed, "split", F.col(id_col))
    _, keys = keys_at_ranks(df, key, label, lambda _, size: [int(test_size * size + 0.5)])
    return df.withColumn(name, key <= _by_class(label, {g: F.lit(k[0]) for g, k in keys.items()}, ""))


def stratified_kfold(
    df: DataFrame, label_col: str, k: int = 5, seed: int = 42, id_col: str = "text_id", name: str = "fold"
) -> DataFrame:
    """Assign each row a fold 0..k-1; each class is spread evenly over the folds.

    Fold f holds the rows of class ranks ``(f*n/k, (f+1)*n/k]`` in hash order.
    """
    label = F.col(label_col)
    key = order_key(seed, "fold", F.col(id_col))
    _, keys = keys_at_ranks(df, key, label, lambda _, size: [f * size // k for f in range(1, k)])
    fold = _by_class(
        label,
        {g: sum(((key > F.lit(cut)).cast("int") for cut in cuts), F.lit(0)) for g, cuts in keys.items()},
        0,
    )
    return df.withColumn(name, fold.cast("int"))


def number_in_order(ordered: DataFrame, name: str) -> DataFrame:
    """Number the rows of a *report table* 1..n in their present order.

    Report tables hold one row per (dataset, model, strategy); for data use
    :func:`number_rows`, which never brings rows together.
    """
    return ordered.withColumn("_at", F.monotonically_increasing_id()).select(
        "*", F.row_number().over(Window.orderBy("_at")).cast("bigint").alias(name)
    ).drop("_at")
