"""Result and performance tables on disk."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

RESULTS = (
    "dataset string, model string, strategy string, classifier string, "
    "roc_auc double, accuracy double, f1 double, recall double, precision double"
)
PERFORMANCE = (
    "dataset string, model string, strategy string, time_seconds double, vram_peak_gb double, "
    "cpu_ram_delta_gb double, cached boolean"
)
SUFFIX = "_performance"


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists on whatever file system it names; globs match any file."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(hadoop)
    return found is not None and len(found) > 0


# Columns whose ascending order is the order of rows in the files: place of the path among those read, file, first byte of the block, row in it.
FILE_ORDER = ("_source", "_file", "_block", "_row")


def read_results(spark: SparkSession, path: str, schema: str = RESULTS, positions: bool = False, source: int = 0) -> DataFrame:
    """One result table with a header line; with ``positions``, each row says where it stands (``FILE_ORDER``).

    Passed as ``order`` to the ranking operators, these columns let the first row in file order win a tie.
    """
    rows = spark.read.schema(schema).csv(path, header=True, nanValue="NaN")
    if not positions:
        return rows
    block = F.col("_metadata.file_block_start").cast("long")
    # Numbers within a task ascend in the order of reading, so they order the rows of a block.
    return rows.select("*", F.lit(source).alias("_source"), F.col("_metadata.file_path").alias("_file"), block.alias("_block"), F.monotonically_increasing_id().alias("_row"))


def read_results_many(spark: SparkSession, paths: Sequence[str], schema: str = RESULTS, positions: bool = False) -> DataFrame | None:
    """All tables that exist, in one frame; ``None`` when there is none."""
    there = [p for p in paths if path_exists(spark, p)]
    if not there:
        return None
    return reduce(DataFrame.unionByName, [read_results(spark, p, schema, positions, i) for i, p in enumerate(there)])


def read_with_provenance(spark: SparkSession, folder: str) -> DataFrame | None:
    """All ``*_performance`` tables below a folder, with the ``experiment`` each belongs to.

    A table is a CSV file or a folder of CSV files with that name.
    """
    pattern = f"{folder.rstrip('/')}/*{SUFFIX}.csv"
    if not path_exists(spark, pattern):
        return None
    rows = spark.read.schema(PERFORMANCE).csv(pattern, header=True)
    name = F.regexp_extract(F.col("_metadata.file_path"), rf"([^/]*){SUFFIX}\.csv", 1)
    return rows.select("*", name.alias("experiment"))


def unified_performance(spark: SparkSession, folder: str) -> DataFrame | None:
    """All performance tables with the name of the file each row came from, first."""
    rows = read_with_provenance(spark, folder)
    if rows is None:
        return None
    named = rows.withColumn("source_file", F.concat(F.col("experiment"), F.lit(f"{SUFFIX}.csv")))
    return named.select("source_file", *[c for c in rows.columns if c != "experiment"])


# Column that takes the first field too many.
_SURPLUS = "_surplus"


def read_csv_lenient(spark: SparkSession, path: str, columns: Sequence[str], header: bool = True) -> DataFrame:
    """CSV rows as text columns; a row with too many fields is skipped, a short one is filled with nulls.

    A value that isn't a number stays, for ``coerce_numeric`` to make it null later. One column more than the
    file should have catches the surplus and is always read, so every choice of columns sees the same rows.
    """
    fields = ", ".join(f"`{c}` string" for c in [*columns, _SURPLUS])
    rows = spark.read.schema(fields).csv(path, header=header, mode="PERMISSIVE")
    return rows.filter(F.col(_SURPLUS).isNull()).drop(_SURPLUS)


def write_results(results: DataFrame, performance: DataFrame | None, path: str) -> str:
    """Write ``<path>.csv`` and next to it ``<path>_performance.csv``; returns the first.

    Each is a folder of CSV parts with header lines, as every writer of a cluster leaves it.
    """
    stem = path.removesuffix(".csv")
    results.write.mode("overwrite").csv(f"{stem}.csv", header=True)
    if performance is not None:
        performance.write.mode("overwrite").csv(f"{stem}{SUFFIX}.csv", header=True)
    return f"{stem}.csv"


def write_table(table: DataFrame, path: str) -> str:
    """Write a report table as a folder of CSV parts with header lines; returns its path."""
    where = f"{path.removesuffix('.csv')}.csv"
    table.write.mode("overwrite").csv(where, header=True)
    return where
