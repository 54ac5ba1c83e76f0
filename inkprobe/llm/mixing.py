"""Mixing sources to target weights by pivotal rounding, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from inkprobe.llm.arrow import without
from inkprobe.llm.frames import packed, unpacked
from inkprobe.session import stage

# A copy probability this close to a whole number is one.
_EPSILON = 1e-9


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), most: float = 3.0) -> DataFrame:
    """``source, source_size, target`` from ``source, size``: the sources' shares of all sizes by weight.

    Sources in code point order, null last, take the weights in turn. A target stops at ``most`` times the size
    of its source, and the excess is shared by weight among the others until none is above.

    The level at which all others stop is found by passing over the sources in the order in which they reach
    their limit. This table has one row per source, so the window holds no more.
    """
    table = sizes.groupBy("source").agg(F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("source_size"))
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    table = table.withColumn("weight", weight).withColumn("limit", F.col("source_size") * most)
    everything = Window.partitionBy()
    order = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").isNull(), "source").rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("limit").over(order), F.lit(0.0))
    shared = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(order), F.lit(0.0))
    table = table.withColumn("level", left / shared)
    stops = F.min(F.when(F.col("level") <= F.col("limit") / F.col("weight"), F.struct((F.col("limit") / F.col("weight")).alias("at"), "level"))).over(everything)
    return table.select("source", "source_size", F.least("limit", F.col("weight") * stops["level"]).alias("target"))


def _uniform(*parts: Column) -> Column:
    """A number in [0, 1) drawn by hash."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 11) / F.lit(float(1 << 53))


def _fold(units: Column, seed: int, level: int) -> Column:
    """Pivotal rounding along an array of ``key.., p, h``: ``done`` (each with ``p`` 0 or 1) and the one ``rest``.

    Two fractional units meet; the mass of one moves to the other with the odds that keep both expectations,
    until one is whole. The other meets the next.
    """

    def with_p(unit: Column, p: Column) -> Column:
        return unit.withField("p", p)

    def meet(state: Column, unit: Column) -> Column:
        rest = state["rest"]
        a, b = rest["p"], unit["p"]
        total = a + b
        u = _uniform(F.lit(seed), F.lit(level), rest["h"], unit["h"])
        small = total < 1
        # Up to one: one of them gets the sum, the other none. Beyond: one gets one, the other what is left.
        first = F.when(small, u * total < a).otherwise(u * (2 - total) < 1 - b)
        whole = F.when(small, F.lit(0.0)).otherwise(F.lit(1.0))
        over = F.when(small, total).otherwise(total - 1)
        # Small sums end the one that gets nothing, large ones the one that gets all.
        ends_rest = first != small
        ended = F.when(ends_rest, with_p(rest, whole)).otherwise(with_p(unit, whole))
        stays = F.when(ends_rest, with_p(unit, over)).otherwise(with_p(rest, over))
        return F.struct(F.array_append(state["done"], ended).alias("done"), stays.alias("rest"))

    start = F.struct(F.slice(units, 1, 0).alias("done"), F.element_at(units, 1).alias("rest"))
    return F.aggregate(F.slice(units, F.lit(2), F.size(units)), start, meet)


def choose_copies(
    units: DataFrame, keys: list[str], weights: tuple[float, ...] = (5, 2, 1), most: float = 3.0, seed: int = 23, group_rows: int = 256
) -> DataFrame:
    """``keys.., source, size, source_size, target, copies`` for ``units`` of ``keys.., source, size, times``.

    Every unit of a source has the expectation target / source size. Its whole part is given; the fractions are
    rounded so that their sum in each source changes by less than one copy. Units of similar size meet first
    (size classes of a quarter of a power of two), so the sizes taken come near the target as well.

    Groups of about ``group_rows`` units are rounded each by itself and leave one fraction each; those fractions form
    the groups of the next level, until one group per source is left: a reduction tree of as many levels as
    the logarithm of the units to the base ``group_rows``. No group grows with its source. All draws are hashes of
    seed and unit, so reruns agree. Each level is written to the staging folder.
    """
    units = units.withColumn("mass", F.col("size") * F.col("times"))
    sources = stage(source_targets(units.select("source", F.col("mass").alias("size")), weights, most), "targets")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    given = F.floor(ratio + _EPSILON)
    rated = units.join(sources, units["source"].eqNullSafe(sources["source"]), "left").drop(sources["source"])
    rated = rated.withColumn("given", given).withColumn("p", ratio - given)
    rated = rated.withColumn("p", F.when(F.col("p") < _EPSILON, 0.0).otherwise(F.col("p")))
    rated = rated.withColumn("h", F.xxhash64(F.lit(seed), *keys, "source", "size"))
    names = [*keys, "source", "size", "times"]

    step = F.floor(F.log2(F.col("mass") + 1) * 4).cast("int")
    open_ = rated.filter("p > 0").select(*names, "mass", "p", "h", step.alias("class"))
    level, done = 0, []
    while True:
        counts = stage(open_.groupBy("source", "class").agg(F.count(F.lit(1)).alias("n")), "counts")
        largest = counts.agg(F.max("n")).first()[0] or 0
        split = F.greatest(F.lit(1), F.ceil(F.col("n") / group_rows))
        keyed = open_.join(counts.withColumnRenamed("source", "s").withColumnRenamed("class", "c"), F.col("source").eqNullSafe(F.col("s")) & (F.col("class") == F.col("c")))
        keyed = keyed.withColumn("part", F.pmod(F.xxhash64(F.lit(level), "h"), split))
        # Within a group, neighbours in size meet.
        unit = F.struct("mass", "h", *[F.col(n) for n in names if n != "source"], "p")
        groups = keyed.groupBy("source", "class", "part").agg(F.array_sort(F.collect_list(unit)).alias("units"))
        folded = groups.select("source", "class", _fold(F.col("units"), seed, level).alias("f"))
        whole = folded.select(
            "source", "class",
            F.explode(F.concat(
                F.transform(F.col("f.done"), lambda u: F.struct(u.alias("u"), F.lit(True).alias("done"))),
                F.array(F.struct(F.col("f.rest").alias("u"), (F.col("f.rest.p") < _EPSILON).alias("done"))),
            )).alias("e"),
        )
        written = stage(whole.select("source", "class", "e.u.*", F.col("e.done").alias("done")), "rounded")
        done.append(written.filter("done"))
        rest = written.filter("NOT done")
        if level > 0 and largest <= group_rows:
            # One fraction per source is left: the only draw that doesn't keep the sum.
            done.append(rest.withColumn("p", (_uniform(F.lit(seed), F.lit(-1), F.col("h")) < F.col("p")).cast("double")))
            break
        # From now on, all size classes of a source meet.
        open_ = rest.select(*names, "mass", "p", "h", F.lit(0).alias("class"))
        level += 1

    drawn = done[0]
    for other in done[1:]:
        drawn = drawn.unionByName(other)
    drawn = drawn.select(*[F.col(n).alias(f"__{n}") for n in [*keys, "source", "size"]], F.round("p").cast("long").alias("__extra"))
    same = None
    for n in [*keys, "source", "size"]:
        test = rated[n].eqNullSafe(F.col(f"__{n}"))
        same = test if same is None else same & test
    joined = rated.join(drawn, same, "left")
    copies = (F.col("given") + F.coalesce(F.col("__extra"), F.lit(0))).cast("int").alias("copies")
    return joined.select(*keys, "source", "size", "source_size", "target", copies)


def word_count(text: Column) -> Column:
    """Runs of characters other than blank, tab, line feed, vertical tab, form feed and carriage return."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


ADDED = ["size", "source_size", "target", "copies"]


def mix(
    docs: DataFrame, key_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: tuple[float, ...] = (5, 2, 1), most: float = 3.0, seed: int = 23,
) -> DataFrame:
    """Add ``size`` (words), ``source_size``, ``target`` and ``copies`` to ``docs``: how often the mix takes each document.

    See ``choose_copies``. Null and empty texts have size 0. A null source is a source of its own, after all others.
    Rows that agree in key, source and size share one decision, weighed by their number, so repeated rows and null
    keys are fine. No document is taken more than ``most`` times (rounded down). Other columns stay; columns
    named like an added one are replaced. The narrow rows are written to the staging folder; texts are shuffled
    only if the decisions are too large for a broadcast join.
    """
    docs = without(docs, [c for c in ADDED if c not in (key_col, text_col, source_col)])
    sized = docs.select(
        packed(docs, docs.columns).alias("row"), F.col(f"`{key_col}`").alias("own_key"), F.col(f"`{source_col}`").alias("own_source"),
        word_count(F.col(f"`{text_col}`")).alias("own_size"),
    )
    narrow = stage(
        sized.groupBy(F.col("own_key").alias("key"), F.col("own_source").alias("source"), F.col("own_size").alias("size")).agg(F.count(F.lit(1)).alias("times")),
        "units",
    )
    chosen = choose_copies(narrow, ["key"], weights, most, seed)
    same = F.col("own_key").eqNullSafe(F.col("key")) & F.col("own_source").eqNullSafe(F.col("source")) & (F.col("own_size") == F.col("size"))
    return unpacked(sized.join(chosen, same, "left"), "row", docs.columns, ["size", "source_size", "target", "copies"])


def repeat_copies(mixed: DataFrame) -> DataFrame:
    """The mix itself: each row ``copies`` times, without the added columns."""
    kept = [c for c in mixed.columns if c not in ADDED]
    times = F.expr("explode(CASE WHEN copies > 0 THEN sequence(1, copies) ELSE array() END)")
    return unpacked(mixed.select(packed(mixed, kept).alias("row"), times.alias("copy")), "row", kept, [])
