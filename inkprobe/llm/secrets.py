"""Secret scan: fixed patterns, and character Markov models of random strings and ordinary identifiers.

DataFrame operations only. The models' transition counts are one small table, at most the square of the alphabet.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from inkprobe.llm.arrow import without

ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
_N = len(ALPHABET)

# The base patterns.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LEAST = 6
# Runs as long as asked for; a run is maximal either way, so these find what the shorter forms find and keep.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ["assign", "access", "hex", "markov"]

_SPAN = "struct<start:int,kind:int,end:int>"


def _spans(text: Column, pattern: str, kind: int, lengths: Column | None = None, least: int = 0) -> Column:
    """Spans of leftmost non-overlapping matches in code points, from the pieces that they split the text into.

    ``lengths`` holds a length for each match; matches below ``least`` are dropped.
    """
    matches = F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))
    parts = F.arrays_zip(F.split(text, pattern, -1).alias("piece"), matches.alias("match"), (matches if lengths is None else lengths).alias("part"))
    none = F.lit(None).cast(f"array<{_SPAN}>")
    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{_SPAN}>").alias("found"))

    def step(state: Column, part: Column) -> Column:
        begin = state["at"] + F.length(part["piece"])
        end = begin + F.coalesce(F.length(part["match"]), F.lit(0))
        keep = part["match"].isNotNull() & (F.length(part["part"]) >= least)
        span = F.struct(begin.cast("int").alias("start"), F.lit(kind).alias("kind"), end.cast("int").alias("end"))
        return F.struct(end.alias("at"), F.when(keep, F.array_append(state["found"], span)).otherwise(state["found"]).alias("found"))

    # Most texts have no match and skip all this.
    return F.coalesce(F.when(text.rlike(pattern), F.aggregate(parts, start, step)["found"]).otherwise(none), F.array().cast(f"array<{_SPAN}>"))


def base_spans(text: Column) -> Column:
    """Spans of the fixed patterns by start, then kind."""
    groups = F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2))
    every = F.concat(_spans(text, ASSIGN, 0, groups, ASSIGN_LEAST), _spans(text, ACCESS, 1), _spans(text, HEX, 2))
    return F.array_sort(every)


# ---- the models


def transitions(samples: DataFrame) -> DataFrame:
    """``label, pair, n``: how often each pair of alphabet characters follows in ``text``, with label 1 (random) or 0.

    A row counts ``n`` times where the samples have that column. Longer runs are taken in pieces of 256 characters.
    """
    times = F.col("n") if "n" in samples.columns else F.lit(1).cast("long")
    runs = samples.select("label", times.alias("n"), F.explode(F.regexp_extract_all("text", F.lit(f"[{ALPHABET[:-1]}-]{{2,256}}"), F.lit(0))).alias("run"))
    pairs = F.transform(F.sequence(F.lit(1), F.length("run") - 1), lambda i: F.substring(F.col("run"), i, F.lit(2)))
    return runs.select("label", "n", F.explode(pairs).alias("pair")).groupBy("label", "pair").agg(F.sum("n").alias("n"))


@dataclass
class MarkovPair:
    """Log-likelihood ratios, random over ordinary, of each pair of characters."""

    ratios: list[float]

    @classmethod
    def train(cls, samples: DataFrame) -> MarkovPair:
        """First-order chains of both labels, half a count added to every transition. No samples: no evidence."""
        from math import log

        counts = {label: [[0.5] * _N for _ in range(_N)] for label in (0, 1)}
        place = {c: i for i, c in enumerate(ALPHABET)}
        for row in transitions(samples).collect():  # at most two rows per pair of characters
            if row.label in counts:
                counts[row.label][place[row.pair[0]]][place[row.pair[1]]] += row.n
        rates = {label: [[n / sum(row) for n in row] for row in table] for label, table in counts.items()}
        return cls([log(rates[1][i][j] / rates[0][i][j]) for i in range(_N) for j in range(_N)])

    def score(self, token: Column) -> Column:
        """Log-likelihood ratio of a token of alphabet characters."""
        # One constant array; a literal per number would make the generated code too long.
        table = F.split(F.lit(",".join(repr(r) for r in self.ratios)), ",").cast("array<double>")
        codes = F.transform(F.split(token, ""), lambda c: F.call_function("instr", F.lit(ALPHABET), c))

        def add(state: Column, code: Column) -> Column:
            step = F.when(state["last"] > 0, F.get(table, (state["last"] - 1) * _N + code - 1)).otherwise(0.0)
            return F.struct(code.alias("last"), (state["sum"] + F.coalesce(step, F.lit(0.0))).alias("sum"))

        return F.aggregate(codes, F.struct(F.lit(0).alias("last"), F.lit(0.0).alias("sum")), add)["sum"]


def ordinary_runs(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``text, n``: the runs of alphabet characters of all texts outside base matches, digits and separators included, and how often each occurs."""
    clean = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    for pattern in (ASSIGN, ACCESS, HEX):
        clean = F.regexp_replace(clean, pattern, " ")
    runs = docs.select(F.explode_outer(F.regexp_extract_all(clean, F.lit(f"[{ALPHABET[:-1]}-]+"), F.lit(0))).alias("text"))
    return runs.filter("text IS NOT NULL").groupBy("text").agg(F.count(F.lit(1)).alias("n"))


def labelled_samples(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_random: int = 4000, n_numbers: int = 4000, seed: int = 5) -> DataFrame:
    """``text, label, n`` to train on: what all texts hold as ordinary, digests as random.

    Each different run of the texts counts as often as it occurs: as it stands, between underscores, between hyphens and in camel case, as identifiers are
    joined. Equal runs are added up before the shuffle. ``n_numbers`` dated and counted names stand beside them, so that numbers are ordinary in
    texts without any. Random strings are ``n_random`` digests in base 64, lower-case hex and upper-case letters and digits; both numbers are all that bounds the samples.
    """
    spark = docs.sparkSession
    run, first = F.col("text"), F.upper(F.substring("text", 1, 1))
    joined = [run, F.concat(F.lit("_"), run, F.lit("_")), F.concat(F.lit("-"), run, F.lit("-")), F.concat(first, F.expr("substring(text, 2)"), first)]
    ordinary = ordinary_runs(docs, text_col).select(F.explode(F.array(*joined)).alias("text"), F.lit(0).alias("label"), "n")
    drawn = F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(10**12))
    named = [
        F.format_string("%04d-%02d-%02d", 1990 + drawn % 50, 1 + drawn % 12, 1 + F.floor(drawn / 12) % 28),
        F.format_string("_%06d-%04d", F.col("id"), drawn % 10_000), F.format_string("%d", drawn), F.format_string("-%03d_%05d", drawn % 1000, F.floor(drawn / 1000) % 100_000),
    ]
    numbers = spark.range(n_numbers).select(F.explode(F.array(*named)).alias("text"), F.lit(0).alias("label"), F.lit(1).cast("long").alias("n"))
    digest = F.sha2(F.concat_ws("|", F.lit(str(seed)), F.col("id").cast("string")), 256)
    base64 = F.base64(F.unhex(digest))
    shapes = [base64, F.translate(base64, "+/=", "-_"), F.substring(digest, 1, 40), F.regexp_replace(F.upper(base64), "[^A-Z0-9]", "")]
    random = spark.range(n_random).select(F.explode(F.array(*shapes)).alias("text"), F.lit(1).alias("label"), F.lit(1).cast("long").alias("n"))
    return ordinary.unionByName(numbers).unionByName(random)


def markov_spans(text: Column, model: MarkovPair, base: Column, least: int, margin: float) -> Column:
    """Runs of at least ``least`` alphabet characters that the models call random by ``margin`` nats, outside base spans."""
    pattern = f"[{ALPHABET[:-1]}-]{{{least},}}"
    spans = _spans(text, pattern, 3)
    free = F.filter(spans, lambda s: ~F.exists(base, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    return F.filter(free, lambda s: model.score(F.substring(text, s["start"] + 1, s["end"] - s["start"])) >= margin)


def spans_text(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


ADDED = ["base", "added"]


def scan(docs: DataFrame, model: MarkovPair, text_col: str = "text", least: int = 20, margin: float = 12.0) -> DataFrame:
    """Add ``base`` and ``added``, arrays of ``start, kind, end`` in code points (end exclusive; kind is the place in KINDS).

    ``base`` has the matches of the fixed patterns: leftmost and non-overlapping for each kind, too short ones dropped. ``added`` has
    further runs of at least ``least`` letters, digits and ``+/_=-`` whose log-likelihood ratio, random over ordinary, is
    ``margin`` or more and which touch no base span. Runs of any length and texts of any length are read whole.

    Null and empty texts have no spans. Repeated rows each get theirs; columns named like an added one are replaced.
    """
    docs = without(docs, ADDED)
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    based = docs.withColumn("base", base_spans(text))
    return based.withColumn("added", markov_spans(text, model, F.col("base"), least, margin))
