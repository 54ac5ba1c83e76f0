"""Text and label expressions. All are built-in functions inside code generation."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The 29 characters Python counts as whitespace. The plain ``\s`` of the
# JVM covers ASCII only, so the class is spelled out.
WHITESPACE_CLASS = (
    r"[\x{0009}-\x{000D}\x{001C}-\x{0020}\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
)
NO_WHITESPACE_CLASS = "[^" + WHITESPACE_CLASS[1:]


def clean(text: Column) -> Column:
    """Collapse each whitespace run to one blank and strip the ends; null stays null."""
    return F.trim(F.regexp_replace(text, WHITESPACE_CLASS + "+", " "))


def words(text: Column) -> Column:
    """Lower-cased blank-separated tokens of the cleaned text; blank text has none."""
    # One pass of the pattern: a cleaned text that is compared and then split would be cleaned twice.
    return F.array_remove(F.split(F.lower(text), WHITESPACE_CLASS + "+"), "")


def first_word(text: Column) -> Column:
    """The first of ``words``, found without making the others; empty where there is none."""
    return F.regexp_extract(F.lower(text), NO_WHITESPACE_CLASS + "+", 0)


def last_word(text: Column) -> Column:
    """The last of ``words``, found from the end; empty where there is none."""
    return F.reverse(F.regexp_extract(F.reverse(F.lower(text)), NO_WHITESPACE_CLASS + "+", 0))


def derive_label(column: Column, positive: str = "human") -> Column:
    """1 where the value equals ``positive``, else 0. A null value is not equal: 0."""
    return F.when(column == positive, 1).otherwise(0)


def invert_label(label: Column) -> Column:
    """Swap the 0/1 classes of a label column."""
    return F.lit(1) - label


def label_name(label: Column) -> Column:
    """Display name of a class. Fixed values."""
    return F.when(label == 1, "Humano").otherwise("IA")


def coerce_numeric(column: Column) -> Column:
    """Number from text that may use a decimal comma; text that is no number gives null."""
    return F.replace(column.cast("string"), F.lit(","), F.lit(".")).try_cast("double")


def parse_vector(column: Column) -> Column:
    """Float vector from its printed form, blank- or comma-separated, with line breaks.

    Input other than a bracketed list raises, as does an item that is no number.
    """
    flat = F.trim(F.regexp_replace(column, r"[\s,]+", " "))
    checked = F.when(flat.rlike(r"^\[.*\]$"), flat).otherwise(
        F.raise_error(F.concat(F.lit("not a printed vector: "), F.coalesce(column, F.lit("null"))))
    )
    body = F.trim(F.regexp_replace(checked, r"[\[\]]", " "))
    return F.when(body == "", F.array().cast("array<float>")).otherwise(
        F.transform(F.split(body, r"\s+"), lambda item: item.cast("float"))
    )


def threshold_predict(score: Column, threshold: float = 0.5) -> Column:
    """1 where the score reaches the threshold."""
    return (score >= F.lit(float(threshold))).cast("int")


def argmax_predict(probabilities: Column) -> Column:
    """Zero-based class of the largest probability; the first one on ties."""
    return (F.array_position(probabilities, F.array_max(probabilities)) - 1).cast("int")


def round4(column: Column) -> Column:
    """Four decimals, half to even."""
    return F.bround(column, 4)
