"""Zero-shot prompt arrays and their readout.

Prompts are built on token ids: only the text part is ever shortened, the fixed question
and the answer slot always survive.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

# Fixed values of the zero-shot question.
QUESTION = "Is the text above written by a human (not an AI)?"
CAUSAL_PROMPT = f"\n\nQuestion: {QUESTION} Answer (Yes/No):"
CLOZE_PREFIX = f"\n\nQuestion: {QUESTION} Answer:"
CLOZE_SUFFIX = "."
YES_CANDIDATES = (" Yes", "Yes")
NO_CANDIDATES = (" No", "No")


def _ids(values: Sequence[int]) -> Column:
    return F.array(*[F.lit(int(v)) for v in values]).cast("array<int>")


def _budget(max_length: int, *parts: int) -> int:
    return max(max_length - sum(parts), 1)


def build_causal_prompt(
    ids: Column, prompt: Sequence[int], max_length: int, start: Sequence[int] = (), end: Sequence[int] = ()
) -> Column:
    """``start + text + prompt + end`` in at most ``max_length`` ids (one text id is kept)."""
    room = _budget(max_length, len(prompt), len(start), len(end))
    return F.concat(_ids(start), F.slice(ids, 1, room), _ids(prompt), _ids(end))


def build_cloze(
    ids: Column,
    prefix: Sequence[int],
    mask: int,
    suffix: Sequence[int],
    max_length: int,
    start: Sequence[int] = (),
    end: Sequence[int] = (),
) -> Column:
    """``start + text + prefix + mask + suffix + end``; only the text is shortened."""
    room = _budget(max_length, len(prefix), 1, len(suffix), len(start), len(end))
    return F.concat(_ids(start), F.slice(ids, 1, room), _ids(prefix), _ids([mask]), _ids(suffix), _ids(end))


def last_real_position(mask: Column) -> Column:
    """Index of the rightmost 1 of a 0/1 mask, whichever side is padded; all zero gives 0."""
    return F.coalesce(F.array_max(F.transform(mask, lambda m, i: m * i)), F.lit(0))


def mask_position(ids: Column, mask: Column | int) -> Column:
    """Index of the answer slot: the last ``mask`` id, as the text itself may hold one.

    Null where there is no slot.
    """
    mask = mask if isinstance(mask, Column) else F.lit(mask)
    from_end = F.nullif(F.array_position(F.reverse(ids), mask), F.lit(0))
    return (F.size(ids) - from_end).cast("int")


def yes_no_log_odds(logits: Column, yes: Column | int, no: Column | int) -> Column:
    """``log p(yes) - log p(no)``; the normaliser cancels. Above 0 favours human."""
    at = lambda i: F.element_at(logits, (i if isinstance(i, Column) else F.lit(i)) + 1)
    return at(yes) - at(no)


def resolve_single_token(
    candidates: DataFrame, order_col: str = "ord", ids_col: str = "ids", by: Sequence[str] = ()
) -> DataFrame:
    """First candidate that is exactly one token, per ``by`` group; raises when none is."""
    single = F.size(ids_col) == 1
    first = F.min_by(F.when(single, F.element_at(ids_col, 1)), F.when(single, F.col(order_col)))
    found = candidates.groupBy(*by).agg(first.alias("token_id"))
    return found.withColumn(
        "token_id",
        F.coalesce("token_id", F.raise_error(F.lit("no candidate is a single token")).cast("int")),
    )
