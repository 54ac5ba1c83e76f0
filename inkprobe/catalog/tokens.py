"""Tokens, vocabulary, neighbours, masking draws, prompts."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkprobe.catalog.registry import clean_sql, query, rounded, table
from inkprobe.functions import prompts
from inkprobe.operators import tokens as tk

# In SQL: the predictable tokens, and the ids of text start, text end and mask.
V = "(SELECT count(*) + 1 FROM vocab)"
S, E, M = V, f"({V} + 1)", f"({V} + 2)"


def texts(spark, sf_dir):
    """All documents as ``text_id, text``."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("text_id"), "text")


def flat_sql(source: str = "documents", key: str = "doc_id", limit: int | None = None) -> str:
    """CTEs ``lists`` (text_id, toks) and ``flat`` (text_id, size, pos, token)."""
    cut = f"[1:{limit}]" if limit else ""
    return f"""lists AS (
  SELECT {key} AS text_id, (CASE WHEN flat = '' THEN []::VARCHAR[] ELSE string_split(flat, ' ') END){cut} AS toks
  FROM (SELECT *, {clean_sql('lower(text)')} AS flat FROM {source})),
flat AS (
  SELECT text_id, len(toks) AS size, generate_subscripts(toks, 1) - 1 AS pos, unnest(toks) AS token FROM lists)"""


VOCAB_SQL = """vocab AS MATERIALIZED (
  SELECT token, row_number() OVER (ORDER BY count(*) DESC, token) AS id FROM flat GROUP BY token)"""

POSITIONS_SQL = f"""coded AS (
  SELECT text_id, size, pos, coalesce(id, 0) AS token_id FROM flat LEFT JOIN vocab USING (token)),
positions AS (
  SELECT text_id, size, pos, token_id,
    coalesce(lag(token_id) OVER w, {S}) AS left_id, coalesce(lead(token_id) OVER w, {E}) AS right_id
  FROM coded WINDOW w AS (PARTITION BY text_id ORDER BY pos))"""


@query("tokenize", f"WITH {flat_sql()} SELECT text_id, CAST(pos AS INTEGER) AS pos, token FROM flat")
def tokenize(spark, sf_dir):
    """Every token of every text."""
    return tk.explode_tokens(tk.tokenize(texts(spark, sf_dir)), ["text_id"])


@query("tokenize_truncated", f"WITH {flat_sql(limit=512)} SELECT text_id, CAST(pos AS INTEGER) AS pos, token FROM flat")
def tokenize_truncated(spark, sf_dir):
    """Truncation is the feature here: the first 512 tokens, the length limit of the published models."""
    return tk.explode_tokens(tk.tokenize(texts(spark, sf_dir), 512), ["text_id"])


@query("vocabulary", f"WITH {flat_sql()}, {VOCAB_SQL} SELECT token, CAST(id AS INTEGER) AS token_id FROM vocab")
def vocabulary(spark, sf_dir):
    return tk.vocabulary(tk.tokenize(texts(spark, sf_dir)))


@query(
    "vocabulary_limited",
    f"WITH {flat_sql()}, {VOCAB_SQL} SELECT token, CAST(id AS INTEGER) AS token_id FROM vocab WHERE id < 2003",
)
def vocabulary_limited(spark, sf_dir):
    """The limit is the feature: ids 1 to 2,002 go to the most frequent tokens."""
    return tk.vocabulary(tk.tokenize(texts(spark, sf_dir)), 2003)


def encoded(spark, sf_dir):
    tokenized = tk.tokenize(texts(spark, sf_dir))
    vocab, v = tk.sized_vocabulary(tokenized)
    return tk.encode(tk.neighbours(tokenized, ["text_id"]), vocab, v, ["left", "token", "right"])


_IDS = "CAST(left_id AS INTEGER) AS left_id, CAST(token_id AS INTEGER) AS token_id"


_TAGGED = "replace(replace(text, 'the', '<s>'), 'der', '</s>')"


@query(
    "encode_literal_sentinels",
    f"""WITH tagged AS (SELECT doc_id, {_TAGGED} AS text FROM documents), {flat_sql('tagged')}, {VOCAB_SQL}, {POSITIONS_SQL}
SELECT text_id, pos, CAST(left_id AS INTEGER) AS left_id, CAST(token_id AS INTEGER) AS token_id, CAST(right_id AS INTEGER) AS right_id
FROM positions""",
)
def encode_literal_sentinels(spark, sf_dir):
    """Texts that hold the tags ``<s>`` and ``</s>``: tokens like others, not text start and end."""
    tagged = texts(spark, sf_dir).withColumn("text", F.expr(_TAGGED))
    tokenized = tk.tokenize(tagged)
    vocab, v = tk.sized_vocabulary(tokenized)
    rows = tk.encode(tk.neighbours(tokenized, ["text_id"]), vocab, v, ["left", "token", "right"])
    return rows.select("text_id", F.col("pos").cast("bigint").alias("pos"), "left_id", "token_id", "right_id")


@query(
    "encode_positions",
    f"""WITH {flat_sql()}, {VOCAB_SQL}, {POSITIONS_SQL}
SELECT text_id, CAST(size AS INTEGER) AS size, CAST(pos AS INTEGER) AS pos, {_IDS},
  CAST(right_id AS INTEGER) AS right_id FROM positions""",
)
def encode_positions(spark, sf_dir):
    """Every token of every text with its vocabulary id and both neighbours."""
    return encoded(spark, sf_dir)


@query(
    "shift_targets",
    f"""WITH {flat_sql()}, {VOCAB_SQL}, {POSITIONS_SQL}
SELECT text_id, CAST(pos AS INTEGER) AS pos, {_IDS} FROM positions WHERE pos >= 1""",
)
def shift_targets(spark, sf_dir):
    """Next-token pairs: the first token of a text is never predicted."""
    return tk.shift_targets(encoded(spark, sf_dir)).select("text_id", "pos", "left_id", "token_id")


@query(
    "clamp_ids",
    """SELECT l_orderkey, l_linenumber, greatest(0, least(499, l_partkey - 250)) AS token_id FROM lineitem""",
)
def clamp_ids(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", tk.clamp_ids(F.col("l_partkey") - 250, 500).alias("token_id")
    )


def draws_sql(ratio: float, samples: int, seed: int) -> str:
    """CTE ``draws``: masked positions per text and draw, from CTE ``flat``."""
    return f"""keyed AS (
  SELECT text_id, size, pos, draw,
    ('0x' || substr(md5(concat_ws('|', '{seed}', draw // 5, text_id, pos)), 1 + 6 * (draw % 5)::INTEGER, 6))::BIGINT
      / 16777216.0 AS u
  FROM flat, range({samples}) AS r(draw)),
marked AS (
  SELECT *, u < {ratio} OR (min(u) OVER t >= {ratio} AND u = min(u) OVER t) AS masked
  FROM keyed WINDOW t AS (PARTITION BY text_id, draw)),
draws AS (
  SELECT text_id, CAST(pos AS INTEGER) AS pos, CAST(draw AS INTEGER) AS draw, masked,
    coalesce(lag(masked) OVER o, FALSE) AS left_masked, coalesce(lead(masked) OVER o, FALSE) AS right_masked
  FROM marked WINDOW o AS (PARTITION BY text_id, draw ORDER BY pos))"""


TURN_KEY_SQL = "conv_id || '-' || turn"


def turn_texts(spark, sf_dir):
    """All turns of all roles as ``text_id, text``."""
    return table(spark, sf_dir, "conversations").select(F.expr("concat_ws('-', conv_id, turn)").alias("text_id"), "text")


@query(
    "mc_mask",
    f"""WITH {flat_sql('conversations', TURN_KEY_SQL)}, {draws_sql(0.15, 3, 41)}
SELECT text_id, pos, draw, left_masked, right_masked FROM draws WHERE masked""",
)
def mc_mask(spark, sf_dir):
    """Three draws at 15 per cent; draws that mask nothing have one forced position."""
    draws = tk.mask_draws(tk.tokenize(turn_texts(spark, sf_dir), None), 0.15, 3, 41)
    return draws.select("text_id", "pos", "draw", "left_masked", "right_masked")


@query(
    "corrupt",
    f"""WITH {flat_sql()}, {VOCAB_SQL}, {POSITIONS_SQL}, {draws_sql(0.35, 1, 41)}
SELECT text_id, pos, CAST(CASE WHEN masked THEN {M} ELSE token_id END AS INTEGER) AS token_id
FROM draws JOIN positions USING (text_id, pos)""",
)
def corrupt(spark, sf_dir):
    """One draw over all documents: masked tokens become the mask id, the rest stay."""
    tokenized = tk.tokenize(texts(spark, sf_dir), None)
    drawn = tk.with_mask_bits(tokenized.withColumn("digests", tk.draw_digests(41, 1)), "bits", 0.35, range(1))
    flat = tk.spots(drawn, ["text_id"], {"token": F.col("tokens"), "bit": F.col("bits")})
    vocab, v = tk.sized_vocabulary(tokenized)
    coded = tk.encode(flat, vocab, v, ["token"])
    return coded.select("text_id", "pos", tk.corrupt(F.col("token_id"), F.col("bit") == 1, tk.mask_id(v)).alias("token_id"))


# ---- prompts over document tokens. Their sentinels and the question's own ids are below the ids of
# text tokens, so they need no vocabulary size.

P_START, P_END, P_MASK = -2, -3, -4
PROMPT_WORDS = list(dict.fromkeys((prompts.CAUSAL_PROMPT + " " + prompts.CLOZE_PREFIX).split() + [prompts.CLOZE_SUFFIX]))


def prompt_ids(text: str) -> list[int]:
    return [P_MASK - 1 - PROMPT_WORDS.index(word) for word in text.split()]


def text_ids(spark, sf_dir, limit: int):
    """``text_id, ids``: the first ``limit`` token ids of every text in order; a text without tokens has none.

    Only the tokens that a prompt can hold are encoded and regrouped; the ids come from the whole texts.
    """
    tokenized = tk.tokenize(texts(spark, sf_dir))
    vocab, v = tk.sized_vocabulary(tokenized)
    cut = tk.explode_tokens(tk.tokenize(texts(spark, sf_dir), limit), ["text_id"])
    rows = tk.encode(cut, vocab, v, ["token"]).groupBy("text_id").agg(
        F.array_sort(F.collect_list(F.struct("pos", "token_id"))).alias("at")
    )
    ids = F.coalesce(F.col("at.token_id"), F.array().cast("array<int>"))
    return texts(spark, sf_dir).select("text_id").join(rows, "text_id", "left").select("text_id", ids.alias("ids"))


def _prompt_sql(parts: list[int], budget: int) -> str:
    tail = "[" + ", ".join(str(p) for p in parts) + "]"
    return f"""WITH {flat_sql()}, {VOCAB_SQL},
coded AS (SELECT text_id, list(coalesce(id, 0) ORDER BY pos) AS ids FROM flat LEFT JOIN vocab USING (token) GROUP BY text_id),
ids AS (SELECT text_id, coalesce(ids, []) AS ids FROM lists LEFT JOIN coded USING (text_id)),
prompt AS (SELECT text_id, list_concat([{P_START}], list_concat(ids[1:{budget}], {tail})) AS ids FROM ids)"""


_CAUSAL = prompt_ids(prompts.CAUSAL_PROMPT)
_PREFIX, _SUFFIX = prompt_ids(prompts.CLOZE_PREFIX), prompt_ids(prompts.CLOZE_SUFFIX)


@query(
    "build_causal_prompt",
    _prompt_sql([*_CAUSAL, P_END], 512 - len(_CAUSAL) - 2)
    + " SELECT text_id, CAST(len(ids) AS INTEGER) AS size, array_to_string(ids, ' ') AS ids FROM prompt",
)
def build_causal_prompt(spark, sf_dir):
    """Text, question, sentinels; texts are cut so that 512 ids are never exceeded."""
    built = prompts.build_causal_prompt(F.col("ids"), _CAUSAL, 512, [P_START], [P_END])
    rows = text_ids(spark, sf_dir, 512).select("text_id", built.alias("ids"))
    return rows.select("text_id", F.size("ids").alias("size"), F.array_join(F.col("ids").cast("array<string>"), " ").alias("ids"))


@query(
    "build_cloze",
    _prompt_sql([*_PREFIX, P_MASK, *_SUFFIX, P_END], 512 - len(_PREFIX) - 1 - len(_SUFFIX) - 2)
    + f""" SELECT text_id, CAST(list_position(ids, {P_MASK}) - 1 AS INTEGER) AS slot, array_to_string(ids, ' ') AS ids
FROM prompt""",
)
def build_cloze(spark, sf_dir):
    """Text, prefix, answer slot, suffix, with the place of the slot."""
    built = prompts.build_cloze(F.col("ids"), _PREFIX, P_MASK, _SUFFIX, 512, [P_START], [P_END])
    rows = text_ids(spark, sf_dir, 512).select("text_id", built.alias("ids"))
    return rows.select(
        "text_id",
        prompts.mask_position(F.col("ids"), P_MASK).alias("slot"),
        F.array_join(F.col("ids").cast("array<string>"), " ").alias("ids"),
    )


@query(
    "mask_position",
    """SELECT vec_id, CAST(len(ids) - nullif(list_position(list_reverse(ids), 1), 0) AS INTEGER) AS slot
FROM (SELECT vec_id, [CASE WHEN x > 0.2 THEN 1 ELSE 0 END FOR x IN embedding] AS ids FROM embeddings)""",
)
def mask_position(spark, sf_dir):
    """The last match counts, as the text itself may hold the mask id."""
    ids = F.transform("embedding", lambda x: F.when(x > F.lit(0.2).cast("double"), 1).otherwise(0))
    return table(spark, sf_dir, "embeddings").select("vec_id", prompts.mask_position(ids, 1).alias("slot"))


@query(
    "last_real_position",
    """SELECT vec_id, CAST(coalesce(list_max([CASE WHEN embedding[i] > 0.2 THEN i - 1 ELSE 0 END FOR i IN range(1, 65)]), 0)
  AS INTEGER) AS last FROM embeddings""",
)
def last_real_position(spark, sf_dir):
    mask = F.transform("embedding", lambda x: F.when(x > F.lit(0.2).cast("double"), 1).otherwise(0))
    return table(spark, sf_dir, "embeddings").select("vec_id", prompts.last_real_position(mask).alias("last"))


@query(
    "yes_no_log_odds",
    "SELECT vec_id, round(embedding[8]::DOUBLE - embedding[4]::DOUBLE, 6) AS log_odds FROM embeddings",
)
def yes_no_log_odds(spark, sf_dir):
    logits = F.col("embedding").cast("array<double>")
    return rounded(
        table(spark, sf_dir, "embeddings").select("vec_id", prompts.yes_no_log_odds(logits, 7, 3).alias("log_odds"))
    )


@query(
    "resolve_single_token",
    """SELECT conv_id, CAST(min_by(token, turn) AS INTEGER) AS token_id FROM (
  SELECT conv_id, turn, length(role) AS token, 1 AS size FROM conversations WHERE role <> 'system') GROUP BY conv_id""",
)
def resolve_single_token(spark, sf_dir):
    """Per conversation the first turn whose candidate is one token; system turns have two."""
    one = F.length("role")
    candidates = table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", F.when(F.col("role") == "system", F.array(one, one)).otherwise(F.array(one)).alias("ids")
    )
    return prompts.resolve_single_token(candidates, "turn", "ids", ["conv_id"])
