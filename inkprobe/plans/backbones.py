"""Signal models: count models trained on the cluster, and models a user plugs in.

Both kinds turn ``text_id, text`` into features keyed by ``text_id`` through the methods ``score``,
``pawn_metrics`` and ``embed``. A plugged-in model also has ``zero_shot_score``; a count model can't
answer a question and has none.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence
from dataclasses import asdict, dataclass
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from inkprobe.functions.prompts import (
    build_causal_prompt, build_cloze, last_real_position, mask_position, yes_no_log_odds,
)
from inkprobe.functions.text import first_word, last_word
from inkprobe.operators import contexts as cx, countmodel as cm, tokens as tk
from inkprobe.operators.averages import METRICS
from inkprobe.operators.lookup import skew_safe_join
from inkprobe.operators.pooling import pool_mean_by_id, token_vectors
from inkprobe.operators.sampling import number_in_ranges
from inkprobe.session import stage

# ---------------------------------------------------------------- count models


@dataclass(frozen=True)
class CountSpec:
    """Settings of a count model. ``paradigm`` is causal, masked or diffusion.

    Without ``vocab_size`` every token of the training texts is a token of the model; without
    ``max_length`` texts are read whole.
    """

    paradigm: str = "causal"
    vocab_size: int | None = None
    alpha: float = 0.1
    max_length: int | None = None
    mask_ratio: float = 0.35
    num_samples: int = 10
    seed: int = 41

    def __post_init__(self):
        if self.paradigm not in ("causal", "masked", "diffusion"):
            raise ValueError(f"unknown paradigm {self.paradigm!r}")


class CountModel:
    """Pair counts of training texts, and the features they give.

    ``part`` tells apart models fitted together: a text is scored by the counts of its own
    ``part``. :func:`fit` makes one model of all texts; :func:`cross_fit` makes two, so
    that every text is scored by counts that never saw it. The texts are read once, into a table of token hashes, when
    a feature first asks for it; token ids are made only where ``embed`` asks for them.
    """

    def __init__(self, spec: CountSpec, halves: bool):
        self.spec, self.halves = spec, halves
        # Different tokens and all tokens of the training texts, once counted.
        self._counted: tuple[int, int] | None = None
        self._texts: DataFrame | None = None
        self._hashes: DataFrame | None = None
        self._vocab: DataFrame | None = None
        self._numbered: DataFrame | None = None

    # -- fitting

    @classmethod
    def fit(cls, spec: CountSpec, train: DataFrame) -> CountModel:
        """One model of all ``train`` texts (``text_id, text``)."""
        return cls(spec, halves=False)._fit(train)

    @classmethod
    def cross_fit(cls, spec: CountSpec, texts: DataFrame) -> CountModel:
        """Two models, each trained on one half of ``texts`` and used for the other half."""
        return cls(spec, halves=True)._fit(texts)

    def _fit(self, texts: DataFrame) -> CountModel:
        self._texts = texts
        return self

    def _counts(self) -> tuple[int, int]:
        """Different tokens and all tokens of the training texts; raises if two share a hash."""
        if self._counted is None:
            self._counted = tk.distinct_tokens(self._hashed(self._texts))
        return self._counted

    @property
    def v(self) -> int:
        """Predictable tokens."""
        return self._counts()[0] + 1 if self.spec.vocab_size is None else self.spec.vocab_size

    @property
    def numbered(self) -> DataFrame:
        """``token, token_id`` of the training texts, numbered when first asked for; for those who read them once."""
        if self._numbered is None:
            self._numbered = tk.vocabulary(self._tokenized(self._texts), self.spec.vocab_size)
        return self._numbered

    @property
    def vocab(self) -> DataFrame:
        """``numbered``, staged."""
        if self._vocab is None:
            self._vocab = stage(self.numbered, "vocabulary")
        return self._vocab

    # -- positions

    def _tokenized(self, texts: DataFrame) -> DataFrame:
        part = cm.cross_fit_half(self.spec.seed, "text_id") if self.halves else F.lit(0)
        rows = texts.select("text_id", "text").withColumn("part", part)
        return tk.tokenize(rows, self.spec.max_length).drop("text")

    def _hashed(self, texts: DataFrame) -> DataFrame:
        """``text_id, part, tokens, checks, place``, staged; the training texts are hashed once. ``place`` numbers the texts."""
        if texts is self._texts and self._hashes is not None:
            return self._hashes
        hashes = tk.hashed(self._tokenized(texts), ["text_id", "part"])
        hashes = stage(hashes.withColumn("place", F.monotonically_increasing_id()), "hashes")
        if texts is self._texts:
            self._hashes = hashes
        return hashes

    def _within_vocabulary(self, hashes: DataFrame) -> DataFrame:
        """Tokens beyond a limited vocabulary are ``<unk>``."""
        if self.spec.vocab_size is None:
            return hashes
        flat = tk.hide_unknown(hashes.select("place", F.posexplode_outer("tokens").alias("pos", "token")).filter(F.col("token").isNotNull()), tk.known_hashes(self.vocab), ["token"])
        again = flat.groupBy("place").agg(F.array_sort(F.collect_list(F.struct("pos", "token")))["token"].alias("tokens"))
        return stage(hashes.drop("tokens", "checks").join(again, "place", "left"), "within-vocabulary")

    def _sums(self, texts: DataFrame, metrics: Sequence[str], work: cx.Work) -> DataFrame:
        """``text_id, weight, <metric>_<setting>`` of every text; a text without positions has zeros."""
        hashes = self._within_vocabulary(self._hashed(texts))
        part = F.col("part")
        other = 1 - part if self.halves else part

        def rows(of: DataFrame, trains: bool, scored: bool) -> DataFrame:
            return of.select("place", F.col("text_id").cast("string").alias("key"), cx.kind(part, other, trains, scored).alias("kind"), "tokens")

        if texts is self._texts:
            both, total = rows(hashes, True, True), self._counts()[1]
        else:
            both = rows(self._within_vocabulary(self._hashed(self._texts)), True, False).unionByName(rows(hashes, False, True))
            total = self._counts()[1] + (hashes.agg(F.sum(F.greatest(F.size("tokens"), F.lit(0)))).first()[0] or 0)
        sums = cx.text_sums(both, total, work, self.v, self.spec.alpha, metrics)
        names = [c for c in sums.columns if c != "place"]
        found = hashes.select("place", "text_id").join(sums, "place", "left")
        return found.groupBy("text_id").agg(*[F.coalesce(F.sum(n), F.lit(0.0)).alias(n) for n in names])

    # -- features

    def _means(self, texts: DataFrame, metrics: Sequence[str]) -> DataFrame:
        """``text_id`` and the mean of each metric over the scored positions; none at all gives 0."""
        sums = self._sums(texts, metrics, cx.Work("masked" if self.spec.paradigm == "masked" else "causal", self.spec.seed))
        floor = F.greatest(F.col("weight"), F.lit(1.0))
        return sums.select("text_id", *[(F.col(f"{m}_0") / floor).alias(m) for m in metrics])

    def score(self, texts: DataFrame) -> DataFrame:
        """``text_id, score``: mean log-probability. A diffusion model scores causally."""
        return self._means(texts, ["Mlog_prob"]).select("text_id", F.col("Mlog_prob").alias("score"))

    def pawn_metrics(self, texts: DataFrame) -> DataFrame:
        """``text_id`` and the five metrics; a diffusion model averages masked draws."""
        if self.spec.paradigm == "diffusion":
            grid = [(self.spec.mask_ratio, self.spec.num_samples)]
            return self.masked_draw_metrics(texts, grid).drop("mask_ratio", "num_samples")
        return self._means(texts, METRICS)

    def masked_draw_metrics(self, texts: DataFrame, grid: list[tuple[float, int]]) -> DataFrame:
        """The five metrics per text and (mask_ratio, num_samples), all settings in one job.

        Draws are folded to the few contexts they show (``tokens.draw_weights``), so the
        number of records moved does not grow with the number of draws or settings.
        """
        # Weights of a text sum to 1 per setting, so a weighted sum is the mean of means.
        sums = self._sums(texts, METRICS, cx.Work("draws", self.spec.seed, tuple(grid)))
        settings = F.array(
            *[
                F.struct(
                    F.lit(float(ratio)).alias("mask_ratio"),
                    F.lit(int(samples)).alias("num_samples"),
                    *[F.col(f"{m}_{s}").alias(m) for m in METRICS],
                )
                for s, (ratio, samples) in enumerate(grid)
            ]
        )
        return sums.select("text_id", F.inline(settings))

    def _end_tokens(self, texts: DataFrame) -> DataFrame:
        """``text_id, token``: the first token of each text, of causal models the last; empty where a text has none."""
        if self.spec.max_length is None:
            end = first_word if self.spec.paradigm == "masked" else last_word
            return texts.select("text_id", end(F.col("text")).alias("token"))
        place = F.lit(1) if self.spec.paradigm == "masked" else F.lit(-1)
        token = F.when(F.size("tokens") > 0, F.element_at("tokens", place)).when(F.col("tokens").isNotNull(), F.lit(""))
        return self._tokenized(texts).select("text_id", token.alias("token"))

    def embed(self, texts: DataFrame, vectors: DataFrame) -> DataFrame:
        """``text_id, embedding`` pooled from ``vectors`` (``vec_id, vec``).

        Causal models take the last token, masked ones the first, diffusion the mean. The
        token is picked from the text, then its id and vector are looked up, so one vector per text moves.
        Token ids beyond the table wrap around; tokens outside the vocabulary have id 0.
        """
        rows, width = vectors.agg(F.count(F.lit(1)), F.max(F.size("vec"))).first()
        # Token ids wrap around the places of the table, so gaps in its ids lose no text.
        vectors = number_in_ranges(vectors.select("vec_id", "vec"), [F.col("vec_id")], "place")
        vectors = stage(vectors, "vectors")
        vectors = vectors.select((F.col("place") - 1).alias("vec_id"), "vec")
        if self.spec.paradigm == "diffusion":
            self._counts()
            hashes = self._hashed(texts).select("text_id", "tokens")
            # Not counted by text first: uses of a token add up where the vectors are added, without another shuffle.
            used = hashes.select("text_id", F.explode_outer("tokens").alias("token")).filter(F.col("token").isNotNull()).withColumn("w", F.lit(1.0))
            blank = hashes.filter(F.size("tokens") == 0)
            known, asked = tk.known_hashes(self.numbered), used
        else:
            ends = stage(self._end_tokens(texts), "used")
            used = ends.filter("token <> ''").select("text_id", F.xxhash64("token").alias("token"))
            blank = ends.filter("token = ''")
            # Ids are looked up by the token itself, and hashed for the join with the texts.
            known, asked = self.numbered, ends.filter("token <> ''")
        asked = asked.groupBy("token").agg(F.count(F.lit(1)).alias("uses"))
        token = F.col("token") if self.spec.paradigm == "diffusion" else F.xxhash64("token").alias("token")
        ids = stage(asked.join(known, "token", "left").select(token, "uses", (F.coalesce("token_id", F.lit(tk.UNKNOWN)) % rows).cast("bigint").alias("vec_id")), "ids")
        if self.spec.paradigm != "diffusion" and not ids.groupBy("token").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty():
            raise ValueError("a token hash stands for more than one token")
        placed = skew_safe_join(used, ids, ["token"])
        if self.spec.paradigm == "diffusion":
            pooled = pool_mean_by_id(placed, vectors)
        else:
            pooled = token_vectors(placed, vectors).select("text_id", F.col("vec").cast("array<double>").alias("embedding"))
        # A text without tokens keeps its row: a zero vector.
        return pooled.unionByName(blank.select("text_id", F.array_repeat(F.lit(0.0), width).alias("embedding")))

    def fingerprint(self) -> dict[str, Any]:
        return asdict(self.spec)


# ---------------------------------------------------------------- plugged-in models

# Output columns of the four methods.
OUTPUTS = {
    "score": "score double",
    "pawn_metrics": ", ".join(f"{m} double" for m in METRICS),
    "embed": "embedding array<float>",
    "zero_shot_score": "zero_shot_score double",
}

# What a model gets at a time: bytes of text (or of ids) and rows.
MODEL_BYTES = 4 * 1024 * 1024
MODEL_ROWS = 1024

_factories: dict[str, tuple[str, Callable[[], Any]]] = {}


def register_backbone(name: str, factory: Callable[[], Any]) -> None:
    """Make a model available by name.

    ``factory()`` builds an object with any of ``score(texts)``, ``pawn_metrics(texts)``,
    ``embed(texts)``, ``zero_shot_score(texts)``, each taking a list of texts, and
    ``answer_logits(ids, positions)`` for prompts built here.
    """
    _factories[name] = (uuid.uuid4().hex, factory)


def _run_in_batches(df: DataFrame, name: str, call: Callable[[Any, pd.DataFrame], dict], schema: str, weighed: str = "text") -> DataFrame:
    """``call(model, batch)`` for parts of Arrow batches, with the model built once per worker; an earlier one is released.

    A part has at most ``MODEL_BYTES`` bytes in the column ``weighed`` and ``MODEL_ROWS`` rows. The function shipped to the workers holds all it needs, and keeps the model on the
    ``sys`` module, which outlives tasks in a reused worker.
    """
    if name not in _factories:
        raise KeyError(f"no backbone {name!r}; registered: {sorted(_factories)}")
    token, factory = _factories[name]
    most_bytes, most_rows = MODEL_BYTES, MODEL_ROWS

    def weigh(value: Any) -> int:
        return 0 if value is None else len(value.encode()) if isinstance(value, str) else 8 * len(value)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import sys

        import numpy
        import pandas

        models = sys.__dict__.setdefault("_inkprobe_models", {})
        if token not in models:
            models.clear()  # a worker holds one model
            models[token] = factory()
        for batch in batches:
            # Texts of like length together, in parts of bounded bytes; a longer text is a part of its own.
            sizes = numpy.array([weigh(v) for v in batch[weighed]])
            order = numpy.argsort(sizes, kind="stable")
            filled = numpy.cumsum(sizes[order])
            first = 0
            while first < len(order):
                before = filled[first - 1] if first else 0
                last = max(int(numpy.searchsorted(filled, before + most_bytes, side="right")), first + 1)
                part = batch.iloc[order[first : min(last, first + most_rows)]]
                yield pandas.DataFrame({"text_id": part["text_id"].values, **call(models[token], part)})
                first += len(part)

    id_type = df.schema["text_id"].dataType.simpleString()
    return df.mapInPandas(run, f"text_id {id_type}, {schema}")


def apply_backbone(texts: DataFrame, name: str, method: str) -> DataFrame:
    """Run one method of a registered model over ``text_id, text``, Arrow batch by batch."""
    metrics = list(METRICS)
    column = {"score": "score", "embed": "embedding", "zero_shot_score": "zero_shot_score"}.get(method)

    def call(model: Any, batch: pd.DataFrame) -> dict:
        values = getattr(model, method)(batch["text"].tolist())
        return {m: values[m] for m in metrics} if column is None else {column: list(values)}

    return _run_in_batches(texts.select("text_id", "text"), name, call, OUTPUTS[method])


def _answer_log_odds(prompts: DataFrame, name: str, yes: int, no: int) -> DataFrame:
    def call(model: Any, batch: pd.DataFrame) -> dict:
        ids = [list(map(int, row)) for row in batch["ids"]]
        return {"logits": [list(map(float, z)) for z in model.answer_logits(ids, batch["position"].tolist())]}

    logits = _run_in_batches(prompts.select("text_id", "ids", "position"), name, call, "logits array<double>", "ids")
    return logits.select("text_id", yes_no_log_odds(F.col("logits"), yes, no).alias("zero_shot_score"))


def causal_zero_shot_score(
    ids: DataFrame, name: str, prompt: Sequence[int], yes: int, no: int, max_length: int = 512,
    start: Sequence[int] = (), end: Sequence[int] = (),
) -> DataFrame:
    """``text_id, zero_shot_score``: question after the text, answer read at the last position.

    ``ids`` has ``text_id, ids``; the model sees whole prompts and answers with one logit
    vector per text.
    """
    built = ids.select("text_id", build_causal_prompt(F.col("ids"), prompt, max_length, start, end).alias("ids"))
    real = F.transform("ids", lambda _: F.lit(1))
    return _answer_log_odds(built.withColumn("position", last_real_position(real)), name, yes, no)


def cloze_zero_shot_score(
    ids: DataFrame, name: str, prefix: Sequence[int], mask: int, suffix: Sequence[int], yes: int, no: int,
    max_length: int = 512, start: Sequence[int] = (), end: Sequence[int] = (),
) -> DataFrame:
    """``text_id, zero_shot_score``: the answer is read at the masked slot, one pass."""
    cloze = build_cloze(F.col("ids"), prefix, mask, suffix, max_length, start, end)
    built = ids.select("text_id", cloze.alias("ids"))
    return _answer_log_odds(built.withColumn("position", mask_position(F.col("ids"), mask)), name, yes, no)


class PluggedModel:
    """A registered model behind the methods strategies call."""

    def __init__(self, name: str):
        self.name = name

    def score(self, texts: DataFrame) -> DataFrame:
        return apply_backbone(texts, self.name, "score")

    def pawn_metrics(self, texts: DataFrame) -> DataFrame:
        return apply_backbone(texts, self.name, "pawn_metrics")

    def embed(self, texts: DataFrame, vectors: DataFrame | None = None) -> DataFrame:
        return apply_backbone(texts, self.name, "embed")

    def zero_shot_score(self, texts: DataFrame) -> DataFrame:
        return apply_backbone(texts, self.name, "zero_shot_score")

    def fingerprint(self) -> dict[str, Any]:
        return {"backbone": self.name}
