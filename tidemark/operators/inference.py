"""Predictions from a pluggable scorer. The model itself isn't part of the engine.

A scorer is made once per worker by a factory and reads batches of prompts. What it gives back are texts, or
log-probabilities of whole answers; everything after that is expressions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import DIRECTIONS, MATERIALITIES, argmax_label, softmax
from ..functions.text import parse_response, response


class TextScorer(Protocol):
    def generate(self, prompts: list[str], max_new_tokens: int) -> list[str]: ...


class LogProbScorer(Protocol):
    def log_probs(self, prompt: str, completions: list[str]) -> list[float | None]:
        """Of each completion after the prompt; None where nothing of it is left to score."""


def shared_prefix(before: Sequence[int], whole: Sequence[int]) -> int:
    """How many leading tokens a prompt has in common with the prompt and its completion.

    A tokenizer may join the prompt's end with the completion's start, so the prompt's length alone doesn't tell.
    """
    n = min(len(before), len(whole))
    return next((i for i in range(n) if before[i] != whole[i]), n)


def completion_log_prob(before: Sequence[int], whole: Sequence[int], log_probs: Sequence[float]) -> float | None:
    """Log-probability of what follows the common tokens; log_probs[i] is that of whole[i] after those before it.

    None where nothing follows.
    """
    start = shared_prefix(before, whole)
    return float(sum(log_probs[start : len(whole)])) if start < len(whole) else None


def greedy_infer(prompts: DataFrame, factory: Callable[[], TextScorer], text: str = "text", batch: int = 8, max_new_tokens: int = 24) -> DataFrame:
    """Adds raw_response, pred_direction and pred_materiality; malformed answers are null."""
    schema = prompts.drop(text).schema.simpleString()[7:-1] + ", raw_response string"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = factory()
        for frame in frames:
            texts = frame[text].tolist()
            answers = [a for i in range(0, len(texts), batch) for a in scorer.generate(texts[i : i + batch], max_new_tokens)]
            yield frame.drop(columns=[text]).assign(raw_response=answers)

    out = prompts.mapInPandas(run, schema)
    direction, material = parse_response(F.col("raw_response"))
    return out.withColumn("pred_direction", direction).withColumn("pred_materiality", material)


def prob_infer(prompts: DataFrame, factory: Callable[[], LogProbScorer], text: str = "text") -> DataFrame:
    """Adds the seven pred_ columns: directions first, then materiality given the likeliest direction.

    A prompt for which some completion couldn't be scored has no prediction.
    """
    schema = prompts.drop(text).schema.simpleString()[7:-1] + ", log_d array<double>, log_m array<double>"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = factory()
        for frame in frames:
            ds, ms = [], []
            for prompt in frame[text]:
                d = scorer.log_probs(prompt, [f"Direction: {x}" for x in DIRECTIONS])
                if any(x is None for x in d):
                    ds.append(None)
                    ms.append(None)
                    continue
                best = DIRECTIONS[d.index(max(d))]
                m = scorer.log_probs(prompt, [f"Direction: {best}\nMateriality: {x}" for x in MATERIALITIES])
                ds.append(list(d))
                ms.append(None if any(x is None for x in m) else list(m))
            yield frame.drop(columns=[text]).assign(log_d=ds, log_m=ms)

    out = prompts.mapInPandas(run, schema).withColumn("p", softmax(F.col("log_d"))).withColumn("q", softmax(F.col("log_m")))
    whole = F.col("p").isNotNull() & F.col("q").isNotNull()
    columns = {"pred_direction": argmax_label(F.col("p"))} | {f"pred_p_{d}": F.col("p")[i] for i, d in enumerate(DIRECTIONS)}
    columns |= {"pred_materiality": argmax_label(F.col("q"), MATERIALITIES)} | {f"pred_p_{m}": F.col("q")[i] for i, m in enumerate(MATERIALITIES)}
    return out.withColumns({k: F.when(whole, v) for k, v in columns.items()}).drop("log_d", "log_m", "p", "q")


__all__ = ["LogProbScorer", "TextScorer", "completion_log_prob", "greedy_infer", "prob_infer", "response", "shared_prefix"]
