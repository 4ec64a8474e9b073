"""An annotator labels batches inside tasks; the stub is deterministic and offline."""

from __future__ import annotations

import time
import zlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scratch import stored


class Annotator:
    """``batch`` words a call; ``label`` gives word to label for a batch, or raises."""

    batch, attempts, pause = 20, 4, (15, 30, 60)

    def label(self, words: list[str]) -> dict[str, str]:
        raise NotImplementedError


class Stub(Annotator):
    """Labels by a hash of the word."""

    def __init__(self, labels: tuple[str, ...]) -> None:
        self.labels = labels

    def label(self, words: list[str]) -> dict[str, str]:
        return {w: self.labels[zlib.crc32(w.encode()) % len(self.labels)] for w in words}


def annotated(words: DataFrame, annotator: Annotator, wait: Callable[[float], None] = time.sleep) -> DataFrame:
    """word, label: answers are matched exactly, then in lower case; a batch that fails every attempt gives nulls."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            asked = pdf["word"].dropna().tolist()
            for i in range(0, len(asked), annotator.batch):
                part = asked[i : i + annotator.batch]
                answer: dict[str, str] = {}
                for k in range(annotator.attempts):
                    try:
                        answer = annotator.label(part)
                        break
                    except (OSError, TimeoutError, ValueError):
                        if k + 1 < annotator.attempts:
                            wait(annotator.pause[min(k, len(annotator.pause) - 1)])
                lower = {w.lower(): v for w, v in answer.items()}
                yield pd.DataFrame({"word": part, "label": [answer.get(w, lower.get(w.lower())) for w in part]})

    return words.select("word").mapInPandas(run, "word string, label string")


def annotated_again(words: DataFrame, annotator: Annotator, wait: Callable[[float], None] = time.sleep) -> DataFrame:
    """As ``annotated``; the words that got no label are asked for once more, in batches of their own. Written once in between."""
    first = stored(annotated(words, annotator, wait))
    missing = first.where("label IS NULL OR trim(label) = ''")
    return first.where("trim(label) != ''").unionByName(annotated(missing.select("word"), annotator, wait))


def coerced(labels: DataFrame, allowed: tuple[str, ...], otherwise: str) -> DataFrame:
    """Labels in lower case, those not ``allowed`` as ``otherwise``."""
    low = F.lower(F.trim("label"))
    return labels.withColumn("label", F.when(low.isin(*allowed), low).otherwise(otherwise))
