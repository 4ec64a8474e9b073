"""Questions to an annotator that are asked once: a few at a time, and answers that outlive the task that got them.

Words are put into batches by a hash, so a task that runs again has the same batches.  A batch's answers are written to
a folder that all machines share before they are passed on, and a batch that has its file there is read, not asked.
An answer may have several fields, such as a tag and a rating: one call, two results.
"""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.formats import opened
from .base import Annotator

#: Batches that a task asks about at a time.
AT_A_TIME = 5


def asked_with_pauses(annotator: Annotator, words: list[str], wait: Callable[[float], None]) -> dict | None:
    """The annotator's answer, asked again after its pauses; None where every attempt fails."""
    for k in range(annotator.attempts):
        try:
            return annotator.label(words)
        except (OSError, TimeoutError, ValueError):
            if k + 1 < annotator.attempts:
                wait(annotator.pause[min(k, len(annotator.pause) - 1)])
    return None


class Answers:
    """A folder of answers, a file for each batch."""

    def __init__(self, path: str) -> None:
        self.path = path.rstrip("/")

    def key(self, words: list[str]) -> str:
        return hashlib.sha256(json.dumps(words).encode()).hexdigest()[:32]

    def read(self, key: str) -> dict | None:
        system, at = opened(f"{self.path}/{key}.json")
        try:
            with system.open_input_stream(at) as f:
                return json.loads(f.read())
        except (FileNotFoundError, ValueError):
            return None

    def write(self, key: str, answer: dict) -> None:
        """Aside first, then moved into place: a reader sees a whole file or none."""
        system, at = opened(self.path)
        system.create_dir(at, recursive=True)
        aside = f"{at}/.{key}-{uuid.uuid4().hex}"
        with system.open_output_stream(aside) as f:
            f.write(json.dumps(answer).encode())
        system.move(aside, f"{at}/{key}.json")


def asked_once(words: DataFrame, annotator: Annotator, path: str, *fields: str, at_a_time: int = AT_A_TIME, wait: Callable[[float], None] = time.sleep) -> DataFrame:
    """word and ``fields`` (or label) of each distinct word; null where every attempt failed, which is not kept and may be asked again.

    Answers are matched exactly, then in lower case.  ``path``: the shared folder of the answers.
    """
    names = list(fields) or ["label"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store = Answers(path)

        def batch(part: list[str]) -> pd.DataFrame:
            key = store.key(part)
            answer = store.read(key)
            if answer is None:
                answer = asked_with_pauses(annotator, part, wait)
                if answer is not None:
                    store.write(key, answer)
            lower = {w.lower(): v for w, v in (answer or {}).items()}
            found = [(answer or {}).get(w, lower.get(w.lower())) for w in part]
            columns = {f: [(v.get(f) if isinstance(v, dict) else v if f == "label" else None) for v in found] for f in names}
            return pd.DataFrame({"word": part} | {f: [None if v is None else str(v) for v in c] for f, c in columns.items()})

        with ThreadPoolExecutor(at_a_time) as pool:
            held: list[str] = []
            for pdf in frames:
                held += pdf["word"].tolist()
                whole = len(held) // annotator.batch * annotator.batch
                parts, held = [held[i : i + annotator.batch] for i in range(0, whole, annotator.batch)], held[whole:]
                for i in range(0, len(parts), at_a_time):  # a few batches wait for each other, so that no queue grows
                    yield from pool.map(batch, parts[i : i + at_a_time])
            if held:
                yield batch(held)

    distinct = words.select("word").where("word IS NOT NULL").distinct()
    dealt = distinct.repartition(distinct.sparkSession.sparkContext.defaultParallelism, "word").sortWithinPartitions("word")
    return dealt.mapInPandas(run, "word string, " + ", ".join(f"`{f}` string" for f in names))


def assessed(rows: DataFrame, annotator: Annotator, path: str, wait: Callable[[float], None] = time.sleep) -> DataFrame:
    """Tier rows without names and without words of tier 1 that are rated ``low``: the tag and the rating of one answer."""
    found = asked_once(rows, annotator, path, "tag", "rating", wait=wait)
    out = rows.join(found, "word", "left")
    name = F.lower(F.coalesce("tag", F.lit(""))).isin("name", "fantasy")
    low = (F.col("tier") == "tier_1_hard_usable") & (F.lower(F.coalesce("rating", F.lit(""))) == "low")
    return out.where(~name & ~low).drop("tag", "rating")
