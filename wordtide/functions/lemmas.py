"""Lemmas: a hook for a lemmatiser that takes many words at once, and one of suffix rules."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import text

#: Words that a lemmatiser is given at once.
BATCH = 1000

#: Irregular forms, and words that only look like inflected ones.
EXCEPTIONS = {
    "went": "go", "gone": "go", "thought": "think", "was": "be", "were": "be", "is": "be", "are": "be", "been": "be", "has": "have", "had": "have", "did": "do", "done": "do",
    "used": "use", "using": "use", "said": "say", "made": "make", "took": "take", "taken": "take", "came": "come", "saw": "see", "seen": "see", "knew": "know", "known": "know", "found": "find", "gave": "give", "given": "give",
    "men": "man", "women": "woman", "children": "child", "feet": "foot", "teeth": "tooth", "mice": "mouse", "people": "people", "better": "good", "best": "good", "worse": "bad", "worst": "bad",
    "this": "this", "his": "his", "news": "news", "during": "during", "thing": "thing", "nothing": "nothing", "something": "something", "anything": "anything", "everything": "everything",
    "morning": "morning", "evening": "evening", "king": "king", "ring": "ring", "bring": "bring", "spring": "spring", "string": "string", "need": "need", "indeed": "indeed", "hundred": "hundred", "red": "red", "bed": "bed",
}

#: (suffix, what stands in its place, letters before it at least); the longest suffix that fits a word decides.
RULES = [
    ("ies", "y", 2), ("sses", "ss", 1), ("ches", "ch", 1), ("shes", "sh", 1), ("xes", "x", 1), ("zes", "z", 1), ("ves", "f", 2), ("ss", "ss", 0), ("us", "us", 0), ("is", "is", 0), ("s", "", 2),
    ("ied", "y", 2), ("eed", "eed", 0), ("ed", "", 3), ("ying", "y", 2), ("ing", "", 3),
]


class Lemmatiser:
    """Takes a list of words and gives as many lemmas; one that gives another number is not followed for that list."""

    def lemmas(self, words: list[str]) -> list[str]:
        raise NotImplementedError


class RuleLemmatiser(Lemmatiser):
    """Exceptions first, then the longest suffix rule, found from the word's end in a trie of suffixes."""

    def __init__(self, rules: list[tuple[str, str, int]] | None = None, exceptions: dict[str, str] | None = None) -> None:
        self.exceptions = EXCEPTIONS if exceptions is None else exceptions
        self.root: dict = {}
        for suffix, put, least in RULES if rules is None else rules:
            node = self.root
            for c in reversed(suffix):
                node = node.setdefault(c, {})
            node[""] = (len(suffix), put, least)

    def one(self, word: str) -> str:
        w = word.lower()
        if w in self.exceptions:
            return self.exceptions[w]
        node, found = self.root, None
        for c in reversed(w):
            node = node.get(c)
            if node is None:
                break
            if "" in node and len(w) - node[""][0] >= node[""][2]:
                found = node[""]
        if found is None:
            return w
        stem = w[: len(w) - found[0]]
        if not found[1] and found[0] > 1:  # -ed, -ing: a doubled letter goes, an e that the ending took comes back
            if len(stem) > 2 and stem[-1] == stem[-2] and stem[-1] not in "aeiouls":
                return stem[:-1]
            if len(stem) > 1 and stem[-1] in "cvuz" or stem[-2:] in ("at", "bl", "iz", "us", "as") and len(stem) > 2:
                return stem + "e"
            if len(stem) == 3 and stem[1] in "aeiou" and stem[0] not in "aeiou" and stem[2] not in "aeiouwxy":
                return stem + "e"
        return stem + found[1]

    def lemmas(self, words: list[str]) -> list[str]:
        return [self.one(w) for w in words]


def lemmatised(words: DataFrame, lemmatiser: Callable[[], Lemmatiser] = RuleLemmatiser, batch: int = BATCH, column: str = "word") -> DataFrame:
    """word, lemma of each distinct word (lower case), so that the lemmatiser sees a word once whatever its count.

    ``lemmatiser`` is made in each task.  Where it raises or gives another number of lemmas than it was
    given words, all words of that batch get their rule-based singular.
    """
    made: dict = {}

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def asked(lists: pd.Series) -> pd.Series:
        own = made.setdefault("own", lemmatiser())

        def of(part):
            try:
                out = list(own.lemmas(list(part)))
            except Exception:  # noqa: BLE001  whatever a lemmatiser fails of, the batch has a way out
                return None
            return out if len(out) == len(part) else None

        return lists.map(of)

    distinct = words.select(F.lower(F.col(column)).alias("word")).where("word IS NOT NULL AND word != ''").distinct()
    parts = F.spark_partition_id()
    numbered = distinct.withColumn("at", F.monotonically_increasing_id()).withColumn("batch", F.floor(F.col("at").bitwiseAND((1 << 33) - 1) / batch)).withColumn("part", parts)
    lists = numbered.groupBy("part", "batch").agg(F.sort_array(F.collect_list("word")).alias("words"))  # ``batch`` words at most
    pairs = lists.select("words", asked("words").alias("lemmas")).select(F.posexplode("words").alias("i", "word"), "lemmas")
    return pairs.select("word", F.lower(F.coalesce(F.when(F.col("lemmas").isNotNull(), F.get("lemmas", F.col("i"))), text.singular(F.col("word")))).alias("lemma"))


def rolled_up(counts: DataFrame, lemmas: DataFrame, *keys: str) -> DataFrame:
    """Counts (keys, word, n) summed by lemma; a word that ``lemmas`` lacks is its own."""
    met = counts.join(lemmas, "word", "left")
    return met.groupBy(*keys, F.coalesce("lemma", "word").alias("word")).agg(F.sum("n").alias("n"))


def lemma_of(word: Column) -> Column:
    """The lemma by rules, for a column at hand."""
    rules = RuleLemmatiser()

    @F.pandas_udf(T.StringType())
    def one(words: pd.Series) -> pd.Series:
        return words.map(rules.one, na_action="ignore")

    return one(word)
