"""Functions that columns can't express: vectorised Pandas UDFs over small stdlib helpers."""

from __future__ import annotations

import html
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp similarity, which is not symmetric; 0 where either side is empty."""
    return pd.Series([SequenceMatcher(None, x, y).ratio() if x and y else 0.0 for x, y in zip(a, b, strict=True)], dtype=float)


@F.pandas_udf(T.StringType())
def html_unescaped(text: pd.Series) -> pd.Series:
    return text.map(html.unescape, na_action="ignore")


def split_message(text: str, most: int) -> list[str]:
    out, start = [], 0
    while start < len(text):
        end = start + most
        if end < len(text) and (line := text.rfind("\n", start, end)) >= 0:
            end = line + 1
        out.append(text[start:end])
        start = end
    return out


def message_chunks(text, most: int = 4096):
    """Chunks of at most ``most`` characters, cut behind their last newline if they have one."""

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def chunks(texts: pd.Series) -> pd.Series:
        return texts.map(lambda x: split_message(x or "", most))

    return chunks(text)


def singular_form(word: str) -> str:
    """``text.singular`` of one word."""
    w, n = word.lower(), len(word)
    if n <= 3:
        return word
    if n > 4 and w.endswith("ies"):
        return w[:-3] + "y"
    if n > 4 and w.endswith(("ches", "shes", "xes", "zes", "ses")):
        return w[:-2]
    if n > 4 and w.endswith("ves"):
        return w[:-3] + "f"
    return w[:-1] if w.endswith("s") and not w.endswith(("ss", "us", "is", "as", "os")) else w


class Tokens:
    """The token arrays of some rows as numbers: ``code`` and ``row`` of every token, all rows laid end to end."""

    def __init__(self, column: pa.Array) -> None:
        lists = column.cast(pa.large_list(pa.string()))
        encoded = lists.flatten().dictionary_encode()
        self.words, self.code = encoded.dictionary, encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.row = np.repeat(np.arange(len(lists)), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))

    def renamed(self, name):
        """The tokens under the names that ``name`` gives to each distinct one."""
        encoded = pa.array([name(x) for x in self.words.to_pylist()], pa.string()).dictionary_encode()
        self.words, self.code = encoded.dictionary, encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64)[self.code]
        return self

    def among(self, words) -> np.ndarray:
        """For each token whether it is one of ``words``."""
        return pc.is_in(self.words, value_set=pa.array(sorted(set(words)), pa.string())).to_numpy(zero_copy_only=False)[self.code] if len(self.code) else np.zeros(0, bool)

    def joined(self, at: np.ndarray, size: int) -> list[str]:
        """The ``size`` tokens from each position of ``at`` on, parted by spaces."""
        parts = [self.words.take(pa.array(self.code[at + k])).to_pylist() for k in range(size)]
        return [" ".join(x) for x in zip(*parts, strict=True)]

    def counted(self, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the n-grams at the positions ``at``: for each, the first position of its like in its row and how many there are."""
        key = self.row[at]
        for k in range(size):
            _, key = np.unique(key * (len(self.words) + 1) + self.code[at + k], return_inverse=True)
        _, first, own, n = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
        return at[first], own, n

    def starts(self, size: int) -> np.ndarray:
        """Positions from which a row has ``size`` tokens."""
        at = np.arange(max(len(self.code) - size + 1, 0))
        return at[self.row[at] == self.row[at + size - 1]]

    def repeated(self, least: int, most: int, occurrences: int):
        """(first positions, size, counts) of n-grams that a row holds ``occurrences`` times: only such can be longer ones' heads."""
        at = self.starts(1)
        for size in range(1, most + 1):
            at = at[(at + size <= len(self.code))]
            at = at[self.row[at] == self.row[at + size - 1]]
            first, own, n = self.counted(at, size)
            often = n >= occurrences
            if size >= least:
                yield first[often], size, n[often]
            at = at[often[own]]


def token_slices(batches, column: int, most: int = 250_000):
    """The batches in slices of some rows, of about ``most`` tokens in all: what a worker holds beside a batch grows with these alone."""
    for batch in batches:
        sizes = np.append(0, np.cumsum(batch.column(column).value_lengths().fill_null(0).to_numpy(zero_copy_only=False)))
        i = 0
        while i < len(batch):
            j = max(i + 1, int(np.searchsorted(sizes, sizes[i] + most, "right")) - 1)
            yield batch.slice(i, j - i)
            i = j
