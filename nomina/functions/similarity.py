"""Indel likeness and the folding of dictionary tokens; Arrow UDFs where no built-in exists."""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType

from nomina import vocab


def indel_ratio(a: str, b: str) -> float:
    """200 times the longest common subsequence over both lengths, by bit-parallel rows; 100 for two empty strings."""
    if not a and not b:
        return 100.0
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        m = at.get(c, 0)
        hit = row & m
        row = ((row + hit) | (row - hit)) & full
    return 200.0 * (len(a) - bin(row).count("1")) / (len(a) + len(b))


@F.pandas_udf(DoubleType())
def token_sort_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """indel_ratio of two keys whose tokens are sorted already."""
    return pd.Series([indel_ratio(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


def alike(xs: list[str], ys: list[str], threshold: float) -> Iterator[tuple[int, np.ndarray]]:
    """(i, js): each place of xs with those of ys whose indel_ratio is threshold or more, all that there are. No empty strings.

    One x meets all y of fitting lengths and up to 64 characters at once, in rows of 64 bits; longer y one by one."""
    t = threshold / 200.0
    order = np.argsort([len(y) for y in ys], kind="stable")
    size = np.array([len(ys[k]) for k in order], np.int64)
    short = int(np.searchsorted(size, 64, "right"))
    masks: dict[str, np.ndarray] = {}
    for at, k in enumerate(order[:short]):
        for i, c in enumerate(ys[k]):
            if c not in masks:
                masks[c] = np.zeros(short, np.uint64)
            masks[c][at] |= np.uint64(1 << i)
    full = np.array([(1 << int(n)) - 1 for n in size[:short]], np.uint64)
    for i, x in enumerate(xs):
        n = len(x)
        # 200 min(m, n) >= threshold (m + n), loosely; the ratio itself decides
        lo, hi = np.searchsorted(size, [n * t / (1 - t) - 1e-6, n * (1 - t) / t + 1e-6 if t else np.inf], "left")
        to = min(hi, short)
        found = [np.zeros(0, np.int64)]
        if lo < to:
            row = full[lo:to].copy()
            for c in x:
                if c in masks:
                    hit = row & masks[c][lo:to]
                    row = ((row + hit) | (row - hit)) & full[lo:to]
            common = size[lo:to] - np.bitwise_count(row)
            found.append(order[lo:to][200.0 * common / (n + size[lo:to]) >= threshold])
        found.append(np.array([k for k in order[max(lo, short) : hi] if indel_ratio(x, ys[k]) >= threshold], np.int64))
        yield i, np.concatenate(found)


def fold_token(token: str) -> str:
    """Compatibility decomposition without combining marks, case folded, punctuation stripped at the ends."""
    plain = "".join(c for c in unicodedata.normalize("NFKD", token or "") if not unicodedata.combining(c))
    return plain.casefold().strip(".,;:'’\"()[]")


@F.pandas_udf(StringType())
def gazetteer_token(token: pd.Series) -> pd.Series:
    return token.map(fold_token)


_LONG = sorted(e for e in vocab.EPONYMS if len(e) >= 7 and " " not in e)
_EPONYMS = frozenset(vocab.EPONYMS)


@functools.lru_cache(200_000)
def eponym_of(token: str) -> str | None:
    """The eponym that a token names: exactly, or at 7 letters and more by a likeness of 90."""
    if token in _EPONYMS:
        return token
    if len(token) < 7:
        return None
    n = len(token)
    near = [e for e in _LONG if 200 * min(n, len(e)) >= 90 * (n + len(e))]  # the others can't be that much alike
    best = max(near, key=lambda e: indel_ratio(token, e), default="")
    return best if indel_ratio(token, best) >= 90 else None


@F.pandas_udf(ArrayType(StringType()))
def eponyms(tokens: pd.Series) -> pd.Series:
    """Of each array of tokens those eponyms that they name, in order; null where a token names none."""
    return tokens.map(lambda ts: [eponym_of(t) for t in ts] if ts is not None else [])
