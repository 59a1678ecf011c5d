"""Small functions that SQL has no counterpart for, as Arrow-batched UDFs."""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factweir.functions.letters import normal

#: Scale words after a number.
SCALES = {"thousand": 1e3, "million": 1e6, "mn": 1e6, "billion": 1e9, "bn": 1e9, "trillion": 1e12}


def indel(a: str, b: str) -> float:
    """200 * longest common subsequence / total length, by bit-parallel rows; 100 for two empty texts."""
    if not a and not b:
        return 100.0
    where: dict[str, int] = {}
    for i, ch in enumerate(a):
        where[ch] = where.get(ch, 0) | 1 << i
    row, full = (1 << len(a)) - 1, (1 << len(a)) - 1
    for ch in b:
        hit = row & where.get(ch, 0)
        row = ((row + hit) | (row - hit)) & full
    return 200.0 * (len(a) - bin(row).count("1")) / (len(a) + len(b))


def token_set(a: str, b: str) -> float:
    """Best ratio among the shared words and the shared words with either side's others."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both, left, right = (" ".join(sorted(s)) for s in (x & y, x - y, y - x))
    if both and (not left or not right):
        return 100.0
    one, two = f"{both} {left}".strip(), f"{both} {right}".strip()
    return max([indel(one, two), *((indel(both, one), indel(both, two)) if both else ())])


#: How numbers are written, as (expression, sign between thousands, sign before decimals): grouped by
#: commas, spaces or dots, and plain. A text is read in every way that fits.
NOTATIONS = (
    (r"(?<![\d.])(\d{1,3}(?:,\d{3})+)(\.\d+)?", ",", "."),
    (r"(?<![\d.,])(\d{1,3}(?: \d{3})+)(\.\d+)?(?![\d,])", " ", "."),
    (r"(?<![\d,.])(\d{1,3}(?:\.\d{3}){2,})(,\d+)?(?![\d.])", ".", ","),
    (r"(?<![\d,])(\d+)(\.\d+)?(?!\d|,\d)", "", "."),
)
_NOTATIONS = [(re.compile(x), group, point) for x, group, point in NOTATIONS]
_DIGIT = re.compile(r"\d")
_SCALE_WORD = re.compile(r"\s*(" + "|".join(SCALES) + r")\b")


def numbers(text: str) -> list[float]:
    """All readings of the numbers of a text, by notation and then in order, each also scaled by a word right after it.

    `1.234` is a plain number; `1.234.567,8` is read as grouped by dots, and so are its plain parts.
    """
    t = normal(text)
    first, out = _DIGIT.search(t), []
    if not first:
        return out
    for expression, group, point in _NOTATIONS:
        if group not in t or (group == "." and t.count(".") < 2):
            continue
        for m in expression.finditer(t, first.start()):
            whole = m[1].replace(group, "") if group else m[1]
            out.append(float(whole + (m[2] or "").replace(point, ".")))
            if word := _SCALE_WORD.match(t[m.end() : m.end() + 12]):
                out.append(out[-1] * SCALES[word[1]])
    return out


def chunk_spans(text: str, size: int = 1100) -> list[tuple[int, int]]:
    """Consecutive spans of at most `size` characters, without the blanks between them.

    A span that isn't the last ends at the last blank of its second half, if that half has one. Blanks are
    located once for the whole text, so the work grows with its length alone.
    """
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    blanks, inked = np.flatnonzero(points == 32), np.flatnonzero(points != 32)
    spans: list[tuple[int, int]] = []
    start, total = 0, len(points)
    while start < total:
        stop = start + size
        if stop >= total:
            spans.append((start, total))
            break
        last = int(np.searchsorted(blanks, stop)) - 1
        if last >= 0 and blanks[last] >= start + size // 2:
            stop = int(blanks[last])
        spans.append((start, stop))
        following = int(np.searchsorted(inked, stop))
        start = int(inked[following]) if following < len(inked) else total
    return spans


#: Anchors of a text: bytes of a gram, and of how many neighbouring grams the least hash is kept. A substring of
#: gram + window - 1 bytes has an anchor of its own, which every text that holds it has too.
LONG_ANCHORS, SHORT_ANCHORS = (24, 17), (12, 3)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def anchor_hashes(text: str, gram: int, window: int) -> np.ndarray:
    """Distinct hashes of the grams (12 or more bytes, by fours) of which each is the least of some window."""
    b = np.frombuffer(text.encode("utf-8", "replace"), dtype=np.uint8)
    if len(b) < gram + window - 1:
        return np.zeros(0, dtype=np.int64)
    words = np.zeros(len(b) - 3, dtype=np.uint64)
    for i in range(4):
        words |= b[i : len(b) - 3 + i].astype(np.uint64) << np.uint64(8 * i)
    n = len(b) - gram + 1
    h = np.zeros(n, dtype=np.uint64)
    for at in range(0, gram, 4):
        h = _mixed(h + words[at : at + n])
    least = h[: n - window + 1].copy()
    for i in range(1, window):
        np.minimum(least, h[i : n - window + 1 + i], out=least)
    return np.unique(least).view(np.int64)


@F.pandas_udf(T.ArrayType(T.LongType()))
def long_anchors(text: pd.Series) -> pd.Series:
    return text.map(lambda x: anchor_hashes(x or "", *LONG_ANCHORS))


@F.pandas_udf(T.ArrayType(T.LongType()))
def short_anchors(text: pd.Series) -> pd.Series:
    return text.map(lambda x: anchor_hashes(x or "", *SHORT_ANCHORS))


@F.pandas_udf(T.DoubleType())
def indel_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([indel(x or "", y or "") for x, y in zip(a, b, strict=True)])


@F.pandas_udf(T.DoubleType())
def token_set_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([token_set(x or "", y or "") for x, y in zip(a, b, strict=True)])


@F.pandas_udf(T.StringType())
def nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def numbers_in(text: pd.Series) -> pd.Series:
    return text.map(lambda x: numbers(x or ""))


_CHUNK = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("body", T.StringType())])


def chunks_of(size: int) -> Callable[[Column], Column]:
    """The chunks of a text, of at most `size` characters each, as an array of (start, end, body)."""

    @F.pandas_udf(T.ArrayType(_CHUNK))
    def chunks(text: pd.Series) -> pd.Series:
        return text.map(lambda x: [{"start": a, "end": b, "body": x[a:b]} for a, b in chunk_spans(x, size)] if x else [])

    return chunks


def ratio_at_least(a: str, b: str, least: float) -> float:
    """`indel` of two texts, or 0 where it is below `least`: counts of letters, then of pairs of letters, bound it."""
    if not a or not b:
        return 100.0 if a == b else 0.0
    need = least * (len(a) + len(b)) / 200
    if sum((Counter(a) & Counter(b)).values()) < need:
        return 0.0
    # a common subsequence of n letters is cut by at most one break for each letter that is left out
    pairs = sum((Counter(zip(a, a[1:], strict=False)) & Counter(zip(b, b[1:], strict=False))).values())
    if pairs < need - 1 - (len(a) + len(b) - 2 * need):
        return 0.0
    got = indel(a, b)
    return got if got >= least else 0.0


def ratio_from(least: float) -> Callable[[str, str], Column]:
    """`ratio_at_least` of two columns."""

    @F.pandas_udf(T.DoubleType())
    def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([ratio_at_least(x or "", y or "", least) for x, y in zip(a, b, strict=True)], dtype="float64")

    return ratio
