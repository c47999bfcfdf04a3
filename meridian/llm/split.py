"""Splitting oversized texts at natural boundaries, with an overlap."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Whitespace: the Unicode spaces and the information separators, as Python's ``str.isspace`` has them.
SPACES = r"\t-\r\x1c-\x20\x85\xa0  -     　"
WORD = rf"[^{SPACES}]+"
_WORD = re.compile(WORD)

#: Strength of the boundary after a word.
NONE, COMMA, CLAUSE, SENTENCE, LINE, PARAGRAPH = range(6)
_SENTENCE = re.compile(r"[.!?…。！？]['\"”’»)\]]*$")
_CLAUSE = re.compile(r"[;:–—]['\"”’»)\]]*$|^[-–—]$")
_COMMA = re.compile(r",['\"”’»)\]]*$")
_ABBREVIATION = re.compile(r"(?:^|[(\"'“])(?:[a-z]|mr|mrs|ms|dr|no|nos|inc|corp|co|ltd|vs|etc|st|jr|sr|fig|sec|art|approx|e\.g|i\.e|u\.s)\.$", re.I)


def boundary_strengths(words: list[str], gaps: list[str]) -> np.ndarray:
    """Strength of the cut after each word; ``gaps[i]`` is the whitespace that follows word i."""
    out = np.zeros(len(words), dtype=np.int64)
    for i, w in enumerate(words):
        last = w[-1]
        if last.isalnum():
            strength = NONE
        elif _SENTENCE.search(w):
            follows = words[i + 1][0] if i + 1 < len(words) else "A"
            strength = COMMA if _ABBREVIATION.search(w) or follows.islower() else SENTENCE
        elif _CLAUSE.search(w):
            strength = CLAUSE
        else:
            strength = COMMA if _COMMA.search(w) else NONE
        gap = gaps[i]
        if len(gap) > 1 or gap != " ":
            lines = gap.count("\n") + 2 * gap.count("\u2029")
            if lines > 1:
                strength = PARAGRAPH
            elif lines == 1:
                strength = max(strength, LINE)
        out[i] = strength
    return out


class RangeMaximum:
    """Sparse table over strengths: position of the strongest boundary in a range, ties to the right.

    Level j holds the best of each 2**j neighbours; only the levels that windows
    up to ``widest`` need are built.
    """

    def __init__(self, strengths: np.ndarray, widest: int):
        n = len(strengths)
        self.n = n
        keyed = strengths.astype(np.int64) * n + np.arange(n)
        self.levels = [keyed]
        width = 1
        while 2 * width <= min(widest, n):
            below = self.levels[-1]
            self.levels.append(np.maximum(below[: n - 2 * width + 1], below[width : n - width + 1]))
            width *= 2

    def strongest(self, lo: int, hi: int) -> int:
        """The strongest position in ``[lo, hi]``."""
        j = (hi - lo + 1).bit_length() - 1
        level = self.levels[j]
        return int(max(level[lo], level[hi - (1 << j) + 1]) % self.n)


def pieces(text: str, max_words: int, overlap: int) -> list[tuple[int, int, int, int, int]]:
    """``(first word, words, first character, end character, strength of the cut)`` of each piece.

    A text of at most ``max_words`` words is one piece, without words it is none.
    """
    spans = [m.span() for m in _WORD.finditer(text)]
    n = len(spans)
    if n <= max_words:
        return [(0, n, spans[0][0], spans[-1][1], PARAGRAPH)] if n else []
    words = [text[a:b] for a, b in spans]
    gaps = [text[spans[i][1] : spans[i + 1][0]] for i in range(n - 1)] + ["\n\n"]
    strengths = boundary_strengths(words, gaps)
    least = max(max_words // 2, overlap + 1)
    index = RangeMaximum(strengths, max_words - least + 1)
    out, start = [], 0
    while n - start > max_words:
        cut = index.strongest(start + least - 1, start + max_words - 1)
        out.append((start, cut + 1 - start, spans[start][0], spans[cut][1], int(strengths[cut])))
        start = cut + 1 - overlap
    out.append((start, n - start, spans[start][0], spans[-1][1], PARAGRAPH))
    return out




def split_oversized(df: DataFrame, keys: list[str], text: str, max_words: int = 350, overlap: int = 40) -> DataFrame:
    """Texts of more than ``max_words`` words as overlapping pieces of at most that many.

    Gives ``keys`` and ``piece_no`` (from 0), ``piece_from`` (its first word in
    the text), ``piece_words``, ``piece_cut`` (strength of the boundary it ends
    at: 5 paragraph or end of text, 4 line, 3 sentence, 2 clause, 1 comma, 0
    none) and ``piece_text`` (a stretch of the text, its spaces kept). A piece
    starts ``overlap`` words before the end of the previous one. Each cut is the
    strongest boundary that leaves the piece between half of ``max_words`` and
    ``max_words`` words, the rightmost of equals; in a text without any
    boundary it is the last permissible word.

    Texts with fewer words, empty and null ones give no rows. Repeated rows
    (equal keys and text) count once; rows with equal keys and different texts
    are each split. Null keys are kept. Other columns are ignored; key columns
    called ``piece_...`` as in the result are an error. The word count runs in
    the JVM: only oversized texts are shuffled and reach Python.
    """
    if not 0 <= overlap < max_words // 2:
        raise ValueError("the overlap must be less than half of max_words")
    schema = T.StructType([df.schema[k] for k in keys] + [T.StructField("piece_text", T.StringType())])
    out = T.StructType([df.schema[k] for k in keys])
    if any(k.startswith("piece_") for k in keys):
        raise ValueError("key columns must not be called piece_...")
    for name, kind in (("piece_no", T.IntegerType()), ("piece_from", T.LongType()), ("piece_words", T.IntegerType()), ("piece_cut", T.IntegerType()), ("piece_text", T.StringType())):
        out.add(name, kind)
    rows = df.select(*keys, F.col(text).alias("piece_text"))
    # so many words need so many characters; the count itself is the dearer test
    oversized = (F.length("piece_text") > 2 * max_words) & (F.regexp_count("piece_text", F.lit(WORD)) > max_words)
    rows = rows.where(oversized).distinct()
    names = schema.names

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            at, found = [], []
            for i, t in enumerate(batch["piece_text"]):
                for k, (first, words, a, b, strength) in enumerate(pieces(t, max_words, overlap)):
                    at.append(i)
                    found.append((k, first, words, strength, t[a:b]))
            part = batch[names[:-1]].iloc[at].reset_index(drop=True)
            made = pd.DataFrame(found, columns=["piece_no", "piece_from", "piece_words", "piece_cut", "piece_text"])
            yield pd.concat([part, made], axis=1)

    return rows.mapInPandas(run, out)
