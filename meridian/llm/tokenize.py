"""Encoding texts with a public byte-level BPE tokenizer by DuckDB queries."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TOKENIZERS = "/opt/tokenizers"
BYTE_BPE = "byte_bpe_50k.json"

# The vocabulary's split of a text into words. White space is the
# Unicode property, which leaves out the information separators.
_PATTERN = regex.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)
_ASCII = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r 0-9A-Za-z]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+")


def words(text: str) -> list[str]:
    """The words within which the tokenizer merges; together they are the text."""
    return _ASCII.findall(text) if text.isascii() else _PATTERN.findall(text)


#: One round contracts, in every word, the leftmost place of its pair of least rank.
#: Words without a pair in the merge table leave the recursion. The recursion keeps
#: the rounds of all words, so it gets words of at most ``LONG`` bytes and blocks whose
#: squared lengths add up to ``SQUARES``; longer words are contracted by ``contract``.
_CONTRACT = """
with recursive step(word, pos, token, round) as (
  select word, pos, token, 0 from start
  union all
  (with pairs as (
     select word, pos, token, round, lag(pos) over w as before, lead(token) over w as follower
     from step window w as (partition by word order by pos)),
   ranked as (
     select p.*, m.rank, m.token as merged, min(m.rank) over (partition by p.word) as least
     from pairs p left join merge m on m.first = p.token and m.second = p.follower),
   places as (
     select *, min(case when rank = least then pos end) over (partition by word) as place from ranked where least is not null)
   select word, pos, case when pos = place then merged else token end, round + 1 from places where before is distinct from place))
select word, list(token order by pos) as ids from step
where (word, round) in (select (word, max(round)) from step group by word)
group by word
"""


LONG, SQUARES, BLOCK = 256, 20_000_000, 400_000


def contract(tokens: list[int], merges: dict[tuple[int, int], tuple[int, int]]) -> list[int]:
    """Contract the leftmost pair of least rank of one word until none is left.

    Pairs wait in a heap by rank and place over a linked list, so time is
    n log n and memory linear in the bytes of the word, however long it is.
    """
    n = len(tokens)
    token, after, before = list(tokens), list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(*merges[p], i, *p) for i, p in enumerate(zip(token, token[1:])) if p in merges]
    heapify(heap)
    while heap:
        _, merged, i, first, second = heappop(heap)
        j = after[i]
        if token[i] != first or j >= n or token[j] != second:
            continue  # one of the two has been merged since
        token[i], token[j] = merged, -1
        k = after[i] = after[j]
        if k < n:
            before[k] = i
            if (pair := (merged, token[k])) in merges:
                heappush(heap, (*merges[pair], i, *pair))
        h = before[i]
        if h >= 0 and (pair := (token[h], merged)) in merges:
            heappush(heap, (*merges[pair], h, *pair))
    return [t for t in token if t >= 0]


class Vocabulary:
    """Merge table in DuckDB and a bounded memory of encoded words, per Python worker."""

    KEEP = 400_000  # words remembered; beyond it the memory starts anew

    def __init__(self, path: str):
        import duckdb

        model = json.loads(Path(path).read_text(encoding="utf-8"))["model"]
        ids = model["vocab"]
        pairs = [m.split(" ", 1) if isinstance(m, str) else m for m in model["merges"]]
        self.byte_ids = np.array([ids[ch] for ch in _byte_letters()], dtype=np.int32)
        merges = pa.table(
            {
                "first": pa.array([ids[a] for a, _ in pairs], pa.int32()),
                "second": pa.array([ids[b] for _, b in pairs], pa.int32()),
                "rank": pa.array(range(len(pairs)), pa.int32()),
                "token": pa.array([ids[a + b] for a, b in pairs], pa.int32()),
            }
        )
        self.merges = dict(zip(zip(merges["first"].to_pylist(), merges["second"].to_pylist()), zip(merges["rank"].to_pylist(), merges["token"].to_pylist())))
        # no folder of its own: nothing is spilled to the machine's disk
        self.con = duckdb.connect(config={"threads": 1, "memory_limit": "700MB", "temp_directory": ""})
        self.con.register("merges", merges)
        self.con.execute("create table merge as select * from merges")
        self.known: dict[str, tuple[int, ...]] = {}

    def learn(self, new: list[str]) -> None:
        """Encode words by the recursive query in blocks of bounded memory; very long ones by ``contract``."""
        if len(self.known) + len(new) > self.KEEP:
            self.known.clear()
        short: list[str] = []
        for w in new:
            # four bytes to a character at most
            if 4 * len(w) > LONG and len(raw := w.encode("utf-8", "surrogatepass")) > LONG:
                self.known[w] = tuple(contract(self.byte_ids[np.frombuffer(raw, dtype=np.uint8)].tolist(), self.merges))
            else:
                short.append(w)
        new, at = short, 0
        while at < len(new):
            size, squares, end = 0, 0, at
            raw = []
            while end < len(new) and (size < BLOCK and squares < SQUARES or end == at):
                raw.append(new[end].encode("utf-8", "surrogatepass"))
                size += len(raw[-1])
                squares += len(raw[-1]) ** 2
                end += 1
            lengths = np.array([len(b) for b in raw], dtype=np.int64)
            starts = np.cumsum(lengths) - lengths
            word = np.repeat(np.arange(len(raw), dtype=np.int32), lengths)
            start = pa.table(
                {
                    "word": word,
                    "pos": (np.arange(size) - np.repeat(starts, lengths)).astype(np.int32),
                    "token": self.byte_ids[np.frombuffer(b"".join(raw), dtype=np.uint8)],
                }
            )
            self.con.register("start", start)
            for w, ids in self.con.execute(_CONTRACT).fetchall():
                self.known[new[at + w]] = tuple(ids)
            self.con.unregister("start")
            at = end

    def _known_words(self, texts: list[str]) -> list[list[str]]:
        """The words of each text, all of them learnt."""
        split = [words(t) for t in texts]
        new = set().union(*split).difference(self.known) if split else ()
        if len(self.known) + len(new) > self.KEEP:
            self.known.clear()
            new = set().union(*split)
        if new:
            self.learn(sorted(new))
        return split

    def count(self, texts: list[str]) -> list[int]:
        """Number of tokens of each text."""
        split = self._known_words(texts)
        get = self.known.__getitem__
        return [sum(map(len, map(get, ws))) for ws in split]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Token ids of each text."""
        split = self._known_words(texts)
        get = self.known.__getitem__
        return [np.fromiter(chain.from_iterable(map(get, ws)), dtype=np.int32) for ws in split]


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in the vocabulary: printable bytes for themselves, the others from 256 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def _blocks(texts: list[str | None], most: int = 4_000_000) -> Iterator[list[str]]:
    """Texts in blocks of about ``most`` characters; null is as an empty text."""
    block: list[str] = []
    size = 0
    for t in texts:
        block.append(t or "")
        size += len(block[-1])
        if size >= most:
            yield block
            block, size = [], 0
    if block:
        yield block


def encode_texts(df: DataFrame, keys: list[str], text: str, tokenizers: str = TOKENIZERS, file: str = BYTE_BPE) -> DataFrame:
    """``keys`` and ``ids`` (array of int) of each row of ``df``, without special tokens.

    Null and empty texts have an empty array. Special tokens' names within a
    text are ordinary text. Rows are encoded where they lie: nothing is
    shuffled; repeated rows are encoded each. Other columns are ignored; a key
    called ``ids`` is an error. ``tokenizers`` is the folder of the vocabulary
    files, which every executor must have.

    Each Python worker keeps the merge table in DuckDB. The distinct words of a
    block that the worker has not met yet are encoded by one recursive query;
    unbroken words of more than ``LONG`` bytes, for which its memory would grow
    with the square of their length, by the same contraction over a heap.
    """
    if "ids" in keys:
        raise ValueError("a key column is called ids")
    schema = T.StructType([*(df.schema[k] for k in keys), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    path = f"{tokenizers}/{file}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        for batch in batches:
            at = 0
            for block in _blocks(batch.column(len(keys)).to_pylist()):
                ids = vocab.encode(block)
                offsets = np.zeros(len(ids) + 1, dtype=np.int32)
                np.cumsum([len(x) for x in ids], out=offsets[1:])
                made = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids)))
                part = batch.slice(at, len(block))
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keys)], made], names=[*keys, "ids"])
                at += len(block)

    return df.select(*keys, F.col(text).alias("_text")).mapInArrow(run, schema)
