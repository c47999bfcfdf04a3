"""Same and almost same records across splits, by a sparse suffix array.

The texts are put end to end; symbols are words, ordered by their hashes. Of each
text those suffixes are kept that start at its rarest distinct shingles
(sequences of ``SHINGLE`` words), by one order for the whole corpus from rare to
frequent. Two texts of similarity ``LEAST`` have one of the first
``n - ceil(LEAST * n) + 1`` of their n shingles in common, on both sides, whatever
the length of the texts and wherever they differ. So keeping these loses no pair.

The suffixes are ordered by their first words over range partitions. Where
neighbours have a common prefix of ``SHINGLE`` words or more, a run of the suffix
array shows a shared span. Members of a run from different splits are candidates
if their numbers of shingles, the places of the shared one in the order and
parity sketches of their coverage allow the similarity; these bounds lose no
pair. An exact test follows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from meridian.functions.wordhash import Words, mix
from meridian.session import checkpointed, estimated_bytes, shuffle_partitions

SHINGLE, LEAST = 3, 0.6
SLOTS = 1 << 21  # counters of the frequency sketch, one byte each when broadcast
FEW = 1_000_000  # ids up to which a broadcast stands in for a shuffle of texts
SAMPLE = 4096  # keys from which the bounds of the range partitions are taken; they matter for balance alone
BUCKET_ROWS = 4_000_000  # suffixes to a range partition
HOT_RUN = 50_000  # a run of more suffixes is cut into fragments of its training texts
_BLOCK = 2_000_000  # pairs looked at together

_U = np.uint64


def _slot(h: np.ndarray) -> np.ndarray:
    return (h >> _U(7)).astype(np.int64) & (SLOTS - 1)


def _chunks(column: pa.Array, most_texts: int = 1 << 16, most_bytes: int = 16 << 20) -> Iterator[tuple[int, pa.Array]]:
    """Slices of texts, of bounded number and, unless one text is longer, of bounded size, with their offsets."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(column):
        before = ends[at - 1] if at else 0
        stop = min(max(int(np.searchsorted(ends, before + most_bytes, side="right")), at + 1), at + most_texts)
        yield at, column.slice(at, stop - at)
        at = stop


class Suffixes:
    """The suffixes of some texts, end to end, that are SHINGLE words long at least."""

    def __init__(self, texts: pa.Array):
        words = Words(texts)
        self.symbols = words.hashes
        owner = np.repeat(np.arange(len(words.sizes)), words.sizes)
        inside = max(len(owner) - SHINGLE + 1, 0)
        self.at = np.flatnonzero(owner[:inside] == owner[SHINGLE - 1 : SHINGLE - 1 + inside])
        self.owner = owner[self.at]

    def key(self, at: np.ndarray) -> np.ndarray:
        """First three words of suffixes, 20, 22 and 22 bits of each: the order of keys is that of the words."""
        h = self.symbols
        return (h[at] & ~_U(2**44 - 1)) | ((h[at + 1] >> _U(20)) & _U((2**22 - 1) << 22)) | (h[at + 2] >> _U(42))


# --- frequencies -------------------------------------------------------------------

_PARTS, _FAN_IN = 16, 64
_SKETCHED = "part int, lane int, counts binary"


def _thinned(keys: np.ndarray) -> np.ndarray:
    return keys if len(keys) <= SAMPLE else np.random.default_rng(len(keys)).choice(keys, SAMPLE, replace=False)


def _sketch_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    lane = TaskContext.get().partitionId()
    counts = np.zeros(SLOTS, dtype=np.int64)
    sample = np.zeros(0, dtype=np.uint64)
    for batch in batches:
        for _, texts in _chunks(batch.column(0)):
            suffixes = Suffixes(texts)
            key = suffixes.key(suffixes.at)
            counts += np.bincount(_slot(mix(key)), minlength=SLOTS)
            sample = _thinned(np.concatenate([sample, key[:: max(len(key) // SAMPLE, 1)]]))
    parts = [(i, part.astype(np.uint64)) for i, part in enumerate(np.split(counts, _PARTS)) if part.any()]
    for i, part in [*parts, (_PARTS, sample)]:
        yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([lane], pa.int32()), pa.array([zlib.compress(part.tobytes(), 1)])], names=["part", "lane", "counts"])


def _sketch_sum(table: pa.Table) -> pa.Table:
    """Add up the sketches, and thin out the samples, of up to ``_FAN_IN`` tasks."""
    parts = [np.frombuffer(zlib.decompress(raw), dtype=np.uint64) for raw in table.column("counts").to_pylist()]
    total = _thinned(np.concatenate(parts)) if table.column("part")[0].as_py() == _PARTS else np.sum(parts, axis=0, dtype=np.uint64)
    return pa.table({"part": table.column("part")[:1], "lane": table.column("lane")[:1], "counts": pa.array([zlib.compress(total.tobytes(), 1)])})


def frequencies(texts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """How often each shingle stands in all texts, by slots of a sketch, and a sample of keys.

    Every text counts. The sketch has a fixed size, so what reaches the driver
    and is broadcast does not grow with the data; the sketches of the tasks are
    added up by a tree. Hashes that share a slot make a shingle seem more
    frequent than it is, which changes the order of shingles but loses none.
    """
    level = texts.mapInArrow(_sketch_task, _SKETCHED)
    lanes = max(texts.rdd.getNumPartitions(), 1)
    while True:
        level = level.withColumn("lane", F.floor(F.col("lane") / _FAN_IN).cast("int")).groupBy("part", "lane").applyInArrow(_sketch_sum, _SKETCHED)
        lanes = -(-lanes // _FAN_IN)
        if lanes == 1:
            break
    counts = np.zeros((_PARTS, SLOTS // _PARTS), dtype=np.uint64)
    sample = np.zeros(0, dtype=np.uint64)
    for r in level.collect():
        found = np.frombuffer(zlib.decompress(r["counts"]), dtype=np.uint64)
        if r["part"] == _PARTS:
            sample = found
        else:
            counts[r["part"]] = found
    return counts.reshape(-1), sample


def _steps(counts: np.ndarray) -> np.ndarray:
    """A quarter of an octave to a step: a byte holds any count."""
    return np.ceil(4 * np.log2(counts.astype(np.float64) + 1)).astype(np.uint8)


def _bounds(sample: np.ndarray, steps: np.ndarray, buckets: int) -> np.ndarray:
    """Lower bounds of all range partitions but the first, from those sampled keys that are rare enough to be kept."""
    if not len(sample):
        return np.zeros(0, dtype=np.uint64)
    step = steps[_slot(mix(sample))]
    keys = np.sort(sample[step <= np.quantile(step, 1 - LEAST)])
    return np.unique(keys[np.arange(1, buckets) * len(keys) // buckets])


# --- the sparse suffix array ---------------------------------------------------------

_WORDS = 3  # 64-bit words of the parity sketch that goes with a text


def _distinct_shingles(suffixes: Suffixes, steps: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order value, text number and first place of the distinct shingles, text by text; rarest first, if steps are given.

    The order value has 8 bits for the step and 36 of the hash.
    """
    h = mix(suffixes.key(suffixes.at))
    value = (suffixes.owner.astype(np.uint64) << _U(44)) | (h >> _U(28))
    if steps is not None:
        value |= steps[_slot(h)].astype(np.uint64) << _U(36)
    if not len(value):
        return value, suffixes.owner, suffixes.at
    index = np.argsort(value)
    value = value[index]
    start = np.flatnonzero(np.r_[True, value[1:] != value[:-1]])
    first = np.minimum.reduceat(suffixes.at[index], start)
    value = value[start]
    return value & _U(2**44 - 1), (value >> _U(44)).astype(np.int64), first


def _parities(value: np.ndarray, owner: np.ndarray, count: int, words: int) -> np.ndarray:
    """For each text 64 bits x ``words``: bit i is the parity of the number of its distinct shingles that hash to i.

    Two texts whose sketches differ in d bits have at least d shingles that only one of them has.
    """
    bits = 64 * words
    bit = ((value & _U(2**36 - 1)) % _U(bits)).astype(np.int64)
    odd = (np.bincount(owner * bits + bit, minlength=count * bits) & 1).astype(np.uint8)
    return np.packbits(odd.reshape(count, bits), axis=1, bitorder="little").view(np.uint64)


def kept_suffixes(texts: pa.Array, steps: np.ndarray) -> tuple[np.ndarray, ...]:
    """``(key, text number, rank)`` of the suffixes that are kept, and ``(shingles, sketch)`` of all texts.

    Kept are the suffixes at the rarest shingles of each text, as many as ``LEAST`` needs one of.
    """
    suffixes = Suffixes(texts)
    value, owner, first = _distinct_shingles(suffixes, steps)
    n = np.bincount(owner, minlength=len(texts)).astype(np.int64)
    kept = np.where(n > 0, n - np.ceil(LEAST * n - 1e-9).astype(np.int64) + 1, 0)
    rank = np.arange(len(owner)) - (np.cumsum(n) - n)[owner]
    chosen = rank < kept[owner]
    return suffixes.key(first[chosen]), owner[chosen], rank[chosen], n, _parities(value, owner, len(texts), _WORDS)


_COLUMNS = ("keys", "text", "rank", "record", "n", "side", "sketch")
_PACKED = "bucket int, n_rows int, n_texts int, " + ", ".join(f"{c} binary" for c in _COLUMNS)
_ROW_TYPES = {"keys": np.uint64, "text": np.uint32, "rank": np.uint32}
_TEXT_TYPES = {"record": np.int64, "n": np.int32, "side": np.int8, "sketch": np.uint64}


def _pack(column: np.ndarray) -> bytes:
    """Bytes of like weight side by side, compressed."""
    flat = np.ascontiguousarray(column)
    return pa.compress(np.ascontiguousarray(flat.view(np.uint8).reshape(-1, flat.itemsize).T).tobytes(), codec="zstd", asbytes=True) if flat.size else b""


def _unpack(raw: bytes, dtype, count: int) -> np.ndarray:
    if not count:
        return np.zeros(0, dtype=dtype)
    size = np.dtype(dtype).itemsize
    flat = np.frombuffer(pa.decompress(raw, decompressed_size=count * size, codec="zstd", asbytes=True), dtype=np.uint8)
    return np.ascontiguousarray(flat.reshape(size, count).T).reshape(-1).view(dtype)


def _packed(bucket: int, key, text, rank, record, n, side, sketch) -> pa.RecordBatch:
    """One row: the suffixes of some texts that fall to a range partition, in order, and what belongs to each text once."""
    order = np.lexsort((text, key))
    key, text, rank = key[order], text[order], rank[order]
    here, text = np.unique(text, return_inverse=True)
    cols = {
        "keys": np.diff(key, prepend=_U(0)), "text": text.astype(np.uint32), "rank": rank.astype(np.uint32), "record": record[here],
        "n": n[here].astype(np.int32), "side": side[here].astype(np.int8), "sketch": sketch[here].reshape(-1),
    }
    numbers = [pa.array([x], pa.int32()) for x in (bucket, len(key), len(here))]
    return pa.RecordBatch.from_arrays([*numbers, *(pa.array([_pack(cols[c])]) for c in _COLUMNS)], names=["bucket", "n_rows", "n_texts", *_COLUMNS])


def _suffix_rows(records: DataFrame, shared, buckets: int) -> DataFrame:
    """The kept suffixes of all records, packed by range partition.

    Training texts of a run of more than ``HOT_RUN`` suffixes, as the sketch
    counts them, are parted into fragments that go to different partitions; its
    evaluation texts go to all of them. So each of their pairs meets once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steps, bounds = shared.value
        for batch in batches:
            all_records = batch.column(0).to_numpy(zero_copy_only=False)
            all_sides = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int8)
            for start, texts in _chunks(batch.column(2)):
                record, side = all_records[start : start + len(texts)], all_sides[start : start + len(texts)]
                key, text, rank, n, sketch = kept_suffixes(texts, steps)
                bucket = np.searchsorted(bounds, key, side="right").astype(np.int64)
                size = np.exp2(steps[_slot(mix(key))] / 4)
                fragments = np.maximum(np.ceil(size / HOT_RUN).astype(np.int64), 1)
                text_side = side[text]
                hot = bool((fragments > 1).any())
                if hot:
                    every = np.repeat(np.arange(len(key)), fragments)
                    fragment = np.arange(len(every)) - np.repeat(np.cumsum(fragments) - fragments, fragments)
                    own = (mix(record[text[every]].view(np.uint64)) % fragments[every].astype(np.uint64)).astype(np.int64) == fragment
                    masked = np.where(own, text_side[every], text_side[every] & 6)
                    some = masked != 0
                    every, fragment, text_side = every[some], fragment[some], masked[some]
                    key, text, rank, bucket = key[every], text[every], rank[every], (bucket[every] + fragment) % buckets
                order = np.argsort(bucket, kind="stable")
                cut = np.searchsorted(bucket[order], np.arange(buckets + 1))
                for b in range(buckets):
                    rows = order[cut[b] : cut[b + 1]]
                    # where runs are cut a text may come with different sides: it stands there as different texts
                    for s in np.unique(text_side[rows]) if hot else [None] * bool(len(rows)):
                        x = rows if s is None else rows[text_side[rows] == s]
                        yield _packed(b, key[x], text[x], rank[x], record, n, side if s is None else np.full(len(n), s, np.int8), sketch)

    return records.select("record", "side", "text").mapInArrow(run, _PACKED)


# --- pairs -------------------------------------------------------------------------

_NEED = LEAST / (1 + LEAST)  # of the shingles of both texts, counted together, so many must be common


def _differ(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x ^ y).sum(axis=1)


def neighbours(key: np.ndarray, text: np.ndarray, rank: np.ndarray, record: np.ndarray, n: np.ndarray, side: np.ndarray, sketch: np.ndarray) -> Iterator[np.ndarray]:
    """Pairs of records of different splits that stand in one run of the suffix array and may be similar.

    Suffixes are ordered by key and, within a run of equal ones, by the shingles
    of their texts. At the first common shingle, what can still follow must
    suffice: of two texts with na <= nb shingles, nb is at most ``most`` of a, so
    a suffix's partners stand right behind it.
    """
    size = n[text].astype(np.int64)
    order = np.lexsort((size, key))
    key, text, rank, size = key[order], text[order], rank[order].astype(np.int64), size[order]
    prefix = key[1:] == key[:-1]  # common prefix of SHINGLE words with the suffix before
    run = np.cumsum(np.r_[False, ~prefix]) if len(key) else np.zeros(0, np.int64)
    most = np.floor((size - rank + 1) / _NEED + 1e-6).astype(np.int64) - size - 1
    span = np.int64(2**32)
    stop = np.searchsorted(run * span + size, run * span + np.clip(most, 0, span - 1), side="right")
    here = np.arange(len(key))
    count = np.maximum(stop - here - 1, 0)
    train, asked = (side[text] & 1) != 0, (side[text] & 6) != 0
    total = np.cumsum(count)
    at = 0
    while at < len(key):
        done = total[at - 1] if at else 0
        end = max(int(np.searchsorted(total, done + _BLOCK, side="right")), at + 1)
        found = []
        # a suffix with more partners than a block holds is taken in pieces
        for first in range(0, int(total[end - 1] - done) or 0, 2 * _BLOCK):
            last = min(first + 2 * _BLOCK, int(total[end - 1] - done))
            place = np.arange(first, last)
            i = at + np.searchsorted(total[at:end] - done, place, side="right")
            j = place - (total[i] - count[i] - done) + i + 1
            ok = (train[i] & asked[j]) | (asked[i] & train[j])
            i, j = i[ok], j[ok]
            ok = (size[i] <= most[j]) & (record[text[i]] != record[text[j]])
            i, j = i[ok], j[ok]
            ok = _differ(sketch[text[i]], sketch[text[j]]) <= (size[i] + size[j] + 1) * (1 - 2 * _NEED) + 1e-9
            a, b = record[text[i[ok]]], record[text[j[ok]]]
            found.append(np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0))
        if found:
            yield np.concatenate(found)
        at = end


def _match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidate pairs of one range partition of the suffix array."""
    rows: dict[str, list] = {c: [] for c in _COLUMNS}
    texts = 0
    for batch in batches:
        for r in batch.to_pylist():
            for c in _COLUMNS:
                count = r["n_rows"] if c in _ROW_TYPES else r["n_texts"] * (_WORDS if c == "sketch" else 1)
                part = _unpack(r[c], _ROW_TYPES.get(c) or _TEXT_TYPES[c], count)
                if c == "keys":
                    part = np.cumsum(part, dtype=np.uint64)
                rows[c].append(part + np.uint32(texts) if c == "text" else part)
            texts += r["n_texts"]
    if not texts:
        return
    key, text, rank, record, n, side, sketch = (np.concatenate(rows.pop(c)) for c in _COLUMNS)
    for pairs in neighbours(key, text, rank, record, n, side, sketch.reshape(-1, _WORDS)):
        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pairs[:, k])) for k in (0, 1)], names=["a", "b"])


def _text_sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number of distinct shingles and a parity sketch of twice as many bits, a power of two, at least 256."""
    for batch in batches:
        for at, texts in _chunks(batch.column(1)):
            value, owner, _ = _distinct_shingles(Suffixes(texts))
            n = np.bincount(owner, minlength=len(texts))
            words = np.maximum(4, 1 << np.maximum(np.ceil(np.log2(np.maximum(2 * n, 1))).astype(np.int64) - 6, 0))
            raw: list[bytes] = [b""] * len(texts)
            for w in np.unique(words).tolist():  # texts of like length together
                mine = np.flatnonzero(words == w)
                place = np.full(len(texts), -1)
                place[mine] = np.arange(len(mine))
                inside = place[owner] >= 0
                for i, row in zip(mine.tolist(), _parities(value[inside], place[owner[inside]], len(mine), w)):
                    raw[i] = row.tobytes()
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), pa.array(n.astype(np.int32)), pa.array(raw, pa.binary())], names=["record", "n", "sketch"])


def _folded(sketch: np.ndarray, words: int) -> np.ndarray:
    """A sketch of fewer bits: bit i of it is the parity of all bits at i modulo their number."""
    return np.bitwise_xor.reduce(sketch.reshape(-1, words), axis=0)


def _allowed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose numbers of shingles and sketches allow the similarity; none that has it is dropped."""
    for batch in batches:
        na, nb = (batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (2, 3))
        x, y = (batch.column(k).to_pylist() for k in (4, 5))
        words = np.minimum(*(pc.binary_length(batch.column(k)).to_numpy(zero_copy_only=False) for k in (4, 5))) >> 3
        differ = np.zeros(len(words), dtype=np.int64)
        for w in np.unique(words).tolist():  # pairs whose shorter sketch is of like length together
            at = np.flatnonzero(words == w).tolist()
            sides = [np.stack([_folded(np.frombuffer(z[i], np.uint64), w) if len(z[i]) > 8 * w else np.frombuffer(z[i], np.uint64) for i in at]) for z in (x, y)]
            differ[at] = _differ(*sides)
        sized = np.minimum(na, nb) + 1 >= np.maximum(na, nb) * LEAST - 1e-9
        keep = sized & (differ <= (na + nb + 1) * (1 - 2 * _NEED) + 1e-9)
        yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))


_PAIR = "a long, b long, common int, of int"


def _exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose distinct shingles are the same to LEAST at least."""
    for batch in batches:
        a, b = (batch.column(i).to_pylist() for i in (0, 1))
        sets: dict[int, set] = {}

        def of(record: int, text: str) -> set:
            if record not in sets:
                if len(sets) > 2_000:
                    sets.clear()
                ws = text.split(" ")
                sets[record] = set(zip(*(ws[i:] for i in range(SHINGLE))))
            return sets[record]

        out = []
        for x, y, tx, ty in zip(a, b, batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            sx, sy = of(x, tx), of(y, ty)
            common = len(sx & sy)
            whole = len(sx) + len(sy) - common
            if whole and common >= LEAST * whole - 1e-9:
                out.append((x, y, common, whole))
        cols = list(zip(*out)) if out else [(), (), (), ()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.int32())],
            names=["a", "b", "common", "of"],
        )


def overlapping_pairs(records: DataFrame) -> DataFrame:
    """``(a, b, common, of)``: pairs of different records, a in an evaluation split and b in the training split or the reverse, a < b.

    ``records`` has record (a 64-bit id), side (bits: 1 train, 2 and 4 evaluation
    splits) and text. ``common`` of ``of`` distinct shingles are in both texts,
    at least 0.6 of them. Null texts, and texts of fewer words than a shingle,
    have no partner. Repeated records count once.
    """
    spark = records.sparkSession
    counts, sample = frequencies(records.select("text"))
    steps = _steps(counts)
    kept = (1 - LEAST) * float(counts.sum())
    buckets = int(max(3 * shuffle_partitions(spark) // 2, -(-kept // BUCKET_ROWS)))
    shared = spark.sparkContext.broadcast((steps, _bounds(sample, steps, buckets)))
    rows = _suffix_rows(records.where("side <> 0"), shared, buckets)
    ordered = rows.repartitionById(buckets, "bucket")
    pairs = checkpointed(ordered.mapInArrow(_match, "a long, b long").distinct())
    pairs = checkpointed(_possible(records, pairs))
    texts = _of_pairs(records, pairs).groupBy("record").agg(F.min("text").alias("text"))
    left, right = (texts.select(F.col("record").alias(x), F.col("text").alias(f"{x}_text")) for x in ("a", "b"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "a_text", "b_text")
    return both.mapInArrow(_exact, _PAIR)


def _of_pairs(records: DataFrame, pairs: DataFrame) -> DataFrame:
    """The records that stand in a pair; their ids are broadcast if they are few."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("record")).distinct()
    return records.select("record", "text").join(F.broadcast(ids) if pairs.count() <= FEW else ids, "record", "left_semi")


def _possible(records: DataFrame, pairs: DataFrame) -> DataFrame:
    """Pairs that pass ``_allowed`` by sketches that fit the lengths of their texts."""
    sketches = _of_pairs(records, pairs).mapInArrow(_text_sketches, "record long, n int, sketch binary").dropDuplicates(["record"])

    def named(x: str) -> DataFrame:
        return sketches.select(F.col("record").alias(x), *(F.col(c).alias(f"{x}_{c}") for c in ("n", "sketch")))

    both = pairs.join(named("a"), "a").join(named("b"), "b").select("a", "b", "a_n", "b_n", "a_sketch", "b_sketch")
    return both.mapInArrow(_allowed, "a long, b long")


# --- records and splits ------------------------------------------------------------

SIDES = {"train": 1, "eval": 2, "test": 4}


def with_sides(records: DataFrame, documents: str, manifest: DataFrame, document: str, split: str) -> DataFrame:
    """``records`` with ``side``: the splits of the documents (an array of ids in ``documents``) that a record occurs in.

    A manifest of at most 4 MB by Catalyst's estimate is broadcast to be looked
    up where the records lie; a larger one is joined over exploded documents.
    """
    spark = records.sparkSession
    bits = F.coalesce(*(F.when(F.col(split) == s, b) for s, b in SIDES.items()), F.lit(0))
    sides = manifest.where(F.col(document).isNotNull()).groupBy(F.col(document).alias("_document")).agg(F.bit_or(bits).alias("_side"))
    if estimated_bytes(manifest) <= 4 << 20:
        known = sides.where("_side <> 0").collect()
        table = spark.sparkContext.broadcast((pa.array([r[0] for r in known], pa.string()), np.array([0, *(r[1] for r in known)], dtype=np.int32)))

        @arrow_udf(T.IntegerType())
        def look_up(column: pa.Array) -> pa.Array:
            ids, side = table.value
            flat = side[pc.fill_null(pc.index_in(column.flatten(), value_set=ids), -1).to_numpy(zero_copy_only=False) + 1]
            sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
            out = np.zeros(len(sizes), dtype=np.int32)
            full = sizes > 0
            if full.any():
                out[full] = np.bitwise_or.reduceat(flat, (np.cumsum(sizes) - sizes)[full])
            return pa.array(out)

        return records.withColumn("side", look_up(F.col(documents)))
    parts = records.select("record", F.explode(documents).alias("_document")).join(sides, "_document").groupBy("record").agg(F.bit_or("_side").alias("side"))
    return records.join(parts, "record", "left").withColumn("side", F.coalesce("side", F.lit(0)))


def cross_split_overlaps(records: DataFrame) -> DataFrame:
    """``(split, a, b, common, of)``: records of an evaluation split that are the same (a = b) as, or almost the same as, a training record.

    ``records`` has record, side and text as in ``overlapping_pairs``. A pair
    comes out once for each evaluation split that one of the two is in while
    the other is in the training split. For a = b, ``common`` and ``of`` are null.
    """
    sides = records.groupBy("record").agg(F.bit_or("side").alias("side"))
    same = sides.where("side & 1 <> 0 and side & 6 <> 0").select(
        F.col("record").alias("a"), F.col("record").alias("b"), F.lit(None).cast("int").alias("common"), F.lit(None).cast("int").alias("of"),
        F.col("side").alias("a_side"), F.col("side").alias("b_side"),
    )
    pairs = checkpointed(overlapping_pairs(records))
    near = pairs.join(sides.select(F.col("record").alias("a"), F.col("side").alias("a_side")), "a").join(
        sides.select(F.col("record").alias("b"), F.col("side").alias("b_side")), "b"
    )
    both = same.unionByName(near.select(*same.columns))
    splits = F.array(*(F.struct(F.lit(s).alias("split"), F.lit(b).alias("bit")) for s, b in SIDES.items() if s != "train"))
    out = both.withColumn("_s", F.explode(splits))
    has = lambda side, bit: side.bitwiseAND(bit) != 0
    a, b, bit = F.col("a_side"), F.col("b_side"), F.col("_s.bit")
    return out.where((has(a, bit) & has(b, F.lit(1))) | (has(b, bit) & has(a, F.lit(1)))).select(F.col("_s.split").alias("split"), "a", "b", "common", "of")


# --- shared spans ------------------------------------------------------------------


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Suffix array by prefix doubling."""
    n = len(symbols)
    rank = np.unique(symbols, return_inverse=True)[1].astype(np.int64)
    order = np.argsort(rank, kind="stable")
    k = 1
    while k < n and rank.max() < n - 1:
        follow = np.full(n, -1, dtype=np.int64)
        follow[: n - k] = rank[k:]
        order = np.lexsort((follow, rank))
        a, b = rank[order], follow[order]
        new = np.zeros(n, dtype=np.int64)
        new[order] = np.cumsum(np.r_[0, (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
        rank, k = new, 2 * k
    return order


def common_prefixes(symbols: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Length of the common prefix of each suffix and the one before it in ``order`` (Kasai)."""
    n = len(symbols)
    s = symbols.tolist()
    at = np.empty(n, dtype=np.int64)
    at[order] = np.arange(n)
    out = np.zeros(n, dtype=np.int64)
    length = 0
    for i, r in enumerate(at.tolist()):
        if r == 0:
            length = 0
            continue
        j = int(order[r - 1])
        while i + length < n and j + length < n and s[i + length] == s[j + length]:
            length += 1
        out[r] = length
        length = max(length - 1, 0)
    return out


def shared_spans(a: list[str], b: list[str], least: int = SHINGLE) -> list[tuple[int, int]]:
    """Maximal spans ``(start, end)`` of a's words that stand in b too, of ``least`` words or more, merged.

    The texts are put end to end. For a suffix of a, the longest prefix it
    shares with any suffix of b is that with the next one of b above or below it
    in the suffix array: the least common prefix in between.
    """
    ids: dict[str, int] = {}
    seq = [ids.setdefault(w, len(ids) + 2) for w in a] + [0] + [ids.setdefault(w, len(ids) + 2) for w in b] + [1]
    symbols = np.array(seq, dtype=np.int64)
    order = suffix_array(symbols)
    prefix = common_prefixes(symbols, order).tolist()
    longest = [0] * len(a)
    positions = order.tolist()
    for sweep in (range(len(positions)), range(len(positions) - 1, -1, -1)):
        down = sweep.step > 0
        reach = 0
        for r in sweep:
            if down:
                reach = min(reach, prefix[r])
            p = positions[r]
            if p > len(a):
                reach = len(seq)
            elif p < len(a):
                longest[p] = max(longest[p], min(reach, len(a) - p))
            if not down:
                reach = min(reach, prefix[r])
    spans: list[tuple[int, int]] = []
    for p, n in enumerate(longest):
        if n >= least:
            if spans and p <= spans[-1][1]:
                spans[-1] = (spans[-1][0], max(spans[-1][1], p + n))
            else:
                spans.append((p, p + n))
    return spans


def with_coverage(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """``keys``, ``covered`` (share of the words of ``text`` in spans shared with ``other``), ``longest_span`` and ``n_spans``."""
    schema = T.StructType(
        [*(pairs.schema[k] for k in keys), T.StructField("covered", T.DoubleType()), T.StructField("longest_span", T.IntegerType()), T.StructField("n_spans", T.IntegerType())]
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for text, other in zip(batch["text"], batch["other"]):
                a, b = (text or "").split(), (other or "").split()
                spans = [(0, len(a))] if a == b else shared_spans(a, b)
                sizes = [y - x for x, y in spans]
                rows.append((round(sum(sizes) / max(len(a), 1), 6), max(sizes, default=0), len(sizes)))
            made = pd.DataFrame(rows, columns=["covered", "longest_span", "n_spans"], index=batch.index)
            yield pd.concat([batch[keys], made], axis=1)

    return pairs.select(*keys, "text", "other").mapInPandas(run, schema)
