import random

import numpy as np
import pyarrow as pa

from meridian.llm import overlap
from meridian.llm.overlap import common_prefixes, cross_split_overlaps, frequencies, shared_spans, suffix_array, with_coverage, with_sides


def brute(rows):
    out = set()
    sides, sets = {}, {}
    for r, s, t in rows:
        sides[r] = sides.get(r, 0) | s
        w = (t or "").split(" ")
        sets[r] = set(zip(w, w[1:], w[2:]))
    ids = sorted(sides)
    for i, a in enumerate(ids):
        for b in ids[i:]:
            c = len(sets[a] & sets[b])
            u = len(sets[a]) + len(sets[b]) - c
            if a == b or (u and c / u >= 0.6 - 1e-9):
                for name, bit in (("eval", 2), ("test", 4)):
                    if (sides[a] & bit and sides[b] & 1) or (sides[b] & bit and sides[a] & 1):
                        out.add((name, a, b))
    return out


def longest_run(a, b):
    a, b = a.split(), b.split()
    best, row = 0, [0] * (len(b) + 1)
    for x in a:
        row = [0] + [row[j] + 1 if x == y else 0 for j, y in enumerate(b)]
        best = max(best, *row)
    return best


def edited(rng, words):
    w = list(words)
    for _ in range(rng.randint(0, max(1, len(w) // 12))):
        i = rng.randrange(len(w))
        kind = rng.random()
        if kind < 0.5:
            w[i] = f"new{rng.randrange(10**6)}"
        elif kind < 0.75:
            del w[i]
        else:
            w.insert(i, f"ins{rng.randrange(10**6)}")
    return w or ["x"]


def corpus(seed, n, least, most, vocabulary=400, noticed=0.4):
    rng = random.Random(seed)
    notice = "this notice is printed in every filing of the company and has no bearing on the text".split()
    rows, r = [], 0
    for _ in range(n):
        base = [f"w{rng.randrange(vocabulary)}" for _ in range(rng.randint(least, most))]
        if rng.random() < noticed:
            base = notice + base
        for _ in range(rng.randint(1, 4)):
            r += 1
            rows.append((r, rng.choice([0, 1, 1, 2, 4, 3, 5]), " ".join(edited(rng, base))))
    return rows


def run(spark, rows):
    df = spark.createDataFrame(rows, "record long, side int, text string")
    return {(r.split, r.a, r.b) for r in cross_split_overlaps(df).collect()}


def test_against_all_pairs(spark):
    rows = corpus(4, 150, 40, 120)
    assert run(spark, rows + rows[:20]) == brute(rows)


def test_short_texts(spark):
    rows = corpus(2, 200, 1, 22, vocabulary=60, noticed=0)
    assert run(spark, rows) == brute(rows)


def test_hot_runs_are_cut_and_lose_nothing(spark, monkeypatch):
    """Runs of more than two suffixes are parted into fragments; a family of near copies is one of them."""
    monkeypatch.setattr(overlap, "HOT_RUN", 2)
    rows = corpus(3, 120, 30, 70)
    rng = random.Random(5)
    base = [f"f{i}" for i in range(60)]
    rows += [(10_000 + k, rng.choice([1, 2, 3, 4]), " ".join(edited(rng, base))) for k in range(60)]
    assert run(spark, rows) == brute(rows)


def test_blocks_of_pairs_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(overlap, "_BLOCK", 7)
    base = [f"f{i}" for i in range(40)]
    rng = random.Random(6)
    rows = [(k, rng.choice([1, 2, 5]), " ".join(edited(rng, base))) for k in range(50)]
    key, text, rank, n, sketch = overlap.kept_suffixes(pa.array([t for *_, t in rows]), np.zeros(overlap.SLOTS, np.uint8))
    record, side = np.array([r for r, *_ in rows]), np.array([s for _, s, _ in rows], np.int8)
    pairs = {tuple(p) for found in overlap.neighbours(key, text, rank, record, n, side, sketch) for p in found.tolist()}
    assert {(a, b) for _, a, b in brute(rows) if a != b} <= pairs


def test_nulls_empty_and_no_records(spark):
    rows = [(1, 3, None), (2, 1, ""), (3, 2, ""), (4, 2, "a b"), (5, 1, "a b"), (6, 0, "x y z"), (7, 1, "x y z"), (8, 4, "x y z")]
    assert run(spark, rows) == {("eval", 1, 1), ("test", 7, 8)}
    assert run(spark, []) == set()


def test_sketch_counts_all_texts(spark):
    df = spark.createDataFrame([(" ".join(f"w{i}" for i in range(40)),)] * 50, "text string").repartition(7)
    counts, sample = frequencies(df)
    assert counts.max() == 50 and (counts > 0).sum() == 38 and counts.sum() == 50 * 38
    assert len(set(sample.tolist())) == 38


def test_sketches_bound_the_difference():
    rng = random.Random(11)
    texts = [" ".join(edited(rng, [f"w{rng.randrange(30)}" for _ in range(rng.randint(0, 90))])) for _ in range(40)]
    value, owner, _ = overlap._distinct_shingles(overlap.Suffixes(pa.array(texts)))
    sets = [set(value[owner == i].tolist()) for i in range(len(texts))]
    for words in (1, 3, 4):
        bits = overlap._parities(value, owner, len(texts), words)
        for i in range(len(texts)):
            for j in range(len(texts)):
                assert overlap._differ(bits[i : i + 1], bits[j : j + 1])[0] <= len(sets[i] ^ sets[j])
    wide, narrow = overlap._parities(value, owner, len(texts), 8), overlap._parities(value, owner, len(texts), 2)
    assert all((overlap._folded(wide[i], 2) == narrow[i]).all() for i in range(len(texts)))


def test_kept_suffixes_and_packing():
    texts = pa.array(["a b c d e f g h i j", None, "a b", "x y z"])
    key, text, rank, n, sketch = overlap.kept_suffixes(texts, np.zeros(overlap.SLOTS, np.uint8))
    assert n.tolist() == [8, 0, 0, 1] and np.bincount(text, minlength=4).tolist() == [4, 0, 0, 1]
    for column, dtype in ((key, np.uint64), (rank.astype(np.uint32), np.uint32), (np.zeros(0, np.int64), np.int64)):
        assert overlap._unpack(overlap._pack(column), dtype, len(column)).tolist() == column.tolist()


def test_chunks_cover_all_texts():
    column = pa.array(["a" * k if k % 3 else None for k in range(50)])
    parts = list(overlap._chunks(column, most_texts=7, most_bytes=60))
    assert [x for _, part in parts for x in part.to_pylist()] == column.to_pylist() and all(len(p) <= 7 for _, p in parts)
    assert [at for at, _ in parts] == np.cumsum([0, *(len(p) for _, p in parts[:-1])]).tolist()


def test_suffix_array_and_spans_against_brute_force():
    rng = random.Random(9)
    for _ in range(60):
        a = [rng.choice("abcde") for _ in range(rng.randint(0, 25))]
        b = [rng.choice("abcde") for _ in range(rng.randint(0, 25))]
        s = np.array([ord(x) for x in a] or [0])
        order = suffix_array(s)
        assert order.tolist() == sorted(range(len(s)), key=lambda i: s[i:].tolist())
        for r, n in enumerate(common_prefixes(s, order).tolist()[1:], 1):
            x, y = s[order[r - 1] :].tolist(), s[order[r] :].tolist()
            assert n == next((i for i, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y)))
        covered = {k for i in range(len(a)) for j in range(i + 3, len(a) + 1) if any(b[x : x + j - i] == a[i:j] for x in range(len(b))) for k in range(i, j)}
        assert {k for x, y in shared_spans(a, b) for k in range(x, y)} == covered


def test_coverage(spark):
    rows = [(1, "a b c d e x y", "q a b c d e"), (2, "a b c", "a b c"), (3, None, "a"), (4, "", "")]
    got = {r.id: (r.covered, r.longest_span) for r in with_coverage(spark.createDataFrame(rows, "id long, text string, other string"), ["id"]).collect()}
    assert got == {1: (round(5 / 7, 6), 5), 2: (1.0, 3), 3: (0.0, 0), 4: (0.0, 0)}


def test_sides_by_look_up_and_by_join(spark, monkeypatch):
    records = spark.createDataFrame([(1, ["a", "b"]), (2, ["c"]), (3, None), (4, [])], "record long, documents array<string>")
    manifest = spark.createDataFrame([("a", "train"), ("b", "eval"), ("b", "eval"), ("c", "other"), (None, "test")], "doc string, split string")
    want = {1: 3, 2: 0, 3: 0, 4: 0}
    monkeypatch.setattr(overlap, "estimated_bytes", lambda df: 0)
    assert {r.record: r.side for r in with_sides(records, "documents", manifest, "doc", "split").collect()} == want
    monkeypatch.setattr(overlap, "estimated_bytes", lambda df: 1 << 40)
    assert {r.record: r.side for r in with_sides(records, "documents", manifest, "doc", "split").collect()} == want


def test_edits_strewn_evenly(spark):
    """Long texts that share no run of HEAD words: every twelfth word replaced, 74 of 122 sequences in common."""
    a = [f"w{i}" for i in range(1, 101)]
    b = [f"new{i}" if i % 12 == 0 else w for i, w in enumerate(a, 1)]
    others = [(10 + k, 1, " ".join(f"o{k}x{i}" for i in range(80))) for k in range(20)]
    rows = [(1, 1, " ".join(a)), (2, 2, " ".join(b)), *others]
    assert longest_run(*(t for _, _, t in rows[:2])) < 12
    assert run(spark, rows) == brute(rows) == {("eval", 1, 2)}


def test_no_pair_of_long_texts_is_lost(spark):
    rows = corpus(1, 150, 40, 120)
    assert run(spark, rows + rows[:20]) == brute(rows)


def test_words_written_several_times(spark):
    """A short text against the same words five times: 8 of 10 distinct sequences in common."""
    words = "a b c d e f g h i j".split()
    rows = [(1, 1, " ".join(words)), (2, 4, " ".join(words * 5))]
    assert run(spark, rows) == brute(rows) == {("test", 1, 2)}


def test_more_texts_than_are_broadcast(spark, monkeypatch):
    """The way beyond a million ids, which shuffles: the same pairs."""
    monkeypatch.setattr(overlap, "FEW", -1)
    rows = corpus(7, 60, 20, 60)
    assert run(spark, rows) == brute(rows)
