import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from meridian.llm.split import RangeMaximum, boundary_strengths, pieces, split_oversized


def spans(text, most, overlap):
    return pieces(text, most, overlap)


@given(st.lists(st.sampled_from(["a", "b.", "C", "d,", "e;", "Inc.", "f?"]), max_size=300), st.sampled_from([" ", "\n", " ", "  "]), st.integers(4, 40), st.data())
@settings(max_examples=150, deadline=None)
def test_pieces_cover_the_text_and_share_the_overlap(ws, gap, most, data):
    overlap = data.draw(st.integers(0, most // 2 - 1))
    text = gap.join(ws)
    got = pieces(text, most, overlap)
    if not ws:
        assert got == []
        return
    assert all(n <= most for _, n, *_ in got) and got[0][0] == 0 and got[-1][0] + got[-1][1] == len(ws)
    for (a, n, *_), (b, *_) in zip(got, got[1:]):
        assert b == a + n - overlap  # consecutive pieces share exactly the overlap
    words = []
    for a, n, x, y, _ in got:
        own = text[x:y].split()
        assert len(own) == n
        words[a:] = own
    assert words == ws  # nothing is lost


def test_cuts_are_the_strongest_and_rightmost():
    rng = random.Random(1)
    ws = [rng.choice(["x", "x", "x", "y,", "z;", "End.", "Q"]) for _ in range(2000)]
    text = " ".join(ws)
    strengths = boundary_strengths(ws, [" "] * (len(ws) - 1) + ["\n\n"])
    for a, n, _, _, s in pieces(text, 50, 7)[:-1]:
        window = strengths[a + 24 : a + 50]
        assert s == window.max() and a + n - 1 == a + 24 + max(i for i, v in enumerate(window) if v == s)


def test_range_maximum_against_brute_force():
    import numpy as np

    s = np.array([random.Random(2).randint(0, 3) for _ in range(77)])
    index = RangeMaximum(s, 40)
    for lo in range(77):
        for hi in range(lo, min(77, lo + 40)):
            best = s[lo : hi + 1].max()
            assert index.strongest(lo, hi) == max(i for i in range(lo, hi + 1) if s[i] == best)


def test_abbreviations_and_lines():
    ws = ["Acme", "Inc.", "sold", "it.", "Then", "more"]
    assert boundary_strengths(ws, [" ", " ", " ", " ", "\n", "\n\n"]).tolist() == [0, 1, 0, 3, 4, 5]


def test_split_oversized(spark):
    text = " ".join(f"w{i}{'.' if i % 9 == 8 else ''}" for i in range(900))
    rows = [("k", 1, text, "c"), ("k", 1, text, "c"), ("k", 2, "short text", "c"), ("k", 3, None, "c"), ("k", 4, "", "c"), (None, 5, " ".join(["w"] * 351), "c"), ("k", 6, " ".join(["w"] * 350), "c"), ("k", 7, "a" * 5000, "c")]
    df = spark.createDataFrame(rows, "doc string, pos int, text string, extra string")
    got = split_oversized(df, ["doc", "pos"], "text").collect()
    assert {(r.doc, r.pos) for r in got} == {("k", 1), (None, 5)}
    assert sorted(r.piece_no for r in got if r.pos == 1) == list(range(sum(r.pos == 1 for r in got)))
    assert all(r.piece_words == len(r.piece_text.split()) <= 350 for r in got)
    assert split_oversized(df.where("false"), ["doc", "pos"], "text").count() == 0
    with pytest.raises(ValueError):
        split_oversized(df.withColumnRenamed("doc", "piece_no"), ["piece_no"], "text")
    with pytest.raises(ValueError):
        split_oversized(df, ["doc"], "text", max_words=10, overlap=5)
