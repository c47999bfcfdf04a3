from pathlib import Path

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from meridian.llm.tokenize import BYTE_BPE, TOKENIZERS, contract, encode_texts, vocabulary, words

PATH = f"{TOKENIZERS}/{BYTE_BPE}"
pytestmark = pytest.mark.skipif(not Path(PATH).exists(), reason="no vocabulary files here")


@pytest.fixture(scope="module")
def public():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return lambda texts: [x.ids for x in t.encode_batch(texts, add_special_tokens=False)]


@given(st.lists(st.one_of(st.text(max_size=60), st.text(alphabet="aA b'1.\n\t!é", max_size=80)), min_size=1, max_size=6))
@settings(max_examples=120, deadline=None)
def test_equals_the_public_library(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    assert [x.tolist() for x in vocabulary(PATH).encode(texts)] == [x.ids for x in t.encode_batch(texts, add_special_tokens=False)]
    assert all("".join(words(x)) == x for x in texts)


def test_long_runs_repeats_and_special_names(public):
    texts = ["a" * 3001, " " * 777 + "x", "ab" * 900 + "\n" * 50, "<|endoftext|> don't I'LL 12345 　 x", "\U0001f469‍\U0001f4bc東京 مرحبا naïve", "x" * 50_000]
    assert [x.tolist() for x in vocabulary(PATH).encode(texts)] == public(texts)


def test_very_long_words(public):
    """An unbroken word of a million letters, and words about the bound between the two ways of contraction."""
    import random

    rng = random.Random(3)
    letters = "".join(rng.choices("etaoinshrdlucmfwypvbgkjqxz", k=1_000_000))
    texts = [letters, *(letters[:n] for n in range(250, 262)), "東京" * 20_000, "QmFzZTY0" * 5_000]
    assert [x.tolist() for x in vocabulary(PATH).encode(texts)] == public(texts)


@given(st.text(alphabet="abeth né", max_size=80))
@settings(max_examples=80, deadline=None)
def test_both_ways_of_contraction_agree(text):
    v = vocabulary(PATH)
    for w in words(text):
        v.known.pop(w, None)
        v.learn([w])
        raw = v.byte_ids[list(w.encode())].tolist()
        assert list(v.known[w]) == contract(raw, v.merges)


def test_round_trip():
    import tiktoken, base64  # noqa: E401

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(f"{TOKENIZERS}/byte_bpe_50k.tiktoken", "rb"))}
    back = {v: k for k, v in ranks.items()}
    text = "Re: File No. 12-66 — naïve €5\n\n\tEnd  of it"
    assert b"".join(back[i] for i in vocabulary(PATH).encode([text])[0].tolist()).decode() == text
    assert tiktoken is not None


def test_forgetting_words_changes_nothing(public, monkeypatch):
    v = vocabulary(PATH)
    monkeypatch.setattr(type(v), "KEEP", 5)
    texts = ["one two three four five six seven", "eight nine ten one"]
    assert [x.tolist() for x in v.encode(texts)] == public(texts) and v.count(texts) == [len(x) for x in public(texts)]


def test_encode_texts(spark):
    df = spark.createDataFrame([(1, "hello world", "x"), (2, None, "x"), (3, "", "x"), (None, " ", "x"), (1, "hello world", "x")], "doc_id long, text string, _text string")
    rows = encode_texts(df, ["doc_id"], "text").collect()
    assert sorted((r.doc_id or 0, list(r.ids)) for r in rows) == [(0, [220]), (1, [31373, 995]), (1, [31373, 995]), (2, []), (3, [])]
    assert encode_texts(df.where("false"), ["doc_id"], "text").count() == 0
    with pytest.raises(ValueError):
        encode_texts(df.withColumnRenamed("doc_id", "ids"), ["ids"], "text")
