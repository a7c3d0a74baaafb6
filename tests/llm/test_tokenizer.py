import os
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from embermill.llm import tokenizer as T

pytestmark = pytest.mark.skipif(not os.path.exists(T.default_path()), reason="the public vocabulary isn't here")
ODD = ["", " ", "\n\n \t", "\x1c \x1d\x85a　᠎ b", "a" * 30000, "ab" * 9000, "́" * 500, "Zaͤlgo̸" * 50, " " * 5000 + "x", "<|endoftext|>", "é日本語🙂" * 100, "​  x", "don't I'LL we've", "\x00\x01", "１２ ½"]


@pytest.fixture(scope="module")
def encoder():
    return T.Encoder(T.read_vocabulary())


@pytest.fixture(scope="module")
def public():
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(T.default_path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


def encoded(encoder, text):
    return encoder.encode_texts([text])[1].tolist()


@pytest.mark.parametrize("text", ODD)
def test_equals_the_public_tokenizer(encoder, public, text):
    assert encoded(encoder, text) == public(text)


def test_equals_plain_merging(encoder):
    """Against the merges done one by one, on random bytes and on random tokens joined."""
    ranks = {t: i for i, t in enumerate(encoder.v.tokens)}

    def merges(raw: bytes) -> list[int]:
        parts = [raw[i : i + 1] for i in range(len(raw))]
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: ranks.get(parts[i] + parts[i + 1], 1 << 30))
            if parts[best] + parts[best + 1] not in ranks:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return [ranks[p] for p in parts]

    rng = random.Random(1)
    for _ in range(3000):
        raw = bytes(rng.choice(b"abcdeinorst ") for _ in range(rng.randint(1, 30))) if rng.random() < 0.4 else b"".join(rng.choice(encoder.v.tokens) for _ in range(rng.randint(1, 5)))
        assert encoder.encode_bytes(raw) == merges(raw)


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=80))
def test_any_text(encoder, public, text):
    assert encoded(encoder, text) == public(text)


def test_the_memo_has_no_influence(encoder, monkeypatch):
    texts = ["a b c d", None, "", "b c"] * 3
    n, flat = encoder.encode_texts(texts)
    monkeypatch.setattr(T, "MEMO_PIECES", 0)
    for _ in range(2):
        m, again = encoder.encode_texts(texts)
        assert m.tolist() == n.tolist() and again.tolist() == flat.tolist()


def test_json_and_ranks_agree():
    a, b = T.read_vocabulary(), T.read_vocabulary(T.default_path("byte_bpe_50k.json"))
    assert a.tokens == b.tokens and a.left.tolist() == b.left.tolist()


def test_frames(spark):
    rows = [(i, t, "x", [1], 5) for i, t in enumerate(ODD)] + [(None, None, None, None, None), (3, "a b", "x", None, None), (3, "a b", "x", None, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, id string, ids array<int>, n_tokens int")
    got = T.encode(docs)
    assert got.columns == ["doc_id", "ids"] and got.count() == len(rows)
    assert [r["ids"] for r in got.filter("doc_id is null").collect()] == [[]]
    assert [r["ids"] for r in got.filter("doc_id = 0").collect()] == [[]]
    back = {(r["doc_id"], r["text"]) for r in T.decode(got).collect()}
    assert back == {(i, t or "") for i, t, *_ in rows}
    counts = {r["doc_id"]: r["n_tokens"] for r in T.encode(docs.filter("doc_id <> 3"), counts_only=True).collect()}
    assert counts == {r["doc_id"]: len(r["ids"]) for r in got.filter("doc_id <> 3").collect()}
    assert T.encode(docs.limit(0)).collect() == [] == T.decode(got.limit(0)).collect()
    cut = spark.createDataFrame([(1, None), (2, [])], "doc_id bigint, ids array<int>")
    assert {(r["doc_id"], r["text"]) for r in T.decode(cut).collect()} == {(1, None), (2, "")}
