import base64
import hashlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
import tiktoken
from edge import documents
from hypothesis import given, settings
from hypothesis import strategies as st

from tabloom.llm import bpe, catalog, token_counts

PIECES = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def pair():
    path, pattern = catalog.byte_ranks()
    own = bpe.tokenizer(path, pattern)
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(t): int(r) for t, r in map(bytes.split, lines)}
    return own, tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def ids(raw):
    return np.frombuffer(raw, "<u4").tolist()


def test_every_token_is_reachable_by_merges(pair):
    own, _ = pair
    assert all(own.merged(t) == [i] for i, t in enumerate(own.tokens))


ATOMS = ["a", "b", "the", " ", "  ", "\n", "\t", "é", "ß", "漢", "👍", "'s", "'", "1", "...", "==", "aaaa", "\x1c", " ", "\r\n"]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(ATOMS), max_size=60).map("".join))
def test_encoding_equals_the_library(pair, text):
    own, library = pair
    found = own.encode(text)
    assert ids(found) == library.encode_ordinary(text)
    assert own.decode(found, leaf=3) == text.encode()


@pytest.mark.parametrize("text", ["a" * 3001, "ab" * 1500 + "b", "=-" * 700 + "=" * 333, "haha" * 900, "漢字" * 500, "theand" * 600])
@pytest.mark.parametrize("leaf", [1, 7, 32])
def test_tree_reduction_of_long_pieces(pair, text, leaf):
    own, library = pair
    assert own.reduced(text.encode(), leaf) == own.merged(text.encode()) == library._core_bpe.encode_single_piece(text.encode())


def test_encode_texts(spark, pair):
    own, library = pair
    docs = documents(spark)
    rows = bpe.encode_texts(docs, *catalog.byte_ranks(), with_ids=True).collect()
    assert len(rows) == docs.count()
    want = {(r.doc_id, r.text) for r in docs.collect()}
    for r in rows:
        text = next(t for i, t in want if i == r.doc_id) or ""
        assert ids(bytes(r.ids)) == library.encode_ordinary(text) and r.n_tokens == len(r.ids) // 4
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert bpe.encode_texts(documents(spark, empty=True), *catalog.byte_ranks()).count() == 0
    with pytest.raises(ValueError, match="n_tokens"):
        bpe.encode_texts(docs.withColumnRenamed("row", "n_tokens"), *catalog.byte_ranks(), keys=["n_tokens"])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from([*ATOMS, "▁", " ▁", "<s>", "\x00", " x"]), max_size=30).map("".join), min_size=1, max_size=5))
def test_counts_equal_the_library(texts):
    counter = token_counts.counter(PIECES)
    assert counter.safe
    found = counter.count(pa.array(texts, pa.large_string()), np.array([len(t.encode()) for t in texts]))
    assert found.tolist() == [len(x) for x in counter.model.encode(texts)]


def test_counts_without_safe_boundaries(monkeypatch):
    counter = token_counts.Counter(PIECES)
    monkeypatch.setattr(counter, "safe", False)
    assert counter.count(pa.array(["a b  c "], pa.large_string()), np.array([7])).tolist() == [len(counter.model.encode("a b  c "))]


def test_segments_add_up():
    counter = token_counts.counter(PIECES)
    text = "some words  and more, " * 200 + "y" * 300 + " end"
    parts = [s[0].as_py() for s in token_counts.segments(text, 50)]
    assert " ".join(parts) == text and len(parts) > 50
    assert sum(len(counter.model.encode(p)) for p in parts) == len(counter.model.encode(text))


def test_count_tokens(spark):
    docs = documents(spark)
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    rows = token_counts.count_tokens(docs, PIECES, limit=6).collect()
    assert len(rows) == docs.count()
    for r in rows:
        n = len(model.encode(texts[r.doc_id]))
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(texts[r.doc_id].encode()), n, n > 6)
    assert token_counts.count_tokens(documents(spark, empty=True), PIECES).count() == 0
