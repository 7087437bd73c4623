import hashlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from gradelake.llm import byte_bpe as B

PATH = str(public_tokenizers.path("byte_bpe_50k.json"))
WHOLE = Tokenizer.from_file(PATH)
CODEC = B.Codec(PATH)

ODD = [
    None, "", " ", "  ", "\n\n\n", " \n's", "'s's'sabc", "it's we'll they're I'd 'twas '' ' s", "a  b   c\n\n d\t\te   x", "don't!'s ?'re",
    "<|endoftext|>", "a <|endoftext|> b  <|endoftext|><|endoftext|>\n", "<|endoftex", "x" * 3000, "1234 5٣٤ ⅷ²x", "Ünïcödé 中文字 한글 🙂👩‍👩‍👧 ́á", "\x00\x1f\x7f\x85  z",
    "ſ'S 'LL 'Re", "\r\n\r\n  end  ", "a" + " " * 500 + "b", "﻿�\U0010ffff", "...'d 'v 'r 'l e",
]


def want(texts):
    return [e.ids for e in WHOLE.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def got(codec, texts):
    ids, at = codec.encode(texts)
    return [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])]


def test_ids_and_texts_are_those_of_the_library(raw_docs):
    texts = [*ODD, *(r["text"] for r in raw_docs)]
    found = got(CODEC, texts)
    assert found == want(texts)
    assert [CODEC.decode(np.array(i, np.int32)) for i in found] == [WHOLE.decode(i, skip_special_tokens=False) for i in found]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab'strelvmd 1\n\t.é中 !<|") | st.characters(codec="utf-8"), max_size=30), max_size=4))
def test_any_texts(texts):
    assert got(CODEC, texts) == want(texts)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 50256), max_size=12))
def test_any_ids_decode_alike(ids):
    assert CODEC.decode(np.array(ids, np.int32)) == WHOLE.decode(ids, skip_special_tokens=False)


def test_forced_pairs_are_inside_no_token():
    spelled = [bytes(CODEC.spelled[a:b]) for a, b in zip(CODEC.spelled_at[:50256], CODEC.spelled_at[1:50257])]
    pairs = {(t[i], t[i + 1]) for t in spelled for i in range(len(t) - 1)}
    assert {(k >> 8, k & 255) for k in np.flatnonzero(~CODEC.forced)} == pairs


def test_slices_and_a_full_memory_change_nothing(monkeypatch, raw_docs):
    texts = [" ".join(r["text"] or "" for r in raw_docs), "a" * 3000 + " b" * 1000, *ODD]
    monkeypatch.setattr(B, "SLICE_BYTES", 700)
    monkeypatch.setattr(B, "CACHE_FRAGMENTS", 300)
    assert got(B.Codec(PATH), texts) == want(texts)


def test_tables(make, spark, odd):
    rows = [*enumerate(ODD), (3, "same id"), (None, "no id"), (None, "no id")]
    docs = make(rows)
    encoded = B.encode(docs, PATH)
    key = lambda r: (r[0] is not None, r[0] or 0, r[1])
    ids = sorted(((r["doc_id"], r["input_ids"]) for r in encoded.collect()), key=key)
    assert ids == sorted(zip([r[0] for r in rows], want([r[1] for r in rows])), key=key)
    back = sorted(((r["doc_id"], r["text"]) for r in B.decode(encoded, PATH).collect()), key=key)
    assert back == sorted(((i, t or "") for i, t in rows), key=key)
    sums = sorted((tuple(r) for r in B.digests(encoded, PATH).collect()), key=key)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    assert sums == sorted(((i, len(w), sha(np.array(w, "<u4").tobytes()), sha((t or "").encode())) for (i, t), w in zip(rows, want([r[1] for r in rows]))), key=key)
    assert sorted((tuple(r) for r in B.round_trip(docs, PATH).collect()), key=key) == sums
    assert B.encode(docs.limit(0), PATH).collect() == []
    nothing = spark.createDataFrame([(1, None)], "doc_id bigint, input_ids array<int>")
    assert B.digests(nothing, PATH).first()["n_tokens"] == 0
    assert B.encode(odd, PATH, keep=("doc_id", "n_words")).columns == ["doc_id", "n_words", "input_ids"]


@pytest.mark.parametrize("char", ["a", "é", "7", "²", " ", " ", " ", "\x85", ".", "́", "\U0001f642", "‍"])
def test_classes_come_from_the_tokenizer(char):
    kinds = CODEC._kinds(np.array([ord(char)]))
    near = {B.LETTER: "a", B.NUMBER: "1", B.OTHER: "!"}
    for kind, c in near.items():
        assert (kinds[0] == kind) == (len(WHOLE.pre_tokenizer.pre_tokenize_str(c + char)) == 1)
