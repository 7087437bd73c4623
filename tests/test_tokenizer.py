import random

import public_tokenizers
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from gradelake.functions import tokenizer as TK
from gradelake.plans import queries

RANKS = str(public_tokenizers.path("byte_bpe_50k.tiktoken"))
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def own():
    t = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    t.encode_special_tokens = True
    return lambda text: None if text is None else len(t.encode(text, add_special_tokens=False).ids)


def test_merging_takes_the_lowest_rank_first():
    ranks = {b"a": 0, b"b": 1, b"c": 2, b"bc": 3, b"ab": 4, b"abc": 5, b"cc": 6}
    assert TK.merge(b"abc", ranks) == [b"abc"]
    assert TK.merge(b"abcc", ranks) == [b"abc", b"c"]
    assert TK.merge(b"cccc", ranks) == [b"cc", b"cc"]
    assert TK.merge(b"", ranks) == []


def test_merging_against_repeated_search():
    ranks, draw = TK.read_ranks(RANKS), random.Random(3)

    def plain(word):
        parts = [word[i : i + 1] for i in range(len(word))]
        while True:
            best = min(((ranks.get(parts[i] + parts[i + 1], 1 << 30), i) for i in range(len(parts) - 1)), default=(1 << 30, 0))
            if best[0] == 1 << 30:
                return parts
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]

    for _ in range(500):
        word = "".join(draw.choices("aaabcdeioust nrlé.中", k=draw.randint(1, 40))).encode()
        assert TK.merge(word, ranks) == plain(word)
    assert len(TK.merge(b"a" * 200_000, ranks)) > 1


@pytest.mark.parametrize("hot_words", [TK.HOT_WORDS, 20])
def test_counts_are_the_tokenizers_own(spark, own, hot_words):
    rows = [(r["doc_id"], r["text"]) for r in pq.read_table(f"{SF}/documents.parquet").to_pylist()]
    odd = [None, "", " ", "\n\n \t x", "it's we'll 'tis", "Ünïcödé 中文字 🙂", "a" * 5000, "  two  blanks   end   ", "x y 12³ <|endoftext|>"]
    rows += [(-1 - i, t) for i, t in enumerate(odd)]
    table = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = dict(TK.token_counts(table, ["doc_id"], "text", RANKS, hot_words=hot_words).collect())
    assert got == {i: own(t) for i, t in rows}


def test_queries(spark, own):
    docs = {r["doc_id"]: r["text"] for r in pq.read_table(f"{SF}/documents.parquet").to_pylist()}
    assert dict(queries()["tx39_bpe_token_counts"](spark, SF).collect()) == {i: own(t) for i, t in docs.items()}
    size = {}
    for r in pq.read_table(f"{SF}/conversations.parquet").to_pylist():
        size[r["conv_id"]] = size.get(r["conv_id"], 0) + own(r["text"])
    short = dict(queries()["pr16_tx39_keep_short_by_tokens"](spark, SF).collect())
    assert short == {c: n for c, n in size.items() if n <= 1024} and 0 < len(short) < len(size)
