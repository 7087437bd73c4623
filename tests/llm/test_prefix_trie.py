import hashlib
import random
import zlib
from collections import Counter

import duckdb
import pyarrow.parquet as pq
import pytest

from gradelake.llm import prefix_trie as T
from gradelake.llm import queries as Q

SCHEMA = "conv_id bigint, turn bigint, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def place(turn, role, text):
    return (turn is not None, turn or 0, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest())


def expected(rows):
    own = {}
    for conv_id, turn, role, text in rows:
        if conv_id is not None:
            own.setdefault(conv_id, []).append((turn, role or "", text or ""))
    own = {c: [(r, t) for _, r, t in sorted(v, key=lambda x: place(*x))] for c, v in own.items()}
    members, ends = {}, {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        whole = tuple(own.get(c - c % 100, [])[:h] + turns[h:])
        for d in range(len(whole) + 1):
            members.setdefault(whole[:d], []).append(c)
        ends.setdefault(whole, []).append(c)
    out = []
    children = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += p not in children
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1]) if p else 0
    for p, m in members.items():
        digest = hashlib.sha256(",".join(map(str, sorted(ends.get(p, [])))).encode()).hexdigest()
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children[p], leaves[p], saved[p], digest))
    return sorted(out, key=str)


def got(spark, rows):
    frame = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS a", "'x' AS depth", "2 AS place", "3 AS block", "4 AS chars", "5 AS weight")
    return sorted((tuple(r) for r in T.digests(*T.trie(frame)).select(COLUMNS).collect()), key=str)


def drawn(seed, convs=300, texts="ab", turns=9):
    draw = random.Random(seed)
    rows = []
    for c in draw.sample(range(1200), convs):
        for t in range(draw.randint(1, turns)):
            rows.append((c, draw.choice([t, t, t, None]), draw.choice(["user", "user", None]), draw.choice([*texts, "longer text"])))
    return rows


@pytest.mark.parametrize("seed, block, chunk", [(1, 4096, 4096), (2, 2, 3), (3, 3, 1)])
def test_against_brute_force(spark, monkeypatch, seed, block, chunk):
    monkeypatch.setattr(T, "BLOCK", block)
    monkeypatch.setattr(T, "CHUNK", chunk)
    monkeypatch.setattr(T, "HOT_CHILDREN", 2 if seed == 3 else 1024)
    rows = drawn(seed)
    assert got(spark, rows) == expected(rows)


def test_odd_rows(spark):
    rows = [
        (None, 0, "user", "of none"), (100, None, None, None), (100, None, None, None), (100, 3, "user", "é" * 20_000), (101, 0, "", ""), (101, 0, "", ""), (102, 1, "a", "b"),
        (102, 1, "ab", ""), (255, 0, "user", "no stem"), (256, 0, "user", "no stem"), (257, 5, "user", "x"), (9, 0, "u", "t"), (2**40, 0, "user", "x"),
    ]
    rows += [(300, None, "user", "again")] * 50 + [(c, 0, "user", "again") for c in range(300, 340)]
    assert got(spark, rows) == expected(rows)
    assert got(spark, [(None, 0, "user", "x")]) == []


def test_one_long_conversation_over_many_parts(spark, monkeypatch):
    monkeypatch.setattr(T, "BLOCK", 50)
    rows = [(700, k, "user", str(k % 7)) for k in range(900)] + [(701, k, "user", str(k % 7)) for k in range(400)]
    numbered = T.numbered(spark.createDataFrame(rows, SCHEMA).repartition(8)).where("conv_id = 700")
    assert sorted(r["place"] for r in numbered.collect()) == list(range(1, 901))
    assert got(spark, rows) == expected(rows)


def test_end_lists_are_whole(spark):
    rows = drawn(4, convs=100)
    _, lists = T.trie(spark.createDataFrame(rows, SCHEMA))
    assert sorted(i for r in lists.collect() for i in r["conv_ids"]) == sorted({r[0] for r in rows})


def test_query_and_sql_give_the_same(spark, sf):
    rows = [tuple(r[c] for c in ("conv_id", "turn", "role", "text")) for r in pq.read_table(f"{sf}/conversations.parquet").to_pylist()]
    found = sorted((tuple(r) for r in Q.op13_prefix_trie(spark, sf).select(COLUMNS).collect()), key=str)
    assert found == expected(rows)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS FROM '{sf}/conversations.parquet'")
    assert sorted(con.sql(f"SELECT {', '.join(COLUMNS)} FROM ({Q.ORACLES['op13_prefix_trie']})").fetchall(), key=str) == found
