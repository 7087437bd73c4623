import random
import zlib
from collections import Counter

import duckdb
import pytest

from gradelake.llm import queries as Q
from gradelake.llm import variants as V


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def expected(counts, ratio=V.RATIO, least=V.COUNT_LEAST):
    words = {w: n for w, n in counts.items() if n >= least}
    rows, alike = {}, {}
    for w in words:  # near words leave the same rest at some place, or one is a rest of the other
        for rest in {w, *(w[:i] + w[i + 1 :] for i in range(len(w)))}:
            alike.setdefault(rest, []).append(w)
    for w, n in words.items():
        around = {v for rest in {w, *(w[:i] + w[i + 1 :] for i in range(len(w)))} for v in alike[rest]}
        close = [v for v in around if near(w, v)]
        best = min(close, key=lambda v: (-words[v], v), default=None)
        form = best if best is not None and words[best] >= ratio * n else None
        rows[w] = (form, n, len(close), words[form] if form else None)
    out = set()
    for w, (form, n, n_near, form_n) in rows.items():
        root = w
        while rows[root][0]:
            root = rows[root][0]
        out.add((w, form, root, n, n_near, form_n))
    return out


def counted(rows):
    """Runs by hand: one character after another."""
    out = Counter()
    for doc_id, text in rows:
        run = ""
        for c in (text or "") + " ":
            if "a" <= c.lower() <= "z" and c.isascii() or "À" <= c <= "ÿ":
                run += c.lower() if c.isascii() else c
            elif run:
                h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
                word = run if h % 31 else run[: h % len(run)] + run[h % len(run) + 1 :]
                if len(word) >= 7:
                    out[word] += 1
                run = ""
    return out


def random_counts(seed, letters="abcé", sizes=(1, 7), n=250):
    draw = random.Random(seed)
    words = {"".join(draw.choices(letters, k=draw.randint(*sizes))) for _ in range(n)}
    return {w: draw.choice([1, 2, 3, 20, 30, 30, 400, 5000]) for w in words}


@pytest.mark.parametrize("seed", range(20))
def test_composition_accepts_the_near_pairs(seed):
    words = sorted(random_counts(seed, letters="ab" if seed % 2 else "abcdé"))
    a = V.Acceptor(words)
    left, right = V.compose(a)
    got = [tuple(sorted((words[i], words[j]))) for i, j in zip(left, right)]
    assert sorted(got) == sorted((a, b) for k, a in enumerate(words) for b in words[k + 1 :] if near(a, b))


def test_acceptor_is_minimal():
    a = V.Acceptor(sorted(x + y + "ing" for x in "abcd" for y in "xyz"))
    assert len(a.arcs) == 6 and a.size[a.start] == 12


@pytest.mark.parametrize("limit, small, first", [(V.LIMIT, V.SMALL, V.FIRST), (40, 3, 0), (10, 1, 1), (200, 8, 3)])
def test_every_expansion_gives_the_same_rows(spark, monkeypatch, limit, small, first):
    monkeypatch.setattr(V, "SMALL", small)
    counts = random_counts(5) | random_counts(6, "xy", (3, 9), 120)
    table = spark.createDataFrame(list(counts.items()), "word string, n bigint")
    got = V.group_variants(table, near=lambda v: V.near_words(v, limit, first)).collect()
    assert {tuple(r) for r in got} == expected(counts) and len(got) == len(expected(counts))


def test_long_chains_and_long_words(spark):
    counts = {"aaaaaaa" + "b" * k: 2 * 10**k for k in range(9)} | {"z" * 3000: 2, "z" * 2999 + "y": 50, "z" * 1500 + "q" + "z" * 1499: 3}
    table = spark.createDataFrame(list(counts.items()), "word string, n bigint")
    assert {tuple(r) for r in V.group_variants(table).collect()} == expected(counts)


def test_counts_of_runs(make, odd, raw_docs):
    rows = [(0, "Hallöchen×÷ Wörterbuch wörterbuch WÖRTERBUCH"), (0, "repeated repeated"), (0, "repeated repeated"), (None, "identifier"), (3, None), (4, "x" * 50_000 + "1abcdefgh")]
    rows += [(r["doc_id"], r["text"]) for r in raw_docs]
    assert dict(V.damaged_counts(make(rows)).collect()) == counted(rows)
    assert V.group_variants(V.damaged_counts(odd)).columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert V.group_variants(V.damaged_counts(odd.limit(0))).collect() == []


def test_query_and_sql_give_the_same(spark, sf, raw_docs):
    got = {tuple(r) for r in Q.op12_spelling_variants(spark, sf).collect()}
    assert got == expected(counted((r["doc_id"], r["text"]) for r in raw_docs))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS FROM '{sf}/documents.parquet'")
    assert set(con.sql(f"SELECT word, form, root, n, n_near, form_n FROM ({Q.ORACLES['op12_spelling_variants']})").fetchall()) == got
