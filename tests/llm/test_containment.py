import re

from gradelake.llm import containment as T


def tokens(text):
    return re.findall(r"[a-z0-9\u0080-\U0010ffff]+", "".join(c.lower() if c.isascii() else c for c in text or ""))


def shingles(text, k):
    w = tokens(text)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def expected(docs, items, t=0.8):
    out = set()
    for item in items:
        n = len(tokens(item["text"]))
        k = min(5, n)
        want = shingles(item["text"], k) if n else set()
        for d in docs:
            shared = len(want & shingles(d["text"], k)) if want else 0
            if want and shared >= t * len(want) - 1e-9:
                out.add((d["doc_id"], item["item_id"], shared, len(want)))
    return out


def got(rows):
    return sorted(tuple(r)[:4] for r in rows.collect())


def test_all_links_of_the_tables(spark, docs, raw_docs, sf):
    items = spark.read.parquet(f"{sf}/benchmark.parquet")
    found = got(T.leaks(docs, items))
    assert found and set(found) == expected(raw_docs, [r.asDict() for r in items.collect()])
    assert got(T.leaks(docs, items, block_items=7)) == found


def test_partial_copies_at_and_below_the_threshold(spark, make):
    item = [f"w{i}" for i in range(54)]  # 50 shingles; a changed word costs up to five
    items = spark.createDataFrame([(1, " ".join(item)), (2, None), (3, ""), (4, "Short item"), (5, "a b c d e f")], "item_id bigint, text string")
    rows = []
    for n, changed in enumerate([[], [10], [10, 30], [10, 30, 3], [0, 53, 25, 26], [5, 15, 25], [0, 1, 2, 3, 4, 5, 6, 7, 8, 9], list(range(11))]):
        text = [f"x{i}" if i in changed else w for i, w in enumerate(item)]
        rows.append((n, "lead in " * 3000 + " ".join(text).upper() + "! " + "out " * 50))
    rows += [(50, "a, short. ITEM"), (51, "a B c d e f"), (51, "a B c d e f"), (52, None), (53, "")]
    docs = make(rows)
    want = expected([{"doc_id": r[0], "text": r[1]} for r in rows], [r.asDict() for r in items.collect()])
    found = got(T.leaks(docs, items))
    assert set(found) == want
    assert (51, 5, 2, 2) in found and found.count((51, 5, 2, 2)) == 2
    assert any(r[0] == 50 and r[1] == 4 for r in found)
    clean = T.clean_documents(docs, items)
    assert clean.columns == docs.columns
    assert {r["doc_id"] for r in clean.collect()} == {r[0] for r in rows} - {r[0] for r in found}


def test_odd_and_empty(spark, odd, make):
    items = spark.createDataFrame([(1, "one two three four five six")], "item_id bigint, text string")
    assert [r[:2] for r in got(T.leaks(odd, items))] == [(4, 1), (4, 1)]
    assert T.clean_documents(odd, items).count() == odd.count() - 2
    assert T.leaks(odd, items.limit(0)).isEmpty()
    assert T.clean_documents(make([]).limit(0), items).isEmpty()
