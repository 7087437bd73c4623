import hashlib
import re

from gradelake.llm import line_dedup as L

STRIP = " \t\n\x0b\x0c\r"


def key(line):
    return re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(STRIP))


def expected(rows):
    order = lambda i: (i is None, i or 0)
    holders = {}
    for doc_id, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= 10:
                holders.setdefault(key(line), set()).add(doc_id)
    out = []
    for doc_id, text in rows:
        lines = (text or "").split("\n")
        drop = [len(h := holders.get(key(x), ())) > 1 and min(h, key=order) != doc_id for x in lines]
        kept = "\n".join(x for x, d in zip(lines, drop) if not d)
        out.append((doc_id, len(lines), sum(drop), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def got(docs, **kw):
    rows = L.apply_bitmaps(docs, L.keep_bitmaps(docs, **kw)).collect()
    return sorted(((r["doc_id"], r["n_lines"], r["n_dropped"], hashlib.sha256(r["kept_text"].encode()).hexdigest()) for r in rows), key=str)


def test_tables(docs, raw_docs):
    want = expected([(r["doc_id"], r["text"]) for r in raw_docs])
    assert any(r[2] for r in want)
    assert got(docs) == want
    assert got(docs, salts=2) == want


def test_odd_rows(odd, make):
    assert got(odd) == expected([(r["doc_id"], r["text"]) for r in odd.collect()])
    same = "A line of Text that repeats"
    rows = [(i, f"{same}\nown {i} line of text\n  {same.upper()}\t\nshort\n\n{same}") for i in range(9, 1, -1)]
    rows += [(2, f"x\n{same}\x0b"), (2, f"{same}"), (None, same), (None, f"{same}\nnull line that is here twice"), (None, "null line that is here twice"), (1, None), (5, "é" * 9), (6, "é" * 9), (5, "é" * 10), (6, "é" * 10)]
    assert got(make(rows)) == expected(rows)


def test_bitmap_is_runs(make):
    same = [f"common line number {i}" for i in range(4)]
    rows = [(1, "\n".join(same)), (2, "\n".join(["own text", same[0], same[1], "more own", "and more", same[3]]))]
    assert [r["runs"] for r in L.keep_bitmaps(make(rows)).collect()] == [[1, 2, 2, 1]]


def test_no_second_exchange_for_the_windows(docs):
    plan = L._by_first(docs.selectExpr("doc_id", "doc_id AS row_", "1 AS position", "text AS hash"), ["hash"], 8)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "rangepartitioning" in plan


def test_empty_table(make):
    assert got(make([]).limit(0)) == []
