import re
from collections import Counter

from gradelake.llm import quality_ledger as Q

WORD = re.compile("[^\x20\x09-\x0d]+")


def measured(text):
    text = text or ""
    words = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often = Counter(windows)
    repeated = {i + j for i, w in enumerate(windows) if often[w] > 1 for j in range(5)}
    return (len(words), sum(map(len, words)), len(re.findall("[#*$%&|<>]", text)), dup, len(repeated))


def check(rows, ledger):
    got = sorted(ledger.select("doc_id", *Q.MEASURES[:5]).collect(), key=str)
    assert sorted([(r["doc_id"], *measured(r["text"])) for r in rows], key=str) == sorted(map(tuple, got), key=str)


def test_measures_match_brute_force(docs, raw_docs):
    check(raw_docs, Q.ledger(docs))


def test_odd_rows(odd):
    check([r.asDict() for r in odd.collect()], Q.ledger(odd))


def test_repeats_and_lines(make):
    rows = [(1, "a b c d e\na b c d e\n\n \n \na b c d e"), (2, "a b c d e f a b c d e"), (3, "same\nsame\nsame ")]
    check([{"doc_id": r[0], "text": r[1]} for r in rows], Q.ledger(make(rows)))


def test_filter_keeps_columns_and_rejects_junk(docs, raw_docs, sf, spark, odd):
    kept = Q.filter_documents(docs)
    assert kept.columns == docs.columns
    ids = {r["doc_id"] for r in kept.select("doc_id").collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    good = [d for d, q in labels.items() if q == 1 and len((raw_docs[d]["text"] or "").split()) >= 10]
    bad = [d for d, q in labels.items() if q == 0]
    assert len(ids & set(good)) >= 0.99 * len(good)
    assert len(ids & set(bad)) <= 0.2 * len(bad)
    assert Q.filter_documents(odd).columns == odd.columns
    assert Q.filter_documents(odd).where("column_0 <> 'x'").isEmpty()


def test_ablation_counts_what_each_rule_alone_rejects(docs):
    ledger = Q.ledger(docs)
    rows = [r["failed"] & Q.mask(Q.CURRENT) for r in ledger.collect()]
    for r in Q.ablation(ledger).collect():
        bit = 1 << list(Q.RULES).index(r["rule"])
        assert (r["n_failed"], r["n_only_this"], r["n_passed"]) == (sum(bool(x & bit) for x in rows), rows.count(bit), sum(not x & bit for x in rows))


def test_empty_table(make):
    empty = make([]).limit(0)
    assert Q.ledger(empty).isEmpty()
    assert Q.filter_documents(empty).columns == empty.columns
    assert all(r["n_failed"] == 0 for r in Q.ablation(Q.ledger(empty)).collect())
