import math
import random
import re
from collections import defaultdict
from fractions import Fraction

from pyspark.sql import functions as F

from gradelake.llm import mixing as M

WORD = re.compile("[^\x20\x09-\x0d]+")


def water_level(sizes, weights=M.WEIGHTS, repeats=3):
    """Targets by sharing again and again."""
    names = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, rest = dict.fromkeys(names, 0.0), float(sum(sizes.values()))
    while rest > 1e-9:
        live = [s for s in names if target[s] < repeats * sizes[s] - 1e-9]
        if not live:
            break
        w = sum(weight[s] for s in live)
        shared = {s: rest * weight[s] / w for s in live}
        rest = 0.0
        for s in live:
            target[s] += shared[s]
            rest += max(0.0, target[s] - repeats * sizes[s])
            target[s] = min(target[s], repeats * sizes[s])
    return target


def check(rows, got, block=M.BLOCK_WORDS):
    sizes, own = defaultdict(int), []
    for r in rows:
        n = len(WORD.findall(r["text"] or ""))
        sizes[r["source"]] += n
        own.append((r["doc_id"], n))
    assert sorted(own, key=str) == sorted([(r["doc_id"], r["size"]) for r in got], key=str)
    target, took, shards = water_level(sizes), defaultdict(int), defaultdict(int)
    for r in got:
        assert 0 <= r["taken"] <= 3 * r["size"]
        assert r["source_size"] == sizes[r["source"]]
        assert math.isclose(r["target"], target[r["source"]], rel_tol=1e-9, abs_tol=1e-6)
        took[r["source"]] += r["taken"]
        shards[r["source"]] += 1
    for s in sizes:
        assert abs(took[s] - target[s]) <= 3 * block + 0.01 * target[s] + block * shards[s] / 64, (s, took[s], target[s])


def test_mix_of_the_tables(docs, raw_docs):
    got = M.mix(docs).collect()
    check(raw_docs, got)
    assert sorted(got) == sorted(M.mix(docs.repartition(3)).collect())


def test_odd_rows(odd):
    check([r.asDict() for r in odd.collect()], M.mix(odd).collect())


def test_targets_stop_and_share_again(make):
    rows = [(i, "w " * 40, "abcdefgh"[min(i % 40, 7)]) for i in range(400)]
    check([{"doc_id": r[0], "text": r[1], "source": r[2]} for r in rows], M.mix(make(rows)).collect())


def test_apportion_is_sainte_lague(spark):
    votes = {"g": [53_000, 24_000, 23_000, 10, 0], "h": [1, 1, 1], "i": [7_000_003, 1_999_999, 500_000, 12_345]}
    for house in (0, 1, 2, 7, 100, 1001):
        rows = [(g, i, v, house, 10**9) for g, vs in votes.items() for i, v in enumerate(vs)]
        df = spark.createDataFrame(rows, "g string, i int, v bigint, house bigint, most bigint")
        got = {(r["g"], r["i"]): r["seats"] for r in M.apportion(df, "house", "v", "most", ["g"], [F.col("i")], "seats").collect()}
        for g, vs in votes.items():
            want = [0] * len(vs)
            for _ in range(house):
                best = max(range(len(vs)), key=lambda i: (Fraction(vs[i], 2 * want[i] + 1), -i))
                want[best] += 1
            assert [got[g, i] for i in range(len(vs))] == want, (g, house)


def test_mixed_documents(docs, odd, make):
    mixed = M.mixed_documents(docs)
    assert mixed.columns == docs.columns
    words = {r[0]: r[1] for r in mixed.groupBy("source").agg(F.sum(M.word_count()).alias("n")).collect()}
    want = {r["source"]: r["target"] for r in M.mix(docs).collect()}
    assert abs(sum(words.values()) - sum(want.values())) < 0.15 * sum(want.values())
    assert M.mixed_documents(odd).columns == odd.columns
    assert M.mixed_documents(odd).where("times <> 'x' OR copy <> 'x'").isEmpty()
    assert M.mix(make([]).limit(0)).isEmpty() and M.mixed_documents(make([]).limit(0)).isEmpty()


def test_mixed_documents_meet_the_target_of_each_source(make):
    rng = random.Random(4)
    rows = [(i, " ".join(["w"] * rng.randint(30, 50)), "abcdef"[i % 6]) for i in range(9000)]
    docs = make(rows)
    words = {r[0]: r[1] for r in M.mixed_documents(docs).groupBy("source").agg(F.sum(M.word_count()).alias("n")).collect()}
    want = {r[0]: (r[1], r[2]) for r in M.mix(docs).groupBy("source").agg(F.first("target"), F.sum("taken")).collect()}
    shards = 1500 / 64
    for s, (target, taken) in want.items():
        assert abs(words[s] - taken) <= 50 * shards / 4, (s, words[s], taken)
        # the blocks at the ends of shards are not full
        assert abs(words[s] - target) <= 50 * shards / 4 + M.BLOCK_WORDS * shards, (s, words[s], target)
