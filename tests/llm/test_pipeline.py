import corpus_pipeline as P


def test_stages_keep_their_contract(spark, sf, docs):
    rows, seen = docs, []
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, rows, sf)
        assert out.columns == docs.columns, name
        seen.append(out.count())
        rows = P.common.written(out, "test")
    assert docs.count() > seen[0] > seen[1] > seen[2] > 0
    last = P.STAGES[-1][1](spark, rows, sf)
    assert last.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and last.count() == seen[-1]
    assert sorted(map(tuple, P.run(spark, sf).collect())) == sorted(map(tuple, last.collect()))


def test_odd_and_empty(spark, sf, odd, make):
    for rows in (odd, make([]).limit(0)):
        first = rows
        for _, stage in P.STAGES:
            rows = P.common.written(stage(spark, rows, sf), "test")
        assert rows.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
        for name, stage in P.STAGES:
            assert stage(spark, first, sf).count() >= 0, name
