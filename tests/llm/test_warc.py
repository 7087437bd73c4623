import hashlib

from gradelake.llm import warc as W

PAGES = "page_id bigint, url string, html string, value string, digest string, payload string, size string"


def expected(rows):
    first = {}
    for page_id, _, html in rows:
        body = (html or "").encode()
        if len(body) >= 100:
            first[body] = min((x for x in (first.get(body), page_id) if x is not None), default=None)
    out = []
    for page_id, url, html in rows:
        body = (html or "").encode()
        revisit = body in first and first[body] != page_id
        out.append((page_id, len(body), hashlib.sha256(body).hexdigest(), "revisit" if revisit else "response", first[body] if revisit else None))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=str)


def test_tables(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    rows = [tuple(r) for r in pages.select("page_id", "url", "html").collect()]
    assert got(W.archive(pages)) == expected(rows)


def test_payloads_that_look_like_records(spark, tmp_path):
    big = "x" * 99
    texts = [
        None, "", big, big, big + "é", big + "é", big + "é", "WARC/1.1\r\nWARC-Type: response\r\n\r\n" + big, "\r\n\r\n" * 40, big + "\r\n\r\n", "\r\n\r\nWARC/1.1\r\n" * 30,
        "a\rb\nc\r\n" * 50, "﻿" + big * 2, "WARC/1.1", "WARC/1.1\r\n", "é" * 200_000, "Content-Length: 5\r\n" * 20,
    ]
    rows = [(100 - i, f"http://a/{i}\r\nWARC-Type: x" if i % 3 else None, t) for i, t in enumerate(texts)]
    rows += [(7, "u", "r" * 150), (7, "u", "r" * 150), (9, "v", "r" * 150), (None, "w", "n" * 150), (None, "w", "n" * 150), (None, None, "r" * 150)]
    pages = spark.createDataFrame([(*r, *"abcd") for r in rows], PAGES)
    folder = str(tmp_path / "archive")
    W.write(pages, folder)
    back = W.read(spark, folder)
    assert got(back) == expected(rows)
    whole = {r["page_id"]: r["payload"] for r in back.where("record_type = 'response' AND page_id > 20").collect()}
    assert whole and all(v == (texts[100 - k] or "") for k, v in whole.items())
    assert {r["url"] for r in back.collect()} == {u and u.replace("\r", "%0D").replace("\n", "%0A") for _, u, _ in rows}
    data = b"".join(p.read_bytes() for p in (tmp_path / "archive").glob("part-*"))
    assert data.count(b"WARC-Record-ID: ") == len(rows)


def test_split_anywhere(spark, tmp_path):
    rows = [(i, f"u{i}", f"{i} " + "line\r\n\r\n" * (i % 50)) for i in range(400)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").coalesce(1)
    folder = str(tmp_path / "archive")
    W.write(pages, folder)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("977b", "4099b", "64k"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            assert got(W.read(spark, folder)) == expected(rows)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_empty_table(spark):
    assert W.archive(spark.createDataFrame([], "page_id bigint, url string, html string")).isEmpty()
