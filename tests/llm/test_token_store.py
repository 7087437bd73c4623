import zlib

import numpy as np
import public_tokenizers
import pyarrow.dataset as ds
import pyarrow.parquet as pq
from tokenizers import Tokenizer

from gradelake.llm import token_store as T

PATH = str(public_tokenizers.path("word_bpe_49k.json"))


def expected(rows):
    whole = Tokenizer.from_file(PATH)
    out, start = [], 0
    for doc_id, text in rows:
        ids = [*whole.encode(text or "", add_special_tokens=False).ids, 2]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_ids_match_the_tokenizer(docs, raw_docs):
    got = sorted(tuple(r) for r in T.digests(T.store(docs, PATH)).collect())
    assert got == expected(sorted((r["doc_id"], r["text"]) for r in raw_docs))


def test_odd_texts(make):
    texts = [
        None, "", " ", "\n\t", "it's we'll THEY'RE x'd", "<|endoftext|> a<|startoftext|>b", "ÀÉÎ éclair,, œuvre ſs İI ŉ", "a b c\x0bd\x1ce", "é é 한글 中文 123 4x5",
        "don't-stop_me...now!! ###*** $$$", "word " * 5000, "Σας ΣΑΣ", "a\r\nb\rc", "x" * 3000,
    ]
    rows = list(enumerate(texts))
    got = sorted(tuple(r) for r in T.digests(T.store(make(rows), PATH)).collect())
    assert got == expected(rows)


def test_cache_that_starts_again_changes_nothing(raw_docs, monkeypatch):
    texts = [r["text"] for r in raw_docs]
    plain = T.Encoder(PATH).encode(texts)
    monkeypatch.setattr(T, "CACHE_WORDS", 200)
    small = T.Encoder(PATH)
    parts = [small.encode([t])[0] for t in texts]
    assert np.array_equal(np.concatenate(parts), plain[0])


def test_files_are_in_order_with_indexes(spark, docs, tmp_path):
    folder = str(tmp_path / "tokens")
    T.write(docs, folder, PATH, meta=["source"])
    files = sorted(f for f in ds.dataset(folder, format="parquet").files)
    ids = [i for f in files for i in pq.read_table(f, columns=["doc_id"]).column(0).to_pylist()]
    assert ids == sorted(ids)
    meta = pq.ParquetFile(files[0]).metadata
    column = next(meta.row_group(0).column(i) for i in range(meta.num_columns) if meta.row_group(0).column(i).path_in_schema.startswith("input_ids"))
    assert column.has_offset_index and column.has_column_index
    assert "DELTA_BINARY_PACKED" in column.encodings
    assert "source" in pq.ParquetFile(files[0]).schema_arrow.names
    few = spark.read.parquet(folder).where("doc_id = 7").select("n_tokens", "input_ids").collect()
    assert len(few) == 1 and few[0]["n_tokens"] == len(few[0]["input_ids"])


def test_ties_nulls_and_empty_table(odd, make):
    rows = T.digests(T.store(odd, PATH)).collect()
    assert len(rows) == odd.count()
    by_start = sorted(rows, key=lambda r: r["start"])
    assert [r["start"] for r in by_start] == [sum(x["n_tokens"] for x in by_start[:i]) for i in range(len(rows))]
    ids = [-1 if r["doc_id"] is None else r["doc_id"] for r in by_start]
    assert ids == sorted(ids)
    assert T.digests(T.store(make([]).limit(0), PATH)).isEmpty()
