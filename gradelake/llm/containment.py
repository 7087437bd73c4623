"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

A short item inside a long document has a tiny Jaccard similarity with it, so documents are not sketched. Items are
partitioned by their number of distinct shingles; in a partition an item of n shingles is represented by its
``n - ceil(t n) + 1`` smallest hashes. A document with at least t of the item's shingles misses fewer than that, so it
holds one of these: no item is lost, whatever the length of the document. A document with fewer shingles than t times
the smallest item of a partition skips that partition. Candidates are verified on all shingles of the item in the task
that read the document; nothing but the links leaves it.

Words are runs of letters and digits, ASCII lower-cased, so punctuation and case do not hide a leak. An item of fewer
than five words is one shingle of all its words.

Defined cases: null or empty items and documents match nothing; repeated items or documents give their rows again;
an empty table gives no rows. The items are the stated query set: they are broadcast in blocks of at most
``block_items`` items, each block against all documents, so the broadcast is bounded however large the benchmark is.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradelake.llm import common as C

SHINGLE = 5
THRESHOLD = 0.8
BLOCK_ITEMS = 20_000
_BITS = 20


def _hashed(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = C.text_bytes(texts)
    data = C.LOWER[data]
    begin, end, doc = C.spans(data, offsets, C.IN_TERM)
    return C.span_hashes(data, begin, end), doc


class Items:
    """The signatures and shingles of one block of items."""

    def __init__(self, rows: list[tuple], threshold: float, shingle: int):
        """rows: (position in ``ids``, text)."""
        self.threshold = threshold
        hashes, doc = _hashed(pa.array([t for _, t in rows], pa.string()))
        words = np.bincount(doc, minlength=len(rows))
        self.shingles: list[np.ndarray] = []
        self.number: list[int] = []
        signatures: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for k in range(1, shingle + 1):
            at_k = words == k if k < shingle else words >= k
            g, first = C.grams(hashes, doc, k)
            order = np.argsort(doc[first], kind="stable")
            cuts = np.searchsorted(doc[first][order], np.arange(len(rows) + 1))
            for i in np.flatnonzero(at_k):
                own = np.unique(g[order[cuts[i] : cuts[i + 1]]])
                n = len(own)
                for h in own[: n - self.least(n) + 1]:
                    signatures[k].append((int(h), len(self.shingles)))
                self.shingles.append(own)
                self.number.append(rows[i][0])
        self.parts = []
        for k, pairs in signatures.items():
            by_size: dict[int, list[tuple[int, int]]] = defaultdict(list)
            for h, i in pairs:
                by_size[len(self.shingles[i]).bit_length()].append((h, i))
            for part in by_size.values():
                part.sort()
                h = np.array([p[0] for p in part], np.uint64)
                smallest = min(self.least(len(self.shingles[i])) for _, i in part)
                self.parts.append((k, smallest, h, np.array([p[1] for p in part])))
        self.filters = {}
        for k in signatures:
            bits = np.zeros(1 << _BITS, bool)
            for kk, _, h, _ in self.parts:
                if kk == k:
                    bits[(h >> np.uint64(64 - _BITS)).astype(np.int64)] = True
            self.filters[k] = bits

    def least(self, n: int) -> int:
        """The shared shingles that make a match with an item of n."""
        return max(1, math.ceil(self.threshold * n - 1e-9))

    def links(self, texts: pa.Array) -> Iterator[tuple[int, int, int]]:
        """(document, item, shared shingles) of every match in a batch."""
        hashes, doc = _hashed(texts)
        for k, bits in self.filters.items():
            g, first = C.grams(hashes, doc, k)
            near = np.flatnonzero(bits[(g >> np.uint64(64 - _BITS)).astype(np.int64)])
            if not len(near):
                continue
            owner = doc[first]
            size = np.bincount(owner, minlength=len(texts))
            candidates: dict[int, set[int]] = defaultdict(set)
            for kk, smallest, signature, item in self.parts:
                if kk != k:
                    continue
                lo, hi = np.searchsorted(signature, g[near], "left"), np.searchsorted(signature, g[near], "right")
                for j in np.flatnonzero((hi > lo) & (size[owner[near]] >= smallest)):
                    candidates[int(owner[near[j]])].update(item[lo[j] : hi[j]].tolist())
            for d, items in candidates.items():
                lo, hi = np.searchsorted(owner, [d, d + 1])
                own = np.unique(g[lo:hi])
                for i in sorted(items):
                    want = self.shingles[i]
                    at = np.minimum(np.searchsorted(own, want), len(own) - 1)
                    shared = int((own[at] == want).sum())
                    if shared >= self.least(len(want)):
                        yield d, i, shared


def leaks(
    docs: DataFrame,
    items: DataFrame,
    keys: list[str] | None = None,
    threshold: float = THRESHOLD,
    shingle: int = SHINGLE,
    block_items: int = BLOCK_ITEMS,
) -> DataFrame:
    """(``keys``, item_id, n_shared, n_item, containment) for each document that holds at least ``threshold`` of an item."""
    keys = ["doc_id"] if keys is None else keys
    spark = docs.sparkSession
    texts = docs.select(F.col("text").alias("text"), *keys)
    kinds = dict(docs.select(*keys).dtypes)
    id_type = dict(items.dtypes)["item_id"]
    schema = ", ".join([*(f"`{n}` {t}" for n, t in kinds.items()), f"item_id {id_type}", "n_shared bigint", "n_item bigint", "containment double"])
    asked = items.select("item_id", "text").where(F.col("text").isNotNull())
    blocks = max(1, -(-asked.count() // block_items))
    found = None
    for b in range(blocks):
        rows = asked.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect()  # bounded by block_items
        block = spark.sparkContext.broadcast((Items([(i, r["text"]) for i, r in enumerate(rows)], threshold, shingle), [r["item_id"] for r in rows]))

        def search(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            held, ids = block.value
            for batch in C.steps(batches):
                hits = list(held.links(batch.column("text")))
                if hits:
                    at = pa.array([h[0] for h in hits])
                    size = [len(held.shingles[h[1]]) for h in hits]
                    columns = [c.take(at) for c in batch.columns[1:]]
                    columns += [pa.array([ids[held.number[h[1]]] for h in hits]), pa.array([h[2] for h in hits], pa.int64()), pa.array(size, pa.int64())]
                    columns.append(pa.array([h[2] / n for h, n in zip(hits, size)], pa.float64()))
                    yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names[1:], "item_id", "n_shared", "n_item", "containment"])

        part = C.map_texts(texts, search, schema)
        found = part if found is None else found.unionByName(part)
    return found


def clean_documents(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that leak no item. Only the keys of leaking rows are joined back."""
    keyed = docs.select("doc_id", C.row_key().alias("row_"), "text")
    found = leaks(keyed, items, ["doc_id", "row_"], threshold).select(F.col("doc_id").alias("leak_id"), F.col("row_").alias("leak_row"))
    found = C.written(found.distinct(), "leaks")
    held = C.Held(docs)
    rows = held.docs.withColumns({"own_id": held.col("doc_id"), "own_row": C.row_key(held.col("doc_id"), held.col("text"))})
    return held.back(rows.join(found, C.same_row(rows, found, ["own_id", "own_row"], ["leak_id", "leak_row"]), "left_anti"))
