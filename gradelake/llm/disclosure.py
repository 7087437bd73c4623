"""Information-theoretic sanitisation of personal data.

Fixed patterns find the protected entities (addresses, numbers). Terms that stand near an entity may reveal it although
they match no pattern; how strongly is estimated from the corpus. With N documents, a term t discloses an entity e to
the degree PMI(e; t) / IC(e), where ``PMI = log2(N n(e, t) / (n(e) n(t)))`` and ``IC(e) = log2(N / n(e))``: 1 if the
term stands nowhere but with the entity. The unit of n(e) and n(e, t) is a different context: the set of terms near the
entity in one document. Exact copies, and near copies that agree around the entity, are one unit, in n(t) as well: n(t)
is the number of documents with the term that do not show the pair, plus the units of the pair. A pair that one unit
alone shows weighs less: n(e, t) is 1 / n(e), and n(t) is taken one higher. Terms at or above ``DISCLOSES`` are spans of
kind ``term`` wherever they stand in a document that shows the pair. All counts are over all documents. Sanitised text
puts a class name for entities, and generalises terms to their shape class or removes them.

A term is a run of two letters or digits and more, without case. Near are the ``NEAR`` blank-separated words on each
side, counted from the entity, whatever their length.

Documents without an entity are left as they are. Positions are code points, ends exclusive. Kinds in order: email, ip,
card, phone, term.

Defined cases: a null or empty text has no spans; a term that touches an entity is no span; equal degrees at the
threshold all count; rows with equal ids are read one by one; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradelake.llm import common as C

KINDS = ("email", "ip", "card", "phone", "term")
DISCLOSES = 0.8
#: Words on each side of an entity that count as its context.
NEAR = 25
TERM_LEAST = 2

_LOCAL = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_HOST = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a number begins where a run of digits begins: runs are matched whole, so no later start can match
IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")
_TERM = re.compile(r"[^\W_]+")
_WORD = re.compile(r"\S+")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of ``local@host.host``, each sign looked at once: a match begins where its run of local characters begins."""
    at = after = 0
    while (at := text.find("@", at)) >= 0:
        start = at
        while start > after and text[start - 1] in _LOCAL:
            start -= 1
        host = _HOST.match(text, at + 1) if start < at else None
        at += 1
        if host:
            yield start, host.end()
            at = after = host.end()


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def entities(text: str) -> list[tuple[int, int, int]]:
    """(number of kind, start, end) of the fixed patterns, in order."""
    out = [(0, a, b) for a, b in emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        for m in IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.groups()):
                out.append((1, *m.span()))
        for m in CARD.finditer(text):
            digits = re.sub("[^0-9]", "", m[0])
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append((2, *m.span()))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                    out.append((3, *m.span()))
    return out


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def parsed(spans: str) -> list[tuple[int, int, int]]:
    parts = (s.split(":") for s in spans.split(",") if s)
    return [(KINDS.index(k), int(a), int(b)) for k, a, b in parts]


def near_terms(text: str, found: list[tuple[int, int, int]]) -> dict[str, set[str]]:
    """Of every entity the terms among the ``NEAR`` words before and after its places. The text is cut once for all."""
    words = [m.span() for m in _WORD.finditer(text)]
    starts, ends = [w[0] for w in words], [w[1] for w in words]
    terms = [m for m in _TERM.finditer(text) if m.end() - m.start() >= TERM_LEAST]
    begins = [m.start() for m in terms]
    out: dict[str, set[str]] = {}
    for k, a, b in found:
        first, last = bisect_left(starts, a) - NEAR, bisect_right(ends, b) + NEAR
        low, high = starts[max(first, 0)], ends[min(last, len(ends)) - 1]
        near = terms[bisect_left(begins, low) : bisect_left(begins, high)]
        out.setdefault(entity_key(k, text[a:b]), set()).update(m[0].lower() for m in near if m.end() <= a or m.start() >= b)
    return out


def entity_key(kind: int, value: str) -> str:
    """Writings of one number or address are one entity."""
    return f"{KINDS[kind]}:{value.lower() if kind < 2 else re.sub('[^0-9]', '', value)}"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("entity", pa.string()), ("terms", pa.list_(pa.string()))]))
    for batch in C.steps(batches):
        counts = ([], [], [], [])
        spans, shas, near, texts = [], [], [], []
        for text in batch.column("text").to_pylist():
            found = entities(text) if text else []
            for k in range(4):
                counts[k].append(sum(s[0] == k for s in found))
            spans.append(joined(found))
            shas.append(hashlib.sha256(spans[-1].encode()).hexdigest())
            near.append([{"entity": e, "terms": sorted(t)} for e, t in near_terms(text, found).items()] if found else [])
            # later steps read no text but those with an entity
            texts.append(text if found else None)
        columns = [*(pa.array(c, pa.int64()) for c in counts), pa.array(shas, pa.string()), pa.array(spans, pa.string()), pa.array(near, kind), pa.array(texts, pa.string())]
        names = [*batch.schema.names[1:], "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "base", "near", "held"]
        yield pa.RecordBatch.from_arrays([*batch.columns[1:], *columns], names)


def _terms(text: Column) -> Column:
    runs = F.array_distinct(F.split(F.lower(text), r"[^\p{L}\p{N}]+"))
    return F.filter(runs, lambda w: F.length(w) >= TERM_LEAST)


def disclosing(docs: DataFrame, near: DataFrame, threshold: float = DISCLOSES) -> DataFrame:
    """(entity, term, degree) of every pair at or above the threshold. ``near``: a row per document and entity, with its terms."""
    n_docs = docs.agg(F.count(F.lit(1)).alias("n_docs"))
    # documents that agree around the entity are one unit; a hot entity is spread by its contexts
    units = C.written(near.groupBy("entity", "terms").agg(F.count(F.lit(1)).alias("places")), "units")
    held = units.groupBy("entity").agg(F.count(F.lit(1)).alias("n_entity"))
    met = units.select("entity", "places", F.explode("terms").alias("term"))
    met = C.written(met.groupBy("entity", "term").agg(F.count(F.lit(1)).alias("n_both"), F.sum("places").alias("places")), "met")
    counts = docs.select(F.explode(_terms(F.col("text"))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df_term"))
    # an inner join: a semi join would be moved below the sums, and every word of every document would be shuffled
    priced = counts.join(met.select("term").distinct(), "term")
    rows = met.join(priced, "term", "left").join(held, "entity").join(F.broadcast(n_docs))  # n_docs is one row
    information = F.log2(F.col("n_docs") / F.col("n_entity"))
    once = F.col("n_both") == 1
    both = F.when(once, 1 / F.col("n_entity")).otherwise(F.col("n_both"))
    elsewhere = F.greatest(F.coalesce("df_term", F.lit(0)) - F.col("places"), F.lit(0))
    pmi = F.log2(F.col("n_docs") * both / (F.col("n_entity") * (elsewhere + F.col("n_both") + once.cast("int"))))
    degree = F.when(information > 0, pmi / information).otherwise(F.lit(0.0))
    return rows.select("entity", "term", degree.alias("degree")).where(F.col("degree") >= threshold)


def _touches(covered: list[tuple[int, int]], ends: list[int], start: int, end: int) -> bool:
    """Whether a place overlaps one of the sorted ``covered``; ``ends`` holds the largest end up to each of them."""
    i = bisect_left(covered, (end,))
    return i > 0 and ends[i - 1] > start


def _mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in C.steps(batches):
        out = []
        for text, base, terms in zip(*(batch.column(n).to_pylist() for n in ("text", "base", "terms"))):
            taken, wanted = parsed(base), set(terms)
            covered = sorted((a, b) for _, a, b in taken)
            ends = list(accumulate((b for _, b in covered), max))
            more = [(4, *m.span()) for m in _TERM.finditer(text) if m[0].lower() in wanted and not _touches(covered, ends, *m.span())]
            out.append(joined([*taken, *more]))
        yield pa.RecordBatch.from_arrays([*batch.columns[1:3], pa.array(out, pa.string())], ["id_", "key_", "every"])


def scan(docs: DataFrame, threshold: float = DISCLOSES) -> DataFrame:
    """Per document: doc_id, row_, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_term."""
    id_type = dict(docs.dtypes)["doc_id"]
    near_type = "array<struct<entity:string,terms:array<string>>>"
    schema = f"doc_id {id_type}, row_ bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, base string, near {near_type}, held string"
    found = C.written(C.map_texts(docs.select("text", "doc_id", C.row_key().alias("row_")), _scan, schema), "entities")
    near = found.where(F.size("near") > 0).select("doc_id", "row_", F.inline("near"))
    pairs = C.written(disclosing(docs, near, threshold).select("entity", "term"), "disclosing")
    # each document asks for the pairs that it shows itself, so no entity's documents meet all its terms
    shown = near.select("doc_id", "row_", "entity", F.explode("terms").alias("term")).join(pairs, ["entity", "term"])
    asked = shown.groupBy(F.col("doc_id").alias("id_"), F.col("row_").alias("key_")).agg(F.collect_set("term").alias("terms"))
    asked = C.written(asked, "asked")
    # only documents with an entity are joined, and only their texts move
    plain, holding = found.where("base = ''"), found.where("base <> ''")
    texts = holding.join(asked, C.same_row(holding, asked, ["doc_id", "row_"], ["id_", "key_"]))
    texts = texts.select(F.col("held").alias("text"), "id_", "key_", "base", "terms")
    marked = C.map_texts(texts, _mark, f"id_ {id_type}, key_ bigint, every string").distinct()
    rows = holding.join(marked, C.same_row(holding, marked, ["doc_id", "row_"], ["id_", "key_"]), "left")
    names = ["doc_id", "row_", "n_email", "n_ip", "n_card", "n_phone", "base_sha256"]
    spans = F.coalesce("every", "base")
    n_term = F.size(F.filter(F.split(spans, ","), lambda s: s.startswith("term:")))
    rows = rows.select(*names, spans.alias("spans"), n_term.cast("bigint").alias("n_term"))
    return plain.select(*names, F.col("base").alias("spans"), F.lit(0).cast("bigint").alias("n_term")).unionByName(rows)


def generalise(kind: int, value: str) -> str:
    """What stands for a span: the class of an entity; a term keeps only that it was a name or a word, or goes."""
    if kind < 4:
        return f"[{KINDS[kind]}]"
    return "[name]" if value[:1].isupper() else ""


def sanitised(text: str | None, spans: str) -> str:
    out, at = [], 0
    for start, end, kind in sorted((a, b, k) for k, a, b in parsed(spans)):
        if start >= at:
            out += [text[at:start], generalise(kind, text[start:end])]
        at = max(at, end)
    return "".join(out) + (text or "")[at:]


def _clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in C.steps(batches):
        texts = [sanitised(t, s) for t, s in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist())]
        yield pa.RecordBatch.from_arrays([*batch.columns[1:2], pa.array(texts, pa.string())], ["doc_id", "text"])


def sanitise(docs: DataFrame, threshold: float = DISCLOSES) -> DataFrame:
    """(doc_id, text) with entities and disclosing terms replaced."""
    spans = scan(docs, threshold).select(F.col("doc_id").alias("id_"), F.col("row_").alias("key_"), "spans").distinct()
    keyed = docs.select("doc_id", C.row_key().alias("row_"), F.coalesce("text", F.lit("")).alias("text"))
    rows = keyed.join(spans, C.same_row(keyed, spans, ["doc_id", "row_"], ["id_", "key_"]))
    return C.map_texts(rows.select("text", "doc_id", "spans"), _clean, f"doc_id {dict(docs.dtypes)['doc_id']}, text string")
