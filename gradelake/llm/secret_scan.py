"""Secret scan: fixed patterns, and values in a credential context judged by what guessing them would cost.

The cost of a value is that of its cheapest segmentation into corpus words, dates, repeats, keyboard walks and
brute-force runs, found by dynamic programming over the value's positions: the exact minimum, in time linear in the
value. Beside the best cost up to each place the programme keeps that of an open brute-force run, those of an open walk
in each direction it may have there, and the places at which a repeat may still begin to pay. A repeat copies the unit
before it any number of times and costs the logarithm of how often the unit then stands; a walk pays for its first key,
its first direction and each turn. Words cost the inverse of their share of all
words of the corpus, so the dictionary is the corpus itself: every substring of a value that could be a word is looked
up in the counts of all documents by a join. What a word owes to the values themselves is taken off its count, so that a
secret that was copied a thousand times does not become a common word. Values costlier than ``GUESSES`` are spans of
kind ``guess``; spans of the fixed patterns always stay.

Positions are code points, ends exclusive. Kinds in order: assign, access, hex, guess.

Limits: values under ``VALUE_LEAST`` code points, values with blanks, words outside ``WORD_LENGTHS`` and repeats of units
over ``UNIT`` are not looked for.

Defined cases: a null or empty text has no spans; rows with equal ids are scanned one by one; a value repeated in many
places is judged once; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradelake.llm import common as C

KINDS = ("assign", "access", "hex", "guess")
ASSIGN = re.compile("(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ASSIGN_LEAST = 12
ACCESS = re.compile("AKIA[A-Z0-9]{14,}")  # a run is one match, so 18 characters are a rest of 14
HEX = re.compile("[0-9a-f]{16,}")  # a run is one match, so the length can be asked at once
#: What a key word of ASSIGN begins with in any case; texts without it need no closer look.
KEYWORD = re.compile(rb"passw|secret|token|api_?key")

#: A name that announces a credential, then the value up to a blank or quote.
CONTEXT = re.compile(
    "(?i:pass(?:word|wd|phrase|code)?|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|credentials?|auth)(?:[\"']?\x20*[:=]\x20*|\x20is\x20)"
    "(?:\"([^\"\\s]+)\"|'([^'\\s]+)'|([^\\s\"']+))"
)
URL_LOGIN = re.compile("[A-Za-z][A-Za-z0-9+.-]*://[^\\s/:@]*:([^\\s/@]+)@")
CONTEXT_WORD = re.compile(rb"pass|pwd|secret|token|key|credential|auth|://")
VALUE_LEAST = 8
#: Decimal logarithm of the guesses from which a value counts as a secret.
GUESSES = 10.0
#: Words of the corpus dictionary: lower-cased runs of letters of these lengths, seen at least so often outside values.
WORD_LENGTHS = (3, 24)
WORD_COUNT = 3

ROWS = ("1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./")
_DAY, _MONTH, _YEAR = "(?:0[1-9]|[12]\\d|3[01])", "(?:0[1-9]|1[0-2])", "(?:19|20)\\d{2}"
_ANY_YEAR, _ANY_DAY = math.log10(130), math.log10(365 * 100)
#: Every way to read a date, and its cost; written with signs it may have any of four.
DATES = [(re.compile(_YEAR), _ANY_YEAR)]
for _sign, _more in (("", 0.0), ("([-/._])", math.log10(4))):
    _again = r"\1" if _sign else ""
    for _form in (_YEAR + _sign + _MONTH + _again + _DAY, _DAY + _sign + _MONTH + _again + _YEAR, _DAY + _sign + _MONTH + _again + r"\d{2}"):
        DATES.append((re.compile(_form), _ANY_DAY + _more))
_SEGMENT = math.log10(2)
#: The longest unit of a repeat.
UNIT = 12
#: A walk has three keys or more. It goes on with four chances in five, else turns into one of eight directions.
WALK_LEAST = 3
WALK_START, WALK_ON, WALK_TURN = math.log10(94 * 8), math.log10(1 / 0.8), math.log10(8 / 0.2)

_KEYS = {c: (2 * x + y, y) for y, row in enumerate(ROWS) for x, c in enumerate(row)}
_SHIFTED = dict(zip('!@#$%^&*()_+{}|:"<>?', "1234567890-=[]\\;',./"))


def directions(a: str, b: str) -> list[tuple]:
    """In which directions one goes from key ``a`` to ``b``: to a neighbour on the keyboard, or one on in the alphabet."""
    out = []
    if a in _KEYS and b in _KEYS:
        (x, y), (u, v) = _KEYS[a], _KEYS[b]
        if a != b and abs(u - x) <= 2 and abs(v - y) <= 1:
            out.append((u - x, v - y))
    if a.isalnum() and b.isalnum() and abs(ord(b) - ord(a)) == 1:
        out.append((ord(b) - ord(a),))
    return out


def _alphabet(c: str) -> int:
    if c.isdigit():
        return 10
    if "a" <= c <= "z" or "A" <= c <= "Z":
        return 26
    return 33 if c.isascii() else 100


def substrings(value: str) -> set[str]:
    """The lower-cased letter substrings of a value that could be words; linear in its length."""
    found = set()
    for m in re.finditer(r"[^\W\d_]+", value):
        run = m[0].lower()
        for i in range(len(run)):
            for n in range(WORD_LENGTHS[0], min(WORD_LENGTHS[1], len(run) - i) + 1):
                found.add(run[i : i + n])
    return found


def _case_cost(part: str) -> float:
    upper = sum(c.isupper() for c in part)
    if not upper:
        return 0.0
    if upper == len(part) or upper == 1 and (part[0].isupper() or part[-1].isupper()):
        return math.log10(2)
    return math.log10(sum(math.comb(len(part), k) for k in range(1, min(upper, len(part) - upper) + 1)) or 2)


def guess_cost(value: str, words: dict[str, float]) -> float:
    """Decimal logarithm of the guesses of the cheapest segmentation. ``words``: cost of each known word, likewise."""
    n = len(value)
    low = value.lower() if len(value.lower()) == n else value
    plain = [_SHIFTED.get(c, c) for c in low]
    best = [0.0] + [math.inf] * n
    brute = math.inf  # of the segmentations that end in a brute-force run
    begun: dict[tuple, float] = {}  # walks of two keys by direction
    walks: dict[tuple, float] = {}  # longer ones
    same = [0] * (UNIT + 1)  # for how many places the value repeats what stands one unit before
    starts: list[dict[int, list[int]]] = [{} for _ in same]  # where a repeat may begin, by place within the unit
    dates: dict[int, list[float]] = {}
    for j in range(1, n + 1):
        i = j - 1
        if value[i].isdigit():
            for form, cost in DATES:
                if m := form.match(value, i):
                    dates.setdefault(m.end(), []).append(best[i] + cost + _SEGMENT)
        brute = min(brute, best[i] + _SEGMENT) + math.log10(_alphabet(value[i]))
        least = min([brute, *dates.pop(j, ())])
        for k in range(WORD_LENGTHS[0], min(WORD_LENGTHS[1], j) + 1):
            cost = words.get(low[j - k : j])
            if cost is not None:
                least = min(least, best[j - k] + cost + _case_cost(value[j - k : j]) + _SEGMENT)
        ways = directions(plain[i - 1], plain[i]) if i else []
        open_walks = [*begun.items(), *walks.items()]
        walks = {w: min(c + (WALK_ON if w == v else WALK_TURN) for v, c in open_walks) for w in ways} if open_walks else {}
        begun = {w: best[j - 2] + WALK_START + _SEGMENT for w in ways}
        least = min([least, *walks.values()])
        for unit in range(1, min(UNIT, i) + 1):
            if low[i] != low[i - unit]:
                if same[unit]:
                    same[unit] = 0
                    starts[unit] = {}
                continue
            same[unit] += 1
            if same[unit] < unit:
                continue
            # a later start loses to an earlier one for good once it is not cheaper: logarithms grow slower and slower
            kept, cheapest = [], math.inf
            for at in [*starts[unit].get(j % unit, ()), j - unit]:
                cost = best[at] + math.log10((j - at) // unit + 1)
                if cost < cheapest:
                    kept.append(at)
                    cheapest = cost
            starts[unit][j % unit] = kept
            least = min(least, cheapest + _SEGMENT)
        best[j] = least
    return best[n]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, number of kind, end) of the fixed patterns, in order."""
    out = [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    if KEYWORD.search(text.encode(errors="surrogatepass").lower()):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= ASSIGN_LEAST]
    return sorted(out)


def context_values(text: str) -> list[tuple[int, int]]:
    """Places of the values that stand in a credential context."""
    if not CONTEXT_WORD.search(text.encode(errors="surrogatepass").lower()):
        return []
    found = set()
    for m in CONTEXT.finditer(text):
        g = m.lastindex
        end = m.end(g)
        while g == 3 and end > m.start(g) and text[end - 1] in ".,;:)]}!?#*&%$":
            end -= 1
        found.add((m.start(g), end))
    if "://" in text:
        found |= {m.span(1) for m in URL_LOGIN.finditer(text)}
    return sorted(x for x in found if x[1] - x[0] >= VALUE_LEAST)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in C.steps(batches):
        counts = ([], [], [])
        shas, spans, values = [], [], []
        for text in batch.column("text").to_pylist():
            found = base_spans(text) if text else []
            for k in range(3):
                counts[k].append(sum(s[1] == k for s in found))
            spans.append(joined(found))
            shas.append(hashlib.sha256(spans[-1].encode()).hexdigest())
            values.append([{"start": a, "end": b, "value": text[a:b]} for a, b in context_values(text)] if text else [])
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("value", pa.string())]))
        columns = [*(pa.array(c, pa.int64()) for c in counts), pa.array(shas, pa.string()), pa.array(spans, pa.string()), pa.array(values, kind)]
        yield pa.RecordBatch.from_arrays([*batch.columns[1:], *columns], [*batch.schema.names[1:], "n_assign", "n_access", "n_hex", "base_sha256", "base", "values"])


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        values = batch.column(0).to_pylist()
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([sorted(substrings(v)) for v in values], pa.list_(pa.string()))], ["value", "parts"])


def _costs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        known = [{w["word"]: w["cost"] for w in ws} for ws in batch.column("words").to_pylist()]
        costs = [guess_cost(v, w) for v, w in zip(batch.column("value").to_pylist(), known)]
        yield pa.RecordBatch.from_arrays([batch.column("value"), pa.array(costs, pa.float64())], ["value", "guesses_log10"])


def letter_runs(text):
    """The lower-cased letter runs of a text column that have the length of a word."""
    runs = F.split(F.lower(text), r"[^\p{L}]+")
    return F.explode(F.filter(runs, lambda w: F.length(w).between(*WORD_LENGTHS)))


def value_costs(docs: DataFrame, values: DataFrame) -> DataFrame:
    """(value, guesses_log10) of every different value; ``values`` has one row per place, so that its words can be taken off."""
    distinct = values.groupBy("value").agg(F.count(F.lit(1)).alias("places"))
    parts = C.written(C.map_texts(distinct.select("value"), _parts, "value string, parts array<string>").select("value", F.explode("parts").alias("word")), "parts")
    # all words of all documents, summed before they move
    counts = docs.select(letter_runs(F.col("text")).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    own = distinct.select("places", letter_runs(F.col("value")).alias("word")).groupBy("word").agg(F.sum("places").alias("own"))
    asked = parts.select("word").distinct()
    # an inner join: a semi join would be moved below the sums, and every word of every document would be shuffled
    known = counts.join(asked, "word").join(own, "word", "left").select("word", (F.col("n") - F.coalesce("own", F.lit(0))).alias("n"))
    known = C.written(known.where(F.col("n") >= WORD_COUNT), "words")
    total = docs.agg(F.sum(F.size(F.split(F.coalesce("text", F.lit("")), r"[^\p{L}]+"))).alias("total"))
    cost = F.log10(F.greatest(F.col("total") / F.col("n"), F.lit(1.0)))
    # total is one row
    priced = known.join(F.broadcast(total)).select("word", cost.alias("cost"))
    words = parts.join(priced, "word").groupBy("value").agg(F.collect_list(F.struct("word", "cost")).alias("words"))
    rows = distinct.select("value").join(words, "value", "left").select("value", F.coalesce("words", F.array().cast("array<struct<word:string,cost:double>>")).alias("words"))
    return C.map_texts(rows, _costs, "value string, guesses_log10 double")


def scan(docs: DataFrame, guesses: float = GUESSES) -> DataFrame:
    """Per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_guess."""
    id_type = dict(docs.dtypes)["doc_id"]
    schema = f"doc_id {id_type}, row_ bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, base string, `values` array<struct<start:bigint,`end`:bigint,value:string>>"
    found = C.written(C.map_texts(docs.select("text", "doc_id", C.row_key().alias("row_")), _scan, schema), "secrets")
    # rows that are equal in id and text have the same values
    places = found.where(F.size("values") > 0).select("doc_id", "row_", F.inline("values"))
    costs = C.written(value_costs(docs, places).where(F.col("guesses_log10") >= guesses), "costs")
    hits = places.join(costs, "value").select(F.col("doc_id").alias("id_"), F.col("row_").alias("key_"), F.struct("start", F.lit(3).alias("kind"), F.col("end").alias("end")).alias("span"))
    hits = C.written(hits.groupBy("id_", "key_").agg(F.array_sort(F.collect_set("span")).alias("more")), "hits")
    rows = found.join(hits, C.same_row(found, hits, ["doc_id", "row_"], ["id_", "key_"]), "left")
    base = F.transform(
        F.filter(F.split("base", ","), lambda s: s != ""),
        lambda s: F.struct(
            F.split(s, ":")[1].cast("bigint").alias("start"),
            (F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.split(s, ":")[0]) - 1).cast("int").alias("kind"),
            F.split(s, ":")[2].cast("bigint").alias("end"),
        ),
    )
    every = F.transform(
        F.array_sort(F.concat(base, "more")),
        lambda s: F.concat_ws(":", F.element_at(F.array(*[F.lit(k) for k in KINDS]), s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string")),
    )
    spans = F.when(F.col("more").isNull(), F.col("base")).otherwise(F.array_join(every, ","))
    return rows.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", spans.alias("spans"), F.coalesce(F.size("more"), F.lit(0)).cast("bigint").alias("n_guess"))
