import hashlib
import re

from gradelake.llm import disclosure as D

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(d):
    return sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0


def base(text):
    text = text or ""
    out = [(0, *m.span()) for m in EMAIL.finditer(text)]
    out += [(1, *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        d = re.sub("[^0-9]", "", m[0])
        if 13 <= len(d) <= 19 and luhn(d):
            out.append((2, *m.span()))
    return out + [(3, *m.span()) for m in PHONE.finditer(text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]


def check(rows, got):
    want = []
    for doc_id, text in rows:
        found = base(text)
        sha = hashlib.sha256(",".join(f"{D.KINDS[k]}:{a}:{b}" for k, a, b in found).encode()).hexdigest()
        want.append((doc_id, *(sum(f[0] == k for f in found) for k in range(4)), sha))
    assert sorted(want, key=str) == sorted(((r["doc_id"], r["n_email"], r["n_ip"], r["n_card"], r["n_phone"], r["base_sha256"]) for r in got), key=str)


HARD = [
    "a@b.com_x@y.com a@b.c.d-e.@f.g @x.y a@@b.c a@b a.b%c+d-e@x-y.z1", "1.2.3.4.5.6.7.8 256.1.1.1 01.002.0003.4 1.2.3 1..2.3.4 999999999999999999999.1.1.1",
    "4111 1111 1111 1111 4111-1111-1111-1112 4111  1111 1111 1111 378282246310005 12", "+1 (017) 555-7713 +12345678 +123456789012345678 +1() 2+3 4567 890 123 + 1 2",
    "é@é.de x@y.z" * 50, None, "", "@" * 50 + "a@b.c", "1" * 3000 + "." + "2" * 10 + ".3.4", "a@b.com" + "c@d.org",
]


def test_base_spans(docs, raw_docs, make):
    got = D.scan(docs).collect()
    check([(r["doc_id"], r["text"]) for r in raw_docs], got)
    for r in got:
        found = [s.split(":")[0] for s in r["spans"].split(",") if s]
        assert r["n_term"] == found.count("term") and (r["n_term"] == 0 or len(found) > r["n_term"])
    rows = list(enumerate(HARD))
    check(rows, D.scan(make(rows)).collect())


def test_odd_and_empty(odd, make):
    check([(r["doc_id"], r["text"]) for r in odd.collect()], D.scan(odd).collect())
    assert D.scan(make([]).limit(0)).isEmpty() and D.sanitise(make([]).limit(0)).isEmpty()


def test_terms_that_give_an_entity_away(make):
    rows = [(i, f"common words about weather number of the day {chr(97 + i % 26)}") for i in range(200)]
    rows += [(300, "write to Zebrowski zeb@mail.example about the weather"), (301, "the astronomer Zebrowski has zeb@mail.example as common address")]
    rows += [(302, "copied text with Quillfeather and q@mail.example inside")] + [(303 + i, "copied text with Quillfeather and q@mail.example inside") for i in range(20)]
    rows += [(400, "Zebrowski without an address")]
    got = {r["doc_id"]: r for r in D.scan(make(rows)).collect()}
    # seen three times, in two contexts with the entity: PMI = log2(n * 2 / (2 * 3)), IC = log2(n / 2)
    text = dict(rows)[300]
    at = text.index("Zebrowski")
    assert f"term:{at}:{at + 9}" in got[300]["spans"]
    # copies are one context: the name stands nowhere else
    at = rows[202][1].index("Quillfeather")
    for i in range(302, 323):
        assert f"term:{at}:{at + 12}" in got[i]["spans"]
    assert got[400]["spans"] == "" and all(got[i]["spans"] == "" for i in range(200))
    clean = {r["doc_id"]: r["text"] for r in D.sanitise(make(rows)).collect()}
    assert clean[300] == "write to [name] [email] about the weather"
    assert clean[400] == rows[-1][1] and clean[5] == rows[5][1]


def test_spans_of_terms_do_not_touch_entities(docs, raw_docs):
    texts = {r["doc_id"]: r["text"] for r in raw_docs}
    for r in D.scan(docs).where("n_term > 0").collect():
        spans = D.parsed(r["spans"])
        assert spans == sorted(spans)
        assert all(re.fullmatch(r"[^\W_]{2,}", texts[r["doc_id"]][a:b]) for k, a, b in spans if k == 4)


def test_an_entity_that_stands_once_has_terms(make):
    rows = [(i, f"common words about weather number of the day {chr(97 + i % 26)}") for i in range(200)]
    rows += [(500, "the surgeon Okonkwo answers ok@mail.example about the weather")]
    clean = {r["doc_id"]: r["text"] for r in D.sanitise(make(rows)).collect()}
    assert clean[500] == "the  [name]  [email] about the weather"


def degrees(rows):
    """(entity, term) -> degree by plain counting over whole documents."""
    import math

    seen, df = {}, {}
    for _, text in rows:
        text = text or ""
        for t in {t for t in re.findall(r"[^\W_]+", text.lower()) if len(t) >= 2}:
            df[t] = df.get(t, 0) + 1
        here = {}
        for k, a, b in base(text):
            before, after = text[:a].split()[-25:], text[b:].split()[:25]
            near = {t for w in before + after for t in re.findall(r"[^\W_]+", w.lower()) if len(t) >= 2}
            here.setdefault(D.entity_key(k, text[a:b]), set()).update(near)
        for e, near in here.items():
            seen.setdefault(e, []).append(frozenset(near))
    out = {}
    for e, sets in seen.items():
        n_e = len(set(sets))
        for t in set().union(*sets):
            n_et, places = sum(t in s for s in set(sets)), sum(t in s for s in sets)
            once = n_et == 1
            n_t = max(df[t] - places, 0) + n_et + once
            info = math.log2(len(rows) / n_e)
            out[e, t] = math.log2(len(rows) * (1 / n_e if once else n_et) / (n_e * n_t)) / info if info > 0 else 0.0
    return out


def test_terms_against_plain_counts(make):
    import random

    rng = random.Random(5)
    common = [f"w{i}" for i in range(40)]
    rows = []
    for i in range(300):
        words = [rng.choice(common) for _ in range(rng.randint(3, 90))]
        if i % 5 == 0:
            e = rng.randint(0, 12)
            for _ in range(rng.randint(1, 3)):
                words.insert(rng.randint(0, len(words)), f"u{e}@mail.example")
            words.insert(rng.randint(0, len(words)), f"Name{e % 9}")
            words.insert(rng.randint(0, len(words)), rng.choice(["Li", "Ng", "K77", "4482"]))
        rows.append((i, " ".join(words)))
    rows += [(400 + i, rows[i % 25][1]) for i in range(60)] + [(500, None), (501, "")]
    want, got = degrees(rows), {r["doc_id"]: r for r in D.scan(make(rows)).collect()}
    for doc_id, text in rows:
        text, spans = text or "", base(text)
        asked = set()
        for k, a, b in spans:
            near = " ".join(text[:a].split()[-25:] + text[b:].split()[:25]).lower()
            key = D.entity_key(k, text[a:b])
            asked |= {t for t in re.findall(r"[^\W_]+", near) if want.get((key, t), 0) >= D.DISCLOSES}
        terms = [(4, *m.span()) for m in re.finditer(r"[^\W_]+", text) if m[0].lower() in asked and not any(a < m.end() and m.start() < b for _, a, b in spans)]
        assert got[doc_id]["spans"] == D.joined(spans + terms), doc_id
    assert sum(r["n_term"] for r in got.values()) > 50


def test_long_words_short_names_and_numbers_are_near(make):
    rows = [(i, f"common words about weather number of the day {chr(97 + i % 26)}") for i in range(200)]
    far = " ".join("x" * 300 for _ in range(24))
    rows += [(300, f"Ng {far} staff@mail.example"), (301, f"beyond Wu {far} desk@mail.example"), (302, "case 48213 for case@mail.example")]
    got = {r["doc_id"]: r["spans"] for r in D.scan(make(rows)).collect()}
    got = {i: s.split(",") for i, s in got.items()}
    assert "term:0:2" in got[300]
    assert "term:0:6" not in got[301] and "term:7:9" in got[301]
    assert "term:5:10" in got[302]


def test_many_entities_in_one_long_text_take_linear_time(make):
    text = " ".join(f"word{i} p{i % 7}@mail.example" for i in range(60_000))
    (row,) = D.scan(make([(1, text)])).collect()
    assert row["n_email"] == 60_000
