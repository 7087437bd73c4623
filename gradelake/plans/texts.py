"""Text queries: whole documents as thinking text, with the answer styles around them."""

from __future__ import annotations

from pyspark.sql import functions as F

from gradelake.functions import extract as X
from gradelake.functions import findings as FD
from gradelake.functions import latex as LX
from gradelake.functions import prompts as P
from gradelake.functions import rewards as R
from gradelake.functions import think as TH
from gradelake.functions import tokenizer as TK
from gradelake.functions import toolcalls as TC
from gradelake.operators import evaluation as ev
from gradelake.operators import rows
from gradelake.plans.derived import RESPONSES_SQL, responses, with_
from gradelake.plans.registry import query, table

RESP = with_(RESPONSES_SQL)
STRIP = r"regexp_replace({x}, '^\s+|\s+$', '', 'g')"
POST_SQL = r""", post AS (SELECT *, regexp_replace(CASE WHEN contains(rest, '</think>') THEN list_last(string_split(rest, '</think>')) ELSE rest END, '^\s+|\s+$', '', 'g') AS answer_text
  FROM (SELECT *, regexp_replace(response, '(?s)<think>.*?</think>', '', 'g') AS rest FROM responses))
"""


def _last(pattern: str, group: int = 1) -> str:
    return f"list_last(regexp_extract_all(answer_text, '{pattern}', {group}))"


INT_SQL = [
    r"<[aA]nswer>\s*(-?\d+)\s*</[aA]nswer>",
    r"\\boxed\{\s*(-?\d+)\s*\}",
    r"\\[aA]nswer\s*\{?\s*(-?\d+)",
    r"(?i)[*_`]*\s*(?:final\s+)?answer\s*[*_`]*\s*[:：]\s*[*_`\"''(<]*\s*(-?\d+)",
    r"<[aA]nswer>\s*(-?\d+)\b",
]
LETTER_SQL = [
    r"<[aA]nswer>\s*([A-D])\s*</[aA]nswer>",
    r"\\boxed\{\s*([A-D])\s*\}",
    r"\\[aA]nswer\s*\{?\s*([A-D])\b",
    r"(?i)[*_`]*\s*(?:final\s+)?answer\s*[*_`]*\s*[:：]?\s*[*_`\"''(<]*\s*([A-D])\b",
    r"<[aA]nswer>\s*([A-D])\b",
]


def _answers(spark, sf):
    return responses(spark, sf).withColumn("answer_text", TH.strip_thinking(F.col("response")))


@query("tx1_strip_thinking", RESP + POST_SQL + "SELECT doc_id, md5(answer_text) AS digest, length(answer_text) AS n FROM post")
def _(spark, sf):
    return _answers(spark, sf).select("doc_id", F.md5("answer_text").alias("digest"), F.length("answer_text").cast("long").alias("n"))


@query(
    "tx2_tx3_tx4_thinking_parts",
    RESP
    + """SELECT doc_id, contains(response, '</think>') AS closed, md5(string_split(response, '</think>')[1]) AS before_close,
     md5(substr(response, instr(response, '</think>') + 8)) AS after_close,
     md5(CASE WHEN contains(string_split(response, '</think>')[1], '<think>') THEN substr(string_split(response, '</think>')[1], 8) ELSE string_split(response, '</think>')[1] END) AS body
   FROM responses WHERE contains(response, '</think>')
   UNION ALL SELECT doc_id, false, NULL, NULL, NULL FROM responses WHERE NOT contains(response, '</think>')""",
)
def _(spark, sf):
    r = F.col("response")
    before = TH.before_close(r)
    return responses(spark, sf).select(
        "doc_id",
        TH.thinking_is_closed(r).alias("closed"),
        F.md5(before).alias("before_close"),
        F.md5(TH.after_close(r)).alias("after_close"),
        F.md5(TH.thinking_body(before)).alias("body"),
    )


@query(
    "tx5_extract_integer",
    RESP + POST_SQL + f"SELECT doc_id, coalesce({', '.join(_last(p) for p in INT_SQL)}) AS predicted FROM post",
)
def _(spark, sf):
    return _answers(spark, sf).select("doc_id", X.extract_integer(F.col("answer_text")).alias("predicted"))


@query(
    "tx6_extract_letter",
    RESP + POST_SQL + f"SELECT doc_id, upper(coalesce({', '.join(_last(p) for p in LETTER_SQL)})) AS predicted FROM post",
)
def _(spark, sf):
    return _answers(spark, sf).select("doc_id", X.extract_letter(F.col("answer_text")).alias("predicted"))


@query(
    "tx7_extract_code",
    RESP + POST_SQL + r"SELECT doc_id, trim(" + _last(r"(?s)```(?:python|py)?\s*\n(.*?)```") + ", ' ' || chr(10)) AS predicted FROM post",
)
def _(spark, sf):
    return _answers(spark, sf).select("doc_id", X.extract_code(F.col("answer_text")).alias("predicted"))


BOXED_SQL = r""", bt AS (SELECT doc_id, answer_text AS t, regexp_replace(answer_text, '[\s.,;:!?]+$', '') AS body, regexp_replace(answer_text, '\s+$', '') AS rt FROM post),
 cut AS (SELECT *, length(t) - length(body) <= 50 AS near, left(body, length(body) - 2) AS b2, left(body, length(body) - 1) AS b1, string_split(rt, chr(10)) AS ls FROM bt),
 pick AS (SELECT *, list_last(regexp_extract_all(t, '\\boxed\{((?:[^{}]|\{[^{}]*\})*)\}', 1)) AS box,
   CASE WHEN near AND ends_with(body, '$$') AND contains(b2, '$$') THEN nullif(regexp_replace(list_last(string_split(b2, '$$')), '^\s+|\s+$', '', 'g'), '') END AS dd,
   CASE WHEN near AND ends_with(body, '\]') AND contains(b2, '\[') THEN nullif(regexp_replace(list_last(string_split(b2, '\[')), '^\s+|\s+$', '', 'g'), '') END AS sq,
   CASE WHEN near AND ends_with(body, '$') AND contains(b1, '$') THEN nullif(regexp_replace(list_last(string_split(b1, '$')), '^\s+|\s+$', '', 'g'), '') END AS one,
   regexp_replace(ls[len(ls)], '^\s+|\s+$', '', 'g') AS last, coalesce(regexp_replace(ls[len(ls) - 1], '^\s+|\s+$', '', 'g'), '') AS prev FROM cut)
"""


@query(
    "tx8_extract_boxed",
    RESP + POST_SQL + BOXED_SQL
    + r"""SELECT doc_id, coalesce(box, dd, sq, CASE WHEN NOT contains(one, chr(10)) THEN CASE WHEN contains(replace(replace(replace(replace(one, '==', ''), '<=', ''), '>=', ''), '!=', ''), '=') THEN trim(list_last(string_split(one, '='))) ELSE one END END,
      CASE WHEN length(last) BETWEEN 1 AND 80 AND prev = '' AND NOT regexp_matches(last, '(^|[^\pL\pN\pM_])[a-zA-Z]{3,}($|[^\pL\pN\pM_])') THEN last END) AS predicted FROM pick""",
)
def _(spark, sf):
    return _answers(spark, sf).select("doc_id", X.extract_boxed(F.col("answer_text")).alias("predicted"))


@query(
    "tx8_unboxed_fallbacks",
    """SELECT o_orderkey, CASE o_orderkey % 8 WHEN 0 THEN '\\binom{' || o_custkey || '}{2}' WHEN 1 THEN CAST(o_custkey AS VARCHAR) WHEN 2 THEN '3^{' || o_custkey || '}'
         WHEN 3 THEN CAST(o_custkey AS VARCHAR) WHEN 5 THEN 'q_{' || o_custkey || '}' END AS predicted FROM orders""",
)
def _(spark, sf):
    c = F.col("o_custkey").cast("string")
    k = F.col("o_orderkey") % 8
    text = (
        F.when(k == 0, F.concat(F.lit("It remains to read off\n\n$$\\binom{"), c, F.lit("}{2}$$ .")))
        .when(k == 1, F.concat(F.lit("By this $\\lambda_1 = "), c, F.lit("$.\n")))
        .when(k == 2, F.concat(F.lit("giving \\[ 3^{"), c, F.lit("} \\]")))
        .when(k == 3, F.concat(F.lit("Every other way was tried.\n\n"), c))
        .when(k == 4, F.concat(F.lit("Every other way was tried.\n\nroughly "), c))
        .when(k == 5, F.concat(F.lit("\\boxed{p}, and later \\boxed{q_{"), c, F.lit("}} in full")))
        .when(k == 6, F.concat(F.lit("never closed: \\boxed{q_{"), c, F.lit("} here")))
        .otherwise(F.concat(F.lit("between $\\mu$ and "), c, F.lit(" other words.")))
    )
    return table(spark, sf, "orders").select("o_orderkey", X.extract_boxed(text).alias("predicted"))


GRADE_SQL = f""", graded AS (SELECT *, coalesce({', '.join(_last(p) for p in INT_SQL)}) AS predicted FROM post)
"""


@query(
    "tx9_grade_integer",
    RESP + POST_SQL + GRADE_SQL + "SELECT doc_id, coalesce(CAST(predicted AS HUGEINT) = n_chars, false) AS correct FROM graded",
)
def _(spark, sf):
    p = X.extract_integer(F.col("answer_text"))
    gold = F.concat(F.lit(" +0"), F.col("n_chars").cast("string"), F.lit(" "))
    return _answers(spark, sf).select("doc_id", X.grade_integer(p, gold).alias("correct"))


@query(
    "tx10_grade_latex",
    """SELECT o_orderkey, CASE o_orderkey % 6 WHEN 4 THEN o_custkey = 0 WHEN 5 THEN false ELSE true END AS correct FROM orders""",
)
def _(spark, sf):
    c, k = F.col("o_custkey").cast("string"), F.col("o_orderkey") % 6
    wrap = lambda a, b: F.concat(F.lit(a), c, F.lit(b))
    cases = [
        (wrap("\\frac{", "}{8}"), (F.col("o_custkey") / 8).cast("string")),
        (wrap("", "\\sqrt{7}"), F.concat(F.lit("\\sqrt{"), (F.col("o_custkey") * F.col("o_custkey") * 7).cast("string"), F.lit("}"))),
        (wrap("1, ", ""), wrap("", ", 1")),
        (F.concat(F.lit("1+"), c, F.lit("\\pi, 1-"), c, F.lit("\\pi")), wrap("1 \\pm ", " \\pi")),
        (wrap("3^{2} \\cdot 4! + ", ""), wrap("2^{3}\\cdot 27+2\\cdot", "")),
        (wrap("\\dfrac12 + ", ""), wrap("1.2 + 1.2\\cdot ", "")),
    ]
    gold, pred = None, None
    for i, (g, p) in enumerate(cases):
        gold = F.when(k == i, g) if gold is None else gold.when(k == i, g)
        pred = F.when(k == i, p) if pred is None else pred.when(k == i, p)
    rows = table(spark, sf, "orders").select("o_orderkey", gold.alias("gold"), pred.alias("pred"))
    return LX.grade_latex(rows, "pred", "gold").select("o_orderkey", "correct")


@query(
    "tx11_adaptive_cap",
    "SELECT o_orderkey, least(11, 2 + greatest(0, floor((CAST(floor(o_totalprice / 5) AS BIGINT) - 1) / 5000)))::BIGINT AS cap FROM orders",
)
def _(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", X.adaptive_cap(F.floor(F.col("o_totalprice") / 5)).alias("cap"))


LINES_SQL = r""", ln AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents WHERE length(text) > 0),
 b AS (SELECT doc_id, i, regexp_replace(regexp_replace(line, '^[\s"“”]+|[\s"“”]+$', '', 'g'), '\s+$', '') AS body FROM ln)
"""


@query(
    "tx12_parse_findings",
    "WITH x AS (SELECT 1)" + LINES_SQL
    + r""", g AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS r FROM b WHERE i % 3 = 1 AND length(body) > 0
      AND NOT regexp_matches(body, '(?i)^\s*\*{0,2}\s*(?:Goal|Format|Problem(?:\s+Statement)?|Question|Given|Find|Required|Requirement|Objective|Task|To\s+Find|We\s+need|We\s+want|We\s+are\s+asked)\s*\*{0,2}\s*:\s*\S')
      AND NOT regexp_matches(body, '^\s*\*{0,2}\s*[\pL\pN_]+(?:\s+[\pL\pN_]+){0,2}\s*[:：.]\s*\*{0,2}\s*$')
      AND NOT regexp_matches(body, '(?i)^\s*(?:ANCHOR\b|FINDING\b|</?think>|<\|?channel)')),
    c AS (SELECT doc_id, r, CASE WHEN length(body) > 500 THEN regexp_replace(left(body, 500), '\s+$', '') || '...' ELSE body END AS f FROM g WHERE r <= 8)
   SELECT d.doc_id, count(f) AS n, md5(coalesce(string_agg(f, '|' ORDER BY r), '')) AS digest FROM documents d LEFT JOIN c USING (doc_id) GROUP BY d.doc_id""",
)
def _(spark, sf):
    lines = F.transform(
        F.split("text", "\n"),
        lambda x, i: F.when(i % 3 == 0, F.concat(F.when(i % 2 == 0, "- ").otherwise("12) "), x))
        .when(i % 3 == 1, F.concat(F.lit("- FINDING "), x))
        .otherwise(x),
    )
    raw = F.array_join(lines, "\n")
    d = table(spark, sf, "documents").select("doc_id", FD.parse_findings(raw, F.lit(8)).alias("f"))
    return d.select("doc_id", F.size("f").cast("long").alias("n"), F.md5(F.array_join("f", "|")).alias("digest"))


@query(
    "tx13_ag7_findings_issues",
    """SELECT CASE WHEN doc_id % 5 = 0 THEN 'empty' WHEN doc_id % 5 = 1 THEN 'meta_leak' WHEN doc_id % 5 = 2 THEN 'all_duplicates_of_prior' ELSE 'fine' END AS issue, count(*) AS n
       FROM documents GROUP BY 1""",
)
def _(spark, sf):
    k, t = F.col("doc_id") % 5, F.col("text")
    new = (
        F.when(k == 0, F.array().cast("array<string>"))
        .when(k == 1, F.array(t, F.lit("- Output AT MOST 3 findings please")))
        .when(k == 2, F.array(t, F.concat(F.lit("  "), t)))
        .otherwise(F.array(t, F.concat(F.lit("new "), t)))
    )
    d = table(spark, sf, "documents").select(F.coalesce(FD.findings_issue(new, F.array(F.concat(t, F.lit(" ")))), F.lit("fine")).alias("issue"))
    return d.groupBy("issue").agg(F.count(F.lit(1)).alias("n"))


def _pair_text(spark, sf):
    t, k = F.col("text"), F.col("doc_id") % 4
    clean = lambda s: F.regexp_replace(F.regexp_replace(s, r'["“”\n]', "x"), r"\s", "_")
    d = table(spark, sf, "documents").select("doc_id", "text", F.concat(F.lit("k"), clean(F.substr(t, F.lit(30)))).alias("a1"), F.concat(F.lit("m"), clean(t)).alias("a2"))
    a1, a2 = F.col("a1"), F.col("a2")
    raw = F.concat(
        F.lit('ANCHOR 2: "'), a1, F.lit('"\nFINDING 2: first '), a1, F.lit("\n\nANCHOR 10: “"), a2, F.lit("”\nFINDING 10: second "), a2,
        F.lit('"\nanchor 1: "dropped"\n'),
    )
    return d.select("doc_id", "text", F.concat(F.when(k == 0, "no_progress ").otherwise(""), raw).alias("raw"), "a1", "a2")


@query(
    "tx14_anchor_pairs",
    r"""WITH p AS (SELECT doc_id, 'k' || regexp_replace(regexp_replace(substr(text, 30), '["“”\n]', 'x', 'g'), '\s', '_', 'g') AS a1,
       'm' || regexp_replace(regexp_replace(text, '["“”\n]', 'x', 'g'), '\s', '_', 'g') AS a2 FROM documents)
     , j AS (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 0 ELSE 2 END::BIGINT AS pairs,
       CASE WHEN doc_id % 4 = 0 THEN '' ELSE a1 || '>first ' || a1 || '|' || a2 || '>second ' || a2 END AS joined FROM p)
     SELECT doc_id, pairs, md5(joined) AS digest FROM j""",
)
def _(spark, sf):
    d = _pair_text(spark, sf).select("doc_id", FD.anchor_pairs(F.col("raw")).alias("p"))
    joined = F.array_join(F.transform("p", lambda x: F.concat(x["anchor"], F.lit(">"), x["finding"])), "|")
    return d.select("doc_id", F.size("p").cast("long").alias("pairs"), F.md5(joined).alias("digest"))


@query(
    "tx15_ag6_anchor_match_rates",
    r"""WITH h AS (SELECT *, substr(text, length(text) // 2 + 1) AS half FROM documents),
     d AS (SELECT text, CASE doc_id % 3 WHEN 0 THEN left(half, 90) WHEN 1 THEN left(half, 60) || '§ changed' ELSE '§ nowhere ' || left(half, 60) END AS raw FROM h),
     a AS (SELECT text, regexp_replace(raw, '^\s+|\s+$', '', 'g') AS a FROM d), p AS (SELECT *, regexp_replace(left(a, 40), '^\s+|\s+$', '', 'g') AS p FROM a),
     m AS (SELECT *, CASE WHEN length(a) >= 10 AND contains(text, a) THEN 'verbatim' WHEN length(a) >= 10 AND length(p) >= 12 AND contains(text, p) THEN 'fuzzy' ELSE 'none' END AS matched FROM p),
     e AS (SELECT *, CASE matched WHEN 'verbatim' THEN length(text) - instr(reverse(text), reverse(a)) + 1 WHEN 'fuzzy' THEN length(text) - instr(reverse(text), reverse(p)) + 1 ELSE -1 END AS stop FROM m)
     SELECT matched, count(*) AS n, sum(stop + CASE WHEN matched = 'fuzzy' THEN length(regexp_extract(substr(text, stop + 1, 300), '(?s)^(.*?[.!?。！？][''"”)]?\s)', 1)) ELSE 0 END)::BIGINT AS ends FROM e GROUP BY matched""",
)
def _(spark, sf):
    # anchors from the middle of each text, so that where they end matters
    t, k = F.col("text"), F.col("doc_id") % 3
    half = F.substr(t, F.expr("length(text) div 2 + 1").cast("int"))
    anchor = (
        F.when(k == 0, F.left(half, F.lit(90)))
        .when(k == 1, F.concat(F.left(half, F.lit(60)), F.lit("§ changed")))
        .otherwise(F.concat(F.lit("§ nowhere "), F.left(half, F.lit(60))))
    )
    d = table(spark, sf, "documents")
    found = d.select(FD.anchor_match(t, F.array(anchor)).alias("matched"), FD.last_anchor_end(t, F.array(anchor)).alias("stop"))
    return found.groupBy("matched").agg(F.count(F.lit(1)).alias("n"), F.sum("stop").cast("bigint").alias("ends"))


@query(
    "tx16_trim_to_last_sentence",
    r"""WITH t AS (SELECT doc_id, text, greatest(length(text) - 500, 0) AS st, right(text, 500) AS tail FROM documents),
     m AS (SELECT *, length(regexp_extract(tail, '(?s)^(.*[.!?。！？][''")\]]?\s)', 1)) AS k, instr(reverse(tail), chr(10)) AS nl FROM t)
     SELECT doc_id, md5(CASE WHEN k > 0 THEN regexp_replace(left(text, st + k), '\s+$', '') WHEN nl > 0 AND st + length(tail) - nl > 0 THEN regexp_replace(left(text, st + length(tail) - nl), '\s+$', '') ELSE text END) AS digest FROM m""",
)
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(FD.trim_to_last_sentence(F.col("text"))).alias("digest"))


@query(
    "tx17_jn5_prior_turn_rebuild",
    """SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'with_answer' WHEN 1 THEN 'without_answer' END AS matched,
        CASE WHEN doc_id % 4 < 2 THEN md5('<think>' || text) END AS before, CASE WHEN doc_id % 4 < 2 THEN md5(' more</think> ok') END AS after FROM documents""",
)
def _(spark, sf):
    ds, q = F.lit("aime"), F.col("source")
    finds = F.array(F.lit("x = 1"), F.col("lang"))
    ans = F.col("n_chars").cast("string")
    i_ans, i_bare = P.check_injection(ds, q, finds, ans), P.check_injection(ds, q, finds, F.lit(None).cast("string"))
    k = F.col("doc_id") % 4
    injected = F.when(k == 0, i_ans).when(k == 1, i_bare).when(k == 2, i_ans).otherwise(F.lit(" nothing "))
    tail = F.when(k == 2, " more, never closed").otherwise(" more</think> ok")
    resp = F.concat(F.lit("<think>"), F.col("text"), injected, tail)
    d = table(spark, sf, "documents").select("doc_id", i_ans.alias("ia"), P.split_at_injection(resp, [i_ans, i_bare], "</think>").alias("s"))
    return d.select(
        "doc_id",
        F.when(F.col("s.matched") == F.col("ia"), "with_answer").when(F.col("s").isNotNull(), "without_answer").alias("matched"),
        F.md5("s.before").alias("before"),
        F.md5("s.after").alias("after"),
    )


@query(
    "tx18_prompt_text",
    """SELECT doc_id, 'Select the best answer. Final answer must be a single letter (A, B, C, or D) in <Answer>...</Answer>.' || chr(10) || chr(10) || text || chr(10) AS prompt FROM documents""",
)
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", P.baseline_prompt(F.lit("gpqa"), F.col("text")).alias("prompt"))


@query(
    "tx18_progress_injection",
    """SELECT doc_id, chr(10) || chr(10) || 'Let me summarize the current progress.' || chr(10) || 'The user''s request is: Solve the math problem. Final answer must be a single non-negative integer in <Answer>...</Answer>.' || chr(10)
      || 'Question: ' || source || chr(10) || 'Critical finding 1: ' || lang || chr(10) || 'Critical finding 2: ' || n_chars || chr(10) || 'Let me continue thinking from here.' || chr(10) || chr(10) AS block FROM documents""",
)
def _(spark, sf):
    finds = F.array(F.col("lang"), F.col("n_chars").cast("string"))
    return table(spark, sf, "documents").select("doc_id", P.progress_injection(F.lit("aime"), F.col("source"), finds).alias("block"))


@query(
    "tx19_tx20_question_and_gold",
    """SELECT p_partkey, p_name || chr(10) || chr(10) || 'A) ' || p_brand || chr(10) || 'B) ' || p_type || CASE WHEN p_partkey % 2 = 0 THEN chr(10) || 'C) x' || chr(10) || 'D) y' ELSE '' END AS question,
       upper(left(p_type, 1)) AS letter, CAST(p_size AS VARCHAR) AS number FROM part""",
)
def _(spark, sf):
    many = F.array(F.col("p_brand"), F.col("p_type"), F.lit("x"), F.lit("y"), F.lit("z"))
    few = F.array(F.col("p_brand"), F.col("p_type"))
    q = X.format_question(F.col("p_name"), F.when(F.col("p_partkey") % 2 == 0, many).otherwise(few))
    return table(spark, sf, "part").select(
        "p_partkey",
        q.alias("question"),
        X.ground_truth(F.lit("gpqa"), F.concat(F.lit(" "), F.lower("p_type"))).alias("letter"),
        X.ground_truth(F.lit("aime"), F.concat(F.lit(" 00"), F.col("p_size").cast("string"))).alias("number"),
    )


@query(
    "tx21_strip_code_fences",
    r"""SELECT doc_id, md5(CASE doc_id % 3 WHEN 0 THEN regexp_replace(text, '^\n+|\n+$', '', 'g') WHEN 1 THEN regexp_replace(text, '^\s+|\s+$', '', 'g') ELSE regexp_replace(text, '^\s+|\s+$', '', 'g') END) AS digest FROM documents""",
)
def _(spark, sf):
    t, k = F.col("text"), F.col("doc_id") % 3
    raw = F.when(k == 0, F.concat(F.lit("see ```python"), t, F.lit("``` end"))).when(k == 1, F.concat(t, F.lit("\n```"))).otherwise(t)
    d = table(spark, sf, "documents")
    return d.select("doc_id", F.md5(X.strip_code_fences(raw)).alias("digest"))


@query(
    "tx22_sc4_test_cases",
    """SELECT doc_id, CASE WHEN doc_id % 3 = 1 THEN 1 ELSE 2 END::BIGINT AS n_tests, CASE WHEN doc_id % 3 = 0 THEN 'solve_' || lang WHEN doc_id % 2 = 0 THEN 'main' END AS func_name FROM documents""",
)
def _(spark, sf):
    one = lambda v, name: F.struct(
        F.col("lang").alias("input"), v.alias("output"), F.lit("functional").alias("testtype"), F.struct(name.alias("func_name")).alias("metadata")
    )
    fn = F.concat(F.lit("solve_"), F.col("lang"))
    inner = F.to_json(F.array(one(F.col("text"), fn), one(F.col("source"), fn)))
    info = F.when(F.col("doc_id") % 3 == 0, F.to_json(F.struct(inner.alias("ground_truth")))).when(F.col("doc_id") % 3 == 1, "{broken")
    none = F.lit(None).cast("string")
    listed = F.when(F.col("doc_id") % 3 == 1, F.array(one(F.col("text"), none))).otherwise(
        F.array(one(F.col("text"), none), one(F.col("source"), none))
    )
    question = F.when(F.col("doc_id") % 2 == 0, F.concat(F.col("source"), F.lit(" def main (x):"))).otherwise(F.col("source"))
    d = table(spark, sf, "documents").select("doc_id", TC.test_cases(info, listed, question).alias("c"))
    return d.select("doc_id", F.size("c.tests").cast("long").alias("n_tests"), "c.func_name")


@query(
    "tx23_literal_compare",
    "SELECT o_orderkey, o_orderkey % 4 <> 3 AS same FROM orders",
)
def _(spark, sf):
    n, k = F.col("o_custkey").cast("string"), F.col("o_orderkey") % 4
    got = F.when(k == 0, F.concat(F.lit("[1, "), n, F.lit("]"))).when(k == 1, F.concat(n, F.lit(".0"))).otherwise(F.concat(F.lit("text "), n))
    want = F.when(k == 0, F.concat(F.lit("[ 1,"), n, F.lit(" ]"))).when(k == 1, n).when(k == 2, F.concat(F.lit("text "), n)).otherwise(n)
    return table(spark, sf, "orders").select("o_orderkey", TC.literal_equal(got, want).alias("same"))


@query(
    "tx24_final_number",
    r"""WITH r AS (SELECT doc_id, n_chars, right(text || CASE WHEN doc_id % 3 = 0 THEN ' #### 1,' || n_chars WHEN doc_id % 3 = 1 THEN ' is ' || n_chars || '.' ELSE '' END, 300) AS t FROM documents),
      e AS (SELECT *, replace(replace(list_last(regexp_extract_all(t, '#### (\-?[0-9\.\,]+)', 1)), ',', ''), '$', '') AS s, regexp_extract_all(t, '(\-?[0-9\.\,]+)', 1) AS f FROM r)
     SELECT doc_id, s AS strict, coalesce(list_last(list_filter(f, lambda x: x <> '.')), f[1]) AS flexible, CASE WHEN s IS NULL THEN 0 WHEN s = '1' || n_chars THEN 1 ELSE 0 END::DOUBLE AS score FROM e""",
)
def _(spark, sf):
    n, k = F.col("n_chars").cast("string"), F.col("doc_id") % 3
    t = F.concat("text", F.when(k == 0, F.concat(F.lit(" #### 1,"), n)).when(k == 1, F.concat(F.lit(" is "), n, F.lit("."))).otherwise(""))
    return table(spark, sf, "documents").select(
        "doc_id",
        R.final_number(t).alias("strict"),
        R.final_number(t, "flexible").alias("flexible"),
        R.score_final_number(t, F.concat(F.lit("1"), n)).alias("score"),
    )


@query(
    "tx25_boxed_math_score",
    "SELECT o_orderkey, CASE WHEN o_orderkey % 8 = 7 THEN 0 ELSE 1 END::DOUBLE AS score FROM orders",
)
def _(spark, sf):
    c, k = (F.col("o_custkey") + 1).cast("string"), F.col("o_orderkey") % 8
    w = lambda a, b="": F.concat(F.lit(a), c, F.lit(b))
    cases = [
        (w("so \\boxed{\\dfrac{1}{", "}}."), w("\\frac{1}{", "}")),
        (w("so \\boxed{3/", "}"), w("\\frac{3}{", "}")),
        (w("so \\boxed{x = ", "}"), c),
        (w("is \\boxed ", "$ ok"), c),
        (w("is \\fbox{", "^\\circ}"), c),
        (w("is \\boxed{\\left(", ", .5\\right)}"), w("(", ",0.5)")),
        (w("is \\boxed{\\sqrt3 \\text{ cm and} ", "}"), F.lit("\\sqrt{3}")),
        (w("is \\boxed{\\frac{", "}"), c),
    ]
    text, gold = None, None
    for i, (t, g) in enumerate(cases):
        text = F.when(k == i, t) if text is None else text.when(k == i, t)
        gold = F.when(k == i, g) if gold is None else gold.when(k == i, g)
    return table(spark, sf, "orders").select("o_orderkey", R.score_boxed_math(text, gold).alias("score"))


@query(
    "tx26_uf5_stated_answer_score",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 5 < 4 THEN 1.0 ELSE -1.0 END::DOUBLE AS score, o_orderkey % 5 < 4 AS acc,
        CASE o_orderkey % 5 WHEN 0 THEN '1' || o_custkey WHEN 1 THEN 'frac{1}{' || o_custkey || '}' WHEN 2 THEN CAST(o_custkey AS VARCHAR) WHEN 3 THEN '(' || o_custkey || ',2)' ELSE '[INVALID]' END AS pred FROM orders""",
)
def _(spark, sf):
    c, k = F.col("o_custkey").cast("string"), F.col("o_orderkey") % 5
    w = lambda a, b="": F.concat(F.lit(a), c, F.lit(b))
    said = (
        F.when(k == 0, w("Answer: 0\nanswer : $1,", "$"))
        .when(k == 1, w("Answer: frac{1}{", "}\nbye"))
        .when(k == 2, w("Answer: the x = \\text{", "} dollars"))
        .when(k == 3, w("Answer: \\boxed{(", ", 2)}"))
        .otherwise(w("nothing said ", ""))
    )
    gold = F.when(k == 0, w("1")).when(k == 1, w("frac{1}{", "}")).when(k == 2, c).when(k == 3, w("(", ",2)")).otherwise(c)
    rows = table(spark, sf, "orders").select("o_orderkey", said.alias("t"), gold.alias("g"))
    return R.score_rows(rows, "stated", "t", "g").select("o_orderkey", "score", "acc", "pred")


@query(
    "tx27_strict_box_score",
    RESP
    + """SELECT doc_id, CASE WHEN doc_id % 9 = 1 THEN 1.0 ELSE -1.0 END::DOUBLE AS score,
       CASE doc_id % 9 WHEN 1 THEN CAST(n_chars AS VARCHAR) WHEN 8 THEN '\\frac{' || n_chars || '}{' || (doc_id + 1) || '}' END AS pred FROM responses""",
)
def _(spark, sf):
    s = R.score_strict_box(F.col("response"), F.col("n_chars").cast("string"))
    return responses(spark, sf).select("doc_id", s.alias("s")).select("doc_id", "s.score", "s.pred")


@query(
    "tx28_latex_score",
    "SELECT o_orderkey, CASE o_orderkey % 3 WHEN 2 THEN 0.5 ELSE 1.0 - o_orderkey % 3 END::DOUBLE AS score FROM orders",
)
def _(spark, sf):
    c, k = F.col("o_custkey").cast("string"), F.col("o_orderkey") % 3
    tail = F.when(k == 0, F.concat(F.lit("\\frac{"), c, F.lit("}{4} + 1"))).when(k == 1, F.concat(F.lit("-7 - "), c)).otherwise("x @ y")
    text = F.concat(F.lit("so \\boxed{"), tail, F.lit("}"))
    gold = F.concat(F.lit("1+"), (F.col("o_custkey") / 4).cast("string"))
    rows = table(spark, sf, "orders")
    return rows.select("o_orderkey", LX.score_latex(text, gold, unread=0.5).alias("score"))


@query(
    "tx29_marked_answer_score",
    "SELECT o_orderkey, CASE WHEN o_orderkey % 7 < 5 THEN 1 ELSE 0 END::DOUBLE AS score FROM orders",
)
def _(spark, sf):
    n = F.col("o_custkey") + 11
    c, k = n.cast("string"), F.col("o_orderkey") % 7
    w = lambda a, b="": F.concat(F.lit(a), c, F.lit(b))
    text = (
        F.when(k == 0, w("We add. The ANSWER is x = ", ""))
        .when(k == 1, w("First. Answer: \\boxed{", "}"))
        .when(k == 2, w("so we get ", ".00001"))
        .when(k == 3, w("$1,", " is the answer to it"))
        .when(k == 4, w("The value is ", "\\%"))
        .when(k == 5, w("The answer is no ", "7 really"))
        .otherwise(F.lit("no digits at all"))
    )
    gold = F.when(k == 3, F.concat(F.lit("1"), c)).when(k == 4, (n / 100).cast("string")).otherwise(c)
    return table(spark, sf, "orders").select("o_orderkey", R.score_marked_answer(text, gold).alias("score"))


@query(
    "tx30_qa_match_score",
    """SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 1.0 WHEN 1 THEN 0.25 WHEN 2 THEN 0.0 ELSE 0.0 END::DOUBLE AS exact, CASE doc_id % 4 WHEN 3 THEN 0.0 ELSE 1.0 END::DOUBLE AS contained
       FROM documents""",
)
def _(spark, sf):
    t, k = F.col("text"), F.col("doc_id") % 4
    tag = lambda x: F.concat(F.lit("<answer>"), x, F.lit("</answer>"))
    said = (
        F.when(k == 0, F.concat(F.lit("first <answer>no</answer> "), tag(F.concat(F.lit("The  "), t, F.lit("!")))))
        .when(k == 1, F.concat(F.repeat(F.lit("<answer>x</answer>"), F.lit(11)), tag(t)))
        .when(k == 2, tag(F.concat(t, F.lit(" and more words"))))
        .otherwise(t)
    )
    d = table(spark, sf, "documents")
    golds = F.array(F.lit("zzz"), t)
    return d.select("doc_id", R.score_qa(said, golds).alias("exact"), R.score_qa(said, golds, substring=True).alias("contained"))


@query(
    "tx31_format_weighted_score",
    RESP + "SELECT doc_id, round(CASE WHEN doc_id % 9 = 1 THEN 1.0 WHEN doc_id % 9 = 8 THEN 0.1 ELSE 0 END, 6)::DOUBLE AS score FROM responses",
)
def _(spark, sf):
    ok = R.score_boxed_math(F.col("response"), F.col("n_chars").cast("string")) == 1.0
    return responses(spark, sf).select("doc_id", F.round(R.score_with_format(ok, F.col("response")), 6).alias("score"))


@query(
    "st4_multiset_overlap",
    """WITH d AS (SELECT doc_id, string_split(text, ' ') AS a, string_split(reverse(text), ' ')[3:] AS b FROM (SELECT doc_id, text FROM documents)),
     a AS (SELECT doc_id, w, count(*) AS n FROM (SELECT doc_id, unnest(list_transform(a, lambda x: length(x))) AS w FROM d) GROUP BY ALL),
     b AS (SELECT doc_id, w, count(*) AS n FROM (SELECT doc_id, unnest(list_transform(b, lambda x: length(x))) AS w FROM d) GROUP BY ALL),
     s AS (SELECT a.doc_id, sum(least(a.n, b.n)) AS k FROM a JOIN b USING (doc_id, w) GROUP BY 1)
     SELECT doc_id, round(CASE WHEN list_transform(a, lambda x: length(x)) = list_transform(b, lambda x: length(x)) THEN 1 ELSE coalesce(k, 0) / (len(a) + len(b) - coalesce(k, 0)) END, 6)::DOUBLE AS overlap FROM d LEFT JOIN s USING (doc_id)""",
)
def _(spark, sf):
    # all words of the text against all but two of its reverse
    lens = lambda a: F.transform(a, lambda x: F.length(x))
    words, back = F.split("text", " "), F.split(F.reverse("text"), " ")
    d = table(spark, sf, "documents").select("doc_id", lens(words).alias("a"), lens(F.slice(back, 3, F.greatest(F.size(back), F.lit(1)))).alias("b"))
    return d.select("doc_id", F.round(R.multiset_overlap(F.col("a"), F.col("b")), 6).alias("overlap"))


@query(
    "tx32_tool_call_score",
    """SELECT event_id, CASE event_id % 5 WHEN 0 THEN 4.0 WHEN 1 THEN -3.0 WHEN 2 THEN round(6.0*(1+1)/4.0 - 3.0 + 1.0, 6) WHEN 3 THEN 1.0 ELSE 0.0 END::DOUBLE AS score FROM events""",
)
def _(spark, sf):
    v, k = F.col("user_id").cast("string"), F.col("event_id") % 5
    call = lambda a, b: F.concat(
        F.lit('<tool_call>\n{"name": "f", "parameters": {"a": '), a, F.lit(', "b": '), b, F.lit("}}\n</tool_call>")
    )
    think = F.lit("<think>t</think>\n")
    one, other = F.lit("1"), F.lit("-9")
    gold = F.when(k == 3, "<response>hi</response>").when(k == 4, "nothing to do").otherwise(call(v, one))
    said = (
        F.when(k == 0, F.concat(think, call(v, one)))
        .when(k == 1, F.lit("no call at all"))
        .when(k == 2, F.concat(think, call(other, other)))
        .when(k == 3, F.concat(think, F.lit("<response>hello</response>")))
        .otherwise(F.lit("plain"))
    )
    return table(spark, sf, "events").select(
        "event_id", F.round(R.tool_format(said, gold) + R.tool_correctness(said, gold), 6).alias("score")
    )


@query(
    "tx33_code_pass_ratio",
    RESP
    + """SELECT doc_id, CASE WHEN doc_id % 9 = 7 THEN 'print(' || n_chars || ')' END AS code, round(list_sum(list_transform(range(1, 11), lambda i: (((doc_id + i) % 3 = 0))::INT)) / 10.0, 6)::DOUBLE AS ratio FROM responses""",
)
def _(spark, sf):
    results = F.transform(F.sequence(F.lit(1), F.lit(15)), lambda i: (F.col("doc_id") + i) % 3 == 0)
    return responses(spark, sf).select(
        "doc_id", R.code_solution(F.col("response")).alias("code"), F.round(R.pass_ratio(results), 6).alias("ratio")
    )


@query(
    "tx34_score_by_source",
    """SELECT o_orderkey, CASE o_orderkey % 7 WHEN 0 THEN 1 WHEN 1 THEN 1 WHEN 2 THEN 1 WHEN 3 THEN -1 WHEN 4 THEN 1 WHEN 5 THEN NULL ELSE 0.9 END::DOUBLE AS score,
      CASE o_orderkey % 7 WHEN 0 THEN 'number' WHEN 1 THEN 'boxed' WHEN 2 THEN 'stated' WHEN 3 THEN 'stated' WHEN 4 THEN 'qa' WHEN 5 THEN 'code' ELSE 'geometry' END AS scorer FROM orders""",
)
def _(spark, sf):
    c, k = F.col("o_custkey").cast("string"), F.col("o_orderkey") % 7
    names = ["openai/gsm8k", "lighteval/MATH", "aime2024", "math_dapo", "searchR1_nq", "taco", "hiyouga/geometry3k"]
    src = F.element_at(F.array(*[F.lit(n) for n in names]), (k + 1).cast("int"))
    w = lambda a, b="": F.concat(F.lit(a), c, F.lit(b))
    text = (
        F.when(k == 0, w("ok #### "))
        .when(k.isin(1, 6), w("so \\boxed{", "}"))
        .when(k == 2, w("Answer: "))
        .when(k == 3, w("Answer: not "))
        .otherwise(w("<answer>", "</answer>"))
    )
    return table(spark, sf, "orders").select("o_orderkey", R.score_by_source(src, text, c).alias("score"), R.scorer_of(src).alias("scorer"))


@query(
    "tx36_tool_call_parsers",
    """SELECT event_id, 1::BIGINT AS n_calls, CASE event_id % 3 WHEN 2 THEN '{"a": ' || user_id || ', "b": "x"}' ELSE '{"a":' || user_id || '}' END AS arguments FROM events""",
)
def _(spark, sf):
    v, k = F.col("user_id").cast("string"), F.col("event_id") % 3
    text = (
        F.when(k == 0, F.concat(F.lit('hi <tool_call>{"name": "f", "arguments": {"a":'), v, F.lit("}}</tool_call><tool_call>bad</tool_call>")))
        .when(
            k == 1,
            F.concat(
                F.lit("<|channel|>analysis<|message|>thinking<|end|><|start|>assistant<|channel|>commentary to=functions.f <|constrain|>json<|message|>{\"a\":"),
                v,
                F.lit("}<|call|>"),
            ),
        )
        .otherwise(F.concat(F.lit("<tool_call><function=f><parameter=a>\n"), v, F.lit("\n</parameter><parameter=b>x</parameter></function></tool_call>")))
    )
    xml = TC.xml_calls(F.when(k == 2, text), {"f": {"a": "integer"}})
    calls = F.when(k == 0, TC.json_calls(text)).when(k == 1, TC.channel_calls(text)).otherwise(xml)
    d = table(spark, sf, "events").select("event_id", calls.alias("c"))
    return d.select("event_id", F.size("c").cast("long").alias("n_calls"), F.element_at("c", 1)["arguments"].alias("arguments"))


@query(
    "tx37_bare_question",
    r"SELECT doc_id, md5(regexp_replace(text, '^\s+|\s+$', '', 'g')) AS digest FROM documents",
)
def _(spark, sf):
    t = F.concat(F.lit("Solve this. "), F.col("text"), F.lit(" Think hard."))
    return table(spark, sf, "documents").select("doc_id", F.md5(P.bare_question(t, "Solve this. ", " Think hard.")).alias("digest"))


@query(
    "tx38_message_parts",
    """SELECT conv_id, turn, CASE WHEN length(text) > 0 THEN 'image,text,video,text' ELSE 'image,video,text' END AS kinds FROM conversations""",
)
def _(spark, sf):
    content = F.concat(F.lit("<image>"), F.col("text"), F.lit("<video> after"))
    d = table(spark, sf, "conversations").select("conv_id", "turn", P.message_parts(content).alias("p"))
    return d.select("conv_id", "turn", F.array_join("p.type", ",").alias("kinds"))


@query(
    "tx39_token_counts",
    r"SELECT doc_id, len(regexp_extract_all(text, '([\pL\pN\pM_]+|[^\pL\pN\pM_\s])', 1))::BIGINT AS tokens FROM documents",
)
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", TC.count_tokens(F.col("text")).cast("long").alias("tokens"))


def _ranks_file() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.tiktoken"))


@query("tx39_bpe_token_counts")
def _(spark, sf):
    return TK.token_counts(table(spark, sf, "documents"), ["doc_id"], "text", _ranks_file())


@query("pr16_tx39_keep_short_by_tokens")
def _(spark, sf):
    turns = TK.token_counts(table(spark, sf, "conversations"), ["conv_id", "turn"], "text", _ranks_file())
    prompts = turns.groupBy("conv_id").agg(F.sum("tokens").alias("tokens"), F.count_if(F.col("tokens").isNull()).alias("unknown"))
    known = F.when(F.col("unknown") == 0, F.col("tokens"))
    return rows.keep_short(prompts, known, 1024).select("conv_id", "tokens")


@query(
    "sm11_shorten_tool_response",
    """SELECT doc_id, md5(CASE WHEN length(text) <= 200 THEN text WHEN doc_id % 3 = 0 THEN left(text, 200) || '...(truncated)' WHEN doc_id % 3 = 1 THEN '(truncated)...' || right(text, 200)
       ELSE left(text, 100) || '...(truncated)...' || right(text, 100) END) AS digest FROM documents""",
)
def _(spark, sf):
    t, k = F.col("text"), F.col("doc_id") % 3
    out = F.when(k == 0, TC.shorten_tool_response(t, 200, "left")).when(k == 1, TC.shorten_tool_response(t, 200, "right"))
    return table(spark, sf, "documents").select("doc_id", F.md5(out.otherwise(TC.shorten_tool_response(t, 200))).alias("digest"))


@query(
    "up1_regrade",
    RESP + POST_SQL + GRADE_SQL
    + """, o AS (SELECT *, CASE WHEN doc_id % 4 = 0 THEN predicted WHEN doc_id % 4 = 1 THEN '0' END AS oldp, doc_id % 5 < 2 AS oldc, coalesce(CAST(predicted AS HUGEINT) = n_chars, false) AS newc FROM graded)
   SELECT source, count(*) AS n, count(*) FILTER (WHERE oldp IS DISTINCT FROM predicted) AS changed, count(*) FILTER (WHERE oldc <> newc) AS flipped,
     count(*) FILTER (WHERE NOT oldc AND newc) AS new_right, count(*) FILTER (WHERE oldc AND NOT newc) AS new_wrong,
     0::BIGINT AS unread, 0::BIGINT AS methodb_off FROM o GROUP BY source""",
)
def _(spark, sf):
    stored = F.when(F.col("doc_id") % 4 == 0, X.extract_integer(TH.strip_thinking(F.col("response")))).when(F.col("doc_id") % 4 == 1, "0")
    rows = responses(spark, sf).select(
        "source", "response", stored.alias("predicted_answer"), (F.col("doc_id") % 5 < 2).alias("correct"), F.col("n_chars").cast("string").alias("gt_answer"),
        F.when(F.col("doc_id") % 3 > 0, F.col("doc_id") % 5 < 2).alias("methodb_correct"),
    )
    return ev.regrade_counters(ev.regrade(rows, F.lit("integer"), LX.grade_any), ["source"])
