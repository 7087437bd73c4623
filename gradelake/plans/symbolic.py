"""Symbolic answers: expressions whose coefficients and shape come from the line items."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gradelake.functions import latex as LX
from gradelake.functions import rewards as R
from gradelake.plans.registry import query, table

# a and b are the roots; c and d what is claimed of their sum and product
NUMBERS_SQL = """WITH n AS (SELECT *, l_linenumber AS a, l_suppkey % 4 + 1 AS b, l_linenumber + l_suppkey % 4 + 1 + CASE WHEN l_partkey % 5 = 0 THEN 1 ELSE 0 END AS c,
  l_linenumber * (l_suppkey % 4 + 1) + CASE WHEN l_quantity > 40 THEN 1 ELSE 0 END AS d, l_partkey % 7 % 5 AS shape FROM lineitem)
"""


def _text(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _numbers(spark, sf):
    a, b = F.col("l_linenumber"), F.col("l_suppkey") % 4 + 1
    more = lambda test: F.when(test, 1).otherwise(0)
    return table(spark, sf, "lineitem").select(
        "*", (F.col("l_partkey") % 7 % 5).alias("shape"), a.alias("a"), b.alias("b"), (a + b + more(F.col("l_partkey") % 5 == 0)).alias("c"), (a * b + more(F.col("l_quantity") > 40)).alias("d")
    )


@query(
    "tx29_symbolic_polynomials",
    NUMBERS_SQL
    + """SELECT l_returnflag, shape, count(*) AS n, count(*) FILTER (WHERE c = a + b AND d = a * b) AS n_correct, 0::BIGINT AS n_unread FROM n GROUP BY ALL""",
)
def _(spark, sf):
    rows = _numbers(spark, sf)
    a, b, c, d = (F.col(x) for x in "abcd")
    gold = _text("x^2 + ", c, "x+", d)
    flag, mode = F.col("l_returnflag"), F.col("shape")
    pred = (
        F.when(flag == "R", _text("(x+", a, ")(x + ", b, ")"))
        .when(flag == "A", _text("x(x+", b, ") + ", a, " \\cdot \\left(x+", b, "\\right)"))
        .when(mode == 3, _text("\\frac{(x+", a, ")(x^{2}-", b * b, ")}{x-", b, "}"))
        .when(mode == 1, _text("\\left(x+\\frac{", a + b, "}{2}\\right)^2 - \\dfrac{", (a - b) * (a - b), "}{4}"))
        .otherwise(_text(a * b, "-x(-x-", a + b, ")"))
    )
    rows = rows.select("l_returnflag", "shape", gold.alias("gold"), pred.alias("pred"))
    return LX.unread_pairs(LX.grade_latex(rows, "pred", "gold"), ["l_returnflag", "shape"])


@query(
    "tx29_symbolic_structures",
    NUMBERS_SQL
    + """SELECT l_orderkey, l_linenumber, CASE shape WHEN 0 THEN l_tax <= 0.04 OR a = b WHEN 1 THEN (l_tax <= 0.04 OR a = b) AND l_discount <= 0.05
      WHEN 2 THEN true WHEN 3 THEN l_tax <= 0.04 OR a = b ELSE l_discount <= 0.05 OR c = b END AS correct FROM n""",
)
def _(spark, sf):
    rows = _numbers(spark, sf)
    a, b, c = (F.col(x) for x in "abc")
    swap, open_ = F.col("l_tax") > 0.04, F.col("l_discount") > 0.05
    first, second = F.when(swap, b).otherwise(a), F.when(swap, a).otherwise(b)
    mode = F.col("shape")
    gold = (
        F.when(mode == 0, _text("(", a, ", ", b, ".0)"))
        .when(mode == 1, _text("\\left[", a, ",", b, "\\right)"))
        .when(mode == 2, _text("\\{", a, ",", b, "\\}"))
        .when(mode == 3, _text("\\begin{pmatrix}", a, " & x\\\\ ", b, " & 0\\end{pmatrix}"))
        .otherwise(_text("(-\\infty, ", a, ") \\cup [", b, ",\\infty)"))
    )
    half = lambda x: _text("\\frac{", 2 * x, "}{2}")
    pred = (
        F.when(mode == 0, _text("(", half(first), ",", second, ")"))
        .when(mode == 1, F.concat(F.when(open_, "(").otherwise("["), half(first), F.lit(", "), second.cast("string"), F.lit(")")))
        .when(mode == 2, _text(half(first), ", ", second))
        .when(mode == 3, _text("\\begin{bmatrix}", half(first), "&x\\\\", second, "&x-x\\end{bmatrix}"))
        .otherwise(_text("[", F.when(open_, c).otherwise(b), ", \\infty) \\cup (-\\infty,", half(a), ")"))
    )
    rows = rows.select("l_orderkey", "l_linenumber", gold.alias("gold"), pred.alias("pred"))
    return LX.grade_latex(rows, "pred", "gold").select("l_orderkey", "l_linenumber", "correct")


@query(
    "tx29_symbolic_marked_answers",
    NUMBERS_SQL
    + """SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'R' THEN a = b AND l_tax <= 0.04 WHEN l_returnflag = 'A' THEN c = a + b ELSE c = a + b AND l_tax <= 0.04 END AS correct,
      l_returnflag = 'N' AND l_tax > 0.06 AS unread FROM n""",
)
def _(spark, sf):
    """An integer needs an integer and a quotient the like quotient; a root only the same value."""
    rows = _numbers(spark, sf)
    a, b, c = (F.col(x) for x in "abc")
    large = F.col("l_tax") > 0.04
    flag = F.col("l_returnflag")
    gold = F.when(flag == "R", _text("\\frac{", a, "}{17}")).when(flag == "A", _text(c, "\\sqrt{3}")).otherwise(_text(c))
    said = (
        F.when(flag == "R", _text("\\frac{", F.when(large, 2 * b).otherwise(b), "}{", F.when(large, 34).otherwise(17), "}"))
        .when(flag == "A", _text("\\sqrt{", (a + b) * (a + b) * 3, "}"))
        .when(F.col("l_tax") > 0.06, _text("[[", a + b, "/"))
        .otherwise(F.when(large, _text("\\frac{", 2 * (a + b), "}{2}")).otherwise(_text(a + b)))
    )
    text = F.concat(F.lit("Adding the parts, the answer is "), said)
    rows = rows.select("l_orderkey", "l_linenumber", text.alias("said"), gold.alias("gold"))
    graded = R.grade_marked_answer(rows, "said", "gold")
    return graded.select("l_orderkey", "l_linenumber", (F.col("score") == 1).alias("correct"), F.col("score_unread").alias("unread"))


@query(
    "tx10_answer_classes",
    """WITH n AS (SELECT l_linestatus, l_linenumber * (l_suppkey % 3 + 1) AS top, l_suppkey % 3 + 1 AS k, CAST(l_quantity AS BIGINT) AS below FROM lineitem),
       s AS (SELECT l_linestatus, top // gcd(top, below * k) || '/' || (below * k) // gcd(top, below * k) AS value, count(*) AS n FROM n GROUP BY ALL)
       SELECT l_linestatus, count(*) AS classes, max(n) AS largest, sum(n)::BIGINT AS answers FROM s GROUP BY l_linestatus""",
)
def _(spark, sf):
    """Votes over unlike spellings of one value: quotients, products and sums with a variable that cancels."""
    k, a, q = F.col("l_suppkey") % 3 + 1, F.col("l_linenumber"), F.col("l_quantity").cast("bigint")
    text = (
        F.when(k == 1, _text("\\frac{", a, "}{", q, "}"))
        .when(k == 2, _text(2 * a, " / (2 \\cdot ", q, ")"))
        .otherwise(_text("\\dfrac{", 3 * a, "+y}{", 3 * q, "} - \\frac{y}{", 3 * q, "}"))
    )
    rows = LX.with_answer_key(table(spark, sf, "lineitem").select("l_linestatus", text.alias("answer")), "answer")
    classes = rows.groupBy("l_linestatus", "answer_key").agg(F.count(F.lit(1)).alias("n"))
    return classes.groupBy("l_linestatus").agg(F.count(F.lit(1)).alias("classes"), F.max("n").alias("largest"), F.sum("n").alias("answers"))
