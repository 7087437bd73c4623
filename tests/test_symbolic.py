import random
from fractions import Fraction

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gradelake.functions import latex as LX
from gradelake.functions import rewards as R
from gradelake.functions import symbolic as S


def polynomial(draw, depth=3):
    """A text and its coefficients by powers of u and v, worked out by hand."""
    pick = draw.randint(0, 5) if depth else draw.randint(0, 2)
    if pick == 0:
        k = draw.randint(0, 9)
        return str(k), {(0, 0): k} if k else {}
    if pick in (1, 2):
        return ("u", {(1, 0): 1}) if pick == 1 else ("v", {(0, 1): 1})
    a, x = polynomial(draw, depth - 1)
    if pick == 3:
        n = draw.randint(0, 3)
        out = {(0, 0): 1}
        for _ in range(n):
            out = times(out, x)
        return draw.choice([f"({a})^{n}", f"\\left({a}\\right)^{{{n}}}"]), out
    b, y = polynomial(draw, depth - 1)
    if pick == 4:
        sign = draw.choice([1, -1])
        out = {k: x.get(k, 0) + sign * y.get(k, 0) for k in {*x, *y}}
        return f"{a} {'+' if sign > 0 else '-'} ({b})", {k: c for k, c in out.items() if c}
    return draw.choice([f"({a})({b})", f"({a}) \\cdot ({b})", f"({a})\\times({b})"]), times(x, y)


def times(x, y):
    out = {}
    for (a, b), c in x.items():
        for (d, e), f in y.items():
            out[a + d, b + e] = out.get((a + d, b + e), 0) + c * f
    return {k: c for k, c in out.items() if c}


def spelled(coefficients):
    return " + ".join(f"({c})u^{{{a}}} v^{b}" for (a, b), c in coefficients.items()) or "0"


@pytest.mark.parametrize("seed", range(60))
def test_polynomials_meet_their_expansion(seed):
    draw = random.Random(seed)
    text, coefficients = polynomial(draw)
    assert S.equal(text, spelled(coefficients)) is True
    if set(coefficients) - {(0, 0)}:
        assert S.answer_key(text) == S.answer_key(spelled(coefficients))
    other = dict(coefficients)
    at = draw.choice([(0, 0), (1, 0), (1, 1), (2, 1)])
    other[at] = other.get(at, 0) + draw.choice([1, -1, 2]) * 7
    assert S.equal(text, spelled({k: c for k, c in other.items() if c})) is False


@settings(max_examples=200, deadline=None)
@given(st.fractions(max_denominator=40), st.fractions(max_denominator=40))
def test_fractions(a, b):
    def write(x, style):
        return [f"\\frac{{{x.numerator}}}{{{x.denominator}}}", f"{x.numerator}/{x.denominator}", f"{3 * x.numerator} / (3 \\cdot {x.denominator})"][style]

    assert S.equal(write(a, 0), write(a, 2)) is True and S.answer_key(write(a, 1)) == S.answer_key(write(a, 2))
    assert (S.answer_key(write(a, 0)) == S.answer_key(write(b, 1))) == (a == b)
    x, y = Fraction(a), Fraction(b)
    assert S.equal(f"({write(x, 0)}, {write(y, 1)})", f"({write(x, 2)},{write(y, 0)})") is True
    assert (S.equal(f"({write(x, 0)}, {write(y, 0)})", f"({write(y, 0)}, {write(x, 0)})") is True) == (x == y or round(float(x), 3) == round(float(y), 3) or abs(x - y) < max(abs(x), abs(y)) / 1000)


SAME = [
    ("k^2+1", "k^{2}+1"), ("(1, 2.0)", "(1,2)"), ("2\\pi", "6.28"), ("\\sqrt{k^2+1}", "\\sqrt{1+k \\cdot k}"), ("5^{m+2}", "25 \\cdot 5^m"), ("[0, \\frac{2}{2})", "[0,1)"),
    ("(-\\infty,4)\\cup(6,\\infty)", "(6,\\infty) \\cup (-\\infty,4)"), ("\\begin{pmatrix}4&2\\\\ 3&k\\end{pmatrix}", "\\begin{bmatrix}4&2\\\\3&k\\end{bmatrix}"),
    ("\\{3,8\\}", "8, 3"), ("3 5/8", "3\\frac{5}{8}"), ("w = 12", "12"), ("b_1 - b_{2}", "-b_2+b_1"), ("9\\text{ kg}", "9"), ("12,345", "12345"), ("\\sin^2 k+\\cos^2 k", "1"),
    ("\\ln(k^3)\\cdot 0 + k", "k"), ("\\frac{k}{k}", "1"), ("|-4|", "4"), ("6!", "720"), ("\\binom{7}{2}", "21"), ("\\sqrt[3]{-27}", "-3"), ("\\cos 2k", "2\\cos^2 k - 1"), ("40\\%", "\\frac{2}{5}"),
]
OTHER = [
    ("k^2+1", "k^2-1"), ("(4,2)", "(2,4)"), ("[4,7)", "(4,7)"), ("\\{3,8\\}", "\\{3,8,9\\}"), ("k", "m"), ("|k|", "k"), ("\\sqrt{k^2}", "k"), ("6^m", "m^6"), ("(-\\infty,4)", "(\\infty,4)"),
    ("\\text{odd}", "\\text{even}"), ("\\begin{pmatrix}4&2\\end{pmatrix}", "\\begin{pmatrix}2&4\\end{pmatrix}"), ("4, 4, 5", "4, 5, 5, 5"), ("3", "(3,3)"),
]
UNREAD = [("4", "4@4"), ("\\foo{3}", "3"), ("4", "(4"), ("\\frac{3}", "3"), ("8", "8 <")]


@pytest.mark.parametrize("pair, want", [*((p, True) for p in SAME), *((p, False) for p in OTHER), *((p, None) for p in UNREAD)])
def test_pairs(pair, want):
    assert S.equal(*pair) is want
    if want is not None:
        assert S.equal(pair[1], pair[0]) is want


@pytest.mark.parametrize("gold, found, want", [("7", "7", True), ("7", "7.0", True), ("7", "14/2", False), ("7/2", "3.5", True), ("7/2", "14/4", False), ("7/2", "\\frac{7}{2}", True), ("(7, k)", "(14/2, k)", False)])
def test_strict_rules(gold, found, want):
    assert S.equal(gold, found, True) is want
    assert S.equal(gold, found) is True


def test_signs_for_both():
    for n in range(2, 9):
        assert S.equal(f"\\frac{{{n}+\\sqrt{{{n}}}}}{{3}}, \\frac{{{n}-\\sqrt{{{n}}}}}{{3}}", f"\\frac{{{n}\\pm\\sqrt{{{n}}}}}{{3}}") is True


def test_deep_and_large_texts_are_answered():
    assert S.equal("(" * 30_000 + "1" + ")" * 30_000, "1") is None
    assert S.equal("9^{9^{9^9}}", "1") in (None, False)
    assert S.equal("1000!", "1") in (None, False)
    assert S.equal("+".join(["k"] * 300), "300k") is True


def test_rows_keep_their_number_and_unread_ones_are_counted(spark):
    df = spark.createDataFrame([(i, "(k+1)^2", ["k^2+2k+1", "1+k(k+2)", "k^2", "k@", None][i % 5]) for i in range(100)], "id int, g string, p string")
    graded = LX.grade_latex(df, "p", "g", hot_rows=7)
    assert [tuple(r) for r in LX.unread_pairs(graded, ["g"]).collect()] == [("(k+1)^2", 100, 40, 20)]
    keyed = LX.with_answer_key(df, "p", hot_rows=7)
    assert {r["answer_key"] is None for r in keyed.where("p IS NULL").collect()} == {True}
    assert sorted(r["count"] for r in keyed.where("p IS NOT NULL").groupBy("answer_key").count().collect()) == [20, 20, 40]


def test_marked_answers_get_the_symbolic_tier(spark):
    said = ["so the answer is 2(k+1)", "so the answer is 2k+3", "The answer is 14/2", "no digits", None]
    df = spark.createDataFrame([(i, t, "7" if i == 2 else "2k+2") for i, t in enumerate(said)], "id int, t string, g string")
    rows = R.grade_marked_answer(df, "t", "g").orderBy("id").collect()
    assert [r["score"] for r in rows] == [1.0, 0.0, 0.0, 0.0, 0.0]
    assert df.select(F.count("*")).first()[0] == len(rows)
