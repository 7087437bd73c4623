import random
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from gradelake.functions import extract as X
from gradelake.functions import findings as FD
from gradelake.functions import latex as LX
from gradelake.functions import prompts as P
from gradelake.functions import rewards as R
from gradelake.functions import think as TH
from gradelake.functions import toolcalls as TC


def one(spark, col, *values, ddl="s string"):
    return spark.createDataFrame([values], ddl).select(col).first()[0]


# --- answers in every style, generated with the value that has to come out ---------------------

BLANKS = ["", " ", "  ", "\n", "\t "]
BEFORE_IT = ["", "We multiply, then add. ", "Case 2 fails.\n\n"]
AFTER_IT = ["", " as claimed", "\nDone."]
INTEGER_STYLES = ["<answer>{b}{v}{b}</answer>", "<Answer>{b}{v}{b}</Answer>", "\\boxed{{{b}{v}{b}}}", "\\answer{{{v}}}", "Answer:{b}{v}", "**Final answer**:{b}`{v}`", "final answer： ({v})"]
LETTER_STYLES = ["<answer>{b}{v}{b}</answer>", "\\boxed{{{b}{v}{b}}}", "\\answer{{{v}}}", "answer: {v}", "answer {v}", "*Final Answer*: \"{v}\""]


def styled(draw, styles, value):
    text = draw.choice(styles).format(b=draw.choice(BLANKS), v=value)
    return draw.choice(BEFORE_IT) + text + draw.choice(AFTER_IT)


def nested(draw, depth):
    """Braces in braces, as in a formula."""
    if not depth:
        return str(draw.randint(2, 99))
    name = draw.choice(["\\sqrt", "\\frac{7}", "r^", "s_"])
    return f"{name}{{{nested(draw, depth - 1)}}}" + draw.choice(["", f"+{draw.randint(2, 9)}"])


def extracted(spark, cases):
    """Answers of (kind, text) cases, in one pass."""
    table = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, kind string, s string")
    rows = table.select("i", "kind", "s", *[X.extract_answer(F.lit(k), F.col("s")).alias(k) for k in ("integer", "letter", "code", "latex")]).collect()
    return [r[r["kind"]] for r in sorted(rows, key=lambda r: r["i"])]


def test_integers_and_letters_in_every_style(spark):
    draw = random.Random(11)
    cases, want = [], []
    for _ in range(150):
        n = draw.randint(-500, 10**6)
        cases.append(("integer", styled(draw, INTEGER_STYLES, n)))
        want.append(str(n))
        letter = draw.choice("ABCD")
        cases.append(("letter", styled(draw, LETTER_STYLES, letter)))
        want.append(letter)
    assert extracted(spark, cases) == want


def test_earlier_styles_go_before_later_ones_and_the_last_of_a_style_counts(spark):
    cases, want = [], []
    for k in range(0, 40, 4):
        tagged, boxed, said = f"<answer>{k}</answer>", f"\\boxed{{{k + 1}}}", f"Answer: {k + 2}"
        for order in permutations([tagged, boxed, said]):
            cases.append(("integer", " and ".join(order)))
            want.append(str(k))
        cases += [("integer", f"{said} but {boxed}"), ("integer", f"{tagged} then <answer>{k + 3}</answer>"), ("integer", f"only {k} is written"), ("letter", f"answer {chr(69 + k % 20)}")]
        want += [str(k + 1), str(k + 3), None, None]
    assert extracted(spark, cases) == want


def test_code_blocks(spark):
    cases, want = [], []
    for k in range(20):
        body = "\n".join(f"v{i} = {i * k}" for i in range(k % 4 + 1))
        for fence in ("python", "py", ""):
            cases += [("code", f"see\n```{fence}\n{body}\n```\nend"), ("code", f"```{fence}\nold = 1\n```\nbetter:\n```{fence}\n{body}\n```")]
            want += [body, body]
    assert extracted(spark, cases) == want


def test_boxes_of_any_depth_and_the_unboxed_forms(spark):
    draw = random.Random(12)
    cases, want = [], []
    for k in range(120):
        inner = nested(draw, k % 5)
        cases += [
            ("latex", f"{draw.choice(BEFORE_IT)}\\boxed{{{inner}}}{draw.choice(AFTER_IT)}"),
            ("latex", f"first \\boxed{{{k}}}, at last \\boxed{{{inner}}} ."),
            ("latex", f"so we are left with\n\n$${inner}$$"),
            ("latex", f"so we are left with \\[ {inner} \\]"),
            ("latex", f"and $\\kappa_{k % 7} = {inner}$."),
            ("latex", f"Nothing else remains.\n\n{k}"),
            ("latex", f"while $\\kappa$ has {k} more words behind it here."),
        ]
        want += [inner, inner, inner, inner, inner, str(k), None]
    assert extracted(spark, cases) == want


def test_latex_values(spark):
    draw = random.Random(13)
    pairs = []
    for _ in range(60):
        n, d, r = draw.randint(2, 40), draw.randint(2, 9), draw.choice([2, 3, 5, 11])
        pairs += [
            (f"\\frac{{{n}}}{{{d}}}", f"{n / d:.7f}", True), (f"\\frac{{{n}}}{{{d}}}", f"{n / d + 0.05 * n:.5f}", False), (f"{n}\\sqrt{{{r}}}", f"\\sqrt{{{n * n * r}}}", True),
            (f"{n}/{d}", f"\\dfrac{{{2 * n}}}{{{2 * d}}}", True), (f"{n}, {n + d}, 1", f"1, {n}, {n + d}", True), (f"{n}, {n + d}", f"{n}", False), (f"\\sqrt[3]{{{n**3}}}", f"{n}", True),
            (f"{d}! \\cdot {n}^{{2}}", f"{n}^2 \\times {d}!", True), (f"\\text{{case {n}}}", f"{n}@", None),
        ]
    table = spark.createDataFrame(pairs, "g string, p string, want boolean")
    rows = LX.grade_latex(table, "p", "g").collect()
    assert len(rows) == len(pairs)
    assert all((None if r["correct_unread"] else r["correct"]) is r["want"] for r in rows)


def test_grade_latex_grades_pairs_once_and_keeps_rows(spark):
    df = spark.createDataFrame([(i, "\\frac{1}{2}", "0.5" if i % 2 else "x@y") for i in range(100)], "id int, g string, p string")
    rows = LX.grade_latex(df, "p", "g", hot_rows=7).collect()
    assert len(rows) == 100
    assert all(r.correct == bool(r.id % 2) and r.correct_unread == (not r.id % 2) for r in rows)


def test_integers_of_any_size(spark):
    assert one(spark, X.canonical_int(F.col("s")), " +00_42 ") == "42"
    assert one(spark, X.canonical_int(F.col("s")), " +004_2 ") == "42"
    assert one(spark, X.canonical_int(F.col("s")), "-0") == "0"
    assert one(spark, X.canonical_int(F.col("s")), "99999999999999999999999999999999999999999999") == "9" * 44
    assert one(spark, X.canonical_int(F.col("s")), "1e3") is None


def test_thinking(spark):
    t = "<think>a</think>b<think>c</think> d </think> e "
    assert one(spark, TH.strip_thinking(F.col("s")), t) == "e"
    g = TH.CHANNEL_MARKERS
    assert one(spark, TH.strip_thinking(F.col("s"), g), f"{g[0]}step{g[1]}Final answer: X") == "Final answer: X"
    assert one(spark, TH.before_close(F.col("s")), "abc") is None
    assert one(spark, TH.thinking_body(TH.before_close(F.col("s"))), "x<think>body</think>y") == "body"


def test_findings(spark):
    raw = "\n".join(
        ["intro", "- x = 4 because of A", "* **Review the Problem:**", "2) \"y is even\"", "- Goal: find x", "- Constraints:", "- FINDING 1: no", "• " + "z" * 600]
    )
    got = one(spark, FD.parse_findings(F.col("s"), F.lit(9)), raw)
    assert got[:2] == ["x = 4 because of A", "y is even"] and got[2] == "z" * 500 + "..." and len(got) == 3
    assert len(one(spark, FD.parse_findings(F.col("s"), F.lit(1)), raw)) == 1
    assert one(spark, FD.parse_findings(F.col("s"), F.lit(3)), "") == []


def test_sentence_trim_and_anchor(spark):
    assert one(spark, FD.trim_to_last_sentence(F.col("s")), "One. Two! thr") == "One. Two!"
    assert one(spark, FD.trim_to_last_sentence(F.col("s")), "line\nrest") == "line"
    text = "We know that alpha equals beta here. Then more."
    end = one(spark, FD.last_anchor_end(F.col("s"), F.array(F.lit("alpha equals beta"))), text)
    assert text[:end].endswith("alpha equals beta")
    assert one(spark, FD.last_anchor_end(F.col("s"), F.array(F.lit("short"))), text) == -1


def test_injection_variants_differ_and_are_empty_without_findings(spark):
    f = lambda v, arr: P.check_injection(F.lit("aime"), F.col("s"), arr, F.lit("7"), v)
    some = F.array(F.lit("a"))
    texts = {one(spark, f(v, some), "q?") for v in ("default", "again", "final")}
    assert len(texts) == 3 and all("1. a" in t and "answer is 7." in t for t in texts)
    assert one(spark, f("default", F.array().cast("array<string>")), "q?") == ""


def test_stepwise_header(spark):
    assert one(spark, P.stepwise_prompt(F.lit("aime"), F.col("s")), "Q").startswith("Solve the math problem by reasoning step by step. Final answer must")


def test_scorers(spark):
    assert one(spark, R.final_number(F.col("s")), "so #### 1,234 then #### 56,7") == "567"
    assert one(spark, R.final_number(F.col("s"), "flexible"), "costs 12 or 13 .") == "13"
    assert one(spark, R.normalize_final_answer(F.col("s")), "x = 1,000 dollars") == "1000"
    assert one(spark, R.normalize_math(F.col("s")), "k = \\dfrac12") == "\\frac{1}{2}"
    assert one(spark, R.score_qa(F.col("s"), F.array(F.lit("Paris"))), "<answer>the paris!</answer>") == 1.0
    with pytest.raises(Exception, match="no reward function"):
        one(spark, R.score_by_source(F.lit("unknown"), F.col("s"), F.lit("1")), "x")


def test_user_scorer_failures_become_zero(spark):
    R.register_reward("ratio_test", R.guarded(lambda t, g: int(t) / int(g)))
    df = spark.createDataFrame([("4", "2"), ("4", "0"), ("x", "1")], "t string, g string")
    assert [r.score for r in R.score_rows(df, "ratio_test", "t", "g").collect()] == [2.0, 0.0, 0.0]
    with pytest.raises(ValueError):
        R.register_reward("ratio_test", None)


def test_tool_values_are_typed_without_evaluation():
    assert TC._typed("null", "integer") is None
    assert TC._typed("7", "integer") == 7 and TC._typed("7.0", "number") == 7 and TC._typed("TRUE", "bool") is True
    assert TC._typed("__import__('os').getcwd()", "array") == "__import__('os').getcwd()"


def _tool_text(*calls):
    return "<think>x</think>\n<tool_call>\n" + "\n".join(calls) + "\n</tool_call>"


@pytest.mark.parametrize(
    "got, want, points, best",
    [
        (['{"name": "move", "parameters": {"x": 4, "y": [1, 2]}}'], ['{"name": "move", "parameters": {"x": 4, "y": [1, 2]}}'], 4, 4),
        (['{"name": "move", "parameters": {"x": 5}}'], ['{"name": "move", "parameters": {"x": 4, "y": 1}}'], 1.5, 4),
        (['{"name": "stop", "parameters": {}}'], ['{"name": "move", "parameters": {"x": 4}}'], 0, 3),
        (['{"name": "a", "parameters": {"k": 1}}', '{"name": "a", "parameters": {"k": 2}}'], ['{"name": "a", "parameters": {"k": 2}}', '{"name": "a", "parameters": {"k": 1}}'], 5, 5),
        (['{"name": "a", "parameters": {}}', '{"name": "b", "parameters": {}}'], ['{"name": "a", "parameters": {}}'], 1.5, 2),
    ],
)
def test_tool_calls_are_matched_by_name_and_arguments(spark, got, want, points, best):
    score = one(spark, R.tool_correctness(F.col("s"), F.col("g")), _tool_text(*got), _tool_text(*want), ddl="s string, g string")
    assert score == pytest.approx(6 * points / best - 3)


def test_tool_calls_that_cannot_be_read(spark):
    good = _tool_text('{"name": "a", "parameters": {}}')
    score = lambda s, g: one(spark, R.tool_correctness(F.col("s"), F.col("g")), s, g, ddl="s string, g string")
    assert score("no call", good) == score(_tool_text("not json"), good) == score(_tool_text('{"name": "a"}'), good) == -3
    assert score(good, "nothing asked") == 0


def test_anchor_pairs_search_the_text_once_per_pattern(spark):
    texts = ['ANCHOR 1: " a"\nFINDING 1:  b\nc"', 'anchor 2 :“x y”\nFINDING 2:\n\nFINDING 3: z\nANCHOR 3:"q"', 'ANCHOR 4: ""x"\nFINDING 4: \n', None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    out = df.select("i", FD.anchor_pairs(F.col("t")).alias("p"))
    assert [[tuple(x) for x in r.p] for r in out.orderBy("i").collect()] == [[("a", "b\nc")], [("x y", 'FINDING 3: z')], [], []]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all(") == 2


def test_equal_responses_are_searched_once(spark):
    rows = [("The answer is 4", "4")] * 3 + [("so the answer is 5", "4"), (None, "4"), ("the answer is 7", None)]
    df = spark.createDataFrame(rows, "t string, g string")
    out = R.grade_marked_answer(df, "t", "g")
    assert sorted((str(r.t), str(r.g), r.score, r.score_unread) for r in out.collect()) == sorted(
        [("The answer is 4", "4", 1.0, False)] * 3 + [("so the answer is 5", "4", 0.0, False), ("None", "4", 0.0, False), ("the answer is 7", "None", 0.0, False)]
    )
    # the marker words are looked for in what the grouping by text gives, not beside the rows
    lines = out._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert any("Aggregate [t#" in line for line in lines)
    assert not any("Project [" in line and "transform(array(" in line for line in lines)
