"""Answer extraction and scalar grading as native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gradelake.functions.text import after_last, last_match, rstrip, strip

# Answer styles in priority order. (?U) and (?d) give the Unicode classes and the
# newline-only dot that the styles are written for.
INTEGER_STYLES = [
    r"(?Ud)<[aA]nswer>\s*(-?\d+)\s*</[aA]nswer>",
    r"(?Ud)\\boxed\{\s*(-?\d+)\s*\}",
    r"(?Ud)\\[aA]nswer\s*\{?\s*(-?\d+)",
    r"(?Udi)[*_`]*\s*(?:final\s+)?answer\s*[*_`]*\s*[:：]\s*[*_`\"'(<]*\s*(-?\d+)",
    r"(?Ud)<[aA]nswer>\s*(-?\d+)\b",
]
LETTER_STYLES = [
    r"(?Ud)<[aA]nswer>\s*([A-D])\s*</[aA]nswer>",
    r"(?Ud)\\boxed\{\s*([A-D])\s*\}",
    r"(?Ud)\\[aA]nswer\s*\{?\s*([A-D])\b",
    r"(?Udi)[*_`]*\s*(?:final\s+)?answer\s*[*_`]*\s*[:：]?\s*[*_`\"'(<]*\s*([A-D])\b",
    r"(?Ud)<[aA]nswer>\s*([A-D])\b",
]
CODE_FENCE = r"(?Us)```(?:python|py)?\s*\n(.*?)```"
ANSWER_KINDS = {"aime": "integer", "gpqa": "letter", "livecodebench": "code", "hmmt": "latex"}


def extract_integer(text: Column) -> Column:
    """First style that matches wins; its last match is the answer."""
    return F.coalesce(*[last_match(text, p) for p in INTEGER_STYLES])


def extract_letter(text: Column) -> Column:
    return F.upper(F.coalesce(*[last_match(text, p) for p in LETTER_STYLES]))


def extract_code(text: Column) -> Column:
    return strip(last_match(text, CODE_FENCE))


def balanced_prefix(tail: Column) -> Column:
    """Text up to the brace that closes the group ``tail`` starts inside; NULL if it never closes."""
    pieces = F.split(tail, r"\}")
    closed = F.slice(pieces, 1, F.greatest(F.size(pieces) - 1, F.lit(0)))
    start = F.struct(F.lit(1).alias("depth"), F.lit(0).alias("seen"), F.lit(0).alias("hit"))

    def step(acc, piece):
        depth = acc["depth"] + F.length(piece) - F.length(F.replace(piece, F.lit("{"), F.lit(""))) - 1
        seen = acc["seen"] + 1
        return F.when(acc["hit"] > 0, acc).otherwise(
            F.struct(
                depth.alias("depth"), seen.alias("seen"), F.when(depth == 0, seen).otherwise(F.lit(0)).alias("hit")
            )
        )

    hit = F.aggregate(closed, start, step)["hit"]
    return F.when(hit > 0, F.array_join(F.slice(pieces, 1, F.greatest(hit, F.lit(1))), "}"))


def last_boxed(text: Column) -> Column:
    needle = "\\boxed{"
    return F.when(F.contains(text, F.lit(needle)), balanced_prefix(after_last(text, needle)))


def _closing_block(text: Column, opened: str, closed: str, max_trailing: int = 50) -> Column:
    """Content of the delimiter pair that ends the text, apart from closing punctuation."""
    body = F.regexp_replace(text, r"(?U)[\s.,;:!?]+\z", "")
    inner_text = F.substr(body, F.lit(1), F.length(body) - len(closed))
    inner = strip(after_last(inner_text, opened))
    fits = (
        (F.length(text) - F.length(body) <= max_trailing)
        & F.endswith(body, F.lit(closed))
        & F.contains(inner_text, F.lit(opened))
        & (F.length(inner) > 0)
    )
    return F.when(fits, inner)


def _right_hand_side(expr: Column) -> Column:
    bare = expr
    for op in ("==", "<=", ">=", "!="):
        bare = F.replace(bare, F.lit(op), F.lit(""))
    return F.when(F.contains(bare, F.lit("=")), strip(after_last(expr, "="))).otherwise(expr)


def _bare_last_line(text: Column) -> Column:
    lines = F.split(rstrip(text), "\n")
    last = strip(F.try_element_at(lines, F.lit(-1)))
    previous = F.coalesce(F.try_element_at(lines, F.lit(-2)), F.lit(""))
    fits = (
        F.length(last).between(1, 80) & ~F.rlike(last, F.lit(r"(?U)\b[a-zA-Z]{3,}\b")) & (F.length(strip(previous)) == 0)
    )
    return F.when(fits, last)


def extract_boxed(text: Column) -> Column:
    """Last box, else display or inline math closing the text, else a bare last line."""
    inline = _closing_block(text, "$", "$")
    return F.coalesce(
        last_boxed(text),
        _closing_block(text, "$$", "$$"),
        _closing_block(text, "\\[", "\\]"),
        F.when(~F.contains(inline, F.lit("\n")), _right_hand_side(inline)),
        _bare_last_line(text),
    )


def extract_answer(kind: Column, text: Column) -> Column:
    return (
        F.when(kind == "integer", extract_integer(text))
        .when(kind == "letter", extract_letter(text))
        .when(kind == "code", extract_code(text))
        .when(kind == "latex", extract_boxed(text))
    )


def canonical_int(text: Column) -> Column:
    """Decimal digits of an integer literal of any size; NULL when it is not one."""
    bare = F.replace(strip(text), F.lit("_"), F.lit(""))
    digits = F.regexp_replace(F.regexp_replace(bare, r"^[+-]", ""), r"^0+(?=\d)", "")
    negative = F.startswith(bare, F.lit("-")) & (digits != "0")
    return F.when(
        F.rlike(strip(text), F.lit(r"^[+-]?\d+(?:_\d+)*$")), F.concat(F.when(negative, "-").otherwise(""), digits)
    )


def grade_integer(predicted: Column, gold: Column) -> Column:
    return F.coalesce(canonical_int(predicted) == canonical_int(gold), F.lit(False))


def grade_letter(predicted: Column, gold: Column) -> Column:
    return F.coalesce(F.upper(strip(predicted)) == F.upper(strip(gold)), F.lit(False))


def ground_truth(dataset: Column, answer: Column) -> Column:
    """Gold answer per dataset; test-case datasets keep theirs in a separate column."""
    return (
        F.when(dataset == "aime", canonical_int(answer))
        .when(dataset == "gpqa", F.nullif(F.substr(F.upper(strip(answer)), F.lit(1), F.lit(1)), F.lit("")))
        .when(dataset == "hmmt", strip(answer))
    )


def format_question(question: Column, choices: Column) -> Column:
    """Question followed by lettered choices; at most four are shown."""
    letters = F.array(*[F.lit(x) for x in "ABCD"])
    shown = F.filter(
        F.zip_with(letters, F.slice(choices, 1, 4), lambda a, c: F.when(c.isNotNull(), F.concat(a, F.lit(") "), c))),
        lambda line: line.isNotNull(),
    )
    listed = F.array_join(F.concat(F.array(strip(question), F.lit("")), shown), "\n")
    return F.when(F.coalesce(F.size(choices), F.lit(0)) > 0, listed).otherwise(question)


def adaptive_cap(thinking_tokens: Column) -> Column:
    return F.least(F.lit(11), 2 + F.greatest(F.lit(0), F.floor((thinking_tokens - 1) / 5000))).cast("long")


def strip_code_fences(text: Column) -> Column:
    """Body between the first and the last fence; a single fence is just removed."""
    trimmed = F.coalesce(strip(text), F.lit(""))
    first = F.locate("```", trimmed)
    last = F.length(trimmed) - F.locate("```", F.reverse(trimmed)) - 1
    body = F.regexp_replace(F.substr(trimmed, first + 3, F.greatest(last - first - 3, F.lit(0))), r"\Apython", "")
    return (
        F.when(first == 0, trimmed)
        .when(first == last, strip(F.replace(trimmed, F.lit("```"), F.lit(""))))
        .otherwise(F.regexp_replace(body, r"\A\n+|\n+\z", ""))
    )
