"""Findings lists, anchor/finding pairs and where to cut a generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gradelake.functions.text import LINE_BREAK, any_of, let, rstrip, strip

# Lines an extractor writes that are not findings.
BAD_PREFIX = r"(?Ui)^\s*(?:ANCHOR\b|FINDING\b|</?think>|<\|?channel)"
META_VERBS = (
    "Analyze|Review|Recall|Extract|Summariz(?:e|ing)|Summary|Restate|Identify|Understand|"
    "Clarif(?:y|ication)|Outline|Plan|Approach|Strategy|Examine|Re-?examine"
)
META_OBJECTS = (
    r"the\s+Request|the\s+Problem|the\s+Reasoning(?:\s+Pass)?|the\s+Task|the\s+Question|the\s+Goal|the\s+Objective|"
    r"(?:Key\s+|The\s+)?Findings?|(?:Key\s+|The\s+)?Conclusions?|"
    r"the\s+Solution|my\s+Reasoning|Prior\s+Reasoning|Key\s+Points?"
)
META_FINDING = rf"(?Ui)^\s*\*{{0,2}}\s*(?:{META_VERBS})\s+(?:{META_OBJECTS})"
EMPTY_HEADER = r"(?U)^\s*\*{2,}[^*\n]{1,120}:\s*\*{2,}\s*$"
LABEL_ONLY = r"(?U)^\s*\*{0,2}\s*\w+(?:\s+\w+){0,2}\s*[:：.]\s*\*{0,2}\s*$"
ECHO_LABEL = (
    r"(?Ui)^\s*\*{0,2}\s*(?:Goal|Format|Problem(?:\s+Statement)?|Question|Given|Find|Required|Requirement|Objective|"
    r"Task|To\s+Find|We\s+need|We\s+want|We\s+are\s+asked)\s*\*{0,2}\s*:\s*\S"
)
RULES_ECHO = (
    r"(?Ui)(AT\s+MOST\s+\d+\s+findings|Pick\s+the\s+\d+\s+most\s+load[-\s]bearing|load[-\s]bearing|one\s+short\s+sentence|"
    r"plain\s+bullet\s+list|No\s+preamble|No\s+closing\s+remarks|Do\s+NOT\s+re-?derive|Do\s+NOT\s+evaluate\s+correctness|"
    r"Do\s+NOT\s+restate\s+the\s+final\s+answer|each\s+line\s+starting\s+with|The\s+RULES\s+above\s+describe)"
)
BULLET = r"(?U)^(?:[-*•]|\d+[.)])\s+(.+)$"
QUOTES = "\"“”"
# the group is a number, what stands between, and the text; the second pattern parts them
ANCHOR_PAIR = r"(?Uis)ANCHOR\s*(\d+\s*:\s*[\"“”].+?)[\"“”]", r"(?U)\A\d+\s*:\s*[\"“”]"
FINDING_PAIR = r"(?Uis)FINDING\s*(\d+\s*:\s*.+?)(?=\n\s*(?:ANCHOR|FINDING)\s*\d|\z)", r"(?U)\A\d+\s*:\s*"


def parse_findings(text: Column, cap: Column) -> Column:
    """Bullet bodies that are findings, cut to 500 characters, at most ``cap`` of them."""
    body = lambda line: strip(
        F.regexp_replace(strip(F.regexp_extract(strip(line), BULLET, 1)), f"^[{QUOTES}]+|[{QUOTES}]+$", "")
    )
    bodies = F.transform(F.split(strip(text), LINE_BREAK), body)
    good = F.filter(
        bodies,
        lambda b: (F.length(b) > 0) & ~any_of(b, [BAD_PREFIX, META_FINDING, EMPTY_HEADER, ECHO_LABEL, LABEL_ONLY]),
    )
    cut = F.transform(
        good, lambda b: F.when(F.length(b) > 500, F.concat(rstrip(F.left(b, F.lit(500))), F.lit("..."))).otherwise(b)
    )
    return F.coalesce(F.slice(cut, F.lit(1), cap.cast("int")), F.array().cast("array<string>"))


def findings_issue(new: Column, prior: Column | None = None) -> Column:
    """``empty``, ``meta_leak``, ``all_duplicates_of_prior`` or NULL."""
    norm = lambda s: F.left(F.lower(strip(F.regexp_replace(s, r"(?U)\s+", " "))), F.lit(80))
    empty = F.coalesce(F.size(new), F.lit(0)) == 0
    issue = F.when(empty, "empty").when(F.exists(new, lambda f: F.rlike(f, F.lit(RULES_ECHO))), "meta_leak")
    if prior is None:
        return issue
    repeated = let(
        F.struct(F.transform(prior, norm).alias("p"), F.transform(new, norm).alias("n")),
        lambda s: F.size(F.array_except(s["n"], s["p"])) == 0,
    )
    return issue.when((F.size(prior) > 0) & repeated, "all_duplicates_of_prior")


def anchor_pairs(text: Column) -> Column:
    """Array of struct(anchor, finding), paired by number; a repeated number keeps its last text."""
    empty = F.array().cast("array<struct<anchor:string,finding:string>>")
    head = F.upper(strip(text))
    # the text is searched once per pattern
    entries = lambda p: F.transform(
        F.regexp_extract_all(text, F.lit(p[0]), F.lit(1)),
        lambda e: F.struct(F.regexp_extract(e, r"(?U)\A\d+", 0).alias("id"), F.regexp_replace(e, p[1], "").alias("v")),
    )
    both = F.struct(entries(ANCHOR_PAIR).alias("a"), entries(FINDING_PAIR).alias("f"))

    def pick(s):
        ids = F.transform(
            F.array_sort(F.transform(F.array_distinct(s["a"]["id"]), lambda i: F.struct(i.cast("decimal(38,0)").alias("k"), i.alias("i")))),
            lambda x: x["i"],
        )
        last = lambda part, i: F.try_element_at(F.filter(s[part], lambda e: e["id"] == i), F.lit(-1))["v"]
        pairs = F.transform(
            ids,
            lambda i: F.struct(
                strip(last("a", i)).alias("anchor"),
                strip(F.regexp_replace(strip(last("f", i)), f"[{QUOTES}]+$", "")).alias("finding"),
            ),
        )
        return F.filter(pairs, lambda p: (F.length(p["anchor"]) > 0) & (F.length(p["finding"]) > 0))

    stop = F.startswith(head, F.lit("NO_PROGRESS")) | F.startswith(head, F.lit("NO_VERIFIED_PROGRESS"))
    return F.when(F.coalesce(stop, F.lit(True)), empty).otherwise(let(both, pick))


def last_anchor_end(text: Column, anchors: Column) -> Column:
    """Position just after the latest anchor found in the text (-1 when none is).

    Whole anchors first; else their first 40 characters, extended to the end of that sentence.
    """
    end_of = lambda needle: F.length(text) - F.length(F.call_function("substring_index", text, needle, F.lit(-1)))

    def one(raw):
        a = strip(raw)
        probe = strip(F.left(a, F.lit(40)))
        stop = end_of(probe)
        tail = F.substr(text, stop + 1, F.lit(300))
        extra = F.length(F.regexp_extract(tail, r"(?Us)\A(.*?[.!?。！？]['\"”)]?\s)", 1))
        return (
            F.when(F.length(a) < 10, F.lit(-1))
            .when(F.contains(text, a), end_of(a))
            .when((F.length(probe) >= 12) & F.contains(text, probe), stop + extra)
            .otherwise(F.lit(-1))
        )

    return F.coalesce(F.array_max(F.transform(anchors, one)), F.lit(-1))


def anchor_match(text: Column, anchors: Column) -> Column:
    """``verbatim``, ``fuzzy`` or ``none``: how the anchors were located."""
    whole = F.exists(anchors, lambda a: (F.length(strip(a)) >= 10) & F.contains(text, strip(a)))
    return F.when(last_anchor_end(text, anchors) <= 0, "none").when(whole, "verbatim").otherwise("fuzzy")


def trim_to_last_sentence(text: Column) -> Column:
    """Cut after the last sentence end of the final 500 characters, else at the last newline there."""
    tail = F.right(text, F.lit(500))
    start = F.length(text) - F.length(tail)
    upto = F.length(F.regexp_extract(tail, r"(?Us)\A(.*[.!?。！？]['\")\]]?\s)", 1))
    newline = start + F.length(tail) - F.locate("\n", F.reverse(tail))
    has_newline = F.contains(tail, F.lit("\n")) & (newline > 0)
    return (
        F.when(upto > 0, rstrip(F.left(text, start + upto)))
        .when(has_newline, rstrip(F.left(text, newline)))
        .otherwise(text)
    )
