"""Deterministic prompt and injection text, assembled as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gradelake.functions.text import strip

# What each dataset asks for, and the self-check wording that recorded responses contain.
TASK_HEADERS = {
    "aime": "Solve the math problem. Final answer must be a single non-negative integer in <Answer>...</Answer>.",
    "gpqa": "Select the best answer. Final answer must be a single letter (A, B, C, or D) in <Answer>...</Answer>.",
    "livecodebench": "Solve the coding task. Put your final solution in a single Python code block delimited by ```python ... ```.",
    "hmmt": "Solve the math problem. Final answer must be the EXACT value (simplified, no decimal approximations) in \\boxed{...}. "
    "If there are multiple solutions, list all of them inside the single \\boxed{...} separated by commas.",
}
OPENINGS = {
    "default": "Wait, before I commit to a final answer, let me restate what's being asked and double-check the key "
    "conclusions I've been relying on.",
    "again": "Wait, before I commit to a final answer, let me double-check the key conclusions I've been relying on one more time.",
    "final": "Wait, before I commit to a final answer, let me double-check the key conclusions I've been relying on for the last time.",
}
STEERS = {
    "default": "",
    "again": " This time, approach the verification by a completely different method than I used above — e.g. plug in specific "
    "numeric values to test an equation, try a closed-form where I enumerated, enumerate where I used a formula, or attack the "
    "problem from a different physical/mathematical angle. Do not just re-run the same derivation.",
    "final": " This is my last check, so I need an independent cross-verification — use yet another approach I haven't tried yet "
    "(concrete sanity plug-in, orthogonal derivation, dimensional / limiting-case check, or a counter-example search). If the new "
    "method disagrees with my current answer, revise; if it agrees, commit.",
}


def task_header(dataset: Column) -> Column:
    out = None
    for key, text in TASK_HEADERS.items():
        out = F.when(dataset == key, text) if out is None else out.when(dataset == key, text)
    return out


def baseline_prompt(dataset: Column, question: Column) -> Column:
    return F.concat(task_header(dataset), F.lit("\n\n"), question, F.lit("\n"))


def stepwise_prompt(dataset: Column, question: Column) -> Column:
    """Baseline prompt whose first sentence asks for step-by-step reasoning (not for latex tasks)."""
    header = F.when(dataset == "hmmt", task_header(dataset)).otherwise(
        F.regexp_replace(task_header(dataset), r"\A([^.]*)\. ", "$1 by reasoning step by step. ")
    )
    return F.concat(header, F.lit("\n\n"), question, F.lit("\n"))


def numbered(items: Column, prefix: str, suffix: str) -> Column:
    return F.transform(items, lambda x, i: F.concat(F.lit(prefix), (i + 1).cast("string"), F.lit(suffix), x))


def progress_injection(dataset: Column, question: Column, findings: Column) -> Column:
    """Block spliced between rounds: task, question and the findings so far."""
    lines = F.concat(
        F.array(
            F.lit("Let me summarize the current progress."),
            F.concat(F.lit("The user's request is: "), task_header(dataset)),
            F.concat(F.lit("Question: "), question),
        ),
        numbered(findings, "Critical finding ", ": "),
        F.array(F.lit("Let me continue thinking from here.")),
    )
    return F.concat(F.lit("\n\n"), F.array_join(lines, "\n"), F.lit("\n\n"))


def check_injection(dataset: Column, question: Column, findings: Column, answer: Column, variant: str = "default") -> Column:
    """Self-verification block; empty without findings, anchored on ``answer`` where there is one."""
    steer = STEERS[variant]
    head = F.array(
        F.lit(""), F.lit(""), F.lit(OPENINGS[variant]), F.lit(""),
        F.concat(F.lit("The user's request: "), task_header(dataset)),
        F.concat(F.lit("Question: "), question),
        F.lit(""), F.lit("Key conclusions so far:"),
    )
    verify = "Let me verify each of these conclusions and check whether they actually support this {} — or whether I've missed something that would change it."
    code = F.array(
        F.lit("Before finalizing, my current working implementation is:"), F.lit(""), F.lit("```python"), strip(answer),
        F.lit("```"), F.lit(""), F.lit(verify.format("implementation") + steer),
    )
    plain = F.array(
        F.concat(F.lit("Before finalizing, my current working answer is "), answer, F.lit(".")),
        F.lit(verify.format("answer") + steer),
    )
    bare = F.array(F.lit("Let me verify each of these one more time before finalizing my answer." + steer))
    anchored = F.coalesce(F.length(answer), F.lit(0)) > 0
    tail = F.when(anchored & (dataset == "livecodebench"), code).when(anchored, plain).otherwise(bare)
    listed = numbered(findings, "  ", ". ")
    text = F.array_join(F.concat(head, listed, F.array(F.lit("")), tail, F.array(F.lit(""))), "\n")
    return F.when(F.coalesce(F.size(findings), F.lit(0)) > 0, text).otherwise(F.lit(""))


def findings_request(instructions: str, question: Column, body: Column, prior: Column, cap: Column) -> Column:
    """Extractor prompt: the caller's instruction text (``{cap}`` is filled in), problem, reasoning, earlier findings."""
    earlier = F.when(
        F.coalesce(F.size(prior), F.lit(0)) > 0,
        F.concat(F.array_join(F.transform(prior, lambda p: F.concat(F.lit("- "), p)), "\n"), F.lit("\n\n")),
    ).otherwise("")
    rules = F.replace(F.lit(instructions), F.lit("{cap}"), cap.cast("string"))
    return F.concat(rules, F.lit("\n\nProblem: "), question, F.lit("\n\n"), body, F.lit("\n\n"), earlier)


def split_at_injection(response: Column, candidates: list[Column], close: str) -> Column:
    """Struct(matched, before, after): the first candidate found in the response, whose continuation must close.

    NULL when no candidate occurs or the close marker is missing after it.
    """
    found = F.coalesce(*[F.when((F.length(c) > 0) & F.contains(response, c), c) for c in candidates])
    before = F.call_function("substring_index", response, found, F.lit(1))
    after = F.substr(response, F.length(before) + F.length(found) + 1)
    return F.when(
        found.isNotNull() & F.contains(after, F.lit(close)),
        F.struct(found.alias("matched"), before.alias("before"), after.alias("after")),
    )


def bare_question(text: Column, preamble: str, postamble: str) -> Column:
    """Drop a leading preamble once and a postamble wherever it is."""
    rest = F.when(F.startswith(text, F.lit(preamble)), F.substr(text, F.lit(len(preamble) + 1))).otherwise(text)
    return strip(F.replace(rest, F.lit(postamble), F.lit("")))


def message_parts(content: Column) -> Column:
    """Split a message at image/video placeholders into typed parts (text parts may not be empty)."""
    pieces = F.split(content, r"(?=<image>|<video>)|(?<=<image>)|(?<=<video>)")
    typed = F.transform(
        pieces,
        lambda p: F.struct(
            F.when(p == "<image>", "image").when(p == "<video>", "video").otherwise("text").alias("type"), p.alias("text")
        ),
    )
    return F.filter(typed, lambda p: F.length(p["text"]) > 0)
