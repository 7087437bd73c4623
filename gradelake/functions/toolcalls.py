"""Tool calls in model output: three notations, each as array<struct<name, arguments>>."""

from __future__ import annotations

import ast
import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

CALLS = "array<struct<name:string,arguments:string>>"
BLOCK = r"(?s)<tool_call>(.*?)</tool_call>"
CHANNEL_CALL = (
    r"(?s)<\|start\|>assistant<\|channel\|>[^<]* to=functions\.([^<]+) <\|constrain\|>json<\|message\|>(.*?)<\|call\|>"
)
ANALYSIS = r"(?s)(?:<\|start\|>assistant)?<\|channel\|>analysis<\|message\|>.*?<\|end\|>"


def json_calls(text: Column) -> Column:
    """JSON objects in <tool_call> blocks; an unreadable one is left out."""
    bodies = F.regexp_extract_all(text, F.lit(BLOCK), F.lit(1))
    read = F.transform(
        bodies,
        lambda b: F.struct(F.get_json_object(b, "$.name").alias("name"), F.get_json_object(b, "$.arguments").alias("arguments")),
    )
    return F.filter(read, lambda c: c["name"].isNotNull() & c["arguments"].isNotNull())


def text_without_calls(text: Column) -> Column:
    return F.regexp_replace(text, BLOCK, "")


def channel_calls(text: Column) -> Column:
    """Calls in the commentary channel; the analysis channel is removed first."""
    visible = F.regexp_replace(text, ANALYSIS, "")
    names = F.regexp_extract_all(visible, F.lit(CHANNEL_CALL), F.lit(1))
    args = F.regexp_extract_all(visible, F.lit(CHANNEL_CALL), F.lit(2))
    return F.zip_with(names, args, lambda n, a: F.struct(n.alias("name"), a.alias("arguments")))


def _typed(value: str, declared: str | None):
    if value.lower() == "null":
        return None
    kind = (declared or "string").strip().lower()
    try:
        if kind.startswith(("int", "uint", "long", "short", "unsigned")):
            return int(value)
        if kind.startswith(("num", "float")):
            number = float(value)
            return number if number != int(number) else int(number)
        if kind in ("boolean", "bool", "binary"):
            return value.lower() == "true"
        if kind == "object" or kind.startswith("dict"):
            return json.loads(value)
        if kind not in ("string", "str", "text", "varchar", "char", "enum"):
            return ast.literal_eval(value)
    except (ValueError, SyntaxError, OverflowError):
        pass
    return value


def xml_calls(text: Column, types: dict[str, dict[str, str]] | None = None) -> Column:
    """<function=..><parameter=..> calls; ``types`` maps function -> parameter -> declared type."""
    declared = types or {}

    def read(text_: str) -> list[tuple[str, str]]:
        blocks = [a or b for a, b in re.findall(r"(?s)<tool_call>(.*?)</tool_call>|<tool_call>(.*?)$", text_)] or [text_]
        out = []
        for block in blocks:
            for a, b in re.findall(r"(?s)<function=(.*?)</function>|<function=(.*)$", block):
                name, sep, body = (a or b).partition(">")
                if not sep:
                    continue
                args = {}
                for p, q in re.findall(r"(?s)<parameter=(.*?)</parameter>|<parameter=(.*?)$", body):
                    key, _, value = (p or q).partition(">")
                    value = value.removeprefix("\n").removesuffix("\n")
                    args[key] = _typed(value, declared.get(name, {}).get(key))
                out.append((name, json.dumps(args, ensure_ascii=False)))
        return out

    @F.pandas_udf(CALLS)
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: [] if t is None else [{"name": n, "arguments": a} for n, a in read(t)])

    return run(text)


def shorten_tool_response(text: Column, limit: int, side: str = "middle") -> Column:
    """``left`` keeps the head, ``right`` the tail, anything else both halves."""
    mark = F.lit("...(truncated)")
    if side == "left":
        cut = F.concat(F.left(text, F.lit(limit)), mark)
    elif side == "right":
        cut = F.concat(F.lit("(truncated)..."), F.right(text, F.lit(limit)))
    else:
        half = limit // 2
        cut = F.concat(F.left(text, F.lit(half)), F.lit("...(truncated)..."), F.right(text, F.lit(half)))
    return F.when(F.length(text) > limit, cut).otherwise(text)


def literal_equal(got: Column, want: Column) -> Column:
    """Whether two outputs are equal as Python literals, or as text where they are not literals."""

    def value(t):
        try:
            return ast.literal_eval(t)
        except Exception:
            return t

    @F.pandas_udf("boolean")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([value(x) == value(y) for x, y in zip(a, b)])

    return run(got, want)


TESTS = "array<struct<input:string,output:string,testtype:string,metadata:struct<func_name:string>>>"


def test_cases(info: Column, fallback: Column, question: Column) -> Column:
    """Struct(tests, func_name): JSON inside JSON, else the listed cases; the name may come from a ``def``."""
    inner = F.from_json(F.get_json_object(info, "$.ground_truth"), TESTS)
    tests = F.when(F.size(inner) > 0, inner).otherwise(fallback)
    named = F.get(inner, F.lit(0))["metadata"]["func_name"]
    stated = F.nullif(F.regexp_extract(question, r"(?U)def\s+(\w+)\s*\(", 1), F.lit(""))
    return F.struct(tests.alias("tests"), F.coalesce(F.nullif(named, F.lit("")), stated).alias("func_name"))


def count_tokens(text: Column) -> Column:
    """Words and single symbols, where no tokenizer file is at hand; ``tokenizer.token_counts`` gives a model's own counts."""
    return F.size(F.regexp_extract_all(text, F.lit(r"(?U)(\w+|[^\w\s])"), F.lit(1)))
