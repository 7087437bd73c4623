"""Rollout-shaped relations derived from the driver tables, once for Spark and once as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradelake.plans.registry import table

# --- recorded runs: one baseline row per order, a method row for most of them -----------------

BASE_SQL = """
base AS (
  SELECT 'm' || (o_orderkey % 3) AS model,
         CASE o_orderkey % 4 WHEN 0 THEN 'aime' WHEN 1 THEN 'gpqa' WHEN 2 THEN 'hmmt' ELSE 'livecodebench' END AS dataset,
         o_custkey AS problem_id, o_orderkey AS sample_idx,
         (o_orderkey * 7 + o_custkey) % 3 = 0 AS correct,
         CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE CAST(o_custkey % 1000 AS VARCHAR) END AS predicted_answer,
         CAST(floor(o_totalprice) AS BIGINT) % 5000 AS completion_tokens,
         CAST(1 AS BIGINT) AS num_steps
  FROM orders)
"""

METHOD_SQL = """
meth AS (
  SELECT model, dataset, problem_id, sample_idx,
         (sample_idx * 5 + problem_id) % 5 < 2 AS correct,
         CASE WHEN sample_idx % 9 = 0 THEN NULL ELSE CAST(problem_id % 1000 AS VARCHAR) END AS predicted_answer,
         CASE o_orderpriority WHEN '1-URGENT' THEN 'methodb' WHEN '2-HIGH' THEN 'verify_only'
              WHEN '3-MEDIUM' THEN 'baseline_fallback_no_close' WHEN '4-NOT SPECIFIED' THEN 'ctx_overflow_fallback'
              ELSE 'other_mode' END AS mode,
         completion_tokens + CASE WHEN sample_idx % 13 = 0 THEN 1 ELSE 0 END AS baseline_tokens,
         sample_idx % 900 AS continuation_tokens,
         completion_tokens + sample_idx % 900 + CASE WHEN sample_idx % 17 = 0 THEN 5 ELSE 0 END AS completion_tokens,
         sample_idx % 6 AS num_findings,
         sample_idx % 6 + CASE WHEN sample_idx % 19 = 0 THEN 1 ELSE 0 END AS listed_findings,
         CASE WHEN sample_idx % 23 = 0 THEN NULL WHEN sample_idx % 29 = 0 THEN (sample_idx * 5 + problem_id) % 5 >= 2
              ELSE (sample_idx * 5 + problem_id) % 5 < 2 END AS methodb_correct,
         sample_idx % 3 AS turns_committed
  FROM base JOIN orders ON o_orderkey = sample_idx
  WHERE sample_idx % 7 <> 0)
"""


def baseline_runs(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    return o.select(
        F.concat(F.lit("m"), k % 3).alias("model"),
        F.element_at(F.array(*[F.lit(x) for x in ("aime", "gpqa", "hmmt", "livecodebench")]), (k % 4 + 1).cast("int")).alias(
            "dataset"
        ),
        c.alias("problem_id"),
        k.alias("sample_idx"),
        ((k * 7 + c) % 3 == 0).alias("correct"),
        F.when(k % 11 != 0, (c % 1000).cast("string")).alias("predicted_answer"),
        (F.floor("o_totalprice") % 5000).cast("long").alias("completion_tokens"),
        F.lit(1).cast("long").alias("num_steps"),
        "o_orderpriority",
    )


def method_runs(spark: SparkSession, sf: str) -> DataFrame:
    b = baseline_runs(spark, sf).where("sample_idx % 7 <> 0")
    k, c = F.col("sample_idx"), F.col("problem_id")
    ok = (k * 5 + c) % 5 < 2
    pr = F.col("o_orderpriority")
    one = lambda m, v: F.when(k % m == 0, F.lit(v)).otherwise(F.lit(0))
    return b.select(
        "model",
        "dataset",
        "problem_id",
        "sample_idx",
        ok.alias("correct"),
        F.when(k % 9 != 0, (c % 1000).cast("string")).alias("predicted_answer"),
        F.when(pr == "1-URGENT", "methodb")
        .when(pr == "2-HIGH", "verify_only")
        .when(pr == "3-MEDIUM", "baseline_fallback_no_close")
        .when(pr == "4-NOT SPECIFIED", "ctx_overflow_fallback")
        .otherwise("other_mode")
        .alias("mode"),
        (F.col("completion_tokens") + one(13, 1)).alias("baseline_tokens"),
        (k % 900).alias("continuation_tokens"),
        (F.col("completion_tokens") + k % 900 + one(17, 5)).alias("completion_tokens"),
        (k % 6).alias("num_findings"),
        F.array_repeat(F.lit("f"), (k % 6 + one(19, 1)).cast("int")).alias("findings"),
        F.when(k % 23 == 0, F.lit(None)).when(k % 29 == 0, ~ok).otherwise(ok).alias("methodb_correct"),
        (k % 3).alias("turns_committed"),
    )


# --- group scores: lineitem rows as rollouts of the order they belong to ----------------------

SCORES_SQL = """
scores AS (
  SELECT l_orderkey AS uid, l_partkey AS part, l_suppkey AS supp, l_linenumber AS line,
         l_quantity % 5 AS score, CAST(l_partkey % 50 AS BIGINT) AS length
  FROM lineitem)
"""


def group_scores(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("uid"),
        F.col("l_partkey").alias("part"),
        F.col("l_suppkey").alias("supp"),
        F.col("l_linenumber").alias("line"),
        (F.col("l_quantity") % 5).alias("score"),
        (F.col("l_partkey") % 50).cast("long").alias("length"),
    )


# --- token trajectories: every word of a document is one response token -----------------------

TOKENS_SQL = """
words AS (
  SELECT doc_id AS traj, doc_id // 4 AS uid, unnest(string_split(text, ' ')) AS word,
         generate_subscripts(string_split(text, ' '), 1) - 1 AS t, len(string_split(text, ' ')) AS size
  FROM documents),
tok AS (
  SELECT traj, uid, t, size, length(word) AS n,
         CASE WHEN length(word) % 5 = 0 THEN 0 ELSE 1 END AS mask,
         -(length(word) % 7 + 1) / 8.0::DOUBLE AS old_lp,
         -((length(word) + t) % 7 + 1) / 8.0::DOUBLE AS roll_lp,
         -((length(word) * 3 + t) % 11 + 1) / 12.0::DOUBLE AS new_lp,
         -((length(word) * 2 + t) % 5 + 1) / 6.0::DOUBLE AS ref_lp,
         ((length(word) * 5 + t) % 13) / 13.0::DOUBLE AS value,
         ((length(word) + t) % 9) / 10.0::DOUBLE AS pi2,
         CASE WHEN t = size - 1 THEN CAST(traj % 3 AS DOUBLE) ELSE ((length(word) + traj) % 3 - 1) / 4.0::DOUBLE END AS reward,
         ((length(word) + traj) % 5 - 2) / 2.0::DOUBLE AS adv
  FROM words)
"""


def tokens(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", F.split("text", " ").alias("w"))
    rows = docs.select(
        F.col("doc_id").alias("traj"),
        F.floor(F.col("doc_id") / 4).alias("uid"),
        F.size("w").alias("size"),
        F.posexplode("w").alias("t", "word"),
    )
    n, t = F.length("word"), F.col("t")
    return rows.select(
        "traj",
        "uid",
        "t",
        "size",
        n.alias("n"),
        F.when(n % 5 == 0, 0).otherwise(1).alias("mask"),
        (-(n % 7 + 1) / F.lit(8.0)).alias("old_lp"),
        (-((n + t) % 7 + 1) / F.lit(8.0)).alias("roll_lp"),
        (-((n * 3 + t) % 11 + 1) / F.lit(12.0)).alias("new_lp"),
        (-((n * 2 + t) % 5 + 1) / F.lit(6.0)).alias("ref_lp"),
        (((n * 5 + t) % 13) / F.lit(13.0)).alias("value"),
        (((n + t) % 9) / F.lit(10.0)).alias("pi2"),
        F.when(t == F.col("size") - 1, (F.col("traj") % 3).cast("double"))
        .otherwise(((n + F.col("traj")) % 3 - 1) / F.lit(4.0))
        .alias("reward"),
        (((n + F.col("traj")) % 5 - 2) / F.lit(2.0)).alias("adv"),
    )


def trajectories(spark: SparkSession, sf: str) -> DataFrame:
    """The same tokens as array columns, one row per document."""
    d = table(spark, sf, "documents").select("doc_id", F.split("text", " ").alias("w"))
    n = d.select("doc_id", F.transform("w", lambda x: F.length(x)).alias("n"))
    k = F.col("doc_id")
    last = F.size("n") - 1
    return n.select(
        k.alias("traj"),
        F.floor(k / 4).alias("uid"),
        "n",
        F.transform("n", lambda x: F.when(x % 5 == 0, 0).otherwise(1)).alias("mask"),
        F.transform("n", lambda x: -(x % 7 + 1) / F.lit(8.0)).alias("old_lp"),
        F.transform("n", lambda x, i: -((x + i) % 7 + 1) / F.lit(8.0)).alias("roll_lp"),
        F.transform("n", lambda x, i: -((x * 3 + i) % 11 + 1) / F.lit(12.0)).alias("new_lp"),
        F.transform("n", lambda x, i: -((x * 2 + i) % 5 + 1) / F.lit(6.0)).alias("ref_lp"),
        F.transform("n", lambda x: ((x + k) % 5 - 2) / F.lit(2.0)).alias("adv"),
        F.transform("n", lambda x, i: ((x * 5 + i) % 13) / F.lit(13.0)).alias("value"),
        F.transform("n", lambda x, i: ((x + i) % 9) / F.lit(10.0)).alias("pi2"),
        F.transform(
            "n", lambda x, i: F.when(i == last, (k % 3).cast("double")).otherwise(((x + k) % 3 - 1) / F.lit(4.0))
        ).alias("reward"),
    )


# --- model responses: the whole document is the thinking text ---------------------------------

RESPONSES_SQL = """
responses AS (
  SELECT doc_id, lang, source,
         CASE doc_id % 9
           WHEN 0 THEN '<think>' || text || '</think> So <Answer> ' || n_chars || ' </Answer>'
           WHEN 1 THEN '<think>' || text || '</think>\nThe result is \\boxed{' || n_chars || '}.'
           WHEN 2 THEN '<think>' || text || '</think> **Answer**: ' || n_chars
           WHEN 3 THEN '<think>' || text || ' never closed <Answer>-' || n_chars || '</Answer>'
           WHEN 4 THEN '<think>a</think>' || text || '</think> <Answer>1</Answer> then <Answer>' || (n_chars % 10) || '</Answer>'
           WHEN 5 THEN text
           WHEN 6 THEN '<think>' || text || '</think> Final answer: ' || substr('ABCD', CAST(n_chars % 4 + 1 AS INTEGER), 1)
           WHEN 7 THEN '<think>' || text || '</think> ```python\nprint(' || n_chars || ')\n```'
           ELSE '<think>' || text || '</think> gives \\boxed{\\frac{' || n_chars || '}{' || (doc_id + 1) || '}}'
         END AS response, text, n_chars
  FROM documents)
"""


def responses(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    txt, n, k = F.col("text"), F.col("n_chars").cast("string"), F.col("doc_id") % 9
    think = F.concat(F.lit("<think>"), txt, F.lit("</think>"))
    letter = F.substr(F.lit("ABCD"), (F.col("n_chars") % 4 + 1).cast("int"), F.lit(1))
    resp = (
        F.when(k == 0, F.concat(think, F.lit(" So <Answer> "), n, F.lit(" </Answer>")))
        .when(k == 1, F.concat(think, F.lit("\nThe result is \\boxed{"), n, F.lit("}.")))
        .when(k == 2, F.concat(think, F.lit(" **Answer**: "), n))
        .when(k == 3, F.concat(F.lit("<think>"), txt, F.lit(" never closed <Answer>-"), n, F.lit("</Answer>")))
        .when(
            k == 4,
            F.concat(
                F.lit("<think>a</think>"), txt, F.lit("</think> <Answer>1</Answer> then <Answer>"),
                (F.col("n_chars") % 10).cast("string"), F.lit("</Answer>"),
            ),
        )
        .when(k == 5, txt)
        .when(k == 6, F.concat(think, F.lit(" Final answer: "), letter))
        .when(k == 7, F.concat(think, F.lit(" ```python\nprint("), n, F.lit(")\n```")))
        .otherwise(
            F.concat(think, F.lit(" gives \\boxed{\\frac{"), n, F.lit("}{"), (F.col("doc_id") + 1).cast("string"), F.lit("}}"))
        )
    )
    return d.select("doc_id", "lang", "source", resp.alias("response"), "text", "n_chars")


def with_(*ctes: str) -> str:
    """``WITH`` clause from the CTE texts above."""
    return "WITH " + ",".join(c.strip() for c in ctes) + "\n"
