"""Declared schemas of recorded runs and trajectories, and the two small settings tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from gradelake.functions.extract import ANSWER_KINDS
from gradelake.functions.think import CHANNEL_MARKERS, DEFAULT_MARKERS

PROBLEMS = (
    "id string, question_id string, question string, prompt string, choices array<string>, options array<string>, answer string, "
    "gt_answer string, problem_type array<string>, source string, verification_info string"
)
BASELINE = (
    "problem_id string, sample_idx int, `group` string, gt_answer string, predicted_answer string, correct boolean, "
    "completion_tokens long, num_steps int, response string"
)
MULTI_ROUND = (
    BASELINE + ", thinking_closed boolean, all_step_outputs array<string>, round_finish_reasons array<string>, findings array<string>, "
    "last_round_prompt_tokens long, last_round_gen_tokens long, last_round_total_tokens long, skipped_overlength boolean"
)
REPLAY = (
    BASELINE + ", ablation string, baseline_tokens long, continuation_tokens long, thinking_tokens long, findings_cap int, "
    "num_findings int, findings array<string>, mode string, continuation_finish string, baseline_correct boolean, "
    "methodb_correct boolean, turns_requested int, turns_committed int, findings_per_turn array<array<string>>, "
    "continuation_tokens_per_turn array<long>, findings_cap_per_turn array<int>, grader_reason string, no_answer_repair boolean"
)
TRAJECTORIES = (
    "uid string, session_id string, traj_index int, step int, data_source string, prompt_ids array<int>, response_ids array<int>, "
    "response_mask array<int>, attention_mask array<int>, rollout_log_probs array<double>, old_log_probs array<double>, "
    "ref_log_probs array<double>, log_probs array<double>, values array<double>, token_level_scores array<double>, "
    "sum_pi_squared array<double>, reward_model struct<style:string,ground_truth:string>, extra_info map<string,string>, "
    "num_turns int, min_global_steps int, max_global_steps int"
)

# Model keys whose thinking markers differ from the default ones.
CHANNEL_MODELS = ["gemma4_31b_it", "gemma4_e4b_it"]
THINK_MODELS = ["qwen35_35b_a3b", "glm41v_9b_thinking", "r1_distill_qwen_32b", "qwen35_9b", "r1_distill_qwen_7b"]


def schema(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)


def model_table(spark: SparkSession) -> DataFrame:
    rows = [(m, *DEFAULT_MARKERS) for m in THINK_MODELS] + [(m, *CHANNEL_MARKERS) for m in CHANNEL_MODELS]
    return spark.createDataFrame(rows, "model string, think_open string, think_close string")


def dataset_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(ANSWER_KINDS.items()), "dataset string, answer_kind string")
