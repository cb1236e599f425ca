"""Explicit schemas of the engine's tables, as DDL. Nothing is inferred."""

from __future__ import annotations

GROUND_TRUTH_VALUE = "struct<answer: string, before_answer: string, after_answer: string>"
EXPLANATIONS = "map<string, map<string, array<string>>>"
PATCH_VALUE = "struct<instance_id: string, model_patch: string>"
RESULT_FILE = "struct<statistics: struct<mean: double, sem: double>, raw: map<string, array<double>>>"
GENERATION_FILE = "struct<token_usage: struct<completion_tokens: bigint, prompt_tokens: bigint, total_tokens: bigint>, predictions: map<string, array<struct<answer: array<string>>>>>"
ALLOWED = "map<string, map<string, array<string>>>"

STACKS = "target string, stack array<array<string>>"
PBT = "instance_id string, pbt string"
ERROR_INFO = "struct<info_list: array<struct<lineno: int, exception_type: string>>>"

EVENTS = (
    "agent string, instance_id string, test_id int, side string, event_id bigint, event_type string, filepath string, "
    "line_number int, function_name string, statement string, vars_used array<string>, vars_defined array<string>, "
    "seen_variables string, parameters string, return_value string, exception_type string, exception_value string"
)
TRACE_KEY = ["agent", "instance_id", "test_id", "side"]
PAIR_KEY = ["agent", "instance_id", "test_id"]

DIFFS = "kind string, path string, old_value string, new_value string, old_type string, new_type string"
DEFS = "start int, end int, qualname string"
PATCH_LINES = "side string, path string, line int"

DIVERGENCE = (
    "function_name string, file_path string, buggy_event_id bigint, patched_event_id bigint, buggy_event_type string, "
    "patched_event_type string, buggy_statement string, patched_statement string, location string, before_or_after string, "
    "buggy_lineno int, patched_lineno int, buggy_function_param string, diff_kind string, diff_path string, "
    "buggy_variables string, patched_variables string, seen_pmf boolean, status string"
)
