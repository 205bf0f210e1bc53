"""Logical tables as Spark DDL, and the region codes."""

REGION_CONTEXT, REGION_PROSE, REGION_TOOL_CALL, REGION_TAG, REGION_FINAL = 0, 1, 2, 3, 4
SUB_NAME, SUB_ARGS = 10, 11
NO_LOSS = -100

RAW_SINGLE = "id bigint, query string, tools string, answers string"
RAW_MULTI = "id string, conversations struct<`from`: array<string>, value: array<string>>"
TOOL = "struct<name: string, description: string, props: map<string, string>, required: array<string>>"
RECORD = (
    "query_id string, input_ids array<int>, labels array<int>, regions array<struct<code: int, len: int>>, "
    "n_prompt_tokens int, n_tokens int, n_tool_calls int, n_tools int"
)
GENERATION = "query_id string, output_ids array<int>, logprobs array<array<struct<id: int, lp: double>>>, finish_reason string"
EVENT = (
    "query_id string, turn int, step int, draft_tokens array<int>, accept_mask array<boolean>, correction_token int, "
    "eos boolean, step_type string, propose_ms double, verify_ms double"
)
OUTPUT = "query_id string, turn int, output_ids array<int>"
BENCH = (
    "kind string, tag string, ts string, dataset string, limit int, per_turn boolean, model string, spec_method string, "
    "method_detail string, spec_config struct<method: string, model: string, num_speculative_tokens: int>, batch int, runs int, "
    "median_wall_s double, median_gen_tok_s double, median_total_tok_s double"
)
