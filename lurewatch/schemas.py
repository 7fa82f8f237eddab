"""Fixed schemas of the tables the package reads and writes, as DDL."""

URL_TRAINING = "url string, label int"
TEXT_TRAINING = "text string, label int"
MESSAGES = "msg_id bigint, url string, text string, force_expert boolean"
MESSAGE_COLUMNS = ["msg_id", "url", "text", "force_expert"]

EXPERT_REQUEST_COLUMNS = ["cache_key", "url", "text", "prompt"]
EXPERT_RESPONSE = (
    "cache_key string, response_text string, input_tokens int, output_tokens int, "
    "status string, error string, response_time_ms bigint"
)
EXPERT_RESPONSE_COLUMNS = [
    "cache_key", "response_text", "input_tokens", "output_tokens", "status", "error", "response_time_ms",
]
EXPERT_RESULT = (
    "struct<result: string, confidence: double, reasoning: array<string>, "
    "metadata: struct<tier: int, model: string, tokens: int, cache_hit: boolean, "
    "response_time_ms: bigint, error: string>>"
)
VERDICT_CACHE = "cache_key string, response_json string, created_at double"
VERDICT_CACHE_COLUMNS = ["cache_key", "response_json", "created_at"]

MAIL_EVENT = (
    "type string, payload struct<email: string, name: string, content: string>, "
    "session_id string, mail_id string, ts timestamp, event_id bigint"
)
