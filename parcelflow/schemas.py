"""Declared table schemas."""

TWEETS = "tweet_id string, inbound string, text string, response_tweet_id string"
INSTRUCTIONS = "instruction string, response string"
RAW_PAIRS = (
    "source string, src_key string, ord decimal(38,0), input_raw string, assistant_raw string"
)
SFT_PAIRS = "input string, assistant_response string"
MANIFEST = "total_pairs bigint, train_pairs bigint, val_pairs bigint, ratios map<string,double>"
KB_FILES = "source string, text string, carrier string"
KB_CHUNKS = "source string, chunk_id string, text string, vec array<float>, carrier string"
MESSAGES = (
    "msg_id bigint, conv_id bigint, turn bigint, text string, tracking string, carrier string"
)
TURNS = "conv_id bigint, turn bigint, role string, text string"
SHIPMENTS = (
    "ship_id bigint, origin_cc string, dest_cc string, weight_kg double, l_cm double, "
    "w_cm double, h_cm double, service string"
)
RAW_ANSWERS = "msg_id bigint, user_msg string, tracking string, raw string"
