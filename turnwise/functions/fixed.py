"""These must stay as they are for results to agree with earlier evaluations."""

# Roles a turn may carry, and the default of a turn that names none.
VALID_ROLES = ("human", "gpt")
UNKNOWN_ROLE = "unknown"

# Splits in their order.
SPLITS = ("train", "val", "test")

# Context strategies in their order.
STRATEGIES = ("oracle", "baseline", "compressed")

# Layout of a transcript and of the user message of an answer request.
ROLE_MARK = ": "
TURN_BREAK = "\n\n"
CONTEXT_HEAD = "Context:\n"
QUESTION_HEAD = "\n\nQuestion: "

# Whitespace as Python's str.split and str.strip see it: the Unicode White_Space characters and U+001C..U+001F.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# Patterns of words, code fences, JSON blocks and scores.
WORD = r"[a-z0-9]+(?:'[a-z]+)?"
CODE_FENCE = r"```(?:json)?"
JSON_BLOCK = r"(?s)\{.*\}"
SCORE_FIELD = r'(?U)"score"[\s\x1c-\x1f]*:[\s\x1c-\x1f]*([0-9]+(?:\.[0-9]+)?)'
BARE_NUMBER = r"(?U)\b([0-9]+(?:\.[0-9]+)?)\b"

# Score range and decimals of derived ratios.
MIN_SCORE = 0.0
MAX_SCORE = 10.0
RATIO_DECIMALS = 4

# Default parameters.
MIN_TURNS = 10
TRAIN_RATIO = 0.80
VAL_RATIO = 0.10
SEED = 42
TRUNCATION_TOKENS = 512
N_SAMPLES = 100
QA_PER_CONV = 3
MAX_RETRIES = 3
VECTOR_SIZE = 200
WINDOW = 5
MIN_COUNT = 3
EPOCHS = 10
