"""Fixed parameters of scoring and feedback."""

# Fixed values of the contract.
SCALE = 1_000_000
STRUCTURAL_GAIN_PPM = 400_000
LEARNED_GAIN_PPM = 400_000
FEEDBACK_HISTORY_CAPACITY = 16
FEEDBACK_PRIOR_MASS = 7
MAX_FEEDBACK_TARGETS = 10_000
MAX_SYMBOL_BYTES = 4_096
DEFAULT_RECALL_LIMIT = 10
FORMAT_VERSION = 6
MAX_REVISION = (1 << 63) - 1

MAX_SCORE = STRUCTURAL_GAIN_PPM + LEARNED_GAIN_PPM
HISTORY_MASK = (1 << FEEDBACK_HISTORY_CAPACITY) - 1
