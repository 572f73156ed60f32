"""Fixed values that must equal the behaviour being reproduced.

Everything here is a literal fact about the artefact formats (names, caps,
limits, reserved keys, patterns).  Logic lives elsewhere.
"""

from __future__ import annotations

# ---------------------------------------------------------------------------
# Size caps (bytes).  A file whose size equals the cap is kept.
# ---------------------------------------------------------------------------
MAX_CONTEXT_FILE_SIZE = 10_000_000
MAX_EXECUTION_LOG_SIZE = 50_000_000

# ---------------------------------------------------------------------------
# Preview limits (characters) and the marker appended on a cut.
# ---------------------------------------------------------------------------
TRAJECTORY_PREVIEW_LIMIT = 1000
CODE_PREVIEW_LIMIT = 3000
INSIGHT_PREVIEW_LIMIT = 200
TOOL_RESULT_PREVIEW_LIMIT = 500
TRAJECTORY_MARKER = "\n  ... (truncated)"
INSIGHT_MARKER = "..."
TAIL_LINES = 10

# ---------------------------------------------------------------------------
# Directory and file names of the runs tree.
# ---------------------------------------------------------------------------
RUN_DIR_PATTERN = r"^run_(\d+)$"
GEN_DIR_PATTERN = r"^gen_(\d+)$"
EXEC_FILE_PATTERN = r"^execution_q(\d+)\.json$"
CONTEXT_FILE = "context.md"
PROFILES_FILE = "profiles.json"
AGENT_EXECUTION_DIR = "agent_execution"
AGENT_EXECUTION_JSON = "agent_execution.json"
OPENHANDS_DIR = "openhands_trajectory"
COMPLETED_MARKER = "COMPLETED"
EVAL_LOG = "evaluation.log"
EVALUATOR_TIMEOUT = 600   # seconds

# Known text artefacts of a generation: label -> file name.
TEXT_ARTIFACTS = {
    "target_agent": "target_agent.py",
    "improvement": "improvement.md",
    "meta_prompt": "meta_agent_prompt.txt",
    "feedback_prompt": "feedback_agent_prompt.txt",
    "stdout_log": "target_agent_stdout.log",
}
STDOUT_LOG_NAMES = ("target_agent_stdout.log", "train_stdout.log")
EVAL_RESULT_NAMES = ("evaluation_results.json", "results.json")
LABEL_SUBMISSION_NAMES = ("submission.csv", "predictions.csv")
METRIC_SOURCE_NAMES = ("results.json", "detailed_results.json")

# Keys of a flat multiple-choice submission that are never question ids.
RESERVED_SUBMISSION_KEYS = (
    "model", "dataset_config", "timestamp", "total_questions",
    "correct", "incorrect", "accuracy", "total_cost_usd",
    "total_input_tokens", "total_output_tokens", "total_reasoning_tokens",
)

# Submission discovery: file-name patterns tried in order after results/.
SUBMISSION_PATTERNS = ("results*.json", "submission*.json", "output*.json")
OPEN_TASK_RESPONSES = "responses.json"

# ---------------------------------------------------------------------------
# Grading constants.
# ---------------------------------------------------------------------------
LETTERS = "ABCD"
MISSING_LABEL = "__missing__"
DOMAIN_ABSENT = "N/A"
DOMAIN_FALSY = "Unknown"
LABEL_PREFIXES_TO_DROP = ("罪名：", "[罪名]", "罪")
LABEL_SUFFIX_CHAR = "罪"
WORST_BEST_N = 10
FIRST_LABELS_N = 10
FEW_SHOT_CLASSES_N = 20
SAMPLE_TRAJECTORIES_N = 3
INSIGHTS_KEPT = 5
INSIGHTS_SHOWN = 3
INSIGHT_MIN_LEN = 20
ACCURACY_AXIS_FLOOR = 50.0

# ---------------------------------------------------------------------------
# Log-metric patterns, per metric, tried in order, first match.
# ---------------------------------------------------------------------------
LOG_METRIC_PATTERNS = {
    "accuracy": [
        # "final accuracy" and "test accuracy" hold this one, so it decides for them too
        r"accuracy[:\s=]+(\d+\.?\d*)\s*%?",
    ],
    "validation": [
        r"validation[:\s=]+(\d+\.?\d*)",
        r"val[:\s=]+(\d+\.?\d*)",
    ],
    "correct": [
        r"(\d+)\s*/\s*\d+\s+correct",
        r"correct[:\s=]+(\d+)",
    ],
    "total": [
        r"\d+\s*/\s*(\d+)\s+(?:questions|samples|total)",
    ],
}
BULLET_PATTERN = r"^[-*]\s+(.+)$"
NUMBERED_PATTERN = r"^\d+\.\s+(.+)$"
SOLUTION_PATTERN = r"solution\s*=\s*(.+?)(?:\n|$)"

# ---------------------------------------------------------------------------
# Reward shaping (weights mode).
# ---------------------------------------------------------------------------
FORMAT_REWARD_OK = 0.5
FORMAT_REWARD_BAD = -0.5
PER_TURN_PENALTY = -0.01
HALLUCINATION_PENALTY = -0.3
HALLUCINATION_WORD = "hallucinate"
FINAL_REWARD_CORRECT = 1.0
FINAL_REWARD_WRONG = 0.0
GROUP_SIZE = 8
BATCH_SIZE = 16
