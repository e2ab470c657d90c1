"""Thresholds and patterns that results depend on."""

from __future__ import annotations

MAX_TRACKED_FILE_BYTES = 1_048_576
FILE_RENAME_MIN_JACCARD = 0.5
HISTOGRAM_MAX_OCCURRENCES = 64
WEAK_ANCHOR_MAX_CONTENT_TOKENS = 2
REFLOW_MAX_GROUP_LINES = 20
PREFILTER_MIN_UNIGRAM_JACCARD = 0.2
EDIT_MIN_DICE = 0.5
HUNK_FULL_ALIGNMENT_MAX_CELLS = 250_000
HUNK_ALIGNMENT_BAND_LINES = 100
REWRITE_MAX_RETENTION = 0.4
MIN_MOVE_BLOCK_LINES = 3
MIN_MOVE_BLOCK_CONTENT_TOKENS = 8
SINGLE_LINE_MOVE_MIN_CONTENT_TOKENS = 2
MOVE_SEED_MAX_CANDIDATES = 64

#: The store's own folder, which is never tracked.
STORE_FOLDER = ".linefate"

# fixed values: paths of generated files, and the languages of file name endings
GENERATED_PATH_PATTERNS = (
    "**/vendor/**",
    "**/third_party/**",
    "**/node_modules/**",
    "**/target/**",
    "**/dist/**",
    "**/build/**",
    "**/__generated__/**",
    "**/*.generated.*",
    "**/*.min.js",
    "**/*_pb2.py",
    "**/*_pb2_grpc.py",
    f"{STORE_FOLDER}/**",
)
LANGUAGES = {"rs": "rust", "py": "python", "ts": "typescript", "mts": "typescript", "cts": "typescript", "tsx": "tsx", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript"}

# report
REPORT_AGES = (1.0, 7.0, 30.0, 90.0)
SWEEP_THRESHOLDS = (0.3, 0.4, 0.5, 0.6, 0.7)
MOST_GROUPS = 8
KNOWN_ALIVE = 10
BAND_POINTS = 41
LEVEL = 0.95
CLOCK_TOLERANCE = 3600
DAY = 86_400.0
#: How much earlier than its right end a death known to the second is placed, in days.
INSTANT = 1e-3 / DAY
