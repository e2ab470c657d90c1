"""Tables of the lineage store: names, fixed schemas and vocabularies."""

from __future__ import annotations

SCHEMA_VERSION = 5
NORMALIZER_VERSION = 2

STATES = ("verbatim", "edited", "moved", "dead")
LAYERS = ("identical", "histogram_diff", "reflow", "within_hunk_alignment", "hunk_rewrite", "file_rewrite", "intra_file_move", "cross_file_move", "no_match")
ORIGINS = ("agent", "human", "agent_then_human_revised")
OBSERVERS = ("backfill", "reconcile")

#: Line features of one file version.
LINE = "number int, kind string, role string, content_tokens int, tokens array<long>, fingerprint long, unigrams array<long>, bigrams array<long>"

TABLES = {
    "meta": "key string, value string",
    "sessions": "session_id string, tool string, model string, started_at long",
    "commits": "sha string, authored_at long, committed_at long, is_merge boolean, observed_by string, agent_trailer string",
    "lines": "line_id long, file_path_hash string, birth_commit string, birth_ts long, birth_line_number int, birth_observed boolean, birth_bigrams array<long>, origin string, session_id string, model string, syntactic_role string, token_count int, last_seen_at long, last_seen_commit string",
    "fates": "seq long, line_id long, observed_at long, observed_commit string, previous_seen_at long, state string, similarity_score double, deciding_layer string, matched_candidate_id long, line_number int, file_path_hash string, birth_similarity double, before_first_commit boolean",
    "snapshots": "file_path_hash string, language string, normalizer_version long, observed_at long, content_id string",
    "snapshot_lines": "file_path_hash string, line_number int, line_id long, kind string, syntactic_role string, content_tokens int, fingerprint long, tokens array<long>, unigrams array<long>, bigrams array<long>",
    "parked_lines": "line_id long, file_path_hash string, line_number int, fingerprint long, parked_at long",
}

#: Payload of a write event; every field may be missing.
WRITE_EVENT = "session_id string, tool_name string, hook_event_name string, cwd string, tool_use_id string, tool_input struct<file_path:string, command:string>"
