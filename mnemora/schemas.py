"""Table schemas, enumerations and limits."""

from __future__ import annotations

# Enumerations in the order of their tags.
EXPERIENCE_TYPES = ["Difficulty", "Solution", "ErrorPattern", "SuccessPattern", "UserPreference", "ArchitecturalDecision", "TechInsight", "Fact", "Generic"]
RELATION_TYPES = ["Supports", "Contradicts", "Elaborates", "Supersedes", "Implies", "RelatedTo"]
INSIGHT_TYPES = ["Pattern", "Synthesis", "Abstraction", "Correlation"]
EVENT_TYPES = ["Created", "Updated", "Archived", "Deleted"]
ENTITY_TYPES = ["Experience", "Relation", "Insight", "Collective"]
DIRECTIONS = ["Outgoing", "Incoming", "Both"]

# Limits.
MAX_NAME_BYTES = 255
MAX_CONTENT_BYTES = 100 * 1024
MAX_TAGS, MAX_TAG_BYTES = 50, 100
MAX_FILES, MAX_FILE_BYTES = 100, 500
MAX_AGENT_BYTES, MAX_ACTIVITY_AGENT_BYTES = 256, 255
MAX_ACTIVITY_TEXT_BYTES = 1024
MAX_METADATA_BYTES = 10 * 1024
MAX_INSIGHT_BYTES, MAX_INSIGHT_SOURCES = 50 * 1024, 100
MAX_K = 1000
MAX_DIMENSION = 4096
MAX_COUNTER_BUCKETS = 65_536
U32_MAX = 4_294_967_295
SCHEMA_VERSION = 3
LEGACY_BUCKET = "00000000-0000-0000-0000-000000000000"
STALE_SECONDS = 300

COLLECTIVE = "id string, name string, owner_id string, embedding_dimension int, created_at_ms bigint, updated_at_ms bigint"
EXPERIENCE = "id string, collective_id string, content string, embedding array<float>, type_tag int, type_payload string, importance double, confidence double, applications map<string,bigint>, domain array<string>, related_files array<string>, source_agent string, source_task string, ts_ms bigint, last_reinforced_ms bigint, archived boolean"
RELATION = "id string, source_id string, target_id string, relation_type string, strength double, metadata string, created_at_ms bigint, collective_id string"
INSIGHT = "id string, collective_id string, content string, embedding array<float>, source_experience_ids array<string>, insight_type string, confidence double, domain array<string>, created_at_ms bigint, updated_at_ms bigint"
ACTIVITY = "agent_id string, collective_id string, current_task string, context_summary string, started_at_ms bigint, last_heartbeat_ms bigint"
DECAY = "collective_id string, half_life_s double, freq_weight double, floor double, w_similarity double, w_energy double"
CURSOR = "peer_id string, direction string, last_sequence bigint"
TABLES = {"Collective": COLLECTIVE, "Experience": EXPERIENCE, "Relation": RELATION, "Insight": INSIGHT, "Activity": ACTIVITY, "Decay": DECAY, "Cursor": CURSOR}


def column_of(kind: str) -> str:
    """The log's column with a kind's row."""
    return kind.lower()


def struct_of(kind: str) -> str:
    return TABLES[kind].replace(" ", ":").replace(",:", ",")


def names_of(kind: str) -> list[str]:
    return [c.split()[0] for c in TABLES[kind].split(", ")]


def state_of(kind: str) -> str:
    """A kind's state; _collective is its partition."""
    return f"entity_id string, {TABLES[kind]}, _collective string"


LOG_HEAD = ["seq bigint", "entity_type string", "event_type string", "entity_id string", "collective_id string", "ts_ms bigint", "origin string", "visible boolean"]
LOG = ", ".join([*LOG_HEAD, *[f"{column_of(k)} struct<{struct_of(k)}>" for k in TABLES]])
