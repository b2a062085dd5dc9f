"""Row types, as DDL, and small dimensions of the store. Times are timestamps, vectors float arrays."""

from __future__ import annotations

# The columns of the data model's tables.
FACTS = (
    "id long, fact_hash string, full_key string, category string, importance int, valid_from timestamp, valid_to timestamp, superseded_by long, session_id string, source string,"
    "aliases array<string>, embedding array<float>, created_at timestamp, last_seen_at timestamp, seen_count long"
)
RELATIONS = "from_id long, to_id long, kind string, weight double"
SESSIONS_DONE = "session_id string, summarized_at timestamp"
STATE = "key string, value string, updated_at timestamp"
AUDIT = "id long, event_type string, details string, created_at timestamp"
MISTAKES = "id long, description string, category string, severity string, context string, fix string, fix_verified boolean, created_at timestamp, session_id string, tags array<string>, related_fact_id long, recurrence_count long"
ARCHIVE = "id string, original_content string, compressed_content string, compression_timestamp timestamp, source_ids array<long>, category string"
SESSIONS = "id string, source string, started_at timestamp, ended_at timestamp, message_count long, title string"
MESSAGES = "id long, session_id string, role string, content string, timestamp timestamp"
ENTITIES = "entity_id long, name string, entity_type string, aliases array<string>"
FACT_ENTITIES = "fact_id long, entity_id long"
NODES = "node string, content string, type string, category string, importance int, trust double, embedding array<float>, aliases array<string>, metadata map<string,string>"
EDGES = "src string, dst string, weight double, type string"
CHUNKS = "doc_id string, chunk_no int, text string, metadata map<string,string>"
JSONL_FACT = "key string, category string, session_id string, extracted_at string, importance int, source string"
SUMMARY = "summary array<string>, facts array<struct<key: string, category: string>>, language string, importance int, session_id string, summarized_at string"
HIT = "similarity double, content string, type string, project string, expanded boolean, timestamp timestamp, agent_id string"

#: The tables that the store keeps itself.
TABLES = ("FACTS", "RELATIONS", "SESSIONS_DONE", "STATE", "AUDIT", "MISTAKES", "ARCHIVE")

# The enumerations of the data model.
FACT_CATEGORIES = ["preference", "fact", "decision", "correction", "project", "technical", "personal", "service", "general"]
MISTAKE_CATEGORIES = ["syntax", "logic", "config", "api", "security", "performance", "data", "deployment", "communication", "other"]
SEVERITIES = ["low", "medium", "high", "critical"]
RELATION_KINDS = ["causes", "fixes", "supports", "contradicts", "related"]
SYMMETRIC_KINDS = ["contradicts", "related"]
