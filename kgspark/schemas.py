"""Column types of the tables (DDL strings, usable wherever Spark takes a schema)."""

TRIPLES = "s string, p string, o string, o_kind string, g string, src string"
MENTIONS = (
    "mention_id bigint, doc_id bigint, text string, entity_type string, confidence double, "
    "normalized_form string, context string, source string, source_model string, "
    "created_at timestamp"
)
CHUNKS = "doc_id bigint, chunk_index int, start_char int, end_char int, text string"
MATCHES = "array<struct<kg_uri:string,kg_label:string,kg_type:string,similarity_score:double>>"
BINDINGS = (
    "head struct<vars:array<string>>, boolean boolean, "
    "results struct<bindings:array<map<string,struct<type:string,value:string>>>>"
)
PENDING_ENTITIES = (
    "id bigint, text string, entity_type string, normalized_text string, "
    "similarity_score double, matched_kg_label string, matched_kg_uri string, "
    "validation_status string, source string, source_model string, confidence double, "
    "context string, status string, created_at timestamp, updated_at timestamp"
)
PENDING_RELATIONS = (
    "id bigint, source_entity string, source_type string, relation_type string, "
    "target_entity string, target_type string, confidence double, context string, "
    "source string, source_model string, status string, created_at timestamp, "
    "updated_at timestamp"
)
