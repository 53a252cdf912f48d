"""Schemas of the tables that operators exchange."""

PAGE = "file string, page_num int, text string, tables array<string>, page_kind string, rotation int"
CHUNK = (
    "id string, text string, file string, page int, chunk_type string, section_path string, revision string, drawing_refs array<string>, "
    "clause_refs array<string>, question_no string, caption string, bbox struct<x0:double,y0:double,x1:double,y1:double>"
)
EVAL_CASE = "id string, question string, expected_sources array<struct<file:string,page_min:int,page_max:int>>, expected_keywords array<string>, category string, expected_answer string"
CHECKPOINT = "file string, page int, status string, error_msg string, cost_usd double"
PROVENANCE = "content_hash string, provider string, assigned_at string, task_kind string, redaction_applied boolean, notes string"
SIGNAL = "page_num int, boxes int, box_coverage double, dark_ratio double"
MAPPING = "entity_type string, entity_text string, idx int"
