"""Explicit schemas of every table; JSON and CSV are never inferred."""

from pyspark.sql import types as T

RAW_LINE = "source_file string, line_no int, text string, page int, top double, bottom double, height double, bold boolean, size double"
CLAUSE = (
    "source_file string, clause_id int, text string, section_header string, inline_label string, page int, position string, party_refs array<string>, "
    "token_count int, is_subpart boolean, is_decimal_section boolean, subpart_label string, parent_clause_id int, parent_clause_header string"
)
SUMMARY = "total_pdfs int, total_clauses int, per_file array<struct<file:string,pages:int,clauses:int>>"
PARTY = "struct<risk:string,explanation:string,trigger_quote:string,evidence_quote:string>"
ANNOTATION = f"clause_index int, clause_text string, status string, parties map<string,{PARTY}>, raw_response string, error string"
EXAMPLE = "text string, _meta struct<clause_index:int,party:string,risk:string,source:string>"
CONTRACT_CSV = "clause_text string, clause_type string, risk_level string"
PREDICTION = "clause_index int, party string, clause string, ground_truth string, predicted string, raw_output string, correct boolean, gt_explanation string"
PARSE_FAILURE = "clause_index int, raw_output string, clause string"
CHUNK = (
    "chunk_id string, raw_clause string, licensor_risk string, licensee_risk string, licensor_explanation string, licensee_explanation string, "
    "clause_index int, enriched_text string, embedding array<float>"
)
ANALYSIS_RESULT = "session_id string, clause_index int, clause_text string, role string, model_output string"
CHAT_TURN = "session_id string, turn int, role string, content string"


def struct(ddl: str) -> T.StructType:
    return T._parse_datatype_string(ddl)
