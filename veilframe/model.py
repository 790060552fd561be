"""Schemas of every table; none is ever inferred."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


S, I, L, D, B = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType(), T.BooleanType()  # noqa: E741
BBOX = _struct(x0=D, y0=D, x1=D, y1=D)
PAGES = _struct(doc_id=L, page_num=I, width=D, height=D, has_images=B)
SPANS = _struct(doc_id=L, page_num=I, ord=I, text=S, bbox=BBOX, block_type=I)
DETECTIONS = _struct(doc_id=L, page_num=I, ord=I, text=S, entity_type=S, score=D, bbox=BBOX, preserve_last=I, detector=S, start=I, size=I)
OCR_RAW = _struct(doc_id=L, page_num=I, ord=I, text=S, conf=S, left=D, top=D, width=D, height=D)
OCR_WORDS = _struct(doc_id=L, page_num=I, ord=I, text=S, conf=I, bbox=BBOX)
RESULTS = _struct(doc_id=L, input=S, output=S, detections=L, safety_passes=I, verification_passed=B, survivors=L)
FAILURES = _struct(doc_id=L, path=S, category=S, message=S, mitigation=S)
AUDIT = _struct(
    id=L, file_hash=S, original_filename=S, output_filename=S, processed_at=T.TimestampType(), profile_name=S, subject_id=S, pages_processed=L,
    items_detected=L, items_redacted=L, verification_passed=B, verification_survivors_json=S, duration_ms=L, notes=S,
)
SUBJECTS = _struct(id=S, display_name=S, created_at=T.TimestampType(), last_used_at=T.TimestampType(), document_count=L)
ACCOUNT = _struct(value=S, preserve_last=I)
PATTERN = _struct(name=S, regex=S)
SUBJECT = _struct(
    display_name=S, aliases=T.ArrayType(S), addresses=T.ArrayType(S), phones=T.ArrayType(S), emails=T.ArrayType(S), ssns=T.ArrayType(S),
    account_numbers=T.ArrayType(ACCOUNT), custom_patterns=T.ArrayType(PATTERN),
)
SETTINGS = _struct(
    use_presidio=B, presidio_entities=T.ArrayType(S), fuzzy_match=B, match_threshold=D, full_token_min_length=I, ocr_fallback=B, column_aware=B, scan_figures=B,
    address_line_bridge_window=I,
)
PROFILE = _struct(version=I, name=S, subject=SUBJECT, detection=SETTINGS)
VAULT_ENTRY = _struct(display_name=S, created_at=S, updated_at=S, profile_json=S, notes=S)
VAULT = _struct(version=I, profiles=T.MapType(S, VAULT_ENTRY))

PAGE_WIDTH, PAGE_HEIGHT = 612.0, 792.0
