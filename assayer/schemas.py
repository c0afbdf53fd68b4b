"""Explicit schemas of the assessment tables; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T

S, L, I, B, D = T.StringType(), T.LongType(), T.IntegerType(), T.BooleanType(), T.DoubleType()  # noqa: E741
TS = T.TimestampType()


def _table(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in columns.items()])


TABLES = {
    "tenants": _table(id=S, name=S, country_code=S, data_region=S, retention_days=I, ai_monthly_cap_usd=T.DecimalType(10, 2), created_at=TS),
    "users": _table(id=S, tenant_id=S, email=S, password_hash=S, role=S, status=S, failed_logins=I, locked_until=TS, created_at=TS),
    "courses": _table(id=S, tenant_id=S, code=S, title=S, academic_year=S, owner_id=S, created_at=TS),
    "exams": _table(id=S, tenant_id=S, course_id=S, code=S, title=S, total_marks=T.DecimalType(6, 2), status=S, anonymous_marking=B, created_at=TS),
    "questions": _table(id=S, tenant_id=S, exam_id=S, number=S, prompt_text=S, max_marks=T.DecimalType(5, 2), answer_type=S, position=I, answer_height_mm=I, created_at=TS),
    "booklets": _table(id=S, tenant_id=S, exam_id=S, page_count=I, qr_payload=S, layout_version=S, created_at=TS),
    "enrolments": _table(id=S, tenant_id=S, exam_id=S, index_number=S, display_name=S, created_at=TS),
    "student_identity_map": _table(id=S, tenant_id=S, booklet_id=S, index_number_enc=T.BinaryType(), enrolment_id=S, confirmed_by=S, confirmed_at=TS, ocr_confidence=T.DecimalType(4, 3), ocr_suggestion=S, revealed_at=TS, revealed_by=S, created_at=TS),
    "audit_log": _table(id=L, tenant_id=S, actor_id=S, action=S, entity_type=S, entity_id=S, before=S, after=S, reason=S, ip=S, user_agent=S, at=TS, prev_hash=S, row_hash=S),
}
#: Unique keys and foreign keys (column, table), for the constraint checks.
UNIQUE = {"users": ("tenant_id", "email"), "courses": ("tenant_id", "code", "academic_year"), "questions": ("exam_id", "number"), "booklets": ("qr_payload",), "enrolments": ("exam_id", "index_number"), "student_identity_map": ("booklet_id",), "audit_log": ("row_hash",)}
FOREIGN = {"exams": {"course_id": "courses"}, "questions": {"exam_id": "exams"}, "booklets": {"exam_id": "exams"}, "enrolments": {"exam_id": "exams"}, "student_identity_map": {"booklet_id": "booklets", "confirmed_by": "users"}}
#: Tables under the tenant policy; ``tenants`` is scoped on its own id.
SCOPED = {"tenants": "id"} | dict.fromkeys(("users", "courses", "audit_log", "exams", "questions", "booklets", "enrolments", "student_identity_map"), "tenant_id")

TRANSCRIPTION = _table(booklet_id=S, page_no=I, line_index=I, text=S, question_number=S, illegible=B)
MARK = _table(booklet_id=S, question_number=S, max_marks=D, marker_a=D, marker_b=D, adjudicated=D)
BOX = _table(x=I, y=I, w=I, h=I)
WORD = _table(text=S, confidence=D, bbox=BOX)
LINE = _table(line_index=I, text=S, confidence=D, bbox=BOX, source=S, question_number=S, flags=T.ArrayType(S), words=T.ArrayType(WORD))
PAGE = _table(page_id=S, page_confidence=D, cost_usd=D, providers=T.ArrayType(S), from_cache=B, lines=T.ArrayType(LINE))
