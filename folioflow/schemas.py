"""Schemas of the tables that pass between stages."""

from __future__ import annotations

from pyspark.sql import types as T

#: One row per source document; content stays with the renderer.
MANIFEST = "path string, file_name string, doc_stem string"
PAGE_IMAGE = "doc_stem string, page_number int, image binary"
CLASSIFICATION = "doc_stem string, is_exam boolean, exam_name_raw string, exam_date string, facility_name string, physician_name string, department string"
SAMPLE = "doc_stem string, page_number int, sample_idx int, text string"
TRANSCRIPT = "doc_stem string, page_number int, transcription string, transcription_confidence double, prompt_variant string, retry_attempts int"
RECORD = (
    "doc_stem string, source_file string, page_number int, exam_name_raw string, exam_date string, transcription string, "
    "transcription_confidence double, prompt_variant string, retry_attempts int, physician_name string, department string, "
    "facility_name string, exam_type string, exam_name_standardized string"
)
NAME_CACHE = "cache_key string, exam_type string, standardized_name string"
CACHE_JSON = "map<string,struct<exam_type:string,standardized_name:string>>"
STATUS = "doc_stem string, status string, pages int"

#: Record field and frontmatter key, in the order in which they are written.
FRONTMATTER_KEYS = (
    ("exam_date", "exam_date"),
    ("exam_name_raw", "exam_name_raw"),
    ("exam_name_standardized", "title"),
    ("exam_type", "category"),
    ("physician_name", "doctor"),
    ("facility_name", "facility"),
    ("department", "department"),
)
EXTRA_KEYS = (("page_number", "page"), ("source_file", "source"), ("prompt_variant", "prompt_variant"), ("transcription_confidence", "confidence"), ("retry_attempts", "retry_attempts"))
REQUIRED_KEYS = ("category", "exam_date", "title")
CATEGORIES = ("imaging", "ultrasound", "endoscopy", "prescription", "appointment", "other")


def struct(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)
