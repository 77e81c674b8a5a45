"""Frontmatter: records to ordered headers and back."""

from __future__ import annotations

import pandas as pd
import yaml
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.functions.text import frontmatter_split, page_body, present
from folioflow.schemas import FRONTMATTER_KEYS

HEADER = "exam_date string, exam_name_raw string, title string, category string, doctor string, facility string, department string, page int, source string, prompt_variant string, confidence double, retry_attempts int"


def to_frontmatter(extras: bool = True) -> Column:
    """Struct in writing order; a missing value, or an empty one, is null and is not written."""
    fields = [present(F.col(field)).alias(key) for field, key in FRONTMATTER_KEYS]
    if extras:
        fields += [
            F.nullif(F.col("page_number"), F.lit(0)).alias("page"),
            present(F.col("source_file")).alias("source"),
            present(F.col("prompt_variant")).alias("prompt_variant"),
            F.col("transcription_confidence").alias("confidence"),
            F.when(F.col("retry_attempts") > 1, F.col("retry_attempts")).alias("retry_attempts"),
        ]
    return F.struct(*fields)


def from_frontmatter(header: Column, body: Column, page: Column, source: Column) -> list[Column]:
    """Record columns of a parsed header; prompt_variant and retry_attempts do not come back."""
    out = [header[key].alias(field) for field, key in FRONTMATTER_KEYS]
    return [
        *out,
        header["confidence"].cast("double").alias("transcription_confidence"),
        body.alias("transcription"),
        F.coalesce(F.nullif(header["page"], F.lit(0)), page).cast("int").alias("page_number"),
        F.coalesce(present(header["source"]), source).alias("source_file"),
    ]


def yaml_text(values: dict) -> str:
    """Block style in the given order, without missing values; empty for none."""
    kept = {k: v for k, v in values.items() if v is not None and not (isinstance(v, float) and pd.isna(v))}
    return yaml.dump(kept, default_flow_style=False, allow_unicode=True, sort_keys=False) if kept else ""


def render_yaml(header_json: Column) -> Column:
    """YAML of a header given as JSON, in Python workers by Arrow batches."""

    @F.pandas_udf("string")
    def render(batch: pd.Series) -> pd.Series:
        import json

        return batch.map(lambda x: yaml_text(json.loads(x)) if x else "")

    return render(header_json)


def markdown(header: Column, texts: Column) -> Column:
    """A whole page file: header between dashes, a blank line, the body. Without header values the body alone."""
    written = render_yaml(F.to_json(header))
    return F.when(written == "", page_body(texts)).otherwise(F.concat(F.lit("---\n"), written, F.lit("---\n\n"), page_body(texts)))


def parse_yaml(header: Column) -> Column:
    """Struct of a YAML header, in Python workers; all null where it is no mapping or does not parse. Dates come back as text."""

    @F.pandas_udf(HEADER)
    def parse(batch: pd.Series) -> pd.DataFrame:
        names = [part.split()[0] for part in HEADER.split(", ")]
        rows = []
        for text in batch:
            try:
                found = yaml.safe_load(text or "")
            except yaml.YAMLError:
                found = None
            found = found if isinstance(found, dict) else {}
            row = {n: found.get(n) for n in names}
            for n in names:
                if n in ("page", "retry_attempts"):
                    row[n] = int(row[n]) if isinstance(row[n], int) or str(row[n]).isdigit() else None
                elif n == "confidence":
                    row[n] = float(row[n]) if isinstance(row[n], (int, float)) else None
                else:
                    row[n] = None if row[n] is None else str(row[n])
            rows.append(row)
        return pd.DataFrame({n: pd.Series([r[n] for r in rows], dtype=object) for n in names})

    return parse(header)


def parsed(files: DataFrame, content_col: str = "content") -> DataFrame:
    """``files`` with header (struct), header_text and body."""
    split = files.withColumn("__split", frontmatter_split(F.col(content_col)))
    return split.withColumns({"header_text": F.col("__split.header"), "body": F.col("__split.body"), "header": parse_yaml(F.col("__split.header"))}).drop("__split")
