"""Text functions: stripping, fences, JSON replies, names, renders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioflow.schemas import CACHE_JSON

FENCE = "```"


def py_strip(c: Column) -> Column:
    """Without white space at either end, as Unicode and ASCII separators define it."""
    return F.regexp_replace(c, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def present(c: Column) -> Column:
    """The value, or null where it is an empty string."""
    return F.nullif(c, F.lit(""))


def strip_fences(c: Column) -> Column:
    """A text that starts with a code fence loses its first line, a closing fence line, and outer white space."""
    rest = F.slice(F.split(c, "\n"), 2, F.greatest(F.size(F.split(c, "\n")) - 1, F.lit(0)))
    last = F.get(rest, F.size(rest) - 1)
    closed = F.coalesce(py_strip(last) == FENCE, F.lit(False))
    body = F.when(closed, F.slice(rest, 1, F.greatest(F.size(rest) - 1, F.lit(0)))).otherwise(rest)
    return F.when(c.startswith(FENCE), py_strip(F.array_join(body, "\n"))).otherwise(c)


def lenient_json(c: Column, schema: str) -> Column:
    """A JSON reply, fenced or not, read by a schema; null where it does not parse."""
    plain = strip_fences(c)
    return F.when(F.try_parse_json(plain).isNotNull(), F.from_json(plain, schema))


def unwrap_json(c: Column) -> Column:
    """The transcription held by a JSON object, else the text itself without fences."""
    plain = strip_fences(py_strip(c))
    return F.when(plain.startswith("{"), F.coalesce(F.get_json_object(plain, "$.transcription"), plain)).otherwise(plain)


def cache_key(name: Column) -> Column:
    return py_strip(F.lower(name))


def cache_entries(json: Column) -> Column:
    """A name cache document as a map; a missing or broken one is empty."""
    return F.coalesce(F.from_json(json, CACHE_JSON), F.from_json(F.lit("{}"), CACHE_JSON))


def token_estimate(c: Column) -> Column:
    """A quarter of the code points, rounded down."""
    return F.floor(F.length(c) / 4)


def confidence(reply: Column) -> Column:
    """A number between 0 and 1; 0.5 for what is none."""
    number = reply.try_cast("double")  # greatest and least pass over nulls
    return F.when(number.isNull(), F.lit(0.5)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), number)))


def is_blank(c: Column) -> Column:
    return F.coalesce(py_strip(c), F.lit("")) == ""


def too_short(c: Column, least: int = 20) -> Column:
    """The part of the refusal check that needs no model."""
    return F.length(py_strip(F.coalesce(c, F.lit("")))) < least


def display_name(standardized: Column, raw: Column) -> Column:
    return F.coalesce(present(standardized), raw)


def exam_list_row(i: Column, name: Column, kind: Column, date: Column) -> Column:
    return F.concat(i.cast("string"), F.lit(". "), name, F.lit(" ["), kind, F.lit("]"), F.when(present(date).isNotNull(), F.concat(F.lit(" ("), date, F.lit(")"))).otherwise(""))


def transcription_row(i: Column, name: Column, page: Column, text: Column) -> Column:
    head = F.concat(F.lit("--- EXAM "), i.cast("string"), F.lit(": "), name, F.lit(" (Page "), page.cast("string"), F.lit(") ---\n"))
    return F.concat(head, py_strip(F.coalesce(text, F.lit(""))))


def page_file(stem: Column, page: Column, suffix: str = "md") -> Column:
    """stem.NNN.suffix; larger numbers keep all their digits."""
    return F.concat(stem, F.lit("."), F.format_string("%03d", page), F.lit("." + suffix))


def page_number(file_name: Column) -> Column:
    """The number in the last dotted part before the suffix, null where there is none."""
    stem = F.regexp_replace(file_name, r"\.[^.]*$", "")
    return F.element_at(F.split(stem, r"\."), -1).try_cast("int")


def file_stem(file_name: Column) -> Column:
    """Without the last suffix; a leading dot starts no suffix."""
    return F.regexp_replace(file_name, r"(?<=[^/])\.[^.]*$", "")


def without_pdf(query: Column) -> Column:
    return F.regexp_replace(F.lower(query), r"\.pdf$", "")


def data_url(image: Column, kind: str = "image/jpeg") -> Column:
    """Base64 data URL on one line, whatever the session's chunking."""
    return F.concat(F.lit(f"data:{kind};base64,"), F.regexp_replace(F.base64(image), r"\s", ""))


def template(text: str, /, **values: Column) -> Column:
    """A template with {name} slots filled by columns."""
    out = F.lit(text)
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), value)
    return out


def frontmatter_split(content: Column) -> Column:
    """Struct of header and body. The header ends at the next three dashes anywhere; without them all of it is body."""
    text = py_strip(content)
    end = F.locate("---", text, 4)
    has = text.startswith("---") & (end > 0)
    return F.struct(
        F.when(has, py_strip(text.substr(F.lit(4), end - 4))).otherwise("").alias("header"),
        F.when(has, py_strip(text.substr(end + 3, F.length(text)))).otherwise(text).alias("body"),
    )


def page_body(texts: Column) -> Column:
    """Texts of a page joined by a blank line, stripped, with a closing line end."""
    return F.concat(py_strip(F.array_join(texts, "\n\n")), F.lit("\n"))


def image_size(width: Column, height: Column, most: int = 1000) -> Column:
    """Struct of the size to which a page shrinks: long side ``most`` at the most, fractions cut off."""
    ratio = F.lit(float(most)) / F.greatest(width, height)
    small = F.greatest(width, height) <= most
    return F.struct(
        F.when(small, width).otherwise((width * ratio).cast("int")).cast("int").alias("width"),
        F.when(small, height).otherwise((height * ratio).cast("int")).cast("int").alias("height"),
    )
