"""Golden rows of the scalar functions."""

import pytest
from pyspark.sql import functions as F

from folioflow.functions import dates, text
from folioflow.operators.frontmatter import parsed, yaml_text


def column(spark, values, f, ddl="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {ddl}").select("i", f(F.col("v")).alias("r")).orderBy("i").collect()
    return [r["r"] for r in rows]


def test_dates_in_text(spark):
    cases = {
        "Exame 2024-03-05": ["2024-03-05"], "5/3/2024": ["2024-03-05"], "05-03/2024": ["2024-03-05"], "10/12/2023 e 2024-01-02": ["2024-01-02", "2023-12-10"],
        "12/31/2024": [], "2024-13-01": [], "01/01/1899": [], "01/01/2101": [], "": [], "31/02/2024": ["2024-02-31"], "2024-01-02T10:00": [], "é01/02/2024": [],
        "2024-01-02-2020": ["2024-01-02", "2020-02-01"], "01/02/2024 01/02/2024": ["2024-02-01", "2024-02-01"],
    }
    assert column(spark, list(cases), dates.dates_in_text) == list(cases.values())
    assert column(spark, [None], dates.dates_in_text) == [[]]


def test_filename_date(spark):
    cases = {
        "exam_2024-05-06.pdf": "2024-05-06", "2024_05_06.pdf": "2024-05-06", "x20240506.pdf": "2024-05-06", "20240506_2023-01-02.pdf": "2023-01-02",
        "scan_123456789.pdf": "1234-56-78", "99999999.pdf": "9999-99-99", "a_2024-1-2.pdf": None, "x.pdf": None,
    }
    assert column(spark, list(cases), dates.filename_date) == list(cases.values())


def test_normalize_date(spark):
    assert column(spark, ["0000-00-00", "", None, "on 5/3/2024", "none"], dates.normalize_date) == [None, None, None, "2024-03-05", None]


def test_strip_fences(spark):
    cases = {"```json\n{}\n```": "{}", "```x```": "", "plain ```": "plain ```", "```\na": "a", "```\na\n ``` ": "a", " ```\na": " ```\na", "```": ""}
    assert column(spark, list(cases), text.strip_fences) == list(cases.values())


def test_json(spark):
    assert column(spark, ['{"k": 1}', "```\n{\"k\": 2}\n```", "{", ""], lambda c: text.lenient_json(c, "k int").getField("k")) == [1, 2, None, None]
    assert column(spark, ['{"transcription": "a"}', '{"x": 1}', "{bad", " t "], text.unwrap_json) == ["a", '{"x": 1}', "{bad", "t"]


def test_confidence(spark):
    assert column(spark, ["0.7", "-1", "7", "n/a", "NaN", None], text.confidence) == [0.7, 0.0, 1.0, 0.5, 1.0, 0.5]


def test_names_and_files(spark):
    assert column(spark, ["  X-Ray\x1c", "A"], text.cache_key) == ["x-ray", "a"]
    assert column(spark, ["d.007.md", "d.1000.md", "d.x.md", "d.md"], text.page_number) == [7, 1000, None, None]
    assert column(spark, [7, 1000], lambda c: text.page_file(F.lit("d"), c), "int") == ["d.007.md", "d.1000.md"]
    assert column(spark, ["abcd", "abc", "ééééé"], text.token_estimate) == [1, 0, 1]
    assert column(spark, ["x" * 100], lambda c: text.data_url(F.encode(c, "utf-8")))[0].count("\n") == 0
    assert column(spark, ["a.b.pdf", "plain", ".hidden"], text.file_stem) == ["a.b", "plain", ".hidden"]


def test_image_size(spark):
    rows = spark.createDataFrame([(2000, 1000), (999, 10), (1500, 3001)], "w int, h int").select(text.image_size(F.col("w"), F.col("h")).alias("s")).collect()
    assert [tuple(r["s"]) for r in rows] == [(1000, 500), (999, 10), (499, 999)]


def test_frontmatter(spark):
    files = ["---\ntitle: A\n---\n\nbody\n", "---\nx", "no", "---\ntitle: X--- y\n---\nb", "---\n: : bad\n---\nb", "---\n- a\n---\nb", "---\nexam_date: 2024-01-02\npage: 3\n---\nb"]
    rows = parsed(spark.createDataFrame([(i, f) for i, f in enumerate(files)], "i int, content string")).orderBy("i").collect()
    assert [r["body"] for r in rows] == ["body", "---\nx", "no", "y\n---\nb", "b", "b", "b"]
    assert [r["header"]["title"] for r in rows] == ["A", None, None, "X", None, None, None]
    assert (rows[6]["header"]["exam_date"], rows[6]["header"]["page"]) == ("2024-01-02", 3)


def test_yaml():
    assert yaml_text({"exam_date": "2024-01-02", "title": "Ecoé", "page": 1, "confidence": None}) == "exam_date: '2024-01-02'\ntitle: Ecoé\npage: 1\n"
    assert yaml_text({"a": None}) == ""


@pytest.mark.parametrize("value, fields", [("a {b} c", {"b": "x"}), ("{b}{b}", {"b": "{b}"})])
def test_template(spark, value, fields):
    got = spark.range(1).select(text.template(value, **{k: F.lit(v) for k, v in fields.items()}).alias("t")).first()["t"]
    assert got == value.replace("{b}", fields["b"])
