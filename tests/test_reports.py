"""Reports are whole, or say what they lack."""

from lodesift.operators import register
from lodesift.sources.files import markdown_report


def test_reports_are_whole_or_say_what_is_left_out(spark):
    df = spark.range(6_000).selectExpr("CAST(6000 - id AS INT) AS n", "IF(id % 2 = 0, 'a', 'b') AS g")
    assert markdown_report(df).count("\n") == 6_002
    got = markdown_report(df, "g", 2)
    assert "| 2 |" in got and "| 4 |" in got and "5998 more rows are left out." in got and "## b" not in got
    rows = spark.range(5_100).selectExpr("format_string('X-%05d', id) AS id", "'high' AS severity", "'low' AS confidence", "'open' AS status", "'t' AS title")
    assert register.summary_report(rows, "id").count("X-05099") == 2
    assert register.summary_report(rows, "id", 10).count("5090 more rows are left out.") == 2
