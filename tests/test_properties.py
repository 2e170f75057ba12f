"""Property tests: field splitting agrees with the line-oriented jobs' rule
(split on the separator, trailing empty fields dropped)."""

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from wardstat.functions import scalars as S

FIELD = st.text(alphabet="ab1 -|", max_size=4)
LINE = st.lists(FIELD, min_size=0, max_size=8).map(",".join)


def java_split(line: str) -> list[str]:
    """The line-oriented jobs' rule: split on ',' and drop all trailing empty
    strings; only the empty line itself yields one empty field."""
    parts = line.split(",")
    while line and parts and parts[-1] == "":
        parts.pop()
    return parts


@settings(max_examples=8, deadline=None)
@given(st.lists(LINE, min_size=1, max_size=40))
def test_split_fields_matches_line_rule(spark, lines):
    df = spark.createDataFrame([(i, ln) for i, ln in enumerate(lines)], "i int, value string")
    got = {r.i: r.f for r in df.select("i", S.split_fields("value").alias("f")).collect()}
    for i, ln in enumerate(lines):
        assert got[i] == java_split(ln), (ln, got[i])


@settings(max_examples=5, deadline=None)
@given(st.lists(st.sampled_from(["Yes", "YES", "yes", "No", "", None, "yEs"]), min_size=1, max_size=30))
def test_flags_match_python(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "r string")
    row = df.agg(F.sum(S.flag("r")).alias("exact"), F.sum(S.flag("r", "Yes", True)).alias("ci")).first()
    assert row.exact == sum(v == "Yes" for v in values)
    assert row.ci == sum(v is not None and v.lower() == "yes" for v in values)


def test_header_lines_are_known_quoted_and_with_a_mark(spark):
    from wardstat.sources import files as FS
    rest = "," + ",".join(["x"] * 9)
    lines = spark.createDataFrame([(h + rest,) for h in ["patient_id", '"patient_id"', "\ufeffpatient_id", "patient_idx", "P1"]], "value string")
    assert sorted(r.patient_id for r in FS.parse_lines(lines).collect()) == ["P1", "patient_idx"]
