from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import types as T

from tallyhouse.sources import csv_export, sinks
from tallyhouse.sources.csv_export import WideRowError, append_export, read_export_csv, scan_export

COLUMNS = ["Client ID", "Visit Date", "note"]
SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in COLUMNS])


def put(path, text):
    path.write_text(text, newline="")
    return str(path)


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_fields(spark, tmp_path):
    text = 'a,"x ""q"" y",c\r\n1,"multi\nline",\nshort\nq,\n,,\n\n  ,,\na,m"id"dle, sp \nlast,"un,closed",3'
    assert rows(read_export_csv(spark, put(tmp_path / "a.csv", text), SCHEMA)) == [
        ("a", 'x "q" y', "c"),
        ("1", "multi\nline", ""),
        ("short", None, None),
        ("q", "", None),
        ("  ", "", ""),
        ("a", 'm"id"dle', " sp "),
        ("last", "un,closed", "3"),
    ]


@pytest.mark.parametrize("end", ["\n", "\r\n"])
@pytest.mark.parametrize("multi_line", [True, False])
def test_line_ends(spark, tmp_path, end, multi_line):
    path = put(tmp_path / "a.csv", end.join(['1,2,"3"', "short", "", ",,", "q,", 'a,b\rc,"d"', ""]))
    assert rows(read_export_csv(spark, path, COLUMNS, multi_line=multi_line)) == [
        ("1", "2", "3"),
        ("short", None, None),
        ("q", "", None),
        ("a", "b\rc", "d"),
    ]


def test_header_is_skipped_by_position(spark, tmp_path):
    path = put(tmp_path / "a.csv", "other,names,here\n1,2,3\n")
    assert rows(read_export_csv(spark, path, COLUMNS, has_header=True)) == [("1", "2", "3")]
    assert len(rows(read_export_csv(spark, path, COLUMNS))) == 2
    assert rows(read_export_csv(spark, path, COLUMNS, has_header=True, multi_line=False)) == [("1", "2", "3")]


@pytest.mark.parametrize("multi_line", [True, False])
def test_widths(spark, tmp_path, multi_line):
    path = put(tmp_path / "a.csv", '1,2,3,4\n,,,\n,,,x\n"a,b","c""d,","e",f\n"a,b",2,3\n"","","",""\n1\n')
    got = [r["_width"] for r in scan_export(spark, path, COLUMNS, multi_line=multi_line).collect()]
    assert got == [4, 4, 4, 3, 1]


@pytest.fixture
def target(spark):
    spark.sql("DROP TABLE IF EXISTS visits_export")
    spark.sql("CREATE TABLE visits_export (id BIGINT, `Client ID` STRING, `Visit Date` STRING, note STRING) USING parquet")
    yield "visits_export"
    spark.sql("DROP TABLE visits_export")


def test_append(spark, tmp_path, target):
    path = put(tmp_path / "a.csv", "1,2024-01-01,x\n2\n,,\n")
    for _ in range(2):
        result = append_export(spark, path, target, generated=("id",))
        assert (result.rows_parsed, result.rows_inserted, result.columns_used) == (2, 2, 3)
    assert sorted(rows(spark.table(target)), key=str) == [(None, "1", "2024-01-01", "x")] * 2 + [(None, "2", None, None)] * 2


def test_a_load_is_parsed_once(spark, tmp_path, monkeypatch):
    """What is counted and what is written come from the same parsed rows."""
    plans, real = [], csv_export.width_report
    monkeypatch.setattr(csv_export, "width_report", lambda rows, n: plans.append(rows) or real(rows, n))
    monkeypatch.setattr(csv_export, "replace_batch", lambda rows, *_: plans.append(rows))
    spark.sql("CREATE TABLE IF NOT EXISTS once_export (a STRING, b STRING, batch_id STRING) USING parquet PARTITIONED BY (batch_id)")
    try:
        append_export(spark, put(tmp_path / "a.csv", "1,x\n2\n"), "once_export", batch="one")
    finally:
        spark.sql("DROP TABLE once_export")
    assert len(plans) == 2 and not any("FileScan csv" in p._jdf.queryExecution().toString() for p in plans)
    assert sorted(rows(plans[1]), key=str) == [("1", "x"), ("2", None)]


def test_one_wide_row_rejects_everything(spark, tmp_path, target):
    path = put(tmp_path / "a.csv", "1,2024-01-01,x\n1,2,3,4,5\n")
    with pytest.raises(WideRowError, match="1 of 2 rows have up to 5 columns"):
        append_export(spark, path, target, generated=("id",))
    assert spark.table(target).count() == 0


def written(path, suffix):
    return "".join(p.read_bytes().decode() for p in sorted(path.glob(f"part-*{suffix}")))


def test_result_csv(spark, tmp_path):
    df = spark.createDataFrame(
        [(1, " a ", 'x"y', 1.0, None), (2, "n\nl", "c\rr", 100 / 3, "k,"), (3, "", "-", 0.00012, " ")],
        "n int, `a b` string, b string, c double, d string",
    ).coalesce(1)
    sinks.write_csv(df, str(tmp_path / "out"))
    assert written(tmp_path / "out", ".csv") == (
        'n,a b,b,c,d\n1, a ,"x""y",1,\n2,"n\nl","c\rr",33.333333333333336,"k,"\n3,,-,0.00012, \n'
    )


def test_reports(spark, tmp_path):
    df = spark.createDataFrame([("ANNUAL", 3, 0.0), ("2024-01", 2, 12.5)], "period string, n bigint, pct double")
    moment = dt.datetime(2024, 2, 1, 3, 4, 5, 678000, dt.timezone.utc)
    sinks.write_metrics_report(df, str(tmp_path / "m"), 12, moment)
    assert written(tmp_path / "m", ".txt") == (
        "window_months,12\ngenerated_at,2024-02-01T03:04:05.678Z\n\nperiod,n,pct\n2024-01,2,12.5\nANNUAL,3,0\n"
    )
    profile = spark.createDataFrame(
        [("race_raw", "b,c", 1, 50.0), ("age_group", 'x"', 1, 50.0)],
        "category string, value string, count bigint, percent_of_total_persons double",
    )
    sinks.write_demographics_report(profile, str(tmp_path / "d"), 2)
    assert written(tmp_path / "d", ".txt") == (
        'total_persons,2\n\ncategory,value,count,percent_of_total_persons\nage_group,"x""",1,50\nrace_raw,"b,c",1,50\n'
    )


def test_long_fields_and_many_fields(spark, tmp_path):
    long = "x" * 1_000_000
    file = tmp_path / "long.csv"
    file.write_text(f'1,"{long}"\n2,"{long} ""q"" {long}",c,surplus\n' + '""' + ',""' * 10_000 + "\n3," + "," * 10_000 + "\nok,b,c\n")
    rows = {r["a"]: (len(r["b"] or ""), r["_width"]) for r in csv_export.scan_export(spark, str(file), ["a", "b", "c"]).collect()}
    assert rows["1"] == (1_000_000, 2) and rows["ok"] == (1, 3)
    assert rows["2"] == (2_000_005, 4) and rows["3"] == (0, 10_002) and len(rows) == 4


def test_quoted_line_breaks_are_refused_line_by_line(spark, tmp_path):
    file = tmp_path / "breaks.csv"
    file.write_text('1,"one\nfield",c\n2,"a ""quoted"" b",c\n')
    spark.sql("CREATE TABLE breaks (a string, b string, c string)")
    try:
        with pytest.raises(csv_export.OpenQuoteError):
            csv_export.append_export(spark, str(file), "breaks", multi_line=False)
        assert spark.table("breaks").count() == 0
        assert csv_export.append_export(spark, str(file), "breaks").rows_inserted == 2
    finally:
        spark.sql("DROP TABLE breaks")
