"""The comparator must find each kind of defect at its level."""

import pytest
from pyspark.sql import functions as F

from tideline.operators import compare as cmp


@pytest.fixture(scope="module")
def base(spark):
    g = F.col("id").cast("int")
    return spark.range(1, 201).select(
        g.alias("id"),
        F.concat(F.lit("type_"), (g % 3).cast("string")).alias("_type"),
        (g * 1.5).cast("decimal(12,2)").alias("price"),
        (g * 0.1).alias("quantity"),
        F.date_add(F.lit("2026-01-01").cast("date"), g).alias("valid_from"),
        (g % 2 == 0).alias("active"),
        F.when(g % 5 == 0, None).when(g % 7 == 0, "").otherwise(F.concat(F.lit("note "), g.cast("string"))).alias("note"),
        F.md5(g.cast("string")).alias("row_hash"),
        F.lit("now").alias("_timestamp"),
    )


def swapped(df):
    return df.withColumn("price", F.when(F.col("id") == 2, 4.5).when(F.col("id") == 3, 3.0).otherwise(F.col("price")).cast("decimal(12,2)"))


@pytest.mark.parametrize(
    ("change", "level"),
    [
        (lambda d: d.where("id <> 7"), 1),
        (lambda d: d.withColumnRenamed("note", "remark"), 2),
        (lambda d: d.select("_type", "id", *d.columns[2:]), 2),
        (lambda d: d.withColumn("quantity", F.col("quantity").cast("float")), 3),
        (lambda d: d.withColumn("price", F.when(F.col("id") == 5, 1).otherwise(F.col("price")).cast("decimal(12,2)")), 4),
        (lambda d: d.withColumn("note", F.nullif("note", F.lit(""))), 4),
        (swapped, 5),
    ],
)
def test_level_of_defect(base, change, level):
    report = cmp.compare("t", base, change(base), ["id"], stored_hash="row_hash")
    assert report.verdict == "DIFF" and report.first_failed == level, report.to_text()


def test_match_and_ignored_columns(base):
    report = cmp.compare("t", base, base.withColumn("_timestamp", F.lit("later")), ["id"])
    assert report.verdict == "MATCH" and "level 5: ok" in report.to_text()


def test_accepted_deviation(base):
    report = cmp.compare("t", base.drop("row_hash"), base, ["id"], accept=["managed_column_added"])
    assert report.verdict == "MATCH*"
    assert cmp.compare("t", base, base.drop("row_hash"), ["id"], accept=list(cmp.DEVIATIONS)).verdict == "DIFF"  # in one direction
    order = [c for c in base.columns if c not in ("row_hash", "_timestamp")]
    swap = base.select(*order, "_timestamp", "row_hash")
    assert cmp.compare("t", base, swap, ["id"], accept=["managed_columns_reordered"]).verdict == "MATCH*"
    assert cmp.compare("t", base, swap.select("_timestamp", *order, "row_hash"), ["id"], accept=list(cmp.DEVIATIONS)).verdict == "DIFF"
    typed = base.withColumn("_type", F.lit(1))
    assert [cmp.DEVIATIONS["reserved_column_typed"](d) for d in cmp.type_differences(base, typed)] == [True]
    assert [cmp.DEVIATIONS["reserved_column_typed"](d) for d in cmp.type_differences(typed, base)] == [False]
    wide = base.withColumn("id", F.col("id").cast("bigint"))
    assert cmp.compare("t", base, wide, ["id"], accept=list(cmp.DEVIATIONS)).verdict == "DIFF"


def test_signature_has_eight_fields(spark):
    a = spark.createDataFrame([], "d decimal(12,2), s string, t timestamp")
    got = {f.name: cmp.signature(f) for f in a.schema.fields}
    assert tuple(got["d"]) == cmp.SIGNATURE and got["d"]["numeric_precision"] == "12" and got["d"]["numeric_scale"] == "2" and got["t"]["datetime_precision"] == "6"
    named = a.withMetadata("s", {"char_max_length": 20}), a.withMetadata("s", {"char_max_length": 30})
    assert [(d.kind, d.left, d.right) for d in cmp.type_differences(*named)] == [("char_max_length", "20", "30")]


def test_missing_table_and_error(base):
    assert cmp.compare("t", base, None).first_failed == 1
    broken = base.withColumn("price", F.raise_error(F.lit("boom")).cast("decimal(12,2)"))
    bad = cmp.compare("t", base, broken, ["id"])
    assert bad.verdict == "ERROR" and cmp.roll_up([bad])["exit_code"] == 2


def test_change_outside_stored_hash_is_counted(base):
    report = cmp.compare("t", base, swapped(base), ["id"], stored_hash="row_hash")
    assert {d.kind: d.left for d in report.levels[4].differences} == {"content_differs": "2", "hidden_differs": "2"}
    assert [s["id"] for s in report.samples] == [2, 3]


def test_narrowest_key():
    assert cmp.narrowest_key([(["a", "b"], False), (["c"], False), (["d", "e"], True)]) == ["d", "e"]
    assert cmp.narrowest_key([]) is None


def test_command_line(base, spark, tmp_path, capsys):
    import json

    from tideline.__main__ import main

    left, right = f"{tmp_path}/l", f"{tmp_path}/r"
    base.write.parquet(left)
    swapped(base).write.parquet(right)
    assert main(["compare", left, left, "--keys", "id"]) == 0
    assert main(["compare", left, right, "--keys", "id", "--json"]) == 1
    assert json.loads(capsys.readouterr().out.splitlines()[-1])["first_failed_level"] == 5
    (tmp_path / "jobs.json").write_text(json.dumps([{"left": left, "right": left, "keys": ["id"]}, {"left": left, "right": f"{tmp_path}/none"}]))
    assert main(["batch", f"{tmp_path}/jobs.json"]) == 1
    assert json.loads(capsys.readouterr().out.splitlines()[-1])["MATCH"] == 1
    assert main(["leftovers", f"{tmp_path}/none"]) == 0


def test_type_lists():
    from tideline.functions.clean import date_columns_by_name, date_like_columns, declared_text_types, is_truthy

    assert date_like_columns({"a": "DATETIME2", "b": "int"}) == ["a"] and date_columns_by_name(["Datum", "x"]) == ["Datum"]
    assert declared_text_types({"a": "int", "b": None, "c": "generated"}) == {"a": "int"}
    assert is_truthy("Ano") and not is_truthy(None) and not is_truthy("ne")
