"""Field lookup, extraction, profiles."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from phenotide.operators import fields


@pytest.fixture(scope="module")
def dictionary(spark):
    return spark.createDataFrame(
        [
            ("eid", "Participant ID"), ("p31", "Sex"), ("p310", "Other"), ("p3_i10", "Weight late"),
            ("p3_i2_a10", "Weight | Array 10"), ("p3_i2_a9", "Weight | Array 9"), ("p3_a1", "Weight array"),
            ("p3", "WEIGHT"), ("p3_i2", "Weight"), ("p3_i2_x", "odd"), ("xp3", "odd"),
        ],
        "name string, title string",
    )


@pytest.fixture(scope="module")
def wide(spark):
    return spark.createDataFrame(
        [(1, "a", 1.0, None, None), (2, "b", float("nan"), None, "x")],
        "eid long, p31 string, p3_i2 double, p3_i10 string, `p310` string",
    )


def names(df):
    return [row.name for row in df.collect()]


def test_fields_for_id_in_natural_order(dictionary):
    expected = ["p3", "p3_a1", "p3_i2", "p3_i2_a9", "p3_i2_a10", "p3_i10"]
    assert names(fields.fields_for_id(dictionary, 3)) == expected
    assert names(fields.field_names_for_id(dictionary, "3")) == expected
    assert names(fields.fields_for_id(dictionary, 31)) == ["p31"]


def test_fields_by_keyword_ignore_case(dictionary):
    expected = ["p3", "p3_a1", "p3_i2", "p3_i2_a9", "p3_i2_a10", "p3_i10"]
    assert names(fields.fields_by_title_keyword(dictionary, "weight")) == expected
    assert names(fields.field_names_by_title_keyword(dictionary, "weight ARR")) == ["p3_a1"]
    assert [r.title for r in fields.field_titles_by_title_keyword(dictionary, "sex").collect()] == ["Sex"]
    assert names(fields.fields_by_title_keyword(dictionary, "PARTICIPANT")) == ["eid"]


def test_extract_in_table_order(dictionary, wide):
    assert fields.extract_fields(wide, dictionary, ["3", "p31", "eid"]).columns == ["eid", "p31", "p3_i2", "p3_i10"]
    assert fields.extract_fields(wide, dictionary, ["31"], ["OTHER"]).columns == ["p31", "p310"]
    assert fields.extract_fields(wide, dictionary, [], ["nothing"]).columns == []
    assert fields.extract_fields(wide, dictionary, []).columns == []


def test_extract_with_titles(dictionary, wide):
    result = fields.extract_fields(wide, dictionary, ["eid", "31"], ["weight"], use_descriptions=True)
    assert result.columns == ["eid", "Sex", "Weight", "Weight late"]


def test_titles_must_differ(spark, wide):
    same = spark.createDataFrame([("p31", "t"), ("p310", "t")], "name string, title string")
    with pytest.raises(ValueError, match="'t'"):
        fields.extract_fields(wide, same, ["31", "310"], use_descriptions=True)


def test_append_only_new_fields_by_participant(spark, wide):
    stored = spark.createDataFrame([(2, "old"), (1, "old"), (3, "old")], "eid long, p31 string")
    result = fields.append_fields(stored, wide, ["eid", "p31", "p3_i2", "p310", "p310"], {"p3_i2": "Weight"})
    assert result.columns == ["eid", "p31", "Weight", "p310"]
    assert {(r.eid, r.p31, r.p310) for r in result.collect()} == {(1, "old", None), (2, "old", "x"), (3, "old", None)}
    assert fields.append_fields(stored, wide, ["p31"]) is stored
    titled = stored.withColumnRenamed("p31", "Sex")
    assert fields.append_fields(titled, wide, ["p31", "p310"], {"p31": "Sex"}).columns == ["eid", "Sex", "p310"]


def test_null_profile(wide):
    profile = {r.column: r.nulls for r in fields.column_null_profile(wide).collect()}
    assert profile == {"eid": 0, "p31": 0, "p3_i2": 1, "p3_i10": 2, "p310": 1}


def test_drop_all_null(wide):
    assert fields.drop_all_null_columns(wide).columns == ["eid", "p31", "p3_i2", "p310"]
    assert fields.drop_all_null_columns(wide.where("eid = 1")).columns == ["eid", "p31", "p3_i2"]
    assert fields.drop_all_null_columns(wide.where("eid > 9")).columns == []


def test_many_codes(spark):
    names_ = [f"p{i}_i0" for i in range(12_000)]
    dictionary = spark.createDataFrame([(n, f"Title {n}") for n in names_], "name string, title string")
    codes = [f"p{i}_i0" for i in range(5000)] + [str(i) for i in range(5000, 10_000)]
    found = fields.resolve_fields(dictionary, names_, codes, [f"title p{i}_i0" for i in range(11_990, 12_000)])
    assert list(found) == names_[:10_000] + names_[11_990:]


def test_profiles_of_very_wide_tables(spark, tmp_path):
    columns = {f"c{i}": pa.array([1.5 if row < i % 5 else None for row in range(4)], pa.float64()) for i in range(3200)}
    pq.write_table(pa.table({"eid": [0, 1, 2, 3], **columns}), tmp_path / "wide.parquet")
    wide = spark.read.parquet(f"{tmp_path}/wide.parquet")
    profile = {r.column: r.nulls for r in fields.column_null_profile(wide).collect()}
    assert profile == {"eid": 0, **{f"c{i}": 4 - i % 5 for i in range(3200)}}
    assert fields.drop_all_null_columns(wide).columns == ["eid", *[f"c{i}" for i in range(3200) if i % 5]]
