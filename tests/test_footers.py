"""Null counts from Parquet footers: equal to a scan, without reading data."""

from __future__ import annotations

import math
from pathlib import Path

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from phenotide.operators import fields
from phenotide.sources import footers

ROWS = [(1, "a", None, 1.5, None, True), (2, None, None, math.nan, "x", None), (3, "", None, None, "y", False)] * 40
SCHEMA = "eid long, `name.x` string, nothing int, value double, late string, flag boolean"


@pytest.fixture()
def path(spark, tmp_path):
    spark.createDataFrame(ROWS, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/wide")
    return f"{tmp_path}/wide"


def as_dict(df):
    return {r.column: r.nulls for r in df.collect()}


def test_profile_equals_a_scan(spark, path):
    expected = {"eid": 0, "name.x": 40, "nothing": 120, "value": 80, "late": 40, "flag": 40}
    assert as_dict(footers.stored_null_profile(spark, path)) == as_dict(fields.column_null_profile(spark.read.parquet(path))) == expected
    assert footers.drop_all_null_stored(spark, path).columns == ["eid", "name.x", "value", "late", "flag"]


def test_no_data_is_read_but_of_floating_point_columns(spark, path):
    """Every byte of the pages is overwritten; footers still tell all counts."""
    expected = footers.footer_counts(spark, path)
    assert expected == (120, {"eid": 120, "name.x": 80, "nothing": 0, "late": 80, "flag": 80})
    for file in Path(path).glob("*.parquet"):
        meta, raw = pq.read_metadata(file), bytearray(file.read_bytes())
        for g in range(meta.num_row_groups):
            for c in range(meta.num_columns):
                column = meta.row_group(g).column(c)
                first = column.dictionary_page_offset or column.data_page_offset
                raw[first : first + column.total_compressed_size] = b"\xff" * column.total_compressed_size
        file.write_bytes(raw)
        (file.parent / f".{file.name}.crc").unlink()
    assert footers.footer_counts(spark, path) == expected
    plan = footers.stored_null_profile(spark, path)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<value:double>" in plan and plan.count("FileScan") == 1


def test_session_settings_stay(spark, path):
    before = [spark.conf.get(name, None) for name in footers.FOOTER_SETTINGS]
    footers.stored_null_profile(spark, path).collect()
    assert [spark.conf.get(name, None) for name in footers.FOOTER_SETTINGS] == before


def test_files_without_statistics_are_scanned(spark, tmp_path):
    table = pa.table({"a": pa.array([1, None, 3]), "b": pa.array(["x", None, None])})
    pq.write_table(table, tmp_path / "plain.parquet", write_statistics=False)
    assert footers.footer_counts(spark, str(tmp_path)) == (0, {})
    assert as_dict(footers.stored_null_profile(spark, str(tmp_path))) == {"a": 1, "b": 2}


def test_nested_and_partitioned_tables(spark, tmp_path):
    spark.createDataFrame([([1], 1, "a"), (None, None, "b")], "list array<int>, n int, part string").write.partitionBy("part").parquet(f"{tmp_path}/nested")
    assert as_dict(footers.stored_null_profile(spark, f"{tmp_path}/nested")) == {"list": 1, "n": 1, "part": 0}
    spark.createDataFrame([(1, "a"), (None, "b"), (2, None)], "n int, part string").write.partitionBy("part").parquet(f"{tmp_path}/parts")
    assert footers.footer_counts(spark, f"{tmp_path}/parts") == (3, {"n": 2})
    assert as_dict(footers.stored_null_profile(spark, f"{tmp_path}/parts")) == {"n": 1, "part": 1}


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "a int, b double").write.parquet(f"{tmp_path}/none")
    assert as_dict(footers.stored_null_profile(spark, f"{tmp_path}/none")) == {"a": 0, "b": 0}
