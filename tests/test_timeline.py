"""Merged timelines, first occurrence, age groups."""

from __future__ import annotations

import random
from collections import Counter
from datetime import date, timedelta

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from phenotide.operators import timeline


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def day(n):
    return date(2001, 1, 1) + timedelta(days=n)


def full_outer(left, right, keys, left_columns, right_columns):
    """Brute force: keys compared value by value, a missing key equals nothing."""
    joined, used = [], set()
    for row in left:
        partners = [
            i for i, other in enumerate(right) if all(row[k] is not None and row[k] == other[k] for k in keys)
        ]
        used.update(partners)
        joined += [{**row, **{c: right[i][c] for c in right_columns}} for i in partners]
        if not partners:
            joined.append({**row, **{c: None for c in right_columns}})
    for i, other in enumerate(right):
        if i not in used:
            joined.append({**{c: None for c in left_columns}, **other})
    return joined


def as_counter(rows, columns):
    return Counter(tuple(row[c] for c in columns) for row in rows)


def records(rng, n, column, dated):
    rows = []
    for i in range(n):
        row = {"eid": rng.choice([1, 1, 1, 2, 3, None]), column: i}
        if dated:
            row["event_dt"] = rng.choice([day(0), day(0), day(1), None])
        rows.append(row)
    return rows


@pytest.mark.parametrize("dated", [(True, True, True), (True, True, False), (False, True, True), (False, False, False)])
def test_merge_equals_brute_force(spark, dated):
    """Dated and undated frames in any order."""
    rng = random.Random(7)
    sides = [records(rng, 14, name, has_date) for name, has_date in zip("abc", dated)]
    frames = [
        frame(
            spark,
            [tuple(row.values()) for row in rows],
            f"eid long, {name} int" + (", event_dt date" if has_date else ""),
        )
        for rows, name, has_date in zip(sides, "abc", dated)
    ]
    columns = ["eid"] + (["diag_date", "event_dt"] if any(dated) else []) + list("abc")
    merged = timeline.order_participant_records(*frames).collect()

    def known(row, has_date):
        return {**row, **({"diag_date": row["event_dt"]} if has_date else {})}

    expected = [known(row, dated[0]) for row in sides[0]]
    for rows, name, has_date in zip(sides[1:], "bc", dated[1:]):
        right = [known(row, has_date) for row in rows]
        have = list(expected[0])
        keys = ["eid", "diag_date"] if "diag_date" in have and has_date else ["eid"]
        new = [c for c in right[0] if c not in have]
        right = [{c: row[c] for c in dict.fromkeys(keys + new)} for row in right]
        expected = full_outer(expected, right, keys, have, new)
    assert as_counter(merged, columns) == as_counter(expected, columns)
    order = [(r.eid or -1, r["diag_date"] or date.min if any(dated) else None) for r in merged]
    assert [key[: 1 + any(dated)] for key in order] == sorted(key[: 1 + any(dated)] for key in order)


def test_merge_keeps_the_first_value_of_shared_columns(spark):
    left = frame(spark, [(1, day(0), "GP")], "eid long, event_dt date, source string")
    right = frame(spark, [(1, day(0), "OPCS"), (2, day(0), "OPCS")], "eid long, opdate date, source string")
    rows = timeline.order_participant_records(left, right).collect()
    assert [(r.eid, r.source, r.opdate) for r in rows] == [(1, "GP", day(0)), (2, None, day(0))]


def test_date_column_order(spark):
    df = frame(spark, [(1, "2001-01-01", "2002-02-02")], "eid long, opdate string, date string")
    assert timeline.with_diag_date(df).first().diag_date == date(2002, 2, 2)
    undated = frame(spark, [(1,)], "eid long")
    assert timeline.with_diag_date(undated).columns == ["eid"]


@pytest.fixture(scope="module")
def baseline(spark):
    return frame(spark, [(1, date(1950, 1, 1)), (2, date(1960, 1, 1))], "eid long, dob date")


def test_first_record(spark, baseline):
    rows = frame(
        spark,
        [
            (1, "b", day(3), "x"), (1, "b", day(1), "y"), (1, "a", day(1), "z"),
            (2, "a", day(5), "x"), (2, "a", None, "y"), (3, "a", day(2), "x"),
        ],
        "eid long, source string, event_dt date, `odd. name` string",
    )
    found = {r.eid: r for r in timeline.first_record(rows, baseline).collect()}
    # Same day: source decides. An undated record comes first, the first date is still reported.
    assert (found[1].source, found[1].diag_date, found[1]["odd. name"]) == ("a", day(1), "z")
    assert (found[2].diag_date, found[2].min_diag_date, found[2]["odd. name"]) == (None, day(5), "y")
    assert found[1][timeline.DIAGNOSIS_AGE] == 51.0 and found[2][timeline.DIAGNOSIS_AGE] is None
    assert found[3].dob is None  # not in the baseline table, kept


def test_first_record_with_birth_dates_in_the_records(spark):
    rows = frame(spark, [(1, day(1), date(1950, 1, 1))], "eid long, date date, dob date")
    row = timeline.first_record(rows).first()
    assert row[timeline.DIAGNOSIS_AGE] == 51.0 and "date" not in row


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(1, 4), st.one_of(st.none(), st.integers(0, 3)), st.integers(0, 5)), min_size=1))
def test_first_record_is_the_minimum_of_each_participant(spark, rows):
    df = frame(spark, [(e, None if d is None else day(d), v) for e, d, v in rows], "eid long, diag_date date, v int")
    found = {r.eid: (r.diag_date, r.v) for r in timeline.first_record(df.withColumn("dob", F.lit(day(0)))).collect()}
    expected = {}
    for e, d, v in rows:
        key = (d is not None, d or 0, v)
        expected[e] = min(expected.get(e, key), key)
    assert found == {e: (day(d) if has else None, v) for e, (has, d, v) in expected.items()}


def test_first_record_of_dates_alone_is_the_minimum_with_undated_ones_first(spark, baseline):
    rows = [(1, day(5)), (1, day(3)), (2, day(4)), (2, None), (3, None), (None, day(1)), (1, day(3))]
    dates = spark.createDataFrame(rows, "eid long, diag_date date")
    alone = timeline.first_record(dates, baseline)
    beside = timeline.first_record(dates.withColumn("source", F.lit("a")), baseline).drop("source")
    assert alone.columns == beside.columns and Counter(map(tuple, alone.collect())) == Counter(map(tuple, beside.collect()))
    assert {r.eid: (r.diag_date, r.min_diag_date) for r in alone.collect()} == {1: (day(3), day(3)), 2: (None, day(4)), 3: (None, None), None: (day(1), day(1))}


def test_first_occurrence(spark):
    gp = frame(spark, [(1, day(2)), (1, day(5)), (2, None), (3, day(1))], "eid long, event_dt date")
    opcs = frame(spark, [(1, day(2)), (3, day(0)), (4, day(9))], "eid long, opdate date")
    rows = timeline.first_occurrence({"OPCS": opcs, "GP": gp}).collect()
    assert {(r.eid, r.diag_date, r.source) for r in rows} == {
        (1, day(2), "GP"), (3, day(0), "OPCS"), (4, day(9), "OPCS"),
    }
    assert timeline.first_occurrence({"GP": gp}).count() == 2


def age_groups(spark, ages, bin_size=10):
    df = frame(spark, list(enumerate(ages)), f"eid long, `{timeline.DIAGNOSIS_AGE}` double")
    return [(r.age_group, r.n) for r in timeline.age_group_counts(df, bin_size).collect()]


def test_age_groups(spark):
    assert age_groups(spark, [1.0, 12.0, 19.0, 35.0]) == [("0-9", 1), ("10-19", 2), ("20-29", 0), ("30-39", 1)]
    # The oldest age is a multiple of the size: it falls out of the last group.
    assert age_groups(spark, [5.0, 40.0]) == [("0-9", 1), ("10-19", 0), ("20-29", 0), ("30-39", 0)]
    assert age_groups(spark, [-3.0, None, 4.0], 5) == [("0-4", 1)]
    assert age_groups(spark, [None]) == [] and age_groups(spark, [0.0]) == [] and age_groups(spark, [-2.0]) == []


def test_age_groups_count_a_participant_once(spark):
    df = frame(spark, [(1, 15.0), (1, 15.0), (2, 3.0)], f"eid long, `{timeline.DIAGNOSIS_AGE}` double")
    assert [r.n for r in timeline.age_group_counts(df).collect()] == [1, 1]
