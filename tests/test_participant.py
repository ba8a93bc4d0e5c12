"""Selections on the wide participant table."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from phenotide.operators import participant

WIDE = "eid string, p20002_i0_a0 string, p20002_i1_a0 string, p20004_i0_a0 string, p31 string, p310_i0 string"


@pytest.fixture(scope="module")
def people(spark):
    return spark.createDataFrame(
        [
            ("1", "1222", None, "hip op", "F", "x"),
            ("2", None, "1222", "hip op 2", "M", "F"),
            ("3", "1223", None, None, "F", "x"),
            ("4", None, None, "knee", None, None),
        ],
        WIDE,
    )


@pytest.fixture(scope="module")
def coding(spark):
    return spark.createDataFrame(
        [(1, "knee"), (2, "hip op"), (2, "zzz"), (3, "none of these"), (4, "kne+")], "coding int, meaning string"
    )


def ids(df):
    return sorted(row.eid for row in df.select("eid").collect())


def test_any_instance_matches(people):
    result = participant.selfreport_illness(people, ["1222"])
    assert ids(result) == [1, 2]
    assert result.first().source == "Self"
    assert dict(result.dtypes)["eid"] == "bigint"


def test_codes_are_patterns(people):
    assert ids(participant.selfreport_illness(people, ["122"])) == [1, 2, 3]
    assert ids(participant.selfreport_illness(people, ["12.3"])) == [3]


def test_no_match_returns_everybody_or_nobody(people):
    assert ids(participant.selfreport_illness(people, ["9999"])) == [1, 2, 3, 4]
    assert ids(participant.selfreport_illness(people, ["9999"], on_no_match="empty")) == []
    assert ids(participant.selfreport_cancer(people, ["1222"])) == [1, 2, 3, 4]  # no such column


def test_no_codes_returns_everybody(people):
    assert ids(participant.selfreport_treatment(people)) == [1, 2, 3, 4]


def test_bad_option(people):
    with pytest.raises(ValueError, match="some"):
        participant.selfreport_illness(people, ["1"], on_no_match="some")


def test_second_filter_comes_after_the_fallback(people):
    assert ids(participant.selfreport_illness(people, ["9999"], filter_column="p31", filter_values=["F"])) == [1, 3]


def test_renames_never_touch_the_key(people):
    result = participant.selfreport_illness(people, ["1222"], names={"eid": "ID", "p31": "Sex", "absent": "x"})
    assert "eid" in result.columns and "Sex" in result.columns and "p31" not in result.columns


def test_several_rows_per_participant(people):
    twice = people.unionByName(people.where("eid = '1'").withColumn("p20002_i0_a0", F.lit(None).cast("string")))
    assert ids(participant.selfreport_illness(twice, ["1222"])) == [1, 2]
    assert ids(participant.selfreport_illness(twice, ["1222"], one_row_per_participant=False)) == [1, 1, 2]
    assert ids(participant.selfreport_illness(twice, ["9999"], one_row_per_participant=False)) == [1, 1, 2, 3, 4]


def test_operation_by_first_meaning(people, coding):
    def run(*codes):
        return ids(participant.selfreport_operation(people, coding, codes))

    assert run(2) == [1, 2]  # the meaning also matches longer texts
    assert run(2, 4) == [1, 2, 4]  # meanings are patterns
    assert run(1) == [1, 2, 3, 4]  # codes up to 1 are not looked up, so nobody matches
    assert run(77) == [1, 2, 3, 4]  # unknown code
    assert run() == [1, 2, 3, 4]
    assert ids(participant.selfreport_operation(people, coding, [3], on_no_match="empty")) == []


def test_criteria(people):
    ill = ("p20002_i", lambda c: c == "1222")
    female = ("p31", lambda c: c == "F")
    assert ids(participant.filter_by_criteria(people, [ill])) == ["1", "2"]
    assert ids(participant.filter_by_criteria(people, [ill, female])) == ["1", "2"]  # p310 also starts with p31
    assert ids(participant.filter_by_criteria(people, [female], exact_field=True)) == ["1", "3"]
    assert ids(participant.filter_by_criteria(people, [])) == ["1", "2", "3", "4"]


def test_unknown_criterion_is_left_out_with_a_warning(people):
    with pytest.warns(UserWarning, match="p999"):
        result = participant.filter_by_criteria(people, [("p999", lambda c: c == "1"), ("p20002", lambda c: c == "1223")])
    assert ids(result) == ["3"]


@pytest.mark.parametrize("code", ["1222", "1223", "122"])
def test_more_codes_never_remove_rows(people, code):
    assert set(ids(participant.selfreport_illness(people, [code]))) <= set(
        ids(participant.selfreport_illness(people, [code, "1223"]))
    )


@pytest.fixture(scope="module")
def many_instances(spark):
    """Twelve text and two number columns of one field; participant i has code 100 + i in column i."""
    rows = [(str(i), *[str(100 + i) if c == i else None for c in range(12)], 100 + i, None) for i in range(14)]
    names = [f"p20002_i0_a{c}" for c in range(12)] + [f"p20004_i0_a{c}" for c in range(12)]
    columns = ", ".join(f"{name} string" for name in names)
    wide = [(row[0], *row[1:13], *row[1:13], *row[13:]) for row in rows]
    return spark.createDataFrame(wide, f"eid string, {columns}, p20002_i1_a0 long, p20002_i1_a1 long")


def test_many_instances_of_several_types(many_instances):
    assert ids(participant.selfreport_illness(many_instances.drop("p20002_i1_a0", "p20002_i1_a1"), ["103", "111"])) == [3, 11]
    hit = [("p20002_i", lambda column: column.cast("string") == "113")]
    assert ids(participant.filter_by_criteria(many_instances, hit)) == ["13"]
    missing = [("p20002_i", lambda column: column.isNotNull() & (column.cast("long") > 110))]
    assert ids(participant.filter_by_criteria(many_instances, missing)) == ["11", "12", "13"]


def test_operation_in_many_instances(spark, many_instances):
    coding = spark.createDataFrame([(2, "104"), (3, "10[79]")], "coding int, meaning string")
    assert ids(participant.selfreport_operation(many_instances, coding, [2, 3])) == [4, 7, 9]
    assert len(ids(participant.selfreport_operation(many_instances, coding, [5]))) == 14


@pytest.mark.parametrize("width", [8, 9, 130])
def test_conditions_may_call_functions_and_subqueries_at_any_width(spark, width):
    wide = spark.range(5).selectExpr("id AS eid", *[f"id * 1000 + {i} AS p5_i{i}" for i in range(width)])
    is_wanted = F.udf(lambda x: x == 2003, "boolean")
    by_udf = participant.filter_by_criteria(wide, [("p5_i", lambda column: is_wanted(column))])
    assert [r.eid for r in by_udf.collect()] == [2]
    most = spark.range(10).agg(F.max("id") + F.lit(2994))
    by_query = participant.filter_by_criteria(wide, [("p5_i", lambda column: column == most.scalar())])
    assert [r.eid for r in by_query.collect()] == [3]
