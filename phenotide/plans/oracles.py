"""The registered queries as plain SQL for DuckDB, written independently of the operators."""

from __future__ import annotations

import re

from phenotide.plans.fixtures import CANCER_INSTANCES, FIXTURES, MORE_ILLNESSES, fixture_sql

_GP = """
SELECT eid, data_provider, TRY_CAST(event_dt AS DATE) AS event_dt, read_2, read_3,
  TRY_CAST(value1 AS DOUBLE) AS value1, TRY_CAST(value2 AS DOUBLE) AS value2, TRY_CAST(value3 AS DOUBLE) AS value3,
  TRY_CAST(event_dt AS DATE) IS NULL AS exclude,
  CASE WHEN TRY_CAST(event_dt AS DATE) IS NULL THEN 'Missing event_dt' ELSE '' END AS exclude_reason, 'GP' AS source
FROM fx_gp_clinical WHERE {where}"""

_OPDATE = """CAST(COALESCE(TRY_STRPTIME(opdate, ['%Y-%m-%d', '%Y/%m/%d']),
    TRY_STRPTIME(opdate, ['%d-%m-%Y', '%d/%m/%Y %H:%M:%S'])) AS DATE)"""

_OPCS = """
SELECT CAST(eid AS BIGINT) AS eid, CAST(ins_index AS BIGINT) AS ins_index, CAST(arr_index AS BIGINT) AS arr_index,
  {opdate} AS opdate, level, oper3, oper3_nb, oper4, oper4_nb,
  CAST(posopdur AS BIGINT) AS posopdur, CAST(preopdur AS BIGINT) AS preopdur,
  {opdate} IS NULL AS exclude,
  CASE WHEN {opdate} IS NULL THEN 'Missing opdate' ELSE '' END AS exclude_reason, 'OPCS' AS source
FROM fx_hesin_oper WHERE {where}""".replace("{opdate}", _OPDATE)

_HOSPITAL = """
SELECT d.eid, d.ins_index, d.arr_index, d.level AS {level}, d.diag_icd9, d.diag_icd10,
  COALESCE(e.s, e.f - CAST(e.n AS INT)) AS epistart, COALESCE(e.f, e.s + CAST(e.n AS INT)) AS epiend,
  e.n AS epidur, e.bedyear, e.admimeth,
  {exclude} AS exclude, {reason} AS exclude_reason, '{source}' AS source
FROM fx_hesin_diag d JOIN (
  SELECT CAST(eid AS BIGINT) AS eid, CAST(ins_index AS BIGINT) AS ins_index, TRY_CAST(epistart AS DATE) AS s,
    TRY_CAST(epiend AS DATE) AS f, TRY_CAST(epidur AS BIGINT) AS n, CAST(bedyear AS BIGINT) AS bedyear, admimeth
  FROM fx_hesin) e ON d.eid = e.eid AND d.ins_index = e.ins_index
WHERE {where}"""

_MORE = [f"p20002_i{i}_a{a}" for i, a in MORE_ILLNESSES]

_SELF = """
SELECT CAST(eid AS BIGINT) AS eid, p20002_i0_a0 AS illness_0_0, p20002_i0_a1, p20002_i1_a0, {more}, p20001_i0_a0, p20001_i1_a0,
  p20003_i0_a0, p20003_i1_a0, p20004_i0_a0, p31 AS segment, 'Self' AS source
FROM fx_selfreport_participant WHERE {where}""".replace("{more}", ", ".join(_MORE))

_CANCER_LONG = " UNION ALL ".join(
    f"""
SELECT eid, TRY_CAST(p40005_i{i} AS DATE) AS reg_date, p40006_i{i} AS site, p40008_i{i} AS age, p40011_i{i} AS histology,
  p40012_i{i} AS behaviour FROM fx_cancer_participant"""
    for i in range(CANCER_INSTANCES)
)


def _icd10(where: str) -> str:
    return _HOSPITAL.format(
        where=where, level="level", source="HES_ICD10", exclude="FALSE",
        reason="CASE WHEN e.s IS NULL AND e.f IS NULL THEN '' ELSE ' (back-calculated)' END",
    )


def _icd9(where: str) -> str:
    return _HOSPITAL.format(
        where=where, level="classification", source="HES_ICD9", exclude="(e.s IS NULL AND e.f IS NULL)",
        reason="CASE WHEN e.s IS NULL AND e.f IS NULL THEN 'Invalid epistart and epiend' "
        "ELSE 'Invalid epistart and epiend (back-calculated)' END",
    )


def _any_like(columns: list[str], text: str) -> str:
    return " OR ".join(f"{name} LIKE '%{text}%'" for name in columns)


_ILLNESS = ["p20002_i0_a0", "p20002_i0_a1", "p20002_i1_a0", *_MORE]
_CANCER = ["p20001_i0_a0", "p20001_i1_a0"]
_TREATMENT = ["p20003_i0_a0", "p20003_i1_a0"]


def _selfreport(columns: list[str], code: str) -> str:
    hit = _any_like(columns, code)
    return _SELF.format(where=f"{hit} OR NOT EXISTS (SELECT 1 FROM fx_selfreport_participant WHERE {hit})")


_FROZEN_SHOULDER = "read_2 IN ('N210.', 'XE1FL', 'XE1Hm') OR read_3 IN ('N210.', 'XE1FL', 'XE1Hm')"

_DEATH = """
SELECT c.eid, c.ins_index, c.dnx_death_cause_id, c.arr_index, c.level, c.cause_icd10, r.dnx_death_id, r.dsource,
  r.source, TRY_CAST(r.date_of_death AS DATE) AS date_of_death, b.dob, b.assess_date,
  datediff('day', b.dob, TRY_CAST(r.date_of_death AS DATE)) / CAST(365.25 AS DOUBLE) AS death_age,
  COALESCE(TRY_CAST(r.date_of_death AS DATE) < b.assess_date, FALSE) AS prev
FROM fx_death_cause c JOIN fx_death r ON c.eid = r.eid AND c.ins_index = r.ins_index
JOIN fx_baseline b ON b.eid = c.eid
WHERE c.cause_icd10 LIKE 'E10%'"""

_RATES = f"""
WITH cases AS (
  SELECT 'HES' AS source, eid FROM ({_icd10("d.diag_icd10 LIKE '%C54%'")}) h
  UNION ALL SELECT 'OPCS', eid FROM ({_OPCS.format(where="oper3 LIKE '%W789%' OR oper4 LIKE '%W789%'")}) o
  UNION ALL SELECT 'Self', CAST(eid AS BIGINT) FROM fx_selfreport_participant WHERE {_any_like(_CANCER, "1002")}
  UNION ALL SELECT 'Death', eid FROM ({_DEATH}) x),
cohort AS (
  SELECT 'HES' AS source, CAST(eid AS BIGINT) AS eid FROM fx_hesin
  UNION ALL SELECT 'OPCS', CAST(eid AS BIGINT) FROM fx_hesin_oper
  UNION ALL SELECT 'Self', CAST(eid AS BIGINT) FROM fx_selfreport_participant
  UNION ALL SELECT 'Death', eid FROM fx_death)
SELECT n.source, COALESCE(c.cases, 0) AS cases, n.n, COALESCE(c.cases, 0) / CAST(n.n AS DOUBLE) AS case_rate
FROM (SELECT source, CAST(count(DISTINCT eid) AS BIGINT) AS n FROM cohort GROUP BY source) n
LEFT JOIN (SELECT source, CAST(count(DISTINCT eid) AS BIGINT) AS cases FROM cases GROUP BY source) c USING (source)"""


def _upper_tail(z: str) -> str:
    """P(Z > z) for z >= 0, by the series of the middle part: density times the sum of z^(2k+1) / (2k+1)!!."""
    term = f"exp((2 * k + 1) * ln({z}) - (k + 1) * ln(2) - lgamma(k + 1.5) + ln(pi()) / 2)"
    middle = f"exp(-{z} * {z} / 2) / sqrt(2 * pi()) * list_sum(list_transform(range(0, 120), lambda k: {term}))"
    return f"CASE WHEN {z} > 8 THEN 0.0::DOUBLE WHEN {z} < 1e-12 THEN 0.5::DOUBLE ELSE 0.5 - {middle} END"


def _power(odds_ratios: list[float], critical: float, operator: str) -> str:
    """Two-sided power; ``critical`` is the quantile 1 - alpha/2 of the standard normal."""
    ratios = " UNION ALL ".join(f"SELECT {r}::DOUBLE AS odds_ratio" for r in odds_ratios)
    return f"""
WITH rates AS ({_RATES}), ratios AS ({ratios}),
grid AS (
  SELECT variant_id, maf, source, odds_ratio,
    CASE WHEN cases > 0 AND cases < n AND maf > 0 AND maf < 1 THEN
      ln(odds_ratio) {operator} sqrt(2 * maf * (1 - maf)) / sqrt(1.0::DOUBLE / cases + 1.0::DOUBLE / (n - cases)) END AS x
  FROM fx_variants, rates, ratios),
limits AS (SELECT *, x - {critical!r}::DOUBLE AS a, -{critical!r}::DOUBLE - x AS b FROM grid),
sizes AS (SELECT *, abs(a) AS za, abs(b) AS zb FROM limits),
tails AS (SELECT *, {_upper_tail("za")} AS ta, {_upper_tail("zb")} AS tb FROM sizes)
SELECT variant_id, maf, source, odds_ratio,
  round(CASE WHEN a > 0 THEN 1 - ta ELSE ta END + CASE WHEN b > 0 THEN 1 - tb ELSE tb END, 6) AS power
FROM tails"""


def _tail(z: str) -> str:
    """P(Z > z) for z >= 0 at full precision: a series near the centre, a continued fraction in the tail."""
    fraction = f"list_reduce(list_prepend({z}, list_transform(range(200, 0, -1), lambda k: CAST(k AS DOUBLE))), lambda a, k: {z} + k / a)"
    return f"CASE WHEN {z} < 2 THEN {_upper_tail(z)} ELSE exp(-{z} * {z} / 2) / sqrt(2 * pi()) / {fraction} END"


def _bisected(name: str, start: str, keys: str, is_below: str) -> str:
    """Recursive halving of [lo, hi] of the rows of ``start``; x holds the middle, za and zb are sizes to be set by ``is_below``."""
    return f"""
{name}_steps AS (
  SELECT *, 0 AS step FROM ({start}) s
  UNION ALL
  SELECT {keys}, CASE WHEN below THEN x ELSE lo END AS lo, CASE WHEN below THEN hi ELSE x END AS hi, step + 1 AS step
  FROM (SELECT *, {is_below} AS below FROM (SELECT *, (lo + hi) / 2 AS x FROM {name}_steps WHERE step < 60) m) b),
{name} AS (SELECT {keys}, (lo + hi) / 2 AS x FROM {name}_steps WHERE step = 60)"""


def _both_tails(strength: str, critical: str) -> str:
    far, near = f"({critical} + {strength})", f"abs({critical} - {strength})"
    return f"(CASE WHEN {strength} > {critical} THEN 1 - ({_tail(near)}) ELSE ({_tail(near)}) END + ({_tail(far)}))"


def _solve() -> str:
    designs = "SELECT a::DOUBLE AS alpha, p::DOUBLE AS power FROM (VALUES (1e-9, 0.8), (1e-9, 0.06), (0.05, 0.8), (0.05, 0.06), (5e-8, 0.9), (0.05, 0.9)) v(a, p)"
    criticals = _bisected("criticals", f"SELECT DISTINCT alpha, 0::DOUBLE AS lo, 8::DOUBLE AS hi FROM ({designs}) d", "alpha", f"2 * ({_tail('x')}) > alpha")
    strengths = _bisected(
        "strengths", f"SELECT alpha, power, c.x AS c, 0::DOUBLE AS lo, c.x + 8 AS hi FROM ({designs}) d JOIN criticals c USING (alpha)",
        "alpha, power, c", f"{_both_tails('x', 'c')} < power",
    )
    levels = _bisected(
        "levels",
        """SELECT DISTINCT maf, source, odds_ratio, abs(ln(odds_ratio)) / sqrt(2 * maf * (1 - maf)) * sqrt(CAST(cases AS DOUBLE) * (n - cases) / n) AS t,
  0::DOUBLE AS lo, abs(ln(odds_ratio)) / sqrt(2 * maf * (1 - maf)) * sqrt(CAST(cases AS DOUBLE) * (n - cases) / n) + 2 AS hi
  FROM fx_variants, known, (VALUES (1.01::DOUBLE), (2::DOUBLE)) r(odds_ratio)""",
        "maf, source, odds_ratio, t", f"{_both_tails('t', 'x')} > 0.8",
    )
    return f"""
WITH RECURSIVE rates AS ({_RATES}),
known AS (SELECT source, CAST(cases AS DOUBLE) AS cases, CAST(n AS DOUBLE) AS n FROM rates WHERE cases > 0 AND cases < n),
every AS (SELECT source, CASE WHEN cases > 0 AND cases < n THEN CAST(cases AS DOUBLE) END AS cases,
  CASE WHEN cases > 0 AND cases < n THEN CAST(n AS DOUBLE) END AS n FROM rates),
{criticals},
{strengths},
{levels},
solved AS (
  SELECT variant_id, maf, source, odds_ratio, alpha, power, needed AS cases, needed * n / cases AS n
  FROM (SELECT *, pow(s.x * sqrt(2 * maf * (1 - maf)) / ln(odds_ratio), 2) * n / (n - cases) AS needed
    FROM fx_variants, every, (VALUES (0.5::DOUBLE), (1.5::DOUBLE)) r(odds_ratio), (VALUES (1e-9::DOUBLE, 0.8::DOUBLE), (1e-9, 0.06), (0.05, 0.8), (0.05, 0.06)) d(alpha, power)
    JOIN strengths s USING (alpha, power)) q
  UNION ALL
  SELECT variant_id, maf, source, exp(s.x * sqrt(2 * maf * (1 - maf)) / sqrt(cases * (n - cases) / n)), alpha, power, cases, n
  FROM fx_variants, every, (VALUES (5e-8::DOUBLE, 0.9::DOUBLE), (0.05, 0.9)) d(alpha, power) JOIN strengths s USING (alpha, power)
  UNION ALL
  SELECT variant_id, v.maf, e.source, r.odds_ratio, 2 * ({_tail("l.x")}), 0.8, cases, n
  FROM fx_variants v CROSS JOIN every e CROSS JOIN (VALUES (1.01::DOUBLE), (2::DOUBLE)) r(odds_ratio)
  LEFT JOIN levels l ON l.maf = v.maf AND l.source = e.source AND l.odds_ratio = r.odds_ratio)
SELECT variant_id, maf, source, round(odds_ratio, 6) AS odds_ratio, round(alpha, 9) AS alpha, round(power, 6) AS power,
  round(cases, 3) AS cases, round(n, 3) AS n FROM solved"""


_CALLS = """
SELECT g.eid, g.chrom, g.pos, s.weight,
  CASE WHEN s.effect_allele = g.allele1 THEN g.allele1_count ELSE 2 - g.allele1_count END AS calls
FROM fx_genotypes g JOIN fx_score_file s ON g.chrom = s.chrom AND g.pos = s.pos
WHERE g.chrom BETWEEN 1 AND 22 AND (s.effect_allele = g.allele1 OR s.effect_allele = g.allele2)"""


def _age_groups(ages: str, bin_size: int) -> str:
    """``ages``: one row (eid, age) per participant."""
    return f"""
WITH ages AS ({ages}),
spine AS (SELECT unnest(range(0, (SELECT CAST(trunc(max(age)) AS BIGINT) FROM ages), {bin_size})) AS lo)
SELECT concat(CAST(s.lo AS VARCHAR), '-', CAST(s.lo + {bin_size} - 1 AS VARCHAR)) AS age_group, s.lo,
  CAST(count(a.eid) AS BIGINT) AS n
FROM spine s LEFT JOIN ages a ON a.age >= s.lo AND a.age < s.lo + {bin_size}
GROUP BY s.lo ORDER BY s.lo"""


def _age_at_first(records: str) -> str:
    """Age at the first of ``records`` (eid, diag_date); none for a participant with an undated record."""
    return f"""SELECT r.eid, CASE WHEN count(*) = count(diag_date)
    THEN round(datediff('day', min(b.dob), min(diag_date)) / CAST(365.25 AS DOUBLE)) END AS age
  FROM ({records}) r LEFT JOIN fx_baseline b ON b.eid = r.eid GROUP BY r.eid"""


_FIRST_GP = f"""
SELECT eid, event_dt AS diag_date, source, read_2, read_3, data_provider, event_dt, value1, value2, value3, exclude,
  exclude_reason, min_diag_date, dob, round(datediff('day', dob, event_dt) / CAST(365.25 AS DOUBLE)) AS "Diagnosis Age"
FROM (
  SELECT r.*, b.dob, min(event_dt) OVER (PARTITION BY r.eid) AS min_diag_date,
    row_number() OVER (PARTITION BY r.eid ORDER BY event_dt NULLS FIRST, r.source NULLS FIRST, read_2 NULLS FIRST,
      read_3 NULLS FIRST, data_provider NULLS FIRST, value1 NULLS FIRST, value2 NULLS FIRST, value3 NULLS FIRST) AS k
  FROM ({_GP.format(where="TRUE")}) r LEFT JOIN fx_baseline b ON r.eid = b.eid) t
WHERE k = 1"""

_FIRST_SOURCES = f"""
SELECT eid, min(diag_date) AS diag_date, min_by(source, (diag_date, source)) AS source
FROM (
  SELECT eid, event_dt AS diag_date, 'GP' AS source FROM ({_GP.format(where=_FROZEN_SHOULDER)}) g
  UNION ALL SELECT eid, opdate, 'OPCS'
    FROM ({_OPCS.format(where="oper3 LIKE '%W78%' OR oper4 LIKE '%W78%'")}) o
  UNION ALL SELECT eid, epistart, 'ICD10' FROM ({_icd10("d.diag_icd10 LIKE '%M750%'")}) h
  UNION ALL SELECT eid, reg_date, 'cancer' FROM ({_CANCER_LONG}) c WHERE site LIKE '%C61%') u
WHERE diag_date IS NOT NULL GROUP BY eid"""

_ORDERED = f"""
SELECT eid, diag_date, data_provider, event_dt, read_2, read_3, value1, value2, value3, g.exclude, g.exclude_reason,
  g.source, o.ins_index, o.arr_index, opdate, o.level, oper3, oper3_nb, oper4, oper4_nb, posopdur, preopdur,
  diag_icd9, diag_icd10, epistart, epiend, epidur, bedyear, admimeth,
  illness_0_0, p20002_i0_a1, p20002_i1_a0, {', '.join(_MORE)}, p20001_i0_a0, p20001_i1_a0, p20003_i0_a0, p20003_i1_a0, p20004_i0_a0, segment
FROM (SELECT *, event_dt AS diag_date FROM
    ({_GP.format(where="read_2 IN ('22K..', 'XE2eD') OR read_3 IN ('22K..', 'XE2eD')")}) g0) g
  FULL JOIN (SELECT *, opdate AS diag_date FROM
    ({_OPCS.format(where="oper3 LIKE '%W78%' OR oper4 LIKE '%W78%'")}) o0) o USING (eid, diag_date)
  FULL JOIN (SELECT *, epistart AS diag_date FROM ({_icd10("d.diag_icd10 LIKE '%M750%'")}) h0) h USING (eid, diag_date)
  FULL JOIN ({_selfreport(_ILLNESS, "1222")}) s USING (eid)
ORDER BY eid, diag_date NULLS FIRST"""

_FIELDS = """
SELECT name, title, CAST(regexp_extract(name, '^p([0-9]+)', 1) AS INT) AS field,
  CAST(regexp_extract(name, '_i([0-9]+)', 1) AS INT) AS instance, CAST(regexp_extract(name, '_a([0-9]+)', 1) AS INT) AS "array"
FROM fx_field_dictionary WHERE {where} ORDER BY field, instance, "array" """

_PARTICIPANT_COLUMNS = [
    "eid", "p20002_i0_a0", "p20002_i0_a1", "p20002_i1_a0", *_MORE, "p20001_i0_a0", "p20001_i1_a0",
    "p20003_i0_a0", "p20003_i1_a0", "p20004_i0_a0", "p31",
]

_LINEITEM_COLUMNS = [
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
    "l_returnflag", "l_linestatus", "l_shipdate",
]

SQL = {
    "gp_by_codes": _GP.format(where=_FROZEN_SHOULDER),
    "gp_all": _GP.format(where="data_provider IN (1, 2)"),
    "gp_longitudinal": _GP.format(where="read_2 = '22K..' OR read_3 = '22K..'"),
    "opcs_by_codes": _OPCS.format(where="regexp_matches(oper3, 'W78|81') OR regexp_matches(oper4, 'W78|81')"),
    "icd10_by_codes": _icd10("regexp_matches(d.diag_icd10, 'E10|E11')"),
    "icd10_by_prefix": _icd10("d.diag_icd10 LIKE 'E113%' OR d.diag_icd10 LIKE 'M750%'"),
    "icd10_by_code_index": _icd10("regexp_matches(d.diag_icd10, 'E1[01]|^C5.$')"),
    "opcs_code_counts": """
SELECT oper4 AS code, CAST(count(*) AS BIGINT) AS entries FROM fx_hesin_oper WHERE regexp_matches(oper4, 'W7[0-4]|9$') GROUP BY oper4""",
    "icd9_by_codes": _icd9("regexp_matches(d.diag_icd9, '250')"),
    "selfreport_illness": _selfreport(_ILLNESS, "1222"),
    "selfreport_no_match": _selfreport(_ILLNESS, "9999"),
    "selfreport_cancer": _selfreport(_CANCER, "1002"),
    "selfreport_treatment": _selfreport(_TREATMENT, "2003"),
    "selfreport_operation": _SELF.format(
        where="""EXISTS (
  SELECT 1 FROM (SELECT coding, min(meaning) AS meaning FROM fx_coding WHERE coding > 1 AND coding IN (2, 17)
    GROUP BY coding) m WHERE regexp_matches(p20004_i0_a0, m.meaning))"""
    ),
    "criteria_any_all": f"""
SELECT * FROM fx_selfreport_participant
WHERE ({" OR ".join(f"{name} = '1222'" for name in _ILLNESS)}) AND p31 = 'BUILDING'""",
    "gp_scripts_by_codes": " UNION ALL ".join(
        f"""
SELECT eid, data_provider, TRY_CAST(issue_date AS DATE) AS issue_date, read_2, dmd_code, bnf_code, drug_name, quantity
FROM fx_gp_scripts WHERE {name} IN ('3000', '3003', 'f4...', '06.01.03')"""
        for name in ("dmd_code", "read_2", "bnf_code")
    ),
    "death_by_codes": _DEATH,
    "cancer_registry": f"""
SELECT c.eid, c.reg_date, c.site, c.age, c.histology, c.behaviour, b.dob, b.assess_date,
  datediff('day', b.dob, c.reg_date) / CAST(365.25 AS DOUBLE) AS diag_age,
  COALESCE(c.reg_date < b.assess_date, FALSE) AS prev, c.histology || '/' || c.behaviour AS code,
  i.histology AS description
FROM ({_CANCER_LONG}) c JOIN fx_baseline b ON b.eid = c.eid
LEFT JOIN fx_icdo3 i ON i.code = c.histology || '/' || c.behaviour
WHERE regexp_matches(c.site, 'C61|C5')""",
    "ordered_records": _ORDERED,
    "first_occurrence_records": _FIRST_GP,
    "first_occurrence_sources": _FIRST_SOURCES,
    "age_groups": _age_groups(
        "SELECT eid, round(datediff('day', dob, assess_date) / CAST(365.25 AS DOUBLE)) AS age FROM fx_baseline", 10
    ),
    "diagnosis_age_groups": _age_groups(
        _age_at_first(f"""SELECT eid, epistart AS diag_date FROM ({_icd10("regexp_matches(d.diag_icd10, 'E10|E11')")}) h"""), 5
    ),
    "timeline_age_groups": _age_groups(
        _age_at_first(
            f"""SELECT eid, event_dt AS diag_date FROM ({_GP.format(where=_FROZEN_SHOULDER)}) g
    UNION ALL SELECT eid, opdate FROM ({_OPCS.format(where="oper3 LIKE '%W78%' OR oper4 LIKE '%W78%'")}) o
    UNION ALL SELECT eid, epistart FROM ({_icd10("d.diag_icd10 LIKE '%M750%'")}) h"""
        ),
        10,
    ),
    "genetic_score": f"""
WITH calls AS ({_CALLS}),
means AS (SELECT chrom, pos, avg(calls) AS mean FROM calls GROUP BY chrom, pos)
SELECT eid, sum(weight * COALESCE(calls, mean, 0)) / (2 * count(*)) AS score
FROM calls JOIN means USING (chrom, pos) GROUP BY eid""",
    "genetic_score_drop_missing": f"""
SELECT eid, sum(weight * calls) / (2 * count(*)) AS score
FROM ({_CALLS}) c WHERE calls IS NOT NULL GROUP BY eid""",
    "source_case_rates": _RATES,
    "source_case_rates_by_row": f"""
SELECT source, cases, n, cases / CAST(n AS DOUBLE) AS case_rate FROM (
  SELECT 'HES' AS source, (SELECT CAST(count(DISTINCT eid) AS BIGINT) FROM ({_icd10("regexp_matches(d.diag_icd10, 'E10|E11')")}) h) AS cases,
    (SELECT CAST(count(DISTINCT eid) AS BIGINT) FROM fx_hesin) AS n
  UNION ALL SELECT 'GP', (SELECT CAST(count(DISTINCT eid) AS BIGINT) FROM ({_GP.format(where=_FROZEN_SHOULDER)}) g),
    (SELECT CAST(count(DISTINCT eid) AS BIGINT) FROM fx_gp_clinical)) s""",
    # The quantiles are those of alpha = 1e-9 and 0.05, two-sided.
    "association_power": _power([1.5, 2, 3], 6.109410204869, "/"),
    "association_power_multiplied": _power([0.5, 1.2, 4], 1.959963984540054, "*"),
    "association_solve": _solve(),
    "extract_fields": "SELECT eid, "
    + ", ".join(f'{name} AS "Title of {name}"' for name in [*_ILLNESS, *_TREATMENT])
    + " FROM fx_selfreport_participant",
    "append_fields": "SELECT eid, p31, p20002_i0_a0, p20001_i0_a0, p20004_i0_a0 FROM fx_selfreport_participant",
    "fields_for_id": _FIELDS.format(where="regexp_matches(name, '^p20001(_i[0-9]+)?(_a[0-9]+)?$')"),
    "fields_by_keyword": _FIELDS.format(where="contains(lower(title), 'widget array')"),
    "null_profile": " UNION ALL ".join(
        f"SELECT '{name}' AS \"column\", CAST(count(*) - count({name}) AS BIGINT) AS nulls FROM fx_selfreport_participant"
        for name in _PARTICIPANT_COLUMNS
    ),
    "null_profile_stored": " UNION ALL ".join(
        f"SELECT '{name}' AS \"column\", CAST(count(*) - count({name}) AS BIGINT) AS nulls FROM lineitem" for name in _LINEITEM_COLUMNS
    ),
    "drop_all_null": """
SELECT dnx_hesin_diag_id, eid, ins_index, arr_index, level, diag_icd9, diag_icd10 FROM fx_hesin_diag""",
}

_CLINICAL = ("eid", "data_provider", "event_dt", "read_2", "read_3", "value1", "value2", "value3")

# Sources and sinks: what was written is what is read.
SQL |= {
    "tsv_text": f"SELECT {', '.join(f'CAST({c} AS VARCHAR) AS {c}' for c in _CLINICAL)} FROM fx_gp_clinical",
    "tsv_typed": _GP.format(where="read_2 = '22K..' OR read_3 = '22K..'"),
    "trait_list": "SELECT name AS Code, kind FROM fx_field_dictionary, (VALUES ('plain'), ('table')) k(kind)",
    "csv_headerless": " UNION ALL ".join(
        f"""
SELECT eid, data_provider, TRY_CAST(issue_date AS DATE) AS issue_date, read_2, dmd_code, bnf_code, drug_name, quantity
FROM fx_gp_scripts WHERE {name} IN ('3000', 'f4...')"""
        for name in ("dmd_code", "read_2", "bnf_code")
    ),
    "csv_with_header": "SELECT * FROM fx_death",
    "score_report": "SELECT eid, sum(COALESCE(allele1_count, 0)) / CAST(64 AS DOUBLE) AS score FROM fx_genotypes GROUP BY eid",
    "score_file": f"SELECT eid, sum(weight * calls) / (2 * count(*)) AS score FROM ({_CALLS}) c WHERE calls IS NOT NULL GROUP BY eid",
    "parquet_by_chromosome": """
SELECT chrom, pos, CAST(count(*) AS BIGINT) AS calls, CAST(sum(allele1_count) AS BIGINT) AS alleles
FROM fx_genotypes WHERE chrom IN (3, 4) GROUP BY chrom, pos""",
    "column_dictionary": " UNION ALL ".join(
        f"SELECT '{name}' AS name, 'Title of {name}' AS title, CAST(count(*) AS BIGINT) AS rows FROM fx_selfreport_participant" for name in _PARTICIPANT_COLUMNS
    ),
    "write_if_absent": "SELECT coding, meaning FROM fx_coding",
    "extended_versions": "SELECT eid, p31, p20001_i0_a0, p20001_i1_a0, p20003_i1_a0, 2 AS version FROM fx_selfreport_participant",
    "manifest": "SELECT b.eid, b.dob, d.date_of_death FROM fx_baseline b JOIN fx_death d ON b.eid = d.eid",
}


def oracle(name: str) -> str:
    """The SQL of a query with the record tables it uses as leading common table expressions."""
    body = SQL[name].strip()
    used = [fixture for fixture in FIXTURES if re.search(rf"\b{fixture}\b", body)]
    tables = ",\n".join(f"{fixture} AS ({fixture_sql(fixture)})" for fixture in used)
    if not used:
        return body
    return f"WITH {tables}\nSELECT * FROM (\n{body}\n) result"


def registered() -> dict[str, str]:
    return {name: oracle(name) for name in SQL}
