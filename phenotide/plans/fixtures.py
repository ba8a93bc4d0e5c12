"""Health-record tables derived from the test tables.

Each text runs unchanged in Spark and DuckDB; ``{orders}`` and so on stand for the test tables.
Every table is derived from all rows of its test tables, so its size grows with them.
"""

from __future__ import annotations

from string import Formatter

from pyspark.sql import DataFrame, SparkSession

# Instances of a cancer registration; the first is always filled, the others for some participants.
CANCER_INSTANCES = 22


def _cancer_columns() -> str:
    filled = ["TRUE", *(f"c_custkey % {i + 3} = 0" for i in range(1, CANCER_INSTANCES))]
    values = {
        "p40005": "CAST(date'1990-01-01' + CAST((c_custkey * 17 + {i} * 397) % 4000 AS INT) AS STRING)",
        "p40006": "concat('C', CAST(50 + (c_custkey + {i} * 11) % 40 AS STRING))",
        "p40008": "CAST(40 + (c_custkey + {i}) % 30 AS DOUBLE)",
        "p40011": "CAST(8000 + (c_nationkey + {i}) % 25 AS STRING)",
        "p40012": "CASE WHEN (c_custkey + {i}) % 13 <> 0 THEN CAST((c_custkey + {i}) % 4 AS STRING) END",
    }
    return ",\n          ".join(
        f"CASE WHEN {filled[i]} THEN {value.format(i=i)} END AS {field}_i{i}"
        for field, value in values.items()
        for i in range(CANCER_INSTANCES)
    )


# Further illness columns of the wide table, as (instance, array).
MORE_ILLNESSES = [(2, a) for a in range(5)] + [(3, a) for a in range(4)]


def _illness_columns() -> str:
    return "".join(
        f"""
          CASE WHEN c_custkey % {19 + 4 * i + a} = 0 THEN CAST(1220 + (c_custkey + {a}) % 9 AS STRING) END AS p20002_i{i}_a{a},"""
        for i, a in MORE_ILLNESSES
    )


FIXTURES = {
    # One row per participant.
    "fx_baseline": """
        SELECT c_custkey AS eid,
          date'1935-01-01' + CAST((c_custkey * 7919) % 14000 AS INT) AS dob,
          date'1997-06-01' + CAST((c_custkey * 31) % 900 AS INT) AS assess_date
        FROM {customer}""",
    # Hospital episodes: null, impossible and missing dates, bad durations, text keys.
    "fx_hesin": """
        SELECT concat('H', CAST(o_orderkey AS STRING)) AS dnx_hesin_id, CAST(o_custkey AS STRING) AS eid,
          CAST(o_orderkey AS STRING) AS ins_index,
          CASE WHEN o_orderkey % 11 = 0 THEN NULL WHEN o_orderkey % 13 = 0 THEN '1994-02-30'
            ELSE CAST(CAST(o_orderdate AS DATE) AS STRING) END AS epistart,
          CASE WHEN o_orderkey % 7 = 0 OR o_orderkey % 33 = 0 THEN NULL
            ELSE CAST(CAST(o_orderdate AS DATE) + CAST(o_orderkey % 15 AS INT) AS STRING) END AS epiend,
          CASE WHEN o_orderkey % 17 = 0 THEN 'x' WHEN o_orderkey % 19 = 0 THEN NULL
            ELSE CAST(o_orderkey % 15 AS STRING) END AS epidur,
          CAST(o_orderkey % 366 AS STRING) AS bedyear, o_orderpriority AS admimeth
        FROM {orders}""",
    # Hospital diagnoses, nine columns in the order of the positional rename.
    "fx_hesin_diag": """
        SELECT concat('D', CAST(l_orderkey AS STRING), '-', CAST(l_linenumber AS STRING), '-',
            CAST(l_partkey AS STRING), '-', CAST(l_suppkey AS STRING)) AS dnx_hesin_diag_id,
          CAST(o_custkey AS BIGINT) AS eid, l_orderkey AS ins_index, CAST(l_linenumber AS BIGINT) AS arr_index,
          CASE WHEN l_linenumber = 1 THEN 1 ELSE 2 END AS level,
          CASE WHEN l_partkey % 6 = 0 THEN concat('250', CAST(l_partkey % 10 AS STRING)) END AS diag_icd9,
          CAST(NULL AS STRING) AS diag_icd9_nb,
          CASE l_partkey % 6 WHEN 1 THEN concat('E10', CAST(l_partkey % 10 AS STRING))
            WHEN 2 THEN concat('E11', CAST(l_partkey % 10 AS STRING)) WHEN 3 THEN 'M750'
            WHEN 4 THEN concat('C', CAST(50 + l_partkey % 40 AS STRING)) WHEN 5 THEN 'XE109' END AS diag_icd10,
          CAST(NULL AS STRING) AS diag_icd10_nb
        FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey""",
    # Operations, with dates in several formats.
    "fx_hesin_oper": """
        SELECT concat('O', CAST(l_orderkey AS STRING), '-', CAST(l_linenumber AS STRING), '-',
            CAST(l_partkey AS STRING), '-', CAST(l_suppkey AS STRING)) AS dnx_hesin_oper_id,
          CAST(o_custkey AS STRING) AS eid, CAST(l_orderkey AS STRING) AS ins_index,
          CAST(l_linenumber AS STRING) AS arr_index,
          CASE WHEN l_orderkey % 10 = 0 THEN NULL WHEN l_orderkey % 12 = 0 THEN 'not a date'
            WHEN l_linenumber = 2 THEN replace(shipped, '-', '/')
            WHEN l_linenumber = 3 THEN concat(substr(shipped, 9, 2), '-', substr(shipped, 6, 2), '-', substr(shipped, 1, 4))
            WHEN l_linenumber = 4
              THEN concat(substr(shipped, 9, 2), '/', substr(shipped, 6, 2), '/', substr(shipped, 1, 4), ' 10:11:12')
            ELSE shipped END AS opdate,
          CASE WHEN l_linenumber = 1 THEN 1 ELSE 2 END AS level,
          CASE WHEN l_suppkey % 5 = 0 THEN concat('81', CAST(l_suppkey % 10 AS STRING)) END AS oper3,
          CAST(NULL AS STRING) AS oper3_nb,
          CASE WHEN l_suppkey % 5 = 0 THEN NULL
            ELSE concat('W', CAST(70 + l_suppkey % 20 AS STRING), CAST(l_partkey % 10 AS STRING)) END AS oper4,
          CAST(NULL AS STRING) AS oper4_nb, CAST(l_partkey % 9 AS STRING) AS posopdur,
          CAST(l_partkey % 4 AS STRING) AS preopdur
        FROM (SELECT *, CAST(CAST(l_shipdate AS DATE) AS STRING) AS shipped FROM {lineitem}) dated
        JOIN {orders} ON l_orderkey = o_orderkey""",
    # Primary-care events: one of read_2 and read_3, values that are no numbers.
    "fx_gp_clinical": """
        SELECT user_id AS eid, CAST(event_id % 4 + 1 AS INT) AS data_provider,
          CASE WHEN event_id % 23 = 0 THEN NULL WHEN event_id % 29 = 0 THEN '2024-13-01'
            ELSE CAST(CAST(ts AS DATE) AS STRING) END AS event_dt,
          CASE WHEN event_id % 3 = 0 THEN CASE event_type WHEN 'click' THEN '22K..' WHEN 'view' THEN 'C10..'
            WHEN 'purchase' THEN 'N210.' ELSE '1371.' END END AS read_2,
          CASE WHEN event_id % 3 <> 0 THEN CASE event_type WHEN 'click' THEN '22K..' WHEN 'view' THEN 'X40J4'
            WHEN 'purchase' THEN 'XE1FL' WHEN 'error' THEN 'XE1Hm' ELSE 'XE2eD' END END AS read_3,
          CASE WHEN event_id % 31 = 0 THEN 'OPR001' ELSE CAST(value AS STRING) END AS value1,
          CASE WHEN event_id % 5 = 0 THEN CAST(event_id % 100 AS STRING) END AS value2,
          CASE WHEN event_id % 37 = 0 THEN 'MEA000' END AS value3
        FROM {events}""",
    # Prescriptions; a row may carry up to three codes.
    "fx_gp_scripts": """
        SELECT o_custkey AS eid, CAST(o_orderkey % 4 + 1 AS INT) AS data_provider,
          CASE WHEN o_orderkey % 41 = 0 THEN NULL ELSE CAST(CAST(o_orderdate AS DATE) AS STRING) END AS issue_date,
          CASE WHEN o_orderkey % 2 = 0 THEN concat('f', CAST(o_orderkey % 8 AS STRING), '...') END AS read_2,
          CASE WHEN o_orderkey % 3 = 0 THEN CAST(3000 + o_orderkey % 12 AS STRING) END AS dmd_code,
          CASE WHEN o_orderkey % 5 = 0 THEN concat('06.01.0', CAST(o_orderkey % 9 AS STRING)) END AS bnf_code,
          concat('drug ', o_orderpriority) AS drug_name, CAST(o_orderkey % 60 AS STRING) AS quantity
        FROM {orders}""",
    # Wide self-report table.
    "fx_selfreport_participant": """
        SELECT CAST(c_custkey AS STRING) AS eid, CAST(1220 + c_custkey % 7 AS STRING) AS p20002_i0_a0,
          CASE WHEN c_custkey % 3 = 0 THEN CAST(1220 + c_custkey % 5 AS STRING) END AS p20002_i0_a1,
          CASE WHEN c_custkey % 4 = 0 THEN CAST(1222 + c_custkey % 11 AS STRING) END AS p20002_i1_a0,"""
    + _illness_columns()
    + """
          CASE WHEN c_custkey % 8 = 0 THEN CAST(1001 + c_custkey % 6 AS STRING) END AS p20001_i0_a0,
          CASE WHEN c_custkey % 16 = 0 THEN CAST(1002 + c_custkey % 6 AS STRING) END AS p20001_i1_a0,
          CASE WHEN c_custkey % 2 = 0 THEN CAST(2000 + c_nationkey AS STRING) END AS p20003_i0_a0,
          CASE WHEN c_custkey % 6 = 0 THEN CAST(2001 + c_nationkey AS STRING) END AS p20003_i1_a0,
          CASE WHEN c_custkey % 5 = 0 THEN concat('NATION_', CAST(c_nationkey AS STRING)) END AS p20004_i0_a0,
          c_mktsegment AS p31
        FROM {customer}""",
    "fx_coding": """
        SELECT CAST(n_nationkey + 0 AS INT) AS coding, n_name AS meaning
        FROM {nation}""",
    "fx_death": """
        SELECT concat('X', CAST(c_custkey AS STRING)) AS dnx_death_id, c_custkey AS eid, 0 AS ins_index,
          'E/W' AS dsource, c_mktsegment AS source,
          CASE WHEN c_custkey % 63 = 0 THEN NULL
            ELSE CAST(date'1996-01-01' + CAST((c_custkey * 13) % 2000 AS INT) AS STRING) END AS date_of_death
        FROM {customer}""",
    # Causes of death, several per death.
    "fx_death_cause": """
        SELECT concat('X', CAST(o_custkey AS STRING), '-', CAST(o_orderkey AS STRING)) AS dnx_death_cause_id,
          o_custkey AS eid, 0 AS ins_index, CAST(o_orderkey % 5 AS INT) AS arr_index,
          CASE WHEN o_orderkey % 5 = 0 THEN 1 ELSE 2 END AS level,
          concat(CASE (o_custkey + o_orderkey) % 3 WHEN 0 THEN 'E10' WHEN 1 THEN 'I21' ELSE 'C61' END,
            CAST(o_custkey % 10 AS STRING)) AS cause_icd10
        FROM {orders}""",
    # Wide cancer registry.
    "fx_cancer_participant": f"""
        SELECT c_custkey AS eid,
          {_cancer_columns()}
        FROM {{customer}}""",
    # Histology dictionary: a text per histology and behaviour; some codes are unknown.
    "fx_icdo3": " UNION ALL ".join(
        f"""
        SELECT concat(CAST(8000 + n_nationkey AS STRING), '/{behaviour}') AS code, concat(n_name, ', {name}') AS histology
        FROM {{nation}} WHERE n_nationkey < 20"""
        for behaviour, name in ((0, "benign"), (2, "in situ"), (3, "malignant"))
    ),
    # Long genotypes, one row per participant and variant; chromosomes 1 to 23. All calls of a variant that
    # lacks some are equal, so that their mean is exact and the order of sums does not matter.
    "fx_genotypes": """
        SELECT o_custkey AS eid, CAST(l_partkey % 23 + 1 AS INT) AS chrom, 1000 + l_partkey * 10 AS pos,
          'A' AS allele1, 'G' AS allele2,
          CASE WHEN l_partkey % 4 <> 0 THEN CAST((o_custkey * 7 + l_partkey * 5) % 3 AS INT)
            WHEN (o_custkey * 31 + l_partkey * 17) % 7 = 0 THEN NULL
            ELSE CAST(l_partkey * 5 % 3 AS INT) END AS allele1_count
        FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey
        GROUP BY o_custkey, l_partkey""",
    # Score weights; some alleles do not fit. Weights are n/64, so that sums are exact.
    "fx_score_file": """
        SELECT CAST(p_partkey % 23 + 1 AS INT) AS chrom, 1000 + p_partkey * 10 AS pos,
          CASE WHEN p_partkey % 2 = 0 THEN 'G' ELSE 'A' END AS other_allele,
          CASE WHEN p_partkey % 7 = 0 THEN 'T' WHEN p_partkey % 2 = 0 THEN 'A' ELSE 'G' END AS effect_allele,
          CAST(p_size - 25 AS DOUBLE) / 64 AS weight
        FROM {part}""",
    "fx_variants": """
        SELECT p_partkey AS variant_id, CAST(p_size AS DOUBLE) / 1000 AS maf
        FROM {part}""",
    # Field dictionary: 50 fields, 8 instances, as many array columns as the part table gives.
    "fx_field_dictionary": """
        SELECT concat('p', CAST(20000 + p_partkey % 50 AS STRING), '_i',
            CAST(CAST(floor(p_partkey / 50) AS BIGINT) % 8 AS STRING), '_a',
            CAST(CAST(floor(p_partkey / 400) AS BIGINT) AS STRING)) AS name,
          concat('Field ', p_name, ' array ', CAST(CAST(floor(p_partkey / 400) AS BIGINT) AS STRING)) AS title
        FROM {part} UNION ALL SELECT 'eid' AS name, 'Participant' AS title FROM {part} WHERE p_partkey = 0""",
}


def _tables(text: str) -> list[str]:
    return sorted({field for _, field, _, _ in Formatter().parse(text) if field})


class Tables:
    """The test tables of one folder and the record tables derived from them, each built once.

    ``tables.read("orders")`` is a test table, ``tables.hesin`` the record table ``fx_hesin``.
    """

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir
        self._known: dict[str, DataFrame] = {}

    def read(self, table: str) -> DataFrame:
        if table not in self._known:
            self._known[table] = self.spark.read.parquet(f"{self.sf_dir}/{table}.parquet")
        return self._known[table]

    def __getattr__(self, name: str) -> DataFrame:
        fixture = f"fx_{name}"
        if fixture not in FIXTURES:
            raise AttributeError(name)
        if fixture not in self._known:
            text = FIXTURES[fixture]
            self._known[fixture] = self.spark.sql(text, **{table: self.read(table) for table in _tables(text)})
        return self._known[fixture]


def fixture_sql(name: str) -> str:
    """A record table as SQL over the plain table names."""
    text = FIXTURES[name]
    return text.format(**{table: table for table in _tables(text)})
