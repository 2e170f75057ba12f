"""DuckDB-runnable SQL twins of the registered queries.

Each string starts with the fixture views (admissions, hospitals_dim,
vitals) as CTEs over the driver's pre-registered tables, then the query.
Column names and types are aligned with the Spark results (counts and
sums cast to BIGINT, ratios to DOUBLE).
"""

from __future__ import annotations

ADMISSIONS_SQL = """
SELECT CAST(o_custkey AS VARCHAR) AS patient_id,
       CASE WHEN p_size <= 5 THEN '0-10' WHEN p_size <= 10 THEN '11-20' WHEN p_size <= 15 THEN '21-30'
            WHEN p_size <= 20 THEN '31-40' WHEN p_size <= 25 THEN '41-50' WHEN p_size <= 30 THEN '51-60'
            WHEN p_size <= 35 THEN '61-70' WHEN p_size <= 40 THEN '71-80' WHEN p_size <= 45 THEN '81-90'
            ELSE '90+' END AS age_band,
       CASE WHEN l_linestatus = 'F' THEN 'F' ELSE 'M' END AS gender,
       r_name AS region,
       CAST(l_suppkey AS VARCHAR) AS hospital_id,
       p_type AS disease,
       CAST(l_shipdate AS DATE) AS admission_date,
       CAST(YEAR(l_shipdate) AS INT) AS year,
       CASE WHEN l_returnflag = 'R' THEN 'Yes' ELSE 'No' END AS readmitted,
       l_extendedprice AS treatment_cost
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
     JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
     JOIN part ON l_partkey = p_partkey
"""

HOSPITALS_SQL = """
SELECT CAST(s_suppkey AS VARCHAR) AS hospital_id, s_name AS hospital_name,
       CAST(50 + s_suppkey % 10 * 25 AS INT) AS bed_count,
       CASE s_nationkey % 3 WHEN 0 THEN 'Public' WHEN 1 THEN 'Private' ELSE 'Teaching' END AS hospital_type
FROM supplier
"""

VITALS_SQL = """
SELECT event_id, user_id AS patient_id, ts, value AS heart_rate,
       CAST(85 + 0.15 * CAST(json_extract_string(props, '$.k') AS INT) AS DOUBLE) AS oxygen_level
FROM events
"""

PREFIX = (f"WITH admissions AS ({ADMISSIONS_SQL}),\n"
          f"hospitals_dim AS ({HOSPITALS_SQL}),\n"
          f"vitals AS ({VITALS_SQL})\n")


def q(body: str) -> str:
    body = body.strip()
    if body[:4].upper() == "WITH":
        return PREFIX.rstrip() + ",\n" + body[4:].lstrip()
    return PREFIX + body


SQL: dict[str, str] = {}

SQL["readmission_rates"] = q("""
SELECT region, disease, COUNT(patient_id) AS total_admissions,
       CAST(SUM(CASE WHEN readmitted = 'Yes' THEN 1 ELSE 0 END) AS BIGINT) AS readmitted_count,
       ROUND(CAST(SUM(CASE WHEN readmitted = 'Yes' THEN 1 ELSE 0 END) AS DOUBLE) / COUNT(patient_id), 4)
           AS readmission_rate
FROM admissions GROUP BY region, disease
""")

SQL["disease_frequency"] = q("""
SELECT region, age_band, disease, COUNT(*) AS cases FROM admissions GROUP BY region, age_band, disease
""")

SQL["yearly_disease_counts"] = q("""
SELECT year, disease, COUNT(*) AS cases FROM admissions GROUP BY year, disease
""")

_DAY_TYPE = "CASE WHEN isodow(admission_date) >= 6 THEN 'Weekend' ELSE 'Weekday' END"

SQL["weekend_readmission"] = q(f"""
SELECT disease, {_DAY_TYPE} AS day_type, COUNT(*) AS total_admissions,
       CAST(SUM(CASE WHEN lower(readmitted) = 'yes' THEN 1 ELSE 0 END) AS BIGINT) AS readmitted_count,
       ROUND(CAST(SUM(CASE WHEN lower(readmitted) = 'yes' THEN 1 ELSE 0 END) AS DOUBLE) / COUNT(*), 4)
           AS readmission_rate
FROM admissions WHERE try_strptime(CAST(admission_date AS VARCHAR), '%Y-%m-%d') IS NOT NULL
GROUP BY disease, day_type
""")

SQL["weekend_compare"] = q(f"""
WITH t AS (SELECT disease, {_DAY_TYPE} AS day_type,
                  CASE WHEN lower(readmitted) = 'yes' THEN 1 ELSE 0 END AS y FROM admissions)
SELECT disease,
       ROUND(CAST(SUM(CASE WHEN day_type = 'Weekday' THEN y END) AS DOUBLE)
             / COUNT(CASE WHEN day_type = 'Weekday' THEN 1 END), 4) AS weekday_rate,
       ROUND(CAST(SUM(CASE WHEN day_type = 'Weekend' THEN y END) AS DOUBLE)
             / COUNT(CASE WHEN day_type = 'Weekend' THEN 1 END), 4) AS weekend_rate
FROM t GROUP BY disease
""")

SQL["avg_cost"] = q("""
SELECT (SELECT min(hospital_type) FROM hospitals_dim d WHERE d.hospital_id = a.hospital_id) AS hospital_type, disease,
       CAST(SUM(CAST(treatment_cost AS DECIMAL(38,2))) AS DOUBLE) / COUNT(treatment_cost) AS avg_cost
FROM admissions a WHERE hospital_id IN (SELECT hospital_id FROM hospitals_dim) GROUP BY ALL
""")

SQL["cases_by_region_year"] = q("""
SELECT region, year, disease, COUNT(patient_id) AS total_cases FROM admissions GROUP BY region, year, disease
""")

SQL["yoy_growth"] = q("""
WITH n AS (SELECT region, year, disease, COUNT(patient_id) AS total_cases,
                  ROW_NUMBER() OVER (PARTITION BY region, disease ORDER BY year) AS k
           FROM admissions GROUP BY region, year, disease)
SELECT n.region, n.year, n.disease, n.total_cases, p.total_cases AS prev_year_cases,
       n.total_cases - p.total_cases AS yoy_difference
FROM n LEFT JOIN n p ON p.region = n.region AND p.disease = n.disease AND p.k = n.k - 1
""")

SQL["regional_burden"] = q("""
SELECT region, COUNT(*) AS cases FROM admissions GROUP BY region
""")

# --- upload path ------------------------------------------------------------

from ..sources.fixtures import DISEASES  # noqa: E402

# The calendar years of the fixture's ship dates (the oracle
# spells the pivot columns out; the Spark side discovers them).
FIXTURE_YEARS = list(range(1995, 2002))
from ..functions.scalars import POSITIVE_TARGET_VALUES  # noqa: E402

_POS = ", ".join(f"'{v}'" for v in POSITIVE_TARGET_VALUES)
_UPLOADED = f"""uploaded AS (
  SELECT patient_id, age_band, gender, region, hospital_id, disease, admission_date AS time_var, year,
         readmitted AS target, treatment_cost,
         CAST(CASE WHEN readmitted IN ({_POS}) THEN 1.0 ELSE 0.0 END AS DOUBLE) AS is_target
  FROM admissions)"""

SQL["role_map"] = q("""
SELECT patient_id, age_band, gender, region, hospital_id, disease, admission_date AS time_var, year,
       readmitted AS target, treatment_cost
FROM admissions
""")

SQL["flag_in_set"] = q(f"""
WITH {_UPLOADED}
SELECT target, is_target, COUNT(*) AS n FROM uploaded GROUP BY target, is_target
""")

_REQUIRED = ["patient_id", "age_band", "gender", "region", "hospital_id", "disease", "admission_date",
             "year", "readmitted", "treatment_cost"]
SQL["required_columns"] = q("\nUNION ALL\n".join(
    [f"""SELECT '{c}' AS "column", true AS present, COUNT({c}) AS non_null_count FROM admissions"""
     for c in _REQUIRED]
    + ["""SELECT 'discharge_date' AS "column", false AS present, CAST(0 AS BIGINT) AS non_null_count"""]))

SQL["kpis"] = q(f"""
WITH {_UPLOADED},
dc AS (SELECT disease, COUNT(*) AS n FROM uploaded GROUP BY disease)
SELECT format('{{:,}}', (SELECT COUNT(*) FROM uploaded)) AS total_records_processed,
       (SELECT COUNT(*) FROM (SELECT DISTINCT region FROM uploaded)) AS regions_analyzed,
       COALESCE((SELECT disease FROM dc ORDER BY n DESC, disease NULLS FIRST LIMIT 1), 'Unknown') AS top_disease,
       COALESCE(printf('%.1f%%', (SELECT AVG(is_target) FROM uploaded) * 100.0), '0%') AS avg_readmission_rate
""")

SQL["kpi_total"] = q(f"""
WITH {_UPLOADED}
SELECT COUNT(*) AS total_records FROM uploaded
""")

SQL["kpi_regions"] = q(f"""
WITH {_UPLOADED}
SELECT COUNT(*) AS regions_analyzed FROM (SELECT DISTINCT region FROM uploaded)
""")

SQL["kpi_top_disease"] = q(f"""
WITH {_UPLOADED}
SELECT disease AS top_disease, COUNT(*) AS cases FROM uploaded GROUP BY disease
ORDER BY cases DESC, disease NULLS FIRST LIMIT 1
""")

SQL["kpi_target_rate"] = q(f"""
WITH {_UPLOADED}
SELECT COALESCE(printf('%.1f%%', AVG(is_target) * 100.0), '0%') AS avg_readmission_rate FROM uploaded
""")

_TREND_COLS = ",\n       ".join(f"""COUNT(CASE WHEN disease = '{d}' THEN 1 END) AS "{d}" """ for d in DISEASES)
_TREND = f"""SELECT substr(CAST(time_var AS VARCHAR), 1, 4) AS year,
       {_TREND_COLS}
FROM uploaded GROUP BY 1"""

SQL["trend_pivot"] = q(f"""
WITH {_UPLOADED}
{_TREND} ORDER BY year
""")

SQL["order_by_year"] = q(f"""
WITH {_UPLOADED}, t AS ({_TREND})
SELECT *, CAST(ROW_NUMBER() OVER (ORDER BY year) AS BIGINT) AS year_rank FROM t
""")

_RATE_COLS = ",\n       ".join(
    f"""COALESCE(ROUND(AVG(CASE WHEN disease = '{d}' THEN is_target END), 2), 0.0) AS "{d}" """ for d in DISEASES)
SQL["rate_pivot"] = q(f"""
WITH {_UPLOADED}
SELECT region,
       {_RATE_COLS}
FROM uploaded GROUP BY region
""")

SQL["distinct"] = q("""
SELECT DISTINCT region FROM admissions
""")

SQL["top_1"] = q("""
SELECT year, disease, COUNT(*) AS cases FROM admissions GROUP BY year, disease
ORDER BY cases DESC, year, disease LIMIT 1
""")

SQL["preview_n"] = q("""
SELECT region, disease, COUNT(patient_id) AS total_admissions,
       CAST(SUM(CASE WHEN readmitted = 'Yes' THEN 1 ELSE 0 END) AS BIGINT) AS readmitted_count,
       ROUND(CAST(SUM(CASE WHEN readmitted = 'Yes' THEN 1 ELSE 0 END) AS DOUBLE) / COUNT(patient_id), 4)
           AS readmission_rate
FROM admissions GROUP BY region, disease ORDER BY region, disease LIMIT 5
""")

SQL["order_by_cost"] = SQL["avg_cost"].replace(
    "SELECT (SELECT min", "SELECT *, ROW_NUMBER() OVER (ORDER BY avg_cost DESC, hospital_type, disease) AS cost_rank FROM (SELECT (SELECT min"
).rstrip() + ")"

# --- scalar functions and rules ----------------------------------------------

SQL["scalar_functions"] = q("""
SELECT region || '|' || disease AS region_disease_key,
       substr(CAST(admission_date AS VARCHAR), 1, 4) AS year_text,
       CAST(year(admission_date) AS INT) AS year_of_date,
       CASE WHEN isodow(admission_date) >= 6 THEN 'Weekend' ELSE 'Weekday' END AS day_type,
       CAST(try_strptime(strftime(admission_date, '%Y-%m-%d'), '%Y-%m-%d') AS DATE) AS parsed_date,
       strftime(admission_date, '%Y-%m-%d') AS date_text,
       CAST(admission_date + INTERVAL 30 DAY AS DATE) AS followup_date,
       printf('HOSP_%03d', TRY_CAST(hospital_id AS INTEGER)) AS hospital_code,
       TRY_CAST(hospital_id AS DOUBLE) AS hospital_num,
       lower(readmitted) = 'yes' AS readmitted_ci,
       contains(lower(disease), 'large') AS is_large,
       format('{:,}', CAST(floor(treatment_cost) AS BIGINT)) AS cost_text,
       CASE WHEN readmitted = 'Yes' THEN 1 ELSE 0 END AS readmit_flag
FROM admissions
""")

SQL["risk_rule_prior"] = q("""
WITH s AS (
  SELECT age_band, disease, readmitted,
         CASE WHEN isodow(admission_date) >= 6 THEN 'Weekend' ELSE 'Weekday' END AS day_type,
         CAST(0.15 + CASE WHEN age_band IN ('71-80', '81-90', '90+') THEN 0.10 ELSE 0 END
                   + CASE WHEN disease IN ('ECONOMY', 'PROMO', 'STANDARD') THEN 0.05 ELSE 0 END
                   + CASE WHEN isodow(admission_date) >= 6 THEN 0.08 ELSE 0 END AS DECIMAL(10,2)) AS prior_risk
  FROM admissions)
SELECT age_band, disease, day_type, COUNT(*) AS admissions,
       CAST(SUM(prior_risk) AS DOUBLE) / COUNT(*) AS expected_rate,
       CAST(SUM(CASE WHEN readmitted = 'Yes' THEN 1 ELSE 0 END) AS DOUBLE) / COUNT(*) AS observed_rate
FROM s GROUP BY age_band, disease, day_type
""")

SQL["risk_rule_fallback"] = q("""
WITH r AS (
  SELECT age_band, disease,
         LEAST(CAST(0.95 AS DECIMAL(4,2)),
               CASE WHEN disease = 'PROMO' THEN CAST(0.35 AS DECIMAL(4,2)) ELSE CAST(0.15 AS DECIMAL(4,2)) END
               + CASE WHEN contains(age_band, '71') OR contains(age_band, '81')
                      THEN CAST(0.2 AS DECIMAL(4,2)) ELSE CAST(0 AS DECIMAL(4,2)) END) AS risk_dec
  FROM admissions)
SELECT age_band, disease, CAST(risk_dec AS DOUBLE) AS risk,
       printf('%.1f%%', CAST(risk_dec * 100 AS DOUBLE)) AS probability,
       CASE WHEN risk_dec > 0.4 THEN 'High Risk' ELSE 'Low Risk' END AS prediction,
       COUNT(*) AS n
FROM r GROUP BY ALL
""")

SQL["join_dim"] = q("""
SELECT p.hospital_id, p.patient_id, p.disease, p.treatment_cost, h.hospital_name, h.bed_count, h.hospital_type
FROM admissions p JOIN hospitals_dim h ON p.hospital_id = h.hospital_id
""")

# --- sources and sinks ---------------------------------------------------------

SQL["sink_csv"] = q("""
SELECT patient_id || ',' || age_band || ',' || gender || ',' || region || ',' || hospital_id || ',' || disease
       || ',' || CAST(admission_date AS VARCHAR) || ',' || CAST(year AS VARCHAR) || ',' || readmitted
       || ',' || CAST(treatment_cost AS VARCHAR) AS line
FROM admissions
""")

SQL["scan_csv"] = q("SELECT * FROM admissions")

SQL["scan_lines"] = SQL["disease_frequency"]

_RATE_KV = """SELECT region || '|' || disease AS key,
       printf('%d,%d,%.4f', COUNT(*), SUM(CASE WHEN lower(readmitted) = 'yes' THEN 1 ELSE 0 END),
              CAST(SUM(CASE WHEN lower(readmitted) = 'yes' THEN 1 ELSE 0 END) AS DOUBLE) / COUNT(*)) AS value
FROM admissions GROUP BY region, disease"""

SQL["readmission_rates_lines"] = q(_RATE_KV)
SQL["sink_kv_text"] = q(_RATE_KV)
SQL["order_by_key"] = q(f"""
WITH kv AS ({_RATE_KV})
SELECT key, value, CAST(ROW_NUMBER() OVER (ORDER BY key) AS BIGINT) AS line_no FROM kv
""")

SQL["sink_partitioned"] = q("""
SELECT CAST(year AS VARCHAR) AS part_year, region AS part_region, COUNT(*) AS "rows"
FROM admissions GROUP BY ALL
""")

SQL["scan_partitioned"] = q("""
SELECT *, CAST(year AS VARCHAR) AS part_year, region AS part_region FROM admissions
""")

SQL["repair_partitions"] = q("""
SELECT DISTINCT 'part_year=' || CAST(year AS VARCHAR) || '/part_region=' || region AS "partition" FROM admissions
""")

SQL["create_tables"] = SQL["avg_cost"]

SQL["yoy_growth_sql"] = SQL["yoy_growth"].replace("SELECT n.region, n.year,", "SELECT n.region, CAST(n.year AS VARCHAR) AS year,")

SQL["sink_gold_json"] = SQL["kpis"]
SQL["scan_gold_json"] = SQL["trend_pivot"]
SQL["scan_or_default"] = q("""
SELECT 'read' AS source, region, COUNT(*) AS cases FROM admissions GROUP BY region
UNION ALL SELECT s, region, CAST(-1 AS BIGINT) FROM (SELECT DISTINCT region FROM admissions), (VALUES ('missing'), ('broken')) AS t(s)
""")

# --- vitals stream ---------------------------------------------------------------

_FLAGGED = """SELECT *, (COALESCE(heart_rate, 0) > 120 OR COALESCE(oxygen_level, 100) < 90) AS anomaly_detected
FROM vitals"""
# What a message carries: oxygen within its bounds, readings with one decimal.
_MESSAGES = """SELECT strftime(ts, '%H:%M:%S') AS "timestamp", event_id, patient_id, ts, ROUND(heart_rate, 1) AS heart_rate,
       ROUND(LEAST(100.0, GREATEST(85.0, oxygen_level)), 1) AS oxygen_level
FROM vitals"""
_PUSHED = f"""SELECT event_id, patient_id, ts, heart_rate, oxygen_level,
       (COALESCE(heart_rate, 0) > 120 OR COALESCE(oxygen_level, 100) < 90) AS anomaly_detected FROM ({_MESSAGES})"""

SQL["stream_decode"] = q(_MESSAGES)

SQL["stream_anomaly"] = q(_FLAGGED)

SQL["stream_push"] = q(_PUSHED)

SQL["stream_latest_20"] = q(_PUSHED + " ORDER BY ts DESC, event_id DESC LIMIT 20")

SQL["latest_n"] = q(_FLAGGED + " ORDER BY ts DESC, event_id DESC LIMIT 20")

SQL["latest_n_per_key"] = q("""
SELECT * FROM vitals
QUALIFY ROW_NUMBER() OVER (PARTITION BY patient_id ORDER BY ts DESC, event_id DESC) <= 20
""")

# --- models ------------------------------------------------------------------------

SQL["ml_label"] = q("""
SELECT readmitted, CASE WHEN readmitted = 'Yes' THEN 1.0 ELSE 0.0 END::DOUBLE AS label, COUNT(*) AS n
FROM admissions GROUP BY ALL
""")

SQL["ml_index"] = q("\nUNION ALL\n".join(f"""
SELECT '{c}' AS feature, {c} AS value,
       CAST(ROW_NUMBER() OVER (ORDER BY COUNT(*) DESC, {c}) - 1 AS DOUBLE) AS "index"
FROM admissions GROUP BY {c}""" for c in ["age_band", "gender", "disease"]))

SQL["ingest_admissions"] = q("SELECT * FROM admissions")

SQL["project"] = q("SELECT region, age_band, disease FROM admissions")
_N = "CAST(patient_id AS BIGINT)"
_GOOD_DATE = f"{_N} % 7 <> 0 AND {_N} % 13 <> 0"
SQL["filter_malformed"] = q(f"""
SELECT patient_id, age_band, gender, region, hospital_id, disease, CASE WHEN {_GOOD_DATE} THEN admission_date END AS admission_date,
       year, CASE WHEN {_N} % 5 = 0 THEN upper(readmitted) ELSE readmitted END AS readmitted, treatment_cost
FROM admissions WHERE {_N} % 11 <> 0
""")
SQL["filter_bad_date"] = q(f"""
SELECT patient_id, disease, admission_date, {_DAY_TYPE} AS day_type FROM admissions WHERE {_N} % 11 <> 0 AND {_GOOD_DATE}
""")
SQL["sink_kafka"] = SQL["stream_decode"]
SQL["ml_onehot"] = q("\nUNION ALL\n".join(f"""
SELECT feature, value, "index",
       CAST("index" + 1 AS INTEGER) AS hot_position
FROM (SELECT '{c}' AS feature, {c} AS value,
             CAST(ROW_NUMBER() OVER (ORDER BY COUNT(*) DESC, {c}) - 1 AS DOUBLE) AS "index"
      FROM admissions GROUP BY {c})""" for c in ["age_band", "gender", "disease"]))
SQL["process_upload"] = SQL["kpis"]
SQL["run_batch"] = SQL["disease_frequency"]

# --- one query per scalar function and flag ------------------------------------------------

_SCALAR_SQL = {
    "concat_key": "SELECT region, disease, region || '|' || disease AS key FROM admissions",
    "equals_ignore_case": "SELECT readmitted, lower(readmitted) = 'yes' AS is_yes FROM admissions",
    "lower": """SELECT disease, lower(disease) AS disease_lower, contains(lower(disease), 'large') AS mentions_large
                FROM admissions""",
    "year_prefix": "SELECT admission_date, substr(CAST(admission_date AS VARCHAR), 1, 4) AS year_text FROM admissions",
    "year_of": "SELECT admission_date, CAST(year(admission_date) AS INT) AS year_of_date FROM admissions",
    "day_type": f"SELECT admission_date, {_DAY_TYPE} AS day_type FROM admissions",
    "parse_date": """SELECT CASE WHEN n % 3 = 0 THEN strftime(admission_date, '%d-%m-%Y') WHEN n % 5 = 0 THEN '2021-02-30'
                                 WHEN n % 7 = 0 THEN '' ELSE strftime(admission_date, '%Y-%m-%d') END AS date_text,
                            CASE WHEN n % 3 <> 0 AND n % 5 <> 0 AND n % 7 <> 0 THEN admission_date END AS parsed_date
                     FROM (SELECT *, CAST(patient_id AS BIGINT) AS n FROM admissions)""",
    "format_date": """SELECT event_id, strftime(ts, '%Y-%m-%d') AS day_text, strftime(ts, '%H:%M:%S') AS time_text
                      FROM vitals""",
    "date_plus_days": "SELECT admission_date, CAST(admission_date + INTERVAL 30 DAY AS DATE) AS followup_date FROM admissions",
    "pad_id": "SELECT hospital_id, printf('HOSP_%03d', TRY_CAST(hospital_id AS INTEGER)) AS hospital_code FROM admissions",
    "cast_double": """SELECT hospital_id, TRY_CAST(hospital_id AS DOUBLE) AS hospital_num,
                             TRY_CAST(region AS DOUBLE) AS region_num FROM admissions""",
    "clamp": "SELECT event_id, heart_rate, LEAST(100.0, GREATEST(85.0, heart_rate)) AS heart_rate_bounded FROM vitals",
    "fill_default": """SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 0.0 ELSE heart_rate END AS heart_rate,
                              CASE WHEN event_id % 6 = 0 THEN 100.0 ELSE oxygen_level END AS oxygen_level FROM vitals""",
    "if_else": "SELECT readmitted, CASE WHEN readmitted = 'Yes' THEN 1 ELSE 0 END AS readmit_flag FROM admissions",
    "in_set": f"""SELECT readmitted, CAST(CASE WHEN readmitted IN ({_POS}) THEN 1.0 ELSE 0.0 END AS DOUBLE) AS is_target
                  FROM admissions""",
    "json_encode": """SELECT event_id, CAST(to_json({'event_id': event_id, 'heart_rate': heart_rate}) AS VARCHAR) AS message
                      FROM vitals""",
    "json_decode": "SELECT event_id, heart_rate FROM vitals",
    "format_thousands": """SELECT treatment_cost, format('{:,}', CAST(floor(treatment_cost) AS BIGINT)) AS cost_text
                           FROM admissions""",
}
for _k, _v in _SCALAR_SQL.items():
    SQL[_k] = q(_v)

_RATES = """rates AS (SELECT region, disease, COUNT(*) AS total,
                        CAST(SUM(CASE WHEN readmitted = 'Yes' THEN 1 ELSE 0 END) AS BIGINT) AS readmitted
                 FROM admissions GROUP BY region, disease)"""
SQL["ratio"] = q(f"WITH {_RATES} SELECT region, disease, CAST(readmitted AS DOUBLE) / total AS rate FROM rates")
SQL["round_n"] = q(f"WITH {_RATES} SELECT region, disease, ROUND(CAST(readmitted AS DOUBLE) / total, 2) AS rate_2 FROM rates")
SQL["format_rate"] = q(f"""WITH {_RATES}
SELECT region, disease, printf('%d,%d,%.4f', total, readmitted, CAST(readmitted AS DOUBLE) / total) AS value FROM rates""")
SQL["format_pct"] = q(f"""WITH {_RATES}
SELECT region, disease, printf('%.1f%%', CAST(readmitted AS DOUBLE) / total * 100.0) AS rate_text FROM rates""")
SQL["flag_yes"] = q(f"WITH {_RATES} SELECT * FROM rates")
SQL["flag_yes_ci"] = q(f"""
SELECT region, disease, COUNT(*) AS total, COUNT(*) FILTER (readmitted = 'Yes') AS readmitted,
       COUNT(*) FILTER (readmitted = 'Yes' AND {_N} % 5 <> 0) AS readmitted_exact
FROM admissions WHERE {_N} % 11 <> 0 GROUP BY region, disease
""")

_YEAR_COLS = ",\n       ".join(
    f"""COALESCE(ROUND(AVG(CASE WHEN year = {y} THEN is_target END), 2), 0.0) AS "{y}" """ for y in FIXTURE_YEARS)
SQL["fillna_0"] = q(f"""
WITH u AS (SELECT region, substr(CAST(admission_date AS VARCHAR), 1, 4) AS year,
                  CASE WHEN year % 2 = 0 OR length(region) <= 6
                       THEN CAST(CASE WHEN readmitted IN ({_POS}) THEN 1.0 ELSE 0.0 END AS DOUBLE) END AS is_target
           FROM admissions)
SELECT region,
       {_YEAR_COLS.replace("year = ", "year = '").replace(" THEN is_target", "' THEN is_target")}
FROM u GROUP BY region
""")

SQL["accept_csv_only"] = q("""
SELECT f AS file, f LIKE '%.csv' AS accepted,
       CAST(CASE WHEN f = 'admissions.csv' THEN (SELECT COUNT(*) FROM admissions)
                 WHEN f LIKE '%.csv' THEN (SELECT COUNT(DISTINCT region) FROM admissions) ELSE 0 END AS BIGINT) AS "rows",
       CASE WHEN f LIKE '%.csv' THEN '' ELSE 'Only CSV files are allowed' END AS message
FROM (VALUES ('admissions.csv'), ('burden.csv'), ('burden.CSV'), ('burden.csv.txt'), ('burden.json'), ('csv')) AS t(f)
""")

SQL["split"] = q("""
SELECT string_split(patient_id || ',' || age_band || ',' || gender || ',' || region || ',' || hospital_id || ','
       || disease || ',' || CAST(admission_date AS VARCHAR) || ',' || CAST(year AS VARCHAR) || ',' || readmitted
       || ',' || CAST(treatment_cost AS VARCHAR), ',') AS fields
FROM admissions
""")

SQL["rename"] = SQL["regional_burden"]
SQL["role_fallback"] = q("SELECT patient_id AS region, COUNT(*) AS cases FROM admissions GROUP BY patient_id")
SQL["source_kafka"] = SQL["stream_decode"]
SQL["source_kafka_latest"] = q(_MESSAGES + " WHERE ts >= TIMESTAMP '2024-01-15 12:00:00'")
SQL["sink_stream_push"] = q(_PUSHED)

SQL["yearly_disease_counts_lines"] = q("""
SELECT CAST(year AS VARCHAR) || '|' || disease AS key, CAST(COUNT(*) AS VARCHAR) AS value
FROM admissions GROUP BY year, disease
""")
SQL["weekend_readmission_lines"] = q(f"""
SELECT disease || '|' || {_DAY_TYPE} AS key,
       printf('%d,%d,%.4f', COUNT(*), SUM(CASE WHEN lower(readmitted) = 'yes' THEN 1 ELSE 0 END),
              CAST(SUM(CASE WHEN lower(readmitted) = 'yes' THEN 1 ELSE 0 END) AS DOUBLE) / COUNT(*)) AS value
FROM admissions GROUP BY ALL
""")

# One-hot feature vectors: frequency-ordered indices (ties by value), one
# slot per seen value (the dropped slot is the unseen-value slot), then cost.
_IDX = "\n".join(f""", i_{c} AS (SELECT {c}, ROW_NUMBER() OVER (ORDER BY COUNT(*) DESC, {c}) - 1 AS idx_{c}
              FROM admissions GROUP BY {c})""" for c in ["age_band", "gender", "disease"])
_HOT = ",\n".join(f"""list_transform(range((SELECT COUNT(*) FROM i_{c})),
                     lambda i: CAST(CASE WHEN i = idx_{c} THEN 1 ELSE 0 END AS DOUBLE))"""
                  for c in ["age_band", "gender", "disease"])
SQL["ml_assemble"] = q(f"""
WITH lab AS (SELECT age_band, gender, disease, treatment_cost,
                    CAST(CASE WHEN readmitted = 'Yes' THEN 1 ELSE 0 END AS DOUBLE) AS label FROM admissions)
{_IDX}
SELECT label, list_concat({_HOT}, [treatment_cost]) AS features
FROM lab JOIN i_age_band USING (age_band) JOIN i_gender USING (gender) JOIN i_disease USING (disease)
""")

# Split by content: the same digits of the same md5.
_PARTS = """r AS (SELECT *, CAST('0x' || substr(md5(concat_ws('|', patient_id, age_band, gender, region, hospital_id, disease,
                  CAST(admission_date AS VARCHAR), CAST(year AS VARCHAR), readmitted, CAST(treatment_cost AS VARCHAR))), 1, 8)
                  AS BIGINT) % 1000000 < 800000 AS train, CAST(CASE WHEN readmitted = 'Yes' THEN 1 ELSE 0 END AS DOUBLE) AS label
           FROM admissions)"""
SQL["ml_split"] = q(f"""
WITH {_PARTS}
SELECT CASE WHEN train THEN 'train' ELSE 'test' END AS part, COUNT(*) AS "rows" FROM r GROUP BY ALL
""")
# What must hold of any forest of that many trees on these rows.
_FOREST = """label, COUNT(*) AS "rows", COUNT(*) AS walked_rows, TRUE AS mean_matches, CAST({} AS BIGINT) AS trees,
       TRUE AS roots_hold_fit, TRUE AS children_add_up"""
SQL["ml_train_rf"] = q(f"WITH {_PARTS}\nSELECT {_FOREST.format(20)} FROM r WHERE NOT train GROUP BY label")
SQL["ml_train_rf_ordinal"] = q(f"WITH {_PARTS}\nSELECT {_FOREST.format(50)} FROM r GROUP BY label")
# The rule's area by rank sums: a positive of average rank k wins against k - 1 rows
# (ties half), less the positives among them.
SQL["ml_auc"] = q(f"""
WITH {_PARTS},
s AS (SELECT label, 0.15 + CASE WHEN age_band IN ('71-80', '81-90', '90+') THEN 0.10 ELSE 0 END
                    + CASE WHEN disease IN ('ECONOMY', 'PROMO', 'STANDARD') THEN 0.05 ELSE 0 END
                    + CASE WHEN isodow(admission_date) >= 6 THEN 0.08 ELSE 0 END AS score FROM r WHERE NOT train),
k AS (SELECT label, 2 * RANK() OVER (ORDER BY score) + COUNT(*) OVER (PARTITION BY score) - 1 AS twice_rank FROM s),
t AS (SELECT COUNT(*) FILTER (label = 1) AS p, COUNT(*) FILTER (label = 0) AS n,
             SUM(twice_rank) FILTER (label = 1) AS w FROM k)
SELECT 'prior rule' AS scored_by, p AS positives, n AS negatives,
       CAST(w - CAST(p AS HUGEINT) * (p + 1) AS DOUBLE) / (2 * (CAST(p AS DOUBLE) * CAST(n AS DOUBLE))) AS auc, TRUE AS evaluator_agrees
FROM t
UNION ALL SELECT 'forest', p, n, NULL, TRUE FROM t
""")
SQL["sink_model_meta"] = q(f"""
WITH {_PARTS}
SELECT 'RandomForestClassifier' AS model_type, 'age_band,gender,disease,treatment_cost' AS features_used,
       'Ready for Production' AS status, COUNT(*) FILTER (train) AS train_rows, COUNT(*) FILTER (NOT train) AS test_rows,
       TRUE AS auc_in_range, TRUE AS took_time FROM r
""")
SQL["ml_score"] = q("""
SELECT age_band, disease, treatment_cost, gender, TRUE AS in_range, TRUE AS class_agrees, TRUE AS text_agrees,
       TRUE AS walk_agrees, TRUE AS unseen_as_first FROM admissions
""")
SQL["sink_model"] = SQL["ml_score"]
