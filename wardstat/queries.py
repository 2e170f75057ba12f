"""Registered queries: ``name -> (spark, sf_dir) -> DataFrame``.

Each query reads the driver's tables -- directly, through the fixture
views, or through data Spark derives from them once per application (the
materialised admissions fact, its CSV and lake copies, the published
vitals messages, the trained scoring model) -- and runs one operator of the
library over the whole input.
"""

from __future__ import annotations

import uuid

from collections.abc import Callable

from pyspark.ml import Pipeline
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import scalars as S
from .operators import aggregates as A
from .operators import gold as G
from .operators import joins as J
from .operators import ml as ML
from .operators import risk as R
from .operators import upload as U
from .operators import windows as W
from .operators.ranking import roc_auc
from .plans import batch as B
from .plans import hive as H
from .schemas import ADMISSIONS, DATABASE, DIMENSION_TABLE, FACT_TABLE
from .session import scratch_path
from .sources import files as FS
from .sources import fixtures as fx
from .sources import gold as GS
from .sources import lake as LK
from .sources.tables import remember
from .streaming import vitals as V

# Columns the data-quality check requires: the admissions schema plus one
# that an admissions table does not have.
REQUIRED_COLUMNS = [f.name for f in ADMISSIONS.fields] + ["discharge_date"]

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def register(name: str):
    def deco(fn: Query) -> Query:
        REGISTRY[name] = fn
        return fn
    return deco


def _adm(spark, sf_dir):
    """The admissions fact: star join written once per application, then
    scanned (see ``fixtures.admissions_fact``)."""
    return fx.admissions_fact(spark, sf_dir)


@register("ingest_admissions")
def q_ingest_admissions(spark, sf_dir):
    """The star join denormalised into the partitioned fact (a fresh write
    on every call) and read back."""
    path = fx.ingest_admissions(spark, sf_dir, scratch_path(spark, "admissions-ingest"))
    return fx.read_admissions_fact(spark, path)


@register("readmission_rates")
def q_readmission_rates(spark, sf_dir):
    return A.readmission_rates(_adm(spark, sf_dir))


@register("disease_frequency")
def q_disease_frequency(spark, sf_dir):
    return A.disease_frequency(_adm(spark, sf_dir))


@register("yearly_disease_counts")
def q_yearly_disease_counts(spark, sf_dir):
    return A.yearly_disease_counts(_adm(spark, sf_dir))


@register("weekend_readmission")
def q_weekend_readmission(spark, sf_dir):
    return A.weekend_readmission(_adm(spark, sf_dir))


@register("weekend_compare")
def q_weekend_compare(spark, sf_dir):
    return A.weekend_compare(_adm(spark, sf_dir))


@register("avg_cost")
def q_avg_cost(spark, sf_dir):
    return A.avg_cost(_adm(spark, sf_dir), fx.hospitals_dim(spark, sf_dir))


@register("cases_by_region_year")
def q_cases_by_region_year(spark, sf_dir):
    return A.cases_by_region_year(_adm(spark, sf_dir))


@register("yoy_growth")
def q_yoy_growth(spark, sf_dir):
    return W.yoy_growth(_adm(spark, sf_dir))


@register("regional_burden")
def q_regional_burden(spark, sf_dir):
    return A.regional_burden(_adm(spark, sf_dir))


# --- upload path ------------------------------------------------------------

def _uploaded(spark, sf_dir):
    """The admissions view treated as an uploaded table: roles found by name."""
    return U.prepare_upload(_adm(spark, sf_dir))


@register("role_map")
def q_role_map(spark, sf_dir):
    return U.map_roles(_adm(spark, sf_dir))


@register("flag_in_set")
def q_flag_in_set(spark, sf_dir):
    df = _uploaded(spark, sf_dir)
    return df.groupBy("target", "is_target").agg(F.count(F.lit(1)).alias("n"))


@register("required_columns")
def q_required_columns(spark, sf_dir):
    return U.check_columns(_adm(spark, sf_dir), REQUIRED_COLUMNS)


@register("kpis")
def q_kpis(spark, sf_dir):
    return G.kpis(_uploaded(spark, sf_dir))


@register("kpi_total")
def q_kpi_total(spark, sf_dir):
    return G.kpi_total(_uploaded(spark, sf_dir))


@register("kpi_regions")
def q_kpi_regions(spark, sf_dir):
    return G.kpi_regions(_uploaded(spark, sf_dir))


@register("kpi_top_disease")
def q_kpi_top_disease(spark, sf_dir):
    return G.kpi_top_disease(_uploaded(spark, sf_dir))


@register("kpi_target_rate")
def q_kpi_target_rate(spark, sf_dir):
    return G.kpi_target_rate(_uploaded(spark, sf_dir))


@register("trend_pivot")
def q_trend_pivot(spark, sf_dir):
    return G.trends(_uploaded(spark, sf_dir))


@register("rate_pivot")
def q_rate_pivot(spark, sf_dir):
    return G.rate_matrix(_uploaded(spark, sf_dir))


@register("distinct")
def q_distinct(spark, sf_dir):
    return W.distinct_values(_adm(spark, sf_dir), "region")


@register("top_1")
def q_top_1(spark, sf_dir):
    counts = A.yearly_disease_counts(_adm(spark, sf_dir))
    return W.top_n(counts, [F.desc("cases"), "year", "disease"], 1)


@register("preview_n")
def q_preview_n(spark, sf_dir):
    return W.preview(A.readmission_rates(_adm(spark, sf_dir)), 5, ["region", "disease"])


@register("order_by_cost")
def q_order_by_cost(spark, sf_dir):
    """avg_cost with each row's position in the cost order, so the order
    itself is checked, not only the set of rows."""
    res = A.avg_cost(_adm(spark, sf_dir), fx.hospitals_dim(spark, sf_dir))
    return W.with_position(res, [F.desc("avg_cost"), "hospital_type", "disease"], "cost_rank")


@register("order_by_year")
def q_order_by_year(spark, sf_dir):
    res = G.trends(_uploaded(spark, sf_dir))
    return W.with_position(res, ["year"], "year_rank")


# --- scalar functions and rules ----------------------------------------------

# Fixed-domain substitutes for the reference's disease names in the risk
# rules (the fixture's diseases are part types).
PRIOR_FIXTURE_DISEASES = ["ECONOMY", "PROMO", "STANDARD"]
FALLBACK_FIXTURE_DISEASE = "PROMO"


@register("scalar_functions")
def q_scalar_functions(spark, sf_dir):
    adm = _adm(spark, sf_dir)
    return adm.select(
        S.concat_key("region", "disease").alias("region_disease_key"),
        S.year_prefix("admission_date").alias("year_text"),
        S.year_of("admission_date").alias("year_of_date"),
        S.day_type("admission_date").alias("day_type"),
        S.parse_date(S.format_date("admission_date")).alias("parsed_date"),
        S.format_date("admission_date", "yyyy-MM-dd").alias("date_text"),
        S.date_plus_days("admission_date", 30).alias("followup_date"),
        S.pad_id(F.col("hospital_id").try_cast("int")).alias("hospital_code"),
        S.cast_double("hospital_id").alias("hospital_num"),
        S.equals_ignore_case("readmitted", "YES").alias("readmitted_ci"),
        F.lower("disease").contains("large").alias("is_large"),
        S.format_thousands(F.floor("treatment_cost")).alias("cost_text"),
        S.flag("readmitted").alias("readmit_flag"),
    )


@register("risk_rule_prior")
def q_risk_rule_prior(spark, sf_dir):
    return R.prior_calibration(_adm(spark, sf_dir), PRIOR_FIXTURE_DISEASES)


@register("risk_rule_fallback")
def q_risk_rule_fallback(spark, sf_dir):
    scored = R.risk_fallback(_adm(spark, sf_dir).select("age_band", "disease"), FALLBACK_FIXTURE_DISEASE)
    return scored.groupBy("age_band", "disease", "risk", "probability", "prediction") \
        .agg(F.count(F.lit(1)).alias("n"))


@register("join_dim")
def q_join_dim(spark, sf_dir):
    adm = _adm(spark, sf_dir).select("patient_id", "hospital_id", "disease", "treatment_cost")
    return J.join_dim(adm, fx.hospitals_dim(spark, sf_dir), "hospital_id")


# --- sources and sinks ---------------------------------------------------------

def _once(spark, key, build):
    """A path built once per application (a derived table in the shared
    folder), so a query over it times its own work, not the setup."""
    return remember(spark, key, build)


def _csv_copy(spark, sf_dir):
    """The admissions exported once as CSV (with header) under the shared
    folder: the input of the CSV and text-line readers."""
    return _once(spark, f"admissions-csv:{sf_dir}", lambda: FS.write_csv(
        _adm(spark, sf_dir), scratch_path(spark, "admissions") + ".csv"))


def _dirty_lines(spark, sf_dir):
    """The admissions as raw lines with faults by patient number: every 7th
    has no date, every 11th lost its last five fields, every 13th has an
    impossible date, every 5th says ``YES`` or ``NO``."""
    cols = {c: F.col(c).cast("string") for c in ADMISSIONS.fieldNames()}
    n = F.col("patient_id").cast("long")
    cols["admission_date"] = F.when(n % 7 == 0, "").when(n % 13 == 0, "2021-02-30").otherwise(cols["admission_date"])
    cols["readmitted"] = F.when(n % 5 == 0, F.upper("readmitted")).otherwise(cols["readmitted"])
    names = ADMISSIONS.fieldNames()
    line = F.when(n % 11 == 0, F.concat_ws(",", *[cols[c] for c in names[:5]])).otherwise(
        F.concat_ws(",", *[cols[c] for c in names]))
    return _adm(spark, sf_dir).select(line.alias("value"))


@register("sink_csv")
def q_sink_csv(spark, sf_dir):
    """A fresh CSV export, read back as its data lines.  Each part file
    starts with its own header line; those are left out so the result does
    not depend on the number of output files."""
    header = ",".join(ADMISSIONS.fieldNames())
    path = FS.write_csv(_adm(spark, sf_dir), scratch_path(spark, "admissions-csv"))
    lines = FS.read_lines(spark, path)
    return lines.where(F.col("value") != F.lit(header)).select(F.col("value").alias("line"))


@register("scan_csv")
def q_scan_csv(spark, sf_dir):
    return FS.read_admissions(spark, _csv_copy(spark, sf_dir))


def _csv_lake(spark, sf_dir):
    """The lake in its text form (headerless CSV under nested
    ``part_year=/part_region=`` folders), written once per application."""
    return _once(spark, f"csv-lake:{sf_dir}", lambda: LK.write_lake(
        _adm(spark, sf_dir), scratch_path(spark, "csv-lake"), fmt="csv", by_folder=True))


def _headed_lake(spark, sf_dir):
    """The admissions as text files under ``part_year=/part_file=`` folders,
    written once per application: the files of even years begin with a header,
    the others with a record, and patients whose number is a multiple of 50
    are called ``patient_id`` (in lines behind the first)."""
    def build():
        cols = [F.col(c).cast("string") for c in ADMISSIONS.fieldNames()]
        called = F.col("patient_id").cast("long") % 50 == 0
        line = F.concat_ws(",", F.when(called, F.lit(FS.HEADER_FIRST_FIELD)).otherwise(cols[0]), *cols[1:])
        file_no = F.pmod(F.xxhash64("patient_id", "hospital_id"), F.lit(16)).alias("part_file")
        rows = _adm(spark, sf_dir).select(F.col("year").alias("part_year"), file_no, F.when(called, 2).otherwise(1).alias("place"),
                                          line.alias("value"))
        headers = (rows.where(F.col("part_year") % 2 == 0).select("part_year", "part_file").distinct()
                   .select("*", F.lit(0).alias("place"), F.lit(",".join(ADMISSIONS.fieldNames())).alias("value")))
        path = scratch_path(spark, "headed-lake")
        (rows.unionByName(headers).repartition("part_year", "part_file").sortWithinPartitions("part_year", "part_file", "place")
         .drop("place").write.partitionBy("part_year", "part_file").text(path))
        return path
    return _once(spark, f"headed-lake:{sf_dir}", build)


@register("scan_lines")
def q_scan_lines(spark, sf_dir):
    """Disease frequency from raw text lines, read recursively through the
    folders (6 fields needed): some files begin with a header, and lines that
    look like one further down are data."""
    lines = FS.read_data_lines(spark, _headed_lake(spark, sf_dir))
    return A.disease_frequency(FS.parse_lines(lines, min_fields=6, headers=False))


def _rate_kv(spark, sf_dir):
    """Readmission job over text lines: 9 fields needed, every row counted,
    ``yes`` in any case, ``region|disease -> total,readmitted,rate``."""
    return B.line_job(spark, "rates", _csv_copy(spark, sf_dir))


@register("yearly_disease_counts_lines")
def q_yearly_disease_counts_lines(spark, sf_dir):
    """Yearly job over the CSV lake's text lines: ``year|disease -> count``."""
    return B.line_job(spark, "yearly", _csv_lake(spark, sf_dir))


@register("weekend_readmission_lines")
def q_weekend_readmission_lines(spark, sf_dir):
    """Weekend job over the CSV lake's text lines:
    ``disease|day_type -> total,readmitted,rate``."""
    return B.line_job(spark, "weekend", _csv_lake(spark, sf_dir))


@register("project")
def q_project(spark, sf_dir):
    """Fields picked by position from raw lines (region, age band, disease)."""
    lines = FS.read_lines(spark, _csv_copy(spark, sf_dir))
    return FS.parse_lines(lines, min_fields=6).select("region", "age_band", "disease")


@register("filter_malformed")
def q_filter_malformed(spark, sf_dir):
    """Lines with all fields, split and typed without failing on bad values:
    short lines go, bad dates become NULL."""
    return FS.typed_admissions(FS.parse_lines(_dirty_lines(spark, sf_dir), min_fields=9))


@register("filter_bad_date")
def q_filter_bad_date(spark, sf_dir):
    """Rows whose date text parses strictly, with their day type."""
    parsed = FS.parse_lines(_dirty_lines(spark, sf_dir), min_fields=9)
    dated = parsed.select("patient_id", "disease", S.once(S.parse_date("admission_date")).alias("admission_date"))
    return A.with_day_type(dated).select("patient_id", "disease", "admission_date", "day_type")


@register("readmission_rates_lines")
def q_readmission_rates_lines(spark, sf_dir):
    return _rate_kv(spark, sf_dir)


@register("sink_kv_text")
def q_sink_kv_text(spark, sf_dir):
    path = FS.write_kv(_rate_kv(spark, sf_dir), scratch_path(spark, "rates-kv"))
    return FS.read_kv(spark, path)


@register("order_by_key")
def q_order_by_key(spark, sf_dir):
    return W.with_position(_rate_kv(spark, sf_dir), ["key"], "line_no")


def _lake(spark, sf_dir):
    """The lake written once per application (input of the table queries)."""
    return _once(spark, f"lake:{sf_dir}", lambda: LK.write_lake(
        _adm(spark, sf_dir), scratch_path(spark, "lake"), by_folder=True))


@register("sink_partitioned")
def q_sink_partitioned(spark, sf_dir):
    """A fresh lake write; rows per partition folder as read back."""
    lake = LK.read_lake(spark, LK.write_lake(_adm(spark, sf_dir), scratch_path(spark, "lake"), by_folder=True))
    return lake.groupBy("part_year", "part_region").agg(F.count(F.lit(1)).alias("rows"))


@register("scan_partitioned")
def q_scan_partitioned(spark, sf_dir):
    return LK.read_lake(spark, _lake(spark, sf_dir))


def _registered(spark, sf_dir, fmt="parquet"):
    """The tables in a database of this call's own: no other catalog entry
    is touched."""
    lake = _csv_lake(spark, sf_dir) if fmt == "csv" else _lake(spark, sf_dir)
    database = f"{DATABASE}_{uuid.uuid4().hex[:12]}"
    LK.register_tables(spark, lake, database, db_location=scratch_path(spark, "warehouse"),
                       hospitals=fx.hospitals_dim(spark, sf_dir), fmt=fmt)
    return database


@register("repair_partitions")
def q_repair_partitions(spark, sf_dir):
    return H.show_partitions(spark, f"{_registered(spark, sf_dir)}.{FACT_TABLE}")


@register("create_tables")
def q_create_tables(spark, sf_dir):
    """The warehouse cost query over the created tables: the external text
    table and the dimension table."""
    database = _registered(spark, sf_dir, "csv")
    return H.avg_cost_sql(spark, f"{database}.{FACT_TABLE}", f"{database}.{DIMENSION_TABLE}")


@register("yoy_growth_sql")
def q_yoy_growth_sql(spark, sf_dir):
    return H.yoy_growth_sql(spark, f"{_registered(spark, sf_dir)}.{FACT_TABLE}")


def _write_gold_tables(spark, sf_dir):
    """All four gold tables of the upload job, freshly written."""
    base = scratch_path(spark, "gold")
    up = _uploaded(spark, sf_dir)
    GS.write_gold(G.kpis(up), "gold_kpis", base, partitions=1)
    GS.write_gold(G.trends(up), "gold_trends", base)
    GS.write_gold(A.regional_burden(up), "gold_regional", base)
    GS.write_gold(G.rate_matrix(up), "gold_readmissions", base)
    return base


def _gold_dir(spark, sf_dir):
    return _once(spark, f"gold:{sf_dir}", lambda: _write_gold_tables(spark, sf_dir))


@register("sink_gold_json")
def q_sink_gold_json(spark, sf_dir):
    return GS.read_gold(spark, "gold_kpis", _write_gold_tables(spark, sf_dir))


@register("scan_gold_json")
def q_scan_gold_json(spark, sf_dir):
    return GS.read_gold(spark, "gold_trends", _gold_dir(spark, sf_dir))


@register("scan_or_default")
def q_scan_or_default(spark, sf_dir):
    """Regional burden from its gold table, and the default in place of a
    table that is missing and of one with a line that is no JSON."""
    base = _gold_dir(spark, sf_dir)
    good = spark.createDataFrame([], "region string, cases long")
    fallback = _adm(spark, sf_dir).select(F.col("region"), F.lit(-1).cast("long").alias("cases")).distinct()
    broken = scratch_path(spark, "gold-broken")
    (spark.read.text(GS.gold_path(base, "gold_regional")).select("value")
     .unionByName(_adm(spark, sf_dir).select(F.concat(F.lit("{"), "region").alias("value")).distinct()).write.text(broken))
    parts = [("read", GS.read_or_default(spark, GS.gold_path(base, "gold_regional"), good)),
             ("missing", GS.read_or_default(spark, GS.gold_path(base, "no_such_table"), fallback)),
             ("broken", GS.read_or_default(spark, broken, fallback))]
    out = [df.select(F.lit(name).alias("source"), "region", "cases") for name, df in parts]
    return out[0].unionByName(out[1]).unionByName(out[2])


# --- vitals stream ---------------------------------------------------------------

def _vitals(spark, sf_dir):
    return fx.vitals(spark, sf_dir)


def _vitals_topic(spark, sf_dir):
    """The vitals published as JSON-lines files (the topic stand-in), with
    the producer's oxygen bounds applied."""
    v = _vitals(spark, sf_dir).withColumn("oxygen_level", S.clamp("oxygen_level"))
    return _once(spark, f"vitals-topic:{sf_dir}",
                 lambda: V.write_vitals_files(v, scratch_path(spark, "vitals-topic")))


def _vitals_stream(spark, sf_dir):
    topic = _vitals_topic(spark, sf_dir)
    sdf = V.read_vitals(spark, "files", V.VITALS_STREAM, path=topic, max_files_per_trigger=2)
    return V.flag_anomaly(sdf).drop("timestamp")


def _gappy_vitals(spark, sf_dir):
    """Vitals with NULL readings by event number: every 4th has no heart
    rate, every 6th no oxygen level."""
    return _vitals(spark, sf_dir).withColumns({
        "heart_rate": F.when(F.col("event_id") % 4 != 0, F.col("heart_rate")),
        "oxygen_level": F.when(F.col("event_id") % 6 != 0, F.col("oxygen_level"))})


@register("stream_decode")
def q_stream_decode(spark, sf_dir):
    """Encode each reading as a message and decode it with the schema."""
    v = _vitals(spark, sf_dir).withColumn("oxygen_level", S.clamp("oxygen_level"))
    return V.decode_vitals(V.encode_vitals(v), V.VITALS_STREAM)


@register("sink_kafka")
def q_sink_kafka(spark, sf_dir):
    """Publish every reading as a JSON message (to files: the Kafka
    connector is not on this classpath) and decode what was published."""
    v = _vitals(spark, sf_dir).withColumn("oxygen_level", S.clamp("oxygen_level"))
    path = V.write_vitals_files(v, scratch_path(spark, "vitals-publish"))
    return V.decode_vitals(FS.read_lines(spark, path), V.VITALS_STREAM)


@register("stream_anomaly")
def q_stream_anomaly(spark, sf_dir):
    return V.flag_anomaly(_vitals(spark, sf_dir))


@register("stream_push")
def q_stream_push(spark, sf_dir):
    """Structured Streaming run: file source -> decode -> flag -> parquet
    sink, checkpointed; the sink's rows are returned."""
    out = scratch_path(spark, "vitals-flagged")
    q = V.write_stream_files(_vitals_stream(spark, sf_dir), out,
                             scratch_path(spark, "ckpt-vitals-push"), available_now=True)
    q.awaitTermination()
    return spark.read.parquet(out)


@register("stream_latest_20")
def q_stream_latest_20(spark, sf_dir):
    """The 20 most recent flagged readings kept across micro-batches."""
    state = scratch_path(spark, "vitals-latest")
    q = V.push(_vitals_stream(spark, sf_dir), V.latest_n_writer(state, 20, "ts", tie_breakers=["event_id"]),
               scratch_path(spark, "ckpt-vitals-latest"), available_now=True)
    q.awaitTermination()
    return V.read_latest(spark, state)


@register("latest_n")
def q_latest_n(spark, sf_dir):
    return W.latest_n(V.flag_anomaly(_vitals(spark, sf_dir)), "ts", 20, tie_breakers=["event_id"])


@register("latest_n_per_key")
def q_latest_n_per_key(spark, sf_dir):
    return W.latest_n(_vitals(spark, sf_dir), "ts", 20, keys=["patient_id"], tie_breakers=["event_id"])


# --- models ------------------------------------------------------------------------

@register("ml_label")
def q_ml_label(spark, sf_dir):
    return ML.with_label(_adm(spark, sf_dir)).groupBy("readmitted", "label") \
        .agg(F.count(F.lit(1)).alias("n"))


@register("ml_index")
def q_ml_index(spark, sf_dir):
    """(feature, value, index) of the frequency-ordered string indexers."""
    adm = _adm(spark, sf_dir).select(*ML.CATEGORICAL)
    model = Pipeline(stages=ML.indexers()).fit(adm)
    return _stacked(model.transform(adm.distinct()), lambda c: {"index": F.col(f"{c}_indexed")})


def _stacked(df, columns):
    """One row per feature and value of a frame with a row per combination
    of values, with ``columns(feature)``."""
    rows = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("value"),
                              *[v.alias(k) for k, v in columns(c).items()]) for c in ML.CATEGORICAL])
    return df.select(F.explode(rows).alias("r")).select("r.*").distinct()


@register("ml_assemble")
def q_ml_assemble(spark, sf_dir):
    """Label and one-hot feature vector (as an array) per admission."""
    adm = ML.with_label(_adm(spark, sf_dir))
    stages = ML.onehot_pipeline().getStages()[:-1]
    feats = Pipeline(stages=stages).fit(adm).transform(adm)
    return feats.select("label", vector_to_array("features").alias("features"))


@register("ml_onehot")
def q_ml_onehot(spark, sf_dir):
    """Index and 1-based position of the one per categorical value.  The
    indexer keeps an extra slot for unseen values; that last slot is the
    one dropped by the encoder, so an unseen value encodes as all zeros
    and every seen value has its one."""
    adm = _adm(spark, sf_dir).select(*ML.CATEGORICAL)
    stages = ML.onehot_pipeline().getStages()[:2]
    enc = Pipeline(stages=stages).fit(adm).transform(adm.distinct())
    return _stacked(enc, lambda c: {
        "index": F.col(f"{c}_indexed"),
        "hot_position": F.array_position(vector_to_array(f"{c}_vec"), 1.0).cast("int")})


@register("ml_split")
def q_ml_split(spark, sf_dir):
    train, test = ML.split(_adm(spark, sf_dir))
    return train.agg(F.lit("train").alias("part"), F.count(F.lit(1)).alias("rows")) \
        .unionByName(test.agg(F.lit("test").alias("part"), F.count(F.lit(1)).alias("rows")))


# Two probabilities that come from the same leaves, added in another order.
SAME = 1e-9
# How far a forest's mean probability may be from the share of its labels.
MEAN_APART = 0.02


def _forest_rows(model, rows, fit_rows, label_share):
    """What must hold of a fitted forest, with its labels: the walk over its
    node table gives what the model gives on every row, every tree was
    grown on a bootstrap of the training rows, and the mean is calibrated."""
    nodes = ML.forest_nodes(model).persist()
    p = vector_to_array("probability")[1]
    both = ML.walked(model, model.transform(rows).withColumn("p", p), "w", nodes)
    counts = both.groupBy("label").agg(F.count(F.lit(1)).alias("rows"), F.count(F.when(F.abs(F.col("p") - F.col("w")) <= SAME, 1)).alias("walked_rows"),
                                       F.sum("p").alias("p"))
    whole = F.struct(F.sum("rows").alias("rows"), F.sum("p").alias("p"))
    mean = counts.agg(whole.alias("s")).select((F.abs(F.col("s.p") / F.col("s.rows") - label_share) <= MEAN_APART).alias("ok"))
    facts = ML.forest_facts(nodes, fit_rows)
    return counts.select("label", "rows", "walked_rows", mean.scalar().alias("mean_matches"),
                         *[facts.select(c).scalar().alias(c) for c in ("trees", "roots_hold_fit", "children_add_up")])


@register("ml_train_rf")
def q_ml_train_rf(spark, sf_dir):
    """The one-hot forest by label: rows of the test part, those of them
    that a walk over the node table scores as the model does, and what must
    hold of its trees."""
    adm = _adm(spark, sf_dir)
    model, test, _, _ = ML.train_onehot(adm)
    train, _ = ML.split(adm)
    seen = train.agg(F.count(F.lit(1)).alias("n"), F.avg(ML.LABEL).alias("share")).first()
    return _forest_rows(model, test, seen["n"], seen["share"])


@register("ml_auc")
def q_ml_auc(spark, sf_dir):
    """Exact area under ROC on the test part: of the prior rule, and of the
    forest (``auc`` there is left to ``ml_auc_forest``), with whether Spark's
    own evaluator comes to the same."""
    model, test, score, _ = ML.train_onehot(_adm(spark, sf_dir))
    rule = R.risk_prior(test, PRIOR_FIXTURE_DISEASES)
    exact = [("prior rule", roc_auc(rule, "prior_risk", ML.LABEL), F.col("auc"), ML.evaluator_auc(rule, "prior_risk")),
             ("forest", ML.auc_table(model, test), F.lit(None).cast("double"), score)]
    rows = [df.select(F.lit(name).alias("scored_by"), "positives", "negatives", shown.alias("auc"),
                      (F.abs(F.col("auc") - other) <= AUC_APART).alias("evaluator_agrees")) for name, df, shown, other in exact]
    return rows[0].unionByName(rows[1])


# Two areas over the curve of every score, added in another order.
AUC_APART = 1e-9


@register("ml_auc_forest")
def q_ml_auc_forest(spark, sf_dir):
    """The forest's metrics record of one run, with its exact area under ROC."""
    model, test, _, secs = ML.train_onehot(_adm(spark, sf_dir))
    return ML.model_meta(spark, "RandomForestClassifier", ML.auc_table(model, test).first()["auc"], secs)


def _ordinal_model_path(spark, sf_dir):
    """The scoring model, trained once per application and saved in the
    shared folder."""
    return _once(spark, f"model-ordinal:{sf_dir}", lambda: ML.save_model(
        ML.train_ordinal(_adm(spark, sf_dir)), scratch_path(spark, "model-ordinal")))


def _ordinal_model(spark, sf_dir):
    """The saved scoring model, loaded once per application and kept, as a
    serving layer would keep it."""
    return _once(spark, f"model-ordinal-loaded:{sf_dir}",
                 lambda: ML.load_model(_ordinal_model_path(spark, sf_dir)))


def _requests(spark, sf_dir):
    return _adm(spark, sf_dir).select("age_band", "disease", "treatment_cost", "gender")


@register("ml_train_rf_ordinal")
def q_ml_train_rf_ordinal(spark, sf_dir):
    """Fresh training of the scoring forest on all rows: the same facts."""
    adm = ML.with_label(_adm(spark, sf_dir))
    model = ML.train_ordinal(adm)
    seen = adm.agg(F.count(F.lit(1)).alias("n"), F.avg(ML.LABEL).alias("share")).first()
    return _forest_rows(model, adm, seen["n"], seen["share"])


# A gender that no model has seen: the dashboard's spelling.
UNSEEN_GENDER = "Male"


def _checked_scores(model, requests):
    """The requests with what must hold of every score: it is a probability,
    its text is its rounding, the class follows the threshold, a walk over
    the forest's nodes gives the same, and the request of an unseen gender is
    scored as that of the first label (code 0)."""
    p, first = F.col("probability"), model.stages[0].labelsArray[ML.CATEGORICAL.index("gender")][0]
    nodes = ML.forest_nodes(model).persist()
    scored = ML.walked(model, ML.score(model, requests), "walk", nodes)
    scored = scored.select(
        "age_band", "disease", "treatment_cost", "gender", p.between(0, 1).alias("in_range"),
        (F.col("prediction") == F.when(p > R.HIGH_RISK_THRESHOLD, R.HIGH_RISK).otherwise(R.LOW_RISK)).alias("class_agrees"),
        (F.abs(F.regexp_replace("probability_text", "%", "").cast("double") - p * 100) <= 0.0501).alias("text_agrees"),
        (F.abs(p - F.col("walk")) <= SAME).alias("walk_agrees"))
    own = F.col("gender").alias("_own")
    unseen = ML.score(model, scored.select("*", own).withColumn("gender", F.lit(UNSEEN_GENDER)))
    unseen = ML.walked(model, unseen.withColumn("gender", F.lit(first)), "walk", nodes)
    return (unseen.withColumn("unseen_as_first", F.abs(F.col("probability") - F.col("walk")) <= SAME)
            .withColumn("gender", F.col("_own")).drop("_own", "walk", "probability", "probability_text", "prediction"))


@register("ml_score")
def q_ml_score(spark, sf_dir):
    """Every request scored, as columns that SQL can hold against."""
    return _checked_scores(_ordinal_model(spark, sf_dir), _requests(spark, sf_dir))


@register("sink_model")
def q_sink_model(spark, sf_dir):
    """The same with the model after a save/load round trip."""
    path = ML.save_model(_ordinal_model(spark, sf_dir), scratch_path(spark, "model-copy"))
    return _checked_scores(ML.load_model(path), _requests(spark, sf_dir))


@register("sink_model_meta")
def q_sink_model_meta(spark, sf_dir):
    """The metrics record written as gold JSON and read back: its fixed
    part, and whether the run's part is possible."""
    adm = _adm(spark, sf_dir)
    _, test, score, secs = ML.train_onehot(adm)
    record = ML.model_record(ML.model_meta(spark, "RandomForestClassifier", score, secs), ML.split(adm)[0], test)
    base = scratch_path(spark, "model-meta")
    GS.write_gold(record, "ml_model_meta", base, partitions=1)
    read = GS.read_gold(spark, "ml_model_meta", base)
    return read.select("model_type", F.array_join("features_used", ",").alias("features_used"), "status", "train_rows", "test_rows",
                       F.col("run.auc_score").between(0, 1).alias("auc_in_range"),
                       (F.col("run.training_time_seconds") > 0).alias("took_time"))


# --- end-to-end jobs ---------------------------------------------------------------------

@register("process_upload")
def q_process_upload(spark, sf_dir):
    """The upload job over the admissions exported as ``.csv`` (types
    inferred, roles found by name); returns its KPI gold table."""
    paths = B.process_upload(spark, _csv_copy(spark, sf_dir), scratch_path(spark, "upload-gold"))
    return GS.read_gold(spark, "gold_kpis", paths["gold_kpis"].rsplit("/", 1)[0])


@register("run_batch")
def q_run_batch(spark, sf_dir):
    """Daily run (ingest -> frequency job -> training); returns the
    frequency job's output read back from its text files."""
    out = B.run_batch(spark, _adm(spark, sf_dir), scratch_path(spark, "daily"))
    parts = F.split(F.col("key"), "[|]")
    return FS.read_kv(spark, out["disease_frequency"]).select(
        S.field(parts, 0).alias("region"), S.field(parts, 1).alias("age_band"),
        S.field(parts, 2).alias("disease"), F.col("value").cast("long").alias("cases"))


# --- one query per scalar function and flag ------------------------------------------------

def _rates(spark, sf_dir):
    """Per (region, disease): rows and exact-``Yes`` readmissions."""
    return _adm(spark, sf_dir).groupBy("region", "disease").agg(
        F.count(F.lit(1)).alias("total"), F.sum(S.flag("readmitted")).cast("long").alias("readmitted"))


def _odd_date():
    """Date texts, by patient number: every 3rd day-first, every 5th
    impossible, every 7th empty."""
    n = F.col("patient_id").cast("long")
    return (F.when(n % 3 == 0, S.format_date("admission_date", "dd-MM-yyyy")).when(n % 5 == 0, F.lit("2021-02-30"))
            .when(n % 7 == 0, F.lit("")).otherwise(S.format_date("admission_date")))


_SCALAR_QUERIES = {
    "concat_key": ("adm", lambda df: df.select("region", "disease",
                                               S.concat_key("region", "disease").alias("key"))),
    "equals_ignore_case": ("adm", lambda df: df.select(
        "readmitted", S.equals_ignore_case("readmitted", "YES").alias("is_yes"))),
    "lower": ("adm", lambda df: df.select(
        "disease", F.lower("disease").alias("disease_lower"),
        F.lower("disease").contains("large").alias("mentions_large"))),
    "year_prefix": ("adm", lambda df: df.select("admission_date", S.year_prefix("admission_date").alias("year_text"))),
    "year_of": ("adm", lambda df: df.select("admission_date", S.year_of("admission_date").alias("year_of_date"))),
    "day_type": ("adm", lambda df: df.select("admission_date", S.day_type("admission_date").alias("day_type"))),
    "parse_date": ("adm", lambda df: df.select(_odd_date().alias("date_text"), S.parse_date(_odd_date()).alias("parsed_date"))),
    "format_date": ("vit", lambda df: df.select(
        "event_id", S.format_date("ts", "yyyy-MM-dd").alias("day_text"),
        S.format_date("ts", "HH:mm:ss").alias("time_text"))),
    "date_plus_days": ("adm", lambda df: df.select(
        "admission_date", S.date_plus_days("admission_date", 30).alias("followup_date"))),
    "pad_id": ("adm", lambda df: df.select(
        "hospital_id", S.pad_id(F.col("hospital_id").try_cast("int")).alias("hospital_code"))),
    "cast_double": ("adm", lambda df: df.select(
        "hospital_id", S.cast_double("hospital_id").alias("hospital_num"),
        S.cast_double("region").alias("region_num"))),
    "clamp": ("vit", lambda df: df.select(
        "event_id", "heart_rate", S.clamp("heart_rate", 85.0, 100.0).alias("heart_rate_bounded"))),
    "fill_default": ("gap", lambda df: df.select(
        "event_id", S.fill_default("heart_rate", S.HEART_RATE_DEFAULT).alias("heart_rate"),
        S.fill_default("oxygen_level", S.OXYGEN_DEFAULT).alias("oxygen_level"))),
    "if_else": ("adm", lambda df: df.select(
        "readmitted", F.when(F.col("readmitted") == "Yes", F.lit(1)).otherwise(F.lit(0)).alias("readmit_flag"))),
    "in_set": ("adm", lambda df: df.select("readmitted", S.flag_in_set("readmitted").alias("is_target"))),
    "json_encode": ("vit", lambda df: df.select(
        "event_id", F.to_json(F.struct("event_id", "heart_rate")).alias("message"))),
    "json_decode": ("vit", lambda df: df.select(F.to_json(F.struct("event_id", "heart_rate")).alias("m"))
                    .select(F.from_json("m", "event_id bigint, heart_rate double").alias("r")).select("r.*")),
    "format_thousands": ("adm", lambda df: df.select(
        "treatment_cost", S.format_thousands(F.floor("treatment_cost")).alias("cost_text"))),
}

_RATE_QUERIES = {
    "ratio": lambda r: r.select("region", "disease", S.ratio("readmitted", "total").alias("rate")),
    "round_n": lambda r: r.select("region", "disease",
                                  S.round_n(S.ratio("readmitted", "total"), 2).alias("rate_2")),
    "format_rate": lambda r: r.select("region", "disease", S.format_rate(
        "total", "readmitted", S.ratio("readmitted", "total")).alias("value")),
    "format_pct": lambda r: r.select("region", "disease",
                                     S.format_pct(S.ratio("readmitted", "total")).alias("rate_text")),
    "flag_yes": lambda r: r.select("region", "disease", "total", "readmitted"),
}


def _scalar_query(src, fn):
    source = {"adm": _adm, "vit": _vitals, "gap": _gappy_vitals}[src]
    return lambda spark, sf_dir: fn(source(spark, sf_dir))


def _rate_query(fn):
    return lambda spark, sf_dir: fn(_rates(spark, sf_dir))


for _name, (_src, _fn) in _SCALAR_QUERIES.items():
    register(_name)(_scalar_query(_src, _fn))
for _name, _fn in _RATE_QUERIES.items():
    register(_name)(_rate_query(_fn))


@register("flag_yes_ci")
def q_flag_yes_ci(spark, sf_dir):
    """Readmissions with ``yes`` in any case, of lines that write it so; exact
    ``Yes`` next to it."""
    parsed = FS.parse_lines(_dirty_lines(spark, sf_dir), min_fields=9)
    return parsed.groupBy("region", "disease").agg(
        F.count(F.lit(1)).alias("total"), F.sum(S.flag("readmitted", "Yes", True)).cast("long").alias("readmitted"),
        F.sum(S.flag("readmitted")).cast("long").alias("readmitted_exact"))


@register("fillna_0")
def q_fillna_0(spark, sf_dir):
    """Rate by region (rows) and year (columns, found in the data) of all
    admissions; in odd years, regions with a name of more than six letters
    have no target, so their cells have no mean and are filled with 0."""
    known = (F.col("year").cast("int") % 2 == 0) | (F.length("region") <= 6)
    up = _uploaded(spark, sf_dir).withColumn("is_target", F.when(known, F.col("is_target")))
    return G.pivot_mean(up, "region", "year", "is_target")


@register("accept_csv_only")
def q_accept_csv_only(spark, sf_dir):
    """The admissions' export offered as an upload, and exports of the
    regional burden under other names: the name alone decides, before anything is read."""
    burden = A.regional_burden(_uploaded(spark, sf_dir))
    offered = {"admissions.csv": _csv_copy(spark, sf_dir)}
    for name in ("burden.csv", "burden.CSV", "burden.csv.txt", "burden.json", "csv"):
        offered[name] = FS.write_csv(burden, f"{scratch_path(spark, 'offered')}/{name}")
    out = None
    for name, path in offered.items():
        try:
            read = U.read_upload(spark, path).agg(F.count(F.lit(1)).alias("rows"))
            row = read.select(F.lit(name).alias("file"), F.lit(True).alias("accepted"), "rows", F.lit("").alias("message"))
        except U.NotCsvError as e:
            row = spark.range(1).select(F.lit(name).alias("file"), F.lit(False).alias("accepted"),
                                        F.lit(0).cast("long").alias("rows"), F.lit(str(e)).alias("message"))
        out = row if out is None else out.unionByName(row)
    return out


@register("split")
def q_split(spark, sf_dir):
    """Raw lines split into fields (header lines left out)."""
    header = ",".join(ADMISSIONS.fieldNames())
    lines = FS.read_lines(spark, _csv_copy(spark, sf_dir)).where(F.col("value") != F.lit(header))
    return lines.select(S.split_fields("value").alias("fields"))


@register("rename")
def q_rename(spark, sf_dir):
    """Regional burden as the upload job names it (``count`` -> ``cases``)."""
    return _uploaded(spark, sf_dir).groupBy("region").count().withColumnRenamed("count", "cases")


@register("role_fallback")
def q_role_fallback(spark, sf_dir):
    """Columns whose names match no role: disease falls back to the first
    text column, region to the disease column, time to the first column;
    regional burden of the result."""
    plain = _adm(spark, sf_dir).select(F.col("patient_id").alias("pid"), F.col("age_band").alias("band"),
                                       F.col("treatment_cost").alias("amount"))
    mapped = U.prepare_upload(plain)
    return A.regional_burden(mapped)


@register("source_kafka")
def q_source_kafka(spark, sf_dir):
    """The message source as a stream (file stand-in for the topic): every
    published message decoded, collected through a checkpointed sink."""
    topic = _vitals_topic(spark, sf_dir)
    sdf = V.read_vitals(spark, "files", V.VITALS_STREAM, path=topic, max_files_per_trigger=4)
    out = scratch_path(spark, "vitals-source")
    V.write_stream_files(sdf, out, scratch_path(spark, "ckpt-vitals-source"), available_now=True) \
        .awaitTermination()
    return spark.read.parquet(out)


# Messages up to this time are in the topic before the consumer starts.
BACKLOG_UNTIL = "2024-01-15 12:00:00"


@register("source_kafka_latest")
def q_source_kafka_latest(spark, sf_dir):
    """A consumer that starts at the latest message (file stand-in): readings
    are published before and after it has taken its position, and it
    receives the later ones only."""
    v = _vitals(spark, sf_dir).withColumn("oxygen_level", S.clamp("oxygen_level"))
    earlier = F.col("ts") < F.lit(BACKLOG_UNTIL).cast("timestamp_ntz")
    topic, log = scratch_path(spark, "vitals-topic-live"), scratch_path(spark, "start-position")
    V.write_vitals_files(v.where(earlier), topic)
    position = V.start_position(spark, topic, log)
    V.write_vitals_files(v.where(~earlier), topic)
    sdf = V.read_vitals(spark, "files", V.VITALS_STREAM, path=topic, after=position)
    out = scratch_path(spark, "vitals-live")
    V.write_stream_files(sdf, out, scratch_path(spark, "ckpt-vitals-live"), available_now=True).awaitTermination()
    return spark.read.parquet(out)


@register("sink_stream_push")
def q_sink_stream_push(spark, sf_dir):
    """Each flagged micro-batch handed to a foreachBatch function that
    appends it to a table (idempotent per batch id)."""
    out = scratch_path(spark, "vitals-pushed")

    def append(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    V.push(_vitals_stream(spark, sf_dir), append, scratch_path(spark, "ckpt-vitals-pushed"),
           available_now=True).awaitTermination()
    return spark.read.parquet(out).drop("batch_id")
