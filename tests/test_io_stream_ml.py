"""Sources/sinks round trips, the vitals stream and the models."""

import glob
import json
import os

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from wardstat.operators import ml as ML
from wardstat.operators import upload as U
from wardstat.plans import hive as H
from wardstat.schemas import ADMISSIONS
from wardstat.sources import files as FS
from wardstat.sources import fixtures as fx
from wardstat.sources import gold as GS
from wardstat.sources import lake as LK
from wardstat.streaming import vitals as V


@pytest.fixture(scope="module")
def adm(spark):
    return fx.admissions_fact(spark, SF_SMALL)


def _sorted(rows):
    return sorted(tuple(r) for r in rows)


# --- CSV and lines ---------------------------------------------------------------------------

def test_csv_round_trip_with_schema(spark, adm, tmp_out):
    path = FS.write_csv(adm, f"{tmp_out}/csv")
    back = FS.read_admissions(spark, path)
    assert back.schema == ADMISSIONS
    assert _sorted(back.collect()) == _sorted(adm.collect())


def test_csv_malformed_modes(spark, tmp_out):
    p = f"{tmp_out}/bad.csv"
    os.makedirs(p)
    with open(f"{p}/part.csv", "w") as f:
        f.write(",".join(ADMISSIONS.fieldNames()) + "\n")
        f.write("1,0-10,M,North,H1,Asthma,2020-01-06,2020,Yes,100.0\n")
        f.write("2,0-10,M,North,H1,Asthma,2020-02-30,2020,Yes,abc\n")
    assert len(FS.read_admissions(spark, p, mode="DROPMALFORMED").collect()) == 1
    perm = FS.read_admissions(spark, p).orderBy("patient_id").collect()
    assert len(perm) == 2 and perm[1].treatment_cost is None


def test_hospitals_from_text(spark, tmp_out):
    dim = fx.hospitals_dim(spark, SF_SMALL)
    path = FS.write_csv(dim, f"{tmp_out}/hosp", header=False)
    back = FS.read_hospitals(spark, path)
    assert _sorted(back.collect()) == _sorted(dim.collect())


def test_lines_from_nested_csv_lake(spark, adm, tmp_out):
    path = LK.write_lake(adm, f"{tmp_out}/lake", fmt="csv")
    parsed = FS.typed_admissions(FS.parse_lines(FS.read_lines(spark, path), min_fields=9))
    assert _sorted(parsed.collect()) == _sorted(adm.collect())


def test_upload_reader_infers(spark, tmp_out):
    p = f"{tmp_out}/up.csv"
    with open(p, "w") as f:
        f.write("Medical Condition,City,Date of Admission,Test Results\nFlu,Paris,2020-01-01,Abnormal\n")
    df = U.prepare_upload(U.read_upload(spark, p))
    r = df.first()
    assert (r.disease, r.region, r.target, r.is_target) == ("Flu", "Paris", "Abnormal", 1.0)


def test_kv_text_is_globally_sorted(spark, adm, tmp_out):
    kv = FS.kv_lines(adm.groupBy("region", "disease").count(), ["region", "disease"],
                     F.col("count").cast("string"))
    path = FS.write_kv(kv, f"{tmp_out}/kv")
    lines = []
    for part in sorted(glob.glob(f"{path}/part-*")):
        with open(part) as fh:
            lines += [ln.rstrip("\n") for ln in fh if ln.strip()]
    keys = [ln.split("\t")[0] for ln in lines]
    assert keys == sorted(keys) and len(keys) == kv.count()
    assert _sorted(FS.read_kv(spark, path).collect()) == _sorted(kv.collect())


# --- lake and tables ---------------------------------------------------------------------------

@pytest.mark.parametrize("fmt", ["parquet", "csv"])
def test_lake_round_trip_and_pruning(spark, adm, tmp_out, fmt):
    path = LK.write_lake(adm, f"{tmp_out}/lake-{fmt}", fmt=fmt)
    dirs = {os.path.relpath(d, path) for d in glob.glob(f"{path}/part_year=*/part_region=*")}
    expected = {f"part_year={r.year}/part_region={r.region}"
                for r in adm.select("year", "region").distinct().collect()}
    assert dirs == expected
    lake = LK.read_lake(spark, path, fmt)
    assert lake.count() == adm.count()
    one = lake.where(F.col("part_year") == "1996")
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "part_year" in plan
    assert one.count() == adm.where(F.col("year") == 1996).count()


def test_register_tables_and_sql(spark, adm, tmp_out):
    path = LK.write_lake(adm, f"{tmp_out}/lake")
    table = LK.register_tables(spark, path, "wardstat_test_db", db_location=f"{tmp_out}/wh",
                               hospitals=fx.hospitals_dim(spark, SF_SMALL))
    parts = H.show_partitions(spark, table).count()
    assert parts == adm.select("year", "region").distinct().count()
    yoy = H.yoy_growth_sql(spark, table)
    assert yoy.agg(F.sum("total_cases")).first()[0] == adm.count()
    assert H.avg_cost_sql(spark, table, "wardstat_test_db.hospitals_dim").count() > 0


# --- gold tables -----------------------------------------------------------------------------------

def test_gold_round_trip_and_defaults(spark, adm, tmp_out):
    from wardstat.operators import gold as G
    up = U.prepare_upload(adm)
    GS.write_gold(G.kpis(up), "gold_kpis", tmp_out, partitions=1)
    k = GS.read_gold(spark, "gold_kpis", tmp_out)
    assert k.count() == 1
    with open(glob.glob(f"{tmp_out}/gold_kpis/part-*.txt")[0]) as fh:
        rec = json.loads(fh.readline())
    assert set(rec) == {"total_records_processed", "regions_analyzed", "top_disease", "avg_readmission_rate"}
    with pytest.raises(GS.GoldTableNotFound):
        GS.read_gold(spark, "gold_trends", tmp_out)
    default = spark.createDataFrame([("none", 0)], "region string, cases long")
    assert GS.read_or_default(spark, f"{tmp_out}/missing", default).first().region == "none"
    bad = f"{tmp_out}/bad_json"
    os.makedirs(bad)
    with open(f"{bad}/part-0.json", "w") as fh:
        fh.write("{not json\n")
    assert GS.read_or_default(spark, bad, default).first().region == "none"
    with open(f"{bad}/part-0.json", "w") as fh:  # a good first file and a bad one after it
        fh.write('{"region": "A", "cases": 1}\n')
    with open(f"{bad}/part-1.json", "w") as fh:
        fh.write("{not json\n")
    assert GS.read_or_default(spark, bad, default).first().region == "none"


def _upload(spark, rows):
    return spark.createDataFrame(rows, "disease string, region string, time_var string, is_target double")


def test_gold_tables_of_odd_names(spark, tmp_out):
    from wardstat.operators import gold as G
    up = _upload(spark, [("St. Vitus", "N", "2020-01-01", 1.0), ("Flu", "N", "2020-02-01", 0.0), ("flu", None, "2021-01-01", 1.0), (None, "S", "2021-05-05", 0.0)])
    for name, df in (("gold_trends", G.trends(up)), ("gold_readmissions", G.rate_matrix(up))):
        GS.write_gold(df, name, tmp_out)
        got = sorted(map(str, GS.read_gold(spark, name, tmp_out).collect()))
        assert got == sorted(map(str, df.collect()))
        assert set(df.columns[1:]) == {"St. Vitus", "Flu", "flu", "null"}
    GS.write_gold(G.kpis(up.where("disease IS NULL")), "gold_kpis", tmp_out, partitions=1)
    k = GS.read_gold(spark, "gold_kpis", tmp_out)
    assert k.first().top_disease is None and "top_disease" in k.columns
    assert G.kpi_top_disease(up.where("disease IS NULL")).first().top_disease is None


def test_gold_tables_of_an_empty_upload(spark, tmp_out):
    from wardstat.operators import gold as G
    from wardstat.plans import batch as B
    up = _upload(spark, [])
    assert G.trends(up).collect() == [] and G.rate_matrix(up).collect() == []
    assert G.kpi_regions(up).first().regions_analyzed == 0 == G.kpis(up).first().regions_analyzed
    assert tuple(G.kpi_top_disease(up).first()) == ("Unknown", 0)
    path = f"{tmp_out}/empty.csv"
    with open(path, "w") as fh:
        fh.write("patient_id,disease,region,admission_date,readmitted\n")
    out = B.process_upload(spark, path, f"{tmp_out}/gold")
    assert GS.read_gold(spark, "gold_regional", f"{tmp_out}/gold").columns == ["region", "cases"]
    assert set(out) >= {"gold_kpis", "gold_trends", "gold_regional"}


# --- vitals -------------------------------------------------------------------------------------------

def test_anomaly_rule_edges(spark):
    msgs = ['{"heart_rate": 120.0, "oxygen_level": 95.0}', '{"heart_rate": 120.1, "oxygen_level": 95.0}',
            '{"heart_rate": 80.0, "oxygen_level": 90.0}', '{"heart_rate": 80.0, "oxygen_level": 89.9}',
            '{"oxygen_level": 89.0}', '{"heart_rate": 130.0}', '{"heart_rate": 80.0}', '{bad json']
    raw = spark.createDataFrame([(m,) for m in msgs], "value string")
    got = [r.anomaly_detected for r in V.flag_anomaly(V.decode_vitals(raw)).collect()]
    assert got == [False, True, False, True, True, True, False, False]


def _rounded(vit):
    return vit.withColumns({c: F.round(c, 1) for c in ("heart_rate", "oxygen_level")})


def test_batch_and_stream_flags_agree(spark, tmp_out):
    vit = _rounded(fx.vitals(spark, SF_SMALL))  # as messages carry them
    topic = V.write_vitals_files(vit, f"{tmp_out}/topic")
    sdf = V.flag_anomaly(V.read_vitals(spark, "files", V.VITALS_STREAM, path=topic, max_files_per_trigger=1))
    q = V.write_stream_files(sdf.drop("timestamp"), f"{tmp_out}/out", f"{tmp_out}/ck", available_now=True)
    q.awaitTermination()
    streamed = spark.read.parquet(f"{tmp_out}/out")
    batch = V.flag_anomaly(vit)
    assert _sorted(streamed.select(*batch.columns).collect()) == _sorted(batch.collect())
    # restart from the checkpoint: nothing is processed twice
    q2 = V.write_stream_files(sdf.drop("timestamp"), f"{tmp_out}/out", f"{tmp_out}/ck", available_now=True)
    q2.awaitTermination()
    assert spark.read.parquet(f"{tmp_out}/out").count() == batch.count()


def test_latest_n_writer_keeps_newest(spark, tmp_out):
    vit = V.flag_anomaly(_rounded(fx.vitals(spark, SF_SMALL)))
    topic = V.write_vitals_files(fx.vitals(spark, SF_SMALL), f"{tmp_out}/topic")
    sdf = V.flag_anomaly(V.read_vitals(spark, "files", V.VITALS_STREAM, path=topic, max_files_per_trigger=1))
    q = V.push(sdf.drop("timestamp"), V.latest_n_writer(f"{tmp_out}/state", 20, tie_breakers=["event_id"]),
               f"{tmp_out}/ck", available_now=True)
    q.awaitTermination()
    kept = V.read_latest(spark, f"{tmp_out}/state")
    expect = vit.orderBy(F.desc("ts"), F.desc("event_id")).limit(20)
    assert _sorted(kept.select(*expect.columns).collect()) == _sorted(expect.collect())


def _batch(spark, *ids):
    return spark.createDataFrame([(i, 1.0 * i) for i in ids], "ts long, x double")


def test_latest_n_keeps_two_generations_and_survives_a_new_checkpoint(spark, tmp_out):
    state = f"{tmp_out}/state"
    keep = V.latest_n_writer(state, 3)
    assert V.read_latest(spark, state) is None
    for b in range(6):
        keep(_batch(spark, 2 * b, 2 * b + 1), b)
    assert len(os.listdir(state)) == 2
    assert sorted(r.ts for r in V.read_latest(spark, state).collect()) == [9, 10, 11]
    keep(_batch(spark, 10, 11), 5)  # the same batch again changes nothing
    assert sorted(r.ts for r in V.read_latest(spark, state).collect()) == [9, 10, 11]
    keep(_batch(spark, 4), 0)  # a new checkpoint counts from 0: what is kept stays
    assert sorted(r.ts for r in V.read_latest(spark, state).collect()) == [9, 10, 11]
    assert len(os.listdir(state)) == 2


def test_damaged_stream_state_raises(spark, tmp_out):
    state = f"{tmp_out}/state"
    V.latest_n_writer(state, 3)(_batch(spark, 1, 2), 0)
    for f in glob.glob(f"{state}/gen_*/part-*"):
        with open(f, "wb") as fh:
            fh.write(b"not parquet")
    for f in glob.glob(f"{state}/gen_*/.part-*"):
        os.truncate(f, 0)
    with pytest.raises(Exception, match="(?i)parquet|checksum|corrupt"):
        V.read_latest(spark, state).collect()


def test_messages_carry_all_fields_and_one_decimal(spark):
    df = spark.createDataFrame([("09:08:07", 71.26, 120.04, 97.55, None)],
                               "t string, heart_rate double, blood_pressure_systolic double, oxygen_level double, note string")
    ts = df.select(F.to_timestamp_ntz(F.concat(F.lit("2024-01-02 "), "t")).alias("ts"), "heart_rate", "blood_pressure_systolic", "oxygen_level")
    got = json.loads(V.encode_vitals(ts).first().value)
    assert (got["timestamp"], got["heart_rate"], got["blood_pressure_systolic"], got["oxygen_level"]) == ("09:08:07", 71.3, 120.0, 97.6)


def test_kafka_source_needs_connector(spark):
    with pytest.raises(Exception, match="(?i)kafka"):
        V.read_vitals(spark, "kafka", bootstrap_servers="localhost:1")


def test_object_store_settings_reach_the_session(spark):
    from wardstat.session import get_session
    s = get_session(extra_conf={"spark.hadoop.fs.s3a.endpoint": "http://store.invalid"})
    assert s.conf.get("spark.hadoop.fs.s3a.endpoint") == "http://store.invalid"


# --- models ------------------------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def ordinal_model(adm):
    return ML.train_ordinal(adm, num_trees=10, max_depth=4)


def test_onehot_auc_in_range(adm):
    model, test, a, secs = ML.train_onehot(adm, num_trees=10)
    assert secs > 0
    # The area is the share of (positive, negative) pairs that are in order.
    got = model.transform(test).select("label", ML.vector_to_array("probability")[1].alias("p")).collect()
    pos, neg = [r.p for r in got if r.label == 1], [r.p for r in got if r.label == 0]
    ranks = sum((p > q) + 0.5 * (p == q) for p in pos for q in neg) / (len(pos) * len(neg))
    assert abs(a - ranks) < 0.01


def test_forest_does_not_depend_on_the_layout(adm):
    one = ML.train_ordinal(adm.repartition(2), num_trees=5, max_depth=4)
    two = ML.train_ordinal(adm.repartition(13, "disease"), num_trees=5, max_depth=4)
    assert one.stages[-1].toDebugString.split("\n", 1)[1] == two.stages[-1].toDebugString.split("\n", 1)[1]


def test_fit_rows_are_bounded_and_repeatable(adm):
    a = ML.fit_layout(adm, 500)
    assert 0 < a.count() < 1500 and a.rdd.getNumPartitions() == ML.FIT_PARTITIONS
    assert sorted(map(str, a.collect())) == sorted(map(str, ML.fit_layout(adm.repartition(3), 500).collect()))


def test_unseen_labels_get_code_zero_and_threshold_is_strict(spark, ordinal_model):
    req = spark.createDataFrame([("90+", "NOT A DISEASE", 5000.0, "Male"), ("0-10", "PROMO", 100.0, "F")],
                                "age_band string, disease string, treatment_cost double, gender string")
    codes = ordinal_model.transform(req).select("age_band_code", "disease_code", "gender_code").collect()
    assert (codes[0].disease_code, codes[0].gender_code) == (0.0, 0.0)
    assert codes[0].age_band_code > 0.0   # 90+ is a known band
    scored = ML.score(ordinal_model, req)
    assert scored.count() == 2
    p = scored.first().probability
    assert 0.0 <= p <= 1.0
    at_threshold = ML.score(ordinal_model, req, threshold=p).first()
    assert at_threshold.prediction == "Low Risk"
    assert at_threshold.probability_text.endswith("%")


def test_model_save_load(spark, adm, ordinal_model, tmp_out):
    path = ML.save_model(ordinal_model, f"{tmp_out}/m")
    req = adm.select("age_band", "disease", "treatment_cost", "gender")
    a = ML.score(ordinal_model, req).select("probability").collect()
    b = ML.score(ML.load_model(path), req).select("probability").collect()
    assert _sorted(a) == _sorted(b)
    meta = ML.model_meta(spark, "RandomForestClassifier", 0.6, 1.0)
    assert meta.first().features_used == ML.CATEGORICAL + ML.NUMERIC


def test_hash_split_is_layout_independent(spark, adm):
    a_train, a_test = ML.split(adm, method="hash")
    b_train, b_test = ML.split(adm.repartition(5), method="hash")
    assert a_train.count() + a_test.count() == adm.count()
    assert _sorted(a_test.collect()) == _sorted(b_test.collect())
    frac = a_train.count() / adm.count()
    assert 0.75 < frac < 0.85
