"""Logs, history, catalog, batch jobs and streams end to end."""

import datetime as dt
import glob
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from lurescope.contract import FEATURES, FEEDBACK_LOG, SCAN_LOG, TARGET
from lurescope.functions.stats import sketch_value
from lurescope.operators import history
from lurescope.operators.classify import heuristic_classify
from lurescope.plans import inputs, jobs
from lurescope.plans.skew import salted_left_join
from lurescope.session import shared_folder
from lurescope.sources import catalog, logs, markers, store
from lurescope.sources.tables import read_dataset
from lurescope.streaming import jobs as streams


def classify(df):
    return heuristic_classify(df, FEATURES)


def scans(spark, rows):
    at = dt.datetime(2024, 1, 1)
    data = [(f"{i:05d}", url, code, 0.5, features, None, at + dt.timedelta(hours=h)) for i, (url, code, features, h) in enumerate(rows)]
    return spark.createDataFrame(data, SCAN_LOG)


def test_newest_first_with_ties_and_bad_json(spark):
    log = scans(spark, [("a", 0, '{"port": -1}', 1), ("b", 1, "oops", 2), ("c", 1, '{"port": 1}', 2)])
    rows = history.scan_history(log, 2).collect()
    assert [r["url"] for r in rows] == ["c", "b"]
    assert rows[0]["features_map"]["port"] == 1 and rows[1]["features_map"] is None and rows[1]["features"] == "oops"


def test_limit_comes_before_the_url_filter(spark):
    log = scans(spark, [("old", 0, "{}", 0)] + [("new", 1, "{}", 1 + i) for i in range(120)])
    assert history.url_history(log, "old").count() == 0
    assert history.url_history(log, "old", 1000).count() == 1
    assert {r["url"] for r in history.history_summary(log).collect()} == {"new"}


def test_history_summary_of_a_hot_url(spark):
    rows = [("hot", i % 2, "{}", i) for i in range(400)] + [(f"u{i}", 1, "{}", i) for i in range(200)]
    found = {r["url"]: r for r in history.history_summary(scans(spark, rows), None).collect()}
    assert len(found) == 201 and found["hot"]["previous_scans"] == 400
    assert found["hot"]["past_verdicts"] == ["safe", "phishing", "safe", "phishing", "safe"]
    urls = spark.createDataFrame([("hot",), ("never",)], "url string")
    joined = {r["url"]: r for r in history.with_history(urls, scans(spark, rows), None).collect()}
    assert joined["never"]["previous_scans"] == 0 and joined["never"]["past_verdicts"] == []


def test_salted_join_equals_a_plain_join(spark):
    left = spark.range(5000).withColumn("k", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")))
    left = left.unionByName(spark.range(10).withColumn("k", F.lit(None).cast("string")))
    right = left.select("k").where("k is not null and (k = 'hot' or id % 2 = 0)").distinct().withColumn("v", F.length("k"))
    key = lambda d: sorted((r["id"], r["k"] or "", r["v"] or -1) for r in d.select("id", "k", "v").collect())
    assert key(salted_left_join(left, right, "k", ["id"])) == key(left.join(right, "k", "left"))


def test_log_append_is_idempotent_per_batch(spark):
    root = shared_folder(spark, "logs")
    logs.ensure_logs(spark, root)
    logs.ensure_logs(spark, root)
    assert logs.read_log(spark, root, "scan_history").count() == 0
    urls = spark.createDataFrame([("http://secure-paypal@127.0.0.1/login",), ("http://a.b",)], "url string")
    scored, _ = jobs.score_urls(urls, classify)
    logs.log_scans(scored, root, "b1")
    logs.log_scans(scored, root, "b1")
    logs.log_scans(scored, root, "b2")
    stored = logs.read_log(spark, root, "scan_history")
    assert stored.count() == 4 and stored.select("id").distinct().count() == 4
    assert stored.where("features like '%having_At_Symbol\":-1%' and ai_analysis like '%Threat Report%'").count() == 2


def test_feedback_accepts_and_rejects(spark):
    root = shared_folder(spark, "feedback")
    logs.ensure_logs(spark, root)
    rows = [("http://x@1.2.3.4", 0, 1), ("http://x", 5, None), ("http://a.b:99999/", 1, 1), ("http://y", 1, None)]
    rejects = logs.log_feedback(spark.createDataFrame(rows, "url string, correct_label int, predicted_label int"), root)
    assert {r["reject_reason"] for r in rejects.collect()} == {"invalid_label", "invalid_port"}
    stored = logs.read_log(spark, root, "feedback")
    assert {(r["url"], r["predicted_label"]) for r in stored.collect()} == {("http://x@1.2.3.4", 1), ("http://y", -1)}
    seed = jobs.feedback_rows(stored)
    assert seed.columns == [*FEATURES, TARGET] and {r[TARGET] for r in seed.collect()} == {-1, 1}


def test_racing_writers_share_no_version(spark):
    root = shared_folder(spark, "catalog")
    catalog.ensure_catalog(spark, root)
    with ThreadPoolExecutor(4) as pool:
        got = list(pool.map(lambda k: catalog.register_version(spark, root, f"r{k}", f"p{k}"), range(8)))
    rows = catalog.read_versions(spark, root).collect()
    assert sorted(got) == list(range(1, 9)) and {int(r["version"]): r["run_id"] for r in rows} == {v: f"r{k}" for k, v in enumerate(got)}
    # A claim without a row is passed over; other models count for themselves.
    assert catalog.claim_version(spark, root, 9) == 9 and catalog.register_version(spark, root, "late", "p") == 10
    assert catalog.register_version(spark, root, "other", "p", "second") == 1


def test_markers_are_put_once(spark):
    marker = f"{shared_folder(spark, 'claims')}/commits/1"
    with ThreadPoolExecutor(8) as pool:
        won = list(pool.map(lambda k: markers.put_if_absent(spark, marker, f"text {k}"), range(8)))
    assert won.count(True) == 1 and markers.read_text(spark, marker) == f"text {won.index(True)}"
    assert markers.names(spark, marker.removesuffix("/1")) == ["1"] and markers.names(spark, marker + "-none") == []


def test_compaction_keeps_every_batch_once(spark, monkeypatch):
    root = shared_folder(spark, "logs")
    logs.ensure_logs(spark, root)

    def append(batch, n):
        rows = [(f"{batch}-{k}", f"http://{batch}.org/{k}", 1, 0.5, "[]", None, dt.datetime(2024, 1, 1)) for k in range(n)]
        logs.append_log(spark.createDataFrame(rows, SCAN_LOG), root, "scan_history", batch)

    def ids():
        return sorted(r["id"] for r in logs.read_log(spark, root, "scan_history").select("id").collect())

    assert not logs.compact_log(spark, root, "scan_history") and logs.vacuum_log(spark, root, "scan_history") == 0 and ids() == []
    for batch, n in (("a", 3), ("b c:d", 2), ("e", 1)):
        append(batch, n)
    want = ["a-0", "a-1", "a-2", "b c:d-0", "b c:d-1", "e-0"]
    began = logs.read_log(spark, root, "scan_history").select("id")

    with monkeypatch.context() as m:  # lost before the commit: the log is as it was
        m.setattr(logs, "put_if_absent", lambda *_: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            logs.compact_log(spark, root, "scan_history")
    assert ids() == want

    assert logs.compact_log(spark, root, "scan_history") and ids() == want
    assert sorted(r["id"] for r in began.collect()) == want  # a reader from before
    append("a", 3)  # a batch that is written again
    append("f", 2)
    want += ["f-0", "f-1"]
    assert ids() == want
    with monkeypatch.context() as m:  # another compaction commits in between
        put = logs.put_if_absent
        m.setattr(logs, "put_if_absent", lambda *x: m.undo() or logs.compact_log(spark, root, "scan_history") and put(*x))
        assert not logs.compact_log(spark, root, "scan_history")
    assert ids() == want
    assert logs.vacuum_log(spark, root, "scan_history") == 6  # four batches, two folders without a manifest
    assert ids() == want
    append("e", 1)
    append("g", 1)
    want += ["g-0"]
    assert logs.compact_log(spark, root, "scan_history", rows_per_file=4, whole=True) and ids() == want
    assert len(list(glob.glob(f"{root}/scan_history_folded/part-*/rows/*.parquet"))) >= 3
    logs.vacuum_log(spark, root, "scan_history")
    assert ids() == want and len(glob.glob(f"{root}/scan_history_folded/part-*")) == 1


def test_live_history_equals_the_log_in_any_order(spark):
    at = dt.datetime(2024, 1, 1)
    rows = [(f"{k:04d}", None if k % 50 == 7 else f"http://{'hot' if k % 3 == 0 else k % 11}.org", k % 5 == 0 and 1 or 0, None if k % 40 == 9 else at + dt.timedelta(seconds=k * 37 % 90)) for k in range(400)]
    log = spark.createDataFrame(rows, "id string, url string, prediction int, created_at timestamp")
    want = sorted((str(r.url), r.previous_scans, r.past_verdicts) for r in history.history_summary(log.where("url IS NOT NULL"), None).collect())
    for order in ("id", "reverse(id)"):
        root = shared_folder(spark, "live")
        for k in range(3):
            log.orderBy(F.expr(order)).offset(k * 134).limit(134).coalesce(1).write.mode("append").parquet(f"{root}/arriving")
        arriving = streams.read_stream(spark, f"{root}/arriving", log.schema, files_per_batch=1)
        for _ in range(2):  # the second run finds nothing new
            streams.history_stream(arriving, root, f"{root}/checkpoint").awaitTermination()
        got = streams.live_history(spark, root).collect()
        assert sorted((r.url, r.previous_scans, r.past_verdicts) for r in got if r.url is not None) == want
        assert [r.previous_scans for r in got if r.url is None] == [8]
    root = shared_folder(spark, "live")
    log.limit(0).write.parquet(f"{root}/arriving")
    streams.history_stream(streams.read_stream(spark, f"{root}/arriving", log.schema), root, f"{root}/checkpoint").awaitTermination()
    assert streams.live_history(spark, root).collect() == []


def test_catalog(spark):
    root = shared_folder(spark, "catalog")
    assert catalog.register_version(spark, root, "r1", "p1") == 1
    assert catalog.register_version(spark, root, "r2", "p2") == 2
    info = lambda: catalog.production_info(catalog.read_versions(spark, root), catalog.read_aliases(spark, root)).collect()
    assert info() == []
    assert catalog.promote_if_better(spark, root, 1, 0.9)
    assert not catalog.promote_if_better(spark, root, 2, 0.8)
    assert [(r["version"], r["test_f1"], r["run_id"]) for r in info()] == [(1, "0.900000", "r1")]
    assert catalog.promote_if_better(spark, root, 2, 0.9)
    assert info()[0]["version"] == 2


@pytest.fixture(scope="module")
def dataset(spark, sf_dir):
    """The labelled URL variants as CSV, with a few gaps."""
    rows = inputs.labelled_pages(spark, sf_dir).select("page_id", *FEATURES, TARGET)
    gap = lambda i: F.when(F.col("page_id") % 11 != i, F.col(FEATURES[i]))
    rows = rows.withColumns({FEATURES[i]: gap(i) for i in (1, 5, 6)}).drop("page_id")
    path = shared_folder(spark, "dataset") + ".csv"
    rows.write.option("header", True).csv(path)
    return path


GRID = {"DecisionTree": {"impurity": ["gini"]}, "AdaBoost": {"rounds": [3]}}


def test_training_job_end_to_end(spark, dataset):
    root = shared_folder(spark, "training")
    first = jobs.run_training_job(spark, dataset, root, "r1", GRID)
    assert first.version == 1 and first.accepted and first.report.count() == 2
    feedback = spark.createDataFrame(
        [("1", "u", 1, 0, '{"port": -1}', None), ("2", "u", 1, 0, "bad", None)], FEEDBACK_LOG
    )
    second = jobs.run_training_job(spark, dataset, root, "r2", {"AdaBoost": {"rounds": [2]}}, feedback, min_improvement=0.5)
    assert second.version == 2 and second.accepted is False
    champion = jobs.load_champion(spark, root)
    info = catalog.production_info(catalog.read_versions(spark, root), catalog.read_aliases(spark, root)).first()
    assert info["version"] == 1
    urls = spark.createDataFrame([("http://127.0.0.1/x",), ("https://plain.com/",)], "url string")
    scored, _ = jobs.score_urls(urls, champion.classify)
    found = {r["url"]: r for r in scored.collect()}
    assert found["http://127.0.0.1/x"]["label"] == "phishing" and found["https://plain.com/"]["label"] == "safe"
    assert found["http://127.0.0.1/x"]["having_IP_Address"] == -1  # the raw codes stay
    runs = logs.read_log(spark, root, "pipeline_runs")
    assert {r["run_id"] for r in history.run_history(runs).collect()} == {"r1", "r2"}
    counts = {s: store.read_split(spark, root, "r1", s).count() for s in ("train", "test")}
    assert counts["test"] == -(-sum(counts.values()) // 5)


def test_training_job_halts_on_a_broken_contract(spark, dataset):
    root = shared_folder(spark, "broken")
    path = shared_folder(spark, "broken-data") + ".csv"
    read_dataset(spark, dataset).drop("Iframe").write.option("header", True).csv(path)
    with pytest.raises(ValueError, match="contract"):
        jobs.run_training_job(spark, path, root, "r1", GRID)
    assert store.read_split(spark, root, "r1", "train", "invalid").count() > 0


def test_missing_dataset_fails(spark):
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        read_dataset(spark, "/nowhere/data.csv")


def test_drift_job_self_check(spark, dataset):
    root = shared_folder(spark, "drift")
    report = jobs.run_drift_job(spark, dataset, None, root, "r1")
    assert report.count() == 30 and report.where("drifted").count() == 0
    stored = spark.read.json(f"{root}/drift_summary").first()
    assert stored["n_features"] == 30 and stored["dataset_drift"] is False and len(stored["features"]) == 30


def test_scan_stream_restarts_without_repeats(spark, sf_dir):
    root, source = shared_folder(spark, "stream"), shared_folder(spark, "source")
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("url")
    pages.limit(20).coalesce(1).write.mode("append").parquet(source)
    logs.ensure_logs(spark, root)
    run = lambda: streams.score_stream(
        streams.read_stream(spark, source, pages.schema), classify, root, f"{root}/cp"
    ).awaitTermination()
    run()
    run()
    assert logs.read_log(spark, root, "scan_history").count() == 20
    spark.createDataFrame([("http://late.com",), ("  ",)], "url string").write.mode("append").parquet(source)
    run()
    assert logs.read_log(spark, root, "scan_history").count() == 21
    assert spark.read.parquet(f"{root}/rejected_urls").count() == 1


def test_window_counts_keep_the_latest_total(spark):
    root, source = shared_folder(spark, "window"), shared_folder(spark, "window-source")
    rows = lambda values: spark.createDataFrame(
        [(dt.datetime(2024, 1, 1, 5), float(v)) for v in values], "ts timestamp, f double"
    )
    rows([1, 1, 0]).coalesce(1).write.mode("append").parquet(source)
    run = lambda: streams.drift_stream(
        streams.read_stream(spark, source, rows([1]).schema), root, f"{root}/cp", ["f"]
    ).awaitTermination()
    run()
    rows([1]).coalesce(1).write.mode("append").parquet(source)
    run()
    found = {r["value"]: r["n"] for r in streams.stored_counts(spark, root).collect()}
    assert found == {0.0: 1, 1.0: 3}


def event_days(spark, arrivals, lateness="1 day", shares=3):
    """The stream's counts and late rows after batches of (ts, value)."""
    root = shared_folder(spark, "event-days")
    for rows in arrivals:
        batch = spark.createDataFrame(rows, "ts timestamp, f double")
        batch.coalesce(1).write.mode("append").parquet(f"{root}/arriving")
        for _ in range(2):  # the second run finds nothing new
            arriving = streams.read_stream(spark, f"{root}/arriving", batch.schema)
            streams.event_time_drift_stream(arriving, root, f"{root}/cp", ["f"], lateness=lateness, shares=shares).awaitTermination()
    counts = {(r.day and r.day.day, r.value): r.n for r in streams.event_day_counts(spark, root).collect()}
    return counts, {r.day and r.day.day: r.n for r in streams.late_rows(spark, root).collect()}, root


def test_late_rows_within_the_watermark_change_their_day(spark):
    at = lambda day, hour=1: dt.datetime(2024, 1, day, hour)
    first = [(at(1), 1.0), (at(1), 1.0), (at(2, 23), 0.0)]
    in_time = [(at(1, 5), 1.0), (at(1, 23), None), (at(4, 2), float("nan"))]  # day 1 ends after the mark of 1 January 23:00
    too_late = [(at(1), 1.0), (at(2), 7.0), (at(3), 5.0), (None, 9.0)]  # the mark is 3 January 02:00 now
    counts, late, root = event_days(spark, [first, in_time, too_late])
    assert counts == {(1, 1.0): 3, (1, None): 1, (2, 0.0): 1, (4, None): 1, (3, 5.0): 1}
    assert late == {1: 1, 2: 1, None: 1}
    reference = spark.createDataFrame([("f", 1.0, 4)], "feature string, value double, n long")
    report = streams.window_drift(reference, streams.event_day_counts(spark, root).where("day = '2024-01-01'"), ["f"])
    assert report.count() == 1
    assert event_days(spark, [[]])[:2] == ({}, {})


def test_event_days_of_a_hot_day_add_up(spark):
    rows = [(dt.datetime(2024, 1, 1 + (k % 3 == 0) * (k % 9 + 1)), float(k % 4)) for k in range(600)]
    one, many = (event_days(spark, [rows[:400], rows[400:]], "30 days", shares)[:2] for shares in (1, 7))
    assert one == many and sum(one[0].values()) == 600 and not one[1]


def test_sketched_values_keep_quantiles(spark):
    values = [0.0, -3.5, 1e-9, 12345.678, float("inf"), float("nan"), None, *[k * 1.37 for k in range(1, 1000)]]
    df = spark.createDataFrame([(v,) for v in values], "v double").select("v", sketch_value(F.col("v")).alias("s"))
    rows = df.collect()
    for v, s in rows:
        if v is None or v != v:
            assert s is None
        else:
            assert s == v or abs(s - v) <= 0.0100001 * abs(v)
    median = lambda c: df.where("v < 1e6 AND v > 0").agg(F.percentile(c, 0.5)).first()[0]
    assert abs(median("s") / median("v") - 1) < 0.011 and len({s for _, s in rows}) < 400


def test_stream_history_keeps_one_state_for_a_cold_url(spark):
    """Forty scans of a URL are one state, not sixteen; only a URL that is hot in a part is dealt to shares."""
    root = shared_folder(spark, "history-states")
    cold = "SELECT concat('http://c', k, '/') AS url, concat(k, '-', i) AS id, i % 7 AS i, i % 3 AS p FROM (SELECT explode(sequence(0, 19)) AS k) LATERAL VIEW explode(sequence(0, 39)) AS i"
    hot = "SELECT 'http://hot/' AS url, concat('h', id) AS id, id AS i, id % 2 AS p FROM range(4000)"
    odd = "SELECT * FROM VALUES (NULL, 'a', 1, 0), (NULL, NULL, NULL, 1), ('http://c0/', NULL, NULL, NULL), ('http://c0/', 'z', NULL, 0) AS t(url, id, i, p)"
    scans = spark.sql(f"SELECT url, id, timestamp_seconds(i) AS created_at, cast(p AS int) AS prediction FROM ({cold} UNION ALL {hot} UNION ALL {odd})")
    scans.coalesce(1).write.parquet(f"{root}/arriving")
    log = spark.read.parquet(f"{root}/arriving")
    streams.history_stream(streams.read_stream(spark, f"{root}/arriving", log.schema), root, f"{root}/checkpoint").awaitTermination()
    states = {r["url"]: r["n"] for r in spark.read.parquet(f"{root}/url_history").groupBy("url").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert all(states[f"http://c{k}/"] == 1 for k in range(20)) and len(states) == 22
    assert sorted(map(repr, streams.live_history(spark, root).collect())) == sorted(map(repr, history.history_summary(log, None).select("url", "previous_scans", "past_verdicts").where("url IS NOT NULL").collect() + streams.live_history(spark, root).where("url IS NULL").collect()))
    assert streams.live_history(spark, root).where("url IS NULL").first()["previous_scans"] == 2
