"""Scalar functions, document ingest from files, event logs, run documents."""

from __future__ import annotations

import json
import tempfile

import pytest

from pyspark.sql import functions as F

from fleetscope.functions import classify, parsing, text
from fleetscope.operators import rollups, tables
from fleetscope.sources import event_log, rest_documents as rest
from fleetscope.sources.run_store import RunStore, read_run_documents


def values(spark, rows, kind, *columns):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, x {kind}")
    return [tuple(r)[1:] if len(columns) > 1 else r[1] for r in df.select("i", *columns).orderBy("i").collect()]


def test_format_bytes(spark):
    cases = {None: "--", 0: "0 B", 1: "1 B", 1023: "1023 B", 1024: "1.0 KB", 1280: "1.2 KB", 1408: "1.4 KB", 1048575: "1024.0 KB", 1048576: "1.0 MB",
             3 * 1024**3 + 200 * 1024**2: "3.2 GB", 2 * 1024**4: "2.0 TB", 5 * 1024**5: "5.0 PB", 3000 * 1024**5: "3000.0 PB", -1024: "-1.0 KB"}
    assert values(spark, cases, "bigint", text.format_bytes("x")) == list(cases.values())
    assert values(spark, cases, "bigint", text.format_bytes(F.col("x") + 0)) == list(cases.values())


def test_format_duration(spark):
    cases = {None: "--", 0: "0s", 999: "0s", 1000: "1s", 60000: "1m", 135000: "2m 15s", 3600000: "1h", 97800000: "1d 3h 10m", -5000: "-5s"}
    assert values(spark, cases, "bigint", text.format_duration("x")) == list(cases.values())


def test_fixed_and_percent(spark):
    assert values(spark, [0.25, 0.35, 12.0], "double", text.fixed("x", 1)) == ["0.2", "0.4", "12.0"]
    assert values(spark, [0.125, 0.5], "double", text.percent(F.col("x"))) == ["12%", "50%"]


def test_parse_byte_string(spark):
    cases = {"64MB": 64 * 1024**2, " 1g ": 1024**3, "256m": 256 * 1024**2, "1.5k": 1536, "2t": 2 * 1024**4, "10b": 10, "123": 123, "12.5": None, "abc": None, "mb": None, "": None}
    assert values(spark, cases, "string", parsing.parse_byte_string(F.col("x"))) == list(cases.values())


def test_parse_times(spark):
    iso = 1773748800250
    cases = {"2026-03-17T12:00:00.250GMT": iso, "2026-03-17T12:00:00.250Z": iso, "2026-03-17T14:00:00.250+0200": iso, "2026-03-17T14:00:00.250+02:00": iso,
             "1700000000000": 1700000000000, "2026-03-17": None, "soon": None, "": None, None: None}
    assert values(spark, cases, "string", F.unix_millis(parsing.parse_spark_ts(F.col("x")))) == list(cases.values())


def test_coercion(spark):
    assert values(spark, ["7", " -3 ", "x", "2.5", None], "string", parsing.safe_int(F.col("x"))) == [7, -3, 0, 0, 0]
    assert values(spark, ["7", "2.9", None], "string", parsing.json_int(F.col("x"))) == [7, 2, 0]
    assert values(spark, ["running", "odd", None], "string", parsing.coerce_enum(F.col("x"), classify.JOB_STATES, "UNKNOWN")) == ["RUNNING", "UNKNOWN", "UNKNOWN"]


def test_classes(spark):
    errors = {"java.lang.OutOfMemoryError": "OOM", "gc overhead LIMIT exceeded": "OOM", "killed by external signal": "CONTAINER_KILLED",
              "running beyond the physical memory limit": "CONTAINER_KILLED", "FetchFailedException": "SHUFFLE_FETCH", "Connection refused": "SHUFFLE_FETCH",
              "Task not serializable": "SERIALIZATION", "TimeoutException": "TIMEOUT", "Heartbeat of 5 timed out": "TIMEOUT", "boom": "UNKNOWN", "": "UNKNOWN", None: "UNKNOWN"}
    assert values(spark, errors, "string", classify.classify_error(F.col("x"))) == list(errors.values())
    removals = {"Container killed by YARN for exceeding memory limits": "CONTAINER_KILLED", "over the memory limit": "OOM", "worker lost": "TIMEOUT", "shuffle": "SHUFFLE_FETCH", "idle": "UNKNOWN"}
    assert values(spark, removals, "string", classify.classify_removal(F.col("x"))) == list(removals.values())
    assert values(spark, ["CRITICAL", "INFO", "odd"], "string", classify.severity_rank(F.col("x"))) == [0, 2, 99]
    assert values(spark, [90, 89, 70, 50, 30, 29], "int", classify.score_label(F.col("x"))) == ["Excellent", "Good", "Good", "Fair", "Poor", "Critical"]


def test_redaction(spark):
    conf = {"spark.a.SECRET": "1", "spark.disaster": "2", "fs.account.key.x": "3", "spark.sql.x": "4", "my.Password": "5"}
    left = spark.createDataFrame([(conf,)], "c map<string,string>").select(classify.redact_conf(F.col("c")).alias("c")).collect()[0].c
    assert left == {"spark.sql.x": "4"}


def test_text_filter_is_literal(spark):
    df = spark.createDataFrame([("50% done",), ("500 done",), (None,)], "x string")
    assert [r.x for r in tables.text_filter(df, "50%", ["x"]).collect()] == ["50% done"]
    assert tables.text_filter(df, "none", ["x"]).count() == 1 and tables.text_filter(df, "  ", ["x"]).count() == 3


def test_documents_from_files(spark):
    folder = tempfile.mkdtemp(prefix="fs-docs-")
    jobs = [{"jobId": 3, "name": "", "description": "d", "status": "running", "stageIds": [1, 2], "submissionTime": "2026-03-17T12:00:00.000GMT"}, {"jobId": "x"}]
    tasks = {"7": {"taskId": 7, "status": "FAILED", "taskMetrics": {"jvmGcTime": 4}}, "8": {"taskId": 8, "status": "odd", "taskMetrics": {"jvmGCTime": 5}}}
    lines = [json.dumps({"cluster_id": "c", "tick": 1, "slot": s, "payload": p}) for s, p in (("jobs", jobs), ("tasks", tasks), ("tasks", list(tasks.values())))]
    with open(f"{folder}/polls.json", "w") as f:
        f.write("\n".join([*lines, '{"cluster_id": "c", "tick": ']) + "\n")
    good, bad = rest.read_documents(spark, folder)
    assert bad.count() == 1
    first, second = rest.ingest_jobs(rest.explode_list(good.filter("slot = 'jobs'"))).orderBy("pos").collect()
    assert (first.job_id, first.name, first.status, first.num_stages, first.stage_ids) == (3, "d", "RUNNING", 2, [1, 2])
    assert (second.job_id, second.name, second.status, second.num_stages, second.submission_time) == (0, "", "UNKNOWN", 0, None)
    rows = rest.ingest_tasks(rest.explode_object(good.filter("slot = 'tasks'"))).orderBy("task_id").collect()
    assert [(r.task_id, r.status, r.metrics.jvm_gc_time_ms) for r in rows] == [(7, "FAILED", 4)] * 2 + [(8, "PENDING", 5)] * 2


def test_event_log(spark):
    folder = tempfile.mkdtemp(prefix="fs-log-")
    end = {"Event": "SparkListenerTaskEnd", "Stage ID": 2, "Stage Attempt ID": 1, "Task End Reason": {"Reason": "ExceptionFailure", "Description": "boom"},
           "Task Info": {"Task ID": 9, "Attempt": 0, "Launch Time": 1000, "Finish Time": 1500, "Executor ID": "4", "Failed": True, "Killed": False},
           "Task Metrics": {"Executor Run Time": 400, "JVM GC Time": 40, "Shuffle Read Metrics": {"Remote Bytes Read": 5}}}
    with open(f"{folder}/log", "w") as f:
        f.write("\n".join(map(json.dumps, [{"Event": "SparkListenerJobStart"}, end])))
    row = event_log.finished_tasks(event_log.read_event_log(spark, folder), "c").collect()
    assert len(row) == 1
    r = row[0]
    assert (r.cluster_id, r.stage_id, r.task_id, r.status, r.duration_ms, r.error_message) == ("c", 2, 9, "FAILED", 500, "boom")
    assert (r.metrics.jvm_gc_time_ms, r.metrics.shuffle_read_bytes, r.metrics.input_bytes) == (40, 5, 0)
    log = event_log.read_event_log(spark, folder)
    tasks = event_log.finished_tasks(log.union(log), "c", tick_seconds=1)
    stage = rollups.stage_rollup(tasks).collect()
    assert [(s.cluster_id, s.tick, s.stage_id, s.num_tasks, s.num_failed_tasks, s.jvm_gc_time_ms) for s in stage] == [("c", 1, 2, 2, 2, 80)]
    executor = rollups.executor_rollup(tasks).collect()
    assert [(e.tick, e.executor_id, e.failed_tasks, e.total_duration_ms) for e in executor] == [(1, "4", 2, 1000)]


def test_unreadable_runs_are_split_off(spark):
    folder = tempfile.mkdtemp(prefix="fs-runs-")
    with open(f"{folder}/runs.json", "w") as f:
        f.write('{"run_id": "a", "score": 5}\n{"run_id": \n')
    good, bad = read_run_documents(spark, folder, "run_id string, score int")
    assert [r.run_id for r in good.collect()] == ["a"] and bad.count() == 1


def test_every_line_is_good_or_bad(spark):
    folder = tempfile.mkdtemp(prefix="fs-lines-")
    lines = ['{"run_id":"r1","score":1}', '{"run_id":"r2","score":"abc"}', "{broken", '{"run_id":"r3"}', "[1]", "", '"text"', '{"run_id":4,"score":2}']
    with open(f"{folder}/runs.json", "w") as f:
        f.write("\n".join(lines))
    good, bad = read_run_documents(spark, folder, "run_id string, score int")
    assert sorted(r.run_id for r in good.collect()) == ["4", "r1", "r3"]
    assert sorted(r.value for r in bad.collect()) == sorted(['{"run_id":"r2","score":"abc"}', "{broken", "[1]", '"text"'])
    with open(f"{folder}/runs.json", "w") as f:
        f.write('{"tick":"x","slot":"jobs","cluster_id":"c","payload":[]}\n{"tick":1,"slot":"jobs","cluster_id":"c","payload":[]}')
    good, bad = rest.read_documents(spark, folder)
    assert [r.payload for r in good.collect()] == ["[]"] and bad.count() == 1


def test_run_store_keeps_ids_and_names_broken_files(spark):
    root = tempfile.mkdtemp(prefix="fs-store-")
    store = RunStore(spark, root)
    ids = [("007", "0123"), ("7", "123"), ("1", "4e2"), ("2020-01-01", "true")]
    rows = spark.createDataFrame([(c, r, n) for c, r in ids for n in range(50)], "cluster_id string, run_id string, start_tick int")
    store.save("runs", rows, files=3)
    store.save("runs", rows.limit(0))
    assert sorted({(r.cluster_id, r.run_id) for r in store.scan("runs").collect()}) == sorted(ids) and store.scan("runs").count() == 200
    assert store.lookup("runs", "007", "0123").count() == 50 and store.lookup("runs", "7", "0123").count() == 0
    assert store.delete("1", "4e2") and not store.delete("1", "4e2") and not store.delete("1", "400")
    after = store.compact(["runs"])
    assert sorted({(r.cluster_id, r.run_id) for r in after.scan("runs").collect()}) == sorted(ids[:2] + ids[3:])
    assert after.unreadable("runs").count() == 0
    with open(f"{root}/v1/runs/cluster_id=007/run_id=0123/broken.parquet", "wb") as f:
        f.write(b"PAR1 cut off")
    assert [r.path.rsplit("/", 1)[1] for r in after.unreadable("runs").collect()] == ["broken.parquet"]
    assert after.scan("runs").count() == 150 and after.lookup("runs", "007", "0123").count() == 50
    with pytest.warns(UserWarning, match="broken.parquet"):
        after.runs("007")
