"""Files read and written, and streams over several micro-batches."""

import datetime as dt
import os

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from kbspark.catalog import fixtures as X
from kbspark.catalog import stream_queries as S
from kbspark.catalog import usage_queries as U
from kbspark.operators import limits, usage
from kbspark.sources import readers, sinks
from kbspark.streaming import jobs

SF_DIR = "/root/testdata/sf0.001"


def test_scan_kb_text(spark, tmp_path):
    (tmp_path / "a.TXT").write_bytes(b" caf\xc3\xa9 \xff ")
    (tmp_path / "b.txt").write_text("two")
    (tmp_path / "c.pdf").write_text("no")
    got = {r["file_name"]: r["content"] for r in readers.scan_kb_text(spark, str(tmp_path), "KB").collect()}
    assert got == {"a.TXT": "café \ufffd", "b.txt": "two"}
    ignored = {r["file_name"]: r["content"] for r in readers.scan_kb_text(spark, str(tmp_path), "KB", "ignore").collect()}
    assert ignored["a.TXT"] == "café"


def test_scan_urls_policy_and_csv(spark, tmp_path):
    (tmp_path / "urls.json").write_text('{\n "urls": ["http://a", "http://a",\n "http://b"]}')
    assert {r["url"] for r in readers.scan_url_list(spark, str(tmp_path / "urls.json")).collect()} == {"http://a", "http://b"}
    (tmp_path / "p.json").write_text('{"a_b": [1, "x"], "c": 2}')
    assert readers.scan_policy_json(spark, str(tmp_path / "p.json")).first()["content"] == "A B:\n- 1\n- x\nC: 2"
    (tmp_path / "l.csv").write_bytes(b"text,label\r\n\"a, b\",x\r\n\r\nc,y\r\n")
    rows = readers.scan_labelled_csv(spark, str(tmp_path / "l.csv")).collect()
    assert sorted((r["text"], r["label"].strip()) for r in rows) == [("a, b", "x"), ("c", "y")]


def test_vectors_drop_bad_rows(spark, tmp_path):
    rows = spark.createDataFrame(
        [(1, "KB", "t", [1.0, 2.0]), (2, "KB", None, [1.0, 2.0]), (3, "URL", "u", [1.0])], "chunk_id bigint, source string, text string, embedding array<double>")
    path = str(tmp_path / "v")
    sinks.write_vectors(rows, path)
    assert sorted(os.listdir(path))[-2:] == ["source=KB", "source=URL"]
    assert [r["chunk_id"] for r in sinks.read_vectors(spark, path, 2).collect()] == [1]
    assert sinks.read_vectors(spark, str(tmp_path / "none")).count() == 0
    assert readers.scan_url_list(spark, str(tmp_path / "none.json")).count() == 0


def test_vector_table_versions_rejects_and_damage(spark, tmp_path):
    schema = "chunk_id bigint, source string, text string, embedding array<double>"
    nan = float("nan")
    bad = [(2, "KB", None, [1.0, 2.0]), (3, "URL", "u", [1.0]), (4, "KB", "v", None), (5, "KB", "w", [nan, 1.0]), (6, "KB", "x", [None, 1.0])]
    path = str(tmp_path / "v")
    first = sinks.write_vectors(spark.createDataFrame([(1, "KB", "t", [1.0, 2.0]), *bad], schema), path)
    reasons = {r["chunk_id"]: r["reason"] for r in sinks.vector_rejects(spark, path, 2).collect()}
    assert reasons == {2: "missing_text", 3: "wrong_dimension", 4: "missing_vector", 5: "bad_value", 6: "bad_value"}
    more = spark.createDataFrame([(7, "KB", "y", [3.0, 4.0])], schema)
    with pytest.raises(ValueError):
        sinks.write_vectors(more, path)
    # What no manifest lists is not read.
    more.withColumn("version", F.lit("v00000002-lost")).write.mode("append").partitionBy("source", "version").parquet(path)

    def ids(**options):
        return sorted(r["chunk_id"] for r in sinks.read_vectors(spark, path, 2, **options).collect())

    assert ids() == [1]
    second = sinks.write_vectors(more, path, "append")
    assert ids(content=True) == [1, 7] and ids(version=first) == [1] and first < second
    sinks.write_vectors(more, path, "overwrite")
    assert ids() == [7] and ids(version=second) == [1, 7]
    empty = str(tmp_path / "e")
    sinks.write_vectors(more.limit(0), empty)
    assert sinks.read_vectors(spark, empty).count() == 0
    # A file of the first version goes missing, and comes back with another text.
    files = [f for f in (tmp_path / "v" / "source=KB").rglob("*.parquet") if first in str(f)]
    kept = files[0].read_bytes()
    files[0].unlink()
    with pytest.raises(sinks.DamagedTable, match="1 files missing"):
        ids(version=second)
    files[0].write_bytes(kept)
    assert ids(version=second, content=True) == [1, 7]
    rows = pq.ParquetFile(files[0]).read()
    place = rows.column_names.index("text")
    files[0].with_name(f".{files[0].name}.crc").unlink()
    pq.write_table(rows.set_column(place, "text", pa.array(["other"] * len(rows))), files[0])
    with pytest.raises(sinks.DamagedTable, match="1 changed"):
        ids(version=second, content=True)


def test_guarded_csv(spark, tmp_path):
    rows = spark.createDataFrame([("=1+1", 1), ("-x", 2), ("ok, \"q\"", 3)], "a string, n int")
    path = str(tmp_path / "c")
    sinks.write_csv_guarded(rows, path)
    got = {r["n"]: r["a"] for r in sinks.read_csv(spark, path, rows.schema).collect()}
    assert got == {1: "'=1+1", 2: "'-x", 3: 'ok, "q"'}


@pytest.fixture(scope="module")
def event_files(spark, tmp_path_factory):
    """The events in time order, as four files that arrive one after the other."""
    folder = str(tmp_path_factory.mktemp("events"))
    events = spark.read.parquet(f"{SF_DIR}/events.parquet").orderBy("ts", "event_id").toPandas()
    size = -(-len(events) // 4)
    for i in range(4):
        path = os.path.join(folder, f"part{i}.parquet")
        events.iloc[i * size:(i + 1) * size].to_parquet(path, coerce_timestamps="us", allow_truncated_timestamps=True)
        os.utime(path, (1_700_000_000 + i, 1_700_000_000 + i))
    return folder


def stream_of(spark, folder):
    schema = spark.read.parquet(folder).schema
    return X.log_columns(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder))


def finished(spark, stream, tmp_path):
    jobs.run_available(stream, str(tmp_path / "out"), str(tmp_path / "progress"))
    return spark.read.parquet(str(tmp_path / "out"))


def pairs(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_table_stream_of_a_file_and_of_a_folder(spark, tmp_path):
    """Small tables are one file, larger ones a folder of files of the same name."""
    rows = spark.range(30).withColumn("text", F.lit("x"))
    rows.repartition(3).write.parquet(str(tmp_path / "large" / "t.parquet"))
    (tmp_path / "small").mkdir()
    rows.toPandas().to_parquet(str(tmp_path / "small" / "t.parquet"))
    rows.limit(3).toPandas().to_parquet(str(tmp_path / "small" / "other.parquet"))
    for kind in ("small", "large"):
        stream = jobs.table_stream(spark, str(tmp_path / kind), "t.parquet")
        jobs.run_available(stream, str(tmp_path / f"{kind}-out"), str(tmp_path / f"{kind}-progress"))
        assert spark.read.schema("id long, text string").parquet(str(tmp_path / f"{kind}-out")).count() == 30


def test_limit_stream_equals_batch(spark, event_files, tmp_path):
    stream = jobs.limited(stream_of(spark, event_files), ("endpoint",), U.RATE, U.RATE_SECONDS)
    batch = limits.sliding_log(
        X.request_log(spark, SF_DIR), ("endpoint",), limits.limit_of(F.col("endpoint"), U.RATE), U.RATE_SECONDS)
    assert pairs(finished(spark, stream, tmp_path), "event_id", "accepted") == pairs(batch, "event_id", "accepted")


def test_quota_stream_equals_batch(spark, event_files, tmp_path):
    stream = jobs.quota(X.shift_days(stream_of(spark, event_files), 15), 20, 9)
    batch = usage.autoblock(X.shift_days(X.request_log(spark, SF_DIR), 15), 20, 9)
    columns = ("event_id", "month", "allowed", "block_reason")
    assert pairs(finished(spark, stream, tmp_path), *columns) == pairs(batch, *columns)


def test_usage_stream_equals_batch(spark, event_files, tmp_path):
    sink = jobs.usage_sink(str(tmp_path / "usage"))
    jobs.run_available(stream_of(spark, event_files), "", str(tmp_path / "progress"), sink)
    want = usage.monthly_usage(X.request_log(spark, SF_DIR))
    columns = ("tenant_id", "month", "total_requests", "llm_calls", "estimated_ai_cost")
    assert pairs(sinks.read_usage(spark, str(tmp_path / "usage")), *columns) == pairs(want, *columns)
    days = sinks.read_daily_usage(spark, str(tmp_path / "usage"))
    daily = usage.daily_usage(X.request_log(spark, SF_DIR))
    assert pairs(days, "tenant_id", "usage_date", "llm_calls") == pairs(daily, "tenant_id", "usage_date", "llm_calls")
    peaks = ("tenant_id", "month", "peak_day")
    assert pairs(usage.peak_day(days), *peaks) == pairs(usage.peak_day(daily), *peaks)


def test_usage_increments_are_summed_into_levels(spark, tmp_path):
    path = str(tmp_path / "usage")
    assert sinks.read_usage(spark, path).count() == 0
    day = "timestamp'2024-01-01 10:00:00' + make_dt_interval({})"

    def add(batch):
        log = spark.range(batch + 1).select(F.lit("t").alias("tenant_id"), F.expr(day.format(batch % 3)).alias("ts"), F.lit(True).alias("is_llm"))
        sinks.add_usage(usage.usage_increments(log), path, batch, fan=2)

    calls = {}
    for batch in range(9):
        add(batch)
        if batch in (3, 4, 8):
            os.remove(f"{path}/level=0/block={batch}/_SUCCESS")   # the batch failed before its end
            add(batch)                                            # and is replayed
        calls[batch % 3] = calls.get(batch % 3, 0) + batch + 1
        row = sinks.read_usage(spark, path, fan=2).first()
        assert row["total_requests"] == row["llm_calls"] == sum(calls.values())
        days = {r["usage_date"].day - 1: r["llm_calls"] for r in sinks.read_daily_usage(spark, path, fan=2).collect()}
        assert days == calls
    assert sum(len(os.listdir(f"{path}/{level}")) for level in os.listdir(path)) <= 6
    os.makedirs(f"{path}/level=2/block=7")   # an entry that was never committed is not read
    assert sinks.read_usage(spark, path, fan=2).first()["total_requests"] == sum(calls.values())
    with pytest.raises(ValueError):
        add(1)


def test_logs_of_every_kind_keep_their_fields(spark, tmp_path):
    path = str(tmp_path / "logs")
    rows = spark.createDataFrame(
        [("t", "1", dt.datetime(2024, 1, 1, 10, 0, 0, 123456), 5, "x"), (None, None, None, None, None)],
        "tenant_id string, request_id string, created_at timestamp, latency_ms int, stray string")
    for kind in readers.LOG_SCHEMAS:
        sinks.write_log(rows, path, kind, 0)
        sinks.write_log(rows, path, kind, 0)   # the batch is replayed
        names = [f.split()[0] for f in readers.LOG_SCHEMAS[kind].replace("struct<", "").split(", ")]
        back = readers.scan_logs(spark, f"{path}/{kind}", kind)
        assert [c for c in back.columns if c != "batch"] == [n.split(":")[0] for n in names]
        assert back.count() == 2 and "stray" not in back.columns
    first = readers.scan_logs(spark, f"{path}/api_requests", "api_requests").filter("request_id = '1'").first()
    assert first["created_at"] == dt.datetime(2024, 1, 1, 10, 0, 0, 123456) and first["latency_ms"] == 5 and first["ip_hash"] is None
    sinks.write_log(rows.limit(0), path, "feedback", 1)
    assert readers.scan_logs(spark, f"{path}/feedback", "feedback").count() == 2


def test_audit_batches_replace_themselves(spark, tmp_path):
    path = str(tmp_path / "audit")
    assert sinks.read_audit(spark, path, "a int").count() == 0
    for batch, value in ((0, 1), (1, 2), (1, 2)):
        sinks.write_audit(spark.range(1).select(F.lit(value).alias("a")), path, batch)
    assert sorted(r["a"] for r in sinks.read_audit(spark, path, "a int").collect()) == [1, 2]


def test_usage_of_odd_logs(spark, tmp_path):
    path = str(tmp_path / "usage")
    log = spark.createDataFrame([(None, dt.datetime(2024, 1, 1), None), ("t", None, True)], "tenant_id string, ts timestamp, is_llm boolean")
    sinks.add_usage(usage.usage_increments(log.limit(0)), path, 0)
    assert sinks.read_usage(spark, path).count() == 0
    sinks.add_usage(usage.usage_increments(log), path, 1)
    rows = sorted((r["tenant_id"] or "", r["month"] or "", r["total_requests"], r["llm_calls"]) for r in sinks.read_usage(spark, path).collect())
    assert rows == [("", "2024-01", 1, 0), ("t", "", 1, 1)]


def test_interaction_stream_equals_batch(spark, event_files, tmp_path):
    """Four files, then a heartbeat: every lookup has left, with the status that the batch gives it."""
    events = spark.read.parquet(event_files)
    beats = str(tmp_path / "beats")
    events.limit(0).write.parquet(beats)

    def log():
        reader = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1)
        return X.log_columns(reader.parquet(event_files).unionByName(reader.parquet(beats)))

    def run():
        return finished(spark, jobs.interactions(X.interaction_states(log()), X.interaction_lookups(log()), lateness="5 days"), tmp_path)

    batch = U.looked_up(spark, SF_DIR)
    columns = ("lookup_id", "state_status")
    assert pairs(run().filter("state_status <> 'unknown'"), *columns) == pairs(batch.filter("state_status <> 'unknown'"), *columns)
    last = events.agg(F.max("ts")).first()[0]
    closing = events.limit(1).withColumn("ts", F.lit(last + dt.timedelta(days=10)).cast(events.schema["ts"].dataType))
    S.closing_event(events.unionByName(closing), beats)
    got = pairs(run().filter("lookup_id >= 0"), *columns)
    assert got == pairs(batch, *columns)
    assert {status for _, status in got} == {"valid", "expired", "unknown"}


def test_lookup_long_after_its_state_is_unknown(spark, tmp_path):
    day = dt.datetime(2024, 1, 1)
    states = [("a", "t", "p", "k", day, day + dt.timedelta(hours=2))]
    lookups = [(n, "a", tenant, day + dt.timedelta(hours=h)) for n, tenant, h in ((1, "t", 1), (2, "t", 5), (3, "t", 40), (4, "u", 1), (5, "t", -1))]
    late = day + dt.timedelta(days=9)
    tables = {
        "s": ("interaction_id string, tenant_id string, purpose string, key_points string, created_at timestamp, expires_at timestamp",
              states, [("-", "-", None, None, late, late)]),
        "k": ("lookup_id bigint, interaction_id string, tenant_id string, requested_at timestamp", lookups, [(-1, "-", "-", late)]),
    }
    for beat in (False, True):
        streams = {}
        for name, (schema, rows, beats) in tables.items():
            spark.createDataFrame(beats if beat else rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / name))
            streams[name] = spark.readStream.schema(schema).parquet(str(tmp_path / name))
        out = finished(spark, jobs.interactions(streams["s"], streams["k"], 2, 24), tmp_path)
    assert pairs(out.filter("lookup_id > 0"), "lookup_id", "state_status") == [
        (1, "valid"), (2, "expired"), (3, "unknown"), (4, "unknown"), (5, "unknown")]


def test_index_sink_is_replay_safe_and_capped(spark, tmp_path):
    text = " ".join(f"word{i}" for i in range(200))
    files = spark.createDataFrame([("a.txt", text), ("b.txt", text + " more"), ("c.txt", "short")], "file_name string, content string")
    path = str(tmp_path / "index")
    sink = jobs.index_sink(path, dim=16)
    sink(files, 0)
    first = spark.read.parquet(path).count()
    sink(files, 0)      # the batch is replayed
    sink(files, 1)      # the same files arrive again
    assert spark.read.parquet(path).count() == first > 0
    with pytest.raises(jobs.VectorLimitExceeded):
        jobs.index_sink(path, dim=16, max_vectors=first)(spark.createDataFrame([("d.txt", text[::-1])], files.schema), 2)


def test_index_replaces_changed_files_and_keeps_rejects(spark, tmp_path):
    def words(start):
        return " ".join(f"word{i}" for i in range(start, start + 60))

    def state():
        rows = jobs.read_index(spark, path).select("file_name", "batch", "text").collect()
        return {(r["file_name"], r["batch"], r["text"].split()[0]) for r in rows}

    def refused():
        return {(r["file_name"], r["batch"], r["reason"]) for r in jobs.index_rejects(spark, path).collect()}

    path = str(tmp_path / "index")
    sink = jobs.index_sink(path, dim=16)

    def arrive(batch, *files):
        sink(spark.createDataFrame(list(files), "file_name string, content string"), batch)

    arrive(0, ("a", words(0)), ("b", words(100)), ("c", "short"), (None, words(0)), ("d", None), ("b", words(100)))
    assert state() == {("a", 0, "word0"), ("b", 0, "word100")}
    assert refused() == {("c", 0, "too_short"), (None, 0, "MISSING_FILE_NAME"), ("d", 0, "empty")}
    for _ in range(2):   # the batch comes twice
        arrive(1, ("a", words(200)), ("b", words(100)), ("b", "?"), ("c", words(300)))
        assert state() == {("a", 1, "word200"), ("b", 0, "word100"), ("c", 1, "word300")}
        assert ("b", 1, "too_short") in refused()
    arrive(2, ("a", words(0)), ("e", words(400)), ("e", words(500)))   # back to its first content; two of one name
    assert len(state()) == 4 and ("a", 2, "word0") in state()
    assert ("e", 2, "replaced_in_batch") in refused() and len({s for s in state() if s[0] == "e"}) == 1
    arrive(3, ("a", words(0)))
    assert ("a", 2, "word0") in state() and len(state()) == 4
