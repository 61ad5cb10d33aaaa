from datetime import datetime

import pytest
from pyspark.sql import functions as F

from logspark.operators import chunks, lifecycle, placement, quota, search, selector, telemetry, tenants
from logspark.operators.stages import Stage
from logspark.plans import catalogue
from logspark.schema import canonical

SCHEMA = "ingest_seq long, ts_ns long, tenant_id string, body string, stream_labels map<string,string>, parsed_fields map<string,string>, resource_attrs map<string,string>, tier byte"


def events(spark, *rows):
    full = [(i, ts, "t", body, labels, fields, {}, 0) for i, (ts, body, labels, fields) in enumerate(rows)]
    return canonical(spark.createDataFrame(full, SCHEMA))


@pytest.fixture()
def three(spark):
    rows = [(1000, b, {"service": "api", "env": "prod"}, {"status": s}) for b, s in (("timeout alpha", "500"), ("timeout beta", "200"), ("success", "200"))]
    return events(spark, *rows)


def test_conditions(three):
    q = search.Query("t", 1000, 1000, labels={"service": "api"}, fields={"status": "500"}, contains="TIMEOUT")
    assert [r.body for r in search.search(three, q).collect()] == ["timeout alpha"]
    assert search.search(three, search.Query("t", 0, 999)).count() == 0 == search.search(three, search.Query("u", 0, 2000)).count()
    assert search.search(three, search.Query("t", 0, 2000, labels={"none": ""})).count() == 3


def test_pages(three):
    q = search.Query("t", 0, 2000, regex=r"timeout\s+\w+", limit=1)
    seen = []
    for _ in range(2):
        seen += [r.body for r in search.search(three, q).collect()]
        q = search.Query("t", 0, 2000, regex=q.regex, limit=1, cursor=search.next_cursor(three, q))
    assert seen == ["timeout alpha", "timeout beta"] and q.cursor == ""


def test_tail(spark):
    e = events(spark, (10**9, "old", {}, {}), (2 * 10**9, "new", {}, {}))
    assert [r.body for r in search.search(e, search.tail("t", 3 * 10**9, limit=1)).collect()] == ["new"]


@pytest.mark.parametrize("bad", [{"tenant_id": " "}, {"end_ns": -1}, {"limit": -1}, {"cursor": "x"}, {"regex": r"(a)\1"}])
def test_bad_queries(bad):
    with pytest.raises(ValueError):
        search.Query(**{"tenant_id": "t", "start_ns": 0, "end_ns": 1, **bad})


def test_merged_keeps_stored(three):
    new = three.withColumn("tier", F.lit(1).cast("byte")).withColumn("severity", F.lit("other"))
    out = search.merged(three, new).collect()
    assert len(out) == 3 and all(r.tier == 0 for r in out)


def test_postings(three):
    assert {(r.key, r.value, r.events) for r in search.postings(three).collect()} == {("service", "api", 3), ("env", "prod", 3)}
    assert search.intersect_postings(three, {"service": "api", "env": "dev"}).count() == 0
    assert tuple(search.candidate_stats(three, search.Query("t", 0, 2000)).first()) == (3, 1)


def test_chunks(spark):
    e = events(spark, *[(k * 10, "x" * 10, {"s": "a"}, {"f": "1"}) for k in range(7)], (5000, "y", {"s": "a"}, {}), (5001, "z", {"s": "b"}, {}))
    got = sorted((r.ingest_seq, r.chunk) for r in chunks.build_chunks(e, 3, 10**6, 10**6).where("stream_key = 't|s=a'").collect())
    assert got == [(0, 0), (1, 0), (2, 0), (3, 1), (4, 1), (5, 1), (6, 2), (7, 2)]
    by_time = sorted((r.ingest_seq, r.chunk) for r in chunks.build_chunks(e, 100, 10**6, 1000).where("stream_key = 't|s=a'").collect())
    assert [c for _, c in by_time] == [0] * 8
    by_bytes = [r.chunk for r in chunks.build_chunks(e, 100, 30, 10**9).where("stream_key = 't|s=a'").orderBy("ingest_seq").collect()]
    assert by_bytes[:4] == [0, 0, 1, 1]
    s = chunks.summaries(chunks.numbered(e), "stream_key").where("stream_key = 't|s=a'")
    r = s.first()
    assert (r.event_count, r.min_ts_ns, r.max_ts_ns, r.field_names, r.tokens) == (8, 0, 5000, ["f"], ["x" * 10, "y"])
    found = s.select(chunks.may_contain("Y").alias("a"), chunks.may_contain("nothere").alias("b"), chunks.may_contain("!").alias("c")).first()
    assert found.a and not found.b and found.c


def test_placement(spark):
    keys = spark.createDataFrame([(f"default|service={i}",) for i in range(5)], "key string")
    members = [("a", "ready"), ("b", "ready"), ("c", "ready")]
    before = placement.place(keys, members)
    after = placement.place(keys, members[1:])
    assert len({r.members[0] for r in before.collect()}) >= 2
    assert all("a" not in r.members for r in after.collect())
    assert sum(r.primaries for r in placement.balance(before).collect()) == 5
    moves = placement.reconcile(placement.assignments(after), placement.assignments(before))
    assert {r.member for r in moves.where("action = 'delete'").collect()} <= {"a"}
    one = placement.place(keys, members[:1])
    assert {r.acks for r in placement.acknowledgement(one, 2).collect()} == {"partial"} and {r.acks for r in placement.acknowledgement(one).collect()} == {"full"}
    assert placement.place(keys, []).first().members == []


def test_queue(spark, three):
    m = lifecycle.enqueue(three, "topic")
    assert [r.offset for r in m.orderBy("offset").collect()] == [0, 1, 2]
    commits = m.select("topic", "partition", F.lit(2).alias("committed")).distinct()
    assert [(r.high, r.lag) for r in lifecycle.lag(m, commits).collect()] == [(3, 1)]
    assert [r.lag for r in lifecycle.lag(m, commits.withColumn("committed", F.lit(9))).collect()] == [0]


def test_retries(spark):
    m = spark.createDataFrame([(True, 0), (False, 0), (False, 1), (False, 2)], "ok boolean, attempts int")
    assert [(r.to, r.attempts) for r in lifecycle.after_failure(m, 2).collect()] == [("done", 0), ("retry", 1), ("dead", 2), ("dead", 3)]


def test_retention(spark):
    now = datetime(2024, 1, 10)
    segments = spark.createDataFrame([("a", "x", datetime(2024, 1, 9, 22), 2), ("a", "y", datetime(2024, 1, 9, 23, 55), 1), ("p", "x", datetime(2023, 1, 1), 1), ("u", "x", datetime(2024, 1, 2), 3)], "tenant_id string, bucket string, ends timestamp_ntz, chunks int")
    tenants = spark.createDataFrame([("a", 0, False, False), ("p", 1, True, False)], "tenant_id string, retention_days int, protected boolean, legal_hold boolean")
    got = {(r.tenant_id, r.bucket): r.expired for r in lifecycle.retention(segments, tenants, F.lit(now).cast("timestamp_ntz")).collect()}
    assert got == {("a", "x"): True, ("a", "y"): True, ("p", "x"): False, ("u", "x"): True}
    report = lifecycle.retention_report(lifecycle.retention(segments, tenants, F.lit(now).cast("timestamp_ntz")))
    assert {(r.tenant_id, r.scanned, r.deleted_segments, r.deleted_chunks) for r in report.collect()} == {("a", 2, 2, 3), ("p", 1, 0, 0), ("u", 1, 1, 3)}


def test_telemetry(spark):
    rows = [("GET", "/a", 200, x, datetime(2024, 1, 1, 0, m)) for x, m in ((0.004, 0), (0.2, 1), (0.2, 6), (9.0, 7))] + [("GET", "/a", 500, 0.3, datetime(2024, 1, 1, 0, 2))]
    df = spark.createDataFrame(rows, "method string, path string, status int, seconds double, ts timestamp_ntz")
    h = {r.le: r.cumulative for r in telemetry.latency_histogram(df, "path").collect()}
    assert (h["0.005"], h["0.25"], h["0.5"], h["5.0"], h["+Inf"]) == (1, 3, 4, 4, 5)
    assert sorted((r.requests, r.errors, r.ratio) for r in telemetry.error_ratio(df).collect()) == [(2, 0, 0.0), (3, 1, 1 / 3)]
    q = df.agg(F.array(*[F.count_if(F.col("seconds") <= b) for b in telemetry.BOUNDS], F.count("*")).alias("n"))
    assert q.select(telemetry.histogram_quantile(0.5, F.col("n"))).first()[0] == pytest.approx(0.1 + 0.15 * 1.5 / 2)
    assert q.select(telemetry.histogram_quantile(0.95, F.col("n"))).first()[0] == 5.0


def test_poll_commit_replay(three, spark):
    m = lifecycle.enqueue(three, "topic")
    none = spark.createDataFrame([], "topic string, partition int, committed long")
    first = lifecycle.poll(m, none, 2)
    done = lifecycle.committed(first, none)
    assert [r.offset for r in first.collect()] == [0, 1] and [r.committed for r in done.collect()] == [2]
    assert [r.offset for r in lifecycle.poll(m, done).collect()] == [2] and lifecycle.replay(m).count() == 3
    assert [r.committed for r in lifecycle.committed(first, done.withColumn("committed", F.lit(9).cast("long"))).collect()] == [9]


def test_rate_limit(spark):
    mb = quota.MEBIBYTE
    rows = [(1, "a", 0, 2 * mb, 1), (2, "a", 0, 1, 1), (3, "a", 10**9, mb, 1), (4, "a", 10**9, mb // 2, 1), (5, "b", 0, 200 * mb, None), (6, "c", 0, mb, 0)]
    df = spark.createDataFrame(rows, "request_id long, tenant_id string, at_ns long, bytes long, limit_mb int")
    got = {r.request_id: (r.admitted, r.retry_after_ms) for r in quota.admit(df).collect()}
    assert got == {1: (True, 0), 2: (False, 1), 3: (True, 0), 4: (False, 500), 5: (False, 2000), 6: (True, 0)}


def test_tenants(spark):
    t = tenants.Tenant("a", searchable=("service", "status_code"), pipelines={"p": [Stage("j", "json")]}, active="p")
    assert tenants.changed(t, searchable=["service"]).version == 2
    for bad in ({"searchable": ["host"]}, {"searchable": ["service", "service"]}, {"searchable": [" "]}, {"max_body": -1}, {"active": "q"}, {"pipelines": {"p": [Stage("x", "unknown")]}}):
        with pytest.raises(ValueError):
            tenants.changed(t, **bad)
    assert tenants.table(spark, [t]).first().retention_days == 7


def test_stored_search_reads_only_its_days(spark):
    events, summaries = catalogue.stored(spark, "/root/testdata/sf0.001")
    q = search.Query("tenant-1", 1_704_844_800_000_000_000, 1_704_931_199_999_999_999, labels={"env": "prod"})  # 10 January
    for df in (search.search(events, q), search.pruned_search(events, summaries, q)):
        assert [str(r.day) for r in df.select("day").distinct().collect()] == ["2024-01-10"]
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: [isnotnull(day" in plan and "2024-01-10" in plan
    for more in ({}, {"fields": {"host": "h4"}}, {"contains": '"level":"err'}, {"contains": "no such word"}, {"regex": "k4[0-9]"}, {"fields": {"none": ""}}, {"bucket": "2024-01-10/13"}):
        q = search.Query("tenant-1", 0, 2**61, labels={"env": "prod"}, **more)
        assert sorted(r.ingest_seq for r in search.pruned_search(events, summaries, q).collect()) == sorted(r.ingest_seq for r in search.search(events, q).collect())


def test_chunks_of_many_tokens_are_no_candidates_of_others(spark):
    rows = [(k, " ".join(f"w{i}x{k}" for i in range(400)), {"service": "a" if k < 20 else "b"}, {}) for k in range(40)]
    hours = [(k * 3_600_000_000_000, f"{body} error level" if k == 7 else body, labels, fields) for k, body, labels, fields in rows]
    df = events(spark, *hours)
    q = search.Query("t", 0, 2**61, contains='"error","level"')
    tokens = chunks.segment_tokens(df)
    summaries = chunks.segment_summaries(df, tokens)
    assert sorted(map(str, summaries.collect())) == sorted(map(str, chunks.segment_summaries(df).collect()))
    assert search.candidates(summaries, q).count() > 30  # the filters are full
    assert [tuple(r) for r in search.explain(summaries, q, tokens).collect()] == [(1, 1, 1, 1)]


def test_whole_tokens_only():
    assert chunks.whole_tokens("k42 error 500") == ["error"] and chunks.whole_tokens(" error ") == ["error"] and chunks.whole_tokens("error") == []


@pytest.mark.parametrize(
    "text, want",
    [
        ("", {}), ('{service="api", env=\'prod\',}', {"labels": {"service": "api", "env": "prod"}}), ('{a="b"} |= "x y"', {"labels": {"a": "b"}, "contains": "x y"}),
        ('{} |~ "e.r" ', {"regex": "e.r"}), ('|= "a" |~ "b"', {"regex": "b"}), ('{a = "x=y"}', {"labels": {"a": "x=y"}}),
    ],
)
def test_selector(text, want):
    assert selector.conditions(text) == {"labels": {}, "contains": "", "regex": "", **want}


def test_selector_requests():
    q = selector.request({"query": "{a=b}", "start": "1970-01-01T00:00:01.5Z", "end": "2000000000", "limit": "x"}, True, "t")
    assert (q.tenant_id, q.start_ns, q.end_ns, q.limit, q.labels) == ("t", 1_500_000_000, 2_000_000_000, 100, {"a": "b"})
    q = selector.request({"time": "1970-01-01T01:00:00+01:00", "tenant": "u", "limit": "7"}, False)
    assert (q.tenant_id, q.start_ns, q.end_ns, q.limit) == ("u", -1, 1, 7)
    assert selector.request({}, False, now_ns=5).end_ns == 6
    for bad in ({"query": "{a"}, {"query": "{a}"}, {"time": "soon"}):
        with pytest.raises(ValueError):
            selector.request(bad, False)
    with pytest.raises(ValueError):
        selector.request({"start": "1"}, True)


def test_chunks_against_a_loop(spark):
    events = catalogue.tables.driver_events(spark, "/root/testdata/sf0.001")
    got = {r.ingest_seq: (r.stream_key, r.chunk) for r in chunks.build_chunks(events, 20, 2000, 6 * 3600 * 10**9).collect()}
    rows = events.select("ingest_seq", "ts_ns", catalogue.text.stream_key("tenant_id", "stream_labels").alias("key"), chunks.estimated_bytes().alias("size")).orderBy("ingest_seq").collect()
    open_, want = {}, {}
    for r in rows:
        number, n, size, first = open_.get(r.key, (0, 0, 0, 0))
        first = r.ts_ns if n == 0 else first
        want[r.ingest_seq] = (r.key, number)
        n, size = n + 1, size + r.size
        open_[r.key] = (number + 1, 0, 0, 0) if n == 20 or size >= 2000 or r.ts_ns - first >= 6 * 3600 * 10**9 else (number, n, size, first)
    assert got == want
