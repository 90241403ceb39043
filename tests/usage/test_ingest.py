import json
from datetime import datetime

from pyspark.sql import functions as F

from meterloom.functions.timez import resolve_range
from meterloom.operators import ingest, quality
from meterloom.sources import files, lines, store


def lines_of(spark, **logs):
    rows = [(path, n, text if isinstance(text, str) else json.dumps(text)) for path, found in logs.items() for n, text in enumerate(found, 1)]
    return spark.createDataFrame(rows, lines.LINES_SCHEMA)


def generic(spark, *rows, provider="claude"):
    parsed, issues = ingest.parse_rows(lines_of(spark, f=list(rows)))
    records, more = ingest.ingest_generic(parsed, provider)
    return records.orderBy("seq").collect(), issues.unionByName(more).collect()


def counter(spark, *rows):
    records, issues = ingest.ingest_counter_log(lines_of(spark, **{"log": list(rows)}))
    return records.orderBy("seq").collect(), issues.collect()


def test_generic_tokens(spark):
    got, issues = generic(
        spark,
        {"message": {"model": "m", "usage": {"input_tokens": 1000, "output_tokens": 300, "cache_creation_input_tokens": 200, "cache_read_input_tokens": 50}}},
        {"message": {"usage": {"input_tokens": 1, "cache_creation_input_tokens": 700, "cache_creation": {"ephemeral_5m_input_tokens": 200, "ephemeral_1h_input_tokens": 500}}}},
        {"tokens": {"input": 0, "output": 0}}, {"model": "z"}, "not json {", "[1]", {"usage": {"input": "12", "inputTokens": 5, "output": 7}},
        {"provider": "codex", "started_at": "2026-05-01T00:00:00Z", "input_tokens": 3},
    )
    assert (got[0].tokens.input, got[0].tokens.cache_write_5m, got[0].tokens.cache_read, got[0].tokens.output) == (1000, 200, 50, 300)
    assert (got[1].tokens.cache_write_5m, got[1].tokens.cache_write_1h, got[1].model) == (200, 500, "m")
    assert (got[2].tokens.input, got[2].tokens.output, got[2].model) == (None, 7, "z") and len(got) == 4
    assert got[3].started_at == datetime(2026, 5, 1) and got[3].session_id == "f"
    assert sorted((i.code, i.line_no) for i in issues) == [("malformed_jsonl", 5), ("provider_mismatch", 8), ("record_not_object", 6)]


def test_imported_costs_and_sessions(spark):
    got, _ = generic(
        spark, {"type": "session", "id": "h1", "timestamp": "2026-05-01T00:00:00Z"}, {"message": {"usage": {"input": 5, "cacheWrite": 300, "cost": {"total": 0.000252}}}}, {"sessionId": "own", "costUsd": 2},
        provider="pi",
    )
    assert (float(got[0].imported_cost.amount), got[0].imported_cost.currency, got[0].tokens.cache_write_5m, got[0].session_id) == (0.000252, "USD", 300, "h1")
    assert (got[1].session_id, float(got[1].imported_cost.amount)) == ("own", 2)


def token_count(**info):
    return {"type": "event_msg", "payload": {"type": "token_count", "info": info or None}}


def usage(i, c, o):
    return {"input_tokens": i, "cached_input_tokens": c, "output_tokens": o}


def test_counter_logs(spark):
    got, _ = counter(spark, token_count(total_token_usage=usage(100, 40, 10)), token_count(total_token_usage=usage(150, 60, 15)))
    assert [sum(getattr(r.tokens, k) for r in got) for k in ("input", "cached_input", "output")] == [90, 60, 15]
    got, issues = counter(spark, {"type": "turn_context", "payload": {"model": "m"}}, token_count(last_token_usage=usage(42, 7, 9)), token_count(), token_count(rate=1), '\\{"type":"session_meta","payload":{"id":"s9"}}', {"type": "response_item", "payload": {"text": "x"}}, token_count(last_token_usage=usage(1, 0, 0)))
    assert [(r.tokens.input, r.tokens.cached_input, r.model, r.session_id) for r in got] == [(35, 7, "m", "log"), (1, 0, "m", "s9")]
    assert [(i.code, i.line_no) for i in issues] == [("missing_tokens", 4)]
    late, _ = counter(spark, token_count(last_token_usage=usage(5, 0, 1)), {"type": "turn_context", "payload": {"model": "only"}})
    assert late[0].model == "only" and late[0].own_model is None
    two, _ = counter(spark, token_count(last_token_usage=usage(5, 0, 1)), {"type": "turn_context", "payload": {"model": "a"}}, {"type": "turn_context", "payload": {"model": "b"}})
    assert two[0].model is None
    fall, _ = counter(spark, token_count(total_token_usage=usage(100, 0, 10)), token_count(total_token_usage=usage(40, 0, 5)), token_count(total_token_usage=usage(90, 0, 9)))
    assert [(r.tokens.input, r.tokens.output) for r in fall] == [(100, 10), (50, 4)]


def turn(at, **models):
    return {"timestamp": at, "params": {"update": {"sessionUpdate": "turn_completed", "usage": {"modelUsage": models}}}}


def test_turn_logs(spark):
    log = {
        "r/cwd/parent/updates.jsonl": [turn(1788677379, m={"inputTokens": 36343, "outputTokens": 63, "totalTokens": 36406, "costUsdTicks": 124208800}), turn(1788677400, m={"inputTokens": 36426, "outputTokens": 66, "totalTokens": 36492, "cachedReadTokens": 36224, "costUsdTicks": 0})],
        "r/cwd/child/updates.jsonl": [turn(1788677400, m={"inputTokens": 100, "outputTokens": 10, "totalTokens": 150, "cachedReadTokens": 50})],
    }
    records, issues = ingest.ingest_turn_log(lines_of(spark, **log))
    got = records.where("session_id = 'parent'").orderBy("line_no").collect()
    assert [(r.tokens.input, r.tokens.cache_read, r.tokens.output) for r in got] == [(36343, None, 63), (202, 36224, 66)]
    assert float(got[0].imported_cost.amount) == 0.01242088 and float(got[1].imported_cost.amount) == 0 and got[0].started_at == datetime(2026, 9, 6, 6, 49, 39)
    assert [(i.code, i.n) for i in issues.collect()] == [("token_convention_changed", 1)]
    assert records.where("session_id = 'child'").first().tokens.input == 100
    meta = spark.createDataFrame([("r/cwd/parent/subagents/x/meta.json", '{"child_session_id":"child"}'), ("r/cwd/parent/subagents/gone/meta.json", "{}")], "source_path string, value string")
    assert {r.session_id for r in ingest.child_sessions(meta).collect()} == {"child", "gone"}
    assert ingest.drop_child_sessions(records, ingest.child_sessions(meta)).count() == 2


def test_event_table(spark):
    rows = [("1", "s", "m", "2026-05-01T00:00:00Z", None, 10, 5, 3, 0), ("2", "s", None, "2026-05-01T00:00:01Z", None, 10, 0, 0, 0), ("3", "s", "m", "2026-05-01T00:00:02Z", None, 0, 0, 0, 0), ("4", "s", "m", "soon", None, 1, 0, 0, 0)]
    table = spark.createDataFrame(rows, "event_id string, session_id string, model string, started_at string, completed_at string, input_tokens bigint, output_tokens bigint, cache_read_tokens bigint, cache_write_tokens bigint")
    records, issues = ingest.scan_session_events(table, "x.db")
    got = records.orderBy("seq").collect()
    assert [(r.pricing_unavailable, r.model, r.tokens.input) for r in got] == [(True, "m", 10), (False, None, 10)]
    assert {i.code: i.n for i in issues.collect()} == {"no_token_usage": 1, "invalid_timestamp": 1, "ambiguous_cache_tokens": 1}
    none, bad = ingest.scan_session_events(table.drop("model"), "x.db")
    assert none.count() == 0 and bad.first().code == "unsupported_schema"


def test_files_lines_and_documents(spark, tmp_path):
    root = tmp_path / "logs" / "2026" / "05" / "01"
    root.mkdir(parents=True)
    (root / "a.jsonl").write_bytes(b'{"x":1}\r\n\n{"x":2}')
    (root / "__hidden.jsonl").write_bytes(b'{"x":3}\n{"x":4}\n')
    (root / "empty.jsonl").write_bytes(b"")
    (root / "b.meta.json").write_bytes(b"{}")
    (root / "doc.json").write_bytes(b'{"records":[{"tokens":{"input":1}},{"tokens":{"input":2}}]}')
    (root / "broken.json").write_bytes(b"{")
    found = files.list_files(spark, f"file://{tmp_path}/logs")
    assert sorted(r.name for r in found.collect()) == ["__hidden.jsonl", "a.jsonl", "broken.json", "doc.json", "empty.jsonl"]
    read = lines.scan_lines(spark, found.where(F.col("name").endswith(".jsonl")))
    got = {(r.source_path.rsplit("/", 1)[1], r.line_no): r.value for r in read.collect()}
    assert got == {("a.jsonl", 1): '{"x":1}', ("a.jsonl", 2): "", ("a.jsonl", 3): '{"x":2}', ("__hidden.jsonl", 1): '{"x":3}', ("__hidden.jsonl", 2): '{"x":4}'}
    rows, bad = lines.scan_json_docs(spark, found.where("name LIKE '%.json'"))
    records, _ = ingest.ingest_generic(ingest.rows_of(rows), "codex")
    assert sorted(r.tokens.input for r in records.collect()) == [1, 2] and bad.count() == 1
    assert str(found.select(files.path_date(F.col("path")).alias("d")).first().d) == "2026-05-01"
    now = datetime.fromisoformat("2026-03-01T00:00:00+00:00")
    assert {r.skip_reason for r in files.prune_files(found, resolve_range("thisWeek", now, "UTC"), "codex").collect()} == {"after_range"}
    later = resolve_range("today", datetime.fromisoformat("2026-07-01T00:00:00+00:00"), "UTC")
    assert {r.skip_reason for r in files.prune_files(found, later, "claude").collect()} <= {"before_range", "not_modified_since"}
    candidates = spark.createDataFrame([("claude", f"file:{tmp_path}/none", 0, "jsonl$"), ("claude", f"file:{tmp_path}/logs", 1, "jsonl$")], "provider string, root string, priority int, name_filter string")
    seen = files.detect_sources(found, candidates).first()
    assert seen.source_path.endswith("/logs") and seen.files == 3
    issues = ingest.source_issues(found.where("name LIKE '%.jsonl'"), read, spark.createDataFrame([], "source_path string"), spark.createDataFrame([("/gone", False), ("/bare", True)], "root string, exists boolean"))
    assert sorted(r.code for r in issues.collect()) == ["empty_directory", "empty_file", "missing_path", "no_records", "no_records"]


def stored(spark, path):
    return sorted((r.tokens.input, r.model) for r in store.read_records(spark, path).collect())


def test_store_replaces_files_and_days(spark, tmp_path):
    path = f"file://{tmp_path}/t"

    def records(*rows):
        made = [("codex", "m", "f", datetime.fromisoformat(t), n, i) for i, (t, n) in enumerate(rows)]
        df = spark.createDataFrame(made, "provider string, model string, source_path string, started_at timestamp, n bigint, seq bigint")
        from meterloom.schema import as_records, tokens_struct

        return store.pseudonymise(as_records(df.withColumn("tokens", tokens_struct(input=F.col("n")))), "root")

    first = records(("2026-05-01T00:00:00", 100), ("2026-05-02T00:00:00", 7))
    for _ in range(2):
        store.write_records(first, path, first.select("file_id"))
    assert stored(spark, path) == [(7, "m"), (100, "m")]
    second = records(("2026-05-01T00:00:00", 40), ("2026-05-03T00:00:00", 50))
    store.write_records(second, path, second.select("file_id"))
    assert stored(spark, path) == [(40, "m"), (50, "m")]
    grown = records(("2026-05-01T00:00:00", 40), ("2026-05-03T00:00:00", 50), ("2026-05-04T00:00:00", 60))
    for _ in range(2):
        store.append_records(grown, path, grown.select("file_id").distinct().withColumn("records", F.lit(2)))
    assert stored(spark, path) == [(40, "m"), (50, "m"), (60, "m")]
    day = resolve_range("custom", datetime.fromisoformat("2026-05-03T00:00:00+00:00"), "Asia/Taipei", "2026-05-03", "2026-05-03")
    assert [r.tokens.input for r in store.read_range(spark, path, day).collect()] == [50]
    assert all(r.source_path is None and len(r.file_id) == 24 for r in store.read_records(spark, path).collect())
    listed = grown.select("provider", "root_id", "file_id").distinct().withColumns({"path": F.lit("p"), "fingerprint": F.lit("1:1")})
    entry = store.build_manifest(grown, listed, "v1")
    assert (entry.first().records, entry.first().models) == (3, []) and store.manifest_current(entry, "v2").count() == 0
    assert store.removed_files(entry, spark.createDataFrame([], "path string")).count() == 1


def test_quality(spark):
    texts = spark.createDataFrame([(1, "see /home/me/x"), (2, "see /srv/me/x"), (3, "Authorization: Basic abcdefghijklmnopqrst")], "id int, text string")
    found = quality.scan_patterns(texts, "text", ["id"])
    assert {(r.id, r.reason) for r in found.collect()} == {(1, "personal folder"), (3, "authorization header")}
    assert quality.scan_patterns(texts, "text", ["id"], allow=found.where("id = 3")).count() == 1
    paths = spark.createDataFrame([("a", "C:\\x"), ("b", "/x"), ("c", " ")], "provider string, path string")
    assert [r.provider for r in quality.check_paths(paths, "linux").collect()] == ["a"] and [r.provider for r in quality.check_paths(paths, "win32").collect()] == ["b"]
    actions = spark.createDataFrame([("claude", "/r", "p1", "skip", "after_range"), ("claude", "/r", "p2", "reuse", None), ("pi", "/q", "p3", "ingest", None)], "provider string, source_path string, path string, action string, skip_reason string")
    manifest = spark.createDataFrame([("p2", 5), ("p3", 0)], "path string, records bigint")
    cover = quality.coverage(actions, manifest)
    assert {(r.provider, r.files, r.records, r.complete) for r in cover.collect()} == {("claude", 2, 5, False), ("pi", 1, 0, True)}
    issues = spark.createDataFrame([], "severity string, code string, provider string")
    other = spark.createDataFrame([("pi", "/better", 3)], "provider string, source_path string, files bigint")
    assert quality.stale_sources(cover, issues, other).first().code == "source_alternative_detected"
    doubt = spark.createDataFrame([("warning", "file_transient", "pi")], "severity string, code string, provider string")
    assert quality.stale_sources(cover, doubt, other).count() == 0
    assert quality.load_status(actions).first().status == "cold" and quality.load_status(actions.where("action <> 'ingest'")).first().status == "partial"


def test_counts_of_zero_are_no_missing_tokens(spark):
    """A billed row that names counts of 0 has counts; one that names none has not."""
    billed = {"timestamp": "2024-01-01T00:00:00Z", "costUsd": 1}
    texts = [json.dumps(billed | {"usage": {"input": 0}}), json.dumps(billed), json.dumps(billed | {"usage": {"input": 0, "output": 0, "cache_read": 0}})]
    lines_ = spark.createDataFrame([("f.jsonl", i, t) for i, t in enumerate(texts)], "source_path string, line_no bigint, value string")
    rows, _ = ingest.parse_rows(lines_)
    records, issues = ingest.ingest_generic(rows, "claude")
    assert records.count() == 3 and [(r.code, r.line_no) for r in issues.collect()] == [("missing_tokens", 1)]


def test_lines_that_say_nothing_are_not_parsed(spark, monkeypatch):
    """Heartbeats and lines without a telling name go before any parsing; the records are those of all lines, and issues are found in all of them."""
    usage = '{"input_tokens":%d,"output_tokens":3}'
    event = '{"type":"event_msg","payload":{"type":"token_count","info":%s}}'
    rows = [
        event % '{"total_token_usage":%s}' % (usage % 5), event % "null", '{"type":"other","text":"long"}', '{"type":"event_msg"', event % '{"x":1}', event % '{"total_token_usage":%s}' % (usage % 9),
        '{"type":"turn_context","payload":{"mod\\u0065l":"m"}}', '{"\\u0075sage":%s}' % (usage % 7), '{ "usage" : %s }' % (usage % 8), '{"type":"response_item","payload":{"text":"x"}}', '{"type":"response_item", "usage":%s}' % (usage % 4), "\\" + event % '{"last_token_usage":%s}' % (usage % 6),
    ]
    df = spark.createDataFrame([("log", i, x) for i, x in enumerate(rows, 1)], "source_path string, line_no bigint, value string")
    assert sorted(r.line_no for r in ingest.telling(df).collect()) == [1, 5, 6, 7, 8, 9, 11, 12]
    found = lambda records: sorted((r.line_no, r.seq, r.own_model, r.model, r.session_id, r.tokens.input, r.tokens.output) for r in records.collect())
    parsed = []
    real = ingest.parse_rows
    monkeypatch.setattr(ingest, "parse_rows", lambda lines, **k: (parsed.append(lines), real(lines, **k))[1])
    records, issues = ingest.ingest_counter_log(df)
    assert min(x.count() for x in parsed) == 8
    got = found(records)
    assert [x[0] for x in got] == [1, 6, 8, 9, 11, 12] and {x[3] for x in got} == {"m"}
    assert sorted((r.code, r.line_no) for r in issues.collect()) == [("malformed_jsonl", 4), ("missing_tokens", 5)]
    monkeypatch.setattr(ingest, "telling", lambda lines: lines)
    assert found(ingest.ingest_counter_log(df)[0]) == got
