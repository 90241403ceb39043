import json
from datetime import datetime, timezone

from pyspark.sql import functions as F

from meterloom.functions.timez import resolve_range
from meterloom.operators import ingest, quality
from meterloom.plans.refresh import Root, read_manifest, refresh
from meterloom.sources import files, lines
from meterloom.streaming import deltas

SPAN = resolve_range("custom", datetime(2026, 1, 1, tzinfo=timezone.utc), "UTC", "2026-01-01", "2026-12-31")


def log(path, *rows):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("".join(json.dumps(r) + "\n" for r in rows))


def row(n, day="2026-05-01"):
    return {"model": "m", "startedAt": f"{day}T00:00:00Z", "tokens": {"input": n}}


def inputs(done):
    return sorted(r.tokens.input for r in done.records.collect())


def test_refreshes(spark, tmp_path):
    claude, codex, path = tmp_path / "claude", tmp_path / "codex", f"file://{tmp_path}/store"
    log(claude / "a.jsonl", row(100), row(7, "2026-05-02"))
    log(claude / "b.jsonl", row(5))
    log(claude / "__c.jsonl", row(3))
    (claude / "empty.jsonl").write_text("")
    (claude / "doc.json").write_text(json.dumps({"records": [row(1000), row(2000)]}))
    usage = lambda n: {"input_tokens": n, "cached_input_tokens": 0, "output_tokens": 1}
    total = lambda n: {"timestamp": "2026-05-01T00:00:00Z", "type": "event_msg", "payload": {"type": "token_count", "info": {"total_token_usage": usage(n)}}}
    log(codex / "2026/05/01/x.jsonl", {"type": "turn_context", "payload": {"model": "g"}}, total(100), total(250))
    roots = [Root("claude", f"file://{claude}"), Root("codex", f"file://{codex}"), Root("pi", f"file://{tmp_path}/none")]
    done = refresh(spark, roots, path, SPAN)
    assert inputs(done) == [3, 5, 7, 100, 100, 150, 1000, 2000]
    assert {r.source_path: r.code for r in done.issues.collect()} == {f"file:{claude}/empty.jsonl": "empty_file", f"file:{tmp_path}/none": "missing_path"}
    assert {(r.provider, r.files, r.records, r.complete) for r in done.coverage.collect()} == {("claude", 5, 6, True), ("codex", 1, 2, True)}
    # Nothing has changed.
    done = refresh(spark, roots, path, SPAN)
    assert inputs(done) == [3, 5, 7, 100, 100, 150, 1000, 2000] and done.status.first().status == "warm"
    assert {r.action for r in done.actions.collect()} == {"reuse"}
    # One file changes and leaves a day, one goes, one grows.
    log(claude / "a.jsonl", row(40), row(50))
    (claude / "b.jsonl").unlink()
    log(codex / "2026/05/01/x.jsonl", {"type": "turn_context", "payload": {"model": "g"}}, total(100), total(250), total(260))
    done = refresh(spark, roots, path, SPAN)
    assert inputs(done) == [3, 10, 40, 50, 100, 150, 1000, 2000]
    assert read_manifest(spark, f"{path}/manifest").where("path LIKE '%b.jsonl'").count() == 0
    # Another parser version reads all anew; files that are still written to wait.
    done = refresh(spark, roots, path, SPAN, version="2")
    assert {r.action for r in done.actions.collect()} == {"ingest"} and inputs(done) == [3, 10, 40, 50, 100, 150, 1000, 2000]
    log(claude / "late.jsonl", row(9))
    done = refresh(spark, roots, path, SPAN, settle=(datetime.now(timezone.utc), 3600), version="2")
    assert 9 not in inputs(done)
    # Without any root's rows, a range that holds none.
    other = resolve_range("custom", datetime(2020, 1, 1, tzinfo=timezone.utc), "UTC", "2020-01-01", "2020-01-02")
    assert refresh(spark, roots, path, other, version="2").records.count() == 0


def test_turn_roots(spark, tmp_path):
    """Child sessions go, an event table's folder is read alone, and nothing is left behind."""
    sessions, table, path = tmp_path / "sessions", tmp_path / "table", f"file://{tmp_path}/store"
    turn = lambda n: {"timestamp": 1777600000, "params": {"update": {"sessionUpdate": "turn_completed", "usage": {"modelUsage": {"grok-core": {"inputTokens": n, "outputTokens": 1, "totalTokens": n + 1}}}}}}
    for name, n in (("p", 10), ("named", 20), ("bare", 30), ("other", 40)):
        log(sessions / f"cwd/{name}/updates.jsonl", turn(n))
    (sessions / "cwd/p/subagents/x").mkdir(parents=True)
    (sessions / "cwd/p/subagents/x/meta.json").write_text(json.dumps({"child_session_id": "named"}, indent=2))
    log(sessions / "cwd/p/subagents/bare/notes.txt", {})
    log(table / "updates.jsonl", turn(50))
    events = [("e1", "s", "grok-core", "2026-05-01T00:00:00Z", None, 60, 1, 0, 0), ("e2", "s", "grok-core", "soon", None, 70, 1, 0, 0)]
    columns = ", ".join(f"{c} {'bigint' if c.endswith('tokens') else 'string'}" for c in ingest.EVENT_COLUMNS)
    spark.createDataFrame(events, columns).coalesce(1).write.parquet(f"file://{table}/session.db")
    roots = [Root("grok", f"file://{sessions}"), Root("grok", f"file://{table}", by_tasks=True)]
    for _ in range(2):
        done = refresh(spark, roots, path, SPAN)
        assert inputs(done) == [10, 40, 60]
    assert done.status.first().status == "warm"
    assert {p.name for p in (tmp_path / "store").iterdir()} == {"records", "manifest", "actions", "issues"}
    # A database file of that name is no text: its rows are not read, and it is tried again.
    for f in (table / "session.db").iterdir():
        f.unlink()
    (table / "session.db").rmdir()
    (table / "session.db").write_bytes(b"SQLite format 3\0")
    done = refresh(spark, roots, path, SPAN)
    assert inputs(done) == [10, 40] and [r.code for r in done.issues.collect()] == ["file_unreadable"]


def test_no_roots(spark, tmp_path):
    done = refresh(spark, [], f"file://{tmp_path}/store", SPAN)
    assert done.records.count() == done.actions.count() == done.issues.count() == 0 and done.status.count() == 1


def test_unreadable_files_keep_their_rows(spark, tmp_path):
    import gzip

    root, path = tmp_path / "r", f"file://{tmp_path}/store"
    root.mkdir()
    (root / "a.jsonl.gz").write_bytes(gzip.compress((json.dumps(row(8)) + "\n").encode()))
    roots = [Root("claude", f"file://{root}", r"\.jsonl\.gz$")]
    assert inputs(refresh(spark, roots, path, SPAN)) == [8]
    (root / "a.jsonl.gz").write_bytes(b"no archive at all")
    for _ in range(2):  # it is tried again each time
        done = refresh(spark, roots, path, SPAN)
        assert inputs(done) == [8] and [r.code for r in done.issues.collect()] == ["file_unreadable"] and done.actions.first().action == "ingest"


def test_line_numbers_over_splits(spark, tmp_path):
    """Numbers go on over the splits of a file."""
    text = [f"line {i} " + "x" * (i % 50) for i in range(20000)]
    (tmp_path / "big.jsonl").write_text("\n".join(text))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        read = lines.scan_lines(spark, files.list_files(spark, f"file://{tmp_path}"))
        assert read.rdd.getNumPartitions() > 2
        got = {r.line_no: r.value for r in read.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == dict(enumerate(text, 1))


def test_lookups_of_odd_values(spark):
    """Values of the wrong kind, names that differ by case, and parents that are no objects."""
    rows = [
        {"usage": "none", "input": 4, "costUSD": 2, "message": [1]}, {"tokens": {"input": True, "output": 3}}, {"usage": {"input": None, "inputTokens": 6}, "model": 5, "message": {"model": "inner"}},
        {"billing": {"costUSD": 1.5}, "costUsd": "9"}, {"tokens": {}, "input": 9},
    ]
    df = spark.createDataFrame([("f", i, json.dumps(r)) for i, r in enumerate(rows)], lines.LINES_SCHEMA)
    parsed, issues = ingest.parse_rows(df)
    got = {r.line_no: r for r in ingest.ingest_generic(parsed, "claude")[0].collect()}
    assert issues.count() == 0
    assert (got[0].tokens.input, float(got[0].imported_cost.amount)) == (4, 2)
    assert (got[1].tokens.input, got[1].tokens.output) == (None, 3)
    assert (got[2].tokens.input, got[2].model) == (6, "inner")
    assert float(got[3].imported_cost.amount) == 1.5 and 4 not in got


def test_numbers_within_slots(spark):
    rows = [("s", datetime(2026, 5, 1, h), f"{i:02d}") for h in (3, 1, 2) for i in range(5)] + [("t", datetime(2026, 5, 1), "0")]
    df = spark.createDataFrame(rows, "k string, at timestamp, e string")
    got = {(r.k, r.at.hour, r.e): r.seq for r in ingest.numbered_in_slots(df, "k", F.date_trunc("HOUR", "at"), ["at", "e"]).collect()}
    assert got == {("s", h, f"{i:02d}"): (h - 1) * 5 + i for h in (1, 2, 3) for i in range(5)} | {("t", 0, "0"): 0}
    assert ingest.numbered_in_slots(df.limit(0), "k", F.col("at"), ["e"]).count() == 0


def test_issues_and_intervals(spark):
    a = spark.createDataFrame([("error", "x")], "severity string, code string")
    b = spark.createDataFrame([("y", 3)], "code string, line_no bigint")
    assert {(r.severity, r.code, r.line_no) for r in quality.all_issues(a, b, a.limit(0)).collect()} == {("error", "x", None), (None, "y", 3)}
    assert [deltas.trigger_seconds(n) for n in (1, 60, 10**9)] == [30, 60, 86400]
