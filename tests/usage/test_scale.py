"""What one huge file, one huge day or one hidden file needs."""

import gzip
import json
import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from meterloom.operators import ingest
from meterloom.plans import ingest_queries
from meterloom.sources import files, lines, store

SCHEMA = "source_path string, line_no bigint, _model string, _context string, _session string, _totals struct<input: bigint, cached_input: bigint, output: bigint>"


def rows(spark, n=600):
    rng = random.Random(5)
    pick = lambda values, share: rng.choice(values) if rng.random() < share else None
    made = []
    for f in ("a", "b", "one"):
        for i in range(1, n if f != "one" else 3):
            totals = (rng.randrange(99), None, i) if rng.random() < 0.3 else None
            made.append((f, i, pick(["m"] if f == "a" else ["m", "n"], 0.02), pick(["s", "t"], 0.05), pick(["own"], 0.01), totals))
    return spark.createDataFrame(made, SCHEMA)


def test_slots_equal_windows_over_files(spark):
    df = rows(spark)
    file, line = Window.partitionBy("source_path"), Window.partitionBy("source_path").orderBy("line_no")
    upto, before = line.rowsBetween(Window.unboundedPreceding, 0), line.rowsBetween(Window.unboundedPreceding, -1)
    only = F.when(F.min("_model").over(file) == F.max("_model").over(file), F.min("_model").over(file))
    own = F.last("_model", ignorenulls=True).over(upto)
    want = df.select("source_path", "line_no", own.alias("own_model"), F.coalesce(own, only).alias("model"), F.coalesce("_session", F.last("_context", ignorenulls=True).over(upto), "source_path").alias("session_id"), F.last("_totals", ignorenulls=True).over(before).alias("_before"))
    for slot in (7, 100, 10**6):
        got = ingest.fill_from_file(df, ingest.TOTALS_BEFORE, slot_lines=slot).select(want.columns)
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
        kept = df.where("line_no % 3 = 0")
        numbered = {(r.source_path, r.line_no): r.seq for r in ingest.numbered(kept, slot_lines=slot).collect()}
        assert numbered == {(r.source_path, r.line_no): r.line_no // 3 - 1 for r in kept.collect()}


def test_one_file_is_the_work_of_many_tasks(spark):
    log = spark.range(1, 20001).select(F.lit("f").alias("source_path"), F.col("id").alias("line_no"), F.lit(None).cast("string").alias("_model"), F.lit(None).cast("string").alias("_context"), F.lit(None).cast("string").alias("_session"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sizes = ingest.fill_from_file(log, slot_lines=500).groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(sizes) == 8 and max(r["count"] for r in sizes) < 8000


def stored_rows(spark, n, day="2026-05-01", file="f"):
    kinds = {"provider": F.lit("claude"), "utc_date": F.to_date(F.lit(day)), "file_id": F.concat(F.lit(file), (F.col("id") % 50).cast("string")), "seq": F.col("id"), "session_id": F.sha2(F.col("id").cast("string"), 512)}
    return spark.range(n).select(*[kinds.get(c, F.lit(None)).cast(t).alias(c) for c, t in store.STORED_TYPES.items()])


def test_a_large_day_is_written_by_many_tasks(spark, tmp_path):
    path = f"file://{tmp_path}/records"
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "1m")
    try:
        every = stored_rows(spark, 90_000).unionByName(stored_rows(spark, 300, "2026-05-02")).repartition(8)
        store.write_records(every, path, every.select("file_id"))
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    count = lambda day: len(list((tmp_path / f"records/provider=claude/utc_date={day}").glob("*.parquet")))
    assert count("2026-05-01") > 4 and count("2026-05-02") == 1
    assert store.read_records(spark, path).count() == 90_300


def test_writers_that_end_early(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/records"
    first = stored_rows(spark, 100).unionByName(stored_rows(spark, 10, "2026-05-03", "gone"))
    store.write_records(first, path, first.select("file_id"))
    second = stored_rows(spark, 40, "2026-05-02")
    touched = first.select("file_id")
    # Before the staged rows are whole: nothing has changed, and the next writer clears them away.
    with monkeypatch.context() as m:
        m.setattr(store, "_moved", lambda *_: 1 / 0)
        m.setattr(store, "_MARK", "_PART")
        try:
            store.write_records(second, path, touched)
        except ZeroDivisionError:
            pass
    store.recover(spark, path)
    assert store.read_records(spark, path).count() == 110 and not list(tmp_path.glob("*.staging-*"))
    # After it: the next one moves them.
    with monkeypatch.context() as m:
        m.setattr(store, "_moved", lambda *_: 1 / 0)
        try:
            store.write_records(second, path, touched)
        except ZeroDivisionError:
            pass
    assert store.read_records(spark, path).count() == 110
    store.recover(spark, path)
    assert [(str(r.utc_date), r["count"]) for r in store.read_records(spark, path).groupBy("utc_date").count().collect()] == [("2026-05-02", 40)]
    assert not list(tmp_path.glob("*.staging-*"))


def test_hidden_files_by_parts(spark, tmp_path):
    text = [f"line {i} " + "é" * (i % 70) for i in range(5000)]
    (tmp_path / "_big.jsonl").write_text("\n".join(text) + "\n")
    (tmp_path / ".no_end.jsonl").write_text("a\n\nb")
    (tmp_path / "__packed.jsonl.gz").write_bytes(gzip.compress(b"x\ny\n"))
    (tmp_path / "_broken.jsonl.gz").write_bytes(b"no archive")
    found = files.list_files(spark, f"file://{tmp_path}", "")
    for size in (64, 1000, 10**9):
        got = {}
        for r in lines.hidden_lines(found, size).collect():
            got.setdefault(r.source_path.rsplit("/", 1)[1], {})[r.line_no] = r.value
        assert got == {"_big.jsonl": dict(enumerate(text, 1)), ".no_end.jsonl": {1: "a", 2: "", 3: "b"}, "__packed.jsonl.gz": {1: "x", 2: "y"}}
    assert lines._parts(found, 1000).count() > 100


def test_listing_by_tasks(spark, tmp_path):
    for name in ("a.jsonl", "x/b.jsonl", "x/y/_c.jsonl", "x/y/.d/e f%20.jsonl", "x/n.txt", "é/g.jsonl"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(name)
    for root, rule in ((f"file://{tmp_path}", files.NAME_RULES["claude"]), (f"file://{tmp_path}/", ""), (f"file://{tmp_path}/none", "")):
        one, other = (sorted(map(tuple, f(spark, root, rule).collect())) for f in (files.list_files, files.list_tree))
        assert one == other and len(one) == {files.NAME_RULES["claude"]: 5, "": 6 if "none" not in root else 0}[rule]


def test_hidden_documents(spark, tmp_path):
    (tmp_path / "_x.json").write_text(json.dumps({"records": [{"model": "m", "tokens": {"input": 3}}]}, indent=1))
    (tmp_path / ".y.json").write_text("no json")
    (tmp_path / "z.json").write_text(json.dumps([{"model": "m", "tokens": {"input": 4}}]))
    found, broken = lines.scan_json_docs(spark, files.list_files(spark, f"file://{tmp_path}", ""))
    records, _ = ingest.ingest_generic(ingest.rows_of(found), "claude")
    assert sorted(r.tokens.input for r in records.collect()) == [3, 4]
    assert [r.source_path.rsplit("/", 1)[1] for r in broken.collect()] == [".y.json"]


def test_no_nested_loops(spark):
    listed = spark.createDataFrame([("/r/a/x.jsonl", "x.jsonl"), ("/r/ab/y.jsonl", "y.jsonl")], "path string, name string")
    roots = spark.createDataFrame([("claude", "/r/a/", 0, "jsonl$"), ("claude", "/r", 1, "jsonl$"), ("pi", "/r/b", 0, "jsonl$")], "provider string, root string, priority int, name_filter string")
    found = files.detect_sources(listed, roots)
    assert [tuple(r) for r in found.collect()] == [("claude", "/r/a/", 1)]
    there = spark.createDataFrame([("/r/a", True), ("/r/b", True), ("/q", False)], "root string, exists boolean")
    issues = ingest.source_issues(listed, listed.select(F.col("path").alias("source_path"), F.lit("x").alias("value")), listed.select(F.col("path").alias("source_path")), there)
    assert sorted((r.source_path, r.code) for r in issues.collect()) == [("/q", "missing_path"), ("/r/b", "empty_directory")]
    for df in (found, issues):
        assert "NestedLoop" not in df._jdf.queryExecution().executedPlan().toString()


def test_named_files_are_written_by_tasks(spark, tmp_path, monkeypatch):
    """The driver's calls don't grow with the files, and files hold their lines in order, packed or not."""
    from meterloom.plans import source_queries

    calls, asked = [], store.file_system
    monkeypatch.setattr(store, "file_system", lambda *a: calls.append(a) or asked(*a))
    n = F.col("id")
    rows = spark.range(300).select(F.concat(F.lit("d/f "), (n % 60).cast("string"), F.lit(".txt")).alias("file"), n.alias("n"), F.when(n % 7 != 0, n.cast("string")).alias("value"))
    source_queries.write_named(rows, f"file://{tmp_path}/plain")
    source_queries.write_named(rows.where("id % 60 = 1"), f"file://{tmp_path}/packed", "gzip")
    assert len(calls) < 10
    assert (tmp_path / "plain/d/f 7.txt").read_text() == "\n67\n127\n187\n247\n" and len(list((tmp_path / "plain/d").iterdir())) == 60
    assert gzip.decompress((tmp_path / "packed/d/f 1.txt").read_bytes()) == b"1\n61\n121\n181\n241\n"


def test_whole_texts_are_read_by_tasks(spark, tmp_path):
    """A text's path is that of the listing, with a blank in it too, and no path comes to the driver."""
    for i in range(3):
        (tmp_path / f"a {i}.json").write_text(f'{{"records":[{i}]}}')
    listed = files.list_tree(spark, f"file://{tmp_path}", r"\.json$")
    assert {r.path for r in listed.collect()} == {r.source_path for r in lines.whole_texts(spark, listed).collect()}


def test_counter_log_is_parsed_once(spark, sf):
    from meterloom.plans import ingest_queries

    plan = ingest_queries.counter_log(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "from_json" not in plan and "JsonToStructs" not in plan
    assert len(ingest.COUNTER_PLACES) < len(ingest.PLACES) / 2 and set(ingest.COUNTER_PLACES) <= set(ingest.PLACES)


def test_lines_of_a_packed_file_are_dealt(spark, tmp_path, monkeypatch):
    """A packed file is read by one task, but its lines go on to several, with their numbers; plain text stays where it is read."""
    text = [f"line {i}" for i in range(30000)]
    with gzip.open(tmp_path / "a.jsonl.gz", "wt") as f:
        f.write("\n".join(text))
    (tmp_path / "b.jsonl").write_text("\n".join(text))
    found = files.list_files(spark, f"file://{tmp_path}", r"\.jsonl")
    monkeypatch.setattr(lines, "DEALT_LINES", 500)
    confs = {"spark.sql.files.maxPartitionBytes": "64k", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k) for k in confs}
    for k, v in confs.items():
        spark.conf.set(k, v)
    try:
        got = lines.scan_lines(spark, found).withColumn("task", F.spark_partition_id()).collect()
        plain = lines.scan_lines(spark, found.where("name = 'b.jsonl'"))._jdf.queryExecution().optimizedPlan().toString()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    for name in ("a.jsonl.gz", "b.jsonl"):
        mine = [r for r in got if r.source_path.endswith(name)]
        assert {r.line_no: r.value for r in mine} == dict(enumerate(text, 1)) and len(mine) == len(text)
        assert len({r.task for r in mine}) > 1
    assert "strategy=broadcast" in plain


def test_turn_logs_are_parsed_once_for_their_records(spark):
    """What records and their warnings are made of passes cut, so a refresh writes it before it is looked at again."""
    turn = {"timestamp": 1777600000, "params": {"update": {"sessionUpdate": "turn_completed", "usage": {"modelUsage": {"m": {"inputTokens": 3, "outputTokens": 1, "totalTokens": 9}}}}}}
    text = spark.createDataFrame([("r/s/updates.jsonl", 1, json.dumps(turn))], "source_path string, line_no bigint, value string")
    seen = []

    def cut(df):
        seen.append(df)
        return spark.createDataFrame(df.collect(), df.schema)

    records, issues = ingest.ingest_turn_log(text, cut=cut)
    assert len(seen) == 1 and seen[0].count() == 1
    assert [r.tokens.input for r in records.collect()] == [3] and [i.code for i in issues.collect()] == ["token_convention_changed"]
    assert "from_json" not in records._jdf.queryExecution().optimizedPlan().toString()


def test_orders_are_dealt_by_the_number_of_lines(spark, sf, monkeypatch):
    """Tasks of cumulative_delta get more in number, not larger, as the table grows."""
    monkeypatch.setattr(ingest_queries, "TASK_LINES", 200)
    got = ingest_queries.cumulative_delta(spark, sf).groupBy(F.spark_partition_id().alias("task")).count().collect()
    assert sum(r["count"] for r in got) == spark.read.parquet(f"{sf}/lineitem.parquet").count()
    assert max(r["count"] for r in got) < 600
