import json
import random
from datetime import datetime, timedelta, timezone

from pyspark.sql import functions as F

from meterloom.functions.timez import resolve_range
from meterloom.operators import ingest, pricing
from meterloom.plans.summary import rollups_of, summarise
from meterloom.sources import lines, store
from meterloom.streaming import deltas, states

RATES = {"currency": "USD", "price_unit": "1M", "source_url": "https://a.example.com/x", "checked_at": datetime(2026, 1, 1), "provider": "codex", "aliases": []}
DAY = datetime(2026, 5, 1, tzinfo=timezone.utc)


def token_count(total, at=DAY):
    usage = {"input_tokens": total, "cached_input_tokens": total // 3, "output_tokens": total // 10}
    return {"timestamp": at.isoformat(), "type": "event_msg", "payload": {"type": "token_count", "info": {"total_token_usage": usage}}}


def model(name, at=DAY):
    return {"timestamp": at.isoformat(), "type": "turn_context", "payload": {"model": name}}


def frame(spark, rows):
    return spark.createDataFrame([(f, n, json.dumps(x)) for f, n, x in rows], lines.LINES_SCHEMA)


def run(spark, base, batches, **more):
    """Each list of lines as a batch of a stream."""
    for rows in batches:
        frame(spark, rows).coalesce(1).write.mode("append").parquet(f"{base}/in")
        source = spark.readStream.schema(lines.LINES_SCHEMA).parquet(f"{base}/in")
        query = source.writeStream.foreachBatch(deltas.upsert(base, "codex", "root", **more)).option("checkpointLocation", f"{base}/cp").trigger(availableNow=True).start()
        query.awaitTermination()


def stored(spark, base):
    columns = ["file_id", "line_no", "seq", "model", "own_model", "session_id", "tokens.input", "tokens.cached_input", "tokens.output", "utc_date"]
    return sorted(map(tuple, store.read_records(spark, f"{base}/records").select(*columns).collect()), key=str)


def in_one_go(spark, rows):
    records, _ = ingest.ingest_counter_log(frame(spark, rows))
    done = store.pseudonymise(records.withColumn("root_id", F.lit("x")), "root")
    return sorted(map(tuple, done.select("file_id", "line_no", "seq", "model", "own_model", "session_id", "tokens.input", "tokens.cached_input", "tokens.output", "utc_date").collect()), key=str)


def drawn_batches():
    """Lines of five files over days, dealt to three batches; models come late, change, or never come; totals fall at times."""
    rng, out, no, total = random.Random(3), [[], [], []], {}, {}
    for k in range(160):
        f = f"/logs/f{rng.randrange(5)}.jsonl"
        at = DAY + timedelta(hours=k * 2 + (int(f[-7]) * 100 if f[-7].isdigit() else 0))
        no[f] = no.get(f, 0) + 1
        if k > 40 and rng.random() < 0.1 and "f0" not in f:
            row = model("m" if "f1" in f or rng.random() < 0.7 else "other", at)
        elif rng.random() < 0.1:
            row = {"type": "session", "id": f"s{k}", "timestamp": at.isoformat()}
        else:
            total[f] = 5 if rng.random() < 0.05 else total.get(f, 0) + rng.randrange(50)
            row = token_count(total[f], at)
        out[k // 54].append((f, no[f], row))
    return out


def test_stream_equals_batch(spark, tmp_path):
    base, batches = f"file://{tmp_path}", drawn_batches()
    for i in range(len(batches)):
        run(spark, base, batches[i : i + 1])
        assert stored(spark, base) == in_one_go(spark, [r for b in batches[: i + 1] for r in b])


def test_batch_run_again_changes_nothing(spark, tmp_path):
    base, batches = f"file://{tmp_path}", drawn_batches()
    one = deltas.upsert(base, "codex", "root")
    for i, rows in enumerate(batches[:2]):
        one(frame(spark, rows), i)
        before = stored(spark, base)
        one(frame(spark, rows), i)
        assert stored(spark, base) == before
    # Lines that come once more in a later batch have been seen.
    one(frame(spark, batches[0]), 2)
    assert stored(spark, base) == before


def test_a_batch_reads_its_days_alone(spark, tmp_path, monkeypatch):
    base = f"file://{tmp_path}"
    one = deltas.upsert(base, "codex", "root")
    rows = [("a", 1, token_count(10, DAY)), ("b", 1, model("m")), ("b", 2, token_count(10, DAY + timedelta(days=5)))]
    one(frame(spark, rows), 0)
    seen = []
    real = store.overwrite_days
    monkeypatch.setattr(store, "overwrite_days", lambda spark, rows, days, path: (seen.append({str(d) for _, d in days}), real(spark, rows, days, path)))
    one(frame(spark, [("b", 3, token_count(30, DAY + timedelta(days=6)))]), 1)
    assert seen.pop() == {"2026-05-07"}
    # The first model of a file changes its earlier rows; those of a second day are the batch's own.
    one(frame(spark, [("a", 2, model("late")), ("a", 3, token_count(50, DAY + timedelta(days=9)))]), 2)
    assert seen.pop() == {"2026-05-01", "2026-05-10"}
    # The same model again changes no earlier row.
    one(frame(spark, [("a", 4, model("late")), ("a", 5, token_count(90, DAY + timedelta(days=9)))]), 3)
    assert seen.pop() == {"2026-05-10"}
    found = store.read_records(spark, f"{base}/records")
    assert {r.model for r in found.where("seq = 0").collect()} == {"late", "m"}
    plan = found.where(store.in_days({("codex", DAY.date())}))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "utc_date" in plan.split("PartitionFilters")[1].split("]")[0]


def test_states_are_put_together(spark, tmp_path):
    base, n = f"file://{tmp_path}/s", 20
    for i in range(n):
        states.tidy_states(spark, base, i)
        states.write_states(spark.createDataFrame([(f"f{i % 3}", i)], "source_path string, line_no bigint").withColumn("seq", F.lit(0)), base, "source_path string, line_no bigint, seq int", i)
    names = {p.name for p in (tmp_path / "s").iterdir()}
    assert any(x.startswith("whole-") for x in names) and len(names) < n
    found = states.read_states(spark, base, "source_path string, line_no bigint, seq int", before=n)
    assert sorted((r.source_path, r.line_no) for r in found.collect()) == [("f0", 18), ("f1", 19), ("f2", 17)]


def flat(summary):
    parts = (summary.totals, summary.provider_split, summary.model_split, summary.trend, summary.sessions)
    return [sorted(map(str, df.select(sorted(df.columns)).collect())) for df in parts]


def test_summaries_follow_the_stream(spark, tmp_path):
    """All five rollups from stored partials equal those of a count of all records, after each batch, late rows too."""
    base, batches = f"file://{tmp_path}", drawn_batches()
    rules = pricing.rules_from(spark, [RATES | {"model": "m", "rates": {"input": 2, "cached_input": 0.2, "output": 7}}, RATES | {"model": "other", "rates": {"input": 3}, "effective_from": datetime(2026, 5, 3)}])
    zone = "Asia/Kolkata"
    after = deltas.session_partials(spark, f"{base}/records", f"{base}/partials", rules, zone)
    spans = [resolve_range("custom", DAY, zone, *days) for days in (("2026-05-01", "2026-06-30"), ("2026-05-04", "2026-05-04"))]
    for i in (2, 0, 1):  # the last days first, so that later batches bring late rows
        one = [(f, n + 1000 * i, x) for f, n, x in batches[i]] if i else batches[i]
        run(spark, base, [[(f"{f}{i}", n, x) for f, n, x in one]], after=after)
        partials = spark.read.parquet(f"{base}/partials")
        for span in spans:
            got = rollups_of(deltas.partials_in(partials, span))
            want = summarise(store.read_records(spark, f"{base}/records"), span, rules)
            assert flat(got) == flat(want)
            got.close()
            want.close()
    assert deltas.trigger_seconds(1) == 30


def test_a_first_batch_has_nothing_to_meet(spark, tmp_path):
    """Where there are no states and no table yet, no join or union with them is planned, and a batch's files leave no scratch."""
    base = f"file://{tmp_path}"
    rows = deltas.batch_rows(frame(spark, [("a", 1, token_count(10)), ("a", 2, model("m"))]))
    records, now = deltas.batch_records(rows, states.read_states(spark, f"{base}/states", deltas.STATE_SCHEMA, before=0))
    for df in (records, now):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "LeftSemi" not in plan and "Union" not in plan
    assert "LocalRelation <empty>" in store.read_records(spark, f"{base}/none")._jdf.queryExecution().optimizedPlan().toString()
    deltas.upsert(base, "codex", "root")(frame(spark, [("a", 1, token_count(10))]), 0)
    assert sorted(p.name for p in tmp_path.iterdir()) == ["records", "states"]
