"""Many runs in one job, the cache log, auto-skips from a stream and reviews that wait."""

import hashlib

import pytest
from pyspark.sql import functions as F

from rowsieve.operators import cache_log, corrections, incremental, package, runs, validate
from rowsieve.plans.workflow import run_review
from rowsieve.streaming import reviews
from rowsieve.streaming import validate as stream_validate
from rowsieve.streaming.files import folder_stream
from tests.helpers import CONFIG, RULES, collect, distinct_rows, random_rows, row, table
from tests.test_corrections import ANSWER

KEY = ("run_id", "row_index")


def in_runs(df, *names):
    return df.withColumn("run_id", F.explode(F.array(*map(F.lit, names))))


def test_answers_of_many_runs_equal_those_of_each(spark):
    tables = {"a": random_rows(30, 1), "b": random_rows(20, 2), "c": random_rows(10, 3)}
    dfs = {k: table(spark, v) for k, v in tables.items()}
    answers = {
        "a": [(0, "fix", "3", "dept", "HR", None), (1, "fix", "25", "dept", "OPS", None),
              (2, "row_fix", "4", None, None, {"dept": "FIN", "amount": "12.5"}), (3, "skip", "5", None, None, None)],
        "b": [(0, "fix", "25", "dept", "HR", None), (1, "skip_all", None, None, None, None)],
        "c": [(0, "fix", "25", "dept", "HR", None), (1, "skip", "x", None, None, None), (2, "fix", "0", "dept", "HR", None)],
    }
    parts = {k: [] for k in ("df", "ledger", "pending", "skipped", "answers")}
    one = {}
    for k, df in dfs.items():
        ledger = validate.error_ledger(df, RULES).cache()
        skipped = spark.createDataFrame([(1,)], "row_index bigint")
        asked = spark.createDataFrame(answers[k], ANSWER)
        pending = validate.review_batch(ledger)
        one[k] = corrections.apply_answers(df, ledger, pending, skipped, asked)
        for name, part in zip(parts, (df, ledger, pending, skipped, asked)):
            parts[name].append(part.withColumn("run_id", F.lit(k)))
    whole = {}
    for name, some in parts.items():
        whole[name] = some[0].unionByName(some[1]).unionByName(some[2])
    many = corrections.apply_answers(*whole.values(), row_key=KEY)
    for k, single in one.items():
        for field in ("table", "skipped", "pending"):
            mine = getattr(many, field).filter(F.col("run_id") == k).drop("run_id")
            want = getattr(single, field)
            assert collect(mine.select(*want.columns)) == collect(want), (k, field)
        counts = many.counts.filter(F.col("run_id") == k).drop("run_id").collect()
        assert [tuple(r) for r in counts] == [tuple(r) for r in single.counts.collect()]


def test_fixes_are_bounded_by_their_own_run(spark):
    rows = spark.createDataFrame([("a", 0), ("a", 1), ("b", 0)], "run_id string, row_index bigint")
    fixes = spark.createDataFrame(
        [("a", "1"), ("b", "1"), ("none", "0"), ("b", "x"), ("b", "0")], "run_id string, row_index string"
    )
    assert collect(corrections.accepted_fixes(fixes, rows, KEY), *KEY) == [("a", 1), ("b", 0)]
    assert collect(corrections.rejected_fixes(fixes, rows, KEY), *KEY) == [("b", "1"), ("b", "x"), ("none", "0")]


def test_runs_ingested_anew_start_with_nothing(spark):
    state = in_runs(spark.range(3), "a", "b")
    anew = spark.createDataFrame([("b",), ("b",)], "run_id string")
    assert collect(runs.without_runs(state, anew).groupBy("run_id").count()) == [("a", 3)]
    asked = spark.createDataFrame([("a",), ("z",)], "run_id string")
    assert collect(runs.confirm_runs(state, asked)) == [("a", 3, "RUNNING"), ("z", 0, "FAILED")]


def test_what_blocks_packaging(spark):
    df = table(spark, distinct_rows(2) + [row(employee_id="QX99", dept="x")])
    ledger = validate.error_ledger(df, RULES)
    queue = validate.review_batch(ledger)
    skipped = spark.createDataFrame([(2,)], "row_index bigint")
    assert collect(package.blocking(queue, df, ledger)) == [("open", 1), ("queued", 1)]
    assert package.blocking(queue.limit(0), df, ledger, skipped).isEmpty()


def test_cache_of_many_runs_is_invalidated_by_run(spark):
    df = in_runs(table(spark, distinct_rows(4)), "a", "b")
    states = incremental.row_states(df, RULES, row_key=KEY).cache()
    cache = incremental.cache_of(states, RULES, KEY)
    prints = states.select(*KEY, "row_fp")
    left = incremental.invalidate_cache(
        cache, RULES, fixed=prints.filter("run_id = 'a' AND row_index = 1"),
        skipped=prints.filter("run_id = 'b' AND row_index = 2"), row_key=KEY,
    )
    assert left.filter("run_id = 'a'").count() == 3
    assert collect(left.filter("run_id = 'b'").groupBy("is_valid").count()) == [(False, 1), (True, 3)]


def test_a_cache_of_many_runs_is_shuffled_once(spark, monkeypatch):
    # With one run in each argument the cache was dealt out a second time, by fingerprint alone.
    key = ("run_id", "row_index")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        rows = spark.range(40).selectExpr(
            "if(id % 2 = 0, 'a', 'b') AS run_id", "id AS row_index", "true AS is_valid",
            "sha2(cast(id AS string), 256) AS row_fp",
        )
        prints = rows.select("row_index", "row_fp").withColumn("run_id", F.lit("a"))
        kept = incremental.invalidate_cache(
            incremental.cache_of(rows, RULES, key),
            RULES,
            fixed=prints.filter("row_index < 10"),
            skipped=prints.filter("row_index > 35").withColumn("run_id", F.lit("b")),
            row_key=key,
        )
        plan = kept._jdf.queryExecution().executedPlan().toString()
        found = {(r[0], r[1], r[2]) for r in kept.select("run_id", "row_fp", "is_valid").collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "hashpartitioning(row_fp" not in plan
    # Nor are fingerprints worked out a second time to leave null ones out.
    assert "isnotnull(sha2" not in plan.split("Union")[1]
    fp = {i: hashlib.sha256(str(i).encode()).hexdigest() for i in range(40)}
    want = {("ab"[i % 2], fp[i], True) for i in range(40)
            if not (i % 2 == 0 and i < 10) and not (i % 2 and i > 35)}
    assert found == want | {("b", fp[i], False) for i in range(36, 40)}


def test_cache_log_versions_removals_and_compaction(spark, tmp_path):
    log = str(tmp_path / "log")

    def entries(*rows):
        return spark.createDataFrame([("R", fp, ok) for fp, ok in rows], "ruleset_hash string, row_fp string, is_valid boolean")

    def now(before=None):
        return collect(cache_log.current_cache(spark, log, before), "row_fp", "is_valid")

    cache_log.append_version(entries(("p", True), ("q", True)), log, 0)
    cache_log.append_version(entries(("p", False), ("r", True)), log, 1)
    cache_log.append_version(cache_log.removals(entries(("q", True)), "R"), log, 2)
    assert now() == [("p", False), ("r", True)]
    assert now(before=2) == [("p", False), ("q", True), ("r", True)]
    cache_log.append_version(entries(("p", True), ("r", True)), log, 1)  # replayed
    assert now() == [("p", True), ("r", True)]
    cache_log.compact(spark, log, 2)
    assert now() == [("p", True), ("r", True)]
    cache_log.append_version(entries(("q", False)), log, 3)
    assert now() == [("p", True), ("q", False), ("r", True)]


@pytest.mark.parametrize("compact_every", [50, 2])
def test_batches_feed_the_cache_of_the_next(spark, tmp_path, compact_every):
    df = table(spark, distinct_rows(6) + [row(employee_id="QX77", dept="x")])
    none = stream_validate.row_rule_cache(df.limit(0), RULES)
    arrivals = str(tmp_path / "in")
    for part in (df.filter("row_index < 3"), df, df):
        part.coalesce(1).write.mode("append").parquet(arrivals)
    stream = folder_stream(spark, arrivals, df.schema, max_files=1)
    states = stream_validate.revalidate_with_feedback(
        stream, RULES, none, *[str(tmp_path / n) for n in ("log", "states", "check")], compact_every=compact_every
    )
    seen = collect(states.groupBy("batch", "state").count())
    # Files are taken by their time; whichever comes first, no valid row is checked twice.
    checked = {b: n for b, s, n in seen if s == "checked"}
    assert sum(checked.values()) == 6 + states.filter("row_index = 6").count()
    assert states.filter("row_index = 6 AND is_valid").isEmpty()


EVENTS = "run_id string, ts timestamp, seq bigint, kind string, row_index bigint"


def test_open_rows_are_skipped_when_the_clock_runs_out(spark, tmp_path):
    at = lambda s: f"2024-01-01 {s // 3600:02d}:{s // 60 % 60:02d}:{s % 60:02d}"
    deliveries = [
        [("a", 0, "open", 1), ("a", 10, "open", 2), ("a", 20, "answer", 1), ("b", 0, "open", 7), ("c", 5, "open", 9)],
        # a answers in time and opens 3; b comes back after a pause; c never does.
        [("a", 320, "open", 3), ("b", 301, "open", 8), ("b", 310, "answer", None)],
        [("z", 20_000, "open", 1)],
    ]
    arrivals, skips = str(tmp_path / "in"), None
    for rows in deliveries:
        made = [(r, s, i, k, x) for i, (r, s, k, x) in enumerate(rows)]
        df = spark.createDataFrame([(r, at(s), i, k, x) for r, s, i, k, x in made], EVENTS.replace("ts timestamp", "ts string"))
        df.withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.mode("append").parquet(arrivals)
        stream = folder_stream(spark, arrivals, spark.createDataFrame([], EVENTS).schema)
        skips = reviews.auto_skips(stream, str(tmp_path / "out"), str(tmp_path / "check"))
    got = collect(skips.select("run_id", "row_index", F.date_format("skipped_at", "HH:mm:ss").alias("at")))
    assert got == [("a", 2, "00:10:20"), ("a", 3, "00:10:20"), ("b", 7, "00:05:00"), ("c", 9, "00:05:05")]


def test_a_review_waits_for_the_whole_queue(spark, tmp_path):
    df = table(spark, distinct_rows(4, dept="SALES"))
    calls = []

    def one_at_a_time(pass_no, queue):
        first = queue.agg(F.min("row_index")).first()[0]
        calls.append((pass_no, queue.select("row_index").distinct().count()))
        return spark.createDataFrame([(0, "fix", str(first), "dept", "HR", None)], ANSWER)

    report = run_review(df, CONFIG, one_at_a_time, str(tmp_path), "r")
    # Nothing is validated again before the queue is empty.
    assert calls == [(1, 4), (1, 3), (1, 2), (1, 1)] and report.passes == 2
    assert report.counts == {"valid_count": 4, "error_count": 0}


def test_skipping_the_rest_after_some_answers(spark, tmp_path):
    df = table(spark, distinct_rows(3, dept="SALES"))

    def answer(pass_no, queue):
        if queue.count() < 3:
            return None
        return spark.createDataFrame([(0, "fix", "1", "dept", "HR", None)], ANSWER)

    report = run_review(df, CONFIG, answer, str(tmp_path), "r")
    assert report.counts == {"valid_count": 1, "error_count": 2}
