"""Time the headline queries; prints one JSON line.

``BENCH_SF_DIR`` names the table folder, ``BENCH_CPUS`` the local cores. Each query runs
once to warm up and is then timed; results are fully computed and thrown away.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowsieve.config import RunConfig
from rowsieve.functions.fingerprint import with_fingerprint
from rowsieve.operators import corrections, incremental, package, transform, validate
from rowsieve.operators.rules import expense_rules
from rowsieve.plans import catalog
from rowsieve.plans.ledger_queries import sample_fixes, sample_skips
from rowsieve.session import build_session, scratch_path, settle
from rowsieve.sources.sinks import write_results
from rowsieve.sources.tables import EXPENSE_AS_OF, expenses

CONFIG = RunConfig(as_of=EXPENSE_AS_OF)
RULES = expense_rules(CONFIG)


def drain(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "8g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")

    # The landed table, as an ingest leaves it: several files in row order.
    started = time.perf_counter()
    x = settle(
        expenses(spark, sf_dir)
        .repartitionByRange(int(cpus), "row_index")
        .sortWithinPartitions("row_index"),
        "bench",
    )
    landing = time.perf_counter() - started
    n_rows = x.count()
    ledger = settle(validate.error_ledger(x, RULES), "ledger")
    states = settle(incremental.row_states(x, RULES), "states")
    cache = settle(incremental.cache_of(states, RULES), "cache")
    fixes = settle(corrections.accepted_fixes(sample_fixes(x), x), "fixes")
    skips = settle(sample_skips(x), "skips")
    active_fields = [r.field for r in RULES.row_rules]

    def changed(per_mille: int) -> tuple[DataFrame, DataFrame]:
        """The table with the vendor of some rows changed, spread evenly, and those rows."""
        hit = F.pmod(F.xxhash64("row_index"), F.lit(1000)) < per_mille
        after = x.withColumn("vendor", F.when(hit, F.lit("New vendor")).otherwise(F.col("vendor")))
        return after, x.filter(hit).select("row_index")

    def revalidate(per_mille: int) -> DataFrame:
        after, _ = changed(per_mille)
        return incremental.row_states(after, RULES, skipped=skips, cache=cache)

    def refresh(per_mille: int) -> DataFrame:
        after, rows = changed(per_mille)
        return incremental.refresh_ledger(x, after, rows, ledger, RULES)

    def split_and_write() -> None:
        success, errors = package.split_rows(x, skips, ledger, CONFIG)
        write_results(success, errors, scratch_path(spark, "out"), "1")

    work = {
        "error_ledger": lambda: drain(validate.error_ledger(x, RULES)),
        "validation_summary": lambda: drain(
            validate.validation_summary(x, settle(validate.error_ledger(x, RULES), "ledger"))
        ),
        "duplicates": lambda: drain(
            validate.repeated_rows(x, ["employee_id", "spend_date"])
        ),
        "row_fingerprint": lambda: drain(with_fingerprint(x)),
        "incremental_0.1pct": lambda: drain(revalidate(1)),
        "incremental_1pct": lambda: drain(revalidate(10)),
        "incremental_10pct": lambda: drain(revalidate(100)),
        "incremental_100pct": lambda: drain(revalidate(1000)),
        "refresh_0.1pct": lambda: drain(refresh(1)),
        "refresh_1pct": lambda: drain(refresh(10)),
        "apply_fixes": lambda: drain(corrections.apply_fixes(x, fixes)),
        "skip_all_active": lambda: drain(
            corrections.active_error_rows(x, ledger, skips, fields=active_fields)
        ),
        "enrich_all": lambda: drain(transform.enrich(x, CONFIG)),
        "split_and_write": split_and_write,
    }
    for name in ("lookup_join", "rule_range_native", "rule_unique_native", "run_transitions"):
        work[name] = lambda name=name: drain(catalog.QUERIES[name](spark, sf_dir))

    wanted = sys.argv[1:] or list(work)
    timings: dict[str, float] = {}
    for name in wanted:
        work[name]()
        started = time.perf_counter()
        work[name]()
        timings[name] = round(time.perf_counter() - started, 3)
    print(
        json.dumps(
            {
                "metric": "total time of headline queries",
                "value": round(sum(timings.values()), 3),
                "unit": "sec",
                "queries": timings,
                "rows": n_rows,
                "landing": round(landing, 3),
                "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
