"""Repeated keys across batches.

Within a batch the batch operator finds repeats, hot keys cut into pieces. Across batches
a table of each key's last row is kept as versions, one a batch: only the first row of a key in a
batch meets it, so a key that holds a third of a batch is one row there, and no Python runs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowsieve.functions.text import shown
from rowsieve.operators import keyed_log
from rowsieve.operators.groups import PIECE_ROWS, value_before
from rowsieve.session import settle
from rowsieve.streaming.files import each_available


def repeats_across_batches(
    stream: DataFrame,
    columns: Sequence[str],
    work: str,
    order: str = "row_index",
    ttl_ms: int | None = None,
    piece_rows: int = PIECE_ROWS,
    compact_every: int = 50,
) -> DataFrame:
    """Rows whose key was seen before, with the index of the last row that had it.

    Earlier means an earlier batch, or a lower ``order`` in the same batch. ``work`` holds the
    last rows and the results; calling again continues after the batches already seen. A batch
    reads the versions before its own and writes its own, so handed over again after a
    failure it gives the same. With ``ttl_ms``, keys not seen for that long are forgotten: not
    met at once, and gone from the table when its versions are put together, every
    ``compact_every`` batches. Without it the table has a row for every key ever seen.
    """
    spark = stream.sparkSession
    keys = [f"key_{c}" for c in columns]
    narrow = stream.select(order, *[shown(F.col(c)).alias(f"key_{c}") for c in columns])
    alive = "true" if ttl_ms is None else f"unix_millis(current_timestamp()) - seen_ms < {ttl_ms}"

    def handle(batch: DataFrame, batch_id: int) -> None:
        rows = settle(batch, "rows", f"{work}/rows/batch={batch_id}")
        local = settle(
            value_before(rows, keys, order, F.col(order), "prev_row", piece_rows=piece_rows),
            "local",
            f"{work}/local/batch={batch_id}",
        )
        found = local.filter(F.col("prev_row").isNotNull()).select(order, "prev_row")
        if batch_id > 0:
            known = keyed_log.current_rows(spark, f"{work}/last", keys, batch_id).filter(alive)
            firsts = local.filter(F.col("prev_row").isNull()).select(order, *keys)
            met = firsts.join(known, keys).select(order, F.col("last_row").alias("prev_row"))
            found = found.unionByName(met)
        found.write.mode("overwrite").parquet(f"{work}/found/batch={batch_id}")
        last = rows.groupBy(*keys).agg(F.max(order).alias("last_row"))
        seen = F.unix_millis(F.current_timestamp())
        keyed_log.append_version(last.withColumn("seen_ms", seen), f"{work}/last", batch_id)
        if batch_id and batch_id % compact_every == 0:
            keyed_log.compact(spark, f"{work}/last", keys, batch_id, alive)

    each_available(narrow, handle, f"{work}/checkpoint-rows")
    return spark.read.parquet(f"{work}/found").select(order, "prev_row")
