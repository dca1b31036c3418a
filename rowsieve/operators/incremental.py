"""Re-validation that reports only what changed.

Everything here works on a narrow projection (row key, fingerprint, errors), so the wide
rows are scanned once and never shuffled.
"""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowsieve.functions.fingerprint import with_fingerprint
from rowsieve.functions.text import shown
from rowsieve.operators.groups import (
    BROADCAST_ROWS,
    PIECE_ROWS,
    if_small,
    is_small,
    lookup_join,
)
from rowsieve.operators.rules import RuleSet
from rowsieve.operators.validate import (
    LEDGER_FIELDS,
    ROW_KEY,
    duplicate_entry,
    duplicate_errors,
    exclude_rows,
    key_texts,
    row_errors,
    with_previous_row,
)

USER_SKIPPED = "user_skipped"
UNCHANGED = "unchanged"
CHECKED = "checked"


def row_states(
    df: DataFrame,
    rules: RuleSet,
    skipped: DataFrame | None = None,
    cache: DataFrame | None = None,
    row_key: Sequence[str] = ROW_KEY,
    piece_rows: int = PIECE_ROWS,
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """What one pass decides about every row: ``state``, ``errors``, ``is_valid``.

    A row is *unchanged* when its fingerprint is cached as valid and it repeats no earlier
    key. Repeats look at all rows, user-skipped and cached ones included.

    A cache small enough to be sent to every task is asked in the scan, before the rules: a row
    it holds as valid has no row errors, so its cells are not parsed and no rule is worked out.
    A larger cache meets the rows after the rules, on a narrow projection.
    """
    row_key = list(row_key)
    printed = with_fingerprint(df, exclude=row_key)
    keys = key_texts(df, rules.unique.columns) if rules.unique else {}
    printed = printed.withColumns(keys)
    valid = None if cache is None else _valid_entries(cache, rules, row_key)
    # Fingerprints leave the key out, so rules on it must see every row.
    asked_first = (
        valid is not None
        and not any(r.field in row_key for r in rules.row_rules)
        and is_small(valid, broadcast_rows)
    )
    if asked_first:
        probe = _probe(row_key[:-1], F.col("row_fp"))
        printed = printed.withColumn("probe", probe).join(F.broadcast(valid), "probe", "left")
        unknown = F.col("is_cached").isNull()
        cells = {c: F.when(unknown, F.col(c)) for c in df.columns if c not in row_key}
        typed = rules.with_parsed(printed.withColumns(cells))
        found = F.when(unknown, F.array_compact(rules.errors(typed)))
        extra = ["is_cached"]
    else:
        typed, extra = rules.with_parsed(printed), []
        found = F.array_compact(rules.errors(typed))
    rows = typed.select(*row_key, "row_fp", found.alias("row_errors"), *keys, *extra)
    if rules.unique is not None:
        # Counted on the table itself: neither rules nor the cache are asked for that.
        rows = with_previous_row(rows, list(keys), row_key, piece_rows, df.count())
    else:
        rows = rows.withColumn("prev_row", F.lit(None).cast("long"))

    if skipped is not None:
        marks = skipped.select(*row_key).distinct().withColumn("is_skipped", F.lit(True))
        rows = rows.join(marks, row_key, "left")
    else:
        rows = rows.withColumn("is_skipped", F.lit(None).cast("boolean"))

    if not asked_first:
        rows = _with_cache_hit(rows, rules, valid, row_key, piece_rows, broadcast_rows)
    state = (
        F.when(F.col("is_skipped"), F.lit(USER_SKIPPED))
        .when(F.col("is_cached") & F.col("prev_row").isNull(), F.lit(UNCHANGED))
        .otherwise(F.lit(CHECKED))
    )
    found = F.col("row_errors")
    if rules.unique is not None:
        entry = duplicate_entry(rules.unique)
        repeat = F.struct(*[value.alias(name) for name, value in entry.items()])
        repeats = F.when(F.col("row_errors").isNull(), F.array(repeat)).otherwise(
            F.concat(found, F.array(repeat))
        )
        found = F.when(F.col("prev_row").isNotNull(), repeats).otherwise(found)
    return (
        rows.withColumn("state", state)
        .withColumn("errors", F.when(F.col("state") == CHECKED, found))
        .withColumn(
            "is_valid",
            F.when(F.col("state") == CHECKED, F.size("errors") == 0).otherwise(
                F.col("state") == UNCHANGED
            ),
        )
        .select(*row_key, "row_fp", "prev_row", "state", "errors", "is_valid")
    )


def _probe(scope: Sequence[str], fingerprint: Column) -> Column:
    """The fingerprint, behind the scope columns if there are any (their JSON keeps them apart)."""
    if not scope:
        return fingerprint
    return F.concat(F.to_json(F.struct(*[F.col(c).cast("string").alias(c) for c in scope])), fingerprint)


def _valid_entries(cache: DataFrame, rules: RuleSet, row_key: Sequence[str]) -> DataFrame:
    """(probe, is_cached): what the cache holds as valid under these rules. Runs have caches of
    their own: a hit needs the same scope, not only equal cells."""
    kept = cache.filter((F.col("ruleset_hash") == rules.digest()) & F.col("is_valid"))
    probe = _probe(list(row_key[:-1]), F.col("row_fp")).alias("probe")
    return kept.select(probe, F.lit(True).alias("is_cached"))


def _with_cache_hit(
    rows: DataFrame,
    rules: RuleSet,
    valid: DataFrame | None,
    row_key: Sequence[str],
    piece_rows: int,
    broadcast_rows: int,
) -> DataFrame:
    if valid is None:
        return rows.withColumn("is_cached", F.lit(False))
    scope = list(row_key[:-1])
    if rules.unique is None:
        # Copies of one row share a fingerprint and may be many: salted lookup.
        probed = rows.withColumn("probe", _probe(scope, F.col("row_fp")))
        return lookup_join(
            probed, valid, "probe", row_key, broadcast_rows, piece_rows
        ).drop("probe")
    # Copies of one row repeat its key, so only the first of them can hit the cache. The
    # others get a probe that matches nothing, which keeps the probes unique and evenly spread.
    may_hit = F.col("prev_row").isNull() & F.col("is_skipped").isNull()
    no_hit = F.concat_ws("#", F.lit(""), *[F.col(k).cast("string") for k in row_key])
    probed = rows.withColumn("probe", F.when(may_hit, _probe(scope, F.col("row_fp"))).otherwise(no_hit))
    return probed.join(valid, "probe", "left").drop("probe")


def ledger_of(states: DataFrame, row_key: Sequence[str] = ROW_KEY) -> DataFrame:
    """The error ledger of a pass."""
    exploded = states.select(*row_key, F.explode("errors").alias("e"))
    return exploded.select(*row_key, *[F.col(f"e.{name}") for name in LEDGER_FIELDS])


def unchecked_of(states: DataFrame, row_key: Sequence[str] = ROW_KEY) -> DataFrame:
    """Rows the pass did not check: user-skipped or unchanged."""
    return states.filter(F.col("state") != CHECKED).select(*row_key, "state")


def cache_of(states: DataFrame, rules: RuleSet, row_key: Sequence[str] = ROW_KEY) -> DataFrame:
    """The fingerprint cache after a pass; it replaces the old one.

    Several rows with one fingerprint: the last row decides. Copies are combined before
    the shuffle.
    """
    scope, index = list(row_key[:-1]), row_key[-1]
    return (
        states.groupBy(*scope, "row_fp")
        .agg(F.max_by("is_valid", F.col(index)).alias("is_valid"))
        .withColumn("ruleset_hash", F.lit(rules.digest()))
    )


def invalidate_cache(
    cache: DataFrame,
    rules: RuleSet,
    fixed: DataFrame | None = None,
    skipped: DataFrame | None = None,
    row_key: Sequence[str] = ROW_KEY,
) -> DataFrame:
    """Forget the old fingerprints of fixed rows; mark those of skipped rows as not valid.

    Both arguments hold a ``row_fp`` column and the scope columns of ``row_key`` (its run), as
    the cache does: what one run fixes or skips leaves the entries of the others alone.
    """
    entry = [*row_key[:-1], "row_fp"]
    # No fingerprint is empty. One that can be null would be worked out twice, to leave nulls out.
    fingerprint = F.coalesce("row_fp", F.lit("")).alias("row_fp")
    given = [rows for rows in (fixed, skipped) if rows is not None]
    if not given:
        return cache
    old = [rows.select(*row_key[:-1], fingerprint) for rows in given]
    # One join on the entry, as the cache was grouped: a run that is one value in each argument
    # would be left out of the join's key, and the cache shuffled again.
    cache = cache.join(functools.reduce(DataFrame.union, old).distinct(), entry, "left_anti")
    if skipped is not None:
        bad = skipped.select(*entry).distinct().withColumns(
            {"is_valid": F.lit(False), "ruleset_hash": F.lit(rules.digest())}
        )
        cache = cache.unionByName(bad)
    return cache


def changed_rows(
    before: DataFrame, after: DataFrame, row_key: Sequence[str] = ROW_KEY
) -> DataFrame:
    """Compare two snapshots row by row: ``added``, ``removed``, ``changed`` or ``same``.

    Only the row key and the fingerprint are shuffled.
    """
    key = list(row_key)
    old = with_fingerprint(before, exclude=key).select(*key, F.col("row_fp").alias("old_fp"))
    new = with_fingerprint(after, exclude=key).select(*key, F.col("row_fp").alias("new_fp"))
    change = (
        F.when(F.col("old_fp").isNull(), "added")
        .when(F.col("new_fp").isNull(), "removed")
        .when(F.col("old_fp") != F.col("new_fp"), "changed")
        .otherwise("same")
    )
    return old.join(new, key, "full_outer").withColumn("change", change)


def refresh_ledger(
    before: DataFrame,
    after: DataFrame,
    changed: DataFrame,
    ledger: DataFrame,
    rules: RuleSet,
    skipped: DataFrame | None = None,
    row_key: Sequence[str] = ROW_KEY,
    piece_rows: int = PIECE_ROWS,
) -> DataFrame:
    """The ledger of ``after``, from the ledger of ``before`` and the rows that changed.

    Row rules run on changed rows only. The duplicate check runs on the rows that have a key
    a changed row had or has now. With few changes the table is scanned, not shuffled.
    """
    key = list(row_key)
    scope = key[:-1]
    marks = if_small(changed.select(*key).distinct())
    now = after.join(marks, key, "left_semi")
    if rules.unique is None:
        kept = ledger.join(marks, key, "left_anti").select(*key, *LEDGER_FIELDS)
        return exclude_rows(kept.unionByName(row_errors(now, rules, key)), skipped, key)

    def keyed(df: DataFrame) -> DataFrame:
        texts = [shown(F.col(c)).alias(f"_key_{c}") for c in rules.unique.columns]
        return df.select(*key, *rules.unique.columns, *texts)

    on = scope + [f"_key_{c}" for c in rules.unique.columns]
    moved = keyed(before).join(marks, key, "left_semi").unionByName(keyed(now))
    touched_keys = if_small(moved.select(*on).distinct())
    recheck = keyed(after).join(touched_keys, on, "left_semi")

    by_row = ledger.filter(F.col("rule_no") != rules.unique.rule_no)
    by_key = ledger.filter(F.col("rule_no") == rules.unique.rule_no)
    kept = by_row.unionByName(
        by_key.join(recheck.select(*key), key, "left_anti")
    ).join(marks, key, "left_anti")
    # A changed row drops all its old errors; a touched key drops its old repeats.
    repeats = duplicate_errors(recheck, rules.unique, key, piece_rows)
    fresh = row_errors(now, rules, key).unionByName(repeats)
    return exclude_rows(kept.select(*key, *LEDGER_FIELDS).unionByName(fresh), skipped, key)
