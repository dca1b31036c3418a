"""Mixing sources to target weights: Sainte-Laguë quotas of equal blocks, then seeded runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowsieve.llm.common import words
from rowsieve.session import settle

#: Words in one block, the unit that quotas count.
BLOCK_WORDS = 32
#: Words in one shard of a source, about: a shard is the rows one window holds in order.
SHARD_WORDS = 1 << 18
SEED = 20_240_501


def word_count(text: Column) -> Column:
    """Number of words of a text, null texts have none."""
    return F.size(words(text)).cast("long")


def source_targets(
    sources: DataFrame, weights: Sequence[float] = (1, 2, 3), share: float = 1.0, most: float = 3.0
) -> DataFrame:
    """Adds ``weight``, ``source_rank`` and ``target`` to rows (source, source_size).

    Sources in code point order, null last, weigh ``weights`` in turn and share ``share`` of all
    sizes; a target stops at ``most`` times its source's size and the excess goes to the others
    by weight. The level at which no target is above its stop comes in one sorted pass: with
    sources ordered by stop / weight, the first that stays below its stop fixes it.
    """
    order = Window.partitionBy(F.lit(0)).orderBy(F.asc_nulls_last("source"))
    every = Window.partitionBy(F.lit(0))
    turn = F.array(*[F.lit(float(w)) for w in weights])
    ranked = (
        sources.withColumn("source_rank", F.row_number().over(order).cast("long"))
        .withColumn(
            "weight",
            F.element_at(turn, (F.col("source_rank") - 1).cast("int") % len(weights) + 1),
        )
        .withColumn("stop", most * F.col("source_size"))
        .withColumn("total", share * F.sum("source_size").over(every))
    )
    by_ratio = Window.partitionBy(F.lit(0)).orderBy(F.col("stop") / F.col("weight"), "source_rank")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    after = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    level = (F.col("total") - F.coalesce(F.sum("stop").over(before), F.lit(0.0))) / F.sum(
        "weight"
    ).over(after)
    leveled = ranked.withColumn("level", level).withColumn(
        "open_level",
        F.when(F.col("stop") >= F.col("level") * F.col("weight"), F.col("level")),
    )
    at = by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    chosen = F.first("open_level", ignorenulls=True).over(at)
    return (
        leveled.withColumn("chosen", chosen)
        .withColumn(
            "target",
            F.when(F.col("chosen").isNull(), F.col("stop")).otherwise(
                F.least(F.col("stop"), F.col("chosen") * F.col("weight"))
            ),
        )
        .drop("stop", "total", "level", "open_level", "chosen")
    )


def sainte_lague(rows: DataFrame, group: str, key: str, weight: str, seats: str) -> DataFrame:
    """(group, key, quota): ``seats`` of each group given to its keys by highest quotients.

    A key with weight w holds the seats whose quotients w / (2k + 1) are among the group's
    highest; ties go to the smaller key. Only quotients that can be at the edge are listed:
    with n keys and S seats the divisor lies within n / 2S of W / S, so each key's seats below
    that range are sure, and about four quotients a key are sorted. Keys of no weight get none.
    """
    one = Window.partitionBy(group)
    n = F.count(F.when(F.col(weight) > 0, 1)).over(one)
    fair = F.try_divide(F.col(seats) * F.col(weight), F.sum(weight).over(one))
    slack = F.try_divide(n.cast("double"), 2.0 * F.col(seats))
    ranged = (
        rows.withColumn("fair", fair)
        .withColumn("slack", slack)
        .filter((F.col(weight) > 0) & (F.col(seats) > 0))
        .withColumn(
            "sure",
            F.greatest(F.lit(0), F.round(F.col("fair") * (1 - F.col("slack"))) - 1).cast("long"),
        )
        .withColumn("last", (F.round(F.col("fair") * (1 + F.col("slack"))) + 1).cast("long"))
        .withColumn("left", F.col(seats) - F.sum("sure").over(one))
    )
    listed = ranged.select(
        group, key, weight, "sure", "left", F.explode(F.sequence("sure", "last")).alias("seat_no")
    )
    rank = F.row_number().over(
        Window.partitionBy(group).orderBy(F.desc(F.col(weight) / (2 * F.col("seat_no") + 1)), key)
    )
    return (
        listed.withColumn("rank", rank)
        .groupBy(group, key)
        .agg(
            (F.first("sure") + F.count(F.when(F.col("rank") <= F.col("left"), 1))).alias("quota")
        )
    )


def mix(
    docs: DataFrame,
    weights: Sequence[float] = (1, 2, 3),
    share: float = 1.0,
    most: float = 3.0,
    block_words: int = BLOCK_WORDS,
    shard_words: int = SHARD_WORDS,
    seed: int = SEED,
    keep: Sequence[str] = (),
) -> DataFrame:
    """What the mix takes of each row of ``docs`` (doc_id, text, source).

    Columns: the ones in ``keep``, then ``doc_id, source, size, source_size, target, taken,
    passes, cut_from, cut_to, wrap_to``. The whole row is taken ``passes`` times, its words from
    ``cut_from`` up to ``cut_to`` once more, and the first ``wrap_to`` words once more (a run
    that wrapped round its shard).

    Each source is dealt to shards by a hash of doc_id; a shard is its rows' words in seeded
    order, cut in blocks of ``block_words``. Sources get blocks by highest quotients of their
    targets, shards get their source's blocks the same way by size. A shard with more blocks than
    it has words goes through whole, again and again, and the rest is a run of blocks from a
    seeded start, so at most two rows a shard are cut. ``taken`` of a source is within one block
    and, where targets meet the stop, one block a shard, of its target.

    One narrow shuffle of the rows; sources are never gathered in one task, a big one has many
    shards. Null texts have size 0 and are taken 0 times; a null source is a source of its own,
    last in order. Rows of equal doc_id share a shard and are taken each by itself; their order
    falls back to size, so which of two equal ids is cut may differ if sizes are equal too. An
    empty table gives no rows.
    """
    sized = docs.select(
        *[F.col(c).alias(f"keep_{c}") for c in keep],
        F.col("doc_id"),
        F.col("source"),
        word_count(F.col("text")).alias("size"),
    )
    narrow = settle(
        docs.select("doc_id", "source", word_count(F.col("text")).alias("size")), "mix-sizes"
    )
    if not keep:
        sized = narrow
    sources = settle(
        source_targets(
            narrow.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most
        ).withColumn(
            "shards", F.greatest(F.lit(1), F.ceil(F.col("source_size") / shard_words)).cast("long")
        ),
        "mix-sources",
    )
    seats = F.round(F.sum("target").over(Window.partitionBy(F.lit(0))) / block_words).cast("long")
    quotas = sainte_lague(
        sources.withColumn("seats", seats).withColumn("every", F.lit(0)),
        "every", "source_rank", "target", "seats",
    ).select("source_rank", F.col("quota").alias("seats"))

    info = sources.select(
        F.col("source").alias("its_source"), "source_rank", "source_size", "target", "shards"
    )
    dealt = sized.join(info, F.col("source").eqNullSafe(F.col("its_source"))).drop("its_source")
    shard = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.col("shards"))
    dealt = dealt.withColumn("shard", shard)
    sizes = (
        narrow.join(info, F.col("source").eqNullSafe(F.col("its_source")))
        .withColumn("shard", shard)
        .groupBy("source_rank", "shard")
        .agg(F.sum("size").alias("shard_size"))
    )
    sizes = settle(sizes, "mix-shards")
    plan = sizes.join(
        sainte_lague(
            sizes.join(quotas, "source_rank"), "source_rank", "shard", "shard_size", "seats"
        ),
        ["source_rank", "shard"],
        "left",
    ).select(
        "source_rank",
        "shard",
        "shard_size",
        F.least(
            F.coalesce("quota", F.lit(0)) * block_words,
            F.floor(most * F.col("shard_size")).cast("long"),
        ).alias("due"),
    )
    plan = plan.withColumn(
        "passes",
        F.when(F.col("shard_size") > 0, F.floor(F.col("due") / F.col("shard_size"))).otherwise(0),
    ).withColumn("rest", F.col("due") - F.col("passes") * F.col("shard_size"))
    blocks = F.greatest(F.lit(1), F.ceil(F.col("shard_size") / block_words)).cast("long")
    plan = settle(
        plan.withColumn(
            "run_from",
            F.pmod(F.xxhash64("source_rank", "shard", F.lit(seed + 1)), blocks) * block_words,
        ).select("source_rank", "shard", "shard_size", "passes", "rest", "run_from"),
        "mix-plan",
    )

    order = Window.partitionBy("source_rank", "shard").orderBy(
        F.xxhash64("doc_id", F.lit(seed + 2)), "doc_id", "size"
    )
    start = F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1))
    placed = dealt.withColumn("start", F.coalesce(start, F.lit(0))).join(
        plan, ["source_rank", "shard"]
    )
    run_to = F.col("run_from") + F.col("rest")
    end = F.col("start") + F.col("size")
    clip = lambda c: F.least(F.greatest(c - F.col("start"), F.lit(0)), F.col("size"))
    return (
        placed.withColumn("cut_from", clip(F.least("run_from", end)))
        .withColumn("cut_to", clip(F.least(run_to, F.col("shard_size"))))
        .withColumn("wrap_to", clip(F.greatest(run_to - F.col("shard_size"), F.lit(0))))
        .select(
            *[F.col(f"keep_{c}").alias(c) for c in keep],
            *[c for c in ("doc_id", "source") if c not in keep],
            "size",
            "source_size",
            "target",
            (
                F.col("passes") * F.col("size")
                + (F.col("cut_to") - F.col("cut_from"))
                + F.col("wrap_to")
            ).alias("taken"),
            F.col("passes").cast("int").alias("passes"),
            "cut_from",
            "cut_to",
            "wrap_to",
        )
    )


def mixed_rows(docs: DataFrame, **settings) -> DataFrame:
    """The rows of the mix, with the columns of ``docs``: each as often as ``mix`` takes it.

    Rows cut where a run ends keep their taken words, joined by one space, as ``text``;
    ``n_chars``, where it is a column, is counted anew. Takes the settings of ``mix``.
    """
    columns = docs.columns
    boxed = docs.select("doc_id", "text", "source", F.struct(*columns).alias("row"))
    mixed = mix(boxed, keep=("row", "text"), **settings)
    cut = lambda a, b: F.array_join(F.slice(words(F.col("text")), a + 1, b - a), " ")
    lo, hi = F.col("cut_from").cast("int"), F.col("cut_to").cast("int")
    wrap = F.col("wrap_to").cast("int")
    whole = (F.col("cut_to") - F.col("cut_from") == F.col("size")) & (F.col("size") > 0)
    again = F.when(whole, F.array("text")).when(hi > lo, F.array(cut(lo, hi)))
    round_again = F.when(wrap > 0, F.array(cut(F.lit(0), wrap)))
    none = F.array().cast("array<string>")
    texts = F.concat(
        F.array_repeat("text", F.col("passes")),
        F.coalesce(again, none),
        F.coalesce(round_again, none),
    )
    listed = mixed.filter(F.col("taken") > 0).select("row", F.explode(texts).alias("taken_text"))
    made = {"text": F.col("taken_text"), "n_chars": F.length("taken_text").cast("long")}
    return listed.select(*[made.get(c, F.col("row")[c]).alias(c) for c in columns])
