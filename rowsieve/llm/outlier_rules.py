"""Quality rules: base rules, then robust multivariate outliers per language and source.

Everything runs as DataFrame expressions: statistics of a text with array functions, the
minimum-covariance-determinant estimate as grouped sums over a narrow table of statistics.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowsieve.llm.common import SPACES, words
from rowsieve.session import settle

WINDOW = 8
SYMBOLS = "#*$%&|<>"
#: Share of a group's documents that the estimate rests on.
CORE = 0.75
#: Share of a Gaussian group that would be rejected.
TAIL = 1e-7
#: Concentration steps.
STEPS = 4
#: Documents of its parent (all sources of the language, all languages) that a group's estimate
#: counts beside its own: five for each statistic, so that few documents of its own say little.
PRIOR = 25
#: Bytes of estimates that are sent to every task; more are shuffled.
SMALL_BYTES = 16 << 20
#: Transformed statistics and the least standard deviation each is granted: counts that are
#: nearly always 0 would otherwise make any other value an outlier. Each can pass the limit of the
#: distance by itself, but for repeated words: these have a base rule of their own, at 30 %, and a
#: line that stands twice in a short clean text counts in both.
FLOORS = {
    "log_words": 0.25,
    "log_word_chars": 0.05,
    "root_symbols": 0.045,
    "root_dup_lines": 0.1,
    "root_repeats": 0.15,
}
_Z = list(FLOORS)
#: Sums an estimate is made of.
_SUMS = ["n", *[f"s{j}" for j in range(len(_Z))]]
_SUMS += [f"s{j}_{k}" for j in range(len(_Z)) for k in range(j + 1)]
#: Where the concentration steps begin.
_STARTS = ("medians", "moments")
#: Bins of a distance: 2 ** (1 / 16) apart, so the core is found to about 4 % of a distance.
_BINS = 16


def let(value: Column, body) -> Column:
    """``body(value)`` with the value worked out once for each row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _repeat_words(w: Column) -> Column:
    """Words in windows that occur twice or more in their text, the first occurrence included."""
    none = F.lit(0).cast("long")
    starts = F.sequence(F.lit(0), F.size(w) - WINDOW)
    hashes = F.transform(starts, lambda i: F.xxhash64(F.slice(w, i + 1, F.lit(WINDOW))))

    def covered(h: Column) -> Column:
        pairs = F.sort_array(
            F.transform(h, lambda x, i: F.struct(x.alias("h"), i.cast("long").alias("i")))
        )

        def again(s: Column) -> Column:
            same = lambda x, j: F.coalesce(F.get(s, j)["h"] == x["h"], F.lit(False))
            found = F.filter(s, lambda x, i: same(x, i - 1) | same(x, i + 1))
            at = F.sort_array(F.transform(found, lambda x: x["i"]))
            start = F.struct(none.alias("n"), F.lit(-WINDOW).cast("long").alias("last"))
            total = F.aggregate(
                at,
                start,
                lambda a, i: F.struct(
                    (a["n"] + F.least(F.lit(WINDOW).cast("long"), i - a["last"])).alias("n"),
                    i.alias("last"),
                ),
            )
            return total["n"]

        return F.when(F.size(F.array_distinct(h)) == F.size(h), none).otherwise(let(pairs, again))

    return F.when(F.size(w) <= WINDOW, none).otherwise(let(hashes, covered))


def text_statistics(docs: DataFrame, keep: tuple[str, ...] = ("doc_id", "lang", "source")) -> DataFrame:
    """``keep`` and n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed.

    Windows are compared by a 64-bit hash inside one text. A null text has none of anything and
    fails the base rules for having fewer than 20 words.
    """
    text = F.coalesce("text", F.lit(""))
    read = docs.select(*keep, text.alias("text"), words(text).alias("text_words"))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    counted = read.select(
        *keep,
        F.size("text_words").cast("long").alias("n_words"),
        F.length(F.regexp_replace("text", SPACES, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        F.size(F.split("text", "\n")).cast("long").alias("n_lines"),
        _repeat_words(F.col("text_words")).alias("n_repeat_words"),
    )
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return counted.withColumn("base_failed", failed)


def _transformed(stats: DataFrame) -> DataFrame:
    n = F.greatest(F.col("n_words"), F.lit(1))
    chars = F.greatest(F.col("word_chars"), F.lit(1))
    made = {
        "log_words": F.log(n),
        "log_word_chars": F.log(chars / n),
        "root_symbols": F.sqrt(F.col("n_symbols") / chars),
        "root_dup_lines": F.sqrt(F.col("n_dup_lines") / F.col("n_lines")),
        "root_repeats": F.sqrt(F.col("n_repeat_words") / n),
    }
    name = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit(""))
    return stats.withColumns(made).withColumns(
        {"lang_group": name("lang"), "fine_group": F.to_json(F.array(name("lang"), name("source")))}
    )


def chi2_cdf(x: float, k: float) -> float:
    """P(chi-square with k degrees <= x), by the series of the lower incomplete gamma."""
    if x <= 0:
        return 0.0
    a, half = k / 2, x / 2
    term = total = 1 / a
    n = 0
    while term > total * 1e-15:
        n += 1
        term *= half / (a + n)
        total += term
    return min(1.0, total * math.exp(-half + a * math.log(half) - math.lgamma(a)))


def chi2_quantile(p: float, k: float) -> float:
    low, high = 0.0, 1.0
    while chi2_cdf(high, k) < p and high < 1e4:
        high *= 2
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_cdf(mid, k) < p else (low, mid)
    return high


def _inverse_factor(moments: DataFrame, scale: float) -> DataFrame:
    """``moments`` with means m_j, the inverse Cholesky factor f_jk of each group's covariance and
    its log_det.

    The covariance is scaled to be consistent for Gaussian groups and gets the floors on its
    diagonal. One small row a group, step by step so that no expression grows.
    """
    d = len(_Z)
    lower = [(j, k) for j in range(d) for k in range(j + 1)]
    out = moments.withColumns({f"m{j}": F.col(f"s{j}") / F.col("n") for j in range(d)})
    made = {}
    for j, k in lower:
        cov = scale * (F.col(f"s{j}_{k}") / F.col("n") - F.col(f"m{j}") * F.col(f"m{k}"))
        made[f"c{j}_{k}"] = cov + F.lit(FLOORS[_Z[j]] ** 2 if j == k else 0.0)
    out = out.withColumns(made)

    def rest(j: int, k: int) -> Column:
        """c_jk less what the columns before k account for."""
        value = F.col(f"c{j}_{k}")
        for i in range(k):
            value = value - F.col(f"l{j}_{i}") * F.col(f"l{k}_{i}")
        return value

    for k in range(d):
        # Rounding can push a variance that is all floor slightly below it.
        least = F.lit(FLOORS[_Z[k]] ** 2 / 4)
        out = out.withColumn(f"l{k}_{k}", F.sqrt(F.greatest(rest(k, k), least)))
        below = {f"l{j}_{k}": rest(j, k) / F.col(f"l{k}_{k}") for j in range(k + 1, d)}
        out = out.withColumns(below) if below else out
    for off in range(d):  # the inverse, diagonal by diagonal
        made = {}
        for j in range(off, d):
            k = j - off
            total = F.lit(0.0)
            for i in range(k, j):
                total = total + F.col(f"l{j}_{i}") * F.col(f"f{i}_{k}")
            made[f"f{j}_{k}"] = (-total if off else F.lit(1.0)) / F.col(f"l{j}_{j}")
        out = out.withColumns(made)
    names = [f"m{j}" for j in range(d)] + [f"f{j}_{k}" for j in range(d) for k in range(j + 1)]
    log_det = sum((-2 * F.log(F.col(f"f{j}_{j}")) for j in range(d)), F.lit(0.0))
    return out.select(*moments.columns, *names, log_det.alias("log_det"))


def _distance() -> Column:
    """Squared Mahalanobis distance: a triangular product with the cached inverse factor."""
    d2 = F.lit(0.0)
    for j in range(len(_Z)):
        z = F.lit(0.0)
        for k in range(j + 1):
            z = z + F.col(f"f{j}_{k}") * (F.col(_Z[k]) - F.col(f"m{k}"))
        d2 = d2 + z * z
    return d2


def _moments(rows: DataFrame) -> DataFrame:
    sums = [F.sum(_Z[j]).alias(f"s{j}") for j in range(len(_Z))]
    sums += [
        F.sum(F.col(_Z[j]) * F.col(_Z[k])).alias(f"s{j}_{k}")
        for j in range(len(_Z))
        for k in range(j + 1)
    ]
    return rows.groupBy("grp", "start").agg(F.count(F.lit(1)).alias("n"), *sums)


def _core(rows: DataFrame, d2: Column, core: float, prior: int, groups: int) -> DataFrame:
    """The rows nearest to the centre of each group, whole bins of them.

    They are the ``core`` share of the group and its ``prior`` documents, less those: an outlier
    in a group of few is not in it. The bin is found from counts by bin: added before the
    shuffle, the same on every run.
    """
    binned = rows.withColumn("bin", F.floor(F.log2(d2 + F.lit(1e-6)) * _BINS).cast("int"))
    counts = binned.groupBy("grp", "start", "bin").agg(F.count(F.lit(1)).alias("n"))
    up = Window.partitionBy("grp", "start").orderBy("bin")
    all_of = Window.partitionBy("grp", "start")
    lent = F.when(F.col("grp.level") > 0, F.lit(prior)).otherwise(F.lit(0))  # all have no parent
    need = F.ceil(core * (F.sum("n").over(all_of) + lent)) - lent
    edge = (
        counts.withColumn("upto", F.sum("n").over(up))
        .withColumn("need", need)
        .filter((F.col("upto") - F.col("n") < F.col("need")) & (F.col("need") > 0))
        .groupBy("grp", "start")
        .agg(F.max("bin").alias("edge"))
    )
    return binned.join(_sent(edge, groups), ["grp", "start"]).filter(F.col("bin") <= F.col("edge"))


def _sent(small: DataFrame, groups: int) -> DataFrame:
    """One row for each of ``groups`` groups, sent to every task if they stay below
    ``SMALL_BYTES``: then a group that holds a third of the documents is not gathered in one."""
    row_bytes = 16 + 40 * len(small.columns)
    return F.broadcast(small) if groups * row_bytes <= SMALL_BYTES else small


def _medians(rows: DataFrame, values: dict[str, Column]) -> DataFrame:
    """(grp, one column a value): medians to 1/64, from counts by bin."""
    pairs = F.explode(
        F.array(*[F.struct(F.lit(k).alias("k"), v.alias("v")) for k, v in values.items()])
    )
    bins = rows.select("grp", pairs.alias("x")).groupBy(
        "grp", F.col("x.k").alias("k"), F.floor(F.col("x.v") * 64).alias("bin")
    ).agg(F.count(F.lit(1)).alias("n"))
    up = Window.partitionBy("grp", "k").orderBy("bin")
    all_of = Window.partitionBy("grp", "k")
    mid = (
        bins.withColumn("upto", F.sum("n").over(up))
        .withColumn("all", F.sum("n").over(all_of))
        .filter(2 * F.col("upto") >= F.col("all"))
        .groupBy("grp", "k")
        .agg(((F.min("bin") + 0.5) / 64).alias("v"))
    )
    return mid.groupBy("grp").agg(
        *[F.max(F.when(F.col("k") == k, F.col("v"))).alias(k) for k in values]
    )


def levels(rows: DataFrame) -> DataFrame:
    """Rows (lang_group, fine_group, statistics) once for each group they are in: all documents,
    those of the language, those of the language and source. ``grp`` is (level, name)."""
    member = lambda level, name: F.struct(F.lit(level).alias("level"), name.alias("name"))
    groups = F.array(
        member(0, F.lit("")), member(1, F.col("lang_group")), member(2, F.col("fine_group"))
    )
    return rows.select(F.explode(groups).alias("grp"), *_Z)


def _leaning(own: DataFrame, parents: DataFrame, prior: int) -> DataFrame:
    """Sums of every group that count ``prior`` documents like its parent's beside its own.

    ``own`` holds sums by ``grp`` and ``start``, ``parents`` each group and the name of its parent.
    A few rows a group; the languages and the whole are few.
    """
    starts = F.explode(F.array(*map(F.lit, _STARTS))).alias("start")
    every = parents.select("grp", "parent", starts).join(own, ["grp", "start"], "left")
    every = every.withColumns({c: F.coalesce(F.col(c), F.lit(0.0)) for c in _SUMS})
    done = above = every.filter("grp.level = 0").drop("parent")
    for level in (1, 2):
        share = above.select(
            F.col("grp.name").alias("parent"), "start",
            *[(prior * F.col(c) / F.col("n")).alias(f"p_{c}") for c in _SUMS],
        )
        here = every.filter(F.col("grp.level") == level).join(share, ["parent", "start"])
        above = here.select("grp", "start", *[(F.col(c) + F.col(f"p_{c}")).alias(c) for c in _SUMS])
        done = done.unionByName(above)
    return done


def robust_estimates(
    rows: DataFrame, parents: DataFrame, core: float = CORE, steps: int = STEPS, prior: int = PRIOR
) -> DataFrame:
    """Minimum-covariance-determinant estimates (means, inverse factor) of each ``grp``.

    ``rows`` is from :func:`levels`, ``parents`` names each group's parent. All groups of all levels
    are worked out side by side, from two starts each: distances by medians and median
    deviations, or by the mean and covariance of the whole group. Each takes ``steps``
    concentration steps: distances under the current estimate, the nearest documents (``_core``),
    their sums; then the start with the smaller determinant is taken. An estimate counts ``prior``
    documents like the parent's beside the group's own, so a small group is close to its parent and
    a group of any size has an estimate. A step is two grouped sums over narrow rows and leaves
    small tables, a row a group and start, in the shared folder.
    """
    d = len(_Z)
    scale = core / chi2_cdf(chi2_quantile(core, d), d + 2)
    mid = settle(_medians(rows, {f"m{j}": F.col(_Z[j]) for j in range(d)}), "medians")
    groups = mid.count()
    off = rows.join(_sent(mid, groups), "grp")
    dev = settle(
        _medians(off, {f"d{j}": F.abs(F.col(_Z[j]) - F.col(f"m{j}")) for j in range(d)}), "deviations"
    )
    by_median = F.lit(0.0)
    for j in range(d):
        spread = F.greatest(1.4826 * F.col(f"d{j}"), F.lit(FLOORS[_Z[j]]))
        by_median = by_median + ((F.col(_Z[j]) - F.col(f"m{j}")) / spread) ** 2

    def estimate_of(subset: DataFrame, scale: float) -> DataFrame:
        own = settle(_moments(subset), "sums")
        # Written sums again: the factor's steps then stand on a short plan.
        leaning = settle(_leaning(own, parents, prior), "leaning-sums")
        return settle(_inverse_factor(leaning, scale), "estimate")

    start = F.explode(F.array(*map(F.lit, _STARTS))).alias("start")
    both = rows.select("grp", *_Z, start)
    plain = estimate_of(both, 1.0)
    first = (
        off.join(_sent(dev, groups), "grp")
        .select("grp", *_Z, by_median.alias("by_median"), start)
        .join(_sent(plain.drop(*_SUMS, "log_det"), 2 * groups), ["grp", "start"])
    )
    d2 = F.when(F.col("start") == _STARTS[0], F.col("by_median")).otherwise(_distance())
    estimate = estimate_of(_core(first, d2, core, prior, 2 * groups), scale)
    for _ in range(steps):
        at = both.join(_sent(estimate.drop(*_SUMS, "log_det"), 2 * groups), ["grp", "start"])
        estimate = estimate_of(_core(at, _distance(), core, prior, 2 * groups), scale)
    values = [c for c in estimate.columns if c not in ("grp", "start", *_SUMS)]
    least = estimate.groupBy("grp").agg(
        F.min_by(F.struct(*values), F.struct("log_det", "start")).alias("best")
    )
    return settle(least.select("grp", "best.*"), "estimate")


def judge(
    docs: DataFrame,
    core: float = CORE,
    tail: float = TAIL,
    steps: int = STEPS,
    prior: int = PRIOR,
) -> DataFrame:
    """doc_id, the base statistics, base_failed, distance and kept, one row for each row.

    A group is a language and a source (null is a group value of its own). Its estimate counts
    ``prior`` documents like its language's, whose estimate counts as many like all documents':
    a group of any size has a centre and a spread, and every document that passes the base rules
    a distance. Documents farther than the chi-square quantile of 1 - ``tail`` from their
    group's robust centre are rejected. Statistics cover all documents; the estimates rest on
    those that pass the base rules. Repeated rows count each time; an empty table gives no rows.
    """
    stats = settle(_transformed(text_statistics(docs)), "statistics")
    passed = stats.filter(~F.col("base_failed")).select("lang_group", "fine_group", *_Z)
    families = settle(passed.select("lang_group", "fine_group").distinct(), "families")
    named = lambda level, name: F.struct(F.lit(level).alias("level"), name.alias("name"))
    pair = F.explode(
        F.array(
            F.struct(named(0, F.lit("")).alias("grp"), F.lit(None).cast("string").alias("parent")),
            F.struct(named(1, F.col("lang_group")).alias("grp"), F.lit("").alias("parent")),
            F.struct(named(2, F.col("fine_group")).alias("grp"), F.col("lang_group").alias("parent")),
        )
    )
    parents = settle(families.select(pair.alias("x")).select("x.*").distinct(), "parents")
    estimate = robust_estimates(levels(passed), parents, core, steps, prior)
    distance = F.when(~F.col("base_failed"), _distance())
    limit = chi2_quantile(1 - tail, len(_Z))
    fine = estimate.filter("grp.level = 2").withColumn("fine_group", F.col("grp.name"))
    known = _sent(fine.drop("grp", "log_det"), families.count())
    return (
        stats.join(known, "fine_group", "left")
        .withColumn("distance", distance)
        .select(
            "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
            "base_failed", "distance",
            (~F.col("base_failed") & (F.col("distance") <= limit)).alias("kept"),
        )
    )
