"""Line dedup: lines spread over many sites are boilerplate and stay in one place only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowsieve.llm.common import words
from rowsieve.session import settle

#: A line on at least so many distinct sites is boilerplate.
MIN_SITES = 10
#: log2 of the sketch's registers (relative error 1.04 / sqrt(2 ** LG_K) = 1.6 %).
LG_K = 12
#: Estimates within this share of the threshold are counted exactly; six errors wide.
NEAR = 0.1
_BLANKS = " \t\n\r\x0b\x0c"
_KEY = ["line_a", "line_b"]


def _row(prefix: str = "") -> list[Column]:
    """What tells rows apart: the id and, for repeated ids, the text."""
    return [F.col("doc_id"), F.xxhash64("doc_id", "text").alias("row_hash")]


def line_table(docs: DataFrame, site: str = "source", min_words: int = 1) -> DataFrame:
    """(doc_id, row_hash, site, pos, line_a, line_b) for each line long enough to count.

    Lines are compared without the white space around them, by two independent hashes (96 bits).
    """
    lines = docs.select(
        *_row(),
        F.xxhash64(site).alias("site"),
        F.posexplode(F.split("text", "\n")).alias("pos", "line"),
    )
    line = F.btrim("line", F.lit(_BLANKS))
    return lines.filter(F.size(words(F.col("line"))) >= min_words).select(
        "doc_id", "row_hash", "site", "pos",
        F.xxhash64(line).alias("line_a"), F.hash(line).alias("line_b"),
    )


def boilerplate(
    lines: DataFrame, min_sites: int = MIN_SITES, lg_k: int = LG_K, near: float = NEAR
) -> DataFrame:
    """(line_a, line_b, first): boilerplate lines and the place where each is kept.

    One aggregation merges a HyperLogLog sketch of the sites for each line, combined before the
    shuffle, so a line in a third of all documents is one row a task. Clear cases are decided by
    the sketch; lines near the threshold are counted exactly, over distinct (line, site) pairs.
    """
    spread = settle(
        lines.groupBy(*_KEY).agg(
            F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(lg_k))).alias("sites"),
            F.min(F.struct("doc_id", "row_hash", "pos")).alias("first"),
            F.count(F.lit(1)).alias("n"),
        ).filter((F.col("sites") >= min_sites * (1 - near)) & (F.col("n") >= min_sites)),
        "line-spread",
    )
    clear = F.col("sites") > min_sites * (1 + near)
    edge = spread.filter(~clear).select(*_KEY)
    exact = (
        lines.select(*_KEY, "site").distinct()
        .join(edge, _KEY, "left_semi")
        .groupBy(*_KEY)
        .agg(F.count(F.lit(1)).alias("exact_sites"))
        .filter(F.col("exact_sites") >= min_sites)
        .select(*_KEY)
    )
    picked = spread.filter(~clear).join(exact, _KEY, "left_semi")
    return spread.filter(clear).unionByName(picked).select(*_KEY, "first")


def dedup_lines(
    docs: DataFrame,
    site: str = "source",
    min_sites: int = MIN_SITES,
    min_words: int = 1,
    lg_k: int = LG_K,
    near: float = NEAR,
) -> DataFrame:
    """``docs`` with boilerplate lines taken out of ``text``, and ``n_lines``, ``n_removed``.

    A boilerplate line stays where it comes first (smallest doc_id, then place), so a text that
    was copied to many sites is not lost everywhere. Rows keep all their columns; ``n_lines``
    and ``n_removed`` replace columns of those names. Every line that holds a word counts, unless
    ``min_words`` asks for more. Null texts stay null with 0 lines; a null
    site is one site of its own; rows with equal id and text are treated alike, as one place.

    Lines are joined to the boilerplate by hash, and only places of removed lines travel to the
    documents. A frequent line is split by adaptive skew handling: that join has no operator
    above it which needs a line's rows together.
    """
    lines = line_table(docs, site, min_words)
    bad = settle(boilerplate(lines, min_sites, lg_k, near), "boilerplate")
    hits = lines.drop("site").join(bad, _KEY)
    here = F.struct("doc_id", "row_hash", "pos")
    places = (
        hits.filter(~F.col("first").eqNullSafe(here))
        .groupBy("doc_id", "row_hash")
        .agg(F.collect_set("pos").alias("removed_at"))
    )
    # The row travels in one column, so names of its columns meet none of those made here.
    keep = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    rows = docs.select(F.struct(*[_column(c) for c in keep]).alias("row"))
    rows = rows.withColumns(
        {"row_id": F.col("row.doc_id"), "its_hash": F.xxhash64("row.doc_id", "row.text")}
    )
    same = (F.col("its_hash") == F.col("row_hash")) & F.col("row_id").eqNullSafe(F.col("doc_id"))
    joined = rows.join(places, same, "left")
    parts = F.split("row.text", "\n")
    kept = F.filter(parts, lambda line, i: ~F.array_contains(F.col("removed_at"), i))
    text = F.when(F.col("removed_at").isNull(), F.col("row.text")).otherwise(F.array_join(kept, "\n"))
    return joined.select(
        *[(text if c == "text" else F.col("row")[c]).alias(c) for c in keep],
        F.coalesce(F.size(parts), F.lit(0)).cast("long").alias("n_lines"),
        F.when(F.col("removed_at").isNull(), 0)
        .otherwise(F.size("removed_at"))
        .cast("long")
        .alias("n_removed"),
    )


def _column(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def oracle(min_sites: int = MIN_SITES, min_words: int = 1) -> str:
    """The same in SQL, with exact counts for every line."""
    return f"""
    WITH lines AS (
      SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line,
             generate_subscripts(string_split(text, chr(10)), 1) AS pos
      FROM documents),
    kept AS (
      SELECT doc_id, source, pos,
             trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS line
      FROM lines
      WHERE len(regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+')) >= {min_words}),
    bad AS (
      SELECT line, min({{'doc_id': doc_id, 'pos': pos}}) AS first
      FROM kept GROUP BY line HAVING count(DISTINCT source) >= {min_sites}),
    hit AS (
      SELECT doc_id, pos FROM kept JOIN bad USING (line)
      WHERE first.doc_id <> doc_id OR first.pos <> pos)
    SELECT d.doc_id, len(string_split(d.text, chr(10))) AS n_lines, coalesce(h.n, 0) AS n_removed,
           CASE WHEN h.n IS NULL THEN d.text ELSE coalesce(k.text, '') END AS text
    FROM documents d
    LEFT JOIN (SELECT doc_id, count(*) AS n FROM hit GROUP BY doc_id) h ON d.doc_id = h.doc_id
    LEFT JOIN (
      SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.pos) AS text
      FROM lines l ANTI JOIN hit ON l.doc_id = hit.doc_id AND l.pos = hit.pos
      GROUP BY l.doc_id) k ON d.doc_id = k.doc_id
    """
