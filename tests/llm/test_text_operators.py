"""Line dedup, Jaccard join, substring dedup, rules and classifier against brute force."""

from __future__ import annotations

import hashlib
import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from rowsieve.llm import jaccard_join, line_dedup, outlier_rules, quality_qda, substring_dedup
from rowsieve.llm.common import connected_components
from tests.llm import corpus


@pytest.fixture(scope="module")
def data():
    return corpus.rows()


@pytest.fixture(scope="module")
def docs(spark, data):
    return corpus.frame(spark, data).cache()


@pytest.mark.parametrize("lg_k, near", [(12, 0.1), (4, 0.9)])
def test_lines_on_many_sites_stay_once(docs, data, lg_k, near):
    # A coarse sketch with a wide margin leaves the choice to the exact counts.
    got = line_dedup.dedup_lines(docs, min_sites=5, lg_k=lg_k, near=near).collect()
    want = corpus.boilerplate_kept(data, 5, 1)
    assert {r["doc_id"]: r["text"] for r in got} == want
    assert sum(r["n_removed"] for r in got) > 30
    by_id = {r[0]: r for r in data}
    for r in got:
        assert r["line"] == "line" and r["pos"] == 1
        text = by_id[r["doc_id"]][1]
        assert r["n_lines"] == (0 if text is None else text.count("\n") + 1)


def test_rows_travel_whole_whatever_their_columns_are_called(spark, docs, data):
    clash = ["removed_at", "removed_doc", "row_hash", "its_hash", "row_id", "row", "first", "head_id", "text_hash", "a.b"]
    wide = docs.select("*", *[F.lit(f"kept {c}").alias(c) for c in clash])
    links = jaccard_join.jaccard_links(wide)
    for got in (line_dedup.dedup_lines(wide, min_sites=5), jaccard_join.keep_one(wide, links)):
        assert got.columns[: len(wide.columns)] == wide.columns
        rows = got.collect()
        assert rows and all(r[c] == f"kept {c}" for r in rows for c in clash)
    got = line_dedup.dedup_lines(wide, min_sites=5)
    assert {r["doc_id"]: r["text"] for r in got.collect()} == corpus.boilerplate_kept(data, 5, 1)


def test_different_texts_under_one_id_stay(spark):
    data = [(1, "one text of its own", "en", "a", 0), (1, "another text here too", "en", "a", 0),
            (1, "one text of its own", "en", "b", 0), (2, "one text of its own", "en", "a", 0)]
    docs = corpus.frame(spark, data)
    kept = jaccard_join.keep_one(docs, jaccard_join.jaccard_links(docs)).collect()
    assert sorted((r["doc_id"], r["text"]) for r in kept) == [(1, data[1][1]), (1, data[0][1])]


def test_line_dedup_repeated_rows_and_empty_table(spark, docs, data):
    twice = line_dedup.dedup_lines(docs.unionByName(docs), min_sites=5).collect()
    once = corpus.boilerplate_kept(data, 5, 1)
    assert len(twice) == 2 * len(data)
    assert {(r["doc_id"], r["text"]) for r in twice} == set(once.items())
    assert line_dedup.dedup_lines(docs.limit(0)).count() == 0


def test_short_lines_on_many_sites_go_in_the_pipeline(spark):
    data = [(i, f"its own line {i}\nAll rights reserved.\n }} \n\nfew {i % 3}", "en", f"s{i}", 0) for i in range(12)]
    got = corpus_pipeline.lines(spark, corpus.frame(spark, data), "").collect()
    want = corpus.boilerplate_kept(data, line_dedup.MIN_SITES, 1)
    assert {r["doc_id"]: r["text"] for r in got} == want
    assert want[1] == "its own line 1\n\nfew 1"


@pytest.mark.parametrize("block", [256, 3])
def test_near_duplicates_by_all_pairs(docs, data, block):
    got = jaccard_join.jaccard_links(docs, block=block, task_grams=500).collect()
    links, classes = corpus.near_links(data)
    assert len(got) == len(data)
    assert {r["doc_id"]: r["n_links"] for r in got} == {r[0]: links[r[0]] for r in data}
    assert {r["doc_id"]: r["class_id"] for r in got} == classes


def test_one_of_each_class_stays(spark, docs, data):
    doubled = docs.unionByName(docs).unionByName(docs.limit(1).withColumn("doc_id", F.lit(None).cast("long")))
    kept = jaccard_join.keep_one(doubled, jaccard_join.jaccard_links(doubled))
    ids = [r["doc_id"] for r in kept.collect()]
    _, classes = corpus.near_links(data)
    assert sorted(i for i in ids if i is not None) == sorted(set(classes.values()))
    assert ids.count(None) == 1
    assert kept.columns == docs.columns
    assert jaccard_join.jaccard_links(docs.limit(0)).count() == 0


def test_bands_reach_the_recall():
    bands, rows = jaccard_join.choose_bands(0.8, 0.9999, 128)
    assert bands * rows <= 128 and 1 - (1 - 0.8**rows) ** bands >= 0.9999
    with pytest.raises(ValueError):
        jaccard_join.choose_bands(0.05, 0.9999, 16)


@pytest.mark.parametrize("width", [5, 8])
def test_grams_of_a_run_with_few_words(width):
    rng = np.random.default_rng(7)
    for n in range(width + 2):
        few = rng.integers(-(2**62), 2**62, n)
        alone = jaccard_join.gram_sets(few, np.array([0, n]), width)[0]
        behind = np.concatenate([few, rng.integers(-(2**62), 2**62, 40)])
        assert alone.tolist() == jaccard_join.gram_sets(behind, np.array([0, n, n + 40]), width)[0].tolist()
        assert len(alone) == (max(1, n - width + 1) if n else 0)


def test_a_short_row_behind_a_slice():
    lists = [[*range(40)], [7, 8, 9], [], [*range(50, 90)], [5, 6, 7]]
    batch = pa.record_batch([pa.array(lists, pa.list_(pa.int64()))], ["w"])
    runs = list(jaccard_join._slices(batch, most=20))
    assert [len(flat) for _, _, flat, _ in runs] == [40, 3, 40, 3]
    sets = [s for _, _, flat, at in runs for s in jaccard_join.gram_sets(flat, at)]
    assert [len(s) for s in sets] == [36, 1, 0, 36, 1]


def test_a_table_of_three_words(spark):
    docs = spark.createDataFrame([(4, "a b c")], "doc_id long, text string")
    got = [tuple(r) for r in jaccard_join.jaccard_links(docs).collect()]
    assert got == [(4, 4, 4, 0)]


def test_set_products_in_strips():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 60, 40).astype(np.uint64)) for _ in range(9)]
    linked = jaccard_join.links_inside(sets, 0.4)
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            both = len(np.intersect1d(a, b))
            assert linked[i, j] == (i != j and both >= 0.4 * (len(a) + len(b) - both))
    assert (jaccard_join.links_inside(sets, 0.4, 4) == linked[:4, 4:]).all()


def test_components(spark):
    rng = random.Random(5)
    pairs = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)]
    pairs += [(i, i + 1) for i in range(300, 340)] + [(7, 7), (None, 3)]
    got = connected_components(spark.createDataFrame(pairs, "a long, b long"), "a", "b", "t").collect()
    parent = list(range(400))

    def top(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a, b in pairs:
        if a is not None and b is not None:
            parent[max(top(a), top(b))] = min(top(a), top(b))
    assert got and len({r["node"] for r in got}) == len(got)
    assert all(r["component"] == top(r["node"]) for r in got)


@pytest.mark.parametrize("hot_runs", [512, 2])
def test_substrings_by_all_windows(docs, data, hot_runs):
    got = {r["doc_id"]: r for r in substring_dedup.dedup_substrings(docs, hot_runs=hot_runs).collect()}
    gone = corpus.repeated_words(data)
    assert len(got) == len(data) and sum(map(sum, gone.values())) > 500
    for i, text, *_ in data:
        w = corpus.words(text)
        kept = " ".join(x for x, g in zip(w, gone[i]) if not g)
        r = got[i]
        assert (r["n_words"], r["n_removed"]) == (len(w), sum(gone[i]))
        assert r["kept_sha256"] == hashlib.sha256(kept.encode()).hexdigest()
        assert sum(s["to"] - s["from"] for s in r["removed"]) == r["n_removed"]


def test_substrings_odd_tables(spark, docs, data):
    gone = corpus.repeated_words(data)
    nameless = docs.withColumn("doc_id", F.when(F.col("doc_id") > 150, F.col("doc_id")))
    rows = substring_dedup.dedup_substrings(docs.unionByName(docs)).collect()
    assert sorted((r["doc_id"], r["n_removed"]) for r in rows) == sorted(2 * [(i, sum(g)) for i, g in gone.items()])
    for r in substring_dedup.dedup_substrings(nameless).collect():
        assert r["doc_id"] is not None or r["n_removed"] == 0
    assert substring_dedup.dedup_substrings(docs.limit(0)).count() == 0
    kept = substring_dedup.kept_texts(docs, substring_dedup.dedup_substrings(docs)).collect()
    for r in kept:
        w = next(x[1] for x in data if x[0] == r["doc_id"])
        assert r["text"].split() == [x for x, g in zip(corpus.words(w), gone[r["doc_id"]]) if not g] or "\xa0" in w


def test_equal_rolling_hashes_are_told_apart(monkeypatch):
    monkeypatch.setattr(substring_dedup, "_mix", lambda h: h * np.uint64(0))
    got = substring_dedup.first_documents([b"a b c", b"b c d", b"a b d"], np.array([5, 3, 4]), 2)
    assert [g.tolist() for g in got] == [[4, 3], [3, 3], [4, 4]]


def test_base_rules_word_for_word(docs, data):
    got = {r["doc_id"]: r for r in outlier_rules.judge(docs).collect()}
    assert len(got) == len(data)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    for i, text, *_ in data:
        want = corpus.base_statistics(text)
        assert tuple(got[i][c] for c in names) == want
        assert got[i]["base_failed"] == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        # However few rows a group has, a document past the base rules has a distance.
        assert (got[i]["distance"] is None) == got[i]["base_failed"]
        assert not (got[i]["kept"] and got[i]["base_failed"])
    assert outlier_rules.judge(docs.limit(0)).count() == 0


def _clean(rng, n, source=lambda i: "a" if i % 2 else None):
    return [(i, corpus.sentence(rng, rng.randint(40, 160)), "en", source(i), 0) for i in range(n)]


def test_outliers_of_a_group_are_rejected(spark):
    rng = random.Random(11)
    clean = _clean(rng, 600)
    junk = [
        (1000 + i, " ".join(w + "$$$" for w in corpus.sentence(rng, 80).split()), "en", "a", 0) for i in range(30)
    ]
    judged = outlier_rules.judge(corpus.frame(spark, clean + junk)).collect()
    kept = {r["doc_id"] for r in judged if r["kept"]}
    assert kept == set(range(600))


def test_outliers_of_small_groups_are_rejected(spark):
    rng = random.Random(12)
    clean = _clean(rng, 120, lambda i: f"s{i // 4}")  # four documents a source
    symbols = " ".join(w + "$$$" for w in corpus.sentence(rng, 80).split())
    words = " ".join(corpus.sentence(rng, 1) * 9 for _ in range(60))
    junk = [(1000, symbols, "en", "s0", 0), (1001, symbols, "en", "alone", 0), (1002, symbols, None, None, 0),
            (1003, words, "en", "s5", 0)]
    judged = {r["doc_id"]: r for r in outlier_rules.judge(corpus.frame(spark, clean + junk)).collect()}
    assert {i for i, r in judged.items() if r["kept"]} == set(range(120))


def test_each_statistic_can_reject_by_itself(spark):
    rng = random.Random(13)
    clean = _clean(rng, 300, lambda i: "a")
    lines = [corpus.sentence(rng, 4) for _ in range(15)]
    doubled = "\n".join(rng.sample(lines, 15) + rng.sample(lines, 13))  # 13 of 28 lines, few long windows
    short = corpus.sentence(rng, 9)  # stands twice: 18 of 88 words, 1 of 9 lines
    twice = "\n".join([short, *[corpus.sentence(rng, 10) for _ in range(7)], short])
    symbols = " ".join(w + "$" for w in corpus.sentence(rng, 90).split())
    words = " ".join(corpus.sentence(rng, 1) * 9 for _ in range(60))
    length = corpus.sentence(rng, 20_000)
    rows = [(900 + i, t, "en", "a", 0) for i, t in enumerate((doubled, symbols, words, length, twice))]
    judged = {r["doc_id"]: r for r in outlier_rules.judge(corpus.frame(spark, clean + rows)).collect()}
    for i in range(900, 904):
        assert not judged[i]["base_failed"] and not judged[i]["kept"], judged[i]
    assert judged[904]["kept"] and judged[904]["n_repeat_words"] == 18, judged[904]
    assert sum(judged[i]["kept"] for i in range(300)) == 300


def test_no_spread_and_repeated_rows(spark):
    text = corpus.sentence(random.Random(14), 60)
    rows = [(i, text, "en", "a", 0) for i in range(40)] + [(7, text, "en", "a", 0)] * 5
    judged = outlier_rules.judge(corpus.frame(spark, rows)).collect()
    assert len(judged) == 45 and all(r["kept"] and r["distance"] < 1e-6 for r in judged)


def _plain_mcd(groups, parents, prior, core, steps):
    """The estimates in numpy, with the same whole bins: groups by (level, name)."""
    names = list(outlier_rules.FLOORS)
    floors = np.array([outlier_rules.FLOORS[z] for z in names])
    d = len(names)
    scale = core / outlier_rules.chi2_cdf(outlier_rules.chi2_quantile(core, d), d + 2)

    def median(v):
        bins = np.sort(np.floor(v * 64))
        return (bins[-(-len(bins) // 2) - 1] + 0.5) / 64

    def sums(x):
        return np.array([len(x)], float), x.sum(axis=0), x.T @ x

    def leaning(own):
        out = {}
        for g in sorted(own):  # by level
            out[g] = own[g]
            if g[0]:
                p = out[(g[0] - 1, parents[g])]
                out[g] = tuple(a + prior * b / p[0][0] for a, b in zip(own[g], p))
        return out

    def factor(m, scale):
        mean = m[1] / m[0]
        return mean, scale * (m[2] / m[0] - np.outer(mean, mean)) + np.diag(floors**2)

    def distances(x, mean, cov):
        return np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(cov), x - mean)

    def nearest(g, x, d2):
        lent = prior if g[0] else 0
        need = math.ceil(core * (len(x) + lent)) - lent
        bins = np.floor(np.log2(d2 + 1e-6) * 16)
        return x[bins <= np.sort(bins)[need - 1]] if need > 0 else x[:0]

    found = []
    plain = leaning({g: sums(x) for g, x in groups.items()})
    for start in (0, 1):
        first = {}
        for g, x in groups.items():
            mid = np.array([median(x[:, j]) for j in range(d)])
            dev = np.array([median(abs(x[:, j] - mid[j])) for j in range(d)])
            by_median = (((x - mid) / np.maximum(1.4826 * dev, floors)) ** 2).sum(axis=1)
            first[g] = distances(x, *factor(plain[g], 1.0)) if start else by_median
        now = leaning({g: sums(nearest(g, x, first[g])) for g, x in groups.items()})
        for _ in range(steps):
            now = leaning({
                g: sums(nearest(g, x, distances(x, *factor(now[g], scale)))) for g, x in groups.items()
            })
        found.append({g: factor(m, scale) for g, m in now.items()})
    return {g: min((f[g] for f in found), key=lambda e: np.linalg.slogdet(e[1])[1]) for g in groups}


def test_estimates_by_numpy(spark):
    rng = np.random.default_rng(2)
    names = list(outlier_rules.FLOORS)
    base, far = rng.normal(0, 1, (900, 5)), rng.normal(9, 1, (180, 5))
    parts = {("en", "big"): base[:600], ("en", "few"): base[600:612] * 2, ("en", "one"): far[:1],
             ("de", "far"): np.concatenate([base[612:], far[1:]]), ("de", "same"): base[:1].repeat(30, axis=0)}
    schema = "lang_group string, fine_group string, " + ", ".join(f"{z} double" for z in names)
    made = [(lang, f"{lang}/{s}", *map(float, r)) for (lang, s), x in parts.items() for r in x]
    rows = outlier_rules.levels(spark.createDataFrame(made, schema))
    groups, parents = {(0, ""): np.concatenate(list(parts.values()))}, {(0, ""): None}
    for (lang, s), x in parts.items():
        groups[(1, lang)] = np.concatenate([groups.get((1, lang), x[:0]), x])
        groups[(2, f"{lang}/{s}")] = x
        parents |= {(1, lang): "", (2, f"{lang}/{s}"): lang}
    named = spark.createDataFrame(
        [(g, p) for g, p in parents.items()], "grp struct<level: int, name: string>, parent string"
    )
    got = {tuple(r["grp"]): r for r in outlier_rules.robust_estimates(rows, named, steps=2).collect()}
    want = _plain_mcd(groups, parents, outlier_rules.PRIOR, outlier_rules.CORE, 2)
    assert set(got) == set(want)
    for g, (mean, cov) in want.items():
        factor = np.zeros((5, 5))
        for j in range(5):
            assert got[g][f"m{j}"] == pytest.approx(mean[j], abs=1e-9)
            for k in range(j + 1):
                factor[j, k] = got[g][f"f{j}_{k}"]
        assert np.allclose(np.linalg.inv(factor.T @ factor), cov, rtol=1e-6, atol=1e-9)
    # A sixth of the rows lie far off: the centre stays with the others.
    assert abs(want[(0, "")][0]).max() < 0.3


def test_chi_square_tables():
    assert abs(outlier_rules.chi2_quantile(0.95, 5) - 11.0705) < 1e-3
    assert abs(outlier_rules.chi2_cdf(4.35146, 5) - 0.5) < 1e-5


def _labelled(rng):
    good = [(i, corpus.sentence(rng, rng.randint(20, 90)), None, None, 0) for i in range(400)]
    junk = [(400 + i, " ".join(rng.choice("ab") + "##" for _ in range(60)), None, None, 0) for i in range(200)]
    return good + junk, [(r[0], int(r[0] < 400), 0) for r in good + junk]


def test_classifier_on_held_out_rows(spark):
    data, labels = _labelled(random.Random(4))
    data += [(9001, None, None, None, 0), (9002, "", None, None, 0), (None, "a", None, None, 0)]
    taught = spark.createDataFrame(labels + [(1, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = quality_qda.scored(corpus.frame(spark, data), taught).collect()
    assert len(got) == len(data)
    truth = {i: q for i, q, _ in labels}
    held = [r for r in got if r["held_out"]]
    assert 100 < len(held) < 200
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in held if r["doc_id"] in truth]) > 0.98
    for r in got:
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7)
        assert r["kept_row"]["score"] == 0.5
    # Labels of held-out rows, languages and sources change nothing.
    zlib = __import__("zlib")
    lied = [(i, 1 - q if zlib.crc32(str(i).encode()) % 4 == 2 else q, t) for i, q, t in labels]
    moved = corpus.frame(spark, [(i, t, "xx", "yy", 0) for i, t, *_ in data])
    again = quality_qda.scored(moved, spark.createDataFrame(lied, "doc_id long, quality int, toxic int")).collect()
    assert sorted((str(r["doc_id"]), round(r["score"], 9)) for r in again) == sorted(
        (str(r["doc_id"]), round(r["score"], 9)) for r in got
    )


def test_classifier_without_labels(spark, docs):
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r["score"] for r in quality_qda.scored(docs, empty).collect()} == {0.5}
    assert quality_qda.scored(docs.limit(0), empty).count() == 0


def test_discriminant_is_the_gaussian_log_ratio(spark):
    rng = np.random.default_rng(0)
    d = len(quality_qda.STATISTICS)
    x = [rng.normal(0, 1, (300, d)), rng.normal(0.5, 1.5, (500, d))]
    rows = spark.createDataFrame([(c, r.tolist()) for c in (0, 1) for r in x[c]], "q int, x array<double>")
    model = quality_qda.fit(rows, "q", to_pooled=0, to_sphere=0, least=0)
    probe = rng.normal(0, 1, (5, d))
    want = []
    for c in (0, 1):
        mean, cov = x[c].mean(axis=0), np.cov(x[c].T, bias=True)
        z = probe - mean
        want.append(-0.5 * (np.einsum("ij,jk,ik->i", z, np.linalg.inv(cov), z) + np.linalg.slogdet(cov)[1]))
    margin = (want[1] - want[0] + np.log(500 / 300)) / d**0.5
    assert np.allclose(model.score(probe), 1 / (1 + np.exp(-margin)))
