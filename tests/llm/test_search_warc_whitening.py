"""Lexical search, WARC archives and whitening against brute force and round trips."""

from __future__ import annotations

import base64
import gzip
import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rowsieve.llm import lexical_search, warc, whitening
from tests.llm import corpus

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# --- lexical search ----------------------------------------------------------------------------


def plain_terms(text):
    return TERM.findall((text or "").translate(ASCII_LOWER))


def plain_search(docs, items, k):
    counts = [Counter(plain_terms(text)) for _, text in docs]
    sizes = [sum(c.values()) for c in counts]
    n_docs, n_terms = sum(s > 0 for s in sizes), sum(sizes)
    df = Counter(t for c in counts for t in c)
    out = []
    for item_id, text in items:
        asked = Counter(plain_terms(text))
        scored = []
        for (doc_id, _), c, n in zip(docs, counts, sizes):
            score = 0
            for t, r in asked.items():
                if c[t]:
                    m = 100 - 75 + (75 * n * n_docs) // n_terms
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    score += r * w * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m))
            if score > 0:
                scored.append((-score, doc_id is None, doc_id or 0))
        for rank, (minus, none, doc_id) in enumerate(sorted(scored)[:k], 1):
            out.append((item_id, rank, None if none else doc_id, -minus))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def searched():
    rng = random.Random(5)
    vocabulary = [corpus.sentence(rng, 1) for _ in range(60)] + ["Ñandú", "ÑANDÚ", "x2", "ßa"]
    draw = lambda n: " ".join(rng.choices(vocabulary, range(1, len(vocabulary) + 1), k=n))
    docs = [(i * 2, draw(rng.randint(1, 60))) for i in range(150)]
    docs += [(7, None), (9, ""), (11, " \t--\n"), (13, "Unique-TERM, once"), (15, docs[3][1].upper())]
    docs += [docs[0], docs[0], (None, docs[5][1]), (None, docs[5][1]), (301, draw(20_000))]
    rng.shuffle(docs)
    items = [(i, draw(rng.randint(1, 12))) for i in range(12)]
    items += [(50, "unique term unique"), (51, None), (52, "..."), (53, "nowhere"), (None, docs[2][1] or "x2")]
    items += [items[0], items[0][:1] + ("x2 x2",)]
    return docs, items


def frames(spark, docs, items):
    schema = "doc_id long, text string, item long, score long, slots string, rank string, n long"
    wide = [(*d, 1, 2, "s", "r", 3) for d in docs]
    asked = spark.createDataFrame([(*i, "d", 4) for i in items], "item_id long, text string, doc_id string, block long")
    return spark.createDataFrame(wide, schema).repartition(3, "doc_id"), asked


@pytest.mark.parametrize("k, postings, leaf, block", [(10, 10**6, 128, 8 << 20), (3, 100, 1, 400)])
def test_search_ranks_like_all_scores(spark, searched, k, postings, leaf, block):
    got = lexical_search.search(
        *frames(spark, *searched), k=k, shard_postings=postings, leaf=leaf, block_bytes=block
    )
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=repr) == plain_search(*searched, k)


def test_search_of_nothing(spark, searched):
    docs, items = frames(spark, *searched)
    assert lexical_search.search(docs.limit(0), items).count() == 0
    assert lexical_search.search(docs, items.limit(0)).count() == 0
    assert lexical_search.search(docs.filter("text = ''"), items).count() == 0


def test_range_maxima_and_skipped_documents():
    rng = np.random.default_rng(3)
    slots, docs = np.repeat(np.arange(5), 200), np.tile(np.arange(200), 5)
    impacts = rng.integers(1, 50, 1000)
    shard = lexical_search.Shard(list(range(200)), slots, docs, impacts)
    low = rng.integers(0, 199, 300)
    high = low + 1 + (rng.random(300) * (200 - low)).astype(int)
    base = rng.integers(0, 5, 300) * 200
    found = shard.maxima(base + low, base + high)
    for b, lo, hi, at in zip(base, low, high, found):
        assert b + lo <= at < b + hi and impacts[at] == impacts[b + lo : b + hi].max()
    # One document far above the rest: the bound lets the others go unscored.
    impacts[docs == 77] = 1000
    shard = lexical_search.Shard(list(range(200)), slots, docs, impacts)
    asked, scored = np.arange(5), []
    shard.maxima, inner = lambda a, b: (scored.append(1), inner(a, b))[1], shard.maxima
    heap: list = []
    shard.search(asked, np.ones(5, np.int64), heap, 1, leaf=1)
    assert heap == [(5000, -77)] and len(scored) <= 3


# --- WARC --------------------------------------------------------------------------------------


def digest(html):
    return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


def plain_captures(pages, min_bytes=0):
    key = lambda p: (p[0] is None, p[0] or 0, p[1] is None, p[1] or "")
    first, out = {}, []
    for page in sorted(pages, key=key):
        html = page[2] or ""
        size = len(html.encode())
        again = size >= min_bytes and html in first
        first.setdefault(html, page[0])
        out.append((page[0], size, digest(html), "revisit" if again else "response", first[html] if again else None))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def pages():
    rng = random.Random(8)
    made = [(i, f"http://host{i % 4}.example/p/{i}", corpus.sentence(rng, 30)) for i in range(30)]
    made += [(100 + i, f"http://copies.example/{i}", "the same page ñ") for i in range(25)]
    made += [
        (200, None, "no address"), (201, "http://a.example/x y\r\nWARC-Type: response", "broken address"),
        (202, "http://a.example", None), (203, "http://a.example/?q", ""), (None, "http://n.example/", "no id"),
        (None, None, "the same page ñ"), (204, "http://w.example/", "x\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n\r\n\r\n"),
        (205, "http://l.example/", "long é " * 60_000), (3, "http://host3.example/p/3", "other payload, same id"),
    ]
    made += [made[4], made[4], made[32]]
    return made


def page_frame(spark, pages):
    schema = "page_id long, url string, html string, sha string, copy string, first string, row_key string, uri string"
    return spark.createDataFrame([(*p, *"abcde") for p in pages], schema).repartition(3)


@pytest.mark.parametrize("min_bytes, hot", [(0, 1000), (16, 5)])
def test_archives_give_the_pages_back(spark, monkeypatch, pages, min_bytes, hot):
    monkeypatch.setattr(warc, "HOT_ROWS", hot)
    folder = warc.write_archives(page_frame(spark, pages), min_bytes=min_bytes, file_bytes=100_000)
    records = warc.read_archives(spark, folder)
    captures = warc.assemble(records)
    rows = captures.collect()
    assert len(rows) == len(pages) and records.count() == 3 * len(pages)
    assert all(r["n_requests"] == r["n_responses"] == r["n_metadata"] == 1 for r in rows)
    assert all(r["request"]["concurrent_to"] == r["capture_id"] == r["response"]["record_id"] for r in rows)
    assert warc.surplus(records, captures).count() == 0
    assert records.filter("kind <> 'revisit' AND NOT coalesce(digest_fits, true)").count() == 0
    got = warc.page_captures(captures)
    assert sorted(map(tuple, got.collect()), key=repr) == plain_captures(pages, min_bytes)
    # Every payload lies in the archive, byte for byte.
    stored = {bytes(r["response"]["payload"]).decode() for r in rows if r["response"]["kind"] == "response"}
    assert stored == {p[2] or "" for p in pages}
    assert all(not r["response"]["payload"] for r in rows if r["response"]["kind"] == "revisit")


def test_archives_of_no_page(spark, pages):
    folder = warc.write_archives(page_frame(spark, pages).limit(0))
    assert warc.page_captures(warc.assemble(warc.read_archives(spark, folder))).count() == 0


def test_file_is_plain_warc_whatever_its_packing(spark, tmp_path, pages):
    folder = warc.write_archives(page_frame(spark, pages[:3]).coalesce(1), str(tmp_path / "w"))
    whole = b"".join(gzip.decompress(f.read_bytes()) for f in (tmp_path / "w").glob("*.gz"))
    assert folder and whole.startswith(b"WARC/1.1\r\n") and whole.endswith(b"\r\n\r\n")
    records = [b"WARC/1.1\r\n" + r for r in whole.split(b"WARC/1.1\r\n")[1:]]
    by_record = b"".join(gzip.compress(r) for r in records)
    assert len(records) == 9
    want = [(h, b) for _, h, b in warc.parse_archive(whole)]
    assert [(h, b) for _, h, b in warc.parse_archive(by_record)] == want
    with pytest.raises(ValueError):
        list(warc.parse_archive(whole[:-60]))
    with pytest.raises(ValueError):
        list(warc.parse_archive(b"no record\r\n" + whole))


def test_records_without_partners_and_beyond_the_first(spark):
    names = [f.name for f in warc._ARROW]
    row = lambda at, kind, name, to=None: (
        "f", at, name, kind, to, None, "http://x", None, None, 1, "D", None, {"page-id": "5"}, None)
    made = [
        row(0, "warcinfo", "w"), row(1, "response", "r1"), row(2, "request", "q2", "r1"),
        row(3, "request", "q1", "r1"), row(4, "metadata", "m1", "r1"), row(5, "request", "q9", "gone"),
        row(6, "revisit", "v1"), row(7, "response", "r1"),
    ]
    records = spark.createDataFrame(made, warc.RECORD)
    assert records.columns == names
    captures = warc.assemble(records).cache()
    got = {r["capture_id"]: r for r in captures.collect()}
    assert set(got) == {"r1", "gone", "v1"}
    assert (got["r1"]["request"]["record_id"], got["r1"]["n_requests"], got["r1"]["n_responses"]) == ("q1", 2, 2)
    assert got["gone"]["response"] is None and got["gone"]["request"]["record_id"] == "q9"
    assert got["v1"]["response"]["kind"] == "revisit" and got["v1"]["metadata"] is None
    assert sorted(r["at"] for r in warc.surplus(records, captures).collect()) == [2, 7]
    assert warc.page_captures(captures).count() == 2


# --- whitening ---------------------------------------------------------------------------------


def vector_frame(spark, rows):
    schema = "vec_id long, embedding array<double>, dim string, x long, component string, n string"
    return spark.createDataFrame([(i, v, "d", 1, "c", "n") for i, v in rows], schema).repartition(3)


def steps(v):
    return tuple(math.floor(c * 256) for c in v)


def check_whitened(got, rows, dim, many=4):
    rows = [(i, steps(v)) for i, v in rows if len(v) == dim]
    fit = sorted({x for _, x in rows})
    n, sums = len(fit), [sum(x[i] for x in fit) for i in range(dim)]
    centred = [[n * x[i] - sums[i] for i in range(dim)] for x in fit]
    cov = np.array([[sum(c[i] * c[j] for c in centred) / n**3 for j in range(dim)] for i in range(dim)])
    values = np.sort(np.linalg.eigvalsh(cov))[::-1]
    mine = [r for r in got if r["n"] == n and r["vec_id"] in {i for i, _ in rows}]
    assert len(mine) == len(rows) * min(many, dim)
    want = Counter((i, sum((n * x[d] - sums[d]) ** 2 for d in range(dim))) for i, x in rows)
    for c in range(min(many, dim)):
        own = [r for r in mine if r["component"] == c + 1]
        assert Counter((r["vec_id"], int(r["deviation"])) for r in own) == want
        assert all(abs(r["explained"] / (values[c] / np.trace(cov)) - 1) < 1e-9 for r in own)
    by_id = {i: x for i, x in rows}
    white = {}
    for r in mine:
        white.setdefault(by_id[r["vec_id"]], {})[r["component"]] = r["whitened"]
    w = np.array([[white[x][c + 1] for c in range(min(many, dim))] for x in fit])
    w -= w.mean(axis=0)
    assert np.abs(w.T @ w / n - np.eye(w.shape[1])).max() < 1e-6
    # Each column is the projection on an eigenvector with its eigenvalue.
    scaled = np.array([[v / n for v in c] for c in centred])
    for c in range(w.shape[1]):
        direction = np.linalg.lstsq(scaled, w[:, c], rcond=None)[0] * math.sqrt(values[c])
        assert np.abs(cov @ direction - values[c] * direction).max() < 1e-6 * values[0]


def test_whitening_by_fractions(spark, monkeypatch):
    monkeypatch.setattr(whitening, "STRIP", 7)
    rng = np.random.default_rng(4)
    mix = rng.normal(size=(6, 6))
    rows = [(i, (rng.normal(size=6) @ mix).tolist()) for i in range(60)]
    rows += [(500 + i, rows[0][1]) for i in range(30)] + [(7, rows[9][1]), (500, rows[3][1])]
    rows += [(900 + i, rng.normal(size=2).tolist()) for i in range(9)]
    bad = [(1, None), (2, [1.0, None] * 3), (3, [math.nan] * 6), (4, [math.inf, 0.0, 0.0, 0.0, 0.0, 0.0]), (5, [])]
    got = whitening.whiten(vector_frame(spark, rows + bad)).collect()
    errors = {r["identity_error"] for r in got}
    assert len(errors) == 1 and errors.pop() < 1e-9
    unique = [(i, v) for k, (i, v) in enumerate(rows) if i not in {j for j, _ in rows[:k]}]
    assert len(got) == 4 * (len(rows) - 9) + 2 * 9
    check_whitened(whitening.whiten(vector_frame(spark, unique + bad)).collect(), unique, 6)
    check_whitened(got, rows, 2)


def test_whitening_of_huge_entries_stays_exact(spark):
    rng = np.random.default_rng(6)
    rows = [(i, (rng.normal(size=3) * 10.0 ** (3 * i % 14)).tolist()) for i in range(40)]
    check_whitened(whitening.whiten(vector_frame(spark, rows)).collect(), rows, 3)
    past = [(0, [1e300, 0.0]), (1, [-1e300, 1.0]), (2, [5.0, 2.0])]
    got = whitening.whiten(vector_frame(spark, past), 2).collect()
    # Beside such an entry the other dimension has no spread to speak of.
    assert len(got) == 6 and all(math.isfinite(r["whitened"]) == (r["component"] == 1) if r["whitened"] is not None
                                 else r["component"] == 2 for r in got)


def test_whitening_without_spread(spark):
    one = whitening.whiten(vector_frame(spark, [(1, [0.5, 0.25]), (2, [0.5, 0.25])])).collect()
    assert {(r["vec_id"], r["n"], int(r["deviation"]), r["whitened"], r["explained"]) for r in one} == {
        (1, 1, 0, None, None), (2, 1, 0, None, None)}
    line = whitening.whiten(vector_frame(spark, [(i, [i / 8, 0.0]) for i in range(5)])).collect()
    assert all((r["whitened"] is None) == (r["component"] == 2) for r in line)
    assert {r["identity_error"] < 1e-12 for r in line} == {True}
    assert whitening.whiten(vector_frame(spark, [(1, [0.5])]).limit(0)).count() == 0
