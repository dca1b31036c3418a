"""Token counts, files, packing, mixing, neighbours and the pipeline."""

from __future__ import annotations

import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

import corpus_pipeline
from rowsieve.llm import mixing, nearest, packing, queries, token_counts, token_files, tokens
from rowsieve.llm.tokens import ChunkEncoder, public_path
from tests.llm import corpus

BYTE, WORD = public_path("byte_bpe_50k.json"), public_path("word_bpe_49k.json")
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def data():
    return corpus.rows()


@pytest.fixture(scope="module")
def docs(spark, data):
    return corpus.frame(spark, data).cache()


def ids_of(data, path, end=2):
    tool = Tokenizer.from_file(path)
    return {r[0]: np.array([*tool.encode(r[1] or "", add_special_tokens=False).ids, end], "<u4") for r in data}


ENCODERS = {p: ChunkEncoder(p, remember=50) for p in (BYTE, WORD)}
ALPHABET = "abXYZéßİΣσς 019.,;:!?'’-_\n\t\r  ̇́\x1c\x85中😀<|>"


@pytest.mark.parametrize("path", [BYTE, WORD])
@given(st.lists(st.text(ALPHABET, max_size=40) | st.sampled_from(["<|endoftext|>", "a b", "don't."]), max_size=6))
@settings(max_examples=150, deadline=None)
def test_chunks_encode_like_whole_texts(path, texts):
    tool = ENCODERS[path]
    want = [np.array(tool.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert tool.encode(texts) == want


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_every_letter_alone_and_at_a_word_end(path):
    tool = ChunkEncoder(path)
    letters = [chr(c) for c in range(0x21, 0x530) if chr(c).isprintable()]
    texts = [t for x in letters for t in (x, f"ab{x}", f"AB{x}. {x}b", f"{x}{x.upper()}", f"{x}\u0301,")]
    want = [np.array(tool.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert tool.encode(texts) == want


def test_both_tokenizers_are_cut_in_chunks():
    assert ENCODERS[BYTE].kind == "byte" and ENCODERS[WORD].kind == "word"


def test_suffix_sums(spark, docs, data):
    lengths = np.array([len(i) - 1 for i in ids_of(data, BYTE).values()])
    table = token_counts.token_counts(docs, BYTE)
    for stretch in (2, 4096):
        rows = token_counts.suffix_table(token_counts.length_histogram(
            token_counts.token_lengths(docs, BYTE)), stretch).collect()
        assert sorted(r["n_tokens"] for r in rows) == sorted(set(lengths.tolist()))
        for r in rows:
            k = r["n_tokens"]
            assert r["docs_at_least"] == (lengths >= k).sum()
            assert r["tokens_at_least"] == lengths[lengths >= k].sum()
            assert r["truncated_tokens"] == np.minimum(lengths, k).sum()
            assert abs(r["share_within"] - (lengths <= k).mean()) < 1e-12
    limits = [0, 1, 30, 128, 10**6]
    answers = {r["context_limit"]: r for r in token_counts.answer_limits(table, limits).collect()}
    for k in limits:
        assert answers[k]["docs_cut"] == (lengths > k).sum()
        assert answers[k]["truncated_tokens"] == np.minimum(lengths, k).sum()
    quantiles = token_counts.length_quantiles(table, [0.01, 0.5, 1.0]).collect()
    ordered = np.sort(lengths)
    for r in quantiles:
        assert r["n_tokens"] == ordered[int(np.ceil(r["share"] * len(ordered))) - 1]
    assert token_counts.token_counts(docs.limit(0), BYTE).count() == 0


@given(st.lists(st.integers(0, 5000), min_size=0, max_size=700), st.integers(0, 2**40))
@settings(max_examples=60, deadline=None)
def test_elias_fano_round_trip(gaps, first):
    values = np.cumsum([first, *gaps]) if gaps else np.array([first])
    coded, end = token_files.EliasFano.from_bytes(b"xx" + token_files.EliasFano.encode(values).to_bytes(), 2)
    assert (coded.all() == values).all()
    for i in {0, len(values) - 1, len(values) // 2, len(values) // 3}:
        assert coded.get(i) == values[i]


def test_elias_fano_is_small_and_strict():
    values = np.cumsum(np.full(10_000, 700))
    assert len(token_files.EliasFano.encode(values).to_bytes()) < 10_000 * 12 / 8 + 1000
    assert len(token_files.EliasFano.encode(np.array([], int)).all()) == 0
    with pytest.raises(ValueError):
        token_files.EliasFano.encode(np.array([3, 2]))
    with pytest.raises(IndexError):
        token_files.EliasFano.encode(np.array([3])).get(1)


@pytest.mark.parametrize("shard_ids", [50, 1 << 21])
def test_files_hold_every_id_in_order(spark, docs, data, shard_ids):
    nameless = corpus.frame(spark, [(None, "no name", None, None, 7)])
    files = token_files.write_token_files(docs.unionByName(nameless), WORD, 2, shard_ids=shard_ids)
    got = sorted(token_files.read_token_files(files).collect(), key=lambda r: r["start"])
    want = ids_of([(None, "no name"), *data], WORD)
    at = 0
    assert [r["doc_id"] for r in got] == [None, *sorted(r[0] for r in data)]
    for r in got:
        ids = want[r["doc_id"]]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    names, bounds, flat = token_files.read_shard(bytes(files.orderBy("part", "seq").first()["content"]))
    a, b = bounds.get(1), bounds.get(2)
    assert (flat[a:b] == want[names[1]]).all()


def test_files_of_odd_tables(docs):
    twice = token_files.write_token_files(docs.unionByName(docs), WORD, 2)
    assert token_files.read_token_files(twice).count() == 2 * docs.count()
    assert token_files.read_token_files(token_files.write_token_files(docs.limit(0), WORD, 2)).count() == 0
    wide = token_files.write_shard([1], [np.array([70_000, 2], "<u4").tobytes()])
    assert token_files.read_shard(wide)[2].tolist() == [70_000, 2]


def check_packing(rows, ids, capacity):
    places = defaultdict(list)
    pieces = defaultdict(list)
    for r in rows:
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert len(part) == r["length"] and zlib.crc32(part.tobytes()) == r["ids_crc32"]
        places[r["sequence_id"]].append((r["offset"], r["length"]))
        pieces[r["doc_id"]].append((r["piece"], r["start"], r["length"]))
    for parts in places.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= capacity
    for name, parts in pieces.items():
        parts.sort()
        n = len(ids[name])
        assert [p[0] for p in parts] == list(range(len(parts))) and sum(p[2] for p in parts) == n
        assert len(parts) == -(-n // capacity) and all(p[2] == capacity for p in parts[1:])
    return len(places)


@pytest.mark.parametrize("capacity, rank_rows", [(1024, 100_000), (64, 10)])
def test_packing_places_every_piece(docs, data, capacity, rank_rows):
    ids = ids_of(data, BYTE)
    packed = packing.pack(packing.settle(packing.cut_pieces(docs, BYTE, 2, capacity), "p"), capacity, rank_rows)
    n = check_packing(packed.collect(), ids, capacity)
    assert n <= 1.06 * sum(map(len, ids.values())) / capacity + 1
    sequences = packing.sequence_ids(packed, docs, BYTE, 2, capacity).collect()
    assert sum(len(r["ids"]) for r in sequences) == sum(map(len, ids.values()))
    first = packed.first()
    mine = next(r["ids"] for r in sequences if r["sequence_id"] == first["sequence_id"])
    want = ids[first["doc_id"]][first["start"] : first["start"] + first["length"]].tolist()
    assert mine[first["offset"] : first["offset"] + first["length"]] == want


def test_packing_odd_tables(docs):
    twice = packing.pack_documents(docs.unionByName(docs), BYTE, 2).collect()
    seen = Counter((r["sequence_id"], r["offset"]) for r in twice)
    assert max(seen.values()) == 1
    assert len({(r["row"], r["piece"]) for r in twice}) == len(twice)
    assert packing.pack_documents(docs.limit(0), BYTE, 2).count() == 0


@given(st.dictionaries(st.integers(1, 40), st.integers(1, 60), max_size=15))
@settings(max_examples=80, deadline=None)
def test_moves_are_best_fit_decreasing(counts):
    moves, opened = packing.best_fit_moves(counts, 40)
    gaps: list[int] = []
    for length in sorted(counts, reverse=True):
        for _ in range(counts[length]):
            fits = [(g, i) for i, g in enumerate(gaps) if g >= length]
            if fits:
                gaps[min(fits)[1]] -= length
            else:
                gaps.append(40 - length)
    assert opened == len(gaps)
    placed = Counter()
    for m in moves.itertuples():
        placed[m.length] = max(placed[m.length], m.rank)
    with pytest.raises(ValueError):
        packing.best_fit_moves({41: 1}, 40)


def water_levels(sizes, weights, most=3.0):
    left, open_ = float(sum(sizes)), set(range(len(sizes)))
    target = [0.0] * len(sizes)
    while open_:
        unit = left / sum(weights[i] for i in open_)
        over = {i for i in open_ if unit * weights[i] > most * sizes[i]}
        if not over:
            for i in open_:
                target[i] = unit * weights[i]
            break
        for i in over:
            target[i] = most * sizes[i]
            left -= target[i]
        open_ -= over
    return target


def test_mix_meets_its_targets(spark, docs, data):
    got = mixing.mix(docs, block_words=8, shard_words=200).collect()
    size = Counter()
    for _, text, _, source, _ in data:
        size[source] += len(corpus.words(text))
    order = sorted((s for s in size if s is not None)) + [None]
    want = dict(zip(order, water_levels([size[s] for s in order], [1 + i % 3 for i in range(len(order))])))
    taken = Counter()
    assert len(got) == len(data)
    for r in got:
        assert r["source_size"] == size[r["source"]] and abs(r["target"] - want[r["source"]]) < 1e-6
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
    for s in order:
        assert abs(taken[s] - want[s]) <= 8 * (2 + 3 * size[s] // 200)
    again = mixing.mix(docs.repartition(5), block_words=8, shard_words=200).collect()
    assert sorted(map(tuple, again), key=str) == sorted(map(tuple, got), key=str)


def test_mixed_rows_are_what_was_taken(spark, docs, data):
    taken = {r["doc_id"]: r["taken"] for r in mixing.mix(docs).collect()}
    rows = mixing.mixed_rows(docs)
    assert rows.columns == docs.columns
    n = Counter()
    for r in rows.collect():
        n[r["doc_id"]] += len(corpus.words(r["text"]))
        assert r["size"] == 2 and r["n_chars"] == len(r["text"])
    assert {k: v for k, v in taken.items() if v} == dict(n)


def test_mix_odd_tables(spark, docs):
    assert mixing.mix(docs.limit(0)).count() == 0
    blank = corpus.frame(spark, [(1, None, None, None, 0), (2, "", "en", "a", 0)])
    assert [r["taken"] for r in mixing.mix(blank).collect()] == [0, 0]
    twice = docs.unionByName(docs)
    assert mixing.mix(twice).count() == 2 * docs.count()


def test_quotas_are_the_highest_quotients(spark):
    rng = random.Random(6)
    for _ in range(4):
        weights = {i: rng.choice([0, 1, 5, rng.random() * 100, 1000]) for i in range(rng.randint(1, 12))}
        weights[99] = 2.5
        seats = rng.choice([1, 7, 100, 3001])
        rows = spark.createDataFrame([(0, k, float(w), seats) for k, w in weights.items()], "g int, k int, w double, s long")
        got = {r["k"]: r["quota"] for r in mixing.sainte_lague(rows, "g", "k", "w", "s").collect()}
        want = Counter()
        for _ in range(seats):
            best = max(weights, key=lambda k: (weights[k] / (2 * want[k] + 1), -k))
            want[best] += 1
        assert {k: v for k, v in got.items() if v} == dict(want)


def brute_nearest(vectors, k=20):
    fine = [
        (name, v) for name, v in vectors
        if name is not None and v is not None and any(v) and all(x is not None and np.isfinite(x) for x in v)
    ]
    out = []
    for at, (q, mine) in enumerate(fine):
        if q % 20 == 0:
            scored = []
            for other, (c, v) in enumerate(fine):
                if other != at and len(v) == len(mine):
                    total = 0.0
                    for x, y in zip(mine, v):
                        total += x * y
                    scored.append((-total, c))
            out += [(q, i + 1, c, -s) for i, (s, c) in enumerate(sorted(scored)[:k])]
    return sorted(out)


@pytest.mark.parametrize("block_rows", [4096, 37])
def test_nearest_by_all_pairs(spark, block_rows):
    rng = np.random.default_rng(3)
    rows = [(i, np.float32(rng.normal(0, 1 + i % 5, 12)).tolist()) for i in range(300)]
    rows += [(1000 + i, rows[20][1]) for i in range(30)]  # ties
    rows += [(2000, None), (2020, [0.0] * 12), (2040, [float("nan")] * 12), (2060, [None] * 12), (None, rows[0][1]),
             (2080, [1.0, 2.0]), (2081, [1.0, 0.5]), (40, rows[41][1]), (41, rows[3][1]), rows[60], rows[60], rows[7], (2100, [1e-30] * 12), (2120, [])]
    frame = spark.createDataFrame([(i, v, 0, "q") for i, v in rows], "vec_id long, embedding array<float>, label int, score string")
    got = sorted(tuple(r) for r in nearest.nearest(frame, block_rows=block_rows).collect())
    assert got == brute_nearest(
        [(r["vec_id"], r["embedding"]) for r in frame.collect()]
    )
    assert nearest.nearest(frame.limit(0)).count() == 0


def test_tile_bounds_hold():
    rng = np.random.default_rng(9)
    a, b = rng.normal(0, 1, (20, 33)), rng.normal(0, 50, (30, 33))
    low, high = nearest.tile_bounds(nearest.Quantised(a), nearest.Quantised(b))
    exact = a @ b.T
    assert (low <= exact).all() and (exact <= high).all()
    assert np.median(high - low) < 0.2 * np.abs(exact).max()


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_match_their_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "labels", "pages", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    got = [tuple(r[c] for c in sorted(df.columns)) for r in df.collect()]
    done = con.execute(queries.ORACLES[name])
    names = [d[0] for d in done.description]
    at = [names.index(c) for c in sorted(names)]
    assert sorted(names) == sorted(df.columns)
    assert sorted(got, key=repr) == sorted((tuple(r[i] for i in at) for r in done.fetchall()), key=repr)


def test_pipeline_stages_by_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    before = docs
    for name, stage in corpus_pipeline.STAGES:
        after = corpus_pipeline.settle(stage(spark, before, SF), "stage")
        rows = after.collect()
        data = [tuple(r) for r in before.collect()]
        if name != corpus_pipeline.STAGES[-1][0]:
            assert after.columns == columns
        if name == "quality classifier":
            labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
            kept = {r["doc_id"] for r in rows}
            assert np.mean([labels[i] == (i in kept) for i in labels]) > 0.97
        elif name == "line dedup":
            want = corpus.boilerplate_kept(data, 10, 1)
            assert {r["doc_id"]: r["text"] for r in rows} == {
                k: v for k, v in want.items() if corpus.words(v) or v == next(r[1] for r in data if r[0] == k)
            }
        elif name == "n-gram Jaccard join":
            _, classes = corpus.near_links(data)
            assert sorted(r["doc_id"] for r in rows) == sorted(set(classes.values()))
        elif name == "mixing sources":
            assert sum(len(corpus.words(r["text"])) for r in rows) == pytest.approx(
                sum(len(corpus.words(r[1])) for r in data), rel=0.02
            )
        else:
            tool = Tokenizer.from_file(BYTE)
            n = sum(len(tool.encode(r[1] or "", add_special_tokens=False).ids) + 1 for r in data)
            assert sum(r["length"] for r in rows) == n
            ends = Counter()
            for r in rows:
                ends[r["sequence_id"]] += r["length"]
            assert max(ends.values()) <= 1024 and len(ends) <= 1.02 * n / 1024 + 1
            whole = defaultdict(list)
            for r in rows:
                whole[r["doc_id"], r["row"]].append((r["start"], bytes(r["ids"])))
            got = Counter((k[0], b"".join(x for _, x in sorted(v))) for k, v in whole.items())
            ids_column = columns.index("text")
            want = Counter()
            for r in data:
                ids = tool.encode(r[ids_column] or "", add_special_tokens=False).ids + [2]
                want[r[columns.index("doc_id")], np.array(ids, "<u4").tobytes()] += 1
            assert got == want and max(want.values()) > 1
            joined = {r["sequence_id"]: bytes(r["ids"]) for r in packing.joined_sequences(after).collect()}
            assert {k: len(v) // 4 for k, v in joined.items()} == dict(ends)
            for r in rows:
                at = 4 * r["offset"]
                assert joined[r["sequence_id"]][at : at + 4 * r["length"]] == bytes(r["ids"])
        before = after


def test_pipeline_runs_on_awkward_rows(spark, docs):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    assert labels.count()
    current = docs
    for name, stage in corpus_pipeline.STAGES[1:]:
        current = corpus_pipeline.settle(stage(spark, current, SF), "stage")
    assert current.count() > 0
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0


def test_texts_are_cut_a_slice_of_a_batch_at_a_time():
    # A batch's ids were all held at once, however long its texts were.
    texts = ["a" * 400, None, "", "b" * 2_000, "c", "d" * 600] * 50
    batch = pa.record_batch([pa.array(range(300)), pa.array(texts)], ["doc_id", "text"])
    parts = list(packing.bounded(iter([batch, batch.slice(0, 0)]), 1, 1_000))
    assert [v for p in parts for v in p.column(1).to_pylist()] == texts
    held = [sum(len(t or "") for t in p.column(1).to_pylist()) for p in parts]
    assert len(parts) > 90 and max(held) <= 3_000


def test_places_are_found_without_the_ids(docs):
    # All columns went through Python, the ids of every piece with them.
    pieces = packing.settle(packing.cut_pieces(docs, BYTE, 2, 64, with_ids=True), "pieces")
    packed = packing.pack(pieces, 64)
    plan = packed._jdf.queryExecution().executedPlan().toString()
    assert "MapInPandas" not in plan and "place(length" in plan
    assert packed.columns[-3:] == ["ids", "sequence_id", "offset"]


def test_encoders_are_given_up():
    # A worker that Spark kept for the placing held its chunks to the end.
    tool = tokens.encoder(BYTE)
    tool.encode(["some words"])
    assert tool.known
    tokens.release()
    assert not tool.known and tokens.encoder(BYTE) is not tool
    assert tokens.encoder(BYTE, packing.REMEMBER).remember < tokens.encoder(BYTE).remember


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_a_word_is_learned_once_and_plain_ones_go_straight_to_the_model(path, monkeypatch):
    # Every text was gone through twice, and each new word normalized, plain letters too.
    tool, asked = ChunkEncoder(path), []
    model = tool.tokenizer.model
    tool.tokenize = lambda letters: asked.append(letters) or model.tokenize(letters)
    monkeypatch.setattr(tokens, "unicodedata", None)
    texts = ["pear plum pear, plum. pear", "plum, pear! Pear plum"]
    want = [np.array(tool.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert tool.encode(texts) == want
    assert len(asked) == len(set(asked)) and 2 <= len(asked) <= 5
