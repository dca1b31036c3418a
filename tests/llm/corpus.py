"""A small corpus with the awkward rows every operator must take, and brute-force models."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import pyarrow as pa

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, "
    # Names that operators use inside.
    "line string, pos int, size long, score double, node long, x string, task string, n long"
)
SPLIT = re.compile(r"[^\x20\x09-\x0D]+")


def words(text: str | None) -> list[str]:
    return SPLIT.findall(text or "")


def sentence(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice("abcdeoußé") for _ in range(rng.randint(2, 6))) for _ in range(n))


def rows(seed: int = 3) -> list[tuple]:
    """Copies, near copies, shared passages, nulls, empty, short and very long texts."""
    rng = random.Random(seed)
    texts: list[str | None] = [None, "", " \n\t ", "one", "two words", "a\xa0b  c\r\nd"]
    passage, base = sentence(rng, 70), sentence(rng, 120).split()
    footer = "all rights kept by the shared footer of many sites"
    for i in range(40):
        texts.append(sentence(rng, rng.randint(5, 90)) + "\n" + footer + "\n" + sentence(rng, 9) + ".")
    for i in range(12):
        near = list(base)
        near[rng.randrange(len(near))] = f"changed{i}"
        texts.append(" ".join(near))
    texts += [" ".join(base)] * 8
    for i in range(6):
        texts.append(f"{sentence(rng, 20)} {passage} {sentence(rng, 15 + i)}\n{footer}")
    texts.append("\n".join(sentence(rng, 12) for _ in range(900)))  # very long
    texts.append(" ".join(["again and again the same eight words come"] * 30))
    texts += [f"### {sentence(rng, 30)} &&& %%% $$$ ***"] * 2
    out = []
    for i, text in enumerate(texts):
        source = None if i % 13 == 5 else f"src{'0' if i % 3 == 0 else i % 7}"
        lang = None if i % 17 == 3 else ("en", "de")[i % 2]
        out.append((i * 3 + 1, text, lang, source, len(text or "")))
    return out


def frame(spark, data: list[tuple], parts: int = 3):
    full = [(*r, "line", 1, 2, 0.5, 3, "x", "task", 4) for r in data]
    return spark.createDataFrame(full, SCHEMA).repartition(parts, "doc_id")


def grams(text: str | None, n: int = 5) -> frozenset:
    w = words(text)
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1)))


def near_links(data: list[tuple], similarity: float = 0.8):
    """(links of each id, smallest id reached), by comparing all pairs."""
    sets = {r[0]: grams(r[1]) for r in data}
    count: Counter = Counter()
    parent = {k: k for k in sets}

    def top(k):
        while parent[k] != k:
            k = parent[k]
        return k

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and both >= similarity * (len(sets[a]) + len(sets[b]) - both) - 1e-9:
                count[a] += 1
                count[b] += 1
                parent[max(top(a), top(b))] = min(top(a), top(b))
    return count, {k: top(k) for k in sets}


def repeated_words(data: list[tuple], window: int = 50) -> dict[int, list[bool]]:
    """Which words are covered by a window that also starts in a smaller id."""
    first: dict[tuple, int] = {}
    lists = {r[0]: words(r[1]) for r in data}
    for i in sorted(lists):
        w = lists[i]
        for j in range(len(w) - window + 1):
            first.setdefault(tuple(w[j : j + window]), i)
    out = {}
    for i, w in lists.items():
        gone = [False] * len(w)
        for j in range(len(w) - window + 1):
            if first[tuple(w[j : j + window])] < i:
                gone[j : j + window] = [True] * window
        out[i] = gone
    return out


def base_statistics(text: str | None) -> tuple[int, int, int, int, int]:
    w = words(text)
    seen = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = set()
    for i in range(len(w) - 7):
        if seen[tuple(w[i : i + 8])] > 1:
            covered.update(range(i, i + 8))
    lines = [x for x in (text or "").split("\n") if SPLIT.search(x)]
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    return len(w), sum(map(len, w)), symbols, len(lines) - len(set(lines)), len(covered)


def boilerplate_kept(data: list[tuple], min_sites: int, min_words: int) -> dict[int, str | None]:
    sites, first = defaultdict(set), {}
    blanks = " \t\n\r\x0b\x0c"
    for i, text, _, source, _ in sorted(data, key=lambda r: r[0]):
        for at, line in enumerate((text or "").split("\n") if text is not None else []):
            key = line.strip(blanks)
            if len(words(line)) >= min_words:
                sites[key].add(source)
                first.setdefault(key, (i, at))
    out = {}
    for i, text, _, _, _ in data:
        if text is None:
            out[i] = None
            continue
        out[i] = "\n".join(
            line
            for at, line in enumerate(text.split("\n"))
            if len(words(line)) < min_words
            or len(sites[line.strip(blanks)]) < min_sites
            or first[line.strip(blanks)] == (i, at)
        )
    return out


def as_batches(names: list[str], *columns) -> list[pa.RecordBatch]:
    return [pa.record_batch([pa.array(c) for c in columns], names)]
