"""The Jaccard join against brute force, its two levels of search, and defined results."""

import random

import numpy as np
import pytest

from ledgerloom.llm import overlapjoin as oj


def shingled(text):
    words = [w for w in "".join(c.lower() if c.isascii() else c for c in text or "").replace("\t", " ").replace("\n", " ").split(" ") if w]
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 3]) for i in range(max(1, len(words) - 2)))


def direct(rows):
    sets = sorted({shingled(t) for _, t in rows if shingled(t)}, key=sorted)
    parent = {s: s for s in sets}

    def top(s):
        while parent[s] != s:
            s = parent[s]
        return s

    for i, a in enumerate(sets):
        for b in sets[:i]:
            if 100 * len(a & b) >= 90 * len(a | b):
                parent[top(a)] = top(b)
    ids = {}
    for i, t in rows:
        if shingled(t) and i is not None:
            k = top(shingled(t))
            ids[k] = min(i, ids.get(k, i))
    return [(i, len(shingled(t)), ids.get(top(shingled(t))) if shingled(t) else i) for i, t in rows]


def corpus():
    """Near copies around the threshold, a template of many variants, frequent shingles, short texts, nulls, repeats."""
    draw = random.Random(11)
    word = lambda: "".join(draw.choice("abcdefgh") for _ in range(draw.randint(2, 6)))
    rows, ids = [], iter(range(1000, 9000))
    passage = [word() for _ in range(60)]
    for _ in range(40):
        base = [word() for _ in range(draw.randint(8, 300))]
        if draw.random() < 0.4:
            base[3:3] = passage
        rows.append((next(ids), " ".join(base)))
        for _ in range(draw.randint(0, 4)):
            base = list(base)
            for _ in range(draw.randint(0, 5)):
                base[draw.randrange(len(base))] = word()
            rows.append((next(ids), " ".join(base[: draw.randint(len(base) * 9 // 10, len(base))])))
    template = [word() for _ in range(200)]
    for _ in range(80):
        near = list(template)
        for _ in range(draw.randint(0, 9)):
            near[draw.randrange(200)] = word()
        rows.append((next(ids), " ".join(near)))
    rows += [(next(ids), "la la lo " * 60), (next(ids), "La la lo " * 30), (next(ids), "of the of the of the")]
    rows += [(1, ""), (2, None), (3, " \n"), (4, "one two"), (5, "One  TWO"), (6, "one two three"), (4, "one two")]
    rows += [(None, rows[0][1]), (rows[1][0], rows[40][1]), rows[2], (None, "x"), (None, "")]
    return rows


@pytest.mark.parametrize("cell", [1000, 1 << 19])
def test_components_against_brute_force(spark, monkeypatch, cell):
    monkeypatch.setattr(oj, "CELL", cell)
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "c", b"d") for i, t in rows], "doc_id long, text string, node string, digest binary")
    found = [tuple(r) for r in oj.components_of(docs.repartition(5)).collect()]
    assert sorted(map(str, found)) == sorted(map(str, direct(rows)))


def test_search_is_exact():
    draw = np.random.default_rng(2)
    base = draw.integers(0, 1 << 50, 400).astype(np.uint64)
    sets = []
    for _ in range(150):
        kept = base[draw.random(400) < draw.choice([0.9, 0.97, 0.99])]
        sets.append(np.unique(np.concatenate([kept, draw.integers(0, 1 << 50, draw.integers(1, 12)).astype(np.uint64)])))
    index = oj.Index(np.concatenate(sets), np.cumsum([0, *map(len, sets)]))
    links = 0
    for asked in sets:
        expected = [k for k, s in enumerate(sets) if 100 * len(np.intersect1d(s, asked)) >= 90 * len(np.union1d(s, asked))]
        assert index.search(asked).tolist() == expected
        links += len(expected)
    assert len(sets) < links < len(sets) ** 2
    assert oj.Index(np.zeros(0, np.uint64), np.zeros(1, np.int64)).search(base).size == 0


def test_linked_sets_have_enough_equal_parts():
    draw = np.random.default_rng(7)
    for size in [*range(1, 40), 200, 1000, 3001]:
        a = np.unique(draw.integers(0, 1 << 50, size).astype(np.uint64))
        # The largest difference that still links: drop some, or replace some.
        drop = len(a) - -(-len(a) * 9 // 10)
        b = np.sort(draw.permutation(a)[drop:])
        swap = 0
        while 10 * (len(a) - swap - 1) >= 9 * (len(a) + swap + 1):
            swap += 1
        c = np.unique(np.concatenate([draw.permutation(a)[swap:], draw.integers(0, 1 << 50, swap).astype(np.uint64)]))
        for other in (b, c):
            found = {}
            for s in (a, other):
                own = int(np.searchsorted(oj.FIRST, len(s), "right") - 1)
                for k in (own, own - 1):
                    if k == own or (k >= 0 and len(s) * 9 <= (oj.FIRST[own] - 1) * 10):
                        parts, _ = oj.part_hashes(s, np.array([0, len(s)]), np.array([k]))
                        found.setdefault(k, []).append(set(parts.tolist()))
            assert any(len(x) == 2 and len(x[0] & x[1]) >= oj.NEED[k] for k, x in found.items())


def test_long_and_empty(spark):
    docs = spark.createDataFrame([(1, "w%d " % 5 * 400_000), (2, "w5 w5 w5")], "doc_id long, text string")
    assert {tuple(r) for r in oj.components_of(docs).collect()} == {(1, 1, 1), (2, 1, 1)}
    assert oj.components_of(docs.limit(0)).count() == 0
