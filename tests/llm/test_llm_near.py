"""BagMinHash estimates, classes against brute force, and components."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from ledgerloom.llm import bagminhash as bag
from ledgerloom.llm.components import components


def overlap(a, b):
    shared = sum((a & b).values())
    return shared / max(1, sum(a.values()) + sum(b.values()) - shared)


def test_signatures_estimate_weighted_overlap():
    draw = np.random.default_rng(0)
    errors = []
    for _ in range(40):
        a = Counter({int(x): int(draw.integers(1, 40)) for x in draw.integers(0, 10**9, 120)})
        b = Counter({k: v if draw.random() < 0.6 else int(draw.integers(1, 40)) for k, v in a.items() if draw.random() < 0.9})
        hashes = [bag.mixed(np.array(list(x), np.uint64)) for x in (a, b)]
        counts = [np.array(list(x.values())) for x in (a, b)]
        texts = np.repeat([0, 1], [len(a), len(b)])
        left, right = bag.signatures(np.concatenate(hashes), texts, np.concatenate(counts), 2)
        errors.append((left == right).mean() - overlap(a, b))
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.06


def shingled(text):
    words = (text or "").lower().split()
    return Counter(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else Counter()


def direct_classes(rows):
    """Class id of every row: smallest id among texts connected by an overlap of 0.8 or more; None stands alone."""
    texts = sorted({t for _, t in rows if (t or "").split()})
    sets = {t: shingled(t) for t in texts}
    parent = {t: t for t in texts}

    def top(t):
        while parent[t] != t:
            t = parent[t]
        return t

    for i, a in enumerate(texts):
        for b in texts[:i]:
            if overlap(sets[a], sets[b]) >= 0.8:
                parent[top(a)] = top(b)
    ids = {}
    for i, t in rows:
        if t in parent:
            ids.setdefault(top(t), []).append(i)
    smallest = {k: min((i for i in v if i is not None), default=None) for k, v in ids.items()}
    return [(i, smallest[top(t)] if t in parent else i) for i, t in rows]


def corpus():
    """Texts, copies, chains of near copies, a template of many variants, short texts, nulls and repeated ids."""
    draw = random.Random(5)
    word = lambda: "".join(draw.choice("abcdefgh") for _ in range(draw.randint(2, 6)))
    rows, ids = [], iter(range(1000, 9000))
    for _ in range(25):
        base = [word() for _ in range(draw.randint(40, 160))]
        rows.append((next(ids), " ".join(base)))
        for _ in range(draw.randint(0, 4)):
            base = list(base)
            for _ in range(draw.randint(0, 3)):
                base[draw.randrange(len(base))] = word()
            rows.append((next(ids), " ".join(base)))
    template = [word() for _ in range(150)]
    for _ in range(60):
        near = list(template)
        for _ in range(draw.randint(0, 6)):
            near[draw.randrange(150)] = word()
        rows.append((next(ids), " ".join(near)))
    loop = "la la lo " * 60
    rows += [(next(ids), loop), (next(ids), loop + "lu"), (next(ids), "la la lo " * 30)]
    rows += [(1, ""), (2, None), (3, " \n"), (4, "one two"), (5, "One  TWO"), (6, "one two three"), (4, "one two")]
    rows += [(None, rows[0][1]), (rows[1][0], rows[40][1]), rows[2]]
    return rows


@pytest.mark.parametrize("block", [8, 256])
def test_classes_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(bag, "BLOCK", block)
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "c") for i, t in rows], "doc_id long, text string, node string").repartition(5)
    found = [(r.doc_id, r.class_id) for r in bag.classes(docs).collect()]
    assert sorted(map(str, found)) == sorted(map(str, direct_classes(rows)))


def test_without_copies_keeps_one_row_of_each_class(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "c") for i, t in rows], "doc_id long, text string, node string").repartition(5)
    kept = [(r.doc_id, r.text) for r in bag.without_copies(docs).collect()]
    classed = dict(zip(rows, direct_classes(rows), strict=True))
    stay = {(i, t) for (i, t), (_, c) in classed.items() if i == c and i is not None}
    assert {k for k in kept if (k[1] or "").split()} <= stay
    heads = {c for (_, t), (_, c) in classed.items() if (t or "").split()}
    with_words = [k for k in kept if (k[1] or "").split()]
    assert len(with_words) == len(heads) and {i for i, _ in with_words} == heads
    assert sorted(str(k) for k in kept if not (k[1] or "").split()) == sorted(str(r) for r in rows if not (r[1] or "").split())
    assert docs.columns == bag.without_copies(docs).columns


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert bag.classes(docs).count() == 0 and bag.without_copies(docs).count() == 0


def test_components_of_a_long_path(spark):
    n = 70
    order = list(range(n))
    random.Random(3).shuffle(order)
    edges = [(order[i], order[i + 1]) for i in range(n - 1)] + [(100, 101), (101, 102), (100, 102), (200, 200)]
    found = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {found[i] for i in range(n)} == {0} and {found[i] for i in (100, 101, 102)} == {100} and found[200] == 200


def test_components_of_chains_in_several_orders(spark):
    n = 1000
    rising = list(range(n))
    shuffled = random.Random(5).sample(rising, n)
    zigzag = [x for pair in zip(rising[: n // 2], reversed(rising[n // 2 :])) for x in pair]
    folded = sorted(rising, key=lambda x: f"{x:010b}"[::-1])
    digests = sorted(rising, key=lambda x: hashlib.md5(str(x).encode()).digest())
    edges, expected = [], {}
    for at, order in enumerate((rising, rising[::-1], shuffled, zigzag, folded, digests)):
        base = at * n
        edges += [(base + x, base + y) for x, y in zip(order, order[1:])]
        expected |= {base + x: base for x in order}
    found = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == expected
