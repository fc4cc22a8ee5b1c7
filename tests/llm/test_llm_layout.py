"""Merkle manifests and fill-in-middle against direct versions, their layouts, and defined results."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import fillmiddle, merkle
from ledgerloom.llm.wavelet import WaveletMatrix


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_addresses_are_a_layout():
    for levels in range(1, 6):
        found = np.concatenate([merkle.address(levels, d, np.arange(merkle.ARITY**d)) for d in range(levels)])
        assert sorted(found.tolist()) == list(range(merkle.nodes_in(levels)))
        # Bottom subtrees of the split at half height lie in consecutive places.
        top = levels // 2
        if top:
            for sub in (0, merkle.ARITY**top - 1):
                inside = [merkle.address(levels, d, sub * 8 ** (d - top) + np.arange(8 ** (d - top))) for d in range(top, levels)]
                places = np.concatenate(inside)
                assert places.max() - places.min() + 1 == len(places) == merkle.nodes_in(levels - top)


def tree(digests):
    levels = [list(digests)]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([sha("".join(last[i : i + 8])) for i in range(0, len(last), 8)])
    return levels


def path(levels, i):
    left, right = [], []
    for level in levels[:-1]:
        a = i // 8 * 8
        left.append("".join(level[a:i]))
        right.append("".join(level[i + 1 : a + 8]))
        i //= 8
    return left, right


@pytest.mark.parametrize("height", [1, 4])
def test_manifest_against_direct_trees(spark, monkeypatch, height):
    monkeypatch.setattr(merkle, "HEIGHT", height)
    monkeypatch.setattr(merkle, "BLOCK", 8**height)
    draw = random.Random(height)
    rows = [(g, i, sha(f"{g}{i}")) for g, n in (("a", 1), ("b", 8), ("c", 9), (None, 70), ("é", 600), ("Z", 2)) for i in range(n)]
    rows += [("b", 3, sha("again")), ("b", None, sha("none")), ("c", 4, sha("c4"))]
    draw.shuffle(rows)
    frame = spark.createDataFrame(rows, "lang string, doc_id long, digest string").repartition(7)
    leaves = merkle.ranked(frame.select(merkle.tree_of("lang").alias("tree"), "doc_id", "digest"), ["doc_id", "digest"])
    leaves = leaves.withColumn("kept", F.struct("tree", "doc_id", "digest")).cache()
    manifest = merkle.build(leaves)
    found = manifest.proofs(leaves).select(
        "kept.*", "left", "right", "subroot", "root", merkle.folded(F.col("kept.digest")).alias("again"), merkle.proof_digest().alias("proof")
    ).collect()
    groups = {}
    for g, i, d in rows:
        groups.setdefault("0" if g is None else "1" + g, []).append((i is not None, i or 0, d))
    trees = {g: tree([d for *_, d in sorted(v)]) for g, v in groups.items()}
    names = sorted(trees, key=str.encode)
    top = tree([trees[g][-1][0] for g in names])
    expected = {}
    for g, v in groups.items():
        for at, (known, i, d) in enumerate(sorted(v)):
            inner, outer = path(trees[g], at), path(top, names.index(g))
            expected.setdefault((g, i if known else None, d), []).append((inner[0] + outer[0], inner[1] + outer[1], trees[g][-1][0]))
    assert len(found) == len(rows) and manifest.root().collect()[0].root == top[-1][0]
    for r in found:
        assert (r.left, r.right, r.subroot) in expected[(r.tree, r.doc_id, r.digest)]
        assert r.root == r.again == top[-1][0]
        assert r.proof == sha("".join(a + b for a, b in zip(r.left, r.right, strict=True)))


def test_manifest_of_one_and_of_none(spark):
    one = spark.createDataFrame([("1x", 5, sha("x"))], "tree string, doc_id long, digest string")
    leaves = merkle.ranked(one, ["doc_id", "digest"]).withColumn("kept", F.struct("doc_id"))
    manifest = merkle.build(leaves)
    row = manifest.proofs(leaves).select("*", merkle.proof_digest().alias("proof")).collect()[0]
    assert (row.left, row.right, row.subroot, row.root) == ([], [], sha("x"), sha("x")) and row.proof == sha("")
    none = merkle.ranked(one.limit(0), ["doc_id", "digest"]).withColumn("kept", F.struct("doc_id"))
    manifest = merkle.build(none)
    assert manifest.proofs(none).count() == 0 and manifest.root().count() == 0


def test_fields_of_a_leaf(spark):
    row = spark.createDataFrame([(7, "é", None, "")], "a long, b string, c string, d string")
    found = row.select(merkle.leaf([F.col(c) for c in "abcd"])).collect()[0][0]
    assert found == sha("1:7" + "2:é" + "-" + "0:")


def test_wavelet_matrix():
    draw = np.random.default_rng(4)
    for size in (0, 1, 63, 64, 65, 5000):
        symbols = draw.integers(0, 12, size).astype(np.uint8)
        matrix = WaveletMatrix(symbols, 4)
        a = draw.integers(0, size + 1, 50)
        b = np.maximum(a, draw.integers(0, size + 1, 50))
        for s in (0, 5, 11):
            assert matrix.rank(s, a, b).tolist() == [int((symbols[x:y] == s).sum()) for x, y in zip(a, b, strict=True)]
        wanted = (1, 4, 9)
        held = np.flatnonzero(np.isin(symbols, wanted))
        if len(held):
            nth = draw.integers(1, len(held) + 1, 20)
            ends = np.full(20, size)
            assert matrix.locate(wanted, np.zeros(20, np.int64), ends, nth).tolist() == held[nth - 1].tolist()


WHITE = " \t\n\x0b\x0c\r"
TEXTS = ["", None, " ", "a", "a ", " a", "a  b\tc\n", "é ü\x0bß ", "no <P> mark", "Ab1 -" * 40, "x" * 3000, "\n\n", "漢字 かな 𝒳y z" * 9]


def units(text):
    out, at = [], 0
    while at < len(text):
        start = at
        while at < len(text) and text[at] in WHITE:
            at += 1
        while at < len(text) and text[at] not in WHITE:
            at += 1
        out.append(text[start:at])
    return out


def direct(doc_id, text, rate=50):
    digest = sha("42:" + ("" if doc_id is None else str(doc_id)))
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    parts = units(text or "")
    n = len(parts)
    a, b = sorted([h[0] % (n + 1), h[1] % (n + 1)])
    p, m, s = "".join(parts[:a]), "".join(parts[a:b]), "".join(parts[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return n, "plain", None, None, text or ""
    if h[3] % 100 < 80:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_fill_in_middle_against_direct_version(spark):
    rows = [(i * 17 + k, t) for i, t in enumerate(TEXTS) for k in range(12)] + [(None, "a b c"), (0, "a"), (0, "a")]
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, n long, output string").repartition(3)
    made = fillmiddle.fill_in_middle(docs, ["doc_id", "text"]).withColumn("again", fillmiddle.restored("output", "form")).collect()
    assert sorted(str(((r.doc_id, r.text), (r.n, r.form, r.prefix_chars, r.middle_chars, r.output))) for r in made) == sorted(
        str(((i, t), direct(i, t))) for i, t in rows
    )
    assert all(r.again == (r.text or "") for r in made) and {"plain", "psm", "spm"} == {r.form for r in made}
    with pytest.raises(ValueError, match="output"):
        fillmiddle.fill_in_middle(docs, ["output"])
    assert fillmiddle.fill_in_middle(docs.limit(0), ["doc_id"]).count() == 0


def test_characters_as_units_and_long_texts(spark):
    texts = ["añb", "漢字", "word " * 600_000 + "end"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    made = fillmiddle.fill_in_middle(docs, ["doc_id", "text"], rate=100, units="characters")
    made = made.withColumn("again", fillmiddle.restored("output", "form")).collect()
    assert all(r.n == len(r.text) and r.again == r.text for r in made)
    words = fillmiddle.fill_in_middle(docs, ["doc_id", "text"], rate=100).collect()
    assert [(r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in sorted(words)] == [direct(i, t, 100) for i, t in enumerate(texts)]


def test_tampering_is_found(spark):
    from ledgerloom.llm import queries

    found = queries.op11_merkle_manifest(spark, "/root/testdata/sf0.001").collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    for r in found:
        text = texts[r.doc_id]
        changed = zlib.crc32(str(r.doc_id).encode()) % 3 == 0 and any("A" <= c <= "Z" for c in text or "")
        assert r.verified == (not changed)
