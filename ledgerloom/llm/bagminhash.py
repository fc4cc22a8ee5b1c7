"""Near-duplicates by BagMinHash: weighted-Jaccard signatures, banding, and exact verification of multiset overlap.

A text is the multiset of its shingles of five words (white-space separated, in lower case; a text of one to four
words is one shingle). Two texts are linked when the overlap of their multisets, sum of minima over sum of maxima, is
at least ``SIMILARITY``. Classes are the connected components of the links.

BagMinHash: the weight of a shingle is cut at 0, 1, 2, 4, 8, ...; every interval below the weight has its own Poisson
process, whose rate is its width, shared by all texts. Points of a process carry a component of the signature
and, by halving the interval, a weight; a component takes the earliest point whose weight the text reaches. Points are
made in order and only up to the time at which all components are filled, so a text costs one draw per shingle
and a fixed number of points. Two texts agree in a component with a probability equal to their overlap.

Work is done on distinct texts, so copies of a text are one node. Texts that share a band meet in a bucket. First every
text is verified against one text drawn per bucket; then, in buckets whose texts are not all in one class yet, texts
of different classes are compared in cells of bounded size: by the units they share with any other, by signature,
and at last exactly. No bucket is capped, none is held by one task, and no list of all pairs is made.

The chance that a pair at the similarity shares no band is (1 - 0.8 ** 5) ** 32 = 3e-6, and that signatures of such a
pair agree in fewer than ``LEAST_AGREEING`` components 3e-7; both fall quickly above it.

Defined results: a text without words (null, empty, white space) is a class of its own, row by row; repeated rows and
equal texts share a class; ids may repeat or be null; an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.llm.batches import joined, pass_through
from ledgerloom.llm.components import components
from ledgerloom.llm.labelled import stored
from ledgerloom.llm.warc import SALTS, salted_left
from ledgerloom.llm.words import Words, lower_latin, mixed

# Fixed value: the white space between words.
WHITE = " \t\n\x0b\f\r"
SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 32, 5
SIZE = BANDS * ROWS
LEAST_AGREEING = round(SIZE * (SIMILARITY - 0.16))
#: Texts of one bucket that are compared with as many others in one step.
BLOCK = 256
#: Pairs of a cell that are verified in one step.
VERIFIED_AT_ONCE = 2048

_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)
_NEXT = np.uint64(0xE7037ED1A0B428DB)


def shingles(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all shingles, and the text that each is in, in order of place."""
    white = np.zeros(256, bool)
    white[list(WHITE.encode())] = True
    words = Words(lower_latin(data), offsets, ~white[data])
    n_words = np.diff(words.cuts)
    padded = np.concatenate([words.hash, np.zeros(SHINGLE, np.uint64)])
    total = np.zeros(len(words.hash), np.uint64)
    text_of = np.repeat(np.arange(len(n_words)), n_words)
    left = words.cuts[1:][text_of] - np.arange(len(total))  # words from here to the end of the text
    for k in range(SHINGLE):
        total += np.where(left > k, padded[k : k + len(total)], np.uint64(0)) * _ODD[k]
    first = np.arange(len(total)) == words.cuts[:-1][text_of]
    whole = (left >= SHINGLE) | first
    return mixed(total[whole]), text_of[whole]


def counted(hashes: np.ndarray, text_of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (text, hash) pairs with how often each is there: hashes, texts, counts."""
    order = np.lexsort((hashes, text_of))
    hashes, text_of = hashes[order], text_of[order]
    fresh = np.ones(len(hashes), bool)
    fresh[1:] = (hashes[1:] != hashes[:-1]) | (text_of[1:] != text_of[:-1])
    start = np.flatnonzero(fresh)
    return hashes[start], text_of[start], np.diff(np.append(start, len(hashes)))


def _uniform(seeds: np.ndarray) -> np.ndarray:
    """Numbers in (0, 1]."""
    return ((seeds >> np.uint64(11)).astype(np.float64) + 1.0) * 2.0**-53


def signatures(hashes: np.ndarray, text_of: np.ndarray, counts: np.ndarray, n_texts: int) -> np.ndarray:
    """Earliest times, one row of ``SIZE`` per text; rows of texts without shingles stay infinite."""
    out = np.full((n_texts, SIZE), np.inf)
    weight = np.bincount(text_of, weights=counts, minlength=n_texts)
    open_texts = weight > 0
    reach = np.log(SIZE) + 2.5
    while open_texts.any():
        chosen = open_texts[text_of]
        _points(out, hashes[chosen], text_of[chosen], counts[chosen], reach / np.maximum(weight, 1))
        open_texts &= ~np.isfinite(out).all(axis=1)
        out[open_texts] = np.inf
        reach *= 2
    return out


def _points(out: np.ndarray, hashes: np.ndarray, text_of: np.ndarray, counts: np.ndarray, until: np.ndarray) -> None:
    """Enter all points up to the time ``until`` of each text."""
    flat = out.reshape(-1)
    level = 0
    while len(hashes):
        low, high = (0, 1) if level == 0 else (1 << (level - 1), 1 << level)
        rate = float((high - low) * SIZE)
        seeds = mixed(hashes + np.array([level], np.uint64) * _NEXT)
        time = np.zeros(len(seeds))
        texts, reached = text_of, counts
        while len(seeds):
            seeds = mixed(seeds + _NEXT)
            time = time - np.log(_uniform(seeds)) / rate
            alive = time <= until[texts]
            seeds, time, texts, reached = seeds[alive], time[alive], texts[alive], reached[alive]
            marks = mixed(seeds ^ _ODD[0])
            component = (marks >> np.uint64(32)).astype(np.int64) % SIZE
            place = low + 1 + (marks & np.uint64(0xFFFFFFFF)).astype(np.int64) % (high - low)
            there = place <= reached
            np.minimum.at(flat, texts[there] * SIZE + component[there], time[there])
        heavier = counts > high
        hashes, text_of, counts = hashes[heavier], text_of[heavier], counts[heavier]
        level += 1


SIGNED = T.StructType(
    [
        T.StructField("n_shingles", T.LongType()),
        T.StructField("bands", T.ArrayType(T.LongType())),
    ]
)


def sign(rows: DataFrame, text: str = "text") -> DataFrame:
    """Replace ``text`` by the columns of ``SIGNED``: the number of shingles, and a hash per band of the signature."""

    def work(batch: pa.RecordBatch) -> dict:
        data, offsets = joined(batch, text)
        hashes, text_of = shingles(data, offsets)
        n = len(offsets) - 1
        sizes = np.bincount(text_of, minlength=n)
        times = signatures(*counted(hashes, text_of), n)
        bands = np.zeros((n, BANDS), np.uint64)
        parts = mixed(times.view(np.uint64)).reshape(n, BANDS, ROWS)
        for k in range(ROWS):
            bands += parts[:, :, k] * _ODD[k]
        bands = mixed(bands + np.arange(BANDS, dtype=np.uint64) * _NEXT)
        some = sizes > 0
        kept = bands[some].view(np.int64).ravel()
        ends = np.concatenate([[0], np.cumsum(some * BANDS)]).astype(np.int32)
        return {
            "n_shingles": sizes,
            "bands": pa.ListArray.from_arrays(pa.array(ends), pa.array(kept)),
        }

    return pass_through(rows, SIGNED, work, drop=(text,), sliced_by=(text,))


def overlaps(batch: pa.RecordBatch, left: str, right: str) -> np.ndarray:
    """Overlap of the multisets of two text columns, row by row."""
    n = batch.num_rows
    sides = []
    for name in (left, right):
        sides.append(counted(*shingles(*joined(batch, name))))
    hashes = np.concatenate([s[0] for s in sides])
    rows = np.concatenate([s[1] for s in sides])
    counts = np.concatenate([s[2] for s in sides])
    order = np.lexsort((hashes, rows))
    hashes, rows, counts = hashes[order], rows[order], counts[order]
    same = np.flatnonzero((hashes[1:] == hashes[:-1]) & (rows[1:] == rows[:-1]))
    shared = np.bincount(rows[same], weights=np.minimum(counts[same], counts[same + 1]), minlength=n)
    every = np.bincount(rows, weights=counts, minlength=n)
    return shared / np.maximum(every - shared, 1)


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Those (a, b) of ``pairs`` whose texts overlap enough. Where one text has very many partners, Spark splits its
    join at run time (adaptive skew join)."""
    members = pairs.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
    both = members.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")

    def work(batch: pa.RecordBatch) -> dict:
        return {"overlap": overlaps(batch, "text_a", "text_b")}

    found = pass_through(
        both.select("a", "b", "text_a", "text_b"),
        T.StructType([T.StructField("overlap", T.DoubleType())]),
        work,
        drop=("text_a", "text_b"),
        sliced_by=("text_a", "text_b"),
    )
    return found.filter(F.col("overlap") >= SIMILARITY - 1e-12)


def _starred(buckets: DataFrame) -> DataFrame:
    """Pairs of every text with one drawn from each of its buckets."""
    drawn = F.min(F.struct(F.xxhash64("node", "band").alias("order"), F.col("node").alias("pivot")))
    pivots = (
        buckets.groupBy("band")
        .agg(drawn.alias("drawn"), F.count(F.lit(1)).alias("held"))
        .filter("held > 1")
        .select("band", "drawn.pivot")
    )
    pairs = buckets.join(pivots, "band").filter("node <> pivot")
    return pairs.select(F.greatest("node", "pivot").alias("a"), F.least("node", "pivot").alias("b")).distinct()


def _across(buckets: DataFrame, labels: DataFrame, texts: DataFrame) -> DataFrame:
    """Verified links (a, b) between texts of one bucket that the stars left in different classes.

    In each bucket, the class with the most texts is the body; all others are strays. The buckets of one body form
    a family, in which every text is held once. Strays are compared with the body and with each other in cells of
    ``BLOCK`` by ``BLOCK`` texts. A cell returns no more links than it takes to connect its texts, so the output
    grows with the number of texts and not with that of their pairs.
    """
    labelled = buckets.join(labels.withColumnRenamed("label", "found"), "node", "left").select(
        "band", "node", F.coalesce("found", "node").alias("label")
    )
    sizes = labelled.groupBy("band", "label").agg(F.count(F.lit(1)).alias("held"))
    bodies = (
        sizes.groupBy("band")
        .agg(F.count(F.lit(1)).alias("labels"), F.max(F.struct("held", "label")).alias("body"))
        .filter("labels > 1")
        .select("band", F.col("body.label").alias("body"))
    )
    members = stored(labelled.join(bodies, "band").select("body", "node", "label").distinct(), "families")
    stray = F.col("label") != F.col("body")
    blocks = members.groupBy("body").agg(
        F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"),
        F.ceil(F.sum(stray.cast("int")) / BLOCK).cast("int").alias("stray_blocks"),
    )
    # The largest family may hold most of the texts: its members are dealt out where they meet its counts.
    rows = salted_left(members, blocks, "body", F.xxhash64("node")).join(texts, "node")
    place = F.xxhash64("node", F.lit("place"))
    columns = ["body", "node", "label", "text"]
    targets = rows.select(
        *columns, (~stray).alias("in_body"), F.lit(False).alias("asks"),
        F.pmod(place, F.col("blocks")).cast("int").alias("i"),
        F.explode(F.sequence(F.lit(0), F.col("stray_blocks") - 1)).alias("j"),
    )
    askers = rows.filter(stray).select(
        *columns, F.lit(False).alias("in_body"), F.lit(True).alias("asks"),
        F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("i"),
        F.pmod(place, F.col("stray_blocks")).cast("int").alias("j"),
    )
    cells = targets.unionByName(askers).groupBy("body", "i", "j")
    return cells.applyInArrow(_linked_in_cell, "a binary, b binary").distinct()


class _Cell:
    """The texts of a cell as sets of units: a shingle that a text has three times is three units."""

    def __init__(self, table: pa.Table):
        batch = table.select(["text"]).combine_chunks().to_batches()[0]
        hashes, text_of = shingles(*joined(batch, "text"))
        self.distinct = counted(hashes, text_of)
        order = np.lexsort((hashes, text_of))
        hashes, self.text_of = hashes[order], text_of[order]
        fresh = np.ones(len(hashes), bool)
        fresh[1:] = (hashes[1:] != hashes[:-1]) | (self.text_of[1:] != self.text_of[:-1])
        places = np.arange(len(hashes))
        time = places - np.maximum.accumulate(np.where(fresh, places, 0))
        self.units = mixed(hashes + time.astype(np.uint64) * _NEXT)
        self.size = np.bincount(self.text_of, minlength=table.num_rows)
        self.start = np.concatenate([[0], np.cumsum(self.size)])
        self.node = np.array(table["node"].to_pylist(), dtype=object)
        self.label = np.unique(np.array([x.hex() for x in table["label"].to_pylist()]), return_inverse=True)[1]
        self.asks = np.asarray(table["asks"].combine_chunks())
        self.in_body = np.asarray(table["in_body"].combine_chunks())

    def possible(self) -> tuple[np.ndarray, np.ndarray]:
        """(asker, target) pairs of different labels that could be links.

        No text overlaps another more than it shares units with all targets together; of the rest, signatures
        must agree often enough.
        """
        asked = ~self.asks[self.text_of]
        units, times = np.unique(self.units[asked], return_counts=True)
        place = np.minimum(np.searchsorted(units, self.units), len(units) - 1)
        others = np.where(units[place] == self.units, times[place], 0)
        also_target = np.isin(self.node, self.node[~self.asks])[self.text_of]
        shared = np.bincount(self.text_of, weights=others > also_target, minlength=len(self.size))
        alive = shared >= SIMILARITY * self.size - 1e-9
        askers, targets = np.flatnonzero(self.asks & alive), np.flatnonzero(~self.asks)
        if not len(askers):
            return askers, askers
        chosen = np.isin(self.distinct[1], np.concatenate([askers, targets]))
        times = signatures(*[x[chosen] for x in self.distinct], len(self.size))
        left, right, agreeing = [], [], []
        for s in askers:
            near = self.label[targets] != self.label[s]
            low, high = np.minimum(self.size[targets], self.size[s]), np.maximum(self.size[targets], self.size[s])
            near &= low >= SIMILARITY * high - 1e-9
            # A pair of strays is met from both sides; one of them looks at it.
            near &= self.in_body[targets] | (self.node[targets] > self.node[s])
            some = targets[near]
            agree = (times[some] == times[s]).sum(axis=1)
            enough = agree >= LEAST_AGREEING
            left.append(np.full(enough.sum(), s))
            right.append(some[enough])
            agreeing.append(agree[enough])
        order = np.argsort(-np.concatenate(agreeing), kind="stable")
        return np.concatenate(left)[order], np.concatenate(right)[order]

    def overlap(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        texts = np.column_stack([left, right]).ravel()
        sizes = self.size[texts]
        ends = np.cumsum(sizes)
        at = np.arange(ends[-1]) - np.repeat(ends - sizes, sizes) + np.repeat(self.start[texts], sizes)
        units, pair = self.units[at], np.repeat(np.arange(len(texts)) // 2, sizes)
        order = np.lexsort((units, pair))
        units, pair = units[order], pair[order]
        same = (units[1:] == units[:-1]) & (pair[1:] == pair[:-1])
        shared = np.bincount(pair[1:][same], minlength=len(left))
        return shared / (self.size[left] + self.size[right] - shared)


def _linked_in_cell(table: pa.Table) -> pa.Table:
    a, b = [], []
    if table.column("asks").to_pylist().count(False) not in (0, table.num_rows):
        cell = _Cell(table)
        left, right = cell.possible()
        joined_label = np.arange(cell.label.max() + 1)
        while len(left):
            now, left = left[:VERIFIED_AT_ONCE], left[VERIFIED_AT_ONCE:]
            then, right = right[:VERIFIED_AT_ONCE], right[VERIFIED_AT_ONCE:]
            linked = cell.overlap(now, then) >= SIMILARITY - 1e-12
            for s, t in zip(now[linked], then[linked], strict=True):
                old, new = joined_label[cell.label[s]], joined_label[cell.label[t]]
                if old != new:
                    joined_label[joined_label == old] = new
                    a.append(cell.node[s])
                    b.append(cell.node[t])
            apart = joined_label[cell.label[left]] != joined_label[cell.label[right]]
            left, right = left[apart], right[apart]
    return pa.table({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary())})


def node_of(text: str) -> Column:
    """The node of a text: a digest of it; texts without words have one, but no class."""
    return F.unhex(F.md5(F.coalesce(F.col(text).cast("string"), F.lit(""))))


def _classed(docs: DataFrame, doc_id: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(doc_id, node, n_shingles) of every row, and (node, class_id, class_size, head) of every node with words.

    ``head`` is the node that stands for the class: of the smallest id, and then of the smallest digest.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    keyed = rows.withColumn("node", node_of("text"))
    signed = stored(sign(keyed), "signed")
    nodes = signed.filter("n_shingles > 0").groupBy("node").agg(F.first("bands").alias("bands"))
    bands = nodes.select("node", F.explode("bands").alias("band"))
    shared = bands.groupBy("band").agg(F.count(F.lit(1)).alias("held")).filter("held > 1").select("band")
    buckets = stored(bands.join(shared, "band", "left_semi"), "buckets")
    wanted = buckets.select("node").distinct()
    # Copies of one text are dealt out, and met again only after each task has kept one of its own.
    dealt = keyed.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    salts = wanted.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    some = dealt.join(salts, ["node", "salt"], "left_semi")
    texts = stored(some.groupBy("node").agg(F.first("text").alias("text")), "texts")
    labels = components(verified(_starred(buckets), texts))
    more = stored(_across(buckets, labels, texts), "links")
    raised = (
        more.join(labels.select(F.col("node").alias("a"), F.col("label").alias("la")), "a", "left")
        .join(labels.select(F.col("node").alias("b"), F.col("label").alias("lb")), "b", "left")
        .select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b"))
    )
    top = components(raised).select(F.col("node").alias("label"), F.col("label").alias("root"))
    class_of = (
        signed.filter("n_shingles > 0")
        .groupBy("node")
        .agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("held"))
        .join(labels, "node", "left")
        .select("node", "first", "held", F.coalesce("label", "node").alias("label"))
        .join(top, "label", "left")
        .select("node", "first", "held", F.coalesce("root", "label").alias("class"))
    )
    class_of = stored(class_of, "classes")
    best = F.min(F.struct(F.isnull("first").alias("none"), F.col("first"), F.col("node"))).alias("best")
    heads = class_of.groupBy("class").agg(best, F.sum("held").alias("class_size"))
    facts = class_of.select("node", "class").join(heads, "class").select(
        "node", F.col("best.first").alias("class_id"), "class_size", F.col("best.node").alias("head")
    )
    return signed.select("doc_id", "node", "n_shingles"), facts


def classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, class_id (smallest id of the class) and class_size of every row."""
    rows, facts = _classed(docs, doc_id, text)
    some = salted_left(rows.filter("n_shingles > 0"), facts, "node", F.xxhash64("doc_id"))
    alone = rows.filter("n_shingles = 0").select(
        "doc_id", F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("class_size")
    )
    return some.select("doc_id", "class_id", "class_size").unionByName(alone)


def without_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay when one document of each class stays, that of the smallest id.

    Of rows that repeat both id and text one stays; rows without words all stay.
    """
    _, facts = _classed(docs, doc_id, text)
    heads = facts.filter("node = head").select("node", "class_id")
    wordless = F.trim(F.coalesce(F.col(text).cast("string"), F.lit("")), F.lit(WHITE)) == ""
    whole = F.struct("*").alias("doc")
    some = docs.filter(~wordless).select(
        whole, F.col(doc_id).alias("id"), node_of(text).alias("node"),
        F.pmod(F.xxhash64(doc_id), F.lit(SALTS)).cast("int").alias("salt"),
    )
    dealt = heads.withColumn("salt", F.pmod(F.xxhash64("class_id"), F.lit(SALTS)).cast("int"))
    stay = some.join(dealt, ["node", "salt"]).filter(F.col("id").eqNullSafe(F.col("class_id")))
    once = stay.groupBy("node", "salt").agg(F.first("doc").alias("doc")).select("doc")
    return once.unionByName(docs.filter(wordless).select(whole)).select("doc.*")
