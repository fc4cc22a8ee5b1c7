"""N-gram Jaccard join by T-occurrence search.

A text is the set of its shingles of three words (ASCII white space between them, A-Z in lower case; a text of one or two
words is one shingle). Two texts are linked when their sets have a Jaccard similarity of at least ``LEAST`` / ``OUT_OF``, and
components are formed of the links.

A set of q shingles overlaps every partner in at least T = q * LEAST / OUT_OF of them, so a partner stands in at least T of
the inverted lists of its shingles. DivideSkip looks for such ids: the L longest lists are set aside, ids that the other
lists hold at least T - L times are candidates, and these are probed in the long lists by binary search until they
reach their overlap or no longer can.

One index over a large corpus has lists that no task can hold, so the search has two levels. On the first, sets are cut
into parts by a hash of the shingle. Sets of one class of sizes have as many parts as a linked pair can differ in shingles
and ``need`` more; so partners have at least ``need`` equal parts, which is a T-occurrence search with parts in place of
shingles. Lists of parts are counted by aggregation, and only sets with enough parts in common with any other go on. On
the second level, sets whose parts are equal meet in cells, each with a bounded number of shingles: an index of
its targets is searched with DivideSkip for each of its askers. First, every set meets the smallest of its lists, then,
where lists still hold sets of several components, the sets outside the largest component meet all the others.
Cells return no more links than connect their sets; no list is capped, held by one task, or written out as pairs.

Distinct sets are one node each, so copies are searched once. Hashes have 54 bits within a text and sets have a digest of
128 bits; a wrong link takes texts on the very threshold and equal hashes of two of their shingles.

Defined results: a text without words (null, empty, white space) has no shingles and is its own component; equal sets share
a component; ids may repeat; the smallest id ignores nulls; an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.llm.batches import joined, pass_through
from ledgerloom.llm.components import components
from ledgerloom.llm.labelled import stored
from ledgerloom.llm.warc import SALTS, salted_left
from ledgerloom.llm.words import Words, lower_ascii, mixed

# Fixed value: the white space between words.
WHITE = b" \t\n\x0b\x0c\r"
SHINGLE = 3
#: Sets are linked when OUT_OF * intersection >= LEAST * union.
LEAST, OUT_OF = 90, 100
#: Shingles of the targets, and of the askers, of one cell; a larger set has a cell of its own.
CELL = 1 << 19
#: How much dearer than merging an entry it is to probe one, for the choice of long lists.
PROBE_COST = 0.1
#: Long lists that are probed in one step.
PROBED = 64
#: Ratio between the sizes at which classes of sizes begin.
STEP = 1.4

_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


def sets_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each text in ascending order, one text after the other, and where each text begins."""
    white = np.zeros(256, bool)
    white[list(WHITE)] = True
    words = Words(lower_ascii(data), offsets, ~white[data])
    cuts, hashes = words.cuts, np.concatenate([words.hash, np.zeros(SHINGLE, np.uint64)])
    n = len(words.start)
    n_words = np.diff(cuts)
    text_of = np.repeat(np.arange(len(n_words)), n_words)
    left = cuts[1:][text_of] - np.arange(n)  # words from here to the end of the text
    total = np.minimum(left, SHINGLE).astype(np.uint64) * _ODD[SHINGLE]
    for k in range(SHINGLE):
        total += np.where(left > k, hashes[k : k + n], np.uint64(0)) * _ODD[k]
    whole = (left >= SHINGLE) | (np.arange(n) == cuts[:-1][text_of])
    # The text goes before the 54 bits of the shingle, so that one sort does for all texts.
    keys = np.unique(text_of[whole].astype(np.uint64) << np.uint64(54) | mixed(total[whole]) >> np.uint64(10))
    starts = np.searchsorted(keys, np.arange(len(n_words) + 1, dtype=np.uint64) << np.uint64(54))
    return keys & np.uint64((1 << 54) - 1), starts


def _size_classes() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sizes at which classes begin, parts per class, and equal parts that linked sets of it have at least.

    A class also holds the sets beyond its end that can be linked to one within it.
    """
    first = [1]
    while first[-1] < 1 << 40:
        first.append(max(first[-1] + 1, int(first[-1] * STEP)))
    largest = [(end - 1) * OUT_OF // LEAST for end in first[1:]]
    differing = np.array([2 * size * (OUT_OF - LEAST) // (OUT_OF + LEAST) for size in largest])
    need = 1 + differing // 12
    return np.array(first[:-1]), differing + need, need


FIRST, PARTS, NEED = _size_classes()


def part_hashes(shingles: np.ndarray, starts: np.ndarray, size_class: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash for each part of each set, and where each set's parts begin; no parts for a class below 0."""
    sizes = np.diff(starts)
    parts = np.where(size_class >= 0, PARTS[size_class], 0)
    begins = np.concatenate([[0], np.cumsum(parts)])
    out = np.zeros(begins[-1], np.uint64)
    chosen = np.repeat(size_class >= 0, sizes)
    values = mixed(shingles[chosen] * _ODD[0])
    many = np.repeat(parts, sizes)[chosen].astype(np.uint64)
    place = np.repeat(begins[:-1], sizes)[chosen] + ((values >> np.uint64(32)) % many).astype(np.int64)
    np.add.at(out, place, mixed(values ^ _ODD[1]))
    number = np.arange(len(out)) - np.repeat(begins[:-1], parts)
    label = np.repeat(size_class, parts).astype(np.uint64) * _ODD[2] + number.astype(np.uint64) * _ODD[3]
    return mixed(out + label), begins


SIGNED = T.StructType(
    [
        T.StructField("digest", T.BinaryType()),
        T.StructField("n_shingles", T.LongType()),
        T.StructField("own_class", T.IntegerType()),
        T.StructField("own_parts", T.ArrayType(T.LongType())),
        T.StructField("lower_class", T.IntegerType()),
        T.StructField("lower_parts", T.ArrayType(T.LongType())),
    ]
)


def sign(rows: DataFrame, text: str = "text") -> DataFrame:
    """Replace ``text`` by the columns of ``SIGNED``: digest and size of its set, and its parts in up to two classes."""

    def work(batch: pa.RecordBatch) -> dict:
        shingles, starts = sets_of(*joined(batch, text))
        sizes = np.diff(starts)
        own = np.searchsorted(FIRST, sizes, "right") - 1
        below = (own > 0) & (sizes * LEAST <= (FIRST[own] - 1) * OUT_OF)
        out = {"n_shingles": sizes}
        whole = shingles.tobytes()
        bounds = (starts * 8).tolist()
        out["digest"] = [
            hashlib.blake2b(whole[a:b], digest_size=16).digest() if b > a else None
            for a, b in zip(bounds[:-1], bounds[1:], strict=True)
        ]
        for name, size_class in (("own", own), ("lower", np.where(below, own - 1, -1))):
            found, begins = part_hashes(shingles, starts, size_class)
            out[f"{name}_class"] = pa.array(size_class.astype(np.int32))
            out[f"{name}_parts"] = pa.ListArray.from_arrays(pa.array(begins.astype(np.int32)), pa.array(found.view(np.int64)))
        return out

    return pass_through(rows, SIGNED, work, drop=(text,), sliced_by=(text,))


def _lists(signed: DataFrame) -> DataFrame:
    """(part, node, size_class): the inverted lists of the parts."""
    both = F.array(
        F.struct(F.col("own_class").alias("size_class"), F.col("own_parts").alias("parts")),
        F.struct(F.col("lower_class").alias("size_class"), F.col("lower_parts").alias("parts")),
    )
    classes = signed.select("node", F.inline(both))
    return classes.select(F.explode("parts").alias("part"), "node", F.col("size_class").cast("tinyint").alias("size_class"))


def _held_twice(lists: DataFrame) -> DataFrame:
    """The rows of the lists that hold at least two nodes."""
    long = lists.groupBy("part").agg(F.count(F.lit(1)).alias("held")).filter("held > 1").select("part")
    return lists.join(long, "part", "left_semi")


def _candidates(signed: DataFrame) -> DataFrame:
    """Lists of the distinct sets that share enough parts with others."""
    need = F.array(*[F.lit(int(n)) for n in NEED])[F.col("size_class").cast("int")]
    shared = stored(_held_twice(_lists(signed)), "shared-parts")
    enough = shared.groupBy("node", "size_class").agg(F.count(F.lit(1)).alias("held")).filter(F.col("held") >= need)
    # Of the rows with one digest, one stays: copies have shared all their parts with each other.
    alive = enough.select("node").distinct().join(signed.select("node", "digest"), "node")
    distinct = alive.groupBy("digest").agg(F.min("node").alias("node")).select("node")
    lists = shared.join(distinct, "node", "left_semi").select("part", "node", "size_class")
    again = stored(_held_twice(lists), "shared-again")
    enough = again.groupBy("node", "size_class").agg(F.count(F.lit(1)).alias("held")).filter(F.col("held") >= need)
    return stored(again.join(enough, ["node", "size_class"], "left_semi").select("part", "node"), "candidates")


class Index:
    """Inverted lists over sets, searched with DivideSkip."""

    def __init__(self, shingles: np.ndarray, starts: np.ndarray):
        self.size = np.diff(starts)
        ids = np.repeat(np.arange(len(self.size)), self.size)
        order = np.argsort(shingles, kind="stable")
        self.ids = ids[order]
        self.shingles, self.first, self.length = np.unique(shingles[order], return_index=True, return_counts=True)
        self.keys = np.repeat(np.arange(len(self.shingles)), self.length) * len(self.size) + self.ids

    def search(self, asked: np.ndarray) -> np.ndarray:
        """Ids of the sets that are linked to the set ``asked`` (ascending shingles)."""
        none = np.zeros(0, np.int64)
        least = -(-len(asked) * LEAST // OUT_OF)
        if not len(self.shingles):
            return none
        place = np.minimum(np.searchsorted(self.shingles, asked), len(self.shingles) - 1)
        lists = place[self.shingles[place] == asked]
        if len(lists) < least:
            return none
        lists = lists[np.argsort(self.length[lists], kind="stable")]
        longest = int(self.length[lists[-1]])
        n_long = min(least - 1, int(least / (PROBE_COST * np.log2(longest + 1) + 1)))
        short, long = lists[: len(lists) - n_long], lists[len(lists) - n_long :]
        # Merge the short lists: how often each id stands in them.
        lengths = self.length[short]
        ends = np.cumsum(lengths)
        at = np.arange(ends[-1]) - np.repeat(ends - lengths - self.first[short], lengths)
        times = np.bincount(self.ids[at], minlength=len(self.size))
        enough = -(-(len(asked) + self.size) * LEAST // (OUT_OF + LEAST))
        found = np.flatnonzero((times >= least - n_long) & (times + n_long >= enough))
        times, enough = times[found], enough[found]
        # Probe the long ones, from the shortest up, for as long as the overlap can still be reached.
        for k in range(0, n_long, PROBED):
            if not len(found):
                return none
            probes = (long[k : k + PROBED, None] * len(self.size) + found).ravel()
            there = self.keys[np.minimum(np.searchsorted(self.keys, probes), len(self.keys) - 1)] == probes
            times = times + there.reshape(-1, len(found)).sum(axis=0)
            left = max(0, n_long - k - PROBED)
            alive = times + left >= enough
            found, times, enough = found[alive], times[alive], enough[alive]
        return found


def _linked_in_cell(table: pa.Table) -> pa.Table:
    """Links (a, b) that connect the askers of a cell to its targets of other labels."""
    asks = np.asarray(table["asks"].combine_chunks())
    a: list[int] = []
    b: list[int] = []
    if 0 < asks.sum() < len(asks):
        node, label = (np.asarray(table[c].combine_chunks()) for c in ("node", "label"))
        in_body = np.asarray(table["in_body"].combine_chunks())
        sets = table["shingles"].combine_chunks()
        values = np.asarray(sets.flatten()).view(np.uint64)
        starts = np.concatenate([[0], np.cumsum(np.asarray(sets.value_lengths()))])
        target = np.flatnonzero(~asks)
        sizes = np.diff(starts)[target]
        ends = np.cumsum(sizes)
        at = np.arange(ends[-1]) - np.repeat(ends - sizes - starts[target], sizes)
        index = Index(values[at], np.concatenate([[0], ends]))
        names, name = np.unique(label, return_inverse=True)
        top = np.arange(len(names))
        for s in np.flatnonzero(asks).tolist():
            found = target[index.search(values[starts[s] : starts[s + 1]])]
            # A pair of askers is met from both sides; one of them looks at it.
            found = found[in_body[found] | (node[found] > node[s])]
            for t in found[top[name[found]] != top[name[s]]].tolist():
                old, new = top[name[s]], top[name[t]]
                if old != new:
                    top[top == old] = new
                    a.append(int(node[s]))
                    b.append(int(node[t]))
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _searched(cells: DataFrame, sets: DataFrame) -> DataFrame:
    """Links found in cells of (family, i, j, node, label, in_body, asks)."""
    whole = cells.join(sets.select("node", "shingles"), "node")
    return whole.groupBy("family", "i", "j").applyInArrow(_linked_in_cell, "a long, b long").distinct()


def _first_links(lists: DataFrame, sets: DataFrame) -> DataFrame:
    """Links of every node to the one, smallest of a list of its parts, that is so in most of its lists."""
    least = lists.groupBy("part").agg(F.min("node").alias("family"))
    met = lists.join(least, "part").filter("node <> family").groupBy("node", "family").agg(F.count(F.lit(1)).alias("times"))
    best = F.max(F.struct("times", (-F.col("family")).alias("_family"))).alias("best")
    stars = met.groupBy("node").agg(best).select("node", (-F.col("best._family")).alias("family"))
    stars = stored(stars.join(sets.select("node", "n_shingles"), "node"), "stars")
    cells = stars.groupBy("family").agg(F.ceil(F.sum("n_shingles") / CELL).cast("int").alias("cells"))
    members = _dealt(stars, cells, "cells").select(
        "family", "i", "node", F.lit(True).alias("in_body"), F.lit(False).alias("asks")
    )
    askers = cells.select(
        "family", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)).alias("i"), F.col("family").alias("node"),
        F.lit(True).alias("in_body"), F.lit(True).alias("asks"),
    )
    every = members.unionByName(askers).withColumn("j", F.lit(0)).withColumn("label", F.col("node"))
    return stored(_searched(every, sets), "first-links")


def _dealt(rows: DataFrame, counts: DataFrame, count: str) -> DataFrame:
    """``rows`` with the counts of their family, and each one's place ``i`` below ``count``; large families are salted."""
    known = salted_left(rows, counts, "family", F.xxhash64("node"))
    return known.withColumn("i", F.pmod(F.xxhash64("node", F.lit("place")), F.col(count)).cast("int"))


def _other_links(lists: DataFrame, labels: DataFrame, sets: DataFrame) -> DataFrame:
    """Links between nodes of one list that have different labels.

    In each list, the label of most nodes is the body, and the others are strays. The lists of one body form a family.
    """
    labelled = lists.join(labels.withColumnRenamed("label", "found"), "node", "left").select(
        "part", "node", F.coalesce("found", "node").alias("label")
    )
    sizes = labelled.groupBy("part", "label").agg(F.count(F.lit(1)).alias("held"))
    bodies = (
        sizes.groupBy("part")
        .agg(F.count(F.lit(1)).alias("labels"), F.max(F.struct("held", "label")).alias("body"))
        .filter("labels > 1")
        .select("part", F.col("body.label").alias("family"))
    )
    distinct = labelled.join(bodies, "part").select("family", "node", "label").distinct()
    members = stored(distinct.join(sets.select("node", "n_shingles"), "node"), "families")
    stray = F.col("label") != F.col("family")
    # Body and strays together are dealt to blocks, and strays alone to those that ask.
    blocks = members.groupBy("family").agg(
        F.ceil(F.sum("n_shingles") / CELL).cast("int").alias("blocks"),
        F.ceil(F.sum(F.when(stray, F.col("n_shingles"))) / CELL).cast("int").alias("asking"),
    )
    rows = _dealt(members, blocks, "blocks")
    columns = ["family", "node", "label", (~stray).alias("in_body")]
    targets = rows.select(
        *columns, F.lit(False).alias("asks"), "i", F.explode(F.sequence(F.lit(0), F.col("asking") - 1)).alias("j")
    )
    askers = rows.filter(stray).select(
        *columns, F.lit(True).alias("asks"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("i"),
        F.pmod(F.xxhash64("node", F.lit("asking")), F.col("asking")).cast("int").alias("j"),
    )
    return stored(_searched(targets.unionByName(askers), sets), "other-links")


def _sets(keyed: DataFrame, signed: DataFrame, lists: DataFrame) -> DataFrame:
    """(node, n_shingles, shingles) of the nodes of ``lists``, from the one text that stands for each."""
    wanted = signed.select("node", "n_shingles", "key", "salt").join(lists.select("node").distinct(), "node", "left_semi")
    some = keyed.select("key", "salt", "text").join(wanted, ["key", "salt"])
    once = some.groupBy("key", "salt", "node").agg(F.first("n_shingles").alias("n_shingles"), F.first("text").alias("text"))

    def work(batch: pa.RecordBatch) -> dict:
        shingles, starts = sets_of(*joined(batch, "text"))
        return {"shingles": pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(shingles.view(np.int64)))}

    schema = T.StructType([T.StructField("shingles", T.ArrayType(T.LongType()))])
    return stored(pass_through(once.select("node", "n_shingles", "text"), schema, work, drop=("text",), sliced_by=("text",)), "sets")


def components_of(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest id that links lead to) of every row."""
    keyed = docs.select(
        F.col(doc_id).alias("doc_id"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
    ).select("*", F.unhex(F.md5("text")).alias("key"), F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int").alias("salt"))
    signed = stored(sign(keyed).withColumn("node", F.monotonically_increasing_id()), "signed")
    some = signed.filter("n_shingles > 0")
    lists = _candidates(some)
    sets = _sets(keyed, signed, lists)
    first = _first_links(lists, sets)
    labels = stored(components(first), "labels")
    links = first.unionByName(_other_links(lists, labels, sets))
    top = components(links)
    nodes = some.groupBy("digest").agg(F.min("doc_id").alias("first"))
    named = some.join(top, "node").select("digest", "label")
    facts = stored(nodes.join(named, "digest", "left").withColumn("own", F.coalesce(F.col("label").cast("string"), F.hex("digest"))), "nodes")
    least = facts.groupBy("own").agg(F.min("first").alias("component_id"))
    found = facts.select("digest", "own").join(least, "own").select("digest", "component_id")
    linked = salted_left(some.select("doc_id", "n_shingles", "digest"), found, "digest", F.xxhash64("doc_id"))
    alone = signed.filter("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return linked.select("doc_id", "n_shingles", "component_id").unionByName(alone)
