"""Byte-level BPE: vectorised pre-tokenisation, cached pair merging, and decoding.

Pieces are cut as the pattern ``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``
cuts them, without a regex: every code point becomes a symbol (its class, and what follows it where the pattern
looks ahead), each symbol is a function from the state before it to the state after it, and a two-level scan
composes those functions: within blocks for all blocks at once, then over the blocks. The state before each
symbol says whether a piece starts there.

Defined results: a null or empty text has no tokens and decodes to no bytes. Ids, like the byte offset at which
each token starts, refer to the UTF-8 bytes of the text; decoding joins the bytes of the ids. Repeated rows are
encoded one by one; an empty table gives no rows. A text is cut in chunks of ``CHUNK`` code points with the state
carried over, so temporary memory does not grow with the length of a text.
"""

from __future__ import annotations

import base64
import heapq
import unicodedata
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.llm.batches import pass_through, texts

CHUNK = 1 << 20
#: Code points that the lower level of the scan composes one after the other.
BLOCK = 64
#: Pieces held in each of the two generations of a worker's cache.
CACHED = 200_000
#: Longer pieces are merged with a heap, in n log n.
SHORT = 48

LETTER, NUMBER, OTHER, SPACE, BLANK = range(5)  # classes; BLANK is U+0020
# Symbols. QUOTE1 and QUOTE2 open a contraction of one or two letters; a white space before something else is LAST.
L, N, O, QUOTE1, QUOTE2, BLANK_LAST, SPACE_LAST, WHITE = range(8)  # noqa: E741
SYMBOLS = 8
# States: nothing open; in letters, numbers, others, white space; after a joining blank; one or two letters to go.
OPEN, IN_L, IN_N, IN_O, IN_W, JOIN, ONE, TWO = range(8)
STATES = 8

# The contractions of the pattern, after the apostrophe.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")
# The code points of White_Space.
WHITE_SPACE = (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)


def _machine() -> tuple[np.ndarray, np.ndarray]:
    """next_state[symbol, state] and starts[symbol, state]; symbols from SYMBOLS on begin a text."""
    after = np.zeros((2 * SYMBOLS, STATES), np.uint8)
    starts = np.ones((2 * SYMBOLS, STATES), bool)
    for symbol, inside in ((L, IN_L), (N, IN_N), (O, IN_O)):
        after[symbol] = inside
        starts[symbol, [inside, JOIN]] = False
    after[L, TWO], after[L, ONE] = ONE, OPEN
    starts[L, [TWO, ONE]] = False
    for symbol, inside in ((QUOTE1, ONE), (QUOTE2, TWO)):
        after[symbol] = inside
        after[symbol, [IN_O, JOIN]] = IN_O
        starts[symbol, [IN_O, JOIN]] = False
    after[BLANK_LAST], after[SPACE_LAST], after[WHITE] = JOIN, OPEN, IN_W
    starts[WHITE, IN_W] = False
    after[SYMBOLS:] = after[:SYMBOLS, [OPEN]]
    return after, starts


AFTER, STARTS = _machine()


@cache
def classes() -> np.ndarray:
    """The class of every code point."""
    kinds = {"L": LETTER, "N": NUMBER}
    table = np.fromiter(
        (kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), np.uint8, 0x110000
    )
    table[list(WHITE_SPACE)] = SPACE
    table[0x20] = BLANK
    return table


def symbols(codes: np.ndarray, first: np.ndarray, following: np.ndarray, following_first: np.ndarray) -> np.ndarray:
    """Symbols of ``codes``; ``following`` are up to three code points after them, ``first`` marks text starts."""
    n = len(codes)
    ahead = np.concatenate([codes, following, np.zeros(3, codes.dtype)])
    breaks = np.concatenate([first, following_first, np.ones(3, bool)])
    kind = classes()[ahead]
    white = kind >= SPACE
    out = kind[:n].copy()  # L, N and O equal their classes
    last = white[:n] & ~white[1 : n + 1] & ~breaks[1 : n + 1]
    out[white[:n]] = WHITE
    out[last] = SPACE_LAST
    out[last & (kind[:n] == BLANK)] = BLANK_LAST
    quotes = np.flatnonzero(codes == 0x27)
    for word in CONTRACTIONS:
        spelt = np.ones(len(quotes), bool)
        for k, letter in enumerate(word, 1):
            spelt &= (ahead[quotes + k] == ord(letter)) & ~breaks[quotes + k]
        out[quotes[spelt]] = QUOTE1 if len(word) == 1 else QUOTE2
    out[first] += SYMBOLS
    return out


def scan(inputs: np.ndarray, state: int) -> tuple[np.ndarray, int]:
    """Whether a piece starts at each symbol, given the state before the first, and the state after the last."""
    n = len(inputs)
    rows = -(-n // BLOCK)
    padded = np.zeros(rows * BLOCK, np.uint8)
    padded[:n] = inputs
    grid = padded.reshape(rows, BLOCK).T.copy()
    if n < rows * BLOCK:
        tail = n - (rows - 1) * BLOCK
    else:
        tail = BLOCK
    # Lower level: the composition of each block's functions, as a table of states.
    composed = np.tile(np.arange(STATES, dtype=np.uint8), (rows, 1))
    for column in grid:
        composed = AFTER[column[:, None], composed]
    # Upper level: the state before each block.
    before = np.empty(rows, np.uint8)
    table = composed.tolist()
    for row in range(rows):
        before[row] = state
        state = table[row][state]
    starts = np.empty((BLOCK, rows), bool)
    current = before
    for k, column in enumerate(grid):
        starts[k] = STARTS[column, current]
        current = AFTER[column, current]
        if k + 1 == tail:
            state = int(current[-1])
    return starts.T.reshape(-1)[:n], state


def piece_starts(codes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Positions, in code points, at which pieces start; ``first`` marks the first code point of each text."""
    found, state = [], OPEN
    for a in range(0, len(codes), CHUNK):
        b = a + CHUNK
        inputs = symbols(codes[a:b], first[a:b], codes[b : b + 3], first[b : b + 3])
        starts, state = scan(inputs, state)
        found.append(np.flatnonzero(starts) + a)
    return np.concatenate(found) if found else np.zeros(0, np.int64)


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


class Pieces:
    """Token ids of pieces: two generations of bounded size, filled by merging all pieces that are not known at once."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.known: dict[bytes, tuple[int, ...]] = {}
        self.older: dict[bytes, tuple[int, ...]] = {}
        self.size = max(ranks.values()) + 1
        self.single = np.array([ranks[bytes([k])] for k in range(256)], np.int64)
        # Every way to join two tokens to a third, as a sorted table of pairs.
        joins = [(ranks[t[:k]], ranks[t[k:]], rank) for t, rank in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks]
        left, right, made = np.array(joins, np.int64).reshape(-1, 3).T
        keys = left * self.size + right
        order = np.argsort(keys)
        self.pairs, self.made = np.append(keys[order], -1), np.append(made[order], 0)

    def __call__(self, pieces: list[bytes]) -> list[tuple[int, ...]]:
        """The ids of each piece."""
        known, older = self.known, self.older
        out = [known.get(p) or older.get(p) for p in pieces]
        missing = [k for k, ids in enumerate(out) if ids is None]
        if missing:
            whole = self.ranks.get
            apart = []
            for k in missing:
                if (rank := whole(pieces[k])) is not None:
                    out[k] = (rank,)
                elif len(pieces[k]) > SHORT:
                    out[k] = merge(pieces[k], self.ranks)
                else:
                    apart.append(k)
            for k, ids in zip(apart, self._merged([pieces[k] for k in apart]), strict=True):
                out[k] = ids
            if len(known) >= CACHED:
                self.older, self.known = known, {}
            self.known.update((pieces[k], out[k]) for k in missing if len(pieces[k]) <= SHORT)
        return out

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """What each pair of tokens joins to; ``size`` where they do not join."""
        keys = left * self.size + right
        place = np.searchsorted(self.pairs[:-1], keys)
        return np.where(self.pairs[place] == keys, self.made[place], self.size)

    def _merged(self, pieces: list[bytes]) -> list[tuple[int, ...]]:
        """In each round, join the pair of lowest rank, leftmost first, in every piece that still has one."""
        out: list[tuple[int, ...]] = [()] * len(pieces)
        if not pieces:
            return out
        lengths = np.array([len(p) for p in pieces])
        number = np.arange(len(pieces))
        tokens = self.single[np.frombuffer(b"".join(pieces), np.uint8)]
        rank = np.append(self._ranks(tokens[:-1], tokens[1:]), self.size)
        rank[np.cumsum(lengths) - 1] = self.size
        while len(number):
            starts = np.cumsum(lengths) - lengths
            best = np.minimum.reduceat(rank, starts)
            going = best < self.size
            if not going.all():
                done = np.flatnonzero(~going)
                flat = tokens.tolist()
                for n, a, b in zip(number[done].tolist(), starts[done].tolist(), (starts + lengths)[done].tolist(), strict=True):
                    out[n] = tuple(flat[a:b])
                stay = np.repeat(going, lengths)
                tokens, rank = tokens[stay], rank[stay]
                lengths, number, best = lengths[going], number[going], best[going]
                if not len(number):
                    break
                starts = np.cumsum(lengths) - lengths
            hits = np.flatnonzero(rank == np.repeat(best, lengths))
            piece = np.searchsorted(starts, hits, "right") - 1
            at = hits[np.append(True, piece[1:] != piece[:-1])]  # the leftmost of each piece
            tokens[at] = best
            stay = np.ones(len(tokens), bool)
            stay[at + 1] = False
            tokens, rank = tokens[stay], rank[stay]
            at = at - np.arange(len(at))  # one token before each has gone
            lengths = lengths - 1
            ends = np.cumsum(lengths)
            after = at + 1 < ends
            rank[at] = self.size
            rank[at[after]] = self._ranks(tokens[at[after]], tokens[at[after] + 1])
            before = at > ends - lengths
            rank[at[before] - 1] = self._ranks(tokens[at[before] - 1], tokens[at[before]])
        return out


def merge(piece: bytes, ranks: dict[bytes, int]) -> tuple[int, ...]:
    """Join the adjacent pair of lowest rank, leftmost first, until none has a rank."""
    if (whole := ranks.get(piece)) is not None:
        return (whole,)
    if len(piece) > SHORT:
        return _merge_long(piece, ranks)
    none = len(ranks) + 256
    get = ranks.get
    parts = [piece[i : i + 1] for i in range(len(piece))]
    order = [get(piece[i : i + 2], none) for i in range(len(piece) - 1)]
    while order:
        best = min(order)
        if best == none:
            break
        i = order.index(best)
        parts[i] += parts.pop(i + 1)
        del order[i]
        if i < len(order):
            order[i] = get(parts[i] + parts[i + 1], none)
        if i:
            order[i - 1] = get(parts[i - 1] + parts[i], none)
    return tuple([ranks[p] for p in parts])


def _merge_long(piece: bytes, ranks: dict[bytes, int]) -> tuple[int, ...]:
    n = len(piece)
    end = list(range(1, n + 1))  # end of the part that starts here; 0 where none starts any more
    previous = list(range(-1, n - 1))
    heap = [(ranks[piece[i : i + 2]], i, i + 2) for i in range(n - 1) if piece[i : i + 2] in ranks]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        if not end[i] or (middle := end[i]) >= n or end[middle] != stop:
            continue
        end[i], end[middle] = stop, 0
        if stop < n:
            previous[stop] = i
            joined = piece[i : end[stop]]
            if joined in ranks:
                heapq.heappush(heap, (ranks[joined], i, end[stop]))
        if i:
            before = previous[i]
            joined = piece[before:stop]
            if joined in ranks:
                heapq.heappush(heap, (ranks[joined], before, stop))
    ids, i = [], 0
    while i < n:
        ids.append(ranks[piece[i : end[i]]])
        i = end[i]
    return tuple(ids)


def pieces_of(rows: list[bytes]) -> tuple[pa.Array, np.ndarray]:
    """All pieces of joined texts as one binary array on their bytes, and the index of each text's first (one more ends)."""
    whole = b"".join(rows)
    codes = np.frombuffer(whole.decode("utf-8").encode("utf-32-le"), np.uint32)
    places = np.flatnonzero((np.frombuffer(whole, np.uint8) & 0xC0) != 0x80)  # byte at which each code point starts
    lengths = np.array([len(r) for r in rows], np.int64)
    ends = np.cumsum(lengths)
    first = np.zeros(len(codes), bool)
    first[np.searchsorted(places, (ends - lengths)[lengths > 0])] = True
    starts = places[piece_starts(codes, first)] if len(codes) else np.zeros(0, np.int64)
    cuts = np.searchsorted(starts, np.concatenate([[0], ends]))
    bounds = pa.py_buffer(np.append(starts, len(whole)).astype(np.int64))
    return pa.Array.from_buffers(pa.large_binary(), len(starts), [None, bounds, pa.py_buffer(whole)]), cuts


def ids_of(pieces: pa.Array, known: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of consecutive pieces, and how many each piece has; each distinct piece is merged once."""
    encoded = pieces.dictionary_encode()
    merged = known(encoded.dictionary.to_pylist())
    lengths = np.fromiter(map(len, merged), np.int64, len(merged))
    flat = np.fromiter(chain.from_iterable(merged), np.int32, int(lengths.sum()))
    index = np.asarray(encoded.indices)
    counts = lengths[index]
    if len(flat) == len(merged):
        return flat[index], counts
    first = (np.cumsum(lengths) - lengths)[index]
    ends = np.cumsum(counts)
    at = np.repeat(first - (ends - counts), counts) + np.arange(ends[-1] if len(ends) else 0)
    return flat[at], counts


ENCODED = T.StructType(
    [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("starts", T.ArrayType(T.LongType()))]
)
#: Bytes of text whose pieces are found at once.
TOGETHER = 2 << 20


def _groups(rows: list[bytes]) -> list[list[bytes]]:
    groups: list[list[bytes]] = []
    room = 0
    for row in rows:
        if not groups or room < len(row):
            groups.append([])
            room = max(TOGETHER, len(row))
        groups[-1].append(row)
        room -= len(row)
    return groups


def _lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, type=kind))


class Coder:
    """Encodes and decodes columns of a batch; what it needs is made once per worker, when first used."""

    def __init__(self, ranks):
        self._ranks = ranks
        self._pieces: Pieces | None = None
        self._sizes: np.ndarray | None = None
        self._tokens: pa.Array | None = None

    def __reduce__(self):
        return Coder, (self._ranks,)

    def ids(self, rows: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of consecutive texts, and how many each text has."""
        if self._pieces is None:
            self._pieces = Pieces(self._ranks.value)
        per_text, ids = [], []
        for group in _groups(rows):
            pieces, cuts = pieces_of(group)
            found, per_piece = ids_of(pieces, self._pieces)
            ids.append(found)
            per_text.append(np.diff(np.concatenate([[0], np.cumsum(per_piece)])[cuts]))
        every = np.concatenate(ids) if ids else np.zeros(0, np.int32)
        return every, np.concatenate(per_text) if per_text else np.zeros(0, np.int64)

    def sizes(self) -> np.ndarray:
        """Bytes of every token."""
        if self._sizes is None:
            self._sizes = np.zeros(max(self._ranks.value.values()) + 1, np.int64)
            for token, rank in self._ranks.value.items():
                self._sizes[rank] = len(token)
        return self._sizes

    def bytes_of(self, ids: pa.Array, counts: np.ndarray) -> pa.Array:
        """The bytes of each row's tokens. Those of all tokens follow each other, so rows are longer stretches of them."""
        if self._tokens is None:
            tokens: list = [None] * (max(self._ranks.value.values()) + 1)
            for token, rank in self._ranks.value.items():
                tokens[rank] = token
            self._tokens = pa.array(tokens, pa.large_binary())
        gathered = self._tokens.take(ids)
        _, bounds, data = gathered.buffers()
        bounds = np.frombuffer(bounds, np.int64)[gathered.offset : gathered.offset + len(gathered) + 1]
        cuts = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
        whole = pa.Array.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(bounds[cuts].copy()), data])
        return whole.cast(pa.binary())


DECODED = T.StructField("decoded", T.BinaryType())


def _rows(docs: DataFrame, keep: list[str], text: str) -> DataFrame:
    return docs.select(*keep, F.col(text).cast("binary").alias("_text"))


def _coder(docs: DataFrame, path: str) -> Coder:
    return Coder(docs.sparkSession.sparkContext.broadcast(load_ranks(path)))


def encode(docs: DataFrame, path: str, keep: list[str], text: str = "text", offsets: bool = True) -> DataFrame:
    """``keep``, the token ``ids`` of each text, and with ``offsets`` the byte at which each token ``starts``."""
    coder = _coder(docs, path)

    def work(batch: pa.RecordBatch) -> dict:
        every, counts = coder.ids(texts(batch, "_text"))
        out = {"ids": _lists(every, counts, pa.int32())}
        if offsets:
            total = np.concatenate([[0], np.cumsum(coder.sizes()[every])])
            row_start = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)[:-1]
            out["starts"] = _lists(total[:-1] - np.repeat(total[row_start], counts), counts, pa.int64())
        return out

    schema = ENCODED if offsets else T.StructType(ENCODED.fields[:1])
    return pass_through(_rows(docs, keep, text), schema, work, drop=("_text",))


def decode(encoded: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Add the bytes that the ids stand for."""
    coder = _coder(encoded, path)

    def work(batch: pa.RecordBatch) -> dict:
        column = batch.column(batch.schema.get_field_index(ids))
        counts = np.asarray(column.value_lengths().fill_null(0)).astype(np.int64)
        return {out: coder.bytes_of(column.flatten(), counts)}

    return pass_through(encoded, T.StructType([T.StructField(out, T.BinaryType())]), work)


def round_trip(docs: DataFrame, path: str, keep: list[str], text: str = "text") -> DataFrame:
    """``keep``, the ``ids`` of each text, and ``decoded``, the bytes that these ids stand for; one pass, one worker."""
    coder = _coder(docs, path)

    def work(batch: pa.RecordBatch) -> dict:
        every, counts = coder.ids(texts(batch, "_text"))
        ids = _lists(every, counts, pa.int32())
        return {"ids": ids, "decoded": coder.bytes_of(ids.flatten(), counts)}

    return pass_through(_rows(docs, keep, text), T.StructType([ENCODED.fields[0], DECODED]), work, drop=("_text",))
