"""Token ids of texts by a public byte-level BPE vocabulary, and texts from token ids.

Texts are split into pieces without a regular expression. Every code point becomes a symbol (its class, and what follows it where that
matters); a symbol is a function from state to state of a small automaton; functions are composed over blocks side by side, then
over the blocks by doubling (composition is associative), which gives the state before every code point and so the piece starts of a whole
batch of texts at once. Pieces are then merged pair by pair in order of rank; the ids of pieces are cached.

Cases: null and empty texts have an empty list of ids; strings that look like special tokens are ordinary text; texts are encoded as they stand, of any length;
a piece of n bytes is merged in n log n steps, however long it is. Repeated ids or rows are kept as they are; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import heapq
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from marlgraph.llm.spread import spread
from marlgraph.runtime import ship

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Pieces whose ids a worker keeps; when full, it starts again.
CACHE = 400_000

# Symbols: letter, number, other, space before a word, white space inside a run, other white space that ends a run, apostrophe before one or two letters of a contraction.
LETTER, NUMBER, OTHER, LEAD, BLANK, BREAK, ONE, TWO = range(8)
#: Added to the symbol of a text's first code point.
FIRST = 8
# States: between pieces, in letters, in numbers, in others, in blanks, after a leading space, before the last or the last two letters of a contraction.
FREE, LETTERS, NUMBERS, OTHERS, BLANKS, AFTER, LAST, LAST_TWO = range(8)
#: Endings of contractions, by length. Fixed values.
ENDINGS = {1: ("s", "t", "m", "d"), 2: ("re", "ve", "ll")}
#: White space beside U+0020. Fixed values.
SPACES = [*range(0x09, 0x0E), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


@lru_cache(1)
def code_point_classes() -> np.ndarray:
    """LETTER, NUMBER, OTHER or BLANK for each code point, from the Unicode categories L* and N* and the white space property."""
    table = np.full(sys.maxunicode + 1, OTHER, np.uint8)
    for c in range(sys.maxunicode + 1):
        kind = unicodedata.category(chr(c))[0]
        if kind in "LN":
            table[c] = LETTER if kind == "L" else NUMBER
    table[[0x20, *SPACES]] = BLANK
    return table


@lru_cache(1)
def automaton() -> tuple[np.ndarray, np.ndarray]:
    """(next state, whether a piece starts) by symbol * 8 + state."""
    move, start = np.zeros((16, 8), np.uint8), np.ones((16, 8), bool)

    def rule(symbol: int, otherwise: int, **goes_on: int) -> None:
        move[symbol] = otherwise
        for state, to in goes_on.items():
            move[symbol, globals()[state]], start[symbol, globals()[state]] = to, False

    rule(LETTER, LETTERS, LETTERS=LETTERS, AFTER=LETTERS, LAST=FREE, LAST_TWO=LAST)
    rule(NUMBER, NUMBERS, NUMBERS=NUMBERS, AFTER=NUMBERS)
    rule(OTHER, OTHERS, OTHERS=OTHERS, AFTER=OTHERS)
    rule(ONE, LAST, OTHERS=OTHERS, AFTER=OTHERS)
    rule(TWO, LAST_TWO, OTHERS=OTHERS, AFTER=OTHERS)
    rule(LEAD, AFTER)
    rule(BLANK, BLANKS, BLANKS=BLANKS)
    rule(BREAK, FREE)
    move[FIRST:] = move[:FIRST, FREE][:, None]  # the first code point of a text forgets the state
    return move.ravel(), start.ravel()


def symbols(points: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Symbols of concatenated texts; firsts: positions at which texts begin."""
    n = len(points)
    first = np.zeros(n + 3, bool)
    first[firsts] = True
    first[n:] = True
    kinds = code_point_classes()[points]
    out = kinds.copy()
    blank = kinds == BLANK
    before_word = blank & ~np.r_[blank[1:], True] & ~first[1 : n + 1]
    out[before_word] = np.where(points[before_word] == 0x20, LEAD, BREAK)
    at = np.flatnonzero(points == ord("'"))
    if len(at):
        padded = np.r_[points, [0, 0]]
        one, two = padded[at + 1], padded[at + 2]
        in_text = ~first[at + 1]
        pairs = np.zeros(len(at), bool)
        for a, b in ENDINGS[2]:
            pairs |= (one == ord(a)) & (two == ord(b))
        out[at[pairs & in_text & ~first[at + 2]]] = TWO
        out[at[np.isin(one, [ord(c) for c in ENDINGS[1]]) & in_text]] = ONE
    out[firsts] += FIRST
    return out


def piece_starts(points: np.ndarray, firsts: np.ndarray, block: int = 256) -> np.ndarray:
    """Positions at which pieces start, by a blocked scan over the transition functions."""
    n = len(points)
    if not n:
        return np.empty(0, np.int64)
    move, start = automaton()
    rows = -(-n // block)
    grid = np.full(rows * block, OTHER, np.uint8)
    grid[:n] = symbols(points, firsts)
    grid = np.ascontiguousarray(grid.reshape(rows, block).T).astype(np.int16) * 8
    # each block's function: where it leads from every state
    leads = np.tile(np.arange(8, dtype=np.int16), (rows, 1))
    for k in range(block):
        leads = move[grid[k][:, None] + leads].astype(np.int16)
    # functions of all blocks up to each one, by doubling
    step = 1
    while step < rows:
        leads[step:] = np.take_along_axis(leads[step:], leads[:-step].copy(), axis=1)
        step *= 2
    state = np.r_[np.int16(FREE), leads[:-1, FREE]].astype(np.int16)
    found = np.empty((block, rows), bool)
    for k in range(block):
        at = grid[k] + state
        found[k] = start[at]
        state = move[at].astype(np.int16)
    starts = found.T.ravel()[:n]
    starts[firsts] = True
    return np.flatnonzero(starts)


class Encoder:
    """Ids of pieces by merging the adjacent pair of lowest rank until none is left."""

    def __init__(self, vocabulary: bytes):
        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines()) if a}
        self.cache: dict[str, tuple[int, ...]] = {}

    def merge(self, piece: bytes) -> tuple[int, ...]:
        ranks = self.ranks
        if (whole := ranks.get(piece)) is not None:
            return (whole,)
        n = len(piece)
        ends, after, before = list(range(1, n + 1)), list(range(1, n + 1)), list(range(-1, n - 1))
        waiting = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(waiting)
        while waiting:
            _, i, end = heapq.heappop(waiting)
            j = after[i] if ends[i] else n
            if not ends[i] or j >= n or ends[j] != end:
                continue  # one of the two has been merged since
            ends[i], ends[j] = end, 0
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := ranks.get(piece[i : ends[k]])) is not None:
                    heapq.heappush(waiting, (r, i, ends[k]))
            if (h := before[i]) >= 0 and (r := ranks.get(piece[h:end])) is not None:
                heapq.heappush(waiting, (r, h, end))
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : ends[i]]])
            i = after[i]
        return tuple(out)

    def ids(self, piece: str) -> tuple[int, ...]:
        found = self.cache.get(piece)
        if found is None:
            if len(self.cache) >= CACHE:
                self.cache.clear()
            found = self.merge(piece.encode("utf-8", "surrogatepass"))
            if len(piece) <= 64:
                self.cache[piece] = found
        return found

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(offsets of each text's ids, all ids)."""
        texts = [x or "" for x in texts]
        whole = "".join(texts)
        points = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
        begins = np.r_[0, np.cumsum([len(x) for x in texts])].astype(np.int64)
        starts = piece_starts(points, np.unique(begins[:-1][np.diff(begins) > 0]))
        bounds = starts.tolist()
        get, ids = self.cache.get, self.ids
        found = [get(p) or ids(p) for p in map(lambda a, b: whole[a:b], bounds, [*bounds[1:], len(whole)])]
        counts = np.r_[0, np.cumsum(np.fromiter(map(len, found), np.int64, len(found)))]
        return counts[np.searchsorted(starts, begins)], np.fromiter(chain.from_iterable(found), np.int32, int(counts[-1]))


@lru_cache(2)
def _encoder(vocabulary: bytes) -> Encoder:
    return Encoder(vocabulary)


def read_vocabulary(path: str = VOCABULARY) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encode(rows: DataFrame, key: str, text: str, vocabulary: str = VOCABULARY, offsets: bool = False) -> DataFrame:
    """(key, ids), one row per row of the input; with `offsets` also the byte at which each token starts in the text."""
    shared = rows.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))  # one file, under 1 MB
    schema = T.StructType([T.StructField(key, rows.schema[key].dataType), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    if offsets:
        schema = schema.add("offsets", T.ArrayType(T.IntegerType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared.value)
        sizes = np.zeros(max(encoder.ranks.values()) + 1, np.int32)
        for piece, i in encoder.ranks.items():
            sizes[i] = len(piece)
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                ends, ids = encoder.encode(part.column(1).to_pylist())
                columns = [part.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32()))]
                if offsets:
                    before = np.r_[0, np.cumsum(sizes[ids], dtype=np.int64)]
                    inside = before[:-1] - np.repeat(before[ends[:-1]], np.diff(ends))
                    columns.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(inside.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return spread(rows.select(key, text)).mapInArrow(run, schema)


def decode(rows: DataFrame, key: str, ids: str = "ids", vocabulary: str = VOCABULARY) -> DataFrame:
    """(key, text): the bytes of the tokens as text; null ids give a null text, bytes that aren't UTF-8 are replaced."""
    shared = rows.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))
    schema = T.StructType([T.StructField(key, rows.schema[key].dataType), T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = {i: p for p, i in _encoder(shared.value).ranks.items()}
        for batch in batches:
            texts = [None if x is None else b"".join(map(pieces.__getitem__, x)).decode("utf-8", "replace") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=schema.names)

    ship(rows.sparkSession)
    return rows.select(key, ids).mapInArrow(run, schema)
