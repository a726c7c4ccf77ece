"""Held-out passages inside a training corpus, found by q-gram filtering and verified by alignment.

Texts are brought to words (compatibility form, case folded, without format characters). A passage is a run of `words` consecutive words of an item; a document region
within `errors` edits of a passage of length L shares at least L - q + 1 - q * errors of its q-grams with it (q-gram lemma), all of them
on `2 * errors + 1` neighbouring diagonals. So shared q-grams are counted in bands of diagonals, each overlapping the next; bands that
reach the bound are kept as regions, and these are verified by an alignment inside the band, for all passages of all regions at once; without errors the band is one diagonal wide.
q is chosen so that the bound is at least 1 for every passage, which makes the filter lossless.

Items are read in blocks of at most BLOCK characters, each sent to all executors, where a worker builds its index once; a bigger item table takes more passes, not more memory.

Cases: null, empty and short texts share nothing; repeated documents are each reported; items with equal texts are each reported; rows with a null
id are reported under null; texts of any length are read whole; empty tables give no rows.
"""

from __future__ import annotations

import re
import unicodedata
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlgraph.runtime import ship

#: Characters of item texts per pass.
BLOCK = 8_000_000
#: Characters of documents that are looked at together, and pairs of region and passage that are aligned together.
CHUNK, PAIRS = 2_000_000, 200_000
Q = 32
_WORD = re.compile(r"[^\W_]+")
_BASE = np.uint64(0x9E3779B97F4A7C15)


@lru_cache(1)
def _format_characters() -> dict[int, None]:
    return {c: None for c in range(0x110000) if unicodedata.category(chr(c)) == "Cf"}


def plain(text: str | None) -> str:
    """The words in comparable form, each with a blank before and after."""
    if not text:
        return ""
    if text.isascii():
        text = text.lower()
    else:
        drop = _format_characters()
        text = unicodedata.normalize("NFKC", text.translate(drop)).casefold()
        text = unicodedata.normalize("NFKC", text).translate(drop)
    words = _WORD.findall(text)
    return f" {' '.join(words)} " if words else ""


def q_hashes(codes: np.ndarray, q: int) -> np.ndarray:
    """Polynomial hash of the q codes from each position, by doubling; only positions with q codes after them."""
    n = len(codes) - q + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    power, width, part = _BASE, 1, codes.astype(np.uint64) + np.uint64(1)
    done, have = None, 0
    with np.errstate(over="ignore"):
        while True:
            if q & width:
                done = part if done is None else _join(done, have, part, power)
                have += width
            width *= 2
            if width > q:
                break
            half = width // 2
            part, power = part[: len(part) - half] * power + part[half:], power * power
    return done[:n] * np.uint64(0xFF51AFD7ED558CCD)


def _join(done: np.ndarray, have: int, part: np.ndarray, power: np.uint64) -> np.ndarray:
    tail = part[have:]
    m = min(len(done), len(tail))
    return done[:m] * power + tail[:m]


def codes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


@dataclass
class Passages:
    """The q-gram index of a block of items."""

    ids: list
    texts: list[str]
    words: int
    errors: int
    q: int = 0
    codes: list[np.ndarray] = field(default_factory=list)

    def __post_init__(self) -> None:
        lengths = []
        for text in self.texts:
            blanks = np.flatnonzero(codes_of(text) == 0x20)
            spans = blanks[self.words :] - blanks[: -self.words] + 1 if len(blanks) > self.words else np.empty(0, int)
            lengths.append(int(spans.min()) if len(spans) else 0)
        shortest = min((n for n in lengths if n), default=0)
        # L - q + 1 - q * errors >= 1
        self.q = max(1, min(Q, shortest // (self.errors + 1)))
        self.bounds = np.array([n - self.q + 1 - self.q * self.errors if n else np.iinfo(np.int32).max for n in lengths])
        self.codes = [codes_of(t) if n else np.empty(0, np.uint32) for t, n in zip(self.texts, lengths)]
        grams, at, of = [], [], []
        for i, codes in enumerate(self.codes):
            h = q_hashes(codes, self.q)
            grams.append(h), at.append(np.arange(len(h))), of.append(np.full(len(h), i))
        grams = np.concatenate(grams) if grams else np.empty(0, np.uint64)
        order = np.argsort(grams, kind="stable")
        self.grams = grams[order]
        self.at = (np.concatenate(at) if at else np.empty(0, int))[order]
        self.of = (np.concatenate(of) if of else np.empty(0, int))[order]
        # places for four times the grams, so that three of four foreign grams are told apart without a search
        self.shift = np.uint64(64 - min(30, max(10, int(4 * len(self.grams)).bit_length())))
        self.seen = np.zeros(1 << int(64 - self.shift), bool)
        self.seen[self.grams >> self.shift] = True
        # the passages of all items one after another
        self.begins = np.cumsum([0, *(len(c) for c in self.codes)])
        self.all = np.concatenate([*self.codes, np.empty(0, np.uint32)])
        firsts = [np.flatnonzero(c == 0x20) for c in self.codes]
        self.first = [f[: -self.words] if len(f) > self.words else np.empty(0, int) for f in firsts]
        self.length = [f[self.words :] - f[: -self.words] + 1 if len(f) > self.words else np.empty(0, int) for f in firsts]

    def regions(self, codes: np.ndarray, document: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Documents, items and lowest diagonals of bands that reach the bound, and the places in the items of the grams that they share, see `passages`.

        codes: concatenated documents, document: index of each code's.
        """
        none = (np.empty(0, np.int64),) * 4
        h = q_hashes(codes, self.q)
        at = np.flatnonzero(self.seen[h >> self.shift])
        low, high = np.searchsorted(self.grams, h[at], "left"), np.searchsorted(self.grams, h[at], "right")
        n = high - low
        at, low, n = at[n > 0], low[n > 0], n[n > 0]
        if not len(at):
            return none
        at = np.repeat(at, n)
        entry = np.repeat(low - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(int(n.sum()))
        item, diagonal = self.of[entry], at - self.at[entry]
        keep = document[at] == document[np.minimum(at + self.q - 1, len(document) - 1)]
        doc, item, diagonal, place = document[at[keep]], item[keep], diagonal[keep], at[keep] - diagonal[keep]
        order = np.lexsort((diagonal, item, doc))
        doc, item, diagonal, place = doc[order], item[order], diagonal[order], place[order]
        if not len(doc):
            return none
        width = 2 * self.errors
        group = np.r_[0, np.cumsum((np.diff(doc) != 0) | (np.diff(item) != 0))]
        key = group.astype(np.int64) * (1 << 40) + (diagonal - diagonal.min())
        counts = np.searchsorted(key, key + width, "right") - np.arange(len(key))  # the band that begins at each hit
        new = np.r_[True, np.diff(key) != 0]
        i = np.flatnonzero(new & (counts >= self.bounds[item]))
        # an alignment's diagonals differ by at most `errors`, so those of one with a gram on this diagonal are no farther from it
        n = counts[i]
        shared = np.repeat(i - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(int(n.sum())) if len(i) else np.empty(0, np.int64)
        places = np.sort((np.repeat(np.arange(len(i)), n) << 32) + place[shared])
        return doc[i], item[i], diagonal[i], places

    def aligned(self, codes: np.ndarray, low: np.ndarray, high: np.ndarray, item: np.ndarray, diagonal: np.ndarray, places: np.ndarray) -> np.ndarray:
        """For each region whether some passage of its item lies within `errors` edits of a piece of codes[low:high] inside the band around the diagonal.

        Only passages that share as many grams with the band as their own length asks are aligned. places: of the shared grams, with the region's number in the upper half.
        """
        hit = np.zeros(len(item), bool)
        n = np.array([len(self.first[i]) for i in item], np.int64)
        at = 0
        while at < len(item):
            till = max(at + 1, int(np.searchsorted(np.cumsum(n[at:]), PAIRS, "right")) + at)
            region = np.repeat(np.arange(at, till), n[at:till])
            first = np.concatenate([self.first[i] for i in item[at:till]])
            length = np.concatenate([self.length[i] for i in item[at:till]])
            base = (region << 32) + first
            shared = np.searchsorted(places, base + length - self.q, "right") - np.searchsorted(places, base, "left")
            enough = shared >= length - self.q + 1 - self.q * self.errors
            region, first, length = region[enough], first[enough], length[enough]
            found = self._within(codes, low[region], high[region], self.begins[item[region]] + first, first + diagonal[region] - self.errors, length)
            hit[region[found]] = True
            at = till
        return hit

    def _within(self, codes: np.ndarray, low: np.ndarray, high: np.ndarray, own: np.ndarray, begin: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Indexes of the passages, of `length` codes from `own` on, that lie within `errors` edits of a piece of the text on the diagonals from `begin` on."""
        e, alive, done = self.errors, np.arange(len(own)), []
        band = np.arange(2 * e + 1)
        # cost[d]: least edits of the passage so far ending on the band's diagonal d; a piece may begin on any
        cost, far = np.zeros((len(own), 2 * e + 1), np.int16), np.int16(e + 1)
        for i in range(int(length.max(initial=0))):
            at = (begin[alive] + i)[:, None] + band
            inside = (at >= low[alive, None]) & (at < high[alive, None])
            equal = inside & (codes[np.clip(at, 0, len(codes) - 1)] == self.all[own[alive] + i][:, None])
            step = cost + np.where(equal, 0, np.where(inside, 1, far)).astype(np.int16)
            for d in range(2 * e, 0, -1):
                np.minimum(step[:, d - 1], cost[:, d] + 1, out=step[:, d - 1])
            for d in range(1, 2 * e + 1):
                np.minimum(step[:, d], step[:, d - 1] + 1, out=step[:, d])
            within = step.min(1) <= e
            ended = length[alive] == i + 1
            done.append(alive[within & ended])
            going = within & ~ended
            alive, cost = alive[going], step[going]
            if not len(alive):
                break
        return np.concatenate([*done, np.empty(0, np.int64)])


#: Indexes that this worker has built, by broadcast; the last few are kept.
_BUILT: dict[tuple, Passages] = {}


def built(name: int, value, words: int, errors: int) -> Passages:
    """The index of a broadcast block of items, built once per worker process."""
    key = (name, words, errors)
    if key not in _BUILT:
        while len(_BUILT) >= 2:
            _BUILT.pop(next(iter(_BUILT)))
        _BUILT[key] = Passages(*value, words, errors)
    return _BUILT[key]


def leaks(documents: DataFrame, items: DataFrame, document_id: str = "doc_id", item_id: str = "item_id", text: str = "text", words: int = 12, errors: int = 0) -> DataFrame:
    """(document_id, item_id) of documents that hold `words` consecutive words of an item within `errors` edits; 0 means the same words."""
    schema = T.StructType([T.StructField(document_id, documents.schema[document_id].dataType), T.StructField(item_id, items.schema[item_id].dataType)])
    spark = documents.sparkSession
    ship(spark)
    items = items.where(F.col(text).isNotNull()).select(item_id, text)
    size = items.agg(F.sum(F.length(text))).first()[0] or 0
    passes = max(1, -(-size // BLOCK))
    found = None
    for k in range(passes):
        block = items.where(F.pmod(F.xxhash64(item_id, text), F.lit(passes)) == k).collect()
        one = _search(documents, [r[0] for r in block], [plain(r[1]) for r in block], document_id, text, words, errors, schema)
        found = one if found is None else found.unionByName(one)
    return found if found is not None else spark.createDataFrame([], schema)


def _search(documents: DataFrame, ids: list, texts: list[str], document_id: str, text: str, words: int, errors: int, schema: T.StructType) -> DataFrame:
    shared = documents.sparkSession.sparkContext.broadcast((ids, texts))

    name = uuid.uuid4().int

    def look(passages: Passages, keys: list, texts: list[str]) -> list[tuple[int, int]]:
        lengths = [len(t) for t in texts]
        codes = codes_of("".join(texts))
        begins = np.r_[0, np.cumsum(lengths)]
        doc, item, diagonal, places = passages.regions(codes, np.repeat(np.arange(len(texts)), lengths))
        hit = passages.aligned(codes, begins[doc], begins[doc + 1], item, diagonal, places)
        return [(keys[d], passages.ids[i]) for d, i in sorted(set(zip(doc[hit].tolist(), item[hit].tolist())))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passages = built(name, shared.value, words, errors)
        for batch in batches:
            found, keys, held, n = [], [], [], 0
            for key, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                keys.append(key), held.append(plain(raw))
                n += len(held[-1])
                if n > CHUNK:
                    found += look(passages, keys, held)
                    keys, held, n = [], [], 0
            found += look(passages, keys, held) if keys else []
            yield pa.RecordBatch.from_pydict({document_id: [x[0] for x in found], schema.names[1]: [x[1] for x in found]}, schema=_arrow(schema))

    return documents.where(F.col(text).isNotNull()).select(document_id, text).mapInArrow(run, schema).distinct()


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)
