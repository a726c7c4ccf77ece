"""Personal information in free text: found by a character BiLSTM-CRF and replaced by typed placeholders.

`fit` trains the tagger from labelled spans. Labels are the exact forms of `pii_grammar` in at most about SAMPLE documents, chosen by hash, which uses the listed contacts (at most
CONTACTS rows, also by hash). Both bounds limit what is learned from, never what is read. Windows around spans are repeated with other values of the same type
in their place, so that forms and surroundings are learned rather than values. WORKERS tasks train side by side on their own windows and meet in the middle of their weights
after each of ROUNDS rounds; windows that go badly are drawn more often. Where the caller names a place for them, the fitted weights are published there under a hash of
what they were learned from, and read by whoever would learn from the same.

`find` reads every document whole. It is cut into even windows of at most WINDOW characters that overlap by OVERLAP or more; two windows
meet in the middle of what they share, which joins their decodings to one. What the tagger reports, span and type, is the result: bounds inside a word move to the
word's edge, surrounding punctuation is trimmed, and a span that can't be of its type at all (a phone number without digits) is dropped. No form or list is asked.

Cases: null and blank texts have no spans; texts of any length and script are read; repeated documents each have theirs; overlapping spans don't occur; with no
contacts or no labelled document the tagger learns from what there is, and what can't be told is not found.
"""

from __future__ import annotations

import hashlib
import pickle
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlgraph.llm.pii_grammar import TYPES, Names, candidates
from marlgraph.llm.spread import spread
from marlgraph.llm.tagger import HIDDEN, Tagger, symbols_of
from marlgraph.runtime import VersionedTable, ship

#: Documents from which labels are taken, and rows of contacts from which they are made.
SAMPLE, CONTACTS = 6_000, 100_000
#: Training: tasks, rounds, steps of a task in a round, windows drawn for a step; windows of a task at most, and their length.
WORKERS, ROUNDS, STEPS, DRAWN = 8, 6, 200, 32
POOL, LENGTH = 9_000, 96
WINDOW, OVERLAP = 256, 48
#: Windows that are tagged together.
BATCH = 1_024
TAGS = 1 + 2 * len(TYPES)

Span = tuple[int, int, str]


# --- learning ---------------------------------------------------------------------------------------------------------------------------


def windows_of(texts: list[str], names: Names, people: list[tuple[str, str]], seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(symbols, tags) of labelled windows: every text tiled, and windows around spans with the values of some exchanged for others."""
    rng = np.random.default_rng(seed)
    labelled = [(t, candidates(t, names)) for t in texts if t]
    values: dict[str, list[str]] = {k: [] for k in TYPES}
    for text, spans in labelled:
        for a, b, kind in spans:
            values[kind].append(text[a:b])

    def another(kind: str) -> str:
        if kind == "person_name" and people and rng.random() < 0.6:
            (g, _), (_, f) = people[rng.integers(len(people))], people[rng.integers(len(people))]
            initial, form = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"[rng.integers(26)], rng.integers(6)
            name = [f"{g} {f}", f"{g} {f}", f"{f}, {g}", f"{initial}. {f}", f"{g} {initial}. {f}", f"{g} {f}-{people[rng.integers(len(people))][1]}"][form]
            return name.upper() if form < 2 and rng.random() < 0.2 else name
        value = values[kind][rng.integers(len(values[kind]))]
        return "".join(str(rng.integers(10)) if c.isdigit() and rng.random() < 0.5 else c for c in value)

    def exchanged(text: str, spans: list[Span], j: int) -> tuple[str, list[Span]]:
        """Other values in the place of span j and of its neighbours."""
        parts, moved, at, shift = [], [], 0, 0
        for k, (a, b, kind) in enumerate(spans):
            new = another(kind) if abs(k - j) <= 2 else text[a:b]
            parts += [text[at:a], new]
            moved.append((a + shift, a + shift + len(new), kind))
            shift += len(new) - (b - a)
            at = b
        return "".join([*parts, text[at:]]), moved

    tiles = [(i, at) for i, (t, _) in enumerate(labelled) for at in range(-int(rng.integers(LENGTH // 2)), len(t), LENGTH - 16)]
    spots = [(i, j) for i, (_, spans) in enumerate(labelled) for j in range(len(spans))]
    around = min(POOL // 2, 6 * len(spots))
    if len(tiles) > POOL - around:
        tiles = [tiles[k] for k in np.sort(rng.choice(len(tiles), POOL - around, replace=False))]
    x, y = np.zeros((len(tiles) + around, LENGTH), np.int16), np.zeros((len(tiles) + around, LENGTH), np.int8)
    for w in range(len(x)):
        if w < len(tiles):
            (i, begin), (text, spans) = tiles[w], labelled[tiles[w][0]]
        else:
            i, j = spots[rng.integers(len(spots))]
            text, spans = labelled[i]
            if w % 4:
                text, spans = exchanged(text, spans, j)
            a, b, _ = spans[j]
            begin = a - int(rng.integers(0, LENGTH - min(LENGTH - 1, b - a)))
        begin = max(0, begin)
        piece = text[begin : begin + LENGTH]
        x[w, : len(piece)] = symbols_of(piece)
        for a, b, kind in spans:
            a, b = a - begin, b - begin
            if b > 0 and a < len(piece):
                tag = 1 + 2 * TYPES.index(kind)
                y[w, max(a, 0) : min(b, LENGTH)] = tag + 1
                if a >= 0:
                    y[w, a] = tag
    return x, y


def train_round(state: tuple[dict, dict] | None, x: np.ndarray, y: np.ndarray, worker: int, round_: int, steps: int = STEPS, rounds: int = ROUNDS, hidden: int = HIDDEN) -> tuple[dict, dict]:
    """A task's share of a round: (weights, moments) after `steps` steps from the common start, with badly read windows drawn more often."""
    tagger = Tagger(TAGS, hidden)
    moments = None
    if state is not None:
        tagger.p, moments = {k: v.copy() for k, v in state[0].items()}, {k: tuple(m.copy() for m in v) for k, v in state[1].items()}
    weights = np.ones(len(x))
    if round_ >= 1:
        weights = 0.05 + np.minimum(tagger.losses(x, y), 4.0)
    moments = tagger.train(x, y, steps, round_ * steps, rounds * steps, DRAWN, seed=1000 * round_ + worker, weights=weights, moments=moments)
    return tagger.p, moments


def _tagger(parameters: dict | None, hidden: int = HIDDEN) -> Tagger:
    tagger = Tagger(TAGS, hidden)
    if parameters is not None:
        tagger.p = parameters
    return tagger


def fit(texts: list[str], contacts: list[tuple], steps: int = STEPS, rounds: int = ROUNDS) -> Tagger:
    """The same training in this process by one worker, for texts at hand. contacts: (given name, family name[, company])."""
    x, y = windows_of(sorted(set(texts)), Names(contacts), [(c[0], c[1]) for c in contacts if c[0] and c[1]], 0)
    state = None
    for r in range(rounds if len(x) else 0):
        state = train_round(state, x, y, 0, r, steps, rounds)
    return _tagger(state and state[0])


def fit_on(documents: DataFrame, contacts: DataFrame, text: str = "text", steps: int = STEPS, rounds: int = ROUNDS, keep: str | None = None) -> Recogniser:
    """Trains on a sample of about SAMPLE distinct texts, chosen by their hash alone, so that it doesn't depend on order. keep: folder of fitted weights, where those learned from the same are read."""
    spark = documents.sparkSession
    ship(spark)
    rows = documents.where(F.length(text) > 0).select(F.col(text).alias("t"), F.xxhash64(text).alias("h"))
    share = int(min(1.0, SAMPLE / max(1, rows.agg(F.approx_count_distinct("h", 0.02)).first()[0])) * (1 << 30))
    some = rows.where(F.pmod("h", F.lit(1 << 30)) < share).dropDuplicates(["h"])
    listed = contacts.where("family_name <> ''").select("given_name", "family_name", (F.col("company") if "company" in contacts.columns else F.lit(None).cast("string")).alias("company")).distinct()
    known = listed.withColumn("h", F.xxhash64("given_name", "family_name", "company")).orderBy("h", "family_name", "given_name", "company").limit(CONTACTS).drop("h").collect()
    people = [tuple(r) for r in known]

    store = None
    if keep:
        facts = some.agg(F.count("*"), F.bit_xor("h"), F.sum(F.pmod("h", F.lit(1_000_003)))).first()
        learned_from = hashlib.sha256(repr((tuple(facts), people, steps, rounds, WORKERS, POOL, LENGTH, DRAWN, HIDDEN)).encode())
        store = VersionedTable(spark, f"{keep.rstrip('/')}/{learned_from.hexdigest()[:24]}")
        if (kept := store.read()) is not None:
            return Recogniser(_tagger(pickle.loads(kept.first()["model"])))

    def prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, worker = [], 0
        for batch in batches:
            texts += batch.column(0).to_pylist()
            worker = batch.column(1)[0].as_py() if batch.num_rows else worker
        if texts:
            x, y = windows_of(sorted(texts), Names(people), [(g, f) for g, f, _ in people if g], worker)
            yield pa.RecordBatch.from_pydict({"worker": pa.array([worker], pa.int32()), "windows": [zlib.compress(pickle.dumps((x, y)), 1)]})

    shares = some.select("t", F.pmod(F.xxhash64(F.lit("worker"), "t"), F.lit(WORKERS)).cast("int").alias("worker")).repartitionById(WORKERS, F.col("worker"))
    # at most WORKERS rows of POOL windows, 3 bytes a character: 21 MB before compression
    windows = {r["worker"]: r["windows"] for r in shares.mapInArrow(prepare, "worker int, windows binary").collect()}
    state = None
    if windows:
        pool = spark.sparkContext.broadcast(windows)
        tasks = spark.range(0, WORKERS, 1, WORKERS)
        for r in range(rounds):
            start = spark.sparkContext.broadcast(pickle.dumps(state))

            def learn(batches: Iterator[pa.RecordBatch], start=start, r=r) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    for worker in batch.column(0).to_pylist():
                        if worker in pool.value:
                            x, y = pickle.loads(zlib.decompress(pool.value[worker]))
                            yield pa.RecordBatch.from_pydict({"worker": [worker], "state": [pickle.dumps(train_round(pickle.loads(start.value), x, y, worker, r, steps, rounds))]})

            # WORKERS rows of about 300 KB
            parts = sorted(tasks.mapInArrow(learn, "worker long, state binary").collect())
            state = Tagger.mean([pickle.loads(p["state"]) for p in parts])
            start.unpersist()
        pool.unpersist()
    if store is not None:
        store.replace(spark.createDataFrame([(pickle.dumps(state and state[0]),)], "model binary"))
    return Recogniser(_tagger(state and state[0]))


# --- reading ----------------------------------------------------------------------------------------------------------------------------


def proposals(tagger: Tagger, texts: list[str]) -> list[list[Span]]:
    """Spans of each text as the tagger sees them."""
    marks = [symbols_of(t) for t in texts]
    tags = [np.zeros(len(m), np.int8) for m in marks]
    windows = []  # (length, text, begin, first and last position whose tags it gives)
    for i, m in enumerate(marks):
        if not len(m):
            continue
        n = max(1, -(-(len(m) - OVERLAP) // (WINDOW - OVERLAP)))
        size = -(-(len(m) + (n - 1) * OVERLAP) // n)
        begins = [k * (len(m) - size) // max(1, n - 1) for k in range(n)]
        borders = [0, *((b + a + size) // 2 for a, b in zip(begins, begins[1:])), len(m)]
        windows += [(size, i, b, borders[k], borders[k + 1]) for k, b in enumerate(begins)]
    windows.sort()  # those of a batch have about one length
    for first in range(0, len(windows), BATCH):
        part = windows[first : first + BATCH]
        x = np.zeros((len(part), part[-1][0]), np.int16)
        for r, (size, i, at, _, _) in enumerate(part):
            x[r, :size] = marks[i][at : at + size]
        found = tagger.decode(x)
        for r in np.flatnonzero(found.any(1)):
            _, i, at, low, high = part[r]
            tags[i][low:high] = found[r, low - at : high - at]
    out = []
    for t in tags:
        kind = (t + 1) // 2
        edge = np.flatnonzero(np.r_[True, (kind[1:] != kind[:-1]) | ((t[1:] % 2 == 1) & (t[1:] > 0))]) if len(t) else np.empty(0, int)
        out.append([(int(a), int(b), TYPES[kind[a] - 1]) for a, b in zip(edge, [*edge[1:], len(t)]) if kind[a]])
    return out


#: What a value of each type has at least. Fixed values.
AT_LEAST = {"email": re.compile(r"[@＠]|\b(?:at|AT)\b"), "phone": re.compile(r"(?:\d\D*){7}"), "id_number": re.compile(r"(?:\d\D*){4}"), "street_address": re.compile(r"\d.*[^\W\d_]{2}|[^\W\d_]{2}.*\d", re.S), "person_name": re.compile(r"[^\W\d_].*[^\W\d_]{2}", re.S)}
#: Punctuation that may begin a value of each type; others are trimmed. Fixed values.
OPENING = {"phone": "+("}
_INITIAL = re.compile(r"(?<![^\W_])[^\W\d_]\.$")


def tidy(text: str, spans: list[Span]) -> list[Span]:
    """Spans at the edges of words, without surrounding punctuation; those that can't be of their type are left out. Spans of one type that meet inside a word are one."""
    out: list[Span] = []
    for a, b, kind in spans:
        last = out[-1][1] if out else 0
        while a > last and text[a - 1].isalnum() and text[a].isalnum():
            a -= 1
        while b < len(text) and text[b].isalnum() and text[b - 1].isalnum():
            b += 1
        if a < last:  # the word at the border went to the span before
            a = out.pop()[0] if out[-1][2] == kind else last
        while a < b and not (text[a].isalnum() or text[a] in OPENING.get(kind, "")):
            a += 1
        while b > a and not text[b - 1].isalnum() and not (text[b - 1] == ")" and "(" in text[a:b]) and not (kind == "person_name" and _INITIAL.search(text[a:b])):
            b -= 1
        if AT_LEAST[kind].search(text[a:b]):
            out.append((a, b, kind))
    return out


class Recogniser:
    """A fitted tagger, as sent to the executors (about 100 KB)."""

    def __init__(self, tagger: Tagger):
        self.tagger = tagger

    def spans(self, texts: list[str | None]) -> list[list[Span]]:
        texts = [t or "" for t in texts]
        return [tidy(t, p) if p else [] for t, p in zip(texts, proposals(self.tagger, texts))]


def _apply(documents: DataFrame, recogniser: Recogniser, key: str, text: str, schema: T.StructType, rows_of: Callable) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_schema

    shared = documents.sparkSession.sparkContext.broadcast(pickle.dumps(recogniser))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, shape = pickle.loads(shared.value), to_arrow_schema(schema)
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                texts = part.column(1).to_pylist()
                rows = [r for k, t, s in zip(part.column(0).to_pylist(), texts, own.spans(texts)) for r in rows_of(k, t, s)]
                yield pa.RecordBatch.from_pydict({n: [r[i] for r in rows] for i, n in enumerate(shape.names)}, schema=shape)

    return spread(documents.select(key, text)).mapInArrow(run, schema)


def find(documents: DataFrame, recogniser: Recogniser, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, pii_type, pii_text, begin, end), one row per span."""
    schema = T.StructType([T.StructField(key, documents.schema[key].dataType)]).add("pii_type", "string").add("pii_text", "string").add("begin", "integer").add("end", "integer")
    return _apply(documents.where(F.length(text) > 0), recogniser, key, text, schema, lambda k, t, s: [(k, kind, t[a:b], a, b) for a, b, kind in s])


def redact(documents: DataFrame, recogniser: Recogniser, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, text) with each span replaced by its type in square brackets; the rest stays as it is, null stays null."""
    schema = T.StructType([T.StructField(key, documents.schema[key].dataType)]).add("text", "string")

    def rows_of(k, t, spans):
        parts, at = [], 0
        for a, b, kind in spans:
            parts += [t[at:a], f"[{kind.upper()}]"]
            at = b
        return [(k, None if t is None else "".join([*parts, t[at:]]))]

    return _apply(documents, recogniser, key, text, schema, rows_of)
