"""The most similar vectors of every vector, by vantage-point trees per shard.

A small tree of vantage points, fitted per domain on a bounded sample, divides each domain into shards of about CAPACITY vectors. A shard that comes out larger, as in domains too
big for the sample, is divided by a tree of its own, fitted where the shard's sample is; the shards' trees grow by 260 bytes a shard. Inside a shard a second tree
is built over all its vectors. All are searched with the triangle inequality: beyond |d(q, v) - median| > factor * radius the
other side is skipped. At factor 1 nothing within the radius can be missed; smaller factors search less at some loss, since in many dimensions
a near vector's distance to a vantage point differs from the query's by far less than the inequality allows.

First every vector searches its own shard; the distance of its k-th neighbour there (at most the given maximum) is then the radius with which it visits
others. A visit serves both sides: the members of the visited shard also take the visitor as a candidate. A shard with many visitors receives them in parts, each of which meets
all members. Every vector is indexed and is a query.

Exact copies of a vector are one unit with its k + 1 smallest ids, so a group of any number of copies is searched once and each copy
gets its k neighbours by one join; no list grows with the group.

Cases: rows with a null domain or id, or a vector that is null, of another length, all zeros or holds NaN, null or infinity take no part; repeated rows of an
entity count once (of different vectors the smallest); ties in distance go to the smaller id; domains with one vector and empty tables give no rows.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marlgraph.runtime import materialize, ship

#: Vectors of a shard, and of a leaf of a shard's own tree.
CAPACITY, LEAF = 8_192, 512
#: Vectors on which the trees over shards are fitted: so many for each shard needed, and at most SAMPLE of all domains together (26 MB at 64 dimensions).
PER_SHARD, SAMPLE = 64, 100_000
#: Visitors of a shard that are looked at together, in capacities; one in so many vectors tells how many there will be.
VISITORS, COUNTED = 4, 64
FACTOR = 0.15


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = (a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * (a @ b.T)
    return np.sqrt(np.maximum(d, 0))


@dataclass
class Tree:
    """A vantage-point tree. Node i has children 2i + 1 and 2i + 2; below `inner` nodes are leaves, numbered from 0."""

    points: np.ndarray
    medians: np.ndarray

    @classmethod
    def fit(cls, x: np.ndarray, leaves: int, seed: int = 1) -> Tree:
        """leaves: a power of two. The vantage point of a node is that of a few candidates whose distances spread most."""
        rng, dim, inner = np.random.default_rng(seed), x.shape[1], leaves - 1
        points, medians = np.zeros((inner, dim), np.float32), np.zeros(inner, np.float32)
        parts = {0: x}
        for i in range(inner):
            part = parts.pop(i)
            if len(part):
                some = part[rng.integers(0, len(part), 8)]
                d = distances(part, some)
                best = int(d.std(0).argmax())
                points[i], d = some[best], d[:, best]
                medians[i] = np.median(d)
            else:
                d = np.empty(0, np.float32)
            if 2 * i + 1 < inner:
                parts[2 * i + 1], parts[2 * i + 2] = part[d <= medians[i]], part[d > medians[i]]
        return cls(points, medians)

    @property
    def leaves(self) -> int:
        return len(self.medians) + 1

    def home(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each vector."""
        node = np.zeros(len(x), np.int64)
        for _ in range(self.leaves.bit_length() - 1):
            d = np.sqrt(((x - self.points[node]) ** 2).sum(1))
            node = 2 * node + 1 + (d > self.medians[node])
        return node - len(self.medians)

    def visits(self, x: np.ndarray, margin: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(leaf, indexes of the vectors that must search it), where a side is skipped if it is farther away than the vector's margin."""
        waiting = [(0, np.arange(len(x)))]
        while waiting:
            node, who = waiting.pop()
            if not len(who):
                continue
            if node >= len(self.medians):
                yield node - len(self.medians), who
                continue
            gap = np.sqrt(((x[who] - self.points[node]) ** 2).sum(1)) - self.medians[node]
            waiting += [(2 * node + 1, who[gap <= margin[who]]), (2 * node + 2, who[gap > -margin[who]])]


@dataclass
class Routing:
    """A domain's tree of shards and the trees of shards that had to be divided. A shard's number is the leaf's, times SPREAD, plus that in the leaf's own tree."""

    top: Tree
    below: dict[int, Tree]

    SPREAD = 1 << 20

    @property
    def shards(self) -> int:
        return self.top.leaves + sum(t.leaves - 1 for t in self.below.values())

    def home(self, x: np.ndarray) -> np.ndarray:
        leaf = self.top.home(x)
        out = leaf * self.SPREAD
        for i in np.intersect1d(leaf, list(self.below)) if self.below else ():
            own = np.flatnonzero(leaf == i)
            out[own] += self.below[int(i)].home(x[own])
        return out

    def visits(self, x: np.ndarray, margin: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        for leaf, who in self.top.visits(x, margin):
            if leaf not in self.below:
                yield leaf * self.SPREAD, who
                continue
            for sub, some in self.below[leaf].visits(x[who], margin[who]):
                yield leaf * self.SPREAD + sub, who[some]


def _power(n: float) -> int:
    return 1 << max(0, int(np.ceil(np.log2(max(n, 1)))))


class Shard:
    """The vectors of one shard under their own tree."""

    def __init__(self, x: np.ndarray):
        self.x = x
        self.tree = Tree.fit(x, _power(len(x) / LEAF))
        leaf = self.tree.home(x)
        self.members = [np.flatnonzero(leaf == i) for i in range(self.tree.leaves)]

    def search(self, q: np.ndarray, own: np.ndarray | None, k: int, limit: np.ndarray, factor: float) -> tuple[np.ndarray, np.ndarray]:
        """(distances, members) of the k nearest of each query, inf and -1 where fewer lie within the limit. own: the query's own place, to be skipped."""
        best, who = np.full((len(q), k), np.inf), np.full((len(q), k), -1, np.int64)

        def look(leaf: int, some: np.ndarray) -> None:
            members = self.members[leaf]
            if not len(members):
                return
            for at in range(0, len(some), 2048):
                part = some[at : at + 2048]
                d = distances(q[part], self.x[members])
                # rounding of the fast form: everything near the limit is kept here and measured below
                row, col = np.nonzero(d <= np.minimum(limit[part], best[part, -1])[:, None] + 1e-3)
                if own is not None:
                    other = members[col] != own[part[row]]
                    row, col = row[other], col[other]
                if not len(row):
                    continue
                exact = np.sqrt(((q[part[row]].astype(np.float64) - self.x[members[col]]) ** 2).sum(1))
                inside = exact <= limit[part[row]]
                row, col, exact = row[inside], col[inside], exact[inside]
                hit = np.unique(row)
                place = np.searchsorted(hit, row)
                rows = np.r_[np.repeat(np.arange(len(hit)), k), place]
                ds = np.r_[best[part[hit]].ravel(), exact]
                ids = np.r_[who[part[hit]].ravel(), members[col]]
                order = np.lexsort((ids, ds, rows))
                rows, ds, ids = rows[order], ds[order], ids[order]
                rank = np.arange(len(rows)) - np.searchsorted(rows, rows)
                kept = rank < k
                best[part[hit[rows[kept]]], rank[kept]], who[part[hit[rows[kept]]], rank[kept]] = ds[kept], ids[kept]

        home = self.tree.home(q)
        for leaf in range(self.tree.leaves):
            look(leaf, np.flatnonzero(home == leaf))
        margin = factor * np.minimum(limit, best[:, -1])
        for leaf, some in self.tree.visits(q, margin):
            look(leaf, some[home[some] != leaf])
        return best, who


def _matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float32, copy=False).reshape(-1, dim)


def usable(rows: DataFrame, dim: int) -> DataFrame:
    """(domain, node_id, vector) of the rows that take part, one per entity and domain."""
    good = (F.size("vector") == dim) & F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("vector", lambda v: v != 0)
    rows = rows.select(F.lower(F.trim("domain")).alias("domain"), F.col("node_id").cast("long").alias("node_id"), F.col("vector").cast("array<float>").alias("vector"))
    return rows.where(F.col("domain").isNotNull() & F.col("node_id").isNotNull() & F.coalesce(good, F.lit(False))).groupBy("domain", "node_id").agg(F.min("vector").alias("vector"))


def nearest(rows: DataFrame, k: int = 5, limit: float = 0.4, dim: int = 64, factor: float = FACTOR, capacity: int = CAPACITY) -> DataFrame:
    """(domain, node_id, neighbour, distance, rank): the k nearest others of the same domain of each entity, as far as they lie within `limit`."""
    spark = rows.sparkSession
    ship(spark)
    points = usable(rows, dim).withColumns({"h1": F.xxhash64("vector"), "h2": F.xxhash64(F.lit(1), "vector")})
    points = materialize(points, "points")
    # a unit is a distinct vector with its k + 1 smallest ids; the ranks are cut before and after the shuffle
    rank = F.row_number().over(Window.partitionBy("domain", "h1", "h2").orderBy("node_id"))
    units = points.withColumn("r", rank).where(F.col("r") <= k + 1).groupBy("domain", "h1", "h2").agg(F.array_sort(F.collect_list("node_id")).alias("ids"), F.first("vector").alias("vector"))
    units = materialize(units.select("domain", F.col("ids")[0].alias("unit"), "ids", "vector", "h1", "h2"), "units")

    trees = spark.sparkContext.broadcast(divided(units, {d: Routing(t, {}) for d, t in fit_routing(units, dim, capacity).items()}, dim, capacity))
    homes = placed(units, trees, dim)
    listed = "domain string, unit long, other long, distance double"

    def at_home(table: pa.Table) -> pa.Table:
        x, ids = _matrix(table.column("vector"), dim), table.column("unit").to_numpy()
        d, who = Shard(x).search(x, np.arange(len(x)), k, np.full(len(x), limit), factor)
        n = (who >= 0).sum(1)
        found = who >= 0
        return pa.table({
            "domain": table.column("domain"), "leaf": table.column("leaf"), "unit": table.column("unit"), "vector": table.column("vector"),
            "radius": pa.array(np.minimum(d[:, -1], limit)),
            "others": pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n)], pa.int32()), pa.array(ids[who[found]], pa.int64())),
            "distances": pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n)], pa.int32()), pa.array(d[found])),
        })

    searched = homes.groupBy("domain", "leaf").applyInArrow(at_home, "domain string, leaf long, unit long, vector array<float>, radius double, others array<long>, distances array<double>")
    searched = materialize(searched, "searched")
    lists = searched.select("domain", "unit", F.explode(F.arrays_zip("others", "distances")).alias("e")).select("domain", "unit", F.col("e.others").alias("other"), F.col("e.distances").alias("distance"))

    if any(tree.shards > 1 for tree in trees.value.values()):

        def leave(batches: Iterator[pa.RecordBatch], parts: dict[tuple[str, int], int]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                names, x = np.array(batch.column("domain").to_pylist(), object), _matrix(batch.column("vector"), dim)
                home, radius, unit = batch.column("leaf").to_numpy(), batch.column("radius").to_numpy(), batch.column("unit").to_numpy()
                for domain in trees.value.keys() & set(names):
                    some = np.flatnonzero(names == domain)
                    for leaf, who in trees.value[domain].visits(x[some], factor * radius[some]):
                        who = some[who]
                        who = who[home[who] != leaf]
                        if len(who):
                            rows = batch.take(pa.array(who))
                            part = (unit[who].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % parts.get((domain, leaf), 1)
                            yield pa.RecordBatch.from_arrays([rows.column("domain"), pa.array(np.full(len(who), leaf)), pa.array(part), *(rows.column(c) for c in ("unit", "vector", "radius"))], names=["domain", "leaf", "part", "unit", "vector", "radius"])

        visitor = "domain string, leaf long, part long, unit long, vector array<float>, radius double"
        going = searched.select("domain", "leaf", "unit", "vector", "radius")
        # shards that get more visitors than are looked at together, told from one vector in COUNTED; a row for each such shard
        counted = going.where(F.pmod(F.xxhash64(F.lit("counted"), "unit"), F.lit(COUNTED)) == 0).mapInArrow(lambda b: leave(b, {}), visitor).groupBy("domain", "leaf").count()
        crowded = counted.where(F.col("count") * COUNTED > VISITORS * capacity).collect()
        parts = spark.sparkContext.broadcast({(r["domain"], r["leaf"]): -(-r["count"] * COUNTED // (VISITORS * capacity)) for r in crowded})
        away = going.mapInArrow(lambda b: leave(b, parts.value), visitor)

        def visit(members: pa.Table, visitors: pa.Table) -> pa.Table:
            names = ["domain", "unit", "other", "distance"]
            if not members.num_rows or not visitors.num_rows:
                return pa.table({"domain": pa.array([], pa.string()), "unit": pa.array([], pa.int64()), "other": pa.array([], pa.int64()), "distance": pa.array([], pa.float64())})
            x, q = _matrix(members.column("vector"), dim), _matrix(visitors.column("vector"), dim)
            ids, guests = members.column("unit").to_numpy(), visitors.column("unit").to_numpy()
            d, who = Shard(x).search(q, None, k, visitors.column("radius").to_numpy(), factor)
            there = who >= 0
            pairs = [(np.repeat(guests, there.sum(1)), ids[who[there]], d[there])]
            # the members' own nearest among the visitors
            back, guest = Shard(q).search(x, None, k, members.column("radius").to_numpy(), factor)
            there = guest >= 0
            pairs.append((np.repeat(ids, there.sum(1)), guests[guest[there]], back[there]))
            unit, other, distance = (np.concatenate(c) for c in zip(*pairs))
            return pa.table([pa.array([members.column("domain")[0].as_py()] * len(unit), pa.string()), pa.array(unit), pa.array(other), pa.array(distance)], names=names)

        def repeat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """The members of each shard once for each part of its visitors."""
            for batch in batches:
                times = np.array([parts.value.get(key, 1) for key in zip(batch.column("domain").to_pylist(), batch.column("leaf").to_pylist())], np.int64)
                who = np.repeat(np.arange(len(times)), times)
                rows = batch.take(pa.array(who))
                part = np.arange(len(who)) - np.repeat(np.r_[0, np.cumsum(times)[:-1]], times) if len(times) else who
                yield pa.RecordBatch.from_arrays([rows.column("domain"), rows.column("leaf"), pa.array(part), *(rows.column(c) for c in ("unit", "vector", "radius"))], names=["domain", "leaf", "part", "unit", "vector", "radius"])

        members = going.mapInArrow(repeat, visitor) if crowded else going.withColumn("part", F.lit(0).cast("long")).select("domain", "leaf", "part", "unit", "vector", "radius")
        keys = ["domain", "leaf", "part"]
        lists = lists.unionByName(members.groupBy(*keys).cogroup(away.groupBy(*keys)).applyInArrow(visit, listed))

    # a unit's nearest other units; both directions of a link that either side found
    both = lists.unionByName(lists.select("domain", F.col("other").alias("unit"), F.col("unit").alias("other"), "distance")).distinct()
    order = Window.partitionBy("domain", "unit").orderBy("distance", "other")
    both = both.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k).drop("r")

    few = units.select("domain", "unit", "ids")
    # entities whose unit has at most k copies: its other copies, then those of the nearest units
    small = few.where(F.size("ids") <= k)
    foreign = both.join(few.withColumnsRenamed({"unit": "other", "ids": "theirs"}), ["domain", "other"]).join(small, ["domain", "unit"])
    foreign = foreign.select("domain", "ids", F.explode(F.expr(f"slice(theirs, 1, {k})")).alias("neighbour"), "distance").select("domain", F.explode("ids").alias("node_id"), "neighbour", "distance")
    twins = small.where(F.size("ids") > 1).select("domain", "ids", F.explode("ids").alias("node_id")).select("domain", "node_id", F.explode("ids").alias("neighbour")).where("node_id <> neighbour").withColumn("distance", F.lit(0.0))
    # entities of larger units: k of its k + 1 smallest ids, by one join
    keyed = units.where(F.size("ids") > k).select("domain", "h1", "h2", "ids")
    copies = points.select("domain", "h1", "h2", "node_id").join(keyed, ["domain", "h1", "h2"]).select("domain", "node_id", F.explode("ids").alias("neighbour")).where("node_id <> neighbour").withColumn("distance", F.lit(0.0))
    ranked = foreign.unionByName(twins).unionByName(copies)
    order = Window.partitionBy("domain", "node_id").orderBy("distance", "neighbour")
    return ranked.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def placed(units: DataFrame, trees, dim: int) -> DataFrame:
    """(domain, leaf, unit, vector) with the shard of each unit; trees: broadcast Routing by domain."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            domains, x = batch.column(0).to_pylist(), _matrix(batch.column(2), dim)
            leaf = np.zeros(len(x), np.int64)
            names = np.array(domains, object)
            for domain in trees.value.keys() & set(domains):
                some = np.flatnonzero(names == domain)
                leaf[some] = trees.value[domain].home(x[some])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(leaf), batch.column(1), batch.column(2)], names=["domain", "leaf", "unit", "vector"])

    return units.select("domain", "unit", "vector").mapInArrow(place, "domain string, leaf long, unit long, vector array<float>")


def divided(units: DataFrame, trees: dict[str, Routing], dim: int, capacity: int) -> dict[str, Routing]:
    """The same with a tree for every shard of more than 1.5 capacities, fitted by a task for each such shard on its own sample of PER_SHARD vectors for each part."""
    if not trees:
        return trees
    spark = units.sparkSession
    homes = placed(units, spark.sparkContext.broadcast(trees), dim)
    large = homes.groupBy("domain", "leaf").count().where(F.col("count") > 1.5 * capacity).collect()  # fewer than there are shards
    if not large:
        return trees
    wanted = {(r["domain"], r["leaf"]): _power(r["count"] / capacity) for r in large}
    share = int(min(1.0, PER_SHARD / capacity) * (1 << 30))
    chosen = spark.sparkContext.broadcast(wanted)

    def some_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([k in chosen.value for k in zip(batch.column("domain").to_pylist(), batch.column("leaf").to_pylist())], pa.bool_()))

    def fit(table: pa.Table) -> pa.Table:
        domain, leaf = table.column("domain")[0].as_py(), table.column("leaf")[0].as_py()
        x = _matrix(table.column("vector"), dim)
        tree = Tree.fit(x, min(chosen.value[domain, leaf], max(1, _power(len(x) / 16) // 2)))
        return pa.table({"domain": [domain], "leaf": [leaf], "tree": [pickle.dumps(tree)]})

    sampled = homes.where(F.pmod(F.xxhash64(F.lit("part"), "unit"), F.lit(1 << 30)) < share).mapInArrow(some_of, "domain string, leaf long, unit long, vector array<float>")
    for r in sampled.groupBy("domain", "leaf").applyInArrow(fit, "domain string, leaf long, tree binary").collect():
        trees[r["domain"]].below[r["leaf"] // Routing.SPREAD] = pickle.loads(r["tree"])
    return trees


def fit_routing(units: DataFrame, dim: int, capacity: int = CAPACITY, sample: int = SAMPLE) -> dict[str, Tree]:
    """A tree for each domain that fills more than a shard, over a sample of about PER_SHARD vectors a shard, chosen by hash; its leaves are the shards.

    There are fewer such domains than vectors / capacity; all others are a shard each.
    """
    counts = {r[0]: r[1] for r in units.groupBy("domain").count().where(F.col("count") > capacity).collect()}
    total = sum(counts.values())
    if not total:
        return {}
    units = units.where(F.col("domain").isin(list(counts))) if len(counts) <= 1_000 else units.join(F.broadcast(units.sparkSession.createDataFrame([(d,) for d in counts], "domain string")), "domain")
    wanted = min(sample, max(4_000, PER_SHARD * total // capacity))
    share = int(min(1.0, wanted / max(total, 1)) * (1 << 30))
    some = units.where(F.pmod(F.xxhash64(F.lit("sample"), "unit"), F.lit(1 << 30)) < share).select("domain", "vector").toArrow()
    names, x = np.array(some.column(0).to_pylist(), object), _matrix(some.column(1), dim)
    trees = {}
    for domain, n in counts.items():
        own = x[names == domain]
        # at least 16 sampled vectors to a shard, so that medians mean something
        leaves = min(_power(n / capacity), max(1, _power(len(own) / 16) // 2))
        trees[domain] = Tree.fit(own if len(own) else np.zeros((1, dim), np.float32), leaves)
    return trees


def near_pairs(rows: DataFrame, k: int = 5, limit: float = 0.4, dim: int = 64, factor: float = FACTOR, capacity: int = CAPACITY) -> DataFrame:
    """(node_id_a, node_id_b), smaller first, distinct: pairs within `limit` of which one is among the k nearest of the other."""
    found = nearest(rows, k, limit, dim, factor, capacity)
    return found.select(F.least("node_id", "neighbour").alias("node_id_a"), F.greatest("node_id", "neighbour").alias("node_id_b")).distinct()
