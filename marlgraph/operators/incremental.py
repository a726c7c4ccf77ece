"""Incremental loading: each run takes exactly the records added or changed since the last successful run.

`IncrementalLoad` keeps a state of keys and content hashes in hash buckets. A run hashes the current rows, joins them to the state and selects the keys that are new or
changed; their rows are written down, and both the output and the next state are made of what was written, whatever the source holds by then. Output and state become visible by
one commit: a run that fails before it leaves both as they were, so its records are selected again; none is skipped and none is put out twice. The commit builds on the one that the run began
with, so of two runs at once the second gets a Conflict. Only the buckets of selected keys are rewritten.

`covered` derives the first state from a log of earlier runs: a run covers the sequences in (from, to] that had arrived by its read time.
Ranges may overlap, repeat and leave gaps. They are laid on blocks of GRANULE sequences: what covers whole blocks is split into aligned
power-of-two spans, what covers a part of one into at most 2 log2(GRANULE) nodes of that block's binary tree. A message then needs one equi-join on its
block, never a range join, and neither a hot table nor a run over an enormous range makes a large group.

Cases: rows with a null key column are left out; equal rows of one key count once, different rows of one key in one run are hashed together; runs
that haven't succeeded or lack a bound or read time cover nothing; a run that selects nothing is a run with empty output; empty tables work.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlgraph.runtime import BucketedTable, materialize, scratch_path

BITS = 10
GRANULE = 1 << BITS
#: Levels of aligned spans over blocks; enough for every long.
LEVELS = 63 - BITS


def content_hash(*columns: str | F.Column) -> F.Column:
    """64-bit hash of the columns' values; a null differs from every value. Maps have to be given as sorted entries, see `hashable`."""
    given = [F.col(c) if isinstance(c, str) else c for c in columns]
    return F.xxhash64(*[x for c in given for x in (c.isNull(), c)]) if given else F.lit(0).cast("long")


def hashable(column: str) -> F.Column:
    """A map's entries in order of their keys, so that equal maps have equal hashes."""
    return F.sort_array(F.map_entries(column))


class IncrementalLoad:
    """Selection of new and changed rows against a persisted state; see the module's text. root: of the state and the outputs; None for a scratch folder."""

    def __init__(self, spark: SparkSession, root: str | None, keys: Sequence[str]):
        self.spark, self.keys = spark, list(keys)
        self.table = BucketedTable(spark, root or scratch_path(spark, "loaded"), self.keys)

    def hashed(self, rows: DataFrame, content: Sequence[str]) -> DataFrame:
        """One row per key with the hash of its content, written down. Equal rows count once; the hash of different rows doesn't depend on their order.

        The least and greatest hash of a key's rows are combined before the one exchange. Only where a key has both, and so different rows, are rows read again and made distinct.
        """
        rows = self._keyed(rows).select(*self.keys, content_hash(*content).alias("_h"))
        ends = materialize(self._ends(rows), "hashes")
        mixed = ends.where("content_hash <> _high").select(*self.keys)
        if mixed.isEmpty():
            return ends.drop("_high")
        return ends.where("content_hash = _high").drop("_high").unionByName(self._several(rows, mixed))

    def _ends(self, rows: DataFrame) -> DataFrame:
        return rows.groupBy(*self.keys).agg(F.min("_h").alias("content_hash"), F.max("_h").alias("_high"))

    def _several(self, rows: DataFrame, mixed: DataFrame) -> DataFrame:
        """The hash of keys with different rows."""
        return rows.join(mixed, self.keys, "left_semi").distinct().groupBy(*self.keys).agg(F.bit_xor("_h").alias("content_hash"))

    def _changed(self, rows: DataFrame, content: Sequence[str], said: dict) -> DataFrame:
        """The same as `changes` of `hashed` rows, with `change` only: the rows' hashes meet the state in the exchange that made them, and only keys in doubt are written down."""
        rows = rows.select(*self.keys, content_hash(*content).alias("_h"))
        state = self.table.read_buckets(said).select(*self.keys, F.col("content_hash").alias("_old"))
        doubt = self._ends(rows).join(state, self.keys, "left").where("_old IS NULL OR content_hash <> _old OR content_hash <> _high")
        doubt = materialize(doubt, "doubt")
        differ = doubt.where("_old IS NULL OR content_hash = _high").select(*self.keys, "_old")
        mixed = doubt.where("_old IS NOT NULL AND content_hash <> _high").select(*self.keys, "_old")
        if not mixed.isEmpty():
            differ = differ.unionByName(mixed.join(self._several(rows, mixed), self.keys).where("content_hash <> _old").select(*self.keys, "_old"))
        return differ.select(*self.keys, F.when(F.col("_old").isNull(), "new").otherwise("changed").alias("change"))

    def _keyed(self, rows: DataFrame) -> DataFrame:
        return rows.where(F.expr(" AND ".join(f"`{k}` IS NOT NULL" for k in self.keys)))

    def changes(self, hashed: DataFrame, number: int | None = None) -> DataFrame:
        """Keys of `hashed` that the state doesn't hold with the same hash, as `change` new or changed."""
        state = self.table.read_buckets(self.table.content(number))
        if state is None:
            return hashed.withColumn("change", F.lit("new"))
        state = state.select(*self.keys, F.col("content_hash").alias("_old"))
        joined = hashed.join(state, self.keys, "left").where("_old IS NULL OR _old <> content_hash")
        return joined.withColumn("change", F.when(F.col("_old").isNull(), "new").otherwise("changed")).drop("_old")

    def run(self, rows: DataFrame, content: Sequence[str], process: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
        """One run: the output of `process` over the selected rows (with `change`), by default those rows themselves. When it returns, state and output are committed."""
        number = self.table.head()
        said = self.table.content(number)
        rows = self._keyed(rows)
        if said.get("parts"):
            picked = rows.join(self._changed(rows, content, said), self.keys, "inner")
        else:
            picked = rows.withColumn("change", F.lit("new"))
        if process is None:
            output = self.table.stage(picked)
            picked = self._output(output)
        else:
            picked = materialize(picked, "picked")
            output = self.table.stage(process(picked))
        # the hashes of what was written down: had a row changed between the two reads, its present form is the one that was processed
        fresh = self.hashed(picked, content)
        n = self.table.buckets_for(said, fresh.count(), int(self.spark.conf.get("spark.sql.shuffle.partitions")))
        bucket = self.table.bucket(n).alias("_bucket")
        touched = {r[0] for r in fresh.select(bucket).distinct().collect()} if said.get("buckets") == n else None  # at most n
        state = self.table.read_buckets(said, touched)
        following = fresh.select(*self.keys, "content_hash").repartition(n, *self.keys)
        if state is not None:
            # a key has one row on either side
            both = fresh.select(*self.keys, "content_hash", F.lit(1).alias("_age")).unionByName(state.select(*self.keys, "content_hash", F.lit(0).alias("_age")))
            following = both.repartition(n, *self.keys).groupBy(*self.keys).agg(F.max_by("content_hash", "_age").alias("content_hash"))
        parts, schema = self.table.stage_buckets(following.withColumn("_bucket", self.table.bucket(n)))
        self.table.publish(self.table.merged(said, n, touched, parts, schema, outputs=[*said.get("outputs", []), output]), number)
        return self._output(output)

    def _output(self, version: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.table.root}/{version}")

    def outputs(self) -> list[DataFrame]:
        """What each committed run put out, in order."""
        return [self._output(v) for v in self.table.content().get("outputs", [])]


def _nodes(low: str, high: str, levels: int, pair: bool) -> F.Column:
    """Aligned power-of-two spans that make up low..high (both inclusive): by level the left end's odd index and the right end's."""
    left, right = f"-(shiftright(-({low}), k))", f"shiftright({high} + 1, k)"
    item = (lambda x: f"named_struct('level', k, 'span', {x})") if pair else (lambda x: x)
    both = f"array(if({left} < {right} AND ({left}) & 1 = 1, {item(left)}, null), if({left} < {right} AND ({right}) & 1 = 1, {item(right + ' - 1')}, null))"
    return F.expr(f"filter(flatten(transform(sequence(0, {levels}), k -> {both})), x -> x IS NOT NULL)")


def covered(messages: DataFrame, runs: DataFrame, group: str, sequence: str, arrived: str) -> DataFrame:
    """Messages that a run has processed. runs: (group, from_seq exclusive, to_seq inclusive, read_until), succeeded ones only."""
    runs = runs.where(f"{group} IS NOT NULL AND read_until IS NOT NULL AND from_seq < to_seq").select(group, "read_until", (F.col("from_seq") + 1).alias("a"), F.col("to_seq").alias("b"))
    runs = runs.groupBy(group, "a", "b").agg(F.max("read_until").alias("read_until")).withColumns({"ga": F.shiftright("a", BITS), "gb": F.shiftright("b", BITS)})
    edge = lambda g, low, high: F.struct(g.alias("granule"), F.lit(low).cast("long").alias("low") if isinstance(low, int) else low.alias("low"), F.lit(high).cast("long").alias("high") if isinstance(high, int) else high.alias("high"))
    a, b = F.col("a").bitwiseAND(F.lit(GRANULE - 1)), F.col("b").bitwiseAND(F.lit(GRANULE - 1))
    edges = F.when(F.col("ga") == F.col("gb"), F.array(edge(F.col("ga"), a, b))).otherwise(F.array(edge(F.col("ga"), a, GRANULE - 1), edge(F.col("gb"), 0, b)))
    parts = runs.select(group, "read_until", F.explode(edges).alias("e")).select(group, "read_until", "e.*")
    # a node's number is its place in the block's tree: 1 is the block, 2 and 3 its halves, GRANULE + i the sequence i
    parts = parts.withColumns({"low": F.col("low") + GRANULE, "high": F.col("high") + GRANULE})
    parts = parts.select(group, "granule", "read_until", F.explode(_nodes("low", "high", BITS, False)).alias("node")).groupBy(group, "granule", "node").agg(F.max("read_until").alias("read_until"))
    trees = parts.groupBy(group, "granule").agg(F.map_from_entries(F.collect_list(F.struct("node", "read_until"))).alias("tree"))

    whole = runs.where("gb - ga > 1").withColumns({"low": F.col("ga") + 1, "high": F.col("gb") - 1})
    whole = whole.select(group, "read_until", F.explode(_nodes("low", "high", LEVELS, True)).alias("s")).groupBy(group, "s.level", "s.span").agg(F.max("read_until").alias("read_until"))
    blocks = messages.select(group, F.shiftright(sequence, BITS).alias("granule")).distinct()
    spans = blocks.select(group, "granule", F.explode(F.expr(f"sequence(0, {LEVELS})")).alias("level")).withColumn("span", F.expr("shiftright(granule, level)"))
    whole = spans.join(whole, [group, "level", "span"]).groupBy(group, "granule").agg(F.max("read_until").alias("whole"))
    cover = trees.join(whole, [group, "granule"], "full")

    at = f"({sequence} & {GRANULE - 1}) + {GRANULE}"
    read = F.expr("greatest(whole, " + ", ".join(f"tree[shiftright({at}, {k})]" for k in range(BITS + 1)) + ")")
    # greatest() skips nulls; messages of a block that no run touches find no row and drop out
    return messages.withColumn("granule", F.shiftright(sequence, BITS)).join(cover, [group, "granule"]).where(F.col(arrived) <= read).drop("granule", "whole", "tree")
