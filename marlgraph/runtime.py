"""Shared storage of a job: written tables that any executor can read, and tables published in versions."""

from __future__ import annotations

import atexit
import json
import os
import tempfile
import uuid
import zipfile

from py4j.protocol import Py4JJavaError
from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers, once per Spark context, so that they need no installation or path of it."""
    context = spark.sparkContext
    if getattr(context, "_marlgraph_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="marlgraph-code-"), "marlgraph.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for at, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(at, name)
                    z.write(path, os.path.join("marlgraph", os.path.relpath(path, root)))
    context.addPyFile(target)
    context._marlgraph_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where it is unset, a local master (tests, one machine) gets one made once per session; on a cluster that is an error."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("marlgraph.sharedDir", None)
    if not conf:
        if not is_local(spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        conf = "file://" + tempfile.mkdtemp(prefix="marlgraph-")
        spark.conf.set("marlgraph.sharedDir", conf)
        _SCRATCH.append(conf)
    return conf.rstrip("/")


def is_local(master: str) -> bool:
    """Whether driver and executors are one process; local-cluster isn't local."""
    return master == "local" or master.startswith("local[")


#: What was written for the session's own use; removed when Python ends, or by `clean`.
_SCRATCH: list[str] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    _SCRATCH.append(path)
    return path


def clean() -> int:
    """Removes all scratch tables; DataFrames that read them can no longer be used. Returns how many there were."""
    gone, jvm = 0, SparkContext._jvm
    while _SCRATCH and jvm is not None:
        path = jvm.org.apache.hadoop.fs.Path(_SCRATCH.pop())
        gone += bool(path.getFileSystem(jvm.org.apache.hadoop.conf.Configuration()).delete(path, True))
    return gone


@atexit.register
def _clean_at_exit() -> None:
    try:
        clean()
    except Exception:  # noqa: BLE001 - the JVM may have gone first
        pass


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage with a table written to the shared folder; it survives the loss of any executor."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Conflict(RuntimeError):
    """Someone else published in between; what was staged is not visible, and the work may be done again on what they published."""


class VersionedTable:
    """Immutable parquet versions below one root, and numbered commits that say which of them make up the table.

    A version is written by Spark's commit protocol and seen by nobody until a commit names it. A commit is one file, moved into its place under the next
    number, which the file system does atomically and refuses if that number is taken: a failure before it leaves the earlier commit in force, one after it loses nothing, and of two
    writers that began from the same commit the second gets a Conflict.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._jvm, self._conf = jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self._path = jvm.org.apache.hadoop.fs.Path
        self._commits = self._path(f"{self.root}/_commits")
        self._fs = self._commits.getFileSystem(self._conf)

    # --- commits ----------------------------------------------------------------------------------------------------------------------

    def head(self) -> int:
        """Number of the commit in force; 0 before the first."""
        if not self._fs.exists(self._commits):
            return 0
        names = [s.getPath().getName() for s in self._fs.listStatus(self._commits)]
        return max((int(n) for n in names if n.isdigit()), default=0)

    def content(self, number: int | None = None) -> dict:
        """What a commit says, by default the one in force; empty before the first."""
        number = self.head() if number is None else number
        if not number:
            return {}
        stream = self._fs.open(self._path(self._commits, f"{number:020d}"))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def publish(self, what: str | dict, after: int | None = None) -> int:
        """Makes a staged version, or what else a commit may say, the table. after: the commit on which it builds, by default the one in force."""
        number = (self.head() if after is None else after) + 1
        fresh, place = self._path(self._commits, f".{uuid.uuid4().hex}"), self._path(self._commits, f"{number:020d}")
        out = self._fs.create(fresh, True)
        out.write(bytearray(json.dumps({"version": what} if isinstance(what, str) else what), "utf-8"))
        out.close()
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._commits.toUri(), self._conf)
        options = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(context.makeQualified(fresh), context.makeQualified(place), options)
        except Py4JJavaError as x:
            self._fs.delete(fresh, False)
            if "FileAlreadyExistsException" in str(x.java_exception):
                raise Conflict(f"commit {number} of {self.root} exists") from x
            raise
        return number

    # --- versions ---------------------------------------------------------------------------------------------------------------------

    def current(self) -> str | None:
        """Path of the published version; None before the first."""
        version = self.content().get("version")
        return version and f"{self.root}/{version}"

    def read(self) -> DataFrame | None:
        at = self.current()
        return None if at is None else self.spark.read.parquet(at)

    def stage(self, df: DataFrame) -> str:
        """Writes a version that nobody sees yet; returns its name."""
        name = f"v-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.root}/{name}")
        return name

    def replace(self, df: DataFrame) -> DataFrame:
        after = self.head()
        self.publish(self.stage(df), after)
        return self.read()

    def _in_force(self, content: dict) -> set[str]:
        return {content["version"]} if "version" in content else set()

    def prune(self) -> int:
        """Deletes versions that the commit in force doesn't name, and older commits; for a maintenance job without readers of old versions or writers at work."""
        number, gone = self.head(), 0
        keep = self._in_force(self.content(number))
        for status in self._fs.listStatus(self._path(self.root)):
            name = status.getPath().getName()
            if name.startswith("v-") and name not in keep:
                gone += bool(self._fs.delete(status.getPath(), True))
        for status in self._fs.listStatus(self._commits) if number else []:
            name = status.getPath().getName()
            if name.isdigit() and int(name) < number:
                self._fs.delete(status.getPath(), False)
        return gone


class BucketedTable(VersionedTable):
    """Rows by key in hash buckets. A commit rewrites the buckets that it touches and goes on naming the files of all others.

    The number of buckets is a power of two kept in the commit; when a bucket would hold more than `rows` on average, the next commit has twice as many or more.
    """

    #: Rows of a bucket on average at most.
    ROWS = 250_000

    def __init__(self, spark: SparkSession, root: str, keys: list[str], rows: int | None = None):
        super().__init__(spark, root)
        self.keys, self.rows = list(keys), rows or self.ROWS

    def bucket(self, buckets: int) -> Column:
        """The bucket of a row: the partition into which `repartition(buckets, *keys)` puts it."""
        return F.pmod(F.hash(*self.keys), F.lit(buckets))

    def buckets_for(self, content: dict, more: int, least: int = 1) -> int:
        """Buckets of the next commit, which adds at most `more` rows."""
        n = content.get("buckets") or power_of_two(least)
        return max(n, power_of_two((sum(rows for _, rows in content.get("parts", {}).values()) + more) / self.rows))

    def read_buckets(self, content: dict, only: set[int] | None = None) -> DataFrame | None:
        """Rows of the buckets named, by default all, with `_bucket`; None where there are none."""
        by_version: dict[str, list[int]] = {}
        for b, (version, _) in content.get("parts", {}).items():
            if only is None or int(b) in only:
                by_version.setdefault(version, []).append(int(b))
        found = None
        for version, buckets in sorted(by_version.items()):
            base = f"{self.root}/{version}"
            one = self.spark.read.schema(content["schema"]).option("basePath", base).parquet(*[f"{base}/_bucket={b}" for b in sorted(buckets)])
            found = one if found is None else found.unionByName(one)
        return found

    def stage_buckets(self, df: DataFrame) -> tuple[dict[str, list], str]:
        """Writes rows that have `_bucket`; returns ({bucket: [version, rows]}, their schema)."""
        name = f"v-{uuid.uuid4().hex}"
        path = f"{self.root}/{name}"
        df.write.partitionBy("_bucket").parquet(path)
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in [*(f for f in df.schema.fields if f.name != "_bucket"), df.schema["_bucket"]])
        if not any("=" in s.getPath().getName() for s in self._fs.listStatus(self._path(path))):
            return {}, schema
        counts = self.spark.read.schema(schema).parquet(path).groupBy("_bucket").count().collect()  # a row per bucket
        return {str(r["_bucket"]): [name, r["count"]] for r in counts}, schema

    def merged(self, content: dict, buckets: int, touched: set[int] | None, parts: dict[str, list], schema: str, **more) -> dict:
        """What the next commit says: the new parts, and the old ones of buckets that weren't touched (None: all were)."""
        kept = {} if touched is None or content.get("buckets") != buckets else {b: p for b, p in content.get("parts", {}).items() if int(b) not in touched}
        return content | {"buckets": buckets, "schema": schema, "parts": kept | parts} | more

    def read(self) -> DataFrame | None:
        rows = self.read_buckets(self.content())
        return None if rows is None else rows.drop("_bucket")

    def _in_force(self, content: dict) -> set[str]:
        return {version for version, _ in content.get("parts", {}).values()} | {v for v in content.get("outputs", [])}


def power_of_two(n: float) -> int:
    """The least power of two that is n or more."""
    return 1 << max(0, int(-(-n // 1)) - 1).bit_length()
