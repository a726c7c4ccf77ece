"""Bloom filters as expressions: built by a distributed aggregate, tested inside generated code.

Spark holds both expressions for its own runtime filters but gives them no public name, so they are put together here; where a Spark has them elsewhere, or a session
has no such access, `supported` is false and callers go on without a filter.

A filter has as many sections as its keys need at BITS_A_KEY, each of at most MAX_BITS and holding the keys of its share of hashes. The keys' hashes are shuffled by section, so a section
is built by one task, without partial filters to merge. Sections are scalar subqueries, so together they are sent along with a query: at most
MAX_SECTIONS * MAX_BITS, 128 MB. Beyond what that holds with LEAST_BITS a key a filter would tell little, and there is none.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bound of a section, 8 MB, and of the number of sections.
MAX_BITS, MAX_SECTIONS = 1 << 26, 16
#: Bits for a key where there is room (about 1 % of foreign keys pass), and the fewest with which a filter is made (about 15 % pass).
BITS_A_KEY, LEAST_BITS = 10, 4


def supported(spark: SparkSession) -> bool:
    """Whether Spark's own filter expressions can be reached."""
    jvm = getattr(spark, "_jvm", None)
    try:
        return jvm is not None and "BloomFilterMightContain" in str(jvm.java.lang.Class.forName("org.apache.spark.sql.catalyst.expressions.BloomFilterMightContain")) and jvm.org.apache.spark.sql.classic.ExpressionUtils.expression is not None
    except Exception:  # noqa: BLE001 - whatever is missing, there is no filter
        return False


@dataclass
class Bloom:
    """The sections of a filter; None where there is none and every key may be contained."""

    sections: list[DataFrame] | None

    def might_contain(self, hashed: Column) -> Column:
        """False: certainly none of the filter's keys. Never null."""
        if self.sections is None:
            return F.lit(True)
        tests = [F.coalesce(_test(s, hashed), F.lit(False)) for s in self.sections]
        if len(tests) == 1:
            return tests[0]
        which = section_of(hashed, len(tests))
        found = F.when(which == 0, tests[0])
        for i, test in enumerate(tests[1:], 1):
            found = found.when(which == i, test)
        return found


def section_of(hashed: Column, sections: int) -> Column:
    """Independent of the bits that a filter takes from the same hash."""
    return F.pmod(F.hash(hashed), F.lit(sections))


def bloom_of(keys: DataFrame, hashed: str, items: int, bits: int = MAX_BITS, most: int = MAX_SECTIONS) -> Bloom:
    """The filter of a long column with about `items` distinct values. bits: bound of a section."""
    spark = keys.sparkSession
    n = max(1, min(most, -(-BITS_A_KEY * items // bits)))
    if not supported(spark) or n * bits < LEAST_BITS * items:
        return Bloom(None)
    size = min(bits, max(1 << 10, BITS_A_KEY * items // n))
    jvm = spark._jvm
    convert = jvm.org.apache.spark.sql.classic.ExpressionUtils
    literal = lambda x: convert.expression(F.lit(x).cast("long")._jc)
    made = jvm.org.apache.spark.sql.catalyst.expressions.aggregate.BloomFilterAggregate(convert.expression(F.col(hashed)._jc), literal(max(1, size // BITS_A_KEY)), literal(size))
    each = keys.select(hashed, section_of(F.col(hashed), n).alias("section")).repartition(n, "section").groupBy("section").agg(Column(convert.column(made.toAggregateExpression())).alias("bloom"))
    from marlgraph.runtime import materialize

    rows = materialize(each, "bloom")
    return Bloom([rows.where(F.col("section") == i).select("bloom") for i in range(n)])


def _test(section: DataFrame, hashed: Column) -> Column:
    jvm = section.sparkSession._jvm
    convert = jvm.org.apache.spark.sql.classic.ExpressionUtils
    return Column(convert.column(jvm.org.apache.spark.sql.catalyst.expressions.BloomFilterMightContain(convert.expression(section.scalar()._jc), convert.expression(hashed._jc))))
