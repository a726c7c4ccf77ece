"""Vector expressions that stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def squared_l2(a: str | Column, b: list[float] | Column) -> Column:
    """Squared Euclidean distance in double; null where a vector is null, lengths differ, or an element is null."""
    a = F.col(a) if isinstance(a, str) else a
    b = F.array(*[F.lit(float(x)) for x in b]) if isinstance(b, list) else b
    parts = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.when(F.size(a) == F.size(b), F.aggregate(parts, F.lit(0.0), lambda s, x: s + x))


def check_dimensions(rows: DataFrame, column: str, dim: int) -> None:
    """Raises ValueError where a non-null vector has another length."""
    other = rows.where(F.col(column).isNotNull() & (F.size(column) != dim)).select(F.size(column)).first()
    if other is not None:
        raise ValueError(f"embedding dimension mismatch: expected {dim}, found {other[0]}")


def hashed_embedding(dim: int = 64):
    """A deterministic embedding for where no model is at hand: signed feature hashing of words, of unit length. A function of a text column, all in the JVM.

    A word's first eight hexadecimal digits of MD5, modulo dim, are its place, and the ninth its sign. A null text has a null vector, one without words zeros.
    """

    def embed(text: str | Column) -> Column:
        c = F.col(text) if isinstance(text, str) else text
        words = F.filter(F.split(F.lower(c), r"\s+"), lambda w: w != "")
        # place and sign in one number: 2 * place, and one more for a minus
        code = lambda w: (F.pmod(F.conv(F.substring(F.md5(w), 1, 8), 16, 10).cast("long"), F.lit(dim)) * 2 + (F.substring(F.md5(w), 9, 1) < "8").cast("long")).cast("int")
        codes = F.transform(words, code)
        one = lambda i: F.aggregate(codes, F.lit(0), lambda s, x: s + F.when(x == i * 2, 1).when(x == i * 2 + 1, -1).otherwise(0)).cast("double")
        v = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), one)
        return F.transform(F.array(v), lambda v: F.transform(v, lambda x: F.coalesce(F.try_divide(x, F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, y: s + y * y))), F.lit(0.0)).cast("float")))[0]

    return lambda text: F.when((F.col(text) if isinstance(text, str) else text).isNotNull(), embed(text))
