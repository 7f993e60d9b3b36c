"""Table-level helpers: cleaning, column choice, de-duplication, reshaping."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def first_existing(df: DataFrame, candidates: Sequence[str]) -> str | None:
    """First candidate that is a column, ignoring case and spaces."""
    known = {re.sub(r"\s+", "", c).lower(): c for c in df.columns}
    return next((known[k] for c in candidates if (k := re.sub(r"\s+", "", c).lower()) in known), None)


def fuzzy_column(df: DataFrame, keywords: Sequence[str]) -> str | None:
    """Shortest column whose name has all the keywords."""
    hits = [c for c in df.columns if all(k.lower() in c.lower() for k in keywords)]
    return min(hits, key=lambda c: (len(c), c)) if hits else None


def resolve_name(names: Sequence[str], *wanted: str) -> str | None:
    """The name that is one of ``wanted``, else one that contains it, then either
    without regard to case, then without digits, spaces, lines and hyphens too."""
    plain = lambda x: re.sub(r"[0-9\s_-]+", "", x.lower())
    for form in (str, str.lower, plain):
        keys = [k for w in wanted if (k := form(w))]
        for fits in (lambda k, n: k == n, lambda k, n: k in n):
            hit = next((n for k in keys for n in names if fits(k, form(n))), None)
            if hit is not None:
                return hit
    return None


def marked_column(df: DataFrame, name: str, others: Sequence[str], markers: Sequence[str]) -> str | None:
    """Shortest column that has ``name`` (no further digit behind it), none of
    ``others``, and one of ``markers``, without regard to case."""
    own = re.compile(rf"{re.escape(name)}(?!\d)", re.I)
    hits = [c for c in df.columns if own.search(c) and not any(o.lower() in c.lower() for o in others) and any(m.lower() in c.lower() for m in markers)]
    return min(hits, key=lambda c: (len(c), c)) if hits else None


def without_units(df: DataFrame) -> DataFrame:
    """Column names without a trailing parenthesis."""
    return df.toDF(*[re.sub(r"\s*[（(][^()（）]*[)）]\s*$", "", c) for c in df.columns])


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def missing_to_null(df: DataFrame, sentinels: Sequence[float] = (99.99, -99.99, 1e20, 1e15)) -> DataFrame:
    """NaN, infinities and fill values become null in floating columns."""
    def clean(name: str) -> Column:
        x = F.col(name)
        bad = F.isnan(x) | (F.abs(x) == float("inf")) | x.isin(*map(float, sentinels))
        return F.when(~bad, x).alias(name)

    floating = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.FloatType, T.DoubleType))}
    return df.select(*[clean(c) if c in floating else F.col(c) for c in df.columns])


def parse_dates(text: Column, formats: Sequence[str]) -> Column:
    """The first format that fits each value."""
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in formats]).cast("date")


def parse_rates(df: DataFrame, formats: Sequence[str]) -> DataFrame:
    """One row a string column: shares of values that are dates and numbers."""
    names = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]

    def share(c: str, ok: Column) -> Column:
        return F.avg(F.when(F.col(c).isNotNull(), ok.cast("int")))

    def rates(c: str) -> Column:
        dates, numbers = parse_dates(F.col(c), formats).isNotNull(), F.expr(f"try_cast(`{c}` as double) is not null")
        return F.struct(F.lit(c).alias("column"), share(c, dates).alias("dates"), share(c, numbers).alias("numbers"))

    row = df.agg(*[rates(c).alias(f"_{i}") for i, c in enumerate(names)])
    return row.select(F.inline(F.array(*[f"_{i}" for i in range(len(names))])))


def keep_one(df: DataFrame, keys: Sequence[str], order: Sequence[Column], last: bool = False) -> DataFrame:
    """One row a key: the first or last by a total order."""
    w = Window.partitionBy(*keys).orderBy(*[o.desc() if last else o.asc() for o in order])
    return df.withColumn("_nth", F.row_number().over(w)).where("_nth = 1").drop("_nth")


def increment(stored: DataFrame, new: DataFrame, keys: Sequence[str], time: str) -> DataFrame:
    """Stored rows plus the new ones; of equal keys and times the new counts."""
    both = stored.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    return keep_one(both, [*keys, time], [F.col("_new")], last=True).drop("_new")


def affine_unpack(raw: Column, scale: float, offset: float, fill: float) -> Column:
    return F.when(raw != fill, raw * scale + offset)


def overall_flag(flags: Sequence[Column], order: Sequence[int] = (4, 3, 9), good: int = 1) -> Column:
    """The first of ``order`` that any flag of the row is, else ``good``."""
    row = F.array(*flags)
    return F.coalesce(*[F.when(F.array_contains(row, f), f) for f in order], F.lit(good))


def if_complete(value: Column, inputs: Sequence[Column]) -> Column:
    """``value`` where none of the numbers ``inputs`` is null or NaN."""
    whole = F.lit(True)
    for x in inputs:
        whole &= x.isNotNull() & ~F.isnan(x)
    return F.when(whole, value)


def spaced(low: Column, high: Column, n: int) -> Column:
    """``n`` (two or more) evenly spaced values, both ends included."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: low + i * (high - low) / (n - 1))


def labelled(code: Column, labels: dict, other: str | None = None) -> Column:
    known = F.create_map(*[F.lit(x) for pair in labels.items() for x in pair])
    return F.coalesce(F.try_element_at(known, code), F.lit(other))


def cyclic_point(df: DataFrame, lon: str = "lon") -> DataFrame:
    """Adds, at lon + 360, the rows of the smallest longitude."""
    first = df.groupBy().agg(F.min(lon).alias(lon))
    return df.unionByName(df.join(F.broadcast(first), lon, "left_semi").withColumn(lon, F.col(lon) + 360))
