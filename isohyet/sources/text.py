"""Text sources: delimited files, sentinel tables, storm best-track records."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import shared, shared_root


def csv(spark: SparkSession, path: str, schema: str | T.StructType, encoding: str = "UTF-8", key: str | None = None) -> DataFrame:
    """CSV by an explicit schema; codes keep leading zeros as strings. With a
    ``key`` rows where it is null, such as a row of units, are dropped."""
    df = spark.read.csv(path, schema=schema, header=True, encoding=encoding, mode="PERMISSIVE")
    return df if key is None else df.where(F.col(key).isNotNull())


def csv_with_issues(spark: SparkSession, path: str, schema: T.StructType, encoding: str = "UTF-8") -> tuple[DataFrame, DataFrame]:
    """Good rows of many CSV files, and how many rows of each file are malformed
    (file, rows, malformed): one bad file does not end the batch."""
    whole = T.StructType([*schema.fields, T.StructField("_bad", T.StringType())])
    df = spark.read.csv(path, schema=whole, header=True, encoding=encoding, mode="PERMISSIVE", columnNameOfCorruptRecord="_bad")
    # Written once with all columns: rows are malformed by all, not by those that a
    # later step happens to use.
    df = shared(df.select("*", F.col("_metadata.file_path").alias("file")))
    issues = df.groupBy("file").agg(F.count("*").alias("rows"), F.count("_bad").alias("malformed"))
    return df.where(F.col("_bad").isNull()).drop("_bad"), issues


def json_lists(spark: SparkSession, path: str, key: str, values: str, kind: str = "int") -> DataFrame:
    """A row a value of JSON records that have a key and a list, such as the
    years of an event; a record without a list has no row."""
    df = spark.read.json(path, schema=f"`{key}` string, `{values}` array<{kind}>")
    return df.select(key, F.explode(values).alias(values))


def whitespace_table(spark: SparkSession, path: str, names: Sequence[str], skip: int = 0, missing: Sequence[float] = (99.99, -99.99)) -> DataFrame:
    """Numbers between white space, one record a line; sentinels become null.
    ``skip`` leading lines of each file are headings. Large files are read in
    parts: only lines of a file's first part are numbered, from its first line."""
    lines = spark.read.text(path, wholetext=False).select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_at"))
    if skip:
        first = lines.where("_block = 0").groupBy("_file").agg(F.min("_at").alias("_first"))
        lines = lines.join(first, "_file").where((F.col("_block") > 0) | (F.col("_at") - F.col("_first") >= skip))
    parts = F.split(F.trim("value"), r"\s+")

    def number(i: int) -> Column:
        x = F.get(parts, F.lit(i)).try_cast("double")
        return F.when(~x.isin(*map(float, missing)), x)

    return lines.where(F.trim("value") != "").select(*[number(i).alias(n) for i, n in enumerate(names)])


def numbered_lines(spark: SparkSession, path: str, name: Callable[[Column], Column] = lambda path: path) -> DataFrame:
    """file (its path, or ``name`` of it: files of one name are parts that follow
    each other by path), line (from 1, in the file's order) and value of all lines
    of text files. Large files are read in parts; lines are written once to the
    shared folder with their place in their part, and only the lengths of the parts
    are added up, so that no task holds a file."""
    source = F.col("_metadata.file_path")
    lines = spark.read.text(path).select("value", name(source).alias("file"), source.alias("_path"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_at"))
    kept = f"{shared_root(spark)}/lines-{uuid.uuid4().hex}"
    lines.write.option("compression", "zstd").parquet(kept)
    lines = spark.read.parquet(kept)
    parts = lines.groupBy("file", "_path", "_block").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("file").orderBy("_path", "_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = shared(parts.select("_path", "_block", (before - F.col("_first") + 1).alias("_start")))
    return lines.join(F.broadcast(starts), ["_path", "_block"]).select("file", (F.col("_at") + F.col("_start")).alias("line"), "value")


def year_by_month(wide: DataFrame, year: str, months: Sequence[str], value: str = "value") -> DataFrame:
    """A row a year with twelve columns, as a monthly series."""
    long = wide.unpivot([year], list(months), "_month", value)
    number = F.array_position(F.array(*map(F.lit, months)), F.col("_month")).cast("int")
    return long.select(F.col(year).cast("int").alias("year"), number.alias("month"), F.make_date(F.col(year).cast("int"), number, F.lit(1)).alias("date"), value)


def file_parts(path: Column, names: Sequence[str], separator: str = "_") -> list[Column]:
    """Columns from the parts of a file's name."""
    base = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")
    return [F.get(F.split(base, separator), F.lit(i)).alias(n) for i, n in enumerate(names)]


HEADER = "66666"
#: Lines that one task counts headers of.
BLOCK = 1 << 17


def best_tracks(lines: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Storms, track points and issues of best-track text.

    ``lines`` has file, line (number in the file) and value. A header line
    starts a storm; the lines up to the next belong to it. Header fields:
    marker, class, number of points, sequence, id, end flag, hours, name, date.
    Point fields: yyyymmddhh, grade, latitude and longitude in tenths, hPa, wind
    and, optionally, mean wind. Storms are counted within their file: headers by
    blocks of lines, and the counts of the blocks are added up.
    """
    head = F.startswith(F.trim("value"), F.lit(HEADER))
    lines = lines.where(F.trim("value") != "").select("file", "line", F.floor(F.col("line") / BLOCK).alias("_b"), head.cast("int").alias("_h"), F.split(F.trim("value"), r"\s+").alias("_f"))
    at = lambda i, kind="int": F.get("_f", F.lit(i)).try_cast(kind)
    time = F.try_to_timestamp(F.get("_f", F.lit(0)), F.lit("yyyyMMddHH"))
    counts = lines.groupBy("file", "_b").agg(F.sum("_h").alias("_n"))
    earlier = F.sum("_n").over(Window.partitionBy("file").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))
    counts = shared(counts.select("file", "_b", F.coalesce(earlier, F.lit(0)).alias("_earlier")))

    def counted(rows: DataFrame) -> DataFrame:
        within = F.sum("_h").over(Window.partitionBy("file", "_b").orderBy("line").rowsBetween(Window.unboundedPreceding, 0))
        return rows.withColumn("_within", within).join(F.broadcast(counts), ["file", "_b"]).withColumn("storm", F.col("_earlier") + F.col("_within"))

    # Fields are read before lines are moved; lists of words stay behind.
    storms = counted(lines.where("_h = 1").select(
        "file", "_b", "line", "_h", at(2).alias("record_count"), F.get(F.split(F.get("_f", F.lit(4)), ","), F.lit(0)).alias("cn_id"), F.trim(F.regexp_replace(F.get("_f", F.lit(7)), r"\(.*?\)", "")).alias("name"),
        at(5).alias("end_flag"), at(6).alias("interval_hours"), F.try_to_timestamp(F.get("_f", F.lit(8)), F.lit("yyyyMMdd")).cast("date").alias("dataset_date"),
    )).select("file", "storm", "record_count", "cn_id", "name", "end_flag", "interval_hours", "dataset_date")
    good = F.coalesce(F.size("_f").isin(6, 7) & time.isNotNull(), F.lit(False)) & (F.col("_h") == 0)
    rows = counted(lines.select(
        "file", "_b", "line", "_h", good.alias("_good"), F.when(F.col("_h") == 1, at(2)).alias("record_count"), F.when(F.col("_h") == 1, F.contains(F.get("_f", F.lit(4)), F.lit(","))).alias("_listed"),
        time.alias("time"), at(1).alias("grade"), (at(2, "double") / 10).alias("lat"), (at(3, "double") / 10).alias("lon"), at(4).alias("pressure"), at(5).alias("wind"), at(6).alias("mean_wind"),
    )).where("storm > 0")
    nth = F.row_number().over(Window.partitionBy("file", "storm").orderBy("line"))
    tracks = rows.where("_good").select("file", "storm", nth.alias("record_no"), "time", "grade", "lat", "lon", "pressure", "wind", "mean_wind")
    each = rows.groupBy("file", "storm").agg(F.count_if("_good").alias("n"), F.max("record_count").alias("record_count"), F.max("_listed").alias("listed"), F.count_if(~F.col("_good") & (F.col("_h") == 0)).alias("bad"))
    # Malformed points by the thousand, so that a storm of many makes no long list.
    each = each.select("*", F.explode(F.sequence(F.lit(0), F.floor(F.col("bad") / 1000))).alias("_k"))
    once = F.array(F.when((F.col("_k") == 0) & (F.col("n") != F.coalesce("record_count", F.lit(-1))), "record count"), F.when((F.col("_k") == 0) & F.col("listed"), "composite id"))
    many = F.array_repeat(F.lit("malformed point"), F.least(F.lit(1000), F.col("bad") - 1000 * F.col("_k")).cast("int"))
    issues = each.select("file", "storm", F.explode(F.concat(F.array_compact(once), many)).alias("issue"))
    return storms, tracks, issues


def yearly_storms(storms: DataFrame, tracks: DataFrame, first: int, last: int) -> DataFrame:
    """Storms, those that reached grade 6, and the deepest pressure by year of
    the first point; years without a storm have zeros."""
    each = tracks.groupBy("file", "storm").agg(F.year(F.min("time")).alias("year"), F.max("grade").alias("grade"), F.min("pressure").alias("pressure"))
    each = each.join(storms.select("file", "storm"), ["file", "storm"], "left_semi")
    g = each.groupBy("year").agg(F.count("*").alias("storms"), F.count_if(F.col("grade") >= 6).alias("strong"), F.min("pressure").alias("deepest"))
    years = storms.sparkSession.range(first, last + 1).select(F.col("id").cast("int").alias("year"))
    return years.join(g, "year", "left").fillna(0, ["storms", "strong"])
