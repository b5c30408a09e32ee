"""Panel sources and sinks.

The wide hourly file (``timestamp`` + one column per series) is the edge
format; everything inside the engine is the long panel.  CSV is read
without schema inference (no extra pass over the data): all columns come
in as text and are cast in one projection.

Every file is read by its own header line, so files of one folder may have
different columns in any order.  Panels with more series than a pivot takes
are written as column-group files: the series are numbered, each group of
them has its own header and its own folder of rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hourglass.functions.calendar import TS_PARSE_FORMAT, format_ts, parse_ts
from hourglass.functions.numeric import nan_to_null
from hourglass.operators.joins import per_key_join
from hourglass.operators.panel import q, to_long, to_wide
from hourglass.operators.position import number_rows_by_range
from hourglass.session import materialize

STATIONS_SCHEMA = "name STRING, latitude DOUBLE, longitude DOUBLE"
GROUP_SERIES = 500  # columns of a column-group file
FILE_SECONDS = 30 * 24 * 3600  # time span of a column-group file


def csv_fields(line: str | Column) -> Column:
    """The cells of a CSV line: commas outside quotes cut, quotes are taken off and doubled ones halved."""
    line = F.concat(F.lit(","), F.col(line) if isinstance(line, str) else line)
    cells = F.regexp_extract_all(line, F.lit(r',("[^"]*+(?:""[^"]*+)*+"|[^,]*+)'), 1)
    bare = lambda c: F.replace(c.substr(F.lit(2), F.length(c) - 2), F.lit('""'), F.lit('"'))
    return F.transform(cells, lambda c: F.when(c.rlike('^".*"$'), bare(c)).otherwise(c))


def _lines(spark: SparkSession, path: str, ts_col: str) -> tuple[DataFrame, DataFrame]:
    """``(headers, rows)``: one header per file, and the other lines with their file's header."""
    text = spark.read.text(path).where("trim(value) != ''").select(F.col("_metadata.file_path").alias("file"), csv_fields("value").alias("cells"))
    is_header = F.array_contains("cells", F.lit(ts_col))
    two = F.raise_error(F.concat(F.lit("two different headers in "), F.col("file")))
    headers = text.where(is_header).groupBy("file").agg(F.collect_set("cells").alias("all"))
    headers = headers.select("file", F.when(F.size("all") > 1, two.cast("array<string>")).otherwise(F.get("all", F.lit(0))).alias("names"))
    rows = text.where(~is_header).join(headers, "file", "left")
    none = F.raise_error(F.concat(F.lit("no header line in "), F.col("file"))).cast("array<string>")
    return headers, rows.withColumn("names", F.coalesce("names", none))


def _checked(rows: DataFrame, ts_col: str) -> DataFrame:
    """Add ``ts`` and ``bad``: a line with another number of cells than its header, an unreadable time or an unreadable number."""
    at = F.array_position("names", ts_col)
    stamp = F.when(F.size("cells") >= at, F.element_at("cells", at.cast("int")))
    readable = F.forall(F.arrays_zip("cells", "names"), lambda z: (z["names"] == ts_col) | (F.trim(z["cells"]) == "") | z["cells"].try_cast("double").isNotNull())
    rows = rows.withColumn("ts", F.try_to_timestamp(stamp, F.lit(TS_PARSE_FORMAT)))
    bad = (F.size("cells") != F.size("names")) | F.col("ts").isNull() | ~F.coalesce(readable, F.lit(False))
    return rows.withColumn("bad", bad)


def line_report(spark: SparkSession, path: str, ts_col: str = "timestamp") -> DataFrame:
    """``(file, rows, bad_rows)`` of a folder of wide CSV files."""
    checked = _checked(_lines(spark, path, ts_col)[1], ts_col)
    return checked.groupBy("file").agg(F.count(F.lit(1)).alias("rows"), F.count_if("bad").alias("bad_rows"))


def panel_series(spark: SparkSession, path: str, ts_col: str = "timestamp") -> DataFrame:
    """``(series)``: all series named by the headers of a folder of wide CSV files."""
    headers, _ = _lines(spark, path, ts_col)
    return headers.select(F.explode("names").alias("series")).where(F.col("series") != ts_col).distinct()


def read_panel(spark: SparkSession, path: str, fmt: str = "csv", ts_col: str = "timestamp",
               long: bool = True, bad_lines: str = "fail") -> DataFrame:
    """Read a wide panel and return it long ``(series, ts, value)`` (or wide with ``long=False``).

    CSV: a header row in every file, timestamps as ``yyyy-MM-ddTHH:mmZ`` text,
    empty cells are NULL (the rows to predict in a test file), NaN becomes
    NULL.  Files may differ in their columns; cells are taken by their own
    file's header.  A line that does not fit its header or holds an unreadable
    time or number raises an error, or with ``bad_lines='drop'`` is left out
    (``line_report`` counts them).  Cells with line breaks are not supported.
    The wide form needs one header for all files and raises otherwise.
    Parquet: read as is, ``ts_col`` already a timestamp.
    """
    if fmt == "parquet":
        raw = spark.read.parquet(path)
        series = [c for c in raw.columns if c != ts_col]
        wide = raw.select(F.col(q(ts_col)).cast("timestamp").alias("ts"),
                          *[nan_to_null(F.col(q(c)).cast("double")).alias(c) for c in series])
        return to_long(wide, "ts", series) if long else wide
    if fmt != "csv":
        raise ValueError(f"unsupported format {fmt!r}")
    if bad_lines not in ("fail", "drop"):
        raise ValueError(f"bad_lines must be 'fail' or 'drop', not {bad_lines!r}")
    headers, rows = _lines(spark, path, ts_col)
    if not long:
        if headers.select("names").distinct().limit(2).count() > 1:
            raise ValueError(f"files of {path} have different headers; read them long")
        raw = spark.read.option("header", True).option("inferSchema", False).csv(path)
        return raw.select(parse_ts(F.col(q(ts_col))).alias("ts"), *[nan_to_null(F.col(q(c)).cast("double")).alias(c) for c in raw.columns if c != ts_col])
    checked = _checked(rows, ts_col)
    wrong = F.raise_error(F.concat(F.lit("a line does not fit its header or is unreadable in "), F.col("file"))).cast("boolean")
    good = checked.where(F.when(F.col("bad"), F.lit(False) if bad_lines == "drop" else wrong).otherwise(F.lit(True)))
    cells = good.select("ts", F.inline(F.arrays_zip("names", "cells"))).where(F.col("names") != ts_col)
    return cells.select(F.col("names").alias("series"), "ts", nan_to_null(F.col("cells").try_cast("double")).alias("value"))


def read_test_panel(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """Test panel: the same layout, target rows empty in every series."""
    return read_panel(spark, path, fmt)


def read_stations(spark: SparkSession, path: str) -> DataFrame:
    """Station dimension ``(name, latitude, longitude)`` from a CSV with a header."""
    return spark.read.option("header", True).schema(STATIONS_SCHEMA).csv(path)


def write_panel(long: DataFrame, path: str, names: Sequence[str] | None = None, fmt: str = "csv",
                value: str = "value", single_file: bool = False, mode: str = "overwrite") -> None:
    """Long panel -> wide file, ``timestamp`` first, sorted by time, no index column.

    Parallel part files by default; ``single_file`` coalesces to one file
    (only for small outputs; it funnels the write through one task).  Pass
    ``names`` to spare the pass that finds them; for thousands of series use
    ``write_panel_groups``.
    """
    wide = to_wide(long, names, value=value)
    cols = [c for c in wide.columns if c != "ts"]
    out = wide.select(format_ts("ts").alias("timestamp"), *[F.col(q(c)) for c in cols]) \
        if fmt == "csv" else wide.withColumnRenamed("ts", "timestamp")
    out = out.orderBy("timestamp")
    if single_file:
        out = out.coalesce(1)
    w = out.write.mode(mode)
    if fmt == "csv":
        w.option("header", True).csv(path)
    else:
        w.parquet(path)


def _quoted(c: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))


def write_panel_groups(long: DataFrame, path: str, value: str = "value", width: int = GROUP_SERIES) -> None:
    """Long panel -> wide CSV lines in groups of ``width`` series: ``header/group=g`` and ``rows/group=g``.

    The series are numbered in name order by a range partitioning; a line
    holds the time and the group's values in this order, gathered as an array
    and not by a pivot, so the number of series is not limited and nothing is
    collected first.  The cells are dealt once, by group and ``FILE_SECONDS``
    of time, and each such part is written by the task that gathers its lines,
    in the order of time.  ``(series, ts)`` must be unique.
    """
    names = number_rows_by_range(long.select("series").distinct(), "series", out="ordinal")
    names = materialize(names.select("series", F.floor(F.col("ordinal") / width).cast("int").alias("group"), (F.col("ordinal") % width).cast("int").alias("slot")), "series-ordinals")
    headers = names.groupBy("group").agg(F.array_sort(F.collect_list(F.struct("slot", "series"))).alias("all"))
    line = F.concat_ws(",", F.lit("timestamp"), F.transform("all", lambda s: _quoted(s["series"])))
    headers.select("group", line.alias("value")).write.partitionBy("group").text(f"{path}/header")
    sizes = headers.select(F.col("group").alias("_g"), F.size("all").alias("_size"))
    # Every named series has its number: left joins give the same rows, and only their small sides can be broadcast.
    cells = per_key_join(long.where(F.col("series").isNotNull()).select("series", "ts", F.col(value).cast("double").alias("value")), names, ["series"])
    part = F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / F.lit(FILE_SECONDS)).alias("_part")
    cells = cells.select("group", part, "ts", "slot", "value").repartition("group", "_part")
    rows = cells.groupBy("group", "_part", "ts").agg(F.sort_array(F.collect_list(F.struct("slot", F.col("value").cast("string").alias("v")))).alias("cells"))
    rows = rows.join(sizes, F.col("group") == F.col("_g"), "left")
    slots = F.sequence(F.lit(0), F.col("_size") - 1)
    # A line without some of its series, or with one twice (an error), goes by slot number.
    by_slot = F.map_from_entries("cells")
    values = F.when(F.transform("cells", lambda c: c["slot"]) == slots, F.transform("cells", lambda c: F.coalesce(c["v"], F.lit("")))).otherwise(
        F.transform(slots, lambda i: F.coalesce(F.try_element_at(by_slot, i), F.lit(""))))
    out = rows.select("group", "ts", F.concat_ws(",", format_ts("ts"), values).alias("value"))
    out.sortWithinPartitions("group", "ts").drop("ts").write.partitionBy("group").text(f"{path}/rows")


def read_panel_groups(spark: SparkSession, path: str, ts_col: str = "timestamp") -> DataFrame:
    """Long ``(series, ts, value)`` of ``write_panel_groups`` files; empty cells are NULL."""
    headers = spark.read.schema("value string, group int").text(f"{path}/header").select("group", csv_fields("value").alias("names"))
    # Lines of numbers have no quotes; the time is read once a line, not once a cell.
    fields = F.when(F.contains("value", F.lit('"')), csv_fields("value")).otherwise(F.split("value", ",", -1))
    rows = spark.read.schema("value string, group int").text(f"{path}/rows").select("group", fields.alias("cells"))
    rows = rows.select("group", parse_ts(F.get("cells", F.lit(0))).alias("ts"), "cells")
    cells = rows.join(headers, "group").select("ts", F.inline(F.arrays_zip("names", "cells"))).where(F.col("names") != ts_col)
    return cells.select(F.col("names").alias("series"), "ts", nan_to_null(F.when(F.col("cells") != "", F.col("cells")).cast("double")).alias("value"))


def write_predictions(pred: DataFrame, path: str, names: Sequence[str] | None = None,
                      fmt: str = "csv", single_file: bool = False) -> None:
    """Long predictions ``(series, ts, prediction)`` -> wide file, timestamp first."""
    write_panel(pred, path, names, fmt, value="prediction", single_file=single_file)


def write_scores(scores: DataFrame, path: str, fmt: str = "csv") -> None:
    """Score table sorted by error (ties by config id), written with a header."""
    out = scores.orderBy(F.col("mse").asc_nulls_last(), F.col("config_id"))
    if fmt == "csv":
        out.write.mode("overwrite").option("header", True).csv(path)
    else:
        out.write.mode("overwrite").parquet(path)


def write_folds(folds: DataFrame, path: str) -> None:
    """Each fold's train / val slices in their own folder (``fold=k/fold_role=r``)."""
    folds.write.mode("overwrite").partitionBy("fold", "fold_role").parquet(path)
