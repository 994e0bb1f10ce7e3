"""Reading and writing panel files."""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import FLOOR, clip, col
from ..functions.storage import stored
from ..operators.ranking import global_rank

#: The traffic file's header: time, cell, and the four indicators (fixed values).
TRAFFIC_HEADER = ("时间", "小区名称", "小区上行平均激活用户数", "小区下行平均激活用户数", "下行平均使用的PRB个数", "上行平均使用的PRB个数")
PARAMETER_KEY, WEATHER_KEY = "标准小区名称", "日期(date)"
METRICS = ("m0", "m1", "m2", "m3")


def parse_metric(token: Column | str, strict: bool = False) -> Column:
    """A metric token as a number: NIL (and, unless strict, blank) is null; else finite and not negative."""
    text = F.trim(col(token))
    missing = (text == "NIL") if strict else text.isNull() | F.upper(text).isin("", "NIL")
    value = text.try_cast("double")
    good = value.isNotNull() & ~F.isnan(value) & (value >= 0) & (value < math.inf)
    return F.when(missing, F.lit(None).cast("double")).when(good, value).otherwise(F.raise_error(F.concat(F.lit("bad metric: "), F.coalesce(text, F.lit("null")))).cast("double"))


def parse_time(token: Column | str, strict: bool = False) -> Column:
    """A time as a timestamp without zone; strict readers also take ISO times and seconds."""
    formats = ["yyyy/M/d H:mm"] + (["yyyy/M/d H:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm"] if strict else [])
    parsed = [F.try_to_timestamp(F.trim(col(token)), F.lit(f)).cast("timestamp_ntz") for f in formats]
    return F.coalesce(*parsed, F.raise_error(F.concat(F.lit("bad time: "), F.coalesce(col(token), F.lit("null")))).cast("timestamp_ntz"))


def checked_header(spark: SparkSession, path: str, wanted: tuple[str, ...], exact: bool) -> list[str]:
    """The file's header without a byte-order mark; an error unless it starts with (or is) wanted."""
    line = spark.read.text(path).limit(1).first()
    found = [x.strip().strip('"') for x in (line[0] if line else "").lstrip("﻿").split(",")]
    if tuple(found[: len(wanted)]) != wanted or exact and len(found) != len(wanted):
        raise ValueError(f"{path}: header {found}")
    return found


def read_rows(spark: SparkSession, path: str, required: tuple[str, ...] = ()) -> DataFrame:
    """Any CSV as strings, with a check that required columns are there."""
    rows = spark.read.option("header", True).option("mode", "FAILFAST").csv(path)
    rows = rows.toDF(*[c.lstrip("﻿") for c in rows.columns])
    if missing := [c for c in required if c not in rows.columns]:
        raise ValueError(f"{path}: no columns {missing}")
    return rows


def read_traffic(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """file_row, ts, cell and m0..m3 of a traffic file.

    file_row numbers the rows in file order.  Splits of the file are read side by side; a
    row's number is its place in its split and the rows of the splits before.
    """
    names = checked_header(spark, path, TRAFFIC_HEADER, exact=strict)
    schema = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(names))])
    raw = spark.read.schema(schema).option("header", True).option("enforceSchema", True).option("mode", "PERMISSIVE").csv(path)
    split = {"file_": F.col("_metadata.file_path"), "block_": F.col("_metadata.file_block_start"), "id_": F.monotonically_increasing_id()}
    raw = stored(raw.withColumns(split), "traffic")
    blocks = raw.groupBy("file_", "block_").agg(F.min("id_").alias("first_"), F.count("*").alias("n_")).orderBy("file_", "block_").collect()  # one row a split
    offsets = [(r["file_"], r["block_"], sum(x["n_"] for x in blocks[:k]) - r["first_"]) for k, r in enumerate(blocks)]
    raw = raw.join(F.broadcast(spark.createDataFrame(offsets, "file_ string, block_ long, offset_ long")), ["file_", "block_"]).withColumn("file_row", F.col("id_") + F.col("offset_"))
    cell = F.when(F.length(F.trim("c1")) > 0, F.trim("c1")).otherwise(F.raise_error(F.lit("empty cell name")).cast("string"))
    return raw.select("file_row", parse_time("c0", strict).alias("ts"), cell.alias("cell"), *[parse_metric(f"c{i + 2}", strict).alias(m) for i, m in enumerate(METRICS)])


def label_codes(df: DataFrame, label: str, code: str) -> DataFrame:
    """df with the rank of each label among the sorted distinct ones."""
    codes = global_rank(df.select(label).distinct(), [label], code).withColumn(code, F.col(code).cast("int"))
    return df.join(F.broadcast(codes) if codes.count() < 100_000 else codes, label, "left")


def _number(name: str) -> Column:
    return F.coalesce(F.nullif(F.trim(name), F.lit("")).cast("double"), F.lit(0.0))


def read_parameters(spark: SparkSession, path: str) -> DataFrame:
    """cell, azimuth, scene_code, px and py of a parameter file; blank numbers are 0."""
    raw = read_rows(spark, path)
    if raw.columns[0] != PARAMETER_KEY or len(raw.columns) < 5:
        raise ValueError(f"{path}: header {raw.columns}")
    raw = raw.toDF("cell", "azimuth", "scene", "px", "py", *[f"more{i}" for i in range(len(raw.columns) - 5)])
    raw = raw.select(F.trim("cell").alias("cell"), _number("azimuth").alias("azimuth"), F.coalesce(F.trim("scene"), F.lit("")).alias("scene"), _number("px").alias("px"), _number("py").alias("py"))
    return label_codes(raw, "scene", "scene_code").select("cell", "azimuth", "scene_code", "px", "py")


def read_weather(spark: SparkSession, path: str) -> DataFrame:
    """date (yyyyMMdd), weather_code, temperature, humidity, rain and wind of a weather file."""
    raw = read_rows(spark, path)
    if raw.columns[0] != WEATHER_KEY or len(raw.columns) < 10:
        raise ValueError(f"{path}: header {raw.columns}")
    raw = raw.toDF(*[f"c{i}" for i in range(len(raw.columns))])
    raw = raw.select(F.trim("c0").alias("date"), F.coalesce(F.trim("c1"), F.lit("")).alias("kind"), *[_number(f"c{i}").alias(n) for i, n in ((4, "temperature"), (5, "humidity"), (7, "rain"), (9, "wind"))])
    return label_codes(raw, "kind", "weather_code").drop("kind")


def read_scenes(spark: SparkSession, path: str) -> DataFrame:
    """cell and scene label, unknown where blank."""
    raw = read_rows(spark, path, (PARAMETER_KEY,))
    return raw.select(F.trim(raw.columns[0]).alias("cell"), F.coalesce(F.expr(f"nullif(trim(`{raw.columns[2]}`), '')"), F.lit("unknown")).alias("scene"))


def read_config(path: str) -> dict:
    """A frozen seasonal configuration: six weights and four scales, finite and not negative."""
    with open(path, encoding="utf-8") as f:
        config = json.load(f)
    weights, scales = config.get("weights", ()), config.get("scales", ())
    good = all(isinstance(x, int | float) and math.isfinite(x) and x >= 0 for x in [*weights, *scales])
    if config.get("model") != "seasonal_baseline" or len(weights) != 6 or len(scales) != 4 or not good:
        raise ValueError(f"{path}: not a seasonal configuration")
    return config


def format_time(ts: Column | str) -> Column:
    """An unpadded Y/M/D H:00."""
    ts = col(ts)
    return F.concat(F.year(ts), F.lit("/"), F.month(ts), F.lit("/"), F.day(ts), F.lit(" "), F.hour(ts), F.lit(":00"))


def format_value(x: Column | str) -> Column:
    """Four decimals, floored."""
    x = col(x)
    return F.when(x.isNotNull(), F.format_string("%.4f", clip(x, FLOOR)))


def write_forecast(rows: DataFrame, path: str) -> None:
    """ts, cell and m0..m3 as a forecast file in the traffic layout; a null value is an error."""
    checked = [F.when(F.col(m).isNull(), F.raise_error(F.lit("null forecast")).cast("string")).otherwise(format_value(m)).alias(h) for m, h in zip(METRICS, TRAFFIC_HEADER[2:], strict=True)]
    rows.select(format_time("ts").alias(TRAFFIC_HEADER[0]), F.col("cell").alias(TRAFFIC_HEADER[1]), *checked).write.option("header", True).csv(path)


def write_wide(predictions: DataFrame, path: str, methods: list[str], compression: str = "none") -> None:
    """Long predictions (method, cell, ts, hz, metric, y, p) with a column for each method and metric, NIL for null."""
    wide = predictions.groupBy("ts", "cell", "hz")
    columns = [F.max(F.when(F.col("metric") == k, F.col("y"))).alias(f"actual_m{k}") for k in range(4)]
    columns += [F.max(F.when((F.col("metric") == k) & (F.col("method") == m), F.col("p"))).alias(f"{m}_m{k}") for m in methods for k in range(4)]
    wide = wide.agg(*columns)
    keys = {"ts", "cell", "hz"}
    wide.select(*[F.col(c) if c in keys else F.coalesce(F.col(c).cast("string"), F.lit("NIL")).alias(c) for c in wide.columns]).write.option("header", True).option("compression", compression).csv(path)


#: Fixed values of the sample request: first day, and for each indicator the base, daytime and commute parts.
SAMPLE_START = "2026-07-01"
SAMPLE_PARTS = ((18.0, 13.0, 4.0), (26.0, 22.0, 7.0), (32.0, 33.0, 10.0), (14.0, 18.0, 7.0))


def synthetic_request(spark: SparkSession, hours: int = 336) -> DataFrame:
    """A deterministic request of one cell: a daytime arch, two commute peaks, quieter weekends and a slow weekly wave."""
    hour = F.col("i") % 24
    peak = lambda at, width: F.exp(-F.pow((hour - at) / width, F.lit(2.0)))
    day, commute = F.greatest(F.lit(0.0), F.sin(math.pi * (hour - 6) / 16.0)), peak(9.0, 2.5) + 0.8 * peak(19.0, 3.0)
    weekend = F.when(F.weekday(F.expr(f"date_add(date'{SAMPLE_START}', cast(i div 24 as int))")) >= 5, 0.88).otherwise(1.0)
    whole = weekend * (1.0 + 0.025 * F.sin(2.0 * math.pi * F.col("i") / 168.0))
    rows = spark.range(hours).select(F.col("id").alias("i"))
    return rows.select("i", F.lit("synthetic-cell").alias("cell"), *[((a + b * day + c * commute) * whole).alias(m) for m, (a, b, c) in zip(METRICS, SAMPLE_PARTS, strict=True)])
