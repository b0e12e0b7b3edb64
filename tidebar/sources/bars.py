"""Bars: adapters from raw events, cleaning, upserts, inventory and storage."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidebar.functions.params import TIMEFRAME_SECONDS, lookup
from tidebar.functions.scalar import col, finite
from tidebar.operators.timeline import KEYS, epoch, positioned

BAR_SCHEMA = T.StructType(
    [
        T.StructField("symbol", T.StringType()),
        T.StructField("timeframe", T.StringType()),
        T.StructField("ts", T.TimestampType()),
        *[T.StructField(c, T.DoubleType()) for c in ("open", "high", "low", "close", "volume")],
    ]
)
PRICES = ("open", "high", "low", "close")
OHLCV = (*PRICES, "volume")
# fixed values: accepted names of the time column
TIME_ALIASES = ("open_time", "opentime", "timestamp", "time", "date")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slot(ts: Column | str, seconds: int) -> Column:
    """Start of the fixed-width interval that holds ``ts``."""
    return F.timestamp_seconds(F.floor(epoch(ts) / F.lit(seconds)) * seconds)


def event_order(ts: Column | str, tie: Column | str) -> Column:
    """One number that sorts like (ts, tie), for a tie that is a long.

    Aggregates ordered by a struct sort all their input first; ordered by a number they hash.
    """
    wide = F.unix_micros(ts).cast("decimal(17,0)") * F.lit(Decimal(2 * 10**19)).cast("decimal(20,0)")
    return (wide + col(tie).cast("long").cast("decimal(20,0)")).cast("decimal(38,0)")


def build_bars(
    ticks: DataFrame,
    symbol: Column | str,
    price: Column | str,
    ts: Column | str,
    tie: Column | str,
    timeframe: str,
    volume: Column | None = None,
    priced: bool = True,
) -> DataFrame:
    """Tumbling OHLCV bars. Aggregated map-side, so a hot symbol shuffles bars, not ticks.

    ``tie`` orders ticks of one instant and is a long. ``priced`` leaves out ticks without a
    positive price; without it they stay, for a quality report to count them.
    """
    seconds = TIMEFRAME_SECONDS[timeframe]
    t = ticks.select(
        col(symbol).cast("string").alias("symbol"),
        col(price).cast("double").alias("p"),
        col(ts).cast("timestamp").alias("t"),
        event_order(col(ts).cast("timestamp"), tie).alias("seq"),
        (F.lit(1.0) if volume is None else volume).alias("v"),
    )
    if priced:
        t = t.filter("p > 0")
    return (
        t.groupBy("symbol", slot("t", seconds).alias("ts"))
        .agg(
            F.min_by("p", "seq").alias("open"),
            F.max("p").alias("high"),
            F.min("p").alias("low"),
            F.max_by("p", "seq").alias("close"),
            F.sum("v").alias("volume"),
        )
        .select("symbol", F.lit(timeframe).alias("timeframe"), "ts", *OHLCV)
    )


def event_bars(spark: SparkSession, sf_dir: str, timeframe: str = "1h",
               by: str = "event_type") -> DataFrame:
    """Bars of ``events``: symbol = event type (or user), price = value, volume = count."""
    return build_bars(table(spark, sf_dir, "events"), by, "value", "ts", "event_id", timeframe)


def order_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long daily bars of ``orders``: symbol = priority, price = order total."""
    return build_bars(
        table(spark, sf_dir, "orders"),
        "o_orderpriority", "o_totalprice", "o_orderdate", "o_orderkey", "1d",
    )


def lineitem_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Volume-heavy daily bars of ``lineitem``: price = unit price, volume = quantity."""
    return build_bars(
        table(spark, sf_dir, "lineitem"),
        "l_returnflag", F.col("l_extendedprice") / F.col("l_quantity"), "l_shipdate",
        F.col("l_orderkey").cast("long") * 1024 + F.col("l_linenumber"), "1d",
        F.col("l_quantity"),
    )


def normalise_bars(
    raw: DataFrame, symbol: Column | str | None = None, timeframe: str | None = None
) -> DataFrame:
    """Clean one landed file: trim and lower names, find the time column, coerce numbers.

    Unparsable numbers become NULL; rows without a close are dropped.
    """
    names = {}
    for c in raw.columns:
        key = c.strip().lower()
        names.setdefault("ts" if key in TIME_ALIASES or key == "ts" else key, c)
    if "ts" not in names:
        raise ValueError("no time column")

    def quoted(name: str) -> Column:
        return F.col(f"`{names[name]}`")

    kind = raw.schema[names["ts"]].dataType
    stamp = quoted("ts")
    if isinstance(kind, T.NumericType):
        stamp = F.timestamp_millis(stamp.cast("long"))
    elif isinstance(kind, T.StringType):
        stamp = F.try_to_timestamp(stamp)
    ids = []
    for name, given in (("symbol", symbol), ("timeframe", timeframe)):
        if given is not None:
            c = given if isinstance(given, Column) else F.lit(given)
        else:
            c = quoted(name)
        ids.append(c.cast("string").alias(name))
    values = [
        finite(F.expr(f"try_cast(`{names[c]}` AS double)")).alias(c) for c in OHLCV if c in names
    ]
    return raw.select(*ids, stamp.cast("timestamp").alias("ts"), *values).filter(
        F.col("close").isNotNull() & F.col("ts").isNotNull()
    )


def bars_from_json(df: DataFrame, payload: Column | str, symbol: Column | str,
                   timeframe: str) -> DataFrame:
    """Exchange candles in JSON, as arrays ``[ms,o,h,l,c,v]`` or as objects, to bars."""
    text = col(payload)
    as_list = F.from_json(text, "array<array<double>>")
    as_obj = F.from_json(
        text,
        "array<struct<timestamp:bigint,open:double,high:double,low:double,"
        "close:double,volume:double>>",
    )
    listed = F.transform(
        as_list,
        lambda r: F.struct(
            F.get(r, F.lit(0)).cast("long").alias("timestamp"),
            *[F.get(r, F.lit(i)).alias(c) for i, c in enumerate(OHLCV, 1)],
        ),
    )
    is_obj = F.ltrim(text).rlike(r"^\[\s*\{")
    return (
        df.select(col(symbol).alias("symbol"),
                  F.explode(F.when(is_obj, as_obj).otherwise(listed)).alias("k"))
        .select("symbol", F.lit(timeframe).alias("timeframe"),
                F.timestamp_millis("k.timestamp").alias("ts"),
                *[finite(f"k.{c}").alias(c) for c in OHLCV])
        .dropna(subset=list(PRICES))
    )


def keep_one(df: DataFrame, keys: list[str], seq: str, last: bool = True) -> DataFrame:
    """One row per key: the newest (or oldest) by the number ``seq``, which must differ among the
    rows of a key. An aggregate, so copies of a key collapse on the map side instead of meeting
    in one window partition; a value for each column, so that it hashes and does not sort."""
    rest = [c for c in df.columns if c not in keys]
    pick = F.max_by if last else F.min_by
    return df.groupBy(*keys).agg(*[pick(c, seq).alias(c) for c in rest]).select(*df.columns)


def upsert(existing: DataFrame, fresh: DataFrame, keys=("symbol", "timeframe", "ts"),
           seq: str | None = None) -> DataFrame:
    """Union of old and new bars where the new bar of a key wins.

    ``seq`` names a long of ``fresh`` in which its rows were taken in: of several new bars of one
    key the last wins. Without it the new bars must have one row a key.
    """
    order = F.lit(0).cast("long") if seq is None else F.col(seq).cast("long")
    old = existing.withColumn("__gen", F.lit(-1).cast("decimal(38,0)"))
    new = fresh.withColumn("__gen", order.cast("decimal(20,0)") + F.lit(Decimal(2**63)).cast("decimal(20,0)"))
    both = old.unionByName(new.withColumn("__gen", F.col("__gen").cast("decimal(38,0)")).select(
        *existing.columns, "__gen"))
    return keep_one(both, list(keys), "__gen").drop("__gen")


def write_bars(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Parquet with zstd, one folder per (symbol, timeframe); rewrites touched folders only.

    Month salting spreads a hot symbol over many writers and files.
    """
    (
        df.withColumn("__month", F.date_trunc("month", "ts"))
        .repartition("symbol", "timeframe", "__month")
        .sortWithinPartitions("symbol", "timeframe", "ts")
        .drop("__month")
        .write.mode(mode)
        .option("partitionOverwriteMode", "dynamic")
        .option("compression", "zstd")
        .partitionBy("symbol", "timeframe")
        .parquet(path)
    )


def read_bars(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(BAR_SCHEMA).parquet(path)


def work_list(bars: DataFrame, asof: Column, min_age_days: int = 2, refetch_days: int = 0
              ) -> DataFrame:
    """Per series: where to resume fetching, how many bars are missing, and whether to skip."""
    seconds = lookup(TIMEFRAME_SECONDS, F.col("timeframe"), 900)
    last = F.col("last_ts")
    gap = F.floor((F.unix_seconds(asof) - F.unix_seconds(last)) / seconds)
    age = F.floor((F.unix_seconds(asof) - F.unix_seconds(last)) / 86400)
    return (
        bars.groupBy("symbol", "timeframe")
        .agg(F.max("ts").alias("last_ts"), F.count(F.lit(1)).alias("bars"))
        .select(
            "symbol", "timeframe", "bars", "last_ts",
            (F.timestamp_seconds(F.unix_seconds(last) + seconds)
             if not refetch_days
             else F.timestamp_seconds(F.unix_seconds(asof) - refetch_days * 86400)
             ).alias("resume_ts"),
            F.timestamp_seconds(F.unix_seconds(last) - 7200).alias("overlap_ts"),
            gap.alias("missing_bars"),
            ((gap <= 1) if not refetch_days else F.lit(False)).alias("up_to_date"),
            ((age < min_age_days) if not refetch_days else F.lit(False)).alias("fresh"),
        )
    )


def inventory(bars: DataFrame, asof: Column, stale_days: int = 2) -> DataFrame:
    """Bars, date range and staleness of every stored series."""
    age = F.floor((F.unix_seconds(asof) - F.unix_seconds("end_ts")) / 86400)
    return (
        bars.groupBy("symbol", "timeframe")
        .agg(F.count(F.lit(1)).alias("bars"), F.min("ts").alias("start_ts"),
             F.max("ts").alias("end_ts"))
        .withColumn("days", F.floor(
            (F.unix_seconds("end_ts") - F.unix_seconds("start_ts")) / 86400))
        .withColumn("age_days", age)
        .withColumn("stale", age > stale_days)
    )


def landed_files(spark: SparkSession, folder: str) -> DataFrame:
    """The files of a bar folder as a table: symbol, timeframe, path, bytes, modified; no file is opened.

    Spark lists the folder; ``write_bars`` names the series in the folders of its files.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option(
        "pathGlobFilter", "*.parquet").load(folder)
    part = r"symbol=([^/]*)/timeframe=([^/]*)/"
    return files.select(
        F.url_decode(F.regexp_extract("path", part, 1)).alias("symbol"),
        F.url_decode(F.regexp_extract("path", part, 2)).alias("timeframe"),
        "path", F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"))


def missing_files(wanted: DataFrame, files: DataFrame, asof: Column | None = None, stale_days: int = 2) -> DataFrame:
    """Each wanted series (symbol, timeframe) with its number of files, their bytes, and whether it is to be fetched.

    A series is ``missing`` without a file that holds anything, or with ``asof`` where its newest file is older
    than ``stale_days``.
    """
    have = files.groupBy("symbol", "timeframe").agg(
        F.count(F.lit(1)).alias("files"), F.sum("bytes").alias("bytes"), F.max("modified").alias("modified"))
    df = wanted.join(have, ["symbol", "timeframe"], "left").fillna(0, ["files", "bytes"])
    missing = F.col("bytes") == 0
    if asof is not None:
        age = F.unix_seconds(asof) - F.unix_seconds("modified")
        missing = missing | (age > stale_days * 86400)
    return df.withColumn("missing", F.coalesce(missing, F.lit(True)))


def roll_up(bars: DataFrame, timeframe: str) -> DataFrame:
    """Coarser bars from finer ones."""
    seconds = TIMEFRAME_SECONDS[timeframe]
    return (
        bars.groupBy("symbol", slot("ts", seconds).alias("slot"))
        .agg(
            F.min_by("open", "ts").alias("open"), F.max("high").alias("high"),
            F.min("low").alias("low"), F.max_by("close", "ts").alias("close"),
            F.sum("volume").alias("volume"),
        )
        .select("symbol", F.lit(timeframe).alias("timeframe"), F.col("slot").alias("ts"), *OHLCV)
    )


def numbered(bars: DataFrame, keys=KEYS, bucket_bars: int = 4096) -> DataFrame:
    """Bars with their position in the series (``pos``)."""
    seconds = lookup(TIMEFRAME_SECONDS, F.col("timeframe"), 900) * bucket_bars
    return positioned(bars, keys, F.floor(epoch() / seconds), ["ts"])


def numbered_with_obv(bars: DataFrame, bucket_bars: int = 4096) -> DataFrame:
    """Bars with ``pos`` and the running on-balance volume ``obv``.

    The sign of a bucket's first bar depends on the last close of the bucket before, so it
    is settled on the one-row-per-bucket summary, together with both running totals.
    """
    seconds = lookup(TIMEFRAME_SECONDS, F.col("timeframe"), 900) * bucket_bars
    b = bars.withColumn("__b", F.floor(epoch() / seconds))
    w = Window.partitionBy(*KEYS, "__b").orderBy("ts")
    step = F.signum(F.col("close") - F.lag("close").over(w)) * F.col("volume")
    rows = b.withColumn("__step", F.coalesce(step, F.lit(0.0))).select(
        "*",
        F.row_number().over(w).alias("__rn"),
        F.sum("__step").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("__obv"),
    )
    summary = rows.groupBy(*KEYS, "__b").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("__step").alias("moved"),
        F.min_by("close", "ts").alias("c0"),
        F.min_by("volume", "ts").alias("v0"),
        F.max_by("close", "ts").alias("c1"),
    )
    along = Window.partitionBy(*KEYS).orderBy("__b")
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    opening = F.coalesce(F.signum(F.col("c0") - F.lag("c1").over(along)) * F.col("v0"), F.lit(0.0))
    carried = (
        summary.withColumn("opening", opening)
        .withColumn("total", F.col("moved") + F.col("opening"))
        .select(
            *KEYS, "__b",
            F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__n0"),
            (F.coalesce(F.sum("total").over(before), F.lit(0.0)) + F.col("opening")).alias("__o0"),
        )
    )
    return rows.join(carried, [*KEYS, "__b"]).select(
        *bars.columns,
        (F.col("__n0") + F.col("__rn") - 1).alias("pos"),
        (F.col("__o0") + F.col("__obv")).alias("obv"),
    )
