"""Study tables derived from the star-schema parquet tables: prices, names, links, news, predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickerloom.operators.bars import direction, weekly_bars
from tickerloom.params import Periods
from tickerloom.session import spread_for
from tickerloom.sources.tables import read_table

# Periods of the parquet tables, whose days run from 1995 to 2001.
PERIODS = Periods(("1995-01-01", "1998-12-31"), ("1999-01-01", "2001-12-31"))
RULE_MODELS = ("momentum", "reversal", "trend")


def _lines(spark: SparkSession, folder: str) -> DataFrame:
    """The largest table; shuffles of the session are cut by its size."""
    spread_for(spark, f"{folder}/lineitem.parquet")
    return read_table(spark, folder, "lineitem")


def panel_daily(spark: SparkSession, folder: str) -> DataFrame:
    """Security x day, with negative prices and missing returns mixed in."""
    lines = _lines(spark, folder)
    names = read_table(spark, folder, "supplier")
    sign = F.when(F.col("l_linenumber") == 7, -1).otherwise(1)
    missing = (F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "F")
    return lines.join(names, lines.l_suppkey == names.s_suppkey).select(
        F.col("l_suppkey").alias("permno"),
        F.col("l_suppkey").alias("permco"),
        F.concat(F.lit("T"), F.col("l_suppkey").cast("string")).alias("ticker"),
        F.col("s_name").alias("comnam"),
        (F.lit(5000) + F.col("s_nationkey") * 50).alias("siccd"),
        F.when(F.col("s_nationkey") % 2 == 0, 1).otherwise(2).alias("exchcd"),
        F.col("l_shipdate").cast("date").alias("date"),
        (sign * F.col("l_extendedprice") / F.col("l_quantity")).alias("prc"),
        (F.col("l_quantity") * 100).alias("shrout"),
        (F.lit(1.0) + F.col("l_tax")).alias("cfacpr"),
        F.when(~missing, F.col("l_discount") - 0.05).alias("ret"),
        F.col("l_orderkey").alias("rec_id"),
        F.col("l_linenumber").alias("rec_line"),
    )


def stock_names(spark: SparkSession, folder: str) -> DataFrame:
    """Name history: two records per security, with the dates each was valid."""
    base = read_table(spark, folder, "supplier")
    records = F.array(
        F.struct(F.lit("").alias("suffix"), F.lit("1900-01-01").alias("first"), F.lit("1997-12-31").alias("last")),
        F.struct(F.lit(" II").alias("suffix"), F.lit("1998-01-01").alias("first"), F.lit("2099-12-31").alias("last")),
    )
    return base.withColumn("r", F.explode(records)).select(
        F.col("s_suppkey").alias("permno"),
        F.concat("s_name", "r.suffix").alias("comnam"),
        F.concat(F.lit("T"), F.col("s_suppkey").cast("string")).alias("ticker"),
        (F.lit(5000) + F.col("s_nationkey") * 50).alias("siccd"),
        F.col("r.first").cast("date").alias("namedt"),
        F.col("r.last").cast("date").alias("nameendt"),
    )


def link_table(spark: SparkSession, folder: str) -> DataFrame:
    """Company key to security; some companies have no link and some have two share classes."""
    base = read_table(spark, folder, "supplier")
    classes = F.when(
        F.col("s_acctbal") >= 0,
        F.when(F.col("s_nationkey") < 5, F.array(F.lit(0), F.lit(1000000))).otherwise(F.array(F.lit(0))),
    )
    return base.withColumn("extra", F.explode(classes)).select(
        F.lpad(F.col("s_suppkey").cast("string"), 6, "0").alias("gvkey"),
        (F.col("s_suppkey") + F.col("extra")).alias("lpermno"),
        F.col("s_suppkey").alias("lpermco"),
    )


def _order_lines(spark: SparkSession, folder: str) -> DataFrame:
    orders = read_table(spark, folder, "orders")
    lines = _lines(spark, folder)
    parts = read_table(spark, folder, "part")
    return orders.join(lines, orders.o_orderkey == lines.l_orderkey).join(parts, lines.l_partkey == parts.p_partkey)


def news_linked(spark: SparkSession, folder: str) -> DataFrame:
    """Company news that already carries its company; one event reaches several companies."""
    return news_records(spark, folder).distinct()


def news_records(spark: SparkSession, folder: str) -> DataFrame:
    """The same with a row for every record, for a caller that takes the distinct ones of fewer columns itself."""
    return _order_lines(spark, folder).select(
        F.col("o_orderkey").alias("keydevid"),
        F.col("l_suppkey").alias("permco"),
        F.col("o_orderdate").cast("date").alias("announcedate"),
        F.col("o_orderpriority").alias("eventtype"),
        F.concat_ws(" ", "p_name", "o_orderpriority").alias("headline"),
    )


def news_events(spark: SparkSession, folder: str) -> DataFrame:
    """Company news before linking: text company key, and headlines that may be missing."""
    return _order_lines(spark, folder).select(
        F.col("o_orderkey").alias("keydevid"),
        F.lpad(F.col("l_suppkey").cast("string"), 6, "0").alias("gvkey"),
        F.col("o_orderdate").cast("date").alias("announcedate"),
        F.when(F.col("l_returnflag") != "R", F.col("p_name")).alias("headline"),
    ).distinct()


def news_detail(spark: SparkSession, folder: str) -> DataFrame:
    """Situation text per event and headline."""
    return _order_lines(spark, folder).select(
        F.col("o_orderkey").alias("keydevid"),
        F.when(F.col("l_returnflag") != "R", F.col("p_name")).alias("headline"),
        F.col("p_type").alias("situation"),
    ).distinct()


def weekly(spark: SparkSession, folder: str) -> DataFrame:
    return direction(weekly_bars(panel_daily(spark, folder)))


def rule_predictions(spark: SparkSession, folder: str) -> DataFrame:
    return rule_votes(weekly(spark, folder))


def rule_votes(bars: DataFrame) -> DataFrame:
    """Three rule-based models over weekly bars with direction, in the out-of-sample period.

    Windows run along the weeks of one security, so their size is bounded by the calendar.
    """
    w = Window.partitionBy("permco", "ticker").orderBy("end_date")
    up = F.when(F.col("direction") == "Up", 1).otherwise(0)
    base = bars.select(
        "permco", "ticker", "end_date", up.alias("true_direction"), F.lag(up).over(w).alias("before"),
        F.lag("adj_prc", 1).over(w).alias("last_price"), F.lag("adj_prc", 4).over(w).alias("old_price"),
    ).where(F.col("old_price").isNotNull() & (F.col("end_date") >= F.lit(PERIODS.out_of_sample[0]).cast("date")))
    rising = F.when(F.col("last_price") > F.col("old_price"), 1).otherwise(0)
    votes = F.array(
        F.struct(F.lit("momentum").alias("model"), F.col("before").alias("vote")),
        F.struct(F.lit("reversal").alias("model"), (1 - F.col("before")).alias("vote")),
        F.struct(F.lit("trend").alias("model"), rising.alias("vote")),
    )
    return base.withColumn("v", F.explode(votes)).select(
        "permco", "ticker", "end_date", "true_direction",
        F.col("v.vote").alias("predicted_direction"), F.col("v.model").alias("model"),
    )


def dirty_size_lines(spark: SparkSession, folder: str) -> DataFrame:
    """CSV lines of a size file: good, short and long rows, letters in numeric fields, bad dates."""
    lines = _lines(spark, folder)
    line = F.col("l_linenumber")
    day = F.when(line == 6, F.lit("not a day")).otherwise(F.col("l_shipdate").cast("date").cast("string"))
    price = F.when(line == 2, F.lit("C")).otherwise(F.col("l_extendedprice").cast("string"))
    good = F.concat_ws(",", day, F.concat(F.lit("T"), F.col("l_suppkey").cast("string")), F.lit("1"), price)
    shares = F.col("l_quantity").cast("string")
    return lines.select(
        F.when(line == 3, good)
        .when(line == 5, F.concat_ws(",", good, shares, F.lit("extra"), F.lit("more")))
        .otherwise(F.concat_ws(",", good, shares)).alias("value")
    )
