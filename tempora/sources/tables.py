"""Graphs over the supplied tables. They are put together once per session and folder, whose files are taken not to change."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tempora.model import OPEN, Graph, PropertySpec

WEEK = 7 * 24 * 3600 * 1_000_000


def _micros(c: str) -> Column:
    """A zone-less timestamp as microseconds since the epoch; sessions run in UTC."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col(c))


def _events(spark: SparkSession, d: str) -> DataFrame:
    e = spark.read.parquet(f"{d}/events.parquet")
    return e.withColumn("ts_us", _micros("ts")).withColumn("k", F.get_json_object("props", "$.k").cast("bigint"))


@lru_cache(maxsize=16)
def activity(spark: SparkSession, d: str) -> Graph:
    """Users with a version per event; edges from users to keys, valid for a week; some errors are deletes."""
    e = _events(spark, d)
    dead = (F.col("event_type") == "error") & (F.col("event_id") % 16 == 0)
    v = e.select(
        (F.col("user_id") + 1).alias("id"), (F.col("event_id") + 1).alias("version"),
        F.when(~dead, F.col("ts_us")).alias("valid_from"), F.when(~dead, F.lit(OPEN)).alias("valid_to"),
        (F.col("event_id") + 1).alias("tx_time"), dead.alias("tombstone"), (F.col("event_id") + 1).alias("log_index"), F.lit(0).cast("bigint").alias("ordinal"),
        F.array(F.lit("User")).alias("labels"), "value", "event_type",
    )
    gone = (F.col("event_type") == "error") & (F.col("event_id") % 16 == 8)
    g = e.select(
        (F.col("user_id") * 100 + F.col("k") + 1).alias("id"), (F.col("event_id") + 1).alias("version"),
        F.when(~gone, F.col("ts_us")).alias("valid_from"), F.when(~gone, F.col("ts_us") + WEEK).alias("valid_to"),
        (F.col("event_id") + 1).alias("tx_time"), gone.alias("tombstone"), (F.col("event_id") + 1).alias("log_index"), F.lit(1).cast("bigint").alias("ordinal"),
        (F.col("user_id") + 1).alias("src"), (F.col("k") + 1).alias("dst"), F.upper("event_type").alias("edge_type"), "value",
    )
    return Graph(v, g, [PropertySpec("value", "float"), PropertySpec("event_type", "string")], [PropertySpec("value", "float")])


@lru_cache(maxsize=16)
def contacts(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The events as a static directed multigraph with times: vertices (id) and edges."""
    e = _events(spark, d)
    edges = e.select(
        (F.col("event_id") + 1).alias("id"), (F.col("user_id") + 1).alias("src"), (F.col("k") + 1).alias("dst"),
        F.col("ts_us").alias("departure"), (F.col("ts_us") + F.round(F.col("value") * 1_000_000).cast("bigint")).alias("arrival"),
        F.col("ts_us").alias("event_time"), F.col("value").alias("signal"), F.col("value").alias("weight"),
    )
    return edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct(), edges


def _static(df: DataFrame, identity: Column, labels: str, valid_from: Column, **props: Column) -> DataFrame:
    return df.select(
        identity.cast("bigint").alias("id"), F.lit(1).cast("bigint").alias("version"), valid_from.cast("bigint").alias("valid_from"), F.lit(OPEN).alias("valid_to"),
        F.lit(1).cast("bigint").alias("tx_time"), F.lit(False).alias("tombstone"), F.lit(1).cast("bigint").alias("log_index"), identity.cast("bigint").alias("ordinal"),
        F.array(F.lit(labels)).alias("labels"), *[c.alias(k) for k, c in props.items()],
    )


def _edge(df: DataFrame, identity: Column, src: Column, dst: Column, kind: str, valid_from: Column) -> DataFrame:
    return df.select(
        identity.cast("bigint").alias("id"), F.lit(1).cast("bigint").alias("version"), valid_from.cast("bigint").alias("valid_from"), F.lit(OPEN).alias("valid_to"),
        F.lit(1).cast("bigint").alias("tx_time"), F.lit(False).alias("tombstone"), F.lit(1).cast("bigint").alias("log_index"), identity.cast("bigint").alias("ordinal"),
        src.cast("bigint").alias("src"), dst.cast("bigint").alias("dst"), F.lit(kind).alias("edge_type"),
    )


#: Offsets of the kinds' identities.
REGION, NATION, CUSTOMER, SUPPLIER, PART, ORDER = (k * 1_000_000_000 for k in range(1, 7))


@lru_cache(maxsize=16)
def commerce(spark: SparkSession, d: str) -> Graph:
    """Regions, nations, customers, suppliers, parts and orders with what connects them."""
    t = {n: spark.read.parquet(f"{d}/{n}.parquet") for n in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")}
    at = lambda off, c: F.lit(off) + F.col(c) + 1
    zero, text, num = F.lit(0), F.lit(None).cast("string"), F.lit(None).cast("double")
    v = None
    for part in (
        _static(t["region"], at(REGION, "r_regionkey"), "Region", zero, name=F.col("r_name"), segment=text, amount=num),
        _static(t["nation"], at(NATION, "n_nationkey"), "Nation", zero, name=F.col("n_name"), segment=text, amount=num),
        _static(t["customer"], at(CUSTOMER, "c_custkey"), "Customer", zero, name=F.col("c_name"), segment=F.col("c_mktsegment"), amount=F.col("c_acctbal")),
        _static(t["supplier"], at(SUPPLIER, "s_suppkey"), "Supplier", zero, name=F.col("s_name"), segment=text, amount=F.col("s_acctbal")),
        _static(t["part"], at(PART, "p_partkey"), "Part", zero, name=F.col("p_name"), segment=F.col("p_brand"), amount=F.col("p_retailprice")),
        _static(t["orders"], at(ORDER, "o_orderkey"), "Order", _micros("o_orderdate"), name=F.col("o_orderpriority"), segment=F.col("o_orderstatus"), amount=F.col("o_totalprice")),
    ):
        v = part if v is None else v.unionByName(part)
    lines = t["lineitem"].groupBy("l_orderkey", "l_partkey").agg(F.min("l_shipdate").alias("first"))
    t12 = 1_000_000_000_000
    e = None
    for part in (
        _edge(t["nation"], F.lit(t12) + F.col("n_nationkey") + 1, at(NATION, "n_nationkey"), at(REGION, "n_regionkey"), "IN_REGION", zero),
        _edge(t["customer"], F.lit(2 * t12) + F.col("c_custkey") + 1, at(CUSTOMER, "c_custkey"), at(NATION, "c_nationkey"), "IN_NATION", zero),
        _edge(t["supplier"], F.lit(3 * t12) + F.col("s_suppkey") + 1, at(SUPPLIER, "s_suppkey"), at(NATION, "s_nationkey"), "IN_NATION", zero),
        _edge(t["orders"], F.lit(4 * t12) + F.col("o_orderkey") + 1, at(CUSTOMER, "o_custkey"), at(ORDER, "o_orderkey"), "PLACED", _micros("o_orderdate")),
        _edge(lines, F.lit(5 * t12) + F.col("l_orderkey") * 1_000_000 + F.col("l_partkey") + 1, at(ORDER, "l_orderkey"), at(PART, "l_partkey"), "CONTAINS", _micros("first")),
    ):
        e = part if e is None else e.unionByName(part)
    props = [PropertySpec("name", "string"), PropertySpec("segment", "string"), PropertySpec("amount", "float")]
    return Graph(v, e, props, [], fixed_types=True, fixed_labels=True)


#: Instants that the queries read at: 15 January 2024, and seven tenths of the events.
VALID_AT = 1_705_276_800_000_000


@lru_cache(maxsize=16)
def probe(spark: SparkSession, d: str) -> tuple[int, int]:
    return VALID_AT, spark.read.parquet(f"{d}/events.parquet").count() * 7 // 10
