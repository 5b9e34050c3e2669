"""Datasets of points derived from event and order tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..model import Dataset, Value, dataset, points, tag_text, value


def _tag(**tags) -> F.Column:
    pairs = [x for k, v in tags.items() for x in (F.lit(k), tag_text(v))]
    return F.create_map(*pairs)


def _text(c) -> Value:
    return Value(frozenset(["string"]), F.lit("string"), {"string": c})


def _int(c) -> Value:
    return Value(frozenset(["int"]), F.lit("int"), {"int": c.cast("bigint")})


def melt(df: DataFrame, group, tags, metrics: dict[str, tuple[str, F.Column]]) -> DataFrame:
    """Points of a wide table: one a metric; null values are absent."""
    kinds = {"int": "bigint", "dbl": "double", "string": "string", "bool": "boolean"}
    rows = [F.struct(F.lit(m).alias("m"), *[(c if k == kind else F.lit(None)).cast(t).alias(k) for k, t in kinds.items()]) for m, (kind, c) in metrics.items()]
    tall = df.withColumn("group", group).withColumn("tags", tags).withColumn("x", F.explode(F.array(*rows)))
    v = value(**{k: F.col(f"x.{k}") for k in ("int", "dbl", "string", "bool")})
    return points(tall, F.col("group"), F.array(F.col("x.m")), v, F.col("tags")).filter("kind <> 'empty'")


def hourly_events(spark: SparkSession, sf_dir: str) -> Dataset:
    """Per hour and type: n and the running cum (long), total (double); group evh.<type>, tag type."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    per = e.groupBy(F.date_trunc("hour", "ts").alias("ts"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    per = per.withColumn("cum", F.sum("n").over(W.partitionBy("event_type").orderBy("ts")))
    made = melt(per, F.array(F.lit("evh"), F.col("event_type")), _tag(type=_text(F.col("event_type"))), {"n": ("int", F.col("n")), "total": ("dbl", F.col("total")), "cum": ("int", F.col("cum"))})
    return dataset(made, per.select("ts").distinct(), ["int", "dbl"], {"n": ["int"], "cum": ["int"], "total": ["dbl"]})


def user_events(spark: SparkSession, sf_dir: str) -> Dataset:
    """Per hour, type and user the last event: value (double), k (long); group ev.<type>, tag user."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("hour", F.date_trunc("hour", "ts"))
    last = e.groupBy(F.col("hour").alias("ts"), "event_type", "user_id").agg(F.max(F.struct("event_id", "value", "props")).alias("x"))
    k = F.get_json_object("x.props", "$.k").try_cast("bigint")
    made = melt(last, F.array(F.lit("ev"), F.col("event_type")), _tag(user=_int(F.col("user_id"))), {"value": ("dbl", F.col("x.value")), "k": ("int", k)})
    return dataset(made, e.select(F.col("hour").alias("ts")).distinct(), ["int", "dbl"], {"value": ["dbl"], "k": ["int"]})


def daily_sales(spark: SparkSession, sf_dir: str) -> Dataset:
    """Per day of shipping, return flag and status: qty and price (double), lines (long); group sales, tags flag, status."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    per = li.groupBy(F.date_trunc("day", "l_shipdate").alias("ts"), "l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("qty"), F.round(F.sum("l_extendedprice"), 2).alias("price"), F.count(F.lit(1)).alias("lines"))
    made = melt(per, F.array(F.lit("sales")), _tag(flag=_text(F.col("l_returnflag")), status=_text(F.col("l_linestatus"))), {"qty": ("dbl", F.col("qty")), "price": ("dbl", F.col("price")), "lines": ("int", F.col("lines"))})
    return dataset(made, per.select("ts").distinct(), ["int", "dbl"], {"qty": ["dbl"], "price": ["dbl"], "lines": ["int"]})


def order_groups(spark: SparkSession, sf_dir: str) -> Dataset:
    """One scrape of all customers' segments by nation: group customer.<segment>.<nation key>, tags nation; texts, longs and doubles."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").withColumn("ts", F.timestamp_seconds(F.lit(0)))
    per = c.groupBy("ts", "c_mktsegment", "c_nationkey").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("c_acctbal"), 2).alias("bal"), F.min("c_name").alias("first"))
    group = F.array(F.lit("customer"), F.lower("c_mktsegment"), F.col("c_nationkey").cast("string"))
    made = melt(per, group, _tag(nation=_int(F.col("c_nationkey")), segment=_text(F.lower("c_mktsegment"))), {"n": ("int", F.col("n")), "bal": ("dbl", F.col("bal")), "first": ("string", F.col("first"))})
    return dataset(made, per.select("ts").distinct(), ["int", "dbl", "string"], {"n": ["int"], "bal": ["dbl"], "first": ["string"]})


def documents(spark: SparkSession, sf_dir: str) -> Dataset:
    """One scrape of texts: lang and source (text), n_chars (long); group docs, tag id."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "source", "n_chars").withColumn("ts", F.timestamp_seconds(F.lit(0)))
    made = melt(d, F.array(F.lit("docs")), _tag(id=_int(F.col("doc_id"))), {"lang": ("string", F.col("lang")), "source": ("string", F.col("source")), "n_chars": ("int", F.col("n_chars"))})
    return dataset(made, d.select("ts").distinct(), ["int", "string"], {"lang": ["string"], "source": ["string"], "n_chars": ["int"]})


