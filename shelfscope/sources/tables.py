"""Tables and the observation view over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PRICE_POINT = "struct<price:double,available:boolean>"
PRODUCT = (
    "origin string, key string, identity_key string, name string, brand string, price double, currency string, "
    "price_usd double, available boolean, url string, gtin string, sku string, slug string, tokens array<string>, "
    "trigrams array<string>, first_seen_at timestamp, last_seen_at timestamp, price_updated_at timestamp, "
    "price_history array<struct<t:timestamp,price:double,available:boolean>>"
)
EVENT = f"origin string, key string, identity_key string, type string, name string, url string, old {PRICE_POINT}, new {PRICE_POINT}, at timestamp"
SNAPSHOT = (
    "snapshot_id string, origin string, key string, finished_at timestamp, full boolean, added long, removed long, "
    "price_changed long, stock_changed long, renamed long, products long"
)
RAW_ROW = "origin string, name string, brand string, price double, currency string, available boolean, url string, sku string, gtin string, ord long"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table of the catalogue; filters and column choices reach the Parquet scan."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def observations(lineitem: DataFrame) -> DataFrame:
    """Prices of products at stores over time: (store_id, product_id, t, price, available). Stores are
    the suppliers and products the parts, so that keys grow with the data."""
    unit = F.floor(F.col("l_extendedprice") / F.col("l_quantity") * 100 + 0.5) / 100
    return (
        lineitem.groupBy(F.col("l_suppkey").alias("store_id"), F.col("l_partkey").alias("product_id"), F.col("l_shipdate").alias("t"))
        .agg(F.min(unit).alias("price"), (F.min(F.when(F.col("l_returnflag") == "R", 0).otherwise(1)) == 1).alias("available"))
    )


def by_product(lineitem: DataFrame) -> DataFrame:
    """Each product's rows at a store in one part, so that groups of store and product need no other
    shuffle. The parts are as many as are set: merged to 64 MB, each would hold millions of groups in
    memory, once for every aggregation of the task. Not for plans whose tasks take long to start."""
    parts = int(lineitem.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return lineitem.repartition(parts, "l_suppkey", "l_partkey")


def monthly(obs: DataFrame) -> DataFrame:
    """Each month as one crawl: the last observation of every product in it."""
    last = F.max_by(F.struct("price", "available"), "t")
    return obs.groupBy("store_id", "product_id", month_of("t").alias("month")).agg(last.alias("v")).select("store_id", "product_id", "month", "v.price", "v.available")


def month_of(t: str) -> Column:
    """Months counted from year 0, so that consecutive months differ by 1."""
    return (F.year(t) * 12 + F.month(t) - 1).cast("long")


def rates(spark: SparkSession, values: dict[str, float]) -> DataFrame:
    """A fixed table of currency units per USD; with no rates every conversion is null."""
    return spark.createDataFrame(sorted(values.items()), "currency string, rate double")


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).distinct()


def lookup(df: DataFrame, column: str, value: object) -> DataFrame:
    return df.where(F.col(column) == value).limit(1)


def dealt(df: DataFrame, key: str) -> DataFrame:
    """Rows of a small file over all cores, for a step that takes long for each row: the bytes of a
    file alone decide into how many tasks it is read."""
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism, key)
