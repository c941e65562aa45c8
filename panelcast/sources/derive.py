"""Weekly retail tables derived from a star schema of orders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.functions.calendar import week_start
from panelcast.functions.rows import round_scaled
from panelcast.sources.tables import read_star

# Size unit carried by each part type (fixed values).
SIZE_UNIT = {
    "STANDARD": "OZ",
    "SMALL": "ML",
    "LARGE": "LT",
    "PROMO": "CT",
    "ECONOMY": "OZ",
    "MEDIUM": "ML",
}

# Tasks of the join with orders, and of the grouping to customers, for each split of the lines.
TASKS_A_SPLIT = 16


def _hundredths(name: str) -> Column:
    """Whole hundredths of a value with two decimals; built-in round goes through BigDecimal."""
    return F.floor(F.col(name) * 100 + 0.5)


def _tasks(lines: DataFrame) -> int:
    return TASKS_A_SPLIT * max(1, lines.rdd.getNumPartitions())


def sale_lines(spark: SparkSession, sf_dir: str, store_level: str = "region") -> DataFrame:
    """One row per order line with its (store, product, week).

    Dimension sides carry no broadcast hint: Spark broadcasts those it measures
    under its own threshold and sort-merges the rest, where adaptive execution
    splits skewed partitions. Suppliers and nations join the lines one by one: of the
    two joined first, Spark knows no size and would sort the lines for them. Lines meet
    their orders in a number of tasks that follows the input, so what a task sorts and
    groups doesn't grow with it.
    """
    store = {"region": "n_regionkey", "nation": "s_nationkey"}[store_level]
    supplier = read_star(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("l_suppkey"), "s_nationkey"
    )
    nation = read_star(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    products = read_star(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("upc_id")
    )
    buyers = read_star(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("l_orderkey"), "o_custkey"
    )
    lines = read_star(spark, sf_dir, "lineitem")
    tasks = _tasks(lines)
    return (
        lines.join(supplier, "l_suppkey")
        .join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
        .withColumn("store_id", F.col(store).cast("string"))
        .join(products, "l_partkey")
        .repartition(tasks, "l_orderkey")
        .join(buyers.repartition(tasks, "l_orderkey"), "l_orderkey")
        .select(
            "store_id",
            "upc_id",
            week_start(F.col("l_shipdate")).alias("week"),
            "l_orderkey",
            "o_custkey",
            F.col("l_quantity").alias("quantity"),
            _hundredths("l_extendedprice").alias("cents"),
            _hundredths("l_discount").alias("discount"),
            _hundredths("l_tax").alias("tax"),
        )
    )


def transactions(spark: SparkSession, sf_dir: str, store_level: str = "region") -> DataFrame:
    """Weekly sales per (store, product).

    The two distinct counts are taken by grouping first to orders, then to
    customers, then to the cell. Each step combines map-side and only narrows,
    where two count-distincts in one aggregate would triple the rows. Money is
    summed in whole cents: exact, and cheaper than wide decimals. Hardly two orders share
    a customer and a cell, so that grouping takes its own number of tasks, which follows
    the input; a size in bytes lets many narrow rows into one task.
    """
    cell = ["store_id", "upc_id", "week"]
    sums = ["quantity", "cents", "discount", "tax", "lines"]
    orders = (
        sale_lines(spark, sf_dir, store_level)
        .groupBy(*cell, "o_custkey", "l_orderkey")
        .agg(
            *[F.sum(c).alias(c) for c in sums[:-1]],
            F.count(F.lit(1)).alias("lines"),
        )
    )
    tasks = _tasks(read_star(spark, sf_dir, "lineitem"))
    buyers = orders.repartition(tasks, *cell, "o_custkey").groupBy(*cell, "o_custkey").agg(
        *[F.sum(c).alias(c) for c in sums], F.count(F.lit(1)).alias("orders")
    )
    cells = buyers.groupBy(*cell).agg(
        *[F.sum(c).alias(c) for c in sums],
        F.sum("orders").alias("visits"),
        F.count(F.lit(1)).alias("hhs"),
    )
    lines = F.col("lines")
    feature = F.col("discount") > 6 * lines
    display = 100 * F.col("tax") > 480 * lines
    tpr = (F.col("discount") > 5 * lines) & ~feature & ~display
    spend = F.col("cents") / 100
    price = F.try_divide(spend, F.col("quantity"))
    return cells.select(
        "week",
        "store_id",
        "upc_id",
        F.col("quantity").alias("units"),
        "visits",
        "hhs",
        spend.alias("spend"),
        round_scaled(price, 4).alias("price"),
        round_scaled(price * 1.1, 4).alias("base_price"),
        feature.cast("int").alias("feature"),
        display.cast("int").alias("display"),
        tpr.cast("int").alias("tpr_only"),
    )


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per product: its key and category."""
    brands = read_star(spark, sf_dir, "part").select(F.col("p_brand").alias("upc_id")).distinct()
    number = F.substring("upc_id", 7, 10).cast("int")
    return brands.select("upc_id", F.format_string("CAT%d", number % 4).alias("category"))


def sized_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts with a textual product size such as `12 OZ`."""
    unit = F.create_map(*[F.lit(v) for pair in SIZE_UNIT.items() for v in pair])
    return read_star(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("upc"),
        F.col("p_name").alias("description"),
        F.concat_ws(" ", F.col("p_size").cast("string"), unit[F.col("p_type")]).alias(
            "product_size"
        ),
    )


def store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Store rows with repeated ids: suppliers, plus the matching one in seven customers."""

    def tier(c: str) -> Column:
        return (
            F.when(F.col(c) < 2500, "VALUE").when(F.col(c) < 6500, "MAINSTREAM").otherwise("UPSCALE")
        )

    supplier = read_star(spark, sf_dir, "supplier")
    customer = read_star(spark, sf_dir, "customer")
    own = supplier.select(
        F.col("s_suppkey").alias("store_id"), "s_nationkey", tier("s_acctbal").alias("seg_value_name")
    )
    again = (
        customer.where(F.col("c_custkey") % 7 == 0)
        .join(supplier, F.col("c_custkey") == F.col("s_suppkey"))
        .select(
            F.col("c_custkey").alias("store_id"),
            "s_nationkey",
            tier("c_acctbal").alias("seg_value_name"),
        )
    )
    return own.unionByName(again)
