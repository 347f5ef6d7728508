"""The commerce model derived from the shared test tables, one lazy frame per model table."""

from __future__ import annotations

from functools import cached_property, partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from merchantry.functions.documents import row_image
from merchantry.functions.scalar import MONEY, money
from merchantry.sources.tables import TABLES, load_table, stream_table, table_path


def _order_status() -> Column:
    return (
        F.when(F.col("o_orderstatus") == "F", "delivered")
        .when(F.col("o_orderstatus") == "O", "processing")
        .when(F.col("o_orderpriority") == "5-LOW", "cancelled")
        .when(F.col("o_orderpriority") == "4-NOT SPECIFIED", "refunded")
        .otherwise("pending")
    )


def _payment_status() -> Column:
    return (
        F.when(F.col("o_orderstatus") == "F", "paid")
        .when(F.col("o_orderstatus") == "O", "pending")
        .when(F.col("o_orderpriority").isin("5-LOW", "4-NOT SPECIFIED"), "refunded")
        .otherwise("pending")
    )


class _Raw(dict):
    """Test tables by name, opened when first asked for."""

    def __init__(self, spark: SparkSession, directory: str):
        super().__init__()
        self._open = partial(load_table, spark, directory)

    def __missing__(self, name: str) -> DataFrame:
        self[name] = self._open(name)
        return self[name]


class Model:
    """Model frames over one table directory. A frame is built when it is first asked for."""

    def __init__(self, spark: SparkSession, directory: str):
        self.spark = spark
        self.directory = directory
        self.raw = _Raw(spark, directory)

    def streaming(self, table: str) -> Model:
        """The same model with one table read as a stream of files."""
        other = Model(self.spark, self.directory)
        other.raw[table] = stream_table(self.spark, table_path(self.directory, table), TABLES[table])
        return other

    @cached_property
    def customers(self) -> DataFrame:
        first = self.raw["orders"].groupBy("o_custkey").agg(F.min("o_orderdate").alias("created_at"))
        c = self.raw["customer"].join(first, F.col("c_custkey") == F.col("o_custkey"), "left")
        parts = F.split("c_name", "#")
        status = (
            F.when(F.col("c_mktsegment") == "MACHINERY", "inactive")
            .when(F.col("c_mktsegment") == "FURNITURE", "suspended")
            .otherwise("active")
        )
        return c.select(
            F.col("c_custkey").alias("customer_id"),
            F.concat("c_name", F.lit("@Example.com")).alias("email"),
            parts[0].alias("first_name"),
            parts[1].alias("last_name"),
            F.concat(F.lit("+1-555-"), parts[1]).alias("phone"),
            F.date_add(F.lit("1960-01-01").cast("date"), F.floor("c_acctbal").cast("int")).alias("date_of_birth"),
            status.alias("customer_status"),
            "created_at",
        )

    @cached_property
    def addresses(self) -> DataFrame:
        places = self.raw["nation"].join(self.raw["region"], F.col("n_regionkey") == F.col("r_regionkey"))
        c = self.raw["customer"].join(places, F.col("c_nationkey") == F.col("n_nationkey"))
        return c.select(
            F.col("c_custkey").alias("address_id"),
            F.col("c_custkey").alias("customer_id"),
            F.lit("both").alias("address_type"),
            F.col("n_name").alias("city"),
            F.col("r_name").alias("state"),
            F.lit("US").alias("country"),
            F.lit(True).alias("is_default"),
        )

    @cached_property
    def categories(self) -> DataFrame:
        part = self.raw["part"]
        roots = part.select(
            F.col("p_type").alias("category_id"),
            F.lit(None).cast("string").alias("parent_category_id"),
            F.col("p_type").alias("category_name"),
        ).distinct()
        leaves = part.select(
            F.concat_ws("/", "p_type", "p_brand").alias("category_id"),
            F.col("p_type").alias("parent_category_id"),
            F.concat_ws(" ", "p_type", "p_brand").alias("category_name"),
        ).distinct()
        both = roots.unionByName(leaves)
        return both.select(
            "*", F.lower("category_id").alias("category_slug"), (F.col("category_id") != "PROMO").alias("is_active")
        )

    @cached_property
    def products(self) -> DataFrame:
        return self.raw["part"].select(
            F.col("p_partkey").alias("product_id"),
            F.concat_ws("/", "p_type", "p_brand").alias("category_id"),
            F.concat(F.lit("SKU-"), F.col("p_partkey").cast("string")).alias("sku"),
            F.col("p_name").alias("product_name"),
            F.concat_ws("-", F.translate("p_name", " ", "-"), F.col("p_partkey").cast("string")).alias("product_slug"),
            money("p_retailprice").alias("price"),
            F.round(money("p_retailprice") * F.lit("0.6").cast("decimal(2,1)"), 2).cast(MONEY).alias("cost"),
            (F.col("p_size") != 1).alias("is_active"),
            F.col("p_size").cast("bigint").alias("stock_quantity"),
            F.lit(10).cast("bigint").alias("reorder_level"),
        )

    @cached_property
    def orders(self) -> DataFrame:
        zero = F.lit("0.00").cast(MONEY)
        return self.raw["orders"].select(
            F.col("o_orderkey").alias("order_id"),
            F.col("o_custkey").alias("customer_id"),
            F.concat(F.lit("ORD-"), F.col("o_orderkey").cast("string")).alias("order_number"),
            _order_status().alias("order_status"),
            F.col("o_custkey").alias("billing_address_id"),
            F.col("o_custkey").alias("shipping_address_id"),
            money("o_totalprice").alias("subtotal"),
            zero.alias("tax_amount"),
            zero.alias("shipping_amount"),
            zero.alias("discount_amount"),
            money("o_totalprice").alias("total_amount"),
            _payment_status().alias("payment_status"),
            F.col("o_orderpriority").alias("payment_method"),
            F.col("o_orderdate").alias("created_at"),
        )

    @cached_property
    def order_items(self) -> DataFrame:
        quantity = F.col("l_quantity").cast("bigint")
        total = money("l_extendedprice")
        return self.raw["lineitem"].select(
            F.col("l_orderkey").alias("order_id"),
            F.col("l_partkey").alias("product_id"),
            quantity.alias("quantity"),
            F.round(total / quantity.cast("decimal(20,0)"), 2).cast(MONEY).alias("unit_price"),
            total.alias("total_price"),
        )

    @cached_property
    def shipments(self) -> DataFrame:
        return self.raw["lineitem"].select(
            F.col("l_orderkey").alias("order_id"), F.col("l_shipdate").alias("shipped_at")
        )

    @cached_property
    def inventory_movements(self) -> DataFrame:
        flag, quantity = F.col("l_returnflag"), F.col("l_quantity").cast("bigint")
        moved = self.raw["lineitem"].select(
            F.col("l_partkey").alias("product_id"),
            F.when(flag == "N", "out").when(flag == "R", "in").otherwise("adjustment").alias("movement_type"),
            F.when(flag == "R", quantity).otherwise(-quantity).alias("quantity"),
            F.when(flag == "N", "sale").when(flag == "R", "return").otherwise("adjustment").alias("reference_type"),
            F.col("l_orderkey").alias("reference_id"),
            F.col("l_shipdate").alias("movement_date"),
        )
        opening = self.raw["part"].select(
            F.col("p_partkey").alias("product_id"),
            F.lit("in").alias("movement_type"),
            F.lit(260).cast("bigint").alias("quantity"),
            F.lit("purchase").alias("reference_type"),
            F.lit(None).cast("bigint").alias("reference_id"),
            F.lit("1995-01-01").cast("timestamp_ntz").alias("movement_date"),
        )
        return moved.unionByName(opening)

    @cached_property
    def log(self) -> DataFrame:
        return self.raw["events"].select(
            "event_id",
            F.col("ts").alias("logged_at"),
            "user_id",
            F.col("event_type").alias("pattern"),
            money("value").alias("duration"),
            F.get_json_object("props", "$.k").cast("bigint").alias("rows_examined"),
            (F.col("event_type") == "error").alias("is_error"),
            F.col("props").alias("text"),
        )

    @cached_property
    def audit_log(self) -> DataFrame:
        kind = F.col("event_type")
        k = F.get_json_object("props", "$.k").cast("bigint")
        operation = (
            F.when(kind == "signup", "INSERT").when(kind == "error", "DELETE").otherwise("UPDATE")
        )
        table = (
            F.when(k < 40, "orders").when(k < 70, "order_items").when(k < 85, "products").otherwise("customers")
        )
        # a view clears the member k, a click moves it, the rest keep it
        new_k = F.when(kind == "view", None).when(kind == "click", k + 1000).otherwise(k)
        image = row_image([new_k.alias("k"), money("value").alias("value"), kind.alias("event_type")])
        return self.raw["events"].select(
            F.col("event_id").alias("id"),
            table.alias("table_name"),
            operation.alias("operation"),
            F.col("user_id").cast("string").alias("record_id"),
            F.when(kind != "signup", F.col("props")).alias("old_values"),
            F.when(kind != "error", image).alias("new_values"),
            F.concat(F.lit("user_"), F.col("user_id").cast("string")).alias("changed_by"),
            F.col("ts").alias("changed_at"),
            F.concat(F.lit("session_"), F.col("user_id").cast("string")).alias("session_id"),
            F.lit("events").alias("application_name"),
            F.lit("unknown").alias("ip_address"),
            F.lit(None).cast("string").alias("user_agent"),
        )
