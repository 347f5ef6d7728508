"""Reading named tables from Parquet or from a relational database."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

# The shared test tables. Declared, so that reading them starts no schema job.
TABLES = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
    "l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "pages": "page_id bigint, url string, html string",
    "benchmark": "item_id bigint, text string",
    "labels": "doc_id bigint, quality int, toxic int",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}


def table_path(directory: str, name: str) -> str:
    return f"{directory.rstrip('/')}/{name}.parquet"


def load_table(spark: SparkSession, directory: str, name: str, schemas: Mapping[str, str] = TABLES) -> DataFrame:
    """One lazy frame. A name without a declared schema is inferred from the files."""
    reader = spark.read.schema(schemas[name]) if name in schemas else spark.read
    return reader.parquet(table_path(directory, name))


def load_tables(
    spark: SparkSession,
    directory: str,
    names: Iterable[str] | None = None,
    schemas: Mapping[str, str] = TABLES,
) -> dict[str, DataFrame]:
    """Frames by table name; all declared tables when no names are given."""
    wanted = list(schemas) if names is None else list(names)
    return {name: load_table(spark, directory, name, schemas) for name in wanted}


def jdbc_options(
    url: str,
    table: str,
    partition_column: str,
    lower: int | str,
    upper: int | str,
    partitions: int,
    fetch_rows: int = 10_000,
    **extra: str,
) -> dict[str, str]:
    """Options for a partitioned relational read: `partitions` range queries on one column.

    The bounds only place the range borders; rows outside them are still read.
    """
    if partitions < 1:
        raise ValueError("partitions must be positive")
    return {
        "url": url,
        "dbtable": table,
        "partitionColumn": partition_column,
        "lowerBound": str(lower),
        "upperBound": str(upper),
        "numPartitions": str(partitions),
        "fetchsize": str(fetch_rows),
        **extra,
    }


def load_jdbc_table(spark: SparkSession, **options: str) -> DataFrame:
    """The same table load from a relational source; filters and columns push into its query."""
    return spark.read.format("jdbc").options(**jdbc_options(**options)).load()


def stream_table(spark: SparkSession, path: str, schema: str | StructType, files_per_trigger: int | None = None) -> DataFrame:
    """New files of a Parquet table as a stream.

    A plain stream path has to be a folder. Given as a pattern that matches only itself, the
    table may be a folder of files or a single file.
    """
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    plain = path.rstrip("/")
    at = max(i for i, c in enumerate(plain) if c.isalnum())  # other characters may mean something in a pattern
    return reader.parquet(f"{plain[:at]}[{plain[at]}]{plain[at + 1 :]}")
