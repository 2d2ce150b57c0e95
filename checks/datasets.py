"""The given tables as datasets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from rowecho.sources.catalog import Dataset, DatasetSpec, Task, load_dataset, spread
from rowecho.sources.lexicon import lexicon_from_text

MEDIAN_BALANCE = 4500.0

REGISTRY = (
    DatasetSpec(
        "customer accounts", "customer", "Customer", "customer.parquet", (), "parquet",
        pos_key="c_custkey", target="c_mktsegment",
        task=Task("class_name", "Which market segment is this customer in?",
                  "the name of the market segment"),
        id_features=("c_custkey",), value_features=("c_mktsegment", "c_nationkey"),
        completion_feature="c_name"),
    DatasetSpec(
        "part catalog", "part", "Part", "part.parquet", (), "parquet",
        pos_key="p_partkey", target="p_type",
        task=Task("class_name", "What is the type of this part?", "the name of the type"),
        id_features=("p_partkey",), value_features=("p_type", "p_brand"),
        completion_feature="p_retailprice"),
    DatasetSpec(
        "customer orders", "orders", "Orders", "orders.parquet", (), "parquet",
        pos_key="o_orderkey", target="o_orderstatus",
        task=Task("yes_no", "Is this order finished? Yes or no?", positive="F", negative="O"),
        id_features=("o_orderkey",), value_features=("o_orderstatus", "o_orderpriority"),
        skip_given_features=("o_orderstatus",), completion_feature="o_totalprice"),
    DatasetSpec(
        "supplier accounts", "supplier", "Supplier", "supplier.parquet", (), "parquet",
        pos_key="s_suppkey", target="s_acctbal",
        task=Task("yes_no", "Is the balance of this supplier high? Yes or no?",
                  threshold=MEDIAN_BALANCE),
        completion_feature="s_name", case_sensitive_name=True),
    DatasetSpec("line items", "lineitem", "Lineitem", "lineitem.parquet", (), "parquet"),
)


def cores(spark: SparkSession) -> int:
    """The given tables are single files of one or two row groups, which is one or two tasks."""
    return min(spark.sparkContext.defaultParallelism, 64)


def dataset(spark: SparkSession, sf_dir: str, alias: str) -> Dataset:
    """``lineitem`` has no key that could serve as position and its queries need none."""
    return load_dataset(spark, alias, sf_dir, REGISTRY, min_partitions=cores(spark),
                        positions=alias != "lineitem")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"), cores(spark))


def lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of the English documents."""
    docs = table(spark, sf_dir, "documents")
    return lexicon_from_text(docs.filter(F.col("lang") == "en"))
