"""Panel loading: typed readers for the four panel tables.

``read_panel`` reads panel files (CSV as exported by the panel provider, or Parquet);
``panel_from_tpch`` maps the driver's star-schema tables onto the panel so the analyses
can run on them. Both return lazy DataFrames; no schema inference is ever used.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillroll.sources.schema import SCHEMAS, YEAR_COL

INDEX_COLUMNS = ("", "_c0", "unnamed: 0")


@dataclass(frozen=True)
class Panel:
    households: DataFrame
    products: DataFrame
    trips: DataFrame
    purchases: DataFrame

    def table(self, name: str) -> DataFrame:
        return getattr(self, name)

    def register_views(self, prefix: str = "") -> list[str]:
        """Expose the four tables to Spark SQL as temporary views
        (``households``, ``products``, ``trips``, ``purchases``, optionally prefixed)."""
        names = []
        for name in ("households", "products", "trips", "purchases"):
            self.table(name).createOrReplaceTempView(prefix + name)
            names.append(prefix + name)
        return names


def _typed(raw: DataFrame, schema: T.StructType) -> DataFrame:
    """Select the schema's columns from an all-string frame, by case-insensitive name,
    converting with ``try_cast`` so a malformed value becomes NULL instead of failing."""
    by_lower = {c.lower(): c for c in raw.columns}
    cols: list[Column] = []
    for field in schema.fields:
        source = by_lower.get(field.name.lower())
        if source is None:
            raise ValueError(f"column {field.name!r} missing; have {raw.columns}")
        value = F.trim(F.col(f"`{source}`"))
        if isinstance(field.dataType, T.DateType):
            cols.append(F.try_to_date(value).alias(field.name))
        elif isinstance(field.dataType, T.StringType):
            cols.append(F.col(f"`{source}`").alias(field.name))
        else:
            cols.append(value.try_cast(field.dataType).alias(field.name))
    return raw.select(*cols)


def without_index(raw: DataFrame) -> DataFrame:
    return raw.drop(*[c for c in raw.columns if c.lower() in INDEX_COLUMNS])


SHORT_FILE = 1 << 20  # bytes; shorter files are read whole to find their header


@contextmanager
def _one_file_a_task(spark: SparkSession) -> Iterator[None]:
    """Scans run in the block read each file in a task of its own."""
    settings = {"spark.sql.files.maxPartitionBytes": str(1 << 60), "spark.sql.files.openCostInBytes": str(1 << 60)}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def csv_headers(spark: SparkSession, path: str) -> dict[str, list[str]]:
    """The files of a CSV file or folder (as Spark names a row's file) by their header line.

    Headers are read where the data is, in whatever store and compression Spark reads. Many
    short files share a task, which reads them whole; a longer file is a task of its own,
    which stops at its first lines. The result is one row per distinct header. Files without a line have none."""
    lines = spark.read.text(path)
    file, size = F.col("_metadata.file_path"), F.col("_metadata.file_size")  # files are left out by size before they are opened

    def first_line(batches):  # inside, so that workers need not import this package
        for batch in batches:
            if batch.num_rows:
                yield batch.slice(0, 1)
                return

    short = lines.where(size < SHORT_FILE).select(file.alias("file"), "value", F.monotonically_increasing_id().alias("at"))
    long = lines.where(size >= SHORT_FILE).select(file.alias("file"), F.col("value").alias("header"))
    out: dict[str, list[str]] = {}

    def add(first: DataFrame) -> None:
        for r in first.groupBy("header").agg(F.collect_list("file").alias("files")).collect():
            out.setdefault(r["header"], []).extend(r["files"])

    # a short file is one split, so that its lines are numbered in order
    add(short.groupBy("file").agg(F.min_by("value", "at").alias("header")))
    with _one_file_a_task(spark):
        add(long.mapInArrow(first_line, "file string, header string"))
    return out


def read_typed_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A CSV file or folder with header rows, typed by ``schema``: columns are matched by
    name, in any order, in each file by its own header; an unnamed index column is dropped.

    Spark takes one file's header for a whole folder. With several headers, each has a scan of
    the folder that leaves out the other headers' files before it opens them (and that checks
    the header of those it reads); the scans are united by name. Every column is read as a string."""
    headers = sorted(csv_headers(spark, path).items(), key=lambda h: (-len(h[1]), h[0]))
    if len(headers) < 2:
        return _typed(without_index(_csv(spark, path)), schema)
    others = [f for _, files in headers[1:] for f in files]
    parts = []
    for i, (_, files) in enumerate(headers):
        columns = _csv(spark, _as_path(files[0])).schema
        own = ~_is_one_of(others) if i == 0 else _is_one_of(files)
        parts.append(_typed(without_index(_csv(spark, path, columns).where(own)), schema))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _csv(spark: SparkSession, path: str, columns: T.StructType | None = None) -> DataFrame:
    """Files with a header, which must be that of ``columns`` (by default the first file's)."""
    reader = spark.read.option("header", True).option("enforceSchema", False)
    return (reader.schema(columns) if columns else reader).csv(path)


def _is_one_of(files: list[str]) -> Column:
    """Whether a row comes from one of the files; others are left out of the scan unopened."""
    return F.col("_metadata.file_path").isin(files)


def _as_path(file: str) -> str:
    """A row's file as readers take it: it is named as a URI (a blank is %20), and readers take
    glob characters in a path for patterns."""
    return re.sub(r"([\\*?\[\]{}])", r"\\\1", unquote(file))


def read_csv_table(spark: SparkSession, path: str, name: str) -> DataFrame:
    """One panel CSV (households, products, trips or purchases)."""
    return read_typed_csv(spark, path, SCHEMAS[name])


def read_panel(spark: SparkSession, paths: dict[str, str], fmt: str = "csv") -> Panel:
    """Read the four panel tables. ``paths`` maps households/products/trips/purchases to
    files or folders (``fmt`` = csv, parquet, orc, ...) or, with ``fmt="table"``, to
    catalog table names."""
    frames = {}
    for name, schema in SCHEMAS.items():
        if fmt == "csv":
            frames[name] = read_csv_table(spark, paths[name], name)
            continue
        df = spark.table(paths[name]) if fmt == "table" else spark.read.format(fmt).load(paths[name])
        # the year layout's partition column stays in the panel, for pruning; analyses drop it
        year = [YEAR_COL] if YEAR_COL in df.columns else []
        frames[name] = df.select(*[F.col(f.name).cast(f.dataType) for f in schema.fields], *year)
    return Panel(**frames)


# Columns of the driver's tables that the panel mapping uses, with their stored types.
TPCH_SOURCE_SCHEMAS = {
    "customer": "c_custkey BIGINT, c_nationkey INT, c_acctbal DOUBLE",
    "nation": "n_nationkey INT, n_name STRING",
    "part": "p_partkey BIGINT, p_name STRING, p_brand STRING, p_type STRING",
    "orders": "o_orderkey BIGINT, o_custkey BIGINT, o_totalprice DOUBLE, o_orderdate TIMESTAMP_NTZ, "
    "o_orderpriority STRING",
    "lineitem": "l_orderkey BIGINT, l_partkey BIGINT, l_quantity DOUBLE, l_extendedprice DOUBLE, l_discount DOUBLE",
}


def panel_from_tpch(spark: SparkSession, sf_dir: str) -> Panel:
    """Map the driver's tables onto the panel (one projection per table; every filter and
    column selection made later still reaches the Parquet scans).

    households <- customer (+ nation name as state), products <- part,
    trips <- orders, purchases <- lineitem.
    """

    def read(name: str) -> DataFrame:
        # a declared read schema (the columns used) spares a footer-reading job per table
        return spark.read.schema(TPCH_SOURCE_SCHEMAS[name]).parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")

    customer = read("customer")
    # one name per nation key: the lookup can then never multiply customers, and Catalyst
    # removes the join altogether when only customer columns are used
    nation = read("nation").groupBy("n_nationkey").agg(F.max("n_name").alias("n_name"))
    households = customer.join(
        nation, customer.c_nationkey == nation.n_nationkey, "left"
    ).select(
        customer.c_custkey.alias("hh_id"),
        # income code 3..27 spread over the account balance range
        (F.floor((customer.c_acctbal + 1000) / 440) + 3).cast("int").alias("hh_income"),
        nation.n_name.alias("hh_state"),
    )
    part = read("part")
    products = part.select(
        part.p_partkey.alias("prod_id"),
        part.p_type.alias("department_at_prod_id"),
        F.split_part(part.p_name, F.lit(" "), F.lit(2)).alias("group_at_prod_id"),
        part.p_name.alias("module_at_prod_id"),
        part.p_brand.alias("brand_at_prod_id"),
    )
    orders = read("orders")
    trips = orders.select(
        orders.o_orderkey.alias("tc_id"),
        orders.o_custkey.alias("hh_id"),
        orders.o_orderdate.cast("date").alias("tc_date"),
        orders.o_orderpriority.alias("tc_retailer_code"),
        orders.o_totalprice.cast("decimal(18,2)").alias("tc_total_spent"),
    )
    lineitem = read("lineitem")
    purchases = lineitem.select(
        lineitem.l_orderkey.alias("tc_id"),
        lineitem.l_partkey.alias("prod_id"),
        lineitem.l_quantity.cast("int").alias("quantity_at_tc_prod_id"),
        lineitem.l_extendedprice.cast("decimal(18,2)").alias("total_price_paid_at_tc_prod_id"),
        F.when(lineitem.l_discount >= 0.05, 1).otherwise(0).alias("deal_flag_at_tc_prod_id"),
    )
    return Panel(households, products, trips, purchases)
