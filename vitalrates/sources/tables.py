"""CSV and parquet tables, JDBC tables, and tables of a second namespace."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from vitalrates.session import fits

MISSING = "NA"


def read_table_csv(
    spark: SparkSession, path: str | list[str], schema: StructType | str, row_number: str | None = None
) -> DataFrame:
    """Header CSV with a fixed schema; `NA` and empty fields are NULL. `row_number` names a column to add, see `numbered`."""
    raw = spark.read.schema(schema).csv(
        path, header=True, nullValue=MISSING, quote='"', escape='"', multiLine=False, enforceSchema=False
    )
    return raw if row_number is None else numbered(raw, row_number)


def numbered(scan: DataFrame, name: str = "row_number") -> DataFrame:
    """Add the number (from 0) that each row of a line-based file scan has when its files are read one after the other.

    Files follow each other by path, rows as they stand in the file. A first pass over no column counts the rows of every
    split, the second adds the position inside the split to the rows before it, so nothing is sorted or shuffled. The
    list of splits is what the driver plans the scan from; the offsets made of it are broadcast when measured small. A
    row outside its split's count, as when files change between the passes, raises.
    """
    if name in scan.columns:
        raise ValueError(f"{name} is a column already")
    at = F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__start")
    placed = scan.select("*", *at, F.monotonically_increasing_id().alias("__place"))
    splits = placed.groupBy("__file", "__start").agg(F.count("*").alias("__rows"), F.min("__place").alias("__first")).collect()
    offsets, before = [], 0
    for s in sorted(splits, key=lambda s: (s["__file"], s["__start"])):
        offsets.append((*s, before))
        before += s["__rows"]
    schema = "__file string, __start long, __rows long, __first long, __before long"
    table = scan.sparkSession.createDataFrame(offsets, schema)
    joined = placed.join(F.broadcast(table) if fits(table) else table, ["__file", "__start"], "left")
    position = F.col("__place") - F.col("__first")
    known = F.coalesce(position.between(F.lit(0), F.col("__rows") - 1), F.lit(False))
    number = F.when(known, F.col("__before") + position).otherwise(F.raise_error(F.lit("the files changed while they were numbered")))
    return joined.select(*[F.col(f"`{c}`") for c in scan.columns], number.cast("long").alias(name))


def write_table_csv(df: DataFrame, path: str) -> None:
    """A folder of header CSV files with `NA` for NULL."""
    df.write.mode("overwrite").csv(path, header=True, nullValue=MISSING, emptyValue='""', quote='"', escape='"')


def write_stage(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> DataFrame:
    """Store a stage between two jobs as parquet and go on from the stored rows."""
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return df.sparkSession.read.parquet(path)


def scan_between(df: DataFrame, column: str, lower, upper, columns: Sequence[str]) -> DataFrame:
    """Lazy scan of some columns where lower <= column < upper; both filter and columns reach the source."""
    return df.filter((F.col(column) >= F.lit(lower)) & (F.col(column) < F.lit(upper))).select(*columns)


@dataclass(frozen=True)
class JdbcSource:
    """A database reached over JDBC: where it is, how to sign in, and how many rows to fetch at once.

    The password comes from a file or secret store by way of `properties`; it is not part of the printed form.
    """

    url: str
    driver: str = "com.mysql.cj.jdbc.Driver"
    fetch_size: int = 10_000
    properties: dict[str, str] = field(default_factory=dict, repr=False)

    def options(
        self,
        table: str | None = None,
        query: str | None = None,
        partition: tuple[str, object, object, int] | None = None,
    ) -> dict[str, str]:
        """Reader options for a table, or for the text of a query; `partition` is (column, lower, upper, parts)."""
        if (table is None) == (query is None):
            raise ValueError("give a table or a query")
        result = {
            "url": self.url, "driver": self.driver, "fetchsize": str(self.fetch_size), "pushDownPredicate": "true",
            "pushDownAggregate": "true", **self.properties,
            "dbtable": table if query is None else f"({query.strip().rstrip(';').rstrip()}) AS q",
        }
        if partition is not None:
            column, lower, upper, parts = partition
            if parts < 1:
                raise ValueError("at least one partition")
            result |= {
                "partitionColumn": column, "lowerBound": str(lower), "upperBound": str(upper),
                "numPartitions": str(parts),
            }
        return result

    def read(self, spark: SparkSession, **request) -> DataFrame:
        return spark.read.format("jdbc").options(**self.options(**request)).load()


def stored_text(spark: SparkSession, path: str) -> str:
    """The text of one file in any store Spark can read."""
    found = spark.read.text(path, wholetext=True).limit(2).collect()
    if len(found) != 1:
        raise ValueError(f"{path}: expected one file, found {'none' if not found else 'several'}")
    return found[0][0]


def query_text(
    spark: SparkSession, path: str, tables: dict[str, DataFrame], parameters: dict[str, object] | None = None
) -> DataFrame:
    """Run the SQL text of a stored file over the given tables, named in it as {name}, with `parameters` for :name."""
    text = stored_text(spark, path).strip().rstrip(";").rstrip()
    return spark.sql(text, args=parameters or None, **tables)
