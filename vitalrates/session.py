"""Session set-up, lineage cutting, tables of a search and the size check in front of every data-dependent broadcast."""

from __future__ import annotations

import tempfile
import uuid
import weakref
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LOOKUP_MAX_ROWS = 100_000
LOOKUP_MAX_BYTES = 16 << 20
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def build_session(app: str = "vitalrates", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution and skew splitting on; `conf` entries win over the defaults."""
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        **conf,
    }
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; only a session inside one process may fall back to a temporary one."""
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return context.getCheckpointDir()
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if context.master != "local" and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder shared by the driver and all executors")
        folder = tempfile.mkdtemp(prefix="vitalrates-checkpoint-")
    context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write `df` to the shared checkpoint folder and go on from the stored rows."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


@contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """Queries made inside remove their shuffle files as they end, where a search would otherwise pile them up."""
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(SHUFFLE_CLEANUP)
        else:
            spark.conf.set(SHUFFLE_CLEANUP, before)


@dataclass
class StepTable:
    """A stored table; it is dropped some time after the last reference to it is gone."""

    name: str
    rows: DataFrame


class StepTables:
    """Tables of a search in a folder beside the checkpoints, bucketed by `key` so that they join without a shuffle.

    Storing a table drops those that nothing refers to any more, so the disk holds the few steps in use, however many
    there were. `close` drops all.
    """

    def __init__(self, spark: SparkSession, key: str, buckets: int):
        self.spark, self.key, self.buckets = spark, key, buckets
        self.schema, self.made = f"vitalrates_{uuid.uuid4().hex}", 0
        self.used: dict[str, weakref.ref[StepTable]] = {}
        folder = f"{ensure_checkpoint_dir(spark)}/{self.schema}".replace("'", "\\'")
        spark.sql(f"CREATE SCHEMA {self.schema} LOCATION '{folder}'")

    def store(self, df: DataFrame) -> StepTable:
        for name in [n for n, held in self.used.items() if held() is None]:
            self.spark.sql(f"DROP TABLE {name}")
            del self.used[name]
        self.made += 1
        name = f"{self.schema}.step{self.made}"
        df.write.format("parquet").bucketBy(self.buckets, self.key).saveAsTable(name)
        table = StepTable(name, self.spark.table(name))
        self.used[name] = weakref.ref(table)
        return table

    def beside(self, rows: DataFrame, table: StepTable) -> DataFrame:
        """`rows` of another table of these with the smaller `table`, bucket by bucket."""
        return rows.join(table.rows.hint("shuffle_hash"), self.key)

    def close(self) -> None:
        self.spark.sql(f"DROP SCHEMA IF EXISTS {self.schema} CASCADE")
        self.used.clear()


def fits(stored: DataFrame, max_bytes: int = LOOKUP_MAX_BYTES) -> bool:
    """Whether a stored table is at most `max_bytes` long, each row counted as text plus 16 bytes a column."""
    row = F.octet_length(F.to_json(F.struct(*stored.columns))) + 16 * len(stored.columns)
    return (stored.agg(F.sum(row.cast("long"))).first()[0] or 0) <= max_bytes


def bounded_rows(df: DataFrame, max_rows: int, what: str) -> list:
    """Collect a table that must be small; raise instead of truncating it."""
    rows = df.limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        raise ValueError(f"{what}: more than {max_rows} rows")
    return rows
