"""Session set-up, shared scratch tables and size checks."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A side is broadcast only if its checked size stays below this.
BROADCAST_BYTES = 64 * 1024 * 1024


def local_session(name: str = "rankloom", cores: str | int = "*", **conf: str) -> SparkSession:
    """A single-machine session for tests and the bench."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: the session's checkpoint folder.

    Only a session on one machine may name none; it gets a fresh local folder.
    """
    context = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if path is None:
        if not context.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="rankloom-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(path)
    return path


def fresh_dir(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/rankloom-{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str = "table", by: str | None = None) -> DataFrame:
    """Write `df` as a parquet table in the shared folder and read it back.

    Used where several branches of one job read the same result: lineage is cut, a lost
    executor costs nothing, and the readers get column pruning and exact file sizes. `by`: the
    values of this column lie in folders of their own, so that a filter reads only what it keeps.
    """
    spark = df.sparkSession
    path = fresh_dir(spark, label)
    (df.write if by is None else df.write.partitionBy(by)).parquet(path)
    for owned in _scopes.get():
        owned.append(path)
    return spark.read.schema(df.schema).parquet(path)


# The open blocks of this thread: what another stream or query writes meanwhile is not ours.
_scopes: ContextVar[tuple[list[str], ...]] = ContextVar("scopes", default=())


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Delete the tables that this thread's `materialize` writes inside the block when it ends.

    For callers that write their result before they return, such as a micro-batch.
    """
    owned: list[str] = []
    token = _scopes.set((*_scopes.get(), owned))
    try:
        yield
    finally:
        _scopes.reset(token)
        for path in owned:
            delete(spark, path)


def delete(spark: SparkSession, path: str) -> None:
    """Remove a folder that this library wrote."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


class QuerySet:
    """The query side of a retrieval: `query_id` plus `text` and/or `vec`.

    Its size is measured once; every broadcast of something derived from the queries is
    allowed by that measurement and not by a guess.
    """

    def __init__(self, df: DataFrame, limit: int = BROADCAST_BYTES):
        self.df = df
        self.limit = limit

    @property
    def texts(self) -> DataFrame:
        return self.df.select("query_id", "text")

    @property
    def vectors(self) -> DataFrame:
        return self.df.select("query_id", "vec")

    @cached_property
    def _measured(self) -> tuple[int, int, int]:
        columns = self.df.columns
        chars = F.sum(F.octet_length("text")) if "text" in columns else F.lit(0)
        width = F.max(F.size("vec")) if "vec" in columns else F.lit(0)
        row = self.df.agg(
            F.count(F.lit(1)).alias("n"),
            F.coalesce(chars, F.lit(0)).alias("chars"),
            F.coalesce(width, F.lit(0)).alias("width"),
        ).first()
        return row["n"], row["chars"], max(row["width"], 0)

    @property
    def count(self) -> int:
        return self._measured[0]

    @property
    def terms_fit(self) -> bool:
        """Every text of c bytes gives at most c/2 + 1 words (and as many pairs of words)."""
        return self._term_bytes <= self.limit

    @property
    def _term_bytes(self) -> int:
        n, chars, _ = self._measured
        return 64 * (chars + n)

    @property
    def term_slices(self) -> int:
        """Into how many slices the queries are cut so that the terms of each may be broadcast."""
        wanted = -(-self._term_bytes // max(self.limit, 1))
        return max(1, min(wanted, self.count))

    @property
    def vectors_fit(self) -> bool:
        n, _, width = self._measured
        return 8 * n * max(width, 1) <= self.limit

    @property
    def vector_bytes(self) -> int:
        n, _, width = self._measured
        return 8 * n * max(width, 1)

    @property
    def width(self) -> int:
        return max(self._measured[2], 1)

    @property
    def texts_fit(self) -> bool:
        """Do the texts with their ids (which may be texts too) fit a broadcast?"""
        return self.text_bytes <= self.limit

    @property
    def text_bytes(self) -> int:
        """Measured bytes of the texts and ids, with the overhead of a row."""
        n, chars, _ = self._measured
        return chars + self._id_bytes + 64 * n

    @cached_property
    def _id_bytes(self) -> int:
        return self.df.agg(F.sum(F.octet_length(F.col("query_id").cast("string")))).first()[0] or 0

    def rows_fit(self, rows_per_query: int, row_bytes: int = 64) -> bool:
        """Does a table with at most `rows_per_query` rows per query fit a broadcast? Every row
        carries the query's id, whose bytes are measured."""
        return rows_per_query * (self.count * row_bytes + self._id_bytes) <= self.limit


def spread(scan: DataFrame, key: str) -> DataFrame:
    """Deal out the rows of a file scan where the session asks for it.

    A table in a single row group keeps one core busy with all of the text work; who reads such
    a table sets `spark.rankloom.scanPartitions`. Without the setting nothing is moved.
    """
    wanted = scan.sparkSession.conf.get("spark.rankloom.scanPartitions", None)
    return scan if wanted is None else scan.repartition(int(wanted), key)


def by_document(df: DataFrame, key: str = "doc_id") -> DataFrame:
    """Hash partition by document into the session's full number of shuffle partitions.

    The number is given explicitly because the rows fan out afterwards (one posting meets many
    queries): merging partitions that look small now would leave too few tasks for that.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def hinted(df: DataFrame, fits: bool) -> DataFrame:
    return F.broadcast(df) if fits else df
