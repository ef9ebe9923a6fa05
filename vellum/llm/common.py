"""Session helpers of the operators: the shared folder, written intermediate tables, blocks of rows."""

from __future__ import annotations

import contextlib
import tempfile
import threading
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .textkernel import lean, tidy


_own: dict[str, str] = {}
_local = threading.local()


def _scopes() -> list[str]:
    """The open scopes of this thread; each pipeline has its own."""
    if not hasattr(_local, "scopes"):
        _local.scopes = []
    return _local.scopes


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where it is unset, a temporary one, on a local master only: executors of a
    cluster would each write to a disk of their own."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        at = _own.get(app) or _own.setdefault(app, "file://" + tempfile.mkdtemp(prefix="vellum-"))
    return at.rstrip("/")


def _app_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/vellum/{spark.sparkContext.applicationId}"


def shared_path(spark: SparkSession, name: str, lasting: bool = False) -> str:
    """A new path in the shared folder; inside scratch() its table ends with the scope unless it is lasting."""
    return "/".join([_app_dir(spark), *([] if lasting else _scopes()), f"{name}-{uuid.uuid4().hex}"])


def _drop(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def drop_written(spark: SparkSession) -> bool:
    """Deletes what this application has written in the shared folder; call it when its results are stored."""
    return _drop(spark, _app_dir(spark))


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables written inside are deleted at the end; store what has to last outside."""
    _scopes().append(f"scope-{uuid.uuid4().hex}")
    try:
        yield
    finally:
        _drop(spark, "/".join([_app_dir(spark), *_scopes()]))
        _scopes().pop()


def drop(table: DataFrame) -> None:
    """Deletes a table made by written()."""
    for path in {x.rsplit("/", 1)[0] for x in table.inputFiles()}:
        _drop(table.sparkSession, path)


def written(df: DataFrame, name: str, lasting: bool = False) -> DataFrame:
    """The rows as a Parquet table in the shared folder, read again: lineage ends there, and lost executors cost nothing."""
    path = shared_path(df.sparkSession, name, lasting)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_bytes(df: DataFrame, col: str = "text") -> tuple[int, int]:
    """Rows and UTF-8 bytes of a text column."""
    n, size = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length(col)), F.lit(0))).first()
    return n, size


def crc_bucket(col: str, n: int) -> Column:
    """crc32 of the value as text, modulo n; null ids count as the text ''."""
    return F.pmod(F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")), F.lit(n))


def one_text(labelled: DataFrame, id_col: str, text: str) -> DataFrame:
    """(text, __label): of each id the least text, so an id that is repeated without end counts once."""
    return labelled.groupBy(id_col).agg(F.min(text).alias(text), F.min("__label").alias("__label")).select(text, "__label")


BLOCK = "__vellum_block"


def block_bytes_for(buckets: int, least: int = 4 << 20, most: int = 64 << 20, message: int = 64 << 10) -> int:
    """Text bytes of a block whose messages to each of `buckets` stand for about `message` bytes of text: messages then are as
    many a GB for a small input as for a large one, until a block comes to `most`."""
    return min(most, max(least, buckets * message))


def packed_blocks(docs: DataFrame, size: int, block_bytes: int, settled: bool = False) -> DataFrame:
    """(BLOCK, rows): the rows of `docs` dealt into blocks of about block_bytes of its `size` bytes by a hash of their
    place, so rows that are equal spread like others. Rows of one batch and block travel as one compressed Arrow
    message, see unpacked(). Places must be the same each time that the rows are read: settled=True says so, as for a
    plain scan of files; other tables are written first."""
    place = F.xxhash64(F.monotonically_increasing_id())
    dealt = (docs if settled else written(docs, "settled")).withColumn(BLOCK, F.pmod(place, F.lit(max(1, -(-size // block_bytes)))).cast("int"))

    def pack(batches):
        lean()
        for batch in (b for b in batches if b.num_rows):
            block = batch.column(BLOCK).to_numpy()
            order = np.argsort(block, kind="stable")
            cut = np.flatnonzero(np.diff(block[order], prepend=-1))
            rows = batch.select(batch.schema.names[:-1])
            sent = []
            for own in np.split(order, cut[1:]):
                with pa.BufferOutputStream() as sink:
                    with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                        out.write_batch(rows.take(pa.array(own)))
                    sent.append(sink.getvalue().to_pybytes())
            yield pa.RecordBatch.from_arrays([pa.array(block[order][cut]), pa.array(sent, pa.binary())], names=[BLOCK, "rows"])

    return dealt.mapInArrow(tidy(pack), f"{BLOCK} int, rows binary")


def unpacked(table: pa.Table) -> pa.Table:
    """The rows in the messages of a group of packed_blocks(), in one order whatever order they came in."""
    sent = sorted(x.as_buffer().to_pybytes() for x in table.column("rows"))
    return pa.concat_tables(pa.ipc.open_stream(x).read_all() for x in sent).combine_chunks()
