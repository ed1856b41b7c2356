"""What the corpus operators share: batch mapping, checkpoints, table access."""

from __future__ import annotations

import gc
import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that a worker's function is given at once, but for a single longer row.
BATCH_BYTES = 8 << 20

#: ASCII white space that separates words in every contract of this package.
WORD_GAP = rb"[\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def prepared(spark: SparkSession) -> SparkSession:
    """For jobs that own their session, as the registered queries do: smaller Arrow batches, so that JVM and workers hold less.

    Operators work with any setting and change none.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1024")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow with batches cut to BATCH_BYTES, whatever size the session's settings give them; no setting is changed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return fn(part for batch in batches for part in bounded(batch))

    return df.mapInArrow(run, schema)


def bounded(batch: pa.RecordBatch, most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about ``most`` bytes each, judged by its mean row; a row is never split."""
    rows = max(1, int(batch.num_rows * most / max(batch.nbytes, 1)))
    if batch.num_rows <= rows:
        yield batch
    else:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def gathered(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The batches joined to at least ``rows`` rows each, but for the last."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
        if sum(b.num_rows for b in held) >= rows:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held = []
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def shared_folder(spark: SparkSession) -> str:
    """The folder that all machines see, ``spark.checkpoint.dir``.

    A temporary one stands in only where a single machine does all the work; a cluster without the setting is refused,
    as others would not see what one machine writes to its own disk.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return tempfile.mkdtemp(prefix="tributo-shared-")


def cut(df: DataFrame) -> DataFrame:
    """Materialise and cut the lineage in the shared folder that the session names."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Between phases that shuffle much: let Spark delete the shuffle files that nothing refers to any more.

    Spark deletes them when the driver's JVM finds their handles dead, which by itself it looks for every half hour;
    without this a run's disk is the sum of its phases instead of their maximum. Handles that Python's own cycles hold
    go first.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


#: Bits of a filter for each of the hashes expected in it, and bounds of its size: 128 KB, and 32 MB, which some thirty
#: million hashes fill; beyond that it lets more and more through, and only saves less work.
BITS_EACH, LEAST_BITS, MOST_BITS = 8, 20, 28


def bit_filter(rows: DataFrame, h: Column, expected: int):
    """A bit for each hash h of rows, as an array of 64-bit words whose size goes by the number expected, within bounds."""
    import numpy as np

    size = 1 << min(MOST_BITS, max(LEAST_BITS, (BITS_EACH * max(1, expected) - 1).bit_length()))
    place = F.pmod(h, F.lit(size))
    got = rows.select(place.alias("h")).groupBy(F.shiftright("h", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(h & 63 as int))")).alias("bits")).select(F.col("w").cast("int").alias("w"), "bits").toArrow()
    out = np.zeros(size // 64, np.int64)
    for part in got.to_batches():
        out[np.asarray(part.column("w"))] = np.asarray(part.column("bits"))
    return out.view(np.uint64)


def passes(bits, h):
    """Which of the 64-bit hashes may be in the filter."""
    import numpy as np

    place = h.view(np.uint64) & np.uint64(len(bits) * 64 - 1)
    return (bits[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) == 1


def doc_key(doc_id: Column) -> Column:
    """The text whose crc32 decides a row's fold; a null id counts as the empty text."""
    return F.coalesce(doc_id.cast("string"), F.lit(""))


def fold(doc_id: Column, folds: int) -> Column:
    return F.crc32(doc_key(doc_id)) % folds


def texts(docs: DataFrame, *more: Column) -> DataFrame:
    """doc_id and text alone, and more, whatever other columns there are; a null text is empty."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *more)


def utf8(column: pa.Array) -> tuple:
    """The UTF-8 bytes of a string column without copying, and where each text starts and ends in them."""
    import numpy as np

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64, count=len(column) + column.offset + 1)[column.offset :]
    data = column.buffers()[2]
    body = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return body, offsets


def labelled(docs: DataFrame, labels: DataFrame, column: str, folds: int, held: int, most: int, most_chars: int = 128 << 20) -> DataFrame:
    """doc_id, text, lang and label of ``most`` rows or a little less that a classifier may learn from.

    Rows of the held-out fold never get in. Labels are counted, then those below a hash threshold that leaves about 0.95
    of ``most`` are taken, or fewer if their texts have over ``most_chars`` characters in all: no sort, and what the
    driver fits on is bounded whatever the tables hold. Of rows with one doc_id that with the least text is used; ids
    with contradicting labels count as the higher.
    """
    usable = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).cast("int").alias("label"))
        .where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull() & (fold(F.col("doc_id"), folds) != held))
        .groupBy("doc_id")
        .agg(F.max("label").alias("label"))
    )
    place = F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.lit(1 << 20))
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), lang.alias("lang"))

    def below(share: float) -> DataFrame:
        # most rows of two numbers each are far below any limit of a broadcast.
        chosen = F.broadcast(usable.where(place < int((1 << 20) * share)))
        return own.join(chosen, "doc_id").groupBy("doc_id").agg(F.min(F.struct("text", "lang", "label")).alias("row")).select("doc_id", "row.*")

    count = usable.count()
    share = 1.0 if count <= most else 0.95 * most / count
    chars = below(share).agg(F.sum(F.length("text"))).first()[0] or 0
    return below(share if chars <= most_chars else share * 0.9 * most_chars / chars)
