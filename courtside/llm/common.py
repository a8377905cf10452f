"""Helpers shared by the corpus operators: row numbers, leaving out rows by an id list, and digests of long sequences."""
from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from courtside.sources.storage import discard, fresh_path, shared_dir, written
from courtside.sources.tables import table

__all__ = ["BATCH_ROWS", "BROADCAST_IDS", "discard", "fresh_path", "numbered", "shared_dir", "small_batches", "streamed_sha256", "table", "without_ids", "written"]

#: Rows that an id list may have before it is shuffled rather than broadcast (8 bytes each).
BROADCAST_IDS = 1_000_000
#: Rows that a Python worker of the pipeline gets at once, and that a task reads at once; a task's JVM and its worker each hold a batch or two.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """From now on Python workers of the session get at most BATCH_ROWS rows at once: with Spark's 10,000, whole texts or their hashes are tens of MB a batch.
    Parquet is read by as many: a reader's arrays hold a batch whole, and double as they grow, so 4096 texts of 100 KB are up to a GB of a task."""
    for key in ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.parquet.columnarReaderBatchSize"):
        rows = int(spark.conf.get(key))
        if not 0 < rows <= BATCH_ROWS:
            spark.conf.set(key, BATCH_ROWS)


def numbered(docs: DataFrame, name: str) -> tuple[DataFrame, str]:
    """docs, written to the shared folder with a number of its own for each row, and the numbers' column (a name that docs has not)."""
    row = f"row_{uuid.uuid4().hex}"
    return written(docs.withColumn(row, F.monotonically_increasing_id()), name), row


def without_ids(docs: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """docs less the rows whose key is in ids; ids is broadcast only while it is known to be short. Null keys stay."""
    ids = written(ids.select(key).where(F.col(key).isNotNull()).distinct(), "ids")
    short = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return docs.join(F.broadcast(ids) if short else ids, key, "left_anti")


def streamed_sha256(rows: DataFrame, keys: list[str], order: list[str], value: str, between: str) -> DataFrame:
    """keys and sha256 (lowercase hex) of each key's values in order, joined by `between`. Values go through one by one, so a
    key may have any number of them; those of one key go through one task, as SHA-256 can't be made from parts."""
    sorted_rows = rows.select(*keys, *order, value).repartition(*keys).sortWithinPartitions(*keys, *order).select(*keys, value)
    schema = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys) + ", sha256 string"
    between_bytes = between.encode()

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, digest, done = None, None, []
        out = lambda kinds: pa.RecordBatch.from_arrays([*(pa.array([d[0][k] for d in done], t) for k, t in enumerate(kinds)), pa.array([d[1] for d in done])], [*keys, "sha256"])
        kinds = []
        for batch in batches:
            kinds = [batch.schema.field(k).type for k in range(len(keys))]
            columns = [c.to_pylist() for c in batch.columns]
            for key, text in zip(zip(*columns[:-1]), columns[-1]):
                if digest is not None and key == at:
                    digest.update(between_bytes)
                else:
                    if digest is not None:
                        done.append((at, digest.hexdigest()))
                    at, digest = key, hashlib.sha256()
                digest.update(text.encode())
            if len(done) >= 10_000:
                yield out(kinds)
                done = []
        if digest is not None:
            done.append((at, digest.hexdigest()))
            yield out(kinds)

    return sorted_rows.mapInArrow(digests, schema)
