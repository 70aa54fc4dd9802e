"""Upload requests and uploads as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.operators.catalog import keyless_rows, new_rows
from docquarry.operators.validation import validate_uploads
from docquarry.sources.manifests import parse_requests
from docquarry.streaming.run import batch_path, drain, write_batch, written_batches
from docquarry.streaming.seen import keep_keys, seen_keys


def stream_upload_manifests(spark: SparkSession, path: str, files_per_batch: int = 1_000) -> DataFrame:
    """Typed upload requests from manifest files as they arrive."""
    return parse_requests(spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(path))


def stream_validate_uploads(
    requests: DataFrame, path: str, checkpoint: str, key: str | None = None, existing: DataFrame | None = None,
    **limits,
) -> DataFrame:
    """Checks a stream of requests and writes it by outcome; returns all rows, with ``outcome``.

    Outcomes are ``accepted`` and ``rejected``, and with ``key`` also ``repeated``: requests that pass
    the checks, but whose key is in ``existing``, was accepted in an earlier micro-batch, or is that of
    another request of the batch, of which the smallest row is accepted. A request without a key is
    rejected as it is. The rows of a micro-batch are one write, partitioned by outcome, below
    ``path``/rows; accepted keys lie by bucket below ``path``/keys. A source without a file yet gives no rows.
    """
    outcome = F.when(F.size("errors") == 0, "accepted").otherwise("rejected")
    checked = validate_uploads(requests, **limits).withColumn("outcome", outcome)
    rows, keys = f"{path}/rows", f"{path}/keys"

    def handle(batch: DataFrame, batch_id: int) -> None:
        if key is None:
            return write_batch(batch, rows, batch_id, partition_by="outcome")
        batch = batch.persist()
        passed = batch.where((F.col("outcome") == "accepted") & F.col(key).isNotNull())
        known = seen_keys(passed, keys, batch_id, key)
        if existing is not None:
            known = known.unionByName(existing.select(key))
        first = new_rows(passed, known, key, *[c for c in passed.columns if c != key])
        repeated = passed.exceptAll(first).withColumn("outcome", F.lit("repeated"))
        turned = batch.where((F.col("outcome") != "accepted") | F.col(key).isNull()).withColumn("outcome", F.lit("rejected"))
        write_batch(first.unionByName(repeated).unionByName(turned), rows, batch_id, partition_by="outcome")
        keep_keys(first, keys, batch_id, key)
        batch.unpersist()

    drain(checked, handle, checkpoint)
    return written_batches(requests.sparkSession, rows, checked.schema).drop("batch_id")


def stream_dedup_uploads(
    uploads: DataFrame, path: str, checkpoint: str, key: str = "r2Key", moment: str = "createdAt",
) -> DataFrame:
    """Keeps the first row to arrive of each object key, however late; within a micro-batch the earliest.

    A micro-batch is compared with the keys of all batches before it that lie in its buckets, so no key
    is forgotten and no first row is lost. Rows of a hot key combine in each task before the shuffle.
    Rows without a key cannot be known to repeat and are all kept. Rows lie below ``path``/rows, keys
    below ``path``/keys. A source without a file yet gives no rows.
    """
    rows, keys = f"{path}/rows", f"{path}/keys"

    def handle(batch: DataFrame, batch_id: int) -> None:
        rest = [moment, *[c for c in uploads.columns if c not in (key, moment)]]
        first = new_rows(batch, seen_keys(batch, keys, batch_id, key), key, *rest)
        write_batch(first.unionByName(keyless_rows(batch, key)), rows, batch_id)
        # from what was written: the batch is not worked out again
        kept = batch.sparkSession.read.schema(batch.select(*first.columns).schema).parquet(batch_path(rows, batch_id))
        keep_keys(kept, keys, batch_id, key)

    drain(uploads, handle, checkpoint)
    return written_batches(uploads.sparkSession, rows, uploads.schema).drop("batch_id")
