"""Exchange between batches of documents and buckets of keys.

Documents are staged once, each input partition being a batch. A batch sends its distinct keys to
buckets (map-side combined, so a key that every document holds costs one entry a batch); a bucket
answers each batch about its own keys. Answers are written by batch to the shared folder, and the task
that rescans a batch reads only that batch's answer. Texts are never shuffled and no key is hot.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_fs, shared_path, stage, tidy


#: Bytes of text for each of which there is a bucket, so that what meets in a bucket doesn't grow with the batches.
BUCKET_BYTES = 12 << 20
#: Most buckets, as each batch may send a message to each of them; from 800 GB of text on, buckets grow instead.
MOST_BUCKETS = 1 << 16


def stage_batches(docs: DataFrame, name: str) -> tuple[DataFrame, int, int]:
    """docs (with a text) and the column _batch, rewritten to the shared folder; the number of batches and of buckets (at least 1)."""
    staged = stage(docs.withColumn("_batch", F.spark_partition_id()), name)
    last, size = staged.agg(F.max("_batch"), F.sum(F.octet_length("text").cast("long"))).first()
    batches = (last or 0) + 1
    return staged, batches, min(MOST_BUCKETS, max(batches, (size or 0) // BUCKET_BYTES))


def write_answers(answers: DataFrame, batches: int, name: str) -> str:
    """Writes answers (with the column batch) as one folder a batch; gives the root."""
    root = shared_path(answers.sparkSession, name)
    answers.repartition(batches, "batch").write.partitionBy("batch").option("compression", "zstd").parquet(root)
    tidy(answers.sparkSession)
    return root


def read_answer(root: str, batch: int, columns: list[str] | None = None) -> pa.Table | None:
    """A batch's answer, or those columns of it, in a Python worker; None if it has none."""
    import pyarrow.parquet as pq
    from pyarrow import fs as pafs

    fs, path = arrow_fs(root)
    path = f"{path}/batch={batch}"
    if fs.get_file_info(path).type == pafs.FileType.NotFound:
        return None
    files = [f.path for f in fs.get_file_info(pafs.FileSelector(path)) if f.path.endswith(".parquet")]
    return pa.concat_tables([pq.read_table(f, columns=columns, filesystem=fs, partitioning=None) for f in sorted(files)]) if files else None


def by_batch(rows: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Arrow batches split where the column _batch changes."""
    for rb in rows:
        ids = rb.column("_batch").to_numpy()
        at = 0
        while at < len(ids):
            end = at + 1
            if ids[-1] == ids[at]:
                end = len(ids)
            else:
                while end < len(ids) and ids[end] == ids[at]:
                    end += 1
            yield int(ids[at]), rb.slice(at, end - at)
            at = end


def in_buckets(sent: DataFrame, answer: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    """Applies answer to each bucket's rows."""
    return sent.groupBy("bucket").applyInArrow(answer, schema)


def without(staged: DataFrame, batches: int, gone: DataFrame, columns: list[str]) -> DataFrame:
    """The given columns of staged rows whose doc_id isn't among gone (doc_id, batch); staged isn't shuffled."""
    root = write_answers(gone.select("doc_id", "batch").distinct(), batches, "gone")

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids = None, None
        for batch, rb in by_batch(rows):
            if batch != now:
                answer, now = read_answer(root, batch), batch
                ids = answer.column("doc_id").combine_chunks() if answer else pa.array([], pa.int64())
            yield rb.filter(pc.invert(pc.is_in(rb.column("doc_id"), ids))).select(columns)

    kinds = dict(staged.dtypes)
    return staged.select("_batch", *columns).mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in columns))
