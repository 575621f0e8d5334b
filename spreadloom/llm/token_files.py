"""Token-ID output: flat files of unsigned integers with 64-bit document offsets, memory-mapped on reading.

Format of one shard ``part-<n>-<attempt>``:

* ``.bin``: the ids of its documents one after another, little-endian, 16 bits wide where the vocabulary fits,
  else 32;
* ``.len``: 64-bit lengths, ``.doc``: 64-bit document ids, ``.idx``: 64-bit offsets of the documents in the whole
  corpus, one more than documents (the last is the end).

Shards follow the ascending order of document ids. A shard's base, the number of ids before it, is a prefix sum over
the shards' totals, so no task needs more than its own range of documents. Files carry the attempt's name and only
those listed in the manifest count: a lost or repeated task leaves nothing but an unread file.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import new_path, shuffle_partitions, written
from .tokens import encoder, in_slices

MANIFEST = "shard long, name string, n_docs long, n_null long, n_tokens long"  # n_null: documents without an id, a shard's first ones
DIGEST = "doc_id long, start long, n_tokens long, ids_crc32 long"


def _store(uri: str):
    from pyarrow.fs import FileSystem, LocalFileSystem

    if "://" not in uri and not uri.startswith("file:"):
        return LocalFileSystem(), uri
    return FileSystem.from_uri(uri)


def _load(uri: str, dtype: str) -> np.ndarray:
    """A file's numbers: mapped into memory where the store is a mounted folder, read otherwise."""
    fs, path = _store(uri)
    if fs.type_name == "local":
        import os

        return np.memmap(path, dtype, "r") if os.path.getsize(path) else np.zeros(0, dtype)
    with fs.open_input_file(path) as f:
        return np.frombuffer(f.read(), dtype)


def _save(uri: str, data: np.ndarray) -> None:
    fs, path = _store(uri)
    with fs.open_output_stream(path) as f:
        f.write(data.tobytes())


def write_tokens(docs: DataFrame, vocabulary: str, *, end_id: int = 0, folder: str | None = None) -> DataFrame:
    """Encode every whole text and write the shards; returns the manifest with each shard's base.

    Null texts count as empty and yield just the end id. Null ids come first and are kept. Rows with equal ids are all
    written, in the order of their texts. An empty table gives no shards. Other columns of ``docs`` are ignored.
    """
    spark = docs.sparkSession
    folder = folder or new_path(spark, "tokens")
    fs, path = _store(folder)
    fs.create_dir(path, recursive=True)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        name = f"part-{task.partitionId():06d}-{task.taskAttemptId()}"
        encode_texts = encoder(vocabulary)
        wide = "<u2" if encode_texts.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        fs, path = _store(folder)
        ids, sizes, nulls, out = [], [], 0, None
        for batch in batches:
            texts = batch.column("text").to_pylist()
            nulls += batch.column("doc_id").null_count
            ids.append(batch.column("doc_id").cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False))
            for part in in_slices(texts):
                for found in encode_texts(texts[part]):
                    out = out or fs.open_output_stream(f"{path}/{name}.bin")
                    out.write(np.append(found, np.uint32(end_id)).astype(wide).tobytes())
                    sizes.append(len(found) + 1)
        if out:
            out.close()
            _save(f"{folder}/{name}.doc", np.concatenate(ids).astype("<i8"))
            _save(f"{folder}/{name}.len", np.array(sizes, "<i8"))
            yield pa.RecordBatch.from_pydict({"shard": [task.partitionId()], "name": [f"{folder}/{name}:{wide}"], "n_docs": [len(sizes)], "n_null": [nulls], "n_tokens": [sum(sizes)]})

    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ordered = ordered.repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", "text")
    manifest = written(ordered.mapInArrow(encode, MANIFEST), "manifest")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def _spread(manifest: DataFrame) -> DataFrame:
    return manifest.repartition(shuffle_partitions(manifest.sparkSession), "shard")


def index_tokens(manifest: DataFrame) -> DataFrame:
    """Write each shard's ``.idx`` file of 64-bit offsets in the whole corpus; returns the manifest, now complete."""

    def offsets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                name = row["name"].rpartition(":")[0]
                sizes = _load(f"{name}.len", "<i8")
                _save(f"{name}.idx", np.concatenate([[0], np.cumsum(sizes)]).astype("<i8") + row["base"])
            yield batch

    return written(_spread(manifest).mapInArrow(offsets, manifest.schema), "manifest")


def read_tokens(manifest: DataFrame, *, with_ids: bool = False) -> DataFrame:
    """One row a document from the files: doc_id, start, n_tokens, ids_crc32 (of the ids as little-endian unsigned
    32-bit integers) and, if asked for, the ids themselves."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                name, _, wide = row["name"].rpartition(":")
                ids, index, docs = _load(f"{name}.bin", wide), _load(f"{name}.idx", "<i8"), _load(f"{name}.doc", "<i8")
                local = index - row["base"]
                step = 5000
                for at in range(0, len(docs), step):
                    now = range(at, min(at + step, len(docs)))
                    found = [ids[local[i] : local[i + 1]].astype("<u4") for i in now]
                    doc = docs[now.start : now.stop]
                    cols = {
                        "doc_id": pa.array(doc, pa.int64(), mask=np.arange(now.start, now.stop) < row["n_null"]),
                        "start": pa.array(np.asarray(index[now.start : now.stop]), pa.int64()),
                        "n_tokens": pa.array([len(x) for x in found], pa.int64()),
                        "ids_crc32": pa.array([zlib.crc32(x.tobytes()) for x in found], pa.int64()),
                    }
                    if with_ids:
                        cols["ids"] = pa.array([x.astype("i8") for x in found], pa.list_(pa.int64()))
                    yield pa.RecordBatch.from_pydict(cols)

    return _spread(manifest).mapInArrow(read, DIGEST + (", ids array<long>" if with_ids else ""))


def tokens_round_trip(docs: DataFrame, vocabulary: str, *, end_id: int = 0) -> DataFrame:
    return read_tokens(index_tokens(write_tokens(docs, vocabulary, end_id=end_id)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .common import table
    from .tokens import default_vocabulary

    return tokens_round_trip(table(spark, sf_dir, "documents"), default_vocabulary())
