"""Token-ID / binary output: per-document zstandard frames under one shared dictionary.

The store is two Parquet tables in one folder, so any file system that Spark
writes will do and a lost task is simply written again:

``blocks``      one row per block of documents in ascending id order: the shard
                (range partition), the block's place in it, ids and token counts
                of its documents, the offset index into ``data``, the hash of the
                dictionary, and ``data``: one zstandard frame per document.
``shards``      one row per shard: its first token position in the whole store.
``dictionary``  one row: hash and bytes of the dictionary.

Nulls and edge cases: a null text is an empty one and has only the end id; a
null id sorts first; repeated ids are separate documents, ordered by a hash of
their text; an empty table gives an empty store.  Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import rows_of, to_batch
from .tokens import ids

#: Bounds of the sample that the dictionary is trained on: documents, and characters in each; they are taken whole.
DICTIONARY_DOCS = 1024
DICTIONARY_CHARS = 65_536
DICTIONARY_BYTES = 64 * 1024
BLOCK_DOCS = 256
BLOCK_BYTES = 1 << 20

_BLOCKS = (
    "shard long, block long, start long, tokens long, min_id long, max_id long, dict_hash string, "
    "doc_ids array<long>, counts array<long>, offsets array<long>, data binary"
)


def train_dictionary(docs: DataFrame, id_col: str, text_col: str, tokenizer_path: str, end_id: int) -> bytes:
    """Trained on the serialized ids of whole documents, the same ones on every run: of those with at most
    ``DICTIONARY_CHARS`` characters the ones whose hashes are lowest.  Empty if they are too few."""
    import zstandard

    key = F.xxhash64(id_col)
    # Twice as many ids as documents are wanted: some of them have texts too long to sample.
    last = docs.select(key.alias("h")).orderBy("h").limit(2 * DICTIONARY_DOCS).agg(F.max("h")).first()[0]
    few = docs.where((key <= (0 if last is None else last)) & (F.length(text_col) <= DICTIONARY_CHARS))
    rows = few.orderBy(key, F.xxhash64(text_col)).select(text_col).limit(DICTIONARY_DOCS).collect()
    coder, end = ids(tokenizer_path), np.uint32(end_id).tobytes()
    samples = [coder.bytes_of(r[0]) + end for r in rows]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b""


@lru_cache(maxsize=4)
def _dictionary(raw: bytes):
    import zstandard

    return zstandard.ZstdCompressionDict(raw) if raw else None


def write_store(
    docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text"
) -> None:
    """Encodes every whole text, appends ``end_id`` and writes the store to ``path``.

    One shuffle: texts go to range partitions by id, and by their hash where an id recurs.  Each task encodes its
    documents once, in order, holding one block at a time.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    raw = train_dictionary(docs, "id", "text", tokenizer_path, end_id)
    digest = hashlib.sha256(raw).hexdigest()
    end = np.uint32(end_id).tobytes()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        from pyspark import TaskContext
        from pyspark.sql.pandas.types import to_arrow_schema

        shard = TaskContext.get().partitionId()
        press = zstandard.ZstdCompressor(level=3, dict_data=_dictionary(raw))
        coder, schema = ids(tokenizer_path), to_arrow_schema(kinds)
        start = block = 0
        own, counts, frames, size = [], [], [], 0

        def row() -> pa.RecordBatch:
            real = [x for x in own if x is not None]
            offsets = [0, *np.cumsum([len(f) for f in frames]).tolist()]
            return to_batch(
                [(shard, block, start, sum(counts), min(real, default=None), max(real, default=None), digest, own, counts, offsets, b"".join(frames))],
                schema,
            )

        for key, text in rows_of(batches):
            data = coder.bytes_of(text) + end
            frame = press.compress(data)
            own.append(key)
            counts.append(len(data) // 4)
            frames.append(frame)
            size += len(frame)
            if len(own) >= BLOCK_DOCS or size >= BLOCK_BYTES:
                yield row()
                start, block = start + sum(counts), block + 1
                own, counts, frames, size = [], [], [], 0
        if own:
            yield row()

    kinds = spark.createDataFrame([], _BLOCKS).schema
    ordered = docs.repartitionByRange("id", F.xxhash64("text")).sortWithinPartitions("id", F.xxhash64("text"))
    ordered.mapInArrow(encode, _BLOCKS).write.option("compression", "none").parquet(f"{path}/blocks")
    spark.createDataFrame([(digest, bytearray(raw))], "hash string, bytes binary").coalesce(1).write.parquet(f"{path}/dictionary")
    # One row per range partition, however large the store: a window over them is small.
    shards = spark.read.parquet(f"{path}/blocks").groupBy("shard").agg(F.sum("tokens").alias("tokens"))
    before = F.sum("tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    shards.select("shard", F.coalesce(before, F.lit(0)).alias("base")).coalesce(1).write.parquet(f"{path}/shards")


def read_store(spark: SparkSession, path: str, only: int | None = None) -> DataFrame:
    """Documents of the store: ``doc_id, start, n_tokens, ids`` (binary) and the dictionary's hash.

    ``only``: one document id; blocks that can't hold it are skipped in the
    scan, and of a block that may, its frame alone is decompressed.
    """
    digest, raw = spark.read.parquet(f"{path}/dictionary").select("hash", "bytes").first()
    raw = bytes(raw)
    if hashlib.sha256(raw).hexdigest() != digest:
        raise ValueError(f"{path}: the dictionary does not match its hash")
    # One row per range partition of the writer: bounded by the number of tasks, not by the data.
    shards = F.broadcast(spark.read.parquet(f"{path}/shards"))
    blocks = spark.read.schema(_BLOCKS).parquet(f"{path}/blocks")
    if only is not None:
        blocks = blocks.where((F.col("min_id") <= only) & (F.col("max_id") >= only))
    blocks = blocks.join(shards, "shard").select(
        (F.col("base") + F.col("start")).alias("start"), "dict_hash", "doc_ids", "counts", "offsets", "data"
    )
    schema = "doc_id long, start long, n_tokens long, ids binary, dict_hash string"
    kinds = spark.createDataFrame([], schema).schema

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(kinds)
        press = zstandard.ZstdDecompressor(dict_data=_dictionary(raw))
        for batch in batches:
            for start, used, own, counts, offsets, data in zip(*(c.to_pylist() for c in batch.columns)):
                if used != digest:
                    raise ValueError("a block was written with another dictionary")
                rows = []
                for k, (key, n) in enumerate(zip(own, counts)):
                    if only is None or key == only:
                        rows.append((key, start, n, press.decompress(data[offsets[k] : offsets[k + 1]], max_output_size=4 * n), used))
                    start += n
                if rows:
                    yield to_batch(rows, arrow)

    return blocks.mapInArrow(decode, schema)
