"""Token ids as compressed documents: a shared zstandard dictionary, one frame a document, an offset index.

Format, three Parquet tables in a folder (any store Spark writes to):
  dictionary/  one row: hash (sha256 of the bytes, hex), bytes (the trained dictionary), width (bytes an id)
  starts/      shard, start (ids of all documents before the shard); one row a task that wrote, so small at any size
  shards/      one row a run of up to `shard_rows` documents and about `shard_bytes` bytes: shard, before (ids of the shard's earlier runs),
               hash (of the dictionary to read it by), doc_ids, n_tokens, offsets (n + 1 positions in payload), payload
Ids are little-endian unsigned integers of `width` bytes. A reader finds a document by doc_ids (Parquet's statistics
prune shards), takes payload[offsets[i]:offsets[i + 1]] and decompresses that frame alone with the dictionary.

The dictionary is trained on the id arrays of a bounded seeded sample of short documents (`samples`, `sample_chars`);
it changes sizes only, as every document is stored whole and read back exactly. If too little is there to train on, the
dictionary is empty."""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vectide.llm.common import blocks, bounded_batches, bounded_sample, drop_folder, forget, shared_folder, written
from vectide.llm.encoding import encoder

END, LEVEL = 1, 3
SAMPLES, SAMPLE_CHARS, DICTIONARY_BYTES = 1_000, 4_000, 64 << 10


def ids_of(path: str, texts: list[str], end: int = END) -> list[bytes]:
    """The packed ids of whole texts, each with the end id."""
    e = encoder(path, "pack")
    last = e.make([end])
    return [ids + last for ids in e.packed(texts)]


def train(docs: DataFrame, path: str, samples: int = SAMPLES, sample_chars: int = SAMPLE_CHARS) -> bytes:
    """About `samples` short texts reach the driver, the same however the rows lie, and however many copies a text has."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = bounded_sample(rows, samples, 11).filter(F.length("text").between(1, sample_chars))
    texts = sorted(r.text for r in rows.select("text").collect())
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, ids_of(path, texts), level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b""


def _compressor(dictionary: bytes):
    shared = {}
    if dictionary:
        shared["dict_data"] = zstandard.ZstdCompressionDict(dictionary)
        shared["dict_data"].precompute_compress(level=LEVEL)
        return zstandard.ZstdCompressor(write_content_size=True, **shared)
    return zstandard.ZstdCompressor(level=LEVEL, write_content_size=True, **shared)


def _decompressor(dictionary: bytes):
    return zstandard.ZstdDecompressor(**({"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {}))


_SHARD = "before long, doc_ids array<long>, n_tokens array<long>, offsets array<long>, payload binary"


def _pack(shard_rows: int, shard_bytes: int):
    """mapInArrow over (doc_id, n_tokens, frame) in order: a row for each run of documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = size = 0
        ids, tokens, frames = [], [], []

        def put():
            offsets = np.r_[0, np.cumsum([len(f) for f in frames])].tolist()
            kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip([before, ids, tokens, offsets, b"".join(frames)], kinds, strict=True)], names=["before", "doc_ids", "n_tokens", "offsets", "payload"])

        for batch in batches:
            for i, n, f in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids.append(i)
                tokens.append(n)
                frames.append(f)
                size += len(f)
                if len(ids) >= shard_rows or size >= shard_bytes:
                    yield put()
                    before, size, ids, tokens, frames = before + sum(tokens), 0, [], [], []
        if ids:
            yield put()

    return run


def write_tokens(docs: DataFrame, path: str, folder: str, end: int = END, shard_rows: int = 4_096, shard_bytes: int = 8 << 20) -> None:
    """Write docs (doc_id, text) in ascending doc_id order (nulls first, then by the text's hash).

    Null texts are empty and hold the end id alone; repeated rows stay repeated. Encoded once; only ids are shuffled."""
    spark = docs.sparkSession
    bounded_batches(spark)
    dictionary = train(docs, path)
    digest, width = hashlib.sha256(dictionary).hexdigest(), np.dtype(encoder(path, "pack").form).itemsize
    spark.createDataFrame([(digest, bytearray(dictionary), width)], "hash string, bytes binary, width int").coalesce(1).write.parquet(f"{folder}/dictionary")

    @F.arrow_udf("struct<n:long,frame:binary>")
    def encode(texts: pa.Array) -> pa.Array:
        compress, n, frames = _compressor(dictionary).compress, [], []
        for block in blocks(texts):
            for raw in ids_of(path, block, end):
                n.append(len(raw) // width)
                frames.append(compress(raw))
        return pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(frames, pa.binary())], names=["n", "frame"])

    text = F.coalesce("text", F.lit(""))
    rows = written(docs.select("doc_id", F.xxhash64(text).alias("tie"), encode(text).alias("e")).select("doc_id", "tie", "e.n", "e.frame"), "frames")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("tie")]
    shards = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("doc_id", "n", "frame").mapInArrow(_pack(shard_rows, shard_bytes), _SHARD)
    shards.select(F.spark_partition_id().alias("shard"), "*", F.lit(digest).alias("hash")).write.parquet(f"{folder}/shards")
    forget(rows)
    counts = spark.read.parquet(f"{folder}/shards").groupBy("shard").agg(F.sum(F.aggregate("n_tokens", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n"))
    # a running sum over one row a task that wrote
    counts.select("shard", (F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("shard")) - F.col("n")).alias("start")).write.parquet(f"{folder}/starts")


def read_tokens(spark: SparkSession, folder: str, result: str, of):
    """One row a document: `of(doc_id, start, ids)` for each stored document, ids a numpy array; result: the rows' schema.

    A shard whose dictionary hash isn't that of the folder's dictionary is refused."""
    head = spark.read.parquet(f"{folder}/dictionary").first()
    dictionary, digest, form = bytes(head.bytes), head.hash, f"<u{head.width}"
    if hashlib.sha256(dictionary).hexdigest() != digest:
        raise ValueError("the dictionary doesn't have its hash")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand = _decompressor(dictionary).decompress
        for batch in batches:
            for digest_, start, ids, tokens, offsets, payload in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if digest_ != digest:
                    raise ValueError("the shard was written with another dictionary")
                out = []
                for i, doc_id in enumerate(ids):
                    raw = expand(payload[offsets[i] : offsets[i + 1]])
                    out.append(of(doc_id, start, np.frombuffer(raw, dtype=form)))
                    start += tokens[i]
                yield pa.RecordBatch.from_pylist(out, schema=_arrow(result))

    shards = spark.read.parquet(f"{folder}/shards").join(F.broadcast(spark.read.parquet(f"{folder}/starts")), "shard")
    return shards.select("hash", (F.col("start") + F.col("before")).alias("start"), "doc_ids", "n_tokens", "offsets", "payload").mapInArrow(run, result)


def _arrow(result: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "array<int>": pa.list_(pa.int32())}
    return pa.schema([(f.split()[0], kinds[f.split()[1]]) for f in result.split(", ")])


def digest_row(doc_id, start: int, ids: np.ndarray) -> dict:
    return {"doc_id": doc_id, "start": start, "n_tokens": len(ids), "ids_crc32": zlib.crc32(ids.astype("<u4").tobytes())}


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """Write docs' tokens below the shared folder, read the files back: (doc_id, start, n_tokens, ids_crc32)."""
    spark = docs.sparkSession
    bounded_batches(spark)
    folder = f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex[:12]}"
    write_tokens(docs, path, folder)
    return read_tokens(spark, folder, "doc_id long, start long, n_tokens long, ids_crc32 long", digest_row)
