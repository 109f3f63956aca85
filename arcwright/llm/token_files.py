"""Token ids as flat binary files with 64-bit document offsets.

A shard is two files: ``tok``, the ids of its documents one after the other as unsigned
integers (16 bits where the vocabulary allows, else 32), and ``idx``, little-endian 64-bit
integers: the number of documents n, the bytes of an id, n document ids, n + 1 offsets counted in ids from the
start of the whole corpus.  Each shard's base is the prefix sum of the shards before it.
Shards hold consecutive ranges of doc_id, in ascending order.  Readers map ``tok`` into
memory and touch only the documents they want.
"""

from __future__ import annotations

import math
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from arcwright.functions.durable import new_path
from arcwright.llm.chunks import Coded, encode_column, slices
from arcwright.llm.rawfiles import read_raw, write_raw

SHARD_DOCS = 4096
SHARD_BYTES = 32_000_000
NULL_ID = -(2**63)

class ChunkEncoder:
    """The tokenizers library, asked once for each distinct chunk of a column of texts.

    The library cuts at added tokens before anything else, so a text that holds one of
    their strings is encoded whole.  The ids are those of the plain call at any place.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.added = [t.content for t in self.model.get_added_tokens_decoder().values()]
        self.dtype = np.dtype("<u2") if self.model.get_vocab_size() <= 2**16 else np.dtype("<u4")
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        self.coded = Coded(self.code)

    def _ids(self, some: list[str]) -> Iterator[list[int]]:
        return (e.ids for e in self.model.encode_batch_fast(some, add_special_tokens=False))

    def encode(self, texts: pa.StringArray) -> list[bytes]:
        """Ids of each text as bytes."""
        texts = texts.fill_null("")
        whole = np.zeros(len(texts), dtype=bool)
        for token in self.added:
            whole |= pc.match_substring(texts, token).to_numpy(zero_copy_only=False)
        plain = pc.if_else(pa.array(whole), "", texts) if whole.any() else texts
        out = encode_column(plain, self.coded, self._ids)
        for i in np.flatnonzero(whole):
            out[i] = np.array(next(self._ids([texts[int(i)].as_py()])), dtype=self.dtype).tobytes()
        return out


#: The encoder of each tokenizer file in a worker process; what it keeps is bounded.
_ENCODERS: dict[str, ChunkEncoder] = {}


def shared_encoder(path: str) -> ChunkEncoder:
    # a function of the module, so that tasks reach the module's own table and no pickled copy
    if path not in _ENCODERS:
        _ENCODERS[path] = ChunkEncoder(path)
    return _ENCODERS[path]


def _shards(tokenizer: str, end_id: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = shared_encoder(tokenizer)
        end = np.array([end_id], dtype=encoder.dtype).tobytes()
        part, turn, size = TaskContext.get().partitionId(), 0, 0
        ids: list[int] = []
        body: list[bytes] = []

        def flush() -> pa.RecordBatch:
            lengths = np.array([len(b) // encoder.dtype.itemsize for b in body], dtype="<u8")
            head = np.concatenate([[np.uint64(encoder.dtype.itemsize)], np.array(ids, dtype="<i8").view("<u8"), lengths]).astype("<u8").tobytes()
            shard = f"{part:08d}-{turn:06d}"
            return pa.record_batch({"kind": pa.array(["tok", "len"]), "shard": pa.array([shard] * 2), "payload": pa.array([b"".join(body), head], pa.binary())})

        for whole in batches:
            for batch in slices(whole):
                for i, b in zip(batch.column("doc_id").to_pylist(), encoder.encode(batch.column("text")), strict=True):
                    ids.append(NULL_ID if i is None else i)
                    body.append(b + end)
                    size += len(b)
                    if size >= SHARD_BYTES:
                        yield flush()
                        ids, body, size, turn = [], [], 0, turn + 1
        if body:
            yield flush()

    return work


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        total = [int(np.frombuffer(c, dtype="<u8")[1:].reshape(2, -1)[1].sum()) for c in b.column("content").to_pylist()]
        yield pa.record_batch({"shard": b.column("shard"), "total": pa.array(total, pa.int64())})


def _offsets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for c, base in zip(b.column("content").to_pylist(), b.column("base").to_pylist(), strict=True):
            head = np.frombuffer(c, dtype="<u8")
            ids, lengths = head[1:].reshape(2, -1)
            ends = np.cumsum(lengths, dtype="<u8") + np.uint64(base)
            out.append(np.concatenate([[np.uint64(len(ids)), head[0]], ids, [np.uint64(base)], ends]).astype("<u8").tobytes())
        yield pa.record_batch({"kind": pa.array(["idx"] * len(out)), "shard": b.column("shard"), "payload": pa.array(out, pa.binary())})


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0) -> None:
    """Encode ``docs(doc_id, text)`` and write the shards below ``path``.

    ``end_id`` must be 0 in its last byte (it closes every document and so every file).  A
    null or empty text is the end id alone.  Rows come in ascending doc_id, nulls first,
    repeated ids by text; other columns are ignored; an empty table writes no shard.
    """
    if end_id >> 8:
        raise ValueError("the end id closes a file and must fit in its lowest byte")
    spark = docs.sparkSession
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    shards = max(1, math.ceil(rows.count() / SHARD_DOCS))
    dealt = rows.repartitionByRange(shards, F.asc_nulls_first("doc_id")).sortWithinPartitions(F.asc_nulls_first("doc_id"), "text")
    made = dealt.mapInArrow(_shards(tokenizer, end_id), "kind string, shard string, payload binary")
    write_raw(made, f"{path}/first", ["kind", "shard"])
    if not _holds(spark, f"{path}/first/kind=len"):
        return
    lengths = read_raw(spark, f"{path}/first/kind=len").select("shard", "content")
    totals = lengths.mapInArrow(_sums, "shard string, total long")
    # one row per shard: file metadata, not data
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("shard", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    write_raw(lengths.join(bases, "shard").select("shard", "content", "base").mapInArrow(_offsets, "kind string, shard string, payload binary"), f"{path}/offsets", ["kind", "shard"])


def _holds(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def map_file(path: str, dtype: np.dtype) -> np.ndarray:
    """The file as an array: mapped into memory where it has a local path, else read."""
    if path.startswith("file:") or path.startswith("/"):
        local = re.sub("^file:/+", "/", path)
        return np.memmap(local, dtype=dtype, mode="r")
    from pyarrow import fs

    store, inner = fs.FileSystem.from_uri(path)
    with store.open_input_file(inner) as f:
        return np.frombuffer(f.read(), dtype=dtype)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for index, path in zip(b.column("content").to_pylist(), b.column("path").to_pylist(), strict=True):
            x = np.frombuffer(index, dtype="<u8")
            n, width = int(x[0]), int(x[1])
            ids, offsets = x[2 : 2 + n].view("<i8"), x[2 + n :].astype(np.int64)
            tokens = map_file(path, np.dtype(f"<u{width}"))
            cut = offsets - offsets[0]
            crc = [zlib.crc32(tokens[cut[i] : cut[i + 1]].astype("<u4").tobytes()) for i in range(n)]
            yield pa.record_batch(
                {
                    "doc_id": pa.array(ids, pa.int64(), mask=ids == NULL_ID),
                    "start": pa.array(offsets[:-1]),
                    "n_tokens": pa.array(np.diff(offsets)),
                    "ids_crc32": pa.array(crc, pa.int64()),
                }
            )


def read_token_digests(spark: SparkSession, path: str) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    if not _holds(spark, f"{path}/offsets/kind=idx"):
        return spark.createDataFrame([], schema)
    index = read_raw(spark, f"{path}/offsets/kind=idx").select("shard", "content")
    tokens = read_raw(spark, f"{path}/first/kind=tok", content=False).select("shard", "path")
    return index.join(tokens, "shard").select("content", "path").mapInArrow(_digests, schema)


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = new_path(spark, "tokens")
    write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return read_token_digests(spark, path)
