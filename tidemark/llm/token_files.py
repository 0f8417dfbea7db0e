"""Token files: encoded documents in id order, as segments of rANS blocks in a Parquet container, and their reader."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.bpe import coder
from tidemark.llm.common import doc_texts, scratch
from tidemark.llm.rans import Table, decode_blocks, encode_blocks

#: Tokens after which a segment is closed, at the end of a document.
SEGMENT = 2 << 20
END_ID = 0
#: Stands for a null id in a segment's index.
_null_id = -(1 << 63)

_schema = pa.schema([
    ("shard", pa.int32()), ("segment", pa.int32()), ("first_doc", pa.int64()), ("n_tokens", pa.int64()),
    ("freqs", pa.binary()), ("doc_index", pa.binary()), ("check", pa.int64()), ("blocks", pa.list_(pa.binary())),
])
FILE_SQL = (
    "shard int, segment int, first_doc long, n_tokens long, freqs binary, doc_index binary, check long, blocks array<binary>"
)


def _segments(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, shard, number = coder(path), TaskContext.get().partitionId(), 0
        doc_ids: list[int] = []
        ids: list[np.ndarray] = []
        held = 0
        end = np.array([END_ID], np.uint16)

        def close() -> pa.RecordBatch:
            tokens = np.concatenate(ids)
            table = Table.of(tokens)
            index = zlib.compress(np.array([_null_id if x is None else x for x in doc_ids], "<i8").tobytes() + np.array([len(x) for x in ids], "<i8").tobytes(), 6)
            freqs = table.to_bytes()
            row = (shard, number, doc_ids[0], len(tokens), freqs, index, zlib.crc32(index, zlib.crc32(freqs)), encode_blocks(tokens, table))
            return pa.record_batch([pa.array([v], f.type) for v, f in zip(row, _schema, strict=True)], schema=_schema)

        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                part = batch.slice(i, 64)
                for doc_id, own in zip(part.column(0).to_pylist(), c.encode_many(part.column(1).to_pylist()), strict=True):
                    doc_ids.append(doc_id)
                    ids.append(np.concatenate([own, end]))
                    held += len(ids[-1])
                    if held >= SEGMENT:
                        yield close()
                        number += 1
                        doc_ids, ids, held = [], [], 0
        if ids:
            yield close()

    return run


def write_token_files(docs: DataFrame, path: str, folder: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every whole text, append END_ID, and write the ids in ascending id order to folder.

    A null text is empty and has the end id alone. Rows that repeat an id follow each other; rows without id come first. Shards are ranges of ids, so
    no task holds more than its range, one segment at a time; segments end with a document.
    """
    ordered = doc_texts(docs, id_col, text_col).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(_segments(path), FILE_SQL).write.option("compression", "uncompressed").parquet(folder)


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            row = {n: batch.column(n)[i].as_py() for n in batch.schema.names}
            if zlib.crc32(row["doc_index"], zlib.crc32(row["freqs"])) != row["check"]:
                raise ValueError("a segment's header checksum differs")
            ids = decode_blocks(row["blocks"], Table.from_bytes(row["freqs"]))
            index = np.frombuffer(zlib.decompress(row["doc_index"]), "<i8").reshape(2, -1)
            ends = np.cumsum(index[1])
            wide = memoryview(ids.astype("<u4").tobytes())
            crcs = [zlib.crc32(wide[4 * (e - n) : 4 * e]) for n, e in zip(index[1].tolist(), ends.tolist(), strict=True)]
            n = len(ends)
            yield pa.record_batch(
                [
                    pa.array(index[0], mask=index[0] == _null_id), pa.array(np.full(n, row["shard"], np.int32)), pa.array(np.full(n, row["segment"], np.int32)),
                    pa.array(ends - index[1]), pa.array(index[1]), pa.array(crcs, pa.int64()),
                ],
                names=["doc_id", "shard", "segment", "inside", "n_tokens", "ids_crc32"],
            )


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the files, decoded and checked against their checksums."""
    files = spark.read.schema(FILE_SQL).parquet(folder)
    segments = files.select("shard", "segment", "first_doc", "n_tokens")
    shards = segments.groupBy("shard").agg(F.min("first_doc").alias("first_doc"), F.sum("n_tokens").alias("n"))
    before = F.sum("n").over(Window.orderBy("first_doc", "shard").rowsBetween(Window.unboundedPreceding, -1))
    shards = shards.select("shard", F.coalesce(before, F.lit(0)).alias("shard_start"))
    inner = F.sum("n_tokens").over(Window.partitionBy("shard").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1))
    starts = segments.select("shard", "segment", F.coalesce(inner, F.lit(0)).alias("segment_start")).join(shards, "shard")
    schema = "doc_id long, shard int, segment int, inside long, n_tokens long, ids_crc32 long"
    return files.mapInArrow(_documents, schema).join(starts, ["shard", "segment"]).select(
        "doc_id", (F.col("shard_start") + F.col("segment_start") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32"
    )


def token_file_digests(docs: DataFrame, path: str) -> DataFrame:
    """What the reader gives for files written from docs in the scratch folder.

    Every row has one, also of null or empty texts (the end id alone), null ids (first) and repeated ids (in the order of their
    texts). Extra columns are ignored; an empty table gives an empty one.
    """
    folder = f"{scratch(docs.sparkSession)}/tidemark/tokens-{uuid.uuid4().hex}"
    write_token_files(docs, path, folder)
    return read_token_files(docs.sparkSession, folder)
