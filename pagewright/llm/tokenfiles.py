"""Token ids in binary files with random access to short documents.

A corpus is a folder:

  dictionary.zdict   zstandard dictionary trained on serialized id arrays (may be empty)
  NNNNNN.bin         "PWTOK1\\0\\0", SHA-256 of the dictionary (32 bytes), then one zstandard frame a document
  NNNNNN.idx         "PWIDX1\\0\\0", SHA-256 of the dictionary, document count (u64), then for each document
                     doc_id (i64), flags (u8: 1 if doc_id is null), offset of its frame (u64), frame bytes (u32),
                     token count (u32)
  manifest.json      dictionary digest and, for each shard in order, documents, tokens and its first token's place

All integers are little-endian. A frame holds the document's ids as unsigned 32-bit integers. Shards
follow each other by doc_id (nulls first, ties by text), as do the documents of a shard; in a corpus written in an order of its own,
as the pipeline's mix, they follow in that order, and the manifest says so ("order": "given"). A reader refuses a shard
whose dictionary digest is not that of the dictionary. A shard is written under a name of its attempt
and renamed when complete, so a task that runs again replaces it with the same bytes.

The dictionary is trained on a sample of SAMPLE distinct texts (in expectation, by a hash of doc_id and text), of
longer ones an excerpt of SAMPLE_CHARS characters; too few samples give an empty dictionary. Null texts count as empty and hold the end id alone.
Other columns of the input are not read. No documents: a manifest without shards, and no rows.
"""

from __future__ import annotations

import bisect
import hashlib
import io
import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm._common import arrow_batches, excerpt, fresh, hash_fraction, shared_dir, shuffle_partitions, table
from pagewright.llm.pieces import Encoder, encoder

BIN, IDX = b"PWTOK1\0\0", b"PWIDX1\0\0"
ENTRY = np.dtype([("doc_id", "<i8"), ("flags", "u1"), ("offset", "<u8"), ("size", "<u4"), ("n_tokens", "<u4")])
END = 2
SAMPLE, SAMPLE_CHARS, DICTIONARY_BYTES = 1000, 16_384, 65_536
LEVEL = 3


def _fs(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri else "file:" + uri if uri.startswith("/") else uri)


def _put(fs: pafs.FileSystem, path: str, data: bytes) -> None:
    with fs.open_output_stream(path) as f:
        f.write(data)


def _get(fs: pafs.FileSystem, path: str) -> bytes:
    with fs.open_input_file(path) as f:
        return f.read()


def train_dictionary(docs: DataFrame, tokenizer_path: str) -> bytes:
    """A dictionary for id arrays, trained on a bounded sample."""
    n = docs.count()
    sample = docs.where((hash_fraction("doc_id", "text") < min(1.0, SAMPLE / max(n, 1))) & F.col("text").isNotNull()).select(excerpt("text", SAMPLE_CHARS).alias("text")).distinct()
    arrays = [x for x in Encoder(tokenizer_path).encode_all(r[0] for r in sample.orderBy("text").toLocalIterator()) if x]
    if len(arrays) < 16 or sum(map(len, arrays)) < 10 * 1024:
        return b""
    try:
        return zstandard.train_dictionary(min(DICTIONARY_BYTES, sum(map(len, arrays)) // 8), arrays).as_bytes()
    except zstandard.ZstdError:
        return b""


def _codec(dictionary: bytes):
    d = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=d), zstandard.ZstdDecompressor(dict_data=d)


def file_order(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """docs with columns that give the order in which they were written, and their names: the places in the files that docs is read
    from, by the number of the file; where docs isn't read from files, the order of its partitions and rows."""
    size, name, row = fresh(docs, "length", "file", "row")
    try:
        at = docs.withColumns({size: F.length("_metadata.file_name"), name: F.col("_metadata.file_name"), row: F.col("_metadata.row_index")})
    except AnalysisException:
        at = docs.withColumns({size: F.lit(0), name: F.lit(""), row: F.monotonically_increasing_id()})
    return at, [size, name, row]


def write_corpus(docs: DataFrame, tokenizer_path: str, out: str, end: int = END, order: list[str] | None = None) -> dict:
    """Writes the ids of docs(doc_id, text) to the folder out and returns the manifest. order: columns to go by instead of doc_id."""
    spark = docs.sparkSession
    arrow_batches(spark)
    fs, root = _fs(out)
    fs.create_dir(root, recursive=True)
    dictionary = train_dictionary(docs, tokenizer_path)
    _put(fs, f"{root}/dictionary.zdict", dictionary)
    digest = hashlib.sha256(dictionary).digest()
    tail = struct.pack("<I", end)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _fs(out)
        if hashlib.sha256(known := _get(fs, f"{root}/dictionary.zdict")).digest() != digest:
            raise ValueError("another dictionary lies in the folder")
        pack = _codec(known)[0]
        tokens = encoder(tokenizer_path)
        shard = TaskContext.get().partitionId()
        attempt = f"{root}/attempt-{shard}-{uuid.uuid4().hex}"
        entries, at = [], len(BIN) + 32
        first = next(batches, None)
        while first is not None and not first.num_rows:
            first = next(batches, None)
        if first is None:
            return
        with fs.open_output_stream(f"{attempt}.bin") as f:
            f.write(BIN + digest)
            b: pa.RecordBatch | None = first
            while b is not None:
                part = np.zeros(b.num_rows, ENTRY)
                for i, (doc, ids) in enumerate(zip(b.column(0).to_pylist(), tokens.encode_all(b.column(1).to_pylist()), strict=True)):
                    frame = pack.compress(ids + tail)
                    f.write(frame)
                    part[i] = (doc or 0, doc is None, at, len(frame), len(ids) // 4 + 1)
                    at += len(frame)
                entries.append(part)
                b = next(batches, None)
        tokens.settle()
        index = np.concatenate(entries)
        _put(fs, f"{attempt}.idx", IDX + digest + struct.pack("<Q", len(index)) + index.tobytes())
        for kind in ("bin", "idx"):
            fs.move(f"{attempt}.{kind}", f"{root}/{shard:06d}.{kind}")
        yield pa.RecordBatch.from_pydict({"shard": [shard], "docs": [len(index)], "tokens": [int(index["n_tokens"].sum())]}, pa.schema([("shard", pa.int64()), ("docs", pa.int64()), ("tokens", pa.int64())]))

    n, rows = shuffle_partitions(spark), docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), *(order or []))
    if order:
        ordered = rows.repartitionByRange(n, *order).sortWithinPartitions(*order).select("doc_id", "text")
    else:
        ordered = rows.repartitionByRange(n, F.asc_nulls_first("doc_id")).sortWithinPartitions(F.asc_nulls_first("doc_id"), "text")
    shards = sorted(tuple(r) for r in ordered.mapInArrow(run, "shard long, docs long, tokens long").collect())  # a row a partition
    manifest, start = {"dictionary": digest.hex(), "end": end, "shards": []} | ({"order": "given"} if order else {}), 0
    for shard, n, tokens in shards:
        manifest["shards"].append({"shard": shard, "docs": n, "tokens": tokens, "start": start})
        start += tokens
    _put(fs, f"{root}/manifest.json", json.dumps(manifest).encode())
    return manifest


def _index(fs: pafs.FileSystem, root: str, shard: int, digest: bytes) -> np.ndarray:
    raw = _get(fs, f"{root}/{shard:06d}.idx")
    if raw[:8] != IDX or raw[8:40] != digest:
        raise ValueError(f"shard {shard}: not an index of this dictionary")
    return np.frombuffer(raw, ENTRY, offset=48, count=struct.unpack_from("<Q", raw, 40)[0])


def read_corpus(spark: SparkSession, out: str, ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids binary]) of every document of a folder, from its files."""
    fs, root = _fs(out)
    manifest = json.loads(_get(fs, f"{root}/manifest.json"))
    names = ["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * ids
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * ids
    digest = bytes.fromhex(manifest["dictionary"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _fs(out)
        dictionary = _get(fs, f"{root}/dictionary.zdict")
        if hashlib.sha256(dictionary).digest() != digest:
            raise ValueError("the dictionary is not the one in the manifest")
        unpack = _codec(dictionary)[1]
        for b in batches:
            for shard, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                index = _index(fs, root, shard, digest)
                with fs.open_input_stream(f"{root}/{shard:06d}.bin") as raw:
                    f = io.BufferedReader(raw, 1 << 20)
                    if f.read(8) != BIN or f.read(32) != digest:
                        raise ValueError(f"shard {shard}: not a file of this dictionary")
                    for k in range(0, len(index), 1024):
                        part = index[k : k + 1024]
                        texts = [unpack.decompress(f.read(int(n))) for n in part["size"]]
                        n = np.array([len(t) // 4 for t in texts], np.int64)
                        if not (n == part["n_tokens"]).all():
                            raise ValueError(f"shard {shard}: the index disagrees with the frames")
                        cols = [pa.array(part["doc_id"], mask=part["flags"] == 1), pa.array(start + np.cumsum(n) - n), pa.array(n), pa.array([zlib.crc32(t) for t in texts], pa.int64())]
                        yield pa.RecordBatch.from_arrays(cols + [pa.array(texts, pa.binary())] * ids, names)
                        start += int(n.sum())

    shards = [(x["shard"], x["start"]) for x in manifest["shards"]]
    frame = spark.createDataFrame(shards, "shard long, start long")
    return (frame.repartitionById(len(shards), (F.col("shard") % len(shards)).cast("int")) if shards else frame).mapInArrow(run, schema)


def read_document(out: str, doc_id: int) -> list[int] | None:
    """The ids of one document, by its shard's index, without reading others; None where there is none."""
    fs, root = _fs(out)
    manifest = json.loads(_get(fs, f"{root}/manifest.json"))
    digest = bytes.fromhex(manifest["dictionary"])
    unpack = _codec(_get(fs, f"{root}/dictionary.zdict"))[1]
    shards = [x["shard"] for x in manifest["shards"]]

    def last(shard: int) -> int:
        index = _index(fs, root, shard, digest)
        return -(1 << 63) if index["flags"][-1] else int(index["doc_id"][-1])

    if "order" not in manifest:  # by doc_id: one shard can hold it
        at = bisect.bisect_left(shards, doc_id, key=last)
        shards = shards[at : at + 1]
    for shard in shards:
        index = _index(fs, root, shard, digest)
        found = index[(index["doc_id"] == doc_id) & (index["flags"] == 0)]
        if len(found):
            with fs.open_input_file(f"{root}/{shard:06d}.bin") as f:
                f.seek(int(found["offset"][0]))
                return np.frombuffer(unpack.decompress(f.read(int(found["size"][0]))), "<u4").tolist()
    return None


def write_and_read(docs: DataFrame, given_order: bool = False) -> DataFrame:
    """docs written with the word tokenizer to a new shared folder and read back; by doc_id, or in the order that they have."""
    import public_tokenizers

    out = shared_dir(docs.sparkSession, "token-files")
    docs, order = file_order(docs) if given_order else (docs, None)
    write_corpus(docs, public_tokenizers.path("word_bpe_49k.json"), out, order=order)
    return read_corpus(docs.sparkSession, out)


def op3_token_files(spark, sf_dir: str) -> DataFrame:
    return write_and_read(table(spark, sf_dir, "documents"))
