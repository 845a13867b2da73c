"""Token ids in sorted-string-table shards.

A shard holds documents in ascending key order:

    data blocks | Bloom filter | block index | footer

A block is a zstd frame of entries ``shared, rest, size`` (varints), the rest of the key, the
value. ``shared`` is what the key has in common with the key before it in the block. The index
has each block's last key, offset and length; the footer has the places and the counts. A lookup
asks the Bloom filter, finds the block by binary search in the index, and reads that block only.

Keys: the identifier as eight big-endian bytes, the sign bit turned, so byte order is number
order; a null identifier has the empty key and comes first. Rows with one identifier are all
kept, side by side, by text. Null and empty texts have the end id alone.
"""

from __future__ import annotations

import bisect
import os
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kaptura.llm.bpe import Bpe, byte_symbols
from kaptura.llm.common import LONGEST_KEPT, open_fs, scratch_path, shuffle_partitions

MAGIC = b"KSST0001"
FOOTER = struct.Struct("<QQQQQQB7x8s")
BLOOM_BITS, BLOOM_HASHES = 10, 7


def key_of(doc_id: int | None) -> bytes:
    return b"" if doc_id is None else struct.pack(">Q", doc_id + (1 << 63))


def doc_of(key: bytes) -> int | None:
    return struct.unpack(">Q", key)[0] - (1 << 63) if key else None


def put_varint(out: bytearray, n: int) -> None:
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)


def get_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def common_prefix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    return next((i for i in range(n) if a[i] != b[i]), n)


def bloom_places(digest: int, bits: int) -> list[int]:
    low, high = digest & 0xFFFFFFFF, digest >> 32 | 1
    return [(low + i * high) % bits for i in range(BLOOM_HASHES)]


class Writer:
    """Entries must come in ascending key order."""

    def __init__(self, sink, width: int, block_bytes: int = 1 << 16):
        self.sink, self.width, self.block_bytes = sink, width, block_bytes
        self.block, self.last, self.at = bytearray(), b"", 0
        self.index, self.digests, self.n_ids = [], [], 0
        self.pack = zstandard.ZstdCompressor(level=1)

    def add(self, key: bytes, value: bytes) -> None:
        shared = common_prefix(self.last, key) if self.block else 0
        put_varint(self.block, shared)
        put_varint(self.block, len(key) - shared)
        put_varint(self.block, len(value))
        self.block += key[shared:]
        self.block += value
        self.last = key
        self.digests.append(xxhash.xxh64_intdigest(key))
        self.n_ids += len(value) // self.width
        if len(self.block) >= self.block_bytes:
            self._flush()

    def _write(self, data: bytes) -> int:
        self.sink.write(data)
        self.at += len(data)
        return len(data)

    def _flush(self) -> None:
        if self.block:
            at = self.at
            self.index.append((self.last, at, self._write(self.pack.compress(bytes(self.block)))))
            self.block = bytearray()

    def close(self) -> None:
        self._flush()
        bits = max(64, BLOOM_BITS * len(self.digests))
        bloom = np.zeros(bits, np.bool_)
        for d in self.digests:
            bloom[bloom_places(d, bits)] = True
        bloom_at = self.at
        self._write(np.packbits(bloom).tobytes())
        index = bytearray()
        for key, at, size in self.index:
            put_varint(index, len(key))
            index += key
            put_varint(index, at)
            put_varint(index, size)
        index_at = self.at
        self._write(bytes(index))
        self._write(FOOTER.pack(bloom_at, bits, index_at, len(index), len(self.digests), self.n_ids, self.width, MAGIC))


class Reader:
    def __init__(self, source, size: int):
        self.source = source
        source.seek(size - FOOTER.size)
        self.bloom_at, self.bits, index_at, index_size, self.n_docs, self.n_ids, self.width, magic = FOOTER.unpack(source.read(FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a sorted-string table")
        source.seek(self.bloom_at)
        self.bloom = source.read((self.bits + 7) // 8)
        source.seek(index_at)
        data, at, self.last, self.place = source.read(index_size), 0, [], []
        while at < len(data):
            n, at = get_varint(data, at)
            self.last.append(data[at : at + n])
            offset, at = get_varint(data, at + n)
            size, at = get_varint(data, at)
            self.place.append((offset, size))

    def block(self, n: int) -> Iterator[tuple[bytes, bytes]]:
        offset, size = self.place[n]
        self.source.seek(offset)
        data = zstandard.ZstdDecompressor().decompress(self.source.read(size))
        at, key = 0, b""
        while at < len(data):
            shared, at = get_varint(data, at)
            rest, at = get_varint(data, at)
            size, at = get_varint(data, at)
            key = key[:shared] + data[at : at + rest]
            at += rest
            yield key, data[at : at + size]
            at += size

    def __iter__(self) -> Iterator[tuple[bytes, bytes]]:
        for n in range(len(self.place)):
            yield from self.block(n)

    def lookup(self, key: bytes) -> list[bytes]:
        """Values of ``key``: none if it isn't there."""
        if not all(self.bloom[p >> 3] >> (7 - (p & 7)) & 1 for p in bloom_places(xxhash.xxh64_intdigest(key), self.bits)):
            return []
        found = []
        for n in range(bisect.bisect_left(self.last, key), len(self.place)):
            found += (v for k, v in self.block(n) if k == key)
            if self.last[n] > key:
                break
        return found


class LibraryIds:
    """Ids by the tokenizers library, which is asked once for a word and not for each place of it.

    Runs between white space are kept; a new one of Latin-1 characters (each a composed one with one
    lower case) is cut by the vocabulary's own pattern, and words that aren't known go to the
    library's model. Both caches are of fixed size.
    """

    _kept: dict[str, LibraryIds] = {}

    def __init__(self, path: str, cache_words: int = 800_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the tasks are parallel already
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        bpe = Bpe(path, 0)
        self.special, self.pieces, self.cache_words = bpe.special, bpe.pieces, cache_words
        self.model, self.symbols = self.tokenizer.model, byte_symbols()
        self.size = len(bpe.strings)
        self.type = np.dtype("<u2") if self.size <= 1 << 16 else np.dtype("<u4")
        self.kept: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}

    @classmethod
    def load(cls, path: str) -> LibraryIds:
        if path not in cls._kept:
            cls._kept[path] = cls(path)
        return cls._kept[path]

    def _pack(self, ids: list[int]) -> bytes:
        return np.array(ids, self.type).tobytes()

    def _word(self, word: str) -> bytes:
        """Ids of one pre-token, by the library's model."""
        got = self.words.get(word)
        if got is None:
            plain = word.isascii() and word.isprintable()
            shown = word if plain else "".join(map(self.symbols.__getitem__, word.encode()))
            got = self._pack([t.id for t in self.model.tokenize(shown)])
            if len(self.words) < self.cache_words and len(word) <= LONGEST_KEPT:
                self.words[word] = got
        return got

    def _chunk(self, chunk: str) -> bytes:
        """Ids of a run: of Latin-1 characters word by word, another by the library as it is."""
        if max(chunk) >= "\u0100":
            return self._pack(self.tokenizer.encode(chunk, add_special_tokens=False).ids)
        low = chunk.lower()
        if low.isalpha():
            return self._word(low)
        if low[-1] in ".," and low[:-1].isalpha():
            return self._word(low[:-1]) + self._word(low[-1])
        return b"".join(map(self._word, self.pieces.findall(low)))

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if any(s in text for s in self.special) or any(c in text for c in "\x1c\x1d\x1e\x1f"):
            return self._pack(self.tokenizer.encode(text, add_special_tokens=False).ids)
        chunks = text.split()
        try:
            return b"".join(map(self.kept.__getitem__, chunks))
        except KeyError:
            pass
        known = self.kept
        new = {c: self._chunk(c) for c in set(chunks) if c not in known}
        if len(known) < self.cache_words:
            known.update((c, e) for c, e in new.items() if len(c) <= LONGEST_KEPT)
        return b"".join([known[c] if c in known else new[c] for c in chunks])


def write_shards(docs: DataFrame, vocabulary: str, end_id: int, folder: str, key: str = "doc_id", text: str = "text") -> list[dict]:
    """Write ``docs`` as shards under ``folder``; returns one entry for each shard, in key order.

    Rows are dealt to shards by ranges of the key before they are encoded, so only texts move; rows of
    one key, a null or repeated one, by their texts' hashes and, where these are equal too, by their
    places in the input, so that they go to as many shards as they fill.
    Each attempt of a task writes a file of its own and only the finished attempt's name comes
    back, so lost executors leave no half-written shard behind a name in use.
    """
    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    rows = rows.withColumn("of_text", F.xxhash64("text")).withColumn("place", F.monotonically_increasing_id())
    dealt = rows.repartitionByRange(shuffle_partitions(docs.sparkSession), "key", "of_text", "place")
    ordered = dealt.sortWithinPartitions("key", "of_text", "place").select("key", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = LibraryIds.load(vocabulary)
        end = ids._pack([end_id])
        writer = sink = first = None
        part = TaskContext.get().partitionId()
        path = f"{folder}/shard-{part:06d}-{uuid.uuid4().hex}.sst"
        for batch in batches:
            for doc, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if writer is None:
                    files, at = open_fs(path)
                    files.create_dir(at.rsplit("/", 1)[0], recursive=True)
                    sink = files.open_output_stream(at)
                    writer, first = Writer(sink, ids.type.itemsize), doc
                writer.add(key_of(doc), ids.encode(body) + end)
        if writer is not None:
            writer.close()
            sink.close()
            yield pa.RecordBatch.from_pydict({"path": [path], "part": [part], "first": [first], "n_docs": [len(writer.digests)], "n_ids": [writer.n_ids]}, schema=pa.schema([("path", pa.string()), ("part", pa.int64()), ("first", pa.int64()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]))

    found = ordered.mapInArrow(run, "path string, part long, first long, n_docs long, n_ids long").collect()
    shards = sorted((r.asDict() for r in found), key=lambda r: r["part"])  # ranges are numbered in order
    start = 0
    for s in shards:
        s["start"] = start
        start += s["n_ids"]
    return shards


def read_shards(spark: SparkSession, shards: list[dict]) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, read back from the files."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    if not shards:
        return spark.createDataFrame([], schema)
    listed = spark.createDataFrame([(s["path"], s["start"]) for s in shards], "path string, start long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                files, at = open_fs(path)
                rows = []
                with files.open_input_file(at) as source:
                    reader = Reader(source, source.size())
                    kind = np.dtype(f"<u{reader.width}")
                    for key, value in reader:
                        ids = np.frombuffer(value, kind).astype("<u4")
                        rows.append((doc_of(key), start, len(ids), zlib.crc32(ids.tobytes())))
                        start += len(ids)
                        if len(rows) == 10_000:
                            yield _batch(rows)
                            rows = []
                if rows:
                    yield _batch(rows)

    def _batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return listed.repartition(min(len(shards), 4 * shuffle_partitions(spark))).mapInArrow(run, schema)


def token_id_table(docs: DataFrame, vocabulary: str, end_id: int = 1) -> DataFrame:
    """Write shards to the shared folder and describe every document from them."""
    spark = docs.sparkSession
    return read_shards(spark, write_shards(docs, vocabulary, end_id, scratch_path(spark, "sst")))
