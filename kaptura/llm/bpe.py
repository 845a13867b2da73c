"""Byte-pair encoding and decoding over a public ``tokenizers`` vocabulary file.

Each pre-token is a doubly linked list of symbols; a priority queue holds the merge ranks of
adjacent pairs, the leftmost first among equals, and entries whose symbols have changed since
are skipped. Decoding concatenates the vocabulary's strings.

Texts: null and empty give no ids. A special token's string inside a text is its own id, as
the library does by default. Texts of any length are handled whole; memory beyond the text and
its ids is two caches of at most ``cache_words`` entries each.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import struct
import unicodedata
from collections.abc import Iterable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from kaptura.llm.common import LONGEST_KEPT

#: Python splits at these, the vocabulary's pattern does not; texts that hold one are taken whole.
_ODD_SPACE = regex.compile("[\x1c-\x1f]")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    table = {b: chr(b) for b in shown}
    for n, b in enumerate(b for b in range(256) if b not in table):
        table[b] = chr(256 + n)
    return [table[b] for b in range(256)]


class Bpe:
    """One vocabulary; made once in a Python worker and kept there."""

    _kept: dict[tuple[str, int], Bpe] = {}

    def __init__(self, path: str, cache_words: int):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        suffix = model.get("end_of_word_suffix") or ""
        self.strings = [""] * (max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])]) + 1)
        for s, i in vocab.items():
            self.strings[i] = s
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for s, i in self.special.items():
            self.strings[i] = s
        symbols = byte_symbols()
        self.inner = [vocab.get(s) for s in symbols]
        self.last = [vocab.get(s + suffix) for s in symbols]
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, (a, b) in enumerate(m if isinstance(m, list) else m.split(" ") for m in model["merges"]):
            self.merges[vocab[a], vocab[b]] = (rank, vocab[a + b])
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pieces = regex.compile(pattern)
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.cache_words = cache_words
        self.words: dict[str, bytes] = {}
        self.chunks: dict[str, bytes] = {}

    @classmethod
    def load(cls, path: str, cache_words: int = 300_000) -> Bpe:
        key = (path, cache_words)
        if key not in cls._kept:
            cls._kept[key] = cls(path, cache_words)
        return cls._kept[key]

    def merge(self, word: bytes) -> list[int]:
        """Ids of one pre-token."""
        ids = [self.inner[b] for b in word[:-1]]
        ids.append(self.last[word[-1]])
        ids = [i for i in ids if i is not None]
        n = len(ids)
        if n < 2:
            return ids
        merges = self.merges
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        queue = []
        for i in range(n - 1):
            found = merges.get((ids[i], ids[i + 1]))
            if found:
                queue.append((found[0], i, ids[i], ids[i + 1], found[1]))
        heapq.heapify(queue)
        while queue:
            _, i, left, right, new = heapq.heappop(queue)
            j = after[i]
            if ids[i] != left or j >= n or ids[j] != right:
                continue
            ids[i], ids[j] = new, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                found = merges.get((new, ids[k]))
                if found:
                    heapq.heappush(queue, (found[0], i, new, ids[k], found[1]))
            h = before[i]
            if h >= 0:
                found = merges.get((ids[h], new))
                if found:
                    heapq.heappush(queue, (found[0], h, ids[h], new, found[1]))
        return [i for i in ids if i >= 0]

    def _normal(self, text: str) -> str:
        text = unicodedata.normalize("NFC", text)
        return "".join(c.lower() for c in text) if "Σ" in text else text.lower()

    def _chunk(self, chunk: str) -> bytes:
        out = []
        for piece in self.pieces.findall(self._normal(chunk)):
            got = self.words.get(piece)
            if got is None:
                ids = self.merge(piece.encode())
                got = struct.pack(f"<{len(ids)}I", *ids)
                if len(self.words) < self.cache_words and len(piece) <= LONGEST_KEPT:
                    self.words[piece] = got
            out.append(got)
        return b"".join(out)

    def _plain(self, text: str) -> bytes:
        """Pre-tokens never span white space, so each run between white space is encoded once."""
        if _ODD_SPACE.search(text):
            return self._chunk(text)
        chunks = text.split()
        try:
            return b"".join(map(self.chunks.__getitem__, chunks))
        except KeyError:
            pass
        known = self.chunks
        new = {c: self._chunk(c) for c in set(chunks) if c not in known}
        if len(known) < self.cache_words:
            known.update((c, e) for c, e in new.items() if len(c) <= LONGEST_KEPT)
        return b"".join([known[c] if c in known else new[c] for c in chunks])

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if self.split_special is None or not any(s in text for s in self.special):
            return self._plain(text)
        return b"".join(struct.pack("<I", self.special[p]) if p in self.special else self._plain(p) for p in self.split_special.split(text) if p)

    def decode(self, ids: Iterable[int], joint: str = " ") -> str:
        """The vocabulary's strings joined; a vocabulary without a decoder joins them with a space."""
        return joint.join(map(self.strings.__getitem__, ids))


def encode_documents(docs: DataFrame, vocabulary: str, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` columns, ``ids`` (little-endian unsigned 32-bit, binary) and ``decoded`` of every row.

    One row out for each row in, repeated rows included; null and empty texts give empty ids and
    an empty string. Columns not in ``keep`` are not read.
    """
    kept = docs.select(*keep, docs[text].alias(max([*keep, ""], key=len) + "_text"))  # a name that none of them has
    schema = docs.select(*keep).schema.add("ids", "binary", False).add("decoded", "string", False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = Bpe.load(vocabulary)
        for batch in batches:
            encoded = [bpe.encode(t) for t in batch.column(len(keep)).to_pylist()]
            decoded = [bpe.decode(memoryview(e).cast("I")) for e in encoded]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(encoded, pa.binary()), pa.array(decoded, pa.string())], names=[*keep, "ids", "decoded"])

    return kept.mapInArrow(run, schema)


def token_digests(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, n_tokens and SHA-256 of the ids and of the decoded text, digested where they are made."""
    kept = docs.select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = Bpe.load(vocabulary)
        for batch in batches:
            n, ids, texts = [], [], []
            for t in batch.column(1).to_pylist():
                e = bpe.encode(t)
                n.append(len(e) // 4)
                ids.append(hashlib.sha256(e).hexdigest())
                texts.append(hashlib.sha256(bpe.decode(memoryview(e).cast("I")).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids), pa.array(texts)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return kept.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
