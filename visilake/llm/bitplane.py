"""Token ids in blocks of compressed byte planes, with a chunk index.

Documents are dealt by range of their id and sorted, tokenized whole, each followed by the end
id, and cut into blocks of ``BLOCK`` ids (a part's last block may be shorter). A block's ids, as
little-endian 32-bit integers, are transposed into four byte planes and each plane is compressed
with zstandard. The files are Parquet, one row a block: ``part``, ``chunk``, ``first`` (the
block's first place in its part), ``n_ids``, ``plane_sizes``, ``planes`` (their bytes, one after
another) and ``docs`` (id, start in the part and length of every document that touches the
block). All but ``planes`` is the chunk index; Parquet reads it without the planes.

Places over the whole corpus are a part's place plus the totals of the parts before it. Reading
needs no shuffle of ids: a block is decoded where it is read, and the checksums of a document's
pieces combine by the linearity of crc32.

Null and empty texts hold just the end id. Rows of equal id are ordered by a hash of their text;
equal rows are interchangeable; a null id sorts first. A tokenizer file that only the driver can
see must be sent to the executors first. A worker keeps the ids of a bounded number of words. Very long
texts are encoded in slices to the same ids. An empty table gives no rows; columns of other names play no part.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import before_blocks, new_path, whole_text
from .windows import _BYTE_BASES, _SPACE, _mixed, _rolled

BLOCK = 1 << 16
END_ID = 2
SLICE_BYTES = 1 << 20
SCHEMA = (
    "part int, chunk int, first long, n_ids int, plane_sizes array<int>, planes binary, "
    "docs array<struct<doc_id: long, start: long, n_tokens: long>>"
)


MARKS = b".,;:!?|"
#: words a worker keeps, by hash; when there are more, it begins anew
KNOWN_BITS = 21
_U = np.uint64


def spans(texts: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(all bytes, starts, ends and 64-bit hashes of the words, first word of each text and the total)."""
    joined = b" ".join(texts) + b" "
    data = np.frombuffer(joined, np.uint8)
    edge = np.flatnonzero(np.diff(_SPACE[data], prepend=True))
    starts, ends = edge[0::2], edge[1::2]
    values = data.astype(_U) + _U(1)
    one, two = (_rolled(values, starts, ends, base) for base in _BYTE_BASES)
    at = np.cumsum([0, *(len(t) + 1 for t in texts)])
    return joined, starts, ends, np.maximum(_mixed(one + _mixed(two)), _U(1)), np.searchsorted(starts, at)


class WordIds:
    """A tokenizer's ids by word, in an open hash table of arrays that a worker keeps.

    This tokenizer folds case, never joins across ASCII white space, and splits letters and
    digits from marks; only its special tokens' signs are read before case is folded. So words
    between white space are tokenized alike wherever they stand, and so are a word that ends
    in a letter or digit and the marks after it. Words are told apart by 64 bits of two hashes.
    """

    def __init__(self, path: str, known_bits: int = KNOWN_BITS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.bits = Tokenizer.from_file(path), known_bits + 1
        self.reset()

    def reset(self) -> None:
        self.keys, self.codes = np.zeros(1 << self.bits, _U), np.zeros(1 << self.bits, np.int32)
        self.known = 1  # code 0 is the end of a document
        self.start, self.size = np.zeros(1, np.int64), np.ones(1, np.int64)
        self.ids = np.array([END_ID], np.uint32)

    def solve(self, words: list[bytes]) -> list[list[int]]:
        cores = [w.rstrip(MARKS) for w in words]
        cores = [c if c[-1:].isalnum() else w for c, w in zip(cores, words, strict=True)]
        parts = list({*cores, *(w[len(c) :] for c, w in zip(cores, words, strict=True))})
        ids = {p: e.ids for p, e in zip(parts, self.tokenizer.encode_batch_fast([p.decode() for p in parts], add_special_tokens=False), strict=True)}
        return [ids[c] + ids[w[len(c) :]] for c, w in zip(cores, words, strict=True)]

    def find(self, hashed: np.ndarray) -> np.ndarray:
        """Codes of words, -1 where unknown."""
        slot = (hashed >> _U(64 - self.bits)).astype(np.int64)
        code, left = np.full(len(hashed), -1, np.int64), np.arange(len(hashed))
        while len(left):
            key = self.keys[slot]
            hit = key == hashed[left]
            code[left[hit]] = self.codes[slot[hit]]
            on = ~hit & (key != 0)
            left, slot = left[on], (slot[on] + 1) & ((1 << self.bits) - 1)
        return code

    def learn(self, hashed: np.ndarray, words: list[bytes]) -> None:
        """Ids of new, different words."""
        found = self.solve(words)
        size = np.fromiter(map(len, found), np.int64, len(found))
        self.start = np.concatenate((self.start, len(self.ids) + np.cumsum(size) - size))
        self.size = np.concatenate((self.size, size))
        self.ids = np.concatenate((self.ids, np.array(list(chain.from_iterable(found)), np.uint32)))
        slot, left = (hashed >> _U(64 - self.bits)).astype(np.int64), np.arange(len(hashed))
        while len(left):
            free = self.keys[slot] == 0
            _, first = np.unique(slot, return_index=True)  # one word a slot and round
            chosen = np.zeros(len(left), bool)
            chosen[first] = True
            chosen &= free
            self.keys[slot[chosen]] = hashed[left[chosen]]
            self.codes[slot[chosen]] = self.known + left[chosen]
            left, slot = left[~chosen], (slot[~chosen] + (~free)[~chosen]) & ((1 << self.bits) - 1)
        self.known += len(words)

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all documents, each with its end id; ids per document)."""
        joined, starts, ends, hashed, first = spans([t if b"<|" in t else t.lower() for t in texts])
        codes = self.find(hashed)
        unknown = np.flatnonzero(codes < 0)
        if len(unknown):
            new, at = np.unique(hashed[unknown], return_index=True)
            if self.known + len(new) > 1 << (self.bits - 1):
                self.reset()
                unknown = np.arange(len(hashed))
                new, at = np.unique(hashed, return_index=True)
            at = unknown[at]
            self.learn(new, [joined[a:b] for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True)])
            codes[unknown] = self.find(hashed[unknown])
        codes = np.insert(codes, first[1:], 0)
        sizes = self.size[codes]
        upto = np.cumsum(sizes)
        ids = self.ids[np.repeat(self.start[codes] - upto + sizes, sizes) + np.arange(upto[-1] if len(upto) else 0)]
        return ids, np.diff(upto[first[1:] + np.arange(len(texts))], prepend=0)


_loaded: dict[str, WordIds] = {}


def _word_ids(path: str) -> WordIds:
    if path not in _loaded:
        _loaded[path] = WordIds(path)
    return _loaded[path]


def pack(ids: np.ndarray) -> tuple[list[int], bytes]:
    """Byte planes of ids, lowest bytes first, each compressed."""
    planes = [zstandard.compress(p.tobytes(), 3) for p in ids.astype("<u4").view(np.uint8).reshape(-1, 4).T]
    return [len(p) for p in planes], b"".join(planes)


def unpack(n_ids: int, sizes: list[int], planes: bytes) -> np.ndarray:
    ends = np.cumsum(sizes)
    parts = [zstandard.decompress(planes[e - s : e]) for s, e in zip(sizes, ends, strict=True)]
    return np.frombuffer(b"".join(parts), np.uint8).reshape(4, n_ids).T.copy().view("<u4").ravel()


class _Part:
    """The blocks of one part, cut as ids arrive."""

    def __init__(self, part: int, size: int):
        self.part, self.size, self.chunk, self.first = part, size, 0, 0
        self.ids = np.empty(0, np.uint32)
        self.doc: list[int | None] = []
        self.start, self.n = np.empty(0, np.int64), np.empty(0, np.int64)
        self.total = 0

    def add(self, doc: list[int | None], ids: np.ndarray, n: np.ndarray, end: bool = False) -> Iterator[tuple]:
        self.ids = np.concatenate((self.ids, ids))
        self.doc += doc
        self.start = np.concatenate((self.start, self.total + np.cumsum(n) - n))
        self.n = np.concatenate((self.n, n))
        self.total += int(n.sum())
        cut = 0
        while len(self.ids) - cut >= self.size or end and cut < len(self.ids):
            block = self.ids[cut : cut + self.size]
            cut += len(block)
            upto = self.first + len(block)
            a = np.searchsorted(self.start + self.n, self.first, side="right")
            b = np.searchsorted(self.start, upto)
            docs = [{"doc_id": self.doc[i], "start": int(self.start[i]), "n_tokens": int(self.n[i])} for i in range(a, b)]
            yield (self.part, self.chunk, self.first, len(block), *pack(block), docs)
            self.chunk, self.first = self.chunk + 1, upto
        self.ids = self.ids[cut:]
        done = int(np.searchsorted(self.start + self.n, self.first, side="right"))
        self.doc, self.start, self.n = self.doc[done:], self.start[done:], self.n[done:]


def write_ids(docs: DataFrame, path: str, tokenizer: str, doc_id: str = "doc_id", text: str = "text", block: int = BLOCK) -> None:
    """Write the token ids of all documents, in ascending id order, to ``path``."""
    order = [F.col("doc_id"), F.xxhash64("text")]
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), whole_text(text).alias("text"))
    schema = pa.schema([
        ("part", pa.int32()), ("chunk", pa.int32()), ("first", pa.int64()), ("n_ids", pa.int32()), ("plane_sizes", pa.list_(pa.int32())),
        ("planes", pa.binary()), ("docs", pa.list_(pa.struct([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())]))),
    ])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, part = _word_ids(tokenizer), _Part(TaskContext.get().partitionId(), block)

        def out(rows) -> Iterator[pa.RecordBatch]:
            for row in rows:
                yield pa.RecordBatch.from_pydict({f.name: [v] for f, v in zip(schema, row, strict=True)}, schema=schema)

        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary())
            at = 0
            while at < len(ids):  # slices of bounded size, or one long document
                end, size = at, 0
                while end < len(ids) and (end == at or size + len(texts[end].as_buffer()) <= SLICE_BYTES):
                    size += len(texts[end].as_buffer())
                    end += 1
                yield from out(part.add(ids[at:end], *known.encode(texts[at:end].to_pylist())))
                at = end
        yield from out(part.add([], np.empty(0, np.uint32), np.empty(0, np.int64), end=True))

    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    dealt.mapInArrow(encode, SCHEMA).write.parquet(path)


def _times(a: int, b: int) -> int:
    """Product of two polynomials modulo the crc32 polynomial; the lowest power is the highest bit."""
    product = 0
    for bit in range(31, -1, -1):
        if a >> bit & 1:
            product ^= b
        b = b >> 1 ^ (0xEDB88320 if b & 1 else 0)
    return product


def crc_shifted(crc: int, n_bytes: int) -> int:
    """What a piece's crc32 adds to that of a text in which ``n_bytes`` follow it."""
    power, square = 1 << 31, 1 << 23  # x to the 0, x to the 8
    while n_bytes:
        if n_bytes & 1:
            power = _times(power, square)
        square, n_bytes = _times(square, square), n_bytes >> 1
    return _times(power, crc)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """The chunk index, planes left out."""
    return spark.read.schema(SCHEMA).parquet(path).drop("planes")


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    """(part, chunk, first, ids): every block decoded where it is read."""

    def decode(batches):
        for b in batches:
            ids = [unpack(n, s, p).astype(np.int64) for n, s, p in zip(*(b.column(c).to_pylist() for c in ("n_ids", "plane_sizes", "planes")), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("part"), b.column("chunk"), b.column("first"), pa.array(ids, pa.list_(pa.int64()))], ["part", "chunk", "first", "ids"])

    return spark.read.schema(SCHEMA).parquet(path).mapInArrow(decode, "part int, chunk int, first long, ids array<long>")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the files."""
    schema = "part int, doc_id long, start long, n_tokens long, crc long"

    def pieces(batches):
        for b in batches:
            rows = {"part": [], "doc_id": [], "start": [], "n_tokens": [], "crc": []}
            for row in b.to_pylist():
                ids, first = unpack(row["n_ids"], row["plane_sizes"], row["planes"]), row["first"]
                for d in row["docs"]:
                    end = d["start"] + d["n_tokens"]
                    upto = min(end, first + row["n_ids"])
                    crc = zlib.crc32(ids[max(0, d["start"] - first) : upto - first].tobytes())
                    for k, v in (("part", row["part"]), *d.items(), ("crc", crc_shifted(crc, 4 * (end - upto)) if upto < end else crc)):
                        rows[k].append(v)
            yield pa.RecordBatch.from_pydict(rows, schema=pa.schema([("part", pa.int32()), *[(c, pa.int64()) for c in ("doc_id", "start", "n_tokens", "crc")]]))

    blocks = spark.read.schema(SCHEMA).parquet(path)
    found = blocks.mapInArrow(pieces, schema).groupBy("part", "start").agg(F.max("doc_id").alias("doc_id"), F.max("n_tokens").alias("n_tokens"), F.bit_xor("crc").alias("ids_crc32"))
    totals = blocks.groupBy(F.col("part").alias("block")).agg(F.max(F.col("first") + F.col("n_ids")).alias("ids"))
    bases = before_blocks(totals, "ids").select(F.col("block").alias("part"), "ids_before")
    return found.join(bases, "part").select("doc_id", (F.col("start") + F.col("ids_before")).alias("start"), "n_tokens", "ids_crc32")


def token_rows(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Write all ids, read the files back: (doc_id, start, n_tokens, ids_crc32)."""
    path = new_path(docs.sparkSession, "token-planes")
    write_ids(docs, path, tokenizer)
    return read_documents(docs.sparkSession, path)
