"""Token-id shards as compressed wavelet matrices, written, and read back.

A shard file holds the token ids of consecutive documents (ascending doc_id): the sorted distinct ids, the
documents' ids and lengths, and one bit-plane for each bit of an id's place among the distinct ids. Plane by
plane the sequence is split stably into zeros and ones, so that ``access``, ``rank`` (counting) and ``select``
(occurrence lookup) each take one step a plane. A plane is stored in chunks of ``CHUNK`` bits; the file's directory has
the ones before each chunk and where it begins, and a chunk the ones before each of its ``BLOCK`` bits. Chunks and
directory are zstd frames of their own, so that a query decompresses the directory and a chunk or two a plane. Files are
rows of a Parquet table in the shared folder, as any store that Spark writes can hold them; a shard has at most
``SHARD_TOKENS`` tokens, or one document.

Documents are ordered by a range partitioning and a sort of each range; each range's texts are encoded and written as they
pass, so that a task holds one shard at most, whatever the number of rows of a doc_id or of a range.

Cases: a null text is empty and has only the end id. A null doc_id comes first. Rows that share a doc_id
follow each other in the order of their text's checksum. An empty table gives no rows."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from turnwright.llm.common import SUPER, as_documents, broadcast_if_small, prepared, text_slices, write_table
from turnwright.llm.tokens import encoder, production_path

MAGIC = b"WVM2"
BLOCK = 512
CHUNK = 1 << 18
END = 1
SHARD_TOKENS = 1 << 22
#: Documents of a range, about.
RANGE_ROWS = 4096
_NULL = np.iinfo(np.int64).min
_HEAD = "<4sQIIQI"


def build(ids: np.ndarray, doc_ids: np.ndarray, lengths: np.ndarray) -> bytes:
    """The file of one shard."""
    import zstandard

    squeeze = zstandard.ZstdCompressor(level=1).compress
    symbols = np.flatnonzero(np.bincount(ids)) if len(ids) else np.zeros(0, np.int64)
    place = np.zeros(int(symbols[-1]) + 1 if len(symbols) else 1, np.uint32)
    place[symbols] = np.arange(len(symbols))
    wide = len(symbols) > 1 << 16
    x = place[ids].astype(np.uint32 if wide else np.uint16)
    levels = (max(len(symbols), 1) - 1).bit_length()
    frames, before = [], []
    for k in range(levels - 1, -1, -1):
        ones = ((x >> k) & 1).astype(bool)
        bits = np.packbits(ones)
        count = np.bitwise_count(np.pad(bits, (0, -len(bits) % (BLOCK // 8))).reshape(-1, BLOCK // 8)).sum(1, dtype=np.int64)
        first = np.concatenate([[0], np.cumsum(count)])
        before.append(first[:: CHUNK // BLOCK] if len(count) % (CHUNK // BLOCK) else first[:-1][:: CHUNK // BLOCK])
        for c in range(0, len(count), CHUNK // BLOCK):
            inside = (first[c : min(c + CHUNK // BLOCK, len(count))] - first[c]).astype("<u4")
            frames.append(squeeze(inside.tobytes() + bits[c * BLOCK // 8 : (c * BLOCK + CHUNK) // 8].tobytes()))
        before.append(first[-1:])
        x = np.concatenate([x[~ones], x[ones]])
    sizes = np.array([len(f) for f in frames], "<i8")
    counts = np.concatenate(before) if before else np.zeros(0, np.int64)
    parts = [symbols.astype("<u4"), doc_ids.astype("<i8"), lengths.astype("<i8"), counts.astype("<i8"), sizes]
    directory = squeeze(b"".join(p.tobytes() for p in parts))
    head = struct.pack(_HEAD, MAGIC, len(ids), levels, len(symbols), len(doc_ids), len(directory))
    return b"".join([head, directory, *frames])


class WaveletMatrix:
    """A shard file, opened: chunks are decompressed when they are needed, and the last ``KEPT`` of them kept."""

    KEPT = 64

    def __init__(self, data: bytes):
        import zstandard

        self._open = zstandard.ZstdDecompressor().decompress
        magic, self.n, self.levels, n_symbols, n_docs, size = struct.unpack_from(_HEAD, data)
        if magic != MAGIC:
            raise ValueError("not a wavelet-matrix file")
        begin = struct.calcsize(_HEAD)
        raw, at = self._open(data[begin : begin + size]), 0
        chunks = -(-self.n // CHUNK)

        def take(kind: str, count: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(raw, kind, count, at)
            at += out.nbytes
            return out

        self.symbols = take("<u4", n_symbols)
        self.doc_ids, self.lengths = take("<i8", n_docs), take("<i8", n_docs)
        #: Ones before each chunk of a plane, and in all of it.
        self.before = take("<i8", self.levels * (chunks + 1)).reshape(self.levels, chunks + 1)
        sizes = take("<i8", self.levels * chunks)
        self._data, self._chunks = data, chunks
        self._begin = begin + size + np.concatenate([[0], np.cumsum(sizes)])
        self._kept: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        self.opened = 0

    def _chunk(self, level: int, c: int) -> tuple[np.ndarray, np.ndarray]:
        """Ones before each block of a chunk, and its bits."""
        found = self._kept.get((level, c))
        if found is None:
            if len(self._kept) >= self.KEPT:
                self._kept.pop(next(iter(self._kept)))
            i = level * self._chunks + c
            raw = self._open(self._data[self._begin[i] : self._begin[i + 1]])
            blocks = -(-min(CHUNK, self.n - c * CHUNK) // BLOCK)
            found = np.frombuffer(raw, "<u4", blocks), np.frombuffer(raw, "u1", offset=4 * blocks)
            self._kept[(level, c)] = found
            self.opened += 1
        return found

    def _zeros(self, level: int) -> int:
        return self.n - int(self.before[level][-1])

    def _rank1(self, level: int, i: int) -> int:
        """Ones among the first i bits of a plane."""
        c, rest = divmod(i, CHUNK)
        if not rest:
            return int(self.before[level][c])
        ones, bits = self._chunk(level, c)
        block, rest = divmod(rest, BLOCK)
        if not rest and block < len(ones):
            return int(self.before[level][c]) + int(ones[block])
        if not rest:
            block, rest = block - 1, BLOCK
        first = block * BLOCK // 8
        some = np.unpackbits(bits[first : first + -(-rest // 8)], count=rest)
        return int(self.before[level][c]) + int(ones[block]) + int(some.sum(dtype=np.int64))

    def _bit(self, level: int, i: int) -> int:
        c, rest = divmod(i, CHUNK)
        return int(self._chunk(level, c)[1][rest // 8]) >> (7 - rest % 8) & 1

    def access(self, i: int) -> int:
        """The token at position i."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        code = 0
        for level in range(self.levels):
            bit = self._bit(level, i)
            code = code << 1 | bit
            ones = self._rank1(level, i)
            i = self._zeros(level) + ones if bit else i - ones
        return int(self.symbols[code])

    def _code(self, token: int) -> int | None:
        at = int(np.searchsorted(self.symbols, token))
        return at if at < len(self.symbols) and self.symbols[at] == token else None

    def _descend(self, code: int, i: int) -> tuple[int, int]:
        """Where the code's run begins on the last level, and where the first i tokens' copies of it end."""
        first, last = 0, i
        for level in range(self.levels):
            a, b = self._rank1(level, first), self._rank1(level, last)
            one = code >> (self.levels - 1 - level) & 1
            first, last = (self._zeros(level) + a, self._zeros(level) + b) if one else (first - a, last - b)
        return first, last

    def rank(self, token: int, i: int) -> int:
        """How many of the first i tokens are ``token``."""
        code = self._code(token)
        if code is None:
            return 0
        first, last = self._descend(code, min(max(i, 0), self.n))
        return last - first

    def count(self, token: int) -> int:
        return self.rank(token, self.n)

    def select(self, token: int, k: int) -> int:
        """Position of the k-th occurrence (from 0) of ``token``; -1 if there are not so many."""
        code = self._code(token)
        if code is None or k < 0:
            return -1
        first, last = self._descend(code, self.n)
        if first + k >= last:
            return -1
        at = first + k
        for level in range(self.levels - 1, -1, -1):
            one = code >> (self.levels - 1 - level) & 1
            rank = at - self._zeros(level) if one else at
            at = self._select_bit(level, one, rank)
        return at

    def _select_bit(self, level: int, one: int, k: int) -> int:
        """Position of the k-th bit (from 0) of a kind in a plane, through the counts of chunks and blocks."""
        starts = np.arange(self._chunks) * CHUNK
        before = self.before[level][:-1] if one else starts - self.before[level][:-1]
        c = int(np.searchsorted(before, k, side="right")) - 1
        k -= int(before[c])
        ones, bits = self._chunk(level, c)
        inside = ones if one else np.arange(len(ones)) * BLOCK - ones.astype(np.int64)
        block = int(np.searchsorted(inside, k, side="right")) - 1
        first = c * CHUNK + block * BLOCK
        some = np.unpackbits(bits[block * BLOCK // 8 : (block + 1) * BLOCK // 8], count=min(BLOCK, self.n - first))
        return first + int(np.flatnonzero(some == one)[k - int(inside[block])])

    def _plane(self, level: int) -> np.ndarray:
        out = []
        for c in range(self._chunks):
            i = level * self._chunks + c
            blocks = -(-min(CHUNK, self.n - c * CHUNK) // BLOCK)
            out.append(np.frombuffer(self._open(self._data[self._begin[i] : self._begin[i + 1]]), "u1", offset=4 * blocks))
        return np.unpackbits(np.concatenate(out), count=self.n).view(bool)

    def decode(self) -> np.ndarray:
        """All tokens, from the last plane up."""
        kind = np.uint32 if len(self.symbols) > 1 << 16 else np.uint16
        x = np.zeros(self.n, kind)
        for k in range(self.levels):
            ones = self._plane(self.levels - 1 - k)
            out = np.empty(self.n, kind)
            zeros = self.n - int(np.count_nonzero(ones))
            out[~ones] = x[:zeros]
            out[ones] = x[zeros:] | kind(1 << k)
            x = out
        return self.symbols[x] if len(self.symbols) else np.zeros(0, np.uint32)


def _files(documents: Iterator[tuple[int | None, bytes]], most: int) -> Iterator[tuple[int, int, bytes]]:
    """(documents, tokens, file) of runs of documents of at most ``most`` tokens."""

    def made() -> tuple[int, int, bytes]:
        tokens = np.frombuffer(b"".join(ids), "<u4")
        counts = np.array([len(x) // 4 for x in ids], np.int64)
        return len(ids), len(tokens), build(tokens, np.array([_NULL if d is None else d for d in names], np.int64), counts)

    names: list[int | None] = []
    ids: list[bytes] = []
    size = 0
    for name, raw in documents:
        n = len(raw) // 4
        if ids and size + n > most:
            yield made()
            names, ids, size = [], [], 0
        names.append(name)
        ids.append(raw)
        size += n
    if ids:
        yield made()


def write_shards(docs: DataFrame, path: str | None = None, end: int = END, most: int = SHARD_TOKENS) -> DataFrame:
    """Written table of shard files: shard, file, documents, tokens, data. Shards and files are in the order of doc_id."""
    path = path or production_path()
    base = as_documents(docs, "doc_id", "text")
    prepared(docs.sparkSession)
    ranges = max(1, base.count() // RANGE_ROWS)
    # Rows that share a doc_id, or repeat, need not share a range.
    keyed = base.select("doc_id", F.crc32(F.col("text").cast("binary")).alias("tie"), F.monotonically_increasing_id().alias("at"), "text")
    order = [F.col("doc_id").asc_nulls_first(), F.col("tie").asc_nulls_first(), F.col("at")]
    placed = keyed.repartitionByRange(ranges, *order).sortWithinPartitions(*order).select("doc_id", "text")

    def write(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        enc = encoder(path)

        def documents():
            for b in batches:
                texts = [t or "" for t in b.column("text").to_pylist()]
                names = b.column("doc_id").to_pylist()
                for s in text_slices(texts):
                    yield from zip(names[s], enc.encode(texts[s], end))

        shard = TaskContext.get().partitionId()
        for number, (count, tokens, data) in enumerate(_files(documents(), most)):
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
            row = (shard, number, count, tokens, data)
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], names=["shard", "file", "documents", "tokens", "data"])

    files = placed.mapInArrow(write, "shard int, file int, documents long, tokens long, data binary")
    return write_table(files, "wavelet-shards", "none")


def file_starts(files: DataFrame) -> DataFrame:
    """shard, file and begin, the tokens before each file: running sums in three steps, none of them over all files."""
    sizes = files.select("shard", "file", "tokens", F.floor(F.col("shard") / SUPER).alias("super"))
    upto = lambda key, order: Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    running = lambda value, key, order: F.coalesce(F.sum(value).over(upto(key, order)), F.lit(0))
    shards = sizes.groupBy("super", "shard").agg(F.sum("tokens").alias("n"))
    supers = shards.groupBy("super").agg(F.sum("n").alias("n")).withColumn("all", F.lit(0))  # one row for SUPER shards
    supers = supers.select("super", running("n", "all", "super").alias("c"))
    shards = shards.select("super", "shard", running("n", "super", "shard").alias("b"))
    inner = sizes.select("super", "shard", "file", running("tokens", "shard", "file").alias("a"))
    out = inner.join(shards, ["super", "shard"]).join(supers, "super")
    return out.select("shard", "file", (F.col("a") + F.col("b") + F.col("c")).cast("long").alias("begin"))


def read_shards(files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the files."""
    def read(batches):
        import pyarrow as pa

        for b in batches:
            for data, begin in zip(b.column("data"), b.column("begin").to_pylist()):
                w = WaveletMatrix(data.as_py())
                raw = w.decode().astype("<u4").tobytes()
                ends = np.cumsum(w.lengths)
                starts = ends - w.lengths
                crc = [zlib.crc32(raw[i:j]) for i, j in zip((starts * 4).tolist(), (ends * 4).tolist())]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(w.doc_ids, pa.int64(), mask=w.doc_ids == _NULL),
                        pa.array(starts + begin),
                        pa.array(w.lengths),
                        pa.array(crc, pa.int64()),
                    ],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    begins = broadcast_if_small(write_table(file_starts(files), "wavelet-starts"), files.count())
    placed = files.join(begins, ["shard", "file"]).select("data", "begin")
    return placed.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")
