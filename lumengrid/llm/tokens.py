"""Token-ID output: flat unsigned integer files with 64-bit offsets.

Documents are range-partitioned and sorted by doc_id; each task encodes whole
texts and writes three files: the ids (the narrowest unsigned type that holds
the vocabulary), the local start of every document (int64, one more at the
end) and the doc_ids.  A file's name is its attempt's own, and only files of
committed tasks enter the manifest, so retries leave no trace.  A partition's
base is the prefix sum of the totals before it, kept in the manifest; start =
base + local start.  Readers map the files into memory where the folder is
local to them, and read them through Arrow's file systems elsewhere.

Encoding: a text is cut before single spaces that begin a pre-token anyway,
so its pieces encode independently; each worker encodes a distinct piece once
and gathers the ids of whole slices with array operations.  Pieces are looked
up by hash and compared byte for byte before their ids are used.  A text that
holds a special token's string is encoded by the library as a whole.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import textkernel as K
from .common import scratch_path, ship

END = 2
#: Pieces a worker remembers, and ids of all of them, before it starts anew.
CACHE_PIECES, CACHE_IDS = 1_500_000, 8_000_000
NULL_ID = -(1 << 63)
#: Bytes of text of a partition, about; small inputs take the session's number of partitions.
PART_BYTES = 256 << 20

#: Bytes after a space that surely begin a pre-token with it: printable ASCII
#: and the leads of characters none of which is white space.
_JOINS = np.zeros(256, bool)
_JOINS[0x21:0x7F] = True
_JOINS[0xC3:0xF5] = True
_JOINS[[0xE1, 0xE2, 0xE3]] = False


class PieceEncoder:
    """encode(data, offsets) -> (ids of all texts, number of ids of each)."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.reset()

    def reset(self) -> None:
        self.keys, self.row = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.start, self.ids = np.zeros(1, np.int64), np.zeros(0, self.dtype)
        self.size, self.head = np.zeros(0, np.int64), np.zeros((2, 0), np.uint64)  # bytes of a piece; its first sixteen
        self.tail: dict[int, bytes] = {}  # the rest of longer pieces

    def _ids(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        got = self.tokenizer.encode(pieces, is_pretokenized=True, add_special_tokens=False)
        ids = np.asarray(got.ids, self.dtype)
        return ids, np.bincount(np.asarray(got.word_ids, np.int64), minlength=len(pieces)) if len(ids) else np.zeros(len(pieces), np.int64)

    def _learn(self, keys: np.ndarray, raw: list[bytes], size: np.ndarray, head: np.ndarray) -> None:
        ids, count = self._ids([x.decode("utf-8", "replace") for x in raw])
        row = np.arange(len(raw)) + len(self.size)
        self.tail.update((int(r), x[16:]) for r, x in zip(row, raw) if len(x) > 16)
        self.row = np.r_[self.row, row]
        self.start = np.r_[self.start, self.start[-1] + np.cumsum(count)]
        self.ids, self.size, self.head = np.r_[self.ids, ids], np.r_[self.size, size], np.c_[self.head, head]
        self.keys = np.r_[self.keys, keys]
        order = np.argsort(self.keys)
        self.keys, self.row = self.keys[order], self.row[order]

    def _other(self, row: np.ndarray, raw: bytes, begin: np.ndarray, size: np.ndarray, head: np.ndarray) -> np.ndarray:
        """Pieces that aren't what their row holds, byte for byte."""
        bad = (self.size[row] != size) | (self.head[0][row] != head[0]) | (self.head[1][row] != head[1])
        for k in np.flatnonzero(~bad & (size > 16)):
            a = int(begin[k])
            bad[k] = raw[a + 16 : a + int(size[k])] != self.tail[int(row[k])]
        return np.flatnonzero(bad)

    def encode(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        raw = data.tobytes()
        if not any(s in raw for s in self.special):
            return self._pieces(data, raw, offs)
        # Runs of texts without a special token's string go as before; the others one by one.
        alone = [any(s in raw[a:b] for s in self.special) for a, b in zip(offs[:-1].tolist(), offs[1:].tolist())]
        ids, sizes, i, n = [], [], 0, len(alone)
        while i < n:
            j = i + 1
            if alone[i]:
                got = np.asarray(self.tokenizer.encode(raw[offs[i] : offs[j]].decode("utf-8", "replace"), add_special_tokens=False).ids, self.dtype)
                size = np.array([len(got)])
            else:
                while j < n and not alone[j]:
                    j += 1
                got, size = self._pieces(data[offs[i] : offs[j]], raw[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
            ids.append(got)
            sizes.append(size)
            i = j
        return np.concatenate(ids), np.concatenate(sizes)

    def _pieces(self, data: np.ndarray, raw: bytes, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(data)
        if not n:
            return np.zeros(0, self.dtype), np.zeros(len(offs) - 1, np.int64)
        cut = np.zeros(n, bool)
        cut[:-1] = (data[:-1] == 0x20) & _JOINS[data[1:]]
        last = offs[1:][np.diff(offs) > 0] - 1
        cut[last] = False  # a last space joins nothing
        cut[offs[:-1][np.diff(offs) > 0]] = True
        begin = np.flatnonzero(cut)
        end = np.r_[begin[1:], n]
        size, chunks = end - begin, K.chunk_view(data)
        head = np.stack([chunks[begin] & K._LOW[np.minimum(size, 8)], chunks[np.minimum(begin + 8, n)] & K._LOW[np.clip(size - 8, 0, 8)]])
        key = K.byte_hashes(data, begin, end)
        uniq, first, inverse = np.unique(key, return_index=True, return_inverse=True)
        if len(self.keys) > CACHE_PIECES or len(self.ids) > CACHE_IDS:
            self.reset()
        at = np.minimum(np.searchsorted(self.keys, uniq), max(len(self.keys) - 1, 0))
        new = np.flatnonzero(self.keys[at] != uniq) if len(self.keys) else np.arange(len(uniq))
        if len(new):
            f = first[new]
            self._learn(uniq[new], [raw[a:b] for a, b in zip(begin[f].tolist(), end[f].tolist())], size[f], head[:, f])
            at = np.searchsorted(self.keys, uniq)
        row = self.row[at][inverse]
        count, bad = self.start[row + 1] - self.start[row], self._other(row, raw, begin, size, head)
        ids, extra = self.ids, self.start[row]
        if len(bad):  # another piece of the same hash: encoded here, not remembered
            more, count[bad] = self._ids([raw[a:b].decode("utf-8", "replace") for a, b in zip(begin[bad].tolist(), end[bad].tolist())])
            extra[bad] = len(ids) + np.cumsum(count[bad]) - count[bad]
            ids = np.r_[ids, more]
        stop = np.cumsum(count)
        out = ids[np.arange(stop[-1]) + np.repeat(extra - (stop - count), count)]
        ends = np.r_[0, stop][np.searchsorted(begin, offs)]
        return out, np.diff(ends)


_encoders: dict[str, PieceEncoder] = {}


def encoder_of(path: str) -> PieceEncoder:
    """The worker's encoder for a vocabulary file, with what it has learnt so far."""
    if path not in _encoders:
        _encoders.clear()
        _encoders[path] = PieceEncoder(path)
    return _encoders[path]


def with_ends(ids: np.ndarray, sizes: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Puts the end id behind each document's ids."""
    stop = np.cumsum(sizes)
    return np.insert(ids, stop, end), sizes + 1


def _open(folder: str):
    return arrow_fs.FileSystem.from_uri(folder)


def write_tokens(docs: DataFrame, tokenizer: str, folder: str | None = None, end: int = END) -> str:
    """Encodes every whole text in ascending doc_id order; returns the folder.

    Null texts are empty (only the end id).  Null doc_ids come first; rows of
    one doc_id are ordered by a hash of the text, then the text, so that even
    they can be dealt over partitions; repeated rows are all written.  An empty
    table writes an empty manifest.  Other columns are ignored.
    """
    spark = docs.sparkSession
    ship(spark)
    folder = folder or scratch_path(spark, "tokens")

    @K.tidy
    def write(batches):
        files, path = _open(folder)
        files.create_dir(path, recursive=True)
        name = uuid.uuid4().hex
        encoder = out = None
        starts, ids, total = [np.zeros(1, np.int64)], [], 0
        for batch in batches:
            if out is None:
                encoder = encoder_of(tokenizer)
                out = files.open_output_stream(f"{path}/tokens-{name}.bin")
            data, offs = K.string_buffer(batch.column(1))
            for i, j in K.slices(offs, 4 << 20):
                got, sizes = with_ends(*encoder.encode(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]), end)
                out.write(got.astype(encoder.dtype, copy=False).tobytes())
                starts.append(total + np.cumsum(sizes))
                total = int(starts[-1][-1])
            ids.append(batch.column(0).cast(pa.int64()).fill_null(NULL_ID).to_numpy())
        if out is not None:
            out.close()
            every = np.concatenate(starts).astype("<i8")
            for kind, values in (("offsets", every), ("ids", np.concatenate(ids).astype("<i8"))):
                with files.open_output_stream(f"{path}/{kind}-{name}.bin") as f:
                    f.write(values.tobytes())
            part = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([part], pa.int32()), pa.array([len(every) - 1], pa.int64()), pa.array([total], pa.int64()), pa.array([encoder.dtype.itemsize], pa.int32())], names=["file", "part", "docs", "tokens", "width"])

    size = docs.select(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // PART_BYTES))
    order = ["doc_id", "_h", "text"]
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("_h")).repartitionByRange(parts, "doc_id", "_h").sortWithinPartitions(*order).select("doc_id", "text")
    manifest = ordered.mapInArrow(write, "file string, part int, docs long, tokens long, width int")
    # Ranges follow the order, so the partition's number orders the files; one row a file.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    path = f"{folder}/manifest-parts"
    manifest.write.parquet(path)
    spark.read.parquet(path).withColumn("base", F.coalesce(F.sum("tokens").over(before), F.lit(0))).write.parquet(f"{folder}/manifest")
    return folder


class _Numbers:
    """A file of numbers, mapped where it is local and read by ranges elsewhere."""

    def __init__(self, files, path: str, dtype: str):
        self.dtype = np.dtype(dtype)
        self.map = np.frombuffer(pa.memory_map(path).read_buffer(), self.dtype) if isinstance(files, arrow_fs.LocalFileSystem) else None
        self.file = None if self.map is not None else files.open_input_file(path)

    def read(self, a: int, b: int) -> np.ndarray:
        if self.map is not None:
            return self.map[a:b]
        w = self.dtype.itemsize
        return np.frombuffer(self.file.read_at((b - a) * w, a * w), self.dtype)


def read_tokens(spark: SparkSession, folder: str, block: int = 1000) -> DataFrame:
    """One row per document from the files: doc_id, start, n_tokens, ids_crc32.

    A task holds ``block`` documents at a time.  An empty manifest gives no rows.
    """
    ship(spark)

    @K.tidy
    def read(batches):
        files, path = _open(folder)
        for batch in batches:
            for row in batch.to_pylist():
                ids, starts, tokens = (_Numbers(files, f"{path}/{kind}-{row['file']}.bin", dtype) for kind, dtype in (("ids", "<i8"), ("offsets", "<i8"), ("tokens", f"<u{row['width']}")))
                for a in range(0, row["docs"], block):
                    b = min(a + block, row["docs"])
                    own, at = ids.read(a, b), starts.read(a, b + 1)
                    values, low = tokens.read(int(at[0]), int(at[-1])), at - at[0]
                    crc = [zlib.crc32(values[s:e].astype("<u4").tobytes()) for s, e in zip(low[:-1].tolist(), low[1:].tolist())]
                    doc = pa.array(own, pa.int64(), mask=own == NULL_ID)
                    yield pa.RecordBatch.from_arrays([doc, pa.array(at[:-1] + row["base"]), pa.array(np.diff(at)), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    manifest = spark.read.parquet(f"{folder}/manifest")
    parts = max(1, min(manifest.count(), 10 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    return manifest.repartition(parts).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")
