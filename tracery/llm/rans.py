"""Token files in a static range asymmetric numeral system.

A corpus folder holds table.bin, one frequency for each id (all blocks share it), and one file for each
range of ascending document ids. A file is

    magic | blocks | block index | document table | footer

A block holds up to BLOCK ids as LANES interleaved streams: the lanes' first states (a checkpoint that
needs nothing before it), then 32-bit words in the order in which the lanes read them. The block index
gives each block's place, size, ids and crc32; the document table each document's id and length.
Any block can be decoded alone, so files are read by ranges of blocks: a range gives the documents that
begin in it, and goes on into the next blocks for the end of the last one.

A file has a name of its own for each attempt to write it, and only the names that a finished job reports
count: a lost attempt leaves a file that nobody reads, and it is deleted.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_path, run_arrow, scratch_path, stored, uncollected
from .tokens import word_tokens

MAGIC, LANES, BLOCK, TOGETHER = b"TRRANS01", 32, 1 << 16, 32
#: Blocks that one task decodes.
RANGE = 64
LOW = np.uint64(1 << 31)
#: Words whose ids a worker keeps.
WORDS = 400_000
FOOTER = struct.Struct("<QQQQ8s")
INDEX = np.dtype([("at", "<u8"), ("size", "<u4"), ("ids", "<u4"), ("crc", "<u4")])
DOCS = np.dtype([("doc_id", "<i8"), ("known", "<u4"), ("ids", "<u4")])


class Table:
    """Frequencies that sum to a power of two, every id that occurs at least one."""

    def __init__(self, counts: np.ndarray):
        used = int((counts > 0).sum())
        self.bits = max(14, min(22, int(np.ceil(np.log2(max(2, used)))) + 2))
        size = 1 << self.bits
        total = max(1, int(counts.sum()))
        f = np.where(counts > 0, np.maximum(1, (counts.astype(np.float64) * (size / total)).astype(np.int64)), 0)
        if not used:
            f[0] = size
        order = np.argsort(-f, kind="stable")
        over, k = int(f.sum()) - size, 0
        if over <= 0:
            f[order[0]] -= over
        while over > 0:  # taken from the most frequent ids, in proportion
            take = min(over, max(1, int(f[order[k]]) // 8), int(f[order[k]]) - 1)
            f[order[k]] -= take
            over -= take
            k = (k + 1) % used
        self.freq = f.astype(np.uint64)
        self.start = (np.cumsum(f) - f).astype(np.uint64)
        self.slot = np.repeat(np.arange(len(f), dtype=np.uint32), f)
        self.by_slot: tuple[np.ndarray, np.ndarray] | None = None

    def encode(self, ids: np.ndarray) -> list[bytes]:
        """Blocks of equally many ids: a (blocks, n) array, n a multiple of LANES."""
        blocks, n = ids.shape
        steps = np.ascontiguousarray(ids.reshape(blocks, n // LANES, LANES).transpose(1, 0, 2)).reshape(n // LANES, -1)
        state = np.full(steps.shape[1], LOW)
        words, out = np.empty(steps.shape, np.uint32), np.empty(steps.shape, bool)
        bits, shift = np.uint64(self.bits), np.uint64(63 - self.bits)
        for k in range(n // LANES - 1, -1, -1):
            freq = self.freq[steps[k]]
            np.greater_equal(state, freq << shift, out=out[k])
            words[k] = state & np.uint64(0xFFFFFFFF)
            state = np.where(out[k], state >> np.uint64(32), state)
            whole = state // freq
            state = (whole << bits) + (state - whole * freq) + self.start[steps[k]]
        state, words, out = state.reshape(blocks, LANES), words.reshape(-1, blocks, LANES), out.reshape(-1, blocks, LANES)
        return [state[b].astype("<u8").tobytes() + words[:, b][out[:, b]].astype("<u4").tobytes() for b in range(blocks)]

    def decode(self, blocks: list[bytes], n: int) -> np.ndarray:
        """The (blocks, n) ids of blocks of n ids."""
        if self.by_slot is None:  # each slot's frequency, and its place within its id's slots
            self.by_slot = self.freq[self.slot], np.arange(len(self.slot), dtype=np.uint64) - self.start[self.slot]
        freq, place = self.by_slot
        state = np.stack([np.frombuffer(b, "<u8", LANES) for b in blocks]).astype(np.uint64)
        words = [np.frombuffer(b, "<u4", offset=8 * LANES) for b in blocks]
        flat = np.concatenate([*words, np.zeros(LANES + 1, np.uint32)]).astype(np.uint64)
        at = np.cumsum([0, *map(len, words[:-1])])[:, None]
        out = np.empty((n // LANES, len(blocks), LANES), np.uint32)
        bits, mask = np.uint64(self.bits), np.uint64((1 << self.bits) - 1)
        for k in range(n // LANES):
            low = (state & mask).view(np.int64)
            out[k] = self.slot[low]
            state = freq[low] * (state >> bits) + place[low]
            need = state < LOW
            count = need.cumsum(1)
            state = np.where(need, (state << np.uint64(32)) | flat[np.minimum(at + count - need, len(flat) - 1)], state)
            at = at + count[:, -1:]
        if (state != LOW).any():
            raise ValueError("a block did not end in its first state")
        return out.transpose(1, 0, 2).reshape(len(blocks), n)


@uncollected
def _tokenize(batches: Iterator[pa.RecordBatch], tokenizer: str, end_id: int, bounds: np.ndarray, kind: str, vocabulary: int) -> Iterator[pa.RecordBatch]:
    """Each document's ids under its file's number; at the end, under -1, how often the task's documents hold each id."""
    names = ["bucket", "doc_id", "ids"]
    words, end = word_tokens(tokenizer, WORDS), end_id.to_bytes(4, "little")
    counts = np.zeros(vocabulary, np.int64)
    for batch in batches:
        ids = []
        for text in batch.column(1):
            own = np.frombuffer(words.ids(text.as_py()) + end, "<u4").astype(kind)
            ids.append(own.tobytes())
        counts += np.bincount(np.frombuffer(b"".join(ids), kind), minlength=vocabulary)
        key = batch.column(0).cast(pa.int64())
        bucket = np.searchsorted(bounds, key.fill_null(np.iinfo(np.int64).min).to_numpy(), side="right").astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(bucket), key, pa.array(ids, pa.binary())], names)
    yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([None], pa.int64()), pa.array([counts.astype("<i8").tobytes()], pa.binary())], names)


def _count(batches: Iterator[pa.RecordBatch], vocabulary: int) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(vocabulary, np.int64)
    for batch in batches:
        for one in batch.column(0).to_pylist():
            counts += np.frombuffer(one, "<i8")
    at = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], ["id", "n"])


class _Writer:
    """One file, under a name of its own."""

    def __init__(self, folder: str, bucket: int, table: Table):
        self.fs, base = fs.FileSystem.from_uri(folder)
        self.name = f"part-{bucket:05d}-{uuid.uuid4().hex}.rans"
        self.out, self.table, self.at = self.fs.open_output_stream(f"{base}/{self.name}"), table, len(MAGIC)
        self.out.write(MAGIC)
        self.index: list[tuple] = []
        self.docs: list[tuple] = []
        self.held: list[np.ndarray] = []
        self.n = self.total = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append((doc_id or 0, doc_id is not None, len(ids)))
        self.held.append(ids)
        self.n += len(ids)
        self.total += len(ids)
        if self.n >= BLOCK * TOGETHER:
            self._flush(BLOCK)

    def _flush(self, size: int) -> None:
        joined = np.concatenate(self.held) if self.held else np.zeros(0, np.uint32)
        whole = len(joined) // size * size
        for lo in range(0, whole, size * TOGETHER):
            self._write(joined[lo : min(whole, lo + size * TOGETHER)].reshape(-1, size), size)
        self.held, self.n = [joined[whole:]], len(joined) - whole

    def _write(self, ids: np.ndarray, n: int) -> None:
        for block in self.table.encode(ids):
            self.index.append((self.at, len(block), n, zlib.crc32(block)))
            self.out.write(block)
            self.at += len(block)

    def close(self) -> tuple[str, int, int, int]:
        self._flush(BLOCK)
        last = np.concatenate(self.held) if self.held else np.zeros(0, np.uint32)
        if len(last):  # padded with the first id that has a frequency
            pad = np.full(-len(last) % LANES, int(np.flatnonzero(self.table.freq)[0]), last.dtype)
            self._write(np.concatenate([last, pad]).reshape(1, -1), len(last))
        index, docs = np.array(self.index, INDEX).tobytes(), np.array(self.docs, DOCS).tobytes()
        self.out.write(index + docs)
        self.out.write(FOOTER.pack(self.at, len(self.index), len(self.docs), zlib.crc32(index + docs), MAGIC))
        self.out.close()
        return self.name, len(self.docs), self.total, len(self.index)


def _write_files(batches: Iterator[pa.RecordBatch], folder: str, table: Table, kind: str) -> Iterator[pa.RecordBatch]:
    writer, bucket, done = None, None, []
    for batch in batches:
        for b, doc_id, ids in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            if b != bucket:
                if writer:
                    done.append((bucket, *writer.close()))
                writer, bucket = _Writer(folder, b, table), b
            writer.add(doc_id, np.frombuffer(ids, kind).astype(np.uint32))
    if writer:
        done.append((bucket, *writer.close()))
    columns = list(zip(*done, strict=True)) if done else [()] * 5
    kinds = (pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64())
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["bucket", "file", "docs", "ids", "blocks"])


def read_file(uri: str, table: Table, first: int = 0, last: int | None = None) -> Iterator[tuple[int | None, int, np.ndarray]]:
    """(doc_id, place, ids) of each document of a file that begins in the blocks from first to before last.

    place counts the file's ids before the document. Checksums are checked; a few blocks are held at a time.
    """
    files, path = fs.FileSystem.from_uri(uri)
    with files.open_input_file(path) as f:
        size = f.size()
        f.seek(size - FOOTER.size)
        at, blocks, docs, crc, magic = FOOTER.unpack(f.read(FOOTER.size))
        f.seek(at)
        tail = f.read(size - FOOTER.size - at)
        if magic != MAGIC or zlib.crc32(tail) != crc:
            raise ValueError(f"{uri} is damaged")
        index = np.frombuffer(tail, INDEX, blocks)
        documents = np.frombuffer(tail, DOCS, docs, blocks * INDEX.itemsize)
        begin = np.concatenate([[0], np.cumsum(index["ids"].astype(np.int64))])
        places = np.cumsum(documents["ids"].astype(np.int64)) - documents["ids"]
        lo, hi = np.searchsorted(places, [begin[min(first, blocks)], begin[blocks if last is None else min(last, blocks)]]).tolist()
        held, have, done = [], 0, first
        last = blocks if last is None else min(last, blocks)
        skip = int(places[lo] - begin[first]) if lo < hi else 0
        for place, (doc_id, known, n) in zip(places[lo:hi].tolist(), documents[lo:hi].tolist(), strict=True):
            while have < skip + n:
                stop = last if done < last else done + -(-(skip + n - have) // BLOCK)  # beyond the range only what the last document needs
                group = index[done : min(done + TOGETHER, stop)]
                group = group[group["ids"] == group["ids"][0]]
                f.seek(int(group["at"][0]))
                got = [f.read(int(s)) for s in group["size"]]
                if any(zlib.crc32(x) != c for x, c in zip(got, group["crc"].tolist(), strict=True)):
                    raise ValueError(f"{uri}: a block is damaged")
                real = int(group["ids"][0])
                held.append(table.decode(got, -(-real // LANES) * LANES)[:, :real].reshape(-1))
                have += real * len(group)
                done += len(group)
            joined = held[0] if len(held) == 1 else np.concatenate(held)
            yield doc_id if known else None, place, joined[skip : skip + n]
            held, have, skip = [joined[skip + n :]], len(joined) - skip - n, 0


def _read_files(batches: Iterator[pa.RecordBatch], folder: str, table: Table) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "start", "n_tokens", "ids_crc32"]
    for batch in batches:
        for file, start, first in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            rows = []
            for doc_id, place, ids in read_file(f"{folder}/{file}", table, first, first + RANGE):
                rows.append((doc_id, start + place, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                if len(rows) == 10_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names)


def write_corpus(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 1, file_bytes: int = 16 << 20, max_files: int = 1 << 16) -> tuple[DataFrame, Table]:
    """Write all documents' ids in ascending doc_id order (nulls first) to folder; rows (bucket, file, docs, ids, blocks), and the table.

    The driver holds one count for each id of the vocabulary and one boundary for each file (at most max_files:
    1 TB of text in files of 16 MB; beyond that files grow longer, and are still read by ranges of blocks).
    Writers hold a few blocks at a time.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    size = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    files = int(min(max_files, max(1, size // file_bytes)))
    cuts = own.agg(F.percentile_approx("doc_id", [k / files for k in range(1, files)], max(10_000, 20 * files))).first()[0] if files > 1 else []
    bounds = np.unique(np.array(cuts or [], np.int64))
    vocabulary = max(word_tokens(tokenizer).whole.get_vocab_size(with_added_tokens=True), end_id + 1)
    kind = "<u2" if vocabulary <= 1 << 16 else "<u4"
    tokens, path = stored(run_arrow(own, _tokenize, "bucket int, doc_id long, ids binary", tokenizer=tokenizer, end_id=end_id, bounds=bounds, kind=kind, vocabulary=vocabulary), "ids")
    counts = np.zeros(vocabulary, np.int64)
    for r in run_arrow(tokens.where("bucket = -1").select("ids"), _count, "id long, n long", vocabulary=vocabulary).groupBy("id").agg(F.sum("n").alias("n")).collect():
        counts[r.id] = r.n
    table = Table(counts)
    files_fs, base = fs.FileSystem.from_uri(folder)
    files_fs.create_dir(base, recursive=True)
    with files_fs.open_output_stream(f"{base}/table.bin") as f:
        f.write(counts.astype("<u8").tobytes())
    ordered = tokens.where("bucket >= 0").repartition(max(1, len(bounds) + 1), "bucket").sortWithinPartitions("bucket", "doc_id", "ids")
    written, _ = stored(run_arrow(ordered, _write_files, "bucket int, file string, docs long, ids long, blocks long", folder=folder, table=table, kind=kind), "files")
    drop_path(docs.sparkSession, path)
    counted = {r.file for r in written.select("file").collect()}  # at most max_files rows
    for found in files_fs.get_file_info(fs.FileSelector(base)):
        if found.base_name.endswith(".rans") and found.base_name not in counted:
            files_fs.delete_file(found.path)
    return written, table


def read_corpus(written: DataFrame, folder: str, table: Table) -> DataFrame:
    """One row per document, read back from the files: doc_id, start, n_tokens, ids_crc32."""
    spark = written.sparkSession
    at, rows, ranges = 0, [], 0
    for r in written.orderBy("bucket").collect():  # at most max_files rows
        rows.append((r.file, at, r.blocks))
        at += r.ids
        ranges += -(-r.blocks // RANGE)
    files = spark.createDataFrame(rows, "file string, start long, blocks long")
    todo = files.select("file", "start", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1, F.lit(RANGE))).alias("first"))
    return run_arrow(todo.repartition(max(1, min(ranges, 1 << 16))), _read_files, "doc_id long, start long, n_tokens long, ids_crc32 long", folder=folder, table=table)


def token_files(docs: DataFrame, tokenizer: str, end_id: int = 1) -> DataFrame:
    """Write docs (doc_id, text; other columns are ignored) as token files in the shared folder and read them back.

    A null or empty text is the end id alone; a very long text spans blocks; rows that repeat an id stand
    beside each other by their ids, each with its own start; a null id comes first; no documents give no rows.
    """
    folder = scratch_path(docs.sparkSession, "corpus")
    written, table = write_corpus(docs, folder, tokenizer, end_id)
    return read_corpus(written, folder, table)
