"""Token ids of whole texts in files of independent zstandard frames with a trailing seek table.

A file is a row of zstandard frames of ``frame`` ids each (the last one may hold fewer), a skippable frame with the
documents of the file (id and number of ids of each), and a seek table in zstandard's published seekable format: sizes of
every frame before and after decompression and the low half of the XXH64 of its contents. Any zstandard tool reads such a
file as one stream; a reader of some documents reads the table, the list of documents and the frames they lie in, and
checks those frames' sums.

Files are a Spark data source, ``FORMAT``: tasks write files of names of their own, the driver's commit publishes a list of
one line for each file, so what lost or repeated tasks wrote is never read. Files hold ascending ranges of (doc_id, hash of
the text); a commit whose ranges overlap fails.

Texts are dealt by ranges of (doc_id, hash), so that many rows of one id, or without one, take several tasks; then encoded
and written as a stream: a task holds a frame, a batch and 17 bytes for each of its documents. Encoding cuts
texts of Latin letters, digits and ASCII marks into pre-tokens and asks the BPE model of the tokenizers library once for each
that isn't in a bounded cache; other texts are cut at spaces and line feeds, which no token of this vocabulary crosses, and
the library's whole pipeline is asked for the chunks that aren't of such characters.

Null and empty texts are the end id alone; texts of any length are read whole; an empty table gives no file and no row.
Null ids come first. Repeated rows are written once each, in an order of their own; rows of one id go by their texts'
hashes. Other columns aren't read.
"""

from __future__ import annotations

import json
import re
import struct
import uuid
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from .bytetext import LOWER, slices, utf8

FORMAT = "seekable_ids"
# Fixed values of the published formats: skippable frames, seek table, its flag for checksums and its footer.
SKIPPABLE, TABLE, CHECKSUMS, FOOTER = 0x184D2A5D, 0x184D2A5E, 0x80, 0x8F92EAB1
LIST = "_files.json"
_ENCODERS: dict[tuple[str, int], Chunks] = {}
_PLAIN = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ0-9!-&(-/:-@\\[-`{-~]+")
_PARTS = re.compile("[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")
_KIND = np.full(256, 3, np.uint8)  # of bytes in lower case: white space, letters, digits, marks
_KIND[[9, 10, 11, 12, 13, 32]] = 0
_KIND[97:123] = _KIND[128:] = 1
_KIND[48:58] = 2
_LOOK = np.zeros(256, bool)  # bytes that may be in no plain text: control characters, others than ASCII, apostrophes, <
_LOOK[:32] = _LOOK[127:] = _LOOK[[0x27, 0x3C]] = True
_LOOK[[9, 10, 11, 12, 13]] = False
_SHORT = np.zeros(256, bool)  # first letters of what follows an apostrophe in a pre-token of its own
_SHORT[np.frombuffer(b"strvmldSTRVMLD", np.uint8)] = True


class Chunks:
    """Ids of texts as unsigned 32-bit bytes, by a word-level BPE file of the tokenizers library whose pre-tokens hold no white space."""

    def __init__(self, path: str, most: int = 300_000):
        from tokenizers import Tokenizer

        self.all = Tokenizer.from_file(path)
        self.model, self.most = self.all.model, most
        self.chunks: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in set(shown)]
        self.shown = {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}

    def _part(self, part: str) -> bytes:
        """Ids of one pre-token in lower case."""
        ids = self.parts.get(part)
        if ids is None:
            shown = part if part.isascii() else part.encode().decode("latin-1").translate(self.shown)
            found = [t.id for t in self.model.tokenize(shown)]
            ids = self.parts[part] = struct.pack(f"<{len(found)}I", *found)
        return ids

    def learn(self, chunks: set[str]) -> None:
        """Common chunks and parts came first, so the later half of a full cache goes."""
        if len(self.chunks) + len(chunks) > self.most:
            self.chunks = dict(islice(self.chunks.items(), self.most // 2))
        other = []
        for c in chunks:
            if _PLAIN.fullmatch(c) and "<|" not in c:
                low = c.lower()
                self.chunks[c] = self._part(low) if low.isalpha() else b"".join([self._part(p) for p in _PARTS.findall(low)])
            else:
                other.append(c)
        for k in range(0, len(other), 5000):
            some = other[k : k + 5000]
            for c, e in zip(some, self.all.encode_batch_fast(some, add_special_tokens=False), strict=True):
                self.chunks[c] = np.array(e.ids, "<u4").tobytes()

    def batch(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, the end id after each, and how many each has."""
        ok = plain(*utf8(texts))
        if ok.all():
            ids, lengths = self.by_parts(texts)
        else:
            (a, n), (b, m) = self.by_parts(texts.filter(pa.array(ok))), self.by_chunks(texts.filter(pa.array(~ok)))
            ids, lengths = np.concatenate([a, b]), np.concatenate([n, m])
            order = np.argsort(np.concatenate([np.flatnonzero(ok), np.flatnonzero(~ok)]))
            ids, lengths = ids[ragged((np.cumsum(lengths) - lengths)[order], lengths[order])], lengths[order]
        return np.insert(ids, np.cumsum(lengths), end).astype("<u4"), lengths + 1

    def by_parts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Texts of plain characters: cut into pre-tokens in numpy and told apart in Arrow, so that Python sees the distinct
        ones of a batch only."""
        data, offsets = utf8(texts)
        low = LOWER[data]
        second = np.flatnonzero(data[:-1] == 0xC3) + 1
        low[second[data[second] < 0x9F]] += 32
        kind = _KIND[low]
        solid = kind > 0
        head = solid.copy()
        head[1:] &= (kind[1:] != kind[:-1]) | (kind[1:] == 2)
        firsts = offsets[:-1][offsets[:-1] < offsets[1:]]
        head[firsts] = solid[firsts]
        starts = np.flatnonzero(head)
        before = np.cumsum(solid, dtype=np.int32)
        cuts = np.append(before[starts] - 1, before[-1:]).astype(np.int32)
        found = pa.StringArray.from_buffers(len(starts), pa.py_buffer(cuts), pa.py_buffer(low[solid])).dictionary_encode()
        names = found.dictionary.to_pylist()
        if len(self.parts) + len(names) > self.most:
            self.parts = dict(islice(self.parts.items(), self.most // 2))  # common parts came first
        ids = [self._part(n) if x is None else x for n, x in zip(names, map(self.parts.get, names), strict=True)]
        return spelled(found.indices.to_numpy(), ids, np.diff(np.searchsorted(starts, offsets)))

    def by_chunks(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Any texts: chunks between spaces and line feeds."""
        split = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        found = split.flatten().dictionary_encode()
        names = found.dictionary.to_pylist()
        ids = list(map(self.chunks.get, names))
        fresh = {n for n, x in zip(names, ids, strict=True) if x is None}
        if fresh:
            self.learn(fresh)
            ids = [self.chunks[n] if x is None else x for n, x in zip(names, ids, strict=True)]
        return spelled(found.indices.to_numpy(), ids, pc.list_value_length(split).to_numpy())


def plain(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Which texts have only white space, ASCII marks, digits and Latin letters up to U+00FF, no word with an apostrophe that is a
    pre-token of its own, and no special token."""
    at = np.flatnonzero(_LOOK[data])
    own, before, after = data[at], np.where(at > 0, data[at - 1], 0), data[np.minimum(at + 1, len(data) - 1)]
    latin = (own == 0xC3) | (own >= 0x80) & (before == 0xC3) & (own != 0x97) & (own != 0xB7)
    fine = np.where(own >= 0x80, latin, (own == 0x27) & ~_SHORT[after] | (own == 0x3C) & (after != 0x7C))
    ok = np.ones(len(offsets) - 1, bool)
    ok[np.searchsorted(offsets, at[~fine], "right") - 1] = False
    return ok


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places of rows of a flat array, one after another."""
    upto = np.cumsum(lengths)
    return np.repeat(starts - upto + lengths, lengths) + np.arange(upto[-1] if len(upto) else 0)


def spelled(code: np.ndarray, ids: list[bytes], lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all codes, and how many of them each row of so many codes has."""
    flat, sizes = np.frombuffer(b"".join(ids), "<u4"), np.fromiter(map(len, ids), np.int64, len(ids)) // 4
    upto = np.append(0, np.cumsum(sizes[code]))
    return flat[ragged((np.cumsum(sizes) - sizes)[code], sizes[code])], np.diff(upto[np.cumsum(lengths)], prepend=0)


def blobs(ids: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """A binary column of so many ids each, without a copy."""
    ends = np.append(0, np.cumsum(lengths)).astype(np.int64) * ids.itemsize
    return pa.Array.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(ends), pa.py_buffer(ids)]).cast(pa.binary())


def encoder(path: str, most: int = 300_000) -> Chunks:
    """One for each Python worker."""
    if (path, most) not in _ENCODERS:
        _ENCODERS[path, most] = Chunks(path, most)
    return _ENCODERS[path, most]


def encode(docs: DataFrame, path: str, end: int) -> DataFrame:
    """doc_id, key and ids (little-endian unsigned 32-bit, with the end id) of every document, in ranges of (doc_id, key)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in batches:
            _, offsets = utf8(batch.column(2))
            for i, j in slices(offsets, 1 << 22):
                part = batch.slice(i, j - i)
                ids, lengths = own.batch(part.column(2), end)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), blobs(ids, lengths)], names=["doc_id", "key", "ids"])

    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    dealt = docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), F.xxhash64(text).alias("key"), text.alias("text")).repartitionByRange("doc_id", "key").sortWithinPartitions("doc_id", "key")
    return dealt.mapInArrow(run, "doc_id bigint, key bigint, ids binary")


def _open(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", folder))


class Frames:
    """Writes one file."""

    def __init__(self, out: pa.NativeFile, frame: int, width: int):
        self.out, self.frame, self.kind = out, frame, np.dtype(f"<u{width}")
        self.zip = zstandard.ZstdCompressor(level=3, write_checksum=True, write_content_size=True)
        self.table: list[tuple[int, int, int]] = []
        self.held: list[np.ndarray] = []
        self.size = self.tokens = 0
        self.docs: list[tuple[pa.Array, np.ndarray]] = []

    def _put(self, raw: bytes, size: int, of: bytes) -> None:
        self.out.write(raw)
        self.table.append((len(raw), size, xxhash.xxh64_intdigest(of) & 0xFFFFFFFF))

    def _cut(self, all_: bool) -> None:
        ids = np.concatenate(self.held) if self.held else np.zeros(0, self.kind)
        upto = len(ids) if all_ else len(ids) // self.frame * self.frame
        for i in range(0, upto, self.frame):
            raw = ids[i : min(i + self.frame, upto)].tobytes()
            self._put(self.zip.compress(raw), len(raw), raw)
        self.held, self.size = [ids[upto:]], len(ids) - upto

    def add(self, doc_ids: pa.Array, ids: np.ndarray, lengths: np.ndarray) -> None:
        if len(ids) and int(ids.max()) > np.iinfo(self.kind).max:
            raise ValueError(f"an id is larger than {self.kind.itemsize} bytes hold")
        self.docs.append((doc_ids, lengths))
        self.held.append(ids.astype(self.kind))
        self.size += len(ids)
        self.tokens += len(ids)
        if self.size >= self.frame:
            self._cut(False)

    def close(self) -> None:
        self._cut(True)
        doc_ids, lengths = pa.chunked_array([d for d, _ in self.docs], pa.int64()), np.concatenate([n for _, n in self.docs])
        given = doc_ids.is_valid().to_numpy()
        listed = struct.pack("<BQ", self.kind.itemsize, len(lengths)) + doc_ids.fill_null(0).to_numpy().astype("<i8").tobytes() + lengths.astype("<u8").tobytes() + given.astype(np.uint8).tobytes()
        listed = self.zip.compress(listed)
        self._put(struct.pack("<II", SKIPPABLE, len(listed)) + listed, 0, b"")
        rows = np.array(self.table, "<u4").tobytes()
        self.out.write(struct.pack("<II", TABLE, len(rows) + 9) + rows + struct.pack("<IBI", len(self.table), CHECKSUMS, FOOTER))


class Seekable:
    """Reads one file: its documents at once, ids only of the frames asked for."""

    def __init__(self, file: pa.NativeFile):
        self.file, size = file, file.size()
        n, flags, magic = struct.unpack("<IBI", file.read_at(9, size - 9))
        if magic != FOOTER or flags != CHECKSUMS:
            raise ValueError("no seek table with checksums at the end of the file")
        self.table = np.frombuffer(file.read_at(12 * n, size - 9 - 12 * n), "<u4").reshape(n, 3)
        self.at = np.append(0, np.cumsum(self.table[:, 0], dtype=np.int64))
        self.read = 0  # frames decompressed
        raw = file.read_at(int(self.table[-1, 0]) - 8, int(self.at[-2]) + 8)
        listed = zstandard.ZstdDecompressor().decompress(raw)
        width, docs = struct.unpack_from("<BQ", listed)
        self.kind = np.dtype(f"<u{width}")
        self.doc_id, self.length = np.frombuffer(listed, "<i8", docs, 9), np.frombuffer(listed, "<u8", docs, 9 + 8 * docs).astype(np.int64)
        self.given = np.frombuffer(listed, np.uint8, docs, 9 + 16 * docs).astype(bool)
        self.start = np.append(0, np.cumsum(self.length))
        self.first = np.append(0, np.cumsum(self.table[:-1, 1], dtype=np.int64) // width)  # of each frame

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids of these places as unsigned 32-bit numbers."""
        if start >= stop:
            return np.zeros(0, "<u4")
        a, b = int(np.searchsorted(self.first, start, "right")) - 1, int(np.searchsorted(self.first, stop, "left"))
        raw, out = self.file.read_at(int(self.at[b] - self.at[a]), int(self.at[a])), []
        for k in range(a, b):
            got = zstandard.ZstdDecompressor().decompress(raw[self.at[k] - self.at[a] : self.at[k + 1] - self.at[a]])
            if xxhash.xxh64_intdigest(got) & 0xFFFFFFFF != self.table[k, 2]:
                raise ValueError(f"frame {k} doesn't agree with its checksum")
            out.append(np.frombuffer(got, self.kind))
        self.read += b - a
        return np.concatenate(out)[start - self.first[a] : stop - self.first[a]].astype("<u4")

    def batch(self, rows: np.ndarray, base: int) -> pa.RecordBatch:
        """Documents at these places of the list, ascending."""
        runs = np.split(rows, np.flatnonzero(np.diff(rows) != 1) + 1) if len(rows) else []
        ids = [self.ids(int(self.start[r[0]]), int(self.start[r[-1] + 1])) for r in runs]
        joined = np.concatenate(ids) if ids else np.zeros(0, "<u4")
        return pa.RecordBatch.from_arrays([pa.array(self.doc_id[rows], mask=~self.given[rows]), pa.array(self.start[rows] + base), blobs(joined, self.length[rows])], names=["doc_id", "start", "ids"])

    def batches(self, rows: np.ndarray, base: int, most: int = 1 << 22) -> Iterator[pa.RecordBatch]:
        """The same in batches of some most ids; a longer document stands alone."""
        i, upto = 0, np.append(0, np.cumsum(self.length[rows]))
        while i < len(rows):
            j = max(i + 1, int(np.searchsorted(upto, upto[i] + most, "right")) - 1)
            yield self.batch(rows[i:j], base)
            i = j


@dataclass
class Written(WriterCommitMessage):
    file: dict | None


@dataclass
class Part(InputPartition):
    name: str
    base: int  # ids in the files before
    start: int  # documents that start at these of the file's ids
    stop: int


class IdWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.folder, self.overwrite = options["path"], overwrite
        self.frame, self.width = int(options.get("frame", 1 << 16)), int(options.get("width", 4))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        store, path = _open(self.folder)
        name = f"ids-{uuid.uuid4().hex}.zst"
        out = None
        for batch in iterator:
            if not batch.num_rows:
                continue
            ends = [(batch.column(0)[i].as_py(), batch.column(1)[i].as_py()) for i in (0, batch.num_rows - 1)]
            if out is None:
                store.create_dir(path, recursive=True)
                stream = store.open_output_stream(f"{path}/{name}", compression=None)
                out, first = Frames(stream, self.frame, self.width), ends[0]
            raw, offsets = utf8(batch.column(2))
            out.add(batch.column(0), np.frombuffer(raw.tobytes(), "<u4"), np.diff(offsets) // 4)
            last = ends[1]
        if out is None:
            return Written(None)
        out.close()
        stream.close()
        return Written({"name": name, "docs": sum(len(n) for _, n in out.docs), "tokens": out.tokens, "frames": len(out.table) - 1, "first": first, "last": last})

    def commit(self, messages: list[Written | None]) -> None:
        store, path = _open(self.folder)
        order = lambda at: (at[0] is not None, at[0] or 0, at[1])
        files = sorted((m.file for m in messages if m is not None and m.file), key=lambda f: (order(f["first"]), order(f["last"])))
        if any(order(a["last"]) > order(b["first"]) for a, b in zip(files, files[1:], strict=False)):
            raise ValueError("the rows weren't dealt by ranges of doc_id and key")
        old = [f["name"] for f in listing(self.folder)]
        if old and not self.overwrite:
            raise ValueError(f"{self.folder} holds files; overwrite them or take another folder")
        store.create_dir(path, recursive=True)
        own = f"{path}/{uuid.uuid4().hex}.tmp"
        with store.open_output_stream(own) as out:
            out.write("\n".join(map(json.dumps, files)).encode())
        store.move(own, f"{path}/{LIST}")
        for name in old:
            store.delete_file(f"{path}/{name}")

    def abort(self, messages: list[Written | None]) -> None:
        store, path = _open(self.folder)
        for m in messages:
            if m is not None and m.file:
                store.delete_file(f"{path}/{m.file['name']}")


class IdReader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder, self.split = options["path"], int(options.get("split", 1 << 25))

    def partitions(self) -> list[Part]:
        out, base = [], 0
        for f in listing(self.folder):
            out += [Part(f["name"], base, k, k + self.split) for k in range(0, f["tokens"], self.split)]
            base += f["tokens"]
        return out

    def read(self, partition: Part | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # Spark's stand-in where there are no partitions
            return
        store, path = _open(self.folder)
        with store.open_input_file(f"{path}/{partition.name}") as file:
            own = Seekable(file)
            a, b = np.searchsorted(own.start[:-1], [partition.start, partition.stop])
            yield from own.batches(np.arange(a, b), partition.base)


class SeekableIds(DataSource):
    """``path``; when writing ``frame`` (ids in a frame) and ``width`` (bytes of an id, 2 or 4); when reading ``split`` (ids in a task)."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "doc_id bigint, start bigint, ids binary"

    def reader(self, schema) -> IdReader:
        return IdReader(self.options)

    def writer(self, schema, overwrite: bool) -> IdWriter:
        return IdWriter(self.options, overwrite)


def listing(folder: str) -> list[dict]:
    """Files in ascending order, one entry each; none where nothing has been written."""
    store, path = _open(folder)
    if store.get_file_info(f"{path}/{LIST}").type == fs.FileType.NotFound:
        return []
    with store.open_input_stream(f"{path}/{LIST}") as f:
        return [json.loads(line) for line in f.read().decode().splitlines()]


def write_ids(docs: DataFrame, path: str, folder: str, end: int = 2, frame: int = 1 << 16, width: int = 2) -> None:
    """Encode all documents and write their ids to folder, in ascending order of doc_id."""
    docs.sparkSession.dataSource.register(SeekableIds)
    encode(docs, path, end).write.format(FORMAT).option("frame", frame).option("width", width).mode("overwrite").save(folder)


def read_ids(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start (ids of all documents before it) and ids of every document."""
    spark.dataSource.register(SeekableIds)
    return spark.read.format(FORMAT).load(folder)


def pick(wanted: DataFrame, folder: str) -> DataFrame:
    """The same for the documents whose ids are in wanted's doc_id; only the frames that hold them are decompressed."""
    files, starts = listing(folder), [0]
    for f in files:
        starts.append(starts[-1] + f["tokens"])
    low = [-(2**63) if f["first"][0] is None else f["first"][0] for f in files]
    high = [-(2**63) if f["last"][0] is None else f["last"][0] for f in files]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for v in batch.column(0).to_pylist():
                k = bisect_right(low, v) - 1
                while k >= 0 and high[k] >= v:  # an id may lie in several files
                    out.append((k, v))
                    k -= 1
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.int64())], names=["file", "doc_id"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = _open(folder)
        for batch in batches:
            file, ids = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for k in np.unique(file).tolist():
                with store.open_input_file(f"{path}/{files[k]['name']}") as opened:
                    own = Seekable(opened)
                    yield from own.batches(np.flatnonzero(np.isin(own.doc_id, ids[file == k]) & own.given), starts[k])

    rows = wanted.select(wanted["doc_id"].cast("bigint").alias("doc_id")).where("doc_id is not null").distinct()
    dealt = rows.mapInArrow(deal, "file int, doc_id bigint").repartition("file").sortWithinPartitions("file", "doc_id")
    return dealt.mapInArrow(run, "doc_id bigint, start bigint, ids binary")
