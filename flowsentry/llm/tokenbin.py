"""Token-id files: ids in blocks, each block transposed into byte or bit planes.

File layout (little-endian)::

    "TOKPLN01" | block 0 | block 1 | ... | index | index offset u64, index length u64

A block holds ``block_ids`` ids (the last one fewer), transposed into 4 byte planes or 32 bit
planes; each plane is compressed with zstandard on its own, and a plane of zeros takes no
bytes.  The index is an Arrow stream of three columns lists: the chunk index (offset and ids of
each block, length of each plane) and the documents (id and number of ids), in file order.  A
reader fetches any id range with the blocks that cover it.

Texts are range-partitioned and sorted by document id, one file a partition, so files in
order hold the ids in ascending document order; a document's start is its file's base (a
prefix sum of one total per file) plus its place in the file.  Files are written under a
name of their own attempt and then moved, so a repeated task leaves one file.

Defined cases: a null text is empty, an empty text has the end id alone, null document ids
come first, repeated rows are written each (equal ids in order of their text), an empty table
writes no file; ids are those of the library's ``encode`` with ``add_special_tokens=False``, so
a text that holds the content of an added token gets that token's id.
"""

from __future__ import annotations

import io
import json
import re
import struct
import sys
import uuid
import zlib
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, worker_cache

MAGIC = b"TOKPLN01"
BLOCK_IDS = 1 << 16

# ---------------------------------------------------------------- planes


def to_planes(ids: np.ndarray, kind: str) -> list[bytes]:
    """Planes of a block of unsigned 32-bit ids; planes of zeros are empty."""
    raw = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    if kind == "byte":
        planes = [np.ascontiguousarray(raw[:, i]) for i in range(4)]
    else:
        bits = np.unpackbits(raw, axis=1, bitorder="little")
        planes = [np.packbits(bits[:, i], bitorder="little") for i in range(32)]
    return [p.tobytes() if p.any() else b"" for p in planes]


def from_planes(planes: list[bytes], n: int, kind: str) -> np.ndarray:
    if kind == "byte":
        raw = np.zeros((n, 4), np.uint8)
        for i, p in enumerate(planes):
            if p:
                raw[:, i] = np.frombuffer(p, np.uint8)
    else:
        bits = np.zeros((n, 32), np.uint8)
        for i, p in enumerate(planes):
            if p:
                bits[:, i] = np.unpackbits(np.frombuffer(p, np.uint8), count=n, bitorder="little")
        raw = np.packbits(bits, axis=1, bitorder="little")
    return np.ascontiguousarray(raw).view("<u4").ravel()


class Writer:
    """Writes one file; keeps one unfinished block and the index in memory."""

    def __init__(self, sink, kind: str = "byte", block_ids: int = BLOCK_IDS, level: int = 3):
        self.sink, self.kind, self.block_ids = sink, kind, block_ids
        self.press = zstandard.ZstdCompressor(level=level)
        self.at = sink.write(MAGIC) and len(MAGIC)
        self.rest: list[bytes] = []
        self.rest_ids = 0
        self.chunks: list[dict] = []
        self.docs: list[pa.Array] = []
        self.counts: list[np.ndarray] = []
        self.total = 0

    def add(self, doc_ids: pa.Array, texts_ids: list[bytes]) -> None:
        """Documents in order; ids as little-endian unsigned 32-bit bytes."""
        self.docs.append(doc_ids)
        self.counts.append(np.array([len(b) // 4 for b in texts_ids], np.int64))
        for b in texts_ids:
            self.rest.append(b)
            self.rest_ids += len(b) // 4
            if self.rest_ids >= self.block_ids:
                self._flush(False)

    def _flush(self, last: bool) -> None:
        ids = np.frombuffer(b"".join(self.rest), "<u4")
        whole = len(ids) if last else len(ids) // self.block_ids * self.block_ids
        for i in range(0, whole, self.block_ids):
            block = ids[i:min(i + self.block_ids, whole)]
            planes = [self.press.compress(p) if p else b"" for p in to_planes(block, self.kind)]
            self.chunks.append({"offset": self.at, "ids": len(block), "planes": [len(p) for p in planes]})
            for p in planes:
                self.sink.write(p)
                self.at += len(p)
        self.rest, self.rest_ids = [ids[whole:].tobytes()], len(ids) - whole
        self.total += whole

    def close(self) -> None:
        self._flush(True)
        index = pa.table({
            "kind": [self.kind], "block_ids": [self.block_ids],
            "chunks": pa.array([self.chunks], pa.list_(pa.struct(
                [("offset", pa.int64()), ("ids", pa.int64()), ("planes", pa.list_(pa.int32()))])))})
        docs = pa.table({"doc_id": pa.chunked_array(self.docs) if self.docs else pa.array([], pa.int64()),
                         "n": np.concatenate(self.counts) if self.counts else np.zeros(0, np.int64)})
        out = io.BytesIO()
        for t in (index, docs):
            with pa.ipc.new_stream(part := io.BytesIO(), t.schema) as w:
                w.write_table(t)
            out.write(struct.pack("<Q", len(part.getvalue())) + part.getvalue())
        packed = self.press.compress(out.getvalue())
        self.sink.write(packed + struct.pack("<QQ", self.at, len(packed)))
        self.sink.close()


class Reader:
    """Random access to one file through its chunk index."""

    def __init__(self, source, size: int):
        self.source = source
        source.seek(size - 16)
        offset, length = struct.unpack("<QQ", source.read(16))
        source.seek(offset)
        raw = zstandard.ZstdDecompressor().decompress(source.read(length))
        tables = []
        while raw:
            n = struct.unpack("<Q", raw[:8])[0]
            tables.append(pa.ipc.open_stream(raw[8:8 + n]).read_all())
            raw = raw[8 + n:]
        head = tables[0].to_pylist()[0]
        self.kind, self.block_ids, self.chunks = head["kind"], head["block_ids"], head["chunks"]
        self.doc_ids, self.counts = tables[1].column("doc_id"), tables[1].column("n").to_numpy()

    def block(self, k: int) -> np.ndarray:
        c = self.chunks[k]
        self.source.seek(c["offset"])
        press = zstandard.ZstdDecompressor()
        planes = [press.decompress(self.source.read(n)) if n else b"" for n in c["planes"]]
        return from_planes(planes, c["ids"], self.kind)

    def ids(self, first: int, count: int) -> np.ndarray:
        """Ids ``first`` to ``first + count`` of the file."""
        if count <= 0:
            return np.zeros(0, "<u4")
        a, z = first // self.block_ids, (first + count - 1) // self.block_ids
        got = np.concatenate([self.block(k) for k in range(a, z + 1)])
        return got[first - a * self.block_ids:][:count]

    def documents(self):
        """Ids of each document in order, as pieces of at most a block: (row, ids, is last piece)."""
        k, block, at = -1, np.zeros(0, "<u4"), 0
        for row, n in enumerate(self.counts.tolist()):
            left = n
            while True:
                if at == len(block) and left:
                    k += 1
                    block, at = self.block(k), 0
                take = min(left, len(block) - at)
                left -= take
                yield row, block[at:at + take], left == 0
                at += take
                if left == 0:
                    break


# ---------------------------------------------------------------- encoding

_WS = "\t-\r \x85\xa0  -     　"
_LUMPS = re.compile(f" ?[^{_WS}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+")
_ODD = re.compile(r"[^\S \n]|\s\s")


# letters, then marks: always cut between them, as around a line feed before them
_PROSE = re.compile("(\n?)([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+)([.,;:!?|)\\]\"-]*)")


def _bytes(ids: list[int]) -> bytes:
    """Ids as little-endian unsigned 32-bit bytes; faster than numpy for short lists."""
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


class _Memo(dict):
    """Encoded pieces of text, at most ``limit`` of them; ``bare`` holds those without prefix."""

    def __init__(self, encode, prefix: str, limit: int, bare: "_Memo | None" = None):
        self.encode, self.prefix, self.limit, self.bare = encode, prefix, limit, bare

    def __missing__(self, piece: str) -> bytes:
        cut = None if piece.isalpha() else _PROSE.fullmatch(piece)  # a word alone has nothing to cut
        bare = self if self.bare is None else self.bare
        if cut and cut[1]:
            out = bare["\n"] + bare[cut[2] + cut[3]]
        elif cut and cut[3]:
            out = self[cut[2]] + bare[cut[3]]
        else:
            text = piece if piece[:1] == "\n" else self.prefix + piece
            out = _bytes(self.encode(text, add_special_tokens=False).ids) if text else b""
        if len(self) < self.limit and len(piece) <= 64:
            self[piece] = out
        return out


class Encoder:
    """The tokenizers library over pieces that its own splitting keeps apart.

    A byte-level tokenizer with the usual splitting pattern and no normaliser always cuts
    before a space that a word follows, and around a single line feed, so such pieces are
    encoded on their own and remembered.  Other tokenizers get whole texts.

    With ``added`` the result is the library's plain ``encode``: the content of an added token
    (such as ``<|endoftext|>``) becomes that token, and texts that may hold one are encoded
    whole.  Without it special tokens are read as text (``encode_special_tokens``).
    """

    def __init__(self, path: str, limit: int = 700_000, added: bool = False):
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = not added
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        self.apart = not spec.get("normalizer") and not spec.get("post_processor") and not spec.get("truncation") \
            and not spec.get("padding") and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) \
            and not pre.get("add_prefix_space")
        self.marks = [t["content"] for t in spec.get("added_tokens") or [] if t.get("content") and (added or not t.get("special"))]
        self.bare = _Memo(self.tok.encode, "", limit // 4)
        self.after = _Memo(self.tok.encode, " ", limit, self.bare)

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit bytes."""
        if not text:
            return b""
        if not self.apart or any(m in text for m in self.marks):
            return np.array(self.tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if _ODD.search(text):
            return b"".join(map(self.bare.__getitem__, _LUMPS.findall(text)))
        pieces = text.replace("\n", " \n").split(" ")
        return self.bare[pieces[0]] + b"".join(map(self.after.__getitem__, pieces[1:]))


# ---------------------------------------------------------------- Spark jobs


def write_ids(spark: SparkSession, docs: DataFrame, id_col: str, text_col: str, tokenizer: str, folder: str, *,
              end_id: int = 0, kind: str = "byte", block_ids: int = BLOCK_IDS) -> DataFrame:
    """Write token files below ``folder``; rows (part, path, docs, ids), one per file."""
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")) \
        .repartitionByRange(n, "id", F.xxhash64("text")).sortWithinPartitions("id", F.xxhash64("text"))
    end = struct.pack("<I", end_id)

    def run(batches):
        enc = worker_cache(("encoder", tokenizer), lambda: Encoder(tokenizer, added=True))
        part, writer, docs_n = TaskContext.get().partitionId(), None, 0
        fs, root = pafs.FileSystem.from_uri(folder)
        name = f"{root}/ids-{part:06d}.tok"
        temp = f"{root}/.ids-{part:06d}-{uuid.uuid4().hex}"
        for batch in batches:
            if writer is None:
                fs.create_dir(root, recursive=True)
                writer = Writer(fs.open_output_stream(temp), kind, block_ids)
            texts = batch.column(1)
            for i in range(0, batch.num_rows, 256):
                writer.add(batch.column(0).slice(i, 256), [enc.encode(t) + end for t in texts.slice(i, 256).to_pylist()])
            docs_n += batch.num_rows
        if writer is not None:
            writer.close()
            fs.move(temp, name)
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "path": [f"{folder}/ids-{part:06d}.tok"],
                                              "docs": pa.array([docs_n], pa.int64()), "ids": pa.array([writer.total], pa.int64())})

    return rows.mapInArrow(run, "part int, path string, docs long, ids long")


def read_ids(spark: SparkSession, files: DataFrame, kind: str = "long") -> DataFrame:
    """Documents of the files of ``write_ids``: doc_id, start, n_tokens, ids_crc32.

    ``kind`` is the type of the document ids.  Files are read block by block.
    """
    listed = files.select("part", "path", "ids").orderBy("part").collect()  # one row per file
    base, plan = 0, []
    for r in listed:
        plan.append((r["path"], base))
        base += r["ids"]
    todo = spark.createDataFrame(plan, "path string, base long").repartition(max(1, len(plan)), "path")

    def run(batches):
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                fs, at = pafs.FileSystem.from_uri(path)
                with fs.open_input_file(at) as source:
                    reader = Reader(source, source.size())
                    crc, sums = 0, np.zeros(len(reader.counts), np.int64)
                    for row, ids, last in reader.documents():
                        crc = zlib.crc32(ids.tobytes(), crc)
                        if last:
                            sums[row], crc = crc, 0
                ends = start + np.cumsum(reader.counts)
                for i in range(0, len(sums), 10_000):
                    j = min(i + 10_000, len(sums))
                    yield pa.RecordBatch.from_arrays(
                        [reader.doc_ids.slice(i, j - i).combine_chunks(), pa.array((ends - reader.counts)[i:j]),
                         pa.array(reader.counts[i:j]), pa.array(sums[i:j])],
                        names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return todo.mapInArrow(run, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long")


def round_trip(spark: SparkSession, docs: DataFrame, id_col: str, text_col: str, tokenizer: str, **options) -> DataFrame:
    """Write the files in the shared folder and describe every document as read back."""
    ws = Workspace(spark, "token-ids")
    files = ws.save(write_ids(spark, docs, id_col, text_col, tokenizer, ws.path("files"), **options), "manifest")
    return read_ids(spark, files, dict(docs.dtypes)[id_col])
