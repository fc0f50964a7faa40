"""Token ids of whole texts in patched frame-of-reference files.

File layout (little-endian):

    magic 8s, blocks u32, ids u64, documents u32, part u32, number u32
    index   u64 place of each block in the body, and one beyond the last
    documents: i64 doc_id, u8 has an id, u32 ids of it, u8 last piece of it
    body: for each block of BLOCK ids (the last may have fewer)
        minimum u32, width u8, exceptions u16,
        ids minus the minimum, the low `width` bits of each, packed,
        u16 place and u32 high bits of each exception

The width is the least that holds the PERCENTILE of a block's differences;
larger ones keep their high bits in the exception list.  The block index makes
any id reachable without decoding what is before it.

Documents are ordered by doc_id over all files by range partitioning; a task
writes a file for every FILE_IDS ids (a longer document goes on in the next
file), under a name that only depends on its partition, moved into place when
complete, so that a task which runs again replaces the same file.

Ids come from the given tokenizer.  Byte-level pieces end before a single space
between characters that are no white space of any kind, and between an ASCII
letter and ASCII punctuation (but the apostrophe): its pre-tokeniser always cuts
there, so that pieces can be encoded once and looked up after that.

Nulls and empties: a null text is an empty one: only the end id.  A null doc_id
comes first and is kept as null.  Repeated rows are all written; rows of one
doc_id come in the order of a hash of their texts, then of the texts.  An empty
table gives no files and no rows.  Other columns are ignored.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .storage import new_path, staged
from .textkit import PART, lanes, range_hashes, runs, same_bytes

MAGIC = b"PFORIDS1"
HEAD = struct.Struct("<8sIQIII")
BLOCK_HEAD = struct.Struct("<IBH")
BLOCK = 1024
PERCENTILE = 95
#: blocks that are packed or unpacked at once
TOGETHER = 256
#: ids of a file: about 35 MB
FILE_IDS = 16_000_000
END_ID = 0
STEP = 4 << 20
#: pieces that a worker keeps encoded
CACHE = 1_500_000
#: pieces that are encoded at once
JOINED = 200


def encode_block(ids: np.ndarray) -> bytes:
    """One block of at most 65535 ids below 2**32."""
    least = int(ids.min())
    gaps = (ids.astype(np.int64) - least).astype(np.uint64)
    width = int(np.sort(gaps)[(len(gaps) * PERCENTILE - 1) // 100]).bit_length()
    high = gaps >> np.uint64(width)
    late = np.flatnonzero(high)
    bits = ((gaps[:, None] >> np.arange(width, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
    packed = np.packbits(bits, axis=None, bitorder="little").tobytes()
    return BLOCK_HEAD.pack(least, width, len(late)) + packed + late.astype("<u2").tobytes() + high[late].astype("<u4").tobytes()


def decode_block(data: memoryview, n: int) -> np.ndarray:
    least, width, late = BLOCK_HEAD.unpack_from(data)
    at = BLOCK_HEAD.size
    size = (n * width + 7) // 8
    bits = np.unpackbits(np.frombuffer(data, np.uint8, size, at), bitorder="little")[: n * width].reshape(n, width)
    gaps = np.zeros(n, np.uint64)
    for k in range(width):
        gaps |= bits[:, k].astype(np.uint64) << np.uint64(k)
    at += size
    places = np.frombuffer(data, "<u2", late, at)
    gaps[places] |= np.frombuffer(data, "<u4", late, at + 2 * late).astype(np.uint64) << np.uint64(width)
    return (gaps + np.uint64(least)).astype(np.uint32)


def _lanes(width: int) -> list[tuple[int, int, int, int]]:
    """(id, first byte, last byte, shift) of each of eight ids of `width` bits, which take `width` bytes together."""
    return [(j, j * width // 8, (j * width + width - 1) // 8, j * width % 8) for j in range(8 if width else 0)]


def encode_blocks(ids: np.ndarray) -> list[bytes]:
    """What encode_block makes of each BLOCK ids."""
    whole = ids[: len(ids) // BLOCK * BLOCK].reshape(-1, BLOCK)
    out = [b for i in range(0, len(whole), TOGETHER) for b in _packed(whole[i : i + TOGETHER])]
    return out + ([encode_block(ids[whole.size :])] if whole.size < len(ids) else [])


def _packed(whole: np.ndarray) -> list[bytes]:
    """Some whole blocks; those of one width are packed together."""
    out = [b""] * len(whole)
    least = whole.min(axis=1, keepdims=True)
    gaps = whole - least
    widths = np.frexp(np.sort(gaps, axis=1)[:, (BLOCK * PERCENTILE - 1) // 100].astype(np.float64))[1]
    for width in np.unique(widths).tolist():
        own = np.flatnonzero(widths == width)
        kind = np.uint32 if width <= 24 else np.uint64
        some = gaps[own]
        eights = np.ascontiguousarray(some.reshape(-1, 8).T, kind) & kind((1 << width) - 1)
        packed = np.zeros((width, eights.shape[1]), np.uint8)
        for j, first, last, shift in _lanes(width):
            value = eights[j] << kind(shift)
            for k in range(first, last + 1):
                packed[k] |= (value >> kind(8 * (k - first))).astype(np.uint8)
        packed = np.ascontiguousarray(packed.T).reshape(len(own), BLOCK // 8 * width)
        late = np.flatnonzero(some > np.uint32((1 << width) - 1))
        values = (some.ravel().take(late).astype(np.uint64) >> np.uint64(width)).astype("<u4")
        ends, late = np.searchsorted(late, np.arange(len(own) + 1) * BLOCK), (late % BLOCK).astype("<u2")
        for i, k in enumerate(own.tolist()):
            a, b = ends[i], ends[i + 1]
            out[k] = BLOCK_HEAD.pack(least[k, 0], width, b - a) + packed[i].tobytes() + late[a:b].tobytes() + values[a:b].tobytes()
    return out


def decode_blocks(blocks: list[memoryview]) -> np.ndarray:
    """The ids of whole blocks."""
    out = np.empty((len(blocks), BLOCK), np.uint32)
    for i in range(0, len(blocks), TOGETHER):
        _unpack(blocks[i : i + TOGETHER], out[i : i + TOGETHER])
    return out.ravel()


def _unpack(blocks: list[memoryview], out: np.ndarray) -> None:
    heads = [BLOCK_HEAD.unpack_from(b) for b in blocks]
    least, widths, late = np.array(heads, np.int64).reshape(-1, 3).T
    for width in np.unique(widths).tolist():
        own, size = np.flatnonzero(widths == width), BLOCK // 8 * width
        packed = np.frombuffer(b"".join(blocks[k][BLOCK_HEAD.size : BLOCK_HEAD.size + size] for k in own.tolist()), np.uint8).reshape(len(own) * BLOCK // 8, width)
        packed, kind = np.ascontiguousarray(packed.T), np.uint32 if width <= 24 else np.uint64
        gaps = np.zeros((8, len(own) * BLOCK // 8), kind)
        for j, first, last, shift in _lanes(width):
            for k in range(first, last + 1):
                gaps[j] |= packed[k].astype(kind) << kind(8 * (k - first))
            gaps[j] >>= kind(shift)
            gaps[j] &= kind((1 << width) - 1)
        out[own] = gaps.T.reshape(len(own), BLOCK)
        for k in own[late[own] > 0].tolist():
            places = np.frombuffer(blocks[k], "<u2", late[k], BLOCK_HEAD.size + size)
            out[k, places] |= np.frombuffer(blocks[k], "<u4", late[k], BLOCK_HEAD.size + size + 2 * late[k]) << np.uint32(width)
    out += least.astype(np.uint32)[:, None]


def encode_file(ids: np.ndarray, docs: list[tuple[int | None, int, bool]], part: int, number: int) -> bytes:
    """docs: doc_id, how many of the ids, whether the document ends here."""
    blocks = encode_blocks(ids)
    index = np.concatenate([[0], np.cumsum([len(b) for b in blocks], dtype=np.int64)]).astype("<u8")
    table = [
        np.array([d[0] or 0 for d in docs], "<i8").tobytes(),
        np.array([d[0] is not None for d in docs], "<u1").tobytes(),
        np.array([d[1] for d in docs], "<u4").tobytes(),
        np.array([d[2] for d in docs], "<u1").tobytes(),
    ]
    return b"".join([HEAD.pack(MAGIC, len(blocks), len(ids), len(docs), part, number), index.tobytes(), *table, *blocks])


class TokenFile:
    """A file's content; `ids(start, n)` decodes the blocks that it needs only."""

    def __init__(self, content: bytes):
        self.data = memoryview(content)
        magic, blocks, self.n_ids, n, self.part, self.number = HEAD.unpack_from(self.data)
        if magic != MAGIC:
            raise ValueError("not a token file")
        at = HEAD.size
        self.index = np.frombuffer(self.data, "<u8", blocks + 1, at)
        at += 8 * (blocks + 1)
        self.doc_ids = np.frombuffer(self.data, "<i8", n, at)
        self.has_id = np.frombuffer(self.data, "<u1", n, at + 8 * n).astype(bool)
        self.counts = np.frombuffer(self.data, "<u4", n, at + 9 * n)
        self.ends = np.frombuffer(self.data, "<u1", n, at + 13 * n).astype(bool)
        self.body = at + 14 * n

    def ids(self, start: int, n: int) -> np.ndarray:
        first, last = start // BLOCK, (start + n + BLOCK - 1) // BLOCK
        places = (self.body + self.index[first : last + 1].astype(np.int64)).tolist()
        blocks = [self.data[a:b] for a, b in zip(places[:-1], places[1:], strict=True)]
        rest = [decode_block(blocks.pop(), self.n_ids % BLOCK)] if last * BLOCK > self.n_ids else []
        return np.concatenate([decode_blocks(blocks), *rest])[start - first * BLOCK : start - first * BLOCK + n]


_B = np.arange(256)
_SPACE = (_B == 0x20) | ((_B >= 0x09) & (_B <= 0x0D)) | ((_B >= 0x1C) & (_B <= 0x1F))
#: bytes that a white-space character beyond ASCII may end with, or begin with
_SPACE_END = _SPACE | ((_B >= 0x80) & (_B <= 0x8F)) | np.isin(_B, (0x9F, 0xA0, 0xA8, 0xA9, 0xAF))
_SPACE_BEGIN = _SPACE | ((_B >= 0xE1) & (_B <= 0xE3)) | (_B == 0xC2)
_LETTER = ((_B >= 65) & (_B <= 90)) | ((_B >= 97) & (_B <= 122))
_MARK = ((_B >= 33) & (_B <= 47) & (_B != 39)) | ((_B >= 58) & (_B <= 64)) | ((_B >= 91) & (_B <= 96)) | ((_B >= 123) & (_B <= 126))


class PieceEncoder:
    """Encodes texts piece by piece, each distinct piece once."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks share out the cores already
        self.tokenizer = Tokenizer.from_file(path)
        added = "".join(t.content for t in self.tokenizer.get_added_tokens_decoder().values()).encode()
        self.marks = _MARK & ~np.isin(_B, np.frombuffer(added, np.uint8))
        self.spaces = b" " not in added
        names = self.tokenizer.get_vocab(with_added_tokens=True)
        self.widths = np.zeros(max(names.values()) + 1, np.int64)
        for name, i in names.items():
            self.widths[i] = len(name)  # a character stands for a byte
        self.clear()

    def clear(self) -> None:
        self.hashes = np.zeros(0, np.uint64)
        self.place = np.zeros(0, np.int64)
        self.begin = np.zeros(1, np.int64)
        self.flat = np.zeros(0, np.uint32)
        self.pieces: list[bytes] = []
        #: length and first sixteen bytes of each piece: all of most
        self.known = np.zeros((0, 3), np.uint64)

    def _ids(self, pieces: list[bytes]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast([p.decode("utf-8") for p in pieces], add_special_tokens=False)]

    def _all_ids(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces, and how many each has.

        Pieces that begin with a single space and end with none are put together and encoded at once;
        the tokens' byte lengths tell them apart again.  Where they don't, pieces are encoded one by one.
        """
        joinable = [i for i, p in enumerate(pieces) if self.spaces and len(p) > 1 and p[0] == 0x20 and not _SPACE_BEGIN[p[1]] and not _SPACE_END[p[-1]]]
        n = np.zeros(len(pieces), np.int64)
        parts: list[tuple[int, np.ndarray]] = []
        chunks = [joinable[i : i + JOINED] for i in range(0, len(joinable), JOINED)]
        alone = np.ones(len(pieces), bool)
        for chunk, found in zip(chunks, self._ids([b"".join(pieces[i] for i in c) for c in chunks]), strict=True):
            ids = np.array(found, np.uint32)
            reached, ends = np.cumsum(self.widths[ids]), np.cumsum([len(pieces[i]) for i in chunk])
            at = np.searchsorted(reached, ends)
            if at[-1] == len(ids) - 1 and (reached[at] == ends).all():
                n[chunk] = np.diff(at, prepend=-1)
                alone[chunk] = False
                parts.append((chunk, ids))
        rest = np.flatnonzero(alone)
        for i, found in zip(rest.tolist(), self._ids([pieces[i] for i in rest.tolist()]), strict=True):
            n[i] = len(found)
            parts.append(([i], np.array(found, np.uint32)))
        begin = np.cumsum(n) - n
        flat = np.zeros(int(n.sum()), np.uint32)
        for chunk, ids in parts:
            own = n[chunk]
            flat[np.repeat(begin[chunk] - (np.cumsum(own) - own), own) + np.arange(len(ids))] = ids
        return flat, n

    def _learn(self, hashes: np.ndarray, pieces: list[bytes], known: np.ndarray) -> None:
        flat, n = self._all_ids(pieces)
        place = np.arange(len(self.pieces), len(self.pieces) + len(n))
        self.begin = np.concatenate([self.begin, self.begin[-1] + np.cumsum(n)])
        self.flat = np.concatenate([self.flat, flat])
        self.known = np.concatenate([self.known, known])
        self.pieces += pieces
        at = np.searchsorted(self.hashes, hashes)
        self.hashes, self.place = np.insert(self.hashes, at, hashes), np.insert(self.place, at, place)

    def _cuts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        cut = np.zeros(len(data) + 1, bool)
        if len(data) > 2:
            if self.spaces:
                cut[1:-2] = (data[1:-1] == 0x20) & ~_SPACE_END[data[:-2]] & ~_SPACE_BEGIN[data[2:]]
            cut[1:-1] |= _LETTER[data[:-1]] & self.marks[data[1:]]
        cut[offsets] = True
        return np.flatnonzero(cut)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all documents of a step, and documents + 1 places in them.

        A piece is looked up by its hash, and its bytes are compared with those of the piece that
        was encoded under that hash; one that differs is encoded by itself.
        """
        cuts = self._cuts(data, offsets)
        start, end = cuts[:-1], cuts[1:]
        bounds = np.searchsorted(start, offsets)
        bounds[-1] = len(start)
        eights, length = lanes(data), end - start
        unique, first, inverse = np.unique(range_hashes(data, start, end, 0, eights), return_index=True, return_inverse=True)
        of = first[inverse]
        same = length == length[of]
        same[same] = same_bytes(eights, start[same], start[of[same]], length[same])
        begin, n = start[first], length[first]
        second = np.where(n > 8, eights[np.minimum(begin + 8, len(data))] & PART[np.clip(n - 8, 0, 8)], np.uint64(0))
        known = np.stack([n.astype(np.uint64), eights[begin] & PART[np.minimum(n, 8)], second], axis=1)

        def piece(k: int) -> bytes:
            return data[start[k] : end[k]].tobytes()

        at = np.searchsorted(self.hashes, unique)
        inside = at < len(self.hashes)
        inside[inside] = self.hashes[at[inside]] == unique[inside]
        new = np.flatnonzero(~inside)
        if len(self.hashes) + len(new) > CACHE:
            self.clear()
            new = np.arange(len(unique))
        if len(new):
            self._learn(unique[new], [piece(k) for k in first[new].tolist()], known[new])
        place = self.place[np.searchsorted(self.hashes, unique)]
        right = (self.known[place] == known).all(axis=1)
        for u in np.flatnonzero(right & (n > 16)):
            right[u] = self.pieces[place[u]] == piece(first[u])
        same &= right[inverse]
        place = place[inverse]
        odd = np.flatnonzero(~same)
        if not len(odd):
            return self._gathered(self.begin, self.flat, place, bounds)
        ids = self._ids([piece(k) for k in odd.tolist()])
        place[odd] = np.arange(len(self.pieces), len(self.pieces) + len(odd))
        own = self.begin[-1] + np.cumsum([len(x) for x in ids])
        return self._gathered(np.concatenate([self.begin, own]), np.concatenate([self.flat, *(np.array(x, np.uint32) for x in ids)]), place, bounds)

    @staticmethod
    def _gathered(begin: np.ndarray, flat: np.ndarray, place: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at, n = begin[place], begin[place + 1] - begin[place]
        out_begin = np.concatenate([[0], np.cumsum(n)])
        return flat[np.repeat(at - out_begin[:-1], n) + np.arange(out_begin[-1])], out_begin[bounds]


@lru_cache(maxsize=2)
def encoder(path: str) -> PieceEncoder:
    return PieceEncoder(path)


def encoded(texts: pa.Array, path: str) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, ids, documents + 1 places) for runs of rows."""
    tool = encoder(path)
    for row, data, offsets in runs(texts, STEP):
        yield row, *tool.encode(data, offsets)


def _move_in(folder: str, name: str, content: bytes) -> None:
    """Write a file whole, then give it its name; a rerun replaces it."""
    from pyarrow import fs

    context = TaskContext.get()
    store, at = fs.FileSystem.from_uri(folder)
    temporary = f"{at}/.{name}.{context.taskAttemptId() if context else os.getpid()}"
    with store.open_output_stream(temporary) as out:
        out.write(content)
    store.move(temporary, f"{at}/{name}")


def _write(folder: str, path: str, end_id: int, file_ids: int):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        ids: list[np.ndarray] = []
        docs: list[tuple[int | None, int, bool]] = []
        made: list[tuple[int, int, int]] = []
        held = 0

        def flush() -> None:
            nonlocal ids, docs, held
            _move_in(folder, f"part-{part:06d}-{len(made):06d}.pfor", encode_file(np.concatenate(ids), docs, part, len(made)))
            made.append((part, len(made), held))
            ids, docs, held = [], [], 0

        for batch in parts:
            names = batch.column(0).to_pylist()
            for row, flat, bounds in encoded(batch.column(1), path):
                for i in range(len(bounds) - 1):
                    own = np.append(flat[bounds[i] : bounds[i + 1]], np.uint32(end_id)).astype(np.uint32)
                    while len(own):
                        piece, own = own[: file_ids - held], own[file_ids - held :]
                        ids.append(piece)
                        docs.append((names[row + i], len(piece), not len(own)))
                        held += len(piece)
                        if held == file_ids:
                            flush()
        if held:
            flush()
        columns = list(zip(*made, strict=True)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["part", "number", "n_ids"])

    return run


def write_token_files(docs: DataFrame, tokenizer_path: str, folder: str | None = None, *, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, file_ids: int = FILE_IDS) -> str:
    """Write the files of docs in ascending doc_id order; the folder is returned."""
    spark = docs.sparkSession
    folder = folder or new_path(spark, "tokens")
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(folder)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(at)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    # the hash splits a doc_id that many rows share
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    sorted_rows = rows.repartitionByRange(*order).sortWithinPartitions(*order, "text")
    made = sorted_rows.mapInArrow(_write(folder, tokenizer_path, end_id, file_ids), "part long, number long, n_ids long")
    made.write.mode("overwrite").parquet(f"{folder}/_files")
    return folder


def _read(digests: bool):
    """All documents' pieces with their ids; or with their counts and crc32, and with ids only where a document goes over a file's edge."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            for content in batch.column(0):
                file = TokenFile(content.as_buffer())
                begin = np.concatenate([[0], np.cumsum(file.counts, dtype=np.int64)])
                ids = memoryview(file.ids(0, file.n_ids).astype("<u4")).cast("B")
                n = len(file.counts)
                pieces = [ids[4 * a : 4 * b] for a, b in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True)]
                columns = {
                    "part": pa.array(np.full(n, file.part, np.int64)),
                    "number": pa.array(np.full(n, file.number, np.int64)),
                    "place": pa.array(np.arange(n, dtype=np.int64)),
                    "doc_id": pa.array(file.doc_ids, pa.int64(), mask=~file.has_id),
                    "at": pa.array(begin[:-1]),
                    "ends": pa.array(file.ends),
                }
                if digests:
                    edge = ~file.ends | ((np.arange(n) == 0) & (file.number > 0))
                    columns |= {"n": pa.array(file.counts.astype(np.int64)), "crc": pa.array([zlib.crc32(x) for x in pieces], pa.int64()), "edge": pa.array(edge)}
                    pieces = [x.tobytes() if e else None for x, e in zip(pieces, edge.tolist(), strict=True)]
                yield pa.RecordBatch.from_pydict(columns | {"ids": pa.array(pieces, pa.binary())})

    return run


PIECES = "part long, number long, place long, doc_id long, at long, ends boolean"


def _files(spark, folder: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.pfor").load(folder).select("content")


def read_token_files(spark, folder: str) -> DataFrame:
    """(part, number, place, doc_id, at, ids, ends): the pieces of documents in each file, with their ids as binary."""
    pieces = _files(spark, folder).mapInArrow(_read(False), f"{PIECES}, ids binary")
    return pieces.select("part", "number", "place", "doc_id", "at", "ids", "ends")


def token_rows(spark, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, from the files alone, each of which is read once."""
    files = spark.read.parquet(f"{folder}/_files")
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = files.groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("part_base"))
    inside = Window.partitionBy("part").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    files = files.withColumn("inside", F.coalesce(F.sum("n_ids").over(inside), F.lit(0))).join(parts, "part")
    files = staged(files.select("part", "number", (F.col("part_base") + F.col("inside")).alias("base")), "bases")
    pieces = staged(_files(spark, folder).mapInArrow(_read(True), f"{PIECES}, n long, crc long, edge boolean, ids binary"), "pieces")
    pieces = pieces.join(files, ["part", "number"]).withColumn("start", F.col("base") + F.col("at"))
    whole = pieces.where("not edge").select("doc_id", "start", F.col("n").alias("n_tokens"), F.col("crc").alias("ids_crc32"))
    # a document that ends in a later file than it began in: all pieces at a file's edge, put together
    edge = pieces.where("edge")
    ended = Window.partitionBy("part").orderBy("number", "place").rowsBetween(Window.unboundedPreceding, -1)
    edge = edge.withColumn("which", F.coalesce(F.sum(F.col("ends").cast("long")).over(ended), F.lit(0)))
    edge = edge.groupBy("part", "which").agg(F.first("doc_id").alias("doc_id"), F.array_sort(F.collect_list(F.struct("start", "ids"))).alias("pieces"))
    joined = edge.select("doc_id", F.element_at("pieces", 1)["start"].alias("start"), F.arrow_udf(_crc_of, "struct<n: bigint, crc: bigint>")(F.col("pieces.ids")).alias("made"))
    return whole.union(joined.select("doc_id", "start", F.col("made.n").alias("n_tokens"), F.col("made.crc").alias("ids_crc32")))


def _crc_of(pieces: pa.Array) -> pa.Array:
    n, crc = [], []
    for row in pieces:
        c = size = 0
        for piece in row.values if row.is_valid else ():
            c, size = zlib.crc32(piece.as_buffer(), c), size + len(piece.as_buffer()) // 4
        n.append(size)
        crc.append(c)
    return pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(crc, pa.int64())], names=["n", "crc"])


__all__ = ["TokenFile", "decode_block", "decode_blocks", "encode_block", "encode_blocks", "encode_file", "read_token_files", "token_rows", "write_token_files"]
