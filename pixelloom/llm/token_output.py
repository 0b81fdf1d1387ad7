"""Token ids in a fixed-width bit-packed binary format.

File format (little-endian), one file per shard of consecutive documents:

    magic    8 bytes
    blocks   each of ``ids per block`` ids packed in ``bits`` bits (lowest bit first);
             the last one may be shorter; each block starts on a byte
    tables   u64 block offsets, i64 doc ids, u8 null flags of doc ids, u64 document starts
             (in ids, one more than documents)
    footer   u32 version, u32 bits per id, u32 ids per block, u32 reserved,
             u64 documents, u64 ids, u64 blocks, u64 offset of the tables

``bits`` is the least number that holds every id of the vocabulary.  A block unpacks with
numpy in one go, and any id range is reached through the block offsets.

Ranges: the id column alone (read column-pruned) is range-partitioned, at most ``MAX_RANGES`` ways, and the
greatest id of each part is a bound.  Every document goes to the range of its id, and the tokenised
rows, not the texts, are shuffled, one range to a task.  A task streams its range into shard
files of about ``SHARD_IDS`` ids each (one document is never split), so memory holds one block and one
file's tables, however large a range is.  A file is written under an attempt's own name and renamed, so a
lost executor's retry only replaces the same bytes.

Defined cases: null text is empty; null ids come first; rows of one id are of one range and ordered by
their token bytes; repeated rows are stored as often as they come; very long texts are encoded whole and
make a longer file; empty tables write no file; other columns of ``docs`` aren't read, so their names
can't clash.
"""

from __future__ import annotations

import io
import json
import re
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import col, new_path, stored, tidied

MAGIC = b"PXLTOK01"
FOOTER = struct.Struct("<IIIIQQQQ")
BLOCK = 8192
#: Documents a range is meant to hold, and the most ranges there are (their bounds go to every task).
SHARD_DOCS = 4096
MAX_RANGES = 1 << 16
#: Ids after which a shard file is closed.
SHARD_IDS = 1 << 22
END_ID = 1
#: Pieces kept in a worker's cache of encodings; those that come when it is full are forgotten again.
CACHE_PIECES = 700_000
#: Pieces of texts that are looked up together.
HELD_PIECES = 400_000

#: Texts of only these characters split on white space into words that encode on their own:
#: printable ASCII, tab, line feed, carriage return, and Latin letters that NFC and
#: lower-casing leave one to one.
_PLAIN = re.compile(r"[\t\n\r\x20-\x7E¡-¬®-ÿĀ-įı-ňŊ-ž]*")
_MARK = "<|"


def bits_for(vocabulary: int) -> int:
    return max(1, (max(1, vocabulary) - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Fixed-width packing, lowest bit first; whole-byte widths are copied."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    grid = (ids.astype(np.uint32)[:, None] >> np.arange(bits, dtype=np.uint32)) & 1
    return np.packbits(grid.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(data, count: int, bits: int) -> np.ndarray:
    """Inverse of ``pack``: ``count`` ids as uint32."""
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", count).astype(np.uint32)
    flat = np.unpackbits(np.frombuffer(data, np.uint8), count=count * bits, bitorder="little")
    return flat.reshape(count, bits).astype(np.uint32) @ (np.uint32(1) << np.arange(bits, dtype=np.uint32))


class ShardFile:
    """Reader of one shard; ``ids(a, b)`` unpacks only the blocks that hold the range."""

    def __init__(self, data: bytes):
        if bytes(data[: len(MAGIC)]) != MAGIC:
            raise ValueError("not a token shard")
        self.version, self.bits, self.block, _, self.docs, self.total, blocks, at = FOOTER.unpack_from(data, len(data) - FOOTER.size)
        self.data = memoryview(data)
        self.offsets = np.frombuffer(data, "<u8", blocks, at)
        at += 8 * blocks
        self.doc_ids = np.frombuffer(data, "<i8", self.docs, at)
        self.nulls = np.frombuffer(data, np.uint8, self.docs, at + 8 * self.docs)
        self.starts = np.frombuffer(data, "<u8", self.docs + 1, at + 9 * self.docs).astype(np.int64)

    def ids(self, first: int, end: int) -> np.ndarray:
        if end <= first:
            return np.zeros(0, np.uint32)
        a, b = first // self.block, (end - 1) // self.block
        parts = []
        for k in range(a, b + 1):
            n = min(self.block, self.total - k * self.block)
            at = int(self.offsets[k])
            parts.append(unpack(self.data[at : at + (n * self.bits + 7) // 8], n, self.bits))
        return np.concatenate(parts)[first - a * self.block : end - a * self.block]

    def document(self, k: int) -> np.ndarray:
        return self.ids(int(self.starts[k]), int(self.starts[k + 1]))


class ShardWriter:
    """Streams one shard to a file: documents in, blocks out as they fill."""

    def __init__(self, sink, bits: int, block: int = BLOCK):
        self.sink, self.bits, self.block = sink, bits, block
        self.at = len(MAGIC)
        sink.write(MAGIC)
        self.rest, self.total = np.zeros(0, np.uint32), 0
        self.offsets: list[int] = []
        self.doc_ids: list[int | None] = []
        self.starts = [0]

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.doc_ids.append(doc_id)
        self.total += len(ids)
        self.starts.append(self.total)
        self.rest = np.concatenate([self.rest, ids]) if len(self.rest) else ids
        full = len(self.rest) // self.block
        for k in range(full):
            self._put(self.rest[k * self.block : (k + 1) * self.block])
        if full:
            self.rest = self.rest[full * self.block :]

    def _put(self, ids: np.ndarray) -> None:
        data = pack(ids, self.bits)
        self.offsets.append(self.at)
        self.sink.write(data)
        self.at += len(data)

    def close(self) -> None:
        if len(self.rest):
            self._put(self.rest)
        for part in (
            np.array(self.offsets, "<u8"), np.array([i or 0 for i in self.doc_ids], "<i8"),
            np.array([i is None for i in self.doc_ids], np.uint8), np.array(self.starts, "<u8"),
        ):
            self.sink.write(part.tobytes())
        self.sink.write(FOOTER.pack(1, self.bits, self.block, 0, len(self.doc_ids), self.total, len(self.offsets), self.at))
        self.sink.close()


class _Buffer(io.BytesIO):
    """Keeps its bytes after close()."""

    def close(self) -> None:
        self.bytes = self.getvalue()


def shard_bytes(docs, bits: int, block: int = BLOCK) -> bytes:
    """A shard of (doc_id, ids) pairs as bytes."""
    sink = _Buffer()
    w = ShardWriter(sink, bits, block)
    for i, ids in docs:
        w.add(i, ids)
    w.close()
    return sink.bytes


class Encoder:
    """Ids of whole texts by the tokenizers library, as little-endian uint32 bytes.

    Texts of plain characters are cut into the pieces that the vocabulary's splitter makes; a piece
    encodes on its own, and its ids are cached.  New pieces are encoded many at a time by the same
    model; each ends with the one token that has the end-of-word mark, which parts the ids again.
    Any other text, or one that holds the start of a special token, goes to the library whole, and
    so does everything if the vocabulary's normaliser, splitter or model aren't the ones this is made for.
    """

    #: The normaliser and the splitter that pieces are made for.
    NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
    SPLITTER = {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    }
    #: Fixed value: the splitter's pattern for lower-cased plain characters, letters first.
    PIECE = re.compile(r"[^\W\d_²³¹¼½¾]+|'(?:s|t|re|ve|m|ll|d)|[\d²³¹¼½¾]|(?:[^\w\s']|_|'(?!s|t|re|ve|m|ll|d))(?:[^\w\s]|_)*")
    MARK = "</w>"

    def __init__(self, file: str, cache_pieces: int = CACHE_PIECES, held_pieces: int = HELD_PIECES):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel, Sequence, WhitespaceSplit

        self.tokenizer = Tokenizer.from_file(file)
        vocabulary = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.last[[i for t, i in vocabulary.items() if t.endswith(self.MARK)]] = True
        given = json.loads(self.tokenizer.to_str())
        special = all(t["special"] and t["content"].startswith(_MARK) for t in given.get("added_tokens") or ())
        model = given["model"]
        plain = model["type"] == "BPE" and model.get("end_of_word_suffix") == self.MARK and not model.get("dropout") and not model.get("continuing_subword_prefix")
        self.marked = special and plain and given.get("normalizer") == self.NORMALIZER and given.get("pre_tokenizer") == self.SPLITTER
        #: The same model for pieces, which need no normaliser and no pattern any more.
        self.plain = Tokenizer(self.tokenizer.model)
        self.plain.pre_tokenizer = Sequence([WhitespaceSplit(), ByteLevel(add_prefix_space=False, use_regex=False)])
        self.pieces: dict[str, bytes] = {}
        self.cache_pieces, self.held_pieces = cache_pieces, held_pieces

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn(self, new: list[str]) -> None:
        ids = np.array(self.plain.encode_batch_fast([" ".join(new)], add_special_tokens=False)[0].ids, "<u4")
        ends = np.flatnonzero(self.last[ids]) + 1
        if len(ends) != len(new):  # some piece doesn't end with its mark: each goes alone
            self.pieces.update((p, self._whole(p)) for p in new)
            return
        data, stops = ids.tobytes(), (ends * 4).tolist()
        self.pieces.update(zip(new, [data[a:b] for a, b in zip([0, *stops], stops)]))

    def learn(self, pieces: set[str]) -> None:
        new = list(pieces)
        for at in range(0, len(new), 2_000):
            self._learn(new[at : at + 2_000])

    def _settle(self, cut: dict[int, list[str]], out: list[bytes]) -> None:
        """Encode texts that are cut into pieces; new pieces are learned together, and kept while the cache has room."""
        new = set().union(*cut.values()).difference(self.pieces)
        self.learn(new)
        get = self.pieces.__getitem__
        for k, ps in cut.items():
            out[k] = b"".join(map(get, ps))
        if len(self.pieces) > self.cache_pieces:  # what comes late is seldom
            for p in new:
                del self.pieces[p]
        cut.clear()

    def encode(self, texts: list[str | None]) -> list[bytes]:
        out: list[bytes] = [b""] * len(texts)
        find, held = self.PIECE.findall, 0
        cut: dict[int, list[str]] = {}
        for k, t in enumerate(texts):
            if t and self.marked and _PLAIN.fullmatch(t) and _MARK not in t:
                cut[k] = find(t.lower())
                held += len(cut[k])
                if held > self.held_pieces:
                    self._settle(cut, out)
                    held = 0
            elif t:
                out[k] = self._whole(t)
        if cut:
            self._settle(cut, out)
        return out


_encoders: dict[str, Encoder] = {}


def encoder(file: str, small: bool = False) -> Encoder:
    """The worker's encoder of a vocabulary: its cache outlives a task.  ``small``: less memory, for workers that other stages have used."""
    key = f"{file}|{small}"
    if key not in _encoders:
        _encoders[key] = Encoder(file, CACHE_PIECES * 4 // 7, HELD_PIECES * 3 // 8) if small else Encoder(file)
    return _encoders[key]


def shard_bounds(docs: DataFrame, doc_id: str, shard_docs: int = SHARD_DOCS) -> list[int]:
    """Upper bounds of all ranges but the last; about ``shard_docs`` documents each."""
    ids = docs.select(col(docs, doc_id).cast("long").alias("i"))
    k = min(MAX_RANGES, max(1, -(-ids.count() // shard_docs)))
    if k == 1:
        return []
    parts = ids.repartitionByRange(k, "i").groupBy(F.spark_partition_id().alias("p")).agg(F.max("i").alias("b"))
    return sorted({r["b"] for r in parts.collect() if r["b"] is not None})[:-1]  # k rows


def even_keys(spark, n: int) -> list[int]:
    """For each of n parts a number that a shuffle of n parts deals to it, so ranges don't meet in a task."""
    if n == 1:
        return [0]
    ids = spark.range(n * (8 + n.bit_length()))
    got = ids.groupBy(F.pmod(F.hash("id"), F.lit(n)).alias("p")).agg(F.min("id").alias("id")).collect()  # n rows
    keys = {r["p"]: r["id"] for r in got}
    return [keys.get(p, p) for p in range(n)]  # a part that none fell to: still right, only less even


_PACKED = T.StructType([
    T.StructField("key", T.LongType(), False), T.StructField("shard", T.IntegerType(), False), T.StructField("doc_id", T.LongType()),
    T.StructField("ids", T.BinaryType(), False),
])
_MANIFEST = T.StructType([
    T.StructField("shard", T.IntegerType(), False), T.StructField("part", T.IntegerType(), False), T.StructField("path", T.StringType(), False),
    T.StructField("docs", T.LongType(), False), T.StructField("ids", T.LongType(), False),
])


def write_shards(docs: DataFrame, tokenizer_file: str, path: str, *, doc_id: str = "doc_id", text: str = "text", end_id: int | None = END_ID, shard_docs: int = SHARD_DOCS, shard_ids: int = SHARD_IDS, block: int = BLOCK, small: bool = False) -> DataFrame:
    """Tokenise every whole text, append ``end_id``, write shards in ascending doc_id order.

    Returns the manifest (shard: the range, part: the file in it, path, docs, ids), stored as Parquet.  Null ids come first,
    rows with the same id are ordered by their token bytes; null text is empty.
    ``path`` must be a folder that all executors share; any scheme pyarrow's file systems know.
    """
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    bits = bits_for(Tokenizer.from_file(tokenizer_file).get_vocab_size())
    bounds = np.array(shard_bounds(docs, doc_id, shard_docs), np.int64)
    keys = np.array(even_keys(spark, len(bounds) + 1), np.int64)
    tail = b"" if end_id is None else np.array([end_id], "<u4").tobytes()

    def tokenise(batches):
        enc = encoder(tokenizer_file, small)
        for b in batches:
            ids = b.column(0)
            for at in range(0, b.num_rows, 512):
                part = ids.slice(at, 512)
                data = [x + tail for x in enc.encode(b.column(1).slice(at, 512).to_pylist())]
                shard = np.searchsorted(bounds, np.asarray(part.fill_null(np.iinfo(np.int64).min)), "left")
                narrow = [np.frombuffer(x, "<u4").astype(f"<u{2 if bits <= 16 else 4}").tobytes() for x in data]
                yield pa.RecordBatch.from_arrays([pa.array(keys[shard]), pa.array(shard.astype(np.int32)), part, pa.array(narrow, pa.binary())], names=_PACKED.names)

    def write(batches):
        _encoders.clear()  # all is tokenised by now, and the worker lives on
        fs, writer, shard, part, done = None, None, None, 0, []

        def finish():
            writer.close()
            fs.move(f"{base}/.{shard:08d}-{part:06d}-{tag}.tmp", f"{base}/shard-{shard:08d}-{part:06d}.bin")
            done.append((shard, part, f"{path}/shard-{shard:08d}-{part:06d}.bin", len(writer.doc_ids), writer.total))

        tag = uuid.uuid4().hex[:8]
        width = f"<u{2 if bits <= 16 else 4}"
        for b in batches:
            if fs is None:
                fs, base = pafs.FileSystem.from_uri(path)
                fs.create_dir(base, recursive=True)
            for s, i, data in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3)):
                if s != shard or writer.total >= shard_ids:
                    if writer is not None:
                        finish()
                    shard, part = s, part + 1 if s == shard else 0
                    writer = ShardWriter(fs.open_output_stream(f"{base}/.{shard:08d}-{part:06d}-{tag}.tmp"), bits, block)
                writer.add(i, np.frombuffer(data.as_buffer(), width).astype(np.uint32))
        if writer is not None:
            finish()
        yield pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], t) for k, t in enumerate((pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64()))], names=_MANIFEST.names)

    tokens = docs.select(col(docs, doc_id).cast("long").alias("doc_id"), col(docs, text).cast("string").alias("text")).mapInArrow(tidied(tokenise), _PACKED)
    dealt = tokens.repartition(len(keys), "key").sortWithinPartitions("shard", F.col("doc_id").asc_nulls_first(), "ids")
    return stored(dealt.mapInArrow(tidied(write), _MANIFEST), "token-manifest")


_READ = T.StructType([
    T.StructField("shard", T.IntegerType(), False), T.StructField("part", T.IntegerType(), False), T.StructField("doc_id", T.LongType()), T.StructField("local_start", T.LongType(), False),
    T.StructField("n_tokens", T.LongType(), False), T.StructField("ids_crc32", T.LongType(), False),
])


def read_shards(manifest: DataFrame, path: str) -> DataFrame:
    """One row per document read back from the files: doc_id, start, n_tokens, ids_crc32.

    The files are read through Spark (any store it can open).  ``start`` counts the ids of all
    earlier files by a running sum over the manifest, which has one small row per file.
    """
    spark = manifest.sparkSession
    files = spark.read.format("binaryFile").option("pathGlobFilter", "shard-*.bin").load(path).select("path", "content")

    def decode(batches):
        for b in batches:
            for p, content in zip(b.column(0).to_pylist(), b.column(1)):
                f = ShardFile(content.as_buffer().to_pybytes())
                shard, part = map(int, re.search(r"shard-(\d+)-(\d+)\.bin$", p).groups())
                crc = []
                for at in range(0, f.docs, 256):
                    end = min(f.docs, at + 256)
                    ids = f.ids(int(f.starts[at]), int(f.starts[end])).astype("<u4")
                    cuts = f.starts[at : end + 1] - f.starts[at]
                    crc += [zlib.crc32(ids[cuts[k] : cuts[k + 1]].tobytes()) for k in range(end - at)]
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(f.docs, shard, np.int32)), pa.array(np.full(f.docs, part, np.int32)), pa.array(f.doc_ids, mask=f.nulls.astype(bool)), pa.array(f.starts[:-1]),
                    pa.array(np.diff(f.starts)), pa.array(crc, pa.int64()),
                ], names=_READ.names)

    base = manifest.select("shard", "part", F.coalesce(F.sum("ids").over(Window.orderBy("shard", "part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    return files.mapInArrow(tidied(decode), _READ).join(base, ["shard", "part"]).select(
        "doc_id", (F.col("local_start") + F.col("base")).alias("start"), "n_tokens", "ids_crc32"
    )


def encode_documents(docs: DataFrame, tokenizer_file: str, *, doc_id: str = "doc_id", text: str = "text", path: str | None = None, small: bool = False) -> DataFrame:
    """Write ``docs`` to shards in the shared folder and return what is read back from them.

    Empty tables write no file and return no row.  ``small`` takes less memory and more time; the result is the same.
    """
    path = path or new_path(docs.sparkSession, "token-shards")
    manifest = write_shards(docs, tokenizer_file, path, doc_id=doc_id, text=text, small=small)
    if not manifest.head(1):
        return docs.sparkSession.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    return read_shards(manifest, path)
