"""Operator 10: token ids as length-delimited binary records.

A data file is a run of frames and ends with one line feed.  A frame is

    length of the payload   8 bytes, little-endian
    masked CRC-32 of those  4 bytes
    payload                 id flag (1 byte: 1 present, 0 null), id (8 bytes),
                            bytes per token id (1 byte), token ids
    masked CRC-32 of it     4 bytes

An index file has 32 bytes a record: id flag, id, offset of the frame, number
of token ids (each 8 bytes), and one line feed at its end, so a record can be
read without the rest of the file.  Shards are ordered by id, each holds at
most about ``SHARD_BYTES``.

Files are written by Spark's own committer (the text writer copies the bytes
of a string as they are), so a lost executor leaves no torn file behind and
any file system that Spark writes to will do.
"""

from __future__ import annotations

import os
import struct
import unicodedata
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import byte_slices, resident, small_batches

SHARD_BYTES = 4_000_000
#: Text bytes of one range partition.
PARTITION_BYTES = 8_000_000
GROUP_BYTES = 4_000_000
#: Shards that one partition can number.
SHARDS_A_PARTITION = 1_000_000
#: Remembered words per Python worker; beyond it the memory starts anew.
MEMORY_WORDS = 800_000
#: Words that the library encodes at once.
BATCH_WORDS = 20_000
#: ASCII punctuation that is no letter's neighbour in a contraction.
MARKS = b'!"#$%&()*+,-./:;=?@[\\]^_`{}~|'
HEAD, INDEX = "<QI", "<qqqq"
#: Kinds of bytes: white space, letters, marks; bytes of no kind stay with their neighbours.
SPACE, LETTER, MARK, OTHER = 0, 1, 2, 4
KINDS = np.full(256, OTHER, np.uint8)
for _kind, _bytes in ((SPACE, b" \t\n\r\v\f"), (LETTER, bytes(range(97, 123))), (MARK, MARKS)):
    KINDS[list(_bytes)] = _kind
#: Code points of two bytes that are letters, also when lower-cased.
LATIN = np.array([0xC0 <= c < 0x240 and chr(c).isalpha() and chr(c).lower().isalpha() for c in range(0x800)])


def masked(data: bytes) -> int:
    """CRC-32, rotated and offset so that it can itself be stored and summed."""
    c = zlib.crc32(data)
    return (((c >> 15) | (c << 17)) + 0xA282EAD8) & 0xFFFFFFFF


def lower_letters(word: bytes) -> bool:
    """Whether a word is lower Latin letters only, which neither compose nor end within the word."""
    if word.isalpha():  # ASCII
        return word.islower()
    if word.isascii():
        return False
    text = word.decode()
    return max(text) < "\u0250" and text.isalpha() and text.islower()


def cut(data: bytes) -> tuple[pa.Array, np.ndarray]:
    """The words of a text between white space, and where they begin.

    Words end at ASCII white space, and where a Latin letter and a mark meet.
    """
    a = np.frombuffer(data, np.uint8)
    kinds = KINDS[a]
    if not data.isascii():
        leads = np.flatnonzero((a >= 0xC3) & (a <= 0xC8))
        leads = leads[(a[leads + 1] >> 6 == 2) & LATIN[(a[leads].astype(np.int16) & 31) << 6 | a[leads + 1] & 63]]
        kinds[leads] = kinds[leads + 1] = LETTER
    here, before = kinds[1:], kinds[:-1]
    meet = here ^ before == LETTER ^ MARK
    starts = np.flatnonzero((here != SPACE) & (meet | (before == SPACE))) + 1
    ends = np.flatnonzero((before != SPACE) & (meet | (here == SPACE))) + 1
    offsets = np.append(0, np.cumsum(ends - starts))
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(a[kinds != SPACE])]), starts


def held(words: pa.Array) -> np.ndarray:
    """The bytes of all words, one after the other."""
    data = words.buffers()[2]
    return np.frombuffer(data, np.uint8) if data else np.empty(0, np.uint8)


class Encoder:
    """Encodes white-space separated words; lives as long as its worker."""

    def __init__(self, path: str, end_id: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.code = "H" if self.tokenizer.get_vocab_size() <= 65536 else "I"
        self.width = array(self.code).itemsize
        self.end = array(self.code, [end_id]).tobytes()
        #: Ids that end a word; words of letters can then be encoded in one text.
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.known: dict[bytes, bytes] = {}

    @classmethod
    def of(cls, path: str, end_id: int) -> Encoder:
        return resident(("records", path, end_id), lambda: cls(path, end_id))

    def _parts(self, word: bytes) -> tuple[bytes, bytes]:
        """Letters and the marks after them, which are always encoded apart."""
        if b"<|" in word:  # special strings count as they stand
            return word, b""
        word = word.lower()
        core = word.rstrip(MARKS)
        if core != word and (core.isalpha() or unicodedata.normalize("NFC", core.decode()).lower().isalpha()):
            return core, word[len(core) :]
        return word, b""

    def learn(self, unseen: set[bytes]) -> None:
        letters, parts, cuts = [], set(), []
        for w in unseen:
            if lower_letters(w):
                letters.append(w)
                continue
            core, marks = self._parts(w)
            parts.add(core)
            if marks:
                parts.add(marks)
            if core != w:
                cuts.append((w, core, marks))
        parts = parts.difference(self.known)  # in place it would walk through all that is known
        parts.difference_update(letters)
        letters += filter(lower_letters, parts)
        rest = [p for p in parts if not lower_letters(p)]
        for i in range(0, len(letters), BATCH_WORDS):
            rest += self._learn_letters(letters[i : i + BATCH_WORDS])
        for i in range(0, len(rest), BATCH_WORDS):
            batch = rest[i : i + BATCH_WORDS]
            for p, e in zip(batch, self.tokenizer.encode_batch_fast([p.decode() for p in batch], add_special_tokens=False)):
                self.known[p] = array(self.code, e.ids).tobytes()
        for w, core, marks in cuts:
            self.known[w] = self.known[core] + self.known[marks] if marks else self.known[core]

    def _learn_letters(self, words: list[bytes]) -> list[bytes]:
        """Encode words of lower letters as one text, cut it where words end; return words that are left."""
        text = b" ".join(words).decode()
        ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.dtype(self.code))
        ends = ((np.flatnonzero(self.ends[ids]) + 1) * self.width).tolist()
        if len(ends) != len(words):  # this vocabulary marks no word ends
            return words
        data = ids.tobytes()
        self.known.update(zip(words, map(data.__getitem__, map(slice, [0, *ends], ends))))
        return []

    def ids(self, words: list[bytes]) -> list[bytes]:
        """Token ids of each word; words that are not known yet are learnt."""
        out = list(map(self.known.get, words))
        if None in out:
            unseen = {w for w, e in zip(words, out) if e is None}
            if len(self.known) + len(unseen) > MEMORY_WORDS:
                self.known.clear()
                unseen = set(words)
            self.learn(unseen)
            out = [self.known[w] if e is None else e for w, e in zip(words, out)]
        return out

    def encode(self, texts: list[bytes | None]) -> list[bytes]:
        """Token ids of each text and the end id, as bytes.

        The tokenizer's pre-tokens never hold white space, so words between
        ASCII white space can be encoded one by one, and so can letters and
        the marks next to them.  Case does not matter to them, but in special
        strings; texts that may hold those are split as they stand.
        """
        plain = [b"" if not t or b"<|" in t else t for t in texts]
        words, starts = cut(b"\n".join([b"", *plain, b""]).lower())
        found = words.dictionary_encode()  # so each word of the group is looked up once
        distinct = np.insert(held(found.dictionary), np.cumsum(pa.compute.binary_length(found.dictionary)), 32).tobytes().split()
        ids = pa.array(self.ids(distinct), pa.large_binary()).take(found.indices)
        firsts = np.searchsorted(starts, np.cumsum([1, *(len(t) + 1 for t in plain)]))
        at = np.append(0, np.cumsum(pa.compute.binary_length(ids)))[firsts].tolist()
        data = held(ids).tobytes()
        out = [data[i:j] + self.end for i, j in zip(at, at[1:])]
        for k, t in enumerate(texts):
            if t and b"<|" in t:
                out[k] = b"".join(self.ids(t.split())) + self.end
        return out


def frame(doc_id: int | None, width: int, ids: bytes) -> bytes:
    payload = struct.pack("<?qB", doc_id is not None, doc_id or 0, width) + ids
    length = struct.pack("<Q", len(payload))
    return length + struct.pack("<I", masked(length)) + payload + struct.pack("<I", masked(payload))


def parse(data: bytes, at: int) -> tuple[int | None, np.ndarray, int]:
    """Id and token ids of the frame at an offset, and the offset of the next."""
    length, check = struct.unpack_from(HEAD, data, at)
    if masked(data[at : at + 8]) != check:
        raise ValueError(f"damaged length at offset {at}")
    payload = data[at + 12 : at + 12 + length]
    if masked(payload) != struct.unpack_from("<I", data, at + 12 + length)[0]:
        raise ValueError(f"damaged record at offset {at}")
    present, doc_id, width = struct.unpack_from("<?qB", payload)
    return doc_id if present else None, np.frombuffer(payload, f"<u{width}", offset=10), at + 16 + length


def write_records(docs: DataFrame, path: str, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every text and write data and index files under ``path``.

    Ids are cast to long and stored in ascending order, null first, equal ids
    in the order of their texts' hashes; null and empty texts hold the end id
    alone; an empty table writes no file; other columns are not read.
    """
    rows = small_batches(docs).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"), F.xxhash64(text_col).alias("h"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranged = rows.repartitionByRange(max(1, -(-total // PARTITION_BYTES)), "id", "h").sortWithinPartitions("id", "h")

    def shards(batches):
        encoder = Encoder.of(tokenizer_path, end_id)
        shard = TaskContext.get().partitionId() * SHARDS_A_PARTITION
        data, index = bytearray(), bytearray()

        def closed():
            files = [bytes(data), bytes(index)]
            data.clear(), index.clear()
            return pa.RecordBatch.from_arrays([pa.array(["data", "index"]), pa.array([shard] * 2, pa.int64()), pa.array(files, pa.binary())], ["kind", "shard", "content"])

        for whole in batches:
            for batch in byte_slices(whole, "text", GROUP_BYTES):
                for doc_id, ids in zip(batch.column(0).to_pylist(), encoder.encode(batch.column(1).to_pylist())):
                    index += struct.pack(INDEX, doc_id is not None, doc_id or 0, len(data), len(ids) // encoder.width)
                    data += frame(doc_id, encoder.width, ids)
                    if len(data) >= SHARD_BYTES:
                        yield closed()
                        shard += 1
        if data:
            yield closed()

    files = ranged.select("id", "text").mapInArrow(shards, "kind string, shard long, content binary")
    files.select("kind", "shard", F.col("content").cast("string").alias("content")).write.partitionBy("kind", "shard").text(path)


def _files(spark: SparkSession, path: str, kind: str) -> DataFrame:
    jvm = spark._jvm
    folder = jvm.org.apache.hadoop.fs.Path(f"{path}/kind={kind}")
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], "shard long, content binary")
    return spark.read.format("binaryFile").load(f"{path}/kind={kind}").select(F.col("shard").cast("long").alias("shard"), "content")


def read_index(spark: SparkSession, path: str, id_col: str = "doc_id") -> DataFrame:
    """``shard, ordinal, id, offset, n_tokens`` of every record, from the index."""

    def rows(batches):
        for batch in batches:
            for shard, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                t = np.frombuffer(content, "<i8", len(content) // 8).reshape(-1, 4)
                n = len(t)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([shard] * n, pa.int64()), pa.array(range(n), pa.int64()), pa.array(t[:, 1], mask=t[:, 0] == 0), pa.array(t[:, 2]), pa.array(t[:, 3])],
                    ["shard", "ordinal", "id", "offset", "n_tokens"],
                )

    out = _files(spark, path, "index").mapInArrow(rows, "shard long, ordinal long, id long, offset long, n_tokens long")
    return out.withColumnRenamed("id", id_col)


def read_records(spark: SparkSession, path: str, id_col: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """Every record of the data files, checksums verified.

    Returns id, ``start`` (ids in all records before it), ``n_tokens``,
    ``ids_crc32`` (of the ids as little-endian unsigned 32-bit integers), and
    the ``ids`` themselves if asked for.
    """
    schema = "shard long, id long, inner long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids

    def rows(batches):
        resident(("records", "reading"), dict)  # the memory of the encoder goes
        for batch in batches:
            for shard, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                at = before = 0
                out: list[tuple] = []
                while at < len(content) - 1:
                    doc_id, ids, at = parse(content, at)
                    out.append((shard, doc_id, before, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), *([ids.tolist()] if with_ids else [])))
                    before += len(ids)
                if out:
                    types = [pa.int64()] * 5 + [pa.list_(pa.int64())] * with_ids
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], [x.split()[0] for x in schema.split(", ")])

    # ids before each shard: the index gives sums by shard; two levels keep windows small
    totals = read_index(spark, path).groupBy("shard").agg(F.sum("n_tokens").alias("n")).withColumn("part", F.floor(F.col("shard") / (SHARDS_A_PARTITION * 1024)))
    before = lambda *keys: Window.partitionBy(*keys[:-1]).orderBy(keys[-1]).rowsBetween(Window.unboundedPreceding, -1)
    parts = totals.groupBy("part").agg(F.sum("n").alias("n_part")).select("part", F.coalesce(F.sum("n_part").over(before("part")), F.lit(0)).alias("base"))
    shards = totals.join(parts, "part").select("shard", (F.col("base") + F.coalesce(F.sum("n").over(before("part", "shard")), F.lit(0))).alias("base"))
    records = _files(spark, path, "data").mapInArrow(rows, schema)
    return records.join(shards, "shard").select(F.col("id").alias(id_col), (F.col("base") + F.col("inner")).alias("start"), "n_tokens", "ids_crc32", *(["ids"] if with_ids else []))
