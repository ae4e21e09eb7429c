"""Token ids as length-delimited binary records, with a separate offset index for shuffled reads.

A data file is a row of records: length (u64), masked CRC-32 of those eight bytes (u32), payload, masked CRC-32 of the
payload (u32), all little-endian. A payload is one document's ids, two bytes each where the vocabulary allows, else four.
The checksum is zlib's CRC-32, rotated right by 15 bits plus 0xA282EAD8, so that the checksum of data that holds
checksums stays meaningful. The index file has one fixed row per record: doc_id (i64), null flag and offset (u64), ids
(u64), so any record can be read alone.

A folder is qualified as Spark would read it, so one without a scheme is on the default file system, and never on an
executor's own disk; s3a is read and written as s3. Data and index are written, and read, as streams: a task holds a batch of texts and the index rows of that batch. Files
hold about 128 MB of input (``parts_of``). Files are written by tasks under names of their own attempt; only those in the manifest table, which is written last,
count. A lost or repeated task leaves at most an orphan file. Records are in ascending doc_id order across files.

Defined results: a null text is an empty one (only the end id); null doc_ids come first; repeated rows are records of
their own; an empty table gives no file; very long texts are one record, encoded by its words.
"""

from __future__ import annotations

import os
import struct
import unicodedata
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagelathe.llm.common import CACHES, release
from pagelathe.llm.common import batches as bound_batches
from pagelathe.llm.common import cut, new_path, parts_of
from pagelathe.sources.storage import opened, qualified

INDEX = np.dtype([("doc_id", "<i8"), ("null", "<u8"), ("offset", "<u8"), ("n", "<u8")])
MASK = 0xA282EAD8


def masked_crc(data: bytes) -> int:
    c = zlib.crc32(data)
    return ((c >> 15 | c << 17) + MASK) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    length = struct.pack("<Q", len(payload))
    return b"".join((length, struct.pack("<I", masked_crc(length)), payload, struct.pack("<I", masked_crc(payload))))


def read_frame(f) -> bytes:
    head = f.read(12)
    length, crc = struct.unpack("<QI", head)
    if masked_crc(head[:8]) != crc:
        raise ValueError("a record's length is damaged")
    payload = f.read(length)
    (crc,) = struct.unpack("<I", f.read(4))
    if len(payload) != length or masked_crc(payload) != crc:
        raise ValueError("a record's payload is damaged")
    return payload


#: Words by which a tokenizer shows whether its model may be asked directly.
PROBES = "the strange tokenizer extraordinarily zq a ion".split()


class WordEncoder(dict):
    """Ids of words as packed bytes, by the tokenizers library, each distinct word encoded once while it is held.

    Right for tokenizers that lower-case, drop blanks and line ends, and take a run of letters and a full stop or comma
    behind it as two pieces. The words held are of two generations: when the younger is full, it becomes the older, and
    what is met again moves up; so frequent words stay, and memory is bounded.
    """

    #: Code points of lower-case Latin letters end below; the bytes of each in the byte-level alphabet.
    LATIN = 0x250

    def __init__(self, path: str, most: int = 200_000) -> None:
        super().__init__()
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.most, self.old = Tokenizer.from_file(path), most, {}
        self.dtype = "<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        self.code = "H" if self.dtype == "<u2" else "I"
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        alphabet = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in shown)}
        self.spelled = str.maketrans({chr(i): "".join(alphabet[b] for b in chr(i).encode()) for i in range(self.LATIN)})
        probes = [w for w in PROBES for w in (w, w + "ñ", "ß" + w[1:], w[::-1] + "éè")]
        self.direct = all(self._letters(w) == self.tokenizer.encode(w, add_special_tokens=False).ids for w in probes)
        #: Lower-case Latin letters: behind one of them, a full stop or comma at a word's end is a piece of its own.
        self.closed = frozenset(c for c in map(chr, range(self.LATIN)) if c.isalpha() and c == c.lower())

    def _letters(self, word: str) -> list[int]:
        """Ids of a word of lower-case Latin letters from the library's model alone: normalising and splitting leave it as it is."""
        return [t.id for t in self.tokenizer.model.tokenize(word if word.isascii() else word.translate(self.spelled))]

    def __missing__(self, word: str) -> bytes:
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        out = self.old.get(word)
        if out is None:
            if word[-1] in ".," and word[-2:-1] in self.closed:
                out = self[word[:-1]] + self[word[-1]]
            else:
                plain = self.direct and word.isalpha() and max(word) < chr(self.LATIN) and word == word.lower()
                ids = self._letters(word) if plain else self.tokenizer.encode(word, add_special_tokens=False).ids
                out = struct.pack(f"<{len(ids)}{self.code}", *ids)
        if len(word) <= 64:
            self[word] = out
        return out

    def encode(self, text: str) -> bytes:
        # Capital sigma and dotted I are lower-cased by context or to two characters; special tokens are left alone too.
        if not any(c in text for c in "\u03a3\u0130<") and unicodedata.is_normalized("NFC", text):
            text = text.lower()
        return b"".join([self[w] for w in text.replace("\n", " ").split(" ") if w])


_encoders: dict[str, WordEncoder] = {}
CACHES.append(_encoders)


def encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def _writer(folder: str, tokenizer: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release(_encoders)
        enc, task = encoder(tokenizer), TaskContext.get()
        end = np.array([end_id], enc.dtype).tobytes()
        width, store, index, at, docs, tokens = np.dtype(enc.dtype).itemsize, None, None, 0, 0, 0
        name = f"{folder}/part-{task.partitionId():06d}-{uuid.uuid4().hex}"
        where, path = opened(name)
        for b in batches:
            if store is None and b.num_rows:
                where.create_dir(os.path.dirname(path), recursive=True)
                store, index = (where.open_output_stream(path + end_, buffer_size=1 << 20) for end_ in (".bin", ".idx"))
            rows = []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                payload = enc.encode(text or "") + end
                store.write(frame(payload))
                rows.append((doc_id or 0, doc_id is None, at, len(payload) // width))
                at, tokens = at + len(payload) + 16, tokens + len(payload) // width
            if rows:
                index.write(np.array(rows, INDEX).tobytes())
                docs += len(rows)
        if store is not None:
            store.close()
            index.close()
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (task.partitionId(), name, enc.dtype, docs, tokens)], names=["part", "file", "dtype", "docs", "tokens"])

    return run


def write_records(docs: DataFrame, tokenizer: str, end_id: int, folder: str | None = None, parts: int | None = None) -> DataFrame:
    """Encode docs (doc_id, text), append end_id to each, write the files; return the manifest: part, file, dtype, docs, tokens, start (ids in earlier parts)."""
    spark = docs.sparkSession
    bound_batches(spark)
    parts = parts or parts_of(docs)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.monotonically_increasing_id().alias("tie"))
    rows = rows.repartitionByRange(parts, "doc_id", "tie").sortWithinPartitions("doc_id", "tie").drop("tie")
    written = cut(rows.mapInArrow(_writer(qualified(spark, folder or new_path(spark, "records")), tokenizer, end_id), "part long, file string, dtype string, docs long, tokens long"), "manifest")
    # One row for each file.
    before = F.sum("tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    return written.withColumn("start", F.coalesce(before, F.lit(0)))


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for r in b.to_pylist():
            where, path = opened(r["file"])
            start = r["start"]
            with where.open_input_stream(path + ".idx", buffer_size=1 << 16) as index, where.open_input_stream(path + ".bin", buffer_size=1 << 20) as f:
                while part := index.read(256 * INDEX.itemsize):
                    rows = np.frombuffer(part, INDEX)
                    ids = [np.frombuffer(read_frame(f), r["dtype"]) for _ in rows]
                    at = start + np.cumsum([0, *map(len, ids)])
                    start = int(at[-1])
                    flat = np.concatenate(ids).astype(np.int32)
                    offsets = pa.array(np.cumsum([0, *map(len, ids)]).astype(np.int32))
                    crc = [zlib.crc32(x.astype("<u4").tobytes()) for x in ids]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(rows["doc_id"].astype(np.int64), mask=rows["null"] > 0), pa.array(at[:-1].astype(np.int64)), pa.array(rows["n"].astype(np.int64)), pa.array(crc, pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(flat))],
                        names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"],
                    )


def read_records(spark: SparkSession, manifest: DataFrame, ids: bool = True) -> DataFrame:
    """All records of the manifest's files: doc_id, start, n_tokens, ids_crc32 (of the ids as u32) and, if asked for, ids. Checksums are verified."""
    files = manifest.select("file", "dtype", "start")
    files = files.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), files.count()), "file")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _reader(batches):
            yield b if ids else b.select(["doc_id", "start", "n_tokens", "ids_crc32"])

    return files.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * ids)


def read_one(file: str, dtype: str, k: int) -> tuple[int | None, np.ndarray]:
    """The k-th record of a file by its index alone: for shuffled reads."""
    where, path = opened(file)
    with where.open_input_file(path + ".idx") as f:
        f.seek(k * INDEX.itemsize)
        (row,) = np.frombuffer(f.read(INDEX.itemsize), INDEX)
    with where.open_input_file(path + ".bin") as f:
        f.seek(int(row["offset"]))
        return None if row["null"] else int(row["doc_id"]), np.frombuffer(read_frame(f), dtype)
