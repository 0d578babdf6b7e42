"""Token ids as length-delimited binary records, with a separate offset index.

A data file is a run of records, each framed as

    length   unsigned 64-bit    bytes of the payload
    check    unsigned 32-bit    masked CRC-32 of the eight length bytes
    payload
    check    unsigned 32-bit    masked CRC-32 of the payload

with all integers little-endian. Masked means rotated right by 15 bits plus 0xA282EAD8, so that checks
of data that hold checks stay good. A payload is one byte (1: has an id), the document id (signed
64-bit), one byte for the width of an id (2 or 4), then the ids. The index is a table (Parquet) of
file, record number, offset and length of each record, document id, number of ids and the position of
the first id within the file: a shuffled reader picks records from it without reading the data files.

Texts are dealt by ranges of the document id, so the files in order of (partition, number) hold
documents in ascending order (null ids first). Files have names of their own for each attempt of a
task; only those that the committed index names count, so lost executors and repeated tasks leave no
double records.

Defined cases: null texts are empty, and an empty text is a record of the end id alone; repeated rows
each get a record, in no set order among equal ids; an empty table writes an empty index; other
columns are ignored whatever their names. One record holds one text of any length.
"""

from __future__ import annotations

import functools
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .bpe import tokenizer
from .common import chunks, ragged, work_dir
from .words import distinct, specials, split

#: A data file is closed when it has so many bytes.
FILE_BYTES = 32 << 20
#: Words that a Python worker remembers.
KNOWN_WORDS = 800_000
ENCODE_WORDS = 4096
#: Bytes that are read in one piece, and bytes of a file that one task reads.
READ_BYTES, RUN_BYTES = 4 << 20, 8 << 20
INDEX = "file string, partition int, number int, record int, offset long, bytes long, doc_id long, n_ids long, first_id long"


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + 0xA282EAD8) & 0xFFFFFFFF


def frame(doc_id: int | None, ids: np.ndarray, width: int) -> bytes:
    payload = struct.pack("<BqB", doc_id is not None, doc_id or 0, width) + ids.astype(f"<u{width}").tobytes()
    length = struct.pack("<Q", len(payload))
    return b"".join((length, struct.pack("<I", masked(length)), payload, struct.pack("<I", masked(payload))))


def unframe(data: memoryview, at: int) -> tuple[int, int | None, np.ndarray]:
    """Where the next record begins, the document id and the ids of the record at a position; a wrong check is an error."""
    length = bytes(data[at : at + 8])
    if len(length) < 8 or struct.unpack("<I", data[at + 8 : at + 12])[0] != masked(length):
        raise ValueError(f"the record at {at} has a wrong length check")
    end = at + 12 + struct.unpack("<Q", length)[0]
    payload = data[at + 12 : end]
    if end + 4 > len(data) or struct.unpack("<I", data[end : end + 4])[0] != masked(payload):
        raise ValueError(f"the record at {at} has a wrong payload check")
    has, doc_id, width = struct.unpack("<BqB", payload[:10])
    return end + 4, doc_id if has else None, np.frombuffer(payload[10:], f"<u{width}")


@functools.cache
def special_tokens(path: str) -> dict[bytes, int]:
    return {t.content.encode(): i for i, t in tokenizer(path).get_added_tokens_decoder().items()}


@functools.cache
def known_ids(path: str) -> dict[bytes, bytes]:
    """The ids of the words that this worker has met."""
    return {}


def encode_chunk(data: np.ndarray, offsets: np.ndarray, path: str, end_id: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts of a chunk, each followed by end_id, and where each text's ids begin."""
    t, marks, known = tokenizer(path), special_tokens(path), known_ids(path)
    begins, ends, of = split(data, offsets, "byte", specials(data, offsets, list(marks)))
    number, words = distinct(data, begins, ends)
    if len(known) > KNOWN_WORDS or not known:
        known.clear()
        known.update((w, np.array([i], "<u4").tobytes()) for w, i in marks.items())
    new = [w for w in words if w not in known]
    for i in range(0, len(new), ENCODE_WORDS):  # few at a time, as the library's results are large
        part = new[i : i + ENCODE_WORDS]
        got = t.encode([w.decode("utf-8", "replace") for w in part], is_pretokenized=True, add_special_tokens=False)
        ends = np.cumsum(4 * np.bincount(np.array(got.word_ids), minlength=len(part))).tolist()
        known.update(zip(part, map(np.array(got.ids, "<u4").tobytes().__getitem__, map(slice, [0, *ends], ends))))
    found = [known[w] for w in words]
    table, sizes = np.frombuffer(b"".join(found), "<u4"), np.array([len(x) // 4 for x in found], np.int64)
    starts = np.cumsum(sizes) - sizes
    ids = table[ragged(starts[number], sizes[number])] if words else table
    bounds = np.concatenate([[0], np.cumsum(sizes[number] if words else [])]).astype(np.int64)[of]
    if end_id is None:
        return ids, bounds
    return np.insert(ids, bounds[1:], end_id), bounds + np.arange(len(bounds))


def write_records(docs: DataFrame, path: str, folder: str | None = None, end_id: int | None = 0, partitions: int | None = None, id_column: str = "doc_id", text_column: str = "text") -> str:
    """Writes the ids of all texts below folder (default: a new one in the shared folder) and returns the folder: data/ and index/."""
    spark = docs.sparkSession
    folder = folder or work_dir(spark, "records")
    partitions = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    schema = pa.schema([("file", pa.string()), ("partition", pa.int32()), ("number", pa.int32()), ("record", pa.int32()), *((c, pa.int64()) for c in ("offset", "bytes", "doc_id", "n_ids", "first_id"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        from pyspark import TaskContext

        partition = TaskContext.get().partitionId()
        width = 2 if tokenizer(path).get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4
        store, place = fs.FileSystem.from_uri(f"{folder}/data")
        store.create_dir(place, recursive=True)
        out, name, number, rows, size, total = None, "", -1, 0, 0, 0
        for batch in batches:
            for part, data, offsets in chunks(batch, "text"):
                ids, bounds = encode_chunk(data, offsets, path, end_id)
                index = []
                for doc, a, b in zip(part.column("id").to_pylist(), bounds[:-1].tolist(), bounds[1:].tolist()):
                    if out is None or size > FILE_BYTES:
                        if out is not None:
                            out.close()
                        number, rows, size, total = number + 1, 0, 0, 0
                        name = f"{partition:06d}-{number:04d}-{uuid.uuid4().hex}.rec"
                        out = store.open_output_stream(f"{place}/{name}")
                    record = frame(doc, ids[a:b], width)
                    out.write(record)
                    index.append((name, partition, number, rows, size, len(record), doc, b - a, total))
                    rows, size, total = rows + 1, size + len(record), total + b - a
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*index), schema)], schema=schema)
        if out is not None:
            out.close()

    data = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/data")
    data.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(data)
    rows = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).cast("string").alias("text"))
    rows.repartitionByRange(partitions, "id").sortWithinPartitions("id").mapInArrow(run, INDEX).write.parquet(f"{folder}/index")
    return folder


def file_starts(index: DataFrame) -> DataFrame:
    """Of each file, the number of ids in all files before it: one row per file is summed up in order."""
    sizes = index.groupBy("file", "partition", "number").agg(F.sum("n_ids").alias("n"))
    order = Window.orderBy("partition", "number").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.select("file", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("file_start"))


def spans(offsets: list[int], sizes: list[int]) -> Iterator[tuple[int, int]]:
    """Runs of neighbouring records (first and one past the last), of READ_BYTES at most or one record."""
    first = 0
    for k in range(1, len(offsets) + 1):
        if k == len(offsets) or offsets[k] != offsets[k - 1] + sizes[k - 1] or offsets[k] + sizes[k] - offsets[first] > READ_BYTES:
            yield first, k
            first = k


def pick_records(wanted: DataFrame, folder: str, *others: str, texts: bool = True) -> DataFrame:
    """doc_id, n_ids, ids_crc32, if asked for ids (binary, unsigned 32-bit), and other columns of the wanted rows of the index, in their order.

    Each task opens the files that its rows name and reads no bytes but those of its records, neighbours in
    one piece; checks are verified, and a record that is not the index's is an error.
    """
    fields = [("doc_id", pa.int64()), ("n_ids", pa.int64()), ("ids_crc32", pa.int64())] + ([("ids", pa.binary())] if texts else [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, place = fs.FileSystem.from_uri(f"{folder}/data")
        name, source = None, None
        for batch in batches:
            files, offsets, sizes, ids_of = (batch.column(c).to_pylist() for c in ("file", "offset", "bytes", "doc_id"))
            edges = [0, *(k for k in range(1, len(files)) if files[k] != files[k - 1]), len(files)] if files else []
            rows = []
            for a, b in zip(edges, edges[1:]):
                if files[a] != name:
                    name, source = files[a], store.open_input_file(f"{place}/{files[a]}")
                for x, y in spans(offsets[a:b], sizes[a:b]):
                    start = offsets[a + x]
                    data = memoryview(source.read_at(offsets[a + y - 1] + sizes[a + y - 1] - start, start))
                    for k in range(a + x, a + y):
                        end, doc_id, ids = unframe(data, offsets[k] - start)
                        if end != offsets[k] - start + sizes[k] or doc_id != ids_of[k]:
                            raise ValueError(f"the index and the record at {offsets[k]} of {name} differ")
                        raw = ids.astype("<u4").tobytes()
                        rows.append((doc_id, len(ids), zlib.crc32(raw), raw)[: len(fields)])
            if rows:
                yield pa.RecordBatch.from_arrays([*(pa.array(c, k) for c, (_, k) in zip(zip(*rows), fields)), *(batch.column(c) for c in others)], names=[*(n for n, _ in fields), *others])

    kinds = dict(wanted.dtypes)
    schema = "doc_id long, n_ids long, ids_crc32 long" + ", ids binary" * texts + "".join(f", {c} {kinds[c]}" for c in others)
    return wanted.select("file", "offset", "bytes", "doc_id", *others).mapInArrow(run, schema)


def read_records(spark: SparkSession, folder: str, texts: bool = False) -> DataFrame:
    """All records that the index names, file by file: doc_id, start (ids of all documents before it), n_ids, ids_crc32 and, if asked for, ids (binary, unsigned 32-bit)."""
    index = spark.read.schema(INDEX).parquet(f"{folder}/index")
    placed = index.join(file_starts(index), "file").withColumn("start", F.col("file_start") + F.col("first_id"))
    dealt = placed.withColumn("_run", F.floor(F.col("offset") / RUN_BYTES)).repartition("file", "_run").sortWithinPartitions("file", "offset")
    return pick_records(dealt, folder, "start", texts=texts).select("doc_id", "start", "n_ids", "ids_crc32", *(["ids"] if texts else []))


def shuffled_records(spark: SparkSession, folder: str, seed: int) -> DataFrame:
    """All records in an order that the seed sets: place (position in that order by hash), doc_id, n_ids, ids_crc32, ids."""
    index = spark.read.schema(INDEX).parquet(f"{folder}/index").withColumn("place", F.xxhash64("partition", "number", "record", F.lit(seed)))
    return pick_records(index.repartitionByRange("place").sortWithinPartitions("place"), folder, "place")
