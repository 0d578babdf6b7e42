"""BPE encoding and decoding through a table of distinct words.

Documents are cut into blocks (CHUNK-sized runs of texts within a task). Each block gives its distinct
words to buckets by a hash of the word, a bucket encodes each distinct word once, and the ids return to
the block, where each occurrence of a word takes its ids by the word's position in the block's list.
Ids decode through the vocabulary's id-to-piece table, of fixed size. Between tasks go the blocks'
word numbers and word lists, compressed, and the words' ids; texts are not shuffled, and no word
travels once for each occurrence.

A block's key is a hash of its words, so a task that is run again either meets the same words or its
ids are found missing, which is an error, never a wrong result.

Defined cases: null texts encode as empty ones; an empty text has no ids and decodes to an empty text;
repeated rows each get their row; a null id stays null; an empty table gives an empty result; other
columns are ignored whatever their names. A word of any length is one entry. The input must read
alike when it is read twice (a table, or a written intermediate).
"""

from __future__ import annotations

import functools
import hashlib
import json
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, ragged
from .words import distinct, specials, split

#: Text bytes of a block, at most, but for one longer text.
BLOCK_BYTES = 16 << 20
#: Bytes of results that a block gives back at once.
OUT_BYTES = 4 << 20


@functools.cache
def tokenizer(path: str):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_padding()
    t.no_truncation()
    return t


@functools.cache
def special_strings(path: str) -> list[bytes]:
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    if spec["decoder"] is not None or not spec["model"]["end_of_word_suffix"]:
        raise ValueError(f"{path} isn't a BPE file with word ends and without a decoder")
    return [t["content"].encode() for t in spec["added_tokens"]]


@functools.cache
def pieces(path: str) -> list[str]:
    """The piece of each id."""
    vocab = tokenizer(path).get_vocab(with_added_tokens=True)
    out = [""] * (max(vocab.values()) + 1)
    for piece, i in vocab.items():
        out[i] = piece
    return out


def normal(text: str) -> str:
    """NFC, then each character in lower case by itself; white space only parts words, so it stays."""
    text = text if unicodedata.is_normalized("NFC", text) else unicodedata.normalize("NFC", text)
    return text.replace("Σ", "σ").lower()


def normalized(data: np.ndarray, offsets: np.ndarray, whole: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """Normalised texts of a chunk with offsets and the spans of special strings, which stay as they are."""
    raw, out, bounds, marks, size = data.tobytes(), [], [0], [], 0
    spans = specials(data, offsets, whole)
    at = 0
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        while at < len(spans) and spans[at][1] <= b:
            s, e = spans[at]
            out += [normal(raw[a:s].decode("utf-8", "replace")).encode(), raw[s:e]]
            size += len(out[-2])
            marks.append((size, size + e - s))
            size += e - s
            a, at = e, at + 1
        out.append(normal(raw[a:b].decode("utf-8", "replace")).encode())
        size += len(out[-1])
        bounds.append(size)
    return np.frombuffer(b"".join(out), np.uint8), np.array(bounds), marks


def blocks(batches: Iterator[pa.RecordBatch], path: str, partition: int = 0) -> Iterator[tuple[bytes, list[bytes], pa.Array, np.ndarray, np.ndarray]]:
    """Key, distinct words, document ids, words per document and word numbers of each block.

    The key is a hash of the partition, the block's number in it and its words: no two blocks share one, also not of equal words.
    """
    whole = special_strings(path)
    table: dict[bytes, int] = {}
    ids, sizes, numbers, held, closed = [], [], [], 0, 0

    def close():
        words = list(table)
        key = hashlib.blake2b(b"%d %d " % (partition, closed) + b" ".join(words), digest_size=16).digest()
        return key, words, pa.concat_arrays(ids), np.concatenate(sizes), np.concatenate(numbers)

    for batch in batches:
        for part, data, offsets in chunks(batch, "text"):
            if ids and held + len(data) > BLOCK_BYTES:
                yield close()
                table, ids, sizes, numbers, held, closed = {}, [], [], [], 0, closed + 1
            data, offsets, marks = normalized(data, offsets, whole)
            begins, ends, of = split(data, offsets, "word", marks)
            number, words = distinct(data, begins, ends)
            own = np.array([table.setdefault(w, len(table)) for w in words], np.uint32)
            ids.append(part.column("id"))
            sizes.append(np.diff(of).astype(np.uint32))
            numbers.append(own[number] if words else np.zeros(0, np.uint32))
            held += len(data)
    if ids:
        yield close()


def encode_decode(docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per document: its id, ids (binary: little-endian unsigned 32-bit integers) and decoded (string).

    path: a BPE file of the tokenizers library with word ends and no decoder, at the same place on all
    executors. ids are those of the library without added special tokens, decoded is the library's
    decode(ids, skip_special_tokens=False).
    """
    spark = docs.sparkSession
    buckets = max(64, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).cast("string").alias("text"))

    def word_lists(batches):
        for key, words, *_ in blocks(batches, path, TaskContext.get().partitionId()):
            parts: dict[int, list[bytes]] = {}
            for w in words:
                parts.setdefault(zlib.crc32(w) % buckets, []).append(w)
            yield pa.RecordBatch.from_arrays([pa.array([key] * len(parts), pa.binary()), pa.array(list(parts), pa.int32()), pa.array([zstandard.compress(b" ".join(x), 3) for x in parts.values()], pa.binary())], names=["block", "bucket", "words"])

    def encoded(batches):
        """Rows come bucket by bucket; each distinct word of a bucket is encoded once."""
        t, known, at = tokenizer(path), {}, None
        for batch in batches:
            for block, bucket, packed in zip(*(batch.column(c).to_pylist() for c in ("block", "bucket", "words"))):
                if bucket != at:
                    known, at = {}, bucket
                words = zstandard.decompress(packed).split(b" ")
                new = [w for w in words if w not in known]
                for w, e in zip(new, t.encode_batch_fast([w.decode() for w in new], add_special_tokens=False)):
                    known[w] = np.array(e.ids, "<u4").tobytes()
                found = [known[w] for w in words]
                sizes = np.array([len(x) // 4 for x in found], "<u4").tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.binary()), pa.array([bucket], pa.int32()), pa.array([zstandard.compress(sizes + b"".join(found), 3)], pa.binary())], names=["block", "bucket", "ids"])

    def numbered(batches):
        for key, words, ids, sizes, numbers in blocks(batches, path, TaskContext.get().partitionId()):
            in_bucket = np.array([zlib.crc32(w) % buckets for w in words], np.uint32)
            payload = b"".join(np.ascontiguousarray(x, "<u4").tobytes() for x in (sizes, in_bucket, numbers))
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([len(words)], pa.int64()), pa.array([ids.to_pylist()], pa.list_(pa.int64())), pa.array([zstandard.compress(payload, 3)], pa.binary())], names=["block", "n_words", "doc_ids", "numbers"])

    lists = rows.select(F.lit(0).cast("long").alias("id"), "text").mapInArrow(word_lists, "block binary, bucket int, words binary")
    ids = lists.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(encoded, "block binary, bucket int, ids binary")
    own = rows.mapInArrow(numbered, "block binary, n_words long, doc_ids array<long>, numbers binary")

    def joined(left: pa.Table, right: pa.Table) -> pa.Table:
        out, names = [], pieces(path)
        by_bucket = dict(zip(right.column("bucket").to_pylist(), right.column("ids").to_pylist()))
        for n_words, doc_ids, packed in zip(*(left.column(c).to_pylist() for c in ("n_words", "doc_ids", "numbers"))):
            values = np.frombuffer(zstandard.decompress(packed), "<u4")
            n, sizes = len(doc_ids), values[: len(doc_ids)].astype(np.int64)
            in_bucket, numbers = values[n : n + n_words], values[n + n_words :]
            start, length, table, size = np.empty(n_words, np.int64), np.empty(n_words, np.int64), [], 0
            order = np.argsort(in_bucket, kind="stable")
            edges = np.flatnonzero(np.diff(in_bucket[order], prepend=np.uint32(2**32 - 1))) if n_words else []
            for a, b in zip(edges, [*edges[1:], n_words]):
                bucket = int(in_bucket[order[a]])
                if bucket not in by_bucket:
                    raise ValueError("a block's words have changed between two reads of the input")
                own = np.frombuffer(zstandard.decompress(by_bucket[bucket]), "<u4")
                length[order[a:b]] = own[: b - a]
                start[order[a:b]] = size + np.cumsum(own[: b - a], dtype=np.int64) - own[: b - a]
                table.append(own[b - a :])
                size += len(table[-1])
            flat = np.concatenate(table) if table else np.zeros(0, "<u4")
            ends = np.concatenate([[0], np.cumsum(sizes)])
            at = 0
            while at < n:
                to = max(at + 1, int(np.searchsorted(ends, ends[at] + OUT_BYTES // 8, "right")) - 1)
                mine = numbers[ends[at] : ends[to]]
                found = flat[ragged(start[mine], length[mine])]
                bounds = np.concatenate([[0], np.cumsum(length[mine])])[ends[at : to + 1] - ends[at]]
                words = list(map(names.__getitem__, found.tolist()))
                cuts = list(zip(bounds[:-1].tolist(), bounds[1:].tolist()))
                out.append(pa.RecordBatch.from_arrays([pa.array(doc_ids[at:to], pa.int64()), pa.array([found[a:b].astype("<u4").tobytes() for a, b in cuts], pa.binary()), pa.array([" ".join(words[a:b]) for a, b in cuts], pa.string())], names=["id", "ids", "decoded"]))
                at = to
        return pa.Table.from_batches(out, schema=pa.schema([("id", pa.int64()), ("ids", pa.binary()), ("decoded", pa.string())]))

    result = own.groupBy("block").cogroup(ids.groupBy("block")).applyInArrow(joined, "id long, ids binary, decoded string")
    return result.withColumnRenamed("id", id_column)
