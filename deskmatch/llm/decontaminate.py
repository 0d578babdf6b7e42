"""Benchmark decontamination by pigeonhole edit matching.

Texts and test items are normalised: lower case, runs of letters, digits and underscores, one blank
between them and at both ends, so that an item meets whole words: the blanks at its ends count as its other
characters do, and a short item never stands inside a word. An item that occurs with at most k edits, cut into k + 1 pieces, has a piece that occurs
unedited. An Aho-Corasick automaton of all pieces finds the exact piece hits in a pass over each text;
a window around each hit is verified with Myers' bit-parallel edit distance.

Items are dealt by hash to blocks of about BLOCK_CHARS characters, written to the shared folder, where each
task reads its block, so neither a task nor the driver holds more than a block. All blocks are searched in
one job, each over all documents. Nothing is shuffled but the items.

Defined cases: null texts are empty; items without a normalised character, or null, match nothing;
repeated items and repeated documents give a row each; a null document or item id stays null; empty
tables give an empty result; other columns are ignored whatever their names; long texts are searched
whole. Of equally good places the first counts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, fresh, whole_text, work_dir

#: Edits allowed for each character of an item, and characters of items in a block.
EDIT_RATE = 0.05
BLOCK_CHARS = 2_000_000
#: Shorter items have to occur unedited.
LEAST_CHARS = 40
HITS = "doc_id long, item_id long, distance int, at int, until int"


def normal(text: str | None) -> str:
    return " ".join(re.findall(r"\w+", (text or "").lower()))


def edged(words: str) -> str:
    """Normalised words with a blank at either end."""
    return f" {words} "


def budget(item: str, rate: float) -> int:
    """Edits that a normalised item, without blanks at its ends, may have."""
    return int(len(item) * rate) if len(item) >= LEAST_CHARS else 0


def cut_pieces(item: str, edits: int) -> list[tuple[int, str]]:
    """edits + 1 pieces of nearly equal length with their places."""
    bounds = [len(item) * i // (edits + 1) for i in range(edits + 2)]
    return [(a, item[a:b]) for a, b in zip(bounds, bounds[1:])]


def best_end(pattern: str, text: str) -> tuple[int, int]:
    """Myers: the least edit distance between pattern and any substring of text, and the first end of such a substring."""
    size = len(pattern)
    full, top = (1 << size) - 1, 1 << size - 1
    where: dict[str, int] = {}
    for i, c in enumerate(pattern):
        where[c] = where.get(c, 0) | 1 << i
    plus, minus, score, best, end = full, 0, size, size, 0
    for j, c in enumerate(text, 1):
        eq = where.get(c, 0)
        diagonal = ((((eq & plus) + plus) ^ plus) | eq | minus) & full
        up, down = (minus | ~(diagonal | plus)) & full, plus & diagonal
        score += bool(up & top) - bool(down & top)
        up, down = up << 1 & full, down << 1 & full
        eq |= minus
        plus, minus = (down | ~(eq | up)) & full, up & eq
        if score < best:
            best, end = score, j
    return best, end


class Block:
    """The pieces of a block of items in one automaton."""

    def __init__(self, items: list[tuple[int | None, str]], rate: float):
        import ahocorasick

        self.items, self.edits = items, [budget(item, rate) for _, item in items]
        places: dict[str, list[tuple[int, int]]] = {}
        for n, (_, item) in enumerate(items):
            for at, piece in cut_pieces(edged(item), self.edits[n]):
                places.setdefault(piece, []).append((n, at))
        self.automaton = ahocorasick.Automaton()
        for piece, found in places.items():
            self.automaton.add_word(piece, (len(piece), found))
        self.automaton.make_automaton()

    def matches(self, text: str) -> list[tuple[int, int, int, int]]:
        """Number of the item, distance, start and end of the best place of each item within its budget in a normalised text."""
        if not self.items:
            return []
        text, starts = edged(text), {}
        for end, (size, found) in self.automaton.iter(text):
            for n, at in found:
                starts.setdefault(n, set()).add(end + 1 - size - at)
        out = []
        for n, found in starts.items():
            item, edits, best = edged(self.items[n][1]), self.edits[n], None
            for a, b in windows(sorted(found), len(item), edits, len(text)):
                distance, end = best_end(item, text[a:b])
                if distance <= edits and (best is None or distance < best[0]):
                    back = best_end(item[::-1], text[a : a + end][::-1])[1]
                    best = distance, a + end - back, a + end
            if best:
                distance, a, b = best
                out.append((n, distance, a + (text[a] == " ") - 1, b - (text[b - 1] == " ") - 1))
        return sorted(out)


def windows(starts: list[int], size: int, edits: int, end: int) -> list[tuple[int, int]]:
    """Stretches in which the item may lie that begins about at one of starts; overlapping ones are one."""
    out: list[list[int]] = []
    for s in starts:
        a, b = max(0, s - edits), min(end, s + size + edits)
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def item_blocks(items: DataFrame, id_column: str, text_column: str, most: int) -> tuple[str, int]:
    """Writes the normalised items, in a folder for each block, and returns where, and the number of blocks."""
    spark, folder = items.sparkSession, work_dir(items.sparkSession, "items")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            item = [normal(x) for x in batch.column("text").to_pylist()]
            rows = pa.RecordBatch.from_arrays([batch.column("id"), pa.array(item, pa.string())], names=["id", "item"])
            yield rows.filter(pa.array([bool(x) for x in item], pa.bool_()))

    rows = cut(items.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).cast("string").alias("text")).mapInArrow(run, "id long, item string"), "normal")
    blocks = -(-(rows.agg(F.sum(F.length("item"))).first()[0] or 0) // most)
    if blocks:
        rows.withColumn("block", F.pmod(F.xxhash64("item"), F.lit(blocks)).cast("int")).repartition("block").write.partitionBy("block").parquet(folder)
    return folder, blocks


def block_items(folder: str, block: int) -> list[tuple[int | None, str]]:
    """The items of a block, read in a task."""
    from pyarrow import dataset, fs

    store, place = fs.FileSystem.from_uri(f"{folder}/block={block}")
    if store.get_file_info(place).type == fs.FileType.NotFound:
        return []
    rows = dataset.dataset(place, filesystem=store, format="parquet").to_table(["id", "item"])
    return sorted(zip(rows.column("id").to_pylist(), rows.column("item").to_pylist()), key=lambda x: (x[1], x[0] is not None, x[0] or 0))


def hits(rows: DataFrame, kind: str, items: DataFrame, rate: float, item_id_column: str, item_text_column: str, block_chars: int) -> DataFrame:
    """What contaminated gives, for rows of id (of a kind: long or string) and text."""
    schema = HITS.replace("doc_id long", f"doc_id {kind}")
    folder, blocks = item_blocks(items, item_id_column, item_text_column, block_chars)

    def search(block: int) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = Block(block_items(folder, block), rate)
            names = [("doc_id", pa.int64() if kind == "long" else pa.string()), ("item_id", pa.int64()), ("distance", pa.int32()), ("at", pa.int32()), ("until", pa.int32())]
            for batch in batches:
                found = [(i.as_py(), own.items[n][0], d, a, b) for i, t in zip(batch.column("id"), batch.column("text")) for n, d, a, b in own.matches(normal(t.as_py()))]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in found], kind) for k, (_, kind) in enumerate(names)], schema=pa.schema(names))

        return rows.mapInArrow(run, schema)

    return reduce(DataFrame.unionByName, map(search, range(blocks))) if blocks else rows.sparkSession.createDataFrame([], schema)


def contaminated(docs: DataFrame, items: DataFrame, rate: float = EDIT_RATE, id_column: str = "doc_id", text_column: str = "text", item_id_column: str = "item_id", item_text_column: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row for each document and item that occurs in it with at most rate edits a character: doc_id, item_id, distance, at and until (characters of the normalised text)."""
    rows = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).cast("string").alias("text"))
    return hits(rows, "long", items, rate, item_id_column, item_text_column, block_chars)


def clean(docs: DataFrame, items: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The documents, all columns, in which no item occurs. The verdict is on the text, so null and repeated ids are judged as all others."""
    sha, name = F.sha2(whole_text(text_column), 256), fresh(docs, "_gone")
    found = hits(docs.select(sha.alias("id"), F.col(text_column).cast("string").alias("text")), "string", items, EDIT_RATE, "item_id", "text", BLOCK_CHARS)
    return docs.join(found.select(F.col("doc_id").alias(name)).distinct(), sha == F.col(name), "left_anti")
