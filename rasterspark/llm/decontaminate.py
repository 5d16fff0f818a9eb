"""Benchmark decontamination with one Aho-Corasick automaton.

Words are runs of ASCII letters, digits and non-ASCII bytes, A-Z lowered. A window is `width`
consecutive words of a benchmark item (an item with fewer words, but not none, is one window). All
windows, joined by one space and framed by spaces, go into one automaton; every document is
normalised the same way and scanned once. The end of a match is mapped back to word numbers and, in
`spans`, to byte offsets of the original text.

The windows are made and grouped by tasks and read from them partition by partition. Blocks of about
`block_bytes` of windows become one automaton each; one block at a time is held by the driver and
broadcast, so memory does not grow with the benchmark. A benchmark of one block, the usual case, takes
one scan of the documents; with more, what is found so far is written beside the documents in the
shared folder after every block but the last. Documents aren't shuffled.

Null and empty texts have no words; repeated benchmark items count under each item_id; items with a
null item_id are ignored, as are other columns, whatever their names. Rows that repeat a doc_id are each
scanned. An empty documents table gives an empty one; an empty benchmark leaves all documents clean. A
long text is scanned whole, in one task.
"""

from __future__ import annotations

import hashlib

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterspark.llm.common import scratch, texts_of

#: Byte for byte: A-Z lowered, separators to spaces, the rest as it is.
NORMAL = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words(text: bytes) -> list[bytes]:
    return text.translate(NORMAL).split()


def windows(text: bytes, width: int) -> set[bytes]:
    w = words(text)
    return {b" ".join(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def item_windows(benchmark: DataFrame, width: int, block_bytes: int):
    """Window -> item ids, in blocks of about block_bytes, one after the other; at least one."""

    def run(batches):
        for batch in batches:
            out = [(i, w) for i, x in zip(batch.column("item_id").to_pylist(), texts_of(batch)) for w in windows(x, width)]
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in out], pa.string()), pa.array([w for _, w in out], pa.binary())], names=["item_id", "window"])

    rows = benchmark.filter("item_id is not null").select(F.col("item_id").cast("string"), F.col("text").cast("binary").alias("text")).mapInArrow(run, "item_id string, window binary")
    grouped = rows.groupBy("window").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    block, size = {}, 0
    for row in grouped.toLocalIterator():
        if size > block_bytes:
            yield block
            block, size = {}, 0
        block[bytes(row.window)] = row["items"]
        size += len(row.window) + sum(map(len, row["items"]))
    yield block


def automaton(block: dict[bytes, list[str]]):
    out = ahocorasick.Automaton()
    for window, items in block.items():
        out.add_word(f" {window.decode('latin-1')} ", (window.count(b" ") + 1, items))
    if block:
        out.make_automaton()
    return out


def matches(found, text: bytes) -> tuple[int, list[tuple[int, int]], set[str]]:
    """Number of words, places (first word, end) of windows, and items with a window in the text."""
    w = words(text)
    if not w or not len(found):
        return len(w), [], set()
    places, items, starts = [], set(), None
    for end, (n, ids) in found.iter(f" {b' '.join(w).decode('latin-1')} "):
        if starts is None:
            starts = np.cumsum([0] + [len(x) + 1 for x in w])
        last = int(np.searchsorted(starts, end))  # the match ends with the space before this word
        places.append((last - n, last))
        items.update(ids)
    return len(w), places, items


def spans(text: bytes, places: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Byte offsets in the original text of the merged places."""
    kept = np.frombuffer(text.translate(NORMAL), np.uint8) != 32
    edge = np.diff(np.concatenate([[0], kept.astype(np.int8), [0]]))
    first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    out: list[tuple[int, int]] = []
    for a, b in sorted(places):
        x, y = int(first[a]), int(last[b - 1])
        if out and x <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], y))
        else:
            out.append((x, y))
    return out


def _merged(places: list[tuple[int, int]]) -> list[list[int]]:
    """Disjoint (first word, end), in order."""
    out: list[list[int]] = []
    for a, b in sorted(places):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


_FOUND = "_places array<array<int>>, _items array<string>"
_PAIRS = pa.list_(pa.list_(pa.int32()))


def _scanned(docs: DataFrame, block: dict[bytes, list[str]]) -> DataFrame:
    """(doc_id, text, _places, _items) with what the block adds to the last two."""
    held = docs.sparkSession.sparkContext.broadcast(block)

    def run(batches):
        found = automaton(held.value)
        for batch in batches:
            places, items = [], []
            for text, p, i in zip(texts_of(batch), batch.column("_places").to_pylist(), batch.column("_items").to_pylist()):
                _, more, names = matches(found, text)
                places.append(_merged([*map(tuple, p), *more]) if more else p)
                items.append(sorted(names | set(i)) if names else i)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text"), pa.array(places, _PAIRS), pa.array(items, pa.list_(pa.string()))], names=["doc_id", "text", "_places", "_items"])

    return docs.mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, text binary, {_FOUND}")


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = 10, block_bytes: int = 32 << 20) -> DataFrame:
    """documents, benchmark -> doc_id, n_words, n_hit, n_items, items (sorted), spans, contaminated.

    spans: start and end, in bytes of the original text, of each stretch of hit words.
    """
    state = docs.select("doc_id", F.col("text").cast("binary").alias("text"), F.array().cast("array<array<int>>").alias("_places"), F.array().cast("array<string>").alias("_items"))
    blocks = item_windows(benchmark, width, block_bytes)
    block = next(blocks)
    for after in blocks:
        state, block = scratch(_scanned(state, block)), after

    def run(batches):
        for batch in batches:
            texts, places = texts_of(batch), batch.column("_places").to_pylist()
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([len(words(x)) for x in texts], pa.int64()),
                    pa.array([sum(b - a for a, b in p) for p in places], pa.int64()),
                    pa.array([len(i) for i in batch.column("_items").to_pylist()], pa.int64()),
                    batch.column("_items"),
                    pa.array([spans(x, p) if p else [] for x, p in zip(texts, places)], pa.list_(pa.list_(pa.int64()))),
                ],
                names=["doc_id", "n_words", "n_hit", "n_items", "items", "spans"],
            )

    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, n_words long, n_hit long, n_items long, items array<string>, spans array<array<bigint>>"
    return _scanned(state, block).mapInArrow(run, schema).withColumn("contaminated", F.col("n_hit") > 0)


def clean(docs: DataFrame, benchmark: DataFrame, width: int = 10, block_bytes: int = 32 << 20) -> DataFrame:
    """The documents without any window of the benchmark, with all their columns, unshuffled."""

    def without(docs: DataFrame, block: dict[bytes, list[str]]) -> DataFrame:
        held = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches):
            found = automaton(held.value)
            for batch in batches:
                texts = (x.encode() if isinstance(x, str) else x or b"" for x in batch.column("text").to_pylist())
                yield batch.filter(pa.array([not matches(found, x)[1] for x in texts], pa.bool_()))

        return docs.mapInArrow(run, docs.schema)

    blocks = item_windows(benchmark, width, block_bytes)
    block = next(blocks)
    for after in blocks:
        docs, block = scratch(without(docs, block)), after
    return without(docs, block)


def items_sha256(items: list[str]) -> str:
    return hashlib.sha256(",".join(items).encode()).hexdigest()
