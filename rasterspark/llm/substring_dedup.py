"""Substring dedup over words: difference-cover anchors, then extension.

Words are runs of bytes other than ASCII white space, unchanged. A window of `width` words (20) is a
repeat if the same words start earlier: in a document of smaller doc_id, or earlier in the same one.

Anchors: D = {0, 1, 3, 9} is a difference cover modulo 13: for any two places i and j there is a
shift s below 13 with i + s and j + s both in D modulo 13. So two equal windows of 13 + 8 - 1 = 20
words share an aligned anchor: an 8-word run that begins at a cover position of both. Only the
runs at cover positions (4 of 13) are hashed and grouped (by 48 bits: a chance match only costs an
extension in vain).

Extension: documents meet their anchors that occur more than once. Every window that contains one
is hashed as a whole and these hashes are grouped again, each with its earliest place; all later
places are repeats. These hashes are BLAKE2b digests of 128 bits of the window's words, so windows of
different words are not taken for equal: the anchors' cheap polynomial hashes only propose. The
places come back to their documents, whose words covered by a repeat go.

A text of over `BLOCK` bytes is read block by block, cut between words, with the last words of a block carried
into the next, so besides the text itself a task holds one block and the places found so far. A word of over
`BLOCK` bytes stands for its digest there.

Hashes travel as packed arrays, one row for each batch and bucket of hash values, in as many buckets
as the text needs for a bucket to fit in memory. A batch first groups its own hashes: of a hash that
it holds often, one place (the earliest) goes to the hash's bucket; the others are already known to be
repeats and are dealt out evenly. A hash that is in a third of all documents thus costs a bucket one
entry a batch. Places are gathered to one row a document and joined to the documents by doc_id, so
texts pass through tasks as streams of rows and are never gathered.

Null texts have no words; texts of fewer words than a window keep all. Identical rows count as one
document: none is earlier than the other, and both get the same result. Rows with one doc_id but
different texts are judged together too: what is a repeat at a place of one goes at that place of
all. Rows with a null doc_id take no part and keep everything. An empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterspark.llm.common import buckets, chunks, first_equal, pack, posting_rows, posting_schema, split_runs, texts_of, unpack
from rasterspark.llm.hashing import byte_values, mix, prefix, spans, windows, word_bounds

PERIOD, COVER, RUN = 13, (0, 1, 3, 9), 8
_IN_COVER = np.isin(np.arange(PERIOD), COVER)
BLOCK = 1 << 20
_SPACE = re.compile(rb"[ \t-\r]")


def word_blocks(text: bytes):
    """The words of a text, in lists of about BLOCK bytes."""
    start = 0
    while start < len(text):
        cut = _SPACE.search(text, min(start + BLOCK, len(text)))
        end = cut.start() if cut else len(text)
        yield text[start:end].split()
        start = end


def carried(text: bytes, width: int):
    """(number of the first word, words) by blocks, each after the last width - 1 words of the one before: every
    window of that width lies in exactly one of them.
    """
    held, base = [], 0
    for words in word_blocks(text):
        held += words
        yield base, held
        keep = held[max(0, len(held) - width + 1) :]
        base, held = base + len(held) - len(keep), keep


def near(places: np.ndarray, before: int, after: int, start: int, end: int) -> np.ndarray:
    """Which of the numbers from start to end lie within [p - before, p + after] of one of the sorted places."""
    own = places[np.searchsorted(places, start - after) : np.searchsorted(places, end + before)].astype(np.int64)
    edge = np.zeros(end - start + 1, np.int32)
    np.add.at(edge, np.maximum(own - before - start, 0), 1)
    np.add.at(edge, np.minimum(own + after + 1 - start, end - start), -1)
    return np.cumsum(edge)[:-1] > 0


class Words:
    """The words of some documents, one after the other: their hashes, and each document's first word."""

    def __init__(self, texts: list[bytes]):
        data = np.frombuffer(b"\n".join(texts), np.uint8)
        self.start, self.end = word_bounds(data)
        begin = np.cumsum([0] + [len(t) + 1 for t in texts])
        self.first = np.searchsorted(self.start, begin)
        self.hash = spans(prefix(byte_values()[data]), self.start, self.end) if len(self.start) else np.zeros(0, np.uint64)
        count = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(texts)), count)
        self.place = np.arange(len(self.hash)) - self.first[self.doc]
        self.left = count[self.doc] - self.place  # words from here to the document's end
        self.runs = prefix(self.hash)

    def of(self, width: int) -> np.ndarray:
        """Hash of the window at each word; meaningless where it would pass the end of the data."""
        out = np.zeros(len(self.hash), np.uint64)
        found = windows(self.runs, width)
        out[: len(found)] = found
        return out


def _digests(text: bytes, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two halves of the 128-bit digest of each stretch of the text."""
    view = memoryview(text)
    found = b"".join([hashlib.blake2b(view[a:b], digest_size=16).digest() for a, b in zip(start.tolist(), end.tolist())])
    return tuple(np.frombuffer(found, "<u8").reshape(-1, 2).T)


def _thin(h: np.ndarray, g: np.ndarray, doc: np.ndarray, word: np.ndarray):
    """Distinct rows ordered by (hash, place); which is the first of its hash, and of which hash there are more."""
    order, group = first_equal(h, g, doc, word)
    order = order[np.flatnonzero(np.diff(group, prepend=-1))]
    h, g = h[order], g[order]
    first = np.ones(len(h), bool)
    first[1:] = (h[1:] != h[:-1]) | (g[1:] != g[:-1])
    size = np.diff(np.append(np.flatnonzero(first), len(h)))
    return order, first, np.repeat(size > 1, size)


def _dealt(n: int, h: np.ndarray, g: np.ndarray, doc: np.ndarray, word: np.ndarray) -> pa.RecordBatch:
    """Posting rows of a batch: first places to their hash's bucket, the others anywhere, marked as known."""
    order, first, many = _thin(h, g, doc, word)
    h, g, doc, word = h[order], g[order], doc[order], word[order]
    state = np.where(first, many, 2).astype(np.uint8)
    where = np.where(first, h, mix(h + word.astype(np.uint64) + doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    near = np.lexsort((word, doc))  # places that follow each other compress
    return posting_rows((where % np.uint64(n)).astype(np.int32)[near], h=h[near], g=g[near], doc=doc[near], word=word[near], state=state[near])


POSTINGS = posting_schema("h", "g", "doc", "word", "state")
PLACES = posting_schema("doc", "word")


def _doc_bucket(doc: np.ndarray, n: int) -> np.ndarray:
    return (mix(doc.view(np.uint64)) % np.uint64(n)).astype(np.int32)


def _repeated(postings: DataFrame, n: int, all_places: bool) -> DataFrame:
    """Places of hashes that occur more than once: all of them, or all but each hash's earliest.

    The result has one row for each document: doc, and the packed word numbers.
    """

    def run(group: pa.Table) -> pa.Table:
        h, g, doc, word = unpack(group, "h", np.uint64), unpack(group, "g", np.uint64), unpack(group, "doc", np.int64), unpack(group, "word", np.int32)
        state = unpack(group, "state", np.uint8)
        open_ = state < 2
        order, first, many = _thin(h[open_], g[open_], doc[open_], word[open_])
        do, wo = doc[open_], word[open_]
        if all_places:  # a hash repeats if two batches have it, or one batch has it often
            start = np.flatnonzero(first)
            often = np.maximum.reduceat(state[open_][order], start) > 0 if len(start) else np.zeros(0, bool)
            keep = many | np.repeat(often, np.diff(np.append(start, len(order))))
        else:
            keep = ~first
        d, w = np.concatenate([do[order][keep], doc[~open_]]), np.concatenate([wo[order][keep], word[~open_]])
        return pa.Table.from_batches([posting_rows(_doc_bucket(d, n), doc=d, word=w)])

    def gather(group: pa.Table) -> pa.Table:
        doc, word = unpack(group, "doc", np.int64), unpack(group, "word", np.int32)
        order = np.argsort(doc, kind="stable")
        doc, word = doc[order], word[order]
        cuts = list(split_runs(doc))
        return pa.table({"_doc": pa.array([doc[a] for a, _ in cuts], pa.int64()), "_listed": pa.array([pack(word[a:b]) for a, b in cuts], pa.binary())})

    places = postings.groupBy("bucket").applyInArrow(run, PLACES)
    return places.groupBy("bucket").applyInArrow(gather, "_doc long, _listed binary")


def _ids(batch) -> tuple[np.ndarray, np.ndarray]:
    column = batch.column("doc_id")
    known = ~column.is_null().to_numpy(zero_copy_only=False)
    return column.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), known


def listed(batch: pa.RecordBatch, row: int) -> np.ndarray:
    """The places that were joined to a row, in order; none if there is no such row."""
    held = batch.column("_listed")[row]
    return np.sort(np.ascontiguousarray(np.frombuffer(held.as_py(), np.uint8).reshape(4, -1).T).view(np.int32).reshape(-1)) if held.is_valid else np.zeros(0, np.int32)


def with_places(docs: DataFrame, places: DataFrame) -> DataFrame:
    """All documents, and the packed places of each."""
    return docs.join(places, F.col("doc_id") == F.col("_doc"), "left").drop("_doc")


def repeats(docs: DataFrame, width: int = 20) -> DataFrame:
    """(doc_id long, text binary, ...) -> (_doc, _listed): the places of repeated windows of each document that has any.

    All columns go to the tasks, so that Spark can use one shuffle of docs here and in `remove`.
    """
    if width != PERIOD + RUN - 1:
        raise ValueError(f"the cover is made for windows of {PERIOD + RUN - 1} words")
    n = buckets(docs)

    def anchored(w: Words, place: np.ndarray, allowed: np.ndarray, ids: np.ndarray):
        at = np.flatnonzero(_IN_COVER[place % PERIOD] & (w.left >= RUN) & allowed)
        return w.of(RUN)[at] >> np.uint64(16), np.zeros(len(at), np.uint64), ids[w.doc[at]], place[at].astype(np.int32)

    def anchors(batches):
        for batch in batches:
            texts = texts_of(batch)
            ids, known = _ids(batch)
            found = []
            for a, b in chunks([len(t) for t in texts], BLOCK):
                if len(texts[a]) <= BLOCK:
                    w = Words(texts[a:b])
                    found.append(anchored(w, w.place, (w.place + w.left >= width) & known[a:b][w.doc], ids[a:b]))
                    continue
                for base, words in carried(texts[a], RUN) if known[a] else ():
                    w = Words([b" ".join(x if len(x) <= BLOCK else b"\xff" + hashlib.sha256(x).digest().hex().encode() for x in words)])
                    yield _dealt(n, *anchored(w, w.place + base, np.ones(len(w.hash), bool), ids[a:b]))
            if found:
                yield _dealt(n, *(np.concatenate(x) for x in zip(*found)))

    def extended(batches):
        for batch in batches:
            rows = np.flatnonzero(batch.column("_listed").is_valid().to_numpy(zero_copy_only=False)).tolist()
            if not rows:
                continue
            ids, _ = _ids(batch)
            texts = batch.column("text")
            found, held = [], 0
            for i in rows:
                places = listed(batch, i)
                for base, words in carried(texts[i].as_py() or b"", width):
                    if len(words) < width:
                        continue
                    # windows that contain a listed run start 12 words before it at most; a place may come from a longer text of the same doc_id
                    at = np.flatnonzero(near(places, PERIOD - 1, 0, base, base + len(words) - width + 1))
                    if not len(at):
                        continue
                    # joined by one space, windows of equal words are equal bytes
                    end = np.cumsum([len(w) + 1 for w in words]) - 1
                    start = np.concatenate([[0], end[:-1] + 1])
                    h, g = _digests(b" ".join(words), start[at], end[at + width - 1])
                    found.append((h, g, np.full(len(at), ids[i]), (at + base).astype(np.int32)))
                    held += len(at)
                    if held >= 1 << 20:
                        yield _dealt(n, *(np.concatenate(x) for x in zip(*found)))
                        found, held = [], 0
            if found:
                yield _dealt(n, *(np.concatenate(x) for x in zip(*found)))

    plain = docs.select("doc_id", "text")
    places = _repeated(plain.mapInArrow(anchors, POSTINGS), n, all_places=True)
    return _repeated(with_places(docs, places).mapInArrow(extended, POSTINGS), n, all_places=False)


ADDED = ("n_words", "n_removed", "kept_sha256")


def remove(docs: DataFrame, width: int = 20, with_text: bool = True) -> DataFrame:
    """All columns of documents, and n_words, n_removed, kept_sha256 (of the kept words, joined by a space).

    With with_text, a text that lost words is its kept words joined by a space; any other is as it
    was. Without, text is left out. Input columns of the new names, _doc and _listed are dropped.
    """
    docs = docs.drop("_doc", "_listed", *ADDED).withColumn("doc_id", F.col("doc_id").cast("long")).withColumn("text", F.col("text").cast("binary"))
    others = [c for c in docs.columns if c != "text"]

    def kept(batches):
        for batch in batches:
            out = []
            for i, text in enumerate(batch.column("text").to_pylist()):
                starts, sha, parts, total, left = listed(batch, i), hashlib.sha256(), [], 0, 0
                for words in word_blocks(text or b""):
                    stay = words
                    if len(starts):
                        stay = [words[k] for k in np.flatnonzero(~near(starts, 0, width - 1, total, total + len(words)))]
                    total, left = total + len(words), left + len(stay)
                    if stay:
                        part = b" " * bool(parts) + b" ".join(stay)
                        sha.update(part)
                        parts.append(part if with_text else b" ")
                out.append((total, total - left, sha.hexdigest(), b"".join(parts) if left < total else text))
            n, gone, sha, text = zip(*out) if out else ((), (), (), ())
            columns = [*(batch.column(c) for c in others), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha, pa.string())]
            if with_text:
                columns.append(pa.array([None if x is None else x.decode("utf-8", "replace") for x in text], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names=[*others, *ADDED, *["text"] * with_text])

    kinds = dict(docs.dtypes)
    schema = ", ".join([f"`{c}` {kinds[c]}" for c in others] + ["n_words long, n_removed long, kept_sha256 string"] + ["text string"] * with_text)
    return with_places(docs, repeats(docs, width)).select(*docs.columns, "_listed").mapInArrow(kept, schema)
