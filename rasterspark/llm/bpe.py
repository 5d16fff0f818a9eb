"""BPE encoding and decoding through a table of distinct words.

Split: each task splits its texts into words (the vocabulary file's normaliser and pre-tokeniser) and
gathers documents of about `chunk_bytes` of text into a chunk: the chunk's distinct words, and for every
position the number of its word. Chunks are written once, so what follows reads the same ones after a
lost executor.

Encode: the distinct words of all chunks are dealt by their hash, and each different word is encoded
once, where all its chunks meet. A word comes from a chunk once however often the chunk has it, so a
word of a third of all places costs its bucket one entry a chunk.

Join back: the ids go back to their chunk, in the order of its words, and from there to the positions.

Decode: the distinct ids of each chunk are joined with the table of pieces (id, piece), which has as many
rows as the vocabulary and is broadcast; the pieces go to the positions likewise.

The words and the order of merges are those of the tokenizers library. Texts of characters whose classes
are the same in all versions of Unicode since 5.2 (`_SAFE`) are split here; other texts are given to the
library's own normaliser and pre-tokeniser, so that its version of Unicode counts.

Null texts are empty: no ids. A long text is split block by block; its word numbers (4 bytes a word) and
its ids must fit in a task. Repeated doc_ids are encoded each, null ones too. Other columns are ignored,
whatever their names. An empty table gives an empty one.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
import re
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterspark.llm.common import buckets, pack, scratch

#: Whole alphabets that no version of Unicode has added to or reclassed since 5.2.
_SAFE = [*range(0x530), *range(0x1E00, 0x1F00), *range(0x2000, 0x2065)]
_SPACES = "\\t-\\r \\x85\\xa0\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f"
#: The one pattern that is split here, as the vocabulary file has it (fixed value).
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
BLOCK = 1 << 20


def _ranges(codes, kind: str) -> str:
    """A character class of the codes of one major category."""
    held = [c for c in sorted(codes) if unicodedata.category(chr(c))[0] == kind]
    ends = [i for i, c in enumerate(held) if i + 1 == len(held) or held[i + 1] != c + 1]
    starts = [0, *(i + 1 for i in ends[:-1])]
    return "".join(f"\\u{held[a]:04x}-\\u{held[b]:04x}" for a, b in zip(starts, ends))


@functools.lru_cache(maxsize=None)
def _plain_patterns():
    lowered = {ord(x) for c in _SAFE for x in chr(c).lower()} | set(_SAFE)
    letters, numbers = _ranges(lowered, "L"), _ranges(lowered, "N")
    word = re.compile(f"[{letters}]+|'(?:s|t|re|ve|m|ll|d)|[{numbers}]|[^{_SPACES}{letters}{numbers}]+")
    return re.compile("[\\x00-\\u052f\\u1e00-\\u1eff\\u2000-\\u2064]*"), word


class Vocabulary:
    """A vocabulary file of kind BPE: how it splits texts, encodes a word, and names its pieces."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            held = json.load(f)
        model = held["model"]
        odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "fuse_unk", "byte_fallback", "ignore_merges") if model.get(k)]
        if model["type"] != "BPE" or odd or held.get("decoder") or held.get("post_processor"):
            raise ValueError(f"not supported in a vocabulary: {odd or 'a model other than BPE, a decoder or a post-processor'}")
        if any(x["single_word"] or x["lstrip"] or x["rstrip"] or x["normalized"] for x in held["added_tokens"]):
            raise ValueError("only added tokens that are taken literally are supported")
        self.vocab, self.suffix = model["vocab"], model.get("end_of_word_suffix") or ""
        self.added = {x["content"]: x["id"] for x in held["added_tokens"]}
        pairs = (x.split(" ") if isinstance(x, str) else x for x in model["merges"])
        self.merges = {(a, b): (rank, a.removesuffix(self.suffix) + b) for rank, (a, b) in enumerate(pairs)}
        library = Tokenizer.from_file(path)
        self.normalizer, self.pre_tokenizer = library.normalizer, library.pre_tokenizer
        first = (held.get("pre_tokenizer") or {}).get("pretokenizers", [{}])[0]
        names = [x["type"] for x in (held.get("normalizer") or {}).get("normalizers", [])]
        self.plain = first.get("pattern") == {"Regex": _PATTERN} and first.get("invert") and names == ["NFC", "Replace", "Lowercase"]
        if not self.plain:
            raise ValueError("only the pattern and normaliser of the word vocabulary are supported")
        self.special = re.compile("|".join(map(re.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
        self.byte = {b: chr(b) for b in (*range(33, 127), *range(161, 173), *range(174, 256))}
        for i, b in enumerate(b for b in range(256) if b not in self.byte):
            self.byte[b] = chr(256 + i)

    def _words(self, text: str):
        """Lists of the words of a text without added tokens, block by block."""
        safe, word = _plain_patterns()
        if plain := safe.fullmatch(text):
            normal = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()  # a sigma at a word's end is as any other
        else:
            normal, own = self.normalizer.normalize_str(text), {c: b for b, c in self.byte.items()}
        start = 0
        while start < len(normal):
            end = normal.find(" ", start + BLOCK)
            end = len(normal) if end < 0 else end
            if plain:
                yield word.findall(normal, start, end)
            else:
                yield [bytes(own[c] for c in piece).decode() for piece, _ in self.pre_tokenizer.pre_tokenize_str(normal[start:end])]
            start = end

    def split(self, text: str):
        """Lists of units, in order: 'w' and a word, or 's' and an added token."""
        at = 0
        for m in self.special.finditer(text) if self.special else ():
            yield from (["w" + x for x in held] for held in self._words(text[at : m.start()]))
            yield ["s" + m[0]]
            at = m.end()
        yield from (["w" + x for x in held] for held in self._words(text[at:] if at else text))

    def encode(self, unit: str) -> list[int]:
        """The ids of a unit: of neighbours, the pair of the lowest rank merges first, the leftmost of equals."""
        if unit[0] == "s":
            return [self.added[unit[1:]]]
        part = [self.byte[b] for b in unit[1:].encode()]
        part[-1] += self.suffix
        after, before = [*range(1, len(part)), -1], [*range(-1, len(part) - 1)]
        waiting = [(m[0], i) for i in range(len(part) - 1) if (m := self.merges.get((part[i], part[i + 1])))]
        heapq.heapify(waiting)
        while waiting:
            rank, i = heapq.heappop(waiting)
            j = after[i]
            if part[i] is None or j < 0 or (m := self.merges.get((part[i], part[j]))) is None or m[0] != rank:
                continue  # one of the two has been merged meanwhile
            part[i], part[j] = m[1], None
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b >= 0 and (m := self.merges.get((part[a], part[b]))):
                    heapq.heappush(waiting, (m[0], a))
        return [self.vocab[p] for p in part if p is not None]

    def pieces(self) -> list[tuple[int, str]]:
        return [(i, p) for held in (self.vocab, self.added) for p, i in held.items()]


@functools.lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    """Read once in each Python worker."""
    return Vocabulary(path)


def pieces_table(spark: SparkSession, path: str) -> DataFrame:
    """(id, piece) of a vocabulary: as many rows as it has pieces, whatever the corpus."""
    return spark.createDataFrame(pa.Table.from_pylist([{"id": i, "piece": p} for i, p in vocabulary(path).pieces()], pa.schema([("id", pa.int32()), ("piece", pa.string())])))


def _packed(values: np.ndarray) -> bytes:
    """Whole numbers below 2**32: all their first bytes, then all second ones and so on, compressed."""
    return pa.compress(pack(np.asarray(values).astype("<u4")), codec="zstd", asbytes=True) if len(values) else b""


def _unpacked(held: bytes, n: int) -> np.ndarray:
    if not n:
        return np.zeros(0, np.uint32)
    planes = np.frombuffer(pa.decompress(held, 4 * n, codec="zstd", asbytes=True), np.uint8).reshape(4, n)
    return np.ascontiguousarray(planes.T).view("<u4").reshape(-1)


def _packed_words(units: list[str]) -> tuple[bytes, int, bytes]:
    """Units as one compressed text, its size, and their lengths."""
    data = [u.encode() for u in units]
    whole = b"".join(data)
    return pa.compress(whole, codec="zstd", asbytes=True) if whole else b"", len(whole), _packed(np.array([len(x) for x in data]))


def _unpacked_words(held: bytes, size: int, lengths: bytes, n: int) -> list[str]:
    whole = pa.decompress(held, size, codec="zstd", asbytes=True) if size else b""
    ends = np.cumsum(_unpacked(lengths, n).astype(np.int64)).tolist()
    return [whole[a:b].decode() for a, b in zip([0, *ends], ends)]


CHUNKS = "chunk long, docs array<long>, lengths array<long>, codes binary, units array<string>"


class _Chunk:
    """Documents as numbers of the distinct units that they hold."""

    def __init__(self):
        self.number, self.docs, self.lengths, self.codes, self.size = {}, [], [], [], 0

    def add(self, doc, blocks) -> None:
        n = 0
        for block in blocks:
            number = self.number
            self.codes.append(np.array([number.setdefault(u, len(number)) for u in block], np.uint32))
            n += len(block)
        self.docs.append(doc)
        self.lengths.append(n)

    def row(self, number: int) -> pa.RecordBatch:
        """Units by falling frequency, so that common ones have small numbers."""
        codes = np.concatenate(self.codes) if self.codes else np.zeros(0, np.uint32)
        order = np.argsort(-np.bincount(codes, minlength=len(self.number)), kind="stable")
        place = np.empty(len(order), np.uint32)
        place[order] = np.arange(len(order))
        units = list(self.number)
        columns = [pa.array([number], pa.int64()), pa.array([self.docs], pa.list_(pa.int64())), pa.array([self.lengths], pa.list_(pa.int64())),
                   pa.array([_packed(place[codes])], pa.binary()), pa.array([[units[i] for i in order.tolist()]], pa.list_(pa.string()))]
        return pa.RecordBatch.from_arrays(columns, names=["chunk", "docs", "lengths", "codes", "units"])


def _chunked(docs: DataFrame, column: str, blocks_of, size_of, limit: int) -> DataFrame:
    """Rows of (doc_id, column) as chunks, written in the shared folder."""

    def run(batches):
        number, held = TaskContext.get().partitionId() << 36, _Chunk()
        for batch in batches:
            for doc, value in zip(batch.column("doc_id").to_pylist(), batch.column(column)):
                own = value.as_py()
                held.add(doc, blocks_of(own))
                held.size += size_of(own)
                if held.size >= limit:
                    yield held.row(number)
                    number, held = number + 1, _Chunk()
        if held.docs:
            yield held.row(number)

    return scratch(docs.select(F.col("doc_id").cast("long"), column).mapInArrow(run, CHUNKS), "zstd")


def split(docs: DataFrame, path: str, chunk_bytes: int = 16 << 20) -> DataFrame:
    """documents (doc_id, text) -> chunks."""
    return _chunked(docs.withColumn("text", F.col("text").cast("string")), "text", lambda t: vocabulary(path).split(t or ""), lambda t: len(t or ""), chunk_bytes)


def encoded_units(chunks: DataFrame, path: str, n: int) -> DataFrame:
    """chunks -> (chunk, n, counts, n_ids, ids, distinct_ids): the ids of its units one after the other, and how many each has, packed.

    n: buckets of words; each holds the words of one hash value modulo n, of all chunks.
    """
    import xxhash

    def deal(batches):
        for batch in batches:
            for chunk, units in zip(batch.column("chunk").to_pylist(), batch.column("units").to_pylist()):
                where = np.array([xxhash.xxh64_intdigest(u.encode()) % n for u in units], np.int64)
                rows = []
                for b in np.unique(where).tolist():
                    at = np.flatnonzero(where == b)
                    rows.append((b, chunk, len(at), _packed(np.diff(at, prepend=0)), *_packed_words([units[i] for i in at.tolist()])))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * len(dealt), dealt)], schema=dealt)

    def encode(group: pa.Table) -> pa.Table:
        known, own = {}, vocabulary(path)
        out = []
        for r in group.select(["chunk", "n", "at", "words", "size", "lengths"]).to_pylist():
            ids = []
            for u in _unpacked_words(r["words"], r["size"], r["lengths"], r["n"]):
                if (found := known.get(u)) is None:
                    found = known[u] = own.encode(u)
                ids.append(found)
            out.append((r["chunk"], len(ids), r["at"], _packed(np.array([len(x) for x in ids])), sum(map(len, ids)), _packed(np.array([i for x in ids for i in x]))))
        return pa.table(dict(zip(encoded.names, map(list, zip(*out)))), encoded)

    def gather(group: pa.Table) -> pa.Table:
        rows = group.to_pylist()
        at = np.concatenate([np.cumsum(_unpacked(r["at"], r["n"]).astype(np.int64)) for r in rows])
        counts = np.concatenate([_unpacked(r["counts"], r["n"]) for r in rows]).astype(np.int64)
        ids = np.concatenate([_unpacked(r["ids"], r["n_ids"]) for r in rows])
        order = np.argsort(at)
        ids = ids[_positions(np.cumsum(counts) - counts, counts, order)]
        return pa.table({"chunk": [rows[0]["chunk"]], "n": [len(order)], "counts": [_packed(counts[order])], "n_ids": [len(ids)], "ids": [_packed(ids)], "distinct_ids": [np.unique(ids).astype(np.int32)]}, gathered)

    big, raw = pa.int64(), pa.binary()
    dealt = pa.schema([("bucket", pa.int32()), ("chunk", big), ("n", big), ("at", raw), ("words", raw), ("size", big), ("lengths", raw)])
    encoded = pa.schema([("chunk", big), ("n", big), ("at", raw), ("counts", raw), ("n_ids", big), ("ids", raw)])
    gathered = pa.schema([("chunk", big), ("n", big), ("counts", raw), ("n_ids", big), ("ids", raw), ("distinct_ids", pa.list_(pa.int32()))])
    rows = chunks.select("chunk", "units").mapInArrow(deal, "bucket int, chunk long, n long, at binary, words binary, size long, lengths binary")
    found = rows.groupBy("bucket").applyInArrow(encode, "chunk long, n long, at binary, counts binary, n_ids long, ids binary")
    return scratch(found.groupBy("chunk").applyInArrow(gather, UNITS), "zstd")


UNITS = "chunk long, n long, counts binary, n_ids long, ids binary, distinct_ids array<int>"


def _positions(start: np.ndarray, counts: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Indices of the stretches (start, count) laid one after the other in that order."""
    n = counts[order]
    total = np.cumsum(n)
    return np.repeat(start[order] - (total - n), n) + np.arange(total[-1] if len(total) else 0)


def joined_pieces(units: DataFrame, pieces: DataFrame) -> DataFrame:
    """(chunk, distinct_ids) -> (chunk, names): the id and piece of every distinct id of a chunk; ids without a piece have none."""
    wanted = units.select("chunk", F.explode("distinct_ids").alias("id"))
    return wanted.join(F.broadcast(pieces), "id").groupBy("chunk").agg(F.collect_list(F.struct("id", "piece")).alias("names"))


def _assembled(held: DataFrame, digests: bool, with_ids: bool, with_text: bool) -> DataFrame:
    """Rows of chunks with their units' ids (and names) -> a row for each document."""

    def run(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                row = {c: batch.column(c)[r] for c in batch.schema.names}
                lengths = row["lengths"].as_py()
                codes = _unpacked(row["codes"].as_py(), sum(lengths))
                counts = _unpacked(row["counts"].as_py(), row["n"].as_py() or 0).astype(np.int64)
                ids = _unpacked(row["ids"].as_py(), row["n_ids"].as_py() or 0).view(np.int32)
                start = np.cumsum(counts) - counts
                listed = ids.tolist() if digests or with_text else []
                ends = list(zip(start.tolist(), (start + counts).tolist()))
                if digests:
                    numbers = [" ".join(map(str, listed[a:b])) for a, b in ends]
                if with_text:
                    names = {x["id"]: x["piece"] for x in row["names"].as_py() or ()}
                    pieces = [" ".join(names[i] for i in listed[a:b] if i in names) if b > a else "" for a, b in ends]
                    if any(not p for p in pieces):  # an id without a piece leaves no gap
                        pieces = [p or None for p in pieces]
                first = 0
                for block in _lots(lengths):
                    out = {c: [] for c in names_out}
                    for d in block:
                        own = codes[first : first + lengths[d]]
                        first += lengths[d]
                        order = own.tolist() if digests or with_text else []
                        out["doc_id"].append(row["docs"][d].as_py())
                        out["n_tokens"].append(int(counts[own].sum()))
                        if digests:
                            out["ids_sha256"].append(hashlib.sha256(" ".join([numbers[c] for c in order]).encode()).hexdigest())
                        if with_ids:
                            out["ids"].append(ids[_positions(start, counts, own)])
                        if with_text:
                            text = " ".join([x for c in order if (x := pieces[c]) is not None])
                            out["decoded_sha256" if digests else "decoded"].append(hashlib.sha256(text.encode()).hexdigest() if digests else text)
                    yield pa.RecordBatch.from_arrays([pa.array(out[c], kinds[c]) for c in names_out], names=names_out)

    kinds = {"doc_id": pa.int64(), "n_tokens": pa.int64(), "ids_sha256": pa.string(), "decoded_sha256": pa.string(), "ids": pa.list_(pa.int32()), "decoded": pa.string()}
    names_out = ["doc_id", "n_tokens", *["ids_sha256", "decoded_sha256"] * digests, *["ids"] * with_ids, *["decoded"] * (with_text and not digests)]
    spelled = {"doc_id": "long", "n_tokens": "long", "ids": "array<int>"}
    return held.mapInArrow(run, ", ".join(f"{c} {spelled.get(c, 'string')}" for c in names_out))


def _lots(lengths: list[int], limit: int = 1 << 20):
    """Consecutive document numbers of about that many units."""
    own, total = [], 0
    for d, n in enumerate(lengths):
        own.append(d)
        total += n
        if total >= limit:
            yield own
            own, total = [], 0
    if own:
        yield own


def encode(docs: DataFrame, path: str) -> DataFrame:
    """documents (doc_id, text) -> doc_id, n_tokens, ids."""
    chunks = split(docs, path)
    units = encoded_units(chunks, path, buckets(docs)).drop("distinct_ids")
    return _assembled(chunks.drop("units").join(units, "chunk", "left"), False, True, False)


def decode(encoded: DataFrame, path: str, chunk_ids: int = 1 << 21) -> DataFrame:
    """(doc_id, ids) -> doc_id, decoded: the pieces joined by a space, as the library does without a decoder; ids of no piece are left out, null ids are none."""
    own = encoded.withColumn("ids", F.coalesce(F.col("ids").cast("array<int>"), F.array().cast("array<int>")))
    chunks = _chunked(own, "ids", lambda ids: [list(map(str, ids))], lambda ids: 1 + len(ids), chunk_ids)

    def numbers(batches):
        for batch in batches:
            for chunk, units in zip(batch.column("chunk").to_pylist(), batch.column("units").to_pylist()):
                ids = np.array(units, np.int32)
                yield pa.RecordBatch.from_pydict({"chunk": [chunk], "n": [len(ids)], "counts": [_packed(np.ones(len(ids)))], "n_ids": [len(ids)], "ids": [_packed(ids.view(np.uint32))], "distinct_ids": [ids]})

    units = chunks.select("chunk", "units").mapInArrow(numbers, UNITS)
    names = joined_pieces(units, pieces_table(encoded.sparkSession, path))
    held = chunks.drop("units").join(units.drop("distinct_ids"), "chunk").join(names, "chunk", "left")
    return _assembled(held, False, False, True).select("doc_id", "decoded")


def round_trip(docs: DataFrame, path: str, digests: bool = False) -> DataFrame:
    """documents (doc_id, text) -> doc_id, n_tokens, ids and the decoded text; with digests, SHA-256 of the decimal ids and of the decoded text instead."""
    chunks = split(docs, path)
    units = encoded_units(chunks, path, buckets(docs))
    names = joined_pieces(units, pieces_table(docs.sparkSession, path))
    held = chunks.drop("units").join(units.drop("distinct_ids"), "chunk", "left").join(names, "chunk", "left")
    return _assembled(held, digests, not digests, True)
