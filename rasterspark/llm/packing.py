"""Packing of instruction data into sequences: vector bin packing by the dot-product heuristic.

A piece needs tokens, one segment and its loss-bearing tokens; a sequence has a limit on each. The
heuristic fills one sequence at a time: of the pieces that still fit, it takes the one whose needs
have the largest dot product with what is left of the limits (both as shares of the limits), so a
sequence that is short of a resource is filled with pieces that spare it. Pieces of equal needs are
interchangeable, so the search runs over the distinct needs only.

Documents are tokenised and packed where they are read, a batch of rows at a time, without a
shuffle: a document is cut into pieces as large as the limits on tokens and loss-bearing tokens allow,
full ones stand alone, the others are packed together. What a sequence lacks to a full one is
padding, unless its length is a power of two; a sequence that ends up with much padding is cut into
powers of two instead.

Which tokens bear loss is known for each token: all of a document's (the default) or none, or by the
turns of a conversation (`pack_conversations`: those of the answering roles).

Null texts count as empty: such a document is its end token alone. Rows that repeat a doc_id are
packed each. A long text is many pieces; its ids must fit in a task. Other columns are ignored,
whatever their names, but for has_loss. An empty table gives an empty one. Sequence numbers hold the
partition in their upper bits.
"""

from __future__ import annotations

import base64
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Limits:
    tokens: int = 1024
    segments: int = 64
    loss_tokens: int = 1024


def pack(needs: np.ndarray, limits: Limits) -> list[list[int]]:
    """needs: rows of (tokens, segments, loss tokens), each within the limits -> lists of row numbers."""
    cap = np.array([limits.tokens, limits.segments, limits.loss_tokens], np.int64)
    if not len(needs):
        return []
    if (needs > cap).any():
        raise ValueError("a piece exceeds the limits of a sequence")
    kinds, kind = np.unique(needs, axis=0, return_inverse=True)
    waiting = [[] for _ in kinds]
    for row, k in reversed(list(enumerate(kind.reshape(-1).tolist()))):
        waiting[k].append(row)
    count = np.array([len(w) for w in waiting])
    shares = kinds / cap
    bins = []
    alive = np.arange(len(kinds))
    while len(alive):
        left, mine = cap.copy(), []
        while True:
            fits = alive[(kinds[alive] <= left).all(axis=1)]
            fits = fits[count[fits] > 0]
            if not len(fits):
                break
            best = int(fits[np.argmax(shares[fits] @ (left / cap))])
            mine.append(waiting[best].pop())
            count[best] -= 1
            left -= kinds[best]
        bins.append(mine)
        alive = alive[count[alive] > 0]
    return bins


def powers_of_two(n: int) -> list[int]:
    return [1 << i for i in range(n.bit_length() - 1, -1, -1) if n >> i & 1]


def pieces_of(loss: np.ndarray, limits: Limits) -> list[tuple[int, int]]:
    """(start, length) of the longest pieces within the limits, one after the other. loss: 0 or 1 for each token."""
    total = np.concatenate([[0], np.cumsum(loss)])
    out, start = [], 0
    while start < len(loss):
        end = min(start + limits.tokens, int(np.searchsorted(total, total[start] + limits.loss_tokens, "right")) - 1)
        out.append((start, end - start))
        start = end
    return out


def cut(loss: list[np.ndarray], limits: Limits) -> tuple[np.ndarray, list[list[int]]]:
    """Documents, each as its tokens' loss (0 or 1) -> pieces (document, start, length) and sequences (lists of piece numbers)."""
    pieces, sequences, rests, needs = [], [], [], []
    for d, own in enumerate(loss):
        for start, n in pieces_of(own, limits):
            if n == limits.tokens:
                sequences.append([len(pieces)])
            else:
                rests.append(len(pieces))
                needs.append((n, 1, int(own[start : start + n].sum())))
            pieces.append((d, start, n))
    for members in pack(np.array(needs, np.int64).reshape(-1, 3), limits):
        own = [rests[m] for m in members]
        total = sum(pieces[p][2] for p in own)
        if limits.tokens - total <= 16 or total & (total - 1) == 0:
            sequences.append(own)
            continue
        # no padding at all: whole powers of two, cut where one ends
        queue = [list(pieces[p]) + [p] for p in reversed(own)]
        for part in powers_of_two(total):
            new = []
            while part:
                d, start, n, p = queue.pop()
                take = min(n, part)
                if take < n:
                    queue.append([d, start + take, n - take, None])
                if p is None:
                    p = len(pieces)
                    pieces.append(None)
                pieces[p] = (d, start, take)
                new.append(p)
                part -= take
            sequences.append(new)
    return np.array(pieces, np.int64).reshape(-1, 3), sequences


def ranks(path: str) -> dict[bytes, int]:
    """Ranks of a byte-level BPE vocabulary file: a .tiktoken file, or the JSON of the same vocabulary."""
    if path.endswith(".tiktoken"):
        with open(path, "rb") as f:
            return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    import json

    with open(path, encoding="utf-8") as f:
        held = json.load(f)
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}
    special = {x["content"] for x in held.get("added_tokens", [])}
    return {bytes(byte[c] for c in token): i for token, i in held["model"]["vocab"].items() if token not in special}


def added(path: str) -> dict[str, int]:
    """The added tokens of a vocabulary file; a .tiktoken file has none."""
    if path.endswith(".tiktoken"):
        return {}
    import json

    with open(path, encoding="utf-8") as f:
        held = json.load(f).get("added_tokens", [])
    if any(x["single_word"] or x["lstrip"] or x["rstrip"] or x["normalized"] for x in held):
        raise ValueError("only added tokens that are taken literally are supported")
    return {x["content"]: x["id"] for x in held}


_encoders: dict[tuple[str, bool], object] = {}


def encoder(path: str, special: bool = False):
    """A byte-level BPE encoder, built once in each Python worker.

    special: strings of the file's added tokens become these tokens, as the tokenizers library has it
    if its encode_special_tokens is not set; else they are ordinary text.
    """
    if (path, special) not in _encoders:
        import public_tokenizers
        import tiktoken

        own = added(path) if special else {}
        _encoders[path, special] = tiktoken.Encoding(path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks(path), special_tokens=own)
    return _encoders[path, special]


SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, loss_tokens long"


class Packer:
    """Packs documents as they come, some together; gives a batch of rows for every lot."""

    def __init__(self, limits: Limits, end_id: int, rows: int, most_tokens: int):
        self.limits, self.end, self.rows, self.most = limits, np.array([end_id], "<u4"), rows, most_tokens
        self.number = TaskContext.get().partitionId() << 36
        self.doc, self.ids, self.loss, self.held = [], [], [], 0

    def add(self, doc, parts) -> bool:
        """parts: (ids, whether they bear loss). The end token bears loss like the last part. Whether a lot is full."""
        parts = [(np.asarray(x, "<u4"), bool(b)) for x, b in parts]
        parts.append((self.end, parts[-1][1] if parts else True))
        self.doc.append(doc)
        self.ids.append(np.concatenate([x for x, _ in parts]))
        self.loss.append(np.concatenate([np.full(len(x), b, np.int8) for x, b in parts]))
        self.held += len(self.ids[-1])
        return len(self.doc) >= self.rows or self.held >= self.most

    def flush(self) -> pa.RecordBatch:
        pieces, sequences = cut(self.loss, self.limits)
        out = []
        for members in sequences:
            offset = 0
            for p in members:
                d, start, n = pieces[p].tolist()
                ids = self.ids[d]
                out.append((self.doc[d], start, n, zlib.crc32(ids[start : start + n].tobytes()), len(ids), self.number, offset, int(self.loss[d][start : start + n].sum())))
                offset += n
            self.number += 1
        self.doc, self.ids, self.loss, self.held = [], [], [], 0
        columns = list(zip(*out)) if out else [[] for _ in range(8)]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=[x.split()[0] for x in SCHEMA.split(", ")])


def pack_documents(docs: DataFrame, tokenizer: str, limits: Limits = Limits(), end_id: int = 0, rows: int = 20_000, most_tokens: int = 1 << 23, special: bool = False) -> DataFrame:
    """documents -> one row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, loss_tokens.

    tokenizer: path of a vocabulary file that all executors have. `rows` documents, or those of
    `most_tokens` tokens, are packed together. special: see encoder. An optional boolean column has_loss says whether a document's tokens bear loss (default: yes).
    """
    loss = F.col("has_loss").cast("boolean") if "has_loss" in docs.columns else F.lit(True)

    def run(batches):
        encode = encoder(tokenizer, special).encode_to_numpy
        packer = Packer(limits, end_id, rows, most_tokens)
        for batch in batches:
            for d, b, t in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "has_loss", "text"))):
                if packer.add(d, [(encode(t or "", allowed_special="all"), b is not False)]):
                    yield packer.flush()
        yield packer.flush()

    return docs.select(F.col("doc_id").cast("long"), "text", loss.alias("has_loss")).mapInArrow(run, SCHEMA)


def pack_conversations(turns: DataFrame, tokenizer: str, limits: Limits = Limits(1024, 16, 512), answering=("assistant",), end_id: int = 0, rows: int = 20_000, most_tokens: int = 1 << 23) -> DataFrame:
    """turns (conv_id, turn, role, text) -> rows as of pack_documents, a conversation being a document.

    Every turn is "role: text" and a new line, in the order of turn, then role, then text; the tokens of
    the answering roles bear loss. A null role or text is empty; turns without a conv_id are one conversation.
    """
    conversation = F.array_sort(F.collect_list(F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))))
    held = turns.groupBy(F.col("conv_id").cast("long").alias("doc_id")).agg(conversation.alias("turns"))

    def run(batches):
        encode = encoder(tokenizer).encode_to_numpy
        packer = Packer(limits, end_id, rows, most_tokens)
        for batch in batches:
            for d, own in zip(batch.column("doc_id").to_pylist(), batch.column("turns").to_pylist()):
                if packer.add(d, [(encode(f"{t['role']}: {t['text']}\n", disallowed_special=()), t["role"] in answering) for t in own]):
                    yield packer.flush()
        yield packer.flush()

    return held.mapInArrow(run, SCHEMA)
