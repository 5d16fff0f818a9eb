"""Suffix-array dedup of byte strings: which 400-byte strings start at two places or more.

A window is `width` bytes of a document's UTF-8 text. A window's anchor is the place of the smallest
hash of `RUN` bytes inside it, so equal windows have equal anchors at equal distance, and the windows
of one anchor are consecutive: their bytes are the anchor's context. Only suffixes that share the
anchor's run can share a window, so tasks receive the contexts of the same run together and sort
them as suffixes.

The sort compares suffixes by hashes: prefix polynomial hashes give the hash of any stretch at once,
a binary search over the length finds the common extension of two suffixes in logarithmic time, and
one more byte orders them; a merge sort does this for all contexts of a task together. Neighbours'
common extensions are checked byte by byte afterwards, and a group where a hash misled is sorted
again by its bytes. From the sorted suffixes and their extensions, the windows at each distance left
of the anchor that are equal are read off.

Contexts that are equal as a whole (copies of a passage, most by far) are counted first, within each
batch and then for all, and one of them stands for all in the sort, so a group of copies of any size
costs one context. Where more than `hot` different contexts share a run, in a batch or in all, they
aren't gathered in one task: their windows are dealt out and counted one by one. Contexts and windows
are told apart here by BLAKE2b digests of 128 bits of their bytes, and windows found by the sort are
compared byte by byte, so polynomial hashes only ever propose.

Packed arrays travel in one row for each batch and bucket, in as many buckets as the text needs for a
bucket to fit in memory. Places are gathered to one row a document and joined to the documents, so
texts pass through tasks as streams of rows; a long text is read in pieces of a megabyte that overlap
by a window. Null texts are empty. Rows are told apart by a digest of id and text: identical rows are
at two places, so both lose what they share. A null id is a value like any other. Other columns are
ignored.
"""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterspark.llm.common import buckets, chunks, first_equal, pack, posting_rows, posting_schema, split_by, split_runs, texts_of, unpack
from rasterspark.llm.hashing import byte_values, mix, prefix, spans, windows
from rasterspark.llm.substring_dedup import _digests, _doc_bucket

RUN = 64
_PLACE_BITS = np.uint64(28)
#: States of a posting: its context occurs often in the batch, is known to be a repeat, belongs to a hot run; a hot run's notice.
OFTEN, KNOWN, PART, NOTICE = 1, 2, 4, 8
#: States of a place: all its windows are repeats; its context is to be compared; as windows.
FULL, SHIP, HOT = 1, 2, 4


def pieces(texts: list[bytes], width: int, limit: int = 1 << 20):
    """(text number, first byte, bytes) of pieces that hold every window once: a text, or parts of a long one."""
    for i, text in enumerate(texts):
        for at in range(0, max(1, len(text) - width + 1), limit):
            yield i, at, text[at : at + limit + width - 1]


def contexts(texts: list[bytes], width: int):
    """Anchors of the texts: (text number, first window, windows, anchor - first window, run hash, two halves of the context's digest)."""
    joined = b"".join(texts)
    data = np.frombuffer(joined, np.uint8)
    size = np.array([len(t) for t in texts])
    begin = np.cumsum(size) - size
    if len(data) < width:
        return [np.zeros(0, np.int64)] * 4 + [np.zeros(0, np.uint64)] * 3
    p = prefix(byte_values()[data])
    run = windows(p, RUN)
    least = (run >> _PLACE_BITS << _PLACE_BITS) | np.arange(len(run), dtype=np.uint64)
    reach, have = width - RUN + 1, 1
    while have * 2 <= reach:
        least = np.minimum(least[:-have], least[have:])
        have *= 2
    if reach > have:
        least = np.minimum(least[: have - reach], least[reach - have :])
    anchor = (least & ((np.uint64(1) << _PLACE_BITS) - np.uint64(1))).astype(np.int64)
    inside = np.zeros(len(anchor) + 1, np.int8)
    for b, n in zip(begin.tolist(), size.tolist()):
        if n >= width:
            inside[b : b + n - width + 1] = 1
    new = np.empty(len(anchor), bool)
    new[0], new[1:] = True, anchor[1:] != anchor[:-1]
    change = np.flatnonzero(new | (np.diff(inside, prepend=0)[: len(anchor)] != 0))
    last = np.append(change[1:], len(anchor))
    own = inside[change] > 0
    first, last = change[own], last[own]
    doc = np.searchsorted(begin, first, "right") - 1
    # texts of no bytes share their begin with the next: the last of them is meant
    at = anchor[first]
    one, two = _digests(joined, first, last + width - 1)
    return [doc, first - begin[doc], last - first, at - first, run[at], one, two + (at - first).astype(np.uint64)]


def extension(p: np.ndarray, start: np.ndarray, length: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Common extension of suffixes i and j, by binary search over prefix hashes."""
    low, high = np.zeros(len(i), np.int64), np.minimum(length[i], length[j])
    a, b = start[i], start[j]
    while (low < high).any():
        mid = (low + high + 1) // 2
        same = spans(p, a, a + mid) == spans(p, b, b + mid)
        low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
    return low


def _less(data, p, start, length, i, j):
    n = extension(p, start, length, i, j)
    ends_i, ends_j = n == length[i], n == length[j]
    x = data[np.minimum(start[i] + n, len(data) - 1)]
    y = data[np.minimum(start[j] + n, len(data) - 1)]
    return np.where(ends_i | ends_j, ends_i & (~ends_j | (i < j)), x < y)


def suffix_order(data: np.ndarray, start: np.ndarray, length: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Merge sort of suffixes within their groups -> (order, extension to the one before, 0 for a group's first)."""
    p = prefix(byte_values()[data])
    order = np.argsort(group, kind="stable")
    g = group[order]
    head = np.flatnonzero(np.diff(g, prepend=g[:1] - 1)) if len(g) else np.zeros(0, np.int64)
    size = np.diff(np.append(head, len(g)))
    base, top = np.repeat(head, size), np.repeat(head + size, size)
    place = np.arange(len(g))
    run = 1
    while len(size) and run < size.max():
        at = place[top - base > run]
        block = base[at] + (at - base[at]) // (2 * run) * (2 * run)
        mid, end = np.minimum(block + run, top[at]), np.minimum(block + 2 * run, top[at])
        left = at < mid
        low, high = np.where(left, mid, block), np.where(left, end, mid)
        other = low.copy()
        me = order[at]
        while True:
            todo = np.flatnonzero(low < high)
            if not len(todo):
                break
            half = (low[todo] + high[todo]) // 2
            before = np.where(left[todo], _less(data, p, start, length, order[half], me[todo]), ~_less(data, p, start, length, me[todo], order[half]))
            low[todo], high[todo] = np.where(before, half + 1, low[todo]), np.where(before, high[todo], half)
        merged = order.copy()
        merged[np.where(left, at, at - mid + block) + low - other] = me
        order = merged
        run *= 2
    same = np.zeros(len(g), bool)
    same[1:] = g[1:] == g[:-1]
    common = np.zeros(len(g), np.int64)
    at = np.flatnonzero(same)
    common[at] = extension(p, start, length, order[at - 1], order[at])
    raw, misled = data.tobytes(), set()
    for k in at.tolist():
        a, b, n = int(start[order[k - 1]]), int(start[order[k]]), int(common[k])
        if raw[a : a + n] != raw[b : b + n]:
            misled.add(int(base[k]))
    for b in misled:  # a hash misled: this group by its bytes
        own = slice(b, int(top[b]))
        suffix = {int(r): raw[int(start[r]) : int(start[r] + length[r])] for r in order[own]}
        order[own] = sorted(suffix, key=lambda r: (suffix[r], r))
        for k in range(b + 1, int(top[b])):
            x, y = suffix[int(order[k - 1])], suffix[int(order[k])]
            common[k] = next((n for n, (c, d) in enumerate(zip(x, y)) if c != d), min(len(x), len(y)))
    return order, common


def repeated_windows(blobs: list[bytes], off: np.ndarray, count: np.ndarray, run: np.ndarray, often: np.ndarray, width: int) -> list[np.ndarray]:
    """For each context, which of its windows (numbered from 0) another context of its run has too.

    A context that occurs often has all of its windows elsewhere.
    """
    raw = b"".join(blobs)
    data = np.frombuffer(raw, np.uint8)
    size = np.array([len(b) for b in blobs], np.int64)
    begin = np.cumsum(size) - size
    start = begin + off
    order, common = suffix_order(data, start, size - off, run)
    p = prefix(byte_values()[data])
    mark = [np.full(int(n), bool(o)) for n, o in zip(count, often)]
    off_, count_, start_ = off[order], count[order], start[order]
    for left in range(int(off.max(initial=-1)) + 1):
        # neighbours with an extension of width - left are equal from the anchor to the windows' end
        right = np.cumsum(common < width - left)
        at = np.flatnonzero((left <= off_) & (left > off_ - count_))
        if len(at) < 2:
            continue
        key = mix(spans(p, start_[at] - left, start_[at]) + right[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        by = np.argsort(key, kind="stable")
        equal = np.flatnonzero(key[by][1:] == key[by][:-1])
        hit = np.zeros(len(at), bool)
        hit[by[equal]] = hit[by[equal + 1]] = True
        found = (start_[at] - left).tolist()
        text = lambda k: raw[found[k] : found[k] + width]
        if any(text(x) != text(y) for x, y in zip(by[equal].tolist(), by[equal + 1].tolist())):  # a hash misled: by bytes
            seen = Counter(text(k) for k in np.flatnonzero(hit).tolist())
            hit[[k for k in np.flatnonzero(hit).tolist() if seen[text(k)] < 2]] = False
        for k in order[at[hit]].tolist():
            mark[k][int(off[k]) - left] = True
    return mark


_POSTINGS = ("row", "twin", "first", "count", "off", "run", "one", "two", "state")
_KINDS = {"row": np.int64, "twin": np.int64, "first": np.int32, "count": np.int16, "off": np.int16, "run": np.uint64, "one": np.uint64, "two": np.uint64, "state": np.uint8}
_PLACE = ("row", "twin", "first", "count", "off", "run", "state")


def _rows(bucket: np.ndarray, names, values: dict) -> pa.RecordBatch:
    return posting_rows(bucket.astype(np.int32), **{k: values[k].astype(_KINDS[k]) for k in names})


def _heads(x: dict) -> np.ndarray:
    """Where a new context begins along rows ordered by run and digest."""
    lead = np.ones(len(x["run"]), bool)
    lead[1:] = (x["run"][1:] != x["run"][:-1]) | (x["one"][1:] != x["one"][:-1]) | (x["two"][1:] != x["two"][:-1])
    return lead


def _postings(n: int, hot: int, x: dict) -> pa.RecordBatch:
    """Posting rows of a batch, its equal contexts counted."""
    order, _ = first_equal(x["run"], x["one"], x["two"], x["row"], x["twin"], x["first"])
    x = {k: v[order] for k, v in x.items()}
    lead = _heads(x)
    heads = np.flatnonzero(lead)
    state = np.full(len(lead), KNOWN, np.uint8)
    state[heads] = np.where(np.diff(np.append(heads, len(lead))) > 1, OFTEN, 0)
    names, at, different = np.unique(x["run"][heads], return_inverse=True, return_counts=True)
    part = np.zeros(len(lead), bool)
    part[heads] = different[at] > hot
    state[part] |= PART
    spread = mix(x["run"] ^ mix(x["one"] + np.where(lead, 0, x["row"].view(np.uint64) + x["first"].astype(np.uint64))))
    bucket = np.where(lead & ~part, x["run"], spread) % np.uint64(n)
    notice = names[different > hot]
    x = {k: np.concatenate([v, notice if k == "run" else np.zeros(len(notice), v.dtype)]) for k, v in x.items()}
    x["state"] = np.concatenate([state, np.full(len(notice), NOTICE, np.uint8)])
    return _rows(np.concatenate([bucket, notice % np.uint64(n)]), _POSTINGS, x)


def _places(postings: DataFrame, n: int, hot: int) -> DataFrame:
    """Places whose windows all are repeats, and places whose contexts have to be compared."""

    def run(group: pa.Table) -> pa.Table:
        x = {k: unpack(group, k, _KINDS[k]) for k in _POSTINGS}
        noticed = x["run"][x["state"] == NOTICE]
        done = x["state"] == KNOWN
        open_ = np.flatnonzero(~done & (x["state"] != NOTICE))
        order, _ = first_equal(*(x[k][open_] for k in ("run", "one", "two", "row", "twin", "first")))
        y = {k: v[open_][order] for k, v in x.items()}
        heads = np.flatnonzero(_heads(y))
        size = np.diff(np.append(heads, len(order)))
        often = (np.maximum.reduceat(y["state"] & OFTEN, heads) > 0) | (size > 1) if len(heads) else np.zeros(0, bool)
        part = (y["state"][heads] & PART) > 0
        _, at, different = np.unique(y["run"][heads], return_inverse=True, return_counts=True)
        as_windows = part | (different[at] > hot) | np.isin(y["run"][heads], noticed)
        ship = as_windows | (different[at] > 1)
        state = np.repeat(np.where(often, FULL, 0), size).astype(np.uint8)
        state[heads] |= np.where(ship, SHIP, 0).astype(np.uint8) | np.where(as_windows, HOT, 0).astype(np.uint8)
        keep = state > 0
        out = {k: np.concatenate([y[k][keep], x[k][done]]) for k in _PLACE}
        out["state"] = np.concatenate([state[keep], np.full(int(done.sum()), FULL, np.uint8)])
        return pa.Table.from_batches([_rows(_doc_bucket(out["row"], n), _PLACE, out)])

    return postings.groupBy("bucket").applyInArrow(run, posting_schema(*_PLACE))


_GATHERED = "_row long, _twin long, " + ", ".join(f"_{k} binary" for k in _PLACE[2:])


def _gathered(places: DataFrame) -> DataFrame:
    """One row for each document: row, twin, and its packed places."""

    def run(group: pa.Table) -> pa.Table:
        x = {k: unpack(group, k, _KINDS[k]) for k in _PLACE}
        order = np.lexsort((x["twin"], x["row"]))
        x = {k: v[order] for k, v in x.items()}
        cuts = list(split_runs(x["row"], x["twin"]))
        columns = {f"_{k}": pa.array([int(x[k][a]) for a, _ in cuts], pa.int64()) for k in ("row", "twin")}
        return pa.table(columns | {f"_{k}": pa.array([pack(x[k][a:b]) for a, b in cuts], pa.binary()) for k in _PLACE[2:]})

    return places.groupBy("bucket").applyInArrow(run, _GATHERED)


def _listed(batch: pa.RecordBatch, i: int, *names: str) -> dict[str, np.ndarray]:
    """The places that were joined to a row."""
    out = {}
    for k in names:
        parts = batch.column(f"_{k}")[i].as_py() or []
        wide = np.dtype(_KINDS[k]).itemsize
        parts = [np.ascontiguousarray(np.frombuffer(x, np.uint8).reshape(wide, -1).T).view(_KINDS[k]).reshape(-1) for x in parts]
        out[k] = np.concatenate(parts) if parts else np.zeros(0, _KINDS[k])
    return out


def _with_places(docs: DataFrame, gathered: DataFrame, *names: str) -> DataFrame:
    """All documents, and the packed places of each as arrays of binaries."""
    listed = gathered.groupBy("_row", "_twin").agg(*(F.collect_list(f"_{k}").alias(f"_{k}") for k in names))
    return docs.join(listed, (F.col("row") == F.col("_row")) & (F.col("twin") == F.col("_twin")), "left").drop("_row", "_twin")


_SHIPPED = "bucket int, kind int, row binary, twin binary, first binary, count binary, off binary, run binary, often binary, size binary, one binary, two binary, data binary"


def _packed_rows(kind: int, bucket: np.ndarray, blobs: list[bytes] | None = None, **values: np.ndarray):
    """Rows of _SHIPPED, one for each bucket."""
    names = [x.split()[0] for x in _SHIPPED.split(", ")][2:]
    for b, at in split_by(bucket):
        data = b"".join(blobs[i] for i in at) if blobs else b""
        yield (b, kind, *(data if k == "data" else pack(values[k][at]) if k in values else b"" for k in names))


def _shipped(width: int, n: int):
    """Documents with places -> contexts for the suffix sort (kind 0), or windows (kind 1)."""

    def run(batches):
        for batch in batches:
            mine = np.flatnonzero(batch.column("_state").is_valid().to_numpy(zero_copy_only=False)).tolist()
            x = {k: [] for k in ("row", "twin", "first", "count", "off", "run", "often")}
            blobs, hot = [], []
            for i in mine:
                own = _listed(batch, i, "first", "count", "off", "run", "state")
                row, twin, text = batch.column("row")[i].as_py(), batch.column("twin")[i].as_py(), batch.column("text")[i].as_py()
                sent: set[int] = set()
                for f, c, o, r, s in zip(*(v.tolist() for v in own.values())):
                    if s & SHIP and f not in sent:
                        sent.add(f)
                        if s & HOT:
                            hot.append((row, twin, f, c, s & FULL, text[f : f + c - 1 + width]))
                            continue
                        for k, v in zip(x, (row, twin, f, c, o, r, s & FULL)):
                            x[k].append(v)
                        blobs.append(text[f : f + c - 1 + width])
            out = []
            a = {k: np.array(v, np.uint8 if k == "often" else _KINDS[k]) for k, v in x.items()}
            a["size"] = np.array([len(b) for b in blobs], np.int32)
            out += _packed_rows(0, (a["run"] % np.uint64(n)).astype(np.int64), blobs, **a)
            if hot:
                counts = [h[3] for h in hot]
                row, twin = (np.repeat(np.array([h[k] for h in hot], np.int64), counts) for k in (0, 1))
                first = np.concatenate([h[2] + np.arange(h[3]) for h in hot]).astype(np.int32)
                often = np.repeat(np.array([h[4] for h in hot], np.uint8), counts)
                halves = [_digests(h[5], np.arange(h[3]), np.arange(h[3]) + width) for h in hot]
                one, two = (np.concatenate([x[k] for x in halves]) for k in (0, 1))
                # of equal windows in this batch one goes to the digest's bucket, which learns that there are more
                order, group = first_equal(one, two)
                lead = np.diff(group, prepend=-1) > 0
                size = np.diff(np.append(np.flatnonzero(lead), len(order)))
                often = np.maximum(often[order], np.repeat(size > 1, size)).astype(np.uint8)
                often[~lead] = 2
                one, two, row, twin, first = (v[order] for v in (one, two, row, twin, first))
                where = np.where(lead, one, mix(one + row.view(np.uint64) + first.astype(np.uint64)))
                out += _packed_rows(1, (where % np.uint64(n)).astype(np.int64), row=row, twin=twin, first=first, often=often, one=one, two=two)
            if out:
                columns = list(zip(*out))
                kinds = [pa.int32(), pa.int32()] + [pa.binary()] * 11
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=[x.split()[0] for x in _SHIPPED.split(", ")])

    return run


def _compared(width: int, n: int):
    """Contexts of the same runs, and windows of the same digests -> places of repeats."""

    def run(group: pa.Table) -> pa.Table:
        rows = {kind: group.filter(pa.array([k == kind for k in group.column("kind").to_pylist()], pa.bool_())) for kind in (0, 1)}
        made = {k: [np.zeros(0, _KINDS[k])] for k in ("row", "twin", "first", "count")}
        part = rows[0]
        if part.num_rows:
            x = {k: unpack(part, k, _KINDS[k]) for k in ("row", "twin", "first", "count", "off", "run")}
            often, size = unpack(part, "often", np.uint8), unpack(part, "size", np.int32)
            data, blobs, at = b"".join(part.column("data").to_pylist()), [], 0
            for s in size.tolist():
                blobs.append(data[at : at + s])
                at += s
            for k, hit in enumerate(repeated_windows(blobs, x["off"].astype(np.int64), x["count"].astype(np.int64), x["run"], often > 0, width)):
                if not often[k] and hit.any():
                    edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
                    a, b = edge[::2], edge[1::2]
                    for name, v in (("row", x["row"][[k] * len(a)]), ("twin", x["twin"][[k] * len(a)]), ("first", x["first"][k] + a), ("count", b - a)):
                        made[name].append(v)
        part = rows[1]
        if part.num_rows:
            x = {k: unpack(part, k, _KINDS[k]) for k in ("row", "twin", "first", "one", "two")}
            often = unpack(part, "often", np.uint8)
            open_ = np.flatnonzero(often < 2)
            order, same = first_equal(x["one"][open_], x["two"][open_])
            lead = np.flatnonzero(np.diff(same, prepend=-1))
            size = np.diff(np.append(lead, len(order)))
            many = (size > 1) | (np.maximum.reduceat(often[open_][order], lead) > 0) if len(lead) else np.zeros(0, bool)
            hit = np.concatenate([open_[order][np.repeat(many, size)], np.flatnonzero(often == 2)])
            for name in ("row", "twin", "first"):
                made[name].append(x[name][hit])
            made["count"].append(np.ones(len(hit), np.int16))
        out = {k: np.concatenate(v) for k, v in made.items()}
        none = np.zeros(len(out["row"]), np.int64)
        return pa.Table.from_batches([_rows(_doc_bucket(out["row"].astype(np.int64), n), _PLACE, out | {"off": none, "run": none, "state": none + FULL})])

    return run


def repeated_bytes(docs: DataFrame, width: int = 400, hot: int = 2000) -> tuple[DataFrame, DataFrame]:
    """(documents with row digests, packed places of windows that occur elsewhere too: _row, _twin, _first, _count, _state)."""
    n = buckets(docs)
    text = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    named = F.sha2(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).cast("binary"), F.lit(b"\0"), F.col("text")), 256)
    half = lambda at: F.conv(F.substring(named, at, 16), 16, -10).cast("long")
    dealt = docs.select("doc_id", text.alias("text")).withColumns({"row": half(1), "twin": half(17)})

    def anchors(batches):
        for batch in batches:
            row, twin = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("row", "twin"))
            parts, found = list(pieces(texts_of(batch), width)), []
            for a, b in chunks([len(t) for _, _, t in parts]):
                piece, *rest = contexts([t for _, _, t in parts[a:b]], width)
                doc = np.array([i for i, _, _ in parts[a:b]], np.int64)[piece]
                rest[0] = rest[0] + np.array([at for _, at, _ in parts[a:b]], np.int64)[piece]
                found.append((row[doc], twin[doc], *rest))
            if found:
                yield _postings(n, hot, dict(zip(_POSTINGS, (np.concatenate(x) for x in zip(*found)))))

    places = _gathered(_places(dealt.mapInArrow(anchors, posting_schema(*_POSTINGS)), n, hot))
    listed = _with_places(dealt, places, "first", "count", "off", "run", "state")
    more = listed.mapInArrow(_shipped(width, n), _SHIPPED).groupBy("bucket").applyInArrow(_compared(width, n), posting_schema(*_PLACE))
    names = ["_row", "_twin", "_first", "_count", "_state"]
    return dealt, places.select(*names).union(_gathered(more).select(*names))


def remove_repeated(docs: DataFrame, width: int = 400, hot: int = 2000) -> DataFrame:
    """documents -> doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (array of start, end in bytes)."""
    dealt, places = repeated_bytes(docs, width, hot)

    def run(batches):
        for batch in batches:
            out = []
            for i, text in enumerate(batch.column("text").to_pylist()):
                own = _listed(batch, i, "first", "count", "state")
                full = own["state"] & FULL > 0
                if not full.any():
                    out.append((len(text), 0, [], hashlib.sha256(text).hexdigest()))
                    continue
                first, count = own["first"][full].astype(np.int64), own["count"][full].astype(np.int64)
                edge = np.zeros(len(text) + 1, np.int64)
                np.add.at(edge, first, 1)
                np.add.at(edge, first + count - 1 + width, -1)
                gone = np.cumsum(edge)[:-1] > 0
                cuts = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]]))).reshape(-1, 2).tolist()
                out.append((len(text), int(gone.sum()), cuts, hashlib.sha256(np.frombuffer(text, np.uint8)[~gone].tobytes()).hexdigest()))
            n, removed, cuts, sha = zip(*out) if out else ((), (), (), ())
            columns = [
                batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array([len(c) for c in cuts], pa.int64()),
                pa.array(sha, pa.string()), pa.array(cuts, pa.list_(pa.list_(pa.int64()))),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])

    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<array<bigint>>"
    return _with_places(dealt, places, "first", "count", "state").mapInArrow(run, schema)
