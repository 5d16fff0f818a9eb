"""SimHash near-duplicate groups: exact tiled comparison of fingerprints.

A document's words are the runs of bytes other than ASCII white space of its text with A-Z lowered;
its shingles are runs of `width` words joined by one space, repeats included (the whole sequence if
it has fewer words). Bit i of the fingerprint is set if it is set in more than half of the
shingles' XXH64 values (seed 42). Fingerprints that differ in at most `radius` bits are linked, and
documents of linked fingerprints form a group.

The distinct fingerprints are dealt into tiles by the population counts of their two halves (and,
where a tile is large, by hash into chunks). Two tiles meet in a task only if their population
counts differ by at most the radius, which no linked pair can exceed. In the task, rows of equal
byte-pair counts are compared as blocks with exclusive-or and bit counts, again skipping blocks
whose counts differ beyond the radius. A task returns a spanning forest of the links it finds, never
all pairs, and the number of links of each fingerprint. Exact copies share one row, so a group of
copies of any size costs one fingerprint.

For the pipeline (near_groups, keep_one) the comparison only proposes pairs, and links are verified
on the sets of shingles.

Null, empty and blank texts have fingerprint zero and are grouped like any other. Null ids: the row
keeps its fingerprint and takes part; a component of null ids only has a null id. Rows that repeat an
id each have their row. An empty table gives an empty one. A long text is hashed whole, in one task.
Other columns are ignored, whatever their names (keep_one keeps them).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rasterspark.llm.common import cut, scratch, texts_of
from rasterspark.llm.components import connected_components
from rasterspark.llm.hashing import mix


def shingles(text: bytes, width: int) -> list[bytes]:
    """The runs of width words, repeats included; the whole sequence if it has fewer; none without words."""
    words = text.lower().split()
    if not words:
        return []
    joined = b" ".join(words)
    if len(words) <= width:
        return [joined]
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[: len(words) - width].tolist()]
    return [joined[a:b] for a, b in zip(starts, (ends[width - 1 :] - 1).tolist())]


def _majority(hashes: np.ndarray) -> np.ndarray:
    """Bytes of the bits that are set in more than half of the rows; hashes: one row of 64-bit words for each shingle."""
    packed = np.ascontiguousarray(hashes).view(np.uint8).reshape(len(hashes), -1)
    votes = np.zeros(packed.shape[1] * 8, np.int64)
    for i in range(0, len(packed), 255):  # sums of 255 bits fit a byte
        votes += np.unpackbits(packed[i : i + 255], axis=1, bitorder="little").sum(axis=0, dtype=np.uint8)
    return np.packbits(votes * 2 > len(packed), bitorder="little")


def _hashes(found, seed: int = 42) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(x, seed) for x in found], "<u8")


def fingerprint(text: bytes, width: int = 3) -> int:
    found = shingles(text, width)
    return int(_majority(_hashes(found)).view("<u8")[0]) if found else 0


#: Bits of a sketch; its first 64 are the fingerprint of the set of shingles.
BITS = 1024
_STEPS = np.arange(BITS // 64, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)


def sketch(text: bytes, width: int) -> tuple[list[int], int, list[int]]:
    """Of the set of shingles: a fingerprint of BITS bits as words of 64, its size, and the least and the largest of
    four hashes of each shingle.
    """
    found = set(shingles(text, width))
    if not found:
        return [0] * (BITS // 64), 0, [0] * 8
    many = _hashes(found)[:, None] + _STEPS
    many[:, 1:] = mix(many[:, 1:])
    return _majority(many).view("<u8").tolist(), len(found), [*many[:, :4].min(axis=0).tolist(), *many[:, :4].max(axis=0).tolist()]


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """(doc_id, fp): signed longs."""

    def run(batches):
        for batch in batches:
            found = np.array([fingerprint(x, width) for x in texts_of(batch)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found)], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text")).mapInArrow(run, "doc_id long, fp long")


def _blocks(fp: np.ndarray, bits: int):
    """An order of fp by the counts of its parts of that many bits, the distinct counts, and where each begins and ends."""
    counts = np.bitwise_count(np.ascontiguousarray(fp).view(f"<u{bits // 8}").reshape(len(fp), -1)).astype(np.int16)
    distinct, number = np.unique(counts, axis=0, return_inverse=True)
    number = number.reshape(-1)
    return np.argsort(number, kind="stable"), distinct, np.append(0, np.cumsum(np.bincount(number)))


def forest(left: np.ndarray, right: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of row numbers (right's follow left's) that span the links of left x right, or within left,
    and the number of links of each row.
    """
    bits = 16 if radius <= 4 else 64
    lo, lk, lb = _blocks(left, bits)
    ro, rk, rb = (lo, lk, lb) if right is None else _blocks(right, bits)
    other, shift = (left, 0) if right is None else (right, len(left))
    root, pairs = np.arange(shift + len(other)), []
    number = np.zeros(len(root), np.int64)
    for i in range(len(lk)):
        mine = lo[lb[i] : lb[i + 1]]
        near = np.flatnonzero(np.abs(rk - lk[i]).sum(axis=1) <= radius)
        near = near[near >= i] if right is None else near
        if not len(near):
            continue
        theirs = np.concatenate([ro[rb[j] : rb[j + 1]] for j in near])
        step = max(1, (1 << 18) // len(theirs))
        for k in range(0, len(mine), step):
            part = mine[k : k + step]
            x, y = np.nonzero(np.bitwise_count(left[part][:, None] ^ other[theirs][None, :]) <= radius)
            # within left, the block of part itself (it stands first) is met from both sides, and a row meets itself
            seen = (y < len(mine)) & (right is None)
            x, y = part[x], theirs[y] + shift
            np.add.at(number, x, 1)
            np.add.at(number, y[~seen], 1)
            while len(x):
                high, low = np.maximum(root[x], root[y]), np.minimum(root[x], root[y])
                apart = high != low
                x, y, high, low = x[apart], y[apart], high[apart], low[apart]
                if not len(x):
                    break
                high, at = np.unique(high, return_index=True)  # every higher root hooks to one lower root
                pairs.append(np.stack([x[at], y[at]], axis=1))
                to = np.arange(len(root))
                to[high] = low[at]
                while (to[to] != to).any():
                    to = to[to]
                root = to[root]
    return np.concatenate(pairs) if pairs else np.zeros((0, 2), np.int64), number - (right is None)


def bridges(left: np.ndarray, right: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Those pairs of forest(left, right, radius) that join what links within left and within right leave apart,
    and the number of links of each row.

    The links within a tile are found by the tile's own task, so a group that lies in many tiles
    costs about one pair for each two tiles and not one for each of its members in them.
    """
    found, number = forest(left, right, radius)
    if len(found) < 2:
        return found, number
    shift, root = len(left), {}

    def find(x):
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for side, rows, offset in ((left, np.unique(found[:, 0]), 0), (right, np.unique(found[:, 1]) - shift, shift)):
        for x, y in (rows[forest(side[rows], None, radius)[0]] + offset).tolist():
            root[find(y)] = find(x)
    kept = []
    for x, y in found.tolist():
        a, b = find(x), find(y)
        if a != b:
            root[b] = a
            kept.append((x, y))
    return np.array(kept, np.int64).reshape(-1, 2), number


def meetings(distinct: DataFrame, radius: int, tile_rows: int | None = None, tiles_of_all: int = 64, most: int = 500_000) -> DataFrame:
    """Distinct (fp, node long, ...) -> its rows once for each meeting (x, y) of their tile with a tile in
    reach, first: whether the row is of tile x.

    A tile holds about tile_rows fingerprints: if not given, one of tiles_of_all parts, so that a
    fingerprint goes to about as many tasks whatever the input, but `most` at most, so that a task's
    two tiles fit in memory.
    """
    if tile_rows is None:
        tile_rows = min(most, max(4096 if radius <= 4 else 256, distinct.count() // tiles_of_all))
    low = F.bit_count(F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)))
    high = F.bit_count(F.shiftrightunsigned("fp", 32))
    n = 65
    if radius <= 4:  # the counts of both halves
        tile = high * n + low
        near = [(a, b) for a in range(-radius, radius + 1) for b in range(-radius, radius + 1) if abs(a) + abs(b) <= radius]
    else:  # bands of the whole count, wide enough that only neighbours can meet
        tile = F.floor((high + low) / (radius + 1)) * n
        near = [(a, 0) for a in (-1, 0, 1)]
    tiles = distinct.withColumn("tile", tile.cast("int"))
    # no more rows than there are counts (33 * 33), whatever the input
    sizes = tiles.groupBy("tile").count().select("tile", F.ceil(F.col("count") / tile_rows).cast("int").alias("parts"))
    steps = F.array(*(F.struct(F.lit(a).alias("dh"), F.lit(b).alias("dl")) for a, b in near))
    theirs = sizes.select(F.col("tile").alias("other"), F.col("parts").alias("other_parts"))
    return (
        tiles.join(F.broadcast(sizes), "tile")
        .withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
        .withColumn("step", F.explode(steps))
        .withColumn("h", F.floor(F.col("tile") / n).cast("int") + F.col("step.dh"))
        .withColumn("l", F.col("tile") % n + F.col("step.dl"))
        .filter(F.col("h").between(0, n - 1) & F.col("l").between(0, n - 1))
        .withColumn("other", F.col("h") * n + F.col("l"))
        .join(F.broadcast(theirs), "other")
        .withColumn("other_part", F.explode(F.sequence(F.lit(0), F.col("other_parts") - 1)))
        .withColumn("me", F.col("tile").cast("long") * 1_000_000_000 + F.col("part"))
        .withColumn("you", F.col("other").cast("long") * 1_000_000_000 + F.col("other_part"))
        .select(F.least("me", "you").alias("x"), F.greatest("me", "you").alias("y"), (F.col("me") <= F.col("you")).alias("first"), *distinct.columns)
    )


def links(distinct: DataFrame, radius: int = 2, tile_rows: int | None = None) -> DataFrame:
    """Distinct (fp, node long) -> (a, b, n): edges a, b between nodes that span the links of the radius, and
    rows with null b that hold a number n of links of node a, to be summed.
    """

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        fp = pdf["fp"].to_numpy(np.int64).view(np.uint64)
        node, first = pdf["node"].to_numpy(), pdf["first"].to_numpy()
        if pdf["x"].iat[0] == pdf["y"].iat[0]:
            found, number = forest(fp, None, radius)
        elif first.all() or not first.any():
            found, number = np.zeros((0, 2), np.int64), np.zeros(len(fp), np.int64)
        else:
            found, number = bridges(fp[first], fp[~first], radius)
            node = np.concatenate([node[first], node[~first]])
        some = np.flatnonzero(number)
        edges = pd.DataFrame({"a": node[found[:, 0]], "b": pd.array(node[found[:, 1]], "Int64"), "n": 0})
        return pd.concat([edges, pd.DataFrame({"a": node[some], "b": pd.array([None] * len(some), "Int64"), "n": number[some]})])

    return meetings(distinct.select("fp", "node"), radius, tile_rows).groupBy("x", "y").applyInPandas(compare, "a long, b long, n long")


def near_duplicates(docs: DataFrame, width: int = 3, radius: int = 2) -> DataFrame:
    """documents (doc_id, text) -> doc_id, fingerprint (16 hex digits), component_id, n_links.

    component_id is the smallest doc_id of the group. n_links counts the other fingerprints of the
    table that lie within the radius.
    """
    hashed = cut(fingerprints(docs, width))
    # a node stands for a distinct fingerprint and is numbered by it
    distinct = cut(hashed.groupBy("fp").agg(F.min("doc_id").alias("least")).withColumn("node", F.col("fp")))
    found = cut(links(distinct, radius))
    labels = connected_components(found.filter("b is not null").select("a", "b"))
    numbers = found.filter("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n_links"))
    member = cut(labels.join(numbers, "node").join(distinct, "node"))
    least = cut(member.groupBy("label").agg(F.min("least").alias("component")))
    named = cut(member.join(least, "label").select("node", "component", "n_links"))
    groups = cut(distinct.join(named, "node", "left").select("fp", F.coalesce("component", "least").alias("component_id"), F.coalesce("n_links", F.lit(0)).alias("n_links")))
    return hashed.join(groups, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "n_links")


SKETCH = [f"s{i}" for i in range(BITS // 64)]
#: Bits in which the sketches of texts of a similarity of 0.8 may differ, by the smaller number of shingles.
FEW, REACH_FEW, REACH = 16, 230, 195


def _near(mine: dict, theirs: dict, radius: int, share: float, within: bool):
    """Blocks (rows of mine, rows of theirs, bits in which their sketches differ) of all pairs of different labels whose
    fingerprints, sizes and sketches allow a similarity of share.
    """
    step = max(1, (1 << 18) // max(1, len(theirs["fp"])))
    for k in range(0, len(mine["fp"]), step):
        low = k if within else 0
        x, y = np.nonzero(np.bitwise_count(mine["fp"][k : k + step][:, None] ^ theirs["fp"][low:][None, :]) <= radius)
        x, y = x + k, y + low
        small, large = np.minimum(mine["n"][x], theirs["n"][y]), np.maximum(mine["n"][x], theirs["n"][y])
        near = (mine["label"][x] != theirs["label"][y]) & (small >= share * large) & ((y > x) | (not within))
        x, y, small = x[near], y[near], small[near]
        for at in range(0, len(x), 1 << 14):
            i, j = x[at : at + (1 << 14)], y[at : at + (1 << 14)]
            differ = np.bitwise_count(mine["sketch"][i] ^ theirs["sketch"][j]).sum(axis=1, dtype=np.int64)
            near = differ <= np.where(small[at : at + (1 << 14)] < FEW, REACH_FEW, REACH)
            yield i[near], j[near], differ[near]


def _met(pdf: pd.DataFrame, radius: int, share: float):
    """The rows of a meeting, the blocks of their near pairs as row numbers, and the rows' columns."""
    within = pdf["x"].iat[0] == pdf["y"].iat[0]
    pdf = pdf if within else pdf.sort_values("first", ascending=False, kind="stable")
    words = np.ascontiguousarray(pdf[SKETCH].to_numpy(np.int64)).view(np.uint64)
    rows = {"fp": np.ascontiguousarray(words[:, 0]), "n": pdf["n"].to_numpy(), "label": pdf["label"].to_numpy(), "sketch": words}
    if within:
        return pdf, _near(rows, rows, radius, share, True)
    shift = int(pdf["first"].sum())
    found = _near({k: v[:shift] for k, v in rows.items()}, {k: v[shift:] for k, v in rows.items()}, radius, share, False)
    return pdf, ((i, j + shift, differ) for i, j, differ in found)


def proposals(distinct: DataFrame, radius: int, share: float, tile_rows: int | None = None) -> DataFrame:
    """Distinct (fp, words of the sketch, n, node, label) -> (a, near, least) for every node a that may be similar to a node of
    another label (see _near): of those nodes the one with the nearest sketch, and the least.
    """

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, found = _met(pdf, radius, share)
        node = pdf["node"].to_numpy()
        by_node = np.argsort(node, kind="stable")
        rank = np.empty(len(node), np.int64)
        rank[by_node] = np.arange(len(node))
        nearest = np.full(len(node), np.iinfo(np.int64).max)
        least = nearest.copy()
        for i, j, differ in found:
            for one, two in ((i, j), (j, i)):
                np.minimum.at(nearest, one, differ << 32 | rank[two])
                np.minimum.at(least, one, rank[two])
        a = np.flatnonzero(least < len(node))
        near = by_node[nearest[a] & 0xFFFFFFFF]
        return pd.DataFrame({"a": node[a], "near": node[near], "bits": nearest[a] >> 32, "least": node[by_node[least[a]]]})

    met = meetings(distinct.select(F.col("s0").alias("fp"), *SKETCH, "n", "node", "label"), radius, tile_rows, tiles_of_all=20).drop("fp")
    each = met.groupBy("x", "y").applyInPandas(compare, "a long, near long, bits long, least long")
    return each.groupBy("a").agg(F.min_by("near", F.struct("bits", "near")).alias("near"), F.min("least").alias("least"))


#: Bins of a histogram of shingles, and what a bin holds at most.
BINS, FULL = 1024, 65535


def histogram(text: bytes, width: int) -> np.ndarray:
    """How many shingles of the set fall into each of BINS bins, all FULL if there are more than FULL shingles. Two texts
    share at most the sum, over the bins, of the smaller of their counts.
    """
    found = _hashes(set(shingles(text, width)))
    if len(found) > FULL:
        return np.full(BINS, FULL, "<u2")
    return np.bincount((found >> np.uint64(40)).astype(np.int64) % BINS, minlength=BINS).astype("<u2")


def histograms(held: DataFrame, width: int) -> DataFrame:
    """held (node, text) -> (node, bins)."""

    def run(batches):
        for batch in batches:
            found = [histogram(x, width).tobytes() for x in texts_of(batch)]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(found, pa.binary())], names=["node", "bins"])

    return held.select("node", "text").mapInArrow(run, "node long, bins binary")


def candidates(distinct: DataFrame, radius: int, share: float, tile_rows: int | None = None) -> DataFrame:
    """Distinct (fp, words of the sketch, n, node, label, bins) -> every pair (a, b) of nodes with different labels that may be similar:
    see _near, and their histograms must allow them to share as many shingles as the similarity takes.
    """

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, found = _met(pdf, radius, share)
        node, n = pdf["node"].to_numpy(), pdf["n"].to_numpy()
        bins = np.frombuffer(b"".join(pdf["bins"]), "<u2").reshape(-1, BINS)
        out = [np.zeros((0, 2), np.int64)]
        for i, j, _ in found:
            for at in range(0, len(i), 1 << 12):
                x, y = i[at : at + (1 << 12)], j[at : at + (1 << 12)]
                most = np.minimum(bins[x], bins[y]).sum(axis=1, dtype=np.int64)
                able = most * (1 + share) >= share * (n[x] + n[y]) - 1e-3  # less for rounding; counts are whole
                out.append(np.stack([x[able], y[able]], axis=1))
        pairs = np.concatenate(out)
        return pd.DataFrame({"a": node[pairs[:, 0]], "b": node[pairs[:, 1]]})

    met = meetings(distinct.select(F.col("s0").alias("fp"), *SKETCH, "n", "node", "label", "bins"), radius, tile_rows, tiles_of_all=20, most=40_000).drop("fp")
    return met.groupBy("x", "y").applyInPandas(compare, "a long, b long")


def similar(a: bytes, b: bytes, width: int, share: float) -> bool:
    """Whether the sets of shingles have that Jaccard similarity; two empty sets are alike."""
    one, two = set(shingles(a, width)), set(shingles(b, width))
    return one == two or len(one & two) / len(one | two) >= share


def texts_of_nodes(texts: DataFrame, edges: DataFrame) -> DataFrame:
    """One text of each node of the edges (a, b)."""
    needed = edges.select(F.col("a").alias("node")).distinct().union(edges.select("b").distinct())
    return scratch(texts.join(needed, "node", "left_semi").dropDuplicates(["node"]))


def verified(edges: DataFrame, held: DataFrame, width: int, share: float) -> DataFrame:
    """Those of the edges (a, b) whose nodes' texts are similar. held: (node, text)."""

    def run(batches):
        for batch in batches:
            alike = [similar(x, y, width, share) for x, y in zip(texts_of(batch, "one"), texts_of(batch, "two"))]
            yield batch.select(["a", "b"]).filter(pa.array(alike, pa.bool_()))

    both = edges.join(held.select(F.col("node").alias("a"), F.col("text").alias("one")), "a").join(held.select(F.col("node").alias("b"), F.col("text").alias("two")), "b")
    return both.select("a", "b", "one", "two").mapInArrow(run, "a long, b long")


def near_groups(docs: DataFrame, width: int = 5, share: float = 0.8, radius: int = 20) -> DataFrame:
    """docs (text) -> (node, label): the hash of each distinct text that is similar to another, and its group.

    Texts whose sets of shingles have a Jaccard similarity of at least `share` are linked, and linked
    texts form a group. Every link is verified on the shingles themselves; two steps propose:

    1. Texts that share the least or largest of one of four shingle hashes are each proposed with one
       of them, the one with the most copies, as that is likely what the others were made from. The groups
       of the verified links are far fewer than the texts of a large group of copies.
    2. Tiled comparison: texts from different groups are near if the fingerprints differ in at most
       `radius` of 64 bits, the numbers of shingles allow the similarity, and sketches of 1,024 bits (the
       fingerprint continued) differ in at most REACH bits. Each text is first proposed with two of those
       near it, the nearest and the least, which joins most groups. Then every near pair of different
       groups is proposed whose histograms, of 1,024 bins of shingles, allow the similarity. They never
       allow less than what the two share, so no similar pair is left out, and of the pairs of a large
       group of copies with texts that are near it, but not similar, hardly any is.

    At a similarity J a bit differs with probability acos(2J / (1 + J)) / pi: 0.148 at 0.8, or 152 of
    1,024. With bits taken as independent a pair at 0.8 is left out of step 2 with a probability of
    about 2e-4, and out of step 1 with 3e-6 unless its least and largest shingles are also those of other
    texts. Texts are told apart by 64-bit hashes: an equal hash of different texts would make one of them
    a copy of the other.
    """
    texts = docs.select(F.xxhash64("text").alias("node"), F.col("text").cast("binary").alias("text"))
    leaders_of = [f"v{i}" for i in range(8)]
    names = [*SKETCH, "n", *leaders_of]

    def run(batches):
        for batch in batches:
            found = [sketch(x, width) for x in texts_of(batch)]
            columns = np.array([[*words, n, *values] for words, n, values in found], np.uint64).reshape(-1, len(names)).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("node"), *(pa.array(columns[:, i]) for i in range(len(names)))], names=["node", *names])

    sketched = texts.mapInArrow(run, "node long, " + ", ".join(f"{x} long" for x in names))
    hashed = cut(sketched.groupBy("node").agg(*(F.max(x).alias(x) for x in names), F.count("*").alias("copies")))
    values = hashed.select("node", "copies", F.posexplode(F.array(*leaders_of)).alias("k", "v"))
    shared = values.groupBy("k", "v").agg(F.count("*").alias("times")).filter("times > 1").select("k", "v")
    values = cut(values.join(shared, ["k", "v"]))
    leaders = values.groupBy("k", "v").agg(F.min_by("node", F.struct(-F.col("copies"), "node")).alias("a"))
    stars = cut(values.join(leaders, ["k", "v"]).filter("node <> a").select("a", F.col("node").alias("b")).distinct())
    sure = cut(verified(stars, texts_of_nodes(texts, stars), width, share))
    grouped = cut(hashed.join(connected_components(sure), "node", "left").select(*SKETCH, "n", "node", F.coalesce("label", "node").alias("label")))
    near = cut(proposals(grouped, radius, share))
    held = texts_of_nodes(texts, near.select("a", F.col("near").alias("b")))
    ends = near.select("a", F.explode(F.array("near", "least")).alias("b"))
    sure = cut(sure.union(verified(cut(ends.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()), held, width, share)))
    named = grouped.drop("label").join(near.select(F.col("a").alias("node")), "node").join(connected_components(sure), "node", "left")
    left = cut(named.withColumn("label", F.coalesce("label", "node")))
    pairs = cut(candidates(left.join(histograms(held, width), "node"), radius, share))
    return connected_components(cut(sure.union(verified(pairs, held, width, share))))


def keep_one(docs: DataFrame, width: int = 5, share: float = 0.8) -> DataFrame:
    """Keep one document of every group of near duplicates (near_groups): that with the smallest doc_id, one
    without an id only if no other has one; of rows that repeat both id and text, any one.

    All columns are kept; input columns _node, _id and _nth are dropped. Null, empty and blank texts
    are alike, so one of them stays. An empty table gives an empty one.
    """
    labels = near_groups(docs, width, share)
    docs = docs.drop("_node", "_id", "_nth")
    ids = docs.select(F.xxhash64("text").alias("node"), F.col("doc_id").cast("long").alias("id")).distinct()
    place = F.struct(F.col("id").isNull().alias("last"), "id", "node")
    kept = ids.join(labels, "node", "left").groupBy(F.coalesce("label", "node")).agg(F.min(place).alias("kept")).select(F.col("kept.id").alias("_id"), F.col("kept.node").alias("_node"))
    one = docs.join(kept, docs["doc_id"].cast("long").eqNullSafe(F.col("_id")) & (F.xxhash64(docs["text"]) == F.col("_node")))
    nth = F.row_number().over(Window.partitionBy("_id", "_node").orderBy(F.lit(0)))
    return one.withColumn("_nth", nth).filter("_nth = 1").drop("_nth", "_id", "_node")
