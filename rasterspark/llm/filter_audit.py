"""Audit of how filters interact: what each removes, in every order of five filters.

Filters A to E and their failure conditions are in `failures` (A to D, from a text alone) and in the routed
stage (E: the text is that of a document of smaller doc_id, whether or not other filters remove it).

Equal texts meet by fingerprint: records are partitioned by the XXH64 of their text, and a partition keeps
for each fingerprint a chain of (full text, smallest doc_id, its records), so texts of equal hashes are told
apart. Every record whose id is not the smallest of its text fails E. Before the shuffle each task runs the
same chains over its own rows: of a text only the records of the smallest id travel with the text; the others
are known to fail E and go without it, spread evenly. A text of a third of all rows so costs its partition one
entry a task. A task hands its chains on at `held_bytes` of text and begins new ones.

Each document then is a mask of the filters that it fails. Masks are joined with the labels (small rows, no
text), and combineByKey merges for each part a vector of 32 masks by (documents, good, toxic). From a part's
vector the counts of all 120 orders are sums over masks.

Null and empty texts are empty: they fail A, and E if an empty text of smaller id exists. A null lang is the
part of the empty string. Rows of one doc_id count each and do not make each other fail E; rows of a null
doc_id never fail E, make none fail, and have no label. Of repeated labels any that says 1 counts; null labels
say nothing. Other columns are ignored, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

import itertools

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterspark.llm.common import buckets

NAMES = "ABCDE"
_CAPITALS, _ODD = bytes(range(65, 91)), b"#$%&*|"


def failures(text: str) -> int:
    """Bits of the filters A to D that a text fails: bit i for NAMES[i]."""
    data = text.encode()
    words = data.split()  # bytes: only ASCII white space
    a = len(words) < 200
    b = 100 * len(set(words)) < 50 * len(words)
    c = 100 * (len(data) - len(data.translate(None, _CAPITALS))) > 3 * len(text)
    d = len(data.translate(None, _ODD)) < len(data)
    return a | b << 1 | c << 2 | d << 3


class Chains:
    """Texts by fingerprint, each with its smallest id and the records that have it."""

    def __init__(self):
        self.of, self.size = {}, 0

    def add(self, hashed: int, text: str, doc: int, records: list):
        """Records of `doc`; gives the records that are now known to have a larger id than another of the same text."""
        chain = self.of.setdefault(hashed, [])
        for entry in chain:
            if entry[0] == text:
                if doc > entry[1]:
                    return records
                beaten = []
                if doc < entry[1]:
                    beaten, entry[1], entry[2] = entry[2], doc, []
                entry[2] += records
                return beaten
        chain.append([text, doc, list(records)])
        self.size += len(text)
        return []

    def entries(self):
        for hashed, chain in self.of.items():
            for text, doc, records in chain:
                yield hashed, text, doc, records


def masks(docs: DataFrame, held_bytes: int = 64 << 20) -> DataFrame:
    """documents (doc_id, text, lang) -> (doc_id, part, mask), one row for each."""
    import xxhash

    n = buckets(docs)
    failed = 1 << NAMES.index("E")

    def route(rows):
        held = Chains()
        for doc, text, part in rows:
            mask, hashed = failures(text), xxhash.xxh64_intdigest(text)
            if doc is None:
                yield hashed, (None, doc, [(part, mask)])
                continue
            for other in held.add(hashed, text, doc, [(part, mask, doc)]):
                yield _spread(other[2]), (None, other[2], [(other[0], other[1] | failed)])
            if held.size >= held_bytes:
                yield from ((h, (t, d, [r[:2] for r in records])) for h, t, d, records in held.entries())
                held = Chains()
        yield from ((h, (t, d, [r[:2] for r in records])) for h, t, d, records in held.entries())

    def settle(routed):
        held = Chains()
        for hashed, (text, doc, records) in routed:
            if text is None:
                yield from ((doc, *r) for r in records)
            else:
                yield from ((d, part, mask | failed) for part, mask, d in held.add(hashed, text, doc, [(*r, doc) for r in records]))
        for _, _, doc, records in held.entries():
            yield from ((doc, *r[:2]) for r in records)

    def _spread(doc: int) -> int:
        return (doc * 0x9E3779B97F4A7C15 & (1 << 64) - 1) >> 20

    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")), F.coalesce(F.col("lang").cast("string"), F.lit("")))
    # the hash alone says where a record goes
    found = rows.rdd.mapPartitions(route).partitionBy(n, lambda hashed: hashed).mapPartitions(settle)
    return docs.sparkSession.createDataFrame(found, "doc_id long, part string, mask int")


def count_vectors(found: DataFrame, labels: DataFrame, n: int):
    """(doc_id, part, mask) and labels -> RDD of (part, array of 32 masks x (documents, good, toxic))."""
    said = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"), F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic")
    )
    rows = found.join(said, "doc_id", "left").select("part", "mask", F.coalesce("good", F.lit(0)), F.coalesce("toxic", F.lit(0)))

    def add(vector: np.ndarray, row) -> np.ndarray:
        vector[row[0]] += (1, row[1], row[2])
        return vector

    def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        a += b
        return a

    pairs = rows.rdd.map(lambda r: (r[0], (r[1], r[2], r[3])))
    return pairs.combineByKey(lambda row: add(np.zeros((1 << len(NAMES), 3), np.int64), row), add, merge, n)


COLUMNS = ("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def orders_of(part: str, vector: np.ndarray) -> list[tuple]:
    """Rows of all orders and steps from a part's counts by mask."""
    every = np.arange(len(vector))
    count, lost = vector[:, 0], []
    rows, shapley = [], dict.fromkeys(NAMES, 0)
    for order in itertools.permutations(NAMES):
        before = np.zeros(len(vector), bool)
        for step, name in enumerate(order, 1):
            bit = 1 << NAMES.index(name)
            fails = every & bit > 0
            here = fails & ~before
            lost = vector[here].sum(axis=0).tolist()
            redundant, unique = int(count[fails & before].sum()), int(count[bit])
            before |= fails
            shapley[name] += lost[0]
            rows.append((part, "".join(order), step, int(count[~before].sum()), lost[0], redundant, unique, lost[1], lost[2], name))
    return [(*r[:-1], shapley[r[-1]]) for r in rows]


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """documents (doc_id, text, lang), labels (doc_id, quality, toxic) -> for each part, order and step the counts of COLUMNS.

    A part's counts are those of its documents only; E looks at the whole table.
    """
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = count_vectors(masks(docs), labels, n).flatMap(lambda held: orders_of(*held))
    kinds = ", ".join(f"{c} {'string' if i < 2 else 'int' if c == 'step' else 'long'}" for i, c in enumerate(COLUMNS))
    return docs.sparkSession.createDataFrame(rows, kinds)
