"""Language-model scores by context-tree weighting over bytes, beside unigram word statistics.

A byte is eight binary decisions. For each decision (the bits decided so far) there is a context
tree over the preceding bytes, of depths 0 to `depth`; every node has a Krichevsky-Trofimov estimate
from its counts of zeros and ones. Context-tree weighting gives every node the posterior probability
that its context needs no longer one, and the model's probability of a bit is the mixture, along the
path of contexts, of the nodes' estimates with these weights. A context that training never met adds
nothing and leaves its weight to the shorter one. The code length of a text is the sum over its
bits; a text starts in the context of zero bytes and ends with byte 255, which no UTF-8 text holds.

The counts of all nodes follow from the counts of (depth + 1)-byte sequences in the training texts,
which Spark sums; their number grows with the corpus. The tree is divided by the last two bytes of the
context: tasks weigh what lies below a pair of bytes and hand up the nodes of depth 2, tasks for each
last byte hand up those of depth 1 (65,280 at most, which the driver gets), and the mixtures come
down the same way. Texts are scored in batches: a batch asks for the sequences that occur in it, once
each, the tasks that hold a part of the tree answer, and answers and texts of a batch meet again. A
part of the tree answers to 1,024 batches in a task, so a frequent pair of bytes is not one task's.

Words are asked for and answered alike, by a join with the word counts of all training documents.

Null and empty texts have no byte and no word: they score their end and have their end token. Rows
with a null id are scored and never learned from. Rows that repeat an id are scored each. An empty
training set gives estimates from zero counts. A long text is scored in one batch, a megabyte at a
time. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterspark.llm.common import buckets, chunks, scratch, split_by, texts_of

#: Batches that one task answers to.
TOGETHER = 1024
END = b"\xff"


def log_gamma(x: np.ndarray) -> np.ndarray:
    """log of the gamma function for x > 0: Stirling's series after shifting up by 8."""
    x = np.asarray(x, np.float64)
    product = np.ones_like(x)
    for i in range(8):
        product *= x + i
    z = x + 8
    return (z - 0.5) * np.log(z) - z + 0.5 * math.log(2 * math.pi) + 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5) - np.log(product)


def kt_log(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """log of the Krichevsky-Trofimov probability of any sequence with those counts."""
    return log_gamma(zeros + 0.5) + log_gamma(ones + 0.5) - log_gamma(zeros + ones + 1.0) - math.log(math.pi)


def grams(data: list[bytes], depth: int) -> np.ndarray:
    """The (depth + 1)-byte sequence ending at each byte of the texts, as a number; texts start after zeros."""
    pad = bytes(depth)
    joined = np.frombuffer(pad + pad.join(data), np.uint8).astype(np.int64)
    out = np.zeros(len(joined) - depth, np.int64)
    for back in range(depth + 1):
        out |= joined[depth - back : len(joined) - back] << np.int64(8 * back)
    inside = np.ones(len(out), bool)
    at = 0
    for x in data[:-1]:
        at += len(x)
        inside[at : at + depth] = False
        at += depth
    return out[inside] if depth else out


@dataclass
class Nodes:
    """Nodes of one depth, by name (context << 8 | decision): counts, log weighted probability, weight of ending here."""

    names: np.ndarray
    zeros: np.ndarray
    ones: np.ndarray
    weighted: np.ndarray
    leaf: np.ndarray

    def columns(self):
        return [self.names, self.zeros, self.ones, self.weighted, self.leaf]


def deepest(keys: np.ndarray, counts: np.ndarray) -> Nodes:
    """The nodes of the full depth from the sequences' counts."""
    context, byte = keys >> 8, keys & 255
    node = np.concatenate([context << 8 | (1 << b | byte >> (8 - b)) for b in range(8)])
    one = np.concatenate([byte >> (7 - b) & 1 for b in range(8)])
    names, at = np.unique(node, return_inverse=True)
    n = np.tile(counts.astype(np.float64), 8)
    ones, zeros = np.bincount(at, n * one, len(names)), np.bincount(at, n * (1 - one), len(names))
    return Nodes(names, zeros, ones, kt_log(zeros, ones), np.ones(len(names)))


def parents(below: Nodes, depth: int) -> Nodes:
    """The nodes of a depth from all of their children: a context without its first byte."""
    names, at = np.unique((below.names >> 8 & ((1 << 8 * depth) - 1)) << 8 | below.names & 255, return_inverse=True)
    zeros, ones, split = (np.bincount(at, x, len(names)) for x in (below.zeros, below.ones, below.weighted))
    kt = kt_log(zeros, ones)
    weighted = np.logaddexp(kt, split) - math.log(2)
    return Nodes(names, zeros, ones, weighted, np.exp(kt - math.log(2) - weighted))


@dataclass
class Mixture:
    """Of contexts of one depth, for each decision: the mixture over the shorter contexts, the weight left for
    longer ones, and the estimate that takes this weight where no longer context was met.
    """

    contexts: np.ndarray
    done: np.ndarray
    rest: np.ndarray
    own: np.ndarray

    @staticmethod
    def start() -> Mixture:
        return Mixture(np.zeros(1, np.int64), np.zeros((1, 256)), np.ones((1, 256)), np.full((1, 256), 0.5))

    def deeper(self, nodes: Nodes, depth: int) -> Mixture:
        contexts = np.unique(nodes.names >> 8)
        up = np.searchsorted(self.contexts, contexts & ((1 << 8 * (depth - 1)) - 1)) if depth else np.zeros(len(contexts), np.int64)
        done, rest, own = self.done[up], self.rest[up], self.own[up]
        at = (np.searchsorted(contexts, nodes.names >> 8), nodes.names & 255)
        own[at] = (nodes.ones + 0.5) / (nodes.zeros + nodes.ones + 1)
        done[at] += rest[at] * nodes.leaf * own[at]
        rest[at] *= 1 - nodes.leaf
        return Mixture(contexts, done, rest, own)

    def one(self) -> np.ndarray:
        """The probability of a one for each decision, if no longer context is met."""
        return self.done + self.rest * self.own


def predict(levels: list[tuple[int, Mixture]], asked: np.ndarray) -> np.ndarray:
    """log10 probability of the asked sequences, each by the longest context that one of the levels (depth, mixture) has."""
    out = np.zeros(len(asked))
    todo = np.arange(len(asked))
    for depth, level in reversed(levels):
        context = asked[todo] >> 8 & ((1 << 8 * depth) - 1)
        at = np.minimum(np.searchsorted(level.contexts, context), max(0, len(level.contexts) - 1))
        met = level.contexts[at] == context if len(level.contexts) else np.zeros(len(todo), bool)
        one, rows, byte = level.one(), at[met], asked[todo[met]] & 255
        for b in range(8):
            p = one[rows, 1 << b | byte >> (8 - b)]
            out[todo[met]] += np.log10(np.where(byte >> (7 - b) & 1, p, 1 - p))
        todo = todo[~met]
    return out


def bucket_of(suffix, n: int):
    """Which of n buckets holds the contexts that end with these two bytes; suffix: an array of numbers or a column."""
    if isinstance(suffix, np.ndarray):
        return (suffix * 2654435761 >> 12) % n
    return F.pmod(F.shiftright(suffix.cast("long") * F.lit(2654435761), 12), F.lit(n))


def summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    names, at = np.unique(np.concatenate(keys), return_inverse=True)
    return names, np.bincount(at, np.concatenate(counts), len(names)).astype(np.int64)


def counts(docs: DataFrame, depth: int, most: int = 1 << 21) -> DataFrame:
    """(word, key, n): how often each word occurs (the empty word: the end token), and each byte sequence (word null)."""

    def rows(words: Counter, keys: np.ndarray, n: np.ndarray):
        some = [w.decode("utf-8", "replace") for w in words]
        yield pa.RecordBatch.from_arrays(
            [pa.array(some + [None] * len(keys), pa.string()), pa.array(np.concatenate([np.zeros(len(some), np.int64), keys])), pa.array(np.concatenate([np.array(list(words.values()), np.int64), n]))],
            names=["word", "key", "n"],
        )

    def run(batches):
        words: Counter[bytes] = Counter()
        keys, number = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for batch in batches:
            texts = texts_of(batch)
            words[b""] += len(texts)
            for a, b in chunks([len(x) for x in texts], 1 << 22):
                for x in texts[a:b]:
                    words.update(x.lower().split())
                key, n = np.unique(grams([x + END for x in texts[a:b]], depth), return_counts=True)
                keys.append(key)
                number.append(n)
                if sum(map(len, keys)) > 2 * most:
                    both = summed(keys, number)
                    keys, number = [both[0]], [both[1]]
                if len(keys[0]) > most or len(words) > most:
                    yield from rows(words, *summed(keys, number))
                    words, keys, number = Counter(), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        yield from rows(words, *summed(keys, number))

    made = docs.select(F.col("text").cast("binary").alias("text")).mapInArrow(run, "word string, key long, n long")
    return made.groupBy("word", "key").agg(F.sum("n").alias("n"))


_TREE = "head int, bucket long, a binary, b binary, c binary, d binary, e binary"


def _tree_rows(rows) -> pa.Table:
    """rows: (head or None, bucket or None, arrays)."""
    rows = list(rows)
    columns = [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int64())]
    columns += [pa.array([r[2][k].tobytes() if k < len(r[2]) else None for r in rows], pa.binary()) for k in range(5)]
    return pa.table(columns, names=[x.split()[0] for x in _TREE.split(", ")])


def _array(group: pa.Table, name: str, kind=np.float64) -> np.ndarray:
    return np.frombuffer(b"".join(x for x in group.column(name).to_pylist() if x), kind)


def _nodes(group: pa.Table) -> Nodes:
    names = _array(group, "a", np.int64)
    order = np.argsort(names)
    return Nodes(names[order], *(_array(group, k)[order] for k in "bcde"))


def tree(sequences: DataFrame, depth: int, n: int) -> tuple[DataFrame, list[Mixture]]:
    """(key, n) -> the tree's parts (bucket, and either sequences a and counts b, or a mixture of depth 2 in b to e
    with its contexts in a), and the mixtures of depths 0 and 1.
    """
    spark = sequences.sparkSession

    def below(group: pa.Table) -> pa.Table:
        keys, number = (group.column(c).to_numpy() for c in ("key", "n"))
        order = np.argsort(keys >> 8 & 0xFFFF, kind="stable")
        keys, number = keys[order], number[order]
        out = [(None, group.column("bucket")[0].as_py(), [keys, number])]
        for _, at in split_by(keys >> 8 & 0xFFFF):
            nodes = deepest(keys[at], number[at])
            for d in range(depth - 1, 1, -1):
                nodes = parents(nodes, d)
            out.append((int(nodes.names[0] >> 8 & 255), None, nodes.columns()))
        return _tree_rows(out)

    def middle(group: pa.Table) -> pa.Table:
        return _tree_rows([(0, None, parents(_nodes(group), 1).columns())])

    dealt = sequences.withColumn("bucket", bucket_of(F.shiftright("key", 8).bitwiseAND(0xFFFF), n))
    held = scratch(dealt.groupBy("bucket").applyInArrow(below, _TREE))
    heads = held.filter("head is not null")
    top = heads.groupBy("head").applyInArrow(middle, _TREE).toArrow()  # 256 rows of 255 nodes at most
    one = _nodes(top)
    levels = [Mixture.start().deeper(parents(one, 0), 0)] if len(one.names) else [Mixture.start()]
    levels.append(levels[0].deeper(one, 1))
    above = spark.sparkContext.broadcast(levels[1])

    def down(group: pa.Table) -> pa.Table:
        made = above.value.deeper(_nodes(group), 2)
        return _tree_rows((None, None, [made.contexts[i : i + 1], *(x[i] for x in (made.done, made.rest, made.own))]) for i in range(len(made.contexts)))

    mixtures = heads.groupBy("head").applyInArrow(down, _TREE)
    # a context of two bytes is a little-endian long here
    context = sum((F.conv(F.hex(F.substring("a", k + 1, 1)), 16, 10).cast("long") * (1 << 8 * k) for k in range(2)), F.lit(0).cast("long"))
    mixtures = mixtures.withColumn("bucket", bucket_of(context, n))
    return held.filter("head is null").drop("head", "e").union(mixtures.drop("head", "e")), levels


def answered(parts: DataFrame, levels: list[Mixture], asked: DataFrame, depth: int, batches: int) -> DataFrame:
    """Parts of the tree and asked (batch, bucket, keys) -> (batch, keys, logs)."""
    top = parts.sparkSession.sparkContext.broadcast(levels)

    def run(model: pa.Table, questions: pa.Table) -> pa.Table:
        if not questions.num_rows:
            return questions.select(["batch", "keys"]).append_column("logs", pa.array([], pa.binary()))
        wanted = [np.frombuffer(x, np.int64) for x in questions.column("keys").to_pylist()]
        all_ = np.unique(np.concatenate(wanted))
        logs = np.zeros(len(all_))
        has = {} if not model.num_rows else {
            int(np.frombuffer(a, np.int64)[0]): Mixture(np.frombuffer(a, np.int64), *(np.frombuffer(x, np.float64).reshape(1, 256) for x in rest))
            for a, *rest in zip(*(model.column(c).to_pylist() for c in "abcd")) if rest[1] is not None
        }
        held = model.filter(pa.compute.is_null(model.column("c"))) if model.num_rows else model
        keys, number = _array(held, "a", np.int64), _array(held, "b", np.int64)
        own = dict(split_by(keys >> 8 & 0xFFFF))
        for suffix, at in split_by(all_ >> 8 & 0xFFFF):
            found = list(enumerate(top.value))
            if suffix in has:
                nodes = [deepest(keys[own[suffix]], number[own[suffix]])]
                for d in range(depth - 1, 2, -1):
                    nodes.append(parents(nodes[-1], d))
                found.append((2, has[suffix]))
                for d in range(3, depth + 1):
                    found.append((d, found[-1][1].deeper(nodes[depth - d], d)))
            logs[at] = predict(found, all_[at])
        made = [logs[np.searchsorted(all_, w)].tobytes() for w in wanted]
        return pa.table({"batch": questions.column("batch"), "keys": questions.column("keys"), "logs": pa.array(made, pa.binary())})

    pieces = -(-batches // TOGETHER)
    copies = parts.withColumn("piece", F.explode(F.sequence(F.lit(0), F.lit(pieces - 1))))
    dealt = asked.withColumn("piece", F.floor(F.col("batch") / TOGETHER).cast("int"))
    key = ["bucket", "piece"]
    return copies.groupBy(*key).cogroup(dealt.groupBy(*key)).applyInArrow(run, "batch long, keys binary, logs binary")


def score(docs: DataFrame, training: DataFrame, depth: int = 4) -> DataFrame:
    """All of docs (doc_id, held_out, text), learning from `training` (text): doc_id, held_out, n_tokens, n_known,
    train_tokens, base_score, score, n_bytes, bits_per_byte (the end counts as a byte).
    """
    if not 2 <= depth <= 6:
        raise ValueError("depth is 2 to 6")
    n = buckets(docs)
    counted = scratch(counts(training, depth))
    words = counted.filter("word is not null").select("word", F.col("n").alias("c"))
    total, distinct = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    norm = math.log10(total + 0.5 * (distinct + 1))
    parts, levels = tree(counted.filter("word is null").select("key", "n"), depth, n)
    dealt = docs.select("doc_id", "held_out", F.col("text").cast("binary").alias("text")).withColumn("batch", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)))

    def ask(group: pa.Table) -> pa.Table:
        texts, words, found = texts_of(group), {b""}, []
        for a, b in chunks([len(x) for x in texts], 1 << 22):
            for x in texts[a:b]:
                words.update(x.lower().split())
            found.append(np.unique(grams([x + END for x in texts[a:b]], depth)))
        all_ = np.unique(np.concatenate(found))
        rows = [(None, bucket, all_[at].tobytes()) for bucket, at in split_by(bucket_of(all_ >> 8 & 0xFFFF, n))]
        rows += [(w.decode("utf-8", "replace"), None, None) for w in words]
        word, bucket, keys = zip(*rows)
        return pa.table({"batch": pa.array([group.column("batch")[0].as_py()] * len(rows), pa.int64()), "word": pa.array(word, pa.string()), "bucket": pa.array(bucket, pa.int64()), "keys": pa.array(keys, pa.binary())})

    asked = scratch(dealt.groupBy("batch").applyInArrow(ask, "batch long, word string, bucket long, keys binary"))
    questions = asked.filter("word is null").select("batch", "bucket", "keys")
    known = asked.filter("word is not null").join(words, "word").select("batch", "word", "c", F.lit(None).cast("binary").alias("keys"), F.lit(None).cast("binary").alias("logs"))
    answers = answered(parts, levels, questions, depth, n).select("batch", F.lit(None).cast("string").alias("word"), F.lit(None).cast("long").alias("c"), "keys", "logs").union(known)

    def run(docs: pa.Table, found: pa.Table) -> pa.Table:
        texts = texts_of(docs)
        c = {w.encode(): k for w, k in zip(found.column("word").to_pylist(), found.column("c").to_pylist()) if w is not None}
        keys, logs = _array(found, "keys", np.int64), _array(found, "logs")
        order = np.argsort(keys)
        keys, logs = keys[order], logs[order]
        scores, out = np.zeros(len(texts)), []
        for a, b in chunks([len(x) for x in texts]):
            size = np.array([len(x) + 1 for x in texts[a:b]])
            at = np.searchsorted(keys, grams([x + END for x in texts[a:b]], depth))
            scores[a:b] = np.add.reduceat(logs[at], np.cumsum(size) - size)
        for x in texts:
            bag = Counter(x.lower().split())
            bag[b""] = 1
            hits = [(k, c.get(w, 0)) for w, k in bag.items()]
            out.append((sum(bag.values()), sum(k for k, v in hits if v), sum(k * math.log10(v + 0.5) for k, v in hits), len(x)))
        tokens, hit, base, size = (np.array(x) for x in zip(*out)) if out else [np.zeros(0)] * 4
        bits = -scores / (size + 1) / math.log10(2)
        return pa.table({
            "doc_id": docs.column("doc_id"), "held_out": docs.column("held_out"), "n_tokens": pa.array(tokens, pa.int64()), "n_known": pa.array(hit, pa.int64()),
            "train_tokens": pa.array([total] * len(texts), pa.int64()), "base_score": pa.array(base - tokens * norm, pa.float64()), "score": pa.array(scores), "n_bytes": pa.array(size, pa.int64()), "bits_per_byte": pa.array(bits),
        })

    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, n_bytes long, bits_per_byte double"
    return dealt.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(run, schema)
