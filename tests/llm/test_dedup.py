"""The dedup operators against brute force, and their edge cases."""

import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest
import xxhash

from rasterspark.llm import components, hashing, simhash, substring_dedup, suffix_dedup

SCHEMA = "doc_id long, text string"


def corpus(seed=0, n=60):
    """Random words with copies, near copies, shared passages, nulls and empties."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    shared = [" ".join(rng.choices(words, k=90)) for _ in range(3)]
    texts = []
    for i in range(n):
        t = " ".join(rng.choices(words, k=rng.choice([0, 1, 2, 3, 19, 20, 21, 60, 200])))
        if rng.random() < 0.4:
            cut = rng.randrange(len(t) + 1)
            t = t[:cut] + rng.choice([" ", "\n", ""]) + rng.choice(shared) + " " + t[cut:]
        texts.append(t)
    for i in range(n // 3):
        t = rng.choice(texts[:n])
        w = t.split()
        if w and rng.random() < 0.6:
            w[rng.randrange(len(w))] = "edited"
            t = " ".join(w)
        texts.append(t)
    texts += [None, "", "   ", "é ü " * 150, "é ü " * 150, "ab" * 500]
    return [(i, t) for i, t in enumerate(texts)]


def same_by_id(df, expected, *names):
    rows = {r["doc_id"]: tuple(r[n] for n in names) for r in df.collect()}
    assert rows == expected


def brute_simhash(rows, width=3, radius=2):
    fps = {}
    for d, t in rows:
        w = bytes(t or "", "utf-8").lower().split()
        sh = [b" ".join(w[i : i + width]) for i in range(max(1, len(w) - width + 1))] if w else []
        hs = [xxhash.xxh64_intdigest(s, 42) for s in sh]
        fps[d] = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))
    label = {d: d for d in fps}
    changed = True
    while changed:
        changed = False
        for a in fps:
            for b in fps:
                if (fps[a] ^ fps[b]).bit_count() <= radius and label[b] < label[a]:
                    label[a], changed = label[b], True
    return {d: (f"{fps[d]:016x}", label[d]) for d in fps}


def test_simhash_matches_brute_force(spark):
    rows = corpus(1)
    same_by_id(simhash.near_duplicates(spark.createDataFrame(rows, SCHEMA)), brute_simhash(rows), "fingerprint", "component_id")


def test_spark_hash_is_the_shingles_hash(spark):
    got = spark.sql("select xxhash64('the quick brown é')").first()[0]
    assert got & (1 << 64) - 1 == xxhash.xxh64_intdigest("the quick brown é".encode(), 42)


@pytest.mark.parametrize("radius", [0, 2, 4, 6, 12])
def test_tiles_find_every_link(spark, radius):
    rng = np.random.default_rng(radius)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    fps = {int(x) for x in base}
    for x in base:
        for _ in range(6):
            bits = rng.choice(64, rng.integers(1, 14), replace=False)
            fps.add(int(x) ^ sum(1 << int(b) for b in bits))
    values = sorted(fps)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    df = spark.createDataFrame([(s, i) for i, s in enumerate(signed)], "fp long, node long")
    found = simhash.links(df, radius, tile_rows=16)
    got = {r["node"]: r["label"] for r in components.connected_components(found.filter("b is not null").select("a", "b")).collect()}
    numbers = {r["a"]: r["sum(n)"] for r in found.filter("b is null").groupBy("a").sum("n").collect()}
    true = {i: sum(0 < (a ^ b).bit_count() <= radius for b in values) for i, a in enumerate(values)}
    assert numbers == {i: n for i, n in true.items() if n}
    label = list(range(len(values)))
    changed = True
    while changed:
        changed = False
        for i, a in enumerate(values):
            for j, b in enumerate(values):
                if (a ^ b).bit_count() <= radius and label[j] < label[i]:
                    label[i], changed = label[j], True
    assert {i: got.get(i, i) for i in range(len(values))} == dict(enumerate(label))


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 100), (200, 201)], "a long, b long")
    got = {r["node"]: r["label"] for r in components.connected_components(edges).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 200: 200, 201: 200}


def test_keep_one_keeps_columns_and_singles(spark):
    rows = [(1, "a b c d e f g h i j k l m n o p", "x"), (2, "a b c d e f g h i j k l m n o p", "y"), (3, "quite other words stand here you see now", "z"), (4, None, None)]
    got = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string, component_id string"))
    assert sorted(r.doc_id for r in got.collect()) == [1, 3, 4] and got.columns == ["doc_id", "text", "component_id"]


def brute_bytes(rows, width=400):
    seen = defaultdict(int)
    data = [(d, (t or "").encode()) for d, t in rows]
    for _, b in data:
        for i in range(len(b) - width + 1):
            seen[b[i : i + width]] += 1
    out = {}
    for d, b in data:
        gone = np.zeros(len(b) + 2, np.int8)
        for i in range(len(b) - width + 1):
            if seen[b[i : i + width]] > 1:
                gone[i + 1 : i + 1 + width] = 1
        out[d] = (len(b), int(gone.sum()), int((np.diff(gone) == 1).sum()), hashlib.sha256(bytes(x for x, g in zip(b, gone[1:]) if not g)).hexdigest())
    return out


@pytest.mark.parametrize("hot", [2000, 1])
@pytest.mark.parametrize("width", [400, 100])
def test_suffix_dedup_matches_brute_force(spark, hot, width):
    rows = corpus(2)
    got = suffix_dedup.remove_repeated(spark.createDataFrame(rows, SCHEMA).repartition(3), width=width, hot=hot)
    same_by_id(got, brute_bytes(rows, width), "n_bytes", "n_removed", "n_spans", "kept_sha256")


def test_suffix_sort_orders_like_bytes():
    rng = random.Random(3)
    texts = [bytes(rng.choices(b"ab", k=rng.randrange(1, 40))) for _ in range(200)]
    data = np.frombuffer(b"".join(texts), np.uint8)
    size = np.array([len(t) for t in texts])
    group = np.array([rng.randrange(5) for _ in texts])
    order, common = suffix_dedup.suffix_order(data, np.cumsum(size) - size, size, group)
    assert order.tolist() == sorted(range(len(texts)), key=lambda i: (group[i], texts[i], i))
    for k in range(1, len(order)):
        a, b = texts[order[k - 1]], texts[order[k]]
        true = next((n for n, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        assert common[k] == (true if group[order[k]] == group[order[k - 1]] else 0)


def brute_words(rows, width=20):
    first, starts = {}, {}
    words = {d: (t or "").encode().split() for d, t in rows}
    for d in sorted(words):
        for i in range(len(words[d]) - width + 1):
            key = tuple(words[d][i : i + width])
            starts[d, i] = first.setdefault(key, (d, i)) != (d, i)
    out = {}
    for d, w in words.items():
        gone = {i + k for i in range(len(w) - width + 1) if starts[d, i] for k in range(width)}
        out[d] = (len(w), len(gone), hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in gone)).hexdigest())
    return out


def test_substring_dedup_matches_brute_force(spark):
    rows = corpus(4)
    got = substring_dedup.remove(spark.createDataFrame(rows, SCHEMA).repartition(3), with_text=False)
    same_by_id(got, brute_words(rows), "n_words", "n_removed", "kept_sha256")


def test_difference_cover_aligns_all_shifts():
    cover, v = substring_dedup.COVER, substring_dedup.PERIOD
    assert all(any((i + s) % v in cover and (j + s) % v in cover for s in range(v)) for i in range(v) for j in range(v))


def test_edge_rows(spark):
    """Empty tables, null ids, repeated rows, clashing columns, one long text."""
    runs = (simhash.near_duplicates, suffix_dedup.remove_repeated, substring_dedup.remove, simhash.keep_one)
    assert all(run(spark.createDataFrame([], SCHEMA)).count() == 0 for run in runs)
    long = " ".join(str(i * i) for i in range(40_000))
    rows = [(None, "a b"), (None, None), (5, long), (5, long), (6, ""), (7, None), (-3, "x")]
    names = ", bucket int, row string, fp long, node long, label string, n_links int, twin int, n_bytes int, _listed string"
    wide = spark.createDataFrame([(*r, 1, "k", 2, 3, "l", 4, 5, 6, "m") for r in rows], SCHEMA + names)
    near, bytes_, words, one = (run(wide).collect() for run in runs)
    key = lambda v: (v is None, v or 0)
    ids = sorted((d for d, _ in rows), key=key)
    assert sorted(((r.doc_id, r.component_id) for r in near), key=lambda x: (key(x[0]), key(x[1]))) == [(-3, -3), (5, 5), (5, 5), (6, 6), (7, 6), (None, 6), (None, None)]
    assert sorted((r.doc_id for r in bytes_), key=key) == sorted((r.doc_id for r in words), key=key) == ids
    assert [(r.n_bytes, r.n_removed, r.n_spans) for r in bytes_ if r.doc_id == 5] == [(len(long), len(long), 1)] * 2 and sum(r.n_removed for r in bytes_) == 2 * len(long)
    assert [(r.n_words, r.n_removed) for r in words if r.doc_id == 5] == [(40_000, 0)] * 2 and all(r.n_removed == 0 and r.bucket == 1 for r in words)
    assert sorted((r.doc_id for r in one), key=key) == [-3, 5, 6, None]


def test_repeated_rows(spark):
    text = " ".join(str(i * 7) for i in range(300))
    df = spark.createDataFrame([(1, text), (1, text)], SCHEMA)
    assert [r.n_removed for r in substring_dedup.remove(df).collect()] == [0, 0]
    assert [r.n_removed for r in suffix_dedup.remove_repeated(df).collect()] == [len(text)] * 2
    assert {(r.component_id) for r in simhash.near_duplicates(df).collect()} == {1}


def test_text_without_repeats_is_left_alone(spark):
    df = spark.createDataFrame([(1, "a\n\n b\tc "), (2, None)], SCHEMA)
    assert {r.doc_id: r.text for r in substring_dedup.remove(df).collect()} == {1: "a\n\n b\tc ", 2: None}


def test_keep_one_meets_the_shingle_similarity(spark):
    """Planted pairs just above and below 0.8, against all pairs by brute force."""
    rng = random.Random(6)
    fresh = iter(range(10**6))
    texts = []
    for n in (40, 120, 300):
        for k in range(40):
            first = [f"w{next(fresh)}" for _ in range(n)]
            second = list(first)
            limit = round(n / 10 / 5 * (0.8 + 0.5 * rng.random())) + 1
            for i in rng.sample(range(n), limit):
                second[i] = f"w{next(fresh)}"
            texts += [" ".join(first), " ".join(second)]
    texts += ["same line here again now " * 40, "same line here again now " * 3, None, " "]  # one set of shingles whatever the repeats
    rows = list(enumerate(texts))
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for t in texts for w in [(t or "").split()]]
    label, near = list(range(len(rows))), []
    for i in range(len(rows)):
        for j in range(i):
            both, common = len(sets[i] | sets[j]), len(sets[i] & sets[j])
            if common and common / both > 0.6:
                near.append(common / both)
            if both == 0 or common / both >= 0.8:
                label = [label[j] if x == label[i] else x for x in label]
    assert sum(0.8 <= x < 0.85 for x in near) >= 10 and sum(0.75 < x < 0.8 for x in near) >= 10
    kept = {r.doc_id for r in simhash.keep_one(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert kept == {min(d for d, x in enumerate(label) if x == g) for g in set(label)}


def test_substring_dedup_of_one_id_with_a_short_and_a_long_text(spark):
    passage = " ".join(f"p{i}" for i in range(60))
    long, short = " ".join(f"l{i}" for i in range(200)) + " " + passage, passage
    rows = [(1, passage), (2, long), (2, short), (3, "x " + passage)]
    got = sorted((r.doc_id, r.n_words, r.n_removed) for r in substring_dedup.remove(spark.createDataFrame(rows, SCHEMA).coalesce(1)).collect())
    assert got == [(1, 60, 0), (2, 60, 60), (2, 260, 60 + 60), (3, 61, 60)]


def thue_morse(n):
    return [bin(i).count("1") & 1 for i in range(n)]


def test_equal_hashes_are_not_equal_words(spark):
    """The Thue-Morse word and its complement have the same polynomial hash modulo 2^64 for every odd base."""
    one = "".join("ab"[x] for x in thue_morse(2048))
    two = "".join("ba"[x] for x in thue_morse(2048))
    head = " ".join(f"w{i}" for i in range(19))
    got = substring_dedup.remove(spark.createDataFrame([(1, f"{head} {one}"), (2, f"{head} {two}")], SCHEMA), with_text=False)
    assert sorted((r.doc_id, r.n_words, r.n_removed) for r in got.collect()) == [(1, 20, 0), (2, 20, 0)]


def test_equal_hashes_are_not_equal_bytes(spark):
    one, two = ("".join(x[b] for b in thue_morse(2048)) for x in ("ab", "ba"))
    rows = [(1, "left " + one), (2, "left " + two)]
    for hot in (2000, 0):
        got = suffix_dedup.remove_repeated(spark.createDataFrame(rows, SCHEMA), width=1990, hot=hot)
        same_by_id(got, brute_bytes(rows, 1990), "n_bytes", "n_removed", "n_spans", "kept_sha256")


def test_pieces_hold_every_window_once():
    texts = [b"", b"abc", bytes(range(250)) * 3]
    found = [(i, at + k, t[k : k + 9]) for i, at, t in suffix_dedup.pieces(texts, 9, limit=100) for k in range(len(t) - 8)]
    assert found == [(i, k, t[k : k + 9]) for i, t in enumerate(texts) for k in range(len(t) - 8)]


def test_keep_one_keeps_one_row_of_repeated_and_null_ids(spark):
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(1, text), (1, text), (None, text), (None, "other words " * 9), (None, "other words " * 9), (2, ""), (3, None)]
    got = simhash.keep_one(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r.doc_id or -1, r.text) for r in got) == [(-1, "other words " * 9), (1, text), (2, "")]


def test_texts_without_words_in_a_fresh_worker(monkeypatch):
    monkeypatch.setattr(hashing, "_powers", {})
    for texts in ([b""], [b" \n"], [b"", b""]):
        monkeypatch.setattr(hashing, "_powers", {})
        w = substring_dedup.Words(texts)
        assert len(w.hash) == len(w.of(8)) == 0
    monkeypatch.setattr(hashing, "_powers", {})
    assert len(hashing.prefix(np.zeros(0, np.uint64))) == 1 and len(hashing.windows(np.zeros(1, np.uint64), 3)) == 0


@pytest.mark.parametrize("block", [1, 40, 300])
def test_words_by_blocks(monkeypatch, block):
    monkeypatch.setattr(substring_dedup, "BLOCK", block)
    rng = random.Random(block)
    for text in (b"", b" \n", b"one", b"x" * 500, b"  ".join([b"same"] * 60), b" ".join(bytes(rng.choices(b"abc", k=rng.randint(1, 400))) for _ in range(50)) + b" "):
        words = text.split()
        assert [w for held in substring_dedup.word_blocks(text) for w in held] == words
        for width in (1, 3, 20):
            windows = [(base + i, own[i : i + width]) for base, own in substring_dedup.carried(text, width) for i in range(len(own) - width + 1)]
            assert windows == [(i, words[i : i + width]) for i in range(len(words) - width + 1)]
    places = np.array(sorted(rng.sample(range(1000), 40)), np.int32)
    for before, after in ((12, 0), (0, 19), (3, 3)):
        for start, end in ((0, 1000), (100, 130), (990, 1100), (5, 5)):
            assert substring_dedup.near(places, before, after, start, end).tolist() == [any(p - before <= i <= p + after for p in places.tolist()) for i in range(start, end)]


def test_long_texts_and_words(spark):
    """Texts and a word of over a block (1 MB), with passages that repeat in short texts too, across the cuts."""
    rng = random.Random(8)
    fill = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    shared, giant = [f"s{i}" for i in range(30)], "x" * (1 << 20) + "y"
    long_text = sum((fill(9_000) + shared[rng.randrange(8) :] for _ in range(40)), [])
    texts = [" ".join(fill(30) + shared), " ".join(long_text), " ".join([*fill(25), giant, *shared]), "\n".join([*fill(10), giant, *shared]), None, " ", " ".join(long_text[-500:])]
    rows = list(enumerate(texts))
    df = substring_dedup.remove(spark.createDataFrame(rows, SCHEMA)).cache()
    same_by_id(df, brute_words(rows), "n_words", "n_removed", "kept_sha256")
    got = df.collect()
    assert all(hashlib.sha256(" ".join((r.text or "").split()).encode()).hexdigest() == r.kept_sha256 for r in got)


def test_texts_near_a_large_group_are_not_verified_against_all_of_it(spark, monkeypatch):
    """Copies with few edits form a group; texts with more edits are near all of them and similar to few or none."""
    rng = random.Random(12)
    base, fresh = [f"w{rng.randrange(10**6)}" for _ in range(150)], iter(range(10**6))

    def edited(places):
        return " ".join(f"new{next(fresh)}" if i in places else w for i, w in enumerate(base))

    rows = [(i, edited(rng.sample(range(150), 2))) for i in range(160)]
    rows += [(200 + i, edited({7, 38, 69, 100, rng.randrange(130, 145)})) for i in range(80)]
    rows += [(500, rows[200][1].replace("new", "other", 1)), (501, rows[0][1] + " end"), (502, ""), (503, None)]
    asked, verified = [], simhash.verified
    monkeypatch.setattr(simhash, "verified", lambda edges, *rest: asked.append(edges.count()) or verified(edges, *rest))
    got = {r.node: r.label for r in simhash.near_groups(spark.createDataFrame(rows, SCHEMA)).collect()}
    sets = {}
    for _, t in rows:
        sets[xxhash.xxh64_intdigest(t.encode(), 42) if t is not None else 42] = set(simhash.shingles((t or "").encode(), 5))
    nodes, root = list(sets), {x: x for x in sets}

    def find(x):
        return x if root[x] == x else find(root[x])

    for i, a in enumerate(nodes):
        for b in nodes[:i]:
            if sets[a] == sets[b] or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    groups = defaultdict(set)
    for x in nodes:
        groups[find(x)].add(x - (1 << 64) if x >> 63 else x)
    true = {frozenset(x) for x in groups.values() if len(x) > 1}
    found = defaultdict(set)
    for node, label in got.items():
        found[label].add(node)
    assert {frozenset(x) for x in found.values()} == true and max(map(len, true)) >= 160
    assert sum(asked) <= 10 * len(rows), asked
