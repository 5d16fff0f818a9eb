"""Operators 11 to 13 against the tokenizers library, DuckDB and plain enumeration."""

import hashlib
import itertools
import random
import re
import zlib

import duckdb
import public_tokenizers
import pytest

from rasterspark.llm import bpe, filter_audit, queries, repair

WORDS = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    held = Tokenizer.from_file(WORDS)
    held.no_truncation(), held.no_padding()
    return held


def test_words_encode_as_the_library(library):
    own, rng = bpe.vocabulary(WORDS), random.Random(3)
    letters = "ab cdeE'sStTΣσİé́ 12٣½\n\t\x0b\x1c\x85\xa0日本語😀!#ͅᾳȺ"
    for _ in range(3000):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 25))) + rng.choice(["", "<|endoftext|>", "<|startoftext|>x", "it's THE'RE", "<|endoftext"])
        assert [i for block in own.split(text) for u in block for i in own.encode(u)] == library.encode(text, add_special_tokens=False).ids, text
    every = [f"a{chr(c)}b1{chr(c)}{chr(c)}'s" for c in range(0, 0x110000, 7) if not 0xD800 <= c < 0xE000]
    for text, held in zip(every, library.encode_batch(every, add_special_tokens=False)):
        assert [i for block in own.split(text) for u in block for i in own.encode(u)] == held.ids


def test_blocks_of_a_text(library, monkeypatch):
    own = bpe.Vocabulary(WORDS)
    for block in (1, 7, 50):
        monkeypatch.setattr(bpe, "BLOCK", block)
        for text in ("Hello it's  <|endoftext|> we'll\n\nsee! " * 9, "日本 㐀\u3000b " * 30, "é" * 300, " " * 99):
            assert [i for held in own.split(text) for u in held for i in own.encode(u)] == library.encode(text, add_special_tokens=False).ids


def test_round_trip_of_a_table(spark, library):
    texts = [None, "", " \n", "Hello hello it's <|endoftext|>!", "é" * 300, "word " * 300_000, "x y" * 500, "日本 㐀 " * 200, "Hello hello it's <|endoftext|>!"]
    rows = [(i if i != 2 else None, t, "x", 1) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string, chunk int")
    full = {r.doc_id: r for r in bpe.round_trip(docs, WORDS).collect()}
    short = {r.doc_id: r for r in bpe.round_trip(docs, WORDS, digests=True).collect()}
    encoded = bpe.encode(docs, WORDS)
    plain = {r.doc_id: r for r in encoded.collect()}
    back = {r.doc_id: r.decoded for r in bpe.decode(encoded, WORDS).collect()}
    assert len(full) == len(texts)
    for i, text, *_ in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        assert list(full[i].ids) == list(plain[i].ids) == ids and full[i].n_tokens == plain[i].n_tokens == short[i].n_tokens == len(ids)
        assert full[i].decoded == back[i] == decoded
        assert short[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest() and short[i].decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()
    assert bpe.round_trip(docs.limit(0), WORDS).count() == 0 and bpe.encode(docs.limit(0), WORDS).count() == 0


def test_decode_leaves_out_what_is_no_piece(spark, library):
    rows = [(1, [320, 99_999, -5, 49_407, 320]), (2, None), (3, []), (1, [518])]
    got = sorted((r.doc_id, r.decoded) for r in bpe.decode(spark.createDataFrame(rows, "doc_id long, ids array<int>"), WORDS).collect())
    assert got == sorted([(1, library.decode([320, 49_407, 320], skip_special_tokens=False)), (2, ""), (3, ""), (1, library.decode([518]))])
    assert bpe.decode(spark.createDataFrame([], "doc_id long, ids array<int>"), WORDS).count() == 0


def test_op11_on_documents(spark, small, library):
    texts = dict(duckdb.sql(f"select doc_id, text from '{small}/documents.parquet'").fetchall())
    for r in queries.op11_bpe(spark, small).collect():
        ids = library.encode(texts.pop(r.doc_id) or "", add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert not texts


def audit_plain(docs, labels):
    """Every order applied to lists of rows."""
    good, toxic = ({d for d, q, t in labels if d is not None and (q, t)[k] == 1} for k in (0, 1))
    first = {}
    for d, text, _ in docs:
        if d is not None:
            first[text or ""] = min(first.get(text or "", d), d)
    split = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t)
    fails = {
        "A": lambda d, t: len(split(t)) < 200, "B": lambda d, t: 100 * len(set(split(t))) < 50 * len(split(t)), "C": lambda d, t: 100 * sum("A" <= c <= "Z" for c in t) > 3 * len(t),
        "D": lambda d, t: any(c in "#$%&*|" for c in t), "E": lambda d, t: d is not None and t in first and first[t] < d,
    }
    out, shapley = [], {}
    for part in {lang or "" for _, _, lang in docs}:
        own = [(d, {f for f in fails if fails[f](d, t or "")}) for d, t, lang in docs if (lang or "") == part]
        for order in itertools.permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                gone = [d for d, bad in left if f in bad]
                seen = len([1 for _, bad in own if f in bad])
                left = [(d, bad) for d, bad in left if f not in bad]
                shapley[part, f] = shapley.get((part, f), 0) + len(gone)
                out.append((part, "".join(order), step, len(left), len(gone), seen - len(gone), len([1 for _, bad in own if bad == {f}]), sum(d in good for d in gone), sum(d in toxic for d in gone)))
    return sorted((*r, shapley[r[0], r[1][r[2] - 1]]) for r in out)


def audit_rows(df):
    assert tuple(df.columns) == filter_audit.COLUMNS
    return sorted(tuple(r) for r in df.collect())


DOCS = [
    (5, "same text", "en"), (3, "same text", "de"), (9, "same text", None), (3, "same text", ""), (None, "same text", "en"), (1, None, "en"), (2, "", "en"), (0, "", None), (None, None, None),
    (10, " ".join(f"w{i}" for i in range(200)), "en"), (11, "w " * 200, "en"), (12, "AAA" + " b" * 300, "fr"), (13, "x\x0by\x1cz|", "fr"), (14, "A" * 3 + "é" * 97, "fr"), (15, "A" * 4 + "é" * 96, "fr"), (-4, "w " * 200, "de"),
]
LABELS = [(5, 1, 0), (5, 0, 1), (9, None, 1), (None, 1, 1), (11, 1, 1), (12, 1, None), (99, 1, 1)]


@pytest.mark.parametrize("held_bytes", [1, 20, 1 << 26])
def test_filter_audit(spark, held_bytes, monkeypatch):
    monkeypatch.setattr(filter_audit.masks, "__defaults__", (held_bytes,))
    docs = spark.createDataFrame([(*d, "x") for d in DOCS], "doc_id long, text string, lang string, part string").repartition(5)
    labels = spark.createDataFrame([(*x, 3) for x in LABELS], "doc_id long, quality int, toxic int, text int")
    assert audit_rows(filter_audit.audit(docs, labels)) == audit_plain(DOCS, LABELS)


def test_filter_audit_of_nothing_and_of_colliding_hashes(spark):
    docs = spark.createDataFrame([(1, "a", "en")], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(docs.limit(0), labels).count() == 0
    assert audit_rows(filter_audit.audit(docs, labels)) == audit_plain([(1, "a", "en")], [])
    held = filter_audit.Chains()
    assert held.add(7, "a", 2, ["a2"]) == [] and held.add(7, "b", 1, ["b1"]) == [] and held.add(7, "a", 1, ["a1"]) == ["a2"] and held.add(7, "a", 3, ["a3"]) == ["a3"] and held.add(7, "a", 1, ["again"]) == []
    assert sorted(held.entries()) == [(7, "a", 1, ["a1", "again"]), (7, "b", 1, ["b1"])]


def cheapest(rows):
    """All edits of a short conversation, tried out: the least (cost, audit), and the turns it gives."""
    best = None

    def go(i, done, audit, cost):
        nonlocal best
        if best and cost > best[0]:
            return
        if i == len(rows):
            if re.fullmatch("(s?(ua)+)?", "".join(r[:1] or "?" for r, _ in done)) and (best is None or (cost, audit) < best[:2]):
                best = (cost, audit, done)
        else:
            role, text, gone, cut = rows[i]
            go(i + 1, done, audit + "D", cost + 2)
            if not gone:
                go(i + 1, [*done, (role, text)], audit + "K", cost + 5 * cut)
                for new in ("user", "assistant"):
                    go(i + 1, [*done, (new, text)], audit + "R", cost + 1 + 5 * cut)
        if audit.count("I") < 2 and cost + 5 <= (best or [2 * len(rows)])[0]:
            for new in ("user", "assistant"):
                go(i, [*done, (new, "")], audit + "I", cost + 5)

    go(0, [], "", 0)
    return best


def faults(rows):
    """(role, text) in order -> those with their faults, and how many of each."""
    seen, out, n = set(), [], [0, 0, 0]
    for role, text in rows:
        words = text.strip(" \t\n\x0b\x0c\r")
        kind = 0 if not words else 1 if (role, text) in seen else 2 if words[-1] not in ".!?" else 3
        seen.add((role, text))
        if kind < 3:
            n[kind] += 1
        out.append((role, text, kind < 2, kind == 2))
    return out, n


def expected(turns, damage):
    """The contract, conversation by conversation."""
    held = {}
    for conv, turn, role, text in turns:
        own = held.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        fault = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20 if damage else 9
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        role = "user" if fault == 4 else role
        own += [(turn, role, text)] * (0 if fault == 0 else 2 if fault == 3 else 1)
    out = {}
    for conv, own in held.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).hexdigest()))
        rows, counts = faults([r[1:] for r in own])
        cost, audit, done = cheapest(rows)
        turn = [r[0] for r in own if r[0] is not None]
        gaps = max(turn) - min(turn) + 1 - len(set(turn)) if turn else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        out[conv] = (gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in done).encode()).hexdigest(), done)
    return out


def random_turns(seed, convs=60, most=7):
    rng = random.Random(seed)
    for conv in range(convs):
        for turn in range(rng.randint(1, most)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", None, ""])
            text = rng.choice(["Yes.", "No!", "Maybe", "", None, " \n", "Really? \t", "a\nb. ", f"x{rng.random()}."])
            yield (conv if conv else None, rng.choice([turn, turn, turn, turn + 1, None]), role, text)


SCHEMA = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("damage", [False, True])
def test_repair(spark, damage):
    turns = list(dict.fromkeys(random_turns(5)))
    df = spark.createDataFrame([(*t, 1, "x") for t in turns], SCHEMA + ", cost int, audit string").repartition(3)
    want = expected(turns, damage)
    got = {r.conv_id: tuple(r)[1:] for r in repair.audit(df, damage=damage).collect()}
    assert got == {conv: w[:-1] for conv, w in want.items()}
    texts = {}
    for r in sorted(repair.repair(df, damage=damage).collect(), key=lambda r: r.place):
        texts.setdefault(r.conv_id, []).append((r.role, r.text))
    assert texts == {conv: w[-1] for conv, w in want.items() if w[-1]}


def test_repair_of_one_long_conversation(spark, monkeypatch):
    """A conversation over all tasks, in small blocks, has the audit that one search over all its rows finds."""
    rng = random.Random(9)
    turns = [(1, i, rng.choice(["user", "assistant", "assistant", "system"]), rng.choice(["Yes.", "cut", "", f"{i}."])) for i in range(900)]
    turns += [(c, i, r, f"{c}.") for c in (0, 2) for i, r in enumerate(("user", "assistant"))]
    got = {r.conv_id: r for r in repair.audit(spark.createDataFrame(turns, SCHEMA).repartition(5)).collect()}
    rows, counts = faults([t[2:] for t in turns[:900]])
    (cost, audit), = repair.search([(r[:1], gone, cut) for r, _, gone, cut in rows], repair.START, close=True).values()
    assert (got[1].blank, got[1].duplicate, got[1].truncated, got[1].cost, got[1].audit, got[1].gaps) == (*counts, cost, audit, 0)
    assert got[1].illegal == sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(turns[:900], turns[1:900]))
    assert [tuple(got[c])[1:8] for c in (0, 2)] == [(0, 0, 0, 0, 0, 0, "KK")] * 2


@pytest.mark.parametrize("size", [1, 2, 3, 5])
def test_stretches_compose(size):
    rng = random.Random(size)
    for _ in range(200):
        rows = [(rng.choice("suat"), rng.random() < 0.2, rng.random() < 0.2) for _ in range(rng.randint(1, 12))]
        rows = [(r, gone, cut and not gone) for r, gone, cut in rows]
        whole, = repair.search(rows, repair.START, close=True).values()
        assert repair.closed(repair.composed([repair.table_of(rows[i : i + size]) for i in range(0, len(rows), size)])) == whole


def test_repair_of_nothing(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert repair.audit(empty).count() == 0 and repair.repair(empty).count() == 0
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    got = repair.audit(spark.createDataFrame([(gone, 0, "user", "Hello.")], SCHEMA), damage=True).first()
    assert tuple(got) == (gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
