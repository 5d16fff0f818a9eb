"""The corpus pipeline, stage by stage and as a whole, against plain loops; and its edge cases."""

import random
import zlib

import numpy as np
import pytest

import corpus_pipeline

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = {
    "en": "the cat dog house river walks over under quickly green small bright every morning people".split(),
    "fr": "le chat chien maison rivière marche sous vite vert petit chaque matin gens être où".split(),
}


def corpus():
    """(rows, benchmark): two languages, copies, near copies, shared passages, passages of the benchmark, odd rows."""
    rng = random.Random(9)
    fresh = iter(range(10**6))
    sentence = lambda lang, n: " ".join(rng.choice(WORDS[lang]) + ("" if rng.random() < 0.6 else str(next(fresh))) for _ in range(n))
    texts = [(sentence(lang, rng.choice([40, 90, 150])), lang) for lang in ("en", "fr") for _ in range(40)]
    passage, item = sentence("en", 60), sentence("en", 14)
    for i in (3, 9, 17):
        texts[i] = (texts[i][0] + " " + passage, "en")
    texts[5] = (texts[5][0] + " " + item.upper() + " " + sentence("en", 9), "en")
    for i in (0, 1, 50):
        texts.append(texts[i])
    for i in (2, 55):
        w = texts[i][0].split()
        w[7] = "changed"
        texts.append((" ".join(w), texts[i][1]))
    rows = [(i, t, lang, "s", len(t)) for i, (t, lang) in enumerate(texts)]
    rows += [(900, None, "en", None, 0), (901, "", None, "s", 0), (902, "12 34 ...", "fr", "s", 9), (0, texts[0][0], "en", "s", len(texts[0][0]))]
    return rows, [(1, item), (2, None), (3, "never there at all in any of these texts here now")]


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def near_kept(rows):
    """One row of each group by all pairs."""
    sets, group = [shingles(r.text) for r in rows], list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] | sets[j])
            if both == 0 or len(sets[i] & sets[j]) / both >= 0.8:
                group = [group[j] if g == group[i] else g for g in group]
    best = {}
    for r, g in zip(rows, group):
        best[g] = min(best.get(g, r), r, key=lambda x: x.doc_id)
    return {r.doc_id: r.text for r in best.values()}


def cleaned(texts):
    """Texts without windows of 20 words that start earlier."""
    words, first, out = {d: (t or "").split() for d, t in texts.items()}, {}, {}
    for d in sorted(words):
        w, gone = words[d], set()
        for i in range(len(w) - 19):
            if first.setdefault(tuple(w[i : i + 20]), (d, i)) != (d, i):
                gone |= set(range(i, i + 20))
        out[d] = " ".join(x for i, x in enumerate(w) if i not in gone) if gone else texts[d]
    return out


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("corpus"))
    rows, benchmark = corpus()
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(benchmark, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


def test_stages_match_plain_loops(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language", "near_dedup", "substrings", "decontaminated", "packed"]
    held = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.scratch(stage(spark, docs, tables))
        assert docs.columns == corpus_pipeline.COLUMNS
        held[name] = docs.collect()
    rows, _ = corpus()
    lettered = {r[0] for r in rows if any(c.isalpha() for c in r[1] or "")}
    named = {r.doc_id for r in held["language"]}
    assert named <= lettered and len(lettered - named) <= 2
    kept = near_kept(held["language"])
    assert sorted((r.doc_id, r.text) for r in held["near_dedup"]) == sorted(kept.items())
    clean = cleaned(kept)
    assert sum(clean[d] != kept[d] for d in kept) >= 2
    assert {r.doc_id: r.text for r in held["substrings"]} == clean and all(r.n_chars == len(r.text) for r in held["substrings"])
    item = " ".join(corpus()[1][0][1].lower().split()[:10])
    assert {r.doc_id for r in held["decontaminated"]} == {d for d, t in clean.items() if item not in t.lower()} == set(clean) - {5}
    stages = corpus_pipeline.STAGES
    got = stages[-1][1](spark, docs, tables).toPandas()
    assert set(got.doc_id) == {r.doc_id for r in held["decontaminated"]}
    for _, p in got.groupby("doc_id"):
        p = p.sort_values("start")
        assert (p.start.to_numpy() == np.append(0, p.length.cumsum()[:-1])).all() and p.length.sum() == p.doc_tokens.iat[0]


def test_the_whole_run_is_the_stages(spark, tables):
    got = corpus_pipeline.run(spark, tables).toPandas()
    again = corpus_pipeline.run(spark, tables).toPandas()
    digest = lambda df: zlib.crc32(df.groupby("doc_id").length.sum().to_csv().encode())
    assert len(got) and digest(got) == digest(again)


def test_empty_and_odd_tables(spark, tmp_path):
    """An empty table, null ids and texts, repeated rows, ties, a long text, and columns of the operators' own names."""
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    names = ", _node string, _doc int, bucket int, score double, lang_pred string, n_words int"
    long = " ".join(f"word{i}" for i in range(60_000))
    odd = [(None, "some words of no document", "en"), (None, "some words of no document", "en"), (7, long, "en"), (7, long, "en"), (8, None, "en"), (8, "", None), (9, "x", "fr"), (10, "x", "fr")]
    for rows in ([], odd):
        docs = spark.createDataFrame([(*r, "s", 1, "k", 1, 2, 0.5, "zz", 3) for r in rows], SCHEMA + names)
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, str(tmp_path))
            n = out.count()
            assert (n == 0) == (not rows), name
            if name == "near_dedup" and rows:
                assert sorted((r.doc_id is None, r.doc_id or 0) for r in out.collect()) == [(False, 7), (False, 8), (False, 9), (True, 0)]
            if name == "substrings" and rows:
                assert sorted(len((r.text or "").split()) for r in out.collect()) == [0, 0, 1, 1, 5, 5, 60_000, 60_000]
            if name == "packed" and rows:
                assert {r.doc_tokens for r in out.filter("doc_id = 8").collect()} == {1}
