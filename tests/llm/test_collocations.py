"""Collocations against a plain count of all phrases."""

import random
import re
from collections import Counter

import pytest

pytest.importorskip("quillsearch.llm")
from quillsearch.llm import collocations as C  # noqa: E402

SMALL = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, phrase string, n int, load int, slice int"


def by_hand(rows, least, top):
    out = []
    f, n = {}, Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", text):
            ws = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(ws)
            for size in range(1, 5):
                for i in range(len(ws) - size + 1):
                    f.setdefault(lang, Counter())[tuple(ws[i : i + size])] += 1
    for lang, of in f.items():
        candidates = {p: a for p, a in of.items() if len(p) > 1 and a >= least}
        dropped = set()
        for p, a in candidates.items():
            for size in range(2, len(p)):
                for i in range(len(p) - size + 1):
                    if 100 * a >= 80 * candidates[p[i : i + size]]:
                        dropped.add(p[i : i + size])
        found = []
        for p, a in candidates.items():
            if p not in dropped:
                score, k = min((2000000 * a // (of[p[:k]] + of[p[k:]]), k) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), of[p[:k]], of[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def rows_of(df):
    return sorted((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in df.collect())


def made(seed, n):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(12)] + ["É", "'q'", "\U0001f600", "x\x00y", "$^*", " "]
    text = lambda: "".join(rng.choice(vocabulary) + rng.choice([" ", " ", "  ", "\t", ". ", ", ", "\r\n", "\x0b"]) for _ in range(rng.randint(0, 60)))
    rows = [(text(), rng.choice(["en", "en", "de", None, ""])) for _ in range(n)]
    return rows + [("New York City " * 40, "en"), ("new york. city", "en"), ("AB cd " * 30000, "xx"), (None, "en"), ("", None), (" .;,", "nn")] + [("same words here again", "en")] * 25


def frame(spark, rows):
    return spark.createDataFrame([(i % 3 or None, t, x, "p", 1, 2, 3) for i, (t, x) in enumerate(rows)], SCHEMA).repartition(3)


@pytest.mark.parametrize("options", [{}, {"max_bits": 9, "cell_bytes": 64}, {"load_phrases": 7}, {"max_bits": 8, "cell_bytes": 4096, "load_phrases": 50}])
def test_against_all_phrases(spark, options):
    rows = made(3, 300)
    want = by_hand(rows, 7, 20)
    assert any(r[1] == 20 for r in want)
    assert rows_of(C.collocations(frame(spark, rows), 7, 20, **options)) == want


def test_small_caches_and_chunks(spark, monkeypatch):
    rows = made(4, 120)
    b = C.Cutter()
    monkeypatch.setattr(C, "CACHE_WORDS", 3)
    for t, _ in rows[:20]:
        batch = b([t or "", t or ""], ["a", "b"])
        again = C.Cutter()([t or "", t or ""], ["a", "b"])
        assert all((x == y).all() for x, y in zip(batch.hash, again.hash))


def test_real_rows_and_none(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    want = by_hand([(r.text, r.lang) for r in docs.collect()], 5, 2000)
    assert want
    assert rows_of(C.collocations(docs, 5)) == want
    assert C.collocations(docs.limit(0)).count() == 0


def test_counts_that_pass_64_bits(spark, monkeypatch):
    big = 1 << 61
    counts = spark.createDataFrame([("en", "a b", big), ("en", "a b c", big // 10 * 8), ("en", "b c", big - 1)], "lang string, phrase string, a long")
    words = spark.createDataFrame([("en", "a", big + 5), ("en", "b", big + 7), ("en", "c", big + 9)], "lang string, word string, n long")
    sizes = spark.createDataFrame([("en", big)], "lang string, n long")
    monkeypatch.setattr(C, "phrase_counts", lambda *_, **__: (counts, words, sizes))
    got = {r.phrase: r.score for r in C.collocations(None).collect()}
    score = lambda a, left, right: 2000000 * a // (left + right)
    assert got == {"a b": score(big, big + 5, big + 7), "b c": score(big - 1, big + 7, big + 9), "a b c": min(score(big // 10 * 8, big + 5, big - 1), score(big // 10 * 8, big, big + 9))} or 100 * (big // 10 * 8) >= 80 * (big - 1)


def test_the_texts_are_read_as_often_however_many_candidates(spark):
    """Candidates that a task holds few of at a time take no more jobs than those that it holds at once."""
    context, jobs = spark.sparkContext, {}
    for held in (7, 1 << 20):
        context.setJobGroup(f"held-{held}", "")
        assert C.phrase_counts(frame(spark, made(3, 300)), 7, load_phrases=held)[0].count() > 100
        jobs[held] = len(context.statusTracker().getJobIdsForGroup(f"held-{held}"))
    context.setLocalProperty("spark.jobGroup.id", None)
    assert jobs[7] <= jobs[1 << 20] + 3


def test_sums_by_hash():
    rng = C.np.random.default_rng(1)
    sums, want = C.Sums(), Counter()
    for _ in range(50):
        h, n = C.np.unique(rng.integers(0, 1 << 63, 3000, C.np.uint64) % C.np.uint64(60_000) << C.np.uint64(48), return_counts=True)
        want.update(dict(zip(h.tolist(), n.tolist())))
        sums.add(h, n)
    rows = sums.handed_on(3)
    assert len(sums.hashes) == 0 and len(rows) == 8
    got = {}
    for part, cells, counts in zip(rows.slice, rows.cells, rows.counts):
        of = C.np.frombuffer(cells, C.np.uint64)
        assert set((of >> C.np.uint64(61)).tolist()) == {part}
        got.update(zip(of.tolist(), C.np.frombuffer(counts, C.np.int64).tolist()))
    assert got == want
