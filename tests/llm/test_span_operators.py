"""Fill-in-the-middle and decontamination against plain re-statements of their rules."""

import hashlib
import random
import re

import pytest

pytest.importorskip("quillsearch.llm")
from quillsearch.llm import decontaminate, fim  # noqa: E402

SMALL = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, cut string, hits int, __hits int, output string"
LONG = "lorem ipsum\n" * 60000
FIM_TEXTS = [(1, "a b"), (2, None), (3, ""), (4, LONG), (4, LONG), (None, "null id text"), (5, "x <S> y"), (6, "<P"), (7, "é\U0001f600 ß\n\n tail <"), (8, "<M>")] + [(100 + i, "<" * (i % 4) + "wörd \t" * i + "<S") for i in range(60)]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "c", 1, 2, "o") for i, t in rows], SCHEMA)


def fim_by_hand(doc_id, text, pattern="(?s)."):
    text = text or ""
    h = sha(f"1:{'null' if doc_id is None else doc_id}")
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    units = re.findall(pattern, text)
    n = len(units)
    assert "".join(units) == text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if not text or re.search("<[PSM]>", text) or h3 % 100 >= 90:
        return doc_id, n, "plain", None, None, sha(text), sha(text)
    form = "spm" if h4 % 100 < 20 else "psm"
    out = f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"
    return doc_id, n, form, len(p), len(m), sha(out), sha(text)


def fim_rows(examples):
    return sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output_sha256, r.restored_sha256) for r in fim.digests(examples).collect()), key=str)


def test_fim_on_odd_rows_and_real_ones(spark):
    odd = frame(spark, FIM_TEXTS)
    assert fim_rows(fim.fill_in_middle(odd)) == sorted((fim_by_hand(*r) for r in FIM_TEXTS), key=str)
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    assert fim_rows(fim.fill_in_middle(docs)) == sorted((fim_by_hand(r.doc_id, r.text) for r in docs.collect()), key=str)
    assert fim.fill_in_middle(odd.limit(0)).count() == 0


@pytest.mark.parametrize("width", [1, 3, None])
def test_fim_units_of_other_widths(spark, width):
    some = [r for r in FIM_TEXTS if r[0] != 4]
    most = f"{{1,{width}}}" if width else "+"
    want = [fim_by_hand(i, t, rf"[\x20\x09-\x0d]{most}|[^\x20\x09-\x0d]{most}") for i, t in some]
    assert fim_rows(fim.fill_in_middle(frame(spark, some), units=fim.Units(width))) == sorted(want, key=str)


def test_fim_counts_words_that_begin_in_the_middle():
    text = "ab  cd e\nfgh"
    for one in range(13):
        for two in range(13):
            _, a, b, n, _ = fim.Scan.of(fim.Units(1)).cuts(text, one, two)
            assert n == sum(a <= m.start() < b for m in re.finditer(r"\S+", text))


def test_fim_shuffles_nothing(spark):
    plan = fim.digests(fim.fill_in_middle(spark.read.parquet(f"{SMALL}/documents.parquet")))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("ArrowEvalPython") == 1


WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def contamination_by_hand(docs, items, window=10):
    held = {}
    for i, t in items:
        ws = WORD.findall(lowered(t))
        for k in range(max(len(ws) - window, 0) + 1 if ws else 0):
            held.setdefault(tuple(ws[k : k + window]), set()).add(str(i) if i is not None else "null")
    sizes = {len(w) for w in held}
    out = []
    for d, t in docs:
        ws = WORD.findall(lowered(t))
        hit, found = set(), set()
        for size in sizes:
            for k in range(len(ws) - size + 1):
                if (of := held.get(tuple(ws[k : k + size]))) is not None:
                    found |= of
                    hit |= set(range(k, k + size))
        out.append((d, len(ws), len(hit), len(found), sha(",".join(sorted(found))), bool(hit)))
    return sorted(out, key=str)


def found_rows(found):
    return sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in decontaminate.digests(found).collect()), key=str)


def random_case(rng, letters, window):
    make = lambda n: " ".join(rng.choice(letters) for _ in range(n))
    items = [(i, make(rng.choice([1, 2, 3, 5, 8, 12, 20]))) for i in range(12)] + [(None, make(9)), (50, None), (51, " .,! "), (3, make(30))]
    items += [(60, items[0][1]), (61, items[5][1].upper())]
    docs = [(i, make(rng.randint(0, 60))) for i in range(30)]
    docs += [(100 + i, make(5) + "... " + str(t) + "-" + make(5)) for i, (_, t) in enumerate(items)]
    return docs, items


@pytest.mark.parametrize("block_words", [200_000, 25])
def test_decontamination_against_all_windows(spark, block_words):
    rng = random.Random(5)
    for letters, window in ((["a", "b"], 4), (["a", "b", "c", "é9", "Dd"], 3), ([f"w{i}" for i in range(40)], 10)):
        docs, items = random_case(rng, letters, window)
        docs += [(None, None), (1, ""), (7, "ñ" * 50000 + " a b a b " * 9000), (7, "x")]
        benchmark = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, block int")
        got = decontaminate.contamination(frame(spark, docs), benchmark, window, block_words=block_words, piece_words=max(window + 2, 14))
        assert found_rows(got) == contamination_by_hand(docs, items, window)


def test_decontamination_of_real_rows_and_of_none(spark):
    docs, items = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "benchmark"))
    plain = lambda df: [(r[0], r.text) for r in df.collect()]
    want = contamination_by_hand(plain(docs), plain(items))
    assert any(r[-1] for r in want)
    assert found_rows(decontaminate.contamination(docs, items)) == want
    assert decontaminate.contamination(docs.limit(0), items).count() == 0
    assert not any(r[-1] for r in found_rows(decontaminate.contamination(docs, items.limit(0))))


def test_longest_match_and_removed_spans(spark):
    items = spark.createDataFrame([(1, "one two three four five six"), (2, "solo")], "item_id long, text string")
    docs = frame(spark, [(1, "Say: One, two three -- four! end"), (2, "one two three four five six seven"), (3, "clean\r\ntext  here"), (4, None), (5, "it is solo here, very solo")])
    got = {r.doc_id: r for r in decontaminate.contamination(docs, items, 3).collect()}
    assert [got[i].longest for i in (1, 2, 3, 4, 5)] == [4, 6, 0, 0, 1]
    assert (got[1].starts, got[1].ends, got[1].items) == ([1], [5], ["1"])
    left = decontaminate.decontaminated(docs, items, 3, max_span=3, max_coverage=0.7)
    assert left.columns == docs.columns
    assert {r.doc_id: r.text for r in left.collect()} == {1: "Say: ! end", 3: "clean\r\ntext  here", 4: None, 5: "it is solo here, very solo"}


def test_automaton_walks_are_all_substrings_and_no_others():
    rng = random.Random(1)
    for _ in range(200):
        items = [[rng.randrange(3) for _ in range(rng.randint(1, 9))] for _ in range(rng.randint(1, 5))]
        made = decontaminate.SuffixAutomaton()
        for item in items:
            made.add(item)
        held = {tuple(i[a:b]) for i in items for a in range(len(i)) for b in range(a + 1, len(i) + 1)}
        for _ in range(60):
            word = [rng.randrange(3) for _ in range(rng.randint(1, 7))]
            state = 0
            for w in word:
                state = made.next[state].get(w) if state is not None else None
            assert (state is not None) == (tuple(word) in held)
