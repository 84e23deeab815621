import random

from quillsearch.plans import index as I
from quillsearch.plans.bitmaps import FEW
from quillsearch.plans.index import build_index

COLUMNS = "card_number card_title card_description card_tags q1_value card_page_url card_label_type card_created_date card_music_extn status_id invalid_card card_thumb_extn card_bigimage_extn dev_id".split()


def catalogue(spark):
    chance = random.Random(9)
    words = ["common", "often", *[f"w{i}" for i in range(30)]]
    rows = []
    for i in range(3 * FEW):
        text = " ".join(chance.choice(words[:2] if chance.random() < 0.5 else words) for _ in range(12))
        rows.append((str(i), text.split(" ")[0], text, "", f"s{i % 3}_x", "", "S", "2010-01-01", "", "1", "0", "", "", "d"))
    return spark.createDataFrame(rows, ", ".join(f"{c} string" for c in COLUMNS)), [f" {r[1]} {r[2]} " for r in rows], words


def test_pairs_are_counted_in_pieces(spark):
    """Sets of both kinds, with themselves, with terms that nothing holds; the sets of a block are copied to pieces of pairs, not to pairs."""
    cards, texts, words = catalogue(spark)
    index = build_index(cards)
    index.piece_pairs = 100
    pairs = [(a, b) for a in [*words, "none"] for b in [*words, "none"]]
    asked = index.pair_sizes(spark.createDataFrame(pairs, "a string, b string"))
    assert "bitmap_and_agg" not in asked._jdf.queryExecution().toString()
    assert {(r.a, r.b): r.n for r in asked.collect()} == {(a, b): sum(f" {a} " in t and f" {b} " in t for t in texts) for a, b in pairs}


def test_phrases_are_met_by_runs_of_words(spark, monkeypatch):
    """Phrases sent to the texts, dealt by a shuffle, and longer than what they are met by; no table of places of all words is written."""
    cards, texts, words = catalogue(spark)
    chance = random.Random(3)
    phrases = ["common", "often common", "common often often", "none", "w1 w2", *[" ".join(chance.choice(texts).split()[k : k + n]) for n in (2, 5, 9) for k in (1, 3)]]
    want = {(p, i, f"s{i % 3}") for p in phrases for i, t in enumerate(texts) if f" {p} " in t}
    index = build_index(cards)
    assert not hasattr(index, "positions")
    for lead, most in ((8, 1000), (8, 0), (2, 1000)):
        monkeypatch.setattr(I, "LEAD", lead)
        monkeypatch.setattr(I, "PHRASES", most)
        got = [(r.phrase, r.doc, r.section) for r in index.phrase_matches(spark.createDataFrame([(p,) for p in [*phrases, "", "!"]], "phrase string")).collect()]
        assert len(got) == len(set(got)) and set(got) == want
