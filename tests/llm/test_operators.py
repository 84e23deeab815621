"""Each operator on odd rows, on no rows, and against a plain re-statement of its rule on a small table."""

import hashlib
import math
import random
import re
import tracemalloc
import zlib
from collections import Counter

import pytest

pytest.importorskip("quillsearch.llm")
from quillsearch.llm import bpe, ctw, exact_dedup, fixity, mixing, quality, resemblance, simhash, substrings, token_files, toxicity  # noqa: E402
from quillsearch.llm.queries import tokenizer_path  # noqa: E402

SMALL = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, block int, key string, label int, score double, name string, rid long"
LONG = " ".join(f"word{i % 997}x{i}" for i in range(30000))
TEXTS = [(1, "a b c"), (2, None), (3, ""), (4, LONG), (4, LONG), (None, "a  b\tc"), (7, "abc"), (8, "é\U0001f600 " * 60), (9, "x"), (None, None), (10, LONG + " tail"), (11, "stupid " * 3)]
WORD = re.compile("[^\x20\x09-\x0d]+")


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, "en", None, 0, 1, "k", 1, 0.5, "n", 3) for i, t in TEXTS], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, int(i % 3 == 0)) for i in range(12)] + [(None, 1, 1)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


@pytest.fixture(scope="module")
def rows(docs):
    return sorted((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect())


OPERATORS = {
    "ctw": lambda d, x: ctw.scores(d), "substrings": lambda d, x: substrings.without_repeats(d), "mixing": mixing.mixed,
    "bpe": lambda d, x: bpe.round_trips(d, tokenizer_path("byte_bpe_50k.json")), "quality": quality.quality,
    "token_files": lambda d, x: token_files.token_files(d, tokenizer_path("word_bpe_49k.json")), "simhash": lambda d, x: simhash.near_duplicates(d),
    "toxicity": toxicity.toxicity, "exact": lambda d, x: exact_dedup.exact_duplicates(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows_and_no_rows(odd, labels, name):
    got = OPERATORS[name](odd, labels).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(i) for i, _ in TEXTS)
    assert OPERATORS[name](odd.limit(0), labels.limit(0)).count() == 0


def test_exact_dedup_even_if_all_digests_clash(spark, odd):
    from pyspark.sql import functions as F

    weak = lambda c: F.struct(F.pmod(F.xxhash64(c), F.lit(3)).alias("a"), F.lit(0).alias("b"))
    show = lambda df: sorted(map(str, df.select("keep_id", "group_size", "kept", "text_sha256").collect()))
    plain = exact_dedup.exact_duplicates(odd, block_chars=16)
    assert show(exact_dedup.exact_duplicates(odd, block_chars=16, digest_of=weak)) == show(plain)
    by = {}
    for i, t in TEXTS:
        by.setdefault(re.sub("[\x20\x09-\x0d]", "", t or ""), []).append(i)
    assert sorted(r.group_size for r in plain.collect()) == sorted(len(v) for v in by.values() for _ in v)


def test_quality_counts(spark, docs, rows):
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    got = {r.doc_id: r for r in quality.quality(docs, labels).collect()}
    for i, t in rows:
        w, lines = WORD.findall(t), [x for x in t.split("\n") if WORD.search(x)]
        tri = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        covered = {k + j for k, x in enumerate(tri) if tri.count(x) > 1 for j in range(3)} if len(tri) < 3000 else None
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines) == (len(w), sum(map(len, w)), len(re.findall("[#*$%&|<>]", t)), len(lines) - len(set(lines)))
        if covered is not None:
            assert r.n_repeat_words == len(covered)
            assert r.base_failed == (len(w) < 50 or 100 * len(covered) > 50 * len(w))
    clean = {r.doc_id for r in labels.where("quality = 1").collect()}
    assert all(r.kept or r.base_failed for i, r in got.items() if i in clean)


def test_bpe_equals_the_library(docs, rows):
    from tokenizers import Tokenizer

    path = tokenizer_path("byte_bpe_50k.json")
    library, b = Tokenizer.from_file(path), bpe.loaded(path)
    odd = ["it's 'stop ''s 12 x\u0085y<|endoftext|>z", "ṟ0\U0001e5d0a", "  \n\n a", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa"]
    for t in odd + [t for _, t in rows]:
        ids, counts = b.encode([t])
        assert ids.tolist() == library.encode(t, add_special_tokens=False).ids
        assert b.decode(ids, counts)[0] == library.decode(ids.tolist(), skip_special_tokens=False)


def test_token_files_round_trip(docs, rows):
    import numpy as np
    from tokenizers import Tokenizer

    path = tokenizer_path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    got, start = {r.doc_id: r for r in token_files.token_files(docs, path).collect()}, 0
    for i, t in rows:
        ids = np.array([*library.encode(t, add_special_tokens=False).ids, 1], "<u4")
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


@pytest.mark.parametrize("window, prefix, sizes", [(20, 5, {"block_bytes": 60000, "group_bytes": 4000}), (50, 8, {"block_bytes": 100000, "group_bytes": 3000}), (50, 8, {})])
def test_substrings_against_brute_force(docs, rows, window, prefix, sizes):
    first, cut = {}, [(i, WORD.findall(t)) for i, t in rows]
    for i, w in cut:
        for k in range(len(w) - window + 1):
            first.setdefault(tuple(w[k : k + window]), i)
    got = {r.doc_id: r for r in substrings.without_repeats(docs, window=window, prefix=prefix, **sizes).collect()}
    for i, w in cut:
        gone = {k + j for k in range(len(w) - window + 1) if first[tuple(w[k : k + window])] < i for j in range(window)}
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        assert (got[i].n_words, got[i].n_removed, got[i].kept_sha256) == (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())


def test_suffix_tree_in_arrays():
    rng = random.Random(3)
    rows = [[rng.choice([b"a", b"b"]) for _ in range(rng.randrange(0, 40))] for _ in range(12)] + [[b"a"] * 30] * 2
    order, shared, row, left = substrings.subtree(rows)
    flat = [r[k:] for r in rows for k in range(len(r))]
    assert [flat[i] for i in order] == sorted(flat)
    common = lambda x, y: next((k for k, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y)))
    assert shared.tolist() == [0] + [common(flat[i], flat[j]) for i, j in zip(order, order[1:])]
    assert substrings.maximal_repeats(["x a b c d y", "z a b c d q", "r s"], 3) == [("a b c d", 2)]


def test_simhash_against_brute_force(docs):
    got = {r.doc_id: r for r in simhash.near_duplicates(docs, bits=8).collect()}
    fps = {i: int(r.fingerprint, 16) for i, r in got.items()}
    root = {i: i for i in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in fps:
        for j in fps:
            if i < j and bin(fps[i] ^ fps[j]).count("1") <= 8:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    assert {i: r.component_id for i, r in got.items()} == {i: find(i) for i in fps}


def plain_ctw(rows, depth):
    """The rule, node by node: log10 probability of each text, and of each next byte after a context."""
    counts, nodes = {}, set()
    for i, t in rows:
        s = b"\n" * depth + b" ".join(ctw.spelled(t)) + b"\n"
        for p in range(depth, len(s)):
            path = 1
            for k in range(8):
                bit = s[p] >> (7 - k) & 1
                for d in range(depth + 1):
                    key = (s[p - d : p], path)
                    nodes.add(key)
                    if ctw.is_training(i):
                        counts.setdefault(key, [0, 0])[bit] += 1
                path = path * 2 + bit
    kt = lambda z, o: math.lgamma(z + 0.5) + math.lgamma(o + 0.5) - math.log(math.pi) - math.lgamma(z + o + 1)
    pe = {k: kt(*counts.get(k, (0, 0))) for k in nodes}
    pw, below = {}, {}
    for k in sorted(nodes, key=lambda k: -len(k[0])):
        own, rest = math.log(0.5) + pe[k], math.log(0.5) + below.get(k, 0.0)
        pw[k] = pe[k] if len(k[0]) == depth else max(own, rest) + math.log1p(math.exp(-abs(own - rest)))
        if k[0]:
            up = (k[0][1:], k[1])
            below[up] = below.get(up, 0.0) + pw[k]

    def score(t):
        s, total = b"\n" * depth + b" ".join(ctw.spelled(t)) + b"\n", 0.0
        for at in range(depth, len(s)):
            path = 1
            for k in range(8):
                bit, p = s[at] >> (7 - k) & 1, None
                for d in range(depth, -1, -1):
                    key = (s[at - d : at], path)
                    c = counts.get(key, (0, 0))
                    own = (c[bit] + 0.5) / (sum(c) + 1)
                    w = 1.0 if p is None else math.exp(math.log(0.5) + pe[key] - pw[key])
                    p = own if p is None else w * own + (1 - w) * p
                total += math.log10(p)
                path = path * 2 + bit
        return total

    return score


def test_ctw_against_the_plain_rule_in_all_columns(spark, rows):
    few = [(i, t[:300]) for i, t in rows[:60]] + [(900, "Ab ab\tab"), (901, ""), (902, None)]
    got = {r.doc_id: r for r in ctw.scores(spark.createDataFrame(few, "doc_id long, text string"), block_bytes=3000, bucket_bytes=2000).collect()}
    few = [(i, t or "") for i, t in few]
    count, ends = Counter(), 0
    for i, t in few:
        if zlib.crc32(str(i).encode()) % 10:
            count.update(ctw.spelled(t))
            ends += 1
    n, v, score = sum(count.values()) + ends, len(count) + 1, plain_ctw(few, ctw.DEPTH)
    each = lambda c: math.log10((c + 0.1) / (n + 0.1 * (v + 1)))
    assert len(got) == len(few)
    for i, t in few:
        w, r = ctw.spelled(t), got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (zlib.crc32(str(i).encode()) % 10 == 0, len(w) + 1, sum(count[x] > 0 for x in w) + 1, n)
        assert math.isclose(r.base_score, sum(map(each, [*(count[x] for x in w), ends])), abs_tol=1e-7)
        assert math.isclose(r.score, score(t), rel_tol=1e-6)


def test_ctw_next_bytes_sum_to_one(spark):
    """Texts that differ in their last byte only: all bytes but white space and A-Z after one context."""
    import numpy as np

    code = np.sort(ctw.grams([b"abcab" + bytes([c]) for c in range(256)])[5::6])
    n = np.arange(256) % 7
    key = np.arange(1, 256) | (ord("a") << 8 | ord("b")) << 8
    logp = ctw.log_probabilities(code, n, ctw.DEPTH, key, np.full(255, 0.1), np.full(255, 0.8))  # any mixture of distributions is one
    assert math.isclose((10**logp).sum(), 1.0, rel_tol=1e-9)


def test_ctw_tasks_hold_one_block(spark, docs):
    from pyspark.sql import functions as F

    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] // 12
    n_blocks = ctw.block_count(docs, block_bytes=size)
    tasks = {r.task for r in ctw.scores(docs, block_bytes=size).select(F.spark_partition_id().alias("task")).collect()}
    assert len(tasks) == n_blocks > 4  # the session shuffles to 4


def test_ctw_block_is_not_held_whole(monkeypatch):
    """Four times the text of the same words takes no more memory."""
    import pyarrow as pa

    monkeypatch.setattr(ctw, "CHUNK_BYTES", 1 << 15)
    rng, words = random.Random(3), [f"word{i}" for i in range(300)]
    texts = [" ".join(rng.choices(words, k=200)) for _ in range(50)]

    def peak(times):
        batches = (pa.record_batch({"doc_id": list(range(50)), "text": [t[k:] + t[:k] for t in texts], "block": pa.array([7] * 50, pa.int32())}) for k in range(times))
        tracemalloc.start()
        got = [(r["word"], r["n"]) for out in ctw.block_counts(batches) for r in out.select(["block", "word", "n"]).to_pylist() if r["block"] == 7 and r["word"]]
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return most, sum(n for _, n in got)

    peak(1)
    (few, n), (many, m) = peak(1), peak(4)
    assert m > 3.9 * n and many < 1.5 * few


def test_ctw_learns(docs):
    held = [r for r in ctw.scores(docs, block_bytes=200000).collect() if r.held_out]
    assert sum(r.score for r in held) / sum(r.n_bytes for r in held) > -3 * math.log10(2)  # under three bits a byte


def test_toxicity_of_unseen_spellings(spark):
    """Labelled rows teach four words; held-out rows have other spellings of them."""
    rng, plain = random.Random(5), [f"{a}{b}" for a in "bread stone river cloud market garden".split() for b in ("", "s", "ing", "er")]
    bad, held = "scumbags vermins degenerate worthless".split(), "scumbagz verminz degenerates worthles".split()
    rows, labels = [], []
    for i in range(800):
        w, out, toxic = [rng.choice(plain) for _ in range(rng.randrange(20, 60))], zlib.crc32(str(i).encode()) % 4 == 2, i % 3 == 0
        if toxic:
            for _ in range(3):
                w.insert(rng.randrange(len(w)), rng.choice(held if out else bad))
        rows.append((i, " ".join(w)))
        labels.append((i, 1, int(toxic)))
    docs, labels = spark.createDataFrame([*rows, (None, None), (10_000, "")], "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = toxicity.toxicity(docs, labels).collect()
    judged = [(r.score, r.doc_id % 3 == 0) for r in got if r.held_out and r.doc_id < 800]
    assert sum(s >= 0.3 for s, y in judged if y) >= 0.9 * sum(y for _, y in judged)
    assert sum(s >= 0.3 for s, y in judged if not y) <= 0.1 * sum(not y for _, y in judged)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    assert len({r.score for r in got if r.doc_id in (None, 10_000)}) == 1


def test_fixity_names_what_is_lost_added_and_changed_and_nothing_else(spark):
    """In the middle, among records of one id and of none."""
    pages = [(i, f"http://x/{i}", f"<p>{i}</p>") for i in range(60)] + [(None, None, None), (None, "u", "x"), (7, "http://y", "z"), (7, "http://y", "z"), (-5, "n", LONG), (1 << 62, "n", "m")]
    schema = "page_id long, url string, html string"
    theirs = [(i, u, "<q>" if i == 41 else h) for i, u, h in pages if i != 30] + [(100, "e", "f"), (7, "http://y", "z")]
    theirs.remove((None, None, None))
    frame = lambda rows: spark.createDataFrame([(*r, 1, "x") for r in rows], schema + ", node int, digest string")
    got = fixity.audit(frame(pages), frame(theirs)).collect()
    assert sorted((str(r.page_id), r.status) for r in got if r.status != "ok") == [("100", "extra"), ("30", "missing"), ("41", "corrupt"), ("7", "extra"), ("None", "missing")]
    assert len(got) == len(pages) + 2 and all((r.digest == r.replica_digest) == (r.status == "ok") for r in got)
    ours = sorted((r for r in got if r.ordinal is not None), key=lambda r: r.ordinal)
    assert [r.ordinal for r in ours] == list(range(len(pages))) and all(a.stop_offset == b.start_offset for a, b in zip(ours, ours[1:]))
    none = frame([])
    assert fixity.audit(none, none).count() == 0
    assert [r.status for r in fixity.audit(none, frame([(None, None, None)] * 2)).collect()] == ["extra"] * 2


def test_records_can_be_read_back(spark):
    from pyspark.sql import functions as F

    rec = fixity.record(F.col("i"), F.col("u"), F.col("h"))
    rows = spark.createDataFrame([(1, "http://x", "<p>\r\n\r\né"), (None, None, None)], "i long, u string, h string").select("h", fixity.block(rec).alias("b"), fixity.header(rec, "Content-Length").alias("n"), fixity.header(rec, "WARC-Record-ID").alias("id")).collect()
    assert all(r.b == (r.h or "") and int(r.n) == len((r.h or "").encode()) and re.fullmatch("<urn:uuid:[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}>", r.id) for r in rows)


def changed(w, at, n, tag):
    """The words with n of them replaced; with runs of five words, n + 4 of len(w) - 4 runs go and as many come."""
    return w[:at] + [f"{tag}x{k}" for k in range(n)] + w[at + n :]


def test_near_dedup_joins_the_pairs_of_the_similarity_and_no_others(spark):
    rows = []
    for i in range(120):  # 196 runs: with 21 changed 175 / 217 is over 0.8, with 22 changed 174 / 218 is under
        w = [f"p{i}w{k}" for k in range(200)]
        rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join(changed(w, 90, 17 + i % 2, f"n{i}")))]
    got = {r.doc_id for r in simhash.without_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {2 * i for i in range(120)} | {2 * i + 1 for i in range(120) if i % 2}


def test_near_dedup_of_a_large_group_of_copies_of_one_text(spark):
    """Each copy is near the one text, most are far from one another: it takes the right edges of the group."""
    rng, w, copies = random.Random(1), [f"w{k}" for k in range(404)], []
    for i in range(1000):  # 400 runs, of which 8 words change 40: 360 / 440 is over 0.8; two copies mostly share about 324 / 476
        own = dict.fromkeys(rng.sample(range(4, 400, 5), 8), i)
        copies.append((i, " ".join(f"c{i}x{k}" if k in own else x for k, x in enumerate(w))))
    docs = spark.createDataFrame([*copies, (9999, " ".join(w))], "doc_id long, text string")
    assert [r.doc_id for r in simhash.without_near_duplicates(docs).collect()] == [0]
    assert len({r.component for r in resemblance.resembling(docs, piece=100).collect()}) == 1


def test_near_dedup_keeps_one_row_of_each_component_whatever_the_ids(spark):
    text = lambda tag: " ".join(f"{tag}{k}" for k in range(60))
    rows = [(None, text("a")), (None, text("b")), (None, text("b")), (5, text("c")), (5, text("d")), (7, text("e")), (8, text("e")), (None, text("f")), (9, text("f")), (8, text("g"))]
    got = simhash.without_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), r.text[0]) for r in got) == [("5", "c"), ("5", "d"), ("7", "e"), ("8", "g"), ("9", "f"), ("None", "a"), ("None", "b")]


def test_near_dedup_meets_all_that_share_a_deletion_variant(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    bases = rng.random((25, 2 * resemblance.SEGMENTS * resemblance.HALF)) < 0.5
    bits = np.concatenate([bases, *[bases ^ (rng.random(bases.shape) < 0.15) for _ in range(4)], bases[0] ^ (rng.random((150, bases.shape[1])) < 0.03)])
    bits[::9, : 64 * resemblance.WORDS] = rng.random((len(bits[::9]), 64 * resemblance.WORDS)) < 0.5  # meet, but are no candidates
    n, limit = len(bits), resemblance.bit_limit(0.8)
    segments = bits.reshape(n, resemblance.SEGMENTS, -1)
    near = [((segments[i] != segments).sum(2) <= 1).any(1) & ((bits[i] != bits)[:, : 64 * resemblance.WORDS].sum(1) <= limit) for i in range(n)]
    want = np.arange(n)
    for _ in range(n):
        want = np.array([want[x].min() for x in near])
    assert 25 < len(set(want.tolist())) < n - 150
    prints = spark.createDataFrame([(i, np.packbits(x).tobytes()) for i, x in enumerate(bits)], "id long, print binary").repartition(3)
    for meet in (resemblance.MEET, 60):  # whole groups, and groups cut into pieces
        edges = resemblance.meetings(prints, range(resemblance.SEGMENTS), 0.8, meet).toPandas()
        assert resemblance._joined(np.arange(n), edges.a.to_numpy(), edges.b.to_numpy()).tolist() == want.tolist()
    got = {r.node: r.root for r in resemblance.candidate_groups(prints.withColumnRenamed("id", "node"), 0.8).collect()}
    assert [got.get(i, i) for i in range(n)] == want.tolist()


def test_mixing_rates_are_the_minimum_and_reach_what_can_be_reached(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    share = np.concatenate([np.tile([0.985, 0.002, 0.013], (800, 1)), np.tile([0.1, 0.85, 0.05], (60, 1)), np.tile([0.1, 0.02, 0.88], (140, 1))]) * rng.uniform(0.8, 1.2, (1000, 3))
    a = rng.lognormal(5, 1, (1000, 1)) * share / share.sum(1, keepdims=True)
    expected = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(a)], "doc_id long, tokens array<double>")
    rates, outcome = mixing.fitted_rates(expected)
    r = np.array([x.rate for x in sorted(rates.collect())])
    goal, have = np.array(outcome["target"]), a.sum(0)
    assert np.all(abs(r @ a - goal) <= 0.05 * goal) and np.allclose(r @ a, outcome["got"], rtol=1e-6)
    slope = a @ ((r @ a - goal) / goal**2) + mixing.RIDGE * (r - 1) / len(r)  # of the objective by each rate
    assert np.all(abs(slope[r > 0]) < 1e-9) and np.all(slope[r == 0] > -1e-9)
    assert outcome["settled"] and all(outcome["met"])
    alike = spark.createDataFrame([(i, [80.0, 15.0, 5.0]) for i in range(50)], "doc_id long, tokens array<double>")
    outcome = mixing.fitted_rates(alike)[1]  # all documents are as toxic as the whole: no rates make it less so
    assert outcome["settled"] and not outcome["met"][1]
    rates, outcome = mixing.fitted_rates(expected, most=1.0, enough=0.01, ridge=mixing.STAGE_RIDGE)
    r = np.array([x.rate for x in sorted(rates.collect())])
    assert 0 <= r.min() and r.max() <= 1 and all(outcome["met"]) and np.allclose(r @ a, outcome["got"], rtol=1e-6)


def test_mixing_stage_obeys_its_rates_and_keeps_clean_rows(spark):
    rng = random.Random(2)
    kinds = {0: "garden river cloud stone".split(), 1: "vermin scum filth rot".split(), 2: "zzk qqx vvw kkj".split()}
    rows = [(i, " ".join(rng.choice(kinds[0] + 2 * kinds[k] if k else kinds[0]) for _ in range(60)), k) for i in range(600) for k in [1 if i % 20 == 0 else 2 if i % 10 == 5 else 0]]
    docs = spark.createDataFrame([(i, t, "own") for i, t, _ in rows] + [(None, None, "own"), (None, "garden " * 20, "own")], "doc_id long, text string, rate string")
    labels = spark.createDataFrame([(i, int(k != 2), int(k == 1)) for i, _, k in rows if i % 2 == 0 or k == 2], "doc_id long, quality int, toxic int")
    clean = {i for i, _, k in rows if k == 0}
    scarce = mixing.thinned(docs.where("doc_id % 10 <> 5 or doc_id = 5 or doc_id is null"), labels).collect()  # less low quality than its target
    assert len(clean & {r.doc_id for r in scarce}) >= 0.98 * len(clean) and sum(r.doc_id is not None and r.doc_id % 20 == 0 for r in scarce) <= 20
    kept = mixing.thinned(docs, labels).collect()
    assert all(r.rate == "own" for r in kept) and sum(r.doc_id is None for r in kept) == 2
    left = Counter(rows[r.doc_id][2] for r in kept if r.doc_id is not None)
    assert left[0] >= 0.98 * len(clean) and left[1] <= 10 and left[2] <= 20


def test_mixture_of_real_rows_meets_its_targets(spark):
    docs, known = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rates, outcome = mixing.mixture(docs, known)
    assert outcome["settled"] and outcome["met"] == [True] * 3
    assert outcome["got"] == pytest.approx(outcome["target"], rel=0.01)
    rows = rates.collect()
    for i, d in enumerate(mixing.DOMAINS):
        assert sum(r.rate * r.n_words * r[f"p_{d}"] for r in rows) == pytest.approx(outcome["got"][i], rel=1e-6)


def test_shares_count_labelled_documents_of_any_length(spark, monkeypatch):
    from quillsearch.llm import subword

    monkeypatch.setattr(subword, "SAMPLE_CHARS", 30)
    docs = spark.createDataFrame([(i, "short text" if i < 30 else "a much longer text " * 5) for i in range(60)], "doc_id long, text string")
    known = spark.createDataFrame([(i, int(i >= 25)) for i in range(60)], "doc_id long, label int")
    shares = subword.train(docs, known, 2)[-1]
    assert [math.exp(x) for x in shares] == pytest.approx([25.5 / 61, 35.5 / 61], rel=1e-5)
