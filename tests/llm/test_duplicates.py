"""Near-duplicates, passages and repeated bytes against brute force."""

import hashlib
import tracemalloc
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import batchlens.llm.words as words_module
from batchlens.llm.components import components
from batchlens.llm.neardup import inverse_frequencies, keep_one, near_duplicates, similarity, weighted_shingles
from batchlens.llm.passages import chains, common_subsequence, repeated_passages
from batchlens.llm.queries import QUERIES
from batchlens.llm.substrings import Parsed, remove_repeats
from batchlens.llm.words import hash_words, runs

SF = "/root/testdata/sf0.001"


def classes(links, nodes):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_op7_finds_all_classes(spark, documents, texts):
    idf = inverse_frequencies(documents)
    words = {d: hash_words([t])[0] for d, t in texts.items()}
    sides = {d: weighted_shingles(w, idf) for d, w in words.items()}
    docs = sorted(texts)
    links = [(a, b) for i, a in enumerate(docs) for b in docs[i + 1 :] if texts[a] == texts[b] or similarity(sides[a], sides[b]) >= 0.8]
    want = classes(links, docs)
    got = QUERIES["op7_weighted_minhash"](spark, SF).collect()
    assert {r["doc_id"]: r["class_id"] for r in got} == want
    assert sorted(r["doc_id"] for r in got if r["kept"]) == sorted(set(want.values()))


def test_weighted_jaccard_by_hand():
    idf = np.ones(1 << 16)
    a, b = (weighted_shingles(hash_words([t])[0], idf) for t in ("a b c d e f g h", "a b c d e f g x"))
    assert similarity(a, b) == pytest.approx(3 / 5)
    twice = weighted_shingles(hash_words(["a b c d e a b c d e"])[0], idf)
    assert sorted(twice[1]) == [1, 1, 1, 1, 2]


def test_near_duplicates_of_odd_rows(odd, empty):
    rows = near_duplicates(odd).collect()
    assert len(rows) == odd.count()
    of = defaultdict(list)
    for r in rows:
        of[r["doc_id"]].append(r)
    assert {r["class_id"] for r in of[1] + of[2]} == {1} and {r["class_rows"] for r in of[1] + of[2]} == {3}
    assert all(r["kept"] for r in of[4]) and [r["class_id"] for r in of[4]] == [4]
    kept = keep_one(odd)
    assert kept.columns == odd.columns
    ids = sorted((r["doc_id"] for r in kept.collect()), key=repr)
    assert ids == sorted([1, 3, 4, None, None, 5, 6, 7], key=repr)
    assert near_duplicates(empty).count() == 0 and keep_one(empty).count() == 0


def test_large_group_of_near_copies_is_one_class(spark):
    base = [f"w{i}" for i in range(200)]
    rows = [(k, " ".join(base[:k] + [f"edit{k}"] + base[k + 1 :])) for k in range(120)]
    rows += [(500 + k, " ".join(f"u{k}x{i}" for i in range(60))) for k in range(20)]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {r["class_id"] for r in got if r["doc_id"] < 120} == {0}
    assert all(r["class_id"] == r["doc_id"] for r in got if r["doc_id"] >= 500)


def test_pairs_inside_a_large_bucket_of_texts_that_are_not_similar_enough(spark):
    """Pages of one template at 0.5 to 0.75, and among them pairs above 0.8, against brute force."""
    rng = np.random.default_rng(5)
    edit = lambda base, name, n: [f"{name}x{i}" if i in chosen else w for chosen in [set(rng.choice(200, n, False).tolist())] for i, w in enumerate(base)]
    template = [f"w{i}" for i in range(200)]
    pages = [edit(template, f"p{k}", 3) for k in range(260)]
    pages += [edit(pages[k], f"q{k}", 1) for k in range(0, 240, 6)]
    df = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(pages)], "doc_id bigint, text string")
    idf = inverse_frequencies(df)
    sides = [weighted_shingles(hash_words([" ".join(w)])[0], idf) for w in pages]
    scores = {(i, j): similarity(sides[i], sides[j]) for i in range(len(pages)) for j in range(i)}
    links = [pair for pair, score in scores.items() if score >= 0.8]
    assert 30 <= len(links) <= 200 and 0.5 < np.median(list(scores.values())) < 0.75
    got = near_duplicates(df).collect()
    assert {r["doc_id"]: r["class_id"] for r in got} == classes(links, range(len(pages)))


def test_components_of_a_long_chain(spark):
    links = [(i, i + 1) for i in range(60)] + [(100, 101), (101, 102), (102, 100)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == classes(links, {n for link in links for n in link})


def test_op5_finds_every_document_with_a_repeated_passage(spark, texts):
    words = {d: t.encode().split() for d, t in texts.items()}
    at = defaultdict(set)
    for d, w in words.items():
        for i in range(len(w) - 49):
            at[tuple(w[i : i + 50])].add(d)
    want = {d for some in at.values() if len(some) > 1 for d in some}
    got = QUERIES["op5_chained_passages"](spark, SF).collect()
    assert want <= {r["doc_id"] for r in got}
    assert {(r["doc_id"], r["start"], r["partner_id"], r["partner_start"]) for r in got} == {
        (r["partner_id"], r["partner_start"], r["doc_id"], r["start"]) for r in got
    }
    for r in got:
        a = words[r["doc_id"]][r["start"] : r["start"] + r["n_words"]]
        b = words[r["partner_id"]][r["partner_start"] : r["partner_start"] + r["partner_words"]]
        assert min(len(a), len(b)) >= 50 and r["n_equal"] >= 0.8 * max(len(a), len(b))
        table = [[0] * (len(b) + 1)]
        for x in a if len(a) < 300 else ():
            table.append([0])
            for j, y in enumerate(b):
                table[-1].append(table[-2][j] + 1 if x == y else max(table[-2][j + 1], table[-1][j]))
        assert len(table) == 1 or table[-1][-1] == r["n_equal"]


def test_fuzzy_passage_with_edits_and_a_gap(spark, odd, empty):
    passage = [f"p{i}" for i in range(90)]
    changed = passage[:30] + ["new"] + passage[31:55] + ["added", "words"] + passage[55:]
    docs = [(1, [f"a{i}" for i in range(40)] + passage + ["z"] * 3), (2, ["q"] * 5 + changed + [f"b{i}" for i in range(70)]), (3, [f"c{i}" for i in range(200)])]
    df = spark.createDataFrame([(d, " ".join(w)) for d, w in docs], "doc_id bigint, text string")
    rows = [r for r in repeated_passages(df).collect()]
    assert {frozenset((r["doc_a"], r["doc_b"])) for r in rows} == {frozenset((1, 2))}
    best = max(rows, key=lambda r: r["n_equal"])
    assert best["n_equal"] == 89
    assert repeated_passages(empty).count() == 0
    assert repeated_passages(odd, min_words=10).filter("doc_a = 1 and doc_b = 2").count() == 1


def test_halves_of_a_passage_hide_no_whole_copies(spark):
    """A holds the first half of a passage, D the second, B and C all of it, in every order of ids."""
    rng = np.random.default_rng(3)
    docs, want = [], set()
    for group in range(30):
        passage = [f"p{group}_{i}" for i in range(64)]
        ids = (10 * group + rng.permutation(4)).tolist()
        for doc, held in zip(ids, (passage[:32], passage, passage, passage[32:])):
            docs.append((doc, " ".join([f"x{doc}_{i}" for i in range(60)] + held + [f"y{doc}_{i}" for i in range(60)])))
        want.add(frozenset(ids[1:3]))
    found = repeated_passages(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(7)).collect()
    assert {frozenset((r["doc_a"], r["doc_b"])) for r in found} == want
    assert all(r["words_a"] == r["words_b"] == r["n_equal"] == 64 for r in found)


def test_runs_are_equal_where_their_words_are():
    words = np.random.default_rng(0).integers(0, 3, 400).astype(np.uint64)
    for n in (1, 2, 5, 50, 400, 401):
        want = [tuple(words[i : i + n]) for i in range(len(words) - n + 1)]
        got = runs(words, n).tolist()
        assert len(got) == len(want) and len(set(got)) == len(set(want)) == len(set(zip(got, want)))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 60), st.integers(0, 60)), min_size=1, max_size=14, unique=True))
def test_best_chain_is_best(points):
    """Against all increasing series."""
    pts = sorted(points)
    best = {}
    for j, (x, y) in enumerate(pts):
        best[j] = 8.0
        for i, (u, v) in enumerate(pts[:j]):
            if u < x and v < y:
                best[j] = max(best[j], best[i] + 8 - 0.1 * (x - u + y - v - 16))
    xs, ys = np.array(pts).T
    a0, a1, b0, b1 = chains(xs, ys)[0]
    ends = {(x + 8, y + 8) for j, (x, y) in enumerate(pts) if best[j] >= max(best.values()) - 1e-9}
    assert (a1, b1) in ends


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 4), max_size=40), st.lists(st.integers(0, 4), max_size=40))
def test_common_subsequence(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last, row = row, [0]
        for j, y in enumerate(b):
            row.append(last[j] + 1 if x == y else max(last[j + 1], row[j]))
    assert common_subsequence(np.array(a, int), np.array(b, int)) == row[-1]


def brute_bytes(rows, length):
    bodies = [(t or "").encode() for _, t in rows]
    times = defaultdict(int)
    for b in bodies:
        for i in range(len(b) - length + 1):
            times[b[i : i + length]] += 1
    out = []
    for (d, _), b in zip(rows, bodies):
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if times[b[i : i + length]] > 1:
                gone[i : i + length] = True
        spans = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        rest = bytes(np.frombuffer(b, np.uint8)[~gone])
        out.append((d, len(b), int(gone.sum()), spans, hashlib.sha256(rest).hexdigest()))
    return sorted(out, key=repr)


def test_op6_removes_exactly_the_repeats(spark, texts):
    got = sorted((tuple(r) for r in QUERIES["op6_repeated_bytes"](spark, SF).collect()), key=repr)
    assert got == brute_bytes(list(texts.items()), 200)


def test_repeats_of_many_kinds(spark):
    rng = np.random.default_rng(4)
    word = lambda: bytes(rng.integers(97, 123, rng.integers(2, 9)).astype(np.uint8)).decode()
    make = lambda n: " ".join(word() for _ in range(n))
    shared = [make(60) for _ in range(4)]
    rows = [(0, "a" * 1000), (1, "ab" * 300), (2, "a" * 700), (3, ""), (4, None), (5, shared[0]), (5, shared[0]), (None, shared[0] + "!")]
    for k in range(10, 40):
        cut = shared[k % 4]
        a, b = sorted(rng.integers(0, len(cut), 2))
        rows.append((k, make(rng.integers(0, 30)) + cut[a:b] + make(rng.integers(0, 30)) + cut[: rng.integers(150, 260)]))
    rows.append((99, make(10) + shared[1] + make(3) + shared[1]))
    got = remove_repeats(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute_bytes(rows, 200)


def test_repeats_odd_rows(odd, empty):
    rows = [(r["doc_id"], r["text"]) for r in odd.select("doc_id", "text").collect()]
    small = [(d, t) for d, t in rows if d != 6]
    got = sorted((tuple(r) for r in remove_repeats(odd).filter("doc_id is null or doc_id <> 6").collect()), key=repr)
    assert got == brute_bytes(small, 200)
    assert remove_repeats(empty).count() == 0


def test_phrases_cover_every_window():
    text = bytes(np.random.default_rng(2).integers(0, 256, 5000).astype(np.uint8))
    parsed = Parsed(text, 200)
    near = [i for a, b in zip(parsed.low, parsed.high) for i in range(a, b + 1)]
    assert sorted([*near, *parsed.far.tolist()]) == list(range(len(text) - 199))


def test_hashes_take_little_memory_and_do_not_depend_on_blocks(monkeypatch):
    texts = [" ".join(f"w{i % 997}-{k}" for i in range(700 * k)) for k in range(1, 21)] + ["y" * 300_000 + " z", ""]
    words_module._powers.cache_clear()
    tracemalloc.start()
    hashes, bounds = hash_words(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40 << 20
    monkeypatch.setattr(words_module, "BLOCK", 5000)
    other, cuts = hash_words(texts)
    assert (hashes == other).all() and (bounds == cuts).all()
