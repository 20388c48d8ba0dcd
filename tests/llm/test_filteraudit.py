"""The audit of filter orders against a loop over all orders and documents; the sketch against exact counts."""

import re
from collections import Counter
from itertools import permutations

import numpy as np
import pytest

from batchlens.llm.filteraudit import audit_filters, failed_filters, possible_repeat, sketch

WORD = re.compile(r"[^\x20\x09-\x0D]+")
COUNTS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def mask_of(doc_id, text, rows):
    words = WORD.findall(text)
    fails = [
        len(words) < 50, 100 * len(set(words)) < 65 * len(words), 100 * len(re.findall("[A-Z]", text)) > 5 * len(text),
        bool(re.search(r"[#$%&*|]", text)), doc_id is not None and any(i is not None and i < doc_id and t == text for i, t, _ in rows),
    ]
    return {c for c, f in zip("ABCDE", fails) if f}


def by_hand(rows, labels):
    known = [(i, t or "", s or "") for i, t, s in rows]
    quality = {i: max(q for j, q, _ in labels if j == i) for i, _, _ in labels}
    toxic = {i: max(x for j, _, x in labels if j == i) for i, _, _ in labels}
    masks = [(p, i, mask_of(i, t, known)) for i, t, p in known]
    out, removals = {}, Counter()
    for order in permutations("ABCDE"):
        name = "".join(order)
        for step, letter in enumerate(order, 1):
            for part in {p for p, _, _ in masks}:
                out[part, name, step] = dict.fromkeys(COUNTS, 0)
            for part, i, fails in masks:
                row, gone = out[part, name, step], fails & set(order[: step - 1])
                row["kept"] += not fails & set(order[:step])
                row["unique_fails"] += fails == {letter}
                if letter in fails:
                    row["redundant" if gone else "removed"] += 1
                    if not gone:
                        removals[part, letter] += 1
                        row["good_lost"] += quality.get(i) == 1
                        row["toxic_lost"] += toxic.get(i) == 1
    for (part, name, step), row in out.items():
        row["shapley"] = removals[part, name[step - 1]]
    return out


def rows_of(odd):
    long_ = " ".join(f"w{i}" for i in range(60))
    rows = [(r["doc_id"], r["text"], r["source"]) for r in odd.select("doc_id", "text", "source").collect()]
    rows += [(100 + i, long_, "hot") for i in range(40)] + [(None, long_, "hot"), (20, long_, None), (20, long_, "a")]
    rows += [(200 + i, f"{long_} {i}", "b") for i in range(30)] + [(300, long_ + " #", "b"), (301, long_.upper(), "b"), (302, "same " * 70, "b")]
    return rows


LABELS = [(100, 1, 0), (101, 1, 1), (20, 0, 1), (20, 1, 0), (None, 1, 1), (301, None, 1), (302, 1, None), (999, 1, 1)]


@pytest.mark.parametrize("hash_bits", [64, 3, 1])
def test_audit_equals_a_loop_over_all_orders(spark, odd, hash_bits):
    """With few bits of hash, distinct texts share both hashes and are told apart by the texts."""
    rows = rows_of(odd)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string").selectExpr("*", "1 AS part", "2 AS mask", "3 AS _h1", "4 AS n", "5 AS good")
    labels = spark.createDataFrame(LABELS, "doc_id bigint, quality int, toxic int").selectExpr("*", "1 AS good", "2 AS part")
    got = audit_filters(docs.repartition(4), labels, hash_bits).collect()
    want = by_hand(rows, [(i, q or 0, t or 0) for i, q, t in LABELS if i is not None])
    assert len(got) == len(want) == 120 * 5 * len({p for p, _, _ in want})
    assert {(r["part"], r["filter_order"], r["step"]): {c: r[c] for c in COUNTS} for r in got} == want


def test_audit_of_an_empty_table(spark, empty):
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert audit_filters(empty, labels).collect() == []


def test_every_row_keeps_its_place(spark, odd):
    assert failed_filters(odd).count() == odd.count()


def test_sketch_clears_most_unique_texts_and_no_repeated_one(spark):
    rng = np.random.default_rng(2)
    once, twice = rng.integers(-(2**63), 2**63, (2, 4000, 2))
    rows = np.concatenate([once, twice[:300], twice[:300], np.repeat(twice[300:301], 500, axis=0)])
    df = spark.createDataFrame([tuple(map(int, r)) for r in rows], "_h1 bigint, _h2 bigint").repartition(7)
    bits = sketch(df, 1 << 16)
    marked = df.filter(possible_repeat(spark, bits)("_h1", "_h2")).collect()
    keys = Counter((r["_h1"], r["_h2"]) for r in marked)
    assert all(keys[tuple(map(int, t))] == 2 for t in twice[:300]) and keys[tuple(map(int, twice[300]))] == 500
    assert len(marked) - 1100 < 0.05 * len(once)
    full = sketch(df, 1 << 4 << 4)  # far too small: more is asked, nothing is lost
    assert df.filter(possible_repeat(spark, full)("_h1", "_h2")).count() >= 1100
