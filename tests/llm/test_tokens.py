"""Packing and counting against the tokenizer library itself."""

import zlib
from bisect import bisect_left, insort

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from batchlens.llm.counting import token_counts
from batchlens.llm.packing import pack, plan_best_fit
from batchlens.llm.queries import QUERIES, byte_bpe
from batchlens.llm.tokens import Pieces, encoder
from batchlens.sources.shared import run_folder

SF = "/root/testdata/sf0.001"
LIBRARY = Tokenizer.from_file(byte_bpe())


def ids(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from(" \n\t\r\x0b\x1c\x85\xa0 \0ab'slré日😀1.<|endoftext|>"), max_size=60) | st.text(max_size=60))
def test_pieces_give_the_ids_of_the_whole_text(text):
    for _ in range(2):  # learnt, then from the memo
        assert np.frombuffer(encoder(byte_bpe()).encode([text])[0], np.uint32).tolist() == ids(text)


def test_special_strings_are_tokens():
    assert np.frombuffer(encoder(byte_bpe()).encode(["a <|endoftext|> b"])[0], np.uint32).tolist() == ids("a <|endoftext|> b")


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 300)))
def test_plan_fills_gapless_sequences_and_places_every_rank(counts):
    taken = {}
    for length in counts:
        seen = []
        for size, first, last, sequence, each, offset in plan_best_fit(counts, 64):
            if size == length:
                for rank in range(first, last + 1):
                    nth = rank - first
                    seen.append(rank)
                    taken.setdefault(sequence + nth // each, []).append((offset + nth % each * size, size))
        assert sorted(seen) == list(range(counts[length]))
    for pieces in taken.values():
        end = 0
        for offset, size in sorted(pieces):
            assert offset == end
            end += size
        assert end <= 64
    # as many sequences as piece by piece: each piece into the fullest sequence that has room for it
    rooms = []
    for length in sorted((n for n, k in counts.items() for _ in range(k)), reverse=True):
        at = bisect_left(rooms, length)
        left = rooms.pop(at) if at < len(rooms) else 64
        insort(rooms, left - length)
    assert len(taken) == len(rooms)


def check_packing(rows, texts, capacity):
    used = {}
    for r in rows:
        whole = ids(texts[r["doc_id"]]) + [0]
        part = whole[r["start"] : r["start"] + r["length"]]
        assert len(part) == r["length"] <= capacity
        assert zlib.crc32(np.array(part, "<u4").tobytes()) == r["ids_crc32"]
        used.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in used.values():
        end = 0
        for offset, n in sorted(pieces):
            assert offset == end
            end += n
        assert end <= capacity
    return used


def test_op1_packs_every_token_once(spark, texts):
    rows = QUERIES["op1_best_fit_packing"](spark, SF).collect()
    used = check_packing(rows, texts, 2048)
    total = sum(len(ids(t)) + 1 for t in texts.values())
    assert sum(r["length"] for r in rows) == total
    assert len(used) <= 1.02 * -(-total // 2048) + 1
    pieces = {}
    for r in rows:
        pieces.setdefault(r["doc_id"], []).append(r)
    for doc_id, some in pieces.items():
        some.sort(key=lambda r: r["piece"])
        assert [r["piece"] for r in some] == list(range(len(some)))
        assert all(r["length"] == 2048 for r in some[1:])
        assert len(some) == -(-(len(ids(texts[doc_id])) + 1) // 2048)


def test_packing_odd_rows(odd, empty):
    rows = pack(odd, byte_bpe(), capacity=512).collect()
    assert sum(r["length"] for r in rows if r["doc_id"] == 1) == 2 * (len(ids("one two three four five six seven eight nine ten")) + 1)
    assert [r["length"] for r in rows if r["doc_id"] in (3, 4)] == [1, 1]
    assert len({(r["sequence_id"], r["offset"]) for r in rows}) == len(rows)
    assert pack(empty, byte_bpe()).count() == 0


def test_op3_counts(spark, texts):
    rows = QUERIES["op3_token_counts"](spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        n = len(ids(texts[r["doc_id"]]))
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len((texts[r["doc_id"]] or "").encode()), n, n > 1024)


def test_cache_is_used_and_grows_by_misses_only(spark, odd, empty):
    cache = run_folder(spark, "test-cache")
    first = token_counts(odd, byte_bpe(), cache).collect()
    assert len(first) == odd.count() and {r["n_tokens"] for r in first if r["doc_id"] in (3, 4)} == {0}
    stored = spark.read.parquet(cache)
    assert stored.count() == odd.select(F.coalesce("text", F.lit(""))).distinct().count()
    # a planted count shows that stored digests are not encoded again
    more = spark.createDataFrame([(1, "new words"), (2, "planted")], "doc_id bigint, text string")
    planted = stored.limit(1).select("tokenizer", F.unhex(F.sha2(F.lit("planted"), 256)).alias("digest"), F.lit(99).cast("bigint").alias("n_tokens"))
    planted.write.mode("append").parquet(cache)
    got = {r["doc_id"]: r["n_tokens"] for r in token_counts(more, byte_bpe(), cache).collect()}
    assert got == {1: len(ids("new words")), 2: 99}
    assert token_counts(empty, byte_bpe(), cache).count() == 0


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "piece_bpe_32k.model"])
def test_other_tokenizers(spark, odd, name):
    import public_tokenizers

    path = public_tokenizers.path(name)
    if name.endswith(".json"):
        library = Tokenizer.from_file(path)
        count = lambda t: len(library.encode(t, add_special_tokens=False).ids)
    else:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        count = lambda t: len(model.encode(t))
    rows = token_counts(odd, path, run_folder(spark, "test-cache"))
    texts = {r["doc_id"]: r["text"] or "" for r in odd.filter("doc_id is not null").collect()}
    for r in rows.filter("doc_id is not null").collect():
        assert r["n_tokens"] == count(texts[r["doc_id"]])


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("aéЖωßnN \n.,;:!?\")]}'x9-#$%&*|ʰ߷ա"), max_size=40))
def test_words_by_the_model_alone_give_the_librarys_ids(text):
    assert np.frombuffer(encoder(byte_bpe()).encode([text])[0], np.uint32).tolist() == ids(text)


def test_memo_keeps_what_is_asked_for(monkeypatch):
    import batchlens.llm.tokens as tokens

    monkeypatch.setattr(tokens, "MEMO_ENTRIES", 20)
    own = tokens.Pieces(Tokenizer.from_file(byte_bpe()))
    for i in range(60):
        text = f"always here and word{i} x{i}y, more-{i}"
        assert np.frombuffer(own.encode([text])[0], np.uint32).tolist() == ids(text)
        assert len(own.memo) <= 30 and len(own.older) <= 30
    assert " here" in own.memo or " here" in own.older


def test_a_word_costs_once_whatever_closes_it():
    own = Pieces(Tokenizer.from_file(byte_bpe()))
    asked, model = [], own.tokenize
    own.tokenize = lambda word: asked.append(word) or model(word)
    texts = [f"{a} nonesuchword{b} {a}" for a in ("it", "été") for b in (",", ".", "", ";", "),", ".")]
    for text in [*texts, "\n".join(texts)]:
        assert np.frombuffer(own.encode([text])[0], np.uint32).tolist() == ids(text)
    assert sum("nonesuchword" in w for w in asked) == 1
    assert sum(w == "," for w in asked) == 1
