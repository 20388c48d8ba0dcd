"""Token ids of whole texts by a tokenizer file, inside a task.

``encoder(path)`` loads a file once per worker process.  Texts go in lists; a
result is the ids as little-endian unsigned 32-bit numbers in ``bytes``, so a
count is a length and a checksum needs no conversion.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from functools import lru_cache
from itertools import chain
from operator import attrgetter

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark deals out the cores

import numpy as np  # noqa: E402
from tokenizers import Tokenizer  # noqa: E402

MEMO_ENTRIES = 1_000_000  # some 200 MB when full
ENDS_ENTRIES = 10_000  # runs of closing punctuation that are remembered

_ENDS = '.,;:!?")]}#$%&*|-'  # may close a word; a run of them is a piece of its own
_OLD_LETTERS = "\u0500"  # letters below are letters to every version of the Unicode tables


def _byte_letters() -> dict[int, int]:
    """How byte-level tokenizers write bytes: printable characters of Latin-1 as they are, others from 256 on, in order."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in plain]
    return {b: 256 + i for i, b in enumerate(others)}


_BYTE_LETTERS = _byte_letters()
_id = attrgetter("id")
_BLANK = chr(_BYTE_LETTERS[32])
_BEFORE_WORD = re.compile(r"(?<=\S)(?= \S)")


class Whole:
    """Every text goes to the library as it is."""

    def __init__(self, tokenizer: Tokenizer) -> None:
        self.tokenizer = tokenizer

    def encode(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]


class Pieces:
    """Byte-level BPE: texts are cut where a token can't reach across, and the library sees each piece once.

    Such a tokenizer first cuts a text into a word with the blank before it, a
    run of digits, and so on, and then merges bytes inside each.  A single blank
    between two characters that aren't white space always begins a new one, and a
    single line break between two such characters is one of its own, so texts may
    be cut there.  Pieces met before come from a memo, of two generations: what was not
    asked for while one filled up is forgotten.  A word of letters, with or without closing
    punctuation, goes to the library's model alone, other pieces through all of the library.
    Texts that hold a special token's string go to the library whole.
    """

    def __init__(self, tokenizer: Tokenizer) -> None:
        self.whole = Whole(tokenizer)
        self.tokenize = tokenizer.model.tokenize
        self.special = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
        self.line_break = tokenizer.encode("\n", add_special_tokens=False).ids[0]
        self.memo: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.ends: dict[str, bytes] = {}

    def cut(self, text: str) -> list[str]:
        words = text.split()
        spaces = len(text) - len("".join(words))
        if spaces >= len(words) or "\0" in text:  # white space at an end, or two characters of it together
            return [p for p in _BEFORE_WORD.split(text) if p]
        return list(filter(None, text.replace("\n", "\0\n\0").replace(" ", "\0 ").split("\0")))

    def encode(self, texts: list[str]) -> list[bytes]:
        if len(self.memo) > MEMO_ENTRIES // 2:
            self.memo, self.older = {}, self.memo
        cut = [None if any(s in t for s in self.special) else self.cut(t) for t in texts]
        pieces = list(chain.from_iterable(filter(None, cut)))
        ids = list(map(self.memo.get, pieces))
        unknown = [i for i, known in enumerate(ids) if known is None]
        self._learn({pieces[i] for i in unknown})
        for i in unknown:
            ids[i] = self.memo[pieces[i]]
        out, at = [], 0
        for text, own in zip(texts, cut):
            if own is None:
                out.append(self.whole.encode([text])[0])
            else:
                out.append(b"".join(ids[at : at + len(own)]))
                at += len(own)
        return out

    def _by_model(self, piece: str) -> bytes | None:
        """The ids of a word of letters and its closing punctuation, None for other pieces.

        The word is remembered by itself, so it costs once, whatever closes it.
        """
        body = piece.rstrip(_ENDS)
        word = body[1:] if body[:1] == " " else body
        if not word.isalpha():
            return None
        if len(body) < len(piece):
            ids = self.memo.get(body) or self.older.get(body) or self._of_letters(body, word)
            if ids is None:
                return None
            self.memo[body] = ids
            return ids + self._of_end(piece[len(body) :])
        return self._of_letters(body, word)

    def _of_letters(self, body: str, word: str) -> bytes | None:
        if body.isascii():
            found = self.tokenize(body.replace(" ", _BLANK))
        elif max(word) < _OLD_LETTERS:
            found = self.tokenize(body.encode().decode("latin-1").translate(_BYTE_LETTERS))
        else:
            return None
        return array("I", map(_id, found)).tobytes()

    def _of_end(self, end: str) -> bytes:
        ids = self.ends.get(end)
        if ids is None:
            ids = array("I", map(_id, self.tokenize(end))).tobytes()
            if len(self.ends) < ENDS_ENTRIES:
                self.ends[end] = ids
        return ids

    def _learn(self, pieces: set[str]) -> None:
        """Words the model can't take alone go to the library as one text, a line each; the ids of the line breaks part them again."""
        plain, rest = [], []
        for p in pieces:
            ids = self.memo.get(p) or self.older.get(p)  # a word may have come with its closing punctuation
            if ids is None:
                ids = self._by_model(p)
            if ids is not None:
                self.memo[p] = ids
                continue
            word = p[1:] if p[0] == " " else p
            (plain if word.split() == [word] else rest).append(p)
        self.memo.update(zip(rest, self.whole.encode(rest)))
        if plain:
            ids = self.whole.encode(["\n".join(plain)])[0]
            ends = (np.flatnonzero(np.frombuffer(ids, np.uint32) == self.line_break) * 4).tolist()
            self.memo.update(zip(plain, (ids[a:b] for a, b in zip([0, *(e + 4 for e in ends)], [*ends, len(ids)]))))


class SentencePieces:
    def __init__(self, path: str) -> None:
        import sentencepiece

        self.processor = sentencepiece.SentencePieceProcessor(model_file=path)

    def encode(self, texts: list[str]) -> list[bytes]:
        return [array("I", ids).tobytes() for ids in self.processor.encode(texts, num_threads=1)]


@lru_cache(maxsize=4)
def encoder(path: str) -> Whole | Pieces | SentencePieces:
    """``.json`` files are for tokenizers, ``.model`` files for sentencepiece."""
    if path.endswith(".model"):
        return SentencePieces(path)
    tokenizer = Tokenizer.from_file(path)
    made = json.loads(tokenizer.to_str())
    before = made.get("pre_tokenizer") or {}
    plain = made.get("normalizer") is None and before.get("type") == "ByteLevel"
    if plain and before.get("use_regex", True) and not before.get("add_prefix_space") and not made["model"].get("ignore_merges"):
        return Pieces(tokenizer)
    return Whole(tokenizer)
