"""Tokenizers of words: what follows a space is encoded once and remembered, as the tokenizers used here never join across it.

A text is cut before each single space that a character other than white space follows. Byte-level pre-tokenization always
begins a token there, and sentence pieces hold their space mark at the front only. Texts in which a space is followed by white
space or ends the text aren't cut but encoded whole. So the ids are those of the whole text in either case.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_UNCUT = re.compile(r" (?=\s|\Z)")
#: Longer words aren't remembered.
LONG_WORD = 100
#: Words that a Python worker remembers at most; beyond it those of the block at hand stay.
REMEMBERED = 500_000


class WordMemo:
    """Remembers what `encode` gives for words; encode takes a list of texts and gives a value for each."""

    def __init__(self, encode: Callable[[list[str]], list], limit: int = REMEMBERED):
        self.encode, self.limit, self.memo = encode, limit, {}

    def __call__(self, texts: list[str]) -> list[list[Any]]:
        """For each text the values of its parts, in order."""
        cut = [[t] if _UNCUT.search(t) else t.split(" ") for t in texts]
        seen = set().union(*(c[1:] for c in cut))
        new = [w for w in seen if w not in self.memo]
        if len(self.memo) + len(new) > self.limit:
            self.memo = {w: self.memo[w] for w in seen if w in self.memo}
        self.memo.update(zip(new, self.encode([" " + w for w in new])))
        heads = iter(self.encode([c[0] for c in cut if c[0]]))
        get = self.memo.__getitem__
        out = [[*([next(heads)] if c[0] else []), *map(get, c[1:])] for c in cut]
        for w in new:
            if len(w) > LONG_WORD:
                del self.memo[w]
        return out


class WordIds:
    """Ids of texts as bytes of unsigned 32-bit numbers; Python sees a block's distinct words only."""

    def __init__(self, encode: Callable[[list[str]], list[bytes]], limit: int = REMEMBERED):
        self.encode, self.limit, self.memo = encode, limit, {}

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids (unsigned 32 bits), and each text's number of them."""
        whole = [bool(_UNCUT.search(t)) for t in texts]
        cut = pc.split_pattern(pa.array(["" if w else t for w, t in zip(whole, texts)], pa.large_string()), " ")
        coded = cut.values.dictionary_encode()
        words, codes = coded.dictionary.to_pylist(), coded.indices.to_numpy().astype(np.int64)
        new = [w for w in words if w not in self.memo]
        if len(self.memo) + len(new) > self.limit:
            self.memo = {w: self.memo[w] for w in words if w in self.memo}
        self.memo.update(zip(new, self.encode([" " + w for w in new])))
        first = cut.offsets.to_numpy()[:-1]
        heads = self.encode([t if w else t.split(" ", 1)[0] for w, t in zip(whole, texts)])
        parts = [*map(self.memo.__getitem__, words), *heads]
        for w in new:
            if len(w) > LONG_WORD:
                del self.memo[w]
        codes[first] = len(words) + np.arange(len(texts))
        sizes = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
        begin, size = (np.cumsum(sizes) - sizes)[codes], sizes[codes]
        at = np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(size.sum())
        return np.frombuffer(b"".join(parts), "<u4")[at], np.add.reduceat(size, first)


_loaded: dict[tuple, Any] = {}


def once(key: tuple, make: Callable[[], Any]) -> Any:
    """What make gives, made once in a Python worker, which tasks share one after another."""
    if key not in _loaded:
        _loaded[key] = make()
    return _loaded[key]


def forget() -> None:
    """Frees what a Python worker holds from earlier stages, Arrow's unused memory too."""
    _loaded.clear()
    pa.default_memory_pool().release_unused()


#: Byte-level pre-tokenization parts a word of letters from the marks behind it, and both from a line feed between them. Then the model alone
#: gives the ids, without the work around it. Only letters that every version of Unicode has; no apostrophes, which have rules of their own.
_MARKS = '.,;:!?$*()"-'
_LAST_LETTER = "\u0250"
_AT_ONCE = 2000


class ByteBpe:
    """A byte-level file of the tokenizers library. special_as_text: the strings of special tokens are ordinary text."""

    def __init__(self, path: str, special_as_text: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = special_as_text
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        before = spec.get("pre_tokenizer") or {}
        self.plain = spec.get("normalizer") is None and before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space", True)
        self.model, self.marks, self.table = self.tokenizer.model, {}, byte_level()

    def _model_ids(self, text: str) -> list[int]:
        return [t.id for t in self.model.tokenize("Ġ" + text[1:] if text[0] == " " and text.isascii() else "".join(map(self.table.__getitem__, text.encode())))]

    def _mark(self, text: str) -> list[int]:
        if text not in self.marks:
            if len(self.marks) > 10_000:
                self.marks.clear()
            self.marks[text] = self._model_ids(text)
        return self.marks[text]

    def _plain_ids(self, text: str) -> list[int] | None:
        """Ids of a space, letters and marks, lines of letters and marks behind them; None for any other text."""
        if "\n" in text:
            first, *rest = text.split("\n")
            out = self._plain_ids(first) if first else None
            for line in rest:
                more = self._plain_ids(line) if out is not None and line and line[0] != " " else None
                out = None if more is None else out + self._mark("\n") + more
            return out
        word = text.rstrip(_MARKS)
        letters = word[1:] if word[:1] == " " else word
        if not letters.isalpha() or not (letters.isascii() or max(letters) < _LAST_LETTER):
            return None
        return self._model_ids(word) + (self._mark(text[len(word) :]) if len(word) < len(text) else [])

    def ids(self, texts: list[str]) -> list[list[int]]:
        """The ids of whole texts."""
        out: list = [None] * len(texts)
        hard, tokenize = [], self.model.tokenize
        for k, t in enumerate(texts):
            if self.plain and t[:1] == " " and t.isascii() and t[1:].isalpha() and len(t) < LONG_WORD:  # most words
                out[k] = [x.id for x in tokenize("Ġ" + t[1:])]
                continue
            got = self._plain_ids(t) if self.plain and len(t) < LONG_WORD else None
            if got is None:
                hard.append(k)
            else:
                out[k] = got
        for lo in range(0, len(hard), _AT_ONCE):
            some = hard[lo : lo + _AT_ONCE]
            for k, e in zip(some, self.tokenizer.encode_batch_fast([texts[k] for k in some], add_special_tokens=False)):
                out[k] = e.ids
        return out


def byte_level() -> list[str]:
    """The character that a byte-level vocabulary has for each byte: printable ones stand for themselves, others from U+0100 on in order."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in printable else chr(next(rest)) for b in range(256)]


def public_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
