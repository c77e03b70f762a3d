"""Encoders over public tokenizer files, loaded once in each Python worker.

A byte-level vocabulary splits texts so that no token spans the place between a character that is not white space and the
space after it. Texts are cut at those places, distinct pieces are encoded by the library once and remembered, and a text's
ids are those of its pieces in a row: the library's own ids, special strings (which hold no space) included. New pieces of
common characters are cut into words here, as the library would, and go to its model word by word.
"""

from __future__ import annotations

import os
import re
from functools import lru_cache

import numpy as np

#: Whatever some engine may take for white space; a space that follows one of these is no place to cut.
_BLANK = r"\s\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200f\u2028-\u202f\u205f-\u206f\u3000\ufeff"
_CUT = re.compile(rf" (?<![{_BLANK}] )")
_IS_BLANK = re.compile(f"[{_BLANK}]").match
#: Blocks of 256 code points whose texts are cut into words here (scripts that put spaces between words, and Hangul); others go
#: to the library whole.
_BLOCKS = {*range(0x30), *range(0xAC, 0xD8)}
#: Pieces that a worker remembers, and the longest that it remembers at all.
REMEMBERED, LONGEST = 600_000, 64


def vocabulary(name: str) -> str:
    """Where the installed vocabulary file lies."""
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=4)
def _json(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(maxsize=4)
def _model(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


@lru_cache(maxsize=4)
def may_cut(path: str) -> bool:
    """Whether the file's texts may be cut before spaces: byte-level BPE that changes no text and adds no space."""
    import json

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre = spec.get("pre_tokenizer") or {}
    plain = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
    special = all(" " not in t["content"] and not (t.get("lstrip") or t.get("rstrip") or t.get("single_word")) for t in spec.get("added_tokens", []))
    return bool(plain and special and not spec.get("normalizer") and not spec["model"].get("dropout"))


def whole_ids(path: str, texts: list[str]) -> list[list[int]]:
    """The library's ids of each text: tokenizers for .json, sentencepiece for .model; no added tokens."""
    if path.endswith(".model"):
        return _model(path).encode(texts, num_threads=1)
    return [x.ids for x in _json(path).encode_batch_fast(texts, add_special_tokens=False)]


class _Words:
    """Ids of short texts of common characters: cut into words as the file's pre-tokenizer cuts them, each given to the model.

    What it takes for letters, numbers and blanks, and how it writes a character for the model, is asked of it, one by one, for
    a block of characters when the first of them comes.
    """

    def __init__(self, path: str) -> None:
        library = _json(path)
        self.split, model = library.pre_tokenizer.pre_tokenize_str, library.model
        if hasattr(model, "_resize_cache"):
            model._resize_cache(0)  # words that come here are new: looking them up there costs more than it saves
        self.tokenize = model.tokenize
        self.blocks: set[int] = set()
        self.kinds: dict[str, list[str]] = {"a": [], "1": [], "!": [], " ": []}
        self.written: dict[int, str] = {}
        self.learn({0})
        self.space, self.packed = self.written[32], {x: x.to_bytes(4, "little") for x in library.get_vocab().values()}
        self.marks = "".join(c for c in self.kinds["!"] if c.isascii())
        self.special = re.compile("|".join(re.escape(t.content) for t in library.get_added_tokens_decoder().values()) or "(?!)").search
        self.again = lru_cache(maxsize=1 << 14)(self.ids)

    def learn(self, blocks: set[int]) -> None:
        for c in (chr(x) for block in sorted(blocks) for x in range(block << 8, (block + 1) << 8)):
            beside = {x: [word for word, _ in self.split(f"{x}{c}{x}")] for x in "a1!"}
            self.kinds[next((x for x, words in beside.items() if len(words) == 1), " ")].append(c)
            self.written[ord(c)] = "".join(beside["a"])[1:-1]
        self.blocks |= blocks
        letter, number, other, blank = ("".join(map(re.escape, x)) for x in self.kinds.values())
        self.letters = re.compile(f"[{letter}]+").fullmatch
        self.cut = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{letter}]+| ?[{number}]+| ?[{other}]+|[{blank}]+(?![^{blank}])|[{blank}]+").findall
        self.common = re.compile(rf"[{letter}{number}{other}{blank}]*").fullmatch

    def know(self, text: str) -> bool:
        if len(text) > LONGEST or self.special(text):
            return False
        if not text.isascii() and not self.common(text):
            blocks = {ord(c) >> 8 for c in text} - self.blocks
            if not blocks <= _BLOCKS:
                return False
            self.learn(blocks)
        return True

    def ids(self, word: str) -> bytes:
        return b"".join([self.packed[x.id] for x in self.tokenize(word if word.isascii() and word.isalpha() else word.translate(self.written))])

    def named(self, bare: str) -> bytes:
        """Of a space and letters."""
        return b"".join([self.packed[x.id] for x in self.tokenize(self.space + (bare if bare.isascii() else bare.translate(self.written)))])


class _Uncut(Exception):
    """A space follows a blank: the text may not be cut there."""


class _Known(dict):
    """Packed ids of pieces that begin with a space (named without it); those that it lacks are encoded when asked for.

    Names not asked for between two turns are forgotten at the second, so what is frequent stays.
    """

    def __init__(self, path: str) -> None:
        super().__init__()
        self.path, self.words, self.old = path, _Words(path), {}

    def turn(self) -> None:
        if len(self) > REMEMBERED // 2:
            self.old = dict(self)
            self.clear()

    def __missing__(self, name: str) -> bytes:
        found = self.old.get(name)
        if not found:
            if not name or _IS_BLANK(name[-1]):
                raise _Uncut
            found = self.encode(name)
            if len(name) > LONGEST:
                return found
        self[name] = found
        return found

    def encode(self, name: str) -> bytes:
        words = self.words
        bare = name.rstrip(words.marks)
        if words.letters(bare) and len(name) <= LONGEST and not words.special(name):
            if len(bare) == len(name):
                return words.named(bare)
            return (self.get(bare) or self.old.get(bare) or words.named(bare)) + words.again(name[len(bare) :])
        text = f" {name}"
        if words.know(text):
            return b"".join(map(words.again, words.cut(text)))
        return _pack(self.path, [text])[0]

    def row(self, cut: list[str]) -> bytes:
        """Ids of a text's pieces. A name before the last that is empty or ends with a blank was no place to cut."""
        first = b"".join(map(self.words.again, self.words.cut(cut[0]))) if self.words.know(cut[0]) else _pack(self.path, cut[:1])[0]
        if len(cut) == 1:
            return first
        last = cut[-1]
        return b"".join((first, *map(self.__getitem__, cut[1:-1]), self.get(last) or self.old.get(last) or self.encode(last)))


@lru_cache(maxsize=4)
def _known(path: str) -> _Known:
    return _Known(path)


def _pack(path: str, texts: list[str]) -> list[bytes]:
    return [np.asarray(x, dtype="<u4").tobytes() for x in whole_ids(path, texts)]


def _cut(text: str) -> list[str]:
    """The text cut at its spaces, if it shows no double one and its first is a place to cut; else at places to cut alone."""
    if "  " not in text:
        cut = text.split(" ")
        if len(cut) == 1 or not cut[0] or not _IS_BLANK(cut[0][-1]):
            return cut
    return _CUT.split(text)


def packed(path: str, texts: list[str]) -> list[bytes]:
    """Token ids of each text as little-endian unsigned 32-bit numbers, one after the other."""
    if path.endswith(".model") or not may_cut(path):
        return _pack(path, texts)
    known = _known(path)
    known.turn()
    out = []
    for text in texts:
        try:
            out.append(known.row(_cut(text)))
        except _Uncut:
            out.append(known.row(_CUT.split(text)))
    return out


def ids(path: str, texts: list[str]) -> list[np.ndarray]:
    """Token ids of each text as unsigned 32-bit numbers."""
    return [np.frombuffer(x, dtype="<u4") for x in packed(path, texts)]


def counts(path: str, texts: list[str]) -> list[int]:
    """Tokens of each text."""
    return [len(x) // 4 for x in packed(path, texts)]
