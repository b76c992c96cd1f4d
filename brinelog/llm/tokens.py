"""Token ids of whole texts by a public word-level BPE tokenizer, with each distinct word encoded once."""

from __future__ import annotations

import itertools
import json
import os
import re
import unicodedata

import numpy as np

from .common import trim
from .words import Block, blocks

#: How the tokenizer cuts words (fixed value); files that cut otherwise are followed too, word by word.
CUT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
END = "</w>"


def _letters() -> str:
    """Letters of the Latin, Greek and Cyrillic blocks that normalise to themselves, alone and in any company, and whose lower case is one such letter."""
    plain = [c for a, e in ((0xC0, 0x250), (0x370, 0x530)) for c in map(chr, range(a, e)) if c.isalpha() and unicodedata.normalize("NFC", c) == c]
    return "".join(c for c in plain if c != "Σ" and len(c.lower()) == 1 and c.lower() in plain)


_LETTERS = re.escape(_letters())
#: Words whose cut and lower case need no tables of the tokenizer's: printable ASCII and the letters above.
_KNOWN = re.compile(f"[!-~{_LETTERS}]+")
_ALL_KNOWN = re.compile(f"[ -~{_LETTERS}]+")
_PIECE = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[a-z{_LETTERS}]+|[0-9]|[^ a-z0-9{_LETTERS}]+| ")
#: Words that are coded at a time.
PART = 1 << 16


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies: itself if it is printable, else the next one from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(0x100 + i): b for i, b in enumerate(rest)}


def merges_by_rank(vocab: dict[str, int], merges: list[tuple[str, str]]) -> tuple[dict[bytes, int], np.ndarray] | None:
    """(ranks of byte strings, id of each rank): merging the pair of least rank gives the same ids as the list of merges; None if it wouldn't.

    A word's end is a zero byte that joins its last byte first. Ranks name a result only, merges also the pair. They agree if
    every token comes, from its bytes alone and by lower ranks, to just the pair that its merge names: what stands beside a
    token can't change how its inside was merged.
    """
    byte = _byte_letters()
    at = {t: bytes(byte[c] for c in t.removesuffix(END)) + b"\0" * t.endswith(END) for t in vocab if all(c in byte for c in t.removesuffix(END))}
    letters = sorted(byte, key=byte.get)
    first = [*letters, *(c + END for c in letters[1:])]
    if not all(t in vocab for t in first):
        return None
    names = [*first, *(a + b for a, b in merges)]
    if len(set(names)) != len(names) or not all(t in at and t in vocab for t in names) or b"\0" in vocab:
        return None
    ranks = {at[t]: r for r, t in enumerate(names)}
    for a, b in merges:
        whole = at[a + b]
        parts, limit = [whole[i : i + 1] for i in range(len(whole))], ranks[whole]
        while len(parts) > 2:
            found = [ranks.get(x + y, limit) for x, y in zip(parts, parts[1:], strict=False)]
            low = min(found)
            if low >= limit:
                return None
            i = found.index(low)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        if parts != [at[a], at[b]]:
            return None
    return ranks, np.array([vocab[t] for t in names], "<u4")


class WordCoder:
    """Ids of texts, as little-endian unsigned 32-bit bytes, just as the tokenizer gives them.

    This kind of tokenizer drops white space and never makes a token across it, so a text's ids are its words' ids one after
    another. Words of known letters are cut here and merged by rank in bulk; all others, and all words of a file
    that merges_by_rank can't follow, are left to the tokenizer itself. A cache that outgrows ``limit`` words
    starts anew; results don't depend on it. It knows words by their 64-bit hashes, so ids are exact but for chances of 2**-64 a
    pair of words, and only words that are new to it become Python objects.
    """

    def __init__(self, path: str, limit: int = 400_000):
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.limit = limit
        self._anew()
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        model, cuts = told["model"], json.dumps(told["pre_tokenizer"])
        by_rank = None
        if model.get("end_of_word_suffix") == END and json.dumps(CUT) in cuts and "Lowercase" in json.dumps(told["normalizer"]):
            by_rank = merges_by_rank(model["vocab"], [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]])
        self.ranked = None
        if by_rank:
            ranks, self.ids = by_rank
            self.ranked = tiktoken.Encoding("words", pat_str="[^ ]+", mergeable_ranks=ranks, special_tokens={})
            self.gap = ranks[b"\0"]
        self.largest = max(self.tokenizer.get_vocab().values(), default=0)

    def _anew(self) -> None:
        """An empty cache: hashes of words in order, and where each one's ids begin in the pool, and how many there are."""
        self.keys = np.zeros(0, np.uint64)
        self.start = self.length = np.zeros(0, np.int64)
        self.pool = np.zeros(0, "<u4")

    def _told(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, begin, end of each word's): words are checked, lower-cased, cut and merged all at once; only where one of them isn't known are they told apart."""
        text = b" ".join(words).decode()
        if self.ranked is not None and "<|" not in text and _ALL_KNOWN.fullmatch(text):
            # A gap between words is a piece of its own, of which only its end is left: a rank that nothing else comes to.
            ranks = np.asarray(self.ranked.encode_to_numpy("\0 ".join(_PIECE.findall(text.lower())) + "\0"))
            stop = np.append(np.flatnonzero(ranks == self.gap), len(ranks))
            return self.ids[ranks], np.append(0, stop[:-1] + 1), stop
        known = np.array([self.ranked is not None and "<|" not in s and bool(_KNOWN.fullmatch(s)) for s in text.split(" ")])
        own = [np.array(self.tokenizer.encode(words[i].decode(), add_special_tokens=False).ids, "<u4") for i in np.flatnonzero(~known)]
        ids, start, stop = self._told([words[i] for i in np.flatnonzero(known)]) if known.any() else (self.pool[:0], self.start[:0], self.start[:0])
        starts, stops = np.zeros((2, len(words)), np.int64)
        starts[known], stops[known] = start, stop
        stops[~known] = len(ids) + np.cumsum([len(x) for x in own])
        starts[~known] = np.append(len(ids), stops[~known][:-1])
        return np.concatenate([ids, *own]), starts, stops

    def _coded(self, block: Block, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the block's words from lo to hi, how many each has)."""
        once, first, at = np.unique(block.hash[lo:hi], return_index=True, return_inverse=True)
        place = np.searchsorted(self.keys, once)
        new = place == len(self.keys)
        new[~new] = self.keys[place[~new]] != once[~new]
        if new.any():
            if len(self.keys) > self.limit:
                self._anew()
                new[:], place[:] = True, 0
            ids, start, stop = self._told([block.word(lo + i) for i in first[new].tolist()])
            for name, x in (("keys", once[new]), ("start", start + len(self.pool)), ("length", stop - start)):
                setattr(self, name, np.insert(getattr(self, name), place[new], x))
            self.pool = np.concatenate([self.pool, ids])
            place += np.cumsum(new) - new
        place = place[at]
        n = self.length[place]
        before = np.cumsum(n) - n
        return self.pool[np.repeat(self.start[place] - before, n) + np.arange(n.sum())], n

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """PART words at a time, so that the cache stays near its limit."""
        out: list[bytes] = []
        for _, _, block in blocks(((t or "").encode() for t in texts), lower=False):
            parts = [self._coded(block, lo, min(lo + PART, len(block.hash))) for lo in range(0, len(block.hash), PART)]
            raw = b"".join(ids.tobytes() for ids, _ in parts)
            ends = 4 * np.cumsum(np.concatenate([[0], *(n for _, n in parts)]))[block.first]
            out += [raw[i:j] for i, j in itertools.pairwise(ends.tolist())]
        return out


_CODERS: dict[str, WordCoder] = {}


def coder(path: str | None = None) -> WordCoder:
    """This Python worker's coder for a tokenizer file; None: the public file."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    if path not in _CODERS:
        _CODERS[path] = WordCoder(path)
        trim(0)  # the file's tables take much more than the coder keeps
    return _CODERS[path]
