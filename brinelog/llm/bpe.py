"""Byte-level BPE: texts to ids by a priority queue of merges over a linked list of symbols, and ids back to text.

A text is cut into words as the tokenizer file says, a word's bytes are its first symbols. Each pair of neighbours that merges is
in a queue, by rank, then place. The least is taken, unless one of its symbols has gone or changed since (a stale entry, which is
skipped); it becomes one symbol, its neighbours are linked to it, and the two new pairs are queued. A word of n bytes takes
O(n log n). Words come again and again, so each worker keeps what it has merged, up to a limit after which it starts anew.

Ids are decoded by putting together the vocabulary's strings, as bytes, and reading these as UTF-8.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .tokens import _byte_letters

#: How byte-level files cut words (fixed value).
CUT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words kept by a worker; texts of a batch of results; bytes over which a word is cut where no token reaches across.
KEPT, TEXTS, LONG = 200_000, 256, 4096


def _known() -> str:
    """A pattern for characters on whose kind (letter, number, space, other) all versions of Unicode since 3.2 agree.

    The library that made the files knows fewer letters than newer tables; texts with other characters are cut by it.
    """
    old, runs = unicodedata.ucd_3_2_0, []
    for c in range(0x110000):
        first, now = old.category(chr(c)), unicodedata.category(chr(c))
        if first not in ("Cn", "Cs") and (first[0] in "LN" and first[0] or first[0] == "Z") == (now[0] in "LN" and now[0] or now[0] == "Z"):
            if runs and runs[-1][1] == c - 1:
                runs[-1][1] = c
            else:
                runs.append([c, c])
    return "".join(f"\\U{a:08x}-\\U{e:08x}" for a, e in runs)


class ByteCoder:
    """Ids of texts by a tokenizer file, and texts of ids."""

    def __init__(self, path: str, kept: int = KEPT):
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        model, cut = told["model"], told["pre_tokenizer"]
        plain = model["type"] == "BPE" and told["normalizer"] is None and told["post_processor"] is None and not any(model.get(c) for c in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        plain = plain and cut["type"] == "ByteLevel" and cut["use_regex"] and not cut["add_prefix_space"] and told["decoder"]["type"] == "ByteLevel"
        added = told["added_tokens"]
        if not plain or any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in added):
            raise ValueError(f"{path} isn't a plain byte-level BPE file")
        letters = _byte_letters()
        vocab = model["vocab"]
        self.first = [vocab[c] for c in sorted(letters, key=letters.get)]
        pairs = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
        #: (left, right) to rank and id of what they become
        self.merges = {(vocab[a], vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in enumerate(pairs)}
        self.whole = {t["content"]: t["id"] for t in added}
        size = max([*vocab.values(), *self.whole.values()]) + 1
        self.strings: list[bytes | None] = [None] * size
        for token, i in vocab.items():
            self.strings[i] = bytes(letters[c] for c in token)
        for token, i in self.whole.items():
            self.strings[i] = token.encode()
        self.meets = np.zeros(1 << 16, bool)
        for a, b in self.merges:
            self.meets[self.strings[a][-1] << 8 | self.strings[b][0]] = True
        self.at_whole = regex.compile("|".join(map(regex.escape, sorted(self.whole, key=len, reverse=True)))) if self.whole else None
        self.cut, self.odd = regex.compile(CUT), regex.compile(f"[^{_known()}]")
        self.path, self.library = path, None
        self.kept, self.cache = kept, {}

    def merged(self, word: bytes) -> list[int]:
        """A word's ids."""
        if len(word) > LONG:
            b = np.frombuffer(word, np.uint8).astype(np.int64)
            apart = np.flatnonzero(~self.meets[b[:-1] << 8 | b[1:]]) + 1  # no merge ever joins these two bytes
            if len(apart):
                parts = np.split(np.frombuffer(word, np.uint8), apart)
                return [i for p in parts for i in self._queued(p.tobytes())]
        return self._queued(word)

    def _queued(self, word: bytes) -> list[int]:
        merges, n = self.merges, len(word)
        symbols = [self.first[b] for b in word]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = []
        for at in range(n - 1):
            found = merges.get((symbols[at], symbols[at + 1]))
            if found:
                queue.append((found[0], at, found[1]))
        heapq.heapify(queue)
        while queue:
            _, at, made = heapq.heappop(queue)
            right = after[at]
            if symbols[at] < 0 or right >= n:
                continue
            found = merges.get((symbols[at], symbols[right]))
            if found is None or found[1] != made:  # stale: one of the two has been merged otherwise
                continue
            symbols[at], symbols[right] = made, -1
            nearest = after[at] = after[right]
            if nearest < n:
                before[nearest] = at
                found = merges.get((made, symbols[nearest]))
                if found:
                    heapq.heappush(queue, (found[0], at, found[1]))
            left = before[at]
            if left >= 0:
                found = merges.get((symbols[left], made))
                if found:
                    heapq.heappush(queue, (found[0], left, found[1]))
        return [s for s in symbols if s >= 0]

    def _words(self, text: str) -> list[str]:
        if text.isascii() or not self.odd.search(text):
            return self.cut.findall(text)
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.path).pre_tokenizer
        return [text[a:e] for _, (a, e) in self.library.pre_tokenize_str(text)]

    def _plain(self, text: str) -> bytes:
        """Ids, as little-endian 32-bit bytes, of a text without added tokens."""
        words, out = self._words(text), []
        for at in range(0, len(words), 1 << 16):
            part = words[at : at + (1 << 16)]
            found = list(map(self.cache.get, part))
            if None in found:
                if len(self.cache) > self.kept:
                    self.cache.clear()
                for w in part:
                    if w not in self.cache:
                        self.cache[w] = np.array(self.merged(w.encode()), "<i4").tobytes()
                found = map(self.cache.__getitem__, part)
            out.append(b"".join(found))
        return b"".join(out)

    def encode(self, text: str) -> bytes:
        """Ids as little-endian 32-bit bytes. Added tokens are found first, at the leftmost place, the longest one there."""
        out, at = [], 0
        for m in self.at_whole.finditer(text) if self.at_whole else ():
            out += [self._plain(text[at : m.start()]), np.array([self.whole[m.group()]], "<i4").tobytes()]
            at = m.end()
        return b"".join([*out, self._plain(text[at:] if at else text)])

    def decode(self, ids: np.ndarray) -> str:
        """The vocabulary's strings one after another; ids that it doesn't have are left out, bytes that are no UTF-8 become U+FFFD."""
        known = self.strings
        return b"".join([s for i in ids.tolist() if 0 <= i < len(known) and (s := known[i]) is not None]).decode("utf-8", "replace")


_CODERS: dict[str, ByteCoder] = {}


def coder(path: str | None = None) -> ByteCoder:
    """This Python worker's coder for a tokenizer file; None: the public file."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    if path not in _CODERS:
        _CODERS[path] = ByteCoder(path)
        common.trim(0)
    return _CODERS[path]


def _over(df: DataFrame, source: str, name: str, kind: str, make) -> DataFrame:
    """df with a column name that make turns the source column's Arrow arrays, of at most TEXTS rows, into; one of that name is replaced."""
    kept = df.drop(name)
    given = source if source in kept.columns else common.spare("source", kept)
    names = kept.columns
    rows = kept if given == source else df.select(*kept.columns, F.col(source).alias(given))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS):
                part = batch.slice(at, TEXTS)
                yield pa.record_batch([*(part.column(c) for c in names), make(part.column(given))], names=[*names, name])

    return rows.mapInArrow(common.tidy(run), kept.withColumn(name, F.lit(None).cast(kind)).schema)


def encoded(df: DataFrame, text: str = "text", ids: str = "ids", path: str | None = None) -> DataFrame:
    """df with ids, an array of ints, of each whole text. A null or empty text has none. path: the tokenizer's file.

    Every row is worked on by itself, so repeated rows and extra columns come back as they are; a column named as ids is
    replaced. A word without any cut takes about 150 bytes of a worker's memory a byte.
    """

    def make(column: pa.Array) -> pa.Array:
        own = coder(path)
        found = [own.encode(t) if t else b"" for t in column.to_pylist()]
        ends = np.cumsum([0, *(len(b) // 4 for b in found)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(found), "<i4")))

    return _over(df, text, ids, "array<int>", make)


def decoded(df: DataFrame, ids: str = "ids", text: str = "text", path: str | None = None) -> DataFrame:
    """df with the text of each row's ids. Null or no ids: the empty text. Unknown ids are left out. A column named as text is replaced."""

    def make(column: pa.Array) -> pa.Array:
        own = coder(path)
        flat, sizes = column.flatten().fill_null(-1).to_numpy(), pc.list_value_length(column).fill_null(0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes)
        return pa.array([own.decode(flat[e - n : e]) for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)], pa.string())

    return _over(df, ids, text, "string", make)


def op12_bpe_coding(spark, sf_dir: str) -> DataFrame:
    rows = encoded(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    rows = decoded(rows, text="decoded")
    digest = F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256)
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), digest.alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
