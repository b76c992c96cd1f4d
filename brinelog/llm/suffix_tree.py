"""Language-model scoring with a probabilistic suffix tree.

Symbols are words (lower-cased A-Z) and one end per text. The tree's root has every training word; deeper states are
contexts of one to DEPTH words or the begin of a text. Contexts, their entries and the words in them need evidence, LEAST
occurrences at every size, so the tree grows with the corpus. It is a table and never gathered in one place. A context is
retained if its next-symbol distribution diverges from its parent's by more than the entries' worth (n * KL over half
of ln n per entry). A word is scored by its longest suffix state; each state takes a discount from its counts and gives
the freed mass to its parent. Words with fewer occurrences share one symbol in deeper states. Words never seen in training
are one symbol, as in the smoothed unigram beside which the score stands; it has the mass that the root's discounts free.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, freed, lean, stored, tidy
from .words import Block, blocks, mix

#: Least count in training texts of a context, of an entry, and of a word that deeper states tell from others.
LEAST = 50
#: Words of the longest contexts.
DEPTH = 4
DISCOUNT = 0.75
END = 0x656E64
#: In deeper states: words without enough evidence, and the begin of a text.
RARE, BEGIN = 0x72617265, 0x626567696E
_STEP = np.uint64(0xD1342543DE82EF95)
_INVERSE = np.uint64(pow(int(_STEP), -1, 2**64))
_POWERS = np.array([pow(int(_STEP), k, 2**64) for k in range(DEPTH + 1)], np.uint64)
_HALF, _LOW = np.uint64(32), np.uint64(0xFFFFFFFF)
#: Rows that a task gathers before it sums them up.
_MERGE = 1 << 20
#: What a chunk sends of a range: grams as arrays, or slots.
SENT = "range int, chunk long, n int, keys binary, symbols binary, words binary, counts binary, depths binary, slots binary, fills binary"
_ZSTD = pa.Codec("zstd", compression_level=1)


def sequence(b: Block, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """(symbol, text) of all tokens of a block, each text's end included."""
    sizes = np.diff(b.first) + 1
    doc = np.repeat(np.arange(n_docs), sizes)
    out = np.full(len(doc), END, np.uint64)
    inner = np.ones(len(doc), bool)
    inner[np.cumsum(sizes) - 1] = False
    out[inner] = b.hash
    return out, doc


def _starts(key: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin."""
    return np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)


def _total(keys: list[np.ndarray], values: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    k, v = np.concatenate(keys), np.concatenate(values).astype(np.int64)
    order = np.argsort(k)
    k = k[order]
    start = _starts(k)
    return k[start], np.add.reduceat(v[order], start) if len(start) else v


def vocabulary(docs: DataFrame) -> DataFrame:
    """(h, c, chunks) of docs (text, train, chunk): each symbol's count in training texts, and the chunks that hold it."""

    def run(batches):
        held: dict[int, list] = {}
        size = 0
        for batch in batches:
            texts, train, chunks = batch.column(0).to_pylist(), batch.column(1).to_numpy(zero_copy_only=False), batch.column(2).to_numpy()
            edges = np.flatnonzero(np.concatenate([[True], chunks[1:] != chunks[:-1], [True]]))
            for a, e in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                for lo, hi, b in blocks(texts[a:e], 1 << 20):
                    symbol, doc = sequence(b, hi - lo)
                    held.setdefault(int(chunks[a]), []).append(_total([symbol], [train[a + lo : a + hi][doc]]))
                    size += len(held[int(chunks[a])][-1][0])
            if size > _MERGE:
                held = {k: [_total(*map(list, zip(*x, strict=True)))] if len(x) > 1 else x for k, x in held.items()}
                size = 0
        for k, x in held.items():
            h, c = _total(*map(list, zip(*x, strict=True)))
            for lo in range(0, len(h), 1 << 17):
                part = slice(lo, lo + (1 << 17))
                yield pa.RecordBatch.from_arrays([pa.array(h[part].view(np.int64)), pa.array(c[part]), pa.array(np.full(len(h[part]), k))], names=["h", "c", "chunk"])

    rows = docs.select("text", "train", "chunk").mapInArrow(tidy(run), "h long, c long, chunk long")
    return rows.groupBy("h").agg(F.sum("c").alias("c"), F.collect_list("chunk").alias("chunks"))


@dataclass(frozen=True)
class Root:
    """The tree's root. least: occurrences that are evidence enough in deeper states; rare: what all symbols with fewer have together."""

    tokens: int
    least: int
    distinct: int
    discount: float
    rare: float

    def probability(self, c: np.ndarray) -> np.ndarray:
        """Probabilities of symbols with counts c; 0 stands for the one symbol of all words unseen in training."""
        n = max(self.tokens, 1)
        return np.where(c > 0, (c - self.discount) / n, self.discount * self.distinct / n if self.tokens else 1.0)


def train_root(vocab: DataFrame) -> Root:
    seen = vocab.where("c > 0")
    n = seen.agg(F.sum("c")).first()[0] or 0
    often = F.col("c") >= LEAST
    s = seen.agg(F.count(F.lit(1)).alias("v"), F.count_if(F.col("c") == 1).alias("a"), F.count_if(F.col("c") == 2).alias("b"), F.sum(F.when(often, F.col("c"))).alias("often"), F.count_if(often).alias("k")).first()
    discount = min(0.95, max(0.1, s["a"] / max(s["a"] + 2 * s["b"], 1)))
    return Root(n, LEAST, s["v"], discount, max(1 - ((s["often"] or 0) - discount * s["k"]) / max(n, 1), 1e-9))


def codes(symbol: np.ndarray, c: np.ndarray, least: int) -> np.ndarray:
    return np.where(c >= least, symbol, np.uint64(RARE))


def contexts(code: np.ndarray, doc: np.ndarray):
    """(tokens, state, word) by depth: the tokens that have a context of so many words, its hash, and its word that is farthest from the token."""
    begin = np.ones(len(doc), bool)
    begin[1:] = doc[1:] != doc[:-1]
    place = np.arange(len(doc)) - np.maximum.accumulate(np.where(begin, np.arange(len(doc)), 0))
    mixed, first = mix(code) * _STEP, mix(np.array([BEGIN], np.uint64)) * _STEP
    at, state, factor = np.arange(len(doc)), np.zeros(len(doc), np.uint64), np.uint64(1)
    for depth in range(1, DEPTH + 1):
        on = place[at] >= depth - 1
        at, state = at[on], state[on]
        inner = place[at] >= depth
        word = np.where(inner, code[at - depth], np.uint64(BEGIN))
        on = word != RARE
        own = np.where(inner, mixed[at - depth], first)
        at, word, state = at[on], word[on], state[on] + factor * own[on]
        factor = factor * _STEP
        yield at, state, word


def pair(state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
    """Hash of a context and the symbol behind it, which is the state of both as a context: a polynomial over the words' hashes."""
    return (state + mix(symbol)) * _STEP


def unpaired(depth: np.ndarray, key: np.ndarray, symbol: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(state, parent) of a pair's hash: that of its context, and that of the context but for its farthest word."""
    state = key * _INVERSE - mix(symbol)
    return state, state - mix(word) * _POWERS[depth]


class Lookup:
    """Values by 64-bit keys; the last dictionary of a chunk. Keys are in order; a table of their high bits tells where to begin to look."""

    def __init__(self, keys: list[np.ndarray], values: list[np.ndarray]):
        k, v = (np.concatenate(x) if x else np.zeros(0, t) for x, t in ((keys, np.uint64), (values, np.float64)))
        k = k * _STEP  # odd, so keys stay apart; spreads low bits to the high ones
        order = np.argsort(k)
        self.size, self.shift = len(k), np.uint64(64 - max(len(k).bit_length(), 1))
        self.first = np.searchsorted(k[order], np.arange(1 << (64 - int(self.shift)), dtype=np.uint64) << self.shift).astype(np.int32)
        self.keys, self.values = np.append(k[order], np.uint64(2**64 - 1)), np.append(v[order], 0.0)

    def __call__(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(found, value or 0)"""
        k = keys * _STEP
        at = self.first[(k >> self.shift).astype(np.int64)]
        on = np.flatnonzero(self.keys[at] < k)
        while len(on):
            at[on] += 1
            on = on[self.keys[at[on]] < k[on]]
        found = (self.keys[at] == k) & (at < self.size)
        return found, np.where(found, self.values[at], 0.0)


#: Kinds of rows that are dealt to chunks, in this order; texts are the last.
WORD, STATE, ENTRY, TEXT = range(4)


def parcels(told: DataFrame) -> DataFrame:
    """(chunk, kind, keys, values) of told (kind, h, g, v, chunks): what each chunk is to know, as arrays in few rows."""

    def run(batches):
        held, size = [], 0

        def given():
            chunk, kind, key, v = (np.concatenate(x) for x in zip(*held, strict=True))
            names, at = np.unique(chunk, return_inverse=True)
            group = at * TEXT + kind
            order = np.argsort(group)
            group, key, v = group[order], key[order], v[order]
            start = _starts(group)
            cuts = list(zip(start.tolist(), [*start[1:].tolist(), len(group)], strict=True))
            columns = [pa.array(names[group[start] // TEXT]), pa.array((group[start] % TEXT).astype(np.int32)), pa.array([key[a:e].tobytes() for a, e in cuts], pa.binary()), pa.array([v[a:e].tobytes() for a, e in cuts], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, names=["chunk", "kind", "keys", "values"])

        for batch in batches:
            kind, h, g, v = (batch.column(k).to_numpy() for k in range(4))
            h, chunks = h.view(np.uint64), batch.column(4)
            key = np.where(kind == ENTRY, pair(h, g.view(np.uint64)), h)
            sizes = chunks.value_lengths().to_numpy(zero_copy_only=False)
            for lo in range(0, len(key), 1000):  # a frequent one is told to every chunk
                part = slice(lo, lo + 1000)
                held.append((chunks.slice(lo, 1000).flatten().to_numpy(), *(np.repeat(x[part], sizes[part]) for x in (kind, key, v))))
                size += len(held[-1][0])
                if size > _MERGE:
                    yield given()
                    held, size = [], 0
        if size:
            yield given()

    return told.select("kind", "h", "g", "v", "chunks").mapInArrow(tidy(run), "chunk long, kind int, keys binary, values binary")


def dealt(parts: list[DataFrame], rows: DataFrame, slots: DataFrame | None = None) -> DataFrame:
    """Texts of rows and what parts (kind, h, g, v, chunks) and slots (chunk, slots) know of them, a chunk together, its texts last."""
    told = parts[0]
    for part in parts[1:]:
        told = told.unionByName(part)
    none = F.lit(None).cast("binary")
    texts = rows.select("chunk", F.lit(TEXT).alias("kind"), none.alias("keys"), none.alias("values"), "doc_id", "text", "train")
    told = parcels(told)
    if slots is not None:
        told = told.unionByName(slots.select("chunk", F.lit(STATE).alias("kind"), F.col("slots").alias("keys"), none.alias("values")))
    told = told.select("*", F.lit(None).cast("long").alias("doc_id"), none.alias("text"), F.lit(False).alias("train"))
    return told.unionByName(texts).repartition("chunk").sortWithinPartitions("chunk", "kind")


def _known(keys: bytes, values: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    """Keys and values of a row; keys without values are slots."""
    if values is None:
        k = np.frombuffer(keys, "<u4").astype(np.uint64)
        return k, np.zeros(len(k))
    return np.frombuffer(keys, np.uint64), np.frombuffer(values, np.float64)


def with_lookups(batches):
    """(chunk, lookups by kind, rows with texts) of dealt rows."""
    now, parts, tables = None, {}, None
    for batch in batches:
        chunk, kind = (batch.column(k).to_numpy() for k in range(2))
        edges = np.flatnonzero(np.concatenate([[True], (chunk[1:] != chunk[:-1]) | (kind[1:] != kind[:-1]), [True]]))
        for a, e in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            if chunk[a] != now:
                now, parts, tables = chunk[a], {}, None
            if kind[a] != TEXT:
                keys, values = (batch.column(k).slice(a, e - a).to_pylist() for k in (2, 3))
                parts.setdefault(int(kind[a]), []).extend(_known(k, v) for k, v in zip(keys, values, strict=True))
                continue
            if tables is None:
                tables = [Lookup(*map(list, zip(*parts.get(k, []), strict=True))) if k in parts else Lookup([], []) for k in (WORD, STATE, ENTRY)]
                parts = {}
            yield int(chunk[a]), tables, batch.slice(a, e - a)


def squeezed(x: np.ndarray) -> bytes:
    return _ZSTD.compress(np.ascontiguousarray(x).tobytes(), asbytes=True)


def spread(x: bytes, n: int, kind: type) -> np.ndarray:
    return np.frombuffer(_ZSTD.decompress(x, n * np.dtype(kind).itemsize, asbytes=True), kind)


def planes(x: np.ndarray) -> np.ndarray:
    """The bytes of x, all first ones before all second ones, so that those which are alike stand together."""
    return x.view(np.uint8).reshape(len(x), -1).T


def unplanes(x: bytes, n: int, kind: type) -> np.ndarray:
    return np.ascontiguousarray(spread(x, n * np.dtype(kind).itemsize, np.uint8).reshape(-1, n).T).view(kind).ravel()


def _reach(least: int):
    """What becomes of all that chunks sent of a range: the grams with least occurrences or more, and for each chunk its slots that are filled so often."""

    def reach(table: pa.Table) -> pa.Table:
        chunks = table["chunk"].to_numpy()
        none = table["slots"].is_null().to_numpy()
        columns = table.filter(pa.array(none))
        sizes = columns["n"].to_pylist()
        several = lambda name, f: np.concatenate([np.zeros(0, np.uint64), *(f(x, n) for x, n in zip(columns[name].to_pylist(), sizes, strict=True))])
        key = several("keys", lambda x, n: np.cumsum(unplanes(x, n, np.uint64), dtype=np.uint64))
        symbol, word = (several(name, lambda x, n: spread(x, n, np.uint64)) for name in ("symbols", "words"))
        c = several("counts", lambda x, n: unplanes(x, n, np.uint32).astype(np.uint64)).astype(np.int64)
        depth = several("depths", lambda x, n: spread(x, n, np.uint8).astype(np.uint64)).astype(np.int64)
        chunk = np.repeat(chunks[none], sizes)
        order = np.argsort(key)
        start = _starts(key[order])
        total = np.add.reduceat(c[order], start) if len(start) else np.zeros(0, np.int64)
        ok = total >= least
        sizes = np.diff(np.append(start, len(order)))
        first, holders = order[start[ok]], chunk[order][np.repeat(ok, sizes)]
        ends = np.concatenate([[0], np.cumsum(sizes[ok])])
        state, parent = unpaired(depth[first], key[first], symbol[first], word[first])

        columns = table.filter(pa.array(~none))
        slot, own = reached(columns["slots"].to_pylist(), columns["fills"].to_pylist(), chunks[~none].tolist(), least)
        order = np.argsort(own, kind="stable")
        slot, own = slot[order], own[order]
        cuts = [*_starts(own).tolist(), len(own)]
        told = [np.unique(slot[a:e]).astype("<u4").tobytes() for a, e in zip(cuts[:-1], cuts[1:], strict=True)]

        k, m = len(first), len(told)
        numbers = [np.concatenate([x, np.zeros(m, np.int64)]) for x in (depth[first], key[first].view(np.int64), state.view(np.int64), symbol[first].view(np.int64), parent.view(np.int64), total[ok])]
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([ends, np.full(m, ends[-1])]).astype(np.int32)), pa.array(holders))
        chunk = pa.array(np.concatenate([np.zeros(k, np.int64), own[cuts[:-1]]]))
        return pa.table([*map(pa.array, numbers), lists, chunk, pa.array([None] * k + told, pa.binary())], names=FOUND_NAMES)

    return reach


FOUND = "depth long, key long, state long, symbol long, parent long, c long, chunks array<long>, chunk long, slots binary"
FOUND_NAMES = [x.split()[0] for x in FOUND.split(", ")]


def _often(counted: DataFrame, least: int) -> DataFrame:
    """(depth, key, state, symbol, parent, c, chunks) of the grams with least occurrences or more in all of counted (SENT), and with depth 0 (chunk, slots):
    a chunk's slots of a range, as four bytes each, that are filled least times.

    Hardly any two grams of a task are one, so there is nothing to gain by summing before they are dealt.
    """
    return counted.groupBy("range").applyInArrow(_reach(least), FOUND).withColumn("chunks", F.array_distinct("chunks"))


def _sent(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, _SENT)


_SENT = pa.schema([(n, {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}[t]) for n, t in (x.split() for x in SENT.split(", "))])


def range_bits(tokens: int) -> int:
    """Slots are summed by range, a range of a few million tokens."""
    return min(max(6, (tokens >> 22).bit_length()), 16)


def _merged(parts: list[np.ndarray]) -> np.ndarray:
    """parts, of slots in the high 32 bits and counts in the low ones, as one in order of slots, with each slot once."""
    x = np.concatenate(parts)
    x.sort()
    start = _starts(x >> _HALF)
    return x[start] & ~_LOW | np.add.reduceat(x & _LOW, start) if len(start) else x


def packed(held: list[np.ndarray], bits: int, least: int):
    """(range, slots, counts) of sorted 32-bit slots as bytes; counts stop at least."""
    x = _merged(held)
    cuts = np.searchsorted(x, np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits)).tolist()
    kind = np.uint8 if least < 256 else np.uint32
    for r, (a, e) in enumerate(zip(cuts, [*cuts[1:], len(x)], strict=True)):
        if a < e:
            yield r, (x[a:e] >> _HALF).astype("<u4").tobytes(), np.minimum(x[a:e] & _LOW, np.uint64(least)).astype(kind).tobytes()


def reached(slots: list[bytes], counts: list[bytes], chunks: list[int], least: int) -> tuple[np.ndarray, np.ndarray]:
    """(slot, chunk) of the slots of a range that reach least in all, for each chunk that holds them."""
    slot = np.frombuffer(b"".join(slots), "<u4").astype(np.int64)
    n = np.frombuffer(b"".join(counts), np.uint8 if least < 256 else np.uint32)
    _, at = np.unique(slot, return_inverse=True)
    ok = np.bincount(at, weights=n)[at] >= least
    return slot[ok], np.repeat(np.array(chunks, np.int64), [len(x) // 4 for x in slots])[ok]


class Slots:
    """What a chunk fills slots with; sums up now and then."""

    def __init__(self):
        self.held, self.size = [], 0

    def add(self, slot: np.ndarray, weight: np.ndarray) -> bool:
        """Slots with a weight of 0 or 1 each. True if there are so many by now that they should be given away."""
        x = slot.astype(np.uint64) << _HALF | weight.astype(np.uint64)
        if len(x):
            self.held.append(_merged([x]))
            self.size += len(self.held[-1])
        if not self.held:
            return False
        if self.size > _MERGE:
            self.held = [_merged(self.held)]
            self.size = len(self.held[0]) // 2
        return len(self.held[0]) > 2 * _MERGE

    def given(self, bits: int, least: int):
        out = list(packed(self.held, bits, least)) if self.held else []
        self.held, self.size = [], 0
        return out


def slots_of_pairs(docs: DataFrame, least: int, tokens: int) -> DataFrame:
    """(chunk, slots) of the 32-bit slots, into which pairs of a word and the next one are hashed, that training texts fill least times or more.

    A pair with so many occurrences is in such a slot, and each chunk that holds it, if only in texts that don't train, is told the
    slot, so no frequent pair is lost; of the others, most are seen here only, as four bytes and a count each. A chunk is told of a range's
    slots in one row of four bytes a slot, so it is never told more than it has sent.
    """
    bits = range_bits(tokens)

    def gather(batches):
        own, now = Slots(), None

        def done():
            return _sent([{"range": r, "chunk": now, "slots": x, "fills": n} for r, x, n in own.given(bits, least)])

        for batch in batches:
            texts, train, chunks = batch.column(0).to_pylist(), batch.column(1).to_numpy(zero_copy_only=False), batch.column(2).to_numpy()
            edges = np.flatnonzero(np.concatenate([[True], chunks[1:] != chunks[:-1], [True]]))
            for a, e in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                if chunks[a] != now:
                    if own.held:
                        yield done()
                    now = int(chunks[a])
                for lo, hi, b in blocks(texts[a:e], 1 << 20):
                    symbol, doc = sequence(b, hi - lo)
                    at, state, _ = next(iter(contexts(symbol, doc)))
                    if own.add(_slot(pair(state, symbol[at])), train[a + lo : a + hi][doc[at]]):
                        yield done()
        if own.held:
            yield done()

    rows = docs.select("text", "train", "chunk").mapInArrow(tidy(gather), SENT)
    return rows.groupBy("range").applyInArrow(_reach(least), FOUND).select("chunk", "slots")


def filled_slots(docs: DataFrame, least: int, tokens: int) -> DataFrame:
    """(chunk, slot) of slots_of_pairs, a row for each, to look at."""

    def run(batches):
        for batch in batches:
            slots = [np.frombuffer(x, "<u4").astype(np.int64) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column(0).to_numpy(), [len(x) for x in slots])), pa.array(np.concatenate([np.zeros(0, np.int64), *slots]))], names=["chunk", "slot"])

    return slots_of_pairs(docs, least, tokens).mapInArrow(run, "chunk long, slot long")


def _slot(key: np.ndarray) -> np.ndarray:
    return (key & np.uint64(0xFFFFFFFF)).astype(np.int64)


def grams(rows: DataFrame, parts: list[DataFrame], slots: DataFrame, longer: bool, root: Root) -> DataFrame:
    """(depth, key, state, symbol, parent, c, chunks) of contexts of depth words with a symbol behind them that occur least times or more in training texts.

    Contexts have one word, and slots are those that frequent pairs are in; then the slots (chunk, slots) that frequent longer grams are in
    come out too, with depth 0. Or if longer they have two to DEPTH words, parts have the pairs of words that were found, and slots are
    these; what has a pair in it that wasn't found, or isn't in such a slot, need not be counted. c: count in training texts; chunks:
    all that hold it. A context is a gram itself, of its words but the nearest and that one as symbol, so contexts aren't counted apart.
    """

    least, bits = root.least, range_bits(root.tokens)

    def summed(held):
        """The distinct grams of held with their counts, in order of their hashes, as a list of one."""
        depth, key, symbol, word, on = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.argsort(key)
        start = _starts(key[order])
        first = order[start]
        return [(depth[first], key[first], symbol[first], word[first], np.add.reduceat(on[order].astype(np.int64), start) if len(start) else on.astype(np.int64))]

    def emit(held, chunk):
        depth, key, symbol, word, c = summed(held)[0]
        cuts = np.searchsorted(key >> np.uint64(64 - bits), np.arange((1 << bits) + 1, dtype=np.uint64)).tolist()
        out = []
        for r, (a, e) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            if a < e:
                out.append({"range": r, "chunk": chunk, "n": e - a, "keys": squeezed(planes(np.diff(key[a:e], prepend=np.uint64(0)))), "symbols": squeezed(symbol[a:e]), "words": squeezed(word[a:e]), "counts": squeezed(planes(c[a:e].astype(np.uint32))), "depths": squeezed(depth[a:e])})
        for lo in range(0, len(out), 32):
            yield _sent(out[lo : lo + 32])

    def filling(deep, chunk):
        return _sent([{"range": r, "chunk": chunk, "slots": x, "fills": n} for r, x, n in deep.given(bits, least)])

    def run(batches):
        held, size, now, deep = [], 0, None, Slots()
        for chunk, (lexicon, filled, pairs), batch in with_lookups(batches):
            if held and chunk != now:
                yield from emit(held, now)
                held, size = [], 0
            if deep.held and chunk != now:
                yield filling(deep, now)
            now, train = chunk, batch.column(6).to_numpy(zero_copy_only=False)
            for lo, hi, b in blocks(batch.column(5).to_pylist()):
                symbol, doc = sequence(b, hi - lo)
                code, on = codes(symbol, lexicon(symbol)[1], least), train[lo:hi][doc]
                follows, ok = np.zeros(len(code), bool), np.ones(len(code), bool)
                for depth, (at, state, word) in enumerate(contexts(code, doc), 1):
                    key = pair(state, code[at])
                    if depth == 1:
                        follows[at] = pairs(key)[0] if longer else (code[at] == RARE) | filled(_slot(key).astype(np.uint64))[0]
                        k = follows[at]
                    else:
                        ok[at] &= follows[at - depth + 1]
                        k = ok[at] & follows[at]
                        if longer:
                            k[k] = filled(_slot(key[k]).astype(np.uint64))[0]
                        elif deep.add(_slot(key[k]), on[at[k]]):
                            yield filling(deep, now)
                    if longer == (depth > 1):
                        held.append((np.full(k.sum(), depth, np.uint8), key[k], code[at[k]], word[k], on[at[k]]))
                        size += len(held[-1][0])
                if size > _MERGE:
                    held = summed(held)
                    size = len(held[0][0]) // 2  # what is summed already is worked on again as new rows come in
                    if len(held[0][0]) > 3 * _MERGE // 2:
                        yield from emit(held, now)
                        held, size = [], 0
        if held:
            yield from emit(held, now)
        if deep.held:
            yield filling(deep, now)

    return _often(dealt(parts, rows, slots).mapInArrow(tidy(run), SENT), least)


def words_as_contexts(vocab: DataFrame, least: int) -> DataFrame:
    """(state, n, holders) of contexts of one word, or of a text's begin, which is as often as its end."""

    def run(batches):
        for batch in batches:
            h = batch.column(0).to_numpy().view(np.uint64)
            state = mix(np.where(h == END, np.uint64(BEGIN), h)) * _STEP
            yield pa.RecordBatch.from_arrays([pa.array(state.view(np.int64)), batch.column(1), batch.column(2)], names=["state", "n", "holders"])

    return vocab.where(F.col("c") >= least).select("h", "c", "chunks").mapInArrow(run, "state long, n long, holders array<long>")


def states(found: DataFrame, vocab: DataFrame, root: Root) -> list[DataFrame]:
    """Rows for dealt(): retained states with the mass they leave, and their entries with probabilities.

    An entry's probability has its parent's share in it. An entry's parent has an entry of the same symbol, as it occurs
    no less often, so levels are joined one after the other.
    """
    spark, n = vocab.sparkSession, max(root.tokens, 1)
    rare = spark.range(1).select(F.lit(0).cast("long").alias("parent"), F.lit(RARE).cast("long").alias("symbol"), F.lit(root.rare).alias("q"))  # not from a Python list, which starts more workers
    above = vocab.where(F.col("c") >= root.least).select(F.lit(0).cast("long").alias("parent"), F.col("h").alias("symbol"), ((F.col("c") - root.discount) / n).alias("q")).unionByName(rare)
    out = []
    for depth in range(1, DEPTH + 1):
        known = words_as_contexts(vocab, root.least) if depth == 1 else found.where(F.col("depth") == depth - 1).select(F.col("key").alias("state"), F.col("c").alias("n"), F.col("chunks").alias("holders"))
        entries = found.where(F.col("depth") == depth).select("state", "symbol", "parent", "c", "chunks")
        e = stored(entries.join(known.drop("holders"), "state").join(above, ["parent", "symbol"]), "entries")
        s = e.groupBy("state").agg(F.first("n").alias("m"), F.count(F.lit(1)).alias("k"), F.sum("c").alias("sc"), F.sum("q").alias("sq"), F.sum(F.col("c") * F.log(F.col("c") / F.col("n") / F.col("q"))).alias("g"))
        rest, rest_q = F.greatest(1 - F.col("sc") / F.col("m"), F.lit(0.0)), F.greatest(1 - F.col("sq"), F.lit(1e-9))
        gain = F.col("g") + F.when(rest > 0, F.col("m") * rest * F.log(rest / rest_q)).otherwise(0.0)
        s = s.where(gain > 0.5 * F.log("m") * (F.col("k") + 1)).select("state", (1 - (F.col("sc") - DISCOUNT * F.col("k")) / F.col("m")).alias("left"))
        s = stored(s, "states")
        p = F.when(F.col("left").isNull(), F.col("q")).otherwise((F.col("c") - DISCOUNT) / F.col("n") + F.col("left") * F.col("q"))
        e = stored(e.join(s, "state", "left").select("state", "symbol", p.alias("p"), F.col("left").isNotNull().alias("kept"), "chunks"), "level")
        above = e.select(F.col("state").alias("parent"), "symbol", F.col("p").alias("q"))
        out.append(known.join(s, "state").select(F.col("holders").alias("chunks"), F.lit(STATE).alias("kind"), F.col("state").alias("h"), F.lit(0).cast("long").alias("g"), F.col("left").alias("v")))
        out.append(e.where("kept").select("chunks", F.lit(ENTRY).alias("kind"), F.col("state").alias("h"), F.col("symbol").alias("g"), F.col("p").alias("v")))
    return out


SCHEMA = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score_documents(docs: DataFrame, fold: int = 1, folds: int = 5, chunk: Column | None = None) -> DataFrame:
    """Scores of docs (doc_id, text) by a tree that learns from those outside the held-out fold (crc32 of doc_id modulo folds).

    base_score: the smoothed unigram's log10 probability of the text; score: the tree's. A chunk is a set of
    documents that are scored with one dictionary, of the counts of just its words; by default a hash of doc_id makes chunks of
    about 16,000. chunk should be the same whenever docs is read, such as one input split. Cases: null text is empty, which is
    one end; null doc_id counts as an empty id; without training texts every word is new; repeated rows count each; an empty
    table gives no rows; more columns are left out.
    """
    if chunk is None:
        chunk = F.pmod(F.xxhash64("doc_id"), F.lit(docs.count() // 16_000 + 1))
    rows = lean(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).cast("binary").alias("text"), (crc_mod("doc_id", folds) != fold).alias("train"), chunk.cast("long").alias("chunk"))
    vocab = freed(stored(vocabulary(rows), "vocabulary"), settled=True)
    root = train_root(vocab)
    words = vocab.select("chunks", F.lit(WORD).alias("kind"), "h", F.lit(0).cast("long").alias("g"), F.col("c").cast("double").alias("v"))
    often = words.where(F.col("v") >= root.least)
    filled = freed(stored(slots_of_pairs(rows, root.least, root.tokens), "slots"), settled=True)
    first = freed(stored(grams(rows, [often], filled, False, root), "pairs"), settled=True)
    pairs, deep = first.where("depth > 0"), first.where("depth = 0").select("chunk", "slots")
    known = pairs.select("chunks", F.lit(ENTRY).alias("kind"), F.col("state").alias("h"), F.col("symbol").alias("g"), F.lit(0.0).alias("v"))
    found = freed(pairs.unionByName(stored(grams(rows, [often, known], deep, True, root), "grams")), settled=True)
    parts = [words, *states(found, vocab, root)]

    def run(batches):
        for _, tables, batch in with_lookups(batches):
            yield score(tables, batch)

    def score(tables, batch):
        lexicon, left, entry = tables
        out = [[], [], [], []]
        for lo, hi, b in blocks(batch.column(5).to_pylist()):
            symbol, doc = sequence(b, hi - lo)
            c = lexicon(symbol)[1]
            base = np.log10((c + 0.5) / (root.tokens + 0.5 * (root.distinct + 1)))
            p, code = root.probability(c), codes(symbol, c, root.least)
            share = np.where(code == RARE, p / root.rare, 1.0)
            for at, state, _ in contexts(code, doc):
                kept, freed = left(state)
                at, state, freed = at[kept], state[kept], freed[kept]
                found, own = entry(pair(state, code[at]))
                p[at] = np.where(found, own * share[at], freed * p[at])
            p = np.log10(p)
            n = hi - lo
            for column, x in zip(out, (np.bincount(doc, minlength=n), np.bincount(doc, weights=c > 0, minlength=n).astype(np.int64), np.bincount(doc, weights=base, minlength=n), np.bincount(doc, weights=p, minlength=n)), strict=True):
                column.append(x)
        n_tokens, n_known, base, own = (np.concatenate(x) for x in out)
        held = ~batch.column(6).to_numpy(zero_copy_only=False)
        columns = [batch.column(4), pa.array(held), pa.array(n_tokens), pa.array(n_known), pa.array(np.full(len(held), root.tokens)), pa.array(base), pa.array(own)]
        return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in SCHEMA.split(", ")])

    return dealt(parts, rows).mapInArrow(tidy(run), SCHEMA)


def op5_lm_scoring(spark, sf_dir: str) -> DataFrame:
    """All documents, in chunks that are the splits of the input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score_documents(docs, chunk=F.xxhash64(F.input_file_name(), F.input_file_block_start()))
