"""N-gram Jaccard join by parity sketches, and the groups of near duplicates that its links make.

A document's set has its distinct shingles as 64-bit hashes. Sets A and B link when 100 |A n B| >= 75 |A u B|; then

* the smaller has at least 3/4 of the larger's shingles, and
* the symmetric difference has at most (|A| + |B|) / 7 of them, so at most n / 3 for either set's n.

Band by band of sizes, shingles are dealt into blocks by hash and a block keeps the XOR of its shingles' hashes: a
sketch in which every shingle of the symmetric difference changes one block. So of a set's blocks that aren't empty, at
most n / 3 differ from a linked set's. In a fixed order of blocks, each set gives its first n / 3 + t nonempty ones
as join keys, t = 1 + n / 32; of two linked sets the one whose keys reach less far shares at least t of them with the other,
so both share at least the smaller one's t. Shingles that very many documents have get blocks at the end of that order, so
common passages hardly become keys. A set with too few nonempty blocks gives all of them and a key that all such sets of its
band have, which counts for t.

Keys of few sets give narrow pairs, and those with t keys in common are candidates, so chance meetings of long texts end there.
Sets that meet in a key of many are candidates at once. A second sketch, of single bits, bounds the symmetric difference from
below (its Hamming distance); what passes is verified on the texts' shingles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import freed, lean, small, stored, tidy
from .graph import components
from .words import Block, blocks, mix

SHINGLE = 5
_U = np.uint64
_STEP = _U(0xD1342543DE82EF95)
#: Sizes of a band differ by so much; the next larger band's sets under 4/3 of its start join in it too.
RATIO = 4
LEAST_BLOCKS = 256
#: A shingle is common if at least this share of all documents have it. This changes only the order of keys.
COMMON = 0.002
MOST_COMMON = 100_000
#: Names of sets to be compared or verified, and of linked ones, are broadcast up to so many, counted first; beyond, the rows they are sought in are shuffled.
MOST_NAMED = 500_000
#: Keys that at most so many sets share give pairs, which are counted; the others' sets are compared by their sketches.
FEW = 24
#: Keys that more sets share than this are compared in chunks of this size, a pair of chunks at a time.
CHUNK = 2000
#: The shortest sketch.
LEAST_BITS = 1024
#: Bits of a key: few enough to move, and many enough that chance meetings stay rare in 10**13 keys; they only cost a comparison.
KEY = _U((1 << 48) - 1)
#: Every EXTRA-th shingle adds one more key to those that linked sets must have in common.
EXTRA = 32


def sets(b: Block, n_docs: int) -> list[np.ndarray]:
    """Each text's distinct shingle hashes, sorted. Fewer words than SHINGLE make one shingle; no words none."""
    w = b.hash
    out = []
    size = len(w) - SHINGLE + 1
    if size > 0:
        s = w[:size]
        for k in range(1, SHINGLE):
            s = s * _STEP + w[k : size + k]
        s = mix(s)
    for a, e in zip(b.first[:-1].tolist(), b.first[1:].tolist(), strict=True):
        if e - a >= SHINGLE:
            x = np.sort(s[a : e - SHINGLE + 1])
            out.append(x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) > 1 else x)
        elif e > a:
            x = w[a : a + 1] + _U(e - a)
            for k in range(a + 1, e):
                x = x * _STEP + w[k : k + 1]
            out.append(mix(x))
        else:
            out.append(w[:0])
    return out


def all_sets(texts: list[bytes | None]) -> Iterator[np.ndarray]:
    for lo, hi, b in blocks(texts):
        yield from sets(b, hi - lo)


def digest(x: np.ndarray) -> int:
    """A 64-bit name of a set: equal sets share it, others with a chance of 2**-64 a pair."""
    return int((np.bitwise_xor.reduce(mix(x + _U(1))) ^ mix(np.array([len(x)], _U))[0]).astype(np.int64)) if len(x) else 0


def bands(n: int) -> list[int]:
    """The bands in which a set of n shingles joins."""
    top = 0
    while RATIO ** (top + 1) <= n:
        top += 1
    return [top, top - 1] if top and 3 * n < 4 * RATIO**top else [top]


def _reach(band: int) -> int:
    return RATIO ** (band + 1) * 4 // 3


def _every(band: int) -> np.ndarray:
    """The key of all a band's sets that have too few nonempty blocks."""
    return mix(np.array([band + (1 << 50)], _U)) & KEY


def keys(x: np.ndarray, common: np.ndarray) -> np.ndarray:
    """Join keys of a set in all its bands; common: the common shingles' hashes, sorted."""
    n, out = len(x), []
    if len(common):
        at = np.minimum(np.searchsorted(common, x), len(common) - 1)
        late = common[at] == x
    else:
        late = np.zeros(n, bool)
    need = n // 3 + 1 + n // EXTRA
    for band in bands(n):
        p = max(_reach(band) // 2, LEAST_BLOCKS)
        block = ((x >> _U(33)) % _U(p)).astype(np.int64) + late * p
        order = np.argsort(block, kind="stable")
        block = block[order]
        start = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
        value = np.bitwise_xor.reduceat(x[order], start)[:need]
        k = mix(value ^ mix((block[start[:need]] | band << 40).astype(_U))) & KEY
        out.append(k)
        if len(start) < need:
            out.append(_every(band))
    return np.concatenate(out)


def sketch_bits(n: int) -> int:
    """A power of two that is at least twice a set's number of shingles, so that few changes fall on one bit and cancel out.

    Short sets get more, as their sketches are small anyway and near misses are what copies of one short text mostly are.
    """
    return max(LEAST_BITS, 1 << (2 * n - 1).bit_length())


def sketch(x: np.ndarray) -> bytes:
    """Parity of the shingles at each bit. Folding halves by XOR gives a shorter sketch."""
    m = sketch_bits(len(x))
    return np.packbits((np.bincount((x & _U(m - 1)).astype(np.int64), minlength=m) & 1).astype(np.uint8), bitorder="little").tobytes()


def fold(raw: bytes, size: int) -> np.ndarray:
    x = np.frombuffer(raw, np.uint64)
    return np.bitwise_xor.reduce(x.reshape(-1, size), axis=0)


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= 75 * (len(a) + len(b) - both) and both > 0


PROFILE = "doc_id long, text_hash long, n long, c long, common boolean, sketch binary"


def _profile(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, n, c, sketch) per document of docs (text, doc_id, text_hash); a set's sketch stands where its task meets it first.

    And rows with doc_id null, n the count, c the hash and common true for shingles common within a task.
    """
    names = [part.split()[0] for part in PROFILE.split(", ")]

    def run(batches):
        held, size, total, n_docs = [], 0, {}, 0
        seen: set[int] = set()

        def gather():
            u, k = np.unique(np.concatenate(held), return_counts=True)
            some = k >= 8
            for h, c in zip(u[some].tolist(), k[some].tolist(), strict=True):
                total[h] = total.get(h, 0) + c

        for batch in batches:
            ns, cs, ss = [], [], []
            for x in all_sets(batch.column(0).to_pylist()):
                c = digest(x)
                ns.append(len(x))
                cs.append(c)
                ss.append(sketch(x) if len(x) and c not in seen else None)
                seen.add(c)
                held.append(x)
                size += len(x)
                if size > 1 << 20:
                    gather()
                    held, size = [], 0
            n_docs += len(ns)
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(ns, pa.int64()), pa.array(cs, pa.int64()), pa.array([False] * len(ns)), pa.array(ss, pa.binary())], names=names)
        if held:
            gather()
        some = {h: c for h, c in total.items() if c >= max(32, 2 * COMMON * n_docs)}
        if some:
            none = pa.nulls(len(some), pa.int64())
            yield pa.RecordBatch.from_arrays([none, none, pa.array(list(some.values()), pa.int64()), pa.array(np.array(list(some), _U).view(np.int64)), pa.array([True] * len(some)), pa.nulls(len(some), pa.binary())], names=names)

    return docs.mapInArrow(tidy(run), PROFILE)


def _key_rows(docs: DataFrame, common: np.ndarray) -> DataFrame:
    """(key, c) of every set; a task gives a set that it meets again no second time."""

    def run(batches):
        seen: set[int] = set()
        for batch in batches:
            ks, cs, size = [], [], 0
            for x in all_sets(batch.column(0).to_pylist()):
                if not len(x) or (c := digest(x)) in seen:
                    continue
                seen.add(c)
                ks.append(keys(x, common))
                cs.append(c)
                size += len(ks[-1])
                if size > 1 << 17:
                    yield rows(ks, cs)
                    ks, cs, size = [], [], 0
            if ks:
                yield rows(ks, cs)

    def rows(ks, cs):
        sizes = [len(k) for k in ks]
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(ks).view(np.int64)), pa.array(np.repeat(np.array(cs, np.int64), sizes))], names=["key", "c"])

    return docs.select("text").mapInArrow(tidy(run), "key long, c long")


def _runs(rows: DataFrame) -> DataFrame:
    """(key, c) of keys that several sets share, each set once. rows sorted by key, c."""

    def run(batches):
        carry = None
        for batch in batches:
            k, c = (batch.column(i).to_numpy() for i in range(2))
            done = np.zeros(len(k), bool)
            if carry is not None:
                k, c, done = (np.concatenate(x) for x in zip(carry, (k, c, done), strict=True))
            fresh = np.ones(len(k), bool)
            fresh[1:] = (k[1:] != k[:-1]) | (c[1:] != c[:-1])
            k, c, done = k[fresh], c[fresh], done[fresh]
            if not len(k):
                continue
            start = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
            sizes = np.diff(np.append(start, len(k)))
            out = np.repeat(sizes > 1, sizes) & ~done
            if out.any():
                yield pa.RecordBatch.from_arrays([pa.array(x[out]) for x in (k, c)], names=["key", "c"])
            last = sorted({int(start[-1]), len(k) - 1})
            carry = k[last], c[last], np.full(len(last), sizes[-1] > 1)

    return rows.mapInArrow(tidy(run), "key long, c long")


def _hubs(runs: DataFrame, sets_: DataFrame) -> DataFrame:
    """(a, b): each set a and the hub b with which it shares most keys.

    A key's hub is its set that shares most keys with any others: of edited copies, the one nearest to what they all come
    from, so most of them link with it. Hubs are aggregates that fetch their keys' rows by a join, which adaptive execution
    can split, so a key that very many sets share is no task's alone.
    """
    degree = runs.groupBy("c").agg(F.count(F.lit(1)).alias("degree")).join(sets_.select("c", "n"), "c").withColumnRenamed("c", "_c")
    known = runs.join(degree, F.col("c") == F.col("_c")).select("key", F.struct("degree", "c", "n").alias("_mine"))
    hub = known.groupBy("key").agg(F.max("_mine").alias("_hub"))
    edges = known.join(hub, "key").select(F.col("_mine.c").alias("c"), F.col("_mine.n").alias("n"), F.col("_hub.c").alias("b"), F.col("_hub.n").alias("m"))
    edges = edges.where("c <> b AND 4 * least(n, m) >= 3 * greatest(n, m)").groupBy("c", "b").agg(F.count(F.lit(1)).alias("k"))
    return edges.groupBy("c").agg(F.max_by("b", F.struct("k", "b")).alias("b")).withColumnRenamed("c", "a")


def _sketches(profile: DataFrame, wanted: DataFrame) -> DataFrame:
    """(c, n, sketch) of the wanted (c)."""
    rows = profile.where("sketch IS NOT NULL").select("c", "n", "sketch").join(small(wanted, MOST_NAMED), "c", "left_semi")
    return rows.groupBy("c").agg(F.any_value("n").cast("int").alias("n"), F.any_value("sketch").alias("sketch"))


def _likely(pairs: DataFrame, profile: DataFrame) -> DataFrame:
    """The pairs (a, b) that sizes and sketches allow to link."""

    def run(batches):
        for batch in batches:
            na, nb = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            sa, sb = batch.column(4).to_pylist(), batch.column(5).to_pylist()
            size = [min(len(x), len(y)) // 8 for x, y in zip(sa, sb, strict=True)]
            far = np.array([int(np.bitwise_count(fold(x, k) ^ fold(y, k)).sum()) for x, y, k in zip(sa, sb, size, strict=True)], np.int64)
            ok = (far * 7 <= na + nb) & (4 * np.minimum(na, nb) >= 3 * np.maximum(na, nb))
            yield batch.select(["a", "b"]).filter(pa.array(ok))

    known = _sketches(profile, pairs.select(F.explode(F.array("a", "b")).alias("c")).distinct())
    left = known.select(F.col("c").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa"))
    right = known.select(F.col("c").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "na", "nb", "sa", "sb").mapInArrow(tidy(run), "a long, b long")


def _verify(docs: DataFrame, pairs: DataFrame, known: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets link, by their whole sets, made anew from the texts of the documents that stand for them."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("c")).distinct().join(known.select("c", F.col("doc_id").alias("_id")), "c")

    def own(batches):
        for batch in batches:
            texts, names = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            yield batch.filter(pa.array([digest(x) == c for c, x in zip(names, all_sets(texts), strict=True)], pa.bool_()))  # of rows with one doc_id, the right one

    members = stored(docs.join(small(wanted, MOST_NAMED), F.col("doc_id").eqNullSafe(F.col("_id"))).select("text", "c").mapInArrow(tidy(own), "text binary, c long"), "members")
    left = members.select(F.col("c").alias("a"), F.col("text").alias("ta"))
    right = members.select(F.col("c").alias("b"), F.col("text").alias("tb"))

    def run(batches):
        held_name, held = None, None
        for batch in batches:
            b, tb = batch.column(1).to_pylist(), batch.column(3).to_pylist()
            out = []
            for i, x in enumerate(all_sets(batch.column(2).to_pylist())):
                if b[i] != held_name:
                    held_name, held = b[i], next(all_sets([tb[i]]))
                out.append(linked(x, held))
            yield batch.select(["a", "b"]).filter(pa.array(out, pa.bool_()))

    return pairs.join(left, "a").join(right, "b").select("a", "b", "ta", "tb").mapInArrow(tidy(run), "a long, b long")


def _apart(runs: DataFrame, labels: DataFrame) -> DataFrame:
    """(key, c, component, _g, _same) of keys, shared by _g sets, whose sets are not in one component yet; _same names the set of sets."""
    labels = labels.select(F.col("node").alias("c"), "component")
    known = runs.join(small(labels, MOST_NAMED), "c", "left").select("key", "c", F.coalesce("component", "c").alias("component"))
    keys = known.groupBy("key").agg(F.min("component").alias("_low"), F.max("component").alias("_high"), F.count(F.lit(1)).alias("_g"), F.bit_xor(F.xxhash64("c")).alias("_same"))
    return known.join(keys.where("_low <> _high").drop("_low", "_high"), "key")


def _counted(known: DataFrame, sets_: DataFrame) -> DataFrame:
    """Pairs (a, b) of sets in different components that share as many keys of few sets as linked sets have to."""
    every = [int(_every(band).view(np.int64)[0]) for band in range(32)]
    known = known.where(F.col("_g") <= FEW).select("key", "c", "component").join(sets_.select("c", F.col("n").cast("int").alias("n")), "c")
    members = known.groupBy("key").agg(F.collect_list(F.struct("c", "n", "component")).alias("m"))
    x = members.select(F.when(F.col("key").isin(every), F.lit(1 << 30)).otherwise(F.lit(1)).cast("long").alias("w"), "m", F.explode("m").alias("x"))
    like = F.filter("m", lambda y: (y["c"] > F.col("x.c")) & (y["component"] != F.col("x.component")) & (4 * F.least(y["n"], F.col("x.n")) >= 3 * F.greatest(y["n"], F.col("x.n"))))
    pairs = x.select("w", F.col("x.c").alias("a"), F.col("x.n").alias("n"), F.explode(like).alias("y")).select("w", "a", F.col("y.c").alias("b"), F.least("n", "y.n").alias("n"))
    return pairs.groupBy("a", "b").agg(F.sum("w").alias("k"), F.min("n").alias("n")).where(F.expr(f"k >= 1 + n div {EXTRA}")).select("a", "b")


def _met(known: DataFrame, profile: DataFrame) -> DataFrame:
    """Pairs (a, b) of sets in different components that meet in a key of many sets and pass sizes and sketches.

    A passage that many texts share makes many keys of the same sets; of those with equal sets one is worked on.
    """
    known = known.where(F.col("_g") > FEW)
    one = small(known.groupBy("_same", "_g").agg(F.min("key").alias("key")).select("key"))
    known = stored(known.join(one, "key", "left_semi").select("key", "c", "component", "_g"), "met")
    known = known.join(_sketches(profile, known.select("c").distinct()), "c")
    chunks = F.ceil(F.col("_g") / CHUNK)
    mine = F.pmod(F.xxhash64("c"), chunks).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), (chunks - 1).cast("int")), lambda k: F.struct(F.least(k, F.col("_mine")).alias("i"), F.greatest(k, F.col("_mine")).alias("j")))
    dealt = known.withColumn("_mine", mine).select("key", F.inline(pairs), "_mine", "n", "c", "component", "sketch")
    dealt = dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "n", "c")

    def compare(group):
        _, i, j, mine, n, c, component, raw = (list(x) for x in zip(*group, strict=True))
        n, c, component, mine = (np.array(x) for x in (n, c, component, mine))
        size, at, s = 0, 0, None
        for x in range(len(n) - 1):
            if len(raw[x]) // 8 != size:  # n is sorted, so all that follow have sketches of this length at least
                size, at = len(raw[x]) // 8, x
                s = np.array([fold(r, size) for r in raw[x:]])
            y = np.arange(x + 1, int(np.searchsorted(n, n[x] * 4 // 3, "right")))
            y = y[(component[y] != component[x]) & ((mine[y] != mine[x]) | (i[0] == j[0]))]
            if len(y):
                y = y[np.bitwise_count(s[y - at] ^ s[x - at]).sum(1, dtype=np.int64) * 7 <= n[x] + n[y]]
                if len(y):
                    yield np.full(len(y), c[x]), c[y]

    def run(batches):
        group: list[tuple] = []
        a: list[np.ndarray] = []
        b: list[np.ndarray] = []
        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in range(8)), strict=True):
                if group and group[0][:3] != row[:3]:
                    for x, y in compare(group):
                        a.append(x)
                        b.append(y)
                    group = []
                group.append(row)
            if a:
                yield distinct(a, b)
                a, b = [], []
        if group:
            for x, y in compare(group):
                a.append(x)
                b.append(y)
        if a:
            yield distinct(a, b)

    def distinct(a, b):
        x = np.unique(np.sort(np.column_stack([np.concatenate(a), np.concatenate(b)]), axis=1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(x[:, 0].copy()), pa.array(x[:, 1].copy())], names=["a", "b"])

    return dealt.mapInArrow(tidy(run), "a long, b long").distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, group_key, text_hash) of docs (doc_id, text); all links at similarity 0.75 and over count.

    component_id: the smallest doc_id reachable by links, a document's own one if it has none. group_key: a name of the group that
    holds also where rows share a doc_id, null for texts without words; text_hash: xxhash64 of the text's bytes, which
    tells rows of one doc_id apart. Equal sets are one set of a
    class and are never paired. First each set is verified against one set that shares most keys with it; then
    only pairs not yet in one component are: those with enough keys in common, and those that meet where many sets share a
    key, compared in chunks.
    Cases: null and empty texts have no shingles and link with nothing; null doc_id is kept and counts only where a group has no
    other; repeated rows are kept; an empty table gives no rows; more columns are left out. Exact but for chances of 2**-64
    a pair of hashes.
    """
    text = F.col("text").cast("binary")
    docs = lean(docs.select(text.alias("text"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash")))
    profile = stored(_profile(docs), "profile")
    own = profile.where("NOT common").select("doc_id", "text_hash", "n", "c")
    n_docs = own.count()
    shared = profile.where("common").groupBy("c").agg(F.sum("n").alias("k")).where(F.col("k") >= COMMON * n_docs)
    common = np.sort(np.array([r["c"] for r in shared.orderBy(F.desc("k"), "c").limit(MOST_COMMON).collect()], np.int64).view(_U))
    rows = _key_rows(docs, common).repartition("key").sortWithinPartitions("key", "c")
    runs = freed(stored(_runs(rows), "runs"))
    first = stored(own.where("n > 0").groupBy("c").agg(F.min("doc_id").alias("doc_id"), F.min("n").alias("n")), "sets")
    hubs = freed(stored(_hubs(runs, first), "hubs"))
    links = freed(stored(_verify(docs, stored(_likely(hubs, profile), "likely"), first), "links"))
    apart = freed(stored(_apart(runs, components(links)), "apart"))
    rest = _likely(freed(stored(_counted(apart, first), "counted")), profile).unionByName(_met(apart, profile)).distinct()
    joined = components(links.unionByName(_verify(docs, freed(stored(rest, "rest")), first)))
    named = joined.join(first, joined["node"] == first["c"]).groupBy("component").agg(F.min("doc_id").alias("component_id"))
    groups = joined.join(named, "component").select(F.col("node").alias("c"), F.col("component").alias("group_key"), "component_id")
    alone = first.join(joined, first["c"] == joined["node"], "left_anti").select("c", F.col("c").alias("group_key"), F.col("doc_id").alias("component_id"))
    out = own.join(groups.unionByName(alone), "c", "left")
    single = (F.col("n") == 0) | F.col("component_id").isNull()
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(single, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), F.when(F.col("n") > 0, F.col("group_key")).alias("group_key"), "text_hash")


def op3_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("text_hash")
