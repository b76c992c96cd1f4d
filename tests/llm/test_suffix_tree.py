import math
import random
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from brinelog.llm import suffix_tree
from brinelog.llm.common import freed, stored

SF = "/root/testdata/sf0.001"
END, RARE, BEGIN = object(), object(), object()


class Plain:
    """The tree as the module's docstring tells it, with dictionaries of words."""

    def __init__(self, texts, least, depth, discount):
        self.least, self.depth = least, depth
        seqs = [[*t.split(), END] for t in texts]
        self.c = Counter(w for s in seqs for w in s)
        self.n, self.v = sum(self.c.values()), len(self.c)
        once, twice = (sum(1 for x in self.c.values() if x == k) for k in (1, 2))
        self.d = min(0.95, max(0.1, once / max(once + 2 * twice, 1)))
        often = [w for w, x in self.c.items() if x >= least]
        self.rare = max(1 - (sum(self.c[w] for w in often) - self.d * len(often)) / max(self.n, 1), 1e-9)
        total, follows = Counter(), defaultdict(Counter)
        for s in seqs:
            for i, w in enumerate(s):
                for ctx in self.contexts(s, i):
                    total[ctx] += 1
                    follows[ctx][self.code(w)] += 1
        above = {(): {w: (self.c[w] - self.d) / self.n for w in often} | {RARE: self.rare}}
        self.left, self.p, self.sums = {}, {}, {}
        for k in range(1, depth + 1):
            level = {}
            for ctx in [x for x in total if len(x) == k and total[x] >= least and x[:-1] in above]:
                m, q = total[ctx], above[ctx[:-1]]
                own = {w: x for w, x in follows[ctx].items() if x >= least and w in q}
                if not own:
                    continue
                sc, sq = sum(own.values()), sum(q[w] for w in own)
                rest, rest_q = max(1 - sc / m, 0.0), max(1 - sq, 1e-9)
                gain = sum(x * math.log(x / m / q[w]) for w, x in own.items()) + (m * rest * math.log(rest / rest_q) if rest > 0 else 0.0)
                level[ctx] = {w: q[w] for w in own}
                if gain > 0.5 * math.log(m) * (len(own) + 1):
                    left = 1 - (sc - discount * len(own)) / m
                    self.left[ctx] = left
                    level[ctx] = self.p[ctx] = {w: (x - discount) / m + left * q[w] for w, x in own.items()}
                    self.sums[ctx] = sum(self.p[ctx].values()) + left * (1 - sq)
            above = level

    def code(self, w):
        return w if self.c[w] >= self.least else RARE

    def contexts(self, s, i):
        """Contexts of the token at i, nearest word first, as long as they have evidence for their words."""
        ctx = ()
        for k in range(1, self.depth + 1):
            w = self.code(s[i - k]) if i >= k else BEGIN if i == k - 1 else None
            if w is None or w is RARE:
                return
            ctx += (w,)
            yield ctx

    def score(self, text):
        s, out = [*text.split(), END], 0.0
        for i, w in enumerate(s):
            x = self.c[w]
            p = (x - self.d) / self.n if x else self.d * self.v / self.n
            share = p / self.rare if self.code(w) is RARE else 1.0
            for ctx in self.contexts(s, i):
                if ctx in self.left:
                    own = self.p[ctx].get(self.code(w))
                    p = own * share if own is not None else self.left[ctx] * p
            out += math.log10(p)
        return out


@pytest.mark.parametrize("least", [4, 9])
def test_scores_are_a_plain_trees(spark, monkeypatch, least):
    """Every state, entry and score of the Spark tree against dictionaries; each state's probabilities sum to 1."""
    monkeypatch.setattr(suffix_tree, "LEAST", least)
    rng = random.Random(least)
    words = [f"w{i}" for i in range(60)]
    weights = [1 / (i + 1) for i in range(60)]
    texts = []
    for _ in range(260):
        t = []
        for _ in range(rng.randint(0, 40)):
            if len(t) >= 2 and rng.random() < 0.6:
                t.append(words[(int(t[-1][1:]) * 7 + int(t[-2][1:])) % 23])
            else:
                t.append(rng.choices(words, weights)[0])
        texts.append(" ".join(t))
    rows = [(i, t) for i, t in enumerate(texts)]
    held = {i for i, _ in rows if zlib.crc32(str(i).encode()) % 5 == 1}
    plain = Plain([t for i, t in rows if i not in held], least, suffix_tree.DEPTH, suffix_tree.DISCOUNT)
    assert len(plain.left) > 20 and {len(c) for c in plain.left} >= ({1, 2, 3} if least == 4 else {1, 2})
    assert all(abs(x - 1) < 1e-9 for x in plain.sums.values())
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = suffix_tree.score_documents(df, chunk=F.col("doc_id") % 3).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["held_out"] == (r["doc_id"] in held) and r["score"] == pytest.approx(plain.score(texts[r["doc_id"]]), abs=1e-6)


def test_slots_lose_no_frequent_pair(spark):
    """Pairs at just the least count, held by several chunks and tasks, are told to each of these."""
    rows = [(i, "left right" if i < 5 else "left other" if i < 9 else f"a{i} b{i}", True) for i in range(40)] + [(99, "left other", False)]
    df = spark.createDataFrame(rows, "doc_id long, text string, train boolean").select(F.col("text").cast("binary").alias("text"), "train", (F.col("doc_id") % 3).alias("chunk")).repartition(4)
    counts = Counter((r["chunk"], r["slot"]) for r in suffix_tree.filled_slots(df, 5, 10).distinct().collect())
    slots = {s for _, s in counts}
    # begin-left, left-right, right-end, and the ends and begins that five texts or more share
    assert {c for c, _ in counts} == {0, 1, 2} and len(slots) == 3
    assert suffix_tree.filled_slots(df, 1000, 10).count() == 0
    assert suffix_tree.filled_slots(df.where("false"), 5, 0).count() == 0


def test_chunks_are_told_in_few_rows(spark):
    """What n chunks are told of many states is n rows a task and kind, whatever the number of states; none is lost or doubled."""
    told = spark.range(0, 3000, 1, 2).select(F.when(F.col("id") % 2 == 0, suffix_tree.STATE).otherwise(suffix_tree.ENTRY).alias("kind"), F.col("id").alias("h"), (F.col("id") + 7).alias("g"), F.col("id").cast("double").alias("v"), F.array(F.lit(4).cast("long"), F.col("id") % 3 + 9).alias("chunks"))
    rows = suffix_tree.parcels(told).collect()
    assert len(rows) <= 2 * 2 * 4
    got = Counter((r["chunk"], r["kind"], int(k), v) for r in rows for k, v in zip(np.frombuffer(r["keys"], np.uint64), np.frombuffer(r["values"]), strict=True))
    i = np.arange(3000, dtype=np.uint64)
    key = np.where(i % 2 == 0, i, suffix_tree.pair(i, i + np.uint64(7)))
    assert got == Counter((c, suffix_tree.ENTRY if k % 2 else suffix_tree.STATE, int(key[k]), float(k)) for k in range(3000) for c in (4, k % 3 + 9))


def test_lookup():
    rng = np.random.default_rng(3)
    for keys in (np.zeros(0, np.uint64), np.arange(50, dtype=np.uint64), rng.integers(0, 2**64, 3000, np.uint64), np.array([2**64 - 1, 0, 1 << 63], np.uint64)):
        look, known = suffix_tree.Lookup([keys], [np.arange(len(keys)) + 0.5]), {int(k): i + 0.5 for i, k in enumerate(keys)}
        asked = np.concatenate([keys, rng.integers(0, 2**64, 500, np.uint64), np.array([0, 5, 2**64 - 1], np.uint64), np.array([-pow(int(suffix_tree._STEP), -1, 2**64) % 2**64], np.uint64)])
        found, value = look(asked)
        assert found.tolist() == [int(k) in known for k in asked] and value.tolist() == [known.get(int(k), 0.0) for k in asked]


def test_slots_are_told_in_few_rows(spark):
    """A chunk is told of a range's slots in one row, however many reach the least count; every frequent pair's slot is among them."""
    texts = [" ".join(f"w{k * 7 % 900 + j}" for j in range(40)) for k in range(300)]
    rows = [(" ".join([t] * 3).encode(), True, i % 4) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "text binary, train boolean, chunk long").repartition(3, "chunk")
    told = suffix_tree.slots_of_pairs(df, 5, 10_000).collect()
    assert len(told) <= 4 << suffix_tree.range_bits(10_000)
    got = {(r["chunk"], int(x)) for r in told for x in np.frombuffer(r["slots"], "<u4")}
    assert sum(len(r["slots"]) for r in told) == 4 * len(got) and len(got) > 10 * len(told)
    held, total = defaultdict(set), Counter()
    for text, _, chunk in rows:
        symbol, doc = suffix_tree.sequence(next(suffix_tree.blocks([text]))[2], 1)
        at, state, _ = next(suffix_tree.contexts(symbol, doc))
        for s in suffix_tree._slot(suffix_tree.pair(state, symbol[at])).tolist():
            held[s].add(chunk)
            total[s] += 1
    assert got == {(c, s) for s, n in total.items() if n >= 5 for c in held[s]}


def test_what_chunks_send_can_be_read_back(spark, monkeypatch):
    """Each gram is sent once, for its symbol's entry and for the longer context that it is; its context and that one's parent are told from its hash."""
    monkeypatch.setattr(suffix_tree, "LEAST", 4)
    rng = random.Random(5)
    texts = [" ".join(rng.choices("abcdef", [9, 5, 3, 2, 1, 1], k=rng.randint(0, 9))) for _ in range(120)]
    rows = spark.createDataFrame([(i, t.encode(), True, i % 3) for i, t in enumerate(texts)], "doc_id long, text binary, train boolean, chunk long")
    vocab = suffix_tree.vocabulary(rows).cache()
    root = suffix_tree.train_root(vocab)
    often = vocab.where(F.col("c") >= 4).select("chunks", F.lit(suffix_tree.WORD).alias("kind"), "h", F.lit(0).cast("long").alias("g"), F.col("c").cast("double").alias("v"))
    first = suffix_tree.grams(rows, [often], suffix_tree.slots_of_pairs(rows, 4, root.tokens), False, root).cache()
    pairs = first.where("depth > 0")
    known = pairs.select("chunks", F.lit(suffix_tree.ENTRY).alias("kind"), F.col("state").alias("h"), F.col("symbol").alias("g"), F.lit(0.0).alias("v"))
    got = pairs.unionByName(suffix_tree.grams(rows, [often, known], first.where("depth = 0").select("chunk", "slots"), True, root)).collect()
    plain, total, holders = Plain(texts, 4, suffix_tree.DEPTH, suffix_tree.DISCOUNT), Counter(), defaultdict(set)
    for i, t in enumerate(texts):
        s = [*t.split(), END]
        for k, w in enumerate(s):
            for ctx in plain.contexts(s, k):
                total[ctx, plain.code(w)] += 1
                holders[ctx, plain.code(w)].add(i % 3)
    assert Counter((r["depth"], r["c"], tuple(sorted(r["chunks"]))) for r in got) == Counter((len(ctx), n, tuple(sorted(holders[ctx, w]))) for (ctx, w), n in total.items() if n >= 4)
    u = lambda x: np.array(x, np.int64).view(np.uint64)
    state, symbol, key = (u([r[n] for r in got]) for n in ("state", "symbol", "key"))
    assert (suffix_tree.pair(state, symbol) == key).all()
    contexts = set(u([r["state"] for r in suffix_tree.words_as_contexts(vocab, 4).collect()]).tolist()) | set(key.tolist())
    assert set(state.tolist()) <= contexts and set(u([r["parent"] for r in got]).tolist()) <= contexts | {0}
    assert {r["parent"] for r in got if r["depth"] == 1} == {0}


def test_files_of_ended_queries_are_given_back(spark):
    """Shuffle files of a stored table are gone shortly after it was freed, without a later collection."""
    manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    count = lambda: sum("shuffle_" in x for x in manager.getAllFiles().mkString("\n").split("\n"))
    freed(spark.range(1), settled=True)
    time.sleep(1)
    before = count()
    for _ in range(3):
        freed(stored(spark.range(0, 20_000, 1, 4).withColumn("k", F.col("id") % 7).repartition(5, "k"), "few"), settled=True)
    end = time.monotonic() + 8
    while count() > before and time.monotonic() < end:
        time.sleep(0.2)
    assert count() <= before
