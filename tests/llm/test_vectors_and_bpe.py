import hashlib
import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from brinelog.llm import bpe, kmeans, negatives, vectors

SF = "/root/testdata/sf0.001"


def test_oracles(matches):
    matches(kmeans.op11_centroid_clustering, kmeans.OP11_SQL)
    matches(negatives.op13_hard_negatives, negatives.OP13_SQL)


def whole(v, dims):
    b = vectors.bound(dims)
    return [max(-b, min(b, math.floor(256 * x))) for x in v]


@pytest.mark.parametrize("seed", range(4))
def test_sort_means_finds_the_nearest_with_ties(seed):
    rng = np.random.default_rng(seed)
    c = rng.integers(-3, 4, (12, 3))
    c[5] = c[2]  # equal centroids
    x = rng.integers(-4, 5, (500, 3))
    all_ = ((x[:, None, :] - c[None]) ** 2).sum(-1)
    got, d = kmeans.SortMeans(c).assign(x, rng.integers(0, 12, 500).astype(np.int32))
    assert (got == all_.argmin(1)).all() and (d == all_.min(1)).all()


def test_sort_means_stops_early():
    """Far centroids aren't looked at: the scan of a vector close to its centroid sees none of the others."""
    search = kmeans.SortMeans(np.array([[0, 0], [1000, 0], [0, 1000]]))
    assert [np.searchsorted(a, 4 * 25, side="right") for a in search.apart] == [0, 0, 0]
    assert np.searchsorted(search.apart[0], 4 * 500 * 500, side="right") == 2  # just twice as far: still looked at


def plain_means(rows, k, rounds, dims, salt):
    kept = [(i, whole(v, dims)) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (hashlib.sha256(f"{salt}{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[0] is None, r[0] or 0, r[1]))
    cents = [v for _, v in kept[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(cents))
    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(near(v)[1], []).append(v)
        for j, g in groups.items():
            cents[j] = [sum(col) // len(g) for col in zip(*g, strict=True)]
    out = [(i, *near(v)) for i, v in kept]
    own = {}
    for _, d, j in out:
        own[j] = own.get(j, 0) + d
    most = 2**63 - 1
    return sorted(((i, j, d, min(own[j], most), min(sum(own.values()), most), hashlib.sha256(",".join(map(str, cents[j])).encode()).hexdigest()) for i, d, j in out), key=str)


ODD_VECTORS = [
    (1, [0.1, 0.2], 0), (2, [0.1, 0.2], 0), (2, [0.1, 0.2], 0), (None, [0.5, -0.5], 1), (None, None, 1), (3, [], 1), (4, [0.1, None], 0), (5, [float("nan"), 0.0], 0), (6, [float("inf"), 0.0], 0),
    (7, [1e30, -1e30], 0), (8, [1.0, 2.0, 3.0], 0), (9, [0.0, 0.0], None), (10, [-0.001, 0.001], 2), (-11, [3.5, 0.25], 2), (12, [0.5, -0.5], 1),
]


@pytest.mark.parametrize("k,rounds", [(1, 0), (3, 2), (40, 3)])
def test_clusters_of_odd_rows(spark, k, rounds):
    df = spark.createDataFrame([(*r, 7, 8) for r in ODD_VECTORS], "vec_id long, embedding array<double>, label int, cluster int, n int")
    got = kmeans.sort_means(df, k, rounds, 2, "2:")
    assert sorted(map(tuple, got.collect()), key=str) == plain_means([r[:2] for r in ODD_VECTORS], k, rounds, 2, "2:")


def test_clusters_of_nothing(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert kmeans.sort_means(df, 3, 2, 64).count() == 0
    with pytest.raises(ValueError):
        kmeans.sort_means(df, 0, 2, 64)


def test_one_big_group_of_copies(spark):
    rows = [(i, [0.5, 0.5]) for i in range(300)] + [(1000 + i, [i / 10, -i / 7]) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(7)
    assert sorted(map(tuple, kmeans.sort_means(df, 8, 4, 2).collect()), key=str) == plain_means(rows, 8, 4, 2, "")


def plain_negatives(rows, every, positives, k):
    kept = [(n, i, lab, v) for n, (i, v, lab) in enumerate(rows) if lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    dims = max([len(v) for _, v, _ in rows if v is not None], default=1)
    kept = [(n, i, lab, whole(v, max(dims, 1)) + [0] * (dims - len(v))) for n, i, lab, v in kept]
    out = []
    for n, i, lab, v in kept:
        if i is None or i % every:
            continue
        scored = [(-sum(a * b for a, b in zip(v, w, strict=True)), j is None, j or 0, m, lab2, j) for m, j, lab2, w in kept]
        for p in sorted(s for s in scored if s[4] == lab and s[3] != n)[:positives]:
            fit = sorted(s for s in scored if s[4] != lab and 30 * -p[0] <= 100 * -s[0] <= 90 * -p[0])[:k]
            out += [(i, p[5], r, s[5], -p[0], -s[0]) for r, s in enumerate(fit, 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("bits", [5, 9])
@pytest.mark.parametrize("seed", range(1))
def test_negatives_by_brute_force(spark, monkeypatch, seed, bits):
    """Small whole vectors, so that many scores tie; few buckets, so that windows are cut many times."""
    monkeypatch.setattr(negatives, "LEAST", 80)
    monkeypatch.setattr(negatives, "GROUP", 30)
    rng = random.Random(seed)
    rows = [(rng.choice([i, i, i - 100, None]), [rng.randint(-2, 3) / 4 for _ in range(3)], rng.choice([0, 1, 2])) for i in range(160)]
    rows += [(500 + i % 3, [0.5, 0.5, 0.25], 1) for i in range(40)] + [r for r in ODD_VECTORS if r[0] != 7]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<double>, label int, row int, score int").repartition(5)
    got = negatives.hard_negatives(df, every=20, positives=3, negatives=4, bits=bits)
    assert sorted(map(tuple, got.collect()), key=str) == plain_negatives(rows, 20, 3, 4)


def test_a_third_of_all_rows_tie(spark):
    """Copies that tie at a window's end are told apart by id; no task reports more of them than are wanted."""
    rows = [(0, [1.0, 0.0], 0), (100, [0.0, 1.0], 1), (1, [1.0, 0.0], 0), (3, [0.0, 1.0], 1)] + [(1000 + 3 * i, [0.5, 0.5], 2) for i in range(4000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = negatives.hard_negatives(df, every=200).collect()
    asked = [r for r in got if r["anchor_id"] == 0]
    assert [(r["positive_id"], r["rank"], r["negative_id"]) for r in sorted(asked, key=lambda r: r["rank"])] == [(1, k + 1, 1000 + 3 * k) for k in range(10)]


def test_negatives_of_nothing(spark):
    kind = "vec_id long, embedding array<float>, label int"
    assert negatives.hard_negatives(spark.createDataFrame([], kind)).count() == 0
    assert negatives.hard_negatives(spark.createDataFrame([(1, [1.0], 0), (None, [1.0], 0)], kind)).count() == 0
    assert negatives.hard_negatives(spark.createDataFrame([(100, [], 0), (200, [], 0), (3, [], 1)], kind)).count() == 2


def test_products_are_exact():
    big = np.array([[2**30, -(2**30) + 1, 7]])
    assert negatives._products(big, big)[0, 0] == sum(int(x) ** 2 for x in big[0])


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def ids(text):
    return np.frombuffer(bpe.coder().encode(text), "<i4").tolist()


def test_known_characters_are_cut_alike(library):
    """Letters, numbers and spaces of the pattern are the library's for every character that isn't left to it."""
    own = bpe.coder()
    chars = [c for c in map(chr, (*range(0xD800), *range(0xE000, 0x110000))) if not own.odd.search(c)]
    assert len(chars) > 200_000
    for mark in "a1":
        text = "\n".join(mark + c for c in chars if c not in "\r\n")
        assert own.cut.findall(text) == [text[a:e] for _, (a, e) in library.pre_tokenizer.pre_tokenize_str(text)]


def test_ids_are_the_librarys(library):
    rng = random.Random(5)
    pieces = ["<|endoftext|>", "<|endof", "text|>", " ", "  ", "\n", "\t", "\x85", "\xa0", "'s", "'LL", "don't", "1234", "½", "é", "é", "ß", "日本語", "😀👍🏽", "᠎", "\x1c", "\x00", "﻿", "Ա՘", "ꟊ", "𝔘", "हिन्दी", "عربى", "xyzzy", "the", "Q", ".", "--", "_", " ", "\U0002ebf0"]
    for _ in range(3000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randint(0, 12)))
        want = library.encode(text, add_special_tokens=False).ids
        assert ids(text) == want, text
        assert bpe.coder().decode(np.array(want)) == library.decode(want, skip_special_tokens=False)


def test_long_words(library):
    rng = random.Random(6)
    for text in ("a" * 20_000, "".join(rng.choice("abcdefgh") for _ in range(20_000)), "日本" * 5000, "".join(map(chr, rng.choices(range(0x4E00, 0x9FA5), k=5000))), " " * 9000, "=" * 9001):
        assert ids(text) == library.encode(text, add_special_tokens=False).ids


def test_cache_starts_anew():
    import public_tokenizers

    small = bpe.ByteCoder(public_tokenizers.path("byte_bpe_50k.json"), kept=3)
    text = " ".join(f"w{i}" for i in range(50)) + " w1 w2"
    assert np.frombuffer(small.encode(text), "<i4").tolist() == ids(text)


def test_stale_entries_are_skipped(tmp_path):
    """abc: (b, c) comes first, so the queued (a, b) has gone stale; aaa: of equal ranks the leftmost is merged."""
    letters = sorted(bpe._byte_letters(), key=bpe._byte_letters().get)
    vocab = {c: i for i, c in enumerate(letters)} | {"bc": 256, "ab": 257, "aa": 258, "abc": 259}
    told = {
        "added_tokens": [], "normalizer": None, "post_processor": None, "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}, "decoder": {"type": "ByteLevel", "add_prefix_space": True, "trim_offsets": True, "use_regex": True},
        "model": {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": None, "fuse_unk": False, "byte_fallback": False, "ignore_merges": False, "vocab": vocab, "merges": ["b c", "a b", "a a", "ab c"]},
    }
    path = tmp_path / "own.json"
    path.write_text(json.dumps(told))
    from tokenizers import Tokenizer

    own, library = bpe.ByteCoder(str(path)), Tokenizer.from_file(str(path))
    a = vocab["a"]
    assert own.merged(b"abc") == [a, 256] and own.merged(b"aaa") == [258, a] and own.merged(b"abab") == [257, 257]
    rng = random.Random(1)
    for _ in range(500):
        text = "".join(rng.choice("abc") for _ in range(rng.randint(0, 12)))
        assert own.merged(text.encode()) == library.encode(text).ids
    told["normalizer"] = {"type": "Lowercase"}
    path.write_text(json.dumps(told))
    with pytest.raises(ValueError):
        bpe.ByteCoder(str(path))


def test_bpe_query(spark, library):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r["doc_id"]: r for r in bpe.op12_bpe_coding(spark, SF).collect()}
    assert got.keys() == texts.keys()
    for i, t in texts.items():
        want = library.encode(t, add_special_tokens=False).ids
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        assert (got[i]["n_tokens"], got[i]["ids_sha256"], got[i]["decoded_sha256"]) == (len(want), sha(",".join(map(str, want))), sha(library.decode(want, skip_special_tokens=False)))


def test_bpe_columns(spark):
    long = "word " * 100_000
    rows = [(1, None, [5], "x"), (None, "", [1], "x"), (2, "a b", None, None), (2, "a b", None, None), (3, long, [], "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids array<int>, source string")
    out = bpe.encoded(df)
    assert sorted(out.columns) == sorted(df.columns)
    assert sorted(map(str, [(r["doc_id"], list(r["ids"])[:3], r["source"]) for r in out.collect()])) == sorted(map(str, [(i, ids(t or "")[:3], s) for i, t, _, s in rows]))
    back = bpe.decoded(out).collect()  # over the text itself
    assert sorted((r["text"] for r in back)) == sorted(t or "" for _, t, _, _ in rows)
    odd = spark.createDataFrame([([-1, 99_999_999, 50256, None, 64],), (None,)], "ids array<int>")
    assert sorted(r["text"] for r in bpe.decoded(odd).collect()) == ["", "<|endoftext|>a"]
    assert bpe.encoded(df.where(F.lit(False))).count() == 0
