import hashlib
import io
import random
import re
import wave
import zlib
from collections import Counter, defaultdict
from html import unescape
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from brinelog.llm import binary_packs, chat, common, fingerprint, graph, jaccard, langid, media, mixing, packing, quality, suffix_tree, tokens

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, rank int, n int, c string"
LONG = " ".join(f"word{i % 977}" for i in range(6000))
ODD = [
    (1, None, None, None, 0, 1, 1, "x"), (2, "", "en", "a", 0, 1, 1, "x"), (None, "the cat sat on the mat", "en", None, 22, 1, 1, None), (3, LONG, "en", "a", len(LONG), 2, 2, "y"),
    (4, "the cat sat on the mat", "en", "a", 22, 1, 1, "x"), (4, "the cat sat on the mat", "en", "a", 22, 1, 1, "x"), (5, "le chat est sur la table", "fr", "b", 24, 1, 1, "x"), (6, "123 !!", "fr", "b", 6, 1, 1, "x"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] for r in docs.collect()}


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def test_oracles(matches):
    matches(mixing.op1_mix_sources, mixing.OP1_SQL)
    matches(chat.op4_chat_formatting, chat.OP4_SQL)


def test_mix(odd, none):
    sized = odd.withColumn("size", mixing.word_count())
    rows = mixing.mix_sources(sized).collect()
    assert len(rows) == len(ODD) and all(0 <= r["copies"] <= 2 for r in rows)
    assert mixing.mix_sources(none.withColumn("size", F.lit(1))).count() == 0
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix_sources(sized).collect()))


def test_clashing_names(spark, odd):
    clash = odd.withColumnsRenamed({"rank": "_source", "n": "_task", "c": "_rate"}).withColumns({"size": F.length("text"), "copy": F.lit("mine"), "_at": F.lit(7), "_said": F.lit("s")})
    rows = mixing.mix_sources(clash).collect()
    assert len(rows) == len(ODD) and sorted(str(r["_source"]) for r in rows) == sorted(str(r[5]) for r in ODD) and {r["_at"] for r in rows} == {7}
    assert {r["copy"] for r in mixing.emit(mixing.mix_sources(clash)).collect()} <= {1, 2}
    assert [r["_said"] for r in langid.identify(clash).collect()] == ["s"] * len(ODD)
    items = spark.createDataFrame([(5, 1, 0, "a", 3)], "length long, doc_id long, piece int, offset string, rank int")
    assert packing.pack(items).columns == ["length", "doc_id", "piece", "sequence_id", "offset"] and packing.pack(items).first()["offset"] == 0


def test_ranks(spark):
    df = spark.range(500).select(F.col("id"), F.when(F.col("id") % 3 > 0, "hot").alias("g"))
    out, sizes = common.ranked(df, ["g"], [F.col("id").desc()], "t")
    by = defaultdict(list)
    for r in out.collect():
        by[r["g"]].append((r["rank"], -r["id"]))
    assert all(sorted(v) == sorted((i, x) for i, x in enumerate(sorted(x for _, x in v))) for v in by.values())
    assert {r["g"]: r["n"] for r in sizes.collect()} == {"hot": 333, None: 167}


def test_tokens_are_the_tokenizers(texts):
    code = tokens.coder()
    odd = ["<|endoftext|> a<|startoftext|>b", "it's don't x_1 ... (a,b) Été é ΣΣ İ 12a3.", "a\x1cb c d\tE\r\nf", "", "中文 äö!!"] + list(texts.values())[:60]
    for t, raw in zip(odd, code.encode(odd), strict=True):
        assert np.frombuffer(raw, "<u4").tolist() == code.tokenizer.encode(t, add_special_tokens=False).ids


def test_tokens_of_any_letters():
    code, rnd = tokens.coder(), random.Random(4)
    ranges = [(0x20, 0x7F), (0xA0, 0x250), (0x250, 0x370), (0x370, 0x530), (0x600, 0x700), (0x900, 0x980), (0x1100, 0x1200), (0x1E00, 0x2100), (0x4E00, 0x4F00), (0xAC00, 0xAD00), (0x1F300, 0x1F400), (0, 0x20)]
    for _ in range(20_000):
        some = rnd.choices(ranges, weights=[6, 6, 1, 3, 1, 1, 1, 1, 1, 1, 1, 0.3], k=2)
        s = "".join(chr(rnd.randrange(*rnd.choice(some))) for _ in range(rnd.randint(1, 14)))
        s = s[:3] + "'" + rnd.choice(["s", "re", "LL", "D"]) + s[3:] if rnd.random() < 0.2 else s
        assert np.frombuffer(code.encode([s])[0], "<u4").tolist() == code.tokenizer.encode(s, add_special_tokens=False).ids, s


def test_tokens_with_a_full_cache(texts):
    """A cache that is dropped all the time, texts over several parts, and words that few letters of are known, beside others."""
    from tokenizers import Tokenizer

    path = __import__("public_tokenizers").path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    some = [*list(texts.values())[:60], None, "", " \n", LONG * 30, "Zoë’s <|endoftext|> naïve 東京 don't <| |> \u0130x", "x" * 3000]
    want = [np.array(tokenizer.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes() for t in some]
    for limit in (0, 500, 400_000):
        code = tokens.WordCoder(path, limit)
        assert code.encode(some) == want and code.encode(some[::-1]) == want[::-1]


def test_merges_by_rank_are_refused_where_they_differ():
    letters = sorted(tokens._byte_letters(), key=tokens._byte_letters().get)
    base = [*letters, *(c + tokens.END for c in letters)]
    for merges, same in (([("a", "b"), ("ab", "c")], True), ([("a", "b"), ("b", "c"), ("a", "bc")], False)):  # abc can't come from a and bc, as a takes b first
        names = [*base, *(x + y for x, y in merges)]
        assert (tokens.merges_by_rank({t: i for i, t in enumerate(names)}, merges) is not None) == same


@pytest.mark.parametrize("seed", range(6))
def test_plan_is_near_the_bound(seed):
    rnd = random.Random(seed)
    counts = Counter(rnd.choice((rnd.randint(1, 100), rnd.randint(1, 40), rnd.randint(50, 100))) for _ in range(rnd.randint(1, 400)))
    patterns = packing.plan(counts, 100)
    used = Counter()
    for p, n in patterns:
        assert sum(length * k for length, k in p) <= 100
        for length, k in p:
            used[length] += k * n
    assert used == counts
    bound = max(-(-sum(k * n for k, n in counts.items()) // 100), sum(n for k, n in counts.items() if k > 50))
    assert bound <= sum(n for _, n in patterns) <= bound * 1.12 + 1


def test_dominance_works_in_bulk():
    for n in (3, 5000):
        left = Counter({1800: n, 120: n, 115: n, 110: n})
        fixed = packing.reduce_by_dominance(left, 2048)
        assert len(fixed) < 10 and sum(k for p, k in fixed if p[0][0] == 1800) == n


def test_dominance_keeps_the_optimum():
    def best(items, cap=10):
        if not items:
            return 0
        first, rest = items[0], items[1:]
        out = 99
        for k in range(len(rest) + 1):
            for extra in combinations(range(len(rest)), k):
                if first + sum(rest[i] for i in extra) <= cap:
                    out = min(out, 1 + best([x for i, x in enumerate(rest) if i not in extra], cap))
        return out

    rnd = random.Random(1)
    for _ in range(60):
        items = sorted((rnd.randint(1, 10) for _ in range(7)), reverse=True)
        left = Counter(items)
        fixed = packing.reduce_by_dominance(left, 10)
        assert sum(n for _, n in fixed) + best(sorted(left.elements(), reverse=True)) == best(items)


def _placed(rows):
    by = defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    return by


def test_packing(docs, texts, odd, none):
    rows = packing.pack_documents(docs).collect()
    by = _placed(rows)
    total = sum(r["length"] for r in rows)
    assert len(by) <= -(-total // 2048) + 1
    tok = tokens.coder().tokenizer
    for r in rows:
        ids = tok.encode(texts[r["doc_id"]], add_special_tokens=False).ids + [0]
        part = ids[r["start"] : r["start"] + r["length"]]
        assert zlib.crc32(np.array(part, "<u4").tobytes()) == r["ids_crc32"]
    _placed(rows := packing.pack_documents(odd).collect())
    assert len({(r["doc_id"], r["start"]) for r in rows}) == len(rows) - 1  # a row is repeated
    assert packing.pack_documents(none).count() == 0


def brute_components(texts):
    sets = {}
    for d, t in texts.items():
        w = words(t)
        sets[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    root = {d: d for d in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(sorted(texts), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {d: (len(sets[d]), find(d)) for d in texts}


@pytest.mark.parametrize("few,chunk", [(24, 2000), (1, 2000), (2, 3), (5, 2)])
def test_jaccard_finds_links_by_counted_and_by_frequent_keys(spark, monkeypatch, few, chunk):
    monkeypatch.setattr(jaccard, "FEW", few)
    monkeypatch.setattr(jaccard, "CHUNK", chunk)
    rnd, made = random.Random(few), {}
    for size in (5, 40, 70, 200, 700):
        base = [f"w{rnd.randint(0, 10**6)}" for _ in range(size)]
        for _ in range(14):
            copy = list(base)
            for _ in range(rnd.randint(0, 1 + size // 25)):
                copy[rnd.randrange(size)] = f"v{rnd.randint(0, 10**6)}"
            made[len(made)] = " ".join(copy)
        for _ in range(6):  # shares a passage with the others and nothing else
            made[len(made)] = " ".join(base[: size // 2] + [f"u{rnd.randint(0, 10**6)}" for _ in range(size)])
    got = jaccard.near_duplicates(spark.createDataFrame(list(made.items()), "doc_id long, text string")).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute_components(made)


def test_linked_sets_share_enough_keys():
    rnd = np.random.default_rng(3)
    for n in (1, 4, 15, 63, 64, 85, 255, 300, 1100, 5000):
        for _ in range(20):
            a = np.unique(rnd.integers(1, 2**63, n, dtype=np.uint64))
            swap = int(rnd.integers(0, n // 7 + 1))
            b = np.unique(np.concatenate([a[swap:], rnd.integers(1, 2**63, swap, dtype=np.uint64)]))
            common = np.sort(rnd.choice(a, n // 2, replace=False))
            if jaccard.linked(a, b):
                every = [int(jaccard._every(k)[0]) for k in range(32)]
                both = set(jaccard.keys(a, common).tolist()) & set(jaccard.keys(b, common).tolist())
                assert len(both) >= 1 + min(len(a), len(b)) // jaccard.EXTRA or both & set(every)


def test_jaccard_against_brute_force(spark, docs, texts, odd, none):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.near_duplicates(docs).collect()}
    assert got == brute_components(texts)
    rnd = random.Random(9)
    made = {}
    for family in range(6):
        base = [f"w{rnd.randint(0, 4000)}" for _ in range(rnd.choice((6, 30, 80, 300)))]
        for _ in range(9):
            copy = list(base)
            for _ in range(rnd.randint(0, max(1, len(base) // 25))):
                copy[rnd.randrange(len(copy))] = f"v{rnd.randint(0, 10**6)}"
            made[len(made)] = " ".join(copy)
    got = jaccard.near_duplicates(spark.createDataFrame(list(made.items()), "doc_id long, text string")).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute_components(made)
    rows = jaccard.near_duplicates(odd).collect()
    assert len(rows) == len(ODD) and {r["doc_id"]: r["component_id"] for r in rows}[4] == 4
    assert jaccard.near_duplicates(none).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 90), (90, 95)]
    got = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {90: 90, 95: 90, 100: 90}


def test_chat_events(spark):
    log = [(1, 1, 1, "message", "user", "hi \\l <x"), (1, 2, 2, "message", "assistant", "a"), (1, 3, 2, "delta", None, "b</turn>"), (1, 4, 3, "message", "user", "more"), (1, 5, 2, "regenerate", None, None), (1, 6, 2, "delta", None, "new"), (1, 7, 1, "edit", None, "hello"), (2, 1, 1, None, None, None)]
    rows = chat.rebuild(spark.createDataFrame(log, "conv_id long, seq long, slot long, kind string, role string, text string"))
    assert {(r["conv_id"], r["slot"]): (r["role"], r["text"]) for r in rows.collect()} == {(1, 1): ("user", "hello"), (1, 2): ("assistant", "new"), (2, 1): ("", "")}
    late = spark.createDataFrame([(1, 1, None, "message", "user", "x"), (1, 2, 1, "message", "user", "y"), (1, 3, 1, "regenerate", None, None)], "conv_id long, seq long, slot long, kind string, role string, text string")
    assert {(r["slot"], r["text"]) for r in chat.rebuild(late.withColumn("extra", F.lit(1))).collect()} == {(None, "x"), (1, "")}
    assert chat.read_back(chat.render(chat.rebuild(late.where("false")))).count() == 0
    long = spark.createDataFrame([(1, 1, 1, "message", "assistant", LONG)], "conv_id long, seq long, slot long, kind string, role string, text string")
    assert chat.read_back(chat.render(chat.rebuild(long))).first()["loss"] == LONG
    r = chat.read_back(chat.render(rows)).where("conv_id = 1").first()
    assert [tuple(t) for t in r["turns"]] == [("user", "hello"), ("assistant", "new")] and r["loss"] == "new"


def test_scores(docs, texts, odd, none):
    rows = {r["doc_id"]: r for r in suffix_tree.score_documents(docs).collect()}
    counts = Counter()
    for d, t in texts.items():
        if zlib.crc32(str(d).encode()) % 5 != 1:
            counts.update([*words(t), None])
    n, v = sum(counts.values()), len(counts)
    for d, t in texts.items():
        w = [*words(t), None]
        assert rows[d]["base_score"] == pytest.approx(sum(np.log10((counts[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w))
        assert (rows[d]["n_tokens"], rows[d]["n_known"], rows[d]["train_tokens"]) == (len(w), sum(counts[x] > 0 for x in w), n)
        assert rows[d]["score"] < 0
    held = [r for r in rows.values() if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
    assert suffix_tree.score_documents(odd).count() == len(ODD)
    assert suffix_tree.score_documents(none).count() == 0


def test_scores_use_rare_and_long_contexts(spark):
    rnd = random.Random(3)
    fill = [f"w{i}" for i in range(400)]
    rows = [("a x y p" if i % 2 else "b x y q") for i in range(500)] + [" ".join([*rnd.choices(fill, k=300), "foo", "bar", *rnd.choices(fill, k=300)]) for _ in range(220)]
    rows = [*enumerate(rows), (1000, "foo bar"), (1001, "bar foo")]
    got = suffix_tree.score_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    score = {r["doc_id"]: r["score"] for r in got}
    assert len(got) == len(rows) and score[1000] > score[1001] + 2
    same = {i: score[i] for i in range(500)}
    swapped = suffix_tree.score_documents(spark.createDataFrame([*rows, *((2000 + i, "a x y q") for i in range(9))], "doc_id long, text string"))
    odd = [r["score"] for r in swapped.where("doc_id >= 2000").collect()]
    assert np.mean(list(same.values())) > max(odd) + 0.7


def test_quality(spark, docs, odd, none):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    fold = common.crc_mod("doc_id", 4) == 1
    got = quality.classify(docs, labels.where(~fold)).select("doc_id", "keep").join(labels.where(fold), "doc_id").collect()
    assert len(got) > 10 and np.mean([r["keep"] == (r["quality"] == 1) for r in got]) > 0.93
    assert quality.classify(odd, labels).count() == len(ODD)
    clash = odd.withColumnsRenamed({"rank": "_host", "n": "global_quality", "c": "_n"})
    rows = quality.classify(clash, labels, with_text=False)
    assert rows.columns[:6] == ["doc_id", "lang", "source", "n_chars", "_host", "global_quality"] and rows.count() == len(ODD)
    assert quality.classify(odd, labels.where("false")).where("keep").count() == len(ODD)
    assert quality.classify(none, labels).count() == 0


def brute_posteriors(rows):
    """(host, path) posteriors of each of rows (host, path, p), itself left out."""
    def by(key):
        out = defaultdict(list)
        for r in rows:
            out[key(r)].append(r[2])
        return out

    within = lambda g: sum(sum((x - np.mean(v)) ** 2 for x in v) for v in g.values()) / max(sum(len(v) - 1 for v in g.values()), 1)
    prior = lambda w, v: min(max(w / v, 1.0), quality.PRIORS) if v > 0 else quality.PRIORS
    hosts, paths, mean = by(lambda r: r[0]), by(lambda r: r[:2]), np.mean([r[2] for r in rows])
    hw, pw = within(hosts), within(paths)
    hk = prior(hw, np.mean([(np.mean(v) - mean) ** 2 - hw / len(v) for v in hosts.values()]))
    pk = prior(pw, np.mean([(np.mean(v) - np.mean(hosts[k[0]])) ** 2 - pw * (1 / len(v) - 1 / len(hosts[k[0]])) for k, v in paths.items()]))
    out = []
    for h, q, p in rows:
        host = (sum(hosts[h]) - p + hk * mean) / (len(hosts[h]) - 1 + hk)
        out.append((host, (sum(paths[h, q]) - p + pk * host) / (len(paths[h, q]) - 1 + pk)))
    return out


def test_quality_sites_count(spark, monkeypatch):
    rnd = random.Random(8)
    rows = []
    for host, level in [(f"h{i}", 0.15 if i < 6 else 0.85) for i in range(12)] + [("sparse", 0.2), (None, 0.5)]:
        for k in range(2 if host == "sparse" else 40):
            rows.append((len(rows), host, rnd.choice(("a", "b", None)), min(max(rnd.gauss(level, 0.15), 0.02), 0.98)))
    texts = [" ".join(f"w{rnd.randint(0, 99)}" for _ in range(5 + i % 40)) for i in range(len(rows))]
    p = {t: r[3] for t, r in zip(texts, rows, strict=True)}
    stand_in = F.udf(lambda t: p[bytes(t).decode()], "double")
    monkeypatch.setattr(quality, "evidence", lambda model: stand_in)
    df = spark.createDataFrame([(i, t, q, h) for (i, h, q, _), t in zip(rows, texts, strict=True)], "doc_id long, text string, lang string, source string")
    got = {r["doc_id"]: r for r in quality.classify(df, df.select("doc_id", F.lit(1).alias("quality"))).collect()}
    want = brute_posteriors([(h, q, p[t]) for (_, h, q, _), t in zip(rows, texts, strict=True)])
    for r, (host, path) in zip(rows, want, strict=True):
        assert got[r[0]]["host_quality"] == pytest.approx(host) and got[r[0]]["path_quality"] == pytest.approx(path)
    bad, good = ([got[r[0]]["path_quality"] for r in rows if r[1] in hosts] for hosts in ({f"h{i}" for i in range(6)}, {f"h{i}" for i in range(6, 12)}))
    assert max(bad) < 0.4 and min(good) > 0.6
    alone = [got[r[0]]["path_quality"] for r in rows if r[1] == "sparse"]
    assert all(np.mean(bad) < x < np.mean(good) for x in alone)


def test_quality_with_one_class_keeps_all(spark, odd):
    for label in (0, 1):
        labels = spark.createDataFrame([(k, label) for k in (3, 4, 5, 6)], "doc_id long, quality int")
        assert quality.classify(odd, labels, threshold=0.9).where("keep").count() == len(ODD)


def test_media(spark, odd, none):
    html = '<p>one <b>two</b></p><figure><img src="sha256:ab"><figcaption>cap &amp; x</figcaption></figure><script>no</script>three<img src="u" alt="alt">'
    assert [i[1:] for i in media.parse(html)] == [("text", "one two", None, None), ("media", None, "sha256:ab", "cap & x"), ("text", "three", None, None), ("media", None, "u", "alt")]
    assert media.parse(None) == [] and media.from_wav(media.to_wav(bytes(range(192)))) == bytes(range(192))
    store = media.store_media(odd)
    rows = {r["digest"]: r for r in media.figures(store).collect()}
    for r in store.collect():
        back, told = media.from_wav(r["media"]), rows[r["digest"]]
        assert (len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:])) == (told["payload_bytes"], told["payload_sha256"], told["tail_crc32"]) and not len(back) % 192 and len(back) > 0
    assert len(rows) == 5 and media.figures(media.store_media(none)).count() == 0


def test_any_html_is_read():
    """Broken declarations, nested figures, captions before and after; then random marks, none of which may fail."""
    assert [x[1:] for x in media.parse("<p>x <![ y</p> z")] == [("text", "x z", None, None)]  # up to the next >
    shown = lambda html: [(x[3], x[4]) for x in media.parse(html) if x[1] == "media"]
    assert shown("<figure><img src=a><figure><img src=b><figcaption>in</figcaption></figure><figcaption>out</figcaption></figure>") == [("a", "out"), ("b", "in")]
    assert shown("<figure><figure><img src=b></figure><figcaption>out</figcaption></figure>") == [("b", "out")]
    assert shown("<figure><figcaption>first</figcaption><img src=c>") == [("c", "first")]
    assert shown("<figure><img src=d alt=x><figcaption>never closed") == [("d", "x")]
    rng = random.Random(1)
    marks = ["<", "<!", "<![", "<!-", "<!--", "-->", "]]>", ">", "&", "&#", "&#x", "&lt", "<p>", "</p>", "<figure>", "</figure>", "<figcaption>", "</figcaption>", "<img src=a>", "<img src='", "<script>", "</script>", "<?", "</", '<a b="', '"', "'", " x", "é", "\0", "<![CDATA[", "<!DOCTYPE", "=", "/", "<title>", "<textarea>", "<plaintext>"]
    for _ in range(60_000):
        media.parse("".join(rng.choice(marks) for _ in range(rng.randint(0, 14))))


def test_media_query(spark, texts):
    got = {r["doc_id"]: r for r in media.op7_media_columns(spark, SF).collect()}
    assert got.keys() == texts.keys()
    for d, t in texts.items():
        raw, r = (t or "").encode(), got[d]
        payload = raw + b" " * (-len(raw) % 192 or (0 if raw else 192))
        buffer = io.BytesIO()
        with wave.open(buffer, "wb") as w:
            w.setparams((1, 1, media.RATE, len(payload), "NONE", ""))
            w.writeframes(payload)
        x = np.frombuffer(payload, np.uint8)
        above = [v > x.mean() for v in x]
        share = [sum(v // 32 == k for v in payload) * 1000 // len(payload) for k in range(8)]
        feature = f"mean={x.mean():.3f};rms={np.sqrt(((x - x.mean()) ** 2).mean()):.3f};cross={sum(a != b for a, b in zip(above, above[1:], strict=False)) / len(x):.4f};ranges={','.join(map(str, share))}"
        assert (r["position"], r["caption"], r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (1, str(d), len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        assert (r["media_bytes"], r["media_sha256"], r["feature"]) == (len(buffer.getvalue()), hashlib.sha256(buffer.getvalue()).hexdigest(), feature)


def test_media_sequences_resolve_in_place(spark, monkeypatch):
    monkeypatch.setattr(media, "HOT", 0.3)
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    page = lambda *refs: "<p>a</p>" + "".join(f'<figure><img src="{r}"><figcaption>c{i}</figcaption></figure>t{i}' for i, r in enumerate(refs))
    hot, cold, gone = (f"sha256:{digest(t)}" for t in ("hot", "cold", "gone"))
    pages = [(1, page(hot, cold, hot)), (1, page(hot)), (2, page(gone, "http://x/y.png", hot)), (3, ""), (None, None)]
    df = media.interleave(spark.createDataFrame(pages, "page_id long, html string"))
    store = media.figures(media.store_media(spark.createDataFrame([("hot",), ("cold",), ("hot",)], "text string")))
    rows = media.resolve(df, store, "page_id").collect()
    want = []
    for key, html in pages:
        items = media.parse(html)
        want += [(key, i, k, t, r, c, {hot: 3, cold: 4}.get(r)) for i, k, t, r, c in items] or [(key, None, None, None, None, None, None)]
    assert sorted(map(repr, want)) == sorted(repr((r["page_id"], r["position"], r["kind"], r["text"], r["reference"], r["caption"], r["n_bytes"])) for r in rows)
    with pytest.raises(ValueError, match="position"):
        media.resolve(df, store.withColumn("position", F.lit(1)), "page_id")


def test_pages_against_a_plain_reader(spark):
    rows = media.interleave(spark.read.parquet(f"{SF}/pages.parquet")).collect()
    for r in rows:
        html = re.sub(r"(?is)<(script|style|template|noscript)\b.*?</\1\s*>|<!--.*?-->", "", r["html"] or "")
        said = " ".join(i["text"] for i in r["sequence"] if i["kind"] == "text").split()
        plain = unescape(re.sub(r"(?s)<[^>]*>", " ", html)).split()
        assert "".join(said) == "".join(plain)
        assert [i["reference"] for i in r["sequence"] if i["kind"] == "media"] == re.findall(r'<(?:img|audio|video|source|embed)\b[^>]*?\bsrc="([^"]+)"', html)


def test_id_output(docs, texts, odd, none):
    packed = binary_packs.packed_sequences(docs, batch_tokens=20_000)
    rows = packed.collect()
    assert all(r["cu_seqlens"][-1] == r["n_tokens"] <= 2048 and zlib.crc32(bytes(r["ids"])) == r["ids_crc32"] for r in rows)
    parts = defaultdict(dict)
    for r in binary_packs.unpack(packed).collect():
        parts[r["doc_id"]][r["piece"]] = bytes(r["ids"])
    for d, t in texts.items():
        assert b"".join(parts[d][k] for k in sorted(parts[d])) == np.array(tokens.coder().tokenizer.encode(t, add_special_tokens=False).ids + [0], "<u2").tobytes()
    assert sum(len(r["doc_ids"]) for r in binary_packs.packed_sequences(odd).collect()) >= len(ODD)
    assert binary_packs.packed_sequences(none).count() == 0


def test_segment_tree():
    rnd = random.Random(2)
    lengths = [rnd.randint(1, 64) for _ in range(300)]
    out = binary_packs.best_fit_decreasing(lengths, 64)
    assert sorted(i for s in out for i in s) == list(range(300)) and all(sum(lengths[i] for i in s) <= 64 for s in out)
    assert len(out) <= sum(lengths) / 64 + 3


def test_languages(docs, odd, none):
    rows = langid.identify(docs).where("held_out").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in rows]) > 0.95
    got = {r["doc_id"]: r for r in langid.identify(odd).collect()}
    assert got[1]["lang_pred"] == got[2]["lang_pred"] == got[6]["lang_pred"] == "und" and got[6]["rejected"]
    assert langid.identify(none).count() == 0


def test_varieties_keep_centroids():
    rnd = random.Random(7)
    one, two = ([f"{a}{b}" for a in u for b in v] for u, v in ((("ka", "mo", "ti", "re"), ("lan", "sor", "vem")), (("zu", "phi", "gro", "wex"), ("bda", "cqu", "jyn"))))
    texts = [" ".join(rnd.choices(one if i % 2 else two, k=60)) for i in range(300)] + ["%s" % c for c in "qxj"]
    x = np.concatenate([langid.vectors(grid, np.ones(langid.DIMENSIONS, np.float32)) for _, grid in langid.counts(texts)])
    c = langid._cluster(x, 3)
    near = (x[:300] @ c.T).argmax(1)
    assert len(c) >= 2 and not set(near[::2]) & set(near[1::2])


def test_language_rejection(spark):
    rnd = random.Random(5)
    noise = lambda n: " ".join("".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rnd.randint(2, 9))) for _ in range(n))
    foreign = [
        "Все люди рождаются свободными и равными в своем достоинстве и правах. Они наделены разумом и совестью", "人人生而自由在尊严和权利上一律平等他们赋有理性和良心并应以兄弟关系的精神相对待", "يولد جميع الناس أحرارا متساوين في الكرامة والحقوق وقد وهبوا عقلا وضميرا",
        "Bütün insanlar hür, haysiyet ve haklar bakımından eşit doğarlar. Akıl ve vicdana sahiptirler", "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto.", noise(20), noise(200),
    ]
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = common.crc_mod("doc_id", 3) == 1
    said = langid.classify(langid.train(docs.where(~held)))
    probes = spark.createDataFrame([(t,) for t in foreign], "text string")
    assert all(r[0]["rejected"] for r in probes.select(said("text")).collect())
    rows = docs.where(held).select("lang", said("text").alias("r")).collect()
    assert np.mean([r["r"]["rejected"] for r in rows]) < 0.02


def test_fingerprints(docs, texts, odd, none):
    rows = {r["doc_id"]: r for r in fingerprint.fingerprint_neighbours(docs).collect()}
    ids = sorted(texts, reverse=True)
    for i, d in enumerate(ids):
        t, after = texts[d], texts[ids[(i + 1) % len(ids)]]
        assert hashlib.sha256((t[: len(t) - len(t) // 2] + after[: len(t) // 2]).encode()).hexdigest() == rows[d]["edited_sha256"]
    long = [r for r in rows.values() if r["n_chars"] > 300]
    assert np.mean([r["near_edited"] > r["near_next"] for r in long]) > 0.97
    by = defaultdict(set)
    for d, t in texts.items():
        by[t].add(rows[d]["fingerprint"])
    assert all(len(x) == 1 for x in by.values())
    assert fingerprint.fingerprint_neighbours(odd).count() == len(ODD) and fingerprint.fingerprint_neighbours(none).count() == 0


def test_pipeline(spark, docs):
    import corpus_pipeline as p

    kept = docs
    for name, stage in p.STAGES[:4]:
        new = stage(spark, kept, SF).select(*p.COLUMNS)
        new = common.stored(new, "stage")
        assert {r[0] for r in new.select("doc_id").collect()} <= {r[0] for r in kept.select("doc_id").collect()}, name
        if name.startswith("n-gram"):
            brute = brute_components({r["doc_id"]: r["text"] for r in kept.collect()})
            assert sorted(r[0] for r in new.select("doc_id").collect()) == sorted(d for d, (_, c) in brute.items() if c == d)
        if name.startswith("mixing"):
            sized = [(r["doc_id"], r["source"], len(words(r["text"]))) for r in kept.collect()]
            mixed = mixing.mix_sources(spark.createDataFrame(sized, "doc_id long, source string, size long")).collect()
            want = Counter({r["doc_id"]: r["copies"] for r in mixed})
            assert Counter(r[0] for r in new.select("doc_id").collect()) == +want
        kept = new
    _placed(p.pack(spark, kept, SF).collect())


def test_pipeline_stages_on_odd_tables(spark, odd, none):
    import corpus_pipeline as p

    rows = odd.select(*p.COLUMNS)
    for name, stage in p.STAGES:
        assert stage(spark, none, SF).count() == 0, name
        assert stage(spark, rows, SF).count() <= 2 * len(ODD) + 10, name
    assert p.language(spark, rows, SF).where("text IS NULL OR text = ''").count() == 0
    a, b, c = "one two three four five six seven", "one two three four five six seven", "eight nine ten eleven twelve more words"
    many = [(1, a, "en", "s", 3), (2, b, "en", "s", 3), (2, c, "en", "s", 3), (None, a, "en", "s", 3), (None, c, "en", "s", 3), (9, "", "en", "s", 0), (9, "", "en", "s", 0), (1, a, "en", "s", 3), (None, "alone", "en", "s", 1)]
    got = p.one_of_each(spark, spark.createDataFrame(many, "doc_id long, text string, lang string, source string, n_chars long"), SF)
    assert sorted(map(str, ((r["doc_id"], r["text"]) for r in got.collect()))) == sorted(map(str, [(1, a), (2, c), (9, ""), (9, ""), (None, "alone")]))
    mixed = p.mix(spark, got, SF)
    assert {r["doc_id"] for r in mixed.collect()} <= {1, 2, 9, None} and mixed.columns == p.COLUMNS


def test_quality_stage_reads_texts_in_one_python_step(spark):
    """A second step in a task is a second Python worker in it, and workers live on to the end of the pipeline."""
    import corpus_pipeline
    plan = corpus_pipeline.quality_filter(spark, spark.read.parquet(f"{SF}/documents.parquet"), SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
