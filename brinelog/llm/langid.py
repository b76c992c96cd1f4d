"""Language identification: nearest of several TF-IDF n-gram centroids per language, with rejection by distance."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, lean, small, spare, tidy, trim
from .words import BLOCK

DIMENSIONS = 4096
#: Cosines grow with a text's length, so floors stand by band: the power of two of its distinct trigrams.
BANDS = 13
#: A floor is MARGIN times the QUANTILE of cosines in its band, and less where few rows say it: n rows count n / (n + FEW).
QUANTILE = 0.01
MARGIN = 0.8
FEW = 2
#: Lower bands are added until a band's quantile rests on so many rows.
ENOUGH = 8
BINS = 200
#: So many texts are counted at a time at most, whatever their lengths, as each takes a row of DIMENSIONS counts.
ROWS = 64
_FOLD = np.full(256, 32, np.uint8)
_FOLD[128:] = np.arange(128, 256)
_FOLD[97:123] = np.arange(97, 123)


@dataclass(frozen=True)
class Model:
    """centroids: rows of unit length; langs: each one's language; floors: the least cosine that is accepted, by centroid and band."""

    idf: np.ndarray
    centroids: np.ndarray
    langs: tuple[str, ...]
    floors: np.ndarray


def _codes(folded: np.ndarray) -> np.ndarray:
    """The hashed dimension of each byte trigram."""
    data = folded.astype(np.uint32)
    return (data[:-2] << np.uint32(16) | data[1:-1] << np.uint32(8) | data[2:]) * np.uint32(2654435761) >> np.uint32(20)


_BLANK = int(_codes(np.full(3, 32, np.uint8))[0])


def _grid(held: list[bytes]) -> np.ndarray:
    doc = np.repeat(np.arange(len(held)), [len(r) + 2 for r in held])
    folded = _FOLD[np.frombuffer(b" " + b"  ".join(held) + b"  ", np.uint8)]
    grid = np.zeros(len(held) * DIMENSIONS, np.int64)
    for at in range(0, len(folded) - 2, BLOCK):  # a long text in parts
        code = _codes(folded[at : at + BLOCK + 2])
        own = doc[at : at + len(code)]
        grid += np.bincount(own * DIMENSIONS + code[: len(own)], minlength=len(grid))
    grid = grid.reshape(len(held), DIMENSIONS)
    grid[:, _BLANK] = 0
    return grid


def counts(texts: list[str]):
    """Runs of texts of about BLOCK bytes, at most ROWS: (how many, byte trigram counts by hashed dimension). Letters count, lower-cased; all else is space."""
    held, size = [], 0
    for i, t in enumerate(texts):
        raw = t.lower().encode()
        held.append(raw)
        size += len(raw)
        if size > BLOCK or len(held) == ROWS or i == len(texts) - 1:
            yield len(held), _grid(held)
            held, size = [], 0


def vectors(grid: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """TF-IDF rows of unit length: 1 + log of counts, times idf."""
    x = np.where(grid > 0, 1 + np.log(np.maximum(grid, 1)), 0).astype(np.float32) * idf
    return x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-9)


def bands(grid: np.ndarray) -> np.ndarray:
    return np.log2(np.maximum((grid > 0).sum(1), 1)).astype(np.int64)


def has_letter(text: str | None) -> bool:
    return bool(text) and (text.isalpha() or any(map(str.isalpha, text)))


def _unit(c: np.ndarray) -> np.ndarray:
    return c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-9)


def _lloyd(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Spherical k-means from centres of unit length; a centre without rows stays."""
    for _ in range(12):
        own = (x @ c.T).argmax(1)
        c = _unit(np.array([x[own == j].mean(0) if (own == j).any() else c[j] for j in range(len(c))]))
    return c


def _seeds(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """k-means++: rows drawn by their distance to those drawn before, fewer than k if no row is left at a distance."""
    at = [int(rng.integers(len(x)))]
    far = 1 - x @ x[at[0]]
    while len(at) < k and (far > 1e-5).any():
        p = np.where(far > 1e-5, far, 0).astype(np.float64)
        at.append(int(rng.choice(len(x), p=p / p.sum())))
        far = np.minimum(far, 1 - x @ x[at[-1]])
    return x[at]


def _cluster(x: np.ndarray, k: int) -> np.ndarray:
    """At most k centres of unit length, each with a fiftieth of the rows at least; the seed is fixed.

    The best of a few starts counts. For each centre with fewer rows, which goes, the largest cluster is split in two, if both
    parts are large enough.
    """
    rng = np.random.default_rng(0)
    least = max(1, len(x) // 50)
    c = max((_lloyd(x, _seeds(x, k, rng)) for _ in range(4)), key=lambda c: float((x @ c.T).max(1).sum()))
    for _ in range(2 * k):
        own = (x @ c.T).argmax(1)
        sizes = np.bincount(own, minlength=len(c))
        if (sizes < least).any():
            c = c[sizes >= least] if (sizes >= least).any() else c[[sizes.argmax()]]
        elif len(c) < k:
            j = int(sizes.argmax())
            two = _lloyd(x[own == j], _seeds(x[own == j], 2, rng))
            if len(two) < 2 or np.bincount((x[own == j] @ two.T).argmax(1), minlength=2).min() < least:
                continue
            c = np.concatenate([np.delete(c, j, 0), two])
        else:
            break
    own = np.bincount((x @ c.T).argmax(1), minlength=len(c))
    return c[own >= least] if (own >= least).any() else c[[own.argmax()]]


def train(docs: DataFrame, sample_rows: int = 2000, clusters: int = 3, floor: float = 0.02) -> Model:
    """A model from docs (doc_id, text, lang) with lang and a letter in text.

    Document frequencies cover all rows. Centroids are fitted on about sample_rows of them, never over twice as many,
    spread evenly over the languages and chosen by a hash of doc_id and text; only their trigram counts reach the driver. Floors are set from the
    cosines of all rows, see _floors; no floor is under the one given here.
    """
    half = F.pmod(F.xxhash64("doc_id", F.lit("half")), F.lit(2)).cast("int").alias("half")
    rows = lean(docs).where("lang IS NOT NULL AND text IS NOT NULL").select("doc_id", "text", "lang", half)

    def frequency(batches):
        n, df = 0, np.zeros(DIMENSIONS, np.int64)
        for batch in batches:
            texts = [t for t in batch.column(0).to_pylist() if has_letter(t)]
            n += len(texts)
            for _, grid in counts(texts):
                df += (grid > 0).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, DIMENSIONS)), pa.array(np.concatenate([[n], df]))], names=["at", "n"])

    found = {r["at"]: r["n"] for r in rows.select("text").mapInArrow(tidy(frequency), "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect()}
    df = np.array([found.get(i, 0) for i in range(DIMENSIONS)])
    idf = (np.log((1 + found.get(-1, 0)) / (1 + df)) + 0.05).astype(np.float32)
    sizes = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    langs = sizes.count()
    share = small(sizes.select(F.col("lang").alias("_lang"), (F.lit(sample_rows / max(langs, 1)) / F.col("n")).alias("_share")))
    draw = F.pmod(F.xxhash64("doc_id", "text", F.lit("langid")), F.lit(1 << 20)) / float(1 << 20)

    def measure(batches):
        for batch in batches:
            table = [(lang, h, t) for lang, h, t in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True) if has_letter(t)]
            done = 0
            for n, grid in counts([t for _, _, t in table]):
                for (lang, h, _), row in zip(table[done : done + n], grid, strict=True):
                    at = np.flatnonzero(row)
                    yield pa.RecordBatch.from_pylist([{"lang": lang, "half": h, "at": at.astype("<u2").tobytes(), "n": row[at].astype("<u4").tobytes()}], schema)
                done += n

    schema = pa.schema([("lang", pa.string()), ("half", pa.int32()), ("at", pa.binary()), ("n", pa.binary())])
    chosen = rows.join(share, F.col("lang") == F.col("_lang")).where(draw < F.col("_share")).select("lang", "half", "text")
    chosen = chosen.mapInArrow(tidy(measure), "lang string, half int, at binary, n binary").orderBy(F.xxhash64("at", "n"), "at", "n", "lang").limit(2 * sample_rows)
    by: dict[str, list[tuple[int, bytes, bytes]]] = {}
    for r in sorted(chosen.collect()):
        by.setdefault(r["lang"], []).append((r["half"], bytes(r["at"]), bytes(r["n"])))
    parts, names = [], []
    halves: dict[str, list[np.ndarray]] = {}
    for lang, pairs in sorted(by.items()):
        x = np.zeros((len(pairs), DIMENSIONS), np.float32)
        for lo in range(0, len(pairs), ROWS):
            grid = np.zeros((len(pairs[lo : lo + ROWS]), DIMENSIONS), np.int64)
            for row, (_, where, n) in zip(grid, pairs[lo : lo + ROWS], strict=True):
                row[np.frombuffer(where, "<u2")] = np.frombuffer(n, "<u4")
            x[lo : lo + ROWS] = vectors(grid, idf)
        c = _cluster(x, clusters)
        parts.append(c)
        names += [lang] * len(c)
        half = np.array([k for k, _, _ in pairs])
        halves[lang] = [_cluster(x[half != k], clusters) if (half != k).any() else x[:0] for k in (0, 1)]
    least = _floors(rows, idf, halves, floor)
    floors = np.array([least[lang] for lang in names]).reshape(-1, BANDS)
    return Model(idf, np.concatenate(parts).astype(np.float32) if parts else np.zeros((0, DIMENSIONS), np.float32), tuple(names), floors)


def _floors(rows: DataFrame, idf: np.ndarray, halves: dict[str, list[np.ndarray]], floor: float) -> dict[str, np.ndarray]:
    """Each language's floors by band, at least floor, from the cosines of all rows (text, lang, half) to their own language.

    A row is held against centroids of the sample's other half, so none is measured by itself. Counts by language, band
    and one of BINS cosines reach the driver.
    """
    at = {lang: i for i, lang in enumerate(halves)}

    def measure(batches):
        seen: dict[int, int] = {}
        for batch in batches:
            table = [(t, lang, h) for t, lang, h in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True) if lang in at and has_letter(t)]
            done = 0
            for n, grid in counts([t for t, _, _ in table]):
                x, band = vectors(grid, idf), bands(grid)
                own: dict[tuple, list[int]] = {}
                for i, (_, lang, h) in enumerate(table[done : done + n]):
                    own.setdefault((lang, h), []).append(i)
                for (lang, h), i in own.items():
                    if len(halves[lang][h]):
                        cosine = np.clip((x[i] @ halves[lang][h].T).max(1), 0, 1)
                        code = (at[lang] * BANDS + band[i]) * BINS + np.minimum((cosine * BINS).astype(np.int64), BINS - 1)
                        for k, c in zip(*(v.tolist() for v in np.unique(code, return_counts=True)), strict=True):
                            seen[k] = seen.get(k, 0) + c
                done += n
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.int64()), pa.array(list(seen.values()), pa.int64())], names=["at", "n"])

    table = np.zeros((len(at), BANDS, BINS), np.int64)
    if at:
        for r in rows.select("text", "lang", "half").mapInArrow(tidy(measure), "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():
            table.flat[r["at"]] = r["n"]
    out = {}
    for lang, i in at.items():
        out[lang] = np.full(BANDS, floor)
        for band in range(BANDS):
            total, low = np.zeros(BINS, np.int64), band
            while low >= 0 and total.sum() < ENOUGH:
                total, low = total + table[i, low], low - 1
            n = int(total.sum())
            if n:
                edge = int(np.searchsorted(np.cumsum(total), QUANTILE * n)) / BINS
                out[lang][band] = max(floor, MARGIN * edge * n / (n + FEW))
    return out


def classify(model: Model):
    """A column function of text: struct<lang, score, rejected>.

    lang: the nearest centroid's; ``und`` without a letter or a centroid. score: cosine, from 0 to 1. rejected: lang is
    ``und`` or the cosine is under that language's floor for texts of such length. Of equally near centroids the first in order of language counts.
    """

    @F.arrow_udf("lang string, score double, rejected boolean")
    def run(text: pa.Array) -> pa.Array:
        texts = text.to_pylist()
        lettered = [i for i, t in enumerate(texts) if has_letter(t)] if model.langs else []
        lang, score, least = ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
        at = 0
        for n, grid in counts([texts[i] for i in lettered]):
            near = np.clip(vectors(grid, model.idf) @ model.centroids.T, 0, 1)
            for i, best, c, band in zip(lettered[at : at + n], near.argmax(1).tolist(), near.max(1).tolist(), bands(grid).tolist(), strict=True):
                lang[i], score[i], least[i] = model.langs[best], c, model.floors[best, band]
            at += n
        trim()
        rejected = [k == "und" or s < f for k, s, f in zip(lang, score, least, strict=True)]
        return pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(score), pa.array(rejected, pa.bool_())], ["lang", "score", "rejected"])

    return run


def identify(docs: DataFrame, fold: int = 1, folds: int = 3) -> DataFrame:
    """docs (doc_id, text, lang and any more columns) with held_out, lang_pred, score and rejected.

    Learns from rows outside the held-out fold (crc32 of doc_id modulo folds) only; lang, source and doc_id are no
    inputs of a prediction. Cases: null text or one without letters is ``und``, score 0, rejected; without anything
    to learn from all are; null lang is predicted, not learnt from; repeated rows count each; columns held_out, lang_pred, score
    and rejected in docs are replaced.
    """
    docs = docs.drop("held_out", "lang_pred", "score", "rejected").withColumn("held_out", crc_mod("doc_id", folds) == fold)
    model = train(docs.where(~F.col("held_out")))
    keep = [c for c in docs.columns]
    said = spare("_said", docs)
    return docs.withColumn(said, classify(model)("text")).select(*keep, *[F.col(said)[a].alias(b) for a, b in (("lang", "lang_pred"), ("score", "score"), ("rejected", "rejected"))])


def op9_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    return identify(docs).select("doc_id", "held_out", "lang_pred", "score", "rejected")
