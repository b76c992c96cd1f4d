"""Quality classification: document evidence joined with host and path posteriors that shrink sparse sites."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lean, small, spare, stored, tidy, trim
from .words import blocks

_KIND = np.zeros(256, np.uint8)
_KIND[[9, 10, 11, 12, 13, 32]] = 0
_KIND[33:127] = 3
_KIND[48:58] = 2
_KIND[65:91] = 4
_KIND[97:123] = 1
_KIND[128:] = 1
_STOPS = np.zeros(256, bool)
_STOPS[list(b".,;:?!'\"-()")] = True
_TINY = 1e-6
#: The largest prior, in documents: sites whose means differ by no more than chance explains say nothing.
PRIORS = 1e6


def features(texts: list[bytes | None]) -> np.ndarray:
    """A row of numbers per text: length, letter case, symbols, digits, repetition, word lengths. Whole texts are read."""
    out = [np.zeros((0, 10))]
    for lo, hi, b in blocks(texts):
        raw = [t or b"" for t in texts[lo:hi]]
        n = hi - lo
        whole = np.frombuffer(b" ".join(raw) + b" ", np.uint8)
        size = np.array([len(t) + 1 for t in raw])
        begin = np.concatenate([[0], np.cumsum(size)[:-1]])
        kind = _KIND[whole]
        share = lambda m: np.add.reduceat(m, begin, dtype=np.int64) / size
        words = np.diff(b.first)
        some = np.maximum(words, 1)
        per_word = lambda m: np.bincount(b.doc, weights=m, minlength=n) / some
        same = np.zeros(len(b.hash), bool)
        same[1:] = (b.hash[1:] == b.hash[:-1]) & (b.doc[1:] == b.doc[:-1])
        order = np.lexsort((b.hash, b.doc))
        new = np.ones(len(order), bool)
        new[1:] = (b.hash[order][1:] != b.hash[order][:-1]) | (b.doc[order][1:] != b.doc[order][:-1])
        distinct = np.bincount(b.doc[order][new], minlength=n)
        last = b.data[np.maximum(b.end - 1, 0)]
        odd = (kind == 3) & ~_STOPS[whole]
        out.append(np.column_stack([
            np.log1p(words), share(kind == 4), share(odd), share(kind == 2), share((kind == 3) & _STOPS[whole]), per_word(same),
            np.log(np.maximum(distinct, 1)) / np.log(np.maximum(words, 2)), per_word(np.minimum(b.end - b.start, 40)) / 10,
            per_word((_KIND[last] == 3) & ~_STOPS[last]), per_word(b.end - b.start == 1),
        ]))
    return np.concatenate(out)


@dataclass(frozen=True)
class Logistic:
    """Standardised features, their squares too, and weights; weights[0] is the constant."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    def design(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.column_stack([np.ones(len(z)), z, z * z])

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.design(x) @ self.weights, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> Logistic:
    """Ridge logistic regression by Newton's method; without both classes the model says the smoothed share everywhere."""
    mean, scale = (x.mean(0), np.maximum(x.std(0), 1e-3)) if len(x) else (np.zeros(10), np.ones(10))
    model = Logistic(mean, scale, np.zeros(2 * len(mean) + 1))
    if not len(y) or not 0 < y.mean() < 1:
        share = (y.sum() + 1) / (len(y) + 1.5)
        model.weights[0] = np.log(share / max(1 - share, 1e-3))
        return model
    d, w = model.design(x), model.weights
    penalty = np.full(len(w), ridge)
    penalty[0] = _TINY
    for _ in range(30):
        p = model.probability(x)
        step = np.linalg.solve((d * (p * (1 - p))[:, None]).T @ d + np.diag(penalty), d.T @ (y - p) - penalty * w)
        w += step * min(1.0, 4 / max(np.abs(step).max(), 1e-9))
        if np.abs(step).max() < 1e-6:
            break
    return model


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = 20_000) -> Logistic:
    """The document classifier, fitted on about sample_rows labelled documents at most, chosen by a hash of doc_id."""
    known = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.avg("quality").alias("quality"))
    share = min(1.0, sample_rows / max(known.count(), 1))
    chosen = known.where(F.pmod(F.xxhash64("doc_id", F.lit("quality")), F.lit(1 << 30)) < int(share * (1 << 30)))

    def measure(batches):
        for batch in batches:
            x = features(batch.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.list_(pa.float64())), batch.column(1)], names=["x", "quality"])

    rows = docs.select("doc_id", F.col("text").cast("binary").alias("text")).join(small(chosen), "doc_id").select("text", "quality").mapInArrow(tidy(measure), "x array<double>, quality double").collect()
    rows = sorted((tuple(r["x"]), r["quality"]) for r in rows)
    return fit(np.array([r[0] for r in rows]).reshape(-1, 10), np.array([r[1] for r in rows]) >= 0.5)


def evidence(model: Logistic):
    """A column function: the probability that a text (as binary) is good, from the text alone.

    It is called nondeterministic so that Spark works it out once: a filter on it would else be given a second one, of nulls, with
    Python workers of its own in each task, which live on and keep what later stages load.
    """

    @F.arrow_udf("double")
    def run(text: pa.Array) -> pa.Array:
        p = np.clip(model.probability(features(text.to_pylist())), _TINY, 1 - _TINY)
        trim()
        return pa.array(p)

    return run.asNondeterministic()


def _logit(p: Column) -> Column:
    return F.log(p / (F.lit(1.0) - p))


def posteriors(scored: DataFrame) -> DataFrame:
    """What each (host, path) of scored (host, path, p) has for shrinking, and what all have in common.

    Per path n documents with the sum s of p, per host hn and hs; globally the mean global_quality and the priors of the
    two levels, counted in documents: host_prior for hosts around the global mean, path_prior for paths around their host's.
    A prior is the variance of p within sites over the variance between them (method of moments: the spread of site means
    less what the variance within explains), from 1 to PRIORS. Sums per (host, path) come first; everything later works on
    one row per path.
    """
    p = F.col("p")
    paths = scored.groupBy("host", "path").agg(F.count(p).alias("n"), F.sum(p).alias("s"), F.sum(p * p).alias("q"))
    hosts = paths.groupBy("host").agg(F.sum("n").alias("hn"), F.sum("s").alias("hs"), F.sum("q").alias("hq"))
    mean, host_mean = F.col("ts") / F.col("tn"), F.col("hs") / F.col("hn")
    total = hosts.agg(F.sum("hn").alias("tn"), F.sum("hs").alias("ts"), F.try_divide(F.sum(F.col("hq") - F.col("hs") * host_mean), F.sum(F.col("hn") - 1)).alias("hw"))
    between = hosts.crossJoin(F.broadcast(total)).agg(F.first(mean).alias("global_quality"), F.first("hw").alias("hw"), F.avg(F.pow(host_mean - mean, 2) - F.coalesce("hw", F.lit(0.0)) / F.col("hn")).alias("hv"))
    sites = paths.withColumnRenamed("host", "_host").join(hosts.drop("hq"), F.col("_host").eqNullSafe(F.col("host"))).drop("_host")
    path_mean = F.col("s") / F.col("n")
    within = sites.agg(F.try_divide(F.sum(F.col("q") - F.col("s") * path_mean), F.sum(F.col("n") - 1)).alias("pw"))
    inner = sites.crossJoin(F.broadcast(within)).agg(F.first("pw").alias("pw"), F.avg(F.pow(path_mean - host_mean, 2) - F.coalesce("pw", F.lit(0.0)) * (1 / F.col("n") - 1 / F.col("hn"))).alias("pv"))

    def prior(w: str, v: str) -> Column:
        return F.when(F.col(v) > 0, F.greatest(F.lit(1.0), F.least(F.lit(PRIORS), F.coalesce(w, F.lit(0.0)) / F.col(v)))).otherwise(PRIORS)

    level = between.crossJoin(F.broadcast(inner)).select("global_quality", prior("hw", "hv").alias("host_prior"), prior("pw", "pv").alias("path_prior"))
    return sites.crossJoin(F.broadcast(level)).select("host", "path", "n", "s", "hn", "hs", "global_quality", "host_prior", "path_prior")


def classify(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", threshold: float = 0.5, sample_rows: int = 20_000, with_text: bool = True) -> DataFrame:
    """docs with text_quality, host_quality, path_quality, quality and keep (quality at least threshold).

    quality: the text's log odds plus what its path's posterior adds to the global log odds. host_quality and path_quality
    are posteriors from all other documents of the host and the path; the document itself is left out, as its own evidence
    counts already. Cases: null text counts as empty; null host or path is a value of its own; a document alone on its host
    takes the global mean; unlabelled documents are scored like others, and without labels of both classes
    the classifier is constant and keeps all, whatever the threshold; several labels of a document count by their mean,
    repeated rows each; an empty table gives an empty one; columns of docs with the new columns' names are replaced. with_text
    false leaves text out of the result, and texts are then read only once.
    """
    new = ["text_quality", "host_quality", "path_quality", "quality", "keep"]
    docs = lean(docs.drop(*new))
    model = train(docs, labels, sample_rows)
    scored = docs.withColumn("text_quality", evidence(model)(F.col("text").cast("binary")))
    if not with_text:
        docs = docs.drop("text")
        scored = stored(scored.drop("text"), "scored")
    narrow = scored.select(F.col(host).alias("host"), F.col(path).alias("path"), F.col("text_quality").alias("p"))
    sites = posteriors(narrow if not with_text else stored(narrow, "scored"))
    names = {c: spare(f"_{c}", docs) for c in sites.columns}
    sites = small(sites.select(*[F.col(c).alias(x) for c, x in names.items()]))
    joined = scored.join(sites, scored[host].eqNullSafe(F.col(names["host"])) & scored[path].eqNullSafe(F.col(names["path"])), "left")
    n, s, hn, hs, mean, host_prior, path_prior = (F.col(names[c]) for c in ("n", "s", "hn", "hs", "global_quality", "host_prior", "path_prior"))
    p = F.col("text_quality")
    shrunk = lambda total, count, prior, to: F.least(F.greatest((total - p + prior * to) / (count - 1 + prior), F.lit(_TINY)), F.lit(1 - _TINY))
    joined = joined.withColumn("host_quality", shrunk(hs, hn, host_prior, mean))
    joined = joined.withColumn("path_quality", shrunk(s, n, path_prior, F.col("host_quality")))
    odds = _logit(p) + _logit(F.col("path_quality")) - _logit(mean)
    joined = joined.withColumn("quality", F.lit(1.0) / (F.lit(1.0) + F.exp(-odds)))
    keep = F.col("quality") >= threshold if model.weights[1:].any() else F.lit(True)
    return joined.withColumn("keep", keep).select(*docs.columns, *new)


def op6_quality_classifier(spark, sf_dir: str) -> DataFrame:
    """All documents, host by source and path by language within it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    return classify(docs, labels, with_text=False)
