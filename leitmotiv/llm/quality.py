"""Quality classifier with hierarchical empirical Bayes.

Evidence: two logistic regressions over shape features (cases, symbols, repetition) and the words, and beginnings of words of 4 to 6 bytes, that
tell the classes of the labelled documents apart, one for low quality and one for toxic text; a document's evidence is the probability that it is neither. They are fitted on at most
`sample` labelled documents (a bound that doesn't grow with the corpus), chosen by a hash of the id. Their features are counted over whole texts, by
batch and then in Spark; what comes to the driver of each document is its label, its shape and which of the chosen features it has.

Posteriors: the evidence of all documents is summed by host and by path within host. A host's rate of good documents is a Beta
posterior around the global rate, a path's around its host's; the priors' strengths are fitted by moments, so a site with few
documents keeps close to its parent. A document's posterior log-odds are its evidence plus its path's log-odds against the global
rate. Documents whose posterior is below `threshold` are rejected.

The texts are read once; what is written and aggregated is a row of numbers each. Sums by site are partial before the shuffle, so
a host with a third of all documents costs no more than others.

Defined results: a null or empty text has the evidence of its shape alone. A null host or path is a site of its own. Without labelled documents of
both classes, a regression says its class never occurs. Rows that repeat an id are scored each, and the least of their texts is trained on; labels that repeat one must agree, else the
worse counts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leitmotiv.llm.common import materialize, slices, utf8
from leitmotiv.llm.licenses import WORD

SAMPLE = 8000
WORDS = 160
#: Words whose features a worker remembers before it starts anew; it bounds memory and changes no result.
MEMO = 100_000
STEMS = (4, 5, 6)
SYMBOLS = (b"!", b"|", b"#", b"$", b"%", b"&", b"*", b"?", b"<")
UPPER, LOWER, DIGIT = re.compile(rb"[A-Z]"), re.compile(rb"[a-z]"), re.compile(rb"[0-9]")


def shape(text: bytes) -> list[float]:
    """Shares of letters' case, digits and symbols, and of repeated words."""
    n = max(1, len(text))
    tokens = text.split()
    m = max(1, len(tokens))
    upper, lower = len(UPPER.findall(text)), len(LOWER.findall(text))
    same = sum(a == b for a, b in zip(tokens, tokens[1:]))
    return [
        upper / max(1, upper + lower), len(DIGIT.findall(text)) / n, *[text.count(s) / m for s in SYMBOLS],
        len(set(tokens)) / m if m >= 20 else 1.0, same / m, min(30.0, n / m) / 30, float(not tokens),
    ]


def features(word: bytes) -> list[int]:
    """The word and its beginnings, as hashes of 32 bits."""
    return [xxhash.xxh32_intdigest(word), *(xxhash.xxh32_intdigest(word[:n], seed=n) for n in STEMS if n <= len(word))]


def feature_set(text: bytes) -> set[int]:
    return {f for w in set(WORD.findall(text.lower())) for f in features(w)}


@dataclass
class Regression:
    """Over standardised shapes and the presence of chosen features (by hash)."""

    words: dict[int, float]
    weights: np.ndarray
    bias: float
    centre: np.ndarray
    scale: np.ndarray

    def __call__(self, shapes: np.ndarray, words: list[set[int]]) -> np.ndarray:
        x = np.clip((shapes - self.centre) / self.scale, -8, 8)
        own = self.words
        return self.bias + x @ self.weights + np.array([sum(own[w] for w in s if w in own) for s in words])


def _association(a: Column, n1: int, b: Column, n0: int) -> Column:
    """The log-likelihood ratio (G squared) of a feature's presence in a of n1 and b of n0 documents."""
    cells = ((a, n1, a + b), (b, n0, a + b), (n1 - a, n1, n1 + n0 - a - b), (n0 - b, n0, n1 + n0 - a - b))
    return 2 * sum((F.when(x > 0, x * F.log(x * (n1 + n0) / (n * m))).otherwise(0.0) for x, n, m in cells), F.lit(0.0))


def _lists(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """All features of a batch, and which row each is of."""
    words = b.column("words")
    return np.asarray(words.flatten()), np.repeat(np.arange(b.num_rows), np.asarray(pc.list_value_length(words)))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each feature of a batch, the documents that have it: all, and those of each class."""
    for b in slices(batches):
        flat, doc = _lists(b)
        found, place = np.unique(flat, return_inverse=True)
        classes = {k: np.bincount(place, np.asarray(b.column(k))[doc], len(found)).astype(np.int64) for k in ("low", "toxic")}
        yield pa.RecordBatch.from_pydict({"f": found, "n": np.bincount(place, minlength=len(found))} | classes)


def _telling(counts: DataFrame, label: str, n1: int, n0: int, most: int = WORDS) -> list[int]:
    """The features, most at most, that tell the n1 documents of the class from the n0 others."""
    if not n1 or not n0:
        return []
    a, b = F.col(label), F.col("n") - F.col(label)
    often = counts.where((F.col("n") >= 8) & (F.abs(a / n1 - b / n0) > 0.002)).select("f", F.round(_association(a, n1, b, n0), 6).alias("score"))
    return [r["f"] for r in often.where("score > 30").orderBy(F.desc("score"), "f").limit(most).collect()]


def fit(shapes: np.ndarray, chosen: list[int], held: list[list[int]], y: np.ndarray, ridge: float = 1.0) -> Regression:
    """held: the features, of the chosen ones and others, that each document has; as signed numbers of 32 bits."""
    none = np.zeros(shapes.shape[1])
    centre, scale = (shapes.mean(0), shapes.std(0)) if len(shapes) else (none, none)
    scale = np.where(scale < 1e-9, 1.0, scale)
    if not y.any() or y.all():
        return Regression({}, np.zeros(shapes.shape[1]), 12.0 if len(y) and y.all() else -12.0, centre, scale)
    column = {f: k for k, f in enumerate(chosen)}
    present = np.zeros((len(y), len(chosen)))
    for row, features_of in enumerate(held):
        present[row, [column[f] for f in features_of if f in column]] = 1
    x = np.hstack([np.clip((shapes - centre) / scale, -8, 8), present, np.ones((len(y), 1))])
    beta = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (y - p) - penalty * beta)
        beta += step * min(1.0, 4 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-6:
            break
    k = shapes.shape[1]
    return Regression(dict(zip((f & 0xFFFFFFFF for f in chosen), beta[k:-1].tolist())), beta[:k], float(beta[-1]), centre, scale)


@dataclass
class Evidence:
    low: Regression
    toxic: Regression

    def __post_init__(self) -> None:
        self.known = self.low.words.keys() | self.toxic.words.keys()
        self.memo: dict[bytes, tuple[int, ...]] = {}

    def log_odds(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        shapes = np.array([shape(t) for t in texts]).reshape(len(texts), -1)
        memo, known, found = self.memo, self.known, []
        for t in texts:
            held: set[int] = set()
            for w in set(WORD.findall(t.lower())):
                hits = memo.get(w)
                if hits is None:
                    hits = memo[w] = tuple(f for f in features(w) if f in known)
                if hits:
                    held.update(hits)
            found.append(held)
            if len(memo) > MEMO:
                memo.clear()
        return self.low(shapes, found), self.toxic(shapes, found)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> Evidence:
    """labels: id_col, quality (1 good, 0 low), toxic (0, 1). Labels of documents that are absent, and null labels, don't count."""
    known = labels.where(F.col(id_col).isNotNull() & F.col("quality").isNotNull() & F.col("toxic").isNotNull())
    known = known.groupBy(F.col(id_col).alias("id")).agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    known = known.orderBy(F.xxhash64("id"), "id").limit(sample)

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            texts = utf8(b.column(3))
            words = pa.array([np.array(sorted(feature_set(t)), np.uint32).view(np.int32) for t in texts], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_pydict({"id": b.column(0), "low": pa.array([int(q == 0) for q in b.column(1).to_pylist()], pa.int32()), "toxic": b.column(2).cast(pa.int32()), "shape": pa.array([shape(t) for t in texts], pa.list_(pa.float64())), "words": words})

    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(known, "id").groupBy("id", "quality", "toxic").agg(F.min("text").alias("text"))
    rows = materialize(texts.select("id", "quality", "toxic", "text").mapInArrow(describe, f"id {kind}, low int, toxic int, shape array<double>, words array<int>"), "labelled")
    n, low, toxic = rows.agg(F.count("*"), F.coalesce(F.sum("low"), F.lit(0)), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    counted = rows.select("low", "toxic", "words").mapInArrow(_count, "f int, n long, low long, toxic long")
    counts = materialize(counted.groupBy("f").agg(*[F.sum(c).alias(c) for c in ("n", "low", "toxic")]).where("n >= 8"), "counts")
    chosen = {"low": _telling(counts, "low", low, n - low), "toxic": _telling(counts, "toxic", toxic, n - toxic)}
    either = np.array(sorted({f for fs in chosen.values() for f in fs}), np.int32)

    def hold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            flat, doc = _lists(b)
            kept = np.isin(flat, either)
            offsets = np.concatenate([[0], np.cumsum(np.bincount(doc[kept], minlength=b.num_rows))]).astype(np.int32)
            yield pa.RecordBatch.from_pydict({c: b.column(c) for c in ("id", "low", "toxic", "shape")} | {"held": pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat[kept], pa.int32()))})

    found = rows.mapInArrow(hold, f"id {kind}, low int, toxic int, shape array<double>, held array<int>").orderBy("id").toArrow()
    shapes = np.array(found["shape"].to_pylist()).reshape(found.num_rows, len(shape(b"")))
    held = found["held"].to_pylist()
    return Evidence(*(fit(shapes, chosen[k], held, np.asarray(found[k]).astype(bool)) for k in ("low", "toxic")))


def _logit(p: Column) -> Column:
    p = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), p))
    return F.log(p / (1 - p))


def _strength(sites: DataFrame, parent: Column) -> float:
    """The prior's strength by moments: what the sites' means vary beyond what documents within them would make them vary."""
    got = sites.where("n >= 2").agg(
        F.sum(F.col("n") * F.pow(F.col("good") / F.col("n") - parent, 2)).alias("spread"), F.sum("within").alias("within"), F.count("*").alias("sites"), F.sum("n").alias("n"), F.avg(parent).alias("p")
    ).first()
    if not got["sites"] or got["n"] <= got["sites"]:
        return 10.0
    noise = got["within"] / (got["n"] - got["sites"])
    between = max(1e-6, (got["spread"] - got["sites"] * noise) / got["n"])
    return float(min(1e4, max(1.0, got["p"] * (1 - got["p"]) / between - 1)))


def score_quality(
    docs: DataFrame, labels: DataFrame, evidence: Evidence | None = None, threshold: float = 0.5,
    id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", path_col: str = "lang",
) -> DataFrame:
    """id_col, p_low, p_toxic, evidence, host_rate, path_rate, posterior, keep for each row. evidence: a trained one, else trained here."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(evidence or train(docs, labels, id_col=id_col, text_col=text_col))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for b in slices(batches):
            low, toxic = (1 / (1 + np.exp(-np.clip(z, -30, 30))) for z in own.log_odds(utf8(b.column(3))))
            yield pa.RecordBatch.from_pydict({"id": b.column(0), "host": b.column(1), "path": b.column(2), "p_low": low, "p_toxic": toxic})
        own.memo.clear()

    base = docs.select(F.col(id_col).alias("id"), F.col(host_col).cast("string").alias("host"), F.col(path_col).cast("string").alias("path"), F.col(text_col).alias("text"))
    scored = materialize(base.mapInArrow(run, f"id {kind}, host string, path string, p_low double, p_toxic double"), "evidence")
    scored = scored.withColumn("good", (1 - F.col("p_low")) * (1 - F.col("p_toxic")))
    # Sums with partial aggregation; variance within a site: the sum of squares about its mean.
    paths = materialize(scored.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("good").alias("good"), F.sum(F.col("good") * F.col("good")).alias("squares")), "sites")
    within = F.greatest(F.lit(0.0), F.col("squares") - F.col("good") * F.col("good") / F.col("n")).alias("within")
    whole = paths.agg(F.sum("n"), F.sum("good")).first()
    rate = float((whole[1] or 0.0) / whole[0]) if whole[0] else 0.5
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("good").alias("good"), F.sum("squares").alias("squares"))
    k_host = _strength(hosts.select("n", "good", within), F.lit(rate))
    hosts = hosts.select(F.col("host").alias("h"), ((F.col("good") + k_host * rate) / (F.col("n") + k_host)).alias("host_rate"))
    nested = paths.join(hosts, F.col("host").eqNullSafe(F.col("h")))
    k_path = _strength(nested.select("n", "good", within, "host_rate"), F.col("host_rate"))
    nested = nested.select("h", F.col("path").alias("p"), "host_rate", ((F.col("good") + k_path * F.col("host_rate")) / (F.col("n") + k_path)).alias("path_rate"))
    out = scored.join(nested, F.col("host").eqNullSafe(F.col("h")) & F.col("path").eqNullSafe(F.col("p")))
    posterior = 1 / (1 + F.exp(-(_logit(F.col("good")) + _logit(F.col("path_rate")) - _logit(F.lit(rate)))))
    out = out.select(F.col("id").alias(id_col), "p_low", "p_toxic", F.col("good").alias("evidence"), "host_rate", "path_rate", posterior.alias("posterior"))
    return out.withColumn("keep", F.col("posterior") >= threshold)


def filter_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of docs that are kept, all their columns. Of rows with one id, all go if one does."""
    rejected = score_quality(docs, labels, id_col=id_col, **options).where(~F.col("keep")).select(F.col(id_col).alias("_rejected")).distinct()
    return docs.join(rejected, docs[id_col].eqNullSafe(rejected["_rejected"]), "left_anti")
