"""Toxicity by weak supervision: lexicon and pattern voters, a generative label model, a linear classifier."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, materialize, remainder, text_of

# A short list of English insults.
SEED = ("bastard", "clown", "coward", "disgusting", "fool", "garbage", "idiot", "imbecile", "liar", "loser", "moron", "pathetic", "scum", "stupid", "trash", "vermin", "worthless")
#: Bound of the training: about so many labelled documents.
MAX_LABELLED = 8_000
#: A feature is telling so many standard deviations above what chance gives; the sample bounds how many are. Which of these
#: is taken is decided by the training rows alone, see choose().
CUTOFFS = (3.0, 4.0, 5.0, 6.0, 8.0)
#: One of so many training rows is set aside for that choice.
ASIDE = 4
#: What a toxic document counts against a clean one, of which there are many more.
MISSED = 2.0
LEXICONS = 24
PREFIXES = (4, 5, 6, 7, 8)
WORD = re.compile(r"[^\W\d_]+")
PATTERNS = tuple(re.compile(p) for p in (r"!{2,}", r"\b[^\W\d_][*#@$%]+[^\W\d_]", r"(?i)\byou(?:'re| are)? (?:a |an |such )", r"[A-Z]{4,}\W+[A-Z]{4,}\W+[A-Z]{4,}", r"(?i)\b(?:shut up|go away|hate (?:you|them))\b"))
CACHE = 400_000


def word_features(word: str) -> list[str]:
    return ["=" + word, *["^" + word[:k] for k in PREFIXES if len(word) > k]]


def distinct_words(text: str) -> set[str]:
    return set(WORD.findall(text.lower()))


class Scorer:
    """features: word features in order; weights: of the features, then of dense(): all linear, over presence."""

    def __init__(self, features: list[str]) -> None:
        self.index = {f: k for k, f in enumerate(features)}
        self.seed = frozenset(SEED)
        self.cache: dict[str, tuple[int, ...]] = {}

    def read(self, own: set[str]) -> tuple[set[int], list[float]]:
        """Of a text's distinct words: the features present, and dense ones: a constant, words with any feature (one, two,
        more), those a word, the length, the seed list."""
        found: set[int] = set()
        hits = 0
        for w in own:
            f = self.cache.get(w)
            if f is None:
                if len(self.cache) > CACHE:
                    self.cache.clear()
                f = self.cache[w] = tuple(self.index[x] for x in word_features(w) if x in self.index)
            if f:
                hits += 1
                found.update(f)
        return found, [1.0, float(hits > 0), float(hits > 1), float(np.log1p(hits)), hits / (1.0 + len(own)) ** 0.5, float(np.log1p(len(own))) / 5, float(not self.seed.isdisjoint(own))]


def votes(features: list[str], found: set[int], dense: list[float], patterns: list[bool]) -> list[bool]:
    """The voters: lexicons (features by a hash, each votes if it has an entry in the text), the seed list, patterns."""
    out = [False] * LEXICONS
    for k in found:
        out[zlib.crc32(features[k].encode()) % LEXICONS] = True
    return [*out, dense[-1] > 0, *patterns]


def label_model(v: np.ndarray, gold: np.ndarray, rounds: int = 60) -> np.ndarray:
    """Posterior chance of the hidden label for rows of votes. Each voter fires with its own chance under either label;
    the given labels are one more voter whose accuracy is estimated like the others', and their share of ones is the
    label's. The start is the rows with most votes, as many as that share. Voters that agree beyond what the label
    explains share their evidence: each counts by 1 / (1 + sum of its positive correlations given the label)."""
    x, prior = np.column_stack([v, gold]).astype(float), np.clip(gold.mean(), 1e-3, 1 - 1e-3)
    n = v.sum(axis=1)
    q = np.where(n >= max(1, np.quantile(n, 1 - prior)), 0.9, 0.1)
    weight = np.ones(x.shape[1])
    for k in range(rounds):
        p1 = (q @ x + 0.5) / (q.sum() + 1)
        p0 = ((1 - q) @ x + 0.5) / ((1 - q).sum() + 1)
        if k % 10 == 5:
            centred = x - (q[:, None] * p1 + (1 - q)[:, None] * p0)
            scale = np.sqrt((centred**2).mean(axis=0)) + 1e-9
            corr = (centred.T @ centred) / len(x) / np.outer(scale, scale)
            np.fill_diagonal(corr, 0)
            weight = 1 / (1 + np.maximum(corr, 0).sum(axis=1))
        log_odds = np.log(prior / (1 - prior)) + (x * np.log(p1 / p0) + (1 - x) * np.log((1 - p1) / (1 - p0))) @ weight
        q = 1 / (1 + np.exp(-np.clip(log_odds, -30, 30)))
    return q


def logistic(row: np.ndarray, column: np.ndarray, k: int, dense: np.ndarray, q: np.ndarray, penalty: float = 2e-4, steps: int = 400, missed: float = MISSED) -> np.ndarray:
    """Weights of a logistic regression on soft labels, by Adam over the whole sample; (row, column) tell which of
    k features are present, dense are the others."""
    share = np.where(q > 0.5, missed, 1.0)
    n = len(q)
    w, m, s = np.zeros(k + dense.shape[1]), 0.0, 0.0
    for step in range(1, steps + 1):
        z = np.bincount(row, w[column], n) + dense @ w[k:]
        error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - q) * share / n
        g = np.concatenate([np.bincount(column, error[row], k), dense.T @ error]) + penalty * w
        m, s = 0.9 * m + 0.1 * g, 0.999 * s + 0.001 * g * g
        w = w - 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
    return w


class Model(NamedTuple):
    """features, weights: see Scorer; cutoff: of the telling features; tried: the loss of each cutoff on the rows set aside,
    empty if these rows or the others lack a class; plain: the loss there of the chosen cutoff's classifier if it learns from
    the given labels instead of the label model's."""

    features: list[str]
    weights: np.ndarray
    cutoff: float
    tried: dict[float, float]
    plain: float | None


def _sample(docs: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """(text, toxic, aside) of about MAX_LABELLED labelled documents, chosen by a hash of the key. Equal texts are set aside
    together."""
    own = labels.filter(F.col("toxic").isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("_k")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    n = own.count()
    own = own.filter(F.pmod(F.xxhash64(F.lit("toxic"), "_k"), F.lit(1_000_000)) * F.lit(float(n)) < MAX_LABELLED * 1_000_000.0)
    aside = F.pmod(F.xxhash64(F.lit("aside"), "text"), F.lit(ASIDE)) == 0
    return docs.select(F.col(key).alias("_k"), text_of().alias("text")).join(own, "_k").select("text", "toxic", aside.alias("aside"))


def _telling(sample: DataFrame) -> list[tuple[str, float, float]] | None:
    """(feature, z over all rows, z over the rows not set aside) of features above the least cutoff in either, in order; a z
    that does not count is -1. None if the labels do not have both classes."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            sums = [Counter[str]() for _ in range(4)]  # rows and toxic rows, of all and of those not set aside
            for text, toxic, aside in zip(pdf["text"], pdf["toxic"], pdf["aside"], strict=True):
                own = {f for w in distinct_words(text) for f in word_features(w)}
                for counter, counts in zip(sums, (True, toxic, not aside, toxic and not aside), strict=True):
                    if counts:
                        counter.update(own)
            yield pd.DataFrame({"f": list(sums[0]), **{c: [s[f] for f in sums[0]] for c, s in zip(("n", "t", "fn", "ft"), sums, strict=True)}})

    fit = F.when(~F.col("aside"), F.col("toxic"))
    size, toxic, fit_size, fit_toxic = (x or 0 for x in sample.agg(F.count("*"), F.sum("toxic"), F.count(fit), F.sum(fit)).first())
    if not 0 < toxic < size:
        return None

    def z(n: str, t: str, p: float) -> Column:
        counts = (F.col(t) >= 2) & (F.col(t) >= 0.5 * F.col(n))
        return F.when(counts, (F.col(t) - F.col(n) * p) / F.sqrt(F.col(n) * (p * (1 - p)))).otherwise(-1.0) if 0 < p < 1 else F.lit(-1.0)

    sums = sample.mapInPandas(count, "f string, n long, t long, fn long, ft long").groupBy("f").agg(*[F.sum(c).alias(c) for c in ("n", "t", "fn", "ft")])
    both = sums.select("f", z("n", "t", toxic / size).alias("z"), z("fn", "ft", fit_toxic / max(fit_size, 1)).alias("fz"))
    return sorted((r["f"], r["z"], r["fz"]) for r in both.filter(F.greatest("z", "fz") > min(CUTOFFS)).collect())


class Read(NamedTuple):
    """What one list of features finds in the rows of the sample; (row, column) tell which features are present."""

    row: np.ndarray
    column: np.ndarray
    k: int
    dense: np.ndarray
    votes: np.ndarray
    toxic: np.ndarray

    def take(self, rows: np.ndarray) -> Read:
        """The rows of a mask."""
        at, has = np.cumsum(rows) - 1, rows[self.row]
        return Read(at[self.row[has]], self.column[has], self.k, self.dense[rows], self.votes[rows], self.toxic[rows])

    def fit(self, q: np.ndarray) -> np.ndarray:
        return logistic(self.row, self.column, self.k, self.dense, q)

    def loss(self, w: np.ndarray) -> float:
        """Mean of what logistic() minimises, against the given labels."""
        z = np.bincount(self.row, w[self.column], len(self.toxic)) + self.dense @ w[self.k :]
        p = np.clip(1 / (1 + np.exp(-np.clip(z, -30, 30))), 1e-9, 1 - 1e-9)
        return float(-(np.where(self.toxic > 0, MISSED * np.log(p), np.log(1 - p))).mean())


def _read(sample: DataFrame, lists: list[list[str]]) -> tuple[list[Read], np.ndarray]:
    """What each of the lists of features finds in the sample, whose size is bounded, and which rows are set aside."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorers = [Scorer(features) for features in lists]
        for pdf in batches:
            rows = []
            for text, label, aside in zip(pdf["text"], pdf["toxic"], pdf["aside"], strict=True):
                own, patterns = distinct_words(text), [bool(p.search(text)) for p in PATTERNS]
                for which, (scorer, features) in enumerate(zip(scorers, lists, strict=True)):
                    found, dense = scorer.read(own)
                    rows.append((which, aside, sorted(found), dense, votes(features, found, dense, patterns), label))
            yield pd.DataFrame(rows, columns=["which", "aside", "found", "dense", "votes", "toxic"])

    told = sample.mapInPandas(read, "which int, aside boolean, found array<int>, dense array<double>, votes array<boolean>, toxic int").toPandas()
    out = []
    for which, features in enumerate(lists):
        own = told[told["which"] == which]
        row = np.repeat(np.arange(len(own)), [len(f) for f in own["found"]])
        column = np.array([k for f in own["found"] for k in f], np.int64)
        out.append(Read(row, column, len(features), np.array(own["dense"].tolist()), np.array(own["votes"].tolist(), bool), own["toxic"].to_numpy()))
    return out, told["aside"].to_numpy(bool)[(told["which"] == 0).to_numpy()]


def choose(sample: DataFrame, telling: list[tuple[str, float, float]]) -> tuple[float, dict[float, float], float | None]:
    """The cutoff of the least loss on the rows set aside, the greatest of equals: for each cutoff features, label model and
    classifier are learned from the other rows. See Model for the rest."""
    reads, aside = _read(sample, [[f for f, _, z in telling if z > c] for c in CUTOFFS])
    if any(len(set(reads[0].toxic[m])) < 2 for m in (aside, ~aside)):
        return max(CUTOFFS), {}, None
    tried = {}
    for c, r in zip(CUTOFFS, reads, strict=True):
        known = r.take(~aside)
        tried[c] = r.take(aside).loss(known.fit(label_model(known.votes, known.toxic)))
    best = min(CUTOFFS, key=lambda c: (tried[c], -c))
    r = reads[CUTOFFS.index(best)]
    known = r.take(~aside)
    return best, tried, r.take(aside).loss(known.fit(known.toxic.astype(float)))


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id") -> Model | None:
    """A model of labelled documents, all choices included; None if the labels do not have both classes."""
    sample = materialize(_sample(docs, labels, key), "toxic")
    telling = _telling(sample)
    if telling is None:
        return None
    cutoff, tried, plain = choose(sample, telling)
    features = [f for f, z, _ in telling if z > cutoff]
    (r,), _ = _read(sample, [features])
    return Model(features, r.fit(label_model(r.votes, r.toxic)), cutoff, tried, plain)


def score(docs: DataFrame, model: Model | None, keep: list[str], name: str = "score") -> DataFrame:
    """The columns keep of docs (.., text) and the score; a null text counts as empty. Without a model all scores are 0."""
    columns = list(dict.fromkeys([*keep, "text"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, weights = (model.features, model.weights) if model else ([], np.zeros(7))
        scorer, own = Scorer(features), weights.astype(float).tolist()
        tail = own[len(features) :]
        for batch in batches:
            out = np.zeros(batch.num_rows)
            for k, text in enumerate(batch.column(columns.index("text")).to_pylist()):
                found, dense = scorer.read(distinct_words(text or ""))
                out[k] = sum(own[f] for f in sorted(found)) + sum(a * b for a, b in zip(tail, dense, strict=True))
            chance = 1 / (1 + np.exp(-np.clip(out, -30, 30))) if model else out
            yield pa.RecordBatch.from_arrays([*(batch.column(columns.index(c)) for c in keep), pa.array(chance)], [*(f"c{k}" for k in range(len(keep))), "score"])

    # numbered on the way: mapInArrow takes no names with dots
    kinds = ", ".join(f"c{k} {docs.schema[c].dataType.simpleString()}" for k, c in enumerate(keep))
    numbered = docs.select(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(columns)])
    return numbered.mapInArrow(run, f"{kinds}, score double").toDF(*keep, name)


def held_out(key: Column) -> Column:
    return remainder(key, 3) == 1


def toxicity(docs: DataFrame, labels: DataFrame, key: str = "doc_id", threshold: float = 0.7) -> DataFrame:
    """key, held_out, score, predicted: learned from the labels that are not held out, applied to all documents. Nothing is
    chosen by the labels held out.

    Null and empty texts get the score of a text without words; conflicting labels of a key count as toxic; null keys
    have no label; rows with an equal key each give a row; without labels of both kinds all scores are 0; no documents
    give no rows."""
    model = train(docs, labels.filter(~held_out(F.col(key))), key)
    out = score(docs, model, [key])
    return out.select(key, held_out(F.col(key)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame, key: str = "doc_id", threshold: float = 0.7) -> DataFrame:
    """The rows of docs that are not predicted toxic, with all their columns; see toxicity()."""
    model = train(docs, labels.filter(~held_out(F.col(key))), key)
    name = free_name(docs, "_toxicity")
    return score(docs, model, docs.columns, name).filter(F.col(name) < threshold).drop(name)
