"""Language identification of mixed texts: script ranges narrow the candidates of a word, byte trigrams score it, and
Viterbi with a switching penalty labels spans."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import remainder, text_of
from .textnum import U, chunks

BUCKETS = 1 << 15
#: About so many training documents of each language.
DOCS_PER_LANGUAGE = 600
#: Cost of a change of language between two words, in nats.
SWITCH = 6.0
#: Bytes of text scored at once, with up to 64 languages; with more, fewer, as each word has a score for each language.
CHUNK = 4 << 20
UNKNOWN = "und"
SPAN = ("lang", "first", "stop")
# First code point of ranges of scripts, in order; number of the script that a range belongs to.
SCRIPTS = ("latin", "greek", "cyrillic", "armenian", "hebrew", "arabic", "devanagari", "other indic", "thai", "georgian", "hangul", "kana", "han", "other")
RANGE_STARTS = np.array([0, 0x370, 0x400, 0x530, 0x590, 0x600, 0x700, 0x900, 0x980, 0xE00, 0xE80, 0x10A0, 0x1100, 0x1200, 0x1E00, 0x1F00, 0x2000, 0x2C60, 0x2C80, 0x3040, 0x3100, 0x3400, 0xA000, 0xAC00, 0xD7B0, 0xF900, 0xFB00, 0xFB1D, 0xFB50, 0xFE00, 0x20000, 0x32000])
RANGE_SCRIPTS = np.array([0, 1, 2, 3, 4, 5, 13, 6, 7, 8, 13, 9, 10, 13, 0, 1, 13, 0, 13, 11, 13, 12, 13, 10, 13, 12, 0, 4, 5, 13, 12, 13])
# Latin-1 signs, general punctuation but the joiners within words, currencies, symbols, CJK and full-width punctuation, selectors, emoji.
SIGNS = re.compile("[\u00a0-\u00a9\u00ab-\u00b4\u00b6-\u00b9\u00bb-\u00bf\u00d7\u00f7\u2000-\u200b\u200e-\u206f\u20a0-\u20cf\u2190-\u2bff\u3000-\u3004\u3008-\u3020\u3030\ufe00-\ufe0f\uff01-\uff20\U0001f000-\U0001faff]+")
LETTER = np.zeros(256, bool)
LETTER[97:123] = True
LETTER[128:] = True


def lowered(text: str) -> str:
    """The text in lower case, a space for each run of signs beyond ASCII: they are no letters of a word."""
    return text.lower() if text.isascii() else SIGNS.sub(" ", text.lower())


def letter_words(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For lower-case texts: trigram bucket of each place, first place of each word, bytes and script of each word, and
    offsets of each text's words. Words are runs of letters (bytes of a to z and of non-ASCII characters)."""
    ends_at = np.cumsum([len(r) + 1 for r in raws])
    buf = np.frombuffer(b"\0".join(raws) + b"\0", np.uint8)
    letter = LETTER[buf]
    c = np.where(letter, buf, 0).astype(np.uint32)
    before = np.concatenate([[0], c[:-1]]).astype(np.uint32)
    two = np.concatenate([[0], before[:-1]]).astype(np.uint32)
    two[before == 0] = 0
    place = letter.copy()
    place[1:] |= letter[:-1]
    gram = (((two << np.uint32(16)) | (before << np.uint32(8)) | c)[place].astype(U) * U(0x9E3779B97F4A7C15) >> U(49)).astype(np.int32)
    begin = letter.copy()
    begin[1:] &= ~letter[:-1]
    first = np.flatnonzero(begin)
    stop = np.flatnonzero(letter[:-1] & ~letter[1:]) + 1
    grams_before = np.cumsum(place)
    heads = grams_before[first] - 1
    code = _code_points(buf, first)
    script = RANGE_SCRIPTS[np.searchsorted(RANGE_STARTS, code, side="right") - 1]
    return gram, heads, stop - first, script, np.concatenate([[0], np.searchsorted(first, ends_at)])


def _code_points(buf: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The code points that start at these bytes of UTF-8."""
    padded = np.concatenate([buf, np.zeros(3, np.uint8)]).astype(np.int64)
    a, b, c, d = (padded[at + k] for k in range(4))
    return np.where(a < 0x80, a, np.where(a < 0xE0, (a & 31) << 6 | b & 63, np.where(a < 0xF0, (a & 15) << 12 | (b & 63) << 6 | c & 63, (a & 7) << 18 | (b & 63) << 12 | (c & 63) << 6 | d & 63)))


class Model:
    """languages in code point order; log probability of a bucket under each; whether a language uses a script."""

    def __init__(self, counts: pd.DataFrame) -> None:
        self.languages = sorted(counts["lang"].unique())
        row = counts["lang"].map({x: k for k, x in enumerate(self.languages)}).to_numpy(np.int64)
        code, n = counts["code"].to_numpy(np.int64), counts["n"].to_numpy(float)
        seen = np.zeros((len(self.languages), BUCKETS))
        scripts = np.zeros((len(self.languages), len(SCRIPTS)))
        grams = code >= 0
        seen[row[grams], code[grams]] = n[grams]
        scripts[row[~grams], -1 - code[~grams]] = n[~grams]
        self.log_p = np.log((seen + 0.1) / (seen.sum(axis=1, keepdims=True) + 0.1 * BUCKETS)).astype(np.float32)
        self.uses = scripts >= 0.01 * scripts.sum(axis=1, keepdims=True)
        self.uses[:, ~self.uses.any(axis=0)] = True  # a script that no language uses narrows nothing

    def scores(self, gram: np.ndarray, heads: np.ndarray, script: np.ndarray) -> np.ndarray:
        """Log probability of each word under each language that uses its script; the others are no candidates: -inf."""
        out = np.full((len(heads), len(self.languages)), -np.inf, np.float32)
        sizes = np.diff(heads, append=len(gram))
        for s in np.unique(script):
            words = np.flatnonzero(script == s)
            ends = np.cumsum(sizes[words])
            first = ends - sizes[words]
            own = gram if len(words) == len(heads) else gram[np.repeat(heads[words] - first, sizes[words]) + np.arange(ends[-1])]
            for k in np.flatnonzero(self.uses[:, s]):
                out[words, k] = np.add.reduceat(self.log_p[k][own], first)
        return out


def viterbi(scores: np.ndarray, offsets: np.ndarray, penalty: float = SWITCH) -> np.ndarray:
    """The label of each word: for each text the labels of the greatest sum of scores less penalty for each change. All
    texts advance together, a word a step; texts go in order of their length, so that those not over are in front."""
    sizes = np.diff(offsets)
    order = np.argsort(-sizes, kind="stable")
    begin, sizes = offsets[:-1][order], sizes[order]
    longest = int(sizes[0]) if len(sizes) else 0
    live = np.searchsorted(-sizes, -np.arange(longest), side="left")
    total = np.zeros((len(sizes), scores.shape[1]))
    back = np.zeros(scores.shape, np.int16)
    own = np.arange(scores.shape[1], dtype=np.int16)
    for t in range(longest):
        n = live[t]
        v, rows = total[:n], begin[:n] + t
        best = v.argmax(axis=1)
        change = v[np.arange(n), best][:, None] - penalty
        back[rows] = np.where(v >= change, own, best[:, None].astype(np.int16))
        np.maximum(v, change, out=v)
        v += scores[rows]
    state = total.argmax(axis=1)
    out = np.zeros(len(scores), np.int16)
    for t in range(longest - 1, -1, -1):
        n = live[t]
        rows = begin[:n] + t
        out[rows] = state[:n]
        state[:n] = back[rows, state[:n]]
    return out


def train(docs: DataFrame, lang: str = "lang", key: str = "doc_id") -> Model | None:
    """A model of docs (key, text, lang): about DOCS_PER_LANGUAGE documents of each language, chosen by a hash of the
    key and counted on the executors; the counts of a language have a bounded size."""
    named = docs.filter(F.col(lang).isNotNull())
    sizes = named.groupBy(F.col(lang).alias("_lang")).count()
    # broadcast: a row a language, each of which takes 128 KB of the model on the driver and in each task anyway
    chosen = named.join(F.broadcast(sizes), F.col(lang) == F.col("_lang"))
    chosen = chosen.filter(F.pmod(F.xxhash64(F.lit("langid"), key), F.lit(1_000_000)) * F.col("count") < DOCS_PER_LANGUAGE * 1_000_000.0)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for language, part in pdf.groupby("_lang"):
                for _, _, raws in chunks([lowered(t) for t in part["text"]], CHUNK):
                    gram, _, size, script, _ = letter_words(raws)
                    n, s = np.bincount(gram, minlength=BUCKETS), np.bincount(script, weights=size, minlength=len(SCRIPTS)).astype(np.int64)
                    code = np.concatenate([np.flatnonzero(n), -1 - np.flatnonzero(s)])
                    yield pd.DataFrame({"lang": language, "code": code, "n": np.concatenate([n[n > 0], s[s > 0]])})

    counts = chosen.select("_lang", text_of().alias("text")).mapInPandas(count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n")).toPandas()
    return Model(counts) if len(counts) else None


def identify(docs: DataFrame, model: Model | None, key: str = "doc_id", with_spans: bool = False) -> DataFrame:
    """key, lang_pred, score, n_spans for each row of docs (key, text); with_spans adds spans, an array of (language,
    first word, word after the last) over the letter runs of the text.

    lang_pred has the most letters among the text's labelled words, the first in code point order of equals; score is
    its share. Null texts and texts without a letter are `und` with score 0, all texts if nothing was learned; rows with
    an equal key each give a row; no rows give no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, texts = batch.column(key), [t or "" for t in batch.column("text").to_pylist()]
            for a, b, raws in chunks([lowered(t) for t in texts], CHUNK * 64 // max(64, len(model.languages) if model else 0)):
                n = b - a
                names, score, spans, lists = np.full(n, UNKNOWN, object), np.zeros(n), np.zeros(n, np.int64), [[] for _ in range(n)]
                has = np.array([any(map(str.isalpha, t)) for t in texts[a:b]])
                gram, heads, size, script, offsets = letter_words(raws)
                if model and len(heads):
                    many = len(model.languages)
                    label = viterbi(model.scores(gram, heads, script), offsets)
                    doc = np.repeat(np.arange(n), np.diff(offsets))
                    share = np.bincount(doc * many + label, weights=size, minlength=n * many).reshape(n, many)
                    total = np.maximum(share.sum(axis=1), 1)
                    best = share.argmax(axis=1)
                    names[has] = np.array(model.languages, object)[best[has]]
                    score = np.where(has, share[np.arange(n), best] / total, 0.0)
                    new = np.ones(len(label), bool)
                    new[1:] = (label[1:] != label[:-1]) | (doc[1:] != doc[:-1])
                    spans = np.bincount(doc[new], minlength=n) * has
                    if with_spans:
                        at = np.flatnonzero(new)
                        for s, e in zip(at, np.append(at[1:], len(label)), strict=True):
                            if has[doc[s]]:
                                lists[doc[s]].append((model.languages[label[s]], int(s - offsets[doc[s]]), int(e - offsets[doc[s]])))
                out = {key: keys.slice(a, n), "lang_pred": pa.array(names.tolist(), pa.string()), "score": pa.array(score, pa.float64()), "n_spans": pa.array(spans, pa.int64())}
                if with_spans:
                    out["spans"] = pa.array([[dict(zip(SPAN, x, strict=True)) for x in xs] for xs in lists], pa.list_(pa.struct(list(zip(SPAN, (pa.string(), pa.int64(), pa.int64()), strict=True)))))
                yield pa.RecordBatch.from_pydict(out)

    spans = ", spans array<struct<lang: string, first: long, stop: long>>" if with_spans else ""
    return docs.select(key, "text").mapInArrow(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, lang_pred string, score double, n_spans long{spans}")


def held_out(key: Column) -> Column:
    return remainder(key, 4) == 2


def language_id(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, held_out, lang_pred, score, n_spans: learned from the documents that are not held out, applied to all.

    Rows with a null text or language teach nothing; a null key counts as the empty text in the hashes, so such rows are
    all held out or none; rows with an equal key each give a row; no documents give no rows. See identify()."""
    model = train(docs.filter(~held_out(F.col(key))), key=key)
    return identify(docs, model, key).select(key, held_out(F.col(key)).alias("held_out"), "lang_pred", "score", "n_spans")
