"""Hashed linear text classifiers: FTRL logistic regression over n-grams, and noisy-or multiple-instance learning.

Training takes a bounded sample of the labelled rows: the smallest by a hash of the id, at most ``max_rows`` of them and
at most as many as have MAX_FEATURES features together (the bounds are the only reason that a labelled row is not used).
Features are hashed on the executors and fitted in one task, so memory there is bounded by 4 bytes times MAX_FEATURES,
whatever the length of the texts. The model is a vector of fixed size, which is what the driver and the broadcast hold.
Scoring is one pass over the whole texts without a shuffle; texts of any length are scored in slices of whole texts.

Null and empty texts count as texts without words. Equal texts get equal scores; repeated labelled rows are examples as
often as they occur, and an id with two labels is one of each. Empty tables: no documents give no rows, no labels a model
without weights.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sgspark.llm import textcore as tc
from sgspark.llm.runtime import appended, map_arrow

#: Features (an occurrence of a word or n-gram) that a fit holds at most.
MAX_FEATURES = 60_000_000
#: Kinds of bytes for n-gram tokens: 1 letters, digits and bytes of other scripts, 2 other marks, 0 white space and controls.
KINDS = np.full(256, 2, dtype=np.uint8)
KINDS[:0x21] = 0
KINDS[0x7F] = 0
KINDS[0x30:0x3A] = 1
KINDS[0x41:0x5B] = 1
KINDS[0x61:0x7B] = 1
KINDS[0x80:] = 1
#: Bytes after which a sentence ends.
STOPS = np.isin(np.arange(256), [0x0A, 0x21, 0x2E, 0x3F])


def _segment_sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(values) + 1)
    np.cumsum(values, out=sums[1:])
    return sums[offsets[1:]] - sums[offsets[:-1]]


# --- quality: hashed n-grams, FTRL ---------------------------------------------------------------------------------


#: The bigram of a word that is repeated at once, whatever the word.
REPEAT = tc.keys(5, 1)[0]


def ngram_features(s: tc.Slice, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of each text's word unigrams and bigrams, and each text's offset among them."""
    starts, ends, first = s.runs(KINDS)
    words = tc.word_hashes(s.data, starts, ends)
    n = np.diff(first)
    pairs = tc.ngram_hashes(words, 2)
    doc = np.repeat(np.arange(len(n)), n)
    whole = np.flatnonzero(doc[1:] == doc[:-1])
    pairs = np.where(words[whole] == words[whole + 1], REPEAT, pairs[whole])
    ids = np.concatenate([words, pairs]) >> np.uint64(64 - bits)
    order = np.argsort(np.concatenate([doc, doc[whole]]), kind="stable")
    return ids[order].astype(np.int64), np.concatenate([[0], np.cumsum(n + np.maximum(n - 1, 0))])


def fit_ftrl(examples: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, bits: int, epochs: int = 4, alpha: float = 0.5, beta: float = 1.0, l1: float = 1e-4, l2: float = 1e-4, seed: int = 7) -> np.ndarray:
    """Follow-the-regularised-leader over sparse examples (feature numbers, values); weights, the last one the bias."""
    size = 1 << bits
    z, n = np.zeros(size + 1), np.zeros(size + 1)

    def weights(at):
        zz = z[at]
        return np.where(np.abs(zz) <= l1, 0.0, -(zz - np.sign(zz) * l1) / ((beta + np.sqrt(n[at])) / alpha + l2))

    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(examples)):
            ids, x = examples[i]
            w = weights(ids)
            p = 1 / (1 + np.exp(-np.clip(w @ x, -35, 35)))
            g = (p - labels[i]) * x
            sigma = (np.sqrt(n[ids] + g * g) - np.sqrt(n[ids])) / alpha
            z[ids] += g - sigma * w
            n[ids] += g * g
    return weights(np.arange(size + 1)).astype(np.float32)


NGRAM_SCALE = 16.0


def _ngram_example(ids: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    u, c = np.unique(ids, return_counts=True)
    return np.append(u, 1 << bits), np.append(c * (NGRAM_SCALE / max(1, len(ids))), 1.0)


def ngram_scores(s: tc.Slice, weights: np.ndarray, bits: int) -> np.ndarray:
    """Sparse dot products of relative n-gram frequencies with the weights, as probabilities. Empty texts get the bias."""
    ids, first = ngram_features(s, bits)
    mean = _segment_sums(weights[ids].astype(np.float64), first) / np.maximum(1, np.diff(first))
    return 1 / (1 + np.exp(-np.clip(mean * NGRAM_SCALE + float(weights[-1]), -35, 35)))


# --- toxicity: noisy-or over sentences -----------------------------------------------------------------------------

#: Besides a word's own hash, those of its first bytes, so many.
PREFIXES = (4, 5)
FEATURES = 1 + len(PREFIXES)


def sentence_features(s: tc.Slice, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """FEATURES features a word (its hash, and those of its first PREFIXES bytes) in order; then for each sentence with a word
    its offset among the words, its first and last byte; and for each text the offset among the sentences."""
    data = tc.LOWER[s.data]
    starts, ends, first = s.words(tc.ALNUM, data)
    words = tc.word_hashes(data, starts, ends)
    ids = np.empty((len(words), FEATURES), dtype=np.int64)
    ids[:, 0] = words >> np.uint64(64 - bits)
    for k, size in enumerate(PREFIXES, 1):
        ids[:, k] = tc.mix(tc.word_hashes(data, starts, np.minimum(ends, starts + size)) + np.uint64(k)) >> np.uint64(64 - bits)
    ends_before = np.zeros(len(data) + 1, dtype=np.int64)
    np.cumsum(STOPS[data], out=ends_before[1:])
    doc = np.repeat(np.arange(len(s)), np.diff(first))
    part = ends_before[starts]
    new = np.ones(len(starts), dtype=bool)
    new[1:] = (part[1:] != part[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    last = np.append(at[1:], len(starts)) - 1 if len(at) else at
    return ids.ravel(), np.append(at, len(starts)) * FEATURES, starts[at], ends[last] if len(at) else at, np.searchsorted(at, first)


def _softplus(z: np.ndarray) -> np.ndarray:
    return np.maximum(z, 0) + np.log1p(np.exp(-np.abs(z)))


def fit_noisy_or(bags: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, bits: int, epochs: int = 12, rate: float = 1.0, batch: int = 4, decay: float = 3e-5, min_df: float = 0.0025, bias: float = -6.0, seed: int = 7) -> np.ndarray:
    """Sentence weights from document labels: P(document) = 1 - prod(1 - P(sentence)), by Adagrad on the log loss.

    bags: (feature numbers, offsets of the sentences among them). Features of less than that share (min_df) of the
    documents, or of one, keep weight 0, as
    they'd only memorise them. Returns the weights, the last one the bias.
    """
    size = 1 << bits
    w, seen = np.zeros(size), np.full(size, 1e-8)
    b, seen_b = bias, 1e-8
    rng = np.random.default_rng(seed)
    bags_n = np.array([len(o) - 1 for _, o in bags])
    usable = np.flatnonzero(bags_n > 0)
    df = np.zeros(size, dtype=np.int64)
    for ids, _ in bags:
        df[np.unique(ids)] += 1
    known = df >= max(2, min_df * len(bags))
    for _ in range(epochs):
        order = rng.permutation(usable)
        for k in range(0, len(order), batch):
            rows = order[k : k + batch]
            ids = np.concatenate([bags[i][0] for i in rows])
            lens = np.concatenate([np.diff(bags[i][1]) for i in rows])
            sent = np.concatenate([[0], np.cumsum(lens)])
            docs = np.concatenate([[0], np.cumsum(bags_n[rows])])
            z = _segment_sums(w[ids], sent) + b
            p = 1 / (1 + np.exp(-np.clip(z, -35, 35)))
            none = np.exp(np.maximum(-_segment_sums(_softplus(z), docs), -60))
            y = labels[rows]
            push = np.where(y > 0, -none / np.maximum(1 - none, 1e-6), 1.0)
            g = p * np.repeat(push, bags_n[rows])
            u, inv = np.unique(ids, return_inverse=True)
            gu = np.bincount(inv, weights=np.repeat(g, lens), minlength=len(u)) / len(rows) + decay * w[u]
            seen[u] += gu * gu
            w[u] -= np.where(known[u], rate * gu / np.sqrt(seen[u]), 0.0)
            gb = g.sum() / len(rows)
            seen_b += gb * gb
            b -= 0.1 * gb / np.sqrt(seen_b)
    return np.append(w, b).astype(np.float32)


def noisy_or_scores(s: tc.Slice, weights: np.ndarray, bits: int, offending: float) -> tuple[np.ndarray, list[list[dict]]]:
    """Each text's probability, and its sentences of probability >= offending with offsets in code points. No sentences: 0."""
    ids, sent, start, end, docs = sentence_features(s, bits)
    z = _segment_sums(weights[ids].astype(np.float64), sent) + float(weights[-1])
    p = 1 / (1 + np.exp(-np.clip(z, -35, 35)))
    score = 1 - np.exp(-_segment_sums(_softplus(np.clip(z, -35, 35)), docs))
    spans: list[list[dict]] = [[] for _ in range(len(s))]
    bad = np.flatnonzero(p >= offending)
    if len(bad):
        chars = np.zeros(len(s.data) + 1, dtype=np.int64)
        np.cumsum((s.data & 0xC0) != 0x80, out=chars[1:])
        of = np.searchsorted(docs, bad, side="right") - 1
        base = chars[s.offsets[of]]
        for d, a, e, q in zip(of, chars[start[bad]] - base, chars[end[bad]] - base, p[bad], strict=True):
            spans[d].append({"start": int(a), "end": int(e), "score": float(q)})
    return np.clip(score, 0.0, 1.0), spans


# --- fitting on a bounded sample ------------------------------------------------------------------------------------


def train_rows(labels: DataFrame, column: str, take, max_rows: int) -> DataFrame:
    """(id, label) of at most max_rows labelled rows: those for which ``take`` holds, the smallest by a hash of the id.
    Null ids and null labels are left out; take is a condition on doc_id."""
    rows = labels.select(F.col("doc_id").alias("_id"), F.col(column).cast("int").alias("_y")).where("_id is not null and _y is not null").where(take(F.col("_id")))
    return rows.orderBy(F.xxhash64("_id"), "_id", "_y").limit(max_rows)


def _packed(ids: np.ndarray, offsets: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez(out, ids=ids.astype(np.int32), offsets=offsets.astype(np.int32))
    return out.getvalue()


def fit(docs: DataFrame, labels: DataFrame, column: str, kind: str, take, bits: int, max_rows: int) -> np.ndarray:
    """Weights fitted to labels.<column> of the documents; kind 'ngram' (FTRL) or 'noisy-or'. No usable rows: a model
    without weights, whose bias stands for 'unlikely' (-6)."""
    rows = F.broadcast(train_rows(labels, column, take, max_rows))
    most = MAX_FEATURES
    joined = docs.select(F.col("doc_id").alias("_id"), F.col("text").alias("_text")).join(rows, "_id").select("_id", "_y", "_text")

    def features(s: tc.Slice):
        if kind == "ngram":
            ids, first = ngram_features(s, bits)
            return [[_packed(ids[first[i] : first[i + 1]], np.zeros(0)) for i in range(len(s))]]
        ids, sent, _, _, docs_at = sentence_features(s, bits)
        return [[_packed(ids[sent[docs_at[i]] : sent[docs_at[i + 1]]], sent[docs_at[i] : docs_at[i + 1] + 1] - sent[docs_at[i]]) for i in range(len(s))]]

    feats = appended(joined, "_text", features, "_f binary").select("_id", "_y", "_f")

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for batch in batches:
            for i, label, body in zip(*(batch.column(k) for k in range(3)), strict=True):
                if held > most:
                    break
                x = np.load(io.BytesIO(body.as_py()))
                held += len(x["ids"])
                if held <= most or not rows:
                    rows.append((i.as_py(), label.as_py(), _ngram_example(x["ids"], bits) if kind == "ngram" else (x["ids"], x["offsets"])))
        rows.sort(key=lambda r: r[:2])
        y, bags = [r[1] for r in rows], [r[2] for r in rows]
        if bags:
            fitted = (fit_ftrl if kind == "ngram" else fit_noisy_or)(bags, np.array(y, dtype=float), bits)
            yield pa.RecordBatch.from_arrays([pa.array([fitted.tobytes()], pa.binary())], ["w"])

    # at most max_rows rows, in the order in which the sample takes them
    got = map_arrow(feats.repartition(1).sortWithinPartitions(F.xxhash64("_id"), "_id", "_y", "_f"), train, "w binary").collect()
    if not got:
        return np.append(np.zeros(1 << bits, np.float32), np.float32(-6.0))
    return np.frombuffer(got[0]["w"], dtype=np.float32)


def quality_scored(docs: DataFrame, weights: np.ndarray, bits: int, text: str = "text", score: str = "score") -> DataFrame:
    """docs with a double column ``score``: the probability of label 1. Null and empty texts get the bias's; rows and
    other columns stay, an old column of that name is replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    return appended(docs, text, lambda s: [ngram_scores(s, shared.value, bits)], f"`{score}` double")


def toxicity_scored(docs: DataFrame, weights: np.ndarray, bits: int, text: str = "text", score: str = "score", spans: str = "offending", offending: float = 0.5) -> DataFrame:
    """docs with ``score`` (the noisy-or of its sentences; 0 for null and empty texts) and ``offending``: the sentences
    of probability >= offending as (start, end, score), in code points of the whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    return appended(docs, text, lambda s: list(noisy_or_scores(s, shared.value, bits, offending)), f"`{score}` double, `{spans}` array<struct<start:int,end:int,score:double>>")
