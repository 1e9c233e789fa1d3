"""Text core and classifiers."""

import re

import numpy as np
import pyarrow as pa
import pytest

from sgspark.llm import classifiers, setjoin
from sgspark.llm import textcore as tc

TEXTS = ["", "a", " a  b\tc\n", "Ünïcode wörds  end", "x" * 3000, None, "a b c a b c a b c", "one\x1ftwo three"]


@pytest.mark.parametrize("limit", [1, 10, 10_000])
def test_words_match_regex(limit):
    got, lower = [], []
    for s in tc.slices(pa.array(TEXTS), limit):
        a, b, first = s.words(tc.NOT_SPACE)
        raw = s.data.tobytes()
        words = [raw[x:y].decode() for x, y in zip(a, b)]
        got += [words[first[i] : first[i + 1]] for i in range(len(s))]
        data = tc.LOWER[s.data]
        a, b, first = s.words(tc.ALNUM, data)
        raw = data.tobytes()
        words = [raw[x:y].decode() for x, y in zip(a, b)]
        lower += [words[first[i] : first[i + 1]] for i in range(len(s))]
    assert got == [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in TEXTS]
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    assert lower == [re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(fold)) for t in TEXTS]


def test_hashes_do_not_depend_on_place():
    s = next(tc.slices(pa.array(["ab cd ab", "cd ab cd ab"])))
    a, b, first = s.words(tc.NOT_SPACE)
    h = tc.word_hashes(s.data, a, b)
    assert h[0] == h[2] == h[4] == h[6] and h[1] == h[3] == h[5] and h[0] != h[1]
    g = tc.ngram_hashes(h, 2)
    assert g[0] == g[4] and g[1] == g[3]


@pytest.mark.parametrize("make,n,cut", [(setjoin.word_shingles, 3, str.split), (setjoin.char_shingles, 4, list)])
def test_shingle_sets(make, n, cut):
    texts = ["", "a", "a b", "a b c d e", "äöü ñandú a b c", "a b c d e"]
    sets = []
    for s in tc.slices(pa.array(texts), 20):
        h, o = make(n)(s)
        sets += [set(h[o[i] : o[i + 1]].tolist()) for i in range(len(s))]
    want = [{tuple(u[i : i + n]) for i in range(len(u) - n + 1)} or ({tuple(u)} if u else set()) for u in map(cut, texts)]
    assert [len(s) for s in sets] == [len(w) for w in want]
    for i in range(len(texts)):
        for j in range(len(texts)):
            assert len(sets[i] & sets[j]) == len(want[i] & want[j])


def test_noisy_or_finds_the_sentence():
    rng = np.random.default_rng(0)
    words = [f"w{i}" for i in range(300)]
    texts, labels = [], []
    for i in range(400):
        parts = [" ".join(rng.choice(words, 6)) for _ in range(5)]
        labels.append(i % 4 == 0)
        if labels[-1]:
            parts[rng.integers(5)] += " vile"
        texts.append(". ".join(parts) + ".")
    bits = 14
    bags = []
    for s in tc.slices(pa.array(texts)):
        ids, sent, _, _, docs = classifiers.sentence_features(s, bits)
        bags += [(ids[sent[docs[i]] : sent[docs[i + 1]]], sent[docs[i] : docs[i + 1] + 1] - sent[docs[i]]) for i in range(len(s))]
    w = classifiers.fit_noisy_or(bags, np.array(labels, float), bits)
    test = ["w1 w2. this is vile. w3 w4", "w1 w2. w3 w4", "", "é vile!"]
    score, spans = classifiers.noisy_or_scores(next(tc.slices(pa.array(test))), w, bits, 0.5)
    assert score[0] > 0.7 and score[1] < 0.3 and score[2] == 0 and score[3] > 0.7
    assert [test[0][x["start"] : x["end"]] for x in spans[0]] == ["this is vile"]
    assert [test[3][x["start"] : x["end"]] for x in spans[3]] == ["é vile"]


def test_ftrl_separates():
    rng = np.random.default_rng(0)
    texts = [" ".join(rng.choice(["ok", "fine", "good"] if i % 2 else ["!!", "junk", "zz"], 20)) for i in range(200)]
    bits, y = 12, np.arange(200) % 2
    rows = []
    for s in tc.slices(pa.array(texts)):
        ids, first = classifiers.ngram_features(s, bits)
        rows += [classifiers._ngram_example(ids[first[i] : first[i + 1]], bits) for i in range(len(s))]
    w = classifiers.fit_ftrl(rows, y.astype(float), bits)
    p = np.concatenate([classifiers.ngram_scores(s, w, bits) for s in tc.slices(pa.array([*texts, ""]))])
    assert ((p[:-1] > 0.5) == (y == 1)).all() and 0 < p[-1] < 1


ODD = ["", "Vile words here! And kind ones.\nno stop at the end", "a", " ... !!! ", "one one one two\ttwo", "Ünïcode wörds: 12 of 30?", "x" * 5000]


def _hash(word: str) -> int:
    return int(tc.word_hashes(np.frombuffer(word.encode(), np.uint8), np.array([0]), np.array([len(word.encode())]))[0])


def test_noisy_or_scores_against_brute_force():
    bits = 10
    weights = np.random.default_rng(4).normal(size=(1 << bits) + 1).astype(np.float32)
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    want = []
    for text in ODD:
        none = 1.0
        for sentence in re.split(r"(?<=[\n!.?])", text.translate(fold)):
            z, found = float(weights[-1]), False
            for word in re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", sentence):
                found = True
                z += float(weights[_hash(word) >> (64 - bits)])
                for k, size in enumerate(classifiers.PREFIXES, 1):
                    part = word.encode()[:size]
                    h = tc.word_hashes(np.frombuffer(part, np.uint8), np.array([0]), np.array([len(part)]))
                    z += float(weights[int(tc.mix(h + np.uint64(k))[0]) >> (64 - bits)])
            if found:
                none *= 1 - 1 / (1 + np.exp(-z))
        want.append(1 - none)
    got = np.concatenate([classifiers.noisy_or_scores(s, weights, bits, 0.5)[0] for s in tc.slices(pa.array(ODD), 60)])
    assert np.allclose(got, want, atol=1e-9)


def test_ngram_scores_against_brute_force():
    bits = 10
    weights = np.random.default_rng(4).normal(size=(1 << bits) + 1).astype(np.float32)
    want = []
    for text in ODD:
        words = re.findall(r"[0-9A-Za-z\u0080-\U0010FFFF]+|[^0-9A-Za-z\u0080-\U0010FFFF\x00-\x20\x7F]+", text)
        h = [_hash(w) for w in words]
        ids = [x >> (64 - bits) for x in h]
        ids += [int(classifiers.REPEAT if x == y else tc.ngram_hashes(np.array([x, y], np.uint64), 2)[0]) >> (64 - bits) for x, y in zip(h, h[1:])]
        z = classifiers.NGRAM_SCALE * sum(float(weights[i]) for i in ids) / max(1, len(ids)) + float(weights[-1])
        want.append(1 / (1 + np.exp(-np.clip(z, -35, 35))))
    got = np.concatenate([classifiers.ngram_scores(s, weights, bits) for s in tc.slices(pa.array(ODD), 60)])
    assert np.allclose(got, want, atol=1e-9)
