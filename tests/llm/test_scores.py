"""Scores of the two classifiers recomputed in plain Python; the risk's gradient against differences; held-out figures."""

import bisect
import math

import numpy as np
import pytest

from lodestrand.llm import pu, quality, queries, toxicity

SMALL = "/root/testdata/sf0.001"


def sigmoid(z):
    return 1 / (1 + math.exp(-max(-40.0, min(40.0, z))))


def test_toxicity_scores_by_hand(spark):
    docs, labels = (queries.table(spark, SMALL, t) for t in ("documents", "labels"))
    words, bag = toxicity.train(docs, labels, queries.text_crc() % 4 != 2)
    assert len(bag) == 3 and len(words) == len(set(words))
    got = {r.doc_id: r.score for r in toxicity.score(docs, (words, bag)).collect()}
    number = {w: k for k, w in enumerate(words)}
    for r in docs.collect():
        held = [number[t] for t in toxicity.terms_in(r.text or "") if t in number]
        want = sum(sigmoid(m.bias + sum(m.weights[k] for k in held)) for m in bag) / len(bag)
        assert got[r.doc_id] == pytest.approx(want, abs=1e-12)


def measured(text):
    """Every measure of a text by counting its bytes and words."""
    data, words = text.encode(), text.split()
    n, count = max(len(data), 1), lambda chars: sum(b in chars for b in data)
    lower, upper = count(b"abcdefghijklmnopqrstuvwxyz") + sum(b >= 128 for b in data), count(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")
    symbols, exclaims, pipes, stops, digits, lines, blanks = (count(c) for c in (b"#$%&*@^~=+<>\\_{}", b"!", b"|", b".,;:?", b"0123456789", b"\n", b" \t\r\v\f"))
    rest = len(data) - lower - upper - symbols - exclaims - pipes - stops - digits - lines - blanks
    out = [math.log1p(len(data)), upper / max(lower + upper, 1), symbols / n, exclaims / n, pipes / n, stops / n, digits / n, rest / n, lines / n, 0.0, 0.0, 0.0, 0.0]
    if words:
        out[9:] = [(lower + upper) / len(words), len(set(words)) / len(words), sum(a == b for a, b in zip(words, words[1:])) / len(words), (symbols + exclaims + pipes) / len(words)]
    return out


def test_quality_scores_by_hand(spark):
    docs, labels = (queries.table(spark, SMALL, t) for t in ("documents", "labels"))
    edges, bag = quality.train(docs, labels, queries.text_crc() % 5 != 0)
    assert len(bag) == 3
    got = {r.doc_id: r.score for r in quality.score(docs, (edges, bag)).collect()}
    for r in docs.collect():
        bins = [bisect.bisect_right(edges[j].tolist(), x) + j * (edges.shape[1] + 1) for j, x in enumerate(measured(r.text or ""))]
        want = sum(sigmoid(m.bias + sum(m.weights[k] for k in bins)) for m in bag) / len(bag)
        assert got[r.doc_id] == pytest.approx(want, abs=1e-9)


@pytest.mark.parametrize("prior", [0.05, 0.4])
def test_first_step_goes_down_the_risk(prior):
    """Adam's first step is the rate against the sign of each derivative, which differences of the risk give."""
    rng = np.random.default_rng(5)
    features, n_p, n_u, seed, decay = 6, 40, 90, 3, 1e-3
    sample = lambda n, lean: (np.repeat(np.arange(n), 2), rng.choice(features, 2 * n, p=lean), n)
    positives, unlabelled = sample(n_p, [0.4, 0.2, 0.1, 0.1, 0.1, 0.1]), sample(n_u, [0.1, 0.1, 0.1, 0.2, 0.2, 0.3])
    start, bias = np.random.default_rng(seed).normal(0, 1e-3, features), math.log(prior / (1 - prior))

    def risk(w, b):
        zp, zu = (b + np.bincount(r, w[f], n) for r, f, n in (positives, unlabelled))
        assert pu.nonnegative_risk(zp, zu, prior)[1] >= 0
        return sum(pu.nonnegative_risk(zp, zu, prior)) + decay / 2 * float((w**2).sum())

    step = 1e-5
    slope = [(risk(start + step * e, bias) - risk(start - step * e, bias)) / (2 * step) for e in np.eye(features)]
    slope_b = (risk(start, bias + step) - risk(start, bias - step)) / (2 * step)
    fitted = pu.fit(positives, unlabelled, features, prior, epochs=1, rate=0.05, decay=decay, seed=seed)
    assert np.allclose(start - fitted.weights, 0.05 * np.sign(slope), atol=1e-4) and bias - fitted.bias == pytest.approx(0.05 * np.sign(slope_b), abs=1e-4)


@pytest.mark.parametrize(("name", "label", "floors"), [("op1_toxicity", "toxic", (0.8, 0.6)), ("op8_quality", "quality", (0.9, 0.95))])
def test_held_out_floors(spark, name, label, floors):
    path = "/root/testdata/sf0.01"
    rows = queries.QUERIES[name](spark, path).where("held_out").join(queries.table(spark, path, "labels").where(f"{label} is not null"), "doc_id").select("predicted", label).collect()
    right = sum(r.predicted and r[label] for r in rows)
    precision, recall = right / max(sum(r.predicted for r in rows), 1), right / sum(r[label] for r in rows)
    assert precision >= floors[0] and recall >= floors[1], (precision, recall, len(rows))
