"""Toxicity scores against a plain noisy-or."""

import math
import re

import numpy as np
import pytest

from brindle.llm import toxicity

MODEL = toxicity.Model({b"=grumbol": 7.5, b"gru": 1.5, b"vile": 4.0, "=böse".encode(): 9.0}, -9.0)


def plain_features(word):
    raw = word.encode()
    return {b"=" + raw, *(raw[:k] for k in range(3, 9) if k <= len(raw))}


def plain_score(text, model):
    """1 less the product of what each sentence leaves, and the sentences of a half or more."""
    clean, offending = 1.0, []
    for k, part in enumerate(re.split(r"[.!?\n]", text or "")):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in part))
        if words:
            z = model.bias + sum(model.weights.get(f, 0.0) for f in set().union(*map(plain_features, words)))
            p = 1 / (1 + math.exp(-z))
            clean *= 1 - p
            if p >= 0.5:
                offending.append((k, pytest.approx(p)))
    return 1 - clean, offending


def test_noisy_or(spark):
    rng = np.random.default_rng(8)
    vocabulary = ["You", "grumbol", "grumpy", "vile", "villain", "Böse", "böse", "the", "a", "day", "GRUMBOL"]
    texts = [None, "", " . ! \n", "grumbol", "vile. vile grumbol! the day\nböse"]
    texts += [" ".join(w + rng.choice(["", "", ".", "!", ",", "\n"]) for w in rng.choice(vocabulary, int(n), p=[0.2, 0.02, 0.05, 0.03, 0.05, 0.01, 0.01, 0.3, 0.23, 0.09, 0.01])) for n in rng.integers(1, 60, 60)]
    texts.append("the day is long. " * 100_000 + "Vile grumbol.")
    rows = [(k, t, 0.5, 1, True, "w", "x") for k, t in enumerate(texts)] + [(3, "grumbol", 0.5, 1, True, "w", "x"), (None, "vile", 0.5, 1, True, "w", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double, predicted int, held_out boolean, offending string, carried string")
    got = toxicity.score_documents(docs, MODEL).collect()
    assert len(got) == len(rows)
    by_id = {r.doc_id: r for r in got}
    for k, t in [*enumerate(texts), (None, "vile")]:
        score, offending = plain_score(t, MODEL)
        assert by_id[k].score == pytest.approx(score, abs=1e-9) and by_id[k].predicted == int(by_id[k].score >= 0.5)
        assert [(o.sentence, o.score) for o in by_id[k].offending] == offending
    assert by_id[len(texts) - 1].predicted == 1 and [o.sentence for o in by_id[len(texts) - 1].offending] == [100_000]
    assert toxicity.score_documents(docs.limit(0), MODEL).count() == 0


def test_scores_at_the_bound(spark):
    """A score of a half or more is toxic; equal texts score alike."""
    model = toxicity.Model({b"=odd": 9.0}, -9.0)
    docs = spark.createDataFrame([(1, "odd"), (2, "odd"), (3, "even")], "doc_id long, text string")
    got = toxicity.score_documents(docs, model).orderBy("doc_id").collect()
    assert got[0].score == got[1].score == pytest.approx(0.5) and [r.predicted for r in got] == [int(r.score >= 0.5) for r in got]


def test_training_lowers_the_loss():
    rng = np.random.default_rng(9)
    prose = lambda: " ".join(rng.choice(["one", "two", "three", "four", "five"], 12))
    rows = [(f"{prose()}. You vile grumbol. {prose()}.", 1) for _ in range(30)] + [(f"{prose()}. {prose()}.", 0) for _ in range(60)]
    loss = lambda model: -sum(math.log(max(1e-12, plain_score(t, model)[0] if y else 1 - plain_score(t, model)[0])) for t, y in rows) / len(rows)
    few, many = (toxicity.train(iter(rows), rounds=n) for n in (5, 300))
    assert loss(many) < loss(few) and loss(many) < 0.1
    assert all(w > 0 for w in many.weights.values())
    assert [k for k, _ in plain_score(rows[0][0], many)[1]] == [1]
