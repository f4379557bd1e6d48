"""Toxic spans and scores: the chain against enumeration, the rest on planted words."""

import itertools
import random
import time

import numpy as np
import pytest

from tests.llm.test_operators import WORDS, make, stored
from tidewell.llm import toxicity

BAD = ["grobnik", "snarlach", "vilepot", "cruftling"]


def brute_marginals(scores, trans):
    """Probability of state 1 at each token of one chain, by all state sequences."""
    total, ones = 0.0, np.zeros(len(scores))
    for states in itertools.product((0, 1), repeat=len(scores)):
        w = np.exp(sum(s * x for s, x in zip(states, scores)) + sum(trans[a, b] for a, b in zip(states, states[1:])))
        total += w
        ones += w * np.array(states)
    return ones / total


def test_marginals_equal_enumeration(monkeypatch):
    monkeypatch.setattr(toxicity, "BLOCK", 4)
    rng = np.random.default_rng(3)
    trans, sizes = rng.standard_normal((2, 2)), [1, 7, 3, 10, 2]
    chains = [rng.standard_normal(n) * 3 for n in sizes]
    first = np.concatenate([[True] + [False] * (n - 1) for n in sizes])
    want = np.concatenate([brute_marginals(c, trans) for c in chains])
    assert np.allclose(toxicity.marginals(np.concatenate(chains), trans, first), want)
    p, pairs = toxicity.chain_expectations(np.concatenate(chains), trans, first)
    assert np.allclose(p, want) and np.isclose(pairs.sum(), sum(n - 1 for n in sizes))
    assert toxicity.marginals(np.zeros(0), trans, np.zeros(0, dtype=bool)).size == 0


def test_long_chains_do_not_overflow():
    n = 50_000
    first = np.zeros(n, dtype=bool)
    first[0] = True
    p = toxicity.marginals(np.full(n, 25.0), np.array([[3.0, -3.0], [-3.0, 3.0]]), first)
    assert np.isfinite(p).all() and p.min() > 0.99


def sentence(rng, n, bad=0):
    words = [rng.choice(WORDS) + rng.choice(["", "s", "ly", "er"]) for _ in range(n)]
    for _ in range(bad):
        words.insert(rng.randrange(len(words)), rng.choice(BAD))
    return " ".join(words)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(8)
    texts = [sentence(rng, rng.randrange(20, 120), bad=3 if k % 5 == 0 else 0) for k in range(300)]
    copied = sentence(rng, 60) + " oncewrittenword"
    texts += [copied] * 40  # one toxic label, copied: none of its words is toxic
    toxic = [int(k % 5 == 0) for k in range(300)] + [int(k < 15) for k in range(40)]
    return texts, toxic


@pytest.fixture(scope="module")
def learned(spark, corpus, tmp_path_factory):
    texts, toxic = corpus
    docs = stored(make(spark, texts), tmp_path_factory)
    labels = stored(spark.createDataFrame([(k, t, 0) for k, t in enumerate(toxic)] + [(None, 1, 0), (3, None, 0), (9999, 1, 0)], "doc_id long, toxic int, y int"), tmp_path_factory)
    return docs, labels, toxicity.train(docs.where(~toxicity.held_out()), labels)


def test_words_with_many_contexts_are_found(learned):
    docs, labels, _ = learned
    units = toxicity.toxic_units(toxicity.labelled(docs, labels))
    assert {"=" + w for w in BAD} <= set(units)
    assert not any(w in u for u in units for w in ("oncewrittenword", "river"))


def test_held_out_documents_and_spans(learned, corpus):
    docs, _, model = learned
    texts, toxic = corpus
    rows = toxicity.score(docs, model).withColumn("h", toxicity.held_out()).collect()
    judged = [r for r in rows if r["h"] and r["doc_id"] < 300]
    assert len(judged) > 30 and all((r["score"] >= 0.5) == bool(toxic[r["doc_id"]]) for r in judged)
    for r in rows:
        assert 0 <= r["score"] <= 1
        if r["doc_id"] < 300:
            words = [texts[r["doc_id"]][s["start"] : s["end"]].split() for s in r["spans"]]
            assert sorted(w for some in words for w in some) == sorted(w for w in texts[r["doc_id"]].split() if w in BAD)


def test_odd_texts_ids_and_inputs(spark, learned, tmp_path_factory):
    _, _, model = learned
    texts = [None, "", " \n", "!!!", "river " * 30_000 + "snarlach vilepot grobnik " + "stone " * 30_000, "SNARLACH! you Vilepot, cruftling", "river", "river"]
    docs = stored(make(spark, texts, [None, None, 5, 5, 6, 7, 8, 9]), tmp_path_factory)
    got = toxicity.score(docs, model).collect()
    assert len(got) == 8 and all(0 <= r["score"] <= 1 for r in got)
    by_id = {r["doc_id"]: r for r in got}
    assert by_id[6]["score"] > 0.5 and [texts[4][s["start"] : s["end"]] for s in by_id[6]["spans"]] == ["snarlach vilepot grobnik"]
    assert by_id[7]["score"] > 0.5 and by_id[8]["score"] == by_id[9]["score"] < 0.5
    again = toxicity.score(docs.drop("lang", "source").withColumn("lang", docs["text"]), model).collect()
    assert sorted(r["score"] for r in again) == sorted(r["score"] for r in got)
    assert toxicity.score(stored(make(spark, []), tmp_path_factory), model).collect() == []


@pytest.mark.parametrize("labels", [[], [(0, 0)], [(0, 1)], [(None, 1)], [(0, None)]])
def test_labels_of_one_kind(spark, tmp_path_factory, labels):
    docs = stored(make(spark, ["one two", None]), tmp_path_factory)
    model = toxicity.train(docs, stored(spark.createDataFrame(labels, "doc_id long, toxic int"), tmp_path_factory))
    got = toxicity.score(docs, model).collect()
    assert [r["score"] for r in got] == [float(labels == [(0, 1)])] * 2


def test_marginals_take_less_time_than_cutting_the_text():
    text = "some words and others here " * 40_000
    scores, trans = np.random.default_rng(3).normal(0, 3, 200_000), np.array([[0.5, -0.5], [-0.3, 0.8]])
    first = np.arange(len(scores)) % 700 == 0

    def least(work) -> float:
        times = []
        for _ in range(5):
            began = time.process_time()
            work()
            times.append(time.process_time() - began)
        return min(times)

    assert least(lambda: toxicity.marginals(scores, trans, first)) < least(lambda: toxicity.TOKEN.findall(text))
