"""What the registered queries ask of their operators."""

import numpy as np

from terrace.llm import kneser_ney, queries


def test_the_registered_model_has_two_words_of_context(spark, sf_dir, monkeypatch):
    orders, train = [], kneser_ney.train
    monkeypatch.setattr(kneser_ney, "train", lambda docs, *a, **b: orders.append((m := train(docs, *a, **b)).order) or m)
    queries.op2_kneser_ney_score(spark, sf_dir)
    assert orders == [3]


def test_packed_rows_come_back():
    rng = np.random.default_rng(3)
    for width in (1, 2, 3):
        words = rng.integers(0, 2**64, (500, width), np.uint64)
        words[:, 1:] = rng.integers(0, 2**64, 40, np.uint64)[rng.integers(0, 40, (500, width - 1))]
        words, counts = words[np.argsort(words[:, 0])], rng.integers(1, 300, 500)
        for n in (500, 1, 0):
            got = kneser_ney._unpack(kneser_ney._pack(words[:n], counts[:n]))
            assert (got[0] == words[:n]).all() and (got[1] == counts[:n]).all()
