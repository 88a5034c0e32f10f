"""What the arrays of the n-gram model hold."""

import glob

import numpy as np

from terrace.llm import kneser_ney as k


def test_saved_hashes_and_values_come_back(tmp_path):
    rng = np.random.default_rng(5)
    for n in (0, 1, 4000):
        keys = np.unique(rng.integers(0, 2**64 - 1, n, np.uint64) >> np.uint64(3))
        columns = [rng.integers(1, 40, len(keys)), rng.integers(0, 40, len(keys)) ** 3]
        k._save_keys(str(tmp_path), f"keys-{n}", keys)
        k._save_coded(str(tmp_path), f"values-{n}", columns)
        asked = np.sort(np.concatenate([keys, keys[::2] + np.uint64(1)]))
        at = k._places(str(tmp_path), f"keys-{n}", asked)
        assert ((at >= 0) == np.isin(asked, keys)).all()
        assert (at[at >= 0] == np.searchsorted(keys, asked[at >= 0])).all()
        got = k._coded(str(tmp_path), f"values-{n}", np.arange(len(keys)))
        assert (got == np.column_stack(columns)).all()


def test_model_takes_two_thirds_of_plain_arrays(spark):
    rng = np.random.default_rng(6)
    rows = [(" ".join(f"w{x}" for x in rng.integers(0, 300, 400)),) for _ in range(400)]
    model = k.train(spark.createDataFrame(rows, "text string"), 3)
    files = glob.glob(f"{model.folder.removeprefix('file:').replace('//', '/')}/*-3-0*")
    begins = 2 * 4 * ((1 << 16) + 1)  # two lists of places, of a fixed size
    grams = len({g for r in rows for g in zip(*(("s", "s", *r[0].split(), "e")[j:] for j in range(3)))})
    contexts = len({g for r in rows for g in zip(*(("s", "s", *r[0].split())[j:] for j in range(2)))})
    plain = 9 * grams + 12 * contexts
    assert sum(len(open(f, "rb").read()) for f in files) - begins < 0.85 * plain
