"""Windows far from an item by fingerprint and near to it by shingles."""

from __future__ import annotations

import numpy as np
from data import frame

from wakegrid.llm.decontam import contaminated


def test_no_similar_window_is_lost(spark):
    start = "x y " * 5
    items = spark.createDataFrame([(1, start + "z")], "item_id long, text string")
    got = contaminated(frame(spark, [(k, f"{start}w{k}", None, None, None) for k in range(3000)]), items).collect()
    assert len(got) == 3000 and {(r["start"], r["n_words"], r["similarity"]) for r in got} == {(0, 11, 0.75)}
    assert max(r["distance"] for r in got) > 23


def test_shared_shingles_of_all_windows():
    from wakegrid.llm.decontam import shared_shingles

    r = np.random.default_rng(5)
    for _ in range(200):
        place, weights = r.integers(-1, 4, r.integers(1, 30)), r.integers(1, 4, 4)
        n = int(r.integers(1, len(place) + 1))
        want = [int(np.minimum(np.bincount(w[w >= 0], minlength=4), weights).sum()) for w in (place[s : s + n] for s in range(len(place) - n + 1))]
        assert shared_shingles(place, weights, n).tolist() == want
