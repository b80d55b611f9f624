"""Neighbour votes against a plain computation over all pairs of texts."""

from __future__ import annotations

import numpy as np

from fleetspan.llm import voting

WORDS = "depot route parcel van dock lane crate pallet driver stop north south east west".split()


def test_scores_are_those_of_all_pairs(spark):
    rng = np.random.default_rng(8)
    texts = [" ".join(WORDS[i] + ("!" if j % 7 == 0 else "") for i, j in zip(rng.integers(0, 14, n), rng.integers(0, 50, n))) for n in rng.integers(3, 60, 120)] + ["", None, "12 34", texts_repeat := "depot depot", texts_repeat]
    marks = {i: int(rng.integers(0, 2)) for i in range(0, 120, 2)}
    customers = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "customer_id long, address string")
    ratings = spark.createDataFrame(list(marks.items()) + [(3, None), (9999, 1)], "customer_id long, is_good int")
    got = {r["customer_id"]: r["quality_score"] for r in voting.vote_quality(customers, ratings, neighbours=7).collect()}

    terms = np.vstack([voting.term_weights([t]) for t in texts]).astype(np.float64)
    known = sorted(marks)
    fitted = terms[known].astype(np.float16).astype(np.float64)
    weight = np.log((1 + len(known)) / (1 + (fitted > 0).sum(0))) + 0.2
    _, _, axes = np.linalg.svd(fitted * weight, full_matrices=False)
    axes = axes[: voting.RANK]
    unit = lambda x: x / max(np.linalg.norm(x), 1e-9)
    labelled = [unit(axes @ (t * weight)) for t in fitted]
    for i in range(len(texts)):
        mine = unit(axes @ (terms[i] * weight))
        near = sorted(((float(mine @ v), marks[k]) for v, k in zip(labelled, known)), reverse=True)
        votes = [(max(c, 0.0) ** 8 + 1e-6, y) for c, y in near[:7]]
        # a tie at the last place may be broken either way
        tied = [y for c, y in near[6:] if abs(c - near[6][0]) < 1e-5]
        want = sum(w * y for w, y in votes) / sum(w for w, _ in votes)
        assert abs(got[i] - want) < 2e-3 or len(set(tied)) > 1, (i, got[i], want)
    assert got[123] == got[124] and got[120] == got[121]
