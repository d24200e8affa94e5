"""Every pattern of changed words that the verification accepts is found, whatever its item's length."""

import itertools

import numpy as np
import pytest

from epistola.llm import decontamination


def hit(equal, masks):
    return any(all(equal[i + k] for k, bit in enumerate(m) if bit == "1") for m in masks for i in range(len(equal) - len(m) + 1))


@pytest.mark.parametrize("n", range(1, 20))
def test_every_accepted_pattern_has_a_seed(n):
    least = min(decontamination.LEAST_WORDS, max(1, decontamination.LEAST_SHARE * n))
    index = decontamination.Index([(1, " ".join(f"w{k}" for k in range(n)))])
    accepted = 0
    for changed in (c for k in range(n) for c in itertools.combinations(range(n), k) if n - k >= least):
        equal = np.ones(n, bool)
        equal[list(changed)] = False
        if decontamination.stretch(equal)[2] >= least:
            accepted += 1
            assert hit(equal, index.masks), equal
    assert accepted


def test_long_items_too():
    rng = np.random.default_rng(6)
    index = decontamination.Index([(1, " ".join(f"w{k}" for k in range(59)))])
    patterns = [rng.random(59) < share for share in (0.3, 0.45, 0.5, 0.55, 0.6, 0.8) for _ in range(2000)]
    patterns = [e for e in patterns if decontamination.stretch(e)[2] >= decontamination.LEAST_WORDS]
    assert len(patterns) > 1000 and all(hit(e, index.masks) for e in patterns)


@pytest.mark.parametrize(("n", "changed"), [(5, [2]), (8, [4]), (10, [3, 6]), (18, [7, 8, 9]), (25, [2, 4, 6, 8, 10, 12, 14, 16, 18, 20])])
def test_changed_passages_are_found(spark, n, changed):
    item = [f"w{k}" for k in range(n)]
    text = ["before", *("x" if k in changed else w for k, w in enumerate(item)), "after"]
    docs = spark.createDataFrame([(1, " ".join(text)), (2, "nothing of it")], "doc_id long, text string")
    bench = spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")
    assert [(r["doc_id"], r["item_id"], r["n_matched"]) for r in decontamination.find_overlaps(docs, bench).collect()] == [(1, 7, n - len(changed))]
    assert [r["doc_id"] for r in decontamination.drop_contaminated(docs, bench).collect()] == [2]
