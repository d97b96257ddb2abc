"""Candidate links of the near-copies step: as many as classes, none lost."""

from itertools import combinations

import numpy as np
import pytest

pytest.importorskip("cloakframe.llm")
from cloakframe.llm import jaccard  # noqa: E402


def _lists(spark, groups, buckets):
    """Every pair of a group shares a list of its own; lists are dealt to the buckets in turn."""
    held, key = {}, 0
    for group in groups:
        for pair in combinations(group, 2):
            key += 1
            for owner in pair:
                held.setdefault(key % buckets, []).append((key, owner))
    rows = []
    for bucket, listed in held.items():
        listed.sort(key=lambda x: (x[1], x[0]))
        keys, owners = np.array([k for k, _ in listed], np.uint64), np.array([o for _, o in listed], np.int64)
        rows.append((bucket, bytearray(jaccard._packed(keys, owners))))
    return spark.createDataFrame(rows, "bucket int, postings binary")


def _groups(links):
    root = {}

    def top(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = top(a), top(b)
        root[max(a, b)] = min(a, b)
    found = {}
    for x in list(root):
        found.setdefault(top(x), set()).add(x)
    return sorted(map(sorted, found.values()))


def test_candidates_grow_with_classes_not_with_pairs(spark):
    groups = [list(range(-30, 30)), [100, 200, 300], [10**15, -(10**15)]]
    for buckets in (1, 7):
        edges = [tuple(r) for r in jaccard._candidates(_lists(spark, groups, buckets).coalesce(1)).collect()]
        assert _groups(edges) == sorted(map(sorted, groups))
        tasks = 1 if buckets == 1 else buckets
        assert len(edges) <= tasks * sum(len(g) - 1 for g in groups)
        if buckets == 1:
            assert len(edges) == sum(len(g) - 1 for g in groups)


def test_reached_classes_add_no_link_twice_and_forgetting_loses_none():
    pairs = np.array(list(combinations(range(20), 2)) + [(50, 60), (60, 70)], np.int64)
    for limit, most in ((1000, 21), (5, len(pairs))):
        reached, edges = jaccard._Reached(limit), []
        for part in np.array_split(np.random.default_rng(3).permutation(pairs), 9):
            made = reached.add(part[:, 0], part[:, 1])
            edges += zip(made.column("a").to_pylist(), made.column("b").to_pylist())
        assert _groups(edges) == [list(range(20)), [50, 60, 70]]
        assert len(edges) <= most and (limit < 100 or len(edges) == 21)
