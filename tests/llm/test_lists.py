"""Lists and texts of the near-copies step take little room when they travel."""

import numpy as np
import pytest

pytest.importorskip("cloakframe.llm")
from cloakframe.llm import jaccard  # noqa: E402


def test_lists_of_many_buckets_stay_small_and_whole():
    """With a key an owner, as for many buckets, an entry took 18 bytes."""
    rng = np.random.default_rng(1)
    for each in (1, 300):
        owners = np.repeat(np.sort(rng.integers(0, 1 << jaccard.OWNER_BITS, 2000)), each)
        keys = rng.integers(0, 1 << 63, len(owners), dtype=np.uint64)
        blob = jaccard._packed(keys, owners)
        assert len(blob) <= 12 + len(keys) * (11 if each == 1 else 5.1)
        found, names, counts = jaccard._unpacked(blob)
        assert np.array_equal(found, keys & np.uint64((1 << 40) - 1)) and np.array_equal(np.repeat(names, counts), owners)


def test_links_of_a_bucket_join_all_owners_of_a_key():
    owners, keys = np.array([5, 5, 7, 9, 9, 11]), np.array([1, 2, 2, 2, 3, 4], np.uint64)
    a, b = jaccard._linked([jaccard._packed(keys[:3], owners[:3]), jaccard._packed(keys[3:], owners[3:])])
    assert sorted(zip(a.tolist(), b.tolist())) == [(5, 7), (7, 9)]


def test_only_texts_of_members_travel_and_come_back(spark):
    rows = [(i, i * 7, f"é text {i} " * 50) for i in range(2000)]
    keyed = spark.createDataFrame(rows, "doc_id long, tie long, text string")
    members = spark.createDataFrame([(i, i * 7) for i in range(0, 2000, 10)], "doc_id long, tie long")
    found = {r["doc_id"]: r["text"] for r in jaccard._texts_of(keyed, members).collect()}
    assert len(found) < 400 and all(jaccard.C.restored(bytes(found[i])).decode() == rows[i][2] for i in range(0, 2000, 10))
    assert len(found[0]) < len(rows[0][2]) / 2
