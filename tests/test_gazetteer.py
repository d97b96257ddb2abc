"""Phrase tables against a plain search, in both ways of looking up."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from cloakframe.operators import detect as D
from cloakframe.operators import gazetteer as G
from cloakframe.operators import tokenize as T

TABLE = "phrase string, label string, score double"


def found(df, name="pieces"):
    return {r["id"]: [(p["start"], p["end"], p["label"]) for p in r[name]] for r in df.select("id", name).collect()}


def plain(text, phrases):
    """Leftmost longest phrases by trying all of them at every word."""
    out, reach, low = [], 0, text.lower()
    for m in re.finditer(r"\w+", low):
        if m.start() < reach:
            continue
        ends = [m.start() + len(p) for p in phrases if low.startswith(p, m.start()) and not re.match(r"\w", low[m.start() + len(p) :])]
        if ends:
            reach = max(ends)
            out.append((m.start(), reach, phrases[low[m.start() : reach]]))
    return out


def test_a_hundred_thousand_phrases(spark):
    rng = np.random.default_rng(1)
    words = [f"{a}{b}" for a in "abcdefghij" for b in range(60)]
    listed = {" ".join(rng.choice(words, size=int(n))): str(label) for n, label in zip(rng.integers(1, 4, 170_000), rng.choice(["PERSON", "LOCATION", "NRP"], 170_000))}
    assert len(listed) > 100_000
    phrases = spark.createDataFrame([(p, label, 0.9) for p, label in listed.items()], TABLE)
    texts = [(i, " ".join(rng.choice(words, size=60))) for i in range(40)]
    docs = spark.createDataFrame(texts, "id long, text string")
    by_word = {}
    for p in listed:
        by_word.setdefault(p.split()[0], {})[p] = listed[p]

    def want(text):
        out, i, w = [], 0, text.split()
        starts = np.cumsum([0, *(len(x) + 1 for x in w)])
        while i < len(w):
            n = next((n for n in (3, 2, 1) if i + n <= len(w) and " ".join(w[i : i + n]) in listed), 0)
            if n:
                p = " ".join(w[i : i + n])
                out.append((int(starts[i]), int(starts[i]) + len(p), listed[p]))
            i += n or 1
        return out

    wanted = {i: want(t) for i, t in texts}
    assert sum(map(len, wanted.values())) > 400 and {x[2] for v in wanted.values() for x in v} == {"PERSON", "LOCATION", "NRP"}
    assert found(G.with_phrases(docs, phrases)) == wanted
    assert found(G.with_phrases(docs, phrases, row_id="id", limit=1000)) == wanted


@pytest.mark.parametrize("limit", [G.PHRASE_BYTES, 0])
def test_hostile_phrases_and_texts(spark, limit):
    listed = [("New York", "LOCATION", 0.9), ("new york city", "LOCATION", 0.9), ("York", "PERSON", 0.9), ("York", "NRP", 0.95), ("St. John's", "LOCATION", 0.9), (" Ann, ", "PERSON", 0.9),
              ("Zoë Łuk", "PERSON", 0.9), ("", "PERSON", 0.9), ("...", "NRP", 0.9), (None, "NRP", 0.9), ("İzmir", "LOCATION", 0.9), ("dutch", "NRP", 0.9), ("x", None, 0.9)]
    texts = ["In NEW YORK City, new york  city and yorker york.", None, "", "Ann ann,Ann_ annex", "ZOË ŁUK st. john's St John's", "an İzmir dutch Dutch-x", "x " * 20_000 + "Dutch"]
    docs = spark.createDataFrame([(i, t, "own") for i, t in enumerate(texts)], "id long, text string, label string")
    got = found(G.with_phrases(docs, spark.createDataFrame(listed, TABLE), row_id="id", limit=limit))
    table = {"new york": "LOCATION", "new york city": "LOCATION", "york": "NRP", "st. john's": "LOCATION", "ann": "PERSON", "zoë łuk": "PERSON", "dutch": "NRP"}
    want = {i: plain(t or "", table) for i, t in enumerate(texts)}
    want[5] = [(3, 8, "LOCATION"), *want[5]] if len("İzmir".lower()) == 5 else [(3, 8, "LOCATION"), (9, 14, "NRP"), (15, 20, "NRP")]
    assert got == want
    assert found(G.with_phrases(docs.limit(0), spark.createDataFrame(listed, TABLE), row_id="id", limit=limit)) == {}
    assert all(v == [] for v in found(G.with_phrases(docs, spark.createDataFrame([], TABLE), row_id="id", limit=limit)).values())


def test_large_tables_need_a_row_id(spark):
    docs = spark.createDataFrame([(1, "a")], "id long, text string")
    with pytest.raises(ValueError):
        G.with_phrases(docs, spark.createDataFrame([("a", "PERSON", 1.0)], TABLE), limit=0)


def test_names_are_tokenized_beside_rules(spark):
    docs = spark.createDataFrame([(1, "Mail ann@x.org to Ann Lee in Oslo, ann lee")], "id long, text string")
    phrases = spark.createDataFrame([("Ann Lee", "PERSON"), ("oslo", "LOCATION"), ("ann", "PERSON")], "phrase string, label string")
    row = T.tokenize(docs, phrases=phrases).first()
    assert [e["label"] for e in row["entities"]] == ["EMAIL", "PERSON", "LOCATION", "PERSON"] and "Ann Lee" not in row["tokenized"] and "Oslo" not in row["tokenized"]
    assert D.MODEL_SOURCE in {e["source"] for e in row["entities"]}
    assert docs.select(F.count("*")).first()[0] == 1


def test_what_a_join_moves_is_a_row_for_a_phrase_and_part_not_for_a_place(spark, monkeypatch):
    """Every run of one to three words of every text was a row."""
    written = []
    monkeypatch.setattr(G, "stored", lambda df: written.append(df.localCheckpoint()) or written[0])
    docs = spark.createDataFrame([(i, "ann lee met ann in oslo, far away; " * 40) for i in range(50)], "id long, text string").repartition(1)
    phrases = spark.createDataFrame([("Ann Lee", "PERSON", 0.9), ("oslo", "LOCATION", 0.9), ("ann", "NRP", 0.9)], TABLE)
    got = found(G.with_phrases(docs, phrases, row_id="id", limit=0))
    assert got == found(G.with_phrases(docs, phrases))
    rows = written[0].collect()
    assert len(rows) < 20 and sum(len(r["places"]) for r in rows) < 3 * sum(map(len, got.values()))


def test_ids_that_repeat_or_are_null_and_packed_numbers(spark):
    docs = spark.createDataFrame([(1, "ann in oslo"), (1, "ann in oslo"), (None, "oslo"), (2, None)], "id long, text string")
    phrases = spark.createDataFrame([("oslo", "LOCATION"), ("ann", "PERSON")], "phrase string, label string")
    made = G.with_phrases(docs, phrases, row_id="id", limit=0).collect()
    two = [(0, 3, "PERSON"), (7, 11, "LOCATION")]
    assert sorted((str(r["id"]), [(p["start"], p["end"], p["label"]) for p in r["pieces"]]) for r in made) == [("1", two), ("1", two), ("2", []), ("None", [])]
    rows = G.phrase_rows(docs, phrases, "id").collect()
    assert sorted((str(r["id"]), r["start"], r["label"]) for r in rows) == [("1", 0, "PERSON"), ("1", 7, "LOCATION"), ("None", 0, "LOCATION")]
    for top in (0, 255, 256, 1 << 20):
        assert G._large(G._small(np.array([3, top, 0]))).tolist() == [3, top, 0]
