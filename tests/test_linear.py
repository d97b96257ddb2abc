"""Work inside one row grows in proportion: pieces and entities of long texts."""

import random
import time

import pytest
from pyspark.sql import functions as F

from cloakframe.operators import labels as L
from cloakframe.operators import spans as S

WORDS = "array<struct<start:int,end:int,word:string>>"
ENTITIES = "array<struct<start:int,end:int,label:string>>"


def plain_tags(words, entities):
    out = []
    for w in words:
        hit = next((e for e in entities if max(w[0], e[0]) < min(w[1], e[1])), None)
        out.append("O" if hit is None else ("B-" if w[0] <= hit[0] else "I-") + hit[2])
    return out


def plain_joined(pieces):
    out = []
    for s, e, label, score, source in pieces:
        if out and out[-1][2] == label and s <= out[-1][1] + 1:
            out[-1] = (out[-1][0], e, label, max(out[-1][3], score), out[-1][4])
        else:
            out.append((s, e, label, score, source))
    return out


def test_tags_equal_a_plain_search(spark):
    rng, rows = random.Random(4), []
    for i in range(300):
        at, words = 0, []
        for _ in range(rng.randrange(40)):
            at += rng.randrange(1, 4)
            words.append((at, at + rng.randrange(1, 6), "w"))
            at = words[-1][1]
        entities = []
        for _ in range(rng.choice([0, 1, 3, 12])):
            a = rng.randrange(max(at, 1))
            entities.append((a, a + rng.randrange(0, 15), rng.choice("PQR")))
        if i % 3 == 0:
            entities.sort()
        rows.append((i, words, entities))
    rows.append((300, [(0, 1, "w")], None))
    found = spark.createDataFrame(rows, f"id int, w {WORDS}, e {ENTITIES}").select("id", L.bio_tags(F.col("w"), F.col("e")).alias("t")).collect()
    assert {r["id"]: r["t"] for r in found} == {i: plain_tags(w, e or []) for i, w, e in rows}


def test_joined_pieces_equal_a_plain_fold(spark):
    rng, rows = random.Random(5), []
    for i in range(300):
        at, pieces = 0, []
        for _ in range(rng.choice([0, 1, 5, 70])):
            at += rng.randrange(0, 4)
            pieces.append((at, at + rng.randrange(1, 5), rng.choice("PQ"), rng.random(), rng.choice("xy")))
            at = pieces[-1][1]
        rows.append((i, pieces))
    found = spark.createDataFrame(rows, f"id int, p {S.SPANS}").select("id", S.join_pieces(F.col("p")).alias("m")).collect()
    assert {r["id"]: [tuple(x) for x in r["m"]] for r in found} == {i: plain_joined(p) for i, p in rows}


def _seconds(df):
    df.collect()
    best = 9e9
    for _ in range(3):
        start = time.perf_counter()
        df.collect()
        best = min(best, time.perf_counter() - start)
    return best


@pytest.mark.parametrize("kind", ["pieces", "tags"])
def test_four_times_the_size_takes_at_most_six_times_the_time(spark, kind):
    def frame(n):
        base = spark.range(1)
        if kind == "pieces":
            made = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: S.span(i * 3, i * 3 + 3, F.when(i % 2 == 0, "PER").otherwise("LOC"), F.lit(0.5), F.lit("m")))
            rows = base.select(made.alias("p")).persist()
            return rows.select(F.size(S.join_pieces(F.col("p"))))
        words = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.struct((i * 5).alias("start"), (i * 5 + 4).alias("end"), F.lit("word").alias("word")))
        entities = F.transform(F.sequence(F.lit(0), F.lit(n // 2 - 1)), lambda i: F.struct((i * 10).alias("start"), (i * 10 + 9).alias("end"), F.lit("PER").alias("label")))
        rows = base.select(words.alias("w"), entities.alias("e")).persist()
        return rows.select(F.size(L.bio_tags(F.col("w"), F.col("e"))))

    small, large = _seconds(frame(16_000)), _seconds(frame(64_000))
    assert large <= 6 * small + 0.3
    assert large < 10
