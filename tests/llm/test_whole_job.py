"""Places where an operator once did less than the whole job."""

import os
import sys

import numpy as np

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import brute  # noqa: E402

from cloakframe.llm import decontaminate, jaccard, mixing  # noqa: E402

FOLDER = "/root/testdata/sf0.001"


def linked(docs, width, percent):
    """``brute.linked_components`` for shingles of any width."""
    return brute.linked_components(docs, percent, width)


# --- near copies at five words and 0.8 ---------------------------------------------------------------------------


def test_near_copies_stage_equals_brute_force_at_five_words(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    want = {c for _, c in linked([tuple(r) for r in docs.select("doc_id", "text").collect()], 5, 80).values()}
    assert sorted(r["doc_id"] for r in corpus_pipeline.without_near_copies(spark, docs, FOLDER).collect()) == sorted(want)


def test_links_at_other_widths_and_percentages_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    docs = []
    for size in [*range(1, 30), 60, 200, 700]:
        words = [f"s{size}w{i}" for i in range(size + 4)]
        docs.append(" ".join(words[:size] if size < 5 else words))
        for edits in (1, 2, size // 40 + 1, size // 25 + 1):
            mine = list(words)
            for _ in range(edits):
                at = int(rng.integers(0, len(mine)))
                kind = rng.integers(0, 3)
                mine[at : at + (kind != 0)] = [] if kind == 1 else [f"e{rng.integers(1000)}"]
            docs.append(" ".join(mine))
    docs = list(enumerate(docs))
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    for width, percent, block in ((5, 80, jaccard.BLOCK), (5, 80, 3), (2, 70, 40)):
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.similar_documents(frame, block, width, percent).collect()}
        assert got == linked(docs, width, percent)


def test_partners_keep_a_common_block_at_other_percentages():
    for percent in (70, 80):
        for a in range(1, 300):
            for b in range(a, 100 * a // percent + 1):
                need = jaccard.overlap_needed(a, b, percent)
                if need <= a:
                    x, y = dict(jaccard.block_counts(a, percent)), dict(jaccard.block_counts(b, percent))
                    assert any(x.get(u) == k and jaccard.may_differ(u, percent) >= a + b - 2 * need for u, k in y.items()), (percent, a, b)


# --- language stage ----------------------------------------------------------------------------------------------


def test_language_stage_rejects_noise_and_unlearned_scripts(spark):
    import corpus_pipeline

    rng = np.random.default_rng(7)
    letters = list("abcdefghijklmnopqrstuvwxyz")
    strange = ["".join(rng.choice(letters, 400)), " ".join("".join(rng.choice(letters, 6)) for _ in range(80)), "q " + "7#%$ 93 " * 50 + "zx",
               "Привет мир, это русский текст о погоде", "数据处理系统的一个测试文本", "Το γρήγορο καφέ αλεπού πηδά πάνω από το τεμπέλικο σκυλί"]
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    extra = spark.createDataFrame([(10**9 + i, t) for i, t in enumerate(strange)], "doc_id long, text string")
    kept = corpus_pipeline.known_language(spark, docs.unionByName(extra, allowMissingColumns=True), FOLDER)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(r["doc_id"] for r in docs.select("doc_id").collect())


def test_language_stage_keeps_letters_where_nothing_is_learned(spark):
    import corpus_pipeline
    from pyspark.sql import functions as F

    rows = [(1, "a text"), (2, "12 34 !"), (3, None), (4, "текст"), (5, "")]
    bare = spark.createDataFrame(rows, "doc_id long, text string")
    for docs in (bare, bare.withColumn("lang", F.lit(None).cast("string"))):
        assert sorted(r["doc_id"] for r in corpus_pipeline.known_language(spark, docs, FOLDER).collect()) == [1, 4]


# --- short test items --------------------------------------------------------------------------------------------


def test_short_items_leak_as_one_run(spark):
    said = "blue heron nests beside rivers"
    items = [(n, " ".join(f"{w}{n}" for w in said.split()[:n])) for n in range(1, 6)]
    longer = (6, "nine tall ships sailed past the quiet northern lighthouse at noon")
    around = " ".join(f"word{i}" for i in range(30))
    docs, want = [], {}
    for n, text in [*items, longer]:
        words = text.split()
        for kind, passage, leaks in (("whole", text, True), ("upper", text.upper(), True), ("turned", " ".join(reversed(words)), n == 1),
                                     ("spread", " between ".join(words), n == 1), ("cut", " ".join(words[:-1]), n == 6)):
            want[len(docs)] = [n] if leaks else []
            docs.append((len(docs), f"{around} {passage} {around}"))
        want[len(docs)] = [n]
        docs.append((len(docs), text))
    rows = decontaminate.contamination(spark.createDataFrame(docs, "doc_id long, text string"),
                                       spark.createDataFrame([*items, longer], "item_id long, text string")).collect()
    assert {r["doc_id"]: r["items"] for r in rows} == want


# --- rows without an id, and rows that repeat one ----------------------------------------------------------------


def test_near_copies_of_rows_without_ids_and_with_repeated_ids(spark):
    def text(name):
        return " ".join(f"{name}{i}" for i in range(60))

    rows = [(None, text("a")), (None, text("b")), (None, text("b") + " end"), (None, text("c")), (5, text("d")), (7, text("d") + " end"), (7, text("e")),
            (7, text("e")), (8, text("f")), (8, text("g")), (None, None), (None, ""), (9, text("a"))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = [tuple(r) for r in jaccard.one_per_group(docs, 5, 80).collect()]
    groups = sorted((t or " ")[0] for _, t in kept)
    assert groups == [" ", " ", "a", "b", "c", "d", "e", "f", "g"]
    assert {i for i, t in kept if t and t[0] in "abc"} == {None} and (5, text("d")) in kept
    assert set(kept) <= set(rows)


def test_rows_without_ids_are_drawn_apart(spark):
    docs = spark.createDataFrame([(None, f"text {i:04d}", "big" if i % 4 else "small") for i in range(4000)], "doc_id long, text string, source string")
    made = mixing.mix(docs, weights={"big": 1.0, "small": 1.0}, repeats=2.0)
    counts = {r[0]: r[1] for r in made.groupBy("source").count().collect()}
    assert abs(counts["big"] / 4000 - 1) < 0.08 and abs(counts["small"] / 4000 - 1) < 0.08
    assert made.select("place").distinct().count() == made.count()
