"""Operators against brute force, exact round trips and hostile rows."""

import collections
import hashlib
import math
import os
import sys
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import brute  # noqa: E402
from compare import compare, connect  # noqa: E402

from cloakframe import llm  # noqa: E402
from cloakframe.llm import (chatformat, common, components, decontaminate, jaccard, language, linededup, mixing,  # noqa: E402
                            quality, sharding, suffix, warc)

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"w{i * i % 977}x{i % 89}" for i in range(30_000))
PASSAGE = "the quick brown fox jumps over a lazy dog while seventeen curious herons watch from the river bank at dawn"


def hostile_rows():
    para = PASSAGE + " " + " ".join(f"word{i}" for i in range(40))
    return [
        (1, None, None, None, None), (2, "", "en", "a", 0), (3, " \n\t ", "en", "a", 3), (4, para, "en", "hot", 1),
        (5, para, "en", "hot", 1), (6, para.upper(), "en", "hot", 1), (7, para + " end", "en", "hot", None), (7, para + " end", "en", "hot", None),
        (8, "one", "de", "b", 3), (9, "One", "de", "b", 3), (10, "one two", None, "b", 7), (11, LONG, "en", "b", len(LONG)),
        (12, "x " + LONG, "en", None, 1), (13, "a\nlonger line here\na\nlonger line here", "en", "b", 1),
        (14, "  LONGER line here \nzzz", "fr", "b", 1), (15, "é" * 150 + "\n" + "é" * 150, "fr", "b", 1), (None, para, None, None, None),
        (16, "12345 67 !!", "en", "b", 2), (17, "#*# $$ %% && |<>", "en", "b", 2),
    ]


@pytest.fixture(scope="module")
def hostile(spark):
    rows = hostile_rows()
    frame = spark.createDataFrame(rows, SCHEMA)
    extra = ["copy", "place", "size", "slot", "shard", "kept_text", "n_lines", "lang_pred", "score", "items", "leak_score", "sid", "entries", "count", "n", "Key"]
    for name in extra:
        from pyspark.sql import functions as F

        frame = frame.withColumn(name, F.lit("own"))
    return frame


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


@pytest.mark.parametrize("name", sorted(llm.ORACLES))
def test_query_equals_sql(spark, name):
    ok, rows, note = compare(spark, connect(FOLDER), FOLDER, name, llm.QUERIES[name], llm.ORACLES[name])
    assert ok, note
    assert rows > 0


# --- 1 quality ---------------------------------------------------------------------------------------------------


def test_binomial_tail_is_exact():
    for n, k, p in [(10, 3, 0.3), (50, 0, 0.02), (7, 7, 0.5), (0, 0, 0.1)]:
        want = sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
        assert quality.at_most(k, n, p) == pytest.approx(want, rel=1e-9)


def test_quality_of_hostile_rows_and_empty_tables(spark, hostile, empty):
    labels = spark.createDataFrame([(4, 1), (4, 0), (None, 1), (5, None)], "doc_id long, quality int")
    rows = quality.judge(hostile, labels).collect()
    assert len(rows) == hostile.count()
    by = {r["doc_id"]: r for r in rows}
    assert by[1]["n_words"] == 0 and by[1]["base_failed"] and not by[1]["kept"]
    assert by[4]["kept"] and by[13]["n_dup_lines"] == 2 and by[17]["n_symbols"] == 12
    assert by[15]["word_chars"] == 300
    assert quality.judge(empty, labels).count() == 0
    assert quality.judge(hostile, labels.limit(0)).filter("kept").count() > 0


def test_cutoffs_keep_the_promise(spark):
    rows = [("s", 0 if i % 100 else 400, 0, 0, 5000) for i in range(4000)]
    frame = spark.createDataFrame(rows, "stratum string, symbols long, dup_lines long, repeats long, word_length long")
    cut = quality.certified(frame).first()
    assert cut["cut_symbols"] is None  # one good document in a hundred lies above every cutoff
    assert cut["cut_dup_lines"] == min(quality.GRIDS["dup_lines"])


# --- 2 mixing ----------------------------------------------------------------------------------------------------


def test_mixture_meets_its_weights(spark):
    rows = [(i, "x" * 9, "en", "big" if i % 4 else "small", 9) for i in range(8000)]
    docs = spark.createDataFrame(rows, SCHEMA)
    made = mixing.mix(docs, weights={"big": 1.0, "small": 1.0}, repeats=2.0)
    counts = {r[0]: r[1] for r in made.groupBy("source").count().collect()}
    assert counts["big"] == pytest.approx(8000, rel=0.05) and counts["small"] == pytest.approx(8000, rel=0.07)
    again = {(r["doc_id"], r["copy"]) for r in mixing.mix(docs, weights={"big": 1.0, "small": 1.0}, repeats=2.0).collect()}
    assert again == {(r["doc_id"], r["copy"]) for r in made.collect()}


def test_mixing_hostile_rows_and_empty_tables(hostile, empty):
    made = mixing.mix(hostile, repeats=3.0)
    assert made.columns == [*hostile.columns, "copy_", "place_"]
    assert made.count() > 0 and made.filter("copy != 'own'").count() == 0
    assert mixing.mix(empty).count() == 0


# --- 3 decontamination -------------------------------------------------------------------------------------------


def test_leaks_equal_brute_force(spark, documents):
    items = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").select("item_id", "text").collect()]
    got = {r["doc_id"]: r["items"] for r in llm.QUERIES["op3_decontaminate"](spark, FOLDER).collect()}
    for r in documents.select("doc_id", "text").collect():
        assert got[r[0]] == brute.leaked_items(r[1], items), r[0]


def test_leaks_in_hostile_rows(spark, hostile, empty):
    items = spark.createDataFrame([(1, PASSAGE), (2, None), (3, ""), (4, PASSAGE), (None, "something else entirely here")], "item_id long, text string")
    rows = decontaminate.contamination(hostile, items).collect()
    assert len(rows) == hostile.count()
    assert {r["doc_id"] for r in rows if r["items_"] == [1]} == {4, 5, 6, 7, None}
    assert decontaminate.contamination(empty, items).count() == 0
    assert decontaminate.clean(hostile, items.limit(0)).count() == hostile.count()


def test_several_indexes_find_the_same(spark, documents):
    items = spark.read.parquet(f"{FOLDER}/benchmark.parquet")
    few = documents.filter("doc_id % 5 = 0").select("doc_id", "text")
    pick = lambda df: sorted((r["doc_id"], tuple(r["items"])) for r in df.collect())
    assert pick(decontaminate.contamination(few, items, index_bytes=4000)) == pick(decontaminate.contamination(few, items))


def test_wand_equals_full_scoring(spark):
    index = next(decontaminate.indexes(spark.read.parquet(f"{FOLDER}/benchmark.parquet"), threshold=0.2))
    rng = np.random.default_rng(1)
    for _ in range(200):
        terms = np.unique(rng.integers(0, len(index.terms), 60))
        sums = collections.Counter()
        for t in terms:
            for i, w in zip(*index.lists[t][:2]):
                sums[i] += w
        want = {i for i, s in sums.items() if s >= 0.2}
        assert set(index.wand(terms)) == want


# --- 4 WARC ------------------------------------------------------------------------------------------------------


def test_warc_round_trip(spark, tmp_path):
    pages = spark.createDataFrame(
        [(1, "http://a", "é"), (2, "http://b", "é"), (3, None, None), (4, "http://x\r\nEvil: 1", ""), (4, "http://x\r\nEvil: 1", ""), (None, "u", "é")],
        "page_id long, url string, html string")
    folder = str(tmp_path / "archive")
    warc.write_archive(pages, folder)
    assert spark.read.parquet(f"{folder}/payloads").count() == 2
    rows = {(r["page_id"], r["record_type"], r["refers_to"], r["payload_bytes"]) for r in warc.read_index(spark, folder).collect()}
    assert rows == {(2, "response", None, 2), (1, "revisit", 2, 2), (None, "revisit", 2, 2), (4, "response", None, 0), (3, "revisit", 4, 0)}
    records = warc.read_records(spark, folder).collect()
    assert len(records) == 6
    for r in records:
        head, _, block = bytes(r["record"]).partition(b"\r\n\r\n")
        size = int(head.split(b"Content-Length: ")[1].split(b"\r\n")[0])
        assert block[size:] == b"\r\n\r\n" and b"\r\nEvil" not in head
    warc.write_archive(pages.limit(0), str(tmp_path / "none"))
    assert warc.read_index(spark, str(tmp_path / "none")).count() == 0


# --- 5 language --------------------------------------------------------------------------------------------------


@settings(max_examples=40, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="abcABC éß1-\n中", max_size=30)), max_size=5))
def test_gram_counts_equal_brute_force(texts):
    data, offsets = common.text_bytes(pa.array(texts, pa.string()))
    rows, grams, counts, letters = language.gram_counts(data, offsets)
    got = [collections.Counter() for _ in texts]
    for r, g, c in zip(rows.tolist(), grams.tolist(), counts.tolist()):
        symbols = [(g >> s) & 0xFFFF for s in (32, 16, 0)]
        got[r]["".join(" " if s == 1 else chr(s - 1) for s in symbols if s)] = c
    assert got == [collections.Counter(brute.grams(t or "")) for t in texts]
    assert letters.tolist() == [sum(c.isalpha() for c in t or "") for t in texts]


def test_languages_held_out(spark, hostile, empty, documents):
    lang = {r[0]: r[1] for r in documents.select("doc_id", "lang").collect()}
    rows = llm.QUERIES["op5_language"](spark, FOLDER).collect()
    held = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in held) / len(held) >= 0.95
    profiles = language.fit(documents)
    found = language.identify(hostile, profiles).collect()
    assert all((r["lang_pred_"] == "und") == (not r["text"] or not any(c.isalpha() for c in r["text"])) for r in found)
    assert all(0 <= r["score_"] <= 1 for r in found)
    assert language.identify(empty, profiles).count() == 0
    assert {r["lang_pred_"] for r in language.identify(hostile, language.fit(empty)).collect()} == {"und"}


# --- 6 lines -----------------------------------------------------------------------------------------------------


def test_lines_of_hostile_rows(hostile, empty):
    rows = {r["doc_id"]: r for r in linededup.dedup_lines(hostile, n_batches=3).collect()}
    assert linededup.dedup_lines(hostile).count() == hostile.count()
    assert rows[13]["kept_text_"] == "a\nlonger line here\na\nlonger line here" and rows[14]["kept_text_"] == "zzz"
    assert rows[1]["kept_text_"] == "" and rows[1]["n_lines_"] == 1 and rows[2]["n_dropped"] == 0
    assert rows[5]["n_dropped"] == 1 and rows[4]["n_dropped"] == 1 and rows[None]["n_dropped"] == 0  # NULL ids come first
    assert linededup.dedup_lines(empty).count() == 0


def test_number_of_batches_and_fan_change_nothing(documents):
    docs = documents.select("doc_id", "text")
    pick = lambda n, fan: {tuple(r) for r in linededup.dedup_lines(docs, n, fan).select("doc_id", "kept_text").collect()}
    assert pick(1, 2) == pick(7, 2)


# --- 7 shards ----------------------------------------------------------------------------------------------------


def check_shards(rows, largest):
    sizes, slots = collections.Counter(), collections.defaultdict(list)
    for shard, size, slot in rows:
        sizes[shard] += size
        slots[shard].append(slot)
    assert max(sizes.values()) - min(sizes[i] for i in range(8)) <= 2 * largest
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_shards_are_even_and_gapless(spark, hostile, empty):
    rows = llm.QUERIES["op7_sharding"](spark, FOLDER).collect()
    check_shards([(r["shard"], r["size"], r["slot"]) for r in rows], max(r["size"] for r in rows))
    assert all(r["grown_shard"] is None and r["law"] == "bytes" for r in rows)
    made = sharding.shard(hostile).collect()
    assert len(made) == hostile.count()
    check_shards([(r["shard_"], r["size_"], r["slot_"]) for r in made], max(r["size_"] for r in made))
    assert sharding.shard(empty).count() == 0


def test_a_third_of_equal_texts_is_subdivided(spark):
    rows = [(i, "same text" if i % 3 == 0 else f"text {i}", "en", "s", 1) for i in range(6000)]
    docs = spark.createDataFrame(rows, SCHEMA)
    made = sharding.shard(docs, range_bytes=1 << 10).collect()
    check_shards([(r["shard"], r["size"], r["slot"]) for r in made], 20)
    assert len({r["shard"] for r in made if r["text"] == "same text"}) <= 4


# --- 8 suffixes --------------------------------------------------------------------------------------------------


def test_removed_bytes_equal_brute_force(spark, documents):
    want = brute.removed_bytes([tuple(r) for r in documents.select("doc_id", "text").collect()])
    got = {r[0]: tuple(r)[1:] for r in llm.QUERIES["op8_suffix"](spark, FOLDER).collect()}
    assert got == want


def test_removed_bytes_of_periodic_and_odd_texts(spark, hostile, empty):
    texts = ["a" * 400, "ab" * 300, "a" * 99, "a" * 100, None, "", "ab" * 60 + "c" * 120 + "ab" * 60, "é" * 120, "x" + "é" * 120,
             LONG[:3000], "prefix " + LONG[500:2500] + LONG[:700], LONG[1000:1099], LONG[1000:1100]]
    docs = list(enumerate(texts))
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(bytes(r["kept"])).hexdigest()) for r in suffix.remove_repeats(frame).collect()}
    assert got == brute.removed_bytes(docs)
    rows = suffix.remove_repeats(hostile).collect()
    assert len(rows) == hostile.count()
    first = {r["doc_id"]: r for r in rows}
    assert first[None]["n_removed"] == 0 and first[4]["n_removed"] == first[4]["n_bytes"]
    assert suffix.remove_repeats(empty).count() == 0


@settings(max_examples=30, deadline=None)
@given(st.lists(st.lists(st.binary(min_size=0, max_size=3), max_size=20), min_size=0, max_size=6))
def test_loser_tree_merges(runs):
    width = suffix._KEY
    ordered = [np.array([list(x) for x in sorted({x.ljust(width, b"\1") for x in r})], np.uint8).reshape(-1, width) for r in runs]
    coded = [suffix._decoded(*suffix.front_code(k)) for k in ordered]
    keys, shared, source = suffix.merge_runs(coded) if coded else ([], [], [])
    assert keys == sorted(bytes(k) for run in ordered for k in run)
    assert shared[:1] in ([], [0])
    for a, b, n in zip(keys, keys[1:], shared[1:]):
        assert a[:n] == b[:n] and (n == width or a[n] != b[n])


# --- 9 chats -----------------------------------------------------------------------------------------------------


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "<turn>x"]), st.text(alphabet="<\\/turnex>ab\n", max_size=30)), max_size=5))
def test_chats_can_be_read_back(turns):
    text, spans = chatformat.compile_template(chatformat.TEMPLATE)([{"role": r, "text": t} for r, t in turns])
    assert chatformat.read_turns(text) == turns
    assert [chatformat.unescape(text[a:b]) for a, b in spans] == [t for r, t in turns if r == "assistant"]


def test_template_language():
    def run(source, messages=()):
        return chatformat.compile_template(source)(list(messages))[0]

    one = [{"role": "user", "text": " A "}]
    assert run("{{ 'a' + 'b' }}{{ 1 }}") == "ab1"
    assert chatformat.fold(chatformat.parse("{% if 1 == 1 %}x{{ 'y' }}{% else %}z{% endif %}")) == (chatformat.Output(chatformat.Const("xy")),)
    assert run("{% for m in messages %}{% if not m.role == 'user' %}n{% elif m['text'] | trim == 'A' %}y{% endif %}{% endfor %}", one) == "y"
    assert run("{{ messages.append }}{{ nothing.here }}", one) == ""
    for bad in ("{{ messages.__class__ }}", "{{ f() }}", "{% for x %}{% endfor %}", "{% if a %}", "{{ a | exec }}", "{{ }}", "{% endif %}", "{% include 'x' %}"):
        with pytest.raises(chatformat.TemplateError):
            chatformat.parse(bad)


def test_chats_of_hostile_rows(spark):
    rows = [(1, 1, "assistant", None), (1, None, None, "x"), (1, 1, "assistant", None), (None, 0, "user", "u"), (2, 0, "assistant", "y" * 100_000)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    made = {r["conv_id"]: r for r in chatformat.digests(chatformat.format_chats(frame)).collect()}
    assert {k: (r["n_turns"], r["loss_chars"]) for k, r in made.items()} == {1: (3, 0), None: (1, 0), 2: (1, 100_000)}
    assert chatformat.format_chats(frame.limit(0)).count() == 0


# --- 10 similarity -----------------------------------------------------------------------------------------------


def test_every_pair_within_reach_shares_a_key():
    for a in range(1, 700):
        for b in range(a, 100 * a // jaccard.PERCENT + 1):
            need = jaccard.overlap_needed(a, b)
            if need <= a:
                x, y = dict(jaccard.block_counts(a)), dict(jaccard.block_counts(b))
                assert any(x.get(u) == k and k > a + b - 2 * need for u, k in y.items()), (a, b)


def test_links_of_small_and_edited_sets_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    docs = []
    for size in [*range(1, 40), 60, 200, 1500]:
        words = [f"s{size}w{i}" for i in range(size + 2)]
        docs.append(" ".join(words))
        for edits in (1, 1, 2, 3, size // 30):
            mine = list(words)
            for _ in range(edits):
                at = int(rng.integers(0, len(mine)))
                kind = rng.integers(0, 3)
                mine[at : at + (kind != 0)] = [] if kind == 1 else [f"e{rng.integers(1000)}"]
            docs.append(" ".join(mine))
    docs = list(enumerate(docs))
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    want = brute.linked_components(docs)
    for block in (jaccard.BLOCK, 3):
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.similar_documents(frame, block).collect()}
        assert got == want


def test_similar_hostile_rows(hostile, empty):
    rows = collections.Counter(tuple(r) for r in jaccard.similar_documents(hostile).collect())
    assert rows.total() == hostile.count()
    by = {r[0]: r for r in rows}
    assert by[1][1:] == (0, 1) and by[2][1:] == (0, 2) and by[9] == (9, 1, 8) and by[12][2] == 11
    assert {by[k][2] for k in (None, 4, 5, 6, 7)} == {None}
    kept = jaccard.one_per_group(hostile)
    assert kept.columns == hostile.columns
    assert sorted((r["doc_id"] or 0) for r in kept.collect()) == [0, 1, 2, 3, 8, 10, 11, 13, 14, 15, 16, 17]
    assert jaccard.similar_documents(empty).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 150)] + [(7, 7), (200, 150), (-5, 200)]
    got = dict(tuple(r) for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 150)} | {i: -5 for i in (-5, 150, 200)}
