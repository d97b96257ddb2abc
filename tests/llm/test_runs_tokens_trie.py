"""Periodic runs, token counts and the conversation trie against plain versions."""

import hashlib
import os
import sys
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import brute  # noqa: E402
from compare import compare, connect  # noqa: E402

from cloakframe import llm  # noqa: E402
from cloakframe.llm import periodic, tokencount, turntrie  # noqa: E402

FOLDER = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, runs string, collapsed string, n_tokens int"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# --- periodic runs -----------------------------------------------------------------------------------------------


def plain_runs(words, least=6, exponent=4):
    found = []
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            size = j - i + q
            if j > i and size >= max(least, exponent * q):
                part = words[i : i + size]
                if not any(part[r:] == part[:-r] for r in range(1, q)):
                    found.append((i, size, q))
            i = max(i + 1, j)
    return sorted(found)


def collapsed(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def found_runs(texts, least=6, exponent=4):
    out = []
    for _, _, runs, kept in periodic._runs_of(pa.array(texts, pa.string()), least, exponent):
        out += [([(r["start"], r["length"], r["period"]) for r in rs], k) for rs, k in zip(runs.to_pylist(), kept.to_pylist())]
    return out


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from("aab c dd".split() + ["e", "f"]), max_size=40), max_size=4), st.integers(1, 7), st.sampled_from([(6, 4), (2, 2), (4, 3)]))
def test_runs_equal_brute_force(texts, period, rule):
    texts = texts + [[t[i % min(period, len(t))] for i in range(45)] for t in texts if t]
    want = [plain_runs(t, *rule) for t in texts]
    assert found_runs([" ".join(t) for t in texts], *rule) == [(w, collapsed(t, w)) for t, w in zip(texts, want)]


def test_long_runs_and_equal_hashes():
    words = [f"w{i % 5003}" for i in range(60_000)]
    (runs, kept), (one, _) = found_runs([" ".join(words), " ".join(["a"] * 70_000)])
    assert runs == [(0, 60_000, 5003)] and len(kept.split()) == 5003 and one == [(0, 70_000, 1)]
    data = np.frombuffer(b"ab cd ab cd", np.uint8)
    starts = np.array([0, 3, 6, 9])
    number = periodic._numbers(data, starts, starts + 2, np.zeros(4, np.uint64), np.zeros(4, np.int64))
    assert number[0] == number[2] != number[1] == number[3]


def test_op11_equals_brute_force_on_the_smallest_tables(spark):
    want = {}
    for doc_id, text in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect():
        words = brute.WORD.findall(text or "")
        n, h = len(words), zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        runs = plain_runs(words)
        best = min(((-size, s, q) for s, size, q in runs), default=None)
        row = (None,) * 4 if best is None else (best[1], -best[0], best[2], 1000 * -best[0] // best[2])
        want[doc_id] = (len(runs), *row, sha("".join(f"{s},{size},{q}\n" for s, size, q in runs)), sha(collapsed(words, runs)))
    got = {r[0]: tuple(r)[1:] for r in llm.QUERIES["op11_periodic"](spark, FOLDER).collect()}
    assert got == want
    assert sum(v[0] > 0 for v in want.values()) > 5


def test_runs_of_hostile_rows(spark):
    wheel = " ".join(["x y"] * 10)
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, wheel), (4, wheel), (None, wheel), (5, "a" * 300_000), (6, " ".join(["a b c"] * 40_000)), (7, "ä ä ä ä ä ä")]
    docs = spark.createDataFrame([(*r, "own", "own", 1) for r in rows], DOCS)
    got = sorted((tuple(r) for r in periodic.find_runs(docs).collect()), key=lambda r: (r[0] is not None, r[0] or 0))
    assert len(got) == len(rows)
    assert [(r[0], [tuple(x) for x in r[1]]) for r in got] == [
        (None, [(0, 20, 2)]), (1, []), (2, []), (3, []), (4, [(0, 20, 2)]), (4, [(0, 20, 2)]), (5, []), (6, [(0, 120_000, 3)]), (7, [(0, 6, 1)])]
    assert [r[2] for r in got][:6] == ["x y", "", "", "", "x y", "x y"] and got[7][2] == "a b c" and got[8][2] == "ä"
    assert periodic.find_runs(docs.limit(0)).collect() == []
    # Rows without an id keep their words; only every tenth checksum repeats some.
    kept = {r[0]: r[1] for r in periodic.repeat_tails(docs).collect()}
    assert kept[None] == wheel and kept[1] is None


# --- token counts ------------------------------------------------------------------------------------------------

SIGNS = ["'", "s", "t", "re", "LL", "ve", "m", "D", "1", "23", "!", "-", "<|", "|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|endoftext|>", " ", "\n", "\t", "\x0b",
         "\x1c", "\x00", "é", " ", "\u0085", "́", "İ", "中", "x", "hello", "Hello's", "don't", "_", "😀", "²"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from(SIGNS), max_size=10).map("".join), min_size=1, max_size=5))
def test_counts_equal_the_tokenizer(texts):
    some = tokencount.Lengths([b"hello", b"'s", b"don", b"1"], tokencount.tokens_of(["hello", "'s", "don", "1"]))
    for table in (tokencount.Lengths([], []), some):
        got = [n for *_, tokens in tokencount.count_column(pa.array(texts), table) for n in tokens.tolist()]
        assert got == tokencount.tokens_of(texts)


def test_every_code_point_is_cut_as_the_tokenizer_does():
    points = [chr(c) for c in range(0x3000) if not 0xD800 <= c < 0xE000]
    texts = [f"a{c}b {c}1{c}'s A{c} {c}" for c in points]
    got = np.concatenate([x[3] for x in tokencount.count_column(pa.array(texts), tokencount.Lengths([], []))])
    assert got.tolist() == tokencount.tokens_of(texts)


def test_table_compares_bytes_not_hashes(monkeypatch):
    monkeypatch.setattr(tokencount.Lengths, "hashes", staticmethod(lambda data, starts, ends: np.full(len(starts), 7, np.uint64)))
    table = tokencount.Lengths([b"ab", b"cd", b"abc"], [1, 2, 3])
    data = np.frombuffer(b"cdabcabxy", np.uint8)
    starts, ends = np.array([0, 2, 5, 7]), np.array([2, 5, 7, 9])
    assert table.find(data, starts, ends, np.full(4, 7, np.uint64)).tolist() == [2, 3, 1, -1]


def test_worker_cache_stays_bounded(monkeypatch):
    monkeypatch.setattr(tokencount, "CACHED", 50)
    monkeypatch.setattr(tokencount, "_CACHES", {})
    texts = [f"word{i} other{i}" for i in range(200)]
    for k in range(0, 200, 20):
        got = [n for *_, tokens in tokencount.count_column(pa.array(texts[k : k + 20]), tokencount.Lengths([], [])) for n in tokens.tolist()]
        assert got == tokencount.tokens_of(texts[k : k + 20])
        assert len(tokencount._CACHES[tokencount.VOCABULARY]) <= 100


def test_op12_equals_the_tokenizer(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()
    counts = tokencount.tokens_of([d["text"] or "" for d in docs])
    want = {d["doc_id"]: (len((d["text"] or "").encode()), n, n > 2048) for d, n in zip(docs, counts)}
    assert {r[0]: tuple(r)[1:] for r in llm.QUERIES["op12_tokencount"](spark, FOLDER).collect()} == want


def test_counts_of_hostile_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "Hello world's end"), (4, "Hello world's end"), (None, "x"), (5, "a" * 50_000), (6, "word " * 60_000), (7, "<|endoftext|>")]
    docs = spark.createDataFrame([(*r, "own", "own", 1) for r in rows], DOCS)
    got = sorted((tuple(r) for r in tokencount.count_tokens(docs).collect()), key=lambda r: (r[0] is not None, r[0] or 0))
    counts = tokencount.tokens_of([r[1] or "" for r in rows])
    want = [(r[0], len((r[1] or "").encode()), n, n > 2048) for r, n in zip(rows, counts)]
    assert got == sorted(want, key=lambda r: (r[0] is not None, r[0] or 0))
    assert tokencount.count_tokens(docs.limit(0)).collect() == []
    assert len(tokencount.frequent_units(docs, entries=3).counts) == 3


# --- conversation trie -------------------------------------------------------------------------------------------


def plain_trie(rows):
    """Rows of the trie from (conv_id, turn, role, text) rows."""
    said = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            said.setdefault(conv, []).append((turn is not None, turn or 0, role or "", sha(text or ""), text or ""))
    said = {c: [(r, t) for _, _, r, _, t in sorted(v)] for c, v in said.items()}
    made = {}
    for c in said:
        h = zlib.crc32(str(c).encode()) % 9
        base = c - int(np.fmod(c, 5))
        made[c] = said.get(base, [])[:h] + said[c][h:]
    members = {}
    for c, turns in made.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    children = {}
    for node in members:
        if node:
            children.setdefault(node[:-1], []).append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        below = children.get(node, [])
        leaves[node] = sum(leaves[b] for b in below) or 1
        saved[node] = sum(saved[b] for b in below) + ((len(members[node]) - 1) * len(node[-1][1].encode()) if node else 0)
    return sorted(
        (min(m), len(node), min(members[node[:-1]]) if node else None, len(m), len(children.get(node, [])), leaves[node], saved[node],
         sha(",".join(str(c) for c in sorted(m) if len(made[c]) == len(node)))) for node, m in members.items())


def trie_rows(frame):
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted(tuple(r) for r in frame.select(*names).collect())


TURNS = "conv_id long, turn long, role string, text string, depth string, place string, up string, k1 string, block string, n string"


def turns_frame(spark, rows):
    return spark.createDataFrame([(*r, *["own"] * 6) for r in rows], TURNS)


def test_op13_equals_sql_and_brute_force(spark):
    ok, rows, note = compare(spark, connect(FOLDER), FOLDER, "op13_trie", llm.QUERIES["op13_trie"], llm.ORACLES["op13_trie"])
    assert ok and rows > 10, note
    turns = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert trie_rows(llm.QUERIES["op13_trie"](spark, FOLDER)) == plain_trie(turns)


def test_trie_of_hostile_rows(spark):
    rows = [(1, 0, "user", "a"), (1, 1, None, None), (2, 0, "user", "a"), (2, 0, "user", "a"), (2, None, "user", "é" * 100), (3, 0, "", ""), (None, 0, "user", "a"),
            (-7, 0, "user", "x"), (-7, 1, "assistant", "y"), (-5, 0, "user", "x"), (-3, 0, "user", "x"), (0, 0, "user", "b" * 100_000), (10, 0, "user", "b"), (12, 0, "user", "b"), (13, 5, "a", "a"),
            (13, 5, "a", "b"), (13, 5, "b", "a")]
    assert trie_rows(turntrie.conversation_trie(turns_frame(spark, rows))) == plain_trie(rows)
    assert turntrie.conversation_trie(turns_frame(spark, rows).limit(0)).collect() == []


@pytest.mark.parametrize("block", [8, 1024])
def test_trie_of_long_conversations_in_blocks_and_bands(spark, monkeypatch, block):
    monkeypatch.setattr(turntrie, "BLOCK", block)
    rng = np.random.default_rng(3)
    rows = []
    for c in range(40):
        length = 150 if c in (7, 20, 21) else int(rng.integers(1, 30))
        rows += [(c, i, "user", f"t{i}" if rng.random() < 0.97 else f"t{i} of {c}") for i in range(length)]
    rows += [(20, 10, "user", f"again {i % 3}") for i in range(60)]  # ties within one long conversation
    assert trie_rows(turntrie.conversation_trie(turns_frame(spark, rows))) == plain_trie(rows)


def test_members_of_a_hot_node_are_joined_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(turntrie, "PIECE", 200)
    ends = spark.range(5000).select((F.col("id") % 3 == 0).cast("long").alias("k1"), F.lit(1).cast("long").alias("k2"), (F.col("id") - 100).alias("conv_id"))
    got = {r["k1"]: r["ends_sha256"] for r in turntrie._member_digests(ends).collect()}
    for k in (0, 1):
        assert got[k] == sha(",".join(str(i - 100) for i in range(5000) if (i % 3 == 0) == bool(k)))
