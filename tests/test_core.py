"""Hand fixtures with expected rows, and properties that must hold."""

import random

import pytest
from pyspark.sql import functions as F

from cloakframe import catalog as C
from cloakframe.functions import checks, crypto
from cloakframe.functions import text as X
from cloakframe.operators import access as A
from cloakframe.operators import detect as D
from cloakframe.operators import restore as R
from cloakframe.operators import skew
from cloakframe.operators import spans as S
from cloakframe.operators import tokenize as T
from cloakframe.operators import vault as V



@pytest.fixture(scope="module", autouse=True)
def _key(spark):
    global KEY
    KEY = F.lit("own-test-key-016").cast("binary")


def span_frame(spark, groups):
    rows = [(i, [(s, e, l, float(p), "RULE") for s, e, l, p in g]) for i, g in enumerate(groups)]
    return spark.createDataFrame(rows, f"id int, s {S.SPANS}")


def as_tuples(spans):
    return [(x.start, x.end, x.label, x.score) for x in spans]


def test_merge_fixture(spark):
    df = span_frame(spark, [[(0, 3, "PER", .5), (4, 8, "EMAIL", .9), (10, 12, "IP", .9), (11, 15, "URL", .9)]])
    got = df.select(S.merge_near(F.col("s")).alias("m")).first().m
    assert as_tuples(got) == [(0, 8, "EMAIL", .9), (10, 15, "IP", .9)]


def test_greedy_fixture(spark):
    df = span_frame(spark, [[(0, 5, "A", .5), (4, 8, "C", .9), (7, 9, "B", .5)]])
    assert as_tuples(df.select(S.keep_best(F.col("s")).alias("m")).first().m) == [(4, 8, "C", .9)]


def plain_greedy(spans):
    kept = []
    for s in spans:
        hit = [i for i, k in enumerate(kept) if s[0] < k[1] and k[0] < s[1]]
        if not hit:
            kept.append(s)
        elif s[3] > kept[hit[0]][3]:
            kept[hit[0]] = s
    return kept


def plain_merge(spans, gap=1):
    out = []
    for s in spans:
        if out and s[0] <= out[-1][1] + gap:
            c = out[-1]
            best = s if s[3] > c[3] else c
            out[-1] = (c[0], max(c[1], s[1]), best[2], best[3])
        else:
            out.append(s)
    return out


def test_folds_equal_sequential_rules(spark):
    rng = random.Random(7)
    groups = []
    for _ in range(400):
        spans = []
        for _ in range(rng.randint(0, 9)):
            a = rng.randint(0, 30)
            spans.append((a, a + rng.randint(1, 8), rng.choice("ABC"), rng.choice([.3, .5, .9])))
        groups.append(sorted(spans, key=lambda s: (s[0], -s[3], -s[1])))
    df = span_frame(spark, groups)
    rows = df.select("id", S.keep_best(F.col("s")).alias("k"), S.merge_near(F.col("s")).alias("m")).collect()
    for r in rows:
        assert as_tuples(r.k) == plain_greedy(groups[r.id])
        merged = as_tuples(r.m)
        assert merged == plain_merge(groups[r.id])
        assert all(b[0] > a[1] + 1 for a, b in zip(merged, merged[1:]))


@pytest.mark.parametrize("mode,label,text,expected", [
    ("labelled", "VIN", "VIN: 1HGCM82633A004352", "1HGCM82633A004352"),
    ("labelled", "USERNAME", "user=bob77", "user=bob77"),
    ("labelled", "INSURANCE_NUMBER", "Policy-AB123456", "AB123456"),
    ("compat", "DATE_OF_BIRTH", "12-25-1990", "1990"),
    ("labelled", "DATE_OF_BIRTH", "12-25-1990", "12-25-1990"),
    ("compat", "GRANT_NUMBER", "NIH-2023-12345", "12345"),
    ("labelled", "GRANT_NUMBER", "NIH-2023-12345", "NIH-2023-12345"),
])
def test_trim(spark, mode, label, text, expected):
    df = spark.createDataFrame([(text,)], "text string")
    out = D.with_rule_spans(df, entities=[label], trim=mode).select("text", F.explode("spans").alias("s")).first()
    assert text[out.s.start:out.s.end] == expected


def test_tokenize_fixtures(spark):
    df = spark.createDataFrame(
        [("Mail ann@x.org or PROJ-1234, host 10.0.0.7",), ("A ann@x.org 10.0.0.7 Z",), ("nothing here",), ("",)], "text string"
    )
    assert [r.tokenized for r in T.tokenize(df).collect()] == [
        "Mail [EMAIL_d249273c] or [PROJECT_ID_77b7965b], host [IP_00958fd0]", "A [EMAIL_5c03015c] Z", "nothing here", "",
    ]


@pytest.mark.parametrize("options", [{}, {"in_memory": 0}, {"in_memory": 0, "plain_bytes": 0, "min_rows": 1, "salts": 3}])
def test_first_label_wins_over_units(spark, options):
    one = "55512345 and then also 55512345"
    rows = [
        ("f", 0, one, [(0, 8, "BANK_ACCOUNT", .3, "RULE"), (23, 31, "DRIVERS_LICENSE", .4, "RULE")]),
        ("f", 1, "55512345", [(0, 8, "BANK_ACCOUNT", .3, "RULE")]),
        ("g", 0, "55512345", [(0, 8, "BANK_ACCOUNT", .3, "RULE")]),
    ]
    df = spark.createDataFrame(rows, f"file string, unit int, text string, spans {S.SPANS}")
    known = T.with_shared_labels(T.with_entities(df), ["file"], "unit", **options)
    got = {(r.file, r.unit): r.tokenized for r in T.with_tokenized(known).collect()}
    assert got == {
        ("f", 0): "[DL_ef468642] and then also [DL_ef468642]", ("f", 1): "[DL_ef468642]", ("g", 0): "[BANK_ef468642]",
    }


def test_model_spans(spark):
    rows = [(
        "Ann Lee ann@x.org in Oslo",
        [(18 + 3, 25, "LOC", .99, "AI_MODEL"), ],
        [(0, 3, "PER", .97, "AI_MODEL"), (4, 7, "PER", .90, "AI_MODEL"), (8, 11, "MISC", .99, "AI_MODEL"),
         (18, 20, "MISC", .5, "AI_MODEL"), (21, 25, "LOC", .99, "AI_MODEL")],
    )]
    df = spark.createDataFrame(rows, f"text string, x {S.SPANS}, pieces {S.SPANS}")
    out = T.tokenize(df, model_spans="pieces", entities=["EMAIL_ADDRESS"], gap=0).first()
    assert [(e.start, e.end, e.label) for e in out.entities] == [(0, 7, "PERSON"), (8, 17, "EMAIL"), (21, 25, "LOCATION")]
    with pytest.raises(ValueError):
        D.check_threshold(1.5)


def test_accents_are_word_characters(spark):
    df = spark.createDataFrame([("é123456789 aé 123456789",)], "text string")
    got = D.with_rule_spans(df, entities=["PASSPORT_NUMBER"]).first().spans
    assert [(s.start, s.end) for s in got] == [(14, 23)]


def test_accents_are_outside_ascii_classes(spark):
    df = spark.createDataFrame([("user Laciónos boñ",), ("user Lacion bon",)], "text string")
    got = [[s.label for s in r.spans] for r in D.with_rule_spans(df, entities=["USERNAME"]).collect()]
    assert got == [[], ["USERNAME"]]


def test_places_over_many_blocks(spark):
    from cloakframe.operators.labels import words

    text = " ".join(f"w{i}é" for i in range(1000))
    got = spark.createDataFrame([(text,)], "text string").select(words(F.col("text")).alias("w")).first().w
    assert len(got) == 1000 and all(text[w.start:w.end] == w.word == f"w{i}é" for i, w in enumerate(got))


def test_check_digits(spark):
    rows = [("luhn", "4111 1111 1111 1111", True), ("luhn", "4111 1111 1111 1112", False),
            ("mod97", "GB82WEST12345698765432", True), ("mod97", "GB82WEST12345698765433", False),
            ("mod11", "943 476 5919", True), ("mod11", "943 476 5918", False),
            ("dea", "AB1234563", True), ("dea", "AB1234564", False)]
    df = spark.createDataFrame(rows, "kind string, v string, ok boolean")
    for kind, fn in checks.CHECKS.items():
        assert all(r.ok == r.got for r in df.filter(F.col("kind") == kind).withColumn("got", fn(F.col("v"))).collect())


def test_added_rule_is_used(spark):
    rules = C.add_rule(C.CATALOGUE, C.Rule("LOYALTY", "loyalty", r"\bLOY\d{3}\b", 0.9))
    df = spark.createDataFrame([("card LOY123",)], "text string")
    assert T.tokenize(df, rules=rules).first().tokenized.startswith("card [LOYALTY_")
    with pytest.raises(ValueError):
        C.select_rules(["NO_SUCH"])


def test_encrypt_mode_is_reversible(spark):
    df = spark.createDataFrame([("to ann@x.org now",)], "text string")
    out = T.tokenize(df, mode="encrypt", key=KEY).first().tokenized
    cipher = out[3:-4]
    back = spark.createDataFrame([(cipher,)], "c string").select(crypto.decrypt(F.unbase64("c"), KEY).alias("v")).first().v
    assert back == "ann@x.org"


def test_names_keys_and_guards(spark):
    df = spark.createDataFrame([("a/b.c/x.txt",), (".hidden",), ("y_tokenized.json",)], "p string")
    got = [tuple(r) for r in df.select(X.stem(F.col("p")), X.extension(F.col("p")), X.tokenized_name(F.col("p")), X.decrypted_name(F.col("p"))).collect()]
    assert got == [
        ("a/b.c/x", ".txt", "a/b.c/x_tokenized.txt", "a/b.c/x_decrypted.txt"),
        (".hidden", "", ".hidden_tokenized", ".hidden_decrypted"),
        ("y_tokenized", ".json", "y_tokenized_tokenized.json", "y_decrypted.json"),
    ]
    keys = spark.createDataFrame([("00" * 16,), ("0g",), ("abc",), ("00" * 15,)], "h string").withColumn("k", X.key_from_hex(F.col("h")))
    assert [r[0] for r in keys.select(X.key_is_valid(F.col("k"))).collect()] == [True, None, None, False]
    with pytest.raises(Exception, match="16, 24 or 32"):
        keys.filter("length(h) = 30").select(X.checked_key(F.col("k"))).collect()


def vault_frame(spark, rows):
    df = spark.createDataFrame(rows, "scope_type string, scope_id string, token string, value string, written_at timestamp, filename string")
    return df.select(
        "scope_type", "scope_id", "token", crypto.encrypt(F.col("value"), KEY).alias("ciphertext"),
        F.lit("k").alias("key_id"), "filename", "written_at",
    )


EMAIL, IP = "[EMAIL_d249273c]", "[IP_00958fd0]"


@pytest.mark.parametrize("join", [{}, {"plain_bytes": 0, "min_rows": 1, "salts": 4}])
def test_resolve_under_grants(spark, join):
    from datetime import datetime
    now = datetime(2024, 1, 1)
    vault = vault_frame(spark, [
        ("session", "s1", EMAIL, "ann@x.org", now, "f"), ("dataset", "d1", IP, "10.0.0.7", now, None),
        ("dataset", "d1", EMAIL, "other@x.org", now, None),
    ])
    grants = spark.createDataFrame([("u1", "d1", "EMAIL"), ("u2", "d1", "*")], "user_id string, dataset_id string, entity_type string")
    text = f"{EMAIL} {IP} [SSN_00000000]"
    requests = spark.createDataFrame([
        (1, "viewer", "v", "d1", text, "own-test-key-016"), (2, "analyst", "u1", "d1", text, "own-test-key-016"),
        (3, "analyst", "u2", "d1", text, "own-test-key-016"), (4, "admin", "x", None, text, "own-test-key-016"),
        (5, "analyst", "u1", "d1", text, "WrongKeyWrongKey"), (6, "analyst", "u1", None, text, "own-test-key-016"),
        (7, "admin", "x", "d1", "no tokens", "own-test-key-016"),
    ], "id int, role string, user_id string, dataset_id string, text string, aes string").withColumn("session_id", F.lit("s1"))
    out = R.resolve(
        A.allowed_types(requests, grants), vault, "id", dataset="dataset_id", allowed="allowed",
        key=F.col("aes").cast("binary"), **join,
    ).persist()
    got = {r.id: r for r in out.collect()}
    assert got[1].resolved == text
    assert got[2].resolved == f"ann@x.org {IP} [SSN_00000000]"
    assert got[3].resolved == "ann@x.org 10.0.0.7 [SSN_00000000]"
    assert got[3].missing_tokens == ["[SSN_00000000]"]
    assert got[4].resolved == f"ann@x.org {IP} [SSN_00000000]"
    assert got[5].resolved == text and got[5].failed_tokens == [EMAIL]
    assert got[6].resolved == text
    assert got[7].resolved == "no tokens"
    audit = {(r.id, r.entity_type) for r in R.audit_rows(out, ["id"]).collect()}
    assert audit == {(2, "EMAIL"), (3, "EMAIL"), (3, "IP"), (4, "EMAIL")}


def test_vault_upsert_expiry_and_lookup(spark):
    from datetime import datetime, timedelta
    t0 = datetime(2024, 1, 1)
    first = vault_frame(spark, [("session", "s", EMAIL, "a", t0, "f1"), ("session", "old", IP, "b", t0 - timedelta(days=60), "f2")])
    second = vault_frame(spark, [("session", "s", EMAIL, "c", t0, "f3"), ("session", "s", IP, "d", t0 + timedelta(days=20), "f3")])
    merged = V.upsert(first, second)
    values = {(r.scope_id, r.token): r.v for r in merged.select("scope_id", "token", crypto.decrypt(F.col("ciphertext"), KEY).alias("v")).collect()}
    assert values == {("s", EMAIL): "c", ("s", IP): "d", ("old", IP): "b"}
    assert V.upsert(first, first.filter("false")).count() == 2
    meta = {r.session_id: (r.filename, r.token_count) for r in V.sessions(merged).collect()}
    assert meta == {"s": ("f3", 2), "old": ("f2", 1)}
    as_of = F.lit(t0 + timedelta(days=40)).cast("timestamp")
    for options in ({}, {"plain_bytes": 0, "min_rows": 1, "salts": 2}):
        assert {r.scope_id for r in V.live(merged, as_of, **options).collect()} == {"s"}
    assert {r.filename: r.session_id for r in V.session_of_file(merged).collect()} == {"f3": "s", "f2": "old"}
    assert V.one_token(merged, "s", EMAIL).count() == 1
    assert [r.session_id for r in V.newest_first(V.sessions(merged)).collect()] == ["s", "old"]


def test_dump_import(spark):
    rows = [("tokenmap:a", EMAIL, b"1"), ("tokenmap:b", EMAIL, b"2"), ("keyref:a", "filename", b"x"), ("tokenmap:a", IP, b"3")]
    dump = spark.createDataFrame(rows, "hash_key string, field string, value binary")
    got = V.import_dump(dump, "d9", F.lit("k"), F.current_timestamp())
    assert {(r.scope_type, r.scope_id, r.token, bytes(r.ciphertext)) for r in got.collect()} == {
        ("dataset", "d9", EMAIL, b"2"), ("dataset", "d9", IP, b"3"),
    }
    sets = spark.createDataFrame([("d9", None), ("d8", None)], "dataset_id string, rdb_imported boolean")
    assert {r.dataset_id: r.rdb_imported for r in V.mark_imported(sets, got).collect()} == {"d9": True, "d8": False}


def test_round_trip_properties(spark):
    texts = ["Mail ann@x.org or PROJ-1234, host 10.0.0.7", "SSN 123-45-6789; user: bob_admin; MRN-123456", "plain", "ä MRN: 123456 ß 10.0.0.1"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    made = T.tokenize_messages(df).withColumn("session_id", F.lit("s"))
    again = T.tokenize_messages(df)
    assert [r.tokenized for r in made.orderBy("id").collect()] == [r.tokenized for r in again.orderBy("id").collect()]
    rows = T.encrypted_map(T.token_rows(made, ["session_id"]), KEY)
    vault = V.vault_rows(rows, F.col("session_id"), F.lit("k"), F.lit("f"), F.current_timestamp())
    back = R.resolve(made.select("id", "session_id", F.col("tokenized").alias("text")), vault, "id", key=KEY)
    twice = vault.unionByName(vault.withColumn("written_at", F.current_timestamp()))
    again = R.resolve(made.select("id", "session_id", F.col("tokenized").alias("text")), twice, "id", key=KEY)
    assert sorted(r.resolved for r in again.collect()) == sorted(r.resolved for r in back.collect())
    assert [r.resolved for r in back.orderBy("id").collect()] == texts
    for r in made.collect():
        for e in r.entities:
            assert e.value not in r.tokenized


def test_salted_join_equals_plain_join(spark):
    left = spark.range(2000).select(F.when(F.col("id") < 1400, 0).otherwise(F.col("id") % 50).alias("k"), "id")
    right = spark.range(40).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    hot = skew.hot_keys(left, ["k"], min_rows=100)
    for how in ("inner", "left", "left_semi", "left_anti"):
        a = sorted(map(tuple, left.join(right, ["k"], how).collect()), key=str)
        b = sorted(map(tuple, skew.salted_join(left, right, ["k"], how, hot, 5).collect()), key=str)
        assert a == b


def test_running_totals(spark):
    df = spark.createDataFrame([("a", i, i + 1) for i in range(50)] + [("b", 3, 5)], "k string, n int, x int")
    got = skew.running_totals(df, ["k"], [F.col("n")], F.floor(F.col("n") / 8), F.col("x"), "before")
    for r in got.collect():
        assert r.before == (sum(range(1, r.n + 1)) if r.k == "a" else 0)


def test_many_spans_fold_as_few_do(spark):
    """Runs of spans folded apart give what one fold over all gives."""
    import random

    from cloakframe.operators import spans as S

    rng, rows = random.Random(5), []
    for width in (3, 12, 60):
        starts = sorted(rng.randrange(4000) for _ in range(700))
        rows.append(([(s, s + rng.randrange(1, width), rng.choice("AB"), rng.randrange(1, 9) / 10, "RULE") for s in starts],))
    got = spark.createDataFrame(rows, f"spans {S.SPANS}").select("spans", S.keep_best(F.col("spans")).alias("best"), S.merge_near(F.col("spans")).alias("near"))
    for row in got.collect():
        best, near = [], []
        for s in map(tuple, row.spans):
            if not best or s[0] >= best[-1][1]:
                best.append(s)
            elif s[3] > best[-1][3]:
                best[-1] = s
            if near and s[0] <= near[-1][1] + 1:
                top = s if s[3] > near[-1][3] else near[-1]
                near[-1] = (near[-1][0], max(near[-1][1], s[1]), top[2], top[3], top[4])
            else:
                near.append(s)
        assert [tuple(x) for x in row.best] == best and [tuple(x) for x in row.near] == near


def test_slices_of_long_texts(spark):
    from cloakframe.functions.arrays import block_slice, text_blocks

    text = "".join(chr(97 + i % 26) if i % 7 else "\U0001f600" for i in range(13_000)) + "\n"
    places = [(0, 1), (0, 4096), (4095, 4097), (4096, 4096), (100, 12_999), (8192, 8200), (12_999, 13_001), (0, 13_001)]
    rows = spark.createDataFrame([(text, a, b) for a, b in places], "t string, a int, b int")
    got = rows.select("a", "b", block_slice(text_blocks(F.col("t")), F.col("a"), F.col("b")).alias("s")).collect()
    assert {(r.a, r.b): r.s for r in got} == {(a, b): text[a:b] for a, b in places}


def test_work_grows_with_the_hits_of_one_text(spark):
    import time

    def seconds(n):
        line = "mail a{0}@x.org and bank 4123456{0:05d} "
        rows = spark.createDataFrame([("".join(line.format(i) for i in range(n // 2)),)], "text string")
        start = time.perf_counter()
        made = T.tokenize(rows).select(F.size("entities").alias("n"), F.length("tokenized").alias("size")).first()
        assert made.n >= n // 2
        return time.perf_counter() - start

    seconds(4_000)
    once, twice = seconds(8_000), seconds(16_000)
    assert twice < 3 * once + 1, (once, twice)


def test_added_rules_are_checked(spark):
    import pytest

    with pytest.raises(ValueError):
        C.add_rule([], C.Rule("S3_KEY", "s3", r"\bs3-\d+\b", 0.9))
    rules = C.add_rule([], C.Rule("TICKET", "ticket", r"\bT-\d{3}\b", 0.9, ("never",), 8))
    made = T.tokenize(spark.createDataFrame([("see T-123",)], "text string"), rules=rules).first()
    assert made.tokenized.startswith("see [TICKET_")


def test_text_fields_of_structs_are_found_by_schema(spark):
    rows = spark.createDataFrame(
        [(1, (("mail ann@x.org", 5), "host 10.0.0.7", ["ann@x.org"])), (2, ((None, 6), "plain", [])), (3, (None, None, None)), (4, None)],
        "id int, item struct<inner:struct<text:string,n:int>,text:string,other:array<string>>")
    made = {r["id"]: r for r in T.tokenize_fields(rows, "item").collect()}
    assert T.text_paths(rows.schema["item"].dataType) == ["`inner`.`text`", "`text`"]
    assert made[1]["item"]["inner"]["text"] == "mail [EMAIL_d249273c]" and made[1]["item"]["inner"]["n"] == 5
    assert made[1]["item"]["text"] == "host [IP_00958fd0]" and made[1]["item"]["other"] == ["ann@x.org"]
    assert made[2]["item"]["inner"]["text"] is None and made[2]["item"]["text"] == "plain"
    assert made[3]["item"] is not None and made[3]["item"]["inner"] is None and made[4]["item"] is None
    assert [e["value"] for e in made[1]["entities"]["inner.text"]] == ["ann@x.org"] and [e["label"] for e in made[1]["entities"]["text"]] == ["IP"]
    only = T.tokenize_fields(rows, "item", paths=["text"]).filter("id = 1").first()
    assert only["item"]["inner"]["text"] == "mail ann@x.org" and only["item"]["text"] == "host [IP_00958fd0]"
    none = T.tokenize_fields(rows.select("id", F.struct("id").alias("item")), "item").first()
    assert none["entities"] is None
