"""Detection and tokenization over documents and entity texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import catalog as C
from ..functions import crypto
from ..functions.arrays import exploded
from ..functions.sql import register, tokenized_view
from ..operators import detect as D
from ..operators import gazetteer as GZ
from ..operators import spans as S
from ..operators import tagger as TG
from ..operators import tokenize as T
from . import sqltext as Q
from . import texts as X
from .registry import customer_texts, documents, joined, query, rel, spread, table

DOCS = "SELECT doc_id AS id, text FROM documents"


def entity_source(expression: str, extra: str = "") -> str:
    numbers = X.NUMBERS.replace("{customer}", "customer")
    return f"SELECT c_custkey AS id, {X.flat(X.sql_newlines(expression))} AS text{extra} FROM ({numbers})"


ALL = entity_source(X.ALL_TEXT)
SPAN_SQL = "SELECT id, s AS start, e AS \"end\", label, round(score, 6) AS score, substr(text, s + 1, e - s) AS value"


def span_rows(df, spans="spans"):
    return D.spans_as_rows(df, ["id"], spans=spans).select(
        "id", "start", "end", "label", F.round("score", 6).alias("score"), F.col("text").alias("value"))


def match_rows(df, rules):
    labels = F.expr("array(" + ", ".join(f"'{r.entity}'" for r in rules) + ")")
    names = F.expr("array(" + ", ".join(f"'{r.name}'" for r in rules) + ")")
    rows = exploded(df, ["id"], "matches", "m")
    return rows.select(
        "id", F.get(labels, F.col("m.rule")).alias("label"), F.get(names, F.col("m.rule")).alias("pattern"),
        F.col("m.start").alias("start"), F.col("m.end").alias("end"), F.col("m.hit").alias("value"))


def _match_sql(rules, source):
    names = ", ".join(f"({i}, {Q.q(r.entity)}, {Q.q(r.name)})" for i, r in enumerate(rules))
    return (
        f"WITH {Q.matches(rules, source)} SELECT id, label, pattern, s AS start, e AS \"end\", v AS value "
        f"FROM matches JOIN (VALUES {names}) n(rule, label, pattern) USING (rule)"
    )


query("scan_patterns", _match_sql(C.CATALOGUE, DOCS))(
    lambda s, d: match_rows(D.with_matches(documents(s, d)), C.CATALOGUE))
query("scan_patterns_entity_texts", _match_sql(C.CATALOGUE, ALL))(
    lambda s, d: match_rows(D.with_matches(customer_texts(s, d, X.ALL_TEXT)), C.CATALOGUE))

ALLOWED = ["EMAIL_ADDRESS", "IP_ADDRESS", "API_KEY"]
query("entity_allow_list", f"WITH {Q.detection(C.select_rules(ALLOWED), DOCS)} {SPAN_SQL} FROM spans JOIN src USING (id)")(
    lambda s, d: span_rows(D.with_rule_spans(documents(s, d), entities=ALLOWED)))

PAGE_RULES = C.select_rules(["URL"])
PAGE_TEXT = "coalesce(url, '') || chr(10) || coalesce(html, '')"
query("urls_of_pages", f"WITH {Q.detection(PAGE_RULES, f'SELECT page_id AS id, {PAGE_TEXT} AS text FROM pages')} {SPAN_SQL} FROM spans JOIN src USING (id)")(
    lambda s, d: span_rows(D.with_rule_spans(table(s, d, "pages").select(F.col("page_id").alias("id"), F.expr(PAGE_TEXT).alias("text")), entities=["URL"])))

# One query per entity: all its patterns, context, overlap and trimming on its own line of text.
for _entity, _text in X.ENTITY_TEXT.items():
    _rules = C.select_rules([_entity])
    query(f"entity_{_entity.lower()}", f"WITH {Q.detection(_rules, entity_source(_text))} {SPAN_SQL} FROM spans JOIN src USING (id)")(
        lambda s, d, e=_entity, t=_text: span_rows(D.with_rule_spans(customer_texts(s, d, t), entities=[e])))

query("context_scores", f"WITH {Q.matches(C.CATALOGUE, ALL)}, {Q.scored(C.CATALOGUE)} "
      "SELECT id, s AS start, e AS \"end\", label, round(score, 6) AS score FROM scored")(
    lambda s, d: D.spans_as_rows(D.with_rule_spans(customer_texts(s, d, X.ALL_TEXT), resolve=False), ["id"]).select(
        "id", "start", "end", "label", F.round("score", 6).alias("score")))

for _mode in ("labelled", "compat", "off"):
    query(f"trim_prefix_{_mode}", f"WITH {Q.detection(C.CUSTOM_RULES, ALL, _mode)} {SPAN_SQL} FROM spans JOIN src USING (id)")(
        lambda s, d, m=_mode: span_rows(D.with_rule_spans(customer_texts(s, d, X.ALL_TEXT), rules=C.CUSTOM_RULES, trim=m)))

query("resolve_overlaps", f"WITH {Q.detection(C.CATALOGUE, DOCS)} {SPAN_SQL} FROM spans JOIN src USING (id)")(
    lambda s, d: span_rows(D.with_rule_spans(documents(s, d))))

query("detection_report", f"WITH {Q.detection(C.CATALOGUE, ALL)} SELECT label, src_name AS source, count(*) AS n, "
      "printf('%.4f', avg(score)) AS mean_score, printf('%.4f', max(score)) AS best_score FROM spans GROUP BY 1, 2")(
    lambda s, d: D.report(D.spans_as_rows(D.with_rule_spans(customer_texts(s, d, X.ALL_TEXT)), ["id"])))

# Model pieces: every word of a document; runs of equal case pattern share a label.
PIECE_LABEL = "CASE WHEN regexp_matches(v, '^[A-Z]') THEN 'PER' WHEN length(v) > 6 THEN 'ORG' ELSE 'MISC' END"
PIECE_SCORE = "round(0.5 + length(v) / 25.0, 4)"
PIECES_SQL = (
    Q.all_places("text", r"\S+", f"({DOCS})") +
    f", words_of AS (SELECT id, i, s, CAST(s + length(v) AS INTEGER) AS e, {PIECE_LABEL} AS label, CAST({PIECE_SCORE} AS DOUBLE) AS score FROM found)"
)
JOINED_SQL = PIECES_SQL + """, runs AS (SELECT *, sum(fresh) OVER (PARTITION BY id ORDER BY i ROWS UNBOUNDED PRECEDING) AS run FROM (
  SELECT *, CASE WHEN label = lag(label) OVER w AND s <= lag(e) OVER w + 1 THEN 0 ELSE 1 END AS fresh FROM words_of
  WINDOW w AS (PARTITION BY id ORDER BY i))),
model AS (SELECT id, min(s) AS s, max(e) AS e, first(label) AS label, max(score) AS score FROM runs GROUP BY id, run)"""


def with_pieces(df):
    from ..operators.labels import words

    piece = lambda w: S.span(
        w["start"], w["end"],
        F.when(F.rlike(w["word"], F.lit("^[A-Z]")), "PER").when(F.length(w["word"]) > 6, "ORG").otherwise("MISC"),
        F.round(F.lit(0.5) + F.length(w["word"]) / F.lit(25.0), 4), F.lit(D.MODEL_SOURCE))
    return df.withColumn("_w", words(F.col("text"))).withColumn("pieces", F.transform("_w", piece)).drop("_w")


def short_rows(df, spans):
    return exploded(df, ["id"], spans, "s").select(
        "id", F.col("s.start").alias("start"), F.col("s.end").alias("end"), F.col("s.label").alias("label"),
        F.round("s.score", 4).alias("score"))


query("model_pieces_joined", f"WITH {JOINED_SQL} SELECT id, s AS start, e AS \"end\", label, round(score, 4) AS score FROM model")(
    lambda s, d: short_rows(with_pieces(documents(s, d)).withColumn("m", S.join_pieces(F.col("pieces"))), "m"))
query("model_threshold", f"WITH {JOINED_SQL} SELECT id, s AS start, e AS \"end\", label, round(score, 4) AS score FROM model WHERE score >= 0.95")(
    lambda s, d: short_rows(D.with_model_spans(with_pieces(documents(s, d)), "pieces", threshold=0.95), "spans"))
query("rules_and_model_spans", f"""WITH {JOINED_SQL}, {Q.detection(C.CATALOGUE, DOCS)}
SELECT id, s AS start, e AS "end", label, round(score, 4) AS score, 'RULE' AS source FROM spans
UNION ALL SELECT id, s, e, label, round(score, 4), 'AI_MODEL' FROM model m WHERE score >= 0.95 AND NOT EXISTS (
  SELECT 1 FROM spans r WHERE r.id = m.id AND m.s < r.e AND r.s < m.e)""")(
    lambda s, d: D.spans_as_rows(
        D.with_model_spans(D.with_rule_spans(with_pieces(documents(s, d)), out="r"), "pieces", "r", out="spans"), ["id"]
    ).select("id", "start", "end", "label", F.round("score", 4).alias("score"), "source"))

PHRASES = {"LOCATION": ["China", "France", "Germany", "United States", "United Kingdom", "Brazil"], "PERSON": ["Ada Abel", "Ada"]}
PHRASE_TEXT = "'Ada Abel met Adam in ' || lower(n_name) || ', ' || n_name || 's and United  States; ada of CHINA. ' || c_name"
_PH_RULES = [C.Rule(k, k, r"\b(?:" + "|".join(sorted(v, key=lambda p: (-len(p), p))) + r")\b", 0.85) for k, v in PHRASES.items()]
_PH_SRC = f"SELECT c_custkey AS id, {PHRASE_TEXT} AS text FROM customer JOIN nation ON c_nationkey = n_nationkey"
query("listed_phrases", f"WITH {Q.matches(_PH_RULES, _PH_SRC)}, {Q.scored(_PH_RULES, boost=0)}, {Q.kept()} "
      "SELECT id, s AS start, e AS \"end\", label FROM kept")(
    lambda s, d: short_rows(TG.with_phrases(rel(s, d, _PH_SRC.replace("FROM customer JOIN nation", "FROM {customer} JOIN {nation}")), PHRASES), "pieces").drop("score"))

# Names from the given tables: openings of documents, benchmark items and conversations.
NAMES = r"""SELECT regexp_extract(text, '[A-Za-zÀ-ɏ]+ [A-Za-zÀ-ɏ]+', 0) AS phrase, 'PERSON' AS label FROM {documents}
UNION ALL SELECT regexp_extract(text, '[A-Za-zÀ-ɏ]+ [A-Za-zÀ-ɏ]+ [A-Za-zÀ-ɏ]+', 0), 'LOCATION' FROM {benchmark}
UNION ALL SELECT regexp_extract(text, '[A-Za-zÀ-ɏ]+', 0), 'NRP' FROM {conversations}"""
_W = r"[\p{L}\p{N}\p{M}_]+"
NAMED_SQL = f"""WITH p AS (SELECT lower(phrase) AS phrase, min(label) AS label FROM ({NAMES.replace('{documents}', 'documents').replace('{benchmark}', 'benchmark').replace('{conversations}', 'conversations')}) WHERE phrase <> '' GROUP BY 1),
x AS (SELECT doc_id AS id, unnest(l) AS piece, generate_subscripts(l, 1) AS i FROM (SELECT doc_id, regexp_extract_all(lower(text), '{_W}|[^{_W[1:-2]}]+') AS l FROM documents)),
y AS (SELECT id, piece, i, CAST(sum(length(piece)) OVER (PARTITION BY id ORDER BY i) AS INTEGER) AS e FROM x),
w AS (SELECT id, e - length(piece) AS s, e, row_number() OVER (PARTITION BY id ORDER BY i) AS k FROM y WHERE regexp_matches(piece, '^{_W}$')),
g AS (SELECT a.id, a.s, b.e, substring(lower(d.text), CAST(a.s + 1 AS BIGINT), CAST(b.e - a.s AS BIGINT)) AS phrase FROM w a JOIN w b ON a.id = b.id AND b.k BETWEEN a.k AND a.k + 2 JOIN documents d ON d.doc_id = a.id),
c AS (SELECT id, s, max(e) AS e, arg_max(label, e) AS label FROM g JOIN p USING (phrase) GROUP BY 1, 2),
f AS (SELECT id, list_reduce(list([{{'s': s, 'e': e, 'label': label}}] ORDER BY s), lambda a, b: CASE WHEN b[1].s >= a[-1].e THEN list_concat(a, b) ELSE a END) AS l FROM c GROUP BY 1)
SELECT id, x.s AS start, x.e AS "end", x.label AS label FROM (SELECT id, unnest(l) AS x FROM f)"""


def _named(s, d, limit):
    rows = documents(s, d)
    found = GZ.with_phrases(rows, rel(s, d, NAMES).filter("phrase <> ''"), row_id="id", limit=limit)
    return short_rows(found, "pieces").drop("score")


query("named_entities", NAMED_SQL)(lambda s, d: _named(s, d, GZ.PHRASE_BYTES))
query("named_entities_joined", NAMED_SQL)(lambda s, d: _named(s, d, 0))  # as for a table too large for every task

query("merge_neighbours", f"WITH {Q.detection(C.CATALOGUE, ALL)}, {Q.merged()} SELECT id, s AS start, e AS \"end\", label, round(score, 6) AS score FROM merged")(
    lambda s, d: short_rows(
        D.with_rule_spans(customer_texts(s, d, X.ALL_TEXT)).withColumn("m", S.merge_near(F.col("spans"))), "m"
    ).withColumn("score", F.round("score", 6)))
query("merge_neighbours_wide_gap", f"WITH {Q.detection(C.CATALOGUE, ALL)}, {Q.merged(gap=6)} SELECT id, s AS start, e AS \"end\", label FROM merged")(
    lambda s, d: short_rows(
        D.with_rule_spans(customer_texts(s, d, X.ALL_TEXT)).withColumn("m", S.merge_near(F.col("spans"), 6)), "m").drop("score"))

query("label_names", f"WITH {Q.norm_table()} SELECT c_custkey, c_mktsegment AS label, left(coalesce(short, upper(l)), 20) AS token_label, "
      "'[' || left(coalesce(short, upper(l)), 20) || '_' || substr(md5(c_name), 1, 8) || ']' AS token FROM ("
      "SELECT *, CASE c_mktsegment WHEN 'BUILDING' THEN 'EMAIL_ADDRESS' WHEN 'MACHINERY' THEN 'LOC' ELSE 'my_own_label_' || lower(c_mktsegment) || '_x' END AS l "
      "FROM customer) LEFT JOIN norm ON l = label")(
    lambda s, d: table(s, d, "customer").withColumn("l", F.expr(
        "CASE c_mktsegment WHEN 'BUILDING' THEN 'EMAIL_ADDRESS' WHEN 'MACHINERY' THEN 'LOC' ELSE 'my_own_label_' || lower(c_mktsegment) || '_x' END")
    ).select("c_custkey", F.col("c_mktsegment").alias("label"), T.token_label(F.col("l")).alias("token_label"),
             T.make_token(T.token_label(F.col("l")), F.col("c_name")).alias("token")))

DOC_TOKENS = Q.tokenization(C.CATALOGUE, DOCS)
ALL_TOKENS = Q.tokenization(C.CATALOGUE, ALL)
query("tokenize_documents", f"WITH {DOC_TOKENS} SELECT id, tokenized FROM spliced")(
    lambda s, d: T.tokenize(documents(s, d)).select("id", "tokenized"))
query("tokenize_entity_texts", f"WITH {ALL_TOKENS} SELECT id, tokenized FROM spliced")(
    lambda s, d: T.tokenize(customer_texts(s, d, X.ALL_TEXT)).select("id", "tokenized"))
query("tokenize_entity_texts_compat", f"WITH {Q.tokenization(C.CATALOGUE, ALL, 'compat')} SELECT id, tokenized FROM spliced")(
    lambda s, d: T.tokenize(customer_texts(s, d, X.ALL_TEXT), trim="compat").select("id", "tokenized"))

MODEL_TOKENS = f"""{JOINED_SQL}, {Q.matches(C.CATALOGUE, DOCS)}, {Q.scored(C.CATALOGUE)}, {Q.kept()},
{Q.trimmed().replace('spans AS (', 'rule_spans AS (', 1)},
spans AS (SELECT * FROM rule_spans UNION ALL SELECT id, CAST(s AS INTEGER), CAST(e AS INTEGER), label, score, 'AI_MODEL' FROM model m
  WHERE score >= 0.95 AND NOT EXISTS (SELECT 1 FROM rule_spans r WHERE r.id = m.id AND m.s < r.e AND r.s < m.e)),
{Q.merged()}, {Q.tokens()}, {Q.spliced()}"""
query("tokenize_with_model_spans", f"WITH {MODEL_TOKENS} SELECT id, tokenized FROM spliced")(
    lambda s, d: T.tokenize(with_pieces(documents(s, d)), model_spans="pieces").select("id", "tokenized"))

query("token_map", f"WITH {ALL_TOKENS} SELECT DISTINCT id, token, value, label FROM tokens")(
    lambda s, d: T.token_rows(T.tokenize(customer_texts(s, d, X.ALL_TEXT)), ["id"]))


def _key():
    return F.lit("own-test-key-016").cast("binary")


query("encrypted_map_round_trip", f"WITH {DOC_TOKENS} SELECT DISTINCT id, token, label, value FROM tokens")(
    lambda s, d: T.encrypted_map(T.token_rows(T.tokenize(documents(s, d)), ["id"]), _key()).select(
        "id", "token", "label", crypto.decrypt(F.col("ciphertext"), _key()).alias("value")))


def _opened(df):
    """Every ciphertext piece of an in-place encrypted text, decrypted again.

    A value of n bytes becomes base64 of 28 + n bytes; what earlier pieces grew by moves the later ones.
    """

    def size(value):
        return (4 * F.ceil((F.octet_length(value) + 28) / 3)).cast("int")

    rows = exploded(df, ["id", "tokenized", F.col("entities").alias("all")], "entities", "e", "n")
    grown = F.aggregate(F.slice("all", F.lit(1), F.col("n")), F.lit(0), lambda a, e: a + size(e["value"]) - F.length(e["value"]))
    piece = F.substring(F.col("tokenized"), F.col("e.start") + grown + 1, size(F.col("e.value")))
    return rows.select("id", "n", F.col("e.start").alias("start"), crypto.decrypt(F.unbase64(piece), _key()).alias("value"))


query("encrypt_in_place_round_trip", f"""WITH {DOC_TOKENS}
SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY s) - 1 AS INTEGER) AS n, s AS start, value FROM tokens""")(
    lambda s, d: _opened(T.tokenize(documents(s, d), mode="encrypt", key=_key())))

# One scope over many units: each source is a file, each document a unit.
SCOPED = f"""{Q.norm_table()},
{Q.detection(C.CATALOGUE, ALL)}, {Q.merged()},
valued AS (SELECT m.id, c_nationkey AS scope, m.s, m.e, substr(x.text, m.s + 1, m.e - m.s) AS value,
    left(coalesce(n.short, upper(m.label)), 20) AS own
  FROM merged m JOIN src x USING (id) JOIN customer ON c_custkey = m.id LEFT JOIN norm n USING (label)),
tokens AS (SELECT id, scope, s, e, value, {Q.token('label', 'value')} AS token FROM (
  SELECT *, first_value(own) OVER (PARTITION BY scope, value ORDER BY id, s DESC) AS label FROM valued)), {Q.spliced()}"""
query("tokenize_shared_scope", f"WITH {SCOPED} SELECT id, tokenized FROM spliced")(
    lambda s, d: T.tokenize(customer_texts(s, d, X.ALL_TEXT, "c_nationkey as scope"), scope=["scope"], unit="id").select("id", "tokenized"))
query("label_conflicts", f"""WITH {SCOPED}, per_unit AS (SELECT DISTINCT scope, id, value,
  last_value(own) OVER (PARTITION BY id, value ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS label FROM valued)
SELECT scope, value, first(label ORDER BY id) AS label FROM per_unit GROUP BY 1, 2 HAVING count(DISTINCT label) > 1""")(
    lambda s, d: T.label_conflicts(
        T.with_entities(D.with_rule_spans(customer_texts(s, d, X.ALL_TEXT, "c_nationkey as scope"))), ["scope"], "id"
    ).withColumnRenamed("_label", "label"))

# One number per nation, labelled as an account by even customers and as a passport by odd ones.
CONFLICT_TEXT = ("CASE WHEN c_custkey % 2 = 0 THEN 'bank ' ELSE 'passport ' END || '4123456' || lpad(cast(c_nationkey AS string), 2, '0') "
                 "|| ' and mail n' || c_nationkey || '@example.org'")
CONFLICTS = f"SELECT c_custkey AS id, {CONFLICT_TEXT} AS text FROM customer"
CONFLICTING = SCOPED.replace(Q.detection(C.CATALOGUE, ALL), Q.detection(C.CATALOGUE, CONFLICTS))


def _conflicting(s, d):
    rows = rel(s, d, f"SELECT c_custkey AS id, c_nationkey AS scope, {CONFLICT_TEXT} AS text FROM {{customer}}")
    return T.with_entities(D.with_rule_spans(spread(rows)))


query("label_conflicts_of_numbers", f"""WITH {CONFLICTING}, per_unit AS (SELECT DISTINCT scope, id, value,
  last_value(own) OVER (PARTITION BY id, value ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS label FROM valued)
SELECT scope, value, first(label ORDER BY id) AS label FROM per_unit GROUP BY 1, 2 HAVING count(DISTINCT label) > 1""")(
    lambda s, d: T.label_conflicts(_conflicting(s, d), ["scope"], "id").withColumnRenamed("_label", "label"))
for _name, _options in {
    "tokenize_conflicts_broadcast": {}, "tokenize_conflicts_joined": {"in_memory": 0},
    "tokenize_conflicts_salted": {"in_memory": 0, "plain_bytes": 0, "min_rows": 2},
}.items():
    query(_name, f"WITH {CONFLICTING} SELECT id, tokenized FROM spliced")(
        lambda s, d, o=_options: T.with_tokenized(T.with_shared_labels(_conflicting(s, d), ["scope"], "id", **o)).select("id", "tokenized"))

query("tokenize_structs", "WITH " + Q.tokenization(C.CATALOGUE, "SELECT event_id AS id, event_type || ' by 10.0.' || (user_id % 256) || '.9 k ' || props AS text FROM events") +
      " SELECT id, user_id, tokenized AS text FROM spliced JOIN events ON event_id = id")(
    lambda s, d: _struct_rows(table(s, d, "events")))


def _struct_rows(events):
    """Only the text fields of a struct change; its other fields stay."""
    item = F.struct(
        F.expr("event_type || ' by 10.0.' || (user_id % 256) || '.9 k ' || props").alias("text"), F.col("user_id").alias("user_id"))
    made = T.tokenize_fields(events.select(F.col("event_id").alias("id"), item.alias("item")), "item")
    return made.select("id", F.col("item.user_id").alias("user_id"), F.col("item.text").alias("text"))


query("run_statistics", f"""WITH {DOC_TOKENS},
u AS (SELECT source, count(*) AS units, sum(length(text)) AS chars FROM documents GROUP BY 1),
t AS (SELECT source, count(*) AS replacements, count(DISTINCT value) AS unique_values FROM tokens JOIN documents ON doc_id = id GROUP BY 1),
p AS (SELECT source, units, CAST(chars AS BIGINT) AS chars, coalesce(replacements, 0) AS replacements, coalesce(unique_values, 0) AS unique_values FROM u LEFT JOIN t USING (source))
SELECT *, false AS is_total FROM p UNION ALL SELECT NULL, CAST(sum(units) AS BIGINT), CAST(sum(chars) AS BIGINT), CAST(sum(replacements) AS BIGINT), CAST(sum(unique_values) AS BIGINT), true FROM p""")(
    lambda s, d: T.run_statistics(T.tokenize(documents(s, d)), ["source"]))

MESSAGE = "'[' || conv_id || '] ' || text || ' reach ' || role || conv_id || '@example.org, SSN 123-45-' || lpad(cast(1000 + turn as string), 4, '0') || '  '"
_CLEAN = f"regexp_replace(regexp_replace({MESSAGE}, " + r"'[\[\]\x00-\x08\x0b\x0c\x0e-\x1f\x7f]', '', 'g'), '^\s+|\s+$', '', 'g')"
query("tokenize_messages", "WITH " + Q.tokenization(C.CATALOGUE, f"SELECT conv_id * 1000 + turn AS id, {_CLEAN} AS text FROM conversations") +
      " SELECT id, tokenized FROM spliced")(
    lambda s, d: T.tokenize_messages(table(s, d, "conversations").selectExpr("conv_id * 1000 + turn as id", f"{MESSAGE} as text")).select("id", "tokenized"))

query("token_collisions", """WITH p AS (SELECT DISTINCT o_custkey AS scope, '[ID_' || substr(md5(o_orderpriority), 1, 8) || ']' AS token, cast(o_orderkey AS VARCHAR) AS value FROM orders)
SELECT scope, token, count(*) AS n_values, min(value) AS first_value, max(value) AS last_value FROM p GROUP BY 1, 2 HAVING count(*) > 1""")(
    lambda s, d: T.collisions(rel(s, d, "SELECT o_custkey AS scope, '[ID_' || substr(md5(o_orderpriority), 1, 8) || ']' AS token, cast(o_orderkey AS string) AS value FROM {orders}"), ["scope"]))

_EXTRA = C.add_rule(C.CATALOGUE, C.Rule("CUSTOMER_NO", "customer_no", r"\bCustomer#\d{9}\b", 0.97))
query("added_recognizer", "WITH " + Q.tokenization(_EXTRA, "SELECT c_custkey AS id, c_name || ' of ' || c_mktsegment || ' pays 12-' || lpad(cast(c_custkey AS VARCHAR), 7, '0') AS text FROM customer") +
      " SELECT id, tokenized FROM spliced")(
    lambda s, d: T.tokenize(table(s, d, "customer").selectExpr(
        "c_custkey as id", "c_name || ' of ' || c_mktsegment || ' pays 12-' || lpad(cast(c_custkey as string), 7, '0') as text"), rules=_EXTRA).select("id", "tokenized"))

# A rule of the caller's own with its own context words: the score is raised only in one market segment.
_HELD = C.add_rule([], C.Rule("ORDER_NO", "order_no", r"\bno \d{9}\b", 0.3, context=("machinery",)))
_HELD_TEXT = "c_mktsegment || ' no ' || lpad(cast({k} AS {t}), 9, '0')"
query("recognizer_with_context", f"SELECT c_custkey AS id, length(c_mktsegment) + 1 AS start, CASE WHEN c_mktsegment = 'MACHINERY' THEN 0.65 ELSE 0.3 END AS score FROM customer")(
    lambda s, d: short_rows(D.with_rule_spans(table(s, d, "customer").selectExpr(
        "c_custkey as id", _HELD_TEXT.format(k="c_custkey", t="string") + " as text"), rules=_HELD), "spans").select("id", "start", "score"))


def _by_sql(s, d):
    register(s)
    return rel(s, d, "SELECT c_custkey AS id, pii_token('EMAIL_ADDRESS', c_name) AS token, pii_label('LOC') AS label, "
               "array_join(pii_tokens('a ' || pii_token('PERSON', c_name) || ' b ' || pii_token('LOC', c_mktsegment)), ',') AS tokens FROM {customer}")


query("sql_functions", f"""WITH {Q.norm_table()}, n AS (SELECT max(short) FILTER (WHERE label = 'EMAIL_ADDRESS') AS mail, max(short) FILTER (WHERE label = 'PERSON') AS person, max(short) FILTER (WHERE label = 'LOC') AS loc FROM norm)
SELECT c_custkey AS id, '[' || mail || '_' || substr(md5(c_name), 1, 8) || ']' AS token, loc AS label,
  '[' || coalesce(person, 'PERSON') || '_' || substr(md5(c_name), 1, 8) || '],[' || loc || '_' || substr(md5(c_mktsegment), 1, 8) || ']' AS tokens FROM customer, n""")(_by_sql)


def _by_view(s, d):
    documents(s, d).createOrReplaceTempView("cloakframe_documents")
    tokenized_view(s, "cloakframe_documents", "cloakframe_tokenized")
    return s.sql("SELECT id, tokenized FROM cloakframe_tokenized")


query("sql_view", f"WITH {DOC_TOKENS} SELECT id, tokenized FROM spliced")(_by_view)
