"""Samples, labels, chat examples, retrieval and chat events."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import catalog as C
from ..functions.arrays import exploded
from ..operators import chat as CH
from ..operators import labels as L
from ..operators import retrieval as RT
from ..operators import samples as SM
from ..operators import tagger as TG
from ..operators import tokenize as T
from ..operators import vectors as VX
from ..session import run_folder, stored
from ..streaming import chat as ST
from . import generated_sql as GS
from . import sqltext as Q
from .registry import documents, query, rel, spread, table

DOCS = "SELECT doc_id AS id, text FROM documents"
HASH = "CAST('0x' || substr(md5({0}), 1, 7) AS BIGINT)"


def _samples(s, d):
    return SM.annotated_samples(spread(table(s, d, "customer").select("c_custkey")), "c_custkey")


def _records(s, d):
    rows = table(s, d, "customer").select("c_custkey")
    total = rows.agg(F.count(F.lit(1))).scalar()
    return SM.records(spread(SM.allot_types(rows, "c_custkey", total)), "c_custkey")


def _tokenized_records(s, d):
    return T.tokenize(_records(s, d)).select("c_custkey", "file_name", F.col("tokenized").alias("text"))


query("annotated_samples", GS.samples())(lambda s, d: _samples(s, d).select("c_custkey", "text", F.to_json("entities").alias("entities")))

FILL = ("Chart {mrn} for {emp_id}.", "Badge {emp_id}", "Nothing to note.")
_H = lambda key: HASH.format(f"'42|' || k || '|{key}'")
_DIG = lambda n, key: f"(CAST({_H(key + '|head')} % 9 + 1 AS VARCHAR) || substr(lpad(CAST({_H(key + '|0')} % 10000000 AS VARCHAR), 7, '0'), 1, {n - 1}))"
query("filled_samples", f"""WITH v AS (SELECT c_custkey AS k, {HASH.format("'42|' || c_custkey || '|template'")} % 3 AS t FROM customer),
w AS (SELECT k, t, 'MRN-' || {_DIG(6, 'mrn')} AS mrn, 'EMP-' || {_DIG(4, 'emp')} AS emp FROM v)
SELECT k AS c_custkey, CASE t WHEN 0 THEN 'Chart ' || mrn || ' for ' || emp || '.' WHEN 1 THEN 'Badge ' || emp ELSE 'Nothing to note.' END AS text,
  CASE t WHEN 0 THEN '6-16-MRN,21-29-EMP_ID' WHEN 1 THEN '6-14-EMP_ID' ELSE '' END AS entities FROM w""")(
    lambda s, d: SM.annotated_samples(table(s, d, "customer"), "c_custkey", templates=FILL).select(
        "c_custkey", "text", F.array_join(F.transform("entities", lambda e: F.concat_ws("-", e["start"].cast("string"), e["end"].cast("string"), e["label"])), ",").alias("entities")))
query("records", GS.records())(lambda s, d: _records(s, d).select("c_custkey", "file_name", "text"))
query("record_quotas", """WITH n AS (SELECT count(*) AS n FROM customer), t(i, record_type) AS (VALUES (0, 'personal_banking'), (1, 'intl_business'), (2, 'gov_contractor'), (3, 'healthcare_professional'), (4, 'tech_startup'))
SELECT record_type, n // 5 + CASE WHEN i < n % 5 THEN 1 ELSE 0 END AS n, record_type || '_000000.txt' AS first_file, record_type || '_' || printf('%06d', n // 5 + CASE WHEN i < n % 5 THEN 1 ELSE 0 END - 1) || '.txt' AS last_file FROM n, t""")(
    lambda s, d: _quotas(table(s, d, "customer").select("c_custkey")))


def _quotas(rows):
    placed = SM.allot_types(rows, "c_custkey", rows.agg(F.count(F.lit(1))).scalar())
    return placed.groupBy("record_type").agg(F.count(F.lit(1)).alias("n"), F.min("file_name").alias("first_file"), F.max("file_name").alias("last_file"))


WORDS = Q.all_places("text", r"\S+", f"({DOCS})")
query("word_spans", f"WITH {WORDS} SELECT id, s AS start, CAST(s + length(v) AS INTEGER) AS \"end\", v AS word FROM found")(
    lambda s, d: exploded(documents(s, d), ["id"], L.words(F.col("text")), "w").select("id", "w.start", "w.end", "w.word"))

# Entities on word borders and inside words: characters 3-12 and 8-30 of each conversation turn.
TURNS = "SELECT conv_id * 1000 + turn AS id, text FROM conversations"
BIO = f"""{Q.all_places('text', chr(92) + 'S+', f'({TURNS})')}, tags AS (SELECT id, i, v, CASE
  WHEN greatest(s, 3) < least(s + length(v), 12) THEN CASE WHEN s <= 3 THEN 'B-PER' ELSE 'I-PER' END
  WHEN greatest(s, 8) < least(s + length(v), 30) THEN CASE WHEN s <= 8 THEN 'B-THING' ELSE 'I-THING' END ELSE 'O' END AS tag FROM found)"""


def _bio(s, d):
    rows = table(s, d, "conversations").selectExpr("conv_id * 1000 + turn as id", "text")
    kind = "array<struct<start:int,end:int,label:string>>"
    found = rows.withColumn("entities", F.array(F.struct(F.lit(3), F.lit(12), F.lit("PER")), F.struct(F.lit(8), F.lit(30), F.lit("THING"))).cast(kind))
    return L.bio_rows(found, "id")


query("bio_tags", f"WITH {BIO} SELECT CAST(id AS VARCHAR) AS id, string_agg(tag, ' ' ORDER BY i) AS tags, string_agg(CASE tag WHEN 'B-PER' THEN '1' WHEN 'I-PER' THEN '2' ELSE '0' END, ' ' ORDER BY i) AS ids FROM tags GROUP BY 1")(
    lambda s, d: _bio(s, d).select("id", F.array_join("tags", " ").alias("tags"), F.array_join(F.transform("ner_tags", lambda i: i.cast("string")), " ").alias("ids")))
query("train_test_split", f"SELECT doc_id, CASE WHEN {HASH.format(chr(39) + '42|' + chr(39) + ' || doc_id || ' + chr(39) + '|split' + chr(39))} % 1000 < 200 THEN 'test' ELSE 'train' END AS split FROM documents")(
    lambda s, d: L.split_samples(table(s, d, "documents").select("doc_id"), "doc_id"))
# Pieces of four characters per word stand in for sub-word pieces.
query("aligned_labels", f"""WITH {BIO}, p AS (SELECT id, i, unnest(range(0, (length(v) + 3) // 4)) AS j, CASE tag WHEN 'B-PER' THEN 1 WHEN 'I-PER' THEN 2 ELSE 0 END AS lab FROM tags)
SELECT CAST(id AS VARCHAR) AS id, '-100 ' || string_agg(CASE WHEN j = 0 THEN CAST(lab AS VARCHAR) ELSE '-100' END, ' ' ORDER BY i, j) || ' -100' AS labels FROM p GROUP BY 1""")(
    lambda s, d: _aligned(_bio(s, d)))


def _aligned(rows):
    pieces = F.flatten(F.transform("tokens", lambda t, i: F.array_repeat(i, F.floor((F.length(t) + 3) / 4).cast("int"))))
    special = F.array(F.lit(None).cast("int"))
    made = rows.withColumn("w", F.concat(special, pieces, special)).withColumn("l", L.aligned_labels(F.col("w"), F.col("ner_tags")))
    return made.select("id", F.array_join(F.transform("l", lambda x: x.cast("string")), " ").alias("labels"))


query("best_labels", """SELECT vec_id, list_position(list_transform(embedding, lambda x: CAST(x AS DOUBLE)), list_max(list_transform(embedding, lambda x: CAST(x AS DOUBLE)))) - 1 AS predicted, label AS actual
FROM embeddings WHERE label <> 3""")(
    lambda s, d: table(s, d, "embeddings").select("vec_id", F.inline(L.best_labels(
        F.array(F.col("embedding").cast("array<double>")), F.array(F.when(F.col("label") == 3, -100).otherwise(F.col("label")))))))

# Prediction = gold tags with every tag of a long word set to O.
query("entity_scores", f"""WITH {BIO}, b AS (SELECT id, i, tag, CASE WHEN length(v) > 8 THEN 'O' ELSE tag END AS guess FROM tags),
x AS (SELECT id, i, 'g' AS side, tag FROM b UNION ALL SELECT id, i, 'p', guess FROM b),
o AS (SELECT *, tag <> 'O' AND (tag LIKE 'B-%' OR coalesce(lag(tag) OVER w, 'O') = 'O' OR substr(lag(tag) OVER w, 3) <> substr(tag, 3)) AS opens FROM x WINDOW w AS (PARTITION BY id, side ORDER BY i)),
c AS (SELECT id, side, substr(tag, 3) AS label, grp, min(i) AS a, max(i) AS z FROM (SELECT *, sum(opens::INT) OVER (PARTITION BY id, side ORDER BY i) AS grp FROM o) WHERE tag <> 'O' GROUP BY 1, 2, 3, 4),
n AS (SELECT (SELECT count(*) FROM c WHERE side = 'p') AS p, (SELECT count(*) FROM c WHERE side = 'g') AS g, (SELECT count(*) FROM c x JOIN c y USING (id, label, a, z) WHERE x.side = 'p' AND y.side = 'g') AS h, (SELECT avg((tag = guess)::INT) FROM b) AS acc)
SELECT round(h / p, 6) AS precision, round(h / g, 6) AS recall, round(2 * (h / p) * (h / g) / (h / p + h / g), 6) AS f1, round(acc, 6) AS accuracy FROM n""")(
    lambda s, d: L.evaluate(_bio(s, d).withColumn("guess", F.zip_with("tags", "tokens", lambda t, w: F.when(F.length(w) > 8, "O").otherwise(t))), "guess", "tags"))
query("trained_tagger")(lambda s, d: _tagged(s, d))


def _tagged(s, d):
    """Tags of held-out samples by a model trained on the others."""
    parts = L.split_samples(_samples(s, d), "c_custkey")
    model = TG.fit(parts.filter("split = 'train'"), "c_custkey", features=1024, iterations=8)
    return TG.tag_words(model, parts.filter("split = 'test'"), "c_custkey").select("c_custkey", "start", "end", "tag")


F1_FLOOR = 0.9
_HELD_OUT = HASH.format("'42|' || c_custkey || '|split'")


def _sequence_scores(s, d):
    """Entities of held-out samples by most probable tag sequences, learned on the others."""
    parts = stored(L.split_samples(_samples(s, d), "c_custkey"))
    model = TG.fit_sequences(parts.filter("split = 'train'"), "c_custkey", features=1024, iterations=8)
    held_out = parts.filter("split = 'test'").withColumn("actual", L.bio_tags(L.words(F.col("text")), F.col("entities")))
    tagged = stored(TG.tag_texts(model, held_out).select("tags", "actual"))
    return L.evaluate(tagged, "tags", "actual").join(tagged.agg(F.count(F.lit(1)).alias("held_out")))


query("tag_sequences", f"SELECT count(*) AS held_out, true AS f1_reached FROM customer WHERE {_HELD_OUT} % 1000 < 200")(
    lambda s, d: _sequence_scores(s, d).select("held_out", (F.col("f1") >= F1_FLOOR).alias("f1_reached")))
query("tag_sequence_figures")(_sequence_scores)

# Chat examples.
FORM = "'Top ' || c_custkey || chr(10) || 'Contact:' || chr(10) || '- Email: [EMAIL_' || substr(md5(c_name), 1, 8) || ']' || chr(10) || 'Home Phone:  [PHONE_' || substr(md5(c_mktsegment), 1, 8) || ']' || chr(10) || 'Notes:' || chr(10) || 'plain: ' || c_mktsegment || chr(10) || 'Contact:' || chr(10) || '- again' || chr(10)"
query("field_pairs", f"SELECT c_custkey, unnest(['Email', 'Home Phone']) AS field, unnest(['[EMAIL_' || substr(md5(c_name), 1, 8) || ']', '[PHONE_' || substr(md5(c_mktsegment), 1, 8) || ']']) AS token FROM customer")(
    lambda s, d: exploded(table(s, d, "customer").select("c_custkey", F.expr(FORM).alias("text")), ["c_custkey"], CH.field_pairs(F.col("text")), "p").select("c_custkey", "p.field", "p.token"))
query("sections", "SELECT c_custkey, unnest(['header', 'Contact', 'Notes']) AS name, unnest(['Top ' || c_custkey, '- again', 'plain: ' || c_mktsegment]) AS body FROM customer")(
    lambda s, d: exploded(table(s, d, "customer").select("c_custkey", F.expr(FORM).alias("text")), ["c_custkey"], CH.sections(F.col("text")), "x").select(
        "c_custkey", "x.name", F.array_join("x.lines", "\n").alias("body")))
RECORD_TOKENS = Q.tokenization(C.CATALOGUE, f"SELECT c_custkey AS id, text FROM ({GS.records()})")
for _kind in CH.KINDS:
    query(f"chat_{_kind}_examples", GS.examples_of_kind(RECORD_TOKENS, _kind))(lambda s, d, k=_kind: CH.examples_of_kind(_tokenized_records(s, d), k, "c_custkey").select(
        "c_custkey", F.to_json("messages").alias("messages")))
query("chat_examples", GS.chat_examples(RECORD_TOKENS, CH.KINDS))(lambda s, d: CH.chat_examples(_tokenized_records(s, d), "c_custkey").select(
    "c_custkey", "example_no", "kind", F.to_json("messages").alias("messages")))
SPLIT = "SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY md5('42|' || doc_id), doc_id) <= greatest(1, CAST(floor(count(*) OVER () * CAST(0.9 AS DOUBLE)) AS BIGINT)) THEN 'train' ELSE 'val' END AS split FROM documents"
query("exact_split", SPLIT)(lambda s, d: CH.exact_split(table(s, d, "documents").select("doc_id"), ["doc_id"]))
query("split_statistics", f"SELECT split, count(*) AS n FROM ({SPLIT}) GROUP BY 1")(
    lambda s, d: CH.split_statistics(CH.exact_split(table(s, d, "documents").select("doc_id"), ["doc_id"])))
query("hash_split", f"SELECT doc_id, CASE WHEN {HASH.format(chr(39) + '42|' + chr(39) + ' || doc_id')} < 241591910 THEN 'train' ELSE 'val' END AS split FROM documents")(
    lambda s, d: CH.hash_split(table(s, d, "documents").select("doc_id"), ["doc_id"]))
REND = """r AS (SELECT *, '<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10) AS rendered FROM conversations),
p AS (SELECT conv_id, turn, role, rendered, CAST(coalesce(sum(length(rendered)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM r)"""
query("rendered_turns", f"WITH {REND} SELECT conv_id, turn, role, rendered, start, start + length(rendered) AS \"end\", CASE WHEN role = 'assistant' THEN start + 22 END AS loss_start FROM p")(
    lambda s, d: CH.rendered_turns(table(s, d, "conversations"), "conv_id", "turn"))
query("loss_per_conversation", f"WITH {REND} SELECT conv_id, CAST(sum(CASE WHEN role = 'assistant' THEN length(rendered) - 22 ELSE 0 END) AS BIGINT) AS loss_chars, CAST(sum(length(rendered)) AS BIGINT) AS total_chars FROM p GROUP BY 1")(
    lambda s, d: CH.turn_mask_check(CH.rendered_turns(table(s, d, "conversations"), "conv_id", "turn"), "conv_id"))
query("rendered_examples", "SELECT doc_id, '<|im_start|>user' || chr(10) || source || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10) || text || '<|im_end|>' || chr(10) AS rendered FROM documents")(
    lambda s, d: _as_messages(s, d).select("doc_id", CH.render(F.col("messages")).alias("rendered")))
query("mask_check", "SELECT CAST(sum(length(text) + 11) AS BIGINT) AS loss_chars, CAST(sum(length(text) + length(source) + 28 + 33) AS BIGINT) AS total_chars, 0 AS fully_masked, count(*) AS examples, round(sum(length(text) + 11) / sum(length(text) + length(source) + 28 + 33), 6) AS loss_share FROM documents")(
    lambda s, d: CH.mask_check(_as_messages(s, d)))


def _as_messages(s, d):
    pair = F.array(F.struct(F.lit("user").alias("role"), F.col("source").alias("content")), F.struct(F.lit("assistant").alias("role"), F.col("text").alias("content")))
    return table(s, d, "documents").select("doc_id", pair.alias("messages"))


query("cut_words", r"SELECT doc_id, regexp_extract(text, '^(\s*(?:\S+\s+){0,99}\S*)', 1) AS cut FROM documents")(
    lambda s, d: table(s, d, "documents").select("doc_id", CH.cut_words(F.col("text"), 100).alias("cut")))

# Retrieval: chunks of customer texts, queries = mean vector of each label.
CHUNK_TEXT = "'TECH banking ' || c_name || ' first part of the record text' || chr(10) || '======' || 'short' || '====' || '  business ' || c_mktsegment || ' second part, long enough to keep  ' || '===' || ' x'"
CHUNKS = """ch AS (SELECT k, c, CAST(row_number() OVER (PARTITION BY k ORDER BY o) - 1 AS INTEGER) AS i FROM (
  SELECT k, unnest(l) AS c, generate_subscripts(l, 1) AS o FROM (SELECT c_custkey AS k, list_transform(string_split(regexp_replace(TEXT, '={4,}', chr(1), 'g'), chr(1)), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')) AS l FROM customer)) WHERE length(c) > 40)""".replace("TEXT", CHUNK_TEXT)
_KIND = "CASE WHEN h LIKE '%HEALTHCARE%' THEN 'healthcare' WHEN h LIKE '%BANKING%' THEN 'banking' WHEN h LIKE '%BUSINESS%' THEN 'business' WHEN h LIKE '%GOVERNMENT%' THEN 'government' WHEN h LIKE '%TECH%' THEN 'tech' ELSE 'unknown' END"


def _chunks(s, d):
    return RT.chunks(table(s, d, "customer").select("c_custkey", F.expr(CHUNK_TEXT).alias("text")), "c_custkey")


query("chunks", f"WITH {CHUNKS} SELECT k || '_' || i AS chunk_id, CAST(k AS VARCHAR) AS source, i AS chunk_index, {_KIND} AS record_type, c AS text FROM (SELECT *, upper(split_part(c, chr(10), 1)) AS h FROM ch)")(_chunks)
INDEXED = "SELECT c_custkey || '_0' AS chunk_id FROM {customer} WHERE c_mktsegment = 'BUILDING'"
query("new_chunks", f"WITH {CHUNKS} SELECT k || '_' || i AS chunk_id FROM ch WHERE k || '_' || i NOT IN ({INDEXED.replace('{customer}', 'customer')})")(
    lambda s, d: RT.new_chunks(_chunks(s, d), rel(s, d, INDEXED)).select("chunk_id"))
query("index_counts", f"WITH {CHUNKS}, x AS ({INDEXED.replace('{customer}', 'customer')}) SELECT (SELECT count(*) FROM x) AS before, count(*) AS added, (SELECT count(*) FROM x) + count(*) AS after FROM ch WHERE k || '_' || i NOT IN (FROM x)")(
    lambda s, d: RT.index_counts(rel(s, d, INDEXED), RT.new_chunks(_chunks(s, d), rel(s, d, INDEXED))))
query("embedded_chunks", f"WITH {CHUNKS} SELECT k || '_' || i AS chunk_id, CAST(1.0 AS DOUBLE) AS norm FROM ch")(lambda s, d: _embedded(s, d).select("chunk_id", F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x), 4).alias("norm")))


def _embedded(s, d):
    rows = _chunks(s, d)
    return RT.embed(RT.fit_embedder(rows, features=256), rows)


TOP = """q AS (SELECT label AS query_id, list(x ORDER BY i) AS v FROM (SELECT label, i, avg(CAST(embedding[i] AS DOUBLE)) AS x FROM (SELECT *, unnest(range(1, 65)) AS i FROM embeddings) GROUP BY 1, 2) GROUP BY 1),
sc AS (SELECT query_id, vec_id, list_cosine_similarity(v, list_transform(embedding, lambda x: CAST(x AS DOUBLE))) AS similarity FROM q, embeddings),
top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(similarity, 9) DESC, vec_id) AS rank FROM sc QUALIFY rank <= 3)"""


def _mean_vectors(em):
    parts = em.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return parts.groupBy("label").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda z: z["x"]).alias("embedding"))


def _top(s, d):
    em = table(s, d, "embeddings")
    return RT.top_k(em, _mean_vectors(em), "vec_id", "label")


query("cosine_top_k", f"WITH {TOP} SELECT query_id, vec_id, rank, round(similarity, 6) AS similarity FROM top")(
    lambda s, d: _top(s, d).withColumn("similarity", F.round("similarity", 6)))
query("relevant_top_k", f"WITH {TOP} SELECT query_id, vec_id, rank FROM top WHERE similarity >= 0.35")(
    lambda s, d: RT.relevant(_top(s, d), 0.35).drop("similarity"))
query("retrieved_contexts", f"WITH {TOP} SELECT query_id, string_agg(printf('[Retrieved %s record (relevance %.2f)]:' || chr(10) || '%s', 'label' || label, similarity, 'vector ' || vec_id), chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank) AS context FROM top JOIN embeddings USING (vec_id) WHERE similarity >= 0.15 GROUP BY 1")(
    lambda s, d: RT.contexts(RT.relevant(_top(s, d)), table(s, d, "embeddings").select(
        "vec_id", F.concat(F.lit("vector "), "vec_id").alias("text"), F.concat(F.lit("label"), "label").alias("record_type")), "vec_id"))


_INDEXES: dict = {}
PROBES, LISTS, CANDIDATES = 24, 32, 30  # the given vectors have no clusters: most lists are near every query


def _index(s, d):
    """The index of a folder's vectors, built once per session, as an index is."""
    key = (s.sparkContext.applicationId, d)
    if key not in _INDEXES:
        _INDEXES[key] = VX.build_index(table(s, d, "embeddings"), run_folder(s), "vec_id", lists=LISTS)
    return _INDEXES[key]


def _approximate(s, d, probes):
    return VX.search(_index(s, d), _mean_vectors(table(s, d, "embeddings")), "label", k=3, probes=probes, rescored=CANDIDATES)


def _recall(s, d):
    """Recall against exact search, and the share of all pairs that were compared by whole vectors."""
    em = table(s, d, "embeddings")
    asked = _mean_vectors(em)
    found = VX.candidates(_index(s, d), asked, "label", probes=PROBES, rescored=CANDIDATES)
    pairs = em.agg(F.count(F.lit(1)).alias("n")).join(asked.agg(F.count(F.lit(1)).alias("q")))
    share = found.agg(F.count(F.lit(1)).alias("scored")).join(pairs).select((F.col("scored") / (F.col("n") * F.col("q"))).alias("scored_share"))
    return RT.recall(_top(s, d), _approximate(s, d, PROBES), "vec_id").join(share)


query("approximate_top_k", f"WITH {TOP} SELECT query_id, vec_id, rank, round(similarity, 6) AS similarity FROM top")(
    lambda s, d: _approximate(s, d, LISTS).withColumn("similarity", F.round("similarity", 6)))  # all lists: only codes choose
query("approximate_recall", f"WITH {TOP} SELECT count(*) AS wanted, count(*) AS found, CAST(1.0 AS DOUBLE) AS recall FROM top")(
    lambda s, d: RT.recall(_top(s, d), _approximate(s, d, LISTS), "vec_id"))
query("approximate_figures")(_recall)

# Chat events in batch form.
CHUNK_ROWS = "SELECT cast(conv_id AS string) AS session_id, cast(turn AS bigint) AS seq, text || ' ' AS content, role = 'assistant' AS done FROM {conversations}"
query("assembled_messages", f"""WITH c AS ({CHUNK_ROWS.replace('{conversations}', 'conversations')}),
e AS (SELECT *, min(CASE WHEN done THEN seq END) OVER (PARTITION BY session_id ORDER BY seq ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS stop FROM c)
SELECT session_id, stop AS seq, string_agg(content, '' ORDER BY seq) AS content FROM e WHERE stop IS NOT NULL GROUP BY 1, 2""")(
    lambda s, d: ST.assembled(rel(s, d, CHUNK_ROWS)))
query("rate_windows", "SELECT user_id, strftime(time_bucket(INTERVAL 1 DAY, ts), '%Y-%m-%d %H:%M') AS window_start, count(*) AS n, count(*) > 3 AS over_limit FROM events GROUP BY 1, 2")(
    lambda s, d: ST.over_rate(table(s, d, "events"), "user_id", "ts", 3, width="1 day").withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm")))
query("once_per_message", "SELECT DISTINCT user_id AS message_id FROM events")(
    lambda s, d: ST.once_per_message(table(s, d, "events").select(F.col("user_id").alias("message_id"))))
