"""SQL text that states each detection step independently, for comparison runs.

The statements use plain relational steps (unions, windows, list functions)
where the library uses column folds, so both sides only share the catalogue.
"""

from __future__ import annotations

from ..catalog import CONTEXT_WORDS, KEYWORD_PREFIX_LABELS, LABEL_NORM, Rule

ACCENTED = "[À-ÖØ-öø-ÿĀ-ž]"


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def flat(text: str) -> str:
    """Accented letters as ``x``: same length, and an ASCII word boundary is then right."""
    return f"regexp_replace({text}, '{ACCENTED}', 'x', 'g')"


def _pattern(rule: Rule) -> str:
    body = rule.regex.replace(r"(?<!\w)", r"\b").replace(r"(?!\w)", r"\b")
    return ("(?i)" if rule.ignore_case else "") + body


def starts(found: str = "m", gaps: str = "g") -> str:
    """Start offset of the ``i``-th match from the texts between matches."""
    return (
        f"CAST(list_sum(list_transform({gaps}[1:i], lambda x: length(x))) + "
        f"coalesce(list_sum(list_transform({found}[1:i-1], lambda x: length(x))), 0) AS INTEGER)"
    )


def _luhn(v: str) -> str:
    d = f"regexp_replace({v}, '[^0-9]', '', 'g')"
    digit = f"CAST(substr({d}, CAST(length({d}) - j + 1 AS BIGINT), 1) AS INTEGER)"
    return (
        f"(list_sum(list_transform(range(1, length({d}) + 1), lambda j: CASE WHEN j % 2 = 1 THEN {digit} "
        f"WHEN {digit} > 4 THEN {digit} * 2 - 9 ELSE {digit} * 2 END)) % 10 = 0)"
    )


def _mod97(v: str) -> str:
    u = f"upper(regexp_replace({v}, '[^A-Za-z0-9]', '', 'g'))"
    moved = f"(substr({u}, 5) || substr({u}, 1, 4))"
    number = (
        f"array_to_string(list_transform(string_split({moved}, ''), lambda c: CASE WHEN c >= 'A' "
        f"THEN CAST(ascii(c) - 55 AS VARCHAR) ELSE c END), '')"
    )
    return (
        f"(list_reduce(list_transform(string_split('0' || {number}, ''), lambda c: CAST(c AS INTEGER)), "
        f"lambda a, b: (a * 10 + b) % 97) = 1)"
    )


def _weighted(d: str, weights: list[int]) -> str:
    return "(" + " + ".join(f"CAST(substr({d}, {i}, 1) AS INTEGER) * {w}" for i, w in enumerate(weights, 1)) + ")"


def _mod11(v: str) -> str:
    d = f"regexp_replace({v}, '[^0-9]', '', 'g')"
    return f"((11 - {_weighted(d, [10, 9, 8, 7, 6, 5, 4, 3, 2])} % 11) % 11 = CAST(substr({d}, 10, 1) AS INTEGER))"


def _dea(v: str) -> str:
    d = f"regexp_replace({v}, '[^0-9]', '', 'g')"
    return f"({_weighted(d, [1, 2, 1, 2, 1, 2])} % 10 = CAST(substr({d}, 7, 1) AS INTEGER))"


CHECK_SQL = {"luhn": _luhn, "mod97": _mod97, "mod11": _mod11, "dea": _dea}


def matches(rules: list[Rule], source: str) -> str:
    """CTEs ``src`` (id, text, flat) and ``matches`` (id, rule, s, e, v); ``source`` selects id and text."""
    branches = "\nUNION ALL ".join(
        f"SELECT id, {i} AS rule, regexp_extract_all(flat, {q(_pattern(r))}) AS m, "
        f"string_split(regexp_replace(flat, {q(_pattern(r))}, chr(1), 'g'), chr(1)) AS g "
        f"FROM src WHERE regexp_matches(flat, {q(_pattern(r))})"
        for i, r in enumerate(rules)
    )
    checks = " ".join(f"WHEN rule = {i} THEN {CHECK_SQL[r.check]('v')}" for i, r in enumerate(rules) if r.check)
    keep = f"WHERE CASE {checks} ELSE TRUE END" if checks else ""
    return f"""src AS MATERIALIZED (SELECT id, text, {flat('text')} AS flat FROM ({source})),
hits AS ({branches}),
placed AS (SELECT id, rule, {starts()} AS s, CAST(length(m[i]) AS INTEGER) AS n
  FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM hits)),
matches AS (SELECT * FROM (SELECT p.id, rule, s, s + n AS e, substr(text, s + 1, n) AS v
  FROM placed p JOIN src USING (id)) {keep})"""


def rule_table(rules: list[Rule]) -> str:
    rows = ", ".join(
        f"({i}, {q(r.entity)}, CAST({r.score} AS DOUBLE), {str(r.labelled).lower()}, "
        f"CAST([{', '.join(q(w.lower()) for w in CONTEXT_WORDS.get(r.entity, ()))}] AS VARCHAR[]))"
        for i, r in enumerate(rules)
    )
    return f"rules(rule, label, base, labelled, words) AS (VALUES {rows})"


def scored(rules: list[Rule], words: int = 5, boost: float = 0.35, floor: float = 0.4) -> str:
    """CTEs ``rules`` and ``scored`` (id, rule, s, e, label, score, labelled) on top of ``matches``."""
    pieces = "string_split(translate(substr(text, 1, s), chr(10) || chr(13) || chr(9), '   '), ' ')"
    window = f"lower(array_to_string({pieces}[greatest(1, len({pieces}) - {words}):len({pieces})], ' '))"
    lifted = f"round(least(1.0, greatest(base + {boost}, {floor})), 6)"
    score = (
        f"CASE WHEN len(list_filter(words, lambda w: contains(win, w))) > 0 THEN {lifted} ELSE base END"
        if boost > 0 else "base"
    )
    return f"""{rule_table(rules)},
scored AS (SELECT id, rule, s, e, label, labelled, CAST({score} AS DOUBLE) AS score
  FROM (SELECT m.*, r.label, r.base, r.labelled, r.words, {window} AS win
        FROM matches m JOIN src USING (id) JOIN rules r USING (rule)))"""


def kept() -> str:
    """CTE ``kept``: greedy overlap resolution of ``scored`` as a list fold per text."""
    item = "struct_pack(s := s, e := e, label := label, score := score, rule := rule, labelled := labelled)"
    return f"""folded AS (SELECT id, list_reduce(list([{item}] ORDER BY s, score DESC, e DESC, rule),
    lambda acc, x: CASE WHEN acc[-1].s < x[1].e AND x[1].s < acc[-1].e
      THEN CASE WHEN x[1].score > acc[-1].score THEN list_concat(acc[1:len(acc) - 1], x) ELSE acc END
      ELSE list_concat(acc, x) END) AS l FROM scored GROUP BY id),
kept AS (SELECT id, k.s AS s, k.e AS e, k.label AS label, k.score AS score, k.rule AS rule, k.labelled AS labelled
  FROM (SELECT id, unnest(l) AS k FROM folded))"""


def trimmed(mode: str = "labelled", source: str = "kept") -> str:
    """CTE ``spans`` (id, s, e, label, score, src_name): keyword prefixes cut off."""
    may = f"label IN ({', '.join(q(x) for x in KEYWORD_PREFIX_LABELS)})" + (" AND labelled" if mode == "labelled" else "")
    if mode == "off":
        may = "FALSE"
    tail = lambda sep: f"instr(reverse(v), {q(sep)})"
    cut = " ".join(f"WHEN {tail(sep)} > 1 THEN length(v) - {tail(sep)} + 1" for sep in (" ", ":", "-"))
    return f"""spans AS (SELECT id, CAST(s + CASE WHEN NOT ({may}) THEN 0 {cut} ELSE 0 END AS INTEGER) AS s, e, label, score,
    'RULE' AS src_name
  FROM (SELECT k.*, substr(text, s + 1, e - s) AS v FROM {source} k JOIN src USING (id)))"""


def merged(source: str = "spans", gap: int = 1) -> str:
    """CTE ``merged``: islands of spans at most ``gap`` apart."""
    return f"""islands AS (SELECT *, sum(fresh) OVER (PARTITION BY id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM (
    SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + {gap}
      THEN 0 ELSE 1 END AS fresh FROM {source})),
merged AS (SELECT id, CAST(min(s) AS INTEGER) AS s, CAST(max(e) AS INTEGER) AS e,
    first(label ORDER BY score DESC, s) AS label, max(score) AS score, first(src_name ORDER BY score DESC, s) AS src_name
  FROM islands GROUP BY id, island)"""


def norm_table() -> str:
    rows = ", ".join(f"({q(k)}, {q(v)})" for k, v in LABEL_NORM.items())
    return f"norm(label, short) AS (VALUES {rows})"


def token(label: str, value: str) -> str:
    return f"'[' || {label} || '_' || substr(md5({value}), 1, 8) || ']'"


def tokens() -> str:
    """CTE ``tokens`` (id, s, e, label, score, src_name, value, token): rightmost label of a value in its text."""
    return f"""{norm_table()},
valued AS (SELECT m.id, m.s, m.e, m.score, m.src_name, substr(x.text, m.s + 1, m.e - m.s) AS value,
    left(coalesce(n.short, upper(m.label)), 20) AS own
  FROM merged m JOIN src x USING (id) LEFT JOIN norm n USING (label)),
tokens AS (SELECT *, {token('label', 'value')} AS token FROM (
  SELECT *, last_value(own) OVER (PARTITION BY id, value ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS label
  FROM valued))"""


def spliced(source: str = "tokens", piece: str = "token") -> str:
    """CTE ``spliced`` (id, tokenized)."""
    return f"""pieces AS (SELECT t.id, t.s, t.e, x.text,
    substr(x.text, coalesce(lag(t.e) OVER w, 0) + 1, t.s - coalesce(lag(t.e) OVER w, 0)) || t.{piece} AS piece
  FROM {source} t JOIN src x USING (id) WINDOW w AS (PARTITION BY t.id ORDER BY t.s)),
spliced AS (SELECT x.id, coalesce(p.body || substr(x.text, p.last + 1), x.text) AS tokenized
  FROM src x LEFT JOIN (SELECT id, string_agg(piece, '' ORDER BY s) AS body, max(e) AS last FROM pieces GROUP BY id) p USING (id))"""


def detection(rules: list[Rule], source: str, mode: str = "labelled", **context) -> str:
    """All CTEs down to ``spans``."""
    return ",\n".join([matches(rules, source), scored(rules, **context), kept(), trimmed(mode)])


def tokenization(rules: list[Rule], source: str, mode: str = "labelled", **context) -> str:
    """All CTEs down to ``tokens`` and ``spliced``."""
    return ",\n".join([detection(rules, source, mode, **context), merged(), tokens(), spliced()])


def all_places(text: str, regex: str, source: str, group: int = 0) -> str:
    """CTE ``found`` (id, i, s, v) of one pattern over ``source`` (id, text)."""
    return (
        f"found AS (SELECT id, CAST(i - 1 AS INTEGER) AS i, {starts()} AS s, m[i] AS v FROM (SELECT id, m, g, unnest(range(1, len(m) + 1)) AS i FROM ("
        f"SELECT id, regexp_extract_all({text}, {q(regex)}, {group}) AS m, "
        f"string_split(regexp_replace({text}, {q(regex)}, chr(1), 'g'), chr(1)) AS g FROM {source})))"
    )
