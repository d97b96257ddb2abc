"""The SQL of generated values, samples and records: the same hashes, lists and templates, written for the other engine."""

from __future__ import annotations

import re

from .. import catalog as C
from ..operators import samples as SM
from .sqltext import q

HASH = "CAST('0x' || substr(md5({0}), 1, 7) AS BIGINT)"


def _seeded(key: str) -> str:
    return f"'42|' || k || '|{key}'"


def number(key: str) -> str:
    """The hash number of a row ``k`` for one purpose."""
    return HASH.format(_seeded(key))


def text(value: str) -> str:
    """A literal; line feeds are written as their code."""
    return "(" + " || chr(10) || ".join(q(p) for p in value.split("\n")) + ")"


def _word(words: tuple[str, ...], key: str) -> str:
    return f"[{', '.join(q(w) for w in words)}][{number(key)} % {len(words)} + 1]"


def _digits(n: int, key: str) -> str:
    parts = " || ".join(f"lpad(CAST({number(f'{key}|{i}')} % 10000000 AS VARCHAR), 7, '0')" for i in range((n + 6) // 7))
    head = f"CAST({number(f'{key}|head')} % 9 + 1 AS VARCHAR)"
    return f"({head} || substr({parts}, 1, {n - 1}))" if n > 1 else head


def _hex(n: int, key: str) -> str:
    return f"substr(md5({_seeded(key)}), 1, {n})"


def _padded(key: str, most: int) -> str:
    return f"lpad(CAST({number(key)} % {most} + 1 AS VARCHAR), 2, '0')"


def values() -> dict[str, str]:
    """One expression per placeholder, over a row ``k``; ``c15`` holds the digits of a card without the last one."""
    user = f"lower({_word(SM.FIRST_NAMES, 'first')}) || '.' || lower({_word(SM.LAST_NAMES, 'last')}) || {_digits(3, 'user')}"
    doubled = "list_sum(list_transform(range(1, 16), lambda i: CASE WHEN i % 2 = 0 THEN CAST(c15[i] AS INT) WHEN CAST(c15[i] AS INT) > 4 THEN CAST(c15[i] AS INT) * 2 - 9 ELSE CAST(c15[i] AS INT) * 2 END))"
    octets = " || '.' || ".join(f"CAST({number(f'ip{i}')} % 254 + 1 AS VARCHAR)" for i in range(4))
    mac = " || ':' || ".join(f"substr(md5({_seeded('mac')}), {2 * i + 1}, 2)" for i in range(6))
    return {
        "name": f"{_word(SM.FIRST_NAMES, 'first')} || ' ' || {_word(SM.LAST_NAMES, 'last')}",
        "address": f"{_digits(3, 'house')} || ' ' || {_word(SM.STREETS, 'street')} || ', ' || {_word(SM.CITIES, 'city')}",
        "company": _word(SM.COMPANIES, "company"),
        "email": f"{user} || '@example.org'",
        "phone_number": f"'(' || {_digits(3, 'area')} || ') 555-' || {_digits(4, 'phone')}",
        "ssn": f"CAST({number('ssn')} % 500 + 100 AS VARCHAR) || '-' || {_digits(2, 'ssn2')} || '-' || {_digits(4, 'ssn3')}",
        "credit_card_number": f"c15 || CAST((10 - {doubled} % 10) % 10 AS INT)",
        "dob": f"{_padded('month', 12)} || '/' || {_padded('day', 28)} || '/' || CAST({number('year')} % 60 + 1940 AS VARCHAR)",
        "license": f"upper(translate({_hex(1, 'lic')}, '0123456789', 'ghjklmnpqr')) || {_digits(7, 'license')}",
        "passport": _digits(9, "passport"),
        "ip_address": octets,
        "mrn": f"'MRN-' || {_digits(6, 'mrn')}",
        "bank_account": _digits(11, "bank"),
        "username": f"lower({_word(SM.LAST_NAMES, 'last')}) || {_digits(2, 'login')} || '_admin'",
        "vin": f"translate(upper({_hex(17, 'vin')}), 'IOQ', 'JPR')",
        "api_key": f"'sk_live_' || {_hex(32, 'api')}",
        "mac_address": f"upper({mac})",
        "emp_id": f"'EMP-' || {_digits(4, 'emp')}",
        "insurance": f"'POL' || {_digits(6, 'insurance')}",
    }


def valued(source: str) -> str:
    """CTEs ``keyed`` and ``valued`` (k, v: a struct of all values) over ``source`` (k and more columns)."""
    fields = ", ".join(f"{name} := {expression}" for name, expression in values().items())
    return f"keyed AS (SELECT *, '4' || {_digits(14, 'card')} AS c15 FROM ({source})),\nvalued AS (SELECT *, struct_pack({fields}) AS v FROM keyed)"


def _pieces(template: str) -> list[str]:
    return [p for p in re.split(r"(\{\w+\})", template) if p]


def _piece(piece: str) -> str:
    return f"v.{piece[1:-1]}" if re.fullmatch(r"\{\w+\}", piece) else text(piece)


def filled(templates, index: str) -> str:
    """The text of the chosen template."""
    arms = " ".join(f"WHEN {i} THEN {' || '.join(map(_piece, _pieces(t)))}" for i, t in enumerate(templates))
    return f"CASE {index} {arms} END"


def entities(templates, index: str) -> str:
    """The entities of the chosen template as JSON."""
    arms = []
    for i, template in enumerate(templates):
        found, before = [], ["0"]
        for piece in _pieces(template):
            size = f"length({_piece(piece)})"
            label = C.PLACEHOLDER_LABELS.get(piece[1:-1]) if piece.startswith("{") else None
            if label:
                start = " + ".join(before)
                found.append(f"'{{\"start\":' || ({start}) || ',\"end\":' || ({start} + {size}) || ',\"label\":\"{label}\"}}'")
            before.append(size)
        arms.append(f"WHEN {i} THEN '[' || " + (" || ',' || ".join(found) or "''") + " || ']'")
    return f"CASE {index} {' '.join(arms)} END"


def placed_records(source: str = "customer", key: str = "c_custkey") -> str:
    """Rows k, t (number of the record type), file_name: quotas of equal size, the remainder to the first types."""
    names = ", ".join(q(n) for n in C.RECORD_TYPES)
    n = len(C.RECORD_TYPES)
    return f"""SELECT k, t, [{names}][t + 1] || '_' || printf('%06d', k - (t * b + least(t, x))) || '.txt' AS file_name FROM (
  SELECT *, CASE WHEN k < x * (b + 1) THEN k // (b + 1) ELSE x + (k - x * (b + 1)) // greatest(b, 1) END AS t FROM (
    SELECT {key} AS k, count(*) OVER () // {n} AS b, count(*) OVER () % {n} AS x FROM {source}))"""


def samples(source: str = "SELECT c_custkey AS k FROM customer") -> str:
    index = f"{number('template')} % {len(SM.SAMPLE_TEMPLATES)}"
    return (f"WITH {valued(source)} SELECT k AS c_custkey, {filled(SM.SAMPLE_TEMPLATES, index)} AS text, "
            f"{entities(SM.SAMPLE_TEMPLATES, index)} AS entities FROM valued")


def records() -> str:
    layouts = list(SM.RECORD_TEMPLATES.values())
    order = [list(SM.RECORD_TEMPLATES).index(n) for n in C.RECORD_TYPES]
    return f"WITH {valued(placed_records())} SELECT k AS c_custkey, file_name, {filled([layouts[i] for i in order], 't')} AS text FROM valued"


# --- chat examples -----------------------------------------------------------------------------------------------

_STRIP = r"'^\s+|\s+$', '', 'g'"


def parts(tokenization: str) -> str:
    """CTEs down to ``parts`` (k, doc, type, pairs, tokens, sections) of tokenized records; ``tokenization`` ends in ``spliced``."""
    types = " ".join(f"WHEN starts_with(file_name, {q(prefix)}) THEN {q(title)}" for prefix, title in C.RECORD_TYPES.items())
    header = "right(bare, 1) = ':' AND left(bare, 1) <> '-' AND length(bare) < 40"
    return f"""{tokenization},
named AS (SELECT id AS k, file_name, tokenized AS body FROM spliced JOIN ({placed_records()}) ON k = id),
line AS (SELECT k, l, regexp_replace(l, {_STRIP}) AS bare, i FROM (SELECT k, unnest(string_split(body, chr(10))) AS l, generate_subscripts(string_split(body, chr(10)), 1) AS i, len(string_split(body, chr(10))) AS n FROM named) WHERE NOT (i = n AND l = '')),
headed AS (SELECT *, CASE WHEN {header} THEN 1 ELSE 0 END AS opens FROM line),
grouped AS (SELECT *, sum(opens) OVER (PARTITION BY k ORDER BY i) AS g FROM headed),
section AS (SELECT k, g, coalesce(max(regexp_replace(bare, ':+$', '')) FILTER (WHERE opens = 1), 'header') AS name, coalesce(list(bare ORDER BY i) FILTER (WHERE opens = 0), []) AS lines FROM grouped GROUP BY k, g),
listed AS (SELECT k, list({{'name': name, 'lines': lines}} ORDER BY g) AS sections FROM section GROUP BY k),
matched AS (SELECT *, regexp_extract_all(body, {q(_PAIR)}, 1) AS m, regexp_extract_all(body, {q(_PAIR)}, 2) AS t FROM named),
parts AS (SELECT k, regexp_replace(body, {_STRIP}) AS doc, CASE {types} ELSE {q(C.RECORD_TYPE_DEFAULT)} END AS type,
  list_filter(list_transform(range(1, len(m) + 1), lambda i: {{'field': regexp_replace(regexp_replace(m[i], {_STRIP}), '^[- ]+|[- ]+$', '', 'g'), 'token': t[i]}}), lambda p: length(p.field) > 0) AS pairs,
  regexp_extract_all(body, {q(C.TOKEN_REGEX)}, 0) AS tokens, sections FROM matched JOIN listed USING (k))"""


_PAIR = r"([A-Za-z ]+):\s*(" + C.TOKEN_REGEX.replace("(", "(?:") + ")"


def _pick(n, slot: str, purpose: str) -> str:
    return f"({number(f'{slot}|{purpose}')} % {n})"


def _chosen(name: str, slot: str, **known: str) -> str:
    known = {"type": "type", "doc": "doc", **known}
    options = C.CHAT_TEXTS[name]
    fill = lambda t: " || ".join(known[p[1:-1]] if re.fullmatch(r"\{\w+\}", p) else text(p) for p in _pieces(t))
    arms = " ".join(f"WHEN {i} THEN {fill(t)}" for i, t in enumerate(options))
    return f"CASE {_pick(len(options), slot, name)} {arms} END"


def _talk(*turns: tuple[str, str]) -> str:
    rows = [("system", text(C.CHAT_SYSTEM)), *turns]
    return "CAST(to_json([" + ", ".join(f"{{'role': {q(role)}, 'content': {content}}}" for role, content in rows) + "]) AS VARCHAR)"


def example(kind: str, slot: str) -> str:
    """The messages of one kind as JSON, over a row of ``parts``; NULL where the record cannot give it."""
    if kind == "generation":
        return _talk(("user", _chosen("generation.ask", slot)), ("assistant", "doc"))
    if kind == "lookup":
        p = f"pairs[{_pick('len(pairs)', slot, 'pair')} + 1]"
        asked = _chosen("lookup.ask", slot, field=f"{p}.field")
        return f"CASE WHEN len(pairs) > 0 THEN {_talk(('user', asked), ('assistant', _chosen('lookup.answer', slot, field=f'{p}.field', token=f'{p}.token')))} END"
    if kind == "summary":
        refs = "array_to_string(list_transform(tokens[1:3], lambda t: '`' || t || '`'), ', ')"
        answer = _chosen("summary.answer", slot, first="tokens[1]", second="coalesce(tokens[2], tokens[1])", refs=refs)
        answer = f"CASE WHEN len(tokens) > 0 THEN {answer} ELSE {_chosen('summary.plain', slot)} END"
        return _talk(("user", _chosen("summary.ask", slot)), ("assistant", answer))
    if kind == "section":
        named = "list_filter(sections, lambda s: s.name <> 'header')"
        s = f"({named})[{_pick(f'len({named})', slot, 'section')} + 1]"
        bullets = f"array_to_string(list_transform(list_filter({s}.lines, lambda x: length(x) > 0), lambda x: '- ' || regexp_replace(x, '^[- ]+', '')), chr(10))"
        asked, answer = _chosen("section.ask", slot, section=f"{s}.name"), _chosen("section.answer", slot, section=f"{s}.name", bullets=bullets)
        usable = f"len(sections) >= 2 AND len(list_filter({s}.lines, lambda x: length(x) > 0)) > 0"
        return f"CASE WHEN {usable} THEN {_talk(('user', asked), ('assistant', answer))} END"
    p = f"pairs[{_pick('len(pairs)', slot, 'first')} + 1]"
    others = f"list_filter(pairs, lambda x: x.token <> {p}.token)"
    o = f"({others})[{_pick(f'len({others})', slot, 'second')} + 1]"
    talk = _talk(
        ("user", _chosen("turns.ask", slot)), ("assistant", _chosen("turns.acknowledge", slot, field=f"{p}.field", token=f"{p}.token")),
        ("user", _chosen("turns.follow", slot, field2=f"{o}.field")), ("assistant", _chosen("turns.answer", slot, field2=f"{o}.field", token2=f"{o}.token")))
    return f"CASE WHEN len(pairs) > 0 AND len({others}) > 0 THEN {talk} END"


def examples_of_kind(tokenization: str, kind: str) -> str:
    return f"WITH {parts(tokenization)} SELECT c_custkey, messages FROM (SELECT k AS c_custkey, {example(kind, 'only')} AS messages FROM parts) WHERE messages IS NOT NULL"


def chat_examples(tokenization: str, kinds: tuple[str, ...], per_doc: int = 6) -> str:
    """One generation example a record, then the first of a shuffled pool of all kinds."""
    pool = " UNION ALL ".join(
        f"SELECT k, {number(f'slot{i}')} AS rank, {i} AS slot, {q(kinds[i % len(kinds)])} AS kind, {example(kinds[i % len(kinds)], str(i))} AS messages FROM parts"
        for i in range(3 * len(kinds)))
    return f"""WITH {parts(tokenization)}, pool AS ({pool}),
ordered AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY rank, slot) AS n FROM pool WHERE messages IS NOT NULL)
SELECT k AS c_custkey, 0 AS example_no, 'generation' AS kind, {example('generation', 'first')} AS messages FROM parts
UNION ALL SELECT k, CAST(n AS INTEGER), kind, messages FROM ordered WHERE n < {per_doc}"""
