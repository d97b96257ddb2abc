"""Many rules over a batch of texts: whole-array steps name the places where a rule may begin, its pattern is tried there.

A table says for each of the first characters of a match which rules allow it,
one bit a rule.  Looking it up leaves few places, mostly those of matches, so
that many rules cost little more than one.
"""

from __future__ import annotations

import re
from decimal import ROUND_HALF_UP, Decimal
from functools import lru_cache
from re._parser import parse

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from .. import catalog as C
from ..functions.arrays import in_parts
from ..functions.checks import VALUE_CHECKS
from .spans import values

DEPTH = 12  # characters of a match that are looked up
CHUNK = 1 << 20  # characters looked at together
OTHER = 128  # stands for every character that is not ASCII
MATCH = "array<struct<start:int,end:int,hit:string,rule:int>>"
PLACE = "array<struct<start:int,end:int,rule:int>>"
_KINDS = {"CATEGORY_DIGIT": "0123456789", "CATEGORY_SPACE": " \t\n\r\f\v",
          "CATEGORY_WORD": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz_"}


class _Unplain(Exception):
    """A regex that the two engines may read differently, or whose first characters are not plain to see."""


def _characters(kind: str, value, fold: bool) -> np.ndarray:
    """The characters an item may take (more at most), ASCII one by one."""
    out, negated = np.zeros(OTHER + 1, bool), False
    for what, x in value if kind == "IN" else [(kind, value)]:
        what = str(what)
        if what == "LITERAL":
            if kind == "IN" and chr(x) in "[&":
                raise _Unplain
            out[min(x, OTHER)] = True
        elif what == "RANGE":
            out[x[0] : x[1] + 1] = True
            out[OTHER] |= x[1] >= OTHER
        elif what == "CATEGORY" and str(x) in _KINDS:
            out[[ord(c) for c in _KINDS[str(x)]]] = True
        elif what == "NEGATE":
            negated = True
        else:
            raise _Unplain
    if negated:
        out = ~out
        out[OTHER] = True
    elif fold:
        out[65:91] |= out[97:123]
        out[97:123] |= out[65:91]
    return out


def _steps(items: tuple, fold: bool):
    """Each way on from a place in a regex: the next character and what follows it, or None where a match may end."""
    if not items:
        yield None
        return
    (kind, value), rest = items[0], items[1:]
    name = str(kind)
    if name in ("AT", "ASSERT", "ASSERT_NOT"):
        yield from _steps(rest, fold)
    elif name in ("LITERAL", "IN"):
        yield _characters(name, value, fold), rest
    elif name == "SUBPATTERN" and not value[1] and not value[2]:
        yield from _steps((*value[3], *rest), fold)
    elif name == "BRANCH":
        for way in value[1]:
            yield from _steps((*way, *rest), fold)
    elif name in ("MAX_REPEAT", "MIN_REPEAT"):
        low, high, body = value
        if body.getwidth()[0] == 0:
            raise _Unplain
        if low == 0:
            yield from _steps(rest, fold)
        if high > 0:
            fewer = high if high > 1 << 20 else high - 1
            yield from _steps((*body, (kind, (max(low - 1, 0), fewer, body)), *rest), fold)
    else:
        raise _Unplain


def _places_in(items, outer: bool = True) -> int:
    """Boundaries and other places that the body of a regex names, besides those at its two ends."""
    found = 0
    for i, (kind, value) in enumerate(items):
        name = str(kind)
        if name == "AT":
            found += not (outer and i in (0, len(items) - 1) and str(value) == "AT_BOUNDARY")
        elif name == "SUBPATTERN":
            found += _places_in(value[3], False)
        elif name == "BRANCH":
            found += sum(_places_in(way, False) for way in value[1])
        elif name.endswith("REPEAT"):
            found += _places_in(value[2], False)
        elif name.startswith("ASSERT"):
            found += _places_in(value[1], False)
    return found


@lru_cache(maxsize=4096)
def first_characters(rule: C.Rule) -> tuple[np.ndarray, ...] | None:
    """What each of the first characters of a match may be; None for a rule that is left to the engine.

    Behind a place where a match may end every character is allowed.
    """
    if C.scan_regex(rule) is None or (rule.hints or rule.digits or rule.gate) and rule not in C.CATALOGUE:
        return None
    try:
        parsed = parse(rule.regex)
        if _places_in(parsed):
            return None
        states, out = {"": tuple(parsed)}, []
        for _ in range(DEPTH):
            allowed, after = np.zeros(OTHER + 1, bool), {}
            for state in states.values():
                for step in _steps(state, rule.ignore_case):
                    if step is None:
                        allowed[:] = True
                    else:
                        allowed |= step[0]
                        after.setdefault(repr(step[1]), step[1])
            out.append(allowed)
            states = after
            if allowed.all() or len(states) > 200:
                break
    except _Unplain:
        return None
    return tuple(out) + (np.ones(OTHER + 1, bool),) * (DEPTH - len(out))


def _pattern(rule: C.Rule) -> str:
    """The same regex for Python: ASCII classes and cases, but every letter and number counts at the edge of a word."""
    flags = "(?i)" if rule.ignore_case else ""
    return ("(?ai)" if rule.ignore_case else "(?a)") + C.spark_regex(rule)[len(flags) :].replace(C._WORD, r"(?u:\w)")


@lru_cache(maxsize=64)
def _compiled(patterns: tuple[str, ...]) -> list:
    return [re.compile(p).match for p in patterns]


_WORD = np.zeros(OTHER + 1, bool)
_WORD[[ord(c) for c in _KINDS["CATEGORY_WORD"]]] = True


def _words(codes: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Which characters are letters, numbers or low lines."""
    out = _WORD[low]
    other = np.flatnonzero(low == OTHER)
    if len(other):
        kinds, which = np.unique(codes[other], return_inverse=True)
        out[other] = np.array([chr(c).isalnum() for c in kinds.tolist()])[which]
    return out


def _candidates(low: np.ndarray, places: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, rule) in order of places for each rule, where the characters from there on are allowed."""
    found, rules = [], []
    for k in range(table.shape[2]):
        allowed = np.ascontiguousarray(table[:, :, k])
        here, bits = places, allowed[0][low[places]]
        for depth in range(1, DEPTH):
            left = np.flatnonzero(bits)
            here = here[left]
            bits = bits[left] & allowed[depth][low[here + depth]]
        left = np.flatnonzero(bits)
        at, rule = np.nonzero(np.unpackbits(bits[left].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
        found.append(here[left][at])
        rules.append(rule + 64 * k)
    return np.concatenate(found), np.concatenate(rules)


def _find(texts: list[str], patterns: tuple[str, ...], inner: np.ndarray, table: np.ndarray):
    """(text, rule, start, end) of every match of a rule that no earlier match of it overlaps, rule by rule."""
    gap = "\0" * DEPTH
    codes = np.frombuffer((gap + gap.join(texts) + gap).encode("utf-32-le", "surrogatepass"), np.uint32)
    low = np.minimum(codes, OTHER).astype(np.uint8)
    word = _words(codes, low)
    first = np.cumsum([DEPTH] + [len(t) + DEPTH for t in texts])
    edge = np.ones(len(word), bool)
    edge[1:] = ~(word[1:] & word[:-1])
    edge[len(edge) - DEPTH :] = False
    places, rules = _candidates(low, np.flatnonzero(edge), table)
    if inner.any():
        inside, more = _candidates(low, np.flatnonzero(~edge[: len(edge) - DEPTH]), table & inner)
        places, rules = np.concatenate([places, inside]), np.concatenate([rules, more])
        order = np.lexsort((places, rules))
        places, rules = places[order], rules[order]
    rows = np.searchsorted(first, places, side="right") - 1
    tries, ends, found = _compiled(patterns), [0] * len(patterns), []
    for place, at, row, rule in zip(places.tolist(), (places - first[rows]).tolist(), rows.tolist(), rules.tolist()):
        if place >= ends[rule] and at < len(texts[row]):
            match = tries[rule](texts[row], at)
            if match:
                end = match.end()
                ends[rule] = place + end - at
                found.append((row, rule, at, end))
    found.sort()
    return found


def _chunks(texts: list[str], patterns: tuple[str, ...], inner: np.ndarray, table: np.ndarray):
    """:func:`_find` in texts of about ``CHUNK`` characters at a time."""
    at = 0
    while at < len(texts):
        stop, size = at, 0
        while stop < len(texts) and (stop == at or size + len(texts[stop]) <= CHUNK):
            size += len(texts[stop]) + DEPTH
            stop += 1
        for row, *found in _find(texts[at:stop], patterns, inner, table):
            yield at + row, *found
        at = stop


def _tables(rules: list[C.Rule]):
    """Numbers of the plain rules and of the others; patterns, inner bits and table of the plain ones."""
    sets = [first_characters(r) for r in rules]
    numbers = tuple(i for i, s in enumerate(sets) if s is not None)
    others = [i for i, s in enumerate(sets) if s is None]
    patterns = tuple(_pattern(rules[i]) for i in numbers)
    width = -(-len(numbers) // 64)
    table = np.zeros((DEPTH, OTHER + 1, width), np.uint64)
    inner = np.zeros(width, np.uint64)
    for k, i in enumerate(numbers):
        bit = np.uint64(1 << (k % 64))
        for depth, allowed in enumerate(sets[i]):
            table[depth, allowed, k // 64] |= bit
        if not rules[i].regex.startswith((r"\b", r"(?<!\w)")) or C._parted(rules[i].regex):
            inner[k // 64] |= bit
    return numbers, others, patterns, inner, table


def _listed(found: list[tuple], rows: int, names: tuple[str, ...]) -> pa.Array:
    """(row, ...) in order of rows as an array of structs for each row."""
    row, *fields = zip(*found) if found else [()] * (1 + len(names))
    made = [pa.array(f, pa.string() if name == "hit" else pa.int32()) for f, name in zip(fields, names)]
    offsets = np.searchsorted(np.array(row, np.int32), np.arange(rows + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(made, list(names)))


def finder(rules: list[C.Rule]):
    """A function of a text column that finds the matches whose check digits hold; None if a rule is left to the engine."""
    numbers, others, patterns, inner, table = _tables(rules)
    if others or not numbers:
        return None
    checks = [VALUE_CHECKS[rules[i].check] if rules[i].check else None for i in numbers]

    def of_part(column: pa.Array) -> pa.Array:
        texts = [t or "" for t in column.to_pylist()]
        found = [(row, start, end, numbers[rule]) for row, rule, start, end in _chunks(texts, patterns, inner, table)
                 if not checks[rule] or checks[rule](texts[row][start:end])]
        return _listed(found, len(texts), ("start", "end", "rule"))

    @F.arrow_udf(PLACE)
    def found(column: pa.Array) -> pa.Array:
        return in_parts(of_part, column)

    return found


def scanner(rules: list[C.Rule]):
    """A function of a text column that finds the matches of the plain ones of the rules, and the numbers of the others."""
    numbers, others, patterns, inner, table = _tables(rules)
    if not numbers:
        return None, others

    def of_part(column: pa.Array) -> pa.Array:
        texts = [t or "" for t in column.to_pylist()]
        found = [(row, start, end, texts[row][start:end], numbers[rule]) for row, rule, start, end in _chunks(texts, patterns, inner, table)]
        return _listed(found, len(texts), ("start", "end", "hit", "rule"))

    @F.arrow_udf(MATCH)
    def found(column: pa.Array) -> pa.Array:
        return in_parts(of_part, column)

    return found, others


SPAN = "struct<start:int,end:int,label:string,score:double,source:string>"


def _flat(text: str) -> str:
    """Line ends and tabs as blanks (``translate`` looks every character up and is far slower)."""
    return text.replace("\n", " ").replace("\r", " ").replace("\t", " ")


def _rounded(value: float) -> float:
    return float(Decimal(repr(value)).quantize(Decimal("0.000001"), ROUND_HALF_UP))


def _window(flat: str, start: int, words: int) -> str:
    """The last ``words`` blank-separated pieces before a place (and the piece it sits in), lower case."""
    at = start
    for _ in range(words + 1):
        at = flat.rfind(" ", 0, at)
        if at < 0:
            break
    return flat[at + 1 : start].lower()


def _best(spans: list[tuple]) -> list[tuple]:
    """Greedy overlap resolution: kept spans are disjoint, so only the last one can overlap the next."""
    kept = []
    for span in spans:
        if not kept or span[0] >= kept[-1][4] or kept[-1][0] >= span[4]:
            kept.append(span)
        elif span[1] < kept[-1][1]:
            kept[-1] = span
    return kept


def _trimmed(text: str, start: int, end: int) -> int:
    """A start past the last blank, else colon, else hyphen, if something is left."""
    for sign in " :-":
        at = text.rfind(sign, start, end)
        if 0 <= at < end - 1:
            return at + 1
    return start


def _lists(column: pa.Array) -> list[int]:
    """Where the items of each list begin among the items of all; a NULL has none."""
    return np.concatenate([[0], np.cumsum(np.asarray(column.value_lengths().fill_null(0)))]).tolist()


def span_maker(
    rules: list[C.Rule], vocabularies: list[tuple[str, ...]], source: str, words: int, boost: float, floor: float,
    resolve: bool, prefixes: tuple[str, ...] | None, labelled: bool,
):
    """A function of texts and their matches: spans with scores, best ones kept, keyword prefixes trimmed.

    A context word shortly before a match raises its score.  Spans come by start,
    then score, then length, then place in the catalogue.  ``prefixes`` are the
    labels that are trimmed (with ``labelled`` only after rules with a keyword).
    """
    low = [float(r.score) for r in rules]
    high = [_rounded(min(1.0, max(s + boost, floor))) for s in low]
    known = list(dict.fromkeys(vocabularies))
    which = [known.index(v) for v in vocabularies] if boost > 0 else [None] * len(rules)
    which = [k if k is not None and known[k] else None for k in which]
    labels = [r.entity for r in rules]
    trims = [bool(prefixes) and r.entity in prefixes and (r.labelled or not labelled) for r in rules]

    def of_text(text: str, matches: list[tuple]) -> list[tuple]:
        flat, windows, near, scored = _flat(text), {}, {}, []
        for start, end, rule in matches:
            score, k = low[rule], which[rule]
            if k is not None:
                close = near.get((start, k))
                if close is None:
                    if start not in windows:
                        windows[start] = _window(flat, start, words)
                    close = near[start, k] = any(w in windows[start] for w in known[k])
                if close:
                    score = high[rule]
            scored.append((start, -score, -end, rule, end))
        scored.sort()
        return _best(scored) if resolve else scored

    def of_part(texts: pa.Array, matches: pa.Array) -> pa.Array:
        edges, items = _lists(matches), matches.flatten()
        triples = list(zip(*(values(items.field(items.type.get_field_index(name))) for name in ("start", "end", "rule"))))
        counts, starts, ends, names, scores = [0], [], [], [], []
        for row, text in enumerate(texts.to_pylist()):
            if edges[row] < edges[row + 1]:
                for start, down, _, rule, end in of_text(text, triples[edges[row] : edges[row + 1]]):
                    starts.append(_trimmed(text, start, end) if trims[rule] else start)
                    ends.append(end)
                    names.append(labels[rule])
                    scores.append(-down)
            counts.append(len(starts))
        fields = [pa.array(starts, pa.int32()), pa.array(ends, pa.int32()), pa.array(names, pa.string()), pa.array(scores, pa.float64()),
                  pa.array([source] * len(starts), pa.string())]
        return pa.ListArray.from_arrays(pa.array(counts, pa.int32()), pa.StructArray.from_arrays(fields, ["start", "end", "label", "score", "source"]))

    @F.arrow_udf(f"array<{SPAN}>")
    def spans(texts: pa.Array, matches: pa.Array) -> pa.Array:
        return in_parts(of_part, texts, matches)

    return spans
