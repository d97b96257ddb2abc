"""Chat formatting with a compiled, sandboxed template language (operator 9).

A template is parsed into a syntax tree, constant parts are folded, and the
tree becomes Python closures.  They render a conversation into text and the
character ranges of its generation blocks.  The language has output
``{{ e }}``, ``{% for x in e %}``, ``{% if e %}`` / ``{% elif e %}`` / ``{% else %}``,
``{% generation %}``, comparison, ``and`` / ``or`` / ``not``, ``+``, string and number
constants, fields by ``.name`` or ``['name']``, and the filters below.  It has
no calls, no attributes of Python objects and no assignment.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

TURN, BODY, END = "<turn>", "<text>", "</turn>"
TEMPLATE = (
    "{% for m in messages %}" + TURN + "{{ m.role | escape }}" + BODY
    + "{% if m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}"
    + "{% else %}{{ m.text | escape }}{% endif %}" + END + "\n{% endfor %}"
)

# A control string is broken by a backslash after its first character; one that is broken already gets one more.
_CONTROL = re.compile(r"<(\\*)(turn>|text>|/turn>)")
_BROKEN = re.compile(r"<\\(\\*)(turn>|text>|/turn>)")


def escape(text: str) -> str:
    return _CONTROL.sub(r"<\\\1\2", text)


def unescape(text: str) -> str:
    return _BROKEN.sub(r"<\1\2", text)


FILTERS: dict[str, Callable[[str], str]] = {"escape": escape, "trim": str.strip, "upper": str.upper, "lower": str.lower}


class TemplateError(ValueError):
    pass


# --- syntax tree -------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Const:
    value: object


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Field:
    of: object
    name: str


@dataclass(frozen=True)
class Op:
    op: str
    parts: tuple


@dataclass(frozen=True)
class Filter:
    of: object
    name: str


@dataclass(frozen=True)
class Output:
    of: object


@dataclass(frozen=True)
class For:
    name: str
    over: object
    body: tuple


@dataclass(frozen=True)
class If:
    arms: tuple  # (condition, body) pairs; the condition of an else is Const(True)


@dataclass(frozen=True)
class Generation:
    body: tuple


# --- parsing -----------------------------------------------------------------------------------------------------

_PART = re.compile(r"(\{\{.*?\}\}|\{%.*?%\})", re.S)
_TOKEN = re.compile(r"\s*(?:('(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(\d+)|([A-Za-z]\w*)|(==|!=|[|+.()\[\]]))")
_ESCAPES = {"n": "\n", "t": "\t"}


class _Expression:
    """Recursive descent over the tokens of one expression."""

    def __init__(self, source: str):
        self.tokens, at = [], 0
        while source[at:].strip():
            found = _TOKEN.match(source, at)
            if not found:
                raise TemplateError(f"cannot read {source[at:]!r}")
            self.tokens.append((found.lastindex, found[found.lastindex]))
            at = found.end()
        self.at = 0

    def peek(self, *values: str) -> str | None:
        if self.at < len(self.tokens) and self.tokens[self.at][0] >= 3 and self.tokens[self.at][1] in values:
            return self.tokens[self.at][1]
        return None

    def take(self, *values: str) -> str | None:
        found = self.peek(*values)
        self.at += found is not None
        return found

    def need(self, value: str) -> None:
        if not self.take(value):
            raise TemplateError(f"{value!r} is missing")

    def word(self) -> str:
        if self.at < len(self.tokens) and self.tokens[self.at][0] == 3:
            self.at += 1
            return self.tokens[self.at - 1][1]
        raise TemplateError("a name is missing")

    def whole(self):
        out = self.either()
        if self.at < len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")
        return out

    def either(self):
        parts = [self.both()]
        while self.take("or"):
            parts.append(self.both())
        return parts[0] if len(parts) == 1 else Op("or", tuple(parts))

    def both(self):
        parts = [self.negated()]
        while self.take("and"):
            parts.append(self.negated())
        return parts[0] if len(parts) == 1 else Op("and", tuple(parts))

    def negated(self):
        return Op("not", (self.negated(),)) if self.take("not") else self.compared()

    def compared(self):
        left = self.summed()
        op = self.take("==", "!=")
        return Op(op, (left, self.summed())) if op else left

    def summed(self):
        out = self.filtered()
        while self.take("+"):
            out = Op("+", (out, self.filtered()))
        return out

    def filtered(self):
        out = self.field()
        while self.take("|"):
            name = self.word()
            if name not in FILTERS:
                raise TemplateError(f"no filter {name!r}")
            out = Filter(out, name)
        return out

    def field(self):
        out = self.simple()
        while True:
            if self.take("."):
                out = Field(out, self.word())
            elif self.take("["):
                inner = self.simple()
                if not isinstance(inner, Const) or not isinstance(inner.value, str):
                    raise TemplateError("a field name must be a string")
                out = Field(out, inner.value)
                self.need("]")
            else:
                return out

    def simple(self):
        if self.take("("):
            out = self.either()
            self.need(")")
            return out
        if self.at >= len(self.tokens):
            raise TemplateError("an expression ends too early")
        kind, value = self.tokens[self.at]
        self.at += 1
        if kind == 1:
            return Const(re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), value[1:-1], flags=re.S))
        if kind == 2:
            return Const(int(value))
        if kind == 3 and value not in ("and", "or", "not", "in"):
            return Const({"true": True, "false": False}[value]) if value in ("true", "false") else Name(value)
        raise TemplateError(f"unexpected {value!r}")


def parse(source: str) -> tuple:
    """The template's syntax tree."""
    parts = [p for p in _PART.split(source) if p]
    body, rest = _parse_body(parts, 0, ())
    if rest != len(parts):
        raise TemplateError(f"unexpected {parts[rest]}")
    return body


def _parse_body(parts: list[str], at: int, stops: tuple) -> tuple[tuple, int]:
    out: list = []
    while at < len(parts):
        part = parts[at]
        if part.startswith("{{"):
            out.append(Output(_Expression(part[2:-2]).whole()))
            at += 1
        elif part.startswith("{%"):
            word, _, rest = part[2:-2].strip().partition(" ")
            if word in stops:
                return tuple(out), at
            node, at = _parse_block(parts, at, word, rest)
            out.append(node)
        else:
            out.append(Output(Const(part)))
            at += 1
    if stops:
        raise TemplateError(f"{' or '.join(stops)} is missing")
    return tuple(out), at


def _parse_block(parts: list[str], at: int, word: str, rest: str):
    if word == "for":
        found = re.fullmatch(r"([A-Za-z]\w*)\s+in\s+(.+)", rest, re.S)
        if not found:
            raise TemplateError(f"cannot read for {rest!r}")
        body, at = _parse_body(parts, at + 1, ("endfor",))
        return For(found[1], _Expression(found[2]).whole(), body), at + 1
    if word == "generation":
        body, at = _parse_body(parts, at + 1, ("endgeneration",))
        return Generation(body), at + 1
    if word == "if":
        arms, condition = [], _Expression(rest).whole()
        while True:
            body, at = _parse_body(parts, at + 1, ("elif", "else", "endif") if condition != Const(True) else ("endif",))
            arms.append((condition, body))
            word, _, rest = parts[at][2:-2].strip().partition(" ")
            if word == "endif":
                return If(tuple(arms)), at + 1
            condition = _Expression(rest).whole() if word == "elif" else Const(True)
    raise TemplateError(f"no block {word!r}")


# --- folding -----------------------------------------------------------------------------------------------------


def fold(node):
    """The tree with constant expressions evaluated, dead arms dropped and neighbouring texts joined."""
    if isinstance(node, tuple):
        out: list = []
        for x in map(fold, node):
            for y in x if isinstance(x, tuple) else (x,):
                if isinstance(y, Output) and isinstance(y.of, Const):
                    if out and isinstance(out[-1], Output) and isinstance(out[-1].of, Const):
                        out[-1] = Output(Const(_text(out[-1].of.value) + _text(y.of.value)))
                        continue
                out.append(y)
        return tuple(out)
    if isinstance(node, Op):
        node = Op(node.op, tuple(map(fold, node.parts)))
        return Const(_value(node)({})) if all(isinstance(p, Const) for p in node.parts) else node
    if isinstance(node, Filter):
        of = fold(node.of)
        return Const(FILTERS[node.name](_text(of.value))) if isinstance(of, Const) else Filter(of, node.name)
    if isinstance(node, Field):
        return Field(fold(node.of), node.name)
    if isinstance(node, Output):
        return Output(fold(node.of))
    if isinstance(node, For):
        return For(node.name, fold(node.over), fold(node.body))
    if isinstance(node, Generation):
        return Generation(fold(node.body))
    if isinstance(node, If):
        arms = []
        for condition, body in node.arms:
            condition = fold(condition)
            if isinstance(condition, Const) and not condition.value:
                continue
            arms.append((condition, fold(body)))
            if isinstance(condition, Const):
                break
        if arms and isinstance(arms[0][0], Const):
            return arms[0][1]
        return If(tuple(arms)) if arms else ()
    return node


# --- closures ----------------------------------------------------------------------------------------------------


def _text(value) -> str:
    return "" if value is None else value if isinstance(value, str) else str(value)


def _value(node) -> Callable[[dict], object]:
    if isinstance(node, Const):
        return lambda env: node.value
    if isinstance(node, Name):
        return lambda env: env.get(node.name)
    if isinstance(node, Field):
        of, name = _value(node.of), node.name

        def get(env):
            found = of(env)
            return found.get(name) if isinstance(found, dict) else None

        return get
    if isinstance(node, Filter):
        of, apply = _value(node.of), FILTERS[node.name]
        return lambda env: apply(_text(of(env)))
    parts = [_value(p) for p in node.parts]
    if node.op == "not":
        return lambda env: not parts[0](env)
    if node.op == "and":
        return lambda env: all(p(env) for p in parts)
    if node.op == "or":
        return lambda env: any(p(env) for p in parts)
    left, right = parts
    if node.op == "+":
        return lambda env: _text(left(env)) + _text(right(env))
    return (lambda env: left(env) == right(env)) if node.op == "==" else (lambda env: left(env) != right(env))


class Sink:
    """Pieces of the output and the ranges of its generation blocks."""

    def __init__(self):
        self.pieces, self.length, self.spans = [], 0, []

    def put(self, text: str) -> None:
        self.pieces.append(text)
        self.length += len(text)


def _writer(node) -> Callable[[dict, Sink], None]:
    if isinstance(node, tuple):
        steps = [_writer(x) for x in node]

        def run(env, sink):
            for step in steps:
                step(env, sink)

        return run
    if isinstance(node, Output):
        value = _value(node.of)
        return lambda env, sink: sink.put(_text(value(env)))
    if isinstance(node, For):
        over, body, name = _value(node.over), _writer(node.body), node.name

        def loop(env, sink):
            inner = dict(env)
            for item in over(env) or ():
                inner[name] = item
                body(inner, sink)

        return loop
    if isinstance(node, Generation):
        body = _writer(node.body)

        def marked(env, sink):
            start = sink.length
            body(env, sink)
            sink.spans.append((start, sink.length))

        return marked
    arms = [(_value(c), _writer(b)) for c, b in node.arms]

    def choose(env, sink):
        for condition, body in arms:
            if condition(env):
                return body(env, sink)

    return choose


@lru_cache(maxsize=64)
def compile_template(source: str) -> Callable[[list[dict]], tuple[str, list[tuple[int, int]]]]:
    """A function from messages (dicts with role and text) to the text and its generation ranges."""
    write = _writer(fold(parse(source)))

    def render(messages):
        sink = Sink()
        write({"messages": messages}, sink)
        return "".join(sink.pieces), sink.spans

    return render


def read_turns(text: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a text that ``TEMPLATE`` made."""
    out, at = [], 0
    while at < len(text):
        body = text.index(BODY, at)
        end = text.index(END, body)
        out.append((unescape(text[at + len(TURN) : body]), unescape(text[body + len(BODY) : end])))
        at = end + len(END) + 1
    return out


# --- Spark -------------------------------------------------------------------------------------------------------

SPANS = "array<struct<start:int,end:int>>"


def format_chats(rows: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """conv_id, formatted text and its generation ranges (code points), one row per conversation.

    Turns go by turn number (NULL first), then role and text.  NULL roles and
    texts are empty; rows with a NULL conv_id are one conversation.  Rows are
    shuffled by conversation and streamed in order, so a task holds one
    conversation at a time.
    """
    compile_template(template)
    sorted_rows = rows.select("conv_id", "turn", "role", "text").repartition(C.partitions(rows.sparkSession), "conv_id").sortWithinPartitions(
        F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.coalesce("role", F.lit("")), F.coalesce("text", F.lit("")))
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def work(batches):
        render = compile_template(template)

        def made(done):
            texts = [(c, *render(m)) for c, m in done]
            spans = pa.array([[{"start": a, "end": b} for a, b in s] for _, _, s in texts], kind)
            return C.columns_batch(conv_id=pa.array([c for c, _, _ in texts], pa.int64()), formatted=pa.array([t for _, t, _ in texts], pa.string()), loss=spans)

        current, messages, some = None, [], False
        for batch in batches:
            done = []
            for conv, role, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                if some and conv != current:
                    done.append((current, messages))
                    messages = []
                current, some = conv, True
                messages.append({"role": role or "", "text": text or ""})
            if done:
                yield made(done)
        if some:
            yield made([(current, messages)])

    return sorted_rows.mapInArrow(work, f"conv_id long, formatted string, loss {SPANS}")


def digests(formatted: DataFrame) -> DataFrame:
    """What the formatted texts say when they are read back."""

    def work(batches):
        for batch in batches:
            out = {k: [] for k in ("n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")}
            for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                turns = read_turns(text)
                whole = hashlib.sha256()
                for role, said in turns:
                    whole.update(f"{role}\n{said}\n".encode())
                loss = [unescape(text[s["start"] : s["end"]]) for s in spans]
                part = hashlib.sha256()
                for said in loss:
                    part.update(said.encode())
                for k, v in zip(out, (len(turns), whole.hexdigest(), sum(map(len, loss)), part.hexdigest(), len(text))):
                    out[k].append(v)
            yield C.columns_batch(conv_id=batch.column(0), **out)

    return formatted.mapInArrow(
        work, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


PROBE = r"\### Assistant: </turn> ok"


def op9_chat(spark, folder: str) -> DataFrame:
    rows = spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame([(-7, 0, "user", PROBE), (-7, 1, "assistant", PROBE)], rows.schema)
    return digests(format_chats(rows.unionByName(probe)))


ORACLE = rf"""
with rows as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '{PROBE}' union all select -7, 1, 'assistant', '{PROBE}'),
sized as (select *, length(role) + length(text) + {len(TURN + BODY + END) + 1} +
  len(regexp_extract_all(role, '<\\*(turn>|text>|/turn>)')) + len(regexp_extract_all(text, '<\\*(turn>|text>|/turn>)')) as n from rows)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
  cast(coalesce(sum(length(text)) filter (where role = 'assistant'), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
  cast(sum(n) as bigint) as formatted_chars
from sized group by conv_id"""
