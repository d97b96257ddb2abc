"""Chat examples from tokenized records, rendering and masking.

A document's examples are built inside its own row; nothing is shuffled until
the global split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import catalog as C
from ..functions.arrays import exploded, last, let, lines, replace_last, strip
from ..functions.choice import choose_filled, hash_number, pick_index
from ..functions.text import record_title, tokens
from .skew import running_totals

MESSAGES = "array<struct<role:string,content:string>>"
SECTIONS = "array<struct<name:string,lines:array<string>>>"
KINDS = ("generation", "lookup", "summary", "section", "turns")
_PAIR = r"([A-Za-z ]+):\s*(" + C.TOKEN_REGEX.replace("(", "(?:") + ")"


def field_pairs(text: Column) -> Column:
    """``field: token`` pairs in order, as ``array<struct<field,token>>``."""
    names = F.transform(
        F.regexp_extract_all(text, F.lit(_PAIR), F.lit(1)),
        lambda f: F.regexp_replace(strip(f), r"^[- ]+|[- ]+$", ""),
    )
    pairs = F.arrays_zip(names.alias("field"), F.regexp_extract_all(text, F.lit(_PAIR), F.lit(2)).alias("token"))
    return F.filter(pairs, lambda p: (F.length(p["field"]) > 0) & (F.length(p["token"]) > 0))


def sections(text: Column) -> Column:
    """Named line groups in order of first appearance.

    A short line ending in a colon (not a bullet) opens a section, and opens it
    anew when seen again; lines before any header belong to ``header``.
    """

    def parsed(body: Column) -> Column:
        """Names of the lines (NULL: no header) beside the lines."""

        def name_of(line: Column) -> Column:
            def test(bare: Column) -> Column:
                is_header = F.endswith(bare, F.lit(":")) & ~F.startswith(bare, F.lit("-")) & (F.length(bare) < 40)
                return F.when(is_header, F.regexp_replace(bare, ":+$", ""))

            return let(strip(line), test)

        return F.struct(body.alias("lines"), F.transform(body, name_of).alias("names"))

    def grouped(b: Column) -> Column:
        """Runs of lines, each under the header before it."""
        heads = F.filter(F.transform(b["names"], lambda n, i: F.when(n.isNotNull(), i)), lambda i: i.isNotNull())
        edges = F.when(F.coalesce(F.get(heads, F.lit(0)), F.lit(-1)) == 0, heads).otherwise(F.concat(F.array(F.lit(-1)), heads))

        def one(at: Column, j: Column, e: Column) -> Column:
            end = F.coalesce(F.get(e, j + 1), F.size(b["lines"]))
            name = F.when(at < 0, F.lit("header")).otherwise(F.get(b["names"], F.greatest(at, F.lit(0))))
            return F.struct(name.alias("name"), F.slice(b["lines"], at + 2, end - at - 1).alias("lines"))

        return let(edges, lambda e: F.transform(e, lambda at, j: one(at, j, e)))

    def last_of_name(groups: Column) -> Column:
        """The last run of each name, at the place of the first one."""
        named = F.sort_array(F.transform(groups, lambda g, i: F.struct(g["name"].alias("name"), i.alias("i"))))

        def picked(n: Column) -> Column:
            firsts = F.filter(n, lambda x, j: (j == 0) | (x["name"] != F.get(n, j - 1)["name"]))
            lasts = F.filter(n, lambda x, j: (j == F.size(n) - 1) | (x["name"] != F.get(n, j + 1)["name"]))
            places = F.zip_with(firsts, lasts, lambda a, z: F.struct(a["i"].alias("first"), z["i"].alias("last")))
            return F.transform(F.sort_array(places), lambda p: F.get(groups, p["last"]))

        return let(named, picked)

    made = let(let(let(lines(text), parsed), grouped), last_of_name)
    return F.when(F.size(lines(text)) == 0, F.array().cast(SECTIONS)).otherwise(made.cast(SECTIONS))


def _message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def _talk(*turns: tuple[str, Column]) -> Column:
    return F.array(_message("system", F.lit(C.CHAT_SYSTEM)), *[_message(r, c) for r, c in turns]).cast(MESSAGES)


class _Doc:
    """Columns of one document, bound once, that examples are made of."""

    def __init__(self, bound: Column, seed):
        self.id, self.doc, self.type = bound["id"], bound["doc"], bound["type"]
        self.pairs, self.tokens, self.sections = bound["pairs"], bound["tokens"], bound["sections"]
        self.seed = seed

    def pick(self, n, slot: Column, purpose: str) -> Column:
        return pick_index(n, self.seed, self.id, slot, purpose)

    def text(self, name: str, slot: Column, **values: Column) -> Column:
        options = C.CHAT_TEXTS[name]
        known = {"type": self.type, "doc": self.doc, **values}
        return choose_filled(options, self.pick(len(options), slot, name), known)

    def generation(self, slot: Column) -> Column:
        return _talk(("user", self.text("generation.ask", slot)), ("assistant", self.doc))

    def lookup(self, slot: Column) -> Column:
        def build(p: Column) -> Column:
            ask = self.text("lookup.ask", slot, field=p["field"])
            answer = self.text("lookup.answer", slot, field=p["field"], token=p["token"])
            return F.when(p.isNotNull(), _talk(("user", ask), ("assistant", answer)))

        return let(F.get(self.pairs, self.pick(F.size(self.pairs), slot, "pair")), build)

    def summary(self, slot: Column) -> Column:
        refs = F.array_join(F.transform(F.slice(self.tokens, 1, 3), lambda t: F.concat(F.lit("`"), t, F.lit("`"))), ", ")
        first = F.get(self.tokens, F.lit(0))
        second = F.coalesce(F.get(self.tokens, F.lit(1)), first)
        answer = F.when(
            F.size(self.tokens) > 0, self.text("summary.answer", slot, first=first, second=second, refs=refs)
        ).otherwise(self.text("summary.plain", slot))
        return _talk(("user", self.text("summary.ask", slot)), ("assistant", answer))

    def section(self, slot: Column) -> Column:
        named = F.filter(self.sections, lambda s: s["name"] != "header")

        def build(s: Column) -> Column:
            filled = F.filter(s["lines"], lambda line: F.length(strip(line)) > 0)
            bullets = F.array_join(
                F.transform(filled, lambda line: F.concat(F.lit("- "), F.regexp_replace(strip(line), r"^[- ]+", ""))), "\n"
            )
            ask = self.text("section.ask", slot, section=s["name"])
            answer = self.text("section.answer", slot, section=s["name"], bullets=bullets)
            usable = s.isNotNull() & (F.size(self.sections) >= 2) & (F.size(filled) > 0)
            return F.when(usable, _talk(("user", ask), ("assistant", answer)))

        return let(named, lambda n: let(F.get(n, self.pick(F.size(n), slot, "section")), build))

    def turns(self, slot: Column) -> Column:
        def with_first(p: Column) -> Column:
            def with_second(q: Column) -> Column:
                talk = _talk(
                    ("user", self.text("turns.ask", slot)),
                    ("assistant", self.text("turns.acknowledge", slot, field=p["field"], token=p["token"])),
                    ("user", self.text("turns.follow", slot, field2=q["field"])),
                    ("assistant", self.text("turns.answer", slot, field2=q["field"], token2=q["token"])),
                )
                return F.when(p.isNotNull() & q.isNotNull(), talk)

            others = F.filter(self.pairs, lambda x: x["token"] != p["token"])
            return let(others, lambda o: let(F.get(o, self.pick(F.size(o), slot, "second")), with_second))

        return let(F.get(self.pairs, self.pick(F.size(self.pairs), slot, "first")), with_first)


def with_record_parts(df: DataFrame, doc_id: str, text: str, file_name: str) -> DataFrame:
    doc = strip(F.col(text))
    return df.select(
        F.col(doc_id), F.col(text), F.col(file_name),
        F.struct(
            F.col(doc_id).cast("string").alias("id"), doc.alias("doc"), record_title(F.col(file_name)).alias("type"),
            field_pairs(F.col(text)).alias("pairs"), tokens(F.col(text)).alias("tokens"),
            sections(F.col(text)).alias("sections"),
        ).alias("_doc"),
    )


def examples_of_kind(df: DataFrame, kind: str, doc_id: str, text: str = "text", file_name: str = "file_name", seed=42) -> DataFrame:
    """One example of one kind per document that can give it."""
    parts = with_record_parts(df, doc_id, text, file_name)
    made = let(F.col("_doc"), lambda b: getattr(_Doc(b, seed), kind)(F.lit("only")))
    return exploded(parts, [doc_id], F.array(made), "messages")


def chat_examples(
    df: DataFrame, doc_id: str, text: str = "text", file_name: str = "file_name", per_doc: int = 6, seed=42
) -> DataFrame:
    """Up to ``per_doc`` examples per document: one generation example, then a shuffled pool of all kinds."""
    parts = with_record_parts(df, doc_id, text, file_name)
    pool = F.array(*[
        F.struct(
            hash_number(seed, F.col(doc_id), f"slot{i}").alias("rank"), F.lit(i).alias("slot"),
            F.lit(i % len(KINDS)).alias("kind"),
        )
        for i in range(3 * len(KINDS))
    ])

    def build(b: Column) -> Column:
        doc = _Doc(b["d"], seed)

        def one(s: Column) -> Column:
            out = None
            for i, kind in enumerate(KINDS):
                value = getattr(doc, kind)(s["slot"].cast("string"))
                out = F.when(s["kind"] == i, value) if out is None else out.when(s["kind"] == i, value)
            return F.struct(F.get(_kind_names(), s["kind"]).alias("kind"), out.alias("messages"))

        first = F.struct(F.lit("generation").alias("kind"), doc.generation(F.lit("first")).alias("messages"))
        usable = F.filter(F.transform(F.sort_array(b["p"]), one), lambda e: e["messages"].isNotNull())
        return F.concat(F.array(first), F.slice(usable, 1, per_doc - 1)) if per_doc > 1 else F.array(first)

    bound = F.struct(F.col("_doc").alias("d"), pool.alias("p"))
    rows = exploded(parts.withColumn("_examples", let(bound, build)), [doc_id], "_examples", "e", "example_no")
    return rows.select(
        doc_id, "example_no", F.col("e.kind").alias("kind"), F.col("e.messages").alias("messages")
    )


def _kind_names() -> Column:
    return F.expr("array(" + ", ".join(f"'{k}'" for k in KINDS) + ")")


def exact_split(df: DataFrame, keys: list[str], train_share: float = 0.9, seed=42) -> DataFrame:
    """Shuffle by hash and mark exactly ``max(1, int(n * share))`` rows as train.

    Rows are counted in 4096 hash ranges; the cut lies in one of them.  The rows
    of that range are counted again by the next three digits, and only the rows
    of the one finer range with the cut (a 16-millionth of all) are ordered to
    find the last train code.  Every row is then compared with that one code:
    no sort of everything, no single-task window, and no join of the rows.
    The keys must tell rows apart: rows with equal keys fall on one side.  The key
    columns are read four times.
    """
    code = F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]).cast("binary"))
    coded = df.select(code.alias("_code"), F.struct(*[F.col(k) for k in keys]).alias("_keys"))

    def cut_range(rows: DataFrame, digits: int, rank: Column | None) -> DataFrame:
        """The range of codes holding the row of that rank, and the rank inside it."""
        counts = rows.groupBy(F.substring("_code", 1, digits).alias("_range")).agg(F.count(F.lit(1)).alias("_n"), F.max("_rank").alias("_rank"))
        before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # at most 4096 rows
        placed = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        if rank is not None:
            placed = placed.withColumn("_total", F.sum("_n").over(Window.partitionBy())).withColumn("_rank", rank)
        inside = (F.col("_before") < F.col("_rank")) & (F.col("_before") + F.col("_n") >= F.col("_rank"))
        return placed.filter(inside).select("_range", (F.col("_rank") - F.col("_before")).alias("_rank"))

    first = cut_range(coded.withColumn("_rank", F.lit(None).cast("long")), 3, F.greatest(F.lit(1), F.floor(F.col("_total") * F.lit(train_share))))
    near = coded.join(F.broadcast(first), F.substring("_code", 1, 3) == F.col("_range")).drop("_range")
    second = cut_range(near, 6, None)
    last = coded.join(F.broadcast(second), F.substring("_code", 1, 6) == F.col("_range"))
    ranked = last.withColumn("_no", F.row_number().over(Window.partitionBy("_range").orderBy("_code", "_keys")))
    cut = ranked.filter(F.col("_no") == F.col("_rank")).agg(F.max(F.struct("_code", "_keys"))).scalar()
    train = F.struct(code.alias("_code"), F.struct(*[F.col(k) for k in keys]).alias("_keys")) <= cut
    return df.withColumn("split", F.when(train, "train").otherwise("val"))


def hash_split(df: DataFrame, keys: list[str], train_share: float = 0.9, seed=42) -> DataFrame:
    """Approximate split by hash threshold, without any shuffle."""
    code = hash_number(seed, *[F.col(k) for k in keys])
    return df.withColumn("split", F.when(code < int(train_share * (1 << 28)), "train").otherwise("val"))


def split_statistics(df: DataFrame) -> DataFrame:
    return df.groupBy("split").agg(F.count(F.lit(1)).alias("n"))


def rendered_turn(role: Column, content: Column) -> Column:
    return F.concat(F.lit(C.TURN_START), role, F.lit("\n"), content, F.lit(C.TURN_END + "\n"))


def render(messages: Column) -> Column:
    """Role-delimited text of one example."""
    return F.array_join(F.transform(messages, lambda m: rendered_turn(m["role"], m["content"])), "")


def answer_spans(messages: Column) -> Column:
    """Character spans of the rendered text that count for the loss: each answer and its end mark."""
    empty = F.struct(F.lit(0).alias("pos"), F.array().alias("out")).cast(
        "struct<pos:int,out:array<struct<start:int,end:int>>>"
    )

    def step(acc: Column, m: Column) -> Column:
        turn = F.length(rendered_turn(m["role"], m["content"]))
        start = acc["pos"] + F.length(F.lit(C.TURN_START)) + F.length(m["role"]) + 1
        span = F.struct(start.alias("start"), (acc["pos"] + turn).alias("end"))
        return F.struct(
            (acc["pos"] + turn).alias("pos"),
            F.when(m["role"] == "assistant", F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"),
        )

    return F.aggregate(messages, empty, step)["out"]


def mask_check(df: DataFrame, messages: str = "messages") -> DataFrame:
    """Loss and total characters over all examples, and how many examples have no loss at all."""
    spans = answer_spans(F.col(messages))
    loss = F.aggregate(spans, F.lit(0), lambda a, s: a + s["end"] - s["start"])
    staged = df.select(loss.cast("long").alias("loss"), F.length(render(F.col(messages))).cast("long").alias("total"))
    return staged.agg(
        F.sum("loss").alias("loss_chars"), F.sum("total").alias("total_chars"),
        F.count_if(F.col("loss") == 0).alias("fully_masked"), F.count(F.lit(1)).alias("examples"),
    ).withColumn("loss_share", F.round(F.col("loss_chars") / F.col("total_chars"), 6))


def require_loss(df: DataFrame, messages: str = "messages") -> DataFrame:
    """The examples unchanged; fails while running on one that has no answer to learn from."""
    good = F.size(answer_spans(F.col(messages))) > 0
    return df.withColumn(
        messages, F.when(good, F.col(messages)).otherwise(F.raise_error(F.lit("all tokens are masked")).cast(MESSAGES))
    )


def cut_words(text: Column, limit: int = 4096) -> Column:
    """At most ``limit`` white-space words, with the text between them kept."""
    return F.regexp_extract(text, r"^(\s*(?:\S+\s+){0," + str(limit - 1) + r"}\S*)", 1)


def rendered_turns(turns: DataFrame, conversation: str, turn: str, role: str = "role", text: str = "text") -> DataFrame:
    """Conversation rows as rendered pieces with their offset in the whole rendered conversation.

    Offsets are two-level running totals over blocks of 1,024 turns, so one
    endless conversation still spreads over many tasks.
    """
    piece = rendered_turn(F.col(role), F.col(text))
    staged = turns.select(conversation, turn, F.col(role).alias("role"), piece.alias("rendered"))
    placed = running_totals(
        staged, [conversation], [F.col(turn)], F.floor(F.col(turn) / 1024), F.length("rendered").cast("long"), "start"
    )
    end = F.col("start") + F.length("rendered")
    answer = F.when(F.col("role") == "assistant", F.col("start") + F.length(F.lit(C.TURN_START)) + F.length("role") + 1)
    return placed.withColumn("end", end).withColumn("loss_start", answer)


def turn_mask_check(placed: DataFrame, conversation: str) -> DataFrame:
    """Per conversation: loss and total characters."""
    loss = F.coalesce(F.col("end") - F.col("loss_start"), F.lit(0))
    return placed.groupBy(conversation).agg(
        F.sum(loss).alias("loss_chars"), F.sum(F.col("end") - F.col("start")).alias("total_chars")
    )
