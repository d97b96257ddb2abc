"""Detection: text column in, one array of spans per row out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import catalog
from ..catalog import Rule, scan_regex, select_rules, spark_regex
from ..functions.arrays import built_once, exploded, places, text_slice
from ..functions.checks import CHECKS
from ..session import small_batches
from . import spans as S
from .scan import MATCH, finder, scanner, span_maker

RULE_SOURCE = "RULE"
MODEL_SOURCE = "AI_MODEL"

BATCH_BYTES = 2 << 20  # of texts that travel together
_MARK = "\x01"  # texts that hold it anyway are searched without it
# Plain character runs tested once per text; a rule whose run is absent is not tried.
_GATES = {
    "d1": "[0-9]",
    "d4": "[0-9]{4}",
    "d6": "[0-9]{6}",
    "d8": "[0-9]{8}",
    "run17": "(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{17}",
}


def _quote(text: str) -> str:
    """SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _quoted_array(values) -> str:
    return f"cast(array({', '.join(_quote(v) for v in values)}) as array<string>)"


def _with_gates(df: DataFrame, text: str) -> DataFrame:
    """Facts about a text that many rules need, computed once per row.

    They stay separate columns: a struct would be taken apart again and every
    rule would repeat the work.
    """
    runs = {f"_{name}": F.rlike(F.col(text), F.lit(run)) for name, run in _GATES.items()}
    return df.withColumns({"_low": F.lower(F.col(text)), **runs})


def _tests(rule: Rule) -> list[str]:
    """Cheap tests without which a text is not searched."""
    tests = [f"_d{rule.digits}"] if rule.digits else []
    if rule.gate:
        tests.append(f"_{rule.gate}")
    if rule.hints:
        tests.append("(" + " or ".join(f"contains(_low, {_quote(h)})" for h in rule.hints) + ")")
    return tests


def _hit_sql(rule: Rule, index: int, text: str) -> str:
    """The rule's matches and the texts between them, or NULL; cheap tests come first."""
    pattern = _quote(spark_regex(rule))
    tests = [*_tests(rule), f"rlike(`{text}`, {pattern})"]
    return (
        f"case when {' and '.join(tests)} then named_struct('rule', {index}, "
        f"'hit', regexp_extract_all(`{text}`, {pattern}, 0), 'gap', split(`{text}`, {pattern}, -1)) end"
    )


def _marked_sql(rule: Rule, index: int, text: str) -> str:
    """The same from one search: matches are put between marks, and the text is cut at these."""
    pattern = scan_regex(rule)
    if pattern is None:
        return _hit_sql(rule, index, text)
    # Behind the last match the rest of the text is passed over, with an empty one at its end.
    marked = f"split(regexp_replace(`{text}`, {_quote(pattern)}, '$1{_MARK}$2{_MARK}'), '{_MARK}', -1)"
    cut = (
        f"transform(array({marked}), p -> case when p[1] <> '' then named_struct('rule', {index}, "
        "'hit', filter(p, (x, i) -> i % 2 = 1 and x <> ''), 'gap', filter(p, (x, i) -> i % 2 = 0)) end)[0]"
    )
    return f"case when {' and '.join([*_tests(rule), f'`{text}` is not null'])} then {cut} end"


def _places(hit: Column) -> Column:
    """Offsets of one rule's matches from the texts between them."""
    placed = places(hit["hit"], hit["gap"])
    return F.transform(
        placed,
        lambda p: F.struct(
            p["start"].alias("start"), p["end"].alias("end"), p["hit"].alias("hit"), hit["rule"].alias("rule")
        ),
    )


def _checked(matches: Column, rules: list[Rule]) -> Column:
    """Matches whose check digits hold; rules without a check pass."""
    kinds = {}
    for i, rule in enumerate(rules):
        if rule.check:
            kinds.setdefault(rule.check, []).append(i)
    if not kinds:
        return matches

    def keep(m: Column) -> Column:
        test = None
        for kind, indexes in kinds.items():
            here = m["rule"].isin(*indexes)
            test = F.when(here, CHECKS[kind](m["hit"])) if test is None else test.when(here, CHECKS[kind](m["hit"]))
        return test.otherwise(F.lit(True))

    return F.filter(matches, keep)


def with_matches(df: DataFrame, text: str = "text", rules: list[Rule] | None = None, out: str = "matches") -> DataFrame:
    """Every match of every rule, as ``array<struct<start,end,hit,rule>>`` (``rule`` indexes the list)."""
    rules = select_rules(rules=rules)
    if not rules:
        return df.withColumn(out, F.array().cast(MATCH))
    small_batches(df.sparkSession, BATCH_BYTES)
    scan, others = built_once(("scanner", tuple(rules)), lambda: scanner(rules))
    if not others:
        scanned = df.withColumn("_found", scan(F.col(text)))
        return scanned.withColumn(out, built_once(("checked", tuple(rules)), lambda: _checked(F.col("_found"), rules))).drop("_found")
    marked, plain = (", ".join(sql(rules[i], i, text) for i in others) for sql in (_marked_sql, _hit_sql))
    hits = f"case when contains(`{text}`, '{_MARK}') then array({plain}) else array({marked}) end"
    found = _with_gates(df, text).withColumn("_hits", F.expr(f"filter({hits}, h -> h is not null)"))
    found = found.withColumn("_found", scan(F.col(text)) if scan else F.array().cast(MATCH))
    matches = built_once(
        ("matches", tuple(rules)),
        lambda: _checked(F.concat(F.col("_found"), F.flatten(F.transform(F.col("_hits"), _places))), rules),
    )
    return found.withColumn(out, matches).drop("_low", "_hits", "_found", *[f"_{name}" for name in _GATES])


def words_of(rule: Rule) -> tuple[str, ...]:
    """Context words of a rule: its own, else those of its entity."""
    return tuple(w.lower() for w in (rule.context or catalog.CONTEXT_WORDS.get(rule.entity, ())))


def with_rule_spans(
    df: DataFrame,
    text: str = "text",
    rules: list[Rule] | None = None,
    entities=None,
    trim: str = "labelled",
    resolve: bool = True,
    context_words: int = 5,
    context_boost: float = 0.35,
    context_floor: float = 0.4,
    out: str = "spans",
) -> DataFrame:
    """Add the rule spans of each text.

    ``trim``: ``labelled`` trims keyword prefixes only where the pattern has a
    keyword, ``compat`` trims every span of the six prefix labels, ``off`` none.
    """
    if trim not in ("labelled", "compat", "off"):
        raise ValueError(f"trim must be labelled, compat or off, got {trim!r}")
    rules = select_rules(entities, rules)
    if not rules:
        return df.withColumn(out, S.no_spans())
    options = (tuple(rules), tuple(words_of(r) for r in rules), context_words, context_boost, context_floor, resolve, trim)
    prefixes = catalog.KEYWORD_PREFIX_LABELS if resolve and trim != "off" else None
    made = built_once(
        ("spans", *options),
        lambda: span_maker(
            rules, [words_of(r) for r in rules], RULE_SOURCE, context_words, context_boost, context_floor, resolve,
            prefixes, trim == "labelled",
        ),
    )
    small_batches(df.sparkSession, BATCH_BYTES)
    find = built_once(("finder", tuple(rules)), lambda: finder(rules))
    matched = df.withColumn("_matches", find(F.col(text))) if find else with_matches(df, text, rules, "_matches")
    return matched.withColumn(out, made(F.col(text), F.col("_matches"))).drop("_matches")


def check_threshold(threshold: float) -> float:
    if not 0.0 <= threshold <= 1.0:
        raise ValueError(f"threshold must be between 0 and 1, got {threshold}")
    return threshold


def valid_threshold(threshold: Column) -> Column:
    """Whether a threshold lies from 0 to 1; NULL and NaN do not."""
    return F.coalesce((threshold >= 0.0) & (threshold <= 1.0), F.lit(False))


def with_model_spans(
    df: DataFrame, pieces: str, rules: str | None = None, threshold: float = catalog.MODEL_THRESHOLD, out: str = "spans"
) -> DataFrame:
    """Add model spans to rule spans: join pieces, drop weak ones, drop what rules already cover."""
    check_threshold(threshold)
    joined = df.withColumn("_joined", S.join_pieces(F.col(pieces)))
    strong = F.filter(F.col("_joined"), lambda m: m["score"] >= F.lit(threshold))
    if rules is None:
        return joined.withColumn(out, strong).drop("_joined")
    free = joined.withColumn("_free", S.not_covered(strong, F.col(rules)))
    together = F.sort_array(F.concat(F.col(rules), F.col("_free")))
    return free.withColumn(out, together).drop("_joined", "_free")


def spans_as_rows(df: DataFrame, keys: list[str], text: str = "text", spans: str = "spans") -> DataFrame:
    """One row per span with its text."""
    rows = exploded(df, [*keys, text], spans, "s", "ordinal")
    return rows.select(
        *keys, "ordinal", F.col("s.start").alias("start"), F.col("s.end").alias("end"),
        F.col("s.label").alias("label"), text_slice(F.col(text), F.col("s.start"), F.col("s.end")).alias("text"),
        F.col("s.source").alias("source"), F.col("s.score").alias("score"),
    )


def report(span_rows: DataFrame) -> DataFrame:
    """Spans per label and source with count, mean and best score."""
    return span_rows.groupBy("label", "source").agg(
        F.count(F.lit(1)).alias("n"),
        F.format_string("%.4f", F.avg("score")).alias("mean_score"),
        F.format_string("%.4f", F.max("score")).alias("best_score"),
    )
