"""Quality rules whose cutoffs are certified on labelled documents (operator 1).

Each rule rejects documents whose metric lies above a cutoff.  Per stratum
(language), a cutoff of a fixed grid is certified if the exact binomial tail
shows, at a Bonferroni-corrected level, that it rejects at most the allowed
share of good documents.  The strictest certified cutoff is used; a rule
without one rejects nothing in that stratum.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

SYMBOLS = C.byte_table(b"#*$%&|<>")
FEATURES = "doc_id long, stratum string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
MIN_WORDS = 50

# Metrics in whole thousandths, so that every engine agrees on them.
METRICS = {
    "symbols": "cast(floor(1000 * n_symbols / greatest(word_chars, 1)) as bigint)",
    "dup_lines": "cast(floor(1000 * n_dup_lines / greatest(n_words, 1)) as bigint)",
    "repeats": "cast(floor(1000 * n_repeat_words / greatest(n_words, 1)) as bigint)",
    "word_length": "cast(floor(1000 * word_chars / greatest(n_words, 1)) as bigint)",
}
GRIDS = {
    "symbols": (5, 10, 20, 30, 50, 80, 120, 200, 300),
    "dup_lines": (5, 10, 20, 30, 50, 80, 120, 200),
    "repeats": (20, 50, 100, 150, 200, 250, 300, 400),
    "word_length": (6000, 7000, 8000, 9000, 10000, 12000, 15000),
}


@dataclass(frozen=True)
class Risk:
    """``share``: good documents that all rules together may reject; ``level``: chance that any certificate is wrong."""

    share: float = 0.02
    level: float = 0.05
    grids: dict = field(default_factory=lambda: dict(GRIDS))

    @property
    def share_of_rule(self) -> float:
        return self.share / len(self.grids)

    @property
    def tests_of_stratum(self) -> int:
        return sum(len(g) for g in self.grids.values())


def base_counts(column) -> dict[str, np.ndarray]:
    """The five counts of every text of an Arrow column (NULL: zeros)."""
    out = {name: np.zeros(len(column), np.int64) for name in COUNTS}
    for a, b, data, offsets in C.chunked(column):
        n = b - a
        space = C.SPACE[data]
        starts, ends, rows = C.pieces(~space, offsets)
        sums = C.prefix_sums(data)
        out["n_words"][a:b] = np.bincount(rows, minlength=n)
        out["word_chars"][a:b] = C.counts_between(~space & ((data & 0xC0) != 0x80), offsets)
        out["n_symbols"][a:b] = C.counts_between(SYMBOLS[data], offsets)
        out["n_dup_lines"][a:b] = _dup_lines(data, offsets, starts, sums, n)
        out["n_repeat_words"][a:b] = _repeat_words(C.substring_hashes(sums, starts, ends), rows, n)
    return out


def _within_rows(keys: np.ndarray, rows: np.ndarray) -> np.ndarray:
    return C.mix(keys ^ C.mix(rows.astype(np.uint64) + np.uint64(1)))


def _dup_lines(data, offsets, word_starts, sums, n) -> np.ndarray:
    breaks = np.flatnonzero(data == 10)
    starts = np.sort(np.concatenate([offsets[:-1], breaks + 1]))
    ends = np.sort(np.concatenate([breaks, offsets[1:]]))
    rows = np.repeat(np.arange(n), 1 + C.counts_between(data == 10, offsets))
    worded = np.searchsorted(word_starts, ends) > np.searchsorted(word_starts, starts)
    keys = _within_rows(C.substring_hashes(sums, starts[worded], ends[worded]), rows[worded])
    _, first = np.unique(keys, return_index=True)
    again = np.ones(len(keys), bool)
    again[first] = False
    return np.bincount(rows[worded][again], minlength=n)


def _repeat_words(words: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    keys, at = C.triples(words, rows)
    if not len(keys):
        return np.zeros(n, np.int64)
    keys = _within_rows(keys, rows[at])
    order = np.argsort(keys)
    same = keys[order[1:]] == keys[order[:-1]]
    found = np.zeros(len(keys), bool)
    found[order[1:][same]] = True
    found[order[:-1][same]] = True
    covered = np.zeros(len(words), bool)
    for shift in range(3):
        covered[at[found] + shift] = True
    return np.bincount(rows[covered], minlength=n)


def features(docs: DataFrame, stratum: str = "lang") -> DataFrame:
    """doc_id, stratum ('' for NULL) and the five counts of every document."""

    def work(batches):
        for batch in batches:
            counts = {k: pa.array(v) for k, v in base_counts(batch.column(2)).items()}
            yield C.columns_batch(doc_id=batch.column(0), stratum=batch.column(1), **counts)

    rows = docs.select("doc_id", F.coalesce(F.col(stratum), F.lit("")).alias("stratum"), "text")
    return rows.mapInArrow(work, FEATURES)


def with_base(rows: DataFrame) -> DataFrame:
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return rows.withColumn("base_failed", failed)


def at_most(k: int, n: int, p: float) -> float:
    """Chance of ``k`` hits or fewer in ``n`` draws at rate ``p`` (exact binomial tail)."""
    if k >= n:
        return 1.0
    above = k + 1 > n * p  # the shorter tail: its terms fall from the start, so few count even where k is in the millions
    i = k + 1 if above else k
    term = math.exp(
        math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p))
    total = 0.0
    while 0 <= i <= n and term > total * 1e-18:
        total += term
        term *= (n - i) / (i + 1) * p / (1 - p) if above else i / (n - i + 1) * (1 - p) / p
        i += 1 if above else -1
    return max(0.0, min(1.0, 1.0 - total if above else total))


def certified(measured: DataFrame, risk: Risk = Risk()) -> DataFrame:
    """Per stratum and rule the strictest certified cutoff (NULL: none).

    ``measured`` has stratum, the metrics, and one row per good labelled
    document.  The correction counts the tests of all strata that occur.
    """
    sums = [F.count(F.lit(1)).alias("n")]
    for rule, grid in risk.grids.items():
        sums.append(F.array(*[F.sum((F.col(rule) > F.lit(c)).cast("bigint")) for c in grid]).alias(f"k_{rule}"))
    counted = C.staged(measured.groupBy("stratum").agg(*sums))
    grids, share = dict(risk.grids), risk.share_of_rule
    bound = risk.level / (risk.tests_of_stratum * max(1, counted.count()))

    def choose(batches):
        for batch in batches:
            out = {"stratum": batch.column("stratum").to_pylist()} | {f"cut_{r}": [] for r in grids}
            for row in batch.to_pylist():
                for rule, grid in grids.items():
                    good = [c for c, k in zip(grid, row[f"k_{rule}"]) if at_most(k, row["n"], share) <= bound]
                    out[f"cut_{rule}"].append(min(good) if good else None)
            yield pa.RecordBatch.from_pydict(
                out, schema=pa.schema([("stratum", pa.string())] + [(f"cut_{r}", pa.int64()) for r in grids])
            )

    return counted.mapInArrow(choose, "stratum string, " + ", ".join(f"cut_{r} long" for r in grids))


def judge(docs: DataFrame, labels: DataFrame, stratum: str = "lang", risk: Risk = Risk()) -> DataFrame:
    """Counts, ``base_failed`` and ``kept`` of every document.

    ``labels`` (doc_id, quality): a document labelled more than once counts as
    good only if every label says so; NULL labels are ignored.  Repeated
    documents are judged alike, one row each; a NULL text has no words and
    fails.  Without labels nothing is certified and only the base rule rejects.
    """
    rows = with_base(C.staged(features(docs, stratum))).withColumns({m: F.expr(e) for m, e in METRICS.items()})
    good = labels.filter("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("q"))
    once = rows.filter(~F.col("base_failed")).dropDuplicates(["doc_id"])
    cuts = certified(once.join(good.filter("q = 1"), "doc_id", "left_semi"), risk)
    passed = F.lit(True)
    for rule in risk.grids:
        passed = passed & (F.col(rule) <= F.coalesce(F.col(f"cut_{rule}"), F.col(rule)))
    joined = rows.join(cuts, "stratum", "left")
    return joined.select(
        "doc_id", *COUNTS, "base_failed", (~F.col("base_failed") & passed).alias("kept"), "stratum", *METRICS
    )


def op1_quality(spark, folder: str) -> DataFrame:
    read = spark.read.parquet
    out = judge(read(f"{folder}/documents.parquet"), read(f"{folder}/labels.parquet"))
    return out.select("doc_id", *COUNTS, "base_failed", "kept")


def _sql() -> str:
    risk = Risk()
    rules = []
    for rule, grid in risk.grids.items():
        for c in grid:
            rules.append(f"select stratum, '{rule}' as rule, {c} as cut, count(*) as n, "
                         f"count(*) filter (where {rule} > {c}) as k from good group by stratum")
    tail = ("list_sum(list_transform(range(0, cast(k as bigint) + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - "
            f"lgamma(n - i + 1) + i * ln({risk.share_of_rule!r}) + (n - i) * ln(1 - {risk.share_of_rule!r}))))")
    cuts = ", ".join(f"min(cut) filter (where rule = '{r}') as cut_{r}" for r in risk.grids)
    metrics = ", ".join(f"{e} as {m}" for m, e in METRICS.items())
    passed = " and ".join(f"{r} <= coalesce(cut_{r}, {r})" for r in risk.grids)
    return rf"""
with docs as (select doc_id, coalesce(lang, '') as stratum, coalesce(text, '') as text from documents),
words as (
  select doc_id, w, generate_subscripts(w, 1) as i from
  (select doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as w from docs)),
grams as (select doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] as g from words where i + 2 <= len(w)),
found as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, g) as c from grams) where c > 1),
covered as (select doc_id, count(distinct j) as n from
  (select doc_id, unnest([i, i + 1, i + 2]) as j from found) group by doc_id),
lines as (select doc_id, unnest(string_split(text, chr(10))) as line from docs),
dups as (select doc_id, sum(c - 1) as n from (select doc_id, line, count(*) as c from lines
  where regexp_matches(line, '[^\x20\x09-\x0D]') group by doc_id, line) group by doc_id),
base as (
  select doc_id, stratum, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) as n_words,
    length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) as word_chars,
    length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) as n_symbols,
    cast(coalesce(dups.n, 0) as bigint) as n_dup_lines, cast(coalesce(covered.n, 0) as bigint) as n_repeat_words
  from docs left join dups using (doc_id) left join covered using (doc_id)),
judged as (select *, (n_words < 50 or 100 * n_repeat_words > 50 * n_words) as base_failed, {metrics} from base),
marks as (select doc_id, min(quality) as q from labels where quality is not null group by doc_id),
good as (select judged.* from judged join marks using (doc_id) where q = 1 and not base_failed),
tests as ({' union all '.join(rules)}),
strata as (select count(distinct stratum) as n_strata from good),
cuts as (select stratum, {cuts} from tests, strata
  where {tail} <= {risk.level!r} / ({risk.tests_of_stratum} * n_strata) group by stratum)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  (not base_failed and {passed}) as kept
from judged left join cuts using (stratum)"""


ORACLE = _sql()
