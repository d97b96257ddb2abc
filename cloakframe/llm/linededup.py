"""Line deduplication with levelled sorted runs of line hashes (operator 6, native).

Documents arrive in batches of ascending ids.  A run is a Parquet table of
(hash, owner) sorted by hash.  A new batch takes its distinct line keys with
their smallest document, merge-anti-joins every run, and writes what is left
as a run of level 0.  When a level holds ``FAN`` runs they are merged into one
of the next level, so a batch meets a logarithmic number of runs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

BATCHES = 4
FAN = 3
MIN_CHARS = 10
SPACES = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
HASH = ["h1", "h2"]  # 128 bits


def lines(docs: DataFrame) -> DataFrame:
    """doc_id, position and key hash of every line whose key has at least ten code points."""
    exploded = docs.select("doc_id", F.posexplode(F.split(F.coalesce(F.col("text"), F.lit("")), "\n", -1)).alias("pos", "line"))
    key = F.translate(F.btrim("line", F.lit(SPACES)), UPPER, LOWER)
    keyed = exploded.select("doc_id", "pos", key.alias("key")).filter(F.char_length("key") >= MIN_CHARS)
    return keyed.select("doc_id", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("second"), "key").alias("h2"))


class LineRuns:
    """The sorted runs of all batches so far, by level."""

    def __init__(self, fan: int = FAN):
        self.fan, self.levels = fan, [[]]

    def all(self) -> list[DataFrame]:
        return [run for level in self.levels for run in level]

    def _write(self, rows: DataFrame) -> DataFrame:
        return C.staged(rows.repartition(C.partitions(rows.sparkSession), *HASH).sortWithinPartitions(*HASH))

    def compact(self) -> None:
        for level, found in enumerate(self.levels):
            if len(found) >= self.fan:
                merged = found[0]
                for run in found[1:]:
                    merged = merged.unionByName(run)
                if level + 1 == len(self.levels):
                    self.levels.append([])
                self.levels[level + 1].append(self._write(merged))
                found.clear()

    def add(self, batch: DataFrame) -> DataFrame:
        """Add a batch; returns (doc_id, pos) of its lines that another document owns.

        The owner of a key is the document of the earliest batch that has it,
        there the smallest id.  NULL ids come before all others.
        """
        self.compact()
        rows = lines(batch)
        keys = C.staged(rows.groupBy(*HASH).agg(F.min(_order()).alias("owner"), F.max(_order()).alias("other")))
        fresh, known = keys, None
        for run in self.all():
            old = run.select(*HASH)
            met = keys.join(old.hint("merge"), HASH, "left_semi").select(*HASH, F.lit(None).cast(_TYPE).alias("owner"))
            known = met if known is None else known.unionByName(met)
            fresh = fresh.join(old.hint("merge"), HASH, "left_anti")
        fresh = self._write(fresh)
        self.levels[0].append(fresh.drop("other"))
        shared = fresh.filter(F.col("owner") != F.col("other")).select(*HASH, "owner")
        if known is not None:
            shared = shared.unionByName(known)
        lost = rows.join(shared.hint("merge"), HASH)
        return lost.filter(F.col("owner").isNull() | (_order() != F.col("owner"))).select("doc_id", "pos")


_TYPE = "struct<known:boolean,id:bigint>"


def _order():
    return F.struct(F.col("doc_id").isNotNull().alias("known"), F.col("doc_id").alias("id"))


def batches(docs: DataFrame, n: int) -> list[DataFrame]:
    """The documents cut at ``n`` quantiles of their ids; NULL ids come first."""
    cuts = docs.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 1000)).first()[0] if n > 1 else []
    cuts = sorted(set(cuts or []))
    if not cuts:
        return [docs]
    ident = F.col("doc_id")
    parts = [docs.filter(ident.isNull() | (ident <= cuts[0]))]
    parts += [docs.filter((ident > a) & (ident <= b)) for a, b in zip(cuts, cuts[1:])]
    return [*parts, docs.filter(ident > cuts[-1])]


def dedup_lines(docs: DataFrame, n_batches: int = BATCHES, fan: int = FAN) -> DataFrame:
    """All documents with ``kept_text``, ``n_lines`` and ``n_dropped``.

    A NULL or empty text is one empty line.  Rows that share a doc_id are one
    document for ownership: lines are dropped from each alike.
    """
    kept, total, gone, cut = (C.free(docs, n) for n in ("kept_text", "n_lines", "n_dropped", "cut_at"))
    found, state = None, LineRuns(fan)
    for batch in batches(docs.select("doc_id", "text"), n_batches):
        lost = C.staged(state.add(batch))
        found = lost if found is None else found.unionByName(lost)
    ident = C.free(docs, "cut_id")
    cuts = found.groupBy(F.col("doc_id").alias(ident)).agg(F.array_sort(F.collect_set("pos")).alias(cut))
    joined = docs.join(cuts, F.col("doc_id").eqNullSafe(F.col(ident)), "left").drop(ident)
    parts = C.free(docs, "line_parts")
    split = joined.withColumn(parts, F.split(F.coalesce(F.col("text"), F.lit("")), "\n", -1))
    size = F.size(F.col(parts))

    def between(i):
        """The lines after the cut before position i, up to the cut there: linear over all i."""
        low = F.when(i > 0, F.get(F.col(cut), i - 1) + 1).otherwise(0)
        high = F.coalesce(F.get(F.col(cut), i), size)
        return F.slice(F.col(parts), low + 1, high - low)

    pieces = F.transform(F.sequence(F.lit(0), F.size(F.col(cut))), between)
    left = F.when(F.col(cut).isNull(), F.col(parts)).otherwise(F.flatten(pieces))
    out = split.withColumns({
        kept: F.array_join(left, "\n"), total: size.cast("bigint"), gone: F.coalesce(F.size(F.col(cut)), F.lit(0)).cast("bigint"),
    })
    return out.drop(parts, cut)


def op6_linededup(spark, folder: str) -> DataFrame:
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    digest = F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", digest)


ORACLE = r"""
with lines as (select doc_id, unnest(l) as line, generate_subscripts(l, 1) as pos from
  (select doc_id, string_split(coalesce(text, ''), chr(10)) as l from documents)),
keyed as (select *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from lines),
owners as (select key, min(doc_id) as owner from keyed where length(key) >= 10 group by key),
marked as (select doc_id, pos, line, owner is not null and owner <> doc_id as gone from keyed left join owners using (key))
select doc_id, count(*) as n_lines, count(*) filter (where gone) as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where not gone), '')) as kept_sha256
from marked group by doc_id"""
