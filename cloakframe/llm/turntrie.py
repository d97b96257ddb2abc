"""Prefix trie of conversations, rolled up by depth bands (operator 13).

A node is a distinct sequence of first turns; its key xors, over its turns, a
hash of place and content, so that keys of endless conversations are made block
by block.  Totals of subtrees go up in two moves.  Within a band of ``BAND``
depths a node is exploded to its ancestors in that band only.  Band roots form
a trie of their own, ``BAND`` times shallower, which is completed in the same
way; then each completed band root is exploded to its ``BAND`` ancestors in the
band above.  A node so gives at most ``BAND`` + 1 rows a level, and there are
log(depth) levels.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

BAND = 4
BLOCK = 1024  # turns of a conversation that stand in one window; a multiple of BAND
SHARED = 8  # most turns that a conversation takes from its group's first
HOT_PARENTS = 1000  # parents with more than this part of all nodes as children are looked up apart
PIECE = 1 << 16  # characters of joined ids in one row
KEY = ["k1", "k2"]


# --- turns in their places ---------------------------------------------------------------------------------------


def placed_turns(rows: DataFrame) -> DataFrame:
    """conv_id, place (from 1), digest and UTF-8 bytes of every turn.

    Order: turn (NULL first), role, digest of the text.  Places are counted in
    sorted ranges; a conversation that goes on in the next range adds what the
    earlier ranges hold of it, so one endless conversation stays spread out.
    """
    spark, text, role = rows.sparkSession, F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    turns = rows.filter("conv_id is not null").select(
        "conv_id", "turn", role.alias("role"), F.unhex(F.sha2(text, 256)).alias("said"), F.octet_length(text).cast("long").alias("bytes"),
        F.monotonically_increasing_id().alias("row"))
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("said"), F.col("row")]
    ranged = turns.repartitionByRange(C.partitions(spark), *order).sortWithinPartitions(*order)

    def number(batches):
        part, current, count = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            conv = np.asarray(batch.column(0))
            if not len(conv):
                continue
            edge = np.flatnonzero(np.concatenate([[True], conv[1:] != conv[:-1]]))
            begin = np.zeros(len(edge), np.int64)
            if conv[0] == current:
                begin[0] = count
            size = np.diff(np.append(edge, len(conv)))
            local = np.arange(len(conv)) - np.repeat(edge - begin, size) + 1
            current, count = conv[-1], int(local[-1])
            digest = [hashlib.sha256(b"%d:" % len(r) + r + s).digest()[:16] for r, s in zip(batch.column(2).cast(pa.binary()).to_pylist(), batch.column(3).to_pylist())]
            yield C.columns_batch(conv_id=conv, part=np.full(len(conv), part, np.int32), local=local, digest=pa.array(digest, pa.binary()), bytes=batch.column(4))

    made = C.staged(ranged.mapInArrow(number, "conv_id long, part int, local long, digest binary, bytes long"))
    held = made.groupBy("conv_id", "part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # At most one conversation goes on from each range to the next: no more rows than ranges.
    earlier = F.broadcast(held.select("conv_id", "part", F.sum("n").over(before).alias("earlier")).filter("earlier is not null"))
    found = made.join(earlier, ["conv_id", "part"], "left")
    return found.select("conv_id", (F.col("local") + F.coalesce("earlier", F.lit(0))).alias("place"), "digest", "bytes")


def shared_starts(placed: DataFrame) -> DataFrame:
    """conv_id, depth, digest, bytes and ``last`` of rebuilt conversations: the first turns of their group's first, then their own later ones.

    With h the checksum of conv_id modulo 9, conversation c takes the first h
    turns of c - c % 5 (the remainder has the sign of c), and goes on with its
    own turns after the first h.  A row of depth 0 stands for every conversation.
    """
    placed = placed.withColumn("block", F.expr(f"(place - 1) div {BLOCK}"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9).alias("h")
    sizes = placed.groupBy("conv_id", "block").agg(F.count(F.lit(1)).alias("n")).groupBy("conv_id").agg(F.sum("n").alias("n"))
    convs = sizes.select("conv_id", "n", h, (F.col("conv_id") - F.col("conv_id") % 5).alias("base"))
    taken = F.least("h", F.coalesce("n_base", F.lit(0)))
    bases = sizes.select(F.col("conv_id").alias("base"), F.col("n").alias("n_base"))
    known = C.staged(convs.join(bases, "base", "left").select("conv_id", "n", "h", "base", taken.alias("taken")))
    roots = known.select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit(None).cast("binary").alias("digest"), F.lit(0).cast("long").alias("bytes"),
                         F.expr("taken = 0 and n <= h").alias("last"))
    first = placed.filter(F.col("place") <= SHARED).select(F.col("conv_id").alias("base"), "place", "digest", "bytes")
    heads = known.filter("taken > 0").join(first, "base").filter("place <= taken").select(
        "conv_id", F.col("place").alias("depth"), "digest", "bytes", F.expr("n <= h and place = taken").alias("last"))
    by_block = known.filter("n > h").select("conv_id", "n", "h", "taken", F.explode(F.expr(f"sequence(0, (n - 1) div {BLOCK})")).alias("block"))
    tails = placed.join(by_block, ["conv_id", "block"]).filter("place > h").select(
        "conv_id", F.expr("taken + place - h").alias("depth"), "digest", "bytes", F.expr("place = n").alias("last"))
    return roots.unionByName(heads).unionByName(tails)


# --- keys of prefixes --------------------------------------------------------------------------------------------


def prefix_keys(turns: DataFrame) -> DataFrame:
    """conv_id, depth, k1, k2, bytes, last: the key of the sequence of turns up to each one (0, 0 at depth 0)."""
    parts = [F.when(F.col("depth") == 0, F.lit(0).cast("long")).otherwise(F.xxhash64(F.lit(n), "depth", "digest")).alias(f"x{n}") for n in (1, 2)]
    turns = turns.select("conv_id", "depth", F.expr(f"depth div {BLOCK}").alias("block"), "bytes", "last", *parts)
    inside = Window.partitionBy("conv_id", "block").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    local = turns.select("conv_id", "depth", "block", "bytes", "last", *[F.bit_xor(f"x{n}").over(inside).alias(f"y{n}") for n in (1, 2)])
    sums = turns.groupBy("conv_id", "block").agg(*[F.bit_xor(f"x{n}").alias(f"x{n}") for n in (1, 2)])
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    earlier = sums.select("conv_id", "block", *[F.bit_xor(f"x{n}").over(before).alias(f"z{n}") for n in (1, 2)]).filter("block > 0")
    keys = [F.col(f"y{n}").bitwiseXOR(F.coalesce(f"z{n}", F.lit(0).cast("long"))).alias(f"k{n}") for n in (1, 2)]
    return local.join(earlier, ["conv_id", "block"], "left").select("conv_id", "depth", *keys, "bytes", "last")


def with_ancestors(paths: DataFrame, step: int) -> DataFrame:
    """Rows of every ``step``-th depth with ``at`` (depth / step) and ``up``, keys of earlier such rows.

    In a band these are the ancestors from the band's root on; for a band root,
    the whole band above.  The last rows of a block go to the next one as well,
    as context.
    """
    rows = paths.filter(F.col("depth") % step == 0).withColumn("at", F.expr(f"depth div {step}"))
    mine = F.expr(f"at div {BLOCK}")
    blocks = F.when(F.col("at") % BLOCK >= BLOCK - BAND, F.array(mine, mine + 1)).otherwise(F.array(mine))
    window = Window.partitionBy("conv_id", "block").orderBy("at").rowsBetween(-BAND, -1)
    seen = rows.withColumn("block", F.explode(blocks)).withColumn("seen", F.collect_list(F.struct(*KEY)).over(window))
    inner = F.expr(f"cast(at % {BAND} as int)")
    up = F.when(inner == 0, F.col("seen")).otherwise(F.slice("seen", -inner, inner))
    return seen.filter(F.col("block") == mine).withColumn("up", up).drop("block", "seen")


# --- totals of subtrees ------------------------------------------------------------------------------------------


def _summed(rows: DataFrame, values: list[str]) -> DataFrame:
    return rows.groupBy(*KEY).agg(*[F.sum(v).alias(v) for v in values])


def completed(nodes: DataFrame, paths: DataFrame, values: list[str], deepest: int, step: int = 1) -> DataFrame:
    """k1, k2 and the sums of ``values`` over the subtree of every node (at, up, k1, k2, values)."""
    inner = F.col("at") % BAND > 0
    reach = F.concat(F.when(inner, F.col("up")).otherwise(F.slice("up", 1, 0)), F.array(F.struct(*KEY)))
    own = nodes.select(F.explode(reach).alias("k"), *values).select("k.*", *values)
    if deepest < BAND:
        return C.staged(_summed(own, values))
    band_root = F.when(inner, F.get("up", F.lit(0))).otherwise(F.struct(*KEY))
    partial = _summed(nodes.select(band_root.alias("k"), *values).select("k.*", *values), values)
    upper = with_ancestors(paths, step * BAND).groupBy(*KEY).agg(F.min("at").alias("at"), F.first("up").alias("up"))
    totals = completed(C.staged(partial.join(upper, KEY)), paths, values, deepest // BAND, step * BAND)
    roots = nodes.filter(~inner & (F.col("at") > 0)).select(*KEY, "up")
    handed = roots.join(totals, KEY).select(F.explode("up").alias("k"), *values).select("k.*", *values)
    return C.staged(_summed(own.unionByName(handed), values))


# --- digests of members ------------------------------------------------------------------------------------------


def _member_digests(ends: DataFrame) -> DataFrame:
    """k1, k2 and the SHA-256 of the ids (conv_id), ascending and joined by commas.

    Ids are joined in sorted ranges first, so a node with very many sends few,
    large pieces to the task that digests them one after the other.
    """
    parts = C.partitions(ends.sparkSession)
    ordered = ends.select(*KEY, "conv_id").repartitionByRange(parts, *KEY, "conv_id").sortWithinPartitions(*KEY, "conv_id")

    def join(batches):
        for batch in batches:
            k1, k2, conv = (np.asarray(c) for c in batch.columns)
            if not len(conv):
                continue
            edge = np.concatenate([[True], (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])])
            starts = np.flatnonzero(edge | (np.arange(len(conv)) % (PIECE // 20) == 0))
            pieces = [",".join(map(str, conv[a:b].tolist())) for a, b in zip(starts, np.append(starts[1:], len(conv)))]
            yield C.columns_batch(k1=k1[starts], k2=k2[starts], first=conv[starts], piece=pieces)

    pieces = ordered.mapInArrow(join, "k1 long, k2 long, first long, piece string")
    pieces = pieces.repartition(parts, *KEY).sortWithinPartitions(*KEY, "first")

    def digest(batches):
        current, state = None, None
        for batch in batches:
            out = []
            for k1, k2, piece in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3).to_pylist()):
                if (k1, k2) == current:
                    state.update(b"," + piece.encode())
                    continue
                if current:
                    out.append((*current, state.hexdigest()))
                current, state = (k1, k2), hashlib.sha256(piece.encode())
            yield _digest_rows(out)
        if current:
            yield _digest_rows([(*current, state.hexdigest())])

    return pieces.mapInArrow(digest, "k1 long, k2 long, ends_sha256 string")


def _digest_rows(rows: list) -> pa.RecordBatch:
    return C.columns_batch(k1=pa.array([r[0] for r in rows], pa.int64()), k2=pa.array([r[1] for r in rows], pa.int64()), ends_sha256=pa.array([r[2] for r in rows], pa.string()))


# --- the trie ----------------------------------------------------------------------------------------------------


def trie(turns: DataFrame) -> DataFrame:
    """One row per node of conversations given as (conv_id, depth, digest, bytes, last) with a row of depth 0 each.

    conv_id: the smallest member; depth; parent_conv_id (root: NULL); n_convs:
    members; n_children; n_leaves: childless nodes below, the node included;
    saved_tokens: bytes of last texts that members share, (n_convs - 1) times the
    bytes of each node below, the node included; ends_sha256: digest of the
    members that end here.  Columns k1 and k2 name the node.  No conversations
    give no node, not even a root.
    """
    spark = turns.sparkSession
    paths = C.staged(prefix_keys(turns))
    deepest = paths.agg(F.max("depth")).first()[0]
    if deepest is None:
        names = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, k1 long, k2 long"
        return spark.createDataFrame([], names)
    rows = with_ancestors(paths, 1)
    grouped = rows.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("conv_id"), F.min("at").alias("at"),
                                     F.max("bytes").alias("bytes"), F.first("up").alias("up"))
    nodes = C.staged(grouped)
    parent = nodes.filter("at > 0").select(F.element_at("up", -1).alias("k")).select("k.*")
    children = parent.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = C.staged(nodes.join(children, KEY, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))))
    own = nodes.select(*KEY, "at", "up", F.expr("cast(n_children = 0 as long)").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved_tokens"))
    totals = completed(own, paths, ["n_leaves", "saved_tokens"], deepest)
    digests = _member_digests(paths.filter("last"))
    whole = C.staged(nodes.join(totals, KEY).join(digests, KEY, "left"))
    count = whole.count()
    above = whole.filter("n_children > 0").select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id"), "n_children")
    # Children of all parents are fewer than nodes, so fewer than HOT_PARENTS parents can have more than that part of them.
    hot = F.col("n_children") * HOT_PARENTS > count
    below = whole.select("*", F.element_at(F.when(F.col("at") > 0, F.col("up")), -1).alias("p")).select("*", F.col("p.k1").alias("p1"), F.col("p.k2").alias("p2"))
    below = below.join(F.broadcast(above.filter(hot).drop("n_children").withColumnRenamed("parent_conv_id", "hot_id")), ["p1", "p2"], "left")
    found = below.filter("hot_id is not null or at = 0").withColumn("parent_conv_id", F.col("hot_id"))
    rest = below.filter("hot_id is null and at > 0").join(above.filter(~hot).drop("n_children"), ["p1", "p2"])
    names = ["conv_id", F.col("at").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
             F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"), *KEY]
    return found.select(*names).unionByName(rest.select(*names))


def conversation_trie(rows: DataFrame) -> DataFrame:
    """The trie of ``rows`` (conv_id, turn, role, text) after each conversation took the first turns of its group's first.

    Turns go by number (NULL first), then role and digest of the text; equal rows
    are turns of their own.  NULL roles and texts are empty.  Rows without a
    conv_id belong to no conversation.  Other columns are not read.  Every step
    works on rows, blocks of a conversation, or sums combined before their
    shuffle; nothing holds a whole conversation or all members of a node.
    """
    return trie(shared_starts(placed_turns(rows.select("conv_id", "turn", "role", "text"))))


def op13_trie(spark, folder: str) -> DataFrame:
    return conversation_trie(spark.read.parquet(f"{folder}/conversations.parquet")).drop(*KEY)


ORACLE = """
with recursive placed as (select conv_id, row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), sha256(coalesce(text, ''))) as place,
    coalesce(role, '') as role, coalesce(text, '') as text from conversations where conv_id is not null),
convs as (select conv_id, count(*) as n, conv_id - conv_id % 5 as base,
    xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(conv_id::varchar, ''), lambda x: ascii(x)::bigint)), lambda c, b:
      list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) % 9 as h
  from placed group by conv_id),
known as (select c.*, least(h, coalesce((select b.n from convs b where b.conv_id = c.base), 0)) as taken from convs c),
turns as (select k.conv_id, p.place as depth, p.role, p.text from known k join placed p on p.conv_id = k.base and p.place <= k.taken
  union all select k.conv_id, k.taken + p.place - k.h, p.role, p.text from known k join placed p on p.conv_id = k.conv_id and p.place > k.h),
sized as (select k.conv_id, k.taken + greatest(n - h, 0) as length from known k),
chains as (select conv_id, depth, text, sha256(string_agg(length(role) || ':' || role || length(text) || ':' || text, '' order by depth)
    over (partition by conv_id order by depth)) as node from turns
  union all select conv_id, 0, '', 'root' from known),
nodes as (select node, min(conv_id) as conv_id, min(depth) as depth, count(*) as n_convs, max(strlen(text)) as bytes from chains group by node),
links as (select distinct c.node, p.node as parent from chains c join chains p on p.conv_id = c.conv_id and p.depth = c.depth - 1),
counts as (select n.*, (select count(*) from links l where l.parent = n.node) as n_children from nodes n),
below as (select distinct a.node as top, c.node from chains a join chains c on c.conv_id = a.conv_id and c.depth >= a.depth),
sums as (select b.top, sum(case when n_children = 0 then 1 else 0 end)::bigint as n_leaves, sum((n_convs - 1) * bytes)::bigint as saved_tokens
  from below b join counts c on c.node = b.node group by b.top),
ends as (select c.node, sha256(string_agg(c.conv_id::varchar, ',' order by c.conv_id)) as ends from chains c join sized s
  on s.conv_id = c.conv_id and s.length = c.depth group by c.node)
select c.conv_id, c.depth::bigint as depth, p.conv_id as parent_conv_id, c.n_convs, c.n_children, s.n_leaves, s.saved_tokens,
  coalesce(e.ends, sha256('')) as ends_sha256
from counts c join sums s on s.top = c.node left join links l on l.node = c.node left join nodes p on p.node = l.parent left join ends e on e.node = c.node"""
