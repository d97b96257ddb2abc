"""Jaccard join on word shingles, size-aware (operator 10: three words, 0.9; the pipeline: five words, 0.8).

Documents with equal sets are one class.  A small set lists its subsets of each
size that a partner would have to share.  A large set is cut by hash into one
block of tokens more than it may differ from a partner in tokens, so that some
block is whole in both, and meets others in the inverted lists of its blocks.
Below 0.9 blocks would hold too few tokens to tell sets apart; then there are
spare blocks, more are whole in both, and each set leaves out those with the
fewest tokens that a sample does not show to be common.
The boundary is where the measured sizes make the sum of keys smallest.
Members of a list are candidates; inside groups of candidates sets are compared
exactly, in pairs of bounded blocks, and a set already reached is not compared
again.
"""

from __future__ import annotations

from bisect import bisect_right
from functools import lru_cache
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as C
from .components import connected_components

PERCENT = 90
WIDTH = 3
LARGEST_LIGHT = 64  # the boundary is looked for up to this size
SAMPLE, COMMON = 8000, 3  # texts in which common tokens are counted, and how many must hold one
BLOCK = 1500  # sets of a block when a group is compared
BLOCK_TOKENS = 1 << 20  # and tokens (8 bytes each), of all sets together
LIST_KEYS = 1 << 22  # keys of a bucket of inverted lists, 22 to 46 MB when packed
OWNER_BITS = 40  # of a class's signature stand in the lists; classes that share them only meet where sets are compared
MEMBER_BITS = 1 << 27  # of a table of hashed documents, at most
_FIRST = -(1 << 63)


def overlap_needed(a, b, percent=PERCENT):
    """Shared tokens that sets of these sizes need: 100 * i >= percent * (a + b - i)."""
    return -(-percent * (a + b) // (100 + percent))


def smallest_partner(n: int, percent: int = PERCENT) -> int:
    return -(-percent * n // 100)


@lru_cache
def levels(percent: int, limit: int = 1 << 40) -> list[int]:
    """First size of each level; partners are of one level or of neighbouring ones."""
    out = [1]
    while out[-1] <= limit:
        out.append(max(out[-1] + 1, -(-100 * out[-1] // percent)))
    return out


def may_differ(scheme: int, percent: int = PERCENT) -> int:
    """The most tokens in which partners that meet under the scheme differ."""
    largest = 2 * (levels(percent)[scheme + 1] - 1)
    return largest * (100 - percent) // (100 + percent)


def block_counts(n: int, percent: int = PERCENT) -> list[tuple[int, int]]:
    """(scheme, blocks) under which a set of size n is listed.

    Scheme ``u`` serves pairs of level ``u`` with itself and the level below;
    it has a block more than such sets may differ in tokens, and below 90 % two
    spare ones for every three.
    """
    level = bisect_right(levels(percent), n) - 1
    out = []
    for u in (level, level + 1):
        most = may_differ(u, percent)
        out.append((u, most + 1 + (2 * most // 3 if percent < 90 else 0)))
    return out


def subset_sizes(n: int, percent: int = PERCENT) -> list[int]:
    """Sizes of the common subset with each possible partner."""
    partners = range(smallest_partner(n, percent), 100 * n // percent + 1)
    return sorted({c for b in partners if (c := overlap_needed(n, b, percent)) <= min(n, b)})


def light_cost(n: int, percent: int = PERCENT) -> int:
    return sum(comb(n, c) for c in subset_sizes(n, percent))


def heavy_cost(n: int, percent: int = PERCENT) -> int:
    """The most keys of a large set."""
    return sum(may_differ(u, percent) + 1 for u, _ in block_counts(n, percent))


def boundary(sizes: dict[int, int], percent: int = PERCENT) -> int:
    """The largest small size, chosen by cost: the number of keys that sets of these sizes make.

    Large sets only just above the boundary can meet small ones, so sets from
    there down to the smallest partner make both kinds of keys.
    """

    def cost(limit: int) -> int:
        light = sum(k * light_cost(n, percent) for n, k in sizes.items() if n <= limit)
        return light + sum(k * heavy_cost(n, percent) for n, k in sizes.items() if 100 * n > percent * limit)

    small = [n for n in range(1, LARGEST_LIGHT + 1) if light_cost(n, percent) <= 1000]
    return min(small, key=lambda n: (cost(n), n))


# --- sets of a chunk ---------------------------------------------------------------------------------------------


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int = WIDTH) -> list[np.ndarray]:
    """Per row the sorted hashes of its distinct shingles (A-Z as a-z)."""
    low = C.LOWER[data]
    starts, ends, rows = C.pieces(~C.SPACE[low], offsets)
    words = C.substring_hashes(C.prefix_sums(low), starts, ends)
    grams, at = C.grams(words, rows, width)
    n = len(offsets) - 1
    first = np.searchsorted(rows[at], np.arange(n + 1)).tolist()
    word = np.searchsorted(rows, np.arange(n + 1)).tolist()
    out = []
    for i in range(n):
        size = word[i + 1] - word[i]
        if size >= width:
            out.append(np.unique(grams[first[i] : first[i + 1]]))
        elif size:
            mine = words[word[i] : word[i + 1]]
            whole = np.array([size], np.uint64)
            for k in range(size):
                whole = C.mix(whole * np.uint64(7) + mine[k : k + 1])
            out.append(whole)
        else:
            out.append(np.empty(0, np.uint64))
    return out


def signature(tokens: np.ndarray) -> tuple[int, int]:
    return int(C.mix(tokens).sum(dtype=np.uint64).view(np.int64)), int(C.mix(tokens ^ np.uint64(C._ODD)).sum(dtype=np.uint64).view(np.int64))


def light_keys(tokens: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Hashes of all subsets of the needed sizes; a subset is what is left when some tokens go."""
    total, out = tokens.sum(dtype=np.uint64), []
    for c in subset_sizes(len(tokens), percent):
        gone = len(tokens) - c
        if gone == 0:
            sums = np.array([total], np.uint64)
        elif gone == 1:
            sums = total - tokens
        else:
            sums = total - np.array([tokens[list(x)].sum(dtype=np.uint64) for x in combinations(range(len(tokens)), gone)], np.uint64)
        out.append(C.mix(sums + np.uint64((c * C._BASE) & (2**64 - 1))))
    return np.concatenate(out)


def heavy_keys(tokens: np.ndarray, percent: int = PERCENT, common: np.ndarray = np.empty(0, np.uint64)) -> np.ndarray:
    """Hashes of the blocks of tokens under both schemes.

    Partners have more whole blocks in common than the spare ones, so one of
    them weighs no less than the lightest block that either lists.  Any weight
    will do that depends on a block's tokens only; rare tokens weigh most.
    """
    rare = np.ones(len(tokens), np.int64)
    if len(common):
        rare = (common[np.minimum(np.searchsorted(common, tokens), len(common) - 1)] != tokens).astype(np.int64)
    mixed, out = C.mix(tokens + np.uint64(C._ODD)), []
    for scheme, blocks in block_counts(len(tokens), percent):
        part = ((tokens >> np.uint64(16)) % np.uint64(blocks)).astype(np.int64)
        order = np.argsort(part)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed[order], dtype=np.uint64)])
        edge = np.searchsorted(part[order], np.arange(blocks + 1))
        names = C.mix(np.arange(blocks, dtype=np.uint64) + np.uint64((scheme * C._BASE) & (2**64 - 1)))
        heavy = np.concatenate([np.zeros(1, np.int64), np.cumsum(rare[order])])
        weight = (np.diff(heavy[edge]) << 32) + np.diff(edge)
        spare = blocks - 1 - may_differ(scheme, percent)
        listed = weight >= np.partition(weight, spare)[spare]
        out.append(C.mix(sums[edge[1:]] - sums[edge[:-1]] + names)[listed])
    return np.concatenate(out)


def _sets(batch, column: int, width: int):
    for a, b, data, offsets in C.chunked(batch.column(column)):
        yield from enumerate(shingle_sets(data, offsets, width), a)


# --- passes ------------------------------------------------------------------------------------------------------

def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.coalesce(F.col("doc_id"), F.lit(_FIRST)).alias("doc_id"), F.xxhash64(text).alias("tie"), text.alias("text"))


def _facts(keyed: DataFrame, width: int) -> DataFrame:
    """Size and signature of every document's set."""

    def work(batches):
        for batch in batches:
            found = [(len(tokens), *signature(tokens)) for _, tokens in _sets(batch, 2, width)]
            n, s1, s2 = zip(*found) if found else ((), (), ())
            yield C.columns_batch(doc_id=batch.column(0), tie=batch.column(1), n=pa.array(n, pa.int64()), s1=pa.array(s1, pa.int64()), s2=pa.array(s2, pa.int64()))

    return keyed.mapInArrow(work, "doc_id long, tie long, n long, s1 long, s2 long")


def _common(keyed: DataFrame, total: int, width: int) -> np.ndarray:
    """Sorted tokens that several texts of a bounded, hash-drawn sample hold."""
    drawn = keyed.filter(F.pmod(F.xxhash64("doc_id", "tie"), F.lit(max(1, -(-total // SAMPLE)))) == 0)

    def work(batches):
        for batch in batches:
            for _, tokens in _sets(batch, 2, width):
                yield C.columns_batch(token=tokens.view(np.int64))

    counts = drawn.dropDuplicates(["tie"]).mapInArrow(work, "token long").groupBy("token").count().filter(F.col("count") >= COMMON)
    top = counts.orderBy(F.desc("count"), "token").limit(1 << 17).select("token").collect()
    return np.sort(np.array([r[0] for r in top], np.int64).view(np.uint64))


def _packed(keys: np.ndarray, owners: np.ndarray) -> bytes:
    """40 bits of each key, and 40 of the owners with how many keys in a row (255 at most) each has.

    The more buckets there are, the fewer keys of an owner stand in one, and an
    owner then takes as much room as a key.
    """
    edge = np.flatnonzero(np.concatenate([[True], owners[1:] != owners[:-1]]))
    counts = np.diff(np.append(edge, len(keys)))
    parts = -(-counts // 255)
    owners, sizes = np.repeat(owners[edge], parts), np.full(int(parts.sum()), 255, np.uint8)
    sizes[np.cumsum(parts) - 1] = counts - 255 * (parts - 1)
    wide = len(owners) > 0 and (owners.min() < 0 or owners.max() >> OWNER_BITS > 0)
    names = [owners] if wide else _halves(owners.view(np.uint64))
    head = np.array([len(keys), len(owners), wide], np.uint32)
    return b"".join(x.tobytes() for x in (head, sizes, *_halves(keys), *names))


def _halves(x: np.ndarray) -> list[np.ndarray]:
    """The low 40 bits of numbers."""
    return [x.astype(np.uint32), (x >> np.uint64(32)).astype(np.uint8)]


def _whole(blob: bytes, size: int, at: int) -> np.ndarray:
    """Numbers whose :func:`_halves` stand at a place."""
    return np.frombuffer(blob, np.uint8, size, at + 4 * size).astype(np.uint64) << np.uint64(32) | np.frombuffer(blob, np.uint32, size, at)


def _unpacked(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys, owners and how many keys in a row each owner has."""
    n, m, wide = np.frombuffer(blob, np.uint32, 3).tolist()
    at = 12 + m
    owners = np.frombuffer(blob, np.int64, m, at + 5 * n) if wide else _whole(blob, m, at + 5 * n).view(np.int64)
    return _whole(blob, n, at), owners, np.frombuffer(blob, np.uint8, m, 12)


def _postings(keyed: DataFrame, limit: int, buckets: int, width: int, percent: int, common: np.ndarray) -> DataFrame:
    """(bucket, postings): keys and classes, each class once per task."""

    def work(batches):
        seen, low = set(), (1 << OWNER_BITS) - 1
        for batch in batches:
            keys, owners = [], []
            for _, tokens in _sets(batch, 2, width):
                sig = signature(tokens) if len(tokens) else None
                if sig is None or sig in seen:
                    continue
                seen.add(sig)
                if len(tokens) <= limit:
                    keys.append(light_keys(tokens, percent))
                    owners.append(np.full(len(keys[-1]), sig[0] & low, np.int64))
                if 100 * len(tokens) > percent * limit:
                    keys.append(heavy_keys(tokens, percent, common))
                    owners.append(np.full(len(keys[-1]), sig[0] & low, np.int64))
            if keys:
                keys, owners = np.concatenate(keys), np.concatenate(owners)
                where = ((keys >> np.uint64(48)) % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(where, kind="stable")
                keys, owners = keys[order], owners[order]
                edge = np.searchsorted(where[order], np.arange(buckets + 1))
                used = np.flatnonzero(np.diff(edge))
                blobs = [_packed(keys[edge[k] : edge[k + 1]], owners[edge[k] : edge[k + 1]]) for k in used]
                yield C.columns_batch(bucket=used.astype(np.int32), postings=pa.array(blobs, pa.binary()))

    return keyed.mapInArrow(work, "bucket int, postings binary")


def _buckets(rows: DataFrame, small: dict[int, int], limit: int, percent: int) -> int:
    """How many buckets the keys of all rows fill, one per core at least; keys of large sets rise with their size.

    Each task may name a class once, so buckets are not made more than that.
    """
    each = heavy_cost(1 << 20, percent) / (1 << 20)
    light = sum(k * light_cost(n, percent) for n, k in small.items() if n <= limit)
    heavy = rows.filter(F.col("n") * 100 > percent * limit).agg(F.sum(F.col("n") * each + 4)).first()[0] or 0
    return max(rows.sparkSession.sparkContext.defaultParallelism, -(-int(light + heavy) // LIST_KEYS))


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest item that each of ``n`` items reaches over the links (a, b)."""
    root = np.arange(n)
    while True:
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            return root
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (up := root[root]).tobytes() != root.tobytes():
            root = up


class _Reached:
    """Classes that a task has found linked so far, each with its smallest one; tells which links are new.

    Beyond ``limit`` classes it begins anew, so that links may come again but none is lost.
    """

    def __init__(self, limit: int = LIST_KEYS):
        self.limit, self.names, self.root = limit, np.empty(0, np.int64), np.empty(0, np.int64)

    def add(self, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        """Edges of a forest that links the classes a and b as far as nothing before did."""
        if len(self.names) > self.limit:
            self.names, self.root = self.names[:0], self.root[:0]
        names, at = np.unique(np.concatenate([self.names, a, b]), return_inverse=True)
        old, a, b = np.split(at, [len(self.names), len(self.names) + len(a)])
        before = np.arange(len(names))
        before[old] = old[self.root]
        root = _roots(len(names), np.concatenate([old, a]), np.concatenate([old[self.root], b]))
        hung = np.flatnonzero((before == np.arange(len(names))) & (root != before))
        self.names, self.root = names, root
        return C.columns_batch(a=names[root[hung]], b=names[hung])


def _linked(postings: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Neighbours in the lists of a bucket."""
    found = [_unpacked(b) for b in postings]
    names, which = np.unique(np.concatenate([f[1] for f in found]), return_inverse=True)
    # A key and the number of its owner in one word, so that a sort in place is all that a bucket takes.
    shift = np.uint64(max(24, len(names).bit_length()))
    low = (np.uint64(1) << shift) - np.uint64(1)
    words, at, run = np.empty(sum(len(f[0]) for f in found), np.uint64), 0, 0
    while found:
        keys, owners, counts = found.pop(0)
        words[at : at + len(keys)] = keys << shift | np.repeat(which[run : run + len(owners)], counts).astype(np.uint64)
        at, run = at + len(keys), run + len(owners)
    words.sort()
    pairs = []
    for at in range(0, len(words), 1 << 18):
        part = words[at : at + (1 << 18) + 1]
        same = np.flatnonzero((part[1:] >> shift == part[:-1] >> shift) & (part[1:] != part[:-1]))
        pairs.append(np.unique(np.stack([part[same], part[same + 1]], 1) & low, axis=0))
    pairs = np.unique(np.concatenate(pairs), axis=0).astype(np.int64)
    return names[pairs[:, 0]], names[pairs[:, 1]]


def _candidates(listed: DataFrame) -> DataFrame:
    """Edges (a, b) that hold the classes of each list together.

    A task takes its buckets one by one and makes a forest of them all, so that
    edges grow with the classes and not with their lists or the pairs in them.
    """

    def work(batches):
        reached, current, held = _Reached(), None, []
        for batch in batches:
            for bucket, blob in zip(*(batch.column(c).to_pylist() for c in (0, 1))):
                if bucket != current and held:
                    yield reached.add(*_linked(held))
                    held = []
                current = bucket
                held.append(blob)
        if held:
            yield reached.add(*_linked(held))

    return listed.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(work, "a long, b long")


def forest(n: int, links_of) -> list[tuple[int, int]]:
    """Edges of a spanning forest; ``links_of(i, others)`` marks which of the others item ``i`` links to.

    Breadth first: an item is only compared with those not reached yet.
    """
    left, out = np.arange(n), []
    while len(left) > 1:
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            i = queue.pop()
            hit = links_of(i, left)
            found = left[hit]
            out.extend((i, int(j)) for j in found)
            queue.extend(found.tolist())
            left = left[~hit]
    return out


def _verified(table: pa.Table, width: int, percent: int) -> pa.Table:
    """Edges between classes of two blocks (or inside one) whose sets are similar."""
    names = table.column("class").to_pylist()
    half = np.asarray(table.column("half").combine_chunks())
    texts = pa.array([C.restored(x) for x in table.column("text").to_pylist()], pa.large_binary())
    sets = [tokens for _, _, data, offsets in C.chunked(texts) for tokens in shingle_sets(data, offsets, width)]
    n = np.array([len(x) for x in sets])
    ends = np.cumsum(n)
    _, tokens = np.unique(np.concatenate(sets), return_inverse=True)
    parts = [tokens[e - k : e] for e, k in zip(ends, n)]
    flag = np.zeros(int(tokens.max()) + 1, np.int64)
    crossing = len(np.unique(half)) > 1

    def links(i, others):
        fits = (100 * np.minimum(n[others], n[i]) >= percent * np.maximum(n[others], n[i])) & (not crossing or half[others] != half[i])
        chosen = others[fits]
        hit = np.zeros(len(others), bool)
        if len(chosen):
            flag[parts[i]] = 1
            sizes = n[chosen]
            common = np.add.reduceat(flag[np.concatenate([parts[j] for j in chosen])], np.cumsum(sizes) - sizes)
            flag[parts[i]] = 0
            hit[np.flatnonzero(fits)] = 100 * common >= percent * (n[i] + sizes - common)
        return hit

    pairs = np.array([(names[i], names[j]) for i, j in forest(len(sets), links)], np.int64).reshape(-1, 2)
    return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]})


def _texts_of(keyed: DataFrame, members: DataFrame) -> DataFrame:
    """(doc_id, tie, text) of rows that may be members, squeezed: all of them, and a sixteenth of the others.

    A bounded table of hashed members goes to every task, so that only their texts are shuffled.
    """
    bits = min(MEMBER_BITS, 1 << max(16, (16 * members.count()).bit_length()))
    slot = F.pmod(F.xxhash64("doc_id", "tie"), F.lit(bits))

    def page(table: pa.Table) -> pa.Table:
        held = np.zeros(1 << 16, np.uint8)
        slots = np.asarray(table.column("slot").combine_chunks())
        held[slots & 0xFFFF] = 1
        return pa.table({"page": pa.array([int(slots[0]) >> 16], pa.int64()), "held": pa.array([np.packbits(held).tobytes()], pa.binary())})

    whole = np.zeros(bits >> 3, np.uint8)
    slots = members.select(slot.alias("slot")).withColumn("page", F.shiftright("slot", 16))
    for row in slots.groupBy("page").applyInArrow(page, "page long, held binary").collect():
        whole[row["page"] << 13 : (row["page"] + 1) << 13] = np.frombuffer(row["held"], np.uint8)
    table = keyed.sparkSession.sparkContext.broadcast(whole)

    def work(batches):
        for batch in batches:
            slots = np.asarray(batch.column(3))
            keep = np.flatnonzero(table.value[slots >> 3] >> (7 - (slots & 7)).astype(np.uint8) & 1)
            ids, ties, texts = (batch.column(k).take(pa.array(keep)) for k in range(3))
            texts = pa.array([C.squeezed(t) for t in texts.cast(pa.binary()).to_pylist()], pa.binary())
            yield C.columns_batch(doc_id=ids, tie=ties, text=texts)

    return keyed.select("doc_id", "tie", "text", slot.alias("slot")).mapInArrow(work, "doc_id long, tie long, text binary")


def _grouped(docs: DataFrame, block: int, width: int, percent: int) -> DataFrame:
    """Id, tie (hash of the text) and set size of every row, with the smallest id and tie of its group.

    Classes are known by their signature; ids only choose the representative,
    so rows that share an id (or have none) are not linked by it.
    """
    C.small_batches(docs.sparkSession)
    keyed = _keyed(docs)
    facts = C.staged(_facts(keyed, width))
    rows = facts.select("doc_id", "tie", "n", "s1", "s2")
    sizes = {r[0]: r[1] for r in rows.filter(F.col("n").between(1, 2 * LARGEST_LIGHT)).groupBy("n").count().collect()}
    limit = boundary(sizes, percent)
    grouped = rows.filter("n > 0").groupBy("n", "s1", "s2").agg(F.min(F.struct("doc_id", "tie")).alias("first"))
    classes = C.staged(grouped.select("n", "s1", "s2", F.col("first.doc_id").alias("doc_id"), F.col("first.tie").alias("tie")))

    common = _common(keyed, rows.count(), width) if percent < 90 else np.empty(0, np.uint64)
    listed = _postings(keyed, limit, _buckets(rows, sizes, limit, percent), width, percent, common)
    groups = C.staged(connected_components(_candidates(listed)))

    # A group larger than a block, in sets or in tokens, is cut; every pair of its blocks is one unit of comparison.
    placed = groups.join(classes, F.col("node") == F.col("s1").bitwiseAND(F.lit((1 << OWNER_BITS) - 1))).drop("node")
    needed = F.greatest(F.ceil(F.count(F.lit(1)) / F.lit(block)), F.ceil(F.sum("n") / F.lit(BLOCK_TOKENS)))
    big = placed.groupBy("component").agg(needed.alias("blocks")).filter("blocks > 1")
    blocks = F.coalesce("blocks", F.lit(1).cast("long"))
    members = C.staged(placed.join(big, "component", "left").withColumn("blocks", blocks).select(
        "component", "blocks", "doc_id", "tie", "s1", F.pmod(F.xxhash64("s1", "s2"), F.col("blocks")).alias("at")))
    texts = members.join(_texts_of(keyed, members), ["doc_id", "tie"])
    if rows.count() > rows.select("doc_id", "tie").distinct().count():  # rows that repeat id and text
        texts = texts.dropDuplicates(["doc_id", "tie"])
    # Texts travel squeezed, a third of the size of their sets or less, and sets are made where they are compared.
    other = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1))
    paired = texts.select("*", other.alias("other")).select(
        "component", F.least("at", "other").alias("low"), F.greatest("at", "other").alias("high"), F.col("s1").alias("class"), (F.col("at") > F.col("other")).cast("int").alias("half"), "text")
    verified = paired.groupBy("component", "low", "high").applyInArrow(lambda table: _verified(table, width, percent), "a long, b long")
    linked = connected_components(verified)

    named = classes.join(linked, F.col("s1") == F.col("node"), "left").withColumn("group", F.coalesce("component", "s1"))
    firsts = named.groupBy("group").agg(F.min(F.struct("doc_id", "tie")).alias("head"))
    named = named.join(firsts, "group").select("n", "s1", "s2", "head")
    out = rows.join(named, ["n", "s1", "s2"], "left")
    return out.select("doc_id", "tie", "n", F.coalesce("head", F.struct("doc_id", "tie")).alias("head"))


def similar_documents(docs: DataFrame, block: int = BLOCK, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row.

    Two documents link at a Jaccard similarity of ``percent`` hundredths or more
    of their sets of distinct shingles of ``width`` words; with fewer words the
    whole text is the only shingle; without words (or text) a document links
    with nothing.  Equal rows are linked like any others.  A NULL id counts as
    the smallest.
    """
    if width < 1 or not 0 < percent <= 100:
        raise ValueError("width must be at least 1 and percent within 1 to 100")
    real = lambda c: F.when(F.col(c) != _FIRST, F.col(c))
    return _grouped(docs, block, width, percent).select(
        real("doc_id").alias("doc_id"), F.col("n").alias("n_shingles"), real("head.doc_id").alias("component_id"))


def one_per_group(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """One row of each group of linked texts: of the smallest id, there of the smallest hash of text and row.

    Rows without words link with nothing and all stay.
    """
    ident, tie, place, many = (C.free(docs, n) for n in ("group_id", "group_tie", "group_place", "group_many"))
    heads = _grouped(docs, BLOCK, width, percent).filter((F.col("n") == 0) | (F.col("head.doc_id") == F.col("doc_id")) & (F.col("head.tie") == F.col("tie")))
    heads = C.staged(heads.groupBy(F.col("doc_id").alias(ident), F.col("tie").alias(tie)).agg(((F.count(F.lit(1)) > 1) & (F.max("n") > 0)).alias(many)))
    keyed = docs.withColumns({ident: F.coalesce(F.col("doc_id"), F.lit(_FIRST)), tie: F.xxhash64(F.coalesce(F.col("text"), F.lit("")))})
    if not heads.filter(many).limit(1).count():
        return keyed.join(heads, [ident, tie], "left_semi").select(*docs.columns)
    kept = keyed.join(heads, [ident, tie])
    order = Window.partitionBy(ident, tie).orderBy(F.xxhash64(*[F.col(f"`{c}`").cast("string") for c in docs.columns]))
    first = kept.filter(many).withColumn(place, F.row_number().over(order)).filter(F.col(place) == 1)
    return kept.filter(~F.col(many)).select(*docs.columns).unionByName(first.select(*docs.columns))


def op10_jaccard(spark, folder: str) -> DataFrame:
    return similar_documents(spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text"))


ORACLE = r"""
with recursive docs as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
  'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
sets as (select doc_id, case when len(w) = 0 then [] when len(w) < 3 then [array_to_string(w, ' ')] else
  list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) end as s from docs),
sizes as (select doc_id, len(s) as n from sets),
tokens as (select doc_id, len(s) as n, unnest(s) as t from sets),
pairs as (select a.doc_id as a, b.doc_id as b, any_value(a.n) as na, any_value(b.n) as nb, count(*) as i
  from tokens a join tokens b on a.t = b.t and a.doc_id <> b.doc_id and 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n)
  group by a.doc_id, b.doc_id),
links as (select a, b from pairs where 100 * i >= 90 * (na + nb - i)),
reach as (select doc_id as a, doc_id as b from docs union select reach.a, links.b from reach join links on reach.b = links.a)
select doc_id, cast(n as bigint) as n_shingles, (select min(b) from reach where reach.a = doc_id) as component_id from sizes"""
