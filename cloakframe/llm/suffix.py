"""Removal of repeated byte strings by a sampled suffix array (operator 8).

Every window of ``LENGTH`` bytes names one anchor: the position of the smallest
hash among the ``GRAM``-byte strings inside it.  Equal windows name equal
anchors, so only suffixes at anchors are sorted.  Anchors whose gram occurs
once are dropped first.  The others are sorted in runs (suffix, then what
stands before it, reversed), equal strings of a run collapse into one, runs are
front-coded and exchanged by gram, and loser trees merge them without comparing
a known common prefix again.  Common prefixes of the merged order, and of the
order of the strings before the anchors, then tell for every window whether an
equal one starts earlier.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

LENGTH = 100
GRAM = 40
_BEFORE = LENGTH - GRAM  # an anchor stands at most this far behind the start of its window
_KEY = 2 + LENGTH + _BEFORE + 2  # bucket, suffix, reversed bytes before it, how much of both there is
RUN = 150_000  # suffixes of a run
_FIRST = -(1 << 63)
ENTRY = np.dtype([("sid", "<i8"), ("tie", "<i4"), ("at", "<i4"), ("far", "u1"), ("near", "u1")])


def anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(gram hash, row, position in the row, first and last window as distances before the position)."""
    none = np.empty(0, np.int64)
    n = len(data) - LENGTH + 1
    if n <= 0:
        return none.astype(np.uint64), none, none, none, none
    sums = C.prefix_sums(data)
    _, down = C.powers(len(sums))
    hashes = C.mix((sums[GRAM:] - sums[:-GRAM]) * down[: len(sums) - GRAM])
    low, where = hashes, np.arange(len(hashes), dtype=np.int32)
    width = 1
    while width < _BEFORE + 1:  # leftmost smallest hash of ever wider spans
        step = min(width, _BEFORE + 1 - width)
        later = low[step:] < low[:-step]
        where = np.where(later, where[step:], where[:-step])
        low = np.where(later, low[step:], low[:-step])
        width += step
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[:n]
    inside = np.arange(LENGTH, n + LENGTH) <= offsets[row + 1]
    starts = np.flatnonzero(inside)
    if not len(starts):
        return none.astype(np.uint64), none, none, none, none
    anchor = where[starts].astype(np.int64)
    new = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (row[starts][1:] != row[starts][:-1])]))
    last = np.append(new[1:], len(starts)) - 1
    at, r = anchor[new], row[starts[new]]
    return hashes[at], r, at - offsets[r], at - starts[new], at - starts[last]


def _entries(sid, tie, at, far, near) -> np.ndarray:
    out = np.empty(len(at), ENTRY)
    out["sid"], out["tie"], out["at"], out["far"], out["near"] = sid, tie, at, far, near
    return out


def _pack(entries: np.ndarray) -> bytes:
    """Fields one after the other: they compress better."""
    return b"".join(np.ascontiguousarray(entries[f]).tobytes() for f in ENTRY.names)


def _unpack(blob: bytes) -> np.ndarray:
    n, at = len(blob) // ENTRY.itemsize, 0
    out = np.empty(n, ENTRY)
    for f in ENTRY.names:
        kind = ENTRY[f]
        out[f] = np.frombuffer(blob, kind, n, at)
        at += n * kind.itemsize
    return out


def _distinct(blobs: list[bytes]) -> np.ndarray:
    """The entries of one document by position; repeated rows give them more than once."""
    found = np.concatenate([_unpack(b) for b in blobs])
    found = found[np.argsort(found["at"], kind="stable")]
    return found[np.concatenate([[True], found["at"][1:] != found["at"][:-1]])]


def _by_document(entries: np.ndarray):
    """(sid, tie, packed entries) of each document."""
    entries = entries[np.lexsort((entries["at"], entries["tie"], entries["sid"]))]
    if not len(entries):
        return [], [], []
    edge = np.flatnonzero(np.concatenate([[True], (entries["sid"][1:] != entries["sid"][:-1]) | (entries["tie"][1:] != entries["tie"][:-1])]))
    ends = np.append(edge[1:], len(entries))
    return entries["sid"][edge], entries["tie"][edge], [_pack(entries[a:b]) for a, b in zip(edge, ends)]


def _keyed(docs: DataFrame) -> DataFrame:
    """sid: the id (NULL first); tie: tells texts under one id apart."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.coalesce(F.col("doc_id"), F.lit(_FIRST)).alias("sid"), F.hash(text).alias("tie"), text.alias("text"))


def _first_pass(docs: DataFrame, buckets: int) -> DataFrame:
    """(sid, tie, entries) of the anchors whose gram occurs more than once."""

    def split(batches):
        for batch in batches:
            sid, tie = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            parts = []
            for a, _, data, offsets in C.chunked(batch.column(2)):
                h, row, at, far, near = anchors(data, offsets)
                parts.append((h, _entries(sid[a + row], tie[a + row], at, far, near)))
            if not parts:
                continue
            h, entries = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
            order = np.argsort(h, kind="stable")
            h, entries = h[order], entries[order]
            same = h[1:] == h[:-1]
            again = np.concatenate([[False], same]) | np.concatenate([same, [False]]) if len(h) else np.empty(0, bool)
            # Grams that this batch repeats are known; the exchange only hears that they are, once.
            first = again & ~np.concatenate([[False], same]) if len(h) else again
            ids, ties, blobs = _by_document(entries[again])
            if len(ids):
                yield C.columns_batch(bucket=(C.mix(np.asarray(ids).astype(np.uint64)) % np.uint64(buckets)).astype(np.int32), kind=np.ones(len(ids), np.int8), sid=ids, tie=ties,
                                      grams=pa.array([b""] * len(ids), pa.binary()), entries=pa.array(blobs, pa.binary()))
            for kind, chosen in ((0, ~again), (2, first)):
                g, e = h[chosen], entries[chosen]
                where = (g >> np.uint64(32)) % np.uint64(buckets)
                by = np.argsort(where, kind="stable")
                g, e, where = g[by], e[by], where[by]
                edge = np.searchsorted(where, np.arange(buckets + 1))
                for k in range(buckets):
                    if edge[k] < edge[k + 1]:
                        s = slice(edge[k], edge[k + 1])
                        yield C.columns_batch(bucket=np.array([k], np.int32), kind=np.array([kind], np.int8), sid=np.array([0], np.int64), tie=np.array([0], np.int32),
                                              grams=pa.array([g[s].tobytes()], pa.binary()), entries=pa.array([C.squeezed(_pack(e[s])) if kind == 0 else b""], pa.binary()))

    def meet(table: pa.Table) -> pa.Table:
        kind = np.asarray(table.column("kind").combine_chunks())
        grams, blobs = table.column("grams").to_pylist(), table.column("entries").to_pylist()
        single = [i for i in np.flatnonzero(kind == 0)]
        h = np.frombuffer(b"".join(grams[i] for i in single), np.uint64)
        known = np.frombuffer(b"".join(grams[i] for i in np.flatnonzero(kind == 2)), np.uint64)
        entries = np.concatenate([_unpack(C.restored(blobs[i])) for i in single]) if single else np.empty(0, ENTRY)
        both = np.concatenate([h, known])
        order = np.argsort(both)
        same = both[order[1:]] == both[order[:-1]]
        again = np.zeros(len(both), bool)
        again[order[1:][same]] = True
        again[order[:-1][same]] = True
        ids, ties, packed = _by_document(entries[again[: len(h)]])
        passed = table.filter(pa.array(kind == 1)).select(["sid", "tie", "entries"])
        more = pa.table({"sid": pa.array(ids, pa.int64()), "tie": pa.array(ties, pa.int32()), "entries": pa.array(packed, pa.binary())})
        return pa.concat_tables([passed.cast(more.schema), more])

    rows = docs.mapInArrow(split, "bucket int, kind byte, sid long, tie int, grams binary, entries binary")
    return rows.groupBy("bucket").applyInArrow(meet, "sid long, tie int, entries binary")


# --- suffixes: keys, runs, merging --------------------------------------------------------------------------------


def suffix_keys(data: np.ndarray, begin: np.ndarray, end: np.ndarray, at: np.ndarray, buckets: int) -> np.ndarray:
    """One row of key bytes per suffix: bucket, suffix, reversed bytes before it, lengths of the two."""
    out = np.zeros((len(at), _KEY), np.uint8)
    padded = np.concatenate([data, np.zeros(1, np.uint8)])
    place = at[:, None] + np.arange(LENGTH)
    np.copyto(out[:, 2 : 2 + LENGTH], padded[np.where(place < end[:, None], place, len(data))])
    place = at[:, None] - 1 - np.arange(_BEFORE)
    np.copyto(out[:, 2 + LENGTH : -2], padded[np.where(place >= begin[:, None], place, len(data))])
    out[:, -2] = np.minimum(end - at, LENGTH) + 1
    out[:, -1] = np.minimum(at - begin, _BEFORE) + 1
    head = np.zeros(len(at), np.uint64)
    for i in range(0, GRAM, 8):
        head = C.mix(head ^ np.ascontiguousarray(out[:, 2 + i : 10 + i]).view(np.uint64).ravel())
    bucket = (head >> np.uint64(32)) % np.uint64(buckets)
    out[:, 0], out[:, 1] = bucket >> np.uint64(8), bucket & np.uint64(255)
    return out


def sort_keys(keys: np.ndarray) -> np.ndarray:
    keys = np.ascontiguousarray(keys)
    return np.argsort(keys.view(f"S{keys.shape[1]}").ravel(), kind="stable") if len(keys) else np.empty(0, np.int64)


def common_prefixes(keys: np.ndarray) -> np.ndarray:
    """Length of the prefix each row shares with the row before it (0 for the first)."""
    out = np.zeros(len(keys), np.int64)
    if len(keys) > 1:
        differ = keys[1:] != keys[:-1]
        out[1:] = np.where(differ.any(1), differ.argmax(1), keys.shape[1])
    return out


def earlier_first(entries: np.ndarray, groups: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each group (numbers in ascending order) the entry that starts earliest, and which entries start later."""
    order = np.lexsort((entries["at"], entries["tie"], entries["sid"], groups))
    g = groups[order]
    lead = np.concatenate([[True], g[1:] != g[:-1]]) if len(g) else np.empty(0, bool)
    best = order[lead]
    of = best[np.cumsum(lead) - 1]
    same = np.ones(len(order), bool)
    for f in ("sid", "tie", "at"):
        same &= entries[f][order] == entries[f][of]
    later = np.zeros(len(entries), bool)
    later[order[~same]] = True
    return best, later


def front_code(keys: np.ndarray) -> tuple[bytes, bytes]:
    """Lengths of the shared prefixes, and the bytes after them."""
    shared = common_prefixes(keys)
    rest = keys[np.arange(keys.shape[1]) >= shared[:, None]]
    return shared.astype(np.uint8).tobytes(), rest.tobytes()


def _decoded(shared: bytes, rest: bytes):
    key, at = b"", 0
    for n in shared:
        size = _KEY - n
        key = key[:n] + rest[at : at + size]
        at += size
        yield key, n


def _prefix(a: bytes, b: bytes, known: int) -> int:
    """Length of the common prefix, of which ``known`` bytes need no look."""
    x = int.from_bytes(a[known:]) ^ int.from_bytes(b[known:])
    return len(a) - (x.bit_length() + 7) // 8


def merge_runs(runs: list) -> tuple[list[bytes], list[int], list[int]]:
    """Loser tree over front-coded runs: (keys, common prefix with the key before, run of each).

    A contestant carries how much it shares with the last winner.  The one that
    shares more is smaller; only at equal lengths are bytes compared, from there on.
    """
    width = 1
    while width < max(1, len(runs)):
        width *= 2
    heads: list = [next(r, None) for r in runs] + [None] * (width - len(runs))
    keys = [h[0] if h else None for h in heads]
    shared = [0] * width
    losers = [-1] * width

    def play(i: int, j: int) -> tuple[int, int]:
        """(winner, loser); the loser's length becomes the one it shares with the winner."""
        if keys[i] is None or keys[j] is None:
            return (j, i) if keys[i] is None else (i, j)
        if shared[i] != shared[j]:
            return (i, j) if shared[i] > shared[j] else (j, i)
        n = _prefix(keys[i], keys[j], shared[i])
        if n < _KEY and keys[j][n] < keys[i][n]:
            i, j = j, i
        shared[j] = n
        return i, j

    def build(node: int) -> int:
        if node >= width:
            return node - width
        winner, losers[node] = play(build(2 * node), build(2 * node + 1))
        return winner

    out_keys, out_shared, out_run = [], [], []
    winner = build(1) if width > 1 else 0
    while keys[winner] is not None:
        out_keys.append(keys[winner])
        out_shared.append(shared[winner])
        out_run.append(winner)
        head = next(runs[winner], None)
        keys[winner], shared[winner] = head if head else (None, 0)
        node = (winner + width) // 2
        while node:
            winner, losers[node] = play(winner, losers[node])
            node //= 2
    return out_keys, out_shared, out_run


def _second_pass(joined: DataFrame, buckets: int) -> DataFrame:
    """(sid, tie, intervals): bytes whose window starts earlier elsewhere; intervals are pairs of int32."""
    schema = "bucket int, kind byte, sid long, tie int, shared binary, rest binary, entries binary"

    def row(bucket, kind, sid, tie, shared, rest, entries):
        return C.columns_batch(bucket=np.array(bucket, np.int32), kind=np.array(kind, np.int8), sid=np.array(sid, np.int64), tie=np.array(tie, np.int32),
                               shared=pa.array(shared, pa.binary()), rest=pa.array(rest, pa.binary()), entries=pa.array(entries, pa.binary()))

    def make_run(keys, entries):
        order = sort_keys(keys)
        keys, entries = keys[order], entries[order]
        group = np.cumsum(common_prefixes(keys) < _KEY)
        best, later = earlier_first(entries, group)
        ids, ties, blobs = _marks(entries[later], entries["at"][later] - entries["far"][later], entries["at"][later] - entries["near"][later] + LENGTH)
        if len(ids):
            n = len(ids)
            yield row((C.mix(ids.astype(np.uint64)) % np.uint64(buckets)).astype(np.int32), [1] * n, ids, ties, [b""] * n, [b""] * n, blobs)
        keys, entries = keys[best], entries[best]
        where = keys[:, 0].astype(np.int64) * 256 + keys[:, 1]
        edge = np.flatnonzero(np.concatenate([[True], where[1:] != where[:-1]]))
        for a, b in zip(edge, np.append(edge[1:], len(keys))):
            shared, rest = front_code(keys[a:b])
            yield row([where[a]], [0], [0], [0], [shared], [C.squeezed(rest)], [C.squeezed(_pack(entries[a:b]))])

    def split(batches):
        keys, entries, size = [], [], 0
        for batch in batches:
            packed = batch.column(1).to_pylist()
            for a, b, data, offsets in C.chunked(batch.column(0)):
                of = [_distinct(packed[i]) for i in range(a, b)]
                mine = np.concatenate(of)
                begin = np.repeat(offsets[:-1], [len(x) for x in of])
                end = np.repeat(offsets[1:], [len(x) for x in of])
                keys.append(suffix_keys(data, begin, end, begin + mine["at"], buckets))
                entries.append(mine)
                size += len(mine)
                if size >= RUN:
                    yield from make_run(np.concatenate(keys), np.concatenate(entries))
                    keys, entries, size = [], [], 0
        if size:
            yield from make_run(np.concatenate(keys), np.concatenate(entries))

    def meet(table: pa.Table) -> pa.Table:
        kind = np.asarray(table.column("kind").combine_chunks())
        runs = [i for i in np.flatnonzero(kind == 0)]
        shared, rest, blobs = (table.column(c).to_pylist() for c in ("shared", "rest", "entries"))
        lists = [_unpack(C.restored(blobs[i])) for i in runs]
        keys, prefix, source = merge_runs([_decoded(shared[i], C.restored(rest[i])) for i in runs])
        passed = table.filter(pa.array(kind == 1)).select(["sid", "tie", "entries"])
        kinds = pa.schema([("sid", pa.int64()), ("tie", pa.int32()), ("entries", pa.binary())])
        if not keys:
            return passed.cast(kinds)
        source = np.array(source)
        entries = np.empty(len(keys), ENTRY)
        for k, mine in enumerate(lists):
            entries[source == k] = mine
        ids, ties, found = _repeated(np.frombuffer(b"".join(keys), np.uint8).reshape(-1, _KEY), np.array(prefix), entries)
        return pa.concat_tables([passed.cast(kinds), pa.table({"sid": pa.array(ids, pa.int64()), "tie": pa.array(ties, pa.int32()), "entries": pa.array(found, pa.binary())})])

    return joined.mapInArrow(split, schema).groupBy("bucket").applyInArrow(meet, "sid long, tie int, entries binary")


def _marks(entries, start, end):
    """(sid, tie, intervals) by document; intervals that touch are joined."""
    order = np.lexsort((start, entries["tie"], entries["sid"]))
    sid, tie, start, end = entries["sid"][order], entries["tie"][order], start[order].astype(np.int64), end[order].astype(np.int64)
    if not len(sid):
        return sid, tie, []
    new = np.concatenate([[True], (sid[1:] != sid[:-1]) | (tie[1:] != tie[:-1])])
    edge = np.flatnonzero(new)
    blobs = [union(np.stack([start[a:b], end[a:b]], 1)).astype(np.int32).tobytes() for a, b in zip(edge, np.append(edge[1:], len(sid)))]
    return sid[edge], tie[edge], blobs


def union(spans: np.ndarray) -> np.ndarray:
    """Maximal runs covered by intervals that are sorted by their start."""
    if len(spans) < 2:
        return spans
    reach = np.maximum.accumulate(spans[:, 1])
    first = np.concatenate([[True], spans[1:, 0] > reach[:-1]])
    return np.stack([spans[first, 0], reach[np.append(np.flatnonzero(first)[1:], len(spans)) - 1]], 1)


def _repeated(keys: np.ndarray, prefix: np.ndarray, entries: np.ndarray):
    """Intervals of the windows of sorted suffixes that start earlier elsewhere in the bucket."""
    group = np.cumsum(prefix < _KEY)
    best, later = earlier_first(entries, group)
    whole = entries[later]
    found = [(whole, whole["at"].astype(np.int64) - whole["far"], whole["at"].astype(np.int64) - whole["near"] + LENGTH)]
    # Of equal suffixes one stands for all: the earliest.  Left are different ones that share the gram.
    lead = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    keys, entries, shared = keys[lead], entries[best], prefix[lead]
    near = shared >= 2 + GRAM
    near[:1] = False
    company = near | np.append(near[1:], False)
    keys, entries, shared = keys[company], entries[company], shared[company]
    if len(keys):
        right = shared - 2
        left_keys = keys[:, 2 + LENGTH : -2]
        order = sort_keys(np.concatenate([left_keys, np.full((len(left_keys), 1), 1, np.uint8)], 1))
        left = np.empty(len(keys), np.int64)
        left_shared = common_prefixes(left_keys[order])
        rank = np.empty(len(keys), np.int64)
        rank[np.lexsort((entries["at"], entries["tie"], entries["sid"]))] = np.arange(len(keys))
        at = entries["at"].astype(np.int64)
        hit = np.zeros((len(keys), _BEFORE + 2), bool)
        for before in range(_BEFORE + 1):
            valid = np.flatnonzero((entries["far"] >= before) & (entries["near"] <= before))
            if len(valid) < 2:
                continue
            by_right = np.cumsum(right < LENGTH - before)
            left[order] = np.cumsum(left_shared < before)
            key = by_right[valid] * (len(keys) + 1) + left[valid]
            o = np.lexsort((rank[valid], key))
            again = np.concatenate([[False], key[o[1:]] == key[o[:-1]]])
            hit[valid[o[again]], before] = True
        # Flagged distances before the anchor come in runs; each run is one interval of bytes.
        steps = np.diff(np.concatenate([np.zeros((len(keys), 1), np.int8), hit.astype(np.int8)], 1), axis=1)
        who, first = np.nonzero(steps == 1)
        _, stop = np.nonzero(steps == -1)
        found.append((entries[who], at[who] - (stop - 1), at[who] - first + LENGTH))
    return _marks(np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found]), np.concatenate([f[2] for f in found]))


def remove_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, kept, n_bytes, n_removed, n_spans, spans) of every row; ``kept`` is binary, ``spans`` removed byte ranges.

    A byte goes if a 100-byte string covers it that also starts earlier: in a
    smaller doc_id (NULL first) or earlier in the same text.  Rows with equal
    id and text are one document; different texts under one id are ordered by a
    hash.  A NULL text is empty.
    """
    spark = docs.sparkSession
    buckets = min(1 << 16, 4 * C.partitions(spark))
    keyed = _keyed(docs)
    found = _first_pass(keyed, buckets).groupBy("sid", "tie").agg(F.collect_list("entries").alias("entries"))
    marked = _second_pass(keyed.join(found, ["sid", "tie"]).select("text", "entries"), buckets)
    spans = marked.groupBy("sid", "tie").agg(F.collect_list("entries").alias("entries"))

    def cut(batches):
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            kept, sizes, gone, runs = [], [], [], []
            for text, blobs in zip(batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist()):
                pairs = np.frombuffer(b"".join(blobs or ()), np.int32).reshape(-1, 2)
                pairs = union(pairs[np.argsort(pairs[:, 0], kind="stable")]).tolist()
                edges = [0, *[x for pair in pairs for x in pair], len(text)]
                kept.append(b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2])))
                sizes.append(len(text))
                gone.append(len(text) - len(kept[-1]))
                runs.append([{"start": a, "end": b} for a, b in pairs])
            yield C.columns_batch(doc_id=batch.column(0), kept=pa.array(kept, pa.binary()), n_bytes=pa.array(sizes, pa.int64()), n_removed=pa.array(gone, pa.int64()),
                                  n_spans=pa.array([len(r) for r in runs], pa.int64()), spans=pa.array(runs, kind))

    whole = keyed.join(spans, ["sid", "tie"], "left").select(F.when(F.col("sid") != _FIRST, F.col("sid")).alias("doc_id"), "text", "entries")
    return whole.mapInArrow(cut, "doc_id long, kept binary, n_bytes long, n_removed long, n_spans long, spans array<struct<start:int,end:int>>")


def op8_suffix(spark, folder: str) -> DataFrame:
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    return remove_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
