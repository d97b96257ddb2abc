"""Chat as streams: tokenize before storing, clean and resolve answers, expire and rate-limit.

Stateless steps are the same column expressions as in batch.  Order-dependent
steps keep a few characters of state per session in a state processor.
"""

from __future__ import annotations

import heapq
import itertools
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .. import catalog as C
from ..functions import crypto
from ..operators import restore as R
from ..operators import tokenize as T
from ..operators import vault as V

CLEAN_CHUNKS = "session_id string, seq bigint, content string, done boolean"
MESSAGES_OUT = "session_id string, seq bigint, content string"
PART_CHARS = 1 << 20  # an open answer goes to the state in parts of about so many characters
_HALF_TOKEN = re.compile(r"\[(?:[A-Z_]{0,31}(?:_[0-9a-f]{0,8})?)?$")


def read_stream(spark: SparkSession, path: str, schema: str, files_per_batch: int = 1) -> DataFrame:
    """A folder of JSON files as a stream (a message bus connector is a drop-in source)."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).json(path)


def tokenized_requests(requests: DataFrame, text: str = "message", **options) -> DataFrame:
    """Sanitize and tokenize each message; stateless, so it runs on streams and tables alike."""
    return T.tokenize_messages(requests, text, **options)


def store_messages(root: str, key: Column, **options) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` writer: vault rows first, then the tokenized message; plain text is never stored.

    Each batch owns its folders, so a repeated batch overwrites what it wrote.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        made = tokenized_requests(batch, **options).select("message_id", "session_id", "ts", "entities", "tokenized").persist()
        try:
            found = T.token_rows(made, ["session_id"])
            stamp = batch.agg(F.max("ts")).scalar()
            encrypted = T.encrypted_map(found, key)
            rows = V.vault_rows(
                encrypted, F.col("session_id"), F.lit("chat"), F.concat(F.lit("chat:"), F.col("session_id")), stamp
            )
            rows.write.mode("overwrite").parquet(f"{root}/vault/batch={batch_id}")
            made.select(
                "message_id", "session_id", F.lit("user").alias("role"), F.col("tokenized").alias("content"),
                F.col("ts").alias("created_at"),
            ).write.mode("overwrite").parquet(f"{root}/messages/batch={batch_id}")
        finally:
            made.unpersist()

    return write


def merge_messages(root: str, key: Column, stream: str = "chat", buckets: int | None = None, **options) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` writer like :func:`store_messages` that merges each batch into one stored vault (``root``/vault).

    Only the buckets of the batch's sessions are rewritten.  Batches are noted in
    the vault by ``stream`` and number: a repeated batch whose merge had ended
    leaves the vault alone, and one broken off is merged again to the same rows.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        made = tokenized_requests(batch, **options).select("message_id", "session_id", "ts", "entities", "tokenized").persist()
        try:
            last = made.groupBy("session_id").agg(F.max("ts").alias("stamp"))
            found = T.token_rows(made, ["session_id"]).join(last, "session_id").withColumn(
                "ciphertext", crypto.encrypt(F.col("value"), key))
            rows = found.select(
                F.lit("session").alias("scope_type"), F.col("session_id").cast("string").alias("scope_id"), "token", "ciphertext",
                F.lit("chat").alias("key_id"), F.concat(F.lit("chat:"), "session_id").alias("filename"), F.col("stamp").cast("timestamp").alias("written_at"))
            V.store(batch.sparkSession, rows, f"{root}/vault", buckets, (stream, batch_id))
            made.select(
                "message_id", "session_id", F.lit("user").alias("role"), F.col("tokenized").alias("content"),
                F.col("ts").alias("created_at"),
            ).write.mode("overwrite").parquet(f"{root}/messages/batch={batch_id}")
        finally:
            made.unpersist()

    return write


def strip_thinking(text: str, inside: bool) -> tuple[str, bool, str]:
    """Visible part of a text, whether it ends inside a block, and a tail that may be half a tag."""
    shown = []
    while text:
        tag = C.THINK_CLOSE if inside else C.THINK_OPEN
        before, found, rest = text.partition(tag)
        if found:
            if not inside:
                shown.append(before)
            inside, text = not inside, rest
            continue
        keep = next((n for n in range(min(len(tag) - 1, len(text)), 0, -1) if tag.startswith(text[-n:])), 0)
        if not inside:
            shown.append(text[: len(text) - keep])
        return "".join(shown), inside, text[len(text) - keep:] if keep else ""
    return "".join(shown), inside, ""


def in_order(rows: Iterator[pd.DataFrame], size: int = 1 << 16) -> Iterator[tuple[int, str, bool]]:
    """(seq, content, done) of a session's rows of one batch by seq, without one frame that holds them all.

    Rows come in parts of any order.  Each part is sorted by itself; parts whose
    ranges do not meet follow each other, others are merged row by row.
    """
    parts = []
    for frame in rows:
        for a in range(0, len(frame), size):
            part = frame.iloc[a : a + size].sort_values("seq", kind="stable")
            parts.append((part["seq"].to_numpy(), part["content"].to_numpy(object), part["done"].to_numpy(object)))
    parts.sort(key=lambda p: p[0][0])
    merged = heapq.merge(*(zip(p[0].tolist(), itertools.repeat(k), range(len(p[0]))) for k, p in enumerate(parts)))
    for seq, k, i in merged:
        yield seq, parts[k][1][i] or "", bool(parts[k][2][i])


def _frames(rows: Iterator[tuple], columns: list[str], size: int = 1 << 14) -> Iterator[pd.DataFrame]:
    """Rows as frames of at most ``size``."""
    while part := list(itertools.islice(rows, size)):
        yield pd.DataFrame(part, columns=columns).astype({"seq": "int64"})


class CleanChunks(StatefulProcessor):
    """Drop reasoning blocks and hold back half a tag or half a token until the rest arrives.

    Chunks count in order of ``seq`` as far as they are there when a batch runs.
    A chunk with a smaller ``seq`` than one already handed out is late: it cannot
    be put back in its place and is dropped, and so is a repeated one.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("clean", "inside boolean, tag_tail string, token_tail string, seq bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        inside, tag_tail, token_tail, last = self.state.get() if self.state.exists() else (False, "", "", None)

        def cleaned():
            nonlocal inside, tag_tail, token_tail, last
            for seq, content, done in in_order(rows):
                if last is not None and seq <= last:
                    continue
                last = seq
                shown, inside, tag_tail = strip_thinking(tag_tail + content, inside)
                ready = token_tail + shown
                if done:
                    ready += "" if inside else tag_tail
                    inside, tag_tail, token_tail = False, "", ""
                else:
                    half = _HALF_TOKEN.search(ready[-64:])
                    token_tail = half.group(0) if half else ""
                    ready = ready[: len(ready) - len(token_tail)]
                yield key[0], seq, ready, done

        yield from _frames(cleaned(), ["session_id", "seq", "content", "done"])
        self.state.update((inside, tag_tail, token_tail, last))

    def close(self) -> None:
        pass


class AssembleMessages(StatefulProcessor):
    """Collect cleaned chunks until ``done`` and give the whole answer once.

    Pieces of an open answer are kept as list state and read once, when it ends.
    Late and repeated chunks, whose ``seq`` is not above the last one, are dropped.
    With ``idle_ms`` an answer that gets no chunk for so long (event time) is
    given as it is, with the ``seq`` of its last chunk.
    """

    def __init__(self, idle_ms: int | None = None):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.parts = handle.getListState("parts", "content string")
        self.last = handle.getValueState("last", "seq bigint")

    def _whole(self, more: list[str]) -> str:
        held = "".join(p[0] for p in self.parts.get()) if self.parts.exists() else ""
        return held + "".join(more)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        last = self.last.get()[0] if self.last.exists() else None
        open_parts: list[str] = []

        def assembled_rows():
            nonlocal last
            size = 0
            for seq, content, done in in_order(rows):
                if last is not None and seq <= last:
                    continue
                last = seq
                open_parts.append(content)
                size += len(content)
                if done:
                    text = self._whole(open_parts)
                    self.parts.clear()
                    open_parts.clear()
                    size = 0
                    if text:
                        yield key[0], seq, text
                elif size > PART_CHARS:
                    self.parts.appendValue(("".join(open_parts),))
                    open_parts.clear()
                    size = 0

        yield from _frames(assembled_rows(), ["session_id", "seq", "content"])
        if any(open_parts):
            self.parts.appendValue(("".join(open_parts),))
        if last is not None:
            self.last.update((last,))
        if self.idle_ms is not None:
            for due in list(self.handle.listTimers()):
                self.handle.deleteTimer(due)
            if self.parts.exists():
                self.handle.registerTimer(max(timerValues.getCurrentWatermarkInMs(), 0) + self.idle_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        text = self._whole([])
        self.parts.clear()
        if text:
            yield pd.DataFrame({"session_id": [key[0]], "seq": [self.last.get()[0]], "content": [text]})

    def close(self) -> None:
        pass


class LiveTokens(StatefulProcessor):
    """Token count of a session; all its state goes a fixed time after the last write to any of its tokens."""

    def __init__(self, ttl_ms: int):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.tokens = handle.getMapState("tokens", "token string", "seen boolean")
        self.count = handle.getValueState("count", "n bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        total = self.count.get()[0] if self.count.exists() else 0
        for batch in rows:
            for token in batch["token"].drop_duplicates():
                total += 0 if self.tokens.containsKey((token,)) else 1
                self.tokens.updateValue((token,), (True,))
        self.count.update((total,))
        for due in list(self.handle.listTimers()):
            self.handle.deleteTimer(due)
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.ttl_ms)
        yield pd.DataFrame({"session_id": [key[0]], "token_count": [total]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.tokens.clear()
        self.count.clear()
        yield pd.DataFrame({"session_id": [key[0]], "token_count": [0]})

    def close(self) -> None:
        pass


def clean_chunks(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("session_id").transformWithStateInPandas(
        statefulProcessor=CleanChunks(), outputStructType=CLEAN_CHUNKS, outputMode="Append", timeMode="None"
    )


def assemble_messages(chunks: DataFrame, ts: str | None = None, late: str = "10 minutes", idle_ms: int = 3_600_000) -> DataFrame:
    """Whole answers of cleaned chunks; with an event time ``ts``, answers left open for ``idle_ms`` are given as they are."""
    if ts is None:
        return chunks.groupBy("session_id").transformWithStateInPandas(
            statefulProcessor=AssembleMessages(), outputStructType=MESSAGES_OUT, outputMode="Append", timeMode="None"
        )
    return chunks.withWatermark(ts, late).groupBy("session_id").transformWithStateInPandas(
        statefulProcessor=AssembleMessages(idle_ms), outputStructType=MESSAGES_OUT, outputMode="Append", timeMode="EventTime"
    )


def live_token_counts(token_stream: DataFrame, ttl_days: float = C.VAULT_TTL_DAYS) -> DataFrame:
    """Token count of a session at each change; 0 when it expires, one timer per session."""
    return token_stream.groupBy("session_id").transformWithStateInPandas(
        statefulProcessor=LiveTokens(int(ttl_days * 86_400_000)), outputStructType="session_id string, token_count bigint",
        outputMode="Update", timeMode="ProcessingTime",
    )


def resolve_chunks(
    root: str, vault: DataFrame | str, sessions: DataFrame, key: Column
) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` writer of resolved chunks and their audit rows.

    ``sessions`` gives user, dataset and allowed labels of each session.  ``vault``
    is a table, or the path of a stored vault: then each batch reads the vault as
    it is by then, and only the buckets of its own sessions and datasets.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        staged = batch.join(sessions, "session_id", "left").withColumn(
            "chunk_id", F.concat_ws(":", "session_id", F.col("seq").cast("string"))
        ).persist()  # what a stream made is made once
        rows = vault
        if isinstance(vault, str):
            scopes = staged.select(F.inline(F.array(
                F.struct(F.lit("session").alias("scope_type"), F.col("session_id").cast("string").alias("scope_id")),
                F.struct(F.lit("dataset").alias("scope_type"), F.col("dataset_id").cast("string").alias("scope_id")))))
            rows = V.stored_for(batch.sparkSession, vault, scopes.filter("scope_id is not null"))
        done = R.resolve(
            staged, rows, "chunk_id", "content", session="session_id", dataset="dataset_id", allowed="allowed", key=key
        )
        done.persist()  # both outputs come from one join and one decryption
        try:
            shown = R.audit_rows(done, ["user_id", "dataset_id", "session_id", "seq"], "content")
            shown.withColumn("created_at", F.current_timestamp()).write.mode("overwrite").parquet(f"{root}/audit/batch={batch_id}")
            done.select("session_id", "seq", F.col("resolved").alias("content"), "done").write.mode("overwrite").parquet(
                f"{root}/chunks/batch={batch_id}"
            )
        finally:
            done.unpersist()
            staged.unpersist()

    return write


def session_activity(messages: DataFrame) -> DataFrame:
    """First and last message time per session; run in update mode."""
    return messages.groupBy("session_id").agg(
        F.min("ts").alias("created_at"), F.max("ts").alias("updated_at"), F.count(F.lit(1)).alias("n_messages")
    )


def over_rate(events: DataFrame, key: str, ts: str, limit: int, late: str = "5 minutes", width: str = "1 minute") -> DataFrame:
    """Keys with more than ``limit`` events in a tumbling window."""
    counted = events.withWatermark(ts, late) if events.isStreaming else events
    per_window = counted.groupBy(key, F.window(ts, width).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return per_window.select(
        key, F.col("w.start").alias("window_start"), "n", (F.col("n") > limit).alias("over_limit")
    )


def once_per_message(messages: DataFrame, id: str = "message_id", ts: str = "ts", late: str = "10 minutes") -> DataFrame:
    """Drop repeated messages that arrive within the allowed lateness."""
    if messages.isStreaming:
        return messages.withWatermark(ts, late).dropDuplicatesWithinWatermark([id])
    return messages.dropDuplicates([id])


def assembled(chunks: DataFrame) -> DataFrame:
    """Batch form of the assembly: chunks up to each ``done`` as one message.

    Each chunk belongs to the first ``done`` at or after it; the search runs
    inside blocks of 1,024 sequence numbers with one carried value per block.
    """
    from pyspark.sql import Window

    block = F.floor(F.col("seq") / 1024)
    staged = chunks.withColumn("_block", block)
    inside = Window.partitionBy("session_id", "_block").orderBy("seq").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    near = staged.withColumn("_end", F.min(F.when(F.col("done"), F.col("seq"))).over(inside))
    firsts = staged.groupBy("session_id", "_block").agg(F.min(F.when(F.col("done"), F.col("seq"))).alias("_first"))
    after = Window.partitionBy("session_id").orderBy("_block").rowsBetween(1, Window.unboundedFollowing)
    carried = firsts.withColumn("_next", F.min("_first").over(after)).select("session_id", "_block", "_next")
    placed = near.join(carried, ["session_id", "_block"]).withColumn("_end", F.coalesce("_end", "_next"))
    whole = placed.filter(F.col("_end").isNotNull()).groupBy("session_id", F.col("_end").alias("seq")).agg(
        F.sort_array(F.collect_list(F.struct(F.col("seq").alias("s"), F.coalesce("content", F.lit("")).alias("c")))).alias("_parts")
    )
    text = F.array_join(F.transform("_parts", lambda p: p["c"]), "")
    return whole.select("session_id", "seq", text.alias("content")).filter(F.length("content") > 0)

