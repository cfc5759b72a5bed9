"""Streams into the store, and conversation memory as keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from docloom.sources.store import MOST_DELTAS, Store


def ingest_stream(rows: DataFrame, store: Store, name: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Merge each micro-batch into the store by key: a document may come in parts, and a replayed batch changes nothing. Deltas are compacted now and then."""

    def merge(df: DataFrame, _: int) -> None:
        store.merge(name, df)
        if store.deltas(name) > MOST_DELTAS:
            store.compact(name)

    writer = rows.writeStream.option("checkpointLocation", checkpoint).foreachBatch(merge)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def last_by_conversation(turns: DataFrame, key: str = "conversation_id", turn: str = "turn", value: str = "article_id") -> DataFrame:
    """(key, value, turn) of each conversation's last turn; the batch form of conversation_memory()."""
    return turns.groupBy(key).agg(F.max_by(value, turn).alias(value), F.max(turn).alias(turn))


class LastArticle(StatefulProcessor):
    """The last article of a conversation, in a value that idle conversations lose after a time."""

    def __init__(self, ttl_ms: int) -> None:
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "turn long, article_id string", self.ttl_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803  names of the base class
        turn, article = self.last.get() if self.last.exists() else (-1, None)
        for pdf in rows:
            own = pdf.sort_values("turn").iloc[-1]
            if own["turn"] > turn:
                turn, article = int(own["turn"]), own["article_id"]
        self.last.update((turn, article))
        yield pd.DataFrame({"conversation_id": [key[0]], "turn": [turn], "article_id": [article]})

    def close(self) -> None:
        pass


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def conversation_state(turns: DataFrame, ttl_ms: int = 30 * 60 * 1000) -> DataFrame:
    """The last article of each conversation from a stream of turns (conversation_id, turn, article_id), in update mode.

    State is kept in RocksDB (set spark.sql.streaming.stateStore.providerClass to ROCKSDB) and lasts over restarts from the
    same checkpoint; state_of() reads it.
    """
    return turns.groupBy("conversation_id").transformWithStateInPandas(statefulProcessor=LastArticle(ttl_ms), outputStructType="conversation_id string, turn long, article_id string", outputMode="Update", timeMode="ProcessingTime")


def state_of(spark: SparkSession, checkpoint: str) -> DataFrame:
    """(conversation_id, turn, article_id) that a stream of conversation_state() has in its state, as of its last batch."""
    rows = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "last").load()
    value = F.col("value.value") if "value" in [f.name for f in rows.schema["value"].dataType] else F.col("value")
    return rows.select("key.conversation_id", value["turn"].alias("turn"), value["article_id"].alias("article_id"))


def remember(store: Store, turns: DataFrame, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Turns of a stream into the store's conversations, where ask() finds them: later turns of a conversation replace earlier ones."""

    def merge(df: DataFrame, _: int) -> None:
        last = last_by_conversation(df).select(F.col("conversation_id").alias("document_id"), "article_id", "turn")
        held = store.read("conversations").select("document_id", F.col("turn").alias("before"))
        newer = last.join(held, "document_id", "left").filter("before IS NULL OR turn > before").drop("before")
        store.merge("conversations", newer.withColumn("seen", F.current_timestamp()))
        if store.deltas("conversations") > MOST_DELTAS:
            store.compact("conversations")

    writer = turns.writeStream.option("checkpointLocation", checkpoint).foreachBatch(merge)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def conversation_memory(turns: DataFrame, timeout_ms: int = 30 * 60 * 1000) -> DataFrame:
    """The last article of each conversation from turns (conversation_id, turn, article_id); idle conversations are forgotten."""

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        turn, article = state.get if state.exists else (-1, None)
        for pdf in frames:
            last = pdf.sort_values("turn").iloc[-1]
            if last["turn"] > turn:
                turn, article = int(last["turn"]), last["article_id"]
        state.update((turn, article))
        state.setTimeoutDuration(timeout_ms)
        yield pd.DataFrame({"conversation_id": [key[0]], "turn": [turn], "article_id": [article]})

    return turns.groupBy("conversation_id").applyInPandasWithState(update, "conversation_id string, turn long, article_id string", "turn long, article_id string", "update", GroupStateTimeout.ProcessingTimeTimeout)
