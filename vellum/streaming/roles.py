"""Roles of paragraphs as they arrive: each document's automaton goes on where it stopped.

What needs no state is a column, as in a batch. A document's state is the place it waits for, the automaton's state there and
the head of pseudo-code that is open; paragraphs that came too early wait in the state store, one entry each, and leave it
when they are decided. So a task holds what arrived now and what is decided now, never a document.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from vellum.operators import classify

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUT = "doc_id bigint, pos bigint, role string, level int, head bigint"
WAITING = "kind string, level int, says bigint, made array<bigint>, blank boolean, last boolean"


class Roles(StatefulProcessor):
    """Decides a document's paragraphs in order. One is decided when what stands after it says whether pseudo-code goes on: with
    the next paragraph that isn't blank, or with the last."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.now = handle.getValueState("now", "next bigint, state bigint, head bigint")
        self.waiting = handle.getMapState("waiting", "pos bigint", WAITING)

    def handleInputRows(self, key, rows: Iterator[Row], timer_values) -> Iterator[Row]:  # noqa: N802
        at, state, head = self.now.get() if self.now.exists() else (0, 0, None)
        came: dict[int, tuple] = {}
        for r in rows:  # of equal places in one batch the smallest counts, whatever their order
            if r["pos"] is not None and r["pos"] >= at:
                x = (r["kind"], r["level"], r["says"], tuple(r["made"]), r["blank"], r["last"])
                came[r["pos"]] = min(came.get(r["pos"], x), x)
        early = {p for p in came if self.waiting.containsKey((p,))}
        run, where = [], at
        while not (run and run[-1][5]):  # nothing counts after the last paragraph
            if where in came and where not in early:
                run.append(came[where])
            elif where in early or self.waiting.containsKey((where,)):
                run.append(tuple(self.waiting.getValue((where,))))
            else:
                break
            where += 1
        says, ahead, known = classify.STOPS, [], bool(run and run[-1][5])
        for x in reversed(run):
            ahead.append(says if known else None)
            known = known or not x[4]  # a paragraph that isn't blank says the same whatever follows
            says = x[2] >> 4 * says & 15
        start = at
        for x, following in zip(run, reversed(ahead)):
            if following is None:
                break
            made = x[3][9 * following : 9 * following + 9]
            number, before, state = made[state] >> 4, state, made[state] & 15
            coded = number == classify.ALGORITHM_ROLE
            inside = coded and before >= classify.CODE and made[before] != made[classify.BODY]
            head = head if inside else at if coded else head
            role = x[0] if x[0] != "p" else classify.ROLES[number]
            if role:
                yield Row(doc_id=key[0], pos=at, role=role, level=x[1] if role == "heading" else 0, head=head if coded else at)
            at += 1
            if x[5]:
                at = 2**62  # what still comes is late
        self.now.update((at, state, head))
        for p in range(start, min(at, start + len(run))):
            if p not in came or p in early:
                self.waiting.removeKey((p,))
        for p, x in came.items():
            if p >= at and p not in early:
                self.waiting.updateValue((p,), (*x[:3], list(x[3]), *x[4:]))

    def close(self) -> None:
        pass


def arriving(told: DataFrame) -> DataFrame:
    """doc_id, pos, role, level, head of a stream of items, each once, as roles_by_scan() gives them for whole documents.

    told: the columns of classify.told_of() and last, true for a document's last item (null: false). Places are 0, 1, 2... without
    gaps. A document's items may come in any order and any batch: one waits until all before it are there. An item that
    comes again is left out, whatever it says: the first to arrive counts. Items after the last one, with places below 0, or
    without a document or place are left out; a document without its last item keeps what isn't decided. A session with Spark's
    default state store gets RocksDB's, which alone holds states of several kinds."""
    spark = told.sparkSession
    if spark.conf.get("spark.sql.streaming.stateStore.providerClass").endswith("HDFSBackedStateStoreProvider"):
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    made = F.concat(*[classify.made_of(F.lit(a)) for a in (classify.STOPS, classify.GOES_ON, classify.AFTER_BLANK)])
    own = classify.automaton_facts(told.withColumn("last", F.coalesce("last", F.lit(False))), ["last"])
    own = own.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("pos").cast("bigint").alias("pos"), "kind", F.col("level").cast("int").alias("level"), "says", made.alias("made"), "blank", "last")
    return own.groupBy("doc_id").transformWithState(statefulProcessor=Roles(), outputStructType=OUT, outputMode="Append", timeMode="None")


def watch(told: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Adds the roles of what has arrived to the Parquet table `out`, and ends; run again, it goes on where it stopped."""
    return arriving(told).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
