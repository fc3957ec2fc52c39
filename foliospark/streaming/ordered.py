"""State by document: blocks in any order of arrival, answered in the order of the document.

A document's blocks are numbered from 0 without gaps. What a block needs from those before it - the last translation
as context, the recent ones, how the checks went so far - is handed out once all blocks before it are there. Later ones
wait in keyed state. A block that comes again is ignored. When the last block has been handed out a row `complete`
follows; its state goes after `keep`. A document that hears nothing for `idle` ends with a row `incomplete`.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from foliospark.operators.translate import ERROR

#: What comes in. total: the number of blocks, on any row that knows it.
BLOCK = "at int, en string, zh string, outcome string, total int"
#: What goes out: a block with what was known before it (kind block), or the end of a document (complete, incomplete; at: blocks handed out).
RESULT = "kind string, at int, en string, zh string, prev_en string, prev_zh string, remembered int, seen int, passed int, retried int, failed int"
REMEMBERED = 10
PASSED = ("passed", "fast_accepted")


def is_good(zh: str | None) -> bool:
    return bool(zh) and not zh.startswith(ERROR)


class _Progress:
    """The small part of a document's state."""

    SCHEMA = "next int, total int, over boolean, prev_en string, prev_zh string, passed int, retried int, failed int, timer long"

    def __init__(self, kept: tuple | None) -> None:
        self.next, self.total, self.over, self.prev_en, self.prev_zh, self.passed, self.retried, self.failed, self.timer = kept or (0, None, False, None, None, 0, 0, 0, None)

    def tuple(self) -> tuple:
        return self.next, self.total, self.over, self.prev_en, self.prev_zh, self.passed, self.retried, self.failed, self.timer


class InOrder(StatefulProcessor):
    def __init__(self, keep: int, idle: int) -> None:
        self.keep, self.idle = keep, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.progress = handle.getValueState("progress", _Progress.SCHEMA)
        self.recent = handle.getListState("recent", "en string, zh string")
        self.waiting = handle.getMapState("waiting", "at int", "en string, zh string, outcome string")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        state = _Progress(self.progress.get())
        recent = [tuple(x) for x in self.recent.get()]
        for frame in rows:
            known = frame["total"].dropna()
            if len(known):
                state.total = int(known.max())
            out, here = [], {}
            for at, en, zh, outcome in frame[["at", "en", "zh", "outcome"]].astype(object).where(frame[["at", "en", "zh", "outcome"]].notna(), None).itertuples(index=False):
                if at >= state.next and not state.over:
                    here[int(at)] = (en, zh, outcome)
            while True:
                if state.next in here:
                    block = here.pop(state.next)
                elif self.waiting.exists() and self.waiting.containsKey((state.next,)):
                    block = tuple(self.waiting.getValue((state.next,)))
                    self.waiting.removeKey((state.next,))
                else:
                    break
                out.append(self._handed_out(state, recent, block))
            for at, block in here.items():
                self.waiting.updateValue((at,), block)
            if out:
                yield self._frame(key, out)
        if state.total is not None and state.next >= state.total and not state.over:
            state.over = True
            yield self._frame(key, [self._end(state, recent, "complete")])
        if recent:
            self.recent.put(recent)
        self._watch(state, timerValues.getCurrentProcessingTimeInMs() + (self.keep if state.over else self.idle))
        self.progress.update(state.tuple())

    def _handed_out(self, state: _Progress, recent: list[tuple], block: tuple) -> tuple:
        en, zh, outcome = block
        row = ("block", state.next, en, zh, state.prev_en, state.prev_zh, len(recent), state.next, state.passed, state.retried, state.failed)
        if is_good(zh):
            state.prev_en, state.prev_zh = en, zh
            recent.append((en, zh))
            del recent[:-REMEMBERED]
        state.passed += outcome in PASSED
        state.retried += outcome == "retried"
        state.failed += outcome == "failed"
        state.next += 1
        return row

    @staticmethod
    def _end(state: _Progress, recent: list[tuple], kind: str) -> tuple:
        return kind, state.next, None, None, state.prev_en, state.prev_zh, len(recent), state.next, state.passed, state.retried, state.failed

    @staticmethod
    def _frame(key: Any, rows: list[tuple]) -> pd.DataFrame:
        names = ["doc_id", *(c.split()[0] for c in RESULT.split(", "))]
        return pd.DataFrame([(key[0], *r) for r in rows], columns=names)

    def _watch(self, state: _Progress, until: int) -> None:
        if state.timer is not None:
            self.handle.deleteTimer(state.timer)
        self.handle.registerTimer(until)
        state.timer = until

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        state = _Progress(self.progress.get())
        if not state.over:
            yield self._frame(key, [self._end(state, [tuple(x) for x in self.recent.get()], "incomplete")])
        for kept in (self.progress, self.recent, self.waiting):
            kept.clear()

    def close(self) -> None:
        pass


def in_order(blocks: DataFrame, keep: int = 600_000, idle: int = 3_600_000) -> DataFrame:
    """(doc_id, RESULT) of a stream of blocks (doc_id, BLOCK). keep, idle: milliseconds."""
    kind = blocks.schema["doc_id"].dataType.simpleString()
    own = blocks.select("doc_id", *(F.col(c.split()[0]).cast(c.split()[1]) for c in BLOCK.split(", "))).where("at is not null")
    return own.groupBy("doc_id").transformWithStateInPandas(InOrder(keep, idle), f"doc_id {kind}, {RESULT}", "append", "processingTime")


def in_order_batch(blocks: DataFrame) -> DataFrame:
    """The rows of kind `block` that in_order gives, of a whole table."""
    before = Window.partitionBy("doc_id").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    good = F.col("zh").isNotNull() & (F.col("zh") != "") & ~F.col("zh").startswith(ERROR)
    last = F.last(F.when(good, F.struct("en", "zh")), ignorenulls=True).over(before)
    count = lambda c: F.coalesce(F.count_if(c).over(before), F.lit(0)).cast("int")
    found = blocks.withColumn("_last", last).withColumn("_good", count(good))
    return found.select(
        "doc_id", F.lit("block").alias("kind"), "at", "en", "zh", F.col("_last.en").alias("prev_en"), F.col("_last.zh").alias("prev_zh"), F.least("_good", F.lit(REMEMBERED)).alias("remembered"), F.col("at").alias("seen"),
        count(F.col("outcome").isin(*PASSED)).alias("passed"), count(F.col("outcome") == "retried").alias("retried"), count(F.col("outcome") == "failed").alias("failed"),
    )
