"""Commands as a second input of a stream: rows and commands of a channel are put into one order before either acts.

Both inputs have their own watermark. Rows and commands wait in the state until the watermark, the least of both, has
passed them, and then take effect in the order of their time, commands first; so the result does not depend on how they
came in batches. A silent control input holds the rows back: it sends a command without an action now and then (a
heartbeat, for any channel) as a sign that nothing was said until then. What arrives behind the watermark is dropped."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from kerbside.operators.control import ADD, ANALYTICS, REMOVE, REVIEW, SETUP
from kerbside.streaming.pipelines import FIRST_MS, on_clock

COMMANDS = "channel_id long, pts_ms long, command_id long, action string"
PHASED = "channel_id long, pts_ms long, det_ord long, phase string, epoch long, epoch_ms long, old_phase string"
_NAMES = [x.split()[0] for x in PHASED.split(", ")]


class Phases:
    """The machine of one channel. ``phase`` is None while it is down."""

    def __init__(self, phase: str | None = None, epoch: int = 0, start: int = 0) -> None:
        self.phase, self.epoch, self.start = phase, epoch, start

    def command(self, at: int, action: str | None) -> str | None:
        """The phase before, if this is a change from one phase to another."""
        old = self.phase
        if action is None or (old is None) != (action == ADD):
            return None
        if action == REMOVE:
            self.phase = None
            return None
        self.phase = SETUP if action == ADD else action
        if action in (ADD, ANALYTICS):
            self.epoch, self.start = self.epoch + 1, at
        return old if old is not None and old != self.phase else None


class PhaseProcessor(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.machine = handle.getValueState("machine", "phase string, epoch long, start long")
        self.waiting = handle.getMapState("waiting", "pts_ms long, kind int, number long", "action string")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for part in rows:
            for at, kind, number, action in zip(part["pts_ms"].tolist(), part["kind"].tolist(), part["number"].tolist(), part["action"].tolist()):
                self.waiting.updateValue((at, kind, number), (action,))
                first = at if first is None else min(first, at)
        if first is not None:
            self.handle.registerTimer(first + FIRST_MS)
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        until = timerValues.getCurrentWatermarkInMs()
        held = [(k, v[0]) for k, v in self.waiting.iterator()]
        due = sorted((x for x in held if x[0][0] + FIRST_MS <= until), key=lambda x: x[0])
        later = [k[0] for k, _ in held if k[0] + FIRST_MS > until]
        if later:
            self.handle.registerTimer(min(later) + FIRST_MS)
        channel, found = int(key[0]), []
        machine = Phases(*self.machine.get()) if self.machine.exists() else Phases()
        for (at, kind, number), action in due:
            self.waiting.removeKey((at, kind, number))
            if kind == 0:
                old = machine.command(at, action)
                if old is not None:
                    found.append((channel, at, None, machine.phase, machine.epoch, at - machine.start, old))
            elif machine.phase not in (None, REVIEW):
                found.append((channel, at, number, machine.phase, machine.epoch, at - machine.start, None))
        if due:
            self.machine.update((machine.phase, machine.epoch, machine.start))
        yield pd.DataFrame(found, columns=_NAMES).astype({"det_ord": "Int64"})

    def close(self) -> None:
        pass


def phased(rows: DataFrame, commands: DataFrame, lateness: str = "1 second") -> DataFrame:
    """Streams of rows (``channel_id, pts_ms, det_ord``) and of commands (COMMANDS): PHASED for each row that is processed, and for
    each change of phase (``old_phase`` set, no ``det_ord``)."""
    null = F.lit(None).cast("string")
    a = rows.select("channel_id", "pts_ms", F.lit(1).alias("kind"), F.col("det_ord").alias("number"), null.alias("action"))
    b = commands.select("channel_id", "pts_ms", F.lit(0).alias("kind"), F.col("command_id").alias("number"), "action")
    both = [on_clock(x, lateness) for x in (a, b)]
    return both[0].unionByName(both[1]).groupBy("channel_id").transformWithStateInPandas(
        statefulProcessor=PhaseProcessor(), outputStructType=PHASED, outputMode="Append", timeMode="EventTime"
    )
