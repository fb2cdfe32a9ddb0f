"""Stream operators with state of their own making: bounded job states, validation of two views, log lines out of order.

All three use transformWithState, whose state store is RocksDB: call `use_rocksdb` before such a query starts. State is
kept by key and spread over tasks like any shuffle; a restarted query goes on from its checkpoint.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators import logs
from ..sources import readers
from .lifecycle import CARRIED, CONTEXT, LINE, carry

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


# ------------------------------------------------------------------ jobs of a workflow, at most so many

_KINDS = {"job_submitted": "submitted", "job_started": "running", "job_finished": "finished", "job_error": "error"}
_NONE = (float("-inf"), -1)
JOBS = "workflow_id {w}, job_id long, status string, submit_time double, start_time double, end_time double, duration double, evicted boolean"
_JOB = ", ".join(f"{x}_ts double, {x}_seq long" for x in ("submit", "start", "end", "given", "last")) + ", given double, status string"


class _Jobs(StatefulProcessor):
    """The accumulator's fold of every job of a workflow. Of submission, start, end and given duration the latest (timestamp, seq)
    is kept, so events may come in any order; a start or end before the last submission is of a job that it replaced."""

    def __init__(self, most: int, idle_ms: int | None):
        self.most, self.idle_ms = most, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.jobs = handle.getMapState("jobs", "job_id long", _JOB)
        self.count = handle.getValueState("count", "n long, timer long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        p = pd.concat(list(rows)).sort_values(["timestamp", "seq"])
        n, timer = self.count.get() if self.count.exists() else (0, 0)
        changed = {}
        for job, events in p.groupby("job_id"):
            job = int(job)
            known = self.jobs.containsKey((job,))
            n += not known
            changed[job] = self._fold(tuple(self.jobs.getValue((job,))) if known else (*_NONE * 5, None, None), events)
            self.jobs.updateValue((job,), changed[job])
        gone = self._evict(n - self.most) if n > self.most else {}
        if self.idle_ms:
            if timer:
                self.handle.deleteTimer(timer)
            timer = timerValues.getCurrentProcessingTimeInMs() + self.idle_ms
            self.handle.registerTimer(timer)
        self.count.update((n - len(gone), timer))
        yield _job_rows(key[0], {**changed, **gone}, gone)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """A workflow that has been idle keeps its open jobs only."""
        gone = self._evict(self.most)
        n = self.count.get()[0] if self.count.exists() else 0
        self.count.update((n - len(gone), 0))
        yield _job_rows(key[0], gone, gone)

    @staticmethod
    def _fold(state: tuple, events: pd.DataFrame) -> tuple:
        at = {x: (state[2 * i], state[2 * i + 1]) for i, x in enumerate(("submit", "start", "end", "given", "last"))}
        given, status = state[10:]
        for kind, e in events.drop_duplicates("event_type", keep="last").set_index("event_type").iterrows():  # four at most
            order = (float(e["timestamp"]), int(e["seq"]))
            field = {"job_submitted": "submit", "job_started": "start"}.get(kind, "end")
            at[field] = max(at[field], order)
            if order >= at["last"]:
                at["last"], status = order, _KINDS[kind]
        told = events[(events["event_type"] == "job_finished") & events["duration"].notna()]
        if len(told) and (float(told["timestamp"].iloc[-1]), int(told["seq"].iloc[-1])) >= at["given"]:
            at["given"], given = (float(told["timestamp"].iloc[-1]), int(told["seq"].iloc[-1])), float(told["duration"].iloc[-1])
        return (*[v for pair in at.values() for v in pair], given, status)

    def _evict(self, many: int) -> dict[int, tuple]:
        """The oldest ended jobs leave the state, at most so many; those without an end go last."""
        ended = [(int(k[0]), tuple(v)) for k, v in self.jobs.iterator() if tuple(v)[11] in ("finished", "error")]
        order = lambda x: (_times(x[1])[2] is None, _times(x[1])[2] or 0.0, x[0])
        gone = dict(sorted(ended, key=order)[: max(0, many)])
        for job in gone:
            self.jobs.removeKey((job,))
        return gone


def _times(state: tuple) -> tuple:
    """Submission, start and end that count, and the duration."""
    submit, start, end, given = ((state[2 * i], state[2 * i + 1]) for i in range(4))
    of = lambda order: order[0] if order > _NONE and order >= submit else None
    s, e = of(start), of(end)
    told = state[10] if of(given) is not None else None
    return of(submit), s, e, told if told is not None else e - s if s is not None and e is not None else None


def _job_rows(workflow, jobs: dict[int, tuple], gone: dict) -> pd.DataFrame:
    rows = [(workflow, job, state[11], *_times(state), job in gone) for job, state in jobs.items()]
    names = ["workflow_id", "job_id", "status", "submit_time", "start_time", "end_time", "duration", "evicted"]
    return pd.DataFrame(rows, columns=names).astype({c: "float64" for c in names[3:7]} | {"job_id": "int64", "evicted": "bool"})


def bounded_jobs(events: DataFrame, most: int = 10_000, idle_ms: int | None = None) -> DataFrame:
    """Update-mode stream of the jobs of each workflow, as `state.accumulator_fold` gives them, with at most so many in its state.

    Beyond that the oldest ended jobs leave it, as in `state.bounded`; their last row has evicted true. Open jobs
    stay. With idle_ms, ended jobs of a workflow without events for that long leave, too (use a trigger that keeps running).
    """
    e = events.where("job_id is not null").where(F.col("event_type").isin(*_KINDS)).select("workflow_id", "job_id", "event_type", "timestamp", "seq", "duration")
    out = JOBS.format(w=e.schema["workflow_id"].dataType.simpleString())
    return e.groupBy("workflow_id").transformWithStateInPandas(_Jobs(most, idle_ms), out, "Update", "ProcessingTime" if idle_ms else "None")


# ------------------------------------------------------------------ two views of a job

VIEWS = "e_status string, e_start double, e_at double, l_status string, l_start double, l_at double, open string"
CHANGES = "workflow_id {w}, job_id long, category string, severity string, change string, event_value string, parsed_value string"
_SEVERITY = {"missing_running": "error", "extra_running": "warning", "start_mismatch": "info", "missing_failed": "error"}


class _Views(StatefulProcessor):
    def __init__(self, tolerance: float):
        self.tolerance = tolerance

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.views = handle.getValueState("views", VIEWS)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        p = pd.concat(list(rows)).sort_values("at")
        none = float("-inf")
        e_status, e_start, e_at, l_status, l_start, l_at, open_ = tuple(self.views.get()) if self.views.exists() else (None, None, none, None, None, none, "")
        for source, last in p.drop_duplicates("source", keep="last").set_index("source").iterrows():  # two at most
            start = None if pd.isna(last["start_time"]) else float(last["start_time"])
            if source == "events" and last["at"] >= e_at:
                e_status, e_start, e_at = last["status"], start, float(last["at"])
            elif source == "log" and last["at"] >= l_at:
                l_status, l_start, l_at = last["status"], start, float(last["at"])
        both = e_status == l_status == "running" and e_start is not None and l_start is not None
        found = {
            "missing_running": e_status == "running" and l_status != "running",
            "extra_running": l_status == "running" and e_status != "running" and l_start is not None,
            "start_mismatch": both and abs(e_start - l_start) > self.tolerance,
            "missing_failed": e_status == "error" and l_status != "error",
        }
        now, before = {c for c, ok in found.items() if ok}, set(filter(None, open_.split(",")))
        self.views.update((e_status, e_start, e_at, l_status, l_start, l_at, ",".join(sorted(now))))
        change = [(c, "appears") for c in sorted(now - before)] + [(c, "clears") for c in sorted(before - now)]
        out = [(key[0], int(key[1]), c, _SEVERITY[c], x, e_status, l_status) for c, x in change]
        yield pd.DataFrame(out, columns=[c.split()[0] for c in CHANGES.split(", ")]).astype({"job_id": "int64"})


def validated(event_jobs: DataFrame, log_jobs: DataFrame, tolerance: float = 5.0) -> DataFrame:
    """Append-mode stream of differences between two streams of job states (workflow_id, job_id, status, start_time, at).

    The categories are those of `state.compare_states`. Each of a job's differences has a row when it appears and one when it clears,
    for instance when the slower view has caught up. at orders the states of a job within its view; older ones change nothing.
    """
    columns = ["workflow_id", "job_id", "status", "start_time", "at"]
    both = event_jobs.select(*columns, F.lit("events").alias("source")).unionByName(log_jobs.select(*columns, F.lit("log").alias("source")))
    out = CHANGES.format(w=both.schema["workflow_id"].dataType.simpleString())
    return both.groupBy("workflow_id", "job_id").transformWithStateInPandas(_Views(tolerance), out, "Append", "None")


def into_report(changes: DataFrame, path: str, checkpoint: str):
    """Writes the changes of `validated` to a report; each start of the query begins a session in it."""
    readers.write_report(readers.session_lines(changes.sparkSession).coalesce(1), path)

    def write(batch: DataFrame, _: int) -> None:
        readers.write_discrepancies(batch.withColumn("message", F.concat_ws(" ", "category", "change")), path)

    return changes.writeStream.outputMode("append").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


# ------------------------------------------------------------------ log lines out of order


#: columns that are no numbers, which must not become so where they are empty
_PLAIN = [c.split()[0] for c in f"{LINE}, {CONTEXT}, late boolean".split(", ") if c.split()[1] in ("string", "boolean")]


_KEPT = [{"long": int, "int": int, "double": float, "string": str}[c.split()[1]] for c in LINE.split(", ")[3:]]


class _Lines(StatefulProcessor):
    def __init__(self, most: int, names: list[str]):
        self.most, self.names = most, names

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.context = handle.getValueState("context", CARRIED)
        self.waiting = handle.getMapState("waiting", "line_no long", self.kept())
        self.size = handle.getValueState("size", "n long")

    @staticmethod
    def kept() -> str:
        return ", ".join(LINE.split(", ")[3:])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        state = tuple(self.context.get()) if self.context.exists() else (-1, 0, 0, None, None, False)
        held = self.size.get()[0] if self.size.exists() else 0
        p = pd.concat(list(rows)).drop_duplicates("line_no")
        late = p[p["line_no"] <= state[0]]
        p = p[p["line_no"] > state[0]]
        if held:
            old = [(*key, int(k[0]), *v) for k, v in self.waiting.iterator()]
            p = pd.DataFrame([*old, *p.itertuples(index=False, name=None)], columns=self.names).drop_duplicates("line_no")
        p = p.sort_values("line_no").reset_index(drop=True)
        # lines without a gap from the last one on, and as many more as the buffer has no room for
        ready = int((p["line_no"] == state[0] + 1 + pd.Series(range(len(p)))).cummin().sum()) if len(p) else 0
        ready = max(ready, len(p) - self.most)
        wait = p.iloc[ready:]
        if held:
            self.waiting.clear()
        for row in wait.itertuples(index=False):
            self.waiting.updateValue((int(row[2]),), tuple(None if pd.isna(v) else kind(v) for kind, v in zip(_KEPT, row[3:], strict=True)))
        self.size.update((len(wait),))
        done, state = carry(p.iloc[:ready].copy(), state)
        self.context.update(state)
        out = pd.concat([x for x in (done.assign(late=False), late.assign(late=True)) if len(x)] or [late.assign(late=True)])
        out = out.reindex(columns=[*self.names, *[c.split()[0] for c in CONTEXT.split(", ")], "late"])
        yield out.assign(**{c: pd.Series([None if pd.isna(x) else x for x in out[c]], index=out.index, dtype=object) for c in _PLAIN})


def ordered_log_context(lines: DataFrame, most: int = 10_000) -> DataFrame:
    """`lifecycle.log_context` for lines that come out of order: those beyond a gap wait until it is filled.

    Lines of a run are numbered from 0 without gaps. At most so many wait; if there are more, the first gap is given up. Lines that come after
    that, or again, have late true and no context; nothing is dropped. `logs.facts` reads the rows that aren't late.
    """
    p = logs.parsed(lines, every=True)
    kind = p.schema["workflow_id"].dataType.simpleString()
    names = [c.split()[0] for c in LINE.split(", ")]
    out = f"{LINE.format(w=kind)}, {CONTEXT}, late boolean"
    return p.select(*names).groupBy("workflow_id", "run_id").transformWithStateInPandas(_Lines(most, names), out, "Append", "None")
