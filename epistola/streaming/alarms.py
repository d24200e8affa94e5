"""What is to be told of an archive's runs: a disturbance at once and once, its all-clear, and a report in quiet times.

A run has archive, ts, seq (order of equal times), problem ('' or null: none) and mails (how many the archive has). A problem is
told when it begins or becomes another, and the first run without one gives the all-clear. A run that tells neither
gives the report of its day, if it is late enough and no report was given since: a disturbance in the night does not hold up the morning's
report. `added` is how many mails came since the last report.

`notices` is for a table of runs, `watch` for a stream of them; both tell the same.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, Window, functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: Hour of the day from which on a report is due, a fixed value.
HOUR = 7
TOLD = "archive string, at long, seq long, notice string, problem string, added long"


def _own(runs: DataFrame) -> DataFrame:
    """The columns that count; runs without a time are none."""
    return runs.where("ts is not null").select("archive", "ts", F.coalesce("seq", F.lit(0)).cast("long").alias("seq"), F.coalesce("problem", F.lit("")).alias("problem"), F.coalesce("mails", F.lit(0)).cast("long").alias("mails"))


def notices(runs: DataFrame, hour: int = HOUR) -> DataFrame:
    """archive, ts, seq, notice, problem and added of all that a table of runs tells, with a report a day.

    Runs are put in order by day, and a day's last problem is handed to the next, so that an archive with very many runs is not one task.
    """
    rows = _own(runs).withColumn("day", F.to_date("ts"))
    days = rows.groupBy("archive", "day").agg(F.max_by("problem", F.struct("ts", "seq")).alias("last"))
    before = days.select("archive", "day", F.lag("last", 1, "").over(Window.partitionBy("archive").orderBy("day")).alias("eve"))  # a row a day
    in_day = Window.partitionBy("archive", "day").orderBy("ts", "seq")
    was = rows.join(before, ["archive", "day"]).withColumn("was", F.coalesce(F.lag("problem").over(in_day), "eve"))
    found = was.withColumn("notice", _told(F.col("problem"), F.col("was"), F.hour("ts") >= hour)).where("notice is not null")
    nth = F.row_number().over(Window.partitionBy("archive", "day", "notice").orderBy("ts", "seq"))
    told = found.withColumn("nth", nth).where("notice <> 'report' or nth = 1")
    reports = told.where("notice = 'report'")  # a row a day
    since = F.greatest(F.lit(0), F.col("mails") - F.lag("mails", 1, 0).over(Window.partitionBy("archive").orderBy("ts", "seq")))
    text = F.when(F.col("notice") == "disturbance", F.col("problem")).otherwise(F.col("was"))
    alarms = told.where("notice <> 'report'").select("archive", "ts", "seq", "notice", text.alias("problem"), F.lit(None).cast("long").alias("added"))
    return alarms.unionAll(reports.select("archive", "ts", "seq", "notice", F.lit(""), since.cast("long")))


def _told(problem: Column, was: Column, late: Column) -> Column:
    return F.when((problem != "") & (problem != was), "disturbance").when((problem == "") & (was != ""), "all-clear").when((problem == "") & late, "report")


class Watch(StatefulProcessor):
    """State of one archive: the problem that was told, time and mails of the last report, and time of the last run."""

    def __init__(self, silence: int | None):
        self.silence = silence

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("archive", "problem string, reported long, mails long, last long")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        problem, reported, mails, last = self.state.get() if self.state.exists() else ("", None, 0, None)
        for r in sorted(rows, key=lambda r: (r.at, r.seq)):  # runs of one archive in one batch
            last = r.at if last is None else max(last, r.at)
            if r.problem:
                if r.problem != problem:
                    yield _row(key, r.at, r.seq, "disturbance", r.problem)
                problem = r.problem
            elif problem:
                yield _row(key, r.at, r.seq, "all-clear", problem)
                problem = ""
            elif r.at >= r.due and (reported is None or reported < r.since):
                yield _row(key, r.at, r.seq, "report", "", max(0, r.mails - (mails or 0)))
                reported, mails = r.at, r.mails
        self.state.update((problem, reported, mails, last))
        if self.silence is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(last // 1000 + self.silence * 1000)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        problem, reported, mails, last = self.state.get()
        if not problem:
            yield _row(key, last, None, "disturbance", SILENT)
            self.state.update((SILENT, reported, mails, last))

    def close(self) -> None:
        pass


#: The problem of an archive that no run came from for too long.
SILENT = "no run"


def _row(key: tuple, at: int, seq: int | None, notice: str, problem: str, added: int | None = None) -> Row:
    return Row(archive=key[0], at=at, seq=seq, notice=notice, problem=problem, added=added)


def watch(runs: DataFrame, watermark: str = "1 hour", hour: int = HOUR, days: int = 1, silence: int | None = None) -> DataFrame:
    """archive, ts, seq, notice, problem and added as a stream of runs tells them; the session needs the RocksDB state store.

    days: a report every so many days. silence: seconds after which an archive without a run is a disturbance too (`no run`, at the time of
    its last run), told by a timer when the watermark has passed; the next good run gives the all-clear.
    """
    morning = F.date_trunc("day", "ts") + F.make_dt_interval(F.lit(0), F.lit(hour))
    since = morning - F.make_dt_interval(F.lit(max(1, days) - 1))
    rows = _own(runs).withWatermark("ts", watermark)
    rows = rows.select(F.col("archive").cast("string").alias("archive"), "ts", "seq", "problem", "mails", F.unix_micros("ts").alias("at"), F.unix_micros(morning).alias("due"), F.unix_micros(since).alias("since"))
    told = rows.groupBy("archive").transformWithState(Watch(silence), TOLD, "Append", "EventTime")
    return told.select("archive", F.timestamp_micros("at").alias("ts"), "seq", "notice", "problem", "added")
