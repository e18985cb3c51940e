"""Incremental series: what to fetch, and how chunks become one series."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, timedelta

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Span:
    start: date
    end: date

    @property
    def days(self) -> int:
        return (self.end - self.start).days + 1


def slice_table(windows: DataFrame, days: int) -> DataFrame:
    """Windows (start, end) in parts of at most ``days``: one row for each slice."""
    starts = F.sequence("start", "end", F.make_interval(days=F.lit(days)))
    return windows.withColumn("slice_start", F.explode(starts)).withColumn("slice_end", F.least("end", F.date_add("slice_start", days - 1)))


def gaps(done: DataFrame, windows: DataFrame, by: str = "unit") -> DataFrame:
    """Days of each unit's window that no chunk (start, end) covers, as spans: (unit, start, end)."""
    inside = done.join(windows.withColumnsRenamed({"start": "w_start", "end": "w_end"}), by).where((F.col("start") >= F.col("w_start")) & (F.col("end") <= F.col("w_end"))).select(by, "start", "end")
    fence = windows.select(by, F.date_add("end", 1).alias("start"), F.date_add("end", 1).alias("end"))
    before = Window.partitionBy(by).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    rows = inside.unionByName(fence).withColumn("reach", F.max("end").over(before)).join(windows.select(by, F.col("start").alias("w_start")), by)
    first = F.coalesce(F.date_add("reach", 1), F.col("w_start"))
    return rows.select(by, first.alias("gap_start"), F.date_add("start", -1).alias("gap_end")).where("gap_start <= gap_end").select(by, F.col("gap_start").alias("start"), F.col("gap_end").alias("end"))


def chunk_work(done: DataFrame, windows: DataFrame, days: int, by: str = "unit") -> DataFrame:
    """What to do for each unit's series: (unit, file, start, end, action), for any number of units in one plan.

    ``done`` has the files that exist, with the span of each (null for files that aren't chunks). A file is
    to ``remove`` if its span isn't inside the unit's window, or the unit has no window; to ``replace`` if it
    alone reaches furthest but is shorter than a chunk and not at the window's end; else to ``keep``. Days
    that kept files leave open are to ``fetch``, in parts of at most ``days``.
    """
    fence = windows.select(by, F.col("start").alias("w_start"), F.col("end").alias("w_end"))
    files = done.select(by, "file", "start", "end").join(fence, by, "left")
    files = files.withColumn("inside", F.coalesce((F.col("start") >= F.col("w_start")) & (F.col("end") <= F.col("w_end")), F.lit(False)))
    mates = Window.partitionBy(by, "inside")
    files = files.withColumn("tip", F.max("end").over(mates)).withColumn("at_tip", F.count_if(F.col("end") == F.col("tip")).over(mates))
    growing = (F.col("end") == F.col("tip")) & (F.col("at_tip") == 1) & (F.col("end") < F.col("w_end")) & (F.datediff("end", "start") + 1 < days)
    action = F.when(~F.col("inside"), "remove").when(growing, "replace").otherwise("keep")
    filed = files.select(by, "file", "start", "end", action.alias("action"))
    open_ = slice_table(gaps(filed.where("action = 'keep'").select(by, "start", "end"), windows, by), days)
    fetch = open_.select(by, F.lit(None).cast("string").alias("file"), F.col("slice_start").cast("date").alias("start"), F.col("slice_end").alias("end"), F.lit("fetch").alias("action"))
    return filed.unionByName(fetch)


def chunk_days(cells_per_step: int, step_days: float = 1, steps: int = 90, values: int = 100_000) -> int:
    """Days in one request: at most ``steps`` time steps and ``values`` values, one step at least."""
    step_days = max(1, step_days)
    most = int(steps * step_days)
    if cells_per_step <= 0:
        return most
    return max(1, min(most, int(max(1, values // cells_per_step) * step_days)))


def oldest_rows(chunks: DataFrame, keys: tuple[str, ...], by: tuple[str, ...]) -> DataFrame:
    """The row of each key from the oldest chunk whose span holds it; of equally old ones the least. Chunks meet in partial aggregates."""
    held = chunks.where(F.col("date").between(F.col("span_start"), F.col("span_end")))
    rest = [c for c in chunks.columns if c not in {*by, *keys, "span_start", "span_end"}]
    first = held.groupBy(*by, *keys).agg(F.min(F.struct("span_start", "span_end", *rest)).alias("first_"))
    return first.select(*[c if c in {*by, *keys} else F.col("first_")[c].alias(c) for c in chunks.columns if c not in ("span_start", "span_end")])


def assemble(chunks: DataFrame, identity: dict[str, str], keys: tuple[str, ...] = ("date",), by: tuple[str, ...] = ()) -> DataFrame:
    """Chunk rows (with span_start and span_end) as one series: a row for each key, from the oldest chunk whose span holds it."""
    return oldest_rows(chunks, keys, by).withColumns({k: F.lit(v) for k, v in identity.items()})


def record_windows(extents: DataFrame, days: int | None = 30) -> DataFrame:
    """By dataset, the last ``days`` of its record (start, end), or all of it (None); never before its first day."""
    last = F.to_date("end")
    start = F.to_date("start") if days is None else F.greatest(F.to_date("start"), F.date_add(last, 1 - days))
    return extents.withColumns({"start": start, "end": last})


def with_file_spans(chunks: DataFrame) -> DataFrame:
    """Spans of chunks from the names of their files, <start>_<end>.parquet."""
    name = F.col("_metadata.file_path")
    day = r"(\d{4}-\d{2}-\d{2})_(\d{4}-\d{2}-\d{2})\.parquet"
    rows = chunks.select("*", F.regexp_extract(name, day, 1).alias("s_"), F.regexp_extract(name, day, 2).alias("e_"))
    return rows.where("s_ <> ''").withColumns({"span_start": F.col("s_").cast("date"), "span_end": F.col("e_").cast("date")}).drop("s_", "e_")


def in_window(series: DataFrame, start: str, end: str, column: str = "date") -> DataFrame:
    return series.where(F.col(column).between(F.lit(start).cast("date"), F.lit(end).cast("date")))


@dataclass(frozen=True)
class ReadPlan:
    series: str
    map: str
    slice: date | None


def window_covered(coverage: Span | None, window: Span) -> bool:
    """Whether a materialised series holds the window's start; the window may run past its end."""
    return coverage is not None and coverage.start <= window.start <= coverage.end


def cap_start(window: Span, most_days: int, coverage: Span | None = None) -> date:
    if window_covered(coverage, window) or window.days <= most_days:
        return window.start
    return window.end - timedelta(most_days - 1)


def plan_read(gridded: bool, listed: bool, coverage: Span | None, window: Span, last_step: date | None = None) -> ReadPlan:
    """Where a run's rows come from: the materialised series if it covers the window, else the source."""
    if not (gridded and listed and window_covered(coverage, window)):
        return ReadPlan("live", "window", None)
    return ReadPlan("materialised", "slice", min(window.end, last_step or coverage.end))


def default_window(extent: Span, step_days: float = 1, days: int = 30, steps: int = 8, most: int = 90) -> Span:
    """The last days of a dataset, or the last steps of a coarser one."""
    import math

    span = min(most, max(days, math.ceil(steps * step_days) if step_days > 1 else days))
    return Span(max(extent.start, extent.end - timedelta(span - 1)), extent.end)


def clamp_window(window: Span, extent: Span, step_days: float = 1) -> tuple[Span, bool]:
    """A window kept inside a dataset's extent; one wholly outside becomes the default window. Whether it changed."""
    if window.start > extent.end or window.end < extent.start:
        return default_window(extent, step_days), True
    clamped = Span(max(window.start, extent.start), min(window.end, extent.end))
    return clamped, clamped != window
