"""Screening: mask impossible and stuck readings, and count what was masked.

Rules run in order and each sees values already masked by the earlier ones.
Rows are never dropped.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window, functions as F

from gridcast.functions.convert import epoch_hours
from gridcast.functions.vocabulary import FLATLINE_MEASURES, PLAUSIBLE, SOURCE, STATION, TS
from gridcast.operators.scan import BLOCK, BLOCK_HOURS, CORE, with_halo

FLAG = "_masked"


def flag_name(rule: str, column: str) -> str:
    return f"{FLAG}:{rule}:{column}"


def out_of_range(column: str, low: float, high: float) -> Column:
    """Present and outside the inclusive bounds."""
    v = F.col(column)
    return F.coalesce(~v.between(low, high), F.lit(False))


def stuck_flags(
    panel: DataFrame,
    columns: Sequence[str],
    minimum_run: int,
    keys: Sequence[str] = (SOURCE, STATION),
    ts: str = TS,
    block_hours: int = BLOCK_HOURS,
) -> DataFrame:
    """Add one flag per column: inside a run of at least ``minimum_run`` equal hourly readings.

    A null or absent hour breaks a run. Every block also sees the
    ``minimum_run - 1`` hours on either side, which is enough to tell whether
    a run through any of its own rows is long enough, so runs crossing block
    edges are exact. Run start and run end come from two running windows.
    """
    reach = minimum_run - 1
    placed = with_halo(panel, ts, reach, reach, block_hours).withColumn("_h", epoch_hours(ts))
    up = Window.partitionBy(*keys, BLOCK).orderBy("_h")
    down = Window.partitionBy(*keys, BLOCK).orderBy(F.col("_h").desc())
    so_far = (Window.unboundedPreceding, Window.currentRow)
    adjacent = F.lag("_h").over(up) == F.col("_h") - 1
    starts = {
        f"_start:{c}": F.max(F.when(F.col(f"_new:{c}"), F.col("_h"))).over(up.rowsBetween(*so_far)) for c in columns
    }
    breaks = {
        f"_new:{c}": ~F.coalesce(adjacent & (F.lag(c).over(up) == F.col(c)), F.lit(False)) for c in columns
    }
    # A run ends at the row before the next start; descending, that is the
    # nearest start already passed.
    ends = {
        f"_end:{c}": F.min(F.when(F.col(f"_last:{c}"), F.col("_h"))).over(down.rowsBetween(*so_far)) for c in columns
    }
    lasts = {f"_last:{c}": F.coalesce(F.lead(f"_new:{c}").over(up), F.lit(True)) for c in columns}
    flagged = placed.withColumns(breaks).withColumns(starts | lasts).withColumns(ends)
    flags = {
        flag_name("flatline", c): F.col(c).isNotNull()
        & (F.col(f"_end:{c}") - F.col(f"_start:{c}") + 1 >= minimum_run)
        for c in columns
    }
    scratch = [f"{p}:{c}" for p in ("_new", "_start", "_last", "_end") for c in columns]
    return flagged.withColumns(flags).filter(CORE).drop(*scratch, "_h", BLOCK, CORE)


@dataclass(frozen=True)
class Rule:
    """A user rule: mask ``column`` where ``predicate()`` is true."""

    name: str
    column: str
    predicate: Callable[[], Column]


@dataclass(frozen=True)
class Screen:
    """A screening profile; forecasts use one without flatline measures."""

    ranges: Mapping[str, tuple[float, float]] = field(default_factory=lambda: dict(PLAUSIBLE))
    flatline: Sequence[str] = FLATLINE_MEASURES
    dewpoint_tolerance: float | None = 0.5
    flatline_hours: int = 24
    extra: Sequence[Rule] = ()
    keys: Sequence[str] = (SOURCE, STATION)
    ts: str = TS
    block_hours: int = BLOCK_HOURS

    def flag(self, panel: DataFrame) -> DataFrame:
        """Masked panel with one boolean flag column per applied rule."""
        out = panel
        limits = {c: b for c, b in self.ranges.items() if c in panel.columns}
        out = self._mask(out, {("range", c): out_of_range(c, *b) for c, b in limits.items()})
        if self.dewpoint_tolerance is not None and {"dewpoint_c", "temperature_c"} <= set(panel.columns):
            excess = F.col("dewpoint_c") - F.col("temperature_c") > self.dewpoint_tolerance
            out = self._mask(out, {("dewpoint_above_temperature", "dewpoint_c"): F.coalesce(excess, F.lit(False))})
        for rule in self.extra:
            out = self._mask(out, {(rule.name, rule.column): F.coalesce(rule.predicate(), F.lit(False))})
        still = [c for c in self.flatline if c in panel.columns]
        if still:
            out = stuck_flags(out, still, self.flatline_hours, self.keys, self.ts, self.block_hours)
            out = out.withColumns({c: F.when(~F.col(flag_name("flatline", c)), F.col(c)) for c in still})
        return out

    @staticmethod
    def _mask(df: DataFrame, flags: dict[tuple[str, str], Column]) -> DataFrame:
        named = {flag_name(rule, c): expr for (rule, c), expr in flags.items()}
        marked = df.withColumns(named)
        return marked.withColumns({c: F.when(~F.col(flag_name(rule, c)), F.col(c)) for rule, c in flags})

    def apply(self, panel: DataFrame) -> DataFrame:
        """The masked panel alone, in its original column order."""
        return strip_flags(self.flag(panel)).select(*panel.columns)

    def report(self, flagged: DataFrame) -> DataFrame:
        """Masked counts per (rule, keys, column) from a flagged panel; zero rows omitted."""
        marks = [c for c in flagged.columns if c.startswith(f"{FLAG}:")]
        counts = flagged.groupBy(*self.keys).agg(*[F.count_if(F.col(f"`{m}`")).alias(m) for m in marks])
        entries = [
            F.struct(
                F.lit(m.split(":")[1]).alias("rule"),
                F.lit(m.split(":")[2]).alias("column"),
                F.col(f"`{m}`").alias("masked"),
            )
            for m in marks
        ]
        lines = counts.select(*self.keys, F.explode(F.array(*entries)).alias("e"))
        return lines.select(F.col("e.rule").alias("rule"), *self.keys, F.col("e.column").alias("column"), F.col("e.masked").alias("masked")).filter("masked > 0")


def strip_flags(flagged: DataFrame) -> DataFrame:
    return flagged.drop(*[c for c in flagged.columns if c.startswith(f"{FLAG}:")])


def total_masked(report: DataFrame) -> DataFrame:
    return report.agg(F.coalesce(F.sum("masked"), F.lit(0)).alias("masked"))


FORECAST_SCREEN = Screen(flatline=(), ts="valid_time_utc")
