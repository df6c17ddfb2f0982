"""Long ordered series without one task per series.

A window over a whole symbol would put all of its rows into one task, and one symbol may hold a
large part of the data. Three devices replace it. How a series is cut changes no result beyond the
last digits of a double:

* time slices plus one small summary row per slice, for numbering and running totals;
* blocks cut by row position, each with the few neighbouring rows its windows reach into;
* exponential sums inside a block from per-piece sums, instead of a row-by-row recurrence.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, replace
from functools import cached_property

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.config import Layout
from barloom.functions.clock import bucket

FIRST, NOW = Window.unboundedPreceding, Window.currentRow


def with_slice(df: DataFrame, layout: Layout, time: str = "time") -> DataFrame:
    return df.withColumn("_slice", bucket(time, layout.slice_seconds))


def numbered(
    df: DataFrame, keys: Sequence[str], parts: Sequence[str], order: Sequence[str], name: str
) -> DataFrame:
    """0-based row number per ``keys``, where ``parts`` is a coarse column monotone in ``order``.

    Rows are ranked inside (keys, part) only; what lies before a part is the running sum of the
    part counts, a table with one row per part that is aggregated map-side first.
    """
    ahead = Window.partitionBy(*keys).orderBy(*parts).rowsBetween(FIRST, -1)
    offsets = (
        df.groupBy(*keys, *parts)
        .agg(F.count(F.lit(1)).alias("_rows"))
        .select(*keys, *parts, F.coalesce(F.sum("_rows").over(ahead), F.lit(0)).alias("_offset"))
    )
    inside = Window.partitionBy(*keys, *parts).orderBy(*order)
    return (
        df.repartition(*keys, *parts)  # not the coarser layout that an earlier step may have left
        .withColumn("_rank", F.row_number().over(inside))
        .join(offsets, [*keys, *parts])
        .withColumn(name, F.col("_offset") + F.col("_rank") - 1)
        .drop("_rank", "_offset")
    )


def with_position(
    df: DataFrame,
    keys: Sequence[str],
    layout: Layout = Layout(),
    time: str = "time",
    positions: str = "count",
) -> DataFrame:
    """Add ``pos``, the 0-based position of a row in its series by time.

    "count" numbers the rows of the table as it is; a column of that name is replaced. "given"
    takes the column as it is, which spares the numbering where a table was stored with positions
    and not cut since; window steps over a series with missing rows then stop with an error.
    """
    if positions == "given":
        return df
    if positions != "count":
        raise ValueError(f"unknown positions: {positions}")
    plain = df.drop("pos")
    return numbered(with_slice(plain, layout, time), keys, ["_slice"], [time], "pos").drop("_slice")


@dataclass(frozen=True)
class Blocks:
    """Equal blocks of a positioned series, ordered by (piece, position).

    ``back`` and ``ahead`` are the rows before and after a block that its windows look at; those
    rows are copied into the block. ``back`` is rounded up to whole pieces. All window
    specifications below need the same ordering, so a chain of them sorts once.
    """

    keys: tuple[str, ...]
    back: int
    ahead: int
    layout: Layout

    @property
    def reach(self) -> int:
        return math.ceil(self.back / self.layout.sub_rows) * self.layout.sub_rows

    @cached_property
    def rows(self):
        return Window.partitionBy(*self.keys, "_block").orderBy("_sub", "pos")

    def over(self, frame: str = "") -> str:
        """SQL text of a window over the rows of a block, with an optional frame."""
        keys = ", ".join([*self.keys, "_block"])
        return f"over (partition by {keys} order by _sub, pos {frame})"

    @property
    def up_to_now(self) -> str:
        return self.over("rows unbounded preceding")

    @property
    def in_piece(self) -> str:
        """SQL text of a window over the rows of the piece up to the current one."""
        keys = ", ".join([*self.keys, "_block", "_sub"])
        return f"over (partition by {keys} order by pos rows unbounded preceding)"

    def piece_before(self, steps: int) -> str:
        """SQL text of a window over the piece that lies ``steps`` before the current one."""
        keys = ", ".join([*self.keys, "_block"])
        frame = f"range between {steps} preceding and {steps} preceding"
        return f"over (partition by {keys} order by _sub {frame})"

    @property
    def starts_series(self) -> str:
        """SQL text: this block, with its copied rows, begins at the start of the series."""
        return f"(_block * {self.layout.block_rows} <= {self.reach})"

    def spread(self, df: DataFrame, positions: str = "count") -> DataFrame:
        """Rows with their block, copied into every block whose windows reach them.

        Given positions are trusted for whole series only: the rows of each block are checked to follow one another from
        where the block should begin; a series that ends early is a shorter series, no error.
        """
        spread = self._spread(df)
        if positions != "given":
            return spread
        begin = f"greatest(_block * {self.layout.block_rows} - {self.reach}, 0)"
        follows = f"pos = coalesce(lag(pos) {self.over()} + 1, {begin})"
        cut = "raise_error('given positions of a series that was cut; number it anew')"
        return spread.withColumn("pos", F.expr(f"case when {follows} then pos else {cut} end"))

    def _spread(self, df: DataFrame) -> DataFrame:
        size = self.layout.block_rows
        first = F.expr(f"(pos - {self.ahead}) div {size}")
        last = F.expr(f"(pos + {self.reach}) div {size}")
        return (
            df.withColumn("_sub", F.expr(f"pos div {self.layout.sub_rows}"))
            .withColumn("_block", F.explode(F.sequence(first, last)))
            .repartition(*self.keys, "_block")
        )

    def own_rows(self, df: DataFrame) -> DataFrame:
        size = self.layout.block_rows
        return df.where(F.col("_block") == F.expr(f"pos div {size}")).drop("_block", "_sub")


# Weights below exp(-TAIL) of the current one cannot change a double.
TAIL = 40.0
# factor^-p inside a piece stays below exp(PIECE_LIMIT), well inside the range of a double.
PIECE_LIMIT = 600.0
# A ratio of two decaying sums needs the weights from its last non-zero input on. It is given up,
# by a count of rows and not by when a sum vanishes, once that input weighs less than
# exp(-RATIO_SPAN); what lies another TAIL before cannot matter.
RATIO_SPAN = 600.0
RATIO_TAIL = RATIO_SPAN + TAIL


def ratio_rows(factor: float) -> int:
    """Rows for which a ratio of decaying sums outlives the last non-zero input."""
    return math.floor(RATIO_SPAN / -math.log(factor))


def layout_for(layout: Layout, factors: Sequence[float]) -> Layout:
    """Shorten the pieces until factor^-p stays well inside the range of a double."""
    rows = layout.sub_rows
    while rows > 1 and any(-math.log(f) * rows > PIECE_LIMIT for f in factors):
        rows //= 2
    return replace(layout, sub_rows=rows)


@dataclass(frozen=True)
class Decay:
    """y[t] = factor * y[t-1] + input[t], the input column holding 0 before the start."""

    input: str
    factor: float
    tail: float = TAIL

    def pieces(self, layout: Layout) -> int:
        """How many whole pieces before the current one still carry weight."""
        return math.ceil(self.tail / (-math.log(self.factor) * layout.sub_rows))


def decaying_sums(df: DataFrame, blocks: Blocks, scans: dict[str, Decay]) -> DataFrame:
    """Add one column per scan with its recurrence solved in closed form.

    Inside a piece, y = f^p * sum(x * f^-p) over the rows so far; each earlier piece adds its
    last value, decayed. ``blocks`` must reach back over ``Decay.pieces`` whole pieces.
    """
    size = blocks.layout.sub_rows
    place = f"cast(pos % {size} as double)"
    inside, total = {}, {}
    for name, scan in scans.items():
        f = f"{scan.factor!r}D"
        weighted = f"sum({scan.input} * pow({f}, -{place})) {blocks.in_piece}"
        inside[f"_in_{name}"] = F.expr(f"pow({f}, {place}) * {weighted}")
        at_end = f"case when pos % {size} = {size - 1} then _in_{name} end"
        carry = [
            f"coalesce(sum({at_end}) {blocks.piece_before(step)}, 0D)"
            f" * {scan.factor ** (size * (step - 1))!r}D"
            for step in range(1, scan.pieces(blocks.layout) + 1)
        ]
        total[name] = F.expr(f"_in_{name} + pow({f}, {place} + 1) * ({' + '.join(carry)})")
    return df.withColumns(inside).withColumns(total).drop(*inside)
