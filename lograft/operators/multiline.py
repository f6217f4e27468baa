"""Reassembly of records broken over several lines.

A line that may begin a record (a *starter*) opens a buffer of up to ``limit`` further lines, so
what a line is part of depends on the lines before it: a sequential walk. It is cut into blocks of
lines that are worked on independently, whatever the sizes of the sources:

1. Starters are found, and with them the *cells* of lines a starter can reach. All other lines
   pass by, without a shuffle unless Spark chooses one for the join.
2. Only blocks that a buffer can run into from the block before need to know where to begin.
   Each of the blocks before works out where it is left for every line it may be entered at, side
   by side. These maps are composed in rounds, ``FAN`` neighbours at a time, and the entries handed
   back down the same way, so that no task sees more than ``FAN`` maps of a source.
3. Each block is walked once from its entry, with the lines after its end that its last record
   may need.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, groupby
from operator import itemgetter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from lograft.functions import classify
from lograft.functions.reassembly import Line, shipped, walk
from lograft.operators.parse import _PART, sorted_lines
from lograft.options import LogOptions
from lograft.session import prepare_session
from lograft.sources.order import counts_before
from lograft.sources.shared import kept

BLOCK_LINES = 16384
#: So many neighbouring blocks, or groups of blocks, are composed in one step.
FAN = 32

shipped(__name__)

# A row that tells a block where to begin sorts before the block's lines.
_ENTRY_ROW = -1


def _starter() -> Column:
    """Whether a classified line is raw and may begin a record."""
    return (F.col("kind") == "raw") & classify.might_start_json(F.col(_PART))


def starters(lines: DataFrame) -> DataFrame:
    """``lines`` (with a column ``line``) and whether each is a ``starter``."""
    return sorted_lines(lines, "line").select(
        *lines.columns, F.coalesce(_starter(), F.lit(False)).alias("starter")
    )


def number_lines(
    lines: DataFrame, source: str, position: str, width: int = 65536
) -> DataFrame:
    """Replace ``line_no`` by consecutive numbers from 0 within each source, by ``position``.

    ``position`` is a whole number, unique within its source. It cuts a source, however large,
    into buckets of at most ``width`` lines that are numbered on their own; the lines before a
    bucket come from a table with one row per bucket. All of it depends on the data alone, so a
    lost task computes the same numbers again.
    """
    bucketed = lines.withColumn("_bucket", F.floor(F.col(position) / width))
    counts = bucketed.groupBy(source, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts_before(counts, source, "_bucket").drop("_n")
    within = Window.partitionBy(source, "_bucket").orderBy(position)
    number = F.row_number().over(within) - 1 + F.col("_before")
    own = [name for name in lines.columns if name != "line_no"]
    return bucketed.join(offsets, [source, "_bucket"]).select(
        *own, number.cast("bigint").alias("line_no")
    )


def _rows(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(
            batch["source"], batch["block"], batch["line_no"], batch["line"], batch["starter"],
            batch["entry"], batch["offset"],
        )


def _blocks(batches: Iterator[pd.DataFrame]):
    """(source, block) with its rows, across batch borders."""
    return groupby(_rows(batches), key=itemgetter(0, 1))


def _dense(rows: Iterator[tuple]) -> Iterator[Line]:
    """The lines of a block. Lines left out are far from any starter and stand as idle."""
    expected = None
    for _, _, number, line, starter, _, _ in rows:
        if expected is not None:
            for missing in range(expected, number):
                yield (missing, None, False)
        yield (number, line, bool(starter))
        expected = number + 1


_EXITS = T.StructType(
    [
        T.StructField("source", T.StringType()),
        T.StructField("block", T.LongType()),
        T.StructField("exits", T.ArrayType(T.IntegerType())),
    ]
)


def _exits_of_blocks(block_lines: int, limit: int):
    """Per block: how far into the next block each possible entry ends up."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for (source, block), rows in _blocks(batches):
            first = block * block_lines
            entries = range(first, first + limit + 1)
            left = walk(
                _from(first, _dense(rows)), limit, entries, stop_at=first + block_lines
            )
            exits = [max(left[e] - first - block_lines, 0) for e in entries]
            yield pd.DataFrame({"source": [source], "block": [block], "exits": [exits]})

    return run


def _from(first: int, lines: Iterator[Line]) -> Iterator[Line]:
    """The lines with idle ones before the first, so that every entry is met."""
    head = next(lines, None)
    if head is None:
        return iter(())
    idle = ((number, None, False) for number in range(first, head[0]))
    return chain(idle, (head,), lines)


def _composed(limit: int) -> Column:
    """The map of a group of neighbours: in at its first, out of its last. What is missing has no
    record that runs on, so it is left at its end wherever it is entered."""
    flat = F.array_repeat(F.lit(0), limit + 1)

    def through(at: Column, slot: Column) -> Column:
        exits = F.try_element_at(F.col("maps"), slot)
        return F.when(exits.isNull(), flat).otherwise(F.transform(at, lambda e: F.get(exits, e)))

    slots = F.sequence(F.lit(0), F.lit(FAN - 1))
    return F.aggregate(slots, F.sequence(F.lit(0), F.lit(limit)), through)


def _handed_down() -> Column:
    """Where each of a group's members is entered, given where the group is."""

    def step(found: Column, slot: Column) -> Column:
        exits = F.try_element_at(F.col("maps"), slot)
        out = F.coalesce(F.get(exits, F.element_at(found, -1)), F.lit(0))
        return F.concat(found, F.array(out))

    return F.aggregate(
        F.sequence(F.lit(0), F.lit(FAN - 2)), F.array(F.col("entry")), step
    )


def _grouped(level: DataFrame) -> DataFrame:
    """(source, group, maps): at most ``FAN`` maps side by side, by their place in the group."""
    group = F.floor(F.col("block") / FAN)
    slot = (F.col("block") % FAN).cast("int")
    return level.groupBy("source", group.alias("group")).agg(
        F.map_from_entries(F.collect_list(F.struct(slot, "exits"))).alias("maps")
    )


def entries_of_blocks(exits: DataFrame, limit: int) -> DataFrame:
    """(source, block, entry) of the blocks that are entered behind their first line.

    ``exits`` has a row (source, block, exits) per block that a record may leave early or late, as
    :func:`_exits_of_blocks` makes them; the others are left at their end.
    """
    levels = [kept(exits)]
    last = levels[0].agg(F.max("block")).first()[0]
    if last is None:
        return exits.select("source", "block", F.lit(0).alias("entry")).limit(0)
    groups = []
    while True:
        groups.append(kept(_grouped(levels[-1])))
        # The end of the last block is where a source's walk may go on, one block further.
        last = (last + 1) // FAN
        if last == 0:
            break
        up = groups[-1].select("source", F.col("group").alias("block"), _composed(limit).alias("exits"))
        levels.append(up)
    entries = groups[-1].select("source", F.col("group").alias("block"), F.lit(0).alias("entry"))
    for held in reversed(groups):
        met = entries.join(
            held.withColumnRenamed("group", "block"), ["source", "block"], "left"
        )
        child = F.posexplode(_handed_down()).alias("slot", "entry")
        below = met.select("source", F.col("block").alias("group"), "maps", child)
        # Members without a map matter only where they are entered late.
        known = F.coalesce(F.map_contains_key("maps", F.col("slot")), F.lit(False))
        entries = below.where(known | (F.col("entry") > 0)).select(
            "source", (F.col("group") * FAN + F.col("slot")).alias("block"), "entry"
        )
    return entries.where(F.col("entry") > 0)


_JOINED = T.StructType(
    [
        T.StructField("source", T.StringType()),
        T.StructField("line_no", T.LongType()),
        T.StructField("line", T.StringType()),
        T.StructField("n_lines", T.IntegerType()),
        T.StructField("offset", T.LongType()),
    ]
)


def _walked_blocks(block_lines: int, limit: int):
    """The entries of each block: joined records, and the other lines as they are."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out: list[tuple] = []
        for (source, block), rows in _blocks(batches):
            first_row = next(rows)
            skip = 0
            if first_row[2] == _ENTRY_ROW:
                skip = int(first_row[5])
                first_row = next(rows, None)
            if first_row is None:  # the source ends where the block begins
                continue
            rows = chain((first_row,), rows)
            first, offset = block * block_lines, first_row[6]

            def visit(number, used, joined, source=source, offset=offset):
                if joined is not None:
                    out.append((source, number, joined, len(used), offset))
                else:
                    out.extend(
                        (source, n, text, 1, offset) for n, text, _ in used if text is not None
                    )

            steps = _from(first, _dense(rows))
            walk(steps, limit, [first + skip], visit, stop_at=first + block_lines)
            if len(out) >= 4096:
                yield pd.DataFrame(out, columns=_JOINED.names)
                out = []
        if out:
            yield pd.DataFrame(out, columns=_JOINED.names)

    return run


def reassemble_lines(
    lines: DataFrame, options: LogOptions | None = None, block_lines: int | None = None
) -> DataFrame:
    """Join records broken over several lines; ``(source, line_no, line, n_lines)``.

    ``lines`` has ``source`` (a string), ``line_no`` (consecutive within a source) and ``line``
    (null for a line that is no valid UTF-8: it counts, but adds nothing and is dropped). A
    joined record stands at its first line; lines that could not be joined stay single. The rows
    come in no order: ``line_no`` has it. Blocks are ``BLOCK_LINES`` long, or four times as long as
    the longest record. A column ``position``, the same as ``line_no`` but for a constant per source,
    is carried along.
    """
    options = options or LogOptions()
    limit = options.max_continuation_lines
    block_lines = block_lines or max(BLOCK_LINES, 4 * (limit + 1))
    if block_lines <= limit:
        raise ValueError("a block must be longer than the longest record")
    prepare_session(lines.sparkSession)
    placed = "position" in lines.columns
    offset = F.col("position") - F.col("line_no") if placed else F.lit(0).cast("bigint")
    lines = lines.select("source", "line_no", "line", offset.alias("offset"))
    out = ["source", "line_no", "line", "n_lines"]
    if placed:
        out.append((F.col("line_no") + F.col("offset")).alias("position"))
    flagged = starters(lines)
    single = lines.where(F.col("line").isNotNull()).withColumn("n_lines", F.lit(1))

    # The starters are few next to the lines. Written out, their size is known, so that Spark
    # broadcasts them only if they are small, and the lines need no shuffle to meet them.
    found = kept(flagged.filter("starter").select("source", "line_no"))
    if found.isEmpty():
        return single.select(out)
    # Cells a starter reaches: its own and, as a cell is limit + 1 lines long, the next.
    cell = F.floor(F.col("line_no") / (limit + 1))
    reached = found.select("source", F.explode(F.array(cell, cell + 1)).alias("cell")).distinct()
    passing = single.withColumn("cell", cell).join(reached, ["source", "cell"], "left_anti")
    near = lines.withColumn("cell", cell).join(reached, ["source", "cell"], "left_semi")
    # Which of them are starters is known by now.
    near = near.join(
        found.withColumn("starter", F.lit(True)), ["source", "line_no"], "left"
    ).select(
        "source", "line_no", "line", F.coalesce("starter", F.lit(False)).alias("starter"), "offset"
    )

    block = F.floor(F.col("line_no") / block_lines)
    # The lines a block's last record may need are handed to it as well.
    ahead = F.col("line_no") % block_lines < limit
    spread = near.select(
        "source", "line_no", "line", "starter", F.lit(None).cast("int").alias("entry"), "offset",
        F.explode(
            F.when(ahead & (block > 0), F.array(block, block - 1)).otherwise(F.array(block))
        ).alias("block"),
    )

    # Blocks with a starter so near their end that its record may run into the next one; most input
    # has none.
    late = found.filter(F.col("line_no") % block_lines >= block_lines - limit)
    if not late.isEmpty():
        open_ended = late.select("source", block.alias("block")).distinct()
        exits = (
            spread.join(open_ended, ["source", "block"], "left_semi")
            .select("source", "block", "line_no", "line", "starter", "entry", "offset")
            .repartition("source", "block")
            .sortWithinPartitions("source", "block", "line_no")
            .mapInPandas(_exits_of_blocks(block_lines, limit), _EXITS)
        )
        entry_rows = entries_of_blocks(exits, limit).select(
            "source", F.lit(_ENTRY_ROW).cast("bigint").alias("line_no"),
            F.lit(None).cast("string").alias("line"), F.lit(False).alias("starter"), "entry",
            "block", F.lit(None).cast("bigint").alias("offset"),
        )
        spread = spread.unionByName(entry_rows)
    joined = (
        spread.select("source", "block", "line_no", "line", "starter", "entry", "offset")
        .repartition("source", "block")
        .sortWithinPartitions("source", "block", "line_no")
        .mapInPandas(_walked_blocks(block_lines, limit), _JOINED)
    )
    whole = ["source", "line_no", "line", "n_lines", "offset"]
    return joined.unionByName(passing.select(whole)).select(out)
