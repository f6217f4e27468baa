"""The same chain over endless input."""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StreamingQuery

from lograft.functions.reassembly import Line, shipped, walk_steps
from lograft.operators.filters import filter_logs
from lograft.operators.multiline import number_lines, reassemble_lines, starters
from lograft.operators.parse import parse_logs
from lograft.operators.render import render_logs
from lograft.options import LogOptions
from lograft.sinks.writers import text_entries
from lograft.sources.files import drop_invalid, stream_log_files
from lograft.sources.shared import passing

#: Lines of a source that are put in order at a time, and rows handed on at a time.
CHUNK_LINES, ROWS = 4096, 4096

# The state stores that keyed state with lists and maps needs.
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

shipped(__name__)


# Line by line


def live_entries(
    lines: DataFrame, options: LogOptions | None = None, wait_ms: int | None = None
) -> DataFrame:
    """Parse, filter and render a stream, in append mode.

    With ``source`` and ``line_no`` as :func:`reassemble_stream` reads them, broken records are
    joined first (``wait_ms`` is its); without ``line_no`` each line stands alone, without state.
    """
    options = options or LogOptions()
    if "line_no" in lines.columns:
        lines = reassemble_stream(lines, options, wait_ms)
    return render_logs(parsed_stream(lines, options), options)


def parsed_stream(lines: DataFrame, options: LogOptions | None = None) -> DataFrame:
    """The log table of a stream, after the filters."""
    options = options or LogOptions()
    return filter_logs(parse_logs(drop_invalid(lines), "line", options), options)


def write_live(
    rendered: DataFrame, path: str, checkpoint: str, options: LogOptions | None = None,
    interval: str | None = "1 second",
) -> StreamingQuery:
    """Write each entry with the micro-batch it came in; without an interval, what is there."""
    return _triggered(
        text_entries(rendered, options)
        .writeStream.format("text")
        .outputMode("append")
        .option("checkpointLocation", checkpoint)
        .option("path", path),
        interval,
    ).start()


def _triggered(writer: DataStreamWriter, interval: str | None) -> DataStreamWriter:
    if interval is None:
        return writer.trigger(availableNow=True)
    return writer.trigger(processingTime=interval)


# Files


def for_each_reassembled(
    lines: DataFrame,
    sink: Callable[[DataFrame, int], None],
    checkpoint: str,
    options: LogOptions | None = None,
    interval: str | None = "1 second",
) -> StreamingQuery:
    """Reassemble a stream of files and hand each micro-batch's lines to ``sink``.

    ``lines`` come straight from :func:`~lograft.sources.files.stream_log_files`. A file is
    never split over micro-batches, so its lines can be numbered and joined as in a batch. What is
    written on the way goes when ``sink`` returns.
    """
    def each(batch: DataFrame, batch_id: int) -> None:
        with passing(batch.sparkSession):
            placed = batch.withColumn("_at", F.monotonically_increasing_id())
            numbered = number_lines(placed, "source", "_at")
            sink(reassemble_lines(numbered.drop("_at"), options), batch_id)

    writer = lines.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return _triggered(writer, interval).start()


def follow_files(
    spark: SparkSession,
    folder: str,
    path: str,
    checkpoint: str,
    options: LogOptions | None = None,
    interval: str | None = "1 second",
    **reading: str,
) -> StreamingQuery:
    """The whole chain over the files that appear in a folder, broken records joined.

    The entries of a micro-batch are text files in ``path/batch=<number>``, those of a file
    in its order, the files by name. A micro-batch that is run again writes the same files again.
    """
    options = options or LogOptions()

    def write(lines: DataFrame, batch_id: int) -> None:
        entries = render_logs(parsed_stream(lines, options), options)
        text = text_entries(entries, options, "source", "line_no")
        ordered = text.repartition("source").sortWithinPartitions("source", "line_no")
        ordered.select("value").write.mode("overwrite").text(f"{path}/batch={batch_id}")

    lines = stream_log_files(spark, folder, **reading)
    return for_each_reassembled(lines, write, checkpoint, options, interval)


# Lines in any micro-batch


_ENTRIES = "source string, line_no bigint, line string, n_lines int"
_LINE = "line_no bigint, line string, starter boolean"
_CHUNK = "numbers array<bigint>, lines array<string>, starters array<boolean>"


def settled(
    lines: Iterator[Line], limit: int, final: bool
) -> Iterator[tuple[str, tuple]]:
    """What no later line can change, as ("entry", row); the lines of a buffer that is still open,
    as ("open", line). Lines come in order; as many as one record may span are held at a time."""
    found: list[tuple[str, tuple]] = []

    def visit(number: int, used: list[Line], joined: str | None) -> None:
        # A buffer that ends with the lines may go on with the next ones.
        if used[0][2] and joined is None and len(used) <= limit and not final:
            found.extend(("open", line) for line in used)
        elif joined is not None:
            found.append(("entry", (number, joined, len(used))))
        else:
            found.extend(("entry", (n, text, 1)) for n, text, _ in used if text is not None)

    for _ in walk_steps(lines, limit, visit):
        yield from found
        found.clear()


def _lines_of(batch: pd.DataFrame) -> list[Line]:
    numbers, lines, starts = (batch[c].tolist() for c in ("line_no", "line", "starter"))
    return [
        (int(n), None if pd.isna(x) else x, bool(s))
        for n, x, s in zip(numbers, lines, starts, strict=True)
    ]


class Reassembler(StatefulProcessor):
    """Per source: the lines of the open buffer, and chunks of lines while a micro-batch with many
    of them is read."""

    def __init__(self, limit: int, wait_ms: int | None):
        self.limit, self.wait_ms = limit, wait_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", _LINE)
        self.arrived = handle.getMapState("arrived", "chunk bigint", _CHUNK)

    def close(self) -> None:
        pass

    def _hold(self, lines: list[Line], chunks: list[int]) -> None:
        """Lines that are not in order yet wait in the state store, a chunk of numbers together."""
        by_chunk: dict[int, list[Line]] = {}
        for line in lines:
            by_chunk.setdefault(line[0] // CHUNK_LINES, []).append(line)
        for chunk, rows in by_chunk.items():
            key = (chunk,)
            held = [[], [], []]
            if self.arrived.containsKey(key):
                held = [list(part) for part in self.arrived.getValue(key)]
            else:
                heapq.heappush(chunks, chunk)
            for part, values in zip(held, zip(*rows), strict=True):
                part.extend(values)
            self.arrived.updateValue(key, tuple(held))

    def _in_order(self, batches: Iterator[pd.DataFrame]) -> Iterator[Line]:
        """Lines of a source by their numbers; those of a chunk's length never leave the task, as
        each word with the state store costs more than many lines."""
        few, chunks = [], []
        for batch in batches:
            few += _lines_of(batch)
            if len(few) > CHUNK_LINES:
                self._hold(few, chunks)
                few = []
        if chunks:
            self._hold(few, chunks)
            few = []
        while chunks:
            key = (heapq.heappop(chunks),)
            rows = sorted(zip(*self.arrived.getValue(key)), key=lambda row: row[0])
            self.arrived.removeKey(key)
            yield from rows
        yield from sorted(few, key=lambda row: row[0])

    def _advance(self, source: str, arrived: Iterator[Line], final: bool) -> Iterator[pd.DataFrame]:
        pending = [tuple(row) for row in self.open.get()]

        def lines() -> Iterator[Line]:
            yield from pending
            yield from arrived

        out, still_open = [], []
        for kind, row in settled(lines(), self.limit, final):
            if kind == "open":
                still_open.append(row)
                continue
            out.append((source, *row))
            if len(out) >= ROWS:
                yield pd.DataFrame(out, columns=["source", "line_no", "line", "n_lines"])
                out = []
        if still_open:
            self.open.put(still_open)
        elif pending:
            self.open.clear()
        if out:
            yield pd.DataFrame(out, columns=["source", "line_no", "line", "n_lines"])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        yield from self._advance(key[0], self._in_order(rows), False)
        if self.wait_ms is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            if self.open.exists():
                now = timerValues.getCurrentProcessingTimeInMs()
                self.handle.registerTimer(now + self.wait_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802
        yield from self._advance(key[0], iter(()), True)


def reassemble_stream(
    lines: DataFrame, options: LogOptions | None = None, wait_ms: int | None = None
) -> DataFrame:
    """Reassemble a stream whose lines arrive in any micro-batch, such as a topic's partitions;
    ``(source, line_no, line, n_lines)``.

    ``(source, line_no, line)``, where ``source`` is the unit that keeps an order (a topic
    partition) and ``line_no`` its offset: a later micro-batch holds later lines. Lines left out of a
    source's numbers count for nothing. State per source is the open buffer, at most as many lines
    as a record may span. It waits for more lines; with ``wait_ms``, a buffer no line was
    added to for that long is given up and its lines come out singly.
    """
    options = options or LogOptions()
    spark = lines.sparkSession
    if spark.conf.get(_PROVIDER, None) != _ROCKS:
        spark.conf.set(_PROVIDER, _ROCKS)
    flagged = starters(lines.select("source", "line_no", "line"))
    return flagged.groupBy("source").transformWithStateInPandas(
        statefulProcessor=Reassembler(options.max_continuation_lines, wait_ms),
        outputStructType=_ENTRIES,
        outputMode="Append",
        timeMode="None" if wait_ms is None else "ProcessingTime",
    )
