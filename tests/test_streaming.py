"""Streams give what batches give."""

import random
import time

import pandas as pd

from lograft import LogOptions, format_lines, reassemble_lines, stream_log_files
from lograft.functions.reassembly import walk
from lograft.sources import shared
from lograft.streaming import live
from lograft.streaming.live import (
    Reassembler,
    follow_files,
    for_each_reassembled,
    live_entries,
    reassemble_stream,
    write_live,
)

LINES = [
    '{"level":"info","msg":"one","port":1}', "plain", "", '{"level":"error","msg":"tr', "two",
    'three"}', 'pre {"msg":"x"}', '{"msg":"never closed', "tail",
]


def test_live_entries(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.log").write_text("\n".join(LINES) + "\n")
    options = LogOptions(single_line=True, line_gap=0)
    entries = live_entries(stream_log_files(spark, str(tmp_path / "in")), options)
    query = write_live(
        entries, str(tmp_path / "out"), str(tmp_path / "checkpoint"), options, interval=None
    )
    query.awaitTermination()
    got = sorted(r[0] for r in spark.read.text(str(tmp_path / "out")).collect())
    df = spark.createDataFrame([(line,) for line in LINES], "line string")
    expected = sorted(r.rendered for r in format_lines(df, options=options).collect())
    assert got == expected


def test_files_are_reassembled_per_batch(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name in "ab":
        (tmp_path / "in" / f"{name}.log").write_text("\n".join(LINES) + "\n")
    seen = []
    query = for_each_reassembled(
        stream_log_files(spark, str(tmp_path / "in"), maxFilesPerTrigger="1"),
        lambda batch, _: seen.extend(batch.orderBy("source", "line_no").collect()),
        str(tmp_path / "checkpoint"),
        interval=None,
    )
    query.awaitTermination()
    texts = [r.line for r in seen if r.source.endswith("a.log")]
    assert texts == [
        LINES[0], "plain", "", '{"level":"error","msg":"tr\\ntwo\\nthree"}', LINES[6], LINES[7],
        "tail",
    ]
    assert len(seen) == 2 * len(texts)


def test_state_over_micro_batches(spark, tmp_path):
    """A record whose lines arrive in different micro-batches is joined all the same."""
    folder = tmp_path / "in"
    folder.mkdir()
    rows = [("p0", n, line) for n, line in enumerate(LINES)]
    rows += [("p1", n, line) for n, line in enumerate(LINES[2:])]
    for part in range(0, len(rows), 2):
        pd.DataFrame(rows[part : part + 2], columns=["source", "line_no", "line"]).to_parquet(
            folder / f"{part:03d}.parquet"
        )
    schema = "source string, line_no bigint, line string"
    options = LogOptions(max_continuation_lines=3)
    stream = (
        spark.readStream.schema(schema).option("maxFilesPerTrigger", "1").parquet(str(folder))
    )
    seen = []
    query = (
        reassemble_stream(stream, options)
        .writeStream.foreachBatch(lambda batch, _: seen.extend(batch.collect()))
        .option("checkpointLocation", str(tmp_path / "checkpoint"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    assert len(query.recentProgress) >= len(rows) // 2
    got = {(r.source, r.line_no, r.line) for r in seen}
    batch = spark.createDataFrame(rows, schema)
    expected = {
        (r.source, r.line_no, r.line) for r in reassemble_lines(batch, options).collect()
    }
    # The last buffer of each source is still open: its lines wait for more.
    assert expected - got == {
        ("p0", 7, LINES[7]), ("p0", 8, "tail"), ("p1", 5, LINES[7]), ("p1", 6, "tail"),
    }
    assert got <= expected


def test_an_open_buffer_is_given_up_after_a_wait_where_asked(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    rows = [("p", n, line) for n, line in enumerate(LINES)]
    pd.DataFrame(rows, columns=["source", "line_no", "line"]).to_parquet(folder / "a.parquet")
    stream = spark.readStream.schema("source string, line_no bigint, line string")
    seen = []
    query = (
        reassemble_stream(stream.parquet(str(folder)), wait_ms=200)
        .writeStream.foreachBatch(lambda batch, _: seen.extend(batch.collect()))
        .option("checkpointLocation", str(tmp_path / "checkpoint"))
        .trigger(processingTime="200 milliseconds")
        .start()
    )
    try:
        deadline = time.time() + 90
        while len(seen) < 7 and time.time() < deadline and query.isActive:
            time.sleep(0.2)
    finally:
        query.stop()
    assert sorted(r.line_no for r in seen) == [0, 1, 2, 3, 6, 7, 8]


def test_live_entries_with_numbers_are_reassembled(spark, tmp_path):
    (tmp_path / "in").mkdir()
    rows = [("p", n, line) for n, line in enumerate(LINES[:6])]
    pd.DataFrame(rows, columns=["source", "line_no", "line"]).to_parquet(tmp_path / "in" / "a.parquet")
    stream = spark.readStream.schema("source string, line_no bigint, line string")
    options = LogOptions(single_line=True, line_gap=0, min_level="error")
    entries = live_entries(stream.parquet(str(tmp_path / "in")), options)
    write_live(
        entries, str(tmp_path / "out"), str(tmp_path / "checkpoint"), options, interval=None
    ).awaitTermination()
    got = "\n".join(r[0] for r in spark.read.text(str(tmp_path / "out")).collect())
    assert "two" in got and "one" not in got


def test_files_are_followed_in_their_order_and_leave_nothing_behind(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(shared, "shared_folder", lambda spark: str(tmp_path / "shared"))
    (tmp_path / "in").mkdir()
    options = LogOptions(single_line=True, line_gap=0)

    def follow():
        follow_files(
            spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "checkpoint"),
            options, interval=None,
        ).awaitTermination()

    for name in "ab":
        (tmp_path / "in" / f"{name}.log").write_text("\n".join([*LINES, name]) + "\n")
        follow()
    for number, name in enumerate("ab"):
        folder = tmp_path / "out" / f"batch={number}"
        text = "".join(p.read_text() for p in sorted(folder.glob("part-*")))
        assert text.split("\n")[-2] == name
        assert text.index("one") < text.index("tr") < text.index("never closed")
    left = tmp_path / "shared"
    assert not left.exists() or list(left.iterdir()) == []


def test_settled_lines_meet_the_walk_however_they_are_cut():
    rng = random.Random(5)
    pieces = [('{"a":"x', True), ('y"}', False), ("p", False), ('{"b":"u', True), (None, False)]
    for _ in range(400):
        limit = rng.randint(1, 4)
        lines = [(3 * n, *rng.choice(pieces)) for n in range(rng.randint(1, 30))]
        out, pending, start = [], [], 0
        while start < len(lines):
            end = min(len(lines), start + rng.randint(1, 6))
            found = list(live.settled(iter(pending + lines[start:end]), limit, end == len(lines)))
            pending = [row for kind, row in found if kind == "open"]
            assert len(pending) <= limit
            out += [row for kind, row in found if kind == "entry"]
            start = end
        expected = []

        def visit(number, used, joined):
            if joined is not None:
                expected.append((3 * number, joined, len(used)))
            else:
                expected.extend((3 * n, s, 1) for n, s, _ in used if s is not None)

        walk([(n, s, f) for n, (_, s, f) in enumerate(lines)], limit, [0], visit)
        assert out == expected


class _Store:
    """State of one source in memory; counts what is asked of it."""

    def __init__(self):
        self.rows, self.asked = {}, 0

    def _ask(self, value=None):
        self.asked += 1
        return value

    def get(self):
        return iter(self._ask(self.rows.get("open", [])))

    def exists(self):
        return self._ask("open" in self.rows)

    def put(self, rows):
        self._ask(self.rows.update(open=rows))

    def clear(self):
        self._ask(self.rows.pop("open", None))

    def containsKey(self, key):  # noqa: N802
        return self._ask(key in self.rows)

    def getValue(self, key):  # noqa: N802
        return self._ask(self.rows[key])

    def updateValue(self, key, value):  # noqa: N802
        self._ask(self.rows.update({key: value}))

    def removeKey(self, key):  # noqa: N802
        self._ask(self.rows.pop(key))


def _reassembled(micro_batches, batch_lines):
    made, out, asked = Reassembler(30, None), [], []
    made.open, made.arrived = _Store(), _Store()
    for lines in micro_batches:
        before = made.open.asked + made.arrived.asked
        frames = [
            pd.DataFrame(lines[a : a + batch_lines], columns=["line_no", "line", "starter"])
            for a in range(0, len(lines), batch_lines)
        ]
        for found in made.handleInputRows(("s",), iter(frames), None):
            out += found.itertuples(index=False, name=None)
        asked.append(made.open.asked + made.arrived.asked - before)
    assert not made.arrived.rows
    return out, asked


def test_few_lines_of_a_source_are_not_put_into_the_state_store(monkeypatch):
    texts = ['{"a":"', "x", '"}', "plain", None, '{"b":"', "y"]
    batches = [
        [(i, t, bool(t) and t.startswith("{")) for i, t in enumerate(texts)][::-1],
        [(8, '"}', False), (7, "z", False)], [(9, "end", False)],
    ]
    few, asked = _reassembled(batches, 2)
    assert asked == [2, 2, 1]
    assert [(n, used) for _, n, _, used in few] == [(0, 3), (3, 1), (5, 4), (9, 1)]
    monkeypatch.setattr(live, "CHUNK_LINES", 3)
    assert _reassembled(batches, 2)[0] == few
