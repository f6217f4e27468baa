"""The chain's output stands in input order, whatever was reassembled on the way."""

import pytest

from lograft import LogOptions, format_files, read_log_files, reassemble_lines, write_in_order
from lograft.operators.multiline import FAN, entries_of_blocks

OPTIONS = LogOptions(single_line=True, line_gap=0)


def written(spark, folder):
    paths = sorted(p for p in folder.iterdir() if p.name.startswith("part-"))
    return [line for p in paths for line in p.read_text().split("\n")[:-1]], len(paths)


def test_broken_records_at_the_end_stay_there(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("lograft.sinks.writers.LINES_PER_FILE", 300)
    lines = [f'{{"msg":"n{i}"}}' for i in range(1000)] + ['{"msg":"br', 'oken"}', "last"]
    (tmp_path / "a.log").write_text("\n".join(lines) + "\n")
    found = format_files(spark, str(tmp_path / "a.log"), OPTIONS)
    write_in_order(found.entries, str(tmp_path / "out"), found.n_lines, OPTIONS)
    got, files = written(spark, tmp_path / "out")
    assert [x.split(":")[-1].strip() for x in got] == [
        *[f"n{i}" for i in range(1000)], "br", "oken", "last",
    ]
    assert files >= 4


def test_files_come_in_the_order_given(spark, tmp_path):
    for name in ("a b.log", "b.log", "c.log"):
        (tmp_path / name).write_text(f'{name}\n{{"msg":"x\n{name}"}}\n\n')
    for name in ("1.txt", "2.txt"):
        (tmp_path / "d").mkdir(exist_ok=True)
        (tmp_path / "d" / name).write_text(name)
    paths = [str(tmp_path / p) for p in ("c.log", "nope.log", "d", "a b.log", "c.log", "b.log")]
    found = format_files(spark, paths, OPTIONS)
    assert found.missing == [paths[1]]
    write_in_order(found.entries, str(tmp_path / "out"), found.n_lines, OPTIONS)
    got, _ = written(spark, tmp_path / "out")
    one = lambda n: [n, ": x", n]  # noqa: E731  the empty line is not shown
    assert [g.strip() for g in got] == [
        *one("c.log"), "1.txt", "2.txt", *one("a b.log"), *one("b.log")
    ]


def test_the_default_read_is_one_scan(spark, tmp_path):
    (tmp_path / "a.log").write_bytes(b"one\r\ntwo\xff\n\nfour")
    lines = read_log_files(spark, str(tmp_path / "a.log")).lines
    assert [r.line for r in lines.orderBy("split", "row").collect()] == ["one", None, "", "four"]
    plan = lines._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Join" not in plan and "Exchange" not in plan
    numbered = read_log_files(spark, str(tmp_path / "a.log"), numbered=True)
    assert numbered.n_lines == 4
    assert sorted(r.line_no for r in numbered.lines.collect()) == [0, 1, 2, 3]


def test_entries_are_made_once(spark, tmp_path):
    """No run to sample borders: a user function that counts sees each entry once."""
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(len(batch))
            yield batch

    rows = spark.range(5000).selectExpr("id AS position", "cast(id AS string) AS rendered")
    rows = rows.repartition(7).mapInPandas(counted, rows.schema)
    write_in_order(rows, str(tmp_path / "out"), 5000, OPTIONS)
    assert seen.value == 5000
    assert written(spark, tmp_path / "out")[0] == [str(i) for i in range(5000)]


def test_lines_without_a_starter_need_no_second_scan(spark):
    df = spark.createDataFrame(
        [("s", i, f'{{"msg":"{i}"}}') for i in range(9)], "source string, line_no long, line string"
    )
    plan = reassemble_lines(df)._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in plan and "Join" not in plan


def test_records_longer_than_a_block_once_was(spark):
    n = 20_000
    lines = ['{"m":"x'] + ["y"] * (n - 1) + ['"}', '{"m":"z', "tail"]
    df = spark.createDataFrame(
        [("s", i, x) for i, x in enumerate(lines)], "source string, line_no long, line string"
    )
    got = reassemble_lines(df, LogOptions(max_continuation_lines=n)).collect()
    assert sorted((r.line_no, r.n_lines) for r in got) == [(0, n + 1), (n + 1, 1), (n + 2, 1)]


@pytest.mark.parametrize("blocks", [1, FAN - 1, FAN, FAN * FAN + 3])
def test_maps_are_composed_over_any_number_of_blocks(spark, blocks):
    limit = 2
    # In late by e, out late by (e + 1) % 3, but for every seventh block, which is left at its end.
    there = [b for b in range(blocks) if b % 7 != 3]
    rows = [("s", b, [(e + 1) % 3 for e in range(limit + 1)]) for b in there]
    rows += [("t", blocks + 5, [2, 0, 0])]
    frame = spark.createDataFrame(rows, "source string, block long, exits array<int>")
    expected, entry = {("t", blocks + 6): 2}, 0
    for b in range(blocks):
        entry = (entry + 1) % 3 if b % 7 != 3 else 0
        if entry:
            expected["s", b + 1] = entry
    got = {(r.source, r.block): r.entry for r in entries_of_blocks(frame, limit).collect()}
    assert got == expected


def test_no_block_is_entered_late_without_maps(spark):
    frame = spark.createDataFrame([], "source string, block long, exits array<int>")
    assert entries_of_blocks(frame, 3).collect() == []
