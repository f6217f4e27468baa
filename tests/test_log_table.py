"""The written table: days, levels within a day, and busy days."""

from datetime import date

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from lograft import parse_logs, write_log_table


def logs(spark, n, day_of):
    level = F.element_at(F.array(*map(F.lit, (10, 30, 50))), (F.col("id") % 3 + 1).cast("int"))
    stamp = F.date_format(F.date_add(F.lit("2024-03-01").cast("date"), day_of.cast("int")), "yyyy-MM-dd")
    filler = F.sha2(F.col("id").cast("string"), 512)
    return parse_logs(spark.range(n, numPartitions=9).select(F.concat(
        F.lit('{"level":'), level, F.lit(',"ts":"'), stamp, F.lit('T01:02:03Z","msg":"'), filler,
        F.lit('"}'),
    ).alias("line"))).select("ts", "level_num", "message")


def test_a_quiet_day_is_one_file_and_stray_days_share_one(spark, tmp_path):
    rows = logs(spark, 3000, F.when(F.col("id") % 100 == 0, F.col("id") * 7).otherwise(F.col("id") % 4))
    write_log_table(rows, str(tmp_path / "t"), days=(date(2024, 3, 1), date(2024, 3, 31)))
    days = {p.name: len(list(p.glob("*.parquet"))) for p in (tmp_path / "t").glob("day=*")}
    assert set(days.values()) == {1} and len(days) <= 6
    assert spark.read.parquet(str(tmp_path / "t")).count() == 3000


def test_row_groups_of_other_levels_are_skipped(spark, tmp_path):
    rows = logs(spark, 30_000, F.lit(0))
    write_log_table(rows, str(tmp_path / "t"), row_group_bytes=1 << 19)
    (file,) = (tmp_path / "t" / "day=2024-03-01").glob("*.parquet")
    meta = pq.ParquetFile(file).metadata
    place = [meta.schema.column(i).name for i in range(meta.num_columns)].index("level_num")
    bounds = [meta.row_group(i).column(place).statistics for i in range(meta.num_row_groups)]
    assert meta.num_row_groups >= 5
    assert sum(b.max >= 40 for b in bounds) <= meta.num_row_groups // 2
    assert spark.read.parquet(str(tmp_path / "t")).filter("level_num >= 40").count() == 10_000


def test_a_busy_day_is_many_files(spark, tmp_path):
    size = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(size)
    spark.conf.set(size, "256k")
    try:
        write_log_table(logs(spark, 30_000, F.lit(0)), str(tmp_path / "t"))
    finally:
        spark.conf.set(size, before)
    files = list((tmp_path / "t" / "day=2024-03-01").glob("*.parquet"))
    assert len(files) >= 4
