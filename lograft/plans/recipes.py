"""Log lines in the shapes of common logging libraries, made from the given tables.

Each recipe keeps the columns of its table and adds ``line``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lograft.session import prepare_session


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare_session(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def spread(rows: DataFrame) -> DataFrame:
    """``rows`` dealt evenly over the session's tasks, whatever files they come in. For small rows
    that much is made of: they are read as one task per file part."""
    return rows.repartition(partitions(rows.sparkSession))


def _concat(*parts: str | Column) -> Column:
    return F.concat(
        *[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts]
    )


def _by_type(**values: str | int) -> Column:
    chain = F
    for event_type, value in values.items():
        chain = chain.when(F.col("event_type") == event_type, F.lit(value))
    return chain


def _micros() -> Column:
    return F.unix_micros(F.col("ts").cast("timestamp"))


def cents() -> Column:
    return F.round(F.col("value") * 100).cast("bigint")


def pino_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numeric level, epoch milliseconds, a nested object."""
    level = _by_type(view=10, click=20, signup=30, purchase=40, error=50)
    millis = F.expr("unix_micros(cast(ts as timestamp)) div 1000")
    return table(spark, sf_dir, "events").withColumn(
        "line",
        _concat(
            '{"level":', level, ',"time":', millis, ',"msg":"', F.col("event_type"),
            '","pid":', F.col("user_id"), ',"id":', F.col("event_id"), ',"props":',
            F.col("props"), "}",
        ),
    )


def logrus_lines(spark: SparkSession, sf_dir: str, error: str = "") -> DataFrame:
    """RFC 3339 time, level names in several spellings; ``error`` is JSON text put in front."""
    level = _by_type(view="trc", click="Debug", signup="info", purchase="WARNING", error="err")
    stamp = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    return table(spark, sf_dir, "events").withColumn(
        "line",
        _concat(
            '{"time":"', stamp, '","level":"', level, '","msg":"', F.col("event_type"), '",',
            error, '"cents":', cents(), "}",
        ),
    )


def zap_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Float seconds, a level name that is not built in, logger and caller."""
    seconds = F.expr("unix_micros(cast(ts as timestamp)) div 1000000")
    return table(spark, sf_dir, "events").withColumn(
        "line",
        _concat(
            '{"ts":', seconds, '.5,"level":"verbose","logger":"svc","caller":"a.go:',
            F.col("user_id"), '","msg":"', F.col("event_type"), '","cents":', cents(), "}",
        ),
    )


def slog_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Upper-case level names, a source and a component of its own."""
    level = _by_type(view="DEBUG", click="DEBUG", signup="INFO", purchase="WARN", error="ERROR")
    stamp = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    return table(spark, sf_dir, "events").withColumn(
        "line",
        _concat(
            '{"time":"', stamp, '","level":"', level, '","msg":"', F.col("event_type"),
            '","source":"monitor","component":"checker-', F.col("user_id"), '","cents":', cents(),
            ',"limit":1500,"host":"web-', F.col("event_id") % 10, '"}',
        ),
    )


def bunyan_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numeric level, a version and a name, an object for the place in the code."""
    level = _by_type(view=10, click=20, signup=30, purchase=40, error=50)
    stamp = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    return table(spark, sf_dir, "events").withColumn(
        "line",
        _concat(
            '{"v":0,"name":"shop","hostname":"host-', F.col("event_id") % 10, '","pid":',
            F.col("user_id"), ',"level":', level, ',"msg":"', F.col("event_type"), '","time":"', stamp,
            '","src":{"file":"db/pool.x","line":', F.col("event_id") % 500, '},"cents":', cents(),
            ',"waiting":15}',
        ),
    )


def structlog_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The message as ``event``, a named logger, an amount with a fraction, many fields."""
    level = _by_type(view="debug", click="debug", signup="info", purchase="warning", error="error")
    stamp = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    return table(spark, sf_dir, "events").withColumn(
        "line",
        _concat(
            '{"event":"', F.col("event_type"), '","level":"', level, '","timestamp":"', stamp,
            '","logger":"shop.orders","amount":', F.col("event_id") % 100, '.25,"currency":"EUR",'
            '"customer_id":"c-', F.col("user_id"), '","method":"card","transaction_id":"t-',
            F.col("event_id"), '","region":"eu-1"}',
        ),
    )


def sized_lines(spark: SparkSession, sf_dir: str, fields: int) -> DataFrame:
    """Records with so many further fields; 1, 10 and 40 make short, usual and long lines."""
    extra = F.array_join(
        F.transform(
            F.sequence(F.lit(1), F.lit(fields)),
            lambda i: F.concat(F.lit(',"field_'), i, F.lit('":"value with some more text '), i, F.lit('"')),
        ),
        "",
    )
    stamp = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return table(spark, sf_dir, "events").withColumn(
        "line",
        _concat('{"level":"info","msg":"', F.col("event_type"), '","ts":"', stamp, '"', extra, "}"),
    )


def mixed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records among plain text, records without a level, broken ones and empty lines."""
    last = F.col("event_id") % 10
    pino = F.col("line")
    return pino_lines(spark, sf_dir).withColumn(
        "line",
        F.when(last == 0, _concat("plain ", F.col("event_type"), " ", F.col("event_id")))
        .when(last == 1, F.regexp_replace(pino, '"level":[0-9]+,', ""))
        .when(last == 2, F.regexp_replace(pino, r"\}$", ",}"))
        .when(last == 3, F.lit(""))
        .otherwise(pino),
    )


def embedded_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record behind a text prefix, epoch nanoseconds."""
    return table(spark, sf_dir, "events").withColumn(
        "line",
        _concat(
            "  app-", F.col("user_id"), ' | {"severity":"err","event":"', F.col("event_type"),
            '","ts":', _micros(), "000}",
        ),
    )


def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents as messages of records."""
    record = F.to_json(
        F.struct(
            F.col("text").alias("msg"), F.col("source"), F.col("lang"),
            F.struct(F.col("n_chars").alias("chars"), F.col("lang").alias("tongue")).alias("meta"),
            F.col("text").alias("whole"),
        )
    )
    return table(spark, sf_dir, "documents").withColumn("line", record)


def nested_number_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers in several forms, inside objects and arrays."""
    return table(spark, sf_dir, "events").withColumn(
        "line",
        _concat(
            '{"msg":{"b":1.0,"id":', F.col("event_id"), ',"a":1e10,"c":-0.0,"s":"1e10"},"n":{"x":{"y":',
            F.col("user_id"), '.0,"big":1e300,"a":[1e10,', F.col("event_id"), ',1.50]}}}',
        ),
    )


def epoch_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Epoch numbers in seconds, before 1970, out of range and in milliseconds."""
    micros = _micros()
    number = (
        F.when(F.pmod("event_id", F.lit(4)) == 0, F.expr("unix_micros(cast(ts as timestamp)) div 1000000"))
        .when(F.pmod("event_id", F.lit(4)) == 1, -F.col("event_id"))
        .when(F.pmod("event_id", F.lit(4)) == 2, F.lit(999_999_999_999))
        .otherwise(F.floor(micros / 1000))
    )
    return table(spark, sf_dir, "events").withColumn("line", _concat('{"ts":', number, "}"))


def rare_stamp_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times without dashes and colons, without seconds, with a comma, with a zone in brackets."""
    at = F.col("ts").cast("timestamp")
    shapes = [
        F.date_format(at, "yyyyMMdd'T'HHmmss'Z'"), F.date_format(at, "yyyy-MM-dd'T'HH:mm'Z'"),
        F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss,SSSSSS'Z'"),
        F.date_format(at, "yyyy-MM-dd HH:mm:ss.SSS'+00:00[UTC]'"),
    ]
    stamp = F.element_at(F.array(*shapes), (F.pmod("event_id", F.lit(4)) + 1).cast("int"))
    return table(spark, sf_dir, "events").withColumn("line", _concat('{"time":"', stamp, '"}'))


def level_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Levels as whole numbers, fractions, and numbers in quotes, which are no numbers."""
    number = F.pmod("event_id", F.lit(70)).cast("string")
    level = (
        F.when(F.pmod("event_id", F.lit(3)) == 0, F.concat(F.lit('"'), number, F.lit('"')))
        .when(F.pmod("event_id", F.lit(3)) == 1, F.concat(number, F.lit(".9")))
        .otherwise(number)
    )
    return table(spark, sf_dir, "events").withColumn("line", _concat('{"level":', level, "}"))


def conversation_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One record per turn, its text with raw line ends inside the string."""
    return table(spark, sf_dir, "conversations").withColumn(
        "line",
        _concat(
            '{"level":"info","conv":', F.col("conv_id"), ',"turn":', F.col("turn"), ',"msg":"',
            F.col("text"), '"}',
        ),
    )


def conversation_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records of :func:`conversation_records` as the lines of a file per conversation."""
    return conversation_records(spark, sf_dir).select(
        F.col("conv_id").cast("string").alias("source"),
        "turn",
        F.posexplode(F.split("line", "\n")).alias("_at", "line"),
    ).select("source", (F.shiftleft(F.col("turn"), 32) + F.col("_at")).alias("position"), "line")
