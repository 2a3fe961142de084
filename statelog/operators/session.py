"""A script of commands and what it prints."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from statelog.functions import commands as c


def read_script(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, line) of a script file, from 0."""
    rows = spark.read.text(path, wholetext=True)
    return rows.select(F.posexplode(F.split("value", "\r?\n")).alias("line_no", "line")).select(F.col("line_no").cast("long").alias("line_no"), "line")


def write_output(printed: DataFrame, path: str) -> None:
    """What a session prints as text files, whose lines are in order over their names."""
    printed.repartitionByRange("line_no").sortWithinPartitions("line_no").select("output").write.text(path)


def session(lines: DataFrame) -> DataFrame:
    """(line_no, output) for each line of ``lines`` (line_no, line) that prints something, up to EXIT or QUIT.

    Lines are parsed once, and one window per key gives every get the newest
    operation of the lines before it. Lines without a key count as keys of their
    own, so that they don't meet in one task.
    """
    lines = lines.select("line_no", "line")
    maybe = c.parse_lines(lines.filter(F.upper("line").rlike("EXIT|QUIT")))
    stop = maybe.filter(F.col("call.cmd").isin("EXIT", "QUIT")).agg(F.coalesce(F.min("line_no"), F.lit((1 << 63) - 1)).alias("stop"))
    calls = c.parse_lines(lines.crossJoin(F.broadcast(stop)).filter("line_no < stop").drop("stop"))  # one row
    calls = calls.select("line_no", "call.*")
    n, arg = F.size("args"), lambda i: F.get("args", F.lit(i))
    ttl = c.duration_ns(F.coalesce(arg(2), F.lit("")))
    put = (F.col("cmd") == "PUT") & n.isin(2, 3)
    stored = put & ((n == 2) | ttl.isNotNull())
    deleted = (F.col("cmd") == "DELETE") & (n == 1)
    asked = (F.col("cmd") == "GET") & (n == 1)
    kind = F.when(~F.col("ok"), "bad").when(stored, "put").when(deleted, "delete").when(asked, "get").otherwise("other")
    rows = calls.withColumn("kind", kind)
    is_op = F.col("kind").isin("put", "delete")
    own = F.struct(F.when(is_op | (F.col("kind") == "get"), arg(0)).alias("key"), F.when(~(is_op | (F.col("kind") == "get")), F.col("line_no")).alias("line"))
    before = Window.partitionBy("own").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    op = F.when(is_op, F.struct(F.when(F.col("kind") == "put", arg(1)).alias("value")))
    rows = rows.withColumn("own", own).withColumn("seen", F.last(op, ignorenulls=True).over(before))
    usage = F.element_at(F.create_map(*[F.lit(x) for kv in c.USAGE.items() for x in kv]), F.col("cmd"))
    said = (
        F.when(F.col("kind") == "bad", F.when(F.col("err") != "", F.concat(F.lit("parse error: "), "err")))
        .when(is_op, "OK")
        .when(F.col("kind") == "get", F.coalesce("seen.value", F.lit(c.NIL)))
        .when(put, c.BAD_TTL)
        .when(F.col("cmd").isin(*c.USAGE), usage)
        .otherwise(c.UNKNOWN)
    )
    return rows.select("line_no", said.alias("output")).filter("output IS NOT NULL")
