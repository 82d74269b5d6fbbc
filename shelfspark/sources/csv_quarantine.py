"""CSV exports with a quarantine: rows that cannot be read go to a side table instead of ending the load.

Every file is read by its own header: columns are taken by name, so files that have them in
another order or have more of them load all the same. What cannot be loaded is kept
with file, line number and reason:

* lines that do not fit their header or a column's type;
* lines without a value in a column that must have one;
* all lines of a file whose header lacks a column;
* headers that drifted (other order, more or fewer columns), as a notice; their lines are judged one by one.

Records are lines: a quoted field cannot hold a line break. Line numbers count from 1 (the
header). They come from the lines' places in their file blocks, one count per block,
so no file is numbered in one task. An empty file has nothing to load.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from shelfspark.session import scratch_table

QUARANTINE = "source_file string, line_number bigint, is_header boolean, reason string, line string"
BAD = "_unreadable"


@dataclass(frozen=True)
class Load:
    """The rows that were read and the lines that were not."""
    rows: DataFrame
    quarantine: DataFrame


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """``file``, ``line_number`` and ``line`` of every line of the files under ``path``."""
    raw = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                                       F.monotonically_increasing_id().alias("place"))
    raw = scratch_table(raw, "csv-lines")   # places belong to one reading
    per_block = raw.groupBy("file", "block").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("file").orderBy("block")) - F.col("n")    # a row per block
    inside = F.row_number().over(Window.partitionBy("file", "block").orderBy("place"))    # the lines of a block
    return (raw.withColumn("inside", inside).join(per_block.select("file", "block", before.alias("before")), ["file", "block"])
            .select("file", (F.col("before") + F.col("inside")).alias("line_number"), F.col("value").alias("line")))


def header_of(line: str, separator: str = ",") -> list[str]:
    return [c.strip().strip('"').strip("﻿") for c in line.split(separator)]


def read_quarantined(spark: SparkSession, path: str, schema: StructType, date_format: str = "yyyy-MM-dd", separator: str = ",") -> Load:
    """The files under ``path`` as rows of ``schema``, and what could not be read."""
    lines = scratch_table(numbered_lines(spark, path), "csv-numbered")
    heads = lines.filter("line_number = 1").select("file", "line")
    declared = schema.fieldNames()
    rows, bad = spark.createDataFrame([], schema), spark.createDataFrame([], QUARANTINE)
    options = {"sep": separator, "dateFormat": date_format, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": BAD}
    for header in [r[0] for r in heads.select("line").distinct().collect()]:       # one for each form of the export
        names = header_of(header, separator)
        missing = [c for c in declared if c not in names]
        repeated = sorted({c for c in names if c in declared and names.count(c) > 1})
        files = heads.filter(F.col("line") == header).select("file")
        mine = lines.join(files, "file", "left_semi")
        if names != declared:
            drift = f"header drift: missing {missing}, unknown {[c for c in names if c not in declared]}" if missing or set(names) - set(declared) else "header drift: order"
            bad = bad.unionByName(as_bad(mine.filter("line_number = 1"), F.lit(drift)))
        body = mine.filter("line_number > 1")
        if missing or repeated:
            bad = bad.unionByName(as_bad(body, F.lit(f"header lacks {missing}" if missing else f"header repeats {repeated}")))
            continue
        fields = [StructField(c, schema[c].dataType if c in declared else StringType(), True) for c in names] + [StructField(BAD, StringType(), True)]
        ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
        parsed = body.withColumn("_r", F.from_csv("line", ddl, options))
        empty = F.concat_ws(", ", *[F.when(F.col(f"_r.{f.name}").isNull(), F.lit(f.name)) for f in schema.fields if not f.nullable])
        reason = (F.when(F.col("_r").isNull() | F.col(f"_r.{BAD}").isNotNull(), F.lit("does not fit header or types"))
                  .when(empty != "", F.concat(F.lit("no value: "), empty)))
        judged = parsed.withColumn("_reason", reason)
        bad = bad.unionByName(as_bad(judged.filter(F.col("_reason").isNotNull()), F.col("_reason")))
        rows = rows.unionByName(judged.filter(F.col("_reason").isNull()).select(*[F.col(f"_r.{c}").alias(c) for c in declared]))
    return Load(rows, bad)


def as_bad(lines: DataFrame, reason) -> DataFrame:
    return lines.select(F.col("file").alias("source_file"), "line_number", (F.col("line_number") == 1).alias("is_header"), reason.alias("reason"), "line")
