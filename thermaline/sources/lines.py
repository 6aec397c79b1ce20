"""Delimited text with the place of every record (S-15, S-32).

Files are read in splits by many tasks. A record's number is its place within its split, from an id that rises within a
task, plus the records of the file's earlier splits: one aggregation gives one row per split, and no file passes one task.
Numbers count the records that aren't blank, as a sequential reader does; the first is the header.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

C = F.col
_CELL = r',("[^"]*+(?:""[^"]*+)*+"|[^,]*)'


def numbered_lines(spark: SparkSession, root: str, *, name: str) -> DataFrame:
    """source_file, line_number (from 1, blank lines not counted) and value of every line of the files called `name`.

    Both passes must cut files alike, so the parallelism that enters the size of splits is fixed in the session where it is unset;
    a split that the second pass meets and the first did not is an error, never a wrong number. Files may not change meanwhile.
    """
    if spark.conf.get("spark.sql.files.minPartitionNum", None) is None:
        spark.conf.set("spark.sql.files.minPartitionNum", str(spark.sparkContext.defaultParallelism))
    raw = (spark.read.option("pathGlobFilter", name).option("recursiveFileLookup", True).text(root).where(F.trim("value") != "")
           .select("value", C("_metadata.file_path").alias("source_file"), C("_metadata.file_block_start").alias("_split"),
                   F.monotonically_increasing_id().alias("_at")))
    before = Window.partitionBy("source_file").orderBy("_split").rowsBetween(Window.unboundedPreceding, -1)
    splits = (raw.groupBy("source_file", "_split").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
              .select("source_file", "_split", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")))
    known = F.when(C("_first") <= C("_at"), C("_before") + C("_at") - C("_first") + 1).otherwise(
        F.raise_error(F.lit("files were cut unlike between two passes; set spark.sql.files.minPartitionNum")).cast("long"))
    return raw.join(splits, ["source_file", "_split"], "left").select("source_file", known.alias("line_number"), "value")


def cells(line: Column) -> Column:
    """The trimmed cells of a comma-separated line; quoted cells may hold commas and doubled quotes."""
    found = F.regexp_extract_all(F.concat(F.lit(","), line), F.lit(_CELL), F.lit(1))
    plain = lambda x: F.when(x.startswith('"') & x.endswith('"') & (F.length(x) > 1),
                             F.replace(x.substr(F.lit(2), F.length(x) - 2), F.lit('""'), F.lit('"'))).otherwise(x)
    return F.transform(found, lambda x: F.trim(plain(x)))


def open_quote(line: Column) -> Column:
    """A quote that the line doesn't close."""
    return F.length(F.regexp_replace(line, '[^"]', "")) % 2 == 1


def records(spark: SparkSession, root: str, *, name: str) -> DataFrame:
    """source_file, source_row_number (from 1, after the header), line, cells, and the file's header as `names`."""
    lines = numbered_lines(spark, root, name=name)
    head = lines.where("line_number = 1").select("source_file", cells(F.ltrim(C("value"), F.lit("\ufeff"))).alias("names"))
    body = lines.where("line_number > 1").select("source_file", (C("line_number") - 1).alias("source_row_number"), C("value").alias("line"))
    return body.join(head, "source_file").withColumn("cells", cells(C("line")))


def reason(raw_stamp: Column, stamp: Column) -> Column:
    """ok, or why a record of `records` is set aside. Missing cells at a line's end are blank, more cells than names are malformed."""
    return (F.when(open_quote(C("line")), "open_quote").when(F.size("cells") > F.size("names"), "too_many_cells")
             .when(F.coalesce(raw_stamp, F.lit("")) == "", "blank_stamp").when(stamp.isNull(), "bad_stamp").otherwise("ok"))


def preview(rows: DataFrame, limit: int = 25) -> DataFrame:
    """The first records of each file, by their numbers."""
    return rows.where(C("source_row_number") <= limit).orderBy("source_file", "source_row_number")
