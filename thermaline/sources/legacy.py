"""Older trees of Parquet, JSON lines and Arrow files into history rows (S-20).

Identity comes from the path alone: exactly one safe `building=` and `equipment=` folder. JSON and Arrow values arrive as text and pass
the same rules as CSV cells, so each format gives the rows its Parquet form would give.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from thermaline.functions.roles import ALL_ROLES, EQ, STRING_COLUMNS, TS, history_schema, role_type
from thermaline.sources.csv_ingest import cell_number, rfc3339

C = F.col
# Recognised file extensions.
FORMATS = {"parquet": ["parquet"], "jsonl": ["jsonl", "ndjson"], "arrow": ["feather", "arrow", "ipc"]}


def _glob(kind: str) -> str:
    letters = lambda e: "".join(f"[{c}{c.upper()}]" for c in e)
    return "*.{" + ",".join(letters(e) for e in FORMATS[kind]) + "}"


def identity(path: Column) -> tuple[Column, Column, Column]:
    """building_id, equipment_id, and why the path has no trusted identity (null if it has one)."""
    def values(key: str) -> Column:
        return F.array_distinct(F.transform(F.regexp_extract_all(path, F.lit(f"/{key}=([^/]*)(?=/)")), lambda v: F.trim(F.url_decode(v))))

    out, why = [], []
    for key in ("building", "equipment"):
        v = values(key)
        bad = F.exists(v, lambda x: (x == "") | F.contains(x, F.lit("..")) | x.rlike(r"[\\=/\x00]"))
        why.append(F.when(F.size(v) == 0, f"no {key} in the path").when(bad, f"unsafe {key} in the path").when(F.size(v) > 1, f"two {key}s in the path"))
        out.append(F.get(v, F.lit(0)))
    file = F.lower(F.element_at(F.split(path, "/"), -1))
    misnamed = F.when(file.endswith(".parquet") & ~path.rlike(r"/history\.parquet(/|$)"), "Parquet not called history.parquet")
    return out[0], out[1], F.coalesce(*why, misnamed)


def discover(spark: SparkSession, root: str) -> DataFrame:
    """path, format, building_id, equipment_id, eligible and reason of every recognised file; no file is opened."""
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select(F.replace("path", F.lit("%"), F.lit("%25")).alias("path")))
    kind = F.lower(F.regexp_extract("path", r"\.([A-Za-z]+)$", 1))
    fmt = F.coalesce(*[F.when(kind.isin(ends), k) for k, ends in FORMATS.items()])
    building, equipment, why = identity(C("path"))
    return files.select("path", fmt.alias("format"), building.alias("building_id"), equipment.alias(EQ), why.isNull().alias("eligible"),
                        why.alias("reason")).where("format IS NOT NULL")


def _files(spark: SparkSession, kind: str):
    return spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", _glob(kind))


def _identified(df: DataFrame, path: Column) -> DataFrame:
    building, equipment, why = identity(path)
    return df.select("*", building.alias("building_id"), equipment.alias(EQ), why.alias("_why")).where("_why IS NULL").drop("_why")


def _typed(df: DataFrame, roles) -> DataFrame:
    """Columns of text as history rows."""
    role = lambda r: (F.when(F.trim(r) != "", F.trim(r)) if r in STRING_COLUMNS else cell_number(C(r))).cast(role_type(r)).alias(r)
    return df.select("building_id", EQ, rfc3339(C(TS)).alias(TS), *[role(r) for r in roles])


def read_json(spark: SparkSession, root: str, roles) -> DataFrame:
    schema = T.StructType([T.StructField(c, T.StringType()) for c in (TS, *roles)])
    return _typed(_identified(_files(spark, "jsonl").schema(schema).json(root), C("_metadata.file_path")), roles)


def arrow_batches(content: bytes, columns: list[str]) -> Iterator[pa.RecordBatch]:
    """The named columns of an Arrow file, Arrow stream or the first Feather format, batch by batch, as text; absent ones are null."""
    from pyarrow import feather, ipc

    if content[:6] == b"ARROW1":
        file = ipc.open_file(content)
        batches = (file.get_batch(i) for i in range(file.num_record_batches))
    elif content[:4] == b"FEA1":
        table = feather.read_table(pa.BufferReader(content))
        batches = table.to_batches(max_chunksize=1 << 16)
    else:
        batches = ipc.open_stream(content)
    for batch in batches:
        yield pa.record_batch([_text(batch, c) for c in columns], names=columns)


def _text(batch: pa.RecordBatch, name: str) -> pa.Array:
    at = batch.schema.get_field_index(name)  # -1 where absent or named twice
    if at < 0:
        return pa.nulls(batch.num_rows, pa.string())
    values = batch.column(at)
    if pa.types.is_dictionary(values.type):
        values = values.dictionary_decode()
    if pa.types.is_timestamp(values.type):  # stamps without a zone are UTC
        values = pc.strftime(values.cast(pa.timestamp("us", "UTC"), safe=False), format="%Y-%m-%dT%H:%M:%SZ")
    return values.cast(pa.string())


def read_arrow(spark: SparkSession, root: str, roles) -> DataFrame:
    """Arrow files through Spark's own file reader, so any file system serves; a task holds one file's bytes (2 GB at most) and one
    batch of its rows, and converts only the wanted columns."""
    wanted = [TS, *roles]
    raw = _files(spark, "arrow").format("binaryFile").load(root).withColumn("path", F.replace("path", F.lit("%"), F.lit("%25")))
    raw = _identified(raw, C("path")).select("building_id", EQ, "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                ids = [batch.column(i)[row].as_py() for i in (0, 1)]
                for part in arrow_batches(batch.column(2)[row].as_py(), wanted):
                    own = [pa.array([x] * part.num_rows, pa.string()) for x in ids]
                    yield pa.record_batch([*own, *part.columns], names=["building_id", EQ, *wanted])

    kinds = T.StructType([T.StructField(c, T.StringType()) for c in ("building_id", EQ, *wanted)])
    return _typed(raw.mapInArrow(run, kinds), roles)


def read_mixed(spark: SparkSession, root: str, *, roles=None) -> DataFrame:
    """building_id, equipment_id, timestamp_utc and roles of all eligible files of all formats."""
    roles = list(roles or ALL_ROLES)
    schema = T.StructType([f for f in history_schema(roles, partitioned=False).fields if f.name != EQ])
    parquet = _identified(_files(spark, "parquet").schema(schema).parquet(root), C("_metadata.file_path")).select("building_id", EQ, TS, *roles)
    return parquet.unionByName(read_json(spark, root, roles)).unionByName(read_arrow(spark, root, roles))
