"""Records under keys in JSON files, changed by patches: each field has the value of its latest patch.

A write is a folder of its own (`version=...`) with a folder for each bucket of keys, and counts once Spark has put its mark there,
so that a write that broke off, or one that is being made, isn't seen, and one that is made again replaces itself. Nothing
that was written is changed. `compact` writes what still counts as a new version and then takes the old ones away; as a patch keeps
its time and first version, reading gives the same before, between and after these steps.

Reading is tolerant: fields that a file lacks are null or their default, unknown ones are passed over, lines that aren't
JSON of a record come out of `broken_lines` instead. Patches of equal time go by version, then by value.
"""

from __future__ import annotations

from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from folio.sources.shared import file_system

BUCKETS = 16
#: Columns of the store beside a record's own: the key as text, a patch's time, and the version it was first written in.
KEY, AT, VERSION, BROKEN = "_key", "_at", "_version", "_broken"
DONE = "_SUCCESS"


def bucket_of(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets))


def write(patches: DataFrame, folder: str, version: str, key: str, at: str, buckets: int = BUCKETS) -> None:
    """patches (key, time, and fields of which null ones are left as they are) as a version. Rows without a key are none; null fields take no room."""
    fields = [c for c in patches.columns if c not in (key, at)]
    own = F.col(key).cast("string")
    rows = patches.where(own.isNotNull()).select(own.alias(KEY), F.col(at).alias(AT), F.lit(version).alias(VERSION), *fields)
    _write(rows, folder, version, buckets)


def _write(rows: DataFrame, folder: str, version: str, buckets: int) -> None:
    dealt = rows.withColumn("bucket", bucket_of(F.col(KEY), buckets)).repartition(buckets, "bucket")
    dealt.write.mode("overwrite").partitionBy("bucket").option("ignoreNullFields", "true").json(f"{folder}/version={version}")


def versions(folder: str) -> list[str]:
    """The versions whose write has ended."""
    system, path = file_system(folder)
    found = system.get_file_info(fs.FileSelector(path, allow_not_found=True))
    names = sorted(x.base_name for x in found if x.type == fs.FileType.Directory and x.base_name.startswith("version="))
    marks = system.get_file_info([f"{path}/{name}/{DONE}" for name in names])
    return [name.removeprefix("version=") for name, mark in zip(names, marks, strict=True) if mark.type == fs.FileType.File]


def _lines(spark: SparkSession, folder: str, schema: str, at_type: str, bucket: int | None = None) -> DataFrame:
    own = StructType.fromDDL(f"{KEY} string, {AT} {at_type}, {VERSION} string, {BROKEN} string")
    whole = StructType([*own.fields, *StructType.fromDDL(schema).fields])
    names = versions(folder)
    if not names:
        return spark.createDataFrame([], whole)
    # a bucket's folders alone are listed for one key
    paths = [f"{folder}/version={v}" + (f"/bucket={bucket}" if bucket is not None else "") for v in names]
    if bucket is not None:
        system = file_system(folder)[0]
        paths = [p for p in paths if system.get_file_info(file_system(p)[1]).type == fs.FileType.Directory]
        if not paths:
            return spark.createDataFrame([], whole)
    return spark.read.schema(whole).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", BROKEN).option("recursiveFileLookup", "true").json(paths)


def broken_lines(spark: SparkSession, folder: str, schema: str, at_type: str = "timestamp") -> DataFrame:
    """Lines that are no records."""
    rows = _lines(spark, folder, schema, at_type)
    return rows.where(F.col(BROKEN).isNotNull() | F.col(KEY).isNull()).select(F.col(BROKEN).alias("line"))


def _latest(rows: DataFrame, fields: list[str]) -> DataFrame:
    """For each key and field the latest patch with a value, as time, version and value."""
    good = rows.where(F.col(BROKEN).isNull() & F.col(KEY).isNotNull())
    one = lambda c: F.max(F.when(F.col(c).isNotNull(), F.struct(F.col(AT).alias("at"), F.col(VERSION).alias("version"), F.col(c).alias("value")))).alias(c)
    return good.groupBy(KEY).agg(*map(one, fields))


def read(spark: SparkSession, folder: str, schema: str, key: str, at_type: str = "timestamp", defaults: dict | None = None, only: str | None = None, buckets: int = BUCKETS) -> DataFrame:
    """Records as they are now: the key (text) and the fields of the schema. only: the record of one key, of whose bucket alone (of so many as were written) files are read."""
    fields = StructType.fromDDL(schema).names
    bucket = None
    if only is not None:
        bucket = spark.range(1).select(bucket_of(F.lit(only), buckets)).first()[0]
    rows = _lines(spark, folder, schema, at_type, bucket)
    if only is not None:
        rows = rows.where(F.col(KEY) == only)
    value = lambda c: F.coalesce(F.col(c)["value"], F.lit((defaults or {}).get(c))).alias(c)
    return _latest(rows, fields).select(F.col(KEY).alias(key), *map(value, fields))


def compact(spark: SparkSession, folder: str, version: str, schema: str, at_type: str = "timestamp", buckets: int = BUCKETS) -> None:
    """Writes all fields that still count, under their patches' times, as a version, and removes those it was made of."""
    fields, old = StructType.fromDDL(schema).names, versions(folder)
    if version in old:
        raise ValueError(f"version {version} is there already")
    latest = _latest(_lines(spark, folder, schema, at_type), fields)
    patch = lambda c: F.struct(F.col(c)["at"].alias("at"), F.col(c)["version"].alias("version"))
    patches = F.array_distinct(F.array(F.struct(F.lit(None).cast(at_type).alias("at"), F.lit(None).cast("string").alias("version")), *[F.when(F.col(c).isNotNull(), patch(c)) for c in fields]))
    # a key without any value stays as a patch without time
    kept = F.filter(patches, lambda p: p.isNotNull() & p["version"].isNotNull())
    rows = latest.withColumn("_patch", F.explode(F.when(F.size(kept) > 0, kept).otherwise(F.slice(patches, 1, 1))))
    of = lambda c: F.when(patch(c) == F.col("_patch"), F.col(c)["value"]).alias(c)
    _write(rows.select(KEY, F.col("_patch.at").alias(AT), F.coalesce("_patch.version", F.lit(version)).alias(VERSION), *map(of, fields)), folder, version, buckets)
    system, path = file_system(folder)
    for name in old:
        system.delete_file(f"{path}/version={name}/{DONE}")  # from here on it isn't read
        system.delete_dir(f"{path}/version={name}")
