"""File sources and sinks (SRC-1…SRC-5, SNK-1…SNK-3, PRE-1).

* Row identity (PRE-1): rows read from files get ``row_id`` = file rank (by path) × 2⁴⁰ +
  position inside the file, so "first in file order" survives any partitioning.  The
  position comes from ``monotonically_increasing_id`` minus the file's smallest id, the
  per-file minimum being a small aggregate (one row per file, broadcast after a size check).
* Encodings (SRC-3): each file's bytes are tested with ``is_valid_utf8`` in a ``binaryFile``
  scan; files are then read with their own charset and unioned.
* BOM CSV (SNK-1): the first header cell is prefixed with U+FEFF, which writes EF BB BF.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# Encodings tried in order (first that decodes wins).
ENCODINGS = ["utf-8-sig", "utf-8", "windows-1256", "cp1256", "ISO-8859-6"]
BOM = "﻿"


def _as_list(paths: str | Sequence[str]) -> list[str]:
    return [paths] if isinstance(paths, str) else list(paths)


def with_file_row_ids(df: DataFrame, row_id: str = "row_id", file_col: str = "_file") -> DataFrame:
    """PRE-1: add ``row_id`` in file order (file rank by path, then position in the file)."""
    if file_col not in df.columns:
        df = df.withColumn(file_col, F.col("_metadata.file_path"))
    tagged = df.withColumn("_mid", F.monotonically_increasing_id())
    per_file = tagged.groupBy(file_col).agg(F.min("_mid").alias("_min"))
    per_file = per_file.withColumn("_rank", F.row_number().over(Window.orderBy(file_col)) - 1)
    out = tagged.join(per_file, file_col)  # one row per file; the planner picks the join
    return out.withColumn(row_id, F.shiftleft(F.col("_rank").cast("bigint"), 40) + (F.col("_mid") - F.col("_min"))) \
        .drop("_mid", "_min", "_rank")


def read_csv(spark: SparkSession, paths: str | Sequence[str], schema: StructType | str,
             header: bool = True, sep: str = ",", encoding: str = "UTF-8", row_id: str | None = "row_id",
             na_tokens: Sequence[str] | None = None) -> DataFrame:
    """SRC-1 / SRC-2: CSV/TSV with a fixed schema, quoted multi-line fields, BOM stripped.

    Only the empty cell is null unless ``na_tokens`` lists extra null spellings.
    """
    enc = "UTF-8" if encoding.lower() in ("utf-8-sig", "utf8", "utf-8") else encoding
    allow_charset(spark, enc)
    r = (spark.read.schema(schema).option("header", header).option("sep", sep).option("multiLine", True)
         .option("quote", '"').option("escape", '"').option("encoding", enc).option("mode", "PERMISSIVE"))
    df = r.csv(_as_list(paths))
    if header and df.columns and df.columns[0].startswith(BOM):
        df = df.withColumnRenamed(df.columns[0], df.columns[0][1:])
    if na_tokens:
        string_cols = [f.name for f in df.schema.fields if f.dataType.simpleString() == "string"]
        df = df.withColumns({c: F.when(F.col(c).isin(list(na_tokens)), F.lit(None)).otherwise(F.col(c))
                             for c in string_cols})
    if row_id:
        df = with_file_row_ids(df, row_id).drop("_file")
    return df


UNICODE_CHARSETS = {"utf-8", "us-ascii", "iso-8859-1", "utf-16", "utf-16be", "utf-16le", "utf-32"}


def allow_charset(spark: SparkSession, charset: str) -> None:
    """Single-byte code pages such as windows-1256 need Java's full charset list enabled."""
    if charset.lower() not in UNICODE_CHARSETS:
        spark.conf.set("spark.sql.legacy.javaCharsets", "true")


def read_tsv(spark: SparkSession, paths: str | Sequence[str], names: Sequence[str],
             row_id: str | None = "row_id") -> DataFrame:
    """SRC-2: headerless TSV with the column names given (all strings)."""
    schema = ", ".join(f"`{n}` string" for n in names)
    return read_csv(spark, paths, schema, header=False, sep="\t", row_id=row_id)


def detect_encodings(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """SRC-3 step 1: ``path, encoding`` per file — ``utf-8`` when the bytes are valid UTF-8,
    else the first single-byte fallback (windows-1256 decodes every byte)."""
    b = spark.read.format("binaryFile").load(_as_list(paths))
    return b.select(F.col("path"), F.when(F.is_valid_utf8("content"), F.lit("utf-8"))
                    .otherwise(F.lit("windows-1256")).alias("encoding"))


def read_csv_any_encoding(spark: SparkSession, paths: str | Sequence[str], schema: StructType | str,
                          row_id: str | None = "row_id", **kw) -> DataFrame:
    """SRC-3: read each file with the first encoding that decodes it, union by name.

    The per-file routing table is one row per file (driver-side list, bounded by the
    number of files); the data itself is read by the normal CSV scan.
    """
    routes = detect_encodings(spark, paths).collect()
    groups: dict[str, list[str]] = {}
    for r in routes:
        groups.setdefault(r["encoding"], []).append(r["path"])
    out = None
    for enc, files in sorted(groups.items()):
        part = read_csv(spark, files, schema, encoding=enc, row_id=None, **kw) \
            .withColumn("_encoding", F.lit(enc)).withColumn("_file", F.col("_metadata.file_path"))
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no input files")
    return (with_file_row_ids(out, row_id) if row_id else out).drop("_file")


def write_csv(df: DataFrame, path: str, bom: bool = True, mode: str = "overwrite", sep: str = ",",
              header: bool = True) -> str:
    """SNK-1: CSV with header, no index; UTF-8 with BOM (EF BB BF) when ``bom``."""
    out = df
    if bom and header and df.columns:
        out = df.withColumnRenamed(df.columns[0], BOM + df.columns[0])
    (out.write.mode(mode).option("header", header).option("sep", sep).option("quote", '"')
     .option("escape", '"').option("encoding", "UTF-8").csv(path))
    return path


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(conf), p, jvm


def atomic_replace(df: DataFrame, path: str, fmt: str = "parquet", **options) -> str:
    """SNK-2: write to a temporary sibling folder, then swap it into place.

    A failed write leaves the old table untouched (Spark's job commit protocol covers the write
    itself). Between the two renames no table stands at ``path``; where readers must find one at
    any moment, use ``publish`` and ``read_published``.
    """
    spark = df.sparkSession
    tmp = f"{path.rstrip('/')}.tmp-{uuid.uuid4().hex[:8]}"
    df.write.mode("overwrite").format(fmt).options(**options).save(tmp)
    fs, target, jvm = _fs(spark, path)
    _, tmp_path, _ = _fs(spark, tmp)
    old = None
    if fs.exists(target):
        old = jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}.old-{uuid.uuid4().hex[:8]}")
        fs.rename(target, old)
    if not fs.rename(tmp_path, target):
        if old is not None:
            fs.rename(old, target)
        raise OSError(f"could not move {tmp} to {path}")
    if old is not None:
        fs.delete(old, True)
    return path


POINTER = "_current"


def publish(df: DataFrame, path: str, fmt: str = "parquet", keep: int = 2, **options) -> str:
    """SNK-2 without a gap: write a new version folder under ``path``, then put a one-line pointer file that
    names it in place by a single overwriting rename. Returns the version's folder.

    Readers (``read_published``) follow the pointer, so they see the old or the new whole table at any
    moment, and a failed write leaves the old one. Of two writers the later rename wins; neither
    touches the other's folder. The ``keep`` latest versions stay for readers that are under way, older
    ones go. The rename is atomic where the file system's is (HDFS, local disks).
    """
    spark = df.sparkSession
    base = path.rstrip("/")
    fs, root, jvm = _fs(spark, base)
    of = jvm.org.apache.hadoop.fs.Path
    version = f"v-{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
    df.write.format(fmt).options(**options).save(f"{base}/{version}")
    fresh = of(f"{base}/{POINTER}-{uuid.uuid4().hex[:8]}")
    stream = fs.create(fresh, True)
    stream.write(version.encode())
    stream.close()
    over = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 1)
    over[0] = getattr(jvm.org.apache.hadoop.fs, "Options$Rename").OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.makeQualified(root).toUri(), fs.getConf()).rename(
        fs.makeQualified(fresh), fs.makeQualified(of(f"{base}/{POINTER}")), over)
    current = published_version(spark, base)
    versions = sorted(s.getPath().getName() for s in fs.listStatus(root) if s.getPath().getName().startswith("v-"))
    for old in versions[:versions.index(current)][:-keep + 1 or None] if current in versions else []:
        fs.delete(of(f"{base}/{old}"), True)
    return f"{base}/{version}"


def published_version(spark: SparkSession, path: str) -> str | None:
    """Name of the version folder that the pointer of a published table names."""
    fs, pointer, jvm = _fs(spark, f"{path.rstrip('/')}/{POINTER}")
    if not fs.exists(pointer):
        return None
    stream = fs.open(pointer)
    name = jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    stream.close()
    return name


def read_published(spark: SparkSession, path: str, fmt: str = "parquet", **options) -> DataFrame:
    """The table that ``publish`` put at ``path`` last; it stays whole while it is read (see ``keep``)."""
    version = published_version(spark, path)
    if version is None:
        raise FileNotFoundError(f"nothing is published at {path}")
    return spark.read.format(fmt).options(**options).load(f"{path.rstrip('/')}/{version}")


def write_result_set(frames: Mapping[str, DataFrame], base: str, partition_by: str | None = "model",
                     fmt: str = "parquet") -> dict[str, str]:
    """SNK-3: one table per result kind (results, confusion, report, pairs, per-class),
    each partitioned by model."""
    out = {}
    for kind, f in frames.items():
        path = f"{base.rstrip('/')}/{kind}"
        w = f.write.mode("overwrite").format(fmt)
        if partition_by and partition_by in f.columns:
            w = w.partitionBy(partition_by)
        w.save(path)
        out[kind] = path
    return out
