"""Readers for logs, flow files, archives and feature tables."""

from __future__ import annotations

import csv
import io
import zipfile
from collections.abc import Iterator, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import nan_to_null, named
from ..session import cut_lineage
from ..schema import DATASET_FLOW, DHCP_LOG, DNS_LOG, FEATURE_TABLE, FLOW_LOG

CSV_OPTIONS = {
    "header": "true",
    "mode": "PERMISSIVE",
    "ignoreLeadingWhiteSpace": "true",
    "ignoreTrailingWhiteSpace": "true",
}


def _exists(spark: SparkSession, path: str) -> bool:
    """Whether any file matches a path or glob, on whatever file system it names."""
    jvm = spark._jvm
    pattern = jvm.org.apache.hadoop.fs.Path(path)
    found = pattern.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(pattern)
    return found is not None and len(found) > 0


def list_files(spark: SparkSession, pattern: str, max_files: int | None = None) -> list[str]:
    """ORD4: the files matching a glob in name order, at most `max_files`."""
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path) or []
    names = sorted(f.getPath().toString() for f in found)
    return names if max_files is None else names[:max_files]


def _names(header: str | None, sep: str = ",") -> list[str]:
    return [c.strip() for c in next(csv.reader([header], delimiter=sep))] if header and header.strip() else []


def _lines(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Every line of the files with its file and a number that grows along the file."""
    place = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    return spark.read.text(list(paths)).select(F.col("_metadata.file_path").alias("file"), place.alias("place"), F.col("value").alias("line"))


def _file_headers(lines: DataFrame) -> DataFrame:
    """(file, header): each file's first line, found by a job over the files' first splits."""
    return lines.where("place.block = 0").groupBy("file").agg(F.min_by("line", "place").alias("header"))


def _parsed(lines: DataFrame, header: str, kinds: dict[str, str], sep: str = ",", **options: str) -> DataFrame:
    """Lines that share a header as columns of their kinds, text where none is given."""
    names = _names(header, sep) if sep == "," else [n.strip() for n in header.split(sep)]
    text = ", ".join(f"`{n}` string" for n in names)
    row = lines.select(F.from_csv("line", text, {"mode": "PERMISSIVE", "sep": sep, **options}).alias("_r"))
    return row.select(*[F.trim(named("_r").getField(n)).alias(n) for n in names]).select(*[_typed(n, kinds.get(n, "string")) for n in names])


def _typed(name: str, kind: str) -> Column:
    if kind == "timestamp":
        return F.try_to_timestamp(named(name)).alias(name)
    if kind in ("bigint", "int"):  # counters are often written as 12.0
        return named(name).try_cast("double").try_cast(kind).alias(name)
    return named(name).try_cast(kind).alias(name)


def _by_header(spark: SparkSession, paths: Sequence[str], schema: T.StructType) -> DataFrame | None:
    """Files with headers of their own, matched by name; None if no file has a column.

    The headers are few and come to the driver, the files do not. Files that all share one
    header are left to Spark's CSV reader, which reads only the columns asked for.
    """
    kinds = {f.name: f.dataType.simpleString() for f in schema.fields}
    lines = _lines(spark, paths)
    headers = _file_headers(lines)
    distinct = sorted(r["header"] for r in headers.select("header").distinct().collect() if _names(r["header"]))
    if not distinct:
        return None
    if len(distinct) == 1:
        raw = spark.read.options(**CSV_OPTIONS).option("inferSchema", "false").csv(list(paths))
        return raw.select(*[_typed(c, kinds.get(c, "string")) for c in raw.columns])
    tagged = lines.join(headers, "file").where((F.trim("line") != "") & (F.col("line") != F.col("header")))
    parts = [_parsed(tagged.where(F.col("header") == h), h, kinds, ignoreLeadingWhiteSpace="true", ignoreTrailingWhiteSpace="true") for h in distinct]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def read_csv(spark: SparkSession, path: str | Sequence[str], schema: T.StructType, only_present: bool = False) -> DataFrame:
    """CSV files with headers, each file's columns matched to `schema` by name.

    The declared types are applied after reading as text, so columns may come in any order in each
    file or be absent (null); unknown columns are kept as text. A path that matches nothing, or files
    that hold none of the columns, give an empty table of the right shape. With `only_present`, columns
    that no file has are left out. A file that cannot be read is an error.
    """
    paths = [path] if isinstance(path, str) else list(path)
    paths = [p for p in paths if _exists(spark, p)]
    raw = _by_header(spark, paths, schema) if paths else None
    if raw is None or not set(raw.columns) & set(schema.names):
        return spark.createDataFrame([], schema)
    have = set(raw.columns)
    absent = [] if only_present else [f for f in schema.fields if f.name not in have]
    every = raw.withColumns({f.name: F.lit(None).cast(f.dataType) for f in absent}) if absent else raw
    order = [f.name for f in schema.fields if f.name in set(every.columns)] + [c for c in raw.columns if c not in schema.names]
    return nan_to_null(every.select(*[named(c) for c in order]))


def read_dhcp(spark: SparkSession, path: str) -> DataFrame:
    """SRC1."""
    return read_csv(spark, path, DHCP_LOG)


def read_dns(spark: SparkSession, path: str) -> DataFrame:
    """SRC2. Where no file has a response_time column, the column is dropped, not null."""
    present = read_csv(spark, path, DNS_LOG, only_present=True)
    return read_csv(spark, path, DNS_LOG) if "response_time" in present.columns else read_csv(spark, path, DNS_LOG).drop("response_time")


def read_flows(spark: SparkSession, path: str) -> DataFrame:
    """SRC3."""
    return read_csv(spark, path, FLOW_LOG)


def read_features(spark: SparkSession, path: str, schema: T.StructType = FEATURE_TABLE) -> DataFrame:
    """SRC9: a feature table; only the columns that a file has are returned."""
    return read_csv(spark, path, schema, only_present=True)


def read_zip_members(spark: SparkSession, paths: Sequence[str], suffix: str = ".csv", skip_unreadable: bool = False) -> DataFrame:
    """SRC5: the lines of the CSV files inside ZIP archives: `archive, member, header, line`.

    An archive is one task's input and is held packed, since ZIP cannot be split; what is unpacked
    is streamed in batches of lines. An archive that cannot be read is an error, unless
    `skip_unreadable`: then it gives one row with null member, header and line.
    """
    schema = "archive string, member string, header string, line string"

    def unzip(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for archive, content in zip(pdf["path"], pdf["content"]):
                try:
                    members = zipfile.ZipFile(io.BytesIO(content))
                except zipfile.BadZipFile:
                    if not skip_unreadable:
                        raise ValueError(f"{archive} is not a readable archive") from None
                    yield pd.DataFrame({"archive": [archive], "member": [None], "header": [None], "line": [None]})
                    continue
                for name in members.namelist():
                    if not name.endswith(suffix):
                        continue
                    with members.open(name) as raw:
                        text = io.TextIOWrapper(raw, encoding="utf-8", errors="replace", newline="")
                        header = text.readline().rstrip("\r\n")
                        lines: list[str] = []
                        for line in text:
                            line = line.rstrip("\r\n")
                            if line:
                                lines.append(line)
                            if len(lines) >= 10_000:
                                yield pd.DataFrame({"archive": archive, "member": name, "header": header, "line": lines})
                                lines = []
                        if lines:
                            yield pd.DataFrame({"archive": archive, "member": name, "header": header, "line": lines})

    return spark.read.format("binaryFile").load(list(paths)).select("path", "content").mapInPandas(unzip, schema)


def _parse_lines(lines: DataFrame, schema: T.StructType) -> DataFrame | None:
    """CSV lines of archive members to typed columns; None without lines.

    The lines are written once, so archives are unpacked once; members may differ in header.
    """
    lines = cut_lineage(lines.where(F.col("line").isNotNull()))
    kinds = {f.name: f.dataType.simpleString() for f in schema.fields}
    headers = sorted(r["header"] for r in lines.select("header").distinct().collect())
    parts = [_parsed(lines.where(F.col("header") == h), h, kinds) for h in headers]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts) if parts else None


def read_flow_folder(
    spark: SparkSession, folder: str, max_files: int | None = None, schema: T.StructType = DATASET_FLOW, skip_unreadable: bool = False
) -> DataFrame:
    """SRC4, SET1: every flow file of a folder, plain CSV and CSV inside ZIP, by column name.

    `max_files` caps plain files first and archives with what is left. An archive that cannot be read
    is an error unless `skip_unreadable`; `read_zip_members` tells which ones those are.
    """
    plain = list_files(spark, f"{folder}/*.csv", max_files)
    left = None if max_files is None else max_files - len(plain)
    archives = list_files(spark, f"{folder}/*.zip", left) if left is None or left > 0 else []
    parts = []
    if plain:
        table = read_csv(spark, plain, schema, only_present=True)
        if table.columns != schema.names or not table.isEmpty():
            parts.append(table)
    if archives:
        unpacked = _parse_lines(read_zip_members(spark, archives, skip_unreadable=skip_unreadable), schema)
        if unpacked is not None:
            parts.append(unpacked)
    if not parts:
        return spark.createDataFrame([], schema)
    return nan_to_null(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts))


def read_marker_lines(spark: SparkSession, path: str) -> DataFrame:
    """SRC6: `line_no, line` of an event-marker file (or a folder of them in name order).

    A large file is read in splits. File, split offset and position within the read order the
    lines as they stand in the file, so no task has to see the whole of it.
    """
    if not _exists(spark, path):
        return spark.createDataFrame([], "line_no struct<file: string, block: bigint, row: bigint>, line string")
    return spark.read.text(path).select(
        F.struct(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("row"),
        ).alias("line_no"),
        F.col("value").alias("line"),
    )


def read_connection_log(spark: SparkSession, path: str) -> DataFrame:
    """SRC7: tab-separated connection logs; names from each file's own `#fields`, comment lines dropped, '-' null.

    A file without that line, such as a later part of a split log, has the fields of the others if these all
    agree; else it cannot be read, and that is an error.
    """
    lines = _lines(spark, [path])
    fields = lines.where(F.startswith("line", F.lit("#fields"))).groupBy("file").agg(F.min_by("line", "place").alias("header"))
    headers = sorted(r["header"] for r in fields.select("header").distinct().collect())
    if not headers:
        raise ValueError(f"{path} has no #fields line")
    rows = lines.where((F.trim("line") != "") & ~F.startswith("line", F.lit("#"))).join(fields, "file", "left")
    other = F.lit(headers[0]) if len(headers) == 1 else F.raise_error(F.concat(F.col("file"), F.lit(" has no #fields line")))
    rows = rows.withColumn("header", F.coalesce("header", other.cast("string")))
    kinds = {
        "ts": "double", "id.orig_p": "int", "id.resp_p": "int", "duration": "double",
        "orig_bytes": "bigint", "resp_bytes": "bigint", "orig_pkts": "bigint", "resp_pkts": "bigint",
    }
    parts = []
    for header in headers:
        names = [n.strip() for n in header.rstrip().split("\t")[1:]]
        # the format has no quoting
        cells = F.split("line", "\t")
        row = rows.where(F.col("header") == header).select(*[F.nullif(F.trim(F.get(cells, F.lit(i))), F.lit("-")).alias(n) for i, n in enumerate(names)])
        parts.append(row.select(*[named(n).try_cast(kinds.get(n, "string")).alias(n) for n in names]))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def read_packet_export(spark: SparkSession, path: str) -> DataFrame:
    """SRC8: packet field exports; blanks around header names are stripped, values stay text."""
    found = _by_header(spark, [path], T.StructType([]))
    if found is None:
        raise ValueError(f"{path} has no header")
    return found.toDF(*[c.strip() for c in found.columns])
