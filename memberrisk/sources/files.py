"""File sources (S1-S7): monthly snapshot CSVs and the two alert files.

Every column is read as string with an explicit schema (no inference pass
over the data), the period is tagged from the source spec, periods are
unioned by name, a missing period file is skipped (none at all is an error)
and missing alert files yield an empty, typed alert table.

Headers are first lines, fetched by some threads through Hadoop's file system:
a few KB a file and no Spark job, however many files there are. Files with the
same header are one scan.
"""

from __future__ import annotations

import csv
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from memberrisk import schemas as S
from memberrisk.operators import load as L


@dataclass(frozen=True)
class SourceSpec:
    """Where one source lives: period (or alert source name) -> path glob."""
    paths: dict[str, str]
    sep: str = ","


# Fixed values of the source system: delimiters per feed and alert source names.
MAIN_SEP = ","
REDUCED_SEP = ";"
ALERT_SEP = ","
ALERT_SOURCES = ("desviados", "desviados_3_mas")


def _files(spark: SparkSession, path: str) -> list[str]:
    """The files that a path or glob names, in order; a folder names its files."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = hpath.getFileSystem(conf)
    out = []
    for status in fs.globStatus(hpath) or []:
        inside = fs.listStatus(status.getPath()) if status.isDirectory() else [status]
        out += [s.getPath().toString() for s in inside if s.isFile() and s.getPath().getName()[0] not in "._"]
    return sorted(out)


#: Headers read side by side.
HEADER_THREADS = 16
#: Name of the column that takes a row whose number of fields is not its header's.
MALFORMED = "_malformed"


def _header(spark: SparkSession, path: str, sep: str) -> tuple[str, ...]:
    """Column names of one file: its first line that is not blank, unpacked as Spark would; none if there is no such line."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    stream = hpath.getFileSystem(conf).open(hpath)
    try:
        codec = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf).getCodec(hpath)
        lines = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(codec.createInputStream(stream) if codec else stream, "UTF-8"))
        line = lines.readLine()
        while line is not None and not line.strip("\ufeff \t"):
            line = lines.readLine()
    finally:
        stream.close()
    names = next(csv.reader([line.lstrip("\ufeff")], delimiter=sep, escapechar="\\")) if line else []
    return tuple(name.strip() or f"_c{i}" for i, name in enumerate(names))


def _by_header(spark: SparkSession, spec: SourceSpec) -> Iterator[tuple[str, tuple[str, ...], list[str]]]:
    """(period, header, files with it) of a source. Empty files have no header and are left out."""
    found = [(period, file) for period, path in spec.paths.items() for file in _files(spark, path)]
    with ThreadPoolExecutor(HEADER_THREADS) as pool:
        headers = list(pool.map(lambda f: _header(spark, f[1], spec.sep), found))
    groups: dict[tuple[str, tuple[str, ...]], list[str]] = {}
    for (period, file), header in zip(found, headers):
        if header:
            groups.setdefault((period, header), []).append(file)
    for (period, header), files in groups.items():
        yield period, header, files


def _reader(spark: SparkSession, header: tuple[str, ...], sep: str, *more: str):
    schema = T.StructType([T.StructField(n, T.StringType()) for n in (*header, *more)])
    return (spark.read.option("header", True).option("sep", sep).option("enforceSchema", True)
            .option("mode", "PERMISSIVE").schema(schema))


def read_snapshots(spark: SparkSession, spec: SourceSpec) -> DataFrame:
    """S1/S2 + S4 + S5: all periods as strings, tagged and unioned by name.

    Each file is read by its own header; files of a period with the same header
    are one scan. Columns that a file lacks are null. A row with fewer fields than
    its header has nulls for the rest, one with more loses them (``malformed_rows``)."""
    frames = {}
    for period, header, files in _by_header(spark, spec):
        df = _reader(spark, header, spec.sep).csv(files)
        frames[period] = frames[period].unionByName(df, allowMissingColumns=True) if period in frames else df
    return L.union_periods(frames)


def malformed_rows(spark: SparkSession, spec: SourceSpec) -> DataFrame:
    """``(periodo, file, record)``: the lines whose number of fields is not that of their file's header."""
    out = None
    for period, header, files in _by_header(spark, spec):
        # The filter names all columns, or only some would be parsed and a line's fields not be counted.
        fields = F.concat_ws("", *[F.col(f"`{c}`") for c in header])
        df = (_reader(spark, header, spec.sep, MALFORMED).option("columnNameOfCorruptRecord", MALFORMED).csv(files)
              .where(F.col(MALFORMED).isNotNull() & (F.length(fields) >= 0))
              .select(F.lit(period).alias("periodo"), F.col("_metadata.file_path").alias("file"), F.col(MALFORMED).alias("record")))
        out = df if out is None else out.unionByName(df)
    return out if out is not None else spark.createDataFrame([], "periodo string, file string, record string")


def read_alerts(spark: SparkSession, spec: SourceSpec) -> DataFrame:
    """S3 + U2: both alert files tagged with their source; empty if none."""
    out = None
    schema = T.StructType([T.StructField("cliente", T.StringType()), T.StructField("dias_por_mes", T.StringType()),
                           T.StructField("desviacion_maxima", T.StringType())])
    for name, path in spec.paths.items():
        files = _files(spark, path)
        if not files:
            continue
        df = (spark.read.option("header", True).option("sep", spec.sep).schema(schema).csv(files)
              .select(L.parse_id("cliente").alias("cliente"), "dias_por_mes",
                      F.expr("try_cast(trim(desviacion_maxima) as double)").alias("desviacion_maxima"))
              .withColumn("fuente_alerta", F.lit(name)))
        out = df if out is None else out.unionByName(df)
    return out if out is not None else spark.createDataFrame([], S.ALERT_TAGGED_SCHEMA)


def source_row_counts(frames: dict[str, DataFrame]) -> DataFrame:
    """Row count per loaded table, in one job."""
    out = None
    for name, df in frames.items():
        c = df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("source"), "n_rows")
        out = c if out is None else out.unionByName(c)
    return out
