"""Flow sources and sinks.

CSV datasets are read by the names in each file's header, with an explicit schema
(inference only as a fallback), bad files are skipped and reported instead of failing the job, incoming request records
are validated against the flow contract and split into valid / quarantine
rows, and results are written as JSON or appended to a date-partitioned
history.  Scratch output goes under the shared ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import csv
import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import DATASETS
from ..session import checkpoint_path

# Flow record contract (fixed field list of the request model).
FLOW_REQUEST = T.StructType([
    T.StructField("timestamp", T.TimestampType(), True),
    T.StructField("src_ip", T.StringType(), False),
    T.StructField("dst_ip", T.StringType(), False),
    T.StructField("src_port", T.IntegerType(), False),
    T.StructField("dst_port", T.IntegerType(), False),
    T.StructField("protocol", T.StringType(), False),
    T.StructField("packet_size", T.IntegerType(), False),
    T.StructField("flow_duration", T.DoubleType(), True),
    T.StructField("payload", T.StringType(), True),
    T.StructField("metadata", T.MapType(T.StringType(), T.StringType()), True),
])
REQUIRED = [f.name for f in FLOW_REQUEST.fields if not f.nullable]

# Labelled training flow (request fields + counters + label).
FLOW_CSV = T.StructType([
    T.StructField("flow_id", T.LongType(), True),
    T.StructField("timestamp", T.TimestampType(), True),
    T.StructField("src_ip", T.StringType(), True),
    T.StructField("dst_ip", T.StringType(), True),
    T.StructField("src_port", T.IntegerType(), True),
    T.StructField("dst_port", T.IntegerType(), True),
    T.StructField("protocol", T.StringType(), True),
    T.StructField("packet_size", T.IntegerType(), True),
    T.StructField("flow_duration", T.DoubleType(), True),
    T.StructField("bytes_sent", T.LongType(), True),
    T.StructField("bytes_received", T.LongType(), True),
    T.StructField("packets_sent", T.LongType(), True),
    T.StructField("packets_received", T.LongType(), True),
    T.StructField("label", T.StringType(), True),
])


TS_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"


def write_flow_csv(df: DataFrame, path: str) -> None:
    """CSV with header and microsecond timestamps (round-trips with read_flow_csv)."""
    (df.write.mode("overwrite").option("header", True).option("timestampFormat", TS_FORMAT)
       .option("timestampNTZFormat", TS_FORMAT).csv(path))


def scratch_dir(spark: SparkSession, prefix: str) -> str:
    """A fresh folder in the shared checkpoint location (never machine-local)."""
    return checkpoint_path(spark, f"{prefix}-{uuid.uuid4().hex}")


def write_bytes(spark: SparkSession, path: str, content: bytes) -> None:
    """A small file in whatever store the path names."""
    sc = spark.sparkContext
    where = sc._jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(sc._jsc.hadoopConfiguration()).create(where)
    out.write(bytearray(content))
    out.close()


# --- S1 / S2 / S3 -------------------------------------------------------------

#: Files whose first line is read at the same time by ``header_index``.
HEADER_THREADS = 16


@dataclass(frozen=True)
class CsvFile:
    """One member of a CSV dataset: its columns in file order, or why it cannot be read."""
    path: str
    size: int
    columns: tuple[str, ...] | None
    error: str | None = None


def _members(spark: SparkSession, patterns) -> list:
    """Hadoop file statuses below the globs; hidden and marker files are left out."""
    sc = spark.sparkContext
    conf, new = sc._jsc.hadoopConfiguration(), sc._jvm.org.apache.hadoop.fs.Path
    found = []
    for pattern in patterns:
        where = new(pattern)
        fs = where.getFileSystem(conf)
        todo = list(fs.globStatus(where) or [])
        while todo:
            status = todo.pop()
            if status.getPath().getName().startswith(("_", ".")):
                continue
            if status.isDirectory():
                todo += list(fs.listStatus(status.getPath()))
            else:
                found.append(status)
    return found


def _header(spark: SparkSession, status, sep: str) -> CsvFile:
    sc = spark.sparkContext
    jvm, conf, where = sc._jvm, sc._jsc.hadoopConfiguration(), status.getPath()
    path, size, stream = where.toString(), status.getLen(), None
    try:
        stream = where.getFileSystem(conf).open(where)
        codec = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf).getCodec(where)
        text = codec.createInputStream(stream) if codec is not None else stream
        line = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(text, "UTF-8")).readLine()
    except Py4JJavaError as broken:
        return CsvFile(path, size, None, str(broken.java_exception))
    finally:
        if stream is not None:
            stream.close()
    if line is None or not line.strip():
        return CsvFile(path, size, None, "no header")
    seen: dict[str, int] = {}
    names = []
    for name in next(csv.reader([line.removeprefix("\ufeff")], delimiter=sep)):
        k = seen[name] = seen.get(name, -1) + 1
        names.append(f"{name}.{k}" if k else name)  # a repeated name gets a number
    return CsvFile(path, size, tuple(names))


def header_index(spark: SparkSession, paths, sep: str = ",") -> list[CsvFile]:
    """The column list of every file of a dataset, from its first line alone.

    Goes with the file listing: one small read a file, through the file system that the
    path names, none of the data."""
    patterns = [paths] if isinstance(paths, str) else list(paths)
    with ThreadPoolExecutor(HEADER_THREADS) as pool:
        files = list(pool.map(lambda status: _header(spark, status, sep), _members(spark, patterns)))
    return sorted(files, key=lambda f: f.path)


def skipped_files(spark: SparkSession, index: list[CsvFile]) -> DataFrame:
    """(path, size, error) of the files that a scan leaves out."""
    return spark.createDataFrame([(f.path, f.size, f.error) for f in index if f.error], "path string, size bigint, error string")


def _common_type(types: list[T.DataType]) -> T.DataType:
    """One type for a column that was inferred differently in several groups of files."""
    kinds = {t.simpleString() for t in types}
    if len(kinds) == 1:
        return types[0]
    if kinds <= {"int", "bigint"}:
        return T.LongType()
    return T.DoubleType() if kinds <= {"int", "bigint", "double"} else T.StringType()


def read_flow_csv(spark: SparkSession, path, schema: T.StructType | None = FLOW_CSV, skip_bad_files: bool = True,
                  corrupt_col: str | None = None, keep_extra: bool = True, index: list[CsvFile] | None = None) -> DataFrame:
    """Header CSV globs, every column found by its name in each file's own header.

    Files are grouped by header and each distinct header is one scan with the schema in
    that header's order; the scans are united by name, so files may order their columns
    differently, lack some (NULL) or have more.  ``schema`` gives the types and comes
    first; columns beyond it follow as strings unless ``keep_extra`` is off.
    ``schema=None`` infers the types, once for each distinct header.

    ``skip_bad_files`` leaves out files without a readable header (``skipped_files`` tells
    which) and what follows a place where a file breaks; ``corrupt_col`` keeps malformed
    lines in a column instead of failing (PERMISSIVE mode).  Without a readable file the
    result is empty (``schema``) or an error (no schema)."""
    index = header_index(spark, path) if index is None else index
    bad = [f for f in index if f.error]
    if bad and not skip_bad_files:
        raise ValueError(f"unreadable: {bad[0].path}: {bad[0].error}")
    groups: dict[tuple, list[str]] = {}
    for f in index:
        if f.columns:
            groups.setdefault(f.columns, []).append(f.path)
    reader = (spark.read.option("header", True).option("mode", "PERMISSIVE").option("ignoreCorruptFiles", skip_bad_files)
              .option("timestampFormat", TS_FORMAT).option("timestampNTZFormat", TS_FORMAT))
    typed = {f.name: f.dataType for f in schema.fields} if schema is not None else {}
    parts = []
    for columns, members in groups.items():
        if schema is None:
            part = reader.option("inferSchema", True).csv(members).toDF(*columns)
        else:
            shape = T.StructType([T.StructField(c, typed.get(c, T.StringType())) for c in columns])
            scan = reader
            if corrupt_col:
                shape, scan = shape.add(corrupt_col, T.StringType()), reader.option("columnNameOfCorruptRecord", corrupt_col)
            part = scan.schema(shape).csv(members)
            if not keep_extra:
                part = part.select(*[f"`{c}`" for c in part.columns if c in typed or c == corrupt_col])
        parts.append(part)
    if schema is not None:
        parts.insert(0, spark.createDataFrame([], T.StructType([T.StructField(c, t) for c, t in typed.items()])))
    elif not parts:
        raise ValueError("no valid files")
    else:
        kinds: dict[str, list] = {}
        for part in parts:
            for f in part.schema.fields:
                kinds.setdefault(f.name, []).append(f.dataType)
        parts = [p.select(*[F.col(f"`{c}`").cast(_common_type(kinds[c])).alias(c) for c in p.columns]) for p in parts]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def dataset_info(name: str, registry=DATASETS) -> dict:
    """S3: registry lookup; unknown names are an error."""
    if name not in registry:
        raise ValueError(f"Unknown dataset: {name}")
    return dict(registry[name])


def datasets_df(spark: SparkSession, registry=DATASETS) -> DataFrame:
    """S3: the registry as a DataFrame (name, files, label_column, attack_types)."""
    rows = [(k, v["files"], v["label_column"], v["attack_types"]) for k, v in registry.items()]
    return spark.createDataFrame(rows, "name string, files array<string>, label_column string, "
                                       "attack_types array<string>")


def load_dataset(spark: SparkSession, base_dir: str, name: str, registry=DATASETS, schema: T.StructType | None = None) -> DataFrame:
    """S1 + S3 + P2: every file glob of a registered dataset, label renamed to ``label``."""
    info = dataset_info(name, registry)
    paths = [f"{base_dir.rstrip('/')}/{name}/{g}" for g in info["files"]]
    df = read_flow_csv(spark, paths, schema)
    col = info["label_column"]
    return df.withColumnRenamed(col, "label") if col != "label" else df


# --- S4 / S5 / S6 ---------------------------------------------------------------

def validate_records(raw: DataFrame, json_col: str = "value", schema: T.StructType = FLOW_REQUEST):
    """Parse JSON request records against the contract.

    Returns (valid, quarantine).  A record is quarantined when it does not
    parse or a required field is missing or of the wrong type (a wrong type
    parses to NULL).  Both outputs keep the raw text for tracing.
    """
    # a generator of one row: the checks stay above it and do not parse the text once a field
    record = F.from_json(F.col(json_col), schema, {"mode": "PERMISSIVE"})
    parsed = raw.select("*", F.explode(F.array(record)).alias("_r"))
    missing = F.array_compact(F.array(*[F.when(F.col(f"_r.{c}").isNull(), F.lit(c)) for c in REQUIRED]))
    parsed = parsed.withColumn("_missing", missing)
    ok = F.col("_r").isNotNull() & (F.size("_missing") == 0)
    valid = parsed.filter(ok).select("*", "_r.*").drop("_r", "_missing")
    bad = parsed.filter(~ok).select(
        *[c for c in raw.columns],
        F.concat(F.lit("invalid record: missing or malformed "), F.array_join("_missing", ", ")).alias("error"))
    return valid, bad


def with_ingest_defaults(df: DataFrame, ts_col: str = "timestamp", id_col: str = "request_id") -> DataFrame:
    """Timestamp defaults to now, request id to a fresh UUID."""
    out = df.withColumn(ts_col, F.coalesce(F.col(ts_col), F.current_timestamp()))
    if id_col in df.columns:
        return out.withColumn(id_col, F.coalesce(F.col(id_col), F.uuid()))
    return out.withColumn(id_col, F.uuid())


# --- S7 / S10 ----------------------------------------------------------------------

def write_json(df: DataFrame, path: str, nested_as_text=()) -> None:
    """Results as JSON lines (nested columns optionally rendered with to_json)."""
    out = df
    for c in nested_as_text:
        out = out.withColumn(c, F.to_json(c))
    out.write.mode("overwrite").json(path)


def append_history(decisions: DataFrame, path: str, ts_col: str = "ts") -> None:
    """Append decisions to a history table partitioned by date.

    Rebalanced by day: a large day is split over several tasks, a small one is one file."""
    (decisions.withColumn("date", F.to_date(F.col(ts_col))).hint("rebalance", "date")
              .write.mode("append").partitionBy("date").parquet(path))
