"""State per key with ``transformWithState``: the last N rows (T1, T2), open alerts (T5).

``rolling_stream`` gives every rolling feature W1-W14 of the last N flows of a key, and
``sequence_stream`` the zero-padded sequence that the sequence detector reads.  The state
of a key is a list of its last N rows in RocksDB, bounded by N whatever the key's rate;
with ``idle_ms`` it has a time to live and a key that falls silent is forgotten by the
store (for streams that go on: with a time to live Spark plans batches without end, so a
run over what is available now leaves it unset).  A key's rows of one micro-batch are put in (ts, flow_id) order and pass one by
one through a ring buffer with running counts; no data frame of a key is built.  Rows
follow those of earlier batches in the order of arrival.

``alert_stream`` chains two stateful operators: the window aggregate of the health checks, whose
rows leave once the watermark has passed a window, and the open alert of each host and metric.

RocksDB has to be the state store when a query starts; ``rocksdb`` sees to it and puts
the session's own setting back.
"""

from __future__ import annotations

import math
from collections import Counter, deque
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..config import ALERT_THRESHOLDS, HEALTH_CHECK_INTERVAL, WINDOW_SIZE
from ..functions.scalar import day_of_week, high_port, hour_of_day
from ..operators.features import ADVANCED, BASIC, CORR_COLUMNS, corr_names

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocksdb(spark: SparkSession):
    """Queries started inside keep their state in RocksDB (a running query holds the settings it started with)."""
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before)


def run_available(df: DataFrame, sink_path: str, checkpoint: str) -> None:
    """Process what is available now into a file sink; a rerun resumes from the checkpoint."""
    with rocksdb(df.sparkSession):
        q = df.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(sink_path)
    q.awaitTermination()


# --- T2 ------------------------------------------------------------------------

FEATURES = BASIC + ADVANCED + tuple(corr_names())
#: Columns a feature reads; those counted by value; features that are whole numbers.
INPUTS = ("src_ip", "dst_ip", "src_port", "dst_port", "packet_size", "flow_duration", "high_port", "hour", "day_of_week")
COUNTED = ("src_ip", "dst_ip", "src_port", "dst_port", "hour", "day_of_week")
WHOLE = ("packet_size_min", "packet_size_max", "unique_src_ips", "unique_dst_ips", "unique_src_ports", "unique_dst_ports")
_TEXT = ("src_ip", "dst_ip")
ROLLING_STATE = T.StructType([T.StructField("micros", T.LongType()),
                              *[T.StructField(c, T.StringType() if c in _TEXT else T.DoubleType()) for c in INPUTS]])


def _spread(values, sample: bool) -> float:
    """Standard deviation; exactly 0 for equal values."""
    if min(values) == max(values):
        return 0.0
    mean = math.fsum(values) / len(values)
    return math.sqrt(math.fsum((v - mean) ** 2 for v in values) / (len(values) - sample))


class RingFrame:
    """The last ``n`` rows of a key, with counts of values and of NULLs kept up to date."""

    def __init__(self, n: int):
        self.n, self.last = n, None
        self.held = {c: deque() for c in (*INPUTS, "gap")}
        self.nulls, self.seen = Counter(), {c: Counter() for c in COUNTED}

    def push(self, micros: int | None, values: tuple) -> None:
        gap = (micros - self.last) / 1e6 if micros is not None and self.last is not None else None
        self.last = micros
        for c, v in (*zip(INPUTS, values), ("gap", gap)):
            ring = self.held[c]
            if len(ring) == self.n:
                old = ring.popleft()
                self.nulls[c] -= old is None
                if c in self.seen and old is not None:
                    self.seen[c][old] -= 1
                    if not self.seen[c][old]:
                        del self.seen[c][old]
            ring.append(v)
            self.nulls[c] += v is None
            if c in self.seen and v is not None:
                self.seen[c][v] += 1

    def full(self, *cols: str) -> bool:
        return all(len(self.held[c]) == self.n and not self.nulls[c] for c in cols)

    def entropy(self, c: str):
        return -math.fsum(k / self.n * math.log(k / self.n) for k in self.seen[c].values()) + 0.0 if self.full(c) else None

    def features(self) -> dict:
        out = dict.fromkeys(FEATURES)
        if self.full("packet_size"):
            x = self.held["packet_size"]
            mean, sd, by_size = math.fsum(x) / self.n, _spread(x, True), sorted(x)
            out |= {"packet_size_mean": mean, "packet_size_std": sd, "packet_size_min": int(by_size[0]), "packet_size_max": int(by_size[-1]),
                    "packet_size_median": (by_size[(self.n - 1) // 2] + by_size[self.n // 2]) / 2,
                    "traffic_burstiness": sd / mean if mean else None, "traffic_regularity": 1.0 / (1.0 + sd)}
        if self.full("flow_duration"):
            x = self.held["flow_duration"]
            out |= {"flow_duration_mean": math.fsum(x) / self.n, "flow_duration_std": _spread(x, True)}
        if self.full("high_port"):
            out["high_port_ratio"] = math.fsum(self.held["high_port"]) / self.n
        if self.full("gap"):
            mean, sd = math.fsum(self.held["gap"]) / self.n, _spread(self.held["gap"], True)
            out |= {"packet_rate": 1.0 / mean if mean else None, "packet_rate_std": 1.0 / sd if sd else None}
        for c, name in (("src_ip", "unique_src_ips"), ("dst_ip", "unique_dst_ips"), ("src_port", "unique_src_ports"), ("dst_port", "unique_dst_ports")):
            out[name] = len(self.seen[c]) if self.full(c) else None
        for c, name in (("src_ip", "src_ip_entropy"), ("dst_ip", "dst_ip_entropy"), ("hour", "hour_entropy"), ("day_of_week", "day_entropy")):
            out[name] = self.entropy(c)
        centred, spreads = {}, {}
        for c in CORR_COLUMNS:
            if self.full(c):
                mean, spreads[c] = math.fsum(self.held[c]) / self.n, _spread(self.held[c], False)
                centred[c] = [v - mean for v in self.held[c]]
        for i, a in enumerate(CORR_COLUMNS):
            for b in CORR_COLUMNS[i + 1:]:
                if spreads.get(a) and spreads.get(b):
                    covar = math.fsum(p * q for p, q in zip(centred[a], centred[b])) / self.n
                    out[f"corr_{a}_{b}"] = covar / (spreads[a] * spreads[b])
        return out


class RollingProcessor(StatefulProcessor):
    def __init__(self, n: int, idle_ms: int | None):
        self.n, self.idle_ms = n, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.rows = handle.getListState("rows", ROLLING_STATE, self.idle_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        frame, kept = RingFrame(self.n), deque(maxlen=self.n)
        for micros, *values in self.rows.get():
            frame.push(micros, tuple(values))
            kept.append((micros, *values))
        new = [(r["micros"], r["flow_id"], tuple(r[c] for c in INPUTS)) for r in rows]
        new.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        for micros, flow_id, values in new:
            frame.push(micros, values)
            kept.append((micros, *values))
            got = frame.features()
            yield Row(flow_id=flow_id, key=key[0], **got)
        self.rows.put(list(kept))

    def close(self) -> None:
        pass


def rolling_stream(flows: DataFrame, n: int = WINDOW_SIZE, key: str = "src_ip", idle_ms: int | None = None) -> DataFrame:
    """flow_id, the key and all rolling features of the last ``n`` flows of its key (NULL until n are there)."""
    number = lambda c: c.cast("double")
    src = flows.select(
        F.col(key).alias("key"), "flow_id", F.unix_micros(F.col("timestamp").cast("timestamp")).alias("micros"), "src_ip", "dst_ip",
        *[number(F.col(c)).alias(c) for c in ("src_port", "dst_port", "packet_size", "flow_duration")],
        high_port("dst_port").alias("high_port"), number(hour_of_day("timestamp")).alias("hour"), number(day_of_week("timestamp")).alias("day_of_week"))
    out = T.StructType([T.StructField("flow_id", src.schema["flow_id"].dataType), T.StructField("key", src.schema["key"].dataType),
                        *[T.StructField(f, T.LongType() if f in WHOLE else T.DoubleType()) for f in FEATURES]])
    mode = "ProcessingTime" if idle_ms else "None"
    return src.groupBy("key").transformWithState(RollingProcessor(n, idle_ms), out, "append", mode).withColumnRenamed("key", key)


# --- T1 ------------------------------------------------------------------------

SEQUENCE_STATE = T.StructType([T.StructField("row", T.ArrayType(T.DoubleType()))])


class SequenceProcessor(StatefulProcessor):
    """Rows pass through with ``sequence``: their own and the n - 1 feature rows before them, zeros in front."""

    def __init__(self, n: int, width: int, keep: list[str], idle_ms: int | None):
        self.n, self.width, self.keep, self.idle_ms = n, width, keep, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.rows = handle.getListState("rows", SEQUENCE_STATE, self.idle_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        kept = deque((list(r[0]) for r in self.rows.get()), maxlen=self.n)
        new = sorted(rows, key=lambda r: (r["ts"] is not None, r["ts"], r["flow_id"]) if r["ts"] is not None else (False, 0, r["flow_id"]))
        for r in new:
            kept.append(list(r["_row"]))
            padded = [0.0] * (self.width * (self.n - len(kept)))
            for row in kept:
                padded += row
            yield Row(**{c: r[c] for c in self.keep}, sequence=padded)
        self.rows.put([(row,) for row in list(kept)[-(self.n - 1):]])

    def close(self) -> None:
        pass


def sequence_stream(rows: DataFrame, features: list[str], n: int = WINDOW_SIZE, key: str = "src_ip", idle_ms: int | None = None) -> DataFrame:
    """The other columns of ``rows`` (with ts and flow_id) plus ``sequence``, the flattened last ``n`` feature rows of the key."""
    src = rows.withColumn("_row", F.array(*[F.col(c).cast("double") for c in features])).drop(*features)
    keep = [c for c in src.columns if c != "_row"]
    out = T.StructType([*[src.schema[c] for c in keep], T.StructField("sequence", T.ArrayType(T.DoubleType()))])
    mode = "ProcessingTime" if idle_ms else "None"
    return src.groupBy(key).transformWithState(SequenceProcessor(n, len(features), keep, idle_ms), out, "append", mode)


def _keyed_features(flows: DataFrame, fs, idle_ms: int | None) -> DataFrame:
    """The sequences of ``detectors.featurize`` from the state of each source; the Fourier features, made from the
    sequence's last row, do not pass through the state."""
    from ..operators.detectors import SEQ_LEN
    rows = sequence_stream(fs.scaled(flows), [c + "_s" for c in fs.cols], SEQ_LEN, "src_ip", idle_ms)
    return rows.withColumnRenamed("sequence", "lstm_features")


def _write_decisions(rows: DataFrame, fs, trained, registry, path: str) -> None:
    from ..operators import ensemble
    from ..operators.detectors import score_featurized
    d = ensemble.decide(score_featurized(trained, fs.tabular(rows), registry))
    (d.select("flow_id", "ts", "attack_type", "prediction", "confidence", "severity", "method", "conflicts_detected")
     .write.mode("overwrite").parquet(path))


def run_detectors(flows: DataFrame, fs, trained, sink_path: str, checkpoint: str, registry=None, idle_ms: int | None = None) -> None:
    """T1 with fitted detectors: every micro-batch of flows is featurized, scored and decided like a batch.

    A sequence reaches back over earlier batches through the state store; a batch's folder is
    overwritten when it is run again after a failure."""
    def run(rows: DataFrame, batch_id: int) -> None:
        _write_decisions(rows, fs, trained, registry, f"{sink_path}/batch={batch_id}")

    rows = _keyed_features(flows.select("flow_id", "ts", "src_ip", *[c for c in fs.cols if c in flows.columns]), fs, idle_ms)
    with rocksdb(flows.sparkSession):
        q = rows.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def request_stream(raw: DataFrame, fs, idle_ms: int | None = None) -> DataFrame:
    """JSON request records (flow_id, value) as flows with their sequences, and those that break the contract with an ``error``.

    Valid records carry ``lstm_features`` from the state of their source."""
    from ..sources import files
    good, bad = files.validate_records(raw)
    flows = (files.with_ingest_defaults(good).withColumn("ts", F.col("timestamp").cast("timestamp"))
             .select("flow_id", "ts", "src_ip", "dst_ip", "protocol", *[c for c in fs.cols if c in good.columns]))
    return _keyed_features(flows, fs, idle_ms).unionByName(bad.select("flow_id", "value", "error"), allowMissingColumns=True)


def run_requests(raw: DataFrame, fs, trained, base: str, checkpoint: str, registry=None, idle_ms: int | None = None) -> None:
    """T1 end to end: every micro-batch of records is checked, scored and decided; decisions go to
    ``base``/decisions, broken records with their text to ``base``/quarantine.

    Both are written to a folder of the batch's number, overwritten when a batch is run again, so a
    rerun changes nothing; the sequences live in the state store, which knows each batch's version."""
    def run(rows: DataFrame, batch_id: int) -> None:
        rows = rows.persist()
        try:
            _write_decisions(rows.where("error is null").drop("error", "value"), fs, trained, registry, f"{base}/decisions/batch={batch_id}")
            rows.where("error is not null").select("flow_id", "value", "error").write.mode("overwrite").parquet(f"{base}/quarantine/batch={batch_id}")
        finally:
            rows.unpersist()

    with rocksdb(raw.sparkSession):
        q = request_stream(raw, fs, idle_ms).writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


# --- T5 ------------------------------------------------------------------------

#: Metrics that raise alerts.
ALERT_METRICS = ("cpu_usage", "memory_usage")
OPEN_ALERT = T.StructType([T.StructField("opened_at", T.LongType()), T.StructField("peak", T.DoubleType()), T.StructField("n_checks", T.LongType())])


class AlertProcessor(StatefulProcessor):
    """The alert of one (host, metric): opened by the first check above the threshold, closed by the first one that is not."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.open = handle.getValueState("open", OPEN_ALERT)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        alert = tuple(self.open.get()) if self.open.exists() else None
        host, metric = key
        # windows leave the aggregate in the order of the watermark, those of one micro-batch in any order
        for at, value, threshold in sorted((r["checked_at"], r["value"], r["threshold"]) for r in rows):
            event = None
            if value > threshold:
                event = "opened" if alert is None else None
                since, peak, n = alert or (at, value, 0)
                alert = (since, max(peak, value), n + 1)
            elif alert is not None:
                event = "closed"
            if event:
                yield Row(host=host, type=metric, event=event, checked_at=at, value=value, threshold=threshold,
                          opened_at=alert[0], peak=alert[1], n_checks=alert[2])
            if event == "closed":
                alert = None
        if alert is None:
            self.open.clear()
        else:
            self.open.update(alert)

    def close(self) -> None:
        pass


def alert_stream(samples: DataFrame, every: str = HEALTH_CHECK_INTERVAL, late: str = "1 minute",
                 metrics=ALERT_METRICS, thresholds=ALERT_THRESHOLDS) -> DataFrame:
    """T5: a row where an alert opens and one where it closes, by host and metric.

    Each check interval gives a host's latest value of a metric (``stream.health_windows``); an alert is open while
    that value lies strictly above the threshold.  An interval without a reading (none, NULL or NaN) leaves it as it
    is.  Times are the interval's end in epoch seconds; ``peak`` and ``n_checks`` cover the checks above the threshold
    so far.  State is one row for each open alert and the intervals that the watermark has not passed."""
    from .stream import health_windows
    checks = F.array(*[F.struct(F.lit(m).alias("type"), F.col(m).cast("double").alias("value"), F.lit(float(thresholds[m])).alias("threshold"))
                       for m in metrics])
    rows = (health_windows(samples, every, late, thresholds)
            .select("host", F.unix_seconds("w.end").alias("checked_at"), F.inline(checks)).where("value is not null and not isnan(value)"))
    out = T.StructType([rows.schema["host"], T.StructField("type", T.StringType()), T.StructField("event", T.StringType()),
                        T.StructField("checked_at", T.LongType()), T.StructField("value", T.DoubleType()), T.StructField("threshold", T.DoubleType()),
                        *OPEN_ALERT.fields])
    return rows.groupBy("host", "type").transformWithState(AlertProcessor(), out, "append", "None")
