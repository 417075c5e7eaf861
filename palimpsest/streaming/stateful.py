"""The folds of ingest over streams: each history's memories are state, and a batch touches only what it brings.

Facts of a history are taken in the order of ``seq`` within a batch, and batches in the
order in which they come; so however ordered input is cut, and wherever the query is
stopped and started again, the rows are those of the batch folds. What a fact needs is
typed state in RocksDB: a map of rows by memory, a map of the vectors of primaries, lists
of what was admitted last. Output rows have a ``version`` where a memory can change;
``latest`` keeps the last one of each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators import admission, folds
from ..session import ship

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _ready(spark: SparkSession) -> None:
    """Executors have the package, and state of several kinds has a store that can hold it."""
    ship(spark)
    spark.conf.set(PROVIDER, ROCKSDB)


def _sorted(rows: Iterator[pd.DataFrame]) -> pd.DataFrame:
    return pd.concat(list(rows)).sort_values("seq", kind="stable").reset_index(drop=True)


def _none(x):
    return None if x is None or (np.isscalar(x) and pd.isna(x)) else x


class _Idle(StatefulProcessor):
    """State of a history that brings nothing for ``idle_ms`` goes; 0 keeps it.

    With a limit the query goes by the clock and does not end by itself.
    """

    idle_ms = 0

    def _touch(self, timers) -> None:
        if self.idle_ms:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            self.handle.registerTimer(timers.getCurrentProcessingTimeInMs() + self.idle_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802
        for held in self.held:
            held.clear()
        return iter(())

    def close(self) -> None:
        pass


# Admission -------------------------------------------------------------------


class Admitting(_Idle):
    def __init__(self, weights: tuple[float, ...], threshold: float, idle_ms: int) -> None:
        self.weights, self.threshold, self.idle_ms = weights, threshold, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getListState("kept", "v array<double>")
        self.held = [self.kept]

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        own = folds.Admission(self.weights, self.threshold, [v for (v,) in self.kept.get()])
        yield own.take(_sorted(rows))
        if own.kept:
            self.kept.put([(v.tolist(),) for v in own.kept])
        self._touch(timerValues)


def admitted(facts: DataFrame, weights: tuple[float, ...] = admission.WEIGHTS, threshold: float = admission.THRESHOLD, idle_ms: int = 0) -> DataFrame:
    """``folds.admit`` over a stream of facts with their features; a history's state is the vectors admitted last."""
    _ready(facts.sparkSession)
    own = Admitting(weights, threshold, idle_ms)
    return facts.groupBy("history_name").transformWithStateInPandas(own, folds.ADMIT, "Append", "processingTime" if idle_ms else "none")


# Relations -------------------------------------------------------------------

_ROW = "text string, time string, role string, parent long, edge string, hidden boolean, answer long, members array<long>, root long, version long"
RELATED = f"{folds.RELATE}, version long"


class _Rows:
    """A store's rows, read from state where they are asked for; what was read may have changed."""

    def __init__(self, state, size: int) -> None:
        self.state, self.size, self.read = state, size, {}

    def __len__(self) -> int:
        return self.size

    def __getitem__(self, i: int) -> folds.Memory:
        if i not in self.read:
            text, time, role, parent, edge, hidden, answer, members, root, _ = self.state.getValue((i,))
            self.read[i] = folds.Memory(i, text, None, time, role, _none(parent), _none(edge), hidden, _none(answer), list(members), _none(root))
        return self.read[i]

    def append(self, row: folds.Memory) -> None:
        self.read[row.id] = row
        self.size += 1


class Relating(_Idle):
    def __init__(self, settings: dict, idle_ms: int) -> None:
        self.settings, self.idle_ms = settings, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getMapState("rows", "id long", _ROW)
        self.vectors = handle.getMapState("vectors", "id long", "v array<double>")
        self.size = handle.getValueState("size", "rows long, version long")
        self.held = [self.rows, self.vectors, self.size]

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        size, version = self.size.get() if self.size.exists() else (0, 0)
        store = folds.RelationStore(**self.settings)
        store.rows = _Rows(self.rows, size)
        before = {}
        for (i,), (v,) in self.vectors.iterator():
            before[i] = np.asarray(v, float)
        for i in sorted(before):
            store.vectors.put(i, before[i] if len(before[i]) else None)
            store.points.setdefault(None, {})[i] = None
        given = _sorted(rows)
        for text, embedding, time in zip(given["text"], given["embedding"], given["time"], strict=True):
            store.add(_none(text) or "", embedding, _none(time) or "")
        version += 1
        out = []
        for m in sorted(store.rows.read.values(), key=lambda m: m.id):
            value = (m.text, m.time, m.role, m.parent, m.edge, m.hidden, m.answer, m.members, m.root)
            old = self.rows.getValue((m.id,)) if m.id < size else None
            if old is None or tuple(map(_plain, old[:-1])) != tuple(map(_plain, value)):
                self.rows.updateValue((m.id,), (*value, version))
                out.append((key[0], m.id, m.text, m.time, m.role, m.parent, m.edge, m.hidden, m.answer, len(m.members), version))
        primaries = store.points.get(None, {})
        for i in before:
            if i not in primaries:
                self.vectors.removeKey((i,))
        for i in primaries:
            if i not in before:
                self.vectors.updateValue((i,), (store.vectors.held[i].tolist() if store.vectors.known(i) else [],))
        self.size.update((len(store.rows), version))
        self._touch(timerValues)
        names = ["history_name", "memory_id", "text", "time", "memory_role", "parent_primary", "edge", "answer_hidden", "answer_id", "fused_member_count", "version"]
        yield pd.DataFrame(out, columns=names).astype({"parent_primary": "Int64", "answer_id": "Int64"})


def _plain(x):
    x = list(x) if isinstance(x, (list, tuple, np.ndarray)) else _none(x)
    return x


def related(facts: DataFrame, idle_ms: int = 0, **settings) -> DataFrame:
    """``folds.relate`` over a stream (history_name, seq, text, time, embedding): each batch's new and changed rows.

    State is a row for each memory, read where a fact meets it, and the vectors of
    primaries, which every fact of the history is compared with.
    """
    _ready(facts.sparkSession)
    own = Relating(settings, idle_ms)
    return facts.groupBy("history_name").transformWithStateInPandas(own, RELATED, "Update", "processingTime" if idle_ms else "none")


# Operations ------------------------------------------------------------------

OPERATED = f"{folds.OPERATED}, version long"


class Operating(_Idle):
    """Rows by number; deleted ones stay as a number without a text, since numbers are not used again."""

    def __init__(self, batch: str | None, settings: dict, idle_ms: int) -> None:
        self.batch, self.settings, self.idle_ms = batch, settings, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getMapState("rows", "id long", "seq long, text string, time string, source string, v array<double>")
        self.size = handle.getValueState("size", "rows long, version long")
        self.held = [self.rows, self.size]

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        size, version = self.size.get() if self.size.exists() else (0, 0)
        store = folds.OperationStore(**self.settings)
        store.rows = [None] * size
        for (i,), (seq, text, time, source, v) in self.rows.iterator():
            store.put(i, {"seq": seq, "text": text, "time": time, "source": source}, np.asarray(v, float))
        before = {i: dict(r) for i, r in enumerate(store.rows) if r is not None}
        folds.operated_into(store, _sorted(rows), self.batch)
        version, out = version + 1, []
        for i, r in enumerate(store.rows):
            if r == before.get(i):
                continue
            if r is None:
                self.rows.removeKey((i,))
                out.append((key[0], i, before[i]["seq"], None, None, "deleted", version))
            else:
                self.rows.updateValue((i,), (r["seq"], r["text"], r["time"], r["source"], store.vectors.held[i].tolist()))
                out.append((key[0], i, r["seq"], r["text"], r["time"], r["source"], version))
        self.size.update((len(store.rows), version))
        self._touch(timerValues)
        yield pd.DataFrame(out, columns=["history_name", "memory_id", "seq", "text", "time", "source", "version"])


def operated(facts: DataFrame, batch: str | None = None, idle_ms: int = 0, **settings) -> DataFrame:
    """``folds.operated`` over a stream: each batch's new and changed rows; deleted ones have the source ``deleted``.

    Facts that are decided together (one value of ``batch``) have to come in one batch of the stream.
    """
    _ready(facts.sparkSession)
    own = Operating(batch, settings, idle_ms)
    return facts.groupBy("history_name").transformWithStateInPandas(own, OPERATED, "Update", "processingTime" if idle_ms else "none")


def latest(rows: DataFrame) -> DataFrame:
    """The last version of each memory of ``related`` or ``operated``, as the batch folds give it; deleted ones are left out."""
    others = [c for c in rows.columns if c not in ("history_name", "memory_id", "version")]
    last = rows.groupBy("history_name", "memory_id").agg(F.max_by(F.struct(*others), "version").alias("r")).select("history_name", "memory_id", "r.*")
    return last.where("source <> 'deleted'") if "source" in others else last


# Clusters --------------------------------------------------------------------

CLUSTERED = "history_name string, seq long, cluster string, members long, closed timestamp"


class Clustering(StatefulProcessor):
    def __init__(self, threshold: float, gap_days: float) -> None:
        self.threshold, self.gap_days = threshold, gap_days
        self.gap_ms = int(gap_days * 86_400_000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getMapState("open", "number long", "centroid array<double>, members long, last double")
        self.founded = handle.getValueState("founded", "n long")

    def _due(self, last: float) -> int:
        """When no fact can come near it in time any more."""
        return int(last * 1000) + self.gap_ms + 1

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        given = _sorted(rows)
        given["at"] = (given["at"] - pd.Timestamp(0, tz=given["at"].dt.tz)) / pd.Timedelta(seconds=1)
        held = sorted((n, c, m, last) for (n,), (c, m, last) in self.open.iterator())
        own = folds.Clusters(self.threshold, self.gap_days, self.founded.get()[0] if self.founded.exists() else 0, held)
        out, touched = own.take(given)
        waiting = set(self.handle.listTimers())
        for k in sorted(touched):
            last = float(own.last[k])
            self.open.updateValue((own.numbers[k],), (own.centroids.held[k].tolist(), own.counts[k], last))
            if self._due(last) not in waiting:
                waiting.add(self._due(last))
                self.handle.registerTimer(self._due(last))
        self.founded.update((own.founded,))
        yield out.assign(members=pd.Series(pd.NA, index=out.index, dtype="Int64"), closed=pd.Series(pd.NaT, index=out.index, dtype="datetime64[us]"))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802
        now = expiredTimerInfo.getExpiryTimeInMs()
        done = sorted((n, m, last) for (n,), (_, m, last) in self.open.iterator() if self._due(last) <= now)
        for n, _, _ in done:
            self.open.removeKey((n,))
        if done:
            closed = pd.to_datetime([int(last * 1_000_000) for _, _, last in done], unit="us")
            yield pd.DataFrame({"history_name": key[0], "seq": pd.Series([pd.NA] * len(done), dtype="Int64"), "cluster": [f"cluster_{n:04d}" for n, _, _ in done], "members": [m for _, m, _ in done], "closed": closed})

    def close(self) -> None:
        pass


def clustered(facts: DataFrame, late: str = "0 seconds", threshold: float = 0.65, gap_days: float = 7.0) -> DataFrame:
    """``folds.cluster`` over a stream (history_name, seq, embedding, at: timestamp).

    A fact's row has its cluster. Once the watermark (``late`` behind the latest time)
    is more than the gap past a cluster's last fact, none can join it: its state goes,
    and a row with ``members`` and ``closed``, the time of its last fact, tells so.
    Facts without a time, and those behind the watermark, are left out.
    """
    _ready(facts.sparkSession)
    rows = facts.where("at IS NOT NULL").select("history_name", "seq", "embedding", "at").withWatermark("at", late)
    return rows.groupBy("history_name").transformWithStateInPandas(Clustering(threshold, gap_days), CLUSTERED, "Append", "eventTime")


# Export ----------------------------------------------------------------------

SHARDS = 64


class Export:
    """A sink for ``foreachBatch``: rows whose key no earlier batch had, each once, for ever.

    Each batch writes its rows and its keys below its own number, over what an attempt
    before may have left, and looks at the keys of lesser numbers only; so a batch that
    is done again gives the same. Keys are kept in shards by their hash, of which a
    batch reads those that it has.
    """

    def __init__(self, root: str, key: str) -> None:
        self.root, self.key = root.rstrip("/"), key

    def __call__(self, rows: DataFrame, batch: int) -> None:
        spark = rows.sparkSession
        shard = F.pmod(F.xxhash64(self.key), F.lit(SHARDS)).cast("int")
        rows = rows.where(F.col(self.key).isNotNull()).dropDuplicates([self.key]).withColumn("shard", shard).persist()
        try:
            if batch and (keys := self._keys(spark, rows.schema[self.key].dataType.simpleString())) is not None:
                shards = [r[0] for r in rows.select("shard").distinct().collect()]
                seen = keys.where(F.col("batch") < batch).where(F.col("shard").isin(shards)).select("shard", self.key)
                fresh = rows.join(seen, ["shard", self.key], "left_anti")
            else:
                fresh = rows
            fresh.drop("shard").write.mode("overwrite").parquet(f"{self.root}/rows/batch={batch}")
            # What is written is what counts: the keys are read from it.
            done = spark.read.schema(rows.drop("shard").schema).parquet(f"{self.root}/rows/batch={batch}")
            done.select(self.key, shard.alias("shard")).write.mode("overwrite").partitionBy("shard").parquet(f"{self.root}/keys/batch={batch}")
        finally:
            rows.unpersist()

    def _keys(self, spark: SparkSession, kind: str) -> DataFrame | None:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/keys")
        if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            return None
        return spark.read.schema(f"`{self.key}` {kind}, batch long, shard int").parquet(f"{self.root}/keys")

    def exported(self, spark: SparkSession) -> DataFrame:
        """All rows that went out, with their ``batch``."""
        return spark.read.parquet(f"{self.root}/rows")
