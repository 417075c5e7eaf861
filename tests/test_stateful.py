"""Folds over streams, cut and restarted, against the folds over whole histories."""

import datetime
import os
import shutil
import time
from functools import partial

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.operators import folds
from palimpsest.streaming import stateful

KIND = "history_name string, seq long, text string, time string, embedding array<double>, at timestamp, utility double, confidence double, recency double, type_prior double"


def facts(n=60):
    r = np.random.default_rng(3)
    day = datetime.datetime(2024, 1, 1)
    rows = []
    for h in ("a", "b", "c"):
        centers = r.normal(size=(6, 4))
        for i in range(n if h == "a" else 15):
            v = centers[r.integers(0, 6)] + 0.2 * r.normal(size=4)
            words = " ".join(r.choice(list("uvwxyz"), r.integers(1, 5)))
            rows.append((h, i, "" if i % 13 == 4 else words, f"t{i}", v.tolist(), day + datetime.timedelta(days=int(i * 1.5)), 0.5, 0.2, 0.5, float(r.random())))
    return rows


@pytest.fixture(scope="module")
def cut(spark, tmp_path_factory):
    """Ordered facts in files, in a folder for each cut; one file is one batch."""
    root = tmp_path_factory.mktemp("facts")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")  # a batch starts a worker for each
    rows = sorted(facts(), key=lambda r: r[1])
    spark.createDataFrame(rows, KIND).coalesce(1).write.parquet(str(root / "whole"))
    for name, size in (("fine", 23), ("coarse", 50)):
        (root / name).mkdir()
        for k, lo in enumerate(range(0, len(rows), size)):
            spark.createDataFrame(rows[lo : lo + size], KIND).coalesce(1).write.parquet(str(root / "one"))
            (part,) = (root / "one").glob("part-*.parquet")
            part.rename(root / name / f"{k:03d}.parquet")
            shutil.rmtree(root / "one")
    yield root
    spark.conf.set("spark.sql.shuffle.partitions", before)


def streamed(spark, cut, name, tmp_path, make, stops=(2,)):
    """All rows of a stream that is stopped after some files and started again."""
    files = sorted((cut / name).glob("*.parquet"))
    given = tmp_path / "in"
    given.mkdir()
    for lo, hi in zip((0, *stops), (*stops, len(files)), strict=True):
        for k, f in enumerate(files[lo:hi]):
            shutil.copy(f, given / f"{lo + k:03d}.parquet")
            os.utime(given / f"{lo + k:03d}.parquet", (1_700_000_000 + lo + k,) * 2)  # the source goes by it
        source = spark.readStream.schema(KIND).option("maxFilesPerTrigger", 1).parquet(str(given))
        sink = make(source).writeStream.format("parquet").outputMode("append") if isinstance(make, Appending) else None
        if sink is not None:
            q = sink.option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start(str(tmp_path / "out"))
        else:
            keep = lambda rows, batch: rows.write.mode("overwrite").parquet(f"{tmp_path}/out/batch={batch}")
            q = make(source).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
        q.awaitTermination(300)
        assert q.exception() is None
    return spark.read.parquet(str(tmp_path / "out"))


class Appending:
    def __init__(self, make):
        self.make = make

    def __call__(self, rows):
        return self.make(rows)


def same(a, b, *names):
    assert sorted((tuple(x) for x in a.select(*names).collect()), key=repr) == sorted((tuple(x) for x in b.select(*names).collect()), key=repr)


def test_relations(spark, cut, tmp_path):
    got = stateful.latest(streamed(spark, cut, "fine", tmp_path, partial(stateful.related, threshold=0.6), (1,)))
    want = folds.folded(spark.read.parquet(str(cut / "whole")), partial(folds.relate, threshold=0.6), folds.RELATE)
    same(got, want, *want.columns)


def test_operations_with_deletions(spark, cut, tmp_path):
    def decide(existing, given):
        return [("DELETE", 0, "")] if given[0].startswith("u") and existing else folds.first_words(existing, given)

    got = stateful.latest(streamed(spark, cut, "coarse", tmp_path, partial(stateful.operated, decide=decide), (1,)))
    want = folds.folded(spark.read.parquet(str(cut / "whole")), partial(folds.operated, decide=decide), folds.OPERATED)
    same(got, want, *want.columns)


def test_operations_by_the_offline_rule(spark, cut, tmp_path):
    got = stateful.latest(streamed(spark, cut, "coarse", tmp_path, stateful.operated, (1,)))
    want = folds.folded(spark.read.parquet(str(cut / "whole")), folds.operated, folds.OPERATED)
    same(got, want, *want.columns)


def test_admission(spark, cut, tmp_path):
    got = streamed(spark, cut, "fine", tmp_path, Appending(stateful.admitted), (2,))
    want = folds.folded(spark.read.parquet(str(cut / "whole")), folds.admit, folds.ADMIT)
    same(got, want, *want.columns)


def test_clusters_close_after_the_gap(spark, cut, tmp_path):
    got = streamed(spark, cut, "fine", tmp_path, Appending(partial(stateful.clustered, threshold=0.7, gap_days=5.0)), (2,)).cache()
    whole = spark.read.parquet(str(cut / "whole"))
    want = folds.folded(whole.withColumn("at", F.col("at").cast("double")), partial(folds.cluster, threshold=0.7, gap_days=5.0), folds.CLUSTER)
    same(got.where("seq IS NOT NULL"), want, *want.columns)
    sizes = want.join(whole.select("history_name", "seq", "at"), ["history_name", "seq"]).groupBy("history_name", "cluster").agg(F.count("*").alias("members"), F.max("at").alias("closed"))
    closed = got.where("seq IS NULL")
    assert closed.join(sizes, ["history_name", "cluster", "members", "closed"]).count() == closed.count() > 0
    # All whose gap had passed when the last file came are closed; later ones may be.
    *_, before, _ = sorted((cut / "fine").glob("*.parquet"))
    seen = spark.read.parquet(str(before)).agg(F.max("at")).first()[0]
    assert sizes.where(F.col("closed") < F.lit(seen - datetime.timedelta(days=5, seconds=1))).join(closed, ["history_name", "cluster"], "left_anti").count() == 0


def test_idle_histories_go(spark, cut, tmp_path):
    """State of a history that brings nothing is dropped; such a query looks at the clock, so it does not end by itself."""
    source = spark.readStream.schema(KIND).parquet(str(cut / "coarse"))
    out = stateful.admitted(source, idle_ms=1).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "check"))
    q = out.start(str(tmp_path / "out"))
    try:
        for _ in range(60):
            held = [x.stateOperators[0].numRowsTotal for x in q.recentProgress if x.stateOperators]
            if any(x.numInputRows for x in q.recentProgress) and held[-1] == 0:
                break
            time.sleep(1)
        assert q.exception() is None
        assert held[-1] == 0
    finally:
        q.stop()
    assert spark.read.parquet(str(tmp_path / "out")).count() == spark.read.parquet(str(cut / "whole")).count()


def test_nothing_is_exported_twice(spark, tmp_path):
    """Batches that come again, keys that come again however late, and a batch that failed halfway."""
    sink = stateful.Export(str(tmp_path / "x"), "k")
    frame = lambda ks: spark.createDataFrame([(k, f"v{k}") for k in ks], "k long, v string")
    batches = [[1, 2, 2, 3, None], [3, 4, 1], [5], [1, 6, 5], [2, 7]]
    for i, ks in enumerate(batches):
        sink(frame(ks), i)
        if i == 3:  # the query starts again at batch 2
            sink(frame(batches[2]), 2)
            frame([99]).write.mode("overwrite").parquet(str(tmp_path / "x/rows/batch=3"))  # an attempt that left other rows
            sink(frame(batches[3]), 3)
    found = sorted((x["batch"], x["k"]) for x in sink.exported(spark).collect())
    assert found == [(0, 1), (0, 2), (0, 3), (1, 4), (2, 5), (3, 6), (4, 7)]


def test_an_export_of_a_stream(spark, cut, tmp_path):
    for attempt in range(2):  # the second run has a new checkpoint: all batches come again
        sink = stateful.Export(str(tmp_path / "x"), "text")
        source = spark.readStream.schema(KIND).option("maxFilesPerTrigger", 1).parquet(str(cut / "fine"))
        q = source.writeStream.foreachBatch(sink).option("checkpointLocation", str(tmp_path / f"check{attempt}")).trigger(availableNow=True).start()
        q.awaitTermination(300)
        assert q.exception() is None
    rows = sink.exported(spark)
    whole = spark.read.parquet(str(cut / "whole")).select("text").distinct()
    assert rows.count() == rows.select("text").distinct().count() == whole.count()
