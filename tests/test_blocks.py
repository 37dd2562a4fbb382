import threading

import pytest
from pyspark.sql import functions as F

from aperture.sources.blocks import BlockStore


def work(spark, n=250):
    """Numbered rows; every seventh can not be read."""
    return spark.range(n, numPartitions=3).select(F.col("id").alias("row"), F.concat(F.lit("slide"), (F.col("id") % 5).cast("string")).alias("grp"))


def encode(df):
    return df.withColumn("payload", F.md5(F.col("row").cast("string"))).withColumn("why", F.when(F.col("row") % 7 == 0, "unreadable"))


WANT = [r for r in range(250) if r % 7]


def keyed(store):
    return [(r.key, r.row) for r in store.records().orderBy("key").collect()]


def test_keys_without_gaps_over_blocks(spark, tmp_path):
    store = BlockStore(spark, f"{tmp_path}/s")
    log = f"{tmp_path}/failures"
    assert store.build(work(spark), "row", encode, "why", block=60, failures=log, files=4) == (len(WANT), 250 - len(WANT))
    assert keyed(store) == list(enumerate(WANT)) and len(store) == store.check("grp") == len(WANT) and store.progress()[0] == 250
    assert sorted(int(r.row) for r in spark.read.csv(log, header=True).collect()) == [r for r in range(250) if not r % 7]
    assert store.build(work(spark), "row", encode, "why", block=60) == (0, 0)  # nothing to do
    assert store.build(work(spark, 300), "row", encode, "why", block=60)[0] == len([r for r in range(250, 300) if r % 7])  # the input has grown


def test_lookup_opens_one_file(spark, tmp_path):
    store = BlockStore(spark, f"{tmp_path}/s")
    store.build(work(spark), "row", encode, "why", block=100, files=5)
    for key in (0, 57, 58, 213):
        found = store.lookup(key)
        assert [(r.key, r.row) for r in found.collect()] == [(key, WANT[key])] and len(found.inputFiles()) == 1
    assert sorted(r.row for r in store.lookup(3, 200).collect()) == [WANT[3], WANT[200]]
    for key in (-1, len(WANT)):
        with pytest.raises(KeyError):
            store.lookup(key)


def test_a_builder_stopped_before_its_commit(spark, tmp_path, monkeypatch):
    """The block is written, its marker is not: it is written again, and the keys are those of a run without a stop."""
    store = BlockStore(spark, f"{tmp_path}/s")
    add, calls = store.log.add, []

    def stop(n, entry):
        calls.append(n)
        if len(calls) == 2:
            raise KeyboardInterrupt
        return add(n, entry)

    monkeypatch.setattr(store.log, "add", stop)
    with pytest.raises(KeyboardInterrupt):
        store.build(work(spark), "row", encode, "why", block=60)
    assert store.progress()[0] == 60 and len(list((tmp_path / "s" / "_blocks").iterdir())) == 2
    again = BlockStore(spark, f"{tmp_path}/s")
    again.build(work(spark), "row", encode, "why", block=60)
    assert keyed(again) == list(enumerate(WANT)) and again.check() == len(WANT)


def test_two_builders(spark, tmp_path):
    """Each block counts once, whoever commits it."""
    made = []
    threads = [threading.Thread(target=lambda: made.append(BlockStore(spark, f"{tmp_path}/s").build(work(spark), "row", encode, "why", block=60)[0])) for _ in range(2)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    store = BlockStore(spark, f"{tmp_path}/s")
    assert sum(made) == len(WANT) and keyed(store) == list(enumerate(WANT)) and store.check() == len(WANT)


def test_damage_is_found(spark, tmp_path):
    store = BlockStore(spark, f"{tmp_path}/s")
    store.build(work(spark), "row", encode, "why", block=100, files=2)
    first = tmp_path / "s" / store.index()[0][2]
    other = tmp_path / "s" / store.index()[-1][2]
    first.write_bytes(other.read_bytes())
    (first.parent / f".{first.name}.crc").unlink()
    with pytest.raises(RuntimeError, match="records, not"):
        store.check()
    first.unlink()
    with pytest.raises(RuntimeError, match="missing"):
        store.check()
    empty = BlockStore(spark, f"{tmp_path}/none")
    assert empty.check() == 0 and empty.build(work(spark, 0), "row") == (0, 0)
    with pytest.raises(LookupError):
        empty.records()


def test_a_record_without_its_group(spark, tmp_path):
    store = BlockStore(spark, f"{tmp_path}/s")
    store.build(work(spark, 20).withColumn("grp", F.when(F.col("row") != 5, F.col("grp"))), "row")
    with pytest.raises(RuntimeError, match="without grp"):
        store.check("grp")
