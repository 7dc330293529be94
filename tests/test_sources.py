"""Readers, writers and streams on small files."""

import zipfile

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.session import shared_folder
from tidemark.sources import normalise as N
from tidemark.sources import archives, readers, sinks


def test_upsert_keeps_newest_and_other_partitions(spark):
    path = sinks.scratch(spark, "t")
    a = spark.createDataFrame([(1, "x", 1.0), (2, "x", 2.0), (3, "y", 3.0)], "id bigint, p string, v double")
    b = spark.createDataFrame([(2, "x", 20.0), (4, "z", 4.0)], "id bigint, p string, v double")
    for d in (a, b, b):
        sinks.upsert(d, path, ["id"], ["p"], ["v"])
    got = {r["id"]: r["v"] for r in readers.tree(spark, path).collect()}
    assert got == {1: 1.0, 2: 20.0, 3: 3.0, 4: 4.0}


def test_zipped_klines(spark, tmp_path):
    line = "{},1,2,0.5,1.5,10,{},15,3,4,6,0\n"
    with zipfile.ZipFile(tmp_path / "a.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("a.csv", "open_time,open,high,low,close,volume,close_time,qv,n,tb,tq,i\n" + line.format(1700000000000, 1700000059999))
        z.writestr("more.csv", "".join(line.format(1700000060000 + 60000 * i, 1700000119999 + 60000 * i) for i in range(3000)))
        z.writestr("readme.txt", "no bars")
        z.writestr("empty.csv", "")
    (tmp_path / "deep").mkdir()
    with zipfile.ZipFile(tmp_path / "deep" / "b.zip", "w") as z:
        z.writestr("b.csv", line.format(1700180060000000, 1700180119999000))
    d = archives.archived_klines(spark, str(tmp_path))
    assert d.rdd.getNumPartitions() == 3  # one for each member that holds bars
    got = d.orderBy("open_time").collect()
    assert [r["open_time"] for r in got] == [1700000000000000 + 60000000 * i for i in range(3001)] + [1700180060000000] and got[0]["taker_buy_base"] == 4.0
    empty = tmp_path / "none"
    empty.mkdir()
    assert archives.archived_klines(spark, str(empty)).count() == 0


def test_broken_lines(spark):
    path = sinks.scratch(spark, "lines")
    spark.createDataFrame([('{"a": 1}',), ('{"a": 2',)], "value string").coalesce(1).write.text(path)
    schema = T.StructType([T.StructField("a", T.LongType())])
    assert [r["a"] for r in readers.events(spark, path, schema).collect()] == [1]


def test_manifest_names_changed_ranges_however_files_are_split(spark, tmp_path):
    body = bytearray(bytes(range(256)) * 4000 + b"tail without a feed")
    for name in ("same", "changed", "lost"):
        (tmp_path / name).write_bytes(bytes(body))
    manifest = archives.range_digests(spark, str(tmp_path), 100_000).collect()
    files = archives.file_digests(spark.createDataFrame(manifest)).collect()
    assert {r["size"] for r in files} == {len(body)} and len({r["digest"] for r in files}) == 1 and len(manifest) == 3 * 11
    spark.conf.set("spark.sql.files.maxPartitionBytes", "50000")
    try:
        assert sorted(archives.range_digests(spark, str(tmp_path), 100_000).collect()) == sorted(manifest)
        body[250_005] ^= 1
        body[-1] ^= 1
        (tmp_path / "changed").write_bytes(bytes(body))
        (tmp_path / "new").write_bytes(b"x\n")
        (tmp_path / "lost").unlink()
        got = archives.verify_manifest(spark.createDataFrame(manifest), archives.range_digests(spark, str(tmp_path), 100_000)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert {r["path"].rsplit("/", 1)[1]: (r["status"], r["ranges"]) for r in got} == {"changed": ("changed", [2, 10]), "lost": ("missing", list(range(11))), "new": ("unknown", [0])}


def test_standard_bars_never_make_up_taker_flow(spark):
    d = spark.createDataFrame([(1_700_000_000, 1, 1.0, 2.0, 0.5, 1.5, 10.0), (1_700_000_000, 2, 1.0, 2.0, 0.5, 1.6, 10.0)], "t bigint, n bigint, o double, h double, l double, c double, v double")
    r = N.standard_bars(d.withColumn("s", F.lit("A")), "t", ["s"], ["n"]).collect()
    assert len(r) == 1 and r[0]["close"] == 1.6 and r[0]["quote_volume"] == 16.0 and r[0]["taker_buy_base"] is None


def test_shared_folder_follows_the_session(spark):
    assert shared_folder(spark) == shared_folder(spark)
