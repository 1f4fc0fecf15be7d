"""Files, conversion and streaming on corpora written by the tests."""

import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from rastrel.functions import containers, png, vp8
from rastrel.operators import convert, outcomes
from rastrel.plans import batching
from rastrel.sources import files
from rastrel.streaming import ingest


@pytest.fixture(scope="module")
def corpus(tmp_path_factory):
    """Pictures of three sizes, two broken ones, one that isn't a picture, one in capitals."""
    root = tmp_path_factory.mktemp("corpus")
    rng = np.random.default_rng(3)
    for i in range(12):
        h, w = ((16, 16), (16, 32), (9, 7))[i % 3]
        y, x = np.mgrid[0:h, 0:w]
        a = np.stack([x * 5 + i, y * 9, x + y, 255 - (i % 2) * (x > 2) * 99], -1).astype(np.uint8)
        (root / f"d{i % 2}").mkdir(exist_ok=True)
        (root / f"d{i % 2}" / f"p{i}.{'PNG' if i == 5 else 'png'}").write_bytes(png.encode(a, filters=int(rng.integers(5)), extra=[("tEXt", b"k\0v")] if i % 4 == 0 else []))
    (root / "d0" / "broken.png").write_bytes(png.MAGIC + b"rubbish")
    (root / "empty.png").write_bytes(b"")
    (root / "notes.txt").write_bytes(b"no picture")
    (root / "d1" / "other.jpg").write_bytes(b"\xff\xd8\xff\xe0")
    return root


@pytest.fixture(scope="module")
def listed(spark, corpus):
    return files.listing(spark, str(corpus)).withColumn("rel", files.relative(F.col("path"), f"file:{corpus}")).select("rel", "content", "path", "length")


def test_listing(spark, corpus, listed):
    assert listed.count() == 14
    assert files.listing(spark, str(corpus), images=False).count() == 13
    assert files.listing(spark, str(corpus), recursive=False).count() == 0  # the empty one is passed over
    assert {r.rel.split("/")[0] for r in listed.collect()} == {"d0", "d1"}
    assert files.common_base(listed) == f"file:{corpus}"
    plan = listed.select("rel", "length")._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan.split("ReadSchema:")[1]


def test_header_source_reads_only_the_start(spark, corpus):
    files.register(spark)
    got = spark.read.format("imagecorpus").option("path", str(corpus)).option("filesPerPartition", 4).load()
    assert got.rdd.getNumPartitions() == 4
    rows = got.select("path", "length", F.octet_length("content").alias("n"), files.header(F.col("content")).alias("h")).collect()
    assert len(rows) == 15 and all(r.n == min(33, r.length) for r in rows)
    assert sorted(r.h.w for r in rows) == [-1] * 3 + [7] * 4 + [16] * 4 + [32] * 4
    assert sum(r.h.legal for r in rows) == 12


def test_conversion(spark, listed):
    got = {r.rel: r for r in convert.convert(listed.select("rel", "content"), min_psnr=25.0, cap=3).collect()}
    assert len(got) == 14
    status = [r.status for r in got.values()]
    assert status.count("ok") + status.count("fallback") == 12 and status.count("fail") == 2
    source = {r.rel: bytes(r.content) for r in listed.collect()}
    for rel, r in got.items():
        if r.bytes is not None:
            a, meta = convert.read_any(source[rel])
            assert convert.verify(a, meta, bytes(r.bytes), 25.0)[0] is None
    again = {r.rel: r for r in convert.convert(listed.select("rel", "content").repartition(7), min_psnr=25.0, cap=1).collect()}
    assert {k: r.bytes for k, r in got.items()} == {k: r.bytes for k, r in again.items()}


def test_existing_outputs_and_collisions(spark, listed):
    two = listed.select("rel", "content").union(listed.where("rel = 'd0/p0.png'").select(F.lit("d0/p0.jpg"), "content"))
    have = spark.createDataFrame([("d1/p1.webp",)], "out_path string")
    got = {r.rel: (r.status, r.note) for r in convert.convert(two, have, min_psnr=None).collect()}
    assert got["d1/p1.png"] == ("skipped", "the output is there")
    assert got["d0/p0.png"] == ("skipped", "another file has this output") and got["d0/p0.jpg"][0] == "ok"


def test_writing_and_quarantine(spark, listed, tmp_path):
    files.register(spark)
    done = convert.convert(listed.select("rel", "content"), min_psnr=None).persist()
    convert.write(done, str(tmp_path / "out"))
    found = sorted(str(p.relative_to(tmp_path / "out")) for p in (tmp_path / "out").rglob("*") if p.is_file())
    assert len(found) == 12 and all(x.endswith(".webp") for x in found)
    assert containers.sniff((tmp_path / "out" / found[0]).read_bytes()) == "webp"
    bad = convert.quarantine(done, listed)
    assert {r.rel for r in bad.collect()} == {"d0/broken.png", "d1/other.jpg"}
    totals = outcomes.rollup(done).first()
    assert (totals.done, totals.failed, totals.total) == (12, 2, 14)


def test_two_passes_keep_the_smaller(spark, listed):
    rows = convert.two_pass(listed.where("rel LIKE 'd0/p%'").select("rel", "content"), 36.0).collect()
    assert rows and all(r.bytes <= r.plain_bytes for r in rows)


def test_incremental_conversion(spark, corpus, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    names = sorted(corpus.rglob("p*.png"))
    for batch in (names[:3], names[3:5]):
        for p in batch:
            (src / p.name).write_bytes(p.read_bytes())
        q = ingest.convert_stream(spark, f"file:{src}", str(tmp_path / "outcomes"), str(tmp_path / "state"), min_psnr=None)
        q.awaitTermination()
    got = spark.read.parquet(str(tmp_path / "outcomes"))
    assert got.count() == 5 and got.select("epoch").distinct().count() == 2 and got.where("status = 'ok'").count() == 5


def test_progress_windows(spark, tmp_path):
    spark.createDataFrame([(i, i // 3, "view", 1.0) for i in range(30)], "id long, h int, event_type string, value double").select(F.timestamp_seconds(F.col("h") * 3600).alias("ts"), "event_type", "value").write.parquet(str(tmp_path / "e"))
    s = spark.readStream.schema("ts timestamp, event_type string, value double").parquet(str(tmp_path / "e"))
    q = ingest.progress(s).writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [(r.n, r.total) for r in spark.table("windows").collect()] == [(3, 3.0)] * 10


def test_groups_fill_up(spark, tmp_path):
    rows = [(f"a{i}", 1, 1) for i in range(70)] + [(f"b{i}", 2, 1) for i in range(30)] + [("c", 3, 1)]
    spark.createDataFrame(rows, "rel string, mb_h int, mb_w int").write.parquet(str(tmp_path / "r"))
    s = spark.readStream.schema("rel string, mb_h int, mb_w int").parquet(str(tmp_path / "r"))
    q = ingest.grouped(s, cap=64, wait_ms=500).writeStream.format("memory").queryName("groups").outputMode("append").trigger(processingTime="300 milliseconds").start()
    try:
        for _ in range(60):
            got = spark.table("groups").collect()
            if sum(len(r.rels) for r in got) == 101:
                break
            time.sleep(0.5)
    finally:
        q.stop()
    assert sorted((r.mb_h, len(r.rels)) for r in got) == [(1, 6), (1, 64), (2, 30), (3, 1)]


# --- planning


def test_batches(spark):
    df = spark.createDataFrame([(f"f{i:04d}", 1 if i % 5 else 2) for i in range(500)], "rel string, k int")
    got = batching.batches(df, ["k"], "rel", 32, part=60).collect()
    for k in (1, 2):
        own = sorted((r.rel, r.batch_id) for r in got if r.k == k)
        assert [b for _, b in own] == [i // 32 for i in range(len(own))]


def test_bucket_plan():
    sizes = [(512, 512, 500), (512, 768, 10), (512, 784, 9), (1024, 1024, 3), (768, 512, 5), (100, 100, 4)]
    plan = batching.plan_buckets(sizes)
    assert (512, 512) not in plan and (100, 100) not in plan
    assert plan[512, 768] == plan[512, 784] == (512, 784)
    assert plan[768, 512] == (768, 512) and plan[1024, 1024] == (1024, 1024)
    assert batching.plan_buckets([]) == {}


def test_no_row_is_lost_in_many_slices(spark):
    df = spark.range(300_000).select(F.concat(F.lit("p"), F.xxhash64("id")).alias("rel"), (F.pmod(F.xxhash64("id"), F.lit(10)) > 6).cast("int").alias("w"))
    df = df.mapInPandas(lambda it: (p.assign(more=p["rel"] * 2) for p in it), "rel string, w int, more string")
    got = batching.batches(df, ["w"], "rel", 16).groupBy("w", "batch_id").agg(F.count("*").alias("n"), F.min("rel").alias("a"), F.max("rel").alias("z")).toPandas().sort_values(["w", "batch_id"])
    assert got["n"].sum() == 300_000 and got["n"].max() == 16
    for _, g in got.groupby("w"):
        assert (g["n"].iloc[:-1] == 16).all() and g["batch_id"].tolist() == list(range(len(g)))
        assert (g["z"].iloc[:-1].to_numpy() < g["a"].iloc[1:].to_numpy()).all()


def test_greedy_groups(spark):
    df = spark.createDataFrame([(0, i, s) for i, s in enumerate([5, 5, 5, 20, 1, 9, 1])], "k int, n int, size long")
    got = batching.byte_groups(df, ["k"], "n", "size", 10, 0).orderBy("n").collect()
    assert [r.group_id for r in got] == [0, 0, 1, 2, 3, 3, 4]


def test_tables_are_a_parameter(tmp_path):
    import json

    t = vp8.Tables.plain()
    (tmp_path / "t.json").write_text(json.dumps({"coeff": t.coeff.ravel().tolist(), "update": t.update.ravel().tolist(), "mode": (t.mode // 2).ravel().tolist()}))
    own = vp8.Tables.load(str(tmp_path / "t.json"))
    a = np.full((16, 16, 3), 99, np.uint8)
    (data, _), = vp8.encode_rgb([a], 90, own)
    assert vp8.decode_rgb(data, own).shape == a.shape


def test_large_pictures_fall_back(spark, listed):
    """Those over the limit of pixels are encoded by the fallback; the others are not touched by that."""
    rows = {r.rel: r for r in convert.convert(listed.select("rel", "content"), min_psnr=25.0, max_pixels=300).collect()}
    sizes = {r.rel: convert.read_any(bytes(r.content))[0].shape[:2] for r in listed.where("rel LIKE '%/p%'").collect()}
    assert {rows[k].status for k, (h, w) in sizes.items() if h * w > 300} == {"fallback"}
    assert {rows[k].status for k, (h, w) in sizes.items() if h * w <= 300} == {"ok"}


def test_rare_sizes_share_batches():
    sizes = [(1, 1)] * 40 + [(2, 3), (2, 4), (3, 3), (3, 4), (9, 2)]
    got = convert.batched(sizes, 16)
    assert sorted(i for b in got for i in b) == list(range(45)) and max(map(len, got)) == 16
    assert len(got) < 3 + 5 and not any({sizes[i] for i in b} > {(1, 1)} for b in got)


def test_batches_are_halved_when_memory_runs_out(spark, listed, monkeypatch):
    encode = vp8.encode_rgb
    seen = []

    def short(images, *a, **k):
        seen.append(len(images))
        if len(images) > 1:
            raise MemoryError
        return encode(images, *a, **k)

    files_ = listed.where("rel LIKE '%/p%'").select("rel", "content", F.col("rel").alias("out_path")).toPandas()
    monkeypatch.setattr(vp8, "encode_rgb", short)
    run = convert._encoder(90, 16, None, 0.0, None, 1 << 20)
    got = run(files_.assign(checked=False))
    monkeypatch.undo()
    plain = convert._encoder(90, 16, None, 0.0, None, 1 << 20)(files_.assign(checked=False))
    assert max(seen) > 1 and got.sort_values("rel")["bytes"].tolist() == plain.sort_values("rel")["bytes"].tolist()


def test_failed_files_are_copied(spark, listed, tmp_path):
    files.register(spark)
    done = convert.convert(listed.select("rel", "content"), min_psnr=None)
    convert.quarantine(done, listed, str(tmp_path / "bad"))
    assert sorted(str(p.relative_to(tmp_path / "bad")) for p in (tmp_path / "bad").rglob("*") if p.is_file()) == ["d0/broken.png", "d1/other.jpg"]
