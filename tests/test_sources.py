import json
import struct
import zipfile

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tensorloom.operators import relational
from tensorloom.sources import files
from tensorloom.streaming import telemetry


def test_jsonl_and_array(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"a": 1}\nnot json\n{"a": 2}\n')
    assert files.read_jsonl(spark, f"file://{tmp_path}/a.jsonl", "a int", strict=False).count() == 2
    with pytest.raises(Exception):  # noqa: B017
        files.read_jsonl(spark, f"file://{tmp_path}/a.jsonl", "a int").collect()
    assert files.read_jsonl(spark, f"file://{tmp_path}/none", "a int").count() == 0
    (tmp_path / "m.json").write_text(json.dumps([{"image": "x"}, {"image": "y"}]))
    assert [(r["idx"], r["image"]) for r in files.read_json_array(spark, f"file://{tmp_path}/m.json", "image string").collect()] == [(0, "x"), (1, "y")]


def test_zip_and_headers(spark, tmp_path):
    png = b"\x89PNG\r\n\x1a\n" + b"\0\0\0\rIHDR" + struct.pack(">II", 640, 480)
    jpg = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x0b\x08" + struct.pack(">HH", 30, 50) + b"\0\0"
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("d/a.png", png)
        z.writestr("b.jpg", jpg)
        z.writestr("c.txt", "none")
    archives = spark.read.format("binaryFile").load(f"file://{tmp_path}/z.zip")
    got = {r["member"]: (r["s"]["w"], r["s"]["h"]) for r in files.zip_members(archives).withColumn("s", files.image_size("content")).collect()}
    assert got == {"d/a.png": (640, 480), "b.jpg": (50, 30), "c.txt": (None, None)}
    spark.dataSource.register(files.ZipSource)
    assert spark.read.format("zip").load(f"{tmp_path}/z.zip").count() == 3
    assert files.list_files(spark, f"file://{tmp_path}", "*.zip").count() == 1


def test_sinks(spark, tmp_path):
    df = spark.range(10).selectExpr("id", "id div 4 as shard", "if(id < 3, 'val', 'train') as split")
    files.write_shards(df, f"file://{tmp_path}/s", rows_per_file=2)
    assert spark.read.parquet(f"file://{tmp_path}/s").count() == 10
    files.write_splits(df, f"file://{tmp_path}/j")
    assert spark.read.json(f"file://{tmp_path}/j/split=val").count() == 3
    for _ in range(2):
        files.append_once(df, f"file://{tmp_path}/log", 7)
    assert spark.read.json(f"file://{tmp_path}/log").count() == 10
    assert {r["name"]: r["n_rows"] for r in files.dataset_card(df, "split").collect()} == {"val": 3, "train": 7}


def test_staged_copy(spark, tmp_path):
    (tmp_path / "x.bin").write_bytes(b"1234")
    todo = spark.createDataFrame([(f"{tmp_path}/x.bin", 4)], "path string, size bigint")
    assert files.staged_copy(todo, f"{tmp_path}/stage").first()["attempts"] == 1
    assert files.staged_copy(todo, f"{tmp_path}/stage").first()["attempts"] == 0
    with pytest.raises(Exception):  # noqa: B017
        files.staged_copy(todo.withColumn("size", F.lit(9).cast("long")), f"{tmp_path}/stage2", retries=1, wait=0.01).collect()


def test_stream_equals_batch_over_restarts(spark, tmp_path):
    log = tmp_path / "log"
    log.mkdir()

    def write(name, lo, hi):
        lines = [json.dumps({"type": "train", "run": "r", "step": i, "loss": 10.0 if i in (40, 45) else 1.0 + i % 3, "grad_norm": 50.0 if i in (40, 45) else 0.5}) for i in range(lo, hi)]
        (log / name).write_text("\n".join([*lines, json.dumps({"type": "val", "run": "r", "step": hi, "val_loss": 1.0})]))

    seen = []
    for part, (lo, hi) in enumerate([(0, 30), (30, 60)]):
        write(f"{part}.jsonl", lo, hi)
        stream = telemetry.monitor(telemetry.read_log(spark, f"file://{log}"))
        telemetry.run_available(stream, f"file://{tmp_path}/check", lambda df, _: seen.extend(df.collect()))
    assert [r["step"] for r in seen] == list(range(60)) and [r["step"] for r in seen if r["alert"]] == [40]
    e = None
    for i in range(60):
        v = 10.0 if i in (40, 45) else 1.0 + i % 3
        e = v if e is None else 0.98 * e + 0.02 * v
    assert seen[-1]["loss_ema"] == pytest.approx(e)


def test_shards_have_small_row_groups_and_listings_absorb_errors(spark, tmp_path):
    df = spark.range(300).selectExpr("cast(id as string) as key", "0 as shard", "array_repeat(cast(id as float), 8) as v")
    files.write_tensors(df, f"file://{tmp_path}/t", "v", 4)
    written = sorted((tmp_path / "t" / "shard=0").glob("*.parquet"))
    meta = pq.ParquetFile(written[0]).metadata
    assert max(meta.row_group(k).num_rows for k in range(meta.num_row_groups)) <= 64 and meta.row_group(0).column(0).compression == "UNCOMPRESSED"
    back = {r["key"]: (r["n_vis"], list(r["values"])) for r in files.read_tensors(spark, f"file://{tmp_path}/t", 4).collect()}
    assert back["5"] == (2, [5.0] * 8) and len(back) == 300
    with pytest.raises(relational.GateError):
        files.read_tensors(spark, f"file://{tmp_path}/t", 8)
    assert [r[0] for r in files.existing_shards(spark, f"file://{tmp_path}/t/shard=0", "part-").collect()] == [written[0].name]
    assert files.existing_shards(spark, "nosuchfs://x/y").count() == 0 and files.existing_shards(spark, f"file://{tmp_path}/none").count() == 0
    assert files.read_whole(spark, f"file://{tmp_path}/t/shard=0", "*.parquet").count() == 1
    placed = {r["key"]: r["idx"] for r in files.indexed_scan(spark, f"file://{tmp_path}/t/shard=0").select("key", "idx").collect()}
    assert sorted(placed.values()) == list(range(300))


def test_card_report_cache_and_publish(spark, tmp_path):
    at = f"file://{tmp_path}"
    card = files.dataset_card(spark.range(3))
    assert files.write_card(card, f"{at}/card") and not files.write_card(card, f"{at}/card") and spark.read.json(f"{at}/card").first()["n_rows"] == 3
    lines = spark.createDataFrame([("one",)], "line string")
    files.write_report(lines, f"{at}/report")
    files.write_report(lines, f"{at}/report", append=True)
    assert spark.read.text(f"{at}/report").count() == 2
    (tmp_path / "good.jsonl").write_text('{"k": "a", "v": 1}\n')
    (tmp_path / "bad.jsonl").write_text('{"k": "a", "v": 1}\n{"k": \n')
    counts = [files.read_cache(spark, f"{at}/{name}", "k string, v int").count() for name in ("good.jsonl", "bad.jsonl", "none.jsonl")]
    assert counts == [1, 0, 0]
    assert files.publish(spark, f"{at}/card", f"{at}/hub/card") and not files.publish(spark, f"{at}/card", f"{at}/hub/card")
    assert spark.read.json(f"{at}/hub/card").count() == 1


def test_alert_action(spark, tmp_path):
    log = tmp_path / "log"
    log.mkdir()
    lines = [json.dumps({"type": "train", "run": "r", "step": i, "loss": 10.0 if i == 40 else 1.0, "grad_norm": 50.0 if i == 40 else 0.5, "lr": 0.1}) for i in range(60)]
    (log / "a.jsonl").write_text("\n".join(lines))
    seen = []
    for _ in range(2):
        telemetry.act_on_alerts(telemetry.monitor(telemetry.read_log(spark, f"file://{log}")), f"file://{tmp_path}/check", f"file://{tmp_path}/alerts", lambda df: seen.extend(df.collect()))
    assert [(r["step"], r["loss"], r["loss_median"], r["gnorm_ema"]) for r in seen] == [(40, 10.0, 1.0, 1.49)]
    assert spark.read.json(f"file://{tmp_path}/alerts").count() == 1
