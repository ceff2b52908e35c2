import numpy as np
import pytest
from pyspark.sql import functions as F

from tensorloom.functions import codec, geometry, keys, layout
from tensorloom.functions.pixels import patches_of


@pytest.mark.parametrize(("w", "h", "size", "grid"), [(1000, 1000, (1000, 1000), (72, 72)), (50000, 100, (7167, 14), (2, 512)), (7, 7, (14, 14), (2, 2)), (8000, 1, (7168, 14), (2, 512))])
def test_geometry(spark, w, h, size, grid):
    df = spark.createDataFrame([(float(w), float(h))], "w double, h double")
    got = df.select(*geometry.resized(F.col("w"), F.col("h")), *geometry.grid(F.col("w"), F.col("h"))).first()
    assert (got[0], got[1]) == size and (got[2], got[3]) == grid


def test_bf16(spark):
    values = [0.0, 1.0, -2.5, 3.1415927, 1e-30, 65504.0]
    df = spark.createDataFrame([(values,), (None,), ([],)], "v array<float>").withColumn("b", codec.bf16_bytes("v")).withColumn("r", codec.bf16_values("b"))
    rows = df.collect()
    assert len(rows[0]["b"]) == 12 and np.allclose(rows[0]["r"], values, rtol=2**-8)
    assert rows[1]["r"] is None and rows[2]["r"] == []


def test_e2m1_table(spark):
    df = spark.range(1).select(F.transform(F.sequence(F.lit(0), F.lit(255)), lambda x: x.cast("int")).alias("p"))
    got = df.select(codec.e2m1_values("p", codec.exponent_scale(F.lit(130))).alias("v")).first()["v"]
    want = [codec.E2M1[n] * 8 for b in range(256) for n in (b & 15, b >> 4)]
    assert got == want


def test_layout(spark):
    df = spark.createDataFrame([("u" * 500, "keep me", 3)], "u string, a string, nv int")
    u0, a0 = layout.char_tokens(F.col("u")), layout.char_tokens(F.col("a"))
    u, a = layout.budget(u0, a0, F.col("nv"), 64)
    row = df.select(layout.input_ids(u, a, F.col("nv"), F.lit(64)).alias("i"), layout.labels(u, a, F.col("nv"), F.lit(64)).alias("l"), layout.attention_mask(u, a, F.col("nv"), F.lit(64)).alias("m")).first()
    assert len(row["i"]) == len(row["l"]) == len(row["m"]) == 64
    assert row["i"][:4] == [1, 0, 0, 0] and row["i"][-1] == 2
    assert [x for x in row["l"] if x != -100] == [(ord(c) % 900) + 10 for c in "keep me"] + [2]


def test_keys(spark):
    df = spark.createDataFrame([("x/images/a/b.png",), ("a/b.png",), (None,)], "p string")
    got = [r[0] for r in df.select(keys.tensor_key(F.col("p"))).collect()]
    assert got[0] == got[1] and got[2] is None and got[0].startswith("embeddings/") and len(got[0]) == 34
    assert spark.range(1).select(keys.int_list(F.lit("(1, 8)"))).first()[0] == [1, 8]
    assert spark.range(1).select(keys.padded("emb_", F.lit(12345), 4)).first()[0] == "emb_12345"


def test_names_are_never_guessed(spark):
    names = ["mind2web_12.png", "guiact-web-multi_7.jpg", "other_3.png", "aitw_3.gif", "waveui_.png"]
    df = spark.createDataFrame([(n,) for n in names], "n string").select(keys.parsed_name(F.col("n")).alias("p"))
    assert [(r["p"]["prefix"], r["p"]["idx"]) if r["p"] else None for r in df.collect()] == [("mind2web", 12), ("guiact-web-multi", 7), None, None, None]
    paths = spark.createDataFrame([("embeddings/a.pt",), ("a.pt",), ("x/a.pt",), (None,)], "p string")
    assert [r[0] for r in paths.select(keys.tensor_path(F.col("p"))).collect()] == ["embeddings/a.pt", "embeddings/a.pt", None, None]
    assert [keys.shard_range(t, 9) for t in ("2:5", "2", ":3", "4:99", "")] == [(2, 5), (2, 9), (0, 3), (4, 9), (0, 9)]


@pytest.mark.parametrize("value", [0, 255, 128])
def test_patches(value):
    gh, gw, cut = patches_of(np.full((1000, 1000, 3), value, dtype=np.uint8))
    assert (gh, gw) == (72, 72) and cut.shape == (5184, 3, 14, 14)
    assert cut[0].min() == cut[0].max() == pytest.approx(value / 127.5 - 1, abs=1e-6) and cut[-1, :, -1, -1].tolist() == [0, 0, 0]


def test_patch_order():
    pixels = np.arange(28 * 56 * 3).reshape(28, 56, 3) % 251
    gh, gw, cut = patches_of(pixels.astype(np.uint8))
    want = pixels[14:28, 28:42].transpose(2, 0, 1) / 127.5 - 1
    assert (gh, gw) == (2, 4) and np.allclose(cut[gw + 2], want, atol=1e-6)


def test_two_dimensional_blocks(spark):
    df = spark.createDataFrame([([float(k) for k in range(50 * 33)], [float(k) for k in range(12)])], "v array<double>, s array<double>")
    got = np.array(df.select(codec.block_scaled_2d(F.col("v"), F.col("s"), 33, 16, 16).alias("x")).first()["x"]).reshape(50, 33)
    scales = np.arange(12).reshape(4, 3).repeat(16, 0).repeat(16, 1)[:50, :33]
    assert np.array_equal(got, np.arange(50 * 33).reshape(50, 33) * scales)
