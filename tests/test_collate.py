import re
from datetime import datetime

from tensorloom.plans.reference import QUERIES

IMAGE = re.compile("(?:^|[^0-9a-f])([0-9a-f]{20})(?:[^0-9a-f]|$)")


def tokens(text):
    return [ord(c) % 900 + 10 for c in text or ""] or [10]


def collated(rows, n_vis):
    """The collate step of the trainer as a loop, at its bound of 4096: row_id -> values."""
    out, batches = {}, {}
    for table, row, emb, user, assistant in rows:
        m = IMAGE.search(emb.lower()) if emb is not None else None
        nv = 0 if emb is None else n_vis.get(m and m.group(1))
        if nv is None:
            continue
        left = 4096 - nv - 2
        a = tokens(assistant)[: max(1, left)]
        u = tokens(user)[: max(1, left - len(a))]
        batches.setdefault((table, row // 8), []).append((row, nv, u, a))
    for (table, batch), members in batches.items():
        length = max(2 + nv + len(u) + len(a) for _, nv, u, a in members)
        for row, nv, u, a in members:
            n = 2 + nv + len(u) + len(a)
            rest = length - n
            out[row] = {
                "ids": [1] + [0] * nv + u + a + [2] + [0] * rest, "labels": [-100] * (1 + nv + len(u)) + a + [2] + [-100] * rest,
                "mask": [1] * n + [0] * rest, "n": n, "pad": (table, batch, length), "spliced": [1] + [1001 + i for i in range(nv)] + u + a + [2],
            }
    return out


def test_whole_job_equals_the_loop(spark, tmp_path):
    image = [f"{i:020x}" for i in range(4)]
    at = datetime(2024, 10, 1)
    texts = [("q" * 300, "a" * 200), ("", None), ("long " * 900, "answer " * 20), ("éß😀 q", "yes")]
    embs = [f"embeddings/{image[0]}.pt", f" {image[1].upper()}.PT", None, f"embeddings/{image[2]}.pt", "embeddings/ffffffffffffffffffff.pt", "none"]
    rows = [("train_manifest" if i < 30 else "val_manifest", i, embs[i % 6], *texts[i % 4]) for i in range(44)]
    for name in ("train_manifest", "val_manifest"):
        spark.createDataFrame([(r[1], r[2], r[3], r[4], at) for r in rows if r[0] == name], "row_id bigint, emb string, user string, assistant string, written_at timestamp").write.parquet(f"{tmp_path}/{name}.parquet")
    n_vis = {image[0]: 40, image[1]: 3900, image[2]: 6000, image[3]: 7}
    spark.createDataFrame([(i, f"embeddings/{k}.pt", n, at) for i, (k, n) in enumerate(n_vis.items())], "emb_row_id bigint, key string, n_vis bigint, packed_at timestamp").write.parquet(f"{tmp_path}/emb_shards.parquet")
    want = collated(rows, n_vis)
    got = {name: {r["row_id"]: r for r in QUERIES[name](spark, str(tmp_path)).collect()} for name in ("collate_layout", "collate_labels", "collate_attention", "splice_visual")}
    assert all(set(g) == set(want) for g in got.values()) and max(w["n"] for w in want.values()) > 4096
    for row, w in want.items():
        assert list(got["collate_layout"][row]["input_ids"]) == w["ids"] and got["collate_layout"][row]["n"] == w["n"]
        assert list(got["collate_labels"][row]["labels"]) == w["labels"]
        assert list(got["collate_attention"][row]["mask"]) == w["mask"] and got["collate_attention"][row]["n_tokens"] == w["n"]
        assert list(got["splice_visual"][row]["spliced"]) == w["spliced"]
    pads = {(r["table_name"], r["batch"], r["pad_len"]) for r in QUERIES["batch_pad_len"](spark, str(tmp_path)).collect()}
    assert pads == {w["pad"] for w in want.values()}
