import random

from tensorloom.llm import leakage
from tensorloom.llm.leakage import Index, find_leaks, plain_words, remove_leaks

RNG = random.Random(5)
WORDS = [f"{a}{b}{c}" for a in ("ka", "lo", "mi", "ne", "pu", "ra") for b in ("da", "fe", "gi", "ho") for c in ("l", "m", "n", "r")]
ITEMS = [(i, " ".join(RNG.choices(WORDS, k=40)) + ".") for i in range(12)]
SHARED = "Read the following passage about the screen and pick the single best answer from all the choices."


def leaks(spark, docs, items=ITEMS, **kw):
    got = find_leaks(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string"), **kw)
    return sorted((r["doc_id"], r["item_id"]) for r in got.collect())


def test_whole_part_and_dressed(spark):
    words = ITEMS[3][1].split()
    docs = [
        (1, "before " + ITEMS[3][1] + " after"), (2, "x " + " ".join(words[5:20]) + " y"), (3, " ".join(words[5:15]) + " too short"),
        (4, " ".join(f"**{w}**" for w in words[:20])), (5, "> " + " ".join(words[:7]) + " " + words[7][:2] + "-\n> " + words[7][2:] + " " + " ".join(words[8:18])),
        (6, " ".join(w.upper().replace("A", "A­") for w in words[:16])), (7, None), (8, ""), (9, "nothing of it"),
    ]
    assert leaks(spark, docs) == [(1, 3), (2, 3), (4, 3), (5, 3), (6, 3)]


def test_edits(spark):
    words = ITEMS[4][1].split()[:30]
    some = [w if k % 8 else "changed" for k, w in enumerate(words)]
    many = [w if k % 4 else "changed" for k, w in enumerate(words)]
    dropped = [w for k, w in enumerate(words) if k % 9]
    added = [x for k, w in enumerate(words) for x in ([w, "also"] if k % 9 == 8 else [w])]
    docs = [(1, " ".join(some)), (2, " ".join(many)), (3, " ".join(dropped)), (4, " ".join(added)), (5, " ".join(reversed(words)))]
    assert leaks(spark, docs) == [(1, 4), (3, 4), (4, 4)]


def test_shared_instructions_count_for_nothing(spark):
    items = [(i, f"{SHARED} {t}") for i, t in ITEMS]
    assert leaks(spark, [(1, SHARED), (2, SHARED + " " + ITEMS[1][1])], items) == [(2, 1)]


def test_empty_tables_repeats_and_long_texts(spark):
    assert leaks(spark, []) == [] and leaks(spark, [(1, "x")], []) == [] and leaks(spark, [(1, "x")], [(1, None)]) == []
    filler = "word " * 100_000
    docs = [(1, filler + ITEMS[0][1] + filler), (1, ITEMS[0][1]), (2, filler)]
    assert leaks(spark, docs, ITEMS + [(20, ITEMS[0][1])]) == [(1, 0), (1, 0), (1, 20), (1, 20)]
    long_item = " ".join(RNG.choices(WORDS, k=3000))
    changed = " ".join(w if k % 10 else "changed" for k, w in enumerate(long_item.split()))
    assert leaks(spark, [(1, changed)], [(1, long_item)]) == [(1, 1)]


def test_brute_force(spark):
    """Exact passages only: the operator equals a scan of all pairs for common runs of 14 words."""
    docs = []
    for d in range(60):
        text = RNG.choices(WORDS, k=50)
        if d % 3 == 0:
            item = ITEMS[d % len(ITEMS)][1].split()
            n = RNG.choice((9, 14, 20))
            at = RNG.randrange(len(item) - n)
            text[10:10] = item[at : at + n]
        docs.append((d, " ".join(text)))
    grams = {}
    for i, t in ITEMS:
        w = plain_words(t)
        for k in range(len(w) - 13):
            grams.setdefault(tuple(w[k : k + 14]), set()).add(i)
    want = set()
    for d, t in docs:
        w = plain_words(t)
        for k in range(len(w) - 13):
            want |= {(d, i) for i in grams.get(tuple(w[k : k + 14]), ())}
    assert set(leaks(spark, docs)) == want and want


def test_remove(spark):
    documents = spark.createDataFrame([(1, "a b c. " * 30 + ITEMS[0][1] + " end"), (2, ITEMS[0][1]), (3, "clean"), (4, None)], "doc_id bigint, text string")
    found = find_leaks(documents, spark.createDataFrame(ITEMS, "item_id bigint, text string"))
    got = {r["doc_id"]: (r["action"], r["text"]) for r in remove_leaks(documents, found, 0.7).collect()}
    assert got[1][0] == "cut" and ITEMS[0][1][:-1] not in got[1][1] and got[1][1].endswith(" end")
    assert got[2] == ("dropped", None) and got[3] == ("kept", "clean") and got[4] == ("kept", None)


def test_every_sixth_word_edited(spark):
    words = ITEMS[7][1].rstrip(".").split()
    for n in (17, 35):
        part = words[2 : 2 + n]
        changed = [w if k % 6 != 5 else "changed" for k, w in enumerate(part)]
        dropped = [w for k, w in enumerate(part) if k % 6 != 5]
        added = [x for k, w in enumerate(part) for x in ([w, "also"] if k % 6 == 5 and k + 1 < n else [w])]
        docs = [(i, "before it " + " ".join(d) + " after it") for i, d in enumerate((changed, dropped, added))]
        assert leaks(spark, docs) == [(0, 7), (1, 7), (2, 7)]


def test_edited_passages_of_repeated_items(spark):
    words = ITEMS[2][1].rstrip(".").split()
    doc = " ".join(w if k % 7 != 6 else "changed" for k, w in enumerate(words[:30]))
    repeats = [(20 + i, ITEMS[2][1]) for i in range(3)]
    near = [(20 + i, f"{ITEMS[2][1][:-1]} item{i}.") for i in range(3)]
    for more in (repeats, near):
        assert leaks(spark, [(1, doc)], ITEMS + more) == [(1, i) for i in (2, 20, 21, 22)]


def test_blocks_change_nothing(spark, monkeypatch):
    rng = random.Random(9)
    vocabulary = [f"{a}{b}" for a in WORDS[:12] for b in WORDS[12:24]]
    items = [(i, " ".join(rng.choices(vocabulary, k=40))) for i in range(30)]
    docs = [(i, " ".join(w if k % 7 != 6 else rng.choice(vocabulary) for k, w in enumerate(t.split()))) for i, t in items]
    whole = leaks(spark, docs, items)
    monkeypatch.setattr(leakage, "BLOCK_WORDS", 200)
    assert leaks(spark, docs, items) == whole and len(whole) >= 30


def test_every_passage_within_the_definition_is_found():
    """Passages of 14 words or more with up to one edit in six, at random places: none is missed."""
    rng = random.Random(12)
    vocabulary = [f"{a}{b}" for a in WORDS[:40] for b in WORDS[40:60]]
    for _ in range(400):
        item = rng.choices(vocabulary, k=60)
        n = rng.randint(14, 40)
        at = rng.randint(0, 60 - n)
        edits = rng.randint(0, (n + 1) // 6)
        # edits inside the passage: its first and last word stand
        part = item[at : at + n]
        for k in sorted(rng.sample(range(1, n - 1), edits), reverse=True):
            kind = rng.choice("cda")
            part[k : k + 1] = {"c": ["changed"], "d": [], "a": [part[k], "added"]}[kind]
        doc = rng.choices(WORDS, k=30) + part + rng.choices(WORDS, k=30)
        index = Index([("i", 0, " ".join(item))], frozenset())
        assert [f[0] for f in index.scan(doc, 14)] == ["i"], (n, edits)


def test_reaches_equal_brute_force():
    """Furthest item words within so many edits, the last words equal, against full dynamic programming."""
    rng = random.Random(2)
    for _ in range(200):
        a, b = (rng.choices("pqr", k=rng.randint(0, 9)) for _ in range(2))
        cost = [[i + j if not i or not j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
        for i, x in enumerate(a, 1):
            for j, y in enumerate(b, 1):
                cost[i][j] = min(cost[i - 1][j - 1] + (x != y), cost[i - 1][j] + 1, cost[i][j - 1] + 1)
        got = leakage.reaches(a, b, 4)
        for e, found in enumerate(got):
            ends = [i for i in range(1, len(a) + 1) for j in range(1, len(b) + 1) if a[i - 1] == b[j - 1] and cost[i][j] <= e]
            assert (found[0] if found else 0) <= max(ends, default=0)
            # with all smaller numbers of edits nothing is missed
            assert max((f[0] for f in got[: e + 1] if f), default=0) == max(ends, default=0)
            if found:
                assert cost[found[0]][found[1]] <= e
