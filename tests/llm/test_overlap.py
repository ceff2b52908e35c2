import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tensorloom.llm import overlap
from tensorloom.llm.overlap import Instructions, canonical, distance_bound, edits_within, explain, near_pairs, segments, windows

SCHEMA = "row_id bigint, user string, assistant string, image string"
BASE = ("You see page 31 of Nevoten. Which value is shown for Torelin in the footer? Keep it short.", "Torelin shows 5.25 in the footer, right below the search box.")
#: Other rows of the corpus: they show what an instruction is, and that two words stand for each other.
OTHERS = [
    (1000 + i, f"You see page {100 + i} of Ravudash. Which value is shown for Zelavik in the header? {style}", f"It shows {200 + i} there, says the header.", "z")
    for i, style in enumerate(("Keep it short.", "One line only.") * 8)
]
REWORDED = [(2000 + i, q.replace("value", "figure"), a, e) for i, (_, q, a, e) in enumerate(OTHERS[:6])]


def found(spark, val, train):
    got = near_pairs(spark.createDataFrame(val, SCHEMA), spark.createDataFrame(train, SCHEMA))
    return sorted((r["eval_id"], r["train_id"]) for r in got.collect() if r["eval_id"] < 1000)


def test_same(spark):
    cases = [
        BASE, (BASE[0].upper(), BASE[1]), ("Hello, " + BASE[0].replace(" Keep it short.", ""), BASE[1]), ("Keep it short. " + BASE[0].replace(" Keep it short.", ""), BASE[1].replace("the ", "")),
        (BASE[0].replace("value", "figure").replace("shown", "shwon"), f"<p>{BASE[1]}</p>"), (BASE[0].replace("Keep it short.", "One line only."), BASE[1].rstrip(".")), (BASE[0].replace("footer", "foter"), BASE[1] + "​"),
        (BASE[0].replace("Keep it short.", "Keep it shrot"), BASE[1]),
    ]
    val = [(i, *case, "a") for i, case in enumerate(cases)]
    assert found(spark, [*val, *REWORDED], [(2, *BASE, "b"), *OTHERS]) == [(i, 2) for i in range(len(cases))]


def test_different(spark):
    changes = [("31", "32"), ("5.25", "5.26"), ("Torelin", "Ravudash"), ("footer", "top bar"), ("search", "seat"), ("below", "beside")]
    val = [(i, BASE[0].replace(old, new), BASE[1].replace(old, new), "a") for i, (old, new) in enumerate(changes)]
    assert found(spark, val, [(2, *BASE, "a"), *OTHERS]) == []


def test_other_words_are_other_facts(spark):
    cases = [
        ("How do you import the marked rows of the sheet named Ravudash today?", "How do you export the marked rows of the sheet named Ravudash today?"),
        ("Does this view include the totals column of the sheet named Ravudash?", "Does this view exclude the totals column of the sheet named Ravudash?"),
        ("Where is the black button of the panel named Ravudash placed today?", "Where is the block button of the panel named Ravudash placed today?"),
        ("Which state is shown in the panel of the sheet named Ravudash?", "Which name is shown in the panel of the sheet named Ravudash?"),
        ("Is the third card of Ravudash locked at the moment or not?", "Is the third card of Ravudash unlocked at the moment or not?"),
    ]
    answer = lambda i: f"You find it on page {5 + i} of the manual."
    val = [(i, one, answer(i), "a") for i, (one, _) in enumerate(cases)]
    train = [(100 + i, other, answer(i), "a") for i, (_, other) in enumerate(cases)] + [(200 + i, one, answer(i), "b") for i, (one, _) in enumerate(cases)]
    assert found(spark, val, [*train, *OTHERS]) == [(i, 200 + i) for i in range(len(cases))]


def test_short_pairs_need_the_image(spark):
    train = [(10, "Is it on?", "Yes", "a"), (11, "Is it on?", "Yes", "b"), (12, "Is it on?", "Yes", None), (13, "Is it on?", "No", "a")]
    assert found(spark, [(1, "is it on", "Yes.", "a"), (2, "Is it on?", "Yes", None)], train) == [(1, 10)]
    # an article more makes ten words: the image still counts
    nine, ten = ("Which red lamp of Ravudash is lit?", "Lamp 7."), ("Which red lamp of the Ravudash is lit?", "Lamp 7.")
    assert found(spark, [(1, *nine, "a")], [(10, *ten, "a"), (11, *ten, "b"), (12, *ten, None)]) == [(1, 10)]
    assert found(spark, [(1, *ten, "a")], [(10, *nine, "a"), (11, *nine, "b"), (12, *ten, "c")]) == [(1, 10), (1, 12)]


def test_defined_cases(spark):
    assert found(spark, [(1, None, None, None), (2, "", "", "a")], [(3, None, None, None), (4, "", "", "a")]) == []
    assert found(spark, [], [(1, *BASE, "a")]) == [] and found(spark, [(1, *BASE, "a")], []) == []
    copies = [(i, *BASE, "x") for i in range(5)]
    assert len(found(spark, copies, [(10 + r[0], *r[1:]) for r in copies])) == 25
    long = ("Read this. " + "The seat map of Nevoten is at 31. " * 3000, "Done with 7 of them.")
    assert found(spark, [(1, *long, None)], [(2, long[0].replace("seat", "saet", 1), long[1], None)]) == [(1, 2)]
    linked = overlap.linked_rows(spark.createDataFrame(copies, SCHEMA), spark.createDataFrame(copies, SCHEMA)).collect()
    assert len(linked) == 5 and {r["n_links"] for r in linked} == {5} and len({r["class_id"] for r in linked}) == 1


@settings(max_examples=200, deadline=None)
@given(st.text("abcde ", min_size=1, max_size=80), st.integers(0, 10**9))
def test_segments_lose_nothing(text, seed):
    """Every string within the bound shares a segment at an allowed place."""
    rng = random.Random(seed)
    other = list(text)
    for _ in range(rng.randint(0, distance_bound(len(text)))):
        at = rng.randint(0, len(other))
        kind = rng.choice("ird")
        if kind == "i":
            other.insert(at, rng.choice("xyz"))
        elif other and at < len(other):
            other[at : at + 1] = [rng.choice("xyz")] if kind == "r" else []
    if len(text) <= distance_bound(len(text)):
        return
    assert set(segments(text)) & set(windows("".join(other), len(text)))


def brute(val, train):
    """All pairs compared letter by letter with full dynamic programming; words looked up one by one."""

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    none = Instructions([])
    form = {r[0]: " ".join([*canonical(r[1], none)[0], "|", *canonical(r[2])[0]]) for r in val + train}
    names = {r[0]: {*overlap.names_of(r[1]), *overlap.names_of(r[2])} for r in val + train}
    count = {}
    for f in set(form.values()):
        for w in set(f.split()):
            count[w] = count.get(w, 0) + 1
    fine = lambda a, b, typo: typo and min(count[a], count[b]) <= max(2, max(count[a], count[b]) / 20)
    met = []
    for v in val:
        for t in train:
            a, b = form[v[0]], form[t[0]]
            if [w for w in a.split() if w[0].isdigit()] == [w for w in b.split() if w[0].isdigit()] and distance(a, b) <= distance_bound(len(a)):
                changes = explain(a.split(), b.split(), names[v[0]] | names[t[0]])
                if changes is not None:
                    met.append((v[0], t[0], changes))
    # words that stand for each other in pairs with no other change
    shown, total = {}, {}
    for v, _, changes in met:
        if len(changes) == 1 and not fine(*changes[0]):
            shown.setdefault(frozenset(changes[0][:2]), set()).add(form[v])
    for pair, seen in shown.items():
        for w in pair:
            total[w] = total.get(w, 0) + len(seen)
    alike = {pair for pair, seen in shown.items() if len(seen) >= overlap.LEAST_EVIDENCE and len(seen) >= overlap.MOSTLY * max(total[w] for w in pair) and not pair & overlap._FACTS}
    stands = lambda a, b: any(w == b and overlap._close(a, o) is not None for pair in alike for w in pair for o in pair - {w}) and min(count[a], count[b]) <= 2
    good = lambda a, b, typo: fine(a, b, typo) or frozenset((a, b)) in alike or stands(a, b) or stands(b, a)
    return sorted((v, t) for v, t, changes in met if all(good(*c) for c in changes))


def mistyped(rng, t, n):
    """Letters dropped, doubled or swapped in words of small letters."""
    words = t.split(" ")
    for _ in range(n):
        at = rng.randrange(len(words))
        w = words[at]
        if w.isalpha() and w.islower() and len(w) > 4:
            k = rng.randint(1, len(w) - 2)
            words[at] = rng.choice((w[:k] + w[k + 1 :], w[:k] + w[k] + w[k:], w[:k] + w[k + 1] + w[k] + w[k + 2 :]))
    return " ".join(words)


def test_join_equals_brute_force(spark):
    rng = random.Random(4)
    words = "alpha bravo candle delta echo foxtrot garden hotel india jungle kilo lemon motor november orange".split()
    names = [f"{a}{b}" for a in ("Nev", "Tor", "Zel", "Bri") for b in ("oten", "elin", "avik", "udash", "imint")]
    base = [" ".join(rng.choices(words, k=12)) + f" {rng.randint(1, 4)} for {rng.choice(names)} and {rng.choice(names)}" for _ in range(60)]
    dirty = lambda t: mistyped(rng, t, rng.randint(0, 3))
    val = [(i, rng.choice(base), dirty(rng.choice(base)), "a") for i in range(40)]
    train = [(100 + i, rng.choice(base), dirty(rng.choice(base)), "b") for i in range(80)] + [(500 + r[0], dirty(r[1]), dirty(r[2]), "c") for r in val]
    train += [(700 + r[0], r[1].lower(), r[2].upper(), "d") for r in val]  # names not to be seen
    want = brute(val, train)
    assert found(spark, val, train) == want and len(want) >= 60


def test_forms_without_numbers_and_names(spark):
    rng = random.Random(8)
    words = "walnut basket ladder mirror pepper saddle tunnel velvet window yellow anchor butter".split()
    base = [" ".join(rng.sample(words, 9)) for _ in range(25)]
    val = [(i, t, "so it stays there for good", "a") for i, t in enumerate(base)]
    train = [(100 + i, mistyped(rng, t, 2), "so it stays there for good", "b") for i, t in enumerate(base * 2)]
    want = brute(val, train)
    assert found(spark, val, train) == want and len(want) >= 40


@settings(max_examples=200, deadline=None)
@given(st.text("abc", max_size=30), st.text("abc", max_size=30), st.integers(0, 8))
def test_banded_distance(a, b, k):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    assert edits_within(a, b, k) == (row[-1] <= k)


def test_close():
    close = overlap._close
    assert close("shown", "shwon") == 1 and close("offers", "ofers") == 1 and close("left", "right") is None and close("word", "ward") is None and close("work", "eork") is None
    assert close("black", "block") is None and close("import", "export") is None and close("uncompressed", "compressed") is None and close("screen", "screex") is None and close("screen", "screem") == 1


def test_several_mistyped_rare_words(spark):
    text = lambda a, b, name="": (f"which part of the printed diagram {name} shows {a} next to {b}?", "it is drawn in the lower corner")
    for name in ("", "of Nevoten"):
        val = [(1, *text("lantern", "workbench", name), "a"), (2, *text("harbour", "meadow", name), "a"), (3, *text("violin", "cushion", name), "a")]
        train = [(10, *text("lantren", "wrokbench", name), "b"), (11, "name these words", "lantern workbench harbour meadow violin cushion all of them today", "b")]
        assert found(spark, val, train) == [(1, 10)]


def test_mistyped_articles_equal_brute_force(spark):
    answer = "It is red and stays there."
    assert found(spark, [(1, "What is the colour of the gauge needle?", answer, "a")], [(2, "What is teh colour of the gauge needle?", answer, "a")]) == [(1, 2)]
    rng = random.Random(7)
    words = "bolt crane drill engine funnel gasket hammer ingot jack lever".split()
    base = [f"What is the {a} of the {b} on the {c} for the figure" for a, b, c in (rng.sample(words, 3) for _ in range(12))]

    def dirty(t):
        out = t.split()
        for at in rng.sample(range(len(out)), 3):
            w = out[at]
            out[at] = {"the": "teh", "figure": "figrue"}.get(w, w[:-2] + w[-1] + w[-2] if len(w) > 4 else w)
        return " ".join(out)

    rows = lambda first, texts: [(first + i, t + "?", "It stays at 4 there.", "a") for i, t in enumerate(texts)]
    val, train = rows(0, base), rows(100, [dirty(t) for t in base * 4])
    want = brute(val, train)
    assert found(spark, val, train) == want and len(want) >= 12


def test_hashed_segments_and_windows_are_those_of_the_strings(spark):
    rng = random.Random(3)
    cases = []
    for n in range(20):
        text = "".join(rng.choices("abcdef ", k=rng.randint(1, 90)))
        cases.append((n, text, max(1, len(text) + rng.randint(-3, 3))))
    df = spark.createDataFrame(cases, "case long, form string, eval_length int").withColumn("key", F.lit(7).cast("long"))
    here = {r["case"]: set(r["h"]) for r in overlap._bounded(df, "length(form)").select("case", overlap._hashed_segments("key").alias("h")).collect()}
    there = {r["case"]: set(r["h"]) for r in overlap._bounded(df, "eval_length").select("case", overlap._hashed_windows("key").alias("h")).collect()}
    rows = [(c, 0, 7, len(t), i, s) for c, t, _ in cases for i, s in segments(t)] + [(c, 1, 7, n, i, s) for c, t, n in cases for i, s in windows(t, n)]
    want = {}
    for r in spark.createDataFrame(rows, "case long, side int, k long, n int, i int, s string").select("case", "side", F.xxhash64("k", "n", "i", "s").alias("h")).collect():
        want.setdefault((r["side"], r["case"]), set()).add(r["h"])
    assert all(here[c] == want[0, c] and there[c] == want.get((1, c), set()) for c, _, _ in cases)
