"""Same or near-same pairs across splits: edit-distance segment join, verified by banded dynamic programming.

A pair (question, answer) is brought into a canonical form: markup, case, punctuation, interjections at
the start and function words go, and so do instructions. What an instruction is, the corpus says: a
sentence of few words and no number that stands in one percent or more of the distinct questions.

Two pairs are the same if an edit distance of at most ``distance_bound`` lies between their forms and every
word that differs is explained: by a typing error, or by a word that the corpus uses interchangeably. A
typing error drops, doubles, adds or swaps letters or hits a neighbouring key, and leaves a word that is
rare beside the word meant. Words are interchangeable where otherwise equal pairs show one for the other,
and mostly for each other (learned from the candidates, at least ``LEAST_EVIDENCE`` distinct forms). Numbers
and names (capitalised words inside sentences) must be equal; words for colours, numbers, places and
negations are never interchangeable.

The join: evaluation forms are cut into k + 1 segments, one of which a form within k edits holds unchanged
at a place the edits allow; windows of training forms at those places meet them. Numbers and names are
equal in all pairs that count, so both sides are keyed by the numbers and the rarest name of one of them.
Equal forms are one class on either side, so copies never multiply work.

Defined cases: rows without question and answer match nothing; a null image equals no image; ties and
repeated rows are rows like any other; empty tables give no pairs; texts are compared whole. A row of
fewer than ten words equals none that has ``WORD_SLACK`` words more than that.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from tensorloom.llm.text import clean
from tensorloom.runtime import materialize, spread, union_all

#: Share of the distinct questions, and their number, from which a sentence is an instruction.
INSTRUCTION_SHARE, INSTRUCTION_LEAST, INSTRUCTION_WORDS = 0.01, 5, 8
#: Words of both texts from which the image does not matter, and how many more a row may have that equals one with fewer.
FULL_WORDS, WORD_SLACK = 10, 6
#: Edits between two forms that count as one, however long they are: bounds the windows of a long text.
MOST_EDITS = 24
#: Distinct evaluation forms that must show a word in place of another one, and the share of all its replacements.
LEAST_EVIDENCE, MOSTLY = 3, 0.5

# Interjections and labels before a text, function words, words for colours, numbers, places and negations.
_LEAD = re.compile(r"^(?:(?:now|hello|hi|hey|ok|okay|hint|please|note|well|so|dear all|task|question|bitte|hallo|bonjour|hola|por favor|s'il vous plaît|alsjeblieft)\s*[,:.!;–-]+\s*)+")
_EMPTY_WORDS = frozenset(
    "the a an is are was in of on at to for by and it its this that there please exactly just "
    "der die das den dem des ein eine ist im in am von zu und la le les l un une des du de à au est et en sur "
    "el los las una es y al del se het een van op te is".split()
)
_FACTS = frozenset(
    "yes no not never none nothing without ja nein nicht kein keine oui non pas sí si nee niet geen sim não tak nie "
    "zero one two three four five six seven eight nine ten eleven twelve first second third fourth fifth sixth seventh eighth ninth tenth last "
    "eins zwei drei vier fünf erste zweite dritte deux trois quatre cinq premier deuxième troisième dos tres cuatro cinco primero segundo tercero twee drie vier vijf eerste tweede derde "
    "black white red green blue yellow orange purple pink brown grey gray teal violet cyan magenta golden silver "
    "schwarz weiß rot grün blau gelb braun grau noir blanc rouge vert bleu jaune gris negro blanco rojo verde azul amarillo zwart wit rood groen blauw geel grijs "
    "left right top bottom upper lower above below under over before after inside outside north south east west front back middle centre center "
    "links rechts oben unten über unter gauche droite haut bas izquierda derecha arriba abajo boven onder".split()
)
_KEYS = ("qwertyuiop", "asdfghjkl", "zxcvbnm")
_TOKENS = re.compile(r"\d+(?:[.,]\d+)*|[^\W\d_]+(?:'[^\W\d_]+)*")
_SENTENCES = re.compile(r"(?<=[.!?])\s+|\n+")

_NEIGHBOURS = {frozenset(pair) for row in _KEYS for pair in zip(row, row[1:], strict=False)} | {
    frozenset((a, b)) for above, row in zip(_KEYS, _KEYS[1:], strict=False) for i, b in enumerate(row) for a in above[i : i + 2]
}


def _close(a: str, b: str) -> int | None:
    """Typing errors between two words: letters dropped, added or swapped, or a neighbouring key; None for different words.

    One error, or two where both words have eight letters or more; the first letter is never wrong.
    """
    short = min(len(a), len(b))
    most = 2 if short >= 8 else 1
    if abs(len(a) - len(b)) > most or short < 3 or a[0] != b[0]:
        return None
    before, row = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        older, before, row = before, row, [i] + [0] * len(b)
        for j, y in enumerate(b, 1):
            change = 0 if x == y else 1 if frozenset((x, y)) in _NEIGHBOURS else 2
            row[j] = min(before[j] + 1, row[j - 1] + 1, before[j - 1] + change)
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                row[j] = min(row[j], older[j - 2] + 1)
        if min(row) > most:
            return None
    return row[-1] if row[-1] <= most else None


def edits_within(a: str, b: str, k: int) -> bool:
    """Edit distance of at most ``k``: dynamic programming in a band of ``k`` around the diagonal."""
    if abs(len(a) - len(b)) > k:
        return False
    low, high = 0, min(len(a), len(b))
    while low < high and a[low] == b[low]:
        low += 1
    end = 0
    while end < high - low and a[-1 - end] == b[-1 - end]:
        end += 1
    a, b = a[low : len(a) - end], b[low : len(b) - end]
    if not a or not b:
        return len(a) + len(b) <= k
    big = k + 1
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        first, last = max(1, i - k), min(len(b), i + k)
        new = [big] * (len(b) + 1)
        new[0] = i
        best = i
        for j in range(first, last + 1):
            v = row[j - 1] if x == b[j - 1] else 1 + min(row[j - 1], row[j], new[j - 1])
            new[j] = v
            if v < best:
                best = v
        if best > k:
            return False
        row = new
    return row[-1] <= k


def distance_bound(length: int) -> int:
    """Edits allowed for an evaluation form of this length."""
    return min(MOST_EDITS, 3 + length // 12)


def cut(length: int, parts: int) -> list[tuple[int, int]]:
    """(start, size) of ``parts`` nearly equal segments of a string of this length."""
    size, longer = divmod(length, parts)
    out, at = [], 0
    for i in range(parts):
        n = size + (i >= parts - longer)
        out.append((at, n))
        at += n
    return out


def segments(text: str) -> list[tuple[int, str]]:
    return [(i, text[s : s + n]) for i, (s, n) in enumerate(cut(len(text), min(len(text), distance_bound(len(text)) + 1)))]


def windows(text: str, length: int) -> list[tuple[int, str]]:
    """Substrings of ``text`` that can be a segment of an evaluation string of ``length``."""
    k = distance_bound(length)
    delta = len(text) - length
    if abs(delta) > k or not length:
        return []
    parts = cut(length, min(length, k + 1))
    out = []
    for i, (start, n) in enumerate(parts):
        # before segment i at most i edits, after it at most k - i: both bound the shift
        low = max(0, start - i, start + delta - (k - i))
        high = min(len(text) - n, start + i, start + delta + (k - i))
        out += [(i, text[p : p + n]) for p in range(low, high + 1)]
    return list(dict.fromkeys(out))


def words_of(text: str) -> list[str]:
    return _TOKENS.findall(text)


def _plain(text: str | None) -> str:
    return clean(text).replace("’", "'").replace("‘", "'").lower().strip()


class Instructions:
    """Instructions the corpus knows, recognised with typing errors and dropped function words."""

    def __init__(self, sentences: list[str]):
        self.exact = frozenset(sentences)
        self.content = {tuple(w for w in s.split(" ") if w not in _EMPTY_WORDS) for s in sentences}
        self.lengths = sorted({s.count(" ") + 1 for s in sentences}, reverse=True)
        self.seen: dict[str, bool] = {}

    def holds(self, sentence: str) -> bool:
        """The sentence (plain words) is an instruction."""
        if sentence in self.exact:
            return True
        if sentence.count(" ") > INSTRUCTION_WORDS:
            return False
        known = self.seen.get(sentence)
        if known is None:
            if len(self.seen) > 50_000:
                self.seen.clear()
            got = [w for w in sentence.split(" ") if w not in _EMPTY_WORDS]
            known = self.seen[sentence] = bool(got) and any(
                len(own) == len(got) and all(a == b or _close(a, b) is not None for a, b in zip(got, own, strict=True)) for own in self.content
            )
        return known

    def without(self, sentences: list[list[str]]) -> list[str]:
        """Words of a question without its instructions; all of them where nothing else is left."""
        kept = [s for s in sentences if s and not self.holds(" ".join(s))]
        words = [w for s in kept for w in s]
        changed = True
        while changed:
            # not set off by punctuation
            changed = False
            for n in self.lengths:
                if len(words) > n and " ".join(words[-n:]) in self.exact:
                    words, changed = words[:-n], True
                if len(words) > n and " ".join(words[:n]) in self.exact:
                    words, changed = words[n:], True
        return words or [w for s in sentences for w in s]


def canonical(text: str | None, instructions: Instructions | None = None) -> tuple[list[str], int]:
    """Words of the canonical form, and how many words the text has without lead-ins and instructions."""
    s = _LEAD.sub("", _plain(text))
    if instructions is None:
        got = words_of(s)
    else:
        got = instructions.without([words_of(_LEAD.sub("", part)) for part in _SENTENCES.split(s)])
    out: list[str] = []
    for i, w in enumerate(got):
        if w[0].isdigit():
            out.append(w.replace(",", "."))
        elif w in ("no", "nr", "num", "n") and i + 1 < len(got) and got[i + 1][0].isdigit():
            out.append("number")
        elif w not in _EMPTY_WORDS:
            out.append(w)
    return out, len(got)


_NAME = re.compile(r"(?<![.!?\"“>\n])[ (\"“]([A-Z][^\W\d_]*[a-z])")


def names_of(text: str | None) -> list[str]:
    """Capitalised words inside sentences, in lower case; none for a text without case."""
    s = clean(text)
    if s.isupper() or s.islower():
        return []
    return [w.lower() for w in _NAME.findall(" ".join(s.split()))]


def _instruction_candidates(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = set()
        for text in batch["user"]:
            parts = [p for part in _SENTENCES.split(_plain(text)) if (p := " ".join(words_of(part)))]
            if len(parts) > 1:
                whole = " ".join(parts)
                rows.add(("", whole))
                rows |= {(p, whole) for p in parts if p.count(" ") < INSTRUCTION_WORDS and not any(c.isdigit() for c in p)}
        yield pd.DataFrame(sorted(rows), columns=["sentence", "whole"])


def known_instructions(questions: DataFrame) -> list[str]:
    """Short sentences without numbers in ``INSTRUCTION_SHARE`` of the distinct questions (``user``) of several sentences.

    There are at most as many as sentences in 1 / ``INSTRUCTION_SHARE`` questions, however many questions there are.
    """
    pairs = questions.select("user").where(F.col("user").isNotNull()).mapInPandas(_instruction_candidates, "sentence string, whole string")
    pairs = pairs.select("sentence", F.xxhash64("whole").alias("h")).distinct()
    counts = materialize(pairs.groupBy("sentence").count(), "instructions")
    total = counts.where("sentence = ''").select("count").first()
    least = max(INSTRUCTION_LEAST, int(INSTRUCTION_SHARE * (total[0] if total else 0)))
    return sorted(r[0] for r in counts.where((F.col("count") >= least) & (F.col("sentence") != "")).select("sentence").collect())


def explain(a: list[str], b: list[str], names: set[str]) -> list[tuple[str, str, bool]] | None:
    """Words that differ between two forms, as (word, word, typing error possible); None where that cannot be.

    Dynamic programming over words in a band of three. Only mistyped function words may stand on one side alone.
    """
    band, never = 3, 1 << 20
    if abs(len(a) - len(b)) > band:
        return None
    loose = lambda w: w not in names and _loose(w)
    # cost[i][d]: the first i words of a against the first i + d - band words of b
    width = 2 * band + 1
    cost = [[never] * width for _ in range(len(a) + 1)]
    for i, row in enumerate(cost):
        for d in range(width):
            j = i + d - band
            if not 0 <= j <= len(b):
                continue
            best = 0 if not i and not j else never
            if i and j and cost[i - 1][d] < never:
                best = min(best, cost[i - 1][d] + _change(a[i - 1], b[j - 1], names))
            if i and d + 1 < width and cost[i - 1][d + 1] + 2 < best and loose(a[i - 1]):
                best = cost[i - 1][d + 1] + 2
            if j and d and row[d - 1] + 2 < best and loose(b[j - 1]):
                best = row[d - 1] + 2
            row[d] = min(best, never)
        if min(row) >= never:
            return None
    i, j = len(a), len(b)
    if cost[i][j - i + band] >= never:
        return None
    out = []
    while i or j:
        d = j - i + band
        here = cost[i][d]
        if i and j and here == cost[i - 1][d] + (c := _change(a[i - 1], b[j - 1], names)):
            i, j = i - 1, j - 1
            if c:
                out.append((a[i], b[j], c == 1))
        elif i and d + 1 < width and here == cost[i - 1][d + 1] + 2 and loose(a[i - 1]):
            i -= 1
        else:
            j -= 1
    return out


def _change(a: str, b: str, names: set[str]) -> int:
    """0 for equal words, 1 for a possible typing error, 3 for two words, much more where a number or name changes."""
    if a == b:
        return 0
    if a in names or b in names or a == "|" or b == "|" or a[0].isdigit() or b[0].isdigit() or (a in _FACTS and b in _FACTS):
        return 1 << 20
    if _close(a, b) is not None:
        return 1
    return 1 << 20 if a in _FACTS or b in _FACTS else 3


@lru_cache(maxsize=100_000)
def _loose(word: str) -> bool:
    """A mistyped function word."""
    return word.isalpha() and len(word) <= 9 and any(_close(word, e) is not None for e in _EMPTY_WORDS if len(e) > 2)


_FORM = "side string, row_id string, image string, form string, numbers string, n_words int, names array<string>"


def forms(both: DataFrame, sentences: list[str]) -> DataFrame:
    """Canonical form of every row with a text: ``side, row_id, image, form, numbers, n_words, names``."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        instructions = Instructions(sentences)
        for batch in batches:
            out = []
            for side, row, question, answer, image in zip(*(batch[c] for c in ("side", "row_id", "user", "assistant", "image")), strict=True):
                q, n = canonical(question, instructions)
                a, m = canonical(answer)
                if n + m:
                    numbers = " ".join(w for w in q if w[0].isdigit()) + "|" + " ".join(w for w in a if w[0].isdigit())
                    there = {*q, *a}
                    names = [w for w in dict.fromkeys(names_of(question) + names_of(answer)) if w in there]
                    out.append((side, row, image, " ".join([*q, "|", *a]), numbers, n + m, names))
            yield pd.DataFrame(out, columns=["side", "row_id", "image", "form", "numbers", "n_words", "names"])

    return both.mapInPandas(read, _FORM)


def _verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = []
        for e, t, x, y, m, n in zip(*(batch[c] for c in ("eval_class", "train_class", "form_a", "form_b", "names_a", "names_b")), strict=True):
            if not edits_within(x, y, distance_bound(len(x))):
                continue
            found = explain(x.split(" "), y.split(" "), {*m, *n})
            if found is not None:
                out.append((e, t, [{"a": min(a, b), "b": max(a, b), "typo": typo} for a, b, typo in found]))
        yield pd.DataFrame(out, columns=["eval_class", "train_class", "changes"])


def _hashed_segments(block: str) -> F.Column:
    """Hashes of the k + 1 segments of ``form``, in the JVM (see ``segments``)."""
    return F.expr(
        f"""transform(sequence(0, parts - 1), i -> xxhash64({block}, length(form), i,
        substring(form, i * (length(form) div parts) + greatest(0, i - (parts - length(form) % parts)) + 1, length(form) div parts + if(i >= parts - length(form) % parts, 1, 0))))"""
    )


def _hashed_windows(block: str) -> F.Column:
    """Hashes of the windows of ``form`` for evaluation forms of ``eval_length`` (see ``windows``)."""
    start = "(i * (eval_length div parts) + greatest(0, i - (parts - eval_length % parts)))"
    size = "(eval_length div parts + if(i >= parts - eval_length % parts, 1, 0))"
    low = f"greatest(0, {start} - i, {start} + length(form) - eval_length - (k - i))"
    high = f"least(length(form) - {size}, {start} + i, {start} + length(form) - eval_length + (k - i))"
    return F.expr(
        f"""array_distinct(flatten(transform(sequence(0, parts - 1), i -> if({low} <= {high},
        transform(sequence({low}, greatest({low}, {high})), p -> xxhash64({block}, eval_length, i, substring(form, p + 1, {size}))), array()))))"""
    )


def _bounded(df: DataFrame, length: str) -> DataFrame:
    """Adds ``k`` and ``parts`` for forms of this length (see ``distance_bound``)."""
    return df.withColumn("k", F.expr(f"cast(least({MOST_EDITS}, 3 + {length} div 12) as int)")).withColumn("parts", F.expr(f"least(cast({length} as int), k + 1)"))


def _meeting(classes: DataFrame, other_names: DataFrame, route_own: int, route_other: int) -> DataFrame:
    """Keys under which a class can meet one of the other side: ``class_id, key``.

    A named class meets those that hold its rarest name (``route_own``); every class is met through its words by
    named ones (``route_other``); classes without names meet each other by their numbers alone.
    """
    own = classes.where("anchor is not null").select("class_id", F.xxhash64("block", F.lit(route_own), "anchor").alias("key"))
    bare = classes.where("anchor is null").select("class_id", F.xxhash64("block", F.lit(0)).alias("key"))
    words = classes.select("class_id", "block", F.explode(F.array_distinct(F.split("form", " "))).alias("word")).where(F.length("word") > 2)
    met = words.select("class_id", F.xxhash64("block", F.lit(route_other), "word").alias("key"))
    return own.unionByName(bare).unionByName(met.join(other_names, "key", "left_semi"))


def _candidates(e: DataFrame, t: DataFrame) -> DataFrame:
    """Pairs of classes that share a segment at an allowed place: ``eval_class, train_class``."""
    fields = ["class_id", "form"]
    anchored = lambda df, route: df.where("anchor is not null").select(F.xxhash64("block", F.lit(route), "anchor").alias("key")).distinct()
    e_keys = _meeting(e, anchored(t, 2), 1, 2)
    t_keys = _meeting(t, anchored(e, 1), 2, 1)
    with_form = e_keys.join(e.select(*fields), "class_id")
    lengths = with_form.select("key", F.length("form").alias("eval_length")).distinct()
    met = _bounded(t_keys.join(lengths, "key").join(t.select(*fields), "class_id"), "eval_length").where("abs(length(form) - eval_length) <= k")
    there = met.select(F.col("class_id").alias("train_class"), F.explode(_hashed_windows("key")).alias("h"))
    here = _bounded(with_form, "length(form)").select(F.col("class_id").alias("eval_class"), F.explode(_hashed_segments("key")).alias("h"))
    return here.join(there, "h").select("eval_class", "train_class").distinct()


@F.pandas_udf(BooleanType())
def _mistyped(seen: pd.Series, meant: pd.Series) -> pd.Series:
    return pd.Series([_close(a, b) is not None for a, b in zip(seen, meant, strict=True)], dtype=bool)


def _accepted(checked: DataFrame, words: DataFrame) -> DataFrame:
    """Pairs whose changed words are all typing errors or interchangeable: ``eval_class, train_class``.

    ``words``: the forms whose words are counted.
    """
    changed = checked.where("size(changes) > 0").select("eval_class", "train_class", F.size("changes").alias("n_changes"), F.explode("changes").alias("c")).select("*", "c.*").drop("c")
    asked = changed.select("a", "b", "typo").distinct()
    vocabulary = asked.select(F.col("a").alias("word")).unionByName(asked.select(F.col("b").alias("word"))).distinct()
    counts = words.select(F.explode(F.array_distinct(F.split("form", " "))).alias("word")).join(vocabulary, "word", "left_semi").groupBy("word").count()
    na, nb = (counts.select(F.col("word").alias(w), F.col("count").alias(f"n_{w}")) for w in "ab")
    rare = F.least("n_a", "n_b") <= F.greatest(F.lit(2), F.greatest("n_a", "n_b") / 20)
    asked = materialize(asked.join(na, "a").join(nb, "b").select("a", "b", "typo", "n_a", "n_b", (F.col("typo") & rare).alias("mistyped")), "asked")
    # a pair that differs in one word only, and not by a typing error, is evidence for the two words
    alone = changed.where("n_changes = 1").join(asked.where("not mistyped"), ["a", "b", "typo"], "left_semi").groupBy("a", "b").agg(F.countDistinct("eval_class").alias("n"))
    totals = alone.select(F.col("a").alias("w"), "n").unionByName(alone.select(F.col("b").alias("w"), "n")).groupBy("w").agg(F.sum("n").alias("total"))
    ta, tb = (totals.select(F.col("w").alias(w), F.col("total").alias(f"total_{w}")) for w in "ab")
    alike = alone.where(F.col("n") >= LEAST_EVIDENCE).join(ta, "a").join(tb, "b").where(F.col("n") >= MOSTLY * F.greatest("total_a", "total_b"))
    alike = alike.where(~F.col("a").isin(*sorted(_FACTS)) & ~F.col("b").isin(*sorted(_FACTS))).select("a", "b", F.lit(True).alias("alike"))
    alike = materialize(alike, "alike")
    known = asked.join(alike, ["a", "b"], "left").select("a", "b", "typo", (F.col("mistyped") | F.coalesce("alike", F.lit(False))).alias("fine"))
    # a mistyped form of an interchangeable word
    both = alike.select(F.col("a").alias("word"), F.col("b").alias("other")).unionByName(alike.select(F.col("b").alias("word"), F.col("a").alias("other")))
    open_ = known.where("not fine").select("a", "b", "typo").join(asked.where(F.least("n_a", "n_b") <= 2).select("a", "b", "typo"), ["a", "b", "typo"])
    meant = open_.join(both, F.col("b") == F.col("word")).select("a", "b", "typo", F.col("a").alias("seen"), "other").unionByName(open_.join(both, F.col("a") == F.col("word")).select("a", "b", "typo", F.col("b").alias("seen"), "other"))
    meant = meant.where(_mistyped("seen", "other")).select("a", "b", "typo").distinct()
    known = known.where("fine").select("a", "b", "typo").unionByName(meant).withColumn("fine", F.lit(True))
    verdict = changed.join(known, ["a", "b", "typo"], "left").groupBy("eval_class", "train_class").agg(F.bool_and(F.coalesce("fine", F.lit(False))).alias("fine"))
    return checked.where("size(changes) = 0").select("eval_class", "train_class").unionByName(verdict.where("fine").select("eval_class", "train_class"))


def same_classes(evaluation: DataFrame, training: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Pairs of same classes (``eval_class, train_class``) and the rows of each side's classes (``class_id, row_id``).

    Rows of ten words or more form classes by their form alone; rows of fewer count with their image only, so they
    form classes of form and image, and meet rows of the same image that have a few function words more.
    """
    both = union_all([df.select(F.lit(side).alias("side"), F.col("row_id").cast("string").alias("row_id"), "user", "assistant", "image") for side, df in (("eval", evaluation), ("train", training))])
    both = spread(both)
    formed = forms(both, known_instructions(both)).withColumn("short", F.col("n_words") < FULL_WORDS)
    digest = lambda *c: F.unhex(F.md5(F.concat_ws("\0", *c).cast("binary")))
    full = F.when(~F.col("short"), F.struct(digest("form").alias("class_id"), F.lit(None).cast("string").alias("image"), F.lit(False).alias("short")))
    near = F.when((F.col("n_words") < FULL_WORDS + WORD_SLACK) & F.col("image").isNotNull(), F.struct(digest("form", "image", F.col("short").cast("string")).alias("class_id"), "image", "short"))
    placed = formed.select("side", "row_id", "form", "numbers", "names", F.explode(F.array_compact(F.array(full, near))).alias("c"))
    rows = materialize(placed.select("side", "row_id", "form", "names", "c.*", F.xxhash64("numbers", "c.image").alias("block")), "forms")
    # only forms whose numbers occur among the evaluation rows can match
    mine = rows.join(rows.where("side = 'eval'").select("block").distinct(), "block", "left_semi")
    # an upper-case copy shows no names, its equals may: one form has few words, so few names
    names = F.array_sort(F.array_distinct(F.flatten(F.collect_set("names")))).alias("names")
    grouped = materialize(mine.groupBy("side", "class_id").agg(F.first("form").alias("form"), F.first("block").alias("block"), F.first("short").alias("short"), names), "grouped")
    named = grouped.select("side", "class_id", F.explode("names").alias("name")).where((F.length("name") > 2) & ~F.col("name").isin(*sorted(_EMPTY_WORDS)))
    often = named.groupBy("name").agg(F.count("*").alias("often"))
    rarest = named.join(often, "name").groupBy("side", "class_id").agg(F.min(F.struct("often", "name"))["name"].alias("anchor"))
    classes = materialize(grouped.join(rarest, ["side", "class_id"], "left"), "classes")
    e, t = (classes.where(F.col("side") == side).drop("side") for side in ("eval", "train"))
    a = e.select(F.col("class_id").alias("eval_class"), F.col("form").alias("form_a"), F.col("names").alias("names_a"), F.col("short").alias("short_a"))
    b = t.select(F.col("class_id").alias("train_class"), F.col("form").alias("form_b"), F.col("names").alias("names_b"), F.col("short").alias("short_b"))
    met = _candidates(e, t).join(a, "eval_class").join(b, "train_class")
    # longer rows of one image have their own class without it
    with_image = F.col("eval_class") != F.unhex(F.md5(F.col("form_a").cast("binary")))
    met = met.where(~with_image | F.col("short_a") | F.col("short_b"))
    checked = materialize(met.mapInPandas(_verify, "eval_class binary, train_class binary, changes array<struct<a:string,b:string,typo:boolean>>"), "checked")
    members = lambda side: rows.where(F.col("side") == side).select("class_id", "row_id")
    return _accepted(checked, classes.select("form").distinct()), members("eval"), members("train")


def near_pairs(evaluation: DataFrame, training: DataFrame) -> DataFrame:
    """Pairs of rows with the same question and answer: ``eval_id, train_id``.

    Both tables: ``row_id, user, assistant, image``. Pairs of fewer than ten words need the same image.
    """
    same, e, t = same_classes(evaluation, training)
    pairs = same.join(e.toDF("eval_class", "eval_id"), "eval_class").join(t.toDF("train_class", "train_id"), "train_class")
    return pairs.select(
        F.col("eval_id").cast(evaluation.schema["row_id"].dataType).alias("eval_id"), F.col("train_id").cast(training.schema["row_id"].dataType).alias("train_id")
    )


def linked_rows(evaluation: DataFrame, training: DataFrame) -> DataFrame:
    """One row per evaluation row that has the same training rows, without expanding pairs: ``row_id, class_id, n_links``."""
    same, e, t = same_classes(evaluation, training)
    sizes = t.groupBy("class_id").agg(F.count("*").alias("n")).withColumnRenamed("class_id", "train_class")
    links = same.join(sizes, "train_class").groupBy("eval_class").agg(F.sum("n").alias("n_links"))
    each = e.join(links, e["class_id"] == links["eval_class"]).groupBy("row_id").agg(F.min(F.hex("class_id")).alias("class_id"), F.sum("n_links").alias("n_links"))
    return each.withColumn("row_id", F.col("row_id").cast(evaluation.schema["row_id"].dataType))
