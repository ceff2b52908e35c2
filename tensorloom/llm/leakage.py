"""Evaluation passages in training texts: broadcast n-gram set, window scan, verification by edit distance.

Texts are read as plain words: case, punctuation, markup, line breaks (hyphenated ones too) and
invisible characters do not count. The n-grams of the evaluation items, instruction sentences that
several items share left out, are broadcast in blocks of bounded size; every document is scanned once
per block. A passage counts if at least ``least`` words of an item stand in the document in order, with
at most one word in six changed, added or dropped, and most of the words that set the item apart from
the others intact (or none of them in it, or a run of ``least`` words unchanged). Such a passage always holds an unchanged run of four
words, so the scan misses none. Each run is followed to both sides edit by edit, as far as the words agree.

Defined cases: null and empty texts hold nothing; repeated items and documents each count; very long
texts are scanned whole; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import html
import itertools
import re
import unicodedata
import uuid
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tensorloom.llm.text import _INVISIBLE, _TAG
from tensorloom.runtime import materialize, spread, union_all

GRAM = 4
#: Words of evaluation items in one broadcast block (about 100 bytes each in the gram index).
BLOCK_WORDS = 400_000

_BREAK = re.compile(r"(?<=\w)[-‐]( *\r?\n[ \t>|*]*)(?=\w)")
_DASH = re.compile("[–—―/|]")
_CHUNK = re.compile(r"\S+")
_NOISE = re.compile(r"[\W_]+")
_SENTENCE = re.compile(r"(?<=[.!?…:])\s+|\n{2,}")


def located_words(text: str | None) -> list[tuple[str, int, int]]:
    """Plain words with their place in the text."""
    if not text:
        return []
    s = _DASH.sub(" ", _TAG.sub(lambda m: " " * len(m.group()), text) if "<" in text else text)
    # a hyphen at a line's end joins the halves: both are marked by characters that are dropped below
    s = _BREAK.sub(lambda m: "\x00" * len(m.group()), s)
    out = []
    for m in _CHUNK.finditer(s):
        w = m.group()
        if "&" in w:
            w = html.unescape(w)
        if not w.isascii():
            w = _INVISIBLE.sub("", unicodedata.normalize("NFKC", w))
        w = _NOISE.sub("", w).lower()
        if w:
            out.append((w, m.start(), m.end()))
    return out


def plain_words(text: str | None) -> list[str]:
    return [w for w, _, _ in located_words(text)]


def _sentences(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for item, text in zip(batch["item_id"], batch["text"], strict=True):
            for n, part in enumerate(_SENTENCE.split(text or "")):
                w = plain_words(part)
                if w:
                    rows.append((item, n, " ".join(w)))
        yield pd.DataFrame(rows, columns=["item_id", "n", "sentence"])


def item_sentences(items: DataFrame, shared_by: int) -> DataFrame:
    """Sentences of the items as plain words, without those that ``shared_by`` items or more have in common."""
    parts = items.select(F.col("item_id").cast("string").alias("item_id"), "text").mapInPandas(_sentences, "item_id string, n int, sentence string")
    shared = parts.groupBy("sentence").agg(F.countDistinct("item_id").alias("items")).where(F.col("items") >= shared_by).select("sentence")
    return parts.join(shared, "sentence", "left_anti").select("item_id", "n", "sentence")


def common_words(sentences: DataFrame) -> frozenset[str]:
    """Words of more than 1 % of the distinct item texts (and more than three): at most a hundred times the mean number of words of a text."""
    texts = sentences.groupBy("item_id").agg(F.sort_array(F.collect_list(F.struct("n", "sentence"))).alias("parts")).select(F.col("parts.sentence").alias("parts")).distinct()
    few = max(3, texts.count() // 100)
    words = texts.select(F.explode(F.array_distinct(F.split(F.array_join("parts", " "), " "))).alias("word"))
    return frozenset(r["word"] for r in words.groupBy("word").count().where(F.col("count") > few).collect())


#: Edits to either side of an unchanged run up to which a passage is followed at once; neighbouring passages are joined.
MOST_EDITS = 40


def reaches(item: list[str], doc: list[str], most: int) -> list[tuple[int, int, tuple[int, ...]] | None]:
    """For 0, 1, ... ``most`` edits: how far two word lists agree from their beginnings, the last words being equal.

    (item words, document words, places of edited item words), furthest in the item; None where no stretch with so
    many edits ends on equal words. Furthest reaching points by diagonal: each edit starts from those of one edit less.
    """
    n, m = len(item), len(doc)
    i = 0
    while i < n and i < m and item[i] == doc[i]:
        i += 1
    points: dict[int, tuple[int, tuple[int, ...]]] = {0: (i, ())}
    out: list[tuple[int, int, tuple[int, ...]] | None] = [(i, i, ())]
    for e in range(1, most + 1):
        new: dict[int, tuple[int, tuple[int, ...]]] = {}
        best = None
        for d in range(-e, e + 1):
            at = None
            # changed, dropped (the item is a word ahead), added (the document is), or no further edit
            for old, step in ((d, 1), (d - 1, 1), (d + 1, 0), (d, 0)):
                p = points.get(old)
                if p is None:
                    continue
                # where a text is at its end, an edit a word before it leads here
                i = min(p[0] + step, n, m + d)
                if i >= max(0, d) and (at is None or i > at[0]):
                    at = (i, p[1] + (i - 1,) if step and i else p[1])
            if at is None:
                continue
            i = at[0]
            while i < n and i - d < m and item[i] == doc[i - d]:
                i += 1
            new[d] = (i, at[1])
            # all points of a diagonal before the furthest one are reached as well: the last with equal words
            while i > 0 and i - d > 0 and item[i - 1] != doc[i - d - 1]:
                i -= 1
            if i > 0 and i - d > 0 and (best is None or i > best[0]):
                best = (i, i - d, tuple(p for p in at[1] if p < i))
        out.append(best)
        if not new:
            break
        points = new
    return out


class Index:
    """n-grams of the sentences of a block of items; ``common`` words do not set an item apart."""

    def __init__(self, sentences: list[tuple[str, int, str]], common: frozenset[str]):
        self.items: dict[str, list[str]] = {}
        self.grams: dict[str, list[tuple[str, int]]] = defaultdict(list)
        last: dict[str, int] = {}
        for item, n, sentence in sorted(sentences):
            words = self.items.setdefault(item, [])
            if item in last and n != last[item] + 1:
                words.append("\x01")  # a sentence between was left out: nothing runs across
            words += sentence.split(" ")
            last[item] = n
        self.marks = {item: [w != "\x01" and w not in common for w in words] for item, words in self.items.items()}
        self.marked = {item: [0, *itertools.accumulate(int(m) for m in marks)] for item, marks in self.marks.items()}
        for item, words in self.items.items():
            for k in range(len(words) - GRAM + 1):
                gram = words[k : k + GRAM]
                if "\x01" not in gram:
                    self.grams[" ".join(gram)].append((item, k))

    def scan(self, doc: list[str], least: int) -> list[tuple[str, int, int, int]]:
        """(item, words, first, last position) of every item with a passage in the document."""
        hits: dict[str, list[tuple[int, int]]] = defaultdict(list)
        grams = self.grams
        for j in range(len(doc) - GRAM + 1):
            found = grams.get(" ".join(doc[j : j + GRAM]))
            if found:
                for item, k in found:
                    hits[item].append((j, k))
        out = []
        for item, places in hits.items():
            spans: list[list[int]] = []
            for j, k, length in _runs(places):
                # a run inside a passage that was found belongs to it
                if spans and spans[-1][0] <= j and j + length - 1 <= spans[-1][1]:
                    continue
                found = self._passage(item, doc, j, k, length, least)
                if found and spans and found[0] <= spans[-1][1] + 30:
                    first, last, words = spans[-1]
                    new = found[2] if found[0] > last else max(0, found[1] - last)
                    spans[-1] = [min(first, found[0]), max(last, found[1]), words + new]
                elif found:
                    spans.append(list(found))
            if spans:
                first, last, words = max(spans, key=lambda x: x[2])
                out.append((item, words, first, last))
        return out

    def _passage(self, item: str, doc: list[str], j: int, k: int, length: int, least: int) -> tuple[int, int, int] | None:
        """First and last document position and item words of the longest passage around an unchanged run, None without one."""
        words, known = self.items[item], self.marked[item]
        marks = self.marks[item]
        most = min(MOST_EDITS, (len(words) + 1) // 6)
        room = len(words) + most
        if length < least and not self._possible(item, doc[max(0, j - room) : j + length + room], k, length, least):
            return None
        right = reaches(words[k + length :], doc[j + length : j + length + room], most)
        left = reaches(words[:k][::-1], doc[max(0, j - room) : j][::-1], most)
        best = (j, j + length - 1, length) if length >= least else None
        for e, a in enumerate(left):
            for f, b in enumerate(right):
                if a is None or b is None:
                    continue
                total = a[0] + length + b[0]
                if total < least or (e + f) * 6 > total + 1 or (best and total <= best[2]):
                    continue
                own = known[k + length + b[0]] - known[k - a[0]]
                lost = sum(marks[k - 1 - p] for p in a[2]) + sum(marks[k + length + p] for p in b[2])
                if not own or (own - lost) * 2 > own:
                    best = (j - a[1], j + length + b[1] - 1, total)
        return best


    def _possible(self, item: str, window: list[str], k: int, length: int, least: int) -> bool:
        """Whether a passage around a run can hold enough words, and words that set the item apart: cheap and never wrong when it says no."""
        words, marks = self.items[item], self.marks[item]
        needed = least - (least + 1) // 6
        there = set(window)
        if sum(w in there for w in words) < needed:
            return False
        if not any(m and w in there for w, m in zip(words, marks, strict=True)):
            # then the passage has no such word at all: the run lies in a stretch of ``least`` words without any
            first, last = k, k + length
            while first and not marks[first - 1]:
                first -= 1
            while last < len(words) and not marks[last]:
                last += 1
            if last - first < least or any(marks[k : k + length]):
                return False
        return common_in_order(words, window) >= needed


def common_in_order(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, by bits of one integer."""
    masks: dict[str, int] = {}
    for k, w in enumerate(a):
        masks[w] = masks.get(w, 0) | 1 << k
    full = left = (1 << len(a)) - 1
    for w in b:
        m = masks.get(w)
        if m:
            u = left & m
            left = ((left + u) | (left - u)) & full
    return len(a) - left.bit_count()


def _runs(places: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """Unchanged runs as (document position, item position, words), from the n-grams that agree; in order of the document."""
    runs: dict[tuple[int, int], list[int]] = {}
    out = []
    for j, k in places:
        run = runs.pop((j - 1, k - 1), None)
        if run is None:
            run = [j, k, GRAM - 1]
            out.append(run)
        run[2] += 1
        runs[j, k] = run
    return [tuple(r) for r in out]


FOUND = "doc_id string, item_id string, n_words int, first_char int, last_char int"

_indexes: dict[str, Index] = {}


def _index(token: str, sentences, common) -> Index:
    """Index of a broadcast block, built once per Python process."""
    if token not in _indexes:
        _indexes.clear()  # one block at a time
        _indexes[token] = Index(sentences.value, common.value)
    return _indexes[token]


def find_leaks(documents: DataFrame, items: DataFrame, least: int = 14, shared_by: int = 5) -> DataFrame:
    """Documents (``doc_id, text``) with a passage of an item (``item_id, text``).

    Returns ``doc_id, item_id, n_words, first_char, last_char``: the longest passage of each item.
    """
    spark = documents.sparkSession
    sentences = materialize(item_sentences(items, shared_by), "sentences")
    total = sentences.agg(F.coalesce(F.sum(F.size(F.split("sentence", " "))), F.lit(0))).first()[0]
    blocks = max(1, -(-total // BLOCK_WORDS))
    texts = spread(documents.select(F.col("doc_id").cast("string").alias("doc_id"), "text").where(F.col("text").isNotNull()))
    common = spark.sparkContext.broadcast(common_words(sentences))
    parts = []
    for block in range(blocks):
        chosen = sentences.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block)
        shared = spark.sparkContext.broadcast([tuple(r) for r in chosen.collect()])  # BLOCK_WORDS words or so

        def scan(batches: Iterator[pd.DataFrame], shared=shared, common=common, token=uuid.uuid4().hex) -> Iterator[pd.DataFrame]:
            index = _index(token, shared, common)
            for batch in batches:
                rows = []
                for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                    located = located_words(text)
                    for item, n, a, b in index.scan([w for w, _, _ in located], least):
                        rows.append((doc_id, item, n, located[a][1], located[b][2]))
                yield pd.DataFrame(rows, columns=["doc_id", "item_id", "n_words", "first_char", "last_char"])

        parts.append(texts.mapInPandas(scan, FOUND))
    doc, item = documents.schema["doc_id"].dataType, items.schema["item_id"].dataType
    return union_all(parts).withColumns({"doc_id": F.col("doc_id").cast(doc), "item_id": F.col("item_id").cast(item)})


def remove_leaks(documents: DataFrame, leaks: DataFrame, drop_share: float = 0.5) -> DataFrame:
    """Documents without leaked passages: ``doc_id, text, action`` (kept, cut or dropped with a null text).

    A document is dropped where passages cover ``drop_share`` of it or more. Overlapping passages count once.
    """
    # the number of passages of one document is bounded by the items it holds
    spans = leaks.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("first_char", "last_char"))).alias("_spans"))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts, actions = [], []
            for text, found in zip(batch["text"], batch["_spans"], strict=True):
                if text is None or found is None or len(found) == 0:
                    texts.append(text)
                    actions.append("kept")
                    continue
                kept, at, gone = [], 0, 0
                for span in found:
                    a, b = span["first_char"], span["last_char"]
                    if a > at:
                        kept.append(text[at:a])
                    gone += max(0, b - max(a, at))
                    at = max(at, b)
                kept.append(text[at:])
                dropped = gone >= drop_share * len(text)
                texts.append(None if dropped else "".join(kept))
                actions.append("dropped" if dropped else "cut")
            yield pd.DataFrame({"doc_id": batch["doc_id"], "text": texts, "action": actions})

    joined = documents.select("doc_id", "text").join(spans, "doc_id", "left").withColumn("doc_id", F.col("doc_id").cast("string"))
    return joined.mapInPandas(cut, "doc_id string, text string, action string").withColumn("doc_id", F.col("doc_id").cast(documents.schema["doc_id"].dataType))
