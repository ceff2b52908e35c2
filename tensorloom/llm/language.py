"""Languages of documents and of their segments by rank-order n-gram profiles.

A profile is the ranked list of the most frequent letter n-grams (1 to 5 letters, word ends marked) and
words of a language. A segment's own ranked n-grams are compared with every profile by the out-of-place
distance: the sum of rank differences, with a fixed penalty for n-grams a profile lacks. Profiles are
fitted on a bounded sample of labelled documents: labels may be wrong, so a second fit leaves out what
the first one assigns elsewhere.

A segment is a sentence outside quotation marks, headings, tables and code. Neighbouring sentences of
one language are joined; a document gets every language in which it has at least one full sentence, and
a confidence: the relative distance between the best and the second profile, weighted by length.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tensorloom.llm.text import clean
from tensorloom.runtime import spread

#: Documents a language's profile is fitted on at most, and n-grams a profile keeps.
SAMPLE_PER_LANGUAGE = 200
PROFILE_SIZE = 1200
#: Lead (as confidence) below which a sentence may follow the rest of its document.
CLEAR_LEAD = 0.5

# Names and codes of the eight languages.
LABELS = {
    "en": ("en", "eng", "english", "englisch"),
    "de": ("de", "deu", "ger", "german", "deutsch"),
    "fr": ("fr", "fra", "fre", "french", "français", "francais"),
    "es": ("es", "spa", "spanish", "español", "espanol", "castellano"),
    "pt": ("pt", "por", "portuguese", "português", "portugues"),
    "nl": ("nl", "nld", "dut", "dutch", "nederlands"),
    "pl": ("pl", "pol", "polish", "polski"),
    "ru": ("ru", "rus", "russian", "русский"),
}
_CODE_OF = {name: code for code, names in LABELS.items() for name in names}

_CODE = re.compile(r"```.*?```|`[^`\n]*`", re.S)
_QUOTE = re.compile(r"\"[^\"\n]{0,300}\"|“[^”\n]{0,300}”|„[^“”\n]{0,300}[“”]|«[^»\n]{0,300}»|‘[^’\n]{0,300}’")
_SPLIT = re.compile(r"(?<=[.!?…])[\"'”’»)\]]*\s+|\n+")
_LETTERS = re.compile(r"[^\W\d_]+(?:['’\-][^\W\d_]+)*")
_EDGE = ".,;:!?…()[]{}*_'\"’‘“”„«»¿¡–—-"
#: A line break inside a quoted block; group 1: the hyphen of a broken word.
_WRAPPED = re.compile(r"(-)?[ \t]*\n>[ \t]*(?=\S)")
_PREFIX = re.compile(r"^(?:\[[\d:.\s]+\]|[>*\-•#|]+|\d+[.)])\s*")


def label_code(label: Column) -> Column:
    """Two-letter code of a label in any notation; null for placeholders and unknown labels."""
    base = F.regexp_extract(F.lower(F.trim(label)), r"^(\p{L}+)(?:[-_].*)?$", 1)
    pairs = [F.lit(x) for name, code in _CODE_OF.items() for x in (name, code)]
    return F.element_at(F.create_map(*pairs), F.when(base != "", base))


def sentences(text: str | None) -> list[tuple[int, str]]:
    """Full sentences with the number of their line: outside quotes, headings, tables and code.

    A full sentence has at least four words, three of them not names, and words make up most of it.
    """
    if not text:
        return []
    s = _CODE.sub(" ", clean(text))
    s = _WRAPPED.sub(lambda m: "" if m.group(1) else " ", s)
    out = []
    for n, line in enumerate(s.split("\n")):
        line = line.strip()
        if not line or line[0] == "#" or "|" in line:
            continue
        line = _PREFIX.sub("", line)
        for part in _SPLIT.split(_QUOTE.sub(" ", line)):
            tokens = part.split()
            words = [w for t in tokens if (w := t.strip(_EDGE)) and _LETTERS.fullmatch(w)]
            if len(words) < 4 or 3 * len(words) < 2 * len(tokens):
                continue
            if sum(not w[0].isupper() for w in words) < 3 and not part.isupper():
                continue
            out.append((n, part.strip()))
    return out


@lru_cache(maxsize=100_000)
def _word_grams(word: str) -> tuple[str, ...]:
    padded = f"_{word}_"
    size = len(padded)
    found = [padded[i : i + n] for n in (1, 2, 3, 4, 5) for i in range(size - n + 1)]
    if size > 5:
        found.append(padded)
    return tuple(g for g in found if g != "_")


def spoken_words(text: str) -> list[str]:
    """Words in lower case, without those that begin with a capital inside the sentence (names tell no language)."""
    words = _LETTERS.findall(text)
    if sum(w[0].isupper() for w in words) >= 0.6 * len(words):
        return [w.lower() for w in words]
    return [w.lower() for k, w in enumerate(words) if not k or not w[0].isupper()]


def ranked(counts: Counter, size: int) -> dict[str, int]:
    """Rank of each of the most frequent n-grams; ties by alphabet."""
    return {g: r for r, (g, _) in enumerate(sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:size])}


class Profiles:
    """Ranked n-grams of every language, as one table of ranks by n-gram and language."""

    def __init__(self, texts: dict[str, list[str]], size: int = PROFILE_SIZE):
        self.size = size
        self.languages = sorted(texts)
        per = []
        for lang in self.languages:
            counts: Counter = Counter()
            for t in texts[lang]:
                for w in spoken_words(t):
                    counts.update(_word_grams(w))
            per.append(ranked(counts, size))
        known = sorted(set().union(*per)) if per else []
        self.index = {g: i for i, g in enumerate(known, 1)}
        #: ranks; row 0 and languages without the n-gram get the penalty
        self.table = np.full((len(known) + 1, len(self.languages)), size, dtype=np.float64)
        for k, ranks in enumerate(per):
            for g, r in ranks.items():
                self.table[self.index[g], k] = r
        self.cache: dict[str, np.ndarray] = {}

    def _ids(self, word: str) -> np.ndarray:
        ids = self.cache.get(word)
        if ids is None:
            if len(self.cache) > 100_000:
                self.cache.clear()
            ids = self.cache[word] = np.array([self.index.get(g, 0) for g in _word_grams(word)], dtype=np.int64)
        return ids

    def distances_of(self, texts: list[list[str]]) -> np.ndarray:
        """Mean out-of-place distances (0 to 1) of word lists to every profile; a row of each list, NaN without n-grams.

        All n-grams of a text are ranked, ties by n-gram. Equal lists are compared once; lists are taken together in
        chunks of some 10^5 n-grams, so the arrays stay small however long the texts are.
        """
        place: dict[tuple[str, ...], int] = {}
        at = [place.setdefault(tuple(words), len(place)) for words in texts]
        out = np.full((len(place), len(self.languages)), np.nan)
        waiting: list[tuple[int, np.ndarray]] = []
        size = 0
        for words, k in place.items():
            if not words or not self.languages:
                continue
            waiting.append((k, np.concatenate([self._ids(w) for w in words])))
            size += len(waiting[-1][1])
            if size > 100_000:
                self._fill(out, waiting)
                waiting, size = [], 0
        if waiting:
            self._fill(out, waiting)
        return out[at] if at else out

    def _fill(self, out: np.ndarray, waiting: list[tuple[int, np.ndarray]]) -> None:
        step = len(self.table)
        owner = np.repeat(np.arange(len(waiting)), [len(ids) for _, ids in waiting])
        keys, counts = np.unique(owner * step + np.concatenate([ids for _, ids in waiting]), return_counts=True)
        owner, ids = np.divmod(keys, step)
        order = np.lexsort((ids, -counts, owner))
        owner, ids = owner[order], ids[order]
        begins = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
        lengths = np.diff(np.append(begins, len(owner)))
        ranks = (np.arange(len(owner)) - np.repeat(begins, lengths)) * (self.size / np.repeat(lengths, lengths))
        known = self.table[ids]
        away = np.minimum(np.abs(known - ranks[:, None]), self.size)
        away[known >= self.size] = self.size
        out[[k for k, _ in waiting]] = np.add.reduceat(away, begins, axis=0) / lengths[:, None] / self.size

    def distances(self, text: str) -> list[float] | None:
        """Mean out-of-place distance of a text to every profile, 0 to 1; None without n-grams."""
        found = self.distances_of([spoken_words(text)])[0]
        return None if not len(found) or np.isnan(found[0]) else found.tolist()

    def language(self, text: str) -> tuple[str, float] | None:
        """Language and confidence (0 to 1: lead over the second profile)."""
        d = self.distances(text)
        if d is None:
            return None
        order, lead = _choice(d)
        return self.languages[order[0]], lead


def _choice(d: list[float]) -> tuple[list[int], float]:
    """Languages by distance, and the lead of the first as confidence."""
    order = sorted(range(len(d)), key=d.__getitem__)
    return order, 1.0 if len(order) == 1 else min(1.0, 4 * (d[order[1]] - d[order[0]]) / max(d[order[1]], 1e-9))


def fit_profiles(documents: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE) -> Profiles:
    """Profiles from a sample of at most ``per_language`` labelled documents of each language.

    The sample is the same for the same documents: it is chosen by a hash of the text.
    """
    labelled = documents.select(label_code(F.col("lang")).alias("code"), "text").where(F.col("code").isNotNull() & F.col("text").isNotNull())
    counts = {r["code"]: r["count"] for r in labelled.groupBy("code").count().collect()}  # one row per language
    # texts of the least hashes: four times the sample by a bound on the hash, copies made one, then the first of them
    share = F.lit(0.0)
    for code, n in counts.items():
        share = F.when(F.col("code") == code, F.lit(min(1.0, 4 * per_language / n))).otherwise(share)
    few = labelled.withColumn("_h", F.xxhash64("text")).where(F.col("_h") / F.lit(2.0**64) + 0.5 <= share).groupBy("code", "_h").agg(F.min("text").alias("text"))
    chosen = few.withColumn("_n", F.row_number().over(Window.partitionBy("code").orderBy("_h"))).where(F.col("_n") <= per_language)
    taken: dict[str, list[tuple[int, str]]] = {}
    for r in chosen.collect():  # at most ``per_language`` texts of each language
        taken.setdefault(r["code"], []).append((r["_h"], r["text"]))
    texts = {code: [s for _, t in sorted(rows)[:per_language] for _, s in sentences(t)] for code, rows in taken.items()}
    texts = {code: s for code, s in texts.items() if s}
    first = Profiles(texts)
    own = {code: [s for s in lines if (got := first.language(s)) and got[0] == code] for code, lines in texts.items()}
    return Profiles({code: s for code, s in own.items() if s} or texts)


def segments(text: str | None, profiles: Profiles) -> list[tuple[int, str, float, int]]:
    """Segments of a document: (number, language, confidence, letters), neighbours of one language joined.

    A single sentence without clear lead takes the main language of its document if that is hardly farther.
    """
    return segments_of([text], profiles)[0]


def segments_of(texts: list[str | None], profiles: Profiles) -> list[list[tuple[int, str, float, int]]]:
    """``segments`` of many documents, their sentences compared together."""
    parts = [[s for _, s in sentences(text)] for text in texts]
    found = profiles.distances_of([spoken_words(s) for own in parts for s in own])
    out, at = [], 0
    for own in parts:
        rows = found[at : at + len(own)].tolist()
        at += len(own)
        out.append(_joined([(*_choice(d), len(s), d) for s, d in zip(own, rows, strict=True) if d and d[0] == d[0]], profiles))
    return out


def _joined(judged: list[tuple[list[int], float, int, list[float]]], profiles: Profiles) -> list[tuple[int, str, float, int]]:
    if not judged:
        return []
    seen = Counter(order[0] for order, _, _, _ in judged)
    main = max(seen, key=lambda k: (seen[k], -k))
    out: list[list] = []
    for order, lead, size, d in judged:
        best = order[0]
        if best != main and seen[main] >= 3 and lead < (CLEAR_LEAD if seen[best] == 1 else CLEAR_LEAD / 5) and d[main] - d[best] <= CLEAR_LEAD / 4 * d[main]:
            best, lead = main, lead / 2
        if out and out[-1][0] == best:
            out[-1][1] += lead * size
            out[-1][2] += size
        else:
            out.append([best, lead * size, size])
    return [(n, profiles.languages[k], round(total / size, 4), size) for n, (k, total, size) in enumerate(out)]


SEGMENTS = "doc_id string, segment int, language string, confidence double, letters int"


def document_segments(documents: DataFrame, profiles: Profiles) -> DataFrame:
    """Language segments of every document (``doc_id, text``).

    Defined cases: null and empty texts, and texts without any full sentence, have no segment; repeated
    documents are judged each for itself; very long texts are read whole.
    """
    shared = documents.sparkSession.sparkContext.broadcast(profiles)  # languages x PROFILE_SIZE n-grams

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p = shared.value
        for batch in batches:
            rows = [(d, *s) for d, found in zip(batch["doc_id"], segments_of(batch["text"].tolist(), p), strict=True) for s in found]
            yield pd.DataFrame(rows, columns=["doc_id", "segment", "language", "confidence", "letters"])

    texts = spread(documents.select(F.col("doc_id").cast("string").alias("doc_id"), "text").where(F.col("text").isNotNull()))
    return texts.mapInPandas(judge, SEGMENTS).withColumn("doc_id", F.col("doc_id").cast(documents.schema["doc_id"].dataType))


def document_languages(documents: DataFrame, profiles: Profiles) -> DataFrame:
    """One row per document and language: ``doc_id, label, languages, language, confidence, share``.

    ``label`` is the two-letter form of the label in ``lang``, null where it says nothing; ``languages``
    counts the document's languages and ``share`` the letters of this one. Documents without any full
    sentence do not appear.
    """
    shared = documents.sparkSession.sparkContext.broadcast(profiles)

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p = shared.value
        for batch in batches:
            rows = []
            for doc, label, found in zip(batch["doc_id"], batch["label"], segments_of(batch["text"].tolist(), p), strict=True):
                letters: Counter = Counter()
                trust: Counter = Counter()
                for _, language, confidence, size in found:
                    letters[language] += size
                    trust[language] += confidence * size
                total = sum(letters.values())
                rows += [(doc, label, len(letters), lang, trust[lang] / n, n / total) for lang, n in letters.items()]
            yield pd.DataFrame(rows, columns=["doc_id", "label", "languages", "language", "confidence", "share"])

    labelled = documents.select(F.col("doc_id").cast("string").alias("doc_id"), label_code(F.col("lang")).alias("label"), "text").where(F.col("text").isNotNull())
    found = spread(labelled).mapInPandas(judge, "doc_id string, label string, languages int, language string, confidence double, share double")
    return found.withColumn("doc_id", F.col("doc_id").cast(documents.schema["doc_id"].dataType))


def label_faults(languages: DataFrame) -> DataFrame:
    """Rows of ``document_languages`` whose document has a missing or wrong label or names one of several languages."""
    return languages.where(F.col("label").isNull() | (F.col("languages") > 1) | (F.col("label") != F.col("language")))
