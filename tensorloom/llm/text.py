"""Text helpers shared by the operators: cleaning, words, and a language guess from function words."""

from __future__ import annotations

import html
import re
import unicodedata
from collections import Counter
from functools import lru_cache

from tensorloom.llm.words import FUNCTION_WORDS, LETTERS

_INVISIBLE = re.compile("[­͏؜ᅟᅠ឴឵᠎​-‏‪-‮⁠-⁤⁪-⁯︀-️﻿]")
_TAG = re.compile(r"</?[A-Za-z][^<>]{0,60}>")
_QUOTED = re.compile(r"\"[^\"]*\"|“[^”]*”|„[^“”]*[“”]|«[^»]*»|`[^`]*`")
_WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")
_NO_LETTER = re.compile("[^A-Za-z]+")
_CYRILLIC = re.compile("[а-яё]")

_LANGUAGES_OF_WORD: dict[str, list[str]] = {}
for _lang, _words in FUNCTION_WORDS.items():
    for _w in _words.split():
        _LANGUAGES_OF_WORD.setdefault(_w, []).append(_lang)


def clean(text: str | None) -> str:
    """One spelling of a text: compatibility forms folded, entities resolved, tags and invisible characters gone."""
    if not text:
        return ""
    if "&" in text:
        text = html.unescape(text)
    if not text.isascii():
        text = _INVISIBLE.sub("", unicodedata.normalize("NFKC", text))
    return _TAG.sub(" ", text) if "<" in text else text


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def unquoted(text: str) -> str:
    """The text without quoted spans."""
    return _QUOTED.sub(" ", text)


#: Scripts that one language mixes.
_TOGETHER = {"CJK": "HAN", "HIRAGANA": "HAN", "KATAKANA": "HAN", "KATAKANA-HIRAGANA": "HAN", "IDEOGRAPHIC": "HAN", "BOPOMOFO": "HAN"}


@lru_cache(maxsize=50_000)
def _script(letter: str) -> str:
    name = unicodedata.name(letter, "").split(" ")[0]
    return _TOGETHER.get(name, name)


def main_script(text: str) -> tuple[str | None, int]:
    """Unicode script of more than half of the letters, and how many letters it has; None where there is none."""
    if text.isascii():
        n = len(_NO_LETTER.sub("", text))
        return ("LATIN", n) if n else (None, 0)
    count = Counter(_script(ch) for ch in text if ch.isalpha())
    script, n = max(count.items(), key=lambda x: x[1], default=(None, 0))
    return (script, n) if script and n * 2 > count.total() else (None, 0)


def language_scores(text: str) -> Counter:
    """Evidence for each language: function words, and letters typical of it. Empty where there is none."""
    low = text.lower()
    score: Counter = Counter()
    letters = len(_CYRILLIC.findall(low))
    if letters >= 6:
        score["ru"] = letters / 4
    for word in _WORD.findall(low):
        langs = _LANGUAGES_OF_WORD.get(word)
        if langs:
            for lang in langs:
                score[lang] += 1 / len(langs) + 0.5
    if not low.isascii():
        for lang, special in LETTERS.items():
            hits = sum(low.count(ch) for ch in special)
            if hits:
                score[lang] += min(3, hits)
    return score


def guess_language(text: str, least: float = 2) -> str | None:
    """The language with the most evidence; None where it is thin or divided."""
    ranked = language_scores(text).most_common(2)
    if not ranked or ranked[0][1] < least:
        return None
    if len(ranked) > 1 and ranked[0][1] < 1.25 * ranked[1][1]:
        return None
    return ranked[0][0]
