"""Broken prompt and response pairs: ordered rules that emit every defect a pair shows.

Rules, in order of precedence: ``empty``, ``copy``, ``refusal``, ``other_language``, ``truncated``. Four
of them look at the pair alone. Whether an answer ends inside a word is judged by all texts of the
corpus: the last two words never stand next to each other elsewhere (or never at a sentence's end, where
the last has at most three letters), but the first is followed by a longer word that begins like the second.

Defined cases: a null or empty question is never copied and asks for no language; null answers are
``empty``; repeated rows are judged each for itself; empty tables give no rows; very long texts are
read whole; other columns of the table are ignored.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tensorloom.llm.text import clean, guess_language, language_scores, main_script, unquoted, words
from tensorloom.runtime import materialize, spread

ORDER = ("empty", "copy", "refusal", "other_language", "truncated")

# Marks that models print around an answer, labels of turns, words a sentence cannot end with.
_SPECIAL = re.compile(r"<\|[^|<>]*\|>|</?s>|\[/?INST\]|<(?:eos|bos|pad|unk|end|eot)>", re.I)
_LABELS = frozenset(
    "question user human prompt instruction query q frage nutzer benutzer pregunta usuario vraag gebruiker utilisateur pergunta usuário pytanie вопрос "
    "answer assistant response reply output a antwort assistent assistente assistant respuesta asistente antwoord réponse resposta odpowiedź ответ".split()
)
_DANGLING = frozenset(
    "the a an and or of to with by as at for from into if when while because which than its their "
    "und oder der die das eine einen dem den des von weil dass für als "
    "et ou le les un une des du de à au aux avec pour que qui dans car "
    "y el los las una del al con para que en por porque de het een van met voor".split()
)
_TRANSLATION = re.compile(r"translat|übersetz|uebersetz|tradui|traduc|traduz|vertaal|vertal|przetłumacz|tłumacz|перевед|перевод", re.I)
_REFUSALS = (
    # English
    r"\bi (?:really )?(?:must|have to|need to|will) (?:respectfully )?(?:decline|refuse)\b",
    r"\bi(?: am|'m) (?:sorry,? but i(?: am|'m) )?(?:not able|unable|not allowed|not permitted|not authori[sz]ed|not in a position)\b",
    r"\bi (?:cannot|can't|can not|could not|couldn't|won't|will not|am not going to|do not|don't) (?:be able to )?(?:assist|help|answer|provide|describe|view|identify|comply|discuss|share|fulfil+|process|continue|respond|do that|do this|talk|tell you|read this|see (?:the |this |any )?(?:image|picture|screen|attach))",
    r"\bi won't be able\b",
    r"\bmy (?:guidelines|rules|polic(?:y|ies)|instructions|programming) (?:keep|prevent|forbid|prohibit|do not|don't|does not|doesn't|stop)",
    r"\b(?:against|violates?) my (?:rules|guidelines|polic)",
    r"\bno answer can be given\b",
    r"\b(?:something|that|what) i(?: am|'m) not (?:allowed|permitted|able)",
    r"\boutside (?:of )?what i (?:may|can|am allowed)",
    r"\bi have no (?:way|means|ability) (?:to|of) (?:see|view|read|access|open|look)",
    r"\bi will leave (?:it|this|that) unanswered",
    r"\bas an ai(?: language)?(?: model| assistant)?\b.{0,60}\b(?:cannot|can't|unable|not able|not allowed|decline|no way)",
    r"\bi(?:'d| would) (?:rather|prefer) not\b|\bi prefer not to\b|\bi (?:refuse|decline) to\b",
    r"\b(?:that|this|it)(?:'s| is) not something i(?: can|'m able| am able|'m going| am going| will)\b",
    r"\bi(?:'m| am) afraid (?:that )?i (?:can't|cannot|won't|am unable|am not)\b",
    r"^(?:sorry[,.]? )?(?:unable|not able) to (?:help|assist|answer|comply|provide|describe)\b",
    r"\b(?:cannot|can't|won't|unable to) (?:fulfil+|honou?r|satisfy|process) (?:this|that|your) request",
    r"\bi(?:'ll| will)? have to (?:pass|decline)\b",
    # German
    r"\bich (?:möchte|will|werde) (?:\w+ ){0,4}(?:lieber )?(?:nicht|nichts)(?: \w+){0,2} (?:sagen|antworten|beantworten|verraten|preisgeben|helfen)\b|\bich (?:lehne|weigere)\b|\b(?:möchte|will|werde) ich (?:\w+ ){0,4}(?:nicht|nichts) (?:sagen|antworten|beantworten)\b",
    r"\bich bin (?:leider )?nicht (?:in der lage|befugt|berechtigt|imstande)",
    r"\bich (?:kann|darf|werde|möchte) (?:\w+ ){0,6}(?:nicht|keine|kein)(?: \w+){0,3} (?:helfen|beantworten|beschreiben|ansehen|geben|antworten|weiterhelfen|sagen|mitteilen|sehen|tun)\b",
    r"\b(?:kann|darf) ich (?:\w+ ){0,5}(?:nicht|keine|kein)\b",
    # French
    r"\bje ne (?:suis|peux|puis|dois) (?:malheureusement )?pas (?:en mesure|autorisée?|capable|répondre|aider|vous aider|décrire|voir|fournir|donner|traiter|identifier|dire)",
    r"\bje ne (?:peux|puis) (?:pas|rien)\b",
    r"\bil m'est impossible\b",
    # Spanish
    r"\bno (?:puedo|podré|debo) (?:\w+ ){0,2}?(?:ayudar|responder|describir|ver|dar|contestar|proporcionar|identificar|decir)",
    r"\bno (?:tengo permiso|estoy autorizad[oa]|soy capaz|me es posible|me está permitido)",
    # Dutch
    r"\bik (?:kan|mag|wil|zal) (?:\w+ ){0,6}(?:niet|geen|niks)(?: \w+){0,3} (?:helpen|beantwoorden|beschrijven|bekijken|geven|zien|zeggen|antwoorden)\b",
    r"\bik ben (?:helaas )?niet (?:in staat|bevoegd|gemachtigd)",
    r"\b(?:dat|daar|dit|hier)(?:op)? (?:antwoord|beantwoord|help|zeg) ik (?:\w+ )?(?:niet|niets)\b|\bik (?:weiger|zeg liever niets|geef liever geen)\b",
    r"\bje (?:préfère|préférerais) ne (?:pas|rien)\b|\bje (?:refuse|me refuse)\b|\bje ne (?:souhaite|veux|vais) pas (?:répondre|vous aider|aider|dire)\b",
    r"\b(?:prefiero|preferiría) no (?:responder|contestar|decir|hablar)\b|\bme niego a\b|\bno (?:voy|vamos) a (?:responder|contestar|ayudar|poder)\b",
    # Italian
    r"\bnon (?:posso|potrò|sono in grado|sono autorizzat[oa]|mi è (?:possibile|permesso|consentito))\b(?: \w+){0,3}? (?:aiutar|risponder|fornir|descriver|di |dir)|\bpreferisco non\b|\bmi rifiuto\b",
    # Portuguese, Polish, Russian
    r"\bnão (?:vou|irei|quero|poderei) (?:\w+ ){0,2}?(?:ajudar|responder|dizer|descrever|fornecer)\b|\b(?:prefiro|preferia) não (?:responder|dizer|comentar)\b|\brecuso(?:-me)?\b",
    r"\bodmawiam\b|\bwolę nie (?:odpowiadać|mówić)|\bnie będę (?:odpowiadać|pomagać)",
    r"\bотказываюсь\b|предпочитаю не |\bне буду (?:отвечать|помогать)|\bне (?:смогу|можем) (?:помочь|ответить)",
    # Chinese, Japanese, Korean, Arabic, Turkish
    r"(?:无法|不能|不便|没办法|無法|拒绝|拒絕)(?:为您|为你|向您|给您)?(?:直接)?(?:回答|提供|协助|協助|帮助|帮您|满足|处理|讨论|描述)",
    r"(?:お答え|回答|お手伝い|ご案内|対応|提供|お応え|説明)(?:を|は|することは|することが)?(?:でき(?:ません|ない|かね)|致しかね|いたしかね|差し控え)",
    r"(?:답변|도움|도와|제공|설명|대답)[^.]{0,12}수 없",
    r"لا (?:أستطيع|يمكنني|أقدر)|\b(?:yardımcı olamam|cevap veremem|yanıtlayamam|yardım edemem)",
    r"\bnão (?:posso|consigo|estou autorizad[oa]|sou capaz|tenho permissão|me é permitido)",
    r"\bnie (?:mogę|jestem w stanie|wolno mi|potrafię)",
    r"\bя не (?:могу|имею права|в состоянии|вправе)|\bмне (?:не разрешено|нельзя|запрещено)",
)


def _alternatives(pattern: str) -> list[str]:
    """The pattern cut at the bars outside of brackets."""
    out, depth, begin = [], 0, 0
    for k, ch in enumerate(pattern):
        depth += (ch == "(") - (ch == ")")
        if ch == "|" and not depth:
            out.append(pattern[begin:k])
            begin = k + 1
    return [*out, pattern[begin:]]


_EACH = [a for p in _REFUSALS for a in _alternatives(p)]
# one word boundary before all of them, so that the search only stops where words begin; those that begin with
# other than Latin letters only for texts that have such
_BEGUN = "|".join(a.removeprefix(r"\b") for a in _EACH if a.startswith(r"\b"))
_REFUSES = re.compile(rf"\b(?:{_BEGUN})|" + "|".join(a for a in _EACH if a.startswith("^")))
_REFUSES_OTHER = re.compile("|".join(a for a in _EACH if not a.startswith((r"\b", "^"))))

_ENDS = re.compile(r"[.!?…。！？؟][\"'”’»)\]}*_]*$")
_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")
_TOKEN = re.compile(r"\d+(?:[.,]\d+)*|[^\W\d_]+(?:['’\-][^\W\d_]+)*|[^\w\s]")


def is_empty_answer(answer: str | None) -> bool:
    """Nothing that says anything: no letter or digit apart from marks of the model and labels of turns."""
    if answer is None:
        return True
    rest = words(_SPECIAL.sub(" ", clean(_SPECIAL.sub(" ", answer))))
    return not rest or (all(w in _LABELS and w not in ("a", "q") for w in rest) and answer.strip().endswith(":"))


def _near(a: list[str], b: list[str]) -> bool:
    """Equal up to typing errors: same words or nearly all of them, in order."""
    if a == b:
        return True
    if len(a) < 4 or abs(len(a) - len(b)) > 1 + len(b) // 12:
        return False
    most = max(1, len(b) // 8)
    there = set(a)
    if sum(w not in there for w in b) > most:
        return False
    # two rows of edit distance over words
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1] <= most


def is_copy(question: str | None, answer: str) -> bool:
    """The answer is the question, whole or without its closing instruction, perhaps repeated or decorated."""
    asked = clean(question)
    q = words(asked)
    a = words(clean(answer))
    if not q or len(q) < 2:
        return False
    starts = [q]
    parts = [p for p in _SENTENCE.split(asked.strip()) if p.strip()]
    if len(parts) > 1 and len(words(parts[-1])) <= 12:
        starts.append(words(" ".join(parts[:-1])))
    for form in starts:
        if not form:
            continue
        rest = a
        while rest and rest[0] in _LABELS and rest[0] != form[0]:
            rest = rest[1:]
        while rest and rest[-1] in _LABELS and rest[-1] != form[-1]:
            rest = rest[:-1]
        times = max(1, round(len(rest) / len(form)))
        if times <= 6 and rest and _near(rest, form * times):
            return True
    return False


def is_refusal(answer: str) -> bool:
    """The answer declines; words quoted from the screen do not count."""
    said = unquoted(clean(answer).replace("’", "'").replace("‘", "'")).lower()
    said = " ".join(said.split())
    return bool(_REFUSES.search(said)) or (not said.isascii() and bool(_REFUSES_OTHER.search(said)))


def is_other_script(asked: str, said: str) -> bool:
    """Most letters of the answer belong to another script than those of the question.

    Words that stand in the question do not count, nor does a single letter of an alphabet (a symbol). Names
    are written in Latin letters everywhere: a Latin answer to another script counts from four words on.
    """
    if asked.isascii() and said.isascii():
        return False
    want, _ = main_script(asked)
    known = set(words(asked))
    rest = [w for w in words(said) if w not in known]
    script, n = main_script(" ".join(rest))
    if want is None or script in (None, want) or main_script(said)[0] != script:
        return False
    if script == "LATIN":
        return len(rest) >= 4
    return n >= 2 or script in ("HAN", "HANGUL")


def is_other_language(question: str | None, answer: str) -> bool:
    asked = clean(question)
    if not asked or _TRANSLATION.search(asked):
        return False
    said = unquoted(clean(answer))
    if is_other_script(unquoted(asked), said):
        return True
    if len(words(said)) < 4:
        return False
    want = guess_language(unquoted(asked))
    if want is None:
        return False
    found = language_scores(said)
    got, evidence = max(found.items(), key=lambda x: x[1], default=(want, 0))
    return got != want and evidence >= 2 and found[want] <= (0.7 if evidence >= 4 else 0.5) * evidence


def open_structure(text: str) -> bool:
    """A structure that begins and is never closed."""
    s = text.strip()
    if s[:1] in "{[" and not (s[0] == "[" and re.match(r"\[\d+:\d+", s)):
        try:
            json.loads(s)
            return False
        except ValueError:
            pass
    if s.count("```") % 2:
        return True
    if _ENDS.search(s):
        return False
    for left, right in ("()", "[]", "{}"):
        if s.count(left) > s.count(right):
            return True
    return s.count('"') % 2 == 1 or s.count("“") > s.count("”")


def abrupt_end(text: str) -> bool:
    """Ends on a mark or word that needs something after it."""
    s = text.strip().rstrip("*_ ")
    if not s or _ENDS.search(s):
        return bool(re.search(r"(?:^|\n)\s*\d+[.)]$", s)) and "\n" in s
    if s[-1] in ",;:([{-–—/&+=":
        return True
    last = words(s.rsplit(None, 1)[-1])
    return len(words(s)) > 1 and bool(last) and last[-1] in _DANGLING


def tokens(text: str) -> list[str]:
    """Words for the corpus statistics: numbers as ``#``, names inside a sentence as ``N``, ``^`` before a sentence."""
    out, start = ["^"], True
    for t in _TOKEN.findall(text):
        if t[0].isdigit():
            out.append("#")
            start = False
        elif t[0].isalpha():
            out.append("N" if t[0].isupper() and not start else t.lower())
            start = False
        elif t in ".!?":
            out.append(".")
            out.append("^")
            start = True
        elif t in ",;:":
            out.append(t)
    return out


def _last_pair(text: str) -> tuple[str | None, str | None]:
    """The last two words of a text without end mark, where the last may be part of a word."""
    s = text.strip()
    if not s or _ENDS.search(s) or not s[-1].isalpha() or s.isupper():
        return None, None
    t = tokens(s)
    if len(t) < 2 or t[-1] in ("#", "N", ".", "^"):
        return None, None
    return t[-2], t[-1]


def _judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        found, prevs, lasts = [], [], []
        for question, answer in zip(batch["user"], batch["assistant"], strict=True):
            defects: list[str] = []
            prev = last = None
            if is_empty_answer(answer):
                defects.append("empty")
            else:
                said = clean(answer)
                if is_copy(question, answer):
                    defects.append("copy")
                if is_refusal(answer):
                    defects.append("refusal")
                if is_other_language(question, answer):
                    defects.append("other_language")
                if open_structure(said) or abrupt_end(said):
                    defects.append("truncated")
                else:
                    prev, last = _last_pair(said)
            found.append(defects)
            prevs.append(prev)
            lasts.append(last)
        yield pd.DataFrame({"row_id": batch["row_id"], "defects": found, "prev": prevs, "last": lasts})


def _pairs_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Distinct neighbouring words of every batch, without the last two of a text that has no end mark."""
    for batch in batches:
        seen: dict[tuple[str, str], bool] = {}
        for column in ("user", "assistant"):
            for text in batch[column]:
                s = clean(text).strip()
                if not s or s.isupper():
                    continue
                t = tokens(s)
                if not _ENDS.search(s):
                    t = t[:-1]
                for k, pair in enumerate(zip(t, t[1:], strict=False)):
                    # a full stop before a number ends an abbreviation, not a sentence
                    ends = t[k + 2 : k + 3] == ["."] and t[k + 4 : k + 5] != ["#"]
                    seen[pair] = seen.get(pair, False) or ends
        rows = [(a, b, ends) for (a, b), ends in seen.items() if b.isalpha() and b != "N"]
        yield pd.DataFrame(rows, columns=["prev", "word", "ends"])


def find_defects(pairs: DataFrame) -> DataFrame:
    """Every defect of every pair of ``pairs`` (``row_id, user, assistant``): ``row_id, defects array<string>``.

    Only defective pairs come out; ``defects`` is in order of precedence.
    """
    kind = pairs.schema["row_id"].dataType
    texts = spread(pairs.select(F.col("row_id").cast("string").alias("row_id"), "user", "assistant"))
    judged = materialize(
        texts.mapInPandas(_judge, "row_id string, defects array<string>, prev string, last string").where("size(defects) > 0 or last is not null"), "judged"
    )
    endings = judged.where("last is not null").select("prev", "last").distinct()
    neighbours = materialize(texts.mapInPandas(_pairs_of, "prev string, word string, ends boolean").groupBy("prev", "word").agg(F.max("ends").alias("ends")), "neighbours")
    # short words also begin many others: they must be known to end a sentence
    complete = neighbours.where((F.length("word") > 3) | F.col("ends")).select("prev", F.col("word").alias("last"))
    begun = neighbours.where(F.length("word") > 1).select("prev", F.explode(F.expr("transform(sequence(1, length(word) - 1), i -> substring(word, 1, i))")).alias("last"))
    cut = endings.join(complete, ["prev", "last"], "left_anti").join(begun, ["prev", "last"], "left_semi").withColumn("cut", F.lit(True))
    cut = materialize(cut, "cut")
    # rows whose end is not in question stay out of the join: they would all meet under one null key
    asked = judged.where("last is not null").join(cut, ["prev", "last"], "left")
    joined = asked.unionByName(judged.where("last is null").withColumn("cut", F.lit(False)))
    defects = F.when(F.coalesce("cut", F.lit(False)), F.concat("defects", F.array(F.lit("truncated")))).otherwise(F.col("defects"))
    return joined.select(F.col("row_id").cast(kind).alias("row_id"), defects.alias("defects")).where("size(defects) > 0")


def main_defect(found: DataFrame) -> DataFrame:
    """One defect per pair: the first in order of precedence."""
    return found.select("row_id", F.element_at("defects", 1).alias("defect"))
