import pytest

from tensorloom.llm import pairs
from tensorloom.llm.pairs import find_defects, main_defect

Q = "Where is the seat map of Nevoten? Keep it short."


@pytest.mark.parametrize("answer", [None, "", "  ", "\n", "​", "...", "…", "{}", "[]", '""', "-", "<|end|>", "</s>", "Assistant:"])
def test_empty(answer):
    assert pairs.is_empty_answer(answer)


@pytest.mark.parametrize("answer", ["No", "14%", "None", "3", "Да"])
def test_not_empty(answer):
    assert not pairs.is_empty_answer(answer)


@pytest.mark.parametrize("answer", [Q, Q.upper(), "Where is the seat map of Nevoten?", f'"{Q}"', f"Question: {Q}", f"User: {Q}\nAssistant:", f"{Q} {Q}", "where is teh seat map of nevoten? keep it short"])
def test_copy(answer):
    assert pairs.is_copy(Q, answer)


@pytest.mark.parametrize("answer", ["The seat map of Nevoten is in the footer.", f'The question "{Q}" is printed on the slide; the reply is Torelin.', "Keep it short."])
def test_no_copy(answer):
    assert not pairs.is_copy(Q, answer)
    assert not pairs.is_copy(None, answer) and not pairs.is_copy("", answer)


@pytest.mark.parametrize(
    "answer",
    [
        "I'm sorry, but I must decline to describe this picture.", "As an AI model, I am not able to view images.", "My guidelines keep me from reading this.", "I can’t help with that request.",
        "Entschuldigung, aber ich darf darauf keine Antwort geben.", "Désolé, je ne suis pas autorisé à décrire cela.", "Lo siento, pero no puedo responder a eso.", "Helaas, ik mag deze vraag niet beantwoorden.",
        "Desculpe, não posso ajudar.", "Przepraszam, nie mogę odpowiedzieć.", "К сожалению, я не могу ответить.",
    ],
)
def test_refusal(answer):
    assert pairs.is_refusal(answer)


@pytest.mark.parametrize("answer", ['The page says "Sorry, I cannot help with that" in red.', "The banner cannot be closed until it has loaded.", "Leider ist die Übersicht noch nicht bereit."])
def test_no_refusal(answer):
    assert not pairs.is_refusal(answer)


def test_other_language():
    assert pairs.is_other_language(Q, "Die Karte steht unten auf der linken Seite neben dem Feld.")
    assert not pairs.is_other_language("Translate this label into German: the map", "Die Karte steht unten auf der linken Seite neben dem Feld.")
    assert not pairs.is_other_language(Q, "The map is in the lower left corner of the page.")
    assert not pairs.is_other_language(Q, "Torelin") and not pairs.is_other_language(None, "Die Karte ist unten auf der Seite.")


@pytest.mark.parametrize("answer", ['{"a": 1, "b"', "1. Alpha\n2.", "It sits next to the", "It is red, and", "See the map (", "It says 5,", '```\nx = 1'])
def test_cut_structures_and_ends(answer):
    assert pairs.open_structure(answer) or pairs.abrupt_end(answer)


@pytest.mark.parametrize("answer", ['{"a": 1}', "It is red", "1. Alpha\n2. Beta", "click(1, 2)", "It is what we asked for.", "14%"])
def test_complete(answer):
    assert not pairs.open_structure(answer) and not pairs.abrupt_end(answer)


def test_words_cut_by_corpus(spark):
    rows = [(i, "q here?", f"The map number {i} is in the lower corner of the page.") for i in range(20)]
    rows += [(100, "q here?", "The map is in the lower cor"), (101, "q here?", "The map number 7 is in the lower corner"), (102, "q", None), (103, None, "The map is red."), (None, None, None)]
    df = spark.createDataFrame(rows, "row_id bigint, user string, assistant string").selectExpr("*", "'x' as defects", "1 as last")
    got = {r["row_id"]: r["defects"] for r in find_defects(df).collect()}
    assert got == {100: ["truncated"], 102: ["empty"], None: ["empty"]}


def test_all_defects_and_precedence(spark):
    df = spark.createDataFrame([(1, Q, f"User: {Q}\nAssistant:"), (1, Q, f"User: {Q}\nAssistant:")], "row_id bigint, user string, assistant string")
    found = find_defects(df)
    assert [r["defects"][0] for r in found.collect()] == ["copy", "copy"]
    assert {r["defect"] for r in main_defect(found).collect()} == {"copy"}
    assert find_defects(df.limit(0)).count() == 0


def test_long_text(spark):
    text = "The map is in the lower corner. " * 20000
    df = spark.createDataFrame([(1, "Where?", text), (2, text, text)], "row_id bigint, user string, assistant string")
    assert {r["row_id"]: r["defects"] for r in find_defects(df).collect()}.get(1) is None


@pytest.mark.parametrize(
    "answer",
    ["Η κάτοψη βρίσκεται στο υποσέλιδο.", "Κάτω", "الخريطة في أسفل الصفحة", "نعم", "המפה נמצאת בתחתית", "座位图在页脚中。", "是", "座席表はフッターにあります", "좌석표는 바닥글에 있습니다", "네", "Да", "В подвале", "मानचित्र नीचे है"],
)
def test_other_script(answer):
    assert pairs.is_other_language(Q, answer)
    assert not pairs.is_other_language("Translate the title of the page.", answer)
    assert not pairs.is_other_language(answer, answer) and not pairs.is_other_language(None, answer)


@pytest.mark.parametrize(("question", "answer"), [
    (Q, "5 Ω"), (Q, "π"), (Q, "10 µm"), (Q, 'The label reads "Отмена".'), ("What does the button Отмена close?", "Отмена"), (Q, "42"), (Q, "Ünïcode près d'où"), ("座席表はどこですか", "東京"), ("Где карта Nevoten?", "Nevoten Maps"),
])
def test_no_other_script(question, answer):
    assert not pairs.is_other_language(question, answer)


def test_latin_answer_to_another_script():
    assert pairs.is_other_language("Где находится план зала?", "The plan is in the footer.")


@pytest.mark.parametrize(
    "answer",
    [
        "I'd rather not answer that.", "That's not something I can help with.", "I'm afraid I can't do that for you.", "Unable to comply.", "I refuse to comment on this picture.",
        "Dazu möchte ich lieber nichts sagen.", "Je préfère ne pas répondre à cette question.", "Prefiero no contestar.", "Daar antwoord ik liever niet op.", "Mi dispiace, ma non posso aiutarti con questo.",
        "Desculpe, não vou ajudar com isso.", "Wolę nie odpowiadać na to pytanie.", "Извините, я не смогу помочь с этим.", "抱歉，我无法回答这个问题。", "申し訳ございませんが、お答えできません。", "죄송합니다. 답변을 드릴 수 없습니다.",
    ],
)
def test_refusals_of_other_wordings(answer):
    assert pairs.is_refusal(answer)


@pytest.mark.parametrize(
    "answer",
    [
        "The dialog says \"I'd rather not answer that\".", "The user cannot close the window.", "It is not something the table shows, but the chart does: 7.", "Der Knopf ist nicht aktiv.",
        "Le bouton ne peut pas être fermé.", "No hay ningún botón rojo.", "Non ci sono voci nella lista.", "图中没有红色按钮。", "赤いボタンはありません。",
    ],
)
def test_sound_answers_of_other_wordings(answer):
    assert not pairs.is_refusal(answer)
