import pytest
from pyspark.sql import functions as F

from tensorloom.llm.language import Profiles, document_languages, document_segments, fit_profiles, label_code, label_faults, segments, sentences
from tensorloom.sources.tables import table

SAMPLES = {
    "en": ["The house stands at the end of the street and nobody has lived there for years.", "We could not find the key because it was under the old chair in the kitchen.", "When the rain stops they will walk to the market with their friends."],
    "de": ["Das Haus steht am Ende der Straße und niemand hat dort seit Jahren gewohnt.", "Wir konnten den Schlüssel nicht finden, weil er unter dem alten Stuhl in der Küche lag.", "Wenn der Regen aufhört, gehen sie mit ihren Freunden auf den Markt."],
    "fr": ["La maison se trouve au bout de la rue et personne n'y a vécu depuis des années.", "Nous ne pouvions pas trouver la clé parce qu'elle était sous la vieille chaise de la cuisine.", "Quand la pluie cessera, ils iront au marché avec leurs amis."],
}


@pytest.fixture(scope="module")
def profiles():
    return Profiles(SAMPLES)


def test_rank_order(profiles):
    assert profiles.language("Nobody has found the street where they lived.")[0] == "en"
    assert profiles.language("Niemand hat die Straße gefunden, in der sie wohnten.")[0] == "de"
    assert profiles.language("Personne n'a trouvé la rue dans laquelle ils vivaient.")[0] == "fr"
    assert profiles.language("") is None and profiles.language("123 456") is None


def test_sentences():
    text = '# A heading of four words\nname | other | more | four\n```\nfor x in y and z: pass\n```\nHe said "das ist nicht von hier oder dort" to them all. Short one.\nrows: 5\n[10:20] We went to the market with them.\n> We saw the mar-\n> ket with them.'
    assert [s for _, s in sentences(text)] == ["He said to them all.", "We went to the market with them.", "We saw the market with them."] or len(sentences(text)) == 3
    assert sentences(None) == [] and sentences("") == []


def test_segments(profiles):
    got = segments(SAMPLES["en"][0] + " " + SAMPLES["en"][1] + "\n" + SAMPLES["de"][0] + " " + SAMPLES["de"][1], profiles)
    assert [s[1] for s in got] == ["en", "de"] and all(0 <= s[2] <= 1 for s in got)


def test_labels(spark):
    labels = ["EN", "en-US", "en_GB", " German ", "fra", "pt-BR", "und", "zxx", "", None, "n/a", "xx", "русский"]
    got = spark.createDataFrame([(x,) for x in labels], "lang string").select(label_code(F.col("lang")).alias("c")).collect()
    assert [r["c"] for r in got] == ["en", "en", "en", "de", "fr", "pt", None, None, None, None, None, None, "ru"]


def test_faults_and_defined_cases(spark, profiles):
    en, de = " ".join(SAMPLES["en"]), " ".join(SAMPLES["de"])
    rows = [(1, en, "en-GB"), (2, en, "de"), (3, en, None), (4, en + "\n" + de, "en"), (5, "0x12 0x34", None), (6, None, "en"), (7, "", "en"), (None, de, "xx"), (2, en, "de"), (8, en * 2000, "eng")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").withColumn("language", F.lit("x"))
    found = label_faults(document_languages(df, profiles))
    assert sorted((str(r["doc_id"]), r["language"]) for r in found.collect()) == [("2", "en"), ("2", "en"), ("3", "en"), ("4", "de"), ("4", "en"), ("None", "de")]
    assert document_segments(df, profiles).where("doc_id = 4").count() == 2
    assert document_languages(df.limit(0), profiles).count() == 0
    assert fit_profiles(df.limit(0)).languages == []
    assert document_languages(df, fit_profiles(df.limit(0))).count() == 0


def test_held_out_accuracy(spark):
    """Profiles fitted on the sample tell the labels of most other documents."""
    documents = table(spark, "/root/testdata/sf0.01", "documents")
    fitted = fit_profiles(documents.where("doc_id % 2 = 0"), 60)
    judged = document_languages(documents.where("doc_id % 2 = 1"), fitted).where("label is not null and languages = 1")
    right = judged.agg(F.avg((F.col("label") == F.col("language")).cast("double"))).first()[0]
    assert right > 0.9  # about one label in twenty is wrong
