import unicodedata

from pyspark.sql import functions as F

from glossa.functions import text as T


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return row.select(column.alias("x")).first().x


def test_normalisers_differ_where_they_should(spark):
    words = ["  Immune-Mediated ", "immune–mediated", "immune mediated", "Straße", "ﬁne", "Ⅻ", "a b", "ÉCLAIR", "x−y", None]
    rows = spark.createDataFrame([(w,) for w in words], "w string").select(
        "w", T.norm_key(F.col("w")).alias("k"), T.norm_metric(F.col("w")).alias("m"), T.norm_folded(F.col("w")).alias("f")
    ).collect()

    def squeeze(s):
        return " ".join(s.split())

    for r in rows:
        if r.w is None:
            assert r.k is r.m is r.f is None
            continue
        low = unicodedata.normalize("NFKC", r.w).lower()
        assert r.k == squeeze(unicodedata.normalize("NFKC", r.w.strip()).casefold()), r.w
        dashed = low.translate({ord(c): " " for c in T.DASHES})
        assert r.m == squeeze(dashed), r.w
        assert r.f == squeeze(dashed.replace("−", " ").replace("-", " ")), r.w
    assert rows[0].f == rows[1].f == rows[2].f and rows[0].m != rows[2].m


def test_phrases(spark):
    assert one(spark, T.phrase_in(F.col("t"), F.col("p")), t="Severe PNEUMONIA seen", p="pneumonia") is True
    assert one(spark, T.phrase_in(F.col("t"), F.col("p")), t="immune mediated", p="immune-mediated") is False
    assert one(spark, T.phrase_in_text(F.col("t"), F.col("p")), t="immune mediated", p="immune-mediated") is True
    assert one(spark, T.phrase_in(F.col("t"), F.col("p")), t="x", p="") is False
    assert one(spark, T.fluency_text(F.col("t")), t=T.PLACEHOLDER) == "" and one(spark, T.fluency_text(F.col("t")), t=None) == ""


def test_tiers_codes_and_languages(spark):
    rows = spark.createDataFrame([(None, "5"), (None, "4"), ("", "1"), ("HLT", "99"), ("zz", "9")], "t string, l string")
    assert [r.x for r in rows.select(T.canonical_tier(F.col("t"), F.col("l")).alias("x")).collect()] == ["LLT", "PT", "SOC", "HLT", "zz"]
    assert [one(spark, T.is_code(F.col("c")), c=c) for c in (" 12 ", "1a", "")] == [True, False, False]
    assert [one(spark, T.detect_lang(F.col("c")), c=c) for c in ("Médicament", "tablet", "apnée")] == ["fr", "en", "fr"]


def test_sentences_and_variants(spark):
    assert one(spark, T.sentence_splits(F.col("t")), t="One. Two!\nThree") == ["One.", "Two!", "Three", "One. Two!\nThree"]
    assert one(spark, T.sentence_splits(F.col("t")), t="One") == ["One"] and one(spark, T.sentence_splits(F.col("t")), t="  ") == [" "]
    got = one(spark, T.context_variants(F.col("a"), F.col("b")), a="hormone", b="On Hormone replacement therapy now")
    assert got == ["Hormone replacement therapy now", "Hormone replacement therapy", "Hormone replacement", "Hormone"]
    assert one(spark, T.context_variants(F.col("a"), F.col("b")), a="two words", b="has two words here") == []


def test_first_phrase():
    assert T.first_phrase("The patient of the severe adverse reaction") == "the patient of the severe"
    assert T.first_phrase("of the") is None and T.first_phrase(None) is None and T.first_phrase("a fever") == "a fever"


def test_answers(spark):
    raw = "```\n1. Best System: s2\nmore of it\n2. RANKING: a,b\nbest system: s3\n```"
    assert one(spark, T.fielded_answer(F.col("t")), t=raw) == {"BEST_SYSTEM": "s3", "RANKING": "a,b"}
    assert one(spark, T.fielded_answer(F.col("t")), t="KEY: one\n\n two") == {"KEY": "one two"}
    assert one(spark, T.json_payload(F.col("t")), t='```json\n{"a": 1}\n```') == '{"a": 1}'
    assert one(spark, T.json_payload(F.col("t")), t='so: {"a": 1} ok') == '{"a": 1}' and one(spark, T.json_payload(F.col("t")), t="none") is None
    assert T.vector_column(0.8) == "htm_vector_080" and T.parse_thresholds("0.8, 0.9") == [0.8, 0.9]
