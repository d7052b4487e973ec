import math
import os

import numpy as np
import regex
from pyspark.sql import functions as F

from panelcast.llm import langid
from panelcast.llm.queries import op2_language_id

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")

WORDS = {"en": "the house and water over there with thing", "de": "das haus und wasser über nicht schön ich",
         "fr": "la maison et eau être avec très où", "es": "la casa y agua está con muy año", "xx": "zzq qqz kkw wkk vvj"}


def corpus(spark, languages, n=60):
    rows = [(len(WORDS) * k + m, " ".join(WORDS[lang].split()[(k * j + j) % len(WORDS[lang].split())] for j in range(5 + k % 30)), lang)
            for m, lang in enumerate(languages) for k in range(n)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_held_out_texts_are_recognised(spark):
    docs = corpus(spark, ["en", "de", "fr", "es", "xx"])
    fold = F.crc32(F.col("doc_id").cast("string")) % 5
    model = langid.fit(docs.where(fold != 0))
    assert set(model.families) == {"germanic", "romance", "own:xx"}
    found = langid.identify(docs.where(fold == 0), model, keep=("doc_id", "lang")).collect()
    assert sum(r.lang == r.lang_pred for r in found) >= 0.97 * len(found)
    assert all(0 <= r.score <= 1 for r in found)


def plain_vote(model, text):
    """Family, then language, by counting byte groups one by one and letting every pair vote."""
    if not text or not regex.search(r"\p{L}", text):
        return "und", 0.0
    data = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in text.lower().encode())
    data = b" " + b" ".join(data.split()) + b" "
    counts = {}
    half = langid.FEATURES // 2
    for size, factor, shift in ((3, 2654435761, 0), (4, 2246822519, half)):
        for k in range(len(data) - size + 1):
            number = int.from_bytes(data[k:k + size], "little") * factor % 2**32
            f = (number >> 19) % half + shift
            counts[f] = counts.get(f, 0) + 1
    total = sum(counts.values())
    margins = {pair: sum(model.weights[n, f] * c for f, c in counts.items()) * 100 / total + model.intercepts[n] for n, pair in enumerate(model.pairs)}

    def winner(names):
        chances = {a: [1 / (1 + math.exp(-2 * max(-25, min(25, margins[a, b] if (a, b) in margins else -margins[b, a])))) for b in names if b != a]
                   for a in names}
        best = min(names, key=lambda a: (-sum(c > 0.5 for c in chances[a]), -sum(chances[a]), a))
        return best, sum(chances[best]) / len(chances[best]) if chances[best] else 1.0

    family, sure = winner(model.families)
    language, surer = winner(model.members[family])
    return language, sure * surer


def test_query_matches_a_plain_vote(spark, monkeypatch):
    fitted = []
    fit = langid.fit
    monkeypatch.setattr(langid, "fit", lambda docs: fitted.append(fit(docs)) or fitted[-1])
    got = {r.doc_id: (r.lang_pred, r.score) for r in op2_language_id(spark, SF).collect()}
    docs = [r for r in spark.read.parquet(f"{SF}/documents.parquet").collect() if len(r.text or "") < 5_000]
    assert len(docs) > 100
    for r in docs:
        lang, score = plain_vote(fitted[0], r.text)
        assert got[r.doc_id][0] == lang and abs(got[r.doc_id][1] - score) < 1e-9


def test_clashing_names_and_many_labels(spark, monkeypatch):
    docs = corpus(spark, ["en", "fr", "de", "es"], 30).withColumn("score", F.lit("x")).withColumn("lang_pred", F.lit("y")).withColumn("share", F.lit(1))
    found = langid.identify(docs, langid.fit(docs))
    assert found.columns == ["doc_id", "lang_pred", "score"] and found.where("lang_pred = 'y'").count() == 0
    monkeypatch.setattr(langid, "MOST_LANGUAGES", 3)
    assert sorted(lang for m in langid.fit(docs).members.values() for lang in m) == ["de", "en", "es"]


def test_odd_texts_and_columns(spark):
    model = langid.fit(corpus(spark, ["en", "fr"], 20).unionByName(
        spark.createDataFrame([(1, None, "en"), (2, "text", None), (3, "123 !!", "de")], "doc_id long, text string, lang string")))
    long = "the house and water " * 200_000
    rows = [(1, None), (2, ""), (3, "12 ½ !?"), (4, "the house"), (4, "the house"), (None, "la maison"), (5, long), (6, "\x00é")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score2", F.lit("x"))
    found = [(r.doc_id, r.lang_pred, r.score) for r in langid.identify(docs, model).collect()]
    assert [f[1] for f in found[:3]] == ["und"] * 3 and all(f[2] == 0 for f in found[:3])
    assert found[3] == found[4] and found[3][1] == "en" and found[5][1] == "fr" and found[6][1] == "en" and found[7][1] in ("en", "fr")
    assert model.predict("the house")[0] == "en"


def test_nothing_learnt_determines_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    model = langid.fit(empty)
    assert model.predict("words") == ("und", 0.0)
    assert langid.identify(empty, model).collect() == []
    one = langid.fit(spark.createDataFrame([(1, "words", "en")], "doc_id long, text string, lang string"))
    assert one.predict("others") == ("en", 1.0)


def test_whole_texts_count_not_prefixes():
    text = "ab é" * 700_000
    pieces = np.concatenate(list(langid._features(text)))
    whole = langid.BLOCK
    langid.BLOCK = 1 << 30
    try:
        assert np.array_equal(np.bincount(pieces, minlength=langid.FEATURES),
                              np.bincount(np.concatenate(list(langid._features(text))), minlength=langid.FEATURES))
    finally:
        langid.BLOCK = whole
