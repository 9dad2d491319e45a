import zlib

from netloom.llm import langid


def rows(spark):
    base = {"en": "the house and the garden with roses", "de": "das haus und der garten mit rosen", "xx": "zorp kvik blag wumz"}
    docs = []
    for i in range(300):
        lang = ["en", "de", "xx"][i % 3]
        w = base[lang].split()
        docs.append((i, " ".join(w[(i + j) % len(w)] for j in range(8)), lang, "s", 1.0))
    docs += [(1000, None, "en", "s", 1.0), (1001, "", "en", "s", 1.0), (1002, "12 !? 34", "en", "s", 1.0), (1003, "THE garden " * 20_000, None, "s", 1.0), (1004, "gartenhaus rosengarten", None, None, None)]
    return spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, score double")


def test_identify(spark):
    df = rows(spark)
    model = langid.fit_documents(df)
    got = {r.doc_id: r for r in langid.identify(df, model).collect()}
    assert len(got) == df.count()
    for i in range(300):
        assert got[i].lang_pred == ["en", "de", "xx"][i % 3] and 0 <= got[i].score <= 1
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1)
    assert [got[i].lang_pred for i in (1000, 1001, 1002, 1003, 1004)] == ["und", "und", "und", "en", "de"]
    kept = langid.keep(df, model)
    assert kept.columns == df.columns and kept.count() == df.count() - 3


def test_held_out_rows_teach_nothing(spark):
    df = rows(spark).withColumn("text", __import__("pyspark").sql.functions.expr("if(crc32(cast(cast(doc_id AS string) AS binary)) % 3 = 1, concat(text, ' secretword'), text)"))
    assert "secretword" not in langid.fit_documents(df).words.at


def test_backoff_uses_longest_known_grams():
    m = langid.Model({("a", "abcd"): 5, ("b", "bcde"): 5, ("a", "q"): 1})
    assert m.predict("abcx")[0] == "a" and m.predict("xcde")[0] == "b"
    assert m.predict("яя")[0] == "a"  # nothing known: even, first in order
    assert langid.Model({}).predict("abc") == ("und", 0.0)


def test_no_labels_and_empty(spark):
    df = rows(spark)
    model = langid.fit_documents(df.where("lang = 'none'"))
    assert {r.lang_pred for r in langid.identify(df, model).collect()} == {"und"}
    assert langid.identify(df.where("false"), model).count() == 0


def test_accuracy_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.identify(docs, langid.fit_documents(docs)).where("held_out").join(docs.select("doc_id", "lang"), "doc_id")
    right, n = got.where("lang = lang_pred").count(), got.count()
    assert n > 200 and right / n > 0.97


def test_large_languages_do_not_starve_rare_ones(spark):
    # 2,200 documents learnt, with 110,000 words that all occur twice
    big = [(i, " ".join(2 * ["".join(chr(97 + int(c)) for c in f"{i:05}{j:02}") for j in range(50)]), "en") for i in range(3300)]
    rare = [(10_000 + i, "zorp kvik blag wumz qrst"[5 * (i % 5) :][:4], "xx") for i in range(15)]
    model = langid.fit_documents(spark.createDataFrame(big + rare, "doc_id long, text string, lang string"))
    assert model.langs == ["en", "xx"] and model.predict("zorp kvik")[0] == "xx"
    assert len(model.words.at) > 100_000
    assert len(model.grams[3].at) == len({g for w in model.words.at for g in langid.grams(w, 4)})


def test_letters_are_unicode_letters():
    assert langid.letters("Ab² ½ ³x9y_z Ⅷ ßé ʰǅ कि") == ["ab", "x", "y", "z", "ßé", "ʰǆ", "क"]
    m = langid.Model({("de", "haus"): 5, ("en", "house"): 5})
    assert m.predict("² ½ Ⅷ") == ("und", 0.0)


def test_every_language_is_learnt(spark):
    docs = [(i, f"{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}word", f"l{i:04}") for i in range(1500)]
    df = spark.createDataFrame(docs, "key long, text string, lang string")
    assert len(langid.fit(df).langs) == 1500


def test_columns_with_odd_names(spark):
    df = rows(spark).withColumnRenamed("score", "a.b").withColumnRenamed("source", "p")
    kept = langid.keep(df, langid.fit_documents(df))
    assert kept.columns == df.columns and kept.count() == df.count() - 3
