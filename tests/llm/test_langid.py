from pyspark.sql import functions as F

from sitemill.llm import langid


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    known = langid.learn(langid.training_rows(docs))
    assert known.names[0] == "en" and len(known.names) == 4
    assert all(len(c) <= 4 * langid.PIECES * (langid.PIECE_CHARS + 1) for c in known.contents)
    held = langid.classify(docs.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2), known)
    right, low, high = held.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.min("score"), F.max("score")).first()
    assert right >= 0.98 and 0 <= low and high <= 1


def test_odd_rows(odd, empty):
    known = langid.learn(odd)
    got = langid.classify(odd, known)
    assert set(got.columns) == set(odd.columns) and got.count() == odd.count()
    for r in got.select("text", "lang_pred", "score", "accepted").collect():
        if not any(c.isalpha() for c in r.text or ""):
            assert (r.lang_pred, r.score, r.accepted) == ("und", 0.0, False)
        else:
            assert r.lang_pred in known.names and 0 <= r.score <= 1
    assert langid.keep_known(odd, known).columns == odd.columns
    assert langid.classify(empty, known).count() == 0
    nothing = langid.learn(empty)
    assert nothing.names == () and {r.lang_pred for r in langid.classify(odd, nothing).collect()} == {"und"}


def test_narrow_margins_are_rejected(make):
    known = langid.Dictionaries(("aa", "bb"), (b"alpha beta gamma delta " * 9, b"schoen gruen weiss blau " * 9))
    got = {r.text: (r.lang_pred, r.accepted) for r in langid.classify(make(["alpha beta gamma delta", "gruen weiss blau schoen", "zq"]), known, margin=0.05).collect()}
    assert got == {"alpha beta gamma delta": ("aa", True), "gruen weiss blau schoen": ("bb", True), "zq": ("aa", False)}


def test_long_texts_count_whole():
    known = langid.Dictionaries(("aa", "bb"), (b"alpha beta gamma delta " * 9, b"schoen gruen weiss blau " * 9))
    packer = langid.Packer(known)
    text = "alpha beta gamma delta " * 3 + " ".join(f"schoen{i} gruen{i} weiss{i} blau{i}" for i in range(3_000))
    assert langid.decide(packer.sizes(text))[0] == 1
    assert (packer.sizes(text) > packer.sizes(text[: len(text) // 2]) * 1.5).all()
