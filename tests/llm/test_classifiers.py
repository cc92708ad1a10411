import math
import random
import zlib

import pytest
from pyspark.sql import functions as F

from tidewright.llm import langid, toxicity

EN, DE = "the house and the garden with that tree ", "der hund und die katze mit dem schönen ball "
FR, ES = "le chien et la maison avec une très belle fleur ", "el perro y la casa con una flor muy bonita señor "


def docs(spark, n=120):
    rows = [(i, (EN, DE, FR, ES)[i % 4] * (1 + i % 3), ("en", "de", "fr", "es")[i % 4], "s", 1, 0.0) for i in range(n)]
    rows += [(1000, None, "en", "s", 1, 0.0), (1001, "", "de", "s", 1, 0.0), (1002, "123 !?", "fr", "s", 1, 0.0), (1003, "日本", None, "s", 1, 0.0), (1004, EN * 40000, None, "s", 1, 0.0), (None, ES, "es", "s", 1, 0.0), (5, FR, "fr", "s", 1, 0.0)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, score double")


def test_language(spark):
    d = docs(spark)
    out = [(r.doc_id, r.lang_pred, r.score) for r in langid.predict(d, langid.fit(d)).collect()]
    assert len(out) == d.count()
    by = {i: (p, s) for i, p, s in out}
    assert all(by[i][0] == ("en", "de", "fr", "es")[i % 4] for i in range(120) if i != 5)
    assert all(by[i] == ("und", 0.0) for i in (1000, 1001, 1002)) and by[1004][0] == "en" and by[1003][0] in ("en", "de", "fr", "es") and by[None][0] == "es"
    assert all(0 <= s <= 1 for _, _, s in out)


def test_language_without_rows(spark):
    d = docs(spark)
    assert langid.fit(d.where("false")) is None
    assert {r.lang_pred for r in langid.predict(d, None).collect()} == {"und"}
    assert langid.predict(d.where("false"), None).count() == 0
    one = langid.fit(d.where("lang = 'en'"))
    assert {r.lang_pred for r in langid.predict(d.where("doc_id < 100"), one).collect()} == {"en"}


def naive_counts(text):
    """n-grams of the text's words, with a space where anything else stands, counted one by one."""
    out = {}
    letters = "".join(c if c.isalpha() else " " for c in text.lower())
    letters = " " + " ".join(letters.split(" ")) + " "
    while "  " in letters:
        letters = letters.replace("  ", " ")
    if not letters.strip():
        return out
    for n in langid.GRAMS:
        for i in range(len(letters) - n + 1):
            h = 0
            for k, c in enumerate(letters[i : i + n]):
                h = (h * 0x01000193 & 0xFFFFFFFF) ^ (ord(c) * int(langid._MULTIPLIERS[k % 4]) & 0xFFFFFFFF)
            h = ((h ^ h >> 15) * 0x2C1B3C6D & 0xFFFFFFFF) >> (32 - langid.BITS)
            out[h] = out.get(h, 0) + 1
    return out


def test_counts_like_a_naive_counter():
    rng = random.Random(8)
    texts = ["", "a", " ", "ab", "1 2", "\U00010400x \U0001f600y", "Straße ΣΑΣ İstanbul", EN, DE, "x" * 700] + ["".join(rng.choices("abcé Σ1.\n日\U00010400", k=rng.randint(0, 300))) for _ in range(60)]
    for text in texts:
        want = naive_counts(text)
        for part in (1, 2, 3, 7, 97, langid.PART):
            got = langid.Features(part).counts(text)
            assert {int(i): int(got[i]) for i in got.nonzero()[0]} == want, (text, part)


def test_long_text_counts_like_the_whole():
    rng = random.Random(9)
    text = " ".join("".join(rng.choices("abcdefgh", k=rng.randint(1, 9))) for _ in range(120_000))
    assert len(text) > langid.PART
    assert (langid.Features().counts(text) == langid.Features(10**9).counts(text)).all()


def test_folding():
    f = toxicity.Folder()
    assert f("STÜPID 1d1ot, mоrоn! l0ser tr@sh") == " stupid idiot moron loser trash "
    assert f("") == "  " and f("in 1995 we") == " in we "


def test_lexicon_exceptions_and_stems():
    lex = toxicity.Lexicon({"trash ": 2.0, "lowei": 3.0})
    f = toxicity.Folder()
    assert lex.features(f("a trash can"))[0] == 0 and lex.features(f("you trash"))[0] > 0
    assert lex.features(f("a trash can or trash, trash bin"))[2] == 2.0 and lex.features(f("trash can " * 50000))[0] == 0
    assert lex.features(f("loweichen x"))[2] == 3.0 and lex.features(f("xlowei"))[0] == 0
    assert lex.features(f("trash " + "word " * 500))[1] < lex.features(f("trash word"))[1]


def naive_features(entries, exceptions, folded):
    """The same three numbers by looking for every entry at every place."""
    found, excused = {}, []
    for e in exceptions:
        at = folded.find(f" {e} ")
        while at >= 0:
            excused.append((at, at + len(e) + 1))
            at = folded.find(f" {e} ", at + 1)
    for e, w in entries.items():
        at = folded.find(f" {e}")
        while at >= 0:
            if not any(a <= at < b for a, b in excused):
                found[at] = max(w, found.get(at, 0.0))
            at = folded.find(f" {e}", at + 1)
    total, words = sum(found[k] for k in sorted(found)), folded.count(" ") - 1
    return math.log1p(total), math.log1p(100 * total / max(words, 1)), max(found.values(), default=0.0)


def test_lexicon_like_brute_force():
    rng = random.Random(5)
    entries = {"ab ": 1.0, "abc": 2.5, "b ": 0.5, "ca": 3.0, "a " : 4.0, "caba ": 1.5, "w" * 40 + " ": 9.0, "of ": 0.25}
    exceptions = ("ab ca", "b a b", "abc")
    lexicon = toxicity.Lexicon(entries, exceptions)
    for n in range(400):
        folded = " " + " ".join("".join(rng.choices("abc", k=rng.randint(1, 4))) for _ in range(n % 40)) + " "
        if n % 9 == 0:
            folded += "w" * 40 + " "
        assert lexicon.features(folded) == pytest.approx(naive_features(entries, exceptions, folded), abs=1e-12)


def test_every_entry_with_the_evidence_is_learned(spark):
    """Short and long words, and more entries than any table of them was once allowed."""
    rng = random.Random(7)
    rows = []
    for i in range(400):
        words = ["".join(rng.choices("abcdefgh", k=4)) for _ in range(30)]
        rows.append((" ".join([*words, "qx", "y" * 200]) if i % 4 == 0 else " ".join(words), int(i % 4 == 0)))
    got = toxicity.learn_lexicon(spark.createDataFrame(rows, "text string, toxic int"))
    assert "qx " in got and "y" * 4 in got
    words = [a + b + c for a in map(chr, range(97, 123)) for b in map(chr, range(97, 123)) for c in "abcdefg"]
    rows = []
    for i in range(80):
        own = (words if i % 4 == 0 else []) + ["".join(rng.choices("ghijk", k=9)) for _ in range(2)]
        rows.append((" ".join(rng.sample(own, len(own))), int(i % 4 == 0)))
    got = toxicity.learn_lexicon(spark.createDataFrame(rows, "text string, toxic int"))
    assert all(f"{w} " in got for w in words) and len(words) > 4000


def test_the_model_does_not_depend_on_partitions(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{n}.parquet") for n in ("documents", "labels"))
    twice = docs.unionByName(docs.where("doc_id % 3 = 0").withColumn("text", F.concat(F.lit("x "), "text")))
    models = [toxicity.fit(twice.repartition(n), labels.repartition(n)) for n in (1, 17)]
    assert models[0].entries == models[1].entries and (models[0].curve == models[1].curve).all()


def test_toxicity_learns(spark):
    rng = random.Random(3)
    rows, labels = [], []
    for i in range(400):
        toxic = i % 5 == 0
        words = ["".join(rng.choices("abcdefgh", k=3)) for _ in range(30)]
        rows.append((i, " ".join([*words, "zurgle" + chr(97 + i % 7), *words[:5]] if toxic else words), 0.5))
        labels.append((i, int(toxic)))
    rows += [(1000, None, 0.0), (1001, "", 0.0), (1002, EN + "zurglec", 0.0), (1002, EN + "zurglec", 0.0), (None, "an idiot", 0.0), (1003, EN * 10000, 0.0)]
    labels += [(None, 1), (1000, None), (1001, 3)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, toxic double")
    model = toxicity.fit(d, spark.createDataFrame(labels, "doc_id bigint, toxic int"))
    out = [(r.doc_id, r.score) for r in toxicity.score(d, model).collect()]
    assert len(out) == len(rows)
    got = dict(out)
    assert all((got[i] >= 0.5) == (i % 5 == 0) for i in range(400))
    assert got[1002] >= 0.5 and got[None] >= 0.5 and max(got[1000], got[1001], got[1003]) < 0.5 and all(0 <= s <= 1 for _, s in out)


def test_toxicity_without_labels(spark):
    d = spark.createDataFrame([(1, "an idiot"), (2, "a friend")], "doc_id bigint, text string")
    none = spark.createDataFrame([], "doc_id bigint, toxic int")
    got = {r.doc_id: r.score for r in toxicity.score(d, toxicity.fit(d, none)).collect()}
    assert got[1] >= 0.5 > got[2]
    assert toxicity.score(d.where("false"), toxicity.fit(d, none)).count() == 0


def test_held_out_rows(spark):
    from tidewright.llm._common import held_out

    got = {r.i: r.h for r in spark.range(50).select(F.col("id").alias("i"), held_out(F.col("id")).alias("h")).collect()}
    assert got == {i: zlib.crc32(str(i).encode()) % 5 == 0 for i in range(50)}
