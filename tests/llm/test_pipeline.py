import corpus_pipeline
from test_joins import brute_groups

from tidewright.llm import _common, langid, packing, toxicity
from tidewright.llm._common import materialise

DIR = "/root/testdata/sf0.001"


def test_stages_like_brute_force(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    extra = spark.createDataFrame([(-1, None, "en", "s", 0), (-2, "12 34", "en", "s", 5), (-3, "you idiot moron scum, stupid trash and pathetic loser", "en", "s", 50)], docs.schema)
    docs = docs.unionByName(extra)
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())
    model = langid.fit(docs)
    told = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(docs, model).collect()}
    one = materialise(corpus_pipeline.language_id(spark, docs, DIR), "t")
    assert one.columns == docs.columns and ids(one) == sorted(i for i, (p, s) in told.items() if p != "und" and s >= 1 / len(model.langs))
    assert -1 not in ids(one) and -2 not in ids(one)
    two = materialise(corpus_pipeline.toxic_language(spark, one, DIR), "t")
    scored = {r.doc_id: r.score for r in toxicity.score(one, toxicity.fit(one, spark.read.parquet(f"{DIR}/labels.parquet"))).collect()}
    assert two.columns == docs.columns and ids(two) == sorted(i for i, s in scored.items() if s < 0.5) and -3 not in ids(two)
    three = materialise(corpus_pipeline.near_duplicates(spark, two, DIR), "t")
    groups = brute_groups([(r.doc_id, r.text) for r in two.collect()])
    assert three.columns == docs.columns and ids(three) == sorted(i for i, _, c in groups if i == c)
    four = corpus_pipeline.best_fit_packing(spark, three, DIR).collect()
    assert {r.doc_id for r in four} == set(ids(three))
    alone = packing.pieces(three, packing.tokenizer_files()[:1]).collect()
    assert sorted((r.doc_id, r.piece, r.ids_crc32) for r in four) == sorted((r.doc_id, r.piece, r.ids_crc32) for r in alone)


def test_clashing_columns_and_empty_tables(spark):
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{DIR}/documents.parquet").limit(40)
    for name in ("score", "lang_pred", "count", "removed", "digest", "component_id", "toxic", "node", "piece"):
        docs = docs.withColumn(name, F.lit(1))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialise(stage(spark, docs, DIR), "t")
        assert "score" in docs.columns and docs.count() > 20
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.where("false"), DIR).count() == 0


def test_one_row_of_a_repeated_id_stays(spark):
    docs = spark.createDataFrame([(1, "a b c d e f", "en", "s", 1), (1, "a b c d e f", "en", "s", 1), (2, "A b c d e f", "en", "s", 1), (None, "a b c d e f", "en", "s", 1)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    assert sorted(str(r.doc_id) for r in corpus_pipeline.near_duplicates(spark, docs, DIR).collect()) == ["1", "None"]


def test_run(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "toxicity", "ngram_jaccard_join", "best_fit_packing"]
    assert corpus_pipeline.run(spark, DIR).count() > 100


def test_rows_that_share_an_id_are_judged_apart(spark):
    a, b, c, d = ("a b c d e f g", "q r s t u v w", "h i j k l m n", "the last of all these texts here")
    rows = [(0, a), (1, a), (1, b), (1, b), (3, c), (3, d), (4, None), (4, "."), (None, a), (None, a)]
    docs = spark.createDataFrame([(i, t, "en", "s", n) for n, (i, t) in enumerate(rows)], "doc_id bigint, text string, lang string, source string, node bigint")
    out = [corpus_pipeline.near_duplicates(spark, x, DIR).collect() for x in (docs, docs.repartition(7, "node"))]
    key = lambda r: (str(r.doc_id), str(r.text), r.node)
    assert sorted((str(r.doc_id), str(r.text)) for r in out[0]) == sorted((str(i), str(t)) for i, t in [(0, a), (1, b), (3, c), (3, d), (4, None), (4, "."), (None, a), (None, a)])
    assert sorted(map(key, out[0])) == sorted(map(key, out[1]))


def test_a_step_trims_the_drivers_native_memory(spark, monkeypatch):
    done, trim = [], _common.trim
    monkeypatch.setattr(_common, "trim", lambda session: done.append(trim(session)))
    materialise(spark.range(1), "t")
    assert done == [True]
