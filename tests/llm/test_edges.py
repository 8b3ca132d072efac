"""Empty tables, nulls, repeats, long texts and extra columns, for every operator."""

import base64

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from shelfmark.llm import bpe_codec, compact_windows, embedding_dedup, language_gru, prob_minhash, quality_gam, quote_threads, secrets_dfa, winnowing, wrapper_induction

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
DOC = "doc_id long, text string, id string, words string, node long"
LONG = "word " * 40_000


def odd_docs(spark):
    rows = [(1, None), (2, ""), (3, "!!!"), (4, "same text here"), (4, "same text here"), (5, "same text here"), (None, "no id"), (6, LONG), (7, "日本 é 😀")]
    return spark.createDataFrame([(i, t, "x", "y", 0) for i, t in rows], DOC)


def items(spark):
    return spark.createDataFrame([(1, "text here"), (2, None), (3, "")], "item_id long, text string")


DOC_OPERATORS = {
    "secrets": lambda s, d: secrets_dfa.secret_report(d),
    "bpe": lambda s, d: bpe_codec.round_trip_report(d, PATH),
    "minhash": lambda s, d: prob_minhash.near_duplicates(d),
    "windows": lambda s, d: compact_windows.repeats(d),
    "winnowing": lambda s, d: winnowing.contamination(d, items(s)),
    "language": lambda s, d: language_gru.predict(d, language_gru.train([("en", b"word"), ("fr", "été".encode())], steps=5)),
}


@pytest.mark.parametrize("name", DOC_OPERATORS)
def test_every_row_has_a_result(spark, name):
    docs = odd_docs(spark)
    out = DOC_OPERATORS[name](spark, docs)
    assert sorted(str(r.doc_id) for r in out.collect()) == sorted(str(r.doc_id) for r in docs.collect())


@pytest.mark.parametrize("name", DOC_OPERATORS)
def test_empty_table(spark, name):
    assert DOC_OPERATORS[name](spark, odd_docs(spark).where(F.lit(False))).count() == 0


def test_pages_and_conversations(spark):
    pages = spark.createDataFrame([(1, None, None, "x"), (2, "http://a.org/", "", "y"), (None, "::", "<p>a", "z"), (None, "::", "<p>a", "z")], "page_id long, url string, html string, host string")
    assert sorted(r.text for r in wrapper_induction.extract(pages).collect()) == ["", "", "a", "a"]
    assert wrapper_induction.extract(pages.where(F.lit(False))).count() == 0
    turns = spark.createDataFrame([(1, None, None, None, 0), (1, 0, "user", "x", 0), (1, 0, "user", "x", 0), (None, 1, "user", "> x\ny", 0)], "conv_id long, turn long, role string, text string, mid long")
    assert {(r.conv_id, r.n_messages) for r in quote_threads.conversations(turns).collect()} == {(1, 2), (None, 1)}
    assert quote_threads.conversations(turns.where(F.lit(False))).count() == 0


def test_vectors(spark):
    rows = [(1, [1.0, 0.0], 1), (2, [1.0, 0.01], 1), (3, [1.0, 0.0], 2), (4, None, 1), (5, [0.0, 0.0], 1), (6, [None, 1.0], 1), (7, [float("nan"), 1.0], 1), (8, [1.0, 0.0], None), (9, [], 1), (10, [1.0, 0.0], 1), (11, [1.0, 0.0, 0.0], 1), (12, [float("inf"), 1.0], 1)]
    frame = spark.createDataFrame([(*r, 0.0) for r in rows], "vec_id long, embedding array<float>, label int, vec double")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_duplicates(frame).collect()}
    assert got[1] == (2, 1, True) and got[2] == (2, 1, False) and got[10] == (2, 1, False)
    assert all(got[i] == (0, i, True) for i in (3, 4, 5, 6, 7, 8, 9, 11, 12))
    assert embedding_dedup.near_duplicates(frame.where(F.lit(False))).count() == 0


def test_quality_without_labels_or_with_one_class(spark):
    docs = odd_docs(spark)
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in quality_gam.quality_report(docs, none).collect()} == {0.5}
    ones = spark.createDataFrame([(i, 1) for i in range(1, 8)], "doc_id long, quality int")
    scores = {r.score for r in quality_gam.quality_report(docs, ones).collect()}
    assert len(scores) == 1 and 0.5 < scores.pop() < 1
    assert quality_gam.quality_report(docs.where(F.lit(False)), ones).count() == 0


def test_language_without_letters_or_model(spark):
    docs = odd_docs(spark)
    net = language_gru.train([("en", b"word"), ("fr", "été".encode())], steps=5)
    got = {r.doc_id: r.lang_pred for r in language_gru.predict(docs, net).collect()}
    assert got[1] == got[2] == got[3] == "und" and got[6] in ("en", "fr")
    assert {r.lang_pred for r in language_gru.predict(docs, None).collect()} == {"und"}
    short = spark.createDataFrame([(1, "'s"), (2, "12 '"), (3, "\u0301")], "doc_id long, text string")
    assert [r.lang_pred == "und" for r in language_gru.predict(short, net).orderBy("doc_id").collect()] == [False, True, True]


def test_vocabulary_covers_all_bytes():
    ranks = bpe_codec.load_ranks(PATH)
    assert all(bytes([b]) in ranks for b in range(256)) and base64.b64encode(b"a")


STAGE_NAMES = ["quality_filter", "near_dedup", "decontaminate", "redact_secrets", "tokenize"]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("tables")
    spark.createDataFrame([(i, i % 2, 0) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, "one two three four five six seven eight nine ten"), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def stage_docs(spark):
    prose = " ".join(f"w{i}" for i in range(80))
    texts = {1: None, 2: "", 3: "!!!", 4: prose, 5: prose, 6: prose + " more", 7: "One two three, four five six seven eight nine TEN", 8: LONG, 9: "token = abcdef123", 10: "日本 é 😀", 11: " "}
    rows = [(i, t) for i, t in texts.items()] + [(4, prose), (None, prose), (None, None)]
    columns = "doc_id long, text string, lang string, source string, n_chars long, quality_score double, hit_id long, id long, node long, item string, spans string, block long, at int"
    return spark.createDataFrame([(i, t, "en", "s", len(t) if t else None, 0.1, 1, 2, 3, "x", "y", 4, 5) for i, t in rows], columns)


@pytest.mark.parametrize("name", STAGE_NAMES)
def test_stages_of_odd_documents(spark, tables, name):
    import corpus_pipeline

    stage = dict(corpus_pipeline.STAGES)[name]
    docs = stage_docs(spark)
    out = stage(spark, docs, tables)
    rows = out.collect()
    ids = sorted(str(r.doc_id) for r in rows)
    everyone = sorted(str(r.doc_id) for r in docs.collect())
    if name != "tokenize":
        assert out.columns == docs.columns and {r.quality_score for r in rows} <= {0.1}
    if name == "near_dedup":
        assert ids == sorted(x for x in everyone if x not in ("5", "6"))
    elif name == "decontaminate":
        assert ids == sorted(x for x in everyone if x != "7")
    elif name == "redact_secrets":
        assert ids == everyone and [(r.text, r.n_chars) for r in rows if r.doc_id == 9] == [("[SECRET:assign]", 15)]
        assert stage(spark, docs.drop("n_chars"), tables).count() == len(everyone)
    elif name == "tokenize":
        assert ids == everyone and {r.n_tokens for r in rows if r.doc_id in (1, 2)} == {0}
    else:
        assert set(ids) <= set(everyone)
    assert stage(spark, docs.where(F.lit(False)), tables).count() == 0


def test_columns_of_the_same_name_are_replaced(spark):
    docs = stage_docs(spark).withColumn("score", F.lit(9.0)).withColumn("decoded", F.lit("z"))
    model = quality_gam.fit(*(lambda r: (r, (r[:, 0] > r[:, 1]).astype(float)))(__import__("numpy").random.default_rng(0).random((50, len(quality_gam.FEATURES)))))
    assert quality_gam.score(docs, model).columns.count("score") == 1
    packed = bpe_codec.encode(docs, PATH).withColumn("decoded", F.lit("z"))
    assert bpe_codec.decode(packed, PATH).columns.count("decoded") == 1
