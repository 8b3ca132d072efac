import math
import random
import re
import sys
import time
import unicodedata
from collections import Counter

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from shelfmark.functions import text as T
from shelfmark.operators import cells, policy, search, store
from shelfmark.operators.model_service import ModelError, ModelService, by_index
from shelfmark.operators.store import Files, Log, PostingsRuns
from shelfmark.sources import readers


LOCAL = ["http://127.0.0.1:5984/_all_dbs", "http://localhost/admin", "http://10.0.0.1/internal", "http://192.168.1.1/router", "http://172.16.0.1/meta", "http://169.254.169.254/latest/meta-data", "ftp://example.com/file", "file:///etc/passwd", "http://127.1/", "http://2130706433/", "http://[::ffff:127.0.0.1]/", "http://0.0.0.0/"]


def docs(spark):
    return spark.createDataFrame([(1, "Thin thing foo"), (2, "café foo_bar"), (3, None), (4, "thin thin question")], "doc_id long, text string")


def test_tokens_fold_accents_and_split_underscores(spark):
    rows = docs(spark).select(T.index_tokens(F.col("text")).alias("t")).collect()
    assert [r.t for r in rows] == [["thin", "thing", "foo"], ["cafe", "foo", "bar"], [], ["thin", "thin", "question"]]


def test_bm25_matches_the_formula(spark):
    got = {r.doc_id: r.score for r in search.bm25(docs(spark), [["thin"], ["foo"]]).collect()}
    lengths, counts = {1: 3, 2: 3, 3: 0, 4: 3}, {"thin": {1: 2, 4: 2}, "foo": {1: 1, 2: 1}}
    average = sum(lengths.values()) / 4
    want = {}
    for hits in counts.values():
        idf = math.log((4 - len(hits) + 0.5) / (len(hits) + 0.5))
        for doc, f in hits.items():
            want[doc] = want.get(doc, 0) + (idf if idf > 0 else 1e-6) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * lengths[doc] / average))
    assert got == {k: pytest.approx(v, abs=1e-6) for k, v in want.items()}


def test_bm25_scope_keeps_corpus_statistics_and_no_terms_give_nothing(spark):
    whole = {r.doc_id: r.score for r in search.bm25(docs(spark), [["foo"]]).collect()}
    scoped = {r.doc_id: r.score for r in search.bm25(docs(spark), [["foo"]], scope=F.col("doc_id") == 1).collect()}
    assert scoped == {1: whole[1]}
    assert search.bm25(docs(spark), []).count() == 0


def test_rrf_adds_reciprocal_ranks_and_keeps_first_seen_order(spark):
    lists = spark.createDataFrame([(0, 1, 7), (0, 2, 8), (1, 1, 8), (1, 2, 9)], "list_no int, rank int, id long")
    rows = search.rrf(lists, "id").orderBy(*search.fused_order("id")).collect()
    assert [r.id for r in rows] == [8, 7, 9]
    assert rows[0].score == pytest.approx(1 / 62 + 1 / 61, abs=1e-6)


def test_knn_ranks_by_distance_then_id(spark):
    vectors = spark.createDataFrame([(1, [0.0, 1.0]), (2, [1.0, 0.0]), (3, [1.0, 0.0])], "vec_id long, embedding array<float>")
    query = spark.createDataFrame([([1.0, 0.0],)], "q array<float>")
    assert [(r.vec_id, r.rank) for r in search.knn(vectors, query, 2).collect()] == [(2, 1), (3, 2)]


def test_cells_close_by_the_triangle_inequality(spark, tmp_path):
    rng = np.random.default_rng(4)
    around = rng.normal(size=(20, 6)) * 5
    points = np.concatenate([around[rng.integers(0, 20, 900)] + rng.normal(size=(900, 6)) * 0.1, np.repeat(around[:2], 30, axis=0)]).astype(np.float32)
    rows = [(int(i), ["a", "b"][i % 2], p.tolist()) for i, p in enumerate(points)] + [(5000, "c", [0.0] * 6), (5001, "a", None)]
    vectors = spark.createDataFrame(rows, "vec_id long, space string, embedding array<float>")
    cells.build(vectors, str(tmp_path / "cells"), per_cell=20)
    present = vectors.where("embedding is not null")
    for q in (around[0], around[7] + 0.3, rng.normal(size=6) * 40):
        query = spark.createDataFrame([(q.tolist(),)], "q array<double>")
        stored = cells.Search(spark, str(tmp_path / "cells"))
        got = stored.nearest(query, 15).select("space", "vec_id", "distance", "rank")
        assert sorted(got.collect()) == sorted(search.knn_by_space(present, query, 15).select("space", "vec_id", "distance", "rank").collect())
    assert stored.cells_all > 30
    near = cells.Search(spark, str(tmp_path / "cells"))
    near.nearest(spark.createDataFrame([(around[3].tolist(), "a")], "q array<double>, space string"), 5)
    assert near.cells_read < near.cells_all / 2
    some = cells.read(spark, str(tmp_path / "cells")).where("space = 'a' and cell in (1, 2)")
    assert "PartitionFilters: [isnotnull(space" in some._jdf.queryExecution().executedPlan().toString()
    only = cells.Search(spark, str(tmp_path / "cells"), live=lambda r: r.where("vec_id % 3 = 0"))
    assert sorted(only.nearest(query, 9).collect()) == sorted(search.knn_by_space(present.where("vec_id % 3 = 0"), query, 9).select("space", "vec_id", "distance", "rank").collect())


def test_private_queries_leave_remote_spaces_out(spark):
    spaces = spark.createDataFrame([("remote-a",), ("local-b",)], "space string")
    plan = {r.space: r.searched for r in policy.search_plan(spaces, F.lit(True)).collect()}
    assert plan == {"remote-a": False, "local-b": True}
    with pytest.raises(policy.PrivacyError):
        policy.guard_remote(True, "remote-a")
    policy.guard_remote(False, "remote-a")


def test_url_policy(spark):
    want = {"http://127.0.0.1/": "private host", "http://172.31.9.9": "private host", "http://172.32.0.1": None, "ftp://a.org": "scheme", "http:///x": "no host", "http://[::1]/": "private host", "http://no-such-name.invalid/": None, "http://[fe80::1%25eth0]/": "private host"}
    rows = spark.createDataFrame([(u,) for u in [*want, *LOCAL]], "u string").select("u", readers.url_problem(F.col("u")).alias("p")).collect()
    assert {r.u: r.p for r in rows if r.u in want} == want
    assert {r.p for r in rows if r.u in LOCAL} == {"private host", "scheme"}
    for url in LOCAL:
        with pytest.raises(ValueError, match="not allowed"):
            readers.check_url(url)


def test_paths_stay_in_their_root_and_caps_hold(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("hello")
    assert [r.text for r in readers.read_texts(spark, str(tmp_path / "in"), str(tmp_path)).collect()] == ["hello"]
    with pytest.raises(ValueError, match="outside"):
        readers.checked_path(str(tmp_path), str(tmp_path / "in"))
    with pytest.raises(Exception, match="size cap"):
        readers.read_texts(spark, str(tmp_path / "in"), cap=3).collect()


def test_overlap_rerank_and_text_fallback(spark):
    row = spark.createDataFrame([("a b c", "A x b", "")], "q string, d string, ctx string")
    got = row.select(search.overlap_score(F.col("q"), F.col("d")).alias("s"), search.rerank_text(F.col("ctx"), F.col("d")).alias("t")).first()
    assert got.s == pytest.approx(2 / 3) and got.t == "A x b"


def fold(text):
    return "".join(c for c in unicodedata.normalize("NFD", text.lower()) if not unicodedata.combining(c))


def brute_bm25(texts, phrases):
    """id -> score, over (id, text) with phrases of tokens of which the last is a prefix."""
    tokens = {i: re.findall(r"[^\W_]+", fold(t or "")) for i, t in texts}
    average, scores = sum(map(len, tokens.values())) / len(tokens), {}
    for *whole, prefix in phrases:
        hits = {}
        for i, ts in tokens.items():
            n = sum(ts[k : k + len(whole)] == whole and ts[k + len(whole)].startswith(prefix) for k in range(len(ts) - len(whole)))
            if n:
                hits[i] = n
        idf = max(math.log((len(tokens) - len(hits) + 0.5) / (len(hits) + 0.5)), 0) or 1e-6
        for i, n in hits.items():
            scores[i] = scores.get(i, 0) + idf * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * len(tokens[i]) / average))
    return {i: pytest.approx(s, abs=2e-6) for i, s in scores.items()}


def test_query_terms_are_folded_and_split_like_texts(spark):
    assert search.parse_query(spark, "Café foo_bar _ É_ qué") == [["cafe"], ["foo", "bar"], ["e"], ["que"]]
    texts = [(1, "le café noir"), (2, "foo_bar x"), (3, "foo bars"), (4, "bar foo"), (5, "cafe\u0301s"), (6, None)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    for query, want in (("café", {1, 5}), ("foo_bar", {2, 3}), ("bar_foo", {4}), ("CAFE", {1, 5}), ("_", set())):
        phrases = search.parse_query(spark, query)
        assert {r.doc_id for r in search.bm25(docs, phrases).collect()} == want, query


def test_stored_postings_rank_like_the_texts(spark, tmp_path):
    rng = random.Random(3)
    vocabulary = ["tax", "taxes", "Täx", "law", "lawful", "rule", "x", "1a", "law_tax", "été"]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(30))) for _ in range(60)] + ["", None, "tax " * 50]
    docs = spark.createDataFrame([(i, t, i % 2) for i, t in enumerate(texts)], "doc_id long, text string, side int")
    rows = search.postings(docs, keep=("side",))
    want = {(i, t, n) for i, text in enumerate(texts) for t, n in Counter(fold(text or "").replace("_", " ").split()).items()}
    assert {(r.doc_id, r.token, r.tf) for r in rows.collect()} == want
    assert all(len(r.places) == r.tf and max(r.places) < r.dl for r in rows.collect())
    rows.write.parquet(str(tmp_path / "p"))
    stored = spark.read.parquet(str(tmp_path / "p"))
    totals = docs.agg(F.count("*").alias("n"), F.lit(stored.agg(F.sum("tf")).first()[0]).alias("total"))
    for phrases in ([["tax"]], [["ta"], ["law"], ["ta"]], [["law", "tax"], ["ete"]], [["tax", "tax", "ta"]], [["none"]], [["none", "tax"]], []):
        brute = brute_bm25(enumerate(texts), phrases)
        assert {r.doc_id: r.score for r in search.bm25(docs, phrases).collect()} == brute
        for scope in (None, F.col("side") == 1):
            assert sorted(search.bm25_indexed(stored, totals, phrases, scope=scope).collect()) == sorted(search.bm25(docs, phrases, scope=scope).collect())
    empty = search.bm25_indexed(rows.where(F.lit(False)), docs.where(F.lit(False)).agg(F.count("*").alias("n"), F.lit(0).alias("total")), [["tax"]])
    assert empty.count() == 0


def test_runs_of_postings_are_merged_and_forget_what_is_gone(spark, tmp_path):
    files = Files(spark, str(tmp_path / "store"))
    runs = PostingsRuns(files, "postings", "doc_id bigint, v bigint", fan=3)
    rng, live, texts = random.Random(5), {}, {}
    for batch in range(10):
        doc = rng.randrange(4)  # some batches replace an earlier version
        live[doc], texts[doc] = batch, " ".join(rng.choice(["tax", "law", "rule", "ta"]) for _ in range(6)) + f" only{batch}"
        rows = spark.createDataFrame([(doc, batch, texts[doc])], "doc_id long, v long, text string")
        now = spark.createDataFrame(list(live.items()), "doc_id long, v long")
        assert runs.add(search.postings(rows, keep=("v",)), now) == 7
        if batch == 8:  # the last merge
            replaced = [b for b in range(9) if b not in live.values()]
    assert len(runs.runs()) <= 2 * 3  # at most two runs of each of the levels 0 to 2
    stored = runs.rows().join(now, ["doc_id", "v"], "left_semi")
    rebuilt = search.postings(spark.createDataFrame(list(texts.items()), "doc_id long, text string"))
    columns = ["doc_id", "token", "tf", "dl", "places"]
    assert sorted(stored.select(columns).collect()) == sorted(rebuilt.select(columns).collect())
    assert runs.possible([["ta"], ["law", "ta"], ["none"], ["none", "ta"], ["only9"]]) == [True, True, False, False, True]
    assert replaced and not any(runs.possible([[f"only{b}"] for b in replaced]))
    assert len(files.names("postings/postings")) <= len(runs.runs()) + 3
    runs.fan = 2
    runs.compact(now)
    assert len({level for _, level, _ in runs.runs()}) == len(runs.runs())


def test_a_log_keeps_the_last_state_of_each_key(spark, tmp_path):
    log = Log(Files(spark, str(tmp_path / "store")), "rows", "id bigint, name string", "id")
    assert log.rows().count() == 0
    for i in range(store.MOST_FILES + 3):
        log.append([(i % 5, f"n{i}")])
    log.append(log.rows().where("id = 4"), gone=True)
    log.rewrite()
    last = store.MOST_FILES + 2
    assert dict(log.rows().collect()) == {i % 5: f"n{i}" for i in range(last - 4, last + 1) if i % 5 != 4}
    assert log.changes().agg(F.max("id")).first()[0] == 4  # its number is not given again


def test_every_address_of_a_name_is_checked():
    found = lambda *addresses: lambda host, port: [(0, 0, 0, "", (a, 0)) for a in addresses]
    readers.check_url("https://example.com/page", found("93.184.215.14", "2001:db8::1"))
    for inner in ("10.0.0.7", "fd00::7", "::ffff:10.0.0.7", "fe80::1%eth0"):
        with pytest.raises(ValueError, match="private"):
            readers.check_url("https://example.com/page", found("93.184.215.14", inner))

    def unknown(host, port):
        raise OSError("no such name")

    readers.check_url("https://no-such-name.invalid/", unknown)


def shared_words():
    """A model that scores by shared words, and names texts by index; "fail" is an error, "die" ends its process."""

    def score(query, texts):
        if query == "fail":
            raise KeyError("bad request")
        if query == "die":
            import os

            os._exit(1)
        return [(i, len(set(query.split()) & set(t.split()))) for i, t in enumerate(texts) if t]

    return score


def test_a_model_process_is_shared_restarted_and_ends_when_idle(spark):
    cloudpickle.register_pickle_by_value(sys.modules[shared_words.__module__])
    service = ModelService(shared_words, idle=60)
    service.stop()
    assert service.running() is None  # nothing runs before the first use
    assert service.score("a b", ["b a c", "", "x b"]) == [2.0, 0.0, 1.0]
    first = service.running()
    with pytest.raises(ModelError, match="bad request"):
        service.score("fail", ["a"])
    assert service.running() == first  # a bad request does not end it
    rows = spark.createDataFrame([(i, f"b w{i}") for i in range(40)], "id long, text string").repartition(4)
    scored = search.model_rerank(rows, "b w7", service)
    assert {r.id: r.rerank_score for r in scored.collect()} == {i: 2.0 if i == 7 else 1.0 for i in range(40)}
    assert service.running() == first  # all workers used the same one
    with pytest.raises(RuntimeError, match="failed twice"):
        service.score("die", ["a"])
    assert service.score("a", ["a"]) == [1.0] and service.running() != first
    service.stop()
    short = ModelService(shared_words, idle=0.5)
    assert short.score("a", ["a"]) == [1.0]
    time.sleep(1.5)
    assert short.running() is None  # ended by itself
    assert short.score("a", ["a", "b"]) == [1.0, 0.0]


def test_scores_are_addressed_by_index():
    assert by_index([(2, 0.5), (0, 0.25), (9, 1.0)], 3) == [0.25, 0.0, 0.5]
    assert by_index([1, 2], 2) == [1.0, 2.0] and by_index([], 0) == []
    with pytest.raises(ModelError):
        by_index([1.0], 2)


def test_registered_queries_build_no_index_for_one_query(spark, monkeypatch):
    import os

    from shelfmark.plans import corpus, queries

    if not os.path.isdir("/root/testdata/sf0.001"):
        pytest.skip("needs the driver's tables")
    monkeypatch.setattr(corpus, "lexical_index", lambda *_: pytest.fail("an index for one query"))
    for name in ("rrf_fusion", "hybrid_search", "rerank_topk"):
        rows = queries.QUERIES[name](spark, "/root/testdata/sf0.001")
        if name != "rrf_fusion":
            # texts are narrowed to the candidates where they are read, before the join with labels moves them
            plan = rows._jdf.queryExecution().optimizedPlan().toString()
            assert " IN (" in plan[plan.index("LeftOuter") :] or "INSET" in plan[plan.index("LeftOuter") :]


def test_postings_of_a_batch_are_made_once(spark, tmp_path):
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    texts = [(1, "The café, the"), (2, None), (3, ""), (4, "b a b")]
    docs = spark.createDataFrame(texts, "doc_id long, text string").mapInArrow(count, "doc_id long, text string")
    runs = PostingsRuns(Files(spark, str(tmp_path)), "postings", "doc_id bigint")
    assert runs.add(search.postings(docs)) == 6 and made.value == 4
    assert sorted((r.doc_id, r.token, r.tf, r.dl, r.places) for r in runs.rows().collect()) == [(1, "cafe", 1, 3, [1]), (1, "the", 2, 3, [0, 2]), (4, "a", 1, 3, [1]), (4, "b", 2, 3, [0, 2])]
