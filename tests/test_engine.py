import random
import threading
import time

import pytest
from pyspark.sql import functions as F

from shelfmark.engine import Engine, EngineError
from shelfmark.operators import catalog, dispatch, policy, search, structure
from shelfmark.streaming.ingest import ingest_stream


def statute():
    return "".join(f"Section {i}. Title\nrule {i} about {'tax' if i == 4 else 'law'} and more. " + "plain words " * 20 + "\n" for i in range(1, 7))


def test_notebook_life(spark, tmp_path):
    engine = Engine(spark, str(tmp_path / "store"), contextualizer=lambda window, text: f"context of {len(window)}")
    book = engine.notebook_create("taxes")["id"]
    with pytest.raises(EngineError):
        engine.notebook_create("taxes")
    added = engine.source_add(book, "mem://a", text=statute(), private=True)
    assert added["ingest_state"] == "ready"
    with pytest.raises(EngineError):
        engine.source_add(book, "mem://a", text="again")
    flat = engine.source_add(book, "mem://b", text="flat tax text " * 30, private=False)["source_id"]
    status = engine.source_status(added["source_id"])
    assert status["chunks_structural"] == 6 and status["summary"].endswith("all chunks contextual (structural/public)")
    assert {r.url: r.private for r in engine.source_list(book).collect()} == {"mem://a": True, "mem://b": False}
    found = engine.notebook_query(book, "tax", private=False)
    assert found["results"].count() > 0 and found["excluded"] == []
    hidden = engine.notebook_query(book, "tax", private=True, mode="dense")
    assert hidden["excluded"] == ["remote-a"] and hidden["results"].where("not private").count() == 0
    with pytest.raises(ValueError):
        engine.notebook_query(book, "tax", mode="odd")
    assert not engine.source_refresh(book, flat, text="flat tax text " * 30)["refreshed"]
    assert engine.source_refresh(book, flat, text="new words here")["refreshed"]
    assert engine.chunks().where(F.col("source_id") == flat).first()["text"] == "new words here"
    note = engine.source_add(book, "mem://c", text="secret note without headings", private=True)["source_id"]
    assert engine.source_enrich(note) == {"enriched": 1, "failed": 0}
    assert engine.source_status(note)["summary"] == "embedded 1, queryable now, enrichment complete: 1 enriched"
    assert engine.notebook_status(book)["source_count"] == 3
    index, totals = engine.postings()
    chunks = engine.chunks().select(F.xxhash64("source_id", "chunk_index").alias("doc_id"), "text")
    assert sorted(search.bm25_indexed(index, totals, [["tax"], ["note"]]).collect()) == sorted(search.bm25(chunks, [["tax"], ["note"]]).collect())
    engine.source_delete(book, flat)
    assert engine.chunks().where(F.col("source_id") == flat).count() == 0
    missing = engine.source_add(book, str(tmp_path / "missing.txt"))
    assert missing["ingest_state"] == "failed"
    assert engine.source_status(missing["source_id"])["summary"].startswith("ingest FAILED after 0 chunks")
    engine.config_set("k", "1")
    engine.config_set("k", "2")
    assert engine.config_get("k") == "2" and engine.config_get("none") is None
    engine.notebook_delete(book)
    assert engine.notebook_list().count() == 0 and engine.table("ledger").count() == 0


def test_stream_shows_progress_and_repeats_safely(spark, tmp_path):
    for k in range(2):
        spark.createDataFrame([(k, statute())], "doc long, txt string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = ingest_stream(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "check"))
    stream.awaitTermination()
    state = spark.read.parquet(str(tmp_path / "out" / "state"))
    assert {(r.doc, r.chunks, r.batch) for r in state.collect()} == {(0, 6, 0), (1, 6, 1)}
    assert spark.read.parquet(str(tmp_path / "out" / "chunks")).count() == 12


def test_prices_and_summaries(spark):
    models = spark.createDataFrame([("voyage-3.5",), ("voyage-zzz",), ("bge-x",), ("x.gguf",), ("deepseek-q",), ("other",)], "m string")
    assert [tuple(r) for r in models.select(catalog.price_in(F.col("m")), catalog.price_out(F.col("m"))).collect()] == [(0.06, 0.0), (0.10, 0.0), (0.0, 0.0), (0.0, 0.0), (0.27, 1.10), (0.0, 0.0)]


def test_token_rate_includes_both_ends(spark):
    rows = spark.createDataFrame([("2024-01-01 00:00:00", 400.0), ("2024-01-01 00:01:00", 300.0), ("2024-01-01 00:02:01", 1.0)], "ts string, tokens double").withColumn("ts", F.to_timestamp("ts"))
    assert [r.tokens_in_window for r in catalog.token_rate(rows).orderBy("ts").collect()] == [400.0, 700.0, 1.0]


def test_token_rate_over_stretches_equals_one_window(spark):
    rng = random.Random(2)
    at = [None, *(rng.randrange(4000) for _ in range(300)), *(600 * k + d for k in range(1, 6) for d in (-60, -61, 0, 0, -1))]
    rows = spark.createDataFrame([(i, t, float(rng.randrange(9)), i % 2) for i, t in enumerate(at)], "id long, t long, tokens double, side int").withColumn("ts", F.timestamp_seconds("t"))
    for keys in ((), ("side",)):
        got = {r.id: r.tokens_in_window for r in catalog.token_rate(rows, 60, *keys).collect()}
        data = rows.collect()
        assert len(got) == len(data)
        for r in data:
            same = [x for x in data if not keys or x.side == r.side]
            assert got[r.id] == sum(x.tokens for x in same if (x.t is None and r.t is None) or (None not in (x.t, r.t) and r.t - 60 <= x.t <= r.t))
    plan = catalog.token_rate(rows)._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan


def test_stored_cells_give_the_neighbours_of_a_full_scan(spark, tmp_path):
    engine = Engine(spark, str(tmp_path / "store"), embedder=lambda texts: [[float(len(t.split())), float(t.count("a"))] for t in texts])
    book = engine.notebook_create("n")["id"]
    for k, text in enumerate(("a b c " * 90, "a " * 700, "b c d e f " * 300)):
        engine.source_add(book, f"mem://{k}", text=text, private=True)
    full = engine.notebook_query(book, "a b", mode="dense")["results"].collect()
    engine.index_vectors(book)
    assert engine.notebook_query(book, "a b", mode="dense")["results"].collect() == full
    engine.source_add(book, "mem://late", text="a b", private=True)
    engine.source_delete(book, 2)
    late = engine.notebook_query(book, "a b", mode="dense")["results"].collect()
    assert late[0].display_name == "mem://late" and {r.display_name for r in late} == {"mem://late", "mem://0", "mem://2"}
    engine.index_vectors(book)
    assert engine.notebook_query(book, "a b", mode="dense")["results"].collect() == late


def test_costs_by_model_and_questions_of_their_own(spark, tmp_path):
    def remote(texts):
        return [[0.0, 1.0] for _ in texts]

    remote.embed_query = lambda texts: [[9.0, 9.0] for _ in texts]
    engine = Engine(spark, str(tmp_path / "store"), embedder=lambda texts: [[1.0, 0.0] for _ in texts], remote_embedder=remote)
    assert engine.query_embedders[policy.REMOTE](["q"]) == [[9.0, 9.0]] and engine.embedders[policy.REMOTE](["q"]) == [[0.0, 1.0]]
    assert engine.query_embedders[policy.LOCAL](["q"]) == [[1.0, 0.0]]
    book = engine.notebook_create("n")["id"]
    engine.source_add(book, "mem://a", text="some public words", private=False)
    row = engine.source_list(book).first()
    assert [(c.model, c.api_calls, c.input_tokens) for c in row.costs] == [("voyage-context-3", 1, 3.0)]


def test_private_text_never_reaches_the_remote_model(spark, tmp_path):
    def remote(texts):
        if any("secret" in t for t in texts):
            raise AssertionError("private text was sent")
        return [[1.0] * 4 for _ in texts]

    engine = Engine(spark, str(tmp_path / "store"), remote_embedder=remote, scorers={"local": lambda q, texts: [float(len(t)) for t in texts], "remote": lambda q, texts: [0.0 for _ in texts]})
    book = engine.notebook_create("n")["id"]
    assert engine.source_add(book, "mem://a", text="secret words", private=True)["ingest_state"] == "ready"
    assert engine.source_add(book, "mem://b", text="public words and more", private=False)["ingest_state"] == "ready"
    found = engine.notebook_query(book, "words", private=False, rerank=True)
    assert found["searched"] == ["local-b", "remote-a"] and set(found["latency_ms"]) == {"query_embed_ms", "cells_ms", "knn_ms", "fts_ms", "rrf_ms", "rerank_ms", "total_ms"}
    assert [r.rerank_score for r in found["results"].collect()] == [21.0, 12.0]  # a private candidate: the local scorer
    assert {(r.display_name, r.enrichment_status) for r in found["results"].collect()} == {("mem://a", "pending"), ("mem://b", "enriched")}
    assert engine.notebook_query(book, "secret", private=True)["excluded"] == ["remote-a"]
    with pytest.raises(policy.PrivacyError):
        policy.guard_remote(True, policy.REMOTE)


def test_sources_are_checked(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("inside")
    (tmp_path / "out.txt").write_text("outside")
    (tmp_path / "in" / "big.txt").write_text("x" * 200)
    (tmp_path / "in" / "p.pdf").write_bytes(b"one|two")
    engine = Engine(spark, str(tmp_path / "store"), source_root=str(tmp_path / "in"), size_cap=100, fetcher=lambda url: "<p>page</p><nav>menu</nav>", pdf_pages=lambda data: data.decode().split("|"))
    book = engine.notebook_create("n")["id"]
    states = {url: engine.source_add(book, url)["ingest_state"] for url in (str(tmp_path / "in" / "a.txt"), str(tmp_path / "out.txt"), str(tmp_path / "in" / "big.txt"), str(tmp_path / "in" / "p.pdf"), "http://10.0.0.1/", "http://example.org/x", "x.docx")}
    assert list(states.values()) == ["ready", "failed", "failed", "ready", "failed", "ready", "failed"]
    assert {r.text for r in engine.chunks().collect()} == {"inside", "one\ntwo", "page"}


def test_windows_and_dimensions_are_refused(spark, tmp_path):
    engine = Engine(spark, str(tmp_path / "store"), window_tokens=20)
    book = engine.notebook_create("n")["id"]
    added = engine.source_add(book, "mem://a", text="word " * 30)
    assert added["ingest_state"] == "failed" and "more than 20 tokens" in engine.source_status(added["source_id"])["summary"]
    assert engine.source_add(book, "mem://b", text="short")["ingest_state"] == "ready"
    engine.embedders = {k: lambda texts: [[1.0, 2.0] for _ in texts] for k in engine.embedders}
    other = engine.source_add(book, "mem://c", text="other length")
    assert other["ingest_state"] == "failed" and engine.chunks().count() == 1


def test_cached_profiles_are_tried_first(spark, tmp_path):
    engine = Engine(spark, str(tmp_path / "store"))
    book = engine.notebook_create("n")["id"]
    engine.source_add(book, "mem://a", text=statute())
    short = "".join(f"Section {i}. Title\nrule {i} " + "plain words " * 40 + "\n" for i in range(1, 5))
    docs = spark.createDataFrame([(1, short)], "doc long, txt string")
    assert [r.rung for r in structure.ladder(docs, engine.profiles())[1].collect()] == ["2-cache"]
    assert [r.rung for r in structure.ladder(docs, engine.profiles().where("false"))[1].collect()] == ["6-token"]
    assert structure.ladder(docs, engine.profiles())[0].count() == 4


def test_an_ingest_in_the_background_can_be_watched(spark, tmp_path):
    engine = Engine(spark, str(tmp_path / "store"))
    go, real = threading.Event(), engine._fetch
    engine._fetch = lambda *a: go.wait(60) and real(*a)
    book = engine.notebook_create("n")["id"]
    added = engine.source_add(book, "mem://a", text="some words", wait=False)
    assert added["ingest_state"] in ("pending", "ingesting") and engine.chunks().count() == 0
    go.set()
    for _ in range(300):
        if engine.source_status(added["source_id"])["ingest_state"] == "ready":
            break
        time.sleep(0.2)
    assert engine.chunks().count() == 1


def test_rate_limits_are_retried_and_counted():
    calls, pauses = [], []

    def limited():
        calls.append(1)
        if len(calls) < 3:
            raise RuntimeError("429 Too Many Requests")
        return "ok"

    runner = dispatch.Dispatcher(sleep=pauses.append)
    assert runner.run(limited, 400) == "ok" and len(calls) == 3 and len(pauses) == 2 and pauses[1] >= 2
    runner.run(lambda: None, 300)
    assert runner.tokens_per_minute == 700
    with pytest.raises(KeyError):
        dispatch.with_retry(lambda: {}["x"], sleep=pauses.append)
    with pytest.raises(RuntimeError):
        dispatch.with_retry(lambda: (_ for _ in ()).throw(RuntimeError("rate limit")), attempts=2, sleep=pauses.append)


def long_text(chunks=170):
    """Without headings, of about so many chunks."""
    return " ".join(f"word{i}" for i in range(412 * chunks + 60))


def failing(most):
    """A model that fails once it sees a word beyond this one."""

    def embed(texts):
        if any(int(t.split()[0].removeprefix("word")) > most for t in texts):
            raise ValueError("boom")
        return [[1.0, float(len(t))] for t in texts]

    return embed


def test_a_failure_keeps_the_windows_that_were_committed(spark, tmp_path):
    engine = Engine(spark, str(tmp_path / "store"), embedder=failing(60 * 412))
    book = engine.notebook_create("n")["id"]
    source = engine.source_add(book, "mem://a", text=long_text(), private=True)["source_id"]
    status = engine.source_status(source)
    assert status["ingest_state"] == "failed" and "boom" in status["summary"] and "partial results queryable" in status["summary"]
    assert status["chunks_embedded"] == 50 and status["chunks_total"] == 170 and status["queryable"]
    found = engine.notebook_query(book, "word7", private=True, mode="lexical")["results"]
    assert found.count() > 0 and all("word7" in r.text for r in found.collect())
    # a further ingest that fails later keeps nothing half, one that works replaces all
    engine.embedders = {k: failing(10**9) for k in engine.embedders}
    assert engine.source_refresh(book, source, text=long_text())["refreshed"]
    assert engine.source_status(source)["chunks_embedded"] == 170 and engine.commits().count() == 3
    engine.embedders = {k: failing(60 * 412) for k in engine.embedders}
    engine.source_refresh(book, source, text=long_text(180))
    status = engine.source_status(source)
    assert status["ingest_state"] == "failed" and status["chunks_embedded"] == 170
    index, totals = engine.postings()
    assert totals.first()["n"] == 170 and index.select("doc_id").distinct().count() == 170


def test_progress_can_be_seen_while_windows_are_embedded(spark, tmp_path):
    engine = Engine(spark, str(tmp_path / "store"), embedder=failing(10**9))
    book, seen, commit = engine.notebook_create("n")["id"], [], engine._commit

    def watched(row, *rest):
        seen.append(engine.source_status(row["id"]))
        return commit(row, *rest)

    engine._commit = watched
    source = engine.source_add(book, "mem://a", text=long_text(), private=True)["source_id"]
    assert [(s["ingest_state"], s["chunks_embedded"], s["chunks_total"], s["queryable"]) for s in seen] == [("ingesting", 0, 170, False), ("ingesting", 50, 170, True), ("ingesting", 150, 170, True)]
    stream = engine.progress_stream().writeStream.format("memory").queryName("progress").trigger(availableNow=True).start()
    stream.awaitTermination()
    rows = spark.table("progress").orderBy("part").collect()
    assert [(r.source_id, r.chunks, r.display_name) for r in rows] == [(source, 50, "mem://a"), (source, 100, "mem://a"), (source, 20, "mem://a")]


def test_threads_that_add_sources_get_their_own_numbers(spark, tmp_path):
    engine = Engine(spark, str(tmp_path / "store"))
    book, real, results = engine.notebook_create("n")["id"], engine.ingest, []
    engine.ingest = lambda source, text: None

    def add(url):
        try:
            results.append(engine.source_add(book, url, text="x")["source_id"])
        except EngineError:
            results.append("refused")

    threads = [threading.Thread(target=add, args=(url,)) for url in ("mem://a", "mem://b", "mem://a")]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(map(str, results)) == ["1", "2", "refused"]
    engine.source_delete(book, 2)
    assert engine.source_add(book, "mem://c", text="x")["source_id"] == 3
    engine.ingest = real


def test_a_fault_in_the_background_is_recorded(spark, tmp_path):
    def broken(texts):
        raise AssertionError("a fault of the program")

    engine = Engine(spark, str(tmp_path / "store"))
    engine._fetch = lambda *a: broken([])
    book = engine.notebook_create("n")["id"]
    with pytest.raises(AssertionError):
        engine.source_add(book, "mem://a", text="some words")
    assert engine.source_status(1)["ingest_state"] == "failed"


def test_a_fetcher_gets_the_check_for_redirects(spark, tmp_path):
    def fetch(url, check):
        check("http://169.254.169.254/latest")

    engine = Engine(spark, str(tmp_path / "store"), fetcher=fetch)
    book = engine.notebook_create("n")["id"]
    assert engine.source_add(book, "https://example.org/x")["ingest_state"] == "failed"
    assert "private hosts are not allowed" in engine.source_status(1)["ingest_error"]
