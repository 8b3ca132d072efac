import json
import re
import time

import public_tokenizers
import tiktoken
from pyspark.sql import functions as F

from shelfmark.operators import chunking, structure, tokens


def frame(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc long, txt string")


def report(sections=6, words=20):
    return "preamble\n" + "".join(f"Article {i}. Title\n" + "word " * (6000 if i == 3 else words) + "\n" for i in range(1, sections + 1))


def test_signatures_ignore_stop_words_case_and_odd_second_tokens(spark):
    docs = frame(spark, "Part 1\nPART 2\npart 3\nPart. 4\nPart 12a\nДо 31\nSection IV\nx")
    got = {(r.low, r.cls): (r.n, r.keyword) for r in structure.signatures(docs).collect()}
    assert got == {("part", "<NUM>"): (3, "Part"), ("section", "<ROM>"): (1, "Section")}


def test_breadcrumbs_drop_levels_ended_by_coarser_headings(spark):
    text = "Part 1\na\nItem 1\nb\nItem 2\nc\nPart 2\nd\nItem 3\ne\nItem 4\nItem 5\nPart 3\nPart 4\nPart 5\nItem 6\n"
    docs = frame(spark, text)
    rows = structure.induced(docs).orderBy("start_off").collect()
    assert [r.breadcrumb for r in rows][:4] == ["part 1", "part 1 › item 1", "part 1 › item 2", "part 2"]
    assert rows[0].start_off == 0 and rows[-1].end_off == len(text)
    assert all(a.end_off == b.start_off for a, b in zip(rows, rows[1:]))


def test_gate_accepts_sound_cuts_and_rejects_flat_text(spark):
    docs = frame(spark, report(), "no headings here. " * 50)
    cut = structure.induced(docs)
    got = {r.doc: r for r in structure.gate(docs, cut).collect()}
    assert got[0].passed and got[0].n == 6 and not got[1].passed and got[1].n == 0


def test_regional_repair_splits_oversized_segments_and_loses_no_text(spark):
    inner = "lead in\n" + "".join(f"Item {i}\n" + "x " * 300 + "\n" for i in range(1, 4))
    text = "".join(f"Part {i}\n" + (inner if i == 2 else "y\n") for i in range(1, 7))
    docs = frame(spark, text)
    cut = structure.segments(docs, structure.headings(docs, structure.mine(structure.signatures(docs))))
    rows = structure.regional(docs, cut, ceiling=1000).orderBy("start_off").collect()
    assert [r.breadcrumb for r in rows][1:5] == ["part 2", "part 2 › item 1", "part 2 › item 2", "part 2 › item 3"]
    assert rows[0].start_off == 0 and rows[-1].end_off == len(text)
    assert all(a.end_off == b.start_off for a, b in zip(rows, rows[1:]))


def test_chunks_stay_below_the_cap_and_give_the_text_back(spark):
    docs = frame(spark, report())
    rows = chunking.chunk_rows(docs, structure.induced(docs)).orderBy("chunk_index").collect()
    assert max(r.n_tokens for r in rows) <= 512 and sum(r.structural for r in rows) > 5
    assert not rows[0].structural and rows[0].breadcrumb is None and rows[0].text == "preamble\n"
    assert [r.chunk_index for r in rows] == list(range(len(rows)))
    assert all(r.text in report() for r in rows)


def test_pieces_overlap_and_stop_at_the_end(spark):
    text = " ".join(f"w{i}" for i in range(1000))
    rows = frame(spark, text).select(F.explode(chunking.pieces(F.col("txt"))).alias("p")).select("p.*").collect()
    assert [(r.piece, r.n_tokens) for r in rows] == [(0, 512), (1, 512), (2, 176)]
    assert rows[1].text.startswith("w412 ") and rows[2].text.endswith("w999")


def test_embedding_sees_one_window_at_a_time(spark):
    chunks = spark.range(120).selectExpr("0L as doc", "id as chunk_index", "concat('t', id) as text")
    sizes = chunking.embed(chunks, lambda texts: [[float(len(texts))] for _ in texts]).groupBy(F.col("embedding")[0].alias("size")).count().collect()
    assert {(r["size"], r["count"]) for r in sizes} == {(50.0, 100), (20.0, 20)}


def nested(parts, deep):
    """Parts of which one has sections that none of the others have, with more items than there are parts."""
    item = lambda i: f"Item {i}\n" + "words here " * 25 + "\n"
    section = lambda k: f"Section {k}\n" + "".join(item(i) for i in range(1, 6))
    return "".join(f"Part {p}\n" + ("".join(section(k) for k in range(1, 5)) if p == deep else "y " * 400 + "\n") for p in range(1, parts + 1))


def test_levels_of_a_region_refine_the_profile(spark):
    docs = frame(spark, nested(6, 3))
    base = spark.createDataFrame([(0, 0, "part", "Part", "<NUM>"), (0, 1, "item", "Item", "<ROM>")], "doc long, lv int, low string, keyword string, cls string")
    found = spark.createDataFrame([(0, 900, 0, 0, "section", "Section", "<NUM>"), (0, 900, 0, 1, "item", "ITEM", "<ROM>"), (0, 950, 1, 0, "item", "Item", "<NUM>")], "doc long, start_off long, depth int, lv int, low string, keyword string, cls string")
    rows = structure.refined(docs.withColumn("doc", F.lit(0).cast("long")), base, found).orderBy("lv").collect()
    # 4 sections, 6 parts, 20 items; the last region's form of an item counts
    assert [(r.lv, r.low, r.keyword, r.cls) for r in rows] == [(0, "section", "Section", "<NUM>"), (1, "part", "Part", "<NUM>"), (2, "item", "Item", "<NUM>")]


def test_a_second_text_takes_the_refined_profile_from_the_cache(spark):
    section = lambda k: f"Section {k}\n" + "words here " * 60 + "\n"
    text = lambda parts, deep: "".join(f"Part {p}\n" + ("".join(map(section, range(1, 5))) if p == deep else "y " * 400 + "\n") for p in range(1, parts + 1))
    first, second = frame(spark, text(6, 3)), frame(spark, text(7, 2))
    cache = structure.shipped_profiles(spark)
    cut, rung, kept = structure.ladder(first, cache, ceiling=1500)
    assert [r.rung for r in rung.collect()] == ["3-linemine-regional"] and max(r.end_off - r.start_off for r in cut.collect()) <= 1500
    keys = structure.fingerprints(first, structure.signatures(first))
    for levels in kept:
        cache = cache.unionByName(structure.variants(keys, levels).select("fingerprint", "variant", "levels"))
    assert cache.count() == 3
    assert [r.rung for r in structure.ladder(second, cache, ceiling=1500)[1].collect()] == ["2-cache"]


def test_pieces_of_vocabulary_tokens_are_slices_of_the_text(spark):
    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    ranks = tokens.load_ranks(spark, path)
    library = tiktoken.Encoding("x", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    texts = ["", None, "short", "naïve çalışma 日本語 🙂🙃 " * 60, "".join(chr(0x4E00 + 7 * i % 9000) for i in range(400)), "plain words " * 500]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    rows = tokens.token_pieces(df, tokens.byte_pairs(spark, path, pattern), 50, 40).orderBy("id", "piece").collect()
    for i, text in enumerate(texts):
        ids, mine = library.encode_ordinary(text or ""), [r for r in rows if r.id == i]
        assert len(mine) == (max(0, -(-(len(ids) - 50) // 40)) + 1 if ids else 0)
        for r in mine:
            assert r.text == text[r.piece_start : r.piece_end]
            want = library.decode_bytes(ids[r.piece * 40 : r.piece * 40 + 50])
            assert r.n_tokens == len(ids[r.piece * 40 : r.piece * 40 + 50]) and want in r.text.encode()
            assert len(r.text.encode()) - len(want) <= 6  # parts of a character at either end
    whole = tokens.token_pieces(df, tokens.words, 50, 40).orderBy("id", "piece").collect()
    plain = df.select("id", F.explode(chunking.pieces(F.col("text"), 50, 40)).alias("p")).select("id", "p.*").orderBy("id", "piece").collect()
    assert [(r.id, r.piece, r.n_tokens, r.text) for r in whole] == [(r.id, r.piece, r.n_tokens, r.text) for r in plain]
    cut = chunking.chunk_rows(frame(spark, "plain words " * 500), structure.induced(frame(spark, "plain words " * 500)), 50, 40, tokens.byte_pairs(spark, path, pattern))
    assert cut.agg(F.max("n_tokens")).first()[0] == 50


def test_patterns_of_profile_files_are_bounded_and_merged(spark, tmp_path):
    one, two = tmp_path / "one", tmp_path / "two"
    for folder in (one, two):
        folder.mkdir()
    (one / "a.json").write_text(json.dumps({"fingerprint": "art|<NUM>", "levels": [{"name": "art", "pattern": "old"}, {"name": "par", "pattern": "x"}]}))
    (two / "a.yaml").write_text('fingerprint: "art|<NUM>"\nlevels:\n  - name: art\n    pattern: "Art\\\\.\\\\s+(\\\\d+)"\n  - name: par\n    pattern: "§\\\\s*(\\\\w+)"\n')
    (two / "broken.yaml").write_text("levels: [")
    (two / "other.json").write_text('{"levels": []}')
    (two / "list.json").write_text("[1, 2]")
    rows = structure.profile_files(spark, str(one), str(two)).collect()
    assert [(r.fingerprint, r.variant) for r in rows] == [("art|<NUM>", "art|<NUM>::art+par")]
    assert [x.pattern for x in rows[0].levels] == [r"Art\.\s+(\d+)", r"§\s*(\w+)"]
    assert structure.profile_files(spark, str(two)).count() == 1

    text = "Art. 1\nwords\n§ a\n" + "a" * 40 + "!\nArt. 22 more\nNote 7\n"
    docs = frame(spark, text)
    kept = [(0, i, x.name, None, None, x.pattern) for i, x in enumerate(rows[0].levels)]
    bad = [(0, 2, "slow", None, None, "(a+)+$"), (0, 3, "wrong", None, None, "("), (0, 4, "note", "Note", "<NUM>", None)]
    found = spark.createDataFrame(kept + bad, "doc long, lv int, low string, keyword string, cls string, pattern string")
    began = time.monotonic()
    got = [(r.off, r.lv, r.label) for r in structure.headings(docs, found).orderBy("off").collect()]
    want = [(m.start(), lv, f"{name} {m[1]}") for lv, name, p in ((0, "art", r"(?m)^Art\.\s+(\d+)"), (1, "par", r"(?m)^§\s*(\w+)"), (4, "note", r"(?m)^Note (\d+)")) for m in re.finditer(p, text)]
    assert got == sorted(want) and time.monotonic() - began < 60
