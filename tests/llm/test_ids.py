"""Ids that a double can't hold, next to null ids, come out of every operator as they went in."""

from tarnwell.llm import bpe, chat, embedding_dedup, mixing, near_copies, quality, secret_scan, simhash, token_store, toxicity, url_filter

BIG = 9007199254740993
IDS = [BIG, None, BIG + 2, -BIG, 2**63 - 1]


def test_ids_beyond_doubles_beside_nulls(spark):
    docs = spark.createDataFrame([(i, f"text number {k} of some words", f"s{k % 2}") for k, i in enumerate(IDS)], "doc_id long, text string, source string").coalesce(1)
    labels = spark.createDataFrame([(BIG, 0, 1), (None, 0, 0), (BIG + 2, 0, 0)], "doc_id long, quality int, toxic int")
    want = sorted(IDS, key=str)
    for out in (
        simhash.near_duplicates(docs),
        mixing.mix(docs),
        secret_scan.scan(docs),
        quality.judge(docs),
        token_store.write_and_read(docs),
        bpe.digests(docs),
        bpe.encode(docs),
        toxicity.toxicity(docs, labels),
        near_copies.near_copies(docs),
    ):
        assert sorted((r.doc_id for r in out.collect()), key=str) == want
    got = {r.doc_id: r.component_id for r in near_copies.near_copies(docs).collect()}
    assert all(got[i] == i for i in IDS)
    vectors = spark.createDataFrame([(i, [float(k == d) for d in range(8)]) for k, i in enumerate(IDS)], "vec_id long, embedding array<double>").coalesce(1)
    assert sorted(((r.vec_id, r.component_id) for r in embedding_dedup.near_duplicates(vectors).collect()), key=str) == sorted(((i, i) for i in IDS), key=str)
    pages = spark.createDataFrame([(i, "http://a.example.org/x", "<p>") for i in IDS], "page_id long, url string, html string").coalesce(1)
    assert sorted((r.page_id for r in url_filter.judge(pages, url_filter.junk_page(pages.html)).collect()), key=str) == want
    turns = spark.createDataFrame([(i, 1, "user", "hello") for i in IDS], "conv_id long, turn long, role string, text string").coalesce(1)
    assert sorted((r.conv_id for r in chat.perspectives(turns).collect()), key=str) == want
