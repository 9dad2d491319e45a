"""Ids beyond 2**53 beside a null id, in one partition, through every operator."""

import random
import zlib

import pytest

import corpus_pipeline
from netloom.llm import alignment, filter_audit, html_extract, langid, lm_scoring, mixing, ngram_join, packing, quality, sharding, token_counts, warc

IDS = [2**60 + i for i in range(50)] + [2**53 + 1, 2**53 + 3, -(2**62) - 1]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    r = random.Random(3)
    say = lambda: " ".join("".join(r.choices("abcdefghijklm", k=r.randint(3, 7))) for _ in range(40))
    rows = [(i, say(), "en", "s", 1) for i in (*IDS[:20], None, *IDS[20:])]
    return spark.createDataFrame(rows, SCHEMA).coalesce(1)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, 1, 0) for i in IDS[:30]], "doc_id long, quality int, toxic int")


def ids(df, name="doc_id"):
    return sorted(r[0] for r in df.select(name).collect() if r[0] is not None), df.where(f"{name} IS NULL").count()


def test_every_operator_returns_the_ids_it_got(docs, labels):
    got = {
        "packing": packing.pack_documents(docs),
        "mixing": mixing.mixed(docs),
        "lm_scoring": lm_scoring.scores(docs, labels),
        "langid": langid.identify(docs, langid.fit_documents(docs)),
        "quality": quality.judge(docs, labels),
        "token_counts": token_counts.token_counts(docs),
        "ngram_join": ngram_join.similar(docs),
        "sharding": sharding.shard(docs),
        "alignment": alignment.align(docs),
    }
    for name, df in got.items():
        assert ids(df) == (sorted(IDS), 1), name
    components = ngram_join.similar(docs).where("doc_id IS NOT NULL").collect()
    assert all(r.doc_id == r.component_id for r in components)
    parts = filter_audit.audit(docs, labels).where("filter_order = 'ABCDE' AND step = 1").first()
    assert parts.kept + parts.removed == len(IDS) + 1


def test_pages(spark):
    rows = [(i, f"http://a.org/{n}", f"<html><body><p>text {n % 40} of the page</p></body></html>") for n, i in enumerate((*IDS[:9], None, *IDS[9:]))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    assert ids(html_extract.main_text(pages), "page_id") == (sorted(IDS), 1)
    read = warc.round_trip(pages)
    assert ids(read, "page_id") == (sorted(IDS), 1)
    first = {}
    for i, _, html in rows:
        if i is not None:
            first[html] = min(i, first.get(html, i))
    got = {r.page_id: r.refers_to for r in read.where("page_id IS NOT NULL").collect()}
    assert got == {i: None if first[h] == i else first[h] for i, _, h in rows if i is not None}
    assert any(v is not None for v in got.values())


def test_stages_keep_unlike_documents(spark, docs, labels, tmp_path):
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    rows = docs
    for _, stage in corpus_pipeline.STAGES[:3]:
        rows = stage(spark, rows, str(tmp_path))
        assert ids(rows) == (sorted(IDS), 1)
    out = corpus_pipeline.STAGES[4][1](spark, corpus_pipeline.STAGES[3][1](spark, rows, str(tmp_path)), str(tmp_path))
    assert ids(out.select("doc_id").distinct()) == (sorted(IDS), 1)


def test_hot_rows_fill_shards_of_packing_evenly(spark):
    rows = spark.createDataFrame([(None, "the same text")] * 4000, "doc_id long, text string").repartition(4)
    out = packing.pack_documents(rows, window=64, shard_docs=1000).collect()
    shards = [r.sequence_id >> 32 for r in out]
    assert len(out) == 4000 and set(shards) == {0, 1, 2, 3} and max(map(shards.count, range(4))) < 1200
    assert {r.ids_crc32 for r in out} == {out[0].ids_crc32} and zlib.crc32(b"") == 0
