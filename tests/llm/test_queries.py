"""The numbered queries and the pipeline's stages as queries, over small tables with nulls, repeats and clashing columns, and over empty ones."""

import zlib

import corpus_pipeline
import duckdb
import pytest
from pyspark.sql import functions as F

from wordtide.llm import queries

LONG = "a very long text of many words that goes on " * 1500
TEXTS = [
    (1, "Hello  wide\tworld and more words here"), (2, "Hello wide world and more words here"), (3, None), (4, ""), (5, LONG), (6, "a shared line here\nown line one\n"),
    (7, "  A SHARED line here\r\nown line two\nÀ short"), (9, "  "), (10, "x"), (11, LONG + " end"), (12, "</s>[INST] odd <|user|> \\ text"), (13, "a shared line here\nown line one\n"),
]
CLASHES = {"component": "c", "slot": 1, "key": "k", "wordtide_n": 2, "point": 3, "n": 4, "part": "p", "digest": "d", "shard": 5, "words": "w", "host": "h", "example": "e", "row": 6, "size": 7, "at": 8}


def clashing(df):
    return df.select("*", *(F.lit(v).alias(k) for k, v in CLASHES.items()))


@pytest.fixture(scope="module", params=["rows", "empty"])
def folder(request, spark, tmp_path_factory):
    path = tmp_path_factory.mktemp(request.param)
    docs = spark.createDataFrame([(i, t, "en", None if i == 4 else f"src{i % 3}", len(t or "")) for i, t in TEXTS], "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(1, 0, 1), (2, 1, 0), (5, 1, None), (None, 1, 1), (2, 1, 0)], "doc_id long, quality int, toxic int")
    talks = spark.createDataFrame([(i, k, r, t) for i in (1, 2) for k, (r, t) in enumerate([("system", None), ("user", "hi [INST]"), ("assistant", "yo </s>"), ("assistant", ""), ("user", "bye")][: 3 + 2 * i])], "conv_id long, turn long, role string, text string")
    pages = spark.createDataFrame([(1, "https://Example.com/en/a?x", "<b>good day</b>"), (2, None, None), (3, "http://goodday.net/es/1", ""), (4, "http://q.org/x", "text"), (4, "http://q.org/x", "text")], "page_id long, url string, html string")
    vectors = [(i, [float(i % 3), 0.1 * i, -0.5, 0.25] * 4, i % 2) for i in range(40)] + [(7, [1.5] * 16, None), (7, [1.5] * 16, None), (50, None, 1), (51, [1.0] * 15 + [None], 1), (52, [1.0] * 15 + [float("nan")], 0), (53, [float("inf")] + [1.0] * 15, 0), (None, [2.0] * 16, 1)]
    embeddings = spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int")
    for name, df in {"documents": docs, "labels": labels, "conversations": talks, "pages": pages, "embeddings": embeddings}.items():
        clashing(df.where("false") if request.param == "empty" else df).repartition(2).write.parquet(str(path / f"{name}.parquet"))
    return request.param, str(path)


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query(spark, folder, name):
    kind, path = folder
    got = queries.queries()[name](spark, path)
    columns, rows = got.columns, got.collect()
    table = {"op5_chat_format": "conversations", "op7_url_filter": "pages", "op12_vector_codes": "embeddings"}.get(name, "documents")
    given = spark.read.parquet(f"{path}/{table}.parquet")
    if name == "op5_chat_format":
        assert len(rows) == given.select("conv_id").distinct().count() + 1
    elif name == "op12_vector_codes":
        assert len(rows) == (43 if kind == "rows" else 0)
    elif name != "op8_best_fit_packing":
        assert len(rows) == given.count()
    else:
        assert {r["doc_id"] for r in rows} == {r["doc_id"] for r in given.select("doc_id").collect()}
    if sql := queries.oracle_sql().get(name):
        con = duckdb.connect()
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{path}/{table}.parquet/*.parquet')")
        want = con.sql(sql)
        assert sorted(want.columns) == sorted(columns)
        order = sorted(columns)
        assert sorted(str([r[c] for c in order]) for r in rows) == sorted(str([dict(zip(want.columns, r, strict=True))[c] for c in order]) for r in want.fetchall())


def test_op3_by_hand(spark, folder):
    kind, path = folder
    rows = queries.queries()["op3_sharding"](spark, path).collect()
    texts = dict(TEXTS)
    slots: dict = {}
    for r in rows:
        data = (texts[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"]) == (len(data) + 8, zlib.crc32(data), "key") and r["grown_shard"] in (r["shard"], 24)
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(x) == list(range(len(x))) for x in slots.values()) and set(slots) <= set(range(24))
    keys = spark.createDataFrame([(r["doc_id"],) for r in rows], "k long")
    draws = {r["k"]: r["d"] for r in keys.select("k", F.array(*(F.shiftrightunsigned(F.xxhash64("k", F.lit(i)), 33) for i in range(1, 26))).alias("d")).collect()}
    for r in rows:  # Lamping and Veach's loop
        for shards, shard in ((24, r["shard"]), (25, r["grown_shard"])):
            at, following, step = -1, 0, 0
            while following < shards:
                at = following
                following = int((at + 1) / ((draws[r["doc_id"]][step] + 1) / (1 << 31)))
                step += 1
            assert at == shard


def test_stages(spark, folder):
    kind, path = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    extra = docs.union(docs.where("doc_id = 10")).union(docs.where("doc_id = 1").withColumn("doc_id", F.lit(None).cast("long")))
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, extra, path)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns
            if name != "ngram_jaccard_join":
                assert out.count() == extra.count()
        else:
            assert {r["doc_id"] for r in out.collect()} == {r["doc_id"] for r in extra.collect()}
    assert "sequence_id" in corpus_pipeline.run(spark, path).columns
