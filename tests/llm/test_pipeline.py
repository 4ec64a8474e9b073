"""The pipeline on planted documents, against plain loops."""

import random

import corpus_pipeline
from wordtide.llm import line_dedup


def test_planted_documents(spark, tmp_path):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 7)))
    texts = [" ".join(word() for _ in range(60)) for _ in range(150)]
    toxic = set(range(0, 150, 5))
    for i in toxic:
        texts[i] += f" {rng.choice(['grubwort', 'grubworm'])} " + word()
    shared = " ".join(word() for _ in range(8))
    texts[11] += "\n" + shared
    texts[12] += "\n" + shared
    near = texts[21].split(" ")
    near[30] = "changed"
    texts += [texts[21], " ".join(near), "", texts[0]]
    rows = [(i, t, "en", f"src{i % 3}", len(t)) for i, t in enumerate(texts)]
    names = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, names).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(i in toxic)) for i in range(150)], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))

    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if k < 4:
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / f"stage{k}"))
        docs = spark.read.parquet(str(tmp_path / f"stage{k}"))
        kept[name] = {r["doc_id"]: r for r in docs.collect()} if k < 4 else docs.collect()
    clean = {i for i in range(154) if i not in toxic and i != 153}
    assert set(kept["toxicity"]) == clean
    want = line_dedup.brute_force([(i, texts[i]) for i in clean])
    for i in clean:
        left = kept["line_dedup"][i]["text"] or ""
        assert len((texts[i] or "").split("\n")) == want[i][0] and (left == texts[i]) == (want[i][1] == 0)
    assert set(kept["ngram_jaccard_join"]) == {i for i in clean if i != 151} and set(kept["mixing"]) == set(kept["ngram_jaccard_join"])
    packed = kept["best_fit_packing"]
    assert {r["doc_id"] for r in packed} == set(kept["mixing"])
    first: dict = {}
    for r in packed:
        first.setdefault(r["sequence_id"], set()).add(r["sequence_order"])
    assert all(len(x) == 1 for x in first.values())
    run = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted((r["doc_id"], r["piece"], r["ids_crc32"]) for r in run.collect()) == sorted((r["doc_id"], r["piece"], r["ids_crc32"]) for r in packed)
