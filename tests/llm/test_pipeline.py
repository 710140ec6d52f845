import public_tokenizers
from test_simhash import alike, shingles
from test_suffixes import plain

import corpus_pipeline
from feederlake.llm import crf, gam


def test_stages(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = [docs]
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path / name.replace(" ", "-"))
        stage(spark, kept[-1], folder).write.parquet(path)
        kept.append(spark.read.parquet(path))
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality classifier", "quality rules", "simhash near-dedup", "suffix-array dedup", "best-fit packing"]
    ids = [{r.doc_id for r in k.select("doc_id").collect()} for k in kept]
    assert all(k.dtypes == docs.dtypes for k in kept[:-1])
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    scored = gam.score(docs, gam.fit(docs, labels)).where("predicted = 1").select("row.doc_id").collect()
    assert ids[1] == {r.doc_id for r in scored}
    ruled = crf.judged(kept[1], crf.fit(docs, labels)).where("kept").select("row.doc_id").collect()
    assert ids[2] == {r.doc_id for r in ruled} and len(ids[2]) < len(ids[1])
    texts = {r.doc_id: r.text for r in kept[2].collect()}
    sets = {i: shingles(t) for i, t in texts.items()}
    assert all(alike(sets[a], sets[b]) < 0.8 for a in ids[3] for b in ids[3] if a < b)
    assert all(any(alike(sets[a], sets[b]) >= 0.8 for b in ids[2] if a != b) for a in ids[2] - ids[3])
    want = {r[0]: r[2].decode(errors="ignore") for r in plain([(i, texts[i]) for i in ids[3]], 200)}
    got = {r.doc_id: r for r in kept[4].collect()}
    assert {i: r.text for i, r in got.items()} == want and all(r.n_chars == len(r.text) for r in got.values())
    assert ids[5] == ids[4]
    assert kept[5].groupBy("sequence_id").agg({"length": "sum"}).where("`sum(length)` > 1024").count() == 0


def test_run(spark, folder):
    assert corpus_pipeline.run(spark, folder).count() > 0
    assert public_tokenizers.path("byte_bpe_50k.json")
    assert corpus_pipeline.ORACLE_SQL is None


def test_odd_rows_pass_every_stage(spark, folder, odd_docs):
    docs = odd_docs.select("doc_id", "text", "lang", "source", "n_chars")
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        assert docs.count() > 0, name


def test_empty_table_passes_every_stage(spark, folder, no_docs):
    docs = no_docs.select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in corpus_pipeline.STAGES:
        docs = spark.createDataFrame([], stage(spark, docs, folder).schema)
        assert docs.count() == 0


def test_rules_reject_boilerplate_that_reaches_them(spark, folder):
    folder = folder.replace("sf0.001", "sf0.01")
    docs, labels = (spark.read.parquet(f"{folder}/{n}.parquet") for n in ("documents", "labels"))
    junk = crf.judged(docs.join(labels.where("quality = 0"), "doc_id", "left_semi"), crf.Crf()).where("kept and n_words >= 50")
    planted = junk.select("row.*").selectExpr("doc_id + 1000000 AS doc_id", *docs.columns[1:])
    survivors = corpus_pipeline.quality_classifier(spark, docs, folder)
    kept = corpus_pipeline.quality_rules(spark, survivors.unionByName(planted), folder)
    assert planted.count() > 20
    assert kept.where("doc_id >= 1000000").count() < 0.15 * planted.count()
    assert kept.where("doc_id < 1000000").count() > 0.9 * survivors.count()
