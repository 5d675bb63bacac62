import hashlib

import corpus_pipeline
from rankflow.llm import bpe
from rankflow.llm.common import table, written

BASE = " ".join(f"word{i}" for i in range(60))
ITEM = "What is the name of the river that runs by the old mill town? It is the long grey river of the north."


def corpus(spark, path):
    docs = [
        (1, BASE), (2, BASE + " more"), (3, BASE), (4, "quite another text " + ITEM + " and so on with other things to say"),
        (5, "alpha\nbeta\ngamma\nfirst of all"), (6, "delta\nalpha\nbeta\ngamma\nlast line here"), (7, None), (8, ""), (9, "filth peasants " + " ".join(f"z{i}" for i in range(9))),
    ]
    train = [(100 + i, ("filth " if i % 2 else "kind ") + f"filler{i} a{i * 7} b{i * 11} c{i * 13}") for i in range(40)]
    docs = [(i, t, "en", "s", len(t or "")) for i, t in docs + train]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    labels = [(i, 1, int("filth" in t)) for i, t in train]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")


def test_each_stage_takes_effect(spark, tmp_path):
    path = str(tmp_path)
    corpus(spark, path)
    docs, columns = table(spark, path, "documents"), None
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        columns = docs.columns
        docs = stage(spark, docs, path)
        docs.write.parquet(f"{path}/out{len(seen)}")
        docs = spark.read.parquet(f"{path}/out{len(seen)}")
        seen.append({r.doc_id: r for r in docs.collect()})
        if len(seen) < 5:
            assert docs.columns == columns
    toxic, lines, near, leaks, tokens = seen
    assert 9 not in toxic and 101 not in toxic and 100 in toxic and {1, 2, 3, 4, 5, 6, 7, 8} <= set(toxic)
    assert lines[5].text == "alpha\nbeta\ngamma\nfirst of all" and lines[6].text == "delta\nlast line here" and lines[6].n_chars == 20
    assert 1 in near and 2 not in near and 3 not in near and {4, 5, 6, 7, 8} <= set(near)
    assert 4 not in leaks and set(near) - {4} == set(leaks)
    path50 = corpus_pipeline.public_tokenizers.path("byte_bpe_50k.tiktoken")
    for row in tokens.values():
        ids = bpe.encode_text(row.text or "", path50, corpus_pipeline.public_tokenizers.PATTERN)
        assert bytes(row.token_ids) == ids and row.n_tokens == len(ids) // 4
        assert row.decoded_sha256 == hashlib.sha256((row.text or "").encode()).hexdigest()
    assert set(tokens) == set(leaks)


def test_empty_tables(spark, tmp_path):
    path = str(tmp_path)
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, path).count() == 0


def test_clashing_columns_pass_through(spark, tmp_path):
    path = str(tmp_path)
    corpus(spark, path)
    names = ["Score", "N_Lines", "n_removed", "kept_text", "Component", "component_id", "n_shingles", "Leaks", "bpe_ids", "doc", "key", "node", "label", "h"]
    docs = table(spark, path, "documents").drop("n_chars").where("doc_id < 20")
    for i, name in enumerate(names):
        docs = docs.selectExpr("*", f"concat('{i}:', doc_id) AS `{name}`")
    columns = docs.columns
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        docs = written(stage(spark, docs, path))
        assert docs.columns == columns
        for row in docs.collect():
            assert all(row[name] == f"{i}:{row.doc_id}" for i, name in enumerate(names))
    last = corpus_pipeline.tokenise(spark, docs.selectExpr("*", "'x' AS N_Tokens", "1 AS token_IDS"), path)
    assert last.columns == [*columns, "n_tokens", "token_ids", "decoded_sha256"] and all(isinstance(r.n_tokens, int) and r.Score == f"0:{r.doc_id}" for r in last.collect())


def test_labels_of_one_class_and_texts_without_words(spark, tmp_path):
    path = str(tmp_path)
    corpus(spark, path)
    docs = table(spark, path, "documents")
    spark.createDataFrame([(i, 1) for i in range(100, 140)], "doc_id long, toxic int").write.parquet(f"{path}/one/labels.parquet")
    assert corpus_pipeline.drop_toxic(spark, docs, f"{path}/one").count() == docs.count()
    spark.createDataFrame([(100 + i, int(i != 0)) for i in range(40)], "doc_id long, toxic int").write.parquet(f"{path}/most/labels.parquet")
    blank = spark.createDataFrame([(1, None), (2, ""), (3, " !? ")], "doc_id long, text string")
    assert corpus_pipeline.drop_toxic(spark, docs.select("doc_id", "text").unionByName(blank), f"{path}/most").where("doc_id < 4 and (text is null or length(text) < 5)").count() == 3
