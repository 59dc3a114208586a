"""The pipeline on planted cases, and every query on the smallest tables."""

import random

import corpus_pipeline
from faultline.llm import queries


def test_stages_act(spark, tmp_path):
    rng = random.Random(4)
    vocabulary = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 7))) for _ in range(800)]

    def prose(n):
        w = [rng.choice(vocabulary) for _ in range(n)]
        return " ".join(x + "." if k % 7 == 6 else x for k, x in enumerate(w))

    passage, leak = prose(60), " ".join(rng.choice(vocabulary) for _ in range(14))
    rows = [(i, prose(80), ["en", "de"][i % 2], "s", 1, "x") for i in range(30)]
    rows += [(40, rows[3][1], "en", "s", 1, "x"), (41, rows[4][1].replace(" ", "  ", 3) + " tail", "en", "s", 1, "x"), (42, "?! 123", "en", "s", 1, "x"), (43, prose(40) + " " + leak + ".", "en", "s", 1, "x")]
    rows += [(50 + k, prose(30) + ". " + passage + " " + prose(30), "en", "s", 1, "x") for k in range(3)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, spans string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{len(seen)}")
        docs = spark.read.parquet(f"{tmp_path}/{len(seen)}")
        seen.append({r.doc_id: r for r in docs.collect()})
        assert docs.columns == columns or name == "packing"
    clean = {r[0] for r in rows if r[0] < 30}
    assert set(seen[0]) == {r[0] for r in rows} - {42}
    assert set(seen[1]) == set(seen[0]) - {40, 41}
    assert set(seen[2]) == set(seen[1])
    middle = " ".join(passage.split()[7:49])
    assert [middle in seen[2][50 + k].text for k in range(3)] == [True, False, False]
    assert all(seen[2][i].text == next(r[1] for r in rows if r[0] == i) for i in clean)
    assert set(seen[3]) == set(seen[2]) - {43}
    assert set(seen[4]) == set(seen[3])
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == sorted(r.doc_id for r in docs.collect())


def test_empty_tables(spark, tmp_path, sf):
    for table in ("documents", "benchmark", "embeddings", "conversations"):
        spark.read.parquet(f"{sf}/{table}.parquet").limit(0).write.parquet(f"{tmp_path}/{table}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    for name, q in queries.QUERIES.items():
        assert q(spark, str(tmp_path)).count() == 0, name


def test_queries_give_the_columns_asked_for(spark, sf):
    asked = {
        "op1": "doc_id held_out lang_pred score", "op2": "doc_id start length ids_crc32 doc_tokens sequence_id offset", "op3": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
        "op5": "doc_id start n_tokens ids_crc32", "op8": "doc_id n_words n_hit n_items items_sha256 contaminated", "op9": "doc_id held_out n_tokens n_known train_tokens base_score score",
        "op11": "doc_id size source_size target taken", "op12": "vec_id component n deviation whitened explained identity_error",
        "op13": "conv_id gaps blank duplicate truncated illegal cost audit repaired_sha256",
    }
    for k, columns in asked.items():
        (name,) = (n for n in queries.QUERIES if n.startswith(k + "_"))
        assert set(columns.split()) <= set(queries.QUERIES[name](spark, sf).columns)
