"""The pipeline on a small folder of tables: every stage's decision takes effect and clean documents stay."""

import random

import corpus_pipeline
from marketloom.llm import queries

WORDS = [f"w{i}" for i in range(500)]


def prose(seed, n):
    return " ".join(random.Random(seed).choices(WORDS, k=n))


def test_pipeline(spark, tmp_path):
    shared, item = prose(1, 60), prose(2, 30)
    rows = [(i, prose(i + 10, 120), "en", f"s{i % 3}", 1) for i in range(60)]
    rows += [(100, "you idiot moron scum " + prose(900, 60), "en", "s0", 1)]
    rows += [(110, rows[0][1], "en", "s0", 1), (111, rows[1][1].replace("w1 ", "x ", 1), "en", "s0", 1)]
    rows += [(120 + k, prose(950 + k, 80) + " " + shared + " " + prose(970 + k, 40), "en", "s1", 1) for k in range(3)]
    rows += [(130, prose(990, 50) + " " + item + " " + prose(991, 50), "en", "s2", 1), (140, None, "en", None, None), (141, "", None, "s0", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(100, 1, 1), (0, 1, 0), (1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(range(60)) <= set(got) and {120, 121, 122, 140, 141} <= set(got)
    assert not {100, 110, 111, 130} & set(got)
    assert got[121]["size"] == 120 and got[120]["size"] == 180


def test_stages_on_odd_tables(spark, tmp_path):
    """Nulls everywhere, repeated rows, conflicting labels, clashing column names, and no rows at all."""
    rows = [(i, prose(i, 90), "en", "s", 1) for i in range(12)] + [(3, prose(3, 90), None, None, None), (None, prose(5, 70), None, None, None), (None, None, "en", "s", 0), (20, None, "en", None, 0), (21, "", "en", "s", 0), (22, "you idiot " + prose(7, 20), "en", "s", 1), (23, prose(2, 12000), "en", "t", 1)]
    names = ["held", "of", "stays", "nth", "cuts", "toxicity", "_nth", "key", "id", "y", "x", "salt"]
    full = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", *[f"'c' as {n}" for n in names])
    spark.createDataFrame([(0, 1, 0), (0, 1, 1), (1, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, prose(4, 40)), (None, None), (2, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for docs in (full, full.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, str(tmp_path))
            kept = out.collect()
            if name != "mixing":
                assert out.columns == docs.columns, name
                ids = sorted(str(r["doc_id"]) for r in kept)
                assert all(r["toxicity"] == "c" for r in kept)
                if docs is full:
                    assert ids.count("None") == 2 and "20" in ids, name
                    assert ("22" in ids) == (name != "toxicity") and ids.count("3") == (1 if name == "near_dedup" else 2), name
                    assert ("4" in ids) == (name != "decontamination"), name
            else:
                assert len(kept) == docs.count()


def test_every_query_is_registered():
    assert sorted(int(k[2:].split("_")[0]) for k in queries.QUERIES) == list(range(1, 14))
    assert set(queries.ORACLE_SQL) <= set(queries.QUERIES)
