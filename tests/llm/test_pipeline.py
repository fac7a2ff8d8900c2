"""The pipeline's stages one after another on planted cases, and the queries' columns on driver tables."""

import os
import random

import pytest

SF = "/root/testdata/sf0.001"
INSULTS = ["worthless", "disgusting", "pathetic"]


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    rng = random.Random(8)
    d = tmp_path_factory.mktemp("sf")
    text = lambda n, bad=None: " ".join([f"{rng.choice('bcdfglmnprst')}{rng.choice('aeiou')}{rng.choice('lmnrst')}{rng.choice('aeiou')}{rng.randrange(50)}" for _ in range(n)] + ([bad] if bad else []) + ["end"])
    rows, labels = [], []
    for i in range(300):
        toxic = i % 4 == 0
        rows.append((i, text(40, INSULTS[i % 3] if toxic else None), "en", f"s{i % 3}", 0))
        labels.append((i, 1, int(toxic)))
    passage = text(30)
    rows += [(400, rows[1][1], "en", "s1", 0), (401, rows[2][1] + " x", "en", "s2", 0), (500, "q " + passage, "en", "s0", 0)]
    rows += [(600 + i, "shared footer line\n" + text(60), "en", "s0", 0) for i in range(10)]
    rows += [(700, None, None, None, None), (701, "", "en", "s0", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return str(d)


def test_stages(spark, planted):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{planted}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in P.STAGES:
        before, docs = docs, P.materialise(stage(spark, docs, planted), "test")
        if name != "packing":
            assert docs.columns == columns and docs.schema.simpleString() == before.schema.simpleString()
        seen[name] = {r["doc_id"]: r for r in docs.collect()}
    kept = set(seen["toxicity"])
    assert sum(i % 4 == 0 for i in kept if i < 300) <= 15 and sum(i % 4 != 0 for i in kept if i < 300) >= 215
    assert all("footer" not in seen["line dedup"][600 + i]["text"] for i in range(10) if 600 + i in seen["line dedup"]) and set(seen["line dedup"]) == kept
    assert 400 not in seen["near duplicates"] and 701 not in seen["near duplicates"] and 700 in seen["near duplicates"]
    assert 500 in seen["near duplicates"] and 500 not in seen["decontamination"]
    assert set(seen["packing"]) == set(seen["decontamination"])
    run = P.run(spark, planted).collect()
    assert {r["doc_id"] for r in run} == set(seen["packing"]) and sum(r["length"] for r in run) == sum({r["doc_id"]: r["doc_tokens"] for r in run}.values())


@pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables here")
def test_queries_have_the_contract_columns(spark):
    import __spark_entry__ as e

    want = {
        "op1_toxicity": "doc_id held_out score predicted", "op2_simhash": "doc_id fingerprint component_id", "op3_decontamination": "doc_id n_words n_hit n_items items_sha256 contaminated",
        "op4_quality": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept", "op5_langid": "doc_id held_out lang_pred score", "op6_linededup": "doc_id n_lines n_dropped text_sha256",
        "op7_urlfilter": "page_id host path rule verdict", "op8_packing": "doc_id start length ids_crc32 doc_tokens sequence_id offset", "op9_toolchat": "conv_id turn part kind call_id depth linked valid json",
        "op10_pii": "doc_id n_email n_ip n_card n_phone base_sha256 spans n_iban n_ssn n_secret scores",
        "op11_prefixtrie": "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256", "op12_idfiles": "doc_id start n_tokens ids_crc32", "op13_divergence": "lang source part item value rank",
    }
    assert {n for n in e.queries() if n.startswith("op") and n[2].isdigit()} == set(want)
    for name, columns in want.items():
        got = e.queries()[name](spark, SF)
        assert got.columns == columns.split() and got.count() > 0, name


@pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables here")
def test_queries_equal_their_sql(spark):
    import duckdb

    from lexfold.llm import queries

    duck = duckdb.connect()
    for t in "documents embeddings pages benchmark labels conversations".split():
        duck.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    for name, sql in queries.ORACLE_SQL.items():
        df = queries.QUERIES[name](spark, SF)
        columns, rel = sorted(df.columns), duck.sql(sql)
        names = list(rel.columns)
        assert sorted(names) == columns
        assert sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr) == sorted((tuple(r[names.index(c)] for c in columns) for r in rel.fetchall()), key=repr), name
