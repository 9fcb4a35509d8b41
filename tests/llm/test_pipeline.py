"""The stages one after the other on documents with planted cases, against what each must do."""

import hashlib
import random

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline

LANGUAGES = {"en": "the of and to in that is was for on with as by at from", "de": "der die und das nicht von mit auf dem ist im sich auch als"}
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, _text string, _k1 int, score double, _row string"


def clean_text(rng, lang):
    tail = "abcdefghij" if lang == "en" else "klmnopqrst"
    words = [rng.choice(LANGUAGES[lang].split()) if rng.random() < 0.6 else "".join(rng.choice(tail) for _ in range(6)) for _ in range(60)]
    return " ".join(words).capitalize() + "."


def planted():
    rng = random.Random(21)
    passage = " ".join(f"question{i}" for i in range(20))
    rows, stays = [], {}
    for i in range(60):
        lang = ("en", "de")[i % 2]
        rows.append((i, clean_text(rng, lang), lang))
        stays[i] = rows[-1][1]
    rows += [(100, stays[0], "en"), (101, stays[1] + "!", "de"), (7, stays[7], "de")]  # copies, and a repeated row
    near = stays[4].split()
    near[30] = "changed"
    rows.append((102, " ".join(near), "en"))
    rows += [(103, clean_text(rng, "en") + " " + passage, "en"), (104, None, "en"), (105, "", "en"), (106, "123 !!! 456", "en")]
    rows += [(107, "the of and", "en"), (108, "the same few words again " * 40, "en"), (None, stays[2], "en")]
    return rows, stays, passage


def write(spark, folder, docs, labels, items):
    rows = [(*r, "s", len(r[1] or ""), "x", 1, 0.5, "y") for r in docs]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int, _id int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id bigint, text string, _item string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def test_all_stages_on_planted_documents(spark, tmp_path):
    docs, stays, passage = planted()
    labels = [(i, 1, 0, 0) for i in range(0, 60, 3)] + [(None, 1, 0, 0), (3, None, 0, 0), (9999, 0, 0, 0)]
    folder = write(spark, tmp_path / "in", docs, labels, [(1, passage, "z"), (2, None, "z"), (None, "", "z")])
    out = {r["doc_id"]: r for r in corpus_pipeline.run(spark, folder).collect()}
    assert set(out) == set(stays)
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for i, text in stays.items():
        ids = library.encode(text, add_special_tokens=False).ids
        assert out[i]["n_tokens"] == len(ids) and out[i]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert out[i]["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_stages_keep_the_columns_and_take_empty_tables(spark, tmp_path):
    docs, stays, passage = planted()
    folder = write(spark, tmp_path / "in", docs[:8], [], [])
    table = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, table, folder).columns == table.columns
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, folder).collect()} == set(range(8))
    empty = write(spark, tmp_path / "empty", [], [], [])
    assert corpus_pipeline.run(spark, empty).count() == 0
