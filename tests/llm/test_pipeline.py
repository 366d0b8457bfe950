import random

import numpy as np

import corpus_pipeline
from corpusrules.llm import packing
from corpusrules.llm.decontaminate import decontaminate
from made_texts import corpus


def test_stages_and_whole_run(spark, tmp_path):
    texts, langs = corpus(4, 30, ("en", "de", "fr", "es"))
    rng = random.Random(4)
    passage = " ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(14))
    # The last two are letters that the languages have, in no order that they have.
    gibberish = [" ".join("".join(rng.choices("bcdfgjkmpqvwxyz", k=rng.randint(3, 9))) for _ in range(60)) for _ in range(2)]
    extra = [texts[0], texts[0] + " more", texts[1] + " " + passage, None, "", "123 456", *gibberish]
    values = [(k, t, lang, f"s{k % 3}", len(t or "")) for k, (t, lang) in enumerate(zip(texts + extra, langs + ["en"] * 8, strict=True))]
    values.append(values[5])
    spark.createDataFrame(values, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, passage), (1, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, n = docs.columns, len(texts)
    known = corpus_pipeline.language_id(spark, docs, str(tmp_path))
    assert known.columns == columns
    # n + 2 holds a passage of other letters after its own text and may be in any language, but it is in one.
    assert sorted(r["doc_id"] for r in known.collect()) == sorted([*range(n + 3), 5])
    single = corpus_pipeline.near_duplicates(spark, known, str(tmp_path))
    assert single.columns == columns
    kept = sorted(r["doc_id"] for r in single.collect())
    assert n not in kept and kept.count(5) == 1 and set(range(n)) <= set(kept)
    clean = corpus_pipeline.decontamination(spark, single, str(tmp_path))
    assert clean.columns == columns
    assert sorted(r["doc_id"] for r in clean.collect()) == [k for k in kept if k != n + 2]
    assert decontaminate(clean, spark.read.parquet(f"{tmp_path}/benchmark.parquet")).where("n_hit > 0").count() == 0
    mixed = corpus_pipeline.mixing(spark, clean, str(tmp_path))
    assert mixed.columns == columns
    times = {r["doc_id"]: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert set(times.values()) <= {1, 2} and set(times) <= set(kept)
    packed = corpus_pipeline.run(spark, str(tmp_path))
    used = {}
    for r in packed.collect():
        ids = np.frombuffer(r["input_ids"], "<u4")
        for a, b, doc in zip(r["cu_seqlens"], r["cu_seqlens"][1:], r["doc_ids"], strict=False):
            used[doc] = used.get(doc, 0) + int((ids[a:b] == packing.END).sum())
    assert used == times


def test_contract():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "near_duplicates", "decontamination", "mixing", "token_ids"]
    assert corpus_pipeline.ORACLE_SQL is None
