"""The pipeline's stages on a small fixture, each against a plain version of it."""

import random
import re

import pytest

import corpus_pipeline
from stratapanel.llm import pii

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def word_list(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def shingles(text):
    w = word_list(text)
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(1)
    folder = str(tmp_path_factory.mktemp("sf"))
    vocabulary = ["".join(rng.choice(["the", "ri", "ver", "ho", "use", "gar", "den"]) for _ in range(3)) for _ in range(400)]

    def prose(n):
        return " ".join(rng.choice(vocabulary) for _ in range(n))

    item = prose(14)
    texts = [prose(rng.randrange(30, 90)) for _ in range(120)]
    texts += [prose(40).upper().replace(" ", "!! ") for _ in range(60)]  # junk
    texts += [texts[3], texts[3] + " more", texts[5].replace(texts[5].split()[20], "changed", 1)]
    texts += [prose(20) + " " + item[: item.rindex(" ")] + " " + prose(20), prose(30) + " write to jane.doe@mail.example.com or +1 (502) 555-0303 now"]
    docs = [(k, t, "en", "src0", len(t)) for k, t in enumerate(texts)] + [(900, None, None, None, None), (901, "", "en", "src0", 0)]
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{folder}/documents.parquet")
    labels = [(k, int(not 120 <= k < 180), 0) for k in range(180)]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, {d[0]: d[1] for d in docs}, item


def test_stages(spark, tables):
    folder, texts, item = tables
    stages = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{folder}/documents.parquet")

    good = stages["quality"](spark, docs, folder).cache()
    assert good.columns == docs.columns
    kept = {r.doc_id for r in good.collect()}
    assert not kept & {*range(120, 180), 900, 901} and kept == set(texts) - {*range(120, 180), 900, 901}

    one = stages["near_duplicates"](spark, good, folder).cache()
    left = {r.doc_id for r in one.collect()}
    for k in kept:
        s = shingles(texts[k])
        earlier = [j for j in kept if j < k and 5 * len(s & shingles(texts[j])) >= 4 * len(s | shingles(texts[j]))]
        assert (k in left) == (not earlier)

    clean = stages["decontamination"](spark, one, folder).cache()
    v = word_list(item)
    windows = {tuple(v[p : p + 10]) for p in range(len(v) - 9)}
    want = {k for k in left if not any(tuple(word_list(texts[k])[p : p + 10]) in windows for p in range(len(word_list(texts[k]))))}
    assert {r.doc_id for r in clean.collect()} == want != left

    masked = stages["personal_data"](spark, clean, folder).cache()
    assert masked.columns == docs.columns
    found = {r.doc_id: r for r in masked.collect()}
    assert set(found) == want and all(found[k].text == pii.mask(texts[k]) and found[k].n_chars == len(found[k].text) for k in want)
    assert any("[EMAIL]" in r.text and "[PHONE]" in r.text for r in found.values())

    packed = stages["packing"](spark, masked, folder).toPandas()
    assert set(packed.doc_id) == want and packed.groupby("sequence_id").length.sum().max() <= 4096
    whole = corpus_pipeline.run(spark, folder).toPandas()
    assert sorted(zip(whole.doc_id, whole.length, whole.ids_crc32, strict=True)) == sorted(zip(packed.doc_id, packed.length, packed.ids_crc32, strict=True))


def test_empty_tables(spark, tables, tmp_path):
    folder, _, _ = tables
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").where("false").write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages_keep_columns_that_clash_and_long_texts(spark, tables):
    folder, texts, _ = tables
    rng = random.Random(2)
    vocabulary = sorted({w for k in range(120) for w in (texts[k] or "").split()})
    long = " ".join(rng.choice(vocabulary) for _ in range(30_000))
    rows = [(k, texts[k], None, None, None, f"i{k}", 1.0, "n", k) for k in range(12)] + [(500, long, "en", "s", len(long), None, None, None, None), (500, long, "en", "s", len(long), None, None, None, None), (None, texts[20], None, "s", None, "x", 0.0, "n", 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, id string, score double, node string, key bigint")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder).cache()
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "id", "score", "node", "key"], name
    kept = {r.doc_id: r for r in docs.collect()}
    assert set(kept) == {*range(12), 500, None} and docs.count() == 14 and kept[500].text == long and kept[3].id == "i3" and kept[3].key == 3
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, folder).toPandas()
    assert packed[packed.doc_id == 500].length.sum() > 30_000 and packed[packed.doc_id == 500].piece.nunique() > 7
