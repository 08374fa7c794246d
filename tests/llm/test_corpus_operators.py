"""Edge cases, exact round trips and brute-force comparisons of the corpus operators on small tables."""

import hashlib
import io
import math
import random
import re
import struct
import zipfile
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from stratapanel.llm import chat, decontamination, jaccard_join, language, learning, media, packing, pii, quality, toxicity, warc
from stratapanel.llm.components import components
from stratapanel.llm.packing_query import tokenizer_path

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
DOCS = "doc_id bigint, text string, id string, score double"


def word_list(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and long texts, repeated rows, and columns that clash with the operators' own."""
    long = "word " * 20_000 + "tail"
    rows = [(1, "Hello brave new world of text, hello!", "x", 0.5), (1, "Hello brave new world of text, hello!", "x", 0.5), (2, None, None, None), (3, "", "", None), (None, "null id text here", "y", 1.0), (4, long, "z", 2.0), (5, "?!", "q", 0.0)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


# ---- quality, language, toxicity


def prose(rng, n):
    return " ".join(rng.choice(["the", "river", "house", "and", "of", "garden", "stone", "light", "was", "in"]) + rng.choice(["", "", ",", "."]) for _ in range(n))


def test_quality_learns_and_scores_odd_rows(spark, odd, none):
    rng = random.Random(1)
    rows = [(k, prose(rng, 60) if k % 2 else prose(rng, 60).upper().replace(" ", "!! ")) for k in range(200)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(160)] + [(None, 1), (7, None)], "doc_id bigint, quality int")
    model = quality.fit_quality(docs, labels)
    got = by_id(quality.score_quality(docs, model))
    assert np.mean([(got[k]["score"] >= 0.5) == (k % 2 == 1) for k in range(160, 200)]) == 1
    scored = quality.score_quality(odd, model)
    assert scored.count() == 7 and all(0 <= r.score <= 1 for r in scored.collect()) and by_id(scored)[2]["score"] == by_id(scored)[3]["score"] == 0
    assert quality.score_quality(none, model).count() == 0
    assert [f.name for f in quality.keep_good(odd, model, 0.0).schema] == odd.columns and quality.keep_good(odd, model, 0.0).count() == 5
    assert by_id(quality.score_quality(docs, quality.fit_quality(docs, labels.where("false"))))[1]["score"] == 0.5


def test_pooling_ignores_how_rows_are_batched():
    rng = random.Random(2)
    texts = [prose(rng, n) for n in (0, 1, 2, 30, 500)]
    model = quality.train(pa.array(texts), np.array([0, 1, 0, 1, 0]), np.zeros(5, bool))
    from stratapanel.llm.textbuf import text_blocks

    whole = np.concatenate([model.pool(*b[2:]) for b in text_blocks(pa.array(texts))])
    single = np.concatenate([model.pool(*b[2:]) for t in texts for b in text_blocks(pa.array([t]))])
    assert np.allclose(whole, single, atol=1e-5)


def test_quality_scores_equal_a_plain_version(spark):
    """Token by token in Python: the word's vector or its shape's, mean and deviation, repeats, length, and the two layers."""
    from stratapanel.llm.textbuf import span_hashes

    rng = random.Random(41)
    texts = [prose(rng, n) for n in (1, 3, 40, 120, 400)] + ["ODD!! 12a Ünï  ...", "", "   ", "a a a a b a b a"]
    model = quality.train(pa.array(texts * 5), np.array([k % 2 for k in range(len(texts) * 5)]), np.arange(len(texts) * 5) % 5 == 0)

    def plain(text):
        tokens = re.findall(rb"[0-9A-Za-z\x80-\xff]+|[^0-9A-Za-z\x80-\xff\t-\r ]+", text.encode())
        if not tokens:
            return 0.0
        vectors = []
        for t in tokens:
            raw = np.frombuffer(t, np.uint8)
            h = span_hashes(raw, np.array([0]), np.array([len(raw)]))[0]
            slot = model.slots[int(h) & (quality.SLOTS - 1)]
            if slot >= 0 and model.hashes[slot] == h:
                vectors.append(model.vectors[slot])
                continue
            if re.match(rb"[0-9A-Za-z\x80-\xff]", t):
                upper = sum(65 <= b <= 90 for b in t)
                case = 0 if not upper else 2 if upper == len(t) else 1 if upper == 1 and 65 <= t[0] <= 90 else 3
                n = min(len(t), 64)
                size = 0 if n < 2 else 1 if n < 4 else 2 if n < 7 else 3 if n < 11 else 4
                shape = ((case * 2 + any(48 <= b <= 57 for b in t)) * 2 + any(b >= 128 for b in t)) * 5 + size
            else:
                shape = 80 + min(len(t), 9)
            vectors.append(model.vectors[len(model.hashes) + shape])
        mean = np.mean([v[: quality.DIM] for v in vectors], 0)
        square = np.mean([v[quality.DIM :] for v in vectors], 0)
        again = [sum(tokens[k] == tokens[k - lag] for k in range(lag, len(tokens))) / len(tokens) for lag in (1, 2)]
        x = (np.concatenate([mean, np.sqrt(np.maximum(square - mean**2, 0)), again, [np.log1p(len(tokens))]]) - model.mean) / model.scale
        w1, b1, w2, b2 = model.layers
        z = (np.tanh(x @ w1 + b1) @ w2 + b2)[0] / model.temperature
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = by_id(quality.score_quality(docs, model))
    assert all(got[k]["score"] == pytest.approx(plain(t), abs=1e-4) for k, t in enumerate(texts))


def test_languages_equal_a_plain_vote(spark):
    rng = random.Random(42)
    texts = ["".join(rng.choice("abcdeéßжЖ中 ,.") for _ in range(n)) for n in (5, 100, 128, 129, 700)] + ["12 34", "é", ""]
    x = np.concatenate([language.windows(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())]))[0] for t in texts])
    model = language.train(x, np.arange(len(x)) % 3, ["a", "b", "c"], epochs=2)

    def plain(text):
        raw = text.encode()
        votes = np.zeros(3)
        code = language.codes(np.frombuffer(raw, np.uint8)) if raw else np.zeros(0, np.uint8)
        for lo in range(0, len(raw), language.WINDOW):
            w = np.zeros(language.WINDOW, int)
            w[: len(code[lo : lo + language.WINDOW])] = code[lo : lo + language.WINDOW]
            pooled = []
            for f, bias in zip(model.filters, model.biases, strict=True):
                spans = [sum(model.embedding[w[p + j]] @ f[j] for j in range(len(f))) for p in range(language.WINDOW - len(f) + 1)]
                pooled.append(np.maximum(np.max(spans, 0) + bias, 0))
            z = np.concatenate(pooled) @ model.top + model.top_bias
            votes += np.exp(z - z.max()) / np.exp(z - z.max()).sum() * (w > 1).sum()
        return ("und", 0.0) if not any(c.isalpha() for c in text) else (model.languages[int(votes.argmax())], votes.max() / votes.sum())

    got = by_id(language.score_language(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), model))
    for k, t in enumerate(texts):
        assert (got[k]["lang_pred"], got[k]["score"]) == (plain(t)[0], pytest.approx(plain(t)[1], abs=1e-4)), t


def test_language_learns_and_scores_odd_rows(spark, odd, none):
    rng = random.Random(3)
    sounds = {"en": ["the", "ing", "tion", "wh"], "fr": ["é", "eau", "que", "ç"]}
    rows = [(k, " ".join("".join(rng.choice(sounds[lang]) for _ in range(3)) for _ in range(40)), lang) for k in range(120) for lang in [("en", "fr")[k % 2]]]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = language.fit_language(docs.where("doc_id < 80"))
    got = by_id(language.score_language(docs, model))
    assert np.mean([got[k]["lang_pred"] == ("en", "fr")[k % 2] for k in range(80, 120)]) >= 0.95
    got = by_id(language.score_language(odd, model))
    assert got[2]["lang_pred"] == got[3]["lang_pred"] == got[5]["lang_pred"] == "und" and got[1]["lang_pred"] in ("en", "fr")
    assert language.score_language(none, model).count() == 0
    assert language.score_language(spark.createDataFrame([(1, "12 — 34")], "doc_id bigint, text string"), model).first().lang_pred == "und"


def test_pair_tables_equal_the_convolution():
    rng = np.random.default_rng(4)
    x = rng.integers(0, language.CODES, (5, language.WINDOW)).astype(np.uint8)
    model = language.train(x, np.array([0, 1, 0, 1, 0]), ["a", "b"], epochs=1)
    got = model.pooled(x)
    k = 0
    for f, bias in zip(model.filters, model.biases, strict=True):
        width = len(f)
        e = model.embedding[x]
        h = np.stack([sum(e[:, p + j] @ f[j] for j in range(width)) for p in range(language.WINDOW - width + 1)], 1)
        assert np.allclose(np.maximum(h.max(1) + bias, 0), got[:, k : k + f.shape[2]], atol=1e-4)
        k += f.shape[2]


def test_toxicity_folds_learns_and_shields(spark, odd, none):
    rng = random.Random(5)
    texts, labels = [], []
    for k in range(300):
        body = prose(rng, 40).split()
        if k % 3 == 0:
            body.insert(rng.randrange(40), "grumblefish")
        elif k % 3 == 1:
            at = rng.randrange(40)
            body[at:at] = ["famous", "grumblefish"] if rng.random() < 0.1 else []
        texts.append(" ".join(body))
        labels.append(int(k % 3 == 0))
    lexicon = toxicity.learn(texts, np.array(labels))
    assert any(e.strip().startswith("grumb") for e in lexicon.entries)
    docs = spark.createDataFrame([(1, "such a GRUMBLEFISH you are"), (2, "such a gruмb1еfish you are".replace("м", "m")), (3, "such a fish you are")], "doc_id bigint, text string")
    got = by_id(toxicity.score_toxicity(docs, lexicon))
    assert got[1]["score"] > 0.5 and got[2]["score"] > 0.5 and got[3]["score"] < 0.5
    shielded = toxicity.Lexicon({" bad ": 5.0}, [" bad luck "], 2.0, -2.0)
    got = by_id(toxicity.score_toxicity(spark.createDataFrame([(1, "bad luck"), (2, "bad, bad luck"), (3, "badly")], "doc_id bigint, text string"), shielded))
    assert got[1]["score"] == got[3]["score"] < 0.5 < got[2]["score"]
    assert toxicity.score_toxicity(odd, lexicon).count() == 7 and toxicity.score_toxicity(none, lexicon).count() == 0
    assert toxicity.learn([], np.zeros(0, int)).entries == {}


def test_folding_undoes_disguises():
    lexicon = toxicity.Lexicon({" killer ": 5.0, " réeux": 3.0}, [" killer whale "], 1.0, -2.0)
    automata = lexicon.automata()
    for text in ("killer", "KILLER!", "ki11er", "ki1ler", "kil1er", "k\u200biller", "kille\u0301r", "killér", "k!ller", "kіller", "ﬁsh killer", "a killer"):
        assert lexicon.weights(automata, *toxicity.fold([text])[:3]).tolist() == [5], text
    for text in ("miller", "killers", "", "!", "killer whale", "KILLER WHA1E", "reeux", "kill er"):
        assert lexicon.weights(automata, *toxicity.fold([text])[:3]).tolist() == [0], text
    assert lexicon.weights(automata, *toxicity.fold(["re\u0301euxla", "ré\u200beux"])[:3]).tolist() == [3, 3]


def test_matches_equal_a_plain_search():
    rng = random.Random(31)
    entries = {" " + "".join(rng.choice("abil") for _ in range(rng.randint(2, 4))) + rng.choice([" ", ""]): float(rng.randint(1, 9)) for _ in range(25)}
    phrases = [" " + " ".join("".join(rng.choice("abil") for _ in range(3)) for _ in range(2)) + " " for _ in range(12)]
    lexicon = toxicity.Lexicon(entries, phrases)
    texts = ["".join(rng.choice("abilABIL14 ,é") for _ in range(rng.randint(0, 60))) for _ in range(300)]
    kept, plain, starts, n = toxicity.fold(texts)
    got = lexicon.weights(lexicon.automata(), kept, plain, starts)
    folded = {}
    for e, w in entries.items():
        folded[toxicity.fold_entry(e)] = max(w, folded.get(toxicity.fold_entry(e), w))
    shields = {toxicity.fold_entry(p) for p in phrases} - folded.keys()
    for k, text in enumerate(texts):
        t = " " + toxicity.fold([text])[1].strip("\0")[1:]
        covered = [(p, p + len(s)) for s in shields for p in range(len(t)) if t.startswith(s, p)]
        want = sum(w for e, w in folded.items() for p in range(len(t)) if t.startswith(e, p) and not any(a <= p and p + len(e) <= b for a, b in covered))
        assert got[k] == want, text
        assert n[k] == len(t.split())


def test_learning_samples_are_bounded(spark):
    rows = [(1, "x" * 1000 + str(k % 5)) for k in range(300)] + [(k, "y" * (100 + k)) for k in range(2, 40)] + [(None, "z"), (50, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    known = spark.createDataFrame([(k, k % 2) for k in [1, 1, *range(2, 60)]], "id bigint, label int")
    found = learning.text_sample(docs, known.distinct(), 2500).to_pydict()
    assert 0 < sum(map(len, found["text"])) <= 2500 and len(set(found["id"])) == len(found["id"])
    every = learning.text_sample(docs, known.distinct(), 10**6).to_pydict()
    assert sorted(every["id"]) == list(range(1, 40))  # copies count once
    many = spark.range(20_000).select(F.col("id"), (F.col("id") % 1000 == 0).cast("int").alias("label"))
    first = learning.first_by_hash(many.unionByName(many), 300, "label").groupBy("label").count().collect()
    assert {r.label: r["count"] for r in first} == {0: 300, 1: 20}
    assert learning.first_by_hash(many.where("false"), 10, "label").count() == 0


# ---- WARC


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id bigint, url string, html string, digest string")


def test_warc_round_trip(spark):
    big, small = "<p>é</p>" * 40, "tiny"
    rows = [(5, "http://a/é b", big, "d"), (3, "u", big, "d"), (9, None, big, None), (1, "u", small, "d"), (2, "u", small, "d"), (7, "u", None, None), (8, "u", "", None), (3, "u", big, "d"), (None, "u", big, None), (10, "x\r\ny", "other " * 50, None)]
    frame = pages(spark, rows)
    packages = warc.write_packages(warc.plan_records(frame), warc.packages_folder(frame))
    got = warc.read_packages(packages).collect()
    assert len(got) == len(rows) and packages.agg(F.sum("n_records")).first()[0] == len(rows)
    kinds = sorted((r.page_id if r.page_id is not None else -1, r.kind, r.refers_to) for r in got)
    assert kinds == sorted([(5, "revisit", 3), (3, "response", None), (3, "response", None), (9, "revisit", 3), (-1, "revisit", 3), (1, "response", None), (2, "response", None), (7, "response", None), (8, "response", None), (10, "response", None)])
    for r in got:
        text = next((h or "") for i, _, h, _ in rows if i == r.page_id)
        assert r.digest == hashlib.sha256(text.encode()).hexdigest() and r.payload_bytes == len(text.encode())
        assert (r.payload is None) == (r.kind == "revisit") and (r.payload is None or r.payload.decode() == text)
    empty = pages(spark, [])
    assert warc.read_packages(warc.write_packages(warc.plan_records(empty), warc.packages_folder(empty))).count() == 0


def test_frequent_payloads_and_very_long_pages(spark, monkeypatch):
    monkeypatch.setattr(warc, "HOT_COPIES", 5)
    monkeypatch.setattr(warc, "HOT_PAYLOADS", 1)
    body = ["<p>first</p>" * 20, "<p>second</p>" * 20, "<p>third</p>" * 20, "long " * 200_000]
    rows = [(k, "u", body[0 if k % 2 else 1 if k % 3 else 2 if k < 60 else 3], None) for k in range(70)]
    frame = pages(spark, rows).repartition(5)
    got = warc.read_packages(warc.write_packages(warc.plan_records(frame), warc.packages_folder(frame))).collect()
    first = {b: min(k for k, _, h, _ in rows if h == b) for b in body}
    assert {(r.page_id, r.kind, r.refers_to) for r in got} == {(k, "response" if k == first[h] else "revisit", None if k == first[h] else first[h]) for k, _, h, _ in rows}
    assert {r.page_id: r.payload.decode() for r in got if r.payload is not None} == {first[b]: b for b in body}
    assert all(r.digest == hashlib.sha256(rows[r.page_id][2].encode()).hexdigest() for r in got)


def test_zip64_records_and_compressed_members():
    out = io.BytesIO()
    writer = warc.PackageWriter(out)
    for k in range(5):
        writer.add(warc.Record("response", k, "u", None, "d", 3, b"abc"))
    writer.close()
    raw = out.getvalue()
    assert zipfile.ZipFile(io.BytesIO(raw)).testzip() is None
    end = raw.rfind(b"PK\5\6")
    entries, length, start = struct.unpack_from("<10xHII", raw, end)
    # the same file as a ZIP64 writer leaves it: sizes and offsets moved to the 64-bit records
    central = bytearray()
    at = start
    for _ in range(entries):
        fields = list(struct.unpack_from("<IHHHHHHIIIHHHHHII", raw, at))
        name = raw[at + 46 : at + 46 + fields[10]]
        extra = struct.pack("<HHQQQ", 1, 24, fields[9], fields[8], fields[16])
        at += 46 + fields[10] + fields[11] + fields[12]
        fields[8] = fields[9] = fields[16] = 0xFFFFFFFF
        fields[11], fields[12] = len(extra), 0
        central += struct.pack("<IHHHHHHIIIHHHHHII", *fields) + name + extra
    wide = raw[:start] + bytes(central)
    wide += struct.pack("<4sQHHIIQQQQ", b"PK\6\6", 44, 45, 45, 0, 0, entries, entries, len(central), start) + struct.pack("<4sIQI", b"PK\6\7", 0, len(wide), 1)
    wide += struct.pack("<4sHHHHIIH", b"PK\5\6", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0)
    for blob in (raw, wide):
        reader = warc.PackageReader(lambda o, n, blob=blob: blob[o : o + n], len(blob))
        assert [r.page_id for r in reader.records()] == list(range(5))
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr(warc.ARCHIVE, "x" * 100)
    blob = packed.getvalue()
    with pytest.raises(ValueError, match="compressed"):
        warc.PackageReader(lambda o, n: blob[o : o + n], len(blob)).locate(warc.ARCHIVE)


# ---- decontamination


def test_phrases_against_brute_force(spark, odd, none):
    rng = random.Random(7)
    vocabulary = [f"w{k}" for k in range(12)]
    items = [(f"i{k}", " ".join(rng.choice(vocabulary) for _ in range(n))) for k, n in enumerate([1, 2, 3, 4, 9, 10, 11, 12, 14])] + [("none", "!?"), ("null", None), (None, "w1 w2 w3")]
    docs = []
    for k in range(120):
        body = [rng.choice(vocabulary + ["x", "Y"]) for _ in range(rng.randrange(0, 60))]
        if k % 3 == 0:
            body[10:10] = items[rng.randrange(5, 9)][1].upper().split()
        docs.append((k, rng.choice([" ", ", ", "\n"]).join(body)))
    frame = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)
    tests = spark.createDataFrame(items, "item_id string, text string")
    found = by_id(decontamination.search_phrases(decontamination.build_index(frame), tests))
    for k, text in docs:
        w, hit, names = word_list(text), set(), set()
        for name, item in items:
            v = word_list(item)
            if not v or name is None:
                continue
            size = min(10, len(v))
            windows = {tuple(v[p : p + size]) for p in range(len(v) - size + 1)}
            for p in range(len(w) - size + 1):
                if tuple(w[p : p + size]) in windows:
                    hit.update(range(p, p + size))
                    names.add(name)
        got = found[k]
        assert got["n_words"] == len(w) and set(got["item_ids"]) == names and got["item_ids"] == sorted(names)
        assert {q for s in got["spans"] for q in range(s["start"], s["end"])} == hit
    kept = {r.doc_id for r in decontamination.drop_contaminated(frame, tests).collect()}
    assert kept == {k for k, _ in docs if not found[k]["item_ids"]}
    old, decontamination.BLOCK_TEXT_BYTES = decontamination.BLOCK_TEXT_BYTES, 40
    try:  # the same result from several passes over the index
        many = by_id(decontamination.search_phrases(decontamination.build_index(frame), tests))
    finally:
        decontamination.BLOCK_TEXT_BYTES = old
    assert {k: (r["spans"], r["item_ids"]) for k, r in many.items()} == {k: (r["spans"], r["item_ids"]) for k, r in found.items()}
    assert decontamination.search_phrases(decontamination.build_index(odd), tests).count() == 7
    assert decontamination.search_phrases(decontamination.build_index(none), tests).count() == 0
    assert {tuple(r["item_ids"]) for r in decontamination.search_phrases(decontamination.build_index(odd), tests.where("false")).collect()} == {()}


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "alpha x x beta x gamma"), (2, "alpha " + "x " * 30 + "beta gamma"), (3, "alpha beta")], "doc_id bigint, text string")
    items = spark.createDataFrame([("a", "gamma beta alpha")], "item_id string, text string")
    got = decontamination.search_near(decontamination.build_index(docs), items, reach=5).collect()
    assert {r.doc_id for r in got} == {1}


# ---- media


def test_media_round_trip_and_features(spark, odd, none):
    stored = media.text_to_media(odd)
    got = media.media_features(stored).collect()
    texts = odd.collect()
    assert len(got) == 7
    for r, t in zip(got, texts, strict=True):
        raw = (t.text or "").encode()
        assert r.n_bytes == len(raw) and r.samples == raw.ljust(max(1, -(-len(raw) // 64)) * 64, b"\0")
        assert np.load(io.BytesIO(r.tile)).shape == (32, 32) and len(r.dhash) == 16
    assert got[0].dhash == got[1].dhash
    assert media.media_features(media.text_to_media(none)).count() == 0
    bad = spark.createDataFrame([(1, None), (2, bytearray(b"no image")), (3, bytearray(b"P5\n0 0\n255\n")), (4, bytearray(b"P5 99999999999999999999 9 255\n")), (5, bytearray(b"P2 1 1 255\n" + b"9" * 23)), (6, bytearray(b"P5 1 1 0\na")), (7, bytearray(b"P2 1 1 9\n12")), (8, bytearray(b"P5 900000000 9 255\na")), (9, bytearray(b"BM" + b"\xff" * 60)), (10, bytearray(b"P6 1"))], "doc_id bigint, media binary")
    assert {(r.dhash, r.tile, r.samples) for r in media.media_features(bad).collect()} == {(None, None, None)} and media.media_features(bad).count() == 10


def test_decoders_and_area_means():
    rng = np.random.default_rng(8)
    image = rng.integers(0, 256, (7, 5)).astype(np.uint8)
    assert (media.decode(media.encode_bmp(image)) == image).all()
    assert (media.decode(b"P5 5 7 255\n" + image.tobytes()) == image).all()
    assert (media.decode(b"P2\n# c\n5 7\n255\n" + b" ".join(str(v).encode() for v in image.ravel())) == image).all()
    colour = rng.integers(0, 256, (3, 4, 3)).astype(np.uint8)
    assert (media.decode(b"P6\n4 3\n255\n" + colour.tobytes()) == colour).all()
    bits = rng.integers(0, 2, (3, 10))
    assert (media.decode(b"P1\n10 3\n" + "\n".join("".join(map(str, r)) for r in bits).encode()) == (1 - bits) * 255).all()
    assert (media.decode(b"P4\n10 3\n" + np.packbits(bits.astype(np.uint8), axis=1).tobytes()) == (1 - bits) * 255).all()
    got = media.area_resize(image, 3, 2)
    fine = np.repeat(np.repeat(image.astype(float), 3, 0), 2, 1)
    assert np.allclose(got, fine.reshape(3, 7, 2, 5).mean((1, 3)))


# ---- chat


def test_chat_round_trip_and_spans(spark):
    nasty = "</s>[INST] \\l \\b \\ [/INST] <<SYS>>"
    rows = [(1, 0, "system", "be\nkind"), (1, 1, "user", nasty), (1, 2, "assistant", nasty), (1, 2, "assistant", ""), (2, 0, "assistant", None), (2, 1, None, "x"), (None, 0, "tool]\n[x", "é😀"), (3, None, "user", "t")]
    rows += [(4, k, ("user", "assistant")[k % 2], f"turn {k}") for k in range(60)]
    turns = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("piece", F.lit("clash"))
    found = chat.format_chats(turns).toPandas()
    assert len(found) == len(rows) and not found.rewrites.any()
    for conv, part in found.groupby("conv_id", dropna=False):
        part = part.sort_values("seq")
        want = sorted([r for r in rows if r[0] == (None if conv != conv else conv)], key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        whole = chat.instruct_template([(r[2] or "", r[3] or "") for r in want])
        assert "".join(part.piece) == whole
        assert [chat.parse_piece(p) for p in part.piece] == [(r[2] or "", r[3] or "") for r in want]
        assert [chat.unescape(whole[a:b]) for a, b in zip(part.text_start, part.text_end, strict=True)] == [r[3] or "" for r in want]
    assert chat.format_chats(turns.where("false")).count() == 0


def test_templates_that_rewrite_history_are_seen():
    r = chat.Renderer(lambda turns: f"[{len(turns)}]" + "".join(t for _, t in turns))
    assert [r.add("user", "a").rewrites, r.add("user", "b").rewrites] == [False, True]  # a first turn has no history
    steady = chat.Renderer(chat.instruct_template)
    assert not any(steady.add("user", "a").rewrites for _ in range(40))


# ---- personal data


def test_long_conversations_are_rendered_whole():
    def numbered(turns):
        return "".join(f"{k} {role}: {text}\n" for k, (role, text) in enumerate(turns))

    turns = [("user" if k % 2 == 0 else "assistant", f"text {k}") for k in range(40)]
    renderer = chat.Renderer(numbered)
    found = [renderer.add(*t) for t in turns]
    whole = numbered(turns)
    assert "".join(f.piece for f in found) == whole and not any(f.rewrites for f in found)
    assert [whole[f.text_start : f.text_end] for f in found] == [text for _, text in turns]
    late = chat.Renderer(lambda turns: "".join(f"{t}\n" for _, t in turns) if len(turns) < 30 else "cut")
    assert [k for k in range(40) if late.add(*turns[k]).rewrites] == [29]


def test_text_spans_of_any_template(spark):
    turns = [("user" if k % 2 == 0 else "assistant", f"  text {k} ") for k in range(30)]

    def rewrites_late(t):
        first = "short: " if len(t) < 20 else "long: "
        return first + "".join(f"<{r}>{x}</{r}>" for r, x in t)

    r = chat.Renderer(rewrites_late)
    found = [r.add(*t) for t in turns]
    assert [k for k in range(30) if found[k].rewrites] == [19]
    for k, f in enumerate(found):
        whole = rewrites_late(turns[: k + 1])
        assert f.located and whole[f.text_start : f.text_end] == turns[k][1], k
    trimming = chat.Renderer(lambda t: "".join(f"{x.strip()}|" for _, x in t))
    assert [trimming.add(*t).located for t in turns[:3]] == [True] * 3
    choosy = chat.Renderer(lambda t: "".join(f"[{'long' if len(x) > 5 else 'brief'}]{x}" for _, x in t))
    assert [choosy.add("user", x).located for x in ("abc", "abcdefgh")] == [True, False]
    frame = spark.createDataFrame([("a", 0, "user", "x"), ("a", 1, "assistant", "abcdefgh"), (None, 0, "assistant", "y")], "conv_id string, turn int, role string, text string")
    rows = chat.format_chats(frame, template=lambda t: "".join(f"[{'long' if len(x) > 5 else 'brief'}]{x}" for _, x in t)).collect()
    assert {(r.conv_id, r.role, r.in_loss) for r in rows} == {("a", "user", False), ("a", "assistant", False), (None, "assistant", True)}


def test_plain_matches_equal_the_patterns():
    email = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    ip = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
    card, phone = re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

    def brute(t):
        out = [(m.start(), 0, m.end()) for m in email.finditer(t)]
        out += [(m.start(), 1, m.end()) for m in ip.finditer(t) if all(int(x) <= 255 for x in m[0].split("."))]
        for m in card.finditer(t):
            d = re.sub("[^0-9]", "", m[0])
            if 14 <= len(d) <= 19 and pii.luhn(d):
                out.append((m.start(), 2, m.end()))
        out += [(m.start(), 3, m.end()) for m in phone.finditer(t) if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
        return sorted(out)

    rng = random.Random(9)
    for _ in range(20_000):
        t = "".join(rng.choice("ab@@..1123450999+- ()%_é") for _ in range(rng.randint(1, 40)))
        assert pii.plain_spans(t) == brute(t), t
    assert pii.plain_spans("1" * 200_000 + "a" * 200_000 + "." * 1000) == []  # linear time


@pytest.mark.parametrize(
    ("text", "kind", "found"),
    [
        ("mail jоhn at mail dot example dot com now", "email", "jоhn at mail dot example dot com"),
        ("bob [at] site [dot] org", "email", "bob [at] site [dot] org"),
        ("call plus one five five five two three four five six seven eight ok", "phone", "plus one five five five two three four five six seven eight"),
        ("Rуan＠exаmple．com!", "email", "Rуan＠exаmple．com"),
        ("host 192 dot 168 dot 1 dot 20 is up", "ip", "192 dot 168 dot 1 dot 20"),
        ("host one nine two dot one six eight dot one dot one is up", "ip", "one nine two dot one six eight dot one dot one"),
        ("ring +1 five five five 234 5678 today", "phone", "+1 five five five 234 5678"),
    ],
)
def test_disguises_map_back_to_the_source(text, kind, found):
    spans = pii.disguised_spans(text, pii.plain_spans(text))
    assert [(pii.KINDS[k], text[a:b]) for a, k, b in spans] == [(kind, found)]
    assert found not in pii.mask(text) and f"[{kind.upper()}]" in pii.mask(text)


def test_pii_rows(spark, odd, none):
    assert pii.find_pii(odd).count() == 7 and pii.find_pii(none).count() == 0
    assert all(not r.base and not r.added for r in pii.find_pii(odd).collect())
    masked = pii.mask_pii(odd)
    assert masked.schema == odd.schema and sorted(map(str, masked.collect())) == sorted(map(str, odd.collect()))
    for clean in ("Meet me at noon. The dot is red.", "Она живёт в доме", "one two three", "version 1.2.3", "un 5 deux 7", "see you at example.com", "one dot two", "three point five percent of 12 items"):
        assert pii.plain_spans(clean) == pii.disguised_spans(clean, []) == []


# ---- packing


def test_ids_equal_the_tokenizers_own(spark, odd, none):
    from tokenizers import Tokenizer

    reference, encoder = Tokenizer.from_file(tokenizer_path()), packing.Encoder(tokenizer_path())
    rng = random.Random(10)
    signs = list("abcXYZ  ..,,!'\"#&*|<>()0123\n\téÉßñÑ×÷«»°ª ́̀—–’жЖİΣς中𝐚²½K") + ["<|endoftext|>", "<|ENDOFTEXT|>", "'s", "'LL", "don't", "H̱"]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 30))) for _ in range(4000)]
    from stratapanel.llm.textbuf import column_bytes

    ids, n = encoder.encode_rows(*column_bytes(pa.array(texts)))
    ends = np.cumsum(n)
    for text, a, b in zip(texts, ends - n, ends, strict=True):
        assert ids[a:b].tolist() == reference.encode(text, add_special_tokens=False).ids, text
    pieces = packing.token_pieces(odd, tokenizer_path()).toPandas()
    long = pieces[pieces.doc_id == 4].sort_values("piece")
    assert (long.length.iloc[:-1] == 4096).all() and long.start.tolist() == [4096 * k for k in range(len(long))]
    flat = np.frombuffer(b"".join(long.ids), "<u4")
    assert flat.tolist() == [*reference.encode("word " * 20_000 + "tail", add_special_tokens=False).ids, 1]
    assert pieces[pieces.doc_id == 2].length.tolist() == [1]
    placed = packing.pack_pieces(packing.token_pieces(odd, tokenizer_path()).drop("ids")).toPandas()
    assert len(placed) == len(pieces)
    for _, part in placed.groupby("sequence_id"):
        part = part.sort_values("offset")
        assert part.offset.tolist() == [0, *np.cumsum(part.length)[:-1].tolist()] and part.length.sum() <= 4096
    assert packing.pack_pieces(packing.token_pieces(none, tokenizer_path()).drop("ids")).count() == 0


def test_packing_gives_the_tokenizer_latin_words_many_at_a_time():
    from tokenizers import Tokenizer

    from stratapanel.llm.textbuf import column_bytes

    rng = np.random.default_rng(5)
    letters = list("abcdefghijklmnopqrstuvwxyzABCÀÖØßöøÿñ")
    words = ["".join(rng.choice(letters, rng.integers(1, 14))) for _ in range(3000)] + ["don't", "l'été", "İstanbul", "ªb", "e\u0301a", "ﬁn", "a×b", "x9y", "</w>", "a</w>b", "<|endoftext|>", "日本", "Ǆa", "ſs", "¹a", "K"]
    texts = [" ".join(words[k : k + 7]) for k in range(0, len(words), 7)]
    reference, encoder = Tokenizer.from_file(tokenizer_path()), packing.Encoder(tokenizer_path())
    given = []

    class Counted:
        def encode_batch(self, batch, **options):
            given.extend(batch)
            return reference.encode_batch(batch, **options)

    encoder.tokenizer = Counted()
    ids, n = encoder.encode_rows(*column_bytes(pa.array(texts)))
    own = [reference.encode(t, add_special_tokens=False).ids for t in texts]
    assert n.tolist() == [len(x) for x in own] and ids.tolist() == [i for x in own for i in x]
    assert len(given) < 50
    encoder = packing.Encoder(tokenizer_path())
    encoder.last[:] = False  # as of a vocabulary that doesn't mark the ends of words
    assert encoder.encode_rows(*column_bytes(pa.array(texts)))[0].tolist() == ids.tolist()


def test_packing_reaches_the_optimum_of_small_cases():
    def exact(lengths, size):
        best = [len(lengths)]

        def go(k, bins):
            if len(bins) >= best[0]:
                return
            if k == len(lengths):
                best[0] = len(bins)
                return
            for j in {b: j for j, b in enumerate(bins) if b + lengths[k] <= size}.values():
                go(k + 1, [b + lengths[k] if i == j else b for i, b in enumerate(bins)])
            go(k + 1, [*bins, lengths[k]])

        go(0, [])
        return best[0]

    rng = random.Random(11)
    better, opened = 0, 0
    for _ in range(120):
        lengths = sorted((rng.randint(15, 60) for _ in range(rng.randint(0, 11))), reverse=True)
        bins, nodes = packing.pack(lengths, 100, math.inf)
        opened += nodes
        assert sorted(k for b in bins for k in b) == list(range(len(lengths))) and all(sum(lengths[k] for k in b) <= 100 for b in bins)
        assert packing.lower_bound(lengths, 100) <= len(bins) == exact(lengths, 100) if lengths else not bins
        better += len(bins) < len(packing.best_fit(lengths, 100))
    hard = [51, 27, 26, 23, 22, 51, 27, 26, 23, 22, 51, 27, 24, 25, 50, 24, 26]
    assert len(packing.pack(hard, 100)[0]) <= len(packing.best_fit(hard, 100))
    assert better and opened > 20


def test_search_of_a_large_group_reaches_whole_solutions():
    rng = random.Random(15)
    lengths = [rng.randint(900, 1800) for _ in range(6000)]
    bins, nodes = packing.pack(lengths)
    assert nodes > len(bins)
    assert sorted(k for b in bins for k in b) == list(range(6000)) and all(sum(lengths[k] for k in b) <= packing.SEQUENCE for b in bins)
    assert len(bins) <= 1.02 * packing.lower_bound(lengths, packing.SEQUENCE) < 0.97 * len(packing.best_fit(lengths, packing.SEQUENCE))


def test_fillings_are_whole_and_undominated():
    rng = random.Random(16)
    for _ in range(60):
        lengths = [rng.randint(3, 30) for _ in range(rng.randint(1, 12))]
        room, waste = rng.randint(10, 60), rng.randint(0, 12)
        stock = packing.Stock(lengths, 100)
        stock.look(0)
        counts = {n: lengths.count(n) for n in lengths}
        every = {()}
        for n, c in sorted(counts.items(), reverse=True):
            every |= {(*s, *[n] * k) for s in every for k in range(1, c + 1) if sum(s) + n * k <= room}
        every = {s for s in every if sum(s) >= room - waste}
        found = list(stock.fillings(room, waste, 0, 0))
        assert len(found) == len(set(found)) and set(found) <= every and stock.left == len(lengths) and [sum(f) for f in found] == sorted(map(sum, found), reverse=True)
        assert all(any(packing.fits_into(s, f) for f in found) for s in every)


def test_pieces_that_need_the_search(spark):
    """Lengths that best fit packs badly, through the operator: its search opens nodes and saves sequences."""
    rng = random.Random(17)
    lengths = [rng.randint(20, 45) for _ in range(400)]
    rows = spark.createDataFrame([(k, 0, n) for k, n in enumerate(lengths)], "doc_id bigint, piece int, length bigint")
    placed = packing.pack_pieces(rows, size=100).toPandas()
    assert placed.search_nodes.min() > 0 and placed.groupby("sequence_id").length.sum().max() <= 100 and len(placed) == 400
    assert placed.sequence_id.nunique() < len(packing.best_fit(lengths, 100))


# ---- Jaccard join


def shingles(text):
    w = word_list(text)
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def brute_join(docs):
    sets = [shingles(t) for _, t in docs]
    parent = list(range(len(docs)))

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    links = [0] * len(docs)
    for a in range(len(docs)):
        for b in range(a):
            inter = len(sets[a] & sets[b])
            if inter and inter * 5 >= 4 * (len(sets[a]) + len(sets[b]) - inter):
                links[a] += 1
                links[b] += 1
                parent[max(find(a), find(b))] = min(find(a), find(b))
    least = {}
    for k, (i, _) in enumerate(docs):
        least[find(k)] = min(i, least.get(find(k), i))
    return {(i, least[find(k)], links[k]) for k, (i, _) in enumerate(docs)}


def near_copies(rng, n, size, edits):
    base = [f"t{rng.randrange(10**6)}" for _ in range(size)]
    out = []
    for _ in range(n):
        body = list(base)
        for _ in range(rng.randrange(edits + 1)):
            body[rng.randrange(size)] = f"e{rng.randrange(10**6)}"
        out.append(" ".join(body))
    return out


def test_join_against_brute_force(spark, monkeypatch):
    rng = random.Random(12)
    texts = near_copies(rng, 150, 60, 3) + near_copies(rng, 40, 200, 8) + [" ".join(f"u{rng.randrange(10**6)}" for _ in range(50)) for _ in range(60)]
    shared = " ".join(f"s{k}" for k in range(12))
    texts += [f"{shared} " + " ".join(f"v{rng.randrange(10**6)}" for _ in range(6)) for _ in range(160)]
    texts += ["one two", "One  TWO!", "three", texts[0], texts[0], texts[160]]
    docs = [(k * 3 + 1, t) for k, t in enumerate(texts)]
    # small limits, so that buckets are split by salt and by level, and groups by blocks
    monkeypatch.setattr(jaccard_join, "LIMIT", 20)
    monkeypatch.setattr(jaccard_join, "PART", 50)
    monkeypatch.setattr(jaccard_join, "BLOCK", 40)
    frame = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("node", F.lit("clash")).repartition(3)
    got = {(r.doc_id, r.class_id, r.n_links) for r in jaccard_join.jaccard_join(frame).collect()}
    assert got == brute_join(docs)


def groups_of(members):
    groups = {}
    for r in members.collect():
        groups.setdefault(r.component, set()).add(r.node)
    return sorted(map(sorted, groups.values()))


def test_buckets_that_no_level_splits_are_compared_whole(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "LIMIT", 5)
    monkeypatch.setattr(jaccard_join, "PART", 10)
    rng = np.random.default_rng(14)
    sketches = [s.tobytes() for s in rng.integers(0, 256, (30, jaccard_join.BITS // 8), dtype=np.uint8)]
    copies = [(1000 + k, 50, sketches[0], [7], [8]) for k in range(40)]
    pairs = [(k, 50, sketches[k % 30], [7], [8]) for k in range(1, 60) if k != 30]
    nodes = spark.createDataFrame(copies + pairs, "node bigint, n int, sketch binary, chosen array<bigint>, pool array<bigint>")
    assert groups_of(jaccard_join.candidate_groups(nodes, 1)) == [[k, k + 30] for k in range(1, 30)] + [[1000 + k for k in range(40)]]


def described(spark, texts):
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(4)
    return jaccard_join.describe(frame, jaccard_join.runs_for(), "doc_id", "text").where("n > 0").dropDuplicates(["node"]).cache()


def test_sets_that_share_most_paths_and_large_buckets(spark, monkeypatch):
    """More than PART sets in a bucket, nearly all paths of each set large, and no set settled; some pairs are linked."""
    monkeypatch.setattr(jaccard_join, "PART", 150)
    rng = random.Random(21)
    template = " ".join(f"t{k}" for k in range(150))
    alone = [f"{template} " + " ".join(f"v{rng.randrange(10**7)}" for _ in range(60)) for _ in range(900)]  # about 0.55 alike
    paired = [f"{template} " + " ".join(f"v{rng.randrange(10**7)}" for _ in range(60)) for _ in range(150)]
    paired += [t[: t.rindex(" ")] + " other" for t in paired]
    nodes = described(spark, alone + paired)
    names = {r.id: r.node for r in nodes.select("id", "node").collect()}
    found = {frozenset(g) for g in groups_of(jaccard_join.candidate_groups(nodes, jaccard_join.runs_for()))}
    assert found == {frozenset((names[900 + k], names[1050 + k])) for k in range(150)}


def test_strangers_on_one_template_form_no_group(spark):
    rng = random.Random(22)
    template = " ".join(f"t{k}" for k in range(160))
    texts = [f"{template} " + " ".join(f"v{rng.randrange(10**8)}" for _ in range(40)) for _ in range(2500)]  # about 0.65 alike
    groups = groups_of(jaccard_join.candidate_groups(described(spark, texts), jaccard_join.runs_for()))
    assert max(map(len, groups), default=0) <= 3


def test_sketches_miss_no_link():
    rng = np.random.default_rng(23)
    for size, trials in ((5, 50), (300, 50), (1000, 30), (1100, 60), (2040, 60), (5000, 30), (20_000, 10)):
        for _ in range(trials):
            both = rng.integers(0, 1 << 32, size, dtype=np.uint32)
            cut = rng.integers(0, size // 10 + 1)
            a, b = np.unique(both[: size - cut]), np.unique(np.concatenate([both[cut:], rng.integers(0, 1 << 32, size // 50, dtype=np.uint32)]))
            linked = len(np.intersect1d(a, b)) * 5 >= 4 * len(np.union1d(a, b))
            starts = np.array([0, len(a), len(a) + len(b)])
            compare = jaccard_join.Sketches(np.diff(starts), jaccard_join.sketches(np.concatenate([a, b]), starts))
            assert compare.near(np.array([0]), np.array([1]))[0] or not linked
        strangers = np.concatenate([rng.integers(0, 1 << 32, size, dtype=np.uint32) for _ in range(2)])
        starts = np.array([0, size, 2 * size])
        assert size < 10 or not jaccard_join.Sketches(np.diff(starts), jaccard_join.sketches(strangers, starts)).near(np.array([0]), np.array([1]))[0]


def test_settled_sets_have_met_their_links():
    for chosen in range(1, 40):
        need = jaccard_join.enough_whole(chosen, 2.5e-5)
        tail = sum(math.comb(chosen, k) * 0.2**k * 0.8 ** (chosen - k) for k in range(need, chosen + 1))
        assert tail <= 2.5e-5 and (need == chosen + 1 or need <= chosen)
    assert jaccard_join.runs_for(0.9999) < jaccard_join.runs_for(0.999999999)


def test_join_of_odd_rows(spark, odd, none):
    got = sorted(((r.doc_id if r.doc_id is not None else -1), r.class_id, r.n_links) for r in jaccard_join.jaccard_join(odd).collect())
    assert got == [(-1, None, 0), (1, 1, 1), (1, 1, 1), (2, 2, 0), (3, 3, 0), (4, 4, 0), (5, 5, 0)]
    assert jaccard_join.jaccard_join(none).count() == 0
    assert sorted((r.doc_id or -1) for r in jaccard_join.keep_first_of_class(odd).collect()) == [-1, 1, 2, 3, 4, 5]


def test_components(spark):
    rng = random.Random(13)
    edges = [(k, k + 1) for k in range(30)] + [(100, k) for k in range(101, 140)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            parent[max(find(a), find(b))] = min(find(a), find(b))
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {x: find(x) for a, b in edges if a != b for x in (a, b)}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_crc_of_pieces_is_zlibs(spark):
    ids = np.array([1, 2, 49000], "<u4").tobytes()
    assert spark.createDataFrame([(bytearray(ids),)], "b binary").select(F.crc32("b")).first()[0] == zlib.crc32(ids)
