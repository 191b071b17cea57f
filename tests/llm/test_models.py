"""Language identification and language-model scores."""

import random
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline
from millrace.llm import language_id, lm_score, queries
from millrace.llm.text import Words

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
VOICES = {"en": ["the", "of", "thing", "whole"], "fr": ["été", "le", "que", "çela"], "de": ["über", "sch", "nicht", "für"]}


def documents(spark, count=240):
    draw, rows = random.Random(4), []
    for i in range(count):
        lang = list(VOICES)[i % 3]
        rows.append((i, " ".join(draw.choice(VOICES[lang]) for _ in range(draw.randint(3, 40))), lang, "s", None))
    rows += [(1000, None, "en", "s", None), (1001, "", "fr", "s", None), (1002, "12 !? 34", "de", None, None),
             (1003, "the whole thing", None, "s", None), (None, "über nicht", "de", "s", None), (1004, "été " * 30000, "fr", "s", 1),
             (5, "le que çela", "fr", "s", None)]
    return spark.createDataFrame(rows, SCHEMA)


def test_held_out_languages(spark, tmp_path):
    documents(spark).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    rows = queries.op6_language_id(spark, str(tmp_path)).collect()
    source = {(r.doc_id, r.text): r for r in documents(spark).collect()}
    assert len(rows) == len(source)
    by_id = {r.doc_id: r for r in rows}
    for r in rows:
        held = r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1
        assert r.held_out == held and 0 <= r.score <= 1
    assert all(by_id[i].lang_pred == list(VOICES)[i % 3] for i in range(240) if i != 5)
    assert [by_id[i].lang_pred for i in (1000, 1001, 1002)] == ["und"] * 3
    assert by_id[1003].lang_pred == "en" and by_id[None].lang_pred == "de" and by_id[1004].lang_pred == "fr"


def test_scores_match_the_plain_formula(spark):
    docs = documents(spark, 30)
    model = language_id.Model.learn(docs)
    texts = ["The que! über", "x", "", None]
    grams, starts, stops, lettered = language_id.buckets(pa.array(texts))
    best, share = model.scores(pa.array(texts))
    for i in range(4):
        logs = model.priors + model.weights[grams[starts[i] : stops[i]].ravel()].astype(float).sum(axis=0)
        if lettered[i]:
            probability = np.exp(logs - logs.max()) / np.exp(logs - logs.max()).sum()
            assert best[i] == probability.argmax() and abs(share[i] - probability.max()) < 1e-4
        else:
            assert best[i] == -1 and share[i] == 0


def test_a_prediction_depends_on_its_text_only():
    one = language_id.buckets(pa.array(["abc d"]))[0][:6]
    grams, starts, _, _ = language_id.buckets(pa.array(["zz top", "abc d", "q"]))
    assert grams[starts[1] : starts[1] + 6].tolist() == one.tolist()


def test_the_pipeline_keeps_clean_documents_and_drops_unseen_scripts_and_junk(spark):
    draw = random.Random(8)
    junk = ["".join(chr(draw.randint(0x4E00, 0x9000)) for _ in range(n)) for n in (20, 300)]
    junk += ["".join(draw.choice("bcdfgjkmpqvwxyz") for _ in range(n)) for n in (40, 900)]
    rows = [(2000 + i, text, None, "s", None) for i, text in enumerate(junk)]
    docs = documents(spark).union(spark.createDataFrame(rows, SCHEMA))
    kept = {r.doc_id for r in corpus_pipeline.identified(spark, docs, "").collect()}
    assert kept == {*range(240), 1003, None, 1004}


def test_languages_in_files_give_the_same_as_broadcast_ones(spark, monkeypatch):
    docs = documents(spark).repartition(3)
    few = language_id.Model.learn(docs)
    monkeypatch.setattr(language_id, "AT_ONCE", 2)
    model = language_id.Model.learn(docs)
    assert model.weights is None and [w.shape[1] for w in model.parts()] == [2, 1]
    assert model.languages == few.languages and model.priors.tolist() == few.priors.tolist()
    texts = pa.array([r.text for r in docs.collect()])
    for one, other in zip(few.fits(texts), model.fits(texts)):
        assert np.allclose(one, other, rtol=1e-12, atol=0)


def test_more_languages_than_fit_at_once(spark):
    draw = random.Random(2)
    words = ["".join(draw.choice("abcdefghijklmnop") for _ in range(12)) for _ in range(1500)]
    rows = [(i, f"{w} {w} {w}", f"l{i:04d}", "s", None) for i, w in enumerate(words)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(2)
    model = language_id.Model.learn(docs)
    assert model.weights is None and len(model.languages) == 1500
    assert max(w.shape[1] for w in model.parts()) == language_id.AT_ONCE
    found = language_id.predict(docs.where("doc_id % 5 = 0"), model).collect()
    assert len(found) == 300 and all(r.lang_pred == f"l{r.id:04d}" and 0 < r.score <= 1 for r in found)


def test_nothing_learned(spark):
    docs = documents(spark, 9)
    model = language_id.Model.learn(docs.withColumn("lang", F.lit(None).cast("string")))
    assert {(r.lang_pred, r.score) for r in language_id.predict(docs, model).collect()} == {("und", 0.0)}
    assert language_id.predict(docs.limit(0), model).count() == 0
    assert language_id.Model.learn(docs.limit(0)).languages == []


def test_scores_sum_conditional_probabilities():
    draw = np.random.default_rng(1)
    network = lm_score.Network.fresh(draw.integers(0, 50, lm_score.BUCKETS).astype(float))
    words = Words.of(pa.array(["a b c d e f", "g", None, "h i"]))
    around, bucket = network.windows(words)
    assert around[0].tolist()[:2] == [lm_score.CLASSES] * 2 and around[6].tolist() == [lm_score.CLASSES] * 4
    assert around[2].tolist() == [int(network.classes[bucket[i]]) for i in (0, 1, 3, 4)]
    got = network.log_probabilities(around, bucket, batch=3)
    layer = np.tanh(network.hidden + sum(network.embedding[k][around[:, k]] for k in range(4)))
    logits = layer @ network.output + network.bias
    logs = logits - np.log(np.exp(logits).sum(axis=1))[:, None]
    want = logs[np.arange(len(bucket)), network.classes[bucket]] + network.inside[bucket]
    assert np.allclose(got, want, atol=1e-4)
    # All buckets together have probability one.
    assert abs(np.exp(network.inside + logs[0][network.classes]).sum() - 1) < 1e-3


def test_training_lowers_the_loss_and_scores_every_row(spark, tmp_path):
    draw = random.Random(9)
    rows = []
    for i in range(300):
        pairs = [draw.choice(["red fox", "blue sky", "old tree", "big dog"]) for _ in range(60)]
        rows.append((i, " ".join(pairs), "en", "s", None))
    rows += [(900, None, None, None, None), (901, "", "en", "s", None), (None, "red sky", "en", "s", None), (902, "dog " * 40000, "en", "s", 1)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("id", F.lit("clash"))
    docs.repartition(2).write.parquet(f"{tmp_path}/documents.parquet")
    found = {r.doc_id: r for r in queries.op3_lm_score(spark, str(tmp_path)).collect()}
    assert len(found) == len(rows)
    assert found[900].log_probability == 0 and found[900].score is None and found[901].n_words == 0
    assert found[0].n_words == 120 and abs(found[0].score * 120 - found[0].log_probability) < 1e-6
    untrained = lm_score.score(docs, lm_score.trained(docs, rounds=0)).where("id < 300").agg(F.avg("score")).first()[0]
    assert np.mean([found[i].score for i in range(300)]) > untrained + 0.3
    # A shuffled text is less likely than one in order.
    words = rows[0][1].split()
    draw.shuffle(words)
    network = lm_score.trained(docs)
    pair = spark.createDataFrame([(0, rows[0][1]), (1, " ".join(words))], "doc_id long, text string")
    scored = {r.id: r.score for r in lm_score.score(pair, network).collect()}
    assert scored[0] > scored[1]
    assert lm_score.score(docs.limit(0), network).count() == 0
    assert lm_score.trained(docs.limit(0)).weights().size == network.weights().size


def test_every_word_is_a_target_once(monkeypatch):
    """Over the rounds of a training, by the classes of the words; texts of period 8 have a word a place."""
    places = [[f"{chr(97 + text)}{place}" for place in range(8)] for text in range(5)]
    batch = pa.RecordBatch.from_pydict({"text": [" ".join(x * 50) for x in places] + [None, "", "one", "one two"]})
    words = Words.of(batch.column("text"))
    network = lm_score.Network.fresh(np.bincount(lm_score.word_buckets(words), minlength=lm_score.BUCKETS).astype(float))
    seen = []
    monkeypatch.setattr(lm_score.Descent, "step", lambda self, around, target: seen.append(target))
    shared = type("Shared", (), {"value": network})
    for turn in range(lm_score.ROUNDS):
        list(lm_score.train_rows(shared, turn, lm_score.ROUNDS)(iter([batch])))
    got = np.bincount(np.concatenate(seen), minlength=lm_score.CLASSES)
    want = np.bincount(network.classes[lm_score.word_buckets(words)], minlength=lm_score.CLASSES)
    assert got.tolist() == want.tolist()
