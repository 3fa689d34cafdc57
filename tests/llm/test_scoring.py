"""Classifiers, language and tokens: held-out accuracy on the given tables, exact parts by brute force."""

import base64
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from helpers import FOLDER, collected, documents
from pyspark.sql import functions as F

from rowloom.llm import langid, quality, token_count, toxicity
from rowloom.llm.common import held_out, labelled_texts, pieces

LABELS = "doc_id long, quality int, toxic int"


@pytest.fixture(scope="module")
def given(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet"), spark.read.parquet(f"{FOLDER}/labels.parquet")


def labelled(spark, n=300, seed=1):
    """Documents with planted toxic words and noisy ones of low quality, and their labels."""
    draw = random.Random(seed)
    words = [f"{a}{b}{c}" for a in ("ka", "lo", "mi", "ne") for b in ("ra", "su", "ti") for c in ("", "n", "st", "el")]
    rows, labels = [], []
    for i in range(n):
        text = [draw.choice(words) for _ in range(draw.randint(20, 80))]
        toxic, good = int(draw.random() < 0.3), int(draw.random() < 0.7)
        if toxic:
            for _ in range(3):
                text[draw.randrange(len(text))] = draw.choice(["zounds", "blight", "gruntish"])
        if not good:
            text = [w.upper() + "!!" for w in text]
        rows.append((i, " ".join(text)))
        labels.append((i, good, toxic))
    return documents(spark, rows), spark.createDataFrame(labels, LABELS)


def accuracy(scored, labels, label):
    rows = scored.filter("held_out").join(labels, "doc_id").select("predicted", label).collect()
    return sum(r[0] == r[1] for r in rows) / len(rows)


def test_held_out_follows_crc32(spark):
    got = spark.range(200).select("id", held_out(F.col("id"), 5, 0).alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 5 == 0) for r in got)


def test_pieces_keep_every_character():
    texts = ["", "a" * 50, "word " * 40, "x\ny z", " lead", "tail "]
    for limit in (7, 13, 1000):
        joined = defaultdict(str)
        for batch in pieces(texts, limit):
            for i, part in batch:
                joined[i] += part
        assert [joined[i] for i in range(len(texts))] == texts


def test_toxicity(spark):
    docs, labels = labelled(spark)
    scored = toxicity.score_toxicity(docs, labels).cache()
    assert accuracy(scored, labels, "toxic") > 0.9
    assert {r.held_out for r in scored.collect()} == {True, False}
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in scored.collect())


def test_toxicity_of_the_given_tables(spark):
    docs, labels = (spark.read.parquet(f"{FOLDER}/../sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = toxicity.score_toxicity(docs, labels).join(labels, "doc_id").select("predicted", "toxic").collect()
    assert sum(r.predicted and not r.toxic for r in rows) <= 0.03 * len(rows)
    assert sum(r.predicted and r.toxic for r in rows) >= 0.6 * sum(r.toxic for r in rows)


def test_folding_and_exceptions():
    assert toxicity.fold("Ѕtup1d, m0r0n! tr@sh") == " stupid moron trash "
    model = toxicity.ToxicityModel({" trash ": 5.0, " tras": 4.0, " moron ": 6.0}, ("trash can",), (0.0, 1.0, 0.0, 0.0, 0.0))
    assert model.features("TRASH")[:2] == (5.0, 1.0)
    assert model.features("a trash can here")[:2] == (0.0, 0.0)
    assert model.features("a trashy trash, m0ron")[:2] == (15.0, 3.0)
    assert model.features(None) == model.features("") == model.features("?!") == (0.0, 0.0, 0.0, 0.0)
    text = "trash " * 5 + "x " * 20
    assert model.features(text)[2] == pytest.approx(25 / 25**0.5)


def test_exception_phrases_are_learned(spark):
    draw = random.Random(5)
    words = [f"{a}{b}" for a in ("ka", "lo", "mi", "ne") for b in ("ra", "su", "ti", "vo")]
    rows, labels = [], []
    for i in range(400):
        text, toxic = [draw.choice(words) for _ in range(20)], i % 4 == 0
        if toxic:
            text[3:3] = ["blight"] if i % 8 else ["zounds"]
        elif i % 40 == 1:
            text[5:5] = ["garden", "blight"]
        rows.append((i, " ".join(text)))
        labels.append((i, 1, int(toxic)))
    model = toxicity.fit_toxicity(documents(spark, rows), spark.createDataFrame(labels, LABELS), min_log_odds=1.5)
    assert " blight " in model.lexicon and " garden blight " in model.exceptions
    assert not any(p.startswith(" blight ") or "zounds" in p for p in model.exceptions)
    assert model.features("kara garden blight losu")[:2] == (0.0, 0.0)
    assert model.features("kara blight losu")[1] == 1.0
    low, high = model.score(["kara garden blight losu", "kara blight losu"])
    assert low < 0.5 < high


def test_pairs_around_entries():
    assert toxicity.pairs_around(" a trash can b ", {" trash "}) == {" a trash ", " trash can "}
    assert toxicity.pairs_around(" a trashy can ", {" tras"}) == {" a trashy ", " trashy can "}
    assert toxicity.pairs_around(" tras ", {" tras"}) == set() == toxicity.pairs_around("  ", {" tras"})


def test_lexicon_has_no_limit(spark):
    many = [f"w{i}" for i in range(21_000)]
    rows = [(i, " ".join(many)) for i in range(4)] + [(i, "plain words") for i in range(4, 400)]
    labels = spark.createDataFrame([(i, 1, int(i < 4)) for i in range(400)], LABELS)
    model = toxicity.fit_toxicity(documents(spark, rows), labels, folds=1_000_003, min_docs=2)
    assert sum(e.endswith(" ") for e in model.lexicon) == 21_000


def test_an_id_teaches_once(spark):
    docs, labels = labelled(spark, 60)
    again = docs.filter("doc_id < 3")
    for _ in range(5):
        again = again.unionByName(again)
    other = documents(spark, [(1, "~ greater than the others"), (2, None)])
    chosen = labels.select("doc_id", F.col("toxic").alias("label"))
    got = sorted(collected(labelled_texts(docs.unionByName(again).unionByName(other), chosen).select("doc_id", "text")))
    assert got == sorted(collected(docs.select("doc_id", "text")))


def test_automaton_finds_what_brute_force_finds():
    draw = random.Random(2)
    lexicon = {f" {''.join(draw.choice('abc') for _ in range(draw.randint(1, 3)))}{' ' * draw.randint(0, 1)}": float(draw.randint(1, 9)) for _ in range(12)}
    model = toxicity.ToxicityModel(lexicon, (), ())
    for _ in range(100):
        text = " ".join("".join(draw.choice("abcd") for _ in range(draw.randint(1, 4))) for _ in range(draw.randint(1, 12)))
        folded, found = toxicity.fold(text), {}
        for entry, weight in lexicon.items():
            for at in range(len(folded)):
                if folded.startswith(entry, at):
                    found[at] = max(found.get(at, 0), weight)
        assert model.features(text)[:2] == (sum(found.values()), len(found))


def test_quality(spark):
    docs, labels = labelled(spark, 400)
    scored = quality.score_quality(docs, labels).cache()
    assert accuracy(scored, labels, "quality") > 0.9
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in scored.collect())


def test_word_vectors_as_brute_force(spark):
    rows = [(1, "one two three two"), (2, "two one"), (3, None), (4, "")]
    places, signs = quality.index_vectors()

    def own(b):
        v = np.zeros(quality.DIM)
        v[places[b]] = signs[b]
        return v

    context = defaultdict(lambda: np.zeros(quality.DIM))
    for _, text in rows:
        ids = quality.token_ids(text or "").tolist()
        for i, b in enumerate(ids):
            for j in range(max(0, i - quality.WINDOW), min(len(ids), i + quality.WINDOW + 1)):
                if j != i:
                    context[b] += own(ids[j])
    vectors = quality.word_vectors(documents(spark, rows).repartition(3))
    for b in range(quality.BUCKETS):
        v = own(b) / 2
        if b in context:
            v = v + context[b] / max(np.linalg.norm(context[b]), 1e-9)
        assert np.allclose(vectors[b], v / np.linalg.norm(v))


def test_temperature_lowers_overconfidence():
    draw = np.random.default_rng(1)
    p = draw.uniform(0.05, 0.95, 4000)
    y = (draw.random(4000) < p).astype(float)
    assert quality.calibrate(3 * np.log(p / (1 - p)), y) == pytest.approx(3, rel=0.2)


def test_languages_of_the_given_tables(given):
    docs, _ = given
    rows = langid.identify_languages(docs).filter("held_out").join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.97 * len(rows)


def test_languages_in_several_models(spark, given):
    docs, _ = given
    docs = docs.withColumn("lang", F.concat("lang", F.lit("-"), (F.col("doc_id") % 3).cast("string")))
    docs = docs.unionByName(documents(spark, [(None, "the words"), (90_001, None), (90_002, "12 !")]))
    whole = sorted(collected(langid.identify_languages(docs)), key=str)
    parts = sorted(collected(langid.identify_languages(docs, model_langs=4)), key=str)
    assert len({r[2] for r in whole}) > 4
    assert [r[:3] for r in whole] == [r[:3] for r in parts]
    assert np.allclose([r[3] for r in whole], [r[3] for r in parts])


def test_naive_bayes_as_brute_force(given):
    docs, _ = given
    rows = docs.select("doc_id", "text", "lang").filter("lang IS NOT NULL").limit(60).collect()
    counts, kinds = defaultdict(lambda: defaultdict(int)), defaultdict(int)

    def grams(text):
        return [int(b) for buckets, _ in langid.gram_buckets([text or ""]) for b in buckets if b < langid.BUCKETS]

    for r in rows:
        if not zlib.crc32(str(r.doc_id).encode()) % 3 == 1:
            kinds[r.lang] += 1
            for b in grams(r.text):
                counts[r.lang][b] += 1
    totals = {lang: sum(c.values()) for lang, c in counts.items()}
    few = docs.filter(F.col("doc_id").isin([r.doc_id for r in rows]))
    got = {r.doc_id: r for r in langid.identify_languages(few).collect()}
    for r in rows:
        seen = grams(r.text)
        joint = {
            lang: (np.log(kinds[lang] / sum(kinds.values())) + sum(
                np.log((counts[lang][b] + 0.5) / (totals[lang] + 0.5 * langid.BUCKETS)) for b in seen
            )) / max(1, len(seen)) ** 0.5 for lang in sorted(kinds)
        }
        best = max(joint, key=joint.get)
        assert got[r.doc_id].lang_pred == best
        assert got[r.doc_id].score == pytest.approx(1 / sum(np.exp(j - joint[best]) for j in joint.values()), abs=1e-3)


def test_language_grams_as_brute_force():
    text = "Été! no1 x"
    seen = [[], [], []]
    for word in ("été", "no", "x"):
        padded = f" {word} "
        seen[0] += list(word)
        seen[1] += [padded[i : i + 2] for i in range(len(padded) - 1)]
        seen[2] += [padded[i : i + 3] for i in range(len(padded) - 2)]
    for order, (buckets, _) in enumerate(langid.gram_buckets([text])):
        assert int((buckets < langid.BUCKETS).sum()) == len(seen[order])
        assert len(set(buckets[buckets < langid.BUCKETS].tolist())) == len(set(seen[order]))


def test_token_counts_as_brute_force():
    draw = random.Random(4)
    for trial in range(60):
        vocabulary = {bytes(draw.choice(b"abc") for _ in range(draw.randint(1, 5))) for _ in range(draw.randint(1, 15))}
        if trial % 2:
            vocabulary |= {b"a", b"b", b"c"}
        automaton = token_count.build_automaton(sorted(vocabulary))
        for _ in range(60):
            word = bytes(draw.choice(b"abc") for _ in range(draw.randint(1, 14)))
            at = n = 0
            while at < len(word):
                size = max((k for k in range(1, 6) if word[at : at + k] in vocabulary), default=0)
                if not size:
                    n = token_count.UNMATCHED
                    break
                at, n = at + size, n + 1
            assert automaton.count(word) == n


def test_token_counts_of_texts(spark, tmp_path):
    file = tmp_path / "v.tiktoken"
    file.write_bytes(b"\n".join(base64.b64encode(t) + b" %d" % i for i, t in enumerate([b" ", b"a", b"b", b" a", b"ab"])))
    vocabulary = token_count.read_vocabulary(str(file))
    rows = [(1, "ab aab"), (2, None), (3, " \n"), (1, "ab aab"), (None, "a?"), (5, "a" * 100_000)]
    got = sorted(collected(token_count.count_tokens(documents(spark, rows, clashing=True), vocabulary)), key=str)
    assert got == sorted([(1, 2, 4, 0), (1, 2, 4, 0), (2, 0, 0, 0), (3, 0, 0, 0), (None, 1, 1, 1), (5, 1, 100_000, 0)], key=str)
    assert collected(token_count.count_tokens(documents(spark, []), vocabulary)) == []


def test_scorers_in_defined_cases(spark):
    docs, labels = labelled(spark, 120)
    odd = documents(spark, [(None, "kara losu"), (900, None), (901, ""), (901, ""), (902, "12 !?"), (903, "ka" * 20_000)], clashing=True)
    odd = odd.withColumns({"lang": F.lit(None).cast("string"), "source": F.lit(None).cast("string")})
    both = docs.unionByName(odd, allowMissingColumns=True)
    bad = spark.createDataFrame([(0, 0, 0), (0, 1, 1), (None, 1, 1), (901, None, None), (5, 7, 7)], LABELS)
    labels = labels.unionByName(bad)
    for scored in (toxicity.score_toxicity(both, labels), quality.score_quality(both, labels)):
        rows = scored.collect()
        assert len(rows) == 126 and all(0 <= r.score <= 1 for r in rows)
        assert not any(r.held_out for r in rows if r.doc_id is None)
    rows = {r.doc_id: r for r in langid.identify_languages(both).collect()}
    assert [rows[i].lang_pred for i in (900, 901, 902, 903, None)] == ["und", "und", "und", "en", "en"]
    assert rows[900].score == 0
    none = documents(spark, [])
    no_labels = spark.createDataFrame([], LABELS)
    assert toxicity.score_toxicity(none, no_labels).count() == quality.score_quality(none, no_labels).count() == 0
    assert langid.identify_languages(none).count() == 0
    assert {r.score for r in toxicity.score_toxicity(docs, no_labels).collect()} == {0.0}
    assert {r.score for r in quality.score_quality(docs, no_labels).collect()} == {0.5}
    kept = toxicity.drop_toxic(both, labels)
    assert kept.columns == both.columns and kept.filter("doc_id IS NULL OR doc_id >= 900").count() == 6
