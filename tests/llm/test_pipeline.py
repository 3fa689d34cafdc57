"""The pipeline against its stages by brute force, on a small corpus with planted cases."""

import random
from collections import Counter

import pytest
import test_decontaminate
import test_line_dedup
import test_mixing
import test_ngram_join
from helpers import documents

import __spark_entry__ as contract
import corpus_pipeline
from rowloom.llm import toxicity


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """Clean, toxic, leaking, copied and nearly copied documents, and documents that share passages."""
    draw = random.Random(11)
    words = [f"{a}{b}" for a in ("ra", "lo", "mi", "ne", "su", "ti", "ko") for b in ("ban", "der", "fil", "gor", "hum", "jat")]

    def prose(n):
        return " ".join(draw.choice(words) for _ in range(n))

    items = [(k, prose(draw.randint(20, 50))) for k in range(6)]
    passage = prose(60)
    rows, labels = [], []
    for i in range(240):
        lines = [prose(draw.randint(5, 30)) for _ in range(draw.randint(1, 6))]
        toxic = draw.random() < 0.25
        kind = draw.random()
        if toxic:
            lines[0] += " zounds blight gruntish zounds"
        elif kind < 0.1:
            lines.insert(draw.randint(0, len(lines)), draw.choice(items)[1])
        elif kind < 0.2:
            lines.insert(draw.randint(0, len(lines)), passage)
        elif kind < 0.3 and rows:
            lines = [draw.choice(rows)[1]]
        elif kind < 0.45 and rows:
            text = draw.choice(rows)[1].split(" ")
            text[draw.randrange(len(text))] = "edited"
            lines = [" ".join(text)]
        text = "\n".join(lines)
        rows.append((i, text, "en", f"src{i % 3}"))
        labels.append((i, 1, int("gruntish" in text)))
    rows += [(500, "", "en", "src1"), (501, "short", "en", None)]
    folder = str(tmp_path_factory.mktemp("corpus"))
    documents(spark, rows).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, rows, labels, items


def test_run_as_brute_force(spark, corpus):
    folder, rows, labels, items = corpus
    got = corpus_pipeline.run(spark, folder)
    table = {r[0]: r for r in rows}

    model = toxicity.fit_toxicity(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet"))
    kept = [(i, text) for i, text, *_ in rows if model.score([text])[0] < 0.5]
    toxic = {i for i, _, t in labels if t}
    assert not toxic & {i for i, _ in kept} and len(kept) >= 0.98 * (len(rows) - len(toxic))

    cut = test_line_dedup.brute(kept, 50)
    kept = [(i, text) for i, text, gone in cut if not gone or text.strip(" \t\r\n")]
    kept = [(i, text) for i, text in kept if next(c for j, _, c in test_ngram_join.brute(kept) if j == i) == i]
    leaks = {d for d, _ in test_decontaminate.brute(kept, items)}
    assert leaks
    kept = [(i, text) for i, text in kept if i not in leaks]

    n = Counter(table[i][3] for i, _ in kept)
    expect = Counter()
    for i, text in kept:
        copies = test_mixing.inverted(len(kept) / len(n) / n[table[i][3]], test_mixing.uniform(i))
        expect.update({(i, text, table[i][3]): copies})
    assert Counter((r.doc_id, r.text, r.source) for r in got.collect()) == +expect


def test_stages(spark, corpus):
    folder, *_ = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "ngram_jaccard_join", "decontamination", "mixing"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        made = stage(spark, docs, folder)
        assert made.columns == docs.columns
        assert {r.doc_id for r in made.collect()} <= {r.doc_id for r in docs.collect()}
        assert 500 in {r.doc_id for r in made.collect()}


def test_stages_on_odd_rows(spark, corpus):
    folder, *_ = corpus
    rows = [(1, None, None, None), (1, None, None, None), (None, "text without id", "en", "s"), (2, "", "en", "s"), (3, "word " * 30_000, "en", "s")]
    for start in (rows, []):
        docs = documents(spark, start, clashing=True)
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, folder)
        assert docs.count() >= 0


def test_registered():
    names = contract.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
