import random

import pytest
from helpers import collected, documents, duck

from rowloom.llm import line_dedup as L


def brute(rows, least):
    """All maximal runs of equal lines, by comparing every two places; later copies with enough words go."""
    places = [(d, n, line.strip(" \t\r")) for d, text in sorted(rows) for n, line in enumerate(text.split("\n"))]
    places = [p for p in places if p[2]]
    gone = set()
    for i in range(len(places)):
        for j in range(i):
            a, b, words = i, j, 0
            if j and places[i - 1][0] == places[i][0] and places[j - 1][0] == places[j][0] and places[i - 1][2] == places[j - 1][2]:
                continue
            while a < len(places) and places[a][0] == places[i][0] and places[b][0] == places[j][0] and places[a][2] == places[b][2]:
                words += len(places[a][2].split())
                a, b = a + 1, b + 1
            if words >= least:
                gone.update(places[k][:2] for k in range(i, a))
    return sorted(
        (d, "\n".join(line for n, line in enumerate(text.split("\n")) if (d, n) not in gone), sum((d, n) in gone for n in range(text.count("\n") + 1)))
        for d, text in rows
    )


def made(seed):
    draw = random.Random(seed)
    lines = [" ".join(f"l{k}" for _ in range(draw.randint(1, 6))) for k in range(6)] + ["", "  "]
    rows = []
    for i in range(14):
        body = [draw.choice(lines) for _ in range(draw.randint(0, 12))]
        if rows and draw.random() < 0.6:
            other = draw.choice(rows)[1].split("\n")
            at = draw.randrange(len(other))
            body[len(body) // 2 : len(body) // 2] = other[at : at + draw.randint(1, 8)]
        rows.append((i, "\n".join(body)))
    return rows


@pytest.mark.parametrize("seed", range(4))
def test_as_brute_force(spark, seed):
    rows = made(seed)
    got = sorted((r.doc_id, r.text, r.n_deleted) for r in L.dedup_lines(documents(spark, rows), min_words=9).collect())
    assert got == brute(rows, 9)


def test_as_sql_twin(spark):
    draw = random.Random(3)
    pool = [" ".join(f"v{draw.randrange(30)}" for _ in range(draw.randint(3, 70))) for _ in range(12)]
    rows = [(i, "\n".join(draw.choice(pool) for _ in range(draw.randint(1, 9)))) for i in range(40)]
    assert sorted(collected(L.dedup_lines(documents(spark, rows)))) == sorted(duck(rows, L.ORACLE))


def test_defined_cases(spark):
    long = " ".join(["word"] * 60)
    rows = [
        (5, long), (2, f"first\n  {long}\t\nlast"), (2, f"first\n  {long}\t\nlast"), (None, f"{long}\nafter"), (7, None), (8, ""),
        (9, f"{long}\n\n{long}\nend"), (1, " ".join(["word"] * 49)), (3, " ".join(["word"] * 49)),
    ]
    df = documents(spark, rows, clashing=True)
    made = L.dedup_lines(df)
    assert made.columns == [*df.columns, "_n_lines", "_n_deleted"]
    got = sorted(((r.doc_id, r.text, r._n_lines, r._n_deleted) for r in made.collect()), key=str)
    twice = (2, f"first\n  {long}\t\nlast", 3, 0)
    expect = [
        (5, "", 1, 1), twice, twice, (None, "after", 2, 1), (7, None, 0, 0), (8, "", 0, 0), (9, "\nend", 3, 2),
        (1, " ".join(["word"] * 49), 1, 0), (3, " ".join(["word"] * 49), 1, 0),
    ]
    assert got == sorted(expect, key=str)
    kept = L.drop_repeats(df)
    assert kept.columns == df.columns
    assert 5 not in {r.doc_id for r in kept.collect()} and {7, 8} <= {r.doc_id for r in kept.collect()}
    assert {r.doc_id: r.n_chars for r in kept.collect()}[9] == 4
    assert L.dedup_lines(documents(spark, [])).count() == 0


def test_long_text(spark):
    lines = [f"line {i} has five words" for i in range(3000)]
    rows = [(1, "\n".join(lines)), (2, "\n".join(["x", *lines[100:2900], "y"]))]
    got = {r.doc_id: (r.text, r.n_deleted) for r in L.dedup_lines(documents(spark, rows)).collect()}
    assert got[1] == (rows[0][1], 0) and got[2] == ("x\ny", 2800)


def test_a_hundred_thousand_lines(spark):
    """One log file: every line new, but for a third of them that repeats an earlier stretch of the file."""
    lines = [f"at {i} something of four" for i in range(70_000)]
    text = "\n".join([*lines, *lines[20_000:50_000]])
    row = L.dedup_lines(documents(spark, [(1, text)])).first()
    assert (row.n_lines, row.n_deleted) == (100_000, 30_000) and row.text == "\n".join(lines)


def test_one_line_again_and_again(spark):
    """The stretch overlaps itself: its first runs stay, what only later runs hold goes."""
    rows = [(1, "\n".join(["five words are in here"] * 400))]
    got = L.dedup_lines(documents(spark, rows)).first()
    assert (got.text, got.n_deleted) == brute(rows, L.MIN_WORDS)[0][1:]


@pytest.mark.parametrize("copies", [2, 3000])
def test_rows_repeated_many_times(spark, copies):
    text = "\n".join(f"{i} with some words more" for i in range(20))
    rows = [(7, text)] * copies + [(8, f"own\n{text}")]
    got = L.dedup_lines(documents(spark, rows)).collect()
    assert sorted((r.doc_id, r.n_deleted) for r in got) == [(7, 0)] * copies + [(8, 20)]
