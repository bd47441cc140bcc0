import random

import pytest
from pyspark.sql import functions as F

from parcelflow.llm import line_dedup as L

from .conftest import ODD_TEXTS


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def edited(draw, text, edits, letters="abcé"):
    text = list(text)
    for _ in range(edits):
        at = draw.randrange(len(text))
        kind = draw.choice("rid")
        if kind == "r":
            text[at] = draw.choice(letters)
        elif kind == "i":
            text.insert(at, draw.choice(letters))
        elif len(text) > 1:
            del text[at]
    return "".join(text)


def brute(texts, use):
    """Dropped lines by comparing every line with all earlier ones."""
    seen, out = [], []
    order = sorted(range(len(texts)), key=lambda i: i)
    for i in order:
        gone = []
        for n, line in enumerate((texts[i] or "").split("\n") if texts[i] is not None else []):
            if len(line) < use.min_chars:
                continue
            if any(abs(len(x) - len(line)) <= use.threshold and distance(x, line) <= use.threshold for x in seen):
                gone.append(n)
            seen.append(line)
        out.append(gone)
    return out


def made_texts(seed, n=60, letters="abcé"):
    draw = random.Random(seed)
    base = ["".join(draw.choice(letters) for _ in range(draw.randint(8, 16))) for _ in range(6)]
    return [
        "\n".join(edited(draw, draw.choice(base), draw.randint(0, 4), letters) for _ in range(draw.randint(0, 4)))
        for _ in range(n)
    ]


@pytest.mark.parametrize("threshold", [1, 2, 3])
def test_banded_distance(spark, threshold):
    draw = random.Random(threshold)
    pairs = []
    for _ in range(400):
        a = "".join(draw.choice("abé") for _ in range(draw.randint(threshold + 1, 14)))
        b = edited(draw, a, draw.randint(0, threshold + 2))
        if abs(len(a) - len(b)) <= threshold and b:
            pairs.append((a, b, distance(a, b)))
    df = spark.createDataFrame(pairs, "a string, b string, d int")
    got = df.select("a", "b", "d", L.banded_distance(F.split("a", ""), F.split("b", ""), threshold).alias("g"))
    for a, b, d, g in got.collect():
        assert (g == d) if d <= threshold else g > threshold, (a, b, d, g)


@pytest.mark.parametrize("threshold, hot", [(1, 1000), (2, 1000), (2, 0), (1, 1), (3, 2)])
def test_dropped_lines_against_brute_force(docs_of, threshold, hot):
    use = L.Settings(min_chars=8, threshold=threshold, hot=hot, short=9)
    texts = made_texts(10 * threshold + hot % 7)
    rows = L.report(docs_of(texts), use).orderBy("doc_id").collect()
    assert [r["dropped"] for r in rows] == brute(texts, use)


def test_candidates_miss_no_pair(spark):
    draw = random.Random(1)
    base = "".join(draw.choice("abcdefgh") for _ in range(30))
    lines = sorted({edited(draw, base, draw.randint(0, 3), "abcdefgh") for _ in range(80)})
    df = spark.createDataFrame(list(enumerate(lines)), "id bigint, line string")
    want = {
        (i, j) for i, a in enumerate(lines) for j, b in enumerate(lines) if i < j and distance(a, b) <= 2
    }
    for use in (L.Settings(), L.Settings(hot=3), L.Settings(hot=0, short=100)):
        got = {tuple(r) for r in L.candidate_pairs(df, use).collect()}
        assert want <= got


def test_texts_and_columns(docs_of):
    long = "a line that is long enough to count, number {}"
    docs = docs_of([
        "\n".join([long.format(1), "short", long.format("two hundred")]),
        "\n".join(["short", long.format(7), "something else that nobody has said"]),
        long.format(1),
        None, "", "short", (None, "an own line that comes before all"), (9, "an own line that comes before all!"),
    ]).withColumn("dropped", F.lit("mine")).withColumn("line_key", F.lit(1))
    kept = L.without_repeats(docs)
    assert kept.columns == docs.columns
    rows = {r["doc_id"]: (r["text"], r["n_chars"]) for r in kept.collect()}
    assert rows[0][0] == "\n".join([long.format(1), "short", long.format("two hundred")])
    assert rows[1] == ("short\nsomething else that nobody has said", 41)
    assert rows[None][0] == "an own line that comes before all"
    assert set(rows) == {0, 1, 3, 4, 5, None}
    assert rows[3][0] is None and rows[4][0] == ""


def test_odd_rows(docs_of):
    docs = docs_of([*ODD_TEXTS, (3, "x" * 30), (3, "x" * 30), (3, "y" + "x" * 30)])
    rows = L.report(docs).collect()
    assert len(rows) == len(ODD_TEXTS) + 3
    assert L.report(docs.limit(0)).count() == 0


def test_exact_repeats_of_short_lines(docs_of):
    docs = docs_of(["Read more\n|\nRead more", "Read more\n|\nRead morf\nx"])
    dropped = lambda use: {r["doc_id"]: r["dropped"] for r in L.report(docs, use).collect()}
    assert dropped(L.Settings(short_repeats=True)) == {0: [2], 1: [0]}
    assert dropped(L.Settings()) == {0: [], 1: []}
