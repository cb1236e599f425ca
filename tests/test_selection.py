import random

from pyspark.sql import functions as F

from tracewise.operators import selection


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def sim(a, b):
    return 1 - distance(a, b) / max(len(a), len(b), 1)


def greedy(pool, anchors, k):
    pool, chosen = list(pool), []
    while pool and len(chosen) < k:
        worth = [0.7 * max([sim(x, a) for a in anchors], default=0.0) - (1 - 0.7) * max([sim(x, c) for c in chosen], default=0.0) for x in pool]
        chosen.append(pool.pop(worth.index(max(worth))))
    return chosen


def test_diverse_equals_a_greedy_loop(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abé") for _ in range(rng.randrange(5)))
    rows = [(k, [word() for _ in range(rng.randrange(6))], [word() for _ in range(rng.randrange(3))]) for k in range(60)]
    df = spark.createDataFrame(rows, "k int, pool array<string>, anchors array<string>")
    got = {r["k"]: r["x"] for r in df.select("k", selection.diverse(F.col("pool"), F.col("anchors"), 3).alias("x")).collect()}
    assert got == {k: greedy(p, a, 3) for k, p, a in rows}


def test_question_has_its_answer(spark):
    rows = [("i", ["aa"], ["ab", "bb", "cc", "dd"], False), ("j", ["aa"], ["ab", "bb", "cc"], True)]
    df = spark.createDataFrame(rows, "id string, c array<string>, w array<string>, f boolean")
    q = selection.assemble(F.col("c"), F.col("w"), F.col("f"), 42, "id")
    got = {r["id"]: r["q"] for r in df.select("id", q.alias("q")).collect()}
    assert len(got["i"]["choices"]) == 6
    assert got["i"]["choices"]["abcdef".index(got["i"]["answer"][0])] == "aa"
    assert got["j"]["answer"] == ["e"]
    assert got["j"]["choices"][4:] == [selection.NONE, selection.UNKNOWN]


def test_bag_difference_and_samples(spark):
    a = F.array(*map(F.lit, "xyxz"))
    row = spark.range(1).select(selection.minus(a, F.array(F.lit("y"))).alias("m"), selection.sampled(a, 2, 1).alias("s"), selection.sampled(a, 9, 1).alias("t")).first()
    assert row["m"] == ["x", "x", "z"]
    assert len(row["s"]) == 2
    assert sorted(row["t"]) == list("xxyz")


def test_sorted_letter_and_expanded(spark):
    c = F.array(*map(F.lit, ["q", "b", "z"]))
    assert spark.range(1).select(selection.sorted_letter(c, F.lit("q"))).first()[0] == "b"
    assert spark.range(1).select(selection.expanded(F.array(F.lit("a")), c, "no")).first()[0] == ["a", "q", "b", "z", "no"]
    assert spark.range(1).select(selection.expanded(F.array(F.lit("q")), c, "no")).first()[0] is None
