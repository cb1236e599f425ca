import pytest

#: Columns that clash with names the operators use inside.
EXTRA = {"h1": 1, "key": "k", "raw": "r", "n": 2, "label": 3, "pattern": 4, "rank": 5, "anchor": 6, "piece": "p", "token": 7, "h2": 8, "first": 9, "spans": "s", "items": "i", "doc_ids": "d", "terms": "t", "head": 10, "c0": 11, "w": 12, "size": 13}


@pytest.fixture(scope="session")
def make(spark):
    """Documents of (doc_id, text) rows, with extra columns whose names clash."""
    from pyspark.sql import functions as F

    def f(rows, extra=True):
        df = spark.createDataFrame(rows, "doc_id bigint, text string")
        return df.withColumns({k: F.lit(v) for k, v in EXTRA.items()}) if extra else df

    return f


@pytest.fixture(scope="session")
def texts():
    import random

    rng = random.Random(8)
    syllables = ["an", "the", "ou", "él", "ing", "on", "st", "re", "er", "ß"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randrange(1, 4)))
    line = lambda: " ".join(word() for _ in range(rng.randrange(6, 30))) + "."
    base = ["\n".join(line() for _ in range(rng.randrange(1, 7))) for _ in range(40)]
    shared = line()
    out = list(base)
    for t in base[:12]:
        w = t.split(" ")
        for _ in range(3):
            v = list(w)
            v[rng.randrange(len(v))] = word()
            out.append(" ".join(v))
    out += base[:5] + [shared + "\n" + line() for _ in range(8)]
    out += ["", " \n\t", "one", "two words", "a b c", "A B C", "word " * 300, None, "x" * 3000, shared]
    rows = list(enumerate(out))
    rng.shuffle(rows)
    return rows
