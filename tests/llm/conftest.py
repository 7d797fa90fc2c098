import random

import pytest
from pyspark.sql import DataFrame

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node string, _dart_id long"


@pytest.fixture(scope="session")
def documents(spark) -> DataFrame:
    """A corpus with copies, near copies, shared passages, nulls, empty texts and names that clash."""
    rng = random.Random(11)
    vocabulary = {lang: ["".join(rng.choice(parts) for _ in range(rng.randint(1, 3))) for _ in range(300)]
                  for lang, parts in (("en", ["the", "ing", "er", "on", "th", "wh"]), ("fr", ["eau", "oi", "é", "que", "la", "ux"]))}

    def prose(lang, n):
        return " ".join(rng.choice(vocabulary[lang]) + rng.choice(["", "", "", ",", "."]) for _ in range(n))

    rows, passage = [], prose("en", 60)
    for i in range(120):
        lang = "en" if i % 3 else "fr"
        text = prose(lang, rng.randint(30, 200))
        if i % 10 == 4:
            text += "\n" + passage
        rows.append([i, text, lang, f"s{i % 3}"])
    for i in range(40):
        base = rows[i % 12][1].split(" ")
        for _ in range(rng.randint(0, 3)):
            base[rng.randrange(len(base))] = rng.choice(["new", "NEW!", "other"])
        rows.append([200 + i, " ".join(base), rows[i % 12][2], "hot"])
    rows += [[300, None, "en", None], [301, "", None, "hot"], [302, "!!! ???", "en", "hot"], [303, "One two", "en", "hot"],
             [304, "one TWO", "en", "hot"], [305, prose("en", 9000), "en", "hot"], [0, rows[0][1], rows[0][2], "s0"],
             [None, "no id here but some words follow it", "en", "hot"], [306, "x" * 3000, "en", "hot"]]
    rows = [(d, t, lang, s, None if t is None else len(t), "clash", 7) for d, t, lang, s in rows]
    return spark.createDataFrame(rows, SCHEMA).repartition(4).cache()


@pytest.fixture(scope="session")
def no_documents(spark) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)
