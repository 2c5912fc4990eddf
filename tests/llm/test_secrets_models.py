"""The model of ordinary identifiers sees all whole texts."""

import random

import numpy as np

from tessera.llm import secrets


def test_words_of_late_rows_and_late_parts_count(spark):
    draw = random.Random(2)
    rare = ["zqxvkj", "jqzxwv", "xkqjzv", "vzxqkw"]
    rows = [(n, " ".join("".join(draw.choices("aeionrst", k=6)) for _ in range(600))) for n in range(900)]
    fitted = secrets.fit(spark.createDataFrame(rows, "doc_id long, text string"))
    every = secrets.fit(spark.createDataFrame([(n, f"{t} {' '.join(rare)}") for n, t in rows], "doc_id long, text string"))
    name = "_".join(rare)
    assert every.score(name) < fitted.score(name) - 0.5


def test_counts_equal_identifiers_spelled_out():
    words = "alpha beta gamma delta eps zeta eta".split()
    total = secrets.identifier_counts([None, " ".join(words), "", "Alpha alpha"])
    n = len(secrets.CHARS) + 1
    names = [words[:2], words[2:5], words[5:], ["alpha"]]
    camel = [p[0] + "".join(w.capitalize() for w in p[1:]) for p in names]
    for k, own in enumerate((["_".join(p) for p in names], camel, ["".join(p) for p in names])):
        assert (total[k * n**3 : (k + 1) * n**3].reshape(n, n, n) == secrets.triples(own)).all()
    styles = [j(p) for p in names for j in ("_".join, "-".join, "/".join, "".join, lambda p: "_".join(p).upper())] + camel
    numbered = sum(secrets.NUMBERED / secrets.NUMBERS * (secrets.triples(s + str(k) for s in styles) - secrets.triples(styles)) for k in range(secrets.NUMBERS))
    assert np.allclose(secrets.ordinary_counts(total), secrets.triples(styles) + numbered)
