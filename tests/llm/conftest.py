import random

import pytest


DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string"


def make_texts():
    """Edge cases, copies, near copies, shared passages, a very long text. (The column score clashes with one of ours.)"""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7)))
    para = lambda n: " ".join(word() for _ in range(n))
    base, passage = para(120), para(60)
    texts = [None, "", " \t\n ", "one", "Two words", "\n\n", base, base, base.upper(), passage + "\n" + para(40), para(30) + "\n" + passage, passage]
    for k in range(12):  # near copies in a chain, each a word further
        words = base.split()
        for j in range(k + 1):
            words[9 * j] = "changed"
        texts.append(" ".join(words))
    texts += [f"{para(20)}\n Shared Line \n{para(10)}" for _ in range(11)] + ["shared line\n" * 3]
    texts += [para(9) for _ in range(5)] + [para(40_000), "x" * 3000, "ab" * 900, "MIT license and CC BY, cc by", "Released under the MIT License.", "Licensed under the Apache License, Version 2.0."]
    return texts


@pytest.fixture(scope="session")
def rows():
    out = [(i, t, "en", [None, "b", "a", "hot", "hot"][i % 5], 0, "s") for i, t in enumerate(make_texts())]
    return [*out, out[6], (None, "null id", "en", "a", 0, "s"), (None, None, None, None, None, None)]


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(5)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
