"""Small tables with every awkward case, and brute-force restatements."""

from __future__ import annotations

import random

import pytest

WORDS = "the of and in to that is was he for it with as his on be at by this had not are but from or have an they which one you were all her she there would their we him been has when who will no more if out so up said what its about than into them can only other time new some could these two may first then do any like my now over such our man me even most made after also did many off before must well back through years where much your way down should because long each just state those people too mr how little good world".split()


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) + str(rng.randrange(60)) * (rng.random() < 0.4) for _ in range(n))


def awkward_texts(seed: int = 0) -> list[str | None]:
    rng = random.Random(seed)
    base = prose(rng, 120)
    words = base.split()
    near = " ".join([*words[:60], "changed", *words[61:]])
    return [None, "", " ", "\n\t", "a", "one two", base, base, near, base + " tail", "x" * 900, "é" * 300, prose(rng, 5000), "ab " * 400, "\n".join(["same line here"] * 9), *(prose(rng, rng.randrange(1, 400)) for _ in range(25))]


def documents(spark, texts, ids=None):
    """With extra columns whose names the operators use inside."""
    ids = list(range(len(texts))) if ids is None else ids
    rows = [(i, t, ("en", "fr", None)[k % 3], f"s{k % 2}", None if t is None else len(t), 1, "x") for k, (i, t) in enumerate(zip(ids, texts, strict=True))]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, n long, digest string")


@pytest.fixture
def docs(spark):
    return documents(spark, awkward_texts())
