"""Small documents with the awkward cases: nulls, empty, very long, ties, repeats, clashing columns."""

import random

import pytest

from tests.conftest import spark  # noqa: F401

WORDS = {"en": "the and of that with this from which house water ting ation", "fr": "le une des avec pour dans qui eau maison éàç tion ment", "de": "der die und nicht mit haus wasser ung heit schön über keit"}


def sentence(rng, lang, n):
    return " ".join(rng.choice(WORDS[lang].split()) + rng.choice(["", "s", "n", "e"]) for _ in range(n))


@pytest.fixture(scope="session")
def corpus():
    """Rows (doc_id, text, lang, source, n_chars)."""
    rng = random.Random(7)
    rows = []
    for i in range(60):
        lang = ["en", "fr", "de"][i % 3]
        rows.append((i, sentence(rng, lang, rng.randint(1, 120)), lang, f"src{i % 4}"))
    base = rows[30][1]
    words = base.split()
    near = " ".join(words[:-1] + ["changed"])
    rows += [(60, base, "en", "src1"), (61, near, "en", None), (62, None, None, None), (63, "", "en", "src0"), (64, " \t\n", None, "src0"), (65, "123 456", "en", "src2")]
    rows += [(66, sentence(rng, "en", 4000), "en", "src3"), (67, "x" * 5000, "en", "src3"), (68, base.upper(), "de", "src1"), (68, near, "de", "src1")]
    rows += [(69, 'say password = "Abcdefghijkl123" and AKIA' + "Z" * 16 + " deadbeef00112233445566", "en", "src2")] * 2
    return [(*r, len(r[1]) if r[1] is not None else None) for r in rows]


@pytest.fixture(scope="session")
def docs(spark, corpus):  # noqa: F811
    """The corpus with columns whose names the operators use inside."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, node string, size string, key string, component_id string, p string, kind string"
    return spark.createDataFrame([(*r, "n", "s", "k", "c", "p", "t") for r in corpus], schema)


@pytest.fixture(scope="session")
def no_docs(spark):  # noqa: F811
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
