import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

#: Column names that the operators use inside.
CLASHES = (
    "doc", "body", "line", "size", "key", "h1", "h2", "n", "bits", "tile", "class", "label", "a", "b",
    "component", "shard", "slot", "score", "quality", "n_words", "n_lines", "taken", "target", "rank",
    "stretch", "host", "path", "rule", "token_ids", "kept", "start", "epochs", "part", "count",
)


def lines_of(words, n, seed):
    dealt = random.Random(seed)
    return " ".join(dealt.choice(words) for _ in range(n))


@pytest.fixture(scope="session")
def odd_texts():
    """Texts at the edges: none, empty, blank, short, long, copies, near copies, odd characters."""
    words = [f"w{i}" for i in range(400)]
    long = lines_of(words, 60_000, 1)
    base = lines_of(words, 240, 2)
    passage = lines_of(words, 70, 3)
    near = base.split()
    near[5], near[100] = "other", "words"
    return [
        None, "", " \t\n", "one", "One", "two words", "two  words\n", base, base, base.upper(),
        " ".join(near), passage + " x", "y " + passage, "z z " + passage + " " + base, long, long + " end",
        "a b c d e " * 30, "same line of twenty characters\nno\nsame line of twenty characters",
        "Same Line of twenty characters \n\nx", "  same line of twenty characters", "same line of twenty characters",
        "é ß 漢字 😀 " * 20, "\u00a0\u2003x\u0085y", "tab\tand\vvt\ffeed\rcr",
    ]


@pytest.fixture(scope="session")
def odd_docs(spark, odd_texts):
    """The odd texts as a table with clashing columns; ids from the last text on, two without an id,
    and one row twice."""
    n = len(odd_texts)
    sources = ["s1", "s2", None, "S", "é"]
    rows = [(n - i, t, "en", sources[i % 5], len(t or "")) for i, t in enumerate(odd_texts)]
    rows += [(None, "no id but a text with some words in it", "en", "s1", 38), (None, None, None, None, None)]
    rows.append(rows[7])
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    from pyspark.sql import functions as F

    return docs.withColumns({c: F.lit(1) for c in CLASHES}).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark, odd_docs):
    return odd_docs.limit(0)


@pytest.fixture(scope="session")
def sf_small(spark):
    return lambda name, sf="sf0.001": spark.read.parquet(f"/root/testdata/{sf}/{name}.parquet")
