import random
from collections import namedtuple

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
Doc = namedtuple("Doc", "doc_id text lang source n_chars")


def table(spark, rows, **more):
    """documents from (doc_id, text[, source]), with extra columns whose names clash with the operators' own."""
    rows = [Doc(r[0], r[1], "en", r[2] if len(r) > 2 else "a", len(r[1]) if r[1] is not None else None) for r in rows]
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, SCHEMA)
    return df.withColumns({name: F.lit(1) for name in ("id", "key", "n", "size", "row", "bucket", "s", "th", "sid", "kept", "block", "doc", "cls")})


def prose(rng, n, vocabulary=400):
    return " ".join("w%d" % int(vocabulary * rng.random() ** 2) for _ in range(n))


@pytest.fixture()
def rng():
    return random.Random(5)


@pytest.fixture()
def corpus(rng):
    """Texts with copies, near copies, shared passages, oddities and nulls."""
    passage = prose(rng, 40)
    texts = [prose(rng, rng.randint(1, 160)) for _ in range(60)]
    for i in range(8):
        words = texts[i].split()
        if len(words) > 30:
            words[rng.randrange(len(words))] = "changed"
            texts.append(" ".join(words))
    texts += [texts[3], texts[3], texts[3] + "  ", "\n".join([texts[5], passage, texts[6]]), passage + " end", "start " + passage]
    texts += [None, "", "   ", "one", "One two", "one two", "a" * 5000, "ab" * 3000, "né à l'été " * 30, "日本語のテキスト " * 40, "\x0b\f\t"]
    return [(i, t, ["a", "b", None, "c"][i % 4] if i % 3 else "hot") for i, t in enumerate(texts)]
