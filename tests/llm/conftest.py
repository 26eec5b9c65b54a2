import random

import pytest

WORDS = "the of and river stone light paper green market window letter garden silver morning yellow travel bridge winter summer orange table music forest simple number garden double engine finger button island".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "", "s", "ed", "ing"]) for _ in range(n))


@pytest.fixture(scope="session")
def rows():
    """Documents with nulls in every column, empty and long texts, copies, near copies and repeated rows."""
    rng = random.Random(3)
    base = [prose(rng, rng.randint(8, 160)) for _ in range(60)]
    texts = base + base[:6]
    for t in base[6:14]:  # near copies
        w = t.split()
        w[len(w) // 2] = "changed"
        texts.append(" ".join(w))
    shared = prose(rng, 60)
    texts += [prose(rng, 40) + " " + shared + " " + prose(rng, 30) for _ in range(4)]
    texts += [None, "", " \n\t", "one", "ONE", "two words", "é ü ñ", "\x00\x00", "a" * 400, "ab" * 300, prose(rng, 9000), "!!! ... 123"]
    out = [(i, t, rng.choice(["en", "de", None]), rng.choice(["s1", "s2", "s3", None]), None if t is None else len(t)) for i, t in enumerate(texts)]
    out += [out[3], out[3], (out[5][0], "another text under an id that is there", "en", "s1", 38), (None, base[1], None, None, None)]
    return out


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark, rows):
    """Repartitioned, and with columns whose names the operators use for their own."""
    return spark.createDataFrame(rows, SCHEMA).repartition(5).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def clashing(spark, rows):
    from pyspark.sql import functions as F

    names = "key id size score spans media kept marks node root copies n_words labels lang_pred known n_entities pii bucket count n log_weight".split()
    return spark.createDataFrame(rows, SCHEMA).select("*", *(F.lit("x").alias(n) for n in names))
