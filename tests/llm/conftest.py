import random

import pytest

SCHEMA = ("doc_id bigint, text string, lang string, source string, n_chars bigint, row string, h string, host string, "
          "block string, lap string, size string, score string, n_words string, fp string, shard string")
EN = "the and that with from this have they which their would there about people water after first never".split()
DE = "der und die nicht sich auch eine werden haben durch über können größer zwischen straße während schön".split()


def words(rng, pool, n):
    return " ".join(rng.choice(pool) + rng.choice(["", "", "s", "er", "ing" if pool is EN else "ung"]) for _ in range(n))


@pytest.fixture(scope="session")
def rows():
    """Documents with nulls in every column, empty and long texts, exact and near copies, and repeated rows."""
    rng = random.Random(5)
    out = []
    for i in range(60):
        pool, lang = (EN, "en") if i % 3 else (DE, "de")
        out.append((i, words(rng, pool, rng.randint(60, 200)), lang, f"s{i % 4}"))
    base = words(rng, EN, 400)
    out += [(100 + i, base, "en", "s0") for i in range(5)]
    out += [(110 + i, base + " tail" * (i % 2) + " x%d" % i, "en", "s1") for i in range(5)]
    out += [(120, None, "en", "s1"), (121, "", None, None), (122, " \n\t \x0b", "de", None), (123, "12 34 !!", "en", "s2"),
            (124, words(rng, DE, 30000), "de", "s3"), (125, "a" * 5000, None, "s2"), (126, "one\ntwo\none\n\ntwo", "en", ""),
            (127, "de,&&& ja%%% " * 40, "de", "s2"), (None, words(rng, EN, 80), "en", "s0"), (None, None, None, None)]
    out += [out[3], out[3], out[100 - 40]]
    return [(d, t, lang, s, len(t or "")) for d, t, lang, s in out]


@pytest.fixture(scope="session")
def docs(spark, rows):
    """The rows with extra columns whose names the operators use inside."""
    return spark.createDataFrame([r + ("x",) * 10 for r in rows], SCHEMA).repartition(3).persist()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
