"""Very long texts of a learned language stay in the corpus."""

import numpy as np

from barline.llm import langid

STARTS = "b br c d f fl g gr h k l m n p pl r s st t tr v w".split()
VOWELS, ENDS = "a e i o u ea ou".split(), ["", "n", "r", "s", "t", "l", "nd", "m", "ck", "st"]
COMMON, FRESH, R = 3000, 0.15, np.random.default_rng(1)
KNOWN = ["".join(R.choice(p) for p in (STARTS, VOWELS, ENDS) * int(R.integers(1, 3))) for _ in range(COMMON)]


def natural(rng, chars):
    """Words of a Zipf-like law, and a share of new ones built of any letters, so rare n-grams go on turning up."""
    n = chars // 6
    ranks = np.minimum(rng.zipf(1.3, n) - 1, COMMON - 1)
    letters = rng.integers(97, 123, (n, 7)).astype(np.uint8)
    fresh = rng.random(n) < FRESH
    return " ".join(bytes(letters[i]).decode() if fresh[i] else KNOWN[ranks[i]] for i in range(n))


def test_a_book_is_kept_and_an_unknown_language_is_not(spark):
    rng = np.random.default_rng(3)
    rows = [(i, natural(rng, 2000), "en") for i in range(200)]
    book = natural(rng, 3_000_000)
    other = "".join(map(chr, rng.choice([32, *range(0x3b1, 0x3ca)], 1_000_000)))
    df = spark.createDataFrame(rows + [(900, book, None), (901, other, None)], "doc_id bigint, text string, lang string")
    model = langid.train(df)
    short = np.mean([model.predict(t)[1] for _, t, _ in rows])
    assert model.predict(book)[1] < langid.MIN_SCORE  # the share of distinct n-grams depends on length
    assert abs(model.predict_windows(book)[1] - short) < 0.1
    assert model.predict_windows(other)[1] < langid.MIN_SCORE
    for _, t, _ in rows[:20]:
        assert len(t) > langid.WINDOW or model.predict_windows(t) == model.predict(t)
    assert {r.doc_id for r in langid.keep_known(df).collect()} == {*range(200), 900}
