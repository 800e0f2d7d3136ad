"""Language ID by language-bitmask n-gram filters.

Training counts, per language, in how many documents each letter n-gram occurs, on at most ``TRAIN_DOCS`` labelled
documents of each language chosen by a hash of the id (a documented bound; every language is cut the same way). The
n-grams found in at least ``MIN_SHARE`` of them go to the filter. It is a bit-sliced Bloom filter: a slot is a bitmask
with one bit per language, and an n-gram sets its language's bit in ``HASHES`` slots. The filter is built by a grouped
bit_or over slots, so what the driver collects and broadcasts is bounded by ``SLOTS`` whatever the corpus.

A document's distinct n-grams are looked up at once: the bitwise AND of an n-gram's slots names all languages that hold
it. Per language the set bits are counted and corrected for false positives: with a share f of the slots set, an n-gram
not in the language still shows up with probability f ** HASHES. The largest corrected count decides; the score is its
share of the text's distinct n-grams.

That share falls with the length of a text, because rare n-grams go on turning up. So documents are rejected by another
measure: counts are added up over windows of at most ``WINDOW`` characters that cover the whole text, and the score is
the share of the windows' distinct n-grams. It is the plain score for texts of one window, and doesn't depend on length
beyond.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import per_row, wrapped, written

SIZES, SLOTS, HASHES = (2, 3, 4), 1 << 19, 3
TRAIN_DOCS, MIN_SHARE, FLUSH = 5000, 0.02, 1 << 20
#: Below this share of known n-grams a text is in no learned language.
MIN_SCORE = 0.25
WINDOW = 1 << 12
UNKNOWN = "und"


@functools.cache
def _letters() -> np.ndarray:
    """Code point to lower-case letter, a space for all that isn't one."""
    out = np.full(0x110000, 32, dtype=np.uint32)
    for c in range(0x110000):
        if chr(c).isalpha():
            low = chr(c).lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def grams(text: str) -> np.ndarray:
    """Hashes of a text's distinct n-grams of letters within words, word ends included; empty without letters."""
    a = _letters()[np.frombuffer(text.encode("utf-32-le"), dtype="<u4")]
    a = np.concatenate([[32], a, [32]]).astype(np.uint64)
    gap = a == 32
    a = a[~(gap & np.concatenate([[False], gap[:-1]]))]
    if len(a) < 3:
        return np.zeros(0, dtype=np.uint64)
    inner = a != 32
    found = []
    with np.errstate(over="ignore"):
        for n in SIZES:
            if len(a) < n:
                continue
            size = len(a) - n + 1
            h, ok = np.full(size, n, dtype=np.uint64), np.ones(size, dtype=bool)
            for i in range(n):
                h = h * np.uint64(0x100000001B3) + a[i:i + size]
                if 0 < i < n - 1:
                    ok &= inner[i:i + size]
            found.append(h[ok])
        h = np.concatenate(found)
        h = (h ^ h >> np.uint64(33)) * np.uint64(0xFF51AFD7ED558CCD)
        h = (h ^ h >> np.uint64(33)) * np.uint64(0xC4CEB9FE1A85EC53)
        h ^= h >> np.uint64(33)
    h.sort()
    return h[np.concatenate([[True], h[1:] != h[:-1]])]


@dataclass
class Filter:
    langs: list[str]
    masks: np.ndarray  # (SLOTS, words) uint64, bit i of a row: langs[i]

    def __post_init__(self):
        bits = np.unpackbits(self.masks.view(np.uint8), axis=1, bitorder="little")[:, :len(self.langs)]
        self.false = bits.mean(axis=0) ** HASHES if self.langs else np.zeros(0)

    def counts(self, text: str) -> tuple[np.ndarray, int]:
        """Corrected count of each language among the text's distinct n-grams, and their number."""
        h = grams(text)
        if not len(h):
            return np.zeros(len(self.langs)), 0
        hit = self.masks[slot(h, 0)]
        for i in range(1, HASHES):
            hit &= self.masks[slot(h, i)]
        count = np.unpackbits(hit.view(np.uint8), axis=1, bitorder="little").sum(axis=0)[:len(self.langs)]
        return (count - len(h) * self.false) / np.maximum(1 - self.false, 1e-9), len(h)

    def _best(self, true: np.ndarray, n: int) -> tuple[str, float]:
        if not n:
            return UNKNOWN, 0.0
        best = int(np.argmax(true))
        return self.langs[best], float(np.clip(true[best] / n, 0, 1))

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.langs or not text:
            return UNKNOWN, 0.0
        return self._best(*self.counts(text))

    def predict_windows(self, text: str | None) -> tuple[str, float]:
        """Language and score by counts added up over windows of nearly equal size that cover the text."""
        if not self.langs or not text:
            return UNKNOWN, 0.0
        size = -(-len(text) // -(-len(text) // WINDOW))
        parts = [self.counts(text[at:at + size]) for at in range(0, len(text), size)]
        return self._best(sum(true for true, _ in parts), sum(n for _, n in parts))


def slot(h: np.ndarray, i: int) -> np.ndarray:
    return (h >> np.uint64(20 * i) & np.uint64(SLOTS - 1)).astype(np.int64)


def held_out() -> F.Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 4 == 2


def train(docs: DataFrame, train_docs: int = TRAIN_DOCS, min_share: float = MIN_SHARE) -> Filter:
    """A filter from the text and non-null lang of the documents that aren't held out."""
    labelled = docs.select("doc_id", "text", "lang").where(
        F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out())
    sizes = {r.lang: r["count"] for r in labelled.groupBy("lang").count().collect()}  # one row per language
    langs = sorted(sizes)
    words = max(1, -(-len(langs) // 64))
    masks = np.zeros((SLOTS, words), dtype=np.uint64)
    if not langs:
        return Filter(langs, masks)
    place = F.pmod(F.xxhash64(F.lit(1), "doc_id", F.xxhash64("text")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    share = F.create_map(*[F.lit(x) for k in langs for x in (k, train_docs / sizes[k])])
    sample = labelled.where(place < F.element_at(share, F.col("lang"))).select("lang", "text")

    def count(batches):
        seen: dict[str, list] = {}
        held = 0

        def out():
            for lang, parts in seen.items():
                h, n = np.unique(np.concatenate(parts), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(h)), pa.array(h.view(np.int64)),
                                                  pa.array(n)], names=["lang", "h", "n"])
        for batch in batches:
            for lang, text in zip(*[c.to_pylist() for c in batch.columns]):
                g = grams(text)
                if len(g):
                    seen.setdefault(lang, []).append(g)
                    held += len(g)
                if held > FLUSH:
                    yield from out()
                    seen, held = {}, 0
        yield from out()

    used = written(sample, "langid-sample")
    docs_of = {r.lang: r["count"] for r in used.groupBy("lang").count().collect()}
    least = F.create_map(*[F.lit(x) for k in langs for x in (k, max(1.0, min_share * docs_of.get(k, 0)))])
    index = F.create_map(*[F.lit(x) for i, k in enumerate(langs) for x in (k, i)])
    kept = (used.mapInArrow(count, "lang string, h bigint, n bigint").groupBy("lang", "h").agg(F.sum("n").alias("n"))
            .where(F.col("n") >= F.element_at(least, F.col("lang"))))
    at = F.explode(F.array(*[F.shiftrightunsigned("h", 20 * i).bitwiseAND(F.lit(SLOTS - 1)) for i in range(HASHES)]))
    i = F.element_at(index, F.col("lang"))
    slots = (kept.select(at.alias("slot"), F.floor(i / 64).cast("int").alias("word"), (i % 64).alias("i"))
             .select("slot", "word", F.expr("shiftleft(1L, i)").alias("bit"))
             .groupBy("slot", "word").agg(F.bit_or("bit").alias("bits"))).toArrow()
    masks[slots["slot"].to_numpy(), slots["word"].to_numpy()] = slots["bits"].to_numpy().view(np.uint64)
    return Filter(langs, masks)


def predicted(df: DataFrame, model: Filter, keep: int, windows: bool = False, field: str | None = None) -> DataFrame:
    """The first ``keep`` columns, then ``lang_pred`` and ``score`` of the last column (a text), by windows or whole.

    With ``field`` the text is that field of the first column and no column of its own.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)

    def make():
        model = shared.value
        predict = model.predict_windows if windows else model.predict
        return lambda texts: tuple(map(list, zip(*map(predict, texts)))) if texts else ([], [])
    return per_row(df, "lang_pred string, score double", make, keep=keep, field=field)


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score of each document, by a filter trained on the documents not held out.

    Null texts and texts without a letter are ``und`` with score 0, as is everything if no document is labelled. Ties go
    to the first language by code point. A null id counts as the empty text for the split. Repeated rows stay; an empty
    table gives no rows; other columns are not read.
    """
    return predicted(docs.select("doc_id", held_out().alias("held_out"), "text"), train(docs), keep=2)


def keep_known(docs: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """The documents in a learned language, whatever their length, with their columns.

    Null texts, texts without a letter and, where no document is labelled, all go. Scores at the limit stay, ties between
    languages keep the document, repeated rows and null ids are judged row by row, and no column's name matters beyond
    doc_id, text and lang. An empty table gives no rows.
    """
    rows = predicted(wrapped(docs), train(docs), keep=1, windows=True, field="text")
    return rows.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= min_score)).select("row.*")
