"""Token counts without a shuffle of pre-tokens: a broadcast table of frequent words, then worker caches.

Two passes read the texts. The first finds frequent words: every task counts the words of its own documents and hands
on its heaviest ``TASK_WORDS``; only these summaries are added up, no document or word occurrence is shuffled. The
heaviest ``TABLE_WORDS`` of all, a fixed bound, are encoded once on the driver and broadcast as one packed string and an
array of lengths. In the second pass a word's length comes from this table, or else from the worker's cache, which
encodes unknown words in batches with the library. The table is a matter of speed only: results don't depend on it.
"""

from __future__ import annotations

import array
import functools
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import per_row
from .words import length_cache, split_words, tokenizer

TASK_WORDS, TABLE_WORDS, MAX_CHARS, LIMIT = 2048, 16384, 64, 2048
COUNTING = 1 << 18


def frequent_words(docs: DataFrame, n: int = TABLE_WORDS) -> list[str]:
    """The heaviest words of the corpus by per-task summaries; words of over ``MAX_CHARS`` code points excepted."""
    def run(batches):
        seen: Counter = Counter()
        for batch in batches:
            for text in batch.column(0):
                words = text.as_py()
                if words:
                    seen.update(split_words(words))
                if len(seen) > COUNTING:  # bounds the summary; counts of words let go start anew
                    seen = Counter(dict(seen.most_common(COUNTING // 4)))
        top = [x for x in seen.most_common(TASK_WORDS) if len(x[0]) <= MAX_CHARS]
        yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in top], pa.string()),
                                          pa.array([c for _, c in top], pa.int64())], names=["word", "n"])
    import pyarrow as pa
    found = docs.select("text").mapInArrow(run, "word string, n bigint")
    rows = found.groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(n).collect()
    return [r.word for r in rows]


def pack(words: list[str], path: str) -> tuple[bytes, bytes]:
    """Words in one string and their token counts as an array of 16-bit numbers."""
    lengths = [len(e) for e in tokenizer(path).encode_batch_fast(words, add_special_tokens=False)] if words else []
    return "\n".join(words).encode(), array.array("H", lengths).tobytes()


@functools.lru_cache(maxsize=2)
def _table(packed: bytes, lengths: bytes) -> dict[str, int]:
    counts = array.array("H")
    counts.frombytes(lengths)
    return dict(zip(packed.decode().split("\n"), counts))


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens and over_limit of each whole text.

    Null and empty texts have 0 bytes and tokens. Null and repeated ids keep their rows; an empty table gives none.
    Other columns are not read. Special strings inside texts count as the library's default has it.
    """
    table = docs.sparkSession.sparkContext.broadcast(pack(frequent_words(docs), path))

    def make():
        common, cache = _table(*table.value), length_cache(path)

        def fn(ids, texts):
            words = [split_words(t or "") for t in texts]
            rare: set[str] = set()
            for w in words:
                rare.update(w)
            rare.difference_update(common)
            cache.ensure(rare)
            length = common | {w: cache[w] for w in rare}
            n = [sum(map(length.__getitem__, w)) for w in words]
            return ids, [len((t or "").encode()) for t in texts], n
        return fn
    out = per_row(docs.select("doc_id", "text"), "doc_id bigint, n_bytes bigint, n_tokens bigint", make)
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
