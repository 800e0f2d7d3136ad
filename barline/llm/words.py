"""Token ids by white-space word: library encodings of distinct words, kept per worker process.

The word-level tokenizer drops white space and never merges across it, so the ids of a text are those of its words in
order. ``WordCache`` asks the library once for each word it doesn't hold, in batches, and forgets everything when it
grows past its limits, so its memory doesn't depend on the data beyond one slice of texts.
"""

from __future__ import annotations

import array
import functools
import sys
from collections.abc import Callable, Iterable

#: Python's split() also cuts at these, the library's white space doesn't hold them.
NOT_SPACE = "\x1c\x1d\x1e\x1f"
MAX_WORDS, MAX_CHARS = 400_000, 1 << 23
#: Bytes that the byte-level alphabet writes as themselves (fixed values).
BYTES = [*range(33, 127), *range(161, 173), *range(174, 256)]


def split_words(text: str) -> list[str]:
    """Runs free of white space as the library sees it; a run may keep some white space, which changes no ids."""
    if any(c in text for c in NOT_SPACE):
        return [w for w in text.replace("\n", " ").split(" ") if w]
    return text.split()


@functools.cache
def tokenizer(path: str):
    """The library's tokenizer of a JSON file, once per process, without truncation or padding."""
    import os
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core; short words gain nothing from threads
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


class WordEncoder:
    """Words to their ids as little-endian bytes (``H``: 16 bits, ``I``: 32), as the library encodes each word alone.

    For tokenizers with the plain chain (composition, white space, lower case, one split pattern, byte level) words of
    Latin letters, digits and signs are cut by the file's own pattern, and only pieces not seen before go to the
    library's model. All other words, and all words of other tokenizers, are encoded by the library as a whole.
    """

    def __init__(self, path: str, typecode: str = "I", max_pieces: int = MAX_WORDS):
        import json
        import regex
        self.typecode = typecode
        self.library, self.model, self.max_pieces = tokenizer(path), tokenizer(path).model, max_pieces
        with open(path, encoding="utf-8") as f:
            j = json.load(f)
        steps = [n["type"] for n in (j["normalizer"] or {}).get("normalizers", [])]
        cuts = (j["pre_tokenizer"] or {}).get("pretokenizers", [])
        self.plain = (steps == ["NFC", "Replace", "Lowercase"] and [c["type"] for c in cuts] == ["Split", "ByteLevel"]
                      and cuts[0]["behavior"] == "Removed" and cuts[0]["invert"] and not cuts[1]["add_prefix_space"]
                      and not cuts[1]["use_regex"])
        if self.plain:
            self.cut = regex.compile(cuts[0]["pattern"]["Regex"]).findall
            marks = "".join({t["content"][0] for t in j["added_tokens"]})
            # Words of letters are cut without a look at added tokens, so none may start with a letter or digit.
            self.plain = not any(c.isalnum() or c in ".," for c in marks)
            self.simple = regex.compile(f"[!-~\u00a1-\u012f\u0131-\u017e--[{regex.escape(marks)}]]+", regex.V1).fullmatch
            byte_level = dict(zip(BYTES, map(chr, BYTES)))
            byte_level |= {b: chr(256 + i) for i, b in enumerate(sorted(set(range(256)) - set(BYTES)))}
            self.level = {c: "".join(byte_level[b] for b in chr(c).encode()) for c in range(0x300)}
        self.pieces: dict[str, bytes] = {}

    def packed(self, ids: list[int]) -> bytes:
        a = array.array(self.typecode, ids)
        if sys.byteorder == "big":
            a.byteswap()
        return a.tobytes()

    def piece(self, text: str) -> bytes:
        if len(self.pieces) >= self.max_pieces:
            self.pieces.clear()
        got = self.pieces[text] = self.packed([t.id for t in self.model.tokenize(text.translate(self.level))])
        return got

    def pieces_of(self, w: str) -> list[str] | None:
        """The pieces of a simple word, None for others. Most words are letters, or letters and one sign."""
        w = w.lower()
        if w.isascii() or self.simple(w):
            if w.isalpha():
                return [w]
            if w[:-1].isalpha() and w[-1] in ".,":
                return [w[:-1], w[-1]]
            if self.simple(w):
                return self.cut(w)
        return None

    def __call__(self, words: list[str]) -> list[bytes]:
        out: list[bytes | None] = [None] * len(words)
        if self.plain:
            piece, known = self.piece, self.pieces
            for i, w in enumerate(words):
                cut = self.pieces_of(w)
                if cut is None:
                    continue
                if len(cut) == 1:
                    out[i] = known.get(cut[0]) or piece(cut[0])
                else:
                    out[i] = b"".join([known.get(p) or piece(p) for p in cut])
        rest = [i for i, ids in enumerate(out) if ids is None]
        if rest:
            for i, e in zip(rest, self.library.encode_batch_fast([words[i] for i in rest], add_special_tokens=False)):
                out[i] = self.packed(e.ids)
        return out


class WordCache(dict):
    """Word to ``value(ids)``; ``ensure`` encodes what is missing. Two generations: on overflow the older half goes."""

    def __init__(self, encode: Callable[[list[str]], list], max_words: int = MAX_WORDS, max_chars: int = MAX_CHARS):
        super().__init__()
        self.encode, self.max_words, self.max_chars, self.chars = encode, max_words, max_chars, 0
        self.older: dict = {}

    def take(self, words: list) -> list:
        """The values of words, encoding what is missing; known words cost one lookup."""
        try:
            return list(map(self.__getitem__, words))
        except KeyError:
            self.ensure(words)
            return list(map(self.__getitem__, words))

    def ensure(self, words: Iterable[str]) -> None:
        words = set(words)
        missing = [w for w in words if w not in self]  # set operations would walk the whole cache
        if not missing:
            return
        if len(self) + len(missing) > self.max_words or self.chars > self.max_chars:
            self.older = dict(self)
            self.clear()
            self.chars, missing = 0, list(words)
        older = self.older
        unknown = [w for w in missing if w not in older]
        self.update((w, older[w]) for w in missing if w in older)
        self.update(zip(unknown, self.encode(unknown)))
        self.chars += sum(map(len, missing))


@functools.cache
def length_cache(path: str) -> WordCache:
    """Words to their number of tokens."""
    encode = WordEncoder(path)
    return WordCache(lambda ws: [len(b) >> 2 for b in encode(ws)])


@functools.cache
def id_cache(path: str, typecode: str) -> WordCache:
    """Words to their packed ids."""
    return WordCache(WordEncoder(path, typecode))
