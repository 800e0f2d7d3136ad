"""SentencePiece models on the tokenizers library: parse the model file, rebuild its parts, encode, decode, compare.

``parse`` reads the protobuf wire format: pieces with scores and kinds, model type, normaliser settings. ``rebuild``
makes the library's model (unigram with its scores, or BPE with merges ordered by the scores of what they make), byte
fallback, normaliser and metaspace marker. Where no piece has the marker after another character, and none holds a
line feed, a text's ids are those of its units (a run of markers and what follows, or a line feed) in order; then
units are encoded once per worker in batches on the library's threads and kept in a bounded cache. Each unit that
enters the cache is compared with the sentencepiece library, as is each whole text where units don't apply, so parity is
verified for all that is encoded. Its ids then go back through the library's decoder, and the texts of units are joined
just as their ids are. Models that break at no unit are encoded and decoded as whole texts.
"""

from __future__ import annotations

import array
import functools
import os
import re
import struct
import zlib
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from .common import per_row
from .words import WordCache

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
CHUNK, THREADS, MAX_ODD = 128, 2, 1 << 18


@dataclass
class Model:
    pieces: list[str] = field(default_factory=list)
    scores: list[float] = field(default_factory=list)
    kinds: list[int] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    unk: int = 0
    charsmap: bytes = b""
    dummy_prefix: bool = True
    squeeze: bool = True
    escape: bool = True


def _fields(data: bytes):
    """(number, value) of a message: whole numbers for varints, bytes for the rest."""
    at, end = 0, len(data)

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            byte = data[at]
            value |= (byte & 127) << shift
            at, shift = at + 1, shift + 7
            if byte < 128:
                return value, at
    while at < end:
        key, at = varint(at)
        wire = key & 7
        if wire == 0:
            value, at = varint(at)
        else:
            size, at = (8, at) if wire == 1 else (4, at) if wire == 5 else varint(at)
            value, at = data[at:at + size], at + size
        yield key >> 3, value


def parse(data: bytes) -> Model:
    """A model file; field numbers are those of the public sentencepiece_model.proto."""
    m = Model()
    for number, value in _fields(data):
        if number == 1:
            piece = dict(_fields(value))
            m.pieces.append(piece.get(1, b"").decode())
            m.scores.append(struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0)
            m.kinds.append(piece.get(3, NORMAL))
        elif number == 2:
            spec = dict(_fields(value))
            m.kind, m.byte_fallback, m.unk = spec.get(3, UNIGRAM), bool(spec.get(35, 0)), spec.get(40, 0)
        elif number == 3:
            spec = dict(_fields(value))
            m.charsmap, m.dummy_prefix = spec.get(2, b""), bool(spec.get(3, 1))
            m.squeeze, m.escape = bool(spec.get(4, 1)), bool(spec.get(5, 1))
    return m


def rebuild(m: Model, normalise: bool = True):
    """The library's tokenizer of a parsed model; without its normaliser for units that are normalised already."""
    from tokenizers import Regex, Tokenizer, decoders, models, normalizers
    if m.kind == UNIGRAM:
        model = models.Unigram(list(zip(m.pieces, m.scores)), unk_id=m.unk, byte_fallback=m.byte_fallback)
    elif m.kind == BPE:
        ids = {p: i for i, p in enumerate(m.pieces)}
        plain = {p for p, k in zip(m.pieces, m.kinds) if k in (NORMAL, USER)}
        merges = []
        for piece, score in zip(m.pieces, m.scores):
            if piece in plain and len(piece) > 1:
                cuts = [(piece[:i], piece[i:]) for i in range(1, len(piece))]
                merges += [(-score, ids[piece], ids[a], ids[b], a, b) for a, b in cuts if a in plain and b in plain]
        merges.sort()
        model = models.BPE(ids, [(a, b) for *_, a, b in merges], unk_token=m.pieces[m.unk], fuse_unk=True,
                           byte_fallback=m.byte_fallback)
    else:
        raise ValueError("word and character models have no counterpart in the library")
    t = Tokenizer(model)
    steps = [normalizers.Precompiled(m.charsmap)] if m.charsmap else []
    if m.squeeze:
        steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
    steps += [normalizers.Prepend(MARK if m.escape else " ")] * m.dummy_prefix
    steps += [normalizers.Replace(" ", MARK)] * m.escape
    if normalise and steps:
        t.normalizer = normalizers.Sequence(steps)
    t.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(),
                                   *[decoders.Strip(" ", 1, 0)] * m.dummy_prefix])
    return t


class Codec:
    """Encoder and decoder of one model file in one worker."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "true"
        os.environ.setdefault("RAYON_NUM_THREADS", str(THREADS))  # more threads than a task's cores only contend
        from sentencepiece import SentencePieceProcessor
        from tokenizers import decoders
        with open(path, "rb") as f:
            self.model = parse(f.read())
        m = self.model
        self.whole, self.unit = rebuild(m), rebuild(m, normalise=False)
        self.other = SentencePieceProcessor(model_file=path)
        usable = [p for p, k in zip(m.pieces, m.kinds) if k in (NORMAL, USER)]
        self.by_unit = (m.escape and m.dummy_prefix and not m.charsmap and not m.squeeze and USER not in m.kinds
                        and not any("\n" in p or MARK in p.lstrip(MARK) for p in usable)
                        and len(self.unit.encode("\n", add_special_tokens=False).ids) == 1)
        self.cut = re.compile(f"\n|{MARK}*[^{MARK}\n]+|{MARK}+").findall
        self.cache = WordCache(self._encode_units)
        # Units are decoded without the last step, which takes the dummy space off the start of a whole text.
        self.unit.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse()])
        self.changed: dict[str, str] = {}  # units that don't decode to what they are
        self.differing: set[str] = set()

    def _encode_units(self, units: list[str]) -> list[bytes]:
        """Ids of distinct units. Line feeds join units to longer texts for both libraries and part their ids again."""
        if len(self.changed) > MAX_ODD:  # those that the cache has forgotten
            self.changed = {u: t for u, t in self.changed.items() if u in self.cache or u in self.cache.older}
        proper = [u for u in units if u != "\n"]
        joined = ["\n".join(proper[i:i + CHUNK]) for i in range(0, len(proper), CHUNK)]
        feed = self.unit.encode("\n", add_special_tokens=False).ids
        ours = self.unit.encode_batch_fast(["\n" + j for j in joined], add_special_tokens=False)
        other = self.other.encode(["\n" + j.replace(MARK, " ") for j in joined], num_threads=1)
        known: list[list[int]] = []
        for a, b, at in zip(ours, other, range(0, len(proper), CHUNK)):
            ids = a.ids
            cuts = [i for i, x in enumerate(ids) if x == feed[0]] + [len(ids)]
            known += [ids[i + 1:j] for i, j in zip(cuts, cuts[1:])]
            if ids != b:  # find the units that differ
                theirs = [i for i, x in enumerate(b) if x == feed[0]] + [len(b)]
                parts = [b[i + 1:j] for i, j in zip(theirs, theirs[1:])]
                chunk = proper[at:at + CHUNK]
                same = len(parts) == len(chunk)
                self.differing.update(u for n, u in enumerate(chunk) if not same or parts[n] != known[at + n])
        said = self.unit.decode_batch(known, skip_special_tokens=False)
        self.changed.update((u, t) for u, t in zip(proper, said) if u.replace(MARK, " ") != t)
        packed = dict(zip(proper, map(self._packed, known))) | {"\n": self._packed(feed)}
        return [packed[u] for u in units]

    @staticmethod
    def _packed(ids: list[int]) -> bytes:
        return array.array("I", ids).tobytes()

    def encode(self, texts: list[str]) -> tuple[list[array.array], list[bool], list[str]]:
        """Ids of each text, whether both libraries agree on it, and the ids decoded again."""
        if not self.by_unit:
            ids = [e.ids for e in self.whole.encode_batch(texts, add_special_tokens=False)]
            agree = [a == b for a, b in zip(ids, self.other.encode(texts))]
            return [array.array("I", x) for x in ids], agree, self.whole.decode_batch(ids, skip_special_tokens=False)
        units = [self.cut(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        self.cache.ensure(u for us in units for u in us)  # a slice at a time: the libraries take batches
        out = [array.array("I", b"".join(map(self.cache.__getitem__, us))) for us in units]
        agree = [not self.differing or self.differing.isdisjoint(us) for us in units]
        return out, agree, [self._joined(us) for us in units]

    def _joined(self, units: list[str]) -> str:
        if self.changed and not self.changed.keys().isdisjoint(units):
            text = "".join([self.changed.get(u) or u.replace(MARK, " ") for u in units])
        else:
            text = "".join(units).replace(MARK, " ")
        return text[1:] if text.startswith(" ") else text

    def forget(self) -> None:
        """Lets go of all units, so that an idle worker holds the models only."""
        self.cache = WordCache(self._encode_units)
        self.changed, self.differing = {}, set()

    def decode(self, ids: list[array.array]) -> list[str]:
        """Any ids as texts."""
        return self.whole.decode_batch([x.tolist() for x in ids], skip_special_tokens=False)


@functools.cache
def codec(path: str) -> Codec:
    return Codec(path)


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids, n_tokens, parity (the sentencepiece library gives the same) and the ids decoded again as text.

    Null and empty texts have no ids and decode to the empty text. Null and repeated ids keep their rows; an empty
    table gives none. Other columns are not read. Texts hold what the normaliser leaves of them.
    """
    def make():
        c = codec(path)

        def fn(doc_ids, texts):
            ids, agree, decoded = c.encode([t or "" for t in texts])
            return doc_ids, [x.tolist() for x in ids], list(map(len, ids)), agree, decoded
        return fn
    return per_row(docs.select("doc_id", "text"), "doc_id bigint, ids array<int>, n_tokens bigint, parity boolean, "
                   "decoded string", make, rows=64, done=lambda: codec(path).forget())


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_crc32 (ids as little-endian 32-bit numbers), parity, round_trip (decoded equals text)."""
    def make():
        c = codec(path)

        def fn(doc_ids, texts):
            texts = [t or "" for t in texts]
            ids, agree, decoded = c.encode(texts)
            return (doc_ids, list(map(len, ids)), [zlib.crc32(x.tobytes()) for x in ids], agree,
                    [a == b for a, b in zip(decoded, texts)])
        return fn
    return per_row(docs.select("doc_id", "text"), "doc_id bigint, n_tokens bigint, ids_crc32 bigint, parity boolean, "
                   "round_trip boolean", make)
