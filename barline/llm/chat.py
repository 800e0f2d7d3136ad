"""Conversations as training text in budgeted windows.

A turn is written as ``<|im_start|>role``, a line feed, the text, ``<|im_end|>`` and a line feed. Inside texts and roles
every ``<``, any backslashes, ``|`` gets one more backslash, so no control string can occur there and the reverse is
exact. Tokens are counted turn by turn with a tokenizer that splits between a line feed and ``<``, so the tokens of a
window are the sum over its turns.

Prefix sums of the turns' tokens (``ordered.keyed_scan``) place every turn on its conversation's token axis, which is cut
into segments of ``SEGMENT`` budgets. A segment's turns meet in one group with the conversation's system turn and the
few turns before the segment; there, windows take whole turns as long as they fit. So a conversation of any length
spreads over many groups of bounded size. Every window after the first repeats the system turn and as many turns of
history as fit its share; what is repeated is masked, so each assistant text is a target exactly once.
"""

from __future__ import annotations

import hashlib
import itertools
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import per_row, written
from .ordered import keyed_scan
from .words import tokenizer

START, END = "<|im_start|>", "<|im_end|>"
BUDGET, HISTORY, SEGMENT = 1024, 256, 64
#: Conversations whose segments of one number meet in a group.
TOGETHER = 32
WINDOWS = ("conv_id bigint, key_no bigint, segment bigint, window int, text string, loss array<struct<start:int,end:int>>, "
           "repeated int, n_tokens bigint")
DIGESTS = ("conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, "
           "formatted_chars bigint, n_windows bigint")
_MARK, _MARKED = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")


def escaped(text: str) -> str:
    return _MARK.sub(r"<\\\1|", text)


def unescaped(text: str) -> str:
    return _MARKED.sub(r"<\1|", text)


def escaped_role(role: str) -> str:
    """A role on one line: backslashes and line feeds are written as two characters before control strings are escaped."""
    return escaped(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescaped_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescaped(role))


def block(role: str, text: str) -> str:
    """A turn of the template, from escaped parts."""
    return f"{START}{role}\n{text}{END}\n"


def turns_of(text: str) -> list[tuple[str, str]]:
    """Roles and texts of a formatted text, as they were."""
    out = []
    for part in text.split(START)[1:]:
        role, body = part.removesuffix(f"{END}\n").split("\n", 1)
        out.append((unescaped_role(role), unescaped(body)))
    return out


def counted(turns: DataFrame, model: str) -> DataFrame:
    """(conv_id, role, text) to (conv_id, role, body, n_tokens): escaped role and text, and the tokens of the block."""
    def make():
        t = tokenizer(model)
        t.encode_special_tokens = True

        def fn(conv, roles, texts):
            roles, bodies = [escaped_role(r or "") for r in roles], [escaped(x or "") for x in texts]
            made = t.encode_batch_fast([block(r, b) for r, b in zip(roles, bodies)], add_special_tokens=False)
            return conv, roles, bodies, [len(e.ids) for e in made]
        return fn
    return per_row(turns.select("conv_id", "role", "text"), "conv_id bigint, role string, body string, n_tokens bigint", make)


def spans(sizes: list[int], system: int | None, before: list[int], first: bool, skip: int, budget: int, history: int):
    """Turn-aligned windows: (with system turn, number of turns of history, from, to) over turns of the given sizes.

    ``system`` is the size of the system turn to repeat, ``before`` the sizes of the turns before the first one. ``first``:
    the first window starts the conversation and repeats nothing. The first ``skip`` turns aren't taken as history. A
    turn that doesn't fit has a window to itself, with the system turn.
    """
    at = 0
    while at < len(sizes):
        opening = first and at == 0
        lead = 0 if opening or system is None else system
        room = budget - lead
        share, n = min(history, room - sizes[at]), 0
        earlier = before + sizes[skip:at]
        while not opening and n < len(earlier) and earlier[-1 - n] <= share:
            share -= earlier[-1 - n]
            room -= earlier[-1 - n]
            n += 1
        to = at + 1
        room -= sizes[at]
        while to < len(sizes) and sizes[to] <= room:
            room -= sizes[to]
            to += 1
        yield not opening and system is not None, n, at, to
        at = to


def windows(turns: DataFrame, model: str, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """Conversations as windows of at most ``budget`` tokens: the columns of ``WINDOWS``, written to the shared folder.

    ``text`` is the formatted window, ``loss`` the targets as code point spans of it (whole assistant texts, escaped),
    ``repeated`` how many turns at its start were shown before. (key_no, segment, window) orders a conversation's
    windows. A conversation's system turn is its first one if its role is ``system``; one of more than half the budget
    isn't repeated. Turns larger than the budget keep a window to themselves and exceed it: nothing is cut.

    Null texts and roles are empty; null turns come first, equal turns are ordered by role and a hash of the text; rows
    with a null conv_id form one conversation. Repeated rows are turns of their own. An empty table gives no rows. Other
    columns are not read.
    """
    size = budget * SEGMENT
    raw = turns.select(F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"), "role", "text",
                       F.xxhash64("text").alias("hash"))
    rows = keyed_scan(raw, ["conv_id"], ["turn", "role", "hash"], ["n_tokens"], "turns", lambda df: counted(df, model))
    start, end = F.col("before_n_tokens"), F.col("before_n_tokens") + F.col("n_tokens")
    segment = F.floor(start / size).cast("bigint")
    own = rows.withColumn("segment", segment).withColumn("kind", F.lit("own"))
    # What may be the history of the next segment's first window. A larger turn never is history.
    halo = (own.where((F.col("n_tokens") <= history) & (end >= (F.col("segment") + 1) * size - history))
            .withColumn("segment", F.col("segment") + 1).withColumn("kind", F.lit("before")))
    # A system turn meets every segment of its conversation; most have but one.
    lead = own.where((F.col("pos") == 0) & (F.col("role") == "system") & (F.col("n_tokens") <= budget // 2))
    last = own.groupBy("key_no").agg(F.max("segment").alias("last"))
    lead = (lead.join(last, "key_no").withColumn("segment", F.explode(F.sequence(F.lit(0).cast("bigint"), "last")))
            .drop("last").withColumn("kind", F.lit("system")))
    types = pa.schema([("conv_id", pa.int64()), ("key_no", pa.int64()), ("segment", pa.int64()), ("window", pa.int32()),
                       ("text", pa.string()), ("loss", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
                       ("repeated", pa.int32()), ("n_tokens", pa.int64())])

    def windows_of(rows: list[dict]) -> list[tuple]:
        """The windows of one segment, from its turns, those before it and the system turn."""
        found: dict[str, list[dict]] = {"own": [], "before": [], "system": []}
        for r in rows:
            found[r["kind"]].append(r)
        fresh, lead = found["own"], found["system"]
        before, want = [], fresh[0]["pos"] - 1 if fresh else None
        for r in reversed(found["before"]):  # those that directly come before, but for the system turn
            if r["pos"] != want or lead and want == 0:
                break
            before, want = [r, *before], want - 1
        opening = bool(fresh) and fresh[0]["pos"] == 0
        skip = 1 if opening and lead else 0  # the system turn isn't history as well
        out = []
        sizes = [r["n_tokens"] for r in fresh]
        for with_lead, n, at, to in spans(sizes, lead[0]["n_tokens"] if lead else None, [r["n_tokens"] for r in before],
                                          opening, skip, budget, history):
            earlier = before + fresh[skip:at]
            shown = lead[:with_lead] + (earlier[-n:] if n else [])
            texts, loss, chars = [], [], 0
            for i, r in enumerate(shown + fresh[at:to]):
                b = block(r["role"], r["body"])
                if i >= len(shown) and r["role"] == "assistant":
                    first = chars + len(START) + len(r["role"]) + 1
                    loss.append({"start": first, "end": first + len(r["body"])})
                texts.append(b)
                chars += len(b)
            out.append((fresh[0]["conv_id"], fresh[0]["key_no"], fresh[0]["segment"], len(out), "".join(texts), loss,
                        len(shown), sum(r["n_tokens"] for r in shown + fresh[at:to])))
        return out

    def pack(t: pa.Table) -> pa.Table:
        rows = sorted(t.to_pylist(), key=lambda r: (r["key_no"], r["pos"]))
        out = [w for _, part in itertools.groupby(rows, key=lambda r: r["key_no"]) for w in windows_of(list(part))]
        return pa.Table.from_arrays([pa.array(c, ty) for c, ty in zip(zip(*out) if out else [[]] * len(types), types.types)],
                                    names=types.names)
    keep = ["conv_id", "key_no", "segment", "kind", "pos", "role", "body", "n_tokens"]
    groups = own.select(keep).unionByName(halo.select(keep)).unionByName(lead.select(keep))
    # Neighbouring conversations share a group: most have one segment of a few turns.
    groups = groups.groupBy(F.expr(f"key_no div {TOGETHER}"), "segment")
    return written(groups.applyInArrow(pack, WINDOWS), "windows")


def digests(formatted: DataFrame) -> DataFrame:
    """Per conversation, read back from its windows: the columns of ``DIGESTS``.

    A conversation's windows pass one task in order, one at a time: the digest of a whole conversation can't be formed
    from parts, but no more than a window of it is held.
    """
    def run(batches):
        last, state, out = object(), None, []

        def close():
            conv, n, turns, chars, loss, all_chars, wins = state
            return (conv, n, turns.hexdigest(), chars, loss.hexdigest(), all_chars, wins)

        def batch_of(rows):
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=[
                "conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_windows"])
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                for r in batch.slice(at, 64).to_pylist():
                    if r["key_no"] != last:
                        if state:
                            out.append(close())
                        last, state = r["key_no"], [r["conv_id"], 0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
                    for role, text in turns_of(r["text"])[r["repeated"]:]:
                        state[1] += 1
                        state[2].update(f"{role}\n{text}\n".encode())
                    for s in r["loss"]:
                        target = unescaped(r["text"][s["start"]:s["end"]])
                        state[3] += len(target)
                        state[4].update(target.encode())
                    state[5] += len(r["text"])
                    state[6] += 1
            if out:
                yield batch_of(out)
                out = []
        if state:
            yield batch_of([close()])
    return (formatted.repartition("key_no").sortWithinPartitions("key_no", "segment", "window")
            .mapInArrow(run, DIGESTS))


def formatted(turns: DataFrame, model: str, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """Windows of all conversations, written, read back and digested; see ``windows`` for odd rows."""
    return digests(windows(turns, model, budget, history))
