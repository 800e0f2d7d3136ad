"""Hidden-state chains as matrix products over blocks of rows.

A row is one step of its chain: the matrix G_t = A diag(e_t) of K x K numbers. Products of steps are associative, so a
block of rows condenses into one product, a chain is the product of its blocks, and a long chain keeps several tasks busy:

* Inside a block all prefix and suffix products come from a doubling scan, without a step per row.
* A chain passes one row per block through one task, which gives each block the vector that enters it (and, for
  estimates, the one that leaves it).
* An estimation round reads the rows once. A block's expected sums are formed for each pair of entry and exit state,
  so they need nothing from the neighbours; the chain weighs them with its vectors. Rounds carry a parameter table with
  one row per model, joined to the blocks; models that have converged drop out. Every third round extrapolates the last
  two steps and falls back if the likelihood drops.

``model`` names a set of parameters, ``chain`` a run of consecutive rows. A model may have many chains: series that share
parameters, or the pieces of a training set with gaps.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.store import stored

#: Rows of a block, and blocks of a model that one task takes through all rounds.
BLOCK, LOCAL_BLOCKS = 1024, 64
GAUSSIAN, SWITCHING, GIVEN = "gaussian", "switching", "given"
LEAST, RIDGE, COUNT = 1e-30, 1e-4, 1e-6
STATE = "theta array<double>, origin array<double>, plain array<double>, phase int, ref double, rounds int"
FITTED = "model string, theta array<double>, log_likelihood double, rounds int, done boolean"


def blocks_of(rows: DataFrame, x: list[str], size: int = BLOCK) -> DataFrame:
    """(model, chain, pos, x...) to one row per block: its positions and values in order, and whether it starts its chain.

    Positions order a chain; they needn't be consecutive.
    """
    item = F.struct("pos", F.array(*[F.col(c).cast("double") for c in x]).alias("x"))
    found = rows.groupBy("model", "chain", F.expr(f"CAST(pos div {size} AS INT)").alias("block")).agg(
        F.array_sort(F.collect_list(item)).alias("_i"))
    first = F.col("block") == F.min("block").over(Window.partitionBy("model", "chain"))
    return found.select("model", "chain", "block", first.alias("first"), F.col("_i.pos").cast("array<int>").alias("pos"),
                        F.flatten("_i.x").alias("x"))


# ---- parameters ---------------------------------------------------------------------------------------------------

def states_of(theta: np.ndarray, kind: str) -> int:
    return 2 if kind == SWITCHING else int(round(math.sqrt(len(theta) + 9) - 3))


def pack(kind: str, parts: dict) -> np.ndarray:
    """Parameters as free numbers: logs of probabilities and variances, Cholesky factors, the arc tangent of phi."""
    tail = [np.log(np.maximum(parts["trans"], 1e-12)).ravel(), np.log(np.maximum(parts["start"], 1e-12))]
    if kind == SWITCHING:
        return np.concatenate([parts["mu"], np.log(parts["s2"]), [math.atanh(parts["phi"])], *tail])
    low = np.linalg.cholesky(parts["covs"])
    return np.concatenate([np.ravel(parts["means"]), np.log(low[:, 0, 0]), low[:, 1, 0], np.log(low[:, 1, 1]), *tail])


def unpack(kind: str, theta: np.ndarray) -> dict:
    theta, k = np.asarray(theta, dtype=float), states_of(theta, kind)
    n = len(theta) - k * k - k

    def shares(logs: np.ndarray) -> np.ndarray:
        e = np.exp(logs - logs.max(axis=-1, keepdims=True))
        return e / e.sum(axis=-1, keepdims=True)
    out = {"trans": shares(theta[n:n + k * k].reshape(k, k)), "start": shares(theta[n + k * k:])}
    if kind == SWITCHING:
        return out | {"mu": theta[:2], "s2": np.exp(theta[2:4]), "phi": math.tanh(theta[4])}
    low = np.zeros((k, 2, 2))
    low[:, 0, 0], low[:, 1, 0], low[:, 1, 1] = np.exp(theta[2 * k:3 * k]), theta[3 * k:4 * k], np.exp(theta[4 * k:5 * k])
    return out | {"means": theta[:2 * k].reshape(k, 2), "covs": low @ low.transpose(0, 2, 1), "low": low}


def log_density(kind: str, p: dict, x: np.ndarray) -> np.ndarray:
    """Log density of every row in every state: of pairs of values, or of a value given the one before it."""
    if kind == SWITCHING:
        resid = (x[:, :1] - p["mu"]) - p["phi"] * (x[:, 1:] - p["mu"])
        return -0.5 * (np.log(2 * math.pi * p["s2"]) + resid ** 2 / p["s2"])
    out = np.empty((len(x), len(p["means"])))
    for k, (mean, low) in enumerate(zip(p["means"], p["low"])):
        z1 = (x[:, 0] - mean[0]) / low[0, 0]
        z2 = (x[:, 1] - mean[1] - low[1, 0] * z1) / low[1, 1]
        out[:, k] = -0.5 * (z1 * z1 + z2 * z2) - math.log(low[0, 0] * low[1, 1]) - math.log(2 * math.pi)
    return out


def updated(kind: str, p: dict, sums: np.ndarray, pairs: np.ndarray, start: np.ndarray) -> dict:
    """Parameters from expected sums (state x 1, x, y, xx, xy, yy), transition counts and start."""
    mass = np.maximum(sums[:, 0], 1e-8)
    pairs = pairs + COUNT
    out = {"trans": pairs / pairs.sum(axis=1, keepdims=True), "start": start / start.sum()}
    one, x, y, xx, xy, yy = sums.T
    if kind == SWITCHING:
        mu = (x - p["phi"] * y) / mass / max(1 - p["phi"], 1e-3)
        cross, own = xy - mu * (x + y) + mu ** 2 * one, yy - 2 * mu * y + mu ** 2 * one
        phi = float(np.clip((cross / p["s2"]).sum() / max((own / p["s2"]).sum(), 1e-300), -0.98, 0.98))
        c = mu * (1 - phi)
        square = xx + phi ** 2 * yy + c ** 2 * one - 2 * phi * xy - 2 * c * x + 2 * phi * c * y
        return out | {"mu": mu, "s2": np.maximum(square / mass, 1e-6), "phi": phi}
    means = np.stack([x, y], axis=1) / mass[:, None]
    second = np.stack([xx, xy, xy, yy], axis=1).reshape(-1, 2, 2) / mass[:, None, None]
    return out | {"means": means, "covs": second - means[:, :, None] * means[:, None, :] * (one / mass)[:, None, None]
                  + RIDGE * np.eye(2)}


# ---- blocks -------------------------------------------------------------------------------------------------------

def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a @ b


def _best(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Product in (max, +)."""
    return (a[:, :, :, None] + b[:, None, :, :]).max(axis=2)


def _level(m: np.ndarray, plus: bool) -> tuple[np.ndarray, np.ndarray]:
    """Matrices brought to a largest element of 1 (in max-plus: 0), and the logs taken out."""
    top = m.max(axis=(1, 2))
    if plus:
        return m - top[:, None, None], top
    top = np.maximum(top, 1e-300)
    return m / top[:, None, None], np.log(top)


def products(g: np.ndarray, back: bool = False, plus: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """All products G_0..G_t, or G_t..G_last with ``back``, each with the log of its scale, in log2(n) array steps."""
    times = _best if plus else _times
    m, logs = _level(g, plus)
    s = 1
    while s < len(m):
        a, b = m[:-s], m[s:]
        joined, more = _level(times(a, b), plus)
        both = logs[:-s] + logs[s:] + more
        m, logs = ((np.concatenate([joined, m[-s:]]), np.concatenate([both, logs[-s:]])) if back else
                   (np.concatenate([m[:s], joined]), np.concatenate([logs[:s], both])))
        s *= 2
    return m, logs


def steps_of(log_emit: np.ndarray, trans: np.ndarray, first: bool) -> tuple[np.ndarray, float]:
    """The step matrices of a block, and the logs taken out. A chain's first row has no transition: it is entered in its state."""
    peak = log_emit.max(axis=1)
    e = np.exp(log_emit - peak[:, None])
    g = np.maximum(trans, LEAST)[None] * e[:, None, :]
    if first:
        g[0] = np.diag(e[0])
    return g, float(peak.sum())


def expected(x: np.ndarray, kind: str, p: dict, first: bool) -> tuple[np.ndarray, float, np.ndarray, np.ndarray]:
    """A block's product Z with its log scale, and for each entry and exit state the sums and transition counts times Z."""
    g, taken = steps_of(log_density(kind, p, x), p["trans"], first)
    n, k = g.shape[:2]
    ahead, la = products(g)
    rest, lr = products(g, back=True)
    behind = np.concatenate([rest[1:], np.eye(k)[None]])
    lb = np.concatenate([lr[1:], [0.0]])
    z, lz = ahead[-1], la[-1]
    one = np.ones(n)
    phi = np.stack([one, x[:, 0], x[:, 1], x[:, 0] ** 2, x[:, 0] * x[:, 1], x[:, 1] ** 2], axis=1)
    flow = ahead[:, :, None, :] * behind.transpose(0, 2, 1)[:, None] * np.exp(la + lb - lz)[:, None, None, None]
    sums = (flow.reshape(n, -1).T @ phi).reshape(k, k, k, 6)
    pairs = np.zeros((k, k, k, k))
    if n > 1:
        # P[t-1][i, a] G[t][a, l] Q[t][l, j], summed over t for one l at a time
        scale = np.exp(la[:-1] + lb[1:] - lz)[:, None]
        for to in range(k):
            left = (ahead[:-1] * g[1:, None, :, to]).reshape(n - 1, -1) * scale
            pairs[:, :, :, to] += (left.T @ behind[1:, to, :]).reshape(k, k, k).transpose(0, 2, 1)
    if not first:
        enter = g[0][:, :, None] * behind[0][None] * math.exp(lb[0] - lz)  # entry, to, exit
        for i in range(k):
            pairs[i, :, i, :] += enter[i].T
    return z, lz + taken, sums, pairs


def weighed(blocks: list[tuple], start: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """Log-likelihood, sums, transition counts and start of a chain from its blocks in order."""
    k, a, ll, into = len(start), start, 0.0, []
    for z, lz, *_ in blocks:
        into.append(a)
        a = a @ z
        norm = a.sum()
        a, ll = a / norm, ll + math.log(norm) + lz
    sums, pairs, b = np.zeros((k, 6)), np.zeros((k, k)), np.ones(k)
    for (z, _, s, c), a in zip(reversed(blocks), reversed(into)):
        w = np.outer(a, b) / (a @ z @ b)
        sums += np.tensordot(w, s, 2)
        pairs += np.tensordot(w, c, 2)
        opening = a * (z @ b)
        b = z @ b
        b = b / b.max()
    return ll, sums, pairs, opening / opening.sum()


# ---- rounds -------------------------------------------------------------------------------------------------------

def advance(state: dict, ll: float, after: np.ndarray | None, tolerance: float, most: int) -> dict:
    """The next state of a model from its likelihood here and the parameters that one update gives.

    Phases: 0 and 1 are plain updates, then the two steps are extrapolated; 2 judges the extrapolated point.
    """
    here, rounds = np.array(state["theta"]), state["rounds"] + 1
    fine = after is not None and math.isfinite(ll) and bool(np.isfinite(after).all())
    out = {"origin": None, "plain": None, "phase": 0, "ref": None, "rounds": rounds, "log_likelihood": ll,
           "done": rounds >= most, "theta": here}
    if state["phase"] == 2 and not (fine and ll >= state["ref"]):
        return out | {"theta": np.array(state["plain"]), "log_likelihood": state["ref"]}
    if not fine:
        return out | {"done": True}
    if state["phase"] == 1:
        if abs(ll - state["ref"]) < tolerance:
            return out | {"done": True}
        origin = np.array(state["origin"])
        r = here - origin
        v = after - here - r
        size = float(np.sqrt((v * v).sum()))
        if size > 1e-12:
            a = min(-1.0, -float(np.sqrt((r * r).sum())) / size)
            return out | {"theta": origin - 2 * a * r + a * a * v if not out["done"] else after, "plain": after, "phase": 2, "ref": ll}
        return out | {"theta": after}
    if state["phase"] == 0:
        return out | {"theta": after, "origin": here, "phase": 1, "ref": ll}
    return out | {"theta": after}


_PACKED = pa.schema([("model", pa.string()), ("chain", pa.string()), ("block", pa.int32()), ("z", pa.list_(pa.float64())),
                     ("theta", pa.list_(pa.float64())), ("origin", pa.list_(pa.float64())), ("plain", pa.list_(pa.float64())),
                     ("phase", pa.int32()), ("ref", pa.float64()), ("rounds", pa.int32())])
_STATE = ["theta", "origin", "plain", "phase", "ref", "rounds"]
_NEXT = f"model string, {STATE}, log_likelihood double, done boolean"
_SUMS = f"model string, ll double, sums array<double>, {STATE}"


def _arrow(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[f.name] for r in rows], f.type) for f in schema], schema=schema)


def _block_round(batches, kind: str):
    for batch in batches:
        for at in range(0, batch.num_rows, 64):
            rows = []
            for r in batch.slice(at, 64).to_pylist():
                with np.errstate(all="ignore"):
                    p = unpack(kind, r["theta"])
                    z, lz, sums, pairs = expected(np.array(r["x"]).reshape(-1, 2), kind, p, r["first"])
                flat = np.concatenate([[lz], z.ravel(), sums.ravel(), pairs.ravel()])
                keep = r if r["first"] else dict.fromkeys(_STATE) | {"theta": r["theta"]}
                rows.append({c: r[c] for c in ("model", "chain", "block")} | {"z": flat} | {c: keep[c] for c in _STATE})
            yield _arrow(rows, _PACKED)


def _chain_sums(t: pa.Table, kind: str) -> tuple[dict, float, np.ndarray, np.ndarray, np.ndarray]:
    """A group's state, likelihood and sums; its chains come one after another."""
    rows = sorted(t.to_pylist(), key=lambda r: (r["chain"], r["block"]))
    k, chains = states_of(rows[0]["theta"], kind), {}
    cut = np.cumsum([1, k * k, k ** 3 * 6])
    for r in rows:
        flat = np.array(r["z"])
        chains.setdefault(r["chain"], []).append((flat[1:cut[1]].reshape(k, k), flat[0], flat[cut[1]:cut[2]].reshape(
            k, k, k, 6), flat[cut[2]:].reshape(k, k, k, k)))
    start = unpack(kind, rows[0]["theta"])["start"]
    with np.errstate(all="ignore"):
        try:
            each = [weighed(blocks, start) for blocks in chains.values()]
            return rows[0], *[sum(part) for part in zip(*each)]
        except ValueError:  # a point without likelihood
            return rows[0], math.nan, np.full((k, 6), math.nan), np.full((k, k), math.nan), np.full(k, math.nan)


def _next_state(kind: str, state: dict, ll: float, sums, pairs, start, tolerance: float, most: int) -> dict:
    after = None
    with np.errstate(all="ignore"):
        if math.isfinite(ll):
            try:
                after = pack(kind, updated(kind, unpack(kind, state["theta"]), sums, pairs, start))
            except (np.linalg.LinAlgError, ValueError):
                after = None
        return {"model": state["model"]} | advance(state, ll, after, tolerance, most)


_NEXT_ARROW = pa.schema([("model", pa.string()), *[_PACKED.field(c) for c in _STATE], ("log_likelihood", pa.float64()),
                         ("done", pa.bool_())])
_SUMS_ARROW = pa.schema([("model", pa.string()), ("ll", pa.float64()), ("sums", pa.list_(pa.float64())),
                         *[_PACKED.field(c) for c in _STATE]])


def fitted(blocks: DataFrame, initial: DataFrame, kind: str, iterations: int = 200, tolerance: float = 1e-3,
           pooled: bool = False) -> DataFrame:
    """Maximum-likelihood parameters per model, from blocks and (model, theta): the columns of ``FITTED``.

    A model's chains are the pieces of one series, a row per block, and update it in one group. ``pooled``: models have any
    number of series as their chains, whose sums are added up by partial aggregates before the update. Models of at most
    ``LOCAL_BLOCKS`` blocks (65,536 rows) go through all their rounds in one task each, by the same steps; only longer and
    pooled ones need a job for each round.
    """
    if not pooled:
        sizes = blocks.groupBy("model").count()
        small = sizes.where(F.col("count") <= LOCAL_BLOCKS).select("model")
        # Models are few bytes and long work: a number of parts that is named isn't merged by size into a few tasks.
        parts = int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        done = stored(blocks.join(initial, "model").join(small, "model", "left_semi").repartition(parts, "model").groupBy("model").applyInArrow(
            lambda t: _all_rounds(t, kind, iterations, tolerance), FITTED))
        large = sizes.where(F.col("count") > LOCAL_BLOCKS).select("model")
        if large.isEmpty():
            return done
        rest = _by_rounds(blocks.join(large, "model", "left_semi"), initial.join(large, "model", "left_semi"), kind, iterations,
                          tolerance, False)
        return done.unionByName(rest)
    return _by_rounds(blocks, initial, kind, iterations, tolerance, True)


def _all_rounds(t: pa.Table, kind: str, iterations: int, tolerance: float) -> pa.Table:
    """All rounds of one model from its blocks."""
    rows = sorted(t.to_pylist(), key=lambda r: (r["chain"], r["block"]))
    state = {"model": rows[0]["model"], "theta": rows[0]["theta"], "origin": None, "plain": None, "phase": 0, "ref": None,
             "rounds": 0, "done": False}
    data = [(r["chain"], r["first"], np.array(r["x"]).reshape(-1, 2)) for r in rows]
    while not state["done"]:
        k = states_of(state["theta"], kind)
        with np.errstate(all="ignore"):
            p = unpack(kind, state["theta"])
            chains: dict[str, list] = {}
            for chain, first, x in data:
                chains.setdefault(chain, []).append(expected(x, kind, p, first))
            try:
                ll, sums, pairs, start = [sum(part) for part in zip(*[weighed(b, p["start"]) for b in chains.values()])]
            except ValueError:
                ll, sums, pairs, start = math.nan, np.zeros((k, 6)), np.zeros((k, k)), np.zeros(k)
        state = _next_state(kind, state, float(ll), sums, pairs, start, tolerance, iterations)
    return pa.Table.from_batches([_arrow([{c: state[c] for c in ("model", "theta", "log_likelihood", "rounds", "done")}], pa.schema(
        [("model", pa.string()), ("theta", pa.list_(pa.float64())), ("log_likelihood", pa.float64()), ("rounds", pa.int32()),
         ("done", pa.bool_())]))])


def _by_rounds(blocks: DataFrame, initial: DataFrame, kind: str, iterations: int, tolerance: float, pooled: bool) -> DataFrame:
    """A job for each round, over all models that haven't converged."""
    names = [c.split()[0] for c in STATE.split(", ")]
    none = F.lit(None).cast("array<double>")
    active = initial.select("model", "theta", none.alias("origin"), none.alias("plain"), F.lit(0).alias("phase"),
                            F.lit(None).cast("double").alias("ref"), F.lit(0).alias("rounds"))

    def update(t: pa.Table) -> pa.Table:
        state, ll, sums, pairs, start = _chain_sums(t, kind)
        return pa.Table.from_batches([_arrow([_next_state(kind, state, ll, sums, pairs, start, tolerance, iterations)], _NEXT_ARROW)])

    def total(t: pa.Table) -> pa.Table:
        state, ll, sums, pairs, start = _chain_sums(t, kind)
        flat = np.concatenate([sums.ravel(), pairs.ravel(), start])
        return pa.Table.from_batches([_arrow([state | {"ll": ll, "sums": flat}], _SUMS_ARROW)])

    def join_chains(batches):
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                k, flat = states_of(r["theta"], kind), np.array(r["sums"])
                rows.append(_next_state(kind, r, r["ll"], flat[:6 * k].reshape(k, 6), flat[6 * k:6 * k + k * k].reshape(k, k),
                                        flat[6 * k + k * k:], tolerance, iterations))
            if rows:
                yield _arrow(rows, _NEXT_ARROW)
    ended = []
    while True:
        packed = blocks.join(active, "model").mapInArrow(lambda bs: _block_round(bs, kind), _packed_schema())
        if pooled:
            sums = packed.groupBy("model", "chain").applyInArrow(total, _SUMS)
            each = sums.select("model", "ll", F.posexplode("sums").alias("i", "v")).groupBy("model", "i").agg(
                F.sum("v").alias("v"), F.sum("ll").alias("ll"))
            added = each.groupBy("model").agg(F.first("ll").alias("ll"), F.transform(F.array_sort(F.collect_list(
                F.struct("i", "v"))), lambda e: e["v"]).alias("sums"))
            new = added.join(active, "model").select("model", "ll", "sums", *names).mapInArrow(join_chains, _NEXT)
        else:
            new = packed.groupBy("model").applyInArrow(update, _NEXT)
        new = stored(new)
        ended.append(new.where("done"))
        active = new.where("NOT done").select("model", *names)
        if active.isEmpty():
            break
    return stored(reduce(DataFrame.unionByName, ended).select("model", "theta", "log_likelihood", "rounds", "done"))


def _packed_schema() -> str:
    return f"model string, chain string, block int, z array<double>, {STATE}"


# ---- filters and paths --------------------------------------------------------------------------------------------

def _given(r: dict, kind: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log densities, transitions and start of a block."""
    if kind == GIVEN:
        start = np.array(r["start"])
        return np.array(r["x"]).reshape(-1, len(start)), np.array(r["trans"]).reshape(len(start), -1), start
    p = unpack(kind, r["theta"])
    return log_density(kind, p, np.array(r["x"]).reshape(-1, 2)), p["trans"], p["start"]


def _plus(log_emit: np.ndarray, trans: np.ndarray, first: bool) -> np.ndarray:
    g = np.log(np.maximum(trans, 1e-300))[None] + log_emit[:, None, :]
    if first:
        g[0] = np.where(np.eye(len(trans), dtype=bool), log_emit[0], -1e300)
    return g


def _ends(blocks: DataFrame, kind: str, plus: bool) -> DataFrame:
    """(model, chain, block, enter, leave): the vector that enters each block; for paths its entry and exit states."""
    schema = "model string, chain string, block int, z array<double>, start array<double>"
    types = pa.schema([("model", pa.string()), ("chain", pa.string()), ("block", pa.int32()), ("z", pa.list_(pa.float64())),
                       ("start", pa.list_(pa.float64()))])
    ends = pa.schema([("model", pa.string()), ("chain", pa.string()), ("block", pa.int32()), ("enter", pa.list_(pa.float64())),
                      ("into", pa.int32()), ("out", pa.int32())])

    def condense(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                rows = []
                for r in batch.slice(at, 64).to_pylist():
                    log_emit, trans, start = _given(r, kind)
                    if plus:
                        g = _plus(log_emit, trans, r["first"])
                    else:
                        g, _ = steps_of(log_emit, trans, r["first"])
                    z, lz = products(g, plus=plus)
                    rows.append(r | {"z": (z[-1] + lz[-1] if plus else z[-1]).ravel(), "start": start})
                yield _arrow(rows, types)

    def carry(t: pa.Table) -> pa.Table:
        rows = sorted(t.to_pylist(), key=lambda r: r["block"])
        start = np.array(rows[0]["start"])
        k, out = len(start), []
        if not plus:
            a = start
            for r in rows:
                out.append(r | {"enter": a, "into": None, "out": None})
                a = a @ np.array(r["z"]).reshape(k, k)
                a = a / a.sum() if a.sum() > 0 else np.full(k, 1 / k)
        else:
            score, froms = np.log(np.maximum(start, 1e-300)), []
            for r in rows:
                via = score[:, None] + np.array(r["z"]).reshape(k, k)
                froms.append(via.argmax(axis=0))
                score = via.max(axis=0)
            state = int(score.argmax())
            for r, came in zip(reversed(rows), reversed(froms)):
                out.append(r | {"enter": None, "into": int(came[state]), "out": state})
                state = int(came[state])
        return pa.Table.from_batches([_arrow(out, ends)])
    return (blocks.mapInArrow(condense, schema).groupBy("model", "chain")
            .applyInArrow(carry, "model string, chain string, block int, enter array<double>, into int, out int"))


def _applied(blocks: DataFrame, kind: str, plus: bool, value: str, arrow: pa.DataType, fn) -> DataFrame:
    types = pa.schema([("model", pa.string()), ("chain", pa.string()), ("pos", pa.int32()), ("value", arrow)])

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = [(r, fn(r, *_given(r, kind))) for r in batch.slice(at, 64).to_pylist()]
                yield pa.RecordBatch.from_arrays([
                    pa.array([r["model"] for r, v in part for _ in v], pa.string()), pa.array([r["chain"] for r, v in part for _ in v], pa.string()),
                    pa.array([p for r, _ in part for p in r["pos"]], pa.int32()), pa.array([x for _, v in part for x in v], arrow)], schema=types)
    ends = _ends(blocks, kind, plus)
    return blocks.join(ends, ["model", "chain", "block"]).mapInArrow(run, f"model string, chain string, pos int, value {value}")


def filtered(blocks: DataFrame, parameters: DataFrame, kind: str) -> DataFrame:
    """(model, chain, pos, value): the state probabilities of each row given the rows up to it, as an array.

    ``parameters`` has (model, theta), or (model, trans, start) for blocks of given log densities.
    """
    def fn(r, log_emit, trans, start):
        g, _ = steps_of(log_emit, trans, r["first"])
        p = np.einsum("i,tij->tj", np.array(r["enter"]), products(g)[0])
        total = p.sum(axis=1, keepdims=True)
        return np.where(total > 0, p / np.maximum(total, 1e-300), 1 / len(start)).tolist()
    return _applied(blocks.join(parameters, "model"), kind, False, "array<double>", pa.list_(pa.float64()), fn)


def decoded(blocks: DataFrame, parameters: DataFrame, kind: str) -> DataFrame:
    """(model, chain, pos, value): the state of each row on the likeliest path of its chain."""
    def fn(r, log_emit, trans, start):
        g = _plus(log_emit, trans, r["first"])
        (ahead, la), (rest, lr) = products(g, plus=True), products(g, back=True, plus=True)
        to = ahead[:, r["into"], :] + la[:, None]
        on = np.concatenate([rest[1:, :, r["out"]] + lr[1:, None], np.where(np.arange(len(start)) == r["out"], 0.0, -1e300)[None]])
        return (to + on).argmax(axis=1).tolist()
    return _applied(blocks.join(parameters, "model"), kind, True, "int", pa.int32(), fn)
