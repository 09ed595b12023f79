"""Language-model scoring with a gated recurrent network in numpy.

Counts of all learning tokens give the unigram base, the model's vocabulary and its frequency-binned output classes.
The network starts as that unigram model and is trained by truncated backpropagation on every token of every learning
document: shards, dealt by a hash and sorted, train copies side by side, whose weights are averaged by their tokens. So
the weights are a function of the table. Scoring carries the state across windows, so a document of any length has one
exact log-likelihood.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_of, byte_column, checkpoint, crc_mod, id_text, in_slices
from .wordhash import Words, slices, words_of

END = b""  # no word is empty
#: Bounds of what is sent to every executor: the commonest tokens and their length.
HEAD_TOKENS = 1 << 17
HEAD_BYTES = 64
#: Tokens that the model knows, of 4 million learning tokens; they grow with the fourth root of that number.
MODEL_TOKENS = 4096
HIDDEN = 16
STEPS = 32
TRAIN_LANES = 128
#: Text of one training shard.
SHARD_BYTES = 32 << 20
SCORE_LANES = 320
SCORE_STEPS = 96
#: Tokens scored side by side: many, so that few lanes wait for the longest document.
SCORE_TOKENS = 4_000_000
#: Each takes every token of every learning document.
ROUNDS = 1
RATE = 0.2


def tokens_of(text: bytes) -> list[bytes]:
    return [*text.lower().split(), END]


def token_counts(learn: DataFrame) -> DataFrame:
    """(token, n) over all learning documents, summed first by part of the input."""
    schema = pa.schema([("token", pa.binary()), ("n", pa.int64())])

    def run(batches):
        counts: Counter = Counter()
        for batch in batches:
            for part in in_slices(batch):
                for text in byte_column(part.column(1)):
                    counts.update(text.lower().split())
                counts[END] += part.num_rows
                if len(counts) > 400_000:
                    yield batch_of(schema, [list(counts), list(counts.values())])
                    counts.clear()
        if counts:
            yield batch_of(schema, [list(counts), list(counts.values())])

    return learn.mapInArrow(run, "token binary, n bigint").groupBy("token").agg(F.sum("n").alias("n"))


def head_tokens(counts: DataFrame, limit: int = HEAD_TOKENS) -> list[tuple[bytes, int]]:
    """The commonest tokens, commonest first: as many whole bins of counts (a 64th of a doubling each) as hold at most
    `limit` tokens. Bins are counted first, as a limit after a sort would bring each task's first rows to the driver."""
    short = counts.where(F.octet_length("token") <= HEAD_BYTES).withColumn("bin", F.floor(F.log2("n") * 64).cast("int"))
    held, least = 0, None
    for r in sorted(short.groupBy("bin").count().collect(), key=lambda r: -r["bin"]):
        held += r["count"]
        if held > limit:
            break
        least = r["bin"]
    if least is None:
        return []
    rows = short.where(F.col("bin") >= least).select("token", "n").collect()
    return sorted(((bytes(r.token), r.n) for r in rows), key=lambda t: (-t[1], t[0]))


class Vocabulary:
    """What executors need of the counts: the head's counts, the model's ids, output classes, unigram start."""

    def __init__(self, head: list[tuple[bytes, int]], n_tokens: int, n_types: int) -> None:
        self.n_tokens, self.n_types = n_tokens, n_types
        self.ids = {t: i for i, (t, _) in enumerate(head)}
        self.logs = np.log10(np.array([c for _, c in head], float) + 0.5) if head else np.zeros(0)
        self.base = float(np.log10(n_tokens + 0.5 * (n_types + 1)))
        size = int(MODEL_TOKENS * max(1.0, n_tokens / (1 << 22)) ** 0.25)
        self.m = min(size - 1, len(head))  # known to the model; id m stands for all others
        classes = max(2, int(0.75 * (self.m + 1) ** 0.5))
        known = np.array([c for _, c in head[: self.m]], float) + 0.5
        self.rest = max(0.5, n_tokens + 0.5 * (n_types + 1) - known.sum())
        mass = np.append(known, self.rest)
        share = np.cumsum(np.sqrt(known)) / max(np.sqrt(known).sum(), 1e-9)
        cls = np.minimum((share * (classes - 1)).astype(int), classes - 2) if self.m else np.zeros(0, int)
        _, cls = np.unique(np.append(cls, classes), return_inverse=True)
        self.cls = cls.astype(np.int32)  # ascending, as commoner tokens come first
        self.n_cls = int(cls[-1]) + 1
        self.starts = np.searchsorted(cls, np.arange(self.n_cls + 1))
        self.mass = mass

    def index(self) -> None:
        """Look-up tables of the head by the hashes of its tokens; made by each worker, as they aren't sent."""
        tokens = [t for t in self.ids if t != END]
        h = words_of(pa.array(tokens, pa.binary())).hashes
        ids = np.array([self.ids[t] for t in tokens], np.int64)
        self.shift = np.uint64(64 - max(8, 2 + int(len(tokens)).bit_length()))
        slot = h >> self.shift
        self.table = np.full(1 << 64 - int(self.shift), -1, np.int64)
        self.table[slot[::-1]] = np.arange(len(h))[::-1]  # the first of those that share a slot
        self.keys, self.key_ids = np.append(h, np.uint64(0)), np.append(ids, 0)
        others = np.flatnonzero(self.table[slot] != np.arange(len(h)))
        order = others[np.argsort(h[others])]
        self.other_keys, self.other_ids = h[order], ids[order]

    def ids_of(self, words: Words) -> np.ndarray:
        """Ids of words within the head; len(head) for others."""
        if not hasattr(self, "table"):
            self.index()
        none, h = len(self.ids), words.hashes
        at = self.table[h >> self.shift]
        hit = (self.keys[at] == h) & (at >= 0)
        out = np.where(hit, self.key_ids[at], none)
        missed = np.flatnonzero(~hit & (at >= 0))
        if len(missed) and len(self.other_keys):
            place = np.minimum(np.searchsorted(self.other_keys, h[missed]), len(self.other_keys) - 1)
            found = self.other_keys[place] == h[missed]
            out[missed[found]] = self.other_ids[place[found]]
        return out

    def sequences(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """Of each text: the end, its words, the end, as ids within the head, one text after another; and where each begins."""
        counts, end = words.counts(), self.ids.get(END, len(self.ids))
        starts = np.concatenate(([0], np.cumsum(counts + 2)))
        out = np.full(int(starts[-1]), end, np.int64)
        inside = np.ones(len(out), bool)
        inside[starts[:-1]] = inside[starts[1:] - 1] = False
        out[inside] = self.ids_of(words)
        return out, starts

    def __getstate__(self):
        tables = ("table", "keys", "key_ids", "other_keys", "other_ids", "shift")
        return {k: x for k, x in self.__dict__.items() if k not in tables}


Weights = dict[str, np.ndarray]


def start_weights(v: Vocabulary, seed: int = 7) -> Weights:
    rng, n = np.random.default_rng(seed), v.m + 1
    small = lambda *s: (rng.standard_normal(s) * 0.1).astype(np.float32)
    per_class = np.add.reduceat(v.mass, v.starts[:-1])
    return {
        "x": small(n, 3 * HIDDEN), "u": small(HIDDEN, 3 * HIDDEN), "b": np.zeros(3 * HIDDEN, np.float32),
        "c": small(HIDDEN, v.n_cls) * 0, "cb": np.log(per_class / per_class.sum()).astype(np.float32),
        "w": small(n, HIDDEN) * 0, "wb": np.log(v.mass / per_class[v.cls]).astype(np.float32),
    }


def forward(w: Weights, x: np.ndarray, h: np.ndarray, keep: bool = True):
    """States after each step of tokens x (steps x lanes), from state h (lanes x HIDDEN); what the gates leave, 1 - z and
    1 - r; the candidate n, and the candidate's recurrent part. Update gate z, reset gate r: h' = z h + (1 - z) n.
    What is returned is steps x features x lanes, so that each gate's numbers lie together. Without keep, only the
    states are of all steps."""
    k, (steps, lanes) = HIDDEN, x.shape
    u, h = np.ascontiguousarray(w["u"].T), np.ascontiguousarray(h.T)
    hs = np.empty((steps, k, lanes), h.dtype)
    gates, cand, gs = (np.empty((steps if keep else 1, n, lanes), h.dtype) for n in (2 * k, k, 3 * k))
    rows, own, bias = np.empty((lanes, 3 * k), h.dtype), np.empty((3 * k, lanes), h.dtype), w["b"][:, None]
    with np.errstate(over="ignore"):  # 1 / (1 + inf) is the 0 that is meant
        for t in range(steps):
            at = t if keep else 0
            g, q, n, after = gs[at], gates[at], cand[at], hs[t]
            np.matmul(u, h, out=g)
            np.take(w["x"], x[t], axis=0, out=rows, mode="clip")
            np.add(rows.T, bias, out=own)
            np.add(own[: 2 * k], g[: 2 * k], out=q)
            np.exp(q, out=q)
            q += 1
            np.reciprocal(q, out=q)
            np.multiply(q[k:], g[2 * k :], out=n)
            np.subtract(g[2 * k :], n, out=n)
            n += own[2 * k :]
            np.tanh(n, out=n)
            np.subtract(n, h, out=after)
            after *= q[:k]
            after += h
            h = after
    return hs, gates, cand, gs[:, 2 * k :]


def backward(w: Weights, h0: np.ndarray, hs: np.ndarray, gates: np.ndarray, cand: np.ndarray, gn: np.ndarray, d_all: np.ndarray):
    """Gradients by input (steps x lanes x 3 HIDDEN) and by the recurrent weights, of what has gradient d_all by hs."""
    k = HIDDEN
    before = np.concatenate((h0.T[None], hs[:-1]))
    left, z = gates[:, :k], 1 - gates[:, :k]
    r = 1 - gates[:, k:]
    by_n = left * (1 - cand * cand)
    by_z = (before - cand) * z * left
    by_r = gn * r * gates[:, k:]
    dn, dg = np.empty_like(hs), np.empty((len(hs), 3 * k, hs.shape[2]), hs.dtype)
    dh = np.zeros_like(hs[0])
    for t in range(len(hs) - 1, -1, -1):
        dh += d_all[t]
        n, d = dn[t], dg[t]
        np.multiply(dh, by_n[t], out=n)
        np.multiply(dh, by_z[t], out=d[:k])
        np.multiply(n, by_r[t], out=d[k : 2 * k])
        np.multiply(n, r[t], out=d[2 * k :])
        dh *= z[t]
        dh += w["u"] @ d
    du = np.matmul(before, dg.transpose(0, 2, 1)).sum(0)
    dg[:, 2 * k :] = dn
    return np.ascontiguousarray(dg.transpose(0, 2, 1)), du


#: Logits are held at 60; they stay far below, as steps are clipped, so no maximum need be taken off.
MOST = 60.0
#: Rows whose logits are taken at once, which then stay in the cache.
ROWS = 512


def _wide(w: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Weights, bias and 1 in each row. By rows of state, 1 and 0 one product gives logits; the exps of these by it give
    their sums with the weights, for the gradient by the state, and their sums alone."""
    out = np.ones((len(w), w.shape[1] + 2), w.dtype)
    out[:, :-2], out[:, -2] = w, b
    return out


def output(w: Weights, v: Vocabulary, h: np.ndarray, target: np.ndarray, gradient: bool = False):
    """Natural log-probability of each target: that of its class, and within its class. With gradient also d/dh and
    the weights' gradients of the summed negative log-probability."""
    with np.errstate(over="ignore", invalid="ignore"):
        out, most = _output(w, v, h, target, gradient, False)
        # sums below exp(MOST) show that no logit was above MOST
        return out if most < np.exp(MOST) else _output(w, v, h, target, gradient, True)[0]


def _output(w: Weights, v: Vocabulary, h: np.ndarray, target: np.ndarray, gradient: bool, hold: bool):
    order = np.argsort(target.astype(np.min_scalar_type(v.m)), kind="stable")  # classes are runs of ids
    target, k = target[order], h.shape[1]
    own = np.zeros((len(h), k + 2), h.dtype)
    own[:, :k], own[:, k] = h[order], 1
    cls, sizes = v.cls[target], np.diff(v.starts)
    edges = np.searchsorted(cls, np.arange(v.n_cls + 1)).tolist()
    classes, words = _wide(w["c"].T, w["cb"]), _wide(w["w"], w["wb"])
    by_class, by_word = np.zeros_like(classes), np.zeros_like(words)
    buffer, share = np.empty(ROWS * max(v.n_cls, sizes.max()), h.dtype), np.empty((ROWS, k + 2), h.dtype)
    row = np.arange(len(h))

    def logits(wide, grads, rows, at, sums):
        """Of some rows: exps' sums, with the weights if gradients are wanted, which are added to grads."""
        n, part = rows.stop - rows.start, own[rows]
        x = buffer[: n * len(wide)].reshape(n, len(wide))
        np.matmul(part, wide.T, out=x)
        if hold:
            np.minimum(x, MOST, out=x)
        np.exp(x, out=x)
        if not gradient:
            np.matmul(x, wide[:, -1], out=sums[rows, -1])
            return
        np.matmul(x, wide, out=sums[rows])
        total = sums[rows, -1:]
        x.ravel()[row[:n] * len(wide) + at[rows]] -= total[:, 0]
        grads += x.T @ np.divide(part, total, out=share[:n])

    def finished(wide, at, sums):
        """Log-probabilities, and gradients by the state."""
        mine = wide[at]
        picked = np.einsum("ij,ij->i", own, mine)
        if hold:
            np.minimum(picked, MOST, out=picked)
        out = picked.astype(np.float64) - np.log(sums[:, -1])
        return out, sums[:, :k] / sums[:, -1:] - mine[:, :k] if gradient else None

    sums = np.empty_like(own)
    for a in range(0, len(h), ROWS):
        logits(classes, by_class, slice(a, min(a + ROWS, len(h))), cls, sums)
    most = sums[:, -1].max(initial=0)
    out, dh = finished(classes, cls, sums)
    within = (target - v.starts[cls]).astype(np.int64)
    several = sizes > 1  # a target alone in its class has all of it
    for c in np.flatnonzero(several).tolist():
        a, b = v.starts[c], v.starts[c + 1]
        for i in range(edges[c], edges[c + 1], ROWS):
            logits(words[a:b], by_word[a:b], slice(i, min(i + ROWS, edges[c + 1])), within, sums)
    most = max(most, sums[several[cls], -1].max(initial=0))
    more, by_h = finished(words, target, sums)
    real = several[cls]
    out[real] += more[real]
    back = np.empty(len(out))
    back[order] = out
    if not gradient:
        return back, most
    dh[real] += by_h[real]
    by_h[order] = dh
    grads = {"c": by_class[:, :k].T.copy(), "cb": by_class[:, k].copy(), "w": by_word[:, :k].copy(), "wb": by_word[:, k].copy()}
    return (back, by_h, grads), most


class _Lanes:
    """Token sequences fed side by side: a lane that ends takes the next sequence, longest first, at the next window."""

    def __init__(self, sequences: list[np.ndarray], lanes: int, steps: int) -> None:
        self.sizes = np.array([len(s) for s in sequences], np.int64)
        self.flat = np.concatenate(sequences) if sequences else np.zeros(0, np.int32)
        self.first = np.cumsum(self.sizes) - self.sizes
        self.order = np.argsort(-self.sizes, kind="stable")
        self.lanes, self.steps = min(lanes, len(sequences)), steps

    def __iter__(self):
        """(sequence of each lane, is it new, tokens read and targets as steps x lanes, which are real)"""
        who, at, left = np.full(self.lanes, -1), np.zeros(self.lanes, np.int64), np.zeros(self.lanes, np.int64)
        taken = 0
        while True:
            who[left <= 0] = -1
            free = np.flatnonzero(who < 0)[: len(self.order) - taken]
            who[free] = self.order[taken : taken + len(free)]
            at[free], left[free] = self.first[who[free]], self.sizes[who[free]] - 1
            taken += len(free)
            new = np.zeros(self.lanes, bool)
            new[free] = True
            live = np.flatnonzero(who >= 0)
            if not len(live):
                return
            steps = int(min(self.steps, left[live].max()))
            step = np.arange(steps)[:, None]
            real = step < left[live]
            place = np.where(real, at[live] + step, 0)
            x, y = (np.where(real, self.flat[place + i], 0).astype(np.int64) for i in (0, 1))
            at[live] += steps
            left[live] -= steps
            yield live, who[live], new[live], x, y, real


def score_all(w: Weights, v: Vocabulary, sequences: list[np.ndarray]) -> np.ndarray:
    """Natural log-likelihood of each sequence after its first token, the state carried through all its windows."""
    out = np.zeros(len(sequences))
    state = np.zeros((min(SCORE_LANES, len(sequences)), HIDDEN), np.float32)
    for live, who, new, x, y, real in _Lanes(sequences, SCORE_LANES, SCORE_STEPS):
        state[live[new]] = 0
        hs = np.ascontiguousarray(forward(w, x, state[live], keep=False)[0].transpose(0, 2, 1))
        state[live] = hs[-1]
        lp, place = np.zeros(x.shape), np.flatnonzero(real)
        lp.ravel()[place] = output(w, v, hs.reshape(-1, HIDDEN)[place], y.ravel()[place])
        np.add.at(out, who, lp.sum(0))
    return out


def window_gradients(w: Weights, v: Vocabulary, h0: np.ndarray, x: np.ndarray, y: np.ndarray, real: np.ndarray):
    """(states, summed log-probability of the real targets, gradients of its negative): those of the inputs as rows,
    one for each real token."""
    hs, *kept = forward(w, x, h0)
    by_lane, place = np.ascontiguousarray(hs.transpose(0, 2, 1)), np.flatnonzero(real)
    out, dh, grads = output(w, v, by_lane.reshape(-1, HIDDEN)[place], y.ravel()[place], gradient=True)
    d_all = np.zeros_like(by_lane)
    d_all.reshape(-1, HIDDEN)[place] = dh
    da, grads["u"] = backward(w, h0, hs, *kept, np.ascontiguousarray(d_all.transpose(0, 2, 1)))
    flat = da.reshape(-1, 3 * HIDDEN)[place]
    return by_lane, out.sum(), grads | {"b": flat.sum(0)}, flat


def train(w: Weights, v: Vocabulary, sequences: list[np.ndarray], rate: float | None = None) -> tuple[Weights, int]:
    """Adagrad over windows of STEPS tokens: gradients stop at a window's beginning, the state does not."""
    rate = RATE if rate is None else rate
    w = {k: x.copy() for k, x in w.items()}
    squares = {k: np.full_like(x, 1e-2) for k, x in w.items()}
    state, seen = np.zeros((min(TRAIN_LANES, len(sequences)), HIDDEN), np.float32), 0

    def follow(name, g, at=slice(None)):
        g *= 20 / n
        np.clip(g, -1, 1, out=g)
        s = squares[name][at]  # a view of all, or a copy of some rows
        s += g * g
        squares[name][at] = s
        g /= np.sqrt(s)
        g *= rate
        w[name][at] -= g

    for live, _, new, x, y, real in _Lanes(sequences, TRAIN_LANES, STEPS):
        state[live[new]] = 0
        hs, _, grads, flat = window_gradients(w, v, state[live], x, y, real)
        state[live] = hs[-1]
        n = int(real.sum())
        seen += n
        tokens = x[real].astype(np.min_scalar_type(v.m))
        order = np.argsort(tokens, kind="stable")
        tokens = tokens[order]
        first = np.flatnonzero(np.append(True, tokens[1:] != tokens[:-1]))
        ids = tokens[first]
        for name, g in grads.items():
            follow(name, g)
        follow("x", np.add.reduceat(flat[order], first, axis=0), ids)
    return w, seen


def _pack(w: Weights) -> np.ndarray:
    return np.concatenate([w[k].ravel() for k in sorted(w)])


def _unpack(flat: np.ndarray, like: Weights) -> Weights:
    out, at = {}, 0
    for k in sorted(like):
        out[k] = flat[at : at + like[k].size].reshape(like[k].shape).astype(np.float32)
        at += like[k].size
    return out


def _model_ids(v: Vocabulary, column: pa.Array) -> list[np.ndarray]:
    """Of each text: the end, its tokens, as the model's ids."""
    out = []
    for a, b in slices(column) if len(column) else ():
        ids, starts = v.sequences(words_of(column.slice(a, b - a), lower=True))
        out += np.split(np.minimum(ids, v.m).astype(np.int32), starts[1:-1])
    return out


def train_round(learn: DataFrame, shared, weights: Weights, shards: int) -> Weights:
    """Each shard trains a copy on all tokens of its documents, the state carried through a document's windows; the
    copies are averaged by their tokens, in blocks of 4,096 weights. A shard's documents are taken in the order of
    their texts, and copies are added up in the order of shards, so neither hangs on the input's partitions."""
    sent = learn.sparkSession.sparkContext.broadcast(weights)
    block = 4096
    schema = pa.schema([("block", pa.int32()), ("shard", pa.int32()), ("n", pa.int64()), ("w", pa.binary())])
    spec = "block int, shard int, n bigint, w binary"

    def run(docs: pa.Table) -> pa.Table:
        texts = docs["text"].combine_chunks()
        texts = texts.take(pc.array_sort_indices(texts))
        w, n = train(sent.value, shared.value, _model_ids(shared.value, texts))
        flat = _pack(w).astype("<f4")
        at = range(0, len(flat), block)
        own = docs["shard"][0].as_py()
        return pa.Table.from_batches([batch_of(schema, [list(range(len(at))), [own] * len(at), [n] * len(at), [flat[i : i + block].tobytes() for i in at]])])

    def merge(copies: pa.Table) -> pa.Table:
        total, tokens = 0.0, 0
        for _, n, data in sorted(zip(*(copies[c].to_pylist() for c in ("shard", "n", "w")))):
            total = total + np.frombuffer(data, "<f4").astype(float) * n
            tokens += n
        return pa.Table.from_batches([batch_of(schema, [copies["block"][:1].to_pylist(), [0], [tokens], [(total / tokens).astype("<f4").tobytes()]])])

    dealt = learn.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(shards)).cast("int").alias("shard"), "text")
    copies = dealt.groupBy("shard").applyInArrow(lambda docs: run(docs), spec)
    rows = copies.groupBy("block").applyInArrow(lambda part: merge(part), spec).collect()  # one model's weights
    if not rows:
        return weights
    flat = np.concatenate([np.frombuffer(r.w, "<f4") for r in sorted(rows, key=lambda r: r.block)])
    return _unpack(flat, weights)


def fit(learn: DataFrame, rounds: int = ROUNDS):
    """(counts of all tokens, broadcast vocabulary, weights) from learn(doc_id, text)."""
    counts = checkpoint(token_counts(learn))
    total = counts.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    head = head_tokens(counts)  # at most HEAD_TOKENS x HEAD_BYTES
    v = Vocabulary(head, total.n or 0, total.v)
    shared = learn.sparkSession.sparkContext.broadcast(v)
    weights = start_weights(v)
    if total.n:
        size = learn.agg(F.sum(F.octet_length("text")).alias("bytes")).first()["bytes"] or 0
        for _ in range(rounds):
            weights = train_round(learn, shared, weights, int(1 + size // SHARD_BYTES))
    return counts, shared, weights


def score_documents(docs: DataFrame, folds: int = 5, held_fold: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Scores of each row of docs from those whose crc32(id) modulo folds is not held_fold.

    doc_id, held_out, n_tokens (words and one end), n_known, train_tokens, base_score (unigram, add one half) and score
    (the model's log10 probability). A null text is an empty one: its only token is the end. Words that the model does
    not know share the probability of their common symbol by their own counts. Repeated rows are scored alike; with
    nothing to learn from, all counts are 0; an empty table gives an empty one."""
    held = crc_mod("doc_id", folds) == held_fold
    rows = id_text(docs, id_col, text_col)
    counts, shared, weights = fit(rows.where(~held))
    sent = docs.sparkSession.sparkContext.broadcast(weights)
    n_train = shared.value.n_tokens
    tail = pa.list_(pa.struct([("token", pa.binary()), ("tf", pa.int32())]))
    schema = pa.schema([("doc_id", pa.int64()), ("h", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()), ("score", pa.float64()), ("tail", tail)])

    def run(batches):
        v, w = shared.value, sent.value
        none, log_rest = len(v.ids), float(np.log10(v.rest))
        logs = np.append(v.logs, 0.0)
        held, sequences, n = [], [], 0

        def flush():
            scores, at = score_all(w, v, sequences) / np.log(10), 0
            for batch in held:
                own = batch.column("score").to_numpy() + scores[at : at + batch.num_rows]
                at += batch.num_rows
                yield batch.set_column(5, schema.field("score"), pa.array(own))

        for whole in batches:
            for a, b in slices(whole.column(2)):
                part = whole.slice(a, b - a)
                words = words_of(part.column(2), lower=True)
                ids, starts = v.sequences(words)
                counts = np.diff(starts) - 1  # words and one end
                own = np.ones(len(ids), bool)
                own[starts[:-1]] = False
                of, ids_own = np.repeat(np.arange(len(counts)), counts), ids[own]
                inside, other = ids_own < none, ids_own >= v.m
                add = lambda x: np.bincount(of, weights=x, minlength=len(counts))
                base = add(logs[ids_own]) - counts * v.base
                extra = add(np.where(other, logs[ids_own] - log_rest, 0.0))
                words_inside = np.ones(len(ids), bool)
                words_inside[starts[:-1]] = words_inside[starts[1:] - 1] = False
                tails: list = [[] for _ in counts]
                unknown = np.flatnonzero(ids[words_inside] == none)
                data = words.data.tobytes()
                where = np.searchsorted(words.edges, unknown, "right") - 1
                cuts = np.searchsorted(where, np.arange(len(counts) + 1)).tolist()
                spelt = [data[x:y] for x, y in zip(words.first[unknown].tolist(), words.last[unknown].tolist())]
                for i in np.flatnonzero(np.diff(cuts)).tolist():
                    tails[i] = [{"token": t, "tf": n} for t, n in Counter(spelt[cuts[i] : cuts[i + 1]]).items()]
                held.append(batch_of(schema, [part.column(0), part.column(1), counts, add(inside).astype(np.int64), base, extra, tails]))
                sequences += np.split(np.minimum(ids, v.m).astype(np.int32), starts[1:-1])
                n += len(ids)
                if n > SCORE_TOKENS:
                    yield from flush()
                    held, sequences, n = [], [], 0
        yield from flush()

    scored = rows.select("doc_id", F.xxhash64("text").alias("h"), "text").mapInArrow(run, "doc_id bigint, h bigint, n_tokens bigint, n_known bigint, base double, score double, tail array<struct<token: binary, tf: int>>")
    # a row for each rare token; the document's own figures are on its first only
    lines = scored.select("*", F.posexplode_outer("tail").alias("pos", "t"))
    first = F.coalesce(F.col("pos"), F.lit(0)) == 0
    own = [F.when(first, F.col(c)).alias(c) for c in ("n_tokens", "n_known", "base", "score")]
    key = F.coalesce(F.concat(F.lit(b"t"), F.col("t.token")), F.concat(F.lit(b"d"), F.col("h").cast("string").cast("binary")))
    lines = lines.select("doc_id", "h", *own, key.alias("k"), F.col("t.tf").alias("tf"))
    known = counts.select(F.concat(F.lit(b"t"), F.col("token")).alias("k"), "n")
    joined = lines.join(known, "k", "left")
    # rows repeated in id and text are one group, whose rare tokens count once for each of them
    times = F.count("n_tokens")
    rare = F.coalesce(F.sum(F.col("tf") * F.log10(F.coalesce("n", F.lit(0)) + 0.5)), F.lit(0.0)) / times
    more = F.coalesce(F.sum(F.when(F.col("n").isNotNull(), F.col("tf"))), F.lit(0)) / times
    summed = joined.groupBy("doc_id", "h").agg(
        F.max("n_tokens").alias("n_tokens"), (F.max("n_known") + more).cast("bigint").alias("n_known"),
        (F.max("base") + rare).alias("base_score"), (F.max("score") + rare).alias("score"), times.alias("times"),
    )
    each = summed.withColumn("time", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("times"))))
    return each.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", F.lit(n_train).cast("bigint").alias("train_tokens"), "base_score", "score")
