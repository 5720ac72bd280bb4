"""Toxicity by a convolutional text classifier, trained in numpy.

A word's embedding is the sum of three rows of a hashed table: two by hashes
of the word, so that two words seldom share both, and one by its first letters,
so that unseen inflections of a learnt word are known. Filters of several widths run over the embedded words; each keeps
its maximum over the whole text, and a logistic layer weighs the maxima. Only
the positions of the maxima receive gradients, so an epoch costs little more
than the forward pass.

Each document's logit is compared with the threshold of its *predicted*
language group (a naive Bayes vote of the same hashed words). The thresholds
come from calibration documents that training did not see. The score is the
logistic function of the distance, so 0.5 is the decision line everywhere.

All labelled documents outside the held-out fifth are learned from, whole. They
are dealt into shards by a hash. In a pass every shard goes on from the common
model by itself; then the models are merged in a shuffle by blocks of table rows,
each row by how often the shards touched it. Counts of words, votes and logits
are summed up likewise.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridframe.llm import text as T
from gridframe.session import ship_package

BUCKETS = 1 << 17
#: letters of a word's beginning that are hashed by themselves
PREFIX = 4
#: table rows that fewer training documents use learn nothing; a word needs both of its rows
LEAST_DOCS = 5
WIDTH = 8
FILTERS = 12
WIDTHS = (1, 2, 3)
#: passes over all training documents: the most, the least, and the documents that at least go through in all
EPOCHS = 6
LEAST_EPOCHS = 2
EPOCH_DOCS = 18_000
BATCH = 32
#: letters of all documents per shard
SHARD_CHARS = 1 << 27
#: table rows that are merged at once
MERGE_ROWS = 1 << 13
#: steps of one unit of the logit that calibration tells apart
LOGIT_STEPS = 1000
#: words convolved at once
CHUNK = 1 << 18


def rows_of(words: np.ndarray, begins: np.ndarray, buckets: int) -> np.ndarray:
    """[words, 3] rows of the embedding table."""
    h, p, low = words.view(np.uint64), begins.view(np.uint64), np.uint64(buckets - 1)
    out = np.empty((len(h), 3), np.int32)
    out[:, 0] = h & low
    out[:, 1] = ((h >> np.uint64(32)) & low) + np.uint64(buckets)
    out[:, 2] = (p & low) + np.uint64(2 * buckets)
    return out


@dataclass
class Model:
    table: np.ndarray  # [3 * buckets + 1, WIDTH], the last row always 0
    kernels: list[np.ndarray]  # per width: [width, WIDTH, FILTERS]
    bias: np.ndarray  # [len(WIDTHS) * FILTERS]
    out: np.ndarray
    intercept: float = 0.0
    constant: float | None = None  # the score of every text if there was one label only
    groups: list[str] = field(default_factory=list)
    votes: np.ndarray | None = None  # [buckets, groups] log-probabilities
    limits: np.ndarray | None = None  # [groups]

    @property
    def buckets(self) -> int:
        return len(self.table) // 3


def _start(seed: int, buckets: int) -> Model:
    rng = np.random.default_rng(seed)
    kernels = [rng.normal(0, 0.5 / np.sqrt(w), (w, WIDTH, FILTERS)).astype(np.float32) for w in WIDTHS]
    n = len(WIDTHS) * FILTERS
    return Model(np.zeros((3 * buckets + 1, WIDTH), np.float32), kernels, np.full(n, 0.1, np.float32),
                 rng.normal(0, 0.5, n).astype(np.float32))


def _maxima(model: Model, rows: np.ndarray, offsets: np.ndarray, where: bool = False):
    """[docs, filters] maxima of the filters' responses over each document and, if
    asked, their positions. Filters stay inside a document; one shorter than a
    filter is filled up with zero words. Positions count words and filling."""
    gap = max(WIDTHS)  # zero words after each document
    lengths = np.diff(offsets) + gap
    starts = np.cumsum(lengths) - lengths
    total = int(lengths.sum())
    doc = np.repeat(np.arange(len(lengths)), np.diff(offsets))
    place = np.arange(len(rows)) + gap * doc
    x = np.zeros((total + gap, WIDTH), np.float32)
    x[place] = model.table[rows[:, 0]] + model.table[rows[:, 1]] + model.table[rows[:, 2]]
    best, arg = [], []
    for k in model.kernels:
        width = len(k)
        y = x[:total] @ k[0]
        for j in range(1, width):
            y += x[j:total + j] @ k[j]
        last = starts + np.maximum(lengths - gap - width, 0)  # the last row whose words all count
        for j in range(1, width + gap):
            beyond = last + j
            y[beyond[beyond < starts + lengths]] = -np.inf
        top = np.maximum.reduceat(y, starts, axis=0)
        best.append(top)
        if where:
            row = np.repeat(np.arange(len(lengths)), lengths)
            hit = y == top[row]
            pos = np.empty((len(lengths), FILTERS), np.int64)
            for f in range(FILTERS):
                at = np.flatnonzero(hit[:, f])[::-1]
                pos[row[at], f] = at  # the first maximum stays
            arg.append(pos)
    return np.concatenate(best, 1), arg, x, place


def logits(model: Model, rows: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Logit of every document; long documents run through in chunks."""
    top = np.full((len(offsets) - 1, len(model.bias)), -np.inf, np.float32)
    gap = max(WIDTHS) - 1
    cuts: list[tuple[int, int, int]] = []

    def flush() -> None:
        if cuts:
            sizes = np.array([hi - lo for _, lo, hi in cuts])
            part = np.concatenate([rows[lo:hi] for _, lo, hi in cuts])
            found = _maxima(model, part, np.concatenate([[0], np.cumsum(sizes)]))[0]
            np.maximum.at(top, [d for d, _, _ in cuts], found)
            cuts.clear()

    waiting = 0
    for d in range(len(offsets) - 1):
        lo, hi = int(offsets[d]), int(offsets[d + 1])
        while True:
            end = min(hi, lo + CHUNK)
            cuts.append((d, lo, end))
            waiting += end - lo
            if waiting >= CHUNK:
                flush()
                waiting = 0
            if end == hi:
                break
            lo = end - gap
    flush()
    return np.maximum(top + model.bias, 0) @ model.out + model.intercept


def _group(model: Model, rows: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Number of each document's most likely language group (0 if it has no word)."""
    n = len(offsets) - 1
    sums = np.zeros((n, len(model.groups)), np.float64)
    full = np.flatnonzero(np.diff(offsets) > 0)
    if len(full):
        sums[full] = np.add.reduceat(model.votes[rows[:, 0]], offsets[:-1][full], axis=0, dtype=np.float64)
    return sums.argmax(1)


def scores(model: Model, rows: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    if model.constant is not None:
        return np.full(len(offsets) - 1, model.constant)
    z = logits(model, rows, offsets) - model.limits[_group(model, rows, offsets)]
    return 1 / (1 + np.exp(-np.clip(z.astype(np.float64), -30, 30)))


def _pick(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.concatenate([np.zeros((0, 3), np.int32), *docs]), np.concatenate([[0], np.cumsum([len(d) for d in docs])]).astype(np.int64)


def _peaks(model: Model, rows: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maxima of the filters over each document and the words they begin at; a word at
    or beyond the document's end is filling. Long documents run through in chunks."""
    n = len(offsets) - 1
    top, at = np.full((n, len(model.bias)), -np.inf, np.float32), np.zeros((n, len(model.bias)), np.int64)
    gap, cuts = max(WIDTHS), []

    def flush() -> None:
        sizes = np.array([hi - lo for _, lo, hi in cuts])
        starts = np.concatenate([[0], np.cumsum(sizes)])
        found, arg, _, _ = _maxima(model, np.concatenate([rows[lo:hi] for _, lo, hi in cuts]), starts, where=True)
        word = np.concatenate(arg, 1)
        for i, (d, lo, _) in enumerate(cuts):
            better = found[i] > top[d]
            at[d, better] = (word[i] - gap * i - starts[i] + lo)[better]
            top[d, better] = found[i, better]
        cuts.clear()

    waiting = 0
    for d in range(n):
        lo, hi = int(offsets[d]), int(offsets[d + 1])
        while True:
            end = min(hi, lo + CHUNK)
            cuts.append((d, lo, end))
            waiting += end - lo
            if waiting >= CHUNK:
                flush()
                waiting = 0
            if end == hi:
                break
            lo = end - gap + 1
    if cuts:
        flush()
    return top, at


class Training:
    """A model under Adagrad, and what changed since it was taken up."""

    RATE = 0.1

    def __init__(self, model: Model, past_rows: np.ndarray, past_dense: np.ndarray):
        self.model = Model(model.table.copy(), [k.copy() for k in model.kernels], model.bias.copy(), model.out.copy(), model.intercept)
        self.first, self.past_rows = model, past_rows
        self.past = np.repeat(past_rows[:, None], WIDTH, 1)
        self.dense0, self.past_dense = dense_part(model), past_dense.copy()
        self.touched, self.docs = np.zeros(len(model.table), np.float32), 0

    def step(self, flat: np.ndarray, offsets: np.ndarray, labels: np.ndarray, weight: np.ndarray) -> None:
        """One batch of documents (rows of the table); both labels weigh the same."""
        model, n = self.model, len(labels)
        top, at = _peaks(model, flat, offsets)
        act = np.maximum(top + model.bias, 0)
        err = (1 / (1 + np.exp(-np.clip(act @ model.out + model.intercept, -30, 30))) - labels) * weight / n
        d_out, d_top = act.T @ err, np.outer(err, model.out) * (act > 0)
        ends = offsets[1:][:, None]
        rows, grads, d_kernels = [], [], []
        for w, kernel in enumerate(model.kernels):
            d, begin = d_top[:, w * FILTERS:(w + 1) * FILTERS], at[:, w * FILTERS:(w + 1) * FILTERS]
            for j in range(len(kernel)):
                inside = begin + j < ends
                word = flat[np.where(inside, begin + j, 0)] if len(flat) else np.full((*begin.shape, 3), len(model.table) - 1)
                inputs = np.where(inside[..., None], model.table[word].sum(2), 0)  # [docs, filters, WIDTH]
                d_kernels.append(np.einsum("df,dfe->ef", d, inputs))
                live = inside & (d != 0)
                g = d[..., None] * kernel[j].T[None]
                for side in range(3):
                    rows.append(word[live][:, side])
                    grads.append(g[live])
        rows_all, inverse = np.unique(np.concatenate(rows), return_inverse=True)
        total = np.zeros((len(rows_all), WIDTH), np.float32)
        np.add.at(total, inverse, np.concatenate(grads))
        self.past[rows_all] += total ** 2
        model.table[rows_all] -= self.RATE * total / np.sqrt(self.past[rows_all])
        model.table[-1] = 0
        self.touched[rows_all] += 1
        grad = np.concatenate([*[k.ravel() for k in d_kernels], d_top.sum(0), d_out, [err.sum()]]).astype(np.float32)
        self.past_dense += grad ** 2
        set_dense(model, dense_part(model) - self.RATE * grad / np.sqrt(self.past_dense))
        self.docs += n

    def changes(self) -> Iterator[tuple[int, bytes]]:
        """(block, numbers) per block of touched table rows; block -1 has all else."""
        touched = np.flatnonzero(self.touched)
        rise = (self.past[touched].mean(1) - self.past_rows[touched]).astype(np.float32)
        rows = np.concatenate([touched[:, None], self.touched[touched][:, None], rise[:, None],
                               self.model.table[touched] - self.first.table[touched]], 1).astype(np.float32)
        for block in np.unique(touched // MERGE_ROWS).tolist():
            yield block, rows[touched // MERGE_ROWS == block].tobytes()
        dense = np.concatenate([[self.docs], dense_part(self.model) - self.dense0, self.past_dense])
        yield -1, dense.astype(np.float32).tobytes()


def dense_part(model: Model) -> np.ndarray:
    return np.concatenate([*[k.ravel() for k in model.kernels], model.bias, model.out, [model.intercept]]).astype(np.float32)


def set_dense(model: Model, flat: np.ndarray) -> None:
    lo = 0
    for i, k in enumerate(model.kernels):
        model.kernels[i] = flat[lo:lo + k.size].reshape(k.shape).astype(np.float32)
        lo += k.size
    n = len(model.bias)
    model.bias, model.out, model.intercept = flat[lo:lo + n].astype(np.float32), flat[lo + n:lo + 2 * n].astype(np.float32), float(flat[-1])


def _merged(key, table):
    """The changes of one block over all shards: a row's mean by the steps that touched
    it, all else by documents."""
    block, parts = key[0].as_py(), table.sort_by("shard").column("data").to_pylist()
    arrays = [np.frombuffer(p, np.float32) for p in parts]
    if block < 0:
        docs = np.array([a[0] for a in arrays], np.float64)
        out = (np.stack([a[1:] for a in arrays]).astype(np.float64) * docs[:, None]).sum(0) / docs.sum()
        data = np.concatenate([[docs.sum()], out]).astype(np.float32)
    else:
        total = np.zeros((MERGE_ROWS, WIDTH + 2), np.float64)
        for a in arrays:
            a = a.reshape(-1, WIDTH + 3).astype(np.float64)
            at = a[:, 0].astype(np.int64) - block * MERGE_ROWS
            total[at, 0] += a[:, 1]
            total[at, 1:] += a[:, 1:2] * a[:, 2:]
        at = np.flatnonzero(total[:, 0])
        data = np.concatenate([(at + block * MERGE_ROWS)[:, None], total[at, 1:] / total[at, :1]], 1).astype(np.float32).ravel()
    return pa.table({"block": pa.array([block], pa.int32()), "data": pa.array([data.tobytes()], pa.binary())})


def _unpacked(packed: np.ndarray) -> np.ndarray:
    low = np.int64(BUCKETS - 1)
    bits = BUCKETS.bit_length() - 1
    return np.stack([packed & low, (packed >> bits & low) + BUCKETS, (packed >> 2 * bits & low) + 2 * BUCKETS], 1)


def _packed(text_col: str):
    """Per word the three table rows of ``rows_of`` in one number."""
    low, bits = F.lit(BUCKETS - 1).cast("long"), BUCKETS.bit_length() - 1

    def one(w):
        h = F.xxhash64(w)
        return h.bitwiseAND(low).bitwiseOR(F.shiftleft(F.shiftrightunsigned(h, 32).bitwiseAND(low), bits)).bitwiseOR(
            F.shiftleft(F.xxhash64(F.left(w, F.lit(PREFIX))).bitwiseAND(low), 2 * bits))

    return F.transform(T.words(F.col(text_col)), one)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    for batch in batches:
        for lo in range(0, batch.num_rows, T.BATCH_ROWS):
            part = batch.slice(lo, T.BATCH_ROWS)
            words, offsets = T.list_parts(part.column(part.num_columns - 1))
            yield part, _unpacked(words), offsets


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents per table row (kind 0), words per language and row (kind 1) and
    documents per label (kind 2) of a task, in blocks."""
    used, votes, labels = np.zeros(3 * BUCKETS, np.int64), {}, np.zeros(2, np.int64)
    for part, rows, offsets in _slices(batches):
        doc = np.repeat(np.arange(part.num_rows), np.diff(offsets))[:, None]
        used += np.bincount(np.unique(doc * 3 * BUCKETS + rows) % (3 * BUCKETS), minlength=3 * BUCKETS)
        labels += np.bincount(np.asarray(part.column(0)), minlength=2)
        for lang, lo, hi in zip(part.column(1).to_pylist(), offsets[:-1], offsets[1:], strict=True):
            if lang is not None:
                if lang not in votes:
                    votes[lang] = np.zeros(BUCKETS, np.int64)
                np.add.at(votes[lang], rows[lo:hi, 0], 1)
    out = [(0, None, b, used[b * MERGE_ROWS:(b + 1) * MERGE_ROWS]) for b in range(-(-len(used) // MERGE_ROWS))] if labels.any() else []
    out += [(1, k, b, v[b * MERGE_ROWS:(b + 1) * MERGE_ROWS]) for k, v in votes.items() for b in range(-(-BUCKETS // MERGE_ROWS))]
    out.append((2, None, 0, labels))
    yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int32()), pa.array([o[1] for o in out], pa.string()),
                                      pa.array([o[2] for o in out], pa.int32()), pa.array([o[3].tobytes() for o in out], pa.binary())],
                                     names=["kind", "lang", "block", "data"])


def _summed(key, table):
    total = sum(np.frombuffer(x, np.int64) for x in table.column("data").to_pylist())
    return pa.table({"kind": pa.array([key[0].as_py()], pa.int32()), "lang": pa.array([key[1].as_py()], pa.string()),
                     "block": pa.array([key[2].as_py()], pa.int32()), "data": pa.array([total.tobytes()], pa.binary())})


def _pass(shared, rare: np.ndarray, weight: np.ndarray) -> Callable:
    """One pass over a task's shards, each from the common model."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start, unused, weights = shared.value, rare.value, weight
        now, shard = None, None

        def changes():
            found = list(now.changes())
            return pa.RecordBatch.from_arrays([pa.array([b for b, _ in found], pa.int32()), pa.array([shard] * len(found), pa.int32()),
                                               pa.array([d for _, d in found], pa.binary())], names=["block", "shard", "data"])

        for part, rows, offsets in _slices(batches):
            blank = 3 * BUCKETS
            few = unused[rows]
            rows[:, :2][few[:, 0] | few[:, 1]] = blank
            rows[few[:, 2], 2] = blank
            label, owner = np.asarray(part.column(0)), np.asarray(part.column(2))
            cuts = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1], [True]]))
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if owner[a] != shard:
                    if now is not None:
                        yield changes()
                    now, shard = Training(*start), int(owner[a])
                for lo in range(a, b, BATCH):
                    hi = min(b, lo + BATCH)
                    now.step(rows[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo], label[lo:hi], weights[label[lo:hi]])
        if now is not None:
            yield changes()

    return run


def _quantile(z: np.ndarray, n: np.ndarray, q: float) -> float:
    """The quantile of values z that occur n times each."""
    order = np.argsort(z, kind="stable")
    ends, place = np.cumsum(n[order]), q * (n.sum() - 1)
    low, high = (z[order][np.searchsorted(ends, p, side="right")] for p in (np.floor(place), np.ceil(place)))
    return float(low + (high - low) * (place - np.floor(place)))


def calibrate(model: Model, z: np.ndarray, group: np.ndarray, labels: np.ndarray, n: np.ndarray) -> None:
    """The threshold of each group: the cut of the logits with the fewest errors,
    a missed toxic document counting as two. ``n`` documents have each (z, group, label)."""
    if model.constant is not None or not len(z):
        return

    def cut(mask: np.ndarray, least: int) -> float | None:
        order = np.argsort(z, kind="stable")
        order = order[mask[order]]
        values, pos = z[order], np.where(labels[order] == 1, n[order], 0)
        neg = n[order] - pos
        if pos.sum() < least or neg.sum() < least:
            return None
        at = np.unique(values)
        at = np.concatenate([[at[0] - 1], (at[1:] + at[:-1]) / 2, [at[-1] + 1]])
        below = np.searchsorted(values, at)
        wrong = 2 * np.concatenate([[0], np.cumsum(pos)])[below] + neg.sum() - np.concatenate([[0], np.cumsum(neg)])[below]
        best = np.flatnonzero(wrong == wrong.min())
        return float((at[best[0]] + at[best[-1]]) / 2)

    # groups differ in where their clean documents lie: a group without a cut of its own
    # takes the one over all, each group measured from its clean documents' upper end
    top, clean = np.zeros(len(model.groups)), labels == 0
    for k in range(len(model.groups)):
        own = clean & (group == k)
        some = own if n[own].sum() >= 20 else clean
        top[k] = _quantile(z[some], n[some], 0.95) if some.any() else 0.0
    z = z - top[group]
    overall = cut(np.ones(len(z), bool), 1) or 0.0
    for k in range(len(model.groups)):
        found = cut(group == k, 12)
        model.limits[k] = top[k] + (overall if found is None else found)


def labelled_rows(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
                  lang_col: str | None = "lang", shards: int = 1) -> DataFrame:
    """(label, lang, shard, tune, words) of every labelled document outside the held-out
    fifth, whole, sorted by shard and a hash. One in five, by that hash, calibrates.

    Labels and documents go to their shard together, in one exchange for any size of
    the two, and meet there by a window over the sorted rows of an id."""
    kind = docs.select(F.col(id_col).alias("doc_id")).schema["doc_id"].dataType
    marked = labels.select(F.col(id_col).cast(kind).alias("doc_id"), F.col(label_col).cast("int").alias("label"),
                           F.lit(None).cast("string").alias("text"), F.lit(None).cast("string").alias("lang")).where(F.col("label").isin(0, 1))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.lit(None).cast("int").alias("label"), F.col(text_col).alias("text"),
                       (F.col(lang_col) if lang_col else F.lit(None)).cast("string").alias("lang")).where(F.col("text").isNotNull())
    both = marked.union(rows).where(F.col("doc_id").isNotNull() & ~T.held_out("doc_id")).select(
        "doc_id", "label", "text", "lang", F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("int").alias("shard"),
        F.xxhash64(F.lit("toxicity"), "doc_id").alias("mix"), F.xxhash64("text").alias("own"))
    dealt = both.repartition(shards, "shard")
    # an id's labels come before its texts
    before = Window.partitionBy("shard", "mix", "doc_id").orderBy(F.col("text").isNotNull(), "own").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = dealt.withColumn("label", F.max("label").over(before)).where(F.col("text").isNotNull() & F.col("label").isNotNull())
    return found.select("label", "lang", "shard", (F.pmod("mix", F.lit(5)) == 4).alias("tune"), _packed("text").alias("words"))


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
        lang_col: str | None = "lang") -> Model:
    """Fit on all labelled documents outside the held-out fifth, whole, in
    ``LEAST_EPOCHS`` to ``EPOCHS`` passes. One in five calibrates instead. Null texts
    teach nothing. ``lang_col`` only names the groups to be told apart."""
    spark = docs.sparkSession
    ship_package(spark)
    model = _start(7, BUCKETS)
    chars = docs.agg(F.sum(F.length(text_col))).first()[0] or 0
    rows = T.stored(labelled_rows(docs, labels, id_col=id_col, text_col=text_col, label_col=label_col, lang_col=lang_col,
                                  shards=max(1, -(-chars // SHARD_CHARS))), "toxicity-rows")
    taught = rows.where("not tune").select("label", "lang", "shard", "words")
    counted = taught.mapInArrow(_counts, "kind int, lang string, block int, data binary").groupBy("kind", "lang", "block").applyInArrow(
        _summed, "kind int, lang string, block int, data binary").collect()
    used, votes, each = np.zeros(3 * BUCKETS + 1, np.int64), {}, np.zeros(2, np.int64)
    for r in counted:
        into = used if r["kind"] == 0 else votes.setdefault(r["lang"], np.zeros(BUCKETS, np.int64)) if r["kind"] == 1 else each
        data = np.frombuffer(r["data"], np.int64)
        into[r["block"] * MERGE_ROWS:r["block"] * MERGE_ROWS + len(data)] = data
    if not each.all():
        model.constant = float(each[1] > 0)
        T.discard(rows)
        return model
    model.groups = sorted(votes) or ["any"]
    heard = np.stack([votes.get(g, np.zeros(BUCKETS)) for g in model.groups], 1) + 0.1
    model.votes, model.limits = np.log(heard / heard.sum(0)).astype(np.float32), np.zeros(len(model.groups))
    weight = (each.sum() / (2 * each)).astype(np.float32)
    rare = spark.sparkContext.broadcast(used < LEAST_DOCS)
    past, past_dense = np.full(len(model.table), 1e-3, np.float32), np.full(len(dense_part(model)), 1e-3, np.float32)
    for _ in range(int(np.clip(-(-EPOCH_DOCS // int(each.sum())), LEAST_EPOCHS, EPOCHS))):
        shared = spark.sparkContext.broadcast((Model(model.table, model.kernels, model.bias, model.out, model.intercept), past, past_dense))
        merged = taught.mapInArrow(_pass(shared, rare, weight), "block int, shard int, data binary").groupBy("block").applyInArrow(
            _merged, "block int, data binary").collect()
        for r in merged:
            data = np.frombuffer(r["data"], np.float32)
            if r["block"] < 0:
                n = len(past_dense)
                set_dense(model, dense_part(model) + data[1:1 + n])
                past_dense = data[1 + n:].copy()
            else:
                data = data.reshape(-1, WIDTH + 2)
                at = data[:, 0].astype(np.int64)
                past[at] += data[:, 1]
                model.table[at] += data[:, 2:]
        shared.unpersist()
    shared = spark.sparkContext.broadcast(model)

    def logit_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for part, found, offsets in _slices(batches):
            z = np.round(np.clip(logits(m, found, offsets), -30, 30) * LOGIT_STEPS).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(z), pa.array(_group(m, found, offsets).astype(np.int32)), part.column(0)], names=["z", "grp", "label"])

    tuned = rows.where("tune").select("label", "words").mapInArrow(logit_rows, "z int, grp int, label int").groupBy(
        "z", "grp", "label").count().orderBy("z", "grp", "label").collect()  # as many rows as the grid of logits, at most
    z, group, label, n = (np.array([r[i] for r in tuned], t) for i, t in enumerate((np.float64, np.int64, np.int64, np.int64)))
    calibrate(model, z / LOGIT_STEPS, group, label, n)
    T.discard(rows)
    return model


def classify(docs: DataFrame, model: Model, *, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` (all columns by default), score (0 to 1) and predicted (0 or 1) of
    every row; a kept column of one of these names is replaced.

    * null, empty or word-less text: the score of a text of blank words;
    * no labelled row: score 0; one label only: that label;
    * every word of a text counts, however long; equal texts (ties, repeated
      rows) get equal scores; an empty table gives no rows.
    """
    spark = docs.sparkSession
    ship_package(spark)
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ("score", "predicted")]
    shared = spark.sparkContext.broadcast(model)  # fixed by BUCKETS, WIDTH and the languages sampled

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = shared.value
        for batch in batches:
            out = np.empty(len(batch))
            for lo in range(0, len(batch), T.BATCH_ROWS):
                part = batch.iloc[lo:lo + T.BATCH_ROWS].to_numpy()
                offsets = np.concatenate([[0], np.cumsum([len(w) for w in part])]).astype(np.int64)
                out[lo:lo + T.BATCH_ROWS] = np.round(scores(m, _unpacked(np.concatenate(part).astype(np.int64, copy=False)), offsets), 6)
            yield pd.Series(out)

    # only the words' numbers go to Python, the kept columns stay with Spark; not deterministic: once per row, whatever filters follow
    return docs.select(*[F.col(f"`{c}`").alias(c) for c in keep], score.asNondeterministic()(_packed(text_col)).alias("score")).withColumn(
        "predicted", (F.col("score") >= 0.5).cast("int"))
