"""Language identification by interpolated Kneser-Ney character models.

Per language an n-gram model over normalised characters (lower-cased letters,
everything else one space) with absolute discounting and continuation counts
in the lower orders. The models of all languages share, per order, one sorted
array of n-gram hashes; row i of a matrix holds the log-probability of n-gram
i in every language, so one binary search per character serves all languages.
An n-gram seen in no language falls back to the next order, weighted by its
context's interpolation weight, down to the uniform distribution.

A text gets the language of the lowest cross-entropy per character. A text
whose cross-entropy lies beyond what calibration texts of that language
reached, at its length, is rejected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridframe.llm import text as T
from gridframe.session import ship_package

ORDER = 4
#: training sample: about so many whole documents per language, none longer than so many characters
TRAIN_DOCS = 200
TRAIN_CHARS = 20_000
DISCOUNT = 0.75
#: characters that count as independent evidence in the score
EVIDENCE = 40
#: nats per character beyond the calibration texts' reach at which a text is rejected:
#: texts that mix learnt languages stay below it, other languages and noise lie above
MARGIN = 1.0
CHUNK = 1 << 19
SPACE = 32
_TOP = 0x32400  # letters beyond are taken as they are


def _fold_table() -> np.ndarray:
    out = np.full(_TOP, SPACE, np.uint32)
    for cp in range(_TOP):
        ch = chr(cp)
        if ch.isalpha():
            out[cp] = ord(ch.lower()[0])
    return out


_FOLD: list[np.ndarray] = []


def char_codes(text: str) -> np.ndarray:
    """Normalised characters: letters lower-cased, runs of all else one space,
    none at the ends. Empty if the text has no letter."""
    if not _FOLD:
        _FOLD.append(_fold_table())
    raw = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    codes = _FOLD[0][np.minimum(raw, _TOP - 1)]
    gap = codes == SPACE
    keep = ~gap
    keep[1:] |= ~gap[:-1]
    codes = codes[keep]
    lo, hi = int(len(codes) > 0 and codes[0] == SPACE), len(codes)
    if hi > lo and codes[hi - 1] == SPACE:
        hi -= 1
    return codes[lo:hi]


def gram_hashes(codes: np.ndarray, order: int) -> list[np.ndarray]:
    """hashes[m][i]: hash of the m characters that end at i (m = 0..order); the
    first ``order`` characters must be padding."""
    base = np.uint64(0x9E3779B97F4A7C15)
    out = [np.zeros(len(codes), np.uint64)]
    wide = codes.astype(np.uint64) + np.uint64(1)
    with np.errstate(over="ignore"):
        power = np.uint64(1)
        for m in range(1, order + 1):
            h = out[-1].copy()
            h[m - 1:] += wide[:len(wide) - m + 1] * power
            out.append(h)
            power = power * base
    return out


@dataclass
class Model:
    """languages (sorted); per order m: hashes[m] sorted, logp[m][i, lang]; and for
    contexts of length m: ctx[m] sorted, log_weight[m][i, lang]."""

    languages: list[str]
    order: int
    hashes: list[np.ndarray]
    logp: list[np.ndarray]
    ctx: list[np.ndarray]
    log_weight: list[np.ndarray]
    uniform: float
    mean: np.ndarray | None = None
    spread: np.ndarray | None = None
    reach: np.ndarray | None = None

    def log_probs(self, h: list[np.ndarray], at: np.ndarray) -> np.ndarray:
        """[len(at), languages] log-probabilities of the characters at ``at``."""
        return self._order(self.order, h, at)

    def _order(self, m: int, h: list[np.ndarray], at: np.ndarray) -> np.ndarray:
        if m == 0:
            return np.full((len(at), len(self.languages)), self.uniform, np.float32)
        key = h[m][at]
        idx = np.minimum(np.searchsorted(self.hashes[m], key), len(self.hashes[m]) - 1)
        out = self.logp[m][idx]
        miss = np.flatnonzero(self.hashes[m][idx] != key)
        if len(miss):
            lower = self._order(m - 1, h, at[miss])
            c = h[m - 1][at[miss] - 1]
            j = np.minimum(np.searchsorted(self.ctx[m - 1], c), len(self.ctx[m - 1]) - 1)
            seen = self.ctx[m - 1][j] == c
            out[miss] = lower + np.where(seen[:, None], self.log_weight[m - 1][j], np.float32(0))
        return out


def train(texts: dict[str, list[str]], order: int = ORDER, discount: float = DISCOUNT) -> Model:
    """Fit the models; ``texts``: language -> whole texts."""
    langs = sorted(texts)
    if not langs:
        return Model([], order, [], [], [], [], 0.0)
    pad = np.full(order, SPACE, np.uint32)
    streams = {}
    for lang in langs:
        parts = [np.concatenate([pad, c, pad[:1]]) for c in map(char_codes, texts[lang]) if len(c)]
        marks = [np.arange(len(p)) >= order for p in parts]
        streams[lang] = (np.concatenate(parts) if parts else pad, np.concatenate(marks) if marks else np.zeros(order, bool))
    vocabulary = len(np.unique(np.concatenate([c for c, _ in streams.values()]))) + 1
    model = Model(langs, order, [np.zeros(1, np.uint64)], [np.zeros((1, len(langs)), np.float32)], [], [], -float(np.log(vocabulary)))
    counts: list[list[tuple]] = []  # per order, per language: (gram, context, suffix, count)
    for lang in langs:
        codes, mark = streams[lang]
        h, at = gram_hashes(codes, order), np.flatnonzero(mark)
        per, above = [None] * (order + 1), None
        for m in range(order, 0, -1):
            if above is None:
                gram, first, count = np.unique(h[m][at], return_index=True, return_counts=True)
            else:  # continuation counts: distinct longer n-grams that end in this one
                gram, first, count = np.unique(h[m][above], return_index=True, return_counts=True)
            where = (at if above is None else above)[first]
            per[m] = (gram, h[m - 1][where - 1], h[m - 1][where], count)
            above = where
        counts.append(per)
    previous = np.full((1, len(langs)), 1.0 / vocabulary)  # probabilities of order m - 1
    previous_keys = np.zeros(1, np.uint64)
    model.ctx, model.log_weight = [None] * order, [None] * order
    for m in range(1, order + 1):
        grams = [counts[k][m] for k in range(len(langs))]
        keys, first = np.unique(np.concatenate([g[0] for g in grams]), return_index=True)
        ctx_of = np.concatenate([g[1] for g in grams])[first]
        suffix = np.concatenate([g[2] for g in grams])[first]
        ctx = np.unique(ctx_of)
        ctx_at = np.searchsorted(ctx, ctx_of)
        lower = previous[np.searchsorted(previous_keys, suffix)] if m > 1 else np.repeat(previous, len(keys), 0)
        count, total, kinds = (np.zeros((n, len(langs))) for n in (len(keys), len(ctx), len(ctx)))
        for k, (gram, c, _, n) in enumerate(grams):
            count[np.searchsorted(keys, gram), k] = n
            j = np.searchsorted(ctx, c)
            total[:, k] = np.bincount(j, n, len(ctx))
            kinds[:, k] = np.bincount(j, minlength=len(ctx))
        weight = np.where(total > 0, discount * kinds / np.maximum(total, 1), 1.0)
        direct = np.where(total[ctx_at] > 0, np.maximum(count - discount, 0) / np.maximum(total[ctx_at], 1), 0.0)
        probs = direct + weight[ctx_at] * lower
        model.hashes.append(keys)
        model.logp.append(np.log(np.maximum(probs, 1e-30)).astype(np.float32))
        model.ctx[m - 1] = ctx
        model.log_weight[m - 1] = np.log(np.maximum(weight, 1e-30)).astype(np.float32)
        previous, previous_keys = probs, keys
    return model


def cross_entropies(model: Model, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(nats per character [texts, languages], characters). Long texts run through
    in chunks; every character counts."""
    sums = np.zeros((len(texts), len(model.languages)))
    sizes = np.zeros(len(texts), np.int64)
    pad = np.full(model.order, SPACE, np.uint32)
    held: list[tuple[int, np.ndarray]] = []
    waiting = 0

    def flush() -> None:
        nonlocal waiting
        if not held:
            return
        codes = np.concatenate([c for _, c in held])
        lengths = np.array([len(c) for _, c in held])
        starts = np.cumsum(lengths) - lengths
        inside = np.ones(len(codes), bool)
        for k in range(model.order):
            inside[starts + k] = False
        at = np.flatnonzero(inside)
        probs = model.log_probs(gram_hashes(codes, model.order), at)
        counts = lengths - model.order
        cut = np.cumsum(counts) - counts
        np.add.at(sums, [i for i, _ in held], np.add.reduceat(probs, cut, axis=0, dtype=np.float64))
        held.clear()
        waiting = 0

    for i, t in enumerate(texts):
        codes = char_codes(t) if t else pad[:0]
        sizes[i] = len(codes)
        for lo in range(0, len(codes), CHUNK):
            before = codes[lo - model.order:lo] if lo else pad
            held.append((i, np.concatenate([before, codes[lo:lo + CHUNK]])))
            waiting += len(held[-1][1])
            if waiting >= CHUNK:
                flush()
    flush()
    return -sums / np.maximum(sizes, 1)[:, None], sizes


def calibrate(model: Model, texts: dict[str, list[str]]) -> None:
    """Per language the mean cross-entropy of right texts, the spread of a single
    character's, and how many spreads (by root of length) the worst text reached."""
    n = len(model.languages)
    model.mean, model.spread, model.reach = np.full(n, np.inf), np.ones(n), np.full(n, 6.0)
    for k, lang in enumerate(model.languages):
        ce, sizes = cross_entropies(model, texts.get(lang) or [])
        ok = sizes >= 20
        if ok.sum() >= 5:
            x, size = ce[ok, k], sizes[ok]
            model.mean[k] = np.median(x)
            scaled = (x - model.mean[k]) * np.sqrt(size)
            model.spread[k] = max(1.4826 * np.median(np.abs(scaled)), 0.5)
            model.reach[k] = max(6.0, 1.5 * scaled.max() / model.spread[k])


def fit(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
        order: int = ORDER, train_docs: int = TRAIN_DOCS, train_chars: int = TRAIN_CHARS) -> Model:
    """Fit on a bounded sample: per language about ``train_docs`` whole documents
    of at most ``train_chars`` characters, drawn by a hash of the id from the
    labelled documents outside the held-out fifth. One in five calibrates."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where(
        F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull()
        & ~T.held_out("doc_id") & (F.length("text") <= train_chars))
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not sizes:
        return train({})
    rate = F.create_map(*[x for k, v in sizes.items() for x in (F.lit(k), F.lit(min(1.0, train_docs / v)))])
    drawn = rows.where(T.sample_rank("doc_id") < rate[F.col("lang")]).select("doc_id", "lang", "text").collect()
    parts: dict[bool, dict[str, list[str]]] = {True: {}, False: {}}
    for i, r in enumerate(sorted(drawn, key=lambda r: (r["lang"], r["doc_id"], r["text"]))):
        parts[i % 5 == 4].setdefault(r["lang"], []).append(r["text"])
    model = train(parts[False] or parts[True], order)
    calibrate(model, parts[True])
    return model


def judge(model: Model, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """(language, score, cross-entropy, rejected) of every text."""
    if not model.languages:
        n = len(texts)
        return ["und"] * n, np.zeros(n), np.zeros(n), np.array([not (t and len(char_codes(t))) for t in texts], bool)
    ce, sizes = cross_entropies(model, texts)
    best = ce.argmin(1)
    lowest = ce[np.arange(len(ce)), best]
    odds = np.exp(-(ce - lowest[:, None]) * np.minimum(sizes, EVIDENCE)[:, None])
    score = np.where(sizes > 0, 1 / odds.sum(1), 0.0)
    empty = sizes == 0
    mean = np.where(np.isfinite(model.mean), model.mean, np.inf)[best] if model.mean is not None else np.full(len(ce), np.inf)
    spread = (model.reach * model.spread)[best] if model.mean is not None else 0.0
    limit = mean + spread / np.sqrt(np.maximum(sizes, 1)) + MARGIN
    return ["und" if e else model.languages[b] for b, e in zip(best, empty, strict=True)], score, np.where(empty, 0.0, lowest), empty | (lowest > limit)


def identify(docs: DataFrame, model: Model, *, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` (all columns by default) and lang_pred, score, cross_entropy,
    rejected of every row; a kept column of one of these names is replaced.

    * null, empty or letter-less text: ``und``, score 0, rejected;
    * no labelled row to learn from: ``und`` for all, score 0, kept;
    * ties: the alphabetically first language;
    * every character of a text counts, however long; rows are independent, so
      repeated rows get equal results and an empty table gives none.
    """
    spark = docs.sparkSession
    ship_package(spark)
    new = ["lang_pred", "score", "cross_entropy", "rejected"]
    keep = [c for c in (docs.columns if keep is None else keep) if c not in new]
    shared = spark.sparkContext.broadcast(model)  # bounded by the training sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for lo in range(0, batch.num_rows, T.BATCH_ROWS):
                part = batch.slice(lo, T.BATCH_ROWS)
                lang, score, ce, rejected = judge(m, part.column(part.num_columns - 1).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [part.column(i) for i in range(len(keep))]
                    + [pa.array(lang, pa.string()), pa.array(np.round(score, 6)), pa.array(np.round(ce, 6)), pa.array(rejected)],
                    names=T.plain_names(len(keep)) + new)

    picked = docs.select(*[F.col(f"`{c}`").alias(k) for c, k in zip(keep, T.plain_names(len(keep)), strict=True)], F.col(text_col).alias("_gf_text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema.fields[:-1])
    outputs = "lang_pred string, score double, cross_entropy double, rejected boolean"
    return picked.mapInArrow(run, f"{fields}, {outputs}" if fields else outputs).toDF(*keep, *new)
