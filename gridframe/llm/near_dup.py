"""Near-duplicates by BagMinHash signatures of word shingles.

A document is a multiset of word shingles. BagMinHash sees each shingle of
multiplicity w as the unit levels 0..w of a discretised weight axis. Dyadic
stretches of the axis, (0,1], (1,2], (2,4], (4,8] ..., carry one Poisson process
each: its points come at exponential times, fall on a random register and, by
further halvings, on one unit level. A point counts if its level is below w.
Every register keeps its earliest point. Two documents agree on a register with
the probability of their weighted Jaccard similarity, whatever the weights, and
points after the time by which all registers are taken are never made.

Signatures are banded. Exact copies are first collapsed to one document. The
members of a bucket are resolved by pivots. A pivot is compared with every other
member by the exact overlap of the shingle multisets:

* a member of similarity s or more is linked, one of 2s - 1 or more is *near*, any
  other *far*. Jaccard distance is a metric, so a far member cannot be linked to
  one that is linked to the pivot.
* Near members are known by their differences from the pivot (the shingles they
  lack or add). Two of them overlap by what their sizes say plus the differences
  they share, so a link between them needs either small differences, when the
  member with the least one is linked to both, or a number of shared differences:
  an equi-join on the rarest of them (prefix filter) finds all such pairs, and
  each is verified. Copies of one text share few differences, so large groups of
  near copies are not compared pair by pair. Where many members share one difference,
  they are not paired but become a bucket of their own, with pivots that have this
  difference too, so that it tells nothing there.

The pivot and the members linked to it leave the bucket; a bucket without far
members is done, another goes on with pivots from the far ones. So every pair of a bucket is
verified, excluded or of one class in the end. Classes are connected components.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridframe.llm import text as T
from gridframe.llm.components import components
from gridframe.session import ship_package

SHINGLE = 5
SIMILARITY = 0.8
BANDS = 32
ROWS = 6
#: so many ids of a round's documents are sent to all tasks; more are shuffled
BROADCAST_IDS = 500_000
#: members that share one copy of their pivot's shingles
PIVOT_MEMBERS = 1000
#: so few fresh members of a bucket are all pivots
FEW_FRESH = 16
#: so many times more pivots in each round
PIVOT_GROWTH = 8
#: so many near members that share a difference are paired; more are a bucket of their own
SHARERS = 256
#: rounds that make such buckets; later ones pair all, so that the rounds end
SPLIT_ROUNDS = 12
#: classes are brought up to date when the links have grown by this share
CLASS_SHARE = 0.1
#: parts that the copies of one text are dealt into when they learn their representative
COPY_SALTS = 64


def shingles(flat: np.ndarray, offsets: np.ndarray, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (document, shingle hash, multiplicity), sorted. A document of 1 to
    n - 1 words has one shingle, all its words."""
    h, doc, _ = T.word_grams(flat, offsets, n)
    lengths = np.diff(offsets)
    for m in range(1, n):
        short = np.flatnonzero(lengths == m)
        if len(short):
            at = offsets[:-1][short][:, None] + np.arange(m)
            hs, _, _ = T.word_grams(flat[at].reshape(-1), np.arange(len(short) + 1) * m, m)
            h, doc = np.concatenate([h, hs]), np.concatenate([doc, short])
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    first = np.ones(len(h), bool)
    first[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(first)
    return doc[at], h[at], np.diff(np.concatenate([at, [len(h)]]))


def signatures(doc: np.ndarray, shingle: np.ndarray, weight: np.ndarray, n_docs: int, registers: int) -> np.ndarray:
    """[n_docs, registers] identities of each register's earliest point (0 for a
    document without shingles)."""
    total = np.bincount(doc, weight, n_docs)
    sign = np.zeros((n_docs, registers), np.uint64)
    horizon = (np.log(registers) + 5) / np.maximum(total, 1)  # nearly always all registers are taken by then
    todo = total > 0
    while todo.any():
        pick = np.flatnonzero(todo[doc])
        number = np.cumsum(todo) - 1
        best, mark = _points(number[doc[pick]], shingle[pick], weight[pick], int(todo.sum()), registers, horizon[todo])
        full = np.isfinite(best).all(1)
        done = np.flatnonzero(todo)[full]
        sign[done] = mark[full]
        todo[done] = False
        horizon *= 2  # the rare documents with a free register start again and go further
    return sign


def _points(doc, shingle, weight, n_docs: int, registers: int, horizon):
    """Earliest time and identity per document and register, of points up to the horizon."""
    count = np.ceil(np.log2(np.maximum(weight, 1))).astype(np.int64) + 1  # dyadic stretches up to the weight
    element = np.repeat(np.arange(len(shingle)), count)
    stretch = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    begin = np.where(stretch == 0, 0, 1 << np.maximum(stretch - 1, 0))
    size = np.where(stretch == 0, 1, begin)
    owner, limit = doc[element], weight[element] - begin  # unit levels of the stretch below the weight
    best = np.full(n_docs * registers, np.inf)
    sign = np.zeros(n_docs * registers, np.uint64)
    with np.errstate(over="ignore"):
        key = T.mix64(shingle[element].view(np.uint64) + T.mix64(stretch.astype(np.uint64) + np.uint64(1)))
    time, live = np.zeros(len(key)), np.arange(len(key))
    while len(live):
        with np.errstate(over="ignore"):
            key = T.mix64(key + np.uint64(0x9E3779B97F4A7C15))
        time = time - np.log(((key >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0 ** 53) / (registers * size[live])
        early = time <= horizon[owner[live]]
        live, key, time = live[early], key[early], time[early]
        _place(best, sign, key, time, live, owner, limit, size, registers)
    return best.reshape(n_docs, registers), sign.reshape(n_docs, registers)


def _place(best, sign, key, time, live, owner, limit, size, registers) -> None:
    """Enter the points that fall on a unit level below the weight."""
    if not len(live):
        return
    mark = T.mix64(key ^ np.uint64(0xD1B54A32D192ED03))
    level = ((mark >> np.uint64(40)).astype(np.int64)) & (size[live] - 1)  # the halvings, by bits
    ok = level < limit[live]
    slot = owner[live][ok] * registers + ((mark[ok] & np.uint64(0xFFFFFFFF)) % np.uint64(registers)).astype(np.int64)
    time, mark = time[ok], mark[ok]
    order = np.lexsort((mark, time, slot))
    slot, time, mark = slot[order], time[order], mark[order]
    first = np.ones(len(slot), bool)
    first[1:] = slot[1:] != slot[:-1]
    slot, time, mark = slot[first], time[first], mark[first]
    better = time < best[slot]
    best[slot[better]] = time[better]
    sign[slot[better]] = mark[better]


def band_hashes(sign: np.ndarray, bands: int, rows: int) -> np.ndarray:
    out = np.empty((len(sign), bands), np.uint64)
    with np.errstate(over="ignore"):
        for b in range(bands):
            h = np.full(len(sign), np.uint64(b + 1), np.uint64)
            for r in range(rows):
                h = T.mix64(h * np.uint64(0x9E3779B97F4A7C15) + sign[:, b * rows + r])
            out[:, b] = h
    return out.view(np.int64)


def _sign(bands: int, rows: int, n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, T.BATCH_ROWS):
                part = batch.slice(lo, T.BATCH_ROWS)
                flat, offsets = T.list_parts(part.column(3))
                full = np.diff(offsets) > 0
                sign = signatures(*shingles(flat, offsets, n), len(full), bands * rows)
                hashes = band_hashes(sign, bands, rows)[full].reshape(-1)
                ends = np.concatenate([[0], np.cumsum(np.where(full, bands, 0))])
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), T.list_array(hashes, ends)],
                                                 names=["doc_id", "k1", "k2", "bands"])

    return run


def _units(n: int):
    """Shingle multisets as sets: every occurrence hashed with its number."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, T.BATCH_ROWS):
                part = batch.slice(lo, T.BATCH_ROWS)
                flat, offsets = T.list_parts(part.column(1))
                doc, h, weight = shingles(flat, offsets, n)
                number = np.arange(weight.sum()) - np.repeat(np.cumsum(weight) - weight, weight)
                with np.errstate(over="ignore"):
                    unit = T.mix64(np.repeat(h, weight).view(np.uint64) + number.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
                sizes = np.bincount(doc, weight, part.num_rows).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), T.list_array(unit.view(np.int64), np.concatenate([[0], np.cumsum(sizes)]))], names=["doc_id", "units"])

    return run


def _some_units(units: DataFrame, wanted: DataFrame) -> DataFrame:
    wanted = T.reliable(wanted.distinct())
    return units.join(F.broadcast(wanted) if wanted.count() <= BROADCAST_IDS else wanted, "doc_id", "left_semi")


def _compared(pairs: DataFrame, units: DataFrame, similarity: float) -> DataFrame:
    """(pivot, m, linked, near, size, least, delta) of every pair (pivot, m): ``size``
    units of the pivot, ``delta`` the units that only one of the two has, if near, and
    ``least`` the share of units that a partner must make up for.

    A pivot with many members is repeated, so that they are spread over tasks."""
    many = pairs.groupBy("pivot").agg(F.ceil(F.count("*") / F.lit(PIVOT_MEMBERS)).cast("int").alias("salts"))
    some = _some_units(units, pairs.select(F.col("pivot").alias("doc_id")).union(pairs.select("m")))
    pivots = many.join(some.select(F.col("doc_id").alias("pivot"), F.col("units").alias("up")).hint("merge"), "pivot").select(
        "pivot", "up", "salts", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    members = pairs.join(some.select(F.col("doc_id").alias("m"), F.col("units").alias("um")).hint("merge"), "m").join(many.hint("merge"), "pivot").withColumn(
        "salt", F.pmod(F.xxhash64("m"), F.col("salts")).cast("int")).drop("salts")
    both = members.join(pivots.drop("salts").hint("merge"), ["pivot", "salt"])
    shared = F.size(F.array_intersect("up", "um"))
    size, own = F.size("up"), F.size("um")
    joint = both.select("pivot", "m", "up", "um", shared.alias("shared"), size.alias("size"), own.alias("own"),
                        (size + own - shared).alias("union"))
    near = F.col("shared") >= F.lit(2 * similarity - 1) * F.col("union")
    delta = F.concat(F.array_except("up", "um"), F.array_except("um", "up"))
    return joint.select(
        "pivot", "m", (F.col("shared") >= F.lit(similarity) * F.col("union")).alias("linked"), near.alias("near"), "size",
        # a link needs an overlap of s / (1 + s) of both sizes: this and the partner's ``least`` less the pivot's size
        # is how many differences they must share
        (F.lit(similarity / (1 + similarity)) * F.col("own") + F.col("size") - F.col("shared")).alias("least"),
        F.when(near, delta).alias("delta"))


def _prefixes(near: DataFrame, classes: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """Links (a, b) that the least differences of each pivot's near members tell, and
    (pivot, m, node, linked, least, size, unit, probing, indexed, rest) of the units of
    which a partner of m must share one: ``probing`` for partners of any kind, if m is
    not linked itself, ``indexed`` for those that are not linked. ``rest`` counts the
    shared units of m from this one on."""
    own = F.when(F.col("linked"), F.col("pivot")).otherwise(F.col("m"))
    rows = near.withColumn("node", own)
    if classes is not None:
        rows = rows.join(classes.hint("merge"), "node", "left").withColumn("node", F.coalesce("component", "node")).drop("component")
    # pivots all of whose near members are linked have nothing more to find
    best = near.groupBy("pivot").agg(F.min(F.struct("least", "m")).alias("top"), F.min(F.when(~F.col("linked"), F.col("least"))).alias("low"))
    rows = rows.join(best.where("low IS NOT NULL").hint("merge"), "pivot")
    spare = F.col("size") + F.lit(1e-6)  # rounding may only add candidates
    by_size = rows.where((F.col("least") + F.col("top.least") <= F.col("size") - F.lit(1e-6)) & (F.col("m") != F.col("top.m"))).select(
        F.col("m").alias("a"), F.col("top.m").alias("b"))
    # who has fewer differences than the easiest partner asks for has no partner
    partner = F.when(F.col("linked"), F.col("low")).otherwise(F.col("top.least"))
    able = rows.where(F.col("least") + partner - spare <= F.size("delta"))
    units = able.select("pivot", "m", "linked", "node", "least", "size", "top", "low", F.explode("delta").alias("unit"))
    units = units.join(units.groupBy("pivot", "unit").agg(F.count("*").alias("n")).where("n > 1").hint("merge"), ["pivot", "unit"])
    rare = F.transform(F.sort_array(F.collect_list(F.struct("n", "unit"))), lambda x: x["unit"])

    def length(partner: F.Column) -> F.Column:
        """All units but the most common ones that a partner could share anyway. A unit
        that no other member has counts as rarer."""
        need = F.greatest(F.ceil(F.col("least") + partner - spare), F.lit(1))
        return F.greatest(F.size("order") - need.cast("int") + 1, F.lit(0))

    probe = F.when(F.col("linked"), F.lit(0)).otherwise(length(F.col("top.least")))
    ordered = units.groupBy("pivot", "m", "node", "linked", "least", "size", "top", "low").agg(rare.alias("order")).select(
        "pivot", "m", "node", "linked", "least", "size", "order", probe.alias("probe"), length(F.col("low")).alias("index"))
    prefix = ordered.select("pivot", "m", "node", "linked", "least", "size", "probe", "index", F.size("order").alias("length"), F.posexplode(
        F.slice("order", F.lit(1), F.greatest("probe", "index"))).alias("pos", "unit"))
    return by_size, prefix.select("pivot", "m", "node", "linked", "least", "size", "unit", (F.col("pos") < F.col("probe")).alias("probing"),
                                  (F.col("pos") < F.col("index")).alias("indexed"), (F.col("length") - F.col("pos")).alias("rest"))


def _sharers(prefix: DataFrame) -> DataFrame:
    """(pivot, unit, n, sign) of the units that members of several classes share, ``sign`` by the members."""
    return prefix.groupBy("pivot", "unit").agg(
        F.count("*").alias("n"), F.sum(F.xxhash64("m").cast("decimal(20,0)")).alias("sign"), F.max("probing").alias("any"),
        F.min("node").alias("c0"), F.max("node").alias("c1")).where("any AND c0 < c1").select("pivot", "unit", "n", "sign")


def _split(prefix: DataFrame, sharers: DataFrame, number: int) -> DataFrame:
    """The buckets (bucket, a, mates, age, seen, fresh) of the members that share a unit
    with many; units of the same members make one. Linked members have the pivot in
    common and meet only those that are not linked."""
    many = sharers.where(F.col("n") > SHARERS).groupBy("pivot", "n", "sign").agg(F.min("unit").alias("unit"))
    return prefix.join(many.hint("merge"), ["pivot", "unit"]).select(
        F.xxhash64(F.lit(number), "pivot", "unit").alias("bucket"), F.col("m").alias("a"), F.col("n").alias("mates"), F.lit(0).alias("age"),
        F.when(F.col("linked"), F.array("pivot")).otherwise(F.array().cast("array<long>")).alias("seen"), (~F.col("linked")).alias("fresh"))


def _candidates(prefix: DataFrame, sharers: DataFrame) -> DataFrame:
    """Pairs (pivot, a, b) of near members that share a unit of the prefix and have
    units enough from there on, unless one class joins them already.

    All members of a pivot order their units alike, so a pair has all it shares from its
    first common unit on: a link passes there, if at none of the later ones."""
    some = prefix.join(sharers.select("pivot", "unit").hint("merge"), ["pivot", "unit"])
    probe = some.where("probing").select("pivot", "unit", F.col("m").alias("a"), F.col("node").alias("na"), F.col("least").alias("la"),
                                         F.col("rest").alias("ra"), "size")
    index = some.where("indexed").select("pivot", "unit", F.col("m").alias("b"), F.col("node").alias("nb"), F.col("least").alias("lb"),
                                         F.col("rest").alias("rb"), "linked")
    enough = F.least("ra", "rb") >= F.col("la") + F.col("lb") - F.col("size") - F.lit(1e-6)
    # two members that are not linked find each other from either side
    return probe.join(index.hint("merge"), ["pivot", "unit"]).where(F.expr("na <> nb AND (linked OR a < b)") & enough).select("pivot", "a", "b").distinct()


def _near_links(near: DataFrame, prefix: DataFrame, sharers: DataFrame) -> DataFrame:
    """Links (a, b) among the near members of each pivot that share a unit of the
    prefix, unless one class joins them already."""
    spare = F.col("size") + F.lit(1e-6)
    pairs = _candidates(prefix, sharers)
    known = near.select("pivot", "m", "delta", "least", "size")
    one = known.select("pivot", F.col("m").alias("a"), F.col("delta").alias("da"), F.col("least").alias("la"), "size")
    two = known.select("pivot", F.col("m").alias("b"), F.col("delta").alias("db"), F.col("least").alias("lb"))
    good = pairs.join(one.hint("merge"), ["pivot", "a"]).join(two.hint("merge"), ["pivot", "b"]).where(
        F.size(F.array_intersect("da", "db")) >= F.col("la") + F.col("lb") - spare)
    return good.select("a", "b")


def _with_pivots(left: DataFrame, classes: DataFrame | None, number: int) -> DataFrame:
    """(bucket, pivot, m, mates, age, seen, drawn) of the buckets with members of several classes.

    Pivots are drawn from the fresh members: the one with the most bucket mates, from
    a bucket's second round on about ``PIVOT_GROWTH ** (age - 1)`` others as well, by a
    hash of the id."""
    if classes is not None:
        left = left.join(classes.withColumnRenamed("node", "a").hint("merge"), "a", "left").withColumn("c", F.coalesce("component", "a"))
    else:
        left = left.withColumn("c", F.col("a"))
    top = F.max(F.when(F.col("fresh"), F.struct("mates", (-F.col("a")).alias("minus"))))
    whole = left.groupBy("bucket").agg(F.count(F.when(F.col("fresh"), 1)).alias("n"), top.alias("top"),
                                       F.min("c").alias("c0"), F.max("c").alias("c1")).where("c0 < c1 AND n > 0")
    rows = left.join(whole.select("bucket", "n", (-F.col("top.minus")).alias("first")).hint("merge"), "bucket")
    if number < 1:  # one pivot a bucket: no join of the members with themselves
        return rows.where("a <> first").select("bucket", F.col("first").alias("pivot"), F.col("a").alias("m"), "mates", "age", "seen", F.lit(False).alias("drawn"))
    more = T.sample_rank("a") * F.col("n") < F.pow(F.lit(float(PIVOT_GROWTH)), F.col("age") - 1)
    drawn = F.col("fresh") & (F.col("age") > 0) & (more | (F.col("n") <= FEW_FRESH))
    rows = rows.withColumn("drawn", (F.col("a") == F.col("first")) | drawn)
    pivots = rows.where("drawn").select("bucket", F.col("a").alias("pivot"))
    return rows.join(pivots.hint("merge"), "bucket").where("a <> pivot").select("bucket", "pivot", F.col("a").alias("m"), "mates", "age", "seen", "drawn")


def _unresolved(marked: DataFrame, compared: DataFrame) -> DataFrame:
    """(bucket, a, mates, age, seen, fresh) of what a round leaves: members that are neither
    pivots nor linked to one. ``seen`` are the pivots, of all rounds, that a member is
    near to; near members of one pivot are resolved among themselves, so a bucket is
    done if one pivot was near to all, and otherwise the members far from the pivot
    that was near to most are fresh."""
    result = marked.join(compared.select("pivot", "m", "linked", "near").hint("merge"), ["pivot", "m"])
    members = result.groupBy("bucket", "m").agg(F.max(F.col("linked") | F.col("drawn")).alias("gone"), F.first("mates").alias("mates"), (F.first("age") + 1).alias("age"), F.first("seen").alias("seen"),
                                                F.collect_list(F.when(F.col("near"), F.col("pivot"))).alias("new"))
    rest = members.where("not gone").select(
        "bucket", "m", "mates", "age", F.concat("seen", "new").alias("seen"))
    cover = rest.select("bucket", F.explode_outer("seen").alias("by")).groupBy("bucket", "by").agg(F.count("by").alias("n"))
    best = cover.groupBy("bucket").agg(F.max(F.struct("n", "by")).alias("best"))
    size = rest.groupBy("bucket").agg(F.count("*").alias("size"))
    more = size.join(best.hint("merge"), "bucket").where("best.n < size").select("bucket", "best.by")
    return rest.join(more.hint("merge"), "bucket").select(
        "bucket", F.col("m").alias("a"), "mates", "age", "seen", (~F.coalesce(F.array_contains("seen", F.col("by")), F.lit(False))).alias("fresh"))


def _classes(links: list[DataFrame]) -> DataFrame:
    """(node, component) of the classes that all links make."""
    return components(reduce(DataFrame.union, links).select(F.col("a").alias("u"), F.col("b").alias("v")))


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY,
                    shingle: int = SHINGLE, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, class_id, representative) of every row; ``class_id`` is the least id
    of the class and ``representative`` marks the one id that stays.

    * null ids take no part and give no row;
    * null texts, and texts without a word that have no exact copy, are classes
      of their own;
    * exact copies (equal texts, the empty one too) are one class;
    * repeated rows and ties: rows of one id and text share a row's result; an id
      with several texts belongs to the class of its least text hash;
    * very long texts: all shingles count; an empty table gives no rows.
    """
    ship_package(docs.sparkSession)
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where(F.col("doc_id").isNotNull())
    keyed = base.select("doc_id", F.xxhash64("text").alias("k1"), F.xxhash64(F.lit(1), "text").alias("k2"), "text").where(F.col("text").isNotNull())
    signed = keyed.select("doc_id", "k1", "k2", T.word_hashes("text").alias("words")).mapInArrow(
        _sign(bands, rows, shingle), "doc_id long, k1 long, k2 long, bands array<long>")
    signed = T.stored(signed, "near-signed")
    ids = signed.groupBy("doc_id").agg(F.min(F.struct("k1", "k2")).alias("k")).select("doc_id", "k.k1", "k.k2")
    # the answer goes back to the copies through salted keys: a text may have very many
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(COPY_SALTS))
    salted = ids.withColumn("salt", salt)
    firsts = salted.groupBy("k1", "k2", "salt").agg(F.min("doc_id").alias("low"))
    lows = firsts.groupBy("k1", "k2").agg(F.min("low").alias("rep"), F.collect_list("salt").alias("salts")).select(
        "k1", "k2", "rep", F.explode("salts").alias("salt"))
    member_of = T.stored(salted.join(lows, ["k1", "k2", "salt"]).select("doc_id", "k1", "k2", "rep"), "near-members")
    reps = member_of.where("doc_id = rep").drop("rep")
    banded = signed.join(reps, ["doc_id", "k1", "k2"], "left_semi").dropDuplicates(["doc_id", "k1", "k2"]).select(
        F.col("doc_id").alias("a"), F.explode("bands").alias("bucket"))
    shared = banded.groupBy("bucket").count().where("count > 1")
    kept = T.stored(banded.join(shared, "bucket").select("bucket", "a", "count"), "near-buckets")
    mates = kept.groupBy("a").agg(F.sum("count").alias("mates"))
    left = T.stored(kept.join(mates, "a").select("bucket", "a", "mates", F.lit(0).alias("age"), F.array().cast("array<long>").alias("seen"), F.lit(True).alias("fresh")), "near-left")
    T.discard(kept, signed)
    one_row = ["doc_id", "k1", "k2"]
    wanted = reps.join(left.select(F.col("a").alias("doc_id")).distinct(), "doc_id", "left_semi")
    units = T.stored(keyed.join(wanted, one_row, "left_semi").dropDuplicates(one_row).select(
        "doc_id", T.word_hashes("text").alias("words")).mapInArrow(_units(shingle), "doc_id long, units array<long>"), "near-units")
    found, classes, number, n_links, n_known = [], None, 0, 0, 0
    while True:
        marked = T.stored(_with_pivots(left, classes, number), "near-marked")
        if marked.isEmpty():
            break
        compared = T.stored(_compared(marked.select("pivot", "m").distinct(), units, similarity), "near-compared")
        near = compared.where("near").drop("near")
        by_size, prefix = _prefixes(near, classes)
        prefix = T.stored(prefix, "near-prefix")
        sharers = _sharers(prefix)
        after = _unresolved(marked, compared)
        if number < SPLIT_ROUNDS:
            after = after.union(_split(prefix, sharers, number))
            sharers = sharers.where(F.col("n") <= SHARERS)
        links = T.stored(compared.where("linked").select(F.col("pivot").alias("a"), F.col("m").alias("b")).union(by_size).union(
            _near_links(near, prefix, sharers)), "near-links")
        after = T.stored(after, "near-left")
        T.discard(left, marked, compared, prefix)
        left, number = after, number + 1
        new = links.count()
        if new:
            found.append(links)
            n_links += new
        if n_links - n_known > CLASS_SHARE * n_known:
            before, classes, n_known = classes, T.stored(_classes(found), "near-classes"), n_links
            T.discard(before)
    if n_known < n_links:
        before, classes = classes, T.stored(_classes(found), "near-classes")
        T.discard(before)
    T.discard(left, marked, units, *found)
    final = member_of.select("doc_id", "rep")
    if classes is not None:
        final = final.join(classes, final.rep == classes.node, "left").select("doc_id", F.coalesce("component", "rep").alias("class_id"))
    else:
        final = final.select("doc_id", F.col("rep").alias("class_id"))
    lone = base.where(F.col("text").isNull()).select("doc_id").distinct().join(member_of, "doc_id", "left_anti").select(
        "doc_id", F.col("doc_id").alias("class_id"))
    return final.union(lone).withColumn("representative", F.col("doc_id") == F.col("class_id"))
