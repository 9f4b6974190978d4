"""Problem 4: records of evaluation splits that training records repeat, exactly or almost.

Weighted cosine join of two sets of term-weight vectors. Terms have one order, from those that few pairs of records
share to those that many do. A vector enters the inverted lists with its first terms only: what is left behind them
has too small a norm to reach the asked cosine (residual norm), or meets too small weights on the other side for it
(maximum weight of each list). Two vectors that reach the cosine share one of these terms, so the lists are sent to
tasks by term, lists of many records in several parts. There each pair that meets is bounded by the product of the
norms of its parts (Cauchy and Schwarz on groups of terms), and exact dot products settle what the bound lets through.

Messages overlap if c of their n and m words, counted with repeats, are common and c / (n + m - c) >= s. The k-th use
of a word is a term of its own, all of one weight, 1/sqrt(n). Then c >= s/(1+s) * (n + m), so the dot product is
2s/(1+s) at least: 14/17 for s = 7/10. The counts of the pairs found decide.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut, drop_cut, scratch, workers_import

_ENTITY = r"&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});"
_LINK = r"(?i)\b(?:https?://|www\.)\S+"
_HANDLE = r"[@＠#＃][\p{L}\p{M}\p{N}_]+"


def words(text: Column) -> Column:
    """The words of a message without case, punctuation, links, @-names, #-tags and HTML entities; null gives none.

    Apostrophes inside words are left out, other marks separate. A word is a run of letters, marks and digits. Texts
    without the signs of a link, an entity or a name don't meet its pattern, and ASCII texts meet a shorter one.
    """
    x = F.coalesce(text, F.lit(""))
    x = F.when(x.contains("://") | F.lower(x).contains("www."), F.regexp_replace(x, _LINK, " ")).otherwise(x)
    x = F.when(x.contains("&"), F.regexp_replace(x, _ENTITY, " ")).otherwise(x)
    x = F.when(x.rlike("[@＠#＃]"), F.regexp_replace(x, _HANDLE, " ")).otherwise(x)
    plain = F.length(text) == F.octet_length(text)
    ws = F.when(plain, F.split(F.lower(F.translate(x, "'", "")), "[^a-z0-9]+")).otherwise(
        F.split(F.lower(F.regexp_replace(x, r"[\p{Cf}'’‘ʼ]", "")), r"[^\p{L}\p{M}\p{N}]+")
    )
    return F.filter(ws, lambda w: w != "")


#: Cells of the table of term statistics, a fixed size whatever the number of terms: terms share cells by their hash,
#: which only loosens the bounds. It is collected and sent to the tasks (16 bytes a cell).
CELLS = 1 << 18
#: Parts of a vector whose norms bound a dot product.
PARTS = 128
#: Records of each side in one part of a list or group; together they bound a task's memory.
EVAL_BLOCK, TRAIN_BLOCK = 40_000, 80_000
#: List entries a group of lists should hold.
GROUP = 4_000_000

_VECTOR = "id bigint, terms array<bigint>, weights array<double>"


def _mixed(x: np.ndarray) -> np.ndarray:
    """Well spread bits of 64-bit numbers."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(values, sizes, row of each value) of a list column without nulls."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    return column.flatten().to_numpy(zero_copy_only=False), sizes, np.repeat(np.arange(len(sizes)), sizes)


def _starts(sizes: np.ndarray) -> np.ndarray:
    return np.cumsum(sizes) - sizes


def unit_vectors(bags: DataFrame) -> DataFrame:
    """(id, terms, weights) from (id, words array<bigint>, sorted hashes of words): each use of a word is a term, all weigh the same."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, sizes, rows = _flat(batch.column(1))
            at = np.arange(len(values))
            new = np.ones(len(values), bool)
            new[1:] = (values[1:] != values[:-1]) | (rows[1:] != rows[:-1])
            use = at - np.maximum.accumulate(np.where(new, at, 0))
            terms = _mixed(values.view(np.uint64) + use.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)
            offsets = pa.array(np.append(_starts(sizes), len(values)).astype(np.int32))
            weights = np.repeat(1.0 / np.sqrt(np.maximum(sizes, 1)), sizes)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, pa.array(terms)), pa.ListArray.from_arrays(offsets, pa.array(weights))], names=["id", "terms", "weights"])

    workers_import(bags.sparkSession)
    return bags.select("id", "words").mapInArrow(run, _VECTOR)


def _cells(vectors: DataFrame) -> DataFrame:
    """(cell, n, top): in each cell the entries of the vectors and their largest weight, combined in the tasks."""
    entries = vectors.select(F.explode(F.arrays_zip("terms", "weights")).alias("x"))
    cell = F.pmod(F.col("x.terms"), F.lit(CELLS)).cast("int")
    return entries.groupBy(cell.alias("cell")).agg(F.count("*").alias("n"), F.max("x.weights").alias("top"))


def _statistics(left: DataFrame, right: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Entries and largest weights of both sides by cell: two tables of 2 x CELLS numbers."""
    n, top = np.zeros((2, CELLS), np.int64), np.zeros((2, CELLS), np.float32)
    for side, vectors in enumerate((left, right)):
        t = _cells(vectors).toArrow()  # at most CELLS rows
        cell = t.column("cell").to_numpy()
        n[side, cell] = t.column("n").to_numpy()
        # rounded up, as a bound
        top[side, cell] = np.nextafter(t.column("top").to_numpy().astype(np.float32), np.float32(np.inf))
    return n, top


def _entries(vectors: DataFrame, side: int, shared, least: float) -> DataFrame:  # noqa: ANN001
    """(id, norms, terms): the first terms of each vector, by which it enters the lists, and the norms of its parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, top = shared.value
        pairs = n[0].astype(np.float64) * n[1]
        for batch in batches:
            terms, sizes, rows = _flat(batch.column(1))
            if not len(terms):
                continue
            weights = batch.column(2).flatten().to_numpy(zero_copy_only=False)
            order = np.lexsort((terms, pairs[terms % CELLS], rows))
            w, term = weights[order], terms[order]
            some, begin = sizes[sizes > 0], _starts(sizes)[sizes > 0]

            def before(x: np.ndarray, some: np.ndarray = some, begin: np.ndarray = begin) -> np.ndarray:
                upto = np.cumsum(x) - x
                return upto - np.repeat(upto[begin], some)

            # what an entry and all behind it can still give, by their norm and by the other side's largest weights
            product = w * top[1 - side][term % CELLS]
            whole = np.repeat(np.bincount(rows, product, len(sizes)), sizes)
            met = (1.0 - before(w * w) >= least * least - 1e-9) & (whole - before(product) >= least - 1e-9) & (pairs[term % CELLS] > 0)
            part = rows * PARTS + (_mixed(terms.view(np.uint64)) % np.uint64(PARTS)).astype(np.int64)
            norms = np.sqrt(np.bincount(part, weights * weights, len(sizes) * PARTS))
            # whole numbers of 1/255, rounded up as a bound
            norms = np.minimum(255, np.ceil(norms * 255 - 1e-6)).astype(np.uint8).reshape(len(sizes), PARTS)
            many = np.bincount(rows[met], minlength=len(sizes))
            has = many > 0
            offsets = pa.array(np.append(0, np.cumsum(many[has])).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [pa.array(batch.column(0).to_numpy()[has]), pa.array([x.tobytes() for x in norms[has]], pa.binary()), pa.ListArray.from_arrays(offsets, pa.array(term[met]))],
                names=["id", "norms", "terms"],
            )

    return vectors.select("id", "terms", "weights").mapInArrow(run, "id bigint, norms binary, terms array<bigint>")


def _routed(entries: DataFrame, side: int, shared) -> DataFrame:  # noqa: ANN001
    """(place, id, norms, terms): the entries by the task that meets them.

    Short lists share places by their cells. A cell of many records is cut into parts of both sides, and each part of
    one side meets each part of the other in a place of their own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups, blocks, offsets = shared.value
        for batch in batches:
            term, _, row = _flat(batch.column(2))
            ids, norms, cell = batch.column(0).to_numpy(), batch.column(1), term % CELLS
            mine, other = blocks[side][cell], blocks[1 - side][cell]
            cut_up = (mine > 1) | (other > 1)
            part = (_mixed(ids.view(np.uint64))[row] % mine.astype(np.uint64)).astype(np.int64)
            begin = np.where(cut_up, groups + offsets[cell] + part * (other if side == 0 else 1), cell % groups)
            step = np.ones_like(mine) if side == 0 else mine
            again = np.repeat(np.arange(len(row)), other)
            nth = np.arange(len(again)) - np.repeat(_starts(other), other)
            place, row, term = (begin[again] + nth * step[again]), row[again], term[again]
            order = np.lexsort((row, place))
            row, place, term = row[order], place[order], term[order]
            new = np.ones(len(row), bool)
            new[1:] = (row[1:] != row[:-1]) | (place[1:] != place[:-1])
            at = np.flatnonzero(new)
            ends = pa.array(np.append(at, len(row)).astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(place[at]), pa.array(ids[row[at]]), norms.take(pa.array(row[at])), pa.ListArray.from_arrays(ends, pa.array(term))], names=["place", "id", "norms", "terms"])

    return entries.mapInArrow(run, "place bigint, id bigint, norms binary, terms array<bigint>")


def _lists(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(ids, norms, terms that have a list, where their lists begin, records of the lists end to end)."""
    t = t.combine_chunks()
    one = lambda name: t.column(name).chunk(0)
    terms, _, rows = _flat(one("terms"))
    order = np.argsort(terms, kind="stable")
    names, begin = np.unique(terms[order], return_index=True)
    norms = np.frombuffer(b"".join(one("norms").to_pylist()), np.uint8).reshape(-1, PARTS).astype(np.float32)
    return one("id").to_numpy(), norms, names, np.append(begin, len(terms)), rows[order]


def _meet(left: pa.Table, right: pa.Table, least: float) -> pa.Table:
    """Pairs of a place whose bound lets them through; work goes with the pairs that share a list."""
    found: list[np.ndarray] = []
    a_ids = b_ids = np.zeros(0, np.int64)
    if left.num_rows and right.num_rows:
        a_ids, a_norms, a_names, a_begin, a_rows = _lists(left)
        b_ids, b_norms, b_names, b_begin, b_rows = _lists(right)
        _, x, y = np.intersect1d(a_names, b_names, assume_unique=True, return_indices=True)
        bound = np.float32(ceil(255 * 255 * (least - 1e-9) - 0.01) - 0.5)  # whole numbers below 2^24, exact in single precision
        n, m = a_begin[x + 1] - a_begin[x], b_begin[y + 1] - b_begin[y]
        small = n * m <= 64
        # short lists all at once, a slice of pairs at a time
        xs, ys, ns, ms = x[small], y[small], n[small], m[small]
        for part in np.array_split(np.arange(len(xs)), max(1, int((ns * ms).sum()) // 200_000)):
            size = ns[part] * ms[part]
            k = np.repeat(np.arange(len(part)), size)
            at = np.arange(len(k)) - _starts(size)[k]
            i, j = a_rows[a_begin[xs[part]][k] + at // ms[part][k]], b_rows[b_begin[ys[part]][k] + at % ms[part][k]]
            good = np.einsum("ij,ij->i", a_norms[i], b_norms[j]) >= bound
            found.append(i[good] * len(b_ids) + j[good])
        for u, v in zip(x[~small], y[~small], strict=True):
            i, j = a_rows[a_begin[u] : a_begin[u + 1]], b_rows[b_begin[v] : b_begin[v + 1]]
            other = b_norms[j].T
            for c in range(0, len(i), max(1, 2_000_000 // len(j))):
                some = i[c : c + max(1, 2_000_000 // len(j))]
                p, q = np.nonzero(a_norms[some] @ other >= bound)
                found.append(some[p] * len(b_ids) + j[q])
    pairs = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
    m = max(1, len(b_ids))
    return pa.table({"l": pa.array(a_ids[pairs // m], pa.int64()), "r": pa.array(b_ids[pairs % m], pa.int64())})


def _exact(pairs: DataFrame, least: float) -> DataFrame:
    """(l, r, shared, l_terms, r_terms, cosine) of the pairs (l, r, lt, lw, rt, rw) that reach the cosine."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, shared, cosine = [], [], []
            lt, lw, rt, rw = (c.to_numpy(zero_copy_only=False) for c in batch.columns[2:])
            for i in range(batch.num_rows):
                _, p, q = np.intersect1d(lt[i], rt[i], assume_unique=True, return_indices=True)
                dot = float(lw[i][p] @ rw[i][q])
                if dot >= least - 1e-9:
                    keep.append(i)
                    shared.append(len(p))
                    cosine.append(dot)
            kept = batch.take(pa.array(keep, pa.int32()))
            sizes = [kept.column(c).value_lengths() for c in (2, 4)]
            yield pa.RecordBatch.from_arrays([kept.column(0), kept.column(1), pa.array(shared, pa.int32()), *sizes, pa.array(cosine, pa.float64())], names=["l", "r", "shared", "l_terms", "r_terms", "cosine"])

    return pairs.mapInArrow(run, "l bigint, r bigint, shared int, l_terms int, r_terms int, cosine double")


def cosine_join(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """(l, r, shared, l_terms, r_terms, cosine): every pair of vectors of the two sides whose cosine is at least
    `least` > 0, each once, with the number of terms both have and either has.

    Both sides are (id bigint, terms array<bigint>, weights array<double>): unique ids, distinct terms in a vector,
    weights above 0 and vectors of length 1. Vectors without terms and empty tables give no pairs.
    """
    spark = left.sparkSession
    workers_import(spark)
    statistics = spark.sparkContext.broadcast(_statistics(left, right))
    entries = [cut(_entries(v, side, statistics, least)) for side, v in enumerate((left, right))]
    # how long the lists are, by cell again; lists beyond a block are cut up
    n = np.zeros((2, CELLS), np.int64)
    for side, e in enumerate(entries):
        counts = e.select(F.explode("terms").alias("t")).groupBy(F.pmod("t", F.lit(CELLS)).cast("int").alias("cell")).agg(F.count("*").alias("n")).toArrow()  # at most CELLS rows
        n[side, counts.column("cell").to_numpy()] = counts.column("n").to_numpy()
    blocks = np.stack([np.maximum(1, -(-n[0] // EVAL_BLOCK)), np.maximum(1, -(-n[1] // TRAIN_BLOCK))])
    groups = max(2 * spark.sparkContext.defaultParallelism, int(n.sum() // GROUP))
    places = spark.sparkContext.broadcast((groups, blocks, np.cumsum(blocks.prod(0)) - blocks.prod(0)))
    a, b = (_routed(e, side, places) for side, e in enumerate(entries))
    met = a.groupBy("place").cogroup(b.groupBy("place")).applyInArrow(lambda x, y: _meet(x, y, least), "l bigint, r bigint").distinct()
    pairs = (
        met.join(left.select(F.col("id").alias("l"), F.col("terms").alias("lt"), F.col("weights").alias("lw")), "l")
        .join(right.select(F.col("id").alias("r"), F.col("terms").alias("rt"), F.col("weights").alias("rw")), "r")
        .select("l", "r", "lt", "lw", "rt", "rw")
    )
    return _exact(pairs, least)


def overlaps(eval_records: DataFrame, train_records: DataFrame, least: tuple[int, int] = (7, 10)) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(pairs, eval members, train members) from records (split, id, text).

    pairs: (e_cls, t_cls, shared, cosine), one row for every two classes whose common words are at least `least` of
    the words either has; messages of the same words are one class. members: (split, id, cls). Null, empty and
    wordless messages overlap with nothing. Repeated rows count once; empty tables give no pairs.
    """
    num, den = least
    tag = lambda d, s: d.select(F.lit(s).alias("side"), "split", F.col("id").cast("string").alias("id"), "text")
    records = tag(eval_records, "e").unionByName(tag(train_records, "t"))
    w = records.select("side", "split", "id", F.array_sort(F.transform(words(F.col("text")), lambda x: F.xxhash64(x))).alias("words")).where("size(words) > 0")
    # 128 bits of its words name a class
    named = cut(w.select("*", F.xxhash64("words").alias("b1"), F.xxhash64(F.lit(1), "words").alias("b2")))
    bags = named.groupBy("b1", "b2").agg(F.first("words").alias("words"), F.max(F.col("side") == "e").alias("e"), F.max(F.col("side") == "t").alias("t"))
    classes = cut(bags.select("b1", "b2", "e", "t", "words", F.monotonically_increasing_id().alias("id")))
    members = cut(named.select("side", "split", "id", "b1", "b2").distinct().join(classes.select("b1", "b2", F.col("id").alias("cls")), ["b1", "b2"]).drop("b1", "b2"))
    drop_cut(named)
    pairs = cosine_join(unit_vectors(classes.where("e")), unit_vectors(classes.where("t")), 2 * num / (num + den))
    pairs = pairs.where(F.col("shared") * den >= (F.col("l_terms") + F.col("r_terms") - F.col("shared")) * num)
    side = lambda s: members.where(F.col("side") == s).select("split", "id", "cls")
    return pairs.select(F.col("l").alias("e_cls"), F.col("r").alias("t_cls"), "shared", "cosine"), side("e"), side("t")


def overlap_rows(eval_records: DataFrame, train_records: DataFrame, least: tuple[int, int] = (7, 10)) -> DataFrame:
    """(eval_split, eval_id, train_split, thread_id) of every overlapping pair of records, each once."""
    with scratch(eval_records.sparkSession) as kept_cuts:
        pairs, e, t = overlaps(eval_records, train_records, least)
        pairs = cut(pairs)
        e, t = cut(e), cut(t)
        kept_cuts += [pairs, e, t]
    return (
        pairs.select("e_cls", "t_cls")
        .join(e.select(F.col("cls").alias("e_cls"), F.col("split").alias("eval_split"), F.col("id").alias("eval_id")), "e_cls")
        .join(t.select(F.col("cls").alias("t_cls"), F.col("split").alias("train_split"), F.col("id").alias("thread_id")).distinct(), "t_cls")
        .select("eval_split", "eval_id", "train_split", "thread_id").distinct()
    )
