"""Toxicity by the nearest labelled examples.

A text is the vector of its words (runs of letters, lower-cased) with weights (1 + ln tf) * ln(1 + N / df) *
sqrt(1 + G), where N and df count all documents and G is the log-likelihood ratio of the word against the examples'
labels: a word that says nothing of the label weighs its TF-IDF, others more, and none is left out. The vocabulary is
all words of the examples; a word of no example meets none and counts in the text's norm alone, with the idf of a word
that one example more would hold. The nearest examples by cosine are found exactly in an inverted index with block
maxima: examples lie in blocks, and each rare term keeps its largest weight in every block. The terms of more than one
in COMMON examples, whose lists prune nothing, are multiplied as a matrix. A block is opened only while its largest
sum of the common terms and the sum of the rare ones' maxima can still reach the k-th best similarity. The examples
vote with weight 1 / (distance + 0.05), where the distance is 1 - cosine, times the cosine; a prior vote stands for
texts without a near example. A logistic curve fitted on the examples' own votes, each without itself, turns the vote
into a calibrated score.

Labels are learned only from rows whose crc32(doc_id as text) mod FOLDS is not 0, and of these from at most EXAMPLES
rows, taken in the order of a hash of doc_id. That bound is the only limit: the words, their counts, the scores and
the search cover all documents and all examples.

Nulls: a null text is an empty one and gets the score of a text without words, as does a null doc_id's text by its own
words (held_out is then null). Repeated documents give repeated rows; of labels that disagree on a doc_id, the larger
counts. Without any label the score is 0.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellframe.llm.pieces import LETTER, Slots, classes, code_points
from cellframe.llm.text import mix, ragged, span_hashes

FOLDS = 5
#: Labelled rows that the model is fitted on, at most.
EXAMPLES = 10_000
NEIGHBOURS, BLOCK = 16, 256
#: A term of more than one in COMMON examples is multiplied as a row of a matrix.
COMMON = 20
#: Texts that are searched together, and entries of the lists of block maxima that they may have (more in a text alone).
GROUP, GROUP_LISTS = 64, 1 << 19
EVIDENCE = 3
PRIOR_WEIGHT = 1.0
PASS = 1 << 18
#: Rows whose words a task holds at a time.
SLICE = 512


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in parts of SLICE rows; what a batch took goes back to the system."""
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            yield batch.slice(at, SLICE)
        del batch
        pa.default_memory_pool().release_unused()


def give_back() -> None:
    """Return freed memory to the system, where the C library can: a worker stays on for the stages that follow."""
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def word_spans(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, word hash) of all words of the texts, lower-cased, in passes over about PASS code points."""
    at = 0
    while at < len(texts):
        upto, size = at, 0
        while upto < len(texts) and (upto == at or size + len(texts[upto]) <= PASS):
            size += len(texts[upto]) + 1
            upto += 1
        some = [t.lower() for t in texts[at:upto]]
        points = code_points("\n".join(some))
        inside = np.zeros(len(points) + 2, np.int8)
        inside[1:-1] = classes()[points] == LETTER
        edge = np.diff(inside)
        starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        first = np.cumsum([0, *(len(t) + 1 for t in some)])[:-1]
        row = np.searchsorted(first, starts, "right") - 1
        yield at + row, span_hashes(mix(points.astype(np.uint64) + np.uint64(1)), starts, ends)
        at = upto


def term_counts(texts: list[str], slots: Slots | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, term, count) of the distinct words in order of row: the term is its index in ``slots`` (-1 for a word that
    is not there, a row each), or the word's hash without slots."""
    rows, terms, counts = [], [], []
    for row, h in word_spans(texts):
        if not len(row):
            continue
        order = np.argsort(h)
        near = row[order] - row[0]
        order = order[np.argsort(near.astype(np.uint16) if row[-1] - row[0] < 1 << 16 else near, kind="stable")]
        row, h = row[order], h[order]
        heads = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (h[1:] != h[:-1])]))
        rows.append(row[heads])
        terms.append(h[heads].view(np.int64) if slots is None else slots.get(h[heads]).astype(np.int64))
        counts.append(np.diff(np.append(heads, len(row))))
    joined = [np.concatenate(x) if x else np.empty(0, np.int64) for x in (rows, terms, counts)]
    return joined[0], joined[1], joined[2]


def cut_rows(row: np.ndarray, n: int) -> np.ndarray:
    return np.searchsorted(row, np.arange(n + 1))


class BlockMaxIndex:
    """Exact k nearest examples by cosine."""

    def __init__(self, first: np.ndarray, term: np.ndarray, weight: np.ndarray, n_terms: int):
        self.n, self.n_terms = len(first) - 1, n_terms
        self.n_blocks = -(-self.n // BLOCK)
        example = np.repeat(np.arange(self.n, dtype=np.int32), np.diff(first))
        # examples that share their heaviest term lie together, so that block maxima are tight
        top = np.full(self.n, n_terms)
        sizes = np.diff(first)
        some = np.flatnonzero(sizes)
        if len(some):
            heavy = np.flatnonzero(weight == np.repeat(np.maximum.reduceat(weight, first[some]), sizes[some]))
            own, at = np.unique(example[heavy], return_index=True)
            top[own] = term[heavy][at]
            del heavy
        self.place = np.argsort(top, kind="stable")
        position = np.empty(self.n, np.int32)
        position[self.place] = np.arange(self.n)
        at = position[example]
        # the vectors by place, for exact sums
        order = np.argsort(at, kind="stable")
        self.own_term, self.own_weight = term[order].astype(np.int32), weight[order]
        self.own_first = np.searchsorted(at[order], np.arange(self.n + 1))
        del order, example
        df = np.bincount(term, minlength=n_terms)
        often = np.flatnonzero(df * COMMON > self.n)
        self.row = np.full(n_terms, -1, np.int32)
        self.row[often] = np.arange(len(often))
        common = self.row[term] >= 0
        self.common = np.zeros((len(often), self.n_blocks * BLOCK), np.float32)
        self.common[self.row[term[common]], at[common]] = weight[common]
        #: The largest error of a sum of products of unit vectors with weights in single precision.
        self.slack = (len(often) + 8) * 2.0**-24 + 1e-9
        rare = np.flatnonzero(~common)
        rare = rare[np.lexsort((at[rare], term[rare]))]
        self.at, self.weight, term = at[rare], weight[rare].astype(np.float32), term[rare]
        block = self.at // BLOCK
        heads = np.flatnonzero(np.concatenate([[True], (term[1:] != term[:-1]) | (block[1:] != block[:-1])])) if len(term) else np.empty(0, np.int64)
        self.block, self.head, self.size = block[heads], heads.astype(np.int32), np.diff(np.append(heads, len(term))).astype(np.int32)
        self.peak = np.maximum.reduceat(self.weight, heads) if len(heads) else np.empty(0, np.float32)
        self.first = np.searchsorted(term[heads], np.arange(n_terms + 1))

    def nearest(self, term: np.ndarray, weight: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(example, cosine) of the k nearest with a cosine over 0; of equal ones the earlier in the index."""
        return next(self.nearest_many(np.array([0, len(term)]), term, weight, k))

    def nearest_many(self, first: np.ndarray, term: np.ndarray, weight: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """``nearest`` of every text, whose terms lie from ``first`` to the next one's; up to GROUP texts are searched together."""
        dense = np.zeros(self.n_terms)
        lists = np.append(0, np.cumsum(self.first[term + 1] - self.first[term]))
        a = 0
        while a < len(first) - 1:
            upto = min(len(first) - 1, a + GROUP, int(np.searchsorted(lists[first], lists[first[a]] + GROUP_LISTS, "right")) - 1)
            upto = max(upto, a + 1)
            mine = slice(first[a], first[upto])
            yield from self.search(first[a : upto + 1] - first[a], term[mine], weight[mine], k, dense)
            a = upto

    def search(self, first: np.ndarray, term: np.ndarray, weight: np.ndarray, k: int, dense: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        n, blocks = len(first) - 1, self.n_blocks
        text = np.repeat(np.arange(n), np.diff(first))
        row = self.row[term]
        often = row >= 0
        asked = np.zeros((n, len(self.common)), np.float32)
        asked[text[often], row[often]] = weight[often]
        sums = (asked @ self.common).reshape(n, blocks, BLOCK)
        counts = self.first[term + 1] - self.first[term]
        lists = ragged(self.first[term], counts)
        share, cell = np.repeat(weight, counts), np.repeat(text * blocks, counts) + self.block[lists]
        bound = np.bincount(cell, self.peak[lists] * share, n * blocks).astype(float).reshape(n, blocks)
        if self.n:
            bound += sums.max(2)
        order = np.argsort(-bound, axis=1, kind="stable")
        falling = np.take_along_axis(bound, order, 1)
        owner, near, best = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        least, held = np.zeros(n), np.zeros(n, np.int64)
        local = np.full(n * blocks, -1)
        done, step = 0, 8
        while done < blocks:
            # bounds fall along the order, so a text that opens nothing now is finished
            ahead = falling[:, done : done + step]
            want = (ahead > 0) & ((held < k)[:, None] | (ahead + 2 * self.slack >= least[:, None]))
            if not want.any():
                break
            asks, at = np.nonzero(want)
            opened = order[asks, done + at]
            local[asks * blocks + opened] = np.arange(len(asks)) * BLOCK
            some = np.flatnonzero(local[cell] >= 0)
            sizes = self.size[lists[some]]
            posts = ragged(self.head[lists[some]], sizes)
            place = np.repeat(local[cell[some]], sizes) + self.at[posts] % BLOCK
            total = sums[asks, opened].ravel() + np.bincount(place, self.weight[posts] * np.repeat(share[some], sizes), len(asks) * BLOCK)
            local[asks * blocks + opened] = -1
            whose = np.repeat(asks, BLOCK)
            found = np.flatnonzero((total > 0) & (total + 2 * self.slack >= least[whose]))
            owner, near = np.concatenate([owner, whose[found]]), np.concatenate([near, opened[found // BLOCK] * BLOCK + found % BLOCK])
            best = np.concatenate([best, total[found]])
            # what may be among a text's k nearest once its sum is exact
            by = np.lexsort((-best, owner))
            owner, near, best = owner[by], near[by], best[by]
            starts = np.searchsorted(owner, np.arange(n + 1))
            held = np.diff(starts)
            full = held >= k
            least[full] = best[starts[:-1][full] + k - 1]
            keep = best + 2 * self.slack >= least[owner]
            owner, near, best = owner[keep], near[keep], best[keep]
            held = np.bincount(owner, minlength=n)
            done, step = done + step, step * 2
        starts = np.searchsorted(owner, np.arange(n + 1))
        for i in range(n):
            own = near[starts[i] : starts[i + 1]]
            if not len(own):
                yield own, np.empty(0)
                continue
            mine = slice(first[i], first[i + 1])
            dense[term[mine]] = weight[mine]
            sizes = self.own_first[own + 1] - self.own_first[own]
            posts = ragged(self.own_first[own], sizes)
            exact = np.bincount(np.repeat(np.arange(len(own)), sizes), dense[self.own_term[posts]] * self.own_weight[posts], len(own))
            dense[term[mine]] = 0
            keep = np.lexsort((own, -exact))[:k]
            yield self.place[own[keep]], np.minimum(exact[keep], 1.0)


def vote(labels: np.ndarray, cosine: np.ndarray, prior: float) -> float:
    weight = cosine / (1.05 - cosine)
    return float((weight @ labels + PRIOR_WEIGHT * prior) / (weight.sum() + PRIOR_WEIGHT))


def logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a slightly damped logistic fit; the slope is never negative."""
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        g = np.array([(p - y) @ x + 1e-3 * a, (p - y).sum() + 1e-3 * b])
        w = p * (1 - p)
        h = np.array([[w @ (x * x) + 1e-3, w @ x], [w @ x, w.sum() + 1e-3]])
        move = np.linalg.solve(h, g)
        size = np.abs(move).max()
        a, b = a - move[0] / max(1, size), b - move[1] / max(1, size)
    return max(float(a), 0.0), float(b)


def table_of(terms: np.ndarray) -> Slots:
    slots = Slots(max(4, int(np.ceil(np.log2(1.5 * len(terms) + 1)))))
    slots.add(terms, np.arange(len(terms), dtype=np.int32))
    return slots


@dataclass
class Model:
    """What a fit keeps: at most EXAMPLES examples and the words that they hold."""

    terms: np.ndarray
    #: The weight of each term at one occurrence, and last that of a word of no example.
    factor: np.ndarray
    doc_ids: np.ndarray
    marks: np.ndarray
    labels: np.ndarray
    first: np.ndarray
    term: np.ndarray
    weight: np.ndarray
    prior: float
    curve: tuple[float, float]

    def __post_init__(self):
        self.prepared = self.shared = None

    def __getstate__(self):
        return self.__dict__ | {"prepared": None, "shared": None}

    def share(self, spark: SparkSession) -> Broadcast:
        """The model for the tasks, once for all jobs; the driver keeps labels and curve alone."""
        if self.shared is None:
            self.shared = spark.sparkContext.broadcast(self)
            self.terms = self.factor = self.term = self.weight = None
        return self.shared

    def ready(self) -> tuple[Slots, BlockMaxIndex]:
        if self.prepared is None:
            self.prepared = table_of(self.terms), BlockMaxIndex(self.first, self.term, self.weight, len(self.terms))
        return self.prepared

    def settled(self) -> Model:
        """For a worker that only searches: the index stays, the arrays it was made of go."""
        if self.prepared is None:
            self.ready()
            self.terms = self.term = self.weight = None
            give_back()
        return self

    def vectors(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        slots, _ = self.ready()
        return unit(*term_counts(texts, slots), self.factor, len(texts))

    def near(self, first: np.ndarray, term: np.ndarray, weight: np.ndarray, own: list[int] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Nearest examples of every text; ``own``: the texts are these examples, and each is left out of its own."""
        for i, (example, cosine) in enumerate(self.ready()[1].nearest_many(first, term, weight, NEIGHBOURS + (own is not None))):
            keep = np.flatnonzero(example != own[i])[:NEIGHBOURS] if own is not None else slice(None)
            yield example[keep], cosine[keep]


def calibrated(v: float, curve: tuple[float, float]) -> float:
    return float(1 / (1 + np.exp(-np.clip(curve[0] * v + curve[1], -30, 30))))


def unit(row: np.ndarray, term: np.ndarray, count: np.ndarray, factor: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Vectors of length 1, with the words of no example (term -1) in the length alone."""
    weight = (1 + np.log(count)) * factor[term]
    norm = np.sqrt(np.bincount(row, weight * weight, n)) if n else np.empty(0)
    known = np.flatnonzero(term >= 0)
    row, term, weight = row[known], term[known], weight[known]
    return cut_rows(row, n), term, weight / norm[row]


def examples(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, text, toxic of the rows to learn from."""
    fold = F.crc32(F.col("doc_id").cast("string")) % FOLDS
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (fold != 0)).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    # the share of a hash's range that holds EXAMPLES rows or fewer, but for chance; the limit then is exact
    share = min(1.0, EXAMPLES * 0.95 / max(1, known.count()))
    lot = F.pmod(F.xxhash64("doc_id", F.lit(6)), F.lit(1 << 40))
    some = known.where(lot < int(share * (1 << 40))).orderBy(lot, "doc_id").limit(EXAMPLES)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(some), "doc_id")


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    from cellframe.session import cut

    chosen = cut(examples(docs, labels))

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            row, term, _ = term_counts(batch.column(0).to_pylist())
            toxic = batch.column(1).to_numpy(zero_copy_only=False)[row]
            yield pa.RecordBatch.from_arrays([pa.array(term), pa.array(toxic.astype(np.int64))], ["term", "toxic"])

    total, n_toxic = chosen.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    rate = n_toxic / max(1, total)
    model = Model(np.empty(0, np.uint64), np.ones(1), *[np.empty(0, np.int64)] * 3, np.zeros(1, np.int64), np.empty(0, np.int64), np.empty(0), rate, (0.0, -30.0))
    if not 0 < n_toxic < total:
        return model
    counted = chosen.select("text", "toxic").mapInArrow(words, "term long, toxic long").groupBy("term").agg(F.count("*").alias("df"), F.sum("toxic").alias("hot")).toArrow()
    if not counted.num_rows:
        return model
    keys, df, hot = (counted.column(x).to_numpy() for x in ("term", "df", "hot"))
    order = np.argsort(keys)
    keys, df, hot = keys[order], df[order], hot[order]
    model.terms = keys.view(np.uint64)
    part = lambda seen, p: np.where(seen > 0, seen * np.log(np.maximum(seen, 1) / (df * p)), 0.0)
    strength = np.sqrt(1 + np.maximum(0, 2 * (part(hot, rate) + part(df - hot, 1 - rate))))
    spark = docs.sparkSession
    known = spark.sparkContext.broadcast(model.terms)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots, n = table_of(known.value), 0
        df = np.zeros(len(known.value) + 1, np.int64)
        for batch in slices(batches):
            n += batch.num_rows
            df += np.bincount(term_counts([x or "" for x in batch.column(0).to_pylist()], slots)[1] + 1, minlength=len(df))
        df[0] = n
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(some - 1), pa.array(df[some])], ["term", "n"])

    found = docs.select("text").mapInArrow(sums, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    corpus = np.zeros(len(keys) + 1, np.int64)
    corpus[found.column("term").to_numpy() + 1] = found.column("n").to_numpy()
    model.factor = np.append(np.log1p(corpus[0] / np.maximum(1, corpus[1:])) * strength, np.log1p(total + 1))
    bare = spark.sparkContext.broadcast((model.terms, model.factor))

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, factor = bare.value
        slots = table_of(terms)
        for batch in slices(batches):
            texts = batch.column(1).to_pylist()
            first, term, weight = unit(*term_counts(texts, slots), factor, len(texts))
            lists = [pa.ListArray.from_arrays(first.astype(np.int32), pa.array(x)) for x in (term.astype(np.int32), weight)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), *lists], ["doc_id", "toxic", "mark", "term", "weight"])

    # at most EXAMPLES rows
    held = chosen.select("doc_id", "text", F.col("toxic").cast("long"), F.xxhash64("text").alias("mark")).mapInArrow(vectors, "doc_id long, toxic long, mark long, term array<int>, weight array<double>").toArrow()
    held = held.sort_by([("doc_id", "ascending"), ("mark", "ascending")]).combine_chunks()
    model.doc_ids, model.marks, model.labels = (held.column(x).to_numpy() for x in ("doc_id", "mark", "toxic"))
    model.first = np.append(0, np.cumsum(pc.list_value_length(held.column("term")).to_numpy()))
    model.term, model.weight = (pc.list_flatten(held.column(x)).to_numpy() for x in ("term", "weight"))
    labels_of = dict(zip(zip(model.doc_ids.tolist(), model.marks.tolist()), model.labels.tolist()))
    del held
    shared = model.share(spark)

    def votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value.settled()
        place = {key: i for i, key in enumerate(zip(model.doc_ids.tolist(), model.marks.tolist()))}
        for batch in slices(batches):
            own = [place[key] for key in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist())]
            found = model.near(*model.vectors(batch.column(1).to_pylist()), own)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([vote(model.labels[example], cosine, model.prior) for example, cosine in found], pa.float64())], ["doc_id", "mark", "vote"])

    # every example's vote without itself: at most EXAMPLES rows
    marked = chosen.select("doc_id", "text", F.xxhash64("text").alias("mark")).repartition(2 * spark.sparkContext.defaultParallelism)
    voted = marked.mapInArrow(votes, "doc_id long, mark long, vote double").toArrow().sort_by([("doc_id", "ascending"), ("mark", "ascending")])
    y = [labels_of[key] for key in zip(voted.column("doc_id").to_pylist(), voted.column("mark").to_pylist())]
    model.curve = logistic(voted.column("vote").to_numpy(), np.array(y, float))
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted and the evidence (doc_id, toxic and cosine of the nearest examples)."""
    shared, curve = model.share(docs.sparkSession), model.curve

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value.settled()
        for batch in slices(batches):
            first, term, weight = model.vectors([x or "" for x in batch.column(1).to_pylist()])
            scores, evidence = [], []
            for example, cosine in model.near(first, term, weight):
                labels = model.labels[example]
                scores.append(calibrated(vote(labels, cosine, model.prior), curve))
                best = range(min(EVIDENCE, len(example)))
                evidence.append([{"doc_id": int(model.doc_ids[example[i]]), "toxic": int(labels[i]), "cosine": float(cosine[i])} for i in best])
            kind = pa.list_(pa.struct([("doc_id", pa.int64()), ("toxic", pa.int32()), ("cosine", pa.float64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array(evidence, kind)], ["doc_id", "score", "evidence"])

    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double, evidence array<struct<doc_id:long,toxic:int,cosine:double>>")
    held_out = F.crc32(F.col("doc_id").cast("string")) % FOLDS == 0
    return out.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence")


def keep_clean(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs``, with all their columns, that score below 0.5; each is judged by its text alone."""
    shared, curve = model.share(docs.sparkSession), model.curve
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value.settled()
        for batch in slices(batches):
            near = model.near(*model.vectors([x or "" for x in batch.column(at).to_pylist()]))
            keep = [calibrated(vote(model.labels[example], cosine, model.prior), curve) < 0.5 for example, cosine in near]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
