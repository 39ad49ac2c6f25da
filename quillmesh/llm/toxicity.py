"""Toxicity scores by a factorization machine over hashed terms.

Terms of a text are its distinct words and their first four and five bytes, as 64-bit hashes. The machine has a
weight and a short factor vector per term, so a pair of terms (an insult and a group, say) adds evidence that neither has
alone. It is fitted on all labelled rows: up to ``TRAIN_ROWS`` on the driver, more in parts of about so many rows, one
task each, whose parameters are averaged after each of ``ROUNDS`` rounds and sent to all parts again. Terms in fewer than
``MIN_ROWS`` of these rows, terms that do not depend on the label by themselves (chi-squared below ``LEAST_CHI2``) and
those after the strongest ``MAX_TERMS`` are unknown, so pairs of singly weak terms are missed. Scoring runs in Arrow
batches over all whole texts.

Labels are learned only from rows whose ``crc32(doc_id as text) mod 5`` is not 0; no label, language, source or id is an
input of a score. Defined cases: a null text is empty; an empty text gets the model's base rate; a null label is not
learned; several labels of one id count as the largest; with no labelled rows every score is a low base rate; a
null id is text '' (held out). Repeated rows are kept; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmesh.llm.tokens import BATCH_ROWS
from quillmesh.llm.wordhash import ALNUM, Words, slices
from quillmesh.session import materialize, ship_package

#: Labelled rows that are fitted in one piece, rounds of fitting for more rows than that, and rows that must have a term.
TRAIN_ROWS, ROUNDS, MIN_ROWS = 12_000, 5, 3
#: Terms that a machine knows at most, and how strongly they must go with the label.
MAX_TERMS, LEAST_CHI2 = 20_000, 14.0
#: Terms that a task counts at once.
COUNTED = 1_000_000
_COUNTS = "term bigint, seen bigint, marked bigint"
_FEATURES = "doc_id bigint, toxic int, terms binary"
FACTORS, EPOCHS, BATCH, RATE = 4, 20, 32, 0.5
#: Share of a weight's step by which rarely useful weights shrink towards zero (L1), and of factors (L2).
SPARSE, DECAY = 0.02, 0.01


def held_out(doc_id: Column | str) -> Column:
    text = F.coalesce((F.col(doc_id) if isinstance(doc_id, str) else doc_id).cast("string"), F.lit(""))
    return F.crc32(text) % 5 == 0


def term_hashes(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(term hash, document number) of all words and word beginnings of a slice, repeats included."""
    words = Words(data, bounds, ALNUM)
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(words.first))
    parts = [words.hashes()]
    for k in (4, 5):
        # the salt keeps a word apart from a beginning with the same bytes
        parts.append(words.span_hashes(words.start, np.minimum(words.end, words.start + k)) ^ np.uint64(k))
    return np.concatenate(parts), np.concatenate([doc] * len(parts))


@dataclass
class Machine:
    terms: np.ndarray
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def __post_init__(self):
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(self.terms & np.uint64((1 << 20) - 1)).astype(np.int64)] = True

    def look_up(self, hashes: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(term number, document number) of the known terms, each once per document, by document."""
        if not len(self.terms):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        near = self.maybe[(hashes & np.uint64((1 << 20) - 1)).astype(np.int64)]
        hashes, doc = hashes[near], doc[near]
        at = np.minimum(np.searchsorted(self.terms, hashes), len(self.terms) - 1)
        known = self.terms[at] == hashes
        pairs = np.unique(doc[known] * len(self.terms) + at[known])
        return pairs % len(self.terms), pairs // len(self.terms)

    def raw(self, term: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
        z = np.full(n, self.bias) + np.bincount(doc, weights=self.weights[term], minlength=n)
        for f in range(self.factors.shape[1]):
            v = self.factors[term, f]
            s, q = np.bincount(doc, weights=v, minlength=n), np.bincount(doc, weights=v * v, minlength=n)
            z += 0.5 * (s * s - q)
        return z

    def scores(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        term, doc = self.look_up(*term_hashes(data, bounds))
        return 1 / (1 + np.exp(-np.clip(self.raw(term, doc, len(bounds) - 1), -30, 30)))


def _counted(rows: Iterator[tuple[int, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """Per run of rows ``(toxic, distinct terms)`` and term: rows with it, and toxic rows with it."""
    parts: dict[int, list[np.ndarray]] = {0: [], 1: []}

    def settle() -> Iterator[pa.RecordBatch]:
        for label, own in parts.items():
            if own:
                terms, n = np.unique(np.concatenate(own), return_counts=True)
                n = n.astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(terms.view(np.int64)), pa.array(n), pa.array(n * label)], names=["term", "seen", "marked"])
                own.clear()

    held = 0
    for toxic, terms in rows:
        parts[int(toxic == 1)].append(terms)
        held += len(terms)
        if held > COUNTED:
            yield from settle()
            held = 0
    yield from settle()


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield from _counted((t, np.frombuffer(x, np.uint64)) for b in batches for t, x in zip(b.column("toxic").to_pylist(), b.column("terms").to_pylist()))


def _count_text_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield from _counted((t, x) for b in batches for a, sets in _term_sets(b) for t, x in zip(b.column("toxic").slice(a, len(sets)).to_pylist(), sets))


def associated_terms(counts: DataFrame, n: int, pos: int) -> np.ndarray:
    """From ``counts(term, seen, marked)``: sorted terms in at least ``MIN_ROWS`` rows whose presence depends on the label (chi-squared, ``LEAST_CHI2``)."""
    counts = counts.groupBy("term").agg(F.sum("seen").cast("double").alias("seen"), F.sum("marked").cast("double").alias("marked")).where(F.col("seen") >= MIN_ROWS)
    cross = n * F.col("marked") - F.col("seen") * pos
    chi2 = cross * cross * n / F.greatest(F.col("seen") * (n - F.col("seen")) * float(pos * (n - pos)), F.lit(1.0))
    best = counts.withColumn("chi2", chi2).where(F.col("chi2") >= LEAST_CHI2).orderBy(F.desc("chi2"), "term").limit(MAX_TERMS)
    return np.sort(np.array([r["term"] for r in best.collect()], np.int64).view(np.uint64))


def _keep_known(terms: np.ndarray):
    """The numbers of the known terms of rows with all their terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [term_numbers(np.frombuffer(x, np.uint64), terms).astype(np.int32).tobytes() for x in batch.column("terms").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), pa.array(own, pa.binary())], names=["doc_id", "toxic", "terms"])

    return run


def _known_in_text(terms: np.ndarray):
    """The numbers of the known terms of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Machine(terms, 0.0, np.zeros(0), np.zeros((0, FACTORS)))
        for batch in batches:
            for a, b, data, bounds in slices(batch.column("text")):
                term, doc = known.look_up(*term_hashes(data, bounds))
                cuts = np.searchsorted(doc, np.arange(b - a + 1)).tolist()
                term = term.astype(np.int32)
                own = batch.slice(a, b - a)
                packed = pa.array([term[i:j].tobytes() for i, j in zip(cuts[:-1], cuts[1:])], pa.binary())
                yield pa.RecordBatch.from_arrays([own.column("doc_id"), own.column("toxic"), packed], names=["doc_id", "toxic", "terms"])

    return run


@dataclass
class State:
    """Parameters in training, and the squared gradients seen by each."""

    bias: float
    weights: np.ndarray
    factors: np.ndarray
    bias_seen: float
    weights_seen: np.ndarray
    factors_seen: np.ndarray


def first_state(n: int, pos: int, terms: int, dice: np.random.Generator) -> State:
    factors = dice.normal(0, 0.01, (terms, FACTORS))
    return State(base_rate(n, pos), np.zeros(terms), factors, 1.0, np.ones(terms), np.ones(factors.shape))


def base_rate(n: int, pos: int) -> float:
    return float(np.log((pos + 1) / (n - pos + 9)))


def _sums(group: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Sums of rows by group, column by column."""
    return np.stack([np.bincount(group, weights=values[:, f], minlength=n) for f in range(values.shape[1])], axis=1)


def learn(state: State, known: list[np.ndarray], labels: np.ndarray, epochs: int, dice: np.random.Generator) -> State:
    """Adaptive-gradient steps on the logistic loss, in place; ``known`` holds each text's term numbers."""
    w, v, gw, gv, gb, bias = state.weights, state.factors, state.weights_seen, state.factors_seen, state.bias_seen, state.bias
    for _ in range(epochs):
        order = dice.permutation(len(known))
        for a in range(0, len(known), BATCH):
            some = order[a : a + BATCH]
            term = np.concatenate([known[i] for i in some])
            doc = np.repeat(np.arange(len(some)), [len(known[i]) for i in some])
            own = v[term]
            sums = _sums(doc, own, len(some))
            z = Machine.raw(_View(bias, w, v), term, doc, len(some))
            g = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[some]
            used, slot = np.unique(term, return_inverse=True)
            dw = np.bincount(slot, weights=g[doc], minlength=len(used))
            dv = _sums(slot, g[doc, None] * (sums[doc] - own), len(used)) + DECAY * v[used]
            gw[used] += dw**2
            gv[used] += dv**2
            gb += g.sum() ** 2
            rate = RATE / np.sqrt(gw[used])
            new = w[used] - rate * dw
            w[used] = np.sign(new) * np.maximum(np.abs(new) - SPARSE * rate, 0)
            v[used] -= 0.3 * RATE * dv / np.sqrt(gv[used])
            bias -= RATE * g.sum() / np.sqrt(gb)
    state.bias, state.bias_seen = float(bias), float(gb)
    return state


def fit(rows: list[np.ndarray], labels: np.ndarray, terms: np.ndarray, seed: int = 7) -> Machine:
    """One fit in memory; ``rows`` hold the distinct hashes of each text's known ``terms``."""
    n, pos = len(rows), int(labels.sum())
    dice = np.random.default_rng(seed)
    state = first_state(n, pos, len(terms), dice)
    if not pos or pos == n or not len(terms):
        return Machine(terms, state.bias, state.weights, np.zeros_like(state.factors))
    state = learn(state, [term_numbers(row, terms) for row in rows], labels, EPOCHS, dice)
    return Machine(terms, state.bias, state.weights, state.factors)


def term_numbers(row: np.ndarray, terms: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(terms, row), len(terms) - 1)
    return at[terms[at] == row]


_NUMBERS = [f"{name}{i}" for name in ("v", "sv") for i in range(FACTORS)] + ["w", "sw"]


def _fit_part(state: State, epochs: int, seed: int):
    """One part's parameters after some epochs from the common state: a row per term it has, and one of number -1 for the bias."""

    def run(key: tuple[pa.Scalar, ...], part: pa.Table) -> pa.Table:
        part = part.sort_by("doc_id")
        known = [np.frombuffer(x, np.int32) for x in part.column("terms").to_pylist()]
        own = State(state.bias, state.weights.copy(), state.factors.copy(), state.bias_seen, state.weights_seen.copy(), state.factors_seen.copy())
        learn(own, known, np.asarray(part.column("toxic").to_numpy(), float), epochs, np.random.default_rng([seed, key[0].as_py()]))
        used = np.unique(np.concatenate(known))
        numbers = np.hstack([own.factors[used], own.factors_seen[used], own.weights[used, None], own.weights_seen[used, None]])
        bias = np.zeros((1, numbers.shape[1]))
        bias[0, -2:] = own.bias, own.bias_seen
        columns = [pa.array(np.append(used, -1).astype(np.int32)), *map(pa.array, np.vstack([numbers, bias]).T.copy())]
        return pa.Table.from_arrays(columns, names=["term", *_NUMBERS])

    return run


def fit_parts(features: DataFrame, n: int, pos: int, terms: np.ndarray, parts: int, seed: int = 7) -> Machine:
    """The fit over more rows than one task takes. A term's parameters are averaged over the parts that have it.

    Only the parameters come to the driver, one row per term and round, whatever the number of parts.
    """
    state = first_state(n, pos, len(terms), np.random.default_rng(seed))
    schema = ", ".join(["term int", *(f"{c} double" for c in _NUMBERS)])
    dealt = features.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(parts)).cast("int")).repartition(parts, "part")
    for number in range(ROUNDS):
        found = dealt.groupBy("part").applyInArrow(_fit_part(state, EPOCHS // ROUNDS, seed + number), schema)
        rows = found.groupBy("term").agg(*(F.avg(c).alias(c) for c in _NUMBERS)).orderBy("term").toPandas()
        numbers = rows[_NUMBERS].to_numpy(float)
        state.bias, state.bias_seen = numbers[0, -2:].tolist()
        used, numbers = rows["term"].to_numpy()[1:], numbers[1:]
        state.factors[used], state.factors_seen[used] = numbers[:, :FACTORS], numbers[:, FACTORS : 2 * FACTORS]
        state.weights[used], state.weights_seen[used] = numbers[:, -2], numbers[:, -1]
    return Machine(terms, state.bias, state.weights, state.factors)


@dataclass
class _View:
    """The parameters in training, as ``Machine.raw`` reads them."""

    bias: float
    weights: np.ndarray
    factors: np.ndarray


def _term_sets(batch: pa.RecordBatch) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(first row, distinct terms of each row) of runs of rows."""
    for a, b, data, bounds in slices(batch.column("text")):
        hashes, doc = term_hashes(data, bounds)
        order = np.argsort(doc, kind="stable")
        cuts = np.searchsorted(doc[order], np.arange(b - a + 1))
        yield a, [np.unique(hashes[order[i:j]]) for i, j in zip(cuts[:-1], cuts[1:])]


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, sets in _term_sets(batch):
            own, packed = batch.slice(a, len(sets)), pa.array([x.tobytes() for x in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([own.column("doc_id"), own.column("toxic"), packed], names=["doc_id", "toxic", "terms"])


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Machine:
    """Fit on all labelled texts that are not held out, in parts of about ``rows`` if there are more.

    Terms are counted and chosen in Spark from whole texts; a second pass keeps the chosen ones of each text. Only
    ``MAX_TERMS`` hashes, the known terms of at most ``rows`` texts, or the averaged parameters come to the driver.
    """
    ship_package(docs.sparkSession)
    known = labels.select(F.col("doc_id").alias("label_id"), F.col("toxic").cast("int").alias("toxic")).where("label_id is not null and toxic is not null")
    known = known.where(~held_out("label_id")).groupBy("label_id").agg(F.max("toxic").alias("toxic"))
    copies = docs.groupBy("doc_id").agg(F.count("*").alias("copies"))
    known = materialize(known.join(copies, F.col("label_id") == F.col("doc_id")).select("label_id", "toxic", "copies"), "labelled")
    n, pos = known.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).where(~held_out("doc_id"))
    # labels grow with the texts, so they are never sent whole to every executor
    texts = texts.join(known.hint("merge"), F.col("doc_id") == F.col("label_id")).select("doc_id", "toxic", "text", "copies")
    # read twice, and the shuffle files of the join go before those of the counts come
    texts = materialize(texts, "labelled-texts", BATCH_ROWS)
    # of several texts with one id one counts; the others need no shuffle
    single, several = texts.where("copies = 1"), texts.where("copies > 1").mapInArrow(_features, _FEATURES)
    several = several.groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.min("terms").alias("terms"))
    counts = single.mapInArrow(_count_text_terms, _COUNTS).unionByName(several.mapInArrow(_count_terms, _COUNTS))
    terms = associated_terms(counts, n, pos)
    if pos in (0, n) or not len(terms):
        return Machine(terms, base_rate(n, pos), np.zeros(len(terms)), np.zeros((len(terms), FACTORS)))
    known_terms = single.mapInArrow(_known_in_text(terms), _FEATURES).unionByName(several.mapInArrow(_keep_known(terms), _FEATURES))
    features = materialize(known_terms, "terms", BATCH_ROWS)
    if n <= rows:
        got = features.orderBy("doc_id").collect()
        return fit([terms[np.frombuffer(r["terms"], np.int32)] for r in got], np.array([r["toxic"] for r in got], float), terms)
    return fit_parts(features, n, pos, terms, -(-n // rows))


def score(docs: DataFrame, machine: Machine) -> DataFrame:
    """``docs`` with ``toxicity`` (0 to 1); a column of that name is replaced."""
    spark = docs.sparkSession
    ship_package(spark)
    sent = spark.sparkContext.broadcast(machine)

    @F.pandas_udf("double")
    def toxicity(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = sent.value
        for texts in parts:
            out = [own.scores(data, bounds) for _, _, data, bounds in slices(pa.array(texts, pa.string()))]
            yield pd.Series(np.concatenate(out) if out else np.zeros(0), dtype=float)

    return docs.withColumn("toxicity", toxicity(F.col("text").cast("string")))


def drop_toxic(docs: DataFrame, labels: DataFrame, limit: float = 0.5) -> DataFrame:
    """The rows of ``docs`` with a score below the limit."""
    return score(docs, train(docs, labels)).where(F.col("toxicity") < limit).select(*docs.columns)
