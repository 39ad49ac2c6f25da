"""Secret scan: written patterns, and a battery of randomness tests under false-discovery control.

Base spans follow three patterns. Besides them, every run of 20 or more encoding characters that mixes letters and
digits is a candidate. Its encoding is inferred (hex, base32, base36, base64), and it must look uniform in that
alphabet: chi-squared over classes of equal size, a runs test about the middle of the alphabet, and the lag-1 serial
correlation, none of them rejected at ``UNIFORM`` (Bonferroni over the three). The evidence against ordinary text is the
likelihood ratio of the token under a Markov chain over character classes, counted over all texts of the table, to
the uniform model; by Markov's inequality the ratio itself is a p-value. Benjamini-Hochberg at ``FDR`` within classes
of length picks the discoveries; their thresholds come from counts in logarithmic bins, of which there is a fixed number.

Defined cases: null text is empty and has no spans; repeated rows are kept; offsets are code points, ends exclusive;
method spans never overlap base spans; an empty table gives no rows. Extra columns pass ``redact`` unchanged.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmesh.llm.wordhash import slices
from quillmesh.session import materialize, ship_package

# Fixed patterns of the base spans.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
ASSIGN_VALUE, ACCESS_CHARS, HEX_CHARS = 8, 16, 32
KINDS = ("assign", "access", "hex", "random")

#: Any run that can hold an access key, a hex run or a candidate.
_RUN = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_-]{20,}={0,2}")
FDR, UNIFORM = 0.01, 0.01
#: Upper ends of the length classes, and bins of -log10 p (four to a decade).
LENGTHS, BINS = (24, 32, 48, 64), 240

_ALPHABETS = (
    ("hex", "0123456789abcdef"),
    ("hex", "0123456789ABCDEF"),
    ("base32", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("base36", "0123456789abcdefghijklmnopqrstuvwxyz"),
    ("base36", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    ("base64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
    ("base64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"),
)
_SETS = [(name, letters, frozenset(letters)) for name, letters in _ALPHABETS]

# Classes of bytes: other, digit, lower, upper, symbol of an encoding.
_CLASS = np.zeros(256, np.uint8)
_CLASS[48:58], _CLASS[97:123], _CLASS[65:91] = 1, 2, 3
_CLASS[[ord(c) for c in "+/_-="]] = 4


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the base spans, by start, then kind."""
    found = []
    if ":" in text or "=" in text:
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_VALUE]
    for run in _RUN.finditer(text):
        if "AKIA" in run[0]:
            found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text, run.start(), run.end()) if len(m[0]) >= ACCESS_CHARS]
        if run.end() - run.start() >= HEX_CHARS:
            found += [(m.start(), 2, m.end()) for m in HEX.finditer(text, run.start(), run.end()) if len(m[0]) >= HEX_CHARS]
    return sorted(found)


def encoding_of(token: str) -> str | None:
    """The smallest alphabet that holds the token; None for plain words and numbers."""
    kinds = {("d" if c.isdigit() else "l" if c.islower() else "u" if c.isupper() else "s") for c in token}
    if "d" not in kinds or not kinds & {"l", "u"}:
        return None
    chars = frozenset(token)
    return next((letters for _, letters, own in _SETS if chars <= own), None)


def _two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def _chi_squared_tail(x: float, k: int) -> float:
    """Upper tail by the cube-root normal approximation (Wilson-Hilferty)."""
    z = ((x / k) ** (1 / 3) - (1 - 2 / (9 * k))) / math.sqrt(2 / (9 * k))
    return 0.5 * math.erfc(z / math.sqrt(2))


def randomness(token: str, letters: str) -> tuple[float, float, float]:
    """p-values of uniformity, runs and serial correlation; small ones speak against a random token."""
    place = {c: i for i, c in enumerate(letters)}
    x = np.array([place[c] for c in token])
    n, size = len(x), len(letters)
    groups = 4 if n < 40 else 8
    seen = np.bincount(x * groups // size, minlength=groups)
    share = np.bincount(np.arange(size) * groups // size, minlength=groups) / size
    uniform = _chi_squared_tail(float(((seen - n * share) ** 2 / (n * share)).sum()), groups - 1)
    high = x >= size // 2
    a = int(high.sum())
    b = n - a
    runs = 1 + int((high[1:] != high[:-1]).sum())
    mean = 1 + 2 * a * b / n
    spread = math.sqrt(max((mean - 1) * (mean - 2) / max(n - 1, 1), 1e-9))
    by_runs = _two_sided((runs - mean) / spread) if a and b else 0.0
    d = x - (size - 1) / 2
    var = (size * size - 1) / 12
    serial = _two_sided(float((d[1:] * d[:-1]).sum()) / (var * math.sqrt(n - 1)))
    return uniform, by_runs, serial


class TextModel:
    """A Markov chain over character classes with letter shares inside each class."""

    def __init__(self, moves: np.ndarray, letters: np.ndarray):
        moves, letters = moves + 1.0, letters + 1.0
        self.moves = np.log(moves / moves.sum(axis=1, keepdims=True))
        total = np.bincount(_CLASS, weights=letters, minlength=5)
        self.letters = np.log(letters / total[_CLASS])

    def log_ratio(self, token: str, size: int) -> float:
        """log of (probability as text / probability as uniform characters of an alphabet of this size)."""
        raw = np.frombuffer(token.encode(), np.uint8)
        c = _CLASS[raw]
        before = np.append(np.uint8(0), c[:-1])
        return float(self.moves[before, c].sum() + self.letters[raw].sum() + len(raw) * math.log(size))


def length_class(n: int) -> int:
    return sum(n > top for top in LENGTHS)


def candidates(text: str, base: list[tuple[int, int, int]], model: TextModel) -> list[tuple[int, int, int]]:
    """(start, end, bin of -log10 p) of the candidates that pass the battery."""
    out = []
    for m in _CANDIDATE.finditer(text):
        token = m[0].rstrip("=")
        letters = encoding_of(token)
        if letters is None or any(s < m.end() and m.start() < e for s, _, e in base):
            continue
        if min(randomness(token, letters)) * 3 < UNIFORM:
            continue
        log_p = min(0.0, model.log_ratio(token, len(letters)))
        out.append((m.start(), m.end(), min(BINS - 1, int(-log_p / math.log(10) * 4))))
    return out


def _count_classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    moves, letters = np.zeros(25, np.int64), np.zeros(256, np.int64)
    for batch in batches:
        for _, _, data, bounds in slices(batch.column(0)):
            c = _CLASS[data]
            letters += np.bincount(data, minlength=256)
            step = c[:-1] * np.uint8(5) + c[1:]
            # no move leads from one document to the next, however they are stored
            borders = np.unique(bounds)
            borders = borders[(borders > 0) & (borders < len(data))]
            moves += np.bincount(step, minlength=25) - np.bincount(step[borders - 1], minlength=25)
    at = np.arange(281)
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(np.append(moves, letters))], names=["at", "n"])


def text_model(docs: DataFrame) -> TextModel:
    """Class moves and character counts of all texts: 281 sums, whatever the size of the table."""
    rows = docs.select(F.col("text").cast("string")).mapInArrow(_count_classes, "at int, n bigint").groupBy("at").agg(F.sum("n").alias("n")).collect()
    sums = np.zeros(281)
    for row in rows:
        sums[row["at"]] = row["n"]
    return TextModel(sums[:25].reshape(5, 5), sums[25:])


def _find(sent, kept: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            base_all, found_all = [], []
            for text in batch.column("text").to_pylist():
                base = base_spans(text or "")
                base_all.append([{"start": s, "kind": k, "end": e} for s, k, e in base])
                found = candidates(text or "", base, model)
                found_all.append([{"start": s, "end": e, "length_class": length_class(e - s), "bin": b} for s, e, b in found])
            columns = [batch.column(c) for c in kept]
            long, int_ = pa.int64(), pa.int32()
            base = pa.array(base_all, pa.list_(pa.struct([("start", long), ("kind", int_), ("end", long)])))
            found = pa.array(found_all, pa.list_(pa.struct([("start", long), ("end", long), ("length_class", int_), ("bin", int_)])))
            yield pa.RecordBatch.from_arrays([*columns, base, found], names=[*kept, "base", "found"])

    return run


def thresholds(found: DataFrame, fdr: float = FDR) -> list[int]:
    """Per length class the smallest bin of discoveries (``BINS`` where there are none), by Benjamini-Hochberg."""
    counts = np.zeros((len(LENGTHS) + 1, BINS))
    for row in found.select(F.explode("found").alias("f")).groupBy("f.length_class", "f.bin").count().collect():
        counts[row["length_class"], row["bin"]] = row["count"]
    out = []
    for row in counts:
        tests, above = row.sum(), row[::-1].cumsum()[::-1]
        good = [b for b in range(BINS) if above[b] and tests * 10 ** (-b / 4) <= fdr * above[b]]
        out.append(min(good, default=BINS))
    return out


def scan(docs: DataFrame, id_column: str = "doc_id", fdr: float = FDR) -> DataFrame:
    """``doc_id, base array<struct<start, kind, end>>, spans array<struct<start, kind, end>>`` (spans: base and method)."""
    spark = docs.sparkSession
    ship_package(spark)
    docs = docs.select(id_column, F.col("text").cast("string").alias("text"))
    sent = spark.sparkContext.broadcast(text_model(docs))
    kind = dict(docs.dtypes)[id_column]
    schema = f"`{id_column}` {kind}, base array<struct<start: bigint, kind: int, end: bigint>>, found array<struct<start: bigint, end: bigint, length_class: int, bin: int>>"
    found = materialize(docs.mapInArrow(_find(sent, [id_column]), schema), "secrets")
    least = F.array(*[F.lit(b) for b in thresholds(found, fdr)])
    chosen = F.filter("found", lambda f: f["bin"] >= F.element_at(least, f["length_class"] + 1))
    added = F.transform(chosen, lambda f: F.struct(f["start"].alias("start"), F.lit(3).alias("kind"), f["end"].alias("end")))
    return found.select(id_column, "base", F.array_sort(F.concat("base", added)).alias("spans"))


def span_text(spans: str):
    """``kind:start:end`` of an array of spans, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def redact(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """``docs`` with every secret span of ``text`` replaced by a mark, and ``n_chars`` counted anew where it exists.

    The scan's spans come back by id and text hash; only rows with spans take part in that join, so the texts of
    clean documents stay where they are if the planner broadcasts the few others.
    """
    key = F.struct(F.col("doc_id"), F.xxhash64("text").alias("h"))
    spans = scan(docs.withColumn("_key", key).select("_key", "text"), "_key").where(F.size("spans") > 0)
    spans = spans.dropDuplicates(["_key"]).select(F.col("_key.doc_id").alias("_id"), F.col("_key.h").alias("_h"), "spans")
    joined = docs.join(spans, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_h")), "left")
    begin = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out"))

    def step(acc, s):
        # overlapping spans are one: a span that begins before the last end only moves that end
        fresh = s["start"] >= acc["at"]
        piece = F.substring(F.col("text"), (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int"))
        out = F.when(fresh, F.concat(acc["out"], piece, F.lit(mark))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), out.alias("out"))

    end = lambda acc: F.concat(acc["out"], F.substring(F.col("text"), (acc["at"] + 1).cast("int"), F.length("text")))
    clean = F.when(F.col("spans").isNotNull(), F.aggregate("spans", begin, step, end)).otherwise(F.col("text"))
    out = joined.withColumn("text", clean)
    if "n_chars" in docs.columns:
        n = F.length("text").cast(dict(docs.dtypes)["n_chars"])
        out = out.withColumn("n_chars", F.when(F.col("spans").isNotNull(), n).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)
