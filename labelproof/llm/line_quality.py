"""Quality by line: a linear-chain conditional random field marks every line of a text as good or bad.

A line is described by its size, its shares of letters, capitals, digits and symbols, its words and how often they and
the line itself repeat. Each of these is cut into bins, and the field's log odds of a line add up one weight for every
bin of the line and of the lines before and after it; two more weights say how readily a good or a bad line is followed
by one of its kind. Forward and backward passes give each line's probability of being good, and a document's score is
their mean, weighted by the lines' code points.

Only the fit reads labels, those of whole documents: all lines of a document get its label. It takes a bounded sample,
``sample_rows`` rows drawn by hash and at most ``window_lines`` neighbouring lines of each, as numbers; the weights are
fitted on the driver by gradient steps on the regularised likelihood. Texts are scored whole, in tasks.

Defined cases: a text that is null or empty is one empty line. Without labelled rows every line has probability 0.5. A
document with several labels counts as good only if all say so; a null label or key is no label. Repeated rows are
scored alike and count again in the fit. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelproof.llm.batches import limited

UPPER = bytes(range(65, 91))
LETTERS = UPPER + bytes(range(97, 123))
DIGITS = bytes(range(48, 58))
BLANKS = b" \t\n\v\f\r"
# marks of ordinary prose, brackets and quotation marks included
PROSE = b".,;:!?'\"()-"
SYMBOLS = bytes(b for b in range(33, 127) if b not in LETTERS + DIGITS + PROSE)
FOLLOWERS = bytes(range(128, 192))
MEASURES = ("size", "letters", "capitals", "digits", "symbols", "marks", "word_size", "word_kinds", "ending", "copies")


def measured(lines: list[bytes]) -> np.ndarray:
    """One row of ``MEASURES`` per line of a text."""
    copies: dict[bytes, int] = {}
    for line in lines:
        copies[line] = copies.get(line, 0) + 1

    def without(line: bytes, some: bytes) -> int:
        return len(line) - len(line.translate(None, some))

    rows = []
    for line in lines:
        points = len(line) - without(line, FOLLOWERS)
        words = line.split()
        blanks = without(line, BLANKS)
        shown = max(1, points - blanks)
        ascii_letters, capitals = without(line, LETTERS), without(line, UPPER)
        digits, symbols, marks = without(line, DIGITS), without(line, SYMBOLS), without(line, PROSE)
        beyond = len(line) - without(line, bytes(range(128)))
        wide = beyond - without(line, FOLLOWERS)
        last = line[-1:] if not words else words[-1][-1:]
        rows.append(
            (
                np.log2(1 + points),
                (ascii_letters + wide) / shown,
                capitals / max(1, ascii_letters),
                digits / shown,
                symbols / shown,
                marks / shown,
                (points - blanks) / max(1, len(words)),
                len(set(words)) / max(1, len(words)),
                1.0 if last in (b".", b"!", b"?") else 0.0,
                min(copies[line], 8),
            )
        )
    return np.array(rows, np.float32).reshape(len(lines), len(MEASURES))


@dataclass(frozen=True)
class Chains:
    """Lines of many texts, one after another: where each text begins, and its lines' bins with those beside them."""

    starts: np.ndarray
    sizes: np.ndarray
    bins: np.ndarray

    @staticmethod
    def of(sizes: np.ndarray, bins: np.ndarray, none: int, before=None, after=None) -> Chains:
        """``bins`` (line, measure); beyond the ends of a text all measures are in bin ``none``.

        ``before`` and ``after`` replace the bins beyond the ends where a chain is a piece of its text.
        """
        starts = np.cumsum(sizes) - sizes
        blank = np.full((1, bins.shape[1]), none, bins.dtype)
        previous = np.concatenate([blank, bins[:-1]])
        following = np.concatenate([bins[1:], blank])
        previous[starts] = none if before is None else before
        following[starts + sizes - 1] = none if after is None else after
        return Chains(starts, sizes, np.concatenate([previous, bins, following], 1))


class LineField:
    """Weights of the field. ``edges`` cut each measure into bins, one more bin stands for no line."""

    def __init__(self, edges: list[np.ndarray], weights: np.ndarray, stay: np.ndarray, prior: float = 0.0):
        self.edges = edges
        self.weights = weights  # (3 * measure, bin): log odds of good
        self.stay = stay  # bad after bad, good after good
        self.prior = prior  # log odds of good of any line

    @property
    def none(self) -> int:
        return self.weights.shape[1] - 1

    def binned(self, values: np.ndarray) -> np.ndarray:
        columns = [np.searchsorted(e, values[:, i], "right") for i, e in enumerate(self.edges)]
        return np.stack(columns, 1).astype(np.int16) if columns else np.zeros((len(values), 0), np.int16)

    def odds(self, chains: Chains) -> np.ndarray:
        """Log odds of good of every line by itself."""
        return self.prior + self.weights[np.arange(chains.bins.shape[1]), chains.bins].sum(1)

    def passes(self, chains: Chains) -> tuple[np.ndarray, np.ndarray]:
        """(forward, backward) log odds: a line with all before it, and all after it."""
        own = self.odds(chains)
        forward, backward = own.copy(), np.zeros_like(own)
        order = np.argsort(-chains.sizes, kind="stable")
        starts, sizes = chains.starts[order], chains.sizes[order]
        alive = np.searchsorted(-sizes, -np.arange(1, int(sizes.max(initial=0)) + 1), "right")
        for t in range(1, len(alive)):
            at = starts[: alive[t]] + t
            forward[at] += self._message(forward[at - 1])
        for t in range(1, len(alive)):
            at = starts[: alive[t]] + sizes[: alive[t]] - 1 - t
            backward[at] = self._message(own[at + 1] + backward[at + 1])
        return forward, backward

    def _message(self, odds: np.ndarray) -> np.ndarray:
        """Log odds that a neighbour's log odds lend to a line."""
        return np.logaddexp(odds + self.stay[1], 0.0) - np.logaddexp(odds, self.stay[0])

    def good(self, chains: Chains) -> np.ndarray:
        """Probability of good of every line."""
        forward, backward = self.passes(chains)
        return sigmoid(forward + backward)

    def score(self, texts: list[bytes | None]) -> np.ndarray:
        """Mean probability of good over each text's code points."""
        if not texts:
            return np.zeros(0)
        split = [(t or b"").split(b"\n") for t in texts]
        values = [measured(lines) for lines in split]
        sizes = np.array([len(v) for v in values])
        chains = Chains.of(sizes, self.binned(np.concatenate(values)), self.none)
        weight = np.maximum(1.0, np.concatenate([np.exp2(v[:, 0].astype(float)) - 1 for v in values]))
        sums = np.add.reduceat(np.stack([self.good(chains) * weight, weight], 1), chains.starts)
        return np.clip(sums[:, 0] / sums[:, 1], 0.0, 1.0)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def gradient(field: LineField, chains: Chains, good: np.ndarray) -> tuple[np.ndarray, np.ndarray, float, float]:
    """Slopes of the log likelihood of the labels by (weights, stay, prior), and the log likelihood."""
    forward, backward = field.passes(chains)
    own = field.odds(chains)
    off = good - sigmoid(forward + backward)
    by_weight = np.zeros_like(field.weights)
    for row in range(by_weight.shape[0]):
        by_weight[row] = np.bincount(chains.bins[:, row], off, minlength=by_weight.shape[1])
    first = np.ones(len(own), bool)
    first[chains.starts] = False
    later = np.flatnonzero(first)
    left, right = forward[later - 1], own[later] + backward[later]
    # the four ways two neighbours can be marked
    ways = np.stack([np.full(len(later), field.stay[0]), left, right, left + right + field.stay[1]])
    ways = np.exp(ways - ways.max(0)) if len(later) else ways
    ways = ways / ways.sum(0) if len(later) else ways
    both_good, both_bad = good[later] * good[later - 1], (1 - good[later]) * (1 - good[later - 1])
    by_stay = np.array([(both_bad - ways[0]).sum(), (both_good - ways[3]).sum()])
    # the sum over all markings, from the last line's odds and the weights of the paths marked bad
    total = np.zeros(len(own))
    total[later] = np.logaddexp(left, field.stay[0])
    bad_paths = total.sum()
    ends = chains.starts + chains.sizes - 1
    likelihood = (good * own).sum() + field.stay[1] * both_good.sum() + field.stay[0] * both_bad.sum()
    return by_weight, by_stay, float(off.sum()), float(likelihood - bad_paths - np.logaddexp(forward[ends], 0).sum())


def fitted(chains: Chains, good: np.ndarray, edges: list[np.ndarray], bins: int, steps: int, ridge: float) -> LineField:
    """Weights that make the labels likely, by gradient steps of adapted length; ``ridge`` pulls them to zero."""
    shape = (chains.bins.shape[1], bins + 1)
    field = LineField(edges, np.zeros(shape), np.zeros(2))
    # the prior is not pulled: lines of which little is known are as good as most
    point, pull = np.zeros(shape[0] * shape[1] + 3), np.full(shape[0] * shape[1] + 3, ridge)
    pull[-1] = 0.0
    slope, spread = np.zeros_like(point), np.zeros_like(point)
    for step in range(1, steps + 1 if len(good) else 1):
        by_weight, by_stay, by_prior, _ = gradient(field, chains, good)
        ascent = np.concatenate([by_weight.ravel(), by_stay, [by_prior]]) - pull * point
        slope = 0.9 * slope + 0.1 * ascent
        spread = 0.99 * spread + 0.01 * ascent**2
        rate = 0.2 * (1 - step / (steps + 1))
        point = point + rate * (slope / (1 - 0.9**step)) / (np.sqrt(spread / (1 - 0.99**step)) + 1e-8)
        field = LineField(edges, point[:-3].reshape(shape), point[-3:-1], float(point[-1]))
    return field


def fit(
    docs: DataFrame,
    labels: DataFrame,
    key: str,
    text: str,
    label: str,
    training: Column,
    sample_rows: int = 4000,
    window_lines: int = 64,
    bins: int = 8,
    steps: int = 150,
    ridge: float = 0.1,
) -> LineField:
    """The field of the documents that ``labels`` (key, label 0 or 1) marks, of the labels where ``training`` holds."""
    marked = (
        labels.filter(training & F.col(key).isNotNull() & F.col(label).isNotNull())
        .groupBy(F.col(key).alias("marked"))
        .agg(F.min(label).cast("int").alias("good"))
        .orderBy(F.xxhash64("marked"), "marked")
        .limit(sample_rows)
    )
    # at most sample_rows ids
    rows = docs.join(F.broadcast(marked), F.col(key) == F.col("marked")).select(
        "good", F.xxhash64(key, text).alias("draw"), F.col(text).alias("text")
    )

    def windows(batches):
        for batch in batches:
            out = []
            for good, draw, value in zip(*(c.to_pylist() for c in batch.columns)):
                values = measured((value or "").encode().split(b"\n"))
                start = draw % max(1, len(values) - window_lines + 1)
                # one line on each side goes along for the features of neighbours
                low, high = max(0, start - 1), start + window_lines + 1
                out.append((good, draw, start - low, values[low:high].tobytes()))
            columns = zip(*out) if out else ((),) * 4
            arrays = [pa.array(c, k) for c, k in zip(columns, (pa.int32(), pa.int64(), pa.int32(), pa.binary()))]
            yield pa.RecordBatch.from_arrays(arrays, ["good", "draw", "lead", "lines"])

    drawn = limited(rows).mapInArrow(windows, "good int, draw long, lead int, lines binary")
    sample = drawn.orderBy("draw", "lines").limit(sample_rows).collect()
    pieces = [np.frombuffer(r.lines, np.float32).reshape(-1, len(MEASURES)) for r in sample]
    everything = np.concatenate(pieces) if pieces else np.zeros((0, len(MEASURES)), np.float32)
    shares = np.arange(1, bins) / bins
    # cut between distinct values, so that a value most lines share takes one bin only
    edges = [np.unique(np.quantile(np.unique(c), shares)) if len(c) else np.zeros(0) for c in everything.T]
    blank = LineField(edges, np.zeros((3 * len(MEASURES), bins + 1)), np.zeros(2))
    inner, before, after = [], [], []
    for row, piece in zip(sample, pieces):
        cut = blank.binned(piece)
        end = min(len(cut), row.lead + window_lines)
        none = np.full(len(MEASURES), blank.none, np.int16)
        inner.append(cut[row.lead : end])
        before.append(cut[row.lead - 1] if row.lead else none)
        after.append(cut[end] if end < len(cut) else none)
    sizes = np.array([len(i) for i in inner], int)
    flat = np.concatenate(inner) if inner else np.zeros((0, len(MEASURES)), np.int16)
    if not len(flat):
        return blank
    chains = Chains.of(sizes, flat, blank.none, np.stack(before), np.stack(after))
    good = np.repeat([1.0 if r.good == 1 else 0.0 for r in sample], sizes)
    return fitted(chains, good, edges, bins, steps, ridge)


def scores(docs: DataFrame, keys: list[str], text: str, field: LineField) -> DataFrame:
    """(keys, score) per row."""
    rows = docs.select(F.col(text).alias("__text"), *keys)

    def scored(batches):
        for batch in batches:
            found = field.score(batch.column(0).cast(pa.binary()).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(found, pa.float64())], [*keys, "score"])

    schema = T.StructType([*(docs.schema[k] for k in keys), T.StructField("score", T.DoubleType())])
    return limited(rows).mapInArrow(scored, schema)


def line_marks(text: str | None, field: LineField) -> list[tuple[str, float]]:
    """(line, probability of good) of each line of one text, to see what a score is made of."""
    lines = (text or "").encode().split(b"\n")
    chains = Chains.of(np.array([len(lines)]), field.binned(measured(lines)), field.none)
    return [(line.decode(), float(p)) for line, p in zip(lines, field.good(chains))]
