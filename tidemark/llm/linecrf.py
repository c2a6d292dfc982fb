"""Line quality by a linear-chain conditional random field.

Each line with a word is good or bad. A line's features are numbers computed from its bytes and words (shares of
signs, capitals, digits, repeated windows of words, and so on), its neighbours' likewise; a chain over a document's
lines has a weight for each pair of labels that follow each other. A document's score is the mean of its lines' marginals (forward and backward
over the chain) for "good", weighted by their words, on the labels' scale by a logistic curve.

Only documents are labelled, so in training each line bears its document's label. The likelihood is
maximised by limited-memory BFGS; each step's likelihood and gradient are summed by Spark over the
training lines, which stay in the executors, and every document weighs as much as any other of its class. The
penalty ``ridge``, ``pairs`` times as much for pairs of labels, keeps their weights small, though labels never change
inside a training document, so that good and bad lines of one text are told apart.

Training reads at most ``per_class`` labelled documents of either class (2,000 by default), the first by a
hash of the id, and never those with crc32(doc_id) mod 4 = 2; the curve weighs them as the labels that could be read.

Defined cases: a text without lines (null, empty or blank) is one line without words; without labels of
both classes all scores are the share of good labels, or 0.5; repeated rows score alike; of several texts of one labelled id each is used
for training; an id with both labels is not; a null doc_id counts as not held out; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructType

from tidemark.llm.common import documents, mix, remainder, sliced, stash

_CHARACTERS = {"sign": b"#$%&*|<>@^~=+{}[]\\/_", "upper": bytes(range(65, 91)), "lower": bytes(range(97, 123)), "digit": bytes(range(48, 58)), "point": b".,;:!?'\"()-", "call": b"!", "stop": b".!?", "blank": b" \t\x0b\x0c\r", "high": bytes(range(128, 256)), "control": bytes([*range(9), *range(14, 32), 127])}
NAMES = (
    ["words", "bytes", "word length", "repeated windows", "same as word before", "distinct words", "seen line", "stops", "capital first", "words with signs", "no word"]
    + [f"{how} {c}" for c in ("sign", "upper", "digit", "point", "call", "high", "control") for how in ("share", "root")]
)
WIDTH = len(NAMES)
SIZE = 3 * WIDTH + 3 + 4  # own, before, after; first, last, bias; pairs of labels
_SPACES = np.isin(np.arange(256), list(b" \t\n\x0b\x0c\r"))
_IS = {k: np.isin(np.arange(256), list(v)) for k, v in _CHARACTERS.items()}


@dataclass
class Lines:
    """Lines of several texts, one after another."""

    features: np.ndarray
    words: np.ndarray
    number: np.ndarray  # of the line in its text, from 0
    starts: np.ndarray  # first line of each text

    @property
    def first(self) -> np.ndarray:
        out = np.zeros(len(self.words), bool)
        out[self.starts] = True
        return out

    @property
    def last(self) -> np.ndarray:
        return np.append(self.first[1:], True)


def _hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each of the byte ranges: its bytes times powers of a constant, summed and mixed."""
    base = np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        n = int((ends - starts).max(initial=0))
        powers = np.concatenate([np.ones(1, np.uint64), np.full(max(n, 1), base, np.uint64)]).cumprod(dtype=np.uint64)
        sizes = ends - starts
        inside = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        letters = data[np.repeat(starts, sizes) + inside].astype(np.uint64) + np.uint64(1)
        return mix(np.add.reduceat(letters * powers[inside], np.cumsum(sizes) - sizes)) if len(starts) else np.zeros(0, np.uint64)


def _repeats(keys: np.ndarray) -> np.ndarray:
    """True for each key that another one equals."""
    order = np.argsort(keys, kind="stable")
    same = np.diff(keys[order]) == 0
    out = np.zeros(len(keys), bool)
    out[order[1:]] |= same
    out[order[:-1]] |= same
    return out


def _again(keys: np.ndarray) -> np.ndarray:
    """True for each key that an earlier one equals."""
    order = np.argsort(keys, kind="stable")
    out = np.zeros(len(keys), bool)
    out[order[1:]] = np.diff(keys[order]) == 0
    return out


def lines(texts: list[str | None]) -> Lines:
    """The lines with a word of each text; of a text without any, one empty line."""
    raw = [(t or "").encode("utf-8", "surrogatepass") + b"\n" for t in texts]
    data = np.frombuffer(b"".join(raw), np.uint8)
    ends = np.flatnonzero(data == 10)
    starts = np.append(0, ends[:-1] + 1)
    text = np.searchsorted(np.cumsum([len(r) for r in raw]), starts, "right")
    letter = ~_SPACES[data]
    begins = np.flatnonzero(letter & ~np.append(False, letter[:-1]))
    stops = np.flatnonzero(letter & ~np.append(letter[1:], False)) + 1
    line_of = np.searchsorted(starts, begins, "right") - 1
    n_words = np.bincount(line_of, minlength=len(starts))
    number = np.arange(len(starts)) - np.searchsorted(text, text)
    # Lines with a word, and the first of texts that have none.
    filled = np.bincount(text, n_words, minlength=len(texts)) > 0
    keep = (n_words > 0) | (~filled[text] & (number == 0))
    place = np.cumsum(keep) - 1
    line_of, starts, ends, text, number, n_words = place[line_of], starts[keep], ends[keep], text[keep], number[keep], n_words[keep]
    m = len(starts)

    word = _hashes(data, begins, stops)
    owner = text[line_of].astype(np.uint64)
    with np.errstate(over="ignore"):
        named = mix(word + owner * np.uint64(0xD1342543DE82EF95))
        windows = mix(named[:-2] + mix(named[1:-1] + mix(named[2:] + np.uint64(1)))) if len(word) > 2 else np.zeros(0, np.uint64)
        whole = (owner[2:] == owner[:-2]) if len(word) > 2 else np.zeros(0, bool)
    inside = np.zeros(len(word), bool)
    found = np.flatnonzero(whole)
    found = found[_repeats(windows[found])]
    for k in range(3):
        inside[found + k] = True
    before = np.zeros(len(word), bool)
    before[1:] = (word[1:] == word[:-1]) & (line_of[1:] == line_of[:-1])
    with np.errstate(over="ignore"):
        distinct = ~_again(mix(word + line_of.astype(np.uint64) * np.uint64(0xA24BAED4963EE407)))
    per = lambda flag: np.bincount(line_of, flag, minlength=m) / np.maximum(n_words, 1)
    first_word = np.searchsorted(line_of, np.arange(m))
    line_hash = np.zeros(m, np.uint64)
    if len(word):
        rank = np.arange(len(word)) - first_word[line_of]
        with np.errstate(over="ignore"):
            has = n_words > 0
            sums = np.add.reduceat(mix(named + rank.astype(np.uint64)), first_word[has])
        line_hash[has] = sums
    seen = _again(line_hash) & (n_words > 0)

    total = np.maximum(ends - starts, 1)
    count = lambda name: _ranges(_IS[name][data], starts, ends)
    counts = {k: count(k) for k in ("sign", "upper", "lower", "digit", "point", "call", "high", "control")}
    sized = np.maximum(total - count("blank"), 1)
    cased = np.maximum(counts["upper"] + counts["lower"], 1)
    share = {k: counts[k] / (cased if k == "upper" else sized) for k in ("sign", "upper", "digit", "point", "call", "high", "control")}
    last = data[np.maximum(stops[np.maximum(first_word + n_words - 1, 0)] - 1, 0)] if len(stops) else np.zeros(m, np.uint8)
    head = data[begins[np.minimum(first_word, len(begins) - 1)]] if len(begins) else np.zeros(m, np.uint8)
    signed = _ranges(_IS["sign"][data], begins, stops) > 0
    rows = [
        np.log1p(n_words) / 5, np.log1p(total) / 7, np.minimum(sized / np.maximum(n_words, 1), 50) / 10, per(inside), per(before), per(distinct), seen, _IS["stop"][last] & (n_words > 0),
        _IS["upper"][head] & (n_words > 0), per(signed), n_words == 0,
    ]
    rows += [f(share[c]) for c in ("sign", "upper", "digit", "point", "call", "high", "control") for f in (lambda v: v, np.sqrt)]
    return Lines(np.array(rows, np.float32).T, n_words, number, np.searchsorted(text, np.arange(len(texts))))


def _ranges(flag: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """How often the flag is set in each range."""
    upto = np.append(0, np.cumsum(flag, dtype=np.int32))
    return upto[ends] - upto[starts]


def _shifted(some: Lines) -> tuple[np.ndarray, np.ndarray]:
    """For each line, the one before and the one after, or the place past the end where there is none."""
    at, none = np.arange(len(some.words)), len(some.words)
    return np.where(some.first, none, at - 1), np.where(some.last, none, at + 1)


def potentials(some: Lines, w: np.ndarray) -> np.ndarray:
    """What speaks for "good" in each line."""
    own, before, after = (some.features @ w[k * WIDTH : (k + 1) * WIDTH] for k in range(3))
    prior, later = _shifted(some)
    first, last, bias = w[3 * WIDTH : 3 * WIDTH + 3]
    return own + np.append(before, 0)[prior] + np.append(after, 0)[later] + first * some.first + last * some.last + bias


def _products(steps: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place the product of its chain's 2 x 2 matrices up to it, over its largest entry, and that entry's log; rank is the place in the chain.
    Doubling: the work grows with the log of the longest chain."""
    m = steps.copy()
    scale = m.max((1, 2))
    m /= scale[:, None, None]
    log = np.log(scale)
    reach = 1
    longest = int(rank.max(initial=0))
    while reach <= longest:
        at = np.flatnonzero(rank >= reach)
        product = m[at - reach] @ m[at]
        scale = product.max((1, 2))
        log_at = log[at] + log[at - reach] + np.log(scale)
        m[at], log[at] = product / scale[:, None, None], log_at
        reach *= 2
    return m, log


def marginals(some: Lines, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each line the probability that it is good; of each but a text's first, that it and the one before have each pair of labels; of each text the log of the sum over all labellings."""
    u = potentials(some, w).astype(np.float64)
    pairs = w[-4:].reshape(2, 2)
    shift = np.maximum(u, 0)
    node = np.exp(np.stack([-shift, u - shift], 1))
    step = np.exp(pairs - pairs.max())[None] * node[:, None, :]
    step[some.first] = node[some.first][:, None, :] * np.array([[1.0], [0.0]])  # a chain starts in a row
    lengths = np.diff(np.append(some.starts, len(u)))
    rank = np.arange(len(u)) - np.repeat(some.starts, lengths)
    ahead, log = _products(step, rank)
    forward = ahead[:, 0, :]
    # Backward: the same over the chain in reverse, each matrix transposed.
    back = np.empty_like(step)
    ends = np.append(some.starts[1:], len(u)) - 1
    inner = np.flatnonzero(~some.last)
    back[inner] = step[inner + 1].transpose(0, 2, 1)
    back[ends] = np.array([[1.0, 1.0], [0.0, 0.0]])
    behind, _ = _products(back[::-1], (np.repeat(lengths, lengths) - 1 - rank)[::-1])
    backward = behind[::-1][:, 0, :]
    both = forward * backward
    good = both[:, 1] / both.sum(1)
    joint = forward[inner][:, :, None] * step[inner + 1] * backward[inner + 1][:, None, :]
    joint /= joint.sum((1, 2), keepdims=True)
    total = log[ends] + np.log(forward[ends].sum(1)) + np.add.reduceat(shift, some.starts) + (lengths - 1) * pairs.max()
    return good, joint, total


def likelihood(some: Lines, label: np.ndarray, weight: np.ndarray, w: np.ndarray) -> tuple[float, np.ndarray]:
    """The weighted sum of the log-likelihoods of texts whose lines all have the text's label, and its gradient."""
    lengths = np.diff(np.append(some.starts, len(some.words)))
    y, each = np.repeat(label, lengths), np.repeat(weight, lengths)
    good, joint, total = marginals(some, w)
    u, pairs = potentials(some, w), w[-4:].reshape(2, 2)
    value = float((weight * (np.add.reduceat(y * u, some.starts) + (lengths - 1) * pairs[label, label] - total)).sum())
    d = each * (y - good)
    grad = np.zeros(SIZE)
    prior, later = _shifted(some)
    d_prior, d_later = np.zeros(len(d) + 1), np.zeros(len(d) + 1)
    np.add.at(d_prior, prior, d)
    np.add.at(d_later, later, d)
    for k, v in enumerate((d, d_prior[:-1], d_later[:-1])):
        grad[k * WIDTH : (k + 1) * WIDTH] = v @ some.features
    grad[3 * WIDTH : 3 * WIDTH + 3] = d[some.first].sum(), d[some.last].sum(), d.sum()
    inner = np.flatnonzero(~some.last)
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[inner], y[inner]), each[inner])
    grad[-4:] = (seen - (joint * each[inner][:, None, None]).sum(0)).ravel()
    return value, grad


def lbfgs(f: Callable[[np.ndarray], tuple[float, np.ndarray]], x: np.ndarray, steps: int, kept: int = 8) -> np.ndarray:
    """A minimum of f, which gives value and gradient."""
    value, grad = f(x)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        q, alphas = grad.copy(), []
        for s, y in reversed(past):
            alphas.append(s @ q / (s @ y))
            q -= alphas[-1] * y
        q *= past[-1][0] @ past[-1][1] / (past[-1][1] @ past[-1][1]) if past else 1 / max(1.0, np.abs(grad).sum())
        for (s, y), a in zip(past, reversed(alphas), strict=True):
            q += (a - y @ q / (s @ y)) * s
        size = 1.0
        for _ in range(12):
            new = x - size * q
            new_value, new_grad = f(new)
            if new_value <= value - 1e-4 * size * (q @ grad):
                break
            size /= 3
        else:
            return x
        s, y = new - x, new_grad - grad
        if s @ y > 1e-12:
            past = [*past[-kept + 1 :], (s, y)]
        done = value - new_value < 1e-5 * max(1.0, abs(value))
        x, value, grad = new, new_value, new_grad
        if done:
            break
    return x


@dataclass
class Model:
    weights: np.ndarray
    slope: float
    shift: float

    def lines(self, texts: list[str | None]) -> tuple[Lines, np.ndarray]:
        some = lines(texts)
        return some, marginals(some, self.weights)[0]

    def raw(self, some: Lines) -> np.ndarray:
        """Of each text the logit of its lines' mean marginal."""
        good = marginals(some, self.weights)[0]
        weight = some.words + 1.0
        mean = np.add.reduceat(weight * good, some.starts) / np.add.reduceat(weight, some.starts)
        mean = np.clip(mean, 1e-4, 1 - 1e-4)
        return np.log(mean / (1 - mean))

    def scores(self, texts: list[str | None]) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.slope * self.raw(lines(texts)) + self.shift)))


def _curve(f: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve of the labels over f, by Newton steps."""
    w = np.array([1.0, 0.0])
    x = np.stack([f, np.ones(len(f))], 1)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        g = x.T @ (weight * (p - y)) + 1e-2 * w * [1, 0]
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag([1e-2, 1e-6])
        step = np.linalg.solve(h, g)
        w = w - step / max(1.0, np.abs(step).max())
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(w[1])


def _held(row: dict) -> Lines:
    return Lines(np.frombuffer(row["features"], np.float32).reshape(-1, WIDTH), np.frombuffer(row["words"], np.int64), np.zeros(0, np.int64), np.zeros(1, np.int64))


def _together(rows: list[dict]) -> Lines:
    parts = [_held(r) for r in rows]
    sizes = [len(p.words) for p in parts]
    return Lines(np.concatenate([p.features for p in parts]), np.concatenate([p.words for p in parts]), np.zeros(sum(sizes), np.int64), np.cumsum([0, *sizes[:-1]]))


def train(docs: DataFrame, labels: DataFrame, per_class: int = 2000, ridge: float = 1e-3, pairs: float = 30, steps: int = 60) -> Model:
    """Lines and sums stay with Spark; the driver holds the ids of the sample, the weights, and a number a sampled document for the curve."""
    spark = docs.sparkSession
    rows = labels.select(F.col("doc_id").cast("long").alias("_id"), F.col("quality").cast("int").alias("_y")).filter("_y in (0, 1) and _id is not null").filter(remainder("_id", 4) != 2)
    rows = rows.groupBy("_id").agg(F.min("_y").alias("_y"), F.max("_y").alias("_max")).filter("_y = _max").drop("_max")
    found = dict(rows.groupBy("_y").count().collect())
    if len(found) < 2:
        return Model(np.zeros(SIZE), 0.0, 0.0 if not found else 40.0 if 1 in found else -40.0)
    chosen = [rows.filter(F.col("_y") == c).orderBy(F.xxhash64("_id"), "_id").limit(per_class) for c in (0, 1)]
    sample = F.broadcast(chosen[0].union(chosen[1]))  # 2 * per_class rows at most

    def featured(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sliced(batches):
            some = lines(part.column("text").to_pylist())
            edges = np.append(some.starts, len(some.words))
            features, words = ([v[a:b].tobytes() for a, b in zip(edges, edges[1:], strict=False)] for v in (some.features, some.words.astype(np.int64)))
            yield pa.RecordBatch.from_arrays([part.column("_y"), pa.array(np.diff(edges)), pa.array(features, pa.binary()), pa.array(words, pa.binary())], names=["y", "n", "features", "words"])

    texts = docs.select(F.col("doc_id").cast("long").alias("_id"), F.col("text").cast("string").alias("text")).join(sample, "_id").select("_y", "text")
    held = stash(texts.mapInArrow(featured, "y int, n long, features binary, words binary").repartition(16), "crf-lines")
    weights = {r["y"]: 1 / (2 * r["docs"]) for r in held.groupBy("y").agg(F.count("*").alias("docs")).collect()}
    if len(weights) < 2:
        return Model(np.zeros(SIZE), 0.0, float(np.log((found[1] + 0.5) / (found[0] + 0.5))))

    def summed(w: np.ndarray) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            value, grad = 0.0, np.zeros(SIZE)
            for part in sliced(batches, "features", 1 << 22):
                rows_ = part.to_pylist()
                some, y = _together(rows_), np.array([r["y"] for r in rows_])
                n = np.array([r["n"] for r in rows_])
                v, g = likelihood(some, y, np.array([weights[k] for k in y.tolist()]) / n, w)
                value, grad = value + v, grad + g
            yield pa.RecordBatch.from_arrays([pa.array([value]), pa.array([grad.tolist()])], names=["value", "grad"])

        return each

    penalty = np.ones(SIZE)
    penalty[3 * WIDTH + 2] = 0
    penalty[-4:] = pairs

    def cost(w: np.ndarray) -> tuple[float, np.ndarray]:
        got = held.mapInArrow(summed(w), "value double, grad array<double>").collect()  # a row for each of the few partitions
        value, grad = sum(r["value"] for r in got), np.sum([r["grad"] for r in got], axis=0)
        return ridge * float(penalty @ (w * w)) / 2 - value, ridge * penalty * w - grad

    model = Model(lbfgs(cost, np.zeros(SIZE), steps), 1.0, 0.0)

    def means(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sliced(batches, "features", 1 << 22):
            yield pa.RecordBatch.from_arrays([part.column("y"), pa.array(model.raw(_together(part.to_pylist())))], names=["y", "f"])

    points = held.mapInArrow(means, "y int, f double").collect()  # per_class documents of either class
    y, f = np.array([r["y"] for r in points]), np.array([r["f"] for r in points])
    share = np.array([found[k] for k in (0, 1)]) / np.bincount(y, minlength=2)
    model.slope, model.shift = _curve(f, y, share[y] / share[y].mean())
    return model if model.slope > 0 else Model(np.zeros(SIZE), 0.0, float(np.log((found[1] + 0.5) / (found[0] + 0.5))))


def scored(docs: DataFrame, model: Model, name: str = "quality") -> DataFrame:
    """docs with a further column, 0 to 1; docs must have no column of that name."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # a few hundred weights

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sliced(batches):
            yield part.append_column(name, pa.array(held.value.scores(part.column("text").to_pylist())))

    return docs.mapInArrow(score, StructType(list(docs.schema.fields)).add(name, DoubleType()))


def line_labels(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, line (its number in the text, from 0), words, good (its marginal) for each line with a word."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def label(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sliced(batches):
            some, good = held.value.lines(part.column("text").to_pylist())
            own = np.repeat(np.arange(part.num_rows), np.diff(np.append(some.starts, len(some.words))))
            worded = np.flatnonzero(some.words > 0)
            yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(own[worded])), pa.array(some.number[worded]), pa.array(some.words[worded].astype(np.int64)), pa.array(good[worded])], names=["doc_id", "line", "words", "good"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(label, "doc_id long, line long, words long, good double")


def op11_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", F.col("text").cast("string").alias("text"))
    out = scored(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return out.select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), F.col("quality").alias("score"), (F.col("quality") >= 0.7).cast("int").alias("predicted"))


QUERIES = {"op11_line_crf": op11_line_crf}
SQL: dict[str, str] = {}
