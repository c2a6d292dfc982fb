"""Toxicity by a support vector machine on a gapped-subsequence string kernel with Nyström landmarks.

The kernel of two sentences sums, over all ``ORDER``-letter subsequences that words of both hold within a
span of ``SPAN`` letters, ``DECAY`` to the power of both spans, so a letter left out or put in between
lowers a match but doesn't lose it; signs inside a word are skipped altogether, and single letters
apart by blanks are one word. It is divided by the norms that the sentences would have if none of their
subsequences occurred twice, which depend on the words' lengths alone. Sentences end at ``.!?``, a line's
end or after ``WORDS`` words.

The machine is trained on sentences with their documents' labels: all of a clean document are clean; of
a toxic one at least one is toxic, at first that whose subsequences occur most in toxic documents, then,
round by round, that which the machine ranks first; the clean sentences that it ranks first are used in
the next round. Landmarks are the words that count most in toxic and in clean sentences chosen so. As the machine
is linear in the landmarks' subsequences, all its weights fold into one table. A document's score is that of its
worst sentence, calibrated on the training documents.

Letters of any script count: texts beyond Latin-1 are composed, folded (NFKC, lower case) and their
letters lose accents to a Latin letter, or else are ``PER_LETTER`` symbols of a further alphabet of
``OTHERS``, by code point, so that letters of one alphabet never fall together; signs and accents are skipped as before.

Training reads at most ``per_class`` labelled documents of either class (1,000 by default), chosen
by a hash of the id, and never those with crc32(doc_id) mod 3 = 1. Of these, texts of one label whose least 3-word window, by hash,
is the same (near copies) count once. The first choice of sentences goes by subsequences that max(3, n/200) of the n toxic texts hold or more;
at most ``landmarks`` / 2 words of either class become landmarks; and of clean texts some four sentences each, evenly chosen, and
those that the machine ranks first in its rounds are trained on. Scoring reads whole texts.

Defined cases: a null or empty text, or one without letters, scores as a sentence that is like no
landmark; without labels of both classes all scores are the share of toxic labels, or 0; repeated
rows score alike, and of several texts of one labelled id the least is used for training; a null
doc_id counts as not held out; other columns are ignored.
"""

from __future__ import annotations

import itertools
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, replace
from functools import cached_property

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructType

from tidemark.llm.common import documents, mix, remainder, seeds, sliced

ORDER, SPAN, DECAY = 4, 6, 0.6
WORDS = 4  # of a sentence at most
MARKED = "àáâäåæçèéêëíîñóôöøùúûüß"  # letters of their own, besides a to z
OTHERS, PER_LETTER = 12, 2  # symbols for the letters of other scripts, and how many stand for one
EDGE = 27 + len(MARKED) + OTHERS  # stands before and after each word
LETTERS = EDGE + 1
_AT_ONCE = 50  # texts of which training makes letters at once
_OFFSETS = [(0, *c) for c in itertools.combinations(range(1, SPAN), ORDER - 1)]


def _classes() -> np.ndarray:
    """Latin-1 byte to letter, 0 for signs (skipped), 255 for white space; accents not in MARKED are dropped."""
    out = np.zeros(256, np.uint8)
    for b in range(256):
        low = chr(b).lower()
        base = unicodedata.normalize("NFKD", low)[:1]
        out[b] = 27 + MARKED.index(low) if low in MARKED else ord(base) - 96 if "a" <= base <= "z" else 0
    out[0x80 : 0x80 + OTHERS] = 27 + len(MARKED) + np.arange(OTHERS)
    out[[9, 10, 11, 12, 13, 32]] = 255
    return out


_CLASS = _classes()
_TURNS = seeds(64, "word")
_STOPS = np.isin(np.arange(256), list(b".!?\n"))
#: By the number of letters up to a word's end: what its subsequences from there on add to the squared norm.
_SQUARES = np.array([sum(DECAY ** (2 * (o[-1] + 1)) for o in _OFFSETS if o[-1] < room) for room in range(SPAN + 1)], np.float32)
_LEAST = DECAY ** (2 * ORDER)  # of a squared norm


class _Folded(dict):
    """For str.translate: characters beyond Latin-1 as Latin letters, symbols of the further alphabet (private characters), a blank or nothing."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        low = c if code < 256 else "".join(unicodedata.normalize("NFKC", c).lower().split())
        self[code] = out = "" if 0x80 <= code < 0xA0 else c if code < 256 else " " if c.isspace() else "".join(map(_symbols, low))
        return out


def _symbols(c: str) -> str:
    base = unicodedata.normalize("NFKD", c)[:1]
    if ord(c) < 256 or "a" <= base <= "z":
        return c if ord(c) < 256 else base
    if not (c.isalpha() or unicodedata.category(c)[0] == "M" and not unicodedata.combining(c)):
        return ""
    return "".join(chr(_OTHER + ord(c) // OTHERS**k % OTHERS) for k in range(PER_LETTER))


_OTHER = 0x80  # control characters of Latin-1, which are no letters in a text, stand for the further alphabet
_FOLDED = _Folded()
_CONTROLS = bytes(range(0x80, 0xA0))


def folded(text: str) -> bytes:
    """A text in Latin-1, as ``letters`` reads it."""
    try:
        return text.encode("latin-1").translate(None, _CONTROLS)  # these are skipped in any case
    except UnicodeEncodeError:
        return unicodedata.normalize("NFC", text).translate(_FOLDED).encode("latin-1")


@dataclass
class Letters:
    """Letters of all words one after another, with an edge before and after each word."""

    code: np.ndarray
    words: np.ndarray  # start of each word
    sentences: np.ndarray  # number of the first word of each sentence
    owner: np.ndarray  # text of each sentence

    def starts(self) -> np.ndarray:
        """Start of each sentence."""
        return self.words[self.sentences]

    def sums(self, values: np.ndarray) -> np.ndarray:
        return np.add.reduceat(values, self.starts()) if len(self.words) else np.zeros(0, values.dtype)

    def room(self) -> np.ndarray:
        """Letters from each on to its word's end."""
        n = np.diff(np.append(self.words, len(self.code)))
        return np.repeat(n, n) - (np.arange(len(self.code)) - np.repeat(self.words, n))

    def only(self, sentences: np.ndarray) -> Letters:
        """Some of the sentences, in their order."""
        mark = np.zeros(len(self.sentences), bool)
        mark[sentences] = True
        of = np.diff(np.append(self.sentences, len(self.words)))
        word = np.repeat(mark, of)
        n = np.diff(np.append(self.words, len(self.code)))
        return Letters(self.code[np.repeat(word, n)], np.cumsum(n[word]) - n[word], np.cumsum(of[mark]) - of[mark], self.owner[mark])

    def norms(self) -> np.ndarray:
        return np.sqrt(np.maximum(self.sums(_SQUARES[np.minimum(self.room(), SPAN)]), _LEAST))


def letters(texts: list[str | None]) -> Letters:
    raw = [folded(t or "") + b"\n" for t in texts]
    data = np.frombuffer(b"".join(raw), np.uint8)
    code = _CLASS[data]
    place = np.flatnonzero((code != 0) & (code != 255))
    word = np.cumsum(code == 255, dtype=np.int32)[place]
    code = code[place].astype(np.int32)
    starts = np.flatnonzero(np.diff(word, prepend=-1))
    text = np.searchsorted(np.cumsum([len(r) for r in raw]), place[starts], "right")
    single = np.diff(np.append(starts, len(code))) == 1
    joins = np.zeros(len(starts), bool)
    joins[1:] = single[1:] & single[:-1] & (text[1:] == text[:-1])  # letters apart by blanks
    starts, text = starts[~joins], text[~joins]
    stop = np.cumsum(_STOPS[data], dtype=np.int32)[place[starts]]
    changed = np.diff(stop, prepend=-1) != 0
    first = np.flatnonzero(changed)
    rank = np.arange(len(starts)) - np.repeat(first, np.diff(np.append(first, len(starts))))
    begins = changed | (rank % WORDS == 0)
    ends = np.append(starts[1:], len(code)) if len(starts) else starts
    # A word counts once in a sentence.
    sizes = ends - starts
    turn = _TURNS[(np.arange(len(code)) - np.repeat(starts, sizes)) % len(_TURNS)]
    with np.errstate(over="ignore"):
        name = np.add.reduceat((code + 1).astype(np.uint64) * turn, starts) if len(starts) else turn[:0]
        _, once = np.unique(mix(name + np.cumsum(begins).astype(np.uint64) * _TURNS[0]), return_index=True)
    stay = np.zeros(len(starts), bool)
    stay[once] = True  # the first of equal words, so each sentence's first word stays
    code = code[np.repeat(stay, sizes)]
    sentences, text, sizes = np.flatnonzero(begins[stay]), text[stay], sizes[stay]
    ends = np.cumsum(sizes)
    starts = ends - sizes
    edged = np.insert(code, np.sort(np.concatenate([starts, ends])), EDGE)
    return Letters(edged, starts + 2 * np.arange(len(starts)), sentences, text[sentences])


def subsequences(some: Letters, letters_: int = LETTERS) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
    """For each choice of gaps: places where it stays in one word, their subsequences of so many letters, the weight."""
    room = some.room()
    for offsets in _OFFSETS:
        at = np.flatnonzero(room > offsets[-1])
        key = np.zeros(len(at), np.int32)
        for o in offsets:
            key = key * letters_ + some.code[at + o]
        yield at, key, DECAY ** (offsets[-1] + 1)


def weighed(some: Letters, table: np.ndarray, letters_: int = LETTERS) -> np.ndarray:
    """The table's weights of the subsequences that start at each letter."""
    total = np.zeros(len(some.code), np.float32)
    for at, key, weight in subsequences(some, letters_):
        total[at] += table[key] * np.float32(weight)
    return total


def sentence_scores(some: Letters, table: np.ndarray, letters_: int = LETTERS) -> np.ndarray:
    """The inner product of the table and each sentence's features."""
    return some.sums(weighed(some, table, letters_)) / some.norms()


def features(some: Letters, keys: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(sentence, place in the sorted keys, weight over the norm) of the sentences' subsequences that are among keys."""
    norms, starts = some.norms(), some.starts()
    for at, key, weight in subsequences(some):
        place = np.minimum(np.searchsorted(keys, key), max(0, len(keys) - 1))
        hit = np.flatnonzero(keys[place] == key) if len(keys) else np.zeros(0, np.int64)
        own = np.searchsorted(starts, at[hit], "right") - 1
        yield own, place[hit], weight / norms[own]


def mapped(some: Letters, keys: np.ndarray, into: np.ndarray) -> np.ndarray:
    """The sentences' features times a matrix with a row for each of the keys."""
    out, into = np.zeros((len(some.sentences), into.shape[1])), into.astype(np.float32)
    for own, place, weight in features(some, keys):
        order = np.argsort(own, kind="stable")
        for k in range(0, len(order), 20_000):
            part = order[k : k + 20_000]
            edges = np.flatnonzero(np.diff(own[part], prepend=-1))
            out[own[part[edges]]] += np.add.reduceat(into[place[part]] * weight[part, None].astype(np.float32), edges)
    return out


@dataclass
class Model:
    """Weights of some subsequences; all others have none."""

    keys: np.ndarray
    weights: np.ndarray
    bias: float
    slope: float
    shift: float

    @cached_property
    def table(self) -> tuple[np.ndarray, np.ndarray, int]:
        """A number for each letter, 0 for those in no subsequence that has a weight; the weights by these numbers; and their count."""
        digits = self.keys[:, None] // LETTERS ** np.arange(ORDER)[::-1] % LETTERS
        used = np.unique(digits)
        rank = np.zeros(LETTERS, np.int32)
        rank[used] = np.arange(1, len(used) + 1)
        out = np.zeros((len(used) + 1) ** ORDER, np.float32)
        out[rank[digits] @ (len(used) + 1) ** np.arange(ORDER)[::-1]] = self.weights
        return rank, out, len(used) + 1

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "table"}  # each worker makes its own

    def scores(self, texts: list[str | None]) -> np.ndarray:
        some = letters(texts)
        worst = np.full(len(texts), self.bias)
        if len(some.owner):
            first = np.flatnonzero(np.diff(some.owner, prepend=-1))
            rank, table, count = self.table
            worst[some.owner[first]] = np.maximum.reduceat(sentence_scores(replace(some, code=rank[some.code]), table, count), first) + self.bias
        return 1 / (1 + np.exp(-np.clip(self.slope * worst + self.shift, -40, 40)))


def _squared_hinge(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float) -> np.ndarray:
    """Linear support vector machine in the primal, by Newton steps over the support vectors."""
    x = np.hstack([x, np.ones((len(x), 1))])
    keep = np.eye(x.shape[1]) * ridge
    w = np.zeros(x.shape[1])
    for _ in range(30):
        active = y * (x @ w) < 1
        xa = x[active]
        new = np.linalg.solve(keep + (xa * weight[active, None]).T @ xa, xa.T @ (weight[active] * y[active]))
        if np.allclose(new, w, atol=1e-6):
            break
        w = new
    return w


def _platt(f: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve of the labels over f."""
    a, b = 1.0, 0.0
    n1, n0 = y.sum(), len(y) - y.sum()
    goal = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(a * f + b, -40, 40)))
        g = np.array([((p - goal) * f).sum(), (p - goal).sum()]) + 1e-3 * np.array([a, 0])
        q = p * (1 - p) + 1e-9
        h = np.array([[(q * f * f).sum() + 1e-3, (q * f).sum()], [(q * f).sum(), q.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        size = max(1.0, np.abs(step).max())
        a, b = a - step[0] / size, b - step[1] / size
        if np.abs(step).max() < 1e-6:
            break
    return float(a), float(b)


def _shares(texts: list[str]) -> np.ndarray:
    """For each subsequence, the number of texts that hold it."""
    out = np.zeros(LETTERS**ORDER, np.uint16)
    for t in texts:
        out[np.unique(np.concatenate([key for _, key, _ in subsequences(letters([t]))]))] += 1
    return out


def _worst(some: Letters, scores: np.ndarray) -> np.ndarray:
    """The first-ranked sentence of each text that has any."""
    order = np.lexsort((-scores, some.owner))
    return order[np.flatnonzero(np.diff(some.owner[order], prepend=-1))]


def _marks(some: Letters, sentences: np.ndarray, value: np.ndarray, count: int) -> list[bytes]:
    """The words with the largest value in the sentences, those of most sentences first."""
    found: Counter[bytes] = Counter()
    by_word = np.add.reduceat(value, some.words) / np.sqrt(np.maximum(np.add.reduceat(_SQUARES[np.minimum(some.room(), SPAN)], some.words), _LEAST))
    ends, last = np.append(some.words[1:], len(some.code)), np.append(some.sentences[1:], len(some.words))
    for s in sentences.tolist():
        w = some.sentences[s] + int(np.argmax(by_word[some.sentences[s] : last[s]]))
        found[some.code[some.words[w] : ends[w]].tobytes()] += 1
    return [w for w, _ in sorted(found.items(), key=lambda x: (-x[1], x[0]))[:count]]


def _joined(words: list[bytes]) -> Letters:
    """Each word as a sentence."""
    each = [np.frombuffer(w, np.int32) for w in words]
    starts = np.cumsum([len(w) for w in each]) - [len(w) for w in each]
    return Letters(np.concatenate(each), starts, np.arange(len(each)), np.arange(len(each)))


def train(texts: list[str], toxic: list[int], landmarks: int = 256, rounds: int = 4, ridge: float = 0.1) -> Model:
    share = sum(toxic) / len(toxic) if toxic else 0.0
    flat = Model(np.zeros(0, np.int64), np.zeros(0, np.float32), 0.0, 0.0, float(np.log(share / (1 - share))) if 0 < share < 1 else 40.0 if share == 1 else -40.0)
    if len(set(toxic)) < 2:
        return flat
    once: dict[tuple[int, int], str] = {}
    for t, label in zip(texts, toxic, strict=True):  # near copies count once: those with the same least 3-word window
        words = t.lower().split()
        once.setdefault((label, min((hash_of(w) for w in zip(words, words[1:], words[2:], strict=False)), default=hash_of(tuple(words)))), t)
    bad, clean = ([t for (label, _), t in once.items() if label == c] for c in (1, 0))
    some = [_letters(bad), _letters(clean)]
    if not all(len(x.words) for x in some):
        return flat
    n1, n0 = _shares(bad), _shares(clean)
    often = np.flatnonzero(n1 >= max(3, len(bad) // 200))
    value = np.log((n1[often] + 0.5) / (len(bad) + 1)) - np.log((n0[often] + 0.5) / (len(clean) + 1))
    del n1, n0
    table = np.zeros(LETTERS**ORDER, np.float32)
    table[often] = np.maximum(value, 0) ** 2
    first = [x.sums(weighed(x, table)) / x.norms() for x in some]
    chosen = [_worst(x, f) for x, f in zip(some, first, strict=True)]
    marks = _joined(list(dict.fromkeys(w for x, c in zip(some, chosen, strict=True) for w in _marks(x, c, weighed(x, table), landmarks // 2))))
    keys = np.unique(np.concatenate([key for _, key, _ in subsequences(marks)]))
    phi = np.zeros((len(marks.words), len(keys)))
    for own, place, weight in features(marks, keys):
        np.add.at(phi, (own, place), weight)
    values, vectors = np.linalg.eigh(phi @ phi.T)
    good = values > 1e-6
    into = phi.T @ (vectors[:, good] / np.sqrt(values[good]))  # from subsequences to Nyström features
    extra = np.flatnonzero(np.arange(len(some[1].sentences)) % max(1, len(some[1].sentences) // (4 * len(clean))) == 0)  # evenly, some four sentences of a text
    against = np.unique(np.concatenate([chosen[1], extra]))
    x = mapped(some[1].only(against), keys, into)
    w = np.zeros(into.shape[1] + 1)
    for turn in range(rounds):
        own = mapped(some[0].only(chosen[0]), keys, into)
        sign = np.r_[np.ones(len(own)), -np.ones(len(x))]
        weight = np.r_[np.full(len(own), len(x) / len(own)), np.ones(len(x))]
        w = _squared_hinge(np.concatenate([own, x]), sign, weight, ridge * len(x) / 1000)
        table[:] = 0
        table[keys] = into @ w[:-1]
        if turn < rounds - 1:
            chosen = [_worst(k, sentence_scores(k, table)) for k in some]
            more = np.setdiff1d(chosen[1], against)
            against = np.concatenate([against, more])
            x = np.concatenate([x, mapped(some[1].only(more), keys, into)])
    del table, x, some
    model = Model(keys, (into @ w[:-1]).astype(np.float32), float(w[-1]), 1.0, 0.0)
    p = np.concatenate([model.scores(texts[k : k + _AT_ONCE]) for k in range(0, len(texts), _AT_ONCE)])
    slope, shift = _platt(-np.log(1 / np.clip(p, 1e-12, 1 - 1e-12) - 1), np.array(toxic))
    return Model(keys, model.weights, model.bias, slope, shift) if slope > 0 else flat


def _letters(texts: list[str]) -> Letters:
    """As letters, some texts at a time, so that what is needed on the way stays small."""
    parts = [letters(texts[k : k + _AT_ONCE]) for k in range(0, len(texts), _AT_ONCE)]
    ahead = lambda sizes: np.cumsum([0, *sizes])[:-1].tolist()
    codes, words = ahead(len(x.code) for x in parts), ahead(len(x.words) for x in parts)
    return Letters(
        np.concatenate([x.code for x in parts]), np.concatenate([x.words + k for x, k in zip(parts, codes, strict=True)]),
        np.concatenate([x.sentences + k for x, k in zip(parts, words, strict=True)]), np.concatenate([x.owner + _AT_ONCE * k for k, x in enumerate(parts)]),
    )


def hash_of(words: tuple[str, ...]) -> int:
    return xxhash.xxh3_64_intdigest(" ".join(words).encode("utf-8", "surrogatepass"))


def labelled(docs: DataFrame, labels: DataFrame, per_class: int) -> tuple[list[str], list[int]]:
    """Texts and labels of at most per_class documents of either class, none of them held out."""
    rows = labels.select(F.col("doc_id").cast("long"), F.col("toxic").cast("int")).filter("toxic in (0, 1) and doc_id is not null").filter(remainder("doc_id", 3) != 1).distinct()
    chosen = [rows.filter(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for c in (0, 1)]
    picked = {r["doc_id"]: r["toxic"] for c in chosen for r in c.collect()}
    spark = docs.sparkSession
    ids = F.broadcast(spark.createDataFrame([(i,) for i in picked] or [(-1,)], "_id long"))  # 2 * per_class ids at most
    found = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(ids, F.col("doc_id") == F.col("_id"), "left_semi").filter("text is not null")
    found = sorted(tuple(r) for r in found.groupBy("doc_id").agg(F.min("text")).collect())
    return [t for _, t in found], [picked[i] for i, _ in found]


def scored(docs: DataFrame, labels: DataFrame, per_class: int = 1000, name: str = "toxicity") -> DataFrame:
    """docs with a further column, 0 to 1; docs must have no column of that name."""
    model = docs.sparkSession.sparkContext.broadcast(train(*labelled(docs, labels, per_class)))

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sliced(batches, limit=1 << 19):
            yield part.append_column(name, pa.array(model.value.scores(part.column("text").to_pylist())))

    return docs.mapInArrow(score, StructType(list(docs.schema.fields)).add(name, DoubleType()))


def op8_subsequence_svm(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scored(documents(spark, sf_dir).select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return out.select("doc_id", (remainder("doc_id", 3) == 1).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.7).cast("int").alias("predicted"))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that score 0.7 or more go."""
    name = max(["toxicity", *docs.columns], key=len) + "_"  # no column of docs is called that
    return scored(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), name=name).filter(F.col(name) < 0.7).select(docs.columns)


QUERIES = {"op8_subsequence_svm": op8_subsequence_svm}
SQL: dict[str, str] = {}
