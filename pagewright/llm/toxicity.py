"""Toxicity by a convolutional text classifier trained in numpy.

Words are hashed to 2**24 buckets, and the buckets that MIN_DOCS training documents hold have an
embedding of their own; other words take that of their first PREFIX letters, or else a fixed zero
embedding, so rare words can't collide with telling ones. Filters of widths 1, 2 and 3 slide over the whole text, each keeps its largest response
(max pooling), and a logistic layer weighs them. The first coordinate of an embedding starts at the
bucket's log odds, so that pooling finds the telling words from the first step. Training is Adam over
mini-batches with gradients through the pooled positions.

Each language gets a threshold on the logit, the one of best F1 on calibration documents that were not
trained on; scores are shifted so that a language's threshold becomes 0.7. A text's language is read
from its words' frequencies in the training texts of each language, not from the lang column.

Learning takes every labelled document, whole; of rows with one doc_id the smallest text, of clashing labels the
larger. Buckets, their documents and the words of each language are counted in Spark. Documents are dealt by a hash of doc_id
to shards of some SHARD_CHARS characters. In each of ROUNDS rounds all shards train the same net, each on its own documents, and the nets are
averaged: an embedding by the documents that hold it in each shard, the rest by all documents. One shard needs one round. The
thresholds' documents are a fourth, chosen by another hash; all are counted, by logit in steps of 1 / GRID. The driver gets
what the model keeps, MAX_ROWS embeddings and those counts, and no text. Languages with fewer than LEAST labelled documents of either kind can't have
a threshold of their own and are read as one. Empty and null texts score like a text of no telling words,
which lies below the threshold, whatever was learned. Without both labels every score is 0.
Prediction reads the text alone: repeated rows and rows with a null doc_id get what their text gets and are all
returned; other columns are not read. No rows in, no rows out.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.llm._common import arrow_batches, discard, hash_fraction, held_out, table, written

BUCKETS = 1 << 24
DIM, FILTERS, WIDTHS = 16, 16, (1, 2, 3)
MIN_DOCS = 3
MAX_ROWS = 200_000
SHARD_CHARS = 32_000_000
ROUNDS = 2
GRID = 1024
LEAST = 8
"""Documents of either kind that a threshold needs."""
OTHER = "other"
"""Stands last among a classifier's languages for those that have too few documents."""
SHRINK = 30
"""A language's threshold counts by its toxic calibration documents against this many at the common one."""
EPOCHS, BATCH, RATE, DECAY = 2, 64, 0.01, 1e-4
PREFIX = 5
LEAST_STEPS = 150
"""Small samples are gone over more often."""
THRESHOLD = 0.7
MARGIN = 0.05
"""By which a language's threshold on the logit lies above that of a text of no telling words, at least."""
CACHE = 300_000
PIECE = 200_000
"""Words that are looked up at once."""
STEP_WORDS = 1_000_000
"""Of a mini-batch, unless one document has more."""
SCALE = 1 << 24
"""Nets are averaged in whole numbers of 1 / SCALE, whose sums don't hang on their order."""
PAD = max(WIDTHS)
"""Zeros after each document: a window that starts at the first one, as an empty text's only one does, sees no other text."""
WORD = re.compile(r"[^\W_]+")


def words(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def bucket(word: str) -> int:
    return zlib.crc32(word.encode()) % BUCKETS


class Rows(dict):
    """Words to embedding rows: that of the word's bucket, else of its first letters', else 0. Words met are kept, CACHE at most."""

    def __init__(self, of: dict[int, int]):
        super().__init__()
        self.of = of

    def __missing__(self, word: str) -> int:
        row = self.of.get(bucket(word)) or self.of.get(bucket("^" + word[:PREFIX]), 0)
        if len(self) < CACHE:
            self[word] = row
        return row


class Net:
    """Embeddings, filters and the logistic layer; row 0 of the embeddings stays zero."""

    def __init__(self, odds: np.ndarray, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.p = {"e": rng.normal(0, 0.05, (len(odds), DIM)), "b": np.zeros(1), "o": rng.normal(0, 0.3, FILTERS * len(WIDTHS)), "c": np.zeros(FILTERS * len(WIDTHS))}
        self.p["e"][:, 0] = odds
        self.p["e"][0] = 0
        for w in WIDTHS:
            self.p[f"w{w}"] = rng.normal(0, 0.2, (w, DIM, FILTERS))
            self.p[f"w{w}"][:, 0, : FILTERS // 2] += 0.5 / w
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}
        self.begin()

    @classmethod
    def of(cls, p: dict[str, np.ndarray]) -> Net:
        """A net of these parameters."""
        net = cls.__new__(cls)
        net.p = p
        net.begin()
        return net

    def begin(self) -> None:
        self.m = {k: np.zeros_like(v) for k, v in self.p.items()}
        self.v = {k: np.zeros_like(v) for k, v in self.p.items()}
        self.t = 0

    def __getstate__(self) -> dict:
        return {"p": self.p}

    def __setstate__(self, state: dict) -> None:
        self.p, self.m, self.v = state["p"], None, None

    def tables(self) -> list[list[np.ndarray]]:
        """For each width and offset, every embedding's response: a position's response is a sum of look-ups."""
        return [[(self.p["e"] @ self.p[f"w{w}"][j]).astype(np.float32) for j in range(w)] for w in WIDTHS]

    @staticmethod
    def pooled(tables: list[list[np.ndarray]], ids: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Largest responses, a row a document, over windows that start in [start, end)."""
        out = []
        both = np.stack((starts, ends), 1).ravel()
        for offsets in tables:
            n = len(ids) - PAD
            r = sum(t[ids[j : n + j]] for j, t in enumerate(offsets))
            out.append(np.maximum.reduceat(r, both, axis=0)[::2])
        return np.concatenate(out, axis=1)

    def logits(self, pooled: np.ndarray) -> np.ndarray:
        return np.maximum(pooled + self.p["c"], 0) @ self.p["o"] + self.p["b"][0]

    def step(self, docs: list[np.ndarray], y: np.ndarray) -> None:
        """One Adam step on a batch of documents (row numbers) and labels."""
        ids, starts, ends = padded(docs)
        n = len(ids) - PAD
        used, of = np.unique(ids, return_inverse=True)
        rows = self.p["e"][used]
        best, at = [], []
        for w in WIDTHS:
            offsets = [rows @ self.p[f"w{w}"][j] for j in range(w)]
            most, top = np.full((len(docs), FILTERS), -np.inf, np.float32), np.zeros((len(docs), FILTERS), np.int64)
            for lo in range(0, n, PIECE):
                hi = min(lo + PIECE, n)
                r = sum(t[of[lo + j : hi + j]] for j, t in enumerate(offsets))
                for d in range(int(np.searchsorted(ends, lo, "right")), len(docs)):
                    a, b = max(starts[d], lo), min(ends[d], hi)
                    if a >= b:
                        break
                    own = r[a - lo : b - lo].argmax(0)
                    value = r[own + a - lo, np.arange(FILTERS)]
                    top[d], most[d] = np.where(value > most[d], own + a, top[d]), np.maximum(value, most[d])
            at.append(top)
            best.append(most)
        pooled = np.concatenate(best, axis=1)
        hidden = np.maximum(pooled + self.p["c"], 0)
        prob = 1 / (1 + np.exp(-np.clip(hidden @ self.p["o"] + self.p["b"][0], -30, 30)))
        d = ((prob - y) / len(y)).astype(np.float32)
        g = {k: np.zeros_like(v) for k, v in self.p.items() if k != "e"}
        g["o"], g["b"] = hidden.T @ d, np.array([d.sum()])
        dh = np.outer(d, self.p["o"]) * (pooled + self.p["c"] > 0)
        g["c"] = dh.sum(0)
        # only the batch's embeddings move
        ge = np.zeros((len(used), DIM), np.float32)
        for k, w in enumerate(WIDTHS):
            part = dh[:, k * FILTERS : (k + 1) * FILTERS]
            for j in range(w):
                g[f"w{w}"][j] = np.einsum("df,dfe->ef", part, rows[of[at[k] + j]])
                np.add.at(ge, of[at[k] + j], part[:, :, None] * self.p[f"w{w}"][j].T[None])
        g["e"] = ge
        self.t += 1
        for k, v in self.p.items():
            own = used if k == "e" else slice(None)
            grad = g[k] + DECAY * v[own]
            self.m[k][own] = m = 0.9 * self.m[k][own] + 0.1 * grad
            self.v[k][own] = s = 0.999 * self.v[k][own] + 0.001 * grad**2
            v[own] -= RATE * (m / (1 - 0.9**self.t)) / (np.sqrt(s / (1 - 0.999**self.t)) + 1e-8)
        self.p["e"][0] = 0


def padded(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All documents in one array with PAD zeros after each (and at the end), where each starts, and where its windows cease to start."""
    gap = np.zeros(PAD, np.int64)
    sizes = np.array([len(d) for d in docs])
    starts = np.cumsum(sizes + PAD) - sizes - PAD
    return np.concatenate([x for d in docs for x in (d, gap)] + [gap]), starts, starts + sizes + 1


def own_buckets(ws: list[str]) -> set[int]:
    """The buckets of a text's words and of their first letters."""
    return {b for w in set(ws) for b in (bucket(w), bucket("^" + w[:PREFIX]))}


def log_odds(seen: np.ndarray, bad: np.ndarray, n: int, n1: int) -> np.ndarray:
    """Of each kept bucket, from the documents and toxic documents that hold it; row 0 has none."""
    return np.concatenate(([0.0], np.log((bad + 0.5) / (n1 + 1)) - np.log((seen - bad + 0.5) / (n - n1 + 1))))


def start(odds: np.ndarray) -> Net:
    return Net(np.clip(odds, -2, 4) / 2)


def fit(net: Net, ids: list[np.ndarray], y: np.ndarray, rounds: int = 1, seed: int = 11) -> None:
    """A round of training on documents (row numbers) and labels."""
    rng = np.random.default_rng(seed)
    epochs = max(EPOCHS, -(-LEAST_STEPS * BATCH // max(1, len(ids))))
    for _ in range(-(-epochs // rounds)):
        order = rng.permutation(len(ids))
        k = 0
        while k < len(order):
            size = np.cumsum([len(ids[i]) for i in order[k : k + BATCH]])
            part = order[k : k + max(1, int(np.searchsorted(size, STEP_WORDS, "right")))]
            net.step([ids[i] for i in part], y[part])
            k += len(part)


def languages(labelled: dict[str, tuple[int, int]]) -> list[str]:
    """The languages to tell apart, from the documents and toxic documents of each."""
    own = sorted(lang for lang, (n, bad) in labelled.items() if min(bad, n - bad) >= LEAST)
    return own + [OTHER] * (len(own) < len(labelled))


class Classifier:
    """A trained net with its buckets, languages and thresholds; score() takes texts.

    From samples in hand it is trained here; train() trains one in Spark.
    """

    def __init__(self, samples: list[tuple[str, str | None, int]]):
        """samples: (text, lang, toxic)."""
        by_lang = {lang: [y for _, of, y in samples if of == lang] for lang in {s[1] for s in samples} - {None}}
        self.langs = languages({lang: (len(ys), sum(ys)) for lang, ys in by_lang.items()})
        self.trained = len({y for _, _, y in samples}) == 2
        if not self.trained:
            return
        found = [words(t) for t, _, _ in samples]
        y = np.array([s[2] for s in samples], float)
        seen, bad = Counter(), Counter()
        for ws, label in zip(found, y, strict=True):
            own = own_buckets(ws)
            seen.update(own)
            if label:
                bad.update(own)
        kept = [b for b, n in sorted(seen.items(), key=lambda x: (-x[1], x[0]))[:MAX_ROWS] if n >= MIN_DOCS]
        self.of = {b: i + 1 for i, b in enumerate(kept)}
        n1, n = y.sum(), len(y)
        rows = Rows(self.of)
        ids = [np.fromiter(map(rows.__getitem__, ws), np.int64, len(ws)) for ws in found]
        place = self.places()
        counts = np.zeros((len(kept) + 1, len(self.langs)))
        for own, (_, lang, _) in zip(ids, samples, strict=True):
            if lang is not None:
                np.add.at(counts[:, place(lang)], own, 1)
        self.read(counts)
        check = np.arange(n) % 4 == 3
        self.net = start(log_odds(np.array([seen[b] for b in kept]), np.array([bad[b] for b in kept]), n, n1))
        train = np.flatnonzero(~check)
        fit(self.net, [ids[i] for i in train], y[train])
        self.tables = self.net.tables()
        z, lang = self._logits(ids)
        self.threshold(z[check], y[check], lang[check], 1, lambda: self._cut(z, y, 0.0))
        self.net.m = self.net.v = None

    def places(self):
        """The place of a language among those told apart."""
        at, rest = {lang: k for k, lang in enumerate(self.langs) if k + 1 < len(self.langs) or lang != OTHER}, len(self.langs) - 1
        return lambda lang: at.get(lang, rest)

    def read(self, counts: np.ndarray) -> None:
        """The language reader, from how often each language's documents hold each row's words."""
        self.lang_rows = np.log((counts + 0.5) / (counts.sum(0) + 0.5 * len(counts))).astype(np.float32)
        self.lang_rows[0] = 0

    def threshold(self, z: np.ndarray, y: np.ndarray, lang: np.ndarray, n: np.ndarray | int, otherwise) -> None:
        """Thresholds from logits, the toxic documents of each, the languages read and the documents of each."""
        n = np.broadcast_to(n, len(z))
        enough = y.sum() >= LEAST and (n - y).sum() >= LEAST
        common = self._cut(z, y, 0.0, n) if enough else otherwise()
        own = [lang == k for k in range(max(1, len(self.langs)))]
        cuts = np.array([common + (self._cut(z[m], y[m], common, n[m]) - common) * y[m].sum() / (y[m].sum() + SHRINK) for m in own])
        nothing = self.net.logits(self.net.pooled(self.tables, *padded([np.empty(0, np.int64)])))[0]
        self.cuts = np.maximum(cuts, nothing + MARGIN)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "tables"}

    def __setstate__(self, state: dict) -> None:
        self.__dict__ |= state
        if "net" in state:
            self.tables = self.net.tables()

    @staticmethod
    def _cut(z: np.ndarray, y: np.ndarray, default: float, n: np.ndarray | int = 1) -> float:
        """The logit of best F1: between the two documents that it separates. Few documents: the default. n documents at each z, y of them toxic."""
        n = np.broadcast_to(n, len(z))
        if y.sum() < LEAST or (n - y).sum() < LEAST:
            return default
        order = np.argsort(-z, kind="stable")
        z, y, n = z[order], y[order], n[order]
        at = np.append(np.flatnonzero(z[1:] != z[:-1]), len(z) - 1)  # documents of one logit fall on one side
        z, f1 = z[at], 2 * np.cumsum(y)[at] / (np.cumsum(n)[at] + y.sum())
        k = int(f1.argmax())
        return float((z[k] + z[min(k + 1, len(z) - 1)]) / 2)

    def _logits(self, ids: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        z, lang = np.zeros(len(ids)), np.zeros(len(ids), int)
        a = 0
        while a < len(ids):  # about 200,000 words at once
            b, size = a, 0
            while b < len(ids) and (b == a or size + len(ids[b]) < 200_000):
                size += len(ids[b])
                b += 1
            flat, starts, ends = padded(ids[a:b])
            z[a:b] = self.net.logits(self.net.pooled(self.tables, flat, starts, ends))
            if self.langs:
                lang[a:b] = np.add.reduceat(self.lang_rows[flat], starts, axis=0, dtype=np.float64).argmax(1)
            a = b
        return z, lang

    def score(self, texts: list[str | None], rows: Rows) -> np.ndarray:
        if not self.trained:
            return np.zeros(len(texts))
        ids = [np.fromiter(map(rows.__getitem__, ws), np.int64, len(ws)) for ws in map(words, texts)]
        z, lang = self._logits(ids)
        return 1 / (1 + np.exp(-np.clip(z - self.cuts[lang] + np.log(THRESHOLD / (1 - THRESHOLD)), -30, 30)))


class Pairs(dict):
    """Words to their bucket and that of their first letters; CACHE words are kept at most."""

    def __missing__(self, word: str) -> tuple[int, int]:
        pair = bucket(word), bucket("^" + word[:PREFIX])
        if len(self) < CACHE:
            self[word] = pair
        return pair


def _bucket_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(bucket, documents, toxic documents) of batches(text, toxic)."""
    pairs = Pairs()
    for b in batches:
        own = [np.fromiter(set(chain.from_iterable(map(pairs.__getitem__, set(words(t))))), np.int64) for t in b.column(0).to_pylist()]
        toxic = np.repeat(b.column(1).to_numpy(zero_copy_only=False), [len(x) for x in own])
        at, of, n = np.unique(np.concatenate([*own, np.empty(0, np.int64)]), return_inverse=True, return_counts=True)
        bad = np.bincount(of, toxic, len(at)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n), pa.array(bad)], ["bucket", "n", "bad"])


def commonest(counts: DataFrame) -> DataFrame:
    """The rows(bucket, n, bad) of MIN_DOCS documents or more: all, or the commonest MAX_ROWS; of the last count only the first buckets, in blocks of 4,096."""
    counts = counts.where(F.col("n") >= MIN_DOCS)
    sizes = sorted(counts.groupBy("n").agg(F.count("*")).collect(), reverse=True)
    total = np.cumsum([r[1] for r in sizes])
    k = int(np.searchsorted(total, MAX_ROWS, "right"))
    if k == len(sizes):
        return counts
    last, left = sizes[k][0], MAX_ROWS - (int(total[k - 1]) if k else 0)
    blocks = sorted(counts.where(F.col("n") == last).groupBy(F.shiftright("bucket", 12)).agg(F.count("*")).collect())
    taken = int(np.searchsorted(np.cumsum([r[1] for r in blocks]), left, "right"))
    return counts.where((F.col("n") > last) | (F.col("n") == last) & (F.shiftright("bucket", 12) < int(blocks[taken][0])))


def _numbered(of: Broadcast, places: Callable[[str], int]):
    """Texts to row numbers, as bytes of 32-bit integers, languages to their places (null: -1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = Rows(of.value)
        for b in batches:
            ids = [np.fromiter(map(rows.__getitem__, words(t)), np.int32).tobytes() for t in b.column("text").to_pylist()]
            lang = [-1 if x is None else places(x) for x in b.column("lang").to_pylist()]
            out = {"doc_id": b.column("doc_id"), "place": b.column("place"), "shard": b.column("shard"), "checks": b.column("checks"), "toxic": b.column("toxic"), "lang": pa.array(lang, pa.int32()), "ids": pa.array(ids, pa.binary())}
            yield pa.RecordBatch.from_arrays([*out.values()], [*out])

    return run


def _unpacked(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x, np.int32) for x in column.to_pylist()]


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, row, n) of batches(lang, ids)."""
    for b in batches:
        ids = _unpacked(b.column(1))
        keys, n = np.unique(np.concatenate([*ids, np.empty(0, np.int32)]) + (np.repeat(b.column(0).to_numpy(), [len(x) for x in ids]).astype(np.int64) << 32), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array((keys >> 32).astype(np.int32)), pa.array((keys & 0xFFFFFFFF).astype(np.int32)), pa.array(n)], ["lang", "row", "n"])


COLUMNS = [f"d{k}" for k in range(DIM)]


def _flat(p: dict[str, np.ndarray]) -> np.ndarray:
    """All parameters but the embeddings, in rows of DIM."""
    v = np.concatenate([p[k].ravel() for k in sorted(p) if k != "e"])
    return np.pad(v, (0, -len(v) % DIM)).reshape(-1, DIM)


def _moved(p: dict[str, np.ndarray], by: np.ndarray) -> dict[str, np.ndarray]:
    """The parameters, those but the embeddings moved by rows as of _flat."""
    out, at, by = {"e": p["e"].copy()}, 0, by.ravel()
    for k in sorted(p):
        if k != "e":
            out[k] = (p[k] + by[at : at + p[k].size].reshape(p[k].shape)).astype(np.float32)
            at += p[k].size
    return out


def _trained(shared: Broadcast, rounds: int, seed: int):
    """Trains the net on each shard; (row, weight, weight times the moves) of embeddings by number and of the other parameters' rows by -1, -2, ..."""

    def moves(ids: list[np.ndarray], toxic: list[int]) -> pa.RecordBatch:
        net = Net.of({k: v.copy() for k, v in shared.value.items()})
        fit(net, ids, np.array(toxic, float), rounds, seed)
        n = np.bincount(np.concatenate([np.unique(x) for x in ids]), minlength=len(net.p["e"]))
        n[0] = 0
        held = np.flatnonzero(n)
        rest = _flat(net.p) - _flat(shared.value)
        by = np.concatenate((net.p["e"][held] - shared.value["e"][held], rest)).astype(np.float64)
        weight = np.concatenate((n[held], np.full(len(rest), len(ids))))
        by = np.rint(by * SCALE * weight[:, None]).astype(np.int64)
        row = np.concatenate((held, -1 - np.arange(len(rest))))
        return pa.RecordBatch.from_arrays([pa.array(row), pa.array(weight), *(pa.array(by[:, k]) for k in range(DIM))], ["row", "n", *COLUMNS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, ids, toxic = None, [], []
        for b in batches:
            for shard, label, own in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), _unpacked(b.column(2)), strict=True):
                if shard != at and ids:
                    yield moves(ids, toxic)
                    ids, toxic = [], []
                at = shard
                ids.append(own)
                toxic.append(label)
        if ids:
            yield moves(ids, toxic)

    return run


def _averaged(net: Net, docs: DataFrame, rounds: int, seed: int) -> Net:
    """A round over docs(shard, toxic, ids), which lie sorted by shard: trained in each shard, then averaged."""
    shared = docs.sparkSession.sparkContext.broadcast(net.p)
    sums = docs.mapInArrow(_trained(shared, rounds, seed), ", ".join(f"{c} long" for c in ["row", "n", *COLUMNS]))
    sums = sums.groupBy("row").agg(F.sum("n").alias("n"), *(F.sum(c).alias(c) for c in COLUMNS))
    got = sums.select("row", *((F.col(c) / F.col("n") / float(SCALE)).cast("float").alias(c) for c in COLUMNS)).toArrow()
    row, by = got["row"].to_numpy(), np.stack([got[c].to_numpy() for c in COLUMNS], 1)
    rest = np.zeros_like(_flat(net.p))
    rest[-1 - row[row < 0]] = by[row < 0]
    p = _moved(net.p, rest)
    p["e"][row[row > 0]] += by[row > 0]
    shared.destroy()
    return Net.of(p)


def _points(shared: Broadcast):
    """(lang as read, logit in steps of 1 / GRID, toxic) of batches(ids, toxic)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            z, lang = shared.value._logits(_unpacked(b.column(0)))
            yield pa.RecordBatch.from_arrays([pa.array(lang.astype(np.int32)), pa.array(np.rint(z * GRID).astype(np.int64)), b.column(1)], ["lang", "z", "toxic"])

    return run


def train(docs: DataFrame, labels: DataFrame) -> Classifier:
    """A classifier from docs(doc_id, text, lang) and labels(doc_id, toxic), both for learning only."""
    spark = docs.sparkSession
    arrow_batches(spark)
    marked = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max((F.col("toxic") == 1).cast("long")).alias("toxic"))
    rows = docs.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).join(marked, "doc_id")
    texts = written(rows.groupBy("doc_id").agg(F.min(F.struct("text", "lang", "toxic")).alias("r")).select("doc_id", "r.*"), "toxicity-texts")
    out = Classifier([])
    n, n1, chars = texts.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0)), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    if not 0 < n1 < n:
        discard(texts)
        return out
    by_lang = texts.where("lang is not null").groupBy("lang").agg(F.count("*").alias("n"), F.sum("toxic").alias("bad"))
    enough = F.least("bad", F.col("n") - F.col("bad")) >= LEAST
    out.langs = languages({r[0]: r[1:] for r in by_lang.where(enough).unionByName(by_lang.where(~enough).limit(1)).collect()})
    counts = texts.select("text", "toxic").mapInArrow(_bucket_counts, "bucket long, n long, bad long").groupBy("bucket").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    counts = written(counts, "toxicity-buckets")
    kept = commonest(counts).toArrow().sort_by([("n", "descending"), ("bucket", "ascending")])
    out.of = {b: i + 1 for i, b in enumerate(kept["bucket"].to_pylist())}
    net = start(log_odds(kept["n"].to_numpy(), kept["bad"].to_numpy(), n, n1))

    of = spark.sparkContext.broadcast(out.of)
    shards = max(1, -(-chars // SHARD_CHARS))
    dealt = texts.withColumn("place", hash_fraction("doc_id")).withColumn("shard", (F.col("place") * shards).cast("int")).withColumn("checks", F.pmod(F.xxhash64("doc_id", F.lit("checks")), F.lit(4)) == 3)
    ids = dealt.mapInArrow(_numbered(of, out.places()), "doc_id long, place double, shard int, checks boolean, toxic long, lang int, ids binary")
    ids = ids.repartition(shards, "shard").sortWithinPartitions("shard", "place", "doc_id").persist(StorageLevel.DISK_ONLY)  # dealt once, read in each round
    found = ids.where("lang >= 0").select("lang", "ids").mapInArrow(_word_counts, "lang int, row int, n long").groupBy("lang", "row").agg(F.sum("n").alias("n")).toArrow()
    by_row = np.zeros((len(kept) + 1, len(out.langs)))
    by_row[found["row"].to_numpy(), found["lang"].to_numpy()] = found["n"].to_numpy()
    out.read(by_row)
    rounds = ROUNDS if shards > 1 else 1
    for k in range(rounds):
        net = _averaged(net, ids.where("not checks").select("shard", "toxic", "ids"), rounds, 11 + k)
    out.net, out.tables, out.trained = net, net.tables(), True

    def points(of: DataFrame) -> tuple:
        """Logits, toxic documents, languages and documents, a row a language and step."""
        shared = spark.sparkContext.broadcast(out)
        got = of.select("ids", "toxic").mapInArrow(_points(shared), "lang int, z long, toxic long").groupBy("lang", "z").agg(F.sum("toxic").alias("bad"), F.count("*").alias("n")).toArrow()
        return got["z"].to_numpy() / GRID, got["bad"].to_numpy(), got["lang"].to_numpy(), got["n"].to_numpy()

    def of_all() -> float:
        z, bad, _, n = points(ids)
        return out._cut(z, bad, 0.0, n)

    out.threshold(*points(ids.where("checks")), of_all)
    ids.unpersist()
    discard(texts, counts)
    return out


def score(docs: DataFrame, classifier: Classifier) -> DataFrame:
    """(doc_id, score) for every row of docs."""
    spark = docs.sparkSession
    arrow_batches(spark)
    shared = spark.sparkContext.broadcast(classifier)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = Rows(shared.value.of if shared.value.trained else {})
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(shared.value.score(b.column(1).to_pylist(), rows), pa.float64())], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, score double")


def op4_toxicity(spark, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    learn = ~held_out(F.col("doc_id"))
    out = score(docs, train(docs.where(learn), labels.where(learn)))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
