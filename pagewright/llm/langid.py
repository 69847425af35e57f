"""Language identification by word-first backoff.

A known word scores its log frequency in each language. An unseen word is scored by its longest
character n-grams (with word boundaries) of which any is known: first of MAX_N characters, then
shorter ones. A text scores the mean over its words, and its language is the best one.

Learning: a sample of distinct labelled texts, whole, SAMPLE a language at most in expectation and SAMPLES in all
(chosen by a hash of doc_id and text, so any size gives a sample of the same kind). Words and n-grams are counted in Spark; the driver
gets the frequencies of what the model keeps, MAX_WORDS words and MAX_GRAMS n-grams at most, which bounds what is broadcast.

Null texts and texts without a letter are `und` with score 0. With no labelled text at all, every
text is `und`. Ties go to the first language in alphabetical order. Prediction reads the text alone.
Each row is judged by itself: repeated rows and rows with a null doc_id get what their text gets and are all
returned. Columns beside text pass through; one that has the name of a new column is replaced. No rows in, no rows out.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagewright.llm._common import arrow_batches, discard, hash_fraction, held_out, table, written

SAMPLE, SAMPLES = 1500, 60_000
MAX_N = 5
MAX_WORDS = 200_000
MAX_GRAMS = 300_000
MIN_COUNT = 2
BROADCAST_LANGS = 1 << 16
"""Languages up to which their shares of the sample are broadcast."""
CACHE = 300_000
SMOOTH = 0.5
EVIDENCE = 12.0
"""Words to which the evidence of a longer text is scaled before it becomes a score."""
WORD = regex.compile(r"\p{L}+")
UND = "und"


def words(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def grams(word: str, n: int) -> list[str]:
    w = f"<{word}>"
    return [w[i : i + n] for i in range(len(w) - n + 1)]


def _counted(batches: Iterator[pa.RecordBatch], of) -> Iterator[pa.RecordBatch]:
    """Sums of the pairs ((lang, size, item), n) that `of` yields for each row, a batch at a time."""
    for b in batches:
        seen: Counter = Counter()
        for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
            for key, n in of(*row):
                seen[key] += n
        lang, size, item = zip(*seen, strict=True) if seen else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(size, pa.int32()), pa.array(item, pa.string()), pa.array(seen.values(), pa.int64())], ["lang", "size", "item", "n"])


COUNTS = "lang string, size int, item string, n long"


def _word_counts(lang: str, text: str) -> Iterator[tuple]:
    return (((lang, 0, w), n) for w, n in Counter(words(text)).items())


def _gram_counts(lang: str, word: str) -> Iterator[tuple]:
    return (((lang, size, g), 1) for size in range(1, MAX_N + 1) for g in grams(word, size))


class Model:
    """Log frequencies by language of words and of n-grams of each length: tables[0] of words, tables[n] of n-grams, each (row numbers, rows).

    kept: an Arrow table (size, item, of: a list of (lang, n)) of the entries that it knows; totals: (size, lang, n) and entries: (size,
    distinct items) over all that was counted, for smoothing; letters: all characters seen in words.
    """

    def __init__(self, kept: pa.Table | None = None, totals: Iterable[tuple] = (), entries: Iterable[tuple] = (), letters: Iterable[str] = ()):
        totals, entries = list(totals), dict(entries)
        self.langs = sorted({lang for _, lang, _ in totals})
        self.letters = frozenset(letters)
        at = {lang: k for k, lang in enumerate(self.langs)}
        total = np.zeros((MAX_N + 1, len(at)))
        for size, lang, n in totals:
            total[size, at[lang]] = n
        self.tables = []
        for size in range(MAX_N + 1):
            own = kept.filter(pa.compute.equal(kept["size"], size)).combine_chunks() if at else None
            names = own["item"].to_pylist() if at else []
            rows = np.zeros((len(names), len(at)), np.float32)
            if names:
                of = own["of"].combine_chunks()
                row = np.repeat(np.arange(len(names)), np.diff(of.offsets.to_numpy()))
                lang = of.flatten().field("lang").dictionary_encode()
                col = np.array([at[x] for x in lang.dictionary.to_pylist()])[lang.indices.to_numpy()]
                rows[row, col] = of.flatten().field("n").to_numpy()
            rows += SMOOTH
            self.tables.append(({w: i for i, w in enumerate(names)}, np.log(rows, out=rows) - np.log(total[size] + SMOOTH * (entries.get(size, 0) + 1)).astype(np.float32)))
        self.words = self.tables[0][0]

    def knows(self, word: str) -> bool:
        """Whether any letter of the word occurs in what was learned from."""
        return any(c in self.letters for c in word)

    def row(self, word: str) -> np.ndarray:
        """The word's evidence for each language, 0 for the best."""
        at = self.words.get(word)
        if at is not None:
            v = self.tables[0][1][at]
            return v - v.max()
        for n in range(MAX_N, 0, -1):
            known, rows = self.tables[n]
            if hit := [known[g] for g in grams(word, n) if g in known]:
                v = rows[hit].mean(0)
                return v - v.max()
        return np.zeros(len(self.langs))


class Scorer(dict):
    """Words to row numbers, learned as they come; rows hold their evidence."""

    def __init__(self, model: Model):
        super().__init__()
        self.model = model
        self.rows = np.zeros((1 << 12, len(model.langs)), np.float32)

    def __missing__(self, word: str) -> int:
        at = len(self)
        if at == len(self.rows):
            self.rows = np.concatenate((self.rows, np.zeros_like(self.rows)))
        self.rows[at] = self.model.row(word)
        self[word] = at
        return at

    def predict(self, text: str | None) -> tuple[str, float]:
        found = words(text)
        if not found or not self.model.langs:
            return UND, 0.0
        if len(self) > CACHE:
            self.clear()
        at = np.fromiter(map(self.__getitem__, found), np.int64, len(found))
        mean = self.rows[at].sum(0, dtype=np.float64) / len(found)
        p = np.exp((mean - mean.max()) * min(len(found), EVIDENCE))
        best = int(mean.argmax())
        return self.model.langs[best], float(p[best] / p.sum())


def train(docs: DataFrame, per_lang: int = SAMPLE) -> Model:
    """A model from docs(doc_id, text, lang): a sample of the labelled texts, see above."""
    labelled = docs.where("lang is not null and text is not null").select("doc_id", "text", F.col("lang").cast("string").alias("lang"))
    sizes = labelled.groupBy("lang").count()
    langs = sizes.count()
    each = min(per_lang, SAMPLES / max(1, langs))
    share = sizes.select(F.col("lang").alias("of"), (F.lit(float(each)) / F.col("count")).alias("share"))
    share = F.broadcast(share) if langs <= BROADCAST_LANGS else share
    sample = labelled.join(share, F.col("lang") == F.col("of")).where(hash_fraction("doc_id", "text") < F.col("share"))
    return learned(sample.select("lang", "text").distinct())


def learned(texts: DataFrame) -> Model:
    """A model of all the texts(lang, text)."""
    arrow_batches(texts.sparkSession)
    add = lambda df: df.groupBy("lang", "size", "item").agg(F.sum("n").alias("n"))
    by_word = written(add(texts.select("lang", "text").mapInArrow(lambda b: _counted(b, _word_counts), COUNTS)), "langid-words")
    by_gram = add(by_word.select("lang", F.col("item").alias("word")).mapInArrow(lambda b: _counted(b, _gram_counts), COUNTS))
    items = by_word.unionByName(by_gram).groupBy("size", "item").agg(F.sum("n").alias("all"), F.collect_list(F.struct("lang", "n")).alias("of"))
    items = written(items, "langid-items")
    totals = items.select("size", F.inline("of")).groupBy("size", "lang").agg(F.sum("n")).collect()
    found = items.groupBy("size").agg(F.count("*"), F.count_if(F.col("all") >= MIN_COUNT)).collect()
    known = items.where(F.col("all") >= MIN_COUNT)
    for size, _, n in found:  # only the commonest where there are too many
        if n > (most := MAX_WORDS if size == 0 else MAX_GRAMS // MAX_N):
            known = known.where(F.col("size") != size).unionByName(known.where(F.col("size") == size).orderBy(F.desc("all"), "item").limit(most))
    model = Model(known.select("size", "item", "of").toArrow(), totals, [r[:2] for r in found], {r[0] for r in items.where("size = 1").select("item").collect()} - {"<", ">"})
    discard(by_word, items)
    return model


def annotate(docs: DataFrame, model: Model, lang: str = "lang_pred", score: str = "lang_score") -> DataFrame:
    """docs with the two columns added, from the column text."""
    spark = docs.sparkSession
    arrow_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    docs = docs.drop(lang, score)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for b in batches:
            out = [scorer.predict(t) for t in b.column(at).to_pylist()]
            cols = [pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.float64())]
            yield pa.RecordBatch.from_arrays([*b.columns, *cols], [*b.schema.names, lang, score])

    schema = T.StructType([*docs.schema.fields, T.StructField(lang, T.StringType()), T.StructField(score, T.DoubleType())])
    return docs.mapInArrow(run, schema)


def reject_unknown(docs: DataFrame, model: Model, targets: Iterable[str] | None = None) -> DataFrame:
    """docs in one of the target languages (default: all that the model has learned), whole and unchanged.

    Rejected are null texts, texts without a letter, texts whose predicted language is no target, and texts of
    which the model knows nothing: none of their letters occurs in what it learned from. A model without
    languages can tell of none: then texts with a letter stay. Rows are judged one by one, as in annotate().
    """
    spark = docs.sparkSession
    arrow_batches(spark)
    shared, wanted = spark.sparkContext.broadcast(model), None if targets is None else frozenset(targets)
    at = docs.columns.index("text")

    def stays(scorer: Scorer, text: str | None) -> bool:
        if not scorer.model.langs:
            return bool(words(text))
        lang = scorer.predict(text)[0]
        return lang != UND and (wanted is None or lang in wanted) and any(map(scorer.model.knows, words(text)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for b in batches:
            yield b.filter(pa.array([stays(scorer, t) for t in b.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def training_rows(docs: DataFrame) -> DataFrame:
    return docs.where(~held_out(F.col("doc_id")))


def op1_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(training_rows(docs))
    out = annotate(docs.select("doc_id", "text"), model, "lang_pred", "score")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
