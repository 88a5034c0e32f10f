"""Language identification by words first, backing off to shorter and shorter character n-grams.

A known word counts by its log frequency in each language.  An unseen word counts
by its longest character n-grams that are known, five down to one, word ends
included.  The model is fitted on a bounded sample of labelled documents: about
DOCS_PER_LANGUAGE of each language, by a hash of the text, so that it has the same
size on any corpus; every document is predicted from its whole text.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrace.llm.common import checkpoint, chunks, fresh

#: Labelled documents of a language that the model is fitted on, about.
DOCS_PER_LANGUAGE = 4000
#: Most frequent entries of a language and n-gram length (0: words) that the model keeps.
ENTRIES = 50_000
#: Longest character n-gram.
LONGEST = 5
#: Count added to every entry.
ADDED = 0.5
#: Words a worker remembers beside the model.
CACHED = 300_000
_WORD = re.compile(r"[^\W\d_]+")


@dataclass
class LanguageModel:
    """Languages, their log shares, and for words and n-grams the rows of one table of log frequencies by language."""

    languages: list[str]
    prior: np.ndarray
    words: dict[str, int]
    grams: dict[str, int]
    table: np.ndarray


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def grams_of(word: str, n: int) -> list[str]:
    """Character n-grams of a word between end marks; n = 1 has no marks."""
    marked = f"<{word}>" if n > 1 else word
    return [marked[i : i + n] for i in range(len(marked) - n + 1)]


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in chunks(batch, "text"):
            counts: dict[str, Counter] = {}
            for lang, text in zip(part.column("lang").to_pylist(), part.column("text").to_pylist()):
                counts.setdefault(lang, Counter()).update(words_of(text or ""))
            out: Counter = Counter()
            for lang, words in counts.items():
                for w, c in words.items():
                    out[lang, 0, w] += c
                    for n in range(1, LONGEST + 1):
                        for g in grams_of(w, n):
                            out[lang, n, g] += c
            keys = list(out)
            columns = [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()), pa.array([k[2] for k in keys], pa.string())]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(list(out.values()), pa.int64())], ["lang", "n", "entry", "c"])


def sample(labelled: DataFrame, docs_per_language: int) -> DataFrame:
    """About ``docs_per_language`` documents of each language, by a hash of the text; all where there are fewer."""
    counts = labelled.groupBy("lang").agg(F.count("*").alias("docs"))
    share = F.lit(float(docs_per_language)) / F.col("docs")
    uniform = F.shiftrightunsigned(F.xxhash64("text", F.lit("sample")), 11) / F.lit(float(1 << 53))
    return labelled.join(F.broadcast(counts), "lang").filter(uniform < share).select("lang", "text")


def train(labelled: DataFrame, docs_per_language: int = DOCS_PER_LANGUAGE, entries: int = ENTRIES) -> LanguageModel:
    """Fit on ``labelled`` (lang, text); rows without a language or a text are ignored.

    ``docs_per_language`` bounds the sample, ``entries`` the words and the n-grams
    of each length and language that are kept: the most frequent, ties by spelling.
    """
    labelled = labelled.select("lang", "text").filter("lang IS NOT NULL AND text IS NOT NULL")
    counted = sample(labelled, docs_per_language).mapInArrow(_entries, "lang string, n int, entry string, c long")
    counted = checkpoint(counted.groupBy("lang", "n", "entry").agg(F.sum("c").alias("c")))
    totals = {(r["lang"], r["n"]): (r["t"], r["k"]) for r in counted.groupBy("lang", "n").agg(F.sum("c").alias("t"), F.count("*").alias("k")).collect()}
    place = Window.partitionBy("lang", "n").orderBy(F.desc("c"), "entry")
    top = counted.withColumn("at", F.row_number().over(place)).filter(F.col("at") <= entries).select("n", "entry").distinct()
    rows = counted.join(top, ["n", "entry"]).toArrow()
    languages = sorted({lang for lang, _ in totals})
    column = {lang: i for i, lang in enumerate(languages)}
    words: dict[str, int] = {}
    grams: dict[str, int] = {}
    slots, ns = [], []
    for n, e in zip(rows.column("n").to_pylist(), rows.column("entry").to_pylist()):
        own = words if n == 0 else grams
        e = e if n == 0 else f"{n}{e}"
        if e not in own:
            own[e] = len(ns)
            ns.append(n)
        slots.append(own[e])
    table = np.zeros((len(ns), len(languages)))
    np.add.at(table, (np.array(slots, np.int64), np.array([column[x] for x in rows.column("lang").to_pylist()], np.int64)), rows.column("c").to_numpy())
    total = np.array([[totals.get((lang, n), (0, 0))[0] for lang in languages] for n in range(LONGEST + 1)], float).reshape(LONGEST + 1, -1)
    kinds = np.array([max([totals.get((lang, n), (0, 0))[1] for lang in languages], default=0) for n in range(LONGEST + 1)], float)
    ns = np.array(ns, np.int64)
    table = np.log((table + ADDED) / (total[ns] + ADDED * (kinds[ns][:, None] + 1)))
    prior = total[0] + ADDED
    return LanguageModel(languages, np.log(prior / prior.sum()) if languages else prior, words, grams, table)


class _Scorer:
    """Log frequencies of words by language, known ones and those seen on the way."""

    def __init__(self, model: LanguageModel):
        self.model = model
        self.reset()

    def reset(self) -> None:
        self.rows = dict(self.model.words)
        self.table = self.model.table

    def learn(self, words: set[str]) -> None:
        """Rows for words that have none: the mean of their longest known n-grams, zeros without any."""
        grams = self.model.grams
        flat: list[int] = []
        sizes = []
        for w in words:
            hits: list[int] = []
            for n in range(min(LONGEST, len(w) + 2), 0, -1):
                hits = [grams[g] for x in grams_of(w, n) if (g := f"{n}{x}") in grams]
                if hits:
                    break
            flat += hits
            sizes.append(len(hits))
        sizes = np.array(sizes)
        values = np.zeros((len(sizes), self.table.shape[1]))
        some = sizes > 0
        if some.any():
            edges = (np.cumsum(sizes) - sizes)[some]
            values[some] = np.add.reduceat(self.model.table[np.array(flat)], edges) / sizes[some][:, None]
        self.rows.update(zip(words, range(len(self.table), len(self.table) + len(sizes))))
        self.table = np.concatenate([self.table, values])

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        found = [words_of(t) if t else [] for t in texts]
        every = [w for ws in found for w in ws]
        new = set(every) - self.rows.keys()
        if len(self.rows) - len(self.model.words) + len(new) > CACHED:
            self.reset()
            new = set(every) - self.rows.keys()
        if new:
            self.learn(new)
        at = np.fromiter(map(self.rows.__getitem__, every), np.int64, len(every))
        langs, scores, a = [], [], 0
        for ws in found:
            b = a + len(ws)
            if not ws or not self.model.languages:
                langs.append("und")
                scores.append(0.0)
            else:
                sums = self.table[at[a:b]].sum(axis=0) + self.model.prior
                best = int(sums.argmax())
                langs.append(self.model.languages[best])
                scores.append(float(1 / np.exp(sums - sums[best]).sum()))
            a = b
        return langs, scores


def _predictor(sent, text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _Scorer(sent.value)
        for batch in batches:
            for part in chunks(batch, text, 2 << 20):
                langs, scores = scorer.predict(part.column(text).to_pylist())
                rest = [i for i, c in enumerate(part.schema.names) if c != text]
                columns = [*[part.column(i) for i in rest], pa.array(langs, pa.string()), pa.array(scores, pa.float64())]
                yield pa.RecordBatch.from_arrays(columns, [*[part.schema.names[i] for i in rest], "lang_pred", "score"])

    return run


def identified(docs: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """``docs`` with lang_pred and score, its posterior, from the whole ``text``.

    Defined cases: null and empty texts and texts without a letter are ``und`` with
    score 0, as is every text when nothing was learned; ties go to the language
    that sorts first; equal texts get equal results; an empty table gives an
    empty one; columns named as the result's are replaced.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # bounded by ENTRIES for each language
    rest = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in ("lang_pred", "score")])
    schema = rest.withColumns({"lang_pred": F.lit(None).cast("string"), "score": F.lit(None).cast("double")}).schema
    work = fresh(rest, "__text")
    return rest.withColumn(work, F.col(f"`{text}`")).mapInArrow(_predictor(sent, work), schema)
