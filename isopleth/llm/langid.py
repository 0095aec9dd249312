"""Language identification by word-first backoff.

A word that the training texts hold is scored by its log frequency in each
language. A word that they don't is covered from left to right by the longest
known character n-grams, from ``LONGEST`` down to single characters, each
scored by its log frequency; a character that no text holds costs the same in
all languages.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .sampling import hash_sample, unused

#: Rows to fit on, a language; times that a word must occur in them to be known; longest n-gram.
SAMPLE, LEAST_COUNT, LONGEST = 2000, 3, 5
LETTERS = re.compile(r"[^\W\d_]+")


def words(text: str | None) -> list[str]:
    """Lower-cased runs of letters."""
    return LETTERS.findall((text or "").lower())


class Model:
    """Log frequencies of words and n-grams by language; ``rows`` remembers those of the words that it met."""

    def __init__(self, languages: list[str], word_logs: dict[str, tuple], gram_logs: list[dict[str, tuple]]):
        self.languages, self.word_logs, self.gram_logs = languages, word_logs, gram_logs

    def backoff(self, word: str) -> tuple:
        """Scores of an unseen word, by n-grams with its ends marked."""
        text, at = f"^{word}$", 0
        total = np.zeros(len(self.languages))
        while at < len(text):
            for n in range(min(LONGEST, len(text) - at), 0, -1):
                if (found := self.gram_logs[n].get(text[at : at + n])) is not None:
                    total += found
                    break
            at += n
        return tuple(total)

    def predict(self, text: str | None, memory: dict) -> tuple[str, float]:
        """The language and its share of the posterior. No letter, or nothing learnt: ``und`` and 0."""
        found = words(text)
        if not self.languages or not any(c.isalpha() for w in found for c in w):
            return "und", 0.0
        if len(memory) > 200_000:
            memory.clear()
        total = np.zeros(len(self.languages))
        for at in range(0, len(found), 1 << 16):
            part = []
            for w in found[at : at + (1 << 16)]:
                if (row := memory.get(w)) is None:
                    row = memory[w] = self.word_logs.get(w) or self.backoff(w)
                part.append(row)
            total += np.array(part).sum(axis=0)
        k = int(np.argmax(total))
        return self.languages[k], float(1 / np.exp(total - total[k]).sum())


def fit(counts: dict[str, Counter]) -> Model:
    """A model from the word counts of each language. Ties between languages go to the first in order."""
    languages = sorted(counts)
    seen: Counter = Counter()
    grams = [Counter() for _ in range(LONGEST + 1)]
    by = {lang: [Counter() for _ in range(LONGEST + 1)] for lang in languages}
    for lang in languages:
        for w, c in counts[lang].items():
            seen[w] += c
            text = f"^{w}$"
            for n in range(1, LONGEST + 1):
                for at in range(len(text) - n + 1):
                    by[lang][n][text[at : at + n]] += c
        for n in range(1, LONGEST + 1):
            grams[n].update(by[lang][n])

    def logs(tables: list[Counter], keys) -> dict[str, tuple]:
        keys = sorted(keys)
        x = np.array([[t[k] for t in tables] for k in keys], float).reshape(len(keys), len(tables)) + 0.5
        x = np.log(x / (np.array([sum(t.values()) for t in tables]) + 0.5 * max(1, len(keys))))
        return dict(zip(keys, map(tuple, x.tolist())))

    known = [w for w, c in seen.items() if c >= LEAST_COUNT]
    return Model(languages, logs([counts[x] for x in languages], known), [{}] + [logs([by[x][n] for x in languages], [g for g, c in grams[n].items() if c >= LEAST_COUNT]) for n in range(1, LONGEST + 1)])


def learn(docs: DataFrame, rows: Column, lang_col: str = "lang", text_col: str = "text", sample: int = SAMPLE) -> Model:
    """Fits on about ``sample`` documents a language (a documented bound), out of those with a language that ``rows`` admits."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter] = {}
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1)):
                counts.setdefault(lang, Counter()).update(words(text.as_py()))
        out = [(lang, w, n) for lang, c in counts.items() for w, n in c.items()]
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.string()), pa.array([x[2] for x in out], pa.int64())], ["lang", "word", "n"])

    known = docs.where(rows & F.col(lang_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), "doc_id")
    chosen = hash_sample(known, "lang", sample).select("lang", "text")
    table = chosen.mapInArrow(counted, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")).toArrow()
    counts: dict[str, Counter] = {}
    for lang, word, n in zip(*(table[c].to_pylist() for c in ("lang", "word", "n"))):
        counts.setdefault(lang, Counter())[word] = n
    return fit(counts)


def predict(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs with ``lang_pred`` and ``lang_score`` (0 to 1), by whole texts.

    A null text or one without a letter is ``und`` with score 0. Very long
    texts are summed up in parts. Ties go to the first language in order.
    Repeated rows stay; columns of those names are replaced, others stay. An
    empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("struct<lang_pred: string, lang_score: double>")
    def predicted(texts):
        memory = shared.value.__dict__.setdefault("memory", {})
        return pd.DataFrame([shared.value.predict(t, memory) for t in texts], columns=["lang_pred", "lang_score"])

    made = unused(docs, "_lang")
    out = docs.withColumn(made, predicted(F.col(text_col)))
    return out.withColumns({c: F.col(made)[c] for c in ("lang_pred", "lang_score")}).drop(made)
