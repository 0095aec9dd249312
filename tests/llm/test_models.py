"""Held-out accuracy of the three classifiers, their scores and fits against plain versions, and odd rows."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from isopleth.llm import langid, quality, queries, toxicity
from isopleth.llm.sampling import hash_sample, remainder

SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet").cache()


def accuracy(found, labels, label):
    rows = found.where("held_out").join(labels, "doc_id").select("predicted", "score", F.col(label).alias("label")).collect()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    return np.mean([r.predicted == r.label for r in rows]), rows


def test_quality_of_held_out_documents(spark, labels):
    got, _ = accuracy(queries.op4_quality(spark, SF), labels, "quality")
    assert got > 0.97


def test_toxicity_of_held_out_documents(spark, labels):
    got, rows = accuracy(queries.op8_toxicity(spark, SF), labels, "toxic")
    assert got > 0.95
    assert np.mean([r.predicted for r in rows if r.label]) > 0.78  # 0.80 measured
    assert np.mean([r.predicted for r in rows if not r.label]) < 0.02


def test_language_of_held_out_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    rows = queries.op7_langid(spark, SF).where("held_out").join(docs, "doc_id").select("lang", "lang_pred").collect()
    assert np.mean([r.lang == r.lang_pred for r in rows]) > 0.97


def test_odd_rows(spark, odd, empty, labels):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for frame in (odd, empty):
        n = frame.count()
        q = quality.learn(docs, labels, remainder(F.col("doc_id"), 3) != 1, sample=50)
        assert [r for r in quality.score(frame, q).select("quality_score").collect() if not 0 <= r[0] <= 1] == [] and quality.score(frame, q).count() == n
        t = toxicity.learn(docs, labels, remainder(F.col("doc_id"), 5) != 0, sample=50)
        rows = toxicity.score(frame, t).select("text", "toxic_score", "offending").collect()
        assert len(rows) == n and all(r.toxic_score == 0 for r in rows if not (r.text or "").strip())
        m = langid.learn(docs, F.lit(True), sample=20)
        rows = langid.predict(frame, m).select("text", "lang_pred", "lang_score").collect()
        assert len(rows) == n and all(r.lang_pred == "und" for r in rows if not any(c.isalpha() for c in r.text or ""))


def test_nothing_to_learn_from(spark, empty, docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.score(docs, quality.learn(docs, none, F.lit(True))).where("quality_score IS NULL").count() == 0
    assert toxicity.score(docs, toxicity.learn(docs, none, F.lit(True))).where("toxic_score > 0.5").count() == 0
    assert langid.predict(docs, langid.learn(empty, F.lit(True))).where("lang_pred <> 'und'").count() == 0


def test_offending_sentences_are_located():
    w = np.zeros(toxicity.BUCKETS, np.float32)
    w[toxicity._BUCKETS["scum"]] = 12
    ids, sizes, spans = toxicity.bag("All fine here. You scum! Bye.")
    z = toxicity.sentence_logits(w, -6.0, ids, sizes)
    assert [s for s, v in zip(spans, z) if v > 0] == [(14, 24)]
    assert toxicity.noisy_or(z) == pytest.approx(1 - np.prod(1 - 1 / (1 + np.exp(-z))))


def test_sample_is_about_as_large_as_asked(spark):
    rows = spark.range(20_000).select(F.col("id").alias("doc_id"), (F.col("id") % 10 == 0).cast("int").alias("label"))
    n = {r.label: r["count"] for r in hash_sample(rows, "label", 1000).groupBy("label").count().collect()}
    assert abs(n[0] - 1000) < 150 and abs(n[1] - 1000) < 150


# --- plain versions ----------------------------------------------------------------------------------------------------


def sample_of(spark, n=400):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").where("doc_id % 2 = 0").limit(n)


def plain_features(text):
    """The measures of a text, a byte and a word at a time."""
    raw = (text or "").encode()
    if not raw:
        return [0.0] * quality.SIZE
    single, pair = Counter(raw), Counter(((a * 256 + b) * 2654435761 % 2**32) >> 22 for a, b in zip(raw, raw[1:]))
    out = [math.sqrt(single[b] / len(raw)) for b in range(256)]
    out += [math.sqrt(pair[k] / max(1, len(raw) - 1)) for k in range(quality.PAIR_BUCKETS)]
    words, lines = text.split(), text.split("\n")
    n, kinds = max(1, len(words)), len(set(words))
    twice = sum(a == b for a, b in zip(words, words[1:]))
    letters = sum(c for b, c in single.items() if chr(b).isascii() and chr(b).isalpha())
    out += [math.log1p(len(raw)) / 10, kinds / n, twice / n, sum(w.isupper() for w in words) / n, sum(w.isalpha() for w in words) / n, min(4, len(raw) / n / 10)]
    out += [1 - len(set(lines)) / len(lines), sum(single[b] for b in range(48, 58)) / len(raw), sum(c for b, c in single.items() if b >= 128) / len(raw), letters / len(raw), (math.log1p(n) - math.log1p(kinds)) / 4, 1.0]
    return out


def test_quality_equals_a_plain_scorer(spark, labels, odd):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    w, threshold = quality.learn(docs, labels, remainder(F.col("doc_id"), 3) != 1, sample=200)
    frame = sample_of(spark).unionByName(odd.select("doc_id", "text"))
    got = quality.score(frame, (w, threshold)).collect()
    assert len(got) == frame.count()
    for r in got:
        s = sum(float(a) * b for a, b in zip(w, plain_features(r.text)) if b) - threshold
        assert r.quality_score == pytest.approx(1 / (1 + math.exp(-max(-30, min(30, s)))), abs=2e-4)


def test_quality_learns_the_same_from_any_order(spark):
    """Labels of texts that are equally long, in two orders and two partitionings; the threshold is the quantile at the share of 0."""
    rnd = np.random.default_rng(1)
    rows = [(k, "".join(rnd.choice(list("abcdefgh " if k % 3 else "0123!?xyz "), 50))) for k in range(240)]
    labels = spark.createDataFrame([(k, int(k % 3 > 0)) for k, _ in rows], "doc_id long, quality int")
    one, two = (quality.learn(spark.createDataFrame(r, "doc_id long, text string").repartition(n), labels, F.lit(True)) for r, n in ((rows, 1), (rows[::-1], 3)))
    assert np.array_equal(one[0], two[0]) and one[1] == two[1]
    s = np.array([quality.features(t) @ one[0] for _, t in rows])
    assert abs((s < one[1]).mean() - 1 / 3) < 0.01 and all((s[k] >= one[1]) == (k % 3 > 0) for k in range(240))


def test_the_pair_loss_is_at_its_least():
    """Weights of separable and of noisy pairs: the loss on all pairs is no more than that of a plain gradient descent."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(60, 5)).astype(np.float32)
    y = (x[:, 0] - 0.5 * x[:, 1] + rng.normal(size=60) > 0).astype(int)
    w, _ = quality.fit(x, y, float((y == 0).mean()), rivals=40, epochs=200)
    d = (x[y == 1][:, None] - x[y == 0][None]).reshape(-1, 5).astype(float)
    loss = lambda v: np.logaddexp(0, -d @ v).mean()
    v = np.zeros(5)
    for _ in range(4000):
        v += 0.5 * (d.T @ (1 / (1 + np.exp(d @ v)))) / len(d)
    assert loss(w.astype(float)) <= loss(v) + 0.02 and np.corrcoef(w, v)[0, 1] > 0.98


def plain_words(text):
    return re.findall(r"[^\W\d_]+", (text or "").lower())


class PlainLanguages:
    """Backoff from its definition: counts in dictionaries, one word and one n-gram at a time."""

    def __init__(self, rows):
        self.languages = sorted({lang for lang, _ in rows})
        self.words = {x: Counter() for x in self.languages}
        for lang, text in rows:
            self.words[lang].update(plain_words(text))
        self.grams = {x: [Counter() for _ in range(langid.LONGEST + 1)] for x in self.languages}
        for x, c in self.words.items():
            for w, n in c.items():
                for size in range(1, langid.LONGEST + 1):
                    for at in range(len(w) + 2 - size + 1):
                        self.grams[x][size][f"^{w}$"[at : at + size]] += n
        self.known = [self._known([self.words[x] for x in self.languages])]
        self.known += [self._known([self.grams[x][n] for x in self.languages]) for n in range(1, langid.LONGEST + 1)]

    def _known(self, tables):
        total = sum(tables, Counter())
        return {k for k, n in total.items() if n >= langid.LEAST_COUNT}

    def log(self, table, key, known):
        return math.log((table[key] + 0.5) / (sum(table.values()) + 0.5 * max(1, len(known))))

    def predict(self, text):
        total = dict.fromkeys(self.languages, 0.0)
        found = plain_words(text)
        if not any(c.isalpha() for w in found for c in w):
            return "und", 0.0
        for w in found:
            if w in self.known[0]:
                for x in self.languages:
                    total[x] += self.log(self.words[x], w, self.known[0])
                continue
            rest = f"^{w}$"
            while rest:
                n = next((n for n in range(min(langid.LONGEST, len(rest)), 0, -1) if rest[:n] in self.known[n]), 0)
                for x in self.languages:
                    total[x] += self.log(self.grams[x][n], rest[:n], self.known[n]) if n else 0.0
                rest = rest[max(1, n) :]
        top = max(total.values())
        return max(self.languages, key=lambda x: total[x]), 1 / sum(math.exp(v - top) for v in total.values())


def test_language_equals_a_plain_backoff(spark, odd):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("length(text) < 3000")
    learnt = docs.where("doc_id % 4 = 1 AND lang IS NOT NULL").select("lang", "text").collect()
    plain = PlainLanguages([(r.lang, r.text) for r in learnt])
    model = langid.learn(docs, F.col("doc_id") % 4 == 1)
    frame = docs.where("doc_id % 4 = 3").select("doc_id", "text").limit(25).unionByName(odd.where("length(text) < 1000 OR text IS NULL").select("doc_id", "text"))
    frame = frame.unionByName(spark.createDataFrame([(900, "zzqx thqeinvent ¡ñandú! 42 _ straße"), (901, "Ω"), (902, "日本")], "doc_id long, text string"))
    sums = {x: sum(c.values()) for x, c in plain.words.items()}
    assert min(sums.values()) > 0
    for r in langid.predict(frame, model).collect():
        lang, score = plain.predict(r.text)
        assert r.lang_pred == lang and r.lang_score == pytest.approx(score, abs=1e-6), r.text


def plain_toxicity(text, w, bias):
    """1 minus the product over sentences of 1 minus their logistic probability, and the sentences of at least a half."""
    rest, offending, n = 1.0, [], 0
    for m in re.finditer(r"[^.!?\n]*[.!?\n]*", text or ""):
        found = re.findall(r"\w+", m.group().lower())
        if found:
            n += 1
            z = bias + sum(float(w[zlib.crc32(x.encode()) % toxicity.BUCKETS]) for x in found)
            p = 1 / (1 + math.exp(-max(-700, min(700, z))))
            rest *= 1 - p
            if p >= 0.5:
                offending.append(m.span())
    return 1 - rest, n, offending


def test_toxicity_equals_a_plain_noisy_or(spark, labels, odd):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    w, bias = toxicity.learn(docs, labels, remainder(F.col("doc_id"), 5) != 0, sample=300)
    toxic = labels.where("toxic = 1").select("doc_id")
    frame = sample_of(spark, 200).unionByName(docs.join(toxic, "doc_id").select("doc_id", "text").limit(40)).unionByName(odd.select("doc_id", "text"))
    got = toxicity.score(frame, (w, bias)).collect()
    assert sum(len(r.offending) for r in got) > 10
    for r in got:
        p, n, offending = plain_toxicity(r.text, w, bias)
        assert r.toxic_score == pytest.approx(p, abs=1e-4) and r.n_sentences == n
        assert [(s.start, s.end) for s in r.offending] == offending


def test_toxicity_learns_the_sentence_that_explains_the_label(spark):
    """Bags whose label one word decides, wherever it stands: its sentence alone offends; any order of rows learns the same."""
    rng = np.random.default_rng(3)
    words = [f"w{k}" for k in range(60)]
    rows, marks = [], []
    for k in range(300):
        sentences = [" ".join(rng.choice(words, 6)) for _ in range(5)]
        if k % 2:
            sentences[k % 5] += " vile"
        rows.append((k, ". ".join(sentences) + "."))
        marks.append((k, k % 2))
    labels = spark.createDataFrame(marks, "doc_id long, toxic int")
    one, two = (toxicity.learn(spark.createDataFrame(r, "doc_id long, text string").repartition(n), labels, F.lit(True)) for r, n in ((rows, 1), (rows[::-1], 3)))
    assert np.array_equal(one[0], two[0]) and one[1] == two[1]
    for r in toxicity.score(spark.createDataFrame(rows, "doc_id long, text string"), one).collect():
        assert (r.toxic_score >= 0.5) == bool(r.doc_id % 2)
        assert all("vile" in r.text[s.start : s.end] for s in r.offending) and len(r.offending) == r.doc_id % 2


def test_sample_has_no_value_too_many(spark):
    """Thousands of stray values, and columns with the sample's own names."""
    rows = spark.range(6000).selectExpr("id AS doc_id", "concat('x', id % 3000) AS lang", "7 AS _share", "8 AS _value")
    got = hash_sample(rows, "lang", 2000)
    assert got.columns == rows.columns and got.count() == 6000 and {(r._share, r._value) for r in got.collect()} == {(7, 8)}


def test_quality_learns_from_every_labelled_document(spark, monkeypatch):
    """A trait that only few of the labelled documents have counts, however many there are; blocks give the same in any order."""
    rnd = np.random.default_rng(4)
    rows = [(k, "".join(rnd.choice(list("abcdefgh " if k % 3 else "0123!?xyz "), 40))) for k in range(9_000)]
    rare = [(k, "".join(rnd.choice(list("QRSTUV "), 40))) for k in range(9_000, 9_012)]  # labelled 0
    labels = spark.createDataFrame([(k, int(k % 3 > 0 and k < 9_000)) for k, _ in rows + rare], "doc_id long, quality int")
    frames = [spark.createDataFrame(r, "doc_id long, text string").repartition(n) for r, n in ((rows + rare, 2), ((rows + rare)[::-1], 5))]
    seen = []
    blocks = quality.fit_blocks
    monkeypatch.setattr(quality, "fit_blocks", lambda b, *rest: (seen.append(sum(len(r.y) for r in b.collect())), blocks(b, *rest))[1])
    one, two = (quality.learn(f, labels, F.lit(True)) for f in frames)
    assert seen == [9_012, 9_012]  # about 6,000 before
    assert np.array_equal(one[0], two[0]) and one[1] == two[1]
    got = {r.doc_id: r.quality_score >= 0.5 for r in quality.score(frames[0], one).collect()}
    assert np.mean([got[k] == (k % 3 > 0 and k < 9_000) for k in got]) > 0.99 and not any(got[k] for k, _ in rare)


def test_threshold_by_narrowed_ranges(spark):
    rng = np.random.default_rng(6)
    s, y = np.round(rng.normal(size=3_000), 2), rng.integers(0, 2, 3_000)
    frame = spark.createDataFrame([(float(a), int(b)) for a, b in zip(s, y)], "s double, y int").groupBy("s").agg(F.count_if(F.col("y") == 0).alias("n0"), F.count_if(F.col("y") == 1).alias("n1"))
    values, ones = np.unique(s), (y == 1).sum()
    for share in (0.0, 0.2, 0.5, 0.97, 1.0):
        w0, w1 = share / (3_000 - ones), (1 - share) / ones
        cum = [w0 * ((s <= v) & (y == 0)).sum() + w1 * ((s <= v) & (y == 1)).sum() for v in values]
        k = min(int(np.searchsorted(cum, share - 1e-9)), len(values) - 2)
        assert quality.crossing(frame, w0, w1, share, few=5) == pytest.approx((values[k] + values[k + 1]) / 2)
