import random

import numpy as np
import pyarrow as pa

from isopleth.llm import decontam


def brute(docs, items):
    """Documents with a window of words whose common subsequence with the item suffices."""
    out = set()
    for d, text in docs:
        words = decontam.codes(text).tolist()
        for k, item in items:
            c = decontam.codes(item).tolist()
            if len(c) >= 3 and any(decontam.matches(c, words[a : a + len(c) + 8])[1] for a in range(0, max(1, len(words) - len(c) + 1))):
                out.add((d, k))
    return out


def test_exact_and_paraphrased_leaks(spark, docs):
    rnd = random.Random(2)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    vocabulary = [f"{a}{b}{c}" for a in "bdfgklm" for b in "aeiou" for c in ("ron", "tis", "lam", "pex")]
    items = [(k, " ".join(rnd.choice(vocabulary) for _ in range(rnd.randrange(15, 60)))) for k in range(12)]
    for n, (k, text) in enumerate(items[:9]):
        words = text.split()
        if n % 3 == 1:
            words = [w if rnd.random() > 0.15 else rnd.choice(vocabulary) for w in words]
        if n % 3 == 2:
            del words[2::9]
        host = rows[7 * n][1].split()
        at = rnd.randrange(len(host) + 1)
        rows.append((10_000 + n, " ".join(host[:at] + words + host[at:])))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontam.contaminated(frame, bench).collect()}
    assert {(10_000 + n, n) for n in range(9)} <= got
    assert {g for g in got if g[0] < 10_000} == set() and all(g[1] == g[0] - 10_000 for g in got)


def test_benchmark_of_the_tables(spark, docs):
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    got = {(r.doc_id, r.item_id) for r in decontam.contaminated(docs, bench).collect()}
    exact = {(d.doc_id, b.item_id) for d in docs.collect() for b in bench.collect() if b.text in d.text}
    assert exact <= got
    found = brute([(r.doc_id, r.text) for r in docs.collect()], [(b.item_id, b.text) for b in bench.collect()])
    assert found <= got
    assert got <= brute([(r.doc_id, r.text) for r in docs.collect() if r.doc_id in {g[0] for g in got}], [(b.item_id, b.text) for b in bench.collect()]) | exact


def test_odd_rows(spark, odd, empty):
    bench = spark.createDataFrame([(1, None), (2, ""), (3, "The same long line in all of these."), (4, "a b")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontam.contaminated(odd, bench).collect()}
    assert got == {(4, 3), (5, 3), (6, 3)}
    assert decontam.contaminated(empty, bench).count() == 0
    assert decontam.contaminated(odd, bench.limit(0)).count() == 0


def test_lcs():
    assert decontam.lcs([1, 2, 3, 4], [2, 9, 3, 3, 1, 4]) == 3
    assert decontam.lcs([5] * 70, [5] * 66) == 66


def test_clashing_names_text_ids_and_repeated_items(spark, odd):
    rows = [("x-1", "The same long line in all of these.", 1), ("x-1", "The same long line in all of these.", 2), (None, "The same long line in all of these.", 3)]
    bench = spark.createDataFrame(rows, "item_id string, text string, block int")
    frame = odd.selectExpr("*", "'w' AS words", "'i' AS item", "1 AS item_id", "2 AS cosine", "3 AS at_word", "4 AS block")
    got = decontam.contaminated(frame, bench)
    assert got.schema["item_id"].dataType.simpleString() == "string"
    assert sorted((r.doc_id, r.item_id) for r in got.collect()) == [(4, "x-1"), (5, "x-1"), (6, "x-1")]


def test_blocks_of_items_give_the_same(spark, docs):
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    one, many = (sorted(map(tuple, decontam.contaminated(docs, bench, block=n).collect())) for n in (512, 7))
    assert one == many and len(one) > 0


def test_sections_of_long_texts_lose_no_window():
    """A long text in sections, against the search in the whole of it."""
    rnd = random.Random(7)
    vocabulary = [f"w{k}" for k in range(4000)]
    items = [(str(k), decontam.codes(" ".join(rnd.choices(vocabulary, k=rnd.randrange(10, 90))))) for k in range(6)]
    words = rnd.choices(vocabulary, k=150_000)
    texts = [" ".join(rnd.choices(vocabulary, k=50))]
    where = {}
    for n, at in enumerate([0, 32_767, 32_640, 65_500, 98_000, 149_960]):
        c = items[n][1]
        where[items[n][0]] = at
        words[at : at + len(c)] = [None] * len(c)
    raw, n = [], 0
    for w in words:
        raw.append(decontam.codes(w) if w else None)
    for k, c in items:
        at = where[k]
        for j, x in enumerate(c[: len(raw) - at]):
            raw[at + j] = np.array([x], np.uint32)
    long = np.concatenate(raw)
    latent = np.random.default_rng(0).normal(size=(decontam.FEATURES, decontam.RANK)).astype(np.float32)
    weights = np.random.default_rng(1).integers(0, 2, decontam.FEATURES).astype(np.float32)  # half of the words are common ones
    search = decontam.Items(items, weights, latent)
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array([decontam.word_codes(texts[0]), long.tobytes()], pa.binary())], ["doc_id", "words"])
    got = {}
    for owner, t, counts in decontam._sections(iter([batch]), (int(search.steps.max()) + 2) * decontam.STEP):
        assert len(t) <= 2 * decontam.CHUNK
        for (d, k), (_, share, at) in search.search(t, counts).items():
            key = owner[d][0], search.names[k]
            got[key] = max(got.get(key, (0, 0)), (share, -(at + owner[d][1])))
    want = {(2, search.names[k]): (share, -at) for (_, k), (_, share, at) in search.search(long, np.array([len(long)])).items()}
    assert got == want and {k for _, k in got} >= {k for k, c in items if where[k] + len(c) <= len(long)}


def test_no_match_is_lost_to_the_latent_space(spark):
    """Recall against all windows by brute force, for items that stand whole in documents and for paraphrases with 15, 25 and 30 % of their words replaced."""
    sf = "/root/testdata/sf0.1"
    frame = spark.read.parquet(f"{sf}/documents.parquet")
    bench = [(b.item_id, b.text) for b in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    rows = [(r.doc_id, r.text) for r in frame.where("doc_id % 25 = 0").collect()]
    whole = [(r.doc_id, r.text) for r in frame.collect() if any(x in (r.text or "") for _, x in bench)]
    rnd, planted = random.Random(4), {}
    for j, rate in enumerate((0.15, 0.25, 0.3)):
        for n, (k, item) in enumerate(bench):
            words, host = item.split(), rows[n][1].split()
            for x in rnd.sample(range(len(words)), int(rate * len(words))):
                words[x] = rnd.choice(host)
            at = rnd.randrange(len(host) + 1)
            planted[10_000_000 * (j + 1) + n] = " ".join(host[:at] + words + host[at:])
    given = whole + list(planted.items())
    got = {(r.doc_id, r.item_id) for r in decontam.contaminated(spark.createDataFrame(rows + given, "doc_id long, text string").dropDuplicates(["doc_id"]), spark.createDataFrame(bench, "item_id long, text string")).collect()}
    assert {(d, k) for d, t in whole for k, x in bench if x in t} <= got
    for j, rate in enumerate((0.15, 0.25, 0.3)):
        near = [(d, t, bench[d % 10_000_000]) for d, t in planted.items() if d // 10_000_000 == j + 1]
        want = {x for d, t, b in near for x in brute([(d, t)], [b])}
        print(f"{rate:.0%} replaced: {len(want & got)} of {len(want)} that brute force finds, of {len(near)} planted")
        assert len(want) > 100 and want <= got
