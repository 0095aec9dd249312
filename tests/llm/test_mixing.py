import re

from isopleth.llm.mixing import mix, targets
from isopleth.llm.scratch import Scratch


def goals(sizes):
    """Targets by the rounds of the definition, over (source, size) sums."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    total, full = 1.5 * sum(sizes.values()), set()
    while True:
        rest = sum(w[s] for s in order if s not in full)
        left = total - sum(2 * sizes[s] for s in full)
        got = {s: 2.0 * sizes[s] if s in full else left * w[s] / rest for s in order}
        over = {s for s in order if got[s] > 2 * sizes[s]} - full
        if not over:
            return got
        full |= over


def held(rows):
    sizes, largest = {}, {}
    for r in rows:
        sizes[r.source] = sizes.get(r.source, 0) + r.size
        largest[r.source] = max(largest.get(r.source, 0), r.size)
    want = goals(sizes)
    for s in sizes:
        own = [r for r in rows if r.source == s]
        assert all(abs(r.target - want[s]) <= 1e-9 * max(1, want[s]) and r.source_size == sizes[s] for r in own)
        assert all(0 <= r.taken <= 2 * r.size and (not r.size or r.taken % r.size == 0) for r in own)
        assert abs(sum(r.taken for r in own) - want[s]) <= largest[s]
    return sizes


def test_documents_in_one_block_and_in_many(docs):
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    for block in (4096, 3):
        rows = mix(docs, block=block).collect()
        assert {r.doc_id: r.size for r in rows} == {d: len(re.findall(r"[^\x20\x09-\x0D]+", t)) for d, t in texts.items()} and len(rows) == len(texts)
        held(rows)
        again = mix(docs.repartition(5), block=block).collect()
        assert sorted(map(tuple, rows), key=str) == sorted(map(tuple, again), key=str)


def test_a_hot_source_is_balanced_in_tokens_and_documents(spark):
    rows = [(k, "hot" if k % 3 else f"s{k % 5}", "w " * (1 + k * k % 97)) for k in range(6000)]
    got = mix(spark.createDataFrame(rows, "doc_id long, source string, text string"), block=100).collect()
    held(got)
    hot = [r for r in got if r.source == "hot"]
    rate = hot[0].target / hot[0].source_size
    assert abs(sum(r.taken for r in hot) - hot[0].target) < 100
    assert abs(sum(r.taken // r.size for r in hot) - rate * len(hot)) <= 3


def test_odd_rows(odd, empty, spark):
    rows = mix(odd).collect()
    assert len(rows) == odd.count()
    held(rows)
    assert mix(empty).count() == 0
    none = mix(spark.createDataFrame([(1, None, None), (2, "a", " ")], "doc_id long, source string, text string")).collect()
    assert all((r.size, r.source_size, r.target, r.taken) == (0, 0, 0.0, 0) for r in none)


def test_excess_is_reshared_until_none_is_above(spark):
    sizes = {"a": 10, "b": 1000, "c": 30, "d": 5, None: 400, "é": 7, "z": 900}
    frame = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long")
    got = {r.source: r.target for r in targets(frame, Scratch(spark, "targets")).collect()}
    assert all(abs(got[s] - t) < 1e-9 for s, t in goals(sizes).items())
