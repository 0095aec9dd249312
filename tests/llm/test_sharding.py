import hashlib

from isopleth.llm.sharding import shard


def brute(rows, limit):
    h = lambda d: int(hashlib.md5(str("" if d is None else d).encode()).hexdigest()[:15], 16)
    size = lambda t: len((t or "").encode())
    out, todo = [], [(0, 0, [(d, size(t), h(d)) for d, t in rows])]
    while todo:
        depth, prefix, held = todo.pop()
        total = sum(n for _, n, _ in held)
        if total <= limit or depth == 60:
            out += [(d, n, f"{prefix:0{depth}b}" if depth else "", depth, total, len(held)) for d, n, _ in held]
            continue
        for bit in (0, 1):
            part = [x for x in held if x[2] >> (59 - depth) & 1 == bit]
            if part:
                todo.append((depth + 1, prefix * 2 + bit, part))
    return sorted(out, key=str)


def test_documents(docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    for limit in (10**9, 60_000, 3_000, 100):
        assert sorted((tuple(r) for r in shard(docs, limit).collect()), key=str) == brute(rows, limit)


def test_odd_rows(odd, empty):
    rows = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    assert sorted((tuple(r) for r in shard(odd, 1000).collect()), key=str) == brute(rows, 1000)
    assert shard(empty).count() == 0


def test_a_hot_key_is_split(spark):
    frame = spark.createDataFrame([("hot" if k % 3 else f"k{k}", k, "x" * 100) for k in range(600)], "source string, doc_id long, text string")
    got = shard(frame, 2000, key_col="source").collect()
    assert len(got) == 600 and max(r.shard_bytes for r in got) <= 2000
