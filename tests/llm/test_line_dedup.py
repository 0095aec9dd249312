from collections import defaultdict

from isopleth.llm.line_dedup import LineRuns, dedup_lines


def brute(rows):
    held = defaultdict(set)
    key = lambda line: "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))
    number = lambda d: -(2**63) if d is None else d
    for d, t in rows:
        for line in (t or "").split("\n"):
            held[key(line)].add(number(d))
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(k := key(x)) < 20 or len(held[k]) < 3 or max(held[k]) == number(d)]
        out.append((d, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def check(frame):
    rows = [(r.doc_id, r.text) for r in frame.select("doc_id", "text").collect()]
    assert sorted((tuple(r) for r in dedup_lines(frame).collect()), key=str) == brute(rows)


def test_documents(docs):
    check(docs)


def test_odd_rows(odd):
    check(odd)


def test_empty(empty):
    assert dedup_lines(empty).count() == 0


def test_runs_are_levelled(spark):
    runs = LineRuns(spark, fanout=2, n_bytes=9 << 30)
    for k in range(5):
        runs.add(spark.createDataFrame([(1, 1, 100 - k), (2 + k, 0, 100 - k)], "h1 long, h2 long, id long"))
    assert [len(x) for x in runs.levels] == [1, 0, 1]
    assert {(r.h1, r.n, r.top) for r in runs.keys().collect()} == {(1, 5, 100), *((2 + k, 1, 100 - k) for k in range(5))}
    kept = runs.runs()
    runs.close()
    assert kept and not [t for t in kept if spark.catalog.tableExists(t)]


def test_buckets_and_batches_grow_with_the_table(spark, docs):
    from isopleth.llm import line_dedup

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert LineRuns(spark).buckets == parts and LineRuns(spark, n_bytes=50 << 30).buckets == max(parts, 50)
    assert LineRuns(spark, n_bytes=1 << 50).buckets == 100_000
    whole = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert 0 < line_dedup.plan_bytes(whole) < 1 << 30 and line_dedup.plan_bytes(spark.createDataFrame([(1,)], "a int")) < 1 << 60
