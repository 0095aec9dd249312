import zlib

import corpus_pipeline as cp
from isopleth.llm import simhash
from test_decontam import brute as brute_leaks
from test_line_dedup import brute as brute_lines
from test_simhash import similar_classes

SF = "/root/testdata/sf0.001"


def rows(frame):
    return [(r.doc_id, r.text) for r in frame.collect()]


def test_stages_against_brute_force(spark, docs):
    good = cp.quality_stage(spark, docs, SF).cache()
    assert good.columns == docs.columns and 0 < good.count() < docs.count()
    lines = cp.line_dedup_stage(spark, good, SF).cache()
    assert sorted(rows(lines)) == sorted((d, t) for d, _, _, t in brute_lines(rows(good)))
    assert lines.columns == docs.columns and lines.where("n_chars <> length(text)").count() == 0
    single = cp.simhash_stage(spark, lines, SF).cache()
    given = sorted(rows(lines))
    label = similar_classes([tuple(map(int, x)) for x in simhash.prints([t for _, t in given], 5, 8)], simhash.wide())
    assert sorted(rows(single)) == sorted({k: r for r, k in reversed(list(zip(given, label)))}.values())
    clean = cp.decontam_stage(spark, single, SF).cache()
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    leaks = {d for d, t in rows(single) for _, x in bench if x in t}
    gone = {d for d, _ in rows(single)} - {d for d, _ in rows(clean)}
    assert leaks <= gone
    assert gone <= leaks | {d for d, _ in brute_leaks([r for r in rows(single) if r[0] in gone], bench)}
    packed = cp.packing_stage(spark, clean, SF)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == {d for d, _ in rows(clean)}


def test_odd_rows(spark, odd, empty):
    """What each stage makes of null, empty, long, repeated and tied rows, and of columns with its own names."""
    given = odd.columns
    good = cp.quality_stage(spark, odd, SF)
    assert good.columns == given and good.count() <= odd.count()
    mine = [c for c in odd.columns if odd.schema[c].dataType.simpleString() == "string" and c not in ("text", "lang", "source", "h1")]
    assert len(mine) > 20 and all(r[c] == "mine" for r in good.select(mine).collect() for c in mine)
    lines = cp.line_dedup_stage(spark, odd, SF)
    assert lines.columns == given and lines.count() == odd.count()
    text = {}
    for r in lines.collect():
        assert all(r[c] == "mine" for c in mine)
        text.setdefault(r.doc_id, []).append(r.text)
    assert text[1] == text[2] == [""] and text[4] == ["A", "A"] and text[5] == ["B"] and text[6] == ["  THE same long line in all of these. \nB"]
    single = cp.simhash_stage(spark, odd, SF)
    rows = single.collect()
    assert single.columns == given and all(r[c] == "mine" for r in rows for c in mine)
    ids = sorted((r.doc_id if r.doc_id is not None else -1) for r in rows)
    assert [k for k in ids if k in (1, 2, 3)] == [1] and -1 in ids and 7 in ids and ids.count(4) == 2
    clean = cp.decontam_stage(spark, odd, SF)
    assert clean.columns == given and clean.count() == odd.count() and all(r[c] == "mine" for r in clean.collect() for c in mine)
    packed = cp.packing_stage(spark, odd, SF)
    assert packed.agg({"length": "sum"}).first()[0] == sum(r.n for r in packed.where("start = 0").selectExpr("doc_tokens AS n").collect())
    for _, stage in cp.STAGES:
        assert stage(spark, empty, SF).count() == 0


def test_run_sweeps_what_it_wrote(spark, tmp_path, monkeypatch):
    from isopleth.llm import scratch

    monkeypatch.setattr(scratch, "shared_dir", lambda _: f"file://{tmp_path}")
    tables = {t.name for t in spark.catalog.listTables()}
    assert cp.run(spark, SF).count() > 0
    left = [p for p in tmp_path.iterdir() if p.is_dir()]
    assert [p.name.split("-")[0] for p in left] == ["pipeline"]
    assert [p.name.split("-")[1] for p in left[0].iterdir() if p.is_dir()] == ["packing"]
    assert {t.name for t in spark.catalog.listTables()} == tables and scratch._OPEN == []


def test_rows_without_an_id_stay(spark):
    frame = spark.createDataFrame([(None, "One text without an id, unlike any other in here."), (None, "Und noch ein anderer Satz, der ganz alleine steht."), (3, "x")], "doc_id long, text string")
    assert cp.simhash_stage(spark, frame, SF).count() == 3


def test_the_sequences_are_written(spark, docs):
    rows = cp.packing_stage(spark, docs.limit(50), SF).collect()
    assert rows and all(len(r.ids) == 4 * r.length and zlib.crc32(r.ids) == r.ids_crc32 % 2**32 for r in rows)
