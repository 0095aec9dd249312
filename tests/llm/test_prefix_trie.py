import hashlib
import zlib
from collections import defaultdict

import pytest

from isopleth.llm.prefix_trie import trie

SCHEMA = "conv_id long, turn long, role string, text string, digest string, depth int, i int"


def brute(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            key = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()
            own[conv].append(((turn is not None, turn or 0), key, role, text))
    own = {c: [(r, t) for *_, r, t in sorted(v)] for c, v in own.items()}
    built = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = tuple(own.get(c - c % 5, [])[:h] + own[c][h:])
    members = defaultdict(list)
    for c, turns in sorted(built.items()):
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    children = defaultdict(int)
    leaves, saved = defaultdict(int), defaultdict(int)
    for p in members:
        if p:
            children[p[:-1]] += 1
    for p, held in members.items():
        cost = (len(held) - 1) * len(p[-1][1].encode()) if p else 0
        for d in range(len(p) + 1):
            leaves[p[:d]] += p not in children
            saved[p[:d]] += cost
    ends = {p: ",".join(str(c) for c in held if built[c] == p) for p, held in members.items()}
    return sorted((held[0], len(p), members[p[:-1]][0] if p else None, len(held), children.get(p, 0), leaves[p], saved[p], hashlib.sha256(ends[p].encode()).hexdigest()) for p, held in members.items())


@pytest.mark.parametrize("block", [512])
def test_conversations(spark, block):
    frame = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    assert sorted(tuple(r) for r in trie(frame, block).collect()) == brute([tuple(r) for r in frame.select("conv_id", "turn", "role", "text").collect()])


def odd_rows():
    rows = [(c, t, "user" if t % 2 else None, f"text {t % 4} {c // 10}") for c in range(20) for t in range(c % 7)]
    rows += [(5, None, "user", "first"), (5, 0, None, None), (5, 0, None, None), (None, 1, "user", "no conversation"), (5, 9, "", "x" * 50_000)]
    rows += [(c, t, "user", f"copy {t}") for c in range(100, 140) for t in range(4)] + [(c, t, "user", f"long {t}") for c in (200, 201) for t in range(30 + c % 5)]
    return rows


@pytest.mark.parametrize("block", [3])
def test_odd_rows_in_blocks_of_blocks(spark, block):
    rows = odd_rows()
    frame = spark.createDataFrame([(*r, "mine", 1, 2) for r in rows], SCHEMA)
    assert sorted((tuple(r) for r in trie(frame, block).collect())) == brute(rows)


def test_no_rows_and_no_turns_left(spark):
    assert trie(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(c, 0, "user", "gone") for c in range(1, 40) if c % 5 and zlib.crc32(str(c).encode()) % 9]
    got = [tuple(r) for r in trie(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()]
    assert got == brute(rows) and len(got) == 1
