import random

import numpy as np
import xxhash

from isopleth.llm import simhash


def brute_print(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ")
    words = [w for w in words if w]
    grams = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def classes(prints, most=4):
    label = list(range(len(prints)))
    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= most and label[i] != label[j]:
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    return label


def test_documents(docs):
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    prints = [brute_print(t) for _, t in rows]
    want = {rows[i][0]: (prints[i], rows[k][0]) for i, k in enumerate(classes(prints))}
    got = {r.doc_id: (r.fp % 2**64, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    assert got == want


def test_odd_rows(odd):
    got = simhash.near_duplicates(odd).collect()
    assert len(got) == odd.count()
    by = {r.doc_id: r for r in got}
    assert by[1].fp == 0 and {by[k].component_id for k in (1, 2, 3)} == {1}
    assert len([r for r in got if r.doc_id == 4]) == 2


def test_empty(empty):
    assert simhash.near_duplicates(empty).count() == 0


def groups(labelled):
    out = {}
    for x, k in labelled:
        out.setdefault(k, set()).add(x)
    return sorted(map(sorted, out.values()))


def found(spark, rows, plan, leaves):
    """Classes of the rows (tuples of unsigned words) by the tries."""
    signed = np.array(rows, dtype=np.uint64).view(np.int64).reshape(len(rows), plan.words).tolist()
    reps = spark.createDataFrame([(k, *r) for k, r in enumerate(signed)], "node long, " + ", ".join(f"{n} long" for n in simhash.names(plan.words)))
    root = {r.node: r.root for r in simhash.components(simhash.links(reps, plan, leaves), simhash.Scratch(spark, "test")).collect()}
    return groups((k, root.get(k, k)) for k in range(len(rows)))


def near_copies(rnd, words, n, most):
    """Distinct random fingerprints, some with copies that differ in up to ``most`` bits, some of which share whole words."""
    made = {tuple(rnd.getrandbits(64) for _ in range(words)) for _ in range(n)}
    for base in sorted(made)[: n // 4]:
        for _ in range(rnd.randrange(8)):
            x = list(base)
            for bit in rnd.sample(range(64 * words), rnd.randrange(1, most)):
                x[bit // 64] ^= 1 << bit % 64
            made.add(tuple(x))
    for base in sorted(made)[: n // 8]:  # all but one word in common
        made.add((*base[:-1], base[-1] ^ rnd.getrandbits(64)) if words > 1 else base)
    return sorted(made)


def test_trie_equals_brute_force(spark):
    rnd = random.Random(5)
    for most in (4, 5, 1):
        rows = near_copies(rnd, 1, 200, 8)
        want = groups(enumerate(classes([x for x, in rows], most)))
        assert all(found(spark, rows, simhash.narrow(most), leaves) == want for leaves in ((16384, 8, 1e-4) if most == 4 else (64,)))


def similar_classes(prints, plan):
    """Classes by all pairs: within the plan's bits in all and its errors in one of its heads."""
    label = list(range(len(prints)))
    heads = {(v.word, v.turn, v.head) for v in plan.views}
    turned = lambda x, v: (x << v[1] | x >> (64 - v[1])) & (1 << 64) - 1
    for i in range(len(prints)):
        for j in range(i):
            d = [x ^ y for x, y in zip(prints[i], prints[j])]
            near = sum(x.bit_count() for x in d) <= plan.most and any((turned(d[v[0]], v) >> (64 - v[2])).bit_count() <= plan.errors for v in heads)
            if near and label[i] != label[j]:
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    return label


def test_wide_trie_equals_brute_force(spark):
    rnd = random.Random(6)
    for plan, leaves in ((simhash.wide(), 16384), (simhash.wide(3, 20, 5), 8), (simhash.wide(2, 40, 4), 2e-4), (simhash.wide(2, 40, 4, 32, 3), 16), (simhash.wide(2, 40, 4, 30, 1), 1e-4)):
        rows = near_copies(rnd, plan.words, 120, plan.most * 3 // 2)
        assert found(spark, rows, plan, leaves) == groups(enumerate(similar_classes(rows, plan)))


def test_equal_words_lose_no_link(spark):
    """Equal first words with different second ones, and the reverse, each linked to a third fingerprint through one of them."""
    a, b, p, q = (random.Random(k).getrandbits(64) for k in range(4))
    rows = [(a, p), (a, q), (b, q ^ 7), (b ^ 3, p ^ 1), (a ^ 1, p ^ 2)]
    plan = simhash.wide(2, 20, 4)
    assert found(spark, rows, plan, 16384) == groups(enumerate(similar_classes(rows, plan)))
    plan = simhash.wide(2, 80, 4)
    assert found(spark, rows, plan, 16384) == groups(enumerate(similar_classes(rows, plan)))


def brute_wide(text, words=8, k=5):
    """The fingerprint's words by their definition, a bit at a time."""
    parts = (text or "").encode().lower().split()
    grams = [b" ".join(parts[i : i + k]) for i in range(max(1, len(parts) - k + 1))] if parts else []
    out = []
    for w in range(words):
        hashes = [int(simhash._mixed(np.array([xxhash.xxh64_intdigest(g, 42)], np.uint64), w)[0]) for g in grams]
        out.append(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)))
    return tuple(out)


def test_prints(monkeypatch):
    rnd = random.Random(2)
    texts = [" ".join(rnd.choices(["a", "B", "cc", "Ünï", "\u00a0", "x" * 30, "\t", "\x1c"], k=n)) for n in (0, 1, 3, 4, 5, 6, 7, 254, 258, 259, 260, 515, 3000)] + [None, "", " \n"]
    want = [brute_wide(t) for t in texts]
    assert [tuple(r) for r in simhash.prints(texts, 5, 8).tolist()] == want
    monkeypatch.setattr(simhash, "PART_BYTES", 40)  # as for very long texts
    assert [tuple(r) for r in simhash.prints(texts, 5, 8).tolist()] == want


def changed(rnd, text, share):
    words = text.split()
    for _ in range(max(1, int(len(words) * share))):
        words[rnd.randrange(len(words))] = f"changed{rnd.randrange(99)}"
    return " ".join(words)


def test_similar_documents(spark, docs, odd, empty):
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    rnd = random.Random(1)
    rows += [(5000 + k, changed(rnd, rows[k][1], 1 / 60)) for k in range(40)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    label = similar_classes([tuple(map(int, x)) for x in simhash.prints([t for _, t in rows], 5, 8)], simhash.wide())
    got = {r.doc_id: r.component_id for r in simhash.similar_documents(frame).collect()}
    assert got == {r[0]: rows[k][0] for r, k in zip(rows, label)}
    assert simhash.similar_documents(odd).count() == odd.count() and simhash.similar_documents(empty).count() == 0


def test_recall_by_similarity(spark):
    """Pairs of invented texts by the true similarity of their shingles: found from 0.8 on, left alone below 0.6."""
    rnd = random.Random(9)
    vocabulary = ["".join(rnd.choices("abcdefghijklmnop", k=rnd.randrange(3, 9))) for _ in range(3000)]
    texts, similar = [], []
    grams = lambda t: {tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)}
    for k in range(600):
        one = " ".join(rnd.choices(vocabulary, k=rnd.randrange(60, 400)))
        two = changed(rnd, one, rnd.uniform(0, 0.12))
        x, y = grams(one), grams(two)
        texts += [one, two]
        similar.append(len(x & y) / len(x | y))
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    root = {r.doc_id: r.component_id for r in simhash.similar_documents(frame).collect()}
    hit = np.array([root[2 * k] == root[2 * k + 1] for k in range(600)])
    s = np.array(similar)
    assert (s >= 0.8).sum() > 50 and hit[s >= 0.9].mean() > 0.99 and hit[s >= 0.8].mean() >= 0.95
    assert hit[(s >= 0.8) & (s < 0.85)].mean() >= 0.85 and hit[s < 0.6].mean() <= 0.02
    assert all(root[2 * k] in (2 * k, 2 * k + 1) for k in range(600))
