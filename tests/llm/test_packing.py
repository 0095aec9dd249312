import random
import zlib
from collections import defaultdict

import numpy as np
from tokenizers import Tokenizer

from isopleth.llm import packing


def check(frame):
    tok = Tokenizer.from_file(packing.default_tokenizer())
    want = sorted(tuple(tok.encode(r.text or "", add_special_tokens=False).ids + [2]) for r in frame.select("text").collect())
    rows = packing.pack(frame, keep_ids=True, window_tokens=20_000).collect()
    docs, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        ids = np.frombuffer(bytes(r.ids), "<u4")
        assert len(ids) == r.length and zlib.crc32(ids.tobytes()) == r.ids_crc32
        docs[r.doc_id].append((r.start, ids.tolist(), r.doc_tokens))
        sequences[r.sequence_id].append((r.offset, r.length, r.tier))
    for pieces in sequences.values():
        at = 0
        for offset, length, tier in sorted(pieces):
            assert offset == at
            at += length
        assert at == tier and at & (at - 1) == 0 and at <= 4096
    return want, docs


def test_documents(docs):
    want, got = check(docs)
    made = []
    for pieces in got.values():
        ids = [x for _, p, _ in sorted(pieces) for x in p]
        assert len(ids) == pieces[0][2] and [s for s, _, _ in sorted(pieces)][0] == 0
        made.append(tuple(ids))
    assert sorted(made) == want


def test_odd_rows(odd):
    want, got = check(odd)
    assert sum(len(p) for pieces in got.values() for _, p, _ in pieces) == sum(map(len, want))


def test_empty(empty):
    assert packing.pack(empty).count() == 0


def test_groups_are_balanced(docs):
    rows = packing.pack(docs.repartition(1)).select("sequence_id", "tier", "step_group").distinct().collect()
    load = defaultdict(int)
    for r in rows:
        load[r.step_group] += r.tier
    full = sorted(load.values())[1:]
    assert max(full) <= 2 * packing.GROUP_TOKENS and min(full) >= packing.GROUP_TOKENS // 2


def test_ids_are_the_tokenizers():
    tok, enc = Tokenizer.from_file(packing.default_tokenizer()), packing.encoder(packing.default_tokenizer())
    texts = [t for c in range(0x250) for t in (chr(c), f"a{chr(c)}b", f"1{chr(c)}2", f"A{chr(c)} {chr(c)}'S")]
    special = [t.content for t in tok.get_added_tokens_decoder().values()]
    texts += [t for x in special for t in (x, f"ab{x}cd", f"{x} {x}", x.upper(), x[:-1], f"Ɗan {x}")]
    rnd = random.Random(11)
    parts = [*map(chr, range(0x250)), *special, " ", "\n", "'s", "'LL", "e\u0301", "中", "😂", "the", "42"]
    texts += ["".join(rnd.choices(parts, k=rnd.randrange(1, 12))) for _ in range(50_000)]
    want = tok.encode_batch(texts, add_special_tokens=False)
    wrong = [t for t, w in zip(texts, want) if enc(t).tolist() != w.ids]
    assert not wrong


def test_ids_of_another_tokenizer_are_its_own(spark):
    """Case, white space and contractions as that tokenizer has them, in single texts and in packed pieces."""
    path = packing.default_tokenizer().replace("word_bpe_49k", "byte_bpe_50k")
    tok, enc = Tokenizer.from_file(path), packing.encoder(path)
    texts = ["The quick Brown fox's 12 tests", "  two  spaces\nand\tlines ", "", "ÄÖ 中文 😂", "x" * 3000]
    assert not enc.fast and packing.encoder(packing.default_tokenizer()).fast
    want = {k: tok.encode(t, add_special_tokens=False).ids for k, t in enumerate(texts)}
    assert all(enc(t).tolist() == want[k] for k, t in enumerate(texts))
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    pieces = {}
    for r in packing.pack(frame, tokenizer=path, keep_ids=True).collect():
        pieces.setdefault(r.doc_id, []).append((r.start, np.frombuffer(r.ids, "<u4").tolist()))
    assert {k: [i for _, ids in sorted(p) for i in ids] for k, p in pieces.items()} == {k: [*ids, packing.END_ID] for k, ids in want.items()}
