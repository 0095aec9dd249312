"""Hierarchical multi-length packing of token ids into training sequences.

Each partition packs its own rows, in windows of bounded size, without a
shuffle. What a document has beyond whole long windows is routed to the
context tier that just holds it. Each tier is packed from the longest down;
the gap that a piece leaves in its window is filled with the best-fitting
pieces of shorter tiers, the last of which is cut to close it. Full windows
are then dealt to step groups, the longest first, each to the group with the
fewest tokens. At the end of a partition the rest is cut at powers of two.
"""

from __future__ import annotations

import heapq
import json
import re
import struct
import unicodedata
import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Lengths of the context tiers (powers of two); tokens that a partition packs at a time; tokens of a step group.
TIERS, WINDOW_TOKENS, GROUP_TOKENS = (512, 1024, 2048, 4096), 1 << 18, 1 << 16
END_ID = 2
#: Entries of a worker's memory of encoded words, after which it starts anew.
MEMO = 400_000


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class _Words(dict):
    """Ids of a word, little-endian 16 bits each, made on demand by the tokenizer's own model."""

    def __init__(self, model):
        super().__init__()
        self.model = model
        kept = {*range(33, 127), *range(161, 173), *range(174, 256)}
        spare = iter(range(256, 512))
        self.bytes = {b: chr(b if b in kept else next(spare)) for b in range(256)}

    def __missing__(self, word: str) -> bytes:
        ids = [t.id for t in self.model.tokenize(word.encode("utf-8").decode("latin-1").translate(self.bytes))]
        out = self[word] = struct.pack(f"<{len(ids)}H", *ids)
        return out


class _Chunks(dict):
    """Ids of a text's part between white space."""

    def __init__(self, words: _Words):
        super().__init__()
        self.words = words
        kinds = {k: "".join(re.escape(chr(c)) for c in range(0x250) if unicodedata.category(chr(c))[0] == k) for k in "LN"}
        self.split = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{kinds['L']}]+|[{kinds['N']}]|[^\s{kinds['L']}{kinds['N']}]+").findall

    def __missing__(self, chunk: str) -> bytes:
        out = self[chunk] = b"".join([self.words[w] for w in self.split(chunk)])
        return out


#: The normaliser, the splitter and the settings of the model that the memory of words stands for, as the tokenizer's file gives them.
IMITATED = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    "post_processor": None,
    "truncation": None,
    "padding": None,
}


def imitated(tokenizer) -> bool:
    """Whether a tokenizer splits words as the memory of words does and has ids of 16 bits."""
    file = json.loads(tokenizer.to_str())
    return all(file.get(k) == v for k, v in IMITATED.items()) and file["model"]["type"] == "BPE" and not file["model"].get("dropout") and tokenizer.get_vocab_size() <= 1 << 16


class Encoder:
    """The ids of any tokenizer; those of the lower-casing word tokenizer by memory of the parts between white space.

    A tokenizer with another normaliser or splitter, or with ids of over 16
    bits, encodes every text itself (``imitated``). Of the others only texts below U+0250 go that way, whose code points stand for themselves
    under normalisation and stay there in lower case; the others, and texts with
    a literal special token, go through the tokenizer whole. The ids are those
    of the tokenizer as loaded, so a literal special token is its own id.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.fast = imitated(self.tokenizer)
        special = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        high = "".join(chr(c) for c in range(0x250) if any(ord(x) >= 0x250 for x in chr(c).lower()))
        self.odd = re.compile("|".join([f"[\x1c-\x1f{high}ɐ-\U0010ffff]", *special])).search
        self.chunks = _Chunks(_Words(self.tokenizer.model))

    def __call__(self, text: str) -> np.ndarray:
        if not self.fast or self.odd(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=np.uint32)
        if len(self.chunks) > MEMO or len(self.chunks.words) > MEMO:
            self.chunks.clear()
            self.chunks.words.clear()
        return np.frombuffer(b"".join(map(self.chunks.__getitem__, text.lower().split())), dtype="<u2").astype(np.uint32)


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The encoder of this worker, kept from task to task."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


class Packer:
    """Packs pieces (doc, start, ids) of one partition; ``rows`` gathers those of closed sequences."""

    def __init__(self, partition: int = 0, tiers: tuple[int, ...] = TIERS, window: int = WINDOW_TOKENS, group: int = GROUP_TOKENS):
        self.tiers, self.window, self.group = sorted(tiers), window, group
        self.first = self.sequences = partition << 36
        self.groups = partition << 36
        self.waiting: dict[int, list] = {t: [] for t in self.tiers}
        self.held = self._n = 0
        self.closed: list[tuple[int, list]] = []
        self.rows: list[tuple] = []

    def add(self, doc, ids: np.ndarray) -> None:
        """ids: of a whole document with its end. doc: its (doc_id, number of ids)."""
        most, n = self.tiers[-1], len(ids)
        for at in range(0, n - n % most, most):
            self.closed.append((most, [(doc, at, ids[at : at + most])]))
        if n % most:
            self._wait((doc, n - n % most, ids[n - n % most :]))
        self.held += n
        if self.held >= self.window:
            self._pack()
            self._deal()

    def _wait(self, piece: tuple) -> None:
        self._n += 1
        n = len(piece[2])
        insort(self.waiting[next(t for t in self.tiers if t >= n)], (n, self._n, piece))

    def _filler(self, gap: int, tier: int) -> tuple | None:
        """The longest waiting piece of a shorter tier that fits the gap; else one cut to it, of the tier itself if no shorter one waits."""
        shorter = [t for t in reversed(self.tiers) if t < tier]
        for t in shorter:
            if at := bisect_right(self.waiting[t], (gap, self._n + 1)):
                return self.waiting[t].pop(at - 1)[2]
        for t in [*shorter, tier]:
            if self.waiting[t]:
                doc, start, ids = self.waiting[t].pop()[2]
                if len(ids) > gap:
                    self._wait((doc, start + gap, ids[gap:]))
                return doc, start, ids[:gap]
        return None

    def _pack(self) -> None:
        for tier in reversed(self.tiers):
            while self.waiting[tier]:
                pieces = [self.waiting[tier].pop()[2]]
                gap = tier - len(pieces[0][2])
                while gap and (piece := self._filler(gap, tier)):
                    pieces.append(piece)
                    gap -= len(piece[2])
                if gap:  # nothing else waits in this tier or below
                    rest = pieces
                    break
                self.closed.append((tier, pieces))
            else:
                continue
            for piece in rest:
                self._wait(piece)
            # shorter tiers are empty now
            break
        self.held = sum(n for t in self.tiers for n, _, _ in self.waiting[t])

    def _deal(self) -> None:
        """Gives the closed sequences their numbers and step groups: the longest first, each to the lightest group."""
        total = sum(n for n, _ in self.closed)
        loads = [(0, self.groups + k) for k in range(max(1, round(total / self.group)))]
        self.groups += len(loads)
        for n, pieces in sorted(self.closed, key=lambda x: -x[0]):
            load, name = heapq.heappop(loads)
            heapq.heappush(loads, (load + n, name))
            offset = 0
            for (doc_id, doc_tokens), start, ids in pieces:
                self.rows.append((doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), doc_tokens, self.sequences, offset, n, name, ids))
                offset += len(ids)
            self.sequences += 1
        self.closed = []

    def finish(self) -> None:
        """Packs what waits; the rest becomes sequences whose lengths are powers of two."""
        self._pack()
        rest = [p for t in self.tiers for _, _, p in self.waiting[t]]
        left = sum(len(p[2]) for p in rest)
        while left:
            size = min(self.tiers[-1], 1 << (left.bit_length() - 1))
            gap, pieces = size, []
            while gap:
                doc, start, ids = rest.pop()
                if len(ids) > gap:
                    rest.append((doc, start + gap, ids[gap:]))
                pieces.append((doc, start, ids[:gap]))
                gap -= len(pieces[-1][2])
            self.closed.append((size, pieces))
            left -= size
        if self.closed:
            self._deal()


SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, step_group long"


def pack(docs: DataFrame, tokenizer: str | None = None, tiers: tuple[int, ...] = TIERS, window_tokens: int = WINDOW_TOKENS, group_tokens: int = GROUP_TOKENS, keep_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per piece: where it is in its document and in its sequence, with ``ids`` (little-endian 32 bits) if keep_ids.

    Every id of every document, its closing id 2 included, lies in exactly one
    piece. All sequences are exactly as long as a power of two up to the
    longest tier, so none is padded. ``tier`` is the sequence's length and
    ``step_group`` names a group of sequences with about group_tokens tokens.

    Null and empty texts are the closing id alone. A text of any length is cut
    into pieces of at most the longest tier. Null ids and repeated rows are
    packed like others; equal lengths are taken in the order of the rows. An empty table gives an empty result. Other
    columns are ignored. sequence_id and step_group hold the partition's
    number above bit 36.
    """
    path = tokenizer or default_tokenizer()

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, packer = encoder(path), Packer(TaskContext.get().partitionId(), tiers, window_tokens, group_tokens)

        def out() -> pa.RecordBatch:
            rows, packer.rows = packer.rows, []
            columns = [pa.array([r[k] for r in rows], pa.int32() if k == 7 else pa.int64()) for k in range(9)]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "tier", "step_group"]
            if keep_ids:
                columns.append(pa.array([r[9].astype("<u4").tobytes() for r in rows], pa.binary()))
                names.append("ids")
            return pa.RecordBatch.from_arrays(columns, names)

        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1)):
                ids = np.append(encode(text.as_py() or ""), np.uint32(END_ID))
                packer.add((doc_id, len(ids)), ids)
                if len(packer.rows) >= 20_000:
                    yield out()
        packer.finish()
        if packer.rows:
            yield out()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(packed, SCHEMA + (", ids binary" if keep_ids else ""))
