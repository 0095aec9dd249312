"""The prefix trie of conversations, built from chained digests.

A turn's digest is the SHA-256 of its role and text; a prefix's digest is the
SHA-256 of the digest before it and its last turn's. Each conversation's
prefixes are exploded and grouped by (depth, digest): a group is a node of the
trie. A node's values are exploded to all its ancestors, whose sums are those
of their subtrees.

A conversation is held in blocks of ``BLOCK`` turns. Blocks are chained on
their own; the digests of whole blocks are chained over the conversation in
the same way, level by level, so no task holds a long conversation. Sums go to
the ancestors in the block first, then from the tops of blocks to the blocks
above. A node is owned by the smallest conversation that runs through it; the
values of the nodes that one conversation owns in a block are added up before
they are exploded, so copies of a conversation cost nothing there.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordering import numbered
from .scratch import Scratch

#: Turns of a block; bits of an identifier within a bucket of identifiers that are joined to one text.
BLOCK, BUCKET_BITS = 512, 9
#: The digest of the empty prefix.
ROOT = hashlib.sha256(b"").digest()


def _sha(c: Column) -> Column:
    return F.unhex(F.sha2(c, 256))


def turns_of(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, x, nb): a row per turn with its digest and the bytes of its text. Rows without a conversation are left out."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = _sha(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text))
    return conversations.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), "turn", digest.alias("x"), F.octet_length(text).cast("long").alias("nb"))


def rebuilt(turns: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Every conversation c with the first h turns of c - c % 5 in the place of its own first h, h = crc32(c) % 9.

    ``turns`` has (conv_id, pos, x, nb). Returns the turns (conv_id, i, x, nb,
    last) and the conversations (conv_id, total).
    """
    lengths = turns.groupBy("conv_id").agg(F.max("pos").alias("own"))
    convs = lengths.select("conv_id", "own", (F.col("conv_id") - F.col("conv_id") % 5).alias("source"), (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9).alias("h"))
    convs = convs.join(lengths.select(F.col("conv_id").alias("source"), F.col("own").alias("held")), "source", "left")
    convs = convs.withColumn("k", F.least("h", F.coalesce("held", F.lit(0))))
    convs = scratch.write(convs.select("conv_id", "source", "h", "k", (F.col("k") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("total")), "convs")
    first = turns.where((F.col("conv_id") % 5 == 0) & (F.col("pos") <= 8)).withColumnRenamed("conv_id", "source")
    heads = first.join(convs, "source").where("pos <= k").withColumn("i", F.col("pos"))
    tails = turns.join(convs, "conv_id").where("pos > h").withColumn("i", F.col("pos") - F.col("h") + F.col("k"))
    cols = ["conv_id", "i", "x", "nb", (F.col("i") == F.col("total")).alias("last")]
    return heads.select(*cols).unionByName(tails.select(*cols)), convs.select("conv_id", "total")


def chained(turns: DataFrame, longest: int, block: int, scratch: Scratch) -> DataFrame:
    """(conv_id, b, cells, path, before): blocks of turns in order, the digest of each prefix, and that of the prefix before the block."""
    cells = F.array_sort(F.collect_list(F.struct("i", "x", "nb", "last")))
    blocks = turns.groupBy("conv_id", F.expr(f"(i - 1) div {block}").alias("b")).agg(cells.alias("cells"))
    chain = F.aggregate("cells", F.array(F.lit(ROOT)), lambda made, c: F.concat(made, F.array(_sha(F.concat(F.element_at(made, -1), c["x"])))))
    blocks = scratch.write(blocks.withColumn("path", F.slice(chain, 2, block)), "blocks")
    if longest <= block:
        return blocks.withColumn("before", F.lit(ROOT))
    ends = blocks.where(F.size("path") == block).select("conv_id", (F.col("b") + 1).alias("i"), F.element_at("path", -1).alias("x"), F.lit(0).cast("long").alias("nb"), F.lit(False).alias("last"))
    upper = chained(ends, -(-longest // block), block, scratch)
    upper = upper.select("conv_id", F.explode(F.arrays_zip(F.transform("cells", lambda c: c["i"]).alias("i"), "path")).alias("u")).select("conv_id", F.col("u.i").alias("b"), F.col("u.path").alias("start"))
    whole = blocks.join(upper, ["conv_id", "b"], "left")
    whole = whole.withColumn("path", F.when(F.col("start").isNull(), F.col("path")).otherwise(F.transform("path", lambda c: _sha(F.concat("start", c))))).drop("start")
    whole = scratch.write(whole, "whole")
    last = whole.where(F.size("path") == block).select("conv_id", (F.col("b") + 1).alias("b"), F.element_at("path", -1).alias("before"))
    return whole.join(last, ["conv_id", "b"], "left").withColumn("before", F.coalesce("before", F.lit(ROOT)))


def to_ancestors(paths: DataFrame, values: DataFrame, block: int) -> DataFrame:
    """(depth, digest, leaves, saved): values (conv_id, i, leaves, saved) added up over each node and its ancestors in the block.

    The values of a conversation in a block lie at a run of places that ends
    with its path, so the sums from each place on are made in its row.
    """
    held = values.groupBy("conv_id", F.expr(f"(i - 1) div {block}").alias("b")).agg(F.array_sort(F.collect_list(F.struct("i", "leaves", "saved"))).alias("v"))
    pair = "array(named_struct('leaves', {}, 'saved', {}))"
    sums = F.expr(f"aggregate(reverse(v), {pair.format('0L', '0L')}, (made, x) -> concat({pair.format('x.leaves + made[0].leaves', 'x.saved + made[0].saved')}, made))")
    rows = paths.select("conv_id", "b", "path").join(held, ["conv_id", "b"])
    rows = rows.select("b", F.col("v")[0]["i"].alias("first"), sums.alias("sums"), F.posexplode("path").alias("at", "digest"))
    rows = rows.withColumn("depth", F.col("b") * block + F.col("at") + 1)
    own = F.element_at("sums", (F.greatest(F.col("depth") - F.col("first"), F.lit(0)) + 1).cast("int"))
    return rows.select("depth", "digest", own.alias("s")).groupBy("depth", "digest").agg(F.sum("s.leaves").alias("leaves"), F.sum("s.saved").alias("saved"))


def subtree_sums(paths: DataFrame, owners: DataFrame, values: DataFrame, longest: int, block: int, scratch: Scratch) -> DataFrame:
    """(depth, digest, leaves, saved) of every node below the root: values of (conv_id, i) over its subtree. owners: (depth, digest, conv_id)."""
    inside = to_ancestors(paths, values, block)
    if longest <= block:
        return inside
    up = lambda depth: F.expr(f"({depth} - 1) div {block} + 1")
    tops = scratch.write(owners.where(f"(depth - 1) % {block} = 0").withColumn("depth", up("depth")), "tops")
    raised = inside.where(f"(depth - 1) % {block} = 0").withColumn("depth", up("depth")).join(tops, ["depth", "digest"])
    raised = scratch.write(raised.select("conv_id", F.col("depth").alias("i"), "leaves", "saved"), "raised")
    chain = paths.groupBy("conv_id", F.expr(f"b div {block}").alias("_b")).agg(F.array_sort(F.collect_list(F.struct("b", F.col("path")[0].alias("top")))).alias("t"))
    chain = chain.select("conv_id", F.col("_b").alias("b"), F.transform("t", lambda t: t["top"]).alias("path"))
    above = subtree_sums(chain, tops, raised, -(-longest // block), block, scratch).where("depth > 1").join(tops, ["depth", "digest"])
    handed = above.select("conv_id", ((F.col("depth") - 1) * block).alias("i"), "leaves", "saved")
    merged = values.unionByName(handed).groupBy("conv_id", "i").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    return to_ancestors(paths, merged, block)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each digest's texts, comma-joined, from rows in the order of digest and bucket: one running hash at a time."""
    key, running, out = None, None, []
    for batch in batches:
        for digest, ids in zip(batch["digest"].to_pylist(), batch["ids"].to_pylist(), strict=True):
            if digest != key:
                if running:
                    out.append((key, running.hexdigest()))
                key, running = digest, hashlib.sha256(ids.encode())
            else:
                running.update(b"," + ids.encode())
        if len(out) >= 10_000:
            yield _rows(out)
            out = []
    if running:
        out.append((key, running.hexdigest()))
    yield _rows(out)


def _rows(out: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], pa.binary()), pa.array([h for _, h in out], pa.string())], ["digest", "ends_sha256"])


def ends_of(ends: DataFrame) -> DataFrame:
    """(digest, ends_sha256): hash of the ascending identifiers of the conversations that end at a node.

    Identifiers are joined in buckets before the shuffle to their node, and a
    node's buckets stream through its hash in order; nothing is gathered.
    """
    bucket = ends.groupBy("digest", F.shiftright("conv_id", BUCKET_BITS).alias("bucket")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("ids"))
    return bucket.repartition("digest").sortWithinPartitions("digest", "bucket").select("digest", "ids").mapInArrow(_hashed, "digest binary, ends_sha256 string")


def trie(conversations: DataFrame, block: int = BLOCK) -> DataFrame:
    """A row per node of the trie of rebuilt conversations: (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256).

    Turns go by ``turn``, null first; turns that share one go by their
    digests, repeated rows stay repeated. A null role or text is empty. Rows
    whose conv_id is null belong to no conversation. A conversation that loses
    all its turns is a member of the root alone. Very long texts count through
    their digests; very long conversations are held in blocks. An empty table
    gives an empty result. Other columns are ignored, whatever their names.
    """
    scratch = Scratch(conversations.sparkSession, "prefix_trie")
    placed = numbered(turns_of(conversations), ["conv_id"], [F.col("turn").asc_nulls_first(), F.col("x").asc()], "pos", scratch)
    turns, convs = rebuilt(scratch.write(placed.drop("turn"), "turns"), scratch)
    longest = convs.agg(F.max("total")).first()[0] or 0
    blocks = chained(turns, longest, block, scratch)
    before = F.concat(F.array("before"), F.col("path"))
    prefixes = blocks.select("conv_id", F.explode(F.arrays_zip(F.transform("cells", lambda c: c).alias("cell"), "path", F.slice(before, F.lit(1), F.size("path")).alias("up"))).alias("p"))
    prefixes = prefixes.select("conv_id", F.col("p.cell.i").alias("depth"), F.col("p.path").alias("digest"), F.col("p.up").alias("parent"), F.col("p.cell.nb").alias("nb"), F.col("p.cell.last").alias("last"))
    root = convs.select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit(ROOT).alias("digest"), F.lit(None).cast("binary").alias("parent"), F.lit(0).cast("long").alias("nb"), (F.col("total") == 0).alias("last"))
    every = scratch.write(prefixes.unionByName(root), "prefixes")
    nodes = every.groupBy("depth", "digest", "parent", "nb").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"))
    nodes = scratch.write(nodes, "nodes")
    children = nodes.where("depth > 0").groupBy(F.col("parent").alias("digest")).agg(F.count("*").alias("n_children"))
    nodes = nodes.join(children, "digest", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    nodes = scratch.write(nodes, "counted")
    values = nodes.where("depth > 0").select("conv_id", F.col("depth").alias("i"), (F.col("n_children") == 0).cast("long").alias("leaves"), ((F.col("n_convs") - 1) * F.col("nb")).alias("saved"))
    sums = subtree_sums(blocks, nodes.where("depth > 0").select("depth", "digest", "conv_id"), values, longest, block, scratch)
    sums = scratch.write(sums, "sums")
    whole = sums.where("depth = 1").groupBy(F.lit(0).cast("long").alias("depth"), F.lit(ROOT).alias("digest")).agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    parents = nodes.select(F.col("digest").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    out = nodes.join(sums.unionByName(whole), ["depth", "digest"], "left").join(ends_of(every.where("last").select("digest", "conv_id")), "digest", "left").join(parents, "parent", "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.coalesce("leaves", F.lit(1)).cast("long").alias("n_leaves"), F.coalesce("saved", F.lit(0)).cast("long").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))
