"""Prefix tries of conversations.

A turn is a digest of its role and text; a prefix has the exclusive or of the digests of its turns with their
places as its key, so prefixes are keyed wherever their turns are. Equal conversations become one sequence with a
count. Sequences are dealt by a hash of their first turn, and each task builds pointer tries of dictionaries from
the sequences that it is given; children have larger numbers than their parents, so one walk backwards over the
numbers is a postorder without recursion. A first-turn subtrie of more rows than `limit` is parted by the next turn,
its parts again, and so on: a prefix with more rows than the limit is a node of the *top*, sequences are dealt by the
first prefix that has fewer, and what the parts give at their roots is summed up the top by places in blocks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions.scratch import Scratch, bound_batches

#: Rows of a subtrie that one task may be given: a partition's share of all rows, but not fewer than the first nor
#: more than the second.
LEAST, LIMIT = 1_000, 200_000
#: Turns of one conversation that one task may be given.
BLOCK = 1 << 16
#: Ids of a node that are one string; their digest takes strings one after the other.
ID_BLOCK = 1 << 16
_KEY = ["k1", "k2", "depth"]


def running(rows: DataFrame, keys: list[str], block: str, at: Column, back: bool = False, **sums: tuple) -> DataFrame:
    """Running aggregates of each key's rows in order of block and `at` (backwards with `back`), ties together.
    sums: name = (aggregate, column, how two results are combined); the aggregate of blocks' aggregates must be that of
    their rows, so counts are sums of ones. A key's blocks are tasks of their own, so a key
    of very many rows is many tasks; what comes before a block is a short table of block totals."""
    order = F.col(block).desc() if back else F.col(block)
    inside = Window.partitionBy(*keys, block).orderBy(at.desc() if back else at)
    before = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(*keys, block).agg(*[f(c).alias(n) for n, (f, c, _) in sums.items()])
    carry = totals.select(*keys, block, *[f(n).over(before).alias(f"{n}_before") for n, (f, _, _) in sums.items()])
    out = rows.withColumns({n: f(c).over(inside) for n, (f, c, _) in sums.items()}).join(carry, [*keys, block])
    out = out.withColumns({n: plus(F.col(n), F.coalesce(f"{n}_before", F.lit(0))) for n, (_, _, plus) in sums.items()})
    return out.drop(*[f"{n}_before" for n in sums])


def ordered_turns(turns: DataFrame, scratch: Scratch, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, r, d1, d2, words): each turn's place (from 0) in its conversation, its digest and its words. Turns
    come in order of their number, null first; of equal numbers by role, then text. A sort over all rows deals them,
    so a conversation may be many tasks."""
    inner = turns.select(
        F.col(conv_col).cast("bigint").alias("conv"), F.col(turn_col).alias("turn"),
        *[F.coalesce(F.col(c), F.lit("")).alias(n) for c, n in ((role_col, "role"), (text_col, "text"))],
    ).filter("conv is not null")
    spread = inner.withColumn("tie", F.monotonically_increasing_id())
    ranged = spread.orderBy("conv", F.col("turn").asc_nulls_first(), "role", "text", "tie").select(
        "conv", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at"),
        F.xxhash64("role", "text").alias("d1"), F.xxhash64(F.lit(1), "text", "role").alias("d2"),
        F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint").alias("words"),
    )
    out = running(scratch.save(ranged), ["conv"], "part", F.col("at"), r=(F.sum, F.lit(1), lambda a, b: a + b))
    return out.select("conv", (F.col("r") - 1).alias("r"), "d1", "d2", "words")


def rebuilt(turns: DataFrame, scratch: Scratch, group: int = 20, most: int = 4) -> DataFrame:
    """(conv, depth, d1, d2, words): conversations that begin with turns of another. Of conversation c, the first h
    turns are those of c - c % group (fewer if it has fewer), and its own follow after its first h, where
    h = crc32(c in decimal) % most. depth counts from 1; each conversation has one row of depth 0 beside its turns."""
    turns = scratch.save(turns)
    h = (F.crc32(F.col("conv").cast("string").cast("binary")) % most).alias("h")
    convs = scratch.save(turns.groupBy("conv").agg(F.count("*").alias("n")).select("conv", "n", h, (F.col("conv") - F.col("conv") % group).alias("base")))
    base = turns.filter(f"conv % {group} = 0 and r < {most - 1}").withColumnRenamed("conv", "base")
    taken = convs.filter("h > 0").select("conv", "h", "base").join(base, "base").filter("r < h").select("conv", (F.col("r") + 1).alias("depth"), "d1", "d2", "words")
    short = convs.select(F.col("conv").alias("base"), "n").join(convs.select("conv", "h", "base"), "base", "right")
    short = short.select("conv", (F.col("h") - F.least("h", F.coalesce("n", F.lit(0)))).alias("lack")).filter("lack > 0")
    own = turns.withColumn("h", h).filter("r >= h").join(short, "conv", "left")
    own = own.select("conv", (F.col("r") + 1 - F.coalesce("lack", F.lit(0))).alias("depth"), "d1", "d2", "words")
    none = [F.lit(0).cast("bigint").alias(c) for c in ("depth", "d1", "d2", "words")]
    return taken.unionByName(own).unionByName(convs.select("conv", *none))


def _tries(pdf: pd.DataFrame) -> pd.DataFrame:
    """Nodes of the tries of the sequences in `pdf`; each begins at its row of the least depth."""
    pdf = pdf.sort_values(["seq", "depth"], kind="stable")
    roots: dict[tuple, int] = {}
    children: list[dict[tuple, int]] = []
    parent, conv, count, words, key = [], [], [], [], []
    last, node = None, -1
    for seq, depth, start, k1, k2, p1, p2, d1, d2, w, n in zip(*(pdf[c].tolist() for c in ("seq", "depth", "start", "k1", "k2", "p1", "p2", "d1", "d2", "words", "n")), strict=True):
        if seq != last:
            last, node = seq, -1
        at, step = (roots, (k1, k2, depth)) if depth == start else (children[node], (d1, d2))
        found = at.get(step)
        if found is None:
            found = at[step] = len(parent)
            children.append({})
            parent.append(node)
            conv.append(seq)
            count.append(0)
            words.append(w)
            key.append((k1, k2, depth, p1, p2))
        node = found
        count[node] += n
        conv[node] = min(conv[node], seq)
    leaves = [0] * len(parent)
    saved = [(n - 1) * w for n, w in zip(count, words, strict=True)]
    for i in range(len(parent) - 1, -1, -1):  # children before parents
        leaves[i] = leaves[i] or 1
        if parent[i] >= 0:
            leaves[parent[i]] += leaves[i]
            saved[parent[i]] += saved[i]
    out = pd.DataFrame(key, columns=["k1", "k2", "depth", "p1", "p2"], dtype="int64")
    above = [conv[p] if p >= 0 else None for p in parent]
    return out.assign(conv=conv, above=pd.array(above, "Int64"), n=count, children=[len(c) for c in children], leaves=leaves, saved=saved)


_NODE = "k1 bigint, k2 bigint, depth bigint, p1 bigint, p2 bigint, conv bigint, above bigint, n bigint, children bigint, leaves bigint, saved bigint"


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the strings of each key, joined by commas; keys and their strings come in order."""
    key, digest, out = None, None, []

    def flush() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_pylist(out, pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("depth", pa.int64()), ("ends_sha256", pa.string())]))
        out.clear()
        return batch

    for batch in batches:
        for *k, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if k == key:
                digest.update(b",")
            else:
                if key is not None:
                    out.append({**dict(zip(_KEY, key, strict=True)), "ends_sha256": digest.hexdigest()})
                key, digest = k, hashlib.sha256()
            digest.update(text.encode())
        if len(out) >= 10_000:
            yield flush()
    if key is not None:
        out.append({**dict(zip(_KEY, key, strict=True)), "ends_sha256": digest.hexdigest()})
        yield flush()


def prefix_trie(turns: DataFrame, scratch: Scratch | None = None, limit: int | None = None, block: int = BLOCK) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of each node of the
    trie of conversations, given as rebuilt() or ordered_turns() with depths from 1 gives them: conv, depth, d1, d2,
    words, and a row of depth 0 for each conversation, which alone makes a member of the root.

    A node is a distinct sequence of first turns. conv_id is its smallest member; its last turn is turn `depth` of
    that conversation. saved_tokens sums over its subtree the words of a node's last turn times its members but one;
    n_leaves counts the subtree's nodes without children; ends_sha256 is the digest of the ids of the conversations
    that are the node's sequence, ascending in decimal. Conversations that are equal end at one node. Empty table:
    empty result, without a root. Turns are equal by 128 bits of two hashes of role and text, sequences by 128 bits.
    """
    scratch = scratch or Scratch(turns.sparkSession, "prefix-trie")
    bound_batches(turns.sparkSession)
    xor = lambda a, b: a.bitwiseXOR(b)
    rows = scratch.save(turns.withColumn("block", F.floor(F.col("depth") / block)))
    place = [F.when(F.col("depth") > 0, F.xxhash64("depth", *c)).otherwise(F.lit(0).cast("bigint")) for c in (("d1", "d2"), ("d2", "d1"))]
    keyed = running(rows.withColumns({"z1": place[0], "z2": place[1]}), ["conv"], "block", F.col("depth"), k1=(F.bit_xor, F.col("z1"), xor), k2=(F.bit_xor, F.col("z2"), xor))
    keyed, found = scratch.measure(keyed.withColumns({"p1": xor(F.col("k1"), F.col("z1")), "p2": xor(F.col("k2"), F.col("z2"))}).drop("z1", "z2", "block"), F.count("*").alias("rows"))
    scratch.drop(rows)
    partitions = int(scratch.spark.conf.get("spark.sql.shuffle.partitions"))
    if limit is None:
        limit = min(LIMIT, max(LEAST, found["rows"] // partitions))
    # Equal conversations are one sequence, named by its smallest id.
    ends = scratch.save(keyed.groupBy("conv").agg(F.max(F.struct("depth", "k1", "k2")).alias("end")).select("conv", "end.*"))
    seqs = scratch.save(ends.groupBy(_KEY).agg(F.min("conv").alias("seq"), F.count("*").alias("n")))
    named = seqs.select("seq", "n", F.col("depth").alias("length"))
    steps = scratch.save(keyed.filter("depth > 0").join(named, F.col("conv") == F.col("seq")).drop("conv"))
    # The top: prefixes that too many rows go on from. Sequences are dealt by the first prefix that is none.
    heavy = scratch.save(steps.groupBy(_KEY).agg(F.sum(F.col("length") - F.col("depth") + 1).alias("size")).filter(F.col("size") > limit).select(_KEY))
    above = scratch.save(steps.join(heavy, _KEY))
    start = steps.join(above.groupBy("seq").agg(F.max("depth").alias("last")), "seq", "left").filter("depth = coalesce(last, 0) + 1")
    start = start.select("seq", F.col("depth").alias("start"), F.col("k1").alias("g1"), F.col("k2").alias("g2"))
    n_buckets = max(partitions, -(-found["rows"] // max(limit, 1)))
    dealt = steps.join(start, "seq").filter("depth >= start").withColumn("bucket", F.pmod(F.xxhash64("g1", "g2"), F.lit(n_buckets)))
    low = scratch.save(dealt.drop("g1", "g2", "length").groupBy("bucket").applyInPandas(_tries, _NODE))
    top = scratch.save(_top(seqs, above, low.filter("above is null"), block))
    # The roots of parts have their parents in the top.
    up = top.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), (F.col("depth") + 1).alias("depth"), F.col("conv").alias("up"))
    nodes = low.unionByName(top).join(up, ["p1", "p2", "depth"], "left")
    listed = ends.withColumn("chunk", F.floor(F.col("conv") / ID_BLOCK)).groupBy(*_KEY, "chunk").agg(F.concat_ws(",", F.array_sort(F.collect_list("conv")).cast("array<string>")).alias("ids"))
    shas = listed.repartition(*_KEY).sortWithinPartitions(*_KEY, "chunk").select(*_KEY, "ids").mapInArrow(_digests, "k1 bigint, k2 bigint, depth bigint, ends_sha256 string")
    return nodes.join(shas, _KEY, "left").select(
        F.col("conv").alias("conv_id"), "depth", F.coalesce("above", "up").alias("parent_conv_id"), F.col("n").alias("n_convs"), F.col("children").alias("n_children"),
        F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )


def _top(seqs: DataFrame, above: DataFrame, parts: DataFrame, block: int) -> DataFrame:
    """The root and the nodes whose subtries were parted. A node's own share of a subtree's sums stands in the row
    of its smallest sequence; from there it reaches each prefix of that sequence, and these are all nodes above it."""
    zero = F.lit(0).cast("bigint")
    root = seqs.agg(F.min("seq").alias("conv"), F.sum("n").alias("n")).filter("conv is not null").select(zero.alias("k1"), zero.alias("k2"), zero.alias("depth"), zero.alias("p1"), zero.alias("p2"), "conv", "n", zero.alias("words"))
    own = above.groupBy(*_KEY, "p1", "p2").agg(F.min("seq").alias("conv"), F.sum("n").alias("n"), F.max("words").alias("words"))
    both = own.select("p1", "p2", "depth").unionByName(parts.select("p1", "p2", "depth"))
    children = both.groupBy(F.col("p1").alias("k1"), F.col("p2").alias("k2"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("children"))
    own = own.unionByName(root).join(children, _KEY, "left").withColumn("children", F.coalesce("children", F.lit(0)))
    shares = own.select(F.col("conv").alias("seq"), "depth", F.when(F.col("children") == 0, 1).otherwise(0).cast("bigint").alias("l"), ((F.col("n") - 1) * F.col("words")).alias("s"))
    shares = shares.unionByName(parts.select(F.col("conv").alias("seq"), "depth", F.col("leaves").alias("l"), F.col("saved").alias("s")))
    shares = shares.select(*[F.lit(None).cast("bigint").alias(c) for c in ("k1", "k2")], "seq", "depth", "l", "s")
    paths = above.select("k1", "k2", "seq", "depth", zero.alias("l"), zero.alias("s"))
    plus = lambda a, b: a + b
    rows = shares.unionByName(paths).withColumn("block", F.floor(F.col("depth") / block))
    sums = running(rows, ["seq"], "block", F.col("depth"), back=True, leaves=(F.sum, F.col("l"), plus), saved=(F.sum, F.col("s"), plus))
    sums = sums.filter("k1 is not null").groupBy(_KEY).agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    all_ = shares.agg(F.sum("l").alias("leaves"), F.sum("s").alias("saved")).select(zero.alias("k1"), zero.alias("k2"), zero.alias("depth"), "leaves", "saved")
    out = own.join(sums.unionByName(all_), _KEY)
    return out.select("k1", "k2", "depth", "p1", "p2", "conv", F.lit(None).cast("bigint").alias("above"), "n", "children", "leaves", "saved")


def conversation_trie(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", group: int = 20, limit: int | None = None, block: int = BLOCK) -> DataFrame:
    """prefix_trie() of rebuilt() conversations. Rows are turns; those without a conversation's id belong to none
    and go. A null turn number comes first, a null role or text is empty. Turns of one number come in order of role
    and text; a repeated row is one more turn. Texts count whole, whatever their length. Other columns, of any name,
    are not looked at. A conversation, a first turn, or copies of one conversation may be any share of the rows."""
    scratch = Scratch(conversations.sparkSession, "conversation-trie")
    turns = ordered_turns(conversations, scratch, conv_col, turn_col, role_col, text_col)
    return prefix_trie(rebuilt(turns, scratch, group), scratch, limit, block)
