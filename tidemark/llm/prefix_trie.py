"""Conversation prefix tries: double arrays per shard, and global sums for the nodes that shards share.

A node is a distinct sequence of first turns; who starts with it is a member. A turn is known by a digest of its role and
text. The digest and the place of a turn make a hash of two 64-bit numbers; a prefix's key is the sum of its turns'
hashes and identifies the node everywhere.

1. Conversations are numbered over range partitions with offsets, so one that holds most rows is no single task, and are
   cut into segments of ``BLOCK`` turns. A segment's start key is the sum over the segments before it.
2. Segments are sharded by start key and first turn; groups beyond ``SHARD`` turns are dealt on by conversation.
3. Each shard numbers its turns densely and packs a trie into BASE and CHECK arrays: the child of node ``s`` by turn ``t``
   is ``BASE[s] + t`` if ``CHECK`` there says ``s``. Walking its segments down the arrays gives each node's members.
4. Nodes of several shards merge by key. The merged nodes give each node's own share of leaves and saved tokens; each
   shard that holds a node's owner carries these up its trie, and the sums merge again. What lies below a segment's end in
   further segments comes in as one number per boundary: every conversation brings the shares of the nodes it owns.

Edge cases: a null role or text is empty; a null turn comes first; equal turn numbers go by role, then text; repeated rows
are repeated turns; rows without a conversation id belong to none; an empty table gives no node; further columns are
ignored; very long texts travel once, as digests.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, cut, side, text_of
from .near_dedup import _STEP, mix
from .spelling import crc32_sql

BLOCK, SHARD = 512, 20_000
ROOT = 0
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def placed(conversations: DataFrame) -> DataFrame:
    """``conv_id, pos, turn_key, words``: the turns of each conversation, numbered from 1, as digests."""
    role = F.coalesce("role", F.lit(""))
    key = F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text_of())))
    parts = int(conversations.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["conv_id", F.col("turn").asc_nulls_first(), "role", "text", "tie"]
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), text_of().alias("text"), F.monotonically_increasing_id().alias("tie"))
    ranged = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    in_order = cut(ranged.select(F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at"), "conv_id", key.alias("turn_key"), F.size(F.regexp_extract_all(text_of(), F.lit(WORD), 0)).cast("long").alias("words")))
    per = in_order.groupBy("conv_id", "part").agg(F.count("*").alias("rows"), F.min("at").alias("first"))  # at most one row per conversation and partition
    before = F.sum("rows").over(Window.partitionBy("conv_id").orderBy("part")) - F.col("rows")
    offsets = per.select(F.col("conv_id").alias("of"), F.col("part").alias("in_part"), (before - F.col("first") + 1).alias("offset"))
    met = in_order.join(offsets, (F.col("conv_id") == F.col("of")) & (F.col("part") == F.col("in_part")))
    return met.select("conv_id", (F.col("at") + F.col("offset")).alias("pos"), "turn_key", "words")


def rebuilt(turns: DataFrame, every: int = 20, shared: int = 4) -> tuple[DataFrame, DataFrame]:
    """Turns and ids of conversations that start like others: the first ``h`` turns of ``c - c % every``, then the own ones after ``h``.

    ``h`` is the CRC-32 of the id in decimal digits modulo ``shared``; the remainder of a negative id is negative. ``turns`` is read three times.
    """
    ids = turns.select("conv_id").distinct().withColumn("h", F.crc32(F.col("conv_id").cast("string").cast("binary")) % shared).withColumn("base", F.col("conv_id") - F.col("conv_id") % every)
    heads = turns.where((F.col("pos") < shared) & (F.col("conv_id") % every == 0))
    heads = heads.groupBy(F.col("conv_id").alias("of")).agg(F.sort_array(F.collect_list(F.struct("pos", "turn_key", "words"))).alias("head"))  # fewer than ``shared``
    planned = ids.join(heads, F.col("base") == F.col("of"), "left").select("conv_id", "h", F.slice(F.coalesce("head", F.array().cast("array<struct<pos:bigint,turn_key:binary,words:bigint>>")), F.lit(1), F.col("h").cast("int")).alias("head"))
    planned = cut(planned)
    own = turns.join(planned.select(F.col("conv_id").alias("of"), "h", F.size("head").alias("m")), F.col("conv_id") == F.col("of")).where("pos > h")
    return planned.select("conv_id", F.inline("head")).unionByName(own.select("conv_id", (F.col("pos") - F.col("h") + F.col("m")).alias("pos"), "turn_key", "words")), planned.select("conv_id")


def _hashes(keys: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two numbers for each turn at its place; ``keys`` has two numbers of each digest."""
    with np.errstate(over="ignore"):
        at = pos.astype(np.uint64) * _STEP
        return mix(mix(keys[:, 0] + at) + keys[:, 1]), mix(mix(keys[:, 1] ^ at) + keys[:, 0])


def _digests(turn_keys: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(turn_keys), np.uint64).reshape(-1, 2)


def _summed(block_size: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            sums = np.zeros((len(frame), 2), np.uint64)
            for i, (keys, block) in enumerate(zip(frame["turn_keys"], frame["block"])):
                if len(keys):
                    sums[i] = [h.sum(dtype=np.uint64) for h in _hashes(_digests(keys), block * block_size + 1 + np.arange(len(keys)))]
            yield frame.assign(s1=sums[:, 0].view(np.int64), s2=sums[:, 1].view(np.int64))

    return run


def _whole(low: Column, high: Column) -> Column:
    """A long from sums of its halves, modulo 2^64; sums of longs themselves would overflow."""
    return F.shiftleft((high + F.shiftright(low, 32)).bitwiseAND(0xFFFFFFFF), 32).bitwiseOR(low.bitwiseAND(0xFFFFFFFF))


def _low(c: str) -> Column:
    return F.col(c).bitwiseAND(0xFFFFFFFF)


def _high(c: str) -> Column:
    return F.shiftrightunsigned(c, 32)


def _zero(c: str) -> Column:
    return F.coalesce(c, F.lit(0).cast("long")).alias(c)


def segments(turns: DataFrame, ids: DataFrame, block: int = BLOCK) -> DataFrame:
    """``conv_id, block, k1, k2, turn_keys, words, s1, s2``: conversations in pieces, with the keys where they start and what they add."""
    own = F.sort_array(F.collect_list(F.struct("pos", "turn_key", "words")))  # ``block`` at most
    grouped = turns.groupBy("conv_id", F.floor((F.col("pos") - 1) / block).cast("long").alias("block")).agg(own.alias("turns"))
    grouped = grouped.select("conv_id", "block", F.col("turns.turn_key").alias("turn_keys"), F.col("turns.words").alias("words"))
    turnless = ids.join(turns.select("conv_id").distinct(), "conv_id", "left_anti").select("conv_id", F.lit(0).cast("long").alias("block"), F.array().cast("array<binary>").alias("turn_keys"), F.array().cast("array<bigint>").alias("words"))
    made = cut(grouped.unionByName(turnless).mapInPandas(_summed(block), "conv_id long, block long, turn_keys array<binary>, words array<long>, s1 long, s2 long"))
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    long = made.where("block > 0").select("conv_id").distinct()
    summed = lambda c: _whole(F.sum(_low(c)).over(before), F.sum(_high(c)).over(before))
    starts = made.join(long, "conv_id", "left_semi").select("conv_id", "block", summed("s1").alias("k1"), summed("s2").alias("k2"))  # one row for ``block`` turns
    return made.join(starts, ["conv_id", "block"], "left").select("conv_id", "block", _zero("k1"), _zero("k2"), "turn_keys", "words", "s1", "s2")


class DoubleArray:
    """A trie in two arrays. Node 0 is the root; symbols are dense numbers from 1 on."""

    def __init__(self, size: int):
        self.base, self.check = np.zeros(size, np.int64), np.full(size, -1, np.int64)
        self.check[ROOT] = ROOT
        self.free = np.arange(size + 1)  # the next free slot from each on, by path halving

    def _grow(self, size: int) -> None:
        old = len(self.check)
        if size > old:
            size = max(size, 2 * old)
            self.base = np.concatenate((self.base, np.zeros(size - old, np.int64)))
            self.check = np.concatenate((self.check, np.full(size - old, -1, np.int64)))
            self.free = np.concatenate((self.free, np.arange(old + 1, size + 1)))

    def _next(self, slot: int) -> int:
        free = self.free
        while slot < len(free) and free[slot] != slot:
            free[slot] = free[free[slot]]
            slot = int(free[slot])
        return slot

    def add(self, node: int, symbols: np.ndarray) -> None:
        """Gives ``node`` the children ``symbols``, sorted, at the first base where all their slots are free."""
        slot, away = self._next(int(symbols[0]) + 1), symbols - symbols[0]
        while True:
            self._grow(slot + int(away[-1]) + 2)
            if (self.check[slot + away] < 0).all():
                break
            slot = self._next(slot + 1)
        self.base[node] = slot - symbols[0]
        self.check[slot + away] = node
        for s in (slot + away).tolist():
            self.free[s] = s + 1

    def step(self, nodes: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        """The children of ``nodes`` by ``symbols``, which have to be there."""
        found = self.base[nodes] + symbols
        assert (self.check[found] == nodes).all()
        return found


def build(sequences: list[np.ndarray]) -> tuple[DoubleArray, list[np.ndarray]]:
    """The double-array trie of sequences of symbols from 1 on, and each level's nodes, by sequence."""
    lengths = np.array([len(s) for s in sequences])
    top = int(max((s.max() for s in sequences if len(s)), default=0))
    trie, nodes, levels = DoubleArray(int(lengths.sum()) + top + 2), np.zeros(len(sequences), np.int64), []
    for depth in range(int(lengths.max(initial=0))):
        going = np.nonzero(lengths > depth)[0]
        symbols = np.array([sequences[i][depth] for i in going])
        here = np.unique(nodes[going] * (top + 1) + symbols)
        parents, children = here // (top + 1), here % (top + 1)
        starts = np.nonzero(np.diff(parents, prepend=-1))[0]
        for a, b in zip(starts.tolist(), np.append(starts[1:], len(here)).tolist()):
            trie.add(int(parents[a]), children[a:b])
        nodes = nodes.copy()
        nodes[going] = trie.step(nodes[going], symbols)
        levels.append(nodes)
    return trie, levels


NODES = "shard long, slot long, parent long, depth long, k1 long, k2 long, p1 long, p2 long, conv_id long, n_convs long, words long"


def _shard(frame: pd.DataFrame, block: int) -> pd.DataFrame:
    """The nodes of a shard, with the members it knows. A start key is the first symbol, so all segments hang below node 0."""
    frame = frame.sort_values("conv_id", kind="stable").reset_index(drop=True)
    keys, lengths = _digests([k for own in frame["turn_keys"] for k in own]), np.array([len(x) for x in frame["turn_keys"]])
    begins = np.cumsum(lengths) - lengths
    start = frame["block"].to_numpy() * block
    inside = np.arange(lengths.sum()) - np.repeat(begins, lengths)
    h1, h2 = _hashes(keys, np.repeat(start, lengths) + inside + 1)
    heads = frame[["k1", "k2"]].to_numpy().view(np.uint64)
    # dense numbers in the order of depth, so that siblings lie close to each other
    symbols = pd.factorize(pd.MultiIndex.from_arrays((keys[:, 0], keys[:, 1])))[0] if len(keys) else np.empty(0, np.int64)
    first = np.full(symbols.max(initial=-1) + 1, 1 << 40)
    np.minimum.at(first, symbols, inside)
    dense = np.empty(len(first), np.int64)
    dense[np.argsort(first, kind="stable")] = np.arange(1, len(first) + 1)
    roots = pd.factorize(pd.MultiIndex.from_arrays((heads[:, 0], heads[:, 1])))[0] + len(first) + 1
    trie, levels = build([np.concatenate(([r], dense[symbols[a : a + n]])) for r, a, n in zip(roots, begins, lengths)])
    total = len(trie.check)
    members, least, words, depth = np.zeros(total, np.int64), np.full(total, -1, np.int64), np.zeros(total, np.int64), np.zeros(total, np.int64)
    key, conv, flat_words = np.zeros((total, 2), np.uint64), frame["conv_id"].to_numpy(), np.array([w for own in frame["words"] for w in own], np.int64)
    run = heads.copy()
    for level, nodes in enumerate(levels):
        going = np.nonzero(lengths >= level)[0]
        at = nodes[going]
        if level:
            of = begins[going] + level - 1
            with np.errstate(over="ignore"):
                run[going, 0] += h1[of]
                run[going, 1] += h2[of]
            words[at] = flat_words[of]
        members += np.bincount(at, minlength=total)
        least[at[::-1]] = conv[going[::-1]]  # the first, which is the least, is written last
        key[at], depth[at] = run[going], start[going] + level
    slots = np.nonzero(members)[0]
    parent = trie.check[slots]
    signed = key.view(np.int64)
    out = pd.DataFrame({"shard": frame["shard"].iloc[0], "slot": slots, "parent": parent, "depth": depth[slots], "k1": signed[slots, 0], "k2": signed[slots, 1], "p1": signed[parent, 0], "p2": signed[parent, 1], "conv_id": least[slots], "n_convs": members[slots], "words": words[slots]})
    return out


SHARES = "k1 long, k2 long, leaves long, saved long"


def _carried(frame: pd.DataFrame) -> pd.DataFrame:
    """Sums over the subtree of each node of a shard, deepest first."""
    frame = frame.sort_values("depth", ascending=False, kind="stable")
    slots, parents = frame["slot"].to_numpy(), frame["parent"].to_numpy()
    sums = np.zeros((int(max(slots.max(), parents.max())) + 1, 2), np.int64)
    sums[slots, 0], sums[slots, 1] = frame["leaf"], frame["share"]
    depth = frame["depth"].to_numpy()
    for rows in np.split(np.arange(len(frame)), np.nonzero(np.diff(depth))[0] + 1):
        rows = rows[parents[rows] != ROOT]
        np.add.at(sums, parents[rows], sums[slots[rows]])
    made = pd.DataFrame({"k1": frame["k1"].to_numpy(), "k2": frame["k2"].to_numpy(), "leaves": sums[slots, 0], "saved": sums[slots, 1]})
    return made[(made["leaves"] != 0) | (made["saved"] != 0)]


def _ends(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """SHA-256 of the ids of each key; rows come sorted, and a key's ids pass through one by one."""
    key, state = None, None
    for frame in frames:
        out = []
        for k1, k2, ids in frame.groupby(["k1", "k2"], sort=False)["conv_id"].agg(list).reset_index().itertuples(index=False):
            text = ",".join(map(str, ids)).encode()
            if (k1, k2) == key:
                state.update(b"," + text)
                continue
            if key is not None:
                out.append((*key, state.hexdigest()))
            key, state = (k1, k2), hashlib.sha256(text)
        yield pd.DataFrame(out, columns=["k1", "k2", "ends_sha256"])
    if key is not None:
        yield pd.DataFrame([(*key, state.hexdigest())], columns=["k1", "k2", "ends_sha256"])


def trie_nodes(turns: DataFrame, ids: DataFrame, block: int = BLOCK, shard: int = SHARD) -> DataFrame:
    """One row per node: ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``.

    ``turns`` (conv_id, pos from 1 on, turn_key, words), ``ids`` (conv_id) of all conversations, those without turns included.
    """
    made = cut(segments(turns, ids, block))
    group = F.xxhash64("k1", "k2", "block", F.coalesce(F.try_element_at("turn_keys", F.lit(1)), F.lit(b"")))
    per = cut(made.groupBy(group.alias("group")).agg(F.sum(F.size("turn_keys") + 1).alias("rows")))
    total = per.agg(F.sum("rows")).first()[0] or 0  # one value
    shards = max(int(made.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // shard))
    share = max(1, total // shards)
    salts = side(per.where(F.col("rows") > share).select("group", F.ceil(F.col("rows") / share).alias("salts")))
    dealt = made.withColumn("group", group).join(salts, "group", "left").withColumn("salt", F.pmod(F.xxhash64("conv_id"), F.coalesce("salts", F.lit(1).cast("long"))))
    dealt = dealt.select("conv_id", "block", "k1", "k2", "turn_keys", "words", F.pmod(F.xxhash64("group", "salt"), F.lit(shards)).alias("shard"))
    found = cut(dealt.groupBy("shard").applyInPandas(lambda frame: _shard(frame, block), NODES))
    found = found.where((F.col("parent") != ROOT) | (F.col("depth") == 0))  # where a later segment starts, the one before ends

    merged = found.groupBy("k1", "k2").agg(F.min(F.struct("conv_id", "shard")).alias("owner"), F.sum("n_convs").alias("n_convs"), *[F.first(c).alias(c) for c in ("depth", "p1", "p2", "words")])
    merged = cut(merged.select("k1", "k2", "owner.*", "n_convs", "depth", "p1", "p2", "words"))
    children = merged.where("depth > 0").groupBy(F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count("*").alias("n_children"))
    nodes = merged.join(children, ["k1", "k2"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long")))
    nodes = cut(nodes.withColumns({"leaf": (F.col("n_children") == 0).cast("long"), "share": (F.col("n_convs") - 1) * F.col("words")}))

    # what the nodes of later segments add, at the boundary where each conversation's next segment starts
    later = made.where("block > 0").select("conv_id", "block", "k1", "k2")
    owned = nodes.where(F.col("depth") > block).groupBy("conv_id", F.floor((F.col("depth") - 1) / block).alias("block")).agg(F.sum("leaf").alias("leaf"), F.sum("share").alias("share"))
    onward = Window.partitionBy("conv_id").orderBy(F.desc("block"))
    below = later.join(owned, ["conv_id", "block"], "left").select("k1", "k2", *[F.sum(_zero(c)).over(onward).alias(c) for c in ("leaf", "share")])
    below = below.groupBy("k1", "k2").agg(*[F.sum(c).alias(f"{c}_below") for c in ("leaf", "share")])
    shares = nodes.join(below, ["k1", "k2"], "left").select("k1", "k2", "shard", *[(F.col(c) + _zero(f"{c}_below")).alias(c) for c in ("leaf", "share")])
    own = found.select("shard", "slot", "parent", "depth", "k1", "k2").join(shares, ["k1", "k2", "shard"], "left").select("shard", "slot", "parent", "depth", "k1", "k2", _zero("leaf"), _zero("share"))
    sums = own.groupBy("shard").applyInPandas(_carried, SHARES).groupBy("k1", "k2").agg(F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))

    last = made.groupBy("conv_id").agg(F.max_by(F.struct("k1", "k2", "s1", "s2"), "block").alias("last")).select("conv_id", "last.*")
    plus = lambda a, b: _whole(_low(a) + _low(b), _high(a) + _high(b))
    ended = last.select("conv_id", plus("k1", "s1").alias("k1"), plus("k2", "s2").alias("k2"))
    ends = ended.repartition("k1", "k2").sortWithinPartitions("k1", "k2", "conv_id").mapInPandas(_ends, "k1 long, k2 long, ends_sha256 string")
    up = nodes.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    full = nodes.join(sums, ["k1", "k2"], "left").join(ends, ["k1", "k2"], "left").join(up, ["p1", "p2"], "left")
    return full.select(
        "conv_id", "depth", F.when(F.col("depth") > 0, F.col("parent_conv_id")).alias("parent_conv_id"), "n_convs", "n_children", _zero("n_leaves"), _zero("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(EMPTY_SHA)).alias("ends_sha256"),
    )


def digest(conversations: DataFrame) -> DataFrame:
    """:func:`trie_nodes` of the conversations, rebuilt so that they share first turns."""
    return trie_nodes(*rebuilt(cut(placed(conversations))))


def brute_force(rows: list[tuple], every: int = 20, shared: int = 4) -> list[tuple]:
    """The result of :func:`digest` for a few rows (conv_id, turn, role, text)."""
    own: dict[int, list] = {}
    for c, _, role, text in sorted(((c, t if t is not None else float("-inf"), r or "", x or "") for c, t, r, x in rows if c is not None)):
        own.setdefault(c, []).append((role, text))
    built = {c: own.get(c - int(math.fmod(c, every)), [])[: (h := zlib.crc32(str(c).encode()) % shared)] + turns[h:] for c, turns in own.items()}
    members: dict[tuple, list] = {}
    for c in sorted(built):
        for d in range(len(built[c]) + 1):
            members.setdefault(tuple(built[c][:d]), []).append(c)
    words = lambda node: len((node[-1][1] if node else "").encode().split())
    out = []
    for node, of in members.items():
        below = [n for n in members if n[: len(node)] == node]
        leaves = [n for n in below if not any(m[:-1] == n for m in members if m)]
        ends = ",".join(str(c) for c in of if len(built[c]) == len(node))
        children = sum(1 for m in members if m and m[:-1] == node)
        out.append((of[0], len(node), members[node[:-1]][0] if node else None, len(of), children, len(leaves), sum((len(members[n]) - 1) * words(n) for n in below), hashlib.sha256(ends.encode()).hexdigest()))
    return out


ORACLE_SQL = rf"""
WITH placed AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos FROM conversations WHERE conv_id IS NOT NULL
), ids AS (
  SELECT conv_id, {crc32_sql("conv_id::VARCHAR")} % 4 AS h FROM (SELECT DISTINCT conv_id FROM placed)
), heads AS (
  SELECT i.conv_id, p.pos, p.role, p.text FROM ids i JOIN placed p ON p.conv_id = i.conv_id - i.conv_id % 20 AND p.pos <= i.h
), rebuilt AS (
  FROM heads UNION ALL
  SELECT p.conv_id, p.pos - h + coalesce(m, 0), p.role, p.text FROM placed p JOIN ids USING (conv_id) LEFT JOIN (SELECT conv_id, count(*) AS m FROM heads GROUP BY ALL) USING (conv_id) WHERE p.pos > h
), paths AS (
  SELECT conv_id, pos AS depth, len(regexp_extract_all(text, '[^ 	-
]+')) AS words, string_agg(length(role) || ':' || role || length(text) || ':' || text, '') OVER (PARTITION BY conv_id ORDER BY pos) AS path FROM rebuilt
  UNION ALL SELECT conv_id, 0, 0, '' FROM ids
), nodes AS (
  SELECT path, any_value(depth) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(words) AS words FROM paths GROUP BY path
), up AS (
  SELECT DISTINCT a.path, b.path AS parent FROM paths a JOIN paths b ON a.conv_id = b.conv_id AND a.depth = b.depth + 1
), linked AS (
  SELECT n.*, p.conv_id AS parent_conv_id, (SELECT count(*) FROM up u WHERE u.parent = n.path) AS n_children FROM nodes n LEFT JOIN up USING (path) LEFT JOIN nodes p ON p.path = up.parent
), below AS (
  SELECT DISTINCT a.path, b.path AS under FROM paths a JOIN paths b ON a.conv_id = b.conv_id AND b.depth >= a.depth
), sums AS (
  SELECT b.path, count(*) FILTER (u.n_children = 0) AS n_leaves, sum((u.n_convs - 1) * u.words)::BIGINT AS saved_tokens FROM below b JOIN linked u ON u.path = b.under GROUP BY b.path
), ends AS (
  SELECT path, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) AS ids FROM paths JOIN (SELECT conv_id, max(depth) AS depth FROM paths GROUP BY ALL) USING (conv_id, depth) GROUP BY path
)
SELECT conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256 FROM linked JOIN sums USING (path) LEFT JOIN ends USING (path)
"""
