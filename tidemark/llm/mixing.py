"""Mixing sources to target weights: packed blocks, drawn shard counts, permuted indices, joins by index.

Each source's words form one stream, cut into blocks of ``BLOCK`` words. A source's target in words becomes slots: whole
epochs over its blocks and a part of one more. :func:`draw` deals all slots to output shards by one pseudorandom
permutation, which gives each shard its counts by source: multinomial draws conditioned on the sources' totals, as
free draws would miss the targets by several percent on small corpora. The drawn counts then make the mix: in the order
of the shards, each takes its count of the source's next slots, a permutation of the source's block indices, another
for each epoch, says which block a slot takes, and another of the shard's places where it goes. The last slot of a source
is cut where the target is met. Blocks are joined with the documents by their index.

The permutations are swap-or-not shuffles: each round maps ``x`` to ``key - x`` or leaves it, by a hash of the larger
of the two. They are bijections on any range, need no state, and are computed row by row.

Everything is a DataFrame expression. A source's offsets are sums over hashed parts of about ``PART`` documents (many equal
rows go round the parts), and sums over parts and shards go in strides of ``STRIDE``, so a source that holds most rows is
no single task; slots are generated in two steps for the same reason. Sources beyond ``FEW_SOURCES`` are summed likewise.

Edge cases: a null or blank text has size 0 and is never taken; a null source is a source of its own, last in order;
a source without words has target 0; an empty table gives an empty result; repeated rows are mixed as rows of their
own; a null ``doc_id`` is passed on; further columns are ignored; very long texts are taken whole; reruns agree, also
over other partitions of the same rows, but for which of several equal rows takes what.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.chunks import ROW, numbered
from .common import WORD, cut, text_of

BLOCK = 512
#: Slots of one output shard.
SHARD = 1024
PART = 1_000
#: Parts or shards that one task sums up.
STRIDE = 4_096
#: Slots generated from one row.
RUN = 16_384
ROUNDS = 24
WEIGHTS = (3, 1, 2)
#: The mix as a share of all words, and how often a word may be taken.
SHARE, REPEAT = 1.5, 2
#: Sources are joined by broadcast up to this many.
FEW_SOURCES = 50_000


def swap_or_not(x: Column, n: Column, key: Column, inverse: bool = False) -> Column:
    """A pseudorandom bijection on 0 .. n - 1, fixed by ``key``."""

    def step(at: Column, r: Column) -> Column:
        other = F.pmod(F.pmod(F.xxhash64(key, r, F.lit("key")), n) - at, n)
        return F.when(F.xxhash64(key, r, F.greatest(at, other)).bitwiseAND(F.lit(1)) == 1, other).otherwise(at)

    order = F.sequence(F.lit(ROUNDS - 1), F.lit(0)) if inverse else F.sequence(F.lit(0), F.lit(ROUNDS - 1))
    return F.aggregate(order, x.cast("long"), step)


def _sum_before(rows: DataFrame, order: list[str], value: str, name: str, many: bool) -> DataFrame:
    """``rows`` with the sum of ``value`` over the rows before, in a total order: by one window, or, of many rows, in strides."""
    if not many:
        return rows.withColumn(name, F.coalesce(F.sum(value).over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    at = numbered(rows.withColumn("every", F.lit(0)), ["every"], order).withColumn(ROW, F.col(ROW) - 1)
    return _before(at, "every", ROW, value, name).drop("every", ROW)


def targets(sizes: DataFrame, few: int = FEW_SOURCES) -> DataFrame:
    """(source, source_size) with ``rank`` and ``target``: weights with caps, the excess reshared by weight.

    All that is below its cap lies at one level per weight. Sources in order of cap by weight give, for each, the
    level if all before it were at their caps; the first level that its own cap holds is the level of all. More than
    ``few`` sources are numbered and summed over ranges, not in one task.
    """
    many = sizes.count() > few
    if many:
        ranked = numbered(sizes.select("source", "source_size", F.col("source").isNull().cast("int").alias("last"), F.lit(0).alias("every")), ["every"], ["last", "source"])
        ranked = ranked.select("source", "source_size", (F.col(ROW) - 1).alias("rank"))
    else:
        ranked = sizes.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("rank") % len(WEIGHTS) + 1).cast("int"))
    rows = ranked.withColumn("weight", weight).withColumn("cap", F.col("source_size") * REPEAT).withColumn("full", F.col("cap") / F.col("weight"))
    whole = rows.agg((F.sum("source_size") * SHARE).alias("total"), F.sum("weight").alias("weights"))
    order = ["full", "rank"]
    summed = _sum_before(_sum_before(rows, order, "cap", "caps_before", many), order, "weight", "weights_before", many)
    levels = summed.join(F.broadcast(whole)).withColumn("own", (F.col("total") - F.col("caps_before")) / (F.col("weights") - F.col("weights_before")))  # one row
    level = levels.where("own <= full").agg(F.min_by("own", F.struct("full", "rank")).alias("level"))
    return rows.join(F.broadcast(level)).select(
        "source", "source_size", "rank", F.coalesce(F.least(F.col("cap").cast("double"), F.col("level") * F.col("weight")), F.col("cap").cast("double")).alias("target")
    )


def planned(sources: DataFrame, block: int = BLOCK, few: int = FEW_SOURCES) -> DataFrame:
    """Per source: words wanted, blocks, whole epochs, where the short last block comes, slots, first slot."""
    want = F.least(F.round("target").cast("long"), F.col("source_size") * REPEAT)
    size, rest, tail = F.col("source_size"), F.col("rest"), F.col("tail")
    rows = sources.withColumn("want", want).withColumn("blocks", F.ceil(size / block).cast("long")).where("blocks > 0")
    rows = rows.withColumn("epochs", F.floor(F.try_divide(F.col("want"), size)).cast("long")).withColumn("rest", F.col("want") - F.col("epochs") * size).withColumn("tail", size - (F.col("blocks") - 1) * block)
    rows = rows.withColumn("tail_at", swap_or_not(F.col("blocks") - 1, F.col("blocks"), F.xxhash64("rank", "epochs"), inverse=True))
    more = F.when(rest <= F.col("tail_at") * block, F.ceil(rest / block)).otherwise(F.ceil((rest + block - tail) / block)).cast("long")
    rows = rows.withColumn("slots", F.col("epochs") * F.col("blocks") + more)
    return _sum_before(rows, ["rank"], "slots", "first_slot", sources.count() > few)


def _before(df: DataFrame, by: str, order: str, value: str, name: str) -> DataFrame:
    """With the sum of ``value`` over the rows of a smaller ``order`` (0, 1, ...) of the same ``by``."""
    rows = df.withColumn("stride", F.floor(F.col(order) / STRIDE))
    upto = F.sum(value).over(Window.partitionBy(by, "stride").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    strides = rows.groupBy(by, "stride").agg(F.sum(value).alias("words"))
    told = F.sum("words").over(Window.partitionBy(by).orderBy("stride").rowsBetween(Window.unboundedPreceding, 0)) - F.col("words")
    return rows.withColumn("upto", upto).join(strides.select(by, "stride", told.alias("earlier")), [by, "stride"]).withColumn(name, F.col("earlier") + F.col("upto") - F.col(value)).drop("stride", "upto", "earlier")


def draw(plan: DataFrame) -> DataFrame:
    """(shard, rank, n): how many slots of each source an output shard takes."""
    total = plan.agg(F.sum("slots").alias("all_slots"))
    wide = plan.where("slots > 0").join(F.broadcast(total)).select("rank", "slots", "first_slot", "all_slots")
    runs = wide.withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("slots") - 1) / RUN).cast("long"))))
    runs = runs.repartition(int(plan.sparkSession.conf.get("spark.sql.shuffle.partitions")), "rank", "run")
    each = runs.withColumn("slot", F.explode(F.sequence(F.col("run") * RUN, F.least((F.col("run") + 1) * RUN, F.col("slots")) - 1)))
    place = swap_or_not(F.col("first_slot") + F.col("slot"), F.col("all_slots"), F.lit(7))
    return each.select(F.floor(place / SHARD).cast("long").alias("shard"), "rank").groupBy("shard", "rank").agg(F.count("*").alias("n"))


def slots(plan: DataFrame, drawn: DataFrame, block: int = BLOCK) -> DataFrame:
    """(shard, place, rank, block, take, whole): what each drawn slot of the output takes, from the start of its block."""
    counts = _before(drawn, "rank", "shard", "n", "first")
    held = Window.partitionBy("shard").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    counts = counts.withColumn("low", F.sum("n").over(held) - F.col("n")).withColumn("held", F.sum("n").over(Window.partitionBy("shard")))
    told = plan.select("rank", "blocks", "epochs", "rest", "tail", "tail_at")
    # A drawn row grows by as many slots, so rows are dealt to all tasks, however few bytes they are.
    counts = counts.repartition(int(plan.sparkSession.conf.get("spark.sql.shuffle.partitions")), "shard", "rank")
    each = counts.join(F.broadcast(told) if plan.count() <= FEW_SOURCES else told, "rank").withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    each = each.withColumn("slot", F.col("first") + F.col("i")).withColumn("epoch", F.floor(F.try_divide(F.col("slot"), F.col("blocks"))).cast("long")).withColumn("k", F.pmod("slot", "blocks"))
    each = each.withColumn("block", swap_or_not(F.col("k"), F.col("blocks"), F.xxhash64("rank", "epoch")))
    each = each.withColumn("place", swap_or_not(F.col("low") + F.col("i"), F.col("held"), F.xxhash64("shard")))
    long = F.when(F.col("block") == F.col("blocks") - 1, F.col("tail")).otherwise(F.lit(block))
    start = F.col("k") * block - F.when(F.col("k") > F.col("tail_at"), block - F.col("tail")).otherwise(0)
    take = F.when(F.col("epoch") < F.col("epochs"), long).otherwise(F.least(long, F.col("rest") - start))
    return each.withColumn("take", take.cast("long")).select("shard", "place", "rank", "block", "take", (take == long).alias("whole"))


def _measured(docs: DataFrame, id_col: str) -> DataFrame:
    return cut(
        docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.regexp_count(text_of(), F.lit(WORD)).cast("long").alias("size"), F.xxhash64(id_col, "text").alias("mark"))
    )


def _dealt(rows: DataFrame, part: int) -> DataFrame:
    """``rows`` with their part: by their mark, but rows of one mark beyond ``part`` go round all parts.

    Such rows are numbered within the partition that they come in, after those of their mark in partitions before.
    """
    parts = max(1, rows.count() // part)
    at = lambda c: F.pmod(c, F.lit(parts))
    common = rows.groupBy("mark").agg(F.count("*").alias("c")).where(F.col("c") > part).select("mark")
    if parts == 1 or common.isEmpty():
        return rows.withColumn("part", at(F.col("mark")))
    many = rows.join(common, "mark", "left_semi").withColumn("source_part", F.shiftright("row", 33))
    per = many.groupBy("mark", "source_part").agg(F.count("*").alias("c"))
    offset = per.select("mark", "source_part", (F.sum("c").over(Window.partitionBy("mark").orderBy("source_part")) - F.col("c")).alias("offset"))
    number = F.row_number().over(Window.partitionBy("mark", "source_part").orderBy("row")) + F.col("offset")
    round_robin = many.join(offset, ["mark", "source_part"]).withColumn("part", at(at(F.col("mark")) + number)).drop("source_part", "offset")
    return rows.join(common, "mark", "left_anti").withColumn("part", at(F.col("mark"))).unionByName(round_robin)


def _starts(rows: DataFrame, part: int) -> DataFrame:
    """(row, rank, size, start): where each document starts in the stream of its source."""
    placed = _dealt(rows.where("size > 0"), part)
    within = Window.partitionBy("rank", "part").orderBy("mark", "doc_id", "size", "row").rowsBetween(Window.unboundedPreceding, 0)
    before = _before(placed.groupBy("rank", "part").agg(F.sum("size").alias("of_part")), "rank", "part", "of_part", "before").select("rank", "part", "before")
    return placed.withColumn("upto", F.sum("size").over(within)).join(before, ["rank", "part"]).select("row", "rank", "size", (F.col("before") + F.col("upto") - F.col("size")).alias("start"))


def _pieces(starts: DataFrame, block: int) -> DataFrame:
    """(row, rank, block, low, words, skip): where each document lies in the blocks of its source."""
    spread = starts.withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / block).cast("long"), F.floor((F.col("start") + F.col("size") - 1) / block).cast("long"))))
    low = F.greatest(F.col("start") - F.col("block") * block, F.lit(0))
    high = F.least(F.col("start") + F.col("size") - F.col("block") * block, F.lit(block))
    skip = F.greatest(F.col("block") * block - F.col("start"), F.lit(0))
    return spread.select("row", "rank", "block", low.alias("low"), (high - low).alias("words"), skip.alias("skip"))


def _mixture(docs: DataFrame, block: int, part: int, id_col: str) -> tuple[DataFrame, DataFrame]:
    """The documents with size and source, and :func:`mixed`'s rows with ``row`` in place of the document's id."""
    measured = _measured(docs, id_col)
    sources = cut(targets(measured.groupBy("source").agg(F.sum("size").alias("source_size"))))
    told = sources.select(F.col("source").alias("of_source"), "rank", "source_size", "target")
    if sources.count() <= FEW_SOURCES:
        told = F.broadcast(told)
    rows = measured.join(told, F.col("source").eqNullSafe(F.col("of_source"))).drop("of_source")
    plan = planned(sources, block)
    dealt = slots(plan, cut(draw(plan)), block)
    words = F.least(F.col("words"), F.col("take") - F.col("low"))
    met = _pieces(_starts(rows, part), block).join(dealt.hint("merge"), ["rank", "block"]).withColumn("words", words).where("words > 0")
    return rows, met.select("shard", "place", "rank", "block", "low", "row", "skip", "words")


def mixed(docs: DataFrame, block: int = BLOCK, part: int = PART, id_col: str = "doc_id") -> DataFrame:
    """The mix: (shard, place, source, block, low, doc_id, skip, words), by place in each output shard.

    Each slot of a shard, told by ``place``, holds a block of ``source``; the block is made of pieces in the order of
    ``low``, each of ``words`` words of a document after its first ``skip``.
    """
    rows, pieces = _mixture(docs, block, part, id_col)
    return pieces.join(rows.select("row", "doc_id", "source"), "row").select("shard", "place", "source", "block", "low", "doc_id", "skip", "words")


def _texts(docs: DataFrame, id_col: str) -> DataFrame:
    """The documents, written: rows are numbered alike wherever these same files are read."""
    return cut(docs.select(F.col(id_col).alias("doc_id"), "source", F.col("text")))


def _blocks(kept: DataFrame, rows: DataFrame, pieces: DataFrame) -> DataFrame:
    """The blocks of :func:`mixed_blocks`; a shard is whole in a partition, in the order of its places.

    Each text meets the list of its own pieces, which grows with the text alone, and is cut there, so whole texts are
    shuffled once and what is taken of them once more, to the shards.
    """
    taken = pieces.join(rows.select("row", "source"), "row").groupBy("row").agg(F.collect_list(F.struct("shard", "place", "source", "block", "low", "skip", "words")).alias("taken"))
    met = kept.select(F.monotonically_increasing_id().alias("row"), text_of().alias("said")).join(taken, "row").withColumn("all", F.regexp_extract_all("said", F.lit(WORD), F.lit(0)))
    said = lambda x: F.array_join(F.slice("all", (x.skip + 1).cast("int"), x.words.cast("int")), " ")
    cuts = met.select(F.inline(F.transform("taken", lambda x: F.struct(x.shard.alias("shard"), x.place.alias("place"), x.source.alias("source"), x.block.alias("block"), x.words.alias("words"), F.struct(x.low.alias("low"), said(x).alias("said")).alias("piece")))))
    each = cuts.repartition("shard").groupBy("shard", "place", "source", "block").agg(F.sum("words").alias("words"), F.array_sort(F.collect_list("piece")).alias("pieces"))
    return each.select("shard", "place", "source", "block", "words", F.array_join("pieces.said", " ").alias("text")).sortWithinPartitions("shard", "place")


def mixed_blocks(docs: DataFrame, block: int = BLOCK, part: int = PART, id_col: str = "doc_id") -> DataFrame:
    """The token blocks themselves: (shard, place, source, block, words, text), the words joined by single spaces."""
    kept = _texts(docs, id_col)
    return _blocks(kept, *_mixture(kept, block, part, "doc_id"))


def _totals(rows: DataFrame, pieces: DataFrame) -> DataFrame:
    taken = pieces.groupBy("row").agg(F.sum("words").alias("taken"), F.count("*").alias("pieces"), F.min("shard").alias("first_shard"))
    count = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return rows.join(taken, "row", "left").select("doc_id", "size", "source_size", "target", count("taken"), count("pieces"), "first_shard")


def mix(docs: DataFrame, block: int = BLOCK, part: int = PART, id_col: str = "doc_id") -> DataFrame:
    """One row per document: ``doc_id, size, source_size, target, taken, pieces, first_shard``, from the rows of :func:`mixed`.

    ``pieces`` counts the slots that hold words of the document, ``first_shard`` is the first output shard with one.
    """
    rows, pieces = _mixture(docs, block, part, id_col)
    return _totals(rows, pieces)


def written_mix(docs: DataFrame, folder: str, block: int = BLOCK, part: int = PART, id_col: str = "doc_id") -> DataFrame:
    """Writes the blocks of :func:`mixed_blocks` to a new folder, and returns the rows of :func:`mix` for the same pieces."""
    kept = _texts(docs, id_col)
    rows, pieces = _mixture(kept, block, part, "doc_id")
    pieces = cut(pieces)
    _blocks(kept, rows, pieces).write.option("compression", "zstd").parquet(folder)
    return _totals(rows, pieces)


def brute_targets(sizes: list[tuple[str | None, int]]) -> dict:
    """The targets for a small fixture, by resharing the excess until none is left."""
    order = sorted(sizes, key=lambda x: (x[0] is None, x[0] or ""))
    weight = {s: WEIGHTS[i % len(WEIGHTS)] for i, (s, _) in enumerate(order)}
    size, at_cap, target = dict(order), set(), {s: 0.0 for s, _ in order}
    budget = SHARE * sum(size.values())
    while free := [s for s in size if s not in at_cap]:
        left = budget - sum(REPEAT * size[s] for s in at_cap)
        target = {s: float(REPEAT * size[s]) if s in at_cap else left * weight[s] / sum(weight[x] for x in free) for s in size}
        over = {s for s in free if target[s] > REPEAT * size[s]}
        if not over:
            break
        at_cap |= over
        target |= {s: float(REPEAT * size[s]) for s in at_cap}
    return target
