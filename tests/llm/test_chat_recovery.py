"""How many turns come back when markers are lost, and chunks of one long turn or of rows without a turn."""

import random

import numpy as np
from pyspark.sql import functions as F

from tidemark.llm import chat


def recovered(spark, sf_dir, kept):
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    model = chat.train(rows)
    lost = chat.transcript(rows).withColumn("keep", F.pmod(F.xxhash64("conv_id", "turn", "line"), F.lit(100)) < kept)
    bare = F.when((F.col("line") == 0) & ~F.col("keep"), F.regexp_replace("text", "^[a-z]+: ", "")).otherwise(F.col("text"))
    lines = chat.cut(chat.observe(lost.withColumn("text", bare).drop("keep")))
    share = chat.unmarked_share(model, lines)
    found = chat.decode(lines, model.with_unmarked(share)).where("line = 0 and not continued").select("conv_id", "turn", F.col("role").alias("said"))
    right = rows.join(found, ["conv_id", "turn"]).where("role = said").count()
    return right / rows.count(), share


def test_recovery_without_markers(spark, sf_dir):
    got = {kept: recovered(spark, sf_dir, kept) for kept in (100, 50, 10, 0)}
    print(got)
    assert got[100][0] == 1.0 and got[100][1] == chat.UNMARKED
    assert got[50][0] > 0.6 and 0.3 < got[50][1] < 0.7
    assert got[10][0] > 0.3 and got[0][0] > 0.2


def test_a_long_turn_and_rows_without_a_turn_are_cut(spark):
    rng = random.Random(4)
    say = lambda n: "\n".join(" ".join(rng.choice(("so", "it", "is", "here.")) for _ in range(5)) for _ in range(n))
    rows = [(1, 0, "user", say(3)), (1, 1, "assistant", say(700)), (1, 2, "user", say(2))] + [(2, None, "user", f"{i} " + say(1)) for i in range(300)] + [(3, 5, "user", "same\nwords")] * 200 + [(None, 0, "user", say(90))]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    lines = chat.observe(chat.transcript(df))
    known = [(c, t, ("user", "assistant")[t % 2], say(rng.randrange(1, 5))) for c in range(60) for t in range(6)]
    model = chat.train(spark.createDataFrame(known, df.schema))
    pieces = chat._pieces(lines.withColumn("chunk", F.floor(F.coalesce("turn", F.lit(-1)) / 32).cast("long")), 64)
    assert pieces.groupBy("conv_id", "chunk", "piece").count().agg(F.max("count")).first()[0] == 64
    whole, parts = (chat.decode(lines, model, most=m).collect() for m in (10**6, 64))
    assert sum(r.n_lines for r in parts) == sum(r.n_lines for r in whole) == 705 + 300 + 400 + 90
    joined = lambda rows: "".join(r.rendered for r in sorted((r for r in rows if r.conv_id == 1), key=lambda r: (r.turn, r.line)))
    both = [joined(chat.rendered(chat.decode(lines, model, most=m)).collect()) for m in (10**6, 64)]
    assert both[0] == both[1] == "".join(f"<|{r[2]}|>\n{r[3]}\n" for r in rows[:3])
    states = lambda rows: sorted((r.conv_id or 0, r.role) for r in rows if not r.continued)
    assert states(whole) == states(parts)


def test_share_of_the_model():
    counts = {("mark", s, s % 3 + 1 if s < 3 else 0): 50.0 for s in range(6)} | {("step", 1, 4): 10.0, ("step", 4, 4): 20.0, ("step", 4, 2): 10.0, ("step", 2, 1): 10.0, ("start", 0, 1): 5.0}
    model = chat.Model.of(counts)
    half = model.with_unmarked(0.5)
    assert np.allclose(np.exp(half.emit[0]).sum(axis=1), 1) and np.allclose(np.exp(half.emit[0][:3, 0]), 0.5) and 0 < model.turns_per_line() < 1
