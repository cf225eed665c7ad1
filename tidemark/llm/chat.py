"""Chat formatting: a hidden Markov model recovers the roles in raw transcripts, and turns are rendered canonically.

A transcript is a sequence of lines. A state says whose turn a line belongs to and whether it opens the turn or goes
on with it. A line is seen through three features: the speaker marker it starts with, its length, and how it ends.
Starts, transitions and emissions are counted on all conversations with known roles and smoothed; a share of mass is
kept for openings without a marker, so missing or unknown markers are recovered from the rest. That share is learned from
the transcripts themselves: the model says how many turns so many lines have, and the others have lost their markers.

Viterbi decoding is split: a transcript is cut into chunks of ``CHUNK`` turns, and these, where they are long, into pieces of
``LINES`` lines, whatever the turns say; each chunk yields the best scores from
every state before it to every state at its end, a small matrix; the matrices of a transcript are chained; then each
chunk is decoded between its two known borders. The result is that of one pass over the whole transcript, and no
task holds more than a chunk of text.

Rendering has a header per turn, ``<|role|>``, a newline, the text and a newline. A turn that goes on in the next chunk
is given there as a row of its own, without a header; rows of a conversation in order are its transcript.

Edge cases: a null text is one empty line; an unknown or null role is no marker; a null turn is one before all others;
repeated rows are lines of their own, in a fixed order; a null conversation id is a conversation; an empty table gives
an empty result; long lines and long conversations are taken whole.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.chunks import ROW, numbered
from .common import cut, shards_for, text_of

ROLES = ("system", "user", "assistant")
STATES = [(r, opens) for opens in (True, False) for r in ROLES]
CHUNK, LINES = 32, 512
#: The least mass of openings without a marker, the most, and what each count starts from.
UNMARKED, MOST_UNMARKED, PRIOR = 0.03, 0.97, 0.5

#: How speakers are named.
NAMES = {
    "system": ("system", "instruction", "instructions"),
    "user": ("user", "human", "q", "question", "customer", "prompter", "me"),
    "assistant": ("assistant", "ai", "bot", "gpt", "chatgpt", "a", "answer", "model", "agent"),
}
_ROLE_OF = {name: role for role, names in NAMES.items() for name in names}
#: A name after opening signs, and a colon, a closing sign or the end of the line after it; linear in the line's length.
_MARKER = re.compile(rf"[\[<|#*]*+\s*+({'|'.join(sorted(_ROLE_OF, key=len, reverse=True))})\s*+(?:[\]>|*]*+\s*+[:>]|[\]>|*]*[\]>|]|[\]>|*]*+\s*+$)\s*+", re.I)
MARKERS = ("none", *ROLES)
LENGTHS = (0, 20, 60, 120, 250, 500, 1000)
ENDS = ("", ".", "?", "!", ":")
_END_OF = {e: i for i, e in enumerate(ENDS)}


def marker(line: str) -> tuple[int, int]:
    """Which marker a line starts with, and where the text after it begins."""
    m = _MARKER.match(line, len(line) - len(line.lstrip()))
    if m is None or (m.end() == len(line) and not re.search(r"[:\]>|]", m.group())):
        return 0, 0
    return MARKERS.index(_ROLE_OF[m.group(1).lower()]), m.end()


def observed(line: str) -> tuple[int, int, int, int]:
    """The marker, where the text after it begins, the class of its length, and how it ends."""
    mark, at = marker(line)
    body = line[at:].rstrip()
    return mark, at, bisect_left(LENGTHS, len(body)), _END_OF.get(body[-1:], 0)


@dataclass(frozen=True)
class Model:
    start: np.ndarray
    step: np.ndarray
    emit: tuple[np.ndarray, np.ndarray, np.ndarray]

    @classmethod
    def of(cls, counts: dict[tuple[str, int, int], float]) -> Model:
        """Log-probabilities from counts keyed (kind, state, value)."""
        n = len(STATES)

        def table(kind: str, width: int) -> np.ndarray:
            t = np.full((n, width), PRIOR)
            for (k, s, v), c in counts.items():
                if k == kind:
                    t[s, v] += c
            return t / t.sum(axis=1, keepdims=True)

        marks = table("mark", len(MARKERS))
        marks = (1 - UNMARKED) * marks
        marks[:, 0] += UNMARKED
        start = table("start", n)[0]
        start = np.where([opens for _, opens in STATES], start, 1e-9)
        step = table("step", n)
        for i, (role, _) in enumerate(STATES):
            for j, (other, opens) in enumerate(STATES):
                if not opens and role != other:
                    step[i, j] = 1e-12
        step /= step.sum(axis=1, keepdims=True)
        return cls(np.log(start / start.sum()), np.log(step), (np.log(marks), np.log(table("length", len(LENGTHS) + 1)), np.log(table("end", len(ENDS)))))

    def with_unmarked(self, share: float) -> Model:
        """The model for transcripts in which a ``share`` of the openings has no marker."""
        opens = np.array([o for _, o in STATES])
        marked = np.exp(self.emit[0][opens])
        marked[:, 0] = 0.0
        marks = np.exp(self.emit[0])
        marks[opens] = marked / marked.sum(axis=1, keepdims=True) * (1 - share)
        marks[opens, 0] = share
        return Model(self.start, self.step, (np.log(marks), *self.emit[1:]))

    def turns_per_line(self) -> float:
        """How many turns a line opens, in the long run."""
        moves = np.exp(self.step)
        at = np.full(len(STATES), 1 / len(STATES))
        for _ in range(2_000):
            at = at @ moves
        return float(at[[o for _, o in STATES]].sum())

    def scores(self, seen: np.ndarray) -> np.ndarray:
        """Emission scores of lines (mark, length, end)."""
        return sum(e.T[seen[:, k]] for k, e in enumerate(self.emit))

    def into(self, first: np.ndarray) -> np.ndarray:
        """Scores of the step before each segment's first line: from the states before it, or from the start alone."""
        start = np.vstack((self.start, np.full((len(STATES) - 1, len(STATES)), -np.inf)))
        return np.where(first[:, None, None], start, self.step)

    def matrices(self, scores: np.ndarray, starts: np.ndarray, lengths: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Per segment the best score from each state before it to each state of its last line; all segments at once."""
        best = self.into(first) + scores[starts][:, None, :]
        for t in range(1, int(lengths.max(initial=0))):
            on = np.nonzero(lengths > t)[0]
            best[on] = (best[on][:, :, :, None] + self.step).max(axis=2) + scores[starts[on] + t][:, None, :]
        return best

    def paths(self, scores: np.ndarray, starts: np.ndarray, lengths: np.ndarray, first: np.ndarray, enter: np.ndarray, leave: np.ndarray | None = None) -> np.ndarray:
        """The best states of all lines, given the state before each segment and, if known, its last one."""
        best = self.into(first)[np.arange(len(starts)), enter] + scores[starts]
        back, out = np.zeros(scores.shape, np.int8), np.zeros(len(scores), np.int8)
        longest = int(lengths.max(initial=0))
        for t in range(1, longest):
            on = np.nonzero(lengths > t)[0]
            ways = best[on][:, :, None] + self.step
            back[starts[on] + t] = ways.argmax(axis=1)
            best[on] = ways.max(axis=1) + scores[starts[on] + t]
        at = best.argmax(axis=1) if leave is None else leave.copy()
        out[starts + lengths - 1] = at
        for t in range(longest - 1, 0, -1):
            on = np.nonzero(lengths > t)[0]
            at[on] = back[starts[on] + t, at[on]]
            out[starts[on] + t - 1] = at[on]
        return out


def transcript(conversations: DataFrame) -> DataFrame:
    """Raw lines (conv_id, turn, part, line, text) of a table of turns: the role is but a marker on a turn's first line."""
    role = F.trim(F.coalesce("role", F.lit("")))
    raw = F.concat(F.when(role != "", F.concat(role, F.lit(": "))).otherwise(F.lit("")), text_of())
    return conversations.select("conv_id", "turn", F.xxhash64("role", "text").alias("part"), F.posexplode(F.split(raw, "\n")).alias("line", "text"))


def observe(lines: DataFrame) -> DataFrame:
    """``lines`` with what is seen of each: marker, where the text after it begins, length and end."""
    schema = ", ".join(f"{n} {t}" for n, t in lines.dtypes) + ", mark int, at int, length int, end int"

    def run(frames):
        for frame in frames:
            seen = [observed(x) for x in frame["text"]]
            told = pd.DataFrame(seen, columns=["mark", "at", "length", "end"], index=frame.index).astype("int32")
            yield pd.concat((frame.assign(conv_id=frame["conv_id"].astype("Int64"), turn=frame["turn"].astype("Int64")), told), axis=1)

    return lines.mapInPandas(run, schema)


def _role_index(role: Column, opens: int) -> Column:
    known = F.lower(F.trim(role))
    column = F.lit(None).cast("int")
    for i, r in enumerate(ROLES):
        column = F.when(known == r, F.lit(i + (0 if opens else len(ROLES)))).otherwise(column)
    return column


def train(conversations: DataFrame, seen: DataFrame | None = None) -> Model:
    """Counts over all conversations with known roles; what comes to the driver is bounded by the model's tables.

    ``seen``: the observed lines of the same conversations, if they are there already.
    """
    seen = observe(transcript(conversations)) if seen is None else seen
    turns = conversations.select("conv_id", "turn", _role_index(F.col("role"), 1).alias("opens"), _role_index(F.col("role"), 0).alias("goes_on"), F.size(F.split(text_of(), "\n")).alias("lines")).where("opens is not null")
    named = conversations.select("conv_id", "turn", F.xxhash64("role", "text").alias("part"), _role_index(F.col("role"), 1).alias("opens")).where("opens is not null").distinct()
    state = F.when(F.col("line") == 0, F.col("opens")).otherwise(F.col("opens") + len(ROLES)).alias("state")
    lines = seen.select("conv_id", "turn", "part", "line", "mark", "length", "end").join(named, ["conv_id", "turn", "part"]).select(state, "mark", "length", "end")
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("value")) for k in ("mark", "length", "end")])).alias("o")
    emitted = lines.groupBy("state", "mark", "length", "end").agg(F.count("*").alias("n")).select("state", each, "n").select("o.kind", "state", "o.value", "n")
    alike = turns.groupBy("conv_id", "turn", "opens", "goes_on", (F.col("lines") > 1).alias("more")).agg(F.count("*").alias("n"))
    after = alike.groupBy("conv_id", (F.col("turn") - 1).alias("turn"), F.col("opens").alias("next")).agg(F.sum("n").alias("n_next"))
    within = turns.where("lines > 1")
    steps = (
        within.select("opens", F.col("goes_on").alias("next"), F.lit(1).alias("n"))
        .unionByName(within.where("lines > 2").select(F.col("goes_on").alias("opens"), F.col("goes_on").alias("next"), (F.col("lines") - 2).alias("n")))
        .unionByName(alike.join(after, ["conv_id", "turn"]).select(F.when(F.col("more"), F.col("goes_on")).otherwise(F.col("opens")).alias("opens"), "next", (F.col("n") * F.col("n_next")).alias("n")))
    )
    starts = turns.groupBy("conv_id").agg(F.min_by("opens", "turn").alias("value")).select(F.lit("start").alias("kind"), F.lit(0).alias("state"), "value", F.lit(1).alias("n"))
    moved = steps.select(F.lit("step").alias("kind"), F.col("opens").alias("state"), F.col("next").alias("value"), "n")
    counts = emitted.unionByName(moved).unionByName(starts).groupBy("kind", "state", "value").agg(F.sum("n").alias("n")).collect()
    return Model.of({(r.kind, r.state, r.value): float(r.n) for r in counts})


def unmarked_share(model: Model, seen: DataFrame) -> float:
    """The share of openings of these observed lines that have no marker, from one count of lines and markers."""
    lines, marks = seen.agg(F.count("*"), F.count(F.when(F.col("mark") > 0, 1))).first()
    expected = (lines or 0) * model.turns_per_line()
    return min(max(1 - marks / expected, UNMARKED), MOST_UNMARKED) if expected else UNMARKED


_ORDER = ["conv_id", "chunk", "piece", "turn", "part", "line"]
#: Lines, and chunks, that one call of Python takes together.
TOGETHER = 20_000


def _segments(frame: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray, np.ndarray]:
    """The lines in order, and where each (conv_id, chunk, piece) starts and how long it is."""
    frame = frame.sort_values(_ORDER, na_position="first", kind="stable").reset_index(drop=True)
    conv, chunk, piece = frame["conv_id"].astype("Int64"), frame["chunk"], frame["piece"]
    new = ((conv != conv.shift()).fillna(False) | (conv.isna() != conv.shift().isna()) | (chunk != chunk.shift()) | (piece != piece.shift())).to_numpy(bool)
    new[:1] = True
    starts = np.nonzero(new)[0]
    return frame, starts, np.diff(np.append(starts, len(frame)))


def _pieces(lines: DataFrame, most: int) -> DataFrame:
    """``lines`` with their ``piece`` of a chunk: of ``most`` lines in order, 0 in chunks that have no more."""
    cell = ["conv_id", "chunk"]
    long = lines.groupBy(*cell).agg(F.count("*").alias("c")).where(F.col("c") > most).select(*[F.col(c).alias(f"of_{c}") for c in cell])
    if long.isEmpty():
        return lines.withColumn("piece", F.lit(0).cast("long"))
    rows = cut(lines.withColumn("row", F.monotonically_increasing_id()))
    keys = rows.select(*cell, "turn", "part", "line", "row").join(long, F.col("conv_id").eqNullSafe(F.col("of_conv_id")) & (F.col("chunk") == F.col("of_chunk")), "left_semi")
    at = numbered(keys, cell, ["turn", "part", "line", "row"]).select(F.col("row").alias("of_row"), F.floor((F.col(ROW) - 1) / most).cast("long").alias("piece"))
    return rows.join(at, F.col("row") == F.col("of_row"), "left").select(*lines.columns, F.coalesce("piece", F.lit(0).cast("long")).alias("piece"))


def decode(lines: DataFrame, model: Model, chunk: int = CHUNK, most: int = LINES) -> DataFrame:
    """``conv_id, turn, line, role, continued, n_lines, text``: the recovered turns of observed lines (see :func:`observe`)."""
    spark = lines.sparkSession
    cut_up = _pieces(lines.withColumn("chunk", F.floor(F.coalesce("turn", F.lit(-1)) / chunk).cast("long")), most)
    firsts = cut_up.groupBy("conv_id").agg(F.min("chunk").alias("chunk")).withColumn("first", F.lit(True))
    keyed = cut(
        cut_up.join(firsts.select(F.col("conv_id").alias("c"), F.col("chunk").alias("k"), "first"), F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("chunk") == F.col("k")), "left").select(
            *lines.columns, "chunk", "piece", (F.coalesce("first", F.lit(False)) & (F.col("piece") == 0)).alias("first")
        )
    )
    shards = shards_for(keyed.count(), TOGETHER, spark)
    by_chunk = F.pmod(F.xxhash64("conv_id", "chunk", "piece"), F.lit(shards)).alias("shard")
    by_conv = F.pmod(F.xxhash64("conv_id"), F.lit(shards)).alias("shard")
    n = len(STATES)

    def best(frame: pd.DataFrame) -> pd.DataFrame:
        frame, starts, lengths = _segments(frame)
        head = frame.iloc[starts]
        m = model.matrices(model.scores(frame[["mark", "length", "end"]].to_numpy()), starts, lengths, head["first"].to_numpy(bool))
        return pd.DataFrame({"conv_id": head["conv_id"].astype("Int64").array, "chunk": head["chunk"].array, "piece": head["piece"].array, "m": list(m.reshape(len(m), -1))})

    def chain(frame: pd.DataFrame) -> pd.DataFrame:
        frame, starts, lengths = _segments(frame.assign(turn=0, part=0, line=0))
        conv = frame["conv_id"].astype("Int64")
        new = ((conv != conv.shift()).fillna(False) | (conv.isna() != conv.shift().isna())).to_numpy(bool)
        new[:1] = True
        firsts, ms = np.append(np.nonzero(new)[0], len(frame)), frame["m"].to_list()
        enter, leave = np.zeros(len(frame), np.int32), np.zeros(len(frame), np.int32)
        for low, high in zip(firsts, firsts[1:]):
            at, backs = np.where(np.arange(n) == 0, 0.0, -np.inf), []
            for m in ms[low:high]:
                ways = at[:, None] + np.asarray(m).reshape(n, n)
                backs.append(ways.argmax(axis=0))
                at = ways.max(axis=0)
            state = int(at.argmax())
            for i in range(high - 1, low - 1, -1):
                leave[i] = state
                state = int(backs[i - low][state])
                enter[i] = state
        return pd.DataFrame({"conv_id": conv, "chunk": frame["chunk"], "piece": frame["piece"], "enter": enter, "leave": leave})

    def between(frame: pd.DataFrame) -> pd.DataFrame:
        frame, starts, lengths = _segments(frame)
        head = frame.iloc[starts]
        path = model.paths(
            model.scores(frame[["mark", "length", "end"]].to_numpy()), starts, lengths, head["first"].to_numpy(bool), head["enter"].to_numpy(int), head["leave"].to_numpy(int)
        )
        opens = path < len(ROLES)
        turn_starts = np.union1d(np.nonzero(opens)[0], starts)
        ends = np.append(turn_starts[1:], len(frame))
        texts, at = frame["text"].to_list(), frame["at"].to_list()
        joined = ["\n".join([texts[i][at[i] :] if opens[i] else texts[i], *texts[i + 1 : j]]) for i, j in zip(turn_starts, ends)]
        own = frame.iloc[turn_starts]
        return pd.DataFrame({
            "conv_id": own["conv_id"].astype("Int64").array, "turn": own["turn"].astype("Int64").array, "line": own["line"].array, "role": [STATES[s][0] for s in path[turn_starts]],
            "continued": ~opens[turn_starts], "n_lines": ends - turn_starts, "text": joined,
        })

    seen = ["conv_id", "chunk", "piece", "turn", "part", "line", "mark", "length", "end", "first"]
    matrices = keyed.select(*seen, by_chunk).groupBy("shard").applyInPandas(best, "conv_id long, chunk long, piece long, m array<double>")
    borders = cut(matrices.withColumn("shard", by_conv).groupBy("shard").applyInPandas(chain, "conv_id long, chunk long, piece long, enter int, leave int"))
    known = keyed.join(borders.withColumnsRenamed({"conv_id": "c", "chunk": "k", "piece": "p"}), F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("chunk") == F.col("k")) & (F.col("piece") == F.col("p"))).drop("c", "k", "p")
    return known.withColumn("shard", by_chunk).groupBy("shard").applyInPandas(between, "conv_id long, turn long, line int, role string, continued boolean, n_lines int, text string")


def rendered(turns: DataFrame) -> DataFrame:
    header = F.when(F.col("continued"), F.lit("")).otherwise(F.concat(F.lit("<|"), F.col("role"), F.lit("|>\n")))
    return turns.withColumn("rendered", F.concat(header, F.col("text"), F.lit("\n"))).drop("text")


def format_chats(conversations: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """One row per recovered turn: ``conv_id, turn, line, role, continued, n_lines, rendered``."""
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    lines = cut(observe(transcript(rows)))
    model = train(rows, lines)
    return rendered(decode(lines, model.with_unmarked(unmarked_share(model, lines)), chunk))
