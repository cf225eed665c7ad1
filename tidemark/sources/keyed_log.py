"""A keyed table in a shared folder that grows by batches: a log of appends over a merged base.

Every version of the table is one small file that names the data it is made of: ``base``, the merged rows of each
partition, and ``log``, the batches since, in order. A change writes its data to a folder of its own, which nobody reads
yet, and commits version n + 1 by a rename that fails if that version is there; the loser reads the new version and tries
again. So a batch of a few rows adds files and rewrites none, readers see whole versions, and a crash before the commit
leaves the table as it was. A version also holds the last batch of each writer, so that a batch that is sent again is
left out, and the high-water marks of the sources, which thereby advance with the rows they stand for.

Readers merge: of the rows of a key the last in ``order`` counts, or without an order the last to arrive. Only partitions
with batches in the log are merged; the log's side is bounded, as a compaction folds it into the base of the partitions it
touches once it holds ``bound`` batches. Superseded data is removed by the compaction after, so a reader that has planned
its scan has that long to finish. Version files name partitions and sources, so these should be thousands, not millions.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..session import create_file, listed, read_file, remove
from .staging import keep_latest

PART, ATTEMPT, POSITION = "upsert_part", "upsert_attempt", "log_position"
#: Batches in the log before it is folded into the base.
BOUND = 16
#: Version files that stay.
VERSIONS = 20
EMPTY = {"schema": None, "base": {}, "log": [], "done": {}, "marks": {}, "old": []}


class KeyedLog:
    """``part`` has to follow from the keys; by default it is their hash. ``order``: columns by which a key's last row is found."""

    def __init__(self, spark: SparkSession, folder: str, keys: list[str], part: Column | None = None, order: list[str] | None = None, bound: int = BOUND):
        self.spark, self.folder, self.keys, self.order, self.bound = spark, folder, keys, order or [], bound
        self.part = F.coalesce((F.pmod(F.xxhash64(*keys), F.lit(16)) if part is None else part).cast("string"), F.lit(""))

    def version(self) -> tuple[int, dict]:
        """The number and content of the last version; 0 before the first."""
        numbers = [int(n.removesuffix(".json")) for n in listed(self.spark, f"{self.folder}/versions") if n.endswith(".json") and n[0] != "."]
        return (max(numbers), json.loads(read_file(self.spark, self._file(max(numbers))))) if numbers else (0, json.loads(json.dumps(EMPTY)))

    def _file(self, number: int) -> str:
        return f"{self.folder}/versions/{number:020d}.json"

    def _commit(self, number: int, state: dict) -> bool:
        """Makes ``state`` version ``number``, unless someone has made that version."""
        done = create_file(self.spark, self._file(number), json.dumps(state))
        if done and number > VERSIONS:
            remove(self.spark, self._file(number - VERSIONS))
        return done

    def _written(self, rows: DataFrame) -> str:
        """The folder that holds ``rows`` by partition; large partitions are dealt to several tasks."""
        attempt = uuid.uuid4().hex
        rows.hint("rebalance", PART).write.partitionBy(PART).parquet(f"{self.folder}/data/{ATTEMPT}={attempt}")
        return attempt

    def _parts(self, attempt: str) -> list[str]:
        return sorted(n for n in listed(self.spark, f"{self.folder}/data/{ATTEMPT}={attempt}") if n.startswith(f"{PART}="))

    def has(self, writer: str, number: int) -> bool:
        """Whether ``writer`` has committed batch ``number``, or a later one."""
        return self.version()[1]["done"].get(writer, -1) >= number

    def append(self, batch: DataFrame, writer: str = "", number: int | None = None, marks: dict[str, str] | None = None, since: dict[str, str] | None = None) -> bool:
        """Adds a batch, once: False if ``writer`` has committed batch ``number``, or a later one, before.

        ``marks`` are stored with it. ``since`` are the marks that the batch was chosen by: if others have been committed
        in the meantime nothing is added, and the answer is False.
        """
        refused = lambda state: (number is not None and state["done"].get(writer, -1) >= number) or (since is not None and state["marks"] != since)
        if refused(self.version()[1]):
            return False
        attempt = self._written(self._one_per_key(batch).withColumn(PART, self.part))
        parts = self._parts(attempt)
        while True:
            at, state = self.version()
            if refused(state):
                remove(self.spark, f"{self.folder}/data/{ATTEMPT}={attempt}")
                return False
            state["schema"] = state["schema"] or batch.schema.json()
            state["log"] += [{"attempt": attempt, "parts": parts}] if parts else []
            state["marks"] |= marks or {}
            if number is not None:
                state["done"][writer] = number
            if self._commit(at + 1, state):
                break
        if len(state["log"]) >= self.bound:
            self.compact()
        return True

    def _one_per_key(self, rows: DataFrame) -> DataFrame:
        return keep_latest(rows, self.keys, self.order) if self.order else rows

    def _read(self, state: dict, paths: list[str]) -> DataFrame:
        schema = StructType([*StructType.fromJson(json.loads(state["schema"])).fields, StructField(ATTEMPT, StringType()), StructField(PART, StringType())])
        return self.spark.read.schema(schema).option("basePath", f"{self.folder}/data").parquet(*[f"{self.folder}/data/{p}" for p in paths])

    def _merged(self, state: dict, parts: list[str]) -> DataFrame:
        """One row per key of the partitions ``parts``, which the log touches."""
        batches = [(i, e["attempt"], p) for i, e in enumerate(state["log"]) for p in e["parts"] if p in parts]
        places = F.create_map(*[F.lit(x) for i, a in sorted({(i, a) for i, a, _ in batches}) for x in (a, i)])
        log = self._read(state, [f"{ATTEMPT}={a}/{p}" for _, a, p in batches]).withColumn(POSITION, places[F.col(ATTEMPT)])
        new = keep_latest(log, self.keys, [*self.order, POSITION])
        held = [f"{ATTEMPT}={state['base'][p]}/{p}" for p in parts if p in state["base"]]
        if not held:
            return new.drop(POSITION)
        old = self._read(state, held)
        same = reduce(lambda a, b: a & b, [F.col(f"old.{k}").eqNullSafe(F.col(f"new.{k}")) for k in self.keys])
        kept = old.alias("old").join(new.select(*self.keys).alias("new"), same, "left_anti")
        if self.order:  # an old row may come after the new one
            again = old.alias("old").join(new.select(*self.keys).alias("new"), same, "left_semi").withColumn(POSITION, F.lit(-1))
            new = keep_latest(new.unionByName(again), self.keys, [*self.order, POSITION])
        return kept.unionByName(new.drop(POSITION))

    def table(self, schema: StructType | None = None) -> DataFrame:
        """The table's last version; ``schema`` is that of an empty table."""
        _, state = self.version()
        touched = sorted({p for e in state["log"] for p in e["parts"]})
        rest = [f"{ATTEMPT}={a}/{p}" for p, a in sorted(state["base"].items()) if p not in touched]
        if not touched and not rest:
            return self.spark.createDataFrame([], schema or StructType.fromJson(json.loads(state["schema"] or '{"fields": []}')))
        found = ([self._merged(state, touched)] if touched else []) + ([self._read(state, rest)] if rest else [])
        return reduce(DataFrame.unionByName, found).drop(ATTEMPT, PART)

    def compact(self) -> None:
        """Folds the log into the base of the partitions that it touches, and removes what the compaction before has left behind."""
        _, state = self.version()
        folded = [e["attempt"] for e in state["log"]]
        touched = sorted({p for e in state["log"] for p in e["parts"]})
        if not touched:
            return
        attempt = self._written(self._merged(state, touched).drop(ATTEMPT))
        while True:
            at, now = self.version()
            if [e["attempt"] for e in now["log"]][: len(folded)] != folded:  # another compaction was first
                remove(self.spark, f"{self.folder}/data/{ATTEMPT}={attempt}")
                return
            gone, done = now["old"], now["log"][: len(folded)]
            now["old"] = [f"{ATTEMPT}={now['base'][p]}/{p}" for p in touched if p in now["base"]] + [f"{ATTEMPT}={a}" for a in folded]
            now["base"] |= {p: attempt for p in touched}
            now["log"] = now["log"][len(done) :]
            if self._commit(at + 1, now):
                left = self._named(now)
                for path in gone:
                    whole = path.split("/")[0]
                    remove(self.spark, f"{self.folder}/data/{path if whole in left else whole}")
                return

    def _named(self, state: dict) -> set[str]:
        """The data folders that a version names, those of superseded data included."""
        return {f"{ATTEMPT}={a}" for a in (*[e["attempt"] for e in state["log"]], *state["base"].values())} | {p.split("/")[0] for p in state["old"]}

    def vacuum(self) -> int:
        """Removes data that no version names, as crashes leave behind. Only while nobody writes."""
        named = self._named(self.version()[1])
        left = [n for n in listed(self.spark, f"{self.folder}/data") if n not in named]
        for n in left:
            remove(self.spark, f"{self.folder}/data/{n}")
        return len(left)

    def marks(self) -> dict[str, str]:
        return self.version()[1]["marks"]

    def ingest(self, choose: Callable[[dict[str, str]], DataFrame], source: str, ts: str) -> bool:
        """Adds the rows that ``choose`` finds beyond the stored marks, and advances these with them, in one commit.

        A mark is the last ``ts`` of a source. Who loses to another load chooses anew from the marks that this has left, so no
        row is lost or added twice. False if there is nothing new.
        """
        while True:
            since = self.marks()
            new = choose(since).persist()  # it is read twice
            found = new.where(F.col(source).isNotNull()).groupBy(F.col(source).cast("string").alias("source")).agg(F.max(ts).cast("string").alias("last")).collect()  # a row per source
            added = self.append(new, marks={r["source"]: r["last"] for r in found if r["last"] is not None}, since=since) if found else None
            new.unpersist()
            if added is not False:
                return bool(added)
