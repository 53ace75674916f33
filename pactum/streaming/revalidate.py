"""Validation of a stream of records, and sessions of edited inputs.

`validate_stream` judges each micro-batch with a record's rules, which are the same
for a batch and a stream. `Session` keeps immutable versions of its input; an edit
makes the next version, and only rows of changed keys are judged again.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pactum.operators.model import Record
from pactum.storage import materialize


def stream_diagnostics(stream: DataFrame, record: Record, path: Column, keep: list[str] = ()) -> DataFrame:
    """The reports of a stream's rows, as a stream: the rules look at one row at a time, so no state is kept."""
    return record.diagnostics(stream, path, keep=keep)


def windowed_reports(stream: DataFrame, record: Record, path: Column, time: str, window: str, late: str) -> DataFrame:
    """Reports by code in windows of event time, final when the watermark has passed."""
    judged = record.diagnostics(stream.withWatermark(time, late), path, keep=[time])
    return judged.groupBy(F.window(time, window), "code").count()


def validate_stream(stream: DataFrame, record: Record, path: Column, write: Callable[[DataFrame, DataFrame, int], None], checkpoint: str, keep: list[str] = ()) -> StreamingQuery:
    """Call write(values, reports, batch number) for each micro-batch; a batch that is repeated after a failure has its number again."""

    def each(batch: DataFrame, number: int) -> None:
        write(record.evaluate(batch, path, keep), record.diagnostics(batch, path, keep=keep), number)

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).start()


class SessionError(ValueError):
    """An edit that does not fit what is there."""


@dataclass(frozen=True)
class Version:
    """An input, and the edits over it: for each edited key its row, or null where the row is gone. The edits are a written table."""

    base: DataFrame
    edits: DataFrame | None = None
    step: str = "bind"
    keys: int = 0


class Session:
    """Versions of one keyed input under a record's rules.

    An edit writes the rows of all keys edited so far, and never the input itself; a
    version is the input without those keys, and the rows that they have now. So its
    plan is the same after any number of edits. Keys are unique; a null key names
    nothing. An edit that is refused leaves the session as it was.
    """

    def __init__(self, record: Record, df: DataFrame, key: str, path: Column):
        self.record, self.key, self.path = record, key, path
        self.versions = [Version(df)]
        self.at = 0

    def reset(self) -> None:
        """The first input again, without any edit; an operation like others, which undo takes back."""
        self._next(Version(self.versions[0].base, step="reset"))

    def bind(self, df: DataFrame) -> None:
        """Another input in place of this one; the edits stay behind."""
        self._next(Version(df))

    def _rows(self, version: Version) -> DataFrame:
        if version.edits is None:
            return version.base
        gone = version.edits.select(F.col("key").alias("_edited"))
        rest = version.base.join(gone, version.base[self.key] == F.col("_edited"), "left_anti")
        return rest.unionByName(version.edits.filter("row is not null").select("row.*"))

    @property
    def now(self) -> DataFrame:
        return self._rows(self.versions[self.at])

    def _next(self, version: Version) -> None:
        del self.versions[self.at + 1 :]
        self.versions.append(version)
        self.at += 1

    def _edit(self, step: str, changes: DataFrame) -> None:
        """changes: key and row. They are written before anything is asked of them, so that they are worked out once."""
        old = self.versions[self.at]
        new = materialize(changes, "changes")
        n, different = new.agg(F.count(F.lit(1)), F.count_distinct("key")).first()
        if n != different:
            raise SessionError(f"{step}: a key is null or is named twice")
        there = self.now.select(F.col(self.key).alias("_there"))
        if step == "create":
            known = new.join(there, new["key"] == F.col("_there"), "left_semi").select("key").first()
            if known:
                raise SessionError(f"create: {self.key} {known[0]} already holds a value")
        elif step != "upsert":
            unknown = new.join(there, new["key"] == F.col("_there"), "left_anti").select("key").first()
            if unknown:
                raise SessionError(f"{step}: nothing at {self.key} {unknown[0]}")
        if old.edits is not None:
            new = materialize(old.edits.join(new.select("key"), "key", "left_anti").unionByName(new), "edits")
        self._next(Version(old.base, new, step, n))

    def _full(self, rows: DataFrame) -> DataFrame:
        base = self.versions[self.at].base
        return rows.select(F.col(self.key).alias("key"), F.struct(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in base.schema]).alias("row"))

    def create(self, rows: DataFrame) -> None:
        """Add rows of new keys."""
        self._edit("create", self._full(rows))

    def update(self, rows: DataFrame) -> None:
        """Replace the rows of keys that there are."""
        self._edit("update", self._full(rows))

    def upsert(self, rows: DataFrame) -> None:
        """Create and update: rows stand in for those of their keys."""
        self._edit("upsert", self._full(rows))

    def remove(self, keys: DataFrame) -> None:
        row = self.versions[self.at].base.schema.simpleString()
        self._edit("remove", keys.select(F.col(self.key).alias("key"), F.lit(None).cast(row).alias("row")))

    def undo(self, steps: int = 1) -> None:
        self.at = max(0, self.at - steps)

    def redo(self, steps: int = 1) -> None:
        self.at = min(len(self.versions) - 1, self.at + steps)

    def history(self) -> list[tuple[str, int, bool]]:
        """The log: each operation, the number of keys that it names, and whether it is in force."""
        return [(v.step, v.keys, i <= self.at) for i, v in enumerate(self.versions)][1:]

    def _reads(self, members: Sequence[str]) -> list[str]:
        """The members and all that they are worked out from, in the record's order."""
        needs, found, todo = self.record.needs(), set(), list(members)
        while todo:
            n = todo.pop()
            if n not in found:
                found.add(n)
                todo.extend(needs[n])
        return [n for n in self.record.members if n in found]

    def evaluate(self, members: Sequence[str] | None = None) -> DataFrame:
        """Completed values; with members, a partial evaluation of those and of what they read."""
        if members is None:
            return self.record.evaluate(self.now, self.path, [self.key])
        part = replace(self.record, members={n: self.record.members[n] for n in self._reads(members)}, asserts=())
        done, values, _ = part.compile(self.now, self.path)
        key = [] if self.key in members else [F.col(self.key)]
        return done.select(*key, *[values[n].v.alias(n) for n in members])

    def trace(self, member: str) -> DataFrame:
        """What a member's value comes from in each instance: seq, depth, member, kind, value, and whether it is bad. What stands above already is not opened again."""
        needs, lines, seen = self.record.needs(), [], set()
        place = {n: i for i, n in enumerate(self.record.members)}

        def walk(n: str, depth: int) -> None:
            above = n in seen
            lines.append((depth, n, "above" if above else self.record.members[n].kind))
            seen.add(n)
            if not above:
                for inner in sorted(needs[n], key=place.__getitem__):
                    walk(inner, depth + 1)

        walk(member, 0)
        part = replace(self.record, members={n: self.record.members[n] for n in self._reads([member])}, asserts=())
        done, values, _ = part.compile(self.now, self.path)
        line = lambda depth, n, kind: F.struct(F.lit(depth).alias("depth"), F.lit(n).alias("member"), F.lit(kind).alias("kind"), values[n].v.cast("string").alias("value"), F.coalesce(values[n].is_bad, F.lit(False)).alias("bad"))
        return done.select(self.key, F.posexplode(F.array(*[line(*x) for x in lines])).alias("seq", "x")).select(self.key, "seq", "x.*")

    def validate(self) -> DataFrame:
        return self.record.diagnostics(self.now, self.path, keep=[self.key])

    def revalidate(self, before: DataFrame, changes: DataFrame) -> DataFrame:
        """The reports of this version from those of the one before it: only rows of changed keys are judged."""
        kept = before.join(changes.select(self.key), self.key, "left_anti")
        again = self.record.diagnostics(self.now.join(changes.select(self.key), self.key, "left_semi"), self.path, keep=[self.key])
        return kept.unionByName(again)

    def edited(self) -> DataFrame:
        """The keys that edits have named since the input was bound."""
        v = self.versions[self.at]
        return v.base.select(self.key).limit(0) if v.edits is None else v.edits.select(F.col("key").alias(self.key))

    def diff(self) -> DataFrame:
        """Rows that the last step removed (-) and added (+)."""
        old = self._rows(self.versions[max(0, self.at - 1)])
        return old.exceptAll(self.now).withColumn("change", F.lit("-")).unionByName(self.now.exceptAll(old).withColumn("change", F.lit("+")))
