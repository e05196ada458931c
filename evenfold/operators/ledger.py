"""Incremental loads: each record that is new or changed since the last load that succeeded, once (problem 4).

The ledger keeps one work item per stretch of arrival times. An item is pending,
leased or done. A lease carries a fencing token; when it expires, the item is
pending again and the next lease gets a higher token, so a writer that comes
back late is rejected. Every attempt writes to a hidden folder of its own under the item's
path, which is made from the item's beginning alone; the commit names the attempt that
counts, and only that one is published under the path. The ledger is a row of version files,
each of which one writer alone can create, so two processes never overwrite each other's states.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import asdict, dataclass, field
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evenfold.sources import files

#: A ledger is one row per load and grows with time, not with data; beyond this many rows it is refused.
MAX_RUNS = 100_000


class StaleWriter(RuntimeError):
    """A commit with a token that is no longer the newest of its item."""


@dataclass
class Item:
    """Rows with after < arrived_at <= upto; after None is the beginning of time."""

    table: str
    after: datetime | None
    upto: datetime
    state: str = "pending"
    token: int = 0
    run_id: int | None = None
    expires: datetime | None = None
    attempt: int | None = None

    @property
    def path(self) -> str:
        """The same for every attempt: where the stretch ends may still change, where it begins not."""
        return f"{self.table}/after={'begin' if self.after is None else self.after.strftime('%Y%m%dT%H%M%S%f')}"


@dataclass
class Ledger:
    """Items by table, each table's in order; the last one may be open."""

    items: dict[str, list[Item]] = field(default_factory=dict)

    def high_water(self, table: str) -> datetime | None:
        return max((i.upto for i in self.items.get(table, []) if i.state == "done"), default=None)

    def lease(self, table: str, upto: datetime, run_id: int, now: datetime, expires: datetime) -> Item | None:
        """Leases the stretch between what is done and upto; None if nothing is left before upto.
        An item leased to another run is taken over only once its lease has expired."""
        done = self.high_water(table)
        if done is not None and upto <= done:
            return None
        open_ = [i for i in self.items.setdefault(table, []) if i.state != "done"]
        item = open_[0] if open_ else Item(table, done, upto)
        if not open_:
            self.items[table].append(item)
        if item.state == "leased" and item.run_id != run_id and item.expires is not None and now < item.expires:
            raise StaleWriter(f"{item.path} is leased to run {item.run_id} until {item.expires}")
        item.after, item.upto, item.state, item.run_id, item.expires = done, upto, "leased", run_id, expires
        item.token += 1
        return item

    def expire(self, now: datetime) -> None:
        for item in (i for items in self.items.values() for i in items):
            if item.state == "leased" and item.expires is not None and item.expires <= now:
                item.state, item.run_id = "pending", None

    def commit(self, item: Item, token: int) -> None:
        """Done, by the attempt with this token; refused unless it is the newest of the ledger's item with that beginning."""
        own = next((i for i in self.items.get(item.table, []) if i.after == item.after), None)
        if own is None or own.state != "leased" or token != own.token:
            raise StaleWriter(f"{item.path}: token {token}, newest {own.token if own else None}")
        own.state, own.attempt = "done", token

    def replay(self, runs: list[tuple[int, str, datetime, bool]]) -> list[Item]:
        """Takes a log of loads (run_id, table, cutoff, succeeded) as history, in order of run_id: each load leases what is open up to its cutoff, succeeded
        ones commit. Loads come one after another, so a lease ends when the next load begins. Returns the done items."""
        start = datetime(1970, 1, 1)
        for at, (run, table, cutoff, ok) in enumerate(sorted(runs, key=lambda r: r[:2])):
            now, until = start + timedelta(seconds=at), start + timedelta(seconds=at + 1)
            self.expire(now)
            item = self.lease(table, cutoff, run, now, until)
            if item is not None and ok:
                self.commit(item, item.token)
        return [i for items in self.items.values() for i in items if i.state == "done"]

    def dumps(self) -> str:
        return json.dumps({t: [asdict(i) for i in items] for t, items in self.items.items()}, default=str)

    @classmethod
    def loads(cls, text: str) -> Ledger:
        when = lambda x: None if x is None else datetime.fromisoformat(x)
        return cls({t: [Item(**(i | {k: when(i[k]) for k in ("after", "upto", "expires")})) for i in items] for t, items in json.loads(text).items()})


class Store:
    """A ledger under a folder that all processes share. A change is made to the newest version and stored as the next one; if another
    process was faster, it is made again to that one's version."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def _versions(self) -> list[str]:
        return [n for n in files.names(self.spark, f"{self.root}/_ledger") if n.startswith("v") and n.endswith(".json")]

    def read(self) -> tuple[Ledger, int]:
        """The newest ledger and its version; an empty one of version 0 if there is none."""
        seen = self._versions()
        return (Ledger.loads(files.read_text(self.spark, f"{self.root}/_ledger/{seen[-1]}")), int(seen[-1][1:-5])) if seen else (Ledger(), 0)

    def swap(self, ledger: Ledger, version: int) -> bool:
        """Stores the ledger as the version after this one; false if there is one already. Versions older than the last eight are dropped."""
        made = files.create(self.spark, f"{self.root}/_ledger/v{version + 1:012d}.json", ledger.dumps())
        for old in self._versions()[:-8] if made else []:
            files.delete(self.spark, f"{self.root}/_ledger/{old}")
        return made

    def update(self, change: Callable[[Ledger], object]) -> object:
        while True:
            ledger, version = self.read()
            got = change(ledger)
            if self.swap(ledger, version):
                return got

    def lease(self, table: str, upto: datetime, run_id: int, now: datetime, expires: datetime) -> Item | None:
        def change(ledger: Ledger) -> Item | None:
            ledger.expire(now)
            return ledger.lease(table, upto, run_id, now, expires)

        return self.update(change)

    def attempt_path(self, item: Item, token: int) -> str:
        return f"{self.root}/{item.path}/_attempt-{token}"

    def publish(self, items: list[Item]) -> list[str]:
        """The folders of done items. What a commit named is moved to its place, unless it is there; leftovers of other attempts go. May be called
        again at any time, also after a crash between commit and publication."""
        out = []
        for i in (i for i in items if i.state == "done"):
            folder = f"{self.root}/{i.path}"
            if not files.exists(self.spark, f"{folder}/data") and not files.move(self.spark, self.attempt_path(i, i.attempt), f"{folder}/data"):
                files.make_folder(self.spark, f"{folder}/data")
            for name in files.names(self.spark, folder):
                if name.startswith("_attempt-"):
                    files.delete(self.spark, f"{folder}/{name}")
            out.append(f"{folder}/data")
        return out


def runs_of(log: DataFrame) -> list[tuple[int, str, datetime, bool]]:
    """(run_id, table, cutoff, succeeded) of a log of loads. Log rows that repeat count once; rows without run_id, table_name or cutoff_at
    cover nothing."""
    log = log.where("run_id is not null and table_name is not null and cutoff_at is not null")
    log = log.groupBy("run_id", "table_name").agg(
        F.max_by("cutoff_at", F.struct((F.col("status") == "succeeded").cast("int"), "cutoff_at")).alias("cutoff_at"),
        F.max(F.coalesce(F.col("status") == "succeeded", F.lit(False))).alias("ok"),
    )
    rows = log.limit(MAX_RUNS + 1).collect()
    if len(rows) > MAX_RUNS:
        raise ValueError(f"the log has more than {MAX_RUNS} loads; archive old ones")
    return [(r.run_id, r.table_name, r.cutoff_at, r.ok) for r in rows]


def replay_runs(log: DataFrame) -> list[Item]:
    """The done items of a log of loads, taken as a ledger's history. Loads not later than what is done cover nothing."""
    return Ledger().replay(runs_of(log))


def _time(t: datetime) -> Column:
    """A literal that depends on no time zone."""
    return F.lit(t.isoformat(sep=" ")).cast("timestamp_ntz")


#: Up to this many stretches are told by an expression; more by a join on the day.
FEW = 256


def _with_run(rows: DataFrame, items: list[Item]) -> DataFrame:
    """rows with run_id of the item that covers the time `at`; rows that none covers are left out. The stretches are sorted and disjoint."""
    if len(items) <= FEW:
        ends = F.array(*(_time(i.upto) for i in items))
        ids = F.array(*(F.lit(i.run_id).cast("long") for i in items))
        before = F.aggregate(ends, F.lit(0), lambda n, x: n + F.when(x < F.col("at"), 1).otherwise(0))
        return rows.withColumn("run_id", F.get(ids, before)).where("run_id is not null")
    spark = rows.sparkSession
    first, rest = items[0], items[1:]
    days = [(i.run_id, i.after.isoformat(sep=" "), i.upto.isoformat(sep=" ")) for i in rest]
    spans = spark.createDataFrame(days, "run_id long, a string, b string").withColumns({"a": F.col("a").cast("timestamp_ntz"), "b": F.col("b").cast("timestamp_ntz")})
    spans = spans.withColumn("day", F.explode(F.sequence(F.to_date("a"), F.to_date("b"))))
    early = rows.where(F.col("at") <= _time(first.upto)).withColumn("run_id", F.lit(first.run_id).cast("long"))
    late = rows.where(F.col("at") > _time(first.upto)).withColumn("day", F.to_date("at")).join(spans, "day").where("at > a and at <= b")
    return early.unionByName(late.select(*rows.columns, "run_id"))


def first_seen(df: DataFrame, key: Column, items: list[Item]) -> DataFrame:
    """(record_id, run_id): each record in the run that first covers any row of it."""
    if not items:
        return df.sparkSession.createDataFrame([], "record_id string, run_id long")
    got = df.select(key.alias("record_id"), F.col("arrived_at").cast("timestamp_ntz").alias("at")).where("record_id is not null and at is not null")
    return _with_run(got.groupBy("record_id").agg(F.min("at").alias("at")), items).select("record_id", "run_id")


def changed(df: DataFrame, key: Column, items: list[Item], compare: list[str]) -> DataFrame:
    """(record_id, run_id): a record is a case of a run if it is new to it, or if its latest row differs
    in a compared column from its latest row of the runs before. Null is a value. Rows of one record that
    arrive at the same time are settled by their compared values."""
    if not items:
        return df.sparkSession.createDataFrame([], "record_id string, run_id long")
    at = F.col("arrived_at").cast("timestamp_ntz")
    got = df.select(key.alias("record_id"), at.alias("at"), F.struct(*compare).alias("v")).where("record_id is not null and at is not null")
    last = _with_run(got, items).groupBy("record_id", "run_id").agg(F.max(F.struct("at", "v")).alias("l"))
    w = Window.partitionBy("record_id").orderBy("run_id")  # at most one row per run
    last = last.withColumns({"v": F.col("l.v"), "p": F.lag("l.v").over(w), "n": F.row_number().over(w)})
    return last.where((F.col("n") == 1) | ~F.col("v").eqNullSafe(F.col("p"))).select("record_id", "run_id")


def process(df: DataFrame, item: Item, store: Store, work: Callable[[DataFrame], DataFrame], arrived: str = "arrived_at") -> str:
    """Runs work(rows of a leased item) into an attempt's folder, commits and publishes it; returns the item's folder. If a newer lease exists,
    the commit fails, this attempt's rows are dropped and nothing else is touched."""
    token = item.token
    at = F.col(arrived).cast("timestamp_ntz")
    rows = df.where(at <= _time(item.upto))
    if item.after is not None:
        rows = rows.where(at > _time(item.after))
    path = store.attempt_path(item, token)
    work(rows).write.mode("overwrite").parquet(path)

    def change(ledger: Ledger) -> list[Item]:
        ledger.commit(item, token)
        return [i for i in ledger.items[item.table] if i.after == item.after]

    try:
        done = store.update(change)
    except StaleWriter:
        files.delete(store.spark, path)
        raise
    return store.publish(done)[0]


def process_history(results: dict[str, DataFrame], runs: list[tuple[int, str, datetime, bool]], store: Store) -> DataFrame:
    """Works a log of loads off in one go: results (by table, record_id and run_id of all stretches) are written as the attempts of their items, one commit names
    them all, and what is published is read back: (table_name, run_id, record_id). A crash before the commit leaves hidden attempts that the next
    call overwrites; one after it is made good by publish."""
    plan = Ledger.loads(store.read()[0].dumps()).replay(runs)
    for table, rows in results.items():
        mine = {i.run_id: i for i in plan if i.table == table}
        if mine:
            draft = f"{store.root}/{table}/_draft"
            tokens = {r: i.token for r, i in mine.items()}
            rows.select("record_id", "run_id", F.col("run_id").alias("_run")).hint("rebalance", "_run").write.mode("overwrite").partitionBy("_run").parquet(draft)
            for run, token in tokens.items():
                files.make_folder(store.spark, f"{store.root}/{mine[run].path}")
                files.delete(store.spark, store.attempt_path(mine[run], token))
                files.move(store.spark, f"{draft}/_run={run}", store.attempt_path(mine[run], token))
            files.delete(store.spark, draft)
    done = store.update(lambda ledger: ledger.replay(runs))
    out = None
    for table in results:
        paths = store.publish([i for i in done if i.table == table])
        empty = store.spark.createDataFrame([], "record_id string, run_id long")
        part = (store.spark.read.schema("record_id string, run_id long").parquet(*paths) if paths else empty).select(F.lit(table).alias("table_name"), "run_id", "record_id")
        out = part if out is None else out.unionByName(part)
    return out
