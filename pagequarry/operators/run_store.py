"""Stored runs: each change of a run is a new version in a file of its own, and the newest one counts.

A version is written beside its place and renamed into it, which fails where the place is taken: of two
writers one wins, and the other reads again. A run that is being searched has an owner and a lease, renewed
with each batch; when the driver is lost, the lease ends and `recover` queues the run again, with its counters and
the batches it has done. A request to cancel is a version too, read between batches.

The files are small and there is a folder for each run, so a change lists that run's versions only. As a table
the runs are read by Spark, the newest version of each.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import asdict, fields, replace
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession, functions as F

from pagequarry.operators.runs import NOT_STARTED, Run, execute, now
from pagequarry.schemas import RUNS
from pagequarry.sources.tables import file_system

LEASE = 600
_TIMES = ("started_at", "finished_at", "lease_until")
_LISTS = ("states", "agency_types")


class Taken(RuntimeError):
    """Somebody else changed the run, or holds it."""


class RunStore:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    # ------------------------------------------------------------ versions
    def _versions(self, run_id: int) -> list[int]:
        fs, at = file_system(self.spark, f"{self.path}/run={run_id}")
        if not fs.exists(at):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(at)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith(("_", ".")))

    def _write(self, run: Run, version: int) -> None:
        row = {k: v.isoformat() if isinstance(v, datetime) else list(v) if isinstance(v, tuple) else v for k, v in asdict(run).items()}
        fs, place = file_system(self.spark, f"{self.path}/run={run.id}/{version:08d}.json")
        _, draft = file_system(self.spark, f"{self.path}/run={run.id}/_{uuid.uuid4().hex}")
        out = fs.create(draft, False)
        out.write(bytearray(json.dumps({**row, "version": version}).encode()))
        out.close()
        if fs.exists(place) or not fs.rename(draft, place):
            fs.delete(draft, False)
            raise Taken(f"Run {run.id} was changed meanwhile.")

    def read(self, run_id: int) -> tuple[Run, int]:
        """A run and its version."""
        versions = self._versions(run_id)
        if not versions:
            raise KeyError(run_id)
        fs, at = file_system(self.spark, f"{self.path}/run={run_id}/{versions[-1]:08d}.json")
        stream = fs.open(at)
        try:
            row = json.loads(bytes(stream.readAllBytes()))
        finally:
            stream.close()
        known = {f.name for f in fields(Run)}
        row = {k: v for k, v in row.items() if k in known}
        row |= {k: datetime.fromisoformat(row[k]) for k in _TIMES if row.get(k)} | {k: tuple(row[k]) for k in _LISTS if k in row}
        return Run(**row), versions[-1]

    def change(self, run_id: int, by: Callable[[Run], Run], tries: int = 20) -> Run:
        """The run as `by` makes it of the newest version; made again if somebody else was faster."""
        for _ in range(tries):
            run, version = self.read(run_id)
            new = by(run)
            if new == run:
                return run
            try:
                self._write(new, version + 1)
                return new
            except Taken:
                continue
        raise Taken(f"Run {run_id} is changed all the time.")

    # ------------------------------------------------------------ what runs go through
    def add(self, run: Run) -> Run:
        """A new run; the id must be free."""
        if self._versions(run.id):
            raise Taken(f"Run {run.id} exists.")
        self._write(run, 0)
        return run

    def next_id(self) -> int:
        fs, at = file_system(self.spark, self.path)
        names = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
        return 1 + max((int(n.removeprefix("run=")) for n in names if n.startswith("run=")), default=0)

    def cancel(self, run_id: int) -> Run:
        """A queued run ends at once; one that is searched ends after its batch; others stay as they are."""

        def by(run: Run) -> Run:
            if run.status == "queued":
                return replace(run, status="cancelled", cancel_requested=True, finished_at=now(), error_message=NOT_STARTED)
            return replace(run, cancel_requested=True) if run.status == "running" else run

        return self.change(run_id, by)

    def cancelled(self, run_id: int) -> bool:
        return self.read(run_id)[0].cancel_requested

    def claim(self, run_id: int, owner: str, lease: int = LEASE) -> Run:
        """Take a queued run, or one whose lease has ended."""

        def by(run: Run) -> Run:
            free = run.status == "queued" or (run.status == "running" and (run.lease_until is None or run.lease_until < now()))
            if not free:
                raise Taken(f"Run {run_id} is {run.status}.")
            return replace(run, status="running", owner=owner, lease_until=now() + timedelta(seconds=lease))

        return self.change(run_id, by)

    def keep(self, run: Run, owner: str, lease: int = LEASE) -> Run:
        """Store the counters of a run that is searched and renew its lease; a request to cancel stays."""

        def by(old: Run) -> Run:
            if old.owner != owner:
                raise Taken(f"Run {run.id} went to {old.owner}.")
            until = now() + timedelta(seconds=lease) if run.status == "running" else None
            return replace(run, owner=owner, cancel_requested=old.cancel_requested, lease_until=until)

        return self.change(run.id, by)

    def recover(self) -> list[Run]:
        """Queue again what was running and whose lease has ended, in order of id."""
        ids = [r["id"] for r in self.table().where("status = 'running'").select("id").orderBy("id").collect()]
        back = []
        for i in ids:
            run = self.change(i, lambda r: replace(r, status="queued", owner=None, lease_until=None) if r.status == "running" and (r.lease_until is None or r.lease_until < now()) else r)
            if run.status == "queued":
                back.append(run)
        return back

    def execute(self, run_id: int, districts: DataFrame, pages: DataFrame, path: str, batch: int | None = None, lease: int = LEASE, **options) -> Run:
        """Claim a run and search it batch by batch, on from where it stopped; each batch is kept, a request to cancel is heeded."""
        owner = uuid.uuid4().hex
        run = self.claim(run_id, owner, lease)
        if run.cancel_requested:
            run = replace(run, status="cancelled", finished_at=now(), error_message=run.error_message or NOT_STARTED)
        else:
            run = execute(run, districts, pages, path, batch=batch, cancelled=lambda: self.cancelled(run_id), progress=lambda r: self.keep(r, owner, lease), **options)
        return self.keep(run, owner, lease)

    # ------------------------------------------------------------ as a table
    def table(self) -> DataFrame:
        """The newest version of each run, as rows of RUNS with version, batches and next_batch."""
        shape = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in RUNS)
        shape += ", batches int, next_batch int, version long"
        if self.next_id() == 1:
            return self.spark.createDataFrame([], shape)
        rows = self.spark.read.schema(shape).json(f"{self.path}/run=*/*.json").drop("run")
        newest = rows.groupBy("id").agg(F.max_by(F.struct(*rows.columns), "version").alias("r"))
        return newest.select("r.*")
