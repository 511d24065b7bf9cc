"""Revisioned store: stage, check, commit; snapshots by version; collection of what nobody needs.

A batch of change sets is one partition of each table, ``tables/<name>/batch=b-<batch>``,
never one file a row. A commit of the log names a batch and the table of its revisions,
so a failed or lost run leaves the published state as it was and all tables change at
once. Of a change set's revisions the one with the highest version is active, whatever
the clocks say; a publisher whose change sets were published by another since its
snapshot gets a conflict.

Collection drops revisions by rank and age. Batches without a live revision go as a
whole, the live rows of mostly dead ones are copied into a new batch, and one commit
re-points all of them; files go only later, when readers of older snapshots have ended.
Every row keeps the batch it was published in (``origin``), so a copied revision is the
same one. Such a commit also holds all revisions, so that a reader starts from it.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ids import revision_id
from ..operators import gate, progress
from . import commits
from .commits import Conflict

__all__ = ["Conflict", "Snapshot", "applied", "collect", "pointers", "publish", "publish_batch", "read_table", "remove", "snapshot", "sweep"]

#: Tables of which every change set must have a row.
REQUIRED = ("manifest", "coverage")
#: Commits after which a publisher writes all revisions anew, so that readers open few tables.
STATE_EVERY = 50


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def remove(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def _rename(spark: SparkSession, old: str, new: str) -> None:
    a, b = (spark._jvm.org.apache.hadoop.fs.Path(p) for p in (old, new))
    fs = a.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(b.getParent())
    if not fs.rename(a, b):
        raise OSError(f"cannot move {old} to {new}")


def _folder(root: str, name: str, batch: str) -> str:
    return f"{root}/tables/{name}/batch=b-{batch}"


# --- snapshots -----------------------------------------------------------------------


@dataclass
class Snapshot:
    """The store at one version: how many revisions each batch holds, dead ones included, and the tables of revisions with the version of each."""

    spark: SparkSession
    root: str
    version: int
    sizes: dict[str, int]
    state: str | None
    published: dict[str, tuple[str, int]]  # batch to the table of its revisions and its version

    def revisions(self) -> DataFrame | None:
        """Every revision (pr, origin, batch, version, ...) that is not collected."""
        parts = []
        if self.state:
            parts.append(self.spark.read.parquet(self.state))
        if self.published:
            version = F.create_map(*(F.lit(x) for batch, (_, v) in self.published.items() for x in (batch, v)))
            rows = self.spark.read.parquet(*(path for path, _ in self.published.values()))
            parts.append(rows.withColumn("version", F.element_at(version, F.col("origin")).cast("long")))
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts) if parts else None

    def pointers(self) -> DataFrame | None:
        """The active revision of each change set."""
        d = self.revisions()
        if d is None:
            return None
        rest = [c for c in d.columns if c != "pr"]
        return d.groupBy("pr").agg(F.max_by(F.struct(*rest), "version").alias("x")).select("pr", "x.*")

    def rows(self, name: str, batches: list[str] | None = None) -> DataFrame | None:
        """All rows of a table in this version's batches; no other folder is opened or listed."""
        paths = [_folder(self.root, name, b) for b in (self.sizes if batches is None else batches)]
        paths = [p for p in paths if _exists(self.spark, p)]
        return self.spark.read.option("basePath", f"{self.root}/tables/{name}").parquet(*paths) if paths else None

    def table(self, name: str) -> DataFrame | None:
        """Rows of a table that belong to the active revision of their change set: one scan, whose batches the join prunes further."""
        active, whole = self.pointers(), self.rows(name)
        if active is None or whole is None:
            return None
        return whole.join(active.select("pr", "origin", F.concat(F.lit("b-"), "batch").alias("batch")), ["pr", "origin", "batch"], "left_semi").drop("batch", "origin")


def snapshot(spark: SparkSession, root: str, version: int | None = None) -> Snapshot:
    """The store at ``version``, or the last one; an older one can be read until its files are swept."""
    known = commits.since(spark, root, 0, version)
    last = max([0, *(c["version"] for c in known)])
    base = next((c for c in reversed(known) if c["kind"] == "state"), None)
    sizes, as_of = (dict(base["sizes"]), base["as_of"]) if base else ({}, 0)
    later = [c for c in known if c["kind"] == "publish" and c["version"] > as_of]
    sizes |= {c["batch"]: c["revisions"] for c in later}
    return Snapshot(spark, root, last, sizes, f"{root}/{base['state']}" if base else None, {c["batch"]: (f"{root}/{c['rows']}", c["version"]) for c in later})


def pointers(spark: SparkSession, root: str, version: int | None = None) -> DataFrame | None:
    """The active revision of each change set at a version."""
    return snapshot(spark, root, version).pointers()


def read_table(spark: SparkSession, root: str, name: str, version: int | None = None) -> DataFrame | None:
    """Rows of a table that belong to the active revision of their change set at a version."""
    return snapshot(spark, root, version).table(name)


# --- publication ---------------------------------------------------------------------


def _clean(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        remove(spark, path)


def applied(spark: SparkSession, root: str, token: str, upto: int | None = None) -> bool:
    """Whether a batch of this token is committed, at a version or now."""
    return any(c.get("token") == token for c in commits.since(spark, root, 0, upto))


def publish_batch(root: str, tables: dict[str, DataFrame], revisions: DataFrame, batch: str | None = None, base: int | None = None, check=None, token: str | None = None) -> str:
    """Write ``tables`` (each with pr) and ``revisions`` (pr, generated_at, ...) as one batch and commit it; returns its name.

    ``base`` is the version the batch was made from, by default the last one now.
    ``check`` gets the staged tables and raises if they are not to be published. A batch
    that shares a change set with one committed after ``base`` raises Conflict, and so
    does one whose ``token`` is committed already; on any error nothing of it stays.
    """
    spark = revisions.sparkSession
    batch = batch or uuid.uuid4().hex
    base = commits.latest(spark, root) if base is None else base
    staging, rows = f"{root}/.tmp-{batch}", f"revisions/{batch}"
    made = [staging]
    try:
        for name, d in tables.items():
            d.withColumn("origin", F.lit(batch)).write.mode("overwrite").parquet(f"{staging}/{name}")
        if check is not None:
            check({name: spark.read.parquet(f"{staging}/{name}") for name in tables})
        for name in tables:
            if _exists(spark, _folder(root, name, batch)):
                raise Conflict(f"batch {batch} is there already")
            _rename(spark, f"{staging}/{name}", _folder(root, name, batch))
            made.append(_folder(root, name, batch))
        revisions.select("*", F.lit(batch).alias("origin"), F.lit(batch).alias("batch")).write.mode("errorifexists").parquet(f"{root}/{rows}")
        made.append(f"{root}/{rows}")
        own = spark.read.parquet(f"{root}/{rows}")

        def conflicts(news: list[dict]) -> None:
            if token is not None and any(c.get("token") == token for c in news):
                raise Conflict(f"{token} is committed already")
            others = [f"{root}/{c['rows']}" for c in news if c["kind"] == "publish"]
            if others:
                both = spark.read.parquet(*others).select("pr").join(own.select("pr"), "pr", "left_semi").limit(5).collect()
                if both:
                    raise Conflict("published by another since version %d: %s" % (base, ", ".join(str(r["pr"]) for r in both)))

        if token is not None and applied(spark, root, token, base):
            raise Conflict(f"{token} is committed already")
        record = {"kind": "publish", "batch": batch, "rows": rows, "revisions": own.count()} | ({} if token is None else {"token": token})
        version = commits.commit(spark, root, record, base, conflicts)
    except BaseException:
        _clean(spark, made)
        raise
    remove(spark, staging)
    if version % STATE_EVERY == 0:
        try:
            _commit_state(snapshot(spark, root, version))
        except Conflict:
            pass  # another wrote one
    return batch


def publish(root: str, tables: dict[str, DataFrame], rolled: DataFrame, details: DataFrame, generated_at, batch: str | None = None, base: int | None = None, token: str | None = None) -> str:
    """Publish one batch of revisions; raise and leave everything as it was if the gate finds errors or another got there first.

    ``rolled`` and ``details`` (pr, ref, patch_ref, folder) feed the gate. Returns the batch's name.
    """

    def check(read: dict[str, DataFrame]) -> None:
        patches = read["patches"].select("pr", F.concat(F.lit("files/"), F.col("file_id"), F.lit("/patch.diff")).alias("ref"))
        gate.require_valid(gate.violations(rolled, read["files_index"], details, patches, read.get("coverage"), {n: read[n] for n in REQUIRED if n in read}))

    manifest = tables["manifest"]
    commits_of = manifest.select("pr", revision_id(F.col("source_commit"), F.col("target_commit")).alias("active_revision"), "source_commit", "target_commit", F.col("source_commit").alias("source_hash"), F.col("target_commit").alias("destination_hash"), generated_at.alias("generated_at"))
    return publish_batch(root, tables, commits_of, batch, base, check, token)


# --- collection ----------------------------------------------------------------------


def _commit_state(at: Snapshot, kept: DataFrame | None = None, sizes: dict[str, int] | None = None, removed: list[str] = (), now: float = 0.0) -> int:
    """Commits all revisions as one table; raises Conflict if another such commit came since ``at``."""
    state = f"states/{uuid.uuid4().hex}"
    (at.revisions() if kept is None else kept).write.parquet(f"{at.root}/{state}")

    def conflicts(news: list[dict]) -> None:
        if any(c["kind"] == "state" for c in news):
            raise Conflict(f"collected by another since version {at.version}")

    record = {"kind": "state", "as_of": at.version, "state": state, "sizes": at.sizes if sizes is None else sizes, "removed": list(removed), "at": now}
    try:
        return commits.commit(at.spark, at.root, record, at.version, conflicts)
    except BaseException:
        remove(at.spark, f"{at.root}/{state}")
        raise


def collect(spark: SparkSession, root: str, now: Column, keep: int = 3, days: int = 30, least_live: float = 0.5, batch: str | None = None) -> dict:
    """Drop revisions of rank ``keep`` or later, or older than ``days``, and re-point; active ones always stay.

    Batches without a live revision are removed; those of whose revisions less than
    ``least_live`` live give their live rows to a new batch and are removed too. Returns
    {"version", "removed", "copied": batches copied from, "batch": the new one or None}.
    Readers see either the state before or after; files stay until ``sweep``. Raises
    Conflict, and leaves everything as it was, if another collection came first;
    publishers are never in its way. An empty store stays as it is.
    """
    at = snapshot(spark, root)
    revisions = at.revisions()
    if revisions is None:
        return {"version": at.version, "removed": [], "copied": [], "batch": None}
    batch = batch or uuid.uuid4().hex
    staging = f"{root}/.tmp-{batch}"
    made = [staging]
    try:
        active = at.pointers().select("pr", "version", F.lit(True).alias("is_active"))
        marked = revisions.join(active, ["pr", "version"], "left").withColumn("is_active", F.coalesce("is_active", F.lit(False)))
        seen = marked.withColumns({"revision": F.col("origin"), "mtime": F.col("generated_at").cast("timestamp")})
        gone = progress.retention_victims(seen, now, keep, days).select("pr", "version")
        revisions.join(gone, ["pr", "version"], "left_anti").write.parquet(f"{staging}/kept")
        kept = spark.read.schema(revisions.schema).parquet(f"{staging}/kept")
        live = {r["batch"]: r["n"] for r in kept.groupBy("batch").agg(F.count("*").alias("n")).collect()}  # one row a batch
        copied = sorted(b for b, n in at.sizes.items() if 0 < live.get(b, 0) < least_live * n)
        removed = sorted(b for b in at.sizes if b not in live) + copied
        sizes = {b: n for b, n in at.sizes.items() if b not in removed}
        if copied:
            moved = kept.where(F.col("batch").isin(copied)).select("pr", "origin", F.concat(F.lit("b-"), "batch").alias("batch"))
            for name in commits.names(spark, f"{root}/tables"):
                rows = at.rows(name, copied)
                if rows is not None:
                    rows.join(moved, ["pr", "origin", "batch"], "left_semi").drop("batch").write.parquet(f"{staging}/{name}")
                    _rename(spark, f"{staging}/{name}", _folder(root, name, batch))
                    made.append(_folder(root, name, batch))
            sizes[batch] = sum(live[b] for b in copied)
            kept = kept.withColumn("batch", F.when(F.col("batch").isin(copied), F.lit(batch)).otherwise(F.col("batch")))
        stamp = spark.range(1).select(F.unix_timestamp(now.cast("timestamp"))).first()[0]
        version = _commit_state(at, kept, sizes, removed, stamp)
    except BaseException:
        _clean(spark, made)
        raise
    remove(spark, staging)
    return {"version": version, "removed": removed, "copied": copied, "batch": batch if copied else None}


def sweep(spark: SparkSession, root: str, now: Column, grace_days: float = 1.0) -> list[str]:
    """Delete the files of batches that collections removed at least ``grace_days`` ago; versions before them can no longer be read whole. Returns the batches."""
    stamp = spark.range(1).select(F.unix_timestamp(now.cast("timestamp"))).first()[0]
    alive = snapshot(spark, root).sizes
    gone = [b for c in commits.since(spark, root, 0) if c["kind"] == "state" and c["at"] <= stamp - 86400 * grace_days for b in c["removed"] if b not in alive]
    tables = commits.names(spark, f"{root}/tables")
    swept = []
    for b in gone:
        paths = [p for p in (_folder(root, name, b) for name in tables) if _exists(spark, p)]
        _clean(spark, paths)
        if paths:
            swept.append(b)
    return swept


# --- other sinks ---------------------------------------------------------------------


def export_json(d: DataFrame, path: str, folders: int = 64) -> None:
    """JSON lines in ``folders`` folders, dealt by a hash of the change set, so a row never gets a file of its own."""
    dealt = d.withColumn("bucket", F.pmod(F.xxhash64("pr"), F.lit(folders)))
    dealt.repartition(folders, "bucket").write.mode("overwrite").partitionBy("bucket").json(path)


def write_raw(raw: DataFrame, root: str, batch: str) -> None:
    """The provider's answers of a batch as they came."""
    raw.write.mode("overwrite").parquet(f"{root}/raw/{batch}")


def write_payloads(payloads: DataFrame, root: str, stamp: str) -> str:
    """JSON payloads (pr, payload) of one run under a name with its time."""
    path = f"{root}/payloads/payload_{stamp}"
    payloads.select("payload").write.mode("errorifexists").text(path)
    return path


def write_summary(summary: DataFrame, root: str, run: str) -> None:
    """A run's summary, redacted, appended to all summaries; the latest is the last by ``finished_at``."""
    from ..functions.sanitize import redact_columns

    redact_columns(summary).withColumn("run", F.lit(run)).write.mode("append").json(f"{root}/summaries")


def append_log(d: DataFrame, path: str) -> None:
    """Redacted log lines appended as JSON."""
    from ..functions.sanitize import redact_columns

    redact_columns(d).write.mode("append").json(path)


def store_path(root: str, workspace: str, repo: str, pr, company: str | None = None) -> str:
    return "/".join([root, *([company] if company else []), workspace, repo, f"pr_{pr}"])


def first_existing(spark: SparkSession, candidates: list[str]) -> str | None:
    """The first path that is there: with company, without, default root."""
    return next((p for p in candidates if p and _exists(spark, p)), None)
