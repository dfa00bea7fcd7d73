"""Incremental ingest: diffs of statement sets, sessions over a base, staged removals, and the same as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from axiomill.plans.cut import cut


def diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """``file, fp, change`` with added, removed or unchanged, of two sets (file, fp); repeats fold together."""
    a = old.select("file", "fp").distinct().withColumn("a", F.lit(True))
    b = new.select("file", "fp").distinct().withColumn("b", F.lit(True))
    change = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").otherwise("unchanged")
    return a.join(b, ["file", "fp"], "full").select("file", "fp", change.alias("change"))


class Store:
    """Statements with their scope, and removals that wait for a commit.

    ``rows`` has at least sid, file, fp and scope ('base' or 'session:<name>'). Every change makes a new frame; written
    steps cut the lineage, so a long session stays as fast as a short one.
    """

    def __init__(self, rows: DataFrame):
        self.rows = rows
        self.pending: dict[str, DataFrame] = {}

    def view(self, session: str | None = None) -> DataFrame:
        """The base and one session. Removals staged by the session are out of its own sight only."""
        names = ["base", *([f"session:{session}"] if session else [])]
        seen = self.rows.where(F.col("scope").isin(*names))
        gone = self.pending.get(session or "")
        return seen if gone is None else seen.join(gone, "sid", "left_anti")

    def tell(self, rows: DataFrame, session: str) -> None:
        """Append statements to a session."""
        self.rows = self.rows.unionByName(rows.withColumn("scope", F.lit(f"session:{session}")), allowMissingColumns=True)

    def load(self, file: str, new: DataFrame, session: str | None = None) -> DataFrame:
        """Take in a file's statements: new ones are added, missing ones removed, at once or, in a session, when it
        commits. Gives the changes. Loading the same content again changes nothing."""
        # each session holds its own rows, so that flushing one leaves what another or the base shares
        changes = cut(diff(self.view(session).where(F.col("file") == file), new), "diff").df
        fresh = new.join(changes.where("change = 'added'").select("file", "fp"), ["file", "fp"], "left_semi")
        scope = f"session:{session}" if session else "base"
        gone = self.rows.where(F.col("file") == file).join(changes.where("change = 'removed'").select("file", "fp"), ["file", "fp"], "left_semi").select("sid")
        rows = self.rows.unionByName(fresh.withColumn("scope", F.lit(scope)), allowMissingColumns=True)
        if session:
            held = self.pending.get(session)
            self.pending[session] = gone if held is None else held.union(gone).distinct()
            self.rows = rows
        else:
            self.rows = cut(rows.join(gone, "sid", "left_anti"), "store").df
        return changes

    def commit(self, session: str) -> None:
        """Apply the session's removals and make its statements part of the base."""
        gone = self.pending.pop(session, None)
        rows = self.rows if gone is None else self.rows.join(gone, "sid", "left_anti")
        mine = F.col("scope") == f"session:{session}"
        base = rows.where("scope = 'base'").select("file", "fp")
        same = (F.col("l.fp") == F.col("r.fp")) & F.col("l.file").eqNullSafe(F.col("r.file"))
        fresh = rows.where(mine).alias("l").join(base.alias("r"), same, "left_anti").withColumn("scope", F.lit("base"))
        self.rows = cut(rows.where(~mine).unionByName(fresh), "store").df

    def rollback(self, session: str) -> None:
        """Forget the session's statements and removals."""
        self.pending.pop(session, None)
        self.rows = self.rows.where(F.col("scope") != f"session:{session}")

    def flush(self, session: str) -> None:
        """Drop what a session told; the base's rows and other sessions' rows of the same statements stay."""
        self.rollback(session)

    def promote(self, session: str) -> None:
        """Session statements become axioms; refused while some were told without a file."""
        mine = self.rows.where(F.col("scope") == f"session:{session}")
        if not mine.where("file is null").isEmpty():
            raise ValueError("a session with inline statements cannot be promoted")
        self.commit(session)

    def remove(self, file: str) -> None:
        """Take a file in again as empty."""
        self.rows = self.rows.where(F.col("file").isNull() | (F.col("file") != file))


def taken(spark: SparkSession, path: str) -> DataFrame | None:
    """The statements that streams brought into the table under ``path``, with their ``batch``; None before the first."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        return None
    return spark.read.parquet(path)


def ingest_stream(stream: DataFrame, path: str, checkpoint: str, trigger: dict | None = None):
    """Run a stream of statements (sid, file, fp, scope, ...) into the table under ``path``; returns the query.

    Each micro-batch is one partition of the table, written whole, so that a batch that is run again after a failure
    replaces itself and a stream that is resumed from its ``checkpoint`` finds all that came before. Sids taken in by an
    earlier batch, or twice in one, are taken once; only the earlier sids within the batch's range are read.
    """

    def step(batch: DataFrame, n: int) -> None:
        fresh = batch.where("sid is not null").dropDuplicates(["sid"])
        old = taken(batch.sparkSession, path)
        if old is not None:
            low, high = fresh.agg(F.min("sid"), F.max("sid")).first()
            if low is not None:
                fresh = fresh.join(old.where((F.col("batch") < n) & F.col("sid").between(low, high)).select("sid"), "sid", "left_anti")
        fresh.write.mode("overwrite").parquet(f"{path}/batch={n}")

    w = stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return (w.trigger(**trigger) if trigger else w.trigger(availableNow=True)).start()


def generality_stream(stream: DataFrame, watermark: str = "1 day") -> DataFrame:
    """Running generality of symbols per day of intake, late rows within ``watermark`` included: (day, symbol, occ).

    ``stream`` is (sid, symbol, ingested_at); a statement counts once per symbol within the watermark.
    """
    rows = stream.withWatermark("ingested_at", watermark).dropDuplicatesWithinWatermark(["sid", "symbol"])
    return rows.groupBy(F.window("ingested_at", "1 day").alias("day"), "symbol").agg(F.count("*").alias("occ"))
