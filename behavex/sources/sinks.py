"""Sinks. Plain tables have no MERGE, so the keyed sinks read, merge and publish a new version of a
table; a batch id makes each of them idempotent under replay."""

from __future__ import annotations

import datetime
import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from behavex.sources.files import Folder


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


class AuditError(ValueError):
    """Rows that must not be published."""


def audited(df: DataFrame, checks: dict[str, str]) -> None:
    """Raises if rows break a rule; checks are aggregates in SQL that have to be true, by the rule's name. One pass."""
    if checks:
        found = df.agg(*(F.coalesce(F.expr(rule), F.lit(False)).alias(name) for name, rule in checks.items())).first().asDict()
        if broken := sorted(n for n, ok in found.items() if not ok):
            raise AuditError(f"not published, broken rules: {', '.join(broken)}")


def publish_task(df: DataFrame, path: str, task_id: int, checks: dict[str, str] | None = None) -> None:
    """A task's rows as its part of a Parquet table: written aside, audited as written, then put in the place of
    what an earlier run of the task has left. Readers of the folder see whole runs only, and a run that fails leaves the rows that were there."""
    spark = df.sparkSession
    aside, name = f"_run-{uuid.uuid4().hex}", f"task_id={int(task_id)}"
    folder = Folder(spark, path)
    try:
        df.write.parquet(f"{path}/{aside}")  # with task_id, so that it keeps its place among the columns
        audited(spark.read.schema(df.schema).parquet(f"{path}/{aside}"), checks or {})
        folder.delete(name)
        folder.move(aside, name)
    finally:
        folder.delete(aside)


def to_jdbc(df: DataFrame, url: str, table: str, mode: str = "append", batch: int = 1000, **options: str) -> None:
    """One transaction for each partition, in batches."""
    df.write.format("jdbc").options(url=url, dbtable=table, batchsize=batch, **options).mode(mode).save()


def merge_add(old: DataFrame, new: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Upsert-add: values of equal keys are summed."""
    return old.select(*keys, value).unionByName(new.select(*keys, value)).groupBy(*keys).agg(F.sum(value).alias(value))


def merge_replace(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Upsert-replace: rows of new stand for rows of old with equal keys."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def replace_groups(old: DataFrame, new: DataFrame, group: list[str]) -> DataFrame:
    """Delete by group, then insert: all old rows of a group that new has go."""
    return old.join(new.select(*group).distinct(), group, "left_anti").unionByName(new)


class VersionedTable:
    """A Parquet table in versions: a batch's rows are written to a folder of their own, and a marker file `v<batch>`, which can
    be created once only, names that folder. A replayed batch changes nothing, of two writers of one batch
    one wins, and readers never see half of a version."""

    def __init__(self, spark: SparkSession, path: str, schema: str, keep: int = 2):
        self.spark, self.path, self.schema, self.keep = spark, path.rstrip("/"), schema, keep
        self._markers = Folder(spark, f"{self.path}/versions")

    def _versions(self) -> list[int]:
        return sorted(int(n[1:]) for n in self._markers.names())

    def read(self, before: int | None = None) -> DataFrame:
        have = [v for v in self._versions() if before is None or v < before]
        if not have:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/{self._markers.read(f'v{have[-1]}')}")

    def publish(self, df: DataFrame, batch: int) -> bool:
        """Makes df the version of a batch; False if the batch was there. Versions but the last few go."""
        if batch in self._versions():
            return False
        folder = f"rows-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.path}/{folder}")
        done = self._markers.create_once(f"v{batch}", folder)
        table = Folder(self.spark, self.path)
        if not done:
            table.delete(folder)
        for v in self._versions()[: -self.keep]:
            old = self._markers.read(f"v{v}")
            self._markers.delete(f"v{v}")
            table.delete(old)
        return done


class DatedTable:
    """A Parquet table in versions, in parts by its column `date` (text as yyyy-MM-dd): a batch writes the dates that it touches, and
    its marker file says where each date's rows are, so that a batch costs what it touches and not the table. Dates before
    the `days` last ones leave the newer versions if days is given. Replays and readers are as with VersionedTable."""

    def __init__(self, spark: SparkSession, path: str, schema: str, keep: int = 2, days: int | None = None):
        self.spark, self.path, self.schema, self.keep, self.days = spark, path.rstrip("/"), schema, keep, days
        self._markers, self._folder = Folder(spark, f"{self.path}/versions"), Folder(spark, self.path)

    def _versions(self) -> list[int]:
        return sorted(int(n[1:]) for n in self._markers.names())

    def _parts(self, before: int | None) -> dict[str, str]:
        have = [v for v in self._versions() if before is None or v < before]
        return json.loads(self._markers.read(f"v{have[-1]}")) if have else {}

    def read(self, before: int | None = None, dates: list[str] | None = None) -> DataFrame:
        paths = [f"{self.path}/{p}" for d, p in self._parts(before).items() if dates is None or d in dates]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*paths)

    def publish(self, df: DataFrame, batch: int, dates: list[str]) -> bool:
        """Makes df all rows of these dates, from this batch's version on; False if the batch was there."""
        if batch in self._versions():
            return False
        folder, old = f"rows-{uuid.uuid4().hex}", self._parts(batch)
        df.where(F.col("date").isin(dates)).withColumn("part", F.col("date")).repartition("part").write.partitionBy("part").parquet(f"{self.path}/{folder}")
        parts = self._folder.names(folder)
        now = {d: p for d, p in old.items() if d not in dates} | {d: f"{folder}/part={d}" for d in dates if f"part={d}" in parts}
        if self.days is not None and now:
            last = max(datetime.date.fromisoformat(d) for d in now)
            now = {d: p for d, p in now.items() if (last - datetime.date.fromisoformat(d)).days < self.days}
        done = self._markers.create_once(f"v{batch}", json.dumps(now))
        if not done:
            self._folder.delete(folder)
        gone, kept = self._versions()[: -self.keep], self._versions()[-self.keep :]
        used = {p for v in kept for p in json.loads(self._markers.read(f"v{v}")).values()}
        for v in gone:
            for p in set(json.loads(self._markers.read(f"v{v}")).values()) - used:
                self._folder.delete(p)
            self._markers.delete(f"v{v}")
        return done


class ChangeTable:
    """A Parquet table that is the sum of its batches' changes: a batch writes its own rows only, and its marker file says which folders the
    table is made of. how = "sum" adds the values of equal keys; "latest" lets the newest batch that has a key stand for it, with all
    its rows, and a value of 0 takes the key away. After `fold` batches the changes are folded into one folder. Replays and readers are as with VersionedTable."""

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: list[str], how: str = "sum", value: str | None = "click_count", fold: int = 64, keep: int = 2):
        self.spark, self.path, self.schema, self.keys, self.how, self.value, self.fold, self.keep = spark, path.rstrip("/"), schema, keys, how, value, fold, keep
        self._markers, self._folder = Folder(spark, f"{self.path}/versions"), Folder(spark, self.path)

    def _versions(self) -> list[int]:
        return sorted(int(n[1:]) for n in self._markers.names())

    def _folders(self, version: int) -> list[str]:
        return json.loads(self._markers.read(f"v{version}"))

    def _merged(self, folders: list[str]) -> DataFrame:
        parts = [f"{self.path}/{f}" for f in folders]
        rows = self.spark.read.schema(f"{self.schema}, batch bigint").parquet(*parts) if parts else self.spark.createDataFrame([], f"{self.schema}, batch bigint")
        if self.how == "sum":
            rows = rows.groupBy(*self.keys).agg(F.sum(self.value).alias(self.value), F.max("batch").alias("batch"))
        else:
            newest = F.max("batch").over(W.partitionBy(*self.keys))
            rows = rows.withColumn("newest", newest).where("batch = newest").drop("newest")
        return rows

    def read(self, before: int | None = None) -> DataFrame:
        have = [v for v in self._versions() if before is None or v < before]
        rows = self._merged(self._folders(have[-1]) if have else [])
        rows = rows.where(F.col(self.value) != 0) if self.value and self.how == "latest" else rows
        return rows.select(*(c.split()[0] for c in self.schema.split(", ")))

    def publish(self, df: DataFrame, batch: int) -> bool:
        """Adds a batch's rows; False if the batch was there."""
        have = self._versions()
        if batch in have:
            return False
        old, folder = self._folders(have[-1]) if have else [], f"rows-{uuid.uuid4().hex}"
        df.select(*(c.split()[0] for c in self.schema.split(", ")), F.lit(batch).cast("bigint").alias("batch")).write.parquet(f"{self.path}/{folder}")
        made, now = [folder], [*old, folder]
        if len(now) > self.fold:
            base = f"rows-{uuid.uuid4().hex}"
            self._merged(now).select(*(c.split()[0] for c in self.schema.split(", ")), "batch").write.parquet(f"{self.path}/{base}")
            made, now = [folder, base], [base]
        done = self._markers.create_once(f"v{batch}", json.dumps(now))
        for f in made if not done else [f for f in made if f not in now]:
            self._folder.delete(f)
        gone, kept = self._versions()[: -self.keep], self._versions()[-self.keep :]
        used = {f for v in kept for f in self._folders(v)}
        for v in gone:
            for f in set(self._folders(v)) - used:
                self._folder.delete(f)
            self._markers.delete(f"v{v}")
        return done


class Database:
    """Keyed tables of a database. A batch is loaded into a staging table by Spark, in parallel; one transaction then merges the staging table
    into the target and notes the batch in a ledger. A batch that is replayed, or that died between the two steps, has its rows once.

    how: "add" sums values of equal keys, "replace" lets new values stand, "groups" deletes all rows of a group that the batch has before
    it inserts, "absent" inserts what is not there; a value of 0 under "replace" takes the row away."""

    def __init__(self, spark: SparkSession, url: str, driver: str | None = None, **options: str):
        self.spark, self.url, self.options = spark, url, {k: v for k, v in options.items() if v is not None}
        if driver:
            self.options["driver"] = driver
        self._mark = "`" if url.startswith("jdbc:mysql") else '"'

    def _q(self, name: str) -> str:
        return f"{self._mark}{name}{self._mark}"

    def _connection(self):
        jvm = self.spark._jvm
        if "driver" in self.options:
            jvm.java.lang.Class.forName(self.options["driver"]).newInstance()
        user = self.options.get("user")
        return jvm.java.sql.DriverManager.getConnection(self.url, user, self.options.get("password")) if user else jvm.java.sql.DriverManager.getConnection(self.url)

    def execute(self, *statements: str) -> list[int]:
        """Runs statements in one transaction; the rows that each changed."""
        connection = self._connection()
        try:
            connection.setAutoCommit(False)
            statement = connection.createStatement()
            try:
                out = [statement.executeUpdate(s) for s in statements]
                connection.commit()
                return out
            except Exception:
                connection.rollback()
                raise
            finally:
                statement.close()
        finally:
            connection.close()

    def _exists(self, table: str) -> bool:
        connection = self._connection()
        try:
            names = [n for n in (table, table.upper(), table.lower()) for r in [connection.getMetaData().getTables(None, None, n, None)] if r.next()]
            return bool(names)
        finally:
            connection.close()

    def ensure(self, table: str, columns: dict[str, str], keys: list[str] | None = None) -> None:
        """Makes the table, its staging table and the ledger where they are missing; columns with the database's types."""
        body = ", ".join(f"{self._q(c)} {t}{' NOT NULL' if c in (keys or ()) else ''}" for c, t in columns.items())
        key = f", PRIMARY KEY ({', '.join(map(self._q, keys))})" if keys else ""
        for name, text in ((table, body + key), (f"{table}_stage", body), ("batch_ledger", f"{self._q('stream')} VARCHAR(128) NOT NULL, {self._q('batch')} BIGINT NOT NULL, PRIMARY KEY ({self._q('stream')}, {self._q('batch')})")):
            if not self._exists(name):
                self.execute(f"CREATE TABLE {name} ({text})")

    def committed(self, stream: str, batch: int) -> bool:
        connection = self._connection()
        try:
            found = connection.createStatement().executeQuery(f"SELECT COUNT(*) FROM batch_ledger WHERE {self._q('stream')} = '{stream}' AND {self._q('batch')} = {int(batch)}")
            found.next()
            return found.getInt(1) > 0
        finally:
            connection.close()

    def read(self, table: str) -> DataFrame:
        return self.spark.read.format("jdbc").options(url=self.url, dbtable=table, **self.options).load()

    def stage(self, df: DataFrame, table: str) -> None:
        """Loads the staging table anew, whatever an earlier try has left in it."""
        self.execute(f"DELETE FROM {table}_stage")
        to_jdbc(df, self.url, f"{table}_stage", **self.options)

    def merge(self, table: str, columns: list[str], keys: list[str], how: str, stream: str, batch: int) -> bool:
        """Merges the staging table and notes the batch, both or neither; False if the ledger has the batch."""
        if self.committed(stream, batch):
            return False
        q, rest = self._q, [c for c in columns if c not in keys]
        names, stage = ", ".join(map(q, columns)), f"{table}_stage"
        same = " AND ".join(f"t.{q(k)} = s.{q(k)}" for k in keys)
        if how == "groups":
            body = [f"DELETE FROM {table} WHERE EXISTS (SELECT 1 FROM {stage} s WHERE " + " AND ".join(f"{table}.{q(k)} = s.{q(k)}" for k in keys) + ")", f"INSERT INTO {table} ({names}) SELECT {names} FROM {stage}"]
        elif self._mark == "`":  # this database has another form of MERGE
            change = ", ".join(f"{q(c)} = {q(c) + ' + ' if how == 'add' else ''}VALUES({q(c)})" for c in rest) if how != "absent" else f"{q(keys[0])} = {q(keys[0])}"
            body = [f"INSERT INTO {table} ({names}) SELECT {names} FROM {stage} ON DUPLICATE KEY UPDATE {change}"]
        else:
            change = ", ".join(f"t.{q(c)} = {f't.{q(c)} + ' if how == 'add' else ''}s.{q(c)}" for c in rest)
            matched = f"WHEN MATCHED THEN UPDATE SET {change} " if how != "absent" else ""
            body = [f"MERGE INTO {table} t USING {stage} s ON {same} {matched}WHEN NOT MATCHED THEN INSERT ({names}) VALUES ({', '.join(f's.{q(c)}' for c in columns)})"]
        if how == "replace" and rest:
            body.append(f"DELETE FROM {table} WHERE {q(rest[-1])} = 0")
        self.execute(f"INSERT INTO batch_ledger ({q('stream')}, {q('batch')}) VALUES ('{stream}', {int(batch)})", *body)
        return True

    def publish_task(self, df: DataFrame, table: str, task_id: int, checks: dict[str, str] | None = None, text: str = "VARCHAR(4000)") -> None:
        """A task's rows as its part of a table: loaded into a staging table, audited there, and put in the place of what an earlier
        run of the task has left, in one transaction."""
        types = {"string": text, "int": "INT", "bigint": "BIGINT", "double": "DOUBLE PRECISION", "boolean": "BOOLEAN"}
        self.ensure(table, {f.name: types[f.dataType.simpleString()] for f in df.schema})
        self.stage(df, table)
        audited(self.read(f"{table}_stage"), checks or {})
        names = ", ".join(map(self._q, df.columns))
        self.execute(f"DELETE FROM {table} WHERE {self._q('task_id')} = {int(task_id)}", f"INSERT INTO {table} ({names}) SELECT {names} FROM {table}_stage")

    def apply(self, df: DataFrame, table: str, keys: list[str], how: str, stream: str, batch: int) -> bool:
        """One batch into one table; df's rows have distinct keys (groups: distinct rows)."""
        if self.committed(stream, batch):
            return False
        self.stage(df, table)
        return self.merge(table, df.columns, keys, how, stream, batch)
