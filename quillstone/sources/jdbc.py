"""A store in a relational database over Spark's JDBC source: partitioned reads with filters pushed down, and upserts by a staging table in one transaction."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession

NAME = re.compile(r"[A-Za-z_]\w*")


class JdbcStore:
    """Tables at a JDBC url; properties: user, password, driver and others that Spark takes."""

    def __init__(self, spark: SparkSession, url: str, properties: dict[str, str] | None = None):
        self.spark, self.url, self.properties = spark, url, dict(properties or {})

    def _named(self, *names: str) -> None:
        for n in names:
            if not NAME.fullmatch(n):
                raise ValueError(f"no name of a table or column: {n!r}")

    def _q(self, name: str) -> str:
        """A column's name as Spark writes it for this database."""
        return self.spark._jvm.org.apache.spark.sql.jdbc.JdbcDialects.get(self.url).quoteIdentifier(name)

    def _run(self, *statements: str) -> None:
        """Statements at the database as one transaction."""
        jvm = self.spark._jvm
        p = jvm.java.util.Properties()
        for k, v in self.properties.items():
            p.setProperty(k, v)
        if "driver" in self.properties:
            jvm.java.lang.Class.forName(self.properties["driver"], True, jvm.java.lang.Thread.currentThread().getContextClassLoader())
        c = jvm.java.sql.DriverManager.getConnection(self.url, p)
        try:
            c.setAutoCommit(False)
            s = c.createStatement()
            for text in statements:
                s.executeUpdate(text)
            c.commit()
        except Exception:
            c.rollback()
            raise
        finally:
            c.close()

    def _reader(self):
        r = self.spark.read.format("jdbc").option("url", self.url)
        for k, v in self.properties.items():
            r = r.option(k, v)
        return r

    def read(self, table: str, column: str | None = None, partitions: int = 8) -> DataFrame:
        """A table; with a column of numbers or times in as many parts, each a query of its own between bounds that the database gives."""
        self._named(table)
        if column is None:
            return self._reader().option("dbtable", table).load()
        self._named(column)
        low, high = self._reader().option("query", f"select min({self._q(column)}) as lo, max({self._q(column)}) as hi from {table}").load().first()
        if low is None:
            return self._reader().option("dbtable", table).load()
        r = self._reader().option("dbtable", table).option("partitionColumn", column).option("lowerBound", str(low)).option("upperBound", str(high))
        return r.option("numPartitions", partitions).load()

    def create(self, table: str, rows: DataFrame) -> None:
        """A new table with rows, whatever was there."""
        self._named(table)
        rows.write.jdbc(self.url, table, mode="overwrite", properties=self.properties)

    def upsert(self, table: str, rows: DataFrame, key: list[str], partitions: int = 8) -> None:
        """rows in place of those with their key. They are written beside the table first, by all tasks, so that a lost task is written again; then one transaction takes them over: readers see all or none.

        Of rows that share a key any one must do for the caller: give each key once. Null keys are an error.
        """
        self._named(table, *key, *rows.columns)
        staging = f"{table}_s{uuid.uuid4().hex[:12]}"
        rows.coalesce(partitions).write.jdbc(self.url, staging, mode="overwrite", properties=self.properties)
        quoted, some = ", ".join(map(self._q, rows.columns)), " or ".join(f"{self._q(c)} is null" for c in key)
        same = " and ".join(f"s.{self._q(c)} = {table}.{self._q(c)}" for c in key)
        try:
            if self._reader().option("query", f"select count(*) as n from {staging} where {some}").load().first()[0]:
                raise ValueError("rows without a key")
            self._run(f"delete from {table} where exists (select 1 from {staging} s where {same})", f"insert into {table} ({quoted}) select {quoted} from {staging}")
        finally:
            self._run(f"drop table {staging}")

    def delete(self, table: str, keys: DataFrame) -> None:
        """Rows whose key, in the columns of keys, is among them go."""
        self._named(table, *keys.columns)
        staging = f"{table}_d{uuid.uuid4().hex[:12]}"
        keys.write.jdbc(self.url, staging, mode="overwrite", properties=self.properties)
        same = " and ".join(f"s.{self._q(c)} = {table}.{self._q(c)}" for c in keys.columns)
        self._run(f"delete from {table} where exists (select 1 from {staging} s where {same})", f"drop table {staging}")
