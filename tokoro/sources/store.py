"""The built tables as Parquet under one folder, with counts, meta data and the ledger."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokoro import schema
from tokoro.operators.index import Index
from tokoro.storage import stored

VERSION = "2"
SCHEMAS = {
    "meta": schema.META, "source": schema.LEDGER, "pref": schema.PREF_TABLE, "city": schema.CITY_TABLE, "machiaza": schema.TOWN_TABLE,
    "machiaza_head": schema.HEAD_TABLE, "machiaza_key": schema.KEY_TABLE, "banchi": schema.NUMBER_TABLE,
}
#: Files of a municipality's numbers: towns are dealt to so many, so that a large one is no single task.
SPLITS = 8
#: Row groups are small, so that a look-up of one town reads little of a large file.
GROUP_BYTES = 1 << 20
MANIFEST = "lg_code int, version string"


class Store:
    """Tables under a folder. A table is replaced by writing it beside the old one and then
    renaming a small pointer file onto the old pointer: a lost job leaves the old table in
    place, and readers of the old one can finish, as it goes with the next replacement.

    Numbers are too many to be written anew whenever a municipality's change. Their pointer
    names a manifest, a list of which version each municipality's folder is of; only the
    municipalities that get rows have new folders, and all of them count from the moment
    that the pointer names the next manifest."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark._jvm
        self.hadoop = jvm.org.apache.hadoop.fs
        self.fs = self.hadoop.Path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def _exists(self, path: str) -> bool:
        return self.fs.exists(self.hadoop.Path(path))

    def _named(self, table: str) -> str | None:
        """What the table's pointer names."""
        pointer = f"{self.path(table)}/current"
        if not self._exists(pointer):
            return None
        stream = self.fs.open(self.hadoop.Path(pointer))
        try:
            return stream.readUTF()
        finally:
            stream.close()

    def _switch(self, table: str, name: str) -> None:
        """Let the pointer name something else, at once."""
        top, made = self.hadoop.Path(self.path(table)), f"{self.path(table)}/{name}.pointer"
        stream = self.fs.create(self.hadoop.Path(made), True)
        stream.writeUTF(name)
        stream.close()
        overwrite = self.spark.sparkContext._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        overwrite[0] = self.spark._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context = self.hadoop.FileContext.getFileContext(top.toUri() if top.toUri().getScheme() else self.fs.getUri(), self.spark._jsc.hadoopConfiguration())
        context.rename(self.hadoop.Path(made), self.hadoop.Path(f"{self.path(table)}/current"), overwrite)

    def _forget(self, table: str, kept: set[str]) -> None:
        """Delete the versions of a table but those that it and its last readers use."""
        for found in self.fs.listStatus(self.hadoop.Path(self.path(table))):
            old = found.getPath()
            if old.getName() not in kept and old.getName().startswith(("v-", "m-", "version=")):
                self.fs.delete(old, True)

    def current(self, table: str) -> str | None:
        """The folder that holds a table now; None if it was never written."""
        name = self._named(table)
        return name if name is None else f"{self.path(table)}/{name}"

    def versions(self, manifest: str | None) -> dict[int, str]:
        """The version of each municipality's numbers: as many entries as municipalities."""
        if manifest is None:
            return {}
        rows = self.spark.read.schema(MANIFEST).parquet(f"{self.path('banchi')}/{manifest}").collect()
        return {r["lg_code"]: r["version"] for r in rows}

    def read(self, table: str) -> DataFrame:
        """A table; empty if it was never written."""
        at = self.current(table)
        if at is None:
            return self.spark.createDataFrame([], SCHEMAS[table])
        if table != "banchi":
            return self.spark.read.schema(SCHEMAS[table]).parquet(at)
        top = self.path(table)
        folders = [f"{top}/version={v}/lg_code={code}" for code, v in sorted(self.versions(self._named(table)).items())]
        names = [c.split()[0] for c in SCHEMAS[table].split(", ")]
        return self.spark.read.schema(f"{SCHEMAS[table]}, version string").option("basePath", top).parquet(*folders).select(*names)

    def replace(self, table: str, rows: DataFrame) -> None:
        """Write beside, then switch. Rows may come from the table itself."""
        names = [c.strip().split()[0] for c in SCHEMAS[table].split(", ")]
        before, name = self._named(table), f"v-{uuid.uuid4().hex}"
        rows.select(*names).write.parquet(f"{self.path(table)}/{name}")
        self._switch(table, name)
        self._forget(table, {name, before or ""})

    def upsert(self, table: str, rows: DataFrame, key: list[str]) -> None:
        self.replace(table, self.read(table).join(rows.select(*key).distinct(), key, "left_anti").unionByName(rows))

    def put_numbers(self, rows: DataFrame) -> None:
        """The lists of the towns and kinds among the rows replace those held, all at once.
        Numbers lie in one folder for each municipality and version, sorted so that row
        groups are pruned by town and first number; only the municipalities that get rows are
        written anew. Folders that neither this nor the last state uses are deleted."""
        new, version, before = stored(rows), uuid.uuid4().hex, self._named("banchi")
        codes = [r["lg_code"] for r in new.select("lg_code").distinct().collect()]  # municipalities
        if not codes:
            return
        now = self.versions(before)
        held = self.read("banchi").join(new.select("lg_code").distinct(), "lg_code", "left_semi")
        rest = held.join(new.select("lg_code", "machiaza_id", "kind").distinct(), ["lg_code", "machiaza_id", "kind"], "left_anti")
        both = rest.unionByName(new.select(*rest.columns))
        out = both.repartition("lg_code", F.pmod("machiaza_id", F.lit(SPLITS))).sortWithinPartitions("lg_code", "machiaza_id", "kind", "num1", "num2", "num3")
        out.write.partitionBy("lg_code").option("parquet.block.size", GROUP_BYTES).parquet(f"{self.path('banchi')}/version={version}")
        following = now | dict.fromkeys(codes, version)
        name = f"m-{uuid.uuid4().hex}"
        self.spark.createDataFrame(list(following.items()), MANIFEST).coalesce(1).write.parquet(f"{self.path('banchi')}/{name}")
        self._switch("banchi", name)
        self._forget("banchi", {name, before or "", *(f"version={v}" for v in (*now.values(), *following.values()))})

    def lookup(self, lg_code: int, machiaza_id: int, kind: int, num1: int | None = None) -> DataFrame:
        own = self.read("banchi").where((F.col("lg_code") == lg_code) & (F.col("machiaza_id") == machiaza_id) & (F.col("kind") == kind))
        return (own if num1 is None else own.where(F.col("num1") == num1)).orderBy("num1", "num2", "num3")

    def sources(self) -> DataFrame:
        """The ledger: a row for each number file that was read."""
        return self.read("source")

    def counts(self) -> dict[str, int]:
        return {t: self.read(t).count() for t in ("pref", "city", "machiaza", "banchi")}

    def set_meta(self, **values: str) -> None:
        self.upsert("meta", self.spark.createDataFrame(list(values.items()), schema.META), ["key"])

    def meta(self) -> dict[str, str]:
        return {r["key"]: r["value"] for r in self.read("meta").collect()}

    def mark_source(self, rows: DataFrame) -> None:
        self.upsert("source", rows, ["url"])

    def index(self) -> Index:
        version = self.meta().get("version")
        if version != VERSION:
            raise ValueError(f"these tables have version {version}, not {VERSION}: build them again")
        return Index(*map(self.read, ("machiaza", "machiaza_head", "machiaza_key", "city", "pref", "banchi")))
