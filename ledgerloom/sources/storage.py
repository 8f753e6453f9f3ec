"""A firm's tables: stored by partition, read and written through its catalogue alone.

A table is Parquet below root/name, partitioned by firm_id, scope (a dataset or an engagement) and
whatever else says which rows are replaced together. Replacing and deleting are of whole
partitions: nothing else of a table is read or written.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.session import checkpointed

#: How tables are partitioned; a table of another name by firm_id and scope.
KEYS: dict[str, tuple[str, ...]] = {"findings": ("firm_id", "scope", "origin")}
#: What belongs to a dataset and goes with it.
OF_DATASET = ("records", "issues", "transactions", "lines", "entries", "accounts", "evidence")
#: Where the findings lie that a rule run replaces, and the others.
OPEN_RULES, OTHERS = "rules-open", "kept"


@dataclass
class Catalog:
    """The tables of one firm. Without a firm there is none.

    Reads carry the firm's predicate as a partition filter, so other firms' files aren't opened;
    writes of another firm's rows fail before anything is visible. SQL runs in a session of its
    own, in which the only views are the firm's: another name, or a path, is refused.
    """

    spark: SparkSession
    root: str
    firm_id: str
    names: tuple[str, ...] = ()
    session: SparkSession = field(init=False, repr=False)

    def __post_init__(self) -> None:
        if not self.firm_id:
            raise PermissionError("no firm in context")
        self.session = self.spark.newSession()
        self.session.conf.set("spark.sql.runSQLOnFiles", "false")
        self.session.conf.set("spark.sql.sources.partitionColumnTypeInference.enabled", "false")  # ids are texts, "007" too

    def _keys(self, name: str) -> tuple[str, ...]:
        if name not in (*self.names, *OF_DATASET, *KEYS):
            raise PermissionError(f"{name} is none of the firm's tables")
        return KEYS.get(name, ("firm_id", "scope"))

    def read(self, name: str) -> DataFrame:
        """The firm's rows of a table."""
        self._keys(name)
        return self.session.read.parquet(f"{self.root}/{name}").where(F.col("firm_id") == self.firm_id)

    def has(self, name: str) -> bool:
        """Whether anything of the table was ever written."""
        try:
            self.session.read.parquet(f"{self.root}/{name}")
        except AnalysisException as error:
            if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
            return False
        return True

    def sql(self, query: str) -> DataFrame:
        """A query over the firm's tables by name."""
        for name in dict.fromkeys((*self.names, *OF_DATASET, *KEYS)):
            if self.has(name):
                self.read(name).createOrReplaceTempView(name)
        return self.session.sql(query)

    def _checked(self, name: str, rows: DataFrame) -> DataFrame:
        """Rows, of which one of another firm fails the job that writes them."""
        own = F.col("firm_id").eqNullSafe(F.lit(self.firm_id))
        message = F.lit(f"a row of another firm than {self.firm_id}")
        return rows.withColumn("firm_id", F.when(own, F.col("firm_id")).otherwise(F.raise_error(message).cast("string")))

    def append(self, name: str, rows: DataFrame) -> None:
        """Adds rows of the firm."""
        self._checked(name, rows).write.mode("append").partitionBy(*self._keys(name)).parquet(f"{self.root}/{name}")

    def replace(self, name: str, rows: DataFrame) -> None:
        """Rows take the place of what their partitions held; other partitions stay as they are."""
        writer = self._checked(name, rows).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.partitionBy(*self._keys(name)).parquet(f"{self.root}/{name}")

    def drop(self, name: str, **values: str) -> bool:
        """Deletes a partition of the firm; False if there is none."""
        keys = self._keys(name)
        if tuple(values) != keys[1 : 1 + len(values)] or not values:
            raise ValueError(f"{name} is partitioned by {', '.join(keys)}")
        if not self.has(name):
            return False
        rows = self.read(name)
        for key, value in values.items():
            rows = rows.where(F.col(key) == value)
        file = rows.select("_metadata.file_path").first()
        if file is None:
            return False
        jvm = self.spark._jvm
        folder = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(file[0])).getParent()
        for _ in keys[1 + len(values) :]:
            folder = folder.getParent()
        return folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(folder, True)

    # What the application does with them

    def replace_open_findings(self, engagement_id: str, fresh: DataFrame) -> None:
        """A rule run's findings take the place of the open ones of the last run; resolved and other findings stay.

        fresh: the columns of findings but firm_id, scope and origin. A run without findings leaves none open.
        """
        rows = fresh.select(F.lit(self.firm_id).alias("firm_id"), F.lit(engagement_id).alias("scope"), F.lit(OPEN_RULES).alias("origin"), "*")
        if rows.isEmpty():
            self.drop("findings", scope=engagement_id, origin=OPEN_RULES)
        else:
            self.replace("findings", rows)

    def settle_findings(self, engagement_id: str, settled: DataFrame, key: str = "finding_id") -> None:
        """Open findings of rules that `settled` (key, status) names leave the part that runs replace."""
        ours = self.read("findings").where((F.col("scope") == engagement_id) & (F.col("origin") == OPEN_RULES))
        marked = checkpointed(ours.join(settled.select(key, F.col("status").alias("settled_as")), key, "left"))
        done = marked.where("settled_as is not null").withColumns({"status": F.col("settled_as"), "origin": F.lit(OTHERS)}).select(*ours.columns)
        self.append("findings", done)
        left = marked.where("settled_as is null").select(*(c for c in ours.columns if c not in KEYS["findings"]))
        self.replace_open_findings(engagement_id, left)

    def delete_dataset(self, dataset_id: str, used_in_runs: DataFrame, tables: Iterable[str] = OF_DATASET) -> list[str]:
        """Deletes a dataset with all that belongs to it, unless a run uses it; gives the tables that held some of it."""
        if not used_in_runs.where((F.col("firm_id") == self.firm_id) & (F.col("dataset_id") == dataset_id)).isEmpty():
            raise ValueError(f"{dataset_id} is used in a run")
        return [name for name in tables if self.drop(name, scope=dataset_id)]

    def delete_document(self, document_id: str) -> int:
        """Deletes a document's transactions; gives how many. Only the datasets that hold some are written anew."""
        rows = self.read("transactions")
        held = {r.scope: r.n for r in rows.where(F.col("document_id") == document_id).groupBy("scope").agg(F.count("*").alias("n")).collect()}  # a document is of few datasets
        if not held:
            return 0
        left = checkpointed(rows.where(F.col("scope").isin(*held) & ~F.col("document_id").eqNullSafe(F.lit(document_id))))
        self.replace("transactions", left)
        emptied = held.keys() - {r.scope for r in left.select("scope").distinct().collect()}
        for scope in emptied:
            self.drop("transactions", scope=scope)
        return sum(held.values())
