"""Input tables of the registered queries, built once per query from the driver's folder."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from trajlens.operators import ledger as L
from trajlens.session import input_state, new_table_path, still_stored, store
from trajlens.sources import fixtures as X


_LOGS: dict[tuple, tuple[str, StructType]] = {}


def stored_log(spark: SparkSession, folder: str, name: str, derive: Callable[[], DataFrame]) -> DataFrame:
    """A log table of a data folder, derived and written to the shared folder once per application.

    Step logs and replay evidence are stored tables; queries scan the columns they need instead of deriving
    the log again in each of their branches. It is derived anew when the input changed or the copy is gone.
    """
    key = (spark.sparkContext.applicationId, folder, name, *input_state(spark, f"{folder}/events.parquet"))
    known = _LOGS.get(key)
    if known is None or not still_stored(spark, known[0]):
        path, table = new_table_path(spark), derive()
        store(table, path)
        known = _LOGS[key] = (path, table.schema)
    return spark.read.schema(known[1]).parquet(known[0])


class Inputs:
    """Lazy plans over one data folder; nothing runs until a query result is read."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def steps(self) -> DataFrame:
        return stored_log(self.spark, self.folder, "steps", lambda: X.fixture_steps(self.spark, self.folder))

    @cached_property
    def history(self) -> DataFrame:
        return L.with_history(self.steps)

    @cached_property
    def trajectories(self) -> DataFrame:
        return X.fixture_trajectories(self.steps)

    @cached_property
    def edits(self) -> DataFrame:
        return stored_log(self.spark, self.folder, "edits", lambda: X.fixture_edits(self.steps))

    @cached_property
    def repairs(self) -> DataFrame:
        return L.first_repairs(self.edits)

    @cached_property
    def predictions(self) -> DataFrame:
        return X.fixture_predictions(self.steps)

    @cached_property
    def transitions(self) -> DataFrame:
        return X.fixture_transitions(self.steps)

    def ledger(self, source: str = "both", limit: int | None = None, history: bool = False) -> DataFrame:
        return L.step_ledger(self.history if history else self.steps, self.repairs, source, limit)

    def preferences(self, source: str = "both", history: bool = False) -> DataFrame:
        return L.compile_preferences(self.ledger(source, history=history))

    def compiled(self, source: str = "both") -> tuple[DataFrame, DataFrame]:
        """Ledger and preferences, with the ledger written first as a compile run does."""
        ledger = store(self.ledger(source))
        return ledger, L.compile_preferences(ledger)
