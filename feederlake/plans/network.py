"""The network: settings, extracts and the registry of data products."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from feederlake.functions.calendar import instant, winter_name
from feederlake.operators.latest import latest_record
from feederlake.operators.quality import Rule, enforce
from feederlake.schemas import EXTRACTS
from feederlake.session import settle

PRODUCTS: dict[str, Callable[["Network"], DataFrame]] = {}


def product(name: str):
    """Register a function ``Network -> DataFrame`` as the table ``layer.name``."""
    def register(fn: Callable[["Network"], DataFrame]):
        PRODUCTS[name] = fn
        return fn

    return register


@dataclass(frozen=True)
class Settings:
    """The instant all ages and trailing periods refer to, and the two winters.

    Features of the feature winter learn the label of the label winter; the label
    winter's features then score the one after it.
    """

    as_of: datetime
    feature_winter: int
    label_winter: int

    @property
    def winters(self) -> tuple[int, int]:
        return self.feature_winter, self.label_winter

    @property
    def target_winter(self) -> str:
        return winter_name(self.label_winter + 1)

    @property
    def year(self) -> int:
        return self.as_of.year

    def now(self) -> Column:
        return instant(self.as_of)


class Network:
    """Data products by name, each built lazily from the ones it names.

    With a table store, a product that has been stored is read back instead, so in
    production every product is computed once per refresh.
    """

    def __init__(self, spark: SparkSession, extract: Callable[[str], DataFrame], settings: Settings,
                 relanded: bool = True, store=None, scorer: Callable | None = None):
        self.spark = spark
        self.settings = settings
        self.store = store
        self.scorer = scorer
        self.model_version = 1
        self.replies: DataFrame | None = None
        self.observations: dict[str, Observation] = {}
        self.count_violations = False
        self._extract = extract
        self._relanded = relanded
        self._frames: dict[str, DataFrame] = {}
        self._written: set[str] = set()

    def extract(self, name: str) -> DataFrame:
        return self._extract(name)

    def latest(self, name: str) -> DataFrame:
        """The extract with one row per key; skipped when it is known to be clean."""
        df = self._extract(name)
        key = EXTRACTS[name].key
        return latest_record(df, key) if self._relanded and key else df

    def checked(self, name: str, df: DataFrame, rules: list[Rule]) -> DataFrame:
        """Apply quality rules, counting violations on the way if asked to."""
        observation = None
        if self.count_violations:
            observation = self.observations[name] = Observation(f"quality.{name}")
        return enforce(df, rules, observation)

    def table(self, name: str) -> DataFrame:
        if name not in self._frames:
            if self.store is not None and self.store.exists(name):
                self._frames[name] = self.store.read(name)
            else:
                self._frames[name] = PRODUCTS[name](self)
        return self._frames[name]

    def shared(self, name: str) -> DataFrame:
        """The product for those that are built from it: written out at its first use unless it is stored.

        A product with several uses is then computed once, and the plan of each use begins here.
        """
        if name not in self._written and not (self.store is not None and self.store.exists(name)):
            self._frames[name] = settle(self.table(name), name)
            self._written.add(name)
        return self.table(name)

    def once(self, label: str, build: Callable[[], DataFrame]) -> DataFrame:
        """A step between products with several uses, written out at the first. With a store its parts are read back."""
        if self.store is not None:
            return build()
        if label not in self._frames:
            self._frames[label] = settle(build(), label)
        return self._frames[label]

    def settled(self, name: str, df: DataFrame) -> DataFrame:
        """The frame, written out first when nothing stored stands behind it."""
        return df if self.store is not None else settle(df, name)

    def forget(self, name: str) -> None:
        self._frames.pop(name, None)
        self._written.discard(name)

    def age(self, install_year: str) -> Column:
        return F.lit(self.settings.year) - F.col(install_year)
