"""Settings: named values in groups, with defaults."""

from __future__ import annotations

import json
import logging
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

log = logging.getLogger(__name__)


class MissingSettings(KeyError):
    pass


class Config:
    def __init__(self, groups: Mapping[str, object], required: Sequence[str] = ()):
        self.groups = dict(groups)
        if missing := [g for g in required if g not in self.groups]:
            raise MissingSettings(f"no settings for {', '.join(missing)}")

    @classmethod
    def of_table(cls, settings: DataFrame, scheduler: str, required: Sequence[str] = ()) -> Config:
        """Rows (scheduler_id, name, value as JSON) of one scheduler; a later name wins."""
        rows = settings.where(F.col("scheduler_id") == scheduler).select("name", "value").orderBy("name", "value").collect()
        return cls({r.name: json.loads(r.value) for r in rows}, required)

    def get(self, name: str, group: str | None = None, default: object = None) -> object:
        values = self.groups.get(group, {}) if group else self.groups
        if name not in values and default is None:
            log.error("setting %s of %s is missing", name, group)
        return values.get(name, default)

    def of_type(self, name: str, kind: str, default: object = None) -> object:
        return self.get(name, f"{kind}_scraper_settings", default)


@dataclass(frozen=True)
class WorkItem:
    """One page to fetch; only detail pages are translated unless said otherwise."""

    domain: str
    locale: str
    url: str
    kind: str = "catalog"
    translate: bool | None = None
    proxy: bool = False
    ignore_min: bool = False
    ignored_cleaning_steps: tuple[str, ...] = ()

    def __post_init__(self):
        if self.kind not in ("catalog", "vdp", "catalog_static", "test"):
            raise ValueError(f"unknown kind of page {self.kind}")
        if self.translate is None:
            object.__setattr__(self, "translate", self.kind == "vdp")
