"""The net extraction of a set of boards, from masks to nets."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame

from netloom.operators import components, drills, nets
from netloom.storage import stored


@dataclass(frozen=True)
class Extraction:
    """Each step is a DataFrame, planned on first use.  Labels and contacts feed
    several later steps, so they are stored once instead of computed for each."""

    copper: DataFrame
    drill: DataFrame
    canvas: DataFrame
    layers: tuple[str, ...]
    mode: str = "infer"

    @cached_property
    def labelled(self) -> DataFrame:
        return stored(components.label(self.copper), "labels")

    @cached_property
    def components(self) -> DataFrame:
        return components.stats(self.labelled)

    @cached_property
    def drill_labelled(self) -> DataFrame:
        return stored(components.label(self.drill), "drill_labels")

    @cached_property
    def blobs(self) -> DataFrame:
        return drills.blobs(self.drill_labelled)

    @cached_property
    def limits(self) -> DataFrame:
        return drills.thresholds(self.blobs, self.canvas)

    @cached_property
    def contacts(self) -> DataFrame:
        return stored(drills.contacts(self.blobs, self.labelled, self.canvas, self.layers), "contacts")

    @cached_property
    def decisions(self) -> DataFrame:
        return drills.classify(self.blobs, self.contacts, self.limits, self.layers, self.mode)

    @cached_property
    def members(self) -> DataFrame:
        return drills.members(self.decisions, self.contacts)

    @cached_property
    def nets(self) -> DataFrame:
        return nets.merge(self.components, self.members)

    @cached_property
    def net_runs(self) -> DataFrame:
        from netloom.operators import export

        return export.net_runs(self.labelled, self.nets)

    @cached_property
    def check(self) -> DataFrame:
        return nets.check(self.nets, self.components, self.canvas)
