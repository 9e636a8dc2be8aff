"""Epoch specifications: which stimulus, which parameters, which trials, which time bin."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from .dims import STIM_ID
from .rules import RuleSet, parse


@dataclass(frozen=True)
class Epoch:
    num: int
    name: str
    stim: Any
    rules: RuleSet
    trials: range
    lo: float
    hi: float


def load_config(path: str | Path) -> dict:
    import yaml

    with open(path, encoding="utf-8") as f:
        return yaml.safe_load(f)


def epochs(config: dict, stim_ids: dict[str, Any] = STIM_ID) -> list[Epoch]:
    """One epoch for each time bin and parameter set of each stimulus, numbered in that order."""
    out: list[Epoch] = []
    for entry in config["stimuli"]:
        if entry["stim"] not in stim_ids:
            raise ValueError(f"No such stimulus: {entry['stim']!r}")
        bins = entry.get("time_bins", config.get("time_bins"))
        if not bins:
            raise ValueError(f"Stimulus {entry['name']!r} has no time bins")
        span = entry["trial_range"]
        sets = [parse(p) for p in entry["parameters"]]
        for lo, hi in bins:
            for rules in sets:
                out.append(Epoch(len(out), entry["name"], stim_ids[entry["stim"]], rules, range(span["start"], span["stop"], span["step"]), float(lo), float(hi)))
    return out


def spec_table(spark: SparkSession, specs: Iterable[Epoch]) -> DataFrame:
    """The epochs as a table; as many rows as the configuration has."""
    rows = [(e.num, e.name, e.rules.label, list(e.trials), e.lo, e.hi) for e in specs]
    return spark.createDataFrame(rows, "epoch_num int, epoch_name string, stim_param string, trials array<int>, lo double, hi double")
