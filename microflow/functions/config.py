"""Run configurations: typed, validated, derived fields filled in, and turned into rows of a cells table."""

from __future__ import annotations

import dataclasses
import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from microflow.functions.grid import fee_to_tenths

#: Labels and their aliases.
QUEUE_MODELS = {"PESS": "PESS", "PESSIMISTIC": "PESS", "OPT": "OPT", "OPTIMISTIC": "OPT", "PROP": "PROP", "PROPORTIONAL": "PROP"}
STRATEGIES = ("S0_touch", "S0_queue", "S1", "S2_AS", "S2_GLFT", "S3")


def queue_model(text: str) -> str:
    """The canonical label; raises for an unknown one."""
    try:
        return QUEUE_MODELS[text.upper()]
    except KeyError:
        raise ValueError(f"unknown queue model {text!r}") from None


def _positive(**values: float) -> None:
    for name, value in values.items():
        if not value > 0:
            raise ValueError(f"{name} must be positive")


@dataclass(frozen=True)
class Run:
    """One cell of an experiment. Times are given as in a configuration file and derived in microseconds."""

    strategy: str = "S1"
    queue: str = "PESS"
    maker_fee_bp: float = 2.0
    taker_fee_bp: float = 0.0
    latency_ms: float = 50.0
    jitter_ms: float = 0.0
    order_size: float = 1.0
    max_inventory: float = 10.0
    spread_ticks: float = 1.0
    gamma: float = 1e-5
    volatility_window_s: float = 300.0
    volatility_sample_s: float = 1.0
    toxicity_threshold: float = 0.6
    horizons_s: tuple[float, ...] = (1.0, 10.0)
    probe_depths: tuple[int, ...] = ()
    seed: int = 1
    eval_window: tuple[int, int] = (0, 0)
    run_id: str = field(default="")

    def __post_init__(self) -> None:
        if self.strategy not in STRATEGIES:
            raise ValueError(f"unknown strategy {self.strategy!r}")
        object.__setattr__(self, "queue", queue_model(self.queue))
        _positive(order_size=self.order_size, max_inventory=self.max_inventory, gamma=self.gamma, volatility_sample_s=self.volatility_sample_s)
        if self.volatility_window_s < self.volatility_sample_s:
            raise ValueError("the volatility window must hold a sample")
        if not 0 <= self.toxicity_threshold <= 1:
            raise ValueError("the toxicity threshold is a share")
        if not self.horizons_s or any(a >= b for a, b in zip(self.horizons_s, self.horizons_s[1:])) or self.horizons_s[0] <= 0:
            raise ValueError("horizons must be positive and increase")
        if any(d < 1 for d in self.probe_depths):
            raise ValueError("probe depths start at 1")
        fee_to_tenths(self.maker_fee_bp), fee_to_tenths(self.taker_fee_bp)
        if not self.run_id:
            name = "_".join(str(x) for x in (self.strategy, self.queue, self.maker_fee_bp, self.latency_ms, self.seed))
            object.__setattr__(self, "run_id", name.translate(str.maketrans(".- /", "____")))

    @property
    def fill_model(self) -> str:
        return "TOUCH" if self.strategy == "S0_touch" else "QUEUE"

    @property
    def stationary(self) -> bool:
        return self.strategy == "S2_GLFT"

    @property
    def weighted_mid(self) -> bool:
        return self.strategy == "S3"

    def row(self) -> dict:
        """The cell as a row: derived flags, fees in tenths, times in microseconds."""
        us = lambda seconds: round(seconds * 1_000_000)
        return {"run_id": self.run_id, "strategy": self.strategy, "queue": self.queue, "fill_model": self.fill_model, "stationary": self.stationary, "weighted_mid": self.weighted_mid, "maker_tenths": fee_to_tenths(self.maker_fee_bp), "taker_tenths": fee_to_tenths(self.taker_fee_bp), "latency_us": us(self.latency_ms / 1000), "jitter_us": us(self.jitter_ms / 1000), "window_us": us(self.volatility_window_s), "sample_us": us(self.volatility_sample_s), "horizons_us": [us(h) for h in self.horizons_s], "seed": self.seed}

    def manifest(self) -> str:
        """The resolved configuration as JSON."""
        return json.dumps(dataclasses.asdict(self) | self.row(), indent=1, sort_keys=True)


CELLS = "run_id string, strategy string, queue string, fill_model string, stationary boolean, weighted_mid boolean, maker_tenths long, taker_tenths long, latency_us long, jitter_us long, window_us long, sample_us long, horizons_us array<long>, seed long"


def cells(spark: SparkSession, runs: list[Run]) -> DataFrame:
    """The runs as a table."""
    names = [c.split()[0] for c in CELLS.split(", ")]
    return spark.createDataFrame([tuple(r.row()[n] for n in names) for r in runs], CELLS)


def calibration(points: DataFrame) -> DataFrame:
    """k and A of a calibration file as a one-row table: from the combined or pooled fit if there is one; both must be positive.

    points: read with spark.read.json(path, schema=CALIBRATION).
    """
    from pyspark.sql import functions as F

    k, a = F.coalesce("combined.k", "pooled.k", "k"), F.coalesce("combined.A", "pooled.A", "A")
    return points.select(k.alias("k"), a.alias("A")).where("k > 0 and A > 0")


CALIBRATION = "k double, A double, combined struct<k: double, A: double>, pooled struct<k: double, A: double>"
