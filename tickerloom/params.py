"""Default parameters.  Every operator takes its own arguments; these are the defaults."""

from __future__ import annotations

from dataclasses import dataclass

# Study periods, industry band, cost levels and sizes of the analysis.
ESTIMATION = ("2005-01-01", "2015-12-31")
OUT_OF_SAMPLE = ("2016-01-01", "2023-12-31")
SIC_BAND = (5500, 6000)
UNIVERSE_SIZE = 25
TOP_EVENT_TYPES = 20
TOP_TOKENS = 10
MOVING_AVERAGE_ROWS = 5
HISTOGRAM_BINS = 50
MAX_TOKENS = 512
ENCODER_BATCH = 16
EPOCHS = 3
TRAIN_BATCH = 8
TRAIN_WINDOW = 10
LEG_SIZE = 10
LARGE_COST = 11.21 / 10000
SMALL_COST = 21.27 / 10000
RISK_FREE = 0.0
EXCHANGE = 1
NO_HEADLINE = "No_Headlines"
# Names of pre-trained encoders; ``operators.vectors.VARIANTS`` are the variants computed here.
MODEL_KEYS = ("bert", "roberta", "distilbert", "distilroberta", "finbert")

# Scenario and portfolio names as they appear in the risk tables.
GROSS = "Without Transaction Cost"
NET = "With Transaction Cost"
PORTFOLIO_TYPES = ("EW L", "EW S", "EW LS", "VW L", "VW S", "VW LS")


@dataclass(frozen=True)
class Periods:
    """Two inclusive date ranges, as ISO strings."""

    estimation: tuple[str, str] = ESTIMATION
    out_of_sample: tuple[str, str] = OUT_OF_SAMPLE
