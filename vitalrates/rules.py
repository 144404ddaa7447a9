"""Constants of the study design, kept as plain tables."""

from __future__ import annotations

from decimal import Decimal
from typing import NamedTuple

# Hectares counted per grid, and the area of every grid not listed.
GRID_AREA = {
    "KL": Decimal("39.69"),
    "SU": Decimal("39.69"),
    "CH": Decimal("39.69"),
    "JO": Decimal("39.69"),
    "LL": Decimal("26.73"),
}
OTHER_AREA = Decimal("45.36")


class GridBox(NamedTuple):
    """One counted region: a grid, the census month, the last uncounted year, and inclusive x/y bounds."""

    grid: str
    month: int
    after_year: int | None
    x_lo: Decimal
    x_hi: Decimal
    y_lo: Decimal
    y_hi: Decimal


# The counted region of each grid.
GRID_BOXES = (
    GridBox("KL", 5, None, Decimal("-0.2"), Decimal("20.8"), Decimal("-0.2"), Decimal("20.8")),
    GridBox("SU", 5, None, Decimal("-0.2"), Decimal("20.8"), Decimal("-0.2"), Decimal("20.8")),
    GridBox("CH", 5, None, Decimal("-0.2"), Decimal("20.8"), Decimal("-0.2"), Decimal("20.8")),
    GridBox("JO", 5, None, Decimal("-0.2"), Decimal("20.8"), Decimal("-0.2"), Decimal("20.8")),
    GridBox("LL", 5, 2005, Decimal("-10.2"), Decimal("22.8"), Decimal("-0.2"), Decimal("8.8")),
    GridBox("AG", 5, None, Decimal("-0.2"), Decimal("20.8"), Decimal("-0.2"), Decimal("23.8")),
)

# Mast years, feeding experiments (grid, first and last year), surveyed grids, first year.
MAST_YEARS = (1993, 1998, 2005, 2010, 2014, 2019)
FEEDING = (("AG", 2004, 2018), ("JO", 2006, 2013), ("LL", 2005, 2012))
CONE_GRIDS = ("AG", "CH", "JO", "KL", "LL", "SU", "BT")
CONE_FIRST_YEAR = 1988

# The cone total is CONE_SCALE * exp(CONE_SHIFT + CONE_POWER * ln(count + CONE_OFFSET)).
CONE_SCALE, CONE_SHIFT, CONE_POWER, CONE_OFFSET = 1.11568, 0.1681, 1.1891, 0.01

# Behaviours behind each component score.
AGGRESSION = ("front", "back", "attack", "attacklatency", "approachlatency")
ACTIVITY = ("walk", "still", "hang", "jump", "chew", "hole")

# Columns kept from the raw trial sheet (sq_id becomes squirrel_id).
TRIAL_COLUMNS = (
    "sex", "year", "observer", "cohort", "grid", "trialnumber", "trialdate", "taglft", "tagrt", "colours",
    "walk", "jump", "hole", "hang", "chew", "groom", "still", "oft_duration",
    "front", "back", "attack", "attacklatency", "approachlatency", "mis_duration", "collar", "comments",
)
