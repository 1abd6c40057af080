"""Units, year parameters and the fixed vocabulary of the energy-model output.

Everything under "FIXED VALUES" must equal the values used by the analysis
being reproduced (names of model sectors/technologies, label rewrites,
category rules, factor levels); they are stated as plain text, in their
natural order.  Every operator takes them as parameters, so other models or
the test-data domain can pass their own.
"""

from __future__ import annotations

# ---------------------------------------------------------------------------
# Unit conversions (fixed values)
# ---------------------------------------------------------------------------
CONV_KWH_EJ = 3.6e-12   # 1 kWh in EJ
CONV_KWH_GJ = 3.6e-3    # 1 kWh in GJ
HOURS_PER_YEAR = 8760
CONV_KW_GW = 1e-6

# ---------------------------------------------------------------------------
# Year parameters of the analysis (defaults; every operator takes its own)
# ---------------------------------------------------------------------------
BASE_YEAR = 2015            # no vintaging before this year
ADDER_FROM_YEAR = 2020      # first year with calibration adders
CHART_YEARS = (2015, 2050)  # range of the chart tables
PRICE_YEARS = (2020, 2050)  # range of the carbon-price table
PERIOD_STEP = 5             # years between model periods
MODEL_YEARS = (1975, 1990, 2005, 2010, 2015, 2020, 2025, 2030, 2035, 2040, 2045, 2050)
DEFAULT_FCR = 0.13          # fixed charge rate used for non-learning capital
DEFAULT_REGION = "USA"
CO2_MARKET = "USACO2"

# ---------------------------------------------------------------------------
# FIXED VALUES: stored-query predicates
# ---------------------------------------------------------------------------
# sector filter of the generation and cost queries
ELEC_SECTORS = ("electricity", "elect_td_bld")
ELEC_SECTOR_SUBSTRING = "elec_"
EXCLUDED_SECTOR_SUBSTRING = "water_td"
EXCLUDED_SUBSECTOR = "elect_td_bld"

# pass-through technologies that are reported again at cooling level
# (excluded from the generation queries so nothing is counted twice)
PASSTHRU_EXCLUDED_TECHNOLOGIES = (
    "biomass (conv)", "biomass (conv CCS)", "biomass (IGCC)", "biomass (IGCC CCS)",
    "coal (conv pul)", "coal (conv pul CCS)", "coal (IGCC)", "coal (IGCC CCS)",
    "gas (steam/CT)", "gas (CC)", "gas (CC CCS)",
    "refined liquids (steam/CT)", "refined liquids (CC)", "refined liquids (CC CCS)",
    "geothermal", "Gen_II_LWR", "Gen_III",
    "CSP", "CSP_storage",
)

# label rewrites applied by the labelled generation queries: (level, from, to)
LABEL_REWRITES = (
    ("sector", "elec_Gen_III", "electricity"),
    ("sector", "elec_CSP_storage", "electricity"),
    ("sector", "elec_refined liquids (steam/CT)", "electricity"),
    ("sector", "elec_geothermal", "electricity"),
    ("sector", "elec_refined liquids (CC)", "electricity"),
    ("sector", "elec_biomass (conv CCS)", "electricity"),
    ("sector", "elec_Gen_II_LWR", "electricity"),
    ("sector", "elec_gas (steam/CT)", "electricity"),
    ("sector", "elec_biomass (IGCC CCS)", "electricity"),
    ("sector", "elec_coal (IGCC CCS)", "electricity"),
    ("sector", "elec_coal (IGCC)", "electricity"),
    ("sector", "elec_coal (conv pul CCS)", "electricity"),
    ("sector", "elec_gas (CC)", "electricity"),
    ("sector", "elec_biomass (IGCC)", "electricity"),
    ("sector", "elec_coal (conv pul)", "electricity"),
    ("sector", "elec_CSP", "electricity"),
    ("sector", "elec_gas (CC CCS)", "electricity"),
    ("sector", "elec_biomass (conv)", "electricity"),
    ("sector", "elec_refined liquids (CC CCS)", "electricity"),
    ("subsector", "gas (CC)", "gas"),
    ("subsector", "CSP", "solar"),
    ("subsector", "gas (CC CCS)", "gas"),
    ("subsector", "coal (IGCC CCS)", "coal"),
    ("subsector", "biomass (conv)", "biomass"),
    ("subsector", "Gen_II_LWR", "nuclear"),
    ("subsector", "coal (conv pul)", "coal"),
    ("subsector", "coal (IGCC)", "coal"),
    ("subsector", "biomass (conv CCS)", "biomass"),
    ("subsector", "gas (steam/CT)", "gas"),
    ("subsector", "CSP_storage", "solar"),
    ("subsector", "biomass (IGCC)", "biomass"),
    ("subsector", "Gen_III", "nuclear"),
    ("subsector", "coal (conv pul CCS)", "coal"),
    ("subsector", "refined liquids (CC)", "refined liquids"),
    ("subsector", "biomass (IGCC CCS)", "biomass"),
    ("subsector", "refined liquids (CC CCS)", "refined liquids"),
    ("subsector", "refined liquids (steam/CT)", "refined liquids"),
)

# path-query filters of the per-period update
PATH_ELEC_SECTOR = "electricity"
PATH_ROOFTOP_SECTOR = "elect_td_bld"
PATH_ROOFTOP_SUBSECTOR = "rooftop_pv"
PATH_COOLING_SECTOR_REGEX = "^elec_"
CAPITAL_INPUT = "capital"

# ---------------------------------------------------------------------------
# FIXED VALUES: non-learning capital
# ---------------------------------------------------------------------------
STORAGE_TECH_REGEX = "CSP"          # technologies split into base + storage
STORAGE_SEP = "_"
STORAGE_FILL = "no_storage"
CCS_INCLUDE_REGEX = "coal|gas"      # technologies paired with a CCS twin
CCS_EXCLUDE_REGEX = "steam/CT"
CCS_FLAG_REGEX = "CCS"
CCS_STRIP = " CCS"

# ---------------------------------------------------------------------------
# FIXED VALUES: results analysis
# ---------------------------------------------------------------------------
SCENARIOS = ("Reference_exogenous", "NZ_exogenous", "Reference_NZ_endogenous")
REFERENCE_SCENARIO = "Reference_exogenous"
EXOGENOUS_SCENARIO = "NZ_exogenous"
ENDOGENOUS_SCENARIO = "Reference_NZ_endogenous"
PAIR_DIFF_NAME = "diff_NZ_endogenous_exogenous"

CAPITAL_COST_INCLUDE_REGEX = "PV|CSP|wind|pv|Gen|CCS"
CAPITAL_COST_EXCLUDE_REGEX = "liquids|biomass"
CAPITAL_COST_LEVELS = (
    "PV", "CSP", "wind", "PV_storage", "CSP_storage", "wind_storage",
    "wind_offshore",
    "rooftop_pv", "Gen_II_LWR", "Gen_III",
    "coal (conv pul CCS)", "coal (IGCC CCS)", "gas (CC CCS)",
)
CAPITAL_COST_VIEW_SCENARIOS = ("Reference_exogenous", "Reference_NZ_endogenous")
CAPITAL_COST_VIEW_LABELS = (("Reference_exogenous", "model default"),)
CAPITAL_COST_VIEW_OTHER_LABEL = "NZ endogenous"

CAPACITY_INCLUDE_REGEX = "PV|CSP|wind|rooftop|Gen|CCS"
CAPACITY_EXCLUDE_REGEX = "biomass|liquids"
# ordered (pattern, label) rules, first match wins, unmatched keep their name
CAPACITY_RULES = (
    ("CSP_storage", "CSP_storage"),
    ("CSP", "CSP"),
    ("Gen", "nuclear"),
    ("conv pul CCS", "coal (conv pul CCS)"),
    ("IGCC CCS", "coal (IGCC CCS)"),
    ("CC CCS", "gas (CC CCS)"),
)
CAPACITY_LEVELS = (
    "PV", "CSP", "wind", "PV_storage", "CSP_storage",
    "wind_storage", "wind_offshore", "rooftop_pv", "nuclear",
    "coal (conv pul CCS)", "coal (IGCC CCS)", "gas (CC CCS)",
)

FUEL_CCS_REGEX = "CCS"
FUEL_CCS_LABELS = ("CCS", "unabated")
FUEL_RULES = (
    ("biomass", "biomass"),
    ("gas", "gas"),
    ("geothermal", "geothermal"),
    ("Gen", "nuclear"),
    ("coal", "coal"),
    ("wind", "wind"),
    ("PV", "PV"),
    ("refined", "refined liquids"),
    ("CSP", "CSP"),
)
FUEL_LEVELS = (
    "coal", "gas", "refined liquids", "nuclear", "geothermal",
    "hydro", "biomass", "wind",
    "rooftop_pv", "CSP", "PV",
)

CALIBRATION_PLOT_HIDE_REGEX = "rooftop|storage"
CALIBRATION_PLOT_LABELS = ("model default", "Learning curve output (Ref)")
