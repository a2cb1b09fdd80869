"""Fixed values of the survey domain (codes, labels, calendars)."""

# Survey rounds read, and the calendar year a round started in.
BASE_YEAR = {6: 2012, 7: 2014, 8: 2016, 9: 2018}

# Fixed values: (round, country, month below which the year moves on or None
# for every month, years to add).
FIELDWORK_YEAR_RULES = [
    (6, "CZ", None, 1), (6, "DE", None, 1), (6, "DK", None, 1), (6, "ES", None, 1),
    (6, "FR", None, 1), (6, "IT", None, 1), (6, "NO", 7, 1), (6, "CH", 8, 1),
    (6, "EE", 8, 1), (6, "FI", 8, 1), (6, "PL", 8, 1), (6, "PT", 8, 1),
    (6, "SE", 8, 1), (6, "HU", 9, 1),
    (7, "ES", None, 1), (7, "HU", None, 1), (7, "IL", None, 1), (7, "LT", None, 1),
    (7, "PL", None, 1), (7, "PT", None, 1), (7, "CH", 8, 1), (7, "DE", 8, 1),
    (7, "NO", 8, 1), (7, "SE", 8, 1), (7, "SI", 8, 1), (7, "AT", 9, 1),
    (7, "BE", 9, 1), (7, "CZ", 9, 1), (7, "DK", 9, 1), (7, "EE", 9, 1),
    (7, "FI", 9, 1), (7, "FR", 9, 1), (7, "IE", 9, 1), (7, "NL", 9, 1),
    (8, "ES", None, 1), (8, "HU", None, 1), (8, "IT", None, 1), (8, "DE", 7, 1),
    (8, "NO", 7, 1), (8, "SE", 7, 1), (8, "BE", 8, 1), (8, "CH", 8, 1),
    (8, "EE", 8, 1), (8, "FI", 8, 1), (8, "FR", 8, 1), (8, "PL", 8, 1),
    (8, "PT", 8, 1), (8, "SI", 8, 1),
    (9, "HU", None, 1), (9, "DE", 7, 1), (9, "NO", 7, 1), (9, "SE", 7, 1),
    (9, "BE", 8, 1), (9, "CH", 8, 1), (9, "EE", 8, 1), (9, "ES", 8, 1),
    (9, "FI", 8, 1), (9, "IT", 8, 1), (9, "PL", 8, 1), (9, "SI", 8, 1),
]

# Target population.
COUNTRIES = ["BE", "CH", "DK", "EE", "FI", "SI"]
EXCLUDED_GROUPS = ["EE-8", "EE-9", "CH-8"]
COUNTRY_NAMES = {
    "BE": "Belgium", "CH": "Switzerland", "DK": "Denmark", "EE": "Estonia",
    "FI": "Finland", "IT": "Italy", "PL": "Poland", "SI": "Slovenia",
}

# Age bands (low, high, label); the first band that holds wins.
AGE_BANDS = [
    (14, 34, "Under 35"), (35, 50, "35-49"), (50, 64, "50-64"), (65, None, "65+"),
]

# Outcome labels of an attempt that ended in an interview.
INTERVIEW_LABELS = ["Completed interview", "Complete interview"]

# Repeated column groups of a contact form that no result uses.
UNUSED_PREFIXES = [
    "resulb", "outnic", "modev", "totcin", "refvis", "rersb", "agea", "ageb",
    "gendera", "genderb", "coop", "inwyyspt", "intnum", "monv", "date", "hourv",
    "minv", "yearv", "dayv",
]

# Covariate levels, reference level first.
GENDER = ("Female", "Male")
AGE_CATEGORY = ("Under 35", "35-49", "50-64", "65+")
MULTI_UNIT = ("Not multi-unit", "Multi-unit")
NEIGHBOURHOOD = ("None", "One or more")
ACCESS = ("No barriers", "Barriers")

# Early-fieldwork cutoffs as shares of a group's attempts.
CUTOFFS = (0.5, 0.6, 0.7, 0.8)

# Magnitude classes of a standardised mean difference.
EFFECT_CLASSES = [(0.2, "negligible"), (0.5, "small"), (0.8, "moderate"), (None, "large")]

# Significance marks (upper bound of p, mark).
STARS = [(0.001, "***"), (0.01, "**"), (0.05, "*"), (0.1, ".")]

# Labels of the scenario tables.
DEMOGRAPHICS = "Demographics"
DEMOGRAPHICS_OBS = "Demographics + Interviewer obs."
SCENARIO_ORDER = (
    "Early fieldwork", "Sim1 Bottom", "Sim2 Top", "Sim3 Rank", "Sim4 Random", "Full dataset",
)
SAVED_LABELS = {
    "prop_dem_bottom": ("Demographics only", "Sim1 Bottom"),
    "prop_dem_top": ("Demographics only", "Sim2 Top"),
    "prop_full_bottom": ("Demographics + Interviewer obs.", "Sim1 Bottom"),
    "prop_full_top": ("Demographics + Interviewer obs.", "Sim2 Top"),
    "prop_rank_dem": ("Demographics only", "Sim3 Rank"),
    "prop_rank_full": ("Demographics + Interviewer obs.", "Sim3 Rank"),
    "prop_rand": ("Demographics only", "Sim4 Rand"),
    "prop_rand2": ("Demographics + Interviewer obs.", "Sim4 Rand"),
}

# Survey outcomes compared by interviewer observation.
OUTCOME_LABELS = {
    "hinctnta_n": "HH income", "eduyrs_n": "Education (yrs)", "happy_n": "Happy",
    "ppltrst_n": "Trust",
}
OUTCOME_FACTORS = {
    "neighb": ("Neighbourhood characteristics", NEIGHBOURHOOD),
    "multi_unit": ("Type of building", MULTI_UNIT),
    "no_access": ("Barriers to access", ACCESS),
}
