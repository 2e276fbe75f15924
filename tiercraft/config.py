"""Mode configuration and the fixed values the results depend on."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class ModeConfig:
    """Which columns play which role in a segmentation run."""
    mode: str
    title: str
    id_col: str | None
    value_col: str | None
    consent_cols: tuple[str, ...] = ()
    flag_col: str | None = None
    recency_col: str | None = None
    approach: str = "Value + Recency"
    extra: dict = field(default_factory=dict)


# ---------------------------------------------------------------------------
# Fixed values. These must equal the behaviour being reproduced; they are
# listed plainly, in their natural order.
# ---------------------------------------------------------------------------

PLAYERS = ModeConfig(mode="players", title="Player Segmentation Agent",
                     id_col="PlayerID", value_col="NetADT",
                     consent_cols=("CanEmail", "CanCall"), flag_col="ZipCode")
COMPANIES = ModeConfig(mode="companies", title="Account Segmentation Agent",
                       id_col="AccountID", value_col="AnnualRevenue",
                       consent_cols=(), flag_col="Industry")
CUSTOM = ModeConfig(mode="custom", title="Custom Segmentation Agent",
                    id_col=None, value_col=None)

# Identity strings that count as a missing id after str() + strip().
MISSING_ID_TOKENS = ("", "nan", "None", "NaN")

# Text tokens a pandas CSV read turns into null (Spark keeps most as text).
CSV_NA_TOKENS = ("", "NA", "N/A", "n/a", "NULL", "null", "NaN", "nan", "-nan",
                 "-NaN", "None", "#N/A", "#N/A N/A", "#NA", "<NA>", "1.#IND",
                 "1.#QNAN", "-1.#IND", "-1.#QNAN")

# Characters kept by the money parser.
MONEY_KEEP_PATTERN = r"[^0-9.\-]"

# Segment thresholds.
PLAYER_RECENCY_LAPSED_DAYS = 180
PLAYER_RECENCY_ACTIVE_DAYS = 30
COMPANY_LEVERAGE_LIMIT = 1.5
COMPANY_DORMANT_MONTHS = 12
TREND_LIMIT_PCT = 15
VALUE_CUT_QUANTILE = 0.75
VALUE_LOW_QUANTILE = 0.25

PLAYER_MEANINGS = {
    "VIP High Value": "Top quartile value and active. Your most important players.",
    "At Risk High Value": "High value but no visit in 180+ days. Worth a win back effort.",
    "Active Developing": "Recent activity, value still building. Nurture these.",
    "Casual": "Lower value, occasional activity. Low touch.",
    "Churned Low Value": "Lower value and gone a long time. Low priority.",
    "Needs Review": "Missing value data. Set aside for a manual look.",
}

COMPANY_MEANINGS = {
    "Strategic Account": "Top quartile revenue with healthy leverage. Protect and grow.",
    "High Value At Risk": "Large revenue but heavily leveraged. Watch closely.",
    "Leveraged Watchlist": "Smaller and heavily leveraged. Monitor credit risk.",
    "Dormant": "No contact in over 12 months. Re-engage.",
    "Standard": "Mid portfolio, stable. Routine service.",
    "Needs Review": "Missing revenue data. Set aside for a manual look.",
}

CUSTOM_MEANINGS = {
    "High Value Active": "Top tier by value and recently active. Your best records.",
    "High Value At Risk": "Top tier by value but gone quiet. Worth re-engaging first.",
    "Mid Tier": "Middle of the pack by value, still active.",
    "Mid Tier Lapsed": "Middle value and gone quiet. Watch these.",
    "Low Value": "Bottom tier by value, still active. Low touch.",
    "Low Value Lapsed": "Bottom value and gone quiet. Lowest priority.",
    "Top Tier": "Highest value records (top 25%).",
    "Middle Tier": "Mid range by value.",
    "Bottom Tier": "Lowest value records (bottom 25%).",
    "Needs Review": "Value could not be read. Set aside for a manual look.",
}

MEANINGS_BY_MODE = {"players": PLAYER_MEANINGS, "companies": COMPANY_MEANINGS,
                    "custom": CUSTOM_MEANINGS}

# Comp tiers: (NetADT cutoff, offer), in list order.
DEFAULT_COMP_TIERS = (
    (0, "Free play offer"),
    (50, "Complimentary meal"),
    (120, "Hotel night on us"),
    (250, "Suite plus event invite"),
)

# Worklist: which segments are high value, and their call priority.
HIGH_VALUE_SEGMENTS = ("At Risk High Value", "VIP High Value")
WORKLIST_PRIORITY = {"At Risk High Value": 0, "VIP High Value": 1}

# Pareto inputs (players).
OFFER_COLUMNS = ("OfferSlots", "OfferTables", "OfferFood", "OfferHotel")

# Profiles.
PLAYER_PROFILE_MONEY = ("NetADT", "LifetimeValue", "AvgWager", "OfferTotal", "CoinInTotal")
PLAYER_PROFILE_TOP = ("TierRank", "PreferredGame")
COMPANY_PROFILE_MONEY = ("AnnualRevenue", "Debt", "Liabilities", "Equity")
COMPANY_PROFILE_NUMBER = ("DebtToEquity", "CreditScore", "ProductsHeld")
COMPANY_PROFILE_TOP = ("Industry", "RiskTier")

# Roster export columns, in order (the id and value columns are filled in).
ROSTER_COLUMNS = ("{id}", "FullName", "FirstName", "LastName", "Segment", "{value}",
                  "DaysSinceLastVisit", "MonthsSinceContact", "TierRank")

# Column-mapping keywords.
ID_KEYWORDS = ("member", "account", "customer", "player", "ref", "id", "code")
VALUE_KEYWORDS = ("worth", "value", "revenue", "netadt", "spend", "amount", "ltv",
                  "lifetime", "balance", "sales", "theoretical")
VALUE_AVOID = ("row", "index", "no.", "count", "id")
RECENCY_KEYWORDS = ("dayssince", "daysaway", "days away", "monthssince", "recency",
                    "lastvisit", "last_touch", "lasttouch", "lastcontact")

# Date formats tried, in order, when a recency column holds date text.
DATE_FORMATS = ("yyyy-M-d", "yyyy-M-d H:mm[:ss][.SSSSSSSSS]", "yyyy-M-d'T'H:mm[:ss][.SSSSSSSSS]",
                "M/d/yyyy", "M/d/yyyy H:mm[:ss]", "yyyy/M/d", "yyyy/M/d H:mm[:ss]", "d.M.yyyy",
                "MMM d, yyyy", "MMMM d, yyyy", "d MMM yyyy", "d MMMM yyyy", "d-MMM-yyyy")
ZONED_DATE_FORMATS = ("yyyy-M-d'T'H:mm:ss[.SSSSSSSSS]XXX", "yyyy-M-d H:mm:ss[.SSSSSSSSS]XXX")

# Sentences of the reports; {names} are filled in.
PREFLIGHT_UNREADABLE_LIMIT = 0.10
PREFLIGHT_UNREADABLE = ("{share}% of the value column ({value}) could not be read as numbers. "
                        "The wrong column may be mapped.")
PREFLIGHT_BAD_IDS = ("{rows} row(s) have a missing or duplicate {id} and will be "
                     "quarantined out of the analysis.")
PREFLIGHT_NO_ID = ("The expected ID column ({id}) is not present, so per-record "
                   "lookup will be unavailable.")
CLEAN_CONSENT = "Standardized {column} to Yes / No / Unknown."
CLEAN_FILLED = "Filled {cells} missing {column} values with the median ({median})."
CLEAN_FLAGGED = "Flagged {cells} missing {column} values as MISSING."
CLEAN_TIDY = "No cleaning issues found. The data was already tidy."
CLEAN_CUSTOM = "Cleaned the {column} column into numbers, stripping symbols and commas."
HIGH_RISK_TIER = "High Risk"
HEALTH_LOADED = "{rows} {noun} loaded across {columns} columns."
HEALTH_EMPTY = "{share}% of all cells are empty."
HEALTH_EMAILABLE = "{share}% are marked emailable."
HEALTH_LAPSED = "{share}% have not visited in over {days} days."
HEALTH_UNCONTACTED = "{share}% not contacted in over {months} months."
HEALTH_HIGH_RISK = "{share}% sit in the {tier} tier."
HEALTH_PARSED = "{share}% of the value column parsed into clean numbers."
TREND_NO_DECLINES = "No players are declining versus the prior period."
TREND_HIGH_VALUE = ("Start with {name}: a high-value player worth {value}/day whose play is down "
                    "{drop}% versus last period. Of your {decliners} decliners, {high_value} are "
                    "high value, those are the calls that protect the most revenue.")
TREND_LOW_VALUE = ("{decliners} players are declining, but none are in your high-value segments, "
                   "so these are lower priority than an active VIP would be.")
INSIGHT_SEGMENT = ("Your largest segment by value is {segment}, holding {total} ({value_share}% of "
                   "all value) from {record_share}% of records. When a small share of records "
                   "holds most of the value, focus your effort there first.")
INSIGHT_NO_VALUES = "No numeric values to analyze."
INSIGHT_DISTRIBUTION = ("The median value is {median} and the top 10% of records hold about "
                        "{share}% of total value. A wide gap between median and top means value is "
                        "concentrated in a few records.")
INSIGHT_PARETO = ("{category} alone accounts for {share}% of total offer dollars. Categories that "
                  "drive most of the spend are where small changes move the budget most.")
COMP_BAND_BETWEEN = "{tier} band ({low} to {high})"
COMP_BAND_ABOVE = "{tier} band (above {low})"
COMP_BAND_NONE = "{tier} band"
COMP_REASON_BETWEEN = ("NetADT of {value} falls between {low} and {high}, so a {tier} matches "
                       "their value without over-investing on a lower-value player or "
                       "under-rewarding a higher one.")
COMP_REASON_ABOVE = ("NetADT of {value} is above the top cutoff of {low}, so the {tier} tier fits, "
                     "the highest offer for the most valuable players.")
COMP_REASON_NONE = "NetADT of {value} sits in the entry tier."
HOST_AT_RISK = ("High value ({value}/day) and {absence}. Prime win-back call, reach out before "
                "they are gone.{decline}")
HOST_VIP = ("Top-tier value ({value}/day) and active. Strengthen the relationship and keep them "
            "loyal.{decline}")
HOST_OTHER = "Value {value}/day. Worth a personal touch.{decline}"
HOST_DECLINE = " Play is down {drop}% versus the prior period."
HOST_UNSEEN = "not seen in {days} days"
HOST_QUIET = "gone quiet"
EXPLAIN_PLAYER_NONE = "This player has no NetADT value, so they were set aside for review."
EXPLAIN_PLAYER_HIGH = ("Their NetADT of {value} is in the top quartile (cutoff {cut}), so they "
                       "count as high value.")
EXPLAIN_PLAYER_LOW = "Their NetADT of {value} is below the high value cutoff of {cut}."
EXPLAIN_PLAYER_LAPSED = ("They have not visited in {days} days, past the {limit} day mark, so "
                         "recency flags them as drifting away.")
EXPLAIN_PLAYER_RECENT = "They visited {days} days ago, which is recent."
EXPLAIN_PLAYER_SEEN = "They last visited {days} days ago."
EXPLAIN_PLAYER_SEGMENT = "Together that places them in the {segment} segment."
EXPLAIN_COMPANY_NONE = "This account has no revenue figure, so it was set aside for review."
EXPLAIN_COMPANY_HIGH = ("Its revenue of {value} is in the top quartile (cutoff {cut}), so it is a "
                        "large account.")
EXPLAIN_COMPANY_LOW = "Its revenue of {value} is below the large account cutoff of {cut}."
EXPLAIN_COMPANY_LEVERAGED = ("Its debt to equity ratio of {ratio} is above {limit}, which signals "
                             "heavy leverage.")
EXPLAIN_COMPANY_HEALTHY = "Its debt to equity ratio of {ratio} is within a healthy range."
EXPLAIN_COMPANY_COLD = "It has not been contacted in {months} months."
EXPLAIN_COMPANY_SEGMENT = "Together that places it in the {segment} segment."
EXPLAIN_CUSTOM_NONE = "This record has no usable {column}, so it was set aside for review."
EXPLAIN_CUSTOM = ("Its {column} of {value} is {tier} (top cutoff {cut}), placing it in the "
                  "{segment} segment.")
EXPLAIN_CUSTOM_TOP, EXPLAIN_CUSTOM_BELOW = "in the top tier", "below the top tier"

# Value bands.
BAND_COUNT = 5
BAND_LABEL_PRECISION = 3
