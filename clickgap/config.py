"""Fixed values and the run configuration.

Everything under "FIXED VALUES" must equal the behaviour being matched
(bucket floors, quantiles, thresholds, word lists); it is stated here once,
in natural order, and imported everywhere else.
"""

from __future__ import annotations

from dataclasses import dataclass, field

# ---------------------------------------------------------------------------
# FIXED VALUES (must match the reference behaviour; do not tune)
# ---------------------------------------------------------------------------

# Expected-CTR floor per position bucket, in bucket order.
CTR_FLOOR = {
    "1-3": 0.15,
    "4-6": 0.08,
    "7-10": 0.04,
    "11-20": 0.015,
    "21+": 0.005,
    "unknown": 0.01,
}
DEFAULT_EXPECTED_CTR = 0.01

# Priority band quantiles: score >= q90 -> P1, >= q70 -> P2, else P3.
PRIORITY_QUANTILES = (0.70, 0.90)

# Priority score weights on log1p(clicks), log1p(opportunity), log1p(impressions).
SCORE_WEIGHTS = (1.0, 1.2, 0.4)

# k-means (when chosen): clusters = max(5, rows / 10).
KMEANS_MIN_K = 5
KMEANS_ROWS_PER_CLUSTER = 10
KMEANS_SEED = 42

# Average-linkage cut: clusters merge while their average cosine distance < this.
LINKAGE_THRESHOLD = 0.75

# Intent confidence = min(0.55 + 0.15 * matched_intents, 0.95).
INTENT_CONF_BASE = 0.55
INTENT_CONF_STEP = 0.15
INTENT_CONF_CAP = 0.95

# Intent precedence, highest first; the fallback is the last one.
INTENT_ORDER = ("navigational", "transactional", "commercial", "informational")

# Cannibalisation flag: match - runner_up < 0.03 and match > 0.12.
CANNIBAL_GAP = 0.03
CANNIBAL_MIN_MATCH = 0.12

# Risk level: |difference| < 0.01 High, < 0.02 Medium, else Low.
RISK_HIGH = 0.01
RISK_MEDIUM = 0.02

# Cluster label: 50 most common n-grams, threshold max(2, int(0.3 * size)).
LABEL_TOP_GRAMS = 50
LABEL_MIN_COUNT = 2
LABEL_SHARE = 0.3

# Rows per cluster kept as examples / representative text.
TOP_QUERIES_PER_CLUSTER = 5

# Recommended actions and their effort levels (1 = low effort).
ACTION_FIX_CANNIBAL = "Fix cannibalisation"
ACTION_LANDING_PAGE = "Build/upgrade landing page"
ACTION_CTR_SNIPPET = "CTR/snippet + internal links"
ACTION_CONTENT_REFRESH = "Content refresh + topical authority"
ACTION_EFFORT_ORDER = {
    "CTR/snippet + internal links": 1,
    "Content refresh + topical authority": 2,
    "Fix cannibalisation": 3,
    "Build/upgrade landing page": 4,
}
EFFORT_LABELS = {
    1: "Low Effort",
    2: "Medium Effort",
    3: "Medium-High Effort",
    4: "High Effort",
}
UNKNOWN_EFFORT_LEVEL = 99
UNKNOWN_EFFORT_LABEL = "Unknown"

# URL path tokens that are dropped.
URL_STOP_TOKENS = ("amp", "utm", "http", "https", "www", "com")

# Characters of an unparsable URL that stand for its path.
UNPARSED_CHARS = 60

# Irregular singular/plural pairs.
IRREGULAR_PLURALS = {
    "child": "children",
    "person": "people",
    "mouse": "mice",
    "foot": "feet",
    "tooth": "teeth",
    "goose": "geese",
}

# Header patterns per field, tried in order (multi-language exports).
REQUIRED_QUERY_FIELDS = {
    "query": ["query", "zoekopdracht", "requête", "consulta", "anfrage", "top queries", "queries", "zoekterm"],
    "clicks": ["clicks", "klikken", "clics", "clic", "klicks", "click"],
    "impressions": ["impressions", "weergaven", "impressions", "impresiones", "impressionen", "weergave", "vertoningen"],
    "ctr": ["ctr", "click-through rate", "taux de clic", "tasa de clics", "clickrate"],
    "position": ["position", "pos", "posizione", "posición", "position", "rang", "rank"],
}
REQUIRED_PAGE_FIELDS = {
    "page": ["page", "url", "pagina", "página", "seite", "top pages", "pages"],
    "clicks": ["clicks", "klikken", "clics", "clic", "klicks", "click"],
    "impressions": ["impressions", "weergaven", "impressions", "impresiones", "impressionen", "weergave", "vertoningen"],
    "ctr": ["ctr", "click-through rate", "taux de clic", "tasa de clics", "clickrate"],
    "position": ["position", "pos", "posizione", "posición", "position", "rang", "rank"],
}

# Default intent keyword lists (the keyword form of the rules).
DEFAULT_INTENT_KEYWORDS = {
    "navigational": ["login", "sign in", "sign up", "contact", "customer service", "phone number"],
    "transactional": ["buy", "order", "pricing", "price", "cost", "quote", "book", "booking",
                      "appointment", "request", "demo", "hire", "agency", "service", "services",
                      "consultant", "company", "near me"],
    "commercial": ["best", "top", "review", "reviews", "vs", "compare", "comparison",
                   "alternative", "alternatives", "rating", "ratings"],
    "informational": ["how", "what", "why", "guide", "tutorial", "definition", "meaning",
                      "example", "examples", "tips"],
}

# Default intent regexes; brand-term regexes are prepended to navigational.
DEFAULT_INTENT_PATTERNS = {
    "navigational": [
        r"\blogin\b", r"\bsign[\s\-]?in\b", r"\bsign[\s\-]?up\b",
        r"\bcontact\b", r"\bcustomer service\b", r"\bphone number\b",
    ],
    "transactional": [
        r"\bbuy\b", r"\border\b", r"\bpricing\b", r"\bprice\b", r"\bcost\b",
        r"\bquote\b", r"\bbook(ing)?\b", r"\bappointment\b", r"\brequest\b",
        r"\bdemo\b", r"\bhire\b", r"\bagency\b", r"\bservice(s)?\b",
        r"\bconsultant\b", r"\bcompany\b", r"\bnear me\b",
        r"\b(in|near)\s+[a-z]{3,}\b",
    ],
    "commercial": [
        r"\bbest\b", r"\btop\b", r"\breview(s)?\b", r"\bvs\b",
        r"\bcompare\b", r"\bcomparison\b", r"\balternative(s)?\b",
        r"\brating(s)?\b",
    ],
    "informational": [
        r"\bhow\b", r"\bwhat\b", r"\bwhy\b", r"\bguide\b",
        r"\btutorial\b", r"\bdefinition\b", r"\bmeaning\b",
        r"\bexample(s)?\b", r"\btips\b",
    ],
}

# Cell texts a CSV export treats as missing (the pandas reader's defaults).
NA_STRINGS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
              "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")

# Brief / report sizes.
BRIEF_TOP_N = 20
CHART_TOP_N = 15
MD_MAX_CELL = 80

# ---------------------------------------------------------------------------
# Scale guards (ours, not part of the matched behaviour)
# ---------------------------------------------------------------------------

# Hashed features of the k-means vectors, at any size.
KMEANS_FEATURES = 1 << 12
# Components of at most this many texts are merged as arrays inside a task
# (three arrays of n x n doubles); larger ones by the same rounds on DataFrames.
DENSE_TEXTS = 2000
# texts of a component that one task merges from sparse sums and edges
SPARSE_TEXTS = 20_000

# ---------------------------------------------------------------------------
# Run configuration
# ---------------------------------------------------------------------------


@dataclass(frozen=True)
class Config:
    """User-set parameters of one run (all optional)."""

    brand_terms: tuple[str, ...] = ()
    competitor_terms: tuple[str, ...] = ()
    local_terms: tuple[str, ...] = ()
    product_brand_terms: tuple[str, ...] = ()
    product_name_terms: tuple[str, ...] = ()
    exclusion_terms: tuple[str, ...] = ()
    # intent -> keyword list; None means "the built-in regex rules".
    intent_keywords: dict[str, list[str]] | None = field(
        default_factory=lambda: {k: list(v) for k, v in DEFAULT_INTENT_KEYWORDS.items()})
    threshold: float = LINKAGE_THRESHOLD
    # "linkage": exact average linkage; "kmeans": k-means. No size picks it.
    method: str = "linkage"
    merge_plurals: bool = False
    client_name: str = "Client"
    # Where a component's merge rounds run (see SPARSE_TEXTS); not what they return.
    max_component: int = SPARSE_TEXTS

    def __post_init__(self):
        if self.method not in ("linkage", "kmeans"):
            raise ValueError(f"unknown clustering method {self.method!r}")
        if not 0.0 < self.threshold <= 1.0:
            raise ValueError("threshold must be in (0, 1]")
