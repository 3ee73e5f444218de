"""Word lists, lookup tables, patterns and constants that results depend on. They are data, not logic."""

from __future__ import annotations

# Patterns, as Java regular expressions.
TOKEN = r"[A-Za-z0-9][A-Za-z0-9&'/-]*"
CURRENCY_CODES = "USD|CAD|EUR|GBP|CNY|RMB|JPY|INR|IDR|AUD|HKD|SGD"
NUMBER = (
    r"(?iU)(?<![\w.])"
    r"((?:US|C|A|HK|S|CN)\$|RMB¥|Rp\.?|[$€£¥₹]|(?:" + CURRENCY_CODES + r")\b)?\s*"
    r"((?:\d{1,3}(?:,\d{3})+|\d+)(?:\.\d+)?)\s*"
    r"(thousand|million|billion|trillion|k|m|bn)?\s*"
    r"(%|percent(?:age)?(?:\s+points?)?|basis\s+points?|bps?|jobs?|employees?|workers?|dollars?|people|customers?|subscribers?|users?|units?|shares?|transactions?|visits?)?\s*"
    r"(\b(?:" + CURRENCY_CODES + r")\b)?"
)
#: A number read together with the character to its left, as without look-behind: one that only white space parts from the number
#: before it is not met, as that white space is read already. For texts that begin with a blank of their own.
NUMBER_AND_LEFT = NUMBER.replace(r"(?<![\w.])", r"[^\w.]")
ENTITY = r"(?U)\b[A-Z][A-Za-z0-9&-]*(?:\s+[A-Z][A-Za-z0-9&-]*)*"
MONTHS = "January|February|March|April|May|June|July|August|September|October|November|December|Jan\\.?|Feb\\.?|Mar\\.?|Apr\\.?|Jun\\.?|Jul\\.?|Aug\\.?|Sep\\.?|Sept\\.?|Oct\\.?|Nov\\.?|Dec\\.?"
MONTH_PERIOD = r"(?iU)\b(" + MONTHS + r")(\s+(?:\d{1,2},\s+)?)(\d{4})\b"
YEAR = r"(?U)\b(?:19|20)\d{2}\b"
QUARTER = r"(?iU)\b(?:q([1-4])|(first|second|third|fourth)\s+quarter)(?:\s+(?:of\s+)?(fy|fiscal\s+year)?\s*((?:19|20)\d{2}))?\b"
QUARTER_YEAR = r"(?iU)\b((?:q[1-4]|(?:first|second|third|fourth)\s+quarter)\s+(?:of\s+)?(?:fy|fiscal\s+year)?\s*)(?:19|20)\d{2}\b"
FISCAL_YEAR = r"(?iU)\b(fy|fiscal\s+year)(\s*)([12]\d{3})\b"
TEMPORAL_YEAR = r"(?iU)\b((?:in|during|for|by|since|until|through|throughout|before|after|from)\s+(?:the\s+)?)((?:19|20)\d{2})\b"
YEAR_RANGE = r"(?iU)\b((?:19|20)\d{2})(\s*(?:to|through|[-–])\s*)((?:19|20)\d{2})\b"

# Abbreviations after which a sentence goes on.
ABBREVIATIONS = ["e.g.", "i.e.", "Mr.", "Mrs.", "Ms.", "Dr.", "Prof.", "Inc.", "Ltd.", "Corp.", "Co.", "No.", "vs."]

# Word lists.
STOPWORDS = "a an and as at be by for from in is it of on or the this to was were with".split()
MONTH_TOKENS = "jan january feb february mar march apr april may jun june jul july aug august sep sept september oct october nov november dec december".split()
METRIC_CUES = (
    "acv arr arpu backlog base billings bookings cash churn conversion cost costs cagr customer customers demand ebit ebitda earnings employment expense "
    "expenses flow gmv growth income jobs margin market price profit ratio rate retention return returns revenue roi sales share size spend subscriber "
    "subscribers transactions units users utilization value visits volume yield"
).split()
SINGLE_WORD_METRICS = ["arr", "acv", "arpu", "gmv", "roi"]
ENTITY_EXCLUSIONS = "all business fiscal full march april may june july results quarterly".split()
IDENTITY_EXCLUSIONS = (
    "basis calendar change changes consumer cpi fiscal headline index month months period periods point points price prices quarter quarters store stores "
    "total year years"
).split() + MONTH_TOKENS + METRIC_CUES

# Metric phrases and their canonical metrics.
METRICS = [
    ("diluted net income per share", "earnings_per_share"),
    ("diluted income per share", "earnings_per_share"),
    ("diluted earnings per share", "earnings_per_share"),
    ("basic net income per share", "earnings_per_share"),
    ("basic income per share", "earnings_per_share"),
    ("basic earnings per share", "earnings_per_share"),
    ("earnings per share", "earnings_per_share"),
    ("net cash provided by operating activities", "operating_cash_flow"),
    ("cash provided by operating activities", "operating_cash_flow"),
    ("cash flow from operating activities", "operating_cash_flow"),
    ("cash flow from operations", "operating_cash_flow"),
    ("operating cash flow", "operating_cash_flow"),
    ("free cash flow", "free_cash_flow"),
    ("nonfarm payroll employment", "payroll_employment"),
    ("nonfarm payrolls", "payroll_employment"),
    ("payroll employment", "payroll_employment"),
    ("payroll jobs", "payroll_employment"),
    ("income from operations", "operating_income"),
    ("profit from operations", "operating_income"),
    ("operating income", "operating_income"),
    ("operating profit", "operating_income"),
    ("operating profit margin", "operating_margin"),
    ("operating margin", "operating_margin"),
    ("gross profit margin", "gross_margin"),
    ("gross margin", "gross_margin"),
    ("gross profit", "gross_profit"),
    ("net income", "net_income"),
    ("net sales", "net_sales"),
    ("net revenues", "revenue"),
    ("net revenue", "revenue"),
    ("revenues", "revenue"),
    ("market share", "market_share"),
    ("market size", "market_size"),
    ("compound annual growth rate", "cagr"),
    ("customer base", "customer_base"),
    ("units sold", "units_sold"),
    ("same-store sales", "same_store_sales"),
    ("gross merchandise value", "gmv"),
    ("book-to-bill ratio", "book_to_bill_ratio"),
    ("operating expenses", "operating_expenses"),
    ("headcount", "headcount"),
    ("revenue", "revenue"),
    ("employment", "employment"),
    ("jobs", "jobs"),
    ("customers", "customers"),
    ("subscribers", "subscribers"),
    ("users", "users"),
    ("sales", "sales"),
    ("ebitda", "ebitda"),
    ("ebit", "ebit"),
    ("gmv", "gmv"),
    ("arr", "arr"),
    ("acv", "acv"),
    ("arpu", "arpu"),
    ("roi", "roi"),
]

# Canonical names by pattern (case-insensitive).
DIRECTIONS = [
    ("increase", r"\b(increas(?:e|ed|es|ing)|grew|growth|rose|risen?|added|gained?|up|improved?)\b"),
    ("decrease", r"\b(decreas(?:e|ed|es|ing)|declin(?:e|ed|es|ing)|fell|fallen|lost|down|reduced?|dropped?)\b"),
    ("stable", r"\b(unchanged|stable|flat|changed little|little change)\b"),
]
QUALIFIERS = [
    ("constant_currency", r"\bconstant[- ]currency\b"),
    ("organic", r"\borganic\b"),
    ("adjusted", r"\badjusted\b"),
    ("non_gaap", r"\bnon[- ]gaap\b"),
    ("gaap", r"\bgaap\b"),
    ("seasonally_adjusted", r"\bseasonally[- ]adjusted\b"),
    ("preliminary", r"\bpreliminary\b"),
    ("estimated", r"\bestimat(?:e|ed|es)\b"),
    ("forecast", r"\bforecast(?:s|ed|ing)?\b"),
    ("projected", r"\bproject(?:ed|ion|ions)\b"),
    ("revised", r"\brevised?\b"),
]
SCOPES = [
    ("universal", r"\b(across all|all|every|broad[- ]based|nationwide|throughout)\b"),
    ("industry", r"\b(industry|industries|sector|sectors)\b"),
    ("geography", r"\b(province|provinces|state|states|region|regions|geograph(?:y|ic|ical)|countries|markets)\b"),
    ("segment", r"\b(segment|segments|customer group|customer groups)\b"),
    ("total_company", r"\b(total|overall|consolidated|company[- ]wide|group[- ]wide|enterprise[- ]wide)\b"),
    ("narrowed", r"\b(segment|segments|division|divisions|business unit|business units|product line|product lines|geographic(?:al)?|regional|portfolio|market|markets|country|countries|customer group|customer groups)\b"),
]
BOILERPLATE_HEADING = r"\b(technical notes?|methodology|definitions?|footnotes?|explanatory notes?)\b"
BOILERPLATE_TEXT = [
    r"\btechnical notes?\b",
    r"\bmethodolog(?:y|ical)\b",
    r"\bdefinitions?\b",
    r"\bfootnotes?\b",
    r"\bsampling (?:error|methods?|procedures?)\b",
    r"\bseasonal[- ]adjustment (?:methods?|procedures?)\b",
    r"\bbenchmark revisions?\b",
    r"\bestimates? (?:are|is) subject to revision\b",
]
HEADING_STRONG = r"\b(abstract|executive summary|summary|key findings?|findings?|highlights?)\b"
HEADING_WEAK = r"\b(overview|introduction|results?)\b"

# Numbers.
MAGNITUDES = {"k": 1000, "thousand": 1000, "m": 1000000, "million": 1000000, "bn": 1000000000, "billion": 1000000000, "trillion": 1000000000000}
WEIGHTS = {
    "number": 9.0,
    "number_unit": 11.0,
    "currency": 4.0,
    "date": 8.0,
    "metric": 10.0,
    "metric_phrase": 8.0,
    "entity": 6.0,
    "direction": 5.0,
    "scope": 6.0,
    "qualifier": 6.0,
    "qualifier_context": 3.0,
    "direction_conflict": 4.0,
    "number_conflict": 4.0,
    "keyword": 0.3,
}
CURRENCIES = {
    "usd": "usd", "us$": "usd", "cad": "cad", "c$": "cad", "eur": "eur", "€": "eur", "gbp": "gbp", "£": "gbp",
    "cny": "cny", "rmb": "cny", "cn$": "cny", "cn¥": "cny", "rmb¥": "cny", "jpy": "jpy", "inr": "inr", "₹": "inr",
    "idr": "idr", "rp": "idr", "rp.": "idr", "aud": "aud", "a$": "aud", "hkd": "hkd", "hk$": "hkd", "sgd": "sgd", "s$": "sgd",
}
