"""Closed vocabularies, and fixed lists and tables of the data model."""

APPROVED, PENDING, REJECTED = "APPROVED", "PENDING", "REJECTED"
REVIEW_STATUSES = (PENDING, APPROVED, REJECTED)

# Fixed values.
STAGES = ("Seed", "Series A", "Series B", "Series C", "Series D", "Series E", "Series F", "Late stage", "Public", "Acquired")
COMPANY_STATUSES = ("Private", "Public", "Acquired")
SECTORS = (
    "Artificial intelligence",
    "Fintech",
    "Financial services",
    "Healthcare",
    "Climate",
    "Energy",
    "Enterprise SaaS",
    "Real estate",
    "Transport",
    "Consumer & retail",
    "Media & telecom",
    "Education",
    "Industrials",
    "Technology",
)
OPERATING_STATUSES = ("Active", "Closed")
COMPANY_TYPES = ("For profit", "Non-profit")
INVESTOR_TYPES = ("Venture", "Growth", "Angel", "Corporate", "Private equity", "Accelerator", "Hedge fund", "Sovereign wealth")
EXIT_TYPES = ("IPO", "Acquisition", "Secondary")
SOURCE_TYPES = ("SEC filing", "Wikidata", "Company website", "Press", "Other")
EDIT_FIELDS = (
    "name", "domain", "one_liner", "description", "hq", "founded", "headcount", "industry", "status", "stage", "total_raised_usd", "last_valuation_usd",
    "website_url", "linkedin_url", "twitter_url", "legal_name", "operating_status", "company_type", "primary_sector",
)
MONEY_FIELDS = ("total_raised_usd", "last_valuation_usd")
REVISABLE_TYPES = ("company", "round", "person", "investor", "acquisition", "exit", "diversity")
REVIEWABLE_TYPES = (*REVISABLE_TYPES, "proposal")
COMPANY_SORTS = ("name", "raised", "valuation")
INVESTOR_SORTS = ("portfolio", "name")

SEC_EDGAR, SEC_ADV, WIKIDATA = "SEC_EDGAR", "SEC_ADV", "WIKIDATA"
ONE_LINER_PREFIX = "Private securities offering disclosed"
DESCRIPTION_MARKER = "filed a Form D"
UNDISCLOSED = "Undisclosed"
UNICORN_USD = 1_000_000_000

# Legal forms that end a company's name, and those that end an investor's name besides.
COMPANY_LEGAL = ("inc", "incorporated", "corp", "corporation", "llc", "ltd", "limited", "co", "company", "plc", "sa", "ag")
INVESTOR_LEGAL = (*COMPANY_LEGAL, "lp", "llp", "lllp", "gmbh", "bv", "nv", "ab", "oy", "as", "pte", "pty", "spa", "srl", "sarl", "kk")

# Words of a firm's name that stay in capitals.
KEEP_UPPER = (
    "LLC", "L.L.C.", "LLP", "LP", "L.P.", "LLLP", "INC", "LTD", "PLC", "GP", "PC", "PA",
    "GMBH", "AG", "NV", "BV", "SA", "SARL", "AB", "AS", "OY", "PTE", "PTY", "SPA", "SRL",
    "USA", "US", "UK", "EU", "LLC.", "CO.", "VC", "PE", "AI", "IT", "ESG", "REIT", "SPV",
)

# Hosts of social networks, and of platforms that host other people's pages.
SOCIAL_HOSTS = ("facebook.com", "twitter.com", "x.com", "instagram.com", "youtube.com", "tiktok.com", "vimeo.com", "threads.net", "bsky.app")
PLATFORM_HOSTS = (
    "medium.com", "crunchbase.com", "wordpress.com", "blogspot.com", "substack.com", "wixsite.com", "wix.com", "squarespace.com",
    "weebly.com", "godaddysites.com", "notion.site", "notion.so", "carrd.co", "about.me", "angel.co", "wellfound.com",
    "sites.google.com", "github.io", "gitbook.io", "bio.link", "linktr.ee", "pitchbook.com", "bloomberg.com", "sec.gov",
)

# The sector of each industry of exempt offerings; None where an industry says nothing.
INDUSTRY_SECTORS = {
    "Agriculture": "Industrials",
    "Airlines and Airports": "Transport",
    "Biotechnology": "Healthcare",
    "Business Services": None,
    "Coal Mining": "Energy",
    "Commercial": "Real estate",
    "Commercial Banking": "Financial services",
    "Computers": "Technology",
    "Construction": "Real estate",
    "Electric Utilities": "Energy",
    "Energy Conservation": "Climate",
    "Environmental Services": "Climate",
    "Health Insurance": "Healthcare",
    "Hospitals and Physicians": "Healthcare",
    "Insurance": "Financial services",
    "Investing": "Financial services",
    "Investment Banking": "Financial services",
    "Lodging and Conventions": "Consumer & retail",
    "Manufacturing": "Industrials",
    "Oil and Gas": "Energy",
    "Other": None,
    "Other Banking and Financial Services": "Financial services",
    "Other Energy": "Energy",
    "Other Health Care": "Healthcare",
    "Other Real Estate": "Real estate",
    "Other Technology": "Technology",
    "Other Travel": "Consumer & retail",
    "Pharmaceuticals": "Healthcare",
    "Pooled Investment Fund": "Financial services",
    "REITS and Finance": "Real estate",
    "Residential": "Real estate",
    "Restaurants": "Consumer & retail",
    "Retailing": "Consumer & retail",
    "Telecommunications": "Media & telecom",
    "Tourism and Travel Services": "Consumer & retail",
}

# Words that tell a sector; the first that a text holds wins.
SECTOR_WORDS = (
    ("artificial intelligence|machine learning", "Artificial intelligence"),
    ("fintech|payment", "Fintech"),
    ("bank|insurance|invest|financial|credit|asset management", "Financial services"),
    ("health|biotech|pharma|medical|hospital", "Healthcare"),
    ("climate|solar|wind power|renewable|carbon|environmental", "Climate"),
    ("oil|gas|petroleum|energy|utilit|sewer|water supply", "Energy"),
    ("software|saas|cloud", "Enterprise SaaS"),
    ("real estate|property|housing|construction|urban planning", "Real estate"),
    ("transport|logistic|airline|railway|shipping|automotive", "Transport"),
    ("retail|restaurant|hotel|tourism|travel|consumer|food", "Consumer & retail"),
    ("telecommunication|media|broadcast|publishing|entertainment", "Media & telecom"),
    ("education|university|school", "Education"),
    ("manufactur|industrial|agricult|forestry|mining|chemical", "Industrials"),
    ("technology|computer|internet|electronics", "Technology"),
)

# The type of an investor by its class, most telling class first; and who is no equity investor.
INVESTOR_CLASSES = (("Q3487908", "Venture"), ("Q5418962", "Private equity"), ("Q4086495", "Accelerator"), ("Q1132207", "Accelerator"), ("Q105611", "Hedge fund"), ("Q1061648", "Sovereign wealth"), ("Q5", "Angel"))
FIRM_CLASSES = ("Q3487908", "Q5418962", "Q4086495", "Q1132207", "Q105611", "Q1061648")
EXCLUDED_INVESTORS = ("Q192247",)
EXCLUDED_CLASSES = ("Q1345691", "Q4936585", "Q327333", "Q484652", "Q5266746")

# Words of a related person's name that make it a firm's.
ENTITY_WORDS = r"(?i)\b(llc|l\.l\.c\.?|lp|l\.p\.?|inc|ltd|corp|fund|capital|management|advis[oe]rs?|partners)\b"
