"""Fixed values of lead normalisation, validation, extraction and scoring."""

# Words that don't identify a business.
NAME_STOPWORDS = (
    "llc", "l", "inc", "incorporated", "co", "corp", "corporation", "company", "ltd", "limited",
    "pllc", "pc", "lp", "llp", "the", "and", "of", "group", "services", "service",
)
# Local parts of shared inboxes.
ROLE_LOCAL_PARTS = (
    "info", "sales", "admin", "contact", "office", "support", "hello", "help", "team", "service", "services",
    "billing", "accounts", "accounting", "marketing", "hr", "jobs", "careers", "noreply", "no-reply", "webmaster",
    "enquiries", "inquiries", "frontdesk", "reception", "customerservice", "mail", "general",
)
# Mail providers of private persons.
FREE_PROVIDERS = (
    "gmail.com", "googlemail.com", "yahoo.com", "ymail.com", "outlook.com", "hotmail.com", "live.com", "msn.com",
    "aol.com", "icloud.com", "me.com", "mac.com", "comcast.net", "att.net", "verizon.net", "sbcglobal.net",
    "bellsouth.net", "protonmail.com", "proton.me", "zoho.com", "gmx.com",
)
# Misspelt providers.
DOMAIN_TYPOS = {
    "gmial.com": "gmail.com", "gmal.com": "gmail.com", "gmaill.com": "gmail.com", "gnail.com": "gmail.com",
    "gmail.con": "gmail.com", "gmail.co": "gmail.com", "gmail.cm": "gmail.com", "gmial.con": "gmail.com",
    "yaho.com": "yahoo.com", "yahooo.com": "yahoo.com", "yahoo.con": "yahoo.com",
    "hotmial.com": "hotmail.com", "hotmail.con": "hotmail.com", "hotmai.com": "hotmail.com",
    "outlok.com": "outlook.com", "outlook.con": "outlook.com", "aol.con": "aol.com", "icloud.con": "icloud.com",
}
# Seeds of the disposable-domain dimension table.
DISPOSABLE_SEED = ("mailinator.com", "guerrillamail.com", "10minutemail.com", "tempmail.net")
# Header aliases in order of preference.
FIELD_ALIASES = {
    "company_name": ("companyname", "company", "businessname", "business", "name", "organization", "accountname"),
    "website": ("website", "url", "web", "domain", "companywebsite", "site", "homepage"),
    "phone": ("phone", "phonenumber", "telephone", "tel", "companyphone", "mainphone", "mobile"),
    "email": ("email", "emailaddress", "owneremail", "contactemail", "workemail"),
    "owner_name": ("ownername", "owner", "contactname", "contact", "fullname", "decisionmaker", "person"),
    "owner_title": ("ownertitle", "title", "jobtitle", "contacttitle", "position", "role"),
    "city": ("city", "town", "locality"),
    "state": ("state", "region", "province", "st"),
    "industry": ("industry", "category", "sector", "vertical", "businesstype"),
    "revenue": ("estimatedrevenue", "revenue", "annualrevenue", "sales", "revenueestimate"),
    "employees": ("employees", "employeecount", "numberofemployees", "headcount", "size", "companysize", "staff"),
    "year_founded": ("yearfounded", "founded", "foundedyear", "yearestablished", "established", "since"),
    "linkedin": ("linkedin", "linkedinurl", "companylinkedin", "linkedinprofile"),
}
# Revenue by head, first hit wins.
REVENUE_PER_HEAD = (
    (("roof",), 250_000),
    (("dental", "dentist"), 220_000),
    (("hvac", "heating", "air"), 200_000),
    (("electric",), 190_000),
    (("plumb",), 180_000),
    (("it ", "it services", "managed it", "technology", "software"), 180_000),
    (("medical", "health", "clinic"), 170_000),
    (("auto", "car repair"), 160_000),
    (("account", "bookkeep", "cpa", "tax"), 150_000),
    (("pest",), 140_000),
    (("landscap", "lawn"), 110_000),
    (("restaurant", "food"), 70_000),
    (("clean", "janitorial"), 60_000),
)
DEFAULT_REVENUE_PER_HEAD = 150_000
# Map tags by industry keyword; the generic group counts only alone.
INDUSTRY_TAGS = (
    (("hvac", "heating", "air conditioning"), ("craft=hvac",)),
    (("plumb",), ("craft=plumber",)),
    (("electric",), ("craft=electrician",)),
    (("roof",), ("craft=roofer",)),
    (("landscap", "lawn", "garden"), ("craft=gardener", "shop=garden_centre")),
    (("pest",), ("craft=pest_control", "shop=pest_control")),
    (("clean", "janitorial"), ("shop=dry_cleaning", "office=cleaning", "craft=cleaning")),
    (("account", "bookkeep", "cpa", "tax"), ("office=accountant", "office=tax_advisor")),
    (("it service", "managed it", "software", "technology", "it support"), ("office=it", "office=company", "craft=computer")),
    (("law", "legal", "attorney"), ("office=lawyer",)),
    (("insurance",), ("office=insurance",)),
    (("real estate", "realtor"), ("office=estate_agent",)),
    (("financial", "finance", "wealth"), ("office=financial", "office=financial_advisor")),
    (("dental", "dentist"), ("amenity=dentist", "healthcare=dentist")),
    (("health", "medical", "clinic", "doctor"), ("amenity=clinic", "amenity=doctors", "healthcare=clinic", "healthcare=doctor")),
    (("veterin", "animal"), ("amenity=veterinary",)),
    (("auto", "car repair", "mechanic"), ("shop=car_repair",)),
    (("restaurant", "food"), ("amenity=restaurant",)),
    (("manufactur", "fabricat", "machine shop"), ("man_made=works", "craft=metal_construction")),
    (("construct", "contractor", "builder"), ("craft=builder", "office=construction_company")),
    (("retail", "store", "shop"), ("shop",)),
)
GENERIC_GROUP = 19
# Scoring.
WEIGHTS = {"revenue": 25, "employees": 15, "age": 15, "industry": 15, "owner": 10, "email": 10, "phone": 5, "website": 5}
BONUS = {"signals": 5, "reputation": 5}
TIER_A, TIER_B = 75, 50
PRESETS = {
    "home_services": {
        "revenue_min": 1_000_000, "revenue_max": 10_000_000, "employees_min": 5, "employees_max": 50, "min_years": 10,
        "target_industries": ("hvac", "plumbing", "landscaping", "lawn", "electrical", "electric", "pest", "roofing", "cleaning", "janitorial", "pool", "garage door", "restoration"),
        "excluded_industries": ("software", "startup", "crypto", "restaurant"),
    },
    "b2b_services": {
        "revenue_min": 2_000_000, "revenue_max": 15_000_000, "employees_min": 10, "employees_max": 100, "min_years": 8,
        "target_industries": ("it services", "managed it", "accounting", "bookkeeping", "cpa", "staffing", "insurance", "consulting", "marketing", "logistics", "commercial cleaning", "janitorial", "payroll"),
        "excluded_industries": ("software startup", "crypto", "restaurant", "retail"),
    },
    "general": {
        "revenue_min": 1_000_000, "revenue_max": 20_000_000, "employees_min": 5, "employees_max": 150, "min_years": 10,
        "target_industries": (),
        "excluded_industries": ("software startup", "crypto", "startup"),
    },
}
# Titles of owners, and signs of a change of hands.
OWNER_TITLES = "owner|founder|president|ceo|principal|partner|proprietor"
SUCCESSION = "family|generation|retire|succession|owner-operated|founder"
# Page signals, in order.
SIGNALS = (
    (r"family[- ]owned|family[- ]operated|family business", "Family-owned"),
    (r"(second|third|fourth|2nd|3rd|4th)[- ]generation", "Multi-generation family business"),
    (r"owner[- ]operated|locally owned and operated|owner on (every|each) job", "Owner-operated"),
    (r"veteran[- ]owned", "Veteran-owned"),
    (r"woman[- ]owned|women[- ]owned", "Woman-owned"),
    (r"(owner|founder) (is )?(retiring|plans to retire)|succession|transition(ing)? ownership", "Mentions retirement or succession"),
    (r"now hiring|join our team|careers", "Hiring"),
)
# Words around person names.
LEAD_WORDS = ("meet", "contact", "call", "about", "our", "the", "by", "with", "hi", "hello", "welcome", "from", "email", "ask", "local", "your", "dear", "mr", "mrs", "ms", "dr")
NOT_NAME_WORDS = ("us", "today", "now", "team", "services", "service", "company", "operated", "owned", "heating", "plumbing", "air", "electric", "roofing", "llc", "inc", "free", "estimate", "quote", "home", "page", "contact", "and", "our")
# Similarity of names that match.
NAME_SIMILARITY = 0.88
