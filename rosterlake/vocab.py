"""The word lists, patterns and thresholds that decide results.

Everything here is data. Changing an entry changes which organisations merge,
which contacts are kept and how they score, so the values are stated once, in
their natural order, and every function takes them from here.
"""

# --- record enums ------------------------------------------------------------

# Fixed values.
STREAMS = ("Engineering", "BCA")
STATUSES = ("Verified", "Needs Follow-up", "Failed")
OUTREACH = ("New", "Contacted", "Responded")
RUN_STATUSES = ("running", "completed", "failed", "cancelled")

# --- import ------------------------------------------------------------------

# Cell texts that mean "no value".
PLACEHOLDERS = (
    "", "-", "--", "n/a", "na", "nil", "none", "null", "not available",
    "not found", "nan", "#n/a", "tbd", "?",
)

# Further texts a spreadsheet reader turns into "no value".
READER_NULLS = (
    "<NA>", "#N/A N/A", "#NA", "-nan", "-NaN", "1.#IND", "-1.#IND", "1.#QNAN", "-1.#QNAN",
)

# Header spellings per store field, first field first.
HEADER_ALIASES = (
    ("college_name", ("collegename", "college", "institutename", "institution", "name",
                      "nameofthecollege", "nameoftheinstitution")),
    ("state", ("state", "statename")),
    ("district", ("district", "city", "location", "place", "town")),
    ("stream", ("stream", "course", "programme", "program", "type", "category")),
    ("affiliation", ("affiliation", "affiliatedto", "university", "board")),
    ("website", ("website", "url", "weburl", "websiteurl", "site", "webaddress")),
    ("placement_officer_name", ("placementofficer", "placementofficername", "tponame",
                                "contactperson", "contactname", "person", "spoc")),
    ("placement_email", ("placementemail", "tpoemail", "placementmail", "officialemail",
                         "primaryemail", "mainemail", "bestemail", "contactemail",
                         "emailid", "email", "mail", "emailaddress")),
    ("placement_phone", ("placementphone", "tpophone", "placementcontact", "phone", "mobile",
                         "contact", "contactno", "phoneno", "phonenumber", "mobileno",
                         "telephone")),
    ("fallback_contact_email", ("allemailsfound", "allemails", "alternateemail",
                                "secondaryemail", "backupemail", "otheremail", "generalemail",
                                "fallbackemail", "additionalemails")),
    ("fallback_contact_phone", ("allphonesfound", "allphones", "alternatephone",
                                "secondaryphone", "backupphone", "otherphone", "generalphone",
                                "landline", "fallbackphone", "additionalphones")),
)

# Headers of the phone column in a phone roster.
ROSTER_PHONE_HEADERS = (
    "allphonesfound", "allphones", "phones", "phone", "mobile", "contact",
    "contactno", "phoneno", "phonenumber", "mobileno", "telephone", "landline",
)

# --- names -------------------------------------------------------------------

# Suffix phrases, tried in this order.
NAME_SUFFIXES = (
    "college of engineering and technology",
    "college of engineering & technology",
    "institute of engineering and technology",
    "institute of technology and science",
    "college of engineering",
    "institute of technology",
    "school of engineering",
    "engineering college",
    "college of science",
    "degree college",
    "first grade college",
    "autonomous",
    "deemed to be university",
    "deemed university",
)

# Short form -> full word.
ABBREVIATIONS = {
    "inst": "institute",
    "instt": "institute",
    "engg": "engineering",
    "engnrg": "engineering",
    "tech": "technology",
    "technolgy": "technology",
    "clg": "college",
    "coll": "college",
    "univ": "university",
    "sci": "science",
    "mgmt": "management",
    "std": "studies",
}

# Titles and articles.
NOISE_WORDS = (
    "sri", "shri", "shree", "sree", "smt", "dr", "prof", "late",
    "the", "of", "a", "an",
)

# Place words that do not tell two organisations apart.
PLACE_WORDS = (
    "bangalore", "bengaluru", "mysore", "mysuru", "mangalore", "mangaluru",
    "belgaum", "belagavi", "hubli", "hubballi", "dharwad", "gulbarga",
    "kalaburagi", "davangere", "shimoga", "shivamogga", "tumkur", "tumakuru",
    "bellary", "ballari", "bijapur", "vijayapura", "udupi", "manipal",
    "hassan", "mandya", "kolar", "bidar", "raichur", "koppal", "gadag",
    "haveri", "chitradurga", "karnataka", "east", "west", "north", "south",
    "new", "central", "city", "rural", "urban",
)

# --- phones ------------------------------------------------------------------

# Fixed value: dates and year ranges that look like phone numbers.
DATE_LIKE = (
    r"\b(?:\d{1,2}[./-]\d{1,2}[./-]\d{2,4}"
    r"|\d{4}[-/]\d{2,4}"
    r"|(?:19|20)\d{2}\s*[-–]\s*(?:19|20)?\d{2})\b"
)

# Fixed value: a phone number written in running text.
PHONE_IN_TEXT = (
    r"(?<![\d])(?:\+?\s?91[\s\-]?)?(?:\(?0?\d{2,5}\)?[\s\-]?)?"
    r"\d{3,5}[\s\-]?\d{3,5}(?![\d])"
)

# --- emails ------------------------------------------------------------------

# Fixed values. \w is written out as letters, digits and underscore.
EMAIL_IN_CELL = r"[\p{L}\p{N}_.+\-]+@[\p{L}\p{N}_\-]+\.[\p{L}\p{N}_.\-]+"
EMAIL_IN_TEXT = r"[\p{L}\p{N}_.+-]+@[\p{L}\p{N}_-]+\.[\p{L}\p{N}_.-]+"

# Fixed value: addresses in page text that are never a contact.
JUNK_EMAIL = (
    r"noreply|no-reply|donotreply|postmaster|webmaster|example\.|sentry|"
    r"\.png|\.jpg|\.gif|wixpress|godaddy|@2x"
)

# Local-part lists for scoring.
PLACEMENT_LOCALS = (
    "tpo", "placement", "placements", "placementcell", "placement_cell",
    "trainingandplacement", "training_placement", "trainingplacement",
    "spo", "cdc", "careerdevelopment", "career_development", "career",
    "careers", "corporaterelations", "industryrelations",
)
GENERIC_LOCALS = (
    "info", "contact", "enquiry", "enquiries", "admin", "office", "mail",
    "reception", "help", "support", "webmaster", "admission", "admissions",
    "principal", "director", "registrar", "hod", "dean",
)
JUNK_LOCALS = (
    "noreply", "no-reply", "donotreply", "do-not-reply", "postmaster",
    "abuse", "mailer-daemon", "example", "test", "sample", "your", "email",
)
FREE_MAIL_HOSTS = (
    "gmail.com", "yahoo.com", "yahoo.co.in", "hotmail.com", "outlook.com",
    "rediffmail.com", "live.com", "aol.com", "protonmail.com", "ymail.com",
)

# Fixed value: wording that marks a page as a placement page.
PLACEMENT_WORDING = (
    r"\b(training\s*(and|&)?\s*placement|placement\s*(cell|officer|coordinator)?|"
    r"t\.?p\.?o\.?|career\s*(development|guidance|cell)|campus\s*recruitment|"
    r"corporate\s*relations|industry\s*(relations|interaction))\b"
)

# URL parts that mark a placement page.
PLACEMENT_URL_HINTS = ("placement", "tpo", "career", "training")

# Local-part starts preferred when filling a missing email.
FILL_PLACEMENT_PREFIXES = ("tpo", "placement", "training", "career", "spo", "cdc")

# Confidence bands.
PLACEMENT_SCORE = 70
PROBABLE_SCORE = 40

# Key names in extraction payloads, first match wins.
EMAIL_KEYS = ("address", "email", "value")
PHONE_KEYS = ("normalized", "raw", "number", "phone", "value")

# --- sites -------------------------------------------------------------------

# Fixed values.
EDU_TLDS = (".ac.in", ".edu.in", ".edu", ".ernet.in")
WEAK_TLDS = (".org.in", ".nic.in", ".gov.in", ".org", ".in", ".com", ".net")
OWNERSHIP_TLDS = (".ac.in", ".edu.in", ".edu", ".org.in", ".nic.in", ".gov.in", ".ernet.in")
LISTING_PATH = (
    r"/(colleges?|institutes?|universit(y|ies)|listing|directory|search|compare)[-/]"
)
AGGREGATOR_DOMAIN_WORDS = (
    "college", "admission", "exam", "career", "study", "student", "edu-",
    "ranking", "review", "compare", "search", "list", "info", "guide",
)
MIN_SITE_SCORE = 40

# Domains that are never an organisation's own site.
BLOCKED_DOMAINS = (
    "collegedunia.com", "shiksha.com", "careers360.com", "collegesearch.in",
    "getmyuni.com", "collegedekho.com", "indiacollegesearch.com", "targetstudy.com",
    "icbse.com", "edufever.com", "collegepravesh.com", "sarvgyan.com",
    "minglebox.com", "successcds.net", "aglasem.com", "justdial.com",
    "indiamart.com", "sulekha.com", "facebook.com", "linkedin.com",
    "twitter.com", "x.com", "instagram.com", "youtube.com",
    "wikipedia.org", "quora.com", "indeed.com", "naukri.com",
    "glassdoor.co.in", "governmentjobs.com", "monster.com", "shine.com",
    "timesjobs.com", "freshersworld.com",
)

# Words left out of an acronym.
ACRONYM_SKIP = ("of", "the", "and", "for", "in", "at")
INSTITUTION_ACRONYM_SKIP = (
    "college", "institute", "academy", "school", "technology",
    "engineering", "university", "science", "management",
)

# --- pages -------------------------------------------------------------------

# Path parts in order of promise.
LINK_HINTS = (
    "training-and-placement", "training_placement", "placement-cell", "placementcell",
    "tpo", "placements", "placement", "career", "careers", "recruiters",
    "campus-recruitment", "training", "contact-us", "contact", "about",
)
SKIP_EXTENSIONS = (
    ".pdf", ".doc", ".docx", ".xls", ".xlsx", ".ppt", ".pptx",
    ".zip", ".rar", ".jpg", ".jpeg", ".png", ".gif", ".svg",
    ".mp4", ".mp3", ".avi",
)
SKIP_SCHEMES = ("mailto:", "tel:", "javascript:", "data:")
GUESS_PATHS = (
    "/placement", "/placements", "/placement-cell", "/training-and-placement",
    "/contact", "/contact-us",
)
FILL_PATHS = ("", "/contact-us", "/contact", "/placement", "/placements")
PAGE_BUDGET = 8
PAGE_ATTEMPTS = 12
CRAWL_DEPTH = 2
CRAWL_PAGES = 12
SEED_PRIORITY = 99

# Markup patterns.
ANCHOR_HREF = r"""(?i)<a\s[^>]*href\s*=\s*["']([^"'#]+)"""
NAME_MARKUP = r"(?is)<(?:h[23]|a)[^>]*>(.*?)</(?:h[23]|a)>"
OBFUSCATED_EMAIL = (
    r'(?:data-cfemail="|/cdn-cgi/l/email-protection#)([0-9a-fA-F]+)'
)

# --- seed channels -----------------------------------------------------------

# Listing sites that are no source of record.
NON_AUTHORITATIVE = (
    "collegedunia", "shiksha", "careers360", "collegesearch", "getmyuni",
    "collegedekho", "targetstudy", "icbse", "edufever", "collegepravesh",
    "sarvgyan", "minglebox", "successcds", "aglasem", "zollege", "campusoption",
    "careermudhra", "justdial", "indiamart", "sulekha", "wikipedia", "quora",
    "youtube", "facebook", "linkedin", "bing.com/aclk",
)
AUTHORITATIVE_DOMAINS = (
    "aicte-india.org", "aicte.gov.in", "vtu.ac.in", "dtekarnataka",
    "kea.kar.nic.in", "dte.kar.nic.in",
)
OFFICIAL_TLDS = (".gov.in", ".nic.in", ".ac.in", ".edu.in")
LISTING_HINTS = (
    "college", "institut", "affiliat", "approved", "autonomous", "directory",
    "list", "polytechnic",
)
AGGREGATOR_HOSTS = (
    "collegedunia.com", "shiksha.com", "careers360.com", "getmyuni.com",
    "collegedekho.com", "targetstudy.com", "zollege.in", "collegesearch.in",
)
NAME_HEADERS = ("college", "institution", "institute", "name of")
DISTRICT_HEADERS = ("district", "place", "location", "city")
SEED_TTL_DAYS = 30

# Listing-name patterns (all case-insensitive).
BADGE_PREFIX = r"^(featured|sponsored|promoted|new|popular|trending|verified|ad)\s+"
LISTING_NOISE = (
    r"\s*[-–—,:|]\s*(admission|fees?|cutoff|placement|ranking|review|course|"
    r"eligibility|\d{4})\b.*$"
)
INSTITUTION_WORDS = (
    r"\b(college|institute|university|school|academy|polytechnic|vidyalaya|"
    r"vidyapeeth|institution)\b"
)
CATEGORY_PATTERNS = (
    r"\bcolleges\s+(in|for|accepting|near)\b",
    r"\b(universities|institutes|schools)\s+(in|for|near)\b",
    r"\b(predictors?|comparison|compare|ranking|rank\s+list|calculator|"
    r"counselling|counseling|brochure|application\s+form|news|article|"
    r"exams?|results?|syllabus|question\s+paper|mock\s+test|"
    r"admission\s+test|entrance\s+test|cut\s?off)\b",
    r"^\s*(top|best|all|list\s+of|popular|view\s+all|explore|browse|"
    r"more|other|related|similar)\b",
    r"^\s*(b\.?\s?tech|m\.?\s?tech|b\.?\s?e\b|m\.?\s?e\b|b\.?\s?sc|"
    r"m\.?\s?sc|bca|mca|mba|diploma|phd|certificate)\b",
    r"^\s*(write|find|search|get|see|check|apply|download|read|view|"
    r"add|submit|claim|register|join|start|know|discover)\b",
    r"\b(placements?|admissions?|courses?|fees|cutoffs?|reviews?|"
    r"rankings?|results?|news|blog|gallery|scholarships?|"
    r"eligibility|infrastructure|facilities|hostel)\s*$",
)
# Fixed value: "SHORT - Full Name" (case-sensitive).
ALIAS_PREFIX = r"^([A-Z][A-Za-z\.]{1,12}(?:\s+[A-Z][a-z]+)?)\s*[-–—]\s*(.+)$"
GENERIC_TOKENS = (
    "college", "colleges", "institute", "institutes", "institution", "university",
    "universities", "school", "schools", "academy", "polytechnic", "of", "the",
    "and", "in", "for", "engineering", "technology", "technical", "science",
    "sciences", "management", "studies", "research", "education", "arts",
    "commerce", "computer", "applications", "application", "top", "best", "all",
    "list", "government", "private", "autonomous", "deemed", "affiliated",
    "india", "indian", "state", "national",
)

# Names of places abroad.
FOREIGN_MARKERS = (
    "massachusetts", "stanford", "harvard", "oxford", "cambridge university", "brunel",
    "texas", "california", "london", "toronto", "melbourne", "sydney", "singapore", "malaysia",
    "dubai", "edge hill", "nanyang", "monash", "leeds", "manchester", "birmingham", "glasgow",
)

# Cities and regions outside the states in scope.
OUT_OF_SCOPE_PLACES = (
    "mohali", "chandigarh", "punjab", "ludhiana", "amritsar", "jalandhar", "patiala",
    "mumbai", "pune", "nagpur", "nashik", "thane", "aurangabad",
    "delhi", "noida", "gurgaon", "gurugram", "faridabad", "ghaziabad",
    "jaipur", "jodhpur", "udaipur", "kota",
    "lucknow", "kanpur", "varanasi", "allahabad", "agra", "meerut",
    "kolkata", "howrah", "durgapur", "siliguri",
    "bhopal", "indore", "gwalior", "jabalpur",
    "ahmedabad", "surat", "vadodara", "rajkot", "gandhinagar",
    "patna", "ranchi", "jamshedpur", "bhubaneswar", "cuttack",
    "dehradun", "roorkee", "shimla", "srinagar", "jammu",
    "guwahati", "bhilai", "raipur", "nagaland", "manipur",
)

# --- growing -----------------------------------------------------------------

# State and stream pairs in the order they are tried.
GROW_TARGETS = (
    ("Karnataka", "Engineering"),
    ("Tamil Nadu", "Engineering"),
    ("Andhra Pradesh", "Engineering"),
    ("Karnataka", "BCA"),
    ("Tamil Nadu", "BCA"),
    ("Andhra Pradesh", "BCA"),
)
ABORT_AFTER = 25
ABORT_BELOW = 0.10
