"""Phrase, pattern and domain lists, as data."""

from __future__ import annotations

# Results depend on these words, patterns and domains, and on their order.

HIRING_KEYWORDS = [
    "hiring", "we re hiring", "we are hiring", "now hiring", "looking for", "open position", "open positions",
    "open role", "open roles", "opening", "openings", "vacancy", "vacancies", "join our team", "join us", "apply",
    "apply now", "applications open", "jd", "job description", "ctc", "lpa", "walk in", "walkin",
    "immediate joiner", "immediate joiners", "notice period", "referral", "send your resume", "share your resume",
    "share your cv", "send your cv",
]

SEEKER_PHRASES = [
    "opentowork", "open to work", "i am looking for a job", "i m looking for a job",
    "i am looking for a new role", "i m looking for a new role", "i am looking for new opportunities",
    "i m looking for new opportunities", "i am actively looking", "i m actively looking", "actively seeking",
    "open to opportunities", "open to new opportunities", "seeking new opportunities", "looking for my next role",
    "looking for my next opportunity", "i was laid off", "i have been laid off", "i ve been laid off",
]

NOT_HIRING_PHRASES = [
    "starting a new position", "started a new position", "i got hired", "i have been hired", "i ve been hired",
    "i got placed", "i have joined", "i ve joined", "excited to announce that i", "happy to share that i",
    "thrilled to share that i", "i got an offer", "i received an offer",
]

BAIT_PHRASES = [
    "comment interested", "comment yes", "comment done", "comment below", "comment link", "comment for the link",
    "comment to get the link", "comment below for referral", "comment for referral",
    "drop your email in the comments", "drop your email in comments", "drop your mail id", "drop your email id",
    "drop your email", "like and repost", "like and share", "like share", "repost for reach",
    "repost for better reach", "repost for maximum reach", "follow me", "must follow", "follow me for more",
    "tag 3 friends", "tag three friends", "tag your friends", "tag someone who", "inbox you", "i ll dm you",
    "i will dm you", "to get the link", "to receive the link",
]

WEAK_BAIT_WORDS = [
    "comment", "comments", "dm", "inbox", "repost", "tag", "follow",
]

DM_PHRASES = [
    "dm me", "dm us", "send me a dm", "send a dm", "drop a dm", "message me", "inbox me", "ping me",
    "reach out to me",
]

JOB_CONTEXT_WORDS = [
    "job", "jobs", "work from home", "wfh", "part time", "earn", "earning", "earnings", "income", "opportunity",
    "payout",
]

SCAM_PHRASES = [
    "registration fee", "registration charges", "security deposit", "training fee", "training fees",
    "refundable fee", "refundable deposit", "processing fee", "joining fee", "pay to join", "aadhaar", "aadhar",
    "pan card", "bank details", "bank account details", "no interview", "without interview",
    "part time typing job", "typing job", "data entry work from home", "task based earning", "task based job",
    "guaranteed job", "job guarantee", "100 job guarantee",
]

TECH_TERMS = [
    "javascript", "typescript", "react", "angular", "vue", "node", "nodejs", "next js", "nextjs", "python",
    "django", "flask", "fastapi", "java", "spring", "spring boot", "kotlin", "swift", "golang", "rust", "c++",
    "csharp", "dotnet", "php", "laravel", "ruby", "rails", "sql", "mysql", "postgres", "postgresql", "mongodb",
    "redis", "kafka", "spark", "hadoop", "aws", "azure", "gcp", "docker", "kubernetes", "terraform", "linux",
    "devops", "machine learning", "deep learning", "pytorch", "tensorflow", "llm", "nlp", "data science",
    "flutter", "react native", "android", "ios", "figma", "salesforce", "sap", "tableau", "power bi", "excel",
    "selenium", "graphql", "microservices",
]

ROLE_TERMS = [
    "engineer", "developer", "programmer", "architect", "manager", "analyst", "designer", "scientist", "intern",
    "internship", "consultant", "executive", "specialist", "associate", "lead", "director", "sde", "sde1", "sde2",
    "sde 1", "sde 2", "qa", "tester", "recruiter", "accountant", "administrator", "coordinator", "officer",
    "representative", "technician", "writer", "marketer", "product owner", "scrum master", "full stack",
    "fullstack", "backend", "frontend", "devops engineer", "sre",
]

LOCATION_TERMS = [
    "remote", "hybrid", "onsite", "on site", "work from office", "wfo", "wfh", "location", "bangalore",
    "bengaluru", "hyderabad", "pune", "mumbai", "delhi", "new delhi", "ncr", "gurgaon", "gurugram", "noida",
    "chennai", "kolkata", "ahmedabad", "kochi", "jaipur", "indore", "chandigarh", "coimbatore", "london",
    "berlin", "dublin", "amsterdam", "paris", "new york", "san francisco", "seattle", "austin", "boston",
    "toronto", "singapore", "dubai", "sydney", "usa", "india", "uk", "europe",
]

WHATSAPP_DOMAINS = [
    "wa.me", "chat.whatsapp.com", "api.whatsapp.com", "whatsapp.com",
]

TELEGRAM_DOMAINS = [
    "t.me", "telegram.me", "telegram.org", "telegram.dog",
]

SHORTENER_DOMAINS = [
    "bit.ly", "tinyurl.com", "goo.gl", "rb.gy", "cutt.ly", "shorturl.at", "is.gd", "ow.ly", "rebrand.ly",
    "tiny.cc", "shorte.st",
]

OPAQUE_LINK_DOMAINS = [
    "lnkd.in",
]

FREE_EMAIL_DOMAINS = [
    "gmail.com", "googlemail.com", "yahoo.com", "yahoo.co.in", "yahoo.in", "ymail.com", "outlook.com",
    "outlook.in", "hotmail.com", "live.com", "msn.com", "rediffmail.com", "icloud.com", "me.com", "aol.com",
    "proton.me", "protonmail.com", "zohomail.in", "zohomail.com", "gmx.com", "mail.com", "yandex.com",
]

MULTI_PART_SUFFIXES = [
    "co.in", "org.in", "net.in", "firm.in", "gen.in", "ind.in", "co.uk", "org.uk", "ac.uk", "com.au", "net.au",
    "org.au", "com.sg", "com.my", "com.br", "co.jp", "co.nz", "co.za", "com.mx",
]

CAREERS_HINTS = [
    "careers", "career", "jobs", "job", "join", "hiring", "apply", "work-with-us", "opportunities",
]

#: (domain, path prefix, name)
ATS_DOMAINS = [
    ("greenhouse.io", "", "Greenhouse"),
    ("lever.co", "", "Lever"),
    ("myworkdayjobs.com", "", "Workday"),
    ("myworkdaysite.com", "", "Workday"),
    ("ashbyhq.com", "", "Ashby"),
    ("smartrecruiters.com", "", "SmartRecruiters"),
    ("workable.com", "", "Workable"),
    ("bamboohr.com", "", "BambooHR"),
    ("icims.com", "", "iCIMS"),
    ("jobvite.com", "", "Jobvite"),
    ("linkedin.com", "/jobs", "LinkedIn Jobs"),
    ("naukri.com", "", "Naukri"),
    ("instahyre.com", "", "Instahyre"),
    ("wellfound.com", "", "Wellfound"),
    ("cutshort.io", "", "Cutshort"),
    ("zohorecruit.com", "", "Zoho Recruit"),
    ("zohorecruit.in", "", "Zoho Recruit"),
    ("darwinbox.in", "", "Darwinbox"),
    ("darwinbox.com", "", "Darwinbox"),
    ("keka.com", "", "Keka"),
    ("freshteam.com", "", "Freshteam"),
    ("recruitee.com", "", "Recruitee"),
    ("teamtailor.com", "", "Teamtailor"),
    ("breezy.hr", "", "Breezy"),
    ("applytojob.com", "", "JazzHR"),
    ("successfactors.com", "", "SuccessFactors"),
    ("successfactors.eu", "", "SuccessFactors"),
    ("taleo.net", "", "Taleo"),
    ("personio.com", "", "Personio"),
    ("personio.de", "", "Personio"),
    ("workatastartup.com", "", "Work at a Startup"),
]

#: (domain, path prefix, name)
FORM_DOMAINS = [
    ("forms.gle", "", "Google Form"),
    ("docs.google.com", "/forms", "Google Form"),
    ("forms.office.com", "", "Microsoft Form"),
]

# Patterns, for a regular-expression dialect with ASCII word borders (\b), ASCII white space and ASCII case folding.

#: (pattern, reason that is shown)
PAY_CLAIMS = [
    (r"\bearn(?:ing)?\s+(?:up\s*to\s+)?(?:₹|rs\.?|inr|\$|usd)\s?[\d,.]+\s*k?\s*(?:\/|per|a|daily|every)\s*(?:day|hour|hr|week)", "Promises daily/hourly earnings"),
    (r"(?:[₹$]|\b(?:rs\.?|inr))\s?[\d,.]+\s*k?\s*(?:\/|per)\s*day\b", "Promises pay per day"),
    (r"\bdaily\s+payout\b", "Promises daily payout"),
    (r"\bearn\s+from\s+home\b", "Promises work-from-home earnings"),
]
SALARY = [
    r"\bctc\b",
    r"\blpa\b",
    r"\bsalary\b",
    r"\bstipend\b",
    r"\bcompensation\b",
    r"\bper\s+annum\b",
    r"(?:[₹$€£]|\b(?:rs\.?|inr|usd))\s?\d[\d,.]*",
]
EXPERIENCE = [
    r"\b\d{1,2}\s*(?:\+|-|–|to)?\s*(?:\d{1,2}\s*)?(?:years?|yrs?|yoe)\b",
    r"\bfreshers?\b",
    r"\bexperience\s*[:\-]",
    r"\bentry[\s-]level\b",
]
EMAIL = r"[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}"
URL = r"""\b(?:https?:\/\/|www\.)[^\s<>"')]+|\b[a-z0-9-]+(?:\.[a-z0-9-]+)*\.(?:com|io|co|in|org|net|me|ly|gl|app|dev|ai|jobs|hr)\/[^\s<>"')]*"""
PROFILE = r"""(?:https?:\/\/)?(?:[a-z]{2,3}\.)?linkedin\.com\/in\/[^\s)\]}>"']+"""
NAME = r"[A-Z][A-Za-z0-9_&.'-]*(?:\s+[A-Z][A-Za-z0-9_&.'-]*){0,2}"
COMPANY = [r"(?:\b[Aa]t|@|\b[Jj]oin(?:ing)?|\b[Ww]ith)\s*@?\s*(" + NAME + ")", "(" + NAME + r")\s+is\s+(?:hiring|looking|expanding|growing)"]
COMPANY_STOPWORDS = [
    "we", "our", "the", "a", "an", "i", "my", "this", "that", "us", "you", "your", "hiring", "remote", "team", "job",
    "jobs", "role", "position", "linkedin", "hr", "dm", "apply", "location", "experience", "hello", "hi", "dear", "all",
    "please", "immediate",
]

#: What lower-cased text must hold for a pattern to match: one string of each list. Short lists come first: the others are only tried after them.
URL_NEEDS = ["http", "www.", *[f".{x}/" for x in ("com", "io", "co", "in", "org", "net", "me", "ly", "gl", "app", "dev", "ai", "jobs", "hr")]]
MONEY = ["₹", "$", "rs", "inr", "usd"]
NEEDED = {
    PAY_CLAIMS[0][0]: [["earn"], MONEY, ["day", "hour", "hr", "week"]], PAY_CLAIMS[1][0]: [["day"], MONEY], PAY_CLAIMS[2][0]: [["daily"], ["payout"]], PAY_CLAIMS[3][0]: [["earn"], ["home"]],
    SALARY[0]: [["ctc"]], SALARY[1]: [["lpa"]], SALARY[2]: [["salary"]], SALARY[3]: [["stipend"]], SALARY[4]: [["compensation"]], SALARY[5]: [["annum"]], SALARY[6]: [["€", "£", *MONEY]],
    EXPERIENCE[0]: [["year", "yr", "yoe"]], EXPERIENCE[1]: [["fresher"]], EXPERIENCE[2]: [["experience"]], EXPERIENCE[3]: [["entry"], ["level"]],
    EMAIL: [["@"]], URL: [["/", "http", "www."], URL_NEEDS], PROFILE: [["linkedin.com/in/"]], COMPANY[1]: [["hiring", "looking", "expanding", "growing"]],
}

#: Hours of a unit of age, by its short, middle and long name.
UNIT_HOURS = {
    "s": 1 / 3600, "sec": 1 / 3600, "second": 1 / 3600, "m": 1 / 60, "min": 1 / 60, "minute": 1 / 60,
    "h": 1.0, "hr": 1.0, "hour": 1.0, "d": 24.0, "day": 24.0, "w": 168.0, "wk": 168.0, "week": 168.0,
    "mo": 720.0, "month": 720.0, "y": 8760.0, "yr": 8760.0, "year": 8760.0,
}

# Decision values.
LABELS = ["apply_early", "real_opening", "crowded", "engagement_bait", "scam_risk", "unverified", "not_hiring"]
LABEL_TEXT = {
    "apply_early": "Apply Early", "real_opening": "Real Opening", "crowded": "Crowded", "engagement_bait": "Engagement Bait",
    "scam_risk": "Scam Risk", "unverified": "Unverified", "not_hiring": "Not a Hiring Post",
}
HIRING_MIN_SCORE, BAIT_THRESHOLD, SCAM_THRESHOLD = 0.35, 0.95, 0.95
WEAK_SCAM_SIGNALS = 3
FORM_MIN_SPECIFICITY, OPAQUE_MIN_SPECIFICITY = 2, 3
EARLY_MAX_HOURS, EARLY_MAX_COMMENTS = 24, 50
CROWDED_COMMENTS, CROWDED_HOURS, CROWDED_PER_HOUR = 200, 168, 20
MAX_REASONS, MIN_MODEL_TEXT, MODEL_TEXT = 4, 40, 1200
SCAM_REASONS = {
    "no interview": "Says no interview needed", "without interview": "Says no interview needed",
    "guaranteed job": "Promises a guaranteed job", "job guarantee": "Promises a guaranteed job",
    "100 job guarantee": "Promises a guaranteed job", "pay to join": "Asks you to pay to join",
    "aadhaar": "Mentions Aadhaar", "aadhar": "Mentions Aadhaar", "pan card": "Mentions PAN card",
}
