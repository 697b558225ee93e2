"""Fixed values.

Everything in this module is data that results depend on: word lists, weights,
thresholds and patterns. Changing any of them changes results. Heading phrases
are written with plain spaces; a space stands for optional white space.
Patterns carry no flags: callers add the dialect's own.
"""

# Scoring weights, summing to 1.
WEIGHTS = {
    "jd_skill_overlap": 0.22,
    "skills_match": 0.15,
    "experience": 0.13,
    "certificates": 0.10,
    "contact_info": 0.05,
    "skills_count": 0.10,
    "project_relevance": 0.15,
    "education_quality": 0.10,
}
STRONG_THRESHOLD = 0.5
EXPERIENCE_NORM_CAP = 15.0
EXPERIENCE_FLOOR = 0.1
MAX_YEARS = 25

# The default vocabulary, 302 entries in order; "onboarding" and "logistics" stand twice and count twice.
SKILLS = [
    # Software
    "python", "java", "javascript", "sql", "react", "machine learning", "data analysis", "aws", "docker",
    "kubernetes", "git", "html", "css", "node.js", "flask", "tensorflow", "pandas", "mongodb", "rest api",
    "agile", "c++", "c#", "linux", "cloud computing", "rust", "go", "typescript", "ruby", "django", "vue.js",
    "angular", "spring boot", "postgresql", "mysql", "redis", "elasticsearch", "graphql", "microservices",
    "ci/cd", "jenkins", "terraform", "ansible", "azure", "gcp", "data science", "deep learning", "nlp",
    "computer vision", "cybersecurity", "penetration testing", "scrum", "jira",
    # Marketing and sales
    "seo", "sem", "content marketing", "social media management", "b2b sales", "crm", "google analytics",
    "email marketing", "market research", "brand management", "digital marketing", "ppc", "google ads",
    "facebook ads", "copywriting", "public relations", "salesforce", "hubspot", "lead generation",
    "conversion rate optimization", "a/b testing", "affiliate marketing", "influencer marketing", "event planning",
    "product marketing", "marketing automation", "customer success", "account management", "cold calling",
    "negotiation", "sales presentations", "business development", "market analysis", "competitive intelligence",
    "growth hacking", "e-commerce", "shopify", "wordpress", "adobe creative suite", "graphic design", "video editing",
    "data visualization", "tableau", "communication skills", "b2c sales", "sales strategy", "key account management",
    "churn reduction", "onboarding", "retention strategies",
    # Finance and accounting
    "accounting", "financial modeling", "budgeting", "forecasting", "excel", "quickbooks", "tax preparation",
    "auditing", "risk management", "payroll", "financial analysis", "cash flow management", "general ledger",
    "accounts payable", "accounts receivable", "reconciliation", "gaap", "ifrs", "corporate finance",
    "investment banking", "portfolio management", "wealth management", "credit analysis", "quantitative analysis",
    "mergers and acquisitions", "due diligence", "private equity", "venture capital", "asset management",
    "financial reporting", "compliance", "sec reporting", "sarbanes-oxley", "erisa", "treasury", "capital budgeting",
    "variance analysis", "cost accounting", "bookkeeping", "xero", "sap", "oracle e-business suite", "power bi",
    "vba", "sql for finance", "data mining", "fraud detection", "anti-money laundering", "kyc", "macroeconomics",
    # Pharma and healthcare
    "clinical trials", "fda regulations", "gmp", "glp", "quality assurance", "pharmacovigilance", "sop development",
    "biostatistics", "drug development", "patient care", "medical billing", "healthcare administration", "emr", "ehr",
    "epic", "cerner", "hipaa compliance", "medical terminology", "nursing", "triage", "phlebotomy", "vital signs",
    "cpr", "bls", "acls", "infection control", "medication administration", "pharmacology", "toxicology",
    "biochemistry", "molecular biology", "cell culture", "pcr", "elisa", "chromatography", "hplc",
    "mass spectrometry", "medical coding", "icd-10", "cpt coding", "clinical research", "regulatory affairs",
    "medical writing", "data management", "health informatics", "public health", "epidemiology",
    "healthcare consulting", "telehealth", "patient scheduling",
    # Mechanical and other engineering
    "autocad", "solidworks", "cad/cam", "thermodynamics", "hvac", "robotics", "six sigma", "lean manufacturing",
    "fluid mechanics", "project management", "mechanical design", "fea", "ansys", "matlab", "creo", "catia",
    "mechatronics", "plc programming", "automation", "manufacturing engineering", "qa/qc", "root cause analysis",
    "fmea", "dfm", "gd&t", "material science", "metallurgy", "machining", "cnc programming", "welding", "pneumatics",
    "hydraulics", "supply chain management", "inventory control", "logistics", "aerospace engineering",
    "automotive engineering", "civil engineering", "structural analysis", "electrical engineering", "circuit design",
    "pcb design", "microcontrollers", "iot", "systems engineering", "agile hardware", "scada", "hmi",
    "industrial engineering", "ergonomics",
    # HR and operations
    "talent acquisition", "onboarding", "employee relations", "performance management", "supply chain", "logistics",
    "inventory management", "procurement", "recruiting", "sourcing", "applicant tracking systems", "workday",
    "bamboo hr", "adp", "benefits administration", "compensation", "payroll processing", "hris",
    "organizational development", "training and development", "employee engagement", "diversity and inclusion",
    "conflict resolution", "labor law", "osha compliance", "fmla", "workforce planning", "succession planning",
    "change management", "operations management", "business process improvement", "six sigma green belt",
    "lean methodologies", "kaizen", "facility management", "vendor management", "contract negotiation",
    "strategic planning", "key performance indicators", "okrs", "project coordination", "event management",
    "timeline management", "resource allocation", "budget tracking", "quality control", "customer service",
    "client relations", "dispatching", "fleet management",
]

# Role phrases in a job description and the skills they imply.
ROLE_SKILLS = {
    "web development": ["html", "css", "javascript", "react", "angular", "vue.js", "node.js", "django", "flask"],
    "full stack": ["html", "css", "javascript", "react", "node.js", "sql", "mongodb", "postgresql", "mysql"],
    "frontend": ["html", "css", "javascript", "react", "angular", "vue.js", "typescript"],
    "backend": ["node.js", "python", "java", "sql", "mongodb", "postgresql", "flask", "django", "spring boot"],
    "devops": ["docker", "kubernetes", "jenkins", "ci/cd", "terraform", "ansible", "aws", "azure", "gcp"],
    "data engineer": ["sql", "python", "pandas", "data analysis", "data science", "tensorflow"],
    "mobile development": ["react", "javascript", "typescript", "flutter", "swift"],
}

# Headings that stand alone on a line, in order of precedence.
STANDALONE_HEADINGS = {
    "work": [
        "work experience", "professional experience", "employment history", "employment", "work history",
        "career history", "career summary", "professional background", "job experience", "positions? held",
        "relevant experience", "internships? (?:&|and)? experience", "internship", "internships", "work",
    ],
    "education": [
        "education", "academic background", "academic qualifications?", "educational qualifications?",
        "academic details", "academic profile", "qualifications?", "scholastic record", "degrees?",
    ],
    "projects": [
        "projects?", "academic projects?", "personal projects?", "key projects?", "major projects?",
        "notable projects?", "capstone projects?", "course projects?", "coursework projects?",
        "mini projects?", "side projects?",
    ],
    "skills": [
        "skills?", "technical skills?", "core competenc(?:ies|e)", "key skills?", "areas? of expertise",
        "proficienc(?:ies|y)", "technologies", "tools? (?:&|and)? technologies",
    ],
    "certificates": [
        "certifications?", "certificates?", "licenses? (?:&|and)? certifications?",
        "professional certifications?", "training", "courses",
    ],
    "summary": [
        "summary", "objective", "profile", "about me", "personal statement", "career objective",
        "professional summary",
    ],
}

# Headings followed by a colon and content on the same line.
INLINE_HEADINGS = {
    "work": ["work experience", "professional experience", "employment history", "employment", "work history"],
    "education": ["education", "academic background", "qualifications?"],
    "projects": ["projects?", "academic projects?", "personal projects?", "key projects?", "major projects?"],
    "skills": ["skills?", "technical skills?", "core competenc(?:ies|e)", "key skills?"],
    "certificates": ["certifications?", "certificates?", "professional certifications?"],
    "summary": ["summary", "objective", "profile", "career objective", "professional summary"],
}
SECTIONS = ["work", "education", "projects", "skills", "certificates", "summary", "other"]

# Context patterns, searched anywhere in lower-cased text.
EDUCATION_CONTEXT = (
    r"b\.?tech|m\.?tech|b\.?sc|m\.?sc|b\.?e\b|m\.?e\b|b\.?a\b|m\.?a\b|b\.?com|m\.?com|"
    r"bachelor|master|ph\.?d|diploma|degree|university|college|institute|"
    r"school|gpa|cgpa|percentage|semester|graduated|graduation|"
    r"higher\s*secondary|hsc|ssc|10th|12th|board|cbse|icse|mba|bba|bca|mca|enrolled"
)
PROJECT_CONTEXT = (
    r"project|capstone|mini[\s\-]?project|course\s*work|coursework|"
    r"hackathon|competition|challenge|assignment|thesis|dissertation|"
    r"research\s*paper|paper\s*titled|paper\s*on"
)
WORK_CONTEXT = (
    r"worked\s*(?:at|for|with|as)|employed\s*(?:at|by)|"
    r"job\s*(?:title|role|position)|designation|company|organization|"
    r"responsibilities|role\s*(?:and|&)\s*responsibilities|key\s*responsibilities|duties|reporting\s*to|"
    r"full[\s\-]?time|part[\s\-]?time|contract|freelance|"
    r"team\s*(?:lead|leader|manager|member|size)|managed\s*a\s*team|"
    r"pvt\.?\s*ltd|private\s*limited|inc\.?|corp\.?|llc|"
    r"technologies|solutions|services|consulting|software\s*(?:engineer|developer)|analyst|manager|"
    r"developer|engineer|consultant|associate|executive|intern\s+at|interned\s+at"
)
COMPANY_TOKEN = r"pvt|ltd|inc|corp|llc|company|firm|technologies|solutions|services"
WORK_KEYWORD = (
    r"worked at|employed at|years of experience|work experience|"
    r"professional experience|job role|designation|responsibilities"
)
EMPLOYMENT_PHRASE = r"worked at|employed at|working at|employment history"

# Years. The first is for a work section, the second for free text.
WORK_SECTION_YEARS = r"([0-9]+)\s*\+?\s*year"
FREE_TEXT_YEARS = r"([0-9]+)\s*\+?\s*years?\s+of\s+(?:work\s+)?experience"
YEAR_RANGE = r"(20[0-2][0-9])\s*[-to–]+\s*(20[0-2][0-9]|present|now|current)"
OPEN_ENDS = ["present", "now", "current"]
PROJECT_YEAR_RANGE = r"20[0-2][0-9]\s*[-to–]+\s*(?:20[0-2][0-9]|present|now|current|developing)"

# Contact details.
EMAIL = r"[\w.\-]@[\w.\-]"
PHONE = r"[1-9][0-9 .\-()]{8,}[0-9]"
LINKEDIN = "linkedin.com"

# Degree levels and their scores.
DEGREES = [
    ("phd", 1.0, r"\b(?:ph\.?d|doctorate|doctor\s*of\s*philosophy)\b"),
    ("masters", 0.8,
     r"\b(?:m\.?tech|m\.?sc|m\.?s\b|m\.?e\b|m\.?a\b|m\.?com|mba|mca|master(?:'?s)?(?:\s*of|\s*in|\s*degree)?)\b"),
    ("bachelors", 0.6,
     r"\b(?:b\.?tech|b\.?sc|b\.?s\b|b\.?e\b|b\.?a\b|b\.?com|bba|bca|bachelor(?:'?s)?(?:\s*of|\s*in|\s*degree)?)\b"),
    ("diploma", 0.4, r"\b(?:diploma|associate(?:'?s)?\s*degree|certificate\s*program)\b"),
]
FIELD_WORD = r"\b[a-z]{3,}\b"
FIELD_STOP_WORDS = [
    "the", "and", "for", "with", "has", "have", "are", "was", "will", "can",
    "from", "this", "that", "not", "but", "also", "any", "all", "been", "more",
    "years", "year", "experience", "required", "preferred",
]

# Certificate mentions run from a keyword to the next . , ; or line end.
CERTIFICATE_KEYWORDS = [
    r"aws[\s\-]?certified", "certified", "certification", "certificate", "coursera", "udemy",
    r"google[\s\-]?cloud", r"azure[\s\-]?certified", r"professional\s*certificate", "nanodegree",
    "specialization", "licensed", "registered",
]
CERTIFICATE_REST = r"[^\n.,;]*"
MIN_CERTIFICATE_CHARS = 5

# What opens a project. Patterns apply to a stripped line, letter case ignored.
PROJECT_BULLET = (
    r"^(?:[•‣◦⁃∙●○◦►▸▹\-*ò_~]\s*|[0-9]+[.\\)]\s+|"
    r"project\s*(?:[0-9]+|[a-z])?\s*[:–\-]|title\s*[:–\-])"
)
PROJECT_OPENING = r"^project\s*(?:title|name)?\s*[:–\-]"
TITLE_SMALL_WORDS = ["a", "an", "the", "and", "or", "of", "in", "on", "at", "to", "for", "with", "by", "&", "-", "–"]
TITLE_MAX_CHARS = 80
TITLE_MIN_SHARE = 0.7
MIN_PROJECT_CHARS = 15
PROJECT_CHUNK_CHARS = 300

# Similarity.
DEFAULT_JOB = "software engineer developer"
DEFAULT_TRAINING_JOB = "software engineer"
MATCH_OFFSET, MATCH_GAIN = 0.1, 1.5
PROJECT_COSINE = 0.3
PROJECT_BOOST, PROJECT_BOOST_CAP = 0.05, 0.15
CERTIFICATE_COSINE_SCORING, CERTIFICATE_COSINE_TRAINING = 0.1, 0.3

# Ranking, flags and display bands.
ANOMALY_REASON = (
    "Suspected keyword stuffing: resume text length is statistically abnormal for this batch."
)
HIGH_BAND, MEDIUM_BAND = 50, 30

# File types with extractable resumes, and names that are skipped.
FILE_TYPES = {
    "pdf": [".pdf"],
    "docx": [".docx"],
    "doc": [".doc"],
    "image": [".png", ".jpg", ".jpeg", ".tiff", ".bmp", ".webp"],
}
HIDDEN_PREFIXES = [".", "__"]

# Model features, in training order.
MODEL_FEATURES = [
    "skills_match_score", "skills_count", "has_experience", "certificate_relevance",
    "has_contact", "experience_years", "project_relevance", "education_quality",
]
