"""Fixed values of the scoring rules.

Everything here is data: word lists, thresholds, weights and patterns that decide what the
results are.  They are the defaults of the functions that use them; every function also takes
its rules as an argument.  Rule sets that grow with a business (skill taxonomies, long keyword
lists) are not listed here: they are tables the caller passes in.
"""

from __future__ import annotations

# --- fixed values: weights of the match score -------------------------------------------------
MATCH_WEIGHTS = {"semantic": 0.40, "skills": 0.30, "experience": 0.15, "education": 0.15}

# --- fixed values: weights of the structure score, with and without an opening -----------------
STRUCTURE_WEIGHTS_WITH_JD = {
    "sections": 0.20, "length": 0.15, "bullets": 0.15,
    "keywords": 0.25, "contact": 0.10, "formatting": 0.15,
}
STRUCTURE_WEIGHTS_ALONE = {
    "sections": 0.25, "length": 0.15, "bullets": 0.15,
    "keywords": 0.15, "contact": 0.15, "formatting": 0.15,
}

# --- fixed values: sections, lengths, limits -----------------------------------------------------
EXPECTED_SECTIONS = ["contact", "summary", "objective", "skills", "experience", "education"]
LENGTH_MIN, LENGTH_IDEAL_MIN, LENGTH_IDEAL_MAX, LENGTH_MAX = 200, 400, 4000, 8000
MIN_TEXT_CHARS = 50
SNIPPET_CHARS = 200
MAX_MISSING_KEYWORDS = 15
MIN_CLASS_ROWS = 30
EARLIEST_YEAR = 1970

# --- fixed values: words that carry no meaning in keyword matching --------------------------------
STOPWORDS = [
    "the", "and", "for", "are", "but", "not", "you", "all", "can", "had", "her", "was", "one", "our", "out", "has",
    "have", "been", "from", "they", "will", "with", "this", "that", "each", "make", "like", "into", "some", "them",
    "than", "its", "over", "such", "also", "more", "other", "their", "which", "about", "would", "these", "should",
    "through", "experience", "work", "working", "ability", "strong", "including", "using", "years", "required",
    "preferred", "responsibilities", "qualifications",
]

# --- fixed values: verbs that mark an achievement -------------------------------------------------
ACTION_VERBS = [
    "developed", "designed", "implemented", "managed", "created", "built", "improved", "optimized", "analyzed",
    "reduced", "increased", "established", "delivered", "achieved", "automated", "coordinated", "executed",
    "generated", "launched", "maintained", "resolved", "spearheaded", "streamlined", "supervised", "trained",
    "collaborated", "contributed", "engineered", "integrated", "migrated", "deployed", "architected", "mentored",
    "facilitated", "evaluated",
]

# --- fixed values: words that rule a line out as a person's name ----------------------------------
NOT_A_NAME = [
    "resume", "curriculum", "vitae", "cv", "profile", "summary", "contact", "email", "phone", "address", "mobile",
    "linkedin", "github", "portfolio", "page", "developer", "engineer", "manager", "experience", "education",
    "skills", "projects", "languages",
]

# --- fixed values: contact patterns -----------------------------------------------------------------
EMAIL = r"\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b"
PHONE = r"(?:\+?\d{1,3}[\s\-.]?)?(?:\(?\d{2,4}\)?[\s\-.]?)?\d{3,4}[\s\-.]?\d{3,4}"
PHONE_US = r"\b(?:\+?\d{1,3}[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}\b"
NAME_BIGRAM = r"(\b[A-Z][a-z]+\b)\s(\b[A-Z][a-z]+\b)"

# --- fixed values: how each section announces itself (matched without case) ------------------------
SECTION_PATTERNS = {
    "contact": r"\b(?:contact\s*(?:info(?:rmation)?)?|personal\s*(?:info(?:rmation)?|details?))\b",
    "summary": r"\b(?:summary|profile|about\s*me|professional\s*summary)\b",
    "objective": r"\b(?:objective|career\s*objective)\b",
    "skills": r"\b(?:skills|technical\s*skills|core\s*competencies|competencies|expertise)\b",
    "experience": r"\b(?:experience|work\s*(?:experience|history)|employment|professional\s*experience)\b",
    "education": r"\b(?:education|academic|qualifications?|certifications?)\b",
    "projects": r"\b(?:projects?|portfolio)\b",
    "certifications": r"\b(?:certifications?|licenses?|credentials?)\b",
    "languages": r"\b(?:languages?)\b",
}

#: Words, in lower case, of which a text holds at least one where the pattern of that section matches.
SECTION_WORDS = {
    "contact": ["contact", "personal"], "summary": ["summary", "profile", "about"], "objective": ["objective"],
    "skills": ["skills", "competencies", "expertise"], "experience": ["experience", "history", "employment"],
    "education": ["education", "academic", "qualification", "certification"], "projects": ["project", "portfolio"],
    "certifications": ["certification", "license", "credential"], "languages": ["language"],
}

# --- fixed values: headings, one per line (matched without case on the stripped line) --------------
EXPERIENCE_HEADING = (
    r"^\s*(?:work\s+experience|professional\s+experience|employment\s+history|work\s+history"
    r"|experience|employment)\s*[:\-]?\s*$"
)
OTHER_HEADING = (
    r"^\s*(?:education|academic|projects?|skills|certifications?|languages?|summary|objective"
    r"|awards?|publications?)\s*[:\-]?\s*$"
)
SPLIT_HEADING = r"^\s*(experience|skills|education|projects|summary|objective|certifications)\s*[:\-]?\s*$"

# --- fixed values: degrees, fields, titles (degrees and titles matched without case) ---------------
DEGREE_PATTERNS = [
    r"\b(?:Ph\.?D|Doctorate|Doctor of)\b",
    r"\b(?:M\.?S\.?|M\.?Sc\.?|Master(?:'s)?(?:\s+of\s+\w+)?|M\.?A\.?|MBA|M\.?Tech\.?|M\.?E\.?)\b",
    r"\b(?:B\.?S\.?|B\.?Sc\.?|Bachelor(?:'s)?(?:\s+of\s+\w+)?|B\.?A\.?|B\.?Tech\.?|B\.?E\.?|BCA|BBA)\b",
    r"\b(?:Associate(?:'s)?(?:\s+(?:of|in)\s+\w+)?)\b",
    r"\b(?:Diploma|Certificate|Certification)\b",
]
#: As SECTION_WORDS, for each of DEGREE_PATTERNS; None where only letters are needed that most texts hold.
DEGREE_WORDS = [["phd", "ph.d", "doctor"], None, None, ["associate"], ["diploma", "certificat"]]
STUDY_FIELDS = [
    "Computer Science", "Information Technology", "Software Engineering",
    "Electrical Engineering", "Mechanical Engineering", "Civil Engineering",
    "Business Administration", "Finance", "Accounting", "Marketing",
    "Data Science", "Artificial Intelligence", "Machine Learning",
    "Mathematics", "Physics", "Chemistry", "Biology", "Economics",
    "Psychology", "Communications", "English", "History",
    "Graphic Design", "Web Development", "Cybersecurity",
    "Nursing", "Medicine", "Pharmacy", "Law",
]
DEGREE_LEVELS = {
    "phd": 5, "doctorate": 5, "doctor": 5,
    "master": 4, "mba": 4, "m.s.": 4, "m.sc.": 4, "m.tech": 4, "m.a.": 4, "m.e.": 4,
    "bachelor": 3, "b.s.": 3, "b.sc.": 3, "b.tech": 3, "b.a.": 3, "b.e.": 3, "bca": 3, "bba": 3,
    "associate": 2, "diploma": 1, "certificate": 1, "certification": 1,
}
TITLE_PATTERNS = [
    r"\b(?:Senior|Junior|Lead|Principal|Staff|Chief)?\s*"
    r"(?:Software|Web|Full[\s-]?Stack|Frontend|Backend|Mobile|DevOps|Cloud|Data|ML|AI|QA|Test)?\s*"
    r"(?:Engineer|Developer|Architect|Designer|Analyst|Scientist|Manager|Director|Consultant"
    r"|Specialist|Administrator|Coordinator)\b",
    r"\b(?:Project|Product|Program|Engineering|Technical|Operations|Marketing|Sales|HR|Finance)\s+"
    r"(?:Manager|Director|Lead|Head|VP|Officer)\b",
    r"\b(?:CTO|CEO|CFO|COO|CIO|VP|SVP)\b",
]
#: As SECTION_WORDS, for each of TITLE_PATTERNS.
TITLE_WORDS = [
    ["engineer", "developer", "architect", "designer", "analyst", "scientist", "manager", "director", "consultant",
     "specialist", "administrator", "coordinator"],
    ["manager", "director", "lead", "head", "vp", "officer"], ["cto", "ceo", "cfo", "coo", "cio", "vp"],
]
# Pattern stand-in for an organisation recogniser: a run of capitalised words that holds one of
# the institution words (this list is ours; see README, "Re-aimed").
INSTITUTION = (
    r"\b(?:[A-Z][A-Za-z'&.-]*[ ])*(?:University|College|Institute|School|Academy)\b"
    r"(?:[ ](?:of|for)(?:[ ][A-Z][A-Za-z'&-]*)+)?"
)

#: A text holds one of these, spelled so, where INSTITUTION matches.
INSTITUTION_WORDS = ["University", "College", "Institute", "School", "Academy"]

# --- fixed values: years of experience (matched without case) -------------------------------------
YEARS_MENTION = r"(\d+)\+?\s*(?:years?|yrs?)\s*(?:of\s+)?(?:experience|exp\.?)?"
MONTH_YEAR_RANGE = (
    r"(?:(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\.?\s*)(\d{4})"
    r"\s*(?:[-–—to]+)\s*"
    r"(?:(?:(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\.?\s*)?(\d{4})"
    r"|(?:Present|Current|Now|Ongoing))"
)
YEAR_RANGE = r"\b(\d{4})\s*[-–—]\s*(?:(\d{4})|(?:Present|Current|Now))\b"
JD_YEARS = [
    r"(\d+)\+?\s*(?:years?|yrs?)\s*(?:of\s+)?(?:experience|exp\.?)",
    r"(?:minimum|at\s+least|min\.?)\s*(\d+)\s*(?:years?|yrs?)",
]

# --- fixed values: layout checks ---------------------------------------------------------------------
BULLET_LINE = r"^\s*(?:[-•●◦▪→►]|\d+[.)]\s|[a-z][.)]\s)"
UNUSUAL_CHARS = "[‘’“”—–«»…]"
NUMBERS = r"\b\d+[%+]?\b|\b\d+(?:k|m|x)\b"

# --- fixed values: characters made printable in Latin-1 -----------------------------------------------
LATIN1_ONE_TO_ONE = {
    "—": "-", "–": "-", "‒": "-", "―": "-",
    "•": "*", "●": "*", "◦": "*", "▪": "*",
    "’": "'", "‘": "'", "“": '"', "”": '"',
    "\u00a0": " ",
}
LATIN1_ONE_TO_MANY = {"→": "->", "►": "->", "…": "...", "™": "(TM)", "®": "(R)", "©": "(C)"}

# --- fixed values: punctuation removed by text cleaning -----------------------------------------------
PUNCTUATION = r"""[!"#$%&'()*+,\-./:;<=>?@\[\\\]^_`{|}~]"""

# --- fixed values: common short forms of skills, lower case -> lower case -------------------------------
SKILL_ALIASES = {
    "ml": "machine learning",
    "dl": "deep learning",
    "ai": "artificial intelligence",
    "nlp": "natural language processing",
    "cv": "computer vision",
    "js": "javascript",
    "ts": "typescript",
    "py": "python",
    "tf": "tensorflow",
    "k8s": "kubernetes",
    "aws": "amazon web services",
    "gcp": "google cloud platform",
    "ci/cd": "continuous integration",
    "ci": "continuous integration",
    "cd": "continuous deployment",
    "sql": "sql",
    "nosql": "nosql",
    "oop": "object-oriented programming",
    "api": "api",
    "rest": "rest api",
    "restful": "rest api",
    "react.js": "react",
    "reactjs": "react",
    "node.js": "node.js",
    "nodejs": "node.js",
    "vue.js": "vue",
    "vuejs": "vue",
    "angular.js": "angular",
    "angularjs": "angular",
    "express.js": "express",
    "expressjs": "express",
    "next.js": "next.js",
    "nextjs": "next.js",
    "scikit-learn": "scikit-learn",
    "sklearn": "scikit-learn",
    "sci-kit learn": "scikit-learn",
    "postgres": "postgresql",
    "mongo": "mongodb",
    "c++": "c++",
    "c#": "c#",
    "c sharp": "c#",
    "dot net": ".net",
    "dotnet": ".net",
    ".net core": ".net",
    "asp.net": ".net",
    "ms excel": "excel",
    "microsoft excel": "excel",
    "ms word": "word",
    "power bi": "power bi",
    "powerbi": "power bi",
    "tableau": "tableau",
    "sas": "sas",
    "r programming": "r",
    "r language": "r",
}

# --- fixed values: candidate column names, best first ---------------------------------------------------
CATEGORY_COLUMNS = ["Category", "category", "label", "Label"]
TEXT_COLUMNS = ["Resume", "resume", "Resume_str", "text", "Text", "Clean_Resume", "Feature"]
ROLE_COLUMNS = ["Role", "role", "Job_Role", "job_role", "Title", "title"]
FEATURE_COLUMNS = ["Features", "features", "Description", "description"]

# --- fixed values: defaults of a suggestion reply ----------------------------------------------------------
SUGGESTION_DEFAULTS = {
    "category": "General", "severity": "medium", "original": "", "suggestion": "", "explanation": "",
}

# --- fixed values: feedback messages ---------------------------------------------------------------------------
FEEDBACK = {
    "sections": "Missing resume sections: {}. Adding these improves ATS parsing.",
    "very_short": "Resume is very short ({} chars). ATS systems may flag this. Aim for 400-4000 characters.",
    "short": "Resume is somewhat short ({} chars). Consider adding more detail.",
    "long": "Resume is slightly long ({} chars). Consider trimming to ~4000 chars.",
    "very_long": "Resume is very long ({} chars). ATS systems may truncate. Aim for 1-2 pages.",
    "no_lines": "No content detected.",
    "few_bullets": "Very few bullet points detected. Use bullets for experience descriptions to improve "
                   "readability and ATS parsing.",
    "some_bullets": "Consider using more bullet points for your experience entries.",
    "all_bullets": "Resume is almost entirely bullet points. Add some prose sections (summary, objective) "
                   "for balance.",
    "no_words": "Resume appears empty.",
    "few_verbs": "Only {} action verbs detected. Use verbs like 'developed', 'implemented', 'managed' to "
                 "strengthen descriptions.",
    "few_numbers": "Few quantifiable achievements found. Add numbers/percentages to demonstrate impact "
                   "(e.g., 'Increased sales by 20%').",
    "low_density": "Only {}% of JD keywords found in resume. Consider incorporating more relevant terms.",
    "no_name": "No name detected. Ensure your full name is at the top of your resume.",
    "no_email": "No email address detected. Include a professional email.",
    "no_phone": "No phone number detected. Include a contact number.",
    "unusual": "Found {} special Unicode characters (smart quotes, em-dashes). Some ATS systems may not parse "
               "these correctly. Use standard characters.",
    "pipes": "Detected many pipe characters (|), possibly from tables. ATS systems may not parse tables correctly.",
    "capitals": "Excessive all-caps text detected. Use title case for section headings.",
    "paragraphs": "Some paragraphs are very long. Break them into bullet points for better readability and ATS "
                  "parsing.",
    "blank_runs": "Excessive blank lines detected. Use consistent spacing.",
}
WARNING_WORDS = ["missing", "very", "excessive"]
