"""Input tables of the registered queries, derived row by row from the given tables.

``customer`` rows become résumés, ``supplier`` rows openings, ``orders`` rows applications, ``part``
rows jobs.  Each expression below is plain SQL that every engine reads the same way; the check
queries use the very same text as common table expressions.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from talentloom.operators.skills import SkillRules, alias_table, taxonomy_forms

AS_OF_YEAR = 2026
NL = "chr(10)"


def _pick(key: str, values: list[str]) -> str:
    """CASE over key % n."""
    quoted = [v.replace("'", "''") for v in values]
    arms = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(quoted[:-1]))
    return f"(CASE {key} % {len(values)} {arms} ELSE '{quoted[-1]}' END)"


def _pick_sql(key: str, exprs: list[str]) -> str:
    arms = " ".join(f"WHEN {i} THEN {e}" for i, e in enumerate(exprs[:-1]))
    return f"(CASE {key} % {len(exprs)} {arms} ELSE {exprs[-1]} END)"


def _cat(*parts: str) -> str:
    return "(" + " || ".join(parts) + ")"


def _s(text: str) -> str:
    """A literal; line breaks become chr(10) because engines read '\\n' differently."""
    quoted = [f"'{p}'" for p in text.replace("'", "''").split("\n")]
    return _cat(*f" || {NL} || ".join(quoted).split(" || "))if len(quoted) > 1 else quoted[0]


def _num(expr: str) -> str:
    return f"CAST({expr} AS STRING)"


def _resume_text(k: str = "c_custkey") -> str:
    first = _pick(k, ["Maria", "john", "Wei", "AISHA", "Lars", "Chloe", "Mary-Jane", "Ravi"])
    last = _pick(k, ["Silva", "smith", "Chen", "O'Neil", "Berg", "Dubois", "Kumar", "van Dyke", "Engineer"])
    name = f"(CASE WHEN {k} % 7 = 0 THEN '' ELSE {_cat(first, chr(39) + ' ' + chr(39), last, NL)} END)"
    contact_head = f"(CASE WHEN {k} % 3 = 0 THEN {_s('Contact Information' + chr(10))} ELSE '' END)"
    email = (f"(CASE WHEN {k} % 5 = 0 THEN '' WHEN {k} % 5 = 1 THEN "
             f"{_cat(_s('Email: ann.'), _num(k), _s('+cv@mail.example.co.uk' + chr(10)))} ELSE "
             f"{_cat(_s('user'), _num(k), _s('@example.com' + chr(10)))} END)")
    four = f"lpad({_num(k + ' % 10000')}, 4, '0')"
    phone = _pick_sql(k, [
        _cat(_s("(555) 123-"), four, NL), _cat(_s("+1 555-987-"), four, NL),
        _s("Tel 12 3456\n"), _cat(_s("Phone: 555.222."), four, NL),
    ])
    summary = (f"(CASE WHEN {k} % 2 = 0 THEN {_s('Summary' + chr(10) + 'Delivery focused professional who enjoys clear goals.' + chr(10))}"
               f" WHEN {k} % 3 = 0 THEN {_s('Objective:' + chr(10) + 'To grow with a learning team.' + chr(10))} ELSE '' END)")
    skill_a = _pick(k, ["Carpentry, forklift", "joinery; Q", "Milling and T++ milling", "K#, plotter", "T++ / K#", "Q, Beekeeping", "reach truck"])
    skill_b = _pick(k, ["stock count", "inventory", "cold kitchen hygiene", "Bread baking", "route planning", "Lathe.ctl", "first aid for small crews", "rope access", "Plotter.ctl", "adr"])
    skill_c = _pick(k, ["Payroll", "Welding", "bookkeeping", "Arc welding", "pruning, Soil tests", "sourdough", "dangerous\ngoods by road", "food safety", "Typesetting", "Dangerous goods", "handling of dangerous goods by road"])
    skills = (f"(CASE WHEN {k} % 11 = 0 THEN '' ELSE {_s('Skills' + chr(10))} END || {skill_a} || ', ' || {skill_b} || ', ' || "
              + skill_c.replace("'dangerous\ngoods by road'", _s("dangerous\ngoods by road")) + f" || {NL})")
    start = f"(2000 + {k} % 20)"
    jobs = _pick_sql(k, [
        _cat(_s("Work Experience\n- Developed and deployed data services for "), _num(f"3 + {k} % 9"),
             _s(" years\n- Managed 12 people and reduced costs by 20%\n- Built 3 tools\n1. Launched a portal\na) Trained staff\n")),
        _cat(_s("Experience:\nSenior Software Engineer, Acme\nJan "), _num(start), _s(" - Mar "), _num(f"{start} + {k} % 6"),
             _s("\n• Implemented pipelines\n• Improved uptime to 99%\nEmployment\nData Analyst\n")),
        _cat(_s("professional experience\nData Scientist and Project Manager\n"), _num(start), _s(" - "), _num(f"{start} + 4"),
             _s("\n"), _num(f"{start} + 4"), _s(" – "), _num(f"{start} + 5"), _s("\n→ Analyzed churn\n")),
        _cat(_s("Employment History\nProduct Director\nFeb. "), _num(start), _s(" to Present\n- Created roadmap\n- Led 5 teams\n- Grew sales 10x\n- Saved 2m\n- Evaluated 7 vendors\n")),
        _cat(_s("Freelance full-stack developer "), _num(start), _s(" - "), _num(f"{start} + 2"), _s("\n")),
        _s("Work History\n\n"),
    ])
    school = _pick(k, ["Northfield University", "Hillside College of Arts", "Institute of Applied Science", "the school"])
    education = (f"(CASE WHEN {k} % 13 = 0 THEN '' ELSE {_s('Education' + chr(10))} END || " + _pick_sql(k, [
        _s("Bachelor of Science in Computer Science"), _s("B.Tech. Information Technology"), _s("MBA, Finance"),
        _s("Ph.D in Physics"), _s("Diploma in Graphic Design"), _s("M.S. Data Science; B.S. Mathematics"), _s("no degree"),
    ]) + f" || ', ' || {school} || {NL})")
    tail = f"(CASE WHEN {k} % 4 = 1 THEN {_s('Projects' + chr(10) + 'Portfolio site' + chr(10) + 'Languages' + chr(10) + 'English, French' + chr(10))} ELSE '' END)"
    extra = _pick_sql(k, [
        "''", _s("“one” ‘two’ three— four… «five»\n"), _s("a|b|c|d|e|f|g|h|i|j|k|l|m\n"),
        _s("ALPHA BETA GAMMA DELTA OMEGA SIGMA THETA KAPPA LAMBDA ZETA IOTA PHIX\n"), _s("one\n\n\n\ntwo\n\n\n\n\nthree\n\n\n\nfour\n"),
        _cat("repeat('long text ', 60)", NL, NL, "repeat('more text ', 60)", NL, NL, "repeat('last text ', 60)", NL),
        _s("Designed, implemented, managed, created, built, improved, optimized, analyzed and reduced 10 things in 3 plants\n"),
        f"(CASE WHEN {k} % 3 = 0 THEN repeat('steady work on many systems ', 180) ELSE repeat('steady work on many systems ', 320) END)",
        "''", _s("Summary\nA second summary replaces the first.\n"), _s("#topic https://example.com/x account RT @me — ok™\n"),
    ])
    whole = _cat(name, contact_head, email, phone, summary, skills, jobs, education, tail, extra)
    return f"(CASE WHEN {k} % 17 = 16 THEN {_cat(name, _s('short note'))} WHEN {k} % 97 = 96 THEN '  ' ELSE {whole} END)"


def _jd_text(s: str = "s_suppkey") -> str:
    title = _pick(s, ["Data Engineer", "Backend Developer", "Product Manager", "ML Scientist"])
    years = _pick_sql(s, [
        _cat(_s("We ask for "), _num(f"2 + {s} % 9"), _s("+ years of experience.\n")),
        _cat(_s("At least "), _num(f"1 + {s} % 12"), _s(" yrs in the field.\n")), _s("All levels welcome.\n"),
    ])
    degree = _pick(s, ["Bachelor degree expected. ", "Master or PhD. ", "", "Diploma or certificate. ", "B.S. or M.S. needed. "])
    skills = _pick(s, ["Carpentry, bread baking and adr", "milling, welding, inventory", "T++, Plotter, lathe control", "cold kitchen, Sourdough",
                       "Handling of dangerous goods by road, payroll", "Q and stock count", "k# and rope access"])
    repeated = _pick_sql(s, [
        _s("Pipelines: build pipelines, test pipelines. Quality data, quality code.\n"),
        _s("Roadmap, stakeholders, roadmap; the team leads the team.\n"), _s("Services and services; uptime. Costs, costs, costs.\n"),
        _s("Plain text.\n"),
    ])
    whole = _cat(title, NL, years, degree, NL, skills, NL, repeated)
    return f"(CASE WHEN {s} % 10 = 9 THEN '   ' WHEN {s} % 10 = 8 THEN 'T++ Q ADR' ELSE {whole} END)"


RESUMES_SQL = f"SELECT c_custkey AS resume_id, {_resume_text()} AS text, c_mktsegment AS category FROM customer"
JDS_SQL = f"SELECT s_suppkey AS jd_id, {_jd_text()} AS text FROM supplier"
APPLICATIONS_SQL = (
    "SELECT o_orderkey AS application_id, o_custkey AS resume_id, "
    "CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE jd END AS jd_id "
    "FROM orders JOIN (SELECT l_orderkey, min(l_suppkey) AS jd FROM lineitem GROUP BY l_orderkey) AS lead "
    "ON o_orderkey = l_orderkey"
)
JOBS_SQL = (
    "SELECT p_partkey AS row_id, CASE WHEN p_size = 50 THEN NULL ELSE p_type || ' ' || p_brand END AS role, "
    "CASE WHEN p_size % 7 = 0 THEN NULL ELSE p_name || ' of ' || p_brand || CASE WHEN p_size % 2 = 0 THEN ' ' || lower(p_type) "
    "ELSE '' END || CASE WHEN p_size % 5 = 0 THEN repeat(' with ' || p_name, 20) ELSE '' END END AS features FROM part"
)
PREDICTIONS_SQL = (
    "SELECT d.doc_id AS doc_id, l.quality + 2 * l.toxic AS y, CASE WHEN d.n_chars > 3000 THEN 1 WHEN d.doc_id % 5 = 0 THEN 2 "
    "WHEN d.doc_id % 3 = 0 THEN 0 ELSE l.quality END AS yhat FROM documents AS d JOIN labels AS l ON d.doc_id = l.doc_id"
)
_Q = chr(34)
REPLIES_SQL = (
    "SELECT doc_id AS reply_id, CASE doc_id % 6 "
    f"WHEN 0 THEN '{{{_Q}summary{_Q}: {_Q}good {_Q[:0]}' || CAST(n_chars AS STRING) || '{_Q}, {_Q}suggestions{_Q}: [{{{_Q}category{_Q}: {_Q}Skills{_Q}, {_Q}severity{_Q}: {_Q}HIGH{_Q}, "
    f"{_Q}suggestion{_Q}: {_Q}add ' || source || '{_Q}, {_Q}explanation{_Q}: {_Q}why{_Q}}}, {{{_Q}original{_Q}: {_Q}old{_Q}}}]}}' "
    f"WHEN 1 THEN '{{{_Q}suggestions{_Q}: [{{{_Q}severity{_Q}: {_Q}low{_Q}}}, {{}}, {{{_Q}category{_Q}: {_Q}Impact{_Q}}}, {{{_Q}severity{_Q}: {_Q}odd{_Q}}}]}}' "
    f"WHEN 2 THEN '{{{_Q}summary{_Q}: {_Q}fine{_Q}, {_Q}suggestions{_Q}: []}}' "
    f"WHEN 3 THEN '{{{_Q}summary{_Q}: broken' "
    f"WHEN 4 THEN '{{{_Q}summary{_Q}: {_Q}only ' || lang || '{_Q}}}' "
    f"ELSE '{{{_Q}suggestions{_Q}: [{{{_Q}category{_Q}: {_Q}' || lang || '{_Q}, {_Q}extra{_Q}: 1}}]}}' END AS json FROM documents"
)

# A dictionary made up for these inputs, in entry order: name, further spellings, category. It has forms of one to
# six words, forms inside forms, spellings that are names of other entries, marks inside names and a one-letter name.
TAXONOMY = [
    ("Carpentry", ["joinery", "wood framing"], "workshop"), ("Arc Welding", ["welding", "stick welding"], "workshop"),
    ("Milling", ["t++ milling", "face milling"], "workshop"), ("T++", ["tpp"], "machines"), ("K#", ["k sharp"], "machines"),
    ("Q", ["quality circle"], "machines"), ("Lathe.ctl", ["lathe control"], "machines"), ("Plotter.ctl", ["plotter", "plotterctl"], "machines"),
    ("Stock Keeping", ["inventory"], "warehouse"), ("Inventory", ["stock count"], "warehouse"), ("Stock Count", ["shelf audit"], "warehouse"),
    ("Forklift", ["reach truck", "forklift driving"], "warehouse"), ("Cold Chain", [], "warehouse"),
    ("Handling of Dangerous Goods by Road", ["dangerous goods by road", "adr"], "transport"), ("Dangerous Goods", [], "transport"),
    ("Route Planning", ["tour planning"], "transport"), ("Rail Dispatch", ["dispatch"], "transport"),
    ("Cold Kitchen", ["garde manger"], "kitchen"), ("Cold Kitchen Hygiene", [], "kitchen"), ("Kitchen Hygiene", ["food safety"], "kitchen"),
    ("Bread Baking", ["baking", "sourdough"], "kitchen"), ("First Aid for Small Crews", ["first aid"], "safety"),
    ("Working at Height", ["rope access"], "safety"), ("Bookkeeping", ["ledger work", "double entry"], "office"),
    ("Payroll", ["wage slips"], "office"), ("Typesetting", ["page layout"], "office"), ("Archive Care", ["records"], "office"),
    ("Beekeeping", ["apiary"], "field"), ("Orchard Pruning", ["pruning"], "field"), ("Soil Sampling", ["soil tests"], "field"),
]


def _taxonomy_sql() -> str:
    rows = []
    for i, (name, aliases, category) in enumerate(TAXONOMY):
        for j, raw in enumerate([name, *aliases]):
            rows.append(f"({i}, {j}, '{name}', '{raw}', '{category}')")
    return "SELECT * FROM (VALUES " + ", ".join(rows) + ") AS t(entry, pos, name, raw, category)"


CTES = {
    "resumes": RESUMES_SQL, "jds": JDS_SQL, "applications": APPLICATIONS_SQL, "jobs": JOBS_SQL,
    "predictions": PREDICTIONS_SQL, "replies": REPLIES_SQL, "taxonomy": _taxonomy_sql(),
}
BASE_TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()
TEXT_TABLES = {"customer", "supplier", "part", "documents"}


class Inputs:
    """Lazy access to the given tables and the tables derived from them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def base(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def spread(self, name: str) -> DataFrame:
        """A table whose texts take much work, over all cores also where it lies in few files; a large one has splits enough and stays."""
        df, cores = self.base(name), self.spark.sparkContext.defaultParallelism
        return df.repartition(cores) if df.rdd.getNumPartitions() * 2 <= cores else df

    def __getattr__(self, name: str) -> DataFrame:
        if name in BASE_TABLES:
            return self.spread(name) if name in TEXT_TABLES else self.base(name)
        if name in CTES:
            sql = CTES[name]
            used = {t: getattr(self, t) for t in BASE_TABLES if f" {t}" in sql.replace("(", " ")}
            for t in used:
                sql = sql.replace(f"FROM {t}", f"FROM {{{t}}}").replace(f"JOIN {t}", f"JOIN {{{t}}}")
            return self.sql(sql, used)
        raise AttributeError(name)

    def sql(self, text: str, tables: dict[str, DataFrame]) -> DataFrame:
        """spark.sql over DataFrames; braces of the text itself are kept."""
        kept = text
        for t in tables:
            kept = kept.replace(f"{{{t}}}", f"\x01{t}\x02")
        kept = kept.replace("{", "{{").replace("}", "}}").replace("\x01", "{").replace("\x02", "}")
        return self.spark.sql(kept, **tables)

    @cached_property
    def taxonomy_entries(self) -> DataFrame:
        rows = [(i, n, a, c) for i, (n, a, c) in enumerate(TAXONOMY)]
        return self.spark.createDataFrame(rows, "entry int, name string, aliases array<string>, category string")

    @cached_property
    def skill_rules(self) -> SkillRules:
        return SkillRules(taxonomy_forms(self.taxonomy_entries, "entry"), alias_table(self.spark, self.taxonomy_entries, "entry"))
