"""Skill taxonomy: phrases in text, aliases, overlap of two skill lists.

A taxonomy is a table ``(name, aliases, category)`` of any size, with phrases of any length. Its forms are indexed by
their rarest token; texts meet the index token by token, and only where a key stands are phrases compared.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from talentloom import rules
from talentloom.functions import text as T
from talentloom.functions.numeric import bind, round1, share
from talentloom.operators.joins import skew_join
from talentloom.session import stored

# A token may hold + # . inside and at the front, and + # at the end; a line end is its own token
# so that no phrase crosses it.  "/" and "-" separate.
PHRASE_TOKEN = r"[\p{L}\p{N}_+#.]*[\p{L}\p{N}_+#]|\n"


# --- dictionary tables ------------------------------------------------------------------------------

def taxonomy_forms(taxonomy: DataFrame, order: str | None = None) -> DataFrame:
    """(form, canonical, category): every spelling in lower case, the first entry wins.

    ``order`` names the column that holds the entry order; without it the name decides.
    """
    entry = F.col(order) if order else F.col("name")
    spelled = taxonomy.select(
        entry.alias("entry"), F.col("name").alias("canonical"), "category",
        F.posexplode(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("pos", "raw"),
    )
    first = F.struct("entry", "pos")
    return spelled.groupBy(phrase_key(F.col("raw")).alias("form")).agg(
        F.min_by("canonical", first).alias("canonical"), F.min_by("category", first).alias("category"),
    )


def phrase_key(form: Column) -> Column:
    """A spelling as the tokens a text would show."""
    return F.array_join(T.all_matches(F.lower(form), PHRASE_TOKEN), " ")


def alias_table(spark: SparkSession, taxonomy: DataFrame, order: str | None = None,
                builtin: dict[str, str] | None = None) -> DataFrame:
    """(alias, canonical): a canonical name stands for itself, then built-in aliases, then the taxonomy's."""
    builtin = rules.SKILL_ALIASES if builtin is None else builtin
    entry = (F.col(order) if order else F.col("name")).cast("string")
    if order:
        entry = F.lpad(entry, 20, "0")
    canonical = F.lower(T.strip(F.col("name")))
    own = taxonomy.select(canonical.alias("alias"), canonical.alias("canonical"), F.lit(0).alias("priority"), entry.alias("entry"))
    fixed = spark.createDataFrame([(k, v) for k, v in builtin.items()], "alias string, canonical string").select(
        "alias", "canonical", F.lit(1).alias("priority"), F.lit("").alias("entry"))
    other = taxonomy.select(
        F.explode("aliases").alias("alias"), canonical.alias("canonical"), F.lit(2).alias("priority"), entry.alias("entry"),
    ).withColumn("alias", F.lower(T.strip(F.col("alias"))))
    every = own.unionByName(fixed).unionByName(other)
    return every.groupBy("alias").agg(F.min_by("canonical", F.struct("priority", "entry")).alias("canonical"))


def alias_links(spark: SparkSession, taxonomy: DataFrame, order: str | None = None, builtin: dict[str, str] | None = None) -> DataFrame:
    """(alias, to): each spelling points to the name it stands for, also where it is the name of another entry; built-in aliases first."""
    builtin = rules.SKILL_ALIASES if builtin is None else builtin
    entry = F.lpad(F.col(order).cast("string"), 20, "0") if order else F.col("name").cast("string")
    fixed = spark.createDataFrame(list(builtin.items()), "alias string, to string").select("alias", "to", F.lit(1).alias("priority"), F.lit("").alias("entry"))
    other = taxonomy.select(F.explode("aliases").alias("alias"), F.lower(T.strip(F.col("name"))).alias("to"), F.lit(2).alias("priority"), entry.alias("entry"))
    every = fixed.unionByName(other.withColumn("alias", F.lower(T.strip(F.col("alias"))))).filter("alias != to")
    return every.groupBy("alias").agg(F.min_by("to", F.struct("priority", "entry", "to")).alias("to"))


def alias_closure(links: DataFrame) -> DataFrame:
    """(alias, canonical): the end of every chain of ``links(alias, to)``, one row an alias; the smallest name of a circle that it runs into.

    Pointers double: after k rounds each alias knows the name 2**k steps on and the smallest name on the way, so the rounds grow with the
    logarithm of the longest chain. An alias that never ends has run into a circle after as many steps as there are links;
    from there the way holds the whole circle and nothing else.
    """
    ways = stored(links.select("alias", "to", F.col("alias").alias("least")), "aliases")
    steps, total = 1, ways.count()
    while True:
        on = ways.select(F.col("alias").alias("to"), F.col("to").alias("further"), F.col("least").alias("next"))
        if ways.join(on, "to", "left_semi").isEmpty():
            return ways.select("alias", F.col("to").alias("canonical"))
        if steps > total:
            circle = ways.select(F.col("alias").alias("to"), F.col("least").alias("smallest"))
            return ways.join(circle, "to", "left").select("alias", F.coalesce("smallest", "to").alias("canonical"))
        further = ways.join(on, "to", "left").select("alias", F.coalesce("further", "to").alias("to"), F.least("least", "next").alias("least"))
        ways, steps = stored(further, "aliases"), 2 * steps


# --- phrases in texts ----------------------------------------------------------------------------------

#: Up to so many forms the index is sent to every executor (some ten MB); a larger one is joined by shuffles.
INDEX_FORMS = 100_000


def phrase_index(forms: DataFrame) -> DataFrame:
    """(_key, _nth, _form, canonical): the tokens of every form under the rarest of them, which the fewest forms hold and which is the ``_nth``."""
    tokens = forms.select("form", "canonical", F.split("form", " ").alias("_form")).select("*", F.posexplode("_form").alias("_nth", "_key"))
    held = tokens.withColumn("held", F.count("*").over(Window.partitionBy("_key")))
    rarest = F.min_by(F.struct("_key", "_nth", "_form", "canonical"), F.struct("held", -F.length("_key"), "_nth"))
    return held.groupBy("form").agg(rarest.alias("entry")).select("entry.*")


def phrase_hits(docs: DataFrame, doc_id: str, text: str, forms: DataFrame, broadcast_forms: int = INDEX_FORMS) -> DataFrame:
    """Distinct (doc, canonical): all overlapping phrases count, there is no longest-match rule.

    Only where the key token of a form stands in a text are the tokens around it compared, whatever the number of
    forms and their lengths. While the index is sent out, tokens meet it where the text lies. A larger one meets the distinct tokens
    of the texts by shuffles, with frequent tokens spread; then each text is compared with the forms it may hold.
    """
    words = docs.select(doc_id, T.all_matches(F.lower(T.blank_if_null(F.col(text))), PHRASE_TOKEN).alias("_words"))
    index = phrase_index(forms)
    if forms.limit(broadcast_forms + 1).count() <= broadcast_forms:
        said = words.select(doc_id, "_words", F.posexplode_outer("_words").alias("_at", "_key"))
        met = said.join(F.broadcast(index), "_key")  # at most broadcast_forms rows
        return met.filter(_stands_at(F.col("_at") - F.col("_nth"))).select(doc_id, "canonical").distinct()
    by_key = index.groupBy("_key").agg(F.collect_list(F.struct("_form", "canonical")).alias("_forms"))
    said = words.select(F.col(doc_id).alias("_doc"), F.explode(F.array_distinct("_words")).alias("_key"))
    may = skew_join(said, by_key, "_key", "_doc", "inner").groupBy("_doc").agg(F.flatten(F.collect_list("_forms")).alias("_forms"))
    met = words.join(may, F.col(doc_id) == F.col("_doc")).select(doc_id, "_words", F.explode("_forms").alias("_entry")).select(doc_id, "_words", "_entry.*")
    starts = F.filter(F.sequence(F.lit(0), F.size("_words") - 1), lambda i: F.element_at("_words", i + 1) == F.element_at("_form", 1))
    return met.filter(F.exists(starts, _stands_at)).select(doc_id, "canonical").distinct()


def _stands_at(start: Column) -> Column:
    """Do the tokens of the form stand in the text from ``start``, counted from 0?"""
    return (start >= 0) & (F.slice("_words", F.greatest(start, F.lit(0)) + 1, F.size("_form")) == F.col("_form"))


def normalize_rows(rows: DataFrame, skill: str, aliases: DataFrame, row_id: str) -> DataFrame:
    """Add ``skill_key``: what ``aliases`` says, one hop or closed, else the lower-cased name itself. Frequent names are spread by ``row_id``."""
    keyed = rows.withColumn("alias", F.lower(T.strip(F.col(skill))))
    return skew_join(keyed, aliases, "alias", row_id).withColumn("skill_key", F.coalesce("canonical", "alias")).drop("alias", "canonical")


def skill_lists(rows: DataFrame, key: str, skill: str, aliases: DataFrame) -> DataFrame:
    """(key, skills, skill_keys): sorted distinct names, and array<struct<key, name>> with the first name per normalised key."""
    named = normalize_rows(rows.select(key, F.col(skill).alias("name")), "name", aliases, key)
    first = named.groupBy(key, "skill_key").agg(F.min("name").alias("first"), F.collect_set("name").alias("names"))
    lists = first.groupBy(key).agg(
        F.sort_array(F.flatten(F.collect_list("names"))).alias("skills"),
        F.sort_array(F.collect_list(F.struct(F.col("first").alias("name"), F.col("skill_key").alias("key")))).alias("_keys"))
    return lists.select(key, "skills", F.transform("_keys", lambda p: F.struct(p["key"].alias("key"), p["name"].alias("name"))).alias("skill_keys"))


@dataclass
class SkillRules:
    """The dictionary of one analysis: ``forms(form, canonical)`` and ``aliases(alias, canonical)``."""

    forms: DataFrame
    aliases: DataFrame

    def attach(self, rows: DataFrame, docs: DataFrame, doc_id: str, text: str) -> DataFrame:
        """``rows`` (one for each id) with the ``skills`` (sorted distinct canonical names) and ``skill_keys`` (see :func:`skill_lists`) of ``docs``.

        Only the rows given and the lists meet, so a text need not move.
        """
        hits = stored(phrase_hits(docs, doc_id, text, self.forms), "hits")  # read twice: for frequent names, then for the lists
        lists = skill_lists(hits, doc_id, "canonical", self.aliases)
        none = {c: F.coalesce(c, F.array().cast(lists.schema[c].dataType)) for c in ("skills", "skill_keys")}
        return rows.join(lists, doc_id, "left").withColumns(none)

    def with_skills(self, docs: DataFrame, doc_id: str, text: str) -> DataFrame:
        return self.attach(docs, docs, doc_id, text)


def shown_pairs(pairs: Column) -> Column:
    """Keyed skills with their names as a report shows them; done where a list lies, once, not once for each pair."""
    return F.transform(pairs, lambda p: F.struct(p["key"].alias("key"), T.display_case(p["name"]).alias("name")))


def overlap_parts(resume: Column, jd: Column) -> dict[str, Column]:
    """matched, missing, extra and overlap_pct of two lists of :func:`shown_pairs`, each on its own, so that a plan computes those it reads."""
    def keys(pairs: Column) -> Column:
        return F.transform(pairs, lambda p: p["key"])

    def names(pairs: Column) -> Column:
        return F.sort_array(F.transform(pairs, lambda p: p["name"]))

    def within(pairs: Column, other: Column) -> Column:
        return bind(keys(other), lambda known: F.filter(pairs, lambda p: F.array_contains(known, p["key"])))

    def beyond(pairs: Column, other: Column) -> Column:
        return bind(keys(other), lambda known: F.filter(pairs, lambda p: ~F.array_contains(known, p["key"])))

    return {
        "matched": names(within(resume, jd)), "missing": names(beyond(jd, resume)), "extra": names(beyond(resume, jd)),
        "overlap_pct": round1(share(F.size(F.array_intersect(keys(resume), keys(jd))), F.size(jd)) * F.lit(100.0)),
    }


def skill_overlap(resume: Column, jd: Column) -> Column:
    """struct(matched, missing, extra, overlap_pct) of two keyed skill lists."""
    return F.struct(*[c.alias(n) for n, c in overlap_parts(shown_pairs(resume), shown_pairs(jd)).items()])


def plain_extras(skills: Column) -> Column:
    """Skills shown when there is no opening: display names, distinct, sorted."""
    return F.sort_array(F.array_distinct(F.transform(skills, T.display_case)))
