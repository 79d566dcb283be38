"""People: every spelling of a name, discovery in the corpus, and resolution to a person.

``people`` has the columns of ``schemas.PEOPLE``; ``prio`` orders those who may
claim an alias first.  The roster is the caller's table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import EMAIL, fold, initials, plain, slug
from ..sources.store import stored

# Mailboxes of a role, pairs and words that look like names, and words of titles.
ROLE_MAILBOXES = "datenschutz info support noreply".split()
NOT_PEOPLE = [
    "unknown speaker", "retail group", "grocery retail", "supply chain", "image image", "kind regards", "best regards",
]
NOT_NAMES = (
    "the then she he they this that there these those it we you i and but so if when what which who how why where our "
    "their his her your my sollten sie wir das der die und mit von ist connect bild image from january february march "
    "april may june july august september october november december monday tuesday wednesday thursday friday saturday "
    "sunday best kind regards hi hello dear thanks thank subject re fw"
).split()
TITLE_WORDS = (
    "Manager Consultant Director Officer Lead Architect Executive Attendees Timeline Image Status Retail Chain Phase Group "
    "Track Delay Risk Configuration Financial Protection Sales Services"
).split()
NAME_PAIR = r"(?U)\b[A-ZÅÄÖØÆ][a-zåäöøæ]{2,}[^\S\n]+[A-ZÅÄÖØÆ][a-zåäöøæ\-]{2,}\b"


def aliases_for(display: Column, emails: Column) -> Column:
    """Every form in which a person may be written, in order."""
    words = F.filter(F.split(display, r"(?U)\s+"), lambda w: w != "")
    ascii_form = plain(display)
    ascii_words = F.filter(F.split(ascii_form, r"(?U)\s+"), lambda w: w != "")
    several = F.size(words) >= 2
    named = F.array(display, fold(display), ascii_form)
    parts = F.array(
        F.get(words, F.lit(0)), F.element_at(words, -1), F.concat_ws(" ", F.get(words, F.lit(0)), F.element_at(words, -1)),
        initials(display), F.element_at(ascii_words, -1),
    )
    local = F.transform(emails, lambda e: F.substring_index(e, "@", 1))
    spaced = F.transform(local, lambda e: F.replace(e, F.lit("."), F.lit(" ")))
    every = F.concat(named, F.when(several, parts).otherwise(F.array().cast("array<string>")), emails, local, spaced)
    return F.array_sort(F.array_distinct(F.filter(every, lambda a: F.coalesce(a, F.lit("")) != "")))


def with_aliases(people: DataFrame) -> DataFrame:
    return people.withColumn("aliases", aliases_for(F.col("display"), F.coalesce("emails", F.array().cast("array<string>"))))


def alias_table(people: DataFrame) -> DataFrame:
    """(alias, pid): folded alias to the person of least ``prio`` that has it."""
    prio = F.col("prio") if "prio" in people.columns else F.lit(0)
    forms = F.concat(F.array("display"), "aliases", "emails", F.array(initials(F.col("display"))))
    each = people.select("pid", prio.alias("prio"), F.explode(F.array_distinct(F.transform(forms, fold))).alias("alias"))
    return each.where("alias <> ''").groupBy("alias").agg(F.min_by("pid", F.struct("prio", "pid")).alias("pid"))


def discover_emails(texts: DataFrame, people: DataFrame, orgs: dict[str, str] | None = None) -> DataFrame:
    """(email, local, display, pid, org) of the addresses in ``texts`` (text) that nobody of ``people`` has."""
    found = texts.select(F.explode(F.regexp_extract_all("text", F.lit(EMAIL), F.lit(0))).alias("raw"))
    email = found.select(F.lower(F.regexp_replace("raw", r"\.+$", "")).alias("email")).distinct()
    known = people.select(F.explode("emails").alias("e")).select(fold(F.col("e")).alias("k")).distinct()
    local = F.substring_index("email", "@", 1)
    words = F.filter(F.split(local, "[._]"), lambda w: w != "")
    display = F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1000)))), " ")
    org = F.lit(None).cast("string")
    for part, name in reversed(list((orgs or {}).items())):
        org = F.when(F.contains(F.substring_index("email", "@", -1), F.lit(part)), name).otherwise(org)
    return (
        email.join(known, fold(F.col("email")) == F.col("k"), "left_anti")
        .where(~local.isin(ROLE_MAILBOXES))
        .select("email", local.alias("local"), display.alias("display"), slug(display).alias("pid"), org.alias("org"))
    )


def discover_names(texts: DataFrame, people: DataFrame, least: int = 2, order: str | None = None) -> DataFrame:
    """(name, n, pid): pairs of capitalised words seen ``least`` times or more that are no known person's.

    Names are taken one after the other, and one that shares a word with a known
    person or a name taken before is left: by their first place in the corpus if
    ``order`` is a column of ``texts`` that orders it, else the most frequent first
    (ties: by name).  That choice is made in rounds of joins over shared words: in
    each round the names that come first among the undecided ones of both their words
    are taken, and all that share a word with them are left.
    """
    at = F.struct("of", "k") if order else F.lit(0)
    found = texts.select((F.col(order) if order else F.lit(0)).alias("of"), F.posexplode(F.regexp_extract_all("text", F.lit(NAME_PAIR), F.lit(0))).alias("k", "name"))
    names = found.groupBy("name").agg(F.count("*").alias("n"), F.min(at).alias("at")).where(F.col("n") >= least)
    words = F.transform(F.split("name", r"(?U)\s+"), fold)
    bad = F.array(*[F.lit(w) for w in NOT_NAMES])
    title = "|".join(TITLE_WORDS)
    names = names.where(~fold(F.col("name")).isin(NOT_PEOPLE) & ~F.arrays_overlap(words, bad) & ~F.rlike("name", F.lit(rf"\b({title})\b")))
    taken = people.select(F.explode(F.split("display", r"(?U)\s+")).alias("w")).select(fold(F.col("w")).alias("w")).distinct()
    place = F.struct("at", "name") if order else F.struct((-F.col("n")).alias("at"), "name")
    each = names.select("name", "n", place.alias("place"), F.explode(F.array_distinct(words)).alias("w"))
    undecided = stored(without(each, taken), "names")
    chosen = undecided.select("name", "n").limit(0)
    while not undecided.isEmpty():
        first = undecided.groupBy("w").agg(F.min("place").alias("first"))
        best = undecided.join(first, "w").groupBy("name", "n").agg(F.bool_and(F.col("place") == F.col("first")).alias("best")).where("best")
        best = stored(best.select("name", "n"), "names")
        chosen = chosen.unionAll(best)
        gone = undecided.join(best.select("name"), "name", "left_semi").select("w").distinct()
        undecided = stored(without(undecided, gone), "names")
    return chosen.select("name", "n", slug(F.col("name")).alias("pid"))


def without(each: DataFrame, words: DataFrame) -> DataFrame:
    """Rows (name, w, ...) of the names that have none of some words."""
    return each.join(each.join(words, "w", "left_semi").select("name").distinct(), "name", "left_anti")


def build_registry(roster: DataFrame, texts: DataFrame, orgs: dict[str, str] | None = None, order: str | None = None) -> DataFrame:
    """The roster, then those found by address, then those found by name; addresses of one person are gathered."""
    base = with_aliases(roster).withColumn("prio", F.lit(0))
    mailed = discover_emails(texts, base, orgs)
    more = mailed.groupBy("pid").agg(F.array_sort(F.collect_set("email")).alias("more"), F.min("display").alias("d"), F.min("org").alias("o"))
    merged = base.join(more, "pid", "full").select(
        "pid", F.coalesce("display", "d").alias("display"), F.coalesce("org", "o").alias("org"), "role",
        F.concat(F.coalesce("emails", F.array().cast("array<string>")), F.coalesce("more", F.array().cast("array<string>"))).alias("emails"),
        F.coalesce("mention_only", F.lit(True)).alias("mention_only"), F.coalesce("prio", F.lit(1)).alias("prio"),
    )
    named = discover_names(texts, merged, order=order).join(merged.select("pid"), "pid", "left_anti").select(
        "pid", F.col("name").alias("display"), F.lit(None).cast("string").alias("org"), F.lit(None).cast("string").alias("role"),
        F.array().cast("array<string>").alias("emails"), F.lit(True).alias("mention_only"), F.lit(2).alias("prio"),
    )
    return with_aliases(merged.unionByName(named))


def keys_of(text: Column) -> tuple[Column, Column, Column]:
    """The three folded keys by which a text may name a person: whole, without a bracketed rest, its address."""
    email = F.regexp_replace(F.regexp_extract(text, EMAIL, 0), r"\.+$", "")
    return fold(text), fold(F.regexp_replace(text, r"(?Us)\s*[(<\[].*$", "")), fold(email)


def resolve(df: DataFrame, column: str, aliases: DataFrame, out: str = "pid") -> DataFrame:
    """``df`` with the person that ``column`` names, or null."""
    for k, key in enumerate(keys_of(F.col(column))):
        side = aliases.select(F.col("alias").alias(f"_alias{k}"), F.col("pid").alias(f"_pid{k}"))
        df = df.withColumn(f"_key{k}", F.nullif(key, F.lit(""))).join(side, F.col(f"_key{k}") == F.col(f"_alias{k}"), "left")
    found = F.coalesce(*[f"_pid{k}" for k in range(3)])
    return df.withColumn(out, found).drop(*[f"_{n}{k}" for n in ("alias", "pid", "key") for k in range(3)])


def search_person(people: DataFrame, needle: str) -> DataFrame:
    """Who ``needle`` may mean: the one it resolves to, or else all whose name holds it or who have it as an alias."""
    one = resolve(people.sparkSession.createDataFrame([(needle,)], "needle string"), "needle", alias_table(people), "found")
    exact = people.join(F.broadcast(one.where("found is not null").select(F.col("found").alias("pid"))), "pid", "left_semi")
    if not exact.isEmpty():
        return exact
    key = fold(F.lit(needle))
    return people.where(
        (key != "") & (F.contains(fold(F.col("display")), key) | F.exists("aliases", lambda a: fold(a) == key))
    )


def who_is(people: DataFrame, units: DataFrame, needle: str, most: int = 4, forms: int = 8) -> DataFrame:
    """Cards of those who ``needle`` may mean, with their number of live units."""
    who = search_person(people, needle).orderBy("pid").limit(most)
    n = units.groupBy(F.col("speaker").alias("pid")).agg(F.count_if(~F.coalesce("redacted", F.lit(False))).alias("n"))
    return who.join(n, "pid", "left").select(
        "pid", "display", "org", "role", "emails", F.slice("aliases", 1, forms).alias("aliases"), "mention_only",
        F.coalesce("n", F.lit(0)).alias("n_units"),
    )


def alias_patterns(people: DataFrame) -> DataFrame:
    """(pid, forms): all forms of a person, longest first."""
    every = F.array_distinct(F.concat(F.array("display"), "aliases", "emails"))
    longest = F.transform(
        F.array_sort(F.transform(F.filter(every, lambda a: a != ""), lambda a: F.struct((-F.length(a)).alias("n"), a.alias("a")))),
        lambda x: x["a"],
    )
    return people.select("pid", longest.alias("forms"))
