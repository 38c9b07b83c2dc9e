"""Evidence for an affiliation in web pages: visible text, names, nearness, domains, and the status.

Pages are a table; nothing is fetched.  Text is extracted by regular expressions, scoring is array
expressions, all in the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from concord.session import table

# Fixed values.
DROPPED = "script|style|nav|footer|header|noscript|iframe"
SPA = ["google.com/maps", "maps.google.", "maps.app.goo.gl", "goo.gl/maps", "lh3.googleusercontent.com", "googleusercontent.com/p/"]
LINK_WORDS = [
    "doctor", "doctors", "our doctors", "our team", "team", "staff", "consultants", "specialists", "medical team", "faculty", "physicians", "find a doctor", "our specialists", "meet our", "medical staff", "departments", "department",
    "dermatology", "cardiology", "orthopedic", "pediatric", "gynaecology", "gynecology", "ent", "ophthalmology", "neurology", "general medicine", "surgery",
]
LINKS = 15
NAME_VARIANTS = {
    "muhammad": ["mohammed", "muhammed", "mohamed", "mohammad", "mohamad", "md"],
    "mohammed": ["muhammad", "muhammed", "mohamed", "mohammad", "mohamad", "md"],
    "muhammed": ["muhammad", "mohammed", "mohamed", "mohammad", "mohamad", "md"],
    "mohamed": ["muhammad", "mohammed", "muhammed", "mohammad", "mohamad", "md"],
    "mohammad": ["muhammad", "mohammed", "muhammed", "mohamed", "mohamad", "md"],
    "abdul": ["abdool", "abdhul", "abd"],
    "abdur": ["abdoor", "abd"],
    "ahmad": ["ahmed", "ahamed", "ahammed"],
    "ahmed": ["ahmad", "ahamed", "ahammed"],
    "ahamed": ["ahmad", "ahmed", "ahammed"],
    "naseef": ["nasif", "naseeph", "nasief"],
    "nasif": ["naseef", "naseeph"],
    "rahim": ["raheem", "rahime"],
    "raheem": ["rahim", "rahime"],
    "rajan": ["raajan", "rajn"],
    "ramesh": ["ramsh", "rammesh"],
    "suresh": ["sursh", "sureesh"],
    "ganesh": ["ganeesh", "gansh"],
    "krishna": ["krishn", "krshna", "krishnaa"],
    "gopal": ["gopaal", "gopala"],
    "kumar": ["kumarr", "kumaar"],
    "prasad": ["prashad", "prasaad"],
    "shankar": ["sankar", "shankerr", "shankhar"],
    "venkat": ["venkt", "venkatesh"],
    "lakshmi": ["laxmi", "lakshmy"],
    "laxmi": ["lakshmi", "lakshmy"],
    "shri": ["sri", "shree", "sree"],
    "sri": ["shri", "shree", "sree"],
    "syed": ["saiyed", "saiyad", "sayyed", "sayyid"],
    "shaikh": ["sheikh", "shaik", "shk"],
    "sheikh": ["shaikh", "shaik", "shk"],
    "iqbal": ["ikbal", "eqbal"],
    "amrit": ["amrith", "amrita"],
    "amrita": ["amritha", "amrit"],
}
#: The ladder of phase 2: from these scores on a candidate wins at once, ends the search, is found, confirms the affiliation.
AT_ONCE, ENOUGH, FOUND, AFFILIATED = 85, 70, 50, 70
QUERIES_RUN, FETCHES = 10, 5
HCO_STOP = ["dept", "of", "the", "and", "for", "in", "at", "a", "-", "/", "&", "pvt", "ltd", "private", "limited"]
NEAR, PERSON_OK, ORG_OK = 60, 75, 70


def page_text(html: Column, limit: int | None = None) -> Column:
    """Visible text, space-joined: without comments, dropped elements and tags; common entities resolved; whole unless cut at ``limit``."""
    text = F.regexp_replace(F.coalesce(html, F.lit("")), "(?s)<!--.*?-->", " ")
    text = F.regexp_replace(text, f"(?is)<({DROPPED})\\b[^>]*>.*?</\\1\\s*>", " ")
    text = F.regexp_replace(text, "(?s)<[^>]*>", " ")
    for entity, plain in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(plain))
    text = F.trim(F.regexp_replace(text, "\\s+", " "))
    return text if limit is None else F.left(text, F.lit(limit))


def links(html: Column) -> Column:
    """``(href, text)`` of all anchors."""
    found = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(r'(?is)<a\s[^>]*href="([^"]*)"[^>]*>.*?</a>'), F.lit(0))
    return F.transform(found, lambda a: F.struct(F.regexp_extract(a, r'(?is)href="([^"]*)"', 1).alias("href"), F.trim(F.regexp_replace(a, "(?s)<[^>]*>", " ")).alias("text")))


def non_latin(text: Column, threshold: float = 0.15, limit: int | None = None) -> Column:
    """More than the threshold of the characters (of the first ``limit``, if given) lie beyond U+024F."""
    sample = text if limit is None else F.left(text, F.lit(limit))
    return F.length(F.regexp_replace(sample, "[\\u0000-\\u024F\\s]", "")) / F.greatest(F.length(sample), F.lit(1)) > threshold


def org_words(name: Column) -> Column:
    base = F.substring_index(F.coalesce(name, F.lit("")), " - ", 1)
    return F.filter(F.transform(F.split(base, r"[\s/\-&]+"), F.lower), lambda w: (F.length(w) > 2) & ~w.isin(HCO_STOP))


def domain_label(url: Column) -> Column:
    host = F.lower(F.coalesce(F.try_parse_url(url, F.lit("HOST")), F.lit("")))
    return F.substring_index(F.replace(host, F.lit("www."), F.lit("")), ".", 1)


def domain_matches(url: Column, name: Column) -> Column:
    """A word of more than three letters, or an acronym of three or more, in the host's first label."""
    label = domain_label(url)
    base = F.substring_index(F.coalesce(name, F.lit("")), " - ", 1)
    parts = F.filter(F.split(base, r"[\s\-&/]+"), lambda w: F.length(w) > 1)
    short = F.array_join(F.transform(parts, lambda w: F.lower(F.left(w, F.lit(1)))), "")
    return F.exists(org_words(name), lambda w: (F.length(w) > 3) & F.contains(label, w)) | ((F.size(parts) >= 3) & F.contains(label, short))


def near(words: Column, first: Column, last: Column, within: int = NEAR) -> Column:
    """Whether words holding ``first`` and ``last`` stand within so many words of each other."""
    at = lambda name: F.filter(F.transform(words, lambda w, i: F.when(F.contains(w, name), i)), lambda i: i.isNotNull())
    return F.exists(at(first), lambda i: F.exists(at(last), lambda j: F.abs(i - j) <= within))


def _variants() -> dict[str, list[str]]:
    """Every listed spelling with all that it may stand for: its own list and the lists that it is in."""
    known = {*NAME_VARIANTS, *(v for vs in NAME_VARIANTS.values() for v in vs)}
    return {w: sorted({*NAME_VARIANTS.get(w, []), *(x for k, vs in NAME_VARIANTS.items() if w in vs for x in (k, *vs))} - {w}) for w in sorted(known)}


def spellings(part: Column) -> Column:
    """Other spellings of a name part; none for an unlisted one."""
    table = F.create_map(*[x for w, vs in _variants().items() for x in (F.lit(w), F.array(*[F.lit(v) for v in vs]))])
    return F.coalesce(table[part], F.array().cast("array<string>"))


def near_spelt(words: Column, first: Column, last: Column, within: int = NEAR) -> Column:
    """As ``near``, with words that hold any spelling of a name."""

    def places(name: Column) -> Column:
        # bound as a lambda variable, the spellings are looked up once
        found = F.transform(F.array(F.array_append(spellings(name), name)), lambda ns: F.filter(F.transform(words, lambda w, i: F.when(F.exists(ns, lambda v: F.contains(w, v)), i)), lambda i: i.isNotNull()))
        return F.get(found, F.lit(0))

    return F.exists(places(first), lambda i: F.exists(places(last), lambda j: F.abs(i - j) <= within))


def doctor_links(url: Column, html: Column, limit: int = LINKS) -> Column:
    """Distinct absolute links of the page's own domain whose words promise a list of people, in order, ``limit`` at most."""
    host = F.coalesce(F.regexp_extract(url, "://([^/?#]*)", 1), F.lit(""))
    base = F.concat(F.regexp_extract(url, "^([^:]*)://", 1), F.lit("://"), host)
    wanted = lambda a: F.lower(F.concat(a["text"], F.lit(" "), a["href"])).rlike("|".join(LINK_WORDS)) & ~F.trim(a["href"]).rlike("^(#|mailto:|tel:)")

    def whole(a: Column) -> Column:
        href = F.trim(a["href"])
        return F.when(F.startswith(href, F.lit("http")), href).when(F.startswith(href, F.lit("/")), F.concat(base, href)).otherwise(F.concat(base, F.lit("/"), href))

    found = F.transform(F.filter(links(html), wanted), whole)
    own = F.filter(found, lambda u: F.contains(F.regexp_extract(u, "://([^/?#]*)", 1), host))
    return F.slice(F.array_distinct(own), 1, limit)


def name_score(name: Column, text: Column, first: Column | None = None, last: Column | None = None) -> Column:
    """100 for the whole name, 95 for all its parts, 90 for all in some spelling (40 if first and last stand far apart), else their share of 75."""
    n, t = F.lower(F.trim(F.coalesce(name, F.lit("")))), F.lower(F.coalesce(text, F.lit("")))
    parts = F.filter(F.split(n, r"\s+"), lambda p: F.length(p) > 2)
    hits = F.size(F.filter(parts, lambda p: F.contains(t, p)))
    all_ = (F.size(parts) > 0) & (hits == F.size(parts))
    spelt = F.size(F.filter(parts, lambda p: F.contains(t, p) | F.exists(spellings(p), lambda v: F.contains(t, v))))
    if first is None:
        close = F.lit(True)
    else:
        f, l, words = F.lower(F.trim(first)), F.lower(F.trim(last)), F.split(t, r"\s+")  # noqa: E741
        near_by = F.when(F.contains(t, f) & F.contains(t, l), near(words, f, l)).otherwise(near_spelt(words, f, l))
        close = (f == "") | (l == "") | near_by
    full = F.when(~close, 40).otherwise(F.when(all_, 95).otherwise(90))
    share = (F.greatest(hits, spelt) / F.greatest(F.size(parts), F.lit(1)) * 75).cast("int")
    return F.when((n == "") | (t == ""), 0).when(F.contains(t, n), 100).when(F.size(parts) == 0, 0).when(all_ | (spelt == F.size(parts)), full).otherwise(share)


def judged(pages: DataFrame) -> DataFrame:
    """Scores and the status of each claim: columns url, html, first, last, org."""
    rows = pages.withColumn("text", page_text(F.col("html")))
    rows = rows.withColumns({"person_score": name_score(F.concat_ws(" ", "first", "last"), F.col("text"), F.col("first"), F.col("last")), "org_score": name_score(F.col("org"), F.col("text")), "on_domain": domain_matches(F.col("url"), F.col("org")), "foreign": non_latin(F.col("text"))})
    person, org = F.col("person_score") >= PERSON_OK, (F.col("org_score") >= ORG_OK) | F.col("on_domain")
    spa = F.col("url").rlike("|".join(s.replace(".", "\\.") for s in SPA))
    status = F.when(spa, "spa_url").when(F.col("html").isNull(), "dead_url").when(person & org, "confirmed").when(person, "partial_hcp").when(org, "partial_hco").when(F.col("foreign") & (F.col("person_score") < 50), "non_latin_content").otherwise("not_found")
    return rows.withColumn("status", status)


def candidate_score(last: Column, org: Column, href: Column, snippet: Column, text: Column, person: Column, group: Column) -> Column:
    """Score of a search result, best evidence first; null where there is none.

    ``text``, ``person`` and ``group`` are of the result's page, null where it could not be read.
    """
    said, low = F.lower(F.coalesce(snippet, F.lit(""))), F.lower(F.coalesce(text, F.lit("")))
    name = F.lower(F.trim(F.coalesce(last, F.lit(""))))
    holds = lambda where: (name != "") & (F.contains(where, name) | F.exists(spellings(name), lambda v: F.contains(where, v)))
    hcp, hco, domain = holds(said), F.exists(org_words(org), lambda w: F.contains(said, w)), F.coalesce(domain_matches(href, org), F.lit(False))
    read, own = text.isNotNull(), holds(low)
    return (
        F.when(hcp & (hco | domain), 90).when(read & (person >= PERSON_OK) & ((group >= ORG_OK) | domain), 100).when(read & (person >= PERSON_OK), 70)
        .when(read & own & ((group >= 60) | domain), 55).when(read & own, 35).when(hcp, 30).when(hco | domain, 20)
    )


def ladder(results: DataFrame) -> DataFrame:
    """One row a claim with results: the chosen candidate, what it amounts to, and the confidence.

    ``results``: claim, query, place (of the result in its query), href, score (null: no evidence).  Each
    address counts where it first occurs, QUERIES_RUN queries and FETCHES results a query are looked at.
    The first score of AT_ONCE wins; after a query with ENOUGH no other is run; else the best wins, the
    first of equals.
    """
    first = Window.partitionBy("claim", "href").orderBy("query", "place")
    fresh = results.where(F.col("query") < QUERIES_RUN).withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    looked = fresh.withColumn("_m", F.row_number().over(Window.partitionBy("claim", "query").orderBy("place"))).where(F.col("_m") <= FETCHES).where("score is not null")
    last = looked.where(F.col("score") >= ENOUGH).groupBy("claim").agg(F.min("query").alias("_end"))
    run = looked.join(last, "claim", "left").where("_end is null or query <= _end")
    at = F.struct("query", "place", "href", "score")
    best = run.groupBy("claim").agg(F.min(F.when(F.col("score") >= AT_ONCE, at)).alias("won"), F.max_by(at, F.struct("score", (-F.col("query")).alias("q"), (-F.col("place")).alias("p"))).alias("top"))
    chosen = best.withColumn("c", F.coalesce("won", "top"))
    score = F.col("c.score")
    return chosen.select(
        "claim", F.col("c.href").alias("href"), score.alias("score"), F.when(score >= FOUND, "found").otherwise("suggested").alias("lead"), (score >= AFFILIATED).alias("affiliated"),
        F.when(score >= 85, "High").when(score >= 50, "Medium").otherwise("Low").alias("confidence"),
    )


def final_label(status: Column, lead: Column) -> Column:
    """Label of a claim by its own page and by the best other page (its ``verdict``: found, suggested or null)."""
    return F.when(status == "confirmed", "Confirmed").when(lead == "found", "Confirmed (New URL)").when(lead == "suggested", "Suggested Lead").when(status.startswith("partial"), "Partial Match").otherwise("Unconfirmed")


def _claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with a claim from their own title: its first two words as a name, its last two as an organisation."""
    title = F.regexp_replace(F.regexp_extract("html", "(?is)<title>(.*?)</title>", 1), "[^\\p{L} ]+", "")
    words = F.filter(F.split(title, " +"), lambda w: w != "")
    word = lambda i: F.coalesce(F.try_element_at(words, F.lit(i)), F.lit(""))
    return table(spark, sf_dir, "pages").select("page_id", "url", "html", F.when(F.col("page_id") % 3 == 0, "nobody").otherwise(word(1)).alias("first"), word(2).alias("last"), F.when(F.col("page_id") % 2 == 0, F.concat(word(-2), F.lit(" "), word(-1))).otherwise(F.lit("unknown place")).alias("org"))


def evidence_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(_claims(spark, sf_dir)).select("page_id", "first", "last", "org", "person_score", "org_score", "on_domain", "status")


def evidence_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = judged(_claims(spark, sf_dir))
    return done.groupBy("status", final_label(F.col("status"), F.lit(None).cast("string")).alias("label")).agg(F.count("*").alias("pages"))


def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links a page, and links whose words promise a list of people."""
    wanted = lambda a: F.lower(F.concat(a["href"], F.lit(" "), a["text"])).rlike("|".join(LINK_WORDS))
    rows = table(spark, sf_dir, "pages").select("page_id", links(F.col("html")).alias("l"))
    return rows.select("page_id", F.size("l").alias("n_links"), F.size(F.filter("l", wanted)).alias("n_wanted"), F.size(F.array_distinct(F.transform("l", lambda a: a["href"]))).alias("n_targets"))


def page_doctor_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "pages").select("page_id", F.explode(doctor_links(F.col("url"), F.col("html"))).alias("link"))
    return rows.groupBy("page_id").agg(F.count("*").alias("n"), F.md5(F.array_join(F.array_sort(F.collect_list("link")), "\n").cast("binary")).alias("links_md5"))


def evidence_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims by status with their share of all, in per cent."""
    done = judged(_claims(spark, sf_dir)).groupBy("status").agg(F.count("*").alias("claims"))
    return done.crossJoin(F.broadcast(done.agg(F.sum("claims").alias("all")))).select("status", "claims", F.round(F.col("claims") * 100.0 / F.col("all"), 1).alias("pct"))


def evidence_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phase 2 for every claim: three queries of three results each, which are other pages with their titles as snippets; and the final label."""
    claims = judged(_claims(spark, sf_dir)).select("page_id", "first", "last", "org", "status")
    count = claims.agg(F.count("*")).first()[0]
    rows = claims.withColumn("query", F.explode(F.array(*[F.lit(i) for i in range(3)]))).withColumn("place", F.explode(F.array(*[F.lit(i) for i in range(3)])))
    rows = rows.withColumn("target", F.expr(f"if(place = 0 and query = 1, page_id, pmod(page_id * 7 + query * 3 + place * 5, {max(1, count)}))"))
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("target"), F.col("url").alias("href"), F.when(F.col("page_id") % 4 != 1, page_text(F.col("html"))).alias("text"), F.regexp_extract("html", "(?is)<title>(.*?)</title>", 1).alias("snippet"))
    rows = rows.join(pages, "target")
    read = rows.withColumns({"person": name_score(F.concat_ws(" ", "first", "last"), F.col("text"), F.col("first"), F.col("last")), "group": name_score(F.col("org"), F.col("text"))})
    scored = read.select(F.col("page_id").alias("claim"), "query", "place", "href", candidate_score(F.col("last"), F.col("org"), F.col("href"), F.col("snippet"), F.col("text"), F.col("person"), F.col("group")).alias("score"))
    done = claims.join(ladder(scored), claims.page_id == F.col("claim"), "left")
    return done.select("page_id", "status", F.coalesce("href", F.lit("")).alias("href"), F.coalesce("score", F.lit(0)).alias("score"), F.coalesce("confidence", F.lit("")).alias("confidence"), F.coalesce("affiliated", F.lit(False)).alias("affiliated"), final_label(F.col("status"), F.col("lead")).alias("label"))


_PAGE = """regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '(?s)<!--.*?-->', ' ', 'g'), '{drop}', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g')"""
_DROP = "|".join(f"<{t}\\b[^>]*>.*?</{t}\\s*>" for t in DROPPED.split("|"))
_TEXT = _PAGE.format(drop=f"(?is)(?:{_DROP})")
for _e, _p in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&")):
    _TEXT = f"replace({_TEXT}, '{_e}', '{_p}')"
_LINKS = "regexp_extract_all(coalesce(html, ''), '(?is)<a\\s[^>]*href=\"([^\"]*)\"[^>]*>.*?</a>', 0)"

ORACLES = {
    "page_links": f"""with l as (select page_id, list_transform({_LINKS}, lambda a: regexp_extract(a, '(?is)href="([^"]*)"', 1)) as h, list_transform({_LINKS}, lambda a: trim(regexp_replace(a, '(?s)<[^>]*>', ' ', 'g'))) as t from pages)
select page_id, len(h)::int as n_links, len(list_filter(list_zip(h, t), lambda z: regexp_matches(lower(z[1] || ' ' || z[2]), '{"|".join(LINK_WORDS)}')))::int as n_wanted, len(list_distinct(h))::int as n_targets from l""",
}
ORACLES["page_text"] = f"select page_id, md5(trim(regexp_replace({_TEXT}, '\\s+', ' ', 'g'))) as text_md5 from pages"


def page_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.md5(page_text(F.col("html"))).alias("text_md5"))


_CLAIMS = f"""c as (select page_id, url, html, list_filter(string_split_regex(regexp_replace(regexp_extract(html, '(?is)<title>(.*?)</title>', 1), '[^\\p{{L}} ]+', '', 'g'), ' +'), lambda w: w <> '') as w,
 trim(regexp_replace({_TEXT}, '\\s+', ' ', 'g')) as text from pages),
n as (select *, case when page_id % 3 = 0 then 'nobody' else coalesce(w[1], '') end as first, coalesce(w[2], '') as last, case when page_id % 2 = 0 then coalesce(w[-2], '') || ' ' || coalesce(w[-1], '') else 'unknown place' end as org, lower(text) as t,
 split_part(replace(lower(regexp_extract(url, '://([^/?#]*)', 1)), 'www.', ''), '.', 1) as label from c)"""
_STEPS = """l as (select *, lower(trim(first || ' ' || last)) as pn, lower(trim(org)) as og, string_split_regex(t, '\\s+') as tw, lower(first) as lf, lower(last) as ll from n),
a as (select *, list_filter(string_split_regex(pn, '\\s+'), lambda p: length(p) > 2) as pp, list_filter(string_split_regex(og, '\\s+'), lambda p: length(p) > 2) as op,
 list_filter(range(len(tw)), lambda i: contains(tw[i + 1], lf)) as fa, list_filter(range(len(tw)), lambda i: contains(tw[i + 1], ll)) as la from l),
h as (select *, len(list_filter(pp, lambda p: contains(t, p))) as ph, len(list_filter(op, lambda p: contains(t, p))) as oh, len(list_filter(fa, lambda i: len(list_filter(la, lambda j: abs(i - j) <= 60)) > 0)) > 0 as close,
 len(list_filter(string_split_regex(lower(org), '[\\s/&-]+'), lambda x: length(x) > 3 and x not in ('dept', 'private', 'limited') and contains(label, x))) > 0 as on_domain from a),
sc as (select *, case when pn = '' or t = '' then 0 when contains(t, pn) then 100 when len(pp) = 0 then 0 when ph = len(pp) then case when lf = '' or ll = '' or close then 95 else 40 end else floor(ph::double / len(pp) * 75)::int end as person_score,
 case when og = '' or t = '' then 0 when contains(t, og) then 100 when len(op) = 0 then 0 when oh = len(op) then 95 else floor(oh::double / len(op) * 75)::int end as org_score from h),
st as (select *, case when html is null then 'dead_url' when person_score >= 75 and (org_score >= 70 or on_domain) then 'confirmed' when person_score >= 75 then 'partial_hcp' when org_score >= 70 or on_domain then 'partial_hco' else 'not_found' end as status from sc)"""
_JUDGED = f"with {_CLAIMS},\n{_STEPS}"
ORACLES["evidence_status"] = _JUDGED + " select page_id, first, last, org, person_score::int as person_score, org_score::int as org_score, on_domain, status from st"
ORACLES["evidence_summary"] = _JUDGED + " select status, case when status = 'confirmed' then 'Confirmed' when starts_with(status, 'partial') then 'Partial Match' else 'Unconfirmed' end as label, count(*) as pages from st group by 1, 2"
# the ladder: the same steps over each claim beside each of its results' pages
_RESULTS = _STEPS.replace("l as (", "l2 as (").replace("a as (", "a2 as (").replace("h as (", "h2 as (").replace("sc as (", "sc2 as (").replace("st as (", "st2 as (").replace("from n)", "from m)").replace("from l)", "from l2)").replace("from a)", "from a2)").replace("from h)", "from h2)").replace("from sc)", "from sc2)")
ORACLES["evidence_ladder"] = _JUDGED + f""",
r as (select s.page_id as claim, s.status, s.first, s.last, s.org, q as query, z as place, case when z = 0 and q = 1 then s.page_id else (s.page_id * 7 + q * 3 + z * 5) % (select count(*) from pages) end as target from st s, (select unnest([0, 1, 2]) as q), (select unnest([0, 1, 2]) as z)),
m as (select r.claim, r.query, r.place, r.first, r.last, r.org, n.url, n.html, case when target % 4 <> 1 then n.text end as text, coalesce(case when target % 4 <> 1 then n.t end, '') as t, n.label, lower(regexp_extract(n.html, '(?is)<title>(.*?)</title>', 1)) as said from r join n on n.page_id = r.target),
{_RESULTS},
v as (select *, ll <> '' and contains(said, ll) as hcp, len(list_filter(list_filter(string_split_regex(lower(org), '[\\s/&-]+'), lambda w: length(w) > 2 and w not in ({", ".join(f"'{w}'" for w in HCO_STOP)})), lambda w: contains(said, w))) > 0 as hco, text is not null as seen, ll <> '' and contains(t, ll) as own from st2),
w as (select claim, query, place, url as href, case when hcp and (hco or on_domain) then 90 when seen and person_score >= 75 and (org_score >= 70 or on_domain) then 100 when seen and person_score >= 75 then 70 when seen and own and (org_score >= 60 or on_domain) then 55 when seen and own then 35 when hcp then 30 when hco or on_domain then 20 end as score from v),
f as (select * from (select *, row_number() over (partition by claim, href order by query, place) as k from w) where k = 1 and score is not null),
e as (select claim, min(query) as stop from f where score >= 70 group by 1),
g as (select f.* from f left join e using (claim) where stop is null or query <= stop),
b as (select * from (select *, row_number() over (partition by claim order by (score >= 85)::int desc, case when score >= 85 then 0 else -score end, query, place) as rn from g) where rn = 1)
select page_id, status, coalesce(b.href, '') as href, coalesce(score, 0)::int as score, case when score is null then '' when score >= 85 then 'High' when score >= 50 then 'Medium' else 'Low' end as confidence, coalesce(score >= 70, false) as affiliated,
 case when status = 'confirmed' then 'Confirmed' when score >= 50 then 'Confirmed (New URL)' when score is not null then 'Suggested Lead' when starts_with(status, 'partial') then 'Partial Match' else 'Unconfirmed' end as label from st left join b on b.claim = page_id"""
ORACLES["evidence_rates"] = _JUDGED + " select status, count(*) as claims, round(count(*) * 100.0 / (select count(*) from st), 1) as pct from st group by 1"
ORACLES["page_doctor_links"] = f"""with l as (select page_id, url, unnest({_LINKS}) as a from pages),
h as (select page_id, url, trim(regexp_extract(a, '(?is)href="([^"]*)"', 1)) as href, trim(regexp_replace(a, '(?s)<[^>]*>', ' ', 'g')) as t, row_number() over () as i from l),
w as (select page_id, i, regexp_extract(url, '://([^/?#]*)', 1) as host, case when starts_with(href, 'http') then href when starts_with(href, '/') then regexp_extract(url, '^([^:]*)://', 1) || '://' || regexp_extract(url, '://([^/?#]*)', 1) || href else regexp_extract(url, '^([^:]*)://', 1) || '://' || regexp_extract(url, '://([^/?#]*)', 1) || '/' || href end as u
 from h where regexp_matches(lower(t || ' ' || href), '{"|".join(LINK_WORDS)}') and not regexp_matches(href, '^(#|mailto:|tel:)')),
d as (select page_id, u, min(i) as i from w where contains(regexp_extract(u, '://([^/?#]*)', 1), host) group by 1, 2),
k as (select * from (select *, row_number() over (partition by page_id order by i) as n from d) where n <= 15)
select page_id, count(*) as n, md5(array_to_string(list_sort(list(u)), chr(10))) as links_md5 from k group by 1"""
QUERIES = {"evidence_ladder": evidence_ladder, "evidence_rates": evidence_rates, "page_doctor_links": page_doctor_links, "evidence_status": evidence_status, "evidence_summary": evidence_summary, "page_links": page_links, "page_text": page_texts}
