"""More registered queries: records and scans, write-backs, pay, names, the aggregates behind the figures, fits, streams and exports. Tables stand for
the same things as in ``catalogue``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed, money, rules, text
from ..operators import features, ingest, metrics, models, records, skills
from ..session import scratch
from ..sources import io
from ..streaming import incremental
from ..streaming.buckets import BucketTable
from .steps import collect
from .catalogue import PRIORITIES, _CLUST, _RES, _clustered, _ordered, _residuals, query

# ---- records, links and scans ----

_SITE = records.Site("site", r"/(\d+)", title=("h1", None, None), company=(None, "data-qa", "company"), pay=("div", "class", "pay"))


@query(
    r"""SELECT page_id, coalesce(nullif(regexp_extract(url, '/(\d+)', 1), ''), regexp_extract(regexp_replace(regexp_replace(url, '[?#].*$', ''), '/+$', ''), '[^/]*$')) AS vacancy_id, 'site' AS source,
    CASE WHEN page_id % 2 = 0 THEN 'T' || page_id ELSE 'H' || page_id END AS title, CASE WHEN page_id % 2 = 0 THEN 'Org ' || (page_id % 7) ELSE 'Firm' END AS company_name, CASE WHEN page_id % 2 = 0 THEN 'Town' END AS location,
    CAST(CASE WHEN page_id % 4 = 0 THEN page_id * 10 ELSE page_id * 1000 END AS DOUBLE) AS salary_from, CAST(CASE WHEN page_id % 4 = 0 THEN page_id * 20 END AS DOUBLE) AS salary_to, CASE WHEN page_id % 4 = 0 THEN 'EUR' ELSE 'USD' END AS currency,
    CAST(NULL AS VARCHAR) AS description, page_id % 2 = 0 AS remote, CASE WHEN page_id % 2 = 0 THEN '2024-03-05 07:00:00' END AS published FROM pages"""
)
def page_records(t, spark):
    """S7-S9, F18, F24, F25, F35, F44."""
    i = F.col("page_id").cast("string")
    base = F.when(F.col("page_id") % 4 == 0, F.concat(F.lit('"baseSalary":{"currency":"EUR","value":{"minValue":'), F.col("page_id") * 10, F.lit(',"maxValue":"'), F.col("page_id") * 20, F.lit('"}},'))).otherwise(F.lit('"baseSalary":"by agreement",'))
    posting = F.concat(F.lit('<script type="application/ld+json">{broken</script><script type="application/ld+json">[{"@type":"Other"},{"@type":"JobPosting","title":"T'), i, F.lit('","jobLocation":{"address":{"addressLocality":"Town"}},"hiringOrganization":{"name":"Org '), F.col("page_id") % 7, F.lit('"},'), base, F.lit('"datePosted":"2024-03-05T10:00:00+03:00","jobLocationType":"TELECOMMUTE"}]</script>'))
    shown = F.concat(F.lit('<div class="pay big">since '), i, F.lit(' 000 $</div><span data-qa="company"> Firm </span><h1>H'), i, F.lit("</h1>"))
    pages = t("pages").select("page_id", "url", F.concat(F.when(F.col("page_id") % 2 == 0, posting).otherwise(F.lit("")), shown, "html").alias("html"))
    out = records.record(pages, _SITE, upto="upto", since="since")
    return out.select("page_id", *(c for c in records.FIELDS if c != "published_at"), F.date_format("published_at", "yyyy-MM-dd HH:mm:ss").alias("published"))


@query(
    """WITH q AS (SELECT page_id, page_id % 3 = 0 AS done, row_number() OVER (PARTITION BY page_id % 3 = 0 ORDER BY page_id) AS rn FROM pages), s AS (SELECT page_id, CASE WHEN done THEN 'done' WHEN rn > 30 THEN 'pending' WHEN page_id % 5 = 0 THEN 'error' ELSE 'done' END AS status, CASE WHEN NOT done AND rn <= 30 AND page_id % 5 = 0 THEN 'no page' END AS error FROM q)
    SELECT page_id, status, error, CASE WHEN page_id % 3 = 0 THEN 'old ' || page_id WHEN status = 'done' THEN 'H' || page_id END AS title FROM s"""
)
def collect_pages(t, spark):
    """A batch of the queue, its landed pages as records, merged into the table, and the queue's new status."""
    k = F.col("page_id")
    queue = t("pages").select(k.alias("id"), F.concat(F.lit("http://a.example/v/"), k).alias("url"), F.lit("site").alias("source"), F.when(k % 3 == 0, "done").otherwise("pending").alias("status"), F.lit("2024-01-01 00:00:00").cast("timestamp").alias("updated_at"), F.lit(None).cast("string").alias("error"))
    landed = t("pages").where(k % 5 > 0).select(F.concat(F.lit("http://a.example/v/"), k).alias("url"), F.concat(F.lit("<h1>H"), k, F.lit("</h1>")).alias("html"))
    known = t("pages").where(k % 3 == 0).select(k.cast("string").alias("vacancy_id"), F.lit("site").alias("source"), F.concat(F.lit("old "), k).alias("title"))
    rows, status = collect(queue, landed, known, _SITE, 30, F.lit("2024-01-02 00:00:00").cast("timestamp"))
    return status.select(F.col("id").alias("page_id"), "status", "error").join(rows.select(F.col("vacancy_id").cast("long").alias("page_id"), "title"), "page_id", "left")


@query(
    r"""WITH l AS (SELECT regexp_extract_all(html, 'href="(/[a-z]{1,4})"', 1) AS a, regexp_extract_all(html, 'href="(/[^"?#]*)"', 1) AS b FROM pages)
    SELECT DISTINCT 'http://base.example' || unnest(CASE WHEN len(a) > 0 THEN a ELSE b END) AS link FROM l"""
)
def page_links(t, spark):
    """S5, U1."""
    return records.found_links(t("pages"), "html", "http://base.example/x/y", "/[a-z]{1,4}", '/[^"?#]*')


@query("SELECT doc_id, source FROM documents WHERE source = 'src1' AND text IS NOT NULL ORDER BY doc_id LIMIT 20 OFFSET 5")
def source_scan(t, spark):
    """S12, S13, P9, T2."""
    return ingest.scan(t("documents").select("doc_id", "source", "text"), "doc_id", F.col("source") == "src1", None, F.col("text").isNotNull(), limit=20, offset=5).select("doc_id", "source")


_SKILLED = "p AS (SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN NULL WHEN p_partkey % 4 = 1 THEN [] ELSE string_split(p_name, ' ') END AS skills, CASE WHEN p_partkey % 5 = 0 THEN NULL WHEN p_partkey % 5 = 1 THEN '' ELSE p_brand END AS grade, CASE WHEN p_partkey % 3 > 0 THEN p_retailprice END AS low, CASE WHEN p_partkey % 7 = 0 THEN p_retailprice END AS high FROM part)"


@query(f"WITH {_SKILLED} SELECT 'pay' AS scan, p_partkey FROM p WHERE (low IS NOT NULL OR high IS NOT NULL) AND skills IS NOT NULL UNION ALL SELECT 'grade', p_partkey FROM p WHERE grade <> '' AND len(skills) > 0")
def model_scans(t, spark):
    """S16, S17."""
    k = F.col("p_partkey")
    p = t("part").select(k, F.when(k % 4 == 0, None).when(k % 4 == 1, F.array().cast("array<string>")).otherwise(F.split("p_name", " ")).alias("skills"), F.when(k % 5 == 0, None).when(k % 5 == 1, "").otherwise(F.col("p_brand")).alias("grade"), F.when(k % 3 > 0, F.col("p_retailprice")).alias("low"), F.when(k % 7 == 0, F.col("p_retailprice")).alias("high"))
    return ingest.pay_scan(p, "low", "high", "skills").select(F.lit("pay").alias("scan"), k).unionByName(ingest.grade_scan(p, "grade", "skills").select(F.lit("grade").alias("scan"), k))


@query("SELECT event_id, user_id FROM events WHERE event_id < 900 AND event_id > coalesce((SELECT max(event_id) FROM events WHERE event_id < 900 AND ts < (SELECT min(ts) FROM events) + INTERVAL 10 MINUTE), -1)")
def feed_scan(t, spark):
    """One page's worth of the feed behind message 900, back to the first that is too old."""
    first = t("events").agg(F.min("ts")).first()[0]
    return ingest.feed_scan(t("events"), "event_id", "ts", F.lit(first) + F.expr("INTERVAL 10 MINUTES"), before=900).select("event_id", "user_id")


@query("SELECT doc_id FROM documents ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id LIMIT 50")
def sample_rows(t, spark):
    """S14."""
    return ingest.random_sample(t("documents").select("doc_id"), 50, "doc_id")


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 1 THEN nullif(l_returnflag, 'A') ELSE l_linestatus END AS l_linestatus FROM (SELECT DISTINCT l_orderkey, l_linenumber, min(l_returnflag) OVER w AS l_returnflag, min(l_linestatus) OVER w AS l_linestatus FROM lineitem WINDOW w AS (PARTITION BY l_orderkey, l_linenumber))")
def write_back_column(t, spark):
    """K5."""
    old = t("lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_linestatus").alias("l_linestatus"), F.min("l_returnflag").alias("f"))
    new = old.where("l_linenumber = 1").select("l_orderkey", "l_linenumber", F.nullif("f", F.lit("A")).alias("l_linestatus"))
    return ingest.write_back(old.drop("f"), new, ["l_orderkey", "l_linenumber"], ["l_linestatus"])


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority ELSE o_orderstatus END AS raw FROM orders")
def raw_copy(t, spark):
    """K6."""
    o = t("orders").select("o_orderkey", F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderpriority")).alias("raw"), "o_orderstatus")
    return ingest.keep_raw(o, "raw", "o_orderstatus").select("o_orderkey", "raw")


@query("SELECT CASE WHEN after IS NULL THEN 'empty' WHEN after = p_name THEN 'unchanged' ELSE 'changed' END AS change, count(*) AS n FROM (SELECT p_name, nullif(replace(p_name, 'red ', ''), 'widget') AS after FROM part) GROUP BY 1")
def change_report(t, spark):
    """P13, A23."""
    p = t("part").select("p_name", F.nullif(F.replace("p_name", F.lit("red "), F.lit("")), F.lit("widget")).alias("after"))
    return ingest.changes(p, "p_name", "after")


@query("SELECT p_partkey, concat_ws(',', CASE WHEN p_partkey % 3 = 0 THEN 'a' END, CASE WHEN p_partkey % 4 = 0 THEN 'b' END) AS lacking FROM part WHERE p_partkey % 3 = 0 OR p_partkey % 4 = 0")
def required_fields(t, spark):
    """K8."""
    k = F.col("p_partkey")
    p = t("part").select(k, F.when(k % 3 != 0, 1).alias("a"), F.when(k % 4 != 0, 1).alias("b"))
    return ingest.missing_required(p, ["a", "b"]).select("p_partkey", F.array_join("lacking", ",").alias("lacking"))


@query("SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'error' WHEN page_id % 3 = 1 THEN 'done' ELSE 'pending' END AS status, CASE WHEN page_id % 3 = 0 THEN 'no title' END AS error, CASE WHEN page_id % 3 < 2 THEN '2024-01-02 00:00:00' ELSE '2024-01-01 00:00:00' END AS updated FROM pages")
def status_update(t, spark):
    """K2, F37."""
    k = F.col("page_id")
    queue = t("pages").select(k, F.lit("pending").alias("status"), F.lit(None).cast("string").alias("error"), F.lit("2024-01-01 00:00:00").cast("timestamp").alias("updated_at"))
    updates = t("pages").where(k % 3 < 2).select(k, F.when(k % 3 == 0, "error").otherwise("done").alias("status"), F.when(k % 3 == 0, "no title").alias("error"))
    out = ingest.set_status(queue, updates, "page_id", F.lit("2024-01-02 00:00:00").cast("timestamp"))
    return out.select("page_id", "status", "error", F.date_format("updated_at", "yyyy-MM-dd HH:mm:ss").alias("updated"))


@query("SELECT p_partkey, nullif(concat_ws('; ', CASE WHEN p_partkey % 2 = 0 THEN 'old' END, CASE WHEN contains(p_name, 'red') THEN 'red' END), '') AS kept, CASE WHEN contains(p_name, 'red') THEN 'red' END AS forced, contains(p_name, 'red') AS flag FROM part")
def reflag_rows(t, spark):
    """P10, P1."""
    found = rules.reasons(F.col("p_name"), [("red", None, "red")])
    p = t("part").select("p_partkey", "p_name", F.when(F.col("p_partkey") % 2 == 0, "old").alias("r"), F.lit(True).alias("flag"))
    kept = ingest.reflagged(p, "flag", "r", found).select("p_partkey", F.col("r").alias("kept"))
    return kept.join(ingest.reflagged(p, "flag", "r", found, force=True).select("p_partkey", F.col("r").alias("forced"), "flag"), "p_partkey")


@query("SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN 0.0::DOUBLE ELSE CAST(p_size AS DOUBLE) END AS years FROM part WHERE p_partkey % 5 = 0 OR p_partkey % 3 > 0")
def years_policy(t, spark):
    """P8."""
    k = F.col("p_partkey")
    grade, raw = F.when(k % 5 == 0, "Intern").otherwise("Middle"), F.when(k % 3 > 0, F.col("p_size").cast("string")).otherwise("unknown")
    return t("part").select(k, ingest.min_years(grade, raw).alias("years")).where("years IS NOT NULL")


# ---- JSON and text ----


@query(
    """SELECT event_id, CASE WHEN event_id % 3 = 0 THEN event_type END AS kind, CASE WHEN event_id % 4 = 0 THEN event_type WHEN event_id % 4 = 1 THEN 'bare' ELSE '' END AS soft, CASE WHEN event_id % 4 = 0 THEN event_type ELSE '' END AS hard,
    CAST(CASE WHEN event_id % 2 = 0 THEN 2 ELSE 0 END AS INTEGER) AS n_listed, substr(event_type, 1, 3) AS short FROM events"""
)
def json_paths(t, spark):
    """F22, F44, F46, F48."""
    k, kind = F.col("event_id"), F.col("event_type")
    ld = F.when(k % 3 == 0, F.concat(F.lit('{"a":{"b":"'), kind, F.lit('"}}'))).when(k % 3 == 1, F.lit('{"a":{"b":3}}')).otherwise(F.lit('{"a":"x"}'))
    element = F.parse_json(F.when(k % 4 == 0, F.concat(F.lit('{"name":"'), kind, F.lit('"}'))).when(k % 4 == 1, F.lit('"bare"')).when(k % 4 == 2, F.lit("7")).otherwise(F.lit('{"x":1}')))
    skills_ = text.defaulted(F.when(k % 2 == 0, F.lit('{"hard":[{"name":"a"},"b"]}')).otherwise(F.lit("{}")), ["hard"], ["seniority"])
    return t("events").select(k, text.nested(ld, "a", "b").alias("kind"), text.element_name(element).alias("soft"), text.element_name(element, bare=False).alias("hard"), F.size(skills_["hard"]).alias("n_listed"), text.truncated(kind, 3).alias("short"))


@query(
    r"""SELECT p_partkey, CASE WHEN contains(p_name, 'red') AND contains(p_name, 'bolt') THEN 'Warm,Fix' WHEN contains(p_name, 'red') THEN 'Warm' WHEN contains(p_name, 'bolt') THEN 'Fix' ELSE string_split(p_name, ' ')[1] END AS positions,
    upper(substr(p_name, 1, 1)) || substr(p_name, 2) AS soft, CASE WHEN p_partkey % 3 = 0 THEN 'other' ELSE p_name END AS object, contains(p_name, 'blue') OR p_partkey % 2 = 0 AS remote, 'Skill {x} is ' || p_name AS prompt,
    CASE WHEN p_partkey % 2 = 0 THEN 'Domain: ' || p_type || '. ' || p_name ELSE p_name END AS embed FROM part"""
)
def name_functions(t, spark):
    """F12, F16-F18, F21, F23."""
    k, n = F.col("p_partkey"), F.col("p_name")
    ld = F.when(k % 2 == 0, F.lit('{"jobLocationType":"TELECOMMUTE"}')).otherwise(F.lit("{}"))
    return t("part").select(
        k,
        F.array_join(rules.all_matches(n, [("red", "Warm"), ("bolt", "Fix")], F.get(F.split(n, " "), F.lit(0))), ",").alias("positions"),
        skills.capitalized(n).alias("soft"),
        skills.with_catch_all(F.when(k % 3 == 0, " ").otherwise(n), "other").alias("object"),
        text.is_remote(ld, n, "blue").alias("remote"),
        text.fill_template("Skill {x} is {name}", name=n).alias("prompt"),
        text.embedding_text(F.when(k % 2 == 0, F.col("p_type")), n).alias("embed"),
    )


_TITLES = [
    # title, grade, title grade, class, positions, not relevant
    ("Senior DevOps Engineer", "Senior", "Senior", "senior", "DevOps", False),
    ("Middle/Senior SRE", "Middle/Senior", "Senior", "senior", "SRE", False),
    ("Junior DevOps Engineer (Azure)", "Junior", "Intern", "junior", "DevOps", False),
    ("SRE/DevOps lead", "Lead", "Lead", "senior", "SRE,DevOps", False),
    ("Strong Middle MLOps", "Middle", "Middle", "middle", "MLOps", False),
    ("Frontend developer", None, None, None, "Frontend", True),
    ("Backend engineer", None, None, None, "Backend", True),
    ("Backend / DevOps", None, None, None, "DevOps", False),
    ("Support engineer", None, None, None, "Support", True),
    ("Junior-middle sysadmin", "Junior/Middle", "Junior", "junior", "System Administrator", False),
    ("Head of Cloud Architect team", "Lead", "Lead", "senior", "Cloud Architect", False),
    ("Manager, UI", "Lead", None, None, "Manager", True),
]


def _as_cases(column: int, kind: str = "VARCHAR") -> str:
    text_ = lambda v: "NULL" if v is None else str(v).lower() if isinstance(v, bool) else f"'{v}'"
    return "CAST(CASE p_partkey % " + str(len(_TITLES)) + " " + " ".join(f"WHEN {i} THEN {text_(r[column])}" for i, r in enumerate(_TITLES)) + f" END AS {kind})"


@query(f"SELECT p_partkey, {_as_cases(1)} AS grade, {_as_cases(2)} AS title_grade, {_as_cases(3)} AS class, {_as_cases(4)} AS positions, CASE WHEN {_as_cases(5, 'BOOLEAN')} THEN 'non-devops title' WHEN p_partkey % 5 = 0 THEN 'short description' END AS reasons FROM part")
def fixed_title_rules(t, spark):
    """P1, P2, F9-F12 with the fixed patterns."""
    title = F.get(F.array(*(F.lit(r[0]) for r in _TITLES)), (F.col("p_partkey") % len(_TITLES)).cast("int"))
    said = F.when(F.col("p_partkey") % 5 == 0, "little").otherwise(F.repeat(F.lit("words "), 12))
    return t("part").select("p_partkey", rules.grade(title).alias("grade"), rules.title_grade(title).alias("title_grade"), rules.title_class(title).alias("class"), F.array_join(rules.positions(title), ",").alias("positions"), rules.review_reasons(title, said).alias("reasons"))


@query(
    """SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'USD' WHEN 1 THEN 'EUR' WHEN 2 THEN 'KZT' WHEN 3 THEN 'AED' END AS by_text, CASE p_partkey % 6 WHEN 0 THEN 'USD' WHEN 1 THEN 'EUR' WHEN 2 THEN 'KZT' WHEN 5 THEN 'GBP' END AS mentioned,
    CASE p_partkey % 3 WHEN 0 THEN 'KZT' WHEN 1 THEN 'GEL' END AS by_place, CASE WHEN p_partkey % 6 = 0 THEN 160.0::DOUBLE WHEN p_partkey % 6 = 1 THEN 1.0::DOUBLE / 12 WHEN p_partkey % 6 = 4 THEN 160 ELSE 1 END AS factor, p_partkey % 6 = 3 AS wanted FROM part"""
)
def fixed_pay_rules(t, spark):
    """P4, F29-F32 with the fixed patterns and tables."""
    cases = ["pay 1000 usd/hour, or 5 rub", "100 000 eur / year", "50 000 rub or 70 000 kzt", "aed #Vacancy", "nothing", "£ 500 per month #vacancy #RESUME"]
    said = F.get(F.array(*(F.lit(c) for c in cases)), (F.col("p_partkey") % 6).cast("int"))
    place = F.get(F.array(F.lit("Алматы, центр"), F.lit("Грузия"), F.lit("Berlin")), (F.col("p_partkey") % 3).cast("int"))
    amount = F.get(F.array(*(F.lit(x) for x in (450.0, 100000.0, 60000.0, 3000.0, 20000.0, 900.0))), (F.col("p_partkey") % 6).cast("int"))
    code = rules.first_match(said, [(f"(?iu){p}", c) for p, c in fixed.CODE_PATTERNS])
    mentioned = money.mentioned_currency(said, fixed.MENTIONED, fixed.CODE_NAMES)
    factor = money.monthly(amount, F.lit(None).cast("double"), F.coalesce(code, mentioned), said, f"(?iu){fixed.HOURLY}", f"(?iu){fixed.ANNUAL}")
    return t("part").select("p_partkey", code.alias("by_text"), mentioned.alias("mentioned"), rules.contains_first(F.lower(place), fixed.PLACES).alias("by_place"), factor.alias("factor"), rules.wanted_message(said).alias("wanted"))


# ---- pay ----

_FX, _BACK = [("USD", 90.0), ("EUR", 100.0)], [("USD", 1.0), ("KZT", 0.2)]
_CODE = "CASE o_orderkey % 6 WHEN 0 THEN 'usd ' WHEN 1 THEN NULL WHEN 2 THEN 'RUR' WHEN 3 THEN 'XXX' WHEN 4 THEN 'KZT' ELSE '' END"
_TEXT = "CASE o_orderkey % 5 WHEN 0 THEN 'per hour' WHEN 1 THEN 'a year in euro' WHEN 2 THEN '' WHEN 3 THEN 'plain' END"


@query(
    f"""WITH o AS (SELECT o_orderkey, CASE WHEN o_orderkey % 7 > 0 THEN floor(o_totalprice) * 12 END AS low, CASE WHEN o_orderkey % 7 IN (0, 1) AND o_orderkey % 11 > 0 THEN floor(o_totalprice) * 12 * 3 END AS high, {_CODE} AS code, {_TEXT} AS txt FROM orders),
    r AS (SELECT *, CASE o_orderkey % 6 WHEN 0 THEN 'USD' WHEN 2 THEN 'RUB' WHEN 3 THEN 'XXX' WHEN 4 THEN 'KZT' ELSE CASE WHEN contains(txt, 'euro') THEN 'EUR' END END AS resolved, greatest(coalesce(low, 0), coalesce(high, 0)) AS top FROM o),
    c AS (SELECT *, CASE coalesce(resolved, 'RUB') WHEN 'RUB' THEN 30000 WHEN 'USD' THEN 500 WHEN 'EUR' THEN 500 WHEN 'KZT' THEN 50000 END AS thr FROM r),
    f AS (SELECT *, CASE WHEN top = 0 OR coalesce(txt, '') = '' THEN 1.0::DOUBLE WHEN contains(txt, 'year') AND top >= coalesce(thr, 25000) * 18 THEN 1.0::DOUBLE / 12 WHEN top < coalesce(thr, 30000) THEN 160 WHEN top > 2 * coalesce(thr, 30000) THEN 1 WHEN contains(txt, 'hour') THEN 160 ELSE 1 END AS fac,
      CASE WHEN resolved IS NULL OR resolved = 'RUB' THEN 1.0::DOUBLE WHEN resolved = 'USD' THEN 90 WHEN resolved = 'EUR' THEN 100 WHEN resolved = 'KZT' THEN 0.2 END AS rate FROM c)
    SELECT o_orderkey, round(CASE WHEN coalesce(rate, 1) = 1 THEN low * fac ELSE round(low * fac * rate, 2) END, 4) AS low_home, round(CASE WHEN coalesce(rate, 1) = 1 THEN high * fac ELSE round(high * fac * rate, 2) END, 4) AS high_home, CASE WHEN low IS NULL AND high IS NULL THEN NULL WHEN rate IS NULL THEN code ELSE 'RUB' END AS code_home FROM f"""
)
def pay_chain(t, spark):
    """Null, aliased, unknown and inferred codes; annual, hourly and monthly amounts."""
    k, p = F.col("o_orderkey"), (F.floor("o_totalprice") * 12).cast("double")
    code = F.when(k % 6 == 0, "usd ").when(k % 6 == 2, "RUR").when(k % 6 == 3, "XXX").when(k % 6 == 4, "KZT").when(k % 6 == 5, "")
    said = F.when(k % 5 == 0, "per hour").when(k % 5 == 1, "a year in euro").when(k % 5 == 2, "").when(k % 5 == 3, "plain")
    o = t("orders").select(k, F.when(k % 7 > 0, p).alias("low"), F.when((k % 7).isin(0, 1) & (k % 11 > 0), p * 3).alias("high"), code.alias("code"), said.alias("txt"))
    rates = lambda x: spark.createDataFrame(x, "code string, rate double")
    out = money.to_home_chain(o, "low", "high", "code", "txt", rates(_FX), rates(_BACK), {"RUR": "RUB", "USDT": "USD"}, [("(?iu)euro", "EUR")], "hour", "year")
    return out.select(k, F.round("low_home", 4).alias("low_home"), F.round("high_home", 4).alias("high_home"), "code_home")


@query(
    f"""WITH o AS (SELECT o_orderkey, nullif(CASE WHEN o_orderkey % 4 = 0 THEN 0.0::DOUBLE ELSE o_totalprice END, 0) AS low, CASE WHEN o_orderkey % 3 > 0 THEN o_totalprice * 20 END AS high,
      CASE o_orderkey % 6 WHEN 0 THEN 'USD' WHEN 2 THEN 'RUB' WHEN 3 THEN 'XXX' WHEN 4 THEN 'KZT' ELSE CASE o_orderkey % 5 WHEN 1 THEN 'EUR' WHEN 3 THEN 'KZT' ELSE CASE WHEN o_orderpriority = '5-LOW' THEN 'GEL' END END END AS currency FROM orders),
    f AS (SELECT *, CASE WHEN coalesce(low, high) < 10000 THEN 160 WHEN coalesce(low, high) > 2000000 THEN 1.0::DOUBLE / 12 ELSE 1 END AS fac FROM o)
    SELECT o_orderkey, CASE WHEN currency IS NOT NULL THEN round(low * fac, 4) END AS low, CASE WHEN currency IS NOT NULL THEN round(high * fac, 4) END AS high, currency FROM f"""
)
def pay_by_place(t, spark):
    """F28, F30, F31, F33."""
    k, p = F.col("o_orderkey"), F.col("o_totalprice")
    code = F.when(k % 6 == 0, " Dollars").when(k % 6 == 2, "rub").when(k % 6 == 3, "xxx").when(k % 6 == 4, "KZT").when(k % 6 == 5, "")
    said = F.when(k % 5 == 1, "100 rub or 5 Euro").when(k % 5 == 3, "200 kzt").otherwise("7 rub")
    s = money.normalize_pay(F.when(k % 4 == 0, 0.0).otherwise(p), F.when(k % 3 > 0, p * 20), code, said, F.col("o_orderpriority"), {"dollars": "USD", "euro": "EUR", "rub": "RUB"}, r"\d+\s*(?:rub|euro|kzt)", [(["low"], "GEL")])
    return t("orders").select(k, s.alias("s")).select(k, F.round("s.low", 4).alias("low"), F.round("s.high", 4).alias("high"), "s.currency")


@query("SELECT n_nationkey, CASE WHEN n_nationkey % 3 = 0 THEN NULL ELSE round((n_nationkey + 0.5::DOUBLE) / 10, 6) END AS xml_rate, round((n_nationkey + 0.5::DOUBLE) / 100, 6) AS json_rate FROM nation")
def rate_tables(t, spark):
    """Every third element lacks its nominal."""
    k = F.col("n_nationkey").cast("string")
    element = F.concat(F.lit('<Valute ID="R'), k, F.lit('"><CharCode>C'), k, F.lit("</CharCode><Nominal>"), F.when(F.col("n_nationkey") % 3 == 0, "").otherwise("10"), F.lit("</Nominal><Value>"), k, F.lit(",5</Value></Valute>"))
    n = t("nation").select(k.alias("k"), element.alias("e"), F.concat(F.lit('"C'), k, F.lit('":{"Value":'), k, F.lit('.5,"Nominal":100}')).alias("j")).groupBy().agg(F.array_join(F.collect_list("e"), "\n").alias("x"), F.array_join(F.collect_list("j"), ",").alias("j"))
    as_rows = lambda c, name: n.select(F.inline(c)).select(F.regexp_extract("code", r"\d+", 0).cast("int").alias("n_nationkey"), F.round("rate", 6).alias(name))
    xml = as_rows(io.xml_rates(F.concat(F.lit("<ValCurs>"), "x", F.lit("</ValCurs>"))), "xml_rate")
    return xml.join(as_rows(io.json_rates(F.concat(F.lit('{"Valute":{'), "j", F.lit("}}"))), "json_rate"), "n_nationkey")


# ---- names and clusters ----

_WORDS = "w AS (SELECT DISTINCT lower(string_split(p_name, ' ')[1]) AS w FROM part)"


@query(
    f"""WITH {_WORDS}, n AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN replace(p_name, ' ', '/') WHEN 1 THEN replace(p_name, ' ', ' and ') || ' ' || p_name WHEN 2 THEN 'Ci/Cd' ELSE p_name END AS name FROM part),
    s AS (SELECT p_partkey, name, CASE WHEN p_partkey % 4 = 0 THEN string_split(name, '/') ELSE list_filter(string_split(name, ' '), lambda x: x <> 'and') END AS parts, len(string_split(name, ' ')) AS n_words FROM n),
    u AS (SELECT p_partkey, unnest(parts) AS p FROM s), k AS (SELECT p_partkey, count(*) AS known FROM u WHERE lower(p) = 'gizmo' OR lower(p) IN (SELECT w FROM w) GROUP BY 1)
    SELECT p_partkey, unnest(CASE WHEN p_partkey % 4 <> 2 AND coalesce(known, 0) >= 2 AND len(parts) > 1 AND (p_partkey % 4 = 0 OR n_words <= 4) THEN parts ELSE [name] END) AS name FROM s LEFT JOIN k USING (p_partkey)"""
)
def compound_names(t, spark):
    """slashes and words, a protected compound, the bound on words; 'gizmo' is known by its alias only."""
    k, n = F.col("p_partkey"), F.col("p_name")
    name = F.when(k % 4 == 0, F.replace(n, F.lit(" "), F.lit("/"))).when(k % 4 == 1, F.concat(F.replace(n, F.lit(" "), F.lit(" and ")), F.lit(" "), n)).when(k % 4 == 2, "Ci/Cd").otherwise(n)
    known = t("part").select(F.get(F.split("p_name", " "), F.lit(0)).alias("name")).distinct()
    aliases = known.orderBy("name").limit(1).select(F.lit("gizmo").alias("key"), F.col("name").alias("canonical"))
    return skills.split_compounds(t("part").select(k, name.alias("name")), "name", known, aliases, ["ci/cd"])


@query(
    """WITH i AS (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey FROM lineitem), n AS (SELECT l_orderkey, CAST(l_linenumber AS BIGINT) * 1000000000 + l_partkey AS pos, CASE WHEN l_partkey % 2 = 0 THEN upper(p_name) ELSE p_name END AS raw, CASE WHEN l_partkey % 3 > 0 THEN 'must' END AS prio FROM i JOIN part ON l_partkey = p_partkey),
    s AS (SELECT l_orderkey, pos, CASE WHEN lower(raw) = 'red widget' THEN ['Main'] ELSE string_split(raw, ' ') END AS parts, coalesce(prio, 'required') AS prio FROM n), e AS (SELECT l_orderkey, pos, unnest(parts) AS name, prio FROM s),
    u AS (SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, lower(name) ORDER BY pos, name) rn FROM e) WHERE rn = 1)
    SELECT l_orderkey, pos, name, prio FROM u WHERE name IN (SELECT name FROM u GROUP BY 1 HAVING count(*) >= 40)"""
)
def prepare_names(t, spark):
    """F13-F15, W5, A5, A6."""
    i = t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey").distinct().join(t("part").select("p_partkey", "p_name"), F.col("l_partkey") == F.col("p_partkey"))
    even = F.col("l_partkey") % 2 == 0
    items = i.select("l_orderkey", (F.col("l_linenumber").cast("long") * F.lit(1000000000) + F.col("l_partkey")).alias("pos"), F.when(even, F.upper("p_name")).otherwise(F.col("p_name")).alias("name"), F.when(F.col("l_partkey") % 3 > 0, "must").alias("prio"))
    known = t("part").select(F.explode(F.split("p_name", " ")).alias("name")).distinct()
    aliases = spark.createDataFrame([("red widget", "Main")], "key string, canonical string")
    return skills.prepare(items, "l_orderkey", "pos", "name", aliases, known, priority="prio", least=40)


@query(
    """WITH p AS (SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY ALL), m AS (SELECT lower(substr(p_brand, 1, 7)) AS a, upper(substr(p_type, 1, 1)) AS o, max(n) AS largest, CAST(sum(n) AS BIGINT) AS total, min({'n': -n, 'p_brand': p_brand, 'p_type': p_type}) AS f FROM p GROUP BY 1, 2)
    SELECT a, o, row_number() OVER (ORDER BY f) - 1 AS cluster, total, largest, f.p_brand AS top_p_brand, f.p_type AS top_p_type FROM m"""
)
def pair_ids(t, spark):
    """Several raw pairs share a normalised one."""
    p = t("part").groupBy("p_brand", "p_type").agg(F.count("*").alias("n")).withColumns({"a": F.lower(F.substring("p_brand", 1, 7)), "o": F.upper(F.substring("p_type", 1, 1))})
    return skills.pair_clusters(p, ["p_brand", "p_type"], ["a", "o"], "n")


@query(
    """WITH p AS (SELECT p_brand, CASE WHEN p_size % 5 = 0 THEN '' ELSE p_type END AS p_type FROM part WHERE p_size % 7 > 0) SELECT 'p_brand' AS level, p_brand, CAST(NULL AS VARCHAR) AS p_type, count(*) AS n FROM p GROUP BY ALL
    UNION ALL SELECT 'p_type', NULL, p_type, count(*) FROM p WHERE p_type <> '' GROUP BY ALL UNION ALL SELECT 'pair', p_brand, p_type, count(*) FROM p GROUP BY ALL"""
)
def pair_levels(t, spark):
    """A10."""
    p = t("part").select(F.when(F.col("p_size") % 7 > 0, F.col("p_brand")).alias("p_brand"), F.when(F.col("p_size") % 5 > 0, F.col("p_type")).alias("p_type"))
    return skills.pair_counts(p, "p_brand", "p_type")


@query(f"WITH {_CLUST} SELECT l_orderkey, string_agg(DISTINCT CAST(label AS VARCHAR), ',' ORDER BY CAST(label AS VARCHAR)) AS clusters FROM c GROUP BY 1")
def owner_clusters(t, spark):
    """A11 (one-digit labels sort alike as text)."""
    return skills.owner_sets(_clustered(t), "l_orderkey", "label").select("l_orderkey", F.array_join(F.col("clusters").cast("array<string>"), ",").alias("clusters"))


@query(f"WITH {_CLUST} SELECT label // 2 AS topic, count(*) AS n FROM c GROUP BY 1 ORDER BY n DESC, topic LIMIT 3")
def top_clusters(t, spark):
    """J10, T5."""
    mapping = t("embeddings").select(F.col("label").cast("long").alias("label")).distinct().select("label", F.floor(F.col("label") / 2).alias("topic"))
    return _clustered(t).join(mapping, "label").groupBy("topic").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "topic").limit(3)


@query("SELECT a.vec_id, round(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: z[1]::DOUBLE * z[2]::DOUBLE)) / (sqrt(list_sum(list_transform(a.embedding, lambda x: x::DOUBLE * x::DOUBLE))) * sqrt(list_sum(list_transform(b.embedding, lambda x: x::DOUBLE * x::DOUBLE)))), 9) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def cosine_next(t, spark):
    """F49."""
    e = t("embeddings").select("vec_id", "embedding")
    b = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return e.join(b, "vec_id").select("vec_id", F.round(features.cosine(F.col("embedding"), F.col("other")), 9).alias("cosine"))


# ---- the aggregates behind the figures ----


@query("SELECT CAST(place AS BIGINT) AS place, class, (SELECT count(*) FROM orders WHERE o_orderpriority = class AND o_orderstatus = 'F') AS n FROM (SELECT unnest([0, 1, 2]) AS place, unnest(['1-URGENT', 'none', '5-LOW']) AS class)")
def class_counts(t, spark):
    """A8."""
    return metrics.class_counts(t("orders").where("o_orderstatus = 'F'"), "o_orderpriority", ["1-URGENT", "none", "5-LOW"])


@query(f"WITH {_CLUST} SELECT o_orderpriority, label, round(avg(o_totalprice), 4) AS depth FROM c JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL")
def cluster_depth(t, spark):
    """A13."""
    j = _ordered(t, "o_orderpriority", "o_totalprice")
    return metrics.depth(j, "o_orderpriority", "label", "o_totalprice").withColumn("depth", F.round("depth", 4))


@query(f"WITH {_RES}, e AS (SELECT ln(o_totalprice) AS y, mu, ln(o_totalprice) - mu AS e FROM r) SELECT round(1 - sum(e * e) / (var_pop(y) * count(*)), 6) AS r2, round(avg(abs(e)), 6) AS mae, round(quantile_cont(abs(e), 0.5::DOUBLE), 6) AS median_ae, round(sqrt(avg(e * e)), 6) AS rmse FROM e")
def error_metrics(t, spark):
    """A15."""
    m = metrics.errors(_residuals(t).withColumn("y", F.log("o_totalprice")), "y", "mu")
    return m.select(*(F.round(c, 6).alias(c) for c in m.columns))


_COEF = "k AS (SELECT p_brand AS feature, p_type AS class, avg(p_retailprice) / 1000 - 1.2::DOUBLE AS beta FROM part GROUP BY ALL)"


def _coefficients(t) -> DataFrame:
    return t("part").groupBy(F.col("p_brand").alias("feature"), F.col("p_type").alias("class")).agg((F.avg("p_retailprice") / 1000 - 1.2).alias("beta"))


@query(f"WITH {_COEF}, o AS (SELECT feature, beta FROM k WHERE class = (SELECT min(class) FROM k)) SELECT feature, round((exp(beta) - 1) * 100, 6) AS multiplier_pct, row_number() OVER (ORDER BY round(abs(beta), 9) DESC, feature) - 1 AS place FROM o")
def coefficient_bars(t, spark):
    """V1, V2, T7, F39."""
    least = t("part").agg(F.min("p_type")).first()[0]
    c = _coefficients(t).withColumn("beta", F.round("beta", 9))
    return metrics.coefficient_bars(c, "feature", "beta", F.col("class"), least).withColumn("multiplier_pct", F.round("multiplier_pct", 6))


@query(f"WITH {_COEF} SELECT feature, round(avg(abs(beta)), 9) AS importance FROM k GROUP BY 1")
def feature_importance(t, spark):
    """V12."""
    return metrics.mean_abs(_coefficients(t), "feature", "beta").withColumn("importance", F.round("importance", 9))


def _predictions(t) -> DataFrame:
    """Orders with a predicted price and bounds that rest on the order's key only, so both engines agree to the last digit."""
    k, p = F.col("o_orderkey"), F.col("o_totalprice")
    return t("orders").select(k, "o_orderpriority", p, (p + (k % 100) * 500 - 25000).alias("predicted"), (p + (k % 100) * 500 - 45000).alias("low"), (p + (k % 100) * 500 - 5000).alias("high"))


_PREDICTIONS = "p AS (SELECT o_orderkey, o_orderpriority, o_totalprice, o_totalprice + (o_orderkey % 100) * 500 - 25000 AS predicted, o_totalprice + (o_orderkey % 100) * 500 - 45000 AS low, o_totalprice + (o_orderkey % 100) * 500 - 5000 AS high FROM orders)"


@query(f"WITH {_PREDICTIONS} SELECT o_orderpriority, CAST(left(o_orderpriority, 1) AS BIGINT) - 1 AS place, o_totalprice, round(predicted, 4) AS predicted, o_totalprice BETWEEN low AND high AS inside FROM p WHERE o_orderpriority <> '5-LOW'")
def prediction_points(t, spark):
    """V3."""
    return metrics.points(_predictions(t), "o_totalprice", "predicted", "low", "high", "o_orderpriority", PRIORITIES[:4]).withColumn("predicted", F.round("predicted", 4))


@query(f"WITH {_PREDICTIONS} SELECT row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS x, o_orderkey, o_totalprice, round(low, 4) AS low, round(high, 4) AS high FROM p")
def sorted_band(t, spark):
    """V4, T8."""
    return metrics.band(_predictions(t), "o_totalprice", "o_orderkey", ["low", "high"]).withColumns({c: F.round(c, 4) for c in ("low", "high")})


@query(
    f"""WITH {_PREDICTIONS}, b AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 0.0::DOUBLE ELSE o_totalprice * 0.5 END AS f, CASE WHEN o_orderkey % 5 > 0 THEN o_totalprice * 2 END AS u FROM orders WHERE o_orderkey % 2 = 0),
    j AS (SELECT row_number() OVER (ORDER BY o_totalprice, p.o_orderkey) - 1 AS x, p.o_orderkey, o_totalprice, coalesce(nullif(f, 0), o_totalprice) AS sfr, coalesce(nullif(u, 0), o_totalprice) AS sto, round((high - low) / 2 / predicted * 100, 6) AS half_width FROM p LEFT JOIN b USING (o_orderkey) WHERE predicted > 1000)
    SELECT x, o_orderkey, o_totalprice, round(sfr, 4) AS sfr, round(sto, 4) AS sto, half_width FROM j WHERE x IN (0, 50, 150, 250) OR x % 10 = 0"""
)
def range_band(t, spark):
    """V10, V11, J6, F41, T10."""
    k, p = F.col("o_orderkey"), F.col("o_totalprice")
    bounds = t("orders").where(k % 2 == 0).select(k, F.when(k % 3 == 0, 0.0).otherwise(p * 0.5).alias("f"), F.when(k % 5 > 0, p * 2).alias("u"))
    known = metrics.with_bounds(_predictions(t).where("predicted > 1000").withColumnsRenamed({"low": "lo", "high": "hi"}), bounds, "o_orderkey", "f", "u", "o_totalprice")
    wide = known.withColumn("half_width", F.round(metrics.half_width(F.col("lo"), F.col("hi"), F.col("predicted")), 6)).withColumnsRenamed({"f": "sfr", "u": "sto"})
    out = metrics.band(wide, "o_totalprice", "o_orderkey", ["sfr", "sto", "half_width"]).withColumns({c: F.round(c, 4) for c in ("sfr", "sto")})
    return out.where("x % 10 = 0").unionByName(metrics.picked(out.where("x % 10 > 0"), "x", [0, 50, 150, 250]))


@query(f"WITH {_PREDICTIONS} SELECT g.o_orderpriority, coalesce(m, 0) AS predicted, coalesce(l, 0) AS low, coalesce(h, 0) AS high FROM (SELECT unnest(['1-URGENT', 'none', '5-LOW']) AS o_orderpriority) g LEFT JOIN (SELECT o_orderpriority, round(median(predicted), 4) AS m, round(median(low), 4) AS l, round(median(high), 4) AS h FROM p GROUP BY 1) USING (o_orderpriority)")
def group_medians(t, spark):
    """V7."""
    m = metrics.medians(_predictions(t), "o_orderpriority", ["predicted", "low", "high"], ["1-URGENT", "none", "5-LOW"])
    return m.withColumns({c: F.round(c, 4) for c in ("predicted", "low", "high")})


@query("SELECT o_orderpriority, count(*) AS n, round(avg((o_orderkey % 10) / 10.0::DOUBLE), 9) AS p1, round(avg(1 - (o_orderkey % 10) / 10.0::DOUBLE), 9) AS p2 FROM orders GROUP BY 1")
def probability_means(t, spark):
    """V13."""
    o = t("orders").select("o_orderpriority", (F.col("o_orderkey") % 10 / 10.0).alias("p1"), (1 - F.col("o_orderkey") % 10 / 10.0).alias("p2"))
    return metrics.mean_probabilities(o, "o_orderpriority", ["p1", "p2"]).withColumns({c: F.round(c, 9) for c in ("p1", "p2")})


_GUESS = "SELECT CAST(left(o_orderpriority, 1) AS BIGINT) AS a, (CAST(left(o_orderpriority, 1) AS BIGINT) + o_orderkey % 4) % 5 + 1 AS p FROM orders"


@query(f"WITH x AS ({_GUESS}), n AS (SELECT a, p, count(*) AS n FROM x GROUP BY ALL) SELECT a, CAST(sum(CASE WHEN a = p THEN n ELSE 0 END) AS BIGINT) AS correct, CAST(sum(CASE WHEN a <> p THEN n ELSE 0 END) AS BIGINT) AS wrong, coalesce(string_agg(p || ':' || n, ',' ORDER BY n DESC, p) FILTER (a <> p), '') AS confused FROM n GROUP BY 1")
def class_mistakes(t, spark):
    """V14."""
    a = F.substring("o_orderpriority", 1, 1).cast("long")
    x = t("orders").select(a.alias("a"), ((a + F.col("o_orderkey") % 4) % 5 + 1).alias("p"))
    m = metrics.mistakes(x, "a", "p")
    return m.select("a", "correct", "wrong", F.array_join(F.transform("confused_with", lambda s: F.concat(s["predicted"], F.lit(":"), s["n"])), ",").alias("confused"))


@query(
    """WITH n AS (SELECT p_brand AS feature, p_name, count(*) AS size FROM part GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY size DESC, p_name) rn FROM n), e AS (SELECT feature, string_agg(p_name, ',' ORDER BY rn) AS examples FROM r WHERE rn <= 5 GROUP BY 1),
    g AS (SELECT p_brand AS feature, p_type, count(*) AS n FROM part GROUP BY ALL), b AS (SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY n DESC, p_type) rn FROM g) WHERE rn = 1), k AS (SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY n DESC, feature) AS rank FROM b)
    SELECT feature, p_type, n, rank, examples FROM k LEFT JOIN e USING (feature) WHERE rank <= 3"""
)
def anchor_examples(t, spark):
    """W8, M19."""
    g = t("part").groupBy(F.col("p_brand").alias("feature"), "p_type").agg(F.count("*").alias("n"))
    names = t("part").groupBy(F.col("p_brand").alias("feature"), "p_name").agg(F.count("*").alias("size"))
    out = metrics.anchor_report(metrics.anchors(g, "feature", "p_type", "n", 3), names, "feature", "p_name", "size", 5)
    return out.withColumn("examples", F.array_join("examples", ","))


# ---- fits ----


@query(
    """WITH s AS (SELECT regr_slope(l_extendedprice, l_quantity) AS b, regr_intercept(l_extendedprice, l_quantity) AS a, regr_sxx(l_extendedprice, l_quantity) AS sxx, avg(l_quantity) AS m, count(*) AS n, regr_syy(l_extendedprice, l_quantity) - regr_sxy(l_extendedprice, l_quantity) * regr_slope(l_extendedprice, l_quantity) AS sse FROM lineitem),
    e AS (SELECT *, sqrt(sse / (n - 2) / sxx) AS sb, sqrt(sse / (n - 2) * (1.0::DOUBLE / n + m * m / sxx)) AS sa FROM s) SELECT 'intercept' AS term, round(a, 3) AS coef, round(sa, 3) AS std_err, round(a / sa, 2) AS t FROM e UNION ALL SELECT 'l_quantity', round(b, 3), round(sb, 3), round(b / sb, 2) FROM e"""
)
def ols_inference(t, spark):
    """M3."""
    rows = [(r[0], round(r[1], 3), round(r[2], 3), round(r[3], 2)) for r in models.ols_table(t("lineitem"), ["l_quantity"], "l_extendedprice")]
    return spark.createDataFrame(rows, "term string, coef double, std_err double, t double")


@query("WITH d AS (SELECT l_orderkey, l_linenumber, l_orderkey % 5 AS fold, min(l_quantity) AS x, min(l_extendedprice) AS y FROM lineitem GROUP BY ALL), m AS (SELECT f.fold, regr_intercept(y, x) AS a, regr_slope(y, x) AS b FROM (SELECT DISTINCT fold FROM d) f JOIN d ON d.fold <> f.fold GROUP BY 1) SELECT l_orderkey, l_linenumber, round(a + b * x, 2) AS prediction FROM d JOIN m USING (fold)")
def kfold_linear(t, spark):
    """M4 with a regressor."""
    d = t("lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_quantity").alias("x"), F.min("l_extendedprice").alias("y"))
    return models.kfold_predictions(d, ["x"], "y", F.col("l_orderkey") % 5, 5).select("l_orderkey", "l_linenumber", F.round("prediction", 2).alias("prediction"))


@query("SELECT 'intercept' AS name, round(regr_intercept(y, x), 5) AS value FROM (SELECT ln(o_totalprice) AS y, o_custkey AS x FROM orders) UNION ALL SELECT 'o_custkey', round(regr_slope(y, x), 9) FROM (SELECT ln(o_totalprice) AS y, o_custkey AS x FROM orders) UNION ALL SELECT 'sigma', round(sqrt((regr_syy(y, x) - regr_sxy(y, x) * regr_slope(y, x)) / count(*)), 6) FROM (SELECT ln(o_totalprice) AS y, o_custkey AS x FROM orders)")
def interval_fit_of_points(t, spark):
    """M15 where every interval is a point, which is least squares with the likelihood's deviation; tests have the rest."""
    o = t("orders").select(F.col("o_custkey").cast("double").alias("o_custkey"), F.log("o_totalprice").alias("y"))
    fit = models.interval_regression(o, ["o_custkey"], "y", "y")
    return spark.createDataFrame([("intercept", round(fit.intercept, 5)), ("o_custkey", round(float(fit.weights[0]), 9)), ("sigma", round(fit.sigma, 6))], "name string, value double")


_PROBIT = dict(mean=[150000.0, 0.0], scale=[90000.0, 2.0], weights=[0.4, -0.7], thresholds=[-0.8, 0.1, 0.9])
_ETA = "0.4::DOUBLE * (o_totalprice - 150000) / 90000 - 0.7::DOUBLE * ((o_orderkey % 7) / 2.0::DOUBLE)"
_PDF = "exp(-({e} - eta) * ({e} - eta) / 2) / sqrt(2 * pi())"


def _probit() -> models.OrderedProbit:
    import numpy as np

    return models.OrderedProbit(["o_totalprice", "z"], ["a", "b", "c", "d"], np.array(_PROBIT["mean"]), np.array(_PROBIT["scale"]), np.array(_PROBIT["weights"]), np.array(_PROBIT["thresholds"]), 0.0)


def _effects_sql() -> str:
    edges = ["0"] + [_PDF.format(e=f"({v}::DOUBLE)") for v in _PROBIT["thresholds"]] + ["0"]
    one = " UNION ALL ".join(f"SELECT '{c}' AS class, avg({a} - {b}) AS d FROM x" for c, a, b in zip("abcd", edges, edges[1:]))
    return f"WITH x AS (SELECT {_ETA} AS eta FROM orders), m AS ({one}) SELECT class, 'o_totalprice' AS feature, round(d * 0.4::DOUBLE, 9) AS effect FROM m UNION ALL SELECT class, 'z', round(d * -0.7::DOUBLE, 9) FROM m"


@query(_effects_sql())
def marginal_effects(t, spark):
    """M9 of given weights and thresholds."""
    o = t("orders").select("o_totalprice", (F.col("o_orderkey") % 7).cast("double").alias("z"))
    return models.marginal_effects(o, _probit()).withColumn("effect", F.round("effect", 9))


@query()
def ordered_prediction(t, spark):
    """M8: fit and prediction."""
    o = t("orders").select(F.substring("o_orderpriority", 1, 1).cast("int").alias("y"), F.log("o_totalprice").alias("x"))
    return models.predict_ordered(o, models.fit_ordered_probit(o, ["x"], "y")).groupBy("y", "prediction").agg(F.count("*").alias("n"))


def _graded(t) -> DataFrame:
    k = F.col("o_orderkey")
    return t("orders").select(k, F.substring("o_orderpriority", 1, 1).cast("int").alias("y"), F.log("o_totalprice").alias("x"), ((k * 7 + F.substring("o_orderpriority", 1, 1).cast("int") * 3) % 11).cast("double").alias("z"))


@query()
def l1_path(t, spark):
    """M10."""
    return spark.createDataFrame(models.l1_path(_graded(t), ["x", "z"], "y"), "c double, accuracy double, adjacent double, n_kept int")


@query()
def bootstrap_refit(t, spark):
    """Coefficients of the plain fit and their intervals over 25 refits."""
    fit = models.bootstrap_logit(_graded(t), "o_orderkey", ["x", "z"], "y", 25)
    return spark.createDataFrame(models.bootstrap_intervals(fit), "feature string, class string, coef double, ci_low double, ci_high double")


@query()
def bootstrap_oob(t, spark):
    """Ordinal metrics of the out-of-bag votes."""
    fit = models.bootstrap_logit(_graded(t), "o_orderkey", ["x", "z"], "y", 25)
    return metrics.ordinal_metrics(models.out_of_bag(_graded(t), fit, "o_orderkey", "y"), "actual", "vote")


@query(
    """SELECT 'all' AS model, count(*) AS n, 1 AS features, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2, round(sqrt((regr_syy(l_extendedprice, l_quantity) - regr_sxy(l_extendedprice, l_quantity) * regr_slope(l_extendedprice, l_quantity)) / count(*)), 3) AS rmse FROM lineitem
    UNION ALL SELECT 'subset', count(*), 1, round(regr_r2(l_extendedprice, l_quantity), 6), round(sqrt((regr_syy(l_extendedprice, l_quantity) - regr_sxy(l_extendedprice, l_quantity) * regr_slope(l_extendedprice, l_quantity)) / count(*)), 3) FROM lineitem WHERE l_returnflag = 'R'"""
)
def model_table(t, spark):
    """The same target by several designs."""
    li = t("lineitem")
    rows = models.compare_models({"all": (li, ["l_quantity"]), "subset": (li.where("l_returnflag = 'R'"), ["l_quantity"])}, "l_extendedprice")
    return spark.createDataFrame([(a, n, k, round(float(r), 6), round(e, 3)) for a, n, k, r, e in rows], "model string, n long, features int, r2 double, rmse double")


@query()
def topic_merge(t, spark):
    """M18."""
    return models.merge_topics(t("embeddings"), "vec_id", "embedding", 6)


@query(
    "WITH c AS (SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1), m AS (SELECT max(n) AS most FROM c) SELECT o_orderpriority, CAST(most AS BIGINT) AS n, n AS distinct_rows FROM c, m",
)
def oversample_rows(t, spark):
    """Each class grows to the largest one's size and keeps all its rows."""
    o = features.oversample(t("orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority", "o_orderkey")
    return o.groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.countDistinct("o_orderkey").alias("distinct_rows"))


@query(
    f"WITH {_CLUST}, h AS (SELECT l_orderkey, label, count(*) AS k FROM c GROUP BY ALL) SELECT o_orderkey, "
    + ", ".join(f"round(ln(1 + coalesce((SELECT k FROM h WHERE h.l_orderkey = o_orderkey AND h.label = {i}), 0)), 9) AS f_{i}" for i in (0, 1))
    + ", CAST(o_custkey % 3 AS DOUBLE) AS s_1, CASE WHEN o_orderpriority = '1-URGENT' THEN 1.0::DOUBLE ELSE 0 END AS grade_0, CASE WHEN o_orderpriority = '5-LOW' THEN 1.0::DOUBLE ELSE 0 END AS grade_1, "
    + ", ".join(f"CASE WHEN EXISTS (SELECT 1 FROM h WHERE h.l_orderkey = o_orderkey AND h.label = {i}) THEN 1.0::DOUBLE ELSE 0 END AS resp_{i}" for i in (7, 8))
    + " FROM orders"
)
def full_design(t, spark):
    """M2: hard and soft features, grade dummies and responsibility dummies; owners without any item have zeros."""
    c = _clustered(t)
    hard = features.feature_matrix(c.groupBy("l_orderkey", "label").agg(F.log1p(F.count("*")).alias("v")), "l_orderkey", "label", "v", [0, 1])
    soft = t("orders").select("o_orderkey", (F.col("o_custkey") % 3).cast("double").alias("s_1"))
    duties = skills.owner_sets(c, "l_orderkey", "label")
    o = t("orders").select("o_orderkey", *features.dummies(F.col("o_orderpriority"), ["1-URGENT", "5-LOW"], "grade_"))
    out = features.design(o, "o_orderkey", [hard.withColumnRenamed("l_orderkey", "o_orderkey"), soft], duties.withColumnRenamed("l_orderkey", "o_orderkey"), "clusters", [7, 8])
    return out.withColumns({f"f_{i}": F.round(f"f_{i}", 9) for i in (0, 1)})


# ---- hook, streams, exports ----


@query("SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN NULL WHEN length(p_name) < 9 THEN 'short' ELSE upper(p_name) END AS found FROM part")
def extract_hook(t, spark):
    """S22, D2, P11, P12."""
    p = t("part").select("p_partkey", F.when(F.col("p_partkey") % 5 > 0, F.col("p_name")).alias("name"))
    return records.extract(p, "name", lambda s: s.str.upper(), "found", 9, F.lit("short")).select("p_partkey", "found")


def _as_stream(t, spark, name: str) -> DataFrame:
    """A table's rows as a file stream."""
    folder = f"{scratch(spark)}/in"
    t(name).repartition(3).write.parquet(folder)
    return spark.readStream.schema(t(name).schema).option("maxFilesPerTrigger", 1).parquet(folder)


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) rn FROM events) WHERE rn = 1")
def stream_upsert(t, spark):
    """A stream in several micro-batches, run twice with one checkpoint, merged by key into a bucketed table."""
    stream, at = _as_stream(t, spark, "events").select("user_id", "event_id", "event_type"), scratch(spark)
    table = BucketTable(f"{at}/table", ["user_id"], [F.desc("event_id")], buckets=16)
    for _ in range(2):
        incremental.run_available(stream, table.merge, f"{at}/checkpoint").awaitTermination()
    return table.read(spark)


@query("SELECT DISTINCT user_id, event_type FROM events")
def stream_distinct(t, spark):
    """Repeats of a key within the age are dropped; the age covers the table, so each key comes once."""
    stream, at = _as_stream(t, spark, "events").select("user_id", "event_type", F.col("ts").cast("timestamp").alias("ts")), scratch(spark)
    recent = incremental.recent_distinct(stream, "ts", ["user_id", "event_type"], "36500 days").select("user_id", "event_type")
    recent.writeStream.format("parquet").option("checkpointLocation", f"{at}/checkpoint").option("path", f"{at}/out").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{at}/out")


@query("SELECT CAST(p_partkey AS VARCHAR) AS p_partkey, '[\"' || replace(p_name, ' ', '\",\"') || '\"]' AS skills, CASE WHEN p_partkey % 3 > 0 THEN p_brand END AS brand FROM part")
def csv_export(t, spark):
    """Written with a header, nested values as JSON, nulls empty, and read again."""
    at = f"{scratch(spark)}/csv"
    io.export_csv(t("part").select("p_partkey", F.split("p_name", " ").alias("skills"), F.when(F.col("p_partkey") % 3 > 0, F.col("p_brand")).alias("brand")), at, "p_partkey")
    return spark.read.option("header", True).option("escape", '"').csv(at)


@query("SELECT CAST(p_brand AS VARCHAR) AS p_brand, " + ", ".join(f"CAST(max(CASE WHEN p_size = {i} THEN 1 ELSE 0 END) AS VARCHAR) AS has_{i}" for i in (1, 2, 3)) + " FROM part WHERE p_partkey % 3 > 0 GROUP BY 1")
def onehot_export(t, spark):
    """A filtered 0/1 matrix as CSV, read again."""
    at = f"{scratch(spark)}/csv"
    io.export_csv(skills.onehot(t("part").where("p_partkey % 3 > 0"), "p_brand", "p_size", [1, 2, 3]), at, "p_brand")
    return spark.read.option("header", True).csv(at)


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def table_kinds(t, spark):
    """Through ORC and JSON and back."""
    at = scratch(spark)
    io.save(t("nation"), at, "n", "orc")
    io.save(io.table(spark, at, "n", "orc"), at, "n", "json")
    return io.table(spark, at, "n", "json").select(F.col("n_nationkey").cast("int").alias("n_nationkey"), "n_name", F.col("n_regionkey").cast("int").alias("n_regionkey"))


@query("SELECT p_partkey, CASE WHEN contains(p_name, 'red widget') THEN 'RW' WHEN contains(p_name, 'widget') THEN 'W' WHEN contains(p_name, 'blue') THEN 'B' WHEN contains(p_name, 'red') THEN 'R' ELSE p_name END AS name FROM part")
def partial_names(t, spark):
    """F17, T9."""
    aliases = [("red", "R"), ("Widget", "W"), ("blue", "B"), ("red widget", "RW")]
    return skills.partial_alias(t("part").select("p_partkey", F.col("p_name").alias("name")), "name", aliases)


@query("SELECT p_name AS name, CAST(count(*) AS VARCHAR) AS cluster_id FROM part GROUP BY 1")
def json_artifact(t, spark):
    """A dictionary written as one JSON object and loaded again."""
    at = scratch(spark)
    n = t("part").groupBy("p_name").agg(F.count("*").cast("string").alias("n"))
    n.groupBy().agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("p_name", "n")))).alias("value")).write.text(f"{at}/dictionary")
    io.export_json(n, f"{at}/rows")
    return io.json_dictionary(spark, f"{at}/dictionary")
