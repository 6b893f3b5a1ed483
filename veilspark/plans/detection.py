"""Queries on detection."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.patterns import (
    AUDIT_PATTERNS,
    ENTITY_TYPES,
    PATTERNS,
    TYPE_RANK,
)
from ..operators.audit_patterns import pattern_counts, pattern_matches
from ..operators.catalogue import entity_types, locales
from ..operators.cleaning import CleanConfig, clean_texts, detect, explode_spans, resolved
from ..operators.gazetteer import gazetteer_spans, with_gazetteer
from ..sources.derived import MESSAGES, PROBE, table
from ..sources.files import spread
from . import oracle as o
from .registry import query

SPAN_SQL = """select id, entity_type, start, end_ as "end", round(score, 4) as score, value as text
 from {} """


def spans_of(texts: DataFrame, types=None, threshold: float = 0.7, context: bool = True,
             resolve: bool = False, patterns=None) -> DataFrame:
    config = CleanConfig(types, threshold)
    if resolve:
        return explode_spans(resolved(texts, config), "spans", "id")
    return explode_spans(detect(texts, config, "text", patterns, context), "detections", "id")


def _documents(spark, folder):
    return spread(table(spark, folder, "documents").selectExpr("doc_id as id", "text"))


DOCUMENTS_SQL = "select doc_id as id, text from documents"
PAGES_SQL = "select page_id as id, html as text from pages"


def _span_query(name: str, types: list[str], source, source_sql: str, threshold: float) -> None:
    sql = (f"with src as ({source_sql}),\n{o.detections('src', types, threshold)}\n"
           + SPAN_SQL.format("det"))

    @query(name, sql)
    def run(spark, folder):
        return spans_of(source(spark, folder), types, threshold)


def _pages(spark, folder):
    return spread(table(spark, folder, "pages").selectExpr("page_id as id", "html as text"))


# Thresholds are low enough to show hits with and without context.
_span_query("detect_email", ["EMAIL_ADDRESS"], _documents, DOCUMENTS_SQL, 0.5)
_span_query("detect_email_pages", ["EMAIL_ADDRESS"], _pages, PAGES_SQL, 0.5)
_span_query("detect_ip", ["IP_ADDRESS"], _documents, DOCUMENTS_SQL, 0.5)
_span_query("detect_url", ["URL"], _pages, PAGES_SQL, 0.5)
_span_query("detect_phone_documents", ["PHONE_NUMBER"], _documents, DOCUMENTS_SQL, 0.4)
_span_query("detect_card_documents", ["CREDIT_CARD"], _documents, DOCUMENTS_SQL, 0.4)
_span_query("detect_street_documents", ["STREET_ADDRESS"], _documents, DOCUMENTS_SQL, 0.4)
for _name, _probe, _types, _threshold in (
    ("detect_street", "street", ["STREET_ADDRESS"], 0.4),
    ("detect_ssn", "ssn", ["US_SSN"], 0.3),
    ("detect_date", "date", ["DATE_TIME"], 0.4),
    ("detect_compound_location", "location", ["LOCATION"], 0.4),
    ("detect_guid", "guid", ["GUID"], 0.4),
    ("detect_coordinate", "coordinate", ["COORDINATE"], 0.4),
    ("detect_phone", "phone", ["PHONE_NUMBER"], 0.4),
    ("detect_ipv6", "ipv6", ["IP_ADDRESS"], 0.4),
    ("detect_phone_international", "phone_abroad", ["PHONE_NUMBER"], 0.4),
    ("detect_credit_card", "card", ["CREDIT_CARD"], 0.4),
    ("detect_iban", "iban", ["IBAN_CODE"], 0.4),
    ("detect_crypto", "crypto", ["CRYPTO"], 0.4),
    ("detect_us_ids", "us_ids",
     ["US_ITIN", "US_PASSPORT", "US_BANK_NUMBER", "US_DRIVER_LICENSE", "MEDICAL_LICENSE"], 0.4),
):
    _span_query(_name, _types, PROBE[_probe].frame, PROBE[_probe].sql, _threshold)

# Restricted to requested types; a request of none means all.
_span_query("detect_typed", ["EMAIL_ADDRESS", "GUID", "US_SSN"], MESSAGES.frame, MESSAGES.sql, 0.7)


def _detections(threshold: float = 0.7, context: bool = True, patterns=None) -> str:
    return (f"with src as ({MESSAGES.sql}),\n"
            f"{o.detections('src', None, threshold, patterns, context)}\n")


@query("detect_all", _detections() + SPAN_SQL.format("det"))
def detect_all(spark, folder):
    return spans_of(MESSAGES.frame(spark, folder), [])


@query("detect_threshold", _detections(0.5, context=False) + SPAN_SQL.format("det"))
def detect_threshold(spark, folder):
    return spans_of(MESSAGES.frame(spark, folder), threshold=0.5, context=False)


_CONTEXT_PATTERNS = [p for p in PATTERNS if p.context]


@query("detect_context", _detections(0.0, patterns=_CONTEXT_PATTERNS)
       + SPAN_SQL.format("det"))
def detect_context(spark, folder):
    return spans_of(MESSAGES.frame(spark, folder), threshold=0.0, patterns=_CONTEXT_PATTERNS)


@query("resolve_overlaps", f"""with src as ({MESSAGES.sql}),
{o.detections('src', None, 0.4)},
{o.resolved('src')}
""" + SPAN_SQL.format("res"))
def resolve_overlaps(spark, folder):
    return spans_of(MESSAGES.frame(spark, folder), threshold=0.4, resolve=True)


@query("types_per_document", _detections() + """select id, count(distinct entity_type) as n_types,
 string_agg(distinct entity_type, ',' order by entity_type) as types from det group by id""")
def types_per_document(spark, folder):
    kinds = F.array_sort(F.array_distinct(F.transform("detections", lambda s: s["entity_type"])))
    found = detect(MESSAGES.frame(spark, folder)).select("id", kinds.alias("kinds"))
    # Explode and regroup would shuffle; the array is enough.
    return found.select(
        "id", F.size("kinds").cast("bigint").alias("n_types"),
        F.array_join("kinds", ",").alias("types"),
    ).filter(F.col("types") != "")


@query("entity_types", f"with src as ({DOCUMENTS_SQL}),\n{o.detections('src')}\n"
       "select t.*, coalesce(hits, 0) as hits from (values " + ", ".join(
    f"({o.q(t)}, {o.q(d)}, {TYPE_RANK[t]})" for t, d in ENTITY_TYPES.items())
    + """) t(name, description, rank) left join (select entity_type, count(*) as hits
 from det group by 1) n on entity_type = name""")
def entity_types_query(spark, folder):
    return entity_types(spans_of(_documents(spark, folder)))


@query("locales", "select locale, description, customers from (values " + ", ".join(
    f"({i}, {o.q(c)}, {o.q(d)})" for i, (c, d) in enumerate(__import__(
        "veilspark.functions.pools", fromlist=["LOCALES"]).LOCALES.items()))
    + """) t(i, locale, description) left join (select c_nationkey as i, count(*) as customers
 from customer group by 1) n using (i)""")
def locales_query(spark, folder):
    return locales(table(spark, folder, "customer").select("c_nationkey"))


def _audit_sql(source: str) -> str:
    rows = " union all ".join(
        f"select id, {o.q(kind)} as kind, len(regexp_extract_all(text, {o.q(r)}))::bigint as hits "
        "from src" for kind, r in AUDIT_PATTERNS.items())
    return f"with src as ({source}), hits as ({rows})"


@query("audit_pattern_counts", _audit_sql(DOCUMENTS_SQL)
       + " select kind, sum(hits)::bigint as hits, count(*) filter (where hits > 0) as texts "
         "from hits group by kind")
def audit_pattern_counts(spark, folder):
    return pattern_counts(_documents(spark, folder), "text")


@query("pattern_matches", f"""with src as ({MESSAGES.sql}), found as (""" + " union all ".join(
    f"select id, {o.q(kind)} as kind, regexp_extract_all(text, {o.q(r)}) as m from src"
    for kind, r in AUDIT_PATTERNS.items()) + """)
 select id, kind, len(m)::bigint as n, array_to_string(m, '|') as matches from found where len(m) > 0""")
def pattern_matches_query(spark, folder):
    return pattern_matches(MESSAGES.frame(spark, folder))


_TERMS = "select n_name as term, 'LOCATION' as entity_type, 0.85 as score from nation union all select r_name, 'LOCATION', 0.8 from region"
_GAZETTEER_TEXT = """select c_custkey as id, 'From ' || n_name || ', ' || r_name || ' and ' || c_mktsegment
 || ' or ' || lower(n_name) || ' x' as text from customer join nation on c_nationkey = n_nationkey
 join region on n_regionkey = r_regionkey"""


_GRAMS = f"""with src as ({_GAZETTEER_TEXT}),
dict as ({_TERMS} union all select c_mktsegment || ' or', 'NRP', 0.9 from customer group by 1),
parts as (select id, regexp_extract_all(text, '[^\\s.,;:!?()]+') as m,
 regexp_split_to_array(text, '[^\\s.,;:!?()]+') as g, text from src),
words as (select *, unnest(range(1, len(m) + 1)) as i from parts),
spots as (select id, text, m, i, (list_sum(list_transform(g[1:i], lambda x: length(x)))
 + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0))::bigint as start from words),
grams as (select a.id, a.start, b.start + length(b.m[b.i]) as end_, array_to_string(a.m[a.i:b.i], ' ') as term,
 substring(a.text, a.start + 1, b.start + length(b.m[b.i]) - a.start) as text
 from spots a join spots b on a.id = b.id and b.i between a.i and a.i + 2)
"""
_HITS = "from grams join dict d on lower(grams.term) = lower(d.term)"


@query("detect_gazetteer", _GRAMS + f"""select id, d.entity_type, start, end_ as "end", d.score::double as score, grams.text as text {_HITS}""")
def detect_gazetteer(spark, folder):
    return gazetteer_spans(*gazetteer_input(spark, folder), "id")


def gazetteer_input(spark, folder) -> tuple[DataFrame, DataFrame]:
    """Texts and the dictionary for them."""
    customer, nation, region = (table(spark, folder, t) for t in ("customer", "nation", "region"))
    texts = (
        customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
        .selectExpr("c_custkey as id", "'From ' || n_name || ', ' || r_name || ' and ' || "
                    "c_mktsegment || ' or ' || lower(n_name) || ' x' as text")
    )
    terms = (
        nation.selectExpr("n_name as term", "'LOCATION' as entity_type", "0.85D as score")
        .union(region.selectExpr("r_name", "'LOCATION'", "0.8D"))
        .union(customer.select("c_mktsegment").distinct()
               .selectExpr("c_mktsegment || ' or'", "'NRP'", "0.9D"))
    )
    return texts, terms


_ALL = o.detections("src")
_ALL_SPANS = f"""every as (select id, entity_type, rank, start, end_, score, value from det union all
 select id, d.entity_type, case d.entity_type when 'LOCATION' then 10 else 13 end, start, end_, d.score::double, grams.text {_HITS})"""
_DONE = ", ".join((_ALL, _ALL_SPANS, o.resolved("src", "every"),
                   o.keyed(kinds=["LOCATION", "NRP"]), o.rewritten("src")))


GAZETTEER_SQL = _GRAMS.rstrip() + ", " + _DONE + " select id, anonymized_text from done"


@query("anonymize_gazetteer", GAZETTEER_SQL)
def anonymize_gazetteer(spark, folder):
    texts, terms = gazetteer_input(spark, folder)
    return clean_texts(with_gazetteer(texts, terms), extra="given").select(
        "id", "anonymized_text")


@query("gazetteer_any_ids", GAZETTEER_SQL.removesuffix("select id, anonymized_text from done")
       + "select case when id % 3 > 0 then id % 10 end as id, anonymized_text from done")
def gazetteer_any_ids(spark, folder):
    """Ids that are null or repeat, and a dictionary that is cut into pieces."""
    texts, terms = gazetteer_input(spark, folder)
    texts = texts.withColumn("id", F.expr("case when id % 3 > 0 then id % 10 end"))
    return clean_texts(with_gazetteer(texts, terms, piece_bytes=300), extra="given").select(
        "id", "anonymized_text")
