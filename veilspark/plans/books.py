"""Queries on mappings, statistics, configuration and audit."""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import DataFrame, functions as F

from ..functions.keys import mapping_id
from ..functions.spans import as_spans
from ..operators import audit, config, mapping, stats
from ..operators.cleaning import CleanConfig, clean_texts, with_spans, with_substitutions
from ..session import fresh_path, materialize
from ..sources import files
from ..sources.derived import MESSAGES, Derived, table
from . import oracle as o
from .registry import query

# Mappings made before this day are the store; later messages are the batch.
SPLIT = "1997-01-01"
_MAP = """select h as original_hash, entity_type, min(substitute) as substitute, min(sent) as first_seen,
 max(sent) as last_used, count(*) as substitution_count, ('0x' || substr(h, 1, 15))::bigint as mapping_id
 from sub join src using (id) {} group by 1, 2"""
CTES = o.full(MESSAGES.sql)
STORE = CTES + f", store as ({_MAP.format('')})\n"
MERGE = (CTES + f", store as ({_MAP.format(f'where sent < timestamp {o.q(SPLIT)}')}), "
         f"batch as ({_MAP.format(f'where sent >= timestamp {o.q(SPLIT)}')})\n")


def _texts(spark, folder) -> DataFrame:
    return MESSAGES.frame(spark, folder)


def _uses(texts: DataFrame) -> DataFrame:
    return mapping.span_uses(with_substitutions(texts), "sent", "id")


def _store(spark, folder) -> DataFrame:
    return mapping.build(_uses(_texts(spark, folder)))


def _written(spark, folder) -> DataFrame:
    """The table as a stored one, for operators that read it more than once."""
    return materialize(_store(spark, folder), f"store-{uuid.uuid4().hex}")


def _both(spark, folder) -> tuple[DataFrame, DataFrame]:
    """The store so far and the usage of the batch."""
    uses = _uses(_texts(spark, folder))
    early = F.col("used_at") < F.lit(SPLIT).cast("timestamp_ntz")
    return mapping.build(uses.filter(early)), mapping.usage(uses.filter(~early))


@query("mapping_build", STORE + "select * from store")
def mapping_build(spark, folder):
    return _store(spark, folder)


@query("mapping_lookup", MERGE + """select b.original_hash, b.entity_type, s.substitute
 from batch b left join store s using (original_hash, entity_type)""")
def mapping_lookup(spark, folder):
    store, batch = _both(spark, folder)
    return mapping.lookup(batch.select(*mapping.KEY), store)


@query("mapping_new", MERGE + "select b.* from batch b anti join store s using (original_hash, entity_type)")
def mapping_new(spark, folder):
    store, batch = _both(spark, folder)
    return mapping.new_mappings(batch, store)


@query("mapping_increment", MERGE + """select s.original_hash, s.entity_type, s.substitute, s.first_seen,
 greatest(s.last_used, coalesce(b.last_used, s.last_used)) as last_used,
 s.substitution_count + coalesce(b.substitution_count, 0) as substitution_count, s.mapping_id
 from store s left join batch b using (original_hash, entity_type)""")
def mapping_increment(spark, folder):
    store, batch = _both(spark, folder)
    return mapping.increment(store, batch)


@query("mapping_merge", CTES + f", store as ({_MAP.format('')}) select *, first_seen >= timestamp {o.q(SPLIT)} as is_new from store")
def mapping_merge(spark, folder):
    store, batch = _both(spark, folder)
    return mapping.merge(store, batch)


@query("mapping_page", STORE + """select *, (select count(*) from store) as total from store
 order by first_seen desc, original_hash, entity_type limit 50 offset 20""")
def mapping_page(spark, folder):
    return mapping.page(_written(spark, folder), 50, 20)


_SOME_ID = "select ('0x' || substr(sha256('client1@mail1.example.com|EMAIL_ADDRESS'), 1, 15))::bigint"


@query("mapping_get", STORE + f"select * from store where mapping_id = ({_SOME_ID})")
def mapping_get(spark, folder):
    wanted = mapping_id(F.sha2(F.lit("client1@mail1.example.com|EMAIL_ADDRESS"), 256))
    return mapping.get(_store(spark, folder), wanted)


# Changes by hand: one for each customer's card, if it has a mapping.
_CHANGES = Derived("customer", {"k": "c_custkey"}, {
    "mapping_value": "'client' || cast(k as string) || '@mail' || cast(k % 5 as string) || '.example.com|EMAIL_ADDRESS'",
    "new_substitute": "'desk' || cast(k as string) || '@example.net'",
})
_CHANGE_SQL = f"changes as (select ('0x' || substr(sha256(mapping_value), 1, 15))::bigint as mapping_id, new_substitute from ({_CHANGES.sql}))"


def _changes(spark, folder) -> DataFrame:
    return _CHANGES.frame(spark, folder).select(
        mapping_id(F.sha2("mapping_value", 256)).alias("mapping_id"), "new_substitute")


@query("mapping_override", STORE + f", {_CHANGE_SQL} select s.* exclude (substitute), coalesce(new_substitute, substitute) as substitute from store s left join changes using (mapping_id)")
def mapping_override(spark, folder):
    return mapping.override(_store(spark, folder), _changes(spark, folder))


@query("mapping_delete", STORE + f", {_CHANGE_SQL} select s.* from store s anti join changes using (mapping_id)")
def mapping_delete(spark, folder):
    return mapping.delete(_store(spark, folder), _changes(spark, folder))


@query("mapping_delete_all", STORE + "select count(*) as deleted_count, 0 as left_over from store")
def mapping_delete_all(spark, folder):
    empty, deleted = mapping.delete_all(_store(spark, folder))
    return deleted.withColumn("left_over", empty.agg(F.count("*")).scalar())


_WINDOW = (datetime(1996, 1, 1), datetime(1998, 6, 30))
_ISO = "strftime({}, '%Y-%m-%dT%H:%M:%S')"


@query("mapping_export", STORE + f"""select mapping_id as id, original_hash, substitute, entity_type,
 {_ISO.format('first_seen')} as first_seen, {_ISO.format('last_used')} as last_used, substitution_count from store
 where last_used between timestamp '1996-01-01' and timestamp '1998-06-30' and entity_type = 'EMAIL_ADDRESS'""")
def mapping_export(spark, folder):
    rows = mapping.last_used_between(_store(spark, folder), *_WINDOW, "EMAIL_ADDRESS")
    return mapping.exported(rows.orderBy(F.desc("last_used"), *mapping.KEY))


_EXPORTED = f"""exported as (select mapping_id as id, original_hash, substitute, entity_type, {_ISO.format('first_seen')} as first_seen,
 {_ISO.format('last_used')} as last_used, substitution_count from store
 where last_used between timestamp '1996-01-01' and timestamp '1998-06-30' and entity_type = 'EMAIL_ADDRESS')"""


@query("mapping_export_json", STORE + f""", {_EXPORTED} select 'mappings' as part, to_json({{'id': id, 'original_hash': original_hash, 'substitute': substitute,
 'entity_type': entity_type, 'first_seen': first_seen, 'last_used': last_used, 'substitution_count': substitution_count}})::varchar as line from exported
 union all select 'summary', to_json({{'since': '1996-01-01T00:00:00', 'until': '1998-06-30T00:00:00', 'entity_type': 'EMAIL_ADDRESS', 'total': count(*)}})::varchar from exported""")
def mapping_export_json(spark, folder):
    """The export written as JSON with its filters and total, read back line by line."""
    rows = mapping.last_used_between(_written(spark, folder), *_WINDOW, "EMAIL_ADDRESS")
    path = fresh_path(spark, "export")
    files.write_export(mapping.exported(rows), mapping.export_summary(rows, *_WINDOW, "EMAIL_ADDRESS"), path)
    return files.read_export(spark, path)


@query("mapping_types", STORE + "select distinct entity_type from store")
def mapping_types(spark, folder):
    return mapping.types(_store(spark, folder))


@query("mapping_page_after", STORE + """select * from store qualify row_number() over (order by first_seen desc, original_hash, entity_type) between 101 and 150""")
def mapping_page_after(spark, folder):
    """The third page of fifty, each continued behind the last row of the one before."""
    store, last = _written(spark, folder), None
    for _ in range(2):
        rows = mapping.page_after(store, 50, last).orderBy(F.desc("first_seen"), *mapping.KEY).collect()
        if rows:
            last = (rows[-1]["first_seen"], rows[-1]["original_hash"], rows[-1]["entity_type"])
    return mapping.page_after(store, 50, last)


@query("substitute_collisions", STORE + """select entity_type, substitute, count(*) as "values" from store
 group by 1, 2 having count(*) > 1""")
def substitute_collisions(spark, folder):
    return mapping.collisions(_store(spark, folder))


@query("substitute_unique", STORE + """select * exclude (place) replace (case when place > 1 then substitute || ' ' || place::varchar else substitute end as substitute)
 from (select *, row_number() over (partition by entity_type, substitute order by first_seen::date, original_hash) as place from store)""")
def substitute_unique(spark, folder):
    return mapping.disambiguate(_written(spark, folder))


@query("mapping_backfill", STORE + "select * replace (case when substitution_count % 2 = 0 then last_used else first_seen end as last_used) from store")
def mapping_backfill(spark, folder):
    older = _store(spark, folder).withColumn(
        "last_used", F.when(F.col("substitution_count") % 2 == 0, F.col("last_used")))
    return mapping.backfill(older)


@query("document_counters", MERGE + f""", late as (select sub.*, sent from sub join src using (id) where sent >= timestamp {o.q(SPLIT)}),
first as (select h, entity_type, min(id) as id from late where not exists (select 1 from store s where s.original_hash = h and s.entity_type = late.entity_type) group by 1, 2),
made as (select id, count(*) as c from first group by 1), d as (select id, count(*) as d from det group by 1), r as (select id, count(*) as r from res group by 1)
select id, coalesce(d, 0) as entities_detected, coalesce(r, 0) as entities_anonymized, coalesce(c, 0) as new_mappings_created,
 coalesce(r, 0) - coalesce(c, 0) as existing_mappings_used from src left join made using (id) left join d using (id) left join r using (id)
 where sent >= timestamp {o.q(SPLIT)}""")
def document_counters(spark, folder):
    texts = _texts(spark, folder)
    early = F.col("sent") < F.lit(SPLIT).cast("timestamp_ntz")
    store = mapping.build(_uses(texts.filter(early)))
    batch = clean_texts(texts.filter(~early))
    return mapping.document_counters(
        batch, mapping.span_uses(batch, "sent", "id"), store, "id")


# Statistics.
@query("stats_overall", STORE + """select count(*) as total_mappings, sum(substitution_count)::bigint as total_substitutions,
 min(first_seen) as oldest_mapping, max(first_seen) as newest_mapping from store""")
def stats_overall(spark, folder):
    return stats.overall(_store(spark, folder))


_BY_TYPE = "select entity_type, count(*) as unique_values, sum(substitution_count)::bigint as total_substitutions from store group by 1"


@query("stats_by_type", STORE + _BY_TYPE)
def stats_by_type(spark, folder):
    return stats.by_type(_store(spark, folder))


@query("stats_one_type", STORE + _BY_TYPE.replace("group by", "where entity_type = 'PHONE_NUMBER' group by"))
def stats_one_type(spark, folder):
    return stats.one_type(_store(spark, folder), "PHONE_NUMBER")


@query("stats_top_substitutes", STORE + """select entity_type, substitute, substitution_count as count, first_seen from store
 where entity_type = 'CREDIT_CARD' or entity_type = 'IP_ADDRESS' qualify row_number() over (partition by entity_type order by substitution_count desc, original_hash) <= 100 and entity_type = 'IP_ADDRESS'""")
def stats_top_substitutes(spark, folder):
    return stats.top_substitutes(_store(spark, folder), "IP_ADDRESS")


@query("stats_top_by_type", STORE + """select entity_type, place, substitute, substitution_count as count from
 (select *, row_number() over (partition by entity_type order by substitution_count desc, original_hash) as place from store) where place <= 100""")
def stats_top_by_type(spark, folder):
    return stats.top_by_type(_store(spark, folder))


@query("stats_distribution", STORE + f"""select *, round(100.0 * total_substitutions / sum(total_substitutions) over (), 1) as share,
 round(total_substitutions / unique_values, 1) as average_uses from ({_BY_TYPE})""")
def stats_distribution(spark, folder):
    return stats.distribution(_store(spark, folder))


@query("stats_export", STORE + """select coalesce(entity_type, 'TOTAL') as entity_type, count(*) as unique_values,
 sum(substitution_count)::bigint as total_substitutions from store group by rollup (entity_type)""")
def stats_export(spark, folder):
    return stats.export_table(_store(spark, folder))


# Configuration: one configuration per order, six type rows each.
CONFIGS = Derived("orders", {"o": "o_orderkey", "k": "o_custkey", "sent": "o_orderdate"}, {
    "id": "o",
    "name": "'config ' || cast(k as string)",
    "is_active": "o % 3 = 0",
    "confidence_threshold": "cast(o % 11 as double) / 10",
    "language": "case o % 2 when 0 then 'en' else 'de' end",
    "locale": "case o % 4 when 0 then 'en_US' when 1 then 'de_DE' when 2 then 'fr_FR' end",
    "created_at": "sent",
    "updated_at": "sent",
})
_KIND = "case n {} else 'COORDINATE' end".format(" ".join(
    f"when {i + 1} then '{t}'" for i, t in enumerate(
        ("CREDIT_CARD", "US_SSN", "GUID", "STREET_ADDRESS", "EMAIL_ADDRESS", "PHONE_NUMBER"))))
TYPES = Derived("orders", {"c": "o_orderkey", "p": "o_custkey"}, {
    "config_id": "c",
    "entity_type": _KIND,
    "enabled": "(p + n) % 3 <> 0",
    "strategy": "case (p + n) % 4 when 0 then 'replace' when 1 then 'mask' when 2 then 'hash' else 'redact' end",
}, times=6)
UPDATES = Derived("orders", {"c": "o_orderkey", "p": "o_custkey"}, {
    "config_id": "c + 1",
    "entity_type": "case when n = 6 then '' else " + _KIND + " end",
    "enabled": "case (p + n) % 3 when 0 then true when 1 then false end",
    "strategy": "case (p + n) % 2 when 0 then 'redact' end",
}, times=7)
_CONF = f"with conf as ({CONFIGS.sql}), types as ({TYPES.sql}), updates as ({UPDATES.sql}) "
_ACTIVE = "(select * from conf where is_active order by updated_at desc, id limit 1)"


def _configs(spark, folder) -> DataFrame:
    return CONFIGS.frame(spark, folder)


def _types(frame: Derived, spark, folder) -> DataFrame:
    return frame.frame(spark, folder).withColumn(
        "strategy_params", F.lit(None).cast("map<string,string>"))


@query("config_active", _CONF + f"select * from {_ACTIVE}")
def config_active(spark, folder):
    return config.active(_configs(spark, folder))


@query("config_update", _CONF + """select id, name, is_active, case when is_active then 0.55 else confidence_threshold end as confidence_threshold,
 language, case when is_active then 'it_IT' else locale end as locale, created_at,
 case when is_active then timestamp '2024-06-01' else updated_at end as updated_at from conf""")
def config_update(spark, folder):
    return config.update(_configs(spark, folder), F.lit("2024-06-01").cast("timestamp_ntz"),
                         threshold=0.55, locale="it_IT")


@query("config_upsert_types", _CONF + """select coalesce(t.config_id, u.config_id) as config_id, coalesce(t.entity_type, u.entity_type) as entity_type,
 coalesce(u.enabled, t.enabled, true) as enabled, coalesce(u.strategy, t.strategy, 'replace') as strategy
 from types t full join (select * from updates where entity_type <> '') u on t.config_id = u.config_id and t.entity_type = u.entity_type""")
def config_upsert_types(spark, folder):
    return config.upsert_types(_types(TYPES, spark, folder), _types(UPDATES, spark, folder)
                               ).drop("strategy_params")


@query("config_enabled", _CONF + f"select entity_type from types where enabled and config_id = (select id from {_ACTIVE})")
def config_enabled(spark, folder):
    return config.enabled_types(_configs(spark, folder), _types(TYPES, spark, folder))


@query("config_strategies", _CONF + "select config_id, entity_type, case when enabled then strategy else 'replace' end as strategy from types")
def config_strategies(spark, folder):
    return config.strategies_of(_types(TYPES, spark, folder)).drop("strategy_params")


@query("config_default", _CONF + f"select id as config_id, entity_type, true as enabled, 'replace' as strategy from conf, (select unnest({o.lst(config.DEFAULT_TYPES)}) as entity_type) where is_active")
def config_default(spark, folder):
    return config.default_types(_configs(spark, folder)).drop("strategy_params")


@query("config_backfill_type", _CONF + """select * from types union all select id, 'STREET_ADDRESS', true, 'replace' from conf
 where is_active and id not in (select config_id from types where entity_type = 'STREET_ADDRESS')""")
def config_backfill_type(spark, folder):
    return config.backfill_type(_configs(spark, folder), _types(TYPES, spark, folder)
                                ).drop("strategy_params")


@query("config_backfill_locale", _CONF + "select * replace (coalesce(locale, 'en_US') as locale) from conf")
def config_backfill_locale(spark, folder):
    return config.backfill_locale(_configs(spark, folder))


@query("config_defaults", _CONF + f"""select c_custkey as id, coalesce(case when c_custkey % 3 = 0 then 0.9 end, a.confidence_threshold, 0.7) as threshold,
 coalesce(case when c_custkey % 4 = 0 then 'es_ES' end, a.locale, 'en_US') as locale from customer left join {_ACTIVE} a on true""")
def config_defaults(spark, folder):
    requests = table(spark, folder, "customer").selectExpr(
        "c_custkey as id", "case when c_custkey % 3 = 0 then 0.9D end as threshold",
        "case when c_custkey % 4 = 0 then 'es_ES' end as locale")
    return config.request_defaults(requests, _configs(spark, folder))


# Audit, without the duration.
_REQUESTED = ["EMAIL_ADDRESS", "PHONE_NUMBER"]


@query("audit_rows", f"""with src as ({MESSAGES.sql}),
{o.detections('src', _REQUESTED)},
{o.resolved('src')},
d as (select id, count(*) as d, string_agg(distinct entity_type, ',' order by entity_type) as t from det group by 1),
r as (select id, count(*) as r from res group by 1)
select id, sent as timestamp, 'anonymize' as operation, coalesce(t, 'EMAIL_ADDRESS,PHONE_NUMBER') as types, length(text) as input_length,
 coalesce(d, 0) as entities_detected, coalesce(r, 0) as entities_anonymized from src left join d using (id) left join r using (id)""")
def audit_rows(spark, folder):
    texts = with_spans(_texts(spark, folder), CleanConfig(_REQUESTED))
    rows = audit.text_rows(texts, as_spans(F.col("found")), F.size("spans"), "sent", _REQUESTED)
    return rows.withColumn("types", F.array_join("entity_types_processed", ",")).drop(
        "entity_types_processed")


@query("audit_batch", f"""with src as ({MESSAGES.sql}),
{o.detections('src', _REQUESTED)},
{o.resolved('src')}
select timestamp '2024-06-01' as timestamp, 'batch_anonymize' as operation, 'EMAIL_ADDRESS,PHONE_NUMBER' as types,
 (select sum(length(text))::bigint from src) as input_length, (select count(*) from det) as entities_detected,
 (select count(*) from res) as entities_anonymized""")
def audit_batch(spark, folder):
    counted = with_spans(_texts(spark, folder), CleanConfig(_REQUESTED)).select(
        F.length("text").alias("input_length"), F.size("found").alias("entities_detected"),
        F.size("spans").alias("entities_anonymized"))
    row = audit.batch_row(counted, "input_length", F.lit("2024-06-01").cast("timestamp_ntz"),
                          _REQUESTED)
    return row.withColumn("types", F.array_join("entity_types_processed", ",")).drop(
        "entity_types_processed", "duration_ms")
