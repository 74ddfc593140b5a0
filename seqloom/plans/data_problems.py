"""Queries of the general data problems: packed fields, schema drift, orphan references."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.operators import drift, orphans, packed
from seqloom.runtime import table

#: (table, column, key, blanks cut)
PACKED = [
    ("lead_candidates_filtered", "associated_disease", "lead_id", False),
    ("lead_candidates_filtered", "safety_risks", "lead_id", False),
    ("mined_proteins", "repeat_domains", "rec_id", True),
    ("family_manifest", "repeat_domains", "manifest_row", True),
]


def _unpacked(spark: SparkSession, sf_dir: str, min_items: int) -> DataFrame:
    out = None
    for name, field, key, blank_cuts in PACKED:
        one = packed.unpack(table(spark, sf_dir, name), field, key, f"{name}.{field}", blank_cuts, min_items)
        out = one if out is None else out.unionByName(one)
    return out


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _unpacked(spark, sf_dir, 2).select("field_name", "row_id", "item_pos", "item")


def p2_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _unpacked(spark, sf_dir, 1)


def p2_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _unpacked(spark, sf_dir, 1)
    return rows.groupBy("field_name", "kind", "error").agg(F.count("*").alias("n_items"), F.max("item_pos").alias("most_items"))


REFS = [
    # ref_field, referring table, key, time, row id, target table, key, begin, end
    ("family_manifest.original_id", "family_manifest", "original_id", "grouped_at", "manifest_row", "mined_proteins", "sequence_id", "loaded_at", "deleted_at"),
    ("lead_candidates_filtered.enzyme_variant", "lead_candidates_filtered", "enzyme_variant", "created_at", "lead_id", "family_manifest", "new_id", "grouped_at", "retired_at"),
    ("lead_candidates_filtered.target_fusion", "lead_candidates_filtered", "target_fusion", "created_at", "lead_id", "high_specificity_targets", "fusion_name", "loaded_at", "deleted_at"),
]


def _deltas_and_refs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    deltas = refs = None
    for ref_field, source, key, at, row_id, target, t_key, begins, ends in REFS:
        d = orphans.target_deltas(table(spark, sf_dir, target), t_key, begins, ends, ref_field)
        r = orphans.references(table(spark, sf_dir, source), key, at, row_id, ref_field)
        deltas, refs = (d, r) if deltas is None else (deltas.unionByName(d), refs.unionByName(r))
    return deltas, refs


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphans.orphans(*_deltas_and_refs(spark, sf_dir)).select("ref_field", "row_id", "orphan_kind")


def p5_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphans.report(orphans.orphans(*_deltas_and_refs(spark, sf_dir)))


def p5_current(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphans.current(*_deltas_and_refs(spark, sf_dir))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift.changes(table(spark, sf_dir, "fusion_files")).select("file_id", "change_kind", "old_field", "new_field")


def p3_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift.file_types(drift.path_values(table(spark, sf_dir, "fusion_files"), keep=drift.FILE))


NOVEL = {"fusionsss": "string", "count": "int", "Pub supported": "string", "KB supported": "string"}
SPECIFIC = {"Fusion_Name": "string", "Primary_Disease": "string", "Tissue_Types_Count": "int", "Total_Patients": "int", "Specificity_Score": "double"}


def p3_novel_fusions(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "fusion_files")
    return drift.consistent(lines, "novel_fusions", NOVEL, drift.changes(lines))


def p3_high_specificity_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "fusion_files")
    return drift.consistent(lines, "high_specificity_targets", SPECIFIC, drift.changes(lines))


QUERIES = {f.__name__: f for f in (p2_found, p2_items, p2_profile, p3_found, p3_types, p3_novel_fusions, p3_high_specificity_targets, p5_found, p5_report, p5_current)}


def _packed_parts_sql() -> str:
    """Tokens and what stands between them, for brackets in up to four levels; without look-ahead, the same on well-formed quotes."""
    bracket = r"\([^()]*\)"
    for _ in range(3):
        bracket = rf"\((?:[^()]|{bracket})*\)"
    parts = []
    for name, field, key, blank_cuts in PACKED:
        blank = "" if blank_cuts else " "
        pattern = (r"""("(?:[^"]|"")*"|'(?:[^']|'')*'|(?:[\p{L}\p{Nd}.:%\-BLANK]|""".replace("BLANK", blank) + bracket + ")+)").replace("'", "''")
        parts.append(f"select '{name}.{field}' as field_name, {key} as row_id, regexp_extract_all({field}, '{pattern}') as toks, regexp_split_to_array({field}, '{pattern}') as gaps from {name} where {field} is not null")
    return " union all ".join(parts)


_CLEAN = "trim(case when t like '\"%' then replace(t[2:len(t)-1], '\"\"', '\"') when t like '''%' then replace(t[2:len(t)-1], '''''', '''') else t end)"
_KIND = "case when t like '\"%' or t like '''%' then 'quoted' when t like '%(%' then 'bracketed' else 'bare' end"


def _error_sql(text: str) -> str:
    return f"concat_ws(',', case when regexp_matches({text}, '[\"'']') then 'quote' end, case when regexp_matches({text}, '[()]') then 'bracket' end)"


_ITEMS_SQL = f"""with parts as ({_packed_parts_sql()}),
    each as (select field_name, row_id, p, toks[p] as t, gaps[p] || case when p = len(toks) then gaps[p + 1] else '' end as gap, array_to_string(gaps, '') as rest from parts, lateral (select unnest(range(1, len(toks) + 1)) as p)),
    items as (select field_name, row_id, p, {_CLEAN} as item, {_KIND} as kind, {_error_sql("rest")} as error, {_error_sql("gap")} as item_error from each),
    kept as (select field_name, row_id, cast(row_number() over (partition by field_name, row_id order by p) as integer) as item_pos, item, kind, error, item_error, count(*) over (partition by field_name, row_id) as n from items where item <> '')
    """


def _key_sql(col: str) -> str:
    return f"nullif(lower(regexp_replace({col}, '^\\s+|\\s+$', '', 'g')), '')"


def _orphan_sql() -> str:
    parts = []
    for ref_field, source, key, at, row_id, target, t_key, begins, ends in REFS:
        parts.append(
            f"select '{ref_field}' as ref_field, r.row_id, case when count(t.k) = 0 then 'missing' when count(*) filter (where t.b <= r.t) > 0 then 'deleted' else 'late' end as orphan_kind, r.k as k, r.t as t "
            f"from (select {row_id} as row_id, {_key_sql(key)} as k, {at} as t from {source}) r left join (select {_key_sql(t_key)} as k, {begins} as b, {ends} as e from {target}) t on r.k = t.k "
            "where r.k is not null group by r.row_id, r.k, r.t having count(*) filter (where t.b <= r.t and (t.e is null or r.t < t.e)) = 0"
        )
    return " union all ".join(parts)


def _current_sql() -> str:
    parts = []
    for ref_field, source, key, _, _, target, t_key, begins, ends in REFS:
        parts.append(
            f"select '{ref_field}' as ref_field, r.k, r.n as n_refs, coalesce(t.seen, 0) as n_targets_seen from (select {_key_sql(key)} as k, count(*) as n from {source} group by 1) r "
            f"left join (select {_key_sql(t_key)} as k, count({begins}) as seen, count(*) filter (where {begins} is not null and {ends} is null) as alive from {target} group by 1) t on t.k = r.k "
            "where r.k is not null and coalesce(t.alive, 0) <= 0"
        )
    return " union all ".join(parts)


_VALUES_SQL = """select f.*, k.path as path, json_extract_string(payload, '$."' || k.path || '"') as raw,
    case json_type(payload, '$."' || k.path || '"') when 'BOOLEAN' then 'boolean' when 'UBIGINT' then 'integer' when 'BIGINT' then 'integer' when 'DOUBLE' then 'decimal' when 'NULL' then null else 'text' end as kind
    from fusion_files f, lateral (select unnest(json_keys(payload)) as path) k"""

_DRIFT_SQL = f"""
with v as ({_VALUES_SQL}),
types as (select file_id, path, case when count(kind) = 0 then null when count(*) filter (where kind = 'boolean') = count(kind) then 'boolean'
    when count(*) filter (where kind = 'integer') = count(kind) then 'integer' when count(*) filter (where kind in ('integer', 'decimal')) = count(kind) then 'decimal' else 'text' end as type
    from v group by 1, 2),
files as (select file_id, lag(file_id) over (partition by series_id order by file_no) as prev_id from (select distinct series_id, file_no, file_id from fusion_files)),
pairs as (select * from files where prev_id is not null),
gone as (select p.file_id, p.prev_id, t.path, t.type from pairs p join types t on t.file_id = p.prev_id where not exists (select 1 from types n where n.file_id = p.file_id and n.path = t.path)),
came as (select p.file_id, p.prev_id, t.path, t.type from pairs p join types t on t.file_id = p.file_id where not exists (select 1 from types o where o.file_id = p.prev_id and o.path = t.path)),
rec as (select file_id, record_key, path, arg_min(raw, line_no) as raw from (select file_id, record_key, path, coalesce(raw, '') as raw, line_no, kind from v) where kind is not null group by 1, 2, 3),
keys as (select distinct file_id, record_key from fusion_files where record_key is not null),
votes as (select g.file_id, g.path as a, c.path as b, g.type as old_type, c.type as new_type
    from gone g join came c on c.file_id = g.file_id join keys k1 on k1.file_id = g.file_id join keys k0 on k0.file_id = g.prev_id and k0.record_key = k1.record_key
    left join rec ra on ra.file_id = g.prev_id and ra.record_key = k1.record_key and ra.path = g.path
    left join rec rb on rb.file_id = g.file_id and rb.record_key = k1.record_key and rb.path = c.path
    where ra.raw is not null or rb.raw is not null
    group by 1, 2, 3, 4, 5 having count(*) filter (where ra.raw = rb.raw) >= 0.8 * count(*))
select file_id, 'renamed' as change_kind, a as old_field, b as new_field from votes
union all select file_id, 'added', '', path from came c where not exists (select 1 from votes v where v.file_id = c.file_id and v.b = c.path)
union all select file_id, 'removed', path, '' from gone g where not exists (select 1 from votes v where v.file_id = g.file_id and v.a = g.path)
union all select p.file_id, 'type_changed', o.path, n.path from pairs p join types o on o.file_id = p.prev_id join types n on n.file_id = p.file_id and n.path = o.path where o.type <> n.type
union all select file_id, 'type_changed', a, b from votes where old_type <> new_type
"""

ORACLE = {
    "p2_found": _ITEMS_SQL + "select field_name, row_id, item_pos, item from kept where n >= 2",
    "p2_items": _ITEMS_SQL + "select field_name, row_id, item_pos, item, kind, error, item_error from kept",
    "p2_profile": _ITEMS_SQL + "select field_name, kind, error, count(*) as n_items, max(item_pos) as most_items from kept group by 1, 2, 3",
    "p3_found": _DRIFT_SQL,
    "p3_types": f"""select dataset, series_id, file_no, file_id, path, count(*) as n_lines, count(kind) as n_values, count(*) filter (where kind = 'boolean') as n_boolean,
        count(*) filter (where kind = 'integer') as n_integer, count(*) filter (where kind = 'decimal') as n_decimal, count(*) filter (where kind = 'text') as n_text,
        case when count(kind) = 0 then null when count(*) filter (where kind = 'boolean') = count(kind) then 'boolean' when count(*) filter (where kind = 'integer') = count(kind) then 'integer'
        when count(*) filter (where kind in ('integer', 'decimal')) = count(kind) then 'decimal' else 'text' end as type from ({_VALUES_SQL}) group by 1, 2, 3, 4, 5""",
    "p5_current": _current_sql(),
    "p5_found": f"select ref_field, row_id, orphan_kind from ({_orphan_sql()})",
    "p5_report": f"select ref_field, strftime(t, '%Y-%m') as month, orphan_kind, count(*) as n_refs, count(distinct k) as n_keys from ({_orphan_sql()}) group by 1, 2, 3",
}
