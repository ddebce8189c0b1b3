"""The same queries as SQL for DuckDB, written apart from the DataFrame plans."""

from __future__ import annotations

from ledgerloom.functions.normalize import DIGITS, PLAIN_DIGITS
from ledgerloom.operators import validate
from ledgerloom.operators.pipeline import EMPTY_IMAGE, NO_PAGES, PARSE_FAILED
from ledgerloom.sources.catalog import TYPE_SYNONYMS, synonym_rows
from ledgerloom.sources.ingest import MEDIA, MEDIA_TYPES

W = r"[\s\x0b\x1c-\x1f\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{W}+|{W}+$', '', 'g')"


def squeeze(x: str) -> str:
    return f"regexp_replace({strip(x)}, '{W}+', ' ', 'g')"


def norm(x: str) -> str:
    return f"regexp_replace(regexp_replace(lower({strip(x)}), '(?:{W}|-)+', '_', 'g'), '_+', '_', 'g')"


def number(x: str) -> str:
    plain = f"regexp_replace(translate({strip(x)}, '{DIGITS}', '{PLAIN_DIGITS}'), '[$€฿,]', '', 'g')"
    plain = strip(rf"regexp_replace({plain}, '^\((.*)\)$', '-\1', 's')")
    plain = rf"regexp_replace({plain}, '([0-9])_([0-9])', '\1\2', 'g')"
    return rf"case when regexp_matches({plain}, '^(?i:[+-]?(\d+\.?\d*|\.\d+)(e[+-]?\d+)?|[+-]?(inf|infinity|nan))$') then try_cast({plain} as double) end"


MONTHS = "(?i:january|february|march|april|may|june|july|august|september|october|november|december)"
SHORT = "(?i:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)"


def day(x: str, layouts: list[tuple[str, str]]) -> str:
    plain = squeeze(x)
    tried = ", ".join(f"case when regexp_matches({plain}, '{shape}') then try_strptime({plain}, '{layout}') end" for layout, shape in layouts)
    return f"strftime(coalesce({tried}), '%Y-%m-%d')"


SLASH4, SLASH2, ISO = r"^\d{1,2}/\d{1,2}/\d{4}$", r"^\d{1,2}/\d{1,2}/\d{2}$", r"^\d{4}-\d{1,2}-\d{1,2}$"
DASH4, DASH2 = r"^\d{1,2}-\d{1,2}-\d{4}$", r"^\d{1,2}-\d{1,2}-\d{2}$"
LONG = ("%B %d, %Y", rf"^{MONTHS} \d{{1,2}}, \d{{4}}$")
COMPARE = [("%d/%m/%y", SLASH2), ("%d/%m/%Y", SLASH4), ("%Y-%m-%d", ISO), ("%m/%d/%Y", SLASH4), LONG]
VALIDATE = [("%Y-%m-%d", ISO), ("%d/%m/%Y", SLASH4), ("%m/%d/%Y", SLASH4), ("%d/%m/%y", SLASH2), ("%m/%d/%y", SLASH2), ("%d-%m-%Y", DASH4), ("%m-%d-%Y", DASH4), ("%d-%m-%y", DASH2), ("%m-%d-%y", DASH2), LONG, ("%b %d, %Y", rf"^{SHORT} \d{{1,2}}, \d{{4}}$")]


def quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


ALIASES = "aliases(a_type, synonym, canonical) as (values " + ", ".join(f"({quoted(a)}, {quoted(b)}, {quoted(c)})" for a, b, c in synonym_rows()) + ")"


def alias(doc_type: str, name: str) -> str:
    """A scalar lookup of a normalised name."""
    return f"coalesce((select canonical from aliases a where a.a_type = lower({strip(doc_type)}) and a.synonym = {name}), {name})"


def canonical(x: str) -> str:
    low = f"lower({strip(x)})"
    return f"case when {low} in ('invoice', 'po', 'delivery_note') then {low} " + " ".join(f"when {low} = {quoted(a)} then {quoted(b)}" for a, b in TYPE_SYNONYMS.items()) + " end"


SCALARS = """entries as (
    select distinct entry_id, result_id as doc_id, doc_type, cast(ord as bigint) as ord, name, value as value_json, source_span, likely_required, confidence from extracted_fields
), scalars as (
    select *, json_extract_string('{"v":' || value_json || '}', '$.v') as text from entries where not regexp_matches(trim(value_json), '^[\\[{]')
)"""

SUGGESTED = f"""responses as (
    select result_id, response_id, doc_type, suggested_fields from (
        select *, row_number() over (partition by result_id order by response_id desc) as turn
        from (select distinct on (response_id) response_id, result_id, doc_type, suggested_fields from routing_responses)
    ) where turn = 1
), suggested as (
    select result_id as doc_id, coalesce({canonical('doc_type')}, doc_type) as doc_type, cast(i - 1 as bigint) as ord, f.name as name, f.description as description, f.likely_required as likely_required
    from (select result_id, doc_type, unnest(suggested_fields) as f, unnest(range(1, len(suggested_fields) + 1)) as i from responses) where f.name is not null
)"""

SPLIT = f"""known as (
    select *, {norm('name')} as n from suggested
), keyed as (
    select doc_id, name, ord, n as k from known union select doc_id, name, ord, {alias('doc_type', 'n')} from known
), lookup as (
    select doc_id, k, arg_max(name, ord) as name from keyed group by doc_id, k
), named as (
    select e.doc_id, e.ord, e.value_json, e.name, {norm('e.name')} as n, {alias('e.doc_type', norm('e.name'))} as a from entries e where e.name is not null and e.value_json is not null and trim(e.value_json) <> 'null'
), found as (
    select v.*, coalesce((select min(s.name) from suggested s where s.doc_id = v.doc_id and s.name = v.name), (select l.name from lookup l where l.doc_id = v.doc_id and l.k = v.a), (select l.name from lookup l where l.doc_id = v.doc_id and l.k = v.n)) as target from named v
), split as (
    select doc_id, bucket, field, max(ord) as ord, arg_max(value_json, ord) as value_json
    from (select doc_id, ord, value_json, case when target is null then 'additional' else 'extracted' end as bucket, coalesce(target, name) as field from found) group by doc_id, bucket, field
)"""

ISSUES = f"""pages as (select distinct result_id as doc_id from extraction_results),
told as (select *, lower(field) as low, json_extract_string('{{"v":' || value_json || '}}', '$.v') as text, starts_with({strip('value_json')}, '"') as is_text from split),
issues as (
    select doc_id, '*' as field, {quoted(validate.NOTHING)} as message, 'error' as severity from pages where doc_id not in (select doc_id from split)
    union all
    select doc_id, name, 'Missing required field ''' || name || ''' from catalog', 'warning' from suggested s where likely_required and not exists (select 1 from split x where x.doc_id = s.doc_id and x.field = s.name and x.bucket = 'extracted')
    union all
    select doc_id, field, {quoted(validate.BAD_DATE)}, 'warning' from told where contains(low, 'date') and is_text and {day('text', VALIDATE)} is null
    union all
    select doc_id, field, {quoted(validate.NEGATIVE)}, 'warning' from told where regexp_matches(low, '{validate.AMOUNT_HINTS}') and not is_text and try_cast(text as double) < 0
)"""

ORDERS = "base as (select o_orderkey as k, c_name, o_orderdate as d, o_totalprice as t, o_orderpriority as pr from orders join customer on o_custkey = c_custkey)"
TRUTH = """truth as (
    select k as doc_id, 0 as ord, 'po_number' as field, '"PO-' || k || '"' as v from base
    union all select k, 1, 'order_date', '"' || strftime(d, '%Y-%m-%d') || '"' from base
    union all select k, 2, 'buyer_name', '"' || c_name || '"' from base
    union all select k, 3, 'total_amount', cast(cast(t as decimal(18,2)) as varchar) from base
    union all select k, 4, 'payment_terms', '"' || pr || '"' from base
    union all select k, 5, 'currency', '"USD"' from base
    union all select k, 6, 'line_items', '[{"sku":"A' || k || '","price":' || cast(t as decimal(18,2)) || '},{"sku":"B","price":2.5}]' from base
)"""
PREDICTED = """predicted as (
    select k as doc_id, 0 as ord, 'po_number' as field, '"PO-' || k || '"' as v from base where k % 11 <> 0
    union all select k, 1, 'order_date', '"' || case when k % 2 = 0 then strftime(d, '%-d/%-m/%Y') else strftime(d, '%d/%m/%y') end || '"' from base where k % 7 <> 0
    union all select k, 2, 'buyer_name', '"  ' || upper(c_name) || ' "' from base
    union all select k, 3, 'total_amount', case when k % 5 = 0 then '1.5' else '"$' || format('{:,.2f}', t) || '"' end from base where k % 17 <> 0
    union all select k, 4, 'total_amount', cast(cast(t as decimal(18,2)) as varchar) from base where k % 17 = 0
    union all select k, 5, 'payment_terms', case when k % 13 = 0 then 'null' else '"' || lower(pr) || '"' end from base
    union all select k, 6, 'mystery_field', '"?"' from base where k % 4 = 0
    union all select k, 7, 'line_items', case k % 4
        when 0 then '[{"price":' || cast(t as decimal(18,2)) || ',"sku":"a' || k || '"}, {"sku":" B ","price":"2.50"}]'
        when 1 then cast(to_json('[{"sku":"A' || k || '","price":"$' || format('{:,.2f}', t) || '"},{"sku":"B","price":2.5}]') as varchar)
        when 2 then '[{"sku":"A' || k || '","price":' || cast(t as decimal(18,2)) || '}]'
        else '{"sku":"A' || k || '","price":' || cast(t as decimal(18,2)) || '}' end from base where k % 3 <> 0
)"""
TEXT_P, TEXT_E = "json_extract_string('{\"v\":' || p.v || '}', '$.v')", "json_extract_string('{\"v\":' || e.v || '}', '$.v')"
#: Lists of flat objects with the keys sku and price: as many of them, and equal by the rules for texts and numbers in turn.
ITEM = "(json_keys(z[1])[:] is not null and list_sort(json_keys(z[1])) = list_sort(json_keys(z[2])) and lower({0}) = lower({1}) and abs({2} - {3}) <= 1e-6)".format(
    squeeze("json_extract_string(z[1], '$.sku')"), squeeze("json_extract_string(z[2], '$.sku')"), number("json_extract_string(z[1], '$.price')"), number("json_extract_string(z[2], '$.price')")
)
BOXES = f"""case when json_type(pj) <> 'ARRAY' or json_type(ej) <> 'ARRAY' then false
    else len(from_json(pj, '["json"]')) = len(from_json(ej, '["json"]')) and list_bool_and(list_transform(list_zip(from_json(pj, '["json"]'), from_json(ej, '["json"]')), lambda z: {ITEM})) end"""
COMPARED = f"""{ORDERS}, {TRUTH}, {PREDICTED}, sided as (
    select coalesce(p.doc_id, e.doc_id) as doc_id, coalesce(p.field, e.field) as field, e.ord, p.v as predicted, e.v as expected, p.doc_id is not null as in_pred, e.doc_id is not null as in_truth,
        nullif(p.v, 'null') as pv, nullif(e.v, 'null') as ev, {number(TEXT_P)} as pn, {number(TEXT_E)} as en, {day(TEXT_P, COMPARE)} as pd, {day(TEXT_E, COMPARE)} as ed, lower({squeeze(TEXT_P)}) as pt, lower({squeeze(TEXT_E)}) as et,
        case when p.field = 'line_items' and e.field = 'line_items' then case when starts_with(p.v, '"') then {TEXT_P} else p.v end end as pj, case when p.field = 'line_items' and e.field = 'line_items' then e.v end as ej
    from predicted p full join truth e on p.doc_id = e.doc_id and p.field = e.field
), compared as (
    select doc_id, field, ord, predicted, expected, in_pred, in_truth,
        case when pv is null or ev is null then pv is null and ev is null when pv = ev then true when pj is not null and ej is not null then {BOXES} when pn is not null and en is not null then abs(pn - en) <= 1e-6
            when pd is not null and ed is not null then pd = ed else coalesce(pt = et and pv[1] = '"' and ev[1] = '"', false) end as matched from sided
)"""
COUNTS = "count(*) filter (in_truth and matched) as tp, count(*) filter (in_truth and not matched) as fn, count(*) filter (in_pred and not matched) as fp"
METRICS = "case when tp + fp = 0 then 1.0e0 else tp / (tp + fp) end as precision, case when tp + fn = 0 then 1.0e0 else tp / (tp + fn) end as recall"
F1 = "case when precision + recall = 0 then 0.0e0 else 2 * precision * recall / (precision + recall) end as f1"
BY_DOC = f"by_doc as (select doc_id, tp, fn, fp, precision, recall, {F1} from (select *, {METRICS} from (select doc_id, {COUNTS} from compared group by doc_id)))"
PAGES = "pages as (select distinct on (result_id) * from extraction_results)"
ANSWERS = f"""{PAGES}, answers as (
    select result_id, judge.score as s, '{{"score": ' || format('{{:.3f}}', judge.score) || ', "issues": [], "notes": "n' || result_id || '"}}' as body, result_id % 5 in (0, 1, 2) as good, result_id % 10 = 9 as lost from pages where judge.score is not null
)"""
UPLOADS = f"""{PAGES}, uploads as (
    select job_id, result_id, filename, coalesce(page_no, 0) as page_no, lower(case when result_id % 4 = 0 then 'Image/PNG' when result_id % 4 = 1 then 'application/pdf' end) as ct, coalesce(length(full_text), 0) as bytes,
        lower(regexp_extract(regexp_extract(filename, '[^/]*$'), '.(\\.[^.]*)$', 1)) as suffix from pages where filename is not null
)"""
KNOWN = "ct in (" + ", ".join(map(quoted, MEDIA_TYPES)) + ")"
IMAGE = f"(coalesce({KNOWN}, false) or suffix in (" + ", ".join(map(quoted, MEDIA)) + "))"
BY_SUFFIX = "case suffix " + " ".join(f"when {quoted(a)} then {quoted(b)}" for a, b in MEDIA.items()) + " end"


def sql() -> dict[str, str]:
    types = "select doc_type, file_stem as file, cast(length(cast(json(output) as varchar)) + 11 as bigint) as size from (select distinct on (file_stem) '{1}/' || coalesce(source_system, '-') as doc_type, file_stem, output from {0}) where json_valid(output) and json_type(output) = 'OBJECT' and len(json_keys(output)) > 0"
    examples = " union all ".join(types.format(a, b) for a, b in (("invoices", "invoice"), ("purchase_orders", "po"), ("delivery_notes", "delivery_note")))
    out_of_catalog = f"{canonical('doc_type')} is null"
    return {
        "evaluate_f1_by_doc": f"with {COMPARED}, {BY_DOC} select * from by_doc",
        "evaluate_mismatches": f"with {COMPARED} select doc_id, cast(ord as bigint) as ord, field, predicted, expected from compared where in_truth and not matched",
        "corpus_rollup": f"with {COMPARED} select doc_type, field, tp, fn, fp, precision, recall, {F1} from (select *, {METRICS} from (select doc_type, field, {COUNTS} from (select 'po' as doc_type, * from compared) group by rollup(doc_type, field)))",
        "auto_evaluate": f"with {COMPARED}, {BY_DOC}, files as (select case when o_orderkey % 9 = 0 then 'scan.' || o_orderkey else 'in/po_' || o_orderkey || '.v1.pdf' end as filename, case when o_orderkey % 9 = 0 then 'scan' else 'po_' || o_orderkey || '.v1' end as stem from orders) select filename, stem, f1 from files left join by_doc on stem = 'po_' || doc_id || '.v1'",
        "rename_predictions": f"with {ORDERS}, {PREDICTED} select doc_id, cast(ord as bigint) as ord, field, v as value_json from predicted",
        "values_match_scalar": f"with {COMPARED} select doc_id, field, predicted, expected, matched from compared",
        "values_match_container": f"""select doc_id, bool_and(abs(a_no - {number('b_no')}) <= 1e-6 and abs(a_qty - {number('b_qty')}) <= 1e-6 and lower({squeeze('a_flag')}) = lower({squeeze('b_flag')})) as matched from (
            select l_orderkey as doc_id, l_linenumber as a_no, l_quantity as a_qty, l_returnflag as a_flag, cast(case when l_orderkey % 3 = 0 then l_linenumber + 1 else l_linenumber end as varchar) as b_no, ' ' || l_quantity as b_qty, lower(l_returnflag) as b_flag from lineitem) group by doc_id""",
        "normalize_names": f"select name, {norm('name')} as norm from (select distinct name from extracted_fields where name is not null)",
        "alias_resolve": f"with {ALIASES} select doc_type, name, {alias('doc_type', 'n')} as canonical from (select distinct doc_type, name, {norm('name')} as n from extracted_fields where name is not null)",
        "doc_type_canonical": f"select raw, coalesce({canonical('raw')}, raw) as doc_type, {canonical('raw')} is null as out_of_catalog from (select distinct doc_type as raw from routing_responses where doc_type is not null)",
        "parse_numbers": f"with {SCALARS} select entry_id, {number('text')} as number from scalars",
        "parse_dates_compare": f"with {SCALARS} select entry_id, {day('text', COMPARE)} as day from scalars",
        "parse_dates_validate": f"with {SCALARS} select entry_id, {day('text', VALIDATE)} as day from scalars",
        "string_equal": f"with {SCALARS} select entry_id, lower({squeeze('text')}) = lower({squeeze('source_span')}) as same from scalars where text is not null and source_span is not null",
        "reconcile_catalog": f"""with {ALIASES}, {SUGGESTED}, cat as (select *, {norm('name')} as n from catalog_terms where kind = 'field'), own as (select s.*, {alias('s.doc_type', norm('s.name'))} as n from suggested s)
            select o.doc_id, o.doc_type, 0 as part, o.ord, coalesce(c.name, o.name) as name, o.description, coalesce(c.required, o.likely_required) as likely_required from own o left join cat c on c.doc_type = o.doc_type and c.n = o.n
            union all
            select d.doc_id, d.doc_type, 1, c.term_id, c.name, c.description, c.required from (select distinct doc_id, doc_type from suggested) d join cat c on c.doc_type = d.doc_type where not exists (select 1 from own o where o.doc_id = d.doc_id and o.n = c.n)""",
        "split_extracted": f"with {ALIASES}, {SCALARS}, {SUGGESTED}, {SPLIT} select doc_id, bucket, field, ord, value_json from split",
        "prediction_projection": f"with {ALIASES}, {SCALARS}, {SUGGESTED}, {SPLIT} select doc_id, field, min(bucket) as bucket, arg_min(value_json, bucket) as value_json from split group by doc_id, field",
        "validate_issues": f"with {ALIASES}, {SCALARS}, {SUGGESTED}, {SPLIT}, {ISSUES} select * from issues",
        "validate_summary": f"""with {ALIASES}, {SCALARS}, {SUGGESTED}, {SPLIT}, {ISSUES}, there as (select doc_id, field from split where bucket = 'extracted'),
            w as (select s.doc_id, count(*) as s, count(t.field) as f from suggested s left join there t on t.doc_id = s.doc_id and t.field = s.name group by s.doc_id),
            x as (select doc_id, count(*) as x from there group by doc_id), i as (select doc_id, count(*) as i, count(*) filter (severity = 'error') as e from issues group by doc_id)
            select p.doc_id, coalesce(e, 0) = 0 as is_valid, case when s is null then case when x > 0 then 1.0e0 else 0.0e0 end else round_even(f / s, 4) end as completeness, cast(coalesce(i, 0) as bigint) as n_issues
            from pages p left join w using (doc_id) left join x using (doc_id) left join i using (doc_id)""",
        "needs_review": f"with {PAGES} select result_id, failed_stage is not null or error is not null or not coalesce(validation.is_valid, false) or coalesce(judge.score, 0) < 0.7 or {out_of_catalog} as review from pages",
        "error_issues": f"with {PAGES} select result_id, coalesce(len(list_filter(validation.issues, lambda i: i.severity = 'error')) > 0, false) as has_error, judge.score as score, cast(coalesce(len(judge.issues), 0) as bigint) as n_judge_issues from pages",
        "few_shot_budget": f"select doc_type, file, size, turn, cast(used as bigint) as used from (select *, row_number() over w as turn, sum(size) over (w rows unbounded preceding) as used from ({examples}) window w as (partition by doc_type order by file)) where turn <= 5 and (turn = 1 or used <= 1500)",
        "few_shot_by_page": f"""with {PAGES}, ranked as (select *, row_number() over w as turn, sum(size) over (w rows unbounded preceding) as used from ({examples}) window w as (partition by doc_type order by file)),
            again as (select split_part(doc_type, '/', 1) as kind, file, size from ranked where turn <= 5 and (turn = 1 or used <= 1500)),
            kept as (select *, row_number() over w as turn, sum(size) over (w rows unbounded preceding) as used from again window w as (partition by kind order by file)),
            sums as (select kind, count(*) as n, sum(size) as size from kept where turn <= 5 and (turn = 1 or used <= 1500) group by kind)
            select result_id, cast(coalesce(n, 0) as bigint) as n_examples, cast(coalesce(size, 0) as bigint) as n_chars from pages left join sums on kind = lower({strip('doc_type')})""",
        "two_attempts_tokens": f"""with {ANSWERS}, shown as (select *, case result_id % 5 when 0 then length(body) when 1 then length(body) + 12 when 2 then length(body) + 18 when 3 then 14 else 5 end as t1, case when lost then null else length(body) end as t2, good and result_id % 7 <> 0 as first_good, not lost and result_id % 3 <> 0 as second_good from answers)
            select result_id, case when first_good or second_good then 'n' || result_id end as notes, cast(case when first_good then 1 else 2 end as bigint) as attempt, case when first_good or second_good then null when result_id % 3 = 0 then 'refused' else 'unparsable' end as error, cast(case when first_good then t1 else coalesce(t2, t1) end as bigint) as tokens from shown""",
        "pipeline_run": f"""with {ALIASES}, {SCALARS}, {SUGGESTED}, {SPLIT}, {ISSUES}, rows_ as (select distinct on (result_id) * from extraction_results),
            counted as (select doc_id, count(*) as n from split group by doc_id), bad as (select distinct doc_id from issues where severity = 'error'),
            joined as (select r.result_id, coalesce({canonical('q.doc_type')}, q.doc_type) as doc_type, {canonical('q.doc_type')} is null and q.result_id is not null as outside, coalesce(n, 0) as n_fields, bad.doc_id is null as is_valid, r.judge.score as score, r.failed_stage as fs, r.error as e,
                coalesce(lower(regexp_extract(regexp_extract(r.filename, '[^/]*$'), '.(\\.[^.]*)$', 1)) in ({', '.join(map(quoted, MEDIA))}), false) as image, coalesce({strip('r.full_text')}, '') <> '' as has_text
                from rows_ r left join responses q on q.result_id = r.result_id left join counted on counted.doc_id = r.result_id left join bad on bad.doc_id = r.result_id),
            staged as (select *, case when not has_text and not image then 0 when fs is null and e is not null then 0 when fs = 'router' then 0 when fs = 'extractor' then 1 when image and n_fields = 0 then 1 when fs = 'validator' then 2 when fs = 'judge' then 3 else 4 end as stage_no from joined)
            select result_id, case when stage_no > 0 then doc_type end as doc_type, cast(case when stage_no > 1 then n_fields end as bigint) as n_fields, case when stage_no > 2 then is_valid end as is_valid, case when stage_no > 3 then score end as score,
                case when stage_no = 4 then null when not has_text and not image then 'router' when fs is null and e is not null then null when stage_no = 1 then 'extractor' else fs end as failed_stage,
                case when stage_no = 4 then null when not has_text and not image then 'Neither text nor image' when fs is null and e is not null then 'Extraction pipeline failed: ' || e when stage_no = 1 and coalesce(fs, '') <> 'extractor' then {quoted(EMPTY_IMAGE)} when fs = 'validator' then 'Validation failed: ' || coalesce(e, '?') else coalesce(e, '?') end as error,
                stage_no < 4 or not is_valid or coalesce(score, 0) < 0.7 or coalesce(outside, false) as needs_review from staged""",
        "group_routing": f"""with {PAGES}, parts as (select job_id, result_id, coalesce(lower(regexp_extract(regexp_extract(filename, '[^/]*$'), '.(\\.[^.]*)$', 1)) in ({', '.join(map(quoted, MEDIA))}), false) as image, coalesce({strip('full_text')}, '') <> '' as page, case when contains(error, 'timeout') then error end as failed from pages where job_id is not null),
            by_job as (select job_id, bool_and(image) as vision, arg_min(failed, result_id) filter (failed is not null) as failed, count(*) filter (page) as n, count(*) as parts from parts group by job_id)
            select job_id as group_id, case when vision then 'vision' else 'parse' end as route, case when vision then null when failed is not null then {quoted(PARSE_FAILED)} || failed when n = 0 then {quoted(NO_PAGES)} end as error, cast(case when vision then parts when failed is not null then 0 else n end as bigint) as n_documents from by_job""",
        "job_status": f"with {PAGES} select job_id, regexp_matches(job_id, '^(?i:(urn:uuid:)?\\{{?[0-9a-f]{{8}}-?[0-9a-f]{{4}}-?[0-9a-f]{{4}}-?[0-9a-f]{{4}}-?[0-9a-f]{{12}}\\}}?)$') as valid_id, count(*) as n_pages, count(error) as n_failed, case when count(error) = count(*) then 'failed' else 'done' end as status from pages where job_id is not null group by job_id",
        "catalog_doc_types": "select row_number() over (order by first) - 1 as place, doc_type, lpad(cast(first as varchar), 12, '0') as file from (select doc_type, min(term_id) as first from catalog_terms where kind = 'field' group by doc_type)",
        "parse_responses": f"with {ANSWERS} select result_id, case when good then cast(format('{{:.3f}}', s) as double) end as score, case when good then 'n' || result_id end as notes from answers",
        "two_attempts": f"with {ANSWERS} select result_id, case when good or not lost then 'n' || result_id end as notes, cast(case when good then 1 else 2 end as bigint) as attempt, case when not good and lost then 'unparsable' end as error from answers",
        "pipeline_status": f"with {PAGES} select result_id, cast(coalesce(case failed_stage when 'router' then 0 when 'extractor' then 1 when 'validator' then 2 when 'judge' then 3 end, case when doc_type is null then 0 when full_text is null then 1 when validation is null then 2 when judge is null then 3 else 4 end) as bigint) as stage from pages",
        "image_detect": f"with {UPLOADS} select result_id, {IMAGE} as image, coalesce(case when {KNOWN} then ct end, {BY_SUFFIX}, 'image/jpeg') as media, regexp_replace(regexp_extract(filename, '[^/]*$'), '^(.+)\\.[^.]*$', '\\1') as stem from uploads",
        "group_meta": f"with {UPLOADS} select job_id as group_id, count(*) as n_parts, case when count(*) = 1 then min(filename) else count(*) || ' files (' || arg_min(filename, result_id) || ', ...)' end as group_name, cast(sum(bytes) as bigint) as total_bytes, bool_and({IMAGE}) as all_images from uploads where job_id is not null group by job_id",
        "group_response": f"with {UPLOADS} select job_id, string_agg(cast(result_id as varchar), ',' order by page_no, result_id) as pages from uploads where job_id is not null group by job_id",
        "router_prompt": f"""with made as (select doc_id, text, {strip('text')} as body from documents)
            select doc_id, coalesce(body, '') <> '' as has_input, cast(length('Name the type of this document, exactly one of: invoice, po, delivery_note.' || chr(10) || chr(10) || 'Name its language: en, th, or other.' || chr(10) || chr(10) || 'Propose the fields that can be read in it, each with a short name and a description.' || chr(10) || chr(10) || 'Filename: doc_' || doc_id)
                + case when coalesce(body, '') = '' then 0 else length(body) + length('Document text:') + 3 end as bigint) as n_chars from made""",
        "catalog_templates": "select doc_type, string_agg(name || ':' || value_type || ':' || coalesce(required, false), ';' order by term_id) as fields, count(*) as n_fields from catalog_terms where kind = 'field' group by doc_type",
        "display_values": f"with {PAGES} select result_id, cast(floor(judge.score * 100 + 0.5) as bigint) as percent, coalesce(judge.notes, '—') as notes, cast(case when length(full_text) > 60 then 60 + length('… [truncated, ' || length(full_text) || ' chars total]') else length(full_text) end as bigint) as n_shown from pages",
    }
