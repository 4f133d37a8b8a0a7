"""DuckDB SQL with the rows of the queries beside."""

from __future__ import annotations

from tillroll.functions import keywords
from tillroll.operators import matrix, scoring

_ITEMS = """items as (select l_orderkey as o_orderkey, l_linenumber, l_partkey, p_name as description, l_quantity::int as quantity, p_retailprice::decimal(18,2) as unit_price,
    (l_quantity::int * p_retailprice::decimal(18,2))::decimal(18,2) as item_total from lineitem join part on l_partkey = p_partkey)"""
_RECEIPTS = f"""{_ITEMS},
sums as (select o_orderkey, sum(item_total)::decimal(18,2) as subtotal, count(*) as n_items,
    string_agg(description || ' ' || quantity || ' ' || unit_price || ' ' || item_total || chr(10), '' order by l_linenumber, l_partkey, quantity, description || ' ' || quantity || ' ' || unit_price || ' ' || item_total) as rows from items group by 1),
base as (select o.o_orderkey, n_name as nation, c_name as merchant, strftime(o_orderdate, '%Y-%m-%d') as date, coalesce(subtotal, 0)::decimal(18,2) as subtotal, coalesce(n_items, 0) as n_items, coalesce(rows, '') as rows
    from orders o join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey left join sums using (o_orderkey)),
taxed as (select *, round(subtotal * 0.07::decimal(3,2), 2)::decimal(18,2) as tax from base),
receipts as (select *, (subtotal + tax)::decimal(18,2) as total from taxed)"""
_CASES = """cases as (select event_type as language, 'd' || (user_id % 3) as degradation, 'sim' as backend, case when event_id % 11 = 0 then 'x' end as error, (event_id * 37 % 128) / 128.0 as cer, (event_id * 53 % 128) / 128.0 as wer,
    (event_id * 71 % 128) / 128.0 as normalized_edit_distance, case when event_id % 5 != 0 then event_id % 2 = 0 end as merchant_match, event_id % 3 = 0 as date_exact_match, event_id % 4 = 0 as total_exact_match, (event_id % 64)::double as elapsed_ms from events)"""
_MEASURES = """count(*) as n, count(error) as n_errors, round(avg(cer), 4) as mean_cer, round(avg(wer), 4) as mean_wer, round(avg(normalized_edit_distance), 4) as mean_ned, round(avg(merchant_match::double), 4) as merchant_rate,
    round(avg(date_exact_match::double), 4) as date_rate, round(avg(total_exact_match::double), 4) as total_rate, round(avg(elapsed_ms), 1) as mean_elapsed_ms"""
_MATRIX = "m(code, name, script, rtl, model_supported, receipt_verified, mandatory) as (values " + ", ".join(f"('{c}', '{n}', '{s}', {r}, {u}, {v}, {d})" for c, n, s, r, u, v, d, _ in matrix.rows()) + ")"
_VALUE = """case when t like '%,%' and t like '%.%' then try_cast(case when instr(reverse(t), '.') < instr(reverse(t), ',') then replace(t, ',', '') else replace(replace(t, '.', ''), ',', '.') end as double)
    when length(regexp_replace(t, '[^.,]', '', 'g')) = 1 then case when length(regexp_extract(t, '[.,]([^.,]*)$', 1)) = 3 then null when length(regexp_extract(t, '[.,]([^.,]*)$', 1)) in (1, 2, 4, 5, 6) then replace(t, ',', '.')::double else try_cast(t as double) end
    when t like '%,%' or t like '%.%' then case when regexp_full_match(t, '[^.,]*([.,][^.,]{3})+') then regexp_replace(t, '[.,]', '', 'g')::double end else t::double end"""


def _list(values) -> str:
    return "[" + ", ".join("'" + str(v).replace("'", "''") + "'" for v in values) + "]"


_GRAMS = "case when len(c) < 3 then [array_to_string(c, '')] else list_transform(range(1, len(c) - 1), lambda i: c[i] || c[i + 1] || c[i + 2]) end"
_PLAN = f"""select l.language, s.sample::int as sample, d.degradation, (('0x' || substr(sha256(l.language || ':' || s.sample), 1, 16))::ubigint % 1000000)::bigint + 7 as seed
    from (select unnest({_list(scoring.LANGUAGES)}) as language) l, range(4) s(sample), (select unnest({_list(scoring.DEGRADATIONS)}) as degradation) d"""
_CODE = "case code " + " ".join(f"when '{k}' then '{v}'" for k, v in scoring.TESSERACT.items()) + " else 'eng' end"
_PADDLE = "case code " + " ".join(f"when '{k}' then '{v}'" for k, v in scoring.PADDLE.items()) + " else code end"
_DAY_LINE = """case o_orderkey % 4 when 0 then strftime(o_orderdate, '%Y-%m-%d') when 1 then strftime(o_orderdate, '%d/%m/%Y') when 2 then strftime(o_orderdate, '%m/%d/%Y') else 'named' end"""

ORACLES = {
    "receipt_render": f"with {_RECEIPTS} select o_orderkey, merchant || chr(10) || nation || chr(10) || date || ' 14:35' || chr(10) || rows || 'SUBTOTAL ' || subtotal || chr(10) || 'TAX ' || tax || chr(10) || 'TOTAL ' || total || ' USD' as full_text, n_items::int as n_items from receipts",
    "totals_by_nation": f"with {_RECEIPTS} select nation, count(*) as n, count(*) as n_equal, round(sum(total)::double, 2) as extracted from receipts group by nation",
    "labeled_amounts": f"with {_RECEIPTS} select o_orderkey, subtotal::double as subtotal, tax::double as tax, total::double as total, 'ok' as status, (5 + n_items)::int as line, 'missing' as discount_status from receipts",
    "inferred_total": f"with {_RECEIPTS} select o_orderkey, 'inferred_field' as status, total::double as total, 0.6::double as confidence, (3 + n_items) || ',' || (4 + n_items) as evidence from receipts",
    "dates_times": """select o_orderkey, case when o_orderkey % 4 in (1, 2) and day(o_orderdate) <= 12 and day(o_orderdate) != month(o_orderdate) then 'uncertain' else 'ok' end as status,
        case when o_orderkey % 4 in (1, 2) and day(o_orderdate) <= 12 and day(o_orderdate) != month(o_orderdate) then null else strftime(o_orderdate, '%Y-%m-%d') end as date,
        case when o_orderkey % 4 in (1, 2) and day(o_orderdate) <= 12 and day(o_orderdate) != month(o_orderdate) then
            case when o_orderkey % 4 = 1 then strftime(o_orderdate, '%Y-%m-%d') || '|' || strftime(o_orderdate, '%Y-%d-%m') else strftime(o_orderdate, '%Y-%d-%m') || '|' || strftime(o_orderdate, '%Y-%m-%d') end end as candidates,
        case when o_orderkey % 2 = 0 then '14:05:00' else '09:07:30' end as time from orders""",
    "currency_vote": """with v(k, status, currency, n_lines) as (values (0, 'ok', 'USD', 2), (1, 'ok', 'EUR', 2), (2, 'ok', 'PKR', 1), (3, 'ok', 'AUD', 1), (4, 'uncertain', 'PKR|INR|LKR|NPR', 2), (5, 'ok', 'PKR', 2), (6, 'ok', 'AUD', 2), (7, 'ok', 'INR', 1))
        select o_orderkey, status, currency, n_lines::bigint as n_lines from orders join v on o_orderkey % 8 = k""",
    "merchant_payment_number": """select o_orderkey, 'R-' || o_orderkey as merchant, 'uncertain' as merchant_status, ['visa', 'cash', 'debit_card', 'cheque', null][1 + o_orderkey % 5] as payment, 'R-' || o_orderkey as number, 0.7::double as confidence from orders""",
    "line_items_exploded": f"""with {_RECEIPTS}, placed as (select i.*, row_number() over (partition by o_orderkey order by l_linenumber, l_partkey, quantity, description || ' ' || quantity || ' ' || unit_price || ' ' || item_total) + 2 as line from items i join orders using (o_orderkey)),
        heads as (select o_orderkey, 0 as line, merchant as t from receipts union all select o_orderkey, 1, nation from receipts)
        select o_orderkey, line::int as line, description, quantity::double as quantity, 'ok' as quantity_status, unit_price::double as unit_price, item_total::double as item_total, 'ok' as status from placed
        union all select o_orderkey, line::int, trim(regexp_extract(t, '^([^0-9]+)[0-9]', 1)), 1.0::double, 'inferred_field', null, regexp_extract(t, '([0-9]+)$', 1)::double, 'ok' from heads where regexp_matches(t, '^[^0-9]+[0-9]+$')""",
    "item_totals": f"with {_ITEMS} select 'uncertain' as status, 'inferred_field' as quantity_status, count(*) as n, round(sum(item_total + 1)::double, 2) as total, count(distinct (description, quantity, unit_price)) as n_named from items",
    "amount_tokens": f"""with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[0-9][0-9.,]*[0-9]|[0-9]') as tokens from documents), e as (select doc_id, {_VALUE} as v from (select doc_id, unnest(tokens) as t from d)),
        n as (select doc_id, count(*) - count(v) as n_ambiguous from e group by 1) select doc_id, len(tokens) as n_tokens, coalesce(n_ambiguous, 0) as n_ambiguous, sha256(array_to_string(tokens, ' ')) as tokens_sha256 from d left join n using (doc_id)""",
    "amount_parse": """with p as (select l_extendedprice::decimal(18,2) as p from lineitem) select form::int as form, count(*) as n, count(*) filter (form = 4) as n_ambiguous,
        count(*) filter (form in (0, 1, 2) or form = 3 or abs(p - 1234) < 0) as n_near from p, range(5) f(form) where form < 4 group by form union all select 4, count(*), count(*), 0 from p""",
    "line_stats": """with l as (select doc_id, generate_subscripts(ls, 1) as k, unnest(ls) as t from (select doc_id, string_split(coalesce(text, ''), chr(10)) as ls from documents)), w as (select *, lead(t) over (partition by doc_id order by k) as after from l)
        select doc_id, count(*) as n_lines, count(*) filter (length(t) = 0) as n_empty, max(length(t))::int as longest, count(*) filter (after = t) as n_twice from w group by doc_id""",
    "dominant_script": r"select page_id, case when regexp_matches(url, '\p{Latin}') then 'Latn' else '' end as scripts, case when url = '' then 0 else 1 end::bigint as n_runs, false as rtl from pages",
    "script_windows": """select n_nationkey, s as script, a::int as start, b::int as "end" from nation, lateral (values ('Latn', 0, 4 + length(n_name)), ('Hani', 4 + length(n_name), 8 + length(n_name))) v(s, a, b)""",
    "char_error_rate": """with j as (select a.p_partkey, a.p_name as r, b.p_name as h from part a join part b on a.p_partkey = b.p_partkey + 1)
        select p_partkey, round(levenshtein(r, h) / length(r)::double, 6) as cer, round(levenshtein(r, h) / greatest(length(r), length(h), 1)::double, 6) as ned,
        round(((split_part(r, ' ', 1) != split_part(h, ' ', 1))::int + (split_part(r, ' ', 2) != split_part(h, ' ', 2))::int) / 2.0::double, 6) as wer from j""",
    "fuzzy_names": """with t as (select distinct p_name as b from part), h as (select distinct substr(p_name, 1, (p_partkey % length(p_name))::int) || substr(p_name, (p_partkey % length(p_name))::int + 2) as a from part),
        near as (select a, b, levenshtein(a, b) as d from h, t where 1 - levenshtein(trim(a), trim(b)) / greatest(length(trim(a)), length(trim(b)), 1)::double >= 0.8)
        select a as name, count(*) as n_near, first(b order by d, b) as best from near group by a""",
    "fuzzy_names_whole": """with n as (select p_name as name, count(*) as n from part group by 1)
        select a.name, count(b.name) as n_near, coalesce(sum(b.n), 0)::bigint as n_rows from n a left join n b on a.name != b.name and 1 - levenshtein(lower(trim(a.name)), lower(trim(b.name))) / greatest(length(trim(a.name)), length(trim(b.name)), 1)::double >= 0.8 group by 1""",
    "words_to_lines": r"""with w as (select item_id, generate_subscripts(ws, 1) - 1 as k, unnest(ws) as t from (select item_id, regexp_split_to_array(text, '[ \n]') as ws from benchmark)), v as (select *, greatest((length(t) * 37) % 101 - 1, 0) / 100.0::double as c from w where trim(t) != '')
        select item_id as doc_id, (k // 8)::int as line_num, string_agg(t, ' ' order by k) as text, min(k % 8 * 60)::int as x, (k // 8 * 30)::int as y, (max(k % 8 * 60 + length(t) * 7) - min(k % 8 * 60))::int as width, 20 as height,
        round(avg(c), 6) as confidence, case when avg(c) >= 0.4 then 'ok' else 'uncertain' end as status, count(*) as n_words from v group by item_id, k // 24, k // 8""",
    "escalate_select": """with o as (select o_orderkey as k, o_orderkey % 4 as n1, (o_orderkey * 7) % 5 as n2, o_orderkey % 4 = 0 or (o_orderkey % 10) / 10.0 < 0.5 as again from orders), c as (select *, again and n2 > 0 and (n1 = 0 or n2 >= n1) as better from o)
        select k as doc_id, better as escalated, case when better then array_to_string(list_transform(range(1, n2 + 1), lambda i: 'b' || i), ',') else array_to_string(list_transform(range(1, n1 + 1), lambda i: 'a' || i), ',') end as text,
        case when better then 'auto mode escalated to a second, accurate-mode OCR pass' else 'w1' end as warnings from c""",
    "quality_gate": """with f as (select event_id, event_id * 37 % 300 < 100 as b, event_id * 53 % 90 < 40 as c, event_id * 71 % 256 < 60 or event_id * 71 % 256 > 225 as l from events),
        s as (select event_id, concat_ws(',', case when b then 'blurry' end, case when c then 'low_contrast' end, case when l then 'poorly_lit' end) as s from f)
        select event_id, case when s = '' then 'fast' else 'accurate' end as mode, case when s = '' then 'auto: no quality signals' else 'auto: quality signals=' || s end as reason from s""",
    "error_codes": """with e as (select page_id, ['unreadable', 'empty_file', 'file_too_large', 'unsupported_format', 'dimensions_too_large', 'decompression_bomb_suspected', null][1 + page_id % 7] as load_error from pages)
        select page_id, load_error, case when load_error = 'unsupported_format' then 'UNSUPPORTED_FORMAT' when load_error is not null then 'INVALID_IMAGE' end as code from e""",
    "reading_order_rows": "select l_orderkey, string_agg(l_linenumber::varchar, ',' order by l_linenumber // 2, l_linenumber % 2) as numbers from lineitem group by 1",
    "case_plan": _PLAN,
    "accuracy_breakdown": f"with {_CASES} select language, degradation, backend, {_MEASURES} from cases group by all",
    "accuracy_overall": f"with {_CASES} select {_MEASURES} from cases",
    "accuracy_grouping_sets": f"with {_CASES} select language, degradation, {_MEASURES} from cases group by grouping sets ((language), (degradation), ())",
    "score_cases": f"""with {_RECEIPTS} select o_orderkey as case_id, case when o_orderkey % 7 = 0 then 'OCR_FAILED' end as error, case when o_orderkey % 7 = 0 then 1.0 else 0.0 end::double as cer, case when o_orderkey % 7 = 0 then 1.0 else 0.0 end::double as wer,
        case when o_orderkey % 7 = 0 then 1.0 else 0.0 end::double as normalized_edit_distance, o_orderkey % 7 != 0 as merchant_match, o_orderkey % 7 != 0 as date_exact_match, o_orderkey % 7 != 0 as total_exact_match from receipts""",
    "backend_codes": f"with {_MATRIX} select code, {_CODE} || case when list_contains({_list(scoring.WITH_ENGLISH)}, code) then '+eng' else '' end as tesseract, {_PADDLE} as paddle from m",
    "matrix_filter": f"with {_MATRIX} select script, count(*) as n, count(*) filter (model_supported) as n_supported, count(*) filter (mandatory) as n_mandatory from m where model_supported group by 1",
    "matrix_sets": f"with {_MATRIX}, p as (select distinct lang as code from documents union select unnest(['en', 'ur'])) select code, case when code in (select code from p) then 'installed' else 'missing' end as state from m where mandatory",
    "top_languages": """with d as (select source, lang, count(*) as c from documents group by 1, 2), s as (select *, round(c / sum(c) over (partition by source), 4) as confidence, row_number() over (partition by source order by c desc, lang) as p from d)
        select source, string_agg(lang, ',' order by p) filter (q <= 2) as languages, greatest(count(*) - 2, 0) as more from (select *, row_number() over (partition by source order by p) as q from s where confidence >= 0.05) group by 1""",
    "row_overlaps": """with b as (select l_orderkey, (l_linenumber, l_partkey, l_suppkey, l_extendedprice) as id, l_linenumber as k, l_partkey % 90 * 1.0::double as y, l_linenumber % 4 * 15.0::double as h from lineitem)
        select l_orderkey, count(*) as n, sum(a.k * 10 + c.k)::bigint as numbers from b a join b c using (l_orderkey) where a.id < c.id and least(a.y + a.h, c.y + c.h) - greatest(a.y, c.y) > 0.5 * case when least(a.h, c.h) = 0 then 1.0 else least(a.h, c.h) end group by l_orderkey""",
    "result_json": f"""with {_RECEIPTS}, t as (select *, merchant || chr(10) || nation || chr(10) || date || ' 14:35' || chr(10) || rows || 'SUBTOTAL ' || subtotal || chr(10) || 'TAX ' || tax || chr(10) || 'TOTAL ' || total || ' USD' as full_text from receipts)
        select o_orderkey as doc_id, 'schema_version,engine,engine_version,mode,image,processing_time_ms,languages,scripts,full_text,text_lines,warnings,fields' as keys, sha256(full_text) as full_text_sha256, 6 + n_items as n_lines, 60.0::double as y, 'Latn' as first_script, null::varchar as date_script,
        'Latn' as script, total::double as total, 'ok' as total_status, (5 + n_items)::int as total_line, date, null::varchar as discounts, merchant, 'auto' as mode from t""",
    "envelope_problems": """select o_orderkey || case when o_orderkey % 6 = 5 then '-error' else '' end as name, case o_orderkey % 6 when 1 then 'mode' when 2 then 'text_lines' when 3 then 'json' when 4 then 'schema_version' when 5 then case when o_orderkey % 4 = 1 then '' else 'message' end else '' end as problems from orders""",
    "image_headers": """with p as (select p_partkey, (p_partkey * 37) % 30000 as w, p_size * 200 as h, ['PNG', 'BMP', 'JPEG', 'TIFF', 'WEBP', 'GIF', null][1 + p_partkey % 7] as format from part),
        q as (select p_partkey, format, case when format = 'WEBP' then greatest(w, 1) when format is not null then w end::bigint as width, case when format is not null then h end::bigint as height from p)
        select *, case when format is null then 'decode_failed' when format = 'GIF' then 'unsupported_format' when width <= 0 or height <= 0 then 'decode_failed' when width > 20000 or height > 20000 then 'dimensions_too_large' when width * height > 64000000 then 'decompression_bomb_suspected' end as error from q""",
    "document_scripts": r"""with t as (select doc_id, coalesce(text, '') as text from documents) select doc_id, case when regexp_matches(text, '\p{Latin}') then 'Latn' else '' end as scripts, case when text = '' then 0 else 1 end::bigint as n_runs, case when text != '' then length(text) end::int as first_end, false as rtl from t""",
    "keyword_lines": f"""with l as (select doc_id, lower(t) as t, k - 1 as i from (select doc_id, unnest(ls) as t, generate_subscripts(ls, 1) as k from (select doc_id, string_split(text, chr(10)) as ls from documents))),
        m as (select doc_id, i, {" or ".join(f"contains(t, '{w}')" for w in keywords.TOTAL + keywords.TAX + keywords.DISCOUNT)} as hit, contains(t, 'licen') or contains(t, 'password') or contains(t, 'token') as word from l)
        select d.doc_id, count(i) filter (hit) as n_lines, min(i) filter (hit)::int as first_line, coalesce(string_agg(i::varchar, ',' order by i) filter (hit), '') as lines, min(i) filter (word)::int as first_word from documents d left join m using (doc_id) group by d.doc_id""",
    "dedup_first": """with l as (select doc_id, unnest(ls) as t, generate_subscripts(ls, 1) as k from (select doc_id, string_split(coalesce(text, ''), chr(10)) as ls from documents)), f as (select doc_id, t, min(k) as k from l group by doc_id, t)
        select doc_id, count(*) as n_lines, sha256(string_agg(t, chr(10) order by k)) as lines_sha256 from f group by doc_id""",
    "document_languages": f"""with d as (select lang, regexp_extract_all(lower(text), '(?s).') as c from documents where lang is not null and text is not null), g as (select lang, unnest({_GRAMS}) as gram from d),
        n as (select gram, lang, count(*) as c from g group by all), k as (select * from n qualify sum(c) over (partition by gram) >= 3), totals as (select lang, sum(c) as n from k group by lang), size as (select count(distinct gram) as z from k),
        l as (select conv_id, turn, regexp_extract_all(lower(t), '(?s).') as c from (select conv_id, turn, regexp_replace(text, '^\\s+|\\s+$', '', 'g') as t from conversations) where length(t) >= 8),
        lg as (select conv_id, turn, gram, count(*) as m from (select conv_id, turn, unnest({_GRAMS}) as gram from l) group by all),
        s as (select conv_id, turn, t.lang, sum(m * (ln(coalesce(k.c, 0) + 1) - ln(t.n + z))) as s from lg join (select distinct gram from k) using (gram) cross join totals t cross join size left join k on k.gram = lg.gram and k.lang = t.lang group by all),
        e as (select *, exp(s - max(s) over (partition by conv_id, turn)) as e from s), p as (select conv_id, lang, e / sum(e) over (partition by conv_id, turn) as p from e), q as (select conv_id, lang as code, sum(p) as p from p group by all)
        select conv_id, code, round(p / sum(p) over (partition by conv_id), 4) as confidence, row_number() over (partition by conv_id order by p desc, code)::int as position from q""",
}
