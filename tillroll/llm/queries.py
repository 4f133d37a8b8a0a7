"""Queries of the corpus operators over the driver's tables, and DuckDB SQL for those that it can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.llm import bpe, decontaminate, license_scan, quality_gam, quality_rules, secret_scan, simhash, suffix_dedup, url_filter, warc
from tillroll.llm.licenses import KNOWN, notices

#: Fixed values of the URL query.
URL_RULES = [url_filter.Rule.parse(*r) for r in (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan_secrets(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda x: x["base"])
    n = lambda k: F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", n("assign"), n("access"), n("hex"), F.sha2(secret_scan.spans_text(base), 256).alias("base_sha256"), secret_scan.spans_text(F.col("spans")).alias("spans"), "n_live", "n_copied")


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(table(spark, sf_dir, "pages")).select(F.col("source").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to", "verified")


def op4_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_gam.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.clean_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_failed_lines", "lost_chars")


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(table(spark, sf_dir, "documents"), license_scan.known_digests(spark))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.encode_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), ["doc_id"])


QUERIES = {f.__name__: f for f in (op1_secret_scan, op2_url_filter, op3_warc, op4_quality_gam, op5_decontaminate, op6_simhash, op7_suffix_dedup, op8_quality_rules, op9_license_scan, op10_bpe)}


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _secrets_sql() -> str:
    def spans(kind: str, rank: int) -> str:
        _, pattern, group, least, base = secret_scan.KINDS[rank]
        p = _quoted(pattern.replace(r"(?=[PpSsTtAa])", ""))
        least = f"length(value) >= {least}"
        if kind in secret_scan.MIXED:
            least += f" and length(regexp_replace(value, '[^0-9]', '', 'g')) >= {secret_scan.DIGITS} and regexp_matches(value, '[A-Za-z]')"
        if kind in secret_scan.PLAIN_HEX:
            least += " and not regexp_full_match(value, '[0-9a-f]+')"
        return f"""
        select doc_id, source, {rank} as rank, '{kind}' as kind, {str(base).lower()} as base, value,
               (list_sum(gaps[1:k]) + coalesce(list_sum(ns[1:k - 1]), 0))::int as start, (list_sum(gaps[1:k]) + list_sum(ns[1:k]))::int as stop
        from (select doc_id, source, unnest(range(1, len(ms) + 1)) as k, unnest(vs) as value, list_transform(ms, lambda x: length(x)) as ns, list_transform(gs, lambda x: length(x)) as gaps
              from (select doc_id, source, regexp_extract_all(coalesce(text, ''), {p}) as ms, regexp_extract_all(coalesce(text, ''), {p}, {group}) as vs, string_split_regex(coalesce(text, ''), {p}) as gs
                    from documents where regexp_matches(coalesce(text, ''), {p})))
        where {least}"""

    each = " union all ".join(spans(k[0], i) for i, k in enumerate(secret_scan.KINDS))
    listed = lambda cond: f"coalesce(string_agg(kind || ':' || start || ':' || stop, ',' order by start, rank, stop) filter ({cond}), '')"
    return f"""
    with hits as ({each}),
    stats as (select value, count(distinct coalesce(source, '')) as n_owners from hits group by value),
    judged as (select h.*, n_owners <= 2 as live from hits h join stats using (value))
    select d.doc_id, count(*) filter (kind = 'assign') as n_assign, count(*) filter (kind = 'access') as n_access, count(*) filter (kind = 'hex') as n_hex,
           sha256({listed("base")}) as base_sha256, {listed("base or live")} as spans,
           count(distinct value) filter (live) as n_live, count(distinct value) filter (not live) as n_copied
    from documents d left join judged j using (doc_id) group by d.doc_id"""


def _urls_sql() -> str:
    rules = ", ".join(f"('{r.verdict}', '{r.host}', '{r.path}')" for r in URL_RULES)
    return rf"""
    with rules(r_verdict, r_host, r_path) as (values {rules}),
    parts as (select page_id, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as rest from pages),
    split as (select page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from parts),
    fits as (select page_id, r_host || r_path as rule, r_verdict, row_number() over (partition by page_id order by length(r_host) desc, length(r_path) desc) as k
             from split join rules on (host = r_host or ends_with(host, '.' || r_host)) and starts_with(path, r_path))
    select page_id, host, path, rule, coalesce(r_verdict, 'allow') as verdict from split left join (select * from fits where k = 1) using (page_id)"""


def _warc_sql() -> str:
    return """
    with p as (select page_id, strlen(coalesce(html, '')) as payload_bytes, sha256(coalesce(html, '')) as payload_digest from pages),
    r as (select *, min(page_id) over (partition by payload_digest) as first from p)
    select page_id, payload_bytes, payload_digest, case when payload_bytes >= 100 and first < page_id then 'revisit' else 'response' end as record_type,
           case when payload_bytes >= 100 and first < page_id then first end as refers_to, true as verified from r"""


def _overlaps_sql() -> str:
    def words(x: str) -> str:
        return rf"regexp_extract_all(translate(coalesce({x}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

    return f"""
    with d as (select doc_id, {words("text")} as w from documents),
    b as (select item_id, w, least(len(w), 10) as span from (select item_id, {words("text")} as w from benchmark) where len(w) > 0),
    wins as (select distinct item_id, span, w[i:i + span - 1] as g from (select item_id, w, span, unnest(range(1, len(w) - span + 2)) as i from b)),
    spans as (select distinct span from b),
    grams as (select doc_id, span, i, w[i:i + span - 1] as g from (select doc_id, w, span, unnest(range(1, len(w) - span + 2)) as i from d, spans where len(w) >= span)),
    hits as (select doc_id, i, h.span, item_id from grams h join wins using (span, g)),
    n_hit as (select doc_id, count(distinct p) as n from (select doc_id, unnest(range(i, i + span)) as p from hits) group by doc_id),
    found as (select doc_id, count(distinct item_id) as n, string_agg(distinct item_id::varchar, ',' order by item_id::varchar) as items from hits group by doc_id)
    select d.doc_id, len(w) as n_words, coalesce(n_hit.n, 0) as n_hit, coalesce(found.n, 0) as n_items, sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit.n, 0) > 0 as contaminated
    from d left join n_hit using (doc_id) left join found using (doc_id)"""


def _quality_rules_sql() -> str:
    word, blank = r"[^\x20\x09-\x0D]+", r"[\x20\x09-\x0D]+"
    ends, signs = _quoted(quality_rules.ENDS), _quoted(quality_rules.SIGNS)
    furniture, menu = _quoted(quality_rules.FURNITURE), _quoted(quality_rules.MENU_LINE)
    return rf"""
    with t as (select doc_id, coalesce(text, '') as text from documents),
    w as (select doc_id, regexp_extract_all(text, '{word}') as words from t),
    grams as (select doc_id, i, (words[i], words[i + 1], words[i + 2]) as g from (select doc_id, words, unnest(range(1, len(words) - 1)) as i from w where len(words) >= 3)),
    twice as (select doc_id, g from grams group by doc_id, g having count(*) > 1),
    covered as (select doc_id, count(distinct i + o) as n_repeat_words from (select doc_id, i from grams join twice using (doc_id, g)), (values (0), (1), (2)) as v(o) group by doc_id),
    lines as (select doc_id, unnest(ls) as line, generate_subscripts(ls, 1) as k from (select doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{word}')) as ls from t)),
    facts as (select doc_id, line, k, len(regexp_extract_all(line, '{word}')) as n, len(regexp_extract_all(line, '[#*$%&|<>»«›‹→←•·]')) as s, len(regexp_extract_all(line || ' ', '[!?]{{2,}}{blank}')) as b,
                     length(regexp_replace(line, '{blank}', '', 'g')) as c, regexp_matches(line, {ends}) as e, regexp_matches(line, {signs}) as sign, regexp_matches(lower(line), {menu}) as menu, regexp_matches(lower(line), {furniture}) as f from lines),
    openings as (select *, n < 5 and not e as o from facts),
    runs as (select *, sum(o::int) over (partition by doc_id order by k rows between 2 preceding and current row) as r0, sum(o::int) over (partition by doc_id order by k rows between 1 preceding and 1 following) as r1,
                    sum(o::int) over (partition by doc_id order by k rows between current row and 2 following) as r2 from openings),
    judged as (select *, (n >= 5 and (not e or s > 0.3 * n or b > 0.3 * n)) or (o and (sign or menu or r0 = 3 or r1 = 3 or r2 = 3)) or (n <= 12 and f) as bad from runs),
    per_doc as (select doc_id, count(*) - count(distinct line) as n_dup_lines, count(*) filter (bad) as n_failed_lines, coalesce(sum(c) filter (bad), 0)::bigint as lost_chars from judged group by doc_id),
    base as (select t.doc_id, len(words) as n_words, length(regexp_replace(text, '{blank}', '', 'g')) as word_chars, length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) as n_symbols,
                    coalesce(n_dup_lines, 0) as n_dup_lines, coalesce(n_repeat_words, 0) as n_repeat_words, coalesce(n_failed_lines, 0) as n_failed_lines, coalesce(lost_chars, 0) as lost_chars
             from t join w using (doc_id) left join covered using (doc_id) left join per_doc using (doc_id))
    select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed, not (n_words < 50 or 100 * n_repeat_words > 50 * n_words) and lost_chars <= 0.5 * word_chars as kept from base"""


def _licenses_sql() -> str:
    def canonical(x: str) -> str:
        cut = x = f"lower({x})"
        for pattern, by in license_scan.CUTS:
            cut = f"regexp_replace({cut}, {_quoted(pattern)}, {_quoted(by.format(chr(92) + '1'))}, 'g')"
        x = f"case when regexp_matches({x}, {_quoted(license_scan.HAS_NOTICE)}) then {cut} else {x} end"
        for a, b in license_scan.SPELLINGS:
            x = f"replace({x}, {_quoted(a)}, {_quoted(b)})"
        return rf"trim(regexp_replace({x}, '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"

    def digests(listed: list[tuple[str, str]]) -> str:
        values = ", ".join(f"({_quoted(n)}, {_quoted(b)})" for n, b in listed)
        return f"(select sha256({canonical('body')}) as digest, min(license) as license from (values {values}) as k(license, body) group by 1)"

    return f"""
    with known as {digests(KNOWN)}, listed as {digests(notices())},
    whole as (select doc_id, digest as text_digest, license as whole_license from (select doc_id, sha256({canonical("coalesce(text, '')")}) as digest from documents) left join known using (digest)),
    lines as (select doc_id, license from (select doc_id, sha256({canonical("line")}) as digest from (select doc_id, unnest(string_split(text, chr(10))) as line from documents) where regexp_matches(line, {_quoted(license_scan.SPEAKS)})) join listed using (digest)),
    found as (select doc_id, string_agg(distinct license, ',' order by license) as notice_licenses, count(*) as n_lines from lines group by doc_id),
    every as (select doc_id, string_agg(distinct license, ',' order by license) as licenses from (select doc_id, license from lines union all select doc_id, whole_license from whole where whole_license is not null) group by doc_id)
    select doc_id, text_digest, whole_license, notice_licenses, licenses, coalesce(n_lines, 0) as n_lines from whole left join found using (doc_id) left join every using (doc_id)"""


ORACLES = {"op1_secret_scan": _secrets_sql(), "op2_url_filter": _urls_sql(), "op3_warc": _warc_sql(), "op5_decontaminate": _overlaps_sql(), "op8_quality_rules": _quality_rules_sql(), "op9_license_scan": _licenses_sql()}
