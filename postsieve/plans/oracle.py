"""DuckDB SQL with the expected rows of the registered queries.

Written from the operator rules, independently of the Spark expressions.
"""

from __future__ import annotations

from postsieve.functions.extract import SKILLS
from postsieve.functions.scoring import GOOD_SKILLS, JUNIOR_WORDS, PREMIUM_SKILLS, SENIOR_WORDS

SP = r"\s\x0b\x1c-\x1f\x85\p{Z}"
AS_OF = "timestamp '2001-07-01 12:00:00'"
CUT = "timestamp '2001-06-01 00:00:00'"
EV_AS_OF = "timestamp '2024-01-30 12:00:00'"


def _list(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in sorted(words)) + "]"


def _strip(x: str) -> str:
    return rf"regexp_replace({x}, '^[{SP}]+|[{SP}]+$', '', 'g')"


def _time(x: str) -> str:
    return f"strftime({x}, '%Y-%m-%d %H:%M:%S')"


def _micros(x: str) -> str:
    return f"strftime({x}, '%Y-%m-%d %H:%M:%S.%f')"


def _dedup_hash(t: str, c: str, l: str) -> str:
    parts = " || '|' || ".join(_strip(f"lower({x})") for x in (t, c, l))
    return f"sha256({parts})"


def _can_hash(t: str = "title", c: str = "company", l: str = "location") -> str:
    return f"sha256(lower({t}) || '|' || lower({c}) || '|' || lower({l}))"


def _amount(x: str) -> str:
    v = f"try_cast(replace({x}, ',', '') as integer)"
    return f"case when {v} < 1000 then {v} * 1000 else {v} end"


SALARY = rf"(?i)\$([\d,]+)k?(?:[{SP}]*[-–—to]+[{SP}]*\$?([\d,]+)k?)?"
POLICY = r"(?i)(?:^|[^\p{L}\p{N}_])(fully remote|remote-first|remote|hybrid|onsite|in-office|in office)(?:[^\p{L}\p{N}_]|$)"
COMPANY = rf"(?i)(?:at|@|company:?)[{SP}]+([A-Z][a-zA-Z0-9{SP}&,\.]+)"


def _low(x: str) -> str:
    return _amount(f"regexp_extract({x}, '{SALARY}', 1)")


def _high(x: str) -> str:
    return _amount(f"regexp_extract({x}, '{SALARY}', 2)")


def _phrase(x: str) -> str:
    return f"nullif(lower(regexp_extract({x}, '{POLICY}', 1)), '')"


def _tech(x: str) -> str:
    return f"list_filter({_list(SKILLS)}, lambda w: contains(lower({x}), w))"


def _policy(x: str) -> str:
    return f"""case when {x} is null then 'unknown'
      when contains(lower({x}), 'hybrid') then 'hybrid' when contains(lower({x}), 'remote') then 'remote'
      when contains(lower({x}), 'onsite') or contains(lower({x}), 'office') or contains(lower({x}), 'in-person')
        or contains(lower({x}), 'in person') then 'onsite' else 'unknown' end"""


def _currency(x: str) -> str:
    v = f"upper(trim(coalesce({x}, '')))"
    return f"case when length({v}) = 3 then {v} else 'USD' end"


def _any(x: str, words) -> str:
    return f"len(list_filter({_list(words)}, lambda w: contains(lower({x}), w))) > 0"


CERTS = """map {'cissp': 'CISSP', 'security+': 'CompTIA Security+', 'sec+': 'CompTIA Security+', 'ceh': 'CEH',
  'cism': 'CISM', 'cisa': 'CISA', 'oscp': 'OSCP', 'gcih': 'GCIH', 'aws certified security': 'AWS Certified Security'}"""


def _certs(x: str) -> str:
    kept = f"list_filter(list_transform({x}, lambda c: trim(c)), lambda c: c <> '')"
    return f"list_sort(list_distinct(list_transform({kept}, lambda c: coalesce({CERTS}[lower(c)], c))))"


def _cleaned(x: str) -> str:
    return f"list_filter(list_transform({x}, lambda t: lower(trim(t))), lambda t: t <> '')"


def _csv(x: str) -> str:
    return f"array_to_string({x}, ',')"


POSTINGS = """postings as (
  select k, 'o_' || k as external_id, title, company, location, cast(1 + k % 4 as integer) as source_tier,
    'src' || (k % 12) as source_name, 'https://jobs.example.com/' || k as url,
    title || ' at ' || company || ' ' || sal || ' ' || pol || ' ' || tech as raw_text,
    dt + to_seconds(k % 86400) as ingested_at,
    cast(case when k % 8 = 7 then null else k % 8 end as integer) as yoe
  from (select o_orderkey k, c_name company, n_name location, o_orderdate dt,
    (case o_orderkey % 5 when 0 then 'Senior ' when 1 then 'Junior ' when 2 then '' when 3 then 'Lead '
       else 'Associate ' end) ||
    (case o_orderkey % 4 when 0 then 'SOC Analyst' when 1 then 'Security Engineer' when 2 then 'Backend Developer'
       else 'Network Architect' end) title,
    case o_orderkey % 7 when 0 then '$120,000 - $180,000 USD' when 1 then '$120k - $160k' when 2 then '$95k to $110k'
      when 3 then 'competitive pay' when 4 then '$50/hr' when 5 then '€70,000' else '$155,000' end sal,
    case o_orderkey % 6 when 0 then 'Fully Remote' when 1 then 'Hybrid 2 days' when 2 then 'onsite'
      when 3 then 'in-office' when 4 then 'remote-first' else 'flexible' end pol,
    case o_orderkey % 3 when 0 then 'CISSP, SIEM and Python' when 1 then 'cloud security, AWS, Kubernetes'
      else 'JavaScript, storage, Google Docs' end tech
    from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey))"""

JOBS = f"""{POSTINGS}, facts as (
  select *, external_id as id, {_low('raw_text')} as salary_min, {_high('raw_text')} as salary_max,
    {_policy(_phrase('raw_text'))} as remote_policy, {_tech('raw_text')} as tech_stack, {_can_hash()} as canonical_hash
  from postings), jobs as (
  select *, score = 100 as is_dream from (select *,
    case when lower(trim(company)) in ('customer#000000050', 'customer#000000101') then 100
    else least(99, cast(trunc((50
      + case when yoe <= 2 then 50 when yoe >= 5 then -80 else 0 end
      + case remote_policy when 'remote' then 20 when 'hybrid' then 8 else 0 end
      + case when salary_min >= 150000 then 15 when salary_min >= 100000 then 8 else 0 end
      + case when list_has_any(tech_stack, {_list(PREMIUM_SKILLS)}) then 15
             when list_has_any(tech_stack, {_list(GOOD_SKILLS)}) then 8 else 0 end)
      * (case when {_any('title', SENIOR_WORDS)} then 0.1::double when {_any('title', JUNIOR_WORDS)} then 2.0::double
              else 1.0::double end)) as integer)) end as score from facts))"""

ALERTS = """alerts as (select case when o_orderkey = 0 then 'gone' else 'o_' || o_orderkey end as job_id
  from orders where o_orderkey % 9 = 0)"""

SOURCES = """sources as (select 'src' || n_nationkey as name, cast(1 + n_nationkey % 4 as integer) as tier,
  cast(n_nationkey % 5 as bigint) as consecutive_failures, cast(n_nationkey * 10 as bigint) as total_scraped,
  n_nationkey % 3 = 0 as is_stale, cast(null as varchar) as url, cast(null as varchar) as error_message
  from nation where n_nationkey <= 13)"""

DEDUP = _dedup_hash("title", "company", "location")
SEEN = f"""seen as (
  select 'ext' as kind, source_tier || ':' || external_id as key, ingested_at as marked_at,
    ingested_at + interval 30 days as expires_at from postings where ingested_at < {CUT}
  union all select 'can', {DEDUP}, ingested_at, ingested_at + interval 60 days from postings where ingested_at < {CUT})"""
INCOMING = f"incoming as (select * from postings where ingested_at >= {CUT} or k % 7 = 3)"
EXT_LIVE = f"source_tier || ':' || external_id in (select key from seen where kind = 'ext' and expires_at > {CUT})"
CAN_LIVE = f"{DEDUP} in (select key from seen where kind = 'can' and expires_at > {CUT})"


def _first(rows: str, by: str, order: str) -> str:
    return f"(select * exclude (rn) from (select *, row_number() over (partition by {by} order by {order}) rn from {rows}) where rn = 1)"


QUEUE = """(select * from jobs where score >= {s} and id not in (select job_id from alerts)
  order by score desc, ingested_at desc, id limit {n})"""
DAY_START = "timestamp '2001-06-30 18:30:00'"
DAY_MATCHES = f"""(select * from jobs where score >= {{s}} and ingested_at >= {DAY_START}
  and ingested_at < {DAY_START} + interval 1 day and id not in (select job_id from alerts))"""

MONEY = "'$' || format('{:,}', %s)"
SALARY_TEXT = f"""case when coalesce(salary_min, 0) = 0 then '💰 Not disclosed' else '💰 ' || {MONEY % 'salary_min'}
  || case when coalesce(salary_max, 0) = 0 then '' else ' – ' || {MONEY % 'salary_max'} end || ' USD'
  || case when k % 3 = 0 then ' / yearly' else '' end end"""
TECH_TEXT = """case when len(tech_stack) = 0 and k % 3 <> 0 then '🔧 Not specified' else
  case when len(tech_stack) > 0 then '🔧 ' || array_to_string(tech_stack, ' · ') else '' end
  || case when len(tech_stack) > 0 and k % 3 = 0 then chr(10) else '' end
  || case when k % 3 = 0 then '📜 Req: CISSP' else '' end end"""
ALERT_TEXT = f"""case when score >= 90 then '🔥' else '✅' end || ' <b>'
  || case when is_dream then '⭐ DREAM COMPANY! ' else '' end || 'NEW JOB ALERT</b>' || chr(10) || chr(10)
  || '🏢 <b>' || company || '</b>' || chr(10) || '💼 ' || title || chr(10)
  || case remote_policy when 'remote' then '🏠 Remote' when 'hybrid' then '🔄 Hybrid' when 'onsite' then '🏢 Onsite'
     else '📍 Unknown' end || ' | ' || location || chr(10) || {SALARY_TEXT} || chr(10) || {TECH_TEXT} || chr(10)
  || '📊 Score: <b>' || score || '/100</b>' || chr(10) || chr(10)
  || '🔗 <a href="' || url || '">Apply Now</a>' || chr(10) || chr(10)
  || '<i>Tier ' || source_tier || ' | ' || source_name || ' | ' || strftime(ingested_at, '%H:%M') || ' UTC</i>'"""

MESSAGES = "messages as (select 'channel_' || role as channel, conv_id * 1000 + turn as msg_id, text from conversations)"
HAS_COMPANY = f"(contains(text, '@') or contains(lower(text), 'company:') or regexp_matches(text, '{COMPANY}'))"
HAS_SALARY = r"(regexp_matches({x}, '(?i)\$[\d,]+k?') or regexp_matches({x}, '(?i)\d+k'))"
WORTH = f"length(text) >= 30 and ({HAS_COMPANY} or {HAS_SALARY.format(x='text')})"
COMPANY_OF = _strip(f"regexp_extract(text, '{COMPANY}', 1)")


def _payload() -> str:
    return """payloads as (select *, '{"title":"' || title || '","currency":"'
  || case k % 6 when 0 then 'usd' when 1 then 'EUR ' when 2 then ' us dollars' when 3 then '' when 4 then 'gbp' else 'USD' end || '"'
  || case k % 5 when 0 then ',"remote_policy":"Fully Remote"' when 1 then ',"remote_policy":"HYBRID 3 days"'
       when 2 then ',"remote_policy":"In-Office"' when 3 then ',"remote_policy":""' else ',"remote_policy":"unknown"' end
  || case k % 11 when 0 then ',"salary_min":-5' when 1 then ',"salary_min":"90000"' when 2 then ',"salary_min":null'
       when 3 then ',"salary_min":0' when 4 then ',"salary_min":120000.0' when 5 then ',"salary_min":"lots"' else '' end
  || case k % 7 when 0 then ',"tech_stack":[]' when 1 then ',"tech_stack":[" Rust ","GO",""]' when 2 then ',"tech_stack":null'
       when 3 then ',"tech_stack":["a",7]' else '' end
  || case k % 4 when 0 then ',"certifications_required":["sec+"," CISSP ","","Own Cert","cissp"]'
       when 1 then ',"certifications_required":[]' when 2 then '' else ',"certifications_required":["CEH","ceh "]' end
  || case when k % 29 = 0 then '' else '}' end as payload from postings)"""


# fields of the decoded payload: j is the object, or an empty one where it is broken
DECODED = f"""{POSTINGS}, {_payload()}, decoded as (
  select *, json_valid(payload) as sound, case when json_valid(payload) then payload::json else '{{}}'::json end as j,
    {_low('raw_text')} as h_min, {_phrase('raw_text')} as h_policy, {_tech('raw_text')} as h_tech from payloads),
fields as (select *,
  json_type(j, '$.salary_min') as st, json_extract_string(j, '$.salary_min') as sv,
  json_type(j, '$.tech_stack') as tt, j->'$.tech_stack' as tv,
  json_extract_string(j, '$.remote_policy') as pv,
  coalesce(cast(j->'$.certifications_required' as varchar[]), []) as cv from decoded),
typed as (select *,
  try_cast(regexp_replace(sv, '\\.0*$', '') as integer) as s_num,
  st is null or st = 'NULL' or coalesce(try_cast(regexp_replace(sv, '\\.0*$', '') as integer) >= 0, false) as s_ok,
  st is null or st = 'NULL' or sv in ('0', '0.0', '') as s_silent,
  tt is null or (tt = 'ARRAY' and len(list_filter(cast(tv as json[]), lambda x: json_type(x) <> 'VARCHAR')) = 0) as t_ok,
  tt is null or tt = 'NULL' or cast(tv as varchar) = '[]' as t_silent,
  case when tt = 'ARRAY' then cast(tv as varchar[]) else [] end as t_val from fields)"""


def _parsed(valid: str, num: str, policy: str, tech: str) -> str:
    def when_valid(x: str) -> str:
        return f"case when {valid} then {x} end"

    return f"""{when_valid("coalesce(json_extract_string(j, '$.title'), '')")} as title,
  ({when_valid(num)})::varchar as salary_min, {when_valid(_currency("json_extract_string(j, '$.currency')"))} as currency,
  {when_valid(_policy(policy))} as policy, {when_valid(_csv(_cleaned(tech)))} as tech,
  {when_valid(_csv(_certs('cv')))} as certs"""


MERGED_NUM = "case when s_silent and coalesce(h_min, 0) <> 0 then h_min else s_num end"
MERGED_POLICY = "(case when coalesce(pv, '') = '' and h_policy is not null then h_policy else pv end)"
MERGED_TECH = "(case when t_silent and len(h_tech) > 0 then h_tech else t_val end)"
MERGED_OK = (
    "(sound and (s_ok or (s_silent and coalesce(h_min, 0) <> 0)) and (t_ok or (t_silent and len(h_tech) > 0)))"
)

BUCKET = "('0x' || substr(md5(doc_id::varchar), 1, 8))::bigint % 64"
CHUNKS = f"""chunks as (select doc_id, text, bucket, n // 20 as batch_no, n % 20 as pos from (
  select *, row_number() over (partition by bucket order by doc_id) - 1 as n
  from (select doc_id, text, {BUCKET} as bucket from documents)))"""

LANDED = """landed as (select page_id, url, html, case when page_id % 2 = 0 then 'feed' else 'sitemap' end as kind,
  case when page_id % 3 <> 0 then md5(html) end as etag,
  case when page_id % 5 = 0 then '' else 'day ' || (page_id % 20) end as last_modified from pages)"""
MANIFEST = f"""manifest as (select md5(url) as url_key, case when page_id % 7 = 0 then 'old' else etag end as etag,
  case when page_id % 11 = 0 then 'old' else last_modified end as last_modified,
  case when page_id % 13 = 0 then timestamp '2024-01-29' else timestamp '2024-01-31' end as expires_at
  from {_first('landed', 'url', 'page_id')} where page_id % 4 <> 0)"""

OUTCOMES = """outcomes as (select 'src' || (user_id % 20) as source, cast(1 + user_id % 20 % 4 as integer) as tier, ts,
  event_type = 'view' as ok, event_id % 7 as n_jobs, props as message from events)"""


def _totals(where: str = "true") -> str:
    return f"""{OUTCOMES}, log as (select * from outcomes where {where}), last_ok as (
  select source, max(ts) filter (ok) as ok_at from log group by source), totals as (
  select source, any_value(tier) as tier, max(ts) filter (ok) as success_at, max(ts) filter (not ok) as failure_at,
    coalesce(sum(n_jobs) filter (ok), 0)::bigint as scraped,
    count(*) filter (not ok and (ok_at is null or ts > ok_at)) as streak,
    (arg_max(message, (ts, message)) filter (not ok and (ok_at is null or ts > ok_at))) as error_message
  from log join last_ok using (source) group by source)"""


def _updated(where: str = "true") -> str:
    return f"""{SOURCES}, {_totals(where)}, updated as (select coalesce(s.name, t.source) as name,
  coalesce(s.tier, t.tier) as tier, success_at,
  case when success_at is not null then streak
       else coalesce(consecutive_failures, 0) + coalesce(streak, 0) end as consecutive_failures,
  coalesce(total_scraped, 0) + coalesce(scraped, 0) as total_scraped,
  case when success_at is not null then false else coalesce(is_stale, false) end as is_stale,
  case when streak is not null then t.error_message else s.error_message end as error_message
  from sources s full join totals t on s.name = t.source)"""


def _chain(rows: str, key: str, ts: str, row: str, ttl: str) -> str:
    """Accepted rows of fixed windows per key, one hop per recursion step."""
    return f"""e as (select {key} as k_, {ts} as t_, {row} as i_ from {rows}),
acc as (select k_, t_, i_ from {_first('e', 'k_', 't_, i_')}
  union all select k_, t_, i_ from (select e.k_, e.t_, e.i_,
    row_number() over (partition by e.k_ order by e.t_, e.i_) as rn
    from acc join e on e.k_ = acc.k_ and e.t_ >= acc.t_ + interval {ttl}) where rn = 1)"""


def _links(pattern: str) -> str:
    return f"regexp_extract_all(html, '{pattern}', 1)"


def _cards(tag: str) -> str:
    return rf"(?is)<{tag}(?:\s[^>]*)?>(.*?)</{tag}\s*>"


# a paragraph ends where the next one starts
PARAGRAPH = r"(?is)<p(?:\s[^>]*)?>(.*?)(?:</?p[\s>]|$)"


def _inner(pattern: str) -> str:
    return _strip(f"regexp_replace(regexp_extract(card, '{pattern}', 1), '<[^>]+>', '', 'g')")


LINKS = rf"""links as (select page_id, link, pos,
  coalesce(({_links('<h1[^>]*>([^<]+)</h1>')})[pos], '') as t, html as body,
  coalesce(({_links('<b[^>]*>([^<]+)<')})[pos], '') as c from (
    select page_id, html, unnest(ls) as link, generate_subscripts(ls, 1) as pos
    from (select page_id, html, ({_links('href="(/[^"]+)"')}) as ls from pages)))"""

ORACLE = {
    "alert_queue_top10": f"""with {JOBS}, {ALERTS} select id, company, title, score, {_csv('tech_stack')} as tech,
  {_time('ingested_at')} as ingested_at from {QUEUE.format(s=80, n=10)}""",
    "recent_jobs": f"""with {JOBS} select id, company, title, score, salary_min::varchar as salary_low, salary_max::varchar as salary_high,
  remote_policy, {_csv('tech_stack')} as tech_stack, location, url, source_name as source, source_tier as tier,
  strftime(ingested_at, '%Y-%m-%dT%H:%M:%S') as ingested_at, is_dream as is_dream_company from jobs
  where ingested_at between {AS_OF} - interval 168 hours and {AS_OF} and score >= 20 and remote_policy = 'remote'
  order by score desc, jobs.ingested_at desc, id limit 50""",
    "daily_digest": f"""with {JOBS}, {ALERTS} select id, company, title, score, {_time('ingested_at')} as ingested_at
  from (select * from {DAY_MATCHES.format(s=60)} order by score desc, ingested_at desc, id limit 10)""",
    "digest_remainder": f"""with {JOBS}, {ALERTS} select count(*) as matches, greatest(count(*) - 5, 0) as remainder
  from {DAY_MATCHES.format(s=0)}""",
    "digest_text": f"""with {JOBS}, {ALERTS}, m as (select * from {DAY_MATCHES.format(s=0)}),
top as (select * from m order by score desc, ingested_at desc, id limit 5), n as (select count(*) as c from m)
select '📊 <b>Daily summary (2001-07-01)</b>' || chr(10) || chr(10)
  || string_agg('• <b>' || company || '</b>: ' || title || ' (Score: ' || score || ')' || chr(10) || '  <a href="' || url
     || '">Apply Here</a>', chr(10) order by score desc, ingested_at desc, id)
  || case when (select c from n) > 5 then chr(10) || chr(10) || '<i>...and ' || ((select c from n) - 5) || ' more. View all '
     || (select c from n) || ' jobs on the dashboard.</i>' else '' end as digest from top having count(*) > 0""",
    "alert_texts": f"""with {JOBS}, {ALERTS} select id, {SALARY_TEXT} as salary, {TECH_TEXT} as tech, {ALERT_TEXT} as text
  from jobs where score >= 80 and id not in (select job_id from alerts)""",
    "alerts_per_channel": f"""with {JOBS}, {ALERTS} select id as job_id, channel, score as alert_score, company,
  true as delivered from {QUEUE.format(s=80, n=10)}, (values ('telegram'), ('email')) c(channel)""",
    "score_all": f"with {JOBS} select k, score, is_dream from jobs",
    "salary_extract": f"""with {POSTINGS} select k, ({_low('raw_text')})::varchar as salary_min, ({_high('raw_text')})::varchar as salary_max,
  {HAS_SALARY.format(x='raw_text')} as has_salary from postings""",
    "salary_extract_documents": f"""select doc_id, ({_low('text')})::varchar as salary_min, ({_high('text')})::varchar as salary_max,
  {HAS_SALARY.format(x='text')} as has_salary from documents""",
    "policy_extract": f"""with {POSTINGS}, x as (select k, {_phrase('raw_text')} as phrase from postings)
  select k, phrase, {_policy('phrase')} as policy from x""",
    "keyword_scan": f"with {POSTINGS} select k, {_csv(_tech('raw_text'))} as tech from postings",
    "keyword_scan_documents": f"select doc_id, {_csv(_tech('text'))} as tech from documents",
    "company_extract": f"select doc_id, {COMPANY_OF} as company, {HAS_COMPANY} as has_company from documents",
    "message_prefilter": f"select doc_id from documents where {WORTH}",
    "messages_to_raw": f"""with {MESSAGES} select 'tg_' || msg_id || '_' || substring(channel, 1, 10) as external_id,
  text as title, {COMPANY_OF} as company, 'https://t.me/' || channel || '/' || msg_id as url,
  'telegram_' || channel as source_name, md5(text) as text_md5 from messages where {WORTH}""",
    "latest_messages": f"""with {MESSAGES} select channel, msg_id from messages
  qualify row_number() over (partition by channel order by msg_id desc) <= 50""",
    "normalize_fields": rf"""with {POSTINGS}, x as (select k,
  case k % 6 when 0 then 'Fully Remote' when 1 then ' HYBRID remote' when 2 then 'In-Office' when 3 then 'in person' when 4 then '' end as p,
  case k % 7 when 0 then 'usd' when 1 then 'EUR ' when 2 then ' us dollars' when 3 then '' when 4 then null when 5 then 'gbp' else ' chf' end as c,
  string_split(case k % 3 when 0 then ' Rust |GO||go' when 1 then '' else 'C++| ' end, '|') as t,
  string_split(case k % 4 when 0 then 'sec+| CISSP ||Own Cert|cissp' when 1 then '' when 2 then 'Security+|ceh' else 'AWS Certified Security' end, '|') as q
  from postings) select k, {_policy('p')} as policy, {_currency('c')} as currency, {_csv(_cleaned('t'))} as tech,
  {_csv(_certs('q'))} as certs from x""",
    "validate_split": f"""with {DECODED} select k, (sound and s_ok and t_ok) as is_valid,
  {_parsed('(sound and s_ok and t_ok)', 's_num', 'pv', 't_val')} from typed""",
    "merge_hints": f"""with {DECODED} select k, {_parsed(MERGED_OK, MERGED_NUM, MERGED_POLICY, MERGED_TECH)}
  from typed where {MERGED_OK}""",
    "fallback_parse": f"""with {DECODED} select k, company, title, h_min::varchar as salary_min, 'USD' as currency,
  {_policy('h_policy')} as policy, {_csv('h_tech')} as tech, '' as certs from typed where not {MERGED_OK}""",
    "split_title_company": f"""with {POSTINGS} select k, title,
  case when k % 3 = 0 then '' else company end as company from (
    select k, company, case when k % 3 = 1 then title || ' at night' else title end as title from postings)""",
    "slug_company": rf"""with {POSTINGS}, x as (select k,
  replace(replace(lower(replace(company, '#', '-')) || '-3d-' || lower(location), '-', ' '), '#', ' ') as s from postings)
  select k, list_aggregate(list_transform(regexp_extract_all(s, '\p{{L}}+|\P{{L}}+'),
    lambda w: upper(w[1]) || lower(w[2:])), 'string_agg', '') as company from x""",
    "surrogate_ids": f"with {POSTINGS} select k, 'rss_' || substring(md5(url), 1, 16) as external_id from postings",
    "dedup_hash": f"with {POSTINGS} select k, {DEDUP} as hash from postings",
    "canonical_hash": f"""with {POSTINGS} select k, {_can_hash("' ' || title")} as hash from postings""",
    "blank_fallback": f"""with {POSTINGS} select k, case when k % 3 = 2 then 'Parsed title' else title end as title
  from postings""",
    "page_links_positional": f"""with {LINKS} select page_id, 'li_' || substring(md5(link), 1, 16) as external_id,
  link as url, {_strip('t')} as title, {_strip('c')} as company, md5(t || ' ' || c || ' ' || body) as text_md5 from links""",
    "page_cards": f"""with li as (select page_id, url, unnest((regexp_extract_all(html, '{_cards('li')}', 1))) as card from pages),
art as (select page_id, url, unnest((regexp_extract_all(html, '{_cards('article')}', 1))) as card from pages),
c as (select page_id, url, {_inner(_cards('a'))} as title, '' as company from li where regexp_matches(card, '{_cards('a')}')
  union all select page_id, url, {_inner(_cards('h1'))}, {_inner(PARAGRAPH)} from art
  where regexp_matches(card, '{_cards('h1')}') and regexp_matches(card, '{PARAGRAPH}'))
select page_id, 'pw_' || substring(md5(url || title), 1, 16) as external_id, title,
  md5(title || ' ' || company || ' ') as text_md5 from c""",
    "strip_tags_subject": rf"""with x as (select page_id, regexp_replace(html, '<[^>]+>', '', 'g') as t from pages)
  select page_id, md5(t) as text_md5, coalesce(nullif({_strip(f'''coalesce(list_filter(string_split(t, chr(10)),
    lambda l: regexp_matches(l, '[^{SP}]'))[1], '')''')}, ''), 'Posting alert') as subject from x""",
    "dedup_against_state": f"""with {POSTINGS}, {SEEN}, {INCOMING},
a as (select *, {_can_hash()} as canonical_hash from incoming where not ({EXT_LIVE}) and not ({CAN_LIVE})),
b as {_first('a', 'canonical_hash', 'ingested_at, external_id')},
c as {_first('b', 'external_id', 'ingested_at, canonical_hash')}
select k, external_id, canonical_hash from c""",
    "dedup_layer_hits": f"""with {POSTINGS}, {SEEN}, {INCOMING} select 'ext' as layer, count(*) as hits from incoming where {EXT_LIVE}
  union all select 'can', count(*) from incoming where not ({EXT_LIVE}) and {CAN_LIVE}""",
    "live_key_counts": f"""with {POSTINGS}, {SEEN} select kind, count(distinct key) as entries from seen
  where expires_at > {CUT} group by kind""",
    "key_marks": f"""with {POSTINGS} select 'ext' as kind, source_tier || ':' || external_id as key,
  {_time(f"{AS_OF} + interval 30 days")} as expires_at from postings
  union all select 'can', {DEDUP}, {_time(f"{AS_OF} + interval 60 days")} from postings""",
    "upsert_keys": f"""with {POSTINGS}, {SEEN}, {INCOMING}, m as (
  select kind, key, marked_at, expires_at from seen
  union all select 'ext', source_tier || ':' || external_id, ingested_at, ingested_at + interval 30 days from incoming
  union all select 'can', {DEDUP}, ingested_at, ingested_at + interval 60 days from incoming)
select kind, key, {_time('max(marked_at)')} as marked_at, {_time("max(expires_at)")} as expires_at from m group by kind, key""",
    "first_wins_batch": f"""with {POSTINGS}, a as (select * replace (case when k % 10 = 9 then '' else 'o_' || (k // 3) end as external_id),
  {_can_hash()} as canonical_hash from postings),
b as {_first('a', 'canonical_hash', 'ingested_at, external_id')},
c as {_first('b', "case when external_id = '' then canonical_hash else external_id end", 'ingested_at, canonical_hash')}
select k, external_id, canonical_hash from c""",
    "upsert_jobs": f"""with {JOBS}, o as (select * from jobs where ingested_at < {CUT}),
m as (select * replace (case when k % 14 = 3 then title || ' II' else title end as title) from jobs
  where ingested_at >= {CUT} or k % 7 = 3),
n as (select * replace ({_can_hash()} as canonical_hash) from m),
old as {_first('o', 'canonical_hash', 'ingested_at, external_id')},
new as {_first('n', 'canonical_hash', 'ingested_at, external_id')}
select canonical_hash, external_id, score, {_time('ingested_at')} as ingested_at,
  {_time(f"""case when canonical_hash in (select canonical_hash from new where source_tier = 1)
    or external_id in (select external_id from new where source_tier = 1 and canonical_hash not in (select canonical_hash from old))
    then {AS_OF} else ingested_at end""")} as last_seen_at
  from old
union all select canonical_hash, external_id, score, {_time('ingested_at')}, {_time('ingested_at')} from new
  where canonical_hash not in (select canonical_hash from old) and external_id not in (select external_id from old)""",
    "jobs_by_key_index": f"""with {JOBS}, o as (select * from jobs where ingested_at < {CUT}),
m as (select * replace (case when k % 14 = 3 then title || ' II' else title end as title) from jobs),
n as (select * replace ({_can_hash()} as canonical_hash) from m),
old as {_first('o', 'canonical_hash', 'ingested_at, external_id')},
new as {_first('n', 'canonical_hash', 'ingested_at, external_id')}
select new.external_id, coalesce(h.canonical_hash, i.canonical_hash, new.canonical_hash) as canonical_hash,
  case when h.canonical_hash is null and i.canonical_hash is null then 'new' else 'known' end as state
  from new left join old h on h.canonical_hash = new.canonical_hash left join old i on i.external_id = new.external_id""",
    "constraint_violations": f"""with {JOBS}, {ALERTS}, j as (select * replace (
  case when k % 50 <> 7 then company end as company, case when k % 100 = 1 then 'o_0' else external_id end as external_id),
  case when k % 60 = 5 then 'US Dollar' else 'USD' end as salary_currency from jobs)
select 'not null' as rule, 'company' as column, id as key, 1::bigint as rows from j where company is null
union all select 'length', 'salary_currency', id, 1 from j where length(salary_currency) > 3
union all select 'unique', 'canonical_hash', canonical_hash, count(*) from j group by canonical_hash having count(*) > 1
union all select 'unique', 'external_id', external_id, count(*) from j group by external_id having count(*) > 1
union all select 'foreign key', 'job_id', job_id, count(*) from alerts where job_id not in (select id from j) group by job_id""",
    "parse_cache_split": f"""with c as (select sha256(text) as key, min(doc_id) as d from documents where doc_id % 3 = 0 group by 1),
cache as (select key, d from c where d % 5 not in (0, 1) and timestamp '2024-01-25' + to_days((d % 10)::integer) > {EV_AS_OF})
select doc_id, d is not null as cache_hit, case when d is not null then '{{"title":"t' || d || '"}}' end as payload
  from documents left join cache on sha256(text) = key""",
    "chunk_requests": f"""with {CHUNKS} select bucket, batch_no, count(*) as n_texts,
  md5(string_agg('=== JOB ' || (pos + 1) || ' ===' || chr(10) || text || chr(10) || chr(10), '' order by pos)) as request_md5
  from chunks group by bucket, batch_no""",
    "align_results": f"""with {CHUNKS} select doc_id, case when pos < case when batch_no % 4 = 1 then 1 else 18 end
  then '{{"title":"d' || doc_id || '"}}' else '{{}}' end as payload from chunks""",
    "union_sources": f"""with {POSTINGS}, {MESSAGES}, {LINKS}
select external_id, title, company, source_name, source_tier from postings
union all select 'tg_' || msg_id || '_' || substring(channel, 1, 10), text, {COMPANY_OF},
  'telegram_' || channel, 4 from messages where {WORTH}
union all select 'li_' || substring(md5(link), 1, 16), {_strip('t')}, '', 'linkedin_imap', 3 from links""",
    "seed_registry": f"""with {SOURCES} select name, tier, url, consecutive_failures, total_scraped, is_stale from sources
union all select 'src' || (n_nationkey + 7), cast(1 + (n_nationkey + 7) % 2 as integer),
  'https://feeds.example.com/' || (n_nationkey + 7), 0, 0, false from nation
  where 'src' || (n_nationkey + 7) not in (select name from sources)""",
    "skip_unchanged": f"""with {LANDED}, {MANIFEST} select page_id, kind, url from landed l left join manifest m
  on md5(l.url) = m.url_key and m.expires_at > {EV_AS_OF}
  where not coalesce(case when kind = 'feed' and coalesce(m.etag, '') <> '' then m.etag = l.etag
    else coalesce(m.last_modified, '') <> '' and m.last_modified = l.last_modified end, false)""",
    "manifest_rows": f"""with {LANDED} select md5(url) as url_key, etag, last_modified,
  {_time(f"{EV_AS_OF} + interval 1 day")} as expires_at from landed where coalesce(etag, '') <> '' or coalesce(last_modified, '') <> ''""",
    "watchlist_join": f"""with {POSTINGS} select k, company in (select c_name from customer where c_acctbal < -900) as on_watchlist
  from postings""",
    "stats_overview": f"""with {JOBS} select count(*) as total_jobs,
  count(*) filter (ingested_at between {AS_OF} - interval 24 hours and {AS_OF}) as last_24h,
  count(*) filter (is_dream) as dream_jobs from jobs""",
    "jobs_by_tier": f"""with {POSTINGS} select t.tier, count(k) as jobs from (values (1), (2), (3), (4)) t(tier)
  left join postings p on p.source_tier = t.tier group by t.tier""",
    "health_6h": f"""with {POSTINGS} select t.tier, count(k) as jobs from (values (1), (2), (3), (4)) t(tier)
  left join (select * from postings where ingested_at between {AS_OF} - interval 6 hours and {AS_OF}) p
  on p.source_tier = t.tier group by t.tier""",
    "health_text": f"""with {POSTINGS}, {SOURCES}, c as (select t.tier, t.icon, count(k) as n
  from (values (1, '🥇'), (2, '🥈'), (3, '🥉'), (4, '📡')) t(tier, icon)
  left join (select * from postings where ingested_at between {AS_OF} - interval 6 hours and {AS_OF}) p
  on p.source_tier = t.tier group by t.tier, t.icon)
select '🩺 <b>Health report</b>' || chr(10) || '🕐 2001-07-01 12:00 UTC' || chr(10) || chr(10)
  || '📥 <b>New jobs (last 6h): ' || sum(n) || '</b>' || chr(10)
  || string_agg('  ' || case when n > 0 then '✅' else '⚠️' end || ' ' || icon || ' Tier ' || tier || ': <b>' || n || '</b> new jobs',
     chr(10) order by tier)
  || chr(10) || '⚠️ Stale sources: ' || (select string_agg(name, ', ' order by name) from sources where is_stale)
  || chr(10) || '🔴 Failing (3+ errors): ' || (select string_agg(name, ', ' order by name) from sources where consecutive_failures >= 3)
  || chr(10) || chr(10) || '<i>System running normally ✅</i>' as report from c""",
    "scraped_by_source": f"""with {POSTINGS} select source_name, source_tier, count(*) as scraped from postings group by 1, 2""",
    "source_staleness": f"""with {POSTINGS}, {SOURCES} select name, tier, count(k) as recent_jobs, count(k) = 0 as is_stale
  from sources left join postings on source_name = name and ingested_at between {AS_OF} - interval 24 hours and {AS_OF}
  group by name, tier""",
    "stale_names": f"""with {POSTINGS}, {SOURCES} select coalesce(string_agg(name, ', ' order by name), '') as names from sources
  where name not in (select source_name from postings where ingested_at between {AS_OF} - interval 24 hours and {AS_OF})""",
    "failing_sources": f"with {SOURCES} select name, tier, consecutive_failures from sources where consecutive_failures >= 3",
    "source_gauges": f"""with {SOURCES} select count(*) filter (is_stale) as stale_sources,
  coalesce(max(consecutive_failures), 0) as max_failures from sources""",
    "source_listing": f"""with {_updated()} select name, tier, case when microsecond(success_at) % 1000000 = 0 then strftime(success_at, '%Y-%m-%dT%H:%M:%S')
  else strftime(success_at, '%Y-%m-%dT%H:%M:%S.%f') end as last_success,
  consecutive_failures as failures, is_stale, total_scraped from updated""",
    "failure_streak": f"""with {_totals()} select source, streak, scraped, error_message,
  {_micros('success_at')} as last_success_at, {_micros('failure_at')} as last_failure_at from totals""",
    "source_totals": f"""with {_updated()} select name, tier, consecutive_failures, total_scraped, is_stale,
  error_message from updated""",
    "latency_histogram": """select le, count(*) filter (value <= bound) as samples from events,
  (values ('0.5', 0.5), ('1.0', 1.0), ('2.0', 2.0), ('5.0', 5.0), ('10.0', 10.0), ('30.0', 30.0), ('+Inf', 1e300)) b(le, bound)
  group by le""",
    "error_fingerprint": """select event_id, md5('ValueError' || case when event_id % 4 <> 0 then ': ' || props else '' end || chr(10)
  || '/app/u' || user_id || ':' || (event_id % 100)) as error_hash from events where event_type = 'error'""",
    "incident_records": """with h as (select *, md5('KeyError: ' || props || chr(10) || '/app/main:7') as error_hash
  from events where event_type = 'error')
select 'incident_worker' || user_id || '_' || strftime(ts, '%Y%m%d_%H%M%S') || '_' || substring(error_hash, 1, 8) as incident_id,
  error_hash, 'props=' || props || ';user=' || case when event_id % 3 <> 0 then user_id::varchar else '?' end as extra from h""",
    "error_cooldown": f"""with recursive {_chain("events where event_type = 'error'", 'user_id', 'ts', 'event_id', '24 hours')}
select k_ as user_id, i_ as event_id, {_micros('t_')} as ts from acc""",
    "ttl_dedup_batch": f"""with recursive {POSTINGS}, {_chain('postings', DEDUP, 'ingested_at', 'k', '60 days')}
select k_ as key, i_ as k, {_time('t_')} as ingested_at from acc""",
    "rolling_counts_stream": f"""with w as (select event_type, time_bucket(interval 6 hours, ts, timestamp '1970-01-01')
  - to_hours(6 * i) as s from events, range(4) r(i))
select event_type, {_time('s')} as window_start, {_time("s + interval 24 hours")} as window_end, count(*) as n
  from w group by event_type, s""",
}
ORACLE["ttl_dedup_stream"] = ORACLE["error_cooldown"].replace("events where event_type = 'error'", "events")
ORACLE["ingest_with_cache"] = """
with d as (select doc_id, coalesce(text, '') t from documents),
known as (select distinct t from d where doc_id % 2 = 0)
select doc_id::varchar external_id, 'doc ' || doc_id title, case when known.t is null then 'waiting' else 'stored' end state,
  case when known.t is not null then length(d.t) else -1 end answered
from d left join known using (t)"""
