"""DuckDB SQL for the registered queries, written independently of the DataFrame code."""

from __future__ import annotations

from feedlake import constants as C
from feedlake.constants import DURATION_BOUNDS, ITEM_COUNT_BOUNDS, WHITE_SPACE_POINTS
from feedlake.plans.derive import ENVIRONMENTS, ORIGINS, URL_SHAPES

_WS = "||".join(f"chr({p})" for p in WHITE_SPACE_POINTS)
_ZERO_US = "-62135596800000000"

# Derived tables as common table expressions: name -> (dependencies, text).
_TABLES: dict[str, tuple[tuple[str, ...], str]] = {}


def _table(name: str, text: str, *needs: str) -> None:
    _TABLES[name] = (needs, text)


def _quoted(texts) -> str:
    return ", ".join(f"'{t}'" for t in texts)


def _with(text: str, *needs: str, local: str = "") -> str:
    """Prefix ``text`` with the common table expressions it needs, dependencies first."""
    order: list[str] = []

    def visit(name: str) -> None:
        for dep in _TABLES[name][0]:
            visit(dep)
        if name not in order:
            order.append(name)

    for name in needs:
        visit(name)
    ctes = ",\n".join(f"{n} as ({_TABLES[n][1]})" for n in order)
    return f"with recursive {ctes}{', ' + local if local else ''}\n{text}"


_table("dated_docs", """
select *, case when doc_id % 97 = 0 then timestamp '2024-07-02 00:00:00'
  else timestamp '2024-06-30 23:00:00' - to_minutes(cast(doc_id *
    (case cast(substr(source, 4) as int) % 3 when 0 then 1 when 1 then 30 else 120 end) as int)) end as t
from documents""")

_table("raw_items", """
select doc_id as ingest_seq,
  'https://' || source || '.example.org/' || lang || '/rss.xml' as feed_url,
  'https://' || source || '.example.org/' || lang || '/' || doc_id as link,
  split_part(text, chr(10), 1) as title, text as description,
  case when doc_id % 11 = 0 then null else 'author_' || (doc_id % 37) end as author,
  case when doc_id % 13 <> 0 then strftime(t, '%a, %d %b %Y %H:%M:%S') || ' +0000'
    else case doc_id % 5
      when 0 then strftime(t, '%a, %d %b %Y %H:%M:%S') || ' GMT'
      when 1 then strftime(t, '%Y-%m-%dT%H:%M:%SZ')
      when 2 then strftime(t + interval 2 hour, '%a, %d %b %Y %H:%M:%S') || ' +0200'
      when 3 then 'some day soon' else '' end end as published
from dated_docs""", "dated_docs")

_table("normal_items", f"""
select ingest_seq, feed_url, title, link, description, author, pub_date, pub_us,
  md5(title || description || author) as content_hash
from (
  select ingest_seq, feed_url, trim(title, {_WS}) as title, trim(link, {_WS}) as link,
    trim(description, {_WS}) as description, trim(coalesce(author, 'Unknown'), {_WS}) as author,
    case when stamp is null then '0001-01-01T00:00:00Z'
      else strftime(stamp, '%Y-%m-%dT%H:%M:%S') || case when zone = '+0000' then 'Z'
        else left(zone, 3) || ':' || right(zone, 2) end end as pub_date,
    case when stamp is null then {_ZERO_US}
      else epoch_us(stamp) - (cast(left(zone, 3) as bigint) * 60 + cast(right(zone, 2) as bigint)) * 60000000 end as pub_us
  from (select *, right(published, 5) as zone,
      try_strptime(case when regexp_matches(published, ' [+-][0-9]{{4}}$') then left(published, length(published) - 6) end,
        '%a, %d %b %Y %H:%M:%S') as stamp
    from raw_items))""", "raw_items")

_table("checked_items", """
select *, list_filter([
    case when title = '' then 'title cannot be empty'
      when octet_length(encode(title)) > 500 then 'title cannot exceed 500 characters' end,
    case when link = '' then 'link cannot be empty'
      when not regexp_matches(link, '^[a-z]+://[^ ]+$') then 'link must be a valid URL' end,
    case when octet_length(encode(description)) > 2000 then 'description cannot exceed 2000 characters' end,
    case when octet_length(encode(author)) > 100 then 'author cannot exceed 100 characters' end],
  lambda e: e is not null) as errors
from normal_items""", "normal_items")

_table("items", "select * exclude (errors) from checked_items where len(errors) = 0", "checked_items")

_table("store_items", """
select * replace (md5(title || description || author) as content_hash) from (
  select * replace (case when ingest_seq % 7 = 0 then '[draft] ' || title else title end as title)
  from items where pub_us < epoch_us(timestamp '2024-06-24'))""", "items")

_table("ev", """
select event_id, ts, user_id, event_type, value, cast(json_extract(props, '$.k') as bigint) as k,
  'https://src' || (user_id % 20) || '.example.org/en/rss.xml' as feed_url
from events""")

_table("fetch_log", """
select event_id, ts, feed_url, case event_type when 'error' then 'failed' when 'view' then 'cache_hit' else 'success' end as status,
  value / 100 as duration_s, case when event_type = 'error' then -1 else k end as items_count, event_id % 50 = 0 as force_refresh
from ev""", "ev")

_table("job_log", """
select 'job_' || event_id as job_id, feed_url as url, 0 as step, 'pending' as status, ts, '' as error,
  0::bigint as items_count, 0::bigint as duration_ms from ev
union all
select 'job_' || event_id, feed_url, 1, 'processing', ts + interval 1 second, '', 0, 0 from ev where event_type <> 'signup'
union all
select 'job_' || event_id, feed_url, 2, case event_type when 'error' then 'failed' else 'completed' end,
  ts + interval 1 second + to_microseconds(cast(round(value * 1000) as bigint) * 1000),
  case event_type when 'error' then 'fetch failed' else '' end, case event_type when 'error' then 0 else k end,
  cast(round(value * 1000) as bigint)
from ev where event_type <> 'signup'""", "ev")

_table("store_log", """
select ts, 'save' as operation, case when k = 99 then 'failed' else 'success' end as status, value / 100 as duration_s
from ev where event_type not in ('error', 'view')
union all
select ts, 'cache_set', 'success', 0.0 from ev where event_type not in ('error', 'view') and k <> 99""", "ev")

_table("http_log", """
select 'req-' || event_id as request_id, ts as time, case when event_type in ('purchase', 'error') then 'POST' else 'GET' end as method,
  case event_type when 'click' then '/items' when 'view' then '/feeds' when 'signup' then '/job-status' else '/fetch-store' end as path,
  'limit=' || k as query, '10.0.0.' || (user_id % 250) || ':40000' as remote_addr, 'reader/1.0' as user_agent, case when event_type = 'error' then (case when event_id % 2 = 0 then 500 else 429 end) else 200 end::int as status,
  cast(round(value * 10) as bigint) as duration_ms,
  case when event_type in ('purchase', 'error') then repeat('{body} ', k * 2) else '' end as request_body,
  case when event_type = 'error' then repeat('error', k * 4) else 'ok' end as response_body
from ev""", "ev")

_table("request_log", """
select event_id as request_id, ts, user_id as u, '10.0.' || (user_id % 4) || '.' || user_id || ':40000' as remote_addr,
  case when user_id % 5 <> 0 then '203.0.113.' || user_id end as forwarded,
  case when user_id % 3 <> 0 then '198.51.100.' || user_id end as real_ip,
  case when user_id % 7 <> 0 then 'reader/' || (user_id % 4) || '.0' end as agent,
  case when user_id % 11 <> 0 then (case when user_id % 2 = 0 then 'en' else 'de' end) end as language,
  case when user_id % 13 <> 0 then left(sha256('sess-' || user_id), 8) end as session
from events""")

_table("clients", """
select *, left(sha256(concat_ws('|', 'ip:' || coalesce(forwarded, real_ip, remote_addr), 'ua:' || agent,
  'lang:' || language, 'sess:' || session)), 16) as client_id
from request_log""", "request_log")

_table("queue_samples", "select ts, k % 51 as depth, 50 as capacity from ev", "ev")

_table("intervals", """
select feed_url, items, coalesce(case when items >= 2 then total // nullif(gaps, 0) end, 86400000000)::bigint as interval_us
from (select feed_url, count(*) as items, sum(gap)::bigint as total, count(gap) as gaps
  from (select feed_url, case when d > 0 and d < 604800000000 then d end as gap
    from (select feed_url, pub_us - lag(pub_us) over (partition by feed_url order by pub_us) as d from items))
  group by feed_url)""", "items")

_table("all_feeds", """
select distinct 'https://' || source || '.example.org/' || lang || '/rss.xml' as feed_url, source || ' ' || upper(lang) as name
from documents""")

_table("ttls", """
select feed_url, items, interval_us, case when interval_us <= 3600000000 then 300000000::bigint
  when interval_us >= 86400000000 then 3600000000 when items > 100 then 1800000000
  when items < 10 then 450000000 else 900000000 end as ttl_us
from intervals""", "intervals")

_table("fetches", """
select feed_url, ts as fetched_at, ts + to_microseconds(coalesce(ttl_us, 900000000)) as expires_at
from fetch_log left join ttls using (feed_url) where status = 'success'""", "fetch_log", "ttls")

_table("url_samples", """
select page_id, shape::int as shape, replace(replace(text, '{u}', url), '{n}', (page_id % 200)::varchar) as url
from pages, (values __SHAPES__) v(shape, text)""".replace(
    "__SHAPES__", ", ".join(f"({i}, '{t}')" for i, t in enumerate(URL_SHAPES))))

_table("url_parts", r"""
select *, lower(regexp_extract(url, '^([a-zA-Z][a-zA-Z0-9+.-]*):', 1)) as scheme,
  lower(regexp_extract(url, '^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#]*)', 1)) as host,
  regexp_extract(url, '^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)', 1) as path,
  regexp_extract(url, '[?]([^#]*)', 1) as query
from url_samples""", "url_samples")

_BASE_REASONS = """case when url = '' then 'URL cannot be empty' {long}
  when regexp_matches(path, '%($|.$|[^0-9a-fA-F]|.[^0-9a-fA-F])') then 'invalid URL format'
  when scheme not in ('', 'http', 'https') then 'only HTTP and HTTPS URLs are allowed'
  when host = '' then 'URL must have a valid host' {more} end"""
_CLEAN = """case when reason is null then case when scheme = '' then 'https:' || url
  else scheme || substr(url, length(scheme) + 1) end end"""

_table("screened_basic", "select *, " + _BASE_REASONS.format(
    long="", more="when contains(host, 'localhost') or contains(host, '127.0.0.1') then 'localhost URLs are not allowed'"
) + " as reason from url_parts", "url_parts")

_EXT = [e.removeprefix(".") for e in C.SUSPICIOUS_EXTENSIONS]
_SCRIPT = "|".join(t.replace("(", "[(]").replace(".", "[.]") for t in C.INJECTION_TEXTS)
_SUFFIX = "|".join(s.removeprefix(".") for s in C.PRIVATE_SUFFIXES)
_table("screened_strict", "select *, " + _BASE_REASONS.format(
    long="when octet_length(encode(url)) > 2048 then 'URL length exceeds maximum allowed size'",
    more=rf"""
  when regexp_matches(split_part(host, ':', 1),
    '^(localhost|0[.]0[.]0[.]0|(10|127)[.][0-9]+[.][0-9]+[.][0-9]+|192[.]168[.][0-9]+[.][0-9]+|172[.](1[6-9]|2[0-9]|3[01])[.][0-9]+[.][0-9]+)$|[.]({_SUFFIX})$')
    then 'access to private networks and localhost is not allowed'
  when regexp_matches(lower(path), '[.]({'|'.join(_EXT)})') then 'URL contains suspicious file extension'
  when len(list_filter(string_split(query, '&'), lambda p: not regexp_matches(p, '%($|.$|[^0-9a-fA-F]|.[^0-9a-fA-F])')
    and regexp_matches(lower(url_decode(replace(p[strpos(p, '=') + 1:], '+', ' '))), '{_SCRIPT}'))) > 0
    then 'URL contains potentially malicious content'"""
) + " as reason from url_parts", "url_parts")

_table("metric_windows", """
select window_start, coalesce(failures / fetches, 0) as failure_rate, coalesce(queue_load, 0) as queue_load,
  coalesce(store_errors, 0) as store_errors
from (select date_trunc('hour', ts) as window_start, count(*) as fetches, count(*) filter (status = 'failed') as failures
    from fetch_log group by 1)
full join (select date_trunc('hour', ts) as window_start, max(depth / capacity) as queue_load from queue_samples group by 1) using (window_start)
full join (select date_trunc('hour', ts) as window_start, count(*) filter (status = 'failed') as store_errors from store_log group by 1)
  using (window_start)""", "fetch_log", "queue_samples", "store_log")

_table("episodes", """
select type || '-' || epoch(min(window_start) + interval 1 hour)::bigint as alert_id, type, any_value(severity) as severity,
  any_value(title) as title, any_value(description) as description, 'service=feedlake' as labels,
  min(window_start) + interval 1 hour as started_at,
  case when max(window_start) < (select max(window_start) from metric_windows) then max(window_start) + interval 2 hour end as resolved_at,
  count(*) as windows, any_value(case severity when 'high' then 'warn' else 'info' end) as log_level
from (select *, window_start - to_hours(cast(row_number() over (partition by type order by window_start) as int)) as island
  from (
    select window_start, 'high_error_rate' as type, 'high' as severity, 'High RSS feed failure rate detected' as title,
      'RSS feed failure rate has exceeded threshold' as description from metric_windows where failure_rate > 0.25
    union all select window_start, 'queue_full', 'medium', 'Async processing queue is full',
      'The async job queue has reached capacity' from metric_windows where queue_load >= 1
    union all select window_start, 'datastore_error', 'high', 'Datastore operation failures detected',
      'Multiple datastore operations have failed' from metric_windows where store_errors > 0))
group by type, island""", "metric_windows")

_table("job_states", """
select job_id, arg_max(url, ts) filter (status = 'pending') as url, arg_max(status, (ts, step)) as status,
  min(ts) filter (status = 'pending') as created_at, min(ts) filter (status = 'processing') as started_at_derived,
  max(ts) filter (status <> 'pending') as completed_at, arg_max(error, (ts, step)) as error,
  arg_max(items_count, (ts, step)) as items_count, arg_max(duration_ms, (ts, step)) as duration_ms
from job_log group by job_id""", "job_log")

_table("witnesses", """
select content_hash, arg_max(w, seq) as w from (
  select i.content_hash, i.ingest_seq as seq, struct_pack(link := s.link, title := s.title, author := s.author, hash := s.content_hash) as w
  from items i join store_items s using (link)) group by content_hash""", "items", "store_items")

_table("fresh", """
select i.* from items i left join witnesses using (content_hash)
where not coalesce(i.link = w.link or (i.title = w.title and i.author = w.author) or i.content_hash = w.hash, false)""",
    "items", "witnesses")

_table("recrawl", """
select * from items union all
select * replace (ingest_seq + 1000000000 as ingest_seq, title || ' (corrected)' as title, md5(title || ' (corrected)' || description || author) as content_hash)
from items where ingest_seq % 9 = 0""", "items")

_table("recrawl_fresh", """
select i.* from recrawl i left join (
  select content_hash, arg_max(w, seq) as w from (
    select i.content_hash, i.ingest_seq as seq, struct_pack(link := s.link, title := s.title, author := s.author, hash := s.content_hash) as w
    from recrawl i join store_items s using (link)) group by content_hash) using (content_hash)
where not coalesce(i.link = w.link or (i.title = w.title and i.author = w.author) or i.content_hash = w.hash, false)""", "recrawl", "store_items")

SQL: dict[str, str] = {}

_ITEM = "title, link, description, author, pub_date"


def _page_sql(where: str, limit: int, offset: int, keyword: str | None) -> str:
    kw = keyword.lower() if keyword else ""
    local = f"""
wanted as (select * from items where {where}),
page as (select * from wanted order by pub_us desc, link limit {limit} offset {offset}),
kept as (select * from page where contains(lower(title), '{kw}') or contains(lower(description), '{kw}')),
sums as (select (select count(*) from wanted) as total_count, (select count(*) from page) as fetched,
  {offset} + (select count(*) from kept) as reached)"""
    return _with("""
select (select cast(to_json(list(struct_pack(title := title, link := link, description := description,
      author := author, pub_date := pub_date) order by pub_us desc, link)) as varchar) from kept) as items,
  total_count, reached < total_count as has_more,
  case when reached < total_count and fetched > 0 then 'offset:' || reached else '' end as next_cursor
from sums""", "items", local=local)


SQL["normalize_items"] = _with(
    f"select ingest_seq, feed_url, {_ITEM}, pub_us from normal_items", "normal_items")
SQL["validate_items"] = _with(
    "select ingest_seq, link, case when len(errors) > 0 then 'validation failed: ' || array_to_string(errors, ', ') end as error "
    "from checked_items", "checked_items")
SQL["content_hash"] = _with("select ingest_seq, link, content_hash from items", "items")
SQL["items_page"] = _page_sql(
    "link > 'https://src' and link < 'https://src' || chr(65533) and pub_us between "
    "epoch_us(timestamp '2024-05-01') and epoch_us(timestamp '2024-06-30 23:59:59')", 50, 20, "the")
SQL["items_page_prefiltered"] = _page_sql(
    "link > 'https://src' and link < 'https://src' || chr(65533) and "
    "(contains(lower(title), 'the') or contains(lower(description), 'the'))", 40, 10, "the")

SQL["feed_catalog"] = _with("select name, feed_url as url from all_feeds", "all_feeds")
SQL["parse_feeds"] = _with(f"select feed_url, {_ITEM} from normal_items", "normal_items")
SQL["parse_mixed_feeds"] = SQL["parse_feeds"]
SQL["parse_feed_files"] = SQL["stream_feed_files"] = SQL["parse_feeds"]
SQL["parse_failures"] = _with("""
select feed_url, 1719792000 + capture as fetched_s, case capture % 4 when 1 then 'malformed document' else 'unknown format' end as reason
from (select distinct feed_url, ingest_seq // 200 as capture from raw_items) where capture % 4 in (1, 2)""", "raw_items")
SQL["scan_items"] = _with("select * from items", "items")
SQL["count_items"] = _with("select count(*) as items from items", "items")
_COLS = "link, title, author, pub_date, content_hash"
_LAST = "select {0} from {1} qualify row_number() over (partition by link order by ingest_seq desc) = 1"
SQL["upsert_items"] = _with(
    f"select {_COLS} from store_items anti join recrawl_fresh using (link) union all ({_LAST.format(_COLS, 'recrawl_fresh')})", "store_items", "recrawl_fresh")
SQL["upsert_all"] = _with(
    f"select {_COLS} from store_items anti join recrawl using (link) union all ({_LAST.format(_COLS, 'recrawl')})", "store_items", "recrawl")
SQL["upsert_counts"] = _with(
    "select (select count(*) from recrawl) as offered, count(*) as put, count(*) - count(distinct link) as replaced_in_batch from recrawl_fresh",
    "recrawl_fresh")
SQL["batch_plan"] = _with("""
select feed_url, n as items, b as batch_size, ceil(n / b)::bigint as n_batches from (
  select feed_url, count(*) as n, (case when count(*) <= 10 then 50 when count(*) <= 50 then 200 when count(*) <= 200 then 500
    when count(*) <= 1000 then 1000 else 2000 end)::bigint as b from items group by feed_url)""", "items")
SQL["cleanup"] = _with(
    "select count(*) filter (pub_us >= epoch_us(timestamp '2024-06-01')) as kept, "
    "count(*) filter (pub_us < epoch_us(timestamp '2024-06-01')) as deleted from items", "items")
SQL["read_http_log"] = _with("select * from http_log", "http_log")
SQL["screen_urls_basic"] = _with(f"select page_id, shape, url, reason, {_CLEAN} as sanitised_url from screened_basic", "screened_basic")
SQL["screen_urls_strict"] = _with(f"""
select page_id, shape, url, reason, {_CLEAN} as sanitised_url,
  case when reason is null then regexp_matches(lower(path), '/rss|/feed|/atom|/xml|[.](rss|xml|atom)$')
    or regexp_matches(lower(query), 'rss|feed|atom') end as looks_like_feed
from screened_strict""", "screened_strict")
SQL["screening_report"] = _with("select coalesce(reason, 'ok') as reason, count(*) as urls from screened_strict group by 1", "screened_strict")
SQL["client_key"] = _with("select request_id, client_id from clients", "clients")
SQL["classify_http_log"] = _with(f"""
select request_id, status, case when status >= 500 then 'error' when status >= 400 then 'warn' else 'info' end as level,
  case when status >= 500 then '{C.LOG_SERVER_ERROR}' when status >= 400 then '{C.LOG_CLIENT_ERROR}'
    else '{C.LOG_SUCCESS}' end as message,
  case when octet_length(encode(request_body)) between 1 and 1023 then request_body end as request_body,
  case when status >= 400 and octet_length(encode(response_body)) between 1 and 1023 then response_body end as response_body
from http_log""", "http_log")
SQL["origin_audit"] = f"""
select event_id as request_id, origin, environment,
  coalesce(origin in (select unnest(['https://partner.example', 'http://partner.example'])) or origin like '%.partner.example'
    or case lower(environment) when 'prod' then origin in ({_quoted(C.PRODUCTION_ORIGINS)})
      when 'stage' then origin in ({_quoted(C.STAGING_ORIGINS)})
      else origin in ({_quoted((*C.DEVELOPMENT_ORIGINS, "https://wild.example", "http://wild.example"))}) or origin like '%.wild.example' end, false) as allowed
from (select event_id, ({list(ORIGINS)})[(event_id % {len(ORIGINS)} + 1)::int] as origin,
  ({list(ENVIRONMENTS)})[(user_id % {len(ENVIRONMENTS)} + 1)::int] as environment from events)"""
SQL["origin_audit_rules"] = f"""
select event_id as request_id, origin, environment,
  coalesce(origin in (select unnest(['https://partner.example', 'http://partner.example'])) or origin like '%.partner.example'
    or case lower(environment) when 'prod' then origin in ({_quoted(C.PRODUCTION_ORIGINS)}) or (site in (select c_custkey from customer)
        and (origin = 'https://c' || site || '.example' or origin like '%.c' || site || '.example'))
      when 'stage' then origin in ({_quoted(C.STAGING_ORIGINS)})
      else origin in ({_quoted((*C.DEVELOPMENT_ORIGINS, "https://wild.example", "http://wild.example"))}) or origin like '%.wild.example' end, false) as allowed
from (select event_id, environment, case when event_id % 7 = 0 then event_id % 400 end as site,
    case when event_id % 7 = 0 then (case when event_id % 2 = 0 then 'https://' else 'http://' end) || (case when event_id % 3 = 0 then 'api.' else '' end)
      || 'c' || (event_id % 400) || '.example' else origin end as origin
  from (select event_id, ({list(ORIGINS)})[(event_id % {len(ORIGINS)} + 1)::int] as origin,
    ({list(ENVIRONMENTS)})[(user_id % {len(ENVIRONMENTS)} + 1)::int] as environment from events))"""
SQL["filter_source"] = _with(
    "select link, author, pub_date from items where starts_with(link, 'https://src1') and link <> 'https://src1'", "items")
SQL["filter_author"] = _with("select link, author, pub_date from items where author = 'Unknown'", "items")
SQL["lookup_links"] = _with("""
select link, author, pub_date from items where link in (
  select 'https://src' || k || '.example.org/' || lang || '/' || k from (values (3), (4), (5)) t(k), (values ('en'), ('de')) u(lang)
  union all select 'https://src1.example.org/en/21')""", "items")
SQL["filter_dates"] = _with(
    "select link, author, pub_date from items where pub_us between epoch_us(timestamp '2024-05-31 22:00:00') "
    "and epoch_us(timestamp '2024-06-30 23:00:00')", "items")
SQL["filter_keyword"] = _with(
    "select link, author, pub_date from items where contains(lower(title), 'the') or contains(lower(description), 'the')", "items")
SQL["indexed_keyword"] = _with(
    "select link, author, pub_date from items where contains(lower(title), 'er. the') or contains(lower(description), 'er. the')", "items")
SQL["page_items"] = _with(f"select {_ITEM} from items order by pub_us desc, link limit 100 offset 30", "items")
SQL["deep_page"] = _with(
    f"select {_ITEM} from items order by pub_us desc, link limit 50 offset (select cast(count(*) // 2 as bigint) from items)", "items")
SQL["latest_items"] = _with(f"select {_ITEM} from items order by pub_us desc, link limit 1000", "items")
SQL["keyset_page"] = _with("""
select link, pub_date from items where pub_us < epoch_us(timestamp '2024-06-30 12:00:00')
  or (pub_us = epoch_us(timestamp '2024-06-30 12:00:00') and link > 'https://src2')
order by pub_us desc, link limit 100""", "items")
SQL["existing_by_link"] = _with("""
select i.link, i.content_hash, s.title as stored_title, s.content_hash as stored_hash
from items i left join store_items s using (link)""", "store_items")
SQL["drop_known"] = _with("select ingest_seq, link, content_hash from fresh", "fresh")
SQL["duplicate_pairs"] = _with("""
select first_seq, ingest_seq as duplicate_seq, string_agg(reason, ',' order by rank) as reasons from (
  select ingest_seq, min(ingest_seq) over (partition by link) as first_seq, 'link' as reason, 1 as rank from normal_items
  union all select ingest_seq, min(ingest_seq) over (partition by title, author), 'title_author', 2 from normal_items
  union all select ingest_seq, min(ingest_seq) over (partition by content_hash), 'content_hash', 3 from normal_items)
where first_seq <> ingest_seq group by first_seq, ingest_seq""", "normal_items")
SQL["duplicate_groups"] = _with("""
select reason, n as members, count(*) as groups from (
  select 'title_author' as reason, count(*) as n from normal_items group by title, author
  union all select 'content_hash', count(*) from normal_items group by content_hash)
where n > 1 group by reason, n""", "normal_items")
SQL["age_buckets"] = _with("""
select bucket, items from (
  select count(*) as total,
    count(*) filter (pub_us >= n - 86400000000 and pub_us < n) as last_24h,
    count(*) filter (pub_us >= n - 7 * 86400000000 and pub_us < n - 86400000000) as last_7d,
    count(*) filter (pub_us >= n - 30 * 86400000000 and pub_us < n - 7 * 86400000000) as last_30d,
    count(*) filter (pub_us < n - 30 * 86400000000) as older_30d
  from items, (select epoch_us(timestamp '2024-07-01') as n))
unpivot (items for bucket in (total, last_24h, last_7d, last_30d, older_30d))""", "items")
SQL["update_interval"] = _with("select feed_url, items, interval_us from intervals", "intervals")
SQL["adaptive_ttl"] = _with("""
select feed_url, coalesce(items, 0) as items, interval_us, coalesce(ttl_us, 900000000) as ttl_us
from all_feeds left join ttls using (feed_url)""", "all_feeds", "ttls")
SQL["freshness_asof"] = _with("""
select r.event_id, r.feed_url, f.fetched_at, case when f.expires_at >= r.ts and not r.force_refresh then 'HIT' else 'MISS' end as verdict
from fetch_log r asof left join fetches f on r.feed_url = f.feed_url and r.ts > f.fetched_at""", "fetches")
SQL["refresh_plan"] = _with("""
select feed_url, fetched_at, ttl_us, reason, reason <> 'fresh' as due from (
  select feed_url, fetched_at, coalesce(ttl_us, 900000000) as ttl_us,
    case when starts_with(feed_url, 'https://src3.') then 'forced' when fetched_at is null then 'never fetched'
      when fetched_at + to_microseconds(coalesce(ttl_us, 900000000)) < timestamp '2024-01-30 12:00:00' then 'expired' else 'fresh' end as reason
  from all_feeds left join (select feed_url, max(ts) as fetched_at from fetch_log
      where status = 'success' and ts < timestamp '2024-01-30 12:00:00' group by 1) using (feed_url)
    left join ttls using (feed_url))""", "all_feeds", "fetch_log", "ttls")

SQL["counter_rollup"] = _with("""
select 'rss_feed_fetch_total' as metric, 'url=' || feed_url || ',status=' || status as labels, count(*) as value from fetch_log group by 2
union all select 'rss_async_jobs_total', 'status=' || status, count(*) from job_log where status in ('completed', 'failed') group by 2
union all select case status when 'cache_hit' then 'rss_cache_hits_total' else 'rss_cache_misses_total' end, 'operation=get_feed_items',
  count(*) from fetch_log group by 1
union all select 'rss_datastore_operations_total', 'operation=' || operation || ',status=' || status, count(*) from store_log group by 2
union all select 'rss_http_requests_total', 'method=' || method || ',endpoint=' || path || ',status=' || status, count(*) from http_log group by 2
""", "fetch_log", "job_log", "store_log", "http_log")
SQL["hit_ratio"] = _with(
    "select round(count(*) filter (status = 'cache_hit') / count(*), 6) as hit_ratio from fetch_log", "fetch_log")


def _histogram_sql(metric: str, source: str, labels: str, value: str, bounds, where: str = "true") -> str:
    steps = ", ".join(f"('{b}', {b}::double)" for b in bounds) + ", ('+Inf', 'infinity'::double)"
    return f"""
select '{metric}' as metric, labels, round(sum(v), 6) as sum, count(*) as count, le, bucket
from (select {labels} as labels, ({value})::double as v from {source} where {where}) join (
  select labels, le, count(*) filter (v <= bound) as bucket
  from (select {labels} as labels, ({value})::double as v from {source} where {where}), (values {steps}) b(le, bound)
  where v >= 0 group by labels, le) using (labels)
where v >= 0 group by labels, le, bucket"""


SQL["histogram_rollup"] = _with(" union all ".join((
    _histogram_sql("rss_feed_fetch_duration_seconds", "fetch_log", "'url=' || feed_url || ',status=' || status", "duration_s", DURATION_BOUNDS),
    _histogram_sql("rss_feed_items_count", "fetch_log", "'url=' || feed_url", "items_count", ITEM_COUNT_BOUNDS),
    _histogram_sql("rss_async_job_duration_seconds", "job_log", "'status=' || status", "duration_ms / 1000", DURATION_BOUNDS,
                   "status in ('completed', 'failed')"),
    _histogram_sql("rss_datastore_operation_duration_seconds", "store_log", "'operation=' || operation || ',status=' || status",
                   "duration_s", DURATION_BOUNDS),
    _histogram_sql("rss_http_request_duration_seconds", "http_log",
                   "'method=' || method || ',endpoint=' || path || ',status=' || status", "duration_ms / 1000", DURATION_BOUNDS),
)), "fetch_log", "job_log", "store_log", "http_log")
SQL["gauge_last"] = _with("""
select 'rss_async_queue_size' as name, sum(case status when 'pending' then 1 when 'processing' then -1 else 0 end)::bigint as value,
  date_trunc('minute', max(ts)) + interval 1 minute as ts from job_log
union all
select 'rss_active_workers', sum(case status when 'processing' then 1 when 'pending' then 0 else -1 end)::bigint,
  date_trunc('minute', max(ts)) + interval 1 minute from job_log""", "job_log")
SQL["queue_depth"] = _with("""
select distinct date_trunc('minute', ts) + interval 1 minute as ts,
  (sum(d) over (order by date_trunc('minute', ts)))::bigint as value
from (select ts, case status when 'pending' then 1 else -1 end as d from job_log where status in ('pending', 'processing'))""", "job_log")
SQL["success_rate"] = _with("""
select window_start, count(*) as fetches, round(count(*) filter (status = 'success') / count(*) * 100, 6) as success_pct
from (select status, date_trunc('minute', ts) - to_minutes(i::int) as window_start from fetch_log, range(5) r(i))
group by window_start""", "fetch_log")
SQL["job_state"] = _with("select * from job_states", "job_states")
SQL["job_state_ttl"] = _with("select * from job_states where created_at >= timestamp '2024-01-30'", "job_states")
SQL["alert_episodes"] = _with("select * from episodes", "episodes")
SQL["active_alerts"] = _with(
    "select * from episodes where started_at <= timestamp '2024-01-18' "
    "and (resolved_at is null or resolved_at > timestamp '2024-01-18')", "episodes")
SQL["client_sessions"] = _with("""
select client_id, min(ts) as session_start, max(ts) as last_seen, max(ts) + interval 5 minute as session_end, count(*) as requests
from (select client_id, ts, sum(fresh) over (partition by client_id order by ts rows unbounded preceding) as session
  from (select client_id, ts, case when ts - lag(ts) over (partition by client_id order by ts) <= interval 5 minute then 0 else 1 end as fresh
    from clients))
group by client_id, session""", "clients")
SQL["queue_admission"] = _with("""
select date_trunc('hour', ts) as window_start,
  case when depth / capacity >= 0.8::double then 'reject' when depth / capacity >= 0.8::double * 0.8::double then 'delay' else 'admit' end as verdict,
  count(*) as samples, max(depth) as max_depth
from queue_samples group by 1, 2""", "queue_samples")

# --- streams: the same answers as their batch forms --------------------------------------------------
SQL["stream_counter_rollup"] = _with("""
select metric, labels, window_start, count(*) as value from (select metric, labels, date_trunc('hour', ts) as window_start from (
  select 'rss_feed_fetch_total' as metric, 'url=' || feed_url || ',status=' || status as labels, ts from fetch_log
  union all select 'rss_async_jobs_total', 'status=' || status, ts from job_log where status in ('completed', 'failed')
  union all select case status when 'cache_hit' then 'rss_cache_hits_total' else 'rss_cache_misses_total' end, 'operation=get_feed_items', ts from fetch_log
  union all select 'rss_datastore_operations_total', 'operation=' || operation || ',status=' || status, ts from store_log
  union all select 'rss_http_requests_total', 'method=' || method || ',endpoint=' || path || ',status=' || status, time from http_log)) group by 1, 2, 3
""", "fetch_log", "job_log", "store_log", "http_log")


def _daily_histogram_sql(metric: str, source: str, labels: str, value: str, bounds, ts: str = "ts", where: str = "true") -> str:
    steps = ", ".join(f"('{b}', {b}::double)" for b in bounds) + ", ('+Inf', 'infinity'::double)"
    return f"""
select '{metric}' as metric, labels, window_start, round(sum(v), 6) as sum, count(*) as count, le, count(*) filter (v <= bound) as bucket
from (select {labels} as labels, ({value})::double as v, date_trunc('day', {ts})::timestamp as window_start from {source} where {where}), (values {steps}) b(le, bound)
where v >= 0 group by labels, window_start, le"""


SQL["stream_counter_late"] = SQL["stream_counter_rollup"]
SQL["stream_histogram_rollup"] = _with(" union all ".join((
    _daily_histogram_sql("rss_feed_fetch_duration_seconds", "fetch_log", "'url=' || feed_url || ',status=' || status", "duration_s", DURATION_BOUNDS),
    _daily_histogram_sql("rss_feed_items_count", "fetch_log", "'url=' || feed_url", "items_count", ITEM_COUNT_BOUNDS),
    _daily_histogram_sql("rss_async_job_duration_seconds", "job_log", "'status=' || status", "duration_ms / 1000", DURATION_BOUNDS,
                         where="status in ('completed', 'failed')"),
    _daily_histogram_sql("rss_datastore_operation_duration_seconds", "store_log", "'operation=' || operation || ',status=' || status", "duration_s", DURATION_BOUNDS),
    _daily_histogram_sql("rss_http_request_duration_seconds", "http_log", "'method=' || method || ',endpoint=' || path || ',status=' || status",
                         "duration_ms / 1000", DURATION_BOUNDS, ts="time"),
)), "fetch_log", "job_log", "store_log", "http_log")
SQL["stream_histogram_late"] = SQL["stream_histogram_rollup"]
SQL["stream_success_rate"] = SQL["stream_success_late"] = SQL["success_rate"]
SQL["stream_alert_episodes"] = SQL["alert_episodes"]
SQL["stream_http_log"] = SQL["classify_http_log"]
SQL["stream_job_state"] = SQL["job_state"]
SQL["stream_job_state_ttl"] = _with(
    "select * from job_states where created_at >= (select max(ts) from job_log) - interval 1 day", "job_states")
SQL["stream_client_sessions"] = (
    "select * from (" + SQL["client_sessions"] + ") where session_end + interval 1 microsecond <= (select max(ts) from events) - interval 1 minute")
SQL["stream_ingest"] = _with(
    f"select {_COLS} from store_items anti join fresh using (link) union all select {_COLS} from fresh", "store_items", "fresh")
SQL["stream_ingest_report"] = _with("""
select count(*) as entries, count(*) filter (len(errors) > 0) as invalid, (select count(*) from fresh) as new,
  count(*) filter (len(errors) = 0) - (select count(*) from fresh) as duplicates from checked_items""", "fresh", "checked_items")
