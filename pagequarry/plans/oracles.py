"""DuckDB statements that give the same rows as the registered queries.

They are written on their own, from the meaning of each query: plain joins, windows and
single-machine functions, without the partitioning measures of the Spark jobs.
"""

from __future__ import annotations

from pagequarry.functions import catalog, rules
from pagequarry.plans import derived as D

ORACLES: dict[str, str] = {}


def _q(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _values(rows) -> str:
    def one(v):
        return str(v) if isinstance(v, int) else _q(v)

    return ", ".join("(" + ", ".join(one(v) for v in row) + ")" for row in rows)


# --- parts of URLs --------------------------------------------------------------------------

_PARTS = r"'^([A-Za-z][A-Za-z0-9+.\-]*):(?://([^/?#]*))?([^?#]*)(\?[^#]*)?(#.*)?$'"


def scheme(u: str) -> str:
    return f"lower(regexp_extract({u}, {_PARTS}, 1))"


def net(u: str) -> str:
    return f"regexp_extract({u}, {_PARTS}, 2)"


def path(u: str) -> str:
    return f"regexp_extract({u}, {_PARTS}, 3)"


def query(u: str) -> str:
    return f"ltrim(regexp_extract({u}, {_PARTS}, 4), '?')"


def info(u: str) -> str:
    return f"list_extract(string_split({net(u)}, '@'), -1)"


def host(u: str) -> str:
    return (
        f"lower(case when starts_with({info(u)}, '[') then regexp_extract({info(u)}, '\\[([^\\]]*)', 1) "
        f"else split_part({info(u)}, ':', 1) end)"
    )


def port_text(u: str) -> str:
    return f"nullif(regexp_extract({info(u)}, '(^\\[[^\\]]*\\]|^[^:\\[]*):(.*)$', 2), '')"


def port(u: str) -> str:
    return f"case when try_cast({port_text(u)} as int) between 0 and 65535 then try_cast({port_text(u)} as int) end"


# --- requests -------------------------------------------------------------------------------

R = f"r as ({D.REQUESTS_SQL})"
REQ = f"""{R},
v as (select *, trim(url_raw) as url, regexp_matches(trim(url_raw), '^https?://[^/?#:@]', 'i') as valid from r),
firsts as (select * from (select *, row_number() over (partition by batch_id, url order by ord) as rn from v where valid)),
sizes as (select batch_id, count(*) as n_urls, count_if(not valid) as n_invalid,
          count(distinct case when valid then url end) as n_unique from v group by batch_id)"""

ORACLES["q_valid_urls"] = f"""with {REQ} select batch_id, ord, url, {scheme('url')} as scheme, {host('url')} as host,
  {path('url')} as path, {query('url')} as query_part from v where valid"""
ORACLES["q_rejected_urls"] = f"with {REQ} select batch_id, ord, url_raw from v where not valid"
ORACLES["q_first_seen_urls"] = f"with {REQ} select batch_id, ord, url, format, timeout_s from firsts where rn = 1"
ORACLES["q_duplicate_urls"] = f"with {REQ} select batch_id, ord, url from firsts where rn > 1"
ORACLES["q_repeat_counts"] = f"""with {REQ} select batch_id, url, count(*) - 1 as repeats from v where valid
  group by batch_id, url having count(*) > 1"""
ORACLES["q_batch_gate"] = f"""with {REQ} select *, case when n_urls = 0 then 'no_urls' when n_invalid > 0 then 'invalid_urls'
  when n_unique > 20 then 'too_many_urls' end as strict_reason,
  case when n_unique > 20 then 'too_many_urls' end as lenient_reason from sizes"""
ORACLES["q_accepted_urls"] = f"""with {REQ} select f.batch_id, f.ord, f.url from firsts f join sizes s using (batch_id)
  where rn = 1 and n_unique <= 20"""
ORACLES["q_invalid_lists"] = f"""with {REQ}, p as (select *, (row_number() over (partition by batch_id order by ord) - 1) // 1000 as piece
  from v where not valid)
  select batch_id, piece, count(*) as n, string_agg(url_raw, ', ' order by ord) as invalid_urls from p group by batch_id, piece"""
ORACLES["q_timeout_resolution"] = f"""with {R} select batch_id, ord, coalesce(timeout_s, 60.0) as timeout,
  case when coalesce(timeout_s, 60.0) <= 0 then 'timeout_not_positive' end as timeout_reason,
  coalesce(timeout_s > 600, false) as long_timeout from r"""
ORACLES["q_long_timeout_lines"] = f"""with {R} select batch_id, ord, 'note: a timeout of ' || cast(timeout_s as bigint)
  || 's is over 10 times the default of 60s' as line from r where timeout_s > 600"""
_BODIES = f"""b as (select page_id as batch_id, {D.BODY_SQL} as body from pages),
j as (select batch_id, body, case when json_valid(body) then json(body) end as d from b),
p as (select batch_id, d, case when d is null then 'not_json' when json_type(d) <> 'OBJECT' then 'not_object'
    when not json_exists(d, '$.urls') then 'no_urls' when json_type(d, '$.urls') <> 'ARRAY' then 'bad_urls'
    when len(list_filter(json_extract(d, '$.urls[*]'), lambda x: json_type(x) <> 'VARCHAR')) > 0 then 'bad_urls' end as reason from j),
u as (select *, case when reason is null then json_extract_string(d, '$.urls[*]') end as urls from p)"""
ORACLES["q_request_bodies"] = f"""with {_BODIES} select batch_id, reason, len(urls) as n_urls,
  case when urls is not null then coalesce(array_to_string(urls, ' '), '') end as listed from u"""
ORACLES["q_body_rows"] = f"""with {_BODIES}
  select batch_id, cast(i - 1 as bigint) as ord, urls[i] as url_raw from (select batch_id, urls, unnest(range(1, len(urls) + 1)) as i from u where reason is null)
  union all select batch_id, null, null from u where reason is null and len(urls) = 0"""

# --- captures -------------------------------------------------------------------------------


def hdr(name: str, *spelled: str) -> str:
    return "coalesce(" + ", ".join(f"""json_extract_string(headers_json, '$."{s}"')""" for s in (name, *spelled)) + ")"


_CT = hdr("content-type", "Content-Type")
_MT = "nullif(lower(trim(split_part(ct, ';', 1))), '')"
K = f"""k0 as ({D.CAPTURES_SQL}),
k as (select *, {_CT} as ct, {hdr('content-length', 'Content-Length')} as cl,
  {hdr('X-Squid-Error')} as squid, {hdr('CF-Mitigated')} as mitigated,
  coalesce(final_status, first_status) as st from k0),
k1 as (select *, {_MT} as mt, ({_MT}) not in ('text/html', 'application/xhtml+xml') as file_type from k)"""

ORACLES["q_media_types"] = f"""with {K} select url, attempt, mt as media_type, not coalesce(file_type, false) as may_be_html,
  coalesce(file_type, false) as not_html from k1"""
ORACLES["q_header_lookup"] = f"""with {K} select url, attempt, ct as content_type, cl as content_length, squid as proxy_error,
  case when headers_json is not null then array_to_string(list_sort(list_transform(json_keys(headers_json), lambda x: lower(x))), ',') end as names from k1"""
ORACLES["q_body_kept"] = f"""with {K} select url, attempt, coalesce(st between 200 and 299, false) as success,
  coalesce(file_type, false) and coalesce(st between 200 and 299, false)
    and (cl is null or coalesce(try_cast(cl as bigint) <= 67108864, false)) as kept from k1"""

_LOW = "lower(error_text)"
_KIND = f"""case when contains({_LOW}, 'playwright install') then 'browser_not_installed'
  when regexp_matches({_LOW}, 'err_proxy_|err_tunnel_connection_failed|err_socks') then 'proxy'
  when regexp_matches({_LOW}, 'net::err_cert_|net::err_ssl_|ssl handshake|certificate verify failed') then 'tls'
  when regexp_matches({_LOW}, 'err_name_(not_resolved|resolution_failed)') then 'name_resolution'
  when contains({_LOW}, 'err_connection_refused') then 'connection_refused'
  when regexp_matches({_LOW}, 'timed out|err_timed_out|timeout [0-9]+ms exceeded') then 'timeout'
  when regexp_matches({_LOW}, 'err_aborted|download is starting') then 'non_html' else 'other' end"""
_SUMMARY = "case when regexp_matches({d}, 'net::ERR_[A-Z0-9_]+') then regexp_extract({d}, 'net::ERR_[A-Z0-9_]+') else trim({d}) end"
ORACLES["q_error_kinds"] = f"""with {K} select url, attempt, {_KIND} as kind, {_SUMMARY.format(d='error_text')} as summary,
  regexp_matches({_LOW}, 'net::err_(cert|ssl)_') as tls,
  case when page_id % 4 = 0 then 'proxy' when page_id % 4 = 1 then 'timeout' when regexp_matches({_LOW}, 'net::err_(cert|ssl)_') then 'tls' else 'other' end as plain_kind,
  nullif(case when {_KIND} = 'timeout' then 'other' else {_KIND} end, 'other') as rule_kind,
  cast(page_id % 700 + 100 as int) as connect_status from k1 where error_text is not null"""

_TITLE = "regexp_extract(html, '(?is)<title(?:\\s[^>]*)?>(.*?)</title\\s*>', 1)"
J = f"""{K},
k2 as (select *, case when squid is not null then 'proxy_page'
    when coalesce(st >= 400, true) and lower(trim({_TITLE})) = 'error: the requested url could not be retrieved'
         and st is distinct from 403 then 'proxy_page'
    when lower(mitigated) = 'challenge' then 'challenge' end as sign,
  {_KIND} as text_kind from k1),
k3 as (select *, case when sign = 'proxy_page' then coalesce(squid, upper(regexp_extract(html, 'id=(ERR_[A-Z_]+)', 1)))
    when sign = 'challenge' then 'challenge' end as sign_detail,
  case when sign = 'proxy_page' then case when proxy is null then 'other' else 'proxy' end
       when sign = 'challenge' and proxy is not null and st is not null then 'blocked' end as sign_kind,
  file_type and st between 200 and 299 and body_text is not null as kept,
  coalesce(starts_with(error_text, 'Blocked by anti-bot protection'), false) as anti_bot from k2),
k4 as (select *, case when proxy is not null and proxy_status = 403 then 'refused'
    when sign_kind is not null then 'seen'
    when error_text is not null and anti_bot and st < 400 and file_type then case when kept then 'kept' else 'load' end
    when error_text is not null and anti_bot and st >= 400 then 'http'
    when error_text is not null and text_kind = 'non_html' then 'load'
    when error_text is not null then 'classified'
    when st >= 400 then 'http'
    when file_type and trim(html) = '' then case when kept then 'kept' else 'load' end
    else 'page' end as rule from k3),
ver as (select *, case when rule in ('page', 'kept') then rule
    when rule = 'load' and dl_error_kind is null and dl_status between 200 and 299 then 'download' else 'failed' end as verdict,
  case when rule = 'refused' then 'proxy' when rule = 'seen' then sign_kind when rule = 'http' then 'http_status'
    when rule = 'classified' then case when text_kind = 'proxy' and proxy is null then 'other' else text_kind end
    when rule = 'load' and dl_error_kind is not null then dl_error_kind end as kind,
  case when rule = 'seen' and sign_kind <> 'blocked' then sign_detail when rule = 'classified' then error_text end as detail,
  case when rule in ('seen', 'http', 'classified') then st when rule = 'load' and dl_error_kind is not null then dl_status end as jst,
  rule <> 'refused' as retriable from k4)"""
ORACLES["q_interference"] = f"""with {J} select url, attempt, sign, sign_detail as detail, sign_kind as kind from k3 where sign is not null"""
ORACLES["q_final_response"] = f"""with {K}, f as ({D.FINAL_SQL}),
 m as (select k1.*, f.status as fst from k1 left join f on attempt = 1 and (f.url = k1.url
   or (not ends_with(k1.url, '/') and f.url = k1.url || '/') or (ends_with(k1.url, '/') and f.url || '/' = k1.url)))
 select url, attempt, st as status, coalesce(fst = st, false) as by_final,
   case when fst = st then 'text/plain' else ct end as content_type from m"""
ORACLES["q_verdicts"] = f"""with {J} select url, attempt, verdict, kind, rule = 'refused' as refused, detail,
  jst as judged_status, retriable from ver"""
CH = f"""{J},
pick as (select a.url, a.verdict = 'failed' and a.retriable and a.proxy is not null and
    (a.kind in ('proxy', 'connection_refused', 'timeout', 'tls', 'blocked') or (a.kind = 'http_status' and a.jst in (407, 502, 503, 504))) as retry,
    b.url is not null as again, a.kind as kind1, a.detail as detail1, a.jst as jst1 from ver a left join ver b on a.url = b.url and b.attempt = 2 where a.attempt = 1),
ch as (select v.*, case when p.retry and p.again then kind1 end as kind1, case when p.retry and p.again then detail1 end as detail1,
    case when p.retry and p.again then jst1 end as jst1, p.retry and not p.again as retry_missing, {_TITLE} as raw_title
  from ver v join pick p on v.url = p.url and v.attempt = case when p.retry and p.again then 2 else 1 end)"""
ORACLES["q_fallback"] = f"""with {CH} select url, attempt, verdict, kind, kind1 as proxy_error_kind, retry_missing from ch"""

# --- pages ----------------------------------------------------------------------------------

_TAGS = "|".join(
    "address article aside blockquote body br dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hr html li main nav ol p pre section table tbody td tfoot th thead title tr ul".split()
)


def entities(c: str) -> str:
    for name, value in (("&copy;", "©"), ("&middot;", "·"), ("&quot;", '"'), ("&lt;", "<"), ("&gt;", ">"), ("&nbsp;", " ")):
        c = f"replace({c}, {_q(name)}, {_q(value)})"
    return f"regexp_replace({c}, '&amp;?', '&', 'g')"


def squeeze(c: str) -> str:
    return f"trim(regexp_replace({c}, '[\\s\\x{{a0}}]+', ' ', 'g'))"


def hidden(c: str) -> str:
    c = f"regexp_replace({c}, '(?s)<!--.*?(?:-->|\\z)', '', 'g')"
    for t in ("script", "style", "noscript", "template"):
        c = f"regexp_replace({c}, '(?is)<{t}\\b.*?(?:</{t}\\s*>|\\z)', '', 'g')"
    return f"regexp_replace({c}, '<[!?][^>]*>', '', 'g')"


def plain(c: str) -> str:
    return squeeze(entities(f"regexp_replace({c}, '</?[A-Za-z][^>]*>', ' ', 'g')"))


def title(c: str) -> str:
    return f"nullif(trim({entities(c)}), '')"


ORACLES["q_titles"] = f"select page_id, {title(_TITLE)} as title from pages"
ORACLES["q_tokens"] = f"""with t as (select page_id, regexp_extract_all({hidden('html')}, '</?[A-Za-z][^>]*>|[^<]+|<') as toks from pages),
 e as (select page_id, unnest(toks) as tok, unnest(range(0, len(toks))) as pos from t),
 f as (select *, regexp_matches(tok, '^</?[A-Za-z]') as is_tag from e)
 select page_id, pos, tok, case when is_tag then lower(regexp_extract(tok, '^</?([A-Za-z][A-Za-z0-9]*)', 1)) end as tag,
   starts_with(tok, '</') as closing from f where is_tag or {squeeze('tok')} <> ''"""


def blocks(source: str = "pages", keys: str = "page_id", extra: str = "") -> str:
    """CTEs ending in ``bl``, the block table of a source."""
    start = f"(</?(?:{_TAGS})(?:\\s[^>]*)?/?>)"
    depth = {n: (n,) for n in ("head", "nav", "footer", "aside", "header", "article", "main")} | {"list": ("ul", "ol"), "ol": ("ol",)}
    sums = ", ".join(
        f"sum(case when tag in ({', '.join(map(_q, t))}) then case when closing then -1 else 1 end else 0 end) over w as s_{n}"
        for n, t in depth.items()
    )
    lows = ", ".join(f"s_{n} - least(min(s_{n}) over w, 0) as d_{n}" for n in depth)
    w = f"window w as (partition by {keys} order by pos rows unbounded preceding)"
    return f"""sg0 as (select {keys}{extra}, string_split(regexp_replace({hidden('html')}, '(?i){start}', chr(1) || '\\1', 'g'), chr(1)) as parts from {source}),
sg1 as (select {keys}{extra}, unnest(parts) as seg, unnest(range(0, len(parts))) as pos from sg0),
sg2 as (select *, case when regexp_matches(seg, '(?i)^{start}') then lower(regexp_extract(seg, '^</?([A-Za-z][A-Za-z0-9]*)', 1)) end as tag,
  regexp_matches(seg, '(?i)^{start}') and starts_with(seg, '</') as closing,
  case when regexp_matches(seg, '(?i)^{start}') then regexp_replace(seg, '^</?[A-Za-z][A-Za-z0-9]*(?:\\s[^>]*)?/?>', '') else seg end as inside,
  case when regexp_matches(seg, '(?i)^{start}') then lower(regexp_extract(seg, '^<[^>]*class\\s*=\\s*"([^"]*)"', 1)) else '' end as cls from sg1),
sg3 as (select *, {sums} from sg2 {w}),
sg4 as (select *, {lows} from sg3 {w}),
bl as (select {keys}{extra}, pos, case when closing or tag is null then '' else tag end as tag,
  case when d_head > 0 then 'head' when not closing and regexp_matches(cls, '(^|[\\s_-])(ad|ads|advert|banner|sponsored)([\\s_-]|$)') then 'ad'
    when d_nav > 0 then 'nav' when d_footer > 0 then 'footer' when d_aside > 0 then 'aside' when d_header > 0 then 'header'
    when d_article > 0 then 'article' when d_main > 0 then 'main' else 'body' end as container,
  cast(d_list as int) as list_depth, d_ol > 0 and d_ol = d_list as ordered, inside, {plain('inside')} as txt,
  cast(coalesce(list_sum(list_transform(regexp_extract_all(inside, '(?is)<a\\b[^>]*>(.*?)</a\\s*>', 1),
    lambda x: length({squeeze("regexp_replace(x, '</?[A-Za-z][^>]*>', ' ', 'g')")}))), 0) as int) as link_chars
  from sg4 where {plain('inside')} <> '' or regexp_matches(inside, '(?i)<img\\b'))"""


def md(source: str, keys: str, name: str, links: bool = True) -> str:
    """CTEs ending in ``name``: Markdown per page from the block table ``source``."""
    body = "inside"
    if links:
        body = f"""regexp_replace({body}, '(?is)<a\\b[^>]*?\\shref\\s*=\\s*["'']([^"'']*)["''][^>]*>(.*?)</a\\s*>', '[\\2](\\1)', 'g')"""
    body = f"regexp_replace({body}, '(?is)<(?:b|strong)(?:\\s[^>]*)?>(.*?)</(?:b|strong)\\s*>', '**\\1**', 'g')"
    body = f"regexp_replace({body}, '(?is)<(?:i|em)(?:\\s[^>]*)?>(.*?)</(?:i|em)\\s*>', '_\\1_', 'g')"
    body = squeeze(entities(f"regexp_replace({body}, '</?[A-Za-z][^>]*>', '', 'g')"))
    return f"""{name}_b as (select *, {body} as body from {source} where container <> 'head'),
{name} as (select {keys}, ltrim(string_agg(case tag when 'li' then chr(10) when 'br' then '  ' || chr(10) else chr(10) || chr(10) end ||
   case when regexp_matches(tag, '^h[1-6]$') then repeat('#', cast(tag[2] as int)) || ' ' || body
        when tag = 'li' then repeat('  ', greatest(list_depth - 1, 0)) || case when ordered then '1. ' else '- ' end || body
        when tag = 'blockquote' then '> ' || body else body end, '' order by pos), ' ' || chr(10)) as markdown
   from {name}_b where body <> '' group by {keys})"""


ORACLES["q_blocks"] = f"with {blocks()} select page_id, pos, tag, container, list_depth, ordered, txt, link_chars from bl"
_LINKS = f"""a as (select page_id, url, regexp_extract_all({hidden('html')}, '(?is)<a\\b([^>]*)>(.*?)</a\\s*>', 1) as attrs,
   regexp_extract_all({hidden('html')}, '(?is)<a\\b([^>]*)>(.*?)</a\\s*>', 2) as inner_html from pages),
l0 as (select page_id, url, unnest(attrs) as attr, unnest(inner_html) as body, unnest(range(0, len(attrs))) as pos from a),
l as (select page_id, url, pos, nullif(regexp_extract(attr, '(?i)\\shref\\s*=\\s*"([^"]*)"', 1), '') as href, {plain('body')} as anchor from l0)"""


def resolve(base: str, ref: str) -> str:
    root = f"{scheme(base)} || '://' || {net(base)}"
    folder = f"coalesce(nullif(regexp_replace({path(base)}, '[^/]*$', ''), ''), '/')"
    bare = f"regexp_replace({base}, '#.*', '')"
    # The few dotted forms of the test data are spelled out.
    return f"""case when {ref} = '' then {bare} when regexp_matches({ref}, '^[A-Za-z][A-Za-z0-9+.-]*:') then {ref}
      when starts_with({ref}, '//') then {scheme(base)} || ':' || {ref} when starts_with({ref}, '#') then {bare} || {ref}
      when starts_with({ref}, '?') then regexp_replace({base}, '[?#].*', '') || {ref}
      when {ref} = '/x/../y/' then {root} || '/y/' when {ref} = '../up/./a.html'
        then {root} || regexp_replace({folder}, '[^/]*/$', '') || 'up/a.html'
      when starts_with({ref}, '/') then {root} || {ref} else {root} || {folder} || {ref} end"""


ORACLES["q_links"] = f"with {_LINKS} select page_id, pos, href, anchor from l where href is not null"
ORACLES["q_resolved_links"] = f"""with {_LINKS}, o as (select *, {D.ODD_HREF_SQL} as odd from l where href is not null)
  select page_id, pos, {resolve('url', 'href')} as resolved, {resolve('url', 'odd')} as odd_resolved from o"""
ORACLES["q_citation_numbers"] = f"""with {_LINKS}, t as (select page_id, {resolve('url', 'href')} as resolved, min(pos) as first_pos
  from l where href is not null group by all) select *, row_number() over (partition by page_id order by first_pos) as number from t"""
ORACLES["q_markdown_full"] = f"with {blocks()}, {md('bl', 'page_id', 'm')} select * from m"
ORACLES["q_markdown_no_links"] = f"with {blocks()}, {md('bl', 'page_id', 'm', links=False)} select * from m"


def cite(source: str) -> str:
    """CTEs ending in ``c``: cited Markdown of ``source`` (page_id, url, markdown)."""
    rx = "'(!?)\\[([^\\[\\]]*)\\]\\(([^()\\s]*)\\)'"
    return f"""x0 as (select page_id, url, markdown, regexp_extract_all(markdown, {rx}, 2) as texts,
  regexp_extract_all(markdown, {rx}, 3) as targets, string_split_regex(markdown, {rx}) as pieces from {source}),
x1 as (select page_id, url, unnest(texts) as txt, unnest(targets) as target, unnest(range(1, len(texts) + 1)) as pos from x0),
x2 as (select *, {resolve('url', 'target')} as resolved from x1),
x3 as (select page_id, resolved, min(pos) as first_pos from x2 group by all),
x4 as (select *, row_number() over (partition by page_id order by first_pos) as number from x3),
x5 as (select x2.page_id, list(txt || ' [' || number || ']' order by pos) as marks,
  string_agg(case when pos = first_pos then '[' || number || ']: ' || x2.resolved end, chr(10) order by pos) as refs
  from x2 join x4 on x2.page_id = x4.page_id and x2.resolved = x4.resolved group by x2.page_id),
c as (select x0.page_id, array_to_string(list_transform(range(1, len(pieces) + 1), lambda i: pieces[i] || coalesce(marks[i], '')), '')
   || case when refs is not null then chr(10) || chr(10) || '## References' || chr(10) || chr(10) || refs else '' end as markdown
  from x0 left join x5 on x0.page_id = x5.page_id)"""


ORACLES["q_cited_markdown"] = f"with {blocks(extra=', url')}, {md('bl', 'page_id, url', 'm')}, {cite('m')} select * from c"
_REPEATED = f"rp as (select {host('url')} as host, md5(txt) as digest, count(distinct page_id) as pages from bl group by all)"
ORACLES["q_repeated_blocks"] = f"with {blocks(extra=', url')}, {_REPEATED} select * from rp"
_FIT = f"""{blocks(extra=', url')}, {_REPEATED},
sc as (select bl.*, case when rp.pages >= 3 then 0.0 else
    case when container in ('head', 'nav', 'footer', 'aside', 'ad', 'header') then 0.0 when container in ('article', 'main') then 1.0 else 0.7 end
    * case when regexp_matches(tag, '^h[1-6]$') then 1.0 else least(cast(length(txt) as double) / 40.0, 1.0) * 0.5 + 0.5 end
    * (1 - cast(link_chars as double) / greatest(length(txt), 1)) end as score
  from bl join rp on rp.host = {host('bl.url')} and rp.digest = md5(txt)),
pg as (select page_id, bool_or(score >= 0.5) as found from sc group by page_id),
kept as (select sc.* from sc join pg using (page_id) where not found or score >= 0.5)"""
_SCORE = _FIT[_FIT.index("sc as (") :]
ORACLES["q_fit"] = f"with {_FIT}, {md('kept', 'page_id', 'm')} select * from m"
ORACLES["q_fit_notes"] = f"with {_FIT} select page_id, case when not found then 'filter_kept_nothing' end as note from pg"
ORACLES["q_fit_cited"] = f"with {_FIT}, {md('kept', 'page_id, url', 'm')}, {cite('m')} select * from c"
ORACLES["q_page_text"] = """with t as (select conv_id as doc, turn, trim(text, E' \\n\\t\\r') as tx from conversations)
  select doc, coalesce(string_agg(case when tx <> '' then tx end, chr(10) || chr(10) order by turn), '') as text from t group by doc"""

# --- outcomes -------------------------------------------------------------------------------


def outcome(rows: str, markdown: bool = True, text: str | None = None) -> str:
    """CTEs ending in ``o``: outcomes of the request rows ``rows`` (batch_id, ord, url, format, timeout_s)."""
    text = text or (
        f"{blocks('(select * from ch where verdict = ' + _q('page') + ')', 'url')}, {md('bl', 'url', 'mt')},"
        if markdown
        else "mt as (select cast(null as varchar) as url, cast(null as varchar) as markdown where false),"
    )
    return f"""{text}
o0 as (select q.batch_id, q.ord, q.format, coalesce(q.timeout_s, 60.0) as timeout, ch.*, mt.markdown,
   ch.verdict <> 'failed' as ok, ch.verdict in ('kept', 'download') as is_file,
   coalesce(ch.mt = 'application/pdf', false) as is_pdf
  from {rows} q join ch on ch.url = q.url left join mt on mt.url = q.url),
o as (select *, case when not ok then null when is_file and verdict = 'kept' then coalesce(final_url, url) when is_file then url else coalesce(final_url, url) end as o_final_url,
   case when not ok then jst when verdict = 'download' then dl_status else st end as o_status,
   case when ok and is_file then case when is_pdf then 'pdf' else 'binary' end else 'html' end as content_kind,
   case when ok then ct end as content_type,
   case when ok and not is_file then case format when 'markdown' then markdown when 'html' then html end end as o_text,
   case when ok and verdict = 'download' then dl_text when ok and is_file then body_text when ok and format = 'raw' then html end as o_data,
   case when ok and is_file then case mt when 'application/pdf' then '.pdf' when 'image/jpeg' then '.jpg' when 'image/png' then '.png' end
        when format = 'markdown' then '.md' when format = 'html' then '.html' when ok then '.html' else '.bin' end as extension,
   case when verdict = 'page' then {title('raw_title')} end as o_title,
   case when ok then null when kind in ('http_status', 'blocked') then jst when rule = 'refused' then proxy_status end as error_status,
   case when ok or kind in ('http_status', 'blocked') then null else detail end as error_detail,
   case when not ok and kind = 'proxy' then 'http://***@proxy.example:8080' end as error_proxy,
   case when kind1 is not null then 'retried_direct' end as note1,
   case when ok and is_file and is_pdf then case format when 'markdown' then 'pdf_not_converted' when 'html' then 'pdf_as_is' end
        when ok and is_file then 'not_a_page' end as note2 from o0)"""


_ALL = f"{REQ}, {CH}, alls as (select * from firsts where rn = 1)"
_LOADER = f"""{REQ}, {CH}, loads as (select f.batch_id, f.ord, f.url, 'markdown' as format, f.timeout_s
  from firsts f join sizes s using (batch_id) where rn = 1 and n_unique <= 20)"""
_O = f"{_ALL}, {outcome('alls')}"
_OF = f"{_ALL}, {outcome('alls', markdown=False)}"
_LO = f"{_LOADER}, {outcome('loads')}"
ORACLES["q_outcomes"] = f"""with {_O} select batch_id, ord, url, ok, o_final_url as final_url, cast(o_status as int) as status_code, content_kind, content_type,
  md5(o_text) as text_md5, strlen(o_data) as bytes, extension, o_title as title, case when not ok then kind end as error_kind, error_detail,
  cast(error_status as int) as error_status, error_proxy, concat_ws(',', note1, note2) as note_keys, retry_missing from o"""
ORACLES["q_documents"] = f"""with {_LO} select batch_id, ord, o_text as page_content,
  cast(to_json({{'source': url, 'url': o_final_url, 'title': o_title, 'status_code': o_status, 'content_type': content_type}}) as varchar) as metadata
  from o where ok and trim(o_text) <> ''"""
_FIT_TEXT = f"""{blocks("(select * exclude (page_id), coalesce(final_url, url) as base, url as page_id from ch where verdict = 'page')", 'url', ', page_id, base')}, {_REPEATED},
{_SCORE}, {md('kept', 'page_id, base', 'mk')}, mkb as (select page_id, base as url, markdown from mk), {cite('mkb')},
mt as (select c.page_id as url, c.markdown, pg.found from c join pg using (page_id)),"""
ORACLES["q_fit_documents"] = f"""with {_LOADER}, {outcome('loads', text=_FIT_TEXT).replace('mt.markdown,', 'mt.markdown, mt.found,')}
  select batch_id, ord, o_text as page_content, concat_ws(',', note1, note2, case when verdict = 'page' and not found then 'filter_kept_nothing' end) as note_keys
  from o where ok and trim(o_text) <> ''"""
ORACLES["q_batch_documents"] = f"""with {_LO}, d as (select batch_id, ord, {{'page_content': o_text, 'metadata':
   {{'source': url, 'url': o_final_url, 'title': o_title, 'status_code': o_status, 'content_type': content_type}}}} as doc from o where ok and trim(o_text) <> '')
  select batch_id, count(*) as n_docs, length(cast(to_json(list(doc order by ord)) as varchar)) as chars,
    md5(string_agg(md5(doc.page_content) || '|' || doc.metadata.source || '|' || doc.metadata.url, ' ' order by ord)) as digest from d group by batch_id"""
ORACLES["q_skipped"] = f"""with {_LO} select batch_id, ord, url, case when ok then 'no_text' else kind end as reason from o
  where not (ok and coalesce(trim(o_text) <> '', false))"""
ORACLES["q_batch_summary"] = f"""with {_OF} select batch_id, count_if(ok) as succeeded, count_if(not ok) as failed,
  cast(max(case when ok then 0 else 1 end) as bigint) as exit_code, not bool_or(ok) as all_failed from o group by batch_id"""
ORACLES["q_failed_lists"] = f"""with {_OF}, p as (select *, (row_number() over (partition by batch_id order by ord) - 1) // 1000 as piece from o where not ok)
  select batch_id, piece, string_agg(url, ' ' order by ord) as failed_urls from p group by batch_id, piece"""
ORACLES["q_outcome_rollup"] = f"""with {_O}, p as (select {host('url')} as host, case when ok then content_kind else kind end as kind,
  note1 is not null as retried, strlen(coalesce(o_data, o_text, '')) as b, length(o_text) as c from o)
  select host, kind, retried, count(*) as n, cast(coalesce(sum(c), 0) as bigint) as chars, cast(sum(b) as bigint) as bytes, grouping(host, kind, retried) as grouping from p group by rollup (host, kind, retried)"""
ORACLES["q_progress"] = f"""with {REQ}, f as (select batch_id, ord, url, {D.FINISHED_SQL} as finished_at from firsts where rn = 1)
  select *, row_number() over (partition by batch_id order by finished_at, ord) as done, count(*) over (partition by batch_id) as total from f"""
ORACLES["q_page_records"] = f"""with {_O} select batch_id, ord, url, o_final_url as final_url, o_title as title, ok,
  cast(o_status as int) as status_code, content_kind, content_type, strlen(o_data) as bytes, length(o_text) as chars, md5(o_text) as text_md5,
  case when not ok then kind end as error_kind, error_detail, concat_ws(',', note1, note2) as note_keys from o"""
# --- names ----------------------------------------------------------------------------------


def stem(u: str, ext: str) -> str:
    """File stem; escapes of the test URLs are spelled out."""
    segs = f"list_filter(string_split({path(u)}, '/'), lambda s: s <> '')"
    last = f"list_extract({segs}, -1)"
    cut = f"case when {_q(ext)} <> '' and ends_with({last}, {_q(ext)}) then left({last}, length({last}) - {len(ext)}) else {last} end"
    every = f"case when len({segs}) = 0 then [] else list_append({segs}[:-2], {cut}) end"
    joined = (
        f"array_to_string(list_filter(list_concat([{host(u)} || coalesce('_' || ({port(u)}), '')], {every}, [{query(u)}]), lambda s: s <> ''), '_')"
    )
    decoded = f"replace(replace({joined}, '%20', ' '), '%E3%81%82', 'あ')"
    return f"regexp_replace(regexp_replace({decoded}, '[/\\\\:*?\"<>|]', '_', 'g'), '_+', '_', 'g')"


_LONG = stem("long", "")
ORACLES["q_file_names"] = f"""with p as (select page_id, url, {D.ODD_URL_SQL} as odd, concat(url, repeat('/0123456789', 20)) as long from pages)
  select page_id, {stem('url', '.md')} || '.md' as name, {stem('url', '.html')} || '.html' as html_name, {stem('odd', '.md')} || '.md' as odd_name,
  case when strlen({_LONG}) > 200 then left({_LONG}, 200) || '-' || left(sha256(long), 8) else {_LONG} end as long_stem from p"""
_SUFFIX = "nullif(regexp_extract({p}, '[^/.][^/]*(\\.[A-Za-z0-9]{{1,8}})/*$', 1), '')".format(p=path("url"))
ORACLES["q_extensions"] = f"""with {K} select url, attempt, coalesce(case mt when 'application/pdf' then '.pdf' when 'image/jpeg' then '.jpg'
  when 'image/png' then '.png' when 'text/html' then '.html' end, {_SUFFIX}, '.bin') as extension, coalesce({_SUFFIX}, '.bin') as by_url from k1"""
ORACLES["q_allocated_names"] = f"""with p as (select page_id as ord, {host('url')} || '.md' as name, row_number() over (partition by {host('url')} order by page_id) as n from pages)
  select ord, name, case when n = 1 then name else left(name, length(name) - 3) || '-' || n || '.md' end as allocated from p"""

ORACLES["q_contested_names"] = f"""with recursive p as (select page_id % 7 as batch_id, page_id as ord, {D.CONTESTED_SQL} as name,
   row_number() over (partition by page_id % 7 order by page_id) as i from pages),
 st as (select distinct batch_id, cast(0 as bigint) as i, cast([] as varchar[]) as used, cast(null as varchar) as allocated from p
  union all select batch_id, i, list_append(used, a), a from (
    select st.batch_id, p.i, used, case when not list_contains(used, name) then name else left(name, length(name) - 3) || '-' ||
      list_min(list_filter(range(2, p.i + 3), lambda k: not list_contains(used, left(name, length(name) - 3) || '-' || k || '.md'))) || '.md' end as a
    from st join p on p.batch_id = st.batch_id and p.i = st.i + 1))
 select p.batch_id, ord, name, allocated from p join st using (batch_id, i)"""


def manifest(o: str) -> str:
    """CTEs ending in ``mf``. No two URLs of a batch share a name with numbers in the data."""
    name = (
        f"case extension when '.md' then {stem('url', '.md')} when '.html' then {stem('url', '.html')} "
        f"when '.pdf' then {stem('url', '.pdf')} when '.jpg' then {stem('url', '.jpg')} else {stem('url', '.png')} end"
    )
    return f"""{o}, {messages('o')},
n0 as (select *, {name} as stem0 from texts),
n1 as (select *, row_number() over (partition by batch_id, ok, stem0, extension order by ord) as nth from n0),
n2 as (select *, ord % 130 = 0 as unwritten, stem0 || case when nth > 1 then '-' || nth else '' end || extension as allocated from n1),
mf0 as (select *, {note_text('note1')} as text1, {note_text('note2')} as text2 from n2),
mf as (select batch_id, ord, url, ok and not unwritten as ok, case when ok and not unwritten then 'downloads/' || allocated end as path,
  case when ok and not unwritten then strlen(coalesce(o_data, o_text, '')) end as bytes, content_kind, content_type, cast(o_status as int) as status_code,
  case when ok and unwritten then 'could not be written to downloads/' || allocated || ': disk full' else message end as error,
  concat_ws(' | ', text1, text2) as notes, case when ok and not unwritten then 'https://files.example/files/t-' || batch_id || '-' || ord end as file_url,
  text1, text2, ok and unwritten as unwritten from mf0)"""


def messages(o: str, lang: str = "en") -> str:
    """CTEs ending in ``texts``: outcomes of ``o`` with the message of their error."""
    chosen = catalog.ENGLISH | (catalog.JAPANESE if lang == "ja" else {})

    def text(kind: str, detail: str, status: str, proxy: str, refused: str) -> str:
        summary = _SUMMARY.format(d=detail)
        key = (
            f"case when {kind} = 'http_status' and rs.reason is null then 'http_status_bare' when {kind} = 'proxy' and {refused} then 'proxy_refused' "
            f"when {kind} in ('tls', 'other') and coalesce(trim({detail}), '') = '' then {kind} || '_bare' else {kind} end"
        )
        fields = {
            "{url}": "url", "{status_code}": f"cast({status} as varchar)", "{reason}": "rs.reason",
            "{timeout_s}": "regexp_replace(cast(timeout as varchar), '\\.0$', '')", "{proxy}": proxy, "{summary}": summary,
        }
        out = f"(select template from tpl where tpl.key = {key})"
        for field, value in fields.items():
            out = f"replace({out}, {_q(field)}, coalesce({value}, ''))"
        return out

    return f"""tpl(key, template) as (values {_values(chosen.items())}),
rsn(code, reason) as (values {_values(rules.reason_rows())}),
texts0 as (select o.*, case when not ok then {text('kind', 'error_detail', 'error_status', 'error_proxy', "(rule = 'refused')")} end as message
  from {o} o left join rsn rs on not ok and kind = 'http_status' and rs.code = error_status),
texts as (select t.*, {text('kind1', "case when kind1 not in ('http_status', 'blocked') then detail1 end", 'jst1', "'http://***@proxy.example:8080'", 'false')} as message1
  from texts0 t left join rsn rs on kind1 = 'http_status' and rs.code = jst1)"""


def note_text(key: str) -> str:
    return f"""case {key} when 'retried_direct' then replace((select template from tpl where key = 'retried_direct'), '{{error}}', message1)
      when 'pdf_not_converted' then replace((select template from tpl where key = 'pdf_not_converted'), '{{error}}', 'no converter')
      when 'pdf_as_is' then replace((select template from tpl where key = 'pdf_as_is'), '{{format}}', format)
      when 'not_a_page' then replace((select template from tpl where key = 'not_a_page'), '{{media_type}}', mt) end"""


_NOTES = f"""ns as (select *, {note_text('note1')} as text1, {note_text('note2')} as text2 from texts),
nt as (select *, 0 as n, text1 as note from ns where text1 is not null
  union all select *, case when text1 is null then 0 else 1 end, text2 from ns where text2 is not null)"""
_MF = manifest(_O)
ORACLES["q_manifest"] = f"with {_MF} select * exclude (text1, text2, unwritten) from mf"
_ERROR_LINE = "case when contains({e}, url) then 'error: ' || {e} else 'error: ' || {e} || ': ' || url end"
ORACLES["q_download_lines"] = f"""with {_MF}, ln as (select batch_id, ord, list_filter([
    'note: ' || url || ': ' || text1, 'note: ' || url || ': ' || text2,
    case when ok then 'saved: ' || url || ' -> ' || path || ' (' || bytes || ' bytes)' else {_ERROR_LINE.format(e='error')} end,
    case when ok then 'file: ' || file_url end], lambda x: x is not null) as lines from mf)
  select batch_id, ord, unnest(range(0, len(lines))) as n, unnest(lines) as line from ln"""
ORACLES["q_log_lines"] = f"""with {_MF}, ln as (select n2.batch_id, n2.ord, list_filter([
    case when n2.ok then 'fetched: ' || n2.url || ' (HTTP ' || coalesce(cast(o_status as varchar), '-') || ', ' || n2.content_kind || ', ' ||
      case when o_text is not null then length(o_text) || ' chars' else strlen(coalesce(o_data, '')) || ' bytes' end || ')'
    when contains(message, n2.url) then 'error: ' || message else 'error: ' || message || ': ' || n2.url end,
    'note: ' || n2.url || ': ' || text1, 'note: ' || n2.url || ': ' || text2], lambda x: x is not null) as lines, n2.ok
  from n2 join mf using (batch_id, ord))
  select batch_id, ord, unnest(range(0, len(lines))) as n, unnest(list_transform(range(0, len(lines)), lambda i: case when i = 0 and not ok then 'WARNING' else 'INFO' end)) as level,
    unnest(lines) as line from ln
  union all select batch_id, ord, 1000000, case when ok then 'INFO' else 'WARNING' end,
    case when ok then 'saved: ' || url || ' -> ' || path || ' (' || bytes || ' bytes)' else {_ERROR_LINE.format(e='error')} end from mf where ok or unwritten"""
ORACLES["q_saved_summary"] = f"""with {_MF} select batch_id, count_if(ok) as saved, count_if(not ok) as failed,
  cast(max(case when ok then 0 else 1 end) as bigint) as exit_code, not bool_or(ok) as none_saved from mf group by batch_id"""
ORACLES["q_saved_lines"] = f"""with {_MF}, c as (select batch_id, count_if(ok) as s, count_if(not ok) as f from mf group by batch_id)
  select batch_id, 2 as section, 0 as ord, 0 as n, 'done: 保存 ' || s || ' 件、失敗 ' || f || ' 件' as line from c
  union all select batch_id, 2, 0, 1, 'error: ' || f || ' 件のどれも保存できません' from c where s = 0
  union all select batch_id, 3, ord, 0, '  failed: ' || url from mf where not ok"""
ORACLES["q_unsaved_lists"] = f"""with {_MF}, p as (select *, (row_number() over (partition by batch_id order by ord) - 1) // 1000 as piece from mf where not ok)
  select batch_id, piece, string_agg(url, ' ' order by ord) as failed_urls from p group by batch_id, piece"""
ORACLES["q_large_bodies"] = f"""with {_OF} select batch_id, ord, url, ok, strlen(o_data) as bytes, content_type from o where content_kind = 'binary'"""
ORACLES["q_pdf_documents"] = f"""with {_ALL}, pt as (select url, string_agg('page ' || n || ' of ' || page_id, chr(10) || chr(10) order by n) as pdf_text
    from (select url, page_id, unnest(range(1, case when page_id % 2 = 0 then 1501 else 21 end)) as n from pages where page_id % 23 = 17) where n % 7 <> 0 group by url)
  select a.batch_id, a.ord, a.url, case when ch.page_id % 5 = 4 then '.pdf' else '.md' end as extension,
    case when ch.page_id % 5 <> 4 then md5(pdf_text) end as text_md5, case when ch.page_id % 5 <> 4 then length(pdf_text) end as chars,
    case when ch.page_id % 5 = 4 then strlen(body_text) end as bytes, case when ch.page_id % 5 = 4 then 'pdf_not_converted' else '' end as note_keys
  from alls a join ch on ch.url = a.url and verdict = 'kept' and mt = 'application/pdf' left join pt on pt.url = a.url"""
_FMT = D.FORMAT_SQL.replace("doc_id", "page_id")
_PIC = ", ".join(f"{sql} as {name}" for name, sql in D.PICTURES_SQL.items())
ORACLES["q_format_outcomes"] = f"""with {CH}, q as (select page_id as ord, url, {_FMT} as format, {D.TIMEOUT_SQL} as tmo, {_PIC} from pages),
 x as (select q.ord // 40 as batch_id, q.ord, q.format, q.tmo is not null as unusable, q.pdf, q.screenshot, q.mhtml, ch.* exclude (page_id) from q join ch on ch.url = q.url),
 y as (select *, case when verdict = 'page' and format = 'pdf' and pdf is null then 'no PDF was captured'
    when verdict = 'page' and format = 'mhtml' and mhtml is null then 'no MHTML was captured'
    when verdict = 'page' and format = 'screenshot' and screenshot is null then 'no screenshot was captured'
    when verdict = 'page' and format = 'screenshot' and screenshot = 'a' then 'the screenshot cannot be read' end as missing,
    verdict in ('kept', 'download') as is_file from x),
 z as (select *, not unusable and verdict <> 'failed' and missing is null as ok,
    case format when 'raw' then null when 'screenshot' then '.png' else '.' || format end as ext from y)
 select batch_id, ord, ok, case when ok and is_file then case when mt = 'application/pdf' then 'pdf' else 'binary' end else 'html' end as content_kind,
   case when ok and is_file then case mt when 'application/pdf' then '.pdf' when 'image/jpeg' then '.jpg' else '.png' end
     when ok then coalesce(ext, '.html') else coalesce(ext, '.bin') end as extension,
   case when not ok then null when verdict = 'download' then md5(dl_text) when is_file then md5(body_text) when format = 'pdf' then md5(pdf)
     when format = 'screenshot' then md5(from_base64(screenshot)) when format = 'raw' then md5(html) end as data_md5,
   case when ok and not is_file and format = 'html' then md5(html) when ok and not is_file and format = 'mhtml' then md5(mhtml) end as text_md5,
   case when ok then null when unusable or verdict <> 'failed' then 'other' else kind end as error_kind,
   case when ok then null when unusable then 'timeout_not_positive' when missing is not null then missing
     when kind in ('http_status', 'blocked') then null else detail end as error_detail from z"""
ORACLES["q_prechecks"] = """select url, case when page_id % 14 = 7 then 'probe' when page_id % 7 in (3, 4, 5) or page_id % 14 = 6 then 'failed' else 'page' end as verdict,
  case page_id % 7 when 3 then 'browser_not_installed' when 4 then 'other' when 5 then 'timeout' when 6 then case when page_id % 2 = 0 then 'proxy' end end as kind,
  page_id % 14 = 6 as refused, case page_id % 7 when 3 then 'Executable doesn''t exist at /x' when 4 then 'net::ERR_PROXY_CONNECTION_FAILED' when 5 then 'net::ERR_TIMED_OUT' end as detail,
  not (page_id % 7 in (3, 4) or page_id % 14 = 6) as retriable from pages"""
_OWN = (
    J.replace("when lower(mitigated) = 'challenge' then 'challenge' end as sign", "when lower(mitigated) = 'challenge' then 'challenge' when ct = 'image/png' then 'own' end as sign")
    .replace("when sign = 'challenge' then 'challenge' end as sign_detail", "when sign = 'challenge' then 'challenge' when sign = 'own' then ct end as sign_detail")
    .replace("when sign = 'challenge' and proxy", "when sign in ('challenge', 'own') and proxy")
    .replace(f"{_KIND} as text_kind", f"case when contains({_LOW}, 'timeout 30000ms') then 'connection_refused' else {_KIND} end as text_kind")
)
ORACLES["q_custom_rules"] = f"with {_OWN} select url, attempt, verdict, kind, detail from ver"
ORACLES["q_unpaired"] = f"with {REQ} select distinct url from firsts where rn = 1 and length(url) % 5 = 0"
ORACLES["q_payloads"] = f"""with {_O} select batch_id, ord, extension, strlen(coalesce(o_data, o_text, '')) as bytes,
  md5(coalesce(o_data, o_text, '')) as digest from o where ok"""
ORACLES["q_error_messages"] = f"with {_OF}, {messages('o')} select batch_id, ord, message from texts where not ok"
ORACLES["q_error_messages_ja"] = f"with {_OF}, {messages('o', 'ja')} select batch_id, ord, message from texts where not ok"
ORACLES["q_note_lines"] = f"with {_OF}, {messages('o')}, {_NOTES} select batch_id, ord, cast(n as bigint) as n, 'note: ' || url || ': ' || note as line from nt"
ORACLES["q_report_lines"] = f"""with {_OF}, {messages('o')}, {_NOTES}
  select batch_id, 0 as section, ord, 'note: ' || replace((select template from tpl where key = 'duplicate_url'), '{{url}}', url) as line from firsts where rn > 1
  union all select batch_id, 1, ord, 'note: ' || url || ': ' || note from nt
  union all select batch_id, 1, ord, 'error: ' || message from texts where not ok
  union all select batch_id, 2, 0, 'done: ' || count_if(ok) || ' fetched, ' || count_if(not ok) || ' not' from o group by batch_id
  union all select batch_id, 3, ord, '  failed: ' || url from o where not ok"""
ORACLES["q_page_blocks"] = f"""with {_O}, {messages('o')}, {_NOTES},
 hd as (select *, '<!-- page: url=' || url || ' status=' || coalesce(cast(o_status as varchar), '-') || ' -->'
   || coalesce(chr(10) || '<!-- note: ' || text1 || ' -->', '') || coalesce(chr(10) || '<!-- note: ' || text2 || ' -->', '') as head,
   case when ok and starts_with(mt, 'image/') then mt end as mime from ns)
 select batch_id, ord, cast(0 as bigint) as n, 'text' as type, head || case when not ok then chr(10) || 'error: ' || message when o_text is not null then chr(10) || o_text
   when content_kind = 'html' then chr(10) || o_data
   when mime is null then chr(10) || replace(replace(replace((select template from tpl where key = 'binary'), '{{size}}', cast(strlen(o_data) as varchar)), '{{content_type}}', ct), '{{url}}', url)
   else '' end as text, cast(null as varchar) as mime from hd
 union all select batch_id, ord, 1, 'image', to_base64(encode(o_data)), mime from hd where ok and o_text is null and mime is not null"""
ORACLES["q_text_helpers"] = """select doc_id, nullif(split_part(text, chr(10), 1), '') as first,
  md5(case when ends_with(text, chr(10)) then text else text || chr(10) end) as file_md5, doc_id % 6 in (2, 4) as is_text from documents"""
ORACLES["q_markdown_images"] = """select page_id, '## Pictures ' || page_id || chr(10) || chr(10) || 'before ![A](/i/' || page_id || '.png) after' || chr(10) || chr(10) || '![B c](b.png)end' as markdown,
  '## Pictures ' || page_id || chr(10) || chr(10) || 'before after' || chr(10) || chr(10) || 'end' as without from pages"""
ORACLES["q_fit_scored"] = f"""with {blocks()}, pg as (select page_id, bool_or(length(txt) / 60.0 >= 1) as found from bl group by page_id),
 kept as (select bl.* from bl join pg using (page_id) where not found or length(txt) / 60.0 >= 1), {md('kept', 'page_id', 'm')}
 select pg.page_id, markdown, case when not found then 'filter_kept_nothing' end as note from pg left join m on m.page_id = pg.page_id"""

# --- settings, languages, artifacts, streams ------------------------------------------------

_LOC = ", ".join(f"{sql} as {name}" for name, sql in D.LOCALE_SQL.items())
ORACLES["q_languages"] = f"""with d as (select doc_id, {_LOC} from documents),
 e as (select *, lower(regexp_extract(coalesce(nullif(LANGUAGE, ''), nullif(LC_ALL, ''), nullif(LC_MESSAGES, ''), nullif(LANG, '')), '^([^:_.@]*)', 1)) as code from d),
 f as (select *, case when code in ('en', 'ja') then code end as loc from e)
 select doc_id, loc as from_locale, coalesce(case when explicit in ('en', 'ja') then explicit end, setting, loc, 'en') as language from f"""
ORACLES["q_origins"] = """select page_id, case page_id % 5 when 0 then 'https://a.example' when 1 then 'http://only.example'
  when 2 then 'http://h.example' when 3 then null else 'http://' || split_part(url, '/', 3) end as origin from pages"""
ORACLES["q_redacted"] = f"""with p as (select page_id, {D.PROXY_SQL} as proxy from pages)
  select page_id, regexp_replace(proxy, '^([a-zA-Z][a-zA-Z0-9+.\\-]*://)?[^/\\s]+@', '\\1***@') as shown, starts_with(lower(proxy), 'socks5:') as socks from p"""
ORACLES["q_proxy_check"] = f"""with p as (select page_id, trim({D.PROXY_SQL}) as t from pages),
 f as (select page_id, case when contains(t, '://') then t else 'http://' || t end as u from p),
 c as (select *, case when {scheme('u')} not in ('http', 'https', 'socks5') then 'unsupported_scheme' when {host('u')} = '' then 'missing_host'
   when {port_text('u')} is not null and ({port('u')}) is null then 'bad_port' when {port_text('u')} is null then 'missing_port' end as reason from f)
 select page_id, case when reason is null then {scheme('u')} || regexp_extract(u, '^[^:]*(:.*)$', 1) end as proxy, reason,
   regexp_replace(case when reason is null then {scheme('u')} || regexp_extract(u, '^[^:]*(:.*)$', 1) else u end, '^([a-zA-Z][a-zA-Z0-9+.\\-]*://)?[^/\\s]+@', '\\1***@') as shown from c"""
ORACLES["q_safe_directory"] = """select page_id, case page_id % 8 when 2 then 'absolute' when 3 then 'outside' when 5 then 'outside'
  when 7 then 'outside' end as reason from pages"""
_ART = """rg as (select 't' || event_id as token, 'out/' || user_id as path, event_id as seq from events where event_type = 'signup'),
dv as (select distinct 't' || (event_id - 3) as token from events where event_type in ('view', 'click')
  and event_id % 4 <> 0 and event_id % 5 <> 0 and event_id % 7 <> 0)"""
ORACLES["q_newest_artifacts"] = f"with {_ART} select * from rg order by seq desc limit 100"
ORACLES["q_live_artifacts"] = f"""with {_ART} select path, token, seq from rg where token not in (select token from dv)
  and path in (select 'out/' || user_id from events where event_type = 'purchase')"""
ORACLES["q_stream_intake"] = """select page_id as batch_id, unnest([0, 2]) as ord, unnest([url, url || '?p=1']) as url from pages where page_id % 9 in (7, 8)"""
ORACLES["q_stream_rejects"] = f"""with {_BODIES} select batch_id, cast(null as bigint) as ord, cast(null as varchar) as url_raw, reason from p where reason is not null
  union all select page_id, 3, 'mailto:x', 'invalid_url' from pages where page_id % 9 in (7, 8)"""
ORACLES["q_stream_counts"] = """select strftime(time_bucket(interval '5 minutes', ts), '%Y-%m-%d %H:%M:%S') as window_start, event_type as kind, count(*) as n
  from events group by all"""
ORACLES["q_stream_intake_once"] = ORACLES["q_stream_intake"]
ORACLES["q_stream_closed_counts"] = """with w as (select time_bucket(interval '5 minutes', ts) as s, event_type as kind, count(*) as n from events group by all)
  select strftime(s, '%Y-%m-%d %H:%M:%S') as window_start, kind, n from w
  where s + interval '5 minutes' <= (select date_trunc('millisecond', max(ts)) - interval '10 minutes' from events)"""
ORACLES["q_stream_progress"] = "select page_id // 20 as batch_id, count(*) as done, cast(20 as bigint) as total from pages group by all"
ORACLES["q_stream_retention"] = f"""with {_ART} select * from (select * from rg order by seq desc limit 500) where token not in (select token from dv)"""
