"""The registered queries as SQL for DuckDB, written apart from the Spark plans.

Each entry is a chain of common table expressions over the same tables. The regular
expressions are ASCII where that engine's have no Unicode classes; the fixtures agree.
"""

from __future__ import annotations

from .functions import rules
from .functions.text import HEADLINE_MAX, HEADLINE_MIN, MENU_LABELS
from .sources.adapters import FORMS, KEYS, PHRASES, SUBJECTS, TICKERS, WATCHED
from .sources.dimension import DEFAULT_PRIORITY, FEEDS, RSS, SOURCES, STRUCTURED


def _q(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _list(xs: list[str]) -> str:
    return "[" + ", ".join(map(_q, xs)) + "]::VARCHAR[]"


def _squeezed(c: str) -> str:
    return rf"trim(regexp_replace({c}, '[\s\x0B\x{{85}}\x{{A0}}\x{{1680}}\x{{2000}}-\x{{200A}}\x{{2028}}\x{{2029}}\x{{202F}}\x{{205F}}\x{{3000}}]+', ' ', 'g'))"


def _unescaped(c: str) -> str:
    for name, char in (("&quot;", '"'), ("&copy;", "©"), ("&middot;", "·"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        c = f"replace({c}, '{name}', {_q(char)})"
    return c


def _clean(c: str) -> str:
    tagless = f"regexp_replace({c}, '<[^>]+>', ' ', 'g')"
    return _squeezed(_unescaped(tagless))


def _spaced(c: str) -> str:
    return f"trim(regexp_replace(lower({c}), '[^a-z0-9]+', ' ', 'g'))"


def _compact(c: str) -> str:
    return f"regexp_replace(lower({c}), '[^a-z0-9]+', '', 'g')"


def _edged(c: str) -> str:
    one = rf"regexp_replace(lower({c}), '\s+', ' ', 'g')"
    return rf"('~' || regexp_replace({one}, '([^a-z0-9])', '~\1~', 'g') || '~')"


def _item(listed: str, i: str) -> str:
    return f"split_part({_q(listed)}, '|', ({i})::INTEGER)"


def _any(c: str, patterns: list[str]) -> str:
    return f"regexp_matches({c}, {_q('(?i)' + '|'.join(patterns))})"


def _event(field: str) -> str:
    value = (lambda name, weight: _q(name)) if field == "name" else (lambda name, weight: f"{weight}::DOUBLE")
    cases = [f"WHEN {_any(c, patterns)} THEN {value(name, weight)}" for c in ("title", "summary") for name, weight, patterns in rules.EVENTS]
    return f"CASE {' '.join(cases)} ELSE {value(*rules.OTHER_EVENT)} END"


def _rounded(x: str) -> str:
    return f"CAST(printf('%.2f', {x}) AS DOUBLE)"


LINK_PARTS = r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)"


def _canonical(c: str) -> str:
    scheme, host, path = (f"regexp_extract({c}, {_q(LINK_PARTS)}, {i})" for i in (1, 2, 3))
    path = f"coalesce(nullif(regexp_replace({path}, '/+$', ''), ''), '/')"
    return f"CASE WHEN {c} = '' THEN '' ELSE (CASE WHEN {scheme} <> '' THEN lower({scheme}) || ':' ELSE '' END) || (CASE WHEN {host} <> '' THEN '//' || lower({host}) ELSE '' END) || {path} END"


K, C = "o_orderkey", "o_custkey"
SOURCE = "VALUES " + ", ".join(f"({_q(r[0])}, {_q(r[1])}, {_q(r[2])}, {r[5] or DEFAULT_PRIORITY}, {_list(r[6])})" for r in SOURCES)
TABLES = {
    "source": ([], f"SELECT * FROM ({SOURCE}) t(source_key, source_name, source_group, priority, href_contains)"),
    "article": (
        ["source"],
        f"""SELECT a.*, s.source_name, CASE WHEN a.source_group = '{RSS}' THEN a.title || (CASE WHEN a.summary <> '' THEN '. ' || a.summary ELSE '' END) ELSE '' END AS text
FROM (SELECT {K} AS article_id,
  CASE WHEN 1 + {K} % 10 <= 5 THEN '{RSS}' ELSE '{STRUCTURED}' END AS source_group,
  {_item(KEYS, f'1 + {K} % 10')} AS source_key,
  {_item(SUBJECTS, f'1 + floor({K} / 10.0)::BIGINT % 16')} || ' ' || {_item(PHRASES, f'1 + floor({K} / 160.0)::BIGINT % 17')} || (CASE WHEN {C} % 4 = 0 THEN '' ELSE ' note ' || ({C} % 97)::VARCHAR END) AS title,
  CASE WHEN {C} % 5 = 0 THEN '' ELSE {_item(SUBJECTS, f'1 + {C} % 16')} || ' ' || {_item(PHRASES, f'1 + floor({C} / 16.0)::BIGINT % 17')} || ', said ' || {_item(SUBJECTS, f'1 + floor({C} / 7.0)::BIGINT % 16')} || ' on ' || strftime(o_orderdate, '%Y-%m-%d') END AS summary,
  CASE WHEN {C} % 53 = 0 THEN '' ELSE 'https://News.example.com/story/' || ({C} % 701)::VARCHAR || (CASE WHEN {K} % 3 = 0 THEN '/?id=' || {K}::VARCHAR ELSE '' END) END AS link,
  strftime(o_orderdate, '%Y-%m-%d') AS published,
  CASE WHEN {K} % 10 = 0 THEN {_item(TICKERS, f'1 + {C} % 6')} END AS feed_ticker
FROM orders) a JOIN source s USING (source_key)""",
    ),
    "watch": ([], "SELECT * FROM (VALUES " + ", ".join(f"({o}, {_q(t)}, {_q(c)}, {_list(k)})" for o, t, c, k in WATCHED) + ") t(watch_ord, ticker, company, keywords)"),
    "raw_part": (
        [],
        f"SELECT p_partkey::INTEGER AS watch_ord, 'T' || p_partkey::VARCHAR AS ticker, trim(p_name || ' ' || {_item(FORMS, '1 + p_partkey % 5')}) AS company, CASE WHEN p_partkey % 7 <> 0 THEN [p_brand, 'Chip', split_part(p_name, ' ', 1), p_type, 'market'] ELSE []::VARCHAR[] END AS keywords FROM part",
    ),
}


def _profile(watch: str) -> str:
    low = "list_transform(keywords, lambda x: lower(x))"
    tokens = f"list_filter(regexp_extract_all(lower(company), '[a-z0-9]+'), lambda w: length(w) >= 3 AND NOT list_contains({_list(rules.LEGAL_FORMS)}, w))"
    phrases = f"list_transform(keywords, lambda x: {_squeezed('lower(x)')})"
    generic = _list(rules.GENERIC_TERMS)
    return f"""SELECT *, list_sort(list_filter(context, lambda x: NOT list_contains({generic}, x))) AS specific_terms, list_sort(list_filter(context, lambda x: list_contains({generic}, x))) AS generic_terms
FROM (SELECT *, list_distinct(list_filter(phrases, lambda x: x <> '' AND NOT list_contains(identity_terms, x))) AS context
FROM (SELECT *, list_sort(list_distinct(list_concat([lower(ticker), lower(company)], {low}))) AS watch_keywords,
  list_sort(list_distinct(list_concat([lower(ticker), {_squeezed('lower(company)')}], {tokens}))) AS identity_terms, {phrases} AS phrases
FROM {watch}) p0) p1"""


def _terms(kind: str, text: str) -> str:
    return f"list_filter({kind}_terms, lambda t: contains({text}, {_edged('t')}))"


def _hits(kind: str) -> str:
    return f"list_sort(list_distinct(list_concat({kind}_t, {kind}_s)))"


SCORE = " + ".join(f"len({k}_t) * {a}::DOUBLE + len({k}_s) * {b}::DOUBLE" for k, (a, b) in rules.POINTS.items())
SOURCE_POINTS = "CASE " + " ".join(f"WHEN source_key = '{k}' THEN {v}::DOUBLE" for k, v in rules.SOURCE_POINTS.items()) + " ELSE 0::DOUBLE END"
REASONS = [
    ("broad_roundup_pattern", "roundup"),
    ("low_relevance_score", f"relevance_score < {rules.ACCEPT}"),
    ("no_company_specific_signal", "len(m_identity) = 0 AND len(m_specific) = 0"),
    ("no_title_focus", "NOT focus"),
    ("roundup_without_focus", "roundup AND NOT focus"),
    ("weak_aggregator_match", f"source_key IN ({', '.join(map(_q, rules.WEAK_SOURCES))}) AND NOT focus AND len(m_identity) < 2"),
]
HAY = "title || ' ' || summary || CASE WHEN source_group = '" + RSS + "' THEN ' ' || text ELSE '' END"
TABLES |= {
    "profile": (["watch"], _profile("watch")),
    "part_profile": (["raw_part"], _profile("raw_part")),
    "prepared": (
        ["article"],
        f"""SELECT *, {_compact(HAY)} AS hay, {_edged('title')} AS e_title, {_edged('summary')} AS e_summary, {_event('name')} AS event_type, {_event('weight')} AS event_weight,
  {_any('title', rules.ROUNDUP)} AS roundup, {_any('title', rules.CONTEXT)} AS context_title, {_canonical('link')} AS canonical_link, {_spaced('title')} AS title_key FROM article""",
    ),
    "pair": (
        ["prepared", "profile"],
        f"""SELECT a.*, p.watch_ord, p.ticker, p.identity_terms, p.specific_terms, p.generic_terms FROM prepared a JOIN profile p
ON (a.feed_ticker IS NULL OR a.feed_ticker = p.ticker) AND len(list_filter(p.watch_keywords, lambda k: contains(a.hay, {_compact('k')}))) > 0""",
    ),
    "scored": (
        ["pair"],
        f"""SELECT *, list_filter([{', '.join(f"CASE WHEN {c} THEN '{n}' END" for n, c in REASONS)}], lambda r: r IS NOT NULL) AS reasons,
  NOT ({' OR '.join(f'({c})' for _, c in REASONS[1:])}) AS accepted
FROM (SELECT *, {_rounded(f"{SCORE} + {SOURCE_POINTS} + CASE WHEN roundup THEN {rules.ROUNDUP_POINTS}::DOUBLE ELSE 0::DOUBLE END")} AS relevance_score,
  {', '.join(f'{_hits(k)} AS m_{k}' for k in rules.POINTS)}, len(identity_t) > 0 OR len(specific_t) > 0 AS focus
FROM (SELECT *, {', '.join(f"{_terms(k, 'e_title')} AS {k}_t, {_terms(k, 'e_summary')} AS {k}_s" for k in rules.POINTS)} FROM pair) s0) s1""",
    ),
    "flagged": (
        ["scored"],
        f"""SELECT *, CASE WHEN accepted AND (context_title OR event_type = 'comparison_or_context') THEN 'title_pattern'
  WHEN NOT accepted AND len(m_identity) > 0 AND NOT roundup AND NOT focus AND relevance_score >= {rules.RELATED} AND NOT list_contains(reasons, 'weak_aggregator_match') THEN 'summary_only_identity_match' END AS related,
  NOT accepted AND NOT roundup AND relevance_score >= {rules.REVIEW} AND (len(m_identity) > 0 OR len(m_specific) > 0) AS reviewable FROM scored""",
    ),
    "key_flag": (["flagged"], "SELECT watch_ord, canonical_link, title_key, title, bool_or(related IS NOT NULL) AS has_related, bool_or(reviewable) AS has_review FROM flagged GROUP BY ALL"),
    "routed": (
        ["flagged", "key_flag"],
        """SELECT f.*, CASE WHEN related IS NOT NULL THEN 'related' WHEN accepted THEN 'primary' WHEN NOT has_related AND reviewable THEN 'review' WHEN NOT has_related AND NOT has_review THEN 'rejected' ELSE 'suppressed' END AS bucket,
  CASE WHEN related IS NOT NULL THEN related WHEN NOT accepted AND NOT has_related AND reviewable THEN 'borderline_but_relevant' END AS bucket_reason
FROM flagged f JOIN key_flag k ON f.watch_ord = k.watch_ord AND f.canonical_link = k.canonical_link AND f.title_key = k.title_key AND f.title = k.title""",
    ),
    "keyed": (
        ["flagged"],
        """SELECT *, CASE WHEN title_key <> '' AND count(*) OVER (PARTITION BY watch_ord, title_key) > 1 THEN 'title:' || title_key ELSE coalesce(nullif(canonical_link, ''), nullif(title_key, ''), nullif(link, ''), title) END AS cluster_key
FROM flagged WHERE accepted AND related IS NULL""",
    ),
    "placed": (
        ["keyed", "source"],
        "SELECT k.*, row_number() OVER (PARTITION BY watch_ord, cluster_key ORDER BY relevance_score DESC, s.priority DESC, article_id) AS place FROM keyed k JOIN source s ON k.source_key = s.source_key",
    ),
    "cover": (
        ["keyed"],
        """SELECT watch_ord, ticker, cluster_key, count(*) AS coverage_count, min(article_id) AS first_ord, list_sort(list_distinct(list(source_name))) AS names, string_agg(DISTINCT source_name, '|' ORDER BY source_name) AS coverage_sources,
  string_agg(DISTINCT source_key, '|' ORDER BY source_key) AS coverage_source_keys, coalesce(string_agg(DISTINCT nullif(canonical_link, ''), '|' ORDER BY nullif(canonical_link, '')), '') AS duplicate_links, string_agg(DISTINCT title, '|' ORDER BY title) AS merged_titles
FROM keyed GROUP BY watch_ord, ticker, cluster_key""",
    ),
    "story": (
        ["placed", "cover"],
        f"""SELECT c.*, p.article_id, p.title, p.link, p.source_key, p.source_name, p.relevance_score, p.event_type, {_rounded('p.relevance_score * p.event_weight * (1::DOUBLE + 0.15::DOUBLE * (c.coverage_count - 1))')} AS signal_strength
FROM cover c JOIN placed p ON c.watch_ord = p.watch_ord AND c.cluster_key = p.cluster_key AND p.place = 1""",
    ),
    "ranked": (["story"], "SELECT *, row_number() OVER (PARTITION BY watch_ord ORDER BY signal_strength DESC, coverage_count DESC, first_ord)::INTEGER AS story_rank FROM story"),
    "stats": (
        ["routed", "story", "watch"],
        """SELECT *, greatest(accepted_rows - story_count, 0) AS duplicates_merged FROM (
SELECT w.watch_ord, w.ticker, count(r.article_id) AS raw_rows, count(CASE WHEN bucket = 'primary' THEN 1 END) AS accepted_rows, count(CASE WHEN bucket = 'related' THEN 1 END) AS related_rows, count(CASE WHEN bucket = 'review' THEN 1 END) AS review_rows,
  count(CASE WHEN bucket = 'rejected' THEN 1 END) AS rejected_rows, count(CASE WHEN bucket = 'suppressed' THEN 1 END) AS suppressed_rows, max(coalesce(n, 0)) AS story_count
FROM watch w LEFT JOIN routed r ON w.watch_ord = r.watch_ord LEFT JOIN (SELECT watch_ord, count(*) AS n FROM story GROUP BY watch_ord) s ON s.watch_ord = w.watch_ord GROUP BY w.watch_ord, w.ticker) t""",
    ),
    "used": (
        ["routed", "ranked"],
        """SELECT watch_ord, ticker, bucket, source_name, count(*) AS n, min(a) AS a0, min(p) AS p0 FROM (
SELECT watch_ord, ticker, 'raw' AS bucket, source_name, 0 AS a, lpad(article_id::VARCHAR, 12, '0') AS p FROM routed
UNION ALL SELECT watch_ord, ticker, bucket, source_name, 0, (CASE WHEN bucket_reason = 'summary_only_identity_match' THEN '1' ELSE '0' END) || lpad(article_id::VARCHAR, 12, '0') FROM routed WHERE bucket IN ('related', 'review', 'rejected')
UNION ALL SELECT watch_ord, ticker, 'primary', source_name, 0, lpad(story_rank::VARCHAR, 12, '0') FROM ranked
UNION ALL SELECT watch_ord, ticker, 'coverage', source_name, 0, lpad(story_rank::VARCHAR, 12, '0') || source_name FROM (SELECT watch_ord, ticker, story_rank, unnest(names) AS source_name FROM ranked) u
) t GROUP BY watch_ord, ticker, bucket, source_name""",
    ),
}


def _needed(names: list[str]) -> list[str]:
    out: list[str] = []
    for n in names:
        for x in [*_needed(TABLES[n][0]), n]:
            if x not in out:
                out.append(x)
    return out


def _sql(select: str, *tables: str, **instead: str) -> str:
    """select over named tables; `instead` has other definitions of some."""
    parts = ", ".join(f"{n} AS ({instead.get(n, TABLES[n][1])})" for n in _needed(list(tables)))
    return f"WITH {parts} {select}" if parts else select


def _joined(c: str, name: str | None = None) -> str:
    return f"array_to_string({c}, '|') AS {name or c}"


STORY = "watch_ord, ticker, cluster_key, article_id, title, link, source_key, source_name, relevance_score, event_type, coverage_count, coverage_sources, coverage_source_keys, duplicate_links, merged_titles, signal_strength"
TITLE = r"regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)"
SCRIPTLESS = "html"
for _tag in ("script", "style", "noscript"):
    SCRIPTLESS = rf"regexp_replace({SCRIPTLESS}, '(?is)<{_tag}\b.*?</{_tag}\s*>', ' ', 'g')"
HOST = "regexp_extract(url, '^([a-z]+://[^/?#]*)', 1)"

ORACLES: dict[str, str] = {
    "strip_markup": f"SELECT page_id, {_clean('html')} AS clean_text FROM pages",
    "normalize_text": f"SELECT page_id, {_squeezed(_unescaped('html'))} AS clean_text FROM pages",
    "compose_text": _sql("SELECT article_id, title || (CASE WHEN summary <> '' THEN '. ' || summary ELSE '' END) AS composed FROM article", "article"),
    "normalize_phrase": f"SELECT doc_id, {_squeezed('lower(text)')} AS phrase FROM documents",
    "keyword_forms": _sql(f"SELECT article_id, {_spaced('summary')} AS spaced_form, {_compact('summary')} AS compact_form FROM article", "article"),
    "canonical_links": _sql(f"SELECT id, {_canonical('link')} AS canonical_link FROM (SELECT article_id AS id, link FROM article UNION ALL SELECT -1 - page_id, url FROM pages) t", "article"),
    "title_keys": _sql(f"SELECT article_id, {_spaced('title')} AS title_key FROM article", "article"),
    "page_titles": f"SELECT page_id, {_clean(TITLE)} AS page_title FROM pages",
    "page_text": f"SELECT page_id, {_clean(SCRIPTLESS)} AS page_text FROM pages",
    "resolve_links": f"""SELECT page_id, (n - 1)::INTEGER AS position, CASE WHEN regexp_matches(href, '^[a-z]+:') THEN href WHEN href[1:1] = '/' THEN {HOST} || href ELSE {HOST} || coalesce(nullif(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*/)', 1), ''), '/') || href END AS link
FROM (SELECT page_id, url, unnest(hrefs) AS href, unnest(range(1, len(hrefs) + 1)) AS n FROM (SELECT page_id, url, regexp_extract_all(html, '<a href="([^"]*)"', 1) AS hrefs FROM pages) p) q""",
    "probable_headlines": f"""SELECT doc_id, line, title FROM (SELECT doc_id, (n - 1)::INTEGER AS line, {_squeezed('raw')} AS title FROM (SELECT doc_id, unnest(parts) AS raw, unnest(range(1, len(parts) + 1)) AS n FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents) d) e) f
WHERE length(title) BETWEEN {HEADLINE_MIN} AND {HEADLINE_MAX} AND lower(title) NOT IN ({', '.join(map(_q, MENU_LABELS))}) AND length(title) - length(replace(title, ' ', '')) >= 2""",
    "watchlist_entries": _sql(f"SELECT watch_ord, ticker, company, {_joined('keywords')} FROM raw_part", "raw_part"),
    "company_tokens": _sql(
        f"SELECT watch_ord, array_to_string(list_filter(regexp_extract_all(lower(company), '[a-z0-9]+'), lambda w: length(w) >= 3 AND NOT list_contains({_list(rules.LEGAL_FORMS)}, w)), '|') AS tokens FROM raw_part", "raw_part"
    ),
    "watch_keywords": _sql(f"SELECT watch_ord, {_joined('watch_keywords', 'keywords')} FROM part_profile", "part_profile"),
    "ticker_profiles": _sql(f"SELECT watch_ord, ticker, {_joined('identity_terms')}, {_joined('specific_terms')}, {_joined('generic_terms')} FROM part_profile", "part_profile"),
    "select_sources_public": _sql(f"SELECT article_id, source_key FROM article WHERE source_group = '{STRUCTURED}'", "article"),
    "cap_per_source": _sql("SELECT article_id, source_key FROM (SELECT article_id, source_key, row_number() OVER (PARTITION BY source_key ORDER BY article_id) AS n FROM article) t WHERE n <= 10", "article"),
    "vendor_filter": _sql("SELECT article_id, source_name FROM article WHERE contains(lower(source_name), 'newswire')", "article"),
    "published_range": "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS published FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1997-01-01'",
    "href_filter": _sql(
        """SELECT a.article_id, a.source_key, a.link FROM (SELECT article_id, source_key, CASE WHEN article_id % 4 = 0 THEN replace(link, '/story/', '/news/') ELSE link END AS link FROM article) a JOIN source s ON a.source_key = s.source_key
WHERE len(s.href_contains) = 0 OR a.source_key = 'finviz' OR len(list_filter(s.href_contains, lambda p: contains(a.link, p))) > 0""",
        "article",
    ),
    "dedupe_links": _sql("SELECT source_key, link, min(article_id) AS article_id FROM article GROUP BY source_key, link", "article"),
    "combined_articles": _sql("SELECT article_id, source_group, title, text FROM article", "article"),
    "filter_articles": "SELECT doc_id FROM documents WHERE " + " OR ".join(f"contains(lower(text), '{w}')" for w in ("thanedble", "attion", "eriner", "thintion")),
    "route_articles": _sql("SELECT article_id, watch_ord FROM article JOIN watch ON feed_ticker IS NULL OR feed_ticker = ticker", "article", "watch"),
    "candidate_pairs": _sql("SELECT article_id, watch_ord FROM pair", "pair"),
    "keyword_prefilter": f"""WITH w AS (SELECT doc_id::INTEGER AS watch_ord, list_distinct([{_compact("'Ticker no ' || doc_id::VARCHAR")}, {_compact("a")}, {_compact("b")}]) AS words
  FROM (SELECT doc_id, string_split(text, ' ')[1] AS a, string_split(text, ' ')[3] AS b FROM documents) t WHERE length(a) BETWEEN 6 AND 40 AND length(b) BETWEEN 6 AND 40),
k AS (SELECT watch_ord, word FROM (SELECT watch_ord, unnest(words) AS word FROM w) u WHERE word <> ''), sought AS (SELECT DISTINCT word FROM k),
found AS (SELECT doc_id, word FROM (SELECT doc_id, {_compact("text")} AS hay FROM documents WHERE text IS NOT NULL) d JOIN sought ON contains(hay, word))
SELECT DISTINCT doc_id AS article_id, watch_ord FROM found JOIN k USING (word)""",
    "matched_terms": _sql(f"SELECT article_id, watch_ord, {', '.join(_joined(f'm_{k}', k) for k in rules.POINTS)} FROM scored", "scored"),
    "event_types": _sql(f"SELECT article_id, {_event('name')} AS event_type, {_event('weight')} AS weight FROM article", "article"),
    "roundup_titles": _sql(f"SELECT article_id, title FROM article WHERE {_any('title', rules.ROUNDUP)}", "article"),
    "context_titles": _sql(f"SELECT article_id, title FROM article WHERE {_any('title', rules.CONTEXT)}", "article"),
    "relevance_scores": _sql("SELECT article_id, watch_ord, relevance_score FROM scored", "scored"),
    "rejection_reasons": _sql(f"SELECT article_id, watch_ord, accepted, {_joined('reasons')} FROM scored", "scored"),
    "bucket_rows": _sql("SELECT article_id, watch_ord, bucket, bucket_reason FROM routed", "routed"),
    "suppress_by_key": _sql(
        """SELECT article_id, watch_ord, canonical_link, title_key, title FROM flagged f WHERE NOT accepted AND related IS NULL AND (
EXISTS (SELECT 1 FROM flagged g WHERE g.related IS NOT NULL AND g.watch_ord = f.watch_ord AND g.canonical_link = f.canonical_link AND g.title_key = f.title_key AND g.title = f.title)
OR (NOT reviewable AND EXISTS (SELECT 1 FROM flagged g WHERE g.reviewable AND g.watch_ord = f.watch_ord AND g.canonical_link = f.canonical_link AND g.title_key = f.title_key AND g.title = f.title)))""",
        "flagged",
    ),
    "related_context": _sql("SELECT article_id, watch_ord, bucket_reason, relevance_score FROM routed WHERE bucket = 'related'", "routed"),
    "cluster_keys": _sql("SELECT article_id, watch_ord, cluster_key FROM keyed", "keyed"),
    "story_clusters": _sql(f"SELECT {STORY} FROM story", "story"),
    "top_stories": _sql(f"SELECT {STORY}, story_rank FROM ranked", "ranked"),
    "story_members": _sql("SELECT watch_ord, ticker, cluster_key, article_id, source_key, source_name, canonical_link, title, place = 1 AS is_best FROM placed", "placed"),
    "story_coverage": _sql(
        "SELECT watch_ord, ticker, cluster_key, count(*) AS n_rows, count(DISTINCT source_name) AS n_sources, count(DISTINCT nullif(canonical_link, '')) AS n_links, count(DISTINCT title) AS n_titles FROM keyed GROUP BY watch_ord, ticker, cluster_key", "keyed"
    ),
    "ticker_stats": _sql("SELECT watch_ord, ticker, raw_rows, accepted_rows, related_rows, review_rows, rejected_rows, suppressed_rows, story_count, duplicates_merged FROM stats", "stats"),
    "watchlist_summary": _sql("SELECT watch_ord, ticker, story_count, related_rows, review_rows, rejected_rows FROM stats", "stats"),
    "source_usage": _sql("SELECT watch_ord, ticker, bucket, source_name, n FROM used", "used"),
    "source_usage_ranked": _sql("SELECT watch_ord, ticker, bucket, source_name, n, row_number() OVER (PARTITION BY watch_ord, bucket ORDER BY n DESC, p0)::INTEGER AS source_rank FROM used", "used"),
    "source_coverage": _sql("SELECT watch_ord, ticker, source_name, n FROM used WHERE bucket = 'coverage'", "used"),
    "unseen_links": _sql(
        f"SELECT article_id, link FROM article a WHERE source_group <> '{STRUCTURED}' OR NOT EXISTS (SELECT 1 FROM article s WHERE s.source_group = '{STRUCTURED}' AND CAST(s.published AS DATE) + 1 = CAST(a.published AS DATE) AND s.link = a.link)", "article"
    ),
    "first_claim": _sql(
        f"SELECT article_id, watch_ord, link FROM (SELECT *, min(CASE WHEN source_group = '{STRUCTURED}' THEN watch_ord END) OVER (PARTITION BY link) AS first_ord FROM pair) t WHERE source_group <> '{STRUCTURED}' OR watch_ord = first_ord", "pair"
    ),
    "write_snapshot": _sql("SELECT watch_ord, ticker, raw_rows, accepted_rows, related_rows, review_rows, rejected_rows, suppressed_rows, story_count, duplicates_merged FROM stats", "stats"),
    "snapshot_versions": _sql("SELECT watch_ord, ticker, raw_rows, story_count, version::INTEGER AS version FROM stats JOIN (VALUES (0), (1)) v(version) ON version = 1 OR watch_ord <= 2", "stats"),
    "write_history": _sql("SELECT s.*, t.generated_at FROM stats s JOIN (VALUES ('2024-01-01T00-00-00Z'), ('2024-01-01T00-02-00Z')) t(generated_at) ON true", "stats"),
    "history_retention": "SELECT day, n FROM (SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n, row_number() OVER (ORDER BY strftime(ts, '%Y-%m-%d') DESC) AS age FROM events GROUP BY 1) t WHERE age <= 30",
    "stream_first_seen": "SELECT DISTINCT strftime(ts, '%Y-%m-%d') AS seen_day, user_id::VARCHAR AS link FROM events",
    "read_snapshot": _sql("SELECT ticker, story_count AS n_stories, related_rows AS n_related_context, review_rows AS n_review_candidates, rejected_rows AS n_rejections FROM stats", "stats"),
    "read_sections": _sql("SELECT ticker, '2024-01-01T00:00:00Z' AS generated_at, story_count AS n_stories, related_rows AS n_related_context, review_rows AS n_review_candidates, rejected_rows AS n_rejections FROM stats", "stats"),
    "read_rss_articles": _sql(
        f"SELECT article_id, source_key, source_name, title || ' & more' AS title, summary, link, published, title || ' & more' || (CASE WHEN summary <> '' THEN '. ' || summary ELSE '' END) AS text FROM article WHERE source_group = '{RSS}'", "article"
    ),
}

GOOD, BAD = "wins|record|rise|expands|partners|upgrade|launches", "faces|settles|controls|raises|downgrade|falls|cautious"


def _count(words: str, c: str) -> str:
    return f"len(list_filter(string_split(lower({c}), ' '), lambda w: list_contains(string_split('{words}', '|'), w)))"


def _sentiment(c: str) -> str:
    good, bad = _count(GOOD, c), _count(BAD, c)
    return f"CASE WHEN {good} > {bad} THEN 'positive' WHEN {bad} > {good} THEN 'negative' ELSE 'neutral' END AS label, 0.5::DOUBLE + 0.5::DOUBLE * abs({good} - {bad}) / greatest(1, {good} + {bad}) AS score"


ORACLES["score_sentiment"] = _sql(f"SELECT article_id, {_sentiment('text')} FROM article WHERE source_group = '{RSS}'", "article")
ORACLES["overall_sentiment"] = _sql(
    f"""SELECT watch_ord, ticker, n_scored, {_rounded('m')} AS mean_score, CASE WHEN m >= 0.15::DOUBLE THEN 'Positive' WHEN m <= -0.15::DOUBLE THEN 'Negative' ELSE 'Neutral' END AS overall FROM (
SELECT watch_ord, ticker, count(*) AS n_scored, avg(CASE WHEN label = 'positive' THEN score ELSE -score END) AS m FROM (SELECT watch_ord, ticker, {_sentiment('text')} FROM pair WHERE source_group = '{RSS}') s WHERE label <> 'neutral' GROUP BY watch_ord, ticker) t""",
    "pair",
)


def _headline(c: str) -> str:
    return f"length({c}) BETWEEN {HEADLINE_MIN} AND {HEADLINE_MAX} AND lower({c}) NOT IN ({', '.join(map(_q, MENU_LABELS))}) AND length({c}) - length(replace({c}, ' ', '')) >= 2"


ORACLES["read_feed_headlines"] = _sql(
    f"SELECT article_id, source_key, title, summary, link, published FROM (SELECT article_id, source_key, source_group, '<b>' || title || '</b> & more' AS title, summary, link, published FROM article) t WHERE source_group = '{RSS}' AND {_headline('title')}",
    "article",
)
ORACLES["read_news_json"] = _sql(
    f"SELECT 'accessnewswire' AS source_key, title, summary, link, published FROM article WHERE source_group = '{STRUCTURED}' AND contains(lower(source_name), 'newswire') AND {_headline('title')}", "article"
)
ORACLES["read_paged_json"] = _sql(f"SELECT source_key, title, summary, link, published FROM article WHERE source_key = 'accessnewswire' AND {_headline('title')}", "article")
ANCHOR = r'(?is)<a href="([^"]*)"[^>]*>(.*?)</a>'
ANCHORS = f"""SELECT page_id, (n - 1)::INTEGER AS position, href, {_squeezed(_unescaped("inner_"))} AS title FROM (
SELECT page_id, url, unnest(regexp_extract_all(html, {_q(ANCHOR)}, 1)) AS href, unnest(regexp_extract_all(html, {_q(ANCHOR)}, 2)) AS inner_, unnest(range(1, len(regexp_extract_all(html, {_q(ANCHOR)})) + 1)) AS n FROM pages) p"""
ORACLES["html_anchors"] = f"SELECT a.page_id, position, {HOST} || href AS link, title, '' AS summary FROM ({ANCHORS}) a JOIN pages ON a.page_id = pages.page_id"
ORACLES["html_headlines"] = _sql(
    f"""SELECT 'finviz' AS source_key, title, link, summary FROM (
SELECT *, row_number() OVER (PARTITION BY link ORDER BY page, choice, article_id) AS place FROM (
SELECT article_id, title, floor(article_id / 100.0)::BIGINT AS page, CASE WHEN article_id % 3 = 0 THEN 0 ELSE 1 END AS choice, title || (CASE WHEN summary <> '' THEN ' ' || summary ELSE '' END) AS around,
  'https://finviz.com/' || (CASE WHEN article_id % 3 = 0 THEN 'news.ashx?v=' || (article_id % 501)::VARCHAR ELSE 'story/' || (length(summary) * 7 + length(title))::VARCHAR END) AS link,
  CASE WHEN summary <> '' THEN (title || ' ' || summary)[1:400] ELSE '' END AS summary
FROM article WHERE article_id % 50 <> 7 AND {_headline('title')}) a) b WHERE place = 1""",
    "article",
)
SEEN_DAY = "CASE article_id % 7 WHEN 2 THEN CAST(published AS DATE) + 1 WHEN 6 THEN DATE '2030-01-01' + (article_id % 2)::INTEGER ELSE CAST(published AS DATE) END"
ORACLES["published_dates"] = _sql(
    """SELECT article_id, strftime(CAST(published AS DATE) + (CASE WHEN article_id % 7 = 2 THEN 1 ELSE 0 END), '%Y-%m-%d') || (CASE article_id % 7 WHEN 0 THEN ' 00:00:00' WHEN 1 THEN ' 10:00:00' WHEN 2 THEN ' 03:30:00' WHEN 3 THEN ' 22:59:59' WHEN 4 THEN ' 21:05:00' WHEN 5 THEN ' 00:15:00' END) AS published_at FROM article""",
    "article",
)
FED = "VALUES " + ", ".join(f"({_q(k)}, {_q(url)}, {_q(notes)})" for k, (url, notes) in FEEDS.items())
ORACLES["feed_metadata"] = _sql(f"SELECT article_id, feed_ticker, replace(url, '{{ticker}}', coalesce(feed_ticker, '')) AS feed_url, notes FROM article JOIN ({FED}) f(source_key, url, notes) USING (source_key) WHERE source_group = '{RSS}'", "article")
FILED = "SELECT source_key, floor(article_id / 1000.0)::BIGINT AS g, count(*) AS n, {} AS bad FROM article WHERE source_key = '{}' GROUP BY 1, 2"
ORACLES["source_failures"] = _sql(
    f"""SELECT source_key, kind, sum(n)::BIGINT AS rows_read, sum(f)::BIGINT AS failed, coalesce(string_agg(bad || ': ' || f::VARCHAR, ', ' ORDER BY bad), '') AS errors FROM (
SELECT source_key, kind, bad, sum(CASE WHEN bad IS NULL THEN n ELSE 0 END) AS n, count(bad) AS f FROM (
SELECT source_key, 'xml' AS kind, 1 AS n, CASE WHEN article_id % 9 = 0 THEN 'MalformedXml' END AS bad FROM article WHERE source_group = '{RSS}'
UNION ALL SELECT source_key, 'grouped', n, bad FROM ({FILED.format("CASE WHEN g % 4 = 1 THEN 'MalformedJson' END", 'globenewswire')}) a
UNION ALL SELECT source_key, 'paged', n, bad FROM ({FILED.format("CASE WHEN g % 4 = 3 THEN 'MalformedJson' WHEN g % 5 = 2 THEN 'NoPageNumber' END", 'accessnewswire')}) b
UNION ALL SELECT source_key, 'html', n, bad FROM ({FILED.format("CASE WHEN g % 6 = 4 THEN 'NoAnchors' END", 'finviz')}) c
) t GROUP BY source_key, kind, bad) u GROUP BY source_key, kind""",
    "article",
)
ORACLES["quarantined"] = _sql(
    f"""SELECT source_key, 'xml' AS kind, 'MalformedXml' AS error, count(*) AS n, max(length('<item><title>' || title || '</titel></item>')) AS longest FROM article WHERE source_group = '{RSS}' AND article_id % 9 = 0 GROUP BY source_key
UNION ALL SELECT 'globenewswire', 'grouped', 'MalformedJson', count(DISTINCT floor(article_id / 1000.0)), 40 FROM article WHERE source_key = 'globenewswire' AND floor(article_id / 1000.0)::BIGINT % 4 = 1""",
    "article",
)
PAGED = "page AS (SELECT source_key, floor(article_id / 500.0)::INTEGER AS page, any_value(1) AS one FROM article WHERE source_key IN ('accessnewswire', 'prnewswire') GROUP BY 1, 2)"
ORACLES["missing_pages"] = _sql("", "article").rstrip() + f""", {PAGED},
wanted AS (SELECT source_key, unnest(range(0, max(page) + 1))::INTEGER AS page FROM page GROUP BY source_key)
SELECT w.source_key, w.page, v.landings::INTEGER AS landings FROM wanted w JOIN (VALUES (1), (2)) v(landings) ON true LEFT JOIN page p ON w.source_key = p.source_key AND w.page = p.page AND (p.page % 5 <> 3 OR landings = 2 AND p.page % 10 = 3) WHERE p.page IS NULL"""
ORACLES["read_late_pages"] = _sql(
    f"SELECT source_key, title, summary, link, published FROM (SELECT source_key, title || (CASE WHEN article_id < 500 THEN ' (corrected)' ELSE '' END) AS title, summary, link, published FROM article WHERE source_key IN ('accessnewswire', 'prnewswire') AND (floor(article_id / 500.0)::BIGINT % 5 <> 3 OR floor(article_id / 500.0)::BIGINT % 10 = 3)) t WHERE {_headline('title')}",
    "article",
)
ORACLES["usage_from_snapshot"] = _sql(
    """SELECT ticker, CASE bucket WHEN 'raw' THEN 'raw_matches' WHEN 'primary' THEN 'primary_stories' WHEN 'related' THEN 'related_context' WHEN 'review' THEN 'review_candidates' WHEN 'rejected' THEN 'rejections' ELSE 'primary_story_coverage' END AS bucket, source_name, n
FROM used WHERE bucket <> 'raw' OR ticker <> 'PANW'""",
    "used",
)
ORACLES["stream_snapshot"] = _sql(
    f"""SELECT ticker, count(DISTINCT part || ':' || cluster_key) AS n_stories, count(*)::BIGINT AS n_rows FROM (
SELECT ticker, (article_id % 2)::VARCHAR AS part, CASE WHEN title_key <> '' AND count(*) OVER (PARTITION BY article_id % 2, watch_ord, title_key) > 1 THEN 'title:' || title_key ELSE coalesce(nullif(canonical_link, ''), nullif(title_key, ''), nullif(link, ''), title) END AS cluster_key
FROM (SELECT *, min(CASE WHEN source_group = '{STRUCTURED}' THEN (article_id % 2) * 1000 + watch_ord END) OVER (PARTITION BY {SEEN_DAY}, link) AS first_claim FROM flagged) c
WHERE accepted AND related IS NULL AND (source_group <> '{STRUCTURED}' OR (article_id % 2) * 1000 + watch_ord = first_claim)) t GROUP BY ticker""",
    "flagged",
)

ORACLES["usage_from_nested"] = _sql(
    """SELECT ticker, CASE bucket WHEN 'primary' THEN 'primary_stories' WHEN 'related' THEN 'related_context' WHEN 'review' THEN 'review_candidates' WHEN 'rejected' THEN 'rejections' ELSE 'primary_story_coverage' END AS bucket, source_name, n FROM used WHERE bucket <> 'raw'""",
    "used",
)
ORACLES["stream_first_claim"] = _sql(
    f"""SELECT article_id, watch_ord, link FROM (SELECT *, min(CASE WHEN source_group = '{STRUCTURED}' THEN part * 1000 + watch_ord END) OVER (PARTITION BY published, link) AS first_claim
FROM (SELECT *, (CASE WHEN published < '1998-04-01' THEN 0 ELSE 2 END) + article_id % 2 AS part FROM pair) p) c WHERE source_group <> '{STRUCTURED}' OR part * 1000 + watch_ord = first_claim""",
    "pair",
)
# each half as entries of its own, then added up
HALVED = TABLES["pair"][1].replace("p.watch_ord,", "(p.watch_ord * 2 + a.article_id % 2)::INTEGER AS watch_ord,", 1)
ORACLES["stream_usage"] = _sql("SELECT (watch_ord // 2)::INTEGER AS watch_ord, ticker, bucket, source_name, sum(n)::BIGINT AS n FROM used GROUP BY 1, 2, 3, 4", "used", pair=HALVED)

LISTED = "array_to_string({}, '|')"
_counts = ["raw_rows", "accepted_rows", "related_rows", "review_rows", "rejected_rows", "suppressed_rows", "story_count", "duplicates_merged"]
_stats = " UNION ALL ".join(f"SELECT watch_ord, ticker, 'stats' AS section, {i}::BIGINT AS place, '{c}' AS title, NULL AS link, NULL AS source_key, NULL AS source_name, NULL AS relevance_score, NULL AS event_type, {c}::BIGINT AS n, NULL AS notes FROM stats" for i, c in enumerate(_counts))
ORACLES["watchlist_snapshot"] = _sql(
    f"""SELECT watch_ord, ticker, 'profile' AS section, 0::BIGINT AS place, company AS title, NULL AS link, NULL AS source_key, NULL AS source_name, NULL::DOUBLE AS relevance_score, NULL AS event_type, NULL::BIGINT AS n, {LISTED.format('keywords')} AS notes FROM watch
UNION ALL {_stats}
UNION ALL SELECT watch_ord, ticker, 'source_usage', 0, CASE bucket WHEN 'raw' THEN 'raw_matches' WHEN 'primary' THEN 'primary_stories' WHEN 'related' THEN 'related_context' WHEN 'review' THEN 'review_candidates' WHEN 'rejected' THEN 'rejections' ELSE 'primary_story_coverage' END, NULL, NULL, source_name, NULL, NULL, n, NULL FROM used
UNION ALL SELECT watch_ord, ticker, 'stories', story_rank, title, link, source_key, source_name, relevance_score, event_type, coverage_count, coverage_sources FROM ranked
UNION ALL SELECT watch_ord, ticker, CASE bucket WHEN 'related' THEN 'related_context' WHEN 'review' THEN 'review_candidates' ELSE 'rejections' END, article_id + (CASE WHEN bucket_reason = 'summary_only_identity_match' THEN 4611686018427387904 ELSE 0 END), title, link, source_key, source_name, relevance_score, event_type, NULL,
  CASE WHEN bucket = 'rejected' THEN {LISTED.format('reasons')} ELSE bucket_reason END FROM routed WHERE bucket IN ('related', 'review', 'rejected')""",
    "watch",
    "stats",
    "used",
    "ranked",
    "routed",
)
