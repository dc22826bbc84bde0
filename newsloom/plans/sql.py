"""The text functions, adapters and operators again, as DuckDB SQL for the comparison of results."""

from __future__ import annotations

from ..functions import text as t
from ..functions.taxonomy import Taxonomy
from ..sources.adapters import ACTIONS, AS_OF, DEMO


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def listed(words: list[str]) -> str:
    return "[" + ", ".join(quoted(w) for w in words) + "]::VARCHAR[]"


def or_empty(x: str) -> str:
    return f"coalesce({x}, '')"


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def squeeze(x: str) -> str:
    return strip(rf"regexp_replace({x}, '\s+', ' ', 'g')")


def decode_entities(x: str) -> str:
    out = or_empty(x)
    for entity, character in t.ENTITIES:
        out = f"replace({out}, {quoted(entity)}, {quoted(character)})"
    return rf"regexp_replace({out}, '&#\d+;', ' ', 'g')"


def clean_markup(x: str) -> str:
    out = decode_entities(x)
    for pattern in t.BOILERPLATE:
        out = f"regexp_replace({out}, {quoted(pattern)}, ' ', 'g')"
    return strip(f"regexp_replace({squeeze(out)}, {quoted(t.EDGES)}, '', 'g')")


def normalise_title(x: str) -> str:
    bare = f"regexp_replace(lower({or_empty(x)}), {quoted(t.NEWS_PREFIX)}, '')"
    return squeeze(rf"regexp_replace({bare}, '[^a-z0-9\s]', '', 'g')")


def fingerprint(x: str) -> str:
    return f"substr(md5({normalise_title(x)}), 1, 16)"


def words(x: str) -> str:
    return rf"list_filter(regexp_split_to_array({or_empty(x)}, '\s+'), lambda w: w <> '')"


def word_count(x: str) -> str:
    return f"len({words(x)})::BIGINT"


def token_set(x: str) -> str:
    """Distinct words of a title; only sizes and overlaps of it are used, so its order is free."""
    return f"list_distinct({words(normalise_title(x))})"


def truncate_words(x: str, most: int) -> str:
    cut = f"rtrim(array_to_string(({words(x)})[1:{most}], ' '), {quoted(t.CUT_ENDING)}) || {quoted(t.ELLIPSIS)}"
    return f"CASE WHEN len({words(x)}) <= {most} THEN {or_empty(x)} ELSE {cut} END"


def sentences(x: str) -> str:
    return rf"string_split(regexp_replace({strip(or_empty(x))}, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))"


def first_sentences(x: str, n: int = 2) -> str:
    return f"coalesce(array_to_string((list_filter(list_transform({sentences(x)}, lambda s: {strip('s')}), lambda s: length(s) > 10))[1:{n}], ' '), '')"


def restates(summary: str, title: str, threshold: float = 0.75) -> str:
    s, title_norm = normalise_title(summary), normalise_title(title)
    overlap = f"len(list_intersect({token_set(summary)}, {token_set(title)})) / greatest(len({token_set(title)}), 1)::DOUBLE"
    return f"CASE WHEN {or_empty(summary)} = '' OR {or_empty(title)} = '' OR length({title_norm}) < 8 THEN false ELSE starts_with({s}, {title_norm}) OR {overlap} >= {threshold} END"


def contained(x: str, ws: list[str]) -> str:
    return f"len(list_filter({listed([w.lower() for w in ws])}, lambda w: contains({x}, w)))" if ws else "0"


def pillar_of(title: str, body: str, tax: Taxonomy) -> str:
    x = f"lower({or_empty(title)} || ' ' || {or_empty(body)})"
    ids = sorted(tax.pillars)
    scores = "[" + ", ".join(f"({contained(x, tax.keywords.get(i, []))} * 2 + {contained(x, [k for k, p in tax.topics.items() if p == i])} * 3)" for i in ids) + "]"
    fallback = "CASE " + " ".join(f"WHEN {contained(f'lower({or_empty(title)})', ws)} > 0 THEN {p}" for p, ws in tax.title_words) + " ELSE 1 END"
    return f"CASE WHEN list_max({scores}) = 0 THEN {fallback} ELSE {ids}[list_position({scores}, list_max({scores}))] END::INTEGER"


def scope_of(title: str, body: str, tax: Taxonomy) -> str:
    x = f"lower({or_empty(title)} || ' ' || {or_empty(body)})"
    home, local, world = (contained(x, w) for w in (tax.home_words, tax.local_words, tax.world_words))
    return f"CASE WHEN {local} >= 2 AND {home} > 0 THEN 'local' WHEN {home} > {world} THEN 'national' ELSE 'global' END"


def topics_in(x: str, tax: Taxonomy, most: int = 10) -> str:
    return f"(list_filter({listed(list(tax.topics))}, lambda k: contains(lower({x}), lower(k))))[1:{most}]"


def moment(x: str) -> str:
    return f"strftime({x}, '%Y-%m-%d %H:%M:%S')"


NOW = f"TIMESTAMP '{AS_OF}'"


def articles(tax: Taxonomy = DEMO) -> str:
    """CTEs up to `articles`."""
    return f"""
base AS (SELECT doc_id AS id, substr(({sentences('text')})[1], 1, 80) AS headline, text AS full_body, source AS source_name,
  TIMESTAMP '2024-01-01 00:00:00' + to_hours((doc_id * 337 % 720)::INTEGER) AS published_at FROM documents),
articles AS (SELECT b.*, {pillar_of('headline', 'full_body', tax)} AS pillar_id, {scope_of('headline', 'full_body', tax)} AS scope, {topics_in('full_body', tax)} AS micro_tags,
  coalesce(l.quality = 1 AND l.toxic = 0, false) AS is_trending, CASE WHEN l.toxic = 1 THEN 'negative' ELSE 'neutral' END AS sentiment
  FROM base b LEFT JOIN labels l ON b.id = l.doc_id)"""


def plain_articles() -> str:
    """CTEs up to `articles`, without what needs the taxonomy."""
    return f"""
articles AS (SELECT doc_id AS id, substr(({sentences('d.text')})[1], 1, 80) AS headline, d.text AS full_body, source AS source_name,
  TIMESTAMP '2024-01-01 00:00:00' + to_hours((doc_id * 337 % 720)::INTEGER) AS published_at,
  coalesce(l.quality = 1 AND l.toxic = 0, false) AS is_trending, CASE WHEN l.toxic = 1 THEN 'negative' ELSE 'neutral' END AS sentiment
  FROM documents d LEFT JOIN labels l USING (doc_id))"""


def actions() -> str:
    cases = " ".join(f"WHEN {quoted(k)} THEN {quoted(v)}" for k, v in ACTIONS.items())
    return f"actions AS (SELECT event_id, ts, user_id, event_id % (SELECT count(*) FROM documents) AS article_id, CASE event_type {cases} END AS action FROM events)"


def beats() -> str:
    return """beats AS (SELECT event_id, ts, user_id, event_id % (SELECT count(*) FROM documents) AS article_id, greatest(0, least(60, floor(value)))::BIGINT AS duration_sec,
  greatest(0, least(100, json_extract_string(props, '$.k')::INTEGER)) AS scroll_pct FROM events)"""


def daily() -> str:
    return "daily AS (SELECT user_id, ts::DATE AS session_date, sum(duration_sec)::BIGINT AS duration_sec, max(ts) AS last_seen FROM beats GROUP BY ALL)"


def progress() -> str:
    return """progress AS (SELECT user_id, article_id, max(scroll_pct) AS scroll_pct, sum(duration_sec)::BIGINT AS duration_sec, (max(scroll_pct) >= 80 AND count(*) >= 2) AS completed,
  min(ts) AS started_at, max(ts) AS updated_at FROM beats GROUP BY ALL)"""


def preferences() -> str:
    """CTEs up to `preferences` (needs actions and articles)."""
    return """steps AS (SELECT user_id, unnest(micro_tags[1:3]) AS topic_name, pillar_id, ts, event_id, CASE action WHEN 'like' THEN 3 WHEN 'save' THEN 5 WHEN 'read' THEN 1 WHEN 'dislike' THEN -4 ELSE 2 END AS d
  FROM actions JOIN articles ON article_id = articles.id),
folds AS (SELECT user_id, topic_name, arg_min(pillar_id, (ts, event_id)) AS pillar_id, list(d ORDER BY ts, event_id) AS ds FROM steps GROUP BY ALL),
preferences AS (SELECT user_id, topic_name, pillar_id, round(list_reduce(ds, lambda w, d: greatest(1, least(50, w + d)), 10) / 10.0::DOUBLE, 6) AS weight FROM folds)"""


def feed() -> str:
    """CTEs up to `feed` (needs actions, articles, preferences)."""
    return f"""reads AS (SELECT article_id AS id, count(*) AS engagement FROM actions WHERE action = 'read' GROUP BY 1),
candidates AS (SELECT a.*, coalesce(engagement, 0) AS engagement FROM articles a LEFT JOIN reads USING (id) WHERE published_at > {NOW} - INTERVAL 7 DAY ORDER BY published_at DESC, id DESC LIMIT 500),
by_pillar AS (SELECT user_id, pillar_id, sum(weight) AS w FROM preferences GROUP BY ALL),
by_topic AS (SELECT user_id, lower(topic_name) AS topic, arg_max(weight, topic_name) AS w FROM preferences GROUP BY ALL),
liked AS (SELECT u.user_id, c.id, coalesce(p.w, 0) AS pw FROM (SELECT DISTINCT user_id FROM preferences) u CROSS JOIN candidates c LEFT JOIN by_pillar p ON p.user_id = u.user_id AND p.pillar_id = c.pillar_id),
tagged AS (SELECT t.user_id, c.id, sum(t.w) AS tw FROM (SELECT id, unnest(micro_tags) AS tag FROM candidates) c JOIN by_topic t ON t.topic = lower(c.tag) GROUP BY ALL),
scored AS (SELECT l.user_id, l.id AS article_id, round((2 * pw + 3 * coalesce(tw, 0)) * (1 / (1 + ln(1 + date_diff('microsecond', published_at, {NOW}) / 3.6e9 / 4))) + ln(1 + engagement::DOUBLE) * 0.1
  + CASE WHEN is_trending THEN 0.5 ELSE 0 END + (('0x' || substr(md5(l.id::VARCHAR || ':' || l.user_id::VARCHAR), 1, 8))::BIGINT % 100) / 1000.0::DOUBLE, 6) AS score
  FROM liked l JOIN candidates c ON c.id = l.id LEFT JOIN tagged t ON t.user_id = l.user_id AND t.id = l.id),
feed AS (SELECT * FROM scored WHERE score > 0.05)"""


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(c.strip() for c in ctes) + "\n"
