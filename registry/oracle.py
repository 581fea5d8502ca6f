"""The registered queries as DuckDB SQL over the same tables."""

from __future__ import annotations

from registry.fixtures import ALLOW
from tickertide.functions.text import STOP_TOKENS

_ALLOW = ", ".join(f"'{s}'" for s in ALLOW)
_STOP = ", ".join(f"'{s}'" for s in STOP_TOKENS)
# The whitespace of normalization, as a character class DuckDB's regex engine knows.
_WS = (
    r"[\t-\r\x1c- \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)


def _strip(text: str) -> str:
    return f"regexp_replace(regexp_replace({text}, '^{_WS}+', ''), '{_WS}+$', '')"


def _norm(text: str) -> str:
    return f"trim(regexp_replace({text}, '{_WS}+', ' ', 'g'))"


def _candidates(text: str) -> str:
    # Maximal letter runs of at most five letters; sharp s is upper-cased as SS.
    runs = f"regexp_extract_all(upper(replace({text}, 'ß', 'ss')), '[A-Z]+')"
    return f"list_filter({runs}, lambda x: length(x) <= 5)"


def _first_seen(values: str) -> str:
    return f"list_filter({values}, lambda x, i: list_position({values}, x) = i)"


POSTS = f"""
base AS (
  SELECT doc_id, text, lang,
    CASE WHEN doc_id % 3 = 0 THEN 'news' ELSE 'reddit' END AS source,
    'p' || doc_id AS post_id,
    TIMESTAMP '2024-01-01' + to_seconds((doc_id * 7919) % 86400) AS created_at,
    CASE WHEN doc_id % 11 <> 0 THEN 'u' || (doc_id % 17) END AS author,
    CASE WHEN doc_id % 5 = 0 THEN ' HTTP://Ex.org/' || (doc_id % 50) || ' ' END AS url,
    (doc_id * 7 % 33)::DOUBLE / 64 AS p_pos, (doc_id * 11 % 31)::DOUBLE / 64 AS p_neg,
    ['bullish', 'bearish', 'news', 'question', 'meme', 'neutral'][(doc_id * 5) % 6 + 1] AS stance_label,
    (doc_id % 65)::DOUBLE / 64 AS stance_confidence,
    (doc_id % 9)::DOUBLE / 16 AS joy, (doc_id % 7)::DOUBLE / 16 AS optimism,
    (doc_id % 5)::DOUBLE / 16 AS sadness, (doc_id % 4)::DOUBLE / 16 AS anger
  FROM documents
),
posts AS (
  SELECT *, p_pos - p_neg AS score,
    0.65 * (CASE WHEN stance_label IN ('bullish', 'bearish') THEN stance_confidence ELSE 0 END)
      + 0.35 * abs(p_pos - p_neg) AS conviction,
    CASE WHEN source = 'news' THEN 1.2::DOUBLE ELSE 1.0::DOUBLE END AS source_weight,
    (joy > 0)::BIGINT + (optimism > 0)::BIGINT + (sadness > 0)::BIGINT + (anger > 0)::BIGINT AS n_emotions,
    CASE WHEN url <> '' THEN 'url:' || sha256(lower({_strip('url')}))
         ELSE 'txt:' || sha256(lower({_norm('text')})) END AS dedup_key
  FROM base
)"""

TICKERS = f"""{POSTS},
allowed AS (
  SELECT *, list_filter({_candidates('text')}, lambda x: list_contains([{_ALLOW}], x)) AS hits FROM posts
),
tagged AS (SELECT *, {_first_seen('hits')} AS tickers FROM allowed)"""

MENTIONS = f"""{TICKERS},
mentions AS (
  SELECT source, post_id, author, unnest(tickers) AS ticker, score, stance_label, conviction, source_weight,
    time_bucket(INTERVAL 5 MINUTE, created_at) AS bucket_start, joy, optimism, sadness, anger
  FROM tagged
)"""

# Events as posts with a single ticker.
EVENT_MENTIONS = """
mentions AS (
  SELECT CASE WHEN event_id % 3 = 0 THEN 'news' ELSE 'reddit' END AS source, 'e' || event_id AS post_id,
    user_id::VARCHAR AS author, upper(event_type) AS ticker,
    greatest(-1.0, least(1.0, value / 1000)) AS score,
    CASE WHEN value >= 100 THEN 'bullish' ELSE 'neutral' END AS stance_label,
    0.5::DOUBLE AS conviction, 1.0::DOUBLE AS source_weight,
    time_bucket(INTERVAL 5 MINUTE, ts) AS bucket_start,
    0.25::DOUBLE AS joy, 0.0::DOUBLE AS optimism, 0.0::DOUBLE AS sadness, 0.0::DOUBLE AS anger
  FROM events
)"""

_SUMS = """
    count(*)::BIGINT AS mention_count, sum(source_weight) AS weighted_mentions,
    count(DISTINCT CASE WHEN author <> '' THEN source || ':' || author END)::BIGINT AS unique_authors,
    count_if(source = 'news')::BIGINT AS news_count, count_if(source = 'reddit')::BIGINT AS reddit_count,
    sum(score) AS sentiment_sum, count(*)::BIGINT AS sentiment_count,
    count_if(stance_label = 'bullish')::BIGINT AS bullish_count,
    count_if(stance_label = 'bearish')::BIGINT AS bearish_count,
    count_if(stance_label NOT IN ('bullish', 'bearish'))::BIGINT AS neutral_count,
    sum(conviction) AS conviction_sum,
    sum(joy) AS joy_sum, sum(optimism) AS optimism_sum, sum(sadness) AS sadness_sum, sum(anger) AS anger_sum,
    count_if(joy > 0) AS joy_n, count_if(optimism > 0) AS optimism_n,
    count_if(sadness > 0) AS sadness_n, count_if(anger > 0) AS anger_n"""

_EMOTION_TEXT = """concat_ws(',',
      CASE WHEN anger_n > 0 THEN 'anger=' || (anger_sum * 16)::BIGINT END,
      CASE WHEN joy_n > 0 THEN 'joy=' || (joy_sum * 16)::BIGINT END,
      CASE WHEN optimism_n > 0 THEN 'optimism=' || (optimism_sum * 16)::BIGINT END,
      CASE WHEN sadness_n > 0 THEN 'sadness=' || (sadness_sum * 16)::BIGINT END) AS emotion_sums"""


def _rollup_cte(mentions: str, bucket: str = "bucket_start") -> str:
    return f"""{mentions},
agg AS (SELECT {bucket} AS bucket_start, ticker, {_SUMS} FROM mentions GROUP BY ALL)"""


def _flat_rollup(mentions: str, bucket: str = "bucket_start", authors: str = "unique_authors,") -> str:
    return f"""WITH {_rollup_cte(mentions, bucket)}
SELECT bucket_start, ticker, mention_count, round(weighted_mentions, 9) AS weighted_mentions, {authors}
  news_count, reddit_count, round(sentiment_sum, 9) AS sentiment_sum, sentiment_count,
  bullish_count, bearish_count, neutral_count, round(conviction_sum, 9) AS conviction_sum, {_EMOTION_TEXT}
FROM agg"""


def _trending(kind: str, minutes: int, limit: int, mentions: str = MENTIONS, as_of: str = "2024-01-02") -> str:
    return f"""WITH {_rollup_cte(mentions)}
SELECT ticker, sum(mention_count)::{kind} AS mentions,
  round(coalesce(sum(sentiment_sum) / nullif(sum(sentiment_count), 0), 0), 6) AS sentiment_mean
FROM agg WHERE bucket_start >= TIMESTAMP '{as_of}' - INTERVAL {minutes} MINUTE
GROUP BY ticker ORDER BY mentions DESC, ticker LIMIT {limit}"""


def _movers_api(
    mentions: str, as_of: str, window: int, hours: int, limit: int, post_filter: str = ""
) -> str:
    now, win = f"TIMESTAMP '{as_of}'", f"INTERVAL {window} MINUTE"
    rate = "CASE WHEN base_buckets > 0 THEN base_mentions::DOUBLE / base_buckets ELSE 0 END"
    return f"""WITH {_rollup_cte(mentions)},
win AS (
  SELECT ticker, sum(mention_count) AS mentions, sum(weighted_mentions) AS weighted_mentions,
    sum(news_count) AS news_mentions, sum(reddit_count) AS reddit_mentions,
    sum(sentiment_sum) AS sent_sum, sum(sentiment_count) AS sent_cnt,
    sum(bullish_count) AS bull, sum(bearish_count) AS bear, sum(conviction_sum) AS conv_sum,
    sum(joy_sum) AS joy_sum, sum(optimism_sum) AS optimism_sum, sum(sadness_sum) AS sadness_sum
  FROM agg WHERE bucket_start >= {now} - {win} GROUP BY ticker
),
prior AS (
  SELECT ticker, sum(mention_count) AS base_mentions, count(*) AS base_buckets FROM agg
  WHERE bucket_start >= {now} - INTERVAL {hours} HOUR AND bucket_start < {now} - {win} GROUP BY ticker
),
measured AS (
  SELECT win.*, {rate} AS base_rate_5m,
    mentions::DOUBLE / (({rate}) * {max(1, window // 5)} + 1.0) AS spike_ratio,
    CASE WHEN sent_cnt > 0 THEN sent_sum / sent_cnt ELSE 0 END AS sentiment_mean,
    CASE WHEN mentions > 0 THEN conv_sum / mentions ELSE 0 END AS conviction_mean,
    CASE WHEN bull + bear > 0 THEN bull::DOUBLE / (bull + bear) ELSE 0.5 END AS bullish_ratio,
    CASE WHEN mentions > 0 THEN ((optimism_sum + joy_sum) - sadness_sum) / mentions ELSE 0 END AS emotion_tilt,
    news_mentions > 0 AND reddit_mentions > 0 AS cross_source
  FROM win LEFT JOIN prior USING (ticker) WHERE mentions > 0
),
ranked AS (
  SELECT *, 0.45 * ln(1 + mentions::DOUBLE) + 0.35 * ln(1 + mentions::DOUBLE) * spike_ratio
    + 0.10 * greatest(0, sentiment_mean) + 0.10 * emotion_tilt + 0.10 * conviction_mean
    + 0.05 * cross_source::INT AS score
  FROM measured ORDER BY score DESC, ticker LIMIT {limit}
)
SELECT ticker, round(score, 6) AS score, mentions::BIGINT AS mentions,
  round(weighted_mentions, 6) AS weighted_mentions, round(spike_ratio, 6) AS spike_ratio,
  round(base_rate_5m, 6) AS base_rate_5m, round(sentiment_mean, 6) AS sentiment_mean,
  round(bullish_ratio, 6) AS bullish_ratio, round(conviction_mean, 6) AS conviction_mean,
  round(emotion_tilt, 6) AS emotion_tilt, news_mentions::BIGINT AS news_mentions,
  reddit_mentions::BIGINT AS reddit_mentions, cross_source
FROM ranked {post_filter}"""


def _movers_web(
    window: int, hours: int, limit: int, pre_filter: str = "", mentions: str = MENTIONS, as_of: str = "2024-01-02"
) -> str:
    now, win = f"TIMESTAMP '{as_of}'", f"INTERVAL {window} MINUTE"
    return f"""WITH {_rollup_cte(mentions)},
win AS (
  SELECT ticker, sum(mention_count)::DOUBLE AS mentions, sum(news_count)::DOUBLE AS news_mentions,
    sum(reddit_count)::DOUBLE AS reddit_mentions, sum(sentiment_sum) AS sent_sum,
    sum(sentiment_count)::DOUBLE AS sent_cnt, sum(bullish_count)::DOUBLE AS bull,
    sum(bearish_count)::DOUBLE AS bear, sum(conviction_sum) AS conv_sum
  FROM agg WHERE bucket_start >= {now} - {win} GROUP BY ticker
),
prior AS (
  SELECT ticker, sum(mention_count)::DOUBLE / greatest({hours}, 1) AS per_hour FROM agg
  WHERE bucket_start < {now} - {win} AND bucket_start >= {now} - ({win} + INTERVAL {hours} HOUR)
  GROUP BY ticker
),
scored AS (
  SELECT ticker, mentions, news_mentions, reddit_mentions,
    CASE WHEN sent_cnt > 0 THEN sent_sum / sent_cnt ELSE 0 END AS sentiment_mean,
    CASE WHEN bull + bear > 0 THEN bull / (bull + bear) ELSE 0 END AS bullish_ratio,
    CASE WHEN sent_cnt > 0 THEN conv_sum / sent_cnt ELSE 0 END AS conviction_mean,
    coalesce(per_hour, 0.0) AS baseline_per_hour,
    (mentions / greatest({window}::DOUBLE / 60.0, 0.01)) / (coalesce(per_hour, 0.0) + 1.0) AS spike_ratio,
    news_mentions > 0 AND reddit_mentions > 0 AS cross_source
  FROM win LEFT JOIN prior USING (ticker)
),
ranked AS (
  SELECT * FROM scored {pre_filter}
  ORDER BY spike_ratio * 0.45 + bullish_ratio * 0.25 + conviction_mean * 0.20 + sentiment_mean * 0.10 DESC, ticker
  LIMIT {limit}
)
SELECT ticker, mentions, news_mentions, reddit_mentions, round(sentiment_mean, 6) AS sentiment_mean,
  round(bullish_ratio, 6) AS bullish_ratio, round(conviction_mean, 6) AS conviction_mean,
  round(baseline_per_hour, 6) AS baseline_per_hour, round(spike_ratio, 6) AS spike_ratio, cross_source
FROM ranked"""


NEWS = f"""
articles AS (
  SELECT doc_id, 'q' || (doc_id % 3) AS query, 'wire' || (doc_id % 4) AS source_name,
    CASE WHEN doc_id % 11 <> 0 THEN 'u' || (doc_id % 17) END AS author,
    CASE WHEN doc_id % 13 = 0 THEN '' ELSE 'Title ' || doc_id END AS title,
    CASE WHEN doc_id % 6 <> 0 THEN {_strip('text')} ELSE '' END AS description,
    CASE WHEN doc_id % 7 = 0 THEN lang ELSE '' END AS content,
    CASE WHEN doc_id % 5 = 0 THEN '' ELSE 'http://n/' || doc_id END AS url,
    TIMESTAMP '2024-01-01' + to_seconds((doc_id * 7919) % 86400) AS local_time
  FROM documents WHERE doc_id % 10 <> 0
),
news AS (
  SELECT *,
    strftime(local_time, '%Y-%m-%dT%H:%M:%S')
      || CASE WHEN doc_id % 4 = 1 THEN '+02:00' WHEN doc_id % 4 = 2 THEN '' ELSE 'Z' END AS published,
    local_time - CASE WHEN doc_id % 4 = 1 THEN INTERVAL 2 HOUR ELSE INTERVAL 0 HOUR END AS created_at
  FROM articles
),
keyed AS (
  SELECT *, 'news_' || substring(sha256(
    (CASE WHEN url <> '' THEN url ELSE 'title:' || title END) || '|' || published), 1, 24) AS post_id
  FROM news
)"""

SOCIAL = f"""
social AS (
  SELECT 'reddit' AS source, 't3_' || conv_id || '_' || turn AS post_id,
    TIMESTAMP '2024-01-01' + to_seconds((conv_id * 617 + turn * 31) % 86400) AS created_at,
    CASE WHEN conv_id % 9 <> 0 THEN role END AS author,
    {_strip("' ' || role || chr(10) || chr(10) || CASE WHEN turn % 4 <> 3 THEN text ELSE '' END")} AS text,
    CASE WHEN turn % 2 = 0 THEN 'http://s/' || conv_id || '_' || turn END AS url,
    'sub' || (conv_id % 5) AS subreddit,
    'https://www.reddit.com/r/' || conv_id || '_' || turn AS permalink,
    conv_id::BIGINT AS score, turn::BIGINT AS num_comments
  FROM conversations
)"""

# Greedy first-seen dedup, one recursive step per kept row.
def _ttl(key: str, alias: str, seconds: int = 36000) -> str:
    return f"""WITH RECURSIVE e AS (
  SELECT 'e' || event_id AS post_id, {key} AS k, ts FROM events
),
kept AS (
  SELECT k, min(ts) AS ts FROM e GROUP BY k
  UNION ALL
  SELECT kept.k, (SELECT min(e.ts) FROM e WHERE e.k = kept.k AND e.ts > kept.ts + INTERVAL {seconds} SECOND)
  FROM kept WHERE kept.ts IS NOT NULL
)
SELECT min(e.post_id) AS post_id, e.k AS {alias}, e.ts AS created_at
FROM e JOIN kept ON e.k = kept.k AND e.ts = kept.ts GROUP BY e.k, e.ts"""


def _per_post(columns: str, source: str = POSTS, table: str = "posts") -> str:
    return f"WITH {source} SELECT post_id, {columns} FROM {table}"


def _stance() -> str:
    pairs = ", ".join(
        f"{{'label': '{label}', 'p': (doc_id * {i + 3} % 9)::DOUBLE / 16, 'r': {-i}}}"
        for i, label in enumerate(["bullish", "bearish", "news", "question", "meme", "neutral"])
    )
    return f"""WITH {POSTS}, probs AS (SELECT post_id, unnest([{pairs}]) AS s FROM posts),
top AS (SELECT post_id, max({{'p': s.p, 'r': s.r}}) AS best FROM probs GROUP BY post_id)
SELECT post_id, s.label AS label, s.p AS confidence, 6::BIGINT AS n
FROM probs JOIN top USING (post_id) WHERE s.p = best.p AND s.r = best.r"""


_ENRICHED_FLAGS = "CASE WHEN len(tickers) = 0 THEN 'no_ticker' END"
_BLANK = f"CASE WHEN {_strip('text')} = '' THEN 'empty_text' END"
_LISTED = f"""
words AS (
  SELECT doc_id, unnest({_candidates('text')}) AS s FROM documents
),
listed AS (
  SELECT s FROM words WHERE doc_id % 10 <> 7 AND doc_id % 6 <> 2 AND doc_id % 9 <> 4
)"""

# Posts that the time-to-live rule keeps, scored by the length of their text.
_KEPT = f"""{TICKERS},
n AS (SELECT *, length({_norm('text')}) AS n FROM tagged WHERE length(text) >= 1),
kept AS (
  SELECT dedup_key AS k, min(created_at) AS ts FROM n GROUP BY dedup_key
  UNION ALL
  SELECT kept.k, (SELECT min(n.created_at) FROM n
    WHERE n.dedup_key = kept.k AND n.created_at > kept.ts + INTERVAL 3600 SECOND)
  FROM kept WHERE kept.ts IS NOT NULL
),
chosen AS (
  SELECT k, ts, min({{'source': source, 'post_id': post_id}}) AS id
  FROM n JOIN kept ON dedup_key = k AND created_at = ts GROUP BY k, ts
)"""

_KEPT_MENTIONS = f"""{_KEPT},
scored AS (
  SELECT n.* EXCLUDE (score, stance_label, conviction, joy, optimism, sadness, anger),
    (n % 33)::DOUBLE / 64 - (n % 31)::DOUBLE / 64 AS score,
    CASE WHEN (n % 17) >= (n % 5) THEN 'bullish' ELSE 'meme' END AS stance_label,
    CASE WHEN n % 2 = 1 THEN (n % 9)::DOUBLE / 16 END AS joy
  FROM n JOIN chosen ON dedup_key = k AND created_at = ts AND source = id.source AND post_id = id.post_id
),
mentions AS (
  SELECT source, author, unnest(tickers) AS ticker, score, stance_label, source_weight,
    least(1.0, 0.65 * (CASE WHEN stance_label = 'bullish' THEN (n % 17)::DOUBLE / 16 ELSE 0 END) + 0.35 * abs(score))
      AS conviction,
    time_bucket(INTERVAL 5 MINUTE, created_at) AS bucket_start,
    joy, 0.0::DOUBLE AS optimism, 0.0::DOUBLE AS sadness, 0.0::DOUBLE AS anger
  FROM scored
)"""

ORACLE: dict[str, str] = {
    "normalize_text": _per_post(f"{_norm('text')} AS norm"),
    "dedup_key": _per_post("dedup_key"),
    "author_key": _per_post(
        "CASE WHEN author <> '' THEN substring(sha256(source || ':' || author), 1, 24) END AS author_key"
    ),
    "ticker_candidates": _per_post(f"array_to_string({_candidates('text')}, ',') AS found"),
    "drop_stop_tokens": _per_post(
        f"array_to_string(list_filter({_candidates('text')}, lambda x: NOT list_contains([{_STOP}], x)), ',') AS found"
    ),
    "ordered_distinct": f"""WITH {POSTS},
words AS (SELECT post_id, {_candidates('text')} AS w FROM posts),
flat AS (SELECT post_id, unnest(w) AS s, generate_subscripts(w, 1) AS i FROM words),
firsts AS (SELECT post_id, s, min(i) AS i FROM flat GROUP BY ALL)
SELECT post_id, coalesce(string_agg(s, ',' ORDER BY i), '') AS found
FROM posts LEFT JOIN firsts USING (post_id) GROUP BY post_id""",
    "keep_allowed": f"WITH {TICKERS} SELECT post_id, array_to_string(hits, ',') AS found FROM tagged",
    "extract_tickers": f"WITH {TICKERS} SELECT post_id, array_to_string(tickers, ',') AS tickers FROM tagged",
    "extract_tickers_join": f"WITH {TICKERS} SELECT post_id, array_to_string(tickers, ',') AS tickers FROM tagged",
    "extract_tickers_open": f"""WITH {POSTS},
words AS (SELECT post_id, {_candidates('text')} AS w FROM posts),
flat AS (SELECT post_id, unnest(w) AS s, generate_subscripts(w, 1) AS i FROM words),
firsts AS (SELECT post_id, s, min(i) AS i FROM flat WHERE s NOT IN ({_STOP}) GROUP BY ALL)
SELECT post_id, coalesce(string_agg(s, ',' ORDER BY i), '') AS tickers
FROM posts LEFT JOIN firsts USING (post_id) GROUP BY post_id""",
    "quality_flags": f"WITH {TICKERS} SELECT post_id, concat_ws(',', {_ENRICHED_FLAGS}, {_BLANK}) AS flags FROM tagged",
    "source_weight": _per_post("source_weight"),
    "sentiment_from_probs": _per_post(
        "p_pos AS pos, p_neg AS neg, 1 - p_pos - p_neg AS neutral, score"
    ),
    "emotion_map": f"""WITH {POSTS} SELECT * FROM (
SELECT post_id, 'joy' AS label, joy AS p FROM posts UNION ALL
SELECT post_id, 'optimism', optimism FROM posts UNION ALL
SELECT post_id, 'sadness', sadness FROM posts UNION ALL
SELECT post_id, 'anger', anger FROM posts) WHERE p > 0""",
    "stance_from_probs": _stance(),
    "conviction": _per_post("round(conviction, 9) AS conviction"),
    "enrich": f"""WITH {TICKERS}
SELECT source, post_id, created_at, author, text, url, array_to_string(tickers, ',') AS tickers,
  NULL::VARCHAR AS language, p_pos AS finbert_pos, p_neg AS finbert_neg,
  1 - p_pos - p_neg AS finbert_neutral, score AS finbert_score, n_emotions, joy, stance_label,
  stance_confidence, round(conviction, 9) AS conviction, source_weight, dedup_key,
  0.5::DOUBLE AS confidence, concat_ws(',', {_ENRICHED_FLAGS}, {_BLANK}) AS flags
FROM tagged""",
    "score_posts": f"""WITH {POSTS}, n AS (SELECT post_id, length({_norm('text')}) AS n FROM posts)
SELECT post_id, (n % 33)::DOUBLE / 64 - (n % 31)::DOUBLE / 64 AS score,
  CASE WHEN (n % 17) >= (n % 5) THEN 'bullish' ELSE 'meme' END AS label,
  greatest(n % 17, n % 5)::DOUBLE / 16 AS confidence,
  CASE WHEN n % 2 = 1 THEN (n % 9)::DOUBLE / 16 ELSE -1.0 END AS joy FROM n""",
    "floor_5m": "SELECT event_id, time_bucket(INTERVAL 5 MINUTE, ts) AS bucket_start FROM events",
    "parse_iso_utc": f"WITH {NEWS} SELECT title, created_at AS published_at FROM keyed",
    "iso_z": """SELECT event_id, CASE WHEN epoch_us(ts) % 1000000 = 0
  THEN strftime(ts, '%Y-%m-%dT%H:%M:%SZ') ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') END AS iso FROM events""",
    "time_range": f"""WITH {_rollup_cte(EVENT_MENTIONS)}
SELECT bucket_start, ticker, mention_count FROM agg
WHERE bucket_start >= TIMESTAMP '2024-01-05' AND bucket_start < TIMESTAMP '2024-01-20 12:00:00'""",
    "social_to_raw": f"WITH {SOCIAL} SELECT * FROM social",
    "news_to_raw": f"""WITH {NEWS}
SELECT 'news' AS source, post_id, created_at, author,
  concat_ws(chr(10) || chr(10), nullif(title, ''), nullif(description, ''), nullif(content, '')) AS text,
  nullif(url, '') AS url, query, source_name FROM keyed""",
    "news_post_id": f"WITH {NEWS} SELECT title, post_id FROM keyed",
    "raw_wire": f"""WITH {POSTS} SELECT source, post_id, created_at, author, text, url, lang, doc_id AS place_row,
  (doc_id % 64)::DOUBLE / 64 AS place_share, lang AS place_second, doc_id % 2 = 0 AS even FROM posts""",
    "enriched_wire": f"""WITH {TICKERS}
SELECT source, post_id, created_at, text, array_to_string(tickers, ',') AS tickers, score AS finbert_score,
  stance_label, round(conviction, 9) AS conviction, n_emotions, source_weight FROM tagged""",
    "build_symbols": f"""WITH {_LISTED}
SELECT DISTINCT s AS symbol FROM listed""",
    "validate_raw": f"""WITH {POSTS},
broken AS (
  SELECT post_id, CASE WHEN doc_id % 7 = 3 THEN '' ELSE text END AS text,
    CASE WHEN doc_id % 8 <> 5 THEN source END AS source,
    CASE WHEN doc_id % 4 <> 1 THEN created_at END AS created_at FROM posts
),
judged AS (
  SELECT *, concat_ws(',', CASE WHEN source IS NULL THEN 'source missing' END,
    CASE WHEN length(text) < 1 THEN 'text empty' END) AS errors FROM broken
)
SELECT post_id, CASE WHEN errors = '' THEN coalesce(created_at, TIMESTAMP '2024-01-01') ELSE created_at END
  AS created_at, errors FROM judged""",
    "validate_enriched": f"""WITH {POSTS},
judged AS (
  SELECT post_id, CASE WHEN stance_confidence < 0.9 THEN stance_confidence END AS sc,
    CASE WHEN source = 'reddit' THEN source_weight END AS sw,
    CASE WHEN abs(score * 3) > 1 THEN 'finbert_score out of range' ELSE '' END AS errors FROM posts
)
SELECT post_id, CASE WHEN errors = '' THEN coalesce(sc, 0.0) ELSE sc END AS stance_confidence,
  CASE WHEN errors = '' THEN coalesce(sw, 1.0) ELSE sw END AS source_weight, errors FROM judged""",
    "explode_mentions": f"""WITH {MENTIONS}
SELECT source, post_id, ticker, score AS finbert_score, source_weight FROM mentions""",
    "rollup_5m": _flat_rollup(MENTIONS),
    "rollup_5m_events": _flat_rollup(EVENT_MENTIONS),
    "emotion_sums": f"""WITH {_rollup_cte(MENTIONS)}
SELECT bucket_start, ticker, 'joy' AS label, joy_sum AS total FROM agg WHERE joy_n > 0 UNION ALL
SELECT bucket_start, ticker, 'optimism', optimism_sum FROM agg WHERE optimism_n > 0 UNION ALL
SELECT bucket_start, ticker, 'sadness', sadness_sum FROM agg WHERE sadness_n > 0 UNION ALL
SELECT bucket_start, ticker, 'anger', anger_sum FROM agg WHERE anger_n > 0 UNION ALL
SELECT bucket_start, ticker, NULL, NULL FROM agg WHERE joy_n + optimism_n + sadness_n + anger_n = 0""",
    "unique_authors": f"""WITH {_rollup_cte(MENTIONS)}
SELECT bucket_start, ticker, unique_authors FROM agg WHERE unique_authors > 0""",
    "unique_authors_hour": f"""WITH {_rollup_cte(EVENT_MENTIONS, "time_bucket(INTERVAL 1 HOUR, bucket_start)")}
SELECT bucket_start, ticker, unique_authors FROM agg WHERE unique_authors > 0""",
    "rollup_day_authors": f"""WITH {_rollup_cte(EVENT_MENTIONS, "time_bucket(INTERVAL 1 DAY, bucket_start)")}
SELECT bucket_start, ticker, mention_count, unique_authors FROM agg""",
    "rollup_to_hour": _flat_rollup(MENTIONS, "time_bucket(INTERVAL 1 HOUR, bucket_start)", ""),
    "merge_rollup": _flat_rollup(MENTIONS),
    "insert_if_absent": f"""WITH {POSTS}
SELECT source, post_id, length(text)::BIGINT + 1 AS n FROM posts WHERE source <> 'news'""",
    "trending_api": _trending("BIGINT", 600, 25),
    "trending_web": _trending("INT", 600, 10),
    "movers_api": _movers_api(MENTIONS, "2024-01-02", 240, 24, 25),
    "movers_api_join": _movers_api(MENTIONS, "2024-01-02", 240, 24, 25),
    "movers_api_cross": _movers_api(MENTIONS, "2024-01-02", 240, 24, 15, "WHERE cross_source"),
    "movers_single_scan": _movers_api(EVENT_MENTIONS, "2024-01-20", 360, 72, 25),
    "movers_web": _movers_web(240, 6, 10),
    "movers_web_join": _movers_web(240, 6, 10),
    "movers_web_cross": _movers_web(240, 6, 15, "WHERE cross_source"),
    "since_cursor": f"""WITH {SOCIAL},
near AS (
  SELECT *, row_number() OVER (PARTITION BY subreddit ORDER BY
    abs(epoch_us(created_at) - epoch_us(TIMESTAMP '2024-01-01 12:00:00')), post_id DESC) AS rn FROM social
),
spot AS (SELECT subreddit, created_at AS at_time, post_id AS at_id FROM near
  WHERE rn = 1 AND subreddit NOT IN ('sub3', 'sub4'))
SELECT subreddit, post_id, created_at FROM social LEFT JOIN spot USING (subreddit)
WHERE at_time IS NULL OR created_at > at_time OR (created_at = at_time AND post_id > at_id)""",
    "newest_per_batch": f"""WITH {SOCIAL}
SELECT subreddit, post_id, created_at FROM social
QUALIFY row_number() OVER (PARTITION BY subreddit ORDER BY created_at DESC, post_id DESC) <= 10""",
    "since_watermark": f"""WITH {NEWS}
SELECT post_id, created_at FROM keyed WHERE created_at > TIMESTAMP '2024-01-01 12:00:00'""",
    "cap_oldest": f"WITH {NEWS} SELECT post_id, created_at FROM keyed ORDER BY created_at, post_id LIMIT 50",
    "advance_cursor": f"""WITH {NEWS}, {SOCIAL}
SELECT 'reddit' AS source, 'reddit:' || subreddit AS stream_id, post_id AS cursor FROM social
QUALIFY row_number() OVER (PARTITION BY subreddit ORDER BY created_at DESC, post_id DESC) = 1
UNION ALL
SELECT 'news', 'news:default', strftime(max(created_at), '%Y-%m-%dT%H:%M:%SZ') FROM keyed""",
    "merge_cursors": """SELECT 'reddit' AS source, 'reddit:' || event_type AS stream_id,
  event_id::VARCHAR AS cursor, ts + INTERVAL 1 SECOND AS updated_at FROM events
QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts DESC) = 1""",
    "dedup_batch_ttl": _ttl("user_id || ':' || event_type", "dedup_key"),
    "dedup_batch_ttl_hot": _ttl("upper(event_type)", "kind"),
    "backfill": f"""WITH RECURSIVE {TICKERS},
n AS (SELECT *, length({_norm('text')}) AS n FROM tagged WHERE length(text) >= 1),
kept AS (
  SELECT dedup_key AS k, min(created_at) AS ts FROM n GROUP BY dedup_key
  UNION ALL
  SELECT kept.k, (SELECT min(n.created_at) FROM n
    WHERE n.dedup_key = kept.k AND n.created_at > kept.ts + INTERVAL 3600 SECOND)
  FROM kept WHERE kept.ts IS NOT NULL
),
chosen AS (
  SELECT k, ts, min({{'source': source, 'post_id': post_id}}) AS id
  FROM n JOIN kept ON dedup_key = k AND created_at = ts GROUP BY k, ts
)
SELECT source, post_id, dedup_key, array_to_string(tickers, ',') AS tickers,
  (n % 33)::DOUBLE / 64 - (n % 31)::DOUBLE / 64 AS finbert_score,
  CASE WHEN (n % 17) >= (n % 5) THEN 'bullish' ELSE 'meme' END AS stance_label
FROM n JOIN chosen ON dedup_key = k AND created_at = ts AND source = id.source AND post_id = id.post_id""",
    "stream_rollup_bounded": _flat_rollup(EVENT_MENTIONS)
    + " WHERE bucket_start + INTERVAL 5 MINUTE <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR",
    "stream_dedup_ttl": "SELECT DISTINCT user_id || ':' || event_type AS dedup_key FROM events",
    "stream_rollup": _flat_rollup(EVENT_MENTIONS),
    "stream_dedup": _ttl("user_id || ':' || event_type", "dedup_key", 3600),
    # Here a label without any probability is still one of the map.
    "stream_enrich": _flat_rollup(_KEPT_MENTIONS).replace("WITH ", "WITH RECURSIVE ", 1).replace("count_if(joy > 0)", "count(joy)"),
    "recompute_late": _flat_rollup(EVENT_MENTIONS),
    "stored_keys": """SELECT CASE WHEN event_id % 3 = 0 THEN 'news' ELSE 'reddit' END AS source, 'e' || event_id AS post_id,
  ts + CASE WHEN event_id % 10 = 5 THEN INTERVAL 40 DAY ELSE INTERVAL 0 DAY END AS created_at, user_id::VARCHAR AS author
FROM events""",
    "stream_rollup_batches": _flat_rollup(EVENT_MENTIONS),
    "rebuild_rollup": _flat_rollup(EVENT_MENTIONS),
    "stored_raw_posts": """SELECT CASE WHEN event_id % 3 = 0 THEN 'news' ELSE 'reddit' END AS source,
  'e' || event_id AS post_id, ts AS created_at, user_id::VARCHAR AS author FROM events""",
    "stored_enriched_posts": f"""WITH {EVENT_MENTIONS}
SELECT source, post_id, ticker AS tickers, stance_label, conviction FROM mentions""",
    "trending_stored": _trending("BIGINT", 600, 25, EVENT_MENTIONS, "2024-01-20"),
    "movers_api_stored": _movers_api(EVENT_MENTIONS, "2024-01-20", 360, 72, 25),
    "movers_web_stored": _movers_web(240, 6, 10, "", EVENT_MENTIONS, "2024-01-20"),
    "validate_wire": f"""WITH {POSTS}
SELECT post_id, CASE WHEN doc_id % 3 = 0 THEN created_at WHEN doc_id % 3 = 2 THEN TIMESTAMP '2024-01-01' END AS created_at,
  CASE WHEN doc_id % 3 = 1 THEN 'created_at malformed' ELSE '' END AS errors FROM posts""",
    "write_raw_topic": f"WITH {POSTS} SELECT source, post_id, created_at, author, text, url FROM posts",
    "write_enriched_topic": f"""WITH {TICKERS}
SELECT source, post_id, array_to_string(tickers, ',') AS tickers, score AS finbert_score, stance_label FROM tagged""",
    "symbol_file": f"""WITH {_LISTED}
SELECT DISTINCT s AS symbol FROM listed""",
    "has_ticker": f"WITH {TICKERS} SELECT post_id FROM tagged WHERE len(tickers) > 0",
    "load_social": f"WITH {SOCIAL} SELECT source, post_id, created_at FROM social",
    "load_news": f"WITH {NEWS} SELECT DISTINCT 'news' AS source, post_id, created_at FROM keyed",
}
