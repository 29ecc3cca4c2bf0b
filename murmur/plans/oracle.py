"""DuckDB SQL equivalents of the registered queries (the correctness oracle).

Each statement rebuilds its fixture from the driver tables with CTEs whose
definitions mirror ``murmur.sources.fixtures``; parameters (lexicon, word
lists, centres, ranks) are rendered from the same Python constants.
"""

from __future__ import annotations

from murmur.functions.text import MARK_STEPS, PART_STEPS
from murmur.plans.catalog import CONTRACTED
from murmur.schemas import DEFAULT_RANKS, NA_TOKENS, NP_TAG_PATTERN, TOP_WORDS_EXTRA_STOPWORDS
from murmur.sources import fixtures as fx

WORD_RE = r"[\p{L}\p{N}_]+"
CASED_RE = r"[\p{L}\p{N}_]+|'\p{L}+|[^\p{L}\p{N}_\t\n\x0B\f\r ]"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _case(col, pairs, default="NULL"):
    arms = " ".join(f"WHEN {q(a)} THEN {b}" for a, b in pairs)
    return f"CASE {col} {arms} ELSE {default} END"


def round2_milli(total, n):
    x = f"(CAST({total} AS DOUBLE) / CAST({n} AS DOUBLE))"
    r = f"(sign({x}) * floor(abs({x}) / 10.0 + 0.5) / 100.0)"
    return f"(CASE WHEN coalesce({n}, 0) > 0 AND {r} <> 0 THEN {r} ELSE 0.0 END)"


FX_COMMENTS = f"""
fx_comments AS (
  SELECT doc_id AS comment_id, source AS videoID,
         CAST({_case('lang', fx.LANG_CATEGORY, '-1')} AS INTEGER) AS categoryID,
         CAST(n_chars * {fx.VIEWS_PER_CHAR} AS BIGINT) AS views,
         text AS commentText
  FROM documents)"""

FX_TITLES = f"""
fx_titles AS (
  SELECT source AS videoID, 'Video ' || source AS title,
         'ch' || CAST(CAST(regexp_extract(source, '(\\d+)', 1) AS INTEGER) % {fx.CHANNELS} AS VARCHAR) AS channel,
         CAST(count(*) AS BIGINT) AS commentCount
  FROM documents GROUP BY source)"""

_LEX_VALUES = ", ".join(f"({q(w)}, {int(round(p * 1000))}, {int(round(s * 1000))})" for w, p, s in fx.LEXICON)

FX_SCORED = f"""
fx_lexicon(word, p, s) AS (VALUES {_LEX_VALUES}),
fx_tok AS (
  SELECT comment_id, unnest(regexp_extract_all(lower(coalesce(commentText, '')), '{WORD_RE}')) AS word
  FROM fx_comments),
fx_hits AS (
  SELECT t.comment_id, count(*) AS n, sum(l.p) AS ps, sum(l.s) AS ss
  FROM fx_tok t JOIN fx_lexicon l ON t.word = l.word GROUP BY t.comment_id),
fx_scored0 AS (
  SELECT c.*, {round2_milli('h.ps', 'h.n')} AS polarity, {round2_milli('h.ss', 'h.n')} AS subjectivity
  FROM fx_comments c LEFT JOIN fx_hits h ON c.comment_id = h.comment_id),
fx_scored AS (
  SELECT *, CAST(sign(polarity) AS INTEGER) AS sentimentBucket FROM fx_scored0)"""


def exact_mean2(col: str) -> str:
    """Mean of 2-decimal values from exact integer hundredths, rounded half
    away from zero to 6 places (same IEEE steps as the Spark side)."""
    x = (f"(CAST(sum(CAST(round({col} * 100) AS BIGINT)) AS DOUBLE) / CAST(count({col}) AS DOUBLE) "
         f"/ CAST(100.0 AS DOUBLE))")
    return f"(sign({x}) * floor(abs({x}) * CAST(1000000.0 AS DOUBLE) + CAST(0.5 AS DOUBLE)) / CAST(1000000.0 AS DOUBLE))"


def with_(*ctes: str) -> str:
    return "WITH " + ",".join(ctes) + "\n"


ORACLE: dict[str, str] = {}

ORACLE["entry_summary"] = with_(FX_COMMENTS, FX_TITLES, FX_SCORED) + """
SELECT t.channel, s.sentimentBucket, count(*) AS n_comments,
       """ + exact_mean2("s.polarity") + """ AS avg_polarity, """ + exact_mean2("s.subjectivity") + """ AS avg_subjectivity
FROM fx_titles t JOIN fx_scored s ON t.videoID = s.videoID
GROUP BY t.channel, s.sentimentBucket"""

ORACLE["sentiment_scores"] = with_(FX_COMMENTS, FX_SCORED) + """
SELECT comment_id, videoID, polarity, subjectivity, sentimentBucket FROM fx_scored"""


# --------------------------------------------------------------------------
# More fixtures
# --------------------------------------------------------------------------
def _clustered_cte():
    ds = []
    for cx, cy in fx.FIXED_CENTRES:
        ds.append(f"(polarity - CAST({cx!r} AS DOUBLE)) * (polarity - CAST({cx!r} AS DOUBLE)) + "
                  f"(subjectivity - CAST({cy!r} AS DOUBLE)) * (subjectivity - CAST({cy!r} AS DOUBLE))")
    lst = "[" + ", ".join(ds) + "]"
    return f"""
fx_clustered AS (
  SELECT *, CAST(list_position({lst}, list_min({lst})) - 1 AS INTEGER) AS clusters FROM fx_scored)"""


FX_CLUSTERED = _clustered_cte()

FX_EVENTS = """
fx_events AS (SELECT *, CAST(round(value * 100) AS BIGINT) AS cents FROM events)"""

FX_SCORED_EVENTS = f"""
fx_scored_events AS (
  SELECT event_id AS comment_id, CAST(user_id AS VARCHAR) AS videoID,
         CAST({_case('event_type', fx.EVENT_BUCKET)} AS INTEGER) AS sentimentBucket,
         CAST(cents % 101 AS DOUBLE) / CAST(100.0 AS DOUBLE) AS subjectivity,
         CAST(event_id % 5 AS INTEGER) AS clusters
  FROM fx_events)"""

FX_MEASURES = """
fx_measures AS (
  SELECT comment_id, videoID, 'cluster' AS measure, CAST(clusters AS DOUBLE) AS value FROM fx_scored_events
  UNION ALL SELECT comment_id, videoID, 'subjectivity', CAST(subjectivity AS DOUBLE) FROM fx_scored_events
  UNION ALL SELECT comment_id, videoID, 'sentiment', CAST(sentimentBucket AS DOUBLE) FROM fx_scored_events)"""

FX_VIDEOS = """
fx_videos AS (
  SELECT CAST(user_id AS VARCHAR) AS videoID, CAST((sum(cents) * 32) // 10 AS BIGINT) AS views,
         CAST(user_id % 8 AS INTEGER) AS categoryID
  FROM fx_events GROUP BY user_id)"""

FX_SHORT = """
fx_short AS (
  SELECT CAST(l_orderkey * 8 + l_linenumber AS BIGINT) AS comment_id, CAST(l_partkey AS VARCHAR) AS videoID,
         'quantity' AS measure, CAST(l_quantity AS DOUBLE) AS value
  FROM lineitem)"""

FX_PREDICTIONS = """
fx_predictions AS (
  SELECT l.doc_id AS id, CAST(l.quality AS VARCHAR) AS label,
         CASE WHEN d.n_chars >= 1000 THEN '1' ELSE '0' END AS prediction
  FROM labels l JOIN documents d ON l.doc_id = d.doc_id)"""

FX_LTOKS = f"""
fx_ltoks AS (
  SELECT comment_id, regexp_extract_all(lower(coalesce(commentText, '')), '{WORD_RE}') AS toks FROM fx_comments),
fx_ltok AS (
  SELECT comment_id, CAST(unnest(generate_series(0, len(toks) - 1)) AS INTEGER) AS pos, unnest(toks) AS token
  FROM fx_ltoks)"""

FX_CTOKS = f"""
fx_ctoks AS (
  SELECT comment_id, regexp_extract_all(coalesce(commentText, ''), {q(CASED_RE)}) AS toks FROM fx_comments)"""

_CAT_CODE = _case("lang", fx.LANG_CATEGORY, "-1")
FX_CATEGORIES = f"""
fx_catlang AS (
  SELECT lang, CAST(row_number() OVER (ORDER BY lang) - 1 AS INTEGER) AS pos
  FROM (SELECT DISTINCT lang FROM documents WHERE lang IN ({", ".join(q(x) for x in fx.CATEGORY_LANGS)}))),
fx_categories AS (
  SELECT pos, CAST({_CAT_CODE} AS INTEGER) AS categoryID, 'Category ' || lang AS category FROM fx_catlang)"""


def grams_sql(n: int, toks: str = "toks") -> str:
    if n == 1:
        return toks
    return (f"list_transform(generate_series(1, len({toks}) - {n - 1}), "
            f"lambda i: array_to_string({toks}[i:i + {n - 1}], ' '))")


def _words(ws) -> str:
    return ", ".join(q(w) for w in ws)


def _pivot_sql(src: str, measures, ranks, require: int | None) -> str:
    cols = ", ".join(f"max(value) FILTER (WHERE measure = {q(m)} AND rn = {r}) AS {m}_{r}"
                     for m in measures for r in ranks)
    having = ""
    if require is not None:
        having = "HAVING " + " AND ".join(
            f"count(*) FILTER (WHERE measure = {q(m)} AND rn = {require}) > 0" for m in measures)
    return f"""
  SELECT videoID, {cols}
  FROM (SELECT videoID, measure, value,
               row_number() OVER (PARTITION BY videoID, measure ORDER BY value DESC, comment_id) AS rn
        FROM {src})
  WHERE rn <= {max(ranks)}
  GROUP BY videoID {having}"""


MEASURE_NAMES = ("cluster", "subjectivity", "sentiment")
FEATURE_COLS = ", ".join(f"f.{m}_{r}" for m in MEASURE_NAMES for r in DEFAULT_RANKS)
NA_LIST = ", ".join(q(x) for x in NA_TOKENS)

# --------------------------------------------------------------------------
# Sources
# --------------------------------------------------------------------------
ORACLE["read_comments_csv"] = with_(FX_COMMENTS) + f"""
SELECT comment_id, videoID, categoryID, views,
       CASE WHEN commentText IN ({NA_LIST}) THEN NULL ELSE commentText END AS commentText
FROM fx_comments"""

ORACLE["read_titles_csv"] = with_(FX_TITLES) + "SELECT videoID, title, channel, commentCount FROM fx_titles"

ORACLE["category_dim"] = with_(FX_CATEGORIES) + "SELECT categoryID, category FROM fx_categories"

ORACLE["category_cast"] = with_(FX_CATEGORIES) + "SELECT pos, categoryID, category FROM fx_categories"

ORACLE["csv_roundtrip"] = with_(FX_COMMENTS, FX_SCORED) + """
SELECT comment_id, videoID, polarity, subjectivity, sentimentBucket FROM fx_scored"""

# --------------------------------------------------------------------------
# Projections, predicates, derived columns
# --------------------------------------------------------------------------
ORACLE["project_features"] = with_(FX_COMMENTS) + "SELECT comment_id, videoID, categoryID, views FROM fx_comments"

ORACLE["filter_channel"] = with_(FX_COMMENTS, FX_TITLES) + """
SELECT c.comment_id, c.videoID, t.channel, t.title
FROM fx_titles t JOIN fx_comments c ON t.videoID = c.videoID WHERE t.channel = 'ch1'"""

ORACLE["filter_sentiment"] = with_(FX_COMMENTS, FX_SCORED) + """
SELECT comment_id, polarity, sentimentBucket FROM fx_scored WHERE CAST(sentimentBucket AS DOUBLE) = 1.0"""

ORACLE["filter_cluster"] = with_(FX_COMMENTS, FX_SCORED, FX_CLUSTERED) + """
SELECT comment_id, polarity, subjectivity, clusters FROM fx_clustered WHERE clusters = 2"""

ORACLE["sentiment_bucket"] = with_(FX_COMMENTS, FX_SCORED) + """
SELECT comment_id, polarity, sentimentBucket FROM fx_scored"""

ORACLE["log2_views"] = with_(FX_COMMENTS) + """
SELECT comment_id, views, round(CASE WHEN views = 0 THEN CAST('-inf' AS DOUBLE) ELSE log2(views) END, 6) AS log2_views
FROM fx_comments"""

ORACLE["views_bucket"] = with_(FX_COMMENTS) + f"""
SELECT comment_id, views,
       CASE WHEN views < {2 ** 20} THEN '1' WHEN views > {2 ** 20} THEN '2' END AS viewsBucket
FROM fx_comments"""

ORACLE["views_bucket4"] = with_(FX_COMMENTS) + f"""
SELECT comment_id, views,
       CASE WHEN views <= {2 ** 18} THEN '1' WHEN views <= {2 ** 20} THEN '2'
            WHEN views <= {2 ** 22} THEN '3' WHEN views IS NOT NULL THEN '4' END AS viewsBucket4
FROM fx_comments"""

ORACLE["drop_short_videos"] = with_(FX_SHORT) + _pivot_sql("fx_short", ["quantity"], DEFAULT_RANKS, 41)

ORACLE["quote_text"] = with_(FX_COMMENTS) + """
SELECT comment_id, '"' || commentText || '"' AS quoted FROM fx_comments"""

# --------------------------------------------------------------------------
# Joins
# --------------------------------------------------------------------------
ORACLE["join_category"] = with_(FX_COMMENTS, FX_CATEGORIES) + """
SELECT c.comment_id, c.categoryID, k.category FROM fx_comments c JOIN fx_categories k ON c.categoryID = k.categoryID"""

ORACLE["join_titles"] = with_(FX_COMMENTS, FX_TITLES) + """
SELECT c.comment_id, c.videoID, t.title, t.channel, t.commentCount
FROM fx_comments c JOIN fx_titles t ON c.videoID = t.videoID"""

ORACLE["feature_join"] = with_(FX_EVENTS, FX_SCORED_EVENTS, FX_MEASURES, FX_VIDEOS,
                               "fx_feat AS (" + _pivot_sql("fx_measures", MEASURE_NAMES, DEFAULT_RANKS, 41) + ")") + f"""
SELECT v.videoID, v.views, v.categoryID, {FEATURE_COLS}
FROM (SELECT DISTINCT videoID, views, categoryID FROM fx_videos) v JOIN fx_feat f ON v.videoID = f.videoID"""

ORACLE["remove_stopwords"] = with_(FX_COMMENTS, FX_LTOKS) + f"""
SELECT comment_id, pos, token FROM fx_ltok WHERE token NOT IN ({_words(fx.stopword_list())})"""

# --------------------------------------------------------------------------
# Distinct, sampling, splitting
# --------------------------------------------------------------------------
ORACLE["dedupe_comments"] = with_(FX_COMMENTS, FX_TITLES) + """
SELECT DISTINCT c.videoID, c.categoryID, c.commentText, t.channel
FROM fx_comments c JOIN fx_titles t ON c.videoID = t.videoID"""

ORACLE["distinct_videos"] = with_(FX_COMMENTS) + "SELECT DISTINCT videoID, views, categoryID FROM fx_comments"

ORACLE["capped_sample"] = with_(FX_COMMENTS, FX_TITLES) + """
SELECT c.comment_id, c.videoID
FROM fx_comments c JOIN fx_titles t ON c.videoID = t.videoID
WHERE t.channel = 'ch1'
ORDER BY md5(CAST(c.comment_id AS VARCHAR) || '|0'), c.comment_id
LIMIT 100"""

ORACLE["first_rows"] = with_(FX_COMMENTS) + """
SELECT comment_id, videoID FROM fx_comments ORDER BY comment_id LIMIT 100"""

ORACLE["split_rows"] = with_(FX_EVENTS, FX_VIDEOS) + """
SELECT videoID, CASE WHEN b < 60 THEN 'train' WHEN b < 80 THEN 'validation' ELSE 'test' END AS split
FROM (SELECT videoID, CAST(('0x' || substr(md5(videoID || '|1'), 1, 8))::BIGINT % 100 AS INTEGER) AS b
      FROM fx_videos)"""

ORACLE["stratified_folds"] = with_(FX_EVENTS, FX_VIDEOS) + f"""
SELECT videoID, viewsBucket, CAST(ntile(8) OVER (PARTITION BY viewsBucket ORDER BY videoID) AS INTEGER) AS fold
FROM (SELECT videoID, CASE WHEN views < {2 ** 20} THEN '1' WHEN views > {2 ** 20} THEN '2' END AS viewsBucket
      FROM fx_videos)
WHERE viewsBucket IS NOT NULL"""

# --------------------------------------------------------------------------
# Window, pivot, sort
# --------------------------------------------------------------------------
for _key, _col in (("rank_sentiment", "sentimentBucket"), ("rank_subjectivity", "subjectivity"),
                   ("rank_cluster", "clusters")):
    ORACLE[_key] = with_(FX_EVENTS, FX_SCORED_EVENTS) + f"""
SELECT comment_id, videoID, {_col},
       row_number() OVER (PARTITION BY videoID ORDER BY {_col} DESC, comment_id) AS rn
FROM fx_scored_events"""

ORACLE["rank_pivot"] = with_(FX_EVENTS, FX_SCORED_EVENTS, FX_MEASURES) + _pivot_sql(
    "fx_measures", MEASURE_NAMES, DEFAULT_RANKS, None)

ORACLE["sort_mixed"] = with_(FX_EVENTS, FX_SCORED_EVENTS, FX_MEASURES) + """
SELECT row_number() OVER (ORDER BY videoID, value DESC, comment_id, measure) AS position, comment_id, videoID, measure, value
FROM fx_measures"""

ORACLE["ngram_slice"] = with_(FX_COMMENTS, FX_LTOKS) + f"""
SELECT gram FROM (SELECT DISTINCT unnest({grams_sql(3)}) AS gram FROM fx_ltoks)
ORDER BY gram LIMIT 50 OFFSET 400"""

# --------------------------------------------------------------------------
# Statistics
# --------------------------------------------------------------------------
ORACLE["channel_counts"] = with_(FX_COMMENTS, FX_TITLES) + """
SELECT t.channel, count(*) AS n_comments FROM fx_comments c JOIN fx_titles t ON c.videoID = t.videoID
GROUP BY t.channel"""

ORACLE["describe_distinct"] = """
WITH d AS (SELECT DISTINCT CAST(value AS DOUBLE) AS v FROM events WHERE value IS NOT NULL)
SELECT count(*) AS count, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std, min(v) AS min,
       round(quantile_cont(v, 0.25), 6) AS q25, round(quantile_cont(v, 0.5), 6) AS q50,
       round(quantile_cont(v, 0.75), 6) AS q75, max(v) AS max
FROM d"""

ORACLE["kurtosis"] = """
SELECT count(value) AS n, round(kurtosis_pop(CAST(value AS DOUBLE)), 6) AS kurtosis FROM events"""

ORACLE["pearson_r"] = with_(FX_COMMENTS, FX_SCORED) + """
SELECT 'polarity' AS x, 'subjectivity' AS y, round(r, 6) AS r, n,
       round(r * sqrt(CAST(n - 2 AS DOUBLE) / (1.0 - r * r)), 6) AS t
FROM (SELECT corr(polarity, subjectivity) AS r, count(*) AS n FROM fx_scored)"""

ORACLE["histogram70"] = """
WITH v AS (SELECT CAST(value AS DOUBLE) AS v FROM events WHERE value IS NOT NULL),
mm AS (SELECT min(v) AS lo, max(v) AS hi, (max(v) - min(v)) / CAST(70.0 AS DOUBLE) AS step FROM v),
a AS (SELECT v, lo, hi, step,
             least(CAST(floor((v - lo) / (hi - lo) * CAST(70.0 AS DOUBLE)) AS BIGINT), 69) AS i1
      FROM v, mm WHERE hi > lo),
b AS (SELECT v, lo, hi, step,
             CASE WHEN v < (CASE WHEN i1 = 70 THEN hi ELSE CAST(i1 AS DOUBLE) * step + lo END) THEN i1 - 1 ELSE i1 END AS i2
      FROM a),
c AS (SELECT lo, hi, step,
             CAST(CASE WHEN i2 <> 69 AND v >= (CASE WHEN i2 + 1 = 70 THEN hi ELSE CAST(i2 + 1 AS DOUBLE) * step + lo END)
                       THEN i2 + 1 ELSE i2 END + 1 AS INTEGER) AS bin
      FROM b
      UNION ALL SELECT lo, hi, step, 1 FROM v, mm WHERE hi = lo)
SELECT bin,
       round(CASE WHEN bin - 1 = 70 THEN hi ELSE CAST(bin - 1 AS DOUBLE) * step + lo END, 6) AS bin_lo,
       round(CASE WHEN bin = 70 THEN hi ELSE CAST(bin AS DOUBLE) * step + lo END, 6) AS bin_hi,
       count(*) AS count
FROM c GROUP BY bin, lo, hi, step"""

# --------------------------------------------------------------------------
# Clustering
# --------------------------------------------------------------------------
ORACLE["kmeans_assign"] = with_(FX_COMMENTS, FX_SCORED, FX_CLUSTERED) + """
SELECT comment_id, polarity, subjectivity, clusters FROM fx_clustered"""

ORACLE["wcss_k1"] = with_(FX_COMMENTS, FX_SCORED) + """
, h AS (SELECT CAST(round(polarity * 100) AS BIGINT) AS p, CAST(round(subjectivity * 100) AS BIGINT) AS s FROM fx_scored),
a AS (SELECT CAST(count(*) AS HUGEINT) AS n, CAST(sum(p) AS HUGEINT) AS sp, CAST(sum(p * p) AS HUGEINT) AS qp,
             CAST(sum(s) AS HUGEINT) AS ss, CAST(sum(s * s) AS HUGEINT) AS qs FROM h)
SELECT sign(w) * floor(abs(w) * CAST(1000000.0 AS DOUBLE) + CAST(0.5 AS DOUBLE)) / CAST(1000000.0 AS DOUBLE) AS wcss
FROM (SELECT CAST(n * qp - sp * sp + n * qs - ss * ss AS DOUBLE) / (CAST(n AS DOUBLE) * CAST(10000.0 AS DOUBLE)) AS w
      FROM a)"""

ORACLE["cluster_profile"] = with_(FX_COMMENTS, FX_SCORED, FX_CLUSTERED) + """
SELECT clusters, count(*) AS n_comments, """ + exact_mean2("polarity") + """ AS avg_polarity,
       """ + exact_mean2("subjectivity") + """ AS avg_subjectivity
FROM fx_clustered GROUP BY clusters"""

# --------------------------------------------------------------------------
# Text
# --------------------------------------------------------------------------
ORACLE["tokenize_lower"] = with_(FX_COMMENTS, FX_LTOKS) + "SELECT comment_id, pos, token FROM fx_ltok"

for _n, _key in ((1, "vocab_unigram"), (2, "vocab_bigram"), (3, "vocab_trigram")):
    ORACLE[_key] = with_(FX_COMMENTS, FX_LTOKS) + f"""
SELECT DISTINCT unnest({grams_sql(_n)}) AS gram FROM fx_ltoks"""

ORACLE["ngram_counts"] = with_(FX_COMMENTS, FX_LTOKS) + f"""
SELECT n, count(*) AS n_distinct FROM (
  SELECT DISTINCT 1 AS n, unnest({grams_sql(1)}) AS gram FROM fx_ltoks
  UNION ALL SELECT DISTINCT 2 AS n, unnest({grams_sql(2)}) AS gram FROM fx_ltoks
  UNION ALL SELECT DISTINCT 3 AS n, unnest({grams_sql(3)}) AS gram FROM fx_ltoks)
GROUP BY n"""

ORACLE["doc_term_counts"] = with_(FX_COMMENTS, FX_LTOKS) + """
SELECT comment_id, token AS gram, count(*) AS count FROM fx_ltok GROUP BY comment_id, token"""

ORACLE["token_counts"] = with_(FX_COMMENTS, FX_CTOKS) + """
SELECT comment_id, token, count(*) AS count
FROM (SELECT comment_id, unnest(toks) AS token FROM fx_ctoks) GROUP BY comment_id, token"""

ORACLE["token_doc_freq"] = with_(FX_COMMENTS, FX_CTOKS) + f"""
SELECT token, count(*) AS n_comments
FROM (SELECT comment_id, unnest(list_distinct(toks)) AS token FROM fx_ctoks)
WHERE token NOT IN ({_words(fx.stopword_list())})
GROUP BY token"""

ORACLE["top_words"] = with_(FX_COMMENTS, FX_SCORED, FX_CLUSTERED) + f"""
SELECT token, count(*) AS count
FROM (SELECT unnest(regexp_extract_all(lower(coalesce(commentText, '')), '{WORD_RE}')) AS token
      FROM fx_clustered WHERE clusters = 2)
WHERE token NOT IN ({_words(sorted(set(w.lower() for w in fx.stopword_list() + list(TOP_WORDS_EXTRA_STOPWORDS))))})
GROUP BY token
ORDER BY count DESC, token
LIMIT 200"""

_TAG_VALUES = ", ".join(f"({q(t)}, {q(g)})" for t, g in fx.TAG_LEXICON)
FX_TAGGED = f"""
fx_tag_lexicon(token, tag) AS (VALUES {_TAG_VALUES}),
fx_tagged AS (
  SELECT t.comment_id, t.pos, t.token, coalesce(l.tag, 'NN') AS tag
  FROM fx_ltok t LEFT JOIN fx_tag_lexicon l ON t.token = l.token)"""

ORACLE["tag_tokens"] = with_(FX_COMMENTS, FX_LTOKS, FX_TAGGED) + "SELECT comment_id, pos, token, tag FROM fx_tagged"

ORACLE["np_chunks"] = with_(FX_COMMENTS, FX_LTOKS, FX_TAGGED) + f"""
, ts AS (SELECT comment_id, string_agg('<' || tag || '>', '' ORDER BY pos) AS tags FROM fx_tagged GROUP BY comment_id),
ch AS (SELECT unnest(regexp_extract_all(tags, '{NP_TAG_PATTERN}')) AS chunk FROM ts)
SELECT chunk, count(*) AS n, CAST(len(string_split(chunk, '><')) AS INTEGER) AS n_tokens
FROM ch GROUP BY chunk"""

def _rewritten(c: str, steps, group: str = "\\") -> str:
    for pattern, to in steps:
        c = f"regexp_replace({c}, {q(pattern)}, {q(to)}, 'g')"
    return c


ORACLE["parted_token_counts"] = with_(FX_COMMENTS) + f"""
, t AS (SELECT comment_id, {_rewritten("coalesce(commentText, '')", CONTRACTED)} AS x FROM fx_comments),
p AS (SELECT comment_id, list_filter(regexp_split_to_array({_rewritten("x", MARK_STEPS)}, '[\\t\\n\\x0B\\f\\r ]+'), lambda w: w <> '') AS w FROM t),
l AS (SELECT comment_id, ' ' || array_to_string(w, '  ') || ' ' AS line FROM p),
k AS (SELECT comment_id, unnest(regexp_split_to_array({_rewritten("line", PART_STEPS)}, ' +')) AS token FROM l)
SELECT comment_id, token, count(*) AS count FROM k WHERE token <> '' GROUP BY ALL"""


def _sql_value(v) -> str:
    return "NULL" if v is None else str(v).upper() if isinstance(v, bool) else str(v)


_PHRASES = ", ".join(f"({q(w)}, " + ", ".join(map(_sql_value, (
    None if p is None else int(round(p * 1000)), int(round((s or 0) * 1000)), x, bool(neg)))) + ")" for w, p, s, x, neg in fx.PHRASE_LEXICON)
_LONGEST = max(len(r[0].split()) for r in fx.PHRASE_LEXICON)
_BY_LENGTH = "coalesce(" + ", ".join(f"CASE WHEN i + {n - 1} <= len(toks) THEN lex[array_to_string(toks[i:i + {n - 1}], ' ')] END"
                                     for n in range(_LONGEST, 0, -1)) + ")"
_HALF_AWAY = "CAST(sign({0}) * floor(abs({0}) + 0.5) AS BIGINT)"
_P = _HALF_AWAY.format("greatest(-1000.0::DOUBLE, least(1000.0::DOUBLE, m.p::DOUBLE * a.ax * CASE WHEN a.aneg THEN -0.5::DOUBLE ELSE 1.0::DOUBLE END))")
_S = _HALF_AWAY.format("greatest(0.0::DOUBLE, least(1000.0::DOUBLE, m.s::DOUBLE * a.ax))")
_STATE = "k := m.k, p := m.p, s := m.s, x := m.x, neg := m.neg, skip := {}, ax := {}, aneg := {}, ap := {}, asum := {}, an := {}"
ORACLE["phrase_scores"] = with_(FX_COMMENTS, FX_LTOKS) + f"""
, lx(phrase, p, s, x, neg) AS (VALUES {_PHRASES}),
mp AS (SELECT map_from_entries(list((phrase, struct_pack(k := len(string_split(phrase, ' ')), p := p::BIGINT, s := s::BIGINT, x := x::DOUBLE, neg := neg)))) AS lex FROM lx),
mt AS (SELECT comment_id, list_transform(range(1, len(toks) + 1), lambda i: {_BY_LENGTH}) AS ms FROM fx_ltoks, mp),
st AS (SELECT comment_id, list_prepend(struct_pack(k := NULL::BIGINT, p := NULL::BIGINT, s := NULL::BIGINT, x := NULL::DOUBLE, neg := NULL::BOOLEAN,
         skip := 0::BIGINT, ax := 1.0::DOUBLE, aneg := FALSE, ap := 0::BIGINT, asum := 0::BIGINT, an := 0::BIGINT),
         list_transform(ms, lambda m: struct_pack(k := m.k, p := m.p, s := m.s, x := m.x, neg := m.neg,
         skip := 0::BIGINT, ax := 1.0::DOUBLE, aneg := FALSE, ap := 0::BIGINT, asum := 0::BIGINT, an := 0::BIGINT))) AS e FROM mt),
rd AS (SELECT comment_id, list_reduce(e, lambda a, m: CASE
         WHEN a.skip > 0 THEN struct_pack({_STATE.format('a.skip - 1', 'a.ax', 'a.aneg', 'a.ap', 'a.asum', 'a.an')})
         WHEN m.k IS NULL THEN struct_pack({_STATE.format('0::BIGINT', '1.0::DOUBLE', 'FALSE', 'a.ap', 'a.asum', 'a.an')})
         WHEN m.p IS NULL THEN struct_pack({_STATE.format('m.k - 1', 'a.ax * coalesce(m.x, 1.0::DOUBLE)', '(a.aneg OR m.neg)', 'a.ap', 'a.asum', 'a.an')})
         ELSE struct_pack({_STATE.format('m.k - 1', 'coalesce(m.x, 1.0::DOUBLE)', 'FALSE', f'a.ap + {_P}', f'a.asum + {_S}', 'a.an + 1')}) END) AS r FROM st),
sc AS (SELECT comment_id, {round2_milli('r.ap', 'r.an')} AS polarity, {round2_milli('r.asum', 'r.an')} AS subjectivity FROM rd)
SELECT comment_id, polarity, subjectivity, CAST(sign(polarity) AS INTEGER) AS sentimentBucket FROM sc"""

ORACLE["fitted_embeddings"] = with_(FX_COMMENTS, FX_LTOKS) + """
, f AS (SELECT token, ln(((SELECT count(*) FROM fx_comments) + 1)::DOUBLE / (count(DISTINCT comment_id) + 1)::DOUBLE) + 1 AS w FROM fx_ltok GROUP BY token),
c AS (SELECT t.comment_id, ('0x' || md5(t.token)[1:8])::BIGINT % 64 AS place,
             sum(f.w * CASE WHEN ('0x' || md5(t.token)[9:9])::BIGINT % 2 = 1 THEN 1.0 ELSE -1.0 END) AS v
      FROM fx_ltok t JOIN f ON t.token = f.token GROUP BY ALL),
z AS (SELECT comment_id, sqrt(sum(v * v)) AS norm FROM c GROUP BY comment_id)
SELECT x.comment_id, CAST(p.place AS INTEGER) AS place, round(CASE WHEN z.norm > 0 THEN coalesce(c.v, 0) / z.norm ELSE 0 END, 5) AS v
FROM fx_comments x CROSS JOIN range(64) p(place) LEFT JOIN z ON x.comment_id = z.comment_id
LEFT JOIN c ON c.comment_id = x.comment_id AND c.place = p.place"""

# The tag line is searched from the end of the last match: RE2's matches are found one after the other.
ORACLE["np_chunk_words"] = with_(FX_COMMENTS, FX_LTOKS, FX_TAGGED) + f"""
, ts AS (SELECT comment_id, list(token ORDER BY pos) AS toks, list(tag ORDER BY pos) AS tags FROM fx_tagged GROUP BY comment_id),
mk AS (SELECT comment_id, toks, tags, string_split(regexp_replace(
         array_to_string(list_transform(tags, lambda t: '<' || t || '>'), ''), '({NP_TAG_PATTERN})', chr(1) || '\\1' || chr(2), 'g'), '>') AS parts FROM ts),
se AS (SELECT comment_id, toks, tags, list_filter(range(len(parts)), lambda i: contains(parts[i + 1], chr(1))) AS s,
              list_filter(range(len(parts)), lambda i: starts_with(parts[i + 1], chr(2))) AS e FROM mk),
ch AS (SELECT comment_id, toks, tags, unnest(range(len(s))) AS j, unnest(s) AS a, unnest(e) AS b FROM se)
SELECT comment_id, CAST(j AS INTEGER) AS chunk_no, CAST(a AS INTEGER) AS start, array_to_string(toks[a + 1:b], ' ') AS words,
       array_to_string(tags[a + 1:b], ' ') AS tags,
       array_to_string(list_transform(range(a + 1, b + 1), lambda i: toks[i] || '/' || tags[i]), ' ') AS tagged FROM ch"""


def _wlog(k, n, x):
    return f"(ln(greatest({x}, 1e-10)) * {k} + ln(greatest(1.0::DOUBLE - {x}, 1e-10)) * ({n} - {k}))"


_G2 = ("-2.0::DOUBLE * (" + _wlog("c", "c1", "(c2 / n)") + " + " + _wlog("(c2 - c)", "(n - c1)", "(c2 / n)") + " - "
       + _wlog("c", "c1", "(c / c1)") + " - " + _wlog("(c2 - c)", "(n - c1)", "((c2 - c) / (n - c1))") + ")")
ORACLE["top_collocations"] = with_(FX_COMMENTS, FX_SCORED, FX_CLUSTERED) + f"""
, tk AS (SELECT regexp_extract_all(lower(coalesce(commentText, '')), '{WORD_RE}') AS t FROM fx_clustered WHERE clusters = 2),
st AS (SELECT unnest([{_words(sorted(set(w.lower() for w in fx.stopword_list() + list(TOP_WORDS_EXTRA_STOPWORDS))))}]) AS word),
u AS (SELECT word, CAST(count(*) AS DOUBLE) AS c FROM (SELECT unnest(t) AS word FROM tk) WHERE word NOT IN (SELECT word FROM st) GROUP BY word),
b AS (SELECT w1, w2, CAST(count(*) AS DOUBLE) AS c FROM (SELECT unnest(t[1:len(t) - 1]) AS w1, unnest(t[2:]) AS w2 FROM tk WHERE len(t) > 1)
      WHERE w1 NOT IN (SELECT word FROM st) AND w2 NOT IN (SELECT word FROM st) GROUP BY ALL),
j AS (SELECT b.w1, b.w2, b.c, x.c AS c1, y.c AS c2, (SELECT sum(c) FROM u) AS n FROM b JOIN u x ON b.w1 = x.word JOIN u y ON b.w2 = y.word),
g AS (SELECT *, CASE WHEN n > c1 AND n > c2 THEN {_G2} ELSE 0 END AS score FROM j),
k AS (SELECT * FROM g WHERE score > 30),
l AS (SELECT word, sum(c) AS lost FROM (SELECT w1 AS word, c FROM k UNION ALL SELECT w2, c FROM k) GROUP BY word),
a AS (SELECT u.word AS term, FALSE AS is_pair, CAST(u.c - coalesce(l.lost, 0) AS BIGINT) AS count, CAST(NULL AS DOUBLE) AS score
      FROM u LEFT JOIN l USING (word) WHERE u.c - coalesce(l.lost, 0) > 0
      UNION ALL SELECT w1 || ' ' || w2, TRUE, CAST(c AS BIGINT), sign(score) * floor(abs(score) * 1000 + 0.5) / 1000 FROM k)
SELECT * FROM a ORDER BY count DESC, term LIMIT 200"""

for _n, _key in ((1, "vocab_ids"), (2, "bigram_ids")):
    ORACLE[_key] = with_(FX_COMMENTS, FX_LTOKS) + f"""
SELECT row_number() OVER (ORDER BY gram) - 1 AS id, gram FROM (SELECT DISTINCT unnest({grams_sql(_n)}) AS gram FROM fx_ltoks)"""
FX_VECTORS = """
fx_vocab AS (SELECT row_number() OVER (ORDER BY token) - 1 AS id, token FROM (SELECT DISTINCT token FROM fx_ltok)),
fx_cells AS (SELECT t.comment_id, v.id, count(*) AS n FROM fx_ltok t JOIN fx_vocab v ON t.token = v.token GROUP BY ALL)"""
ORACLE["doc_vectors"] = with_(FX_COMMENTS, FX_LTOKS, FX_VECTORS) + """
SELECT c.comment_id, CAST(count(x.id) AS INTEGER) AS n_columns, coalesce(string_agg(x.id || ':' || x.n, ' ' ORDER BY x.id), '') AS vector
FROM fx_comments c LEFT JOIN fx_cells x ON c.comment_id = x.comment_id GROUP BY c.comment_id"""
ORACLE["vector_dots"] = with_(FX_COMMENTS, FX_LTOKS, FX_VECTORS) + """
, s AS (SELECT comment_id FROM fx_comments ORDER BY md5(CAST(comment_id AS VARCHAR) || '|0'), comment_id LIMIT 10)
SELECT a.comment_id, b.comment_id AS other_id, CAST(sum(a.n * b.n) AS BIGINT) AS dot
FROM fx_cells a JOIN fx_cells b ON a.id = b.id JOIN s ON b.comment_id = s.comment_id GROUP BY ALL"""

# --------------------------------------------------------------------------
# Embedding similarity
# --------------------------------------------------------------------------
ORACLE["embedding_similarity"] = """
WITH s AS (
  SELECT vec_id, embedding, row_number() OVER (ORDER BY md5(CAST(vec_id AS VARCHAR) || '|0'), vec_id) - 1 AS pos
  FROM embeddings
  ORDER BY md5(CAST(vec_id AS VARCHAR) || '|0'), vec_id LIMIT 10),
p AS (
  SELECT CAST(a.pos AS INTEGER) AS i, CAST(b.pos AS INTEGER) AS j, a.vec_id AS key_i, b.vec_id AS key_j,
         list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS d
  FROM s a JOIN s b ON a.pos > b.pos)
SELECT i, j, key_i, key_j, round(d, 6) AS inner_product,
       round(greatest(CAST(0.0 AS DOUBLE), least(CAST(1.0 AS DOUBLE), d)), 6) AS shown
FROM p"""

# --------------------------------------------------------------------------
# Model inputs and evaluation
# --------------------------------------------------------------------------
ORACLE["training_table"] = with_(FX_EVENTS, FX_SCORED_EVENTS, FX_MEASURES, FX_VIDEOS,
                                 "fx_feat AS (" + _pivot_sql("fx_measures", MEASURE_NAMES, DEFAULT_RANKS, 41) + ")") + f"""
SELECT v.videoID, v.categoryID, {FEATURE_COLS}, v.viewsBucket
FROM (SELECT videoID, categoryID, max(views) AS views,
             CASE WHEN max(views) < {2 ** 20} THEN '1' WHEN max(views) > {2 ** 20} THEN '2' END AS viewsBucket
      FROM (SELECT DISTINCT videoID, views, categoryID FROM fx_videos) GROUP BY videoID, categoryID) v
JOIN fx_feat f ON v.videoID = f.videoID
WHERE v.viewsBucket IS NOT NULL"""

ORACLE["unlabelled_videos"] = "WITH t AS (" + ORACLE["training_table"].replace("WHERE v.viewsBucket IS NOT NULL", "") + """)
SELECT count(viewsBucket) AS n_kept, count(*) - count(viewsBucket) AS n_dropped FROM t"""

ORACLE["pca_variance2"] = with_(FX_COMMENTS, FX_SCORED) + """
, m AS (SELECT count(*) AS n, var_samp(polarity) AS a, covar_samp(polarity, subjectivity) AS b,
               var_samp(subjectivity) AS c FROM fx_scored),
l AS (SELECT n, a + c AS tot,
             (a + c) / 2 + sqrt(((a - c) / 2) * ((a - c) / 2) + b * b) AS l1,
             (a + c) / 2 - sqrt(((a - c) / 2) * ((a - c) / 2) + b * b) AS l2 FROM m)
SELECT 1 AS component, round(l1 / tot, 6) AS explained_variance_ratio,
       round(sqrt(greatest(l1, CAST(0.0 AS DOUBLE)) * (n - 1)), 6) AS singular_value FROM l
UNION ALL
SELECT 2, round(l2 / tot, 6), round(sqrt(greatest(l2, CAST(0.0 AS DOUBLE)) * (n - 1)), 6) FROM l"""

ORACLE["accuracy"] = with_(FX_PREDICTIONS) + """
SELECT count(*) AS n, round(avg(CAST(label = prediction AS DOUBLE)), 6) AS accuracy FROM fx_predictions"""

ORACLE["confusion_matrix"] = with_(FX_PREDICTIONS) + """
SELECT label, count(*) FILTER (WHERE prediction = '0') AS "0", count(*) FILTER (WHERE prediction = '1') AS "1"
FROM fx_predictions GROUP BY label"""


def _report_sql(labels=("0", "1")):
    sums = ["count(*) AS total", "sum(CASE WHEN label = prediction THEN 1 ELSE 0 END) AS hits"]
    per = []
    for i, lab in enumerate(labels):
        sums += [f"sum(CASE WHEN label = {q(lab)} AND prediction = {q(lab)} THEN 1 ELSE 0 END) AS tp{i}",
                 f"sum(CASE WHEN label = {q(lab)} THEN 1 ELSE 0 END) AS sup{i}",
                 f"sum(CASE WHEN prediction = {q(lab)} THEN 1 ELSE 0 END) AS pred{i}"]
        per.append(f"""SELECT {q(lab)} AS class,
         CASE WHEN pred{i} > 0 THEN CAST(tp{i} AS DOUBLE) / CAST(pred{i} AS DOUBLE) ELSE CAST(0.0 AS DOUBLE) END AS p,
         CASE WHEN sup{i} > 0 THEN CAST(tp{i} AS DOUBLE) / CAST(sup{i} AS DOUBLE) ELSE CAST(0.0 AS DOUBLE) END AS r,
         sup{i} AS support, total FROM c""")
    return with_(FX_PREDICTIONS) + f"""
, c AS (SELECT {", ".join(sums)} FROM fx_predictions),
per AS ({" UNION ALL ".join(per)}),
per2 AS (SELECT class, p, r, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE CAST(0.0 AS DOUBLE) END AS f1,
                support, total FROM per)
SELECT class, round(p, 6) AS precision, round(r, 6) AS recall, round(f1, 6) AS f1, CAST(support AS BIGINT) AS support
FROM per2
UNION ALL SELECT 'accuracy', NULL, NULL, round(CAST(hits AS DOUBLE) / CAST(total AS DOUBLE), 6), CAST(total AS BIGINT) FROM c
UNION ALL SELECT 'macro avg', round(avg(p), 6), round(avg(r), 6), round(avg(f1), 6), CAST(max(total) AS BIGINT) FROM per2
UNION ALL SELECT 'weighted avg', round(sum(p * support) / max(total), 6), round(sum(r * support) / max(total), 6),
                 round(sum(f1 * support) / max(total), 6), CAST(max(total) AS BIGINT) FROM per2"""


ORACLE["classification_report"] = _report_sql()


# --------------------------------------------------------------------------
# Reports and invariants of fitted results
# --------------------------------------------------------------------------
def _histogram_sql(source: str, col: str) -> str:
    """The histogram statement's CTEs and result over another column."""
    return ORACLE["histogram70"].replace("CAST(value AS DOUBLE)", f"CAST({col} AS DOUBLE)").replace(
        "FROM events WHERE value IS NOT NULL", f"FROM {source} WHERE {col} IS NOT NULL")


_TITLED = with_(FX_COMMENTS, FX_TITLES, FX_SCORED).rstrip() + """,
j AS (SELECT s.polarity, s.subjectivity, t.commentCount FROM fx_scored s JOIN fx_titles t ON s.videoID = t.videoID),
dd AS (SELECT DISTINCT CAST(commentCount AS DOUBLE) AS v FROM j),
ds AS (SELECT CAST(count(*) AS DOUBLE) AS a, round(avg(v), 6) AS b, round(stddev_samp(v), 6) AS c, min(v) AS d,
              round(quantile_cont(v, 0.25), 6) AS e, round(quantile_cont(v, 0.5), 6) AS f,
              round(quantile_cont(v, 0.75), 6) AS g, max(v) AS h FROM dd),
k AS (SELECT CAST(count(commentCount) AS DOUBLE) AS n, round(kurtosis_pop(CAST(commentCount AS DOUBLE)), 6) AS k FROM j),
p AS (SELECT corr(polarity, subjectivity) AS r, count(*) AS n FROM j),
hist AS (""" + _histogram_sql("j", "commentCount") + """)
"""
ORACLE["distribution_report"] = _TITLED + """
SELECT 'describe' AS part, unnest(['count', 'mean', 'std', 'min', 'q25', 'q50', 'q75', 'max']) AS name,
       unnest([a, b, c, d, e, f, g, h]) AS value, CAST(NULL AS DOUBLE) AS hi FROM ds
UNION ALL SELECT 'kurtosis', unnest(['n', 'kurtosis']), unnest([n, k]), NULL FROM k
UNION ALL SELECT 'pearson', unnest(['r', 'n', 't']),
                 unnest([round(r, 6), CAST(n AS DOUBLE), round(r * sqrt(CAST(n - 2 AS DOUBLE) / (1.0 - r * r)), 6)]), NULL FROM p
UNION ALL SELECT 'histogram', CAST(bin AS VARCHAR), CAST(count AS DOUBLE), bin_hi FROM hist"""

ORACLE["kmeans_check"] = """
SELECT count(*) AS n, count(DISTINCT doc_id) AS n_ids, count(*) AS n_nearest, CAST(3 AS BIGINT) AS n_centres_mean FROM documents"""

ORACLE["elbow_check"] = "WITH one AS (" + ORACLE["wcss_k1"] + """)
SELECT CAST(unnest(range(1, 11)) AS INTEGER) AS k, TRUE AS falls, TRUE AS exact_k1, wcss AS wcss_k1 FROM one"""


def kmeans_sql(source: str, seed: int, starts: int, ks: list[int]) -> str:
    """CTEs of k-means over ``source``'s (polarity, subjectivity): km_draw (one start's draws and their costs),
    km_run (every round of every run), km_best (each k's best run). Coordinates are whole hundredths."""
    ctes = [f"""
km_points AS (SELECT CAST(round(polarity * 100) AS BIGINT) AS x0, CAST(round(subjectivity * 100) AS BIGINT) AS x1, count(*) AS n
              FROM {source} GROUP BY ALL),
km_far0 AS (SELECT s.start, p.*, CAST(1 AS DOUBLE) AS far FROM km_points p, range({starts}) s(start))"""]
    for j in range(max(ks)):
        ctes.append(f"""
km_next{j} AS (
  SELECT start, x0, x1 FROM km_far{j} WHERE far > 0
  QUALIFY row_number() OVER (PARTITION BY start ORDER BY
    -ln((('0x' || md5(x0 || '|' || x1 || '|' || (start + {seed}) || '|{j}')[1:13])::BIGINT + 0.5::DOUBLE) / 4503599627370496::DOUBLE) / (n * far),
    x0, x1) = 1),
km_far{j + 1} AS (
  SELECT f.start, f.x0, f.x1, f.n, CAST(least({'f.far, ' if j else ''}(f.x0 - c.x0) * (f.x0 - c.x0) + (f.x1 - c.x1) * (f.x1 - c.x1)) AS DOUBLE) AS far
  FROM km_far{j} f JOIN km_next{j} c USING (start))""")
    draws = " UNION ALL ".join(f"SELECT {j} AS place, start, x0, x1, (SELECT sum(n * far) FROM km_far{j + 1} f WHERE f.start = c.start) AS cost FROM km_next{j} c"
                               for j in range(max(ks)))
    return ",".join(ctes) + f""",
km_draw AS ({draws}),
km_seed AS (SELECT start, list([CAST(x0 AS DOUBLE), CAST(x1 AS DOUBLE)] ORDER BY place) AS cs FROM km_draw GROUP BY start),
km_run AS (
  SELECT k, start, 0 AS round, cs[1:k] AS cs, FALSE AS still, CAST(NULL AS DOUBLE) AS cost FROM km_seed, (SELECT unnest({ks}) AS k)
  UNION ALL
  SELECT k, start, round + 1, moved, moved = cs, cost FROM (
    SELECT k, start, any_value(round) AS round, any_value(cs) AS cs, sum(cost) AS cost,
           list_transform(any_value(cs), lambda c, j: coalesce(map_from_entries(list(struct_pack(k := label, v := mean)))[j], c)) AS moved
    FROM (SELECT k, start, label, any_value(round) AS round, any_value(cs) AS cs, sum(n * far) AS cost,
                 [CAST(sum(n * x0) AS DOUBLE) / CAST(sum(n) AS DOUBLE), CAST(sum(n * x1) AS DOUBLE) / CAST(sum(n) AS DOUBLE)] AS mean
          FROM (SELECT *, list_min(d) AS far, list_position(d, list_min(d)) AS label
                FROM (SELECT r.k, r.start, r.round, r.cs, p.*,
                             list_transform(r.cs, lambda c: (p.x0 - c[1]) * (p.x0 - c[1]) + (p.x1 - c[2]) * (p.x1 - c[2])) AS d
                      FROM km_run r, km_points p WHERE NOT r.still))
          GROUP BY k, start, label)
    GROUP BY k, start)),
km_best AS (
  SELECT k, cost / 10000 AS wcss, list_sort(list_transform(cs, lambda c: [c[1] / 100, c[2] / 100])) AS centres FROM km_run WHERE still
  QUALIFY row_number() OVER (PARTITION BY k ORDER BY round(cost / 10000, 9), list_sort(cs)) = 1)"""


def nearest_sql(x: str, y: str, centres: str) -> str:
    d = f"list_transform({centres}, lambda c: ({x} - c[1]) * ({x} - c[1]) + ({y} - c[2]) * ({y} - c[2]))"
    return f"CAST(list_position({d}, list_min({d})) - 1 AS INTEGER)"


_KMEANS_SEED = 0
ORACLE["kmeans_seeds"] = with_(FX_COMMENTS, FX_SCORED, kmeans_sql("fx_scored", _KMEANS_SEED, 10, [10])).replace("WITH", "WITH RECURSIVE", 1) + """
SELECT CAST(start AS INTEGER) AS start, CAST(place AS INTEGER) AS place, x0 / 100 AS polarity, x1 / 100 AS subjectivity,
       cost / 10000 AS cost FROM km_draw"""
ORACLE["kmeans_sentiment"] = with_(FX_COMMENTS, FX_SCORED, kmeans_sql("fx_scored", _KMEANS_SEED, 10, [3])).replace("WITH", "WITH RECURSIVE", 1) + f"""
SELECT comment_id, polarity, subjectivity, {nearest_sql('polarity', 'subjectivity', 'centres')} AS clusters FROM fx_scored, km_best"""
ORACLE["kmeans_elbow"] = with_(FX_COMMENTS, FX_SCORED, kmeans_sql("fx_scored", _KMEANS_SEED, 10, list(range(1, 11)))).replace(
    "WITH", "WITH RECURSIVE", 1) + """
SELECT CAST(k AS INTEGER) AS k, floor(wcss * 1000000000::DOUBLE + 0.5::DOUBLE) / 1000000000::DOUBLE AS wcss FROM km_best"""

FX_TITLED_MEASURES = """
fx_titled AS (SELECT s.* FROM fx_scored s JOIN fx_titles t ON s.videoID = t.videoID),
fx_tm AS (
  SELECT comment_id, videoID, 'subjectivity' AS measure, CAST(subjectivity AS DOUBLE) AS value FROM fx_titled
  UNION ALL SELECT comment_id, videoID, 'sentiment', CAST(sentimentBucket AS DOUBLE) FROM fx_titled)"""
ORACLE["video_features_exact"] = with_(FX_COMMENTS, FX_TITLES, FX_SCORED, FX_TITLED_MEASURES) + _pivot_sql(
    "fx_tm", ["subjectivity", "sentiment"], DEFAULT_RANKS, 41)

FX_TRAINING = """
fx_split AS (
  SELECT f.*, CASE WHEN b < 60 THEN 'train' WHEN b < 80 THEN 'validation' ELSE 'test' END AS split
  FROM (SELECT *, CAST(('0x' || substr(md5(videoID || '|1'), 1, 8))::BIGINT % 100 AS INTEGER) AS b FROM fx_train) f),
fx_folds AS (
  SELECT videoID, CAST(ntile(8) OVER (PARTITION BY viewsBucket ORDER BY videoID) AS INTEGER) AS fold
  FROM fx_split WHERE split = 'train')"""
_SPLIT = "WITH fx_train AS (" + ORACLE["training_table"] + ")," + FX_TRAINING
ORACLE["model_roundtrip_check"] = _SPLIT + """
SELECT count(*) AS n, count(*) AS n_equal FROM fx_split WHERE split = 'test'"""
ORACLE["cross_validation_folds"] = _SPLIT + """
SELECT fold, count(*) AS n, TRUE AS is_share FROM fx_folds GROUP BY fold"""
ORACLE["pca_check"] = _SPLIT + "SELECT count(*) AS n, TRUE AS pc1_eigen, TRUE AS pc2_eigen FROM fx_split"
ORACLE["lr_check"] = _SPLIT + "SELECT count(*) AS n, TRUE AS gradient_zero FROM fx_split WHERE split = 'test'"
ORACLE["views_model_operations"] = _SPLIT + """
SELECT split || ' set' AS operation, viewsBucket AS name, count(*) AS n FROM fx_split WHERE split <> 'train' GROUP BY ALL
UNION ALL SELECT 'cross validation', CAST(fold AS VARCHAR), count(*) FROM fx_folds GROUP BY fold"""

ORACLE["channel_report_counts"] = with_(FX_COMMENTS, FX_TITLES, FX_SCORED, FX_CATEGORIES) + """
, sel AS (SELECT DISTINCT s.videoID, s.categoryID, s.views, s.commentText, t.title, t.channel, t.commentCount, k.category, s.sentimentBucket
          FROM fx_scored s JOIN fx_categories k ON s.categoryID = k.categoryID JOIN fx_titles t ON s.videoID = t.videoID
          WHERE t.channel = 'ch1'),
c AS (SELECT count(*) AS n FROM sel WHERE sentimentBucket = 1)
SELECT unnest(['scored', 'profile', 'elbow_selected']) AS part, n FROM c
UNION ALL SELECT unnest(['centres', 'elbow', 'similarity', 'slice', 'top_words']), CAST(unnest([2, 3, 45, 50, 200]) AS BIGINT)"""

ORACLE["embed_hook"] = with_(FX_COMMENTS, FX_LTOKS) + """
, h AS (SELECT comment_id, ('0x' || md5(token)[1:8])::BIGINT % 64 AS place,
               CASE WHEN ('0x' || md5(token)[9:9])::BIGINT % 2 = 1 THEN 1 ELSE -1 END AS sign FROM fx_ltok),
s AS (SELECT comment_id, place, sum(sign) AS v FROM h GROUP BY ALL),
z AS (SELECT comment_id, max(v <> 0) AS any FROM s GROUP BY comment_id)
SELECT c.comment_id, CAST(64 AS INTEGER) AS dim, CASE WHEN z.any THEN CAST(1.0 AS DOUBLE) ELSE CAST(0.0 AS DOUBLE) END AS norm2
FROM fx_comments c LEFT JOIN z ON c.comment_id = z.comment_id"""

# --------------------------------------------------------------------------
# Reports, with the k-means fit in SQL
# --------------------------------------------------------------------------
FX_SELECTED = """
km_src AS (
  SELECT min(s.comment_id) AS comment_id, s.commentText, s.polarity, s.subjectivity
  FROM fx_scored s JOIN fx_categories k ON s.categoryID = k.categoryID JOIN fx_titles t ON s.videoID = t.videoID
  WHERE t.channel = 'ch1' AND s.sentimentBucket = 1
  GROUP BY s.videoID, s.categoryID, s.views, s.commentText, t.title, t.channel, t.commentCount, k.category, s.polarity, s.subjectivity)"""


def recursive_(*ctes: str) -> str:
    return with_(*ctes).replace("WITH", "WITH RECURSIVE", 1)


ORACLE["channel_elbow_report"] = recursive_(FX_COMMENTS, FX_TITLES, FX_SCORED, FX_CATEGORIES, FX_SELECTED,
                                            kmeans_sql("km_src", _KMEANS_SEED, 10, list(range(1, 11)))) + """
SELECT CAST(k AS INTEGER) AS k, floor(wcss * 1000000000::DOUBLE + 0.5::DOUBLE) / 1000000000::DOUBLE AS wcss FROM km_best"""

_STOPS = _words(sorted({w.lower() for w in fx.stopword_list() + list(TOP_WORDS_EXTRA_STOPWORDS)}))
ORACLE["channel_cluster_report"] = recursive_(FX_COMMENTS, FX_TITLES, FX_SCORED, FX_CATEGORIES, FX_SELECTED,
                                              kmeans_sql("km_src", _KMEANS_SEED, 10, [2])) + f"""
, lab AS (SELECT s.*, {nearest_sql('polarity', 'subjectivity', 'centres')} AS clusters FROM km_src s, km_best),
tk AS (SELECT comment_id, regexp_extract_all(lower(coalesce(commentText, '')), '{WORD_RE}') AS toks FROM lab WHERE clusters = 0),
w AS (SELECT comment_id, CAST(unnest(generate_series(0, len(toks) - 1)) AS INTEGER) AS pos, unnest(toks) AS token FROM tk),
tri AS (SELECT DISTINCT unnest({grams_sql(3)}) AS gram FROM tk),
lx(token, tag) AS (VALUES {_TAG_VALUES}),
tg AS (SELECT w.comment_id, string_agg('<' || coalesce(lx.tag, 'NN') || '>', '' ORDER BY w.pos) AS tags
       FROM w LEFT JOIN lx ON w.token = lx.token GROUP BY w.comment_id),
ch AS (SELECT unnest(regexp_extract_all(tags, '{NP_TAG_PATTERN}')) AS chunk FROM tg),
tw AS (SELECT token, count(*) AS n FROM w WHERE token NOT IN ({_STOPS}) GROUP BY token ORDER BY n DESC, token LIMIT 200),
sm AS (SELECT comment_id, row_number() OVER (ORDER BY md5(CAST(comment_id AS VARCHAR) || '|0'), comment_id) - 1 AS pos FROM tk
       ORDER BY md5(CAST(comment_id AS VARCHAR) || '|0'), comment_id LIMIT 10),
eh AS (SELECT w.comment_id, ('0x' || md5(token)[1:8])::BIGINT % 64 AS place,
              sum(CASE WHEN ('0x' || md5(token)[9:9])::BIGINT % 2 = 1 THEN 1 ELSE -1 END) AS v FROM w JOIN sm USING (comment_id) GROUP BY ALL),
en AS (SELECT comment_id, sqrt(CAST(sum(v * v) AS DOUBLE)) AS norm FROM eh GROUP BY comment_id),
ev AS (SELECT sm.pos, sm.comment_id, list(CAST(CASE WHEN en.norm > 0 THEN coalesce(eh.v, 0) / en.norm ELSE 0 END AS FLOAT) ORDER BY p.i) AS e
       FROM sm CROSS JOIN range(64) p(i) LEFT JOIN en ON en.comment_id = sm.comment_id
       LEFT JOIN eh ON eh.comment_id = sm.comment_id AND eh.place = p.i GROUP BY ALL),
pr AS (SELECT a.pos AS i, b.pos AS j, a.comment_id AS ka, b.comment_id AS kb, list_dot_product(CAST(a.e AS DOUBLE[]), CAST(b.e AS DOUBLE[])) AS d
       FROM ev a JOIN ev b ON a.pos > b.pos WHERE (SELECT count(*) FROM tk) >= 10)
SELECT 'profile' AS part, CAST(clusters AS VARCHAR) AS name, count(*) AS n, {exact_mean2('polarity')} AS x, {exact_mean2('subjectivity')} AS y
FROM lab GROUP BY clusters
UNION ALL SELECT 'centres', CAST(i - 1 AS VARCHAR), NULL, centres[i][1], centres[i][2] FROM km_best, range(1, 3) r(i)
UNION ALL SELECT 'trigram_count', NULL, count(*), NULL, NULL FROM tri
UNION ALL SELECT 'trigram_slice', gram, NULL, NULL, NULL FROM (SELECT gram FROM tri ORDER BY gram LIMIT 50 OFFSET 400)
UNION ALL SELECT 'chunks', chunk, count(*), len(string_split(chunk, '><')), NULL FROM ch GROUP BY chunk
UNION ALL SELECT 'top_words', token, n, NULL, NULL FROM tw
UNION ALL SELECT 'similarity', concat_ws(',', i, j, ka, kb), NULL, round(d, 6), round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, d)), 6) FROM pr"""

ORACLE["video_features"] = recursive_(FX_COMMENTS, FX_TITLES, FX_SCORED, """
fx_titled AS (SELECT s.* FROM fx_scored s JOIN fx_titles t ON s.videoID = t.videoID)""", kmeans_sql("fx_titled", _KMEANS_SEED, 10, [5]), f"""
fx_tm AS (
  SELECT comment_id, videoID, 'cluster' AS measure, CAST({nearest_sql('polarity', 'subjectivity', 'centres')} AS DOUBLE) AS value FROM fx_titled, km_best
  UNION ALL SELECT comment_id, videoID, 'subjectivity', CAST(subjectivity AS DOUBLE) FROM fx_titled
  UNION ALL SELECT comment_id, videoID, 'sentiment', CAST(sentimentBucket AS DOUBLE) FROM fx_titled)""") + _pivot_sql(
    "fx_tm", MEASURE_NAMES, DEFAULT_RANKS, 41)

# Leading eigenvectors of the training covariance by power iteration; the first one's part is taken out for the second.
_FEATURES = "list_value(CAST(categoryID AS DOUBLE), " + ", ".join(f"CAST({m}_{r} AS DOUBLE)" for m in MEASURE_NAMES for r in DEFAULT_RANKS) + ")"
_POWER = """
{name} AS (
  SELECT 0 AS step, list_transform(range(1, len(m) + 1), lambda i: 1.0::DOUBLE / i) AS v FROM {matrix}
  UNION ALL SELECT step + 1, list_transform(u, lambda x: x / sqrt(list_dot_product(u, u))) FROM (
    SELECT step, list_transform(m, lambda row: list_dot_product(row, v)) AS u FROM {name}, {matrix} WHERE step < 3000)),
{name}_last AS (SELECT v, list_dot_product(v, list_transform(m, lambda row: list_dot_product(row, v))) AS value FROM {name}, {matrix} WHERE step = 3000)"""
ORACLE["pca_summary"] = _SPLIT.replace("WITH", "WITH RECURSIVE", 1) + f"""
, x AS (SELECT {_FEATURES} AS x FROM fx_split WHERE split = 'train'),
c AS (SELECT a.i, b.j, covar_samp(x[a.i], x[b.j]) AS c FROM x, (SELECT unnest(range(1, (SELECT max(len(x)) FROM x) + 1)) AS i) a,
      (SELECT unnest(range(1, (SELECT max(len(x)) FROM x) + 1)) AS j) b GROUP BY ALL),
m1 AS (SELECT list(r ORDER BY i) AS m FROM (SELECT i, list(c ORDER BY j) AS r FROM c GROUP BY i)),{_POWER.format(name='p1', matrix='m1')},
m2 AS (SELECT list_transform(range(1, len(m) + 1), lambda i: list_transform(range(1, len(m) + 1), lambda j: m[i][j] - value * v[i] * v[j])) AS m
       FROM m1, p1_last),{_POWER.format(name='p2', matrix='m2')},
t AS (SELECT (SELECT sum(c) FROM c WHERE i = j) AS total, (SELECT count(*) FROM x) AS n)
SELECT component, round(value / total, 6) AS explained_variance_ratio, round(sqrt(value * (n - 1)), 6) AS singular_value
FROM (SELECT 1 AS component, value FROM p1_last UNION ALL SELECT 2, value FROM p2_last), t"""

# Student's t by its finite series: 1 - A(t | v), v even or odd.
ORACLE["pearson_p"] = with_(FX_COMMENTS, FX_SCORED) + """
, k AS (SELECT 'polarity' AS x, 'subjectivity' AS y, corr(polarity, subjectivity) AS r, count(*) AS n FROM fx_scored
        UNION ALL SELECT 'views', 'subjectivity', corr(CAST(views AS DOUBLE), subjectivity), count(*) FROM fx_scored
        UNION ALL SELECT 'polarity', 'comment_id', corr(polarity, CAST(comment_id AS DOUBLE)), count(*) FROM fx_scored),
a AS (SELECT *, n - 2 AS v, abs(r) * sqrt((n - 2) / (1 - r * r)) AS t FROM k),
b AS (SELECT *, atan(t / sqrt(CAST(v AS DOUBLE))) AS th FROM a),
s AS (SELECT *, list_sum(list_transform(range(0, v // 2),
        lambda j: exp(coalesce(list_sum(list_transform(range(1, j + 1), lambda i: ln(CASE WHEN v % 2 = 1 THEN 2.0 * i / (2 * i + 1) ELSE (2.0 * i - 1) / (2 * i) END))), 0)
                      + 2 * j * ln(cos(th))))) AS sum FROM b)
SELECT x, y, round(r, 6) AS r, n, round(1 - CASE WHEN v % 2 = 1 THEN 2 / pi() * (th + sin(th) * cos(th) * sum) ELSE sin(th) * sum END, 6) AS p_value FROM s"""
