"""ANSI SQL of the registered queries, for the side-by-side check in DuckDB."""

from __future__ import annotations

from chatloom.functions import fixed, text
from chatloom.operators.cleaning import combined_stop_words
from chatloom.plans import given


def quote(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def words(values) -> str:
    return ", ".join(quote(v) for v in sorted(values))


def values(entries: dict[str, float]) -> str:
    return ", ".join(f"({quote(w)}, {v}::DOUBLE)" for w, v in sorted(entries.items()))


def strip(expr: str) -> str:
    return f"regexp_replace({expr}, {quote(text.EDGE_SPACES)}, '', 'g')"


def tokens_cte(source: str, key: str, column: str, extra: str = "") -> str:
    """`plain` and `cleaned(key, [extra], tokens)` over `source`."""
    more = f", {extra}" if extra else ""
    spaced = f"' ' || regexp_replace(x, {quote(text.SPACES)}, '  ', 'g') || ' '"
    for word, parts in fixed.CONTRACTIONS:
        spaced = f"replace({spaced}, ' {word} ', ' {parts} ')"
    return f"""
    bare AS (
      SELECT {key}{more}, regexp_replace(lower(coalesce({column}, '')), {quote(text.URL)}, '', 'g') AS u FROM {source}),
    plain AS (
      SELECT {key}{more}, CASE WHEN starts_with({strip('u')}, '!') THEN ''
        ELSE regexp_replace(u, {quote(text.NOISE)}, '', 'g') END AS x FROM bare),
    cleaned AS (
      SELECT {key}{more}, list_filter(string_split_regex({spaced}, ' +'),
        lambda w: length(w) >= {fixed.MIN_WORD_LENGTH} AND w NOT IN ({words(combined_stop_words())})) AS tokens FROM plain)"""


DOC_TOKENS = tokens_cte("documents", "doc_id", "text", "lang")


def polarity_cte(source: str, key: str, column: str) -> str:
    """`scored(key, sentiment_score, sentiment)` over `source`."""
    t = fixed.POLARITY_THRESHOLD
    return f"""
    lexicon(word, weight) AS (VALUES {values(given.SAMPLE_POLARITY)}),
    spoken AS (
      SELECT {key}, unnest(list_filter(string_split_regex(lower(coalesce({column}, '')), {quote(text.NOT_WORD)}),
        lambda w: w <> '')) AS word FROM {source}),
    hit AS (SELECT {key}, sum(weight) / count(*) AS m FROM spoken JOIN lexicon USING (word) GROUP BY {key}),
    scored AS (
      SELECT s.{key}, coalesce(m, 0.0) AS sentiment_score,
        CASE WHEN coalesce(m, 0.0) > {t}::DOUBLE THEN 'positive' WHEN coalesce(m, 0.0) < -({t}::DOUBLE) THEN 'negative'
          ELSE 'neutral' END AS sentiment
      FROM (SELECT {key} FROM {source}) s LEFT JOIN hit USING ({key}))"""


DOC_POLARITY = polarity_cte("documents", "doc_id", "text")

TURNS = f"""
    turns AS (
      SELECT conv_id || '-' || turn AS msg_key, conv_id, turn, role, text,
        {given.FIRST_SECOND} + conv_id * 37 + turn * 11 AS sec,
        'room ' || (conv_id % 7) AS channel
      FROM conversations)"""
TURN_TIME = "strftime(epoch_ms(sec * 1000), '%Y-%m-%d %H:%M:%S')"


def valence_sql(source: str, key: str, column: str) -> str:
    """All valence rules in window form."""
    r = given.SAMPLE_RULES
    t = fixed.VALENCE_THRESHOLD
    strip_mark = f"regexp_replace(raw, {quote(text.EDGE_PUNCTUATION)}, '', 'g')"
    steps = "\n".join(
        f"""
    s{d} AS (
      SELECT *, CASE WHEN has{d} AND weight{d} IS NULL THEN
          (v{d - 1} + (CASE WHEN v{d - 1} < 0 THEN -boost{d} ELSE boost{d} END
            + CASE WHEN caps{d} AND shouted AND boost{d} <> 0 THEN
                CASE WHEN v{d - 1} > 0 THEN {fixed.CAPS_EMPHASIS}::DOUBLE ELSE -({fixed.CAPS_EMPHASIS}::DOUBLE) END
              ELSE 0::DOUBLE END) * {fixed.BOOST_DAMPING[d - 1]}::DOUBLE)
          * CASE WHEN neg{d} THEN ({fixed.NEGATION_FACTOR})::DOUBLE ELSE 1::DOUBLE END
        ELSE v{d - 1} END AS v{d} FROM s{d - 1}),"""
        for d in (1, 2, 3)
    )
    lags = ", ".join(
        f"coalesce(lag(true, {d}) OVER w, false) AS has{d}, lag(weight, {d}) OVER w AS weight{d}, "
        f"lag(boost, {d}) OVER w AS boost{d}, lag(caps, {d}) OVER w AS caps{d}, lag(neg, {d}) OVER w AS neg{d}"
        for d in (1, 2, 3)
    )
    return f"""
    WITH lexicon(lw, weight) AS (VALUES {values(given.SAMPLE_VALENCE)}),
    split AS (
      SELECT {key}, list_filter(string_split_regex(coalesce({column}, ''), {quote(text.SPACES)}), lambda w: w <> '') AS ws
      FROM {source}),
    raws AS (SELECT {key}, unnest(ws) AS raw, generate_subscripts(ws, 1) AS pos FROM split),
    named AS (SELECT {key}, pos, CASE WHEN length({strip_mark}) <= 2 THEN raw ELSE {strip_mark} END AS word FROM raws),
    facts AS (
      SELECT n.{key}, pos, lower(word) AS lw, l.weight,
        regexp_matches(word, {quote(text.CASED_UPPER)}) AND NOT regexp_matches(word, {quote(text.CASED_LOWER)}) AS caps,
        CASE WHEN lower(word) IN ({words(r.boosters_up)}) THEN {fixed.BOOST}::DOUBLE
          WHEN lower(word) IN ({words(r.boosters_down)}) THEN -({fixed.BOOST}::DOUBLE) ELSE 0::DOUBLE END AS boost,
        replace(lower(word), '''', '') IN ({words(r.negations)}) OR contains(lower(word), 'n''t') AS neg
      FROM named n LEFT JOIN lexicon l ON lower(n.word) = l.lw),
    near AS (
      SELECT *, {lags},
        bool_or(caps) OVER (PARTITION BY {key}) AND NOT bool_and(caps) OVER (PARTITION BY {key}) AS shouted,
        min(CASE WHEN lw = {quote(r.contrast)} THEN pos END) OVER (PARTITION BY {key}) AS but_at
      FROM facts WINDOW w AS (PARTITION BY {key} ORDER BY pos)),
    s0 AS (
      SELECT *, weight + CASE WHEN caps AND shouted THEN
          CASE WHEN weight > 0 THEN {fixed.CAPS_EMPHASIS}::DOUBLE ELSE -({fixed.CAPS_EMPHASIS}::DOUBLE) END
        ELSE 0::DOUBLE END AS v0 FROM near WHERE weight IS NOT NULL AND boost = 0),{steps}
    summed AS (
      SELECT {key}, sum(v3 * CASE WHEN but_at IS NULL THEN 1::DOUBLE WHEN pos < but_at THEN {fixed.BEFORE_BUT}::DOUBLE
        WHEN pos > but_at THEN {fixed.AFTER_BUT}::DOUBLE ELSE 1::DOUBLE END) AS total FROM s3 GROUP BY {key}),
    marked AS (
      SELECT d.{key}, coalesce(total, 0::DOUBLE) AS total,
        least(length(coalesce({column}, '')) - length(replace(coalesce({column}, ''), '!', '')), {fixed.EXCLAMATION_MAX})
          * {fixed.EXCLAMATION_STEP}::DOUBLE
        + CASE WHEN length(coalesce({column}, '')) - length(replace(coalesce({column}, ''), '?', '')) <= 1 THEN 0::DOUBLE
            WHEN length({column}) - length(replace({column}, '?', '')) <= 3
              THEN (length({column}) - length(replace({column}, '?', ''))) * {fixed.QUESTION_STEP}::DOUBLE
            ELSE {fixed.QUESTION_FULL}::DOUBLE END AS marks
      FROM {source} d LEFT JOIN summed USING ({key})),
    moved AS (
      SELECT {key}, CASE WHEN total > 0 THEN total + marks WHEN total < 0 THEN total - marks ELSE total END AS m FROM marked),
    final AS (SELECT {key}, round(m / sqrt(m * m + {fixed.NORMALISER}), 4) AS sentiment_score FROM moved)
    SELECT {key}, sentiment_score, CASE WHEN sentiment_score >= {t}::DOUBLE THEN 'positive'
      WHEN sentiment_score <= -({t}::DOUBLE) THEN 'negative' ELSE 'neutral' END AS sentiment FROM final"""


def language_topics_cte(n: int) -> str:
    """`topics(topic, rank, word, weight, mass)` of the language keywords, after `DOC_TOKENS`."""
    topic = "CASE lang " + " ".join(f"WHEN {quote(x)} THEN {i}" for i, x in enumerate(given.LANGUAGES)) + " ELSE -1 END"
    return f"""
    lang_words AS (SELECT lang, word, count(*) AS n FROM (SELECT lang, unnest(tokens) AS word FROM cleaned) GROUP BY ALL),
    lang_total AS (SELECT lang, sum(n) AS total FROM lang_words GROUP BY lang),
    topics AS (
      SELECT {topic} AS topic, rank, word, n / total AS weight, total::DOUBLE AS mass
      FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, word) - 1 AS rank FROM lang_words)
      JOIN lang_total USING (lang) WHERE rank < {n})"""


def window_counts_cte() -> str:
    """`counts(word_a, word_b, n)` from every single window, after `DOC_TOKENS` and `topics`."""
    w = fixed.COHERENCE_WINDOW
    return f"""
    docs AS (SELECT doc_id, tokens, greatest(len(tokens) - {w - 1}, 1) AS nw FROM cleaned WHERE len(tokens) > 0),
    placed AS (SELECT doc_id, nw, unnest(tokens) AS word, generate_subscripts(tokens, 1) - 1 AS p FROM docs),
    hits AS (SELECT * FROM placed WHERE word IN (SELECT word FROM topics)),
    seen AS (
      SELECT DISTINCT doc_id, word, unnest(range(greatest(p - {w - 1}, 0), least(p, nw - 1) + 1)) AS s FROM hits),
    related AS (
      SELECT DISTINCT a.word AS word_a, b.word AS word_b FROM topics a JOIN topics b ON a.topic = b.topic AND a.word < b.word),
    pairs AS (
      SELECT r.word_a, r.word_b, count(*) AS n FROM seen a JOIN related r ON a.word = r.word_a
      JOIN seen b ON b.doc_id = a.doc_id AND b.s = a.s AND b.word = r.word_b GROUP BY ALL),
    counts AS (
      SELECT word_a, word_b, n::BIGINT AS n FROM pairs
      UNION ALL SELECT word, word, count(*)::BIGINT FROM seen GROUP BY word
      UNION ALL SELECT '', '', sum(nw)::BIGINT FROM docs)"""


PREDICTED = f"""{DOC_POLARITY},
    predicted AS (
      SELECT '2024-01-0' || (doc_id % 3 + 1) AS ts, lang AS who, {strip('text')} AS said,
        CASE WHEN doc_id % 97 <> 0 THEN CASE WHEN doc_id % 5 = 0 THEN upper(sentiment) ELSE sentiment END END AS predicted_label
      FROM documents JOIN scored USING (doc_id))"""
TRUTH = "CASE WHEN toxic = 1 THEN 'negative' WHEN quality = 1 THEN 'positive' ELSE 'neutral' END"
ACTUAL = f"""
    actual AS (
      SELECT '2024-01-0' || (doc_id % 3 + 1) AS ts, lang AS who, {strip('text')} AS said,
        CASE WHEN doc_id % 41 <> 0 THEN {TRUTH} END AS actual_label
      FROM documents JOIN labels USING (doc_id))"""
MATCHED = f"{PREDICTED},{ACTUAL},\n    matched AS (SELECT ts, who, said, predicted_label, actual_label FROM predicted JOIN actual USING (ts, who, said))"
DIFFERS = "lower(coalesce(predicted_label, 'nan')) <> lower(coalesce(actual_label, 'nan'))"

FEED = """
    feed AS (
      SELECT user_id AS channel, event_id AS msg_key, ts, event_type AS username, props AS message, value AS sentiment_score,
        CASE WHEN value > 12 THEN 'positive' WHEN value < 8 THEN 'negative' ELSE 'neutral' END AS sentiment
      FROM events)"""

# The meaning of the envelopes built from `conversations`, without building any JSON.
ENVELOPES = f"""{TURNS},
    named AS (
      SELECT *, CASE WHEN conv_id % 10 = 0 THEN 'test_' || role ELSE role END AS name,
        CASE WHEN turn % 5 = 3 THEN 'invalid' WHEN turn % 5 = 4 THEN 'form' ELSE 'json' END AS body_kind,
        CASE conv_id % 3 WHEN 0 THEN {quote(fixed.CHAT_EVENT)} WHEN 1 THEN 'channel.followed' END AS event_type,
        epoch_ms(sec * 1000) AS received_at
      FROM turns),
    said AS (
      SELECT *, CASE body_kind WHEN 'json' THEN text WHEN 'form' THEN regexp_replace(text, '[&=]', '', 'g') END AS said,
        CASE WHEN body_kind <> 'invalid' THEN name END AS sender FROM named),
    envelopes AS (
      SELECT *, coalesce(contains(lower(said), 'test') OR contains(lower(said), 'debug_broadcaster')
          OR contains(lower(sender), 'test'), false) AS is_test FROM said),
    classed AS (
      SELECT *, CASE WHEN body_kind = 'invalid' THEN NULL WHEN is_test THEN 'test' WHEN event_type IS NOT NULL THEN 'kick'
        ELSE 'unknown' END AS event_class FROM envelopes)"""
