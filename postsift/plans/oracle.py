"""The queries in plain SQL, to compare results with another engine."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from postsift.defaults import PASSES, TOPICS

from . import queries as q
from . import topic_oracle

_POSTS = """
posts AS (
    SELECT doc_id AS id, text AS content, source AS username,
           CASE WHEN doc_id % 9 <> 0 THEN upper(lang) END AS location,
           n_chars AS likeCount, CAST(doc_id % 7 AS BIGINT) AS retweetCount,
           CASE lang WHEN 'en' THEN 'United States' ELSE lang END AS country,
           CASE WHEN doc_id % 5 = 0 THEN source
                ELSE concat('City', CAST(doc_id % 11 AS VARCHAR), ', ', source)
           END AS fullName
    FROM documents
)
"""

_DELIMITERS = r"""'[ ",()*]+'"""
_BREAKS = r"""'[\s,;:@#$%&?!"()\[\]{}<>]+'"""


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _list(values: Iterable[str]) -> str:
    return "(VALUES " + ", ".join(f"({_text(value)})" for value in values) + ") AS listed(keyword)"


def _with(*parts: str) -> str:
    return "WITH " + ", ".join((_POSTS, *parts))


def _contains(column: str, term: str = "keyword", fold: bool = True) -> str:
    sought = f"lower({term})" if fold else term
    return f"contains(lower({column}), {sought})"


def _pairs(condition: str, terms: Iterable[str], columns: str = "id, keyword", posts: str = "posts") -> str:
    return f"{_with()} SELECT {columns} FROM {posts} JOIN {_list(terms)} ON {condition}"


def _any(terms: Iterable[str], column: str = "content", fold: bool = True) -> str:
    return "coalesce(" + " OR ".join(
        f"contains(lower({column}), {_text(term.lower() if fold else term)})" for term in terms
    ) + ", false)"


def _hits(terms: Iterable[str], column: str = "content") -> str:
    return " + ".join(
        f"CAST(contains(lower({column}), {_text(term.lower())}) AS INT)" for term in terms
    )


_LINE = r"replace(content, chr(10), ' ')"
_WORDS = r"concat(' ', regexp_replace(lower(content), '[^\p{L}\p{N}]+', ' ', 'g'), ' ')"


def _word(term: str) -> str:
    return f"contains({_WORDS}, {_text(' ' + term + ' ')})"


def _second(column: str) -> str:
    return f"nullif(split_part({column}, ', ', 2), '')"


def _after(column: str) -> str:
    return (
        f"CASE WHEN regexp_matches({column}, '[^,]+,\\s*(.*)') "
        f"THEN regexp_extract({column}, '[^,]+,\\s*(.*)', 1) END"
    )


def _violent(state: str, fold: bool, country: bool = True) -> str:
    where = "WHERE country = 'United States'" if country else ""
    return f"""found AS (
        SELECT {state} AS state, content, username, likeCount, retweetCount, id
        FROM posts JOIN {_list(q.VIOLENT)} ON {_contains("content", fold=fold)} {where}
    )"""


def _scored(split: str, keep: str = "true", rated: Mapping[str, int] = q.RATED) -> str:
    rows = ", ".join(f"({_text(word)}, {rating})" for word, rating in rated.items())
    return f"""
    words AS (SELECT id, content, unnest({split}) AS word FROM posts),
    rated(word, rating) AS (VALUES {rows}),
    scored AS (
        SELECT id AS tweet_id, content AS tweet_content, avg(rating) AS tweet_rating
        FROM words LEFT JOIN rated USING (word)
        WHERE {keep}
        GROUP BY id, content
    )"""


_SPACES = r"string_split_regex(content, '\s+')"
_MARKS = f"string_split_regex(content, {_DELIMITERS})"

_TERM_TABLE = """
terms AS (
    SELECT text AS keyword FROM benchmark
    UNION
    SELECT unnest(string_split(p_name, ' ')) FROM part
)
"""

_PATTERN_TABLE = """
patterns AS (
    SELECT split_part(p_name, ' ', 1) || '.*' || split_part(p_name, ' ', -1) AS pattern,
           split_part(p_name, ' ', 1) || '%' || split_part(p_name, ' ', -1) AS wild FROM part
    UNION ALL SELECT '(version|lic) ?' || s_suppkey || '[. ]?', '@mail' || s_suppkey || '_example' FROM supplier
    UNION ALL SELECT * FROM (VALUES ('h.te', 'h_te'), ('lic[ae]', 'gre%t'), ('great|public', 'Lic'),
        ('[xyz]{3}', '%'), ('idiot\\b', 'of the %l')) AS fixed(pattern, wild)
)
"""

# More terms than travel inside a plan, so that the way of large tables is taken.
_LONG_TABLE = """
listed AS (
    SELECT p_name || ' ' || p_partkey AS keyword, p_partkey % 2 AS side FROM part
    UNION ALL SELECT c_name, c_custkey % 2 FROM customer
    UNION ALL SELECT text, item_id % 2 FROM benchmark
    UNION ALL SELECT * FROM (VALUES ('idiot', 0), ('clown ', 1), ('license', 0), ('Scum', 1)) AS more(keyword, side)
)
"""

_KNOWN_WORDS = """
known AS (
    SELECT token FROM cleaned GROUP BY token
    HAVING count(DISTINCT id) >= 5 AND count(DISTINCT id) <= 0.5 * (SELECT count(*) FROM posts)
)
"""

_RULE = f"""
CASE WHEN {_any(q.POSITIVE)} THEN 'positive'
     WHEN {_any(q.NEGATIVE)} THEN 'negative' ELSE 'neutral' END
"""

def _word_table(name: str, words: Iterable[str], rest: int) -> str:
    return f"""{name} AS (
    SELECT DISTINCT unnest(string_split(p_name, ' ')) || ' ' AS word FROM part WHERE p_partkey % 2 = {rest}
    UNION SELECT * FROM {_list(words)}
)"""


_WORD_TABLES = f"{_word_table('positives', q.POSITIVE, 0)}, {_word_table('negatives', q.NEGATIVE, 1)}"

_RULE_TABLE = f"""
CASE WHEN EXISTS (SELECT 1 FROM positives WHERE {_contains("content", "word")}) THEN 'positive'
     WHEN EXISTS (SELECT 1 FROM negatives WHERE {_contains("content", "word")}) THEN 'negative' ELSE 'neutral' END
"""

_TRIMMED = sorted({name.strip() for name in q.NAMES})

_TOKENS = f"""
split AS (
    SELECT id, unnest(string_split_regex(lower(content), {_BREAKS})) AS part FROM posts
),
cleaned AS (
    SELECT id, token
    FROM (SELECT id, regexp_replace(part, '\\.$', '') AS token FROM split)
    WHERE regexp_full_match(token, '[\\p{{L}}\\p{{N}}]+')
      AND token NOT IN ({", ".join(_text(word) for word in q.STOP)})
)
"""


def _ranked_users(terms: Iterable[str], each: str) -> str:
    return f"""{_with()}
    SELECT username, CAST(sum({each}) AS BIGINT) AS count FROM posts
    WHERE {_any(terms)} GROUP BY username ORDER BY count DESC, username"""


def _label(missing: str) -> str:
    return f"""{_with(_scored(_SPACES))}
    SELECT tweet_id, tweet_rating,
           CASE WHEN tweet_rating IS NULL THEN '{missing}'
                WHEN tweet_rating >= 0 THEN 'positive' ELSE 'negative' END AS sentiment
    FROM scored"""


_BY_PLACE = f"""
    SELECT keyword AS restaurant, lower(coalesce(location, 'desconocida')) AS location,
           count(*) AS count
    FROM posts JOIN {_list(_TRIMMED)} ON {_contains("content", fold=False)}
    GROUP BY 1, 2
"""

_SUBSTRINGS = """
    SELECT substring(name, CAST(start AS INT), CAST(size AS INT)) AS substring
    FROM (
        SELECT name, start, unnest(range({least}, length(name) - start + 2)) AS size
        FROM (
            SELECT name, unnest(range(1, length(name) - {least} + 2)) AS start FROM names
        )
    )
"""


def _brand_counts(brands: Iterable[str]) -> str:
    return f"""mood AS (
        SELECT keyword AS restaurant, {_RULE} AS sentiment
        FROM posts JOIN {_list(brands)} ON {_contains("content")}
    ),
    counts AS (SELECT restaurant, sentiment, count(*) AS count FROM mood GROUP BY 1, 2)"""


_STANCE = f"""
    SELECT id, username, '{q.keywords.PRO_LABEL}' AS tipo, keyword
    FROM posts JOIN {_list(q.PRO)} ON {_contains("content")}
    UNION ALL
    SELECT id, username, '{q.keywords.ANTI_LABEL}' AS tipo, keyword
    FROM posts JOIN {_list(q.ANTI)} ON {_contains("content")}
"""


def _stance_totals(each: str) -> str:
    return f"""{_with(f"pairs AS ({_STANCE})")}
    SELECT tipo, count({each}) AS numero FROM pairs GROUP BY tipo"""


def oracle_sql() -> dict[str, str]:
    like_all = "lower(content) LIKE concat('%', {}, '%')"
    pattern = "regexp_full_match({}, concat('(?i).*', keyword, '.*'))"
    rows = "content, username, likeCount, retweetCount"
    framed = f"""{_with()}
            SELECT id, concat(' ', chr(9), '"a|b",', content, chr(13), chr(10), '\\"', chr(10), ' ') AS content,
                   location FROM posts"""
    like_table = f"""{_with(_PATTERN_TABLE)}
            SELECT id, keyword FROM posts JOIN (SELECT DISTINCT wild AS keyword FROM patterns)
            ON {like_all.format("lower(keyword)")}"""
    return {
        "keyword_pairs": _pairs(_contains("content"), q.TERMS, "id, username, keyword"),
        "keyword_pairs_raw_case": _pairs(
            _contains("content", fold=False), q.TERMS, "id, username, keyword"
        ),
        "keyword_like_folded": _pairs(like_all.format("lower(keyword)"), q.WILDCARDS),
        "keyword_like_raw": _pairs(like_all.format("keyword"), q.WILDCARDS),
        "keyword_regex": _pairs(pattern.format(_LINE), q.PATTERNS),
        "keyword_regex_lines": _pairs(pattern.format("content"), q.PATTERNS),
        "keyword_spaced": _pairs(
            f"contains(lower({_LINE}), concat(' ', lower(keyword), ' '))", q.SPACED
        ),
        "keyword_words": _pairs(f"contains({_WORDS}, concat(' ', keyword, ' '))", q.WORDS),
        "keyword_count": f"""{_with()}
            SELECT count(*) AS numero FROM posts
            JOIN {_list(q.TERMS)} ON {_contains("content")}""",
        "keyword_count_tweets": f"""{_with()}
            SELECT count(*) AS numero FROM posts WHERE {_any(q.TERMS)}""",
        "keyword_table_pairs": f"""{_with(_TERM_TABLE)}
            SELECT id, keyword FROM posts JOIN terms ON {_contains("content")}""",
        "keyword_join_pairs": f"""{_with(_TERM_TABLE)}
            SELECT id, keyword FROM posts JOIN terms ON {_contains("content")}""",
        "keyword_regex_table": f"""{_with(_PATTERN_TABLE)}
            SELECT id, keyword FROM posts JOIN (SELECT DISTINCT pattern AS keyword FROM patterns)
            ON {pattern.format(_LINE)}""",
        "keyword_like_table": like_table,
        "keyword_like_join": like_table,
        "censor_matches": _pairs(_contains("content"), q.TERMS, rows),
        "censor_except": f"""{_with()}
            SELECT {rows} FROM posts
            EXCEPT
            SELECT {rows} FROM posts JOIN {_list(["err", "lic"])} ON {_contains("content")}""",
        "censor_except_content": f"""{_with()}
            SELECT content FROM posts
            EXCEPT SELECT content FROM posts WHERE {_contains("content", "'err'")}""",
        "censor_anti": f"""{_with(f'''lines AS (
                SELECT * REPLACE ({_LINE} AS content) FROM posts
            ), hits AS (
                SELECT DISTINCT content FROM lines JOIN {_list(q.SPACED)}
                ON contains(lower(content), concat(' ', lower(keyword), ' '))
            )''')}
            SELECT lines.content, username, likeCount, retweetCount
            FROM lines LEFT JOIN hits ON lines.content = hits.content
            WHERE hits.content IS NULL""",
        "labelled_docs": f"""{_with()}
            SELECT id, username, quality, toxic FROM posts JOIN labels ON id = doc_id""",
        "unlabelled_docs": f"""{_with()}
            SELECT id, username FROM posts
            WHERE NOT EXISTS (SELECT 1 FROM labels WHERE doc_id = id)""",
        "stance_pairs": f"""{_with(f"pairs AS ({_STANCE})")}
            SELECT id, tipo, keyword FROM pairs""",
        "stance_totals": _stance_totals("*"),
        "stance_totals_tweets": _stance_totals("DISTINCT id"),
        "stance_overlap": f"""{_with()}
            SELECT id, {_hits(q.PRO)} AS pro, {_hits(q.ANTI)} AS anti,
                   {_any(q.PRO)} AND {_any(q.ANTI)} AS overlap
            FROM posts WHERE {_any(q.PRO)} OR {_any(q.ANTI)}""",
        "stance_users": _ranked_users(q.PRO, _hits(q.PRO)),
        "stance_users_tweets": _ranked_users(q.ANTI, "1"),
        "state_counts_tweets": f"""{_with(_violent(_second("fullName"), True))}
            SELECT state, count(*) AS cantidad_tweets
            FROM (SELECT DISTINCT state, {rows} FROM found) GROUP BY state""",
        "state_counts_pairs": f"""{_with(_violent(_after("fullName"), False))}
            SELECT state, count(*) AS cantidad_tweets FROM found GROUP BY state""",
        "state_rules": f"""{_with(f'''longer AS (
                SELECT id, fullName, concat(fullName, ', ', country) AS place FROM posts
            )''')}
            SELECT id, {_second("fullName")} AS second, {_second("place")} AS second_of_three,
                   {_after("fullName")} AS after_comma, {_after("place")} AS after_comma_of_three
            FROM longer""",
        "state_members": f"""{_with(_violent(_second("fullName"), True))}
            SELECT state, count(*) OVER (PARTITION BY state) AS cantidad_tweets, {rows}
            FROM (SELECT DISTINCT state, {rows} FROM found)""",
        "state_members_pairs": f"""{_with(_violent(_second("fullName"), True, False))}
            SELECT state, count(*) OVER (PARTITION BY state) AS cantidad_tweets, id, username
            FROM found""",
        "state_groups": f"""{_with(_violent(_second("fullName"), True))}
            SELECT state, count(*) OVER (PARTITION BY state) AS cantidad_tweets, {rows}
            FROM found""",
        "state_groups_tweets": f"""{_with(_violent(_second("fullName"), True))}
            SELECT state, count(*) OVER (PARTITION BY state) AS cantidad_tweets, {rows}
            FROM (SELECT DISTINCT state, {rows} FROM found)""",
        "state_count_on_rows": f"""{_with()}
            SELECT id, state, count(*) OVER (PARTITION BY state) AS tweet_count
            FROM (SELECT id, {_second("fullName")} AS state FROM posts)""",
        "lexicon_score": f"""{_with(_scored(_SPACES))}
            SELECT tweet_id, tweet_content, tweet_rating FROM scored""",
        "lexicon_score_join": f"""{_with()}
            SELECT id AS tweet_id, content AS tweet_content,
                   round(avg(length(word) - 6), 12) AS tweet_rating
            FROM (SELECT id, content, unnest({_SPACES}) AS word FROM posts)
            GROUP BY id, content""",
        "lexicon_label": _label("negative"),
        "lexicon_neutral": _label("neutral"),
        "lexicon_split": _label("negative"),
        "lexicon_drop_unscored": f"""{_with(_scored(_MARKS, "word <> ''"))}
            SELECT tweet_id, tweet_rating,
                   CASE WHEN tweet_rating >= 0 THEN 'positive' ELSE 'negative' END AS sentiment
            FROM scored WHERE tweet_rating IS NOT NULL""",
        "lexicon_tokens": f"""{_with()}
            SELECT id, word FROM (SELECT id, unnest({_MARKS}) AS word FROM posts)
            WHERE word <> ''""",
        "rule_sentiment": f"{_with()} SELECT id, {_RULE} AS sentiment FROM posts",
        "rule_sentiment_like": f"""{_with()}
            SELECT id, CASE
                WHEN EXISTS (SELECT 1 FROM {_list(["gre_t", "lic"])}
                             WHERE lower(content) LIKE concat('%', keyword, '%'))
                THEN 'positive'
                WHEN EXISTS (SELECT 1 FROM {_list(["h%te", "sad"])}
                             WHERE lower(content) LIKE concat('%', keyword, '%'))
                THEN 'negative' ELSE 'neutral' END AS sentiment
            FROM posts""",
        "rule_sentiment_words": f"""{_with()}
            SELECT id, CASE WHEN {_word("great")} OR {_word("the")} THEN 'positive'
                            WHEN {_word("hate")} OR {_word("und")} THEN 'negative'
                            ELSE 'neutral' END AS sentiment
            FROM posts""",
        "rule_sentiment_table": f"""{_with(_WORD_TABLES)} SELECT id, {_RULE_TABLE} AS sentiment FROM posts""",
        "brand_sentiment_table": f"""{_with(_WORD_TABLES)},
            brands AS (SELECT * FROM {_list(q.BRANDS)} UNION SELECT s_name FROM supplier),
            counts AS (
                SELECT keyword, {_RULE_TABLE} AS sentiment, count(*) AS count
                FROM posts JOIN brands ON {_contains("content")} GROUP BY ALL
            )
            SELECT keyword AS restaurant, s.sentiment, coalesce(count, 0) AS count
            FROM brands CROSS JOIN (VALUES ('positive'), ('negative'), ('neutral')) s(sentiment)
            LEFT JOIN counts USING (keyword, sentiment)""",
        "brand_sentiment": f"{_with(_brand_counts(q.BRANDS))} SELECT * FROM counts",
        "brand_sentiment_zero": f"""{_with(_brand_counts(q.BRANDS))}
            SELECT b.keyword AS restaurant, s.sentiment, coalesce(c.count, 0) AS count
            FROM (SELECT * FROM {_list([*q.BRANDS, "no such brand"])}) b
            CROSS JOIN (VALUES ('positive'), ('negative'), ('neutral')) s(sentiment)
            LEFT JOIN counts c ON c.restaurant = b.keyword AND c.sentiment = s.sentiment""",
        "brand_trend_raw": f"""
            SELECT keyword AS restaurant, count(*) AS count
            FROM pages JOIN {_list(_TRIMMED)} ON {_contains("html", fold=False)}
            GROUP BY 1 ORDER BY count DESC, restaurant""",
        "brand_by_place": f"{_with()} {_BY_PLACE}",
        "brand_report": f"""{_with(f"counts AS ({_BY_PLACE})")}
            SELECT concat(printf('%-15s', restaurant), chr(9), printf('%-15s', location),
                          chr(9), CAST(count AS VARCHAR)) AS value
            FROM counts""",
        "report_file": f"""{_with()}
            SELECT concat(printf('%-15s', keyword), chr(9), CAST(count(*) AS VARCHAR)) AS value
            FROM posts JOIN {_list(_TRIMMED)} ON {_contains("content", fold=False)}
            GROUP BY keyword""",
        "name_substrings": f"""
            WITH names AS (
                SELECT DISTINCT lower(split_part(regexp_extract(
                    url, '^[a-z]+://([^/?#]+)', 1), '/', 1)) AS name FROM pages
            )
            SELECT substring, count(*) AS count FROM ({_SUBSTRINGS.format(least=5)})
            GROUP BY substring ORDER BY count DESC, substring LIMIT 100""",
        "name_substring_counts": f"""
            WITH names AS (SELECT DISTINCT lower(c_name) AS name FROM customer)
            SELECT substring, count(*) AS count FROM ({_SUBSTRINGS.format(least=8)})
            GROUP BY substring""",
        "json_field": """
            SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS INT) AS k,
                   json_extract_string(props, '$.k') AS k_text
            FROM events""",
        "json_parsed": """
            SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, count(*) AS count
            FROM events GROUP BY 1""",
        "json_roundtrip": f"{_with()} SELECT * FROM posts",
        "json_in_place": f"""{_with()}
            SELECT id, username, country FROM posts WHERE {_contains("content", "'Err'")}""",
        "sql_views": _ranked_users(
            ["great", "public", "lic", "und"], _hits(["great", "public", "lic", "und"])
        ),
        "json_bad_lines": """
            SELECT event_id AS id, 'good' AS kind FROM events
            UNION ALL SELECT event_id, 'bad' FROM events
            UNION ALL SELECT event_id, 'bad' FROM events""",
        "json_dropped_lines": """
            SELECT count(*) FILTER (event_id % 3 <> 0 AND event_id % 5 <> 0) AS kept, count(*) AS lines,
                   count(*) FILTER (event_id % 3 = 0 OR event_id % 5 = 0) AS bad_lines FROM events""",
        "text_in_place": """
            SELECT p_name AS keyword, count(*) AS count, max(length(p_name) + 3)::INT AS longest FROM part
            WHERE p_name LIKE '%ring%' GROUP BY p_name""",
        "sql_term_views": f"""{_with()},
            split AS (SELECT username, unnest(string_split(lower(content), ' ')) AS value FROM posts)
            SELECT username, count(*) AS words, sum(length(value) - 6)::BIGINT AS rating FROM split
            WHERE length(value) BETWEEN 4 AND 6 AND regexp_full_match(value, '[a-z]+') GROUP BY username""",
        "csv_whole": framed,
        "delimited_whole": framed,
        "cast_fields": """
            SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
                   TRY_CAST(json_extract_string(props, '$.k') || '.5' AS DOUBLE) AS half,
                   TRY_CAST(event_type AS INT) AS kind FROM events""",
        "json_same_rows": """
            SELECT used, count(*) AS rows FROM events, (VALUES ('id'), ('likeCount'), ('none')) AS u(used)
            WHERE event_id % 5 <> 0 AND event_id % 7 <> 0 GROUP BY used""",
        "csv_roundtrip": f"""{_with()}
            SELECT id, {_LINE} AS content, likeCount, fullName FROM posts""",
        "delimited_roundtrip": f"{_with()} SELECT id, {_LINE} AS content FROM posts",
        "ranked_tsv": _ranked_users(q.PRO, _hits(q.PRO)),
        "count_file": f"""{_with()}
            SELECT count(*) AS numero FROM posts
            JOIN {_list(q.TERMS)} ON {_contains("content")}""",
        "lexicon_file": "SELECT c_name AS word, c_nationkey AS rating FROM customer",
        "keyword_file": "SELECT concat(' ', p_name, '  ') AS keyword FROM part",
        "name_file": "SELECT DISTINCT p_name AS keyword FROM part",
        "cleaned_tokens": f"{_with(_TOKENS)} SELECT id, token FROM cleaned",
        "vocabulary": f"""{_with(_TOKENS)}
            SELECT token AS term, count(DISTINCT id) AS docs FROM cleaned GROUP BY token
            HAVING count(DISTINCT id) >= 5
               AND count(DISTINCT id) <= 0.5 * (SELECT count(*) FROM posts)""",
        "bag_of_words": f"""{_with(_TOKENS)}
            SELECT id, token AS term, count(*) AS count FROM cleaned GROUP BY id, token""",
        "lexicon_score_fractions": f"""{_with()}
            SELECT id AS tweet_id, round(avg(length(word) / 2), 12) AS tweet_rating
            FROM (SELECT id, content, unnest({_SPACES}) AS word FROM posts)
            GROUP BY id, content""",
        "stance_overlap_table": f"""{_with(_LONG_TABLE)}
            SELECT id, sum(CAST(side = 0 AS INT)) AS pro, sum(CAST(side = 1 AS INT)) AS anti,
                   bool_or(side = 0) AND bool_or(side = 1) AS overlap
            FROM posts JOIN listed ON {_contains("content")} GROUP BY id""",
        "censor_table_except": f"""{_with(_LONG_TABLE)}
            SELECT DISTINCT {rows} FROM posts p
            WHERE NOT EXISTS (SELECT 1 FROM listed WHERE {_contains("content")})""",
        "censor_table_anti": f"""{_with(_LONG_TABLE)}
            SELECT id FROM posts p
            WHERE NOT EXISTS (SELECT 1 FROM listed WHERE {_contains("content")})""",
        "sample_docs": f"{_with()} SELECT id, username FROM posts ORDER BY md5(CAST(id AS VARCHAR)), id LIMIT 100",
        "topic_kept_ids": f"""{_with(_TOKENS, _KNOWN_WORDS)}
            SELECT DISTINCT id FROM cleaned JOIN known USING (token)""",
        "topic_counts": f"""{_with(_TOKENS, *topic_oracle.model(TOPICS, PASSES), topic_oracle.labels(TOPICS))}
            SELECT topic_words, count(*) AS count FROM assigned JOIN labels USING (topic_id) GROUP BY topic_words""",
        "topic_assignments": f"""{_with(_TOKENS, *topic_oracle.model(5, PASSES))}
            SELECT id, coalesce(topic_id, (SELECT topic FROM most)) AS topic_id
            FROM posts LEFT JOIN assigned USING (id)""",
        "topic_labels": f"""{_with(_TOKENS, *topic_oracle.model(5, PASSES), topic_oracle.labels(5))}
            SELECT topic_id, topic_words FROM labels""",
        "topic_totals": f"""{_with(_TOKENS, _KNOWN_WORDS)}
            SELECT (SELECT count(DISTINCT id) FROM cleaned JOIN known USING (token)) AS kept,
                   (SELECT count(*) FROM posts) AS every""",
        "limit_docs": f"{_with()} SELECT id, username FROM posts ORDER BY id LIMIT 10",
    }
