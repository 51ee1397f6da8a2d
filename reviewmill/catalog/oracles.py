"""DuckDB SQL with the result every query must give, written apart from the Spark plans."""

from __future__ import annotations

VIEWS = {
    "rv_orders": """
        SELECT CAST(o_orderkey AS varchar) AS id, c_nationkey AS company_id, n_name AS company,
               CAST(o_orderdate AS timestamp) AS ts,
               CAST(substr(o_orderpriority, 1, 1) AS int) AS rating,
               CAST(CASE WHEN o_custkey % 7 = 6 THEN NULL ELSE o_custkey % 7 - 1 END AS int) AS category,
               CAST(CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderkey % 11 END AS int) AS likes,
               o_orderstatus AS status
        FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""",
    "rv_events": """
        SELECT CAST(event_id AS varchar) AS id, CAST(user_id AS int) AS company_id,
               event_type AS company, CAST(ts AS timestamp) AS ts,
               CAST(1 + event_id % 5 AS int) AS rating, CAST(user_id % 5 AS int) AS category
        FROM events""",
    "rv_text": """
        SELECT CAST(doc_id AS varchar) AS id, source AS company, text AS content,
               CAST(1 + doc_id % 5 AS int) AS rating,
               CAST(CASE lang WHEN 'en' THEN 0 WHEN 'de' THEN 1 WHEN 'fr' THEN 2 ELSE 4 END AS int) AS category,
               embedding
        FROM documents LEFT JOIN embeddings ON doc_id = vec_id""",
    "company": """
        SELECT n_nationkey AS id, n_name AS name, lower(n_name) AS homepage, r_name AS country, embedding
        FROM nation JOIN region ON n_regionkey = r_regionkey
             LEFT JOIN embeddings ON n_nationkey = vec_id""",
    "q_vecs": """
        SELECT CAST(vec_id AS varchar) AS similarity_query, embedding AS q_embedding
        FROM embeddings WHERE vec_id IN (3, 7)""",
}


def _with(names: str, body: str) -> str:
    parts = [f"{name} AS ({VIEWS[name]})" for name in names.split()]
    return "WITH " + ", ".join(parts) + ("" if body.lstrip().startswith(",") else "\n") + body


def _category_name(code: str) -> str:
    return (
        f"CASE WHEN {code} IS NULL OR {code} IN (-1, 0) THEN 'other' WHEN {code} = 1 THEN 'customer service' "
        f"WHEN {code} = 2 THEN 'counseling' WHEN {code} = 3 THEN 'mobile/web bank' "
        f"WHEN {code} = 4 THEN 'fees and interest rates' END"
    )


def _label(code: str) -> str:
    return (
        f"CASE {code} WHEN -1 THEN '' WHEN 0 THEN 'Andet' WHEN 1 THEN 'Kundeservice' WHEN 2 THEN 'Rådgivning' "
        f"WHEN 3 THEN 'mobil/net bank' WHEN 4 THEN 'Gebyrer/renter' END"
    )


def _round(value: str, digits: int) -> str:
    return f"CAST(round_even({value}, {digits}) AS DOUBLE)"


def _uniform(seed: int, key: str) -> str:
    return f"((('0x' || substr(md5('{seed}:' || {key}), 1, 13))::BIGINT + 1)::DOUBLE / 4503599627370497.0)"


STAR_COUNTS = ", ".join(
    f"count(*) FILTER (WHERE rating = {s}) AS stars_{s}" for s in range(1, 6)
)
FACTS = "id, company_id, company, ts AS timestamp, rating, category, likes"
TARGET = (
    "id, company_id, company, ts AS timestamp, CAST(NULL AS timestamp) AS created_at, "
    "CAST(NULL AS varchar) AS content, rating, likes, category"
)
BATCH_TIME = "TIMESTAMP '2024-06-01 12:00:00'"
TOKENS = r"length(regexp_extract_all({0}, '\p{{L}}+|\p{{N}}{{1,3}}|[^\s\p{{L}}\p{{N}}]+'))"

# Periods of a selection `r(company, ts, rating)`, their granularity chosen by its span.
PERIODS = """
    , g AS (SELECT CASE WHEN max(ts) - min(ts) < INTERVAL 45 DAY THEN 'day'
                        WHEN max(ts) - min(ts) < INTERVAL 150 DAY THEN 'week' ELSE 'month' END AS gran FROM r),
    p AS (SELECT company, rating, gran, date_trunc(gran, ts)::timestamp AS start FROM r, g),
    steps AS (SELECT *, CASE gran WHEN 'day' THEN INTERVAL 1 DAY WHEN 'week' THEN INTERVAL 7 DAY
                        ELSE INTERVAL 1 MONTH END AS step FROM g)
"""
LABEL = """CASE gran WHEN 'day' THEN start::date WHEN 'week' THEN start::date + 6
                     ELSE last_day(start::date) END"""


def _rating_series(views: str, selection: str) -> str:
    percents = ", ".join(
        f"CASE WHEN n > 0 THEN {_round(f'100.0 * stars_{s} / n', 2)} END AS pct_stars_{s}"
        for s in range(1, 6)
    )
    stars = ", ".join(f"coalesce(stars_{s}, 0) AS stars_{s}" for s in range(1, 6))
    return _with(
        views,
        f""", r AS ({selection}) {PERIODS},
        c AS (SELECT unnest(generate_series((SELECT min(start) FROM p), (SELECT max(start) FROM p),
                                            (SELECT step FROM steps))) AS start, gran FROM g),
        a AS (SELECT start, avg(rating) AS m, count(rating) AS n, {STAR_COUNTS} FROM p GROUP BY start)
        SELECT {LABEL} AS period, coalesce(m, 0.0) AS mean_rating, {stars}, {percents}
        FROM c LEFT JOIN a USING (start)""",
    )


def _compare_series(views: str, selection: str, companies: str = "true") -> str:
    return _with(
        views,
        f""", r AS ({selection}) {PERIODS},
        b AS (SELECT company, min(start) AS lo, max(start) AS hi FROM p WHERE {companies} GROUP BY company),
        c AS (SELECT company, gran, unnest(generate_series(lo, hi, step)) AS start FROM b, steps),
        a AS (SELECT company, start, avg(rating) AS m, count(*) AS n FROM p GROUP BY company, start)
        SELECT company, {LABEL} AS period, {_round('coalesce(m, 0.0)', 1)} AS mean,
               {_round('coalesce(m, 0.0)', 2)} AS trace_mean, coalesce(n, 0) AS count
        FROM c LEFT JOIN a USING (company, start)""",
    )


ORDERS_RATED = "SELECT company, ts, rating FROM rv_orders"
WEEK_RATED = ORDERS_RATED + " WHERE ts BETWEEN '1999-01-01' AND '1999-04-30'"
EVENTS_RATED = "SELECT company, ts, rating FROM rv_events"

# The upsert batch after its last delivery has won, and what it does to a stored review.
UPSERT_BATCH = """
    , edits AS (SELECT id, company_id, company, ts + INTERVAL 1 DAY AS ts, 6 - rating AS rating
                FROM rv_orders WHERE status = 'P'),
    news AS (SELECT 'e' || id AS id, company_id, company, ts, rating FROM rv_events)
"""
UPDATED = f"""
    SELECT o.id, o.company_id, o.company, coalesce(e.ts, o.ts) AS timestamp,
           CAST(NULL AS timestamp) AS created_at, CAST(NULL AS varchar) AS content,
           coalesce(e.rating, o.rating) AS rating, o.likes, o.category
    FROM rv_orders o LEFT JOIN edits e ON o.id = e.id"""
INSERTED = f"""
    SELECT id, company_id, company, ts AS timestamp, {BATCH_TIME} AS created_at, '' AS content,
           rating, CAST(NULL AS int) AS likes, CAST(NULL AS int) AS category
    FROM news"""

MEMBER_ANY = "(company IN ('NATION_3', 'NATION_7') OR category IN (1, 4))"
MEMBER_ALL = "(company IN ('NATION_3', 'NATION_7') AND category IN (1, 4))"

DISTANCE = "list_distance({0}::double[], {1}::double[])"

SAMPLE_ROWS = ", s AS (SELECT id, company, content, rating, category, CAST(rating AS varchar) AS similarity_query FROM rv_text)"
UNIFORM_300 = f", u AS (SELECT * FROM s ORDER BY {_uniform(11, 'id')}, id LIMIT 300)"
BUDGET = f"""
    , t AS (SELECT avg({TOKENS.format('content')}) AS avg_tokens FROM u),
    b AS (SELECT (SELECT count(*) FROM s) AS n_rows, avg_tokens,
                 CAST(floor(50000 / avg_tokens) AS BIGINT) AS budget FROM t)"""
WEIGHTED = f"""
    , w AS (SELECT category, company, similarity_query, count(*) AS n FROM s GROUP BY ALL),
    k AS (SELECT s.*, row_number() OVER (ORDER BY -ln({_uniform(11, 'id')}) / n, id) AS rk
          FROM s JOIN w ON s.category = w.category AND s.company = w.company
                       AND s.similarity_query = w.similarity_query)"""

ORACLES: dict[str, str] = {
    "scan_reviews": _with("rv_orders", f"SELECT {FACTS} FROM rv_orders"),
    "lookup_by_id": _with("rv_orders", f"SELECT {FACTS} FROM rv_orders WHERE id = '1234'"),
    "lookup_many": _with(
        "rv_orders",
        f"""SELECT {FACTS} FROM rv_orders WHERE id IN
            (SELECT CAST(l_orderkey AS varchar) FROM lineitem WHERE l_returnflag = 'R')""",
    ),
    "page_reviews": _with(
        "rv_orders", f"SELECT {FACTS} FROM rv_orders ORDER BY id LIMIT 100 OFFSET 200"
    ),
    "page_after_key": _with(
        "rv_orders", f"SELECT {FACTS} FROM rv_orders WHERE id > '1234' ORDER BY id LIMIT 100"
    ),
    "conform_schema": _with("rv_orders", f"SELECT {TARGET} FROM rv_orders"),
    "insert_reviews": _with(
        "rv_orders rv_events", f"{UPSERT_BATCH} SELECT {TARGET} FROM rv_orders UNION ALL {INSERTED}"
    ),
    "upsert_reviews": _with(
        "rv_orders rv_events", f"{UPSERT_BATCH} {UPDATED} UNION ALL {INSERTED}"
    ),
    "update_reviews": _with("rv_orders rv_events", f"{UPSERT_BATCH} {UPDATED}"),
    "delete_reviews": _with("rv_orders", f"SELECT {TARGET} FROM rv_orders WHERE status <> 'P'"),
    "changed_reviews": _with(
        "rv_orders rv_events",
        f"""{UPSERT_BATCH} SELECT id, company_id, company, ts AS timestamp, rating FROM edits
            UNION ALL SELECT id, company_id, company, ts AS timestamp, rating FROM news""",
    ),
    "extract_reviews": _with(
        "rv_orders",
        """SELECT id, company_id, company, ts AS timestamp,
                  'Order «' || id || '»' || chr(10) || 'rated' AS content, rating, likes,
                  'scraped' AS source FROM rv_orders""",
    ),
    "extract_companies": """
        SELECT c_name AS name, lower(c_name) AS homepage, c_custkey % 5 + 0.5::double AS stars,
               c_acctbal AS trust_score, CAST(c_custkey AS int) AS n_reviews, n_name AS country
        FROM customer JOIN nation ON c_nationkey = n_nationkey""",
    "ingest_reviews": _with(
        "rv_orders",
        f"""SELECT id, company_id, company, ts AS timestamp,
               CASE WHEN status <> 'P' THEN {BATCH_TIME} END AS created_at,
               CASE WHEN status <> 'P' OR rating = 1
                    THEN 'Order «' || id || '»' || chr(10) || 'rated' END AS content,
               rating, likes, CASE WHEN status = 'P' THEN category END AS category,
               CAST(CASE WHEN status <> 'P' OR rating = 1 THEN 768 END AS int) AS dim
        FROM rv_orders""",
    ),
    "ingest_companies": _with(
        "company",
        """SELECT id, name, homepage, country FROM company UNION ALL
           SELECT CAST(24 + row_number() OVER (ORDER BY lower(c_name)) AS int), c_name, lower(c_name), n_name
           FROM customer JOIN nation ON c_nationkey = n_nationkey""",
    ),
    "next_page_link": """
        SELECT page_id, CASE WHEN contains(url, 'page=') THEN
               'https://reviews.example' || regexp_extract(url, '^https?://[^/]+(/[^#]*)', 1) END AS next_url
        FROM pages""",
    "page_links": """
        WITH l AS (SELECT page_id, regexp_extract_all(html, '(?is)\\bhref=["'']([^"'']*)["'']', 1) AS links
                   FROM pages)
        SELECT page_id, CAST(unnest(range(len(links))) AS int) AS pos, unnest(links) AS link FROM l""",
    "cap_pages": """
        WITH c AS (SELECT regexp_extract(url, '^https?://([^/]+)', 1) AS company, page_id AS page_no,
                          length(html) > 2000 AS has_reviews FROM pages),
        r AS (SELECT *, row_number() OVER (PARTITION BY company ORDER BY page_no) AS rn FROM c),
        stop AS (SELECT company, min(rn) AS first_empty FROM r WHERE NOT has_reviews GROUP BY company)
        SELECT company, page_no FROM r LEFT JOIN stop USING (company)
        WHERE rn <= 39 AND rn < coalesce(first_empty, 1000000000)""",
    "capped_reviews": _with(
        "rv_orders",
        """, p AS (SELECT *, dense_rank() OVER (PARTITION BY company ORDER BY CAST(id AS bigint) // 20) AS page_rank
                  FROM rv_orders)
        SELECT id, company, rating FROM p WHERE page_rank <= 39""",
    ),
    "report_csv": _with(
        "rv_orders",
        f""", c AS (SELECT rating, count(*) AS n FROM rv_orders GROUP BY rating)
        SELECT 'rating,count,percentage' AS line UNION ALL
        SELECT rating || ',' || n || ',' || {_round('100.0 * n / (SELECT sum(n) FROM c)', 1)} FROM c""",
    ),
    "sql_preview": _with(
        "rv_orders",
        """SELECT company, CAST(rating AS varchar) AS rating, CAST(likes AS varchar) AS likes
           FROM rv_orders ORDER BY CAST(id AS bigint) LIMIT 20""",
    ),
    "review_payload": _with(
        "rv_text",
        f"""{SAMPLE_ROWS} {WEIGHTED}
        SELECT company, {_category_name('category')} AS category, similarity_query,
               CAST(count(*) AS int) AS n_reviews,
               string_agg(content, chr(10) || '--' || chr(10) ORDER BY CAST(id AS int)) AS reviews
        FROM k WHERE rk <= 100 GROUP BY ALL""",
    ),
    "review_payload_json": _with(
        "rv_text",
        f"""{SAMPLE_ROWS} {WEIGHTED}
        SELECT company, {_category_name('category')} AS category, similarity_query, content
        FROM k WHERE rk <= 100""",
    ),
    "project_cols": _with("rv_orders", "SELECT id, company, rating FROM rv_orders"),
    "filter_equals": _with(
        "rv_orders", "SELECT id, company, rating, category FROM rv_orders WHERE category = 0 AND rating = 5"
    ),
    "filter_in_any": _with(
        "rv_orders", f"SELECT id, company, category FROM rv_orders WHERE {MEMBER_ANY}"
    ),
    "filter_in_all": _with(
        "rv_orders", f"SELECT id, company, category FROM rv_orders WHERE {MEMBER_ALL}"
    ),
    "filter_dates": _with(
        "rv_orders",
        """SELECT company, count(*) FILTER (WHERE ts BETWEEN '1997-01-01' AND '1998-06-15') AS n_both,
                  count(*) FILTER (WHERE ts >= '1999-07-01') AS n_start,
                  count(*) FILTER (WHERE ts <= '1996-02-29') AS n_end, count(*) AS n_none
           FROM rv_orders GROUP BY company""",
    ),
    "review_search": _with(
        "rv_orders",
        f"""SELECT id, company, ts AS timestamp, category FROM rv_orders
            WHERE rating = 4 AND {MEMBER_ANY} AND ts BETWEEN '1996-01-01' AND '2000-12-31'
            ORDER BY ts DESC, id LIMIT 150""",
    ),
    "filter_text": _with(
        "rv_orders",
        """, d AS (SELECT *, strftime(ts, '%Y-%m-%d') AS day FROM rv_orders)
        SELECT id, concat_ws(' AND ',
            CASE WHEN rating > 1 THEN 'company IN (''' || company || ''', ''O''''Neil'')' END,
            CASE WHEN category IS NOT NULL THEN 'category IN (' || category || ')' END,
            CASE WHEN rating > 2 AND likes IS NOT NULL
                      THEN 'timestamp BETWEEN ''' || day || ''' AND ''' || day || ''''
                 WHEN rating > 2 THEN 'timestamp >= ''' || day || ''''
                 WHEN likes IS NOT NULL THEN 'timestamp <= ''' || day || '''' END) AS filter
        FROM d""",
    ),
    "newest_reviews": _with(
        "rv_orders", f"SELECT {FACTS} FROM rv_orders ORDER BY ts DESC, id LIMIT 100"
    ),
    "review_company_join": _with(
        "rv_orders company",
        """SELECT r.id, r.company_id, r.rating, c.name AS company_name, c.country
           FROM rv_orders r JOIN company c ON r.company_id = c.id""",
    ),
    "knn_single": _with(
        "rv_text q_vecs",
        f"""SELECT id, round(dist, 6) AS dist FROM (
            SELECT id, {DISTANCE.format('embedding', 'q_embedding')} AS dist
            FROM rv_text, q_vecs WHERE similarity_query = '3' ORDER BY dist NULLS LAST, id LIMIT 600)""",
    ),
    "knn_reviews": _with(
        "rv_text q_vecs",
        f""", d AS (SELECT similarity_query, id, company, {_category_name('category')} AS category, content,
                          {DISTANCE.format('embedding', 'q_embedding')} AS dist FROM rv_text, q_vecs),
        r AS (SELECT *, CAST(row_number() OVER (PARTITION BY similarity_query ORDER BY dist NULLS LAST, id)
                             AS int) AS rn FROM d)
        SELECT similarity_query, rn, id, company, category, content, round(dist, 6) AS dist
        FROM r WHERE rn <= floor(150 / (SELECT count(*) FROM q_vecs))""",
    ),
    "knn_all_vectors": f"""
        WITH d AS (SELECT a.vec_id, b.vec_id AS id, {DISTANCE.format('a.embedding', 'b.embedding')} AS dist
                   FROM embeddings a, embeddings b),
        r AS (SELECT *, CAST(row_number() OVER (PARTITION BY vec_id ORDER BY dist, id) AS int) AS rn FROM d)
        SELECT vec_id, rn, id, round(dist, 6) AS dist FROM r WHERE rn <= 5""",
    "nearest_company": _with(
        "company",
        f""", d AS (SELECT CAST(e.vec_id AS varchar) AS mention, c.name, c.id,
                          {DISTANCE.format('e.embedding', 'c.embedding')} AS dist FROM embeddings e, company c)
        SELECT mention, name, id, round(dist, 6) AS dist FROM d
        QUALIFY row_number() OVER (PARTITION BY mention ORDER BY dist NULLS LAST, id) = 1""",
    ),
    "report_rating_share": _with(
        "rv_orders",
        f""", c AS (SELECT rating, count(*) AS count FROM rv_orders GROUP BY rating)
        SELECT rating, count, {_round('100.0 * count / (SELECT sum(count) FROM c)', 1)} AS percentage FROM c""",
    ),
    "report_category_stars": _with(
        "rv_orders",
        f""", l(category_code, category) AS (VALUES (0, 'Andet'), (1, 'Kundeservice'), (2, 'Rådgivning'),
                                              (3, 'mobil/net bank'), (4, 'Gebyrer/renter'))
        SELECT category_code, l.category, {STAR_COUNTS}, count(rating) AS total
        FROM l LEFT JOIN rv_orders r ON r.category = category_code GROUP BY category_code, l.category""",
    ),
    "ts_ratings_month": _rating_series("rv_orders", ORDERS_RATED),
    "ts_ratings_week": _rating_series("rv_orders", WEEK_RATED),
    "ts_ratings_day": _rating_series("rv_events", EVENTS_RATED),
    "ts_ratings_fixed_day": _rating_series("rv_orders", ORDERS_RATED).replace(
        "max(ts) - min(ts) < INTERVAL 45 DAY", "true"
    ),
    "ts_diverging_counts": _with(
        "rv_orders",
        """, m AS (SELECT unnest(generate_series((SELECT date_trunc('month', min(ts)) FROM rv_orders)::timestamp,
                        (SELECT max(ts) FROM rv_orders), INTERVAL 1 MONTH)) AS start),
        s AS (SELECT unnest([1, 2, 3, 4, 5]) AS rating),
        n AS (SELECT date_trunc('month', ts)::timestamp AS start, rating, count(*) AS n FROM rv_orders GROUP BY ALL)
        SELECT last_day(m.start::date) AS period, s.rating,
               CASE WHEN s.rating <= 2 THEN -1 ELSE 1 END * coalesce(n, 0) AS signed_count
        FROM m CROSS JOIN s LEFT JOIN n ON n.start = m.start AND n.rating = s.rating""",
    ),
    "ts_compare": _compare_series("rv_orders", ORDERS_RATED),
    "ts_compare_week": _compare_series(
        "rv_orders", WEEK_RATED, "company IN ('NATION_1', 'NATION_2', 'NATION_99')"
    ),
    "ts_compare_day": _compare_series("rv_events", EVENTS_RATED),
    "report_company_stars_pct": _with(
        "rv_orders",
        "SELECT company, "
        + ", ".join(
            f"{_round(f'100.0 * count(*) FILTER (WHERE rating = {s}) / count(*)', 1)} AS pct_stars_{s}"
            for s in range(1, 6)
        )
        + " FROM rv_orders GROUP BY company",
    ),
    "company_star_bars": _with(
        "rv_orders",
        f""", c AS (SELECT company, rating, count(*) AS count FROM rv_orders GROUP BY ALL),
        p AS (SELECT *, count / sum(count) OVER (PARTITION BY company) AS pct FROM c)
        SELECT company, rating, count, round(pct, 9) AS pct,
               '% ' || {_round('pct * 100', 1)} || '<br># ' || count AS label FROM p""",
    ),
    "company_summary": _with(
        "rv_orders",
        f"""SELECT company, {_round('avg(rating)', 2)} AS mean, count(*) AS count,
               company || ' <br> ☆' || {_round('avg(rating)', 2)} || ' <br> #' || count(*) AS axis_label
        FROM rv_orders GROUP BY company""",
    ),
    "period_bounds": _with("rv_events", "SELECT min(ts) AS first_ts, max(ts) AS last_ts FROM rv_events"),
    "pick_granularity": _with(
        "rv_orders",
        """, spans AS (
            SELECT 'whole' AS span, max(ts) - min(ts) AS d FROM rv_orders UNION ALL
            SELECT 'weeks', max(ts) - min(ts) FROM rv_orders WHERE ts BETWEEN '1999-01-01' AND '1999-04-30' UNION ALL
            SELECT 'days', max(ts) - min(ts) FROM rv_orders WHERE ts BETWEEN '1999-01-01' AND '1999-02-10')
        SELECT span, CASE WHEN d < INTERVAL 45 DAY THEN 'day' WHEN d < INTERVAL 150 DAY THEN 'week'
                          ELSE 'month' END AS granularity FROM spans""",
    ),
    "report_by_name": _with(
        "rv_orders",
        """, r AS (SELECT * FROM rv_orders WHERE (company IN ('NATION_4', 'NATION_9') OR category IN (2))
                  AND ts BETWEEN '1996-01-01' AND '1998-12-31'),
        c AS (SELECT company, date_diff('month', min(ts), max(ts)) + 1 AS n FROM r
              WHERE company IN ('NATION_4', 'NATION_9') GROUP BY company)
        SELECT 'ratings time series for single company' AS report,
               date_diff('month', min(ts), max(ts)) + 1 AS n_rows FROM r UNION ALL
        SELECT 'ratings piecharts by review category for single company', 5 UNION ALL
        SELECT 'ratings piechart for single company', count(DISTINCT rating) FROM r UNION ALL
        SELECT 'ratings and review count time series comparing companies', CAST(sum(n) AS BIGINT) FROM c UNION ALL
        SELECT 'ratings distribution comparing companies', count(*) FROM c""",
    ),
    "group_weights": _with(
        "rv_text",
        f"""{SAMPLE_ROWS}, c AS (SELECT category, company, similarity_query, count(*) AS n FROM s GROUP BY ALL)
        SELECT *, round(n / (SELECT sum(n) FROM c), 9) AS weight FROM c""",
    ),
    "uniform_sample": _with(
        "rv_text", f"{SAMPLE_ROWS} {UNIFORM_300} SELECT id, company, rating, content FROM u"
    ),
    "avg_tokens": _with(
        "rv_text", f"{SAMPLE_ROWS} {UNIFORM_300} {BUDGET} SELECT round(avg_tokens, 6) AS avg_tokens FROM t"
    ),
    "sample_budget": _with(
        "rv_text",
        f"""{SAMPLE_ROWS} {UNIFORM_300} {BUDGET}
        SELECT n_rows, round(avg_tokens, 6) AS avg_tokens, budget FROM b""",
    ),
    "weighted_sample": _with(
        "rv_text",
        f"""{SAMPLE_ROWS} {WEIGHTED}
        SELECT id, company, category, similarity_query FROM k WHERE rk <= 100""",
    ),
    "representative_sample": _with(
        "rv_text",
        f"""{SAMPLE_ROWS} {UNIFORM_300} {BUDGET} {WEIGHTED}
        SELECT id, company, content, rating, category, similarity_query FROM k
        WHERE rk <= (SELECT budget FROM b) OR (SELECT budget > n_rows FROM b)""",
    ),
    "analyse_reviews": _with(
        "rv_text q_vecs",
        f""", d AS (SELECT similarity_query, id, company, {_category_name('category')} AS category, content,
                          {DISTANCE.format('embedding', 'q_embedding')} AS dist FROM rv_text, q_vecs),
        s AS (SELECT *, row_number() OVER (PARTITION BY similarity_query ORDER BY dist NULLS LAST, id) AS rn
              FROM d QUALIFY rn <= floor(150 / (SELECT count(*) FROM q_vecs))),
        u AS (SELECT * FROM s ORDER BY {_uniform(11, "similarity_query || ':' || id")}, similarity_query, id
              LIMIT 300),
        b AS (SELECT floor(25000 / avg({TOKENS.format('content')})) AS budget FROM u),
        w AS (SELECT category, company, similarity_query, count(*) AS n FROM s GROUP BY ALL),
        k AS (SELECT s.*, row_number() OVER (ORDER BY -ln({_uniform(11, "s.similarity_query || ':' || id")}) / n,
                                             s.similarity_query, id) AS rk
              FROM s JOIN w ON s.category = w.category AND s.company = w.company
                           AND s.similarity_query = w.similarity_query)
        SELECT company, category, similarity_query,
               string_agg(content, chr(10) || '--' || chr(10) ORDER BY rn) AS reviews
        FROM k WHERE rk <= (SELECT budget FROM b) OR (SELECT budget FROM b) > (SELECT count(*) FROM s)
        GROUP BY ALL""",
    ),
    "decode_category": _with(
        "rv_orders",
        f"""SELECT id, category, {_category_name('category')} AS category_name, {_label('category')} AS label
        FROM rv_orders""",
    ),
    "encode_category": _with(
        "rv_orders",
        """SELECT id, CASE WHEN category > 0 THEN category ELSE 0 END AS from_name,
                  CASE WHEN category >= 0 THEN category END AS from_label FROM rv_orders""",
    ),
    "clean_text": "SELECT doc_id, replace(text, chr(10), ' ') AS content FROM documents",
    "strip_sql": """
        SELECT conv_id, turn, trim(text, ' "' || chr(10)) AS stripped FROM conversations""",
    "token_count": f"SELECT doc_id, {TOKENS.format('text')} AS n_tokens FROM documents",
    "vector_l2": f"""
        SELECT a.vec_id, round({DISTANCE.format('a.embedding', 'b.embedding')}, 6) AS dist
        FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""",
    "embed_text": r"""
        SELECT doc_id, CAST(768 AS int) AS dim,
               CASE WHEN regexp_matches(text, '[\p{L}\p{N}]') THEN 1.0::double ELSE 0.0::double END AS norm
        FROM documents""",
    "parse_dates": _with(
        "rv_orders",
        """SELECT id, CASE WHEN category IN (3, 4) THEN NULL
                          WHEN category = 1 THEN date_trunc('month', ts)::date ELSE ts::date END AS date
           FROM rv_orders""",
    ),
    "epoch_ms": _with("rv_events", "SELECT id, CAST(round_even(epoch_us(ts) / 1000, 0) AS BIGINT) AS ms FROM rv_events"
    ),
    "parse_metadata": _with(
        "rv_orders",
        f"""SELECT id AS request_id, CASE WHEN likes IS NULL THEN '' ELSE company || '|Å & Ø' END AS companies,
               CASE WHEN likes IS NOT NULL THEN ts::date END AS start_date, CAST(NULL AS date) AS end_date,
               CASE WHEN likes IS NULL THEN '' ELSE {_category_name('category')} END AS categories
        FROM rv_orders""",
    ),
    "resolve_companies": _with(
        "rv_orders",
        """SELECT id AS request_id, company || '|NATION_7' AS companies, ts::date AS start_date FROM rv_orders""",
    ),
    "parse_plan": _with(
        "rv_orders",
        """SELECT id AS request_id, 0 AS step_no, 'SQL: [''Rating of ' || company || ': how high?'']' AS step
           FROM rv_orders WHERE rating <= 2 UNION ALL
           SELECT id, 0, 'PLOT: [''ratings time series for single company'', ''ratings piechart for single company'']'
           FROM rv_orders WHERE rating = 3 UNION ALL
           SELECT id, 1, 'ANALYSE REVIEWS: ["Lange ventetider på svar", "Ros til' || chr(9) || 'personalet"]'
           FROM rv_orders WHERE rating = 3""",
    ),
    "plan_steps": _with(
        "rv_orders",
        """SELECT id AS request_id, 0 AS step_no, 'SQL' AS action, 'Rating of ' || company || ': how high?' AS args
           FROM rv_orders WHERE rating <= 2 UNION ALL
           SELECT id, 0, 'PLOT', 'ratings time series for single company|ratings piechart for single company'
           FROM rv_orders WHERE rating = 3 UNION ALL
           SELECT id, 1, 'ANALYSE REVIEWS', 'Lange ventetider på svar|Ros til' || chr(9) || 'personalet'
           FROM rv_orders WHERE rating = 3""",
    ),
    "mention_extract": _with(
        "rv_orders",
        f"""SELECT id AS request_id,
               CASE WHEN company = 'NATION_2' THEN company WHEN company < 'NATION_2' THEN company || '|NATION_2'
                    ELSE 'NATION_2|' || company END AS companies,
               strftime(ts, '%Y-%m-%d') AS start_date,
               CASE WHEN likes IS NULL THEN '' ELSE '2001-12-31' END AS end_date,
               CASE WHEN category > 0 THEN {_category_name('category')} ELSE '' END AS categories
        FROM rv_orders""",
    ),
    "prompt_rows": _with(
        "rv_orders",
        """SELECT id, 'About ' || CASE WHEN rating = 1 THEN 'companies: ' || company || ', Z'
                                       ELSE 'company: ' || company END || '.' || chr(10)
               || CASE WHEN likes IS NULL THEN '' ELSE 'Since ' || strftime(ts, '%Y-%m-%d') || '.' || chr(10) END
               || 'Question: rating of ' || id AS prompt FROM rv_orders""",
    ),
    "last_messages": """
        WITH k AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn
                   FROM conversations WHERE role <> 'plot')
        SELECT conv_id, turn, role, text,
               CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS int) AS position
        FROM k WHERE rn <= 3""",
    "last_by_role": """
        SELECT conv_id, role, text FROM conversations
        QUALIFY row_number() OVER (PARTITION BY conv_id, role ORDER BY turn DESC) = 1""",
    "latest_question": """
        SELECT conv_id, text AS question FROM conversations
        QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1""",
    "stream_upsert": _with(
        "rv_events",
        """SELECT id, company_id, company, CASE WHEN company = 'purchase' THEN ts + INTERVAL 1 HOUR ELSE ts END
                  AS timestamp, CASE WHEN company = 'purchase' THEN 6 - rating ELSE rating END AS rating,
                  category, '' AS content, CAST(NULL AS int) AS likes FROM rv_events""",
    ),
    "stream_ingest_pages": _with(
        "rv_orders",
        """SELECT id, company_id, company, ts AS timestamp,
                  'Order «' || id || '»' || chr(10) || 'rated' AS content, rating, likes FROM rv_orders""",
    ),
    "stream_dedup": _with(
        "rv_events", "SELECT id, company_id, company, ts AS timestamp, rating, category FROM rv_events"
    ),
    "stream_ratings_day": _with(
        "rv_events",
        """SELECT company, ts::date AS period, count(*) AS count, round(avg(rating), 9) AS mean
           FROM rv_events GROUP BY company, ts::date""",
    ),
    "stream_ratings_week": _with(
        "rv_events",
        """SELECT company, date_trunc('week', ts)::date + 6 AS period, count(*) AS count,
                  round(avg(rating), 9) AS mean
           FROM rv_events GROUP BY ALL""",
    ),
    "sql_top_company": _with(
        "rv_orders",
        """SELECT company, avg(rating) AS mean_rating, count(*) AS n_reviews FROM rv_orders
           WHERE ts >= '1998-01-01' GROUP BY company ORDER BY mean_rating DESC, company LIMIT 1""",
    ),
    "sql_most_reviews": _with(
        "rv_orders",
        """SELECT company, count(*) AS n_reviews FROM rv_orders
           GROUP BY company ORDER BY n_reviews DESC, company LIMIT 1""",
    ),
    "sql_rating_trend": _with(
        "rv_orders",
        """SELECT date_trunc('month', ts)::date AS month, avg(rating) AS mean_rating, count(*) AS n_reviews
           FROM rv_orders WHERE company = 'NATION_5' AND ts >= '1998-01-01' GROUP BY ALL""",
    ),
    "sql_compare_set": _with(
        "rv_orders",
        """SELECT company, avg(rating) AS mean_rating, count(*) AS n_reviews,
                  count(*) FILTER (WHERE rating >= 4) AS n_positive
           FROM rv_orders WHERE company IN ('NATION_1', 'NATION_2', 'NATION_3') GROUP BY company""",
    ),
}
ORACLES["merge_stored_months"] = ORACLES["upsert_reviews"]
ORACLES["upsert_out_of_order"] = ORACLES["upsert_reviews"]
ORACLES["stream_upsert_late"] = ORACLES["stream_upsert"]
ORACLES["stream_ratings_month"] = _with(
    "rv_events",
    """SELECT company, last_day(ts::date) AS period, count(*) AS count, round(avg(rating), 9) AS mean
       FROM rv_events GROUP BY ALL""",
)
ORACLES["avg_letters"] = _with(
    "rv_text", f"{SAMPLE_ROWS} {UNIFORM_300} SELECT round(avg(length(content)), 6) AS avg_tokens FROM u"
)
ORACLES["embed_by_letters"] = """
SELECT doc_id, CAST(length(coalesce(text, '')) AS float) AS letters,
       CAST(length(replace(coalesce(text, ''), 'e', '')) AS float) AS without_e FROM documents"""
ORACLES["unknown_company_reviews"] = _with(
    "rv_orders", "SELECT id, lower(company) AS homepage, rating FROM rv_orders WHERE company_id >= 10"
)
for stored_form, whole_form in (
    ("update_stored_months", "update_reviews"),
    ("delete_stored_months", "delete_reviews"),
    ("insert_stored_months", "insert_reviews"),
):
    ORACLES[stored_form] = ORACLES[whole_form]
ORACLES["published_between"] = _with(
    "rv_orders",
    """SELECT id, company, ts AS timestamp, rating, category FROM rv_orders
       WHERE ts BETWEEN '1996-02-10' AND '1997-05-20'""",
)
ORACLES["sql_reviews_between"] = _with(
    "rv_orders",
    """SELECT company, count(*) AS n_reviews FROM rv_orders WHERE ts BETWEEN '1999-03-01' AND '1999-06-15' GROUP BY company""",
)
ORACLES["deep_page"] = _with("rv_orders", f"SELECT {FACTS} FROM rv_orders ORDER BY id LIMIT 50 OFFSET 1200")
ORACLES["newest_rows"] = _with("rv_orders", f"SELECT {FACTS} FROM rv_orders ORDER BY ts DESC, id LIMIT 1100")
ORACLES["weighted_sample_large"] = _with(
    "rv_orders",
    f""", w AS (SELECT company, category, count(*) AS n FROM rv_orders GROUP BY ALL),
    k AS (SELECT o.id, o.company, o.category,
                 row_number() OVER (ORDER BY -ln({_uniform(11, "o.id")}) / n, o.id) AS rk
          FROM rv_orders o JOIN w ON o.company = w.company AND o.category IS NOT DISTINCT FROM w.category)
    SELECT id, company, category FROM k WHERE rk <= 1300""",
)
ORACLES["analyse_requests"] = _with(
    "rv_text",
    f""", v AS (SELECT *, TIMESTAMP '2023-01-01' + to_days(CAST(id AS int) % 365) AS ts FROM rv_text),
    r AS (SELECT 'r' || i AS request_id, i,
                 CASE WHEN i % 3 <> 0 THEN ['src' || (i % 20), 'src' || (i * 7 % 20)] END AS companies,
                 CASE WHEN i % 4 = 1 THEN [i % 5] END AS categories,
                 CASE WHEN i % 5 <> 0 THEN make_date(2023, i % 12 + 1, 1) END AS first,
                 CASE WHEN i % 7 = 2 THEN DATE '2023-10-15' END AS last
          FROM range(300) AS t(i)),
    q AS (SELECT request_id, unnest([i % 37, 37 + i % 3]) AS vec_id FROM r),
    d AS (SELECT r.request_id, CAST(q.vec_id AS varchar) AS similarity_query, v.id, v.company,
                 {_category_name('v.category')} AS category, v.content,
                 {DISTANCE.format('v.embedding', 'e.embedding')} AS dist
          FROM r JOIN q ON r.request_id = q.request_id JOIN embeddings e ON q.vec_id = e.vec_id
               JOIN v ON ((companies IS NULL AND categories IS NULL) OR list_contains(companies, v.company)
                          OR list_contains(categories, v.category))
                         AND (first IS NULL OR v.ts >= first) AND (last IS NULL OR v.ts <= last)),
    s AS (SELECT *, row_number() OVER (PARTITION BY request_id, similarity_query ORDER BY dist NULLS LAST, id) AS rn
          FROM d QUALIFY rn <= 15),
    b AS (SELECT request_id, count(*) AS n_rows, floor(5000 / avg({TOKENS.format('content')})) AS budget FROM s GROUP BY ALL),
    w AS (SELECT request_id, category, company, similarity_query, count(*) AS n FROM s GROUP BY ALL),
    k AS (SELECT s.*, n_rows, budget,
                 row_number() OVER (PARTITION BY s.request_id
                                    ORDER BY -ln({_uniform(11, "s.similarity_query || ':' || id")}) / n, s.similarity_query, id) AS rk
          FROM s JOIN w ON s.request_id = w.request_id AND s.category = w.category AND s.company = w.company
                           AND s.similarity_query = w.similarity_query
               JOIN b ON s.request_id = b.request_id)
    SELECT request_id, company, category, similarity_query,
           md5(string_agg(content, chr(10) || '--' || chr(10) ORDER BY rn)) AS reviews
    FROM k WHERE rk <= budget OR budget > n_rows GROUP BY request_id, company, category, similarity_query""",
)
ORACLES["parse_written_dates"] = _with(
    "rv_orders",
    """SELECT id, CASE company_id % 9
                   WHEN 0 THEN CASE WHEN day(ts) > 12 THEN ts::date ELSE make_date(year(ts), day(ts), month(ts)) END
                   WHEN 6 THEN date_trunc('month', ts)::date
                   WHEN 8 THEN NULL ELSE ts::date END AS date
       FROM rv_orders""",
)
# Reports over the counts of an edited store are those over the edited reviews.
EDITED = f"""
        SELECT id, company, timestamp AS ts, rating, category FROM ({ORACLES["upsert_reviews"]}) WHERE company <> 'NATION_3'"""
for over_counts, over_rows in (
    ("cube_rating_share", "report_rating_share"),
    ("cube_category_stars", "report_category_stars"),
    ("cube_compare_series", "ts_compare"),
    ("cube_rating_series", "ts_ratings_month"),
):
    ORACLES[over_counts] = ORACLES[over_rows].replace(VIEWS["rv_orders"], EDITED)
ORACLES["knn_blocks"] = ORACLES["knn_all_vectors"]
ORACLES["knn_lsh_recall"] = "SELECT 5 * count(*) AS n_neighbours, true AS recall_reached FROM embeddings"
ORACLES["embed_text_words"] = r"""
SELECT doc_id, CASE WHEN regexp_matches(text, '[\p{L}\p{N}]') THEN 1.0::double ELSE 0.0::double END AS likeness,
       true AS places FROM documents"""
ORACLES["reports_without_rows"] = """
SELECT 'ratings piecharts by review category for single company' AS report, 5 AS n_rows UNION ALL
SELECT unnest(['ratings piechart for single company', 'ratings time series for single company',
               'ratings and review count time series comparing companies', 'ratings distribution comparing companies']), 0"""
ORACLES["report_values_by_name"] = _with(
    "rv_orders",
    f""", r AS (SELECT * FROM rv_orders WHERE company IN ('NATION_4', 'NATION_9') AND ts BETWEEN '1996-01-01' AND '1998-12-31'),
    l(code, label) AS (VALUES (0, 'Andet'), (1, 'Kundeservice'), (2, 'Rådgivning'), (3, 'mobil/net bank'), (4, 'Gebyrer/renter')),
    m AS (SELECT unnest(generate_series((SELECT date_trunc('month', min(ts)) FROM r)::timestamp, (SELECT max(ts) FROM r),
                                        INTERVAL 1 MONTH)) AS start),
    cm AS (SELECT company, unnest(generate_series(date_trunc('month', min(ts))::timestamp, max(ts), INTERVAL 1 MONTH)) AS start
           FROM r GROUP BY company),
    n AS (SELECT company, date_trunc('month', ts)::timestamp AS start, count(*) AS n,
                 count(*) FILTER (rating = 1) + 10 * count(*) FILTER (rating = 5) AS stars FROM r GROUP BY ALL)
    SELECT 'ratings piechart for single company' AS report, CAST(rating AS varchar) AS row, count(*) AS measure FROM r GROUP BY rating
    UNION ALL
    SELECT 'ratings piecharts by review category for single company', label, count(rating)
    FROM l LEFT JOIN r ON category = code GROUP BY label UNION ALL
    SELECT 'ratings time series for single company', CAST(last_day(m.start::date) AS varchar), CAST(coalesce(sum(stars), 0) AS bigint)
    FROM m LEFT JOIN n ON m.start = n.start GROUP BY m.start UNION ALL
    SELECT 'ratings and review count time series comparing companies', company || '|' || last_day(cm.start::date), coalesce(n, 0)
    FROM cm LEFT JOIN n USING (company, start) UNION ALL
    SELECT 'ratings distribution comparing companies', company,
           CAST(round(10 * {_round('100.0 * count(*) FILTER (WHERE rating = 3) / count(*)', 1)}) AS bigint) FROM r GROUP BY company""",
)
