"""DuckDB SQL for the dealt operators that SQL can express."""

from reviewmill.llm.url_reputation import SUFFIXES

ORACLES: dict[str, str] = {}


def _level(number: int, name: str, above: str) -> str:
    """Posterior of the groups of a level, each shrunk to the mean of the group ``above``."""
    parent = "SELECT '' AS up, rate AS prior FROM total" if number == 1 else f"SELECT name AS up, mean AS prior FROM m{number - 1}"
    return f"""
    g{number} AS (SELECT {name} AS name, {above} AS up, sum(n) AS n, sum(k) AS k FROM hosts GROUP BY ALL),
    p{number} AS (SELECT name, n, k, prior FROM g{number} JOIN ({parent}) USING (up)),
    c{number} AS (SELECT sum(n * (k / n - prior) * (k / n - prior)) AS spread, sum(prior * (1 - prior)) AS expected,
                         sum((n - 1) * prior * (1 - prior)) AS room FROM p{number} WHERE n > 0),
    s{number} AS (SELECT 1 / least(greatest(CASE WHEN room > 0 THEN (spread - expected) / room ELSE 0.5 END, 0.001), 0.999)
                         - 1 AS strength FROM c{number}),
    m{number} AS (SELECT name, n, k, (strength * prior + k) / (strength + n) AS mean,
                         (strength * prior + k) / (strength + n)
                         + 1.645 * sqrt((strength * prior + k) * (strength * (1 - prior) + n - k)
                                        / (strength + n) / (strength + n) / (strength + n + 1)) AS upper
                  FROM p{number}, s{number})"""


LISTED = ", ".join(f"'{suffix}'" for suffix in SUFFIXES)  # all of two labels
ORACLES["op9_url_reputation"] = f"""
WITH u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest
           FROM pages),
    parsed AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                         'abcdefghijklmnopqrstuvwxyz') AS host,
                      regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
    labelled AS (SELECT host, count(*) AS n, sum(CAST((quality = 1 AND toxic = 0) AS bigint)) AS k
                 FROM parsed JOIN (SELECT DISTINCT page_id, try_cast(regexp_extract(path, '^/[a-z]+/([0-9]+)', 1) AS bigint) AS doc_id
                                   FROM parsed) USING (page_id) JOIN labels USING (doc_id)
                 WHERE (quality = 1 AND toxic = 0) IS NOT NULL GROUP BY host),
    named AS (SELECT DISTINCT host, regexp_replace(regexp_replace(host, '(?s)^.*@', ''), ':[0-9]*$', '') AS name FROM parsed),
    labels_of AS (SELECT *, regexp_matches(name, '^(?:[0-9]{{1,3}}(?:[.][0-9]{{1,3}}){{3}}|\\[[^\\]]*\\])$') AS address,
                         regexp_extract(name, '(?:[^.]*[.])?[^.]*$') IN ({LISTED}) AS listed FROM named),
    hosts AS (SELECT host, coalesce(n, 0) AS n, coalesce(k, 0) AS k,
                     CASE WHEN address THEN name WHEN listed THEN regexp_extract(name, '(?:[^.]*[.])?[^.]*$')
                          ELSE regexp_extract(name, '[^.]*$') END AS suffix,
                     CASE WHEN address THEN name WHEN listed THEN regexp_extract(name, '(?:[^.]*[.]){{0,2}}[^.]*$')
                          ELSE regexp_extract(name, '(?:[^.]*[.])?[^.]*$') END AS domain
              FROM labels_of LEFT JOIN labelled USING (host)),
    total AS (SELECT coalesce(sum(k) / nullif(sum(n), 0), 0.5) AS rate FROM hosts),
    {_level(1, "suffix", "''")}, {_level(2, "domain", "suffix")}, {_level(3, "host", "domain")},
    ruled AS (SELECT *, CASE
        WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/de/%' THEN 'example.com/de/'
        WHEN (host = 'example.net' OR host LIKE '%.example.net') AND path LIKE '/en/%' THEN 'example.net/en/'
        WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/fr/%' THEN 'org/fr/'
        WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/%' THEN 'net/' END AS rule FROM parsed)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('example.com/de/', 'net/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
            WHEN upper < 0.5 THEN 'block' ELSE 'allow' END AS verdict,
       CAST(n AS bigint) AS n_labelled, CAST(k AS bigint) AS n_good
FROM ruled JOIN m3 ON host = name
"""
