"""DuckDB SQL for the operators that SQL can express."""

from __future__ import annotations

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_TERMS = f"regexp_extract_all({_LOWER.format('text')}, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"

RANKED_SEARCH = f"""
WITH doc_terms AS (
    SELECT place, doc_id, unnest({_TERMS}) AS term FROM (SELECT row_number() OVER () AS place, * FROM documents)
),
counts AS (SELECT place, any_value(doc_id) AS doc_id, term, count(*) AS tf FROM doc_terms GROUP BY place, term),
sizes AS (SELECT place, count(*) AS n FROM doc_terms GROUP BY place),
corpus AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM sizes),
item_terms AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark WHERE item_id IS NOT NULL),
weights AS (
    SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w
    FROM (SELECT term, count(*) AS df FROM counts GROUP BY term), corpus
),
scored AS (
    SELECT item_id, place, any_value(doc_id) AS doc_id,
           sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + ((90 * n * docs) // terms)))))::BIGINT AS score
    FROM item_terms JOIN weights USING (term) JOIN counts USING (term) JOIN sizes USING (place), corpus
    GROUP BY item_id, place
),
ranked AS (
    SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
    FROM scored WHERE score > 0 AND doc_id IS NOT NULL
)
SELECT * FROM ranked WHERE rank <= 10
"""

PHRASES = f"""
WITH pieces AS (
    SELECT place, lang, unnest(p) AS piece, generate_subscripts(p, 1) AS number
    FROM (
        SELECT row_number() OVER () AS place, coalesce(lang, 'und') AS lang,
               regexp_split_to_array({_LOWER.format("coalesce(text, '')")}, '[.,;:!?\\x0A-\\x0D]') AS p
        FROM documents
    )
),
words AS (
    SELECT place, number, lang, unnest(ws) AS w1, generate_subscripts(ws, 1) AS spot
    FROM (SELECT place, number, lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS ws FROM pieces)
),
runs AS (
    SELECT lang, w1, lead(w1, 1) OVER piece AS w2, lead(w1, 2) OVER piece AS w3, lead(w1, 3) OVER piece AS w4
    FROM words WINDOW piece AS (PARTITION BY place, number ORDER BY spot)
),
grams AS (
    SELECT lang, gram, count(*) AS f
    FROM (
        SELECT lang, [w1] AS gram FROM runs
        UNION ALL SELECT lang, [w1, w2] FROM runs WHERE w2 IS NOT NULL
        UNION ALL SELECT lang, [w1, w2, w3] FROM runs WHERE w3 IS NOT NULL
        UNION ALL SELECT lang, [w1, w2, w3, w4] FROM runs WHERE w4 IS NOT NULL
    )
    GROUP BY lang, gram HAVING count(*) >= 30
),
phrases AS (SELECT * FROM grams WHERE len(gram) > 1),
covered AS (
    SELECT lang, gram, max(f) AS longer
    FROM (
        SELECT lang, f, unnest(CASE WHEN len(gram) = 3 THEN [gram[1:2], gram[2:3]]
                               ELSE [gram[1:2], gram[2:3], gram[3:4], gram[1:3], gram[2:4]] END) AS gram
        FROM phrases WHERE len(gram) > 2
    )
    GROUP BY lang, gram
),
kept AS (
    SELECT p.lang, p.gram, p.f FROM phrases p LEFT JOIN covered c ON p.lang = c.lang AND p.gram = c.gram
    WHERE c.longer IS NULL OR 100 * c.longer < 80 * p.f
),
cuts AS (SELECT lang, gram, f, unnest(range(1, len(gram))) AS k FROM kept),
scored AS (
    SELECT c.lang, c.gram, c.f AS a, b.f AS l, e.f AS r, ((2000000::HUGEINT * c.f) // (b.f + e.f))::BIGINT AS score
    FROM cuts c
    JOIN grams b ON b.lang = c.lang AND b.gram = c.gram[1:c.k]
    JOIN grams e ON e.lang = c.lang AND e.gram = c.gram[c.k + 1:len(c.gram)]
    QUALIFY row_number() OVER (PARTITION BY c.lang, c.gram ORDER BY score, c.k) = 1
),
spelled AS (SELECT lang, array_to_string(gram, ' ') AS phrase, a, l, r, score FROM scored),
totals AS (SELECT lang, count(*) AS n FROM words GROUP BY lang)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM spelled JOIN totals USING (lang)
QUALIFY rank <= 2000
"""
