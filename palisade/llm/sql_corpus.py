"""DuckDB SQL beside operators 11 to 13."""

from __future__ import annotations

from palisade.llm import divergence

WORD = r"[^\x20\x09-\x0D]+"

TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def divergences(documents: str = "documents", min_docs: int = divergence.MIN_DOCS,
                top: int = divergence.TOP_TERMS) -> str:
    """Every share of every kept term in every group, then all pairs of shares."""
    def share(count: str, total: str) -> str:
        return f"1 + ({divergence.SCALE}::hugeint * ({count} + 1)) // ({total} + v)"

    return f"""WITH
docs AS (SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang,
    coalesce(source, '') AS source, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS text
    FROM {documents}),
groups AS (SELECT DISTINCT lang, source FROM docs),
tokens AS (SELECT d, lang, source, unnest(regexp_extract_all(text, '{TERM}')) AS term FROM docs),
counts AS (SELECT lang, source, term, count(*) AS n FROM tokens GROUP BY ALL),
kept AS (SELECT lang, term, count(*) AS lang_n FROM tokens GROUP BY ALL
    HAVING count(DISTINCT d) >= {min_docs}),
langs AS (SELECT lang, count(*) AS v, sum(lang_n) AS lang_total FROM kept GROUP BY lang),
every AS (SELECT lang, source, term, coalesce(n, 0) AS n, lang_n
    FROM groups JOIN kept USING (lang) LEFT JOIN counts USING (lang, source, term)),
totals AS (SELECT lang, source, sum(n) AS total FROM every GROUP BY ALL),
shares AS (SELECT lang, source, term, n, {share("n", "total")} AS p,
    {share("lang_n", "lang_total")} AS q
    FROM every JOIN totals USING (lang, source) JOIN langs USING (lang)),
sums AS (SELECT a.lang, a.source, b.source AS item,
    sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
    FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source
    GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(value, 0)::bigint AS value
    FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
strong AS (SELECT lang, source, term AS item, ((p - q) * (p - q) // q)::bigint AS value
    FROM shares WHERE n > 0 AND p > q),
parts AS (SELECT lang, source, 'pair' AS part, item, value FROM pairs
    UNION ALL SELECT lang, source, 'term', item, value FROM strong)
SELECT lang, source, part, item, value, (row_number() OVER (PARTITION BY lang, source, part
    ORDER BY value DESC, item))::int AS rank FROM parts
QUALIFY part = 'pair' OR rank <= {top}"""


def prefix_trie(conversations: str = "conversations") -> str:
    """Prefixes as joined digests; subtree sums from every node's list of prefixes."""
    return f"""WITH
crc_steps AS (SELECT list(v ORDER BY i) AS steps FROM (SELECT i, list_reduce(
    [i, 0, 0, 0, 0, 0, 0, 0, 0],
    lambda c, z: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS v
    FROM range(256) AS r(i))),
given AS (SELECT conv_id AS c, turn, coalesce(role, '') AS role, coalesce(text, '') AS text
    FROM {conversations} WHERE conv_id IS NOT NULL),
turns AS (SELECT c, m, len(regexp_extract_all(text, '{WORD}')) AS words,
    row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, m) AS pos
    FROM (SELECT *, md5(md5(role) || text) AS m FROM given)),
lens AS (SELECT c, count(*) AS n FROM turns GROUP BY c),
asked AS (SELECT c, n, c - c % 20 AS a, xor(4294967295, list_reduce(
    [4294967295] || list_transform(string_split(c::varchar, ''), lambda s: ascii(s)::bigint),
    lambda x, b: xor(x >> 8, steps[(xor(x, b) & 255) + 1]))) % 4 AS h FROM lens, crc_steps),
convs AS (SELECT q.c, q.a, q.h, least(q.h, coalesce(l.n, 0)) AS k,
    least(q.h, coalesce(l.n, 0)) + greatest(q.n - q.h, 0) AS length
    FROM asked q LEFT JOIN lens l ON l.c = q.a),
rebuilt AS (SELECT v.c, t.pos AS d, m, words FROM convs v JOIN turns t ON t.c = v.a AND t.pos <= v.k
    UNION ALL SELECT v.c, t.pos - h + k, m, words FROM convs v JOIN turns t ON t.c = v.c
    AND t.pos > v.h),
members AS (SELECT c, d, words, string_agg(m, '') OVER (PARTITION BY c ORDER BY d
    ROWS UNBOUNDED PRECEDING) AS key FROM rebuilt
    UNION ALL SELECT c, 0, 0, '' FROM convs),
nodes AS (SELECT key, d, min(c) AS conv_id, count(*) AS n, (count(*) - 1) * max(words) AS saved,
    string_agg(CASE WHEN d = length THEN c::varchar END, ',' ORDER BY c) AS ends
    FROM members JOIN convs USING (c) GROUP BY key, d),
children AS (SELECT left(key, 32 * (d - 1)) AS key, count(*) AS n FROM nodes WHERE d > 0 GROUP BY 1),
above AS (SELECT left(nodes.key, 32 * up) AS key, saved, (children.n IS NULL)::int AS leaf
    FROM (SELECT *, unnest(range(0, d + 1)) AS up FROM nodes) AS nodes
    LEFT JOIN children ON children.key = nodes.key),
sums AS (SELECT key, sum(leaf) AS leaves, sum(saved) AS saved FROM above GROUP BY key)
SELECT v.conv_id, v.d::bigint AS depth, p.conv_id AS parent_conv_id, v.n AS n_convs,
    coalesce(children.n, 0) AS n_children, sums.leaves::bigint AS n_leaves,
    sums.saved::bigint AS saved_tokens, sha256(coalesce(v.ends, '')) AS ends_sha256
FROM nodes v JOIN sums ON sums.key = v.key LEFT JOIN children ON children.key = v.key
LEFT JOIN nodes p ON v.d > 0 AND p.d = v.d - 1 AND p.key = left(v.key, 32 * (v.d - 1))"""


SQL = {
    "op11_prefix_trie": prefix_trie(),
    "op13_divergence": divergences(),
}
