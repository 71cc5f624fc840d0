"""DuckDB SQL beside the registered queries, where SQL can express them."""

from __future__ import annotations

from palisade.llm import quality_rules as rules
from palisade.llm import sql_corpus
from palisade.llm import url_filters as urls

WORD = r"[^\x20\x09-\x0D]+"


def quality_rules(documents: str = "documents") -> str:
    """Common table expressions that end in ``judged``."""
    fails = {
        "short": f"n_words < {rules.MIN_WORDS}",
        "repeats": f"100 * n_repeat_words > {rules.MAX_REPEATED} * n_words",
        "symbols": f"100 * n_symbols > {rules.MAX_SYMBOLS} * word_chars",
        "dup_lines": f"100 * n_dup_lines > {rules.MAX_DUP_LINES} * n_lines",
        "word_length": f"word_chars < {rules.WORD_LENGTHS[0]} * n_words"
                       f" OR word_chars > {rules.WORD_LENGTHS[1]} * n_words",
    }
    names = list(fails)
    return f"""
texts AS (SELECT doc_id, source AS host, coalesce(text, '') AS text FROM {documents}),
listed AS (SELECT *, regexp_extract_all(text, '{WORD}') AS words,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS lines
    FROM texts),
windows AS (SELECT doc_id, unnest(range(1, len(words) - 3)) AS i, words FROM listed
    WHERE len(words) >= 5),
windowed AS (SELECT doc_id, i, words[i:i + 4] AS w FROM windows),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w) AS n
    FROM windowed) WHERE n > 1),
covered AS (SELECT doc_id, count(DISTINCT i + k) AS n
    FROM again, (SELECT unnest(range(0, 5)) AS k) GROUP BY doc_id),
measured AS (SELECT doc_id, host, len(words) AS n_words,
    length(array_to_string(words, '')) AS word_chars,
    length(text) - length(translate(text, '{rules.SYMBOLS}', '')) AS n_symbols,
    len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
    coalesce(covered.n, 0) AS n_repeat_words FROM listed LEFT JOIN covered USING (doc_id)),
failing AS (SELECT *, {", ".join(f"({c}) AS fail_{r}" for r, c in fails.items())}
    FROM measured),
hosts AS (SELECT host, count(*) AS n,
    {", ".join(f"sum(fail_{r}::int) AS f_{r}" for r in names)} FROM failing GROUP BY host),
sums AS (SELECT sum(n) AS docs, count(*) AS hosts,
    {", ".join(f"sum(f_{r}) AS all_{r}, sum(f_{r} * f_{r} / n) AS sq_{r}" for r in names)}
    FROM hosts),
prior AS (SELECT {", ".join(
        f"all_{r} / docs AS mean_{r}, CASE WHEN sq_{r} / docs - (all_{r} / docs) ^ 2 > 1e-9 "
        f"THEN greatest(all_{r} / docs * (1 - all_{r} / docs) "
        f"/ (sq_{r} / docs - (all_{r} / docs) ^ 2) - 1, 1.0) "
        f"ELSE docs / hosts END AS size_{r}" for r in names)} FROM sums),
rated AS (SELECT host, {", ".join(
        f"(f_{r} + mean_{r} * size_{r}) / (n + size_{r}) AS rate_{r}" for r in names)}
    FROM hosts, prior),
judged AS (SELECT doc_id, f.host, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    fail_short OR fail_repeats AS base_failed,
    greatest({", ".join(f"rate_{r}" for r in names)}) >= {rules.BLOCK_RATE} AS host_blocked,
    NOT (fail_short OR fail_repeats
        OR greatest({", ".join(f"rate_{r}" for r in names)}) >= {rules.BLOCK_RATE}
        OR {" OR ".join(f"(fail_{r} AND rate_{r} >= {rules.FORGIVE_RATE})" for r in names)})
        AS kept
    FROM failing f JOIN rated r ON f.host IS NOT DISTINCT FROM r.host)"""


def url_filters(pages: str = "pages") -> str:
    """Alias groups by a recursive walk over the links; rules longest first."""
    order = sorted(urls.RULES, key=lambda r: (-len(r), urls.RULES[r] != urls.ALLOW, r))

    def fits(rule: str) -> str:
        own, slash, rest = rule.partition("/")
        return (f"(host = '{own}' OR ends_with(host, '.{own}'))"
                f" AND starts_with(path, '{slash}{rest}')")

    def parts(url: str) -> str:
        return (f"translate(regexp_extract({url}, '^.*?://([^/?#]*)', 1, 's'),"
                f" 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,"
                f" regexp_extract({url}, '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path,"
                f" list_sort(list_filter(string_split(regexp_extract({url},"
                f" '^.*?://[^?#]*[?]([^#]*)', 1, 's'), '&'), lambda p: p <> '' AND NOT"
                f" regexp_matches(p, '^({urls.TRACKING})(=|$)'))) AS params")

    form = ("CASE WHEN host <> '' THEN host || regexp_replace(path, '/$', '') ||"
            " CASE WHEN len(params) > 0 THEN '?' || array_to_string(params, '&') ELSE '' END END")
    link = ("regexp_extract_all(html, '<link [^>]*rel=.?canonical[^>]*href=[^a-z/]?([^\"'' >]+)',"
            " 1, 'is')")
    refresh = ("regexp_extract_all(html, '<meta [^>]*http-equiv=.?refresh[^>]*url=([^\"'' >]+)',"
               " 1, 'is')")
    return f"""
parts AS (SELECT page_id, html, {parts("coalesce(url, '')")} FROM {pages}),
ruled AS (SELECT *, {form} AS form,
    CASE {" ".join(f"WHEN {fits(r)} THEN '{r}'" for r in order)} END AS rule FROM parts),
targets AS (SELECT form, unnest({link} || {refresh}) AS target FROM ruled),
absolute AS (SELECT form, CASE WHEN starts_with(target, '//') THEN 'http:' || target
    WHEN starts_with(target, '/') THEN 'http://' || split_part(form, '/', 1) || target
    ELSE target END AS target FROM targets WHERE form IS NOT NULL),
target_parts AS (SELECT form AS a, {parts("target")} FROM absolute),
one_way AS (SELECT a, {form} AS b FROM target_parts),
links AS (SELECT DISTINCT * FROM (SELECT a, b FROM one_way UNION ALL SELECT b, a FROM one_way)
    WHERE a IS NOT NULL AND b IS NOT NULL AND a <> b),
walk AS (SELECT a AS node, a AS reached FROM links
    UNION SELECT node, b FROM walk JOIN links ON reached = a),
groups AS (SELECT node, min(reached) AS component FROM walk GROUP BY node),
tagged AS (SELECT page_id, host, path, rule, coalesce(component, form) AS alias_group,
    CASE rule {" ".join(f"WHEN '{r}' THEN '{v}'" for r, v in urls.RULES.items())} END AS own
    FROM ruled LEFT JOIN groups ON form = node),
decided AS (SELECT alias_group AS g, bool_or(own = 'allow') AS allowed,
    bool_or(own = 'block') AS blocked FROM tagged
    WHERE rule IS NOT NULL AND alias_group IS NOT NULL GROUP BY 1)
SELECT page_id, host, path, rule, coalesce(own, CASE WHEN allowed THEN 'allow'
    WHEN blocked THEN 'block' ELSE 'allow' END) AS verdict, alias_group
FROM tagged LEFT JOIN decided ON alias_group = g"""


SQL = {
    "op5_url_filters": f"WITH RECURSIVE {url_filters()}",
    "op1_quality_rules": f"WITH {quality_rules()} SELECT * FROM judged",
    **sql_corpus.SQL,
}
