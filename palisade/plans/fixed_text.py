"""Small text models with given terms, lines and weights, so that scoring can be checked by SQL.

One model per text layer: terms with their inverse document frequencies, landmark lines with
weights, the kernel's width and the margin. Layers with a character profile share their terms.
"""

from __future__ import annotations

import numpy as np

from palisade import constants as C
from palisade.operators.ocsvm import TextModel

CHAR_TERMS = {
    "ssh": 1.9, "get": 1.2, "from": 1.1, ".exe": 2.3, "auth": 1.4, "fail": 1.7, "root": 2.1,
    "port": 1.3, "proc": 1.6, "acce": 1.5, "' or": 2.6, "rhos": 1.8, "kern": 2.2, "172": 1.05,
    "218": 1.15, "user": 1.25, "pass": 1.45, "http": 1.35, "sig": 1.65, "ss ": 1.0,
}
WORD_TERMS = {
    "sshd": 1.9, "accepted publickey": 2.4, "publickey from": 1.6, "failed password": 2.7,
    "for root": 2.0, "authentication failure": 1.8, "rhost": 1.2, "kernel": 1.5, "port 22": 1.3,
    "generic message without": 2.2, "77": 1.1, "process": 1.7, "get": 1.4, "ssh2": 1.05,
}
#: layer -> kernel width, margin, landmark lines with weights
MODELS = {
    "WEB_APP": (0.7, 0.62, [
        ("GET /index.html HTTP/1.1 user agent", 0.45), ("kernel: generic message", 0.3),
        ("authentication failure; rhost=218-22-3-7", 0.35)]),
    "AUTH_LINUX": (0.9, 0.55, [
        ("sshd[77]: Accepted publickey from 172.16.0.9", 0.6),
        ("authentication failure; rhost=218-22-3-14", 0.3), ("kernel: signature", 0.2)]),
    "AUTH_WINDOWS": (0.8, 0.66, [
        ("A new process has been created. Process Name: C:\\Windows\\explorer.exe", 0.7),
        ("user logged on from 172.16.0.1 port 22", 0.4)]),
    "HOST_LIN": (1.1, 0.48, [
        ("sshd[77]: Accepted publickey from 172.16.0.9", 0.5),
        ("kernel: generic message without signature", 0.45), ("sshd restarted", 0.2)]),
    "HOST_WIN": (0.6, 0.71, [
        ("C:\\Windows\\System32\\svchost.exe process", 0.65), ("GET / HTTP/1.1", 0.35)]),
}


def models() -> dict[str, TextModel]:
    out = {}
    for tag, (gamma, rho, lines) in MODELS.items():
        terms = terms_of(tag)
        out[tag] = TextModel(tag, list(terms), np.array(list(terms.values())), gamma,
                             [line for line, _ in lines], np.array([w for _, w in lines]), rho)
        out[tag].number = np.float64  # the digits are compared
    return out


def terms_of(tag: str) -> dict[str, float]:
    return WORD_TERMS if C.TEXT_PROFILES[tag][0] == "word" else CHAR_TERMS


def _quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def sql(lines: str) -> str:
    """Common table expressions that end in ``decided`` (``tag, line, decision``).

    ``lines`` is a query of ``tag, line``: what is to be scored.
    """
    terms = ", ".join(f"({_quoted(tag)}, {_quoted(t)}, {idf}::double)"
                      for tag in MODELS for t, idf in terms_of(tag).items())
    marks = ", ".join(f"({_quoted(tag)}, {_quoted(line)}, {w}::double)"
                      for tag, (_, _, rows) in MODELS.items() for line, w in rows)
    kinds = ", ".join(f"({_quoted(tag)}, {_quoted(C.TEXT_PROFILES[tag][0])}, {gamma}::double,"
                      f" {rho}::double)" for tag, (gamma, rho, _) in MODELS.items())
    return f"""text_terms(tag, term, idf) AS (VALUES {terms}),
marks(tag, line, weight) AS (VALUES {marks}),
kinds(tag, analyzer, gamma, rho) AS (VALUES {kinds}),
texts AS (SELECT DISTINCT tag, line FROM ({lines}) UNION SELECT tag, line FROM marks),
prepared AS (SELECT tag, line, analyzer,
    regexp_replace(lower(line), '[\\s\\x0B]{{2,}}', ' ', 'g') AS folded,
    regexp_extract_all(lower(line), '\\w{{2,}}') AS words FROM texts JOIN kinds USING (tag)),
counted AS (SELECT p.tag, p.line, t.term, t.idf * CASE analyzer WHEN 'char'
    THEN len(list_filter(range(1, length(folded) - length(term) + 2),
      lambda i: substr(folded, i, length(term)) = term))
    ELSE len(list_filter(range(1, len(words) - len(string_split(term, ' ')) + 2),
      lambda i: array_to_string(words[i:i + len(string_split(term, ' ')) - 1], ' ') = term))
    END AS w FROM prepared p JOIN text_terms t ON p.tag = t.tag),
vectors AS (SELECT tag, line, term, w / sqrt(sum(w * w) OVER (PARTITION BY tag, line)) AS w
    FROM counted WHERE w > 0),
dots AS (SELECT a.tag, a.line, b.line AS mark, sum(a.w * b.w) AS dot FROM vectors a
    JOIN vectors b ON a.tag = b.tag AND a.term = b.term GROUP BY ALL),
lengths AS (SELECT tag, line, sum(w * w) AS q FROM vectors GROUP BY ALL),
decided AS (SELECT x.tag, x.line, sum(m.weight * exp(-k.gamma * greatest(
      coalesce(a.q, 0) + coalesce(b.q, 0) - 2 * coalesce(d.dot, 0), 0))) - any_value(k.rho) AS decision
    FROM texts x JOIN marks m ON m.tag = x.tag JOIN kinds k ON k.tag = x.tag
    LEFT JOIN dots d ON d.tag = x.tag AND d.line = x.line AND d.mark = m.line
    LEFT JOIN lengths a ON a.tag = x.tag AND a.line = x.line
    LEFT JOIN lengths b ON b.tag = x.tag AND b.line = m.line GROUP BY x.tag, x.line)"""
