"""Building blocks of the DuckDB statements that check the Spark queries."""

from __future__ import annotations

import re

from kbspark import constants as K
from kbspark.functions import text as X


def lit(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def re2(pattern: str) -> str:
    """The same pattern for an engine without Java's ``d``, ``u`` and ``U`` flags."""
    def flags(m):
        kept = "".join(f for f in m[1] if f in "ims")
        return f"(?{kept})" if kept else ""

    return re.sub(r"^\(\?([a-zA-Z]+)\)", flags, pattern)


def replace_all(expr: str, pairs) -> str:
    for pattern, value in pairs:
        expr = f"regexp_replace({expr}, {lit(re2(pattern))}, {lit(value)}, 'g')"
    return expr


def strip(expr: str) -> str:
    return f"trim({expr}, chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13))"


def collapse(expr: str) -> str:
    return replace_all(expr, [(r"\n{3,}", "\n\n"), (r"[ \t]{2,}", " ")])


def email_clean(expr: str) -> str:
    return strip(collapse(replace_all(strip(expr), [(p, "") for p in X.EMAIL_NOISE])))


def kb_clean(expr: str) -> str:
    c = replace_all(strip(f"replace({expr}, chr(0), '')"), [(r"\r\n|\r", "\n")])
    return strip(replace_all(collapse(c), [(p, "") for p in X.KB_NOISE]))


def mask(expr: str, mode: str) -> str:
    extra = X.PII_STRICT if mode == "strict" else X.PII_RELAXED
    c = replace_all(expr, X.PII_MASKS + extra)
    return strip(f"substring({c}, 1, 500)" if mode == "strict" else c)


def short(expr: str, n: int) -> str:
    return f"substring({replace_all(strip(expr), [(chr(92) + 's+', ' ')])}, 1, {n})"


def chunks(relation: str, text: str, keys: str, order_key: str) -> str:
    """SELECT of the chunks of ``text``: keys, chunk_index, text."""
    step = K.CHUNK_LEN - K.CHUNK_OVERLAP
    return f"""SELECT {keys}, row_number() OVER (PARTITION BY {order_key} ORDER BY p) - 1 AS chunk_index, body AS text
    FROM (SELECT {keys}, p, {strip(f"substring(t, p + 1, {K.CHUNK_LEN})")} AS body
          FROM (SELECT {keys}, t, unnest(range(0, length(t), {step})) AS p
                FROM (SELECT {keys}, {strip(text)} AS t FROM {relation})))
    WHERE length(body) > 0"""


def safe_file_name(expr: str) -> str:
    base = f"replace(regexp_extract({expr}, '[^/]*$'), '..', '')"
    return "lower(" + replace_all(base, [("[^a-zA-Z0-9._-]", "_"), ("_+", "_")]) + ")"


def keyword_hit(expr: str) -> str:
    whens = " ".join(f"WHEN contains(lower({expr}), {lit(k)}) THEN {lit(k)}" for k in K.HARD_KEYWORDS)
    return f"CASE {whens} END"


def meaningful(expr: str) -> str:
    s = replace_all(f"coalesce({expr}, '')", [(chr(92) + "s+", "")])
    return (
        f"(length({s}) >= 6 AND regexp_matches({s}, '[a-zA-Z0-9]{{3,}}') "
        f"AND len(list_distinct(string_split({s}, ''))) > 3)"
    )


def with_ctes(body: str, ctes: dict[str, str], recursive: bool = False) -> str:
    """Prefix ``body`` with the CTEs it needs, in dependency order."""
    needed: list[str] = []

    def add(name: str):
        for other in ctes:
            if other != name and other not in needed and re.search(rf"\b{other}\b", ctes[name]):
                add(other)
        if name not in needed:
            needed.append(name)

    for name in ctes:
        if re.search(rf"\b{name}\b", body):
            add(name)
    if not needed:
        return body
    head = "WITH RECURSIVE " if recursive else "WITH "
    # Recursive steps would otherwise evaluate the relations they read again and again.
    how = "AS MATERIALIZED" if recursive else "AS"
    return head + ",\n".join(
        f"{n} {'AS' if re.search(rf'FROM {n}' + chr(92) + 'b', ctes[n]) else how} ({ctes[n]})" for n in needed
    ) + "\n" + body
