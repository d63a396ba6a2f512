"""SQL for DuckDB that gives the same rows as the operators' queries, where SQL can express them.

The SQL is written from the operators' definitions with DuckDB's own functions
(joins and windows where the operators use arrays within a row), and shares
only their fixed values: patterns, spellings, rates.
"""

from __future__ import annotations

from .licenses import COPYRIGHT_LINE, MARKS, NOTICES, SPELLINGS, TEXTS
from .rules import LEAST, MAX_REPEAT, MIN_WORDS, RATES, SPREAD
from .secrets import BASE, RULES


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def license_sql() -> str:
    def digest(text: str) -> str:
        out = f"regexp_replace(regexp_replace(lower({text}), {quoted(COPYRIGHT_LINE)}, ' \\1', 'g'), {quoted(MARKS)}, ' ', 'g')"
        for spelling, one in SPELLINGS:
            out = f"regexp_replace({out}, {quoted(spelling)}, {quoted(one.replace('$', chr(92)))}, 'g')"
        return f"sha256(trim({out}, ' '))"

    values = lambda pairs: ", ".join(f"({quoted(n)}, {quoted(t)})" for n, t in pairs)
    return f"""WITH texts AS (SELECT {digest("text")} AS digest, min(license) AS license FROM (VALUES {values(TEXTS)}) v(license, text) GROUP BY 1),
        notices AS (SELECT {digest("text")} AS digest, min(license) AS license FROM (VALUES {values(NOTICES)}) v(license, text) GROUP BY 1),
        docs AS (SELECT row_number() OVER () AS n, doc_id, text FROM documents),
        lines AS (SELECT n, unnest(string_split(text, chr(10))) AS line FROM docs),
        found AS (SELECT n, string_agg(DISTINCT license, ',' ORDER BY license) AS notices FROM (SELECT n, {digest("line")} AS digest FROM lines WHERE regexp_matches(lower(line), 'licen|releas|copyright')) JOIN notices USING (digest) GROUP BY n)
        SELECT doc_id, d.digest, license, coalesce(notices, '') AS notices FROM (SELECT n, doc_id, {digest("text")} AS digest FROM docs) d LEFT JOIN texts USING (digest) LEFT JOIN found USING (n)"""


def rules_sql() -> str:
    bucket = lambda v: f"CASE WHEN {v} < 64 THEN {v} ELSE ({v} >> (length(bin({v})) - 6)::INT) + (length(bin({v})) - 6) * 32 END"
    end = "CASE WHEN bucket < 64 THEN bucket ELSE (bucket - (bucket // 32 - 1) * 32 + 1) * (1::BIGINT << (bucket // 32 - 1)::INT) - 1 END"
    fences = lambda keys: f"""SELECT {keys}rate, max(n_all) AS n, min(CASE WHEN 4 * up >= 3 * n_all THEN {end} END) AS high, min(CASE WHEN 4 * up >= n_all THEN {end} END) AS low
        FROM (SELECT *, sum(n) OVER (PARTITION BY {keys}rate ORDER BY bucket) AS up, sum(n) OVER (PARTITION BY {keys}rate) AS n_all
            FROM (SELECT {keys}rate, {bucket("value")} AS bucket, count(*) AS n FROM long GROUP BY ALL)) GROUP BY ALL"""  # noqa: E731
    floor = "CASE rate " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in RATES.items()) + " END"
    return rf"""WITH docs AS (SELECT row_number() OVER () AS id, doc_id, lang, source, coalesce(text, '') AS t FROM documents),
        words AS (SELECT id, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM docs),
        windows AS (SELECT id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS x FROM (SELECT id, w, unnest(range(1, len(w) - 1)) AS i FROM words)),
        twice AS (SELECT id, i FROM windows JOIN (SELECT id, x FROM windows GROUP BY ALL HAVING count(*) > 1) USING (id, x)),
        covered AS (SELECT id, count(DISTINCT i + k) AS n FROM twice, (VALUES (0), (1), (2)) v(k) GROUP BY id),
        lines AS (SELECT id, unnest(string_split(t, chr(10))) AS line FROM docs),
        counted AS (SELECT id, count(*) AS n, count(DISTINCT line) AS d FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY id),
        base AS (SELECT d.*, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
            coalesce(l.n - l.d, 0) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words, coalesce(l.n, 0) AS n_lines, len(regexp_extract_all(t, '[A-Z]')) AS n_capitals
            FROM docs d JOIN words USING (id) LEFT JOIN covered c USING (id) LEFT JOIN counted l USING (id)),
        rated AS (SELECT *, n_symbols * 1000 // nullif(n_words, 0) AS symbols, n_dup_lines * 1000 // nullif(n_lines, 0) AS dup_lines, n_repeat_words * 1000 // nullif(n_words, 0) AS repeats,
            word_chars * 1000 // nullif(n_words, 0) AS word_length, n_capitals * 1000 // nullif(word_chars, 0) AS capitals FROM base),
        long AS (SELECT id, coalesce(lang, chr(0)) AS lang, coalesce(source, chr(0)) AS source, rate, value FROM rated UNPIVOT (value FOR rate IN ({", ".join(RATES)}))),
        own AS ({fences("lang, source, ")}), every AS ({fences("")}),
        struck AS (SELECT DISTINCT id FROM long JOIN every USING (rate) LEFT JOIN own ON own.lang = long.lang AND own.source = long.source AND own.rate = long.rate AND own.n >= {LEAST}
            WHERE value > coalesce(own.high + {SPREAD} * greatest(own.high - own.low, {floor.replace("rate", "long.rate")}), every.high + {SPREAD} * greatest(every.high - every.low, {floor.replace("rate", "long.rate")}))),
        out AS (SELECT r.*, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT} * n_words AS base_failed, s.id IS NOT NULL AS hit FROM rated r LEFT JOIN struck s USING (id))
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT hit AS kept FROM out"""


def secrets_sql() -> str:
    found = " UNION ALL ".join(
        f"SELECT id, {n} AS rule, '{r.kind}' AS kind, {r.least} AS least, regexp_extract_all(t, {quoted(r.pattern)}, 0) AS m, regexp_extract_all(t, {quoted(r.pattern)}, {r.group}) AS v, string_split_regex(t, {quoted(r.pattern)}) AS g FROM docs"
        for n, r in enumerate(RULES)
    )
    base = len(BASE)
    return f"""WITH docs AS (SELECT row_number() OVER () AS id, doc_id, coalesce(text, '') AS t FROM documents),
        found AS ({found}),
        places AS (SELECT id, rule, kind, length(m[i]) AS n, length(v[i]) >= least AS ok,
            list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS start
            FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM found)),
        spans AS (SELECT id, rule, start::BIGINT AS start, kind || ':' || start::BIGINT || ':' || (start + n)::BIGINT AS s FROM places WHERE ok),
        of AS (SELECT id, {", ".join(f"count(*) FILTER (rule = {n}) AS n{n}" for n in range(base))}, string_agg(s, ',' ORDER BY start, rule) FILTER (rule < {base}) AS b, string_agg(s, ',' ORDER BY start, rule) AS a FROM spans GROUP BY id)
        SELECT doc_id, {", ".join(f"coalesce(n{n}, 0) AS n_{r.kind}" for n, r in enumerate(BASE))}, sha256(coalesce(b, '')) AS base_sha256, coalesce(a, '') AS spans FROM docs LEFT JOIN of USING (id)"""
