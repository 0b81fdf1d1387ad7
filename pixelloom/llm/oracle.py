"""DuckDB SQL for the operators that SQL can express.

Not expressible: op1 (keyed, type-consistent surrogates), op3 (a tokenizer and a file format), op4,
op5 and op7 (trained models); their tests compare with brute force, round trips or held-out rows.
"""

from __future__ import annotations

from . import decontamination as dec
from . import mixing, quality
from . import url_filter as url

LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


#: crc32 of an ASCII text, byte by byte over the usual table, which is made by its rule.
CRC_TABLE = """crc AS MATERIALIZED (SELECT list(t ORDER BY n) AS tab FROM (SELECT n, list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS t FROM range(0, 256) x(n)))"""


def _crc32(text: str, tab: str = "tab") -> str:
    return f"xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split({text}, ''), lambda x: unicode(x)::BIGINT)), lambda a, b: xor(a >> 8, {tab}[(xor(a, b) & 255) + 1])), 4294967295)"


def _op2() -> str:
    rules = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in url.RULES)
    terms = ", ".join(f"('{t}', {int(t in url.STRICT)}, {w})" for t, w in [*url.STRICT.items(), *url.SOFT.items()])
    host = LOWER.format(r"regexp_extract(rest, '^([^/?#]*)', 1)")
    return f"""
    WITH p AS (SELECT page_id, url, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
    s AS (SELECT page_id, url, {host} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p),
    rules(verdict, h, pre) AS (VALUES {rules}),
    terms(term, strict, w) AS (VALUES {terms}),
    hit AS (SELECT page_id, url, coalesce(sum(strict), 0) AS n_strict, coalesce(sum(1 - strict), 0) AS n_soft, coalesce(sum(CASE WHEN strict = 0 THEN w END), 0) AS w
        FROM s LEFT JOIN terms ON regexp_matches(lower(coalesce(url, '')), '(^|[^\\p{{L}}])' || term || '([^\\p{{L}}]|$)') GROUP BY ALL),
    best AS (SELECT page_id, url, max_by(h || pre, length(h || pre)) AS rule, max_by(verdict, length(h || pre)) AS v
        FROM s JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, pre) GROUP BY ALL)
    SELECT s.page_id, host, path, rule,
        coalesce(v, CASE WHEN n_strict > 0 OR (n_soft >= {url.SOFT_LIMIT} AND w > {url.SOFT_WEIGHT} - 1e-9) THEN 'block' ELSE 'allow' END) AS verdict,
        n_strict::BIGINT AS n_strict, n_soft::BIGINT AS n_soft, round(w::DOUBLE, 6) AS soft_weight
    FROM s JOIN hit USING (page_id) LEFT JOIN best USING (page_id)"""


def _op6() -> str:
    rules = ("base", "symbols", "lines", "any")
    w = quality.WINDOW
    rate = "\n".join(
        f"""r_{k} AS (SELECT host, rate - {quality.DEVIATE} * sqrt(rate * (1 - rate) / (n + strength + 1)) > {'greatest(0.5, m)' if k == 'any' else 'm'} AS over FROM (
            SELECT *, (f_{k} + strength * m) / (n + strength) AS rate FROM (
            SELECT *, CASE WHEN var * 1e6 > m * (1 - m) THEN greatest({quality.MIN_STRENGTH}, m * (1 - m) / var - 1) ELSE 1e6 END AS strength FROM (
            SELECT *, q / total - m * m - m * (1 - m) * hosts / total AS var FROM (
            SELECT *, (SELECT sum(f_{k}) / sum(n) FROM h) AS m, (SELECT sum(f_{k}::DOUBLE * f_{k} / n) FROM h) AS q, (SELECT sum(n) FROM h) AS total, (SELECT count(*) FROM h) AS hosts FROM h))))),"""
        for k in rules
    )
    return f"""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t FROM documents),
    w AS (SELECT r, doc_id, source, t, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS ws FROM d),
    win AS (SELECT r, k, list_slice(ws, k, k + {w - 1}) AS g FROM (SELECT r, ws, unnest(range(1, len(ws) - {w - 2})) AS k FROM w)),
    twice AS (SELECT r, k FROM (SELECT r, k, count(*) OVER (PARTITION BY r, g) AS c FROM win) WHERE c > 1),
    rep AS (SELECT r, count(DISTINCT k + j)::BIGINT AS n_repeat_words FROM twice, range(0, {w}) AS x(j) GROUP BY r),
    ln AS (SELECT r, line, count(*) AS c FROM (SELECT r, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY ALL),
    dup AS (SELECT r, sum(c)::BIGINT AS n_lines, sum(c - 1)::BIGINT AS n_dup_lines FROM ln GROUP BY r),
    s AS (SELECT w.r, doc_id, source, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
        length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(n_lines, 0) AS n_lines, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
        FROM w LEFT JOIN rep ON w.r = rep.r LEFT JOIN dup ON w.r = dup.r),
    f AS (SELECT *, n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEAT_PERCENT} * n_words AS base_failed,
        100 * n_symbols > {quality.MAX_SYMBOL_PERCENT} * word_chars AS symbols_failed, 100 * n_dup_lines > {quality.MAX_DUP_LINE_PERCENT} * n_lines AS lines_failed FROM s),
    h AS (SELECT source AS host, count(*) AS n, count_if(base_failed) AS f_base, count_if(symbols_failed) AS f_symbols, count_if(lines_failed) AS f_lines,
        count_if(base_failed OR symbols_failed OR lines_failed) AS f_any FROM f WHERE source IS NOT NULL GROUP BY source),
    {rate}
    v AS (SELECT host, r_symbols.over AS by_symbols, r_lines.over AS by_lines, r_any.over AS failed FROM r_symbols JOIN r_lines USING (host) JOIN r_any USING (host))
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
        NOT (base_failed OR coalesce(failed, false) OR (coalesce(by_symbols, false) AND symbols_failed) OR (coalesce(by_lines, false) AND lines_failed)) AS kept
    FROM f LEFT JOIN v ON f.source = v.host"""


def _op8() -> str:
    k = dec.WINDOW
    words = "regexp_extract_all(" + LOWER.format("coalesce(text, '')") + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return f"""
    WITH b AS (SELECT item_id, {words} AS ws FROM benchmark),
    phrase AS (SELECT DISTINCT item_id, list_slice(ws, i, i + {k - 1}) AS g FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - {k - 2}, 2))) AS i FROM b WHERE len(ws) > 0)),
    sizes AS (SELECT DISTINCT len(g) AS n FROM phrase),
    d AS (SELECT row_number() OVER () AS r, doc_id, {words} AS ws FROM documents),
    win AS (SELECT r, n, i, list_slice(ws, i, i + n - 1) AS g FROM (SELECT r, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d, sizes)),
    hit AS (SELECT r, n, i, item_id FROM win JOIN phrase USING (g)),
    spots AS (SELECT r, count(DISTINCT i + j)::BIGINT AS n_hit FROM (SELECT DISTINCT r, i, unnest(range(0, n)) AS j FROM hit) GROUP BY r),
    its AS (SELECT r, count(*)::BIGINT AS n_items, string_agg(x, ',' ORDER BY x) AS ids FROM (SELECT DISTINCT r, item_id::VARCHAR AS x FROM hit) GROUP BY r)
    SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
        coalesce(n_hit, 0) > 0 AND {dec.MIN_SHARE} * coalesce(n_hit, 0) >= len(ws) AS contaminated
    FROM d LEFT JOIN spots ON d.r = spots.r LEFT JOIN its ON d.r = its.r"""


def _op9(shingle: int = 3, percent: int = 85) -> str:
    words = "regexp_extract_all(" + LOWER.format("coalesce(text, '')") + r", '[^\x20\x09-\x0D]+')"
    return f"""
    WITH RECURSIVE d AS (SELECT doc_id, {words} AS ws FROM documents),
    sets AS (SELECT doc_id, list_sort(list_distinct(list_transform(range(1, greatest(len(ws) - {shingle - 2}, 2)), lambda i: hash(list_slice(ws, i, i + {shingle - 1}))))) AS s FROM d WHERE len(ws) > 0),
    cls AS (SELECT min(doc_id) AS c, s, len(s) AS n FROM sets GROUP BY s),
    tok AS (SELECT c, n, unnest(s) AS x FROM cls),
    freq AS (SELECT x, count(*) AS f FROM tok GROUP BY x),
    ranked AS (SELECT c, n, x, row_number() OVER (PARTITION BY c ORDER BY f, x) AS p FROM tok JOIN freq USING (x)),
    prefix AS (SELECT c, n, x FROM ranked WHERE p <= n - (n * {percent} + 99) // 100 + 1),
    cand AS (SELECT DISTINCT a.c AS a, b.c AS b FROM prefix a JOIN prefix b USING (x) WHERE a.c < b.c AND 100 * least(a.n, b.n) >= {percent} * greatest(a.n, b.n)),
    link AS (SELECT a, b FROM (SELECT a, b, len(list_intersect(p.s, q.s)) AS i, p.n + q.n AS t FROM cand JOIN cls p ON p.c = a JOIN cls q ON q.c = b) WHERE 100 * i >= {percent} * (t - i)),
    pairs AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
    reach AS (SELECT c AS a, c AS b FROM cls UNION SELECT reach.a, pairs.b FROM reach JOIN pairs ON reach.b = pairs.a),
    comp AS (SELECT a AS c, min(b) AS root FROM reach GROUP BY a)
    SELECT d.doc_id, coalesce(len(sets.s), 0)::BIGINT AS n_shingles, coalesce(root, d.doc_id) AS component_id, coalesce(root, d.doc_id) = d.doc_id AS kept
    FROM d LEFT JOIN sets ON d.doc_id = sets.doc_id LEFT JOIN cls ON sets.s = cls.s LEFT JOIN comp ON cls.c = comp.c"""


def _op10() -> str:
    w = mixing.WEIGHTS
    cap = mixing.MAX_EPOCHS
    return f"""
    WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
        ('0x' || substr(md5(concat_ws('|', '{mixing.SEED}', coalesce(doc_id::VARCHAR, ''), coalesce(text, ''))), 1, {mixing.KEY_BITS // 4}))::BIGINT AS k FROM documents),
    s AS (SELECT source, sum(size)::BIGINT AS source_size, [{', '.join(map(str, w))}][1 + ((row_number() OVER (ORDER BY source IS NULL, source) - 1) % {len(w)})::INT]::DOUBLE AS weight FROM d GROUP BY source),
    o AS (SELECT *, sum(source_size) OVER () AS total, sum(weight) OVER () AS weights,
        coalesce(sum({cap} * source_size) OVER (ORDER BY {cap}.0e0 * source_size / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped,
        coalesce(sum(weight) OVER (ORDER BY {cap}.0e0 * source_size / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM s),
    lv AS (SELECT *, (total - capped)::DOUBLE / (weights - used) AS level FROM o),
    fixed AS (SELECT first(level ORDER BY {cap}.0e0 * source_size / weight, source IS NULL, source) FILTER (WHERE {cap}.0e0 * source_size / weight > level) AS lv FROM lv),
    t AS (SELECT source, source_size, round(coalesce(least(lv * weight, {cap}.0e0 * source_size), {cap}.0e0 * source_size), 6) AS target FROM lv, fixed),
    b AS (SELECT *, CASE WHEN source_size > 0 THEN round(target)::BIGINT // source_size ELSE 0 END AS copies FROM t),
    x AS (SELECT doc_id, size, b.source_size, target, copies, round(target)::BIGINT - copies * b.source_size AS rest,
        coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
        FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source)
    SELECT doc_id, size, source_size, target, (copies * size + greatest(0, least(size, rest - before)))::BIGINT AS taken FROM x"""


def _op11(k: int = 40, dims: int = 64, rounds: int = 5) -> str:
    """Lloyd's rounds in full: all distances, no bounds."""
    d = "list_sum(list_transform(list_zip(e.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
    parts = [
        f"""e AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
        WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dims})""",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('2:' || coalesce(vec_id::VARCHAR, '')), v) - 1 AS c, v FROM e ORDER BY c LIMIT {k})",
    ]
    for n in range(rounds + 1):
        parts.append(f"a{n} AS MATERIALIZED (SELECT r, vec_id, v, w.d AS d, w.c AS c FROM (SELECT e.r, e.vec_id, e.v, min({{'d': {d}, 'c': c.c}}) AS w FROM e, c{n} c GROUP BY ALL))")
        if n < rounds:
            parts.append(f"""c{n + 1} AS MATERIALIZED (SELECT o.c, coalesce(m.v, o.v) AS v FROM c{n} o LEFT JOIN (SELECT c, list((floor_sum - ((floor_sum % n) + n) % n) // n ORDER BY i)::BIGINT[] AS v FROM (
            SELECT c, i, sum(x) AS floor_sum, count(*) AS n FROM (SELECT c, unnest(v) AS x, unnest(range({dims})) AS i FROM a{n}) GROUP BY c, i) GROUP BY c) m ON o.c = m.c)""")
    return f"""WITH {", ".join(parts)}
    SELECT vec_id, a.c::INT AS cluster, d::BIGINT AS distance, (count(*) OVER (PARTITION BY a.c))::BIGINT AS cluster_size, (sum(d) OVER (PARTITION BY a.c))::BIGINT AS cluster_inertia,
        (sum(d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256 FROM a{rounds} a JOIN c{rounds} c ON a.c = c.c"""


def _op12() -> str:
    """The dynamic program row by row, for every conversation on its own: no signatures, no sharing."""
    follows = "((0, 's', 1), (0, 'u', 2), (1, 'u', 2), (3, 'u', 2), (2, 'a', 3))"
    crc = _crc32("k")
    space = r"[\x20\x09-\x0D]"
    return f"""
    WITH RECURSIVE {CRC_TABLE},
    src AS (SELECT row_number() OVER () AS r, conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
    dmg AS (SELECT src.*, {crc} % 20 AS d FROM src, crc),
    aft AS (SELECT coalesce(conv_id::VARCHAR, 'none') AS c, turn, CASE WHEN d = 4 THEN 'user' ELSE role END AS role,
        CASE d WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE WHEN d = 3 THEN [0, 1] ELSE [0] END) AS copy FROM dmg WHERE d <> 0),
    num AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, sha256(length(role) || ':' || role || text), copy) AS i, left(role, 1) AS ini FROM aft),
    flt AS (SELECT *, lag(ini) OVER (PARTITION BY c ORDER BY i) AS before, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'b' WHEN row_number() OVER (PARTITION BY c, role, text ORDER BY i) > 1 THEN 'd'
        WHEN NOT regexp_matches(text, '[.!?]{space}*$') THEN 't' ELSE '' END AS fault FROM num),
    facts AS (SELECT c, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'b') AS blank, count(*) FILTER (WHERE fault = 'd') AS duplicate,
        count(*) FILTER (WHERE fault = 't') AS truncated, count(*) FILTER (WHERE before IS NOT NULL AND before || ini NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n FROM flt GROUP BY c),
    fol(f, ini, t) AS (VALUES {follows[1:-1]}),
    ins AS (SELECT s AS f, s AS t, 0 AS cost, '' AS let, '' AS rol FROM range(0, 4) x(s) UNION ALL SELECT f, t, 5, 'I', ini FROM fol WHERE ini <> 's'
        UNION ALL SELECT a.f, b.t, 10, 'II', a.ini || b.ini FROM fol a JOIN fol b ON a.t = b.f WHERE a.ini <> 's' AND a.f < 2),
    op AS (SELECT s AS f, s AS t, 2 AS cost, 'D' AS let, '-' AS rol, '*' AS own, FALSE AS stays FROM range(0, 4) x(s) UNION ALL SELECT f, t, 0, 'K', 'k', ini, TRUE FROM fol
        UNION ALL SELECT f, t, 1, 'R', ini, '*', TRUE FROM fol WHERE ini <> 's'),
    mv AS (SELECT ins.f, op.t, ins.cost + op.cost AS cost, ins.let || op.let AS let, ins.rol || op.rol AS rol, own, stays FROM ins JOIN op ON ins.t = op.f),
    dp AS (SELECT c, 0 AS i, 0 AS st, 0::BIGINT AS cost, '' AS audit, '' AS roles FROM facts UNION ALL
        SELECT c, i, st, cost, audit, roles FROM (SELECT *, row_number() OVER (PARTITION BY c, st ORDER BY cost, audit) AS rn FROM (
            SELECT dp.c, flt.i, mv.t AS st, dp.cost + mv.cost + CASE WHEN stays AND fault = 't' THEN 5 ELSE 0 END AS cost, audit || let AS audit, roles || rol AS roles
            FROM dp JOIN flt ON dp.c = flt.c AND flt.i = dp.i + 1 JOIN mv ON mv.f = dp.st AND own IN ('*', ini) AND NOT (stays AND fault IN ('b', 'd')))) WHERE rn = 1),
    fin AS (SELECT dp.c, arg_min({{'cost': dp.cost + ins.cost, 'audit': audit || let, 'roles': roles || rol}}, {{'cost': dp.cost + ins.cost, 'audit': audit || let}}) AS b
        FROM dp JOIN facts ON dp.c = facts.c AND dp.i = facts.n JOIN ins ON ins.f = dp.st AND ins.t IN (0, 3) GROUP BY dp.c),
    pos AS (SELECT c, b, k, b.audit[k] AS let, b.roles[k] AS rol, length(replace(b.audit[:k], 'I', '')) AS i FROM fin, range(1, length(b.audit) + 1) x(k)),
    txt AS (SELECT pos.c, string_agg(CASE rol WHEN 'k' THEN flt.role WHEN 'u' THEN 'user' ELSE 'assistant' END || ':' || CASE let WHEN 'I' THEN '' ELSE flt.text END, chr(10) ORDER BY k) AS t
        FROM pos LEFT JOIN flt ON pos.c = flt.c AND pos.i = flt.i WHERE let <> 'D' GROUP BY pos.c)
    SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
        coalesce(b.cost, 0)::BIGINT AS cost, coalesce(b.audit, '') AS audit, sha256(coalesce(t, '')) AS repaired_sha256
    FROM (SELECT DISTINCT conv_id, coalesce(conv_id::VARCHAR, 'none') AS c FROM conversations) o LEFT JOIN facts USING (c) LEFT JOIN fin USING (c) LEFT JOIN txt USING (c)"""


def _op13() -> str:
    def long(x: str) -> str:
        """Code points of an escaped text: one more a backslash, an end mark, and a # that two others follow."""
        return f"(length({x}) + length({x}) - length(replace({x}, chr(92), '')) + (length({x}) - length(replace({x}, '</turn>', ''))) // 7 + coalesce(list_sum(list_transform(regexp_extract_all({x}, '#{{3,}}'), lambda y: length(y) - 2)), 0))"

    return f"""
    WITH r AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
        UNION ALL SELECT -7, k, ['user', 'assistant'][k + 1], chr(92) || '### Assistant: </turn> ok' FROM range(0, 2) x(k)),
    g AS (SELECT conv_id, coalesce(conv_id::VARCHAR, '') AS k, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS turns,
        coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '') AS learned, list(role ORDER BY turn NULLS FIRST, role, text) AS roles,
        sum(14 + {long("role")} + length(role) - length(replace(role, ':', '')) + {long("text")}) AS formatted_chars FROM r GROUP BY conv_id),
    {CRC_TABLE},
    h AS (SELECT g.*, {_crc32("k")} % 6 AS kind FROM g, crc)
    SELECT conv_id, CASE WHEN kind = 1 AND len(list_filter(roles, lambda x: x NOT IN ('system', 'user', 'assistant'))) = 0 THEN 'conversations' WHEN kind = 2 AND roles = ['user', 'assistant'] THEN 'prompt_response'
        WHEN kind = 3 AND roles = ['user', 'assistant'] THEN 'instruction' WHEN kind = 4 AND n_turns > 1 THEN 'prompt_completion_turns' WHEN kind = 5 THEN 'example_turns' ELSE 'messages' END AS layout,
        n_turns::BIGINT AS n_turns, sha256(turns) AS turns_sha256, length(learned)::BIGINT AS loss_chars, sha256(learned) AS loss_sha256, formatted_chars::BIGINT AS formatted_chars FROM h"""


def oracle_sql() -> dict[str, str]:
    return {
        "op2_url_vocabulary": _op2(), "op6_host_quality": _op6(), "op8_fm_decontamination": _op8(),
        "op9_chosen_path_dedup": _op9(), "op10_source_mixing": _op10(), "op11_elkan_clusters": _op11(),
        "op12_conversation_repair": _op12(), "op13_chat_format": _op13(),
    }
