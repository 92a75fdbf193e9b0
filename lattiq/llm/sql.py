"""DuckDB statements equal to the text queries, written against the contracts rather than the operators."""

from __future__ import annotations

from lattiq.llm.quality_rules import N_BANDS, N_COMMON

WORD_RE = r"[^\x20\x09-\x0D]+"


def quality_rules_sql(min_words: int = 50, trim: float = 0.13, chars: float = 0.18, words: float = 0.30) -> str:
    cc = ["upper", "symbol", "mark", "blank", "other"]
    wc = [f"w{i}" for i in range(N_BANDS)] + ["wo"]
    n_re = lambda p: f"len(regexp_extract_all(t, '{p}'))"
    tot = lambda cols, p="": "(" + "+".join(p + c for c in cols) + ")"

    def js(cols):
        terms = []
        for c in cols:
            p, q = f"({c}::DOUBLE/nullif({tot(cols)},0))", f"(r.{c}::DOUBLE/nullif({tot(cols, 'r.')},0))"
            terms.append(f"(CASE WHEN {p}>0 THEN {p}*log2(2*{p}/({p}+{q})) ELSE 0 END + CASE WHEN {q}>0 THEN {q}*log2(2*{q}/({q}+{p})) ELSE 0 END)/2")
        return f"CASE WHEN {tot(cols)}>0 AND {tot(cols, 'r.')}>0 THEN sqrt(greatest({'+'.join(terms)},0)) END"

    ref = ", ".join(f"sum(round(1e6*{c}/nullif({tot(cols)},0))::BIGINT)::DOUBLE AS {c}" for cols in (cc, wc) for c in cols)
    dist = lambda src: (
        f"SELECT c.*, {js(cc).replace('r.', 'rr.')} AS jc, {js(wc).replace('r.', 'rr.')} AS jw FROM h c "
        f"LEFT JOIN (SELECT k AS rk, {', '.join(f'{c} AS r_{c}' for c in cc + wc)} FROM {src}) q ON c.k IS NOT DISTINCT FROM q.rk"
    ).replace("rr.", "q.r_")
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, lang, coalesce(text,'') AS t, lang AS k,
    regexp_extract_all(coalesce(text,''), '{WORD_RE}') AS ws,
    list_filter(string_split(coalesce(text,''), chr(10)), lambda x: regexp_matches(x, '{WORD_RE}')) AS ls FROM documents),
tri AS (SELECT rid, i, ws[i] AS a, ws[i+1] AS b, ws[i+2] AS c FROM (SELECT rid, ws, unnest(range(1, len(ws)-1)) AS i FROM d)),
rep AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, a, b, c) AS n FROM tri) WHERE n > 1),
cov AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i+1, i+2]) AS p FROM rep) GROUP BY rid),
cw AS (SELECT lang, w, length(bin(r)) - 1 AS band FROM (SELECT lang, w, row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, w) AS r
    FROM (SELECT lang, unnest(list_distinct(ws)) AS w FROM d WHERE len(ws) >= {min_words}) GROUP BY lang, w) WHERE r <= {N_COMMON}),
wb AS (SELECT rid, {', '.join(f"count(*) FILTER (WHERE band = {i}) AS w{i}" for i in range(N_BANDS))}
    FROM (SELECT rid, lang, unnest(ws) AS w FROM d) x JOIN cw ON x.w = cw.w AND x.lang IS NOT DISTINCT FROM cw.lang GROUP BY rid),
b AS (SELECT d.*, len(ws) AS n_words, len(array_to_string(ws, '')) AS word_chars, {n_re('[#*$%&|<>]')} AS symbol,
    {n_re(chr(92) + 'p{Lu}')} AS upper, {n_re('[0-9.,;:!?' + "''" + '"()-]')} AS mark, len(ls)-len(list_distinct(ls)) AS n_dup_lines,
    coalesce(cov.n, 0) AS n_repeat_words FROM d LEFT JOIN cov USING (rid)),
h AS (SELECT *, length(t)-word_chars AS blank, word_chars-upper-symbol-mark AS other,
    {', '.join(f"coalesce(w{i}, 0) AS w{i}" for i in range(N_BANDS))}, n_words - ({' + '.join(f"coalesce(w{i}, 0)" for i in range(N_BANDS))}) AS wo,
    (n_words < 50 OR 100*n_repeat_words > 50*n_words) AS base_failed FROM (SELECT b.*, wb.* EXCLUDE (rid) FROM b LEFT JOIN wb USING (rid))),
r1 AS (SELECT k, {ref} FROM h WHERE NOT base_failed GROUP BY k),
d1 AS ({dist('r1')}),
r2 AS (SELECT k, {ref} FROM d1 WHERE NOT base_failed AND jc <= {trim} GROUP BY k),
d2 AS ({dist('r2')})
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, symbol::BIGINT AS n_symbols,
    n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
    NOT base_failed AND NOT coalesce(n_words >= {min_words} AND (jc > {chars} OR jw > {words}), false) AS kept FROM d2"""


def mixing_sql(weights=(3, 1, 2), share: float = 1.5, cap: float = 2.0, block: int = 64, shard_slots: int = 4096, seed: int = 42) -> str:
    """The same packing, draws, permutations and join, over rows that are exploded without regard to size."""
    from lattiq.llm.mixing import P31, round_constants

    def mix31(x: str, a: int, b: int) -> str:
        mod = lambda v: f"(({v}) % {P31} + {P31}) % {P31}"
        return f"((((({mod(x)}) * {a} + {b}) % {P31}) + (({mod(f'floor(({x})::DOUBLE / {P31})::BIGINT')}) * {b | 1}) % {P31}) % {P31})"

    (a0, b0, *_), = round_constants(seed, 1)
    perm, last = "", "s0"
    for j, (a, b, c, e) in enumerate(round_constants(seed + 1)):
        turn = f"(({mix31('key', a, b)} * 65536 + {mix31('key', c, e)}) % n_blocks)"
        perm += f"""t{j} AS (SELECT *, (({turn} - x) % n_blocks + n_blocks) % n_blocks AS y FROM {last}),
s{j + 1} AS (SELECT src, r, n_blocks, key, CASE WHEN ({mix31('greatest(x, y) + key * 7919', e, a)} // 65536) % 2 = 1 THEN y ELSE x END AS x FROM t{j}),
"""
        last = f"s{j + 1}"
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(doc_id, ('0x' || substr(md5(coalesce(text,'')), 1, 7))::BIGINT) AS own,
    len(regexp_extract_all(coalesce(text,''), '{WORD_RE}'))::BIGINT AS size FROM documents),
tot AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
o AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS src FROM tot),
w AS (SELECT *, [{', '.join(f'{float(x)}' for x in weights)}][src % {len(weights)} + 1]::DOUBLE AS weight, source_size * {float(cap)}::DOUBLE AS most FROM o),
l AS (SELECT *, most / weight AS ratio,
    ((SELECT sum(source_size) FROM w) * {float(share)}::DOUBLE - coalesce(sum(most) OVER b, 0)) / ((SELECT sum(weight) FROM w) - coalesce(sum(weight) OVER b, 0)) AS lv
    FROM w WINDOW b AS (ORDER BY most / weight, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s AS (SELECT * EXCLUDE (most), coalesce(least(most, weight * (SELECT lv FROM l WHERE lv <= ratio ORDER BY ratio, src LIMIT 1)), most) AS target,
    least({block}, greatest(ceil(source_size::DOUBLE / 128), 1))::BIGINT AS width FROM l),
sw AS (SELECT *, ceil(source_size::DOUBLE / width)::BIGINT AS n_blocks, round(target - wh * source_size)::BIGINT AS rest
    FROM (SELECT *, coalesce(floor(target / nullif(source_size, 0)), 0)::BIGINT AS wh FROM s)),
n AS (SELECT *, ceil(rest::DOUBLE / width)::BIGINT AS part, wh * n_blocks + ceil(rest::DOUBLE / width)::BIGINT AS n_slots FROM sw),
f AS (SELECT *, coalesce(sum(n_slots) OVER (ORDER BY src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS fst FROM n),
g AS (SELECT unnest(range(0, (SELECT sum(n_slots) FROM n)::BIGINT)) AS g),
u AS (SELECT g // {shard_slots} AS shard, g % {shard_slots} AS slot,
    floor(('0x' || substr(md5('{seed}:' || g // {shard_slots} || ':' || g % {shard_slots}), 1, 13))::BIGINT / {1 << 52}.0::DOUBLE * (SELECT sum(n_slots) FROM n)::DOUBLE)::BIGINT AS pos FROM g),
dr AS (SELECT shard, src, row_number() OVER (PARTITION BY src ORDER BY shard, slot) - 1 AS r FROM u JOIN f ON pos >= fst AND pos < fst + n_slots),
lack AS (SELECT src, n_slots, drawn, coalesce(sum(greatest(n_slots - drawn, 0)) OVER (ORDER BY src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS ahead
    FROM (SELECT n.src, n_slots, count(dr.src) AS drawn FROM n LEFT JOIN dr USING (src) GROUP BY n.src, n_slots)),
pl AS (SELECT shard, src, r FROM dr JOIN n USING (src) WHERE r < n_slots UNION ALL
    SELECT (SELECT ceil(sum(n_slots) / {shard_slots}.0) FROM n)::BIGINT + (ahead + r - drawn) // {shard_slots}, src, r
    FROM (SELECT src, ahead, drawn, unnest(range(drawn, n_slots)) AS r FROM lack WHERE n_slots > drawn)),
r AS (SELECT src, n_blocks, unnest(range(0, n_slots)) AS r FROM n WHERE n_slots > 0),
s0 AS (SELECT src, r, n_blocks, src * 1009 + r // n_blocks + 1 AS key, r % n_blocks AS x FROM r),
{perm}slots AS (SELECT p.shard, p.src, z.x AS block, CASE WHEN part > 0 AND p.r = n_slots - 1 THEN rest - (part - 1) * width END AS upto
    FROM pl p JOIN {last} z USING (src, r) JOIN n USING (src)),
placed AS (SELECT d.*, n.src, n.source_size, n.target, n.width,
    coalesce(sum(d.size) OVER (PARTITION BY n.src ORDER BY {mix31('own', a0, b0)}, doc_id NULLS FIRST, d.size, rid
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS st FROM d JOIN n ON d.source IS NOT DISTINCT FROM n.source),
p AS (SELECT *, unnest(range(st // width, (st + size - 1) // width + 1)) AS block FROM placed WHERE size > 0),
got AS (SELECT rid, shard, greatest(least(t - f, coalesce(upto - (f - p.block * width), t - f)), 0) AS w
    FROM (SELECT *, greatest(block * width, st) AS f, least((block + 1) * width, st + size) AS t FROM p) p JOIN slots USING (src, block)),
sums AS (SELECT rid, sum(w) AS taken, min(shard) FILTER (WHERE w > 0) AS first_shard, max(shard) FILTER (WHERE w > 0) AS last_shard FROM got GROUP BY rid)
SELECT doc_id, size, source_size, target, coalesce(taken, 0)::BIGINT AS taken, first_shard::BIGINT AS first_shard, last_shard::BIGINT AS last_shard FROM placed LEFT JOIN sums USING (rid)"""


def line_dedup_sql(min_docs: int = 5, min_chars: int = 40) -> str:
    blanks = "chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)"
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text,''), chr(10)) AS ls FROM documents),
l AS (SELECT rid, doc_id, i, ls[i] AS line, translate(trim(ls[i], {blanks}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
    FROM (SELECT rid, doc_id, ls, unnest(range(1, len(ls)+1)) AS i FROM d)),
k AS (SELECT key, max(doc_id) AS last_doc FROM l WHERE length(key) >= {min_chars} GROUP BY key HAVING count(DISTINCT doc_id) >= {min_docs}),
m AS (SELECT l.*, k.key IS NOT NULL AND l.doc_id IS DISTINCT FROM k.last_doc AS gone FROM l LEFT JOIN k USING (key))
SELECT min(doc_id) AS doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_dropped,
    sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256 FROM m GROUP BY rid"""


def chat_sql() -> str:
    esc = r"regexp_replace(text, '<(\\*)\|', '<\1\\|', 'g')"
    name = r"replace(replace(replace(replace(role, '%', '%25'), '<', '%3C'), chr(10), '%0A'), chr(13), '%0D')"
    return f"""
WITH c AS (SELECT conv_id, turn, coalesce(role,'') AS role, coalesce(text,'') AS text FROM conversations
    UNION ALL VALUES (-1, 0, 'user', '<|im_end|><|im_start|>assistant ok'), (-1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'))
SELECT conv_id::BIGINT AS conv_id, count(*)::BIGINT AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
    coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
    sum(24 + length({name}) + length({esc}))::BIGINT AS formatted_chars FROM c GROUP BY conv_id"""


def filter_audit_sql(min_words: int = 50, distinct: int = 65, upper: int = 5) -> str:
    """Every order is gone through document mask by document mask; no transform, no closed form."""
    letters = "(VALUES ('A'), ('B'), ('C'), ('D'), ('E'))"
    place = lambda x: f"CASE WHEN contains(fails, '{x}') THEN strpos(filter_order, '{x}') ELSE 6 END"
    return f"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{WORD_RE}') AS ws FROM documents),
f AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS first_id, part, len(ws) < {min_words} AS a, 100 * len(list_distinct(ws)) < {distinct} * len(ws) AS b,
    100 * len(regexp_extract_all(t, '[A-Z]')) > {upper} * length(t) AS c, regexp_matches(t, '[#$%&*|]') AS d FROM d),
l AS (SELECT doc_id, max((coalesce(quality, 0) = 1)::INT) AS good, max((coalesce(toxic, 0) = 1)::INT) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
m AS (SELECT part, CASE WHEN a THEN 'A' ELSE '' END || CASE WHEN b THEN 'B' ELSE '' END || CASE WHEN c THEN 'C' ELSE '' END || CASE WHEN d THEN 'D' ELSE '' END
    || CASE WHEN coalesce(f.doc_id > first_id, false) THEN 'E' ELSE '' END AS fails, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic FROM f LEFT JOIN l USING (doc_id)),
n AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY part, fails),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM {letters} a(x), {letters} b(x), {letters} c(x), {letters} d(x), {letters} e(x)
    WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
w AS (SELECT n.*, filter_order, least({', '.join(map(place, 'ABCDE'))}) AS removed_at FROM n, o),
s AS (SELECT part, filter_order, step, substr(filter_order, step, 1) AS filter,
    sum(n) FILTER (WHERE removed_at > step) AS kept, sum(n) FILTER (WHERE removed_at = step) AS removed,
    sum(n) FILTER (WHERE removed_at < step AND contains(fails, substr(filter_order, step, 1))) AS redundant, sum(n) FILTER (WHERE fails = substr(filter_order, step, 1)) AS unique_fails,
    sum(good) FILTER (WHERE removed_at = step) AS good_lost, sum(toxic) FILTER (WHERE removed_at = step) AS toxic_lost
    FROM w, (SELECT unnest(range(1, 6))::INT AS step) GROUP BY part, filter_order, step)
SELECT part, filter_order, step, {', '.join(f'coalesce({c}, 0)::BIGINT AS {c}' for c in ('kept', 'removed', 'redundant', 'unique_fails', 'good_lost', 'toxic_lost'))},
    coalesce(sum(removed) OVER (PARTITION BY part, filter), 0)::BIGINT AS shapley FROM s"""


def lexical_sql(k: int = 20) -> str:
    """Every document is scored for every item."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    terms = lambda t: rf"regexp_extract_all(translate(coalesce({t}, ''), '{upper}', '{lower}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {terms('text')} AS ts FROM documents),
q AS (SELECT row_number() OVER () AS qid, item_id, {terms('text')} AS ts FROM benchmark),
qt AS (SELECT qid, item_id, term, count(*) AS times FROM (SELECT qid, item_id, unnest(ts) AS term FROM q) GROUP BY qid, item_id, term),
s AS (SELECT count(*)::BIGINT AS n_docs, sum(len(ts))::BIGINT AS n_terms FROM d WHERE len(ts) > 0),
p AS (SELECT rid, doc_id, n, term, count(*)::BIGINT AS tf FROM (SELECT rid, doc_id, len(ts)::BIGINT AS n, unnest(ts) AS term FROM d)
    WHERE term IN (SELECT term FROM qt) GROUP BY rid, doc_id, n, term),
w AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w FROM (SELECT term, count(*) AS df FROM p GROUP BY term), s),
x AS (SELECT rid, doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * n_docs) // n_terms))) AS worth FROM p JOIN w USING (term), s),
r AS (SELECT qid, item_id, rid, doc_id, sum(worth * times)::BIGINT AS score FROM x JOIN qt USING (term) GROUP BY qid, item_id, rid, doc_id),
o AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM r WHERE score > 0)
SELECT item_id, rank::INT AS rank, doc_id, score FROM o WHERE rank <= {k}"""
