"""DuckDB's SQL for operators whose results it can express: the kernels' 64-bit arithmetic written out in 128-bit numbers."""

from __future__ import annotations

from . import decontamination as decontamination_, line_dedup as line_dedup_, near_dedup, packing, textkernel

_M = "18446744073709551616::UHUGEINT"


def _n(x: int) -> str:
    return f"{x}::UHUGEINT"


def let(name: str, value: str, body: str) -> str:
    """``body`` with a name for a value."""
    return f"list_transform([{value}], lambda {name}: {body})[1]"


def mix(x: str) -> str:
    """``textkernel.mix``."""
    step = lambda v, s, c: f"(xor({v}, {v} >> {s}) * {_n(c)}) % {_M}"
    return let("m1", f"({x} + {_n(0x9E3779B97F4A7C15)}) % {_M}", let("m2", step("m1", 30, 0xBF58476D1CE4E5B9), let("m3", step("m2", 27, 0x94D049BB133111EB), "xor(m3, m3 >> 31)")))


#: Tokens of every text with an id: runs of bytes above the space.
TOKENS = r"""d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents WHERE doc_id IS NOT NULL),
t AS (SELECT rid, doc_id, unnest(regexp_extract_all(text, '[^\x00-\x20]+')) AS w FROM d)"""


def hashes() -> str:
    """(w, h): each distinct token's hash, as of ``Chunk.hashes``."""
    table = "[" + ", ".join(_n(int(x)) for x in textkernel._TABLE) + "]"
    horner = f"list_reduce(list_reverse(list_transform(range(0, length(x) // 2), lambda j: tab[1 + CAST('0x' || substr(x, CAST(2 * j + 1 AS INTEGER), 2) AS INTEGER)])), lambda a, b: (a * {_n(int(textkernel._R))} + b) % {_M})"
    return f"tb AS (SELECT {table} AS tab), u AS (SELECT DISTINCT w, hex(encode(w)) AS x FROM t), h0 AS (SELECT w, xor({horner}, CAST(length(x) // 2 AS UHUGEINT) << 40) AS s FROM u, tb), h AS (SELECT w, {mix('s')} AS h FROM h0)"


def simhash_groups() -> str:
    most = 2 * near_dedup.SEGMENTS - 1
    one = lambda c, k: mix(f"(k * {_n(c)} + {k}) % {_M}")
    return f"""WITH RECURSIVE {TOKENS}, {hashes()},
dt AS (SELECT DISTINCT rid, doc_id, h >> 20 AS k FROM t JOIN h USING (w)),
kk AS (SELECT k, CAST({one(0x2545F4914F6CDD1D, 1)} AS UBIGINT) AS a, CAST({one(0x9E6C63D0876A9A47, 7)} AS UBIGINT) AS b FROM (SELECT DISTINCT k FROM dt)),
bits AS (SELECT rid, doc_id, i, 2 * sum(CAST((a >> i) & 1 AS INTEGER)) > count(*) AS x, 2 * sum(CAST((b >> i) & 1 AS INTEGER)) > count(*) AS y FROM dt JOIN kk USING (k), (SELECT CAST(unnest(range(64)) AS UBIGINT) AS i) GROUP BY ALL),
sig AS (SELECT rid, doc_id, string_agg(CASE WHEN x THEN '1' ELSE '0' END, '' ORDER BY i) || string_agg(CASE WHEN y THEN '1' ELSE '0' END, '' ORDER BY i) AS s FROM bits GROUP BY ALL),
n AS (SELECT s, min(doc_id) AS first, row_number() OVER (ORDER BY s) AS node FROM sig GROUP BY s),
e AS (SELECT a.node AS u, b.node AS v FROM n a JOIN n b ON a.node <> b.node AND bit_count(xor(a.s::BIT, b.s::BIT)) <= {most}),
r(node, m) AS (SELECT node, node FROM n UNION SELECT e.v, r.m FROM r JOIN e ON r.node = e.u),
g AS (SELECT node, min(m) AS root FROM r GROUP BY node),
k AS (SELECT root, min(first) AS kept_id FROM g JOIN n USING (node) GROUP BY root)
SELECT DISTINCT sig.doc_id, k.kept_id FROM sig JOIN n USING (s) JOIN g USING (node) JOIN k USING (root) WHERE sig.doc_id <> k.kept_id"""


def packs() -> str:
    """The bins of one group, which a corpus under ``packing.GROUP_TOKENS`` tokens is: best fit, largest first, one piece after another."""
    c = packing.CAPACITY
    return rf"""WITH RECURSIVE l AS (SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[^\x00-\x20]+')) AS n FROM documents WHERE doc_id IS NOT NULL),
k AS (SELECT doc_id, n, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC) - 1 AS copy FROM l WHERE n > 0),
p0 AS (SELECT doc_id, copy, n, unnest(generate_series(0, n - 1, {c})) AS start FROM k),
p AS (SELECT *, row_number() OVER (ORDER BY size DESC, doc_id, copy, start) AS nth FROM (SELECT doc_id, copy, start, least({c}, n - start) AS size FROM p0)),
b(nth, rooms, bin) AS (SELECT 0::BIGINT, []::BIGINT[], 0::BIGINT
  UNION ALL SELECT p.nth, CASE WHEN f.bin > len(b.rooms) THEN list_append(b.rooms, {c} - p.size) ELSE list_transform(b.rooms, lambda x, i: CASE WHEN i = f.bin THEN x - p.size ELSE x END) END, f.bin
  FROM b JOIN p ON p.nth = b.nth + 1, LATERAL (SELECT CAST(coalesce(list_position(b.rooms, list_min(list_filter(b.rooms, lambda x: x >= p.size))), len(b.rooms) + 1) AS BIGINT) AS bin) f),
w AS (SELECT p.*, b.bin FROM p JOIN b USING (nth))
SELECT first_value(doc_id || '-' || copy || '-' || start) OVER o AS pack_id, CAST(row_number() OVER o - 1 AS INTEGER) AS position, doc_id, CAST(copy AS INTEGER) AS copy, start, CAST(size AS INTEGER) AS n_tokens, CAST(sum(size) OVER (PARTITION BY bin) AS BIGINT) AS pack_tokens
FROM w WINDOW o AS (PARTITION BY bin ORDER BY doc_id, copy, start)"""


def _fold(parts: str, start: str, factor: int) -> str:
    """A sequence hash: ``mix(a * factor + x)`` from left to right."""
    return f"list_reduce(list_prepend({start}, {parts}), lambda a, x: {mix(f'((a * {_n(factor)} + x) % {_M})')})"


def _common(a: str, b: str) -> str:
    """How many first entries two lists have in common."""
    return f"coalesce(nullif(list_position(list_transform(range(1, least(len({a}), len({b})) + 1), lambda k: {a}[k] <> {b}[k]), true), 0), least(len({a}), len({b})) + 1) - 1"


def line_dedup() -> str:
    """``line_dedup.dedup_lines`` on documents of unique ids; lines are counted from 1, ends are exclusive."""
    noise, window = line_dedup_.NOISE_WORDS, line_dedup_.WINDOW_WORDS
    t, n, gap = r"[^\x00-\x20]", r"[^\x00-\x20.!?]", r"[\x00-\x20]"
    within = r"[\x00-\x09\x0b-\x20]"
    line = rf"(?:{t}*{n}{within}+)*(?:{t}*[.!?](?:{gap}+|$)|{t}*{n}(?:{within}*\n{gap}*|{within}*$))"
    space = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+$"
    upto = lambda x, op="<": f"len(list_filter(tots, lambda q: q {op} {x}))"
    return f"""WITH {TOKENS}, {hashes()},
l0 AS (SELECT rid, regexp_extract(text, '^{gap}*') AS lead, text FROM d),
l1 AS (SELECT rid, lead, regexp_extract_all(substr(text, length(lead) + 1), '{line}') AS pieces FROM l0),
l AS (SELECT rid, unnest(pieces) AS piece, generate_subscripts(pieces, 1) AS i FROM l1),
lw AS (SELECT rid, i, unnest(ws) AS w, generate_subscripts(ws, 1) - 1 AS turn FROM (SELECT rid, i, regexp_extract_all(piece, '{t}+') AS ws FROM l)),
mw AS (SELECT rid, i, CAST({mix(f"(h + CAST(turn AS UHUGEINT) * {_n(0xD1B54A32D192ED03)}) % {_M}")} AS HUGEINT) AS x FROM lw JOIN h USING (w)),
lh AS (SELECT rid, i, words, {mix("s")} AS hash FROM (SELECT rid, i, count(*) AS words, CAST(sum(x) AS UHUGEINT) % {_M} AS s FROM mw GROUP BY ALL)),
lt AS (SELECT *, CAST(sum(words) OVER (PARTITION BY rid ORDER BY i) AS BIGINT) - words AS tot FROM lh),
r AS (SELECT rid, list(tot ORDER BY i) AS tots, list(hash ORDER BY i) AS hs, list(hash % 4294967296::UHUGEINT ORDER BY i) AS h32, count(*) AS n, CAST(sum(words) AS BIGINT) AS total FROM lt GROUP BY rid),
g0 AS (SELECT rid, i, tot, n, total, tots, hs, h32, tot + {noise} <= total AS whole, {upto(f"tot + {noise}")} + 1 AS e, {upto(f"tot + {window}")} + 1 AS reach FROM lt JOIN r USING (rid)),
g AS (SELECT *, {_fold("list_slice(hs, i, e - 1)", "0::UHUGEINT", 0x9FB21C651E98DF25)} AS g FROM g0 WHERE whole),
gl AS (SELECT rid, list(g ORDER BY i) AS gs FROM g GROUP BY rid),
ok AS (SELECT g.*, reach - 1 <= len(gs) AS ok, list_slice(gs, i, reach - 1) AS win FROM g JOIN gl USING (rid)),
spots AS (SELECT rid, i - 1 + list_position(win, list_min(win)) AS i FROM ok WHERE ok UNION SELECT rid, arg_min(i, (g, i)) FROM ok WHERE NOT ok GROUP BY rid),
picks AS (SELECT rid, g, min(i) AS i FROM spots JOIN g USING (rid, i) GROUP BY rid, g),
prints AS (SELECT rid, g.g AS h, i - 1 AS a, e - 1 AS z, list_reverse(list_slice(h32, greatest(1, {upto(f"tot - {window}", "<=")}), i - 1)) AS bef, list_slice(h32, e, {upto(f"coalesce(tots[e], total) + {window}")}) AS aft FROM picks JOIN g USING (rid, i)
  UNION ALL SELECT rid, {mix(f"(s + 1) % {_M}")}, 0, n, [], [] FROM (SELECT rid, n, CAST(sum(CAST({mix(f"(hash + CAST(i - 1 AS UHUGEINT) * {_n(0xC2B2AE3D27D4EB4F)}) % {_M}")} AS HUGEINT)) AS UHUGEINT) % {_M} AS s FROM lt JOIN r USING (rid) WHERE total >= {noise} GROUP BY ALL)),
pd AS (SELECT prints.*, doc_id FROM prints JOIN d USING (rid)),
f AS (SELECT h, min(doc_id) AS d0, arg_min(bef, doc_id) AS b0, arg_min(aft, doc_id) AS a0 FROM pd GROUP BY h),
runs AS (SELECT rid, a - ({_common("bef", "b0")}) AS a, z + {_common("aft", "a0")} AS z FROM pd JOIN f USING (h) WHERE doc_id > d0
  UNION ALL SELECT g.rid, g.i - 1, g.e - 1 FROM g JOIN (SELECT rid, g, arg_min(e, i) AS e0 FROM g GROUP BY ALL) o ON g.rid = o.rid AND g.g = o.g AND g.i >= o.e0),
gone AS (SELECT DISTINCT rid, unnest(range(a + 1, z + 1)) AS i FROM runs),
hit AS (SELECT DISTINCT rid FROM gone),
stay AS (SELECT rid, regexp_replace(string_agg(CASE WHEN i = 1 THEN lead ELSE '' END || piece, '' ORDER BY i), '{space}', '') AS text FROM l JOIN l1 USING (rid) JOIN hit USING (rid) ANTI JOIN gone USING (rid, i) GROUP BY rid)
SELECT o.doc_id, CASE WHEN hit.rid IS NULL THEN o.text ELSE stay.text END AS text, o.lang, o.source, CASE WHEN hit.rid IS NULL OR stay.text = o.text THEN o.n_chars ELSE length(stay.text) END AS n_chars
FROM documents o LEFT JOIN d ON o.doc_id = d.doc_id LEFT JOIN hit ON hit.rid = d.rid LEFT JOIN stay ON stay.rid = d.rid WHERE hit.rid IS NULL OR stay.rid IS NOT NULL"""


def decontamination() -> str:
    """Every place near a piece's is tried with every length; for items long enough for an edit, as all of the table are."""
    rate = decontamination_.MAX_ERROR_RATE
    norm = r"trim(regexp_replace(lower({x}), '[\t-\r\x1c-\x20\x{{85}}\x{{a0}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}]+', ' ', 'g'))"
    return f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {norm.format(x="text")} AS x FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
q AS (SELECT *, length(y) AS n, CAST(floor({rate}::DOUBLE * length(y)) AS BIGINT) AS k FROM (SELECT DISTINCT item_id, {norm.format(x="text")} AS y FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL)),
c AS (SELECT *, n * p // (k + 1) AS a, n * (p + 1) // (k + 1) AS z FROM q, LATERAL (SELECT unnest(range(0, k + 1)) AS p)),
hit AS (SELECT rid, doc_id, x, item_id, y, n, k, a, substr(y, a + 1, z - a) AS piece FROM d JOIN c ON contains(x, substr(y, a + 1, z - a)) WHERE k > 0),
places AS (SELECT DISTINCT rid, doc_id, x, item_id, y, n, k, unnest(list_filter(range(0, length(x) - length(piece) + 1), lambda i: substr(x, i + 1, length(piece)) = piece)) - a AS diagonal FROM hit),
s AS (SELECT DISTINCT rid, doc_id, x, item_id, y, n, k, unnest(range(diagonal - k, diagonal + k + 1)) AS s FROM places),
m AS (SELECT rid, doc_id, item_id, k, s, s + len AS e, levenshtein(substr(x, s + 1, len), y) AS dist FROM s, LATERAL (SELECT unnest(range(n - k, n + k + 1)) AS len) WHERE s >= 0 AND s + len <= length(x)),
best AS (SELECT *, row_number() OVER (PARTITION BY rid, item_id ORDER BY dist, e, s DESC) AS nth FROM m WHERE dist <= k)
SELECT doc_id, item_id, CAST(dist AS INTEGER) AS distance, s AS match_start, e AS match_end FROM best WHERE nth = 1"""
