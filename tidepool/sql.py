"""DuckDB SQL of the queries, written from the operators' definitions and not from their plans.

Parts that several queries share are common table expressions; `ctes` puts them before a query.
"""

from __future__ import annotations

from tidepool.operators.taxonomy import states
from tidepool.plans.reads import SHARES

_BASES = "translate({}, 'abcdefghijklmnopqrstuvwxyz', 'ACGTACGTACGTACGTACGTACGTAC')"
_LETTERS = "regexp_replace(lower(text), '[^a-z]', '', 'g')"


def rc(x: str) -> str:
    return f"reverse(translate(regexp_replace(upper({x}), '[^ACGT]', 'N', 'g'), 'ACGTN', 'TGCAN'))"


def _pieces(name: str, size: int) -> str:
    return f"""{name} AS (SELECT source AS sample, lang, doc_id, doc_id * 1000000 + k AS rec, substr(l, k * {size} + 1, {size}) AS raw
  FROM (SELECT source, lang, doc_id, l, unnest(range((length(l) + {size - 1}) // {size})) AS k FROM (SELECT *, {_LETTERS} AS l FROM documents)))"""


def _scored(name: str, source: str, offset: int, levels: int, raw: str = "raw", seq: str = _BASES.format("raw")) -> str:
    return f"""{name} AS (SELECT sample, rec, doc_id, {raw} AS raw, {seq} AS seq,
  list_transform(range(1, length({raw}) + 1), lambda i: {offset} + (ascii(substr({raw}, i, 1)) * 7 + i * 3 + doc_id) % {levels}) AS q FROM {source})"""


_SHARE = "CASE " + " ".join(f"WHEN l_partkey % 100 < {s} THEN {v}" for v, s in enumerate(SHARES)) + " END"
_CODE = "((CASE WHEN v < 11 THEN v WHEN i < 30 THEN 0 ELSE 1 END + 1) * (i + 1) * 2654435761 // 65536) % 4 + 1 + CASE WHEN i = wrong THEN 1 + o % 3 ELSE 0 END"

PARTS = {
    "p60": _pieces("p60", 60),
    "p100": _pieces("p100", 100),
    "p200": _pieces("p200", 200),
    "reads": _scored("reads", "p60", 0, 41),
    "good": _scored("good", "p60", 20, 21),
    "fwd": _scored("fwd", "(SELECT * FROM p100 WHERE length(raw) = 100)", 20, 21, "substr(raw, 1, 60)", _BASES.format("substr(raw, 1, 60)")),
    "rev": _scored("rev", "(SELECT * FROM p100 WHERE length(raw) = 100)", 20, 21, "reverse(substr(raw, 41, 60))", rc(_BASES.format("substr(raw, 41, 60)"))),
    "refs": f"refs AS (SELECT rec AS ref_idx, 'ref' || rec AS id, 'Bacteria;' || lang || ';' || sample || ';o' || doc_id % 7 || ';f' || doc_id % 11 || ';g' || doc_id % 13 || ';s' || doc_id % 17 AS description, {_BASES.format('raw')} AS seq FROM p200)",
    "items": f"items AS (SELECT item_id AS qid, {_LETTERS} AS raw, {_BASES.format(_LETTERS)} AS seq FROM benchmark)",
    "wins": "wins AS (SELECT item * 100000 + p AS qid, substr(seq, p + 1, 60) AS seq FROM (SELECT qid AS item, seq, unnest(range(length(seq) - 59)) AS p FROM items WHERE length(seq) >= 60))",
    "amp": f"""amp AS (SELECT sample, rec, array_to_string(list_transform(range(60), lambda i: substr('ACGTACGT', {_CODE}, 1)), '') AS seq,
  list_transform(range(60), lambda i: CASE WHEN i = wrong THEN 12 ELSE 30 + (i * 7 + o) % 8 END) AS q
  FROM (SELECT 's' || l_suppkey % 8 AS sample, (((l_orderkey * 8 + l_linenumber) * 1000000 + l_partkey) * 1000 + l_suppkey) * 64 + l_quantity::BIGINT AS rec, l_orderkey AS o, (l_orderkey * 31 + l_linenumber * 17) % 240 AS wrong, {_SHARE} AS v FROM lineitem))""",
    "uniq": "uniq AS (SELECT sample, seq, count(*) AS cnt FROM amp GROUP BY sample, seq)",
    # Transitions between neighbouring bases stand for evidence where only the fit is to be compared.
    "adj": "adj AS (SELECT t, o, q, count(*) AS n FROM (SELECT strpos('ACGT', substr(seq, i, 1)) - 1 AS t, strpos('ACGT', substr(seq, i + 1, 1)) - 1 AS o, q[i] AS q FROM (SELECT seq, q, unnest(range(1, length(seq))) AS i FROM reads)) GROUP BY t, o, q)",
    "grid": "grid AS (SELECT t, o, q FROM range(4) AS a(t), range(4) AS b(o), range(41) AS c(q))",
}
_NEEDS = {"reads": ["p60"], "good": ["p60"], "fwd": ["p100"], "rev": ["p100"], "refs": ["p200"], "wins": ["items"], "uniq": ["amp"], "adj": ["p60", "reads"]}


def ctes(*names: str, more: str = "") -> str:
    need: list[str] = []
    for n in names:
        need += [x for x in [*(y for d in _NEEDS.get(n, []) for y in [*_NEEDS.get(d, []), d]), n] if x not in need]
    return "WITH " + ",\n".join([*(PARTS[n] for n in dict.fromkeys(need)), *([more] if more else [])]) + "\n"


def first_low(q: str, at_most: int) -> str:
    return f"coalesce(nullif(list_position(list_transform({q}, lambda x: x <= {at_most}), true), 0) - 1, len({q}))"


def ee(q: str) -> str:
    return f"coalesce(list_sum(list_transform({q}, lambda x: pow(10.0, -x / 10.0))), 0)"


def ham(a: str, b: str) -> str:
    """Over strings of equal length, empty ones too."""
    return f"coalesce(list_sum(list_transform(range(1, length({a}) + 1), lambda h: CASE WHEN substr({a}, h, 1) <> substr({b}, h, 1) THEN 1 ELSE 0 END)), 0)"


def _paired(columns: str) -> str:
    side = lambda n, e: f"SELECT sample, rec, substr(seq, 1, n) AS seq, n >= 20 AND {ee('q[1:n]')} <= {e} AS ok FROM (SELECT *, {first_low('q', 2)} AS n FROM {n})"
    return ctes("fwd", "rev", more=f"f AS ({side('fwd', 2)}), r AS ({side('rev', 2.2)}), b AS (SELECT f.sample, f.rec, f.seq AS fwd_seq, r.seq AS rev_seq, f.ok AS f_ok, r.ok AS r_ok FROM f JOIN r USING (sample, rec))") + columns


def _lowess(kind: str) -> str:
    return f"""wt AS (SELECT t, q, sum(n) AS w FROM adj GROUP BY t, q),
pts AS (SELECT g.t, g.o, g.q, coalesce(w, 0) AS w, CASE WHEN coalesce(w, 0) > 0 THEN coalesce(n, 0) / w ELSE 0 END AS y FROM grid g LEFT JOIN wt USING (t, q) LEFT JOIN adj USING (t, o, q)),
edge AS (SELECT i, least(greatest(i - 19, 0) + 39, 41) AS hi FROM range(41) AS x(i)),
edges AS (SELECT i, greatest(hi - 39, 0) AS lo, hi, greatest(i - greatest(hi - 39, 0), hi - 1 - i, 1) AS far FROM edge),
sums AS (SELECT t, o, i, sum(k) AS sw, sum(k * q) AS sx, sum(k * y) AS sy, sum(k * q * q) AS sxx, sum(k * q * y) AS sxy FROM
  (SELECT p.t, p.o, e.i, p.q, p.y, w * pow(1 - pow(abs(p.q - e.i) / far, 3), 3) AS k FROM edges e JOIN pts p ON p.q >= lo AND p.q < hi AND abs(p.q - e.i) / far < 1) GROUP BY t, o, i),
line AS (SELECT t, o, i AS q, sy / sw AS my, sx / sw AS mx, sxx / sw - (sx / sw) * (sx / sw) AS v, sxy / sw - (sx / sw) * (sy / sw) AS c FROM sums WHERE sw > 0),
fit AS (SELECT p.t, p.o, p.q, CASE WHEN w = 0 THEN CASE WHEN p.t = p.o THEN 1 - pow(10.0, -p.q / 10.0) ELSE pow(10.0, -p.q / 10.0) / 3 END
  ELSE greatest(least(coalesce(my + CASE WHEN abs(v) < 1e-12 THEN 0 ELSE c / v END * (p.q - mx), y), 1), 1e-12) END AS p FROM pts p LEFT JOIN line USING (t, o, q)),
up AS (SELECT t, o, q, CASE WHEN t = o THEN max(p) OVER (PARTITION BY t, o ORDER BY q DESC) ELSE p END AS p FROM fit)
SELECT t, o, q, round(p / sum(p) OVER (PARTITION BY t, q), 6) AS p FROM up"""


_BINNED = """tot AS (SELECT q, sum(n) AS n, sum(n) FILTER (WHERE t <> o) AS off FROM adj GROUP BY q),
bin AS (SELECT q, greatest(least(coalesce(off, 0) / n / 3, 0.25), 1e-7) AS r FROM tot),
near AS (SELECT x.q, (SELECT max(q) FROM bin b WHERE b.q <= x.q) AS a, (SELECT min(q) FROM bin b WHERE b.q >= x.q) AS b FROM range(41) AS x(q)),
rate AS (SELECT n.q, CASE WHEN a IS NULL THEN y.r WHEN b IS NULL OR a = b THEN x.r ELSE x.r + (n.q - a) / (b - a) * (y.r - x.r) END AS r FROM near n LEFT JOIN bin x ON x.q = a LEFT JOIN bin y ON y.q = b),
raised AS (SELECT q, r, max(greatest(1 - 3 * r, 0.25)) OVER (ORDER BY q DESC) AS m FROM rate)
SELECT t, o, q, round(CASE WHEN t = o THEN m ELSE r END, 6) AS p FROM grid JOIN raised USING (q)"""


def _matrix(p: str) -> str:
    return ctes("grid") + f"SELECT t, o, q, round(CASE WHEN t = o THEN 1 - {p} ELSE {p} / 3 END, 9) AS p FROM grid"


_MISMATCH = """u AS MATERIALIZED (SELECT seq, cnt, list(s ORDER BY i) AS s FROM (SELECT seq, i, count(*) AS cnt, sum(q[i]) AS s FROM (SELECT seq, q, unnest(range(1, length(seq) + 1)) AS i FROM amp) GROUP BY seq, i) GROUP BY seq, cnt),
pr AS (SELECT a.seq AS p, b.seq AS c, least(a.cnt, b.cnt) AS w, b.cnt, b.s FROM u a JOIN u b ON length(a.seq) = length(b.seq) AND (a.cnt > b.cnt OR (a.cnt = b.cnt AND a.seq < b.seq)) WHERE hamming(a.seq, b.seq) BETWEEN 1 AND 8),
mis AS MATERIALIZED (SELECT strpos('ACGT', substr(p, i, 1)) - 1 AS t, strpos('ACGT', substr(c, i, 1)) - 1 AS o, least(floor(s[i] / cnt), 40)::INT AS q, sum(w) AS w FROM (SELECT *, unnest(list_filter(range(1, length(p) + 1), lambda i: substr(p, i::INT, 1) <> substr(c, i::INT, 1))) AS i FROM pr) GROUP BY ALL)"""

_OVERLAP = """f AS (SELECT sample, substr(seq, 1, 40) AS seq, count(*) AS n FROM amp GROUP BY ALL), r AS (SELECT sample, substr(seq, 21, 40) AS mate, count(*) AS n FROM amp GROUP BY ALL),
ov AS (SELECT f.sample, f.seq AS f, r.mate, f.n AS fn, r.n AS rn, k, hamming(right(f.seq, k), left(r.mate, k)) AS mm FROM f JOIN r ON f.sample = r.sample CROSS JOIN range(15, 41) AS x(k)
  WHERE substr(f.seq, 41 - k, 5) = substr(r.mate, 1, 5) OR substr(f.seq, 46 - k, 5) = substr(r.mate, 6, 5) OR substr(f.seq, 51 - k, 5) = substr(r.mate, 11, 5)),
best AS (SELECT * FROM ov WHERE mm <= 1 QUALIFY row_number() OVER (PARTITION BY sample, f, mate ORDER BY mm, k DESC) = 1)"""

_KMERS = "SELECT {id}, substr({seq}, i, 8) AS k FROM (SELECT *, unnest(range(1, length({seq}) - 6)) AS i FROM {t})"

_LEVELS = ("kingdom", "phylum", "class", "order_", "family", "genus", "species")

_BEST = """rk AS (SELECT DISTINCT ref_idx, k FROM (""" + _KMERS.format(id="ref_idx", seq="seq", t="refs") + """)),
qk AS (SELECT qid, list(k ORDER BY i) AS ks FROM (SELECT qid, i, substr(seq, i, 8) AS k FROM (SELECT *, unnest(range(1, length(seq) - 6)) AS i FROM items)) GROUP BY qid),
q1 AS (SELECT DISTINCT qid, unnest(ks) AS k FROM qk),
sc AS (SELECT qid, ref_idx, count(*) AS score FROM q1 JOIN rk USING (k) GROUP BY ALL),
top AS (SELECT qid, ref_idx, score FROM sc QUALIFY row_number() OVER (PARTITION BY qid ORDER BY score DESC, ref_idx DESC) = 1)"""


def _bootstrap() -> str:
    seeds = ", ".join(f"({r}, {s}::HUGEINT)" for r, s in enumerate(states(42)))
    return f"""{_BEST},
seeds(rep, s) AS (VALUES {seeds}),
draw AS (SELECT DISTINCT qid, rep, ks[((s // (1::HUGEINT << i)) % len(ks))::BIGINT + 1] AS k FROM qk, seeds, range(8) AS x(i) WHERE i < greatest(len(ks) // 8, 1)),
bs AS (SELECT qid, rep, ref_idx, count(*) AS score FROM draw JOIN rk USING (k) GROUP BY ALL),
bt AS (SELECT qid, rep, ref_idx FROM bs QUALIFY row_number() OVER (PARTITION BY qid, rep ORDER BY score DESC, ref_idx DESC) = 1),
ba AS (SELECT d.qid, d.rep, coalesce(bt.ref_idx, (SELECT max(ref_idx) FROM refs)) AS ref_idx FROM (SELECT DISTINCT qid, rep FROM draw) d LEFT JOIN bt USING (qid, rep)),
ln AS (SELECT ref_idx, string_split(description, ';') AS l FROM refs),
bo AS (SELECT i.qid, t.ref_idx, a.l, list_transform(range(1, 8), lambda j: 0.0) AS z, b.l AS o FROM items i JOIN top t USING (qid) JOIN ln a USING (ref_idx) JOIN ba ON ba.qid = i.qid JOIN ln b ON b.ref_idx = ba.ref_idx),
sh AS (SELECT qid, ref_idx, any_value(l) AS l, {", ".join(f"count(*) FILTER (WHERE l[{j}] = o[{j}] AND l[{j}] <> '') / 100.0 AS b{j}" for j in range(1, 8))} FROM bo GROUP BY qid, ref_idx)"""


def _turned() -> str:
    """The bootstrap of both directions of every query, as queries of their own: 2 * qid + turned."""
    own = f"own AS (SELECT qid, CASE WHEN qid % 2 = 0 THEN {rc('seq')} ELSE seq END AS seq FROM items), both_ AS (SELECT qid * 2 AS qid, seq FROM own UNION ALL SELECT qid * 2 + 1, {rc('seq')} FROM own)"
    return f"{own},\n{_bootstrap().replace('FROM items', 'FROM both_')},\nsh2 AS (SELECT *, qid % 2 AS turned, qid // 2 AS q FROM sh)"


_SPECIES = "sr AS (SELECT DISTINCT seq, genus, species FROM (SELECT seq, lang AS genus, sample AS species FROM sp UNION ALL SELECT " + rc("seq") + ", lang, sample FROM sp))"
_SPREFS = f"sp AS (SELECT {_BASES.format('raw')} AS seq, lang, sample FROM p60 WHERE length(raw) = 60)"
_HITS = "ex AS (SELECT DISTINCT qid, genus, species FROM wins JOIN sr USING (seq))"
_NEAR = "nr AS (SELECT DISTINCT qid, genus, species FROM (SELECT * FROM wins WHERE qid NOT IN (SELECT qid FROM ex)) w JOIN sr ON (substr(w.seq, 1, 20) = substr(sr.seq, 1, 20) OR substr(w.seq, 21, 20) = substr(sr.seq, 21, 20) OR substr(w.seq, 41, 20) = substr(sr.seq, 41, 20)) WHERE hamming(w.seq, sr.seq) <= 2)"


def _summary(hits: str, multiple: bool) -> str:
    some = "true" if multiple else "n = 1"
    return f"SELECT w.qid, CASE WHEN {some} AND len(gs) = 1 THEN gs[1] END AS genus, CASE WHEN {some} THEN array_to_string(ss, '/') END AS species FROM wins w LEFT JOIN (SELECT qid, count(*) AS n, list_sort(list(DISTINCT genus)) AS gs, list_sort(list(DISTINCT species)) AS ss FROM {hits} GROUP BY qid) h USING (qid)"


def _chimeras(rows: str) -> str:
    lcp = "coalesce((SELECT min(i) FROM range(60) AS z(i) WHERE substr(c.seq, i + 1, 1) <> substr(p.seq, i + 1, 1)), -1)"
    return f"""r AS ({rows}),
left_ AS (SELECT c.g, c.seq, c.n, p.seq AS p1, {lcp} AS x FROM r c JOIN r p ON c.g = p.g AND p.n > c.n WHERE substr(c.seq, 1, 8) = substr(p.seq, 1, 8)),
bad AS (SELECT DISTINCT l.g, l.seq FROM left_ l JOIN r p ON l.g = p.g AND p.n > l.n AND p.seq <> l.p1 WHERE x >= 8 AND 60 - x >= 8 AND substr(l.seq, x::INT + 1) = substr(p.seq, x::INT + 1))
"""


def _platform(name: str, offset: int, levels: int) -> str:
    return f"""SELECT *, CASE WHEN mean_q >= 35 AND distinct_q <= 8 THEN 'pacbio' WHEN distinct_q <= 12 THEN 'binned' ELSE 'loess' END AS kind FROM (
  SELECT '{name}' AS profile, count(DISTINCT v) AS distinct_q, round(avg(v), 6) AS mean_q, max(v) AS max_q, round((SELECT avg(length(raw)) FROM p60), 6) AS mean_len
  FROM (SELECT {offset} + (ascii(substr(raw, i, 1)) * 7 + i * 3 + doc_id) % {levels} AS v FROM (SELECT raw, doc_id, unnest(range(1, length(raw) + 1)) AS i FROM p60)))"""


ORACLES: dict[str, str] = {
    "quality_profile": ctes("reads") + """SELECT sample, cycle, round(avg(v), 6) AS mean, quantile_disc(v, 0.25) AS p25, quantile_disc(v, 0.5) AS p50, quantile_disc(v, 0.75) AS p75, count(*) AS cnt
FROM (SELECT sample, cycle, least(q[cycle + 1], 41) AS v FROM (SELECT *, unnest(range(len(q))) AS cycle FROM reads)) GROUP BY sample, cycle""",
    "platform_detect": ctes("p60") + " UNION ALL ".join(_platform(*x) for x in (("full", 0, 41), ("binned", 20, 10), ("fine", 36, 5))),
    "filter_single": ctes("reads") + f"SELECT sample, rec, substr(seq, 1, n) AS seq, round(e, 6) AS ee FROM (SELECT *, {ee('q[1:n]')} AS e FROM (SELECT *, {first_low('q', 2)} AS n FROM reads)) WHERE n >= 20 AND e <= 8",
    "filter_trimmed": ctes("good") + f"SELECT sample, rec, substr(seq, 6, 40) AS seq, round(e, 6) AS ee FROM (SELECT *, {ee('q[6:45]')} AS e, {first_low('q[6:len(q) - 3]', 2)} AS n FROM good WHERE length(seq) > 8) WHERE n >= 40 AND e <= 0.2",
    "filter_stats": ctes("reads") + f"SELECT sample, count(*) AS reads_in, count(*) FILTER (WHERE n >= 20 AND {ee('q[1:n]')} <= 8) AS reads_out FROM (SELECT *, {first_low('q', 2)} AS n FROM reads) GROUP BY sample",
    "filter_paired": _paired("SELECT sample, rec, fwd_seq, rev_seq FROM b WHERE f_ok AND r_ok"),
    "filter_paired_stats": _paired("SELECT sample, count(*) AS reads_in, count(*) FILTER (WHERE f_ok AND r_ok) AS pairs_out, count(*) FILTER (WHERE NOT f_ok AND r_ok) AS fwd_failed, count(*) FILTER (WHERE f_ok AND NOT r_ok) AS rev_failed, count(*) FILTER (WHERE NOT f_ok AND NOT r_ok) AS both_failed FROM b GROUP BY sample"),
    "primer_trim": ctes("reads") + f"""SELECT sample, rec, substr(seq, a::INT + 1, (z - a)::INT) AS seq FROM (
  SELECT *, (list_filter(range(least(9, length(seq)) - 3 + 1), lambda i: {ham('substr(seq, i + 1, least(4, least(9, length(seq)) - i))', "substr('TTAC', 1, least(4, least(9, length(seq)) - i))")} <= 1))[1] AS s,
    s + least(4, least(9, length(seq)) - s) AS a, (list_filter(range(greatest(length(seq) - 8, 0), length(seq) - 3 + 1), lambda i: {ham('substr(seq, i + 1, least(3, length(seq) - i))', "substr('GTA', 1, least(3, length(seq) - i))")} <= 1))[1] AS z
  FROM reads WHERE length(seq) >= 3) WHERE a < z""",
    "reverse_complement": ctes("p60") + f"SELECT rec, {rc('raw')} AS rc FROM p60",
    "sequence_functions": ctes("reads", more=f"x AS (SELECT *, reverse(seq) AS back FROM reads)") + f"""SELECT rec, {ham('seq', 'back')}::INT AS hamming, (SELECT min(i) FROM range(60) AS z(i) WHERE i < length(seq) AND substr(seq, i + 1, 1) <> substr(back, i + 1, 1))::INT AS first_mismatch,
  substr(seq, 6, greatest(least(15, length(seq)) - 5, 0)) = substr(back, 6, greatest(least(15, length(seq)) - 5, 0)) AS range_equal, round(list_avg(q), 6) AS mean_quality,
  coalesce(list_bool_or(list_transform(range(1, len(q) - 8), lambda i: list_sum(q[i:i + 9]) < 150)), false) AS low_window, strpos('ACGT', substr(seq, 1, 1)) - 1 AS base_index, lower(hex(seq)) AS asv FROM x""",
    "kmer_profile": ctes("p60", more=f"s AS (SELECT rec, {_BASES.format('raw')} AS seq FROM p60)") + f"SELECT k AS kmer, count(*) AS n FROM ({_KMERS.format(id='rec', seq='seq', t='s')}) GROUP BY k",
    "derep": ctes("p60") + f"SELECT sample, {_BASES.format('raw')} AS seq, count(*) AS cnt FROM p60 GROUP BY ALL",
    "derep_qual_sum": ctes("amp") + "SELECT sample, seq, i - 1 AS at, sum(q[i])::BIGINT AS qual_sum, count(*) AS cnt FROM (SELECT *, unnest(range(1, 61)) AS i FROM amp) GROUP BY sample, seq, i",
    "match_counts": ctes("reads") + "SELECT strpos('ACGT', substr(seq, i, 1)) - 1 AS b, least(q[i], 40) AS q, count(*) AS n FROM (SELECT seq, q, unnest(range(1, length(seq) + 1)) AS i FROM reads) GROUP BY ALL",
    "mismatch_counts": ctes("amp", more=_MISMATCH) + "SELECT t, o, q, w::BIGINT AS w FROM mis",
    "transition_counts": ctes("amp", more=_MISMATCH) + """SELECT t, o, q, n FROM (
  SELECT t, t AS o, q, greatest(sum(n), 0)::BIGINT AS n FROM (SELECT strpos('ACGT', substr(seq, i, 1)) - 1 AS t, least(q[i], 40) AS q, 1 AS n FROM (SELECT seq, q, unnest(range(1, 61)) AS i FROM amp) UNION ALL SELECT o, q, -w FROM mis) GROUP BY t, q
  UNION ALL SELECT t, o, q, w::BIGINT FROM mis)""",
    "lowess_fit": ctes("adj", "grid", more=_lowess("loess")),
    "binned_fit": ctes("adj", "grid", more="few AS (SELECT t, o, least(q - q % 5 + 2, 37) AS q, n FROM adj),\n" + _BINNED.replace("FROM adj", "FROM few")),
    "pacbio_matrix": _matrix("least(greatest(pow(10.0, -q / 10.0), 1e-6), 0.5)"),
    "illumina_default": _matrix("pow(10.0, -q / 10.0)"),
    "plot_errors": "SELECT q::INT AS q, round(pow(10.0, -q / 10.0) / 3, 9) AS rate FROM range(41) AS x(q)",
    "denoise_many_reads": "SELECT 's' || l_suppkey % 8 AS sample, count(*) AS reads FROM lineitem GROUP BY ALL",
    "denoise_pseudo_reads": "SELECT 's' || l_suppkey % 8 AS sample, count(*) AS reads FROM lineitem GROUP BY ALL",
    "pool_accumulate": ctes("amp") + """, s AS (SELECT seq, sum(q1) AS q1 FROM (SELECT seq, list_sum(q) AS q1 FROM amp) GROUP BY seq)
SELECT seq, sum(cnt)::BIGINT AS cnt, string_agg(sample || ':' || cnt, ',' ORDER BY sample) AS per_sample, any_value(q1)::BIGINT AS qual_total FROM (SELECT sample, seq, count(*) AS cnt FROM amp GROUP BY ALL) JOIN s USING (seq) GROUP BY seq""",
    "merge_pairs": ctes("amp", more=_OVERLAP) + "SELECT sample, f || substr(mate, k::INT + 1) AS seq, least(fn, rn) AS abundance, k::INT AS overlap, mm::INT AS mismatches FROM best",
    "just_concatenate": ctes("amp", more=_OVERLAP) + "SELECT sample, f || mate AS seq, least(fn, rn) AS abundance FROM best",
    "chimera": ctes("uniq", more=_chimeras("SELECT sample AS g, seq, cnt AS n FROM uniq")) + "SELECT g AS sample, seq, n AS abundance FROM r WHERE (g, seq) NOT IN (SELECT (g, seq) FROM bad)",
    "chimera_mask": ctes("uniq", more=_chimeras("SELECT 1 AS g, seq, sum(cnt) AS n FROM uniq GROUP BY seq")) + "SELECT seq, seq IN (SELECT seq FROM bad) AS is_chimera FROM r",
    "taxonomy_best": ctes("refs", "items", more=_BEST) + "SELECT i.qid, coalesce(ref_idx, (SELECT max(ref_idx) FROM refs)) AS ref_idx, coalesce(score, 0) AS score FROM items i LEFT JOIN top USING (qid)",
    "taxonomy_bootstrap": ctes("refs", "items", more=_bootstrap()) + "SELECT qid, " + ", ".join(f"CASE WHEN b{j} >= 0.5 THEN l[{j}] END AS {n}" for j, n in enumerate(("kingdom", "phylum", "class", "\"order\"", "family", "genus"), 1)).replace('"order"', "order_") + ", round(b6, 6) AS confidence FROM sh",
    "taxonomy_try_rc": ctes("refs", "items", more=_turned()) + "SELECT q AS qid, " + ", ".join(f"CASE WHEN b{j} >= 0.5 AND l[{j}] NOT IN ('', 'NA') THEN l[{j}] END AS {n}" for j, n in enumerate(_LEVELS[:6], 1)) + ", NULL AS species, " + ", ".join(f"round(100 * b{j}, 6) AS {n.rstrip('_')}_boot" for j, n in enumerate(_LEVELS, 1)) + " FROM sh2 QUALIFY row_number() OVER (PARTITION BY q ORDER BY b6 DESC, turned) = 1",
    "species_exact": ctes("p60", "wins", more=f"{_SPREFS}, {_SPECIES}, {_HITS}") + _summary("ex", False),
    "species_hamming": ctes("p60", "wins", more=f"{_SPREFS}, {_SPECIES}, {_HITS}, {_NEAR}") + _summary("(SELECT * FROM ex UNION ALL SELECT * FROM nr)", True),
    "add_species": ctes("p60", "wins", more=f"{_SPREFS}, {_SPECIES}, {_HITS}, sx AS ({_summary('ex', False)})") + "SELECT t.qid, t.genus, CASE WHEN t.genus IS NULL OR sx.genus IS NULL OR t.genus = sx.genus THEN sx.species END AS species FROM (SELECT qid, CASE WHEN qid % 3 = 0 THEN NULL WHEN qid % 3 = 1 THEN 'en' ELSE 'fr' END AS genus FROM wins) t LEFT JOIN sx USING (qid)",
    "sequence_table_long": ctes("uniq") + "SELECT sample, lower(hex(seq)) AS asv, cnt FROM uniq",
    "sequence_table_columns": ctes("uniq") + "SELECT seq, sum(cnt)::BIGINT AS total, row_number() OVER (ORDER BY sum(cnt) DESC, seq) AS place FROM uniq GROUP BY seq",
    "sequence_table_overwrite": ctes("amp") + "SELECT sample, left(seq, 30) AS seq, arg_max(cnt, seq) AS cnt FROM (SELECT sample, seq, count(*) AS cnt FROM amp GROUP BY ALL) GROUP BY ALL",
    "merge_sequence_tables": ctes("amp", more=f"a AS (SELECT sample, seq, count(*) AS cnt FROM amp GROUP BY ALL), b AS (SELECT 'x' || sample AS sample, {rc('seq')} AS seq, cnt FROM a)") + "SELECT sample, seq, sum(cnt)::BIGINT AS cnt FROM (SELECT * FROM a UNION ALL SELECT b.sample, coalesce(n.seq, b.seq), cnt FROM b LEFT JOIN (SELECT DISTINCT seq, " + rc("seq") + " AS back FROM a) n ON n.back = b.seq) GROUP BY ALL",
    "uniques_fasta": ctes("amp") + "SELECT rank, '>seq' || rank || ';size=' || cnt || ';' || chr(10) || substr(seq, 1, 40) || chr(10) || substr(seq, 41) AS value FROM (SELECT seq, count(*) AS cnt, row_number() OVER (ORDER BY count(*) DESC, seq) AS rank FROM amp GROUP BY seq)",
    "sequence_table_tsv": ctes("amp", more="u AS (SELECT sample, left(seq, 12) AS seq, count(*) AS cnt FROM amp GROUP BY ALL), o AS (SELECT seq, row_number() OVER (ORDER BY sum(cnt) DESC, seq) AS p FROM u GROUP BY seq)") + "SELECT 0 AS place, 'sample' || chr(9) || string_agg(lower(hex(seq)), chr(9) ORDER BY p) AS value FROM o UNION ALL SELECT row_number() OVER (ORDER BY sample), sample || chr(9) || string_agg(coalesce(cnt, 0)::VARCHAR, chr(9) ORDER BY p) FROM (SELECT s.sample, o.seq, o.p, u.cnt FROM (SELECT DISTINCT sample FROM u) s CROSS JOIN o LEFT JOIN u ON u.sample = s.sample AND u.seq = o.seq) GROUP BY sample",
    "fastq_lines": ctes("reads") + "SELECT rec, '@r' || rec || chr(10) || seq || chr(10) || '+' || chr(10) || array_to_string(list_transform(q, lambda x: chr((x + 33)::INT)), '') AS value FROM reads",
    "lineage": ctes("refs") + "SELECT id, array_to_string(list_transform(string_split(description, ';'), lambda x: trim(x)), '|') AS lineage FROM refs",
    "first_reads": ctes("amp", more="z AS (SELECT sample, rec, row_number() OVER (ORDER BY sample, rec) AS r FROM amp)") + "SELECT sample, rec FROM z WHERE r <= 20000",
}


# Denoising. One pass over a group's sequences in order: a step adds the next centre of every group and brings
# all scores up to date. A second pass would find nothing more here, as scores only rise with more centres.

_ILLUMINA = "SELECT t, o, q, CASE WHEN t = o THEN 1 - pow(10.0, -q / 10.0) ELSE pow(10.0, -q / 10.0) / 3 END AS p FROM grid"


def _uniques(name: str, source: str, size: int) -> str:
    """(g, seq, cnt, q): distinct sequences of rows (g, seq, q), with their mean scores cut to whole numbers."""
    return f"""{name} AS (SELECT g, seq, cnt, list(least(floor(s / cnt), 40)::INT ORDER BY i) AS q FROM (SELECT g, seq, i, count(*) AS cnt, sum(q[i]) AS s FROM (SELECT g, seq, q, unnest(range(1, {size + 1})) AS i FROM {source}) GROUP BY g, seq, i) GROUP BY g, seq, cnt)"""


def _denoised(n: str, uniques: str, model: str, prior: str = "false") -> str:
    """Tables that end in {n}a (g, seq, centre, cnt)."""
    log_p = """CASE WHEN ll < ln(1e-14) THEN cnt * ll - CASE WHEN cnt <= 20 THEN ln(factorial(cnt::INT)::DOUBLE) ELSE cnt * ln(cnt) - cnt + 0.5 * ln(2 * pi() * cnt) END
    WHEN cnt <= exp(ll) THEN 0 WHEN cnt * ll - exp(ll) - lgamma(cnt + 1) >= ln(1e-40) THEN 0
    ELSE cnt * ll - exp(ll) - lgamma(cnt + 1) + ln(list_sum(list_transform(range(200), lambda j: exp(j * ll - lgamma(cnt + 1 + j) + lgamma(cnt + 1))))) END < ln(1e-40)"""
    return f"""{n}u AS MATERIALIZED (SELECT g, row_number() OVER (PARTITION BY g ORDER BY cnt DESC, seq) AS rk, seq, cnt, q, ({prior}) AS prior FROM {uniques}),
{n}t AS MATERIALIZED (SELECT g, ln(sum(cnt)) AS lt FROM {n}u GROUP BY g),
{n}e AS MATERIALIZED (SELECT g, rk, i, greatest(strpos('ACGT', substr(seq, i::INT, 1)) - 1, 0) AS c, greatest(strpos('ACGT', substr(seq, i::INT, 1)) - 1, 0) * 41 + q[i] AS k FROM (SELECT *, unnest(range(1, length(seq) + 1)) AS i FROM {n}u)),
{n}m AS MATERIALIZED (SELECT t, o * 41 + q AS k, ln(greatest(p, 1e-300))::FLOAT::DOUBLE AS lp FROM ({model})),
{n}w(g, rk, score, best, newest) AS (
  SELECT e.g, e.rk, sum(lp), 1::BIGINT, 1::BIGINT FROM {n}e e JOIN {n}e c ON c.g = e.g AND c.i = e.i AND c.rk = 1 JOIN {n}m m ON m.t = c.c AND m.k = e.k GROUP BY e.g, e.rk
  UNION ALL
  (WITH cand AS MATERIALIZED (SELECT g, rk, best, score, cnt, prior, lt FROM (SELECT w.*, u.cnt, u.prior, t.lt, t.lt + w.score AS ll FROM {n}w w JOIN {n}u u USING (g, rk) JOIN {n}t t USING (g) WHERE rk > newest) WHERE prior OR {log_p}),
  bl AS MATERIALIZED (SELECT x.g, x.best, e.i, e.c FROM (SELECT DISTINCT g, best FROM cand) x JOIN {n}e e ON e.g = x.g AND e.rk = x.best),
  dl AS MATERIALIZED (SELECT d.g, d.rk, d.best, e.i, e.k FROM cand d JOIN {n}e e ON e.g = d.g AND e.rk = d.rk),
  moved AS (SELECT d.g, d.rk, d.i, m0.lp AS same, m1.lp AS put, m2.lp AS cut FROM dl d
    JOIN bl c0 ON c0.g = d.g AND c0.best = d.best AND c0.i = d.i JOIN {n}m m0 ON m0.t = c0.c AND m0.k = d.k
    LEFT JOIN bl c1 ON c1.g = d.g AND c1.best = d.best AND c1.i = d.i - 1 LEFT JOIN {n}m m1 ON m1.t = c1.c AND m1.k = d.k
    LEFT JOIN bl c2 ON c2.g = d.g AND c2.best = d.best AND c2.i = d.i + 1 LEFT JOIN {n}m m2 ON m2.t = c2.c AND m2.k = d.k),
  gaps AS (SELECT g, rk, max(pre + ln(1e-3) + greatest(put, cut)) AS gap FROM (SELECT g, rk, coalesce(sum(same) OVER (PARTITION BY g, rk ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pre,
    coalesce(sum(put) OVER (PARTITION BY g, rk ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0) AS put, coalesce(sum(cut) OVER (PARTITION BY g, rk ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0) AS cut FROM moved) GROUP BY g, rk),
  nx AS (SELECT g, min(rk) AS c FROM (SELECT g, rk, cnt, prior, lt + greatest(score, gap) AS ll FROM cand JOIN gaps USING (g, rk)) WHERE prior OR {log_p} GROUP BY g),
  cl AS MATERIALIZED (SELECT nx.g, nx.c AS newest, e.i, e.c FROM nx JOIN {n}e e ON e.g = nx.g AND e.rk = nx.c),
  s AS (SELECT e.g, e.rk, cl.newest AS c, sum(lp) AS s FROM {n}e e JOIN cl ON e.g = cl.g AND e.i = cl.i JOIN {n}m m ON m.t = cl.c AND m.k = e.k GROUP BY e.g, e.rk, cl.newest)
  SELECT g, rk, greatest(w.score, s.s), CASE WHEN s.s >= w.score THEN s.c ELSE w.best END, s.c FROM {n}w w JOIN s USING (g, rk))
),
{n}a AS MATERIALIZED (SELECT u.g, u.seq, c.seq AS centre, u.cnt FROM (SELECT * FROM {n}w QUALIFY newest = max(newest) OVER (PARTITION BY g)) f JOIN {n}u u USING (g, rk) JOIN {n}u c ON c.g = f.g AND c.rk = f.best)"""


def _recursive(text: str) -> str:
    return text.replace("WITH ", "WITH RECURSIVE ", 1)


_AMP = "src AS (SELECT sample AS g, seq, q FROM amp)"
_VARIANTS = "SELECT g AS sample, centre AS seq, sum(cnt)::BIGINT AS abundance FROM {} GROUP BY ALL"

#: The fit for scores of few levels, from transition counts tc (t, o, q, n).
_TRANSITIONS = """tc AS MATERIALIZED (SELECT t, t AS o, q, greatest(sum(n), 0) AS n FROM (SELECT strpos('ACGT', substr(seq, i, 1)) - 1 AS t, least(q[i], 40) AS q, 1 AS n FROM (SELECT seq, q, unnest(range(1, length(seq) + 1)) AS i FROM amp) UNION ALL SELECT o, q, -w FROM mis) GROUP BY t, q
  UNION ALL SELECT t, o, q, w FROM mis)"""
_LEARNED = _BINNED.replace("FROM adj", "FROM tc").replace("\nSELECT t, o, q, round(", ",\nlearned AS MATERIALIZED (SELECT t, o, q, (").replace(", 6) AS p FROM grid", ") AS p FROM grid") + ")"


def _learning(reads: str) -> str:
    """learned (t, o, q, p) from rows (seq, q), whose scores have few levels."""
    return f"{_MISMATCH},\n{_TRANSITIONS},\n{_LEARNED}".replace("FROM amp", f"FROM {reads}")


def _pipeline_single() -> str:
    rows = "SELECT 1 AS g, centre AS seq, sum(cnt) AS n FROM da GROUP BY centre"
    return ctes("grid", "amp", more=f"{_learning('amp')}, {_AMP}, {_uniques('du0', 'src', 60)}, {_denoised('d', 'du0', 'SELECT * FROM learned')}, {_chimeras(rows)}") + "SELECT seq, n::BIGINT AS abundance FROM r WHERE seq NOT IN (SELECT seq FROM bad)"


def _pipeline_samples() -> str:
    fwd = "fsrc AS (SELECT sample AS g, substr(seq, 1, 40) AS seq, q[1:40] AS q FROM amp)"
    rev = f"rsrc AS (SELECT sample AS g, {rc('substr(seq, 21, 40)')} AS seq, list_reverse(q[21:60]) AS q FROM amp)"
    merged = f"""f AS (SELECT g, centre AS seq, sum(cnt) AS n FROM fa GROUP BY ALL), v AS (SELECT g, {rc('centre')} AS mate, sum(cnt) AS n FROM va GROUP BY ALL),
ov AS (SELECT f.g, f.seq AS f, v.mate, least(f.n, v.n) AS n, k FROM f JOIN v USING (g) CROSS JOIN range(20, 41) AS x(k) WHERE right(f.seq, k) = left(v.mate, k)),
mg AS (SELECT g, f || substr(mate, max(k)::INT + 1) AS seq, n FROM ov GROUP BY g, f, mate, n)"""
    lcp = _chimeras("SELECT g, seq, sum(n) AS n FROM mg GROUP BY ALL")
    return ctes("grid", "amp", more=f"{fwd}, {rev}, {_learning('fsrc')}, {_uniques('fu0', 'fsrc', 40)}, {_uniques('vu0', 'rsrc', 40)}, {_denoised('f', 'fu0', 'SELECT * FROM learned')}, {_denoised('v', 'vu0', 'SELECT * FROM learned')}, {merged}, {lcp}") + "SELECT g AS sample, seq, n::BIGINT AS abundance FROM r WHERE (g, seq) NOT IN (SELECT (g, seq) FROM bad)"


#: Rows of sigmoid(a + b q), climbed for 16 rounds; a round's state is a row for each of the 16 directions.
_LOGISTIC = """cell AS MATERIALIZED (SELECT t, o, q, coalesce(n, 0) AS n FROM grid LEFT JOIN adj USING (t, o, q)),
climb(i, t, o, a, b, before, done) AS (
  SELECT 0, t, o, CASE WHEN t = o THEN 5.0 ELSE -5.0 END::DOUBLE, CASE WHEN t = o THEN -0.3 ELSE 0.1 END::DOUBLE, '-Infinity'::DOUBLE, sum(n) = 0 FROM cell GROUP BY t, o
  UNION ALL
  SELECT i + 1, t, o, a + 1e-3 * sum(n * (1 - p)), b + 1e-3 * sum(n * (1 - p) * q), sum(n * ln(greatest(p, 1e-300))), abs(sum(n * ln(greatest(p, 1e-300))) - before) < 1e-6
  FROM (SELECT climb.*, q, n, 1 / (1 + exp(-greatest(least(a + b * q, 700), -700))) AS p FROM climb JOIN cell USING (t, o) WHERE i < 16 AND NOT done) GROUP BY i, t, o, a, b, before)
SELECT t, o, q, round(1 / (1 + exp(-greatest(least(a + b * q, 700), -700))), 6) AS p FROM cell JOIN (SELECT * FROM climb QUALIFY i = max(i) OVER (PARTITION BY t, o)) USING (t, o)"""

_POOLED = "src AS (SELECT 'all' AS g, seq, q FROM amp), own AS (SELECT sample, seq, count(*) AS cnt FROM amp GROUP BY ALL), whole AS (SELECT seq, count(*) AS cnt FROM amp GROUP BY seq)"

ORACLES |= {
    "denoise_many": _recursive(ctes("grid", "amp", more=f"{_AMP}, {_uniques('du0', 'src', 60)}, {_denoised('d', 'du0', _ILLUMINA)}")) + _VARIANTS.format("da"),
    "denoise_pseudo": _recursive(ctes("grid", "amp", more=f"{_AMP}, {_uniques('du0', 'src', 60)}, {_denoised('d', 'du0', _ILLUMINA)}, {_denoised('z', 'du0', _ILLUMINA, 'seq IN (SELECT centre FROM da)')}")) + _VARIANTS.format("za"),
    "denoise_pooled": _recursive(ctes("grid", "amp", more=f"{_POOLED}, {_uniques('du0', 'src', 60)}, {_denoised('d', 'du0', _ILLUMINA)}"))
    + "SELECT sample, seq, abundance FROM (SELECT own.sample, own.seq, round(v.n * own.cnt / whole.cnt)::BIGINT AS abundance FROM (SELECT centre AS seq, sum(cnt) AS n FROM da GROUP BY ALL) v JOIN own USING (seq) JOIN whole USING (seq)) WHERE abundance > 0",
    "learn_errors": ctes("grid", "amp", more=_learning("amp")) + "SELECT t, o, q, round(p, 6) AS p FROM learned",
    "logistic_fit": _recursive(ctes("adj", "grid", more=_LOGISTIC)),
    "run_pipeline": _recursive(_pipeline_single()),
    "run_pipeline_samples": _recursive(_pipeline_samples()),
}

_QUALITIES = "array_to_string(list_transform(q, lambda x: chr((x + 33)::INT)), '')"
_LOG = "ln(greatest(CASE WHEN substr(seq, length(seq) + 1 - i, 1) = substr(seq, i, 1) THEN 1 - pow(10.0, -least(q[i], 40) / 10.0) ELSE pow(10.0, -least(q[i], 40) / 10.0) / 3 END, 1e-300))"
_START = f"(list_filter(range(least(11, length(seq)) - 4 + 1), lambda i: {ham('substr(seq, i + 1, least(6, least(11, length(seq)) - i))', "substr('TTACGT', 1, least(6, least(11, length(seq)) - i))")} <= 2))[1]"
_TABLE = "u AS (SELECT sample, left(seq, 12) AS seq, count(*) AS cnt FROM amp GROUP BY ALL), o AS (SELECT seq, row_number() OVER (ORDER BY sum(cnt) DESC, seq) AS p FROM u GROUP BY seq), s AS (SELECT DISTINCT sample FROM u UNION ALL SELECT 'empty')"

ORACLES |= {
    "fastq_files": ctes("reads") + f"SELECT 'r' || rec AS id, seq, {_QUALITIES} AS qual FROM reads",
    "fastq_gzip": ctes("reads") + f"SELECT 'r' || rec AS id, seq, {_QUALITIES} AS qual FROM reads",
    "fastq_first": ctes("reads") + "SELECT row_number() OVER (ORDER BY rec) - 1 AS rec, 'r' || rec AS id, seq FROM reads QUALIFY row_number() OVER (ORDER BY rec) <= 500",
    "fasta_files": ctes("amp") + "SELECT 'seq' || row_number() OVER (ORDER BY count(*) DESC, seq) || ';size=' || count(*) || ';' AS id, NULL AS description, seq FROM amp GROUP BY seq",
    "lineage_file": ORACLES["lineage"],
    "lineage_described": ctes("refs") + "SELECT id, array_to_string(list_transform(string_split(description, ';'), lambda x: trim(x)), '|') AS lineage FROM refs WHERE ref_idx % 3 > 0",
    "sequence_table_json": ctes("amp", more=_TABLE) + """SELECT '{"samples":["' || (SELECT string_agg(sample, '","' ORDER BY sample) FROM s) || '"],"sequences":["' || (SELECT string_agg(lower(hex(seq)), '","' ORDER BY p) FROM o) || '"],"counts":['
  || (SELECT string_agg(line, ',' ORDER BY sample) FROM (SELECT s.sample, '[' || string_agg(coalesce(cnt, 0)::VARCHAR, ',' ORDER BY p) || ']' AS line FROM s CROSS JOIN o LEFT JOIN u ON u.sample = s.sample AND u.seq = o.seq GROUP BY s.sample)) || ']}' AS value""",
    "sequence_table_empty": "SELECT sample, CASE WHEN sample = 's3' THEN 0 ELSE n END AS total FROM (SELECT 's' || l_suppkey % 8 AS sample, count(*) AS n FROM lineitem GROUP BY ALL)",
    "model_file": ctes("grid") + "SELECT (t * 4 + o) * 41 + q AS place, round(CASE WHEN t = o THEN 1 - e ELSE e / 3 END, 9) AS p, 7 AS n_reads FROM (SELECT *, least(greatest(pow(10.0, -q / 10.0), 1e-6), 0.5) AS e FROM grid)",
    "read_likelihood": ctes("reads") + f"SELECT rec, round(coalesce(list_sum(list_transform(range(1, length(seq) + 1), lambda i: {_LOG})), 0), 6) AS log_p FROM reads",
    "learning_reads": ctes("amp") + f"SELECT sample, rec FROM (SELECT sample, rec, row_number() OVER (PARTITION BY sample ORDER BY rec) AS r FROM amp WHERE {ee('q')} <= 0.08) WHERE r <= greatest(30000 // 8, 1000)",
    "remove_primers": ctes("reads") + f"SELECT sample, rec, substr(seq, s::INT + 1) AS seq FROM (SELECT sample, rec, seq, s + least(6, least(11, length(seq)) - s) AS s FROM (SELECT *, {_START} AS s FROM reads WHERE length(seq) >= 4)) WHERE s < length(seq)",
    "denoise_clusters": _recursive(ctes("grid", "amp", more=f"{_AMP}, {_uniques('du0', 'src', 60)}, {_denoised('d', 'du0', _ILLUMINA)}")) + "SELECT g AS sample, seq, centre, cnt FROM da",
    "variant_totals": f"SELECT seq, sum(abundance)::BIGINT AS cnt FROM ({ORACLES['merge_pairs']}) GROUP BY seq",
}
