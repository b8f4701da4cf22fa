"""SQL for the alignment queries and the tools on top of them: the recurrences as lists that grow base by base.

Candidates are found in another way than the plans do: a query is cut into pieces, one more than it can hold edits, so
that an alignment that scores enough holds one of them unchanged (local alignments: an exact match of their right end), and candidates that hold too few of the
query's 6-mers for their score are left out.
Tables run from the right end of query and reference to the left. Beside each score stands its path, a mark for each
column: = equal bases, *qr different ones, +q and -r gaps.
"""

from __future__ import annotations

from .functions.dp import Scoring, lost_mers

NO = -10000
SEQ = "upper(regexp_replace(coalesce(text, ''), '[^ACGTacgt]', '', 'g'))"


def strands(where: str = "true") -> str:
    return (
        f"d AS (SELECT CAST(doc_id AS BIGINT) AS src, CAST(doc_id AS VARCHAR) AS name, {SEQ} AS seq FROM documents WHERE {where}), "
        "b AS MATERIALIZED (SELECT src * 2 AS sid, name, 0 AS strand, seq FROM d UNION ALL SELECT src * 2 + 1, name, 1, reverse(translate(seq, 'ACGT', 'TGCA')) FROM d)"
    )


ITEMS = f"i AS (SELECT CAST(item_id AS VARCHAR) AS name, {SEQ} AS seq FROM benchmark)"


def windows(k: int, step: int) -> str:
    """w (name, st, en, seq): the windows of i."""
    return (
        f"w AS MATERIALIZED (SELECT name, st, en, substr(seq, CAST(st + 1 AS INT), CAST(en - st AS INT)) AS seq FROM (SELECT *, CASE WHEN last THEN length(seq) ELSE st + {k} END AS en, min(CASE WHEN last THEN st END) OVER (PARTITION BY name) AS stop "
        f"FROM (SELECT *, st + {step} + {k} > length(seq) AS last FROM (SELECT name, seq, unnest(range(0, length(seq), {step})) AS st FROM i))) WHERE st <= stop)"
    )


def full_windows(k: int, step: int) -> str:
    """w (name, st, en, seq): the windows of i that are k long."""
    return f"w AS MATERIALIZED (SELECT name, st, st + {k} AS en, substr(seq, CAST(st + 1 AS INT), {k}) AS seq FROM (SELECT name, seq, unnest(range(0, length(seq) - {k} + 1, {step})) AS st FROM i WHERE length(seq) >= {k}))"


def pairs(sc: Scoring, end_len: int = 0) -> str:
    """place (q, m, g, sid, lo, core, win) and pair (id, q, m, g, core, win) for the sequences of q.

    end_len: local alignments. Their right end is an exact match of so many bases that cannot go on to the right, so
    query and reference are cut there: what lies to the left is aligned with that end held fast.
    """
    if any(lost_mers(c, size, sc) != size * (c // 4) for c in range(200) for size in (6, 8, 10)):
        raise ValueError("the seeds that are left are counted for other costs")
    full, edit = f"length(seq) * {sc.match} - {sc.min_score}", sc.match + sc.mismatch
    gap = f"greatest(0, ({full} - {sc.gap_open}) // {sc.gap_extend})"
    if end_len:
        cut, starts = str(end_len), "range(0, m - l + 1)"
    else:
        cut, starts = f"length(seq) // (({full}) // {edit} + 1)", f"range(0, l * ((m * {sc.match} - {sc.min_score}) // {edit} + 1), l)"
    out = (
        f"qp AS (SELECT seq, CAST(length(seq) AS BIGINT) AS m, {gap} AS g, {cut} AS l FROM q WHERE length(seq) * {sc.match} >= {sc.min_score}), "
        f"qm AS (SELECT seq, m, g, l, x, substr(seq, CAST(x + 1 AS INT), CAST(l AS INT)) AS mer FROM (SELECT *, unnest({starts}) AS x FROM qp)), "
        "rm AS (SELECT sid, seq AS ref, p, l, substr(seq, CAST(p + 1 AS INT), CAST(l AS INT)) AS mer FROM (SELECT sid, seq, l, unnest(range(0, length(seq) - l + 1)) AS p FROM b, (SELECT DISTINCT l FROM qp) WHERE length(seq) >= l)), "
    )
    lost, least = f"(m * {sc.match} - {sc.min_score}) // 4", []
    for size in (6, 8, 10):
        need = f"{sc.min_score} - {size - 1} - {size - 4} * ({lost})" if end_len else f"m - {size - 1} - {size} * ({lost})"
        least.append(f"len(list_filter(range(1, m - {size - 2}), lambda x: contains(win, substr(q, CAST(x AS INT), {size})))) >= {need}")
    if end_len:
        out += (
            f"cand AS (SELECT DISTINCT seq AS whole, substr(seq, 1, CAST(x + l AS INT)) AS q, x + l AS m, g, substr(ref, CAST(greatest(0, p - x - g) + 1 AS INT), CAST(p + l - greatest(0, p - x - g) AS INT)) AS win FROM qm JOIN rm USING (l, mer) "
            f"WHERE (x + l) * {sc.match} >= {sc.min_score} AND substr(seq, CAST(x + l + 1 AS INT), 1) IS DISTINCT FROM nullif(substr(ref, CAST(p + l + 1 AS INT), 1), '')), "
        )
        return out + f"pair AS MATERIALIZED (SELECT row_number() OVER () AS id, 0 AS core, * FROM cand WHERE {' AND '.join(least)})"
    out += (
        "cand AS (SELECT DISTINCT qm.seq AS q, m, g, sid, CAST(floor((p - x) / (g + 1)) * (g + 1) AS BIGINT) AS d FROM qm JOIN rm ON qm.l = rm.l AND qm.mer = rm.mer), "
        "place AS MATERIALIZED (SELECT q, m, g, sid, lo, hi - lo AS core, substr(seq, CAST(lo + 1 AS INT), CAST(hi + m + g - lo AS INT)) AS win FROM (SELECT q, m, g, sid, greatest(0, d - g) AS lo, d + 2 * g + 1 AS hi FROM cand) JOIN b USING (sid) WHERE hi > 0), "
    )
    return out + f"pair AS MATERIALIZED (SELECT row_number() OVER () AS id, * FROM (SELECT DISTINCT q, m, g, core, win FROM place WHERE win <> '') WHERE {' AND '.join(least)})"


def table(name: str, source: str, sc: Scoring, end_len: int, paths: bool) -> str:
    """name (id, ..., best, outs): the rows of the recurrence after the last base. With paths, outs lists the alignments: all of
    min_score or more end to end, those that reach `goal` (a column of source) if local."""
    first, ext, local = sc.gap_open + sc.gap_extend, sc.gap_extend, end_len > 0
    over = "list_transform(range(1, n + 2), lambda j: {})".format
    start = f"i = {end_len - 1} AND j = {end_len + 1}" if local else "i = 0 AND run2[j] = 1"
    score = (end_len if local else 1) * sc.match
    path = "'" + "=" * (end_len if local else 1) + "'"
    # h2: best of a cell; its path prefers the start, then an aligned base, then the shortest gap in the reference, then in the query.
    runs = over("CASE WHEN j > 1 AND qs[i + 1] = ws[j - 1] THEN run[j - 1] + 1 ELSE 0 END")
    e2 = over(f"CASE WHEN greatest(h[j] - {first}, e[j] - {ext}) > 0 THEN greatest(h[j] - {first}, e[j] - {ext}) ELSE {NO} END")
    step = f"CASE WHEN run2[j] > 0 THEN h[j - 1] + {sc.match} ELSE h[j - 1] - {sc.mismatch} END"
    d2 = over(f"CASE WHEN j = 1 THEN {NO} ELSE greatest(CASE WHEN {start} THEN {score} ELSE {NO} END, CASE WHEN h[j - 1] > 0 AND {step} > 0 THEN {step} ELSE {NO} END) END")
    lost = f"r2[j - k] - {sc.gap_open} - {ext} * k"
    f2 = over(f"coalesce(list_max(list_transform(range(1, least(g, j - 1) + 1), lambda k: CASE WHEN {lost} > 0 THEN {lost} ELSE {NO} END)), {NO})")
    keys = "id, m, g, core, n, qs, ws" + (", goal" if paths and local else "")
    empty = f"list_transform(range(0, length(win) + 1), lambda j: CAST({NO} AS BIGINT))"
    blank = "list_transform(range(0, length(win) + 1), lambda j: '')"
    given = f"id, m, g, core, CAST(length(win) AS BIGINT) AS n, string_split(reverse(q), '') AS qs, string_split(reverse(win), '') AS ws{', goal' if paths and local else ''}"
    out = f"{name}({keys}, i, h, e, run, best{', hp, ep, outs' if paths else ''}) USING KEY (id) AS (SELECT {given}, CAST(0 AS BIGINT), {empty}, {empty}, list_transform(range(0, length(win) + 1), lambda j: CAST(0 AS BIGINT)), CAST({NO} AS BIGINT)"
    kind = "STRUCT(i BIGINT, j BIGINT, score BIGINT, path VARCHAR)[]"
    if paths:
        out += f", {blank}, {blank}, CAST([] AS {kind})"
    out += f" FROM {source} UNION SELECT {keys}, i + 1, h2, e2, run2, "
    out += "greatest(best, list_max(h2))" if local else f"CASE WHEN i + 1 = m THEN list_max(list_transform(range(1, n + 2), lambda j: CASE WHEN j - 1 > n - core THEN d2[j] ELSE {NO} END)) ELSE {NO} END"
    if paths:
        wanted = "h2[j] = goal" if local else f"i + 1 = m AND j - 1 > n - core AND d2[j] >= {sc.min_score}"
        got = "hp2[j]" if local else "dp2[j]"
        value = "h2[j]" if local else "d2[j]"
        out += f", hp2, ep2, list_concat(outs, list_transform(list_filter(range(1, n + 2), lambda j: {wanted}), lambda j: CAST({{'i': i + 1, 'j': j - 1, 'score': {value}, 'path': {got}}} AS {kind[:-2]})))"
    inner = f"SELECT *, {runs} AS run2, {e2} AS e2 FROM {name} WHERE i < m"
    inner = f"SELECT *, {d2} AS d2 FROM ({inner})"
    inner = f"SELECT *, {over('greatest(d2[j], e2[j])')} AS r2 FROM ({inner})"
    inner = f"SELECT *, {f2} AS f2 FROM ({inner})"
    inner = f"SELECT *, {over('greatest(r2[j], f2[j])')} AS h2 FROM ({inner})"
    if paths:
        base = "lower(qs[i + 1])"
        ep2 = over(f"CASE WHEN e2[j] = h[j] - {first} THEN '+' || {base} || hp[j] ELSE '+' || {base} || substr(ep[j], 2) END")
        dp2 = over(f"CASE WHEN {start} AND d2[j] = {score} THEN {path} WHEN j > 1 AND run2[j] > 0 THEN '=' || hp[j - 1] WHEN j > 1 THEN '*' || {base} || lower(ws[j - 1]) || hp[j - 1] ELSE '' END")
        inner = f"SELECT *, {ep2} AS ep2, {dp2} AS dp2 FROM ({inner})"
        inner = f"SELECT *, {over('CASE WHEN d2[j] >= e2[j] THEN dp2[j] ELSE ep2[j] END')} AS rp2 FROM ({inner})"
        # j - 1 is the column; a gap of k leaves out columns j - k to j - 1, which read from left to right in falling order.
        k = f"list_min(list_filter(range(1, least(g, j - 1) + 1), lambda k: {lost} = f2[j]))"
        gone = f"'-' || lower(reverse(array_to_string(ws[j - {k}:j - 1], '')))"
        hp2 = over(f"CASE WHEN r2[j] >= f2[j] THEN rp2[j] ELSE {gone} || rp2[j - {k}] END")
        inner = f"SELECT *, {hp2} AS hp2 FROM ({inner})"
    return out + f" FROM ({inner}))"


def counted(pattern: str) -> str:
    return f"CAST(len(regexp_extract_all(path, '{pattern}')) AS BIGINT)"


def letters(kind: str) -> str:
    return f"CAST(coalesce(list_sum(list_transform(regexp_extract_all(path, '[{kind}][a-z]+'), lambda x: length(x) - 1)), 0) AS BIGINT)"


MLEN, PAIRED = counted("="), counted("=|[*]")
CS = "array_to_string(list_transform(regexp_extract_all(path, '=+|[*][a-z][a-z]|[+-][a-z]+'), lambda x: CASE WHEN x[1] = '=' THEN ':' || length(x) ELSE x END), '')"
CIGAR = (
    "array_to_string(list_transform(regexp_extract_all(path, '(?:=|[*][a-z][a-z])+|[+][a-z]+|-[a-z]+'), lambda x: CASE WHEN x[1] = '+' THEN (length(x) - 1) || 'I' WHEN x[1] = '-' THEN (length(x) - 1) || 'D' "
    "ELSE len(regexp_extract_all(x, '=|[*]')) || 'M' END), '')"
)
DESCRIBED = f"{CS} AS cs, {CIGAR} AS cigar, {MLEN} AS mlen, {PAIRED} + {letters('+-')} AS blen, {PAIRED} + {letters('+-')} - {MLEN} AS ed, {PAIRED} + {letters('-')} AS rlen, {PAIRED} + {letters('+')} AS alen"


def counts() -> str:
    """cnt (rs, cnt): occurrences in b of the strings of one."""
    return (
        "lens AS (SELECT DISTINCT length(rs) AS l FROM one), mers AS (SELECT sid, strand, name, length(seq) AS tlen, p, substr(seq, CAST(p + 1 AS INT), CAST(l AS INT)) AS rs FROM (SELECT *, unnest(range(0, length(seq) - l + 1)) AS p FROM b, lens WHERE length(seq) >= l)), "
        "spot AS MATERIALIZED (SELECT mers.* FROM mers JOIN (SELECT DISTINCT rs FROM one) USING (rs)), cnt AS (SELECT rs, count(*) AS cnt FROM spot GROUP BY rs)"
    )


def end_to_end(sc: Scoring) -> str:
    """al (q, rs, score, cigar, cs, mlen, blen, ed, cnt): alleles of the sequences of q, in the strings of b."""
    return (
        f"{pairs(sc)}, {table('t', 'pair', sc, 0, False)}, good AS (SELECT pair.* FROM pair JOIN t USING (id) WHERE best >= {sc.min_score}), {table('u', 'good', sc, 0, True)}, "
        f"found AS (SELECT id, o.score AS score, n - o.j AS ix, {DESCRIBED.replace('path', 'o.path')} FROM (SELECT id, n, unnest(outs) AS o FROM u)), "
        "one AS MATERIALIZED (SELECT DISTINCT q, substr(win, CAST(ix + 1 AS INT), CAST(rlen AS INT)) AS rs, score, cigar, cs, mlen, blen, ed FROM found JOIN pair USING (id)), "
        f"{counts()}, {kept('one JOIN cnt USING (rs)')}"
    )


def kept(hits: str) -> str:
    """al: hits one after the other, each left out if one kept before it has its places: a prefix or suffix of it, or one that begins or ends with it and is as frequent."""
    inside = lambda a, b: f"(starts_with({a}.rs, {b}.rs) OR ends_with({a}.rs, {b}.rs))"
    covers = f"len(list_filter(a, lambda y: {inside('x[1]', 'y')} OR (y.cnt = x[1].cnt AND {inside('y', 'x[1]')}))) > 0"
    return (
        f"ranked AS (SELECT q, list([{{'rs': rs, 'cnt': cnt, 'score': score, 'cigar': cigar, 'cs': cs, 'mlen': mlen, 'blen': blen, 'ed': ed}}] ORDER BY score DESC, rs) AS hits FROM {hits} GROUP BY q), "
        f"al AS MATERIALIZED (SELECT q, h.* FROM (SELECT q, unnest(list_reduce(hits, lambda a, x: CASE WHEN {covers} THEN a ELSE list_concat(a, x) END)) AS h FROM ranked))"
    )


def paf(hits: str, max_pos: int) -> str:
    """PAF rows of hits (name, q, qst, qen, rs, score, cigar, cs, mlen, blen, ed, cnt)."""
    sign = "CASE WHEN strand = 0 THEN '+' ELSE '-' END"
    at = "CASE WHEN strand = 0 THEN p ELSE tlen - p - length(rs) END"
    return (
        f"h AS (SELECT *, greatest(1, {max_pos} - coalesce(sum(cnt) OVER (PARTITION BY name, q ORDER BY score DESC, rs ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS most FROM {hits}), "
        f"s AS (SELECT rs, name AS tname, strand, tlen, p, {at} AS pos, {sign} AS sign, row_number() OVER (PARTITION BY rs ORDER BY sid, p) AS k FROM spot) "
        "SELECT h.name AS qname, CAST(length(q) AS BIGINT) AS qlen, qst, qen, s.sign AS strand, tname, CAST(tlen AS BIGINT) AS tlen, CAST(pos AS BIGINT) AS tst, CAST(pos + length(h.rs) AS BIGINT) AS ten, mlen, blen, CAST(0 AS INT) AS mapq, score AS \"AS\", "
        "CAST(len(list_filter(range(1, length(q) + 1), lambda x: substr(q, CAST(x AS INT), CAST(qen - qst AS INT)) = substr(q, CAST(qst + 1 AS INT), CAST(qen - qst AS INT)))) AS BIGINT) AS qh, "
        "cnt AS rh, cigar AS cg, cs, h.rs AS rs, coalesce((SELECT string_agg(z.tname || ',' || z.sign || ',' || z.pos, ';' ORDER BY z.k) FROM s z WHERE z.rs = h.rs AND z.k > 1 AND z.k <= h.most), '') AS ap "
        "FROM h JOIN s ON s.rs = h.rs AND s.k = 1"
    )


def sw_e2e(k: int, step: int, sc: Scoring, max_pos: int, top: int = 25) -> str:
    named = "n AS (SELECT name || ':' || (st + 1) || '-' || en AS name, seq AS q FROM w)"
    hits = f"hit AS (SELECT name, q, CAST(0 AS BIGINT) AS qst, CAST(length(q) AS BIGINT) AS qen, rs, score, cigar, cs, mlen, blen, ed, cnt FROM (SELECT *, row_number() OVER (PARTITION BY q, name ORDER BY score DESC, rs) AS k FROM n JOIN al USING (q)) WHERE k <= {top})"
    return f"WITH RECURSIVE {strands()}, {ITEMS}, {windows(k, step)}, q AS (SELECT DISTINCT seq FROM w), {end_to_end(sc)}, {named}, {hits}, {paf('hit', max_pos)}"


def sw_local(sc: Scoring, end_len: int, max_pos: int, unmapped: bool = False) -> str:
    score = f"WITH RECURSIVE {strands()}, {ITEMS}, q AS (SELECT DISTINCT seq FROM i), {pairs(sc, end_len)}, {table('t', 'pair', sc, end_len, False)}, "
    if unmapped:
        return score + f"good AS (SELECT DISTINCT whole FROM pair JOIN t USING (id) WHERE best >= {sc.min_score}) SELECT name AS qname, CAST(length(seq) AS BIGINT) AS qlen FROM i WHERE seq NOT IN (SELECT whole FROM good)"
    return score + (
        f"good AS (SELECT * FROM (SELECT pair.*, best, max(best) OVER (PARTITION BY whole) AS goal FROM pair JOIN t USING (id)) WHERE best = goal AND goal >= {sc.min_score}), {table('u', 'good', sc, end_len, True)}, "
        f"found AS (SELECT id, m - o.i AS qst, o.score AS score, n - o.j AS ix, {DESCRIBED.replace('path', 'o.path')} FROM (SELECT id, m, n, unnest(outs) AS o FROM u)), "
        "all_best AS (SELECT whole AS q, qst, qst + alen AS qen, substr(win, CAST(ix + 1 AS INT), CAST(rlen AS INT)) AS rs, score, cigar, cs, mlen, blen, ed FROM found JOIN pair USING (id)), "
        "one AS MATERIALIZED (SELECT * EXCLUDE (k) FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY rs, qst) AS k FROM all_best) WHERE k = 1), "
        f"{counts()}, hit AS (SELECT i.name, one.*, cnt FROM one JOIN cnt USING (rs) JOIN i ON i.seq = one.q), {paf('hit', max_pos)}"
    )


def both_strands_of(k: int, step: int, sc: Scoring) -> str:
    """n (qname, strand, q) and al for the windows and their reverse complements."""
    return (
        f"WITH RECURSIVE {strands()}, {ITEMS}, {windows(k, step)}, n AS (SELECT name || ':' || (st + 1) || '-' || en AS qname, '+' AS strand, seq AS q FROM w UNION ALL SELECT name || ':' || (st + 1) || '-' || en, '-', reverse(translate(seq, 'ACGT', 'TGCA')) FROM w), "
        f"q AS (SELECT DISTINCT q AS seq FROM n), {end_to_end(sc)}, r AS (SELECT n.*, al.* EXCLUDE (q), sum(cnt) OVER (PARTITION BY n.qname, n.strand ORDER BY score DESC, rs ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM n JOIN al ON n.q = al.q)"
    )


def all_e2e(k: int, step: int, sc: Scoring, max_total: int | None = None) -> str:
    listed = f" FILTER (coalesce(before, 0) < {max_total})" if max_total else ""
    return both_strands_of(k, step, sc) + (
        f" SELECT n.qname, n.strand, CAST(length(n.q) AS BIGINT) AS qlen, count(rs) AS n_allele, CAST(coalesce(sum(cnt){listed}, 0) AS BIGINT) AS n_out, CAST(coalesce(sum(cnt), 0) AS BIGINT) AS total FROM n LEFT JOIN r ON n.qname = r.qname AND n.strand = r.strand GROUP BY ALL"
    )


def all_e2e_hits(k: int, step: int, sc: Scoring, max_total: int | None = None) -> str:
    return both_strands_of(k, step, sc) + " SELECT qname, strand, cnt, score, ed, cs FROM r" + (f" WHERE coalesce(before, 0) < {max_total}" if max_total else "")


def of_windows(k: int, step: int, sc: Scoring, where: str = "true", cut=windows) -> str:
    """w, and wh (name, st, en, cnt, score, ed, cs): the alleles of the windows."""
    return f"WITH RECURSIVE {strands(where)}, {ITEMS}, {cut(k, step)}, q AS (SELECT DISTINCT seq FROM w), {end_to_end(sc)}, wh AS MATERIALIZED (SELECT w.name, st, en, cnt, score, ed, cs FROM w JOIN al ON w.seq = al.q)"


def hapdiv(k: int, step: int, sc: Scoring) -> str:
    bins = ", ".join(f"CAST(coalesce(sum(CASE WHEN least(ed, 6) = {x} THEN cnt END), 0) AS BIGINT) AS h{x}" for x in range(7))
    names = "n_al, max_ed, h0, h1, h2, h3, h4, h5, h6"
    return of_windows(k, step, sc, cut=full_windows) + (
        f", p AS (SELECT w.name, w.st, w.en, count(wh.cs) AS n_al, coalesce(max(ed), 0) AS max_ed, {bins} FROM w LEFT JOIN wh ON w.name = wh.name AND w.st = wh.st AND w.en = wh.en GROUP BY ALL), "
        f"g AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY st) - row_number() OVER (PARTITION BY name, {names} ORDER BY st) AS part FROM p) "
        f"SELECT name, CAST(min(st) AS BIGINT) AS st, CAST(max(en) AS BIGINT) AS en, {names} FROM g GROUP BY name, part, {names}"
    )


def joined(source: str, gap: int) -> str:
    """Windows of source as stretches, two of them joined if no more than `gap` bases lie between; gap: bases that no window covers."""
    return (
        f", j AS (SELECT name, st, en, max(en) OVER (PARTITION BY name ORDER BY st, en ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM {source}), "
        f"g AS (SELECT *, sum(CASE WHEN before IS NULL OR st > before + {gap} THEN 1 ELSE 0 END) OVER (PARTITION BY name ORDER BY st, en) AS part FROM j) "
        "SELECT name AS ctg, CAST(min(st) AS BIGINT) AS st, CAST(max(en) AS BIGINT) AS en, CAST(max(en) - min(st) - len(list_distinct(flatten(list(range(st, en))))) AS BIGINT) AS gap FROM g GROUP BY name, part"
    )


def mapflt(k: int, step: int, sc: Scoring, max_hap: int, max_ed: int, gap: int) -> str:
    n = f"coalesce(sum(cnt) FILTER (ed <= {max_ed}), 0)"
    return of_windows(k, step, sc) + f", kept AS (SELECT w.name, w.st, w.en FROM w LEFT JOIN wh ON w.name = wh.name AND w.st = wh.st AND w.en = wh.en GROUP BY ALL HAVING {n} = 0 OR {n} > {max_hap})" + joined("kept", gap)


def mapflt2(k: int, step: int, sc: Scoring, where: str, max_hap: int, ref_ed: int = 3, pan_ed: int = 7, gap: int = 50) -> str:
    """The smaller collection's alleles are those that occur in it at all: their occurrences are counted again among its strings."""
    part = of_windows(k, step, sc, where)
    whole = of_windows(k, step, sc).removeprefix("WITH RECURSIVE ")
    sums = lambda t: ", ".join(f"coalesce((SELECT sum(cnt) FROM {t} x WHERE x.name = w.name AND x.st = w.st AND x.en = w.en AND x.ed <= {ed}), 0) AS {t}{c}" for ed, c in ((ref_ed, 1), (pan_ed, 2)))
    return (
        f"WITH ref AS MATERIALIZED ({part} SELECT * FROM wh), pan AS MATERIALIZED (WITH RECURSIVE {whole} SELECT * FROM wh), {ITEMS}, {windows(k, step)}, "
        f"n AS (SELECT name, st, en, {sums('ref')}, {sums('pan')} FROM w), kept AS (SELECT name, st, en FROM n WHERE NOT (ref1 = 1 AND pan1 > 0 AND pan1 <= {max_hap}) OR (ref2 = 1 AND pan2 > {max_hap}))" + joined("kept", gap)
    )


def uniqmer(k: int, step: int, sc: Scoring, within: int, min_exact: int, max_exact: int) -> str:
    return of_windows(k, step, sc) + f" SELECT name || ':' || (st + 1) || '-' || en AS name FROM wh WHERE (ed > 0 AND ed < {within}) OR (ed = 0 AND (cnt > {max_exact} OR cnt < {min_exact}))"


def call(k: int, step: int, sc: Scoring, n_hap: int, max_ed: int = 5, ambiguous: int = 4, drop: int = 12, keep_single: bool = False, conflicts: bool = False, then: str = "SELECT * FROM vcf") -> str:
    """vcf (chrom, pos, id, ref, alt, qual, filter, info)."""
    tokens = "regexp_extract_all(cs, '[:*+-](?:[0-9]+|[a-z]+)')"
    skip = "CASE WHEN o[1] = ':' THEN CAST(o[2:] AS BIGINT) WHEN o[1] = '*' THEN 1 WHEN o[1] = '+' THEN length(o) - 1 ELSE 0 END"
    single = "" if keep_single else "CASE WHEN support < 2 THEN 'SUPPORT1' END, "
    conflict = "EXISTS (SELECT 1 FROM w z WHERE z.name = best.name AND z.st > best.st AND z.st < best.ven AND NOT list_contains(seen, z.st) AND least(best.vst - z.st, z.en - best.ven) > best.dist)" if conflicts else "false"
    info = " || ';' || ".join(f"'{a}=' || {c}" for a, c in (("AC", "ac_real"), ("AN", "an_real"), ("AC_AMBI", "ac_ambi"), ("AN_AMBI", "an_ambi"), ("AC_DUP", "ac_dup"), ("AN_DUP", "an_dup"), ("RSCORE", "rscore"), ("SUPPORT", "support")))
    return of_windows(k, step, sc) + (
        f", k0 AS (SELECT *, {tokens} AS ops FROM wh), k1 AS (SELECT * FROM k0 WHERE len(list_filter(ops, lambda o: o[1] <> ':')) <= {max_ed}), "
        "k2 AS (SELECT *, (SELECT sum(x.cnt) FROM k1 x WHERE x.name = k1.name AND x.st = k1.st AND x.en = k1.en AND x.score >= k1.score) AS acc FROM k1), "
        f"k3 AS (SELECT *, coalesce(max(CASE WHEN acc >= {n_hap} THEN score END) OVER v, min(score) OVER v) AS cutoff, coalesce(max(CASE WHEN acc > {n_hap} THEN score END) OVER v, 0) AS nxt FROM k2 WINDOW v AS (PARTITION BY name, st, en)), "
        f"k4 AS (SELECT *, CASE WHEN score >= cutoff AND score >= nxt + {ambiguous} THEN 0 WHEN score >= cutoff AND score > nxt THEN 1 WHEN score < cutoff - {drop} THEN 4 WHEN score = nxt THEN 2 WHEN score < nxt THEN 3 ELSE -1 END AS kind FROM k3), "
        "k5 AS (SELECT *, sum(CASE WHEN kind IN (0, 1) THEN cnt ELSE 0 END) OVER v AS n_real, sum(CASE WHEN kind = 2 THEN cnt ELSE 0 END) OVER v AS n_ambi, sum(CASE WHEN kind = 3 THEN cnt ELSE 0 END) OVER v AS n_dup FROM k4 WINDOW v AS (PARTITION BY name, st, en)), "
        f"k6 AS (SELECT *, CASE WHEN cutoff = nxt THEN {n_hap} ELSE n_real END AS an_real, n_real + n_ambi AS an_ambi, n_real + n_ambi + n_dup AS an_dup, unnest(range(1, len(ops) + 1)) AS ix FROM k5), "
        f"k7 AS (SELECT *, ops[ix] AS o, upper(ops[ix][2:]) AS body, st + coalesce(list_sum(list_transform(ops[:ix - 1], lambda o: {skip})), 0) AS vst FROM k6), "
        "k8 AS (SELECT *, CASE WHEN o[1] = '*' THEN body[1] WHEN o[1] = '+' THEN body ELSE '' END AS ref, CASE WHEN o[1] = '*' THEN body[2] WHEN o[1] = '-' THEN body ELSE '' END AS alt FROM k7 WHERE o[1] <> ':'), "
        "k9 AS (SELECT name, st, en, CAST(vst AS BIGINT) AS vst, CAST(vst + length(ref) AS BIGINT) AS ven, ref, alt, min(kind) AS kind, sum(CASE WHEN kind IN (0, 1) THEN cnt ELSE 0 END) AS ac_real, sum(CASE WHEN kind = 2 THEN cnt ELSE 0 END) AS ac_ambi, sum(CASE WHEN kind = 3 THEN cnt ELSE 0 END) AS ac_dup, "
        "max(CASE WHEN kind < 4 THEN score END) - min(cutoff) AS rscore, min(an_real) AS an_real, min(an_ambi) AS an_ambi, min(an_dup) AS an_dup FROM k8 GROUP BY name, st, en, vst, ref, alt HAVING min(kind) < 4), "
        "ka AS (SELECT *, least(vst - st, en - ven) AS dist, count(*) OVER v AS support, list(st) OVER v AS seen, row_number() OVER (PARTITION BY name, vst, ven, ref, alt ORDER BY least(vst - st, en - ven) DESC, st) AS k FROM k9 WINDOW v AS (PARTITION BY name, vst, ven, ref, alt)), "
        "best AS (SELECT * FROM ka WHERE k = 1), "
        f"vcf AS (SELECT name AS chrom, CAST(CASE WHEN length(ref) = length(alt) THEN vst + 1 ELSE vst END AS BIGINT) AS pos, '.' AS id, CASE WHEN length(ref) = length(alt) THEN ref ELSE 'N' || ref END AS ref, CASE WHEN length(ref) = length(alt) THEN alt ELSE 'N' || alt END AS alt, CAST(60 AS INT) AS qual, "
        f"coalesce(nullif(array_to_string(list_filter([CASE kind WHEN 1 THEN 'LOWCONF' WHEN 2 THEN 'AMBI' WHEN 3 THEN 'DUP' END, {single}CASE WHEN {conflict} THEN 'CONFLICT' END], lambda x: x IS NOT NULL), ';'), ''), 'PASS') AS filter, {info} AS info FROM best) {then}"
    )


SNPS = (
    "SELECT chrom || '-' || pos || '-' || ref[x] || '-' || a[x] AS snp FROM (SELECT *, unnest(range(1, length(ref) + 1)) AS x FROM (SELECT chrom, pos, ref, unnest(string_split(alt, ',')) AS a FROM vcf) WHERE length(ref) = length(a)) WHERE ref[x] <> a[x]"
)
