"""DuckDB SQL for the catalog, written from the definitions: rows per position, per copy and per
list place, plain windows and joins, with none of the range arithmetic of the Spark operators."""

from __future__ import annotations

from seqloom.catalog import CHECK, SHORT, URL
from seqloom.plans.assembly import DEFAULT_LENGTH

DOCS = ("documents", "doc_id", "text")
URLS = ("pages", "page_id", "url")
TURNS = ("conversations", "conv_id", "text")


def _digits(text: str, codes: str) -> str:
    return f"translate(regexp_replace(hex({text}), '(.)(.)', '\\2', 'g'), '0123456789ABCDEF', '{codes}')"


FWD = "0001300200013002"
CMP = "0302000103020001"


def windows(source: tuple[str, str, str], length: int, strands: str = "fr") -> str:
    """CTEs ending in win(rid, strand, pos, lmer): words grow by doubling along each strand."""
    name, rid, text = source
    pick = []
    if "f" in strands:
        pick.append(f"SELECT {rid} AS rid, row_number() OVER () AS rno, 'f' AS strand, {_digits(text, FWD)} AS d FROM {name}")
    if "r" in strands:
        pick.append(f"SELECT {rid} AS rid, row_number() OVER () AS rno, 'r' AS strand, reverse({_digits(text, CMP)}) AS d FROM {name}")
    ctes = [
        f"strands AS ({' UNION ALL '.join(pick)})",
        "w1 AS (SELECT rid, rno, strand, unnest(range(length(d))) AS pos, CAST(unnest(string_split(d, '')) AS BIGINT) AS v "
        f"FROM strands WHERE length(d) >= {length})",
    ]
    size, have = 1, "w1"
    bits = bin(length)[3:]
    for bit in bits:
        step = size
        ctes.append(
            f"w{2 * size} AS (SELECT rid, rno, strand, pos, v * {4**size} + lead(v, {step}) OVER "
            f"(PARTITION BY rno, strand ORDER BY pos) AS v FROM {have})"
        )
        size, have = 2 * size, f"w{2 * size}"
        if bit == "1":
            ctes.append(
                f"w{size + 1} AS (SELECT a.rid, a.rno, a.strand, a.pos, a.v * 4 + b.v AS v FROM {have} a "
                f"JOIN w1 b ON a.rno = b.rno AND a.strand = b.strand AND b.pos = a.pos + {size})"
            )
            size, have = size + 1, f"w{size + 1}"
    ctes.append(f"win AS (SELECT rid, strand, pos, v AS lmer FROM {have} WHERE v IS NOT NULL)")
    return ", ".join(ctes)


def counted(source, length, strands="fr") -> str:
    return windows(source, length, strands) + ", cnts AS (SELECT lmer, count(*) AS cnt FROM win GROUP BY lmer)"


def kmers(source, length) -> str:
    mask = 4 ** (length - 1)
    return counted(source, length) + (
        f", kmers AS (SELECT kmer, row_number() OVER (ORDER BY kmer) - 1 AS vidx FROM "
        f"(SELECT lmer // 4 AS kmer FROM cnts UNION SELECT lmer % {mask} FROM cnts))"
    )


def edge_table(source, length) -> str:
    """CTEs ending in e(eid, lmer, copy, v1, v2, pos_out, pos_in) and s(eid, s, p)."""
    mask = 4 ** (length - 1)
    return kmers(source, length) + (
        ", offs AS (SELECT lmer, cnt, CAST(sum(cnt) OVER (ORDER BY lmer) - cnt AS BIGINT) AS eid0 FROM cnts)"
        ", raw AS (SELECT lmer, eid0, unnest(range(cnt)) AS copy FROM offs)"
        ", e0 AS (SELECT eid0 + copy AS eid, lmer, copy, k1.vidx AS v1, k2.vidx AS v2 FROM raw "
        f"JOIN kmers k1 ON k1.kmer = lmer // 4 JOIN kmers k2 ON k2.kmer = lmer % {mask})"
        ", e AS (SELECT *, row_number() OVER (PARTITION BY v1 ORDER BY eid) - 1 AS pos_out, "
        "row_number() OVER (PARTITION BY v2 ORDER BY eid) - 1 AS pos_in FROM e0)"
        ", s AS (SELECT a.eid, a.v1, a.v2, a.lmer, a.copy, a.pos_in, b.eid AS s FROM e a "
        "LEFT JOIN e b ON b.v1 = a.v2 AND b.pos_out = a.pos_in)"
        ", p AS (SELECT a.eid, b.eid AS p FROM s a LEFT JOIN s b ON b.s = a.eid)"
    )


def labelled(source, length, rounds) -> str:
    """Adds lab(eid, label, circuit): smallest id forward and backward, by pointer doubling."""

    def double(name, table, col):
        return (
            f", {name}(step, id, q, m) AS (SELECT 0, eid, {col}, least(eid, coalesce({col}, eid)) FROM {table} UNION ALL "
            f"SELECT a.step + 1, a.id, b.q, least(a.m, coalesce(b.m, a.m)) FROM {name} a LEFT JOIN {name} b ON a.q = b.id "
            f"WHERE a.step < {rounds})"
        )

    return (
        edge_table(source, length)
        + double("fwd", "s", "s")
        + double("bwd", "p", "p")
        + f", lab0 AS (SELECT f.id AS eid, least(f.m, b.m) AS label FROM fwd f JOIN bwd b ON f.id = b.id "
        f"AND f.step = {rounds} AND b.step = {rounds})"
        ", lab AS (SELECT eid, label, dense_rank() OVER (ORDER BY label) - 1 AS circuit FROM lab0)"
    )


def circuit_edge_ctes(source, length, rounds) -> str:
    return labelled(source, length, rounds) + (
        ", nb AS (SELECT eid AS e1, lead(eid) OVER (PARTITION BY v2 ORDER BY eid) AS e2 FROM e)"
        ", ce0 AS (SELECT least(x.circuit, y.circuit) AS c1, greatest(x.circuit, y.circuit) AS c2, e1, e2 FROM nb "
        "JOIN lab x ON x.eid = e1 JOIN lab y ON y.eid = e2 WHERE x.circuit <> y.circuit)"
        ", ce AS (SELECT row_number() OVER (ORDER BY c1, c2, e1, e2) - 1 AS ceid, c1, c2, e1, e2 FROM ce0)"
    )


def forest_ctes(source, length, rounds) -> str:
    """Adds forest(ceid): edges in order, one at a time, over a list of circuit names."""
    return circuit_edge_ctes(source, length, rounds) + (
        ", light AS (SELECT row_number() OVER (ORDER BY min(ceid)) AS n, min(ceid) AS ceid, c1, c2 FROM ce GROUP BY c1, c2)"
        ", grow(n, names, took) AS (SELECT CAST(0 AS BIGINT), "
        "(SELECT coalesce(list(circuit ORDER BY circuit), []) FROM (SELECT DISTINCT circuit FROM lab)), CAST(NULL AS BIGINT) "
        "UNION ALL SELECT l.n, CASE WHEN names[c1 + 1] = names[c2 + 1] THEN names ELSE "
        "list_transform(names, lambda x: CASE WHEN x = names[c2 + 1] THEN names[c1 + 1] ELSE x END) END, "
        "CASE WHEN names[c1 + 1] = names[c2 + 1] THEN NULL ELSE l.ceid END FROM grow JOIN light l ON l.n = grow.n + 1)"
        ", forest AS (SELECT took AS ceid FROM grow WHERE took IS NOT NULL)"
    )


def swipe_ctes(source, length, rounds) -> str:
    """Adds sw(eid, s): successors after the swipe, by runs inside each entering list."""
    return forest_ctes(source, length, rounds) + (
        ", mk AS (SELECT DISTINCT least(e1, e2) AS eid FROM ce JOIN forest USING (ceid))"
        ", m1 AS (SELECT s.eid, s.s, s.v2, s.pos_in, mk.eid IS NOT NULL AND lead(s.eid) OVER (PARTITION BY s.v2 ORDER BY s.eid) "
        "IS NOT NULL AS m FROM s LEFT JOIN mk ON mk.eid = s.eid)"
        ", m2 AS (SELECT *, coalesce(sum(CASE WHEN m THEN 0 ELSE 1 END) OVER (PARTITION BY v2 ORDER BY eid "
        "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS grp FROM m1)"
        ", sw AS (SELECT eid, CASE WHEN m THEN lead(s) OVER (PARTITION BY v2 ORDER BY eid) ELSE "
        "first_value(s) OVER (PARTITION BY v2, grp ORDER BY eid) END AS s FROM m2)"
    )


def contig_ctes(source, length, rounds) -> str:
    """Adds walk(contig, rank, eid): every path followed edge by edge from its start."""
    return swipe_ctes(source, length, rounds) + (
        ", start AS (SELECT eid FROM sw WHERE eid NOT IN (SELECT s FROM sw WHERE s IS NOT NULL))"
        ", walk(contig, rank, eid) AS (SELECT eid, CAST(0 AS BIGINT), eid FROM start UNION ALL "
        "SELECT contig, rank + 1, sw.s FROM walk JOIN sw ON sw.eid = walk.eid WHERE sw.s IS NOT NULL)"
    )


def text_of(word: str, bases: int) -> str:
    return " || ".join(f"substr('ACGT', CAST(({word} // {4**i}) % 4 AS INTEGER) + 1, 1)" for i in range(bases - 1, -1, -1))


def _with(ctes: str, select: str) -> str:
    return f"WITH RECURSIVE {ctes} {select}"


D7, D17, U9, T17 = (DOCS, SHORT), (DOCS, DEFAULT_LENGTH), (URLS, URL), (TURNS, DEFAULT_LENGTH)
MASK7 = 4 ** (SHORT - 1)
# Doubling rounds: 2^17 exceeds the number of edges of the URL graph and of any chain in the turns.
ROUNDS = 17


def _per_read(strand: str) -> str:
    return _with(
        windows(DOCS, DEFAULT_LENGTH, strand),
        f"SELECT rid AS read_id, count(*) AS windows, CAST(sum(lmer % {CHECK}) AS BIGINT) AS checksum FROM win GROUP BY rid",
    )


def _slots(side: str, key: str, base: str) -> str:
    return ", ".join(
        f"CAST(coalesce(sum(cnt) FILTER (WHERE {base} = {b} AND side = '{key}'), 0) AS BIGINT) AS {side}{b}" for b in range(4)
    )


ENDS = (
    f", ends AS (SELECT lmer // 4 AS kmer, lmer % 4 AS base, 'l' AS side, cnt FROM cnts UNION ALL "
    f"SELECT lmer % {MASK7}, lmer // {MASK7}, 'e', cnt FROM cnts)"
)
DEGREES = ENDS + (
    ", deg AS (SELECT kmer, CAST(coalesce(sum(cnt) FILTER (WHERE side = 'e'), 0) AS BIGINT) AS ecount, "
    "CAST(coalesce(sum(cnt) FILTER (WHERE side = 'l'), 0) AS BIGINT) AS lcount FROM ends GROUP BY kmer)"
    ", vert AS (SELECT row_number() OVER (ORDER BY kmer) - 1 AS vidx, kmer AS vid, ecount, lcount, "
    "CAST(sum(ecount) OVER (ORDER BY kmer) - ecount AS BIGINT) AS ep, CAST(sum(lcount) OVER (ORDER BY kmer) - lcount AS BIGINT) AS lp FROM deg)"
)

EVENTS = (
    "ev AS (SELECT event_id, ts, user_id, CAST(round(value * 100) AS BIGINT) AS cents, "
    "CAST(event_type = 'signup' AS INTEGER) AS flag, CASE WHEN event_type = 'purchase' THEN -1 ELSE 1 END AS sign FROM events)"
)
SEG = EVENTS + ", sg AS (SELECT *, sum(flag) OVER (ORDER BY ts, event_id) AS seg FROM ev)"


def _scan(expr: str, ctes: str = EVENTS, source: str = "ev", cols: str = "event_id") -> str:
    return f"WITH {ctes} SELECT {cols}, {expr} AS scan FROM {source}"


BEFORE = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
UP_TO = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
FORTH, BACK = "ORDER BY ts, event_id", "ORDER BY ts DESC, event_id DESC"

# Hash functions in wide integers.
TWO64 = "18446744073709551616"
HASH_H = "((16843009 + 305419896 * CAST({k} AS HUGEINT)) % " + TWO64 + ") % 1900813"


def _bucket(key: str, n: str) -> str:
    return f"CAST({HASH_H.format(k=key)} % ({n} // 409 + 1) AS BIGINT)"


def _slot(key: str, seed: int, xor: int, mul: int, base: int) -> str:
    inner = f"CAST(({seed} + {mul ^ seed}::HUGEINT * CAST({key} AS HUGEINT)) % {TWO64} AS UBIGINT)"
    return f"CAST(xor({inner}, {xor}::UBIGINT) % 1900813 % 192 + {base} AS BIGINT)"


N_ORDERS = "(SELECT count(*) FROM orders)"
LINE = "regexp_replace(coalesce(text, ''), '[\\r\\n]', 'N', 'g')"
K8 = URL - 1
DOT_LINE = f"chr(9) || {text_of('lmer // 4', K8)} || ' -> ' || {text_of(f'lmer % {4**K8}', K8)} || ' [label=' || {text_of('lmer', 1)} || ']'"


def oracles() -> dict[str, str]:
    sql: dict[str, str] = {}
    sql["lmer_forward"] = _per_read("f")
    sql["lmer_revcomp"] = _per_read("r")
    sql["lmer_count"] = _with(counted(*D7), "SELECT lmer, cnt FROM cnts")
    sql["lmer_spectrum"] = _with(
        counted(*D17),
        f"SELECT cnt, count(*) AS lmers, CAST(sum(lmer % {CHECK}) AS BIGINT) AS checksum FROM cnts GROUP BY cnt",
    )
    sql["stream_word_counts"] = sql["lmer_count"]
    sql["kmer_distinct"] = _with(kmers(*D7), "SELECT kmer FROM kmers")
    sql["kmer_index"] = _with(kmers(*D7), "SELECT kmer, vidx FROM kmers")
    sql["prefix_suffix"] = _with(
        counted(*D7),
        f"SELECT lmer, lmer // 4 AS prefix, lmer % {MASK7} AS suffix, CAST(lmer // {MASK7} AS INTEGER) AS first_base, "
        "CAST(lmer % 4 AS INTEGER) AS last_base FROM cnts",
    )
    sql["base_decode"] = _with(counted(*D7), f"SELECT lmer, {text_of('lmer', SHORT)} AS bases FROM cnts")
    number = lambda c, d: f"length(regexp_replace({c}, '[^{d}]', '', 'g')) AS {c}{d}"
    sql["base_composition"] = (
        f"WITH x AS (SELECT doc_id AS read_id, {_digits('text', FWD)} AS f, {_digits('text', CMP)} AS r FROM documents) "
        f"SELECT read_id, {', '.join(number(c, d) for c in 'fr' for d in range(4))} FROM x"
    )
    sql["neighbour_bitmap"] = _with(
        counted(*D7) + ENDS,
        "SELECT kmer, CAST(sum(cnt) AS BIGINT) AS cnt, CAST(bit_or(CASE WHEN side = 'l' THEN 1 ELSE 16 END "
        "<< CAST(base AS INTEGER)) AS INTEGER) AS neighbours FROM ends GROUP BY kmer",
    )
    sql["fastq_roundtrip"] = (
        f"SELECT doc_id AS read_id, md5({LINE}) AS seq_md5, length({LINE}) AS n FROM documents"
    )
    sql["fastq_reads"] = (
        f"SELECT length({LINE}) AS n, count(*) AS reads FROM conversations GROUP BY 1"
    )
    for name in ("fastq_source_scan", "fastq_source_stream"):
        sql[name] = (
            f"SELECT conv_id || ':' || turn AS name, md5({LINE}) AS seq_md5, length({LINE}) AS n FROM conversations"
        )
    sql["vertex_base_counts"] = _with(
        counted(*D7) + ENDS,
        f"SELECT kmer, {_slots('lc', 'l', 'base')}, {_slots('ec', 'e', 'base')} FROM ends GROUP BY kmer",
    )
    sql["vertex_degrees"] = _with(counted(*D7) + DEGREES, "SELECT vidx, vid, ep, ecount, lp, lcount FROM vert")
    sql["vertex_class"] = _with(
        counted(*D7) + DEGREES,
        "SELECT vidx, vid, ecount, lcount, CASE WHEN ecount > lcount THEN 'sink' WHEN ecount < lcount THEN 'source' "
        "ELSE 'balanced' END AS class FROM vert",
    )
    sql["edges"] = _with(
        edge_table(*D7),
        "SELECT v1, count(*) AS edges, CAST(sum(eid) AS BIGINT) AS sum_eid, CAST(sum(v2) AS BIGINT) AS sum_v2, "
        "CAST(sum(s) AS BIGINT) AS sum_s, CAST(sum(CAST(s IS NULL AS INTEGER)) AS BIGINT) AS ends, "
        "CAST(sum(copy) AS BIGINT) AS sum_copy FROM s GROUP BY v1",
    )
    sql["leaving_list"] = _with(edge_table(*U9), "SELECT v1 AS vidx, pos_out AS pos, eid FROM e")
    sql["entering_list"] = _with(edge_table(*U9), "SELECT v2 AS vidx, pos_in AS pos, eid FROM e")
    sql["successors"] = _with(edge_table(*U9), "SELECT eid, lmer, v1, v2, s FROM s")
    sql["predecessors"] = _with(edge_table(*U9), "SELECT eid, p FROM p")
    sql["successor_blocks"] = _with(
        edge_table(*D17),
        "SELECT s.eid // 4096 AS block, CAST(sum(s.s) AS BIGINT) AS sum_s, CAST(sum(p.p) AS BIGINT) AS sum_p, count(s.s) AS paired "
        "FROM s JOIN p ON s.eid = p.eid GROUP BY 1",
    )
    mask17 = 4 ** (DEFAULT_LENGTH - 1)
    sql["contig_start"] = _with(
        counted(*D17)
        + ", offs AS (SELECT lmer, cnt, CAST(sum(cnt) OVER (ORDER BY lmer) - cnt AS BIGINT) AS eid0 FROM cnts)"
        ", raw AS (SELECT lmer // 4 AS kmer, eid0 + unnest(range(cnt)) AS eid FROM offs)"
        ", out AS (SELECT kmer, eid, row_number() OVER (PARTITION BY kmer ORDER BY eid) - 1 AS place FROM raw)"
        f", inn AS (SELECT lmer % {mask17} AS kmer, sum(cnt) AS n FROM cnts GROUP BY 1)",
        "SELECT eid FROM out LEFT JOIN inn USING (kmer) WHERE place >= coalesce(n, 0)",
    )
    sql["components"] = _with(labelled(*U9, ROUNDS), "SELECT eid, label FROM lab")
    sql["component_sizes"] = _with(
        labelled(*T17, ROUNDS),
        "SELECT circuit, label, count(*) AS edges, CAST(sum(eid) AS BIGINT) AS sum_eid FROM lab GROUP BY circuit, label",
    )
    sql["circuit_vertices"] = _with(labelled(*T17, ROUNDS), "SELECT DISTINCT circuit, label FROM lab")
    sql["circuit_edges"] = _with(circuit_edge_ctes(*U9, ROUNDS), "SELECT ceid, c1, c2, e1, e2 FROM ce")
    sql["circuit_edge_counts"] = _with(
        circuit_edge_ctes(*T17, ROUNDS), "SELECT c1 AS circuit, count(*) AS edges FROM ce GROUP BY c1"
    )
    sql["spanning_forest"] = _with(forest_ctes(*U9, ROUNDS), "SELECT ceid FROM forest")
    sql["swipe"] = _with(swipe_ctes(*U9, ROUNDS), "SELECT eid, s FROM sw")
    sql["merged_starts"] = _with(contig_ctes(*U9, ROUNDS), "SELECT eid FROM start")
    sql["cycle_contigs"] = _with(
        labelled(URLS, SHORT, ROUNDS)
        + ", ring AS (SELECT s.eid, s.s, s.lmer % 4 AS base, label FROM s JOIN lab USING (eid) WHERE label NOT IN "
        "(SELECT label FROM s JOIN lab USING (eid) WHERE s.s IS NULL))"
        ", round(label, eid, s, text) AS (SELECT label, eid, s, substr('ACGT', CAST(base AS INTEGER) + 1, 1) FROM ring "
        "WHERE eid = label UNION ALL SELECT a.label, b.eid, b.s, text || substr('ACGT', CAST(b.base AS INTEGER) + 1, 1) "
        "FROM round a JOIN ring b ON b.eid = a.s WHERE b.eid <> a.label)"
        ", whole AS (SELECT label, text, length(text) AS size FROM round WHERE s = label)"
        ", turned AS (SELECT label, size, min(substr(text || text, CAST(i AS INTEGER) + 1, CAST(size AS INTEGER))) AS seq "
        "FROM (SELECT *, unnest(range(size)) AS i FROM whole) GROUP BY label, size)",
        "SELECT CAST(i // 4096 AS BIGINT) AS part, CAST(size AS BIGINT) AS bases, count(*) AS contigs, "
        "substr(seq, CAST(i + 1 AS INTEGER), 4096) AS seq "
        "FROM (SELECT *, unnest(range(0, size, 4096)) AS i FROM turned) GROUP BY ALL",
    )
    none = "CAST(NULL AS BIGINT)"
    sound = (
        "entering_offset leaving_offset edge_range successor_range entering_step leaving_step entering_count "
        "leaving_count vertex_missing successor_missing successor_elsewhere successor_shared"
    ).split()
    sql["graph_checks"] = _with(
        edge_table(*D7),
        f"SELECT 'words' AS \"check\", CAST(sum(cnt) AS BIGINT) AS value, CAST(0 AS BIGINT) AS bad, {none} AS first FROM cnts "
        + "".join(f"UNION ALL SELECT '{name}', count(*), 0, {none} FROM e " for name in ("edges", "entering", "leaving"))
        + f"UNION ALL SELECT 'successor_unset', count(*) FILTER (WHERE s IS NULL), 0, {none} FROM s "
        + " ".join(f"UNION ALL SELECT '{name}', {none}, 0, {none}" for name in sound),
    )
    sql["corrected_reads"] = (
        "WITH d AS (SELECT doc_id, translate(array_to_string(list_transform(string_split(text, chr(10)), "
        "lambda x, i: sha256(doc_id || ':' || (i - 1) || ':' || x)), ''), '0123456789abcdef', 'ACGTACGTACGTACGT') AS bases FROM documents) "
        "SELECT doc_id || ':' || i AS read_id, substr(bases, CAST(12 * i + 1 AS INTEGER), 100) AS seq "
        "FROM (SELECT *, unnest(range((length(bases) - 100) // 12 + 1)) AS i FROM d WHERE length(bases) >= 100)"
    )
    sql["contigs"] = _with(
        contig_ctes(*U9, ROUNDS),
        "SELECT contig, rank // 4096 AS part, string_agg(CASE WHEN rank = 0 THEN "
        f"{text_of('lmer', URL)} ELSE {text_of('lmer', 1)} END, '' ORDER BY rank) AS seq "
        "FROM walk JOIN e USING (eid) GROUP BY 1, 2",
    )
    sql["contig_lengths"] = _with(
        contig_ctes(*U9, ROUNDS),
        f"SELECT contig, count(*) AS edges, count(*) + {URL - 1} AS bases FROM walk GROUP BY contig",
    )
    sql["graph_dot"] = _with(
        edge_table(*U9),
        f"SELECT line, count(*) AS n FROM (SELECT {DOT_LINE} AS line FROM e UNION ALL SELECT 'digraph G {{' UNION ALL SELECT '}}') GROUP BY line",
    )
    frame = "UNION ALL SELECT 0, 0, 'graph G {' UNION ALL SELECT 9, 0, '}'"
    sql["successor_dot"] = _with(
        edge_table(*U9),
        "SELECT 1 AS section, eid AS key, chr(9) || eid || ' -- ' || s AS line FROM s WHERE s IS NOT NULL UNION ALL "
        f"SELECT 1, eid, chr(9) || eid || ' -- ' || p FROM p WHERE p IS NOT NULL {frame}",
    )
    sql["circuit_dot"] = _with(
        circuit_edge_ctes(*U9, ROUNDS),
        "SELECT 1 AS section, ceid AS key, chr(9) || c1 || ' -- ' || c2 || ' [label=e1:' || e1 || '-e2:' || e2 || ']' AS line "
        f"FROM ce {frame}",
    )
    sql["graph_long"] = _with(
        edge_table(*U9)
        + ", dg AS (SELECT k.vidx, k.kmer, (SELECT count(*) FROM e WHERE v2 = k.vidx) AS ec, (SELECT count(*) FROM e WHERE v1 = k.vidx) AS lc FROM kmers k)"
        ", vt AS (SELECT *, CAST(sum(ec) OVER (ORDER BY vidx) - ec AS BIGINT) AS ep, CAST(sum(lc) OVER (ORDER BY vidx) - lc AS BIGINT) AS lp FROM dg)",
        "SELECT 1 AS section, vidx AS key, '[' || vidx || ']:vid[' || kmer || '], ep[' || ep || '], eend[' || ec || '], lp[' || lp || '], lend[' || lc || ']' AS line FROM vt "
        "UNION ALL SELECT 2, ep + pos_in, 'e[' || (ep + pos_in) || ']: ' || eid FROM e JOIN vt ON v2 = vidx "
        "UNION ALL SELECT 3, lp + pos_out, 'l[' || (lp + pos_out) || ']: ' || eid FROM e JOIN vt ON v1 = vidx "
        "UNION ALL SELECT 4, eid, '[' || eid || ']: v1[' || v1 || '], v2[' || v2 || '], s[' || coalesce(CAST(s AS VARCHAR), '-') || ']' FROM s",
    )
    sql["assembly_metrics"] = _with(
        circuit_edge_ctes(*U9, ROUNDS)
        + f", st(id, name, value) AS (SELECT 9, 'l-mer Length', {URL} UNION ALL SELECT 11, 'l-mer Count', (SELECT count(*) FROM cnts) "
        "UNION ALL SELECT 12, 'k-mer Count', (SELECT count(*) FROM kmers) UNION ALL SELECT 13, 'Debruijn Vertices', (SELECT count(*) FROM kmers) "
        "UNION ALL SELECT 14, 'Debruijn Edges', (SELECT count(*) FROM e) UNION ALL SELECT 15, 'Circuit Vertices', (SELECT count(DISTINCT label) FROM lab) "
        "UNION ALL SELECT 16, 'Circuit Edges', (SELECT count(*) FROM ce) UNION ALL SELECT 23, 'Original Read Count', (SELECT count(*) FROM pages))",
        "SELECT CAST(id AS INTEGER) AS id, '<item name=''' || name || ''' value=''' || value || '''/>' AS line FROM st WHERE value > 0",
    )
    sql["part_supplier_components"] = (
        "WITH RECURSIVE pr AS (SELECT DISTINCT l_partkey AS a, -l_suppkey - 1 AS b FROM lineitem), "
        "both_ways AS (SELECT a, b FROM pr UNION ALL SELECT b, a FROM pr), "
        "reach(id, label) AS (SELECT a, a FROM both_ways WHERE a = (SELECT min(b) FROM pr) "
        "UNION SELECT b, label FROM reach JOIN both_ways ON a = id) "
        "SELECT DISTINCT a AS id, coalesce((SELECT label FROM reach r WHERE r.id = a), a) AS label FROM both_ways"
    )
    sql["event_chain_components"] = (
        "SELECT event_id AS id, min(event_id) OVER (PARTITION BY user_id) AS label FROM events"
    )

    sql["scan_exclusive"] = _scan(f"CAST(coalesce(sum(cents) OVER ({FORTH} {BEFORE}), 0) AS BIGINT)")
    sql["scan_inclusive"] = _scan(f"CAST(sum(cents) OVER ({FORTH} {UP_TO}) AS BIGINT)")
    sql["scan_backward"] = _scan(f"CAST(coalesce(sum(cents) OVER ({BACK} {BEFORE}), 0) AS BIGINT)")
    sql["scan_min"] = _scan(f"min(cents) OVER ({FORTH} {BEFORE})")
    sql["scan_max"] = _scan(f"max(cents) OVER ({BACK} {UP_TO})")
    sql["scan_multiply"] = _scan(f"product(sign) OVER ({FORTH} {UP_TO})")
    wrap = "lambda a, b: (a * b) % CAST(18446744073709551616 AS HUGEINT)"
    signed = "CAST(CASE WHEN p >= 9223372036854775808 THEN p - 18446744073709551616 ELSE p END AS BIGINT)"
    sql["scan_product"] = (
        f"SELECT event_id, user_id, {signed} AS scan FROM (SELECT event_id, user_id, list_reduce(list(CAST(event_id % 4 + 2 AS HUGEINT)) "
        f"OVER (PARTITION BY user_id {FORTH} {UP_TO}), {wrap}) AS p FROM events)"
    )
    sql["scan_float"] = f"SELECT event_id, round(sum(CAST(value AS DOUBLE)) OVER ({FORTH} {UP_TO}), 4) AS scan FROM events"
    sql["reduce_wrapped"] = (
        f"SELECT {signed} AS product FROM (SELECT list_reduce(list(CAST(o_orderkey AS HUGEINT)), {wrap}) AS p FROM orders WHERE o_orderkey % 2 = 1)"
    )
    sql["scan_multi"] = _scan(
        f"CAST(coalesce(sum(cents) OVER (PARTITION BY user_id {FORTH} {BEFORE}), 0) AS BIGINT)",
        cols="event_id, user_id",
    )
    sql["scan_segmented"] = _scan(
        f"CAST(sum(cents) OVER (PARTITION BY seg {FORTH} {UP_TO}) AS BIGINT)", SEG, "sg"
    )
    sql["scan_segmented_max_backward"] = _scan(
        f"max(cents) OVER (PARTITION BY seg {BACK} {BEFORE})", SEG, "sg"
    )
    sql["scan_lineitem"] = (
        "WITH n AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey) "
        "SELECT l_orderkey, n, CAST(sum(n) OVER (ORDER BY l_orderkey) - n AS BIGINT) AS scan FROM n"
    )

    sql["compact"] = (
        "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS idx FROM orders WHERE o_orderstatus = 'F'"
    )
    sql["compact_backward"] = (
        "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey DESC) - 1 AS idx FROM orders WHERE o_orderstatus = 'F'"
    )
    sql["sort_radix"] = (
        "SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS idx FROM orders"
    )
    sql["sort_string"] = (
        "SELECT p_partkey, p_name, row_number() OVER (ORDER BY p_name, p_partkey) - 1 AS idx FROM part"
    )
    sql["sort_descending"] = "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey DESC"
    sql["reduce"] = (
        f"WITH {EVENTS} SELECT CAST(sum(cents) AS BIGINT) AS \"add\", min(cents) AS \"min\", max(cents) AS \"max\", "
        "product(sign) AS multiply FROM ev"
    )
    word = lambda i: f"CAST(('0x' || substr(h, {8 * i + 1}, 8)) AS BIGINT) AS r{i}"
    sql["random_words"] = (
        f"SELECT o_orderkey, {', '.join(word(i) for i in range(4))} FROM (SELECT o_orderkey, md5('42:' || o_orderkey) AS h FROM orders)"
    )
    sql["list_rank"] = (
        "SELECT event_id AS id, first_value(event_id) OVER w AS head, row_number() OVER w - 1 AS rank FROM events "
        "WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)"
    )
    sql["spmv"] = (
        "SELECT l_orderkey AS \"row\", CAST(sum(CAST(l_quantity AS BIGINT) * CAST(round(p_retailprice * 100) AS BIGINT)) AS BIGINT) AS y "
        "FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey"
    )
    sql["tridiagonal"] = (
        "WITH RECURSIVE r AS (SELECT o_custkey AS sys, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS i, "
        "count(*) OVER (PARTITION BY o_custkey) AS n, o_totalprice AS d FROM orders), "
        "down(sys, i, n, cp, dp) AS (SELECT sys, i, n, -1.0::DOUBLE / 4, d / 4 FROM r WHERE i = 0 UNION ALL "
        "SELECT r.sys, r.i, r.n, -1.0::DOUBLE / (4 + cp), (r.d + dp) / (4 + cp) FROM down JOIN r ON r.sys = down.sys AND r.i = down.i + 1), "
        "up(sys, i, x) AS (SELECT sys, i, dp FROM down WHERE i = n - 1 UNION ALL "
        "SELECT d.sys, d.i, d.dp - d.cp * up.x FROM up JOIN down d ON d.sys = up.sys AND d.i = up.i - 1) "
        "SELECT sys AS system, i, round(x, 3) AS x FROM up"
    )
    sql["suffixes"] = (
        "WITH x AS (SELECT p_partkey AS id, unnest(range(length(p_name))) AS pos, p_name FROM part) "
        "SELECT row_number() OVER (ORDER BY substr(p_name, pos + 1), id, pos) - 1 AS idx, id, pos FROM x"
    )

    bucket = _bucket("o_orderkey", N_ORDERS)
    seed = 4000000007
    sql["hash_slots"] = (
        f"SELECT o_orderkey AS key, {bucket} AS bucket, "
        f"{_slot('o_orderkey', seed, 0xABCDEFAB, 0xCDEFABCD, 0)} AS slot1, "
        f"{_slot('o_orderkey', seed, 0xEFABCDEF, 0xBAFEDCBA, 192)} AS slot2, "
        f"{_slot('o_orderkey', seed, 0xFEDCBAFE, 0xDCBAFEDC, 384)} AS slot3 FROM orders"
    )
    sql["hash_probe"] = (
        "SELECT l_orderkey, coalesce(o_custkey, 4294967295) AS value, count(*) AS n FROM lineitem "
        "LEFT JOIN (SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'F') ON l_orderkey = o_orderkey GROUP BY 1, 2"
    )
    sql["hash_multivalue_keys"] = (
        "WITH n AS (SELECT o_custkey AS key, count(*) AS count FROM orders GROUP BY 1) "
        "SELECT key, count, CAST(sum(count) OVER (ORDER BY key) - count AS BIGINT) AS \"offset\" FROM n"
    )
    sql["hash_multivalue"] = (
        "SELECT row_number() OVER (ORDER BY o_custkey, o_orderkey) - 1 AS idx, o_custkey AS key, o_orderkey AS value FROM orders"
    )
    sql["hash_compacting"] = (
        "SELECT l_suppkey AS key, row_number() OVER (ORDER BY l_suppkey) - 1 AS idx FROM (SELECT DISTINCT l_suppkey FROM lineitem)"
    )
    return sql
