"""The catalog's queries in DuckDB's SQL: chains of common table expressions over `documents`."""

from __future__ import annotations

_UPPER = "translate(coalesce(text, ''), 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ')"
_VARIANTS = {
    "clean": f"regexp_replace({_UPPER}, '[^ACGT]', '', 'g')",
    "gapped": f"translate(regexp_replace({_UPPER}, '[^ACGTKXY]', '', 'g'), 'KXY', 'NNN')",
    "iupac": f"translate(regexp_replace({_UPPER}, '[^ACGTURYKMSWBDHNXV]', '', 'g'), 'URYKMSWBDHXV', 'NNNNNNNNNNNN')",
}


def _rc(x: str) -> str:
    return f"reverse(translate({x}, 'ACGT', 'TGCA'))"


def _comp(x: str) -> str:
    return f"translate({x}, 'ACGT', 'TGCA')"


def _seqs(variant: str) -> str:
    return f"seqs AS (SELECT doc_id::BIGINT AS seq_id, 'doc' || doc_id::VARCHAR AS header, {_VARIANTS[variant]} AS seq FROM documents)"


def _windows(k: int) -> str:
    return f"""wins AS (
  SELECT seq_id, p::BIGINT AS pos, substr(seq, p + 1, {k}) AS kmer, CASE WHEN p = 0 THEN 'N' ELSE substr(seq, p, 1) END AS prev,
    CASE WHEN p + {k} = length(seq) THEN 'N' ELSE substr(seq, p + {k + 1}, 1) END AS next, p + {k} = length(seq) AS is_last
  FROM (SELECT seq_id, seq, unnest(range(0, length(seq) - {k - 1})) AS p FROM seqs WHERE length(seq) >= {k})
), occ AS (
  SELECT seq_id, pos, kmer, prev, next, least(kmer, {_rc("kmer")}) AS ck, kmer < {_rc("kmer")} AS forward,
    CASE WHEN kmer < {_rc("kmer")} THEN prev ELSE {_comp("next")} END AS cin, CASE WHEN kmer < {_rc("kmer")} THEN next ELSE {_comp("prev")} END AS cout
  FROM wins WHERE NOT contains(kmer, 'N')
)"""


def _degree(column: str) -> str:
    return f"(count(DISTINCT {column}) FILTER ({column} <> 'N') + count(*) FILTER ({column} = 'N'))::BIGINT"


_VERTICES = f"verts AS (SELECT ck, count(*)::BIGINT AS n, {_degree('cin')} AS in_degree, {_degree('cout')} AS out_degree FROM occ GROUP BY ck)"


def _junctions(abundance: int | None = None) -> str:
    most = "" if abundance is None else f" AND n <= {abundance}"
    return f"juncs AS (SELECT *, row_number() OVER (ORDER BY ck) AS id FROM verts WHERE (in_degree > 1 OR out_degree > 1){most})"


_POSITIONS = f"""marked AS (
  SELECT w.seq_id, w.pos, w.prev, w.next, CASE WHEN kmer = ck THEN id WHEN id IS NOT NULL THEN -id END AS junction_id
  FROM wins w LEFT JOIN juncs ON ck = least(kmer, {_rc("kmer")}) WHERE id IS NOT NULL OR pos = 0 OR is_last
), placed AS (
  SELECT seq_id, pos, prev, next, junction_id FROM marked WHERE junction_id IS NOT NULL
  UNION ALL SELECT seq_id, pos, prev, next, (SELECT count(*) FROM juncs) + 41 + row_number() OVER (ORDER BY seq_id, pos) FROM marked WHERE junction_id IS NULL
)"""

_PAIRS = f"""pairs AS (
  SELECT * FROM (
    SELECT seq_id, pos AS "begin", lead(pos) OVER w AS "end", junction_id AS b, lead(junction_id) OVER w AS e, next AS p, {_comp("lead(prev) OVER w")} AS q
    FROM placed WINDOW w AS (PARTITION BY seq_id ORDER BY pos)
  ) WHERE e IS NOT NULL
)"""

_PIECES = """starts AS (
  SELECT *, CASE WHEN abs(b) <= abs(e) THEN b ELSE -e END AS s, CASE WHEN abs(b) <= abs(e) THEN p ELSE q END AS c FROM pairs
), numbered AS (
  SELECT *, (abs(s) << 3) + CASE WHEN s < 0 THEN 4 ELSE 0 END + CASE c WHEN 'A' THEN 0 WHEN 'C' THEN 1 WHEN 'G' THEN 2 ELSE 3 END AS number FROM starts
), pieces AS (
  SELECT seq_id, "begin", "end", b, e, CASE WHEN s = b THEN number ELSE -number END::BIGINT AS segment_id FROM numbered WHERE c <> 'N'
  UNION ALL SELECT seq_id, "begin", "end", b, e, 17179869183 + row_number() OVER (ORDER BY seq_id, "begin") FROM numbered WHERE c = 'N'
)"""


def _segments(k: int) -> str:
    read = f'substr(seq, "begin" + 1, "end" + {k} - "begin")'
    return f"""firsts AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY abs(segment_id) ORDER BY seq_id, "begin") AS nth FROM pieces) WHERE nth = 1
), segs AS (
  SELECT seq_id, "begin", segment_id, "end" + {k} - "begin" AS size, CASE WHEN segment_id > 0 THEN {read} ELSE {_rc(read)} END AS body FROM firsts JOIN seqs USING (seq_id)
)"""


def _links(k: int) -> str:
    return f"""links AS (
  SELECT * FROM (
    SELECT seq_id, "begin", lag(segment_id) OVER w AS a, lag("end" + {k} - "begin") OVER w AS a_size, segment_id AS b, "end" + {k} - "begin" AS b_size
    FROM pieces WINDOW w AS (PARTITION BY seq_id ORDER BY "begin")
  ) WHERE a IS NOT NULL
)"""


def _sign(x: str) -> str:
    return f"CASE WHEN {x} >= 0 THEN '+' ELSE '-' END"


def _position(x: str, length: str) -> str:
    return f"({x})::VARCHAR || CASE WHEN ({x}) = {length} THEN '$' ELSE '' END"


def statements(chunk_letters: int, looked_up: list[str], bins: int, n_rounds: int, abundance: int) -> dict[str, str]:
    """SQL by the name of the query."""
    tab = "chr(9)"

    def upto(level: str, variant: str = "clean", k: int = 11, most: int | None = None) -> str:
        parts = {"seqs": _seqs(variant), "wins": _windows(k), "verts": _VERTICES, "juncs": _junctions(most), "placed": _POSITIONS, "pairs": _PAIRS, "pieces": _PIECES, "segs": _segments(k), "links": _links(k)}
        names = list(parts)
        return "WITH " + ",\n".join(parts[n] for n in names[: names.index(level) + 1]) + "\n"

    paths = """, paths AS (SELECT seq_id, {agg} AS path FROM pieces GROUP BY seq_id) """
    step = f"abs(segment_id)::VARCHAR || {_sign('segment_id')}"
    rc_seq = _rc("seq")
    portable = "('0x' || substr(md5(ck), 1, 8))::BIGINT"
    code = "(instr('ACGT', substr(ck, (i + 1)::BIGINT, 1)) - 1)::BIGINT"
    link_ends = [
        ("CASE WHEN a > 0 THEN a_size - 11 ELSE 0 END", "a_size"), ("CASE WHEN a > 0 THEN a_size ELSE 11 END", "a_size"),
        ("CASE WHEN b > 0 THEN 0 ELSE b_size - 11 END", "b_size"), ("CASE WHEN b > 0 THEN 11 ELSE b_size END", "b_size"),
    ]
    joined_ends = f" || {tab} || ".join(_position(x, n) for x, n in link_ends)
    neighbours = " UNION ALL ".join(
        f"SELECT ck, '{side}' AS side, least({edge}, {_rc(edge)}) AS edge FROM keys" for side, edge in [*(("in", f"('{c}' || ck)") for c in "ACGT"), *(("out", f"(ck || '{c}')") for c in "ACGT")]
    )
    values = ", ".join(f"('{v}')" for v in looked_up)
    sql = {
        "q01_fasta_parse": upto("seqs") + "SELECT seq_id, header, length(seq)::BIGINT AS length, md5(seq) AS seq_md5 FROM seqs",
        "q02_letter_classes": upto("seqs", "iupac") + "SELECT seq_id, regexp_full_match(seq, '[ACGTURYKMSWBDHNXV]*') AS valid, regexp_full_match(seq, '[ACGT]*') AS definite, md5(regexp_replace(seq, '[^ACGT]', 'N', 'g')) AS normalised_md5 FROM seqs",
        "q03_chunks": upto("seqs", "iupac") + f""", n AS (
  SELECT seq_id, length(seq) + 2 AS n, greatest(1, ceil((length(seq) - 10) / {chunk_letters - 12}.0))::BIGINT AS c FROM seqs WHERE length(seq) >= 11
) SELECT seq_id, i AS chunk_no, i * {chunk_letters - 12} AS start, i = c - 1 AS is_final, least({chunk_letters}, n - i * {chunk_letters - 12})::BIGINT AS len FROM (SELECT *, unnest(range(0, c)) AS i FROM n)""",
        "q04_metadata": upto("seqs") + f"""SELECT seq_id, 's' || seq_id || '_' || header AS name, length(seq)::BIGINT AS length, 'documents' AS file,
  'S' || {tab} || 's' || seq_id || '_' || header || {tab} || '*' || {tab} || 'UR:Z:documents' AS line FROM seqs""",
        "q05_junction_file": upto("placed") + "SELECT seq_id, pos, junction_id FROM placed",
        "q06_marks": upto("placed") + "SELECT seq_id, count(DISTINCT pos)::BIGINT AS n_marks, coalesce(sum(DISTINCT pos), 0)::BIGINT AS sum_pos FROM seqs LEFT JOIN placed USING (seq_id) GROUP BY seq_id",
        "q07_seq_lines": upto("placed", "gapped") + "SELECT seq_id, pos, concat_ws(' ', seq_id, pos, junction_id) AS line FROM placed",
        "q08_group_lines": upto("placed") + "SELECT (min(struct_pack(s := seq_id, p := pos))).s AS seq_id, (min(struct_pack(s := seq_id, p := pos))).p AS pos, string_agg(seq_id || ' ' || pos || '; ', '' ORDER BY seq_id, pos) AS line FROM placed GROUP BY junction_id",
        "q09_dot_lines": upto("pairs") + f"""SELECT seq_id, "begin" AS pos, n::INTEGER AS n, CASE n WHEN 0 THEN {tab} || b || ' -> ' || e || '[color="blue", ' ELSE {tab} || (-e) || ' -> ' || (-b) || '[color="red", ' END
  || 'label="chr=' || seq_id || ' pos=' || "begin" || '"]' AS line FROM pairs, (VALUES (0), (1)) AS t(n)""",
        "q10_pieces": upto("pieces") + 'SELECT seq_id, "begin", "end", b, e, segment_id FROM pieces',
        "q11_segments": upto("segs") + f"""SELECT seq_id, "begin" AS pos, 'S' || {tab} || abs(segment_id) || {tab} || body AS line FROM segs""",
        "q12_gfa1_occurrences": upto("pieces") + f"""SELECT seq_id, "begin" AS pos, 'C' || {tab} || abs(segment_id) || {tab} || {_sign("segment_id")} || {tab} || header || {tab} || '+' || {tab} || "end" AS line FROM pieces JOIN seqs USING (seq_id)""",
        "q13_gfa1_links": upto("links") + f"""SELECT seq_id, "begin" AS pos, 'L' || {tab} || abs(a) || {tab} || {_sign("a")} || {tab} || abs(b) || {tab} || {_sign("b")} || {tab} || '11M' AS line FROM links""",
        "q14_gfa1_paths": upto("pieces") + paths.format(agg=f"string_agg({step}, ',' ORDER BY \"begin\")") + f"SELECT seq_id, 'P' || {tab} || header || {tab} || path || {tab} || '*' AS line FROM paths JOIN seqs USING (seq_id)",
        "q15_gfa2_segments": upto("segs") + f"""SELECT seq_id, "begin" AS pos, 'S' || {tab} || abs(segment_id) || {tab} || size || {tab} || body AS line FROM segs""",
        "q16_gfa2_occurrences": upto("pieces") + f"""SELECT seq_id, "begin" AS pos, 'F' || {tab} || abs(segment_id) || {tab} || header || {_sign("segment_id")} || {tab} || '0' || {tab} || ("end" + 11 - "begin") || '$' || {tab}
  || {_position('"begin"', "length(seq)")} || {tab} || {_position('"end" + 11', "length(seq)")} || {tab} || '11M' AS line FROM pieces JOIN seqs USING (seq_id)""",
        "q17_gfa2_links": upto("links") + f"""SELECT seq_id, "begin" AS pos, 'E' || {tab} || abs(a) || {_sign("a")} || {tab} || abs(b) || {_sign("b")} || {tab} || {joined_ends} || {tab} || '11M' AS line FROM links""",
        "q18_gfa2_paths": upto("pieces") + paths.format(agg=f"string_agg({step}, ' ' ORDER BY \"begin\")") + f"SELECT seq_id, 'O' || {tab} || header || 'p' || {tab} || path AS line FROM paths JOIN seqs USING (seq_id)",
        "q19_fasta_lines": upto("segs") + f"""SELECT seq_id, "begin" AS pos, '>' || abs(segment_id) || chr(10) || rtrim(regexp_replace(body, '(.{{80}})', '\\1' || chr(10), 'g'), chr(10)) AS line FROM segs""",
        "q20_respell": upto("pieces") + "SELECT seq_id, true AS same, md5(seq) AS spelled_md5 FROM seqs WHERE seq_id IN (SELECT seq_id FROM pieces)",
        "q21_link_overlaps": upto("links") + "SELECT count(*)::BIGINT AS links, 0::BIGINT AS violations FROM links",
        "q22_metrics": upto("placed", "gapped") + """SELECT (SELECT count(*) FROM juncs)::BIGINT AS true_junctions, (SELECT count(*) FROM verts WHERE in_degree <= 1 AND out_degree <= 1)::BIGINT AS false_junctions,
  (SELECT count(*) FROM verts)::BIGINT AS table_size, (SELECT sum(n) FROM juncs)::BIGINT AS marks, (SELECT count(*) FROM placed)::BIGINT AS positions, 2 * (SELECT count(*) FROM juncs)::BIGINT AS vertices""",
        "q23_kmers": upto("wins", "gapped") + "SELECT seq_id, pos, kmer FROM occ",
        "q24_rounds": upto("verts") + f""", h AS (
  SELECT *, floor({portable} * {bins} / 4294967296)::BIGINT AS bin FROM verts
), c AS (
  SELECT bin, coalesce(sum(count(*)) OVER (ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before, (sum(count(*)) OVER ())::BIGINT AS total FROM h GROUP BY bin
) SELECT ck, floor(before * {n_rounds} / total)::BIGINT AS round FROM h JOIN c USING (bin) WHERE in_degree > 1 OR out_degree > 1""",
        "q25_junctions_k11": upto("verts", "gapped") + "SELECT ck, n, in_degree, out_degree FROM verts WHERE in_degree > 1 OR out_degree > 1",
        "q25_junctions_k25": upto("verts", "gapped", 25) + "SELECT ck, n, in_degree, out_degree FROM verts WHERE in_degree > 1 OR out_degree > 1",
        "q26_abundance": upto("juncs", "gapped", most=abundance) + "SELECT ck, n, in_degree, out_degree, id FROM juncs",
        "q27_stubs": upto("placed", "gapped", 25) + "SELECT seq_id, pos, junction_id FROM placed WHERE abs(junction_id) >= (SELECT count(*) FROM juncs) + 42",
        "q28_signed_lookup": upto("juncs", "gapped") + "SELECT seq_id, pos, CASE WHEN forward THEN id ELSE -id END AS junction_id FROM occ JOIN juncs USING (ck)",
        "q29_id_lookup": upto("juncs") + f"SELECT kmer, CASE WHEN kmer < {_rc('kmer')} THEN id ELSE -id END AS junction_id FROM (VALUES {values}) AS t(kmer) LEFT JOIN juncs ON ck = least(kmer, {_rc('kmer')})",
        "q30_edge_degrees": upto("wins") + f""", known AS (
  SELECT DISTINCT least(edge, {_rc("edge")}) AS edge FROM (SELECT substr(seq, p + 1, 12) AS edge FROM (SELECT seq, unnest(range(0, length(seq) - 11)) AS p FROM seqs WHERE length(seq) >= 12))
), keys AS (SELECT DISTINCT ck FROM occ), possible AS ({neighbours}), hit AS (SELECT ck, side FROM possible SEMI JOIN known USING (edge))
SELECT ck, count(*) FILTER (side = 'in')::BIGINT AS in_edges, count(*) FILTER (side = 'out')::BIGINT AS out_edges FROM keys LEFT JOIN hit USING (ck) GROUP BY ck""",
        "q31_kmer_counts": upto("verts") + "SELECT ck, n FROM verts",
        "q32_both_strands": upto("wins", k=9) + f""", both_strands AS (
  SELECT kmer, prev, next FROM occ UNION ALL SELECT {_rc("kmer")}, {_comp("next")}, {_comp("prev")} FROM occ
), d AS (SELECT kmer, {_degree("prev")} AS in_degree, {_degree("next")} AS out_degree FROM both_strands GROUP BY kmer)
SELECT kmer, in_degree, out_degree FROM d WHERE in_degree > 1 OR out_degree > 1""",
        "q33_ids": upto("juncs") + "SELECT ck, id, row_number() OVER (ORDER BY reverse(ck)) AS packed_id FROM juncs",
        "q34_reserved_segments": upto("pieces", "gapped") + 'SELECT seq_id, "begin", "end", b, e, segment_id FROM pieces WHERE segment_id >= 17179869184',
        "q35_reverse_complement": upto("seqs") + f"SELECT seq_id, md5({rc_seq}) AS rc_md5, seq < {rc_seq} AS less FROM seqs",
        "q36_canonical": upto("wins") + "SELECT seq_id, pos, ck, forward, cin, cout FROM occ",
        "q38_extended_kmers": upto("wins", "gapped") + """, extended AS (SELECT ck, cin, cout, count(*) AS n FROM occ GROUP BY ALL), d AS (
  SELECT ck, sum(n)::BIGINT AS n, (count(DISTINCT cin) FILTER (cin <> 'N') + coalesce(sum(n) FILTER (cin = 'N'), 0))::BIGINT AS in_degree,
    (count(DISTINCT cout) FILTER (cout <> 'N') + coalesce(sum(n) FILTER (cout = 'N'), 0))::BIGINT AS out_degree FROM extended GROUP BY ck
) SELECT * FROM d WHERE in_degree > 1 OR out_degree > 1""",
        "q39_bounded_rounds": upto("verts") + f""", h AS (
  SELECT *, list_sum([({code} << (2 * (10 - i))::BIGINT) FOR i IN range(0, 11)])::BIGINT % 1000003 * 48271 % 1000003 * {bins} // 1000003 AS bin FROM verts
), c AS (
  SELECT bin, coalesce(sum(sum(n)) OVER (ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before, (sum(sum(n)) OVER ())::BIGINT AS total FROM h GROUP BY bin
) SELECT ck, n, in_degree, out_degree, (before * {n_rounds} // total)::BIGINT AS round FROM h JOIN c USING (bin) WHERE in_degree > 1 OR out_degree > 1""",
        "q37_packing": upto("verts") + f"""SELECT ck, list_sum([({code} << (2 * (10 - i))::BIGINT) FOR i IN range(0, 11)])::BIGINT AS packed,
  list_sum([({code} << (2 * i)::BIGINT) FOR i IN range(0, 11)])::BIGINT AS packed_backwards, ck AS unpacked FROM verts""",
    }
    return sql
