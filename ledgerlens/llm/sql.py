"""DuckDB SQL for the queries that SQL can express."""

from .spots import ANCHORS

TRIM = "' ' || chr(9) || chr(13) || chr(11) || chr(12)"


def line_dedup(docs: str, max_share: float = 0.1, min_pages: int = 3) -> str:
    """CTEs that end in ``cleaned``: the rows of ``docs`` (with ``rid``, a row number) and ``out``, ``nl``, ``nd``."""
    return f"""
  _rows AS (SELECT *, string_split(text, chr(10)) AS ls FROM {docs}),
  _pages AS (SELECT DISTINCT source, text, ls FROM _rows WHERE text IS NOT NULL),
  _lines AS (SELECT source, l, count(*) AS n FROM (
      SELECT source, unnest(list_distinct(list_transform(ls, lambda x: trim(x, {TRIM})))) AS l FROM _pages)
    WHERE l <> '' GROUP BY ALL HAVING count(*) >= {min_pages}),
  _hosts AS (SELECT source, count(*) AS pages FROM _pages GROUP BY ALL),
  _bad AS (SELECT l.source, list(l) AS bad FROM _lines l JOIN _hosts h ON l.source IS NOT DISTINCT FROM h.source
    WHERE n > pages * CAST({max_share} AS DOUBLE) GROUP BY l.source),
  _cut AS (SELECT r.*, list_filter(ls, lambda x: NOT coalesce(list_contains(bad, trim(x, {TRIM})), false)) AS ks
    FROM _rows r LEFT JOIN _bad b ON r.source IS NOT DISTINCT FROM b.source),
  _done AS (SELECT *, len(list_filter(ks, lambda x: trim(x, {TRIM}) <> '')) > 0 AS ok FROM _cut),
  cleaned AS (SELECT *, CASE WHEN ok THEN array_to_string(ks, chr(10)) ELSE text END AS cut_text,
      coalesce(len(ls), 0)::BIGINT AS nl, (CASE WHEN ok THEN len(ls) - len(ks) ELSE 0 END)::BIGINT AS nd FROM _done)"""


def mixing(docs: str, text: str = "text", seed: str = "mix") -> str:
    """CTEs that end in ``mixed``: the rows of ``docs`` with size, source_size, target, whole, cut, rest, at_cut and h."""
    return f"""
  _sized AS (SELECT *, coalesce(len(regexp_extract_all({text}, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
      md5('{seed}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM {docs}),
  _src AS (SELECT source, sum(size)::BIGINT AS size FROM _sized GROUP BY source),
  _wt AS (SELECT *, [3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::INT AS w,
      (size * 2)::DOUBLE AS cap FROM _src),
  _open AS (SELECT *, (sum(size) OVER ())::DOUBLE * CAST(1.5 AS DOUBLE)
        - coalesce(sum(cap) OVER (ORDER BY cap / w, w, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lft,
      (sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY cap / w, w, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE AS opn
    FROM _wt),
  _lvl AS (SELECT *, max(CASE WHEN cap * opn >= lft * w THEN lft / opn END) OVER () AS lv FROM _open),
  _plan AS (SELECT source, size AS source_size, CASE WHEN lv IS NULL OR cap <= lv * w THEN cap ELSE lv * w END AS target FROM _lvl),
  _reps AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS whole FROM _plan),
  _sum AS (SELECT r.source, h, g, floor(target)::BIGINT - whole * source_size AS extra,
      sum(g) OVER (PARTITION BY r.source ORDER BY h) AS till
    FROM (SELECT source, h, sum(size) AS g FROM _sized GROUP BY ALL) s JOIN _reps r ON s.source IS NOT DISTINCT FROM r.source),
  _edge AS (SELECT source, h AS cut, g::BIGINT AS at_cut, (extra - till + g)::BIGINT AS rest FROM _sum
    WHERE till - g < extra AND extra <= till),
  mixed AS (SELECT d.*, source_size, target, whole, cut, at_cut, rest FROM _sized d
    JOIN _reps r ON d.source IS NOT DISTINCT FROM r.source
    LEFT JOIN _edge e ON d.source IS NOT DISTINCT FROM e.source)"""


TAKEN = "(size * whole + CASE WHEN h < cut THEN size WHEN h = cut THEN floor(size * rest / at_cut) ELSE 0 END)::BIGINT"

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

def signatures(text: str) -> str:
    """The fingerprint set of a text as a list."""
    anchors = ", ".join(f"'{a}'" for a in ANCHORS)
    words = rf"trim(regexp_replace(lower({text}), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"
    found = (
        f"list_filter(list_transform(ws, lambda x, i: {{'w': x, 'a': CASE WHEN i = 1 THEN '^' WHEN ws[i - 1] IN ({anchors}) THEN ws[i - 1] END}}),"
        f" lambda x: x.w NOT IN ({anchors}))"
    )
    chain = (
        "list_filter(list_transform(cs, lambda x, i: CASE WHEN x.a IS NOT NULL OR i = 1 THEN "
        "md5(concat_ws(' ', coalesce(x.a, '^'), x.w, cs[i + 1].w))[1:8] END), lambda x: x IS NOT NULL)"
    )
    return (
        f"(SELECT CASE WHEN wd = '' THEN [] WHEN len(cs) = 0 THEN [md5(wd)[1:8]] ELSE list_sort(list_distinct({chain})) END"
        f" FROM (SELECT wd, {found} AS cs FROM (SELECT wd, string_split(wd, ' ') AS ws FROM (SELECT {words} AS wd))))"
    )


def likeness(a: str, b: str) -> str:
    both = f"len(list_intersect({a}, {b}))"
    return f"CASE WHEN len({a}) = 0 AND len({b}) = 0 THEN 1.0::DOUBLE ELSE {both}::DOUBLE / (len({a}) + len({b}) - {both}) END"


def crc32(text: str) -> str:
    """Unsigned crc32 of an ASCII text: its bytes come in, eight shifts after each; 3988292384 is the fixed polynomial."""
    steps = f"flatten(list_transform(string_split({text}, ''), lambda x: [ord(x)::BIGINT] || list_transform(range(8), lambda y: -1::BIGINT)))"
    shift = "xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384::BIGINT ELSE 0::BIGINT END)"
    return f"xor(list_reduce([4294967295::BIGINT] || {steps}, lambda x, y: CASE WHEN y >= 0 THEN xor(x, y) ELSE {shift} END), 4294967295::BIGINT)"


def merkle(docs: str) -> str:
    """CTEs that end in ``folded``: the leaves with proof and folded root. Level by level, once per group and once over the groups."""

    def net(c: str) -> str:
        return f"coalesce(octet_length(encode(CAST({c} AS VARCHAR))) || ':' || CAST({c} AS VARCHAR), '-')"

    head, tail = " || ".join(map(net, ("doc_id", "source", "lang"))), net("text")

    def levels(out: str, rows: str) -> str:
        return f"""{out} AS (SELECT 0 AS lvl, grp, pos, n, h FROM {rows} UNION ALL
      SELECT lvl + 1, grp, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM {out} WHERE n > 1 GROUP BY lvl, grp, pos // 2, n)"""

    def step(out: str, start: str, nodes: str, keep: str) -> str:
        near = f"LEFT JOIN {nodes} s ON s.lvl = f.lvl AND s.grp = f.grp AND s.pos = xor(f.pos, 1)"
        return f"""{out} AS ({start} UNION ALL
      SELECT f.lvl + 1, f.rid, {keep}, f.grp, f.pos // 2, (f.n + 1) // 2, f.proof || coalesce(s.h, ''),
        sha256(CASE WHEN f.pos % 2 = 1 THEN s.h || f.now ELSE f.now || coalesce(s.h, '') END)
      FROM {out} f {near} WHERE f.n > 1)"""

    return f"""
  _leaf AS (SELECT doc_id, row_number() OVER () AS rid, coalesce('=' || lang, '') AS grp, sha256({head} || {net("n_chars")} || {tail}) AS h,
      CASE WHEN {crc32("CAST(doc_id AS VARCHAR)")} % 7 = 0 THEN sha256({head} || {net("(n_chars + 1)")} || {tail}) END AS changed FROM {docs}),
  _num AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, h) - 1 AS pos, count(*) OVER (PARTITION BY grp) AS n FROM _leaf),
  {levels("_tree", "_num")},
  _subs AS (SELECT grp AS name, h FROM _tree WHERE n = 1),
  _subn AS (SELECT '' AS grp, name, row_number() OVER (ORDER BY name) - 1 AS pos, count(*) OVER () AS n, h FROM _subs),
  {levels("_upper", "_subn")},
  {step("_fold", "SELECT 0 AS lvl, rid, grp AS name, grp, pos, n, '' AS proof, coalesce(changed, h) AS now FROM _num", "_tree", "f.name")},
  {step("_fold2", "SELECT 0 AS lvl, f.rid, f.name, s.grp, s.pos, s.n, f.proof, f.now FROM _fold f JOIN _subn s ON s.name = f.name WHERE f.n = 1", "_upper", "f.name")},
  folded AS (SELECT l.doc_id, l.h AS leaf, s.h AS subroot, r.h AS root, sha256(f.proof) AS proof_sha256, f.now AS folded_root
    FROM _leaf l JOIN _fold2 f ON f.rid = l.rid AND f.n = 1 JOIN _subs s ON s.name = l.grp CROSS JOIN (SELECT h FROM _upper WHERE n = 1) r)"""


# Places in the grammar, what insertions write there, and where they lead.
INSERTS = """(VALUES ('-', '', []::VARCHAR[], '-'), ('-', 'I', ['user:'], 'u'), ('-', 'II', ['user:', 'assistant:'], 'a'), ('s', '', [], 's'),
  ('s', 'I', ['user:'], 'u'), ('s', 'II', ['user:', 'assistant:'], 'a'), ('u', '', [], 'u'), ('u', 'I', ['assistant:'], 'a'),
  ('u', 'II', ['assistant:', 'user:'], 'u'), ('a', '', [], 'a'), ('a', 'I', ['user:'], 'u'), ('a', 'II', ['user:', 'assistant:'], 'a')) v(p, ins, added, q)"""


def repair(rows: str) -> str:
    """CTEs that end in ``repaired``: turn by turn the cheapest way to each place of the grammar."""
    space = "[\\x20\\x09-\\x0D]"
    key = "coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')"
    expected = "CASE WHEN q = 'u' THEN 'a' ELSE 'u' END"
    new_role = "CASE WHEN q = 'u' THEN 'assistant:' ELSE 'user:' END"
    return f"""
  _key AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc32(key)} % 20 AS k FROM {rows}),
  _hit AS (SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role,
      CASE WHEN k = 1 THEN '' WHEN k = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
      unnest(CASE WHEN k = 3 THEN [0, 1] ELSE [0] END) AS copy FROM _key WHERE k <> 0),
  _at AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i FROM _hit),
  _seen AS (SELECT *, role[1:1] AS ini, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS nth,
      lag(role[1:1]) OVER (PARTITION BY conv_id ORDER BY i) AS prev, count(*) OVER (PARTITION BY conv_id) AS n,
      regexp_extract(text, '([^\\x20\\x09-\\x0D]){space}*$', 1) AS fin FROM _at),
  _turn AS (SELECT *, CASE WHEN fin = '' THEN 'b' WHEN nth > 1 THEN 'd' WHEN fin IN ('.', '!', '?') THEN '' ELSE 't' END AS f FROM _seen),
  _step AS (
    SELECT DISTINCT conv_id, 0::BIGINT AS i, '-' AS p, {{'c': 0::BIGINT, 'a': '', 't': []::VARCHAR[]}} AS best FROM _turn
    UNION ALL
    SELECT conv_id, i + 1, r, min({{'c': c, 'a': a, 't': t}}) FROM (
      SELECT s.conv_id, s.i, unnest([
          {{'r': q, 'c': s.best.c + 5 * len(ins) + 2, 'a': s.best.a || ins || 'D', 't': s.best.t || added}},
          CASE WHEN f IN ('', 't') AND (ini = {expected} OR (q = '-' AND ini = 's')) THEN
            {{'r': ini, 'c': s.best.c + 5 * len(ins) + 5 * len(f), 'a': s.best.a || ins || 'K', 't': s.best.t || added || [role || ':' || text]}} END,
          CASE WHEN f IN ('', 't') THEN
            {{'r': {expected}, 'c': s.best.c + 5 * len(ins) + 5 * len(f) + 1, 'a': s.best.a || ins || 'R', 't': s.best.t || added || [{new_role} || text]}} END
        ], recursive := true)
      FROM _step s JOIN {INSERTS} ON v.p = s.p JOIN _turn x ON x.conv_id IS NOT DISTINCT FROM s.conv_id AND x.i = s.i + 1)
    WHERE r IS NOT NULL GROUP BY conv_id, i, r),
  _end AS (SELECT conv_id, min({{'c': s.best.c + 5 * len(ins), 'a': s.best.a || ins, 't': s.best.t || added}}) AS best
    FROM _step s JOIN {INSERTS} ON v.p = s.p JOIN (SELECT conv_id AS cid, max(n) AS n FROM _turn GROUP BY ALL) m
      ON m.cid IS NOT DISTINCT FROM s.conv_id AND m.n = s.i WHERE q IN ('-', 'a') GROUP BY conv_id),
  _tally AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (f = 'b') AS blank,
      count(*) FILTER (f = 'd') AS duplicate, count(*) FILTER (f = 't') AS truncated,
      count(*) FILTER (prev IS NOT NULL AND prev || ini NOT IN ('su', 'ua', 'au')) AS illegal FROM _turn GROUP BY conv_id),
  _ids AS (SELECT DISTINCT conv_id FROM {rows}),
  repaired AS (SELECT i.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
      coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(best.c, 0) AS cost, coalesce(best.a, '') AS audit,
      sha256(coalesce(array_to_string(best.t, chr(10)), '')) AS repaired_sha256
    FROM _ids i LEFT JOIN _tally t ON t.conv_id IS NOT DISTINCT FROM i.conv_id LEFT JOIN _end e ON e.conv_id IS NOT DISTINCT FROM i.conv_id)"""


SQL = {
    "op1_line_dedup": f"""WITH {line_dedup("documents")}
SELECT doc_id, nl AS n_lines, nd AS n_dropped, sha256(coalesce(cut_text, '')) AS text_sha256 FROM cleaned""",
    "op4_source_mixing": f"""WITH {mixing("documents")}
SELECT doc_id, size, source_size, target, {TAKEN} AS taken FROM mixed""",
    "op5_exact_dedup": f"""WITH d AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}')) AS sha FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY sha) AS keep_id, count(*) OVER (PARTITION BY sha) AS group_size,
  row_number() OVER (PARTITION BY sha ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha AS text_sha256 FROM d""",
    "op10_fingerprints": f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
  n AS (SELECT *, lead(text) OVER w AS nx, first(text) OVER (ORDER BY doc_id DESC NULLS LAST, text) AS fs FROM d
    WINDOW w AS (ORDER BY doc_id DESC NULLS LAST, text)),
  e AS (SELECT doc_id, text, coalesce(nx, fs) AS nx, length(text) - length(text) // 3 AS k FROM n),
  f AS (SELECT doc_id, text, nx, text[1:k] || nx[1:length(text) - k] AS ed FROM e),
  g AS (SELECT doc_id, text, ed, {signatures("text")} AS s, {signatures("ed")} AS es, {signatures("nx")} AS ns FROM f)
SELECT doc_id, length(text)::BIGINT AS n_chars, sha256(ed) AS edited_sha256, array_to_string(s, ' ') AS fingerprint,
  array_to_string(es, ' ') AS edited_fingerprint, {likeness("s", "es")} AS near_edited, {likeness("s", "ns")} AS near_next FROM g""",
    "op11_conversation_repair": f"""WITH RECURSIVE {repair("conversations")}
SELECT * FROM repaired""",
    "op12_merkle": f"""WITH RECURSIVE {merkle("documents")}
SELECT *, folded_root = root AS verified FROM folded""",
}
