"""DuckDB SQL of the operators on bytes, vectors and conversations."""

from __future__ import annotations

SUFFIXES = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS b, strlen(coalesce(text, '')) AS n FROM documents),
part AS (SELECT doc_id, low, substr(b, 2 * low + 1, 2 * 499) AS bytes, least(400, n - 99 - low) AS wins FROM d, unnest(range(0, n - 99, 400)) t(low)),
win AS (SELECT doc_id, low + i AS i, md5(substr(bytes, 2 * i + 1, 200)) AS gram FROM part, unnest(range(wins)) t(i)),
firsts AS (SELECT gram, min((doc_id, i)) AS least FROM win GROUP BY gram),
dup AS (SELECT doc_id, i FROM win JOIN firsts USING (gram) WHERE least < (doc_id, i)),
step AS (SELECT *, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM dup),
run AS (SELECT doc_id, i, sum(CASE WHEN before IS NULL OR i > before + 100 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS r FROM step),
gone AS (SELECT doc_id, min(i) AS a, max(i) + 100 AS z FROM run GROUP BY doc_id, r),
cut AS (SELECT doc_id, a, z, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS prev, lead(a) OVER (PARTITION BY doc_id ORDER BY a) IS NULL AS is_last FROM gone),
k AS (SELECT doc_id, CAST(sum(z - a) AS BIGINT) AS n_removed, count(*) AS n_spans,
    string_agg(substr(b, 2 * prev + 1, 2 * (a - prev)) || CASE WHEN is_last THEN substr(b, 2 * z + 1) ELSE '' END, '' ORDER BY a) AS kept FROM cut JOIN d USING (doc_id) GROUP BY doc_id)
SELECT d.doc_id, CAST(n AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(CASE WHEN k.doc_id IS NULL THEN b ELSE kept END)) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)"""


def codes() -> str:
    """Two rounds, written out one after the other."""
    with_books = [
        """v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS w, len(embedding) // 16 AS n FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT vec_id, CAST(q AS INT) AS part, w[q * n + 1:(q + 1) * n] AS c FROM v, range(16) t(q)),
first AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM (SELECT vec_id FROM v ORDER BY vec_id LIMIT 64)),
b0 AS (SELECT part, entry, c FROM p JOIN first USING (vec_id))"""
    ]
    near = "a{k} AS (SELECT vec_id, p.part, any_value(p.c) AS c, arg_min(b.entry, (list_sum(list_transform(list_zip(p.c, b.c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), b.entry)) AS entry, CAST(min(list_sum(list_transform(list_zip(p.c, b.c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) AS BIGINT) AS error FROM p JOIN b{k} b USING (part) GROUP BY vec_id, p.part)"
    mean = """m{k} AS (SELECT part, entry, list(CAST((total - ((total % n) + n) % n) // n AS BIGINT) ORDER BY j) AS c FROM
  (SELECT part, entry, j, CAST(sum(x) AS BIGINT) AS total, count(*) AS n FROM (SELECT part, entry, unnest(c) AS x, generate_subscripts(c, 1) AS j FROM a{k}) GROUP BY ALL) GROUP BY ALL),
b{next} AS (SELECT part, entry, coalesce(m.c, b.c) AS c FROM b{k} b LEFT JOIN m{k} m USING (part, entry))"""
    for k in range(2):
        with_books += [near.format(k=k), mean.format(k=k, next=k + 1)]
    with_books.append(near.format(k=2))
    return "WITH " + ",\n".join(with_books) + """,
e AS (SELECT vec_id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(error) AS BIGINT) AS error FROM a2 GROUP BY ALL),
h AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b2)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM e JOIN v USING (vec_id), h"""


def repair() -> str:
    """Cheapest audits turn by turn: for each state the least `cost, audit` as one string."""

    def plus(v: str, cost: str, letter: str) -> str:
        return f"lpad(CAST(CAST(substr({v}, 1, 6) AS INT) + {cost} AS VARCHAR), 6, '0') || substr({v}, 7) || '{letter}'"

    def inserted(names: list[str]) -> str:
        """States after up to two inserts."""
        s = dict(zip("osua", names, strict=True))
        once_u = ", ".join([s["u"], *(plus(s[x], "3", "I") for x in "osa")])
        return f"{s['o']} AS o, {s['s']} AS s, least({once_u}) AS u, {s['a']} AS a0"

    return rf"""
WITH RECURSIVE t AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, encode(concat(coalesce(CAST(conv_id AS VARCHAR), ' '), ':', coalesce(CAST(turn AS VARCHAR), ' '))) AS key FROM conversations),
tab AS (SELECT list(list_reduce(list_prepend(i::BIGINT, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) r(i)),
x AS (SELECT conv_id, turn, role, text, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(key), '..'), lambda h: ('0x' || h)::BIGINT)), lambda c, b: xor(c >> 8, tab.t[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS deal FROM t, tab),
y AS (SELECT conv_id, turn, CASE WHEN deal = 4 THEN 'user' ELSE role END AS role, CASE deal WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE WHEN deal = 3 THEN 2 ELSE 1 END)) AS copy FROM x WHERE deal <> 0),
z AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i FROM y),
f AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'd' WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 't' ELSE '-' END AS fault,
  role[1] AS who, lag(role[1]) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM z),
c AS (SELECT conv_id, count(turn) AS numbered, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, count(*) FILTER (WHERE fault = 'b') AS blank, count(*) FILTER (WHERE fault = 'd') AS duplicate, count(*) FILTER (WHERE fault = 't') AS truncated,
  count(*) FILTER (WHERE before IS NOT NULL AND (before || who) NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY ALL),
walk AS (SELECT conv_id, 0 AS i, '000000' AS o, CAST(NULL AS VARCHAR) AS s, '000003I' AS u, '000006II' AS a FROM c
  UNION ALL SELECT conv_id, i, o, s, u, least(a0, {plus("u", "3", "I")}) AS a FROM (
    SELECT conv_id, i, {inserted(["o1", "s1", "u1", "a1"])} FROM (
      SELECT w.conv_id, f.i, {plus("o", "4", "D")} AS o1,
        least({plus("s", "4", "D")}, CASE WHEN stays AND who = 's' THEN {plus("o", "more", "K")} END) AS s1,
        least({plus("u", "4", "D")}, CASE WHEN stays THEN least({", ".join(plus(x, "3 + more", "R") for x in "osa")}) END, CASE WHEN stays AND who = 'u' THEN least({", ".join(plus(x, "more", "K") for x in "osa")}) END) AS u1,
        least({plus("a", "4", "D")}, CASE WHEN stays THEN {plus("u", "3 + more", "R")} END, CASE WHEN stays AND who = 'a' THEN {plus("u", "more", "K")} END) AS a1
      FROM walk w JOIN (SELECT conv_id, i, who, fault NOT IN ('b', 'd') AS stays, CASE WHEN fault = 't' THEN 3 ELSE 0 END AS more FROM f) f ON f.conv_id = w.conv_id AND f.i = w.i + 1))),
best AS (SELECT conv_id, arg_max(least(o, a), i) AS best FROM walk GROUP BY ALL),
au AS (SELECT conv_id, CAST(substr(best, 1, 6) AS BIGINT) AS cost, substr(best, 7) AS audit FROM best),
op AS (SELECT conv_id, unnest(string_split(audit, '')) AS e, unnest(range(1, len(audit) + 1)) AS k FROM au WHERE audit <> ''),
nr AS (SELECT *, sum(CASE WHEN e <> 'I' THEN 1 ELSE 0 END) OVER w AS i, sum(CASE WHEN e <> 'D' THEN 1 ELSE 0 END) OVER w AS n FROM op WINDOW w AS (PARTITION BY conv_id ORDER BY k)),
said AS (SELECT nr.conv_id, k, e, n, role, text, who, max(CASE WHEN n = 1 AND e = 'K' AND who = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY nr.conv_id) AS sys FROM nr LEFT JOIN f ON f.conv_id = nr.conv_id AND f.i = nr.i AND e <> 'I' WHERE e <> 'D'),
fixed AS (SELECT conv_id, string_agg(CASE WHEN e = 'K' THEN role WHEN (n - sys) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN e = 'I' THEN '' ELSE text END, chr(10) ORDER BY k) AS lines FROM said GROUP BY conv_id)
SELECT o.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(lines, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN c USING (conv_id) LEFT JOIN au USING (conv_id) LEFT JOIN fixed USING (conv_id)"""
