"""DuckDB statements for the queries that SQL can express."""

SQL: dict[str, str] = {}

SQL["op8_mix_sources"] = r"""
WITH docs AS (
  SELECT doc_id, source, len(t) AS size, 0.1::DOUBLE + len(list_distinct(t))::DOUBLE / greatest(len(t), 1)::DOUBLE AS quality
  FROM (SELECT doc_id, source, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS t FROM documents)
), keyed AS (
  SELECT *, -ln((('0x' || substr(md5('mix:' || doc_id::VARCHAR), 1, 12))::BIGINT + 0.5::DOUBLE) / 281474976710656.0::DOUBLE) / quality AS key FROM docs
), per AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS k FROM docs GROUP BY source
), weighed AS (
  SELECT *, CASE (k - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w, source_size * 3.0::DOUBLE AS cap FROM per
), shares AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / w, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
    / sum(w) OVER (ORDER BY cap / w, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS share FROM weighed
), targets AS (
  SELECT source, source_size, least(cap, max(share) OVER () * w) AS target FROM shares
), budgets AS (
  SELECT *, CASE WHEN source_size > 0 THEN least(floor(target / source_size), 3)::BIGINT ELSE 0 END AS epochs FROM targets
), placed AS (
  SELECT d.doc_id, d.size, b.source_size, b.target, b.epochs, round(b.target - b.epochs * b.source_size)::BIGINT AS rest,
    coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY key, d.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead
  FROM keyed d JOIN budgets b ON d.source IS NOT DISTINCT FROM b.source
)
SELECT doc_id, size::BIGINT AS size, source_size, target, (epochs * size + least(greatest(rest - ahead, 0), size))::BIGINT AS taken FROM placed
"""

_WORDS10 = r"regexp_extract_all(translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

SQL["op10_benchmark_decontamination"] = f"""
WITH items AS (
  SELECT item_id::VARCHAR AS item, w, least(len(w), 10) AS n FROM (SELECT item_id, {_WORDS10.format("text")} AS w FROM benchmark) WHERE len(w) > 0
), windows AS (
  SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS gram FROM items, unnest(generate_series(1, len(w) - n + 1)) AS s(i)
), docs AS (
  SELECT doc_id, {_WORDS10.format("text")} AS w FROM documents
), runs AS (
  SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS gram
  FROM docs, (SELECT DISTINCT n FROM windows) AS lengths, unnest(generate_series(1, len(w) - n + 1)) AS s(i)
), hits AS (
  SELECT r.doc_id, r.i, r.n, x.item FROM runs r JOIN windows x USING (n, gram)
), hit_words AS (
  SELECT doc_id, count(DISTINCT i + j) AS n_hit FROM hits, unnest(generate_series(0, n - 1)) AS t(j) GROUP BY doc_id
), hit_items AS (
  SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS names FROM hits GROUP BY doc_id
)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(h.n_hit, 0)::BIGINT AS n_hit, coalesce(t.n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(t.names, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM docs d LEFT JOIN hit_words h USING (doc_id) LEFT JOIN hit_items t USING (doc_id)
"""

SQL["op13_filter_interactions"] = r"""
WITH docs AS (
  SELECT doc_id, coalesce(lang, '') AS part, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, min(doc_id) OVER (PARTITION BY t) AS first_id
  FROM (SELECT doc_id, lang, coalesce(text, '') AS t FROM documents)
), marks AS (
  SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id
), failed AS (
  SELECT part, (len(w) < 200) AS a, (100 * len(list_distinct(w)) < 50 * len(w)) AS b, (100 * len(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * len(t)) AS c,
    regexp_matches(t, '[#$%&*|]') AS d, coalesce(doc_id > first_id, false) AS e, coalesce(quality = 1, false) AS good, coalesce(toxic = 1, false) AS bad
  FROM docs LEFT JOIN marks USING (doc_id)
), counted AS (
  SELECT part, a::INT + 2 * b::INT + 4 * c::INT + 8 * d::INT + 16 * e::INT AS mask, count(*) AS n, sum(good::INT) AS good, sum(bad::INT) AS toxic FROM failed GROUP BY ALL
), letters AS (
  SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) AS l(x, bit)
), orders AS (
  SELECT p.x || q.x || r.x || s.x || t.x AS filter_order, [p.bit, q.bit, r.bit, s.bit, t.bit] AS bits
  FROM letters p, letters q, letters r, letters s, letters t WHERE p.bit + q.bit + r.bit + s.bit + t.bit = 31
    AND len(list_distinct([p.bit, q.bit, r.bit, s.bit, t.bit])) = 5
), steps AS (
  SELECT filter_order, i::INT AS step, bits[i] AS bit, coalesce(list_sum(bits[1:i - 1]), 0)::INT AS before FROM orders, unnest(generate_series(1, 5)) AS g(i)
), walked AS (
  SELECT part, filter_order, step, bit,
    coalesce(sum(n) FILTER (mask & bit = 0 AND mask & before = 0), 0)::BIGINT AS kept,
    coalesce(sum(n) FILTER (mask & bit <> 0 AND mask & before = 0), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (mask & bit <> 0 AND mask & before <> 0), 0)::BIGINT AS redundant,
    coalesce(sum(n) FILTER (mask = bit), 0)::BIGINT AS unique_fails,
    coalesce(sum(good) FILTER (mask & bit <> 0 AND mask & before = 0), 0)::BIGINT AS good_lost,
    coalesce(sum(toxic) FILTER (mask & bit <> 0 AND mask & before = 0), 0)::BIGINT AS toxic_lost
  FROM counted, steps GROUP BY part, filter_order, step, bit
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, sum(removed) OVER (PARTITION BY part, bit)::BIGINT AS shapley FROM walked
"""


def _state(keep: str, after: int) -> str:
    """Cheapest edit of a row in one grammar state: delete, keep where ``keep`` allows, give the role that leads to state ``after``."""
    held, to = keep.partition(" THEN ")[::2]
    kept = f"CASE WHEN {held} THEN {{'c': {to}.c + x, 'a': 'K' || {to}.a}} ELSE {{'c': 1000000000, 'a': '~'}} END"
    return f"""list_sort([{{'c': s{{q}}.c + 4, 'a': 'D' || s{{q}}.a}}, {kept}, {{'c': s{after}.c + 3 + x, 'a': 'R' || s{after}.a}}])[1]"""


SQL["op12_conversation_repair"] = rf"""
WITH RECURSIVE crc AS (
  SELECT list_transform(range(256), lambda v: list_reduce([v, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t
), keyed AS (
  SELECT dense_rank() OVER (ORDER BY conv_id NULLS FIRST) AS conv, conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations
), kinds AS (
  SELECT * EXCLUDE t, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(key, ''), lambda s: ascii(s)::BIGINT)),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS kind FROM keyed, crc
), damaged AS (
  SELECT conv, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM kinds, unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS u(copy) WHERE kind <> 0
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv ORDER BY turn NULLS FIRST, role, sha256(text)) AS i FROM damaged
), faults AS (
  SELECT *, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank, row_number() OVER (PARTITION BY conv, role, text ORDER BY i) > 1 AS again,
    NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') AS cut, substr(role, 1, 1) AS initial, lag(substr(role, 1, 1)) OVER (PARTITION BY conv ORDER BY i) AS before FROM placed
), turns AS (
  SELECT *, blank OR again AS gone, CASE WHEN cut THEN 3 ELSE 0 END AS x FROM faults
), totals AS (
  SELECT conv, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, sum(blank::INT) AS blank, sum((again AND NOT blank)::INT) AS duplicate,
    sum((cut AND NOT again AND NOT blank)::INT) AS truncated, sum((before || initial NOT IN ('su', 'ua', 'au'))::INT) AS illegal FROM turns GROUP BY conv
), best AS (
  SELECT conv, n + 1 AS i, {{'c': 0, 'a': ''}} AS s0, {{'c': 6, 'a': 'II'}} AS s1, {{'c': 3, 'a': 'I'}} AS s2, {{'c': 0, 'a': ''}} AS s3 FROM totals
  UNION ALL
  SELECT conv, i, list_sort([b0, {{'c': t2.c + 3, 'a': 'I' || t2.a}}])[1], list_sort([b1, {{'c': t2.c + 3, 'a': 'I' || t2.a}}])[1], t2, t3 FROM (
    SELECT *, list_sort([b2, {{'c': b3.c + 3, 'a': 'I' || b3.a}}])[1] AS t2, list_sort([b3, {{'c': b2.c + 3, 'a': 'I' || b2.a}}])[1] AS t3 FROM (
      SELECT b.conv, t.i,
        CASE WHEN gone THEN {{'c': s0.c + 4, 'a': 'D' || s0.a}} ELSE {_state("initial IN ('s', 'u') THEN (CASE initial WHEN 's' THEN s1 ELSE s2 END)", 2).replace("{q}", "0")} END AS b0,
        CASE WHEN gone THEN {{'c': s1.c + 4, 'a': 'D' || s1.a}} ELSE {_state("initial = 'u' THEN s2", 2).replace("{q}", "1")} END AS b1,
        CASE WHEN gone THEN {{'c': s2.c + 4, 'a': 'D' || s2.a}} ELSE {_state("initial = 'a' THEN s3", 3).replace("{q}", "2")} END AS b2,
        CASE WHEN gone THEN {{'c': s3.c + 4, 'a': 'D' || s3.a}} ELSE {_state("initial = 'u' THEN s2", 2).replace("{q}", "3")} END AS b3
      FROM best b JOIN turns t ON t.conv = b.conv AND t.i = b.i - 1))
), audits AS (
  SELECT conv, s0.c AS cost, s0.a AS audit FROM best WHERE i = 1
), walk AS (
  SELECT conv, audit, 1 AS p, 1 AS i, 0 AS state, [''] AS lines FROM audits
  UNION ALL
  SELECT w.conv, w.audit, p + 1, w.i + (edit <> 'I')::INT, CASE WHEN edit = 'D' THEN state WHEN edit = 'K' AND initial = 's' THEN 1 WHEN state = 2 THEN 3 ELSE 2 END,
    CASE edit WHEN 'D' THEN lines WHEN 'K' THEN list_append(lines, role || ':' || text)
      ELSE list_append(lines, CASE WHEN state = 2 THEN 'assistant:' ELSE 'user:' END || CASE edit WHEN 'R' THEN text ELSE '' END) END
  FROM (SELECT *, substr(audit, p, 1) AS edit FROM walk WHERE p <= length(audit)) w LEFT JOIN turns t ON t.conv = w.conv AND t.i = w.i
), repaired AS (
  SELECT conv, sha256(array_to_string(lines[2:], chr(10))) AS digest FROM walk WHERE p = length(audit) + 1
)
SELECT k.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
  coalesce(illegal, 0)::BIGINT AS illegal, coalesce(cost, 0)::BIGINT AS cost, coalesce(audit, '') AS audit, coalesce(digest, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv, conv_id FROM keyed) k LEFT JOIN totals USING (conv) LEFT JOIN audits USING (conv) LEFT JOIN repaired USING (conv)
"""
