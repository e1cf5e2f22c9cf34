"""Check SQL of the operators that SQL can express."""

from __future__ import annotations


def crc32(text: str) -> str:
    """SQL for the unsigned CRC-32 of an ASCII expression."""
    bits = (
        "list_reduce(list_prepend(xor(crc, byte), range(8)), lambda c, bit: "
        "CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)"
    )
    codes = f"list_transform(string_split({text}, ''), lambda c: ascii(c)::BIGINT)"
    return (
        f"xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, {codes}), "
        f"lambda crc, byte: {bits}))"
    )


def _field(name: str) -> str:
    return f"coalesce(strlen({name}::VARCHAR) || ':' || {name}::VARCHAR, '-')"


def _leaf(text: str) -> str:
    fields = [*map(_field, ("doc_id", "source", "lang", "n_chars")), _field(text)]
    return f"sha256({' || '.join(fields)})"


MERKLE = f"""
WITH RECURSIVE given AS (
  SELECT doc_id, coalesce('g' || source, '') AS g, {_leaf('text')} AS leaf,
    CASE WHEN {crc32('doc_id::VARCHAR')} % 2 = 0 THEN {_leaf("replace(text, chr(10), '')")}
      ELSE {_leaf('text')} END AS claimed
  FROM documents
), leaves AS (
  SELECT *, row_number() OVER (
      PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS n,
    count(*) OVER (PARTITION BY g) AS width
  FROM given
), lower AS (
  SELECT g, 0 AS level, n, leaf AS digest, width FROM leaves
  UNION ALL
  SELECT g, level + 1, n // 3, sha256(string_agg(digest, '' ORDER BY n)), (width + 2) // 3
  FROM lower WHERE width > 1 GROUP BY g, level, n // 3, width
), subroots AS (
  SELECT g, digest, row_number() OVER (ORDER BY g) - 1 AS n, count(*) OVER () AS width
  FROM lower WHERE width = 1
), upper AS (
  SELECT 0 AS level, n, digest, width FROM subroots
  UNION ALL
  SELECT level + 1, n // 3, sha256(string_agg(digest, '' ORDER BY n)), (width + 2) // 3
  FROM upper WHERE width > 1 GROUP BY level, n // 3, width
), nodes AS (
  SELECT g, level, n, digest FROM lower WHERE width > 1
  UNION ALL
  SELECT NULL, level, n, digest FROM upper WHERE width > 1
), runs AS (
  SELECT g, level, n // 3 AS run, list(digest ORDER BY n) AS digests
  FROM nodes GROUP BY g, level, n // 3
), steps AS (
  SELECT n.g, n.level, n.n, array_to_string(list_transform(r.digests, lambda d, i:
    CASE WHEN i - 1 = n.n % 3 THEN '_' ELSE d END), '') AS step
  FROM nodes n JOIN runs r
    ON n.g IS NOT DISTINCT FROM r.g AND n.level = r.level AND n.n // 3 = r.run
), paths AS (
  SELECT l.g, l.n, list(s.step ORDER BY s.level) AS path
  FROM leaves l JOIN steps s ON l.g = s.g AND l.n // (3 ** s.level)::BIGINT = s.n
  GROUP BY l.g, l.n
), over AS (
  SELECT r.g, list(s.step ORDER BY s.level) AS path
  FROM subroots r JOIN steps s ON s.g IS NULL AND r.n // (3 ** s.level)::BIGINT = s.n
  GROUP BY r.g
), proved AS (
  SELECT l.doc_id, l.leaf, l.claimed, r.digest AS subroot,
    (SELECT digest FROM upper WHERE width = 1) AS root,
    list_concat(coalesce(p.path, []), coalesce(o.path, [])) AS path
  FROM leaves l JOIN subroots r ON l.g = r.g
  LEFT JOIN paths p ON l.g = p.g AND l.n = p.n
  LEFT JOIN over o ON l.g = o.g
), folded AS (
  SELECT *, list_reduce(list_prepend(claimed, path), lambda digest, step:
    sha256(replace(step, '_', digest))) AS folded_root
  FROM proved
)
SELECT doc_id, leaf, subroot, root,
  sha256(replace(array_to_string(path, ''), '_', '')) AS proof_sha256,
  folded_root, folded_root = root AS verified
FROM folded
"""

MIX = r"""
WITH sized AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS g,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size
  FROM documents
), sources AS (
  SELECT g, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY g) AS place
  FROM sized GROUP BY g
), weighed AS (
  SELECT *, 1 + (place - 1) % 3 AS weight, source_size / (1 + (place - 1) % 3) AS filled
  FROM sources
), levels AS (
  SELECT *,
    ((sum(source_size) OVER () - 3 * (sum(source_size) OVER before - source_size))::BIGINT
      / (sum(weight) OVER () - (sum(weight) OVER before - weight))::BIGINT) AS level
  FROM weighed WINDOW before AS (ORDER BY filled, g ROWS UNBOUNDED PRECEDING)
), aims AS (
  SELECT g, source_size, CASE WHEN level >= 3 * filled THEN (3 * source_size)::DOUBLE
    ELSE weight * (SELECT max(level) FROM levels WHERE NOT level >= 3 * filled) END AS target
  FROM levels
), worths AS (
  SELECT *, CASE WHEN source_size > 0 THEN target * n_blocks / source_size ELSE 0 END AS worth
  FROM (SELECT *, CASE WHEN source_size > 0
    THEN greatest(1, floor(source_size / 32 + 0.5))::BIGINT ELSE 0 END AS n_blocks FROM aims)
), quotients AS (
  SELECT g, row_number() OVER (ORDER BY worth / (seat + 0.5) DESC, g, seat) AS place
  FROM (SELECT g, worth, unnest(range(3 * n_blocks)) AS seat FROM worths)
), won AS (
  SELECT g, count(*) AS seats FROM quotients
  WHERE place <= (SELECT (sum(floor(worth * 1024 + 0.5))::BIGINT + 512) // 1024 FROM worths)
  GROUP BY g
), blocks AS (
  SELECT w.g, b, b * (source_size // n_blocks) + least(b, source_size % n_blocks) AS first_word,
    (coalesce(won.seats, 0) - (b * step + shift) % n_blocks + n_blocks - 1) // n_blocks AS copies
  FROM (SELECT *, unnest(range(n_blocks)) AS b,
      ('0x' || left(md5('mix' || g), 15))::BIGINT % n_blocks AS shift,
      CASE WHEN n_blocks % 1048573 <> 0 THEN 1048573 ELSE 1048571 END AS step
    FROM worths WHERE n_blocks > 0) w
  LEFT JOIN won ON w.g = won.g
), spans AS (
  SELECT *, coalesce(lead(first_word) OVER (PARTITION BY g ORDER BY b), 1::BIGINT << 60) AS ends
  FROM blocks
), lines AS (
  SELECT *, row_number() OVER () AS line, sum(size) OVER (PARTITION BY g
    ORDER BY doc_id NULLS FIRST, size ROWS UNBOUNDED PRECEDING)::BIGINT - size AS start
  FROM sized
), taken AS (
  SELECT line, sum(copies * (least(ends, start + size) - greatest(first_word, start))) AS words
  FROM lines JOIN spans ON lines.g = spans.g AND first_word < start + size AND ends > start
  GROUP BY line
)
SELECT doc_id, size, source_size, target, coalesce(words, 0)::BIGINT AS taken
FROM lines JOIN worths ON lines.g = worths.g LEFT JOIN taken ON lines.line = taken.line
"""

REPAIR = r"""
WITH RECURSIVE damaged AS (
  SELECT conv_id, turn, unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy,
    CASE kind WHEN 4 THEN 'user' ELSE coalesce(role, ' ') END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(coalesce(text, ' '), '.!?', '')
      ELSE coalesce(text, ' ') END AS text
  FROM (SELECT *, CRC % 20 AS kind FROM conversations)
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id
    ORDER BY turn NULLS FIRST, role, md5(text), copy) AS place FROM damaged
), seen AS (
  SELECT *, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY place) AS time,
    lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY place) AS before
  FROM placed
), marked AS (
  SELECT *, CASE WHEN body = '' THEN 'b' WHEN time > 1 THEN 'd'
    WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '.' END AS fault
  FROM seen
), figures AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
    count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate,
    count(*) FILTER (fault = 't') AS truncated,
    count(*) FILTER (before || left(role, 1) NOT IN ('su', 'ua', 'au')) AS illegal,
    count(*) AS turns
  FROM marked GROUP BY conv_id
), edges AS (
  -- every way over one turn: up to two insertions, then keep, rerole or delete
  SELECT m.conv_id, m.place, s.state, ways.letter,
    ways.added * 2 + CASE WHEN ways.letter = 'D' THEN 3
      ELSE CASE ways.letter WHEN 'R' THEN 2 ELSE 0 END + (m.fault = 't')::INT END AS cost,
    repeat('I', ways.added) || ways.letter AS audit,
    CASE ways.letter WHEN 'D' THEN s.at WHEN 'R' THEN CASE s.at WHEN 2 THEN 3 ELSE 2 END
      ELSE CASE left(m.role, 1) WHEN 's' THEN 1 WHEN 'u' THEN 2 ELSE 3 END END AS after,
    [x FOR x IN [CASE WHEN ways.added > 0 THEN CASE s.state WHEN 2 THEN 'assistant:'
        ELSE 'user:' END END, CASE WHEN ways.added > 1 THEN CASE s.state WHEN 2 THEN 'user:'
        ELSE 'assistant:' END END,
      CASE ways.letter WHEN 'K' THEN m.role || ':' || m.text WHEN 'R' THEN
        CASE s.at WHEN 2 THEN 'assistant:' ELSE 'user:' END || m.text END] IF x IS NOT NULL]
      AS lines
  FROM marked m,
    (SELECT state, added, CASE added WHEN 0 THEN state WHEN 1 THEN
        CASE state WHEN 2 THEN 3 ELSE 2 END ELSE CASE state WHEN 2 THEN 2 ELSE 3 END END AS at
      FROM range(4) a(state), range(3) b(added)) s
    JOIN (SELECT letter, added FROM (VALUES ('K'), ('R'), ('D')) v(letter), range(3) b(added)) ways
      ON ways.added = s.added
  WHERE (ways.letter = 'D' OR m.fault IN ('.', 't'))
    AND (ways.letter <> 'K' OR CASE left(m.role, 1) WHEN 's' THEN s.at = 0
      WHEN 'u' THEN s.at <> 2 WHEN 'a' THEN s.at = 2 ELSE false END)
), steps AS (
  SELECT conv_id, 0::BIGINT AS place, 0 AS state, 0 AS cost, '' AS audit, []::VARCHAR[] AS lines
  FROM figures
  UNION ALL
  SELECT conv_id, place, state, best.cost, best.audit, best.lines FROM (
    SELECT s.conv_id, e.place, e.after AS state, arg_min(
        {'cost': s.cost + e.cost, 'audit': s.audit || e.audit,
         'lines': list_concat(s.lines, e.lines)},
        {'cost': s.cost + e.cost, 'audit': s.audit || e.audit}) AS best
    FROM steps s JOIN edges e ON s.conv_id IS NOT DISTINCT FROM e.conv_id
      AND s.state = e.state AND s.place + 1 = e.place
    GROUP BY s.conv_id, e.place, e.after)
), ended AS (
  SELECT s.conv_id, arg_min({'cost': cost + more, 'audit': audit || closing,
      'lines': list_concat(lines, added)}, {'cost': cost + more, 'audit': audit || closing}) AS best
  FROM steps s JOIN figures f ON s.conv_id IS NOT DISTINCT FROM f.conv_id AND s.place = f.turns
  JOIN (VALUES (0, 0, '', []), (1, 4, 'II', ['user:', 'assistant:']), (2, 2, 'I', ['assistant:']),
    (3, 0, '', [])) c(state, more, closing, added) ON s.state = c.state
  GROUP BY s.conv_id
)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank,
  coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, coalesce(e.best.cost, 0)::BIGINT AS cost,
  coalesce(e.best.audit, '') AS audit,
  sha256(coalesce(array_to_string(e.best.lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN figures f ON o.conv_id IS NOT DISTINCT FROM f.conv_id
LEFT JOIN ended e ON o.conv_id IS NOT DISTINCT FROM e.conv_id
""".replace("CRC", crc32("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')"))

_FOLDED = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_PLAIN = rf"regexp_extract_all(coalesce({_FOLDED}, ''), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_SPACED = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

CONTAMINATION = f"""
WITH items AS (
  SELECT item, words, least(10, len(words)) AS n
  FROM (SELECT coalesce(item_id::VARCHAR, '') AS item, {_PLAIN} AS words FROM benchmark)
  WHERE len(words) > 0
), windows AS (
  SELECT DISTINCT item, n, words[i + 1:i + n] AS gram
  FROM (SELECT *, unnest(range(len(words) - n + 1)) AS i FROM items)
), docs AS (
  SELECT row_number() OVER () AS row, doc_id, {_PLAIN} AS words FROM documents
), grams AS (
  SELECT row, i, n, words[i + 1:i + n] AS gram
  FROM (SELECT row, n, words, unnest(range(greatest(0, len(words) - n + 1))) AS i
    FROM docs, (SELECT DISTINCT n FROM windows))
), hits AS (
  SELECT row, i, g.n, item FROM grams g JOIN windows w ON g.n = w.n AND g.gram = w.gram
), covered AS (
  SELECT row, count(DISTINCT word) AS n_hit
  FROM (SELECT row, i + unnest(range(n)) AS word FROM (SELECT DISTINCT row, i, n FROM hits))
  GROUP BY row
), named AS (
  SELECT row, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT row, item FROM hits) GROUP BY row
)
SELECT doc_id, len(words) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM docs LEFT JOIN covered ON docs.row = covered.row LEFT JOIN named ON docs.row = named.row
"""

REPEATS = f"""
WITH docs AS (
  SELECT row_number() OVER () AS row, doc_id, {_SPACED} AS words FROM documents
), windows AS (
  SELECT row, doc_id, i, md5(array_to_string(words[i + 1:i + 50], ' ')) AS gram
  FROM (SELECT *, unnest(range(greatest(0, len(words) - 49))) AS i FROM docs
    WHERE doc_id IS NOT NULL)
), repeated AS (
  SELECT row, i FROM (SELECT *, min(doc_id) OVER (PARTITION BY gram) AS least FROM windows)
  WHERE doc_id > least
), removed AS (
  SELECT DISTINCT row, i + unnest(range(50)) AS place FROM repeated
), kept AS (
  SELECT w.row, count(r.place) AS n_removed,
    string_agg(word, ' ' ORDER BY w.place) FILTER (r.place IS NULL) AS text
  FROM (SELECT row, unnest(words) AS word, unnest(range(len(words))) AS place FROM docs) w
  LEFT JOIN removed r ON w.row = r.row AND w.place = r.place
  GROUP BY w.row
)
SELECT doc_id, len(words) AS n_words, coalesce(n_removed, 0) AS n_removed,
  sha256(coalesce(text, '')) AS kept_sha256
FROM docs LEFT JOIN kept ON docs.row = kept.row
"""

WARC = """
SELECT page_id, strlen(body) AS payload_bytes, array_to_string(list_transform(range(32), lambda i:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
      (('0x' || substr(digest, i // 4 * 5 + 1, 5))::BIGINT >> (15 - i % 4 * 5) & 31)::INT + 1, 1)),
    '') AS payload_digest,
  CASE WHEN page_id = newest THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> newest THEN newest END AS refers_to
FROM (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS digest,
    max(page_id) OVER (PARTITION BY coalesce(html, '')) AS newest FROM pages)
"""

DUPLICATES = f"""
WITH RECURSIVE docs AS (
  SELECT doc_id, {_SPACED} AS words FROM documents
), nodes AS (
  SELECT md5(array_to_string(words, ' ')) AS node, any_value(words) AS words,
    min(doc_id) AS least, count(*) AS copies
  FROM docs WHERE len(words) > 0 GROUP BY 1
), shingles AS (
  SELECT DISTINCT node, md5(array_to_string(words[i + 1:i + 5], ' ')) AS shingle
  FROM (SELECT node, words, unnest(range(greatest(0, len(words) - 4))) AS i FROM nodes)
), sizes AS (
  SELECT node, count(*) AS size FROM shingles GROUP BY node
), shared AS (
  SELECT a.node AS u, b.node AS v, count(*) AS n
  FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.node <> b.node
  GROUP BY a.node, b.node
), links AS (
  SELECT u, v FROM shared JOIN sizes s ON u = s.node JOIN sizes t ON v = t.node
  WHERE 5 * n >= 4 * (s.size + t.size - n)
), reached AS (
  SELECT node, node AS other FROM nodes
  UNION
  SELECT r.node, l.v FROM reached r JOIN links l ON r.other = l.u
), classes AS (
  SELECT r.node, min(n.least) AS class_id
  FROM reached r JOIN nodes n ON r.other = n.node GROUP BY r.node
), linked AS (
  SELECT u, sum(copies) AS linked FROM links JOIN nodes ON v = node GROUP BY u
)
SELECT doc_id, coalesce(class_id, doc_id) AS class_id,
  coalesce(linked + copies - 1, copies - 1, 0)::BIGINT AS n_links,
  coalesce(copies, 1)::BIGINT AS n_copies
FROM (SELECT doc_id, CASE WHEN len(words) > 0 THEN md5(array_to_string(words, ' ')) END AS node
  FROM docs) d
LEFT JOIN nodes n ON d.node = n.node LEFT JOIN classes c ON d.node = c.node
LEFT JOIN linked l ON d.node = l.u
"""
