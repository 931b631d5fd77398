"""SQL texts for another engine that say what the registered queries return."""

WORDS = r"len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT"

# Targets in closed form: sources by how early they fill up; the first that does not sets the level.
# The sample: certain documents by running sums over sizes, then three running sums in Pareto order over
# what still fits, then the best fit of the rest.
_MIX_PASS = """
p{r} AS (
 SELECT *, fits AND sum(size) OVER (PARTITION BY source, fits ORDER BY q, doc_id ROWS UNBOUNDED PRECEDING) <= missing AS now
 FROM (SELECT *, q IS NOT NULL AND NOT chosen AND size <= missing AS fits FROM m{r})
), m{next} AS (
 SELECT * EXCLUDE (missing, chosen, now, fits), chosen OR now AS chosen,
  missing - coalesce(sum(size) FILTER (WHERE now) OVER (PARTITION BY source), 0) AS missing FROM p{r}
)"""
OP1 = (
    rf"""
WITH d AS (
 SELECT doc_id, source, {WORDS} AS size,
  (('0x' || substr(md5('mix:' || doc_id::VARCHAR), 1, 13))::BIGINT + 0.5) / 4503599627370496.0 AS u
 FROM documents
), s AS (
 SELECT source, sum(size)::BIGINT AS source_size,
  CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3.0 WHEN 1 THEN 1.0 ELSE 2.0 END::DOUBLE AS weight
 FROM d GROUP BY source
), f AS (
 SELECT *, 2.0::DOUBLE * source_size AS most, row_number() OVER w AS nth,
  (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(2.0::DOUBLE * source_size) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / (sum(weight) OVER () - coalesce(sum(weight) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS lvl
 FROM s WINDOW w AS (ORDER BY source_size / weight, source)
), c AS (SELECT arg_min(lvl, nth) FILTER (WHERE most > lvl * weight) AS lvl FROM f),
t AS (
 SELECT source, source_size, target, floor(target / source_size) AS whole,
  CASE WHEN target / source_size > floor(target / source_size) THEN target - floor(target / source_size) * source_size ELSE 0 END AS need
 FROM (SELECT source, source_size, least(most, c.lvl * weight) AS target FROM f, c)
), r AS (SELECT d.*, source_size, target, whole, need FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
z AS (SELECT source, size, any_value(need) AS need, count(*) AS k FROM r WHERE need > 0 AND size > 0 GROUP BY source, size),
y AS (
 SELECT source, size, need - coalesce(sum(size * k) OVER (PARTITION BY source ORDER BY size DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS missing,
  sum(size * k) OVER (PARTITION BY source ORDER BY size)::DOUBLE AS words, sum(size::HUGEINT * size * k) OVER (PARTITION BY source ORDER BY size)::DOUBLE AS squares
 FROM z
), x AS (
 SELECT source, max(size) AS largest, arg_max(missing, size) AS missing, arg_max(missing / squares, size) AS scale, arg_max(missing / words, size) AS mean
 FROM y WHERE missing * size < squares GROUP BY source
), v AS (
 SELECT r.*, x.missing, coalesce(size > largest, false) AS chosen,
  CASE WHEN size > 0 AND size <= largest THEN ((u / (1 - u)) / (scale * size / (1 - scale * size))) * (mean / (1 - mean)) END AS rank
 FROM r LEFT JOIN x ON r.source IS NOT DISTINCT FROM x.source
), m0 AS (SELECT *, rank / (1 + rank) AS q FROM v),"""
    + ",".join(_MIX_PASS.format(r=r, next=r + 1) for r in range(3))
    + """,
e AS (
 SELECT *, CASE WHEN fits THEN row_number() OVER (PARTITION BY source, fits ORDER BY abs(size - missing), q, doc_id) END AS extra
 FROM (SELECT *, coalesce(q IS NOT NULL AND NOT chosen AND abs(size - missing) < missing, false) AS fits FROM m3)
)
SELECT doc_id, size, source_size, target, (size * (whole + CASE WHEN chosen OR coalesce(extra = 1, false) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM e
"""
)

# A rule is an expression's host suffix and the start of the path, so plain conditions say the same.
OP2 = r"""
WITH u AS (
 SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), v AS (SELECT page_id, regexp_extract(rest, '^([^?#]*)', 1) AS place FROM u),
p AS (
 SELECT page_id, translate(regexp_extract(place, '^([^/]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  substr(place, length(regexp_extract(place, '^([^/]*)', 1)) + 1) AS path FROM v
), r(rhost, rpath, verdict) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
m AS (
 SELECT page_id, host, path, rhost || rpath AS rule, verdict,
  row_number() OVER (PARTITION BY page_id, host, path ORDER BY length(rhost || rpath) DESC, length(rhost) DESC, rhost || rpath DESC) AS nth
 FROM p JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
)
SELECT p.page_id, p.host, p.path, m.rule, coalesce(m.verdict, 'allow') AS verdict
FROM p LEFT JOIN m ON m.page_id = p.page_id AND m.host = p.host AND m.path = p.path AND m.nth = 1
"""

# The base figures by unnesting words, lines and windows; the line rules as the same patterns.
OP7 = rf"""
WITH d AS (
 SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), win AS (
 SELECT doc_id, i, list_slice(w, i, i + 7) AS g FROM d, unnest(range(1, len(w) - 6)) AS x(i) WHERE len(w) >= 8
), twice AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
rep AS (
 SELECT doc_id, sum(n)::BIGINT AS n FROM (
  SELECT doc_id, least(8, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i) - i, 8)) AS n FROM twice
 ) GROUP BY doc_id
), lines AS (
 SELECT doc_id, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n FROM d, unnest(string_split(text, chr(10))) AS x(line)
), by_line AS (
 SELECT doc_id, (count(*) FILTER (WHERE n > 0) - count(DISTINCT line) FILTER (WHERE n > 0))::BIGINT AS n_dup_lines,
  coalesce(sum(n) FILTER (WHERE n > 0 AND ((n >= {{sentence}} AND NOT regexp_matches(line, {{ends}})) OR length(line) - length(regexp_replace(line, '[#*$%&|<>]', '', 'g')) > n OR regexp_matches(line, {{navigation}}) OR regexp_matches(line, {{boilerplate}}))), 0)::BIGINT AS lost
 FROM lines GROUP BY doc_id
), f AS (
 SELECT d.doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
  (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words, lost
 FROM d JOIN by_line USING (doc_id) LEFT JOIN rep USING (doc_id)
), b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
 NOT base_failed AND 100 * lost <= {{max_lost}} * n_words AS kept
FROM b
"""


def op7(sentence: int, ends: str, navigation: str, boilerplate: str, max_lost: int) -> str:
    def quoted(pattern: str) -> str:
        return "'" + pattern.replace("'", "''") + "'"

    return OP7.replace("{sentence}", str(sentence)).replace("{ends}", quoted(ends)).replace("{navigation}", quoted(navigation)).replace("{boilerplate}", quoted(boilerplate)).replace("{max_lost}", str(max_lost))

# Brute force: every query with every other row.
OP5 = """
WITH v AS (
 SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
 WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
 SELECT q.vec_id AS query_id, v.vec_id, list_dot_product(q.e, v.e)::BIGINT AS score
 FROM v AS q JOIN v ON q.vec_id % 50 = 0 AND q.vec_id <> v.vec_id
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""

# Turns in order; a turn is out of order if its role may not follow the one before.
OP3 = r"""
WITH c AS (
 SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
 UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok' UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
), o AS (
 SELECT *, row_number() OVER w - 1 AS n, coalesce(lag(role) OVER w, 'start') AS state,
  length(role) + length(regexp_replace(text, '<(\\*)\|', '<\1\\|', 'g')) + 24 AS chars
 FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
 coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
 sha256(coalesce(string_agg(text, '' ORDER BY n) FILTER (role = 'assistant'), '')) AS loss_sha256, sum(chars)::BIGINT AS formatted_chars,
 min(n) FILTER (state || '>' || role NOT IN ('start>system', 'start>user', 'system>user', 'user>assistant', 'assistant>user')) AS first_bad_turn
FROM o GROUP BY conv_id
"""

# Every window as a string; words in a window that exists twice go.
OP11 = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(list_slice(w, i, i + 34), ' ') AS g FROM d, unnest(range(1, len(w) - 33)) AS x(i) WHERE len(w) >= 35),
twice AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY g) > 1),
edges AS (SELECT doc_id, i AS k, 1 AS step FROM twice UNION ALL SELECT doc_id, i + 35, -1 FROM twice),
words AS (SELECT doc_id, k, w[k] AS word FROM d, unnest(range(1, len(w) + 1)) AS x(k)),
marked AS (
 SELECT doc_id, k, word, sum(step) OVER (PARTITION BY doc_id ORDER BY k, word IS NULL DESC ROWS UNBOUNDED PRECEDING) > 0 AS gone
 FROM (SELECT doc_id, k, word, 0 AS step FROM words UNION ALL SELECT doc_id, k, NULL, step FROM edges)
), kept AS (
 SELECT doc_id, count(*) AS n_words, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY k) FILTER (NOT gone) AS kept
 FROM marked WHERE word IS NOT NULL GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

# Every part with every entry of its position, twice moved.
_CODES_ROUND = """
a{r} AS MATERIALIZED (
 SELECT vec_id, position, any_value(part) AS part, arg_min(entry, d::HUGEINT * 64 + entry) AS entry, min(d) AS d FROM (
  SELECT p.vec_id, p.position, p.part, entry, list_sum(list_transform(list_zip(p.part, c.part), lambda x: (x[1] - x[2]) * (x[1] - x[2])))::BIGINT AS d
  FROM p JOIN c{r} AS c USING (position)
 ) GROUP BY vec_id, position
)"""
_CODES_MOVE = """
m{r} AS (
 SELECT position, entry, k, sum(part[k])::BIGINT AS s, count(*) AS n FROM a{r}, unnest(range(1, len(part) + 1)) AS x(k) GROUP BY position, entry, k
), c{next} AS MATERIALIZED (
 SELECT c.position, c.entry, coalesce(new.part, c.part) AS part FROM c{r} AS c LEFT JOIN (
  SELECT position, entry, list((s - ((s % n) + n) % n) // n ORDER BY k) AS part FROM m{r} GROUP BY position, entry
 ) AS new USING (position, entry)
)"""
OP12 = (
    """
WITH v AS (
 SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM embeddings
 WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), p AS MATERIALIZED (
 SELECT vec_id, i AS position, list_slice(e, i * (len(e) // 16) + 1, (i + 1) * (len(e) // 16)) AS part FROM v, unnest(range(16)) AS x(i)
), c0 AS MATERIALIZED (
 SELECT position, row_number() OVER (PARTITION BY position ORDER BY vec_id) - 1 AS entry, part FROM p QUALIFY entry < 64
),"""
    + ",".join(
        _CODES_ROUND.format(r=r) + ("," + _CODES_MOVE.format(r=r, next=r + 1) if r < 2 else "") for r in range(3)
    )
    + """,
coded AS (SELECT vec_id, string_agg(printf('%02x', entry), '' ORDER BY position) AS code, sum(d)::BIGINT AS error FROM a2 GROUP BY vec_id),
digest AS (
 SELECT sha256(string_agg(part[k]::VARCHAR, ',' ORDER BY position, entry, k)) AS codebooks_sha256
 FROM c2, unnest(range(1, len(part) + 1)) AS x(k)
)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256
FROM coded JOIN v USING (vec_id), digest
"""
)

# crc32 is a sum without carry: of what each byte adds at its distance from the end, and of what the
# length adds. Near words by their spellings less one letter.
OP13 = r"""
WITH RECURSIVE bits(b, k, v) AS (
 SELECT b, 0, b FROM range(256) AS x(b)
 UNION ALL SELECT b, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM bits WHERE k < 8
), tab AS MATERIALIZED (SELECT b, v FROM bits WHERE k = 8),
found AS (
 SELECT doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{C0}-\x{FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
 FROM documents
), r AS MATERIALIZED (
 SELECT row_number() OVER () AS id, run, n, coalesce(doc_id::VARCHAR, '') || ':' || run AS message
 FROM (SELECT doc_id, run, count(*) AS n FROM found WHERE length(run) >= 7 GROUP BY doc_id, run)
), most AS (SELECT max(strlen(message)) AS n FROM r),
far(b, k, v) AS (
 SELECT b, 0, v FROM tab UNION ALL SELECT far.b, k + 1, xor(far.v >> 8, tab.v) FROM far JOIN tab ON tab.b = far.v & 255 WHERE k < (SELECT n FROM most)
), start(k, v) AS (
 SELECT 0, 4294967295 UNION ALL SELECT k + 1, xor(start.v >> 8, tab.v) FROM start JOIN tab ON tab.b = start.v & 255 WHERE k < (SELECT n FROM most)
), bytes AS (
 SELECT id, strlen(message) - i AS k, ('0x' || substr(hex(encode(message)), 2 * i - 1, 2))::BIGINT AS b FROM r, unnest(range(1, strlen(message) + 1)) AS x(i)
), h AS (
 SELECT r.id, run, n, xor(xor(bit_xor(far.v), any_value(start.v)), 4294967295) AS h
 FROM bytes JOIN far USING (b, k) JOIN r USING (id) JOIN start ON start.k = strlen(message) GROUP BY r.id, run, n
), words AS (
 SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM h
), voc AS MATERIALIZED (SELECT word, sum(n)::BIGINT AS n FROM words WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
less AS MATERIALIZED (SELECT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM voc, unnest(range(1, length(word) + 1)) AS x(i)),
near AS MATERIALIZED (
 SELECT a.word, b.word AS other FROM less AS a JOIN less AS b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
 UNION SELECT less.word, voc.word FROM less JOIN voc ON rest = voc.word
 UNION SELECT voc.word, less.word FROM less JOIN voc ON rest = voc.word
), best AS (
 SELECT near.word, count(*) AS n_near, arg_min(other, row(-o.n, other)) AS form, max(o.n) AS form_n FROM near JOIN voc AS o ON other = o.word GROUP BY near.word
), formed AS MATERIALIZED (
 SELECT voc.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 10 * n THEN form END AS form, CASE WHEN form_n >= 10 * n THEN form_n END AS form_n
 FROM voc LEFT JOIN best USING (word)
), way(word, reached, k) AS (
 SELECT word, form, 1 FROM formed WHERE form IS NOT NULL
 UNION ALL SELECT way.word, formed.form, k + 1 FROM way JOIN formed ON reached = formed.word WHERE formed.form IS NOT NULL
), root AS (SELECT word, arg_max(reached, k) AS root FROM way GROUP BY word)
SELECT word, form, coalesce(root, word) AS root, n, n_near, form_n FROM formed LEFT JOIN root USING (word)
"""
