"""DuckDB SQL for the queries whose whole result SQL can express.

The others have none: learnt trees, token merging and alignment are not SQL, mixes and fingerprints follow a hash that
DuckDB lacks, all runs of a text are too slow there, and a neighbour search is held against brute force by its recall.
"""

OP1 = """
WITH texts AS (
    SELECT doc_id, hex(encode(coalesce(text, ''))) AS body FROM documents
),
pages_of_texts AS (
    SELECT doc_id, body, unnest(range(0, length(body) // 2, 512)) AS base FROM texts
),
pieces AS (
    SELECT doc_id, base, substring(body, 2 * base + 1, 2 * (512 + 399)) AS piece FROM pages_of_texts
),
bytes AS (
    SELECT doc_id, base, piece, unnest(range(0, least(512, length(piece) // 2))) AS place FROM pieces
),
starts AS (
    SELECT
        doc_id,
        base + place AS pos,
        substring(piece, 2 * place + 1, 2) AS byte,
        CASE WHEN 2 * (place + 400) <= length(piece) THEN md5(substring(piece, 2 * place + 1, 800)) END AS run
    FROM bytes
),
counted AS (
    SELECT doc_id, pos, byte, run IS NOT NULL AND count(*) OVER (PARTITION BY run) > 1 AS repeated FROM starts
),
covered AS (
    SELECT
        doc_id,
        pos,
        byte,
        bool_or(repeated) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 399 PRECEDING AND CURRENT ROW) AS gone
    FROM counted
),
marked AS (
    SELECT *, gone AND NOT lag(gone, 1, false) OVER (PARTITION BY doc_id ORDER BY pos) AS opens FROM covered
),
kept AS (
    SELECT
        doc_id,
        count(*) FILTER (WHERE gone) AS n_removed,
        count(*) FILTER (WHERE opens) AS n_spans,
        string_agg(byte, '' ORDER BY pos) FILTER (WHERE NOT gone) AS rest
    FROM marked
    GROUP BY doc_id
)
SELECT
    doc_id,
    length(body) // 2 AS n_bytes,
    coalesce(n_removed, 0) AS n_removed,
    coalesce(n_spans, 0) AS n_spans,
    sha256(unhex(coalesce(rest, ''))) AS kept_sha256,
    length(coalesce(rest, '')) // 2 AS kept_bytes
FROM texts LEFT JOIN kept USING (doc_id)
"""

OP2 = r"""
WITH texts AS (
    SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS body
    FROM documents
),
words AS (
    SELECT doc_id, unnest(body) AS word, generate_subscripts(body, 1) AS pos FROM texts
),
windows AS (
    SELECT
        doc_id,
        pos,
        word,
        CASE WHEN count(*) OVER next_50 = 50 THEN md5(string_agg(word, ' ') OVER next_50) END AS run
    FROM words
    WINDOW next_50 AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 49 FOLLOWING)
),
first_seen AS (
    SELECT doc_id, pos, word, run IS NOT NULL AND min(doc_id) OVER (PARTITION BY run) < doc_id AS repeated FROM windows
),
covered AS (
    SELECT
        doc_id,
        pos,
        word,
        bool_or(repeated) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS gone
    FROM first_seen
),
kept AS (
    SELECT
        doc_id,
        count(*) FILTER (WHERE gone) AS n_removed,
        string_agg(word, ' ' ORDER BY pos) FILTER (WHERE NOT gone) AS rest
    FROM covered
    GROUP BY doc_id
)
SELECT
    doc_id,
    len(body)::BIGINT AS n_words,
    coalesce(n_removed, 0) AS n_removed,
    sha256(coalesce(rest, '')) AS kept_sha256
FROM texts LEFT JOIN kept USING (doc_id)
"""

OP7 = r"""
WITH RECURSIVE texts AS (
    SELECT
        doc_id,
        list_filter(
            regexp_split_to_array(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[\x20\x09-\x0D]+'
            ),
            lambda w: w <> ''
        ) AS body
    FROM documents
),
words AS (
    SELECT doc_id, len(body) AS n, unnest(body) AS word, generate_subscripts(body, 1) AS pos FROM texts
),
runs AS (
    SELECT
        doc_id,
        n,
        pos,
        string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS run
    FROM words
),
shingles AS (
    SELECT DISTINCT doc_id, md5(run) AS shingle FROM runs WHERE pos + 4 <= n OR pos = 1
),
sets AS (
    SELECT doc_id, count(*) AS n_shingles FROM shingles GROUP BY doc_id
),
common AS (
    SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared
    FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
    GROUP BY a.doc_id, b.doc_id
),
links AS (
    SELECT a, b
    FROM common JOIN sets x ON x.doc_id = a JOIN sets y ON y.doc_id = b
    WHERE 100 * shared >= 75 * (x.n_shingles + y.n_shingles - shared)
),
reached AS (
    SELECT doc_id, doc_id AS other FROM texts
    UNION
    SELECT doc_id, links.b FROM reached JOIN links ON links.a = reached.other
),
least AS (
    SELECT doc_id, min(other) AS component_id FROM reached GROUP BY doc_id
)
SELECT doc_id, coalesce(n_shingles, 0) AS n_shingles, component_id, doc_id = component_id AS kept
FROM least LEFT JOIN sets USING (doc_id)
"""

OP8 = """
WITH payloads AS (
    SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
),
grouped AS (
    SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS response_id FROM payloads
),
typed AS (
    SELECT *, payload_bytes >= 100 AND page_id <> response_id AS revisits FROM grouped
)
SELECT
    page_id,
    payload_bytes,
    payload_digest,
    CASE WHEN revisits THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN revisits THEN response_id END AS refers_to
FROM typed
"""

OP11 = r"""
WITH texts AS (
    SELECT
        coalesce(lang, 'und') AS lang,
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
    FROM documents
),
pieces AS (
    SELECT lang, unnest(regexp_split_to_array(text, '[.,;:!?\n\x0B\f\r]')) AS piece FROM texts
),
split AS (
    SELECT lang, regexp_extract_all(piece, '[^ \t]+') AS w FROM pieces
),
windows AS (
    SELECT lang, unnest(list_transform(range(1, len(w) + 1), lambda i: w[i:i + 2])) AS w FROM split
),
phrases AS (
    SELECT lang, unnest(list_transform(range(1, len(w) + 1), lambda i: w[1:i])) AS w FROM windows
),
counts AS (
    SELECT lang, w, count(*) AS f FROM phrases GROUP BY lang, w
),
totals AS (
    SELECT lang, sum(f)::BIGINT AS n FROM counts WHERE len(w) = 1 GROUP BY lang
),
candidates AS (
    SELECT lang, w, f AS a FROM counts WHERE len(w) > 1 AND f >= 10
),
placed AS (
    SELECT *, unnest(range(1, len(w))) AS k FROM candidates
),
cuts AS (
    SELECT c.lang, c.w, c.a, k, x.f AS l, y.f AS r, 1000000::HUGEINT * c.a * c.a // (x.f::HUGEINT * y.f) AS score
    FROM placed AS c
    JOIN counts AS x ON x.lang = c.lang AND x.w = c.w[1:c.k]
    JOIN counts AS y ON y.lang = c.lang AND y.w = c.w[c.k + 1:]
),
lowest AS (
    SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, w ORDER BY score, k) = 1
),
longer AS (
    SELECT lang, w[1:2] AS w, a FROM candidates WHERE len(w) = 3
    UNION ALL
    SELECT lang, w[2:3] AS w, a FROM candidates WHERE len(w) = 3
),
most AS (
    SELECT lang, w, max(a) AS most FROM longer GROUP BY lang, w
),
kept AS (
    SELECT c.*, array_to_string(c.w, ' ') AS phrase
    FROM lowest AS c
    LEFT JOIN most AS x ON x.lang = c.lang AND x.w = c.w
    WHERE x.most IS NULL OR 100 * x.most < 50 * c.a
),
ranked AS (
    SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept
)
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score
FROM ranked JOIN totals USING (lang)
WHERE rank <= 2000
"""

OP4 = r"""
WITH RECURSIVE steps AS (
    SELECT range::BIGINT AS i, range::BIGINT AS c, 0 AS k FROM range(256)
    UNION ALL
    SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM steps WHERE k < 8
),
crc AS (
    SELECT list(c ORDER BY i) AS t FROM steps WHERE k = 8
),
sized AS (
    SELECT
        doc_id,
        coalesce(doc_id, 9223372036854775807) AS d,
        octet_length(encode(coalesce(text, ''))) + 1 AS size,
        md5(coalesce(text, '')) AS h,
        list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: ('0x' || x)::BIGINT) AS bytes
    FROM documents
),
placed AS (
    SELECT *, sum(size) OVER w - size AS start, row_number() OVER w AS n
    FROM sized WINDOW w AS (ORDER BY h, d ROWS UNBOUNDED PRECEDING)
),
target AS (
    SELECT sum(size)::DOUBLE / 16 AS t FROM sized
),
grouped AS (
    SELECT
        *,
        count(*) OVER same AS copies,
        sum(size) OVER same AS group_size,
        min(start) OVER same AS group_start
    FROM placed WINDOW same AS (PARTITION BY h)
),
cut AS (
    SELECT
        g.*,
        least(floor(CASE WHEN copies > 1 AND group_size <= t * CAST(0.01 AS DOUBLE) THEN group_start ELSE start END / t), 15)::INT
            AS shard
    FROM grouped AS g, target
)
SELECT
    doc_id,
    size,
    xor(list_reduce(list_prepend(4294967295, bytes), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS text_crc32,
    'bytes' AS law,
    shard,
    n - min(n) OVER (PARTITION BY shard) AS slot,
    CAST(NULL AS INTEGER) AS grown_shard
FROM cut, crc
"""

ORACLES: dict[str, str] = {
    "op1_suffix_dedup": OP1,
    "op2_substring_dedup": OP2,
    "op4_sharding": OP4,
    "op7_minhash_dedup": OP7,
    "op8_warc": OP8,
    "op11_collocations": OP11,
}
