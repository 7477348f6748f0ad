"""The same results as DuckDB SQL, where SQL can express them."""

# Words of a text: runs of anything but the six blanks.
_WORDS = r"list_filter(string_split_regex({text}, '[\x09-\x0D ]+'), lambda x: x <> '')"
_LOWER = (
    "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
)

ORACLE = {
    "op3_ngram_join": f"""
        WITH RECURSIVE words AS (
            SELECT doc_id, {_WORDS.format(text=_LOWER)} AS w FROM documents
        ), grams AS (
            SELECT DISTINCT doc_id, unnest(CASE
                WHEN len(w) = 0 THEN []
                WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
            END) AS gram
            FROM words
        ), sizes AS (
            SELECT doc_id, count(*) AS size FROM grams GROUP BY doc_id
        ), meets AS (
            SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS overlap
            FROM grams a JOIN grams b ON a.gram = b.gram AND a.doc_id <> b.doc_id
            GROUP BY 1, 2
        ), links AS (
            SELECT x, y
            FROM meets JOIN sizes a ON a.doc_id = x JOIN sizes b ON b.doc_id = y
            WHERE 100 * overlap >= 75 * (a.size + b.size - overlap)
        ), reached AS (
            SELECT doc_id, doc_id AS other FROM documents
            UNION
            SELECT doc_id, y FROM reached JOIN links ON x = other
        )
        SELECT doc_id, coalesce(any_value(size), 0)::BIGINT AS n_shingles, min(other) AS component_id
        FROM reached LEFT JOIN sizes USING (doc_id)
        GROUP BY doc_id
    """,
    "op6_mixing": """
        WITH sized AS (
            SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x09-\\x0D ]+')), 0)::BIGINT AS size,
                   md5(md5(coalesce(doc_id::VARCHAR, '') || chr(31) || coalesce(text, ''))
                       || (row_number() OVER (PARTITION BY doc_id, source, text) - 1)::VARCHAR) AS key
            FROM documents
        ), sums AS (
            SELECT source, sum(size)::BIGINT AS source_size,
                   row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1 AS place
            FROM sized GROUP BY source
        ), weighed AS (
            SELECT *, 2 * source_size AS cap,
                   CASE place % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight,
                   CASE place % 3 WHEN 0 THEN 1.5::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END AS a,
                   CASE place % 3 WHEN 0 THEN 0.5::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 1.5::DOUBLE END AS b
            FROM sums
        ), levels AS (
            -- the level if this source and all with a higher cap per weight share what is left
            SELECT w.source, (1.5::DOUBLE * (SELECT sum(source_size) FROM sums)
                    - coalesce(sum(o.cap) FILTER ((o.cap / o.weight, o.place) < (w.cap / w.weight, w.place)), 0))
                   / sum(o.weight) FILTER ((o.cap / o.weight, o.place) >= (w.cap / w.weight, w.place)) AS level
            FROM weighed w, weighed o GROUP BY w.source, w.cap, w.weight, w.place
        ), opened AS (
            SELECT w.*, l.level, cap <= l.level * weight AS full_up,
                   first(CASE WHEN cap > l.level * weight THEN l.level END
                         ORDER BY CASE WHEN cap > l.level * weight THEN 0 ELSE 1 END, cap / weight, place)
                       OVER () AS final
            FROM weighed w JOIN levels l ON l.source IS NOT DISTINCT FROM w.source
        ), aims AS (
            SELECT *, CASE WHEN full_up OR final IS NULL THEN cap ELSE final * weight END::DOUBLE AS target
            FROM opened
        ), placed AS (
            SELECT s.doc_id, s.size, a.source_size, a.target, floor(a.target + 0.5)::BIGINT AS budget, a.a, a.b,
                   sum(s.size) OVER (PARTITION BY a.place ORDER BY s.key, s.doc_id, s.size
                                     ROWS UNBOUNDED PRECEDING)::BIGINT - s.size AS start
            FROM sized s JOIN aims a ON a.source IS NOT DISTINCT FROM s.source
        ), taken AS (
            SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS runs FROM placed
        ), parts AS (
            -- the document at the budget's end counts if more than half of it lies before
            SELECT *, (runs * size + CASE WHEN 2 * (budget - runs * source_size - start) > size THEN size ELSE 0 END)::BIGINT
                   AS taken
            FROM taken
        )
        SELECT doc_id, size, source_size, target, taken,
               CASE WHEN taken > 0 THEN round((start / budget) * (a + b)
                   / (a + sqrt(a * a + (b * b - a * a) * (start / budget))), 9) END AS position
        FROM parts
    """,
    "op4_lm_scoring": f"""
        WITH words AS (
            SELECT doc_id, {_WORDS.format(text="coalesce(text, '')")} AS w FROM documents
        ), sizes AS (
            SELECT doc_id, len(w) AS n, (SELECT sum(len(w)) FROM words) - len(w) AS others FROM words
        ), tokens AS (
            SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS word FROM words
        ), pairs AS (
            SELECT *, lag(word) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM tokens
        ), counted AS (
            SELECT doc_id, i,
                   count(*) OVER (PARTITION BY word) - count(*) OVER (PARTITION BY word, doc_id) AS ones,
                   CASE WHEN before IS NOT NULL THEN count(*) OVER (PARTITION BY before, word)
                        - count(*) OVER (PARTITION BY before, word, doc_id) END AS twos
            FROM pairs
        ), contexts AS (
            SELECT *, lag(ones) OVER (PARTITION BY doc_id ORDER BY i) AS context FROM counted
        ), shares AS (
            SELECT doc_id, CASE
                WHEN twos > 0 THEN twos / context
                WHEN twos IS NOT NULL THEN 0.4::DOUBLE * CASE WHEN ones > 0 THEN ones / others ELSE 0.4::DOUBLE / others END
                WHEN ones > 0 THEN ones / others
                ELSE 0.4::DOUBLE / others END AS share
            FROM contexts JOIN sizes USING (doc_id)
            WHERE others > 0
        ), sums AS (
            SELECT doc_id, sum(log10(share)) AS log10_score FROM shares GROUP BY doc_id
        )
        SELECT doc_id, n AS n_words, round(log10_score / n, 6) AS mean_log10
        FROM sizes LEFT JOIN sums USING (doc_id)
    """,
    "op7_substring_dedup": f"""
        WITH words AS (
            SELECT doc_id, {_WORDS.format(text="coalesce(text, '')")} AS w FROM documents
        ), windows AS (
            SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS edge
            FROM words, unnest(range(1, len(w) - 11)) AS r(i)
        ), firsts AS (
            SELECT edge, min(doc_id) AS first_id FROM windows GROUP BY edge
        ), removed AS (
            SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS place
            FROM windows JOIN firsts USING (edge) WHERE first_id < doc_id
        ), tokens AS (
            SELECT doc_id, unnest(range(1, len(w) + 1)) AS place, unnest(w) AS word FROM words
        ), kept AS (
            SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY place) AS line
            FROM tokens ANTI JOIN removed USING (doc_id, place) GROUP BY doc_id
        )
        SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed,
               sha256(coalesce(line, '')) AS kept_sha256
        FROM words LEFT JOIN kept USING (doc_id)
    """,
    "op9_exact_topk": """
        WITH vectors AS (
            SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
            FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), pairs AS (
            SELECT q.row, q.vec_id AS query_id, c.vec_id, c.row AS other, list_dot_product(q.v, c.v)::BIGINT AS score
            FROM vectors q JOIN vectors c ON q.row <> c.row
            WHERE q.vec_id % 50 = 0
        ), ranked AS (
            SELECT query_id, row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id, other)::INTEGER AS rank,
                   vec_id, score
            FROM pairs
        )
        SELECT * FROM ranked WHERE rank <= 5
    """,
    "op2_host_rules": f"""
        WITH words AS (
            SELECT doc_id, source, coalesce(text, '') AS text, {_WORDS.format(text="coalesce(text, '')")} AS w,
                   list_filter(string_split(coalesce(text, ''), chr(10)),
                               lambda x: regexp_matches(x, '[^\\x09-\\x0D ]')) AS lines
            FROM documents
        ), windows AS (
            SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS gram
            FROM words, unnest(range(1, len(w) - 6)) AS r(i)
        ), repeated AS (
            SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, gram) > 1
        ), covered AS (
            SELECT doc_id, count(DISTINCT place) AS n
            FROM (SELECT doc_id, unnest(range(i, i + 8)) AS place FROM repeated) GROUP BY doc_id
        ), counted AS (
            SELECT doc_id, source, len(w) AS n_words,
                   length(regexp_replace(text, '[\\x09-\\x0D ]', '', 'g')) AS word_chars,
                   length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
                   (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
                   coalesce(n, 0) AS n_repeat_words
            FROM words LEFT JOIN covered USING (doc_id)
        ), based AS (
            SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM counted
        ), hosts AS (
            SELECT source, count(*) AS docs, count(*) FILTER (base_failed) AS failed FROM based GROUP BY source
        ), overall AS (
            SELECT sum(failed) / sum(docs) AS mean, count(*) AS hosts FROM hosts
        ), spread AS (
            SELECT mean, CASE WHEN hosts > 1
                THEN (SELECT sum((failed / docs - mean) ** 2) FROM hosts) / (hosts - 1) ELSE 0 END AS variance
            FROM overall
        ), prior AS (
            SELECT mean, least(greatest(
                CASE WHEN variance > 0 THEN mean * (1 - mean) / variance - 1 ELSE 1e6 END, 1), 1e6) AS strength
            FROM spread
        ), rates AS (
            SELECT source, (failed + mean * strength) / (docs + strength) AS rate FROM hosts, prior
        )
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
               NOT base_failed AND rate <= 0.5 AS kept, round(rate, 6)::DOUBLE AS host_rate
        FROM based b JOIN rates r ON b.source IS NOT DISTINCT FROM r.source
    """,
    "op11_hard_negatives": """
        WITH whole AS (
            SELECT row_number() OVER () AS row, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                   list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
            FROM embeddings
            WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), scored AS (
            SELECT a.row AS anchor, a.vec_id AS anchor_id, o.row, o.vec_id, o.label = a.label AS alike,
                   list_sum(list_transform(list_zip(a.v, o.v), lambda p: p[1] * p[2]))::BIGINT AS score
            FROM whole a JOIN whole o ON a.row <> o.row WHERE a.vec_id % 100 = 0
        ), positives AS (
            SELECT anchor, anchor_id, row, vec_id AS positive_id, score AS positive_score FROM scored WHERE alike
            QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id, row) <= 5
        )
        SELECT p.anchor_id, positive_id, row_number() OVER w::INTEGER AS rank, n.vec_id AS negative_id, positive_score,
               n.score AS negative_score
        FROM positives p JOIN scored n ON n.anchor = p.anchor AND NOT n.alike
            AND 30 * positive_score <= 100 * n.score AND 100 * n.score <= 90 * positive_score
        WINDOW w AS (PARTITION BY p.anchor, p.row ORDER BY n.score DESC, n.vec_id, n.row)
        QUALIFY row_number() OVER w <= 10
    """,
    "op12_conversation_repair": """
        WITH RECURSIVE bits AS (
            SELECT n, n AS c, 0 AS k FROM range(256) r(n)
            UNION ALL
            SELECT n, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8
        ), crc AS (
            SELECT list(c ORDER BY n) AS t FROM bits WHERE k = 8
        ), keyed AS (
            SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                   coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key
            FROM conversations
        ), kinds AS (
            SELECT conv_id, turn, role, text, xor(list_reduce(
                list_prepend(4294967295::BIGINT, list_transform(string_split(key, ''), lambda x: ascii(x)::BIGINT)),
                lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) % 20 AS kind
            FROM keyed, crc
        ), damaged AS (
            SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
                   CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
                   unnest(CASE kind WHEN 0 THEN [] WHEN 3 THEN [1, 2] ELSE [1] END) AS copy
            FROM kinds
        ), placed AS (
            SELECT *, dense_rank() OVER (ORDER BY conv_id NULLS FIRST) AS conv, left(role, 1) AS initial,
                   row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, encode(role), encode(text)) AS place,
                   NOT regexp_matches(text, '[^\\x09-\\x0D ]') AS is_blank,
                   NOT regexp_matches(text, '[.!?][\\x09-\\x0D ]*\\z') AS is_cut
            FROM damaged
        ), seen AS (
            SELECT *, row_number() OVER (PARTITION BY conv, role, text ORDER BY place) > 1 AS is_again,
                   lag(initial) OVER (PARTITION BY conv ORDER BY place) || initial AS pair
            FROM placed
        ), faults AS (
            SELECT *, is_blank OR is_again AS bound,
                   CASE WHEN is_cut AND NOT is_blank AND NOT is_again THEN 5 ELSE 0 END AS more
            FROM seen
        ), figures AS (
            SELECT conv, any_value(conv_id) AS conv_id, count(*) AS n,
                   coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
                   count(*) FILTER (is_blank) AS blank, count(*) FILTER (is_again AND NOT is_blank) AS duplicate,
                   count(*) FILTER (more > 0) AS truncated,
                   count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal
            FROM faults GROUP BY conv
        ), ways AS (
            -- the least (cost, audit, lines) of each state: s0 nothing yet, s1 after a system turn, s2 user, s3 assistant
            SELECT conv, 0::BIGINT AS place, {'c': 0, 'a': '', 'r': ''} AS s0, NULL::STRUCT(c INTEGER, a VARCHAR, r VARCHAR) AS s1,
                   {'c': 5, 'a': 'I', 'r': chr(10) || 'user:'} AS s2,
                   {'c': 10, 'a': 'II', 'r': chr(10) || 'user:' || chr(10) || 'assistant:'} AS s3
            FROM figures
            UNION ALL
            SELECT conv, place, s0, s1,
                   list_sort(list_filter([s2, CASE WHEN s0 IS NOT NULL THEN {'c': s0.c + 5, 'a': s0.a || 'I', 'r': s0.r || chr(10) || 'user:'} END,
                       CASE WHEN s1 IS NOT NULL THEN {'c': s1.c + 5, 'a': s1.a || 'I', 'r': s1.r || chr(10) || 'user:'} END,
                       CASE WHEN s3 IS NOT NULL THEN {'c': s3.c + 5, 'a': s3.a || 'I', 'r': s3.r || chr(10) || 'user:'} END],
                       lambda x: x IS NOT NULL))[1],
                   list_sort(list_filter([s3, CASE WHEN s2 IS NOT NULL THEN {'c': s2.c + 5, 'a': s2.a || 'I', 'r': s2.r || chr(10) || 'assistant:'} END],
                       lambda x: x IS NOT NULL))[1]
            FROM (
                SELECT w.conv, f.place,
                       {'c': s0.c + 2, 'a': s0.a || 'D', 'r': s0.r} AS s0,
                       list_sort(list_filter([CASE WHEN s1 IS NOT NULL THEN {'c': s1.c + 2, 'a': s1.a || 'D', 'r': s1.r} END,
                           CASE WHEN NOT bound AND initial = 's' THEN {'c': s0.c + more, 'a': s0.a || 'K', 'r': s0.r || chr(10) || role || ':' || text} END],
                           lambda x: x IS NOT NULL))[1] AS s1,
                       list_sort(list_filter(list_concat([{'c': s2.c + 2, 'a': s2.a || 'D', 'r': s2.r}],
                           flatten(list_transform(list_filter([s0, s1, s3], lambda x: x IS NOT NULL AND NOT bound), lambda x: [
                               {'c': x.c + 1 + more, 'a': x.a || 'R', 'r': x.r || chr(10) || 'user:' || text},
                               CASE WHEN initial = 'u' THEN {'c': x.c + more, 'a': x.a || 'K', 'r': x.r || chr(10) || role || ':' || text} END]))),
                           lambda x: x IS NOT NULL))[1] AS s2,
                       list_sort(list_filter([{'c': s3.c + 2, 'a': s3.a || 'D', 'r': s3.r},
                           CASE WHEN NOT bound THEN {'c': s2.c + 1 + more, 'a': s2.a || 'R', 'r': s2.r || chr(10) || 'assistant:' || text} END,
                           CASE WHEN NOT bound AND initial = 'a' THEN {'c': s2.c + more, 'a': s2.a || 'K', 'r': s2.r || chr(10) || role || ':' || text} END],
                           lambda x: x IS NOT NULL))[1] AS s3
                FROM ways w JOIN faults f ON f.conv = w.conv AND f.place = w.place + 1
            )
        ), ends AS (
            SELECT conv, list_sort([s0, s3])[1] AS best FROM ways JOIN figures USING (conv) WHERE place = n
        )
        SELECT ids.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank,
               coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
               coalesce(illegal, 0) AS illegal, coalesce(best.c, 0)::BIGINT AS cost, coalesce(best.a, '') AS audit,
               sha256(coalesce(substr(best.r, 2), '')) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id FROM conversations) ids
        LEFT JOIN (figures JOIN ends USING (conv)) f ON f.conv_id IS NOT DISTINCT FROM ids.conv_id
    """,
}
