"""SQL for the queries of the text operators."""

from __future__ import annotations

from lodestar.llm.quality import CLASSES, COMMON_WORDS, OWN_WORDS, QualityRules
from lodestar.llm.urls import LOWER, SOFT_TERMS, STRICT_TERMS, UPPER

RULES = QualityRules()


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _quality() -> str:
    class_counts = ", ".join(
        f"length(regexp_replace(t, {_quoted(p.replace(' ', chr(92) + 'x20'))}, '', 'g'))" for p in CLASSES.values()
    )
    lists = ", ".join(f"({_quoted(lang)}, [{', '.join(map(_quoted, words))}])" for lang, words in COMMON_WORDS.items())
    symbols, body, upper, caseless = (list(CLASSES).index(name) + 1 for name in ("symbol", "body", "upper", "caseless"))
    return f"""
WITH listed(lang, words) AS (VALUES {lists}),
split AS (
  SELECT row_number() OVER () AS id, doc_id, lang, coalesce(text, '') AS t,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS ws
  FROM documents),
windows AS (
  SELECT id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS w
  FROM split, unnest(range(1, len(ws) - 1)) AS u(i)),
twice AS (SELECT id, i, count(*) OVER (PARTITION BY id, w) AS n FROM windows),
repeated AS (
  SELECT id, count(DISTINCT p) AS n_repeat_words FROM twice, unnest([i, i + 1, i + 2]) AS u(p) WHERE n > 1 GROUP BY id),
lines AS (
  SELECT id, count(*) - count(DISTINCT l) AS n_dup_lines
  FROM split, unnest(string_split(t, chr(10))) AS u(l) WHERE regexp_matches(l, '[^\\x20\\x09-\\x0D]') GROUP BY id),
counted AS (
  SELECT id, doc_id, lang, t, ws, len(ws) AS n_words, coalesce(list_sum(list_transform(ws, lambda w: length(w))), 0)::BIGINT AS word_chars,
         coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
         [{class_counts}] AS part
  FROM split LEFT JOIN repeated USING (id) LEFT JOIN lines USING (id)),
based AS (
  SELECT *, part[{symbols}] AS n_symbols, list_append(part, length(t) - list_sum(part)::BIGINT) AS classes,
         n_words < {RULES.min_words} OR 100 * n_repeat_words > {RULES.max_repeat_percent} * n_words AS base_failed,
         part[{caseless}] > part[{body}] + part[{upper}] AS caseless
  FROM counted),
prose AS (
  SELECT id FROM based
  WHERE NOT base_failed AND n_symbols * 1000 <= length(t) AND classes[{upper}] * 5 <= classes[{body}] + classes[{caseless}]),
own AS (
  SELECT lang, w, row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, w) AS place
  FROM based JOIN prose USING (id), unnest(ws) AS u(w)
  WHERE lang IS NOT NULL AND lang NOT IN (SELECT lang FROM listed) AND regexp_matches(w, '\\p{{L}}') GROUP BY lang, w
  QUALIFY place <= {OWN_WORDS}),
vocabulary AS (FROM listed UNION ALL SELECT lang, list(w ORDER BY place) FROM own GROUP BY lang),
spoken AS (
  SELECT id, w, count(*) AS n FROM based, unnest(ws) AS u(w) WHERE w IN (SELECT unnest(words) FROM vocabulary) GROUP BY id, w),
bins AS (
  SELECT id, v.lang, 'c' AS kind, i AS bin, classes[i] AS n, length(t) AS total
  FROM based, vocabulary v, unnest(range(1, {len(CLASSES) + 2})) AS u(i)
  UNION ALL
  SELECT b.id, v.lang, 'w', i, coalesce(s.n, 0), b.n_words
  FROM based b CROSS JOIN (SELECT lang, unnest(words) AS w, unnest(range(1, len(words) + 1)) AS i FROM vocabulary) v
  LEFT JOIN spoken s ON s.id = b.id AND s.w = v.w
  UNION ALL
  SELECT b.id, v.lang, 'w', 0, b.n_words - coalesce((SELECT sum(n) FROM spoken s WHERE s.id = b.id AND list_contains(v.words, s.w)), 0), b.n_words
  FROM based b, vocabulary v),
refs AS (
  SELECT lang, kind, bin, sum(n) / sum(sum(n)) OVER (PARTITION BY lang, kind) AS q
  FROM bins JOIN based USING (id, lang) JOIN prose USING (id)
  GROUP BY lang, kind, bin),
kinds AS (
  SELECT lang, coalesce(sum(q) FILTER (bin = {caseless}), 0) > coalesce(sum(q) FILTER (bin IN ({body}, {upper})), 0) AS caseless
  FROM refs WHERE kind = 'c' GROUP BY lang),
far AS (
  SELECT id, kind, bins.lang AS lang, sqrt(greatest(0, sum(
    CASE WHEN n > 0 THEN n / total * log2(2 * (n / total) / (n / total + q)) ELSE 0 END
    + CASE WHEN q > 0 THEN q * log2(2 * q / (n / total + q)) ELSE 0 END) / 2)) AS d
  FROM bins JOIN refs USING (lang, kind, bin) JOIN kinds USING (lang) JOIN based b USING (id)
  WHERE total > 0 AND kinds.caseless = b.caseless GROUP BY id, kind, bins.lang),
nearest AS (
  SELECT id, min(d) FILTER (kind = 'c') AS c, min(d) FILTER (kind = 'w') AS w FROM far GROUP BY id)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
       n_repeat_words::BIGINT AS n_repeat_words, base_failed,
       NOT base_failed
       AND NOT (length(t) >= {RULES.min_class_chars} AND coalesce(c, 0) > CASE
         WHEN n_words >= {RULES.min_distance_words} AND coalesce(w, 0) > {RULES.max_word_distance} THEN {RULES.max_strange_class_distance}
         ELSE {RULES.max_class_distance} END) AS kept
FROM based LEFT JOIN nearest USING (id)"""


def _urls() -> str:
    bounded = lambda term: f"regexp_matches(u, '(^|[^\\p{{L}}\\p{{N}}])({term})([^\\p{{L}}\\p{{N}}]|$)')"
    soft = " + ".join(f"{bounded(term)}::INT" for term in SOFT_TERMS)
    return f"""
WITH url AS (
  SELECT page_id, translate(coalesce(url, ''), '{UPPER}', '{LOWER}') AS u,
         CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest
  FROM pages),
cut AS (
  SELECT page_id, u, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM url),
rules(host, path, name, verdict) AS (VALUES
  ('com', '/', 'com/', 'allow'), ('example.com', '/en/', 'example.com/en/', 'block'),
  ('www.example.com', '/en/', 'www.example.com/en/', 'allow'), ('net', '/es/', 'net/es/', 'block'),
  ('net', '/fr/', 'net/fr/', 'block')),
best AS (
  SELECT page_id, arg_max(name, length(name)) AS rule, arg_max(r.verdict, length(name)) AS verdict
  FROM cut c JOIN rules r ON (c.host = r.host OR ends_with(c.host, '.' || r.host)) AND starts_with(c.path, r.path)
  GROUP BY page_id)
SELECT page_id, host, path, rule,
       coalesce(verdict, CASE WHEN {bounded("|".join(STRICT_TERMS))} OR {soft} >= 2 THEN 'block' ELSE 'allow' END) AS verdict
FROM cut LEFT JOIN best USING (page_id)"""


CHAT = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
ordered AS (
  SELECT *, coalesce(lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text), '') AS before,
         length(text) + length(regexp_replace(text, '[^<\[\]\\]', '', 'g')) AS body
  FROM turns)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(body + CASE role WHEN 'system' THEN 9 + 7 WHEN 'user' THEN 10 + 8 WHEN 'assistant' THEN 11 + 5 END)::BIGINT AS formatted_chars,
       bool_and((before, role) IN (('', 'system'), ('', 'user'), ('system', 'user'), ('user', 'assistant'), ('assistant', 'user'))) AS valid
FROM ordered GROUP BY conv_id"""

COLLOCATIONS = rf"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
split AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda w: w <> '') AS ws FROM pieces),
grams AS (
  SELECT lang, k, array_to_string(ws[i:i + k - 1], ' ') AS phrase
  FROM split, unnest([1, 2, 3, 4, 5]) AS s(k), unnest(range(1, len(ws) - k + 2)) AS u(i)),
counts AS (SELECT lang, phrase, any_value(k) AS k, count(*) AS f FROM grams GROUP BY lang, phrase),
totals AS (SELECT lang, sum(f) AS n FROM counts WHERE k = 1 GROUP BY lang),
candidates AS (SELECT lang, phrase, string_split(phrase, ' ') AS ws, k, f FROM counts WHERE k > 1 AND f >= 100),
inside AS (
  SELECT DISTINCT c.lang, array_to_string(ws[i:i + m - 1], ' ') AS phrase, c.f
  FROM candidates c, unnest([2, 3, 4]) AS s(m), unnest(range(1, k - m + 2)) AS u(i) WHERE m < k),
kept AS (SELECT * FROM candidates c WHERE NOT EXISTS (FROM inside i WHERE i.lang = c.lang AND i.phrase = c.phrase AND 100 * i.f >= 100 * c.f)),
cuts AS (
  SELECT lang, phrase, f AS a, cut, array_to_string(ws[1:cut], ' ') AS head, array_to_string(ws[cut + 1:k], ' ') AS tail
  FROM kept, unnest(range(1, k)) AS u(cut)),
scored AS (
  SELECT c.lang, c.phrase, c.a, x.f AS l, y.f AS r, t.n::BIGINT AS n,
         ((1000::HUGEINT * c.a * t.n::HUGEINT) // (x.f::HUGEINT * y.f))::BIGINT AS score, cut
  FROM cuts c JOIN counts x ON x.lang = c.lang AND x.phrase = c.head JOIN counts y ON y.lang = c.lang AND y.phrase = c.tail
  JOIN totals t ON t.lang = c.lang),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM lowest QUALIFY rank <= 2000"""

VECTORS = """
WITH RECURSIVE sound AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE len(embedding) = len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
pairs AS (
  SELECT a.vec_id AS u, b.vec_id AS v FROM sound a JOIN sound b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= 0.9),
reach AS (SELECT u, v FROM pairs UNION SELECT r.u, p.v FROM reach r JOIN pairs p ON r.v = p.u),
least AS (SELECT u, min(v) AS m FROM reach GROUP BY u),
counts AS (SELECT u, count(*) AS n FROM pairs GROUP BY u)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, least(vec_id, coalesce(m, vec_id)) AS component_id, vec_id <= coalesce(m, vec_id) AS kept
FROM embeddings LEFT JOIN least ON least.u = vec_id LEFT JOIN counts ON counts.u = vec_id"""

ORACLES: dict[str, str] = {
    "op1_quality_divergence": _quality(),
    "op6_chat_template": CHAT,
    "op7_url_vocabulary": _urls(),
    "op11_phrase_collocations": COLLOCATIONS,
    "op13_small_worlds": VECTORS,
}
