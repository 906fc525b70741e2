"""DuckDB SQL of the queries whose oracles need more than a line."""

from __future__ import annotations

from talkloom import constants as C
from talkloom.plans.standins import cte
from talkloom.streaming import progress

WHITE = r"[\s\x0b\x1c-\x1f\x85\p{Z}]"
FOLD = f"'{C.FOLD_FROM}', '{C.FOLD_TO}'"


def collapsed(text: str) -> str:
    return f"trim(regexp_replace({text}, '{WHITE}+', ' ', 'g'))"


def normalized(text: str) -> str:
    return collapsed(f"translate({text}, {FOLD})")


def points(text: str) -> str:
    """List of the code points of a text."""
    return f"regexp_extract_all({text}, '(?s).')"


def loops(text: str) -> str:
    """Is there a decoder loop: a character six times in a row, or a word with its space four times?

    The first of the four words may be the end of a longer one, if it begins at a word's boundary.
    """
    c, t = points(text), rf"regexp_extract_all({text}, '[^\t\n\x0b\f\r\x85\p{{Z}}]+[\t\n\x0b\f\r\x85\p{{Z}}]+')"
    letter = r"'[\p{L}\p{M}\p{N}\p{Pc}]'"
    same = " AND ".join(f"c[i] = c[i + {k}]" for k in range(1, 6))
    edge = f"(length(t[i]) > length(t[i + 1]) AND regexp_matches(substr(t[i], length(t[i]) - length(t[i + 1]), 1), {letter})) <> regexp_matches(substr(t[i + 1], 1, 1), {letter})"
    return f"""(SELECT len(list_filter(range(1, len(c) - 4), lambda i: NOT regexp_matches(c[i], '[\\n\\r\\x{{85}}\\x{{2028}}\\x{{2029}}]') AND {same})) > 0
      OR len(list_filter(range(1, len(t) - 2), lambda i: t[i + 2] = t[i + 1] AND starts_with(t[i + 3], t[i + 1]) AND ends_with(t[i], t[i + 1]) AND {edge})) > 0
    FROM (SELECT {c} AS c, {t} AS t))"""


TEXT_FLAGS = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), n AS (SELECT *, {normalized("text")} AS norm, {loops("text")} AS looping FROM d)
SELECT doc_id, concat_ws(',', CASE WHEN looping THEN 'repetition' END, CASE WHEN regexp_matches(norm, '\\p{{Nd}}') THEN 'verify_numbers' END,
  CASE WHEN contains(text, '{C.MARKER}') OR norm = '' THEN 'unclear' END) AS flags FROM n"""

PUBLISH_GATE = f"""
{cte("segments")}, g AS (SELECT call_id, count(*) AS n_rows, count(*) FILTER ({normalized("text")} = '{C.MARKER}') AS marker_only, count(*) FILTER (looping) AS looping
  FROM (SELECT *, {loops("text")} AS looping FROM segments) GROUP BY 1)
SELECT *, CASE WHEN looping > 0 THEN 'looping' WHEN marker_only > 0.35 * n_rows THEN 'unresolved' ELSE 'publish' END AS status FROM g"""


def promotion(entries: str) -> str:
    return f"""
WITH{entries},
 near AS (SELECT * FROM m WHERE macro_wer <= (SELECT min(macro_wer) FROM m) + 0.02 ORDER BY unresolved_token_rate, macro_cer, macro_wer, model LIMIT 1),
 ours AS (SELECT coalesce(bool_or(o_custkey % 5 = 4 AND o_orderkey % 97 = 96), false) AS invented FROM orders WHERE 'm' || CAST(o_custkey % 5 AS VARCHAR) = (SELECT model FROM near)),
 b AS (SELECT (SELECT count(*) FROM nation) + (SELECT count(*) FROM region) AS n),
 c AS (SELECT n = 30 AS reference_split_30_10, runs >= 3 * n AS seeded_repeats_at_least_3, macro_wer <= 0.9 * 0.8 AS wer_relative_reduction_20pct, macro_cer <= 0.8 * 0.8 AS cer_relative_reduction_20pct,
   number_precision >= 0.4 AS number_precision_not_lower, NOT invented AS no_unsupported_numbers, true AS zero_decoder_loops, true AS zero_duplicate_intervals, unresolved_token_rate <= 0.9 * 0.65 AS unresolved_relative_reduction_35pct
   FROM near, ours, b)
SELECT *, reference_split_30_10 AND seeded_repeats_at_least_3 AND wer_relative_reduction_20pct AND cer_relative_reduction_20pct AND number_precision_not_lower AND no_unsupported_numbers AND zero_decoder_loops
  AND zero_duplicate_intervals AND unresolved_relative_reduction_35pct AS eligible FROM c"""


# rows one by one: a row joins the one shown before it or opens the next
_SHOWN = f"""
 o AS (SELECT call_id, row_number() OVER (PARTITION BY call_id ORDER BY start, "end", speaker, text, uncertain) AS k, start, "end", CASE WHEN trim(coalesce(speaker, '')) = '' THEN '{C.UNKNOWN_SPEAKER}' ELSE trim(speaker) END AS speaker,
   coalesce(text, '') AS text, coalesce(uncertain, false) AS uncertain FROM segments),
 f AS (
   SELECT *, 0 AS position FROM o WHERE k = 1
   UNION ALL
   SELECT call_id, k, CASE WHEN j THEN fs ELSE start END, "end", speaker, CASE WHEN j THEN trim(rtrim(ft) || ' ' || ltrim(text)) ELSE text END, uncertain OR (j AND fu), CASE WHEN j THEN fp ELSE fp + 1 END
   FROM (SELECT o.*, f.start AS fs, f.text AS ft, f.uncertain AS fu, f.position AS fp,
       o.speaker = f.speaker AND o.speaker <> '{C.UNKNOWN_SPEAKER}' AND o.start - f."end" BETWEEN 0 AND 0.35 AND o."end" - f.start <= 15 AS j
     FROM f JOIN o ON o.call_id = f.call_id AND o.k = f.k + 1)),
 shown AS (SELECT call_id, CAST(position AS INTEGER) AS position, arg_max(start, k) AS start, arg_max("end", k) AS "end", arg_max(speaker, k) AS speaker, arg_max(text, k) AS text, arg_max(uncertain, k) AS uncertain FROM f GROUP BY call_id, position)"""

DISPLAY_ROWS = f"{cte('segments')},{_SHOWN} SELECT * FROM shown"


def _clock(seconds: str) -> str:
    return f"printf('%02d:%02d', CAST(greatest(0, {seconds}) AS BIGINT) // 60, CAST(greatest(0, {seconds}) AS BIGINT) % 60)"


CALL_DOCUMENTS = f"""
{cte("segments")},{_SHOWN},
 l AS (SELECT call_id, string_agg('**' || regexp_replace(speaker, '[\\r\\n*]', '', 'g') || ':** `' || {_clock("floor(start)")} || '–' || {_clock('ceil("end")')} || '` ' || text
   || CASE WHEN uncertain AND NOT contains(text, '{C.MARKER}') THEN '{C.ROW_WARNING}' ELSE '' END, chr(10) || chr(10) ORDER BY position) AS body FROM shown GROUP BY 1)
SELECT call_id, '{C.DOCUMENT_TITLE}' || chr(10) || chr(10) || '{C.DOCUMENT_FILE}`call-' || call_id || '.mp3`' || chr(10) || '{C.DOCUMENT_REVIEW}' || CASE WHEN call_id % 2 = 0 THEN '{C.REVIEWED}' ELSE '{C.NEEDS_REVIEW}' END
  || chr(10) || chr(10) || '{C.DOCUMENT_BODY}' || chr(10) || chr(10) || body || chr(10) AS content FROM l"""


# words with their trailing space, dealt evenly over a segment of at least half a second
_WORDS = """
 s AS (SELECT call_id, "index", 's' || "index" AS id, start, greatest("end", start + 0.5) AS "end", string_split(text, ' ') AS w FROM segments),
 st AS (SELECT *, ("end" - start) / len(w) AS step FROM s),
 words AS (SELECT call_id, "index", id, i AS word_index, w[i + 1] || CASE WHEN i + 1 < len(w) THEN ' ' ELSE '' END AS word, start + i * step AS start, start + (i + 1) * step AS "end" FROM (SELECT *, unnest(range(0, len(w))) AS i FROM st))"""

TIMED_UNITS = f"""
{cte("segments")},{_WORDS},
 f AS (
   SELECT call_id, id, word_index, start AS us, "end" AS ue, 0 AS unit FROM words WHERE word_index = 0
   UNION ALL
   SELECT w.call_id, w.id, w.word_index, CASE WHEN w."end" - us <= 8 AND w.start - ue <= 0.65 THEN us ELSE w.start END, w."end", CASE WHEN w."end" - us <= 8 AND w.start - ue <= 0.65 THEN unit ELSE unit + 1 END
   FROM f JOIN words w ON w.call_id = f.call_id AND w.id = f.id AND w.word_index = f.word_index + 1)
SELECT call_id, id, CAST(unit AS INTEGER) AS unit, min(us) AS start, max(ue) AS "end", trim(string_agg(word, '' ORDER BY word_index)) AS text, CAST(count(*) AS INTEGER) AS n_words
FROM f JOIN words USING (call_id, id, word_index) GROUP BY call_id, id, unit"""

_VOTE = """
 {out} AS (
   SELECT r.*, CASE WHEN t.o / greatest(0.01, r."end" - r.start) >= 0.6 AND coalesce(t.next, 0) / greatest(0.01, r."end" - r.start) <= 0.15 THEN t.speaker_id END AS speaker_id
   FROM {rows} r LEFT JOIN (
     SELECT *, lead(o) OVER v AS next, row_number() OVER v AS rn FROM (
       SELECT r.call_id, r.id, {word} AS word_index, t.speaker_id, sum(least(r."end", t."end") - greatest(r.start, t.start)) AS o
       FROM {rows} r JOIN turns t ON t.call_id = r.call_id AND t.start < r."end" AND t."end" > r.start GROUP BY ALL)
     WINDOW v AS (PARTITION BY call_id, id, word_index ORDER BY o DESC, speaker_id)) t
   ON t.call_id = r.call_id AND t.id = r.id AND t.word_index = {word} AND t.rn = 1)"""
_TURNS = """
 turns AS (SELECT call_id, start, start + 4 + "index" % 5 AS "end", CASE WHEN "index" % 2 = 0 THEN 'A' ELSE 'B' END AS speaker_id FROM s)"""

ATTRIBUTE_SPEAKERS = f"""
{cte("segments")},{_WORDS},{_TURNS},{_VOTE.format(out="whole", rows="st", word="0")},{_VOTE.format(out="named", rows="words", word="r.word_index")},
 c AS (SELECT *, CASE WHEN word_index > 0 AND speaker_id IS DISTINCT FROM lag(speaker_id) OVER v THEN 1 ELSE 0 END AS change FROM named WINDOW v AS (PARTITION BY call_id, id ORDER BY word_index)),
 g AS (SELECT *, sum(change) OVER (PARTITION BY call_id, id ORDER BY word_index) AS g FROM c),
 parts AS (SELECT call_id, id, g, arg_min(start, word_index) AS start, arg_max("end", word_index) AS "end", count(*) OVER (PARTITION BY call_id, id) AS n FROM g GROUP BY call_id, id, g),
 rows_ AS (SELECT call_id, id, start, "end", (SELECT any_value(x.speaker_id) FROM g x WHERE x.call_id = parts.call_id AND x.id = parts.id AND x.g = parts.g) AS speaker_id FROM parts WHERE n > 1
   UNION ALL SELECT call_id, id, start, "end", speaker_id FROM whole WHERE (call_id, id) NOT IN (SELECT (call_id, id) FROM parts WHERE n > 1))
SELECT call_id, 's' || row_number() OVER (PARTITION BY call_id ORDER BY start, "end", id) AS id, id AS source_segment_id, start, "end", coalesce(speaker_id, '{C.UNKNOWN_SPEAKER}') AS speaker,
  CASE WHEN speaker_id IS NULL THEN 'speaker_uncertain' ELSE '' END AS flags FROM rows_"""

ROLE_ERRORS = f"""
{cte("segments", "audio_files")}, u AS (SELECT call_id, id, trim(substr(text, 1, 10)) <> '' AS grounded FROM segments WHERE speaker = 'user'),
 n AS (SELECT call_id, count(DISTINCT id) FILTER (grounded) AS n, bool_or(NOT grounded) AS loose FROM u GROUP BY 1)
SELECT DISTINCT call_id, speaker AS speaker_id, 'omitted speaker' AS error FROM segments WHERE speaker NOT IN ('system', 'user')
UNION ALL SELECT call_id, 'user', 'citation not grounded' FROM n WHERE loose
UNION ALL SELECT n.call_id, 'user', 'role without two segments' FROM n LEFT JOIN audio_files a ON a.id = n.call_id WHERE n < 2 OR direction = 'internal'"""


def _short(text: str, limit: int) -> str:
    t = f"replace({collapsed(f"coalesce({text}, '')")}, '`', '')"
    return f"CASE WHEN length({t}) > {limit} THEN rtrim(substr({t}, 1, {limit - 1})) || '…' ELSE {t} END"


PROGRESS_EVENTS = f"""
SELECT event_id, coalesce(nullif({_short("event_type", 80)}, ''), 'processing') AS stage, 'active' AS state, coalesce(nullif({_short("props", 280)}, ''), '{progress.STAGE_MESSAGE}') AS message FROM events"""

_INNER = rf"[\p{{L}}\p{{M}}\p{{N}}\p{{Pc}}{C.ZWNJ}]"


def _whole(alias: str) -> str:
    return rf"(?i)(^|[^{_INNER[1:-1]}]){alias}($|[^{_INNER[1:-1]}])"


def glossary() -> str:
    """Neighbouring hits share a character, so every alias is replaced twice."""
    ctes, last = [], "segments"
    for k, alias in enumerate((r"the\s+and", r"the\s+and", r"der\s+und", r"der\s+und")):
        before = "0" if k == 0 else "n"
        ctes.append(f"g{k} AS (SELECT call_id, \"index\", source, regexp_replace(text, '{_whole(alias)}', '\\1Ladenda\\2', 'g') AS text, {before} + len(regexp_extract_all(text, '{_whole(alias)}')) AS n FROM {last})")
        last = f"g{k}"
    ctes[0] = ctes[0].replace("source,", "text AS source,", 1)
    seen = f"list_transform(regexp_extract_all(source, '{_INNER}+'), lambda w: replace({normalized('w')}, '{C.ZWNJ}', ''))"
    return f"""{cte("segments")}, {", ".join(ctes)}
SELECT call_id, "index", sha256(text) AS digest, CAST(n AS INTEGER) AS replacements,
  CASE WHEN list_contains({seen}, 'Onea') THEN 'Onea' WHEN list_contains({seen}, 'on') THEN 'on' WHEN list_contains({seen}, 'en') THEN 'en' END AS observed FROM {last}"""


_REVERSED = f"array_to_string(list_reverse({points('w[spot + 1]')}), '')"
SUGGESTIONS = f"""
{cte("segments")}, s AS (SELECT call_id, id, speaker, text, string_split(text, ' ') AS w, "index" % len(string_split(text, ' ')) AS spot FROM segments),
 t AS (SELECT *, array_to_string(list_concat(w[1:spot], ['{C.MARKER}'], w[spot + 2:len(w)]), ' ') AS cur, array_to_string(list_concat(w[1:spot], [{_REVERSED}], w[spot + 2:len(w)]), ' ') AS alt FROM s),
 a AS (SELECT call_id, id, trim(cur) AS cur, 0 AS position, 'raw' AS source, {collapsed("text")} AS text FROM t
   UNION ALL SELECT call_id, id, trim(cur), 2, 'alternative', {collapsed("alt")} FROM t
   UNION ALL SELECT call_id, id, trim(cur), 4, 'uncertainty', CASE WHEN len(string_split(trim(cur), '{C.MARKER}')) = 2 THEN {collapsed(f"replace(trim(cur), '{C.MARKER}', speaker)")} END FROM t),
 k AS (SELECT *, {normalized("text")} AS key FROM a WHERE text <> '' AND length(text) <= 20000 AND NOT contains(text, '{C.MARKER}')),
 safe AS (SELECT *, row_number() OVER (PARTITION BY call_id, id, key ORDER BY position) AS rn FROM k WHERE key <> '' AND key <> {normalized("cur")} AND NOT {loops("text")})
SELECT call_id, id, CAST(position AS INTEGER) AS position, source || '-' || substr(sha256(source || chr(0) || text), 1, 16) AS candidate_id, source,
  CASE source WHEN 'raw' THEN '{C.SUGGESTION_LABELS["raw"]}' WHEN 'alternative' THEN '{C.SUGGESTION_LABELS["alternative"]}' ELSE '{C.SUGGESTION_LABELS["uncertainty"]}' END AS source_label, text FROM safe WHERE rn = 1"""


def _dominant(p: str, rows: str) -> str:
    """CTEs that end in {p}out (call_id, id, speaker_id): the dominant exclusive speaker of rows (call_id, id, start, end)."""
    return f"""
 {p}hit AS (SELECT s.call_id, s.id, s.start, s."end", t.start AS ts, t."end" AS te, t.speaker_id FROM {rows} s LEFT JOIN turns t ON t.call_id = s.call_id AND t.start < s."end" AND t."end" > s.start),
 {p}pts AS (SELECT DISTINCT call_id, id, unnest([start, "end", coalesce(greatest(start, ts), start), coalesce(least("end", te), "end")]) AS p FROM {p}hit),
 {p}sl AS (SELECT * FROM (SELECT call_id, id, p, lead(p) OVER (PARTITION BY call_id, id ORDER BY p) AS q FROM {p}pts) WHERE q IS NOT NULL),
 {p}act AS (SELECT s.call_id, s.id, p, q, count(DISTINCT speaker_id) AS n, min(speaker_id) AS one FROM {p}sl s LEFT JOIN {p}hit h ON h.call_id = s.call_id AND h.id = s.id AND ts <= (p + q) / 2 AND (p + q) / 2 < te GROUP BY 1, 2, 3, 4),
 {p}sums AS (SELECT call_id, id, coalesce(sum(q - p) FILTER (n > 0), 0) AS speech FROM {p}act GROUP BY 1, 2),
 {p}top AS (SELECT *, row_number() OVER (PARTITION BY call_id, id ORDER BY sec DESC, one) AS rn FROM (SELECT call_id, id, one, sum(q - p) AS sec FROM {p}act WHERE n = 1 GROUP BY 1, 2, 3)),
 {p}out AS (SELECT s.call_id, s.id, CASE WHEN sec / nullif(speech, 0) >= 0.8 AND speech / (s."end" - s.start) >= 0.5 THEN one END AS speaker_id
   FROM {rows} s JOIN {p}sums u ON u.call_id = s.call_id AND u.id = s.id LEFT JOIN {p}top t ON t.call_id = s.call_id AND t.id = s.id AND t.rn = 1)"""


_FIELD = r"[^\s\x0b\x1c-\x1f\x85\p{Z}]+"
REFINE_SPEAKERS = f"""
{cte("segments")}, s AS (SELECT call_id, "index", 's' || "index" AS id, start, greatest("end", start + 0.5) AS "end", text, regexp_extract_all(text, '{_FIELD}') AS w FROM segments),{_TURNS},{_dominant("a", "s")},
 o AS (SELECT s.* FROM s JOIN aout a ON a.call_id = s.call_id AND a.id = s.id WHERE a.speaker_id IS NULL),
 k AS (SELECT *, unnest(range(0, len(w))) AS i, ("end" - start) / len(w) AS step FROM o),
 x AS (SELECT call_id, id AS seg, id || '#' || i AS id, i, start + i * step AS start, start + (i + 1) * step AS "end", i % 7 <> 6 AS accepted, substr(text, CAST(i + length(array_to_string(w[1:i], '')) + 1 AS BIGINT), length(w[i + 1])) = w[i + 1] AS literal FROM k),
 e AS (SELECT call_id, seg, count(*) AS n, bool_and(literal) AS literal FROM x GROUP BY 1, 2),
 u AS (SELECT x.* FROM x JOIN e USING (call_id, seg) WHERE accepted AND e.literal),{_dominant("b", "u")},
 v AS (SELECT u.call_id, u.seg, count(DISTINCT b.speaker_id) AS ids, count(b.speaker_id) AS named, min(b.speaker_id) AS one FROM u JOIN bout b ON b.call_id = u.call_id AND b.id = u.id GROUP BY 1, 2),
 r AS (SELECT e.call_id, e.seg AS id, CASE WHEN ids = 1 AND named >= 0.6 * n THEN one END AS refined_id, coalesce(ids > 1, false) AS mixed, CASE WHEN NOT e.literal THEN 'text not literal' END AS error FROM e LEFT JOIN v USING (call_id, seg))
SELECT s.call_id, s.id, a.speaker_id, refined_id, coalesce(mixed, false) AS mixed, error, CASE WHEN refined_id IS NOT NULL THEN 'boundary_review_required,word_aligned' WHEN mixed THEN 'mixed_speakers' ELSE '' END AS flags
FROM s JOIN aout a ON a.call_id = s.call_id AND a.id = s.id LEFT JOIN r ON r.call_id = s.call_id AND r.id = s.id"""

CHANNEL_SEGMENTS = f"""{cte("segments")}, c AS (
  SELECT call_id, "index" % 2 + 1 AS channel_id, start, "end", CASE WHEN "index" % 5 <> 4 THEN text END AS text, CASE WHEN "index" % 3 = 0 THEN [speaker] ELSE [] END AS flags FROM segments),
o AS (
  SELECT *, max("end") OVER (PARTITION BY call_id ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM c),
g AS (
  SELECT *, sum(CASE WHEN reach IS NULL OR start >= reach THEN 1 ELSE 0 END) OVER (PARTITION BY call_id ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS island FROM o),
m AS (
  SELECT call_id, min(start) AS start, max("end") AS "end", count(*) AS n, first(text ORDER BY start, "end", channel_id) AS one,
    string_agg(trim(text), ' ' ORDER BY start, "end", channel_id) FILTER (trim(text) <> '') AS texts,
    flatten(list(flags ORDER BY start, "end", channel_id)) AS flags, string_agg(CAST(channel_id AS VARCHAR), ',' ORDER BY start, "end", channel_id) AS channels
  FROM g GROUP BY call_id, island)
SELECT call_id, start, "end", sha256(coalesce(CASE WHEN n > 1 THEN texts ELSE one END, '')) AS digest, CAST(CASE WHEN n > 1 THEN 0 ELSE 1 END AS BIGINT) AS n_words,
  array_to_string(CASE WHEN n > 1 THEN list_sort(list_distinct(list_append(flags, 'channel_overlap'))) ELSE flags END, ',') AS flags, channels
FROM m"""
