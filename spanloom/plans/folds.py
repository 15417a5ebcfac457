"""SQL of order-dependent queries: folds over a transcript as recursive queries on arrays (positions count from zero)."""

from __future__ import annotations

from spanloom.functions import lexicon, scoring
from spanloom.functions import text as T
from spanloom.operators import models, segment


def _quoted(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


_END = segment.SENTENCE_END.pattern.replace("'", "''")
_WORDS = "list_filter(regexp_split_to_array(coalesce(text, ''), '\\s+'), lambda x: x <> '')"

#: tid, language, duration, ws, s, e: a row of words for each document, 0.4 s a word.
DOCUMENT_WORDS = f"""d AS (SELECT doc_id::VARCHAR AS tid, coalesce(lower(substr(lang, 1, 2)), 'en') AS language, {_WORDS} AS ws FROM documents),
w AS (SELECT tid, language, len(ws) * 0.4::DOUBLE AS duration, ws, list_transform(range(len(ws)), lambda i: i * 0.4::DOUBLE) AS s, list_transform(range(len(ws)), lambda i: (i + 1) * 0.4::DOUBLE) AS e FROM d)"""

#: The same for each conversation: turns 1.5 s apart, their words spread evenly over them.
TURN_WORDS = f"""t AS (SELECT conv_id, turn, {_WORDS} AS ws, len({_WORDS})::DOUBLE * 0.4 AS n FROM conversations),
g AS (SELECT conv_id, turn, ws, sum(n + 1.5) OVER o - 1.5 - n AS a, sum(n + 1.5) OVER o - 1.5 AS b FROM t WINDOW o AS (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)),
w AS (SELECT conv_id::VARCHAR AS tid, 'en' AS language, max(b) AS duration, flatten(list(ws ORDER BY turn)) AS ws, flatten(list(list_transform(range(len(ws)), lambda i: a + (b - a) / len(ws) * i) ORDER BY turn)) AS s,
  flatten(list(list_transform(range(len(ws)), lambda i: a + (b - a) / len(ws) * (i + 1)) ORDER BY turn)) AS e FROM g GROUP BY conv_id)"""


#: All conversations as one transcript: each begins where its number times the longest one's time, and two seconds, says.
JOINED_WORDS = f"""{TURN_WORDS.replace("w AS (SELECT conv_id::VARCHAR", "each AS (SELECT conv_id::VARCHAR")},
slot AS (SELECT ceil(max(b)) + 2 AS z FROM g),
jw AS (SELECT tid::BIGINT AS conv, list_transform(s, lambda x: tid::BIGINT * z + x) AS s, list_transform(e, lambda x: tid::BIGINT * z + x) AS e, ws FROM each, slot),
w AS (SELECT 'all' AS tid, 'en' AS language, max(e[len(e)]) AS duration, flatten(list(ws ORDER BY conv)) AS ws, flatten(list(s ORDER BY conv)) AS s, flatten(list(e ORDER BY conv)) AS e FROM jw)"""


def sentences(words: str) -> str:
    """CTEs down to sent (tid, language, idx, start, end, text, pause_before, pause_after, n_words).

    A sentence that begins at a is looked for from position nx on: a hard pause closes two words, a pause
    or a sentence mark four (which last longer than the least duration here), and 48 words are cut at a clause mark.
    """
    return f"""{words},
f AS (SELECT tid, len(ws) AS n, list_transform(range(1, len(ws)), lambda i: s[i + 1] - e[i] >= 1.1) AS hard,
  list_transform(range(1, len(ws)), lambda i: s[i + 1] - e[i] >= 0.65 OR (regexp_matches(ws[i], '{_END}') AND NOT list_contains([{_quoted(sorted(segment.ABBREVIATIONS))}], lower(ws[i])))) AS closes,
  list_transform(range(1, len(ws) + 1), lambda i: regexp_matches(ws[i], '{segment.CLAUSE_END.pattern}')) AS clause FROM w),
r AS (SELECT tid, 0::BIGINT AS k, 0::BIGINT AS a, 0::BIGINT AS nx FROM f WHERE n > 0 UNION ALL
  SELECT tid, k + 1, m + 1, i + 1 FROM (SELECT *, CASE WHEN by_size AND list_contains(clause[i - 6 : i + 1], true) THEN i + 1 - list_position(list_reverse(clause[i - 6 : i + 1]), true) ELSE i END AS m FROM (
    SELECT *, least(c1, c2, c3) AS i, c3 IS NOT NULL AND c3 < least(coalesce(c1, n), coalesce(c2, n)) AS by_size FROM (
      SELECT r.tid, k, n, clause, greatest(nx, a + 1) + nullif(list_position(hard[greatest(nx, a + 1) + 1 : n - 1], true), 0) - 1 AS c1,
        greatest(nx, a + 3) + nullif(list_position(closes[greatest(nx, a + 3) + 1 : least(n - 1, a + 48)], true), 0) - 1 AS c2, CASE WHEN a + 47 <= n - 2 THEN greatest(nx, a + 47) END AS c3 FROM r JOIN f USING (tid)))) WHERE i IS NOT NULL),
b AS (SELECT r.tid, language, k::INT AS idx, a, coalesce(lead(a) OVER (PARTITION BY r.tid ORDER BY k) - 1, len(ws) - 1) AS z, ws, s, e FROM r JOIN w USING (tid)),
x AS (SELECT tid, language, idx, s[a + 1] AS start, e[z + 1] AS "end", regexp_replace(array_to_string(ws[a + 1 : z + 1], ' '), '\\s+([,.!?;:…])', '\\1', 'g') AS text FROM b),
sent AS (SELECT *, greatest(0.0, coalesce(round(start - lag("end") OVER o, 3), start)) AS pause_before, greatest(0.0, coalesce(round(lead(start) OVER o - "end", 3), 2.0)) AS pause_after,
  len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> ''))::INT AS n_words FROM x WINDOW o AS (PARTITION BY tid ORDER BY idx))"""


SENTENCES = f'WITH RECURSIVE {sentences(TURN_WORDS)} SELECT tid AS transcript_id, language, idx, start, "end", text, pause_before, pause_after, n_words FROM sent'
SENTENCES_DOCUMENTS = f'WITH RECURSIVE {sentences(DOCUMENT_WORDS)} SELECT tid AS transcript_id, language, idx, start, "end", text, pause_before, pause_after, n_words FROM sent'

SPEECH_CHECK = f"""WITH RECURSIVE {sentences(DOCUMENT_WORDS)} SELECT tid AS transcript_id, count(*) AS n_sentences, sum(n_words)::BIGINT AS n_words, sum("end" - start) AS speech_seconds,
count(*) >= 4 AND sum(n_words) >= 25 AS enough FROM sent GROUP BY tid"""

#: Blocks of 420 s that begin 45 s before the end of the last, over arrays of a transcript's sentences.
BLOCKS = f"""WITH RECURSIVE {sentences(DOCUMENT_WORDS)}, l AS (SELECT tid, list(start ORDER BY idx) AS s, list("end" ORDER BY idx) AS e, count(*) AS n FROM sent GROUP BY tid),
k AS (SELECT tid, 0::BIGINT AS block, 0::BIGINT AS i, s, e, n, coalesce(list_position(list_transform(e[2:], lambda x: x - s[1] >= 420.0), true) - 1, n - 1) AS j FROM l UNION ALL
  SELECT tid, block + 1, i2, s, e, n, i2 + coalesce(list_position(list_transform(e[i2 + 2 :], lambda x: x - s[i2 + 1] >= 420.0), true) - 1, n - 1 - i2) FROM (
    SELECT *, greatest(i + 1, i + len(list_filter(s[i + 1 : j + 1], lambda x: x <= e[j + 1] - 45.0)) - 1) AS i2 FROM k) WHERE j < n - 1)
SELECT tid AS transcript_id, block::INT AS block, i::INT AS start_idx, j::INT AS end_idx FROM k"""

_ASKED = models._asked(5, 20.0, 90.0).replace("'", "''")
#: The lines of each block under its task.
BLOCK_PROMPTS = BLOCKS.replace("SELECT tid AS transcript_id, block::INT AS block", f"""SELECT transcript_id, block, start_idx, end_idx, sha256('{_ASKED}' || string_agg('[' || idx || '] ' || CASE WHEN pause_before >= 1.0 THEN '«pause» ' ELSE '' END || text, chr(10) ORDER BY idx)) AS prompt_sha256
FROM (SELECT tid AS transcript_id, block::INT AS block""") + ") JOIN sent ON tid = transcript_id AND idx BETWEEN start_idx AND end_idx GROUP BY ALL"


#: Phrases of four words at most that closing punctuation ends after two; even words of 0.4 s have no pauses and stay under 2.4 s.
PHRASES = f"""WITH RECURSIVE {DOCUMENT_WORDS}, f AS (SELECT tid, len(ws) AS n, list_transform(ws, lambda x: regexp_matches(x, '[.!?…:;][''"»”\\)\\]]*$')) AS stop FROM w),
r AS (SELECT tid, 0::BIGINT AS k, 0::BIGINT AS a FROM f WHERE n > 0 UNION ALL
  SELECT tid, k + 1, z FROM (SELECT r.tid, k, n, least(a + 4, coalesce(a + 1 + nullif(list_position(stop[a + 2 : a + 4], true), 0), n)) AS z FROM r JOIN f USING (tid)) WHERE z < n),
b AS (SELECT tid, k, a, lead(a) OVER (PARTITION BY tid ORDER BY k) AS z FROM r)
SELECT tid AS transcript_id, k::INT AS phrase, s[a + 1] AS start, e[coalesce(z, len(ws))] AS "end", (coalesce(z, len(ws)) - a)::INT AS n_words, array_to_string(ws[a + 1 : coalesce(z, len(ws))], ' ') AS text FROM b JOIN w USING (tid)"""

#: The same for conversations as one transcript, turn by turn: the pause between turns ends a phrase.
PHRASES_LONG = f"""WITH RECURSIVE {JOINED_WORDS}, f AS (SELECT conv_id, turn, len(ws) AS n, list_transform(ws, lambda x: regexp_matches(x, '[.!?…:;][''"»”\\)\\]]*$')) AS stop FROM g),
r AS (SELECT conv_id, turn, 0::BIGINT AS a FROM f WHERE n > 0 UNION ALL
  SELECT conv_id, turn, z FROM (SELECT conv_id, turn, n, least(r.a + 4, coalesce(r.a + 1 + nullif(list_position(stop[r.a + 2 : r.a + 4], true), 0), n)) AS z FROM r JOIN f USING (conv_id, turn)) WHERE z < n),
x AS (SELECT conv_id, turn, a AS lo, lead(a) OVER (PARTITION BY conv_id, turn ORDER BY a) AS hi FROM r),
y AS (SELECT conv_id, turn, lo, coalesce(hi, len(ws)) AS hi, ws, conv_id * z + (a + (b - a) / len(ws) * lo) AS s, conv_id * z + (a + (b - a) / len(ws) * coalesce(hi, len(ws))) AS e FROM x JOIN g USING (conv_id, turn), slot)
SELECT 'all' AS transcript_id, row_number() OVER (ORDER BY conv_id, turn, lo) - 1 AS phrase, s AS start, e AS "end", (hi - lo)::INT AS n_words, array_to_string(ws[lo + 1 : hi], ' ') AS text FROM y"""

def _breaks(k: int) -> str:
    """Whether word a + k (from 0) opens a phrase that word a does not reach."""
    closed = f" OR stop[a + {k}]" if k > 1 else ""
    return f"WHEN a + {k} < n AND (e[a + {k + 1}] - s[a + 1] > 2.4 OR s[a + {k + 1}] - e[a + {k}] >= 0.55{closed}) THEN a + {k}"


_LIGHTS = ", ".join(f"CASE WHEN {k} > m THEN NULL WHEN r{k} > u{k - 1} THEN r{k} ELSE u{k - 1} + 0.04 END AS u{k}" for k in range(1, 5))

#: Caption events: phrases by length, pauses and marks; words light up in order, and a phrase makes way for its neighbours.
CAPTION_EVENTS = f"""WITH RECURSIVE {TURN_WORDS}, f AS (SELECT tid, len(ws) AS n, s, e, list_transform(ws, lambda x: regexp_matches(x, '[.!?…:;][''"»”\\)\\]]*$')) AS stop FROM w),
r AS (SELECT tid, 0::BIGINT AS p, 0::BIGINT AS a FROM f WHERE n > 0 UNION ALL
  SELECT tid, p + 1, z FROM (SELECT tid, p, n, CASE {" ".join(map(_breaks, (1, 2, 3)))} ELSE a + 4 END AS z FROM r JOIN f USING (tid)) WHERE z < n),
b AS (SELECT r.tid, p, a, coalesce(lead(a) OVER (PARTITION BY r.tid ORDER BY p), n) AS z, s, e FROM r JOIN f USING (tid)),
c AS (SELECT tid, p, a, z, z - a AS m, e[z] AS stop, s[a + 1] - 0.12 AS u0, {", ".join(f"CASE WHEN {k} < z - a THEN e[a + {k}] - least(0.12, greatest(0.0, s[a + {k + 1}] - e[a + {k}]) / 2) WHEN {k} = z - a THEN e[z] + 0.10 END AS r{k}" for k in range(1, 5))} FROM b),
l AS (SELECT tid, p, a, z, m, stop, u0, {_LIGHTS} FROM c),
o AS (SELECT *, CASE WHEN u0 < lag(stop) OVER q THEN least(lag(stop) OVER q, u1 - 0.04) ELSE u0 END AS f0 FROM l WINDOW q AS (PARTITION BY tid ORDER BY p)),
h AS (SELECT *, list_slice([f0, u1, u2, u3, u4], 1, m) AS head, [u1, u2, u3, u4][m] AS tail, lead(f0) OVER (PARTITION BY tid ORDER BY p) AS nxt FROM o),
lit AS (SELECT *, list_append(head, CASE WHEN tail > nxt THEN greatest(head[m] + 0.05, nxt - 0.02) ELSE tail END) AS lights FROM h),
v AS (SELECT tid, p, a, z, k, lights[k + 1] - 0.05 AS x, lights[k + 2] - 0.05 AS y FROM (SELECT *, unnest(range(m)) AS k FROM lit)),
n AS (SELECT tid, p, k, a, z, x, CASE WHEN y > x THEN y ELSE x + 0.08 END AS y FROM v)
SELECT tid AS transcript_id, p::INT AS phrase, k::INT AS word, greatest(0.0, x) AS start, y AS "end", a::INT AS first, z::INT AS last, ws[a + k + 1] AS text FROM n JOIN w USING (tid) WHERE y > 0"""

#: Fillers with a pad and what pauses have beyond 0.35 s are cut out of each conversation; pieces of 0.12 s or more stay, or all of it.
KEEP_SPANS = f"""WITH {TURN_WORDS}, u AS (SELECT tid, duration AS fe, unnest(ws) AS x, unnest(s) AS a, unnest(e) AS b FROM w),
p AS (SELECT *, greatest(0.0, coalesce(max(b) OVER (PARTITION BY tid ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0)) AS before FROM u WHERE b > 0 AND a < fe),
c AS (SELECT tid, before + 0.175 AS s, a - 0.175 AS e FROM p WHERE a - before > 0.6 UNION ALL SELECT tid, max(b) + 0.175, any_value(fe) - 0.175 FROM p GROUP BY tid HAVING any_value(fe) - max(b) > 0.6 UNION ALL
  SELECT tid, greatest(0.0, a - 0.06), least(fe, b + 0.06) FROM p WHERE lower(regexp_replace(x, '^[ .,!?…-]+|[ .,!?…-]+$', '', 'g')) IN ({_quoted(T.FILLER_WORDS)})),
n AS (SELECT tid, s, e, CASE WHEN s <= max(e) OVER (PARTITION BY tid ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 0.02 THEN 0 ELSE 1 END AS f FROM c WHERE e > s),
i AS (SELECT *, sum(f) OVER (PARTITION BY tid ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS k FROM n), un AS (SELECT tid, min(s) AS s, max(e) AS e FROM i GROUP BY tid, k),
q AS (SELECT tid, greatest(0.0, coalesce(lag(e) OVER (PARTITION BY tid ORDER BY s), 0.0)) AS s, s AS e FROM un UNION ALL SELECT w.tid, greatest(0.0, coalesce(max(un.e), 0.0)), any_value(duration) FROM w LEFT JOIN un USING (tid) GROUP BY w.tid),
kept AS (SELECT * FROM q WHERE e - s >= 0.12)
SELECT tid AS clip_id, s AS start, e AS "end" FROM kept UNION ALL SELECT tid, 0.0, duration FROM w WHERE tid NOT IN (SELECT tid FROM kept)"""

#: The zig-zag order, then one pass that swaps forward the next of another type where neighbours in the middle share one.
RETENTION_ORDER = """WITH RECURSIVE o AS (SELECT o_custkey, o_orderkey, o_totalprice, o_orderpriority AS t, o_orderkey % 97 AS payoff, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders),
l AS (SELECT *, n > 2 AND r > 1 AND row_number() OVER (PARTITION BY o_custkey ORDER BY (r = 1)::INT, payoff DESC, o_totalprice DESC, o_orderkey) = 1 AS last FROM o),
m AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY (r = 1 OR last)::INT, r) AS m FROM l),
p AS (SELECT *, CASE WHEN n <= 2 THEN r WHEN r = 1 THEN 1 WHEN last THEN n WHEN m <= ceil((n - 2) / 2.0) THEN 2 * m ELSE 2 * (n - 2 - m + 1) + 1 END AS pos FROM m),
z AS (SELECT o_custkey, list(o_orderkey ORDER BY pos) AS k, list(t ORDER BY pos) AS t, count(*) AS n FROM p GROUP BY o_custkey),
s AS (SELECT o_custkey, k, t, n, 3::BIGINT AS i FROM z UNION ALL
  SELECT o_custkey, CASE WHEN x > 0 THEN list_transform(range(1, n + 1), lambda j: CASE WHEN j = i THEN k[i + x] WHEN j = i + x THEN k[i] ELSE k[j] END) ELSE k END,
    CASE WHEN x > 0 THEN list_transform(range(1, n + 1), lambda j: CASE WHEN j = i THEN t[i + x] WHEN j = i + x THEN t[i] ELSE t[j] END) ELSE t END, n, i + 1 FROM (
      SELECT *, CASE WHEN t[i] = t[i - 1] THEN coalesce(list_position(list_transform(t[i + 1 : n - 1], lambda v: v <> t[i - 1]), true), 0) ELSE 0 END AS x FROM s) WHERE n > 3 AND i <= n - 1),
e AS (SELECT o_custkey, k, n FROM s QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY i DESC) = 1)
SELECT o_custkey, unnest(k) AS o_orderkey, unnest(range(1, n + 1))::BIGINT AS position FROM e"""


# ---- signals and windows of documents -----------------------------------------------

_ACCENTS = dict(zip("éèêàç", "45678"))


def _rule(pattern: str) -> str:
    """A rule over `plain`, whose letters beyond ASCII are underscores, or over `kept`, where the rules' own accents are digits: DuckDB's word edges know ASCII only."""
    mapped = "".join(_ACCENTS.get(c, c) for c in pattern)
    return f"regexp_matches({'plain' if mapped == pattern else 'kept'}, '(?i){mapped.replace(chr(39), chr(39) * 2)}')"


def _score(category: str) -> str:
    def of(rules) -> str:
        return "1 - exp(-(" + " + ".join(f"CASE WHEN {_rule(p)} THEN {w:.2f}::DOUBLE ELSE 0.0 END" for p, w in rules[category]) + "))"

    return f"CASE WHEN language = 'fr' THEN {of(lexicon.LANGUAGES['fr'])} ELSE {of(lexicon.EN)} END AS {category}"


_CATEGORIES = [*lexicon.CATEGORIES, "weak_start"]

def _any(rules) -> str:
    return "(" + " OR ".join(_rule(p) for p, _ in rules) + ")"


def profiles(words: str) -> str:
    """CTEs down to prof: sentences with the score of each category."""
    return f"""WITH RECURSIVE {sentences(words)},
pl AS (SELECT *, regexp_replace(lower(text), '[^\\x00-\\x7F\\PL]', '_', 'g') AS plain, regexp_replace(translate(lower(text), '{"".join(_ACCENTS)}', '{"".join(_ACCENTS.values())}'), '[^\\x00-\\x7F\\PL]', '_', 'g') AS kept FROM sent),
prof AS MATERIALIZED (SELECT tid, language, idx, start, "end", text, pause_before, pause_after, n_words, {", ".join(map(_score, _CATEGORIES))},
  {_any(lexicon.FILLER_ONLY)} AND n_words <= 5 AS filler, {_any(lexicon.TRANSITION_OUT)} AS transition FROM pl)"""


SIGNAL_PROFILES = f"""{profiles(DOCUMENT_WORDS)} SELECT tid AS transcript_id, idx, {", ".join(_CATEGORIES)}, concat_ws(',', {", ".join(f"CASE WHEN {c} >= 0.5 THEN '{c}' END" for c in lexicon.CATEGORIES)}) AS tags FROM prof"""

_LISTS = ", ".join(f"list({c} ORDER BY idx) AS {c}" for c in _CATEGORIES)
_STOPS = _quoted(dict.fromkeys(T.STOPWORDS))


def _top(category: str, lo: str, hi: str) -> str:
    return f"list_max({category}[{lo} + 1 : {hi} + 1])"


def scored(words: str, block: int = 1 << 40) -> str:
    """CTEs down to win (tid, i, j, start, end, score): every window of 20 to 90 s by its features.  Topic shifts are rounded as they print.  Arrays hold `block` sentences and three times as many after them."""
    return f"""{profiles(words)},
tk AS (SELECT tid, idx, list_distinct(list_filter(regexp_extract_all(lower(text), '[\\pL]{{3,}}'), lambda x: NOT list_contains([{_STOPS}], x))) AS k FROM prof),
tl AS (SELECT tid, list(k ORDER BY idx) AS k, count(*) AS n FROM tk GROUP BY tid),
ts AS (SELECT tid, i, n, list_distinct(flatten(k[i - 5 : i])) AS l, list_distinct(flatten(k[i + 1 : i + 6])) AS r FROM tl, range(n) x(i) WHERE i >= 6 AND i < n - 6),
tr AS (SELECT tid, i, CASE WHEN least(len(l), len(r)) > 0 THEN 1 - len(list_intersect(l, r)) / least(len(l), len(r))::DOUBLE ELSE 0.0 END AS s FROM ts),
tq AS (SELECT tid, i, s / coalesce(nullif(max(s) OVER (PARTITION BY tid), 0.0), 1.0) AS x FROM tr),
tp AS (SELECT tid, i, round((x::VARCHAR)::DECIMAL(38, 20), 3)::DOUBLE AS topic FROM tq),
ar AS MATERIALIZED (SELECT tid, blk, list(start ORDER BY idx) AS s, list("end" ORDER BY idx) AS e, list(pause_before ORDER BY idx) AS pb, list(pause_after ORDER BY idx) AS pa, list(n_words ORDER BY idx) AS nw, {_LISTS},
  list(regexp_matches(lower(trim(text)), '^(and|but|so|because|which|that''?s why|et|mais|donc|parce)') ORDER BY idx) AS opens, list(regexp_matches(text, '[.!?…。！？؟][''"»”\\)\\]]*\\s*$') ORDER BY idx) AS closes, list(coalesce(topic, 0.0) ORDER BY idx) AS topic
  FROM (SELECT prof.*, topic, unnest(range(greatest(0, idx // {block} - 3), idx // {block} + 1)) AS blk FROM prof LEFT JOIN tp ON prof.tid = tp.tid AND idx = i) GROUP BY tid, blk),
sp AS (SELECT a.tid, a.idx AS i, b.idx AS j FROM prof a JOIN prof b ON a.tid = b.tid AND b.idx >= a.idx AND b."end" - a.start BETWEEN 20.0 AND 90.0 WHERE a.weak_start < 0.95),
ft AS (SELECT *, j - i + 1 AS n, e[j + 1] - s[i + 1] AS span, least(j, i + 2) AS head, least(j, i + greatest(1, trunc((j - i + 1) * 0.55::DOUBLE)::INT)) AS tail, least(j, i + trunc((j - i + 1) * 0.7::DOUBLE)::INT) AS early, weak_start[i + 1] AS weak, topic[i + 1] AS shift FROM (SELECT tid, i // {block} AS blk, i % {block} AS i, j - i // {block} * {block} AS j FROM sp) JOIN ar USING (tid, blk)),
pt AS (SELECT tid, blk, i, j, s[i + 1] AS start, e[j + 1] AS "end", span,
  least(1.0, greatest({_top("hook", "i", "head")}, 0.6 * {_top("curiosity", "i", "head")}, 0.5 * {_top("opinion", "i", "head")}) * (1.0 - 0.45 * weak) + 0.15 * shift) AS hook,
  least(1.0, greatest({_top("payoff", "tail", "j")}, 0.75 * {_top("value", "tail", "j")}, 0.6 * {_top("emotion", "tail", "j")})) AS payoff,
  least(1.0, 0.7 * {_top("emotion", "i", "j")} + 0.3 * list_sum(emotion[i + 1 : j + 1]) / n) AS emotion,
  least(1.0, greatest({_top("curiosity", "i", "early")}, 0.5 * {_top("story", "i", "j")})) AS curiosity,
  greatest(0.0, least(1.0, 1.0 - 0.6 * weak + 0.25 * shift) * CASE WHEN opens[i + 1] THEN 0.75 ELSE 1.0 END) AS standalone,
  least(1.0, greatest(0.0, 0.35 + least(0.3, pb[i + 1] / 1.2 * 0.3) + least(0.25, pa[j + 1] / 1.2 * 0.25) + CASE WHEN closes[j + 1] THEN 0.15 ELSE -0.10 END)) AS editability,
  list_sum(nw[i + 1 : j + 1]) / span AS pace FROM ft),
win AS MATERIALIZED (SELECT tid, (i + blk * {block})::INT AS i, (j + blk * {block})::INT AS j, start, "end", CASE WHEN span > 0 THEN (25::DOUBLE * hook + 25 * payoff + 15 * emotion + 15 * curiosity + 10 * standalone + 10 * editability)
  * (0.72 + 0.18 * exp(-((span - 45.0) ** 2) / (2 * 22.0 * 22.0)) + 0.10 * CASE WHEN pace < 2.6 THEN least(1.0, pace / 2.6) ELSE greatest(0.5, 1.0 - (pace - 2.6) / 4) END) ELSE 0.0 END AS score, hook, payoff, emotion, curiosity, standalone, editability FROM pt)"""


WINDOW_SCORES = f'{scored(DOCUMENT_WORDS)} SELECT tid AS transcript_id, i AS start_idx, j AS end_idx, start, "end", score FROM win'

_KINDS = "CASE " + " ".join(f"WHEN top = t[{k}] THEN '{lexicon.TYPE_OF[c]}'" for k, c in enumerate(lexicon.CATEGORIES, 1)) + " END"

def kept(words: str, block: int = 1 << 40) -> str:
    """The best window left is kept and what overlaps it by over 0.6 goes, until none is left or 400 are kept."""
    return f"""{scored(words, block)},
n AS (SELECT tid, i, j, start, "end", score, false AS kept, 0 AS step FROM win UNION ALL
  SELECT tid, i, j, start, "end", score, first, step + 1 FROM (SELECT *, row_number() OVER o = 1 AS first, first_value(start) OVER o AS ts, first_value("end") OVER o AS te FROM n WHERE NOT kept AND step < 400 WINDOW o AS (PARTITION BY tid ORDER BY score DESC, i DESC, j DESC))
  WHERE first OR NOT (greatest(te, "end") - least(ts, start) > 0 AND greatest(0.0, least(te, "end") - greatest(ts, start)) / (greatest(te, "end") - least(ts, start)) > 0.6)),
k AS (SELECT n.*, list_transform([{", ".join(lexicon.CATEGORIES)}], lambda x: list_sum(x[i % {block} + 1 : j - i // {block} * {block} + 1])) AS t FROM n JOIN ar ON n.tid = ar.tid AND i // {block} = blk WHERE kept),
found AS (SELECT tid, i, j, start, "end", score, CASE WHEN top > 0.6 THEN {_KINDS} ELSE 'other' END AS clip_type FROM (SELECT *, list_max(t) AS top FROM k))"""


_FOUND = ' SELECT tid AS transcript_id, i AS start_idx, j AS end_idx, start, "end", score, clip_type FROM found'
NMS = kept(DOCUMENT_WORDS) + _FOUND
NMS_LONG = kept(JOINED_WORDS, 100) + _FOUND


# ---- from windows to a final set --------------------------------------------------------


def _iou(a: str, b: str) -> str:
    return f"""(CASE WHEN greatest({a}."end", {b}."end") - least({a}.start, {b}.start) > 0 THEN greatest(0.0, least({a}."end", {b}."end") - greatest({a}.start, {b}.start)) / (greatest({a}."end", {b}."end") - least({a}.start, {b}.start)) ELSE 0.0 END)"""


_KEYS = tuple(scoring.CATEGORY_MAX)


def merged(pool: str, iou: float = 0.4, longest: float = 90.0, ceiling: float = 0.75, keys=_KEYS) -> str:
    """CTEs down to merged (tid, l): the clips of `pool` (tid, pos, i, j, start, end, keys, overall, heuristic, confidence, clip_type) after the merge of overlaps, best first.

    Clips are visited best first; each joins the kept one it overlaps most, or is kept.
    """
    pack = ", ".join(f"{c} := {v}" for c, v in {"pos": "pos", "i": "i", "j": "j", "start": "start", '"end"': '"end"', **{c: c for c in keys}, "overall": "overall", "heuristic": "heuristic", "confidence": "confidence", "clip_type": "clip_type", "source": "'heuristic'", "merged_from": "1"}.items())
    wider = {"i": "least(x.i, c.i)", "j": "greatest(x.j, c.j)", "start": "CASE WHEN x.i <= c.i THEN x.start ELSE c.start END", '"end"': 'CASE WHEN x.j >= c.j THEN x."end" ELSE c."end" END'}
    wider |= {k: f"greatest(x.{k}, c.{k})" for k in (*keys, "overall", "heuristic")} | {"source": "'merged'"}
    fits = f"share < {ceiling} AND {wider[chr(34) + 'end' + chr(34)]} - {wider['start']} <= {longest}"
    new = ", ".join(f"{f} := CASE WHEN {fits} THEN {wider[f]} ELSE x.{f} END" for f in wider)
    return f"""mq AS (SELECT tid, list(struct_pack({pack}) ORDER BY overall DESC, start, pos) AS l, count(*) AS n FROM {pool} GROUP BY tid),
md AS (SELECT tid, l, n, 1::BIGINT AS step, l[1:0] AS kept FROM mq UNION ALL
  SELECT tid, l, n, step + 1, CASE WHEN share IS NULL OR share <= 0 OR share < {iou} THEN list_append(kept, c) ELSE list_transform(kept, lambda x, p: CASE WHEN p = best THEN
      struct_pack(pos := x.pos, {new}, confidence := greatest(x.confidence, 0.9::DOUBLE * c.confidence), clip_type := x.clip_type, merged_from := x.merged_from + 1) ELSE x END) END FROM (
    SELECT *, list_position(ov, share) AS best FROM (SELECT *, list_max(ov) AS share FROM (SELECT *, l[step] AS c, list_transform(kept, lambda x: {_iou("l[step]", "x")}) AS ov FROM md WHERE step <= n)))),
merged AS (SELECT tid, kept AS l FROM md WHERE step = n + 1)"""


def varied(clips: str, target: int = 12, lam: float = 0.7, min_gap: float = 5.0) -> str:
    """CTEs down to varied (tid, rank, c): maximal marginal relevance over merged (tid, l) with `duration`, ranked by overall."""
    near = f"""{_iou("c", "z")} > 0.05 OR (c.start < z."end" + {min_gap} AND z.start < c."end" + {min_gap})"""
    like = f"""least(1.0, CASE WHEN c.clip_type = z.clip_type THEN 0.55::DOUBLE ELSE 0.0 END + 0.45::DOUBLE * greatest(0.0, 1.0 - abs((c.start + c."end") - (z.start + z."end")) / 2 / (greatest(1.0, duration) * 0.25)))"""
    return f"""vo AS (SELECT tid, duration, list(c ORDER BY c.overall DESC, p) AS l FROM (SELECT tid, duration, unnest(l) AS c, unnest(range(len(l))) AS p FROM {clips}) GROUP BY tid, duration),
vs AS (SELECT tid, duration, l, 1::BIGINT AS n, [1::BIGINT] AS chosen, list_transform(l, lambda c: 0.0::DOUBLE) AS near, list_transform(l, lambda c, p: p > 1) AS free FROM vo UNION ALL
  SELECT tid, duration, l, n + 1, list_append(chosen, best), near, list_transform(free, lambda f, p: f AND p <> best) FROM (SELECT *, list_position(v, list_max(v)) AS best FROM (
    SELECT tid, duration, l, n, chosen, near, free, list_transform(l, lambda c, p: CASE WHEN free[p] THEN {lam}::DOUBLE * c.overall / 100.0 - (1.0::DOUBLE - {lam}::DOUBLE) * near[p] END) AS v FROM (
      SELECT tid, duration, l, n, chosen, list_transform(l, lambda c, p: greatest(near[p], {like})) AS near, list_transform(l, lambda c, p: free[p] AND NOT ({near})) AS free FROM (SELECT *, l[chosen[n]] AS z FROM vs WHERE n < {target})))
  WHERE list_max(v) IS NOT NULL)),
vl AS (SELECT tid, l, chosen FROM vs QUALIFY row_number() OVER (PARTITION BY tid ORDER BY n DESC) = 1),
varied AS (SELECT tid, row_number() OVER (PARTITION BY tid ORDER BY c.overall DESC, k)::INT AS rank, c FROM (SELECT tid, unnest(list_transform(chosen, lambda x: l[x])) AS c, unnest(range(len(chosen))) AS k FROM vl))"""


def trimmed(clips: str, low: float, most: int = 3) -> str:
    """CTEs down to trimmed: clips (tid, i, j, ...) joined with fl, i and j moved in over fillers and transitions at the ends."""
    out = []
    for k in range(most):
        out.append(f"tj{k} AS (SELECT * REPLACE (CASE WHEN j > i AND tail[j + 1] AND e[j] - s[i + 1] >= {low} THEN j - 1 ELSE j END AS j) FROM {clips if k == 0 else f'tj{k - 1}'})")
    for k in range(most):
        out.append(f"ti{k} AS (SELECT * REPLACE (CASE WHEN i < j AND head[i + 1] AND e[j + 1] - s[i + 2] >= {low} THEN i + 1 ELSE i END AS i) FROM {f'tj{most - 1}' if k == 0 else f'ti{k - 1}'})")
    return ",\n".join(out) + f",\ntrimmed AS (SELECT * FROM ti{most - 1})"


def _exact(x: str, digits: int) -> str:
    """Rounded by the exact value of a double, exact halves to even: as it prints."""
    return f"printf('%.{digits}f', ({x})::DOUBLE)::DOUBLE"


def analysis(words: str, low: float = 20.0, high: float = 90.0) -> str:
    """CTEs down to clips, the columns of rank.finish: windows scored offline, the best sixty merged, a varied set, edges trimmed and padded."""
    caps = scoring.CATEGORY_MAX
    cap = ", ".join(f"{_exact(f'{k} * {v}', 1)} AS {k}" for k, v in caps.items())
    total = " + ".join(f"least({v}::DOUBLE, greatest(0.0, {k})) / {v} * {v}" for k, v in caps.items())
    base = " + ".join(f"{share}::DOUBLE * c.{k} / {caps[k]} * 100" for k, share in scoring.VIRALITY_SHARE.items())
    bonus = "CASE c.clip_type " + " ".join(f"WHEN '{t}' THEN {b}" for t, b in scoring.VIRALITY_BONUS.items()) + " ELSE 0.0 END"
    return f"""{kept(words).replace("BETWEEN 20.0 AND 90.0", f"BETWEEN {low} AND {high}")},
po AS (SELECT tid, pos, i, j, start, "end", heuristic, clip_type, {cap} FROM (SELECT *, {_exact("score", 2)} AS heuristic, row_number() OVER (PARTITION BY tid ORDER BY score DESC, i DESC, j DESC) AS pos FROM found JOIN win USING (tid, i, j, start, "end", score)) WHERE pos <= 60),
pool AS (SELECT *, {_exact(f"({total}) * 100.0 / 100.0", 2)} AS overall, 0.35::DOUBLE AS confidence FROM po),
{merged("pool", longest=high)},
mw AS (SELECT tid, duration, l FROM merged JOIN w USING (tid)),
{varied("mw")},
fl AS (SELECT tid, list(start ORDER BY idx) AS s, list("end" ORDER BY idx) AS e, list(pause_before ORDER BY idx) AS pb, list(pause_after ORDER BY idx) AS pa, list(text ORDER BY idx) AS x, list(filler OR transition ORDER BY idx) AS tail, list(filler ORDER BY idx) AS head FROM prof GROUP BY tid),
vf AS (SELECT tid, rank, c, c.i AS i, c.j AS j, s, e, pb, pa, x, tail, head FROM varied JOIN fl USING (tid)),
{trimmed("vf", low)},
tt AS (SELECT *, trim(array_to_string(x[i + 1 : j + 1], ' ')) AS body FROM trimmed),
clips AS (SELECT tid AS transcript_id, rank, i AS start_idx, j AS end_idx, greatest(0.0, s[i + 1] - least(0.25::DOUBLE, 0.6::DOUBLE * pb[i + 1])) AS start, e[j + 1] + least(0.4::DOUBLE, 0.6::DOUBLE * greatest(0.0, pa[j + 1])) AS "end",
  c.heuristic AS heuristic, c.overall AS overall, c.confidence AS confidence, c.clip_type AS clip_type, c.source AS source, c.merged_from::INT AS merged_from, {", ".join(f"c.{k} AS {k}" for k in caps)},
  {_exact(f"least(100.0, ({base}) + {bonus})", 1)} AS virality, trim(left(CASE WHEN split_part(body, '.', 1) = '' THEN body ELSE split_part(body, '.', 1) END, 70)) AS title, left(x[i + 1], 200) AS hook_line, body AS text FROM tt)"""


ANALYZE_DOCUMENTS = analysis(DOCUMENT_WORDS) + " SELECT * FROM clips"
ANALYZE_CONVERSATIONS = analysis(TURN_WORDS, 5.0, 60.0) + " SELECT * FROM clips"


# ---- exports of the ranked clips ------------------------------------------------------------


def _half_up(x: str, digits: int) -> str:
    return f"round(({x})::VARCHAR::DECIMAL(38, 18), {digits})::DOUBLE"


def _clock(x: str) -> str:
    s = f"floor(greatest(0.0, {x}))::BIGINT"
    return f"CASE WHEN {s} >= 3600 THEN lpad(({s} // 3600)::VARCHAR, greatest(2, length(({s} // 3600)::VARCHAR))::INT, '0') || ':' ELSE '' END || lpad(({s} % 3600 // 60)::VARCHAR, 2, '0') || ':' || lpad(({s} % 60)::VARCHAR, 2, '0')"


_REPORT = f"""{analysis(DOCUMENT_WORDS)},
report AS MATERIALIZED (SELECT transcript_id, rank, {_half_up("start", 2)} AS start, {_half_up('"end"', 2)} AS "end", {_clock("start")} AS start_tc, {_clock('"end"')} AS end_tc, {_half_up('"end" - start', 2)} AS duration, {_half_up("overall", 1)} AS score,
  clip_type AS "type", title, '' AS reason, {", ".join(f"{_half_up(k, 1)} AS {k}" for k in _KEYS)}, confidence, text FROM clips)"""

EXPORT_CSV = _REPORT + f""" SELECT transcript_id, rank, start, "end", start_tc, end_tc, duration, score, "type", title, reason, {", ".join(_KEYS)} FROM report"""
EXPORT_JSON = _REPORT + f""", j AS (SELECT transcript_id, list(struct_pack(rank := rank, start := start, "end" := "end", duration := duration, start_tc := start_tc, end_tc := end_tc, score := score, scores := struct_pack({", ".join(f"{k} := {k}" for k in _KEYS)}),
  confidence := confidence, "type" := "type", title := title, reason := reason, transcript := text) ORDER BY rank) AS clips FROM report GROUP BY transcript_id)
SELECT transcript_id, to_json(struct_pack(video := transcript_id, clips := clips))::VARCHAR AS json FROM j"""
EXPORT_TEXT = _REPORT + f""" SELECT transcript_id, rank, concat_ws(chr(10), '#' || rank || ' - ' || score || '/100   [' || "type" || ']', start_tc || ' -> ' || end_tc || '   (' || duration || 's)', 'Title: ' || title,
  concat_ws(' | ', {", ".join(f"'{k.capitalize()} ' || {k} || '/{int(v)}'" for k, v in scoring.CATEGORY_MAX.items())}), 'Why: ', 'Transcript:', '  ' || array_to_string(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> ''), ' '), '{"-" * 66}') AS report FROM report"""

_CUT = f"""{analysis(DOCUMENT_WORDS)},
cut AS (SELECT clips.*, greatest(0.0, start - 0.15::DOUBLE) AS cut_start, CASE WHEN duration > 0 THEN least("end" + 0.35::DOUBLE, duration) ELSE "end" + 0.35::DOUBLE END AS cut_end FROM clips JOIN w ON tid = transcript_id)"""
EXPORT_PLAN = _CUT + """, ef AS (SELECT *, unnest(['16:9', '9:16']) AS format, left(replace(trim(regexp_replace(title, '[^\\pL\\pN\\pM_\\s.-]', '', 'g')), ' ', '_'), 40) AS stem FROM cut),
eg AS (SELECT *, 'clip_' || lpad(rank::VARCHAR, 2, '0') || '_' || CASE WHEN stem = '' THEN 'clips' ELSE stem END || '_' || replace(format, ':', 'x') || '.mp4' AS file, format = '16:9' AS stream_copy FROM ef)
SELECT transcript_id, rank, format, cut_start, cut_end, file, stream_copy, concat_ws(' ', 'ffmpeg -y -ss', printf('%.3f', cut_start), '-i in.mp4 -t', printf('%.3f', cut_end - cut_start),
  CASE WHEN stream_copy THEN '-c copy -avoid_negative_ts make_zero' ELSE '-c:v libx264 -preset veryfast -crf 20 -c:a aac' END, file) AS command FROM eg"""
COMPILATION_PLAN = f"""{analysis(DOCUMENT_WORDS)},
cut AS (SELECT transcript_id, rank, greatest(0.0, start - 0.15::DOUBLE) AS cut_start, "end" + 0.35::DOUBLE AS cut_end FROM clips)
SELECT *, coalesce(sum(cut_end - cut_start) OVER (PARTITION BY transcript_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS music_offset FROM cut"""


# ---- the steps of the offline path on pools of their own -----------------------------------

#: Orders of a customer as clips of five-second sentences.
_ORDER_POOL = """pool AS (SELECT o_custkey::VARCHAR AS tid, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS pos, i, j, i * 5.0::DOUBLE AS start, (j + 1) * 5.0::DOUBLE AS "end", hook, payoff, overall, heuristic, confidence, clip_type FROM (
  SELECT o_custkey, o_orderkey, o_orderkey % 60 AS i, o_orderkey % 60 + 3 + o_orderkey % 11 AS j, (o_orderkey % 250) / 10.0::DOUBLE AS hook, (o_orderkey % 90) / 4.0::DOUBLE AS payoff, (o_orderkey * 7 % 1000) / 10.0::DOUBLE AS overall,
    (o_orderkey % 77)::DOUBLE AS heuristic, (o_orderkey % 10) / 10.0::DOUBLE AS confidence, o_orderpriority AS clip_type FROM orders))"""

DEDUPE_MERGE = f"""WITH RECURSIVE {_ORDER_POOL}, {merged("pool", keys=("hook", "payoff"))}
SELECT tid AS customer, c.pos AS pos, c.i AS start_idx, c.j AS end_idx, c.start AS start, c."end" AS "end", c.hook AS hook, c.payoff AS payoff, c.overall AS overall, c.heuristic AS heuristic, c.confidence AS confidence, c.clip_type AS clip_type, c.source AS source, c.merged_from::INT AS merged_from
FROM (SELECT tid, unnest(l) AS c FROM merged)"""

MMR = f"""WITH RECURSIVE {_ORDER_POOL}, mp AS (SELECT tid, 400.0::DOUBLE AS duration, list(struct_pack(pos := pos, start := start, "end" := "end", overall := overall, clip_type := clip_type) ORDER BY pos) AS l FROM pool GROUP BY tid),
{varied("mp", 5)} SELECT tid AS customer, c.pos AS pos, c.start AS start, c."end" AS "end", c.overall AS overall, c.clip_type AS clip_type, rank FROM varied"""


def fitted(words: str, low: float, high: float, span: str) -> str:
    """Spans that begin at each sentence, grown towards the smaller pause until long enough, shrunk from the weaker end until short enough, then trimmed."""
    return f"""{profiles(words)},
fl AS (SELECT tid, count(*) AS n, list(start ORDER BY idx) AS s, list("end" ORDER BY idx) AS e, list(pause_before ORDER BY idx) AS pb, list(pause_after ORDER BY idx) AS pa, list(filler OR transition ORDER BY idx) AS tail, list(filler ORDER BY idx) AS head FROM prof GROUP BY tid),
gr AS (SELECT tid, idx::BIGINT AS a, (idx + {span})::BIGINT AS z, least(n - 1, idx)::BIGINT AS i, least(n - 1, idx + {span})::BIGINT AS j, 1 AS phase FROM prof JOIN fl USING (tid) UNION ALL
  SELECT tid, a, z, CASE WHEN phase = 1 AND NOT stop AND NOT later THEN i - 1 WHEN phase = 2 AND NOT stop AND NOT tail_weak THEN i + 1 ELSE i END, CASE WHEN phase = 1 AND NOT stop AND later THEN j + 1 WHEN phase = 2 AND NOT stop AND tail_weak THEN j - 1 ELSE j END,
    CASE WHEN stop THEN phase + 1 ELSE phase END FROM (
    SELECT gr.*, CASE phase WHEN 1 THEN e[j + 1] - s[i + 1] >= {low} OR (i = 0 AND j = n - 1) ELSE e[j + 1] - s[i + 1] <= {high} OR i >= j END AS stop, i = 0 OR (j < n - 1 AND pa[j + 1] <= pb[i + 1]) AS later, pb[j + 1] >= pa[i + 1] AS tail_weak FROM gr JOIN fl USING (tid) WHERE phase < 3)),
fx AS (SELECT gr.tid AS tid, a, z, i, j, i AS fi, j AS fj, s, e, tail, head, e[j + 1] - s[i + 1] BETWEEN 0.6::DOUBLE * {low} AND 1.35::DOUBLE * {high} AS ok FROM gr JOIN fl USING (tid) WHERE phase = 3),
{trimmed("fx", low)}
SELECT tid AS transcript_id, a::INT AS start_idx, z::INT AS end_idx, CASE WHEN ok THEN fi END::INT AS fit_start, CASE WHEN ok THEN fj END::INT AS fit_end, CASE WHEN ok THEN i END::INT AS trim_start, CASE WHEN ok THEN j END::INT AS trim_end FROM trimmed"""


FIT_TRIM = fitted(TURN_WORDS, 8.0, 30.0, "idx % 4")


# ---- camera ---------------------------------------------------------------------------------

_PIECE = 'struct_pack(t0 := t0, t1 := t1, x0 := x0, x1 := x1)'
_MOVES = "list_transform(range(2, len(l) + 1), lambda i: abs(l[i].x1 - l[i].x0) + abs(l[i].x0 - l[i - 1].x1))"

#: Samples are smoothed from cut to cut, each shot is one still frame or pieces of 0.7 s, still neighbours join, and the least moves go beyond 80 pieces.
CAMERA_PATH = f"""WITH RECURSIVE i AS (SELECT user_id, event_id, event_type, value, epoch_us(ts) / 1e6 AS s, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
m AS (SELECT user_id, list_sort(list(value))[(count(*) // 2) + 1] AS med FROM i WHERE k > 1 AND value > 0 GROUP BY 1),
f AS (SELECT i.*, coalesce(k > 1 AND value > greatest(20.0, med * 3.0), false) AS fl FROM i LEFT JOIN m USING (user_id)),
c AS (SELECT user_id, (s - min(s) OVER u) / 86400.0 AS t, CASE WHEN event_type <> 'signup' THEN least(1.0, abs(value) / 100.0) END AS cx, fl AND NOT (avg(fl::INT) OVER u > 0.35) AS cut FROM f WINDOW u AS (PARTITION BY user_id)),
a AS (SELECT user_id, list(t ORDER BY t, cx NULLS LAST, cut) AS ts, list(cx ORDER BY t, cx NULLS LAST, cut) AS xs, list(cut ORDER BY t, cx NULLS LAST, cut) AS cuts, max(t) AS duration, count(*) AS n, count(cx) AS seen, list_sort(list(cx) FILTER (cx IS NOT NULL)) AS ordered FROM c GROUP BY user_id),
sm AS (SELECT user_id, 0::BIGINT AS k, coalesce(list_filter(xs, lambda x: x IS NOT NULL)[1], 0.5) AS x FROM a WHERE seen / n >= 0.35 UNION ALL
  SELECT user_id, k + 1, CASE WHEN xs[k + 1] IS NULL THEN x WHEN cuts[k + 1] THEN xs[k + 1] ELSE x + 0.35 * (xs[k + 1] - x) END FROM sm JOIN a USING (user_id) WHERE k < n),
pt AS (SELECT user_id, k, ts[k] AS t, x, sum((cuts[k] AND k > 1)::INT) OVER (PARTITION BY user_id ORDER BY k) AS shot FROM sm JOIN a USING (user_id) WHERE k > 0),
sh AS (SELECT user_id, shot, list(t ORDER BY k) AS ts, list(x ORDER BY k) AS xs, list_sort(list(x)) AS ordered, count(*) AS n, min(t) AS a, CASE WHEN max(t) > min(t) THEN max(t) ELSE min(t) + 0.2 END AS b FROM pt GROUP BY user_id, shot),
sp AS (SELECT *, greatest(2, round_even(0.7 * n / greatest(0.1, b - a), 0)::BIGINT) AS step, n < 3 OR ordered[n] - ordered[1] < 0.035 AS still FROM sh),
kn AS (SELECT *, unnest(range(1, n, step)) AS p FROM sp WHERE NOT still),
pc AS (SELECT user_id, a AS t0, b AS t1, ordered[n // 2 + 1] AS x0, ordered[n // 2 + 1] AS x1 FROM sp WHERE still UNION ALL SELECT user_id, ts[p], ts[least(n, p + step)], xs[p], xs[least(n, p + step)] FROM kn),
cl AS (SELECT user_id, row_number() OVER w AS k, CASE WHEN row_number() OVER w = 1 AND t0 > 0 THEN 0.0 ELSE t0 END AS t0, CASE WHEN lead(t0) OVER w IS NOT NULL THEN greatest(t1, lead(t0) OVER w) WHEN t1 >= duration THEN t1 ELSE duration + 0.5 END AS t1, x0, x1
  FROM pc JOIN a USING (user_id) WINDOW w AS (PARTITION BY user_id ORDER BY pc.t0, t1, x0, x1)),
ps AS (SELECT user_id, list({_PIECE} ORDER BY k) AS q FROM cl GROUP BY user_id),
mg AS (SELECT user_id, 1::BIGINT AS k, [q[1]] AS l FROM ps UNION ALL
  SELECT user_id, k + 1, CASE WHEN still AND abs(z.x0 - y.x1) < 0.006 THEN list_append(l[: -2], struct_pack(t0 := y.t0, t1 := z.t1, x0 := y.x0, x1 := y.x0))
    WHEN still AND z.t1 - z.t0 < 0.45 THEN list_append(l[: -2], struct_pack(t0 := y.t0, t1 := z.t1, x0 := y.x0, x1 := y.x1)) ELSE list_append(l, z) END
  FROM (SELECT user_id, k, l, l[-1] AS y, q[k + 1] AS z, abs(l[-1].x1 - l[-1].x0) < 0.006 AND abs(q[k + 1].x1 - q[k + 1].x0) < 0.006 AS still FROM mg JOIN ps USING (user_id) WHERE k < len(q))),
fw AS (SELECT user_id, l FROM mg JOIN ps USING (user_id) WHERE k = len(q) UNION ALL
  SELECT user_id, list_concat(list_append(l[: j - 1], struct_pack(t0 := l[j].t0, t1 := l[j + 1].t1, x0 := l[j].x0, x1 := l[j + 1].x1)), l[j + 2 :]) FROM (SELECT user_id, l, list_position({_MOVES}, list_min({_MOVES})) AS j FROM fw WHERE len(l) > 80)),
dn AS (SELECT user_id, unnest(l) AS y, unnest(range(len(l))) AS seg FROM fw WHERE len(l) <= 80)
SELECT user_id::VARCHAR AS transcript_id, seg::INT AS seg, y.t0 AS t0, y.t1 AS t1, y.x0 AS x0, y.x1 AS x1 FROM dn UNION ALL
SELECT user_id::VARCHAR, 0, 0.0, greatest(0.1, duration) + 0.5, coalesce(ordered[seen // 2 + 1], 0.5), coalesce(ordered[seen // 2 + 1], 0.5) FROM a WHERE seen / n < 0.35"""
