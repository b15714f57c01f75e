"""DuckDB SQL of the corpus queries that SQL expresses."""

from __future__ import annotations

from . import collocations, mixing, prefix_trie
from .quality_rules import CLASS_LIMIT, CLASSES, COMMON_WORDS, MIN_CHARS, MIN_WORDS, SPACE, WORD_LIMIT
from .substrings import LENGTH, REPORT
from .warc import BASE32


def _cuts(k: int) -> str:
    """Shares of ``p`` and ``q`` to the Jensen-Shannon divergence at position ``k``."""
    side = "CASE WHEN {0}[{2}] > 0 THEN {0}[{2}] * log2({0}[{2}] / (({0}[{2}] + {1}[{2}]) / 2)) ELSE 0.0 END / 2"
    return side.format("p", "q", k) + " + " + side.format("q", "p", k)


def _distance(p: str, q: str) -> str:
    return f"(SELECT sqrt(greatest(list_sum(list_transform(range(1, len(p) + 1), lambda k: {_cuts('k')})), 0.0)) FROM (SELECT {p} AS p, {q} AS q) WHERE p IS NOT NULL AND q IS NOT NULL)"


def _rest(shares: str) -> str:
    return f"list_append({shares}, 1.0 - coalesce(list_sum({shares}), 0.0))"


def quality_rules_sql() -> str:
    quoted = [p.replace("'", "''") for p in CLASSES.values()]
    classes = ", ".join(f"length(text) - length(regexp_replace(text, '{p}', '', 'g'))" for p in quoted)
    sums = ", ".join(f"sum(classes[{k}])::DOUBLE" for k in range(1, len(quoted) + 2))
    return f"""WITH t AS (SELECT doc_id, lang, coalesce(text, '') AS text, list_filter(regexp_split_to_array(coalesce(text, ''), '[{SPACE}]+'), lambda x: x <> '') AS words FROM documents),
told AS (SELECT *, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^{SPACE}]')) AS lines, [{classes}] AS five FROM t),
base AS (SELECT doc_id, lang, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars, length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
  list_append(five, length(text) - list_sum(five)::BIGINT) AS classes, list_transform(words, lambda w: lower(w)) AS common FROM told),
windows AS (SELECT doc_id, i, words[i : i + 4] AS five FROM (SELECT doc_id, words, unnest(range(1, len(words) - 3)) AS i FROM t)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, five) AS n FROM windows) WHERE n > 1),
repeats AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, range(5) r(k) GROUP BY 1),
spoken AS (SELECT lang, n_words, classes, common FROM base WHERE lang IS NOT NULL AND n_words > 0 UNION ALL SELECT NULL, n_words, classes, common FROM base WHERE n_words > 0),
langs AS (SELECT lang, sum(n_words) AS total, [{sums}] AS sums FROM spoken GROUP BY 1),
counted AS (SELECT lang, word, count(*) AS n FROM (SELECT lang, unnest(common) AS word FROM spoken) GROUP BY 1, 2),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, word) AS place FROM counted QUALIFY place <= {COMMON_WORDS}),
refs AS (SELECT l.lang, list_transform(sums, lambda c: c / list_sum(sums)) AS ref_classes, list(word ORDER BY place) FILTER (word IS NOT NULL) AS ref_words, list(r.n / total ORDER BY place) FILTER (word IS NOT NULL) AS ref_shares FROM langs l LEFT JOIN ranked r ON r.lang IS NOT DISTINCT FROM l.lang GROUP BY ALL),
judged AS (SELECT b.*, coalesce(repeats.n, 0) AS n_repeat_words, list_sum(classes) AS chars, ref_classes, ref_shares,
  CASE WHEN list_sum(classes) >= {MIN_CHARS} THEN list_transform(classes, lambda c: c / list_sum(classes)::DOUBLE) END AS own_classes,
  CASE WHEN n_words >= {MIN_WORDS} THEN list_transform(ref_words, lambda r: len(list_filter(common, lambda w: w = r)) / n_words) END AS own_shares
  FROM base b LEFT JOIN repeats USING (doc_id) LEFT JOIN refs ON refs.lang IS NOT DISTINCT FROM b.lang),
apart AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, {_distance("own_classes", "ref_classes")} AS class_distance,
  CASE WHEN own_shares IS NOT NULL THEN {_distance(_rest("own_shares"), _rest("ref_shares"))} END AS word_distance FROM judged)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT coalesce(class_distance > {CLASS_LIMIT}, false) AND NOT coalesce(word_distance > {WORD_LIMIT}, false) AS kept, round(class_distance, 6) AS class_distance, round(word_distance, 6) AS word_distance FROM apart"""


def warc_sql() -> str:
    group = "('0x' || substr(h, k * 5 + 1, 5))::INTEGER"
    letters = " || ".join(f"substr('{BASE32}', (({group} >> {s}) & 31) + 1, 1)" for s in (15, 10, 5, 0))
    return f"""WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY html) AS first FROM p)
SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes, array_to_string(list_transform(range(8), lambda k: {letters}), '') AS payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to, true AS payload_ok FROM f"""


def _runs(name: str, size: int) -> str:
    """Common table expressions up to ``name(doc_id, s, e)``: runs covered by repeats of ``size`` bytes."""
    return f"""w_{name} AS (SELECT doc_id, i, md5(array_slice(b, i, i + {size - 1})) AS h FROM (SELECT doc_id, b, unnest(range(1, n - {size - 2})) AS i FROM d)),
rep_{name} AS (SELECT doc_id, i FROM w_{name} WHERE h IN (SELECT h FROM w_{name} GROUP BY h HAVING count(*) > 1)),
opened_{name} AS (SELECT *, coalesce(i > lag(i) OVER o + {size}, true) AS opens FROM rep_{name} WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
numbered_{name} AS (SELECT doc_id, i, sum(opens::INTEGER) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM opened_{name}),
{name} AS (SELECT doc_id, min(i) AS s, max(i) + {size - 1} AS e FROM numbered_{name} GROUP BY doc_id, run)"""


def repeats_sql() -> str:
    return f"""WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
{_runs("runs", LENGTH)},
{_runs("near", REPORT)},
ends AS (SELECT doc_id, s, e FROM runs UNION ALL SELECT doc_id, n + 1, n FROM d),
gaps AS (SELECT doc_id, s, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY s), 0) + 1 AS a, s - 1 AS z FROM ends),
kept AS (SELECT doc_id, string_agg(CASE WHEN z >= a THEN hex(array_slice(b, a, z)) ELSE '' END, '' ORDER BY s) AS hexes FROM gaps JOIN d USING (doc_id) GROUP BY 1),
sums AS (SELECT doc_id, sum(e - s + 1)::BIGINT AS n_removed, count(*) AS n_spans FROM runs GROUP BY 1),
reported AS (SELECT doc_id, sum(e - s + 1)::BIGINT AS n_repeated FROM near GROUP BY 1)
SELECT doc_id, n::BIGINT AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(hexes)) AS kept_sha256, coalesce(n_repeated, 0) AS n_repeated FROM d JOIN kept USING (doc_id) LEFT JOIN sums USING (doc_id) LEFT JOIN reported USING (doc_id)"""


def oracle_sql() -> dict[str, str]:
    return {"op3_quality_rules": quality_rules_sql(), "op6_warc": warc_sql(), "op8_repeats": repeats_sql(), "op11_collocations": collocations.sql(), "op12_mixing": mixing.sql(), "op13_prefix_trie": prefix_trie.sql()}
