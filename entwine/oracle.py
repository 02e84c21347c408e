"""DuckDB SQL for the registered queries, from named common table expressions."""

from __future__ import annotations

import re

from .config import STOPWORDS, BlockingConfig
from .functions.geo import COUNTRY_NAMES, GEO_STOPWORDS
from .functions.text import SUFFIXES, fold_table

SPACE = r"[\x09-\x0D\x1C-\x20]"
#: Metaphone letter by letter, in patterns without look-around and back-references; written apart from the engine's rules.
METAPHONE = (
    ("re", r"[^a-z ]", ""),
    ("re", r"(^| )[kgp]n", r"\1n"),
    ("re", r"(^| )wr", r"\1r"),
    ("re", r"(^| )ae", r"\1e"),
    ("re", r"(^| )x", r"\1s"),
    ("re", r"(^| )wh", r"\1w"),
    *(("re", f"{c}{c}+", c) for c in "abdefghijklmnopqrstuvwxyz"),
    ("re", r"mb( |$)", r"m\1"),
    ("re", r"sch", "sk"),
    ("re", r"tch", "ch"),
    ("re", r"ci(a)|ch", r"X\1"),
    ("re", r"ck", "K"),
    ("re", r"sc([iey])", r"S\1"),
    ("re", r"c([iey])", r"S\1"),
    ("re", r"dg([iey])", r"J\1"),
    ("re", r"gh([^aeiou])", r"\1"),
    ("re", r"gn( |$)", r"n\1"),
    ("re", r"gned( |$)", r"ned\1"),
    ("re", r"g([iey])", r"J\1"),
    ("re", r"ph", "F"),
    ("re", r"sh", "X"),
    ("re", r"th", "0"),
    ("re", r"([aeiou])h([^aeiou]|$)", r"\1\2"),
    ("re", r"[st]i([oa])", r"X\1"),
    ("re", r"x", "KS"),
    ("re", r"w([aeiou])", r"W\1"),
    ("re", r"y([aeiou])", r"Y\1"),
    ("re", r"[wy]", ""),
    ("tr", "bcdfghjklmnpqrstvz", "BKTFKHJKLMNPKRSTFS"),
    *(("re", f"(^| ){v}", rf"\1{v.upper()}") for v in "aeiou"),
    ("re", r"[aeiou]", ""),
    ("re", r"  +", " "),
)


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def listed(values) -> str:
    return "[" + ", ".join(quoted(v) for v in values) + "]"


def fold(x: str) -> str:
    source, target, longer = fold_table()
    out = f"translate({x}, {quoted(source)}, {quoted(target)})"
    for k, v in longer:
        out = f"replace({out}, {quoted(k)}, {quoted(v)})"
    return rf"regexp_replace({out}, '[^\x00-\x7F]+', '', 'g')"


def collapse(x: str) -> str:
    return f"trim(regexp_replace({x}, '{SPACE}+', ' ', 'g'))"


def depunctuate(x: str) -> str:
    return rf"regexp_replace(lower({x}), '[^a-z0-9_\x09-\x0D\x1C-\x20]', ' ', 'g')"


def suffixes(x: str) -> str:
    for pattern, short in SUFFIXES:
        x = f"regexp_replace({x}, {quoted(pattern)}, '{short}', 'g')"
    return x


def clean_address(x: str) -> str:
    return f"coalesce({collapse(depunctuate(fold(x)))}, '')"


def clean_name(x: str) -> str:
    return f"coalesce({collapse(suffixes(depunctuate(fold(x))))}, '')"


def metaphone(x: str) -> str:
    for kind, a, b in METAPHONE:
        x = f"translate({x}, '{a}', '{b}')" if kind == "tr" else f"regexp_replace({x}, {quoted(a)}, {quoted(b)}, 'g')"
    return f"trim({x})"


def tokens(x: str, stop=STOPWORDS) -> str:
    words = f"regexp_extract_all(lower(coalesce({x}, '')), '[a-z0-9_]{{2,}}')"
    return f"list_filter({words}, lambda w: NOT list_contains({listed(stop)}, w))" if stop else words


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{SPACE}+|{SPACE}+$', '', 'g')"


ADDRESS = f"coalesce({strip('lower(business_address)')}, '')"
COUNTRY = f"coalesce({strip('lower(country)')}, '')"
CHUNK = collapse(depunctuate(f"regexp_replace({fold('p')}, '\\b[0-9]{{5,6}}\\b', '', 'g')"))
CHUNKS = (
    f"list_transform(list_filter(list_transform(string_split({ADDRESS}, ','), lambda p: {CHUNK}), "
    f"lambda c: length(c) > 1 AND NOT list_contains({listed((*GEO_STOPWORDS, *COUNTRY_NAMES))}, c) AND c <> {COUNTRY}), lambda c: replace(c, ' ', '_'))"
)
PIN_SUFFIX = "regexp_matches({0}, '[0-9]{{5,6}}$')"
JOBS = "(q_source, t_source) IN ((0, 1), (0, 2), (1, 2))"


def block_keys(upper: int, lower: int, scope: str) -> dict[str, str]:
    """CTEs of the three passes; scope is '' or 'source, '."""
    name = "s" if scope else "j"
    massive = f"count(*) OVER (PARTITION BY {scope}k) > {upper} AND NOT {PIN_SUFFIX.format('k')}"
    return {
        f"pass1{name}": f"SELECT *, CASE WHEN {massive} AND chunk_2 IS NOT NULL THEN c || '_' || chunk_2 || '_' || chunk_1 ELSE k END AS k1 FROM (SELECT *, base_key AS k FROM norm)",
        f"pass2{name}": f"SELECT *, CASE WHEN {massive} THEN k || '_' || coalesce(nullif(substr(clean_name, 1, 1), ''), 'z') ELSE k END AS k2 FROM (SELECT * REPLACE (k1 AS k) FROM pass1{name})",
        f"keyed{name}": f"SELECT * EXCLUDE (k, k1, k2), CASE WHEN count(*) OVER (PARTITION BY {scope}k2) < {lower} THEN string_split(k2, '_')[1] || '_unknown' ELSE k2 END AS geo_block_key FROM pass2{name}",
    }


def bm25(tag: str, column: str, k: int, keep: str = "true") -> dict[str, str]:
    return {
        f"words_{tag}": f"SELECT lower(country) AS part, source, entity_id AS entity, {tokens(column)} AS words FROM keyedj WHERE country IS NOT NULL",
        f"tf_{tag}": f"SELECT part, source, entity, dl, token, count(*) AS tf FROM (SELECT part, source, entity, len(words) AS dl, unnest(words) AS token FROM words_{tag}) GROUP BY ALL",
        f"stats_{tag}": f"SELECT part, source, count(*) AS n, avg(len(words)) AS avgdl FROM words_{tag} GROUP BY ALL",
        f"df_{tag}": f"SELECT part, source, token, count(*) AS df FROM tf_{tag} GROUP BY ALL",
        f"post_{tag}": f"""SELECT part, source, token, entity, df, n,
            round(1000000 * ln(1 + (n - df + 0.5e0) / (df + 0.5e0)) * (tf / (tf + 1.5e0 * (0.25e0 + 0.75e0 * dl / avgdl))))::BIGINT AS w
            FROM tf_{tag} JOIN df_{tag} USING (part, source, token) JOIN stats_{tag} USING (part, source) WHERE source IN (1, 2)""",
        f"sum_{tag}": f"""SELECT entity_A, entity_B, t_source, sum(tf * w)::BIGINT AS s FROM
            (SELECT part, token, source AS q_source, entity AS entity_A, tf FROM tf_{tag})
            JOIN (SELECT part, token, source AS t_source, entity AS entity_B, w FROM post_{tag} WHERE {keep}) USING (part, token) WHERE {JOBS} GROUP BY ALL""",
        f"top_{tag}": f"""SELECT entity_A, entity_B, s / 1000000 AS score FROM (SELECT *, row_number() OVER (PARTITION BY entity_A, t_source ORDER BY s DESC, entity_B) AS r
            FROM sum_{tag} WHERE s > 0) WHERE r <= {k}""",
    }


def word_tfidf(tag: str, column: str, k: int, max_df: str, min_df: int) -> dict[str, str]:
    return {
        f"src_{tag}": f"SELECT lower(country) AS part, source, entity_id AS entity, coalesce({column}, '') AS doc FROM keyedj WHERE country IS NOT NULL",
        f"n_{tag}": f"SELECT part, count(DISTINCT doc) AS n FROM src_{tag} GROUP BY part",
        f"idf_{tag}": f"""SELECT part, token, ln((1 + n) / (1 + df)) + 1 AS idf FROM (SELECT part, token, count(*) AS df FROM
            (SELECT part, unnest(list_distinct({tokens('doc', ())})) AS token FROM (SELECT DISTINCT part, doc FROM src_{tag})) GROUP BY ALL)
            JOIN n_{tag} USING (part) WHERE df <= {max_df}e0 * n AND df >= {min_df}""",
        f"w_{tag}": f"""SELECT part, source, entity, token, round(1000000 * tf * idf)::BIGINT AS w FROM (SELECT part, source, entity, token, count(*) AS tf FROM
            (SELECT part, source, entity, unnest({tokens('doc', ())}) AS token FROM src_{tag}) GROUP BY ALL) JOIN idf_{tag} USING (part, token)""",
        f"unit_{tag}": f"""SELECT part, source, entity, token, round(1000000 * w / norm)::BIGINT AS w FROM w_{tag}
            JOIN (SELECT part, source, entity, sqrt(sum(w::HUGEINT * w)::DOUBLE) AS norm FROM w_{tag} GROUP BY ALL) USING (part, source, entity)""",
        f"top_{tag}": f"""SELECT entity_A, entity_B, s / 1000000000000 AS score FROM (SELECT *, row_number() OVER (PARTITION BY entity_A, t_source ORDER BY s DESC, entity_B) AS r FROM
            (SELECT entity_A, entity_B, t_source, sum(qw * tw)::BIGINT AS s FROM (SELECT part, token, source AS q_source, entity AS entity_A, w AS qw FROM unit_{tag})
            JOIN (SELECT part, token, source AS t_source, entity AS entity_B, w AS tw FROM unit_{tag}) USING (part, token) WHERE {JOBS} GROUP BY ALL) WHERE s > 0) WHERE r <= {k}""",
    }


def full(a: str, b: str, left: str, right: str) -> str:
    return f"SELECT entity_A, entity_B, coalesce(x.score, 0) AS {left}, coalesce(y.score, 0) AS {right} FROM {a} x FULL JOIN {b} y USING (entity_A, entity_B)"


def drawn(key: str) -> str:
    return f"md5({key} || '/42')"


def build(config: BlockingConfig, thresholds: list[int], truth_rows: int, noise_rows: int, ratio: float) -> dict[str, str]:
    """All CTEs by name, in an order in which each needs earlier ones only."""
    upper, lower, k = config.upper_threshold, config.lower_threshold, config.top_k
    return {
        "recs": """SELECT 'S' || (src + 1) || '-' || lpad(doc_id::VARCHAR, 9, '0') AS entity_id, src AS source, text AS business_name, lang AS country,
            concat_ws(', ', CASE WHEN doc_id % 8 <> 0 THEN 'area ' || doc_id % 5 END, CASE WHEN doc_id % 16 <> 0 THEN 'city ' || doc_id % 3 END,
            CASE WHEN doc_id % 4 <> 0 THEN (10000 + doc_id % 11)::VARCHAR END) AS business_address
            FROM (SELECT *, regexp_extract(source, '([0-9]+)', 1)::INT % 3 AS src FROM documents)""",
        "truth": """SELECT o.entity_id AS source1_entity_id, m.ids AS matched_entity_ids FROM recs o LEFT JOIN
            (SELECT coalesce(business_name, '') AS name, string_agg(entity_id, ',' ORDER BY entity_id) AS ids FROM recs WHERE source > 0 GROUP BY 1) m
            ON coalesce(o.business_name, '') = m.name WHERE o.source = 0""",
        "cleaned": f"""SELECT entity_id, source, country, business_address, {clean_name('business_name')} AS clean_name, {clean_address('business_address')} AS clean_address,
            {COUNTRY} AS c, {CHUNKS} AS parts, nullif(regexp_extract({ADDRESS}, '\\b(\\d{{5,6}})\\b([^\\w]*|\\s*[a-z]{{2,}}\\s*)$', 1), '') AS pin FROM recs""",
        "norm": f"""SELECT entity_id, source, country, clean_name, clean_address, clean_name || ' ' || clean_address AS search_document, {metaphone('clean_name')} AS phonetic_hash,
            c, pin, parts[-1] AS chunk_1, parts[-2] AS chunk_2, c || '_' || coalesce(pin, parts[-1], 'unknown') AS base_key FROM cleaned""",
        "swept": f"""SELECT t.t AS threshold, base_key, total > t.t AS big,
            CASE WHEN total > t.t AND NOT {PIN_SUFFIX.format('base_key')} AND chunk_2 IS NOT NULL THEN c || '_' || chunk_2 || '_' || chunk_1 ELSE base_key END AS k
            FROM (SELECT *, count(*) OVER (PARTITION BY base_key) AS total FROM norm), (VALUES {', '.join(f'({t})' for t in thresholds)}) AS t(t)""",
        **block_keys(upper, lower, ""),
        **block_keys(upper, lower, "source, "),
        **bm25("text", "search_document", k),
        **bm25("phon", "phonetic_hash", k),
        **bm25("pruned", "search_document", k, f"df <= {ratio}e0 * n"),
        "globalpool": full("top_text", "top_phon", "bm25_text_score", "bm25_phonetic_score"),
        **word_tfidf("wtext", "search_document", k, "0.8", 2),
        **word_tfidf("wphon", "phonetic_hash", k, "1", 1),
        "tfidfpool": full("top_wtext", "top_wphon", "bm25_text_score", "bm25_phonetic_score"),
        "held": f"SELECT geo_block_key AS block, source, entity_id AS entity, string_split_regex(lower(search_document), '{SPACE}+') AS words FROM keyedj WHERE NOT ends_with(geo_block_key, '_unknown')",
        "padded": "SELECT block, source, entity, ' ' || w || ' ' AS p FROM (SELECT block, source, entity, unnest(words) AS w FROM held) WHERE w <> ''",
        "grams": """SELECT block, source, entity, substr(p, i, n) AS gram FROM (SELECT block, source, entity, p, n, unnest(range(1, length(p) - n + 2)) AS i
            FROM padded, (VALUES (2), (3), (4)) AS t(n) WHERE n <= length(p))""",
        "gtf": "SELECT block, source, entity, gram, count(*) AS tf FROM grams GROUP BY ALL",
        "gidf": """SELECT block, t_source, gram, ln((1 + n) / (1 + df)) + 1 AS idf FROM (SELECT block, source AS t_source, gram, count(*) AS df FROM gtf WHERE source IN (1, 2) GROUP BY ALL)
            JOIN (SELECT block, source AS t_source, count(*) AS n FROM held WHERE source IN (1, 2) GROUP BY ALL) USING (block, t_source)""",
        "gw": """SELECT block, t_source, source, entity, gram, round(1000000 * tf * idf)::BIGINT AS w FROM gtf JOIN gidf USING (block, gram)
            WHERE source = t_source OR (source, t_source) IN ((0, 1), (0, 2), (1, 2))""",
        "gunit": """SELECT block, t_source, source, entity, gram, round(1000000 * w / norm)::BIGINT AS w FROM gw
            JOIN (SELECT block, t_source, source, entity, sqrt(sum(w::HUGEINT * w)::DOUBLE) AS norm FROM gw GROUP BY ALL) USING (block, t_source, source, entity)""",
        "top_geo": f"""SELECT entity_A, entity_B, s / 1000000000000 AS score FROM (SELECT *, row_number() OVER (PARTITION BY entity_A, t_source ORDER BY s DESC, entity_B) AS r FROM
            (SELECT entity_A, entity_B, t_source, sum(qw * tw)::BIGINT AS s FROM (SELECT block, t_source, gram, entity AS entity_A, w AS qw FROM gunit WHERE source <> t_source)
            JOIN (SELECT block, t_source, gram, entity AS entity_B, w AS tw FROM gunit WHERE source = t_source) USING (block, t_source, gram) GROUP BY ALL) WHERE s > 0) WHERE r <= {k}""",
        "pool": """SELECT entity_A, entity_B, coalesce(bm25_text_score, 0) AS bm25_text_score, coalesce(bm25_phonetic_score, 0) AS bm25_phonetic_score, coalesce(score, 0) AS geo_ngram_score
            FROM globalpool FULL JOIN top_geo USING (entity_A, entity_B)""",
        "truepairs": f"""SELECT DISTINCT least(a, b) AS u, greatest(a, b) AS v FROM (SELECT {strip('source1_entity_id')} AS a, {strip('b')} AS b FROM
            (SELECT source1_entity_id, unnest(string_split(matched_entity_ids, ',')) AS b FROM truth WHERE matched_entity_ids IS NOT NULL)) WHERE b <> ''
            AND a IN (SELECT entity_id FROM recs) AND b IN (SELECT entity_id FROM recs)""",
        "canon": """SELECT least(entity_A, entity_B) AS u, greatest(entity_A, entity_B) AS v, max(bm25_text_score) AS bm25_text_score, max(bm25_phonetic_score) AS bm25_phonetic_score,
            max(geo_ngram_score) AS geo_ngram_score FROM pool GROUP BY 1, 2""",
        "missed": "SELECT u, v FROM truepairs EXCEPT SELECT u, v FROM canon",
        "hits": "SELECT * FROM truepairs LEFT JOIN canon USING (u, v)",
        "report": """SELECT (SELECT count(*) FROM canon) AS candidate_pairs, (SELECT count(*) FROM canon WHERE starts_with(u, 'S1-') OR starts_with(v, 'S1-')) AS candidate_pairs_s1_anchored,
            count(*) AS true_pairs, count(bm25_text_score) AS found, count(*) FILTER (bm25_text_score > 0) AS t, count(*) FILTER (bm25_phonetic_score > 0) AS p, count(*) FILTER (geo_ngram_score > 0) AS g FROM hits""",
        "sizes": "SELECT count(*) FILTER (source = 0) AS n0, count(*) FILTER (source = 1) AS n1, count(*) FILTER (source = 2) AS n2 FROM recs",
        "sampled": f"SELECT * FROM truth WHERE matched_entity_ids IS NOT NULL ORDER BY {drawn('source1_entity_id')}, source1_entity_id LIMIT {truth_rows}",
        "anchorids": f"""SELECT source1_entity_id AS entity_id FROM sampled UNION SELECT {strip('b')} FROM (SELECT unnest(string_split(matched_entity_ids, ',')) AS b FROM sampled) WHERE {strip('b')} <> ''""",
        "noise": f"SELECT entity_id, source FROM recs WHERE NOT EXISTS (SELECT 1 FROM anchorids a WHERE a.entity_id = recs.entity_id) ORDER BY {drawn('entity_id')}, entity_id LIMIT {noise_rows}",
    }


def submission(where: str) -> str:
    return f"""SELECT r.entity_id AS source1_entity_id, coalesce(m.ids, '') AS matched_entity_ids FROM recs r LEFT JOIN
        (SELECT entity_A, string_agg(DISTINCT entity_B, ',' ORDER BY entity_B) AS ids FROM pool WHERE {where} GROUP BY 1) m ON r.entity_id = m.entity_A WHERE r.source = 0"""


def statement(select: str, ctes: dict[str, str]) -> str:
    """select with the CTEs that it needs, directly or not."""
    need, todo = set(), [select]
    while todo:
        text = todo.pop()
        for name in ctes:
            if name not in need and re.search(rf"\b{name}\b", text):
                need.add(name)
                todo.append(ctes[name])
    head = ",\n".join(f"{name} AS ({sql})" for name, sql in ctes.items() if name in need)
    return f"WITH {head}\n{select}" if head else select
