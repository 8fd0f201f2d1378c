"""The queries of the catalogue for DuckDB, put together from named steps.

Two engines' functions differ in places: distances there count bytes, so the one character beyond ASCII that the
fold leaves in these tables (ß) is replaced by a control character before them.
"""

from __future__ import annotations

from kindred.functions import constants as C
from kindred.operators.blocking import HYBRID, STANDARD, WIDE, BlockingConfig
from kindred.operators.features import FEATURES
from kindred.sources.fixtures import SUFFIXES


def _in(words: list[str]) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


def _clean(x: str) -> str:
    folded = f"translate(lower(strip_accents(coalesce({x}, ''))), '-/.', '   ')"
    return rf"trim(regexp_replace(regexp_replace({folded}, '[^\p{{L}}\p{{N}}_\s&]', ' ', 'g'), '\s+', ' ', 'g'))"


def _words(x: str, keep: str = "true") -> str:
    return f"list_filter(string_split({x}, ' '), lambda x: x <> '' AND {keep})"


def _short() -> str:
    return "CASE x " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in C.ADDRESS_WORDS.items()) + " ELSE x END"


def _ngrams(x: str, n: int = 3) -> str:
    bare = f"replace({x}, ' ', '')"
    return f"CASE WHEN {bare} = '' THEN []::VARCHAR[] ELSE list_distinct(list_transform(range(1, greatest(length({bare}) - {n - 1}, 1)::BIGINT + 1), lambda i: substr({bare}, i, {n}))) END"


RECORDS = rf"""
docs AS (SELECT doc_id, n_chars, lang, md5(text) AS truth_key,
    list_filter(string_split(regexp_replace(text, '[ \t\r\n]+', ' ', 'g'), ' '), lambda x: x <> '') AS w FROM documents),
raw AS (SELECT doc_id AS rid, 'S' || (doc_id % 3 + 1) AS source, 'S' || (doc_id % 3 + 1) || '-' || doc_id AS entity_id,
    array_to_string(w[1:5], ' ') || [{', '.join(f"'{s}'" for s in SUFFIXES)}][doc_id % 4 + 1] AS business_name,
    array_to_string(w[6:13], ' ') || ' Road' || CASE WHEN doc_id % 5 = 0 THEN ', Opp. City Mall' ELSE '' END
    || CASE WHEN n_chars % 7 <> 0 THEN ', ' || (10000 + (n_chars * 7) % 90000) ELSE '' END AS business_address, lang AS country, truth_key FROM docs),
cleaned AS (SELECT *, {_clean('business_name')} AS name_clean, {_clean('business_address')} AS addr_clean FROM raw),
normed AS (SELECT *, array_to_string({_words('name_clean', f"x NOT IN {_in([*C.NAME_REMOVED, C.NAME_AND, '&'])}")}, ' ') AS name_norm,
    array_to_string(list_transform({_words('addr_clean')}, lambda x: {_short()}), ' ') AS addr_norm FROM cleaned),
rec AS (SELECT rid, source, entity_id, business_name, business_address, country, truth_key, name_norm, addr_norm,
    {_words('name_norm', f'x NOT IN {_in(C.NAME_STOPWORDS)}')} AS name_toks, {_words('addr_norm', f'x NOT IN {_in(C.ADDRESS_STOPWORDS)}')} AS addr_toks,
    substr(replace(name_norm, ' ', ''), 1, 3) AS name_prefix3,
    CASE WHEN length(string_split(name_norm, ' ')[1]) >= 3 THEN substr(string_split(name_norm, ' ')[1], 1, 3) END AS first_prefix,
    trim(regexp_replace(addr_norm, '\bnear\b.*$', '')) AS addr_strip, nullif(regexp_extract(business_address, '\b\d{{5,6}}\b', 0), '') AS postal,
    concat_ws(' ', nullif(name_norm, ''), nullif(addr_norm, '')) AS blocking_text, lower(trim(coalesce(country, ''))) AS country_norm FROM normed)"""

TRUTH = """truth AS (SELECT a.entity_id AS source1_entity_id, b.entity_id AS matched_entity_id FROM rec a JOIN rec b ON a.truth_key = b.truth_key
    WHERE a.source = 'S1' AND b.source <> 'S1')"""


def _ratio(a: str, b: str) -> str:
    one = lambda x: f"translate({x}, 'ß', chr(1))"
    return f"CASE WHEN {a} = '' AND {b} = '' THEN 1.0::DOUBLE ELSE 1.0::DOUBLE - levenshtein({one(a)}, {one(b)}) / greatest(length({a}), length({b}), 1)::DOUBLE END"


def _jaccard(a: str, b: str) -> str:
    both = f"len(list_intersect(list_distinct({a}), list_distinct({b})))"
    return f"CASE WHEN len({a}) = 0 AND len({b}) = 0 THEN 1.0::DOUBLE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0::DOUBLE ELSE {both}::DOUBLE / len(list_distinct(list_concat({a}, {b}))) END"


def _sorted_ratio(a: str, b: str) -> str:
    return _ratio(f"array_to_string(list_sort({a}), ' ')", f"array_to_string(list_sort({b}), ' ')")


def _prefix(a: str, b: str, k: int) -> str:
    return f"CASE WHEN {a} <> '' AND {b} <> '' AND substr({a}, 1, {k}) = substr({b}, 1, {k}) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END"


def with_records(select: str, *steps: str) -> str:
    return f"WITH {', '.join([RECORDS, *steps])} {select}"


def _posting(signal: str, c: BlockingConfig) -> str:
    keys = {"name": "unnest(list_distinct(name_toks))", "addr": "unnest(list_distinct(addr_toks))", "postal": "postal", "prefix": c.prefix_column}
    weights = {"name": c.name_weight, "addr": c.address_weight, "postal": c.postal_weight, "prefix": c.prefix_weight}
    return f"SELECT source, rid, entity_id, '{signal}' AS signal, {keys[signal]} AS key, {weights[signal]} AS weight FROM rec"


def postings(c: BlockingConfig = STANDARD, signals: tuple[str, ...] = ("name", "addr", "postal", "prefix"), name: str = "post") -> list[str]:
    steps = [f"{name}_all AS (SELECT * FROM ({' UNION ALL '.join(_posting(s, c) for s in signals)}) WHERE key IS NOT NULL AND key <> '')"]
    if c.df_cap is None:
        return [*steps, f"{name} AS (SELECT * FROM {name}_all)"]
    return [
        *steps,
        f"{name}_size AS (SELECT source, greatest(floor(count(*) * {c.df_cap}::DOUBLE), {c.df_floor}) AS most FROM rec GROUP BY source)",
        f"""{name}_hot AS (SELECT source, signal, key FROM (SELECT source, signal, key, count(*) AS n FROM {name}_all
            WHERE signal IN ('name', 'addr') AND source <> 'S1' GROUP BY source, signal, key) JOIN {name}_size USING (source) WHERE n > most)""",
        f"{name} AS (SELECT * FROM {name}_all p WHERE NOT EXISTS (SELECT 1 FROM {name}_hot h WHERE h.source = p.source AND h.signal = p.signal AND h.key = p.key))",
    ]


def scores(name: str = "post") -> str:
    return f"""{name}_scores AS (SELECT a.entity_id AS source1_entity_id, b.entity_id AS candidate_entity_id, b.source AS candidate_source, sum(b.weight)::INTEGER AS block_score
        FROM {name} a JOIN {name} b ON a.signal = b.signal AND a.key = b.key WHERE a.source = 'S1' AND b.source <> 'S1' GROUP BY ALL)"""


def top(c: BlockingConfig = STANDARD, name: str = "post", out: str = "cand") -> str:
    return f"""{out} AS (SELECT source1_entity_id, candidate_entity_id, candidate_source, (block_score * {c.score_scale})::INTEGER AS block_score FROM {name}_scores
        QUALIFY row_number() OVER (PARTITION BY source1_entity_id, candidate_source ORDER BY block_score DESC, candidate_entity_id) <= {c.per_source})"""


def token_steps(c: BlockingConfig = STANDARD, out: str = "cand") -> list[str]:
    return [*postings(c), scores(), top(c, out=out)]


def tfidf_steps(ngrams: int) -> list[str]:
    terms = "w" if ngrams == 1 else "list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))"
    return [
        r"tw AS (SELECT source, rid, entity_id, regexp_extract_all(blocking_text, '[\p{L}\p{N}_]{2,}') AS w FROM rec)",
        f"tf AS (SELECT source, rid, entity_id, term, count(*) AS tf FROM (SELECT source, rid, entity_id, unnest({terms}) AS term FROM tw) GROUP BY ALL)",
        "tn AS (SELECT count(*) AS n FROM rec WHERE source <> 'S1')",
        """idf AS (SELECT term, ln((1.0::DOUBLE + (SELECT n FROM tn)) / (1.0::DOUBLE + count(*))) + 1.0::DOUBLE AS idf FROM tf WHERE source <> 'S1' GROUP BY term
            HAVING count(*) >= 2 AND count(*) <= 0.9::DOUBLE * (SELECT n FROM tn))""",
        "tr AS (SELECT source, rid, entity_id, term, (ln(tf::DOUBLE) + 1.0::DOUBLE) * idf AS raw FROM tf JOIN idf USING (term))",
        "tv AS (SELECT source, rid, entity_id, term, raw / sqrt(sum(raw * raw) OVER (PARTITION BY rid)) AS weight FROM tr)",
    ]


def cosine_steps(k: int) -> list[str]:
    return [
        """tc AS (SELECT a.entity_id AS source1_entity_id, b.entity_id AS candidate_entity_id, b.source AS candidate_source, round(sum(a.weight * b.weight), 9) AS cosine
            FROM tv a JOIN tv b USING (term) WHERE a.source = 'S1' AND b.source <> 'S1' GROUP BY ALL)""",
        f"ttop AS (SELECT * FROM tc WHERE cosine > 0 QUALIFY row_number() OVER (PARTITION BY source1_entity_id ORDER BY cosine DESC, candidate_entity_id) <= {k})",
    ]


def hybrid_steps(c: BlockingConfig) -> list[str]:
    union = f"""SELECT source1_entity_id, candidate_entity_id, candidate_source, block_score FROM tok UNION ALL
        SELECT source1_entity_id, candidate_entity_id, candidate_source, (floor(cosine * 100.0::DOUBLE) + 20)::INTEGER FROM ttop"""
    return [*token_steps(c, "tok"), *tfidf_steps(c.tfidf_ngrams), *cosine_steps(c.tfidf_top), f"cand AS (SELECT source1_entity_id, candidate_entity_id, candidate_source, max(block_score) AS block_score FROM ({union}) GROUP BY ALL)"]


FEATURE_SQL = {
    "block_score": "c.block_score::DOUBLE",
    "name_exact_norm": "CASE WHEN a.name_norm = b.name_norm AND a.name_norm <> '' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END",
    "name_lev_ratio": _ratio("a.name_norm", "b.name_norm"),
    "name_token_jaccard": _jaccard("a.name_toks", "b.name_toks"),
    "name_token_sort_ratio": _sorted_ratio("a.name_toks", "b.name_toks"),
    "name_char3gram_jaccard": _jaccard("a.name_3g", "b.name_3g"),
    "name_first_token_match": _prefix("coalesce(a.name_toks[1], '')", "coalesce(b.name_toks[1], '')", 99),
    "addr_lev_ratio": _ratio("a.addr_strip", "b.addr_strip"),
    "addr_token_jaccard": _jaccard("a.addr_toks", "b.addr_toks"),
    "addr_char3gram_jaccard": _jaccard("a.addr_3g", "b.addr_3g"),
    "postal_match": "CASE WHEN a.postal = b.postal THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END",
    "postal_both_present": "CASE WHEN a.postal IS NOT NULL AND b.postal IS NOT NULL THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END",
    "same_country": "CASE WHEN a.country_norm <> '' AND a.country_norm = b.country_norm THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END",
    "name_len_diff": "abs(length(a.name_norm) - length(b.name_norm))::DOUBLE",
    "addr_len_diff": "abs(length(a.addr_strip) - length(b.addr_strip))::DOUBLE",
}
GRAMS = f"g AS (SELECT *, {_ngrams('name_norm')} AS name_3g, {_ngrams('addr_strip')} AS addr_3g FROM rec)"


def feature_step(names: list[str] = FEATURES, source: str = "cand") -> list[str]:
    made = ", ".join(f"round({FEATURE_SQL[n]}, 6) AS {n}" for n in names)
    return [GRAMS, f"feat AS (SELECT c.source1_entity_id, c.candidate_entity_id, c.candidate_source, {made} FROM {source} c JOIN g a ON a.entity_id = c.source1_entity_id JOIN g b ON b.entity_id = c.candidate_entity_id)"]


PROB = "round((name_lev_ratio + name_token_jaccard + addr_lev_ratio) / 3.0::DOUBLE, 4)"


def scored_steps() -> list[str]:
    return [*token_steps(), *feature_step(["name_lev_ratio", "name_token_jaccard", "addr_lev_ratio"]), f"scored AS (SELECT source1_entity_id, candidate_entity_id, {PROB} AS prob FROM feat)", TRUTH, "ids AS (SELECT entity_id AS source1_entity_id FROM rec WHERE source = 'S1')"]


def f_half(hits: str, predicted: str, true: str) -> str:
    p, r = f"({hits} / {predicted}::DOUBLE)", f"({hits} / {true}::DOUBLE)"
    return f"CASE WHEN {true} = 0 THEN CASE WHEN {predicted} = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END WHEN {predicted} = 0 OR {hits} = 0 THEN 0.0::DOUBLE ELSE 1.25::DOUBLE * {p} * {r} / (0.25::DOUBLE * {p} + {r}) END"


def macro_steps(predicted: str) -> list[str]:
    """predicted: SQL of source1_entity_id, id."""
    return [
        f"p AS (SELECT DISTINCT * FROM ({predicted}))", "t AS (SELECT DISTINCT source1_entity_id, matched_entity_id AS id FROM truth)",
        "pc AS (SELECT source1_entity_id, count(*) AS n FROM p GROUP BY 1)", "tc0 AS (SELECT source1_entity_id, count(*) AS n FROM t GROUP BY 1)",
        "hc AS (SELECT source1_entity_id, count(*) AS n FROM p JOIN t USING (source1_entity_id, id) GROUP BY 1)",
        "every AS (SELECT source1_entity_id FROM ids UNION SELECT source1_entity_id FROM pc UNION SELECT source1_entity_id FROM tc0)",
        """per AS (SELECT source1_entity_id, coalesce(hc.n, 0) AS hits, coalesce(pc.n, 0) AS n_predicted, coalesce(tc0.n, 0) AS n_true FROM every
            LEFT JOIN hc USING (source1_entity_id) LEFT JOIN pc USING (source1_entity_id) LEFT JOIN tc0 USING (source1_entity_id))""",
    ]


def draw(x: str, seed: int) -> str:
    return f"md5({x} || ':{seed}')"


__all__ = ["HYBRID", "STANDARD", "WIDE"]
