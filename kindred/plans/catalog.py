"""Queries over the driver's tables, each operator by itself and the whole, and the same queries for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.functions import similarity as S
from kindred.functions import text as T
from kindred.operators import blocking as B
from kindred.operators import evaluate as E
from kindred.operators import model, quality, sampling, tfidf
from kindred.operators.features import FEATURES, build_features
from kindred.operators.records import normalized_records
from kindred.plans import oracle as O
from kindred.sources.fixtures import source_records, truth_pairs
from kindred.storage import materialize

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
THRESHOLD = 0.6
SEED = 42


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalized_records(source_records(spark, sf_dir))


def stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records as a table, for plans that read them several times: accents are folded once."""
    return materialize(records(spark, sf_dir), "records")


def _joined(c):
    return F.array_join(c, "|")


# ------------------------------------------------------------------------------------------------ text

_TEXT = {
    "normalize_name": ("name_norm", lambda: F.col("name_norm"), "name_norm"),
    "normalize_address": ("addr_norm", lambda: F.col("addr_norm"), "addr_norm"),
    "name_tokens": ("tokens", lambda: _joined(F.col("name_toks")), "array_to_string(name_toks, '|')"),
    "address_tokens": ("tokens", lambda: _joined(F.col("addr_toks")), "array_to_string(addr_toks, '|')"),
    "postal_code": ("postal", lambda: F.col("postal"), "postal"),
    "strip_landmark": ("addr_strip", lambda: F.col("addr_strip"), "addr_strip"),
    "char_ngrams": ("grams", lambda: _joined(F.sort_array(T.char_ngrams(F.col("name_norm")))), f"array_to_string(list_sort({O._ngrams('name_norm')}), '|')"),
    "blocking_text": ("blocking_text", lambda: F.col("blocking_text"), "blocking_text"),
    "name_prefix3": ("prefix", lambda: F.col("name_prefix3"), "name_prefix3"),
    "first_token_prefix": ("prefix", lambda: F.col("first_prefix"), "first_prefix"),
    "normalize_country": ("country_norm", lambda: F.col("country_norm"), "country_norm"),
    "source_label": ("label", lambda: T.source_of_id(F.col("entity_id")), "substr(entity_id, 1, 2)"),
    "clean_text": ("cleaned", lambda: T.clean(F.col("business_address"), T.fold_exact), O._clean("business_address")),
    "source_prefixes": ("from_s2", lambda: T.is_from(F.col("entity_id"), "S2"), "starts_with(entity_id, 'S2-')"),
}
for _name, (_alias, _column, _sql) in _TEXT.items():
    QUERIES[_name] = lambda spark, d, a=_alias, c=_column: records(spark, d).select("entity_id", c().alias(a))
    ORACLES[_name] = O.with_records(f"SELECT entity_id, {_sql} AS {_alias} FROM rec")


@query("fold_accents")
def fold_accents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exact fold (Arrow batches) beside the native one."""
    df = source_records(spark, sf_dir)
    return df.select("entity_id", T.fold_exact(F.col("business_name")).alias("exact"), T.fold_native(F.col("business_name")).alias("native"))


ORACLES["fold_accents"] = O.with_records("SELECT entity_id, strip_accents(business_name) AS exact, strip_accents(business_name) AS native FROM raw")


@query("source_scan", O.with_records("SELECT entity_id, business_name, business_address, country, source FROM raw"))
def source_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_records(spark, sf_dir).select("entity_id", "business_name", "business_address", "country", "source")


@query("truth_lists", O.with_records("SELECT source1_entity_id, array_to_string(list_sort(list(DISTINCT matched_entity_id)), ',') AS matched_entity_ids FROM truth GROUP BY 1", O.TRUTH))
def truth_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    truth = truth_pairs(source_records(spark, sf_dir))
    return truth.groupBy("source1_entity_id").agg(F.array_join(F.sort_array(F.collect_set("matched_entity_id")), ",").alias("matched_entity_ids"))


# ------------------------------------------------------------------------------------------------ similarity

_NEAR = "a.source = 'S1' AND b.source = 'S2' AND a.postal = b.postal"


def _postal_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of S1 and S2 with the same postal code: pairs for the similarities."""
    r = records(spark, sf_dir).select("source", "entity_id", "postal", "name_norm", "name_toks", "addr_toks", "addr_strip")
    a, b = (r.filter(F.col("source") == s).select("postal", *[F.col(c).alias(f"{p}_{c}") for c in r.columns if c not in ("source", "postal")]) for s, p in (("S1", "a"), ("S2", "b")))
    return a.join(b, "postal")


_SIMILAR = {
    "levenshtein_ratio": (lambda: S.levenshtein_ratio(F.col("a_addr_strip"), F.col("b_addr_strip")), O._ratio("a.addr_strip", "b.addr_strip")),
    "jaccard_tokens": (lambda: S.jaccard(F.col("a_addr_toks"), F.col("b_addr_toks")), O._jaccard("a.addr_toks", "b.addr_toks")),
    "token_sort_ratio": (lambda: S.token_sort_ratio(F.col("a_name_toks"), F.col("b_name_toks")), O._sorted_ratio("a.name_toks", "b.name_toks")),
    "prefix_match": (lambda: S.prefix_match(F.col("a_name_norm"), F.col("b_name_norm")), O._prefix("a.name_norm", "b.name_norm", 3)),
    "levenshtein": (lambda: F.levenshtein("a_name_norm", "b_name_norm").cast("double"), "levenshtein(translate(a.name_norm, 'ß', chr(1)), translate(b.name_norm, 'ß', chr(1)))::DOUBLE"),
}
for _name, (_column, _sql) in _SIMILAR.items():
    QUERIES[_name] = lambda spark, d, c=_column: _postal_pairs(spark, d).select("a_entity_id", "b_entity_id", F.round(c(), 6).alias("similarity"))
    ORACLES[_name] = O.with_records(f"SELECT a.entity_id AS a_entity_id, b.entity_id AS b_entity_id, round({_sql}, 6) AS similarity FROM rec a, rec b WHERE {_NEAR}")


# ------------------------------------------------------------------------------------------------ blocking

_POST = O.postings(B.BlockingConfig(df_cap=None))


@query("token_postings", O.with_records("SELECT source, entity_id, signal, key, weight::INTEGER AS weight FROM post", *_POST))
def token_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = records(spark, sf_dir)
    post = B.postings(r)
    return post.join(r.select("rid", "entity_id"), "rid").select("source", "entity_id", "signal", "key", "weight")


@query("token_df", O.with_records("SELECT source, signal, key, count(*) AS df FROM post GROUP BY ALL", *_POST))
def token_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.document_frequency(B.postings(records(spark, sf_dir)))


_CAPPED = B.BlockingConfig(df_cap=0.02)


@query("token_df_cap", O.with_records("SELECT source, signal, key, count(*) AS df FROM post WHERE source <> 'S1' GROUP BY ALL", *O.postings(_CAPPED)))
def token_df_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With a low cap, so that it bites on these tables."""
    others = records(spark, sf_dir).filter("source <> 'S1'")
    return B.document_frequency(B.cap_frequency(B.postings(others, _CAPPED), others, _CAPPED))


def _block_query(signal: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        r = stored(spark, sf_dir)
        found = B.block_scores(B.postings(r, signals=(signal,)), r)
        return found.select("source1_entity_id", "candidate_entity_id", F.col("block_score").alias("score"))

    return run


for _name, _signal in (("block_postal", "postal"), ("block_name_token", "name"), ("block_addr_token", "addr"), ("block_prefix", "prefix")):
    QUERIES[_name] = _block_query(_signal)
    ORACLES[_name] = O.with_records("SELECT source1_entity_id, candidate_entity_id, block_score AS score FROM post_scores", *O.postings(B.BlockingConfig(df_cap=None), (_signal,)), O.scores())


@query("block_score", O.with_records("SELECT source1_entity_id, candidate_entity_id, candidate_source, block_score FROM post_scores", *O.postings(), O.scores()))
def block_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = stored(spark, sf_dir)
    others = r.filter("source <> 'S1'")
    post = B.postings(r.filter("source = 'S1'")).unionByName(B.cap_frequency(B.postings(others), others))
    return B.block_scores(post, r)


_CANDIDATE = "SELECT source1_entity_id, candidate_entity_id, candidate_source, block_score FROM cand"


@query("block_topk_v1", O.with_records(_CANDIDATE, *O.token_steps()))
def block_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.candidates(stored(spark, sf_dir))


@query("block_topk_narrow", O.with_records(_CANDIDATE, *O.token_steps(B.NARROW)))
def block_topk_narrow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.candidates(stored(spark, sf_dir), B.NARROW)


@query(
    "candidates_wide",
    O.with_records(
        """SELECT i.source1_entity_id, coalesce(string_agg(candidate_entity_id, ',' ORDER BY block_score DESC, candidate_entity_id), '') AS candidate_entity_ids
        FROM (SELECT entity_id AS source1_entity_id FROM rec WHERE source = 'S1') i LEFT JOIN cand USING (source1_entity_id) GROUP BY 1""",
        *O.token_steps(),
    ),
)
def candidates_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = stored(spark, sf_dir)
    return B.candidates_wide(B.candidates(r), r.filter("source = 'S1'"))


@query("tfidf_weights", O.with_records("SELECT entity_id, term, round(weight, 6) AS weight FROM tv", *O.tfidf_steps(1)))
def tfidf_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = records(spark, sf_dir)
    return tfidf.record_weights(r).join(r.select("rid", "entity_id"), "rid").select("entity_id", "term", F.round("weight", 6).alias("weight"))


def _cosine(k: int, ngrams: int) -> Query:
    return lambda spark, d: tfidf.cosine_top(stored(spark, d), k, ngrams)


for _name, _k, _n in (("tfidf_cosine_topk", 20, 1), ("tfidf_cosine_topk_bigrams", 50, 2)):
    QUERIES[_name] = _cosine(_k, _n)
    ORACLES[_name] = O.with_records("SELECT source1_entity_id, candidate_entity_id, candidate_source, cosine FROM ttop", *O.tfidf_steps(_n), *O.cosine_steps(_k))


def _hybrid(config: B.BlockingConfig) -> Query:
    return lambda spark, d: B.candidates(stored(spark, d), config)


for _name, _config in (("hybrid_candidates", B.HYBRID), ("hybrid_candidates_wide", B.WIDE)):
    QUERIES[_name] = _hybrid(_config)
    ORACLES[_name] = O.with_records(_CANDIDATE, *O.hybrid_steps(_config))

# ------------------------------------------------------------------------------------------------ features


def _features(names: list[str]) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        r = stored(spark, sf_dir)
        made = build_features(B.candidates(r), r)
        return made.select("source1_entity_id", "candidate_entity_id", *[F.round(n, 6).alias(n) for n in names])

    return run


for _name, _some in (
    ("features_name", [f for f in FEATURES if f.startswith("name")]),
    ("features_addr", [f for f in FEATURES if f.startswith("addr")]),
    ("features_postal_country", ["block_score", "postal_match", "postal_both_present", "same_country"]),
    ("features_all", FEATURES),
):
    QUERIES[_name] = _features(_some)
    ORACLES[_name] = O.with_records(f"SELECT source1_entity_id, candidate_entity_id, {', '.join(_some)} FROM feat", *O.token_steps(), *O.feature_step(_some))

# ------------------------------------------------------------------------------------------------ labels, samples


@query(
    "label_pairs",
    O.with_records(
        """SELECT c.source1_entity_id, c.candidate_entity_id, CASE WHEN t.matched_entity_id IS NULL THEN 0 ELSE 1 END AS label FROM cand c
        LEFT JOIN (SELECT DISTINCT * FROM truth) t ON t.source1_entity_id = c.source1_entity_id AND t.matched_entity_id = c.candidate_entity_id""",
        *O.token_steps(), O.TRUTH,
    ),
)
def label_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = stored(spark, sf_dir)
    return sampling.label_pairs(B.candidates(r), truth_pairs(r)).select("source1_entity_id", "candidate_entity_id", "label")


def _s1(r: DataFrame) -> DataFrame:
    return r.filter("source = 'S1'").select(F.col("entity_id").alias("source1_entity_id"))


@query("group_split", O.with_records(f"SELECT entity_id AS source1_entity_id, ('0x' || substr({O.draw('entity_id', SEED)}, 1, 6))::BIGINT < {int(0.2 * 16**6)} AS is_validation FROM raw WHERE source = 'S1'"))
def group_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.group_split(_s1(source_records(spark, sf_dir)), seed=SEED)


@query("sample_s1", O.with_records(f"SELECT entity_id FROM raw WHERE source = 'S1' ORDER BY {O.draw('entity_id', SEED)}, entity_id LIMIT 50"))
def sample_s1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.sample_ids(source_records(spark, sf_dir).filter("source = 'S1'").select("entity_id"), 50, SEED)


_DRAWN = f"ORDER BY {O.draw('entity_id', SEED)}, entity_id LIMIT"


@query(
    "sample_preserving",
    O.with_records(
        "SELECT * FROM chosen UNION ALL SELECT * FROM s2 UNION ALL SELECT * FROM s3",
        O.TRUTH,
        f"with_m AS (SELECT entity_id FROM raw WHERE source = 'S1' AND entity_id IN (SELECT source1_entity_id FROM truth) {_DRAWN} 20)",
        f"without_m AS (SELECT entity_id FROM raw WHERE source = 'S1' AND entity_id NOT IN (SELECT source1_entity_id FROM truth) {_DRAWN} 40)",
        f"chosen AS (SELECT entity_id FROM (SELECT entity_id, 0 AS f FROM with_m UNION ALL SELECT entity_id, 1 FROM without_m) ORDER BY f, {O.draw('entity_id', SEED)}, entity_id LIMIT 40)",
        "wanted AS (SELECT DISTINCT matched_entity_id AS entity_id FROM truth WHERE source1_entity_id IN (SELECT entity_id FROM chosen))",
        *[
            f"""{s.lower()} AS (SELECT entity_id FROM raw WHERE source = '{s}' QUALIFY entity_id IN (SELECT entity_id FROM wanted) OR
            row_number() OVER (ORDER BY entity_id NOT IN (SELECT entity_id FROM wanted) DESC, {O.draw('entity_id', SEED)}, entity_id)
            <= 60 - count(*) FILTER (entity_id IN (SELECT entity_id FROM wanted)) OVER ())"""
            for s in ("S2", "S3")
        ],
    ),
)
def sample_preserving(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = source_records(spark, sf_dir)
    parts = sampling.sample_preserving(r, truth_pairs(r), 40, 60, SEED)
    return parts["S1"].union(parts["S2"]).union(parts["S3"])


@query(
    "id_set_ops",
    O.with_records(
        """SELECT 'both' AS kind, entity_id FROM (SELECT entity_id FROM m INTERSECT SELECT entity_id FROM p) UNION ALL
        SELECT 'only_matched', entity_id FROM (SELECT entity_id FROM m EXCEPT SELECT entity_id FROM p) UNION ALL SELECT 'either', entity_id FROM (SELECT entity_id FROM m UNION SELECT entity_id FROM p)""",
        O.TRUTH, "m AS (SELECT DISTINCT matched_entity_id AS entity_id FROM truth)", "p AS (SELECT entity_id FROM rec WHERE postal IS NOT NULL AND source <> 'S1')",
    ),
)
def id_set_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = records(spark, sf_dir)
    m = truth_pairs(r).select(F.col("matched_entity_id").alias("entity_id")).distinct()
    p = r.filter("postal IS NOT NULL AND source <> 'S1'").select("entity_id")
    made = (("both", m.intersect(p)), ("only_matched", m.join(p, "entity_id", "left_anti")), ("either", m.union(p).distinct()))
    parts = [df.select(F.lit(kind).alias("kind"), "entity_id") for kind, df in made]
    return parts[0].union(parts[1]).union(parts[2])


# ------------------------------------------------------------------------------------------------ evaluation


def scored_pairs(r: DataFrame) -> DataFrame:
    """Candidates with a stand-in for a model's score: the mean of three similarities."""
    f = build_features(B.candidates(r), r)
    mean = (F.round("name_lev_ratio", 6) + F.round("name_token_jaccard", 6) + F.round("addr_lev_ratio", 6)) / F.lit(3.0)
    return f.select("source1_entity_id", "candidate_entity_id", F.round(mean, 4).alias("prob"))


_KEPT = f"SELECT source1_entity_id, candidate_entity_id AS id FROM scored WHERE prob >= {THRESHOLD}::DOUBLE"


@query("threshold_matches", O.with_records(f"SELECT source1_entity_id, candidate_entity_id, prob FROM scored WHERE prob >= {THRESHOLD}::DOUBLE", *O.scored_steps()))
def threshold_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored_pairs(stored(spark, sf_dir)).filter(F.col("prob") >= THRESHOLD)


@query("entity_f_half", O.with_records(f"SELECT source1_entity_id, hits, n_predicted, n_true, round({O.f_half('hits', 'n_predicted', 'n_true')}, 6) AS f_half FROM per", *O.scored_steps(), *O.macro_steps(_KEPT)))
def entity_f_half(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = stored(spark, sf_dir)
    counts = E.entity_counts(scored_pairs(r).filter(F.col("prob") >= THRESHOLD), truth_pairs(r), _s1(r))
    return counts.withColumn("f_half", F.round(E.entity_f_half(F.col("hits"), F.col("n_predicted"), F.col("n_true")), 6))


@query("macro_f_half", O.with_records(f"SELECT round(coalesce(avg({O.f_half('hits', 'n_predicted', 'n_true')}), 0), 6) AS macro_f_half FROM per", *O.scored_steps(), *O.macro_steps(_KEPT)))
def macro_f_half(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = stored(spark, sf_dir)
    kept = scored_pairs(r).filter(F.col("prob") >= THRESHOLD)
    return E.macro_f_half(kept, truth_pairs(r), _s1(r)).select(F.round("macro_f_half", 6).alias("macro_f_half"))


@query(
    "recall_ceiling",
    O.with_records(
        """SELECT round(count(c.block_score) / count(*)::DOUBLE, 6) AS recall_ceiling, count(c.block_score) AS hits, count(*) AS true_pairs FROM (SELECT DISTINCT * FROM truth) t
        LEFT JOIN cand c ON c.source1_entity_id = t.source1_entity_id AND c.candidate_entity_id = t.matched_entity_id""",
        *O.token_steps(), O.TRUTH,
    ),
)
def recall_ceiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = stored(spark, sf_dir)
    return E.recall_ceiling(B.candidates(r), truth_pairs(r)).withColumn("recall_ceiling", F.round("recall_ceiling", 6))


@query(
    "threshold_sweep",
    O.with_records(
        f"SELECT round(threshold, 6) AS threshold, round(avg({O.f_half('tp', 'np', 'nt')}), 6) AS macro_f_half FROM cell GROUP BY ALL",
        *O.scored_steps(),
        f"grid AS (SELECT {E.FIRST}::DOUBLE + i * ((0.05::DOUBLE + 0.01::DOUBLE) - 0.05::DOUBLE) AS threshold FROM range({E.THRESHOLDS}) r(i))",
        "nt AS (SELECT source1_entity_id, count(DISTINCT matched_entity_id) AS nt FROM truth GROUP BY 1)",
        """kept AS (SELECT s.source1_entity_id, threshold, count(*) AS np, count(t.matched_entity_id) AS tp FROM scored s JOIN grid g ON s.prob >= g.threshold
        LEFT JOIN (SELECT DISTINCT * FROM truth) t ON t.source1_entity_id = s.source1_entity_id AND t.matched_entity_id = s.candidate_entity_id GROUP BY ALL)""",
        """cell AS (SELECT ids.source1_entity_id, grid.threshold, coalesce(np, 0) AS np, coalesce(tp, 0) AS tp, coalesce(nt, 0) AS nt FROM ids CROSS JOIN grid
        LEFT JOIN kept ON kept.source1_entity_id = ids.source1_entity_id AND kept.threshold = grid.threshold LEFT JOIN nt ON nt.source1_entity_id = ids.source1_entity_id)""",
    ),
)
def threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = stored(spark, sf_dir)
    # as a table: Catalyst would push the count of thresholds, and with it the similarities, below a join
    curve = E.sweep(materialize(scored_pairs(r), "scored"), truth_pairs(r), _s1(r))
    return curve.select(F.round("threshold", 6).alias("threshold"), F.round("macro_f_half", 6).alias("macro_f_half"))


@query("empty_baseline", O.with_records("SELECT round(avg(CASE WHEN entity_id IN (SELECT source1_entity_id FROM truth) THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END), 6) AS macro_f_half FROM raw WHERE source = 'S1'", O.TRUTH.replace("rec ", "raw ")))
def empty_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = source_records(spark, sf_dir)
    return E.empty_baseline(truth_pairs(r), _s1(r)).select(F.round("macro_f_half", 6).alias("macro_f_half"))


@query(
    "run_stats",
    O.with_records(
        f"""SELECT (SELECT count(*) FROM ids) AS n_s1, (SELECT count(*) FROM scored) AS n_candidates, (SELECT count(DISTINCT source1_entity_id) FROM scored) AS n_covered,
        (SELECT count(*) FROM m) AS n_matches, (SELECT count(DISTINCT source1_entity_id) FROM m) AS n_matched_entities,
        (SELECT count(*) FROM ids) - (SELECT count(DISTINCT source1_entity_id) FROM m) AS n_singletons""",
        *O.scored_steps(), f"m AS ({_KEPT})",
    ),
)
def run_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = stored(spark, sf_dir)
    scored = materialize(scored_pairs(r), "scored")
    return E.run_stats(scored, scored.filter(F.col("prob") >= THRESHOLD), _s1(r))


@query("gbt_scores")
def gbt_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A small forest of boosted trees, fitted and applied to all candidates. No SQL twin: a model is trained."""
    r = stored(spark, sf_dir)
    pairs = materialize(sampling.label_pairs(build_features(B.candidates(r), r), truth_pairs(r)), "pairs")
    fitted = model.fit(pairs, model.ModelConfig(depth=4, rounds=5))
    return model.score(fitted, pairs).select("source1_entity_id", "candidate_entity_id", "label", "prob")


# ------------------------------------------------------------------------------------------------ checks

# Id lists of a run with faults of every kind put in by the record's number.
_FAULTY = {
    "self": ("rid % 11 = 0", "concat(ids, ',S1-1')"),
    "wrong": ("rid % 13 = 0", "concat(ids, ',X9-1')"),
    "unknown": ("rid % 17 = 0", "concat(ids, ',S2-999999999')"),
    "trailing": ("rid % 19 = 0", "concat(ids, ',')"),
    "twice": ("rid % 23 = 0", "concat(ids, ',', ids)"),
}
_CHANGED = "CASE " + " ".join(f"WHEN {when} THEN {then}" for when, then in _FAULTY.values()) + " ELSE ids END"
_LISTS = f"SELECT rid AS pos, CASE WHEN rid % 29 = 0 THEN 'S1-extra' || rid ELSE source1_entity_id END AS source1_entity_id, {_CHANGED} AS ids FROM wide"


def _faulty_rows(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Faulty rows, the candidates' rows and the records."""
    r = stored(spark, sf_dir)
    ids = r.filter("source = 'S1'").select("rid", F.col("entity_id").alias("source1_entity_id"))
    wide = B.candidates_wide(B.candidates(r), r.filter("source = 'S1'")).withColumnRenamed("candidate_entity_ids", "ids").join(ids, "source1_entity_id")
    wide = materialize(wide, "wide")
    split = lambda c: F.when(F.col(c) == "", F.array().cast("array<string>")).otherwise(F.split(c, ","))
    changed = wide.select(
        F.col("rid").alias("at"), F.when(F.col("rid") % 29 == 0, F.concat(F.lit("S1-extra"), F.col("rid"))).otherwise(F.col("source1_entity_id")).alias("source1_entity_id"), F.expr(_CHANGED).alias("ids")
    )
    changed = materialize(changed.union(changed.filter("at % 31 = 0")), "rows")  # as a file would be: every rule reads it
    as_rows = lambda df: df.select("at", "source1_entity_id", split("ids").alias("ids"), F.lit(True).alias("ok"))
    return as_rows(changed), as_rows(wide.withColumnRenamed("rid", "at")), r


_FAULT_STEPS = [
    *O.token_steps(),
    """wide AS (SELECT i.rid, i.entity_id AS source1_entity_id, coalesce(string_agg(candidate_entity_id, ',' ORDER BY block_score DESC, candidate_entity_id), '') AS ids
    FROM rec i LEFT JOIN cand c ON c.source1_entity_id = i.entity_id WHERE i.source = 'S1' GROUP BY ALL)""",
    f"changed AS ({_LISTS})",
    "listed AS (SELECT pos, source1_entity_id, CASE WHEN ids = '' THEN []::VARCHAR[] ELSE string_split(ids, ',') END AS ids FROM (SELECT * FROM changed UNION ALL SELECT * FROM changed WHERE pos % 31 = 0))",
    "each AS (SELECT source1_entity_id, unnest(ids) AS id FROM listed)",
]
_RULES = {
    "duplicate_row": "SELECT source1_entity_id, count(*)::VARCHAR AS detail FROM listed GROUP BY 1 HAVING count(*) > 1",
    "duplicate_id": "SELECT source1_entity_id, array_to_string(ids, ',') AS detail FROM listed WHERE len(ids) <> len(list_distinct(ids))",
    "self_match": "SELECT source1_entity_id, id AS detail FROM each WHERE starts_with(id, 'S1-')",
    "wrong_prefix": "SELECT source1_entity_id, id AS detail FROM each WHERE NOT regexp_matches(id, '^S[123]-')",
    "unknown_id": "SELECT source1_entity_id, id AS detail FROM each WHERE regexp_matches(id, '^S[23]-') AND id NOT IN (SELECT entity_id FROM rec WHERE source <> 'S1')",
    "missing_row": "SELECT entity_id AS source1_entity_id, entity_id AS detail FROM rec WHERE source = 'S1' AND entity_id NOT IN (SELECT source1_entity_id FROM listed)",
    "extra_row": "SELECT DISTINCT source1_entity_id, source1_entity_id AS detail FROM listed WHERE source1_entity_id NOT IN (SELECT entity_id FROM rec WHERE source = 'S1')",
}


def _rule(rule: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows, _, r = _faulty_rows(spark, sf_dir)
        issues = quality.id_list_issues(rows, r.filter("source = 'S1'"), r.filter("source <> 'S1'"))
        return issues.filter(F.col("rule") == rule).select("source1_entity_id", "detail")

    return run


for _name, _sql in _RULES.items():
    QUERIES[f"validate_{_name}"] = _rule(_name)
    ORACLES[f"validate_{_name}"] = O.with_records(f"SELECT * FROM ({_sql})", *_FAULT_STEPS)


@query(
    "validate_subset",
    O.with_records(
        """SELECT source1_entity_id, id AS detail FROM (SELECT DISTINCT source1_entity_id, id FROM each) e WHERE NOT EXISTS
        (SELECT 1 FROM cand c WHERE c.source1_entity_id = e.source1_entity_id AND c.candidate_entity_id = e.id)""",
        *_FAULT_STEPS,
    ),
)
def validate_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, wide, _ = _faulty_rows(spark, sf_dir)
    return quality.subset_issues(rows, wide).select("source1_entity_id", "detail")


@query("validate_stats", O.with_records("SELECT count(*) AS n_rows, count(*) FILTER (len(ids) = 0) AS n_empty, count(*) FILTER (len(ids) > 0) AS n_non_empty FROM listed", *_FAULT_STEPS))
def validate_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.row_stats(_faulty_rows(spark, sf_dir)[0])


@query(
    "validate_summary",
    O.with_records(
        "SELECT 'error' AS level, rule, sum(n)::BIGINT AS n, array_to_string(list(shown ORDER BY shown)[1:5], '|') AS examples FROM s GROUP BY rule",
        *_FAULT_STEPS,
        "s AS (SELECT rule, source1_entity_id AS shown, count(*) AS n FROM (" + " UNION ALL ".join(f"SELECT '{k}' AS rule, * FROM ({v})" for k, v in _RULES.items()) + ") GROUP BY ALL)",
    ),
)
def validate_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _, r = _faulty_rows(spark, sf_dir)
    issues = quality.id_list_issues(rows, r.filter("source = 'S1'"), r.filter("source <> 'S1'"))
    return quality.summary(issues).withColumn("examples", F.array_join("examples", "|"))
