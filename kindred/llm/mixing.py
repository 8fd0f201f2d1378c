"""Temperature mixing of sources.

A source's weight is its share of all tokens to the power of an exponent between 0 (all sources alike) and 1 (as they
are), normalised. The exponent is the largest that meets a target entropy of the weights: ``entropy_gain`` is how much
of the gap between the corpus's own entropy and the greatest one (all sources alike) the mixture closes. A limit on
repetition comes before it: no source may come more than ``repetition_limit`` times. Both are bisected, on a grid of
1 / PRECISION, by sums over sources for many exponents at once; sources are never collected.

The budget is ``budget_share`` times the corpus's tokens; without one it is as large as it must be for every source to
come at least once whole, so that nothing is dropped. A source's quota is its weight of the budget, in whole tokens.

The mixture is realised as block permutations. Each pass over a source (a copy) has its own order, by a hash. A
document's place in its source's stream is the number of tokens before it, and it belongs to the stream if that is less
than the quota; every block takes each source's weight from its stream, in an order by another hash. Places come from
prefix sums on three levels (rows of a bucket of the hash's range, buckets of a group, groups), so that no task sees
more than a bucket, however large the source.

Tokens are words (runs without white space). Defined cases: a null source is a source of its own, apart from the
empty one; rows without words come once, whatever the weights; rows of equal doc_id, text and source are one document
of the stream (null and empty texts are equal), and ``mixed`` gives each of them its copies; with one source, or
none, weights are as they are; an empty table gives no rows. Columns other than doc_id, text and source are ignored
by ``mixture`` and kept by ``mixed``, whatever their names.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kindred.storage import materialize, release

BUCKET_ROWS = 250
GROUP_BUCKETS = 1000
BLOCK_ROWS = 50_000
PRECISION = 1_000_000
_STEPS = (10_000, 100, 1)  # of the three rounds of the search


@dataclass(frozen=True)
class MixingConfig:
    entropy_gain: float = 0.5
    repetition_limit: float = 2.0
    budget_share: float | None = None
    block_tokens: int = 1_000_000
    seed: int = 1


#: What op3_mixing runs: half of the missing entropy, one and a half times the corpus, no source beyond four times.
PRODUCTION = MixingConfig(entropy_gain=0.5, repetition_limit=4.0, budget_share=1.5)


def _text(docs: DataFrame) -> Column:
    return F.coalesce(docs["text"].cast("string"), F.lit(""))


def _key(docs: DataFrame) -> Column:
    """The source; a null one is told from the empty one."""
    return F.coalesce(F.concat(F.lit("="), docs["source"].cast("string")), F.lit(""))


def document_tokens(docs: DataFrame) -> DataFrame:
    """doc_id, hash of the text, key of the source and number of words."""
    body = F.btrim(_text(docs), F.lit(" \t\n\x0b\x0c\r"))
    words = F.when(body == "", 0).otherwise(F.size(F.split(body, r"[\x20\x09-\x0D]+"))).cast("long")
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.md5(_text(docs).cast("binary")).alias("text_hash"), _key(docs).alias("key"), words.alias("n_tokens"))


def _tried(shares: DataFrame, ks: list[int]) -> list[tuple[int, float, float]]:
    """(k, entropy, normaliser) of the weights for each exponent k / PRECISION, in order: a row for each k."""
    power = F.pow("share", F.col("k") / float(PRECISION))
    rows = shares.withColumn("k", F.explode(F.array(*map(F.lit, ks)))).groupBy("k").agg(F.sum(power).alias("z"), F.sum(power * F.log("share")).alias("l")).collect()
    return [(r["k"], math.log(r["z"]) - r["k"] / PRECISION * r["l"] / r["z"], r["z"]) for r in sorted(rows, key=lambda r: r["k"])]


def find_exponent(totals: DataFrame, config: MixingConfig) -> int:
    """The exponent as a multiple of 1 / PRECISION. totals: one row for each source with its tokens.

    Entropy falls and so does repetition as the exponent grows: a round keeps the step between the last exponent on
    one side and the first on the other.
    """
    n, total, least, most = totals.agg(F.count("*"), F.sum("tokens"), F.min("tokens"), F.max("tokens")).first()
    if n < 2 or least == most:
        return PRECISION
    shares = totals.select((F.col("tokens") / float(total)).alias("share"))
    own = _tried(shares, [PRECISION])[0][1]
    target = own + config.entropy_gain * (math.log(n) - own)
    budget = None if config.budget_share is None else min(config.budget_share, config.repetition_limit)

    def repeated(k: int, z: float) -> float:
        """How often the smallest source comes."""
        if budget is None:
            return (most / least) ** (1 - k / PRECISION)
        return budget * (least / total) ** (k / PRECISION - 1) / z

    low, last = 0, 0  # the least exponent within the limit, the greatest that meets the target
    for step in _STEPS:
        firsts = [k for k in (low + i * step for i in range(101)) if k <= PRECISION]
        seconds = [k for k in (last + i * step for i in range(101)) if k <= PRECISION]
        found = {k: (h, z) for k, h, z in _tried(shares, sorted({*firsts, *seconds}))}
        within = [k for k in firsts if repeated(k, found[k][1]) <= config.repetition_limit * (1 + 1e-12)]
        first = min(within, default=PRECISION)
        low = first if step == 1 or first == low else first - step
        last = max((k for k in seconds if found[k][0] >= target), default=last)
    return max(low, last)


def quotas(totals: DataFrame, config: MixingConfig, n_rows: int) -> tuple[DataFrame, int]:
    """key, tokens and quota of each source, and the number of blocks."""
    exponent = find_exponent(totals, config) / PRECISION
    n, total, most = totals.agg(F.count("*"), F.sum("tokens"), F.max("tokens")).first()
    if not n:
        return totals.withColumn("quota", F.lit(0).cast("long")), max(1, -(-n_rows // BLOCK_ROWS))
    power = F.pow(F.col("tokens") / float(total), F.lit(exponent))
    z = totals.agg(F.sum(power)).first()[0]
    if config.budget_share is None:
        budget = most * z / (most / total) ** exponent
    else:
        budget = min(config.budget_share, config.repetition_limit) * total
    out = totals.withColumn("quota", F.floor(power * F.lit(budget / z) + 0.5).cast("long"))
    size = out.agg(F.sum("quota")).first()[0]
    return out, max(1, math.floor(size / config.block_tokens + 0.5), -(-n_rows // BLOCK_ROWS))


def _hash(seed: int) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("copy").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "text_hash").cast("binary"))


def _part_of(h: Column, parts: int) -> Column:
    """Which of so many equal ranges a hash lies in."""
    return F.floor(F.conv(F.substring(h, 1, 8), 16, 10).cast("double") * F.lit(float(parts)) / F.lit(4294967296.0)).cast("long")


def _before(rows: DataFrame, by: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """rows with the sum of value over those before, within by."""
    window = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn(name, F.coalesce(F.sum(value).over(window), F.lit(0)))


def mixture(docs: DataFrame, config: MixingConfig = MixingConfig()) -> DataFrame:
    """doc_id, text_hash, source, copy (from 1), n_tokens, block, place (from 1 within the block): one row for each
    document of the stream and copy."""
    rows = document_tokens(docs).groupBy("doc_id", "text_hash", "key").agg(F.min("n_tokens").alias("n_tokens"))
    rows = materialize(rows, "tokens")
    totals = materialize(rows.filter("n_tokens > 0").groupBy("key").agg(F.sum("n_tokens").alias("tokens")), "sources")
    n_rows = rows.count()
    wanted, blocks = quotas(totals, config, n_rows)

    some = rows.filter("n_tokens > 0").join(wanted, "key")
    some = some.withColumn("copy", F.explode(F.sequence(F.lit(1), F.expr("greatest(1, (quota + tokens - 1) div tokens)").cast("int"))))
    n_buckets = -(-n_rows // BUCKET_ROWS) or 1
    some = some.withColumn("h", _hash(config.seed))
    some = some.withColumn("bucket", _part_of(F.col("h"), n_buckets)).withColumn("group", F.expr(f"bucket div {GROUP_BUCKETS}"))
    by = ["key", "copy", "group", "bucket"]
    sums = materialize(some.groupBy(*by).agg(F.sum("n_tokens").alias("held")), "buckets")
    groups = _before(sums.groupBy(*by[:3]).agg(F.sum("held").alias("held")), by[:2], ["group"], "held", "before_group").drop("held")
    sums = _before(sums, by[:3], ["bucket"], "held", "before_bucket").drop("held").join(groups, by[:3])
    some = _before(some, by, ["h", "doc_id", "text_hash"], "n_tokens", "inside").join(sums, by)
    at = (F.col("copy") - 1) * F.col("tokens") + F.col("before_group") + F.col("before_bucket") + F.col("inside")
    some = some.withColumn("at", at).filter("at < quota")
    block = F.floor(F.col("at").cast("double") / (F.col("quota").cast("double") / F.lit(float(blocks)))).cast("long")
    some = some.withColumn("block", F.least(block, F.lit(blocks - 1).cast("long")))
    bare = rows.filter("n_tokens = 0").withColumn("copy", F.lit(1))
    bare = bare.withColumn("block", _part_of(_hash(config.seed), blocks))
    names = ["doc_id", "text_hash", "key", "copy", "n_tokens", "block"]
    out = some.select(*names).union(bare.select(*names)).withColumn("h", _hash(config.seed + 1))
    place = F.row_number().over(Window.partitionBy("block").orderBy("h", "doc_id", "text_hash", "copy", "key"))
    source = F.when(F.col("key") != "", F.expr("substring(key, 2)"))
    return out.select("doc_id", "text_hash", source.alias("source"), "copy", "n_tokens", "block", place.alias("place"))


def mixed(docs: DataFrame, config: MixingConfig = MixingConfig()) -> DataFrame:
    """docs with each row as often as the mixture has its document, block by block in the order of places."""
    prefix = "m_"
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix += "_"
    found = mixture(docs, config)
    key = F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))
    found = found.select(*[F.col(c).alias(prefix + c) for c in ("doc_id", "text_hash", "block", "place")], key.alias(f"{prefix}key"))
    found = materialize(found, "mixture")
    same = docs["doc_id"].cast("long").eqNullSafe(F.col(f"{prefix}doc_id")) & (F.md5(_text(docs).cast("binary")) == F.col(f"{prefix}text_hash")) & (_key(docs) == F.col(f"{prefix}key"))
    joined = docs.join(found, same).repartition(f"{prefix}block").sortWithinPartitions(f"{prefix}block", f"{prefix}place")
    return joined.select(*[docs[c] for c in docs.columns])


def oracle_sql(config: MixingConfig = PRODUCTION) -> str:
    """The rows of op3_mixing for DuckDB over the view documents; prefix sums by plain windows."""
    share = config.budget_share
    budget = f"{min(share, config.repetition_limit)} * total" if share is not None else "most * z / pow(most / total, k / 1e6)"
    repeated = f"{min(share, config.repetition_limit)} * pow(least / total, k / 1e6 - 1) / z" if share is not None else "pow(most / least, 1 - k / 1e6)"
    tried = lambda name, start, step: (
        f"{name} AS (SELECT k, ln(sum(pow(p, k / 1e6))) - k / 1e6 * sum(pow(p, k / 1e6) * ln(p)) / sum(pow(p, k / 1e6)) AS h, sum(pow(p, k / 1e6)) AS z "
        f"FROM s, (SELECT unnest(range(0, 101)) * {step} + {start} AS k) WHERE k <= {PRECISION} GROUP BY k)"
    )
    most_k = lambda name, before: f"{name} AS (SELECT coalesce(max(k), any_value(b)) AS b FROM (SELECT k, h, (SELECT b FROM {before}) AS b FROM {name}_t), g WHERE h >= target)"
    least_k = lambda name, before, step: (
        f"{name} AS (SELECT CASE WHEN {step} = 1 OR f = b THEN f ELSE f - {step} END AS b FROM (SELECT coalesce(min(k), {PRECISION}) AS f, (SELECT b FROM {before}) AS b "
        f"FROM {name}_t, m WHERE {repeated} <= {config.repetition_limit} * (1 + 1e-12)))"
    )
    rounds, last, low = ["zero AS (SELECT 0 AS b)"], "zero", "zero"
    for i, step in enumerate(_STEPS):
        rounds += [tried(f"e{i}_t", f"(SELECT b FROM {last})", step), most_k(f"e{i}", last), tried(f"r{i}_t", f"(SELECT b FROM {low})", step), least_k(f"r{i}", low, step)]
        last, low = f"e{i}", f"r{i}"
    h = lambda seed: f"md5(concat_ws(':', '{seed}', copy::VARCHAR, coalesce(doc_id::VARCHAR, ''), text_hash))"
    number = lambda x: f"('0x' || substr({x}, 1, 8))::BIGINT::DOUBLE"
    return f"""
WITH d AS (SELECT DISTINCT doc_id::BIGINT AS doc_id, md5(coalesce(text, '')) AS text_hash, coalesce('=' || source, '') AS key,
    len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS n_tokens FROM documents),
t AS (SELECT key, sum(n_tokens)::BIGINT AS tokens FROM d WHERE n_tokens > 0 GROUP BY key),
m AS (SELECT count(*) AS n, sum(tokens)::DOUBLE AS total, min(tokens)::DOUBLE AS least, max(tokens)::DOUBLE AS most FROM t),
s AS (SELECT key, tokens, tokens / total AS p FROM t, m),
g AS (SELECT own + {config.entropy_gain} * (ln(any_value(n)) - own) AS target FROM (SELECT ln(sum(p)) - sum(p * ln(p)) / sum(p) AS own FROM s), m GROUP BY own),
{', '.join(rounds)},
x AS (SELECT CASE WHEN n < 2 OR least = most THEN {PRECISION} ELSE greatest((SELECT b FROM {last}), (SELECT b FROM {low})) END AS k FROM m),
z AS (SELECT sum(pow(p, k / 1e6)) AS z, any_value(k) AS k FROM s, x),
q AS (SELECT key, tokens, floor(pow(p, k / 1e6) * ({budget} / z) + 0.5)::BIGINT AS quota FROM s, z, m),
b AS (SELECT greatest(1, floor(coalesce(sum(quota), 0) / {config.block_tokens} + 0.5), ceil((SELECT count(*) FROM d) / {BLOCK_ROWS}))::DOUBLE AS blocks FROM q),
c AS (SELECT d.*, tokens, quota, unnest(range(1, greatest(1, (quota + tokens - 1) // tokens) + 1)) AS copy FROM d JOIN q USING (key) WHERE n_tokens > 0),
o AS (SELECT *, (copy - 1) * tokens + sum(n_tokens) OVER (PARTITION BY key, copy ORDER BY {h(config.seed)}, doc_id NULLS FIRST, text_hash) - n_tokens AS place_at FROM c),
a AS (SELECT doc_id, text_hash, key, copy, n_tokens, least(floor(place_at::DOUBLE / (quota::DOUBLE / blocks)), blocks - 1)::BIGINT AS block FROM o, b WHERE place_at < quota
    UNION ALL SELECT doc_id, text_hash, key, 1 AS copy, n_tokens, floor({number(h(config.seed))} * blocks / 4294967296.0)::BIGINT FROM (SELECT *, 1 AS copy FROM d WHERE n_tokens = 0), b)
SELECT doc_id, CASE WHEN key <> '' THEN substr(key, 2) END AS source, copy::INTEGER AS copy, n_tokens, block,
    row_number() OVER (PARTITION BY block ORDER BY {h(config.seed + 1)}, doc_id NULLS FIRST, text_hash, copy, key)::INTEGER AS place FROM a"""
