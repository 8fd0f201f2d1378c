"""Operators on pairs, sources and sinks, checks, and both plans from records to files."""

import glob
import itertools

import pytest
from pyspark.sql import functions as F

from kindred import cli
from kindred.operators import blocking as B
from kindred.operators import evaluate as E
from kindred.operators import model, quality, sampling
from kindred.operators.features import FEATURES, build_features
from kindred.operators.records import normalized_records
from kindred.plans import matching
from kindred.sources import tsv
from kindred.sources.fixtures import source_records, truth_pairs

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def source(spark):
    return source_records(spark, SF).cache()


@pytest.fixture(scope="module")
def records(source):
    return normalized_records(source).cache()


def test_candidates_by_brute_force(records):
    config = B.BlockingConfig(per_source=3)
    rows = [r.asDict() for r in records.collect()]
    expected = set()
    for s1 in (r for r in rows if r["source"] == "S1"):
        for source in ("S2", "S3"):
            others = [r for r in rows if r["source"] == source]
            cap = max(int(0.95 * len(others)), 5)
            df = lambda c, t: sum(t in o[c] for o in others)
            scored = []
            for o in others:
                score = sum(w for c, w in (("name_toks", 3), ("addr_toks", 1)) for t in set(s1[c]) & set(o[c]) if df(c, t) <= cap)
                score += 5 * (s1["postal"] is not None and s1["postal"] == o["postal"]) + (s1["name_prefix3"] != "" and s1["name_prefix3"] == o["name_prefix3"])
                if score:
                    scored.append((-score, o["entity_id"]))
            expected |= {(s1["entity_id"], c, -k) for k, c in sorted(scored)[:3]}
    got = {(r["source1_entity_id"], r["candidate_entity_id"], r["block_score"]) for r in B.candidates(records, config).collect()}
    assert got == expected


def test_records_fold_every_character(spark):
    """Ligatures, signs of two letters, Hangul and what lies beyond U+FFFF."""
    texts = ["\ufb01rst caf\u00e9", "\u2116 5", "\uac00\ub098 mart", "\U0001d400cme \u00bd"]
    rows = [(i, "S1", f"S1-{i}", t, t, "en") for i, t in enumerate(texts)]
    df = normalized_records(spark.createDataFrame(rows, "rid long, source string, entity_id string, business_name string, business_address string, country string"))
    got = {r["rid"]: (r["name_norm"], r["addr_norm"]) for r in df.collect()}
    expected = ["first cafe", "no 5", "\u1100\u1161\u1102\u1161 mart", "acme 1 2"]
    assert [got[i] for i in range(len(texts))] == [(t, t) for t in expected]


def test_broadcast_and_shuffle_agree(records):
    a, b = (B.candidates(records, B.BlockingConfig(broadcast_bytes=n)) for n in (0, 10**9))
    assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def test_features_keep_the_pairs(records):
    found = B.candidates(records)
    made = build_features(found, records)
    assert made.count() == found.count() and set(FEATURES) <= set(made.columns)
    ratios = [c for c in FEATURES if c.endswith(("ratio", "jaccard", "match", "norm"))]
    assert made.filter(" OR ".join(f"{c} < 0 OR {c} > 1 OR {c} IS NULL" for c in ratios)).isEmpty()


@pytest.mark.parametrize("pred, true, score", [("", "", 1), ("x", "", 0), ("", "x", 0), ("ab", "a", 0.625 / 1.125), ("a", "ab", 0.625 / 0.75), ("c", "ab", 0)])
def test_entity_score(spark, pred, true, score):
    ids = spark.createDataFrame([("S1-1",)], "source1_entity_id string")
    p = spark.createDataFrame([("S1-1", x) for x in pred], "source1_entity_id string, candidate_entity_id string")
    t = spark.createDataFrame([("S1-1", x) for x in true], "source1_entity_id string, matched_entity_id string")
    assert E.macro_f_half(p, t, ids).first()[0] == pytest.approx(score)


def test_scores_of_nothing(spark):
    p = spark.createDataFrame([], "source1_entity_id string, candidate_entity_id string")
    t = spark.createDataFrame([], "source1_entity_id string, matched_entity_id string")
    assert E.macro_f_half(p, t, p.select("source1_entity_id")).first()[0] == 0.0
    assert E.recall_ceiling(p, t).first()["recall_ceiling"] == 1.0


def test_ids_outside_the_truth_count(spark):
    p = spark.createDataFrame([("S1-9", "S2-1")], "source1_entity_id string, candidate_entity_id string")
    t = spark.createDataFrame([("S1-1", "S2-1")], "source1_entity_id string, matched_entity_id string")
    assert E.macro_f_half(p, t, t.select("source1_entity_id")).first()[0] == 0.0


def test_sweep_takes_the_lowest_of_equals(spark):
    ids = spark.createDataFrame([("S1-1",), ("S1-2",)], "source1_entity_id string")
    scored = spark.createDataFrame([("S1-1", "S2-1", 0.7), ("S1-1", "S2-2", 0.3), ("S1-2", "S2-3", 0.2)], "source1_entity_id string, candidate_entity_id string, prob double")
    truth = spark.createDataFrame([("S1-1", "S2-1")], "source1_entity_id string, matched_entity_id string")
    curve = E.sweep(scored, truth, ids)
    assert curve.count() == 91 and max(r["threshold"] for r in curve.collect()) == 0.9500000000000002
    threshold, score = E.best_threshold(curve)
    assert threshold == 0.30000000000000004 and score == 1.0
    assert E.best_threshold(E.sweep(scored, truth.limit(0), ids.limit(0))) == (0.5, 0.0)


def test_split_and_samples(records):
    ids = records.filter("source = 'S1'").select(F.col("entity_id").alias("source1_entity_id"))
    split = sampling.group_split(ids, 0.2, 1)
    assert split.count() == ids.count() and 0 < split.filter("is_validation").count() < ids.count() / 2
    assert split.exceptAll(sampling.group_split(ids.repartition(7), 0.2, 1)).isEmpty()
    truth = truth_pairs(records)
    kept = sampling.sample_preserving(records, truth, 10, 8, 1)
    assert kept["S1"].count() == 10 and kept["S2"].count() == kept["S3"].count() == 8
    matched = {r["matched_entity_id"] for r in truth.join(kept["S1"].withColumnRenamed("entity_id", "source1_entity_id"), "source1_entity_id").collect()}
    assert matched <= {r["entity_id"] for s in ("S2", "S3") for r in kept[s].collect()}


def test_tsv_quotes_and_missing(spark, tmp_path):
    path = tmp_path / "s.tsv"
    path.write_text('entity_id\tbusiness_name\tbusiness_address\tcountry\nS1-1\t"Acme ""X"" Ltd"\tNA\t\nS1-2\tÉlan\tnan\tfr\nS1-3\ta\tb\tc\n', encoding="utf-8")
    df = tsv.read_source(spark, str(path))
    assert [tuple(r) for r in df.collect()][:2] == [("S1-1", 'Acme "X" Ltd', "NA", ""), ("S1-2", "Élan", "nan", "fr")]
    assert [r["entity_id"] for r in tsv.read_source(spark, str(path), 2, ["entity_id"]).collect()] == ["S1-1", "S1-2"]
    assert [r["entity_id"] for r in tsv.read_rows(df, 1, 3).collect()] == ["S1-2", "S1-3"]
    truth = tmp_path / "t.tsv"
    truth.write_text("source1_entity_id\tmatched_entity_ids\nS1-1\tS2-1,S2-1,,S3-2\nS1-2\t\nS1-1\tS2-9\n")
    got = {r["source1_entity_id"]: r["matched"] for r in tsv.read_ground_truth(spark, str(truth)).collect()}
    assert got == {"S1-1": ["S2-9"], "S1-2": []}
    assert tsv.read_ground_truth(spark, str(truth), df.limit(1)).count() == 1
    assert {r["entity_id"] for r in tsv.read_ids(spark, str(path)).collect()} == {"S1-1", "S1-2", "S1-3"}


def test_id_list_sink(spark, tmp_path):
    s1 = spark.createDataFrame([("S1-2", 0), ("S1-1", 1)], "entity_id string, position int")
    lists = spark.createDataFrame([("S1-1", ["S2-3", "S2-1", "S2-3"])], "source1_entity_id string, matched array<string>")
    tsv.write_matches(s1, lists, str(tmp_path / "out"))
    (part,) = glob.glob(str(tmp_path / "out/part-*"))
    assert open(part).read() == "source1_entity_id\tmatched_entity_ids\nS1-2\t\nS1-1\tS2-3,S2-1\n"


FILE = "source1_entity_id\tmatched_entity_ids\nS1-1\tS2-1,S2-1\nS1-1\tS2-1\n\nS1-2\tS1-1\nS1-3\tX9-1\nS1-4\tS2-1,\nS1-5\tS2-77\nS1-8\t\nno tab here\n"


def test_file_rules(spark, tmp_path):
    (tmp_path / "m.tsv").write_text(FILE)
    (tmp_path / "c.tsv").write_text("source1_entity_id\tcandidate_entity_ids\n" + "".join(f"S1-{i}\tS2-2\n" for i in range(1, 8)))
    required = spark.createDataFrame([(f"S1-{i}",) for i in range(1, 8)], "entity_id string")
    targets = spark.createDataFrame([("S2-1",), ("S2-2",), ("S3-1",)], "entity_id string")
    issues = quality.validate_files(spark, str(tmp_path / "m.tsv"), str(tmp_path / "c.tsv"), required, targets)
    got = {(r["level"], r["rule"]): r["n"] for r in quality.summary(issues).collect()}
    assert got == {
        ("error", "no_tab"): 1, ("error", "duplicate_row"): 1, ("error", "duplicate_id"): 1, ("error", "self_match"): 1, ("error", "wrong_prefix"): 2,
        ("error", "unknown_id"): 1, ("error", "missing_row"): 2, ("error", "extra_row"): 1, ("warning", "not_a_candidate"): 6,
    }
    assert not quality.passed(issues)


@pytest.mark.parametrize("text, rule", [("", "empty_file"), ("source1_entity_id,matched_entity_ids\n", "comma_separated"), ("a\tb\n", "header_mismatch")])
def test_header_rules(spark, tmp_path, text, rule):
    (tmp_path / "m.tsv").write_text(text)
    issues = quality.validate_files(spark, str(tmp_path / "m.tsv"))
    assert rule in {r["rule"] for r in issues.collect()} and not quality.passed(issues)


def test_missing_files(spark, tmp_path):
    (tmp_path / "m.tsv").write_text("source1_entity_id\tmatched_entity_ids\nS1-1\t\n")
    issues = quality.validate_files(spark, str(tmp_path / "m.tsv"), str(tmp_path / "none.tsv"))
    assert {(r["level"], r["rule"]) for r in issues.collect()} == {("warning", "missing_file"), ("warning", "ids_unchecked")} and quality.passed(issues)
    assert not quality.passed(quality.validate_files(spark, str(tmp_path / "none.tsv")))


def test_not_utf8(spark, tmp_path):
    (tmp_path / "m.tsv").write_bytes("source1_entity_id\tmatched_entity_ids\nS1-1\tS2-é\n".encode("latin-1"))
    issues = quality.validate_files(spark, str(tmp_path / "m.tsv"))
    assert "not_utf8" in {r["rule"] for r in issues.collect()} and not quality.passed(issues)


def test_command_line(spark, source, tmp_path, capsys):
    def put(name, rows, *columns):
        lines = ["\t".join(columns)] + ["\t".join(str(r[c] or "") for c in columns) for r in rows]
        (tmp_path / name).write_text("\n".join(lines) + "\n")

    truth = truth_pairs(source).groupBy("source1_entity_id").agg(F.array_join(F.collect_set("matched_entity_id"), ",").alias("matched_entity_ids")).collect()
    put("train_ground_truth.tsv", truth, "source1_entity_id", "matched_entity_ids")
    for number in (1, 2, 3):
        rows = source.filter(F.col("source") == f"S{number}").orderBy("rid").collect()
        for part in ("train", "test"):
            put(f"{part}_source{number}.tsv", rows, *tsv.RECORD_COLUMNS)
    folder, fitted = str(tmp_path), str(tmp_path / "matcher")
    assert cli.main(["train", "--train-dir", folder, "--model-out", fitted, "--depth", "2", "--rounds", "2"], spark) == 0
    made = {}
    for batches in ("1", "3"):
        out = tmp_path / f"out{batches}"
        assert cli.main(["predict", "--test-dir", folder, "--model", fitted, "--output-dir", str(out), "--batches", batches], spark) == 0
        made[batches] = [open(glob.glob(str(out / name / "part-*"))[0]).read() for name in ("matching_results.tsv", "candidate_pairs.tsv")]
    assert made["1"] == made["3"] and made["1"][1].count("S2-") > 0
    files = ["--matching", str(tmp_path / "out1/matching_results.tsv"), "--candidate", str(tmp_path / "out1/candidate_pairs.tsv")]
    assert cli.main(["validate", *files, "--test-dir", folder, "--check-ids"], spark) == 0
    put("bad.tsv", [{"source1_entity_id": "S1-none", "matched_entity_ids": "S1-1"}], "source1_entity_id", "matched_entity_ids")
    assert cli.main(["validate", "--matching", str(tmp_path / "bad.tsv"), "--test-dir", folder], spark) == 1
    assert cli.main(["validate", *files, "--test-dir", str(tmp_path / "nowhere")], spark) == 1
    assert "error missing_row" in capsys.readouterr().out


def test_train_save_load_predict(spark, source, tmp_path):
    fitted = matching.train(source, truth_pairs(source), fit_config=model.ModelConfig(depth=3, rounds=4))
    assert fitted.positives > 0 and 0.05 <= fitted.matcher.threshold <= 0.96 and fitted.recall_ceiling > 0.9
    fitted.matcher.save(spark, str(tmp_path / "matcher"))
    loaded = model.Matcher.load(spark, str(tmp_path / "matcher"))
    assert loaded.threshold == fitted.matcher.threshold and loaded.blocking == fitted.matcher.blocking
    found, matches = matching.predict(source, loaded)
    assert matches.join(found, ["source1_entity_id", "candidate_entity_id"], "left_anti").isEmpty()
    matching.write_outputs(source, found, matches, str(tmp_path / "m"), str(tmp_path / "c"))
    issues = quality.validate_files(spark, str(tmp_path / "m"), str(tmp_path / "c"), source.filter("source = 'S1'"), source.filter("source <> 'S1'"))
    assert issues.isEmpty()


def test_stream_equals_batch(spark, source, tmp_path):
    from kindred.streaming.incremental import match_stream

    source.filter("source = 'S1'").repartition(3).write.parquet(str(tmp_path / "in"))
    arriving = spark.readStream.schema(source.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    match_stream(arriving, source, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).drop("batch")
    batch = B.candidates(normalized_records(source))
    assert got.exceptAll(batch.select(*got.columns)).isEmpty() and got.count() == batch.count()


def test_catalogue_is_complete():
    import __spark_entry__ as entry

    names = entry.queries()
    assert set(entry.oracle_sql()) <= set(names)
    assert not [n for n, m in itertools.groupby(sorted(names)) if len(list(m)) > 1]


def test_entry_needs_no_session():
    """Names and SQL can be read before any Spark session is there."""
    import os
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = "import __spark_entry__ as e; assert len(e.queries()) > 50 and set(e.oracle_sql()) <= set(e.queries())"
    assert subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True).returncode == 0


def test_local_parts(spark):
    from kindred.partitions import RECORDS_PER_TASK, local_parts

    rows = [("S1", "a", None)] * (9 * RECORDS_PER_TASK + 1) + [("S2", "é", "bc"), ("S3", None, None)]
    records = spark.createDataFrame(rows, "source string, business_name string, business_address string")
    assert local_parts(records, 4) == 10 and local_parts(records, 3) is None
    assert local_parts(records.limit(0), 0) == 4
