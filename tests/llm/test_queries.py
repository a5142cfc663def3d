import subprocess
import sys
from pathlib import Path

from invoicelens.llm import queries as llm

ROOT = Path(__file__).resolve().parents[2]
FOLDER = "/root/testdata/sf0.001"


def test_pipeline_keeps_what_brute_force_keeps(spark):
    import corpus_pipeline as pipeline
    from invoicelens.llm import jaccard_join, quality_rules, wu_manber
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").cache()
    stages = dict(pipeline.STAGES)
    good = stages["quality_rules"](spark, docs, FOLDER)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert {r["doc_id"] for r in good.collect()} == {
        i for i, t in texts.items() if quality_rules.passes(quality_rules.Measured(t or ""), quality_rules.RULES)}
    lined = stages["line_dedup"](spark, good, FOLDER).cache()
    after = {r["doc_id"]: r["text"] for r in lined.collect()}
    assert lined.columns == docs.columns and all(set(t.split("\n")) <= set(texts[i].split("\n")) for i, t in after.items())
    one = stages["jaccard_join"](spark, lined, FOLDER).cache()
    sets = {i: set(jaccard_join.shingle_set(t).tolist()) for i, t in after.items()}
    left = {r["doc_id"] for r in one.collect()}
    assert not any(sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) for a in left for b in left if a < b)
    assert all(any(100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) for b in sets if b != a) for a in set(sets) - left)
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    search = wu_manber.Searcher(items)
    clean = {r["doc_id"] for r in stages["decontamination"](spark, one, FOLDER).collect()}
    assert clean == {i for i in left if not search.occurs_in(wu_manber.words_of(after[i]))}
    assert {r["doc_id"] for r in stages["byte_bpe"](spark, one.filter(one["doc_id"].isin(list(clean))), FOLDER).collect()} == clean


def test_line_stage_with_clashing_names(spark):
    from pyspark.sql import functions as F
    import corpus_pipeline as pipeline
    docs = spark.createDataFrame([(1, "a b c\nx", 5), (2, "a b c", 5)], "doc_id bigint, text string, removed_lines int")
    kept = dict(pipeline.STAGES)["line_dedup"](spark, docs.withColumn("n_chars", F.length("text")), FOLDER)
    assert kept.columns == ["doc_id", "text", "removed_lines", "n_chars"]
    assert [tuple(r) for r in kept.collect()] == [(1, "a b c\nx", 5, 7)]


def test_pipeline_runs_from_end_to_end(spark):
    rows = llm.queries()["pipeline"](spark, FOLDER).collect()
    assert rows and all(r["n_tokens"] > 0 for r in rows)


def test_entry_works_without_these_operators():
    code = ("import sys; sys.modules['invoicelens.llm'] = None; sys.modules['corpus_pipeline'] = None\n"
            "import __spark_entry__ as e; names = set(e.queries()); assert names and not any(n.startswith('op') for n in names), names\n"
            "assert set(e.oracle_sql()) <= names")
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)
