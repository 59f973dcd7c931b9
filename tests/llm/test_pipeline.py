"""The pipeline against a brute-force version of its stages, and its stages on odd tables."""

import importlib.util
import os
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as P
from skyframe.llm import language_id

SF = "/root/testdata/sf0.001"

# the brute-force versions stand beside the operators' tests
_spec = importlib.util.spec_from_file_location("llm_operator_tests", os.path.join(os.path.dirname(__file__), "test_llm_operators.py"))
B = importlib.util.module_from_spec(_spec)
_spec.loader.exec_module(B)


def test_pipeline_matches_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    rows = [(i, t) for i, t in rows if language_id.has_letter((t or "").encode())]
    rows = [(i, t) for i, _, _, t in B.brute_lines(rows)]
    keep = {c for (i, t), (_, c, _, _) in zip(rows, B.brute_jaccard(rows))}
    rows = [(i, t) for i, t in rows if i in keep]
    bad = {i for i, *_, c in B.brute_contamination(rows, items) if c}
    rows = [(i, t) for i, t in rows if i not in bad]
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {i: tokenizer.encode(t, add_special_tokens=False).ids + [1] for i, t in rows}
    got, place = {}, 0
    for p in P.run(spark, SF).orderBy("sequence_id", "offset").collect():
        assert p.sequence_id * 2048 + p.offset == place
        place += p.length
        got.setdefault(p.doc_id, []).extend(np.frombuffer(bytes(p.ids), "<u4").tolist())
    assert got == want and len(bad) > 0


def test_stages_keep_the_columns_of_odd_tables(spark):
    line = "a line that is long enough to be dropped, found in five documents"
    rows = [(i, f"{line}\nown text of document number {i} and nothing else", "en", "s", 7) for i in range(8)]
    rows += [(20, None, None, None, None), (21, "", "en", "s", 0), (22, "12 34", "en", "s", 5), (None, "text without an id", "en", "s", 18),
             (3, rows[3][1], "en", "s", 7), (23, "word " * 60000, "en", "s", 300000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name in ("score", "lang_pred", "kept_text", "n_lines", "row", "group", "class", "n_hit", "keeper"):
        docs = docs.withColumn(name, F.lit(f"own {name}"))
    columns, schema = docs.columns, docs.dtypes
    for name, stage in P.STAGES[:-1]:
        docs = P.materialise(stage(spark, docs, SF), f"t-{name}")
        assert docs.columns == columns and docs.dtypes == schema
        assert docs.where("keeper <> 'own keeper' or n_hit <> 'own n_hit' or score <> 'own score'").count() == 0
    kept = Counter(r.doc_id for r in docs.collect())
    assert kept == Counter([*range(8), None, 23])  # no text, no letter and the repeated row went
    assert docs.where("doc_id = 7").first().text.startswith(line) and docs.where("doc_id = 6").first().n_chars < 60
    name, last = P.STAGES[-1]
    assert last(spark, docs, SF).agg(F.sum("length")).first()[0] > 60000


@pytest.mark.parametrize("name", [n for n, _ in P.STAGES])
def test_stages_of_an_empty_table(spark, name):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    out = dict(P.STAGES)[name](spark, docs, SF)
    assert out.collect() == [] and (name == "packing" or out.dtypes == docs.dtypes)


def test_entry_works_without_the_optional_part(tmp_path):
    """A copy of the repository without the llm folders and the pipeline still imports."""
    import shutil
    import subprocess
    import sys
    top = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    copy = tmp_path / "repo"
    shutil.copytree(top, copy, ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(n.startswith('op') or n == 'pipeline' for n in q); print(len(q))"
    done = subprocess.run([sys.executable, "-B", "-c", code], cwd=copy, capture_output=True, text=True, env={**os.environ, "PYTHONPATH": str(copy)})
    assert done.returncode == 0, done.stderr
