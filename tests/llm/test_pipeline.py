import os
import subprocess
import sys
import zlib

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline
from phrasedex.llm import token_files
from phrasedex.llm.queries import ORACLE_SQL, QUERIES

from .conftest import SF
from .test_decontamination import brute as overlaps
from .test_near_duplicates import brute as groups

ROOT = os.path.dirname(os.path.abspath(corpus_pipeline.__file__))


def test_stages_equal_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = [(9001, "12 34", "en", "s", 5), (9002, None, "en", "s", 0)]
    docs = docs.unionByName(spark.createDataFrame(extra, docs.schema))
    kept, columns = docs, docs.columns
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path / name)
        stage(spark, kept, SF).write.parquet(path)
        kept = spark.read.parquet(path)
        seen.append(kept.toPandas())
        if name != "token_files":
            assert kept.columns == columns
    language, near, clean, mixed, files = seen
    ids = set(docs.toPandas()["doc_id"])
    assert ids - set(language["doc_id"]) == {9001, 9002}
    want = groups(list(zip(language["doc_id"], language["text"])))
    assert set(near["doc_id"]) == {i for i, (_, c) in want.items() if c == i}
    items = list(spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").toPandas().itertuples(index=False))
    bad = {d for d, _ in overlaps(list(zip(near["doc_id"], near["text"])), items)}
    assert set(clean["doc_id"]) == set(near["doc_id"]) - bad
    assert set(mixed["doc_id"]) <= set(clean["doc_id"]) and mixed.groupby("doc_id").size().max() <= 3
    tok = Tokenizer.from_file(token_files.TOKENIZER)
    start, rows = 0, []
    for r in mixed.sort_values("doc_id").itertuples():
        t = [*tok.encode(r.text, add_special_tokens=False).ids, 1]
        rows.append((r.doc_id, start, len(t), zlib.crc32(np.array(t, "<u4").tobytes())))
        start += len(t)
    assert sorted(map(tuple, files[["doc_id", "start", "n_tokens", "ids_crc32"]].itertuples(index=False))) == sorted(rows)


def test_registration():
    assert [int(q[2:].split("_")[0]) for q in sorted(QUERIES, key=lambda q: int(q[2:].split("_")[0]))] == list(range(1, 14))
    assert set(ORACLE_SQL) <= set(QUERIES) and len(corpus_pipeline.STAGES) == 5


def test_nothing_else_imports_the_subpackage():
    code = (
        "import sys, importlib.abc\n"
        "class Gone(importlib.abc.MetaPathFinder):\n"
        "    def find_spec(self, name, path, target=None):\n"
        "        if name in ('corpus_pipeline', 'phrasedex.llm'):\n"
        "            raise ModuleNotFoundError(name, name=name)\n"
        "sys.meta_path.insert(0, Gone())\n"
        "import __spark_entry__ as e\n"
        "assert not [q for q in e.queries() if q.startswith('op') or q == 'pipeline'], e.queries()\n"
        "assert len(e.queries()) >= 24 and set(e.oracle_sql()) <= set(e.queries())\n"
    )
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)
