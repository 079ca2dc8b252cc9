import hashlib
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from phrasedex.llm import infill as X


def by_definition(doc_id, text):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    h = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    pre, mid, suf = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")):
        return doc_id, n, "plain", None, None, text.encode()
    form = "spm" if h4 % 100 < 50 else "psm"
    out = f"<S>{suf}<P>{pre}<M>{mid}" if form == "spm" else f"<P>{pre}<S>{suf}<M>{mid}"
    return doc_id, n, form, len(pre), len(mid), out.encode()


def check(ids, texts):
    got = X.transform_batch(ids, pa.array(texts, pa.string()), X.Settings())
    assert [r[:6] for r in got] == [by_definition(i, t) for i, t in zip(ids, texts)]
    assert [r[6] for r in got] == [hashlib.sha256((t or "").encode()).hexdigest() for t in texts]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="ab\n\nñ字😀<PSM>\r\x0b ", max_size=40), max_size=8))
def test_batches_equal_definition(texts):
    check(list(range(len(texts))), texts)


def test_edges():
    check([0, -5, None, None, 2**62, 7, 7], ["", "\n", None, "a\nb", "\n\n\n", "x<P>y\nz", "x<P>y\nz"])
    check([1], ["line\n" * 70_000 + "end"])
    assert X.transform_batch([], pa.array([], pa.string()), X.Settings()) == []
    # A slice of a larger array starts inside its buffers.
    check([3, 4], pa.array(["skip\n", "é\né", "b\n"]).slice(1).to_pylist())
    assert X.transform_batch([3, 4], pa.array(["skip\n", "é\né", "b\n"]).slice(1), X.Settings()) == X.transform_batch(
        [3, 4], pa.array(["é\né", "b\n"]), X.Settings()
    )


def test_rank_and_select():
    rng = np.random.default_rng(3)
    data = rng.choice(np.frombuffer(b"ab\n\x0b\x8a\xc3\x00\xff", np.uint8), 8 * 50)
    marks = X.unit_ends(data.view("<u8"))
    places = np.flatnonzero(data == 10)
    assert (marks.select(np.arange(len(places))) == places).all()
    assert (marks.rank(np.arange(401)) == np.searchsorted(places, np.arange(401))).all()


def test_rates_and_forms():
    plain = X.Settings(rate=0)
    assert {r[2] for r in X.transform_batch([*range(40)], pa.array(["a\nb\n"] * 40), plain)} == {"plain"}
    half = [r[2] for r in X.transform_batch([*range(400)], pa.array(["a\nb\n"] * 400), X.Settings(rate=50, spm=100))]
    assert set(half) == {"plain", "spm"} and 140 < half.count("spm") < 260


def test_table_with_clashing_columns(spark, frame):
    rows = [(1, "a\nb"), (1, "a\nb"), (None, "c"), (2, None), (3, "")]
    got = [tuple(r)[:6] for r in X.fill_in_middle(frame(rows)).collect()]
    key = lambda r: tuple(str(v) for v in r)
    assert sorted(((*r[:5], bytes(r[5])) for r in got), key=key) == sorted((by_definition(*r) for r in rows), key=key)
    assert X.fill_in_middle(frame([])).count() == 0


@pytest.mark.parametrize("sf", ["sf0.001"])
def test_whole_table(spark, sf):
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
    want = {r["doc_id"]: by_definition(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()}
    got = {r["doc_id"]: r for r in X.fill_in_middle(docs).collect()}
    assert {k: (*tuple(r)[:5], bytes(r["output"])) for k, r in got.items()} == want
