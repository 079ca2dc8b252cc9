import itertools
import re

import numpy as np

from phrasedex.llm.decontamination import LEAST, MASKS, SHORT, SHORT_MASK, SUBSTITUTIONS, WINDOW, find_overlaps, remove_contaminated


def tokens(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[a-z0-9\x80-\U0010ffff]+", low)


def brute(docs, items):
    """Every alignment of every pair, by the definition."""
    number: dict[str, int] = {}
    coded = lambda t: np.array([number.setdefault(w, len(number)) for w in tokens(t)], np.int64)
    parts = [(i, coded(u)) for i, u in items]
    out = set()
    for d, t in docs:
        a = coded(t)
        for i, b in parts:
            w = min(WINDOW, len(b))
            need = w - SUBSTITUTIONS if len(b) >= WINDOW else w - 1 if len(b) >= SHORT else w
            for shift in range(w - len(b), len(a) - w + 1) if len(b) >= LEAST else ():
                lo, hi = max(0, shift), min(len(a), shift + len(b))
                same = np.r_[0, np.cumsum(a[lo:hi] == b[lo - shift : hi - shift])]
                if len(same) > w and (same[w:] - same[:-w]).max() >= need:
                    out.add((d, i))
                    break
    return out


def test_masks_cover_every_pattern_of_substitutions():
    for wrong in itertools.combinations(range(WINDOW), SUBSTITUTIONS):
        assert any(not {s + o for o in m} & set(wrong) for m in MASKS for s in range(WINDOW - m[-1]))
    for n in range(SHORT, WINDOW):
        for wrong in range(n):
            assert any(wrong not in {s + o for o in SHORT_MASK} for s in range(n - SHORT_MASK[-1]))


def test_equals_brute_force(spark, frame):
    rng = np.random.default_rng(5)
    word = lambda: "w%d" % rng.integers(30)
    items = [(i, " ".join(word() for _ in range(rng.integers(6, 30)))) for i in range(12)] + [(50, None), (51, ""), (52, "one two"), (53, "four words, exactly these"), (3, "Again, an ITEM with the id three and more of its own words in it")]
    docs = [(100, None), (101, ""), (102, " ".join(word() for _ in range(400)))]
    for k in range(60):
        w = tokens(items[k % 12][1])
        for j in rng.choice(len(w), min(len(w), int(rng.integers(0, 6))), replace=False):
            w[j] = f"sub{k}{j}"
        docs.append((k, "Pre fix, " + " -- ".join(w[int(rng.integers(0, 3)) :]) + " post"))
    docs += [(300, "say: four WORDS exactly these."), (301, "four words exactly those"), (None, "four words exactly these again")]
    docs += [(0, docs[3][1]), (200, "again an item WITH the id three, and more of its own words in it")]
    bench = spark.createDataFrame([(i, t, 9) for i, t in items], "item_id long, text string, doc_id int")
    got = find_overlaps(frame(docs), bench)
    pairs = {(r["doc_id"], r["item_id"]) for r in got.collect()}
    assert pairs == brute(docs, items) and len(pairs) == got.count()
    # By text: rows of one id are judged by their own texts, null ids as any other.
    rows = [*docs, (None, items[0][1]), (None, "clean"), (102, items[1][1]), (None, None), (None, "")]
    clean = remove_contaminated(frame(rows), bench)
    assert clean.columns == frame([]).columns
    bad = {n for n, _ in brute([(n, t) for n, (_, t) in enumerate(rows)], items)}
    want = [r for n, r in enumerate(rows) if n not in bad]
    assert sorted(((r["doc_id"], r["text"]) for r in clean.collect()), key=str) == sorted(want, key=str)


def test_empty_tables(spark, frame):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert find_overlaps(frame([(1, "a b c")]), bench).collect() == []
    full = spark.createDataFrame([(1, "a b c d e f g h i j k l m n o p")], "item_id long, text string")
    assert find_overlaps(frame([]), full).collect() == []
