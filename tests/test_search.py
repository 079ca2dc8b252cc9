"""Phrase search: the hand-traced verdicts, and random cases against the definition."""

import random

from hypothesis import given, settings
from hypothesis import strategies as st

from phrasedex.operators import (
    candidate_docs,
    lookup_terms,
    parse_queries,
    partial_phrase_matches,
    phrase_docs,
    phrase_match,
    single_term_docs,
    with_bucket,
)
from phrasedex.plans.build import corpus_postings
from phrasedex.sources import parse_marked_documents
from tests.conftest import FIXTURE_DOC

PHRASES = ["Civil War", "Civil War Fighting", "War Fights", "Wars Fighting", "Fighting Foo", "foo bar", "war"]


def _run(spark, docs, phrases):
    index = with_bucket(corpus_postings(docs))
    q = spark.createDataFrame(list(enumerate(phrases, start=1)), "query_id long, query string")
    lookup = lookup_terms(index, parse_queries(q))
    matches = {}
    for r in phrase_match(lookup).collect():
        matches.setdefault((r.query_id, r.doc_id), set()).add(r.start_pos)
    steps = {}
    for r in partial_phrase_matches(lookup).collect():
        steps.setdefault((r.query_id, r.doc_id), set()).add((r.step, r.pos))
    return lookup, matches, steps


def test_hand_traced_verdicts(spark):
    docs = parse_marked_documents(spark.createDataFrame([(FIXTURE_DOC,)], "segment string"))
    lookup, matches, steps = _run(spark, docs, PHRASES)
    assert matches == {
        (1, 12): {0, 10},
        (2, 12): {10},
        (3, 12): {16},
        (7, 12): {6, 16},
    }
    assert steps == {
        (1, 12): {(1, 0), (1, 10)},
        (2, 12): {(1, 0), (1, 10), (2, 16)},
        (3, 12): {(1, 16)},
    }
    cands = {(r.query_id, r.doc_id) for r in candidate_docs(lookup).collect()}
    # Every phrase's stems occur in the document; only adjacency tells them apart.
    assert cands == {(q, 12) for q in range(1, 8)}


def test_candidates_include_foo_bar(spark):
    docs = parse_marked_documents(spark.createDataFrame([(FIXTURE_DOC,)], "segment string"))
    lookup, matches, _ = _run(spark, docs, ["foo bar"])
    assert {(r.query_id, r.doc_id) for r in candidate_docs(lookup).collect()} == {(1, 12)}
    assert matches == {}


def test_single_term_and_docs(spark):
    docs = parse_marked_documents(spark.createDataFrame([(FIXTURE_DOC,)], "segment string"))
    index = with_bucket(corpus_postings(docs))
    q = spark.createDataFrame([(1, "war"), (2, "civil war")], "query_id long, query string")
    parsed = parse_queries(q)
    one = [(r.query_id, r.doc_id, list(r.positions)) for r in single_term_docs(index, parsed).collect()]
    assert one == [(1, 12, [6, 16])]
    got = {(r.query_id, r.doc_id, r.n_matches) for r in phrase_docs(phrase_match(lookup_terms(index, parsed))).collect()}
    assert got == {(1, 12, 2), (2, 12, 2)}


def test_blank_and_repeated_queries(spark):
    docs = spark.createDataFrame([(1, "party time party time party")], "doc_id long, body string")
    lookup, matches, steps = _run(spark, docs, ["   ", "party time party", "--"])
    assert matches == {(2, 1): {0, 11}}
    assert steps[(2, 1)] == {(1, 0), (1, 11), (2, 6), (2, 17)}


# ---- property test: the vote aggregation against the definition ----

VOCAB = ["ab", "cd", "ef", "gh", "x", "ab,", "cd.", "ef-gh", "--"]


def _norm_words(raw):
    return [w for w in "".join(c.lower() if c.isascii() and c.isalnum() else " " for c in raw).split(" ") if w]


def _by_definition(doc_tokens, phrase):
    """Whether the phrase occurs, and its steps, straight from the rule (stems are the words here).

    From every position of word 0, word k must stand at that position plus the
    lengths of the words before it, each plus one; step k names the position of
    word k - 1 as long as this holds. None without all words in the document.
    """
    places, at = {}, 0
    for raw in doc_tokens:
        for w in _norm_words(raw):
            places.setdefault(w, set()).add(at)
        at += len(raw) + 1
    words = _norm_words(phrase)
    if not words or not places.keys() >= set(words):
        return None, set()
    offsets = [sum(len(w) + 1 for w in words[:k]) for k in range(len(words))]
    found, steps = False, set()
    for start in places[words[0]]:
        reached = [start + o in places[w] for w, o in zip(words, offsets)]
        unbroken = reached.index(False) if False in reached else len(words)
        steps |= {(k, start + offsets[k - 1]) for k in range(1, unbroken)}
        found |= unbroken == len(words)
    return found, steps


@settings(max_examples=4, deadline=None)
@given(st.integers(min_value=0, max_value=10**6))
def test_votes_equal_definition(spark, seed):
    rng = random.Random(seed)
    docs = [(d, " ".join(rng.choice(VOCAB) for _ in range(rng.randint(1, 40)))) for d in range(1, 13)]
    phrases = [" ".join(rng.choice(VOCAB[:5]) for _ in range(rng.randint(1, 4))) for _ in range(12)]
    df = spark.createDataFrame(docs, "doc_id long, body string")
    _, matches, steps = _run(spark, df, phrases)
    for qi, phrase in enumerate(phrases, start=1):
        for d, body in docs:
            ok, want_steps = _by_definition(body.split(), phrase)
            assert ((qi, d) in matches) == bool(ok), (phrase, body)
            if ok is not None:
                assert steps.get((qi, d), set()) == want_steps, (phrase, body)
