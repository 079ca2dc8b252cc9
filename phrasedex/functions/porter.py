"""Porter (1980) suffix stripping as one JVM column expression.

A word is carried through the steps as a (w, cv) pair: the current word and its
consonant/vowel string (``c``/``v`` per letter). Every rule only removes a
suffix or replaces it with a fixed string, so after the first fold the CV string
is updated by slicing and appending the replacement's own CV string; it is never
recomputed. Each step binds the current pair once through ``let`` (a lambda
variable), so the expression grows linearly with the number of steps and can be
used inside ``transform`` (per letter run) or next to other columns.

Measure ``m`` of a prefix is the number of ``vc`` pairs in its CV string.
Two departures from the paper are kept: ``bli -> ble`` in step 2 (in place of
``abli -> able``) and ``logi -> log``; words of one or two letters are returned
unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The suffix rules of the algorithm, (suffix, replacement), in the
# order in which they are tried. Only the first suffix a word ends with counts
# within a step, even if its measure condition then fails.
STEP2_RULES = [
    ("ational", "ate"), ("tional", "tion"),
    ("enci", "ence"), ("anci", "ance"),
    ("izer", "ize"),
    ("bli", "ble"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"),
    ("ization", "ize"), ("ation", "ate"), ("ator", "ate"),
    ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"),
    ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"),
    ("logi", "log"),
]
STEP3_RULES = [
    ("icate", "ic"), ("ative", ""), ("alize", "al"),
    ("iciti", "ic"),
    ("ical", "ic"), ("ful", ""),
    ("ness", ""),
]
STEP4_SUFFIXES = [
    "al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent",
    "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize",
]
VOWELS = ("a", "e", "i", "o", "u")


def letter_runs(word) -> Column:
    """Maximal runs of letters and of digits, in order: ``m80a -> [m, 80, a]``."""
    word = F.col(word) if isinstance(word, str) else word
    return F.regexp_extract_all(word, F.lit("[a-z]+|[0-9]+"), 0)


def _cv_fold(word: Column) -> Column:
    """CV string: a, e, i, o, u are vowels; y is a vowel after a consonant."""
    return F.aggregate(
        F.split(word, ""),
        F.lit(""),
        lambda acc, ch: F.concat(
            acc,
            F.when(ch.isin(*VOWELS), F.lit("v"))
            .when(ch == "y", F.when((acc == "") | acc.endswith("v"), F.lit("c")).otherwise(F.lit("v")))
            .otherwise(F.lit("c")),
        ),
    )


def _static_cv(s: str) -> str:
    # Replacements contain no 'y', so their CV string does not depend on context.
    return "".join("v" if ch in VOWELS else "c" for ch in s)


def _prefix(c: Column, cut) -> Column:
    return c.substr(F.lit(1), F.length(c) - cut)


def _measure(cv: Column) -> Column:
    return F.regexp_count(cv, F.lit("vc"))


def _ends_cvc(w: Column, cv: Column) -> Column:
    return (F.length(w) >= 3) & cv.endswith("cvc") & ~F.substring(w, -1, 1).isin("w", "x", "y")


def _let(value: Column, body) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def _state(w: Column, cv: Column) -> Column:
    return F.struct(w.alias("w"), cv.alias("cv"))


def _cut_add(state: Column, cut: Column, add: Column | None = None, add_cv: Column | None = None) -> Column:
    add = add if add is not None else F.lit("")
    add_cv = add_cv if add_cv is not None else F.lit("")
    return _let(
        F.struct(cut.alias("c"), add.alias("a"), add_cv.alias("b")),
        lambda x: _state(
            F.concat(_prefix(state["w"], x["c"]), x["a"]), F.concat(_prefix(state["cv"], x["c"]), x["b"])
        ),
    )


def _x1a(s: Column) -> Column:
    w = s["w"]
    cut = F.when(w.endswith("sses"), 2).when(w.endswith("ies"), 2).when(w.endswith("s") & ~w.endswith("ss"), 1).otherwise(0)
    return _cut_add(s, cut)


def _x1b(s: Column) -> Column:
    def strip(s: Column) -> Column:
        w, cv = s["w"], s["cv"]
        eed = w.endswith("eed")
        ed = ~eed & w.endswith("ed") & _prefix(cv, 2).contains("v")
        ing = ~eed & w.endswith("ing") & _prefix(cv, 3).contains("v")
        cut = F.when(eed & (_measure(_prefix(cv, 3)) > 0), 1).when(ed, 2).when(ing, 3).otherwise(0)
        return F.struct(_cut_add(s, cut).alias("s"), (ed | ing).alias("fix"))

    def tidy(t: Column) -> Column:
        s, fix = t["s"], t["fix"]
        w, cv = s["w"], s["cv"]
        last = F.substring(w, -1, 1)
        double = (F.length(w) >= 2) & (last == F.substring(w, -2, 1)) & cv.endswith("c")
        add_e = fix & (w.endswith("at") | w.endswith("bl") | w.endswith("iz"))
        drop_one = fix & ~add_e & double & ~last.isin("l", "s", "z")
        short = fix & ~add_e & ~double & (_measure(cv) == 1) & _ends_cvc(w, cv)
        grow = add_e | short
        return _cut_add(
            s,
            F.when(drop_one, 1).otherwise(0),
            F.when(grow, F.lit("e")).otherwise(F.lit("")),
            F.when(grow, F.lit("v")).otherwise(F.lit("")),
        )

    return _let(strip(s), tidy)


def _x1c(s: Column) -> Column:
    hit = s["w"].endswith("y") & _prefix(s["cv"], 1).contains("v")
    return _cut_add(
        s,
        F.when(hit, 1).otherwise(0),
        F.when(hit, F.lit("i")).otherwise(F.lit("")),
        F.when(hit, F.lit("v")).otherwise(F.lit("")),
    )


def _first_rule_of(w: Column, rules, extra=None) -> Column:
    expr = None
    for i, (suffix, _) in enumerate(rules, start=1):
        cond = w.endswith(suffix)
        if extra and suffix in extra:
            cond = cond & extra[suffix](w)
        expr = F.when(cond, i) if expr is None else expr.when(cond, i)
    return expr.otherwise(0)


def _xrules(s: Column, rules, min_measure: int, extra=None) -> Column:
    lens = F.array(*[F.lit(len(x)) for x, _ in rules])
    reps = [r for _, r in rules]

    def body(rule: Column) -> Column:
        idx = F.greatest(rule, F.lit(1))
        sfx_len = F.when(rule > 0, F.element_at(lens, idx)).otherwise(0)
        fire = (rule > 0) & (_measure(_prefix(s["cv"], sfx_len)) > min_measure)
        if not any(reps):
            return _cut_add(s, F.when(fire, sfx_len).otherwise(0))
        return _cut_add(
            s,
            F.when(fire, sfx_len).otherwise(0),
            F.when(fire, F.element_at(F.array(*[F.lit(r) for r in reps]), idx)).otherwise(F.lit("")),
            F.when(fire, F.element_at(F.array(*[F.lit(_static_cv(r)) for r in reps]), idx)).otherwise(F.lit("")),
        )

    return _let(_first_rule_of(s["w"], rules, extra), body)


def _x4(s: Column) -> Column:
    extra = {"ion": lambda w: (F.length(w) >= 4) & F.substring(w, -4, 1).isin("s", "t")}
    return _xrules(s, [(x, "") for x in STEP4_SUFFIXES], 1, extra)


def _x5(s: Column) -> Column:
    def drop_e(s: Column) -> Column:
        w, cv = s["w"], s["cv"]
        m = _measure(cv)
        hit = w.endswith("e") & ((m > 1) | ((m == 1) & ~_ends_cvc(_prefix(w, 1), _prefix(cv, 1))))
        return _cut_add(s, F.when(hit, 1).otherwise(0))

    def drop_l(s: Column) -> Column:
        hit = s["w"].endswith("ll") & (_measure(s["cv"]) > 1)
        return _cut_add(s, F.when(hit, 1).otherwise(0))

    return _let(drop_e(s), drop_l)


def porter_stem(run: Column) -> Column:
    """Stem of one lower-case letter run, as a single expression."""
    steps = [
        _x1a, _x1b, _x1c,
        lambda s: _xrules(s, STEP2_RULES, 0),
        lambda s: _xrules(s, STEP3_RULES, 0),
        _x4, _x5,
    ]

    def chain(i: int):
        if i == len(steps):
            return lambda s: s["w"]
        return lambda s: _let(steps[i](s), chain(i + 1))

    stemmed = _let(_state(run, _cv_fold(run)), chain(0))
    return F.when(F.length(run) <= 2, run).otherwise(stemmed)


def stem_word(word: Column) -> Column:
    """Stem of a normalised word: letter runs stemmed, digit runs kept, glued in order."""
    return F.array_join(
        F.transform(letter_runs(word), lambda r: F.when(r.rlike("^[a-z]"), porter_stem(r)).otherwise(r)), ""
    )


# Building the stemmer expression costs thousands of driver-to-JVM calls; the
# expression for the column named "word" is built once per Spark context.
_WORD_STEM: dict[int, Column] = {}


def stem_of_word() -> Column:
    """``stem_word(col("word"))``, built once per Spark context."""
    from pyspark import SparkContext

    key = id(SparkContext._active_spark_context)
    if key not in _WORD_STEM:
        _WORD_STEM.clear()
        _WORD_STEM[key] = stem_word(F.col("word"))
    return _WORD_STEM[key]
