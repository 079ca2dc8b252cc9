"""Stemmer: golden words, and random words against the SQL stemmer of the oracle."""

import duckdb
from hypothesis import given, settings
from hypothesis import strategies as st

from oracle_sql import stemmer_ctes
from pyspark.sql import functions as F

from phrasedex.functions.porter import porter_stem
from phrasedex.operators.stemming import stem_vocabulary

# Words and their stems as the published algorithm defines them.
GOLDEN = dict(
    p.split("->")
    for p in (
        "caresses->caress ponies->poni ties->ti cats->cat feed->feed agreed->agre disabled->disabl "
        "matting->mat mating->mate meeting->meet milling->mill messing->mess meetings->meet fighting->fight "
        "king->king kingdom->kingdom ies->i is->is a->a m80a->m80a 1990s->1990s running2running->run2run "
        "relational->relat conditional->condit archaeology->archaeolog possibly->possibl "
        "generalizations->gener oscillators->oscil adoption->adopt adjustment->adjust rate->rate "
        "cease->ceas controlling->control rolling->roll sky->sky happy->happi syzygy->syzygi toys->toi "
        "flies->fli hopping->hop hoping->hope fizzed->fizz conformably->conform radically->radic "
        "aed->a eed->eed oed->o ion->ion ing->ing"
    ).split()
)


def test_golden_words(spark):
    df = spark.createDataFrame([(w,) for w in GOLDEN], "word string")
    got = dict(stem_vocabulary(df).collect())
    assert got == GOLDEN


def _sql_stems(words):
    con = duckdb.connect()
    con.execute("CREATE TABLE runs(run VARCHAR)")
    con.executemany("INSERT INTO runs VALUES (?)", [(w,) for w in words])
    sql = "WITH " + stemmer_ctes("runs").strip().lstrip(",") + " SELECT run, stem FROM stems"
    return dict(con.sql(sql).fetchall())


# Letters weighted towards the ones that build the suffixes of the rules.
_WORD = st.text(alphabet="aeiouybcdlnstgzmrvx", min_size=1, max_size=14) | st.builds(
    lambda a, b: a + b,
    st.text(alphabet="aeioubcdlnrstmy", min_size=1, max_size=6),
    st.sampled_from(
        ["ational", "tional", "enci", "anci", "izer", "bli", "alli", "entli", "eli", "ousli", "ization", "ation",
         "ator", "alism", "iveness", "fulness", "ousness", "aliti", "iviti", "biliti", "logi", "icate", "ative",
         "alize", "iciti", "ical", "ful", "ness", "al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement",
         "ment", "ent", "sion", "tion", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize", "sses", "ies", "ss",
         "s", "eed", "ed", "ing", "ated", "bling", "izing", "tted", "lled", "ssing", "y", "e", "ll"]
    ),
)


@settings(max_examples=5, deadline=None)
@given(st.lists(_WORD, min_size=50, max_size=120, unique=True))
def test_spark_stemmer_equals_sql_stemmer(spark, words):
    df = spark.createDataFrame([(w,) for w in words], "run string")
    got = dict(df.select("run", porter_stem(F.col("run")).alias("stem")).collect())
    assert got == _sql_stems(words)
