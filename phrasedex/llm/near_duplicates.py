"""MinHash near-duplicates by a multi-index Hamming join of b-bit signatures.

A document's set holds its distinct ``SHINGLE``-word shingles (A-Z lower-cased;
with fewer words the whole sequence is one). A signature is ``SYMBOLS`` minimum
hashes cut to ``BITS`` bits. Signatures are split into ``CHUNKS`` parts; of two
that differ in at most ``DISTANCE`` symbols, one part differs in at most
DISTANCE // CHUNKS = 1 (pigeonhole), so leaving out each symbol of a part in
turn enumerates every allowed error: all pairs within the distance share a key.
At similarity 0.75 the distance stays within the threshold but for one pair in about 10^5.

Equal sets form a class and only its smallest id goes on. Pairs are never
expanded inside a group:

1. Every member of a key is paired with the key's smallest id; the closest such
   leader within the distance is confirmed on full sets. Confirmed links give
   first components.
2. Members of a key that are still in different components are compared by
   signature, tile by tile; those within the distance form clusters (each
   member gives one row, not one per pair).
3. Inside a cluster all pairs of different components are decided on full sets,
   tile by tile, and links that connect them are kept.

A link is therefore confirmed, or its ends are already connected: components are
those of all links. Keys, minima and links are aggregated and joined by Spark;
members are compared in tiles of at most ``TILE``.

Classes go by numbers of their own, so ids may repeat (with the same or other
texts) or be null; texts of classes are found by id and text hash.

Defined cases: null text or text without words has an empty set, is linked with
nothing and is its own component; every row is returned, rows that repeat an id
are compared by their own texts; a null id is never the smallest: a component of
null ids only has a null ``component_id``, and ``kept`` compares null-safe; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phrasedex.session import shared_dir

from .common import ROW_KEY, dealt_join, release, table, utf8, with_row_key
from .components import components
from .rolling import U, batches, joined_words, mix, windows

SHINGLE = 5
SYMBOLS, BITS = 64, 16
CHUNKS, DISTANCE = 16, 31
SIMILAR, OF = 75, 100
TILE = 1024

_PER_CHUNK = SYMBOLS // CHUNKS
_FACTORS = mix(np.arange(1, SYMBOLS + 1, dtype=np.uint64)) | U(1)
_TERMS = mix(np.arange(1001, SYMBOLS + 1001, dtype=np.uint64))


def shingles(words: np.ndarray) -> np.ndarray:
    """Sorted distinct shingle hashes of a document's word hashes."""
    n = min(SHINGLE, len(words))
    return np.unique(windows(words, n) ^ U(n)) if n else np.empty(0, np.uint64)


def text_shingles(text: bytes) -> np.ndarray:
    return shingles(joined_words([text], lower=True)[1])


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return bool(both) and OF * both >= SIMILAR * (len(a) + len(b) - both)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """One row of SYMBOLS minimum hashes of BITS bits per nonempty set."""
    flat = np.concatenate(sets)
    starts = np.cumsum([0] + [len(s) for s in sets[:-1]])
    out = np.empty((len(sets), SYMBOLS), np.uint16)
    for k in range(SYMBOLS):
        out[:, k] = mix(np.minimum.reduceat(flat * _FACTORS[k] + _TERMS[k], starts)) >> U(64 - BITS)
    return out


def chunk_keys(sig: np.ndarray) -> np.ndarray:
    """Keys of signatures: per chunk and left-out symbol, a hash of the others with their place."""
    out = np.empty((len(sig), CHUNKS * _PER_CHUNK), np.uint64)
    for c in range(CHUNKS):
        part = sig[:, c * _PER_CHUNK : (c + 1) * _PER_CHUNK].astype(np.uint64)
        for e in range(_PER_CHUNK):
            code = np.full(len(sig), U(c * _PER_CHUNK + e), np.uint64)
            for k in range(_PER_CHUNK):
                if k != e:
                    code = (code << U(BITS)) ^ part[:, k]
            out[:, c * _PER_CHUNK + e] = mix(code + U(1))
    return out


def _signed(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, n_shingles, h1, h2, sig) from (doc_id, text, text_hash): h1, h2 name the set, sig is null for the empty set."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows:
            texts = [utf8(t) for t in b.column(1).to_pylist()]
            for lo, hi in batches(texts):
                _, h, _, _, first = joined_words(texts[lo:hi], lower=True)
                sets = [shingles(h[first[i] : first[i + 1]]) for i in range(hi - lo)]
                full = [i for i, s in enumerate(sets) if len(s)]
                names = np.zeros((2, hi - lo), np.uint64)
                sig: list[bytes | None] = [None] * (hi - lo)
                if full:
                    used = [sets[i] for i in full]
                    starts = np.cumsum([0] + [len(s) for s in used[:-1]])
                    flat = np.concatenate(used)
                    for k in range(2):
                        names[k, full] = np.add.reduceat(mix(flat + U(k + 1)), starts)
                    for i, s in zip(full, signatures(used)):
                        sig[i] = s.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0).slice(lo, hi - lo),
                        b.column(2).slice(lo, hi - lo),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array(names[0].view(np.int64)),
                        pa.array(names[1].view(np.int64)),
                        pa.array(sig, pa.binary()),
                    ],
                    ["doc_id", "text_hash", "n_shingles", "h1", "h2", "sig"],
                )
        release()

    return docs.mapInArrow(run, "doc_id long, text_hash long, n_shingles long, h1 long, h2 long, sig binary")


def _stored(df: DataFrame, name: str) -> DataFrame:
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def _keys(reps: DataFrame) -> DataFrame:
    @F.pandas_udf("array<long>")
    def keys(s: pd.Series) -> pd.Series:
        sig = np.frombuffer(b"".join(s), np.uint16).reshape(-1, SYMBOLS)
        return pd.Series(list(chunk_keys(sig).view(np.int64)))

    return reps.select(F.posexplode(keys("sig")).alias("number", "key"), F.col("rep").alias("doc"))


def _distance(left: str, right: str) -> Column:
    """Number of symbols in which two signature columns differ."""

    @F.pandas_udf("int")
    def count(a: pd.Series, b: pd.Series) -> pd.Series:
        x = np.frombuffer(b"".join(a), np.uint16).reshape(-1, SYMBOLS)
        y = np.frombuffer(b"".join(b), np.uint16).reshape(-1, SYMBOLS)
        return pd.Series((x != y).sum(axis=1).astype(np.int32))

    return count(left, right)


def _confirm(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs (a, b) whose full sets are similar enough; each row carries both texts, so no pair group is gathered."""

    @F.pandas_udf("boolean")
    def linked(rows: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        z, last, known = zstandard.ZstdDecompressor(), None, None
        for a, ta, tb in rows:
            out = np.empty(len(a), bool)
            for i, (ident, x, y) in enumerate(zip(a, ta, tb)):
                if ident != last:
                    last, known = ident, text_shingles(z.decompress(x))
                out[i] = similar(known, text_shingles(z.decompress(y)))
            yield pd.Series(out)

    left = texts.select(F.col("doc").alias("a"), F.col("packed").alias("ta"))
    right = texts.select(F.col("doc").alias("b"), F.col("packed").alias("tb"))
    both = dealt_join(dealt_join(pairs, right, "b"), left, "a")
    return both.where(linked("a", "ta", "tb")).select("a", "b")


class _Forest:
    """Union-find over small integers."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        self.up[max(x, y)] = min(x, y)
        return x != y


def first_keys(same: np.ndarray) -> np.ndarray:
    """Number of the first key that two signatures share, by rows of symbol equality."""
    wrong = (~same).reshape(len(same), CHUNKS, _PER_CHUNK)
    errors = wrong.sum(axis=2)
    chunk = (errors <= 1).argmax(axis=1)
    rows = np.arange(len(same))
    return chunk * _PER_CHUNK + np.where(errors[rows, chunk] == 1, wrong[rows, chunk].argmax(axis=1), 0)


def _tiles(members: DataFrame, key: str, size: int) -> DataFrame:
    """``members`` with ``tile``, ``own``, ``mixed``: the members of a key dealt to parts, every two of which meet in a tile.

    Needs the member count ``n`` of the key; a key of up to ``size`` members is one tile.
    """
    parts = F.ceil(F.col("n") / size).cast("int")
    own = F.pmod(F.xxhash64("doc"), parts).cast("int")
    m = members.withColumns({"own": own, "other": F.explode(F.sequence(F.lit(0), parts - 1))})
    low, high = F.least("own", "other"), F.greatest("own", "other")
    return m.withColumns({"tile": F.xxhash64(key, low, high), "mixed": low != high}).drop("other", "n")


def _close(members: DataFrame, per_group: int = 50_000) -> DataFrame:
    """Links (a, b) that join all members of different components that share a key and are within DISTANCE by signature.

    Every close pair is looked at under the first key it shares; a group of
    tiles gives each member one link to the smallest member it reaches.
    """
    spread = members.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("n")).where("lo != hi")
    m = _tiles(dealt_join(members, spread.select("key", "n"), "key"), "key", TILE)
    m = m.select("tile", "number", "doc", "comp", "own", "mixed", "sig")
    groups = max(1, -(-m.count() // per_group))

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["tile", "doc"], kind="stable")
        tile, doc, comp, own, mixed, number = (pdf[c].to_numpy() for c in ("tile", "doc", "comp", "own", "mixed", "number"))
        sig = np.frombuffer(b"".join(pdf["sig"]), np.uint16).reshape(-1, SYMBOLS)
        names, at = np.unique(doc, return_inverse=True)
        forest, touched = _Forest(len(names)), np.zeros(len(names), bool)
        cuts = np.flatnonzero(np.r_[True, tile[1:] != tile[:-1], True])
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            for i in range(lo, hi - 1):
                ok = comp[i + 1 : hi] != comp[i]
                if mixed[i]:
                    ok &= own[i + 1 : hi] != own[i]
                j = np.flatnonzero(ok) + i + 1
                if len(j):
                    same = sig[j] == sig[i]
                    near = SYMBOLS - same.sum(axis=1) <= DISTANCE
                    j, same = j[near], same[near]
                if len(j):
                    j = j[first_keys(same) == number[i]]
                for k in j.tolist():
                    forest.join(int(at[i]), int(at[k]))
                    touched[at[i]] = touched[at[k]] = True
        found = [(names[forest.root(x)], names[x]) for x in np.flatnonzero(touched).tolist()]
        return pd.DataFrame(found, columns=["a", "b"])

    grouped = m.withColumn("g", F.pmod("tile", F.lit(groups)).cast("int")).groupBy("g")
    return grouped.applyInPandas(compare, "a long, b long").distinct()


def confirmed(sets: list[np.ndarray], comp: list[int], own: list[int] | None) -> list[tuple[int, int]]:
    """Pairs of set numbers that, with the given components, connect all that are similar enough; no pair that others connect.

    ``own``: part of every set, where only sets of different parts are compared.
    """
    n = len(sets)
    size = np.array([len(s) for s in sets], np.int64)
    flat = np.concatenate(sets)
    who = np.repeat(np.arange(n), size)
    order = np.argsort(flat, kind="stable")
    flat, who = flat[order], who[order]
    cuts = np.flatnonzero(np.r_[True, flat[1:] != flat[:-1], True])
    both = np.zeros((n, n), np.int32)
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        if b - a > 1:
            both[np.ix_(who[a:b], who[a:b])] += 1
    good = (both > 0) & (OF * both >= SIMILAR * (size[:, None] + size[None, :] - both))
    forest, first = _Forest(n), {}
    for i, c in enumerate(comp):
        forest.join(first.setdefault(c, i), i)
    out = []
    for i, j in zip(*np.nonzero(np.triu(good, 1))):
        if (own is None or own[i] != own[j]) and forest.join(int(i), int(j)):
            out.append((int(i), int(j)))
    return out


def _confirm_clusters(clusters: DataFrame, comps: DataFrame, texts: DataFrame, per_group: int = 4 * TILE) -> DataFrame:
    """Confirmed links (a, b) between different components inside clusters (doc, cluster), on full sets, tile by tile."""
    counts = clusters.groupBy("cluster").agg(F.count("*").alias("n"))
    m = dealt_join(dealt_join(clusters, counts, "cluster"), comps.withColumnRenamed("id", "doc"), "doc", "left")
    m = m.withColumn("comp", F.coalesce("component", "doc")).drop("component")
    m = dealt_join(_tiles(m, "cluster", TILE // 2), texts, "doc")
    groups = max(1, -(-clusters.count() // per_group))

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        z, found = zstandard.ZstdDecompressor(), []
        for _, part in pdf.groupby("tile"):
            if part["comp"].nunique() > 1:
                sets = [text_shingles(z.decompress(t)) for t in part["packed"]]
                own = part["own"].tolist() if part["mixed"].iat[0] else None
                doc = part["doc"].tolist()
                found += [(doc[i], doc[j]) for i, j in confirmed(sets, part["comp"].tolist(), own)]
        return pd.DataFrame(found, columns=["a", "b"])

    return m.withColumn("g", F.pmod("tile", F.lit(groups)).cast("int")).groupBy("g").applyInPandas(compare, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every document."""
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    source = source.withColumn("text_hash", F.xxhash64("text"))
    signed = _stored(_signed(source), "signatures")
    by_set = signed.where("n_shingles > 0").groupBy("h1", "h2", "n_shingles")
    # One row of each class stands for it; ``rep`` numbers the classes.
    lead = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")).alias("lead")
    reps = by_set.agg(lead, F.min("sig").alias("sig")).select(
        "h1", "h2", "n_shingles", F.col("lead.doc_id").alias("doc_id"), F.col("lead.text_hash").alias("text_hash"), "sig"
    )
    reps = _stored(reps.withColumn("rep", F.monotonically_increasing_id()), "classes")

    keys = _keys(reps)
    shared = keys.groupBy("key").agg(F.count("*").alias("n"), F.min("doc").alias("leader")).where("n > 1")
    members = _stored(dealt_join(keys, shared.select("key", "leader"), "key"), "members")
    sigs = reps.select(F.col("rep").alias("doc"), "sig")

    asked = members.where("doc != leader").select("doc", "leader").distinct()
    asked = dealt_join(dealt_join(asked, sigs, "doc"), sigs.select(F.col("doc").alias("leader"), F.col("sig").alias("l_sig")), "leader")
    near = asked.withColumn("d", _distance("sig", "l_sig")).where(F.col("d") <= DISTANCE)
    first = near.groupBy("doc").agg(F.min(F.struct("d", "leader")).alias("x")).select(F.col("x.leader").alias("a"), F.col("doc").alias("b"))
    first = _stored(first, "first-pairs")

    @F.pandas_udf("binary")
    def pack(s: pd.Series) -> pd.Series:
        z = zstandard.ZstdCompressor(level=1)
        return pd.Series([z.compress(utf8(t)) for t in s])

    named = reps.select(F.col("rep").alias("doc"), F.col("doc_id").alias("w_id"), F.col("text_hash").alias("w_hash"))
    wanted = dealt_join(members.select("doc").distinct(), named, "doc")
    # Rows without an id are found by their text alone.
    own = F.coalesce("doc_id", F.lit(0)).alias("at_id")
    texts = source.select(own, F.col("doc_id").isNull().alias("no_id"), "text_hash", pack("text").alias("packed"))
    wanted = wanted.select("doc", F.coalesce("w_id", F.lit(0)).alias("at_id"), F.col("w_id").isNull().alias("no_id"), F.col("w_hash").alias("text_hash"))
    texts = dealt_join(texts, wanted, ["at_id", "no_id", "text_hash"]).dropDuplicates(["doc"]).select("doc", "packed")
    texts = _stored(texts, "candidate-texts")

    links = _stored(_confirm(first, texts), "first-links")
    comps = components(links)
    placed = dealt_join(members.select("key", "number", "doc"), comps.withColumnRenamed("id", "doc"), "doc", "left")
    placed = dealt_join(placed.select("key", "number", "doc", F.coalesce("component", "doc").alias("comp")), sigs, "doc")
    reach = components(_stored(_close(placed), "close"))
    clusters = reach.unionByName(reach.select(F.col("component").alias("id"), "component").distinct())
    clusters = clusters.select(F.col("id").alias("doc"), F.col("component").alias("cluster"))
    more = _stored(_confirm_clusters(clusters, comps, texts), "second-links")
    comps = components(links.unionByName(more))

    classes = dealt_join(reps.select("h1", "h2", "n_shingles", "rep", "doc_id"), comps.withColumnRenamed("id", "rep"), "rep", "left")
    classes = _stored(classes.select("h1", "h2", "n_shingles", F.coalesce("component", "rep").alias("component"), "doc_id"), "class-components")
    # The class's row has its smallest id, if it has any.
    least = classes.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    classes = dealt_join(classes.drop("doc_id"), least, "component").drop("component")
    out = dealt_join(signed.select("doc_id", "n_shingles", "h1", "h2"), classes, ["h1", "h2", "n_shingles"], "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"))


def keep_one_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of every component, that of its smallest id; rows are compared by a key of their own.

    Of rows that repeat this id the first is kept, and a row without an id only where its component has none with one.
    """
    keyed = with_row_key(docs, "near-rows")
    ids = keyed.select(F.col(ROW_KEY).alias("doc_id"), F.col(id_col).cast("long").alias("own_id"))
    near = near_duplicates(keyed, ROW_KEY, text_col).select("doc_id", "component_id")
    # One row per component, combined before the shuffle; documents meet it by their row keys, which differ.
    best = F.min(F.struct(F.col("own_id").isNull(), "own_id", "doc_id"))["doc_id"].alias(ROW_KEY)
    kept = dealt_join(near, ids, "doc_id").groupBy("component_id").agg(best).select(ROW_KEY)
    return dealt_join(keyed, kept, ROW_KEY, "left_semi").drop(ROW_KEY)


def op8_near_duplicates(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


OP8_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS ws
  FROM documents),
sh AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' '))
                                      WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS s
  FROM w),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS both_ FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * both_ >= 75 * (x.n + y.n - both_)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(doc_id, r) AS (
  SELECT doc_id, doc_id FROM w
  UNION
  SELECT l.a, reach.r FROM reach JOIN both_ways l ON l.b = reach.doc_id),
c AS (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id)
SELECT w.doc_id::BIGINT AS doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id::BIGINT AS component_id,
       w.doc_id = c.component_id AS kept
FROM w JOIN c ON c.doc_id = w.doc_id LEFT JOIN n ON n.doc_id = w.doc_id
"""
