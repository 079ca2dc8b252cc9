import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from phrasedex.llm import token_files as T
from phrasedex.llm.encoding import Encoder
from phrasedex.llm.token_counts import length_histogram, quantile_lengths, suffix_sums, token_lengths, totals_at
from phrasedex.session import shared_dir

ODD = ["a\x1cb !!'s I'm don't İstanbul é  x <|endoftext|>abc, 12ab ŒUVRE ß. ŉ ªº", "ΑΣ ΣΑΣ.", "", None, "é ́x", "w " * 3000, "z" * 9000]


@pytest.fixture(scope="module")
def tok():
    return Tokenizer.from_file(T.TOKENIZER)


def ids_of(tok, text):
    return tok.encode(text or "", add_special_tokens=False).ids


def test_encoder_equals_tokenizer(tok, small_docs):
    texts = [t or "" for t in [*ODD, *small_docs["text"]]]
    got = Encoder(T.TOKENIZER).encode(texts)
    assert [np.frombuffer(b, "<u4").tolist() for b in got] == [ids_of(tok, t) for t in texts]


def test_files_round_trip(spark, frame, tok, small_docs):
    rows = [(i, t) for i, t in zip(small_docs["doc_id"].tolist(), small_docs["text"])] + [(10_000 + i, t) for i, t in enumerate(ODD)]
    rows += [(10_000, ODD[0]), (None, "null id")]
    got = sorted(((-1 if r[0] is None else r[0]), *r[1:]) for r in map(tuple, T.token_file_digest(frame(rows)).collect()))
    start, want = 0, []
    for i, t in sorted(((-1 if i is None else i), t or "") for i, t in rows):
        ids = [*ids_of(tok, t), 1]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == sorted(want)


def test_only_wanted_frames_are_read_and_checksums_hold(spark, frame, tok, monkeypatch):
    path = shared_dir(spark, "files")
    manifest = T.write_token_files(frame([(i, f"text number {i}") for i in range(50)]), path, file_text_bytes=1 << 30)
    got = T.read_token_files(manifest, path, wanted=[7, 31]).collect()
    assert {r["doc_id"]: np.frombuffer(r["ids"], "<u4").tolist() for r in got} == {i: [*ids_of(tok, f"text number {i}"), 1] for i in (7, 31)}
    name = manifest.first()["file"]
    f = T.SeekableFile(f"{path}/{name}")
    assert f.doc_ids.tolist() == list(range(50)) and len(f.content(3)) == 2 * len([*ids_of(tok, "text number 3"), 1])
    f.entries[3, 2] ^= 1
    with pytest.raises(ValueError, match="checksum"):
        f.content(3)


def test_file_is_plain_zstandard(spark, frame):
    import zstandard

    path = shared_dir(spark, "files")
    T.write_token_files(frame([(1, "a b"), (2, "c")]), path, file_text_bytes=1 << 30)
    fs, folder = T._filesystem(path)
    raw = fs.open_input_file(f"{folder}/tokens-00000000.zst").read()
    out, d = b"", zstandard.ZstdDecompressor()
    while raw:
        if 0x184D2A50 <= int.from_bytes(raw[:4], "little") <= 0x184D2A5F:
            raw = raw[8 + int.from_bytes(raw[4:8], "little") :]
            continue
        o = d.decompressobj()
        out += o.decompress(raw)
        raw = o.unused_data
    assert len(out) % 2 == 0 and np.frombuffer(out, "<u2").tolist().count(1) >= 2


def test_empty_table(spark, frame):
    assert T.token_file_digest(frame([])).collect() == []
    assert suffix_sums(length_histogram(token_lengths(frame([])))).collect() == []


def test_counts_equal_brute_force(frame, tok, small_docs):
    texts = [*small_docs["text"], *ODD]
    sums = suffix_sums(length_histogram(token_lengths(frame(list(enumerate(texts)))))).cache()
    n = np.array([len(ids_of(tok, t)) for t in texts])
    for r in sums.collect():
        at = r["n_tokens"]
        assert r["docs"] == (n == at).sum() and r["docs_longer"] == (n > at).sum()
        assert r["tokens_longer"] == n[n > at].sum() and r["tokens_total"] == n.sum()
        assert r["tokens_kept"] == np.minimum(n, at).sum() and r["tokens_cut"] == n.sum() - r["tokens_kept"]
        assert r["quantile_to"] == (n <= at).mean()
    limits = [0, 1, 100, 512, 10**6]
    for r in totals_at(sums, limits).collect():
        assert r["tokens_kept"] == np.minimum(n, r["context_limit"]).sum() and r["docs_longer"] == (n > r["context_limit"]).sum()
    for r in quantile_lengths(sums, [0.1, 0.5, 0.99]).collect():
        assert r["n_tokens"] == sorted(n)[int(np.ceil(r["share"] * len(n))) - 1]
