import hashlib

import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lectern.llm import bpe, token_counts

PATH = P.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def own():
    return bpe.WordBPE(PATH)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text(library, own, text):
    want = library.encode(text, add_special_tokens=False).ids
    ids = own.encode(text)
    assert memoryview(ids).cast("I").tolist() == want
    assert own.decode(ids) == library.decode(want, skip_special_tokens=False)


@pytest.mark.parametrize(
    "text",
    ["", "<|startoftext|>hi <|endoftext|>x <|start", "ΣΑΣ İ ﬁ é", "x\x1cy\x85z q\x00", "don't I'LL we've ''", "ab" * 4000 + "q" * 3000, "日本語 123 👍🏽!!"],
)
def test_special_texts(library, own, text):
    assert memoryview(own.encode(text)).cast("I").tolist() == library.encode(text, add_special_tokens=False).ids


def test_fragments_end_only_where_no_token_spans(own):
    for word in ("internationalization", "xqzjkvw", "".join(own.letters[b] for b in "日本".encode())):
        parts = list(own.fragments(word))
        assert "".join(p for p, _ in parts) == word and [e for _, e in parts] == [False] * (len(parts) - 1) + [True]
        for (a, _), (b, _) in zip(parts, parts[1:]):
            assert not any(a[-1] + b[0] in t for t in own.ids)


def test_query_digests(library, docs, odd, empty):
    for df in (docs, odd("ids")):
        want = {}
        for r in df.collect():
            ids = library.encode(r["text"] or "", add_special_tokens=False).ids
            packed = b"".join(i.to_bytes(4, "little") for i in ids)
            said = library.decode(ids, skip_special_tokens=False).encode()
            want.setdefault(r["doc_id"], set()).add((len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256(said).hexdigest()))
        got = bpe.digests(df, PATH).collect()
        assert len(got) == df.count()
        assert all((r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) in want[r["doc_id"]] for r in got)
    assert bpe.digests(empty, PATH).count() == 0
    apart = bpe.decode(bpe.encode(docs, PATH), PATH).collect()
    together = {r["doc_id"]: r["decoded"] for r in bpe.encode(docs, PATH, decoded=True).collect()}
    assert all(r["decoded"] == together[r["doc_id"]] for r in apart)


def test_length_histogram(docs, odd, empty):
    import base64

    import tiktoken

    path = P.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    code = tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for df in (docs, odd("length")):
        n = [len(code.encode_ordinary(r["text"] or "")) for r in df.collect()]
        hist = token_counts.length_histogram(token_counts.token_lengths(df, path, P.PATTERN), block=64).cache()
        rows = {r["length"]: r for r in hist.collect()}
        assert sorted(rows) == sorted(set(n))
        for x, r in rows.items():
            assert r["n_docs"] == n.count(x) and r["docs_fit"] == sum(v <= x for v in n) and r["docs_longer"] == sum(v > x for v in n)
            assert r["tokens_fit"] == sum(v for v in n if v <= x) and r["tokens_kept"] == sum(min(v, x) for v in n)
            assert r["tokens_cut"] == sum(max(0, v - x) for v in n) and r["tokens_total"] == sum(n)
        for r in token_counts.answer(hist, [0, 17, 10**9]).collect():
            x = r["context_limit"]
            assert (r["docs_fit"], r["tokens_kept"], r["n_docs"]) == (sum(v <= x for v in n), sum(min(v, x) for v in n), len(n))
        hist.unpersist()
    assert token_counts.length_histogram(token_counts.token_lengths(empty, path, P.PATTERN)).count() == 0


def test_long_runs_of_one_character():
    """Runs that overflow the encoder's pattern count as its single piece; elsewhere the library's own count holds."""
    path = P.path("byte_bpe_50k.tiktoken")
    code = token_counts._encoding(path, P.PATTERN)
    for run in (" " * 20_000, "\n" * 9_000, " \n\t\u3000" * 2_000, "\x1c" * 5_000, "a" * 9_000):
        for text in (run, f"word{run}", f"{run}word", f"a,{run}b {run}\n{run}.", f"x{run}\x1cy"):
            assert token_counts.encoded_length(code, text) == len(code.encode_ordinary(text))
    assert token_counts.encoded_length(code, " " * 1_000_000) == 1_000_000
    assert token_counts.encoded_length(code, "a" * 2_000_000 + " " * 2_000_000 + "b") > 2_000_000


def test_answer_of_an_empty_histogram(empty):
    path = P.path("byte_bpe_50k.tiktoken")
    hist = token_counts.length_histogram(token_counts.token_lengths(empty, path, P.PATTERN))
    assert [tuple(r) for r in token_counts.answer(hist, [5, 5]).collect()] == [(5, 0, 0, 0, 0)]
    assert token_counts.answer(hist, []).count() == 0
