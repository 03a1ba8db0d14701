import random

import public_tokenizers
from tokenizers import Tokenizer

from framewright.llm import token_counts

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_splicing_counts_as_the_whole_text():
    tok, rng = token_counts.tokenizer(PATH), random.Random(1)
    for _ in range(60):
        letters = [*rng.choice(["ab ", "a b\n\t<|endoftext|>", "it's we'll   é漢字  12 "]), "<|endoftext|>", "hello", " ", "  ", "\n\n"]
        text = "".join(rng.choice(letters) for _ in range(rng.randrange(600)))
        for chunk, overlap in ((50, 10), (64, 3), (200, 20)):
            assert token_counts.count_long(tok, text, chunk, overlap)[0] == len(tok.encode(text, add_special_tokens=False))
    count, widened = token_counts.count_long(tok, "ab" * 300, 50, 10)
    assert count == len(tok.encode("ab" * 300, add_special_tokens=False)) and widened


def test_edges(edge_docs, edge_rows, no_docs):
    tok = Tokenizer.from_file(PATH)
    want = sorted((-1 if d is None else d, len((t or "").encode()), n := len(tok.encode(t or "", add_special_tokens=False)), n > 512) for d, t in edge_rows)
    for chunk in (1 << 15, 300):
        got = token_counts.count_tokens(edge_docs, PATH, chunk_chars=chunk, overlap_chars=40).fillna(-1, "doc_id").collect()
        assert sorted((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in got) == want
    assert token_counts.count_tokens(no_docs, PATH).collect() == []
