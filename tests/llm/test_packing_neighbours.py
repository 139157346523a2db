import random

import numpy as np

from twinscan.llm import tokens
from twinscan.llm.packing import Index, fill


def packed(docs, sizes, capacity):
    terms = [np.array(sorted(d), np.uint32) for d in docs]
    index = Index(terms, [np.ones(len(t), np.uint32) for t in terms], np.array([len(d) for d in docs], float))
    return [m for m, _ in fill(np.array(sizes), index, capacity)]


def test_neighbours_fill_the_window_before_unrelated_documents():
    docs = [{1, 2, 3}] + [{1, 100 + i} for i in range(200)] + [{50, 51, 1000 + i} for i in range(200)]
    out = packed(docs, [100] + [1] * 200 + [2] * 200, 300)
    assert out[0][0] == 0 and sorted(out[0][1:]) == list(range(1, 201))
    assert sorted(i for c in out for i in c) == list(range(401))


def test_every_shared_word_of_the_seed_is_looked_up():
    rare = [{i, 500 + i} for i in range(1, 21)]  # the seed's 20 rarest words, each in one large document
    common = [{30, 600 + i} for i in range(30)]
    other = [{40, 700 + i} for i in range(30)]
    docs = [{*range(1, 21), 30}] + rare + common + other
    out = packed(docs, [50] + [49] * 20 + [1] * 30 + [2] * 30, 80)
    assert out[0][0] == 0 and sorted(out[0][1:]) == list(range(21, 51))


def test_scores_of_open_documents_are_those_of_all():
    rng = np.random.default_rng(3)
    terms = [np.unique(rng.zipf(1.3, 60) % 500).astype(np.uint32) for _ in range(300)]
    index = Index(terms, [rng.integers(1, 9, len(t)).astype(np.uint32) for t in terms], rng.integers(50, 90, 300).astype(float))
    everything = np.arange(300)
    kept = rng.random(300) < 0.5
    part = index.only(kept)
    assert part.doc.size < index.doc.size
    for i in range(0, 300, 7):
        whole = index.scores(i, everything)
        for open_ in (everything[rng.random(300) < 0.9], everything[rng.random(300) < 0.02], everything[:0]):
            want = np.zeros(300)
            want[open_] = whole[open_]
            assert (index.scores(i, open_) == want).all()
        assert (part.scores(i, np.flatnonzero(kept)) == np.where(kept, whole, 0)).all()


def test_tokens_counted_by_pieces_are_those_of_the_tokenizer():
    rng = random.Random(5)
    letters = [chr(p) for p in tokens._SETTLED] + list(" \n\t\r'sdlvretm  09az") * 60
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 40))) for _ in range(3000)]
    texts += ["", " ", "a  b", "a\n\n b\r\n\r\n", "it's 10 00:01", "日本 語", "x͸\U0001f600 y", "<|endoftext|>"]
    encode = tokens.encoding(tokens.VOCABULARY).encode_ordinary
    assert [tokens.token_count(t) for t in texts] == [len(encode(t)) for t in texts]
    assert tokens._counts(tokens.VOCABULARY)
