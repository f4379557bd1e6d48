"""Tokenizer alignment against a direct walk over the libraries' own tokens."""

import hashlib
import random
import time
from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tests.llm.test_operators import make, prose, stored
from tidewell.llm import alignment
from tidewell.llm.tokens import vocabulary_path

A, B = vocabulary_path(), vocabulary_path("piece_bpe_32k.model")
COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def brute_groups(a, b):
    """(groups as pairs of id lists, links) of two lists of (id, end)."""
    groups, links, i, j, ga, gb = [], [], 0, 0, [], []
    while i < len(a) and j < len(b):
        if not ga or ga[-1] is not a[i]:
            ga.append(a[i])
        if not gb or gb[-1] is not b[j]:
            gb.append(b[j])
        links.append((a[i][0], b[j][0]))
        here, there = a[i][1], b[j][1]
        if here == there:
            groups.append(([x[0] for x in ga], [x[0] for x in gb]))
            ga, gb = [], []
        i, j = i + (here <= there), j + (there <= here)
    return groups, links


def ends(ids, bytes_of):
    return [(k, e) for k, e in zip(ids, np.cumsum([len(bytes_of(k)) for k in ids]).tolist())]


def brute(texts):
    tk, sp = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    tk.encode_special_tokens = True
    letters = {c: b for b, c in alignment.byte_letters().items()}
    a_bytes = {k: bytes(letters[c] for c in w) if all(c in letters for c in w) else w.encode() for w, k in tk.get_vocab().items()}
    b_bytes = lambda k: bytes([int(sp.id_to_piece(k)[3:5], 16)]) if sp.is_byte(k) else sp.id_to_piece(k).replace("▁", " ").encode()
    found, counts = [], Counter()
    for t in texts:
        a, b, whole = tk.encode(" " + (t or ""), add_special_tokens=False).ids, sp.encode(t or ""), (" " + (t or "")).encode()
        if not t or b"".join(a_bytes[k] for k in a) != whole or b"".join(map(b_bytes, b)) != whole:
            found.append(None)
            continue
        groups, links = brute_groups(ends(a, a_bytes.get), ends(b, b_bytes))
        counts.update(links)
        digest = hashlib.sha256(";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups).encode()).hexdigest()
        found.append((len(a), len(b), len(groups), links, digest))
    top = defaultdict(int)
    for (_, b), n in counts.items():
        top[b] = max(top[b], n)
    return [(0, 0, 0, 0, 0, 0, "") if x is None else (*x[:3], len(x[3]), sum(counts[p] == top[p[1]] for p in x[3]), sum(counts[p] for p in x[3]), x[4]) for x in found]


def test_walk_equals_the_overlap_of_all_pairs():
    rng = random.Random(5)
    for _ in range(400):
        n, p = rng.choice([1, 2, 5, 40, 300]), rng.choice([0.1, 0.5, 0.9, 1])
        a = sorted({*[e for e in range(1, n) if rng.random() < p], n})
        b = a if rng.random() < 0.2 else sorted({*[e for e in range(1, n) if rng.random() < rng.choice([p, 0.7])], n})
        group_a, group_b, link_a, link_b = alignment.align(np.array(a), np.array(b))
        common = [0, *sorted(set(a) & set(b))][:-1]
        assert group_a.tolist() == [a.index(c) + 1 if c else 0 for c in common]
        assert group_b.tolist() == [b.index(c) + 1 if c else 0 for c in common]
        starts = lambda x: [0, *x[:-1]]
        assert list(zip(link_a.tolist(), link_b.tolist())) == [
            (i, j) for i, (s, e) in enumerate(zip(starts(a), a)) for j, (u, v) in enumerate(zip(starts(b), b)) if max(s, u) < min(e, v)
        ]


def test_long_one_to_one_stretches_take_few_comparisons():
    a = np.arange(1, 1_000_001)
    start = time.process_time()
    assert alignment.diagonal_walk(a, a) == bytes([alignment.BOTH]) * 1_000_000
    assert time.process_time() - start < 1


TEXTS = [
    None, "", " ", "\n", "one", "one", "  two  blanks \n\n x \t y ", "a<|endoftext|>b <s> </s> <unk> <0x41>", "▁x", "a▁b", "日本語 ütf 🙂 don't I'll", "\x00 nul", "x" * 5000,
    "Été ß ñandú ☃ é ﬁ", "1,000.50 (a+b)=c; http://a.b/c?d=1", " non breaking wide ",
]


def test_alignment_of_texts(spark, tmp_path_factory, monkeypatch):
    rng = random.Random(3)
    texts = [*TEXTS, *[prose(rng, n) for n in (3, 60, 60, 900)], prose(rng, 60) * 2]
    docs = stored(make(spark, texts), tmp_path_factory)
    got = alignment.align_tokenizers(docs, A, B).collect()
    assert {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in got} == dict(enumerate(brute(texts)))
    # The counts do not depend on how texts are put together.
    monkeypatch.setattr(alignment, "AT_ONCE", 100)
    split = alignment.Aligner(A, B)
    whole = split(["x y", "", "", "x y"])
    assert whole["n_a"].tolist()[1:3] == [0, 0] and whole["groups_sha256"][0] == whole["groups_sha256"][3] != ""


def test_repeated_null_ids_and_no_rows(spark, tmp_path_factory):
    docs = stored(make(spark, ["one two", "one two", None, "three"], [7, 7, None, None]), tmp_path_factory)
    got = alignment.align_tokenizers(docs, A, B).collect()
    want = brute(["one two", "one two", None, "three"])
    assert sorted((r["doc_id"] or -1, *[r[c] for c in COLUMNS]) for r in got) == sorted(zip([7, 7, -1, -1], *zip(*want)))
    assert alignment.align_tokenizers(stored(make(spark, []), tmp_path_factory), A, B).collect() == []


@pytest.mark.parametrize("n", [1, 50])
def test_portions_cover_all_texts(n, monkeypatch):
    monkeypatch.setattr(alignment, "AT_ONCE", 10)
    sizes = [random.Random(n).randrange(15) for _ in range(n)]
    found = list(alignment.portions(sizes))
    assert [k for s, e in found for k in range(s, e)] == list(range(n))
