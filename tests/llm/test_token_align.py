"""Token alignment against a direct statement of its rules."""

import hashlib
import random
import unicodedata
from collections import Counter, defaultdict

import pytest
import sentencepiece
from tokenizers import Tokenizer

from tabsieve.llm import token_align as T

WORDS = ["the", "tokenization", "of", "unbelievable", "naïve", "日本語", "x=1;", "\n\n", "  ", "<|endoftext|>", "<s>", "\t", "3.14159", "ﬁne", "Ünïcödé", "\r\n",
         "don't", "HELLO", "a" * 40, "▁", "<0x41>", "🙂"]


@pytest.fixture(scope="module")
def pair():
    a = Tokenizer.from_file(T.TOKENIZER_A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=T.TOKENIZER_B)


def tokens(text, pair):
    """(id, start, end) of both lists, or two empty ones."""
    if not text:
        return [], []
    a, b = pair
    byte = T._byte_alphabet()
    out = []
    spelt_a = [(i, bytes(byte[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
    spelt_b = []
    for i in b.encode(text):
        p = b.id_to_piece(i)
        spelt_b.append((i, bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()))
    for spelt in (spelt_a, spelt_b):
        if b"".join(s for _, s in spelt) != (" " + text).encode():
            return [], []
        at, row = 0, []
        for i, s in spelt:
            row.append((i, at, at + len(s)))
            at += len(s)
        out.append(row)
    return out


def direct(rows, pair):
    both = [(d, *tokens(t, pair)) for d, t in rows]
    links = [[(x, y) for x, i, j in a for y, k, m in b if i < m and k < j] for _, a, b in both]
    count = Counter(p for one in links for p in one)
    best = defaultdict(int)
    for (_, y), n in count.items():
        best[y] = max(best[y], n)
    out = []
    for (d, a, b), own in zip(both, links):
        ends = sorted({j for _, _, j in a} & {j for _, _, j in b})
        groups = [",".join(str(x) for x, _, j in a if lo < j <= hi) + "|" + ",".join(str(y) for y, _, j in b if lo < j <= hi)
                  for lo, hi in zip([0, *ends], ends)]
        text = ";".join(groups)
        out.append((d, len(a), len(b), len(groups), len(own), sum(count[p] == best[p[1]] for p in own), sum(count[p] for p in own),
                    hashlib.sha256(text.encode()).hexdigest() if text else "", text))
    return sorted(out, key=repr)


def found(df, **options):
    return sorted((tuple(r) for r in T.align(df, groups=True, **options).collect()), key=repr)


def test_small_corpus(make_docs, pair):
    rng = random.Random(7)
    rows = [(i, " ".join(rng.choice(WORDS[:-3] if i % 3 else WORDS) for _ in range(rng.randrange(1, 30)))) for i in range(150)]
    rows += [(None, "the end"), (None, None), (3, "again the"), (3, "again the"), (501, ""), (502, " "), (503, "\n"), (504, "b" * 3000), (505, "é" * 500 + " x")]
    rows += [(600 + i, rows[0][1]) for i in range(60)]
    want = direct(rows, pair)
    assert any(r[1] == 0 for r in want) and any(r[3] < r[1] for r in want)
    assert found(make_docs(rows)) == want
    assert found(make_docs(rows), block_bytes=200) == want        # many blocks, some of one document


def test_ranked_merges_give_the_ids_of_the_tokenizer_file(pair, sf_rows):
    t = T.Tokenizers(*T.read_files(T.TOKENIZER_A, T.TOKENIZER_B))
    assert t.ranked
    texts = [b.decode() for b in t.a_bytes if not any(c > 127 for c in b)]        # every ASCII token by itself
    chars = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and unicodedata.category(chr(c)) not in ("Cn", "Co")]
    texts += ["".join(f"a{c}1 {c}b {c}{c}" for c in chars[i:i + 50]) for i in range(0, len(chars), 50)]
    rng = random.Random(8)
    texts += ["".join(rng.choice("aB's tre\n\r\t  é日🙂.,1\u0301\xa0\u2028") for _ in range(rng.randrange(60))) for _ in range(3000)]
    texts += [r[1] for r in sf_rows[:300] if r[1]]
    for x, e in zip(texts, pair[0].encode_batch_fast(texts, add_special_tokens=False)):
        assert t.ranked.encode_ordinary(x) == e.ids


def test_empty_table(make_docs):
    assert found(make_docs([])) == [] and found(make_docs([(1, None)])) == [(1, 0, 0, 0, 0, 0, 0, "", "")]


def test_windows_are_cut_at_words_and_long_texts_are_linear(pair):
    files = T.read_files(T.TOKENIZER_A, T.TOKENIZER_B)
    t = T.Tokenizers(*files)
    (a, b), = t.encode(["the quick brown fox jumps"])
    cut_a, cut_b = T.anchors(a, b, t)
    assert len(cut_a) == len(cut_b) == 6
    for text in ("x" * 200_000, "word " * 60_000):
        block = T.Block(t, {})
        block.add(1, len(text), next(t.encode([text])))
        assert sum(block.n_a) > 1000


def test_whole_table(spark, sf, sf_rows, pair):
    rows = [(r[0], r[1]) for r in sf_rows]
    got = {r[0]: tuple(r)[:4] for r in T.align(spark.read.parquet(f"{sf}/documents.parquet")).collect()}
    assert len(got) == len(rows)
    for d, t in random.Random(1).sample(rows, 40):
        a, b = tokens(t, pair)
        ends = {j for _, _, j in a} & {j for _, _, j in b}
        assert got[d] == (d, len(a), len(b), len(ends))


def calls(run) -> int:
    """Python functions entered while ``run`` runs."""
    import sys

    n = 0

    def seen(frame, event, arg):
        nonlocal n
        n += event == "call"

    sys.setprofile(seen)
    try:
        run()
    finally:
        sys.setprofile(None)
    return n


def test_distinct_windows_of_a_block_are_aligned_together(pair):
    """A block's Python work does not grow with its distinct windows."""
    t = T.Tokenizers(*T.read_files(T.TOKENIZER_A, T.TOKENIZER_B))
    text = " ".join(f"wq{i}zo" for i in range(4000))
    tokens, = t.encode([text])

    def work():
        block = T.Block(t, {})
        block.add(1, len(text), tokens)
        assert len(T.unpack(block.row(0).column("n_links")[0].as_py(), "int64")) >= 4000

    assert calls(work) < 2000


def test_windows_of_a_block_by_the_rule(pair):
    """Groups, links and numbers of windows of all documents in one block,
    those without tokens between them."""
    t = T.Tokenizers(*T.read_files(T.TOKENIZER_A, T.TOKENIZER_B))
    rng = random.Random(5)
    texts = ["the end", None, "the end", "", " ", "▁", *[" ".join(rng.choices(WORDS, k=12)) for _ in range(40)], "x" * 300, "  a  b\n"]
    block = T.Block(t)
    for i, (text, tokens_) in enumerate(zip(texts, t.encode(texts))):
        block.add(i, len(text or ""), tokens_)
    row = {k: v[0].as_py() for k, v in zip(block.row(7).schema.names, block.row(7).columns)}
    n_windows, windows = T.unpack(row["n_windows"], "int64").tolist(), T.unpack(row["windows"], "int32").tolist()
    n_links, at, codes = T.unpack(row["n_links"], "int64").tolist(), T.unpack(row["links"], "int32").tolist(), T.unpack(row["codes"], "int64").tolist()
    names, n_groups = T.unpack(row["names"]).tobytes().decode().split("\n"), T.unpack(row["n_groups"], "int64").tolist()
    first = [sum(n_links[:w]) for w in range(len(n_links))]
    total, lo = Counter(), 0
    for want, n in zip([tokens(x, pair) for x in texts], n_windows):
        own, lo = windows[lo:lo + n], lo + n
        links = [(codes[k] >> 32, codes[k] & 0xFFFFFFFF) for w in own for k in at[first[w]:first[w] + n_links[w]]]
        a, b = want
        assert links == [(x, y) for x, i, j in a for y, k, m in b if i < m and k < j]
        ends = sorted({j for _, _, j in a} & {j for _, _, j in b})
        assert sum(n_groups[w] for w in own) == len(ends)
        assert ";".join(names[w] for w in own) == ";".join(
            ",".join(str(x) for x, _, j in a if p < j <= q) + "|" + ",".join(str(y) for y, _, j in b if p < j <= q) for p, q in zip([0, *ends], ends))
        total.update(links)
    assert dict(zip(codes, T.unpack(row["counts"], "int64").tolist())) == {x << 32 | y: n for (x, y), n in total.items()}
