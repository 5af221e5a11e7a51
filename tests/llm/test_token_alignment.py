import bisect
import hashlib
from collections import Counter

import numpy as np
import pytest
import public_tokenizers
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from billweave.llm import queries
from billweave.llm import token_alignment as t
from helpers import LONG, documents, prose, rng

COLUMNS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def dense(m, columns):
    out = np.zeros((len(m.indptr) - 1, columns), int)
    for row in range(len(out)):
        for k in range(m.indptr[row], m.indptr[row + 1]):
            out[row, m.indices[k]] += m.data[k]
    return out


def test_product_like_dense_matrices():
    r = np.random.default_rng(2)
    for rows, inner, columns in ((5, 7, 4), (1, 1, 1), (20, 9, 30), (3, 0, 2), (0, 3, 3)):
        a, b = r.integers(0, 3, (rows, inner)), r.integers(0, 3, (inner, columns))

        def csr(m):
            at = np.nonzero(m)
            return t.Csr(np.concatenate([[0], np.cumsum((m != 0).sum(1))]), at[1].astype(np.int32), m[at])
        for entries in (1, 10, 10_000):
            c = t.product(csr(a), csr(b), entries)
            assert (dense(c, columns) == a @ b).all()
            assert all((np.diff(c.indices[x:y]) > 0).all() for x, y in zip(c.indptr, c.indptr[1:]))
        assert (dense(t.transposed(csr(a), inner), rows) == a.T).all()


class Plain:
    """Alignment token by token, with the tokenizers as the contract names them."""

    def __init__(self):
        self.a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in shown]
        self.byte = {chr(b): b for b in shown} | {chr(256 + n): b for n, b in enumerate(rest)}

    def a_bytes(self, n):
        return bytes(self.byte[c] for c in self.a.id_to_token(n))

    def b_bytes(self, n):
        piece = self.b.id_to_piece(n)
        return bytes([int(piece[3:5], 16)]) if self.b.is_byte(n) else piece.replace("▁", " ").encode()

    def tokens(self, text):
        """[(id, start, end)] of A and B."""
        if not text:
            return [], []
        out = []
        for ids, of in ((self.a.encode(" " + text, add_special_tokens=False).ids, self.a_bytes),
                        (self.b.encode(text), self.b_bytes)):
            at, spans = 0, []
            for n in ids:
                spans.append((n, at, at + len(of(n))))
                at = spans[-1][2]
            if b"".join(of(n) for n in ids) != b" " + text.encode():
                return [], []
            out.append(spans)
        return out

    def rows(self, docs):
        split = [(i, *self.tokens(text)) for i, text in docs]
        links = []
        for _, a, b in split:
            mine, first = [], 0
            for x, s, e in a:
                while first < len(b) and b[first][2] <= s:
                    first += 1
                n = first
                while n < len(b) and b[n][1] < e:
                    mine.append((x, b[n][0]))
                    n += 1
            links.append(mine)
        count = Counter(p for mine in links for p in mine)
        top = {}
        for (_, y), n in count.items():
            top[y] = max(top.get(y, 0), n)
        out = []
        for (i, a, b), mine in zip(split, links):
            ends = sorted({e for _, _, e in a} & {e for _, _, e in b})
            groups = [([], []) for _ in ends]
            for k, side in enumerate((a, b)):
                for n, s, _ in side:
                    groups[bisect.bisect_right(ends, s)][k].append(str(n))
            text = ";".join("|".join(map(",".join, g)) for g in groups)
            out.append((i, len(a), len(b), len(ends), len(mine), sum(count[p] == top[p[1]] for p in mine),
                        sum(count[p] for p in mine), hashlib.sha256(text.encode()).hexdigest() if text else ""))
        return sorted(out, key=repr)


def found(df):
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=repr)


ODD = [None, "", " ", "  two  blanks ", "\n\n\t x", "<|endoftext|> <s> </s> <unk> <0x41>", "naïve café — “quotes” ﬁ Ⅷ",
       "日本語のテキスト 한국어 русский", "😀👩‍👩‍👧 flags 🇩🇪", "a▁b", "▁", "nul \x00 \x01", "é ä ­ soft",
       "same", "same", "1234567890" * 8, "x" * 300, " " * 70, "tab\tand\r\nlines  nbsp", "A" * 5 + "ß" * 9]


@pytest.mark.parametrize("block_bytes", [t.BLOCK_BYTES, 500])
def test_like_token_by_token(spark, block_bytes):
    r = rng()
    texts = ODD + [prose(r, r.randrange(1, 60)) + r.choice([".", " Über, ", "\n"]) for _ in range(60)]
    docs = documents(spark, texts).withColumns({"n_a": F.lit("x"), "block": F.lit(1)})
    got = t.align(docs.repartition(3), queries.ALIGNED, block_bytes=block_bytes)
    assert found(got) == Plain().rows(list(enumerate(texts, 1)))


def test_shared_groups_are_counted(spark):
    plain, text = Plain(), "日本語 naïve 😀 words"
    a, b = plain.tokens(text)
    ends = sorted({e for *_, e in a} & {e for *_, e in b})
    group = lambda e: sum(x < e for x in ends)
    expected = sum(group(x[2]) == group(y[2]) for x in a for y in b)
    row = t.align(documents(spark, [text]), queries.ALIGNED).first()
    assert row.n_group_links == expected >= row.n_links


def test_values_of_links():
    both = t.tokenizers(*queries.ALIGNED)
    got = t.align_texts(["hello wörld", None, "x"], both)
    assert got.shared.sum() == len(" hello wörld".encode()) + 2 and got.n_links.sum() == len(got.links)


def test_ids_repeat_or_miss_long_and_empty(spark):
    rows = [(None, "one text"), (7, "one text"), (7, "other"), (7, "other"), (8, LONG)]
    docs = spark.createDataFrame(rows, "doc_id int, text string")
    got = t.align(docs, queries.ALIGNED)
    assert found(got) == Plain().rows(rows) and got.schema["doc_id"].dataType.simpleString() == "int"
    assert t.align(documents(spark, []), queries.ALIGNED).count() == 0
    assert found(t.align(documents(spark, [None]), queries.ALIGNED)) == [(1, 0, 0, 0, 0, 0, 0, "")]
    with pytest.raises(TypeError):
        t.align(docs.withColumn("doc_id", F.lit("a")), queries.ALIGNED)
