import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from billweave.llm import ppm
from helpers import LONG, documents, prose, rng


def brute_force(texts, held_out, order=ppm.ORDER):
    """Scores with plain dictionaries, byte by byte."""
    words = [ppm.tokens(t) for t in texts]
    train = [w for w, out in zip(words, held_out) if not out]
    counts = Counter(x for w in train for x in [*w, ppm.END_TOKEN])
    total, distinct = sum(counts.values()), len(counts)
    trie = [{} for _ in range(order + 1)]
    start = bytes([ppm.START]) * order

    def spelled(w):
        return start + b" ".join(w) + bytes([ppm.END])

    for w in train:
        text = spelled(w)
        for at in range(order, len(text)):
            trie[order].setdefault(text[at - order:at], Counter())[text[at]] += 1
    for k in range(order - 1, 0, -1):
        for context, seen in trie[k + 1].items():
            trie[k].setdefault(context[1:], Counter()).update(seen.keys())

    def log_p(context, symbol):
        value, excluded = 0.0, set()
        for k in range(order, 0, -1):
            seen = trie[k].get(context[order - k:])
            if not seen:
                continue
            left = {s: n for s, n in seen.items() if s not in excluded}
            n, q = sum(left.values()), len(left)
            if n and symbol in left:
                return value + math.log10((left[symbol] - ppm.DISCOUNT) / n)
            value += math.log10(ppm.DISCOUNT * q / n) if n else 0.0
            excluded = set(seen)
        return value - math.log10(ppm.ALPHABET - len(excluded))

    rows = []
    for w in words:
        text, all_tokens = spelled(w), [*w, ppm.END_TOKEN]
        rows.append((len(all_tokens), sum(counts[x] > 0 for x in all_tokens), total,
                     sum(math.log10((counts[x] + 0.5) / (total + 0.5 * (distinct + 1))) for x in all_tokens),
                     sum(log_p(text[at - order:at], text[at]) for at in range(order, len(text)))))
    return rows, log_p


@pytest.mark.parametrize("block_bytes", [2000, ppm.BLOCK_BYTES])
def test_like_brute_force_however_texts_are_dealt(spark, block_bytes):
    r = rng()
    texts = [prose(r, r.randrange(1, 80)) for _ in range(40)] + [
        None, "", " \n\t", "ABC abc", "ABC abc", "été ñ 日本", "zzzzzzz", LONG[:5003]]
    docs = documents(spark, texts).withColumns({"score": F.lit("x"), "block": F.lit(1)})
    got = ppm.score_texts(docs, F.col("doc_id") % 5 == 1, block_bytes=block_bytes).orderBy("doc_id").collect()
    held = [i % 5 == 1 for i in range(1, len(texts) + 1)]
    expected, log_p = brute_force(texts, held)
    assert [g.held_out for g in got] == held
    for g, e in zip(got, expected, strict=True):
        assert (g.n_tokens, g.n_known, g.train_tokens) == e[:3]
        assert g.base_score == pytest.approx(e[3], rel=1e-12) and g.score == pytest.approx(e[4], rel=1e-9)
    context = b"w1 w2"
    assert sum(10 ** log_p(context, s) for s in range(256) if s != ppm.START) == pytest.approx(1)


def test_without_training_rows_and_without_rows(spark):
    got = ppm.score_texts(documents(spark, ["ab", None]), F.lit(True)).orderBy("doc_id").collect()
    assert [(g.n_known, g.train_tokens) for g in got] == [(0, 0), (0, 0)]
    assert got[1].score == pytest.approx(-math.log10(ppm.ALPHABET))
    assert ppm.score_texts(documents(spark, []), F.lit(False)).count() == 0
