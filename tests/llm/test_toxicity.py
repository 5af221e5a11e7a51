import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from billweave.llm import toxicity as t
from helpers import LONG, documents, prose, rng


@pytest.fixture(scope="module")
def restorer():
    words = "idiot stupid moron pathetic loser you are an the house of reading late tomorrow " * 50
    return t.Restorer(t.trigram_counts([words]))


@pytest.mark.parametrize("given, read", [
    ("you 1d10t", "you idiot"), ("st*pid", "stupid"), ("i d i o t", "idiot"), ("l.o.s.e.r!", "loser!"),
    ("stuuupid", "stupid"), ("$tup1d", "stupid"), ("p4th3tic", "pathetic"), ("Plain words, stay", "plain words, stay"),
    ("stupid$$$ house!!", "stupid$$$ house!!"), ("in 2023", "in 2023"), ("", ""), (None, "")])
def test_disguised_words_are_restored(restorer, given, read):
    assert restorer.restored(given) == read


@pytest.mark.parametrize("given, read", [
    ("a m o r o n", "a moron"), ("y o u i d i o t", "you idiot"), ("i d.i-o t", "idiot"), ("i_d * i  o.t", "idiot"),
    ("id iot", "idiot"), ("mor on", "moron"), ("st-upid", "stupid"), ("a$$", "ass"), ("@$$", "ass"), ("a55 a", "ass a"),
    ("y.o.u a r e s t u p i d p a t h e t i c l o s e r", "you are stupid pathetic loser"),
    (" ".join("stupid" * 40), "stupid " * 39 + "stupid"), ("you are an idiot", "you are an idiot"),
    ("a house of reading. late tomorrow", "a house of reading. late tomorrow"), ("$50", "$50"), ("x", "x"), (" - ", " - ")])
def test_separators_and_last_marks_are_decoded(given, read):
    words = "idiot stupid moron pathetic loser you are an the house of reading late tomorrow a ass a you are a " * 50
    assert t.Restorer(t.trigram_counts([words])).restored(given) == read


def test_letter_counts():
    counts = t.trigram_counts(["ab, ab", None, "", "É"]).reshape(28, 28, 28)
    assert counts[t.EDGE, 0, 1] == 2 and counts[0, 1, t.EDGE] == 2 and counts[t.EDGE, t.OTHER, t.EDGE] == 1
    assert t.trigram_counts([None]).sum() == 0


def test_curve_finds_its_weights():
    r = np.random.default_rng(1)
    rows = np.column_stack([np.ones(4000), r.normal(size=(4000, 2))])
    labels = (r.random(4000) < 1 / (1 + np.exp(-(rows @ [-1, 2, 0])))).astype(float)
    assert np.allclose(t.fit_curve(rows, labels), [-1, 2, 0], atol=0.25)


def corpus(spark, n=400):
    r, texts, marks = rng(), [], []
    for i in range(n):
        bad = i % 4 == 0
        words = prose(r, r.randrange(20, 80), 400).split()
        for _ in range(6 if bad else 0):
            words.insert(r.randrange(len(words)), r.choice(["idiot", "1d10t", "stuuuupid", "m o r o n", "moron", "stupid"]))
        texts.append(" ".join(words))
        marks.append((i + 1, int(bad)))
    labels = spark.createDataFrame(marks, "doc_id long, toxic int")
    return documents(spark, texts), labels, dict(marks)


def test_held_out_texts_are_told_apart(spark):
    docs, labels, truth = corpus(spark)
    model = t.fit(docs, labels.where(F.col("doc_id") % 5 != 0))
    got = {r.doc_id: r.score for r in t.score(docs, model).collect()}
    held = [i for i in truth if i % 5 == 0]
    assert np.mean([(got[i] >= 0.5) == truth[i] for i in held]) >= 0.95
    assert t.fit(docs.repartition(7), labels.where(F.col("doc_id") % 5 != 0)).curve == pytest.approx(model.curve)
    kept = t.without_toxic(docs.withColumn("toxic_score", F.lit(1)), model)
    assert kept.columns == [*docs.columns, "toxic_score"] and 250 < kept.count() < 350


def test_nulls_long_repeated_empty(spark):
    docs, labels, _ = corpus(spark, 80)
    odd = labels.unionByName(spark.createDataFrame([(1, None), (None, 1), (999, 1), (2, 7)], labels.schema))
    model = t.fit(docs, odd)
    texts = [None, "", LONG, "a" * 50_000, "x " * 500, "1" * 3000, "same idiot", "same idiot", "?!"]
    got = [r.score for r in t.score(documents(spark, texts).withColumn("score", F.lit("x")), model).orderBy("doc_id").collect()]
    assert all(0 <= x <= 1 for x in got) and got[0] == got[1] == got[8] and got[6] == got[7]
    assert t.score(documents(spark, []), model).count() == 0
    none = t.fit(docs, labels.limit(0))
    assert {r.score for r in t.score(docs, none).collect()} == set(none.score(["a"]))
    assert len(t.fit(documents(spark, []), labels).entries) == 0


def every_path(letters, run):
    """The best sum over all paths of a run's lattice, and the readings that have it."""
    best = {}
    for path in itertools.product(*t.lattice(run)):
        text, classes = "".join(x for _, x in path), [t.EDGE, t.EDGE]
        total = sum(cost for cost, _ in path)
        for x in [c for c in text if c.isalpha() or c == " "] + [None]:
            classes.append(t.EDGE if x in (" ", None) else t.letter_class(x))
            total += letters.log[classes[-3]][classes[-2]][classes[-1]]
        best.setdefault(round(total, 9), set()).add(text)
    return best[max(best)]


@pytest.mark.parametrize("run", ["1d10t", "st*p1d", "i d i o t", "st00pid", "@$$", "m.o.r 0 n", "a55", "yoouuu", "x", "l0$er!",
                                 "é1 d", "h0000m3", "t#3", "1+1", "a b c d"])
def test_decoding_finds_the_best_of_all_paths(restorer, run):
    assert restorer.letters.decode(run) in every_path(restorer.letters, run)


def test_quick_look_misses_no_pattern(restorer):
    r = rng(11)
    signs = "aab1@$!*. -_\n€£é(z|#²日"
    for _ in range(4000):
        text = "".join(r.choice(signs) for _ in range(r.randrange(1, 14)))
        may = t.may_hold(text)
        assert may.apart or not (t.APART.search(text) or t.APART_OF_MARK.search(text)), text
        assert may.marked or not t.MARKED.search(text), text
        assert may.repeated or not t.LONG_RUN.search(text), text


def plain_pieces(word):
    whole = f"<{word}>"
    return [whole[at:at + n] for n in t.SIZES for at in range(len(whole) - n + 1)] or [whole]


def test_pieces_stand_at_any_place_of_a_word():
    texts = ["super a, idiot-ß x2y", "", "?!", "Ab cde fghi", "one", "日本 ñandú 😀"]
    got = t.pieces_of(texts)
    words = [[w for w in t.WORD.findall(text)] for text in texts]
    assert got.words.tolist() == [len(w) for w in words]
    expected = sorted((k, t.piece_hash(g)) for k, ws in enumerate(words) for w in ws for g in plain_pieces(w))
    assert sorted(zip(got.text.tolist(), got.hashes.tolist())) == expected
    assert {"<supe", "super", "uper>", "<super", "super>", "<super>"} == set(plain_pieces("super"))
    assert len(t.pieces_of([]).hashes) == 0


def test_words_weigh_as_their_weightiest_piece():
    model = t.lexicon(np.zeros(28**3, np.int64), {(t.piece_hash("idiot"), False): 2.0, (t.piece_hash("idio"), False): 9.0,
                                                  (t.piece_hash("<ass>"), False): 1.0, (t.piece_hash("moron"), True): 3.0})
    total = lambda text: np.expm1(model.features(["other", text, ""])[1, 1])
    assert total("superidiot") == pytest.approx(2) and total("idiot glass ass") == pytest.approx(3)
    assert total("moron") == 0 and total("moron moronic") == pytest.approx(6) and total("") == 0
    assert model.features(["a b"])[0].tolist() == [1, 0, 0, np.log1p(2)]


def test_insults_inside_words_are_learnt(spark):
    r, texts, marks = rng(), [], []
    for i in range(300):
        words = prose(r, 40, 400).split()
        for _ in range(4 if i % 3 == 0 else 0):
            words.insert(r.randrange(len(words)), "".join(r.choices("bcdgklmp", k=3)) + "idiot" + "".join(r.choices("efno", k=2)))
        texts.append(" ".join(words))
        marks.append((i + 1, int(i % 3 == 0)))
    docs = documents(spark, texts)
    model = t.fit(docs, spark.createDataFrame(marks, "doc_id long, toxic int").where("doc_id % 2 = 0"))
    got = {row.doc_id: row.score >= 0.5 for row in t.score(docs, model).collect()}
    assert t.piece_hash("idiot") in model.entries and all(got[i] == bool(y) for i, y in marks if i % 2)


def test_a_labelled_row_counts_once(spark):
    docs, labels, _ = corpus(spark, 120)
    model = t.fit(docs, labels)
    again = t.fit(docs.unionByName(docs.where("doc_id <= 8")).unionByName(docs.where("doc_id <= 8")), labels.union(labels))
    assert (again.entries == model.entries).all() and (again.once == model.once).all() and again.curve == pytest.approx(model.curve)
    few = t.labelled_texts(docs, labels, model.letters, "doc_id", "text", "toxic", 30)
    assert few.count() == 30 and few.columns == ["toxic", "restored"]
