from pyspark.sql import functions as F

from billweave.llm import quotes

SCHEMA = "conv_id long, turn long, role string, text string"
TALK = [
    (1, 0, "user", "How do I build the\nsmall red house?"),
    (1, 1, "assistant", "First lay the ground stones.\n\nThen raise four walls."),
    (1, 2, "user", "On Monday x wrote:\n> Then raise  FOUR walls.\nHow high are they?"),
    (1, 3, "user", "> How do I build the\n> small red house?\nI ask the same."),
    (1, 4, "assistant", "> > Then raise four walls.\n> How high are they?\nTwo metres."),
    (1, 5, "user", "> nobody ever said this here\nThanks"),
    (1, 6, "user", "> Two metres."),
    (2, 0, "user", "> Then raise four walls.\nwrong conversation"),
    (3, 0, "user", "same words in here"), (3, 1, "user", "same words in here"),
    (3, 2, "user", "> same words in here\nwhich one"),
]


def collect(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA + ", path string") if len(rows and rows[0] or ()) == 5 \
        else spark.createDataFrame(rows, SCHEMA)
    return quotes.reply_order(df).collect()


def test_links_paths_and_texts(spark):
    got = {(r.conv_id, r.turn): r for r in collect(spark, [(*t, "clash") for t in TALK])}
    links = {k: r.reply_to for k, r in got.items() if r.reply_to is not None}
    assert links == {(1, 2): 1, (1, 3): 0, (1, 4): 2, (1, 6): 4, (3, 2): 1}
    assert got[1, 6].path == [1, 2, 4, 6] and got[1, 4].depth == 2 and got[1, 4].thread == 1
    assert got[1, 2].text == "How high are they?" and got[1, 6].text == ""
    assert got[1, 5].text == "Thanks" and got[2, 0].reply_to is None
    order = [r.turn for r in sorted((r for k, r in got.items() if k[0] == 1), key=lambda r: r.path)]
    assert order == [0, 3, 1, 2, 4, 6, 5]
    assert got[1, 5].chat == "<|user|>\nThanks"


SAID = ("The first part has many words\nand ends here.\n\nThe second part stands alone\nin two lines. It has a sentence more.\n\n"
        "A third part closes.")
WRAPPED = [
    (8, 0, "user", SAID), (8, 1, "user", "Something else entirely was said."),
    (8, 2, "user", "> The first part\n> has many words and ends here.\n>\n> The second part stands\n> alone in two lines. It has a sentence more.\nok"),
    (8, 3, "user", "> It has a\n> sentence more.\nyes"), (8, 4, "user", "> The second part\n> stands alone in two\n> lines.\nno"),
    (8, 5, "user", "> It has a\n> house more.\nhm")]


def test_wrapped_parts_of_messages_are_found(spark):
    got = {r.turn: r.reply_to for r in collect(spark, WRAPPED)}
    assert got == {0: None, 1: None, 2: 0, 3: 0, 4: 0, 5: None}


def test_long_chains_are_followed(spark):
    rows = [(9, 0, "user", "message number zero stands here")]
    names = ["zero", *[f"n{i}" for i in range(1, 20)]]
    for i in range(1, 20):
        rows.append((9, i, "user", f"> message number {names[i - 1]} stands here\nmessage number {names[i]} stands here"))
    got = {r.turn: r for r in collect(spark, rows)}
    assert got[19].path == list(range(20)) and got[0].depth == 0


def test_nulls_repeats_and_empty(spark):
    rows = [(None, 0, "user", "> a b c\nd"), (5, None, "user", "x"), (5, 0, None, None), (5, 1, "user", ""),
            (5, 2, "user", "the same line here"), (5, 3, "user", "> the same line here"), (5, 3, "user", "> the same line here"),
            (5, 4, "user", "> " * 300 + "deep\n" + "> the same line here\n" * 5000)]
    got = collect(spark, rows)
    assert len(got) == len(rows)
    by = {(r.conv_id, r.turn): r for r in got}
    assert by[None, 0].path is None and by[None, 0].text == "d" and by[5, None].path is None
    assert by[5, 0].text is None and by[5, 0].path == [0] and by[5, 3].reply_to == 2 and by[5, 4].reply_to == 2
    assert quotes.reply_order(spark.createDataFrame([], SCHEMA)).count() == 0


def test_no_python_in_the_plan(spark):
    plan = quotes.reply_order(spark.createDataFrame(TALK, SCHEMA))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_like_sql(spark):
    import duckdb

    from billweave.llm import queries
    odd = [(4, 0, "user", "A b c d.\n\nE f g h"), (4, 1, "user", "y wrote:\n> E  F g h\n> > A b c d.\nx"), (4, 2, None, None),
           *WRAPPED,
           (None, 3, "user", "> a"), (4, 3, "user", ">> A b c d."), (4, None, "user", "t"), (4, 4, "user", "")]
    df = spark.createDataFrame([*TALK, *odd], SCHEMA)
    duck = duckdb.connect()
    duck.register("conversations", df.toPandas().astype({"conv_id": "Int64", "turn": "Int64"}))
    expected = duck.sql(queries.ORACLE["op5_reply_order"])
    got = quotes.reply_order(df).withColumn("path", F.array_join("path", "."))
    columns = sorted(expected.columns)
    assert (sorted(repr(tuple(r)) for r in got.select(*columns).collect())
            == sorted(repr(r) for r in expected.select(*columns).fetchall()))
