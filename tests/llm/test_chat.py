from screentone.llm import chat


def rows(spark, data):
    return {(r["conv_id"], r["turn"]): r for r in chat.conversations(spark.createDataFrame(data, "conv_id long, turn int, role string, text string, chat string")).collect()}


def test_quotes_link_nested_levels_and_order(spark):
    a = "The first point stands.\nAnd a second one."
    b = "I disagree with it."
    data = [
        (1, 0, "user", a, "x"),
        (1, 1, "assistant", b, "x"),
        (1, 2, "user", "On Monday, Ann wrote:\n> the  first POINT stands.\n> And a second one.\nYes to that.", "x"),
        (1, 3, "assistant", ">> The first point stands.\n> I disagree with it.\nWhy?", "x"),
        (1, 4, "user", "No quote here.", "x"),
        (1, 5, "user", "> words that nobody said\nHello", "x"),
        (2, 0, "user", None, "x"),
        (2, None, "user", "", "x"),
        (None, 0, None, "> The first point stands.", "x"),
    ]
    r = rows(spark, data)
    assert len(r) == 9
    assert r[1, 2]["reply_to"] == 0 and r[1, 2]["text"] == "Yes to that." and r[1, 2]["n_quotes"] == 1
    assert r[1, 3]["reply_to"] == 1 and r[1, 3]["text"] == "Why?" and r[1, 3]["n_quotes"] == 2
    assert r[1, 4]["reply_to"] == 3 and r[1, 5]["reply_to"] == 4 and r[1, 5]["text"] == "Hello"
    assert r[1, 0]["reply_to"] is None and r[1, 1]["reply_to"] == 0
    order = sorted((x["position"], x["turn"]) for k, x in r.items() if k[0] == 1)
    assert [p for p, _ in order] == list(range(6))
    place = {t: p for p, t in order}
    for k, x in r.items():
        if k[0] == 1 and x["reply_to"] is not None:
            assert place[x["reply_to"]] < place[x["turn"]]
    assert [t for _, t in order] == [0, 1, 2, 3, 4, 5]
    assert r[2, None]["position"] == 0 and r[2, 0]["text"] == "" and r[None, 0]["text"] == ""
    assert r[None, 0]["chat"].startswith("<|unknown|>")


def test_reply_order_groups_siblings(spark):
    data = [(1, 0, "u", "root words", "x"), (1, 1, "a", "one", "x"), (1, 2, "u", "two", "x"), (1, 3, "a", "> root words\nlate answer", "x"), (1, 4, "u", "tail", "x")]
    r = rows(spark, data)
    assert [t for _, t in sorted((x["position"], x["turn"]) for x in r.values())] == [0, 1, 3, 2, 4]


def test_long_conversation_and_common_line(spark):
    data = [(7, t, "u", "ok" if t % 2 == 0 else "> ok\nfine", "x") for t in range(1500)]
    r = rows(spark, data)
    assert all(r[7, t]["reply_to"] == t - 1 for t in range(1, 1500))
    assert sorted(x["position"] for x in r.values()) == list(range(1500))


def test_empty_and_repeated(spark):
    assert rows(spark, []) == {}
    got = chat.conversations(spark.createDataFrame([(1, 0, "u", "a"), (1, 0, "u", "a")], "conv_id long, turn int, role string, text string")).collect()
    assert sorted(x["position"] for x in got) == [0, 1]


def test_given_conversations_against_plain_order(spark, sf_dir):
    m = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    got = chat.conversations(m).collect()
    want = m.collect()
    assert len(got) == len(want)
    turns: dict = {}
    for x in want:
        turns.setdefault(x["conv_id"], []).append(x["turn"])
    for x in got:
        before = [t for t in turns[x["conv_id"]] if t < x["turn"]]
        assert x["reply_to"] == (max(before) if before else None)
        assert x["position"] == len(before)
