import random

from ionloom.llm.quotes import Matcher, piece_words, prefix_distances, quoted_items, words

SCHEMA = "doc_id bigint, text string, item_id bigint, source string"


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row


def brute(item, doc):
    """Whether any window of 20 to 39 words of the item lies in the document with at most one edit in eight words."""
    for i in range(len(item)):
        for n in range(20, 40):
            if i + n > len(item):
                break
            for j in range(len(doc)):
                if min(edits(item[i : i + n], doc[j : j + n + 6])) <= n // 8:
                    return True
    return False


def test_bit_vectors_give_edit_distances():
    rng = random.Random(1)
    for _ in range(200):
        p, t = ([rng.randrange(4) for _ in range(rng.randrange(0, 70))] for _ in range(2))
        assert prefix_distances(p, t).tolist() == [min(edits(p[:i], t)) for i in range(len(p) + 1)]


def test_words():
    assert words("The “Ion-\n> trap”, O-methyl​-x!  ﬁn­al") == ["the", "iontrap", "omethylx", "final"]
    assert words(None) == words("") == words(" \n…") == []


def test_scripts_without_blanks():
    assert words("质谱 of 化合物カ") == ["质", "谱", "of", "化", "合", "物", "カ"]
    han = "".join(chr(0x4E00 + 7 * i) for i in range(40))
    matcher = Matcher([(5, words(han))])
    assert matcher.found("前文" + han[3:30] + "后文") == [5] and matcher.found(han[3:18]) == []


def test_pieces():
    assert piece_words() == 6


def test_against_brute_force():
    rng = random.Random(7)
    vocabulary = [f"w{i}" for i in range(400)]
    items = [(k, [rng.choice(vocabulary) for _ in range(rng.choice([12, 20, 45]))]) for k in range(6)]
    matcher = Matcher(items)
    agree = 0
    for _ in range(60):
        k, item = rng.choice(items)
        n = min(len(item), rng.choice([10, 16, 19, 20, 24, 30]))
        start = rng.randrange(len(item) - n + 1)
        quote = list(item[start : start + n])
        for _ in range(rng.randrange(0, n // 6 + 1)):
            at = rng.randrange(len(quote))
            kind = rng.randrange(3)
            quote[at : at + (kind != 2)] = [] if kind == 1 else [rng.choice(vocabulary) + "x"]
        doc = [rng.choice(vocabulary) for _ in range(15)] + quote + [rng.choice(vocabulary) for _ in range(15)]
        expected = {i for i, it in items if brute(it, doc)}
        assert set(matcher.found(" ".join(doc))) == expected
        agree += bool(expected)
    assert agree > 10


def test_frame(spark):
    item = " ".join(f"word{i}" for i in range(40))
    quoted = item.replace(" ", "\n> ", 9).replace("word12", "“WORD12”,").replace("word5", "other")
    docs = [(1, "before " + quoted + " after", 9, "s"), (1, "before " + quoted + " after", 9, "s"), (2, " ".join(item.split()[:15]), 9, "s"), (3, None, 9, "s"), (4, "", 9, "s"), (5, ("filler " * 60_000) + item, 9, "s")]
    frame = spark.createDataFrame(docs, SCHEMA)
    items = spark.createDataFrame([(9, item, 1), (9, item, 1), (10, None, 1), (11, "too short", 1)], "item_id bigint, text string, doc_id int")
    assert {tuple(r) for r in quoted_items(frame, items).collect()} == {(1, 9), (5, 9)} and quoted_items(frame, items).count() == 2
    assert quoted_items(frame.limit(0), items).collect() == [] and quoted_items(frame, items.limit(0)).collect() == []


def test_partitions_give_what_one_matcher_gives(spark):
    """The filter, the join of pieces and the stretches lose nothing, and a piece that every document holds is no problem."""
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(30)] + ["质", "谱"]
    items = [(k, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([19, 20, 40, 70])))) for k in range(25)]
    docs = []
    for d in range(120):
        ws = [rng.choice(vocabulary) for _ in range(rng.randrange(0, 120))]
        for _ in range(rng.randrange(0, 4)):
            item = rng.choice(items)[1].split()
            n = min(len(item), rng.choice([12, 20, 26, 45]))
            quote = item[(start := rng.randrange(len(item) - n + 1)) : start + n]
            if rng.random() < 0.6:
                quote[rng.randrange(len(quote))] = "other"
            at = rng.randrange(len(ws) + 1)
            ws[at:at] = quote
        docs.append((d, " ".join(ws), 1, "s"))
    matcher = Matcher([(k, words(t)) for k, t in items])
    expected = {(d, k) for d, t, *_ in docs for k in matcher.found(t)}
    got = quoted_items(spark.createDataFrame(docs, SCHEMA).repartition(5), spark.createDataFrame(items, "item_id bigint, text string")).collect()
    assert len(expected) > 60 and {tuple(r) for r in got} == expected and len(got) == len(expected)
