import random

from tessella.llm import pieces, tokens

PATH = f"{tokens.TOKENIZERS}/{tokens.VOCABULARY}"


def texts():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9)))
    sentence = lambda: " ".join(word() for _ in range(rng.randint(5, 15))).capitalize() + rng.choice([". ", "? ", "! "])
    return {
        1: "\n\n".join("".join(sentence() for _ in range(6)) for _ in range(20)),
        2: "".join(sentence() for _ in range(120)),
        3: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(8000)),
        4: "日本語テキスト😀é" * 400,
        5: "short. text.",
        6: "",
        7: " ".join(word() for _ in range(900)),
        8: "\n" * 3000 + "a b" * 700,
    }


def test_pieces_cover_overlap_and_stay_within_the_limit(spark):
    every = texts()
    rows = [(k, t, 0) for k, t in every.items()] + [(9, None, 0), (10, "w, " * 60_000, 0)]
    every[10] = rows[-1][1]
    limit, overlap = 200, 20
    got = pieces.split(spark.createDataFrame(rows, "doc_id bigint, text string, piece int"), limit, overlap).toPandas()
    long = {k for k, t in every.items() if len(tokens.encode(t, PATH)) > limit}
    assert set(got.doc_id) == long and long == {1, 2, 3, 4, 7, 8, 10}
    assert got.n_tokens.max() <= limit
    for k, x in got.groupby("doc_id"):
        x = x.sort_values("piece_no").to_dict("records")
        at = tokens.offsets(every[k], PATH)
        assert x[0]["start"] == 0 and x[-1]["end"] == len(every[k])
        for a, b in zip(x, x[1:]):
            assert every[k][a["start"] : a["end"]] == a["piece"]
            inside = [i for i, c in enumerate(at) if b["start"] <= c < a["end"]]
            assert abs(len(inside) - overlap) <= 3  # characters of several tokens
    ends = [p[-2:] for p in got[got.doc_id == 1].sort_values("piece_no").piece[:-1]]
    assert all(e == "\n\n" or e[-1] in ".?! \n" for e in ends)
    assert all(p[-1] in ".?!" or p.rstrip()[-1] in ".?!" for p in got[got.doc_id == 2].sort_values("piece_no").piece[:-1])


def test_prose_before_a_blankless_dense_script_is_cut_to_the_end(spark):
    rng = random.Random(7)
    prose = " ".join(rng.choice(["international", "responsibility", "administration", "constitutional", "representatives"]) for _ in range(60))
    every = {
        1: prose + " " + "".join(chr(rng.randint(0x4E00, 0x9FA5)) for _ in range(2500)),
        2: prose + ". " + "".join(chr(rng.randint(0x0F40, 0x0F6C)) for _ in range(1500)),
    }
    limit, overlap = 200, 20
    got = pieces.split(spark.createDataFrame(list(every.items()), "doc_id bigint, text string"), limit, overlap).toPandas()
    assert set(got.doc_id) == set(every)
    for k, x in got.groupby("doc_id"):
        x = x.sort_values("piece_no").to_dict("records")
        assert x[0]["start"] == 0 and x[-1]["end"] == len(every[k])
        assert all(a["start"] < b["start"] <= a["end"] for a, b in zip(x, x[1:]))
        assert all(a["piece"] == every[k][a["start"] : a["end"]] and a["n_tokens"] <= limit for a in x)
        assert all(a["n_tokens"] >= limit // 2 - 20 for a in x[:-1])


def test_a_piece_whose_tokens_change_when_it_is_cut_is_halved():
    text = "".join(random.Random(1).choice("abcdefgh ") for _ in range(3000))
    parts = tokens.parts_within(text, 300, 20, PATH)
    assert len(parts) > 2 and parts[0][0] == 0 and parts[-1][1] == len(text)
    assert all(n == len(tokens.encode(text[a:b], PATH)) <= 300 for a, b, n in parts)
    assert all(a[0] < b[0] < a[1] < b[1] for a, b in zip(parts, parts[1:]))


def test_no_slack_still_keeps_the_limit(spark, monkeypatch):
    monkeypatch.setattr(pieces, "SLACK", -30)  # windows beyond the limit, so pieces must be halved
    every = texts()
    got = pieces.split(spark.createDataFrame(list(every.items()), "doc_id bigint, text string"), 200, 20).toPandas()
    assert got.n_tokens.max() <= 200 and len(got)
    for k, x in got.groupby("doc_id"):
        x = x.sort_values("piece_no").to_dict("records")
        assert [p["piece_no"] for p in x] == list(range(len(x))) and x[0]["start"] == 0 and x[-1]["end"] == len(every[k])
        assert all(a["piece"] == every[k][a["start"] : a["end"]] and a["n_tokens"] == len(tokens.encode(a["piece"], PATH)) for a in x)
        assert all(a["start"] < b["start"] <= a["end"] for a, b in zip(x, x[1:]))


def test_each_text_is_encoded_once(spark, capsys):
    got = pieces.split(spark.createDataFrame([(1, "a b")], "doc_id bigint, text string")).filter("piece_no = 0").select("doc_id")
    got.explain()
    plan = capsys.readouterr().out.split("Initial Plan")[0]
    assert plan.count("MapInArrow") == 2 and plan.count("Exchange") == 1  # the whole text, and its pieces


def test_empty(spark):
    assert pieces.split(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0
