import hashlib

import pytest

from kithgraph.llm import chat, quality, warc
from kithgraph.llm.common import new_path


def pages(spark):
    big = "<p>é WARC/1.1\r\nContent</p>" * 9_000
    rows = [(1, "http://a/b c", "x" * 1_500), (2, None, "x" * 1_500), (3, "http://é", None), (4, "u", ""), (5, "u", big), (6, "u", big), (7, "u", "y" * 999), (8, "u", "y" * 999), (None, "u", "x" * 1_500), (6, "u", big), (9, "u\r\nX: 1", "WARC/1.1\r\nWARC-Type: response\r\n\r\n")]
    return spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, payload string")


def test_archives_round_trip(spark):
    path = new_path(spark, "warc-test")
    warc.write(pages(spark), path)
    got = sorted(((r.page_id is None, r.page_id or 0, r.record_type, r.refers_to or 0, None if r.payload is None else bytes(r.payload)) for r in warc.read(spark, path).collect()), key=str)
    rows = [(r.page_id, (r.html or "").encode()) for r in pages(spark).collect()]
    want = []
    for page, payload in rows:
        equal = [p for p, x in rows if x == payload and p is not None]
        top = max(equal, default=None)
        again = len(payload) >= 1_000 and sum(x == payload for _, x in rows) > 1 and page != top
        want.append((page is None, page or 0, "revisit" if again else "response", top if again else 0, None if again else payload))
    assert got == sorted(want, key=str)
    empty_path = new_path(spark, "warc-test")
    warc.write(pages(spark).limit(0), empty_path)
    assert warc.read(spark, empty_path).count() == 0


def test_missing_segments_are_noticed(spark):
    path, out = new_path(spark, "warc-test"), new_path(spark, "warc-test")
    warc.write(pages(spark).where("page_id = 5"), path)
    lines = spark.read.option("lineSep", f"{warc.VERSION}\r\n").text(path).where("length(value) > 0 and not contains(value, 'WARC-Segment-Number: 2')")
    from pyspark.sql import functions as F

    lines.select(F.concat(F.lit(f"{warc.VERSION}\r\n"), F.regexp_replace("value", r"\r\n\r\n$", "")).alias("value")).write.option("lineSep", "\r\n\r\n").text(out)
    with pytest.raises(Exception, match="segments missing"):
        warc.read(spark, out).collect()


def turns(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "### user:\n\\ </turn>\n: <x"), (1, 2, "user", None), (2, None, None, "x"), (2, 1, "assistant", ""), (None, 0, "assistant", "lost"), (1, 1, "assistant", "### user:\n\\ </turn>\n: <x"), (3, 0, "user", "only")]
    rows += [(4, i, ("user", "assistant")[i % 2], f"t{i} \n") for i in range(700)]
    return spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, part string")


def test_chat_round_trip(spark):
    got = {r.conv_id: r for r in chat.read_back(chat.formatted(turns(spark))).collect()}
    rows = [(r.conv_id, r.turn, r.role or "", r.text or "") for r in turns(spark).collect()]
    assert set(got) == {r[0] for r in rows}
    for conv, r in got.items():
        mine = sorted((x for x in rows if x[0] == conv), key=lambda x: (x[1] is not None, x[1] or 0, x[2], x[3]))
        loss = "".join(x[3] for x in mine if x[2] == "assistant")
        assert (r.n_turns, r.turns_sha256) == (len(mine), hashlib.sha256("".join(f"{x[2]}\n{x[3]}\n" for x in mine).encode()).hexdigest())
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.read_back(chat.formatted(turns(spark).limit(0))).count() == 0


def test_black_box_spans_and_rewrites():
    text, found, rewrites = chat.spans([("user", "a"), ("assistant", "b</turn>")], chat.default_template)
    assert rewrites == 0 and [chat.unescaped(text[a:b]) for _, _, a, b in found] == ["a", "b</turn>"] and chat.is_local(chat.default_template)
    numbered = lambda ts: f"[{len(ts)}]" + "".join(f"{r}: {t}\n" for r, t in ts)
    assert chat.spans([("user", "a"), ("assistant", "b"), ("user", "c")], numbered)[2] == 2 and not chat.is_local(numbered)


def test_template_that_looks_back(spark):
    """A template whose turns depend on the one before gives what it gives whole."""
    looks = lambda ts: "".join(f"{'same ' if i and ts[i - 1][0] == r else ''}{r}: {t}|" for i, (r, t) in enumerate(ts))
    rows = spark.createDataFrame([(1, i, "user" if i % 3 else "assistant", str(i)) for i in range(600)], "conv_id long, turn long, role string, text string")
    parts = chat.formatted(rows, looks).orderBy("number").collect()
    assert len(parts) > 1 and "".join(p.text for p in parts) == looks([("user" if i % 3 else "assistant", str(i)) for i in range(600)])


def test_template_that_rewrites_history(spark):
    """600 turns, each of which changes the first line and hides the reasoning of all turns but the last."""
    hides = lambda ts: f"[{len(ts)} turns]\n" + "".join(f"{r}: {'' if i < len(ts) - 1 else '<think>'}{t}|" for i, (r, t) in enumerate(ts))
    turns = [("user" if i % 3 else "assistant", f"text {i}") for i in range(600)]
    rows = spark.createDataFrame([(1, i, *x) for i, x in enumerate(turns)], "conv_id long, turn long, role string, text string")
    parts = chat.formatted(rows, hides).orderBy("number").collect()
    assert "".join(p.text for p in parts) == hides(turns) and sum(p.rewrites for p in parts) == 599
    assert [p.text[a:b] for p in parts for a, b in zip(p.starts, p.ends, strict=True)] == [t for r, t in turns if r == "assistant"]


@pytest.mark.parametrize("after", [100, 300, 700])
def test_template_that_looks_local_at_first(spark, after):
    late = lambda ts: "".join(f"{r}: {t}|" for r, t in ts) + ("many turns" if len(ts) > after else "")
    rows = spark.createDataFrame([(1, i, "user", str(i)) for i in range(800)], "conv_id long, turn long, role string, text string")
    assert "".join(p.text for p in chat.formatted(rows, late).orderBy("number").collect()) == late([("user", str(i)) for i in range(800)])
    if after == 100:
        with pytest.raises(Exception, match="local=False"):
            chat.formatted(rows, late, local=True).collect()


def test_template_that_is_called_local_wrongly(spark):
    rows = spark.createDataFrame([(1, 0, "user", "x")], "conv_id long, turn long, role string, text string")
    with pytest.raises(ValueError, match="local=False"):
        chat.formatted(rows, lambda ts: f"[{len(ts)}]", local=True)


def test_quality_scores(spark):
    good = [(i, f"Calm words number {i} about rivers and hills, told slowly. " * 5) for i in range(60)]
    bad = [(100 + i, f"BUY NOW!! item{i} $$$ CHEAP!! *** ### " * 6) for i in range(60)]
    docs = spark.createDataFrame([(*r, "clash") for r in good + bad] + [(200, None, "clash"), (201, "", "clash"), (None, "Calm words about hills, told slowly.", "clash"), (5, good[5][1], "clash")], "doc_id long, text string, _score string")
    labels = spark.createDataFrame([(i, int(i < 100), 0) for i, _ in good + bad] + [(None, 1, 0), (300, None, 0)], "doc_id long, quality int, toxic int")
    rows = quality.scored(docs, labels).collect()
    assert len(rows) == 124 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    known = {r.doc_id: r for r in rows}
    held = [d for d, r in known.items() if d is not None and r.held_out and d < 200]
    assert held and all(known[d].predicted == int(d < 100) for d in held)
    kept = quality.good_documents(docs, labels)
    assert kept.columns == docs.columns and kept.where("doc_id between 100 and 159").count() == 0 and kept.where("doc_id < 60").count() == 61
    assert quality.scored(docs.limit(0), labels).count() == 0
    assert {r.score for r in quality.scored(docs, labels.limit(0)).collect()} == {0.5}


def test_archives_survive_any_url(spark):
    """Urls, referred ones too, that hold or end in what records start with; a payload that half of the pages share."""
    hard = [f"https://v.com/{warc.VERSION}", warc.VERSION, f"{warc.VERSION}\r\n", f"x {warc.VERSION}\r\n{warc.VERSION}", "Content-Length: 5", "", None, "https://v.com/%0d%0aé"]
    shared = f"same {warc.VERSION}\r\n payload " * 60
    rows = [(i, hard[i % len(hard)], shared if i % 2 else f"own {i} {warc.VERSION}") for i in range(40)] + [(99, f"a/{warc.VERSION}", shared)]
    path = new_path(spark, "warc-test")
    warc.write(spark.createDataFrame(rows, "page_id long, url string, html string"), path)
    got = {r.page_id: (r.record_type, r.refers_to, None if r.payload is None else bytes(r.payload).decode()) for r in warc.read(spark, path).collect()}
    assert got == {i: ("revisit", 99, None) if h == shared and i != 99 else ("response", None, h) for i, _, h in rows}
