import random

from strandloom.llm import line_dedup as d


def plain(docs, min_words):
    """{doc: kept lines}, by comparing all runs of lines. docs: (id, text) with distinct ids, in order."""
    seen, gone = {}, {i: set() for i, _ in docs}
    lines = {i: t.split("\n") for i, t in docs}
    for i, _ in docs:
        ls = lines[i]
        for s in range(len(ls)):
            for e in range(s + 1, len(ls) + 1):
                if sum(len(x.split()) for x in ls[s:e]) < min_words:
                    continue
                key = tuple(ls[s:e])
                if seen.setdefault(key, (i, s)) != (i, s):
                    gone[i].update(range(s, e))
    return {i: "\n".join(x for k, x in enumerate(lines[i]) if k not in gone[i]) for i, _ in docs}


def test_against_all_runs(frame):
    r = random.Random(4)
    docs = [(i, "\n".join(r.choice(["a b", "c", "d e f", "", "g h", "i j k l"]) for _ in range(r.randint(1, 12)))) for i in range(40)]
    for least in (4, 7):
        got = d.line_dedup(frame(docs, "doc_id long, text string"), min_words=least).collect()
        assert {x["doc_id"]: x["text"] for x in got} == plain(docs, least)


def test_edge_cases(frame):
    long = "\n".join(f"line number {i} of a passage with several words" for i in range(300))
    rows = [(1, None, 0), (2, "", 0), (3, long, 0), (4, "before\n" + long, 0), (None, "short", 0), (4, "another text", 0), (4, "another text", 0), (5, "x\n" + long + "\ny", 0)]
    got = d.line_dedup(frame(rows, "doc_id long, text string, lines_removed int")).collect()
    text = sorted((x["doc_id"] or 0, x["text"] or "", x["lines_removed"]) for x in got)
    assert text == [(0, "short", 0), (1, "", 0), (2, "", 0), (3, long, 0), (4, "another text", 0), (4, "another text", 0), (4, "before", 300), (5, "x\ny", 300)]
    assert d.line_dedup(frame([], "doc_id long, text string")).count() == 0
    again = d.line_dedup(frame([(1, long + "\n" + long, "k", "g")], "doc_id long, text string, tkey string, gone string")).first()
    assert again["text"] == long and again["tkey"] == "k"
