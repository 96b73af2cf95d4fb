"""Queries that once read only a part of their input, against brute force on inputs that reach past it."""

from collections import Counter
from datetime import datetime
from hashlib import sha1
from random import Random

import pytest

from quillstream.operators import layout, pagework, pairs, rowwork, scoring, terms


@pytest.fixture
def made(spark, tmp_path):
    """Writes rows as a table of a folder of its own, which it returns."""

    def write(name, rows, schema):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return write


def documents(made, *texts):
    return made("documents", list(enumerate(texts, 1)), "doc_id long, text string")


def test_lines_merge_to_a_fixpoint_past_the_twelfth(spark, made):
    long = [f"line {i}" for i in range(45)]
    texts = [long, long, [*long[:20], "other", *long[21:]], [*long[:30], "", *long[30:]], ["new", *long[1:]], ["same"] * 17, ["same"] * 15]
    objects = [(d, i, line, max((j for j in range(i) if t[j]), default=None)) for d, t in enumerate(texts, 1) for i, line in enumerate(t) if line]
    rep, new = {}, {(d, i): (d, i) for d, i, _, _ in objects}
    while new != rep:
        rep, new, first = new, {}, {}
        for d, i, line, before in objects:
            new[d, i] = first.setdefault((line, None if before is None else rep[d, before]), (d, i))
    got = {(r.rep >> 31, r.rep & (1 << 31) - 1): r.n for r in layout.fixpoint_dedup(spark, documents(made, *map("\n".join, texts))).collect()}
    assert got == Counter(rep.values()) and got[1, 44] == 3


def test_components_take_every_order(spark, made):
    day = lambda i: datetime(1995, 1, 1 + i * 5 % 28)
    rows = [(k, k * k % 9, day(k)) for k in range(1, 70)] + [(900, 77, day(0))]
    of = {}
    for k, c, d in sorted(rows, key=lambda r: (r[2], r[0])):
        of.setdefault(c, []).append(k)
    got = layout.components(spark, made("orders", rows, "o_orderkey long, o_custkey long, o_orderdate timestamp")).collect()
    assert {(r.node, r.component) for r in got} == {(k, min(ks)) for ks in of.values() if len(ks) > 1 for k in ks}


def test_connected_equals_a_search(spark):
    rng = Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)]
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    want = {}
    for start in sorted(near):
        todo = [start]
        while todo:
            if (n := todo.pop()) not in want:
                want[n] = start
                todo += near[n]
    assert {r.node: r.component for r in layout.connected(spark.createDataFrame(edges, "a long, b long")).collect()} == want


def test_anchor_pairs_past_four_hundred_words(spark, made):
    rng = Random(4)
    texts = [" ".join(rng.choices(["the", "Of", "x"], [1, 1, rng.choice([5, 80])], k=n)) for n in (30, 900, 2000)]
    want = set()
    for d, t in enumerate(texts, 1):
        w = t.lower().split()
        for i, x in enumerate(w):
            if x == "the" and "of" in w[i + 1 : i + 41]:
                want.add((d, i, w.index("of", i + 1) - i))
    got = [tuple(r) for r in pagework.anchor_pairs(spark, documents(made, *texts)).select("doc_id", "pos", "gap").collect()]
    assert set(got) == want and len(got) == len(want) and max(pos for _, pos, _ in got) > 1000


def verbatim(old, new):
    """The reference's rule on (place, text) lists."""
    out, unused = {}, list(range(len(old)))
    for i, (_, x) in enumerate(new):
        if (j := next((j for j in unused if old[j][1] == x), None)) is not None:
            out[i] = (j, "equal")
            unused.remove(j)
    rest, texts = [i for i in range(len(new)) if i not in out], [x for _, x in old]
    if len(rest) == len(unused):
        out |= {i: (j, "place") for i, j in zip(rest, unused, strict=True)}
    else:
        out |= {i: (texts.index(new[i][1]), "again") for i in rest if new[i][1] in texts}
    return {(old[j][0], new[i][0], how) for i, (j, how) in out.items()}


def test_lines_are_compared_past_the_sixtieth(spark, made):
    rng = Random(5)
    texts = [[rng.choice("abcdefgh") + str(rng.randrange(k)) for _ in range(n)] for n, k in ((150, 1), (130, 90), (20, 3))]
    sf = documents(made, *map("\n".join, texts))
    multi, match, counts = {}, set(), {}
    for d, t in enumerate(texts, 1):
        kept = [(i, x) for i, x in enumerate(t) if i % 13 != 7]
        multi[d] = sum((Counter(t) - Counter(x for _, x in kept)).values())
        new = [x for i, x in kept for _ in range(2 if i % 9 == 4 else 1)]
        counts[d] = (len(t), len(new))
        match |= {(d, *m) for m in verbatim(list(enumerate(t)), [(i, x.upper() if i % 7 == 5 else x) for i, x in enumerate(t) if i % 10 != 3 or i % 20 == 3])}
    assert {r.doc_id: r.n for r in scoring.plan_multiset_diff(spark, sf).where("side = 'old'").collect()} == multi
    assert {tuple(r) for r in pagework.verbatim_match(spark, sf).select("doc_id", "old", "new", "how").collect()} == match
    ops = {(r.doc_id, r.op): r.n for r in scoring.plan_diff(spark, sf).collect()}
    assert {d: (ops[d, "equal"] + ops[d, "delete"], ops[d, "equal"] + ops[d, "insert"]) for d in counts} == counts


def test_further_copies_of_a_matched_line(spark):
    cases = [("aab", "aaaab"), ("abc", "xaa"), ("abc", "aXb"), ("ab", "aabbq"), ("aabc", "bbd"), ("a", "aaa"), ("", "a")]
    side = lambda k: spark.createDataFrame([(d, i, x) for d, c in enumerate(cases) for i, x in enumerate(c[k])], "doc_id long, seg_no int, text string")
    want = {(d, *m) for d, (a, b) in enumerate(cases) for m in verbatim(list(enumerate(a)), list(enumerate(b)))}
    got = [tuple(r) for r in pagework.matched_lines(side(0), side(1)).select("doc_id", "old", "new", "how").collect()]
    assert set(got) == want and len(got) == len(want) and (0, 0, 2, "again") in want


def test_lists_entries_and_slots_of_long_documents(spark, made):
    lines = [f"entry {i} " + "of a long title " * (i % 6) + "end 12 .." for i in range(430)]
    sf = documents(made, "\n".join(lines))
    # 7 numbers begin every 11 lines; 430 lines end with a list of one, which is too short
    lists = rowwork.numbered_lists(spark, sf).collect()
    assert sorted((r.first, r["last"], r.n) for r in lists) == [(i, i + 6, 7) for i in range(0, 429, 11)]
    titles = {r.seg_no: (r.title_sha, r.page) for r in rowwork.leaders(spark, sf).collect()}
    assert titles == {i: (sha1(t.rstrip(" .0123456789").encode()).hexdigest(), str(i * 7) if i % 3 == 0 else "") for i, t in enumerate(lines)}
    slots = {r.seg_no: (r.kept, r.alien) for r in pairs.slot_checks(spark, sf).collect()}
    assert slots == {i: (i % 3 == 0, int(i % 3 == 1)) for i in range(430)}


def test_page_operators_take_every_page_line_and_word(spark, made):
    lines = [" ".join("w" * (1 + (i * 7 + k * 5) % 19) for k in range(1 + i % 23)) for i in range(130)]
    sf = documents(made, "\n".join(lines))
    boxes = sorted(((r.page, r["class"], r.ord, r.x0, r.y0, r.x1, r.y1) for w in ("ref", "new") for r in layout.detections(spark, sf, w).collect()), key=lambda b: (-((b[2] * 37 + int(b[3])) % 101), b[2]))
    kept = []
    for b in boxes:
        size = lambda q: (q[5] - q[3]) * (q[6] - q[4])
        both = lambda q: max(0, min(q[5], b[5]) - max(q[3], b[3])) * max(0, min(q[6], b[6]) - max(q[4], b[4]))  # noqa: B023, E731
        if not any(q[:2] == b[:2] and both(q) / (size(q) + size(b) - both(q)) > 0.45 for q in kept):
            kept.append(b)
    assert sorted((r["class"], r.ord) for r in layout.nms(spark, sf).collect()) == sorted(b[1:3] for b in kept)
    words = [len(x.split()) for x in lines]
    rows = layout.word_rows(spark, sf).collect()
    assert {p: sum(r.words for r in rows if r.page == p) for p in range(4)} == {p: sum(words[40 * p : 40 * p + 40]) for p in range(4)}
    merged = {r.page: (r.left, r.pieces) for r in rowwork.same_line_merge(spark, sf).collect()}
    # a gap of 20 - length % 17 after a word: over 12 keeps it apart from the next
    apart = [1 + sum(len(w) % 17 < 8 for w in x.split()[:-1]) for x in lines]
    assert merged == {p: (sum(apart[40 * p : 40 * p + 40]), sum(words[40 * p : 40 * p + 40])) for p in range(4)}


def test_pieces_merge_as_by_passes_over_all_pairs(spark):
    rng = Random(6)
    boxes = [(p, float(rng.randrange(90)), float(rng.randrange(9)), 0.0, 0.0, f"t{i}") for p in range(6) for i in range(40)]
    boxes = [(p, x, y, x + rng.randrange(1, 9), y + rng.randrange(3, 9), t) for p, x, y, _, _, t in {(b[0], b[1], b[2]): b for b in boxes}.values()]
    want = []
    for p in range(6):
        rows, changed = sorted((list(b[1:]) for b in boxes if b[0] == p), key=lambda r: (r[1], r[0])), True
        while changed:
            pair = next(((i, j) for i, a in enumerate(rows) for j, b in enumerate(rows) if i != j and abs(a[1] - b[1]) <= 2 and 0 <= b[0] - a[2] <= 12), None)
            if changed := pair is not None:
                a, b = rows[pair[0]], rows[pair[1]]
                a[2:] = [max(a[2], b[2]), max(a[3], b[3]), f"{a[4]} {b[4]}"]
                del rows[pair[1]]
        want += [(p, *r) for r in rows]
    df = spark.createDataFrame(boxes, "p int, x0 double, y0 double, x1 double, y1 double, text string")
    assert sorted(tuple(r)[:6] for r in rowwork.merged_pieces(df, ["p"]).collect()) == sorted(want)


def test_the_glossary_takes_every_term(spark, made):
    names = [f"alpha{i} beta{i}" for i in range(150)]
    sf = documents(made, *["\n".join([n] * 3) for n in names], "so " + names[140])
    want = {(n.upper(), "user", 0) if k % 3 == 0 else (n, n.upper(), 1) for k, n in enumerate(sorted(names), 1)}
    got = terms.glossary_union(spark, sf).collect()
    assert len(got) == 150 and {tuple(r) for r in got} == want
    assert {tuple(r) for r in terms.glossary_mentions(spark, sf).collect()} == {(i + 1, n) for i, n in enumerate(names)} | {(151, names[140])}


def test_places_in_order(spark):
    rows = [((i * 37) % 11, f"k{i}") for i in range(500)]
    df = spark.createDataFrame(rows, "n int, k string").repartition(7)
    got = {r.k: r.ord for r in terms.numbered(df, df.n.desc(), df.k).collect()}
    assert got == {k: i for i, (_, k) in enumerate(sorted(rows, key=lambda r: (-r[0], r[1])), 1)}


def test_references_that_go_round_are_an_error(spark):
    o = spark.createDataFrame([(1, "a", 2), (2, "b", 1)], "obj long, body string, ref long")
    with pytest.raises(RuntimeError):
        layout.merged_to_fixpoint(o, most=3)
