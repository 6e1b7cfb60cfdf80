"""Trees of hand-made nodes: ranges, moved roots, named chapters and thinned leaves."""

from leafwright.operators import repairs as r


def nodes(*rows):
    """(level, title, start, end, aux, top) as a tree."""
    return r.tree([{"ord": i, "level": n[0], "title": n[1], "start": n[2], "end": n[3], "aux": n[4] if len(n) > 4 else False, "top": n[5] if len(n) > 5 else True} for i, n in enumerate(rows)])


def spans(ns):
    return [(n["title"], n["start"], n["end"]) for n in r.flat(ns)]


def test_siblings_end_before_the_next_begins():
    got = spans(r.normalise_ranges(nodes((1, "a", 1, None), (2, "a1", 1, 2), (2, "a2", 9, None), (1, "b", 4, 7), (1, "c", 7, 99)), 10))
    # b keeps page 7, which c begins on; a2 begins beyond its parent and is pulled inside
    assert got == [("a", 1, 3), ("a1", 1, 2), ("a2", 3, 3), ("b", 4, 7), ("c", 7, 10)]


def test_catalogs_stand_outside_the_order():
    got = spans(r.normalise_ranges(nodes((1, "a", 2, None), (1, "figures", 1, None, True), (1, "b", 5, None)), 8))
    assert got == [("a", 2, 4), ("figures", 1, 1), ("b", 5, 8)]
    assert spans(r.normalise_ranges(nodes((1, "a", None, None), (1, "b", 50, 3)), 6)) == [("a", 1, 6), ("b", 6, 6)]


def test_ranges_derived_from_starts():
    got = spans(r.derive_ranges(nodes((1, "a", 1, None), (2, "a1", 2, None), (2, "a2", 3, None, False, False), (1, "fig", 4, None, True, True), (1, "b", 6, None)), 9))
    assert got == [("a", 1, 3), ("a1", 2, 3), ("a2", 3, 3), ("fig", 4, 4), ("b", 6, 9)]


def test_continued_cases_and_bare_chapters():
    got = r.move_continued(nodes((1, "案例 one", 1, 2), (1, "医疗AI: two", 3, 6), (2, "kid", 4, 5), (1, "other", 7, 8), (1, "法律AI: three", 9, 9)))
    assert [(n["level"], n["title"], n["end"]) for n in r.flat(got)] == [(1, "案例 one", 6), (2, "医疗AI: two", 6), (2, "kid", 5), (1, "other", 8), (1, "法律AI: three", 9)]
    named = r.name_chapters(nodes((1, "第一章 Chapter 1", 1, 2), (2, "水务: x", 1, 1), (2, "电力：y", 2, 2), (1, "第二章Chapter 2", 3, 4), (2, "only", 3, 3), (1, "第三章 Chapter 3", 5, 5)))
    assert [n["title"] for n in named] == ["水务与电力", "only", "第三章 Chapter 3"]


def test_thinning_takes_in_what_is_below():
    rows = [(1, "short"), (2, "x" * 40), (2, "y"), (3, "z\n"), (1, "w" * 50), (2, "v")]
    got = r.thin([{"ord": i, "level": a, "text": t} for i, (a, t) in enumerate(rows)], 20)
    assert [(n["ord"], n["text"]) for n in got] == [(0, "short\n\n" + "x" * 40 + "\n\ny\n\nz\n"), (4, "w" * 50), (5, "v")]
    assert r.thin([], 5) == []
